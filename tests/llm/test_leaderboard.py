import datetime as dt
import random
import zlib
from collections import Counter, defaultdict
from math import floor

import numpy as np
import pyarrow as pa

from noticeloom.llm import leaderboard

LINE = "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, flag string, shipped_at timestamp_ntz, nation_id string"
ITEM, VENDOR = "item_id long, price double, brand string", "vendor_id long, nation_id int, price string"


def tables(seed=4):
    rng, lines = random.Random(seed), []
    for k in range(900):
        day = dt.datetime(2024, 1, 1) + dt.timedelta(days=rng.randrange(60), hours=rng.randrange(24))
        lines.append((
            rng.choice([k, k, None]), rng.choice([1, 2, None]), rng.choice([*range(40), 1, 1, 1, 99, None]), rng.choice([1, 1, 2, 3, 4, 9, None]), rng.choice([1, 5, None]),
            rng.choice([round(rng.uniform(0, 90), 2), 12.5, None, float("nan")]), rng.choice(["kept", "kept", "swapped", None]), rng.choice([day, day, day, None]), "x",
        ))
    lines += lines[:30]
    return lines, [(k, rng.choice([2.5, 7.0, None]), "b") for k in range(40)] + [(None, 1.0, "b")], [(1, 7, "p"), (2, 7, "p"), (3, 8, "p"), (4, None, "p"), (None, 7, "p")]


def brute(lines, items, vendors):
    price, nation = {i: p for i, p, _ in items if i is not None}, {v: n for v, n, _ in vendors if v is not None}
    dated = []
    for sale, line, item, vendor, quantity, amount, flag, at, _ in lines:
        h = zlib.crc32(",".join("" if x is None else str(x) for x in (sale, item, vendor, line)).encode())
        s = 19723 + h % 150 if at is None else (at - dt.datetime(1970, 1, 1)).days
        a = s + h % 7 + 20 * (h % 5 == 0)
        dated.append((min(10, 1 + (a - 19723) * 10 // 180), a, s, item, vendor, quantity, amount, flag))
    seen, kept = None, []
    for b in range(1, 11):
        batch = [x for x in dated if x[0] == b]
        kept += [x for x in batch if seen is None or x[2] + 3 >= seen]
        seen = max([x[2] for x in batch] + ([seen] if seen is not None else []), default=None)
    revenue, board, out = defaultdict(Counter), defaultdict(list), []
    for a in sorted({x[1] for x in kept}):
        for b, _, _, item, vendor, quantity, amount, flag in (x for x in kept if x[1] == a):
            if item in price and nation.get(vendor) is not None:
                amount = None if amount is None or amount != amount else floor(100 * amount + 0.5)
                if amount is None and quantity is not None and price[item] is not None:
                    amount = quantity * floor(100 * price[item] + 0.5)
                revenue[nation[vendor]][item] += (amount or 0) * (-1 if flag == "swapped" else 1)
        for n, sums in revenue.items():
            now = sorted((i for i in sums if sums[i] > 0), key=lambda i: (-sums[i], i))[:10]
            for i in {*now, *board[n]}:
                old, new = (x.index(i) + 1 if i in x else None for x in (board[n], now))
                if old != new:
                    out.append((n, a, i, min(10, 1 + (a - 19723) * 10 // 180), "enter" if old is None else "exit" if new is None else "move", old, new, sums[i]))
            board[n] = now
    return out


def frames(spark, lines, items, vendors):
    return spark.createDataFrame(lines, LINE).repartition(3), spark.createDataFrame(items, ITEM), spark.createDataFrame(vendors, VENDOR)


def test_feed_equals_boards_of_every_day(spark):
    made = tables()
    got = [tuple(r) for r in leaderboard.changes(*frames(spark, *made), shards=3).collect()]
    assert Counter(got) == Counter(brute(*made))
    assert {r[4] for r in got} == {"enter", "exit", "move"} and len({r[3] for r in got}) > 3


def test_state_of_both_levels_is_outside_rocksdb(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(leaderboard, "shared_folder", lambda _: str(tmp_path))
    made = tables(6)
    assert Counter(tuple(r) for r in leaderboard.changes(*frames(spark, *made), shards=2).collect()) == Counter(brute(*made))
    kept = [p for p in tmp_path.glob("leaderboard-*/*/state/0/[0-9]*/*") if p.is_file() and not p.name.startswith(".")]
    assert len({p.parents[3] for p in kept}) == 2 and {p.suffix for p in kept} <= {".delta", ".snapshot"}


def test_feed_of_empty_tables(spark):
    lines, items, vendors = tables()
    assert leaderboard.changes(*frames(spark, [], items, vendors)).collect() == []
    assert leaderboard.changes(*frames(spark, lines[:20], [], vendors)).collect() == []


def test_sums_before_the_shuffle_lose_nothing():
    rng = np.random.default_rng(1)
    columns = [rng.integers(0, k, 5000) for k in (3, 2, 4, 50)] + [rng.integers(-99, 99, 5000)]
    names = ["nation_id", "shard", "arrival_day", "item_id", "cents"]
    batches = [pa.record_batch([c[k : k + 500] for c in columns], names=names) for k in range(0, 5000, 500)]
    for held in (100, 3000, 10**6):
        got = pa.Table.from_batches(leaderboard.combined(iter(batches), held)).to_pandas()
        assert got.groupby(names[:4])["cents"].sum().sort_index().equals(pa.Table.from_batches(batches).to_pandas().groupby(names[:4])["cents"].sum().sort_index())
    assert len(got) < 1300 and list(leaderboard.combined(iter([]))) == []


def test_best_of_ties():
    ids, cents = np.array([5, 9, 2, 7]), np.array([3, 3, 3, 0])
    assert ids[leaderboard.best(ids, cents, 2)].tolist() == [2, 5]
    assert leaderboard.best(ids, cents * 0).tolist() == []
