import re
from collections import Counter
from math import floor, log

import numpy as np
import pytest

from noticeloom.llm import mixing, search

QUERY = "item_id long, text string, doc_id string"


def test_targets_share_what_full_sources_leave(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 500), (None, 90), ("d", 0)], "source string, source_size long")
    got = {r.source: r for r in mixing.targets(sizes).collect()}
    assert [got[s].place for s in ("a", "b", "c", "d", None)] == [0, 1, 2, 3, 4]
    # weights 5, 2, 1, 5, 2 of 1600 words: a, d and null are full at 30, 0 and 270; b and c share 1300 by 2 : 1
    assert {s: round(r.target, 6) for s, r in got.items()} == {"a": 30, "b": round(2600 / 3, 6), "c": round(1300 / 3, 6), "d": 0, None: 270}


def test_schedule_keeps_every_run_near_the_shares(spark):
    plan = spark.createDataFrame([(0, 600), (1, 0), (2, 300), (3, 99), (4, 1)], "place long, slots long")
    rows = sorted(tuple(r) for r in mixing.schedule(plan, 1000).collect())
    assert Counter(p for _, p, _ in rows) == {0: 600, 2: 300, 3: 99, 4: 1}
    for place in (0, 2, 3):
        assert [s for _, p, s in rows if p == place] == list(range(sum(p == place for _, p, _ in rows)))
    for k in range(50, 1000, 50):
        upto = Counter(p for at, p, _ in rows if at < k)
        assert abs(upto[0] - 0.6 * k) < 4 and abs(upto[2] - 0.3 * k) < 4
    assert len(set(np.array([mixing_point(i) for i in range(1000)]))) == 1000


def mixing_point(i):
    return i * mixing.GOLDEN % (1 << mixing.BITS)


@pytest.mark.parametrize("block", [7, 1024])
def test_mix_takes_targets_word_by_word(spark, docs, rows, block):
    mix = mixing.Mix(docs, block=block)
    pieces = [r.asDict() for r in mix.pieces().collect()]
    size = {(r.place, r.row): r["size"] for r in mix.rows.collect()}
    texts = Counter((len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")), r[3]) for r in rows)
    assert Counter((r["size"], r.source) for r in mix.rows.collect()) == texts
    # each word of a document is taken equally often or once more, and each slot is at most a block
    for at in {(p["place"], p["row"]) for p in pieces}:
        times = np.zeros(size[at], int)
        for p in pieces:
            if (p["place"], p["row"]) == at:
                times[p["from"] : p["from"] + p["length"]] += 1
        assert times.max() <= 3 and times.max() - times.min() <= 1
    slots = Counter()
    for p in pieces:
        slots[p["position"], p["place"]] += p["length"]
    assert max(slots.values()) <= block and len({at for at, _ in slots}) == len(slots)
    took = Counter()
    for p in pieces:
        took[p["place"]] += p["length"]
    plan = {r.place: r for r in mix.plan.collect()}
    assert {k: r.quota for k, r in plan.items() if r.quota} == dict(took)
    assert all(abs(r.quota - r.target) <= 0.5 for r in plan.values())


def test_mixing_agrees_with_its_closed_form(spark, docs, rows):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    columns = "doc_id, source, size, source_size, target, taken"
    got = mixing.digest(docs.repartition(5)).select(*columns.split(", ")).toArrow()
    con.register("got", got)
    assert len(got) == len(rows)
    assert con.sql(f"SELECT {columns} FROM got EXCEPT ALL ({mixing.SQL})").fetchall() == []


def test_mixing_of_odd_tables(spark, no_docs):
    assert mixing.digest(no_docs).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, " \t", None), (None, "", "a")], "doc_id long, text string, source string")
    assert {(r.taken, r.target) for r in mixing.digest(blank).collect()} == {(0, 0.0)}
    one = spark.createDataFrame([(1, "x " * 5000, None)] * 3, "doc_id long, text string, source string")
    assert sum(r.taken for r in mixing.digest(one).collect()) == 15000


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, queries, top):
    known = [(r[0], Counter(terms(r[1]))) for r in rows]
    known = [(d, c, c.total()) for d, c in known if c]
    N, L = len(known), sum(n for *_, n in known)
    df = Counter(t for _, c, _ in known for t in c)
    out = []
    for item, text, *_ in queries:
        hits = []
        for doc, c, n in known:
            m = 100 - 50 + (50 * n * N) // L
            score = sum(floor(1000 * log((2 * N + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                hits.append((-score, doc is None, doc or 0))
        out += [(item, k + 1, None if null else doc, -score) for k, (score, null, doc) in enumerate(sorted(hits)[:top])]
    return Counter(out)


@pytest.mark.parametrize(("reach", "postings", "top"), [(1, 40, 3), (4, 10**6, 2), (2048, 10**6, 50)])
def test_search_equals_scoring_every_document(spark, docs, rows, monkeypatch, reach, postings, top):
    monkeypatch.setattr(search, "REACH", reach)
    monkeypatch.setattr(search, "POSTINGS", postings)
    queries = [(1, rows[0][1], "x"), (2, rows[2][1].upper() + " no such word", "x"), (3, "ONE é" + "é" * 119, "x"), (3, "two", "x"), (None, rows[5][1], "x"), (5, None, "x"), (6, "!! ,", "x"), (7, "", "x")]
    got = search.search(docs, spark.createDataFrame(queries, QUERY), top)
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "int", "bigint", "bigint"]
    assert Counter(tuple(r) for r in got.collect()) == brute(rows, [q for q in queries if q[1]], top)


def test_search_in_blocks_and_empty_tables(spark, docs, no_docs, rows):
    queries = [(k, rows[k][1], "x") for k in range(12)]
    asked = spark.createDataFrame(queries, QUERY)
    assert Counter(tuple(r) for r in search.search(docs, asked, 5, block_bytes=2000).collect()) == brute(rows, queries, 5)
    assert search.search(no_docs, asked).count() == 0
    assert search.search(docs, asked.where("false")).count() == 0


def test_wand_passes_over_documents(rows):
    rng = np.random.default_rng(3)
    n, per = 20_000, []
    for t, share in enumerate((0.5, 0.5, 0.001)):
        at = np.flatnonzero(rng.random(n) < share)
        per.append((at, np.full(len(at), t), rng.integers(1, 1000, len(at))))
    docs, which, impacts = (np.concatenate(x) for x in zip(*per, strict=True))
    inverted = search.Inverted(docs.astype(np.int32), which.astype(np.int32), impacts, 3)
    heap, ids = search.Heap(5), np.arange(n)
    weights = np.array([1, 1, 900])
    scored = search.wand(inverted, n, np.arange(3), weights, heap, ids, np.zeros(n, bool))
    total = np.bincount(docs, impacts * weights[which], n).astype(int)
    assert heap.score.tolist() == sorted(total, reverse=True)[:5]
    assert scored < n / 4
