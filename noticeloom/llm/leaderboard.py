"""Change feed of each nation's ten best-selling items: two chained levels of stateful streaming."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from noticeloom.llm.common import cut, shared_folder

# Day 0 of the batches, days they span, days that hash to a missing date, days of lateness, rows of a board.
FIRST_DAY, SPAN, SPREAD, LATENESS, TOP = 19723, 180, 150, 3, 10
#: Items of one nation that a shard holds on average, in all nations together: its state is some 64 KB.
ITEMS_PER_SHARD = 4096
LEAST_SHARDS = 8
#: Sums that a task holds before it hands them on.
HELD = 200_000

LINE = "nation_id int, item_id long, day long, arrival_day long, cents long"
SUM = "nation_id int, shard int, arrival_day long, item_id long, cents long"
LISTED = "nation_id int, arrival_day long, item_id long, cents long, listed boolean"
CHANGE = "nation_id int, arrival_day long, item_id long, change string, old_rank int, new_rank int, revenue long"


def timed(lines: DataFrame, batches: int) -> DataFrame:
    """The lines with day (shipped), arrival_day and batch, all from the line itself."""
    key = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("sale_id", "item_id", "vendor_id", "line_no")]
    h = F.crc32(F.concat_ws(",", *key))
    out = lines.select(
        "item_id", "vendor_id", "quantity", "amount", "flag", h.alias("h"),
        F.coalesce(F.unix_date(F.to_date("shipped_at")).cast("long"), F.lit(FIRST_DAY) + h % SPREAD).alias("day"),
    )
    out = out.withColumn("arrival_day", F.col("day") + F.col("h") % 7 + F.when(F.col("h") % 5 == 0, 20).otherwise(0))
    batch = 1 + F.floor((F.col("arrival_day") - FIRST_DAY) * batches / SPAN)
    return out.withColumn("batch", F.greatest(F.lit(1), F.least(F.lit(batches), batch)).cast("int")).drop("h")


def cents(price: Column) -> Column:
    finite = F.when(~F.isnan(price) & (F.abs(price) < float("inf")), price)
    return F.floor(100 * finite + 0.5)


def priced(lines: DataFrame, items: DataFrame, vendors: DataFrame) -> DataFrame:
    """Lines of known items and of vendors with a nation, with their revenue in cents.

    Both joins are by shuffle, whose hot keys Spark splits at run time: neither table is broadcast, as both
    grow with the shop. An id that its table repeats counts once, with its largest price or nation.
    """
    prices = cut(items.where("item_id is not null").groupBy("item_id").agg(F.max("price").alias("price")))
    nations = cut(vendors.where("vendor_id is not null and nation_id is not null").groupBy("vendor_id").agg(F.max("nation_id").cast("int").alias("nation_id")))
    value = F.coalesce(cents(F.col("amount")), F.col("quantity") * cents(F.col("price")), F.lit(0))
    sold = lines.join(prices.hint("merge"), "item_id").select(
        "item_id", "vendor_id", "day", "arrival_day", "batch", F.when(F.col("flag") == "swapped", -value).otherwise(value).cast("long").alias("cents")
    )
    return sold.join(nations.hint("merge"), "vendor_id").select("nation_id", "item_id", "day", "arrival_day", "cents", "batch")


def combined(batches: Iterator[pa.RecordBatch], held: int = HELD) -> Iterator[pa.RecordBatch]:
    """Sums by nation, shard, arrival day and item before the shuffle, so that a hot item is a row a task and day."""
    keys, parts, rows = ["nation_id", "shard", "arrival_day", "item_id"], [], 0

    def summed() -> pa.Table:
        whole = pa.Table.from_batches(parts) if isinstance(parts[0], pa.RecordBatch) else pa.concat_tables(parts)
        return whole.group_by(keys, use_threads=False).aggregate([("cents", "sum")]).rename_columns([*keys, "cents"])

    for batch in batches:
        parts.append(pa.Table.from_batches([batch]).select([*keys, "cents"]))
        rows += batch.num_rows
        if rows >= held:
            whole = summed()
            parts, rows = [whole], whole.num_rows
            if rows >= held // 2:
                yield from whole.to_batches()
                parts, rows = [], 0
    if parts:
        yield from summed().to_batches()


def best(ids: np.ndarray, cents: np.ndarray, top: int = TOP) -> np.ndarray:
    """Positions of the highest positive cents, best first, equal cents by smaller id."""
    at = np.flatnonzero(cents > 0)
    if len(at) > top:
        at = at[cents[at] >= np.partition(cents[at], len(at) - top)[len(at) - top]]
    return at[np.lexsort((ids[at], -cents[at]))][:top]


def gathered(rows: Iterator[pd.DataFrame], *columns: str) -> list[np.ndarray]:
    """Columns of a key's rows, in order of arrival day."""
    frames = list(rows)
    out = [np.concatenate([f[c].to_numpy() for f in frames]) for c in columns]
    order = np.argsort(out[0], kind="stable")
    return [x[order] for x in out]


def runs(days: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of equal days."""
    edge = np.flatnonzero(np.diff(days, prepend=days[0] - 1, append=days[-1] + 1)).tolist()
    return zip(edge[:-1], edge[1:], strict=True)


def packed(*arrays: np.ndarray) -> tuple[bytes, ...]:
    return tuple(x.astype(np.int64).tobytes() for x in arrays)


def unpacked(state: GroupState, n: int) -> tuple[np.ndarray, ...]:
    """The n arrays of a key's state, empty at first."""
    return tuple(np.frombuffer(x, np.int64) for x in state.get) if state.exists else (np.zeros(0, np.int64),) * n


SUMS, LISTS = "ids binary, cents binary", "ids binary, cents binary, board binary"


def shard(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """First level: revenue of one bucket of a nation's items.

    Emits, a day at a time, what the nation's merger has to know: each item that entered or left the
    bucket's own top ten or whose revenue changed while it is listed, with its revenue afterwards.
    """
    days, items, added = gathered(rows, "arrival_day", "item_id", "cents")
    ids, sums = unpacked(state, 2)
    every = np.union1d(ids, items)
    total = np.zeros(len(every), np.int64)
    total[np.searchsorted(every, ids)] = sums
    at, listed, out = np.searchsorted(every, items), best(every, total).tolist(), []
    for i, j in runs(days):
        np.add.at(total, at[i:j], added[i:j])
        now = best(every, total).tolist()
        told = set(listed).symmetric_difference(now) | set(now).intersection(at[i:j].tolist())
        out += [(days[i], x, total[x], x in now) for x in sorted(told)]
        listed = now
    state.update(packed(every, total))
    if out:
        day, which, cents, on = (np.array(x) for x in zip(*out, strict=True))
        yield pd.DataFrame({"nation_id": np.full(len(out), key[0], np.int32), "arrival_day": day, "item_id": every[which], "cents": cents, "listed": on})


def merged(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Second level: one nation's board from the top tens of its shards.

    The shards' lists hold every item that can be among the nation's ten, as a list of ten from each
    bucket under the same order does; the state holds these lists and the last board.
    """
    days, items, value, listed = gathered(rows, "arrival_day", "item_id", "cents", "listed")
    ids, sums, board = unpacked(state, 3)
    every = np.union1d(ids, items)
    total, inside = np.zeros(len(every), np.int64), np.zeros(len(every), bool)
    at, old = np.searchsorted(every, ids), np.searchsorted(every, board)
    total[at], inside[at] = sums, True
    at, out = np.searchsorted(every, items), []
    for i, j in runs(days):
        total[at[i:j]], inside[at[i:j]] = value[i:j], listed[i:j]
        now = best(every, np.where(inside, total, 0))
        was, is_ = ({x: k + 1 for k, x in enumerate(b.tolist())} for b in (old, now))
        for x in sorted(was.keys() | is_.keys()):
            a, b = was.get(x), is_.get(x)
            if a != b:
                out.append((key[0], days[i], every[x], "enter" if a is None else "exit" if b is None else "move", a, b, total[x]))
        old = now
    state.update(packed(every[inside], total[inside], every[old]))
    if out:
        frame = pd.DataFrame(out, columns=["nation_id", "arrival_day", "item_id", "change", "old_rank", "new_rank", "revenue"])
        yield frame.astype({"nation_id": "int32", "arrival_day": "int64", "item_id": "int64", "old_rank": "Int32", "new_rank": "Int32", "revenue": "int64"})


#: Settings of the stream, put back afterwards. A state store lives for one task and goes at its commit; RocksDB
#: would keep half a MB (by estimate) outside the heap for each one ever opened, and each start opens one a partition and level.
STREAM = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.checkpoint.fileChecksum.enabled": "false",  # file systems keep checksums of their own
}
#: For folders of the file scheme: the default manager starts a process for each file that it renames there.
LOCAL = {"spark.sql.streaming.checkpointFileManagerClass": "org.apache.spark.sql.execution.streaming.checkpointing.FileSystemBasedCheckpointFileManager"}


def moved(spark: SparkSession, path: str, to: str) -> bool:
    """Move a folder on the cluster's file system, as files reach a watched folder; false if there is none."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    a, b = hadoop.Path(path), hadoop.Path(to)
    files = a.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(a):
        return False
    files.mkdirs(b.getParent())
    if not files.rename(a, b):
        raise OSError(f"{path} can't be moved to {to}")
    return True


def run(rows: DataFrame, at: str, to: str, name: str) -> None:
    """Run a stream over what is new, from and to the state in `at`/`name`, until it is done."""
    rows.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{at}/{name}").option("path", to).trigger(availableNow=True).start().awaitTermination()


def feed(spark: SparkSession, at: str, earlier: int | None, shards: int) -> None:
    """Run both levels over what is new in the watched folder: the shards', then the mergers' over what those wrote.

    Two queries, as Spark takes one applyInPandasWithState in each.
    """
    lines = spark.readStream.schema(LINE).option("recursiveFileLookup", "true").parquet(f"{at}/fed")
    if earlier is not None:
        lines = lines.where(F.col("day") + LATENESS >= earlier)
    keyed = lines.select("nation_id", F.pmod(F.xxhash64("item_id"), F.lit(shards)).cast("int").alias("shard"), "arrival_day", "item_id", "cents")
    sums = keyed.mapInArrow(combined, SUM)
    local = sums.groupBy("nation_id", "shard").applyInPandasWithState(shard, LISTED, SUMS, "append", GroupStateTimeout.NoTimeout)
    run(local, at, f"{at}/listed", "state")
    listed = spark.readStream.schema(LISTED).parquet(f"{at}/listed")
    boards = listed.groupBy("nation_id").applyInPandasWithState(merged, CHANGE, LISTS, "append", GroupStateTimeout.NoTimeout)
    run(boards, at, f"{at}/changes", "boards")


def changes(lines: DataFrame, items: DataFrame, vendors: DataFrame, batches: int = 10, shards: int | None = None) -> DataFrame:
    """Changes of every nation's board after each arrival day: one row an item whose rank differs.

    The lines are cut into batches by arrival day, written to a new folder under the shared one, and fed in
    order to a stream that is started anew for each batch on one checkpoint. A batch's lines are dropped if
    they were shipped more than three days before the latest day that any earlier batch holds.

    Lines of one nation are dealt to `shards` buckets of items (by default one for every 4,096 rows of items,
    eight at least), each with a state of its own; equal items are summed before they are dealt, so a hot
    nation, item or vendor is spread over all tasks. A merger holds ten items of each of its nation's shards.

    Null: an amount falls back to quantity and price and then to 0, as does one that is no finite number; a
    missing date to a day by hash; lines without item, vendor or nation are ignored, but their days count.
    Repeated lines count as often as they occur; empty tables give an empty result. Days before the first
    batch belong to it. Further columns of the tables are not read.
    """
    spark = lines.sparkSession
    at = os.path.join(shared_folder(spark), f"leaderboard-{uuid.uuid4().hex}")
    shards = shards or max(LEAST_SHARDS, -(-items.count() // ITEMS_PER_SHARD))
    dated = timed(lines, batches)
    latest = dict(dated.groupBy("batch").agg(F.max("day")).collect())  # a row a batch
    priced(dated, items, vendors).write.partitionBy("batch").parquet(f"{at}/lines")
    settings, fed = STREAM | (LOCAL if at.startswith(("file:", "/")) else {}), False
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        for k in sorted(latest):
            if moved(spark, f"{at}/lines/batch={k}", f"{at}/fed/{k}"):
                feed(spark, at, max((d for b, d in latest.items() if b < k), default=None), shards)
                fed = True
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    batch = F.greatest(F.lit(1), F.least(F.lit(batches), 1 + F.floor((F.col("arrival_day") - FIRST_DAY) * batches / SPAN))).cast("int")
    found = spark.read.schema(CHANGE).parquet(f"{at}/changes") if fed else spark.createDataFrame([], CHANGE)
    return found.select("nation_id", "arrival_day", "item_id", batch.alias("batch"), "change", "old_rank", "new_rank", "revenue")


#: The feed of `changes` with default parameters, in DuckDB's SQL (which has no crc32: it is folded byte by byte).
SQL = r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), keyed AS (
  SELECT l.*, concat_ws(',', coalesce(sale_id::VARCHAR, ''), coalesce(l.item_id::VARCHAR, ''), coalesce(l.vendor_id::VARCHAR, ''), coalesce(line_no::VARCHAR, '')) AS k
  FROM sale_lines l
), hashed AS (
  SELECT keyed.*, xor(list_reduce(list_concat([4294967295], list_transform(string_split(k, ''), lambda c: ascii(c)::BIGINT)),
    lambda c, b: xor(c >> 8, t[1 + xor(c & 255, b)])), 4294967295) AS h
  FROM keyed, crc
), dated AS (
  SELECT *, coalesce(date_diff('day', DATE '1970-01-01', shipped_at::DATE), 19723 + h % 150) AS s FROM hashed
), arriving AS (
  SELECT *, s + h % 7 + CASE WHEN h % 5 = 0 THEN 20 ELSE 0 END AS a FROM dated
), cut AS (
  SELECT *, greatest(1, least(10, 1 + floor((a - 19723) * 10 / 180)))::INTEGER AS batch FROM arriving
), latest AS (
  SELECT batch, max(max(s)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM cut GROUP BY batch
), sold AS (
  SELECT v.nation_id, c.item_id, a, c.batch,
    coalesce(floor(100 * amount + 0.5), quantity * floor(100 * price + 0.5), 0)::BIGINT * CASE WHEN flag = 'swapped' THEN -1 ELSE 1 END AS cents
  FROM cut c JOIN latest USING (batch) JOIN vendors v USING (vendor_id) JOIN items i ON i.item_id = c.item_id
  WHERE v.nation_id IS NOT NULL AND (seen IS NULL OR s + 3 >= seen)
), daily AS (
  SELECT nation_id, item_id, a, any_value(batch) AS batch, sum(cents)::BIGINT AS cents FROM sold GROUP BY ALL
), days AS (
  SELECT nation_id, a, any_value(batch) AS batch, row_number() OVER (PARTITION BY nation_id ORDER BY a) AS n FROM daily GROUP BY nation_id, a
), running AS (
  SELECT nation_id, item_id, n, sum(cents) OVER w AS revenue, lead(n) OVER w AS until
  FROM daily JOIN days USING (nation_id, a) WINDOW w AS (PARTITION BY nation_id, item_id ORDER BY a)
), held AS (
  SELECT r.nation_id, r.item_id, d.n, r.revenue FROM running r JOIN days d ON d.nation_id = r.nation_id AND d.n >= r.n AND (r.until IS NULL OR d.n < r.until)
), board AS (
  SELECT *, row_number() OVER (PARTITION BY nation_id, n ORDER BY revenue DESC, item_id) AS rank FROM held WHERE revenue > 0
), top AS (SELECT * FROM board WHERE rank <= 10
), moved AS (
  SELECT coalesce(x.nation_id, y.nation_id) AS nation_id, coalesce(x.item_id, y.item_id) AS item_id, coalesce(x.n, y.n) AS n, y.rank AS old_rank, x.rank AS new_rank
  FROM top x FULL JOIN (SELECT nation_id, item_id, n + 1 AS n, rank FROM top) y ON x.nation_id = y.nation_id AND x.item_id = y.item_id AND x.n = y.n
  WHERE x.rank IS DISTINCT FROM y.rank
)
SELECT m.nation_id::INTEGER AS nation_id, d.a::BIGINT AS arrival_day, m.item_id, d.batch,
  CASE WHEN old_rank IS NULL THEN 'enter' WHEN new_rank IS NULL THEN 'exit' ELSE 'move' END AS change,
  old_rank::INTEGER AS old_rank, new_rank::INTEGER AS new_rank, h.revenue::BIGINT AS revenue
FROM moved m JOIN days d USING (nation_id, n) JOIN held h USING (nation_id, item_id, n)
"""
