"""Shared pieces of the corpus operators: cutting lineage, distributed ranks, components, word hashes."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

U64 = np.uint64
CHUNK_BYTES = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, the folder that driver and executors share. A session without one gets a
    temporary folder if its master is local, as in tests; on a cluster that would be lost with an
    executor, so there it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
    return tempfile.mkdtemp(prefix="noticeloom-")


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the reliable checkpoint folder shared by the cluster (see shared_folder)."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str, bucket: Column) -> DataFrame:
    """Add `name`: the 0-based rank of each row within `keys`, without one task per key.

    `bucket` is a coarse integer that grows with `order`. Bucket counts (partially aggregated, so
    a hot key costs one row per bucket and task) give each bucket its start; row_number then ranks
    inside (keys, bucket) only. The count table has one row per key and bucket in use.
    """
    df = df.withColumn("_bucket", bucket)
    by = [*keys, "_bucket"]
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    starts = starts.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], "_start")
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)]
    joined = df.join(starts, same, "left").drop(*[f"_k{i}" for i in range(len(by))])
    inside = Window.partitionBy(*by).orderBy(*order)
    rank = F.coalesce(F.col("_start"), F.lit(0)) + F.row_number().over(inside) - 1
    return joined.withColumn(name, rank.cast("long")).drop("_start", "_bucket")


def release() -> None:
    """Give the memory that a task of a Python worker has freed back to the system: workers outlive
    their tasks, and the next stage's share an executor with what they keep."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """(id, component): smallest id reachable over edges (a, b), for every id that has an edge.

    Alternates large-star and small-star steps; each step keeps at most one edge per input edge,
    aggregates with map-side combine and is checkpointed, so no long chain lands in a task and nothing
    at the driver. The rows of one hub meet in one task of the joins, two numbers a row. Raises if
    `limit` rounds don't settle.
    """
    cur = cut(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("u <> v").distinct()
    )
    sign = cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    for _ in range(limit):
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: link each vertex's smaller neighbours to the smallest one
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
            .union(least.select("u", F.col("m").alias("v"))).distinct()
        )
        cur = cut(small)
        now = cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == sign:
            break
        sign = now
    else:
        raise RuntimeError(f"components did not settle in {limit} rounds")
    return cur.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        cur.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )


# --- Karp-Rabin word hashes -------------------------------------------------------------------

_rng = np.random.default_rng(20240607)
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
BYTE_LOWER = BYTE.copy()
BYTE_LOWER[65:91] = BYTE[97:123]
BASE = int(_rng.integers(1, 2**60)) * 8 + 3
STEP = _rng.integers(1, 2**63, 64, dtype=np.uint64) * U64(2) + U64(1)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base % 2**64, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Powers:
    """Powers of BASE and of its inverse mod 2**64, kept as long as the longest text seen."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, CHUNK_BYTES // 4)
            self.up, self.down = powers(BASE, n), powers(pow(BASE, -1, 2**64), n)
        return self.up, self.down


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(29))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(32))


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of texts of about `limit` bytes together, one at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow string or binary array as (all bytes, offsets); nulls are empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def word_hashes(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, pw: Powers, space: np.ndarray = IS_SPACE):
    """Hash every word of consecutive texts: (hash per word, index of the text per word).

    A word is a run of bytes not marked in `space`; words never cross texts. Prefix sums
    of byte code times BASE**position give each word's Karp-Rabin value by one subtraction.
    """
    lo, hi = int(offsets[0]), int(offsets[-1])
    n = hi - lo
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    d = data[lo:hi]
    word = ~space[d]
    first = np.zeros(n + 1, bool)
    begins = (offsets[:-1] - lo)[offsets[:-1] < offsets[1:]]
    first[begins] = True
    opens = word.copy()
    opens[1:] &= ~word[:-1] | first[1:n]
    closes = word.copy()
    closes[:-1] &= ~word[1:] | first[1:n]
    s, e = np.flatnonzero(opens), np.flatnonzero(closes)
    up, down = pw.of(n)
    codes = table[d]
    codes *= up[:n]
    total = np.cumsum(codes, dtype=np.uint64)
    before = np.where(s > 0, total[s - 1], U64(0))
    h = mix((total[e] - before) * down[s] + (e - s).astype(np.uint64) * U64(0x9E3779B97F4A7C15))
    return h, np.searchsorted(offsets - lo, s, "right") - 1


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive word hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += h[j : j + n] * STEP[j]
    return mix(out)


def shingle_set(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct k-word shingles of one text; fewer words than k: the whole sequence as one."""
    if len(h) == 0:
        return h
    if len(h) < k:
        return mix((h * STEP[: len(h)]).sum(dtype=np.uint64, keepdims=True) + U64(len(h)))
    return np.unique(windows(h, k))


def per_text(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, pw: Powers, space: np.ndarray = IS_SPACE) -> Iterator[np.ndarray]:
    """Word hashes of each text in turn, a bounded run of texts at a time."""
    for i, j in chunks(offsets):
        h, text = word_hashes(data, offsets[i : j + 1], table, pw, space)
        edge = np.searchsorted(text, np.arange(j - i + 1))
        for k in range(j - i):
            yield h[edge[k] : edge[k + 1]]
