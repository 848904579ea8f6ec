"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeloom.llm.common import BYTE_LOWER, NOT_ALNUM, U64, Powers, cut, mix, per_text, utf8, windows

SEED_WORDS = 5
THRESHOLD = 0.6
BLOOM_LEAST, BLOOM_MOST = 20, 28
SALT = U64(0xA24BAED4963EE407)


def bloom_bits(seeds: int) -> int:
    """log2 of the filter's size: 16 bits a seed, 128 KB at least and 32 MB at most."""
    return min(BLOOM_MOST, max(BLOOM_LEAST, (16 * seeds - 1).bit_length()))


def bloom_places(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    return (h >> U64(64 - width)).astype(np.int64), (mix(h + SALT) >> U64(64 - width)).astype(np.int64)


def in_bloom(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    a, b = bloom_places(h, (len(bits) * 8).bit_length() - 1)
    return ((bits[a >> 3] >> (a & 7).astype(np.uint8)) & (bits[b >> 3] >> (b & 7).astype(np.uint8)) & 1).astype(bool)


def tiles(doc: np.ndarray, item: np.ndarray, least: int = SEED_WORDS, first: int = 32) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two sequences of word hashes: (doc start, item start, length) of tiles.

    Running Karp-Rabin: windows of the search length that hold no marked word are matched by hash
    and extended word by word; matches are marked longest first (ties: earlier in the item, then in
    the document); a match of twice the search length restarts the scan with its length; the search
    length then halves down to `least`. Tiles never overlap in either sequence.
    """
    least = max(1, min(least, len(item)))
    free_d, free_i = np.ones(len(doc), bool), np.ones(len(item), bool)
    out: list[tuple[int, int, int]] = []
    s = max(least, min(first, len(item), len(doc)))
    while len(doc) >= least and len(item) >= least:
        found: list[tuple[int, int, int]] = []
        longest = 0
        if min(len(doc), len(item)) >= s:
            open_i = np.convolve(free_i, np.ones(s, int), "valid") == s
            open_d = np.cumsum(np.concatenate([[0], free_d]))
            open_d = open_d[s:] - open_d[:-s] == s
            wi, wd = windows(item, s), windows(doc, s)
            at: dict[int, list[int]] = {}
            for k in np.flatnonzero(open_i).tolist():
                at.setdefault(int(wi[k]), []).append(k)
            keys = np.array(list(at), np.uint64)
            for p in np.flatnonzero(open_d & np.isin(wd, keys)).tolist() if len(keys) else []:
                for t in at[int(wd[p])]:
                    if p and t and free_d[p - 1] and free_i[t - 1] and doc[p - 1] == item[t - 1]:
                        continue  # part of a longer match already found
                    n = s
                    while p + n < len(doc) and t + n < len(item) and free_d[p + n] and free_i[t + n] and doc[p + n] == item[t + n]:
                        n += 1
                    found.append((n, t, p))
                    longest = max(longest, n)
        if longest >= 2 * s:
            s = longest
            continue
        for n, t, p in sorted(found, key=lambda x: (-x[0], x[1], x[2])):
            ok = free_d[p : p + n] & free_i[t : t + n]
            if ok.all():
                free_d[p : p + n] = free_i[t : t + n] = False
                out.append((p, t, n))
        if found:
            continue  # a match cut by a longer tile may leave a part of this length
        if s == least:
            break
        s = max(least, s // 2)
    return out


def _words(column, pw: Powers) -> Iterator[np.ndarray]:
    return per_text(*utf8(column), BYTE_LOWER, pw, NOT_ALNUM)


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc, th, doc_id, item_id, item_words, covered, n_tiles, coverage) of every document and
    benchmark item where non-overlapping common runs of 5 words or more cover `threshold` of the item.

    Words are runs of letters and digits (non-ASCII bytes count as letters), A-Z as a-z. An item of
    fewer than 5 words needs them all in one run. Items with no word, null texts and empty texts
    match nothing. Reordered passages count, as tiles may lie in any order.

    A Bloom filter of the items' 5-word seeds (32 MB at most) travels to the documents; documents
    with a hit keep their word hashes, and seeds join items by shuffle (Spark broadcasts the seed
    table itself only under its own threshold). A tile of n words has n - 4 seeds, at least n / 5, so a
    pair at the threshold shares so many seeds at least. An item's commonest seeds, too few together
    for that, therefore join nothing: a seed that many items and documents share makes no pairs.
    Pairs with too few shared seeds are dropped before tiling.
    """

    def item_rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        pw = Powers()
        for b in batches:
            item, seed, size, words, n = [], [], [], [], []
            for k, w in enumerate(_words(b.column(1), pw)):
                if len(w):
                    size.append(min(SEED_WORDS, len(w)))
                    item.append(b.column(0)[k].as_py())
                    seed.append(windows(w, size[-1]).view(np.int64).tolist())
                    words.append(w.tobytes())
                    n.append(len(w))
            yield pa.RecordBatch.from_arrays(
                [pa.array(item, pa.int64()), pa.array(seed, pa.list_(pa.int64())), pa.array(size, pa.int32()), pa.array(words, pa.binary()), pa.array(n, pa.int32())],
                ["item_id", "seeds", "size", "item", "item_words"],
            )

    items = cut(benchmark.select(F.col("item_id").cast("long"), "text").mapInArrow(item_rows, "item_id long, seeds array<long>, size int, item binary, item_words int"))
    sizes = sorted(r[0] for r in items.select("size").distinct().collect())
    width = bloom_bits(items.agg(F.sum(F.size("seeds"))).first()[0] or 1)

    def bloom(batches: Iterator) -> Iterator:
        import pyarrow as pa

        bits = np.zeros(1 << (width - 3), np.uint8)
        for b in batches:
            h = b.column(0).flatten().to_numpy().view(np.uint64)
            for a in bloom_places(h, width):
                np.bitwise_or.at(bits, a >> 3, np.left_shift(1, a & 7).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], pa.binary())], ["bits"])

    bits = np.zeros(1 << (width - 3), np.uint8)
    for r in items.select("seeds").coalesce(4).mapInArrow(bloom, "bits binary").collect():
        bits |= np.frombuffer(r.bits, np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def hits(batches: Iterator) -> Iterator:
        import pyarrow as pa

        pw = Powers()
        for b in batches:
            at, seeds, words = [], [], []
            for k, w in enumerate(_words(b.column(3), pw)):
                own = np.unique(np.concatenate([x[in_bloom(x, shared.value)] for x in (windows(w, n) for n in sizes)]))
                if len(own):
                    at.append(k)
                    seeds.append(own.view(np.int64))
                    words.append(w.tobytes())
            if at:
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([*(b.column(i).take(take) for i in range(3)), pa.array(seeds, pa.list_(pa.int64())), pa.array(words, pa.binary())], ["doc", "th", "doc_id", "seeds", "words"])

    def tile(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            at, covered, count = [], [], []
            for k in range(b.num_rows):
                d, t = (np.frombuffer(b.column(c)[k].as_buffer(), np.uint64) for c in (4, 5))
                size = min(SEED_WORDS, len(t))
                shared_seeds = np.isin(windows(t, size), windows(d, size)).sum()
                got = tiles(d, t) if shared_seeds * size >= threshold * len(t) else []
                n = sum(x[2] for x in got)
                if n >= threshold * len(t):
                    at.append(k)
                    covered.append(n)
                    count.append(len(got))
            take = pa.array(at, pa.int64())
            n = b.column(6).take(take).to_numpy()
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i).take(take) for i in range(4)), b.column(6).take(take), pa.array(covered, pa.int32()), pa.array(count, pa.int32()), pa.array(np.array(covered) / np.maximum(n, 1), pa.float64())],
                ["doc", "th", "doc_id", "item_id", "item_words", "covered", "n_tiles", "coverage"],
            )

    keyed = docs.select(*identity(), F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc long, th long, doc_id long, seeds array<long>, words binary"
    near = cut(keyed.mapInArrow(hits, schema)) if sizes else docs.sparkSession.createDataFrame([], schema)
    found = near.select("doc", "th", F.explode("seeds").alias("seed")).distinct()
    used = found.groupBy("seed").agg(F.count(F.lit(1)).alias("used"))
    seeds = items.select("item_id", "size", "item_words", F.explode("seeds").alias("seed")).groupBy("item_id", "size", "item_words", "seed").agg(F.count(F.lit(1)).alias("times"))
    commonest = Window.partitionBy("item_id", "item_words").orderBy(F.col("used").desc(), "seed")
    seeds = seeds.join(used, "seed").withColumn("n", F.sum("times").over(commonest))
    seeds = seeds.where(F.col("n") * F.col("size") >= F.col("item_words") * F.lit(threshold)).select("item_id", "seed")
    pairs = found.join(seeds, "seed").select("doc", "th", "item_id").distinct()
    full = pairs.join(near.select("doc", "th", "doc_id", "words").dropDuplicates(["doc", "th"]), ["doc", "th"]).join(items.select("item_id", "item", "item_words"), "item_id")
    out = "doc long, th long, doc_id long, item_id long, item_words int, covered int, n_tiles int, coverage double"
    return full.select("doc", "th", "doc_id", "item_id", "words", "item", "item_words").mapInArrow(tile, out)


def identity() -> list[Column]:
    """doc and th, which together tell rows with different ids or texts apart."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th")]


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the documents that hold a benchmark item; columns unchanged."""
    bad = contaminated(docs, benchmark, threshold).select("doc", "th").distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *identity())
    return rows.join(bad, ["doc", "th"], "left_anti").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
