"""MinHash near-duplicate groups with sequential Bayesian verification."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeloom.llm.common import BYTE_LOWER, U64, Powers, components, cut, mix, per_text, release, shingle_set, utf8

BANDS, ROWS = 26, 5
HASHES = BANDS * ROWS
BATCH = 10
MISS = 1e-6
BLOCK = 1024
BLOCK_BYTES = 16 << 20
_rng = np.random.default_rng(97)
MULT = _rng.integers(1, 2**63, HASHES, dtype=np.uint64) * U64(2) + U64(1)


def signature(x: np.ndarray) -> np.ndarray:
    """The minima of HASHES multiplicative hashes over a set of 64-bit shingles, as 32 bits each."""
    low = np.full(HASHES, 2**64 - 1, np.uint64)
    for at in range(0, len(x), 2048):
        np.minimum(low, (x[None, at : at + 2048] * MULT[:, None]).min(axis=1), out=low)
    return (low >> U64(32)).astype(np.uint32)


@lru_cache(maxsize=8)
def least_matches(threshold: float, miss: float) -> tuple[int, ...]:
    """For n = BATCH, 2 BATCH, ... hashes: the fewest matches m whose posterior probability of a
    similarity at or over the threshold is still `miss` at least, under a uniform prior, where the
    similarity given m of n matches is Beta(m + 1, n - m + 1)."""
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        def tail(m: int) -> float:  # P(Beta(m+1, n-m+1) >= t) = P(Binomial(n+1, t) <= m)
            return math.fsum(math.comb(n + 1, j) * threshold**j * (1 - threshold) ** (n + 1 - j) for j in range(m + 1))
        out.append(next(m for m in range(n + 1) if tail(m) >= miss))
    return tuple(out)


def plausible(a: np.ndarray, b: np.ndarray, least: tuple[int, ...]) -> np.ndarray:
    """Indices of the signature pairs (rows of a, b) that no batch of hashes rules out."""
    alive = np.arange(len(a))
    same = np.zeros(len(a), np.int32)
    for k, need in enumerate(least):
        if not len(alive):
            break
        part = slice(k * BATCH, (k + 1) * BATCH)
        same[alive] += (a[alive, part] == b[alive, part]).sum(1, dtype=np.int32)
        alive = alive[same[alive] >= need]
    return alive


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n_shingles, f1, f2, sig) per row; f1, f2 fingerprint the whole shingle set."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        pw = Powers()
        for b in batches:
            n, f1, f2, sig = [], [], [], []
            for h in per_text(*utf8(b.column(1)), BYTE_LOWER, pw):
                x = shingle_set(h, words)
                n.append(len(x))
                f1.append(x.sum(dtype=np.uint64))
                f2.append(mix(x + U64(0x632BE59BD9B4E019)).sum(dtype=np.uint64))
                sig.append(signature(x).tobytes() if len(x) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), *(pa.array(np.array(f, np.uint64).view(np.int64)) for f in (f1, f2)), pa.array(sig, pa.binary())],
                ["doc_id", "n_shingles", "f1", "f2", "sig"],
            )
        release()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, f1 long, f2 long, sig binary")


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """(id, hashes): the sorted shingle set of each document as packed 64-bit integers."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        pw = Powers()
        for b in batches:
            data, offsets = utf8(b.column(1))
            for at in range(0, b.num_rows, 64):
                own = offsets[at : at + 65]
                packed = [shingle_set(h, words).tobytes() for h in per_text(data, own, BYTE_LOWER, pw)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, 64), pa.array(packed, pa.binary())], ["id", "hashes"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "id long, hashes binary")


def confirm(pairs: DataFrame, classes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Of the class pairs (a, b), those whose whole shingle sets are similar enough.

    Signatures go first, batch by batch; only pairs left plausible fetch their texts, and their sets
    are intersected exactly. Texts of documents in no such pair are not read again beyond the scan
    side of one join.
    """
    least = least_matches(percent / 100, MISS)

    def prune(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                a, c = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint32).reshape(-1, HASHES) for i in (2, 3))
                yield b.take(pa.array(plausible(a, c, least))).select(["a", "b"])

    def exact(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            keep = []
            for i in range(b.num_rows):
                x, y = (np.frombuffer(b.column(c)[i].as_buffer(), np.int64) for c in (2, 3))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield b.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    sides = [classes.select(F.col("cls").alias(s), F.col("n_shingles").alias(f"n_{s}"), F.col("sig").alias(f"sig_{s}")) for s in "ab"]
    near = pairs.join(sides[0], "a").join(sides[1], "b")
    near = near.where((F.least("n_a", "n_b") * 100) >= (F.greatest("n_a", "n_b") * percent))
    left = cut(near.select("a", "b", "sig_a", "sig_b").mapInArrow(prune, "a long, b long"))
    need = left.select(F.col("a").alias("doc_id")).union(left.select("b")).distinct()
    sets = cut(shingle_sets(docs.select("doc_id", "text").join(need, "doc_id", "left_semi"), words))
    full = left.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("y")), "b")
    return full.select("a", "b", "x", "y").mapInArrow(exact, "a long, b long")


def bucket_rest(members: DataFrame, classes: DataFrame, found: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) that join different components within a bucket; as many as members at most.

    Only buckets with several components are looked at. A bucket of more than BLOCK members or
    BLOCK_BYTES of shingles is compared block against block, each pair of blocks in its own task.
    A task compares classes of different components only: signatures batch by batch, then the whole
    sets; a link unites the two components at once, so a large group settles after about one test a
    member and no pair leaves the task but the links that unite. A pair is left to the first band in
    which the two meet, and pairs with the bucket's lead were tested before.
    """
    least = least_matches(percent / 100, MISS)
    comp = members.join(found.select(F.col("id").alias("cls"), "component"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    mixed = comp.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("size")).where("n > 2 AND lo <> hi")
    mixed = mixed.select("bucket", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("size") * 8 / BLOCK_BYTES)).cast("int").alias("blocks"))
    rows = cut(comp.join(mixed, "bucket").select("bucket", "band", "lead", "cls", "component", "blocks"))
    need = rows.select(F.col("cls").alias("doc_id")).distinct()
    sets = shingle_sets(docs.select("doc_id", "text").join(need, "doc_id", "left_semi"), words)
    own = F.pmod(F.xxhash64("cls"), F.col("blocks").cast("long")).cast("int")
    full = rows.join(sets.withColumnRenamed("id", "cls"), "cls").join(classes.select("cls", "sig"), "cls")
    full = full.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    full = full.select("bucket", "band", "lead", "cls", "component", "sig", "hashes", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def compare(key, t):
        import pyarrow as pa

        _, i, j = (k.as_py() for k in key)
        cls, own = t.column("cls").to_numpy(), t.column("own").to_numpy()
        names, com = np.unique(t.column("component").to_numpy(), return_inverse=True)
        members_of = {c: np.flatnonzero(com == c).tolist() for c in range(len(names))}
        com = com.copy()
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint32).reshape(-1, HASHES)
        sets = [np.frombuffer(h, np.int64) for h in t.column("hashes").to_pylist()]
        size = np.array([len(x) for x in sets])
        band, lead = t.column("band")[0].as_py(), t.column("lead")[0].as_py()
        x = np.flatnonzero((own == i) & (cls != lead))
        y = np.flatnonzero((own == j) & (cls != lead))
        a, b = [], []
        for p in x.tolist():
            q = y[(com[y] != com[p]) & ((cls[y] > cls[p]) if i == j else True)]
            q = q[100 * np.minimum(size[q], size[p]) >= percent * np.maximum(size[q], size[p])]
            q = q[plausible(np.broadcast_to(sig[p], (len(q), HASHES)), sig[q], least)] if len(q) else q
            if len(q) and band:
                q = q[~(sig[q] == sig[p])[:, : band * ROWS].reshape(len(q), band, ROWS).all(2).any(1)]
            for r in q.tolist():
                if com[r] == com[p]:
                    continue
                both = len(np.intersect1d(sets[p], sets[r], assume_unique=True))
                if 100 * both >= percent * (size[p] + size[r] - both):
                    a.append(min(cls[p], cls[r]))
                    b.append(max(cls[p], cls[r]))
                    old, new = sorted((com[p], com[r]), key=lambda c: len(members_of[c]))
                    moved = members_of.pop(old)
                    com[moved] = new
                    members_of[new] += moved
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return full.groupBy("bucket", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs(doc_id, text).

    A-Z count as a-z; words are runs of bytes other than space and 0x09-0x0D; a document is the set
    of its distinct `words`-word shingles (fewer words: the whole sequence is one). Documents with
    100 * intersection >= percent * union link; a component is named by its smallest doc_id.

    Equal sets collapse to one class first, so thousands of copies cost one row. Signatures of 26
    bands of 5 rows give candidates (a pair at the threshold is missed with odds of 3e-5). In each
    bucket every class is first tested against the bucket's smallest class, which settles large
    groups with one test a member; pairs still in different components are then tested in blocks.

    Empty, blank and null texts have no shingles and link with nothing. Rows that share a doc_id
    are one document for linking. Rows with a null doc_id link with nothing and are kept.
    """
    base = cut(signatures(docs, words))
    some = base.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = cut(some.groupBy("n_shingles", "f1", "f2").agg(F.min("doc_id").alias("cls0"), F.max("sig").alias("sig")))
    # one doc_id may stand for several classes if rows repeat an id with other texts
    classes = cut(classes.groupBy(F.col("cls0").alias("cls"), "n_shingles", "f1", "f2", "sig").count().drop("count"))
    lead_of = some.select("doc_id", "n_shingles", "f1", "f2").join(classes.select("cls", "n_shingles", "f1", "f2"), ["n_shingles", "f1", "f2"]).select("doc_id", "cls")
    copies = lead_of.where("doc_id <> cls").select(F.col("doc_id").alias("a"), F.col("cls").alias("b"))

    width = 4 * ROWS
    key = lambda k: F.xxhash64(F.substring("sig", k * width + 1, width), F.lit(k))
    bands = classes.select("cls", "n_shingles", F.posexplode(F.array(*[key(k) for k in range(BANDS)])).alias("band", "bucket"))
    shared = bands.groupBy("bucket").agg(F.min("cls").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = cut(bands.join(shared.drop("n"), "bucket"))
    star = members.where("cls <> lead").select(F.col("lead").alias("a"), F.col("cls").alias("b")).distinct()
    links = cut(confirm(star, classes, docs, words, percent))
    found = components(links)
    rest = bucket_rest(members, classes, found, docs, words, percent)
    stars = found.select(F.col("id").alias("a"), F.col("component").alias("b"))
    found = components(stars.union(rest).union(copies))
    out = base.select("doc_id", "n_shingles").join(found, base.doc_id == found.id, "left")
    out = out.withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def first_of_groups(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each near-duplicate group, that of the smallest doc_id.

    Rows that repeat a doc_id with another text are documents of their own, known by a hash of both;
    of rows equal in both one stays. Rows without a doc_id all stay.
    """
    own = docs.where("doc_id IS NOT NULL").withColumn("_key", F.xxhash64("doc_id", "text"))
    groups = near_duplicates(own.select(F.col("_key").alias("doc_id"), "text"), words, percent)
    groups = groups.select(F.col("doc_id").alias("_key"), "component_id").distinct()
    named = groups.join(own.select("_key", "doc_id").distinct(), "_key")
    kept = named.groupBy("component_id").agg(F.min(F.struct("doc_id", "_key")).alias("first")).select("first._key")
    # rows equal in id and text: the first by a hash of all their columns, so that a task run again agrees
    rows = own.select("_key", F.struct(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("_h"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).alias("one"))
    whole = rows.join(kept, "_key", "left_semi").groupBy("_key").agg(F.min_by("one.row", "one._h").alias("row"))
    return whole.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns]).unionByName(docs.where("doc_id IS NULL"))
