"""Ranked lexical search of stated queries over all documents: WAND in every shard, shard heaps merged."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noticeloom.llm.common import BYTE_LOWER, NOT_ALNUM, Powers, chunks, cut, release, utf8, word_hashes

TOP = 50
#: UTF-8 bytes of query texts handled in one pass over the documents; more queries take more passes.
BLOCK_BYTES = 32 << 20
#: Postings of a shard that are inverted at a time, and documents looked at from a pivot on.
POSTINGS, REACH = 2_000_000, 2048
#: Fixed values of the score.
K_TF, K_LENGTH, ONE, LOG = 1000, 20, 1_000_000_000, 1000
MERGERS = 32

FORWARD = "doc_id long, length long, terms binary, counts binary"
HIT = "query long, doc_id long, score long"
Batches = Iterator[pa.RecordBatch]


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every term of consecutive texts, as word_hashes takes them."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    inside = np.zeros(hi - lo + 2, bool)
    inside[1:-1] = ~NOT_ALNUM[data[lo:hi]]
    first = np.zeros(hi - lo + 2, bool)
    first[(offsets[:-1] - lo)[offsets[:-1] < offsets[1:]] + 1] = True
    begins = inside[1:-1] & (~inside[:-2] | first[1:-1])
    ends = inside[1:-1] & (~inside[2:] | first[2:])
    return np.flatnonzero(begins) + lo, np.flatnonzero(ends) + lo + 1


class Vocabulary:
    """Terms of a block of queries by hash, with their bytes: a word is a term only if its bytes are the same."""

    def __init__(self, texts: list[str | None]) -> None:
        data, offsets = utf8(pa.array(texts, pa.string()))
        h, text = word_hashes(data, offsets, BYTE_LOWER, Powers(), NOT_ALNUM)
        s, e = spans(data, offsets)
        self.hashes, at, term = np.unique(h, return_index=True, return_inverse=True)
        self.sizes = (e - s)[at]
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])[:-1]
        self.bytes = lowered(data[run(s[at], self.sizes)]) if len(at) else np.zeros(0, np.uint8)
        edge = np.searchsorted(text, np.arange(len(texts) + 1))
        #: The distinct terms of each query.
        self.queries = [np.unique(term[edge[k] : edge[k + 1]]).astype(np.int32) for k in range(len(texts))]

    def find(self, data: np.ndarray, s: np.ndarray, e: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions among the words, terms) of the words that are terms of the queries."""
        if not len(self.hashes) or not len(h):
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = np.flatnonzero((self.hashes[at] == h) & (self.sizes[at] == e - s))
        if not len(hit):
            return hit, np.zeros(0, np.int32)
        term, size = at[hit], (e - s)[hit]
        same = lowered(data[run(s[hit], size)]) == self.bytes[run(self.starts[term], size)]
        whole = np.logical_and.reduceat(same, np.concatenate([[0], np.cumsum(size)[:-1]]))
        return hit[whole], term[whole].astype(np.int32)


def run(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All positions of the runs [start, start + size), one after another."""
    out = np.ones(int(sizes.sum()), np.int64)
    edge = np.cumsum(sizes)[:-1]
    out[:1] = starts[:1]
    out[edge] = starts[1:] - starts[:-1] - sizes[:-1] + 1
    return np.cumsum(out)


def lowered(b: np.ndarray) -> np.ndarray:
    return np.where((b >= 65) & (b <= 90), b + np.uint8(32), b).astype(np.uint8)


def forward(vocabulary) -> Callable[[Batches], Batches]:
    """A function of Arrow batches (doc_id, text): each document's length in terms, and of the queries' terms those that it holds with their counts."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pw = vocabulary.value, Powers()
        try:
            for batch in batches:
                ids, (data, offsets) = batch.column(0), utf8(batch.column(1))
                for i, j in chunks(offsets):
                    part = offsets[i : j + 1]
                    h, text = word_hashes(data, part, BYTE_LOWER, pw, NOT_ALNUM)
                    length = np.bincount(text, minlength=j - i)
                    s, e = spans(data, part) if len(h) else (text, text)
                    at, term = words.find(data, s, e, h)
                    pair, count = np.unique(text[at] * (len(words.hashes) + 1) + term, return_counts=True)
                    doc, term = np.divmod(pair, len(words.hashes) + 1)
                    edge = np.searchsorted(doc, np.arange(j - i + 1))
                    cut_up = lambda x: [x[edge[k] : edge[k + 1]].astype(np.int32).tobytes() for k in range(j - i)]  # noqa: E731, B023
                    yield pa.RecordBatch.from_arrays(
                        [ids.slice(i, j - i).cast(pa.int64()), pa.array(length, pa.int64()), pa.array(cut_up(term), pa.binary()), pa.array(cut_up(count), pa.binary())],
                        ["doc_id", "length", "terms", "counts"],
                    )
        finally:
            release()

    return index


class Heap:
    """The best hits of one query so far: higher scores first, equal scores by smaller doc_id, null last."""

    def __init__(self, top: int) -> None:
        self.top = top
        self.score = self.doc = np.zeros(0, np.int64)
        self.null = np.zeros(0, bool)

    @property
    def threshold(self) -> int:
        """The least score that may still enter."""
        return int(self.score[-1]) if len(self.score) == self.top else 1

    def add(self, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        score, doc, null = (np.concatenate(x) for x in ((self.score, score), (self.doc, doc), (self.null, null)))
        best = np.lexsort((doc, null, -score))[: self.top]
        self.score, self.doc, self.null = score[best], doc[best], null[best]


class Inverted:
    """Postings of a run of a shard's documents: by term the documents in order, their impact and its maximum."""

    def __init__(self, docs: np.ndarray, terms: np.ndarray, impacts: np.ndarray, n_terms: int) -> None:
        order = np.argsort(terms, kind="stable")
        self.docs, self.impacts = docs[order], impacts[order]
        self.edge = np.searchsorted(terms[order], np.arange(n_terms + 1))
        self.most = np.zeros(n_terms, np.int64)
        held = np.flatnonzero(np.diff(self.edge))
        if len(held):
            self.most[held] = np.maximum.reduceat(self.impacts, self.edge[held])


def wand(inverted: Inverted, n_docs: int, terms: np.ndarray, weights: np.ndarray, heap: Heap, ids: np.ndarray, nulls: np.ndarray) -> int:
    """Bring the best documents for one query into its heap; returns how many were scored.

    Cursors stand on each term's next document. In their order the maximal impacts are summed until the
    heap's threshold can be reached: that cursor's document is the pivot, and all before it are passed
    over. From the pivot on a short reach of documents is looked at together: those whose terms'
    maxima together stay below the threshold are passed over too, the others are scored.
    """
    lo, hi = inverted.edge[terms], inverted.edge[terms + 1]
    some = (hi > lo) & (weights > 0)
    lo, hi, terms, weights = lo[some], hi[some], terms[some], weights[some]
    bound, at, scored = inverted.most[terms] * weights, lo.copy(), 0
    docs, impacts = inverted.docs, inverted.impacts
    while len(at):
        here = docs[at]
        order = np.argsort(here, kind="stable")
        reach = np.flatnonzero(np.cumsum(bound[order]) >= heap.threshold)
        if not len(reach):
            break
        pivot = int(here[order[reach[0]]])
        stop = min(pivot + REACH, n_docs)
        parts = []
        for k in range(len(at)):
            a = at[k] if here[k] >= pivot else at[k] + np.searchsorted(docs[at[k] : hi[k]], pivot)
            at[k] = a + np.searchsorted(docs[a : hi[k]], stop)
            parts.append((a, at[k]))
        size = np.array([b - a for a, b in parts])
        if size.any():
            rows = run(np.array([a for a, _ in parts])[size > 0], size[size > 0])
            which = np.repeat(np.arange(len(at)), size)
            near = docs[rows] - pivot
            most = np.zeros(stop - pivot, np.int64)
            np.add.at(most, near, bound[which])
            may = most >= heap.threshold
            if may.any():
                keep = may[near]
                total = np.zeros(stop - pivot, np.int64)
                np.add.at(total, near[keep], impacts[rows[keep]] * weights[which[keep]])
                scored += int(may.sum())
                good = np.flatnonzero(may & (total >= heap.threshold))
                if len(good):
                    heap.add(total[good], ids[pivot + good], nulls[pivot + good])
        left = at < hi
        if not left.all():
            at, hi, bound, weights = at[left], hi[left], bound[left], weights[left]
    return scored


def shard(queries, n_docs: int, n_terms: int, top: int) -> Callable[[Batches], Batches]:
    """A function of Arrow batches of the forward index: the best hits of every query in this shard.

    `queries` is the broadcast (terms and weights by query, number of terms). A shard is inverted
    POSTINGS at a time; the heaps, `top` hits a query, carry on, so later runs skip more.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, vocabulary = queries.value
        heaps = [Heap(top) for _ in asked]
        ids, lengths, terms, counts, held = [], [], [], [], 0

        def flush() -> None:
            (term, offsets), (count, _) = utf8(pa.concat_arrays(terms)), utf8(pa.concat_arrays(counts))
            term, count = (np.frombuffer(x[offsets[0] : offsets[-1]].tobytes(), np.int32) for x in (term, count))
            doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets) // 4)
            m = 50 + np.concatenate(lengths) * (50 * n_docs) // max(n_terms, 1)
            impact = ONE * count.astype(np.int64) // (K_TF * count.astype(np.int64) + K_LENGTH * m[doc])
            nulls = np.concatenate([x.is_null().to_numpy(zero_copy_only=False) for x in ids])
            known = np.concatenate([x.fill_null(0).to_numpy() for x in ids])
            inverted = Inverted(doc, term, impact, vocabulary)
            for (at, weights), heap in zip(asked, heaps, strict=True):
                wand(inverted, len(known), at, weights, heap, known, nulls)

        try:
            for batch in batches:
                ids.append(batch.column(0))
                lengths.append(batch.column(1).to_numpy())
                terms.append(batch.column(2))
                counts.append(batch.column(3))
                held += sum(len(x) for x in batch.column(2).buffers()[2:] if x) // 4
                if held >= POSTINGS:
                    flush()
                    ids, lengths, terms, counts, held = [], [], [], [], 0
            if ids:
                flush()
            for q, heap in enumerate(heaps):
                if len(heap.score):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(heap.score), q), pa.int64()), pa.array(heap.doc, pa.int64(), mask=heap.null), pa.array(heap.score, pa.int64())], ["query", "doc_id", "score"])
        finally:
            release()

    return search


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.floor(LOG * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)


def block(docs: DataFrame, rows: list, top: int) -> DataFrame:
    """Hits of one block of queries (item_id, text): item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    vocabulary = Vocabulary([r.text for r in rows])
    known = spark.sparkContext.broadcast(vocabulary)
    index = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(forward(known), FORWARD).where("length > 0"))
    n_docs, n_terms = index.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    frequency = np.zeros(len(vocabulary.hashes), np.int64)
    for r in index.mapInArrow(held_by(len(frequency)), "term int, docs long").groupBy("term").agg(F.sum("docs").alias("docs")).collect():  # a row a term of the queries
        frequency[r.term] = r.docs
    weight = weights(n_docs, frequency)
    asked = spark.sparkContext.broadcast(([(t, weight[t]) for t in vocabulary.queries], len(frequency)))
    hits = index.mapInArrow(shard(asked, n_docs, n_terms, top), HIT)
    # heaps of some shards first, so that a query's last merge reads at most MERGERS heaps
    best = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    part = hits.withColumn("part", F.spark_partition_id() % MERGERS)
    part = part.withColumn("rank", F.row_number().over(Window.partitionBy("query", "part").orderBy(*best))).where(F.col("rank") <= top)
    whole = part.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*best))).where(F.col("rank") <= top)
    names = spark.createDataFrame([(k, r.item_id) for k, r in enumerate(rows)], "query long, item_id long")
    return whole.join(names, "query").select("item_id", "rank", "doc_id", "score")


def held_by(n_terms: int) -> Callable[[Batches], Batches]:
    """A function of Arrow batches of the forward index: in how many of a task's documents each term is."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(x.as_py() for x in batch.column(2)), np.int32), minlength=n_terms)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["term", "docs"])

    return count


def search(docs: DataFrame, queries: DataFrame, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The `top` best documents (doc_id, text) for each query (item_id, text): item_id, rank, doc_id, score.

    A term is a run of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased. A
    document's score sums over the query's distinct terms weight times impact, in whole numbers; only
    scores above 0 are hits, equal scores go by doc_id.

    Queries go in blocks of at most `block_bytes` of text (a larger single query is a block of its own): a
    block's terms are broadcast, each document is cut into terms once and keeps those of the block, and
    each task of that index is a shard with one heap a query. Every term is compared by its bytes. Shards
    hand on `top` hits a query at most, and these are merged in two steps.

    Documents without a term (null, empty, signs only) count nowhere; repeated documents are documents of
    their own; a null doc_id comes last among equal scores. Each query row is ranked for itself, also if
    its id is null or repeated; one without a term has no hits. Other columns are not read; an empty table
    on either side gives no rows.
    """
    spark = docs.sparkSession
    wanted = queries.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    sized = wanted.withColumn("bytes", F.octet_length("text"))
    total = sized.agg(F.sum("bytes")).first()[0] or 0
    parts = max(1, -(-2 * total // block_bytes))
    out = None
    for k in range(parts):  # by hash, in expectation half a block each
        rows = sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).select("item_id", "text").collect()
        if rows:
            found = block(docs, rows, top)
            out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents
), n AS (
  SELECT r, doc_id, len(ts)::BIGINT AS n, ts FROM d WHERE len(ts) > 0
), total AS (
  SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM n
), q AS (
  SELECT DISTINCT i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS i, item_id, text FROM benchmark)
), tf AS (
  SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(ts) AS term FROM n) WHERE term IN (SELECT term FROM q) GROUP BY ALL
), w AS (
  SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term, docs
), impact AS (
  SELECT tf.r, n.doc_id, tf.term, w.w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))) AS part
  FROM tf JOIN n USING (r) JOIN w USING (term), total
), scored AS (
  SELECT i, item_id, r, doc_id, sum(part)::BIGINT AS score FROM q JOIN impact USING (term) GROUP BY ALL
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""
