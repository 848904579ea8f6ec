"""Text quality by nearest-neighbour voting among labelled latent-semantic vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeloom.llm.common import CHUNK_BYTES, utf8

HALF = 2048
STEPS = 24
DIM = 2 * HALF + STEPS
RANK = 48
NEIGHBOURS = 25
SHARPNESS = 4
THRESHOLD = 0.3
FOLD = 5

LOWER = np.arange(256, dtype=np.uint32)
LOWER[65:91] += 32
SHAPE = LOWER.copy()  # letters by case, digits and white space to one code each; punctuation as it is
SHAPE[97:123] = 1
SHAPE[128:] = 1
SHAPE[65:91] = 2
SHAPE[48:58] = 3
SHAPE[:33] = 4


def term_counts(d: np.ndarray) -> np.ndarray:
    """Counts of hashed byte 3-grams of one text: of its shape, then of its lower-cased letters; and
    one heavy term for the step of its compression ratio, which tells repetitive text apart."""
    import pyarrow as pa

    out = np.zeros(DIM, np.int64)
    if len(d) >= 64:
        ratio = len(pa.compress(d.tobytes(), "zstd", asbytes=True)) / len(d)
        out[2 * HALF + min(STEPS - 1, int(ratio * STEPS))] = 1000
    for at in range(0, max(1, len(d) - 2), CHUNK_BYTES):
        part = d[at : at + CHUNK_BYTES + 2]
        if len(part) < 3:
            continue
        for table, base in ((SHAPE, 0), (LOWER, HALF)):
            c = table[part]
            code = (c[:-2] * np.uint32(0x9E3779B1) + c[1:-1] * np.uint32(0x85EBCA77) + c[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(21)
            out[base : base + HALF] += np.bincount(code, minlength=HALF)
    return out


@dataclass
class Model:
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def embed(self, counts: np.ndarray) -> np.ndarray:
        x = unit(np.log1p(counts).astype(np.float32) * self.idf)
        return unit(x @ self.axes)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Similarity-weighted share of label 1 among the NEIGHBOURS nearest labelled vectors, by
        the exact cosine with every one of them; the prior where no neighbour is similar."""
        cos = self.embed(counts) @ self.vectors.T
        k = min(NEIGHBOURS, cos.shape[1])
        near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
        w = np.maximum(np.take_along_axis(cos, near, 1), 0).astype(np.float64) ** SHARPNESS
        total = w.sum(1)
        share = (w * self.labels[near]).sum(1) / np.where(total > 0, total, 1)
        return np.clip(np.where(total > 0, share, self.prior), 0, 1)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def fit_matrix(counts: np.ndarray, labels: np.ndarray) -> Model:
    """Latent-semantic axes (truncated SVD of the tf-idf rows) and the rows' places on them."""
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))) + 0.2
    x = unit(np.log1p(counts).astype(np.float32) * idf.astype(np.float32))
    gram = (x @ x.T).astype(np.float64)
    val, vec = np.linalg.eigh(gram)
    top = np.argsort(-val)[:RANK]
    top = top[val[top] > 1e-9 * max(val.max(), 1e-12)]
    axes = (x.T @ (vec[:, top] / np.sqrt(val[top]))).astype(np.float32)
    return Model(idf.astype(np.float32), axes, unit(x @ axes), labels.astype(np.float64), float(labels.mean()))


def fold(column: str) -> Column:
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % FOLD, F.lit(0))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 1500) -> Model | None:
    """Fit on at most `sample` labelled documents outside the held-out fold: those of smallest
    md5(doc_id), at most that many rows in all. Their bounded term counts (8 KB a row), not their
    texts, come to the driver, and the 48 numbers of each go back to the executors."""
    marked = labels.where(F.col("quality").isin(0, 1) & (fold("doc_id") != 0)).select("doc_id", F.col("quality").cast("int").alias("quality"), F.md5(F.col("doc_id").cast("string")).alias("h"))
    marked = marked.where("h IS NOT NULL").orderBy("h", "quality").limit(sample)
    rows = docs.select("doc_id", "text").where("text <> ''").join(marked, "doc_id").select("h", "quality", "text")

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            data, offsets = utf8(b.column(2))
            terms = [np.minimum(term_counts(data[i:j]), 65535).astype(np.uint16).tobytes() for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(terms, pa.binary())], ["h", "quality", "terms"])

    got = rows.mapInArrow(count, "h string, quality int, terms binary").orderBy("h", "quality", "terms").limit(sample).collect()
    if not got:
        return None
    return fit_matrix(np.array([np.frombuffer(r.terms, np.uint16) for r in got], np.float32), np.array([r.quality for r in got]))


def score(docs: DataFrame, labels: DataFrame, sample: int = 1500) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of documents, from its whole text alone.

    Empty and null texts, and all texts where nothing is labelled, score the prior (share of label 1
    in the sample; 0.5 without one).
    """
    model = fit(docs, labels, sample)
    prior = model.prior if model else 0.5

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            data, offsets = utf8(b.column(2))
            out = np.full(b.num_rows, prior)
            for at in range(0, b.num_rows if model else 0, 256):
                own = offsets[at : at + 257]
                on = np.flatnonzero(own[1:] > own[:-1])
                if len(on):
                    out[at + on] = model.score(np.array([term_counts(data[own[k] : own[k + 1]]) for k in on], np.float32))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out)], ["doc_id", "held_out", "score"])

    keyed = docs.select(F.col("doc_id").cast("long"), (fold("doc_id") == 0).alias("held_out"), "text")
    # a null id is in no fold
    keyed = keyed.withColumn("held_out", F.col("held_out") & F.col("doc_id").isNotNull())
    scored = keyed.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
