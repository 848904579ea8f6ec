"""Language identification by blended-spectrum string kernels."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noticeloom.llm.common import release

BITS = 15
DIM = 1 << BITS
ORDERS = (1, 2, 3)
FOLD = 3
MULT = np.array([2654435761, 2246822519, 3266489917], np.uint32)
LETTER = r"\p{L}"


def gram_codes(text: str) -> np.ndarray:
    """Hashed codes of all 1- to 3-grams of code points of the case-folded text, white space and
    digits each folded to one symbol."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(c <= 32, np.uint32(32), c)
    c = np.where((c >= 48) & (c <= 57), np.uint32(48), c)
    out, h = [], np.zeros(len(c), np.uint32)
    for n in ORDERS:
        if len(c) < n:
            break
        h = h[: len(c) - n + 1] * np.uint32(16777619) + c[n - 1 :] * MULT[n - 1]
        x = h ^ (h >> np.uint32(15))
        x = (x + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(2246822519)
        out.append(x >> np.uint32(32 - BITS))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def presence(texts: list[str | None]) -> np.ndarray:
    """0/1 matrix: which hashed n-grams each text has."""
    m = np.zeros((len(texts), DIM), np.float32)
    for i, t in enumerate(texts):
        if t:
            for at in range(0, len(t), 1 << 18):  # long texts by overlapping pieces: presence unites
                m[i, gram_codes(t[at : at + (1 << 18) + ORDERS[-1] - 1])] = 1
    return m


@dataclass
class Model:
    """labels[c], landmarks' presence (m x DIM, unit rows) folded with the ridge weights: DIM x C."""

    labels: list
    weights: np.ndarray
    bias: np.ndarray

    def scores(self, p: np.ndarray) -> np.ndarray:
        """One-versus-rest decision values. The kernel k(x, l) = <x, l> / (|x| |l|) of all texts with
        all landmarks times the ridge coefficients is one matrix product, associated so that the
        landmark-by-coefficient product is made once, at fitting."""
        norm = np.sqrt(np.maximum(p.sum(1, keepdims=True), 1))
        return (p @ self.weights) / norm + self.bias


def unit_rows(packed: np.ndarray) -> np.ndarray:
    p = np.unpackbits(packed, axis=1).astype(np.float32)
    return p / np.sqrt(np.maximum(p.sum(1, keepdims=True), 1))


def fit_packed(packed: np.ndarray, labels: np.ndarray, landmarks: int = 160, ridge: float = 1e-2, seed: int = 5) -> Model:
    """Nystroem features from landmarks spread over the labels, then ridge regression per label.

    packed: presence bits of the sample, a row each. Only the landmarks (21 MB) and 64 rows at a time
    are ever unpacked.
    """
    names = sorted(set(labels.tolist()))
    rng = np.random.default_rng(seed)
    share = max(1, landmarks // max(1, len(names)))
    chosen = np.concatenate([rng.permutation(np.flatnonzero(labels == c))[:share] for c in names])
    marks = unit_rows(packed[chosen])
    kernel = np.concatenate([unit_rows(packed[i : i + 64]) @ marks.T for i in range(0, len(packed), 64)])
    val, vec = np.linalg.eigh(kernel[chosen].astype(np.float64))
    keep = val > 1e-6 * max(val.max(), 1e-12)
    whiten = vec[:, keep] / np.sqrt(val[keep])
    z = kernel.astype(np.float64) @ whiten
    y = np.where(labels[:, None] == np.array(names, object)[None, :], 1.0, -1.0)
    # every label weighs the same, however rare it is
    w = (1 / np.array([max(1, (labels == c).sum()) for c in labels]))[:, None]
    w /= w.sum()
    mz, my = (w * z).sum(0), (w * y).sum(0)
    a = (z - mz).T @ (w * (z - mz)) + ridge * np.eye(z.shape[1]) / max(1, z.shape[1])
    beta = np.linalg.solve(a, (z - mz).T @ (w * (y - my)))
    return Model(names, marks.T @ (whiten @ beta).astype(np.float32), (my - mz @ beta).astype(np.float32))


def fit(docs: DataFrame, sample: int = 1600, most: int | None = None) -> Model | None:
    """Fit on at most `sample` rows of docs(doc_id, text, lang) outside the held-out fold.

    Each of the labels gets an equal part of the sample, one row at least: its rows with the smallest
    md5(doc_id), or of the text where the id is null. With `most`, only so many labels are learned, the
    commonest first, then by name. Executors send packed presence bits (4 KB a row, whatever the length
    of the text). None without labelled rows.
    """
    rows = (
        docs.where(F.col("lang").isNotNull() & F.col("text").rlike(LETTER))
        .where(F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLD, F.lit(0)) != 1)
        .select("text", "lang", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("text"))).alias("h"))
    )
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "lang")
    known = (counts.limit(most) if most else counts).collect()
    if not known:
        return None
    part = max(1, sample // len(known))
    # a range of hashes that holds about twice a label's part, so that few rows are looked at twice
    reach = F.create_map(*[F.lit(x) for r in known for x in (r.lang, min(2.0**32, 2.0 * (part + 32) / r.n * 2**32))])
    picked = rows.where(F.conv(F.substring("h", 1, 8), 16, 10).cast("double") < F.try_element_at(reach, F.col("lang")))

    def bits(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                packed = np.packbits(presence(part.column(0).to_pylist()).astype(bool), axis=1)
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array([r.tobytes() for r in packed], pa.binary())], ["lang", "h", "bits"])

    first = Window.partitionBy("lang").orderBy("h", "bits")
    got = picked.mapInArrow(bits, "lang string, h string, bits binary").withColumn("k", F.row_number().over(first)).where(F.col("k") <= part).orderBy("h", "lang", "bits").collect()
    if not got:
        return None
    return fit_packed(np.array([np.frombuffer(r.bits, np.uint8) for r in got]), np.array([r.lang for r in got], object))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """Add lang_pred and score to docs (which has `text`); every whole text is read.

    `und` with score 0.0 for a null text, a text without a letter, or no model. Ties go to the label
    that sorts first. Score: the winner's softmax share of the decision values.
    """
    names = [f.name for f in docs.schema.fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name not in ("text", "lang_pred", "score"))
    rest = [n for n in names if n not in ("text", "lang_pred", "score")]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                text = part.column(len(rest))
                lettered = pc.fill_null(pc.match_substring_regex(text, LETTER), False).to_pylist()
                lang, score = ["und"] * part.num_rows, [0.0] * part.num_rows
                on = [i for i, x in enumerate(lettered) if x] if model else []
                if on:
                    s = model.scores(presence(text.take(pa.array(on)).to_pylist())).astype(np.float64)
                    best = s.argmax(1)
                    e = np.exp(4 * (s - s.max(1, keepdims=True)))
                    e = e.max(1) / e.sum(1)
                    for j, i in enumerate(on):
                        lang[i], score[i] = model.labels[best[j]], float(e[j])
                yield pa.RecordBatch.from_arrays([*part.columns[: len(rest)], pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*rest, "lang_pred", "score"])
        release()

    return docs.select(*[F.col(f"`{n}`") for n in rest], "text").mapInArrow(run, f"{schema}, lang_pred string, score double" if rest else "lang_pred string, score double")


def identify(docs: DataFrame, sample: int = 1600) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of documents."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLD == 1, F.lit(False))
    model = fit(docs, sample)
    return predict(docs.select("doc_id", held.alias("held_out"), "text"), model)


def recognised(docs: DataFrame, sample: int = 1600) -> DataFrame:
    """docs without the documents that have no recognisable language (null text, no letter).

    Without a labelled row to learn from, all documents with a letter are kept.
    """
    model = fit(docs, sample)
    if model is None:
        return docs.where(F.col("text").rlike(LETTER))
    rows = predict(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text"), model)
    return rows.where(F.col("lang_pred") != "und").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
