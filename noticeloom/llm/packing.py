"""Packing documents into fixed-length sequences by cutting-stock column generation."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noticeloom.llm.common import cut, ranked, release

CAPACITY = 4096
END = 2
UNIT = 16
#: Lengths up to 64 are classes of their own, up to 128 they go by 2, up to 256 by 4, beyond by 16; pieces
#: of classes up to EXACT go into patterns by bundles of one class.
FINE, EXACT = 64, 256
BUNDLES = (1, 2, 4, 8, 16)
TOKENIZER = "word_bpe_49k.json"
CACHE = 400_000
SHORT = 48
NEAR = 5e-4


class Encoder:
    """Ids of whole texts as little-endian uint32 bytes, by a public tokenizer.

    The tokenizer lower-cases and cuts at white space, and between letters and punctuation, before
    anything else. So a text's ids are those of its blank-separated chunks in turn, and a chunk of
    letters with full stops or commas behind has the letters' ids, then the mark's. Each different
    short chunk is looked up once and kept, in bounded number, for the life of the worker process.
    Words go to the tokenizer many at a time; their ids are told apart by the end-of-word tokens.
    """

    def __init__(self, path: str) -> None:
        import os
        import sys
        from types import ModuleType

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        kept = sys.modules.setdefault("_noticeloom_worker", ModuleType("_noticeloom_worker")).__dict__
        if path not in kept:
            tokenizer = Tokenizer.from_file(path)
            ends = np.zeros(tokenizer.get_vocab_size(), bool)
            for token, i in tokenizer.get_vocab().items():
                ends[i] = token.endswith("</w>")
            kept[path] = [tokenizer, ends, {}]
        self.state = kept[path]
        self.tokenizer, self.ends, self.kept = self.state

    def _each(self, chunks: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of lower-case words of letters only, each one piece to the tokenizer."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words):
            return self._each(words)
        raw, at = ids.tobytes(), (4 * ends).tolist()
        return [raw[i:j] for i, j in zip([0, *at[:-1]], at, strict=True)]

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        if len(self.kept) > CACHE:
            self.kept = self.state[2] = {}
        split, plain, other = [], [], []
        for t in texts:
            t = (t or "").replace("\n", " ").replace("\t", " ").replace("\r", " ")
            try:
                t.encode("latin-1")  # all such characters are their own NFC and have one lower case
                t = t.lower()
                plain.append(t.split(" "))
                split.append(plain[-1])
            except UnicodeEncodeError:
                other.append(t.split(" "))
                split.append(other[-1])
        own = self.kept
        new = {c for c in set().union(*plain) if c not in own}
        parts, odd = {}, {c for c in set().union(*other) if c not in own and c not in new}
        words = set()
        for c in new:
            if c.isalpha():  # most chunks are a word and nothing else
                (words if len(c) <= SHORT else odd).add(c)
                continue
            word = c.rstrip(".,")
            if word.isalpha() and len(c) <= SHORT:
                parts[c] = word, c[len(word) :]
                if word not in own:
                    words.add(word)
            else:
                odd.add(c)
        if words:
            words = list(words)
            own |= zip(words, self._words(words), strict=True)
        odd |= {m for _, m in parts.values() if m not in own}
        brief, long = [c for c in odd if len(c) <= SHORT], [c for c in odd if len(c) > SHORT]
        own |= zip(brief, self._each(brief), strict=True)
        own |= {c: own[w] + own[m] for c, (w, m) in parts.items()}
        if not long:
            return [b"".join(map(own.__getitem__, s)) for s in split]
        rare = dict(zip(long, self._each(long), strict=True))
        return [b"".join(own[c] if c in own else rare[c] for c in s) for s in split]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Cut every document's ids (its text's, then END) into pieces of at most `capacity`.

    One row per piece: doc_id, doc_hash (tells rows that repeat a doc_id apart), start, length,
    ids_crc32, doc_tokens, and with_ids the ids themselves (little-endian uint32). A null or empty
    text is the END id alone.
    """
    columns = ["doc_id", "doc_hash", "start", "length", "ids_crc32", "doc_tokens"]

    def run(batches: Iterator) -> Iterator:
        import zlib

        import pyarrow as pa

        encode = Encoder(path or tokenizer_path())
        end = np.array([END], "<u4").tobytes()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                row, start, length, crc, total, ids = [], [], [], [], [], []
                for k, body in enumerate(encode(part.column(2).to_pylist())):
                    body += end
                    n = len(body) // 4
                    for s in range(0, n, capacity):
                        own = body[4 * s : 4 * (s + capacity)]
                        row.append(k)
                        start.append(s)
                        length.append(len(own) // 4)
                        crc.append(zlib.crc32(own))
                        total.append(n)
                        ids.append(own if with_ids else None)
                take = pa.array(row, pa.int64())
                got = [part.column(0).take(take), part.column(1).take(take), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
                yield pa.RecordBatch.from_arrays([*got, pa.array(ids, pa.binary())] if with_ids else got, [*columns, "ids"] if with_ids else columns)
        release()

    schema = ", ".join(f"{c} long" for c in columns) + (", ids binary" if with_ids else "")
    keyed = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("doc_hash"), "text")
    return keyed.mapInArrow(run, schema)


def bundles(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a pattern is made of: (class, pieces, units) of single pieces and, for lengths up to EXACT,
    of bundles, whose rounding up to whole units is shared: 16 pieces waste nothing."""
    row, count = (x.ravel() for x in np.meshgrid(np.arange(len(sizes)), BUNDLES, indexing="ij"))
    keep = (sizes[row] <= EXACT) | (count == 1)
    row, count = row[keep], count[keep]
    return row, count, -(-count * sizes[row] // UNIT)


def knapsack(values: np.ndarray, units: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Best choice by dynamic programming over the room: how often to take each bundle. Of bundles of
    equal units only the most valuable counts."""
    best, pick = np.zeros(room + 1), np.full(room + 1, -1)
    order = np.lexsort((-values, units))
    order = order[np.diff(units[order], prepend=0) > 0]
    ends = np.searchsorted(units[order], np.arange(room + 1), "right")
    for c in range(1, room + 1):
        fit = order[: ends[c]]
        best[c], pick[c] = best[c - 1], -1
        if len(fit):
            v = best[c - units[fit]] + values[fit]
            k = int(v.argmax())
            if v[k] > best[c] + 1e-12:
                best[c], pick[c] = v[k], fit[k]
    pattern, c = np.zeros(len(units), np.int64), room
    while c > 0:
        k = pick[c]
        if k < 0:
            c -= 1
        else:
            pattern[k] += 1
            c -= units[k]
    return float(best[room]), pattern


def column_generation(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 3000) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often to cut each so that `demand[i]` pieces of at most `sizes[i]` tokens all fit.

    Revised simplex on the cutting-stock program; each entering column is the knapsack pattern of
    least reduced cost (or a surplus column where a price is negative). Stops within NEAR of the optimum or after
    `rounds`; any basis is feasible. Amounts are rounded down, and what is left over is packed
    largest first, so the surplus over the program is at most about one sequence a size.
    """
    m, room = len(sizes), capacity // UNIT
    row, count, units = bundles(sizes)
    columns = [np.where(np.arange(m) == i, capacity // sizes[i], 0) for i in range(m)]
    cost = np.ones(m)
    inverse = np.diag(1.0 / (capacity // sizes))
    x = demand / (capacity // sizes)
    for step in range(rounds):
        price = cost @ inverse
        low = int(price.argmin())
        if price[low] < -1e-9:
            enter, c = -1 * (np.arange(m) == low), 0.0
        else:
            value, taken = knapsack(np.maximum(price, 0)[row] * count, units, room)
            enter = np.bincount(row, taken * count, m).astype(np.int64)
            c = 1.0
            if value <= 1 + 1e-7 or x @ cost * (1 - NEAR) <= price @ demand / value:
                break  # optimal, or within NEAR of the lower bound that scaled prices give
        u = inverse @ enter
        ratio = np.where(u > 1e-10, x / np.where(u > 1e-10, u, 1), np.inf)
        r = int(ratio.argmin())
        if not np.isfinite(ratio[r]):
            break
        x = np.maximum(x - ratio[r] * u, 0)
        x[r] = ratio[r]
        columns[r], cost[r] = enter, c
        own = inverse[r] / u[r]
        u[r] = 0
        inverse -= np.outer(u, own)
        inverse[r] = own
        if step % 100 == 99:
            inverse = np.linalg.inv(np.array(columns, float).T)
            x = np.maximum(inverse @ demand, 0)
    left = demand.astype(np.int64).copy()
    out: list[tuple[np.ndarray, int]] = []
    for r in np.argsort(-x):
        a = columns[r]
        if cost[r] and a.max() > 0:
            often = int(min(np.floor(x[r] + 1e-9), min(left[i] // a[i] for i in np.flatnonzero(a > 0))))
            if often > 0:
                out.append((a.astype(np.int64), often))
                left -= often * a
    order = np.argsort(-sizes)
    while left.sum():
        a, free = np.zeros(m, np.int64), capacity
        for i in order:
            k = min(left[i], free // sizes[i])
            a[i] += k
            free -= k * sizes[i]
        often = int(max(1, min(left[i] // a[i] for i in np.flatnonzero(a))))
        out.append((a, often))
        left -= often * a
    return out


@dataclass
class Plan:
    """For each size class: ranks below `upto[j]` (and not below the one before) go to sequences
    from `base[j]` on, `each[j]` to a sequence."""

    upto: dict[int, np.ndarray]
    base: dict[int, np.ndarray]
    each: dict[int, np.ndarray]


def plan(histogram: dict[int, int], capacity: int) -> Plan:
    """The plan for so many pieces of each class: a class is the most tokens of its pieces."""
    classes = np.array(sorted(histogram), np.int64)
    demand = np.array([histogram[c] for c in classes.tolist()], np.int64)
    upto, base, each = ({int(c): [] for c in classes} for _ in range(3))
    done = dict.fromkeys(classes.tolist(), 0)
    sequence = 0
    inner = classes < capacity
    patterns = [([(int(c), 1)], int(n)) for c, n in zip(classes[~inner], demand[~inner], strict=True)]
    if inner.any():
        for a, often in column_generation(classes[inner], demand[inner].astype(float), capacity):
            patterns.append(([(int(classes[inner][i]), int(a[i])) for i in np.flatnonzero(a)], often))
    for parts, often in patterns:
        for c, k in parts:
            done[c] += k * often
            upto[c].append(done[c])
            base[c].append(sequence)
            each[c].append(k)
        sequence += often
    return Plan(*({c: np.array(v, np.int64) for c, v in x.items()} for x in (upto, base, each)))


def pack(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, doc_hash, start, length <= capacity, ...).

    Lengths are classed the finer the shorter they are (see FINE), so the histogram and the linear program
    have at most 128 + capacity / 16 lines whatever the number of documents. Pieces are ranked within their class (by a
    hash; classes are ranked in parts, so one frequent length is no single task), and a piece's rank
    decides its pattern, sequence and place. Offsets follow from the true lengths, without gaps. A
    sequence holds at most `capacity` tokens. No rows: no sequences.
    """
    n, upto = F.col("length"), lambda step: F.ceil(F.col("length") / step) * step
    most = F.when(n <= FINE, n).when(n <= 2 * FINE, upto(2)).when(n <= EXACT, upto(4)).otherwise(upto(UNIT))
    rows = cut(rows).withColumn("_class", most.cast("int"))
    got = {r[0]: r[1] for r in rows.groupBy("_class").count().collect()}
    todo = plan(got, capacity)
    shuffled = F.xxhash64("doc_id", "doc_hash", "start")
    placed = ranked(rows, ["_class"], [shuffled, F.col("doc_id"), F.col("doc_hash"), F.col("start")], "_rank", F.shiftright(shuffled, 52).cast("int"))
    names = [c for c in placed.columns if c not in ("_class", "_rank")]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            c, rank = b.column("_class").to_numpy(), b.column("_rank").to_numpy()
            seq = np.zeros(len(c), np.int64)
            for k in np.unique(c).tolist():
                at = np.flatnonzero(c == k)
                upto, base, each = todo.upto[k], todo.base[k], todo.each[k]
                j = np.searchsorted(upto, rank[at], "right")
                before = np.where(j > 0, upto[np.maximum(j - 1, 0)], 0)
                seq[at] = base[j] + (rank[at] - before) // each[j]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), b.column("_class"), pa.array(seq)], [*names, "_class", "sequence_id"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema.fields if f.name in names)
    out = placed.select(*names, "_class", "_rank").mapInArrow(run, f"{schema}, _class int, sequence_id long")
    inside = Window.partitionBy("sequence_id").orderBy(F.col("_class").desc(), "doc_id", "doc_hash", "start").rowsBetween(Window.unboundedPreceding, -1)
    return out.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long")).drop("_class")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its ids (little-endian uint32), from packed pieces that carry their ids."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(ordered.alias("o"), F.sum("length").alias("tokens")).select(
        "sequence_id", "tokens", F.expr("aggregate(o, cast('' as binary), (a, p) -> concat(a, p.ids))").alias("ids")
    )
