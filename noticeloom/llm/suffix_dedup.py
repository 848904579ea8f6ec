"""Removal of repeated 100-byte strings by prefix-free parsing.

Triggers: a rolling (Karp-Rabin) hash of every 32-byte gram; a gram is a trigger if its hash is the
least in some run of 69 grams, that is in some 100-byte string. So every 100-byte string has one
trigger, the same one at the same place wherever the string occurs. Triggers cut a text into
phrases: a phrase is the run of 100-byte strings that have one trigger, about 35 of them, and
overlaps the next phrase by 99 bytes. Each 100-byte string lies in one phrase, so no order of
strings ever depends on what follows a phrase: of the suffix array of the parse, only the corpus
order of a phrase's occurrences is needed.

Dictionary: the distinct phrases of a trigger. Parse: their occurrences in corpus order (doc_id,
then start). Phrases that occur again whole need no suffix order at all: every later occurrence is
a repeat. Only the first occurrences of different phrases around one trigger are sorted: a suffix
array of the dictionary to depth 100, combined with the parse order, puts equal strings side by side
with the earliest first. Triggers seen once, nearly all in ordinary text, end at the first shuffle.

A trigger with very many phrases (a line that many documents set in their own contexts) is hot. Hot
triggers are counted over the whole corpus first; each of their 100-byte strings is a phrase of its
own, keyed by its own hash, so that neither such a trigger nor its phrases meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeloom.llm.common import BYTE, U64, Powers, chunks, cut, mix, release, utf8

LENGTH = 100
GRAM = 32
RUN = LENGTH - GRAM + 1
PIECE = 1 << 18
BUCKET_BYTES = 12 << 20
DICT_BYTES = 1 << 20
HOT_PHRASES = 20_000
HOT_LEAST = 500
HOT_SHARE = 2e-5
FLUSH = 400_000
FLUSH_HOT = 4
MIX_A, MIX_B = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93)
WHOLE = U64(LENGTH * int(MIX_A) % 2**64)


def triggers(d: np.ndarray, starts: np.ndarray, ends: np.ndarray, pw: Powers, only: tuple[int, int] | None = None, hot: np.ndarray | None = None):
    """Phrases of consecutive texts d[starts[i]:ends[i]]: (trigger hash, phrase hash, text index,
    first 100-byte string's start in d, number of 100-byte strings). `only` limits the starts; `hot`
    (sorted) are the triggers whose strings are phrases of their own."""
    n = len(d)
    none = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if n < LENGTH:
        return none
    up, down = pw.of(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE[d] * up[:n], dtype=np.uint64, out=total[1:])
    grams = mix((total[GRAM:] - total[:-GRAM]) * down[: n - GRAM + 1])
    low_bits = U64((1 << 22) - 1)
    m = len(grams)
    padded = np.full(-(-m // RUN) * RUN, U64(2**64 - 1))
    padded[:m] = (grams & ~low_bits) | np.arange(m, dtype=np.uint64)
    block = padded.reshape(-1, RUN)
    left = np.minimum.accumulate(block, axis=1).ravel()
    right = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(right[: n - LENGTH + 1], left[RUN - 1 : RUN - 1 + n - LENGTH + 1])
    fits = np.zeros(n + 1, np.int32)
    long = ends - starts >= LENGTH
    np.add.at(fits, starts[long], 1)
    np.add.at(fits, ends[long] - LENGTH + 1, -1)
    ok = np.cumsum(fits)[: n - LENGTH + 1] > 0
    if only:
        ok[: only[0]] = False
        ok[only[1] :] = False
    lo = np.flatnonzero(ok)
    at = (least[ok] & low_bits).astype(np.int64)
    if not len(at):
        return none
    edge = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (lo[1:] != lo[:-1] + 1)]))
    count = np.diff(np.append(edge, len(at)))
    at, lo = at[edge], lo[edge]
    text = np.searchsorted(starts, at, "right") - 1
    width = count + (LENGTH - 1)
    phrase = mix((total[lo + width] - total[lo]) * down[lo] + width.astype(np.uint64) * MIX_A)
    if hot is not None and len(hot):
        key = grams[at]
        place = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
        spread = hot[place] == key
        if spread.any():  # each 100-byte string of a hot trigger is a phrase with a key of its own
            n = count[spread]
            each = np.repeat(lo[spread], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            own = mix((total[each + LENGTH] - total[each]) * down[each] + WHOLE)
            plain = ~spread
            return (
                np.concatenate([key[plain], mix(own + MIX_B)]), np.concatenate([phrase[plain], own]), np.concatenate([text[plain], np.repeat(text[spread], n)]),
                np.concatenate([lo[plain], each]), np.concatenate([count[plain], np.ones(len(each), np.int64)]),
            )
    return grams[at], phrase, text, lo, count


def text_triggers(data: np.ndarray, offsets: np.ndarray, pw: Powers, hot: np.ndarray | None = None) -> Iterator[tuple]:
    """triggers() over whole texts in bounded pieces, with text indices and starts within the text."""
    piece = PIECE
    for i, j in chunks(offsets, piece):
        if offsets[j] - offsets[i] <= 2 * piece:
            own = offsets[i : j + 1] - offsets[i]
            key, phrase, text, lo, n = triggers(data[offsets[i] : offsets[j]], own[:-1], own[1:], pw, None, hot)
            yield key, phrase, text + i, lo - own[text], n
            continue
        size = int(offsets[j] - offsets[i])  # one long text: pieces whose 100-byte strings don't overlap
        for p in range(0, size, piece):
            a, b = max(0, p - 2 * LENGTH), min(size, p + piece + 3 * LENGTH)
            d = data[offsets[i] + a : offsets[i] + b]
            key, phrase, text, lo, n = triggers(d, np.array([0]), np.array([b - a]), pw, (p - a, p - a + piece), hot)
            yield key, phrase, text + i, lo + a, n


PHRASES = np.dtype([("key", "<u8"), ("phrase", "<u8"), ("doc", "<i8"), ("th", "<i8"), ("lo", "<i4"), ("n", "<i4")])
ASKED = np.dtype([("key", "<u8"), ("lo", "<i4"), ("n", "<i4")])


def binaries(rows: np.ndarray, edges: np.ndarray):
    """An Arrow binary array of the runs rows[edges[i]:edges[i + 1]]."""
    import pyarrow as pa

    rows = np.ascontiguousarray(rows)
    size = rows.dtype.itemsize * (rows.shape[1] if rows.ndim > 1 else 1)
    offsets = (np.asarray(edges) * size).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(rows.tobytes())])


def changes(*columns: np.ndarray) -> np.ndarray:
    """True where a sorted row differs from the one before."""
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = False
        for c in columns:
            out[1:] |= c[1:] != c[:-1]
    return out


def spans_by_doc(doc: np.ndarray, th: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    """(doc ids, text hashes, binary of merged (start, end) pairs), a row per document."""
    o = np.lexsort((hi, lo, th, doc))
    doc, th, lo, hi = doc[o], th[o], lo[o], hi[o]
    new = changes(doc, th)
    # ends need not rise with starts, so take the running end within a document
    group = np.cumsum(new)
    run = np.maximum.accumulate(hi.astype(np.int64) + group * (1 << 32)) - group * (1 << 32)
    start = new.copy()
    start[1:] |= lo[1:] > run[:-1]
    first = np.flatnonzero(start)
    last = np.append(first[1:], len(lo)) - 1
    pairs = np.stack([lo[first], run[last]], axis=1).astype(np.int32)
    d = np.flatnonzero(new[first])
    return doc[first][d], th[first][d], binaries(pairs, np.append(d, len(first)))


def first_kept(p: np.ndarray):
    """Sort occurrences by trigger, phrase and corpus order: (sorted rows, is the first of its
    phrase, is a later occurrence of it). The same place met twice is neither."""
    o = np.lexsort((p["lo"], p["th"], p["doc"], p["phrase"], p["key"]))
    p = p[o]
    first = changes(p["key"], p["phrase"])
    head = np.maximum.accumulate(np.where(first, np.arange(len(p)), 0))
    same = (p["doc"] == p["doc"][head]) & (p["th"] == p["th"][head]) & (p["lo"] == p["lo"][head])
    return p, first, ~same


def squeeze(raw: bytes) -> bytes:
    """zstd, after the length in 4 bytes: texts and phrase tables cross shuffles in this form."""
    import pyarrow as pa

    return len(raw).to_bytes(4, "little") + pa.compress(raw, "zstd", asbytes=True)


def unsqueeze(body: bytes) -> bytes:
    import pyarrow as pa

    return pa.decompress(body[4:], int.from_bytes(body[:4], "little"), "zstd", asbytes=True)


def phrase_tables(p: np.ndarray, edges: np.ndarray) -> list[bytes]:
    """Each run of phrase rows, column by column so that ids and starts compress."""
    return [squeeze(b"".join(np.ascontiguousarray(p[c][a:b]).tobytes() for c in PHRASES.names)) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


def phrase_rows(body: bytes) -> np.ndarray:
    raw = unsqueeze(body)
    p, at = np.empty(len(raw) // PHRASES.itemsize, PHRASES), 0
    for c in PHRASES.names:
        kind = PHRASES[c]
        p[c] = np.frombuffer(raw, kind, len(p), at)
        at += len(p) * kind.itemsize
    return p


OUT = "bucket int, kind int, doc long, th long, body binary"


def _rows(bucket, kind, doc, th, body):
    import pyarrow as pa

    n = len(body)
    full = lambda v, t: pa.array(v, t) if isinstance(v, np.ndarray) else pa.array([v] * n, t)
    return pa.RecordBatch.from_arrays([full(bucket, pa.int32()), full(kind, pa.int32()), full(doc, pa.int64()), full(th, pa.int64()), body], ["bucket", "kind", "doc", "th", "body"])


def hot_triggers(keyed: DataFrame) -> np.ndarray:
    """The triggers with the most phrases, sorted: at least HOT_LEAST of them, and HOT_SHARE of all,
    so there are 1 / HOT_SHARE (50,000; 400 KB) at most, whatever the input.

    Every text is read. Phrases that differ are counted per FLUSH phrases of a task; a trigger counts
    where it has FLUSH_HOT of them, so one that goes unseen has less than 1 in 100,000 of the phrases.
    What is hot decides only how the work is dealt, never what is a repeat.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def flush(held: list) -> Iterator:
            key, phrase = (np.concatenate(x) for x in zip(*held, strict=True))
            o = np.argsort(phrase)
            own, n = np.unique(key[o][changes(phrase[o])], return_counts=True)  # a phrase has one trigger
            many = n >= FLUSH_HOT
            zero = np.zeros(many.sum(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(own[many].view(np.int64), 0)), pa.array(np.append(n[many], 0)), pa.array(np.append(zero, n.sum()))], ["key", "n", "all"])

        pw, held, size = Powers(), [], 0
        for batch in batches:
            for key, phrase, *_ in text_triggers(*utf8(batch.column(0)), pw):
                held.append((key, phrase))
                size += len(key)
                if size >= FLUSH:
                    yield from flush(held)
                    held, size = [], 0
        if size:
            yield from flush(held)
        release()

    found = keyed.select("text").mapInArrow(run, "key long, n long, all long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("all").alias("all"))
    found = cut(found)
    total = found.agg(F.sum("all")).first()[0] or 0
    rows = found.where(F.col("n") >= max(HOT_LEAST, int(total * HOT_SHARE))).select("key").collect()
    return np.sort(np.array([r.key for r in rows], np.int64).view(np.uint64))


def scan(keyed: DataFrame, buckets: int) -> DataFrame:
    """Phrases of every text, packed by trigger bucket, after local repeats have become spans."""
    shared = keyed.sparkSession.sparkContext.broadcast(hot_triggers(keyed))

    def flush(held: list) -> Iterator:
        p, first, later = first_kept(np.concatenate(held))
        if later.any():
            q = p[later]
            doc, th, body = spans_by_doc(q["doc"], q["th"], q["lo"], q["lo"] + q["n"] + (LENGTH - 1))
            yield _rows((mix(doc.view(np.uint64)) % U64(buckets)).astype(np.int32), 0, doc, th, body)
        p = p[first]
        b = (p["key"] % U64(buckets)).astype(np.int32)
        o = np.lexsort((p["lo"], p["th"], p["doc"], b))
        p, b = p[o], b[o]
        e = np.flatnonzero(changes(b))
        import pyarrow as pa

        yield _rows(b[e], 1, None, None, pa.array(phrase_tables(p, np.append(e, len(p))), pa.binary()))

    def run(batches: Iterator) -> Iterator:
        pw, held, size = Powers(), [], 0
        for batch in batches:
            doc, th = (batch.column(i).to_numpy() for i in (0, 1))
            for key, phrase, text, lo, n in text_triggers(*utf8(batch.column(2)), pw, shared.value):
                p = np.empty(len(key), PHRASES)
                p["key"], p["phrase"], p["doc"], p["th"], p["lo"], p["n"] = key, phrase, doc[text], th[text], lo, n
                held.append(p)
                size += len(p)
                if size >= FLUSH:
                    yield from flush(held)
                    held, size = [], 0
        if size:
            yield from flush(held)
        del held
        release()

    return keyed.select("doc", "th", "text").mapInArrow(run, OUT)


def settle(phrases: DataFrame) -> DataFrame:
    """Per trigger bucket: spans of whole phrases that occur earlier (kind 0), and the first
    occurrences of phrases whose trigger has other phrases too (kind 1), a row per document."""

    def run(key, t):
        import pyarrow as pa
        import pyarrow.compute as pc

        out = [t.filter(pc.equal(t.column("kind"), 0))]
        p = np.concatenate([np.empty(0, PHRASES), *map(phrase_rows, t.column("body").filter(pc.equal(t.column("kind"), 1)).to_pylist())])
        k = np.sort(p["key"])
        twice = np.unique(k[1:][k[1:] == k[:-1]])
        del k
        if len(twice):
            at = np.minimum(np.searchsorted(twice, p["key"]), len(twice) - 1)
            p, first, later = first_kept(p[twice[at] == p["key"]])
            if later.any():
                q = p[later]
                doc, th, body = spans_by_doc(q["doc"], q["th"], q["lo"], q["lo"] + q["n"] + (LENGTH - 1))
                out.append(pa.Table.from_batches([_rows(0, 0, doc, th, body)]))
            q = p[first]
            edge = np.flatnonzero(changes(q["key"]))
            many = np.diff(np.append(edge, len(q)))
            each = np.repeat(many, many)
            q, each = q[each > 1], each[each > 1]
            if len(q):
                a = np.empty(len(q), ASKED)
                a["key"], a["lo"], a["n"] = q["key"], q["lo"], np.where(each > HOT_PHRASES, -q["n"], q["n"])
                o = np.lexsort((q["lo"], q["th"], q["doc"]))
                doc, th, a = q["doc"][o], q["th"][o], a[o]
                e = np.flatnonzero(changes(doc, th))
                out.append(pa.Table.from_batches([_rows(0, 1, doc[e], th[e], binaries(a, np.append(e, len(a))))]))
        return pa.concat_tables([x.cast(out[0].schema) for x in out])

    return phrases.groupBy("bucket").applyInArrow(run, OUT)


def dictionary(asked: DataFrame, keyed: DataFrame, buckets: int) -> DataFrame:
    """The bytes of the phrases asked for, a row each. A trigger with more than HOT_PHRASES phrases
    is spread: each of its 100-byte strings becomes a phrase dealt by its own hash."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        pw = Powers()
        for batch in batches:
            cols = {"bucket": [], "doc": [], "th": [], "lo": [], "n": [], "phrase": []}
            for i in range(batch.num_rows):
                raw = unsqueeze(batch.column(2)[i].as_py())
                for body in batch.column(3)[i].as_py():
                    for key, lo, n in np.frombuffer(body, ASKED).tolist():
                        if n < 0:
                            d = np.frombuffer(raw, np.uint8)[lo : lo - n + LENGTH - 1]
                            up, down = pw.of(len(d) + 1)
                            tot = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE[d] * up[: len(d)], dtype=np.uint64)])
                            own = mix((tot[LENGTH:] - tot[:-LENGTH]) * down[: len(d) - LENGTH + 1])
                            todo = [(int(own[k]), lo + k, 1) for k in range(-n)]
                        else:
                            todo = [(key, lo, n)]
                        for k, s, m in todo:
                            for c, v in zip(cols, (k % buckets, batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), s, m, raw[s : s + m + LENGTH - 1]), strict=True):
                                cols[c].append(v)
                if len(cols["n"]) > 20_000:
                    yield pa.RecordBatch.from_pydict(cols, schema=schema)
                    cols = {c: [] for c in cols}
            yield pa.RecordBatch.from_pydict(cols, schema=schema)

    import pyarrow as pa

    schema = pa.schema([("bucket", pa.int32()), ("doc", pa.int64()), ("th", pa.int64()), ("lo", pa.int32()), ("n", pa.int32()), ("phrase", pa.binary())])
    per_doc = asked.groupBy("doc", "th").agg(F.collect_list("body").alias("bodies"))
    joined = squeezed(keyed.select("doc", "th", "text")).join(per_doc, ["doc", "th"]).select("doc", "th", "text", "bodies")
    return joined.mapInArrow(run, "bucket int, doc long, th long, lo int, n int, phrase binary")


def suffix_ranks(d: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Ranks, to depth LENGTH, of the suffixes of d at `starts` (equal strings, equal rank).

    Prefix doubling from 8 to 32 bytes over the whole dictionary gives its suffix order to depth 32;
    the suffixes at `starts` then combine the ranks at 0, 32, 64 and 68 to their 100 bytes.
    """
    n = len(d)
    pad = np.concatenate([d, np.zeros(8, np.uint8)])
    word = np.zeros(n, np.uint64)
    for j in range(8):
        word = (word << U64(8)) | pad[j : j + n]
    rank = np.unique(word, return_inverse=True)[1].astype(np.uint64)
    many = U64(n + 1)
    for depth in (8, 16):
        after = np.concatenate([rank[depth:], np.zeros(min(depth, n), np.uint64)])[:n]
        rank = np.unique(rank * many + after, return_inverse=True)[1].astype(np.uint64)
    out = rank[starts]
    for step in (GRAM, 2 * GRAM, LENGTH - GRAM):
        out = np.unique(out * many + rank[starts + step], return_inverse=True)[1].astype(np.uint64)
    return out


def order_suffixes(phrases: DataFrame) -> DataFrame:
    """Per bucket: every 100-byte string of the dictionary in suffix order, then corpus order; all
    but the first of each run of equal strings become spans."""

    def run(key, t):
        import pyarrow as pa

        col = {c: t.column(c).to_numpy() for c in ("doc", "th", "lo", "n")}
        d = np.frombuffer(b"".join(t.column("phrase").to_pylist()), np.uint8)
        n = col["n"].astype(np.int64)
        begin = np.concatenate([[0], np.cumsum(n + LENGTH - 1)[:-1]])
        which = np.repeat(np.arange(len(n)), n)
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        rank = suffix_ranks(d, begin[which] + step)
        doc, th, lo = col["doc"][which], col["th"][which], col["lo"][which].astype(np.int64) + step
        known = np.lexsort((lo, th, doc, rank))
        rank, doc, th, lo = rank[known], doc[known], th[known], lo[known]
        first = changes(rank)
        head = np.maximum.accumulate(np.where(first, np.arange(len(rank)), 0))
        later = ~((doc == doc[head]) & (th == th[head]) & (lo == lo[head]))
        if not later.any():
            return pa.table({"doc": pa.array([], pa.int64()), "th": pa.array([], pa.int64()), "body": pa.array([], pa.binary())})
        a, b, body = spans_by_doc(doc[later], th[later], lo[later], lo[later] + LENGTH)
        return pa.table({"doc": a, "th": b, "body": body})

    return phrases.groupBy("bucket").applyInArrow(run, "doc long, th long, body binary")


def squeezed(rows: DataFrame) -> DataFrame:
    """rows with `text` compressed (empty for null), for shuffles."""
    schema = ", ".join(f"`{f.name}` {'binary' if f.name == 'text' else f.dataType.simpleString()}" for f in rows.schema.fields)
    names = rows.columns
    at = names.index("text")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            data, offsets = utf8(b.column(at))
            z = pa.array([squeeze(data[i:j].tobytes()) for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([z if k == at else c for k, c in enumerate(b.columns)], names)

    return rows.mapInArrow(run, schema)


def with_spans(docs: DataFrame, rest: list[str]) -> DataFrame:
    """(rest: struct, text: compressed, missing, spans: array of packed (start, end) pairs) of docs."""
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"),
        F.col("text").isNull().alias("missing"),
        "text",
    )
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    few = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    settled = cut(settle(scan(keyed, max(few, size // BUCKET_BYTES))))
    asked = settled.where("kind = 1")
    # an asked row holds 16 bytes a phrase of about 135
    phrases = (asked.agg(F.sum(F.octet_length("body"))).first()[0] or 0) // ASKED.itemsize
    spans = settled.where("kind = 0").select("doc", "th", "body")
    if phrases:
        spans = spans.union(order_suffixes(dictionary(asked, keyed, int(max(few, phrases * 135 // DICT_BYTES)))))
    per_doc = spans.groupBy("doc", "th").agg(F.collect_list("body").alias("spans"))
    return squeezed(keyed).join(per_doc, ["doc", "th"], "left").select("rest", "text", "missing", "spans")


def united(bodies: list[bytes] | None) -> np.ndarray:
    """Maximal removed runs, as (start, end) rows, of a document's packed spans."""
    if not bodies:
        return np.zeros((0, 2), np.int64)
    s = np.frombuffer(b"".join(bodies), np.int32).reshape(-1, 2).astype(np.int64)
    s = s[np.argsort(s[:, 0], kind="stable")]
    run = np.maximum.accumulate(s[:, 1])
    new = np.ones(len(s), bool)
    new[1:] = s[1:, 0] > run[:-1]
    first = np.flatnonzero(new)
    return np.stack([s[first, 0], run[np.append(first[1:], len(s)) - 1]], axis=1)


def kept_bytes(raw: bytes, runs: np.ndarray) -> bytes:
    out, at = [], 0
    for a, b in runs.tolist():
        out.append(raw[at:a])
        at = b
    out.append(raw[at:])
    return b"".join(out)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document.

    Every byte covered by a 100-byte string that also starts earlier (smaller doc_id, or the same
    document and an earlier start) is removed; strings are judged on the input. Null texts are
    empty. Null doc_ids come first. Rows that repeat a doc_id with another text are ordered by a
    hash of the text; rows equal in both are one document and get the same result.
    """

    def run(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        for b in batches:
            size, gone, n, sha = [], [], [], []
            for text, bodies in zip(b.column(1), b.column(3), strict=True):
                raw = unsqueeze(text.as_py())
                runs = united(bodies.as_py())
                kept = kept_bytes(raw, runs)
                size.append(len(raw))
                gone.append(len(raw) - len(kept))
                n.append(len(runs))
                sha.append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0).field(0).cast(pa.int64()), *(pa.array(x, pa.int64()) for x in (size, gone, n)), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return with_spans(docs, ["doc_id"]).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs with repeated strings cut out of `text` (and n_chars, if there, set anew).

    Repeats are bytes; a character that loses some of its bytes goes whole. Nothing else changes;
    a null text stays null, and a text that is all repeats becomes empty.
    """
    names = docs.columns
    rest = [c for c in names if c != "text"]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            out = []
            for text, missing, bodies in zip(b.column(1), b.column(2).to_pylist(), b.column(3), strict=True):
                raw, runs = unsqueeze(text.as_py()), united(bodies.as_py())
                out.append(None if missing else kept_bytes(raw, runs).decode("utf-8", "ignore").encode() if len(runs) else raw)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary()).cast(pa.string())], ["rest", "text"])

    full = with_spans(docs, rest)
    cleaned = full.mapInArrow(run, f"rest {full.schema['rest'].dataType.simpleString()}, text string")
    cleaned = cleaned.select(*[F.col("text") if c == "text" else F.col(f"rest.`{c}`").alias(c) for c in names])
    if "n_chars" in names:
        cleaned = cleaned.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars").cast("long")))
    return cleaned
