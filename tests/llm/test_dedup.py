import hashlib
import random
import re

import numpy as np

from noticeloom.llm import minhash, suffix_dedup
from noticeloom.llm.common import Powers, components


def words(rng, n):
    return " ".join(str(rng.randrange(10**6)) for _ in range(n))


def brute_groups(rows, k, percent):
    sets = {}
    for doc_id, text, *_ in rows:
        if doc_id is None:
            continue
        b = bytes(c + 32 if 65 <= c < 91 else c for c in (text or "").encode())
        w = re.findall(rb"[^\x20\x09-\x0d]+", b)
        sets[doc_id] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_near_duplicates_match_brute_force(docs, rows, monkeypatch):
    want = brute_groups(rows, 4, 80)
    assert len({c for _, c in want.values()}) < len(want) - 5
    for block in (1024, 2):
        monkeypatch.setattr(minhash, "BLOCK", block)
        got = minhash.near_duplicates(docs, 4, 80).collect()
        assert len(got) == len(rows)
        for r in got:
            if r.doc_id is None:
                assert r.component_id is None and r.kept
            else:
                assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)


def test_one_document_of_each_group_stays(docs, no_docs, rows):
    want = {c for _, c in brute_groups(rows, 5, 80).values()}
    kept = minhash.first_of_groups(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == sorted(want) and ids.count(None) == 1
    assert minhash.first_of_groups(no_docs).count() == 0


def test_texts_that_share_an_id_are_apart(spark):
    rng = random.Random(3)
    a, b, c = (words(rng, 60) for _ in range(3))
    rows = [(1, a), (2, a + " end"), (2, b), (3, c), (3, c), (3, c + " end"), (0, None), (0, "")]
    got = minhash.first_of_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.text) for r in got} - {(3, c), (3, c + " end")} == {(1, a), (2, b), (0, None), (0, "")}
    assert len(got) == 5


def test_bayesian_bounds_keep_pairs_at_the_threshold():
    least = minhash.least_matches(0.8, 1e-6)
    assert len(least) == minhash.HASHES // minhash.BATCH and all(a < 0.8 * 10 * (i + 1) for i, a in enumerate(least))
    assert least[-1] > 0.5 * minhash.HASHES


def brute_spans(rows):
    seen, out = set(), {}
    for doc_id, text in sorted({(r[0] if r[0] is not None else -(2**63), r[1] or "") for r in rows}):
        b = text.encode()
        mask = bytearray(len(b))
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if w in seen:
                mask[p : p + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(x for x, g in zip(b, mask, strict=True) if not g)
        runs = sum(1 for k in range(len(mask)) if mask[k] and (k == 0 or not mask[k - 1]))
        out[doc_id] = (len(b), sum(mask), runs, hashlib.sha256(kept).hexdigest())
    return out


def test_repeated_strings_match_brute_force(docs, rows, monkeypatch):
    want = brute_spans(rows)
    assert sum(w[1] for w in want.values()) > 3000
    for phrases, least in ((20_000, 500), (1, 500), (20_000, 2)):  # no hot trigger; hot in settling; hot from the start
        monkeypatch.setattr(suffix_dedup, "HOT_PHRASES", phrases)
        monkeypatch.setattr(suffix_dedup, "HOT_LEAST", least)
        monkeypatch.setattr(suffix_dedup, "FLUSH_HOT", 2)
        got = suffix_dedup.digest(docs).collect()
        assert len(got) == len(rows)
        for r in got:
            key = -(2**63) if r.doc_id is None else r.doc_id
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[key], r


def test_phrases_cover_every_string_once(monkeypatch):
    rng = np.random.default_rng(6)
    texts = [bytes(rng.integers(97, 100, n, dtype=np.uint8)) for n in (0, 99, 100, 101, 700, 3000)] + [b"a" * 300]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    for piece in (1 << 20, 400):
        monkeypatch.setattr(suffix_dedup, "PIECE", piece)
        whole = [np.concatenate(x) for x in zip(*suffix_dedup.text_triggers(data, offsets, Powers()), strict=True)]
        hot = [np.concatenate(x) for x in zip(*suffix_dedup.text_triggers(data, offsets, Powers(), np.unique(whole[0])), strict=True)]
        for key, phrase, text, lo, n in (whole, hot):
            got = sorted((t, s) for t, a, m in zip(text.tolist(), lo.tolist(), n.tolist(), strict=True) for s in range(a, a + m))
            assert got == [(t, s) for t, b in enumerate(texts) for s in range(len(b) - 99)]
            by = {}
            for k, p, t, a, m in zip(key.tolist(), phrase.tolist(), text.tolist(), lo.tolist(), n.tolist(), strict=True):
                assert by.setdefault(p, (texts[t][a : a + m + 99], k)) == (texts[t][a : a + m + 99], k)


def test_suffix_dedup_keeps_columns_and_empty_tables(docs, no_docs, rows):
    cleaned = suffix_dedup.deduplicate(docs)
    assert cleaned.columns == docs.columns
    got = cleaned.collect()
    assert len(got) == len(rows) and all(r.doc == 7 and r.th == "x" for r in got)
    assert all(r.n_chars == len(r.text) for r in got if r.text is not None)
    assert suffix_dedup.digest(no_docs).count() == 0


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 300)] + [(500, 500)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(300))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
