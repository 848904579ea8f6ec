import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from noticeloom.llm import packing
from noticeloom.llm.common import shared_folder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `row` string, `th` int, doc int"


def prose(rng, n):
    return " ".join("".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def made():
    """Rows with copies, near copies, shared passages, benchmark items, nulls, repeated ids and a long text."""
    rng = random.Random(9)
    base = [prose(rng, 80) for _ in range(10)]
    passage, item, other = prose(rng, 30), prose(rng, 40), prose(rng, 40)
    near = base[0].split()
    near[40] = "changed"
    words = other.split()
    rows = [(k, t) for k, t in enumerate(base)]
    rows += [(20, base[1]), (21, " ".join(near)), (22, base[2].upper()), (30, base[3] + " " + passage), (31, passage + " " + prose(rng, 60)), (32, prose(rng, 60) + " " + passage)]
    rows += [(40, prose(rng, 30) + " " + item), (41, " ".join(words[20:]) + " " + prose(rng, 30) + " " + " ".join(words[:20]))]
    rows += [(50, None), (51, ""), (52, "12 34 !!"), (53, " \n"), (54, prose(rng, 9000)), (None, prose(rng, 50)), (None, base[4]), (5, prose(rng, 70)), (6, base[6])]
    langs = ["en", "de", None]
    return [(k, t, langs[i % 3], f"src{i % 2}" if i % 5 else None, len(t or ""), "r", i, 1) for i, (k, t) in enumerate(rows)], [(1, item), (2, prose(rng, 12)), (3, None), (4, other)]


@pytest.fixture(scope="module")
def folder(spark, made, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(made[0], SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(made[1], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0d]+", bytes(c + 32 if 65 <= c < 91 else c for c in text.encode()))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def without_near_copies(rows):
    """Of each group linked at a similarity of 0.8, the row of the smallest id; rows without an id stay."""
    own = sorted({(k, t) for k, t in rows if k is not None}, key=str)
    root = list(range(len(own)))
    sets = [shingles(t) for _, t in own]
    for i in range(len(own)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    groups = {}
    for r, row in zip(root, own, strict=True):
        groups.setdefault(r, []).append(row)
    return [(sorted(g, key=lambda x: x[0])) for g in groups.values()], [r for r in rows if r[0] is None]


def without_repeats(rows):
    """Texts without the bytes of 100-byte strings that start earlier; cut characters go whole."""
    seen, out = set(), []
    for k, t in sorted(rows, key=lambda r: -(2**63) if r[0] is None else r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(b[p : p + 100])
        out.append((k, bytes(x for x, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")))
    return out


def tiled(doc, item, least=5):
    """Words of item covered by greedy string tiling, by trying every start at every step."""
    d, t = (re.findall(r"[^\W_]+", x.lower()) for x in (doc, item))
    free_d, free_t, covered = [True] * len(d), [True] * len(t), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(t)):
            for j in range(len(d)):
                n = 0
                while i + n < len(t) and j + n < len(d) and free_t[i + n] and free_d[j + n] and t[i + n] == d[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < min(least, len(t)) or not n:
            return covered / max(1, len(t))
        covered += n
        free_t[i : i + n] = free_d[j : j + n] = [False] * n


def test_stages_match_brute_force(spark, folder, made):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    stage = dict(corpus_pipeline.STAGES)

    def after(name, before):
        out = stage[name](spark, before, folder)
        assert out.columns == names
        return out.cache()

    def pairs(df):
        return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]

    lettered = after("language ID", docs)
    want = [(k, t) for k, t, *_ in made[0] if any(c.isalpha() for c in t or "")]
    assert Counter(pairs(lettered)) == Counter(want)

    apart = after("MinHash near-dedup", lettered)
    groups, without_id = without_near_copies(want)
    got = pairs(apart)
    assert len(got) == len(groups) + len(without_id) and {r for r in got if r[0] is None} == set(without_id)
    for g in groups:
        assert len([r for r in got if r in g]) == 1 and [r for r in got if r in g][0][0] == g[0][0]

    cleaned = after("suffix-array dedup", apart)
    ids = [k for k, _ in got]
    if len(set(ids)) == len(ids) - ids.count(None) + 1:  # rows that share an id come in no told order
        unordered = {None, *(k for k in ids if ids.count(k) > 1)}
        assert {r for r in pairs(cleaned) if r[0] not in unordered} <= set(without_repeats(got))
    assert sum(len(t) for _, t in pairs(cleaned)) < sum(len(t) for _, t in got) - 100

    clean = after("benchmark decontamination", cleaned)
    leaks = {k for k, t in pairs(cleaned) if any(tiled(t, item) >= 0.6 for _, item in made[1] if item)}
    assert leaks == {40, 41}
    assert Counter(pairs(clean)) == Counter(r for r in pairs(cleaned) if r[0] not in leaks)

    pieces = stage["packing"](spark, clean, folder).collect()
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    assert sum(r.length for r in pieces) == sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in pairs(clean))
    for s in {r.sequence_id for r in pieces}:
        own = sorted((r.offset, r.length) for r in pieces if r.sequence_id == s)
        assert [o for o, _ in own] == np.cumsum([0, *[n for _, n in own[:-1]]]).tolist() and sum(n for _, n in own) <= packing.CAPACITY


def test_run_applies_all_stages(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    key = ["doc_id", "start", "length", "ids_crc32"]
    assert Counter(map(tuple, got.select(key).collect())) == Counter(map(tuple, docs.select(key).collect()))


def test_empty_documents_give_an_empty_result(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clusters_need_a_shared_folder():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda *_: None)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="checkpoint.dir"):
        shared_folder(Session)
