import random

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, doc long, th string, shard string, score string"


def words(rng, n, stems=("ba", "ce", "di", "fo", "gu", "ha", "ki", "lo", "mu", "ne")):
    return " ".join("".join(rng.choice(stems) for _ in range(rng.randint(2, 5))) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with copies, near copies, shared passages, nulls, blanks, ties and a long text."""
    rng = random.Random(5)
    base = [words(rng, 60) for _ in range(12)]
    passage = words(rng, 40)
    texts = list(base)
    texts += [base[0]] * 4 + [base[1].upper()]
    for k in range(6):  # near copies of one text, each with one other word changed
        w = base[2].split()
        w[9 * k] = "changed" + str(k)
        texts.append(" ".join(w))
    texts += [base[3] + " " + passage, passage + "\n" + base[4], words(rng, 5) + " " + passage, base[5] * 30, "a" * 400, "é" * 120, "é" * 120, "ab", "one two", "One  TWO", "", None, " \n\t ", "12 34 !!"]
    langs = ["en", "de", None]
    out = [(k, t, langs[k % 3], "src1" if k % 3 else None, len(t or ""), 7, "x", "y", "z") for k, t in enumerate(texts)]
    out.append(out[3])  # a repeated row
    out.append((None, base[7], "en", "src2", 1, 7, "x", "y", "z"))
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOC).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC)
