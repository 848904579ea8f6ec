import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from noticeloom.functions import rules
from noticeloom.operators import ocr_notices as o


def test_references_split_blocks():
    assert o.references_in("a\nb 12 C.\nd", "") == [("a\nb", "12C", False), ("d", None, False)]
    assert o.references_in("6771", "") == [("6771", None, False)]
    assert o.references_in("6771", "تم الإيداع القانوني") == [("", "677I", True)]
    assert o.references_in("42P", "x") == [("", "42P", False)]


def test_titles_and_folding():
    assert o.meaningful("## ACME") and not o.meaningful("S.A.R.L") and not o.meaningful("شركة")
    assert o.plain_fold("إنشاء  فَرْع‏ ٣") == "انشاء فرع 3"


def test_titles_end_complete_notices(spark):
    b = lambda page, top, title, text: ("i", page, 3, float(top), top, title, text, [])
    rows = [b(1, 1, True, "ACME"), b(1, 2, False, "constitution d'une societe a rabat"), b(1, 3, True, "BETA"), b(2, 1, False, "dissolution de la societe"), b(2, 2, False, "42 P"), b(2, 3, False, "tail text")]
    blocks = spark.createDataFrame(rows, "issue string, page int, column int, top double, source_index int, is_title boolean, text string, review_reasons array<string>")
    got = o.segments(blocks).orderBy("segment").collect()
    assert [(r.reference, r.company_name_hint, r.pdf_pages) for r in got] == [(None, "ACME", [1]), ("42P", "BETA", [1, 2]), (None, None, [2])]


BLOCKS = "issue string, page int, column int, top double, source_index int, is_title boolean, text string, review_reasons array<string>, printed_page string"


def random_blocks(seed, issues=3, pages=40):
    """Blocks of titles, events, filings, sure references alone, within and behind texts, and numbers read for one."""
    rng, out = random.Random(seed), []
    for i in range(issues):
        for page in range(1, pages + 1):
            for k in range(rng.randrange(7)):
                body = rng.choice(["constitution de societe a settat", "dissolution de la societe", "تم الإيداع القانوني بتاريخ 12/02/2025", "تم التقييد", "6771", "12 B", "x\n33 C.\n6771\ny", "note\n٤٤ D", "## 5 E", " \n ", "registre de commerce 123"])
                title = rng.random() < 0.25
                out.append((f"i{i}", page, rng.randrange(4), float(rng.randrange(5)), k, title, rng.choice(["ACME", "BETA SA", "SARL"]) if title else body, rng.choice([[], ["r"]]), str(4000 + page)))
    return out


def in_one(rows, pack):
    """The segments of one issue's blocks, read one after another."""
    reader, out = o.Reader(o.event_test(pack)()), []
    for r in sorted(rows, key=lambda r: (r[1], -r[2], r[3], r[4])):
        out += reader.block(SimpleNamespace(page=r[1], column=r[2], is_title=r[5], text=o.unicodedata.normalize("NFKC", r[6]).translate(str.maketrans("٠١٢٣٤٥٦٧٨٩", "0123456789")).strip(), review_reasons=r[7], printed_page=r[8], bbox=None))
    out += reader.flush(None, False)
    if reader.markers and out:
        out[-1] = (*out[-1][:-1], out[-1][-1] + reader.markers)
    return [(k, *f[:7], f[8]) for k, f in enumerate(out)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_stretches_equal_one_reading_of_an_issue(spark, seed):
    rows = random_blocks(seed)
    got = o.segments(spark.createDataFrame(rows, BLOCKS)).drop("regions").collect()
    want = {(i, *map(str, f)) for i in {r[0] for r in rows} for f in in_one([r for r in rows if r[0] == i], rules.pack("js"))}
    assert {(r.issue, *map(str, (r.segment, r.reference, r.reference_inferred, r.text, r.pdf_pages, r.printed_pages, r.company_name_hint, r.review_reasons, r.inferred_markers))) for r in got} == want
    assert len(got) == len(want) > 20 and any(r.reference_inferred for r in got)


def test_one_issue_is_many_stretches(spark):
    rows = random_blocks(5, issues=1, pages=300)
    stretches = o.segment.of_pages(o.prepared(spark.createDataFrame(rows, BLOCKS)), lines="blocks").groupBy("segment").count()
    assert stretches.count() > 100 and stretches.agg({"count": "max"}).first()[0] < 60


def test_what_is_pending_can_be_put_away(spark):
    rows = sorted((r for r in random_blocks(7, issues=1)), key=lambda r: (r[1], -r[2], r[3], r[4]))
    own, out, state = o.event_test(rules.pack("js"))(), [], None
    for r in rows:
        reader = o.Reader(own)
        if state:
            reader.resume(state)
        out += reader.block(SimpleNamespace(page=r[1], column=r[2], is_title=r[5], text=r[6], review_reasons=r[7], printed_page=r[8], bbox=None))
        state = reader.state()
    whole = o.Reader(own)
    assert out == [f for r in rows for f in whole.block(SimpleNamespace(page=r[1], column=r[2], is_title=r[5], text=r[6], review_reasons=r[7], printed_page=r[8], bbox=None))]


def test_plain_texts_pass_by_the_work_on_odd_ones(spark):
    from noticeloom.functions import text

    texts = ["", "a b", "SARL\nrc 12", "12 P", " a", "a ", "\na", "a\n", "a  b", "a \nb", "a\n b", "a\tb", "a\rb", "a\x0bb", "a\fb", "é", "١٢ P", "## a", "<td>a</td>", "a & b", "a\n\nb", "\x1ca"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    odd = text.untidy(F.col("t"), "<#")
    got = df.select("t", odd.alias("odd"), text.clean_block(F.col("t")).alias("clean"), text.untidy(F.col("t")).alias("untidy"), text.normalise(F.col("t")).alias("normal")).collect()
    assert all(r.clean == r.t for r in got if r.odd is None) and all(r.normal == r.t for r in got if r.untidy is None)
    assert [r.t for r in got if r.odd is None] == ["", "a b", "SARL\nrc 12", "12 P", "a & b", "a\n\nb", "\x1ca"]
