import time

from noticeloom.functions import rules
from noticeloom.operators import layout
from noticeloom.plans import catalogue, notices


def test_runs_take_more_tasks_for_more_rows(spark, monkeypatch):
    monkeypatch.setattr(catalogue, "TASK_ROWS", 100)
    sf = "/root/testdata/sf0.001"
    rows = catalogue.table(spark, sf, "lineitem").count()
    assert catalogue.consecutive_runs(spark, sf).rdd.getNumPartitions() == rows // 100 + 1 > 4


def test_a_line_of_many_items_takes_time_in_proportion(spark):
    """One line of 30,000 items and 10,000 lines on one page; each item's share of work is bounded."""
    wide = spark.range(30_000).selectExpr("cast(id % 100 as double) AS x", "1200000.0D AS y", "cast(id as string) AS str", "id AS source")
    tall = spark.range(10_000).selectExpr("cast(0 as double) AS x", "100000 + 10.0D * id AS y", "concat('t', id) AS str", "30000 + id AS source")
    items = wide.union(tall).selectExpr("'i' AS issue", "1 AS page", "595.0D AS width", "2000000.0D AS height", "*", "9.0D AS item_height", "'f' AS font", "1.0D AS item_width")
    began = time.time()
    rows = layout.lines(items).select("text").collect()
    assert time.time() - began < 30
    assert [r.text for r in rows[1:]] == [f"t{k}" for k in reversed(range(10_000))] and rows[0].text == " ".join(map(str, range(30_000)))


def test_ascii_texts_skip_work_and_give_what_others_give(spark):
    """The short ways of ASCII texts against the long ones, which a letter without meaning (an accent) brings about."""
    assert rules.java(r"\bSA\b", "js").startswith("(?isu)S(?<")  # the letter is found before the edge is asked
    base = ["ACME ONE\nSARL\nconstitution societe\nle 2024/3/5", "XSARL s.a.r.l. a.u x\nconstitution societe\n12 - 03 - 2024, _1/2/2023 2022.1.1b", "BETA\tTWO\nS A\x0bS\nconstitution societe\nle 5 mars 2024 RC 4321 capital 12 000 dhs",
            "Gamma\nGAMMA  X\nXRC 77 registre commercial 5555\nconstitution societe\n2001/1/1/2002/2/2", "constitution societe"]
    rows = [(i, long, t + ("\né" if long else "")) for i, t in enumerate(base) for long in (0, 1)]
    df = spark.createDataFrame(rows, "i int, long int, text string")
    for dialect in ("js", "py"):
        got = {(r.i, r.long): (r.company, r.event, r.confidence, r.review_reasons) for r in notices.parse(df, rules.pack(dialect), include_raw_text=False).collect()}
        assert len(got) == len(rows) and all(got[i, 0] == got[i, 1] for i in range(len(base)))
    assert got[0, 0][0].legal_form == "SARL" and got[0, 0][1].decision_date == "2024-03-05"
