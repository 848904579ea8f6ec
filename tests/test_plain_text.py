from pyspark.sql import functions as F

from noticeloom.functions import extract, rules, text
from noticeloom.operators import html_table


def test_ascii_texts_meet_no_pattern_of_other_letters_and_no_unicode_class(spark, capsys):
    d = spark.range(1).select(F.lit("a settat").alias("t"))
    d.select(text.strip(F.col("t"))).explain()
    assert "(?U)" not in capsys.readouterr().out
    d.select(extract.cities(F.col("t"), rules.pack("js"))).explain(True)
    assert "octet_length" in capsys.readouterr().out


def test_ascii_and_other_texts_are_told_alike(spark):
    rows = [("settat",), ("à settat سطات",), ("سطات",), ("",), (None,)]
    d = spark.createDataFrame(rows, "t string")
    assert [r.c for r in d.select(extract.cities(text.fold(F.col("t")), rules.pack("js")).alias("c")).collect()][:4] == [["Settat"]] * 3 + [[]]


def test_strip_knows_all_white_space(spark):
    every = [chr(c) for c in range(1, 0x3100)]
    d = spark.createDataFrame([(c + "a" + c,) for c in every], "t string")
    assert d.where(~text.strip(F.col("t")).eqNullSafe(F.regexp_replace("t", r"(?U)\A\s+|\s+\z", ""))).count() == 0


def test_plain_cells_stay_as_they_are(spark, capsys):
    made = {"q 17": "q 17", " q  17 ": "q 17", "a\tb": "a b", "a\n\n b": "a\nb", "A &AMP; F": "A & F", "x&#65;": "xA", "a<br>b": "a\nb", "é e": "é e", "": "", " ": "", None: None}
    d = spark.createDataFrame(list(made.items()), "t string, told string")
    assert d.where(~text.html_to_text(F.col("t")).eqNullSafe(F.col("told"))).count() == 0
    capsys.readouterr()
    d.select(text.html_to_text(F.col("t"))).explain(True)
    assert "octet_length" in capsys.readouterr().out


def test_tables_of_every_shape_pass_as_arrow(spark):
    d = spark.createDataFrame([(1, "<tr><td rowspan=2>a</td><th colspan='0'>b</th></tr><tr><td>é</td></tr>"), (2, None), (3, "x")], "k int, html string")
    got = {r.k: r.g for r in d.select("k", html_table.grid(F.col("html")).alias("g")).collect()}
    assert [tuple(c) for c in got[1].cells] == [(0, 0, 1, "a"), (0, 1, 1, "b"), (1, 1, 1, "é")] and tuple(got[1])[:2] == (2, 2)
    assert [tuple(got[k]) for k in (2, 3)] == [(0, 0, [])] * 2
