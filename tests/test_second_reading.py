from pyspark.sql import functions as F

from noticeloom.functions import second_reading
from noticeloom.plans import issue_queries, record_queries


def test_readings_are_dealt_to_every_core_and_made_once(spark):
    d = issue_queries.second_reading_fields(spark, "/root/testdata/sf0.001")
    assert d.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert d._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_lines_are_searched_once_for_each_place(spark):
    d = spark.createDataFrame([("x", "y", "n")], "body string, own string, n string")
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        plan = second_reading.read(d, "body", "own", "n", "f")._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    for word in (second_reading.ADDRESS_WORD, second_reading.PURPOSE_WORD, second_reading.FILED, second_reading.BRANCH_WORDS[0]):
        assert plan.count(f", {word})") == 1


def test_odd_readings_give_fields_or_nothing(spark):
    rows = [
        (1, None, None), (2, "", "  \n\t"), (3, "السجل التجاري 20 2005 99999", None), (4, "x", "رقم السجل التجاري\r\n777"),
        (5, "تم الإيداع القانوني بالمحكمة بسطات بتاريخ 19/12/2025 تحت رقم 3\n2025/13/01 2025-02-29", "2024.2.29"),
        (6, "ً\nالهدف\nًa , b\nالمدة\nc", None),
    ]
    d = spark.createDataFrame(rows, "i int, body string, own string").withColumn("n", F.lit(None).cast("string"))
    got = {r.i: r.f for r in second_reading.read(d, "body", "own", "n", "f").collect()}
    assert all(v is None for i in (1, 2) for v in got[i]) and [got[i].commercial_register_number for i in (3, 4)] == ["99999", "777"]
    assert (got[5].filing_date, got[5].decision_date, got[5].filing_number, got[5].court) == ("2025-12-19", "2024-02-29", "3", "بالمحكمة بسطات")
    assert got[6].business_purpose == "ًa, b"


def test_merged_records_are_dealt_to_every_core(spark):
    assert record_queries.merged_readings(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_cities_of_texts_fold_them_once(spark):
    d = spark.createDataFrame([(["Fes"], "à Settat ـ الرِّباط", None), (None, "", "FÈS ﻓﺎس\tTANGER"), (None, None, None)], "had array<string>, a string, b string")
    got = d.select(second_reading.union_cities(F.col("had"), F.col("a"), F.col("b")).alias("c"))
    assert [r.c for r in got.collect()] == [["Fes", "Settat", "Rabat"], ["Tangier", "Fes"], []]
    assert got._jdf.queryExecution().optimizedPlan().toString().count(r"[ \t]+") == 1
