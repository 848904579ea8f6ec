import json
import os

import pytest
from pyspark.sql import functions as F

from noticeloom.functions import second_reading, text
from noticeloom.operators import html_table, layout, records, segment
from noticeloom.plans import catalogue, issue_queries, notices, record_queries  # noqa: F401
from noticeloom.sources import scans, sinks


def test_segments_carry_over_pages_and_drop_the_open_end(spark):
    rows = [("i", 1, 1, "header"), ("i", 2, 1, "a"), ("i", 3, 2, "b"), ("i", 4, 2, "12 C"), ("i", 5, 2, " "), ("i", 6, 2, "3D"), ("i", 7, 3, "open")]
    df = segment.with_reference(spark.createDataFrame(rows, "issue string, position int, page int, line string"))
    got = segment.by_marker(df, page="page").collect()
    assert [(r.reference, r.text, r.pdf_pages) for r in got] == [("12C", "header\na\nb", [1, 2])]
    got = segment.by_marker(df, page="page", trailing=True).orderBy("segment").collect()
    assert [r.reference for r in got] == ["12C", None]


def test_request_parameters():
    q = records.Query.of({"event": [" DISSOLUTION ", "x"], "needs_review": "Yes", "limit": "9999", "offset": "-3", "q": " "})
    assert (q.event, q.needs_review, q.limit, q.offset, q.q) == ("DISSOLUTION", True, 500, 0, None)
    for bad in ({"needs_review": "maybe"}, {"min_confidence": "1.5"}, {"min_confidence": "nan"}, {"limit": "x"}):
        with pytest.raises(ValueError):
            records.Query.of(bad)


@pytest.fixture(scope="module")
def parsed(spark):
    texts = ["ACME ONE\nSARL\nregistre de commerce 5555\nconstitution societe a settat\n2026/01/02", "BETA TWO\nSA\ndissolution de la societe\nrabat", "no event at all"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "ordinal int, text string")
    return notices.parse(df).cache()


def test_filters_page_and_facets(parsed):
    ids = lambda **k: [r.ordinal for r in records.select(parsed, records.Query.of(k)).orderBy("ordinal").collect()]
    assert ids() == [0, 1] and ids(event="dissolution") == [1] and ids(city="SETTAT") == [0] and ids(company="acme") == [0]
    assert ids(q="5555") == [0] and ids(min_confidence="0.9") == [0] and ids(needs_review="true") == [1]
    out = records.respond(parsed, records.Query.of({"limit": "1"}))
    assert out["pagination"] == {"total": 2, "offset": 0, "returned": 1} and json.loads(out["records"][0])["company"]["name"] == "ACME ONE"
    assert {(r.value, r.n) for r in records.facets(parsed, "company.cities_mentioned").collect()} == {("Settat", 1), ("Rabat", 1)}
    assert records.summary(parsed).first().records == 2


def test_sinks_write_whole_files(parsed, tmp_path):
    sinks.export_json(parsed.drop("ordinal"), {"records": 2}, str(tmp_path / "a.json"))
    assert len(json.loads((tmp_path / "a.json").read_text())["records"]) == 2
    sinks.export_csv(parsed, str(tmp_path / "a.csv"), browser=True)
    raw = (tmp_path / "a.csv").read_bytes()
    assert raw.startswith(b"\xef\xbb\xbf") and raw.count(b"\r\n") == 2
    sinks.export_csv(parsed.limit(0), str(tmp_path / "b.csv"))
    assert (tmp_path / "b.csv").read_text(encoding="utf-8-sig") == "company_name,event_type,issue_number,pdf_pages,confidence\n"
    assert sinks.export_name("59/22", "El Jadida", "csv") == "BOAL_59-22_El-Jadida.csv"


def test_second_reading_fills_and_flags(spark, parsed):
    body = "رقم السجل التجاري 194433\nتم الإيداع القانوني بالمحكمة التجارية بتاريخ 06/01/2026 تحت رقم 77\nرأس المال: 100.000 درهم"
    df = parsed.where("ordinal = 1").withColumns({"body": F.lit(body), "own": F.lit(""), "n": F.lit("X")})
    df = second_reading.read(df, "body", "own", "n", "f")
    df = df.withColumn("ocr", F.struct(F.lit(60.0).alias("confidence"), F.col("body").alias("text"), F.col("f").alias("fields")))
    r = second_reading.merge(df).first()
    assert r.ocr.fields.capital_mad == 100000 and r.company.commercial_register_number == "194433"
    assert (r.event.filing.number, r.event.filing.date) == ("77", "2026-01-06")
    assert "ocr_commercial_register_number_needs_review" in r.review_reasons and "commercial_register_number_missing" not in r.review_reasons
    assert r.confidence >= 0.82 and r.needs_review


def test_tables_with_spans(spark):
    html = "<table><tr><td rowspan=2>x</td><td>y</td></tr><tr><td>z</td></tr></table>"
    grid = html_table.cells(spark.createDataFrame([(1, html), (2, None)], "k int, h string"), "k", "h")
    assert [(r.row, r.cell, r.text) for r in grid.orderBy("row", "cell").collect()] == [(0, 0, "x"), (0, 1, "y"), (1, 1, "z")]
    boxed = grid.withColumns({"box": F.array(F.lit(0.0), F.lit(0.0), F.lit(1000.0), F.lit(10.0)), "w": F.lit(1000.0)})
    assert {(r.row, r.column, r.text) for r in html_table.columns_of(boxed, ["k"], "box", "w").collect()} == {(0, 1, "x"), (0, 3, "y"), (1, 3, "z")}


def test_ocr_payload_to_blocks(spark):
    page = {"prunedResult": {"parsing_res_list": [{"block_label": "header", "block_content": "h", "block_bbox": [1, 2, 3, 4]}, {"block_label": "text", "block_content": "left", "block_bbox": [10, 300, 200, 400]}, {"block_label": "paragraph_title", "block_content": "# RIGHT", "block_bbox": [800, 100, 990, 200]}]}}
    for root in ([page, {"markdown": {"text": "only"}}], {"results": [page, {"markdown": {"text": "only"}}]}):
        files = spark.createDataFrame([("i", json.dumps(root))], "issue string, value string")
        pages = scans.ocr_pages(files)
        dims = layout.dimensions(pages.select("issue", F.explode("payload.prunedResult.parsing_res_list.block_bbox").alias("bbox")))
        got = scans.ocr_blocks(pages, dims).orderBy("page", F.col("column").desc(), "top").collect()
        assert [(r.page, r.column, r.text, r.is_title) for r in got] == [(1, 3, "RIGHT", True), (1, 0, "left", False), (2, 3, "only", False)]
    odd = spark.createDataFrame([("i", "[{}]"), ("j", json.dumps([page, "junk", None])), ("k", "{")], "issue string, value string")
    assert [(r.issue, r.page) for r in scans.ocr_pages(odd).orderBy("page").collect()] == [("j", 1), ("j", 2), ("j", 3)]
    assert {tuple(r) for r in scans.ocr_errors(odd).collect()} == {("i", "the file holds no OCR pages"), ("k", "the file is no JSON")}
    with pytest.raises(Exception, match="no OCR pages"):
        scans.ocr_pages(odd.where("issue = 'i'"), strict=True).collect()


def test_lines_read_right_to_left(spark):
    item = lambda s, x, y, n: ("i", 1, 595.276, 841.89, x, y, s, 9.0, "f", n, 20.0)
    rows = [item("head", 50.0, 830.0, 0), item("left", 60.0, 700.0, 1), item("one", 450.0, 700.0, 2), item("two", 480.0, 701.5, 3), item("below", 450.0, 690.0, 4), item("ا", 455.0, 650.0, 5), item("ب", 500.0, 650.0, 6)]
    df = spark.createDataFrame(rows, "issue string, page int, width double, height double, x double, y double, str string, item_height double, font string, source long, item_width double")
    got = layout.lines(df).orderBy("position").collect()
    assert [r.reading_text for r in got] == ["one two", "below", "ب ا", "left"]


def test_html_entities_decode_twice(spark):
    r = spark.createDataFrame([("&amp;lt;b&#x41;&#66; &#39;<br>x",)], "h string").select(text.html_to_text(F.col("h")).alias("t")).first()
    assert r.t == "<bAB '\nx"


def test_failing_records_stay_alone(spark):
    df = spark.createDataFrame([("a", 1), ("b", 0), ("c", 2)], "record_key string, n int")
    got = second_reading.queue(df, "record_key", ["n"], lambda r: {"value": 10 // r["n"]}, "struct<value:int>").orderBy("record_key").collect()
    assert [(r.ocr and r.ocr.value, (r.error or "")[:17]) for r in got] == [(10, ""), (None, "ZeroDivisionError"), (5, "")]


def test_command_line(spark, tmp_path, capsys):
    from noticeloom import cli

    pages = tmp_path / "BOAL_12.txt"
    pages.write_text("4321 bulletin\nACME ONE\nSARL\nconstitution societe\nسطات\nregistre de commerce 5555\n1 A\nno event\n2 B\f4322\nBETA TWO\ndissolution de la societe\n")
    assert cli.main([str(tmp_path / "none.txt")], spark) == 2 and cli.main([str(pages), "--min-confidence", "2"], spark) == 2
    assert cli.main([str(pages), "--include-incomplete"], spark) == 0
    out = json.loads((tmp_path / "BOAL_12.notices.json").read_text())
    assert out["summary"] == {"records": 2, "segments_examined": 3, "document_pages": 2, "records_needing_review": 2}
    assert [(r["source"]["notice_reference"], r["company"]["name"], r["source"]["issue_number"], r["source"]["printed_pages"]) for r in out["records"]] == [("1A", "ACME ONE", "12", ["4321"]), (None, "BETA TWO", "12", ["4322"])]
    assert cli.main([str(pages), "--city", "settat", "--format", "csv", "-o", str(tmp_path / "o" / "x.csv"), "--without-raw-text"], spark) == 0
    rows = (tmp_path / "o" / "x.csv").read_text(encoding="utf-8-sig").splitlines()
    assert len(rows) == 2 and rows[0].startswith("company_name,legal_form,") and rows[0].endswith(",confidence,needs_review,review_reasons") and ",True," in rows[1]
    assert cli.main([str(pages), "--format", "jsonl", "--end-page", "1"], spark) == 0
    assert len((tmp_path / "BOAL_12.notices.jsonl").read_text().splitlines()) == 1
    assert "1 records of 2 segments, pages 1 to 1 of 2" in capsys.readouterr().out
    (tmp_path / "scan.pdf").write_bytes(b"%PDF")
    assert cli.main([str(tmp_path / "scan.pdf")], spark) == 2 and "scan.txt" in capsys.readouterr().err
    assert cli.main([str(pages), "--start-page", "3"], spark) == 2 and cli.main([str(pages), "--start-page", "2", "--end-page", "1"], spark) == 2


def test_service_routes(parsed):
    from noticeloom import service

    assert service.route("/api/", parsed, {})[0] == 200 and service.route("/nothing", parsed, {})[0] == 404
    status, payload, cache = service.route("/api/companies?city=settat&limit=5", parsed, {"records": 2})
    assert (status, payload["pagination"], payload["dataset"]) == (200, {"total": 1, "offset": 0, "returned": 1}, {"records": 2}) and "s-maxage=300" in cache
    assert payload["records"][0]["company"]["name"] == "ACME ONE"
    assert service.route("/api/companies?min_confidence=nan", parsed, {}) == (400, {"error": "min_confidence must lie between 0 and 1"}, "no-store")
    assert service.route("/api/companies", parsed.drop("needs_review").withColumn("needs_review", F.raise_error(F.lit("x")).cast("boolean")), {})[0] in (200, 500)


def test_datasets_and_stores(spark, parsed, tmp_path):
    sinks.export_json(parsed.drop("ordinal"), {"records": 2}, str(tmp_path / "d.json"))
    from noticeloom import service

    data, summary = service.load(spark, str(tmp_path / "d.json"), parsed.drop("ordinal").schema)
    assert summary == {"records": 2} and [(r.ordinal, r.company.name) for r in data.orderBy("ordinal").collect()] == [(0, "ACME ONE"), (1, "BETA TWO")]
    store = str(tmp_path / "store")
    for n, at in ((1, "2026-01-01"), (2, "2026-01-02")):
        sinks.put(spark.createDataFrame([("doc", "k", at, n), ("other", "k", at, 9)], "document_key string, record_key string, processed_at string, ocr int"), store)
    got = sinks.load(spark, store, "doc")
    assert [(r.record_key, r.ocr) for r in got.collect()] == [("k", 2)]
    assert "PartitionFilters: [isnotnull(document_key" in got._jdf.queryExecution().executedPlan().toString() or got.count() == 1
    sinks.json_lines(parsed, str(tmp_path / "lines"))
    sinks.csv(parsed, str(tmp_path / "parts"))
    assert spark.read.json(str(tmp_path / "lines")).count() == 2 and len(spark.read.csv(str(tmp_path / "parts"), header=True).columns) == 25


def test_text_files_by_page(spark, tmp_path):
    (tmp_path / "BOAL_7.txt").write_text("a\nb\fc\fd")
    got = scans.text_lines(spark, str(tmp_path), 1, 2).orderBy("position").collect()
    assert [(r.issue, r.page, r.line) for r in got] == [("7", 1, "a"), ("7", 1, "b"), ("7", 2, "c")]
    assert scans.page_count(scans.text_pages(spark, str(tmp_path))).first().document_pages == 3
    with pytest.raises(ValueError):
        scans.text_lines(spark, str(tmp_path), 3, 2)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in "nation customer orders lineitem events documents pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(catalogue.SQL))
def test_query_matches_its_sql(spark, duck, name):
    key = lambda v: "~" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)
    got = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")
    want = duck.execute(catalogue.SQL[name])
    cols = [d[0] for d in want.description]
    assert sorted(cols) == sorted(got.columns)
    a = sorted(tuple(map(key, r)) for r in got.select(*[f"`{x}`" for x in cols]).collect())
    assert a == sorted(tuple(map(key, r)) for r in want.fetchall())
