"""Pages that arrive one at a time give the segments that the batch plans give."""

import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from noticeloom.operators import ocr_notices
from noticeloom.plans import issues as batch
from noticeloom.streaming import issues

PAGE = "issue string, page int, body string, issue_number string"


@pytest.fixture
def feed(spark, tmp_path):
    """Writes rows as one file, and runs the stream to its end on the same checkpoint each time."""
    sent = []

    def send(make, rows, schema=PAGE):
        (tmp_path / "in").mkdir(exist_ok=True)
        path = tmp_path / "in" / f"p{len(sent)}.json"
        path.write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows))
        os.utime(path, (1_700_000_000 + 60 * len(sent),) * 2)  # files come in order of their times
        sent.append(path)
        stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        q = make(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.parquet(str(tmp_path / "out")).collect()

    return send


def rows_of(*pages, issue="i", number=None):
    return [{"issue": issue, "page": p, "body": b, "issue_number": number} for p, b in pages]


def test_streamed_text_equals_batch_after_restarts(spark, feed):
    rng, pages = random.Random(3), {}
    lines = ["4321 bulletin", "ACME  ONE", "٤٢ P", "6 E", " x‎ y", "شركة", " \t ", "77", "12Z.", "9 z"]
    for issue in ("a", "b"):
        pages[issue] = [(p, "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 9))) or "x") for p in range(1, 9)]
    sent = [(i, p, b) for i in pages for p, b in pages[i]]
    rng.shuffle(sent)
    for k in (0, 8):  # each start is a restart from the checkpoint
        feed(issues.segments, [{"issue": i, "page": p, "body": b, "issue_number": "77"} for i, p, b in sent[k : k + 8]])
    got = feed(issues.segments, [r for i in pages for r in rows_of((9, ""), issue=i, number="77")])
    df = spark.createDataFrame([(i, p, b) for i in pages for p, b in pages[i]], "issue string, page int, body string")
    known = spark.createDataFrame([(i, "77") for i in pages], "issue string, issue_number string")
    want = batch.text_segments(df, known, trailing=True).collect()
    key = lambda r: (r.issue, str(r.reference), r.text, tuple(r.pdf_pages), tuple(r.printed_pages))
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert any(r.reference == "42P" for r in got) and any(r.printed_pages == ["4321"] for r in got)


def test_streamed_pages_wait_for_their_turn(feed):
    """A page that comes early waits; a page that comes again is left out; an ended issue can start anew."""
    feed(issues.segments, rows_of((3, "c\n9 Z"), (1, "a")))
    assert len(feed(issues.segments, rows_of((3, "again"), (1, "again"), (2, "b"), (4, "left"), (5, None)))) == 2
    got = feed(issues.segments, rows_of((1, "new\n1 A")))
    assert sorted((r.reference or "", r.text, r.pdf_pages) for r in got) == [("", "left", [4]), ("1A", "new", [1]), ("9Z", "a\nb\nc", [1, 2, 3])]


def test_silent_issues_end_by_a_timer(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps(r) for r in rows_of((1, "a"), (3, "c"))))
    stream = issues.segments(spark.readStream.schema(PAGE).json(str(tmp_path / "in")), idle_ms=1)
    q = stream.writeStream.format("memory").queryName("silent").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        for _ in range(240):  # processing time goes on without data
            got = spark.sql("SELECT * FROM silent").collect()
            if got or q.exception():
                break
            time.sleep(0.5)
    finally:
        q.stop()
    assert [(r.issue, r.reference, r.text, r.pdf_pages) for r in got] == [("i", None, "a\nc", [1, 3])]


def test_streamed_blocks_equal_batch(spark, feed):
    from test_ocr_notices import BLOCKS, random_blocks

    rows = random_blocks(11, issues=2, pages=10)
    df = spark.createDataFrame(rows, BLOCKS)
    want = ocr_notices.segments(df).collect()
    last = [{"issue": i, "page": 11} for i in ("i0", "i1")]
    block = F.struct("column", "top", "source_index", "is_title", "text", "review_reasons", "printed_page")
    pages = df.groupBy("issue", "page").agg(F.collect_list(block).alias("blocks"))
    every = spark.createDataFrame([(i, p) for i in ("i0", "i1") for p in range(1, 11)], "issue string, page int").join(pages, ["issue", "page"], "left").withColumn("blocks", F.coalesce("blocks", F.array()))
    sent = [json.loads(r.j) for r in every.select(F.to_json(F.struct("*")).alias("j")).collect()]
    schema = "issue string, page int, blocks array<struct<column:int,top:double,source_index:int,is_title:boolean,text:string,review_reasons:array<string>,printed_page:string>>"
    random.Random(1).shuffle(sent)
    feed(issues.ocr_segments, sent[:9], schema)
    got = feed(issues.ocr_segments, sent[9:] + last, schema)
    key = lambda r: (r.issue, str(r.reference), r.reference_inferred, r.text, tuple(r.pdf_pages), tuple(r.printed_pages), str(r.company_name_hint), tuple(r.review_reasons))
    assert sorted(map(key, got)) == sorted(map(key, want)) and len(got) > 10
