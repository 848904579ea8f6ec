"""Streaming: whole issues by file, and pages that arrive one at a time, of text or of OCR blocks."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from noticeloom.functions import extract, rules, text
from noticeloom.operators import ocr_notices
from noticeloom.sources import scans

SEGMENT = "issue string, reference string, text string, pdf_pages array<int>, printed_pages array<string>"
OCR_SEGMENT = "issue string, reference string, reference_inferred boolean, text string, pdf_pages array<int>, printed_pages array<string>, company_name_hint string, review_reasons array<string>, inferred_markers int"
#: The state store that state variables, timers and time to live need.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def files(spark: SparkSession, path: str) -> DataFrame:
    """A stream with one row per issue file: path, body. Parsing a row needs no state."""
    return spark.readStream.format("text").option("wholetext", "true").load(path).select(F.input_file_name().alias("path"), F.col("value").alias("body"))


class Lines:
    """Lines of text pages to segments, as segment.collected() makes them; pending lines are kept between pages."""

    columns = ("reference", "text", "pdf_pages", "printed_pages")

    def __init__(self) -> None:
        self.pending: list[list] = []

    def page(self, page: int, payload: str) -> list[tuple]:
        out = []
        got = json.loads(payload)
        for r in got.get("lines") or ():
            if r.get("marker"):
                out += self.end(r["marker"])
            elif r["line"].strip():
                self.pending.append([r["line"], page, got.get("printed")])
        return out

    def end(self, reference: str | None = None) -> list[tuple]:
        lines, self.pending = self.pending, []
        unique = lambda k: list(dict.fromkeys(x[k] for x in lines if x[k] is not None))
        return [(reference, "\n".join(x[0] for x in lines), unique(1), unique(2))] if lines else []

    def state(self) -> str:
        return json.dumps(self.pending, ensure_ascii=False)

    def resume(self, state: str) -> None:
        self.pending = json.loads(state)


class Blocks:
    """OCR blocks of pages to segments, as ocr_notices.segments() makes them, but without regions."""

    columns = ("reference", "reference_inferred", "text", "pdf_pages", "printed_pages", "company_name_hint", "review_reasons", "inferred_markers")

    def __init__(self, is_event: Callable[[str], bool]) -> None:
        self.reader = ocr_notices.Reader(is_event)

    def page(self, page: int, payload: str) -> list[tuple]:
        out = []
        for b in json.loads(payload).get("blocks") or ():
            own = {k: b.get(k) for k in ocr_notices.BLOCK} | {"page": page, "text": b.get("text") or ""}
            out += self.reader.block(SimpleNamespace(**own))
        return [(*f[:7], f[8]) for f in out]

    def end(self) -> list[tuple]:
        return [(*f[:7], f[8]) for f in self.reader.flush(None, False)]

    def state(self) -> str:
        return self.reader.state()

    def resume(self, state: str) -> None:
        self.reader.resume(state)


class Pages(StatefulProcessor):
    """Pages of an issue in their turn, from 1 on, through a reader of pages.

    State: the page that comes next and what the reader has pending, one value; early pages, a map by
    number, each written once and removed in its turn. Timers end silent issues.
    """

    def __init__(self, make: Callable[[], Lines | Blocks], idle_ms: int | None, keep_ms: int | None) -> None:
        self.make, self.idle_ms, self.keep_ms = make, idle_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "turn int, pending string")
        self.early = handle.getMapState("early", "page int", "payload string, ends boolean", ttlDurationMs=self.keep_ms)

    def told(self, issue: str, out: list[tuple]) -> Iterator[pd.DataFrame]:
        if out:
            yield pd.DataFrame([(issue, *r) for r in out], columns=["issue", *self.reader.columns])

    def begin(self) -> int:
        self.reader = self.make()
        place = self.place.get()
        if not place:
            return 1
        self.reader.resume(place[1])
        return place[0]

    def quiet(self, now: int | None) -> None:
        """Forget the timers, and set one anew while the issue goes on."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if now is not None:
            self.handle.registerTimer(now + self.idle_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        turn, new, out, over = self.begin(), {}, [], False
        for page, payload, ends in ((int(p), q, bool(e)) for frame in rows for p, q, e in frame[["page", "payload", "ends"]].itertuples(index=False)):
            if page >= turn:
                new.setdefault(page, (payload, ends))
        for page in [p for p in new if self.early.containsKey((p,))]:
            del new[page]  # the page that came first counts
        while not over:
            if turn in new:
                payload, over = new.pop(turn)
            elif self.early.exists() and self.early.containsKey((turn,)):
                payload, over = self.early.getValue((turn,))
                self.early.removeKey((turn,))
            else:
                break
            out += self.reader.page(turn, payload)
            turn += 1
        if over:
            out += self.reader.end()
            self.place.clear()
            self.early.clear()
        else:
            for page, value in new.items():
                self.early.updateValue((page,), value)
            self.place.update((turn, self.reader.state()))
        if self.idle_ms:
            self.quiet(None if over else timerValues.getCurrentProcessingTimeInMs())
        yield from self.told(key[0], out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.begin()
        out = []
        for page, (payload, _) in sorted((k[0], v) for k, v in self.early.iterator()):
            out += self.reader.page(page, payload)
        out += self.reader.end()
        self.place.clear()
        self.early.clear()
        yield from self.told(key[0], out)

    def close(self) -> None:
        pass


def run(pages: DataFrame, make: Callable[[], Lines | Blocks], schema: str, idle_ms: int | None, keep_ms: int | None) -> DataFrame:
    pages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    timed = idle_ms or keep_ms
    return pages.groupBy("issue").transformWithStateInPandas(Pages(make, idle_ms, keep_ms), schema, "append", "processingTime" if timed else "none")


def ended(c: Column) -> Column:
    return F.coalesce(c == "", F.lit(True))


def segments(pages: DataFrame, idle_ms: int | None = None, keep_ms: int | None = None, dialect: str = "py") -> DataFrame:
    """Segments of a stream of pages(issue, page, body and, optionally, issue_number); pages count from 1.

    The same segments as issues.text_segments() with trailing lines: bodies are normalised, lines cut,
    references and printed pages found as columns, before any state. A line that is a whole reference
    ends the pending segment. Pages that come before their turn wait for it; a page that comes again, or
    after its turn, is left out. An empty or null body ends the issue in its turn: what is pending goes out
    without a reference and the state is removed.

    With `idle_ms`, an issue that stays silent for so long ends too, its early pages in order first. With
    `keep_ms`, a page that waits longer than that for its turn is forgotten. The session's state store is
    set to RocksDB, which state variables need.
    """
    body = text.normalise(F.col("body"), dialect)
    own = pages.select("issue", "page", ended(F.col("body")).alias("ends"), body.alias("body"), (F.col("issue_number") if "issue_number" in pages.columns else F.lit(None).cast("string")).alias("number"))
    marked = F.transform(text.lines_of(F.col("body"), dialect), lambda r: F.struct(r.alias("line"), extract.notice_reference(r).alias("marker")))
    payload = F.to_json(F.struct(marked.alias("lines"), scans.text_printed_page(F.col("body"), F.col("number")).alias("printed")))
    return run(own.select("issue", "page", "ends", payload.alias("payload")), Lines, SEGMENT, idle_ms, keep_ms)


def ocr_segments(pages: DataFrame, pack: rules.RulePack | None = None, idle_ms: int | None = None, keep_ms: int | None = None) -> DataFrame:
    """Segments of a stream of OCR pages(issue, page, blocks); pages count from 1, and the rest is as in
    segments(), but that null blocks end the issue.

    blocks: array of structs with column, top, source_index, is_title, text, review_reasons and
    printed_page, as scans.ocr_blocks() gives them; the size of the page decides the column, so it must be
    known before the page is sent. Equal to ocr_notices.segments(), but that references read for another
    behind the last segment are not added to it, as it has gone out.
    """
    make_test = ocr_notices.event_test(pack or rules.pack("js"))
    block = lambda b: F.struct((-b["column"]).alias("o"), b["top"].alias("top"), b["source_index"].alias("source_index"), *[b[c].alias(c) for c in ("column", "is_title", "review_reasons", "printed_page")], text.tidy(b["text"], "js").alias("text"))
    # NFKC of all texts of a page in one call: a Python function can't run inside an array
    joined = text.nfkc(F.array_join(F.transform("blocks", lambda b: F.coalesce(b["text"], F.lit(""))), "\u0001"))
    own = pages.select("issue", "page", "blocks", joined.alias("all")).withColumn("parts", F.split("all", "\u0001"))
    whole = F.transform("blocks", lambda b, k: b.withField("text", F.get("parts", k)))
    payload = F.to_json(F.struct(F.array_sort(F.transform(whole, block)).alias("blocks")))
    return run(own.select("issue", "page", F.col("blocks").isNull().alias("ends"), payload.alias("payload")), lambda: Blocks(make_test()), OCR_SEGMENT, idle_ms, keep_ms)
