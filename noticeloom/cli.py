"""Command line: an issue's page text to records in one file."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from noticeloom.functions import extract, rules
from noticeloom.operators import records
from noticeloom.plans import issues, notices
from noticeloom.sources import scans, sinks


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="noticeloom", description="Extract company events from an issue's page text (form feeds between pages).")
    p.add_argument("pages", type=Path, help="text file, or a PDF whose text lies beside it as .txt")
    p.add_argument("-o", "--output", type=Path)
    p.add_argument("--format", choices=("json", "jsonl", "csv"), default="json")
    p.add_argument("--issue-number")
    p.add_argument("--publication-date")
    p.add_argument("--source-url")
    p.add_argument("--start-page", type=int, default=1)
    p.add_argument("--end-page", type=int)
    p.add_argument("--city")
    p.add_argument("--min-confidence", type=float, default=0.0)
    p.add_argument("--without-raw-text", action="store_true")
    p.add_argument("--include-incomplete", action="store_true")
    return p


def kept(found: DataFrame, least: float, city: str | None) -> DataFrame:
    """Records of a confidence and, if asked for, a city."""
    own = found.where(F.col("confidence") >= least)
    return own.where(records.member("company.cities_mentioned", city)) if city else own


def refused(why: str) -> int:
    print(f"noticeloom: {why}", file=sys.stderr)
    return 2


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0, or 2 with a message where the text is missing, or pages or confidence are out of range.

    Records are computed once: the write of the file and the counts of the closing line read one table.
    """
    a = arguments().parse_args(argv)
    source = a.pages.with_suffix(".txt") if a.pages.suffix.lower() == ".pdf" else a.pages
    if not a.pages.is_file():
        return refused(f"there is no file {a.pages}")
    if not source.is_file():
        return refused(f"the text of {a.pages.name} is expected beside it, in {source.name}")
    if not 0 <= a.min_confidence <= 1:
        return refused("the least confidence is a number from 0 to 1")
    spark = spark or SparkSession.builder.appName("noticeloom").getOrCreate()
    last = scans.text_pages(spark, str(source.resolve())).agg(F.max("page")).first()[0] or 0
    end = min(a.end_page or last, last)
    if not 1 <= a.start_page <= end:
        return refused(f"pages {a.start_page} to {a.end_page or last} are not within 1 to {last}")
    wanted = scans.text_pages(spark, str(source.resolve()), a.start_page, end)
    known = wanted.select("issue").distinct().select(
        "issue", F.coalesce(F.lit(a.issue_number), extract.issue_number(F.lit(a.pages.stem))).alias("issue_number"), F.lit(a.publication_date).alias("publication_date"),
        F.lit(a.source_url).alias("source_url"), F.lit(str(a.pages.resolve())).alias("pdf_path"),
    )
    pack = rules.pack("py")
    examined = Observation("segments")
    segments = issues.text_segments(wanted, known, a.include_incomplete, pack).observe(examined, F.count(F.lit(1)).alias("n"))
    # kept as it is: a filter on the confidence would be pushed below all that the confidence is made of
    parsed = notices.parse(segments.join(known, "issue"), pack, not a.without_raw_text).cache()
    try:
        counted = kept(parsed, a.min_confidence, a.city).agg(F.count(F.lit(1)).alias("n"), F.count_if("needs_review").alias("review")).first()
        out = kept(parsed, a.min_confidence, a.city).orderBy("segment").drop("issue", "segment")
        path = a.output or a.pages.with_suffix(f".notices.{a.format}")
        path.parent.mkdir(parents=True, exist_ok=True)
        seen = examined.get["n"]
        if a.format == "json":
            sinks.export_json(out, {"records": counted.n, "segments_examined": seen, "document_pages": last, "records_needing_review": counted.review}, str(path))
        elif a.format == "jsonl":
            sinks.export_lines(out, str(path))
        else:
            sinks.export_csv(out, str(path))
    finally:
        parsed.unpersist()
    print(f"{path}: {counted.n} records of {seen} segments, pages {a.start_page} to {end} of {last}")
    return 0
