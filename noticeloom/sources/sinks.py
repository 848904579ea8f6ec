"""Sinks: one-file JSON, JSON Lines, CSV; names of exports; a keyed result store."""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noticeloom.operators.records import flat

# The header of an export without records.
EMPTY_HEADER = ["company_name", "event_type", "issue_number", "pdf_pages", "confidence"]


def json_lines(records: DataFrame, path: str) -> None:
    """A folder of JSON Lines, nulls written."""
    records.write.option("ignoreNullFields", "false").json(path)


def csv(records: DataFrame, path: str) -> None:
    """A folder of quoted CSV parts with header."""
    flat(records).write.option("quoteAll", "true").option("escape", '"').csv(path, header=True)


def export_json(records: DataFrame, summary: dict, path: str) -> None:
    """One small-export JSON file, streamed row by row: summary first, then the records."""
    with Path(path).open("w", encoding="utf-8") as out:
        out.write('{\n  "schema_version": "1.0.0",\n  "summary": ' + json.dumps(summary, ensure_ascii=False) + ',\n  "records": [')
        whole = records.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j"))
        for k, row in enumerate(whole.toLocalIterator()):
            out.write(("," if k else "") + "\n    " + row.j)
        out.write("\n  ]\n}\n")


def export_lines(records: DataFrame, path: str) -> None:
    """One file of JSON Lines, nulls written, streamed row by row."""
    with Path(path).open("w", encoding="utf-8", newline="\n") as out:
        for row in records.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator():
            out.write(row.j + "\n")


def export_csv(records: DataFrame, path: str, browser: bool = False) -> None:
    """One CSV file with a byte order mark, streamed row by row. `browser` quotes all cells, ends no last
    line and writes whole numbers and booleans as its own program does; an export without records has
    its full header, the other form EMPTY_HEADER."""
    import csv as writer

    rows = flat(records, browser)
    if browser:
        rows = rows.withColumn("confidence", F.regexp_replace("confidence", r"\.0\z", ""))
        with Path(path).open("w", encoding="utf-8-sig", newline="") as out:
            quoted = lambda row: ",".join('"' + ("" if v is None else v).replace('"', '""') + '"' for v in row)
            out.write(quoted(rows.columns))
            for row in rows.toLocalIterator():
                out.write("\r\n" + quoted(row))
        return
    with Path(path).open("w", encoding="utf-8-sig", newline="") as out:
        w = writer.writer(out)
        first = True
        for row in rows.toLocalIterator():
            if first:
                w.writerow(rows.columns)
            first = False
            w.writerow(["" if v is None else {"true": "True", "false": "False"}.get(v, v) if c == "needs_review" else v for c, v in zip(rows.columns, row, strict=True)])
        if first:
            w.writerow(EMPTY_HEADER)


def export_name(issue: str | None, city: str | None, extension: str) -> str:
    safe = lambda v: re.sub(r"[^A-Za-z0-9_-]+", "-", v)
    return f"BOAL_{safe(issue or 'issue')}_{safe(city or 'all-cities')}.{extension}"


def latest(store: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The newest row per key of an append-only store; of rows of one time the one whose content hashes
    lowest, so that every read gives the same."""
    w = Window.partitionBy(*keys).orderBy(F.col(at).desc(), F.xxhash64(F.to_json(F.struct("*"))))
    return store.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def put(results: DataFrame, path: str) -> None:
    """Append results to the store, partitioned by document for pruned reads."""
    results.write.mode("append").partitionBy("document_key").parquet(path)


def load(spark: SparkSession, path: str, document_key: str) -> DataFrame:
    """The newest result per record of one document; only its partition is read."""
    return latest(spark.read.parquet(path).where(F.col("document_key") == document_key), ["record_key"], "processed_at")


def restore(records: DataFrame, store: DataFrame, key: Column) -> DataFrame:
    """records with their stored second reading (ocr), null where none is stored."""
    kept = latest(store, ["record_key"], "processed_at").select(F.col("record_key").alias("_key"), "ocr")
    return records.drop("ocr").withColumn("record_key", key).join(kept, F.col("record_key") == F.col("_key"), "left").drop("_key")


def pending(records: DataFrame, store: DataFrame, key: Column) -> DataFrame:
    """records whose second reading is not stored yet: what a stopped run still has to do."""
    done = store.select(F.col("record_key").alias("_key")).distinct()
    return records.withColumn("record_key", key).join(done, F.col("record_key") == F.col("_key"), "left_anti")
