"""Second readings of many records as a run that can be watched, stopped, gone on with and repeated."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from noticeloom.functions import second_reading
from noticeloom.sources.store import Store


@dataclass
class Progress:
    """Where a run stands: records to do, done and failed, waves of all, and whether it was stopped."""

    todo: int = 0
    done: int = 0
    failed: int = 0
    wave: int = 0
    waves: int = 0
    stopped: bool = False


def schema(result: str) -> str:
    """The schema of a store of runs whose recogniser gives `result` (DDL)."""
    return f"document_key string, record_key string, processed_at timestamp, attempt int, ocr {result}, error string"


class Run:
    """One run of a recogniser over records(document_key, record_key, ...) into a store.

    Records without a result are done, or all with `rerun`, in waves by hash of their key; each wave is
    one write, kept whatever comes later. A record that fails keeps the result it had, with the error and
    the number of attempts beside it, and is done again by the next run; no other record is touched. stop()
    ends the run: its Spark job is cancelled, the wave at work leaves nothing, and the next run does what is
    still pending. A wave that runs twice gives the same key twice, of which one counts.
    """

    def __init__(self, store: Store, result: str, waves: int = 8) -> None:
        self.store, self.result, self.waves = store, result, waves
        self.tag, self._stop = f"run-{uuid.uuid4().hex}", threading.Event()
        self.progress = Progress()

    def stop(self) -> None:
        """End the run from any thread."""
        self._stop.set()
        self.store.spark.sparkContext.cancelJobsWithTag(self.tag)

    def pending(self, records: DataFrame, rerun: bool = False) -> DataFrame:
        """records to do, with the attempts and the result they have in the store."""
        kept = self.store.load().select("document_key", "record_key", F.col("attempt").alias("_attempt"), F.col("ocr").alias("_ocr"))
        own = records.join(kept, ["document_key", "record_key"], "left")
        return own if rerun else own.where(F.col("_ocr").isNull())

    def go(self, records: DataFrame, inputs: list[str], recognise: Callable[[dict], dict], rerun: bool = False, tell: Callable[[Progress], None] | None = None) -> Progress:
        """Do what is to do; `tell` gets the progress after each wave."""
        context, now = self.store.spark.sparkContext, self.progress
        context.addJobTag(self.tag)
        try:
            todo = self.pending(records, rerun).withColumn("_wave", F.pmod(F.xxhash64("document_key", "record_key"), F.lit(self.waves)))
            now.todo, now.waves = todo.count(), self.waves
            for wave in range(self.waves):
                if self._stop.is_set():
                    break
                self._one(todo.where(F.col("_wave") == wave), inputs, recognise)
                now.wave = wave + 1
                if tell:
                    tell(now)
        except Exception:
            if not self._stop.is_set():
                raise
        finally:
            context.removeJobTag(self.tag)
        now.stopped = self._stop.is_set()
        return now

    def _one(self, part: DataFrame, inputs: list[str], recognise: Callable[[dict], dict]) -> None:
        seen = Observation()
        keyed = part.withColumn("_key", F.concat_ws("\u0001", "document_key", "record_key"))
        read = second_reading.queue(keyed.dropDuplicates(["_key"]), "_key", inputs, recognise, self.result)
        old = keyed.groupBy("_key").agg(F.max("_attempt").alias("_attempt"), F.first("_ocr").alias("_ocr"), F.first("document_key").alias("document_key"), F.first("record_key").alias("record_key"))
        rows = old.join(read, "_key").select(
            "document_key", "record_key", F.current_timestamp().alias("processed_at"), (F.coalesce("_attempt", F.lit(0)) + 1).alias("attempt"),
            F.when(F.col("error").isNull(), F.col("ocr")).otherwise(F.col("_ocr")).alias("ocr"), "error",
        )
        self.store.put(rows.observe(seen, F.count_if(F.col("error").isNull()).alias("done"), F.count_if(F.col("error").isNotNull()).alias("failed")))
        self.progress.done += seen.get["done"]
        self.progress.failed += seen.get["failed"]


def restored(records: DataFrame, store: Store) -> DataFrame:
    """records(document_key, record_key, ...) with ocr, error and attempt from the store, null where there is none."""
    kept = store.load().select("document_key", "record_key", "ocr", "error", "attempt")
    return records.drop("ocr", "error", "attempt").join(kept, ["document_key", "record_key"], "left")
