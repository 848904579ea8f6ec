"""A store of results by document and record: appended runs, and snapshots that take their place.

Layout: log/<id>/ (one write each, whole once it has _SUCCESS), snapshots/<id>/, and versions/<n>, a small
JSON file that names a snapshot and the log folders it holds. A version is made by creating its file,
which fails if it is there: of two compactions one wins, and the other's snapshot is never read. Readers
take the last version and the log folders that it doesn't hold, so no row is lost or doubled, whoever
stops at whatever point.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeloom.sources.lineage import shared_folder

KEYS = ("document_key", "record_key")


def scratch(spark: SparkSession, name: str) -> str:
    """The path of a new folder under the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


class Store:
    """Results(document_key, record_key, processed_at, ...) under `path`, the newest of each key counting.

    Of rows of one time the one whose other columns hash lowest counts, so that every read gives the same.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self.files = self.hadoop.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self.hadoop.Path(f"{self.path}/{folder}")
        return sorted(x.getPath().getName() for x in self.files.listStatus(at)) if self.files.exists(at) else []

    def _whole(self, folder: str) -> bool:
        return self.files.exists(self.hadoop.Path(f"{self.path}/{folder}/_SUCCESS"))

    def version(self) -> tuple[int, dict]:
        """The number of the last version (0: none) and what it names."""
        numbers = [int(n) for n in self._names("versions") if n.isdigit()]
        if not numbers:
            return 0, {"snapshot": None, "holds": []}
        stream = self.files.open(self.hadoop.Path(f"{self.path}/versions/{max(numbers)}"))
        try:
            return max(numbers), json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _fresh(self, holds: list[str]) -> list[str]:
        return [n for n in self._names("log") if n not in set(holds) and self._whole(f"log/{n}")]

    def _read(self, folders: list[str]) -> DataFrame:
        """Rows of folders; each is read by its own path, so that a document's rows are one directory in each."""
        out = None
        for f in folders:
            one = self.spark.read.schema(self.schema).option("basePath", f"{self.path}/{f}").parquet(f"{self.path}/{f}")
            out = one if out is None else out.unionByName(one)
        return out if out is not None else self.spark.createDataFrame([], self.schema)

    def put(self, results: DataFrame) -> str:
        """Append results as one write, by document; the name of its folder."""
        name = uuid.uuid4().hex
        results.select(*self._read([]).columns).write.partitionBy("document_key").parquet(f"{self.path}/log/{name}")
        return name

    def rows(self) -> DataFrame:
        """All rows that may count: the snapshot's and those appended since."""
        _, at = self.version()
        return self._read([*([f"snapshots/{at['snapshot']}"] if at["snapshot"] else []), *[f"log/{n}" for n in self._fresh(at["holds"])]])

    def load(self, document_key: str | None = None) -> DataFrame:
        """The newest row of each key; of one document only its directories are read."""
        rows = self.rows()
        return newest(rows if document_key is None else rows.where(F.col("document_key") == document_key))

    def compact(self) -> bool:
        """Write the newest rows as a snapshot and make it the next version; false if another compaction
        came first, whose version then counts. Log folders that a version holds, and snapshots, are removed two
        versions later; a read that takes longer than that has to begin again."""
        number, at = self.version()
        fresh = self._fresh(at["holds"])
        name = uuid.uuid4().hex
        rows = self._read([*([f"snapshots/{at['snapshot']}"] if at["snapshot"] else []), *[f"log/{n}" for n in fresh]])
        newest(rows).write.partitionBy("document_key").parquet(f"{self.path}/snapshots/{name}")
        here = set(self._names("log"))
        told = {"snapshot": name, "holds": sorted({*fresh, *(n for n in at["holds"] if n in here)}), "before": at["holds"], "old": at["snapshot"]}
        target = self.hadoop.Path(f"{self.path}/versions/{number + 1}")
        draft = self.hadoop.Path(f"{self.path}/versions/.{name}")
        stream = self.files.create(draft, True)
        try:
            stream.write(bytearray(json.dumps(told).encode()))
        finally:
            stream.close()
        won = not self.files.exists(target) and self._claimed(draft, target)
        self.files.delete(draft, False)
        if not won:
            self.files.delete(self.hadoop.Path(f"{self.path}/snapshots/{name}"), True)
            return False
        for n in [*(f"log/{n}" for n in at.get("before", [])), *([f"snapshots/{at['old']}"] if at.get("old") else [])]:
            self.files.delete(self.hadoop.Path(f"{self.path}/{n}"), True)
        return True

    def _claimed(self, draft, target) -> bool:
        """Move a whole file to a name that must be free."""
        try:
            self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, target, self.spark.sparkContext._gateway.new_array(self.hadoop.Options.Rename, 0))
            return True
        except Exception as e:
            if "AlreadyExists" in str(e) or self.files.exists(target):
                return False
            raise


def newest(rows: DataFrame) -> DataFrame:
    """The row of each key with the latest processed_at, by one aggregate with partial results."""
    rest = [c for c in rows.columns if c not in KEYS]
    order = F.struct("processed_at", -F.xxhash64(*[F.to_json(F.struct(F.col(c))) for c in rest]))
    best = rows.groupBy(*KEYS).agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return best.select(*[F.col(f"_r.{c}").alias(c) if c in rest else F.col(c) for c in rows.columns])
