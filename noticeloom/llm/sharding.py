"""Proportional stratified interleaving of rows into shards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeloom.llm.common import ranked

SEED = "7"
BUCKETS = 4096


def shard(docs: DataFrame, shards: int = 8, seed: str = SEED, key: str = "doc_id", source: str = "source") -> DataFrame:
    """Assign every row of `docs` to a shard so that each shard matches the mixture of sources.

    Rows are shuffled by md5(seed, key) and ranked within their source; a row's fractional rank is
    (rank + 1/2) / rows of the source. Sorting all rows by it interleaves the sources in
    proportion, and the order is cut into `shards` equal runs. Law: row counts differ by one at most.

    Adds shard (int), slot (long, gapless from 0 in each shard) and mix_rank (double); input columns of
    these names are replaced. Null sources form one source of their own; a null key hashes as empty;
    repeated rows are separate rows with adjacent ranks; an empty table gives an empty result. All
    other input columns are kept, whatever their names, so pass only those to be carried: each row is
    shuffled twice.
    """
    names = [c for c in docs.columns if c not in ("shard", "slot", "mix_rank")]
    whole = F.struct(*[F.col(f"`{c}`") for c in names])
    df = docs.select(whole.alias("row"), F.col(f"`{source}`").alias("s"), F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")))).alias("h"))
    df = df.withColumn("x", F.xxhash64("row"))
    high = F.conv(F.substring("h", 1, 3), 16, 10).cast("int")
    sizes = df.groupBy(F.col("s").alias("_s")).agg(F.count(F.lit(1)).alias("n"))
    df = ranked(df, ["s"], [F.col("h"), F.col("x")], "r", high)
    df = df.join(sizes, F.col("s").eqNullSafe(F.col("_s"))).drop("_s")
    df = df.withColumn("mix_rank", (F.col("r") + F.lit(0.5)) / F.col("n"))
    spread = F.least(F.floor(F.col("mix_rank") * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
    df = ranked(df.withColumn("one", F.lit(1)), ["one"], [F.col("mix_rank"), F.col("h"), F.col("x")], "pos", spread)
    total = max(docs.count(), 1)
    which = F.expr(f"cast(pos * {shards} div {total} as int)")
    start = F.expr(f"(shard * {total}L + {shards - 1}) div {shards}")
    df = df.withColumn("shard", which).withColumn("slot", (F.col("pos") - start).cast("long"))
    return df.select(*[F.col(f"row.`{c}`").alias(c) for c in names], "mix_rank", "shard", "slot")


def digest(docs: DataFrame) -> DataFrame:
    """The columns of the sharding contract for all documents in 8 shards (law: rows)."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    slim = docs.select("doc_id", "source", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    return shard(slim, 8).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source"
    )
