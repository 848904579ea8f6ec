"""Mixing sources to target weights by a low-discrepancy schedule of slots, each filled with a block of words."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeloom.llm.common import cut, ranked

SEED = "11"
#: Words of a block; a slot of the mix is one block.
BLOCK = 1024
#: Weights of the sources in code point order, over and over; how often a source may be repeated.
WEIGHTS, REPEATS = (5, 2, 1), 3
BUCKETS = 4096
#: Points are multiples of 2**-40; GOLDEN is the odd number nearest to 2**40 divided by the golden ratio.
BITS, HALF, GOLDEN = 40, 20, 679544240363
#: Cells of the unit interval by which points find their source.
CELLS = 12


def words(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """Add target, the words that each source (source, source_size) should give.

    All sources share the whole size by weight; a source stops at `repeats` times its own size, and the
    others share what it leaves, until none is above. With sources ordered by size over weight, the full
    ones are the first so many, and all others get the same words per weight: one pass over sums finds it.
    The windows hold one row a source.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (place % len(weights) + 1).cast("int")).cast("long")
    out = sizes.withColumn("place", place).withColumn("weight", weight)
    tight = Window.orderBy(F.col("source_size") / F.col("weight"), "place")
    every = Window.partitionBy()
    before = tight.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) - repeats * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    out = out.withColumn("each", left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    out = out.withColumn("full", repeats * F.col("source_size") <= F.col("weight") * F.col("each"))
    level = F.max(F.when(~F.col("full"), F.col("each"))).over(every)
    return out.withColumn("target", F.when(F.col("full"), repeats * F.col("source_size").cast("double")).otherwise(F.col("weight") * level)).select("source", "source_size", "place", "target")


def point(i: Column) -> Column:
    """The i-th multiple of the golden ratio modulo 1, in units of 2**-40, without overflow below 2**40 slots."""
    low, high = i % (1 << HALF), F.shiftright(i, HALF)
    return (low * GOLDEN + ((high * GOLDEN) % (1 << HALF)) * (1 << HALF)) % (1 << BITS)


def schedule(plan: DataFrame, slots: int) -> DataFrame:
    """The mix as slots: position, place (of the source), slot (rank within the source).

    `plan` has a row a source with its place and its number of slots, `slots` in all. Slot i belongs to the
    source in whose stretch of the cumulative shares the i-th multiple of the golden ratio falls, so every
    run of slots is near the target mixture. Points find their source by a join on 4,096 cells of the unit
    interval. A source that got too few slots gets the missing ones at the end, and slots beyond a source's
    number are left out; both are about log(slots) a source. Ranks come by stretches of slots, so that a
    source with most slots is many tasks.
    """
    spark = plan.sparkSession
    upto = F.sum("slots").over(Window.orderBy("place"))
    share = float(1 << BITS) / max(slots, 1)
    ends = plan.where("slots > 0").withColumn("upto", upto).select(
        "place", "slots", F.floor((F.col("upto") - F.col("slots")) * share).alias("from"), F.floor(F.col("upto") * share).alias("to")
    )
    cells = ends.withColumn("cell", F.explode(F.sequence(F.shiftright("from", BITS - CELLS), F.shiftright(F.col("to") - 1, BITS - CELLS))))
    points = spark.range(slots).select(F.col("id").alias("position"), point(F.col("id")).alias("x"))
    points = points.withColumn("cell", F.shiftright("x", BITS - CELLS))
    dealt = points.join(cells, "cell").where("x >= from and x < to").select("position", "place", "slots")
    stretch = F.floor(F.col("position") * (BUCKETS / max(slots, 1)))
    dealt = ranked(dealt, ["place"], [F.col("position")], "slot", stretch).where("slot < slots").select("position", "place", "slot")
    got = dealt.groupBy("place").agg(F.count(F.lit(1)).alias("got"))
    short = plan.join(got, "place", "left").withColumn("got", F.coalesce("got", F.lit(0).cast("long"))).where("got < slots")
    missing = short.select("place", F.explode(F.sequence(F.col("got"), F.col("slots") - 1)).alias("slot"))
    return dealt.unionByName(missing.select((F.col("slot") + slots).alias("position"), "place", "slot"))


class Mix:
    """A mix of all rows of `docs` by `source`.

    Documents are shuffled within their source by md5(seed, key) and laid end to end; the stream is cut
    into blocks of `block` words (the last of a source may be shorter). Slot r of a source takes its block
    r modulo their number, once more from the start when all are used; the source's last slot stops where
    its target, rounded to whole words, is reached. Each source so gives exactly its rounded target, and
    no document more than `repeats` times its size.

    Null texts and texts of white space have size 0: they are never taken. Null sources are a source of
    their own, after all others; a null key hashes as empty; rows of equal key and size are interchangeable
    rows; an empty table gives an empty mix. Other columns than key, text and source are not read.

    rows    row (a number within place), key, source, size, place, source_size, target
    plan    a row a source: place, source_size, target, quota (whole words), blocks, slots
    """

    def __init__(self, docs: DataFrame, weights: Sequence[int] = WEIGHTS, repeats: int = REPEATS, block: int = BLOCK, seed: str = SEED, key: str = "doc_id", text: str = "text", source: str = "source") -> None:
        self.block = block
        key_text = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))
        slim = cut(docs.select(
            F.col(f"`{key}`").alias("key"), F.col(f"`{source}`").alias("source"), words(F.col(f"`{text}`")).alias("size"),
            F.md5(F.concat_ws("|", F.lit(seed), key_text)).alias("h"),
        ))
        sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
        plan = targets(sizes, weights, repeats).withColumn("quota", F.floor(F.col("target") + 0.5))
        plan = plan.withColumn("blocks", F.expr(f"(source_size + {block - 1}) div {block}"))
        rest = F.col("quota") - F.expr("quota div source_size") * F.col("source_size")
        slots = F.expr("quota div source_size") * F.col("blocks") + F.floor((rest + block - 1) / block)
        self.plan = cut(plan.withColumn("slots", F.when(F.col("source_size") > 0, slots).otherwise(0).cast("long")))
        same = F.col("s.source").eqNullSafe(F.col("p.source"))
        rows = slim.alias("s").join(self.plan.alias("p"), same).select("s.key", "s.source", "s.size", "s.h", "p.place", "p.source_size", "p.target", "p.quota")
        bucket = F.conv(F.substring("h", 1, 3), 16, 10).cast("int")
        order = [F.col("h"), F.col("size"), F.col("key")]
        rows = ranked(rows, ["place"], order, "row", bucket).withColumn("bucket", bucket)
        inside = Window.partitionBy("place", "bucket").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
        per = rows.groupBy("place", "bucket").agg(F.sum("size").alias("words"))
        earlier = F.coalesce(F.sum("words").over(Window.partitionBy("place").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        per = per.select("place", "bucket", earlier.alias("start"))
        rows = rows.join(per, ["place", "bucket"]).withColumn("start", F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
        self.rows = cut(rows.drop("h", "bucket"))

    def pieces(self) -> DataFrame:
        """The mix itself: position, place, slot, row, key, from (word of the document), length (words).

        Ordered by position, place and start of the document the pieces are the mixed text.
        """
        b = self.block
        spans = self.rows.where("size > 0").select(
            "place", "row", "key", "start", "size", F.explode(F.sequence(F.expr(f"start div {b}"), F.expr(f"(start + size - 1) div {b}"))).alias("at")
        )
        slots = schedule(self.plan.select("place", "slots"), int(self.plan.agg(F.sum("slots")).first()[0] or 0))
        known = self.plan.select("place", "source_size", "quota", "blocks")
        slots = slots.join(known, "place").withColumn("at", F.expr("slot % blocks"))
        used = F.expr(f"(slot div blocks) * source_size + at * {b}")  # words of the source in its slots before
        slots = slots.select("position", "place", "slot", "at", (F.col("quota") - used + F.col("at") * b).alias("stop"))
        whole = spans.join(slots, ["place", "at"])
        first = F.greatest(F.col("start"), F.col("at") * b)
        last = F.least(F.col("start") + F.col("size"), (F.col("at") + 1) * b, F.col("stop"))
        return whole.select("position", "place", "slot", "row", "key", (first - F.col("start")).alias("from"), (last - first).alias("length")).where("length > 0")


def digest(docs: DataFrame) -> DataFrame:
    """What the mix of all documents takes of each: the columns of the mixing contract."""
    mix = Mix(docs)
    taken = mix.pieces().groupBy("place", "row").agg(F.sum("length").alias("taken"))
    return mix.rows.join(taken, ["place", "row"], "left").select(
        F.col("key").alias("doc_id"), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source"
    )


#: `digest` in closed form: a source's quota runs through its shuffled words again and again.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5('11|' || coalesce(doc_id::VARCHAR, '')) AS h, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source
), w AS (
  SELECT *, [5, 2, 1][1 + place % 3] AS weight FROM s
), e AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE - 3 * coalesce(sum(source_size) OVER t, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER t, 0)) AS each
  FROM w WINDOW t AS (ORDER BY source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (
  SELECT *, 3 * source_size <= weight * each AS full_ FROM e
), p AS (
  SELECT *, CASE WHEN full_ THEN 3 * source_size::DOUBLE ELSE weight * max(CASE WHEN NOT full_ THEN each END) OVER () END AS target FROM f
), x AS (
  SELECT d.*, source_size, target, floor(target + 0.5)::BIGINT AS quota,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, size, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, source, size, source_size, target,
  CASE WHEN source_size = 0 THEN 0 ELSE (quota // source_size) * size + greatest(0, least(size, quota % source_size - start)) END::BIGINT AS taken
FROM x
"""
