"""Registered queries over notice records made of orders: filters, exports, keys, merging, facets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeloom.functions import second_reading
from noticeloom.operators import inspect, records
from noticeloom.plans import run_queue
from noticeloom.plans.catalogue import query, table
from noticeloom.plans.notices import REGIONS
from noticeloom.sources import sinks
from noticeloom.sources.store import Store, scratch

TYPES = ["INCORPORATION", "DISSOLUTION", "SHARE_TRANSFER", "ODD_KIND_OF_EVENT"]
#: One row per order, as SQL for both engines: the scalars that records are made of.
MADE = """SELECT o_orderkey AS k, c_custkey AS ck, c_name AS name, n_name AS nation, o_orderpriority AS priority, o_orderstatus AS status,
  CASE o_orderkey % 4 WHEN 0 THEN 'INCORPORATION' WHEN 1 THEN 'DISSOLUTION' WHEN 2 THEN 'SHARE_TRANSFER' ELSE 'ODD_KIND_OF_EVENT' END AS kind,
  CAST(30 + o_orderkey % 71 AS DOUBLE) / 100 AS confidence, o_orderkey % 3 = 0 AS review, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE concat(CAST(o_orderkey AS STRING), 'P') END AS reference
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""
MADE_SQL = MADE.replace("AS STRING", "AS VARCHAR")


def made(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """Records of orders: every field follows from the row's scalars (k, ck, name, nation, ...).

    dealt: to every core, where more work follows than the few files of the tables have tasks for.
    """
    nations = table(spark, sf_dir, "nation").withColumn("city", F.initcap("n_name"))  # once a nation, not once a record
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    head = MADE.split(" FROM orders")[0].removeprefix("SELECT ").rstrip()
    rows = o.selectExpr(*split(head), "city")
    if dealt:
        rows = rows.repartition(spark.sparkContext.defaultParallelism, "k")
    null, text = F.lit(None).cast("string"), lambda c: F.col(c).cast("string")
    k = F.col("k")
    pages = F.when(k % 2 == 0, F.array(k.cast("int"))).otherwise(F.array(k.cast("int"), (k + 1).cast("int")))
    side = lambda c: c.cast("double")
    region = lambda page, left: F.struct(page.cast("int").alias("page"), F.lit(1).alias("column"), side(left).alias("left"), side(k % 7 * 10).alias("right"), F.lit(700.0).alias("top"), F.lit(20.0).alias("bottom"), F.lit(3).alias("line_count"))
    regions = F.when(k % 6 == 0, F.array().cast(REGIONS)).otherwise(F.array(region(k, k % 5 * 10), region(k + 1, F.lit(0))).cast(REGIONS))
    source = F.struct(
        F.lit("BOAL").alias("series"), (k % 9 + 5900).cast("string").alias("issue_number"), F.lit("2026-04-29").alias("publication_date"), null.alias("pdf_path"), F.concat(F.lit("https://x/"), k.cast("string")).alias("source_url"),
        F.lit("pdf-text-layer").alias("extraction_engine"), pages.alias("pdf_pages"), F.array(k.cast("string")).alias("printed_pages"), F.col("reference").alias("notice_reference"), (k % 8 == 0).alias("notice_reference_inferred"), regions.alias("regions"))
    cities = F.when(k % 10 == 0, F.array().cast("array<string>")).otherwise(F.array("city", F.lit("Settat")))
    company = F.struct(F.when(k % 11 != 0, F.col("name")).alias("name"), F.lit("SARL").alias("legal_form"), text("ck").alias("commercial_register_number"), F.when(k % 3 == 0, F.concat(F.lit("rue, \"B\" "), F.col("nation"))).alias("registered_address"), cities.alias("cities_mentioned"))
    event = F.struct(
        F.col("kind").alias("primary_type"), F.array("kind", F.lit("CAPITAL_CHANGE")).alias("types"), F.lit("2026-01-02").alias("decision_date"), null.alias("effective_date"), F.lower("priority").alias("business_purpose"), (k * 10).alias("capital_mad"),
        null.alias("branch_address"), F.when(k % 4 == 1, F.lit("م 1")).otherwise(F.lit("سليم")).alias("manager_or_liquidator"), F.struct(F.lit("court").alias("court"), null.alias("date"), text("k").alias("number")).alias("filing"))
    reasons = F.array_compact(F.array(F.when(F.col("review"), "city_not_detected"), F.when(k % 7 == 0, "source_text_has_unmapped_glyphs"), F.when(k % 13 == 0, "event_date_missing")))
    return rows.select("k", F.lit("1.0.0").alias("schema_version"), source.alias("source"), company.alias("company"), event.alias("event"), "confidence", F.col("review").alias("needs_review"), reasons.alias("review_reasons"),
                       F.when(k % 2 == 0, F.lit("شركة")).otherwise(F.lit("plain")).alias("raw_text"), F.struct(F.when(k % 9 == 0, "complete").otherwise("failed").alias("status"), F.lit(61.5).alias("confidence"), F.lit("t").alias("processed_at"), F.lit("o").alias("text")).alias("ocr"))


def split(head: str) -> list[str]:
    """Top-level comma-separated expressions of a SELECT list."""
    out, depth = [""], 0
    for c in head:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


def chosen(spark: SparkSession, sf_dir: str, **given: str) -> DataFrame:
    return records.select(made(spark, sf_dir), records.Query.of(given)).select("k")


@query(f"SELECT k FROM ({MADE_SQL}) WHERE kind = 'DISSOLUTION'")
def select_event(spark, sf_dir):
    return chosen(spark, sf_dir, event="dissolution")


@query(f"SELECT k FROM ({MADE_SQL})")
def select_any_type(spark, sf_dir):
    return chosen(spark, sf_dir, event="capital_CHANGE")


@query(f"SELECT k FROM ({MADE_SQL}) WHERE k % 11 <> 0 AND contains(lower(name), 'er#00000012')")
def select_company(spark, sf_dir):
    return chosen(spark, sf_dir, company="ER#00000012")


@query(f"SELECT k FROM ({MADE_SQL}) WHERE k % 10 <> 0 AND lower(nation) = 'nation_1'")
def select_city(spark, sf_dir):
    return chosen(spark, sf_dir, city=" NATION_1 ")


@query(f"SELECT k FROM ({MADE_SQL}) WHERE review")
def select_review(spark, sf_dir):
    return chosen(spark, sf_dir, needs_review="yes")


@query(f"SELECT k FROM ({MADE_SQL}) WHERE NOT review AND confidence >= 0.85 AND kind = 'INCORPORATION' AND k % 10 <> 0")
def select_conjunction(spark, sf_dir):
    return chosen(spark, sf_dir, needs_review="0", min_confidence="0.85", event="incorporation", city="settat")


@query(f"SELECT k FROM ({MADE_SQL}) WHERE contains(concat_ws(' ', CASE WHEN k % 11 <> 0 THEN lower(name) END, CAST(ck AS VARCHAR), CASE WHEN k % 3 = 0 THEN concat('rue, \"b\" ', lower(nation)) END, lower(kind), lower(priority), CASE WHEN k % 4 = 1 THEN 'م 1' ELSE 'سليم' END), 'odd_kind_of_event 1-urgent')")
def select_text(spark, sf_dir):
    return chosen(spark, sf_dir, q="Odd_Kind_of_Event 1-URGENT")


@query(f"SELECT k FROM ({MADE_SQL}) WHERE k % 10 = 0 AND review")
def listed_unknown_city(spark, sf_dir):
    return records.listed(made(spark, sf_dir), city=records.UNKNOWN_CITY, review="review").select("k")


@query(f"SELECT k FROM ({MADE_SQL}) WHERE kind = 'SHARE_TRANSFER' AND NOT review AND reference IS NOT NULL AND k % 10 <> 0 AND contains(concat(' ', lower(reference)), '7p')")
def listed_records(spark, sf_dir):
    return records.listed(made(spark, sf_dir), "Settat", "SHARE_TRANSFER", "ready", " 7P ").select("k")


@query(f"SELECT DISTINCT kind AS value, CASE kind WHEN 'INCORPORATION' THEN 'Incorporation' WHEN 'DISSOLUTION' THEN 'Dissolution' WHEN 'SHARE_TRANSFER' THEN 'Share transfer' ELSE 'Odd Kind Of Event' END AS label FROM ({MADE_SQL})")
def event_labels(spark, sf_dir):
    return records.event_facet(made(spark, sf_dir))


@query(f"SELECT value, count(*) AS n FROM (SELECT unnest(CASE WHEN k % 10 = 0 THEN ['not detected'] ELSE [concat(upper(left(nation, 1)), lower(substr(nation, 2))), 'Settat'] END) AS value FROM ({MADE_SQL}) WHERE NOT contains(nation, ' ')) GROUP BY value")
def city_facets(spark, sf_dir):
    return records.city_facet(one_word(spark, sf_dir))


def one_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of nations named by one word (initcap of several words is no plain SQL)."""
    plain = table(spark, sf_dir, "nation").where("n_name NOT LIKE '% %'").join(table(spark, sf_dir, "customer"), F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("c_custkey").cast("string").alias("ck"))
    return made(spark, sf_dir).join(plain, F.col("company.commercial_register_number") == F.col("ck"), "left_semi")


@query(f"""SELECT count(*) AS records, count(*) FILTER (WHERE review) AS records_needing_review, count(*) FILTER (WHERE k % 2 = 1) AS multi_page, count(*) FILTER (WHERE k % 8 = 0) AS inferred_references,
  count(*) FILTER (WHERE reference IS NULL) AS records_without_notice_reference, count(*) FILTER (WHERE k % 9 = 0) AS records_with_ocr FROM ({MADE_SQL})""")
def summary_counts(spark, sf_dir):
    return records.summary(made(spark, sf_dir))


FLAT_SQL = """CASE WHEN k % 11 <> 0 THEN name END AS company_name, 'SARL' AS legal_form, CAST(ck AS VARCHAR) AS commercial_register_number, CASE WHEN k % 3 = 0 THEN concat('rue, "B" ', nation) END AS registered_address,
  kind AS event_type, concat(kind, '|CAPITAL_CHANGE') AS event_types, '2026-01-02' AS decision_date, CAST(NULL AS VARCHAR) AS effective_date, lower(priority) AS business_purpose, CAST(k * 10 AS VARCHAR) AS capital_mad, CAST(NULL AS VARCHAR) AS branch_address,
  CASE WHEN k % 4 = 1 THEN 'م 1' ELSE 'سليم' END AS manager_or_liquidator, 'court' AS filing_court, CAST(NULL AS VARCHAR) AS filing_date, CAST(k AS VARCHAR) AS filing_number, CAST(k % 9 + 5900 AS VARCHAR) AS issue_number, '2026-04-29' AS publication_date,
  CASE WHEN k % 2 = 0 THEN CAST(k AS VARCHAR) ELSE concat(k, '|', k + 1) END AS pdf_pages, CAST(k AS VARCHAR) AS printed_pages, reference AS notice_reference, concat('https://x/', k) AS source_url, CAST(review AS VARCHAR) AS needs_review,
  concat_ws('|', CASE WHEN review THEN 'city_not_detected' END, CASE WHEN k % 7 = 0 THEN 'source_text_has_unmapped_glyphs' END, CASE WHEN k % 13 = 0 THEN 'event_date_missing' END) AS review_reasons"""


@query(f"SELECT {FLAT_SQL}, confidence FROM ({MADE_SQL})")
def flat_csv(spark, sf_dir):
    """The 25 columns; city names are compared by city_facets, as their case is no plain SQL."""
    d = records.flat(made(spark, sf_dir))
    assert len(d.columns) == 25
    return d.drop("cities_mentioned").withColumn("confidence", F.col("confidence").cast("double"))


@query(f"""SELECT {FLAT_SQL}, confidence, CAST(k % 8 = 0 AS VARCHAR) AS notice_reference_inferred, 'pdf-text-layer' AS extraction_engine, CASE WHEN k % 9 = 0 THEN 'complete' ELSE 'failed' END AS ocr_status, '61.5' AS ocr_confidence,
  't' AS ocr_processed_at, 'o' AS ocr_text, CASE WHEN k % 2 = 0 THEN 'شركة' ELSE 'plain' END AS raw_text FROM ({MADE_SQL})""")
def flat_browser(spark, sf_dir):
    d = records.flat(made(spark, sf_dir), browser=True)
    assert len(d.columns) == 32
    return d.drop("cities_mentioned").withColumn("confidence", F.col("confidence").cast("double"))


VALID = "CASE WHEN k % 6 = 0 THEN 0 ELSE CAST(k % 7 * 10 > k % 5 * 10 AS INTEGER) + CAST(k % 7 > 0 AS INTEGER) END"


@query(f"SELECT k, {VALID} AS valid, CASE WHEN k % 6 = 0 THEN 1 + k % 2 ELSE 2 END AS slices, k % 6 <> 0 AS by_region, k + CASE WHEN k % 6 = 0 THEN k % 2 ELSE 1 END AS last_page FROM ({MADE_SQL})")
def region_slices(spark, sf_dir):
    slices = records.source_slices(F.col("source.regions"), F.col("source.pdf_pages"))
    d = made(spark, sf_dir).select("k", F.size(records.valid_regions(F.col("source.regions"))).alias("valid"), slices.alias("s"))
    return d.select("k", "valid", F.size("s").cast("long").alias("slices"), F.exists("s", lambda x: x["region"].isNotNull()).alias("by_region"), F.array_max(F.transform("s", lambda x: x["page"])).cast("long").alias("last_page"))


@query(f"SELECT k FROM ({MADE_SQL}) WHERE k % 9 <> 0 AND {VALID} > 0 AND (k % 7 = 0 OR k % 2 = 0)")
def second_reading_needed(spark, sf_dir):
    return made(spark, sf_dir).where(records.needs_second_reading()).select("k")


@query(f"SELECT k, concat(coalesce(reference, ''), '|', CASE WHEN k % 2 = 0 THEN CAST(k AS VARCHAR) ELSE concat(k, '-', k + 1) END, '|', CASE WHEN k % 11 <> 0 THEN name ELSE '' END) AS record_key, concat('v1|a.pdf|', k, '||', k % 9 + 5900) AS document_key FROM ({MADE_SQL})")
def cache_keys(spark, sf_dir):
    doc = records.document_key(F.lit("a.pdf"), F.col("k"), F.lit(None).cast("string"), F.col("source.issue_number"))
    return made(spark, sf_dir).select("k", records.record_key().alias("record_key"), doc.alias("document_key"))


def store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored results: two for each multiple of 3, the later one last in time."""
    keyed = made(spark, sf_dir).where("k % 3 = 0").select(records.record_key().alias("record_key"), "k")
    return keyed.select("record_key", F.explode(F.array(F.lit(1), F.lit(2))).alias("n"), "k").select("record_key", F.concat(F.lit("2026-01-0"), F.col("n").cast("string")).alias("processed_at"), F.struct((F.col("k") * 10 + F.col("n")).alias("value")).alias("ocr"))


@query(f"SELECT k, CASE WHEN k % 3 = 0 THEN k * 10 + 2 END AS restored FROM ({MADE_SQL})")
def restored_results(spark, sf_dir):
    return sinks.restore(made(spark, sf_dir), store(spark, sf_dir), records.record_key()).select("k", F.col("ocr.value").alias("restored"))


@query(f"SELECT k FROM ({MADE_SQL}) WHERE k % 3 <> 0")
def pending_results(spark, sf_dir):
    return sinks.pending(made(spark, sf_dir), store(spark, sf_dir), records.record_key()).select("k")


@query(f"SELECT k FROM ({MADE_SQL}) WHERE (k % 11 <> 0 AND name = 'Customer#000000007') OR reference IN ('33P', '64P', '96P')")
def targeted_records(spark, sf_dir):
    return records.targeted(made(spark, sf_dir), ["Customer#000000007", "33P", "64P", "96P"]).select("k")


def second(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with a second reading: prose anew, a register number, a person; one in five has none."""
    k, text = F.col("k"), lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    null = F.lit(None).cast("string")
    fields = F.struct(
        F.col("company.name").alias("name"), F.lit("SA").alias("legal_form"), F.lit("999").alias("commercial_register_number"), text("voie ", k.cast("string")).alias("registered_address"), F.lit("DISSOLUTION").alias("primary_type"), F.lit("2026-09-09").alias("decision_date"),
        F.lit("  ").alias("business_purpose"), F.lit(5).cast("long").alias("capital_mad"), F.when(k % 2 == 0, text("zone ", k.cast("string"), " شارع ab")).alias("branch_address"), F.lit("منير").alias("manager_or_liquidator"), null.alias("court"), F.lit("2026-08-08").alias("filing_date"), F.lit("7").alias("filing_number"))
    reading = F.struct(F.lit("complete").alias("status"), (k % 101).cast("double").alias("confidence"), F.lit("t").alias("processed_at"), F.lit("بالرباط").alias("text"), fields.alias("fields"))
    return made(spark, sf_dir, dealt=True).withColumn("ocr", F.when(k % 5 != 0, reading))


@query(f"""SELECT k, CASE WHEN k % 5 <> 0 THEN concat('voie ', k) WHEN k % 3 = 0 THEN concat('rue, "B" ', nation) END AS address, 'SARL' AS form, lower(priority) AS purpose, CASE WHEN k % 5 <> 0 AND k % 2 = 0 THEN concat('zone ', k, ' شارع ab') END AS branch,
  CASE WHEN k % 4 <> 1 THEN 'سليم' WHEN k % 5 <> 0 THEN 'منير' ELSE 'م 1' END AS manager, CASE WHEN k % 5 <> 0 THEN '2026-08-08' END AS filed, CAST(k AS VARCHAR) AS filing_number, k * 10 AS capital,
  CASE WHEN k % 5 <> 0 THEN concat_ws('|', CASE WHEN k % 7 = 0 AND k % 101 < 55 THEN 'source_text_has_unmapped_glyphs' END, CASE WHEN k % 101 < 55 THEN 'ocr_confidence_low' END, 'ocr_filing_date_needs_review', CASE WHEN k % 10 = 0 THEN 'ocr_city_detection_needs_review' END, CASE WHEN k % 2 = 0 THEN 'ocr_branch_address_needs_review' END)
    ELSE concat_ws('|', CASE WHEN review THEN 'city_not_detected' END, CASE WHEN k % 7 = 0 THEN 'source_text_has_unmapped_glyphs' END, CASE WHEN k % 13 = 0 THEN 'event_date_missing' END) END AS reasons,
  CASE WHEN k % 5 = 0 THEN confidence WHEN k % 101 >= 75 THEN greatest(confidence, 0.85::DOUBLE) WHEN k % 101 >= 55 THEN greatest(confidence, 0.82::DOUBLE) ELSE confidence END AS confidence FROM ({MADE_SQL})""")
def merged_readings(spark, sf_dir):
    d = second_reading.merge(second(spark, sf_dir))
    return d.select("k", F.col("company.registered_address").alias("address"), F.col("company.legal_form").alias("form"), F.col("event.business_purpose").alias("purpose"), F.col("event.branch_address").alias("branch"), F.col("event.manager_or_liquidator").alias("manager"),
                    F.col("event.filing.date").alias("filed"), F.col("event.filing.number").alias("filing_number"), F.col("event.capital_mad").alias("capital"), F.array_join("review_reasons", "|").alias("reasons"), "confidence")


@query(f"""SELECT k, CASE WHEN k % 5 <> 0 AND (k % 3 <> 0 OR length(concat('voie ', k)) < length(concat('rue, "B" ', nation)) * 1.6) THEN concat('voie ', k) WHEN k % 3 = 0 THEN concat('rue, "B" ', nation) END AS address,
  CASE WHEN k % 5 <> 0 AND k % 2 = 0 THEN concat('zone ', k, ' شارع ab') END AS branch, 'court' AS court, CASE WHEN k % 5 <> 0 THEN '2026-08-08' END AS filed, k % 7 = 0 OR k % 10 = 0 AND review OR confidence < 0.85 AS needs_review,
  concat_ws('|', CASE WHEN k % 10 = 0 AND review THEN 'city_not_detected' END, CASE WHEN k % 7 = 0 THEN 'source_text_has_unmapped_glyphs' END) AS reasons, confidence FROM ({MADE_SQL})""")
def enhanced_records(spark, sf_dir):
    d = second_reading.enhance(second(spark, sf_dir).withColumn("second", F.col("ocr.fields")), "second")
    return d.select("k", F.col("company.registered_address").alias("address"), F.col("event.branch_address").alias("branch"), F.col("event.filing.court").alias("court"), F.col("event.filing.date").alias("filed"), "needs_review", F.array_join("review_reasons", "|").alias("reasons"), "confidence")


# --- diagnostics ----------------------------------------------------------------------------------


@query("""SELECT conv_id, turn, concat('c', turn) AS marker, array_to_string(list(coalesce(text, '')) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), '~') AS context FROM conversations QUALIFY role = 'assistant'""")
def marker_contexts(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("marker", F.when(F.col("role") == "assistant", F.concat(F.lit("c"), F.col("turn").cast("string"))))
    d = inspect.marker_context(c, ["conv_id"], "turn", "marker", "text", 2, 2)
    return d.select("conv_id", "turn", "marker", F.array_join("context", "~").alias("context"))


@query("SELECT event_id, last_value(CASE WHEN event_id % 4 = 0 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS font FROM events")
def carried_values(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("set", F.when(F.col("event_id") % 4 == 0, F.col("event_type")))
    return inspect.carried(e, ["user_id"], "event_id", "set", "font").select("event_id", "font")


@query("""SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) JOIN
  (SELECT user_id, min(n) AS hit FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE event_type = 'purchase' GROUP BY user_id) USING (user_id) WHERE n BETWEEN hit - 8 AND hit + 11""")
def around_first_match(spark, sf_dir):
    return inspect.around_first(table(spark, sf_dir, "events"), ["user_id"], "event_id", F.col("event_type") == "purchase").select("user_id", "event_id")


@query("SELECT conv_id, min(turn) AS segment FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def notice_of_reference(spark, sf_dir):
    s = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("issue"), F.col("turn").alias("segment"), F.col("role").alias("reference"))
    return inspect.notice(s, "assistant").select(F.col("issue").alias("conv_id"), "segment")


@query("""SELECT o_orderkey, concat(strftime(CAST(o_orderdate AS DATE) + INTERVAL 240 MONTH, '%Y-%m-%d'), '|', strftime(CAST(o_orderdate AS DATE) + INTERVAL 240 MONTH, '%d/%m/%Y')) AS dates, concat('RC ', o_custkey + 100000, ' 12') AS said FROM orders""")
def exact_dates(spark, sf_dir):
    day = F.add_months(F.col("o_orderdate").cast("date"), 240)
    said = F.concat(F.lit("RC "), (F.col("o_custkey") + 100000).cast("string"), F.lit(" 12"))
    body = F.concat_ws(" x ", F.date_format(day, "yyyy-MM-dd"), F.date_format(day, "dd/MM/yyyy"), F.date_format(day, "yyyy-MM-dd"))
    d = table(spark, sf_dir, "orders").select("o_orderkey", inspect.exact_tokens(body).alias("t"), said.alias("said"), inspect.exact_tokens(said).alias("u"))
    return d.select("o_orderkey", F.array_join("t.dates", "|").alias("dates"), F.concat(F.lit("RC "), F.array_join("u.numbers", " ")).alias("said"))


# --- stored results -------------------------------------------------------------------------------


@query("""SELECT concat('d', o_custkey % 20) AS document_key, CAST(o_orderkey AS VARCHAR) AS record_key, CASE WHEN o_orderkey % 3 = 0 THEN -1 WHEN o_orderkey % 5 = 0 THEN -2 ELSE o_custkey END AS value,
  CASE WHEN o_orderkey % 3 = 0 THEN '2026-01-03' WHEN o_orderkey % 5 = 0 THEN '2026-01-02' ELSE '2026-01-01' END AS at FROM orders""")
def stored_results(spark, sf_dir):
    """Results of all orders written three times, the newest last but one, with a compaction between: what
    the store gives back."""
    results = Store(spark, scratch(spark, "store"), run_queue.schema("struct<value:bigint>"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("value"), F.concat(F.lit("d"), (F.col("o_custkey") % 20).cast("string")).alias("document_key"), F.col("o_orderkey").cast("string").alias("record_key"))

    def put(rows, at):
        results.put(rows.select("document_key", "record_key", F.lit(at).cast("timestamp").alias("processed_at"), F.lit(1).alias("attempt"), F.struct(F.col("value").cast("long").alias("value")).alias("ocr"), F.lit(None).cast("string").alias("error")))

    put(orders, "2026-01-01")
    put(orders.where("o_orderkey % 3 = 0").withColumn("value", F.lit(-1)), "2026-01-03")
    results.compact()
    put(orders.where("o_orderkey % 5 = 0").withColumn("value", F.lit(-2)), "2026-01-02")
    return results.load().select("document_key", "record_key", F.col("ocr.value").alias("value"), F.date_format("processed_at", "yyyy-MM-dd").alias("at"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey * 2 WHEN c_custkey % 2 = 0 THEN c_custkey * 3 END AS value, CASE WHEN c_custkey % 14 = 7 THEN 'ValueError: odd' END AS error, CASE WHEN c_custkey % 7 = 0 THEN 2 ELSE 1 END AS attempt FROM customer""")
def run_results(spark, sf_dir):
    """Two runs over all customers, the second over what the first failed on: results, errors, attempts."""
    results = Store(spark, scratch(spark, "runs"), run_queue.schema("struct<value:bigint>"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("document_key"), F.col("c_custkey").cast("string").alias("record_key"))

    def first(r: dict) -> dict:
        if r["c_custkey"] % 7 == 0:
            raise ValueError("seven")
        return {"value": r["c_custkey"] * 2}

    def second(r: dict) -> dict:
        if r["c_custkey"] % 2:
            raise ValueError("odd")
        return {"value": r["c_custkey"] * 3}

    for recognise in (first, second):
        run_queue.Run(results, "struct<value:bigint>", waves=2).go(rows, ["c_custkey"], recognise)
    return run_queue.restored(rows, results).select("c_custkey", F.col("ocr.value").alias("value"), "error", "attempt")
