"""Registered queries over the standard tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noticeloom.functions import extract, rules, second_reading, text
from noticeloom.operators import layout, records, segment
from noticeloom.plans import notices

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL if there is one."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- a generic rule pack over documents --------------------------------------------------------

GENERIC = rules.RulePack(
    "js",
    {"LICENCE": [r"released under", r"licen[cs]e"], "CONTACT": [r"[a-z0-9.]+@[a-z0-9.]+", r"555-[0-9]{4}"], "SECRET": [r"password", r"token", r"secret"], "SHOUTING": [r"!!"]},
    {"first": [r"src0"], "teen": [r"src1[0-9]"]},
    [],
    [],
    (("LICENCE", "CONTACT"),),
)
GENERIC_SQL = """
  SELECT doc_id, text, source, n_chars,
    regexp_matches(lower(text), 'released under|licen[cs]e') AS lic,
    regexp_matches(lower(text), '[a-z0-9.]+@[a-z0-9.]+|555-[0-9]{4}') AS con,
    regexp_matches(lower(text), 'password|token|secret') AS sec,
    contains(text, '!!') AS sho
  FROM documents"""
TYPES_SQL = "concat_ws('|', CASE WHEN lic THEN 'LICENCE' END, CASE WHEN con AND NOT lic THEN 'CONTACT' END, CASE WHEN sec THEN 'SECRET' END, CASE WHEN sho THEN 'SHOUTING' END)"


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("low", F.lower("text"))
    return extract.settled(d.withColumn("types", extract.event_types(F.col("low"), GENERIC)).drop("low"), "types")


@query(f"SELECT doc_id, {TYPES_SQL} AS types FROM ({GENERIC_SQL}) WHERE {TYPES_SQL} <> ''")
def classify_docs(spark, sf_dir):
    return classified(spark, sf_dir).where(F.size("types") > 0).select("doc_id", F.array_join("types", "|").alias("types"))


@query(f"SELECT doc_id, split_part({TYPES_SQL}, '|', 1) AS category FROM ({GENERIC_SQL}) WHERE {TYPES_SQL} <> ''")
def primary_category(spark, sf_dir):
    return classified(spark, sf_dir).where(F.size("types") > 0).select("doc_id", F.col("types")[0].alias("category"))


@query("""SELECT doc_id, concat_ws('|', CASE WHEN contains(lower(text), 'the') THEN 'LICENCE' END, CASE WHEN contains(lower(text), ' de ') THEN 'SECRET' END, CASE WHEN contains(lower(text), ' in') AND NOT contains(lower(text), 'the') THEN 'CONTACT' END) AS kept, contains(lower(text), 'the') AND contains(lower(text), ' in') AS suppressed FROM documents""")
def suppressed_category(spark, sf_dir):
    """A type that another one drops wherever both rules match."""
    common = rules.RulePack("js", {"LICENCE": ["the"], "SECRET": [" de "], "CONTACT": [" in"]}, {}, [], [], (("LICENCE", "CONTACT"),))
    free = rules.RulePack("js", common.events, {}, [], [], ())
    low = F.lower("text")
    both = lambda t: F.array_contains(t, "LICENCE") & F.array_contains(t, "CONTACT")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(extract.event_types(low, common), "|").alias("kept"), both(extract.event_types(low, free)).alias("suppressed"))


@query("SELECT doc_id, CASE WHEN source = 'src0' THEN 'first' ELSE 'teen' END AS place FROM documents WHERE regexp_matches(source, 'src0|src1[0-9]')")
def source_any_match(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("places", extract.cities(F.col("source"), GENERIC))
    return d.where(F.size("places") > 0).select("doc_id", F.col("places")[0].alias("place"))


@query("""SELECT doc_id, trim(regexp_replace(lower(translate(translate(text, 'éèêàçñóíäöüß', 'éèêàçñóíäöüß'), chr(9), ' ')), '[ \\n\\r\\t]+', ' ', 'g')) AS folded,
  CAST(len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS INTEGER) AS n_lines FROM documents""")
def fold_lines(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", text.normalise(F.col("text")).alias("t"))
    return d.select("doc_id", text.fold(F.col("t")).alias("folded"), F.size(text.lines_of(F.col("t"))).alias("n_lines"))


@query("""SELECT doc_id, CAST(floor(1000.0::DOUBLE * length(regexp_replace(text, '[^\\p{Lu}]', '', 'g')) / length(regexp_replace(text, '[^\\p{L}]', '', 'g')) + 1e-9) AS BIGINT) AS permille
  FROM documents WHERE length(regexp_replace(text, '[^\\p{L}]', '', 'g')) > 0""")
def uppercase_ratio(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("r", text.uppercase_ratio(F.col("text"))).where("r IS NOT NULL")
    # the ratio is a double; the smallest step of 1 in 20,000 letters is far over its error
    return d.select("doc_id", F.floor(F.col("r") * 1000 + 1e-9).cast("long").alias("permille"))


POINTS_SQL = """SELECT d.doc_id, 30 + CASE WHEN d.n_chars >= 100 THEN 25 ELSE 0 END + CASE WHEN l.quality = 1 THEN 15 ELSE 0 END + CASE WHEN d.lang = 'en' THEN 10 ELSE 0 END
  + CASE WHEN d.lic THEN 10 ELSE 0 END + CASE WHEN d.con THEN 5 ELSE 0 END + CASE WHEN d.sec THEN 5 ELSE 0 END - CASE WHEN d.sho THEN 10 ELSE 0 END AS p,
  concat_ws('|', CASE WHEN d.n_chars < 100 THEN 'text_short' END, CASE WHEN l.quality IS NULL THEN 'label_missing' END, CASE WHEN d.sho THEN 'shouting' END) AS reasons
  FROM (SELECT g.*, o.lang FROM (""" + GENERIC_SQL + """) g JOIN documents o USING (doc_id)) d LEFT JOIN labels l ON d.doc_id = l.doc_id"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("low", F.lower("text"))
    hits = F.struct(*[extract.any_match(F.col("low"), patterns, "js").alias(k) for k, patterns in GENERIC.events.items()])
    d = extract.settled(d.select("doc_id", "source", "n_chars", "lang", hits.alias("has")), "has").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    has = lambda k: F.col(f"has.{k}")
    p = notices.points(F.col("n_chars") >= 100, F.col("quality") == 1, F.col("lang") == "en", has("LICENCE"), has("CONTACT"), has("SECRET"), has("SHOUTING"))
    r = notices.reasons([(F.col("n_chars") < 100, "text_short"), (F.col("quality").isNull(), "label_missing"), (has("SHOUTING"), "shouting")])
    return d.select("doc_id", "source", "n_chars", p.alias("p"), r.alias("review_reasons"))


@query(f"SELECT doc_id, p / 100.0::DOUBLE AS confidence, (reasons <> '' OR p < 85) AS needs_review FROM ({POINTS_SQL})")
def confidence_points(spark, sf_dir):
    return scored(spark, sf_dir).select("doc_id", (F.col("p") / 100).alias("confidence"), ((F.size("review_reasons") > 0) | (F.col("p") < 85)).alias("needs_review"))


@query(f"SELECT doc_id, reasons FROM ({POINTS_SQL})")
def review_reasons_flat(spark, sf_dir):
    return scored(spark, sf_dir).select("doc_id", F.array_join("review_reasons", "|").alias("reasons"))


@query(f"SELECT count(*) AS records, count(*) FILTER (WHERE reasons <> '' OR p < 85) AS needs_review FROM ({POINTS_SQL})")
def review_summary(spark, sf_dir):
    return scored(spark, sf_dir).agg(F.count(F.lit(1)).alias("records"), F.count_if((F.size("review_reasons") > 0) | (F.col("p") < 85)).alias("needs_review"))


@query("SELECT doc_id, right(text, 200) AS tail, length(text) > 200 AS trimmed FROM documents")
def truncate_tail(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.right("text", F.lit(200)).alias("tail"), (F.length("text") > 200).alias("trimmed"))


@query("SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE contains(lower(concat_ws(' ', nullif(c_name, ''), nullif(n_name, ''))), 'er#00000012')")
def search_contains(spark, sf_dir):
    d = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return d.where(records.holds(records.search_text(("c_name", "n_name")), "ER#00000012")).select("c_custkey")


@query("SELECT doc_id, source FROM documents ORDER BY n_chars DESC, doc_id LIMIT 100 OFFSET 40")
def page_of_records(spark, sf_dir):
    q = records.Query.of({"offset": "40"})
    return records.page(table(spark, sf_dir, "documents"), [F.col("n_chars").desc(), "doc_id"], q.limit, q.offset).select("doc_id", "source")


@query("SELECT count(*) AS total FROM documents WHERE lower(source) = 'src3' AND contains(lower(text), 'the')")
def pagination_total(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where((F.lower("source") == "src3") & records.holds("text", "The"))
    return d.agg(F.count(F.lit(1)).alias("total"))


@query(f"""SELECT value, count(*) AS n FROM (SELECT unnest(CASE WHEN {TYPES_SQL} = '' THEN ['not detected'] ELSE string_split({TYPES_SQL}, '|') END) AS value FROM ({GENERIC_SQL})) GROUP BY value""")
def facet_counts(spark, sf_dir):
    return records.facets(classified(spark, sf_dir), "types")


# --- segments over conversations: an assistant turn ends a segment ------------------------------


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.withColumn("marker", F.when(F.col("role") == "assistant", F.concat_ws(":", "conv_id", "turn")))


SEG = """SELECT *, coalesce(count(*) FILTER (WHERE role = 'assistant') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS segment FROM conversations"""
SEG_OUT = "SELECT conv_id, segment, max(CASE WHEN role = 'assistant' THEN concat(conv_id, ':', turn) END) AS reference, string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE role <> 'assistant' AND trim(text) <> '') AS text FROM (" + SEG + ") GROUP BY conv_id, segment"


@query(f"SELECT * FROM ({SEG_OUT}) WHERE text IS NOT NULL AND reference IS NOT NULL")
def segment_conversations(spark, sf_dir):
    return segment.by_marker(turns(spark, sf_dir), "conv_id", "turn", "marker", "text").select("conv_id", "segment", "reference", "text")


@query(f"SELECT * FROM ({SEG_OUT}) WHERE text IS NOT NULL")
def segment_trailing(spark, sf_dir):
    return segment.by_marker(turns(spark, sf_dir), "conv_id", "turn", "marker", "text", trailing=True).select("conv_id", "segment", "reference", "text")


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def segment_text(spark, sf_dir):
    e = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(e, lambda x: x["text"]), "\n").alias("text"))


RUNS = """SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity, sum(c) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING) AS run FROM
  (SELECT *, CASE WHEN lag(l_returnflag) OVER w IS DISTINCT FROM l_returnflag AND row_number() OVER w > 1 THEN 1 ELSE 0 END AS c FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey))"""


TASK_ROWS = 250_000


@query(f"SELECT l_orderkey, CAST(run AS BIGINT) AS run, l_returnflag, count(*) AS n, min(l_quantity) AS low, max(l_quantity) AS high FROM ({RUNS}) GROUP BY ALL")
def consecutive_runs(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    # a task sorts about as many rows however large the table is
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), lines.count() // TASK_ROWS + 1)
    d = segment.runs(lines.repartition(parts, "l_orderkey"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], ["l_returnflag"])
    return d.groupBy("l_orderkey", "run", "l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"))


@query("SELECT conv_id, turn, lag(role) OVER w AS before, lead(role) OVER w AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def prev_next_context(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lag("role").over(w).alias("before"), F.lead("role").over(w).alias("after"))


@query("SELECT conv_id, max_by(text, turn) FILTER (WHERE role = 'user') AS last_user FROM conversations GROUP BY conv_id")
def last_match(spark, sf_dir):
    e = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    d = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(e.alias("e"))
    return d.select("conv_id", extract.at(F.transform("e", lambda x: x["text"]), extract.last_where(F.col("e"), lambda x: x["role"] == "user")).alias("last_user"))


@query("""SELECT c.conv_id, string_agg(c.text, ' ' ORDER BY c.turn) AS block FROM conversations c
  JOIN (SELECT conv_id, min(turn) AS s FROM conversations WHERE role = 'user' GROUP BY conv_id) b USING (conv_id)
  LEFT JOIN (SELECT a.conv_id, min(a.turn) AS e FROM conversations a JOIN (SELECT conv_id, min(turn) AS s FROM conversations WHERE role = 'user' GROUP BY conv_id) u ON a.conv_id = u.conv_id AND a.turn > u.s WHERE a.role = 'assistant' GROUP BY a.conv_id) z USING (conv_id)
  WHERE c.turn >= s AND (e IS NULL OR c.turn < e) GROUP BY c.conv_id""")
def first_match_block(spark, sf_dir):
    d = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("e"))
    s = extract.first_where(F.col("e"), lambda x: x["role"] == "user")
    rest = F.slice("e", s, F.lit(extract.ALL))
    body = extract.until(rest, extract.first_where(rest, lambda x: x["role"] == "assistant"))
    return d.where(s > 0).select("conv_id", F.array_join(F.transform(body, lambda x: x["text"]), " ").alias("block"))


@query("SELECT count(*) FILTER (WHERE n > 1) AS multi_page FROM (SELECT count(DISTINCT turn) AS n FROM conversations GROUP BY conv_id)")
def multi_page_count(spark, sf_dir):
    d = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.countDistinct("turn").alias("n"))
    return d.agg(F.count_if(F.col("n") > 1).alias("multi_page"))


# --- geometry: lineitems as boxes ---------------------------------------------------------------

BOX = "l_orderkey % 50 AS issue, l_orderkey, l_linenumber, CAST(l_partkey % 900 AS DOUBLE) AS x0, CAST(l_suppkey % 1000 AS DOUBLE) AS y0, l_partkey % 900 + l_quantity AS x1, l_suppkey % 1000 + l_quantity * 2 AS y1"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").selectExpr(*[x.strip() for x in BOX.split(", ")])
    return d.withColumn("bbox", F.array("x0", "y0", "x1", "y1"))


@query(f"SELECT issue, width, greatest(floor(width * sqrt(2.0) + 0.5), floor(b + width * 0.065 + 0.5)) AS height FROM (SELECT issue, b, greatest(1000.0, floor(r + greatest(20.0, least(80.0, l)) + 0.5)) AS width FROM (SELECT issue, min(x0) FILTER (WHERE x0 > 0) AS l, max(x1) AS r, max(y1) AS b FROM (SELECT {BOX} FROM lineitem) WHERE x1 > x0 AND y1 > y0 GROUP BY issue))")
def doc_dimensions(spark, sf_dir):
    return layout.dimensions(boxes(spark, sf_dir))


@query(f"SELECT l_orderkey, l_linenumber, x0, y0, CAST(least(3, greatest(0, floor(x0 / 1000 * 4))) AS INTEGER) AS ocr_column, CAST(least(3, greatest(0, floor((x0 - 1000 * 0.042 + 0.5) / (1000 * 0.2333)))) AS INTEGER) AS pdf_column FROM (SELECT {BOX} FROM lineitem)")
def column_assign(spark, sf_dir):
    w = F.lit(1000.0)
    return boxes(spark, sf_dir).select("l_orderkey", "l_linenumber", "x0", "y0", layout.ocr_column(F.col("x0"), w).alias("ocr_column"), layout.pdf_column(F.col("x0"), w).alias("pdf_column"))


@query(f"SELECT issue, l_orderkey, l_linenumber, y0, row_number() OVER (PARTITION BY issue ORDER BY least(3, greatest(0, floor(x0 / 1000 * 4))) DESC, y0, x0, l_orderkey, l_linenumber, x1) AS position FROM (SELECT {BOX} FROM lineitem)")
def reading_order(spark, sf_dir):
    order = Window.partitionBy("issue").orderBy(F.col("column").desc(), "y0", "x0", "l_orderkey", "l_linenumber", "x1")
    d = boxes(spark, sf_dir).withColumn("column", layout.ocr_column(F.col("x0"), F.lit(1000.0)))
    return d.select("issue", "l_orderkey", "l_linenumber", "y0", F.row_number().over(order).cast("long").alias("position"))


@query(f"""SELECT issue, c AS "column", floor(min(x0) * 595.276 / 1000 * 10 + 0.5) / 10 AS "left", floor((841.89 - max(y1) * 841.89 / 1414) * 10 + 0.5) / 10 AS bottom, CAST(count(*) AS INTEGER) AS line_count
  FROM (SELECT *, CAST(least(3, greatest(0, floor(x0 / 1000 * 4))) AS INTEGER) AS c FROM (SELECT {BOX} FROM lineitem)) WHERE x1 > x0 AND y1 > y0 GROUP BY issue, c""")
def bbox_union(spark, sf_dir):
    d = boxes(spark, sf_dir).withColumns({"column": layout.ocr_column(F.col("x0"), F.lit(1000.0)), "page": F.lit(1), "width": F.lit(1000.0), "height": F.lit(1414.0), "text": F.lit("x")})
    return layout.box_regions(d, ["issue"]).select("issue", "column", "left", "bottom", "line_count")


@query("""SELECT o_custkey, CAST(floor(sum(o_totalprice * greatest(1, length(o_orderpriority))) / sum(greatest(1, length(o_orderpriority))) * 10 + 0.5) / 10 AS DOUBLE) AS confidence FROM
  (SELECT o_custkey, CAST(CAST(o_totalprice AS BIGINT) AS DOUBLE) AS o_totalprice, o_orderpriority FROM orders) GROUP BY o_custkey""")
def weighted_mean(spark, sf_dir):
    regions = F.collect_list(F.struct(F.col("p").alias("confidence"), F.col("o_orderpriority").alias("text")))
    price = F.expr("cast(bround(o_totalprice) as double)")
    d = table(spark, sf_dir, "orders").withColumn("p", price).groupBy("o_custkey").agg(regions.alias("r"))
    return d.select("o_custkey", layout.weighted_confidence(F.col("r")).alias("confidence"))


# --- pages: HTML, links, JSON -------------------------------------------------------------------

HTML_SQL = """array_to_string(list_filter(list_transform(string_split(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '<br\\s*/?>', chr(10), 'gi'),
  '</(?:p|div|li|tr|td|th)>', chr(10), 'gi'), '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> ''), chr(10))"""


@query(f"SELECT page_id, {HTML_SQL} AS body FROM pages")
def html_to_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.html_to_text(F.col("html")).alias("body"))


@query("SELECT page_id, regexp_extract(url, '^(https?)://', 1) AS scheme, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path FROM pages")
def url_parts(spark, sf_dir):
    part = lambda p: F.coalesce(F.try_parse_url("url", F.lit(p)), F.lit(""))
    return table(spark, sf_dir, "pages").select("page_id", part("PROTOCOL").alias("scheme"), part("HOST").alias("host"), part("PATH").alias("path"))


@query("SELECT event_id, json_extract_string(props, '$.' || json_keys(props)[1]) AS first_value, len(json_keys(props)) AS n_keys FROM events")
def json_props(spark, sf_dir):
    keys = F.json_object_keys("props")
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "map<string,string>")[keys[0]].alias("first_value"), F.size(keys).cast("long").alias("n_keys"))


# --- round trips: notices written from rows, read back -------------------------------------------


def written(spark: SparkSession, sf_dir: str, shift: bool = True) -> DataFrame:
    """Notice texts made of customers' orders; the extraction must give the columns back."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    day = F.col("o_orderdate").cast("date")
    day = F.add_months(day, 240) if shift else day
    body = F.concat_ws("\n", F.upper(F.translate("c_name", "#", " ")), F.lit("SARL"), F.concat(F.lit("registre de commerce "), (F.col("c_custkey") + 100000).cast("string")), F.lit("constitution societe a settat"),
                       F.concat(F.lit("le "), F.date_format(day, "yyyy/MM/dd")), F.concat(F.lit("capital "), (F.col("o_orderkey") + 1000).cast("string"), F.lit(" dhs")))
    # the tables are few files; the texts are work for every core
    return o.select("o_orderkey", body.alias("text")).repartition(spark.sparkContext.defaultParallelism)


def read_back(spark: SparkSession, sf_dir: str, shift: bool = True) -> DataFrame:
    return notices.parse(written(spark, sf_dir, shift), rules.pack("js"), include_raw_text=False)


FROM_ORDERS = "FROM orders JOIN customer ON o_custkey = c_custkey"


@query(f"SELECT o_orderkey, CAST(c_custkey + 100000 AS VARCHAR) AS register {FROM_ORDERS}")
def roundtrip_register(spark, sf_dir):
    return read_back(spark, sf_dir).select("o_orderkey", F.col("company.commercial_register_number").alias("register"))


@query(f"SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE) + INTERVAL 240 MONTH, '%Y-%m-%d') AS decided {FROM_ORDERS}")
def roundtrip_dates(spark, sf_dir):
    return read_back(spark, sf_dir).select("o_orderkey", F.col("event.decision_date").alias("decided"))


@query(f"SELECT o_orderkey, CASE WHEN year(o_orderdate) >= 2000 THEN strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') END AS decided {FROM_ORDERS}")
def roundtrip_old_dates(spark, sf_dir):
    return read_back(spark, sf_dir, shift=False).select("o_orderkey", F.col("event.decision_date").alias("decided"))


@query(f"SELECT o_orderkey, o_orderkey + 1000 AS capital {FROM_ORDERS}")
def roundtrip_capital(spark, sf_dir):
    return read_back(spark, sf_dir).select("o_orderkey", F.col("event.capital_mad").alias("capital"))


@query(f"SELECT o_orderkey, upper(replace(c_name, '#', ' ')) AS name, 'SARL' AS form, 'INCORPORATION' AS event, 'Settat' AS city {FROM_ORDERS}")
def roundtrip_name(spark, sf_dir):
    d = read_back(spark, sf_dir)
    return d.select("o_orderkey", F.col("company.name").alias("name"), F.col("company.legal_form").alias("form"), F.col("event.primary_type").alias("event"), F.array_join("company.cities_mentioned", "|").alias("city"))


@query(f"SELECT o_orderkey, 0.95::DOUBLE AS confidence, false AS needs_review, '' AS reasons {FROM_ORDERS}")
def flat_records(spark, sf_dir):
    d = read_back(spark, sf_dir)
    d = records.flat(d.withColumn("source", F.col("source").withField("source_url", F.col("o_orderkey").cast("string"))))
    return d.select(F.col("source_url").cast("long").alias("o_orderkey"), F.col("confidence").cast("double").alias("confidence"), F.col("needs_review").cast("boolean").alias("needs_review"), F.col("review_reasons").alias("reasons"))


# --- reconciliation ------------------------------------------------------------------------------


PAIR = "FROM documents d LEFT JOIN benchmark b ON d.doc_id = b.item_id"


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", "text").join(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("new")), "doc_id", "left")


@query(f"SELECT d.doc_id, coalesce(nullif(trim(b.text), ''), d.source) AS replaced, coalesce(nullif(d.source, ''), b.text) AS filled {PAIR}")
def merge_fill(spark, sf_dir):
    return paired(spark, sf_dir).select("doc_id", second_reading.replace_prose(F.col("source"), F.col("new")).alias("replaced"), second_reading.fill_missing(F.col("source"), F.col("new")).alias("filled"))


@query(f"SELECT d.doc_id, CASE WHEN b.text IS NOT NULL AND b.text <> '' AND (d.text = '' OR length(b.text) < length(d.text) * 1.6) THEN b.text ELSE d.text END AS preferred {PAIR}")
def merge_prefer(spark, sf_dir):
    return paired(spark, sf_dir).select("doc_id", second_reading.prefer(F.col("text"), F.col("new")).alias("preferred"))


HALF = "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate >= '1996-{0}-01' AND o_orderdate < '{1}'"
A_SQL, B_SQL = HALF.format("07", "1997-01-01"), HALF.format("01", "1996-07-01")


def half_years(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders")
    part = lambda a, b: o.where((F.col("o_orderdate") >= F.lit(a).cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit(b).cast("timestamp_ntz"))).select("o_orderkey", "o_custkey")
    return records.difference(part("1996-07-01", "1997-01-01"), part("1996-01-01", "1996-07-01"), "o_custkey")


@query(f"SELECT DISTINCT o_custkey FROM ({B_SQL}) WHERE o_custkey NOT IN (SELECT o_custkey FROM ({A_SQL}))")
def missing_refs(spark, sf_dir):
    return half_years(spark, sf_dir)[0]


@query(f"SELECT DISTINCT o_custkey FROM ({A_SQL}) WHERE o_custkey NOT IN (SELECT o_custkey FROM ({B_SQL}))")
def new_refs(spark, sf_dir):
    return half_years(spark, sf_dir)[1]


@query(f"SELECT * FROM ({A_SQL}) WHERE o_custkey NOT IN (SELECT o_custkey FROM ({B_SQL}))")
def new_records(spark, sf_dir):
    return half_years(spark, sf_dir)[2]


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'Rabat|' END || 'Settat' || CASE WHEN o_orderkey % 3 = 0 THEN '|Rabat' ELSE '' END || CASE o_custkey % 2 WHEN 0 THEN '|Fes' ELSE '' END AS cities FROM orders""")
def array_union_ordered(spark, sf_dir):
    """Cities had, then those found in texts, in the order of the rules, each once."""
    had = F.when(F.col("o_orderkey") % 3 != 0, F.array(F.lit("Rabat"), F.lit("Settat")))
    found = second_reading.union_cities(had, F.lit("RABAT, Settat"), F.when(F.col("o_custkey") % 2 == 0, F.lit("à fes")))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(found, "|").alias("cities"))
