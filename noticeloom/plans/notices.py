"""The notice plan: segments to typed, scored records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeloom.functions import extract, rules, text
from noticeloom.functions.rules import RulePack

SCHEMA_VERSION = "1.0.0"
LIMIT = 20_000
MAPPING_REASONS = ["source_text_has_unmapped_glyphs", "source_text_has_suspect_font_mapping"]
REGIONS = "array<struct<page:int,column:int,left:double,right:double,top:double,bottom:double,line_count:int>>"
OPTIONAL = {
    "issue_number": "string", "publication_date": "string", "pdf_path": "string", "source_url": "string", "extraction_engine": "string",
    "pdf_pages": "array<int>", "printed_pages": "array<string>", "reference": "string", "reference_inferred": "boolean", "regions": REGIONS,
    "review_reasons": "array<string>", "company_name_hint": "string",
}


def reasons(checks: list[tuple[Column, str]]) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in checks]))


def points(name: Column, register: Column, form: Column, dated: Column, city: Column, detail: Column, damaged: Column) -> Column:
    """Confidence in hundredths, so that no rounding mode matters."""
    one = lambda c, n: F.coalesce(c, F.lit(False)).cast("int") * n
    total = F.lit(30) + one(name, 25) + one(register, 15) + one(form, 10) + one(dated, 10) + one(city, 5) + one(detail, 5) - one(damaged, 10)
    return F.greatest(F.lit(0), F.least(F.lit(100), total))


RECORD = ("schema_version", "source", "company", "event", "confidence", "needs_review", "review_reasons", "raw_text")


def gated(df: DataFrame, types: Column) -> DataFrame:
    """Add _types, without the rows that have none.

    A filter would be pushed below the projections that fold the text and would fold it once for
    each type again; the generator stays where it is, so the text is folded once.
    """
    return df.select("*", F.explode(F.filter(F.array(types), lambda t: F.size(t) > 0)).alias("_types"))


def parse(segments: DataFrame, pack: RulePack | None = None, include_raw_text: bool = True) -> DataFrame:
    """Notice records of segments(text, ...); segments without an event type are dropped.

    Optional columns of OPTIONAL are used where present. Other columns are kept, but for those named
    like a field of a record (RECORD), which the field replaces. The event gate runs before every
    other extraction. Null and empty texts have no event and are dropped.
    """
    pack = pack or rules.pack()
    d = pack.dialect
    carried = [c for c in segments.columns if c not in OPTIONAL and c != "text" and c not in RECORD]
    rest = F.struct(*[F.col(f"`{c}`") for c in carried]) if carried else F.lit(None)
    optional = [(F.col(name) if name in segments.columns else F.lit(None).cast(kind)).alias(name) for name, kind in OPTIONAL.items()]
    df = segments.select(rest.alias("_rest"), *optional, text.normalise(F.col("text"), d).alias("_all"))
    df = df.select("*", F.right("_all", F.lit(LIMIT)).alias("_text"), (F.length("_all") > LIMIT).alias("_trimmed")).drop("_all")
    df = df.withColumn("_folded", text.fold(F.col("_text")))
    df = gated(df, extract.event_types(F.col("_folded"), pack))
    df = df.withColumn("_lines", text.lines_of(F.col("_text"), d))
    df = df.withColumn("_bent", text.fold_lines(F.col("_lines")))
    ls, fs = F.col("_lines"), F.col("_bent")
    df = df.withColumn("_found", extract.candidates(ls))
    named = extract.company_name(ls, fs, F.col("_found"), pack)
    hint = F.nullif(F.col("company_name_hint"), F.lit(""))
    df = df.withColumns({
        "_name": F.coalesce(hint, named) if d == "js" else named,
        "_form": extract.legal_form(F.col("_text"), F.col("_folded"), pack),
        "_dates": extract.dates(F.col("_text"), F.col("_folded"), pack),
        "_cities": extract.cities(F.col("_folded"), pack),
        "_branching": F.array_contains("_types", "BRANCH_OPENING"),
        "_ending": F.arrays_overlap("_types", F.array(F.lit("DISSOLUTION"), F.lit("LIQUIDATION"))),
        "_plain": text.is_ascii(F.col("_text")),
        "_damaged_glyphs": F.col("_text").contains("\ufffd"),
        "_damaged_font": extract.suspect_font(F.col("_folded"), pack),
    })
    # all labels of these fields are Arabic: an ASCII text has none
    marked = lambda c: F.when(~F.col("_plain"), c)
    df = df.withColumns({
        "_register": extract.register_number(ls, fs, F.col("_name"), pack),
        "_address": marked(extract.registered_address(ls, fs, d)),
        "_purpose": marked(extract.business_purpose(ls, fs, d)),
        "_branch": F.when(F.col("_branching") & ~F.col("_plain"), extract.branch_address(ls, fs, d)),
        "_manager": marked(extract.manager(ls, fs, d)),
        "_filing": F.when(F.col("_plain"), extract.filing_of(F.col("_dates"))).otherwise(extract.filing(ls, fs, F.col("_dates"), d)),
        "_capital": extract.capital(F.col("_text")),
    })
    missing = lambda c: F.col(c).isNull()
    own = reasons([
        (F.col("_trimmed"), "notice_text_trimmed_after_20000_characters"),
        (F.col("_damaged_glyphs"), "source_text_has_unmapped_glyphs"),
        (F.col("_damaged_font"), "source_text_has_suspect_font_mapping"),
        (missing("_name"), "company_name_missing"),
        (missing("_register"), "commercial_register_number_missing"),
        (missing("_form"), "legal_form_missing"),
        (F.size("_dates") == 0, "event_date_missing"),
        (F.col("_branching") & missing("_branch"), "branch_address_missing"),
        (F.col("_ending") & missing("_manager"), "liquidator_missing"),
        (F.size("_cities") == 0, "city_not_detected"),
    ])
    prior = F.array_distinct(F.coalesce("review_reasons", F.array().cast("array<string>")))
    detail = F.coalesce("_branch", "_purpose", "_manager").isNotNull()
    df = df.withColumns({
        "_reasons": F.concat(prior, own) if d == "js" else own,
        "_points": points(~missing("_name"), ~missing("_register"), ~missing("_form"), F.size("_dates") > 0, F.size("_cities") > 0, detail, F.col("_damaged_glyphs") | F.col("_damaged_font")),
    })
    alias = lambda c, n: (F.col(c) if isinstance(c, str) else c).alias(n)
    return df.select(
        *[F.col(f"_rest.`{c}`").alias(c) for c in carried],
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        F.struct(
            alias(F.lit("BOAL"), "series"), "issue_number", "publication_date", "pdf_path", "source_url",
            alias(F.coalesce("extraction_engine", F.lit("pdf-text-layer") if d == "js" else extract.null()), "extraction_engine"),
            alias(F.coalesce("pdf_pages", F.array().cast("array<int>")), "pdf_pages"),
            alias(F.coalesce("printed_pages", F.array().cast("array<string>")), "printed_pages"),
            alias("reference", "notice_reference"),
            alias(F.coalesce("reference_inferred", F.lit(False)), "notice_reference_inferred"),
            alias(F.coalesce("regions", F.array().cast(REGIONS)), "regions"),
        ).alias("source"),
        F.struct(alias("_name", "name"), alias("_form", "legal_form"), alias("_register", "commercial_register_number"), alias("_address", "registered_address"), alias("_cities", "cities_mentioned")).alias("company"),
        F.struct(
            alias(F.col("_types")[0], "primary_type"), alias("_types", "types"), alias(F.try_element_at("_dates", F.lit(1)), "decision_date"), alias(F.try_element_at("_dates", F.lit(2)), "effective_date"),
            alias("_purpose", "business_purpose"), alias("_capital", "capital_mad"), alias("_branch", "branch_address"), alias("_manager", "manager_or_liquidator"), alias("_filing", "filing"),
        ).alias("event"),
        (F.col("_points") / 100).alias("confidence"),
        ((F.size("_reasons") > 0) | (F.col("_points") < 85)).alias("needs_review"),
        F.col("_reasons").alias("review_reasons"),
        (F.col("_text") if include_raw_text else extract.null()).alias("raw_text"),
    )
