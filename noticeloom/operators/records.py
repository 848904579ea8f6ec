"""Queries over notice records: filters, pages, facets, summaries, run differences, flat exports."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeloom.functions import rules
from noticeloom.plans.notices import MAPPING_REASONS, REGIONS

REGION = REGIONS.removeprefix("array<").removesuffix(">")
DEFAULT_LIMIT, MAX_LIMIT = 100, 500
SEARCHED = ("company.name", "company.commercial_register_number", "company.registered_address", "event.primary_type", "event.business_purpose", "event.branch_address", "event.manager_or_liquidator")


@dataclass(frozen=True)
class Query:
    """Parameters of a record query; None is absent. Built from request strings by Query.of()."""

    event: str | None = None
    company: str | None = None
    city: str | None = None
    needs_review: bool | None = None
    min_confidence: float | None = None
    q: str | None = None
    limit: int = DEFAULT_LIMIT
    offset: int = 0

    @classmethod
    def of(cls, given: dict[str, list[str] | str]) -> Query:
        """The first value of each parameter, trimmed; blank is absent. ValueError on bad booleans,
        numbers and confidences outside 0..1; limits and offsets are clamped."""

        def first(name: str) -> str | None:
            v = given.get(name)
            v = (v[0] if v else None) if isinstance(v, list) else v
            return (v or "").strip() or None

        def whole(name: str, default: int) -> int:
            try:
                return int(first(name) or default)
            except ValueError:
                raise ValueError(f"{name} must be an integer") from None

        review = first("needs_review")
        if review is not None and review.lower() not in ("true", "1", "yes", "false", "0", "no"):
            raise ValueError("needs_review must be true or false")
        confidence = first("min_confidence")
        try:
            least = None if confidence is None else float(confidence)
        except ValueError:
            raise ValueError("min_confidence must be a number") from None
        if least is not None and (math.isnan(least) or not 0 <= least <= 1):
            raise ValueError("min_confidence must lie between 0 and 1")
        return cls(
            first("event"), first("company"), first("city"), None if review is None else review.lower() in ("true", "1", "yes"), least, first("q"),
            max(1, min(MAX_LIMIT, whole("limit", DEFAULT_LIMIT))), max(0, whole("offset", 0)),
        )


def member(items: str | Column, value: str) -> Column:
    """Case-insensitive membership; a null list has no members."""
    return F.coalesce(F.exists(items, lambda x: F.lower(x) == value.lower()), F.lit(False))


def holds(c: str | Column, value: str) -> Column:
    """Case-insensitive substring; null counts as empty."""
    c = F.col(c) if isinstance(c, str) else c
    return F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(value.lower()))


def search_text(fields: tuple[str, ...] = SEARCHED) -> Column:
    return F.concat_ws(" ", *[F.nullif(F.col(f), F.lit("")) for f in fields])


def select(records: DataFrame, query: Query, fields: tuple[str, ...] = SEARCHED) -> DataFrame:
    """Records that meet every given predicate; scalar ones reach the scan."""
    out = records
    if query.needs_review is not None:
        out = out.where(F.col("needs_review") == query.needs_review)
    if query.min_confidence is not None:
        out = out.where(F.col("confidence") >= query.min_confidence)
    if query.event:
        out = out.where(member("event.types", query.event))
    if query.city:
        out = out.where(member("company.cities_mentioned", query.city))
    if query.company:
        out = out.where(holds("company.name", query.company))
    if query.q:
        out = out.where(holds(search_text(fields), query.q))
    return out


UNKNOWN_CITY = "__unknown__"
LISTED = ("company.name", "company.legal_form", "company.commercial_register_number", "company.registered_address", "company.cities_mentioned", "event.primary_type", "event.business_purpose", "event.branch_address", "event.manager_or_liquidator", "source.notice_reference")


def listed(records: DataFrame, city: str = "", event: str = "", review: str = "", query: str = "") -> DataFrame:
    """Records as a result list filters them: an exact city, or UNKNOWN_CITY for records without one; the
    primary event; `review` or `ready`; and text in any of ten fields. Blank means any."""
    out = records
    if review in ("review", "ready"):
        out = out.where(F.col("needs_review") == (review == "review"))
    if event:
        out = out.where(F.col("event.primary_type") == event)
    if city == UNKNOWN_CITY:
        out = out.where(F.coalesce(F.size("company.cities_mentioned"), F.lit(0)) == 0)
    elif city:
        out = out.where(F.coalesce(F.array_contains("company.cities_mentioned", city), F.lit(False)))
    if query.strip():
        said = F.concat_ws(" ", *[F.nullif(F.array_join(f, " ") if f == "company.cities_mentioned" else F.col(f), F.lit("")) for f in LISTED])
        out = out.where(holds(said, query.strip()))
    return out


def city_facet(records: DataFrame) -> DataFrame:
    """value, n of the cities of a result list, in order of name; records without one last, if any."""
    return facets(records, "company.cities_mentioned", "not detected").orderBy(F.col("value") == "not detected", "value")


def title_case(name: Column) -> Column:
    """AN_EVENT as `An Event`."""
    return F.array_join(F.transform(F.split(F.lower(name), "_"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), " ")


def event_label(name: Column) -> Column:
    """The display label of an event type."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in rules.LABELS.items() for x in pair]), name), title_case(name))


def event_facet(records: DataFrame) -> DataFrame:
    """value, label of the primary events, in order of name."""
    return records.select(F.col("event.primary_type").alias("value")).distinct().select("value", event_label(F.col("value")).alias("label")).orderBy("value")


def valid_regions(regions: Column) -> Column:
    """Regions with a page and a finite box of positive size."""
    real = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    whole = lambda r: r["page"].isNotNull() & real(r["left"]) & real(r["right"]) & real(r["top"]) & real(r["bottom"])
    return F.filter(F.coalesce(regions, F.array().cast(REGIONS)), lambda r: F.coalesce(whole(r) & (r["right"] > r["left"]) & (r["top"] > r["bottom"]), F.lit(False)))


def source_slices(regions: Column, pages: Column) -> Column:
    """Where a record is shown: struct(page, region) for each region with finite sides, else for each page."""
    real = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    finite = F.filter(F.coalesce(regions, F.array().cast(REGIONS)), lambda r: F.coalesce(r["page"].isNotNull() & real(r["left"]) & real(r["right"]) & real(r["top"]) & real(r["bottom"]), F.lit(False)))
    by_region = F.transform(finite, lambda r: F.struct(r["page"].alias("page"), r.alias("region")))
    by_page = F.transform(F.array_compact(F.coalesce(pages, F.array().cast("array<int>"))), lambda p: F.struct(p.alias("page"), F.lit(None).cast(REGION).alias("region")))
    return F.when(F.size(finite) > 0, by_region).otherwise(by_page)


def page(df: DataFrame, order: list, limit: int, offset: int) -> DataFrame:
    """One page in `order`, which must be total."""
    return df.orderBy(*order).offset(offset).limit(limit)


def respond(records: DataFrame, query: Query, ordinal: str = "ordinal") -> dict:
    """The response of one request: the total before paging and the page's rows as JSON."""
    found = select(records, query)
    rows = page(found, [ordinal], query.limit, query.offset).drop(ordinal).toJSON().collect()
    return {"pagination": {"total": found.count(), "offset": query.offset, "returned": len(rows)}, "records": rows}


def facets(records: DataFrame, items: str, unknown: str = "not detected") -> DataFrame:
    """value, n: records per item of a list column, records without items under `unknown`."""
    own = records.select(F.when(F.coalesce(F.size(items), F.lit(0)) > 0, F.array_distinct(items)).otherwise(F.array(F.lit(unknown))).alias("v"))
    return own.select(F.explode("v").alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def summary(records: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Counts of records, by `keys` if given; records_with_ocr where there is an ocr column."""
    done = [F.count_if(F.col("ocr.status") == "complete").alias("records_with_ocr")] if "ocr" in records.columns else []
    return records.groupBy(*(keys or [])).agg(
        F.count(F.lit(1)).alias("records"), F.count_if("needs_review").alias("records_needing_review"), F.count_if(F.size("source.pdf_pages") > 1).alias("multi_page"),
        F.count_if("source.notice_reference_inferred").alias("inferred_references"), F.count_if(F.coalesce("source.notice_reference", F.lit("")) == "").alias("records_without_notice_reference"), *done,
    )


def difference(current: DataFrame, previous: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(keys gone, keys new, new records) between two runs; a null key equals a null key."""
    a, b = current.select(F.col(key).alias("_k")).distinct(), previous.select(F.col(key).alias("_o")).distinct()
    same = F.col("_k").eqNullSafe(F.col("_o"))
    gone = b.join(a, same, "left_anti").withColumnRenamed("_o", key)
    new = a.join(b, same, "left_anti")
    records = current.join(new, F.col(key).eqNullSafe(F.col("_k")), "left_semi")
    return gone, new.withColumnRenamed("_k", key), records


def record_key() -> Column:
    """reference|pages|name of a record."""
    pages = F.array_join(F.transform("source.pdf_pages", lambda p: p.cast("string")), "-")
    return F.concat_ws("|", F.coalesce("source.notice_reference", F.lit("")), F.coalesce(pages, F.lit("")), F.coalesce("company.name", F.lit("")))


def document_key(name: Column, size: Column, day: Column, issue: Column) -> Column:
    return F.concat_ws("|", F.lit("v1"), *[F.coalesce(c.cast("string"), F.lit("")) for c in (name, size, day, issue)])


def needs_second_reading() -> Column:
    """No finished second reading, a valid region, and a mapping reason or Arabic text; of records with an
    ocr column."""
    done = F.coalesce(F.col("ocr.status") == "complete", F.lit(False))
    reason = F.coalesce(F.arrays_overlap("review_reasons", F.array(*map(F.lit, MAPPING_REASONS))), F.lit(False))
    return ~done & (F.size(valid_regions(F.col("source.regions"))) > 0) & (reason | F.coalesce(F.col("raw_text").rlike("[\\u0600-\\u06ff]"), F.lit(False)))


def targeted(records: DataFrame, wanted: list[str]) -> DataFrame:
    """Records whose company name or reference is one of `wanted`."""
    return records.where(F.col("company.name").isin(wanted) | F.col("source.notice_reference").isin(wanted))


def flat(records: DataFrame, browser: bool = False) -> DataFrame:
    """Records as the flat string columns of the CSV exports, lists joined by a bar: 25, or the 32 of the
    `browser` form, which adds the inferred flag, the engine, the second reading and the raw text."""
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), "|")
    s, c, e = "source.", "company.", "event."
    own = lambda name: F.col(f"ocr.{name}") if "ocr" in records.columns else F.lit(None)
    extra = {
        "notice_reference": {"notice_reference_inferred": s + "notice_reference_inferred"}, "source_url": {"extraction_engine": s + "extraction_engine"},
        "review_reasons": {"ocr_status": own("status"), "ocr_confidence": own("confidence"), "ocr_processed_at": own("processed_at"), "ocr_text": own("text"), "raw_text": "raw_text"},
    }
    cols = {
        "company_name": c + "name", "legal_form": c + "legal_form", "commercial_register_number": c + "commercial_register_number", "registered_address": c + "registered_address", "cities_mentioned": joined(c + "cities_mentioned"),
        "event_type": e + "primary_type", "event_types": joined(e + "types"), "decision_date": e + "decision_date", "effective_date": e + "effective_date", "business_purpose": e + "business_purpose",
        "capital_mad": e + "capital_mad", "branch_address": e + "branch_address", "manager_or_liquidator": e + "manager_or_liquidator", "filing_court": e + "filing.court", "filing_date": e + "filing.date", "filing_number": e + "filing.number",
        "issue_number": s + "issue_number", "publication_date": s + "publication_date", "pdf_pages": joined(s + "pdf_pages"), "printed_pages": joined(s + "printed_pages"), "notice_reference": s + "notice_reference", "source_url": s + "source_url",
        "confidence": "confidence", "needs_review": "needs_review", "review_reasons": joined("review_reasons"),
    }
    whole = {}
    for name, value in cols.items():
        whole[name] = value
        whole |= extra.get(name, {}) if browser else {}
    return records.select(*[(F.col(v) if isinstance(v, str) else v).cast("string").alias(k) for k, v in whole.items()])
