"""Fields of a second (OCR) reading, and merging them into records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeloom.functions import extract, rules, text
from noticeloom.functions.extract import ASCII_EDGE, at, first_where, none, strict_date, until
from noticeloom.plans.notices import MAPPING_REASONS, reasons


# --- Fixed values: words (in compact form) and patterns of a second reading -------------------------

LIMITED, SOLE, JOINT_STOCK, SOLE_LATIN, LIMITED_LATIN, JOINT_STOCK_LATIN = "شركهذاتمسووليه", "الشريكالوحيد", "شركهمساهمه", "sarlau|sarldau", "sarl", rf"{ASCII_EDGE}sa{ASCII_EDGE}"
BRANCH_KIND, INCORPORATION_KIND, TRANSFER_KIND = "انشاءفرعتابع|فتحفرع|creationdunesuccursale", "تاسيسشركه|constitutiondesociete", "تفويتالحصص|cessiondeparts"
DISSOLUTION_KIND, DISSOLUTION_LATIN, LIQUIDATION_KIND = "(?s)حل.{0,24}شركه", "dissolutiondelasociete", "تصفيهالشركه"
REGISTER_LABEL = "السجلالتجاري|registrecommercial"
REGISTER_NUMBER, YEAR = rf"({ASCII_EDGE}\d{{3,8}}{ASCII_EDGE})", r"\A20\d{2}\z"
ADDRESS_WORD, ADDRESS_LABELS, ADDRESS_END, ADDRESS_ENDS = "عنوانمقرهاالاجتماعي", ["الموقع", "siegesocial"], "السجلالتجاري", ["الهدف", "اليدف", "الغرض", "راسالمال"]
PURPOSE_WORD, PURPOSE_LABELS, PURPOSE_ENDS = "غرضالشركه", ["الهدف", "اليدف", "objetsocial"], ["المده", "راسالمال", "التسيير", "السنهالاجتماعيه", "تمالايداعالقانوني"]
BRANCH_WORDS, BRANCH_ENDS = ["الكاينبالعنوانالتالي", "عنوانالفرع"], ["المسير", "التسيير", "تمالايداعالقانوني"]
MANAGER_LABELS, MANAGER_ENDS = ["المسيرمنطرف", "التسييرعينكمسير", "عينكمسير"], ["السنهالاجتماعيه", "تمالايداعالقانوني"]
BEFORE_MANAGER = r"(?iu)\A.*?(?:المسير\s+من\s+طرف|التسيير\s*:\s*عين\s+كمسير\s*للشركة|عين\s+كمسير\s*للشركة)\s*:?\s*"
MISTER = r"\A\s*السيد\s*\(?ة?\)?\s*"
FILED, BEFORE_COURT, COURT_END = "تمالايداعالقانوني", r"\A.*?تم\s+الإيداع\s+القانوني\s*", rf"بتاريخ|{ASCII_EDGE}\d{{1,2}}[./-]\d{{1,2}}[./-]20\d{{2}}{ASCII_EDGE}"
FILING_NUMBERS = [r"(?<![./\d])(\d{1,9})\s+تحت\s*رقم", r"تحت\s*رقم\s*(\d{1,9}(?:[./-]\d{1,9})*)"]
CAPITAL_LABEL, CAPITAL = "راسالمال", r"(\d[\d., ]{1,18})\s*درهم"
BEFORE_ADDRESS = r"\A(?:وعنوان\s+)?مقرها\s+الاجتماعي\s*:?\s*|\Aعنوان\s+المقر\s+الاجتماعي\s*:?\s*|\Aالموقع\s*:?\s*|\Asi[eè]ge\s+social\s*:?\s*"
BEFORE_PURPOSE = r"\A(?:الهدف|اليدف|غرض\s+الشركة(?:\s+بإيجاز)?|objet\s+social)\s*:?\s*"
BEFORE_BRANCH = r"\A.*?(?:الكائن|الكاين|الكاثن)\s+بالعنوان\s+التالي\s*:?\s*|\Aعنوان\s+الفرع\s*:?\s*"

# --- end of fixed values --------------------------------------------------------------------------


def dates_of(c: Column) -> Column:
    """Strict calendar dates of ASCII digits in order of appearance, either way round."""
    raw = F.regexp_extract_all(c, F.lit(rf"(?=\d)({ASCII_EDGE}20\d{{2}}[./-]\d{{1,2}}[./-]\d{{1,2}}{ASCII_EDGE}|{ASCII_EDGE}\d{{1,2}}[./-]\d{{1,2}}[./-]20\d{{2}}{ASCII_EDGE})"), F.lit(1))

    def iso(p: Column) -> Column:
        return F.when(F.length(p[0]) == 4, strict_date(p[0], p[1], p[2])).otherwise(strict_date(p[2], p[1], p[0]))

    return F.array_distinct(F.array_compact(F.transform(F.transform(raw, lambda d: F.split(d, "[./-]")), iso)))


def behind(items: Column, start: Column) -> Column:
    return F.slice(items, start + 1, F.lit(extract.ALL))


def block(lines: Column, start: Column, stop: Column) -> Column:
    """From line `start` (null if 0) to before `stop`, counted from there (0: all); the first line from its colon."""
    head = F.coalesce(extract.after_colon(at(lines, start), "py"), at(lines, start))
    return F.when(start > 0, F.array_join(F.concat(F.array(head), until(behind(lines, start), stop)), " "))


def begins(*words: str) -> Callable[[Column], Column]:
    pattern = r"\A(?:" + "|".join(words) + ")"
    return lambda c: c.rlike(pattern)


def without(c: Column, prefix: str) -> Column:
    return text.clean_value(F.regexp_replace(c, "(?iu)" + prefix, ""))


#: Blocks by the tests of the compact lines that begin and end them.
BLOCKS = {
    "address": (lambda c: c.contains(ADDRESS_WORD) | begins(*ADDRESS_LABELS)(c), lambda c: c.contains(ADDRESS_END) | begins(*ADDRESS_ENDS)(c)),
    "purpose": (lambda c: begins(*PURPOSE_LABELS)(c) | c.contains(PURPOSE_WORD), begins(*PURPOSE_ENDS)),
    "branch": (lambda c: c.contains(BRANCH_WORDS[0]) | c.contains(BRANCH_WORDS[1]), begins(*BRANCH_ENDS)),
    "manager": (begins(*MANAGER_LABELS), begins(*MANAGER_ENDS)),
}


def fields(name: Column) -> dict[str, Column]:
    """Candidate fields of a second reading, by record field, from the columns that read() settles."""
    all_packed, bent, lines = F.col("_all"), F.col("_bent"), F.col("_lines")
    inside = lambda w: all_packed.contains(w)
    form = (
        F.when(inside(LIMITED) & inside(SOLE), "SARL AU").when(all_packed.rlike(SOLE_LATIN), "SARL AU")
        .when(inside(LIMITED) | inside(LIMITED_LATIN), "SARL").when(inside(JOINT_STOCK) | bent.rlike(JOINT_STOCK_LATIN), "SA")
    )
    kind = (
        F.when(all_packed.rlike(BRANCH_KIND), "BRANCH_OPENING").when(all_packed.rlike(INCORPORATION_KIND), "INCORPORATION")
        .when(bent.rlike(DISSOLUTION_KIND) | inside(DISSOLUTION_LATIN), "DISSOLUTION").when(all_packed.rlike(TRANSFER_KIND), "SHARE_TRANSFER").when(inside(LIQUIDATION_KIND), "LIQUIDATION")
    )

    def register(ls: Column, packed: Column) -> Column:
        def near(i: Column) -> Column:
            found = F.regexp_extract_all(F.array_join(F.slice(ls, i, F.lit(3)), " "), F.lit(REGISTER_NUMBER), F.lit(1))
            return F.try_element_at(F.filter(found, lambda v: ~v.rlike(YEAR)), F.lit(1))

        labels = F.filter(F.transform(packed, lambda x, i: F.when(x.rlike(REGISTER_LABEL), i + 1)), lambda i: i.isNotNull())
        return F.try_element_at(F.array_compact(F.transform(labels, near)), F.lit(1))

    liquidator = F.transform(lines, lambda x: F.when(x.contains(extract.LIQUIDATOR), F.nullif(F.regexp_extract(x, extract.PERSON, 1), F.lit(""))))
    liquidator = text.clean_value(F.try_element_at(F.array_compact(liquidator), F.lit(1)))
    manager = text.clean_value(F.regexp_replace(F.regexp_replace("_manager", BEFORE_MANAGER, ""), MISTER, ""))
    court = F.split(F.regexp_replace("_tail", BEFORE_COURT, ""), COURT_END)[0]
    before, after = (F.nullif(F.regexp_extract("_tail_bent", p, 1), F.lit("")) for p in FILING_NUMBERS)
    amount = F.regexp_replace(F.regexp_extract("_amount", CAPITAL, 1), r"\D", "")
    value = lambda c, prefix: without(text.clean_value(F.col(c)), prefix)
    return {
        "name": name, "legal_form": form, "commercial_register_number": F.coalesce(register(F.col("_first"), F.transform("_first", text.compact)), register(lines, F.col("_packed"))),
        "registered_address": value("_address", BEFORE_ADDRESS),
        "primary_type": kind, "decision_date": F.try_element_at(F.filter("_dated", lambda d: ~d.eqNullSafe(F.col("_filed"))), F.lit(1)),
        "business_purpose": value("_purpose", BEFORE_PURPOSE),
        "capital_mad": F.nullif(amount, F.lit("")).try_cast("bigint"),
        "branch_address": value("_branch", BEFORE_BRANCH),
        "manager_or_liquidator": F.coalesce(liquidator, manager), "court": text.clean_value(court), "filing_date": F.col("_filed"),
        "filing_number": F.coalesce(before, after),
    }


def read(df: DataFrame, ocr: str, embedded: str, name: str, out: str) -> DataFrame:
    """Add `out`: the struct of candidate fields read from the columns of both texts.

    Each step settles what the next ones use more than once: where blocks start, where they stop, their
    texts. Fields inlined into each other would search the lines again wherever they are used.
    """
    lines, packed = F.col("_lines"), F.col("_packed")
    split = lambda c, of: F.when(F.col(c) != "", F.split(of, "\n")).otherwise(none())
    starts = {f"_{b}_at": first_where(packed, test) for b, (test, _) in BLOCKS.items()}
    starts |= {"_filed_at": first_where(packed, lambda c: c.contains(FILED)), "_capital_at": first_where(packed, begins(CAPITAL_LABEL))}
    stops = {f"_{b}_to": F.when(F.col(f"_{b}_at") > 0, first_where(behind(packed, F.col(f"_{b}_at")), test)).otherwise(0) for b, (_, test) in BLOCKS.items()}
    texts = {f"_{b}": block(lines, F.col(f"_{b}_at"), F.col(f"_{b}_to")) for b in BLOCKS if b != "manager"}
    m, f, k = (F.col(c) for c in ("_manager_at", "_filed_at", "_capital_at"))
    texts["_manager"] = F.when(m > 0, F.array_join(F.concat(F.array(at(lines, m)), until(behind(lines, m), F.col("_manager_to"))), " "))
    texts["_tail"] = F.when(f > 0, F.array_join(F.slice(lines, f, F.lit(extract.ALL)), " "))
    texts["_amount"] = F.when(k > 0, F.array_join(F.slice(lines, k, F.lit(4)), " "))
    dated = F.array_sort(F.array_distinct(F.concat(dates_of(F.coalesce("_own", F.lit(""))), dates_of(F.col("_whole")))))
    steps = [
        {"_whole": text.ocr_text(F.col(ocr)), "_own": text.ocr_text(F.col(embedded))},
        {"_bent": text.ocr_fold(F.col("_whole"))},
        {"_letters": F.regexp_replace("_bent", r"[^\p{L}\p{N}\n]+", "")},
        # lines hold no line break, so folding them together and apart is the same
        {"_lines": split("_whole", F.col("_whole")), "_packed": split("_whole", F.col("_letters")), "_all": F.translate("_letters", "\n", ""), "_first": split("_own", F.col("_own"))},
        starts, stops, texts,
        {"_filed": F.try_element_at(dates_of(F.col("_tail")), F.lit(1)), "_tail_bent": text.ocr_fold(F.col("_tail")), "_dated": dated},
        {out: as_struct(fields(F.col(name)))},
    ]
    clean = df
    for made in steps:
        clean = extract.settled(clean.withColumns(made), *made)
    return clean.select(*[f"`{c}`" for c in df.columns if c != out], out)


def as_struct(f: dict[str, Column]) -> Column:
    return F.struct(*[v.alias(k) for k, v in f.items()])


# --- precedence --------------------------------------------------------------------------------


def present(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def replace_prose(current: Column, new: Column) -> Column:
    return F.coalesce(present(new), current)


def replace_person(current: Column, new: Column) -> Column:
    weak = current.isNull() | (current == "") | current.rlike("�|[0-9]")
    return F.when(weak, F.coalesce(present(new), current)).otherwise(current)


def fill_missing(current: Column, new: Column) -> Column:
    return F.coalesce(F.nullif(current, F.lit("")), new)


def prefer(current: Column, new: Column) -> Column:
    """The new value if the current one is empty or the new is shorter than 1.6 times it."""
    better = current.isNull() | (current == "") | (F.length(new) < F.length(current) * 1.6)
    return F.when(F.coalesce(new != "", F.lit(False)) & better, new).otherwise(current)


def mixed_script(c: Column) -> Column:
    return F.coalesce(text.has_arabic(c) & c.rlike(rf"{ASCII_EDGE}[A-Za-z]{{1,5}}{ASCII_EDGE}"), F.lit(False))


def union_cities(current: Column, *texts: Column) -> Column:
    said = text.nfkc(F.concat_ws("\n", *[F.nullif(t, F.lit("")) for t in texts]))
    # each form is made once: nested, every use of a form would make all those before it anew
    folded = extract.let(extract.let(said, lambda t: text.tidy(t, "js")), text.fold)
    return F.array_union(F.coalesce(current, none()), extract.cities(folded, rules.pack("js")))


def still(missing: dict[str, Column]):
    def keep(reason: Column) -> Column:
        out = F.lit(True)
        for name, lacks in missing.items():
            out = F.when(reason == name, lacks).otherwise(out)
        return out

    return keep


def enhance(records: DataFrame, reading: str = "second") -> DataFrame:
    """Take second-pass fields (struct column) into records of the OCR import: prose by length, the
    rest where missing; reasons resolved by it go; the confidence stays."""
    n = lambda f: F.col(f"{reading}.{f}")
    df = extract.settled(records, "company", "event", "review_reasons", "confidence", reading)
    df = df.withColumn("company", F.col("company").withField("registered_address", prefer(F.col("company.registered_address"), n("registered_address")))
                            .withField("legal_form", fill_missing(F.col("company.legal_form"), n("legal_form")))
                            .withField("commercial_register_number", fill_missing(F.col("company.commercial_register_number"), n("commercial_register_number"))))
    df = df.withColumn("event", F.col("event").withField("business_purpose", prefer(F.col("event.business_purpose"), n("business_purpose")))
                       .withField("branch_address", prefer(F.col("event.branch_address"), n("branch_address")))
                       .withField("manager_or_liquidator", prefer(F.col("event.manager_or_liquidator"), n("manager_or_liquidator")))
                       .withField("decision_date", fill_missing(F.col("event.decision_date"), n("decision_date")))
                       .withField("capital_mad", F.coalesce("event.capital_mad", n("capital_mad")))
                       .withField("filing", F.struct(*[fill_missing(F.col(f"event.filing.{a}"), n(b)).alias(a) for a, b in (("court", "court"), ("date", "filing_date"), ("number", "filing_number"))])))
    df = extract.settled(df, "company", "event")
    df = df.withColumn("company", F.col("company").withField("cities_mentioned", union_cities(F.col("company.cities_mentioned"), F.col("raw_text"), F.col("company.registered_address"), F.col("event.branch_address"), F.col("event.filing.court"))))
    df = extract.settled(df, "company")
    ending = F.arrays_overlap("event.types", F.array(F.lit("DISSOLUTION"), F.lit("LIQUIDATION")))
    keep = still({
        "commercial_register_number_missing": F.col("company.commercial_register_number").isNull(), "legal_form_missing": F.col("company.legal_form").isNull(), "event_date_missing": F.col("event.decision_date").isNull(),
        "branch_address_missing": F.array_contains("event.types", "BRANCH_OPENING") & F.col("event.branch_address").isNull(), "liquidator_missing": ending & F.col("event.manager_or_liquidator").isNull(),
        "city_not_detected": F.size("company.cities_mentioned") == 0,
    })
    df = df.withColumn("review_reasons", F.filter("review_reasons", keep))
    df = df.withColumn("needs_review", (F.size("review_reasons") > 0) | (F.col("confidence") < 0.85))
    return df.select(*records.columns)


def merge(records: DataFrame, ocr: str = "ocr") -> DataFrame:
    """Merge a second reading (struct: text, confidence, fields, ...; null: none) into each record."""
    had = extract.settled(records, "company", "event", "review_reasons", "confidence", ocr)
    o = lambda f: F.col(f"{ocr}.fields.{f}")
    some = F.col(f"{ocr}.fields").isNotNull()
    score = F.coalesce(F.col(f"{ocr}.confidence"), F.lit(0.0))
    prior = F.filter("review_reasons", lambda r: ~r.startswith("ocr_"))
    was = {
        "register": F.col("company.commercial_register_number").isNull(), "date": F.col("event.decision_date").isNull(), "manager": F.col("event.manager_or_liquidator").isNull(),
        "filed": F.col("event.filing.date").isNull(), "number": F.col("event.filing.number").isNull(), "city": F.coalesce(F.size("company.cities_mentioned"), F.lit(0)) == 0,
    }
    out = had.withColumn("_was", F.struct(*[v.alias(k) for k, v in was.items()])).withColumn("_prior", prior)
    e, c = F.col("event"), F.col("company")
    out = out.withColumn("_event", e.withField("business_purpose", replace_prose(e["business_purpose"], o("business_purpose"))).withField("branch_address", replace_prose(e["branch_address"], o("branch_address")))
                         .withField("manager_or_liquidator", replace_person(e["manager_or_liquidator"], o("manager_or_liquidator"))).withField("decision_date", fill_missing(e["decision_date"], o("decision_date")))
                         .withField("capital_mad", F.coalesce(e["capital_mad"], o("capital_mad")))
                         .withField("filing", F.struct(replace_prose(e["filing"]["court"], o("court")).alias("court"), fill_missing(e["filing"]["date"], o("filing_date")).alias("date"), fill_missing(e["filing"]["number"], o("filing_number")).alias("number"))))
    out = out.withColumn("_company", c.withField("registered_address", replace_prose(c["registered_address"], o("registered_address"))).withField("legal_form", fill_missing(c["legal_form"], o("legal_form")))
                         .withField("commercial_register_number", fill_missing(c["commercial_register_number"], o("commercial_register_number"))))
    out = extract.settled(out, "_event", "_company", "_was", "_prior")
    ev, co = F.col("_event"), F.col("_company")
    out = out.withColumn("_company", co.withField("cities_mentioned", union_cities(co["cities_mentioned"], F.col(f"{ocr}.text"), co["registered_address"], ev["branch_address"], ev["filing"]["court"])))
    out = extract.settled(out, "_company")
    resolved = (score >= 55) & (F.coalesce(F.col(f"{ocr}.text"), F.lit("")) != "")
    keep = still({name: ~resolved for name in MAPPING_REASONS} | {
        "commercial_register_number_missing": co["commercial_register_number"].isNull(), "legal_form_missing": co["legal_form"].isNull(), "event_date_missing": ev["decision_date"].isNull(),
        "branch_address_missing": ev["branch_address"].isNull(), "liquidator_missing": ev["manager_or_liquidator"].isNull(), "city_not_detected": F.size(co["cities_mentioned"]) == 0,
    })
    w = F.col("_was")
    added = reasons([
        (score < 55, "ocr_confidence_low"), (w["register"] & co["commercial_register_number"].isNotNull(), "ocr_commercial_register_number_needs_review"), (w["date"] & ev["decision_date"].isNotNull(), "ocr_event_date_needs_review"),
        (w["manager"] & ev["manager_or_liquidator"].isNotNull(), "ocr_manager_name_needs_review"), (w["filed"] & ev["filing"]["date"].isNotNull(), "ocr_filing_date_needs_review"),
        (w["number"] & ev["filing"]["number"].isNotNull(), "ocr_filing_number_needs_review"), (w["city"] & (F.size(co["cities_mentioned"]) > 0), "ocr_city_detection_needs_review"),
        (mixed_script(co["registered_address"]), "ocr_registered_address_needs_review"), (mixed_script(ev["business_purpose"]), "ocr_business_purpose_needs_review"), (mixed_script(ev["branch_address"]), "ocr_branch_address_needs_review"),
        (mixed_script(o("manager_or_liquidator")), "ocr_manager_name_needs_review"), (mixed_script(ev["filing"]["court"]), "ocr_filing_court_needs_review"),
    ])
    out = out.withColumn("_reasons", F.array_distinct(F.concat(F.filter("_prior", keep), added)))
    floor = F.when(score >= 75, F.when(F.size("_reasons") > 0, 0.85).otherwise(0.9)).when(score >= 55, 0.82).otherwise(0.0)
    pick = lambda new, old: F.when(some, new).otherwise(F.col(old))
    return out.select(*[
        {
            "company": pick(F.col("_company"), "company"), "event": pick(F.col("_event"), "event"), "review_reasons": pick(F.col("_reasons"), "review_reasons"),
            "needs_review": pick(F.size("_reasons") > 0, "needs_review"), "confidence": pick(F.greatest("confidence", floor), "confidence"),
        }.get(name, F.col(name)).alias(name)
        for name in records.columns
    ])


def queue(records: DataFrame, key: str, inputs: list[str], recognise: Callable, result: str) -> DataFrame:
    """key, ocr (DDL `result`), error of every record, from recognise(dict of `inputs`) -> dict.

    The recogniser is built outside this engine. A record that it fails on gives a null result and the
    error's text, and no other record is touched; nor does the caller's merge() change that record.
    """
    from collections.abc import Iterator

    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                given = dict(zip(inputs, row[1:], strict=True))
                try:
                    out.append((row[0], recognise(given), None))
                except Exception as e:  # one record's failure is that record's result
                    out.append((row[0], None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=[key, "ocr", "error"])

    kind = records.schema[key].dataType.simpleString()
    return records.select(key, *inputs).mapInPandas(run, f"`{key}` {kind}, ocr {result}, error string")
