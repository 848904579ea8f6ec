"""Classification and field extraction over a notice's text, lines and folded lines.

Every function takes and returns Columns. `lines` is array<string>; `folded` holds fold() of each
line. Positions are one-based array indices, 0 for none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeloom.functions import rules, text
from noticeloom.functions.rules import ASCII_EDGE, RulePack, java


# --- Fixed values: words and patterns of the fields ----------------------------------------------

NAME_LABEL = "تسميه"
REGISTER = {
    "js": [r"(?:السجل.{0,20}التجاري|التجاري.{0,20}السجل)[^\d]{0,45}(\d{2,10})", rf"(?:registre\s+de\s+commerce|registre\s+commercial|R(?<![A-Za-z0-9_]R)C(?![A-Za-z0-9_]))[^\d]{{0,20}}(\d{{2,10}})"],
    "py": [r"(?:رقم\s+)?(?:التقييد\s+في\s+)?السجل\s+التجاري[^\d]{0,25}(\d{2,10})", r"(?:registre\s+de\s+commerce|registre\s+commercial|\bRC\b)[^\d]{0,15}(\d{2,10})"],
}
REGISTER_CONTEXT = r"(?iu)رقم|سجل|registre"
NUMBER_LABEL, REGISTER_WORDS = "رقم", ["السجل", "registre"]
CAPITAL = [r"(?iu)(?:رأس\s*مال|رأسمال|راسمال)[^\d]{0,30}([\d .]{3,20})\s*(?:درهم|د\.?\s*م)", r"(?iu)capital[^\d]{0,20}([\d .]{3,20})\s*(?:dhs?|mad)"]
JS_STOP_LABELS = ["تجاري"]
ADDRESS_LABEL = {"py": "اجتماعي", "js": "جتماعي"}
PURPOSE_WORDS, PURPOSE = ["غرض", "ايجاز"], r"(?u)غرض.{0,30}(?:شرك|ايجاز|إيجاز)"
BRANCH_EVENT = {"py": "انشاء فرع", "js": r"(?u)انشاء\s+فرع|فتح\s+فرع"}
BRANCH_PLACE = {"py": "كاين|العنوان التالي", "js": r"(?u)كائن|كاين|عنوان\s+التالي|عنوان\s+تالي"}
BRANCH_END = {"py": "المسير|ولمسير|تم الايداع", "js": r"(?u)مسير|ملسير|مصفي|تم\s+الايداع"}
PERSON = r"(?u)السيد(?:ة)?\s*\)?\s*([\p{IsArabic} ]{3,80}?)(?=\s+(?:و\s*)?عنوان|\s+بصفته|\s+كمصفي|\s+مصفيا|$)"
LIQUIDATOR = "مصفي"
NAME_STOPS = ["المسير", "ملسير", "المصفي", "مصفي", "مصفية", "من", "طرف", "السيد", "السيدة", "تعيين", "وذ", "و", "سي", "سيوذ"]
NAME_PARTS = "مسير|ملسير|مصفي|طرف|سيد|تعيين"
MANAGER_LINE = {"py": "المسير|ولمسير|مصفي|مصفية", "js": "المسير|ملسير|مصفي|مصفية"}
BEFORE_PERSON = [r"(?iuU)\A.*?(?:من\s+طرف|تعيين|بصفته|بصفتها)\s*", r"(?uU)السيد(?:ة)?\s*(?:\([^)]*\))?\s*", r"\A(?:وذسي|السي)\s*"]
NO_PERSON = "عنوان|شارع|تجزيه|المغرب|سطات|الدار البيضاء"
ARABIC_WORD = r"([؀-ۿ]{2,})"
COURT, COURT_WORDS = "محكم|ملحكم", ("المحكمه", "محكمة")
COURT_END = rf"(?iu)بتاريخ|تحت\s+رقم|{ASCII_EDGE}\d{{1,2}}[./-]\d{{1,2}}[./-]20\d{{2}}{ASCII_EDGE}"
FILED, FILED_LINE, DONE = "ايداع", "ايداع|اليداع|الي", "تم"
FILING_NUMBER = {"py": r"(?U)تحت\s+رقم\s*[:\-]?\s*(\d{1,10})", "js": r"تحت\s+رقم\s*[:\-]?\s*(\d{1,10}(?:[./-]\d{1,10})*)"}
FILING_NUMBER_BEFORE = r"(?<![./\d])(\d{1,10})\s+تحت\s+رقم"

# --- end of fixed values --------------------------------------------------------------------------

#: A length past the end of any array. slice() adds it to the start, so it must leave room in 32 bits.
ALL = 1_000_000_000


def none() -> Column:
    return F.array().cast("array<string>")


def null() -> Column:
    return F.lit(None).cast("string")


def any_match(c: Column, patterns: list[str], dialect: str, flags: str = "is") -> Column:
    """Whether any pattern matches the folded (or at least lower-case) text c.

    A pattern that is a literal is a substring test; any other is tried only where the text holds
    the literal that its matches need, so most texts never meet the regex engine.
    """
    out = None
    for p in patterns:
        literal, plain = rules.needed(p)
        if plain:
            hit = c.contains(literal)
        else:
            hit = c.rlike(java(p, dialect, flags))
            hit = c.contains(literal) & hit if literal else hit
        out = hit if out is None else out | hit
    return F.lit(False) if out is None else out


def let(c: Column, body: Callable[[Column], Column]) -> Column:
    """body(c), with c computed once. The body is interpreted: hundreds of rules as generated code take
    seconds to compile and gain nothing, as their time goes to searching text."""
    return F.transform(F.array(c), body)[0]


def settled(df: DataFrame, *names: str) -> DataFrame:
    """df with these columns computed at this place, last in order. What follows refers to results, not
    to expressions: fields of structs would be inlined wherever they are used, and plans that build on
    each other's structs would grow without bound."""
    rest = [F.col(f"`{c}`") for c in df.columns if c not in names]
    return df.select(*rest, F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in names]))))


def labels_of(rules_of: dict[str, list[str]], dialect: str, flags: str) -> Callable[[Column], Column]:
    """The names of the rules that match a folded text, in order. An ASCII text meets only the patterns that
    need no letter beyond ASCII."""
    latin = {name: own for name, patterns in rules_of.items() if (own := [p for p in patterns if rules.needed(p)[0].isascii()])}
    named = lambda f, of: F.array_compact(F.array(null(), *[F.when(any_match(f, patterns, dialect, flags), F.lit(name)) for name, patterns in of.items()]))
    return lambda f: F.when(text.is_ascii(f), named(f, latin)).otherwise(named(f, rules_of))


def event_types(folded: Column, pack: RulePack) -> Column:
    """Types whose rules match, in rule order, suppressed ones removed."""
    found = let(folded, labels_of(pack.events, pack.dialect, "is"))
    for present, dropped in pack.suppress:
        found = let(found, lambda t: F.when(F.array_contains(t, present), F.array_remove(t, dropped)).otherwise(t))  # noqa: B023
    return found


def has_event(folded: Column, pack: RulePack) -> Column:
    return any_match(folded, [p for patterns in pack.events.values() for p in patterns], pack.dialect)


def cities(folded: Column, pack: RulePack) -> Column:
    return let(folded, labels_of(pack.cities, pack.dialect, "i"))


def legal_form(raw: Column, folded: Column, pack: RulePack) -> Column:
    upper = F.upper(raw)

    def first(forms: list[tuple[bool, str, str]], test: Callable[[Column, str], Column]) -> Column:
        out = null()
        for latin, pattern, form in reversed(forms):
            out = F.when(test(upper if latin else folded, pattern), F.lit(form)).otherwise(out)
        return out

    # an ASCII text meets only the patterns that need no letter beyond ASCII, and those where their literal is
    near = [f for f in pack.forms if rules.needed(f[1])[0].isascii()]
    gated = lambda c, p: (c.contains(lit.upper()) | c.contains(lit)) & c.rlike(java(p, pack.dialect)) if (lit := rules.needed(p)[0]) else c.rlike(java(p, pack.dialect))
    ascii_only = text.is_ascii(raw) & text.is_ascii(folded)
    return F.when(ascii_only, first(near, gated)).otherwise(first(pack.forms, lambda c, p: c.rlike(java(p, pack.dialect))))


def suspect_font(folded: Column, pack: RulePack) -> Column:
    """Two different marker terms or more."""
    count = F.lit(0)
    for term in pack.suspect:
        count = count + folded.contains(term).cast("int")
    return count >= 2


def first_where(items: Column, test: Callable[[Column], Column]) -> Column:
    return F.coalesce(F.array_position(F.transform(items, lambda x: F.coalesce(test(x), F.lit(False))), True), F.lit(0)).cast("int")


def last_where(items: Column, test: Callable[[Column], Column]) -> Column:
    hits = F.filter(F.transform(items, lambda x, i: F.when(test(x), i + 1)), lambda i: i.isNotNull())
    return F.coalesce(F.try_element_at(hits, F.lit(-1)), F.lit(0)).cast("int")


def at(items: Column, i: Column) -> Column:
    """Element i, null outside (index 0 included)."""
    return F.try_element_at(items, F.when(i > 0, i))


def run_from(items: Column, start: Column, count: Column) -> Column:
    return F.slice(items, F.greatest(start, F.lit(1)), F.greatest(count, F.lit(0)))


def until(items: Column, stop: Column) -> Column:
    """Items before position `stop` (0: all)."""
    return F.when(stop == 0, items).otherwise(F.slice(items, F.lit(1), F.greatest(stop - 1, F.lit(0))))


def after_colon(line: Column, dialect: str) -> Column:
    """What follows the first colon (js: up to the second); null without one."""
    rest = F.regexp_extract(line, r"(?s)\A[^:]*:(.*)\z" if dialect == "py" else r"(?s)\A[^:]*:([^:]*)", 1)
    return F.when(line.contains(":"), rest)


def some(c: Column) -> Column:
    """One-element array of a non-empty value, else the empty array."""
    return F.when(F.coalesce(c != "", F.lit(False)), F.array(c)).otherwise(none())


def trimmed(c: Column, chars: str = text.TRIM) -> Column:
    return F.btrim(c, F.lit(chars))


# --- company name -----------------------------------------------------------------------------

NAME_SHAPE = r"\A[A-Za-zÀ-ÖØ-öø-ÿ0-9&'()./+\- ]{2,100}\z"


def valid_arabic_name(c: Column) -> Column:
    folded = text.fold(c)
    return F.coalesce(F.length(c).between(2, 100) & text.has_arabic(c) & ~folded.rlike("|".join(rules.NOT_NAMES)), F.lit(False))


def candidates(lines: Column) -> Column:
    """Upper-case Latin lines that may be names: array of struct(value, at)."""

    def eligible(x: Column) -> Column:
        upper = F.coalesce(text.uppercase_ratio(x), F.lit(0.0)) >= 0.75
        return x.rlike(NAME_SHAPE) & ~F.upper(x).isin(*rules.GENERIC_LINES) & ~x.rlike(r"\A\d+\s*[A-Z]\z") & upper

    # a line in lower case has no capital letter of NAME_SHAPE, and meets no pattern
    shaped = F.transform(lines, lambda x, i: F.when(F.lower(x) != x, F.struct(trimmed(F.regexp_replace(x, r"\s+", " ")).alias("value"), (i + 1).alias("at"))))
    return F.filter(shaped, lambda c: F.coalesce(c.isNotNull() & eligible(c["value"]), F.lit(False)))


def company_name(lines: Column, folded: Column, found: Column, pack: RulePack) -> Column:
    """Best of the candidates `found` by frequency, legal form and event context; else the Arabic
    name that follows a name label. Only lines beside a candidate are tested for forms and events."""

    def formed(i: Column) -> Column:
        return F.coalesce(legal_form(at(lines, i), at(folded, i), pack).isNotNull(), F.lit(False)).cast("int")

    def eventful(i: Column) -> Column:
        return F.coalesce(has_event(at(folded, i), pack), F.lit(False)).cast("int")

    def ranked(c: Column) -> Column:
        times = F.size(F.filter(found, lambda o: o["value"] == c["value"]))
        score = times * 2 + formed(c["at"]) * 5 + formed(c["at"] + 1) * 7 + eventful(c["at"] - 1) * 4 + eventful(c["at"] + 1) * 3
        only = F.regexp_replace(F.upper(c["value"]), "[^A-Z]", "").isin("SARL", "SARLAU", "SA", "SAS")
        plain = (~only).cast("int") if pack.dialect == "py" else F.lit(1)
        return F.struct(score.alias("s"), plain.alias("p"), F.length(c["value"]).alias("n"), (-c["at"]).alias("o"), c["value"].alias("value"))

    best = F.when(F.size(found) == 1, found[0]["value"]).otherwise(F.array_max(F.transform(found, ranked))["value"])

    def named(i: Column) -> Column:
        own = text.strip(F.coalesce(after_colon(at(lines, i), pack.dialect), F.lit("")))
        following = at(lines, i + 1)
        following = trimmed(following) if pack.dialect == "py" else following
        return F.when(valid_arabic_name(own), own).when(valid_arabic_name(following), following)

    labels = F.filter(F.transform(folded, lambda x, i: F.when(x.contains(NAME_LABEL), i + 1)), lambda i: i.isNotNull())
    arabic = F.try_element_at(F.filter(F.transform(labels, named), lambda v: v.isNotNull()), F.lit(1))
    return F.coalesce(best, arabic)


# --- numbers and dates --------------------------------------------------------------------------


def plausible_register(value: Column, pack: RulePack) -> Column:
    n = value.try_cast("bigint")
    ok = (n > 31) & ~n.between(1900, 2100)
    return F.coalesce(ok & ~n.isin(*pack.not_registers) if pack.not_registers else ok, F.lit(False))


def register_number(lines: Column, folded: Column, name: Column, pack: RulePack) -> Column:
    joined = F.array_join(lines, "\n")
    js = pack.dialect == "js"
    arabic, latin = (F.nullif(F.regexp_extract(joined, ("(?isu)" if js else "(?iuU)") + p, 1), F.lit("")) for p in REGISTER[pack.dialect])
    direct = F.array(F.when(~text.is_ascii(joined), arabic), latin)
    direct = F.try_element_at(F.filter(direct, lambda v: plausible_register(v, pack) if js else v.isNotNull()), F.lit(1))
    first = F.greatest(first_where(lines, lambda x: x.contains(name)), F.lit(1))
    rest = F.slice(lines, first + 1, F.lit(ALL))
    dated = first_where(rest, lambda x: x.rlike(r"20\d{2}"))
    window = F.when(dated > 0, until(rest, dated)).otherwise(F.slice(rest, F.lit(1), F.lit(29)))
    bent = F.slice(folded, first + 1, F.greatest(F.size(window), F.lit(0)))

    def candidate(line: Column, i: Column) -> Column:
        value = F.nullif(F.regexp_extract(line, r"\A\D*(\d{2,10})\D*\z", 1), F.lit(""))
        context = F.slice(bent, F.greatest(i - 1, F.lit(1)), F.least(i + 1, F.lit(3)))
        joined_context = F.array_join(context, " ")
        if js:
            labelled = joined_context.rlike(REGISTER_CONTEXT)
        else:
            labelled = F.exists(context, lambda x: x.startswith(NUMBER_LABEL)) | joined_context.contains(REGISTER_WORDS[0]) | joined_context.contains(REGISTER_WORDS[1])
        return F.when(plausible_register(value, pack) & labelled, F.struct(value.try_cast("bigint").alias("n"), (-i).alias("o"), value.alias("v")))

    near = F.array_max(F.filter(F.transform(window, candidate), lambda c: c.isNotNull()))["v"]
    return F.coalesce(direct, F.when(name.isNotNull(), near))


def iso_date(year: Column, month: Column, day: Column) -> Column:
    """yyyy-mm-dd if the month is 1-12 and the day 1-31; the calendar is not asked."""
    ok = month.try_cast("int").between(1, 12) & day.try_cast("int").between(1, 31)
    return F.when(ok, F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")))


def every(c: Column, pattern: str, parts: int) -> Column:
    """Array of structs g1..gn for every match of the pattern: one scan finds the matches, and each
    is then taken apart on its own, so the pattern must match its own matches in the same way."""
    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    return F.transform(found, lambda m: F.struct(*[F.regexp_extract(m, pattern, i).alias(f"g{i}") for i in range(1, parts + 1)]))


def month_number(name: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for m, n in rules.MONTHS.items() for x in (m, str(n))]), F.lower(name))


def dates(normal: Column, folded: Column, pack: RulePack) -> Column:
    """Distinct ISO dates by family of pattern: numeric first, then with month names."""
    months = "|".join(sorted(rules.MONTHS, key=len, reverse=True))
    js = pack.dialect == "js"
    out = []
    if js:
        # beside digits an edge is no word character on the other side; it is asked behind the first digits
        spaced = F.when(text.is_ascii(normal), F.regexp_replace(normal, rf"(?:{text.ASCII_SPACES})?([./-])(?:{text.ASCII_SPACES})?", "$1")).otherwise(F.regexp_replace(normal, r"(?U)\s*([./-])\s*", "$1"))
        tight = F.when(normal.contains("20"), spaced).otherwise(F.lit(""))
        ymd = every(tight, r"(20(?<![A-Za-z0-9_]20)\d{2})[./-](\d{1,2})[./-](\d{1,2})(?![A-Za-z0-9_])", 3)
        dmy = every(tight, r"(\d(?<![A-Za-z0-9_]\d)\d?)[./-](\d{1,2})[./-](20\d{2})(?![A-Za-z0-9_])", 3)
        out += [F.transform(ymd, lambda d: iso_date(d["g1"], d["g2"], d["g3"])), F.transform(dmy, lambda d: iso_date(d["g3"], d["g2"], d["g1"]))]
    else:
        tight = F.regexp_replace(normal, r"(?U)\s*/\s*", "/")
        out.append(F.transform(every(tight, r"(20\d{2})/(\d{1,2})/(\d{1,2})", 3), lambda d: iso_date(d["g1"], d["g2"], d["g3"])))
    edge, flags = (ASCII_EDGE, "(?iu)") if js else (r"\b", "(?uU)")
    # an ASCII text without the name of a month meets no pattern of them
    named = F.lit(False)
    for m in rules.MONTHS:
        named = named | folded.contains(m) if m.isascii() else named
    folded = F.when(text.is_ascii(folded) & ~named, F.lit("")).otherwise(folded)
    ymd = every(folded, rf"{flags}{edge}(20\d{{2}})\s*({months})\s*([0-3]?\d)(?!\d)", 3)
    dmy = every(folded, rf"{flags}{edge}([0-3]?\d)\s*({months})\s*(20\d{{2}})(?!\d)", 3)
    out += [F.transform(ymd, lambda d: iso_date(d["g1"], month_number(d["g2"]), d["g3"])), F.transform(dmy, lambda d: iso_date(d["g3"], month_number(d["g2"]), d["g1"]))]
    return F.array_distinct(F.array_compact(F.concat(*out)))


def capital(normal: Column) -> Column:
    """Capital in dirhams; all non-digits of the amount go, decimals included."""
    found = []
    for p in CAPITAL:
        amount = F.regexp_extract(normal, p, 1)
        digits = F.regexp_replace(amount if p.isascii() else F.when(~text.is_ascii(normal), amount), r"\D", "")
        found.append(F.nullif(digits, F.lit("")).try_cast("decimal(20,0)").try_cast("bigint"))
    return F.coalesce(*found)


# --- labelled blocks ------------------------------------------------------------------------------


def is_label(folded: Column, dialect: str) -> Column:
    terms = rules.STOP_LABELS + (JS_STOP_LABELS if dialect == "js" else [])
    out = folded.startswith(NUMBER_LABEL)
    for term in terms:
        out = out | folded.contains(term)
    return out


def field_block(lines: Column, folded: Column, test: Callable[[Column], Column], following: int, dialect: str) -> Column:
    """The first labelled line's own value with up to `following` lines, to the next label."""
    i = first_where(folded, test)
    own = F.coalesce(after_colon(at(lines, i), dialect), F.lit(""))
    own = trimmed(text.strip(own), " -") if dialect == "py" else text.strip(F.regexp_replace(text.strip(own), r"\A-+", ""))
    stop = first_where(F.slice(folded, i + 1, F.lit(following)), lambda x: is_label(x, dialect))
    rest = until(F.slice(lines, i + 1, F.lit(following)), stop)
    value = F.array_join(F.concat(some(own), rest), " ")
    value = F.nullif(trimmed(value), F.lit("")) if dialect == "py" else text.clean_field(value)
    return F.when(i > 0, value)


def registered_address(lines: Column, folded: Column, dialect: str) -> Column:
    label = ADDRESS_LABEL[dialect]
    return field_block(lines, folded, lambda x: x.contains(label), 3, dialect)


def business_purpose(lines: Column, folded: Column, dialect: str) -> Column:
    if dialect == "py":
        return field_block(lines, folded, lambda x: x.contains(PURPOSE_WORDS[0]) & x.contains(PURPOSE_WORDS[1]), 8, dialect)
    return field_block(lines, folded, lambda x: x.rlike(PURPOSE), 8, dialect)


def branch_address(lines: Column, folded: Column, dialect: str) -> Column:
    if dialect == "py":
        begins = lambda x: x.rlike(BRANCH_PLACE["py"])
        start = last_where(folded, lambda x: x.contains(BRANCH_EVENT["py"]))
        ahead, bent = F.slice(lines, start + 1, F.lit(11)), F.slice(folded, start + 1, F.lit(11))
        stop = first_where(bent, lambda x: x.rlike(BRANCH_END["py"]))
        ahead, bent = until(ahead, stop), until(bent, stop)
        suffix = lambda line: some(trimmed(text.strip(F.coalesce(after_colon(line, "py"), F.lit(""))), " -"))
        t = first_where(bent, begins)
        inside = F.when(t > 0, F.concat(suffix(at(ahead, t)), F.slice(ahead, t + 1, F.lit(20)))).otherwise(none())
        values = F.when(begins(at(folded, start)), F.concat(suffix(at(lines, start)), ahead)).otherwise(inside)
        return F.when(start > 0, F.nullif(trimmed(F.array_join(values, " ")), F.lit("")))
    begins = lambda x: x.rlike(BRANCH_PLACE["js"])
    start = last_where(folded, lambda x: x.rlike(BRANCH_EVENT["js"]))
    both = F.slice(F.arrays_zip(lines.alias("l"), folded.alias("f")), F.greatest(start, F.lit(1)), F.lit(13))
    t = first_where(both, lambda x: begins(x["f"]))
    window = F.slice(both, F.greatest(t, F.lit(1)), F.lit(13))
    state = F.struct(F.lit(False).alias("over"), none().alias("v"))

    def step(acc: Column, x: Column) -> Column:
        over = acc["over"] | (x["f"].rlike(BRANCH_END["js"]) & (F.size(acc["v"]) > 0))
        own = text.strip(F.coalesce(after_colon(x["l"], "js"), x["l"]))
        return F.struct(over.alias("over"), F.when(over, acc["v"]).otherwise(F.concat(acc["v"], some(own))).alias("v"))

    values = F.aggregate(window, state, step)["v"]
    return F.when((start > 0) & (t > 0), text.clean_field(F.array_join(values, " ")))


def manager(lines: Column, folded: Column, dialect: str) -> Column:
    """Manager or liquidator named in the first line that gives one."""
    at_lines = F.arrays_zip(lines.alias("l"), folded.alias("f"), F.slice(F.concat(lines, F.array(null())), F.lit(2), F.greatest(F.size(lines), F.lit(1))).alias("next"))
    if dialect == "py":

        def person(x: Column) -> Column:
            v = x["l"]
            for p in BEFORE_PERSON:
                v = F.regexp_replace(v, p, "")
            v = trimmed(F.when((F.length(trimmed(v)) < 3) & x["next"].isNotNull(), x["next"]).otherwise(v))
            bad = v.rlike(r"(?U)\b\d{5}\b") | text.fold(v).rlike(NO_PERSON)
            return F.when(x["f"].rlike(MANAGER_LINE["py"]) & ~bad, F.struct(F.nullif(v, F.lit("")).alias("v")))

        return F.try_element_at(F.filter(F.transform(at_lines, person), lambda p: p.isNotNull()), F.lit(1))["v"]
    named = F.transform(lines, lambda x: F.when(x.contains(LIQUIDATOR), text.strip(F.regexp_replace(F.regexp_extract(x, PERSON, 1), r"\s+", " "))))
    liquidator = F.try_element_at(F.filter(named, lambda v: F.length(v) >= 3), F.lit(1))

    def words(x: Column) -> Column:
        all_words = F.regexp_extract_all(F.concat_ws(" ", x["l"], x["next"]), F.lit(ARABIC_WORD), F.lit(1))
        kept = F.filter(all_words, lambda w: ~text.fold(w).isin(*NAME_STOPS) & ~text.fold(w).rlike(NAME_PARTS))
        last = F.slice(kept, F.greatest(F.size(kept) - 3, F.lit(1)), F.lit(4))
        v = text.strip(F.regexp_replace(F.array_join(last, " "), r"[.,:;\-]+\z", ""))
        return F.when(x["f"].rlike(MANAGER_LINE["js"]) & (F.length(v) >= 3) & ~v.rlike(r"\b\d{5}\b"), v)

    return F.coalesce(liquidator, F.try_element_at(F.filter(F.transform(at_lines, words), lambda v: v.isNotNull()), F.lit(1)))


def valid_filing(v: Column) -> Column:
    n = v.try_cast("bigint")
    return F.coalesce(v.rlike(r"\A\d{1,10}(?:[./-]\d{1,10})+\z") | ((n > 0) & ~n.between(1900, 2100)), F.lit(False))


def filing_of(found: Column) -> Column:
    """filing() of a text without a court or a label of filing."""
    return F.struct(null().alias("court"), F.when(F.size(found) > 1, F.try_element_at(found, F.lit(-1))).alias("date"), null().alias("number"))


def filing(lines: Column, folded: Column, found: Column, dialect: str) -> Column:
    """struct(court, date, number): the last court line, the last date of several, the number by its label."""
    date = F.when(F.size(found) > 1, F.try_element_at(found, F.lit(-1)))
    if dialect == "py":
        both = F.arrays_zip(lines.alias("l"), folded.alias("f"))
        c = last_where(both, lambda x: x["f"].contains(COURT_WORDS[0]) | x["l"].contains(COURT_WORDS[1]))
        court = F.when(c > 0, trimmed(at(lines, c)))
        i = last_where(folded, lambda x: x.contains(FILED))
        tail = F.array_join(run_from(lines, i, F.lit(5)), " ")
        number = F.when(i > 0, F.nullif(F.regexp_extract(tail, FILING_NUMBER["py"], 1), F.lit("")))
    else:
        c = last_where(folded, lambda x: x.rlike(COURT))
        more = F.coalesce(at(lines, c + 1), F.lit(""))
        more = text.strip(F.split(more, COURT_END)[0])
        court = F.when(c > 0, text.clean_field(F.concat_ws(" ", at(lines, c), F.nullif(more, F.lit("")))))
        i = last_where(folded, lambda x: x.rlike(FILED_LINE) | (x.rlike(COURT) & x.contains(DONE)))
        tail = F.array_join(run_from(lines, i, F.lit(6)), " ")
        before = F.nullif(F.regexp_extract(tail, FILING_NUMBER_BEFORE, 1), F.lit(""))
        behind = F.nullif(F.regexp_extract(tail, FILING_NUMBER["js"], 1), F.lit(""))
        number = F.when(i > 0, F.when(valid_filing(before), before).when(valid_filing(behind), behind))
    return F.struct(court.alias("court"), date.alias("date"), number.alias("number"))


# --- identifiers ---------------------------------------------------------------------------------


def issue_number(filename: Column) -> Column:
    return F.nullif(F.regexp_extract(filename, r"(?i)BOAL[_-](\d+(?:-bis)?)", 1), F.lit(""))


def notice_reference(line: Column, digits: int = 7) -> Column:
    """The reference if the whole line is one: 1-7 digits, or as many as given, and a capital letter."""
    return F.when(line.rlike(rf"\A\s*\d{{1,{digits}}}\s*[A-Z]\s*\z"), F.regexp_replace(line, r"\s+", ""))


def strict_date(year: Column, month: Column, day: Column) -> Column:
    """yyyy-mm-dd of a real calendar day, else null."""
    v = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.when(F.try_to_date(v, "yyyy-MM-dd").isNotNull(), v)


def pdf_date(value: Column) -> Column:
    """Day of a PDF date such as D:20260429105130+01'00'."""
    g = [F.regexp_extract(value, r"(?:D:)?(\d{4})(\d{2})(\d{2})", i) for i in (1, 2, 3)]
    return F.when(g[0] != "", strict_date(*g))


def http_date(value: Column) -> Column:
    return F.date_format(F.try_to_timestamp(F.substring(value, 6, 20), F.lit("dd MMM yyyy HH:mm:ss")), "yyyy-MM-dd")


def tokens(c: Column, pattern: str) -> Column:
    """Distinct matches in first-seen order."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(f"({pattern})"), F.lit(1)))
