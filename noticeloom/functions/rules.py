"""Rule packs: the fixed tables of both dialects, compiled to Java regular expressions.

"js" is the fuller dialect and the default; "py" differs where the tables below say so. Another
deployment passes a pack of its own.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from os.path import commonprefix

DIALECTS = ("py", "js")

# --- Fixed values of the notice format; of two city patterns where one includes the other, the wider --
EVENTS = {
    "CONTINUATION_AFTER_LOSSES": [r"عدم\s+حل.*الاستمرار\s+في\s+النشاط", r"continuation\s+de\s+l.?activit"],
    "REMOVAL_FROM_REGISTER": [r"التشطيب\s+(?:النهائي\s+)?من\s+السجل\s+التجاري", r"radiation\s+(?:definitive\s+)?du\s+registre"],
    "LIQUIDATION_CLOSED": [r"(?:اغلاق|قفل|اختتام|ختم)\s+(?:ال\w+\s+)?(?:اعمال\s+)?التصفيه", r"cloture\s+(?:definitive\s+)?de\s+(?:la\s+)?liquidation"],
    "DISSOLUTION": [r"(?:حل|انحلال)(?:\s+(?:وذ|ذ|ال|لل|مسبق|مبكر)){0,3}\s+شركه", r"حل\s+الشركه\s+قبل\s+الاوان", r"dissolution\s+(?:anticipee\s+)?(?:de\s+la\s+)?societe"],
    "LIQUIDATION": [r"(?:تعيين|تسميه).{0,40}(?:مصفي|مصفية)", r"تصفيه\s+(?:لل)?شركه", r"mise\s+en\s+liquidation"],
    "BRANCH_OPENING": [r"انشاء\s+فرع", r"فتح\s+فرع", r"creation\s+d.?une\s+succursale"],
    "INCORPORATION": [r"تاسيس\s+(?:ال)?شركه", r"اعلان\s+عن\s+تاسيس", r"constitution\s+(?:d.?une\s+)?societe"],
    "BUSINESS_PURPOSE_CHANGE": [r"(?:تغيير|تعديل).{0,30}غرض\s+(?:ال)?شركه", r"modification\s+de\s+l.?objet\s+social"],
    "REGISTERED_OFFICE_CHANGE": [r"(?:تحويل|تغيير).{0,35}المقر\s+الاجتماعي", r"transfert\s+(?:du\s+)?siege\s+social"],
    "LEGAL_FORM_CHANGE": [r"تغيير\s+الشكل\s+القانوني", r"transformation\s+(?:de\s+la\s+)?forme\s+juridique"],
    "CAPITAL_CHANGE": [r"(?:رفع|زياده|تخفيض).{0,30}راسما?ل", r"(?:augmentation|reduction)\s+(?:du\s+)?capital"],
    "MANAGER_CHANGE": [r"(?:تعيين|استقاله|عزل|تغيير).{0,35}(?:مسير|مدير)", r"(?:nomination|demission|revocation).{0,30}(?:gerant|administrateur)"],
    "SHARE_TRANSFER": [r"(?:تفويت|تحويل).{0,30}(?:حصص|اسهم)", r"cession\s+(?:de\s+)?(?:parts|actions)"],
}
EVENTS_PY = {
    "DISSOLUTION": [r"(?:حل|انحلال)\s+(?:مسبق|مبكر)?\s*(?:لل)?شركه", *EVENTS["DISSOLUTION"][1:]],
    "LIQUIDATION": [EVENTS["LIQUIDATION"][0], r"تصفية\s+(?:لل)?شركه", EVENTS["LIQUIDATION"][2]],
}
CITIES = {
    "Settat": [r"سطات", r"\bsettat\b"],
    "Casablanca": [r"الدار\s+البيضاء", r"\bcasablanca\b"],
    "Rabat": [r"الرباط", r"\brabat\b"],
    "Sale": [r"سلا", r"\bsal[eé]\b"],
    "Temara": [r"تماره", r"\bt[eé]mara\b"],
    "Marrakech": [r"مراكش", r"\bmarrakech\b"],
    "Tangier": [r"طنجه", r"\btanger\b", r"\btangier\b"],
    "Tetouan": [r"تطوان", r"\bt[eé]touan\b"],
    "Fes": [r"فاس", r"\bfes\b", r"\bfez\b"],
    "Meknes": [r"مكناس", r"\bmekn[eè]s\b"],
    "Agadir": [r"اكادير", r"\bagadir\b"],
    "Inezgane": [r"انزكان", r"\binezgane\b"],
    "Ait Melloul": [r"ايت\s+ملول", r"\ba[iï]t\s+melloul\b"],
    "Kenitra": [r"القنيطره", r"\bk[eé]nitra\b"],
    "El Jadida": [r"الجديده", r"\bel\s+jadida\b"],
    "Mohammedia": [r"المحمديه", r"\bmohammedia\b"],
    "Beni Mellal": [r"بني\s+ملال", r"\bbeni\s+mellal\b"],
    "Oujda": [r"وجده", r"\boujda\b"],
    "Nador": [r"الناظور", r"\bnador\b"],
    "Berkane": [r"بركان", r"\bberkane\b"],
    "Safi": [r"اسفي", r"\bsafi\b"],
    "Khouribga": [r"خريبكه", r"\bkhouribga\b"],
    "Berrechid": [r"برشيد", r"\bberrechid\b"],
    "Benslimane": [r"بنسليمان", r"\bbenslimane\b"],
    "Bouskoura": [r"بوسكوره", r"\bbouskoura\b"],
    "Nouaceur": [r"النواصر", r"\bnouaceur\b"],
    "Mediouna": [r"مديونه", r"\bmediouna\b"],
    "Larache": [r"العرائش", r"\blarache\b"],
    "Ksar El Kebir": [r"القصر\s+الكبير", r"\bksar\s+el\s+kebir\b"],
    "Taza": [r"تازه", r"\btaza\b"],
    "Ifrane": [r"افران", r"\bifrane\b"],
    "Khenifra": [r"خنيفـ?ره", r"\bkhenifra\b"],
    "Errachidia": [r"الرشيديه", r"\berrachidia\b"],
    "Ouarzazate": [r"ورزازات", r"\bouarzazate\b"],
    "Essaouira": [r"الصويره", r"\bessaouira\b"],
    "Taroudant": [r"تارودانت", r"\btaroudant\b"],
    "Tiznit": [r"تزنيت", r"\btiznit\b"],
    "Guelmim": [r"كلميم", r"\bguelmim\b"],
    "Laayoune": [r"العيون", r"\blaa?youne\b"],
    "Dakhla": [r"الداخله", r"\bdakhla\b"],
    "Sidi Kacem": [r"سيدي\s+قاسم", r"\bsidi\s+kacem\b"],
    "Sidi Slimane": [r"سيدي\s+سليمان", r"\bsidi\s+slimane\b"],
    "Ouezzane": [r"وزان", r"\bouezzane\b"],
    "Chefchaouen": [r"شفشاون", r"\bchefchaouen\b"],
    "Al Hoceima": [r"الحسيمه", r"\bal\s+hoceima\b"],
    "Benguerir": [r"بنجرير", r"\bbenguerir\b"],
    "Youssoufia": [r"اليوسفيه", r"\byoussoufia\b"],
}
CITIES_PY = {
    "Settat": [r"سطات", r"\bsettat\b"],
    "Casablanca": [r"الدار\s+البيضاء", r"\bcasablanca\b"],
    "Rabat": [r"\bالرباط\b", r"\brabat\b"],
    "Marrakech": [r"\bمراكش\b", r"\bmarrakech\b"],
    "Tangier": [r"\bطنجه\b", r"\btanger\b", r"\btangier\b"],
    "Fes": [r"\bفاس\b", r"\bfes\b", r"\bfez\b"],
    "Meknes": [r"\bمكناس\b", r"\bmeknes\b"],
    "Agadir": [r"\bاكادير\b", r"\bagadir\b"],
    "Kenitra": [r"\bالقنيطره\b", r"\bkenitra\b"],
    "El Jadida": [r"الجديده", r"\bel\s+jadida\b"],
    "Mohammedia": [r"المحمديه", r"\bmohammedia\b"],
    "Beni Mellal": [r"بني\s+ملال", r"\bbeni\s+mellal\b"],
    "Oujda": [r"\bوجده\b", r"\boujda\b"],
    "Safi": [r"\bاسفي\b", r"\bsafi\b"],
    "Khouribga": [r"\bخريبكه\b", r"\bkhouribga\b"],
    "Berrechid": [r"\bبرشيد\b", r"\bberrechid\b"],
}
MONTHS = {
    "يناير": 1, "فبراير": 2, "مارس": 3, "ابريل": 4, "ماي": 5, "يونيو": 6, "يوليوز": 7, "غشت": 8, "شتنبر": 9, "اكتوبر": 10, "نونبر": 11, "دجنبر": 12,
    "janvier": 1, "fevrier": 2, "mars": 3, "avril": 4, "mai": 5, "juin": 6, "juillet": 7, "aout": 8, "septembre": 9, "octobre": 10, "novembre": 11, "decembre": 12,
}
LATIN_SARL_AU = r"\bS\.?\s*A\.?\s*R\.?\s*L\.?\s*A\.?\s*U\.?\b|\bSARLAU\b|\bSARL\s+AU\b"
LATIN_SARL = r"\bS\.?\s*A\.?\s*R\.?\s*L\.?\b|\bSARL\b"
LATIN_SAS = r"\bS\.?\s*A\.?\s*S\.?\b|\bSAS\b"
LATIN_SA = r"\bS\.?\s*A\.?\b|\bSA\b"
#: (matches upper-cased text rather than folded, pattern, form); the first that matches decides.
FORMS_PY = [
    (True, LATIN_SARL_AU, "SARL AU"),
    (True, LATIN_SARL, "SARL"),
    (True, LATIN_SAS, "SAS"),
    (True, LATIN_SA, "SA"),
    (False, r"شركه\s+ذات\s+مسووليه\s+محدوده.{0,40}(?:ال)?شريك\s+(?:ال)?وحيد", "SARL AU"),
    (False, r"شركه\s+لوت\s+مسواذيه\s+مح.{0,40}وذشريك\s+وذوحي", "SARL AU"),
    (False, r"شركه\s+ذات\s+مسووليه\s+محدوده", "SARL"),
    (False, r"شركه\s+لوت\s+مسواذيه\s+مح", "SARL"),
    (False, r"شركه\s+مساهمه", "SA"),
]
FORMS = [
    (True, LATIN_SARL_AU, "SARL AU"),
    (False, r"(?:شركه|شركة).{0,140}(?:شريك).{0,35}(?:وحيد|وحي)", "SARL AU"),
    (False, r"(?:وحيد|وحي).{0,35}(?:شريك).{0,140}(?:شركه|شركة)", "SARL AU"),
    (True, LATIN_SARL, "SARL"),
    (True, LATIN_SAS, "SAS"),
    (True, LATIN_SA, "SA"),
    (False, r"شركه.{0,70}(?:مسووليه|مسؤوليه|مسؤلو|مسواذيه|محاذ)", "SARL"),
    (False, r"(?:مسووليه|مسؤوليه|مسؤلو|مسواذيه|محاذ).{0,70}شركه", "SARL"),
    (False, r"شركه\s+مساهمه", "SA"),
]
GENERIC_LINES = ["SARL", "SARLAU", "SARL AU", "S.A.R.L", "S.A.R.L.AU", "SA", "S.A", "SAS", "RC", "ICE", "MAROC", "MOROCCO"]
SUSPECT = ["وذشريك", "وذوحي", "مسواذيه", "مسؤلو", "محاذ", "شريكوذ", "وحيوذ"]
SUSPECT_PY = ["وذشريك", "وذوحي", "مسواذيه", "لوت"]
NOT_NAMES = ["تسميتها", "تسميه", "مختصر", "الاقتضاء", "متبوعه"]
STOP_LABELS = ["السجل التجاري", "غرض الشركه", "راس مال", "راسمال", "بمقتضي", "تم الايداع", "انشاء فرع", "تاسيس شركه", "حل الشركه", "حل شركه"]
LABELS = {
    "CONTINUATION_AFTER_LOSSES": "Continuation after losses", "REMOVAL_FROM_REGISTER": "Removal from register", "LIQUIDATION_CLOSED": "Liquidation closed",
    "DISSOLUTION": "Dissolution", "LIQUIDATION": "Liquidation", "BRANCH_OPENING": "Branch opening", "INCORPORATION": "Incorporation",
    "BUSINESS_PURPOSE_CHANGE": "Business purpose change", "REGISTERED_OFFICE_CHANGE": "Registered office change", "LEGAL_FORM_CHANGE": "Legal form change",
    "CAPITAL_CHANGE": "Capital change", "MANAGER_CHANGE": "Manager change", "SHARE_TRANSFER": "Share transfer",
}
# --- end of fixed values -----------------------------------------------------------------------

ASCII_EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def java(pattern: str, dialect: str, flags: str = "is") -> str:
    """A pattern of the dialect as a Java one: py classes and edges are Unicode, js ones ASCII. An edge before a
    letter or digit is asked behind it, so that most places of a text are passed over by the letter alone."""
    if dialect == "py":
        return f"(?{flags}uU){pattern}"
    behind = re.sub(r"\\b([A-Za-z0-9])(?![?*+{])", r"\1(?<![A-Za-z0-9_]\1)", pattern)
    return f"(?{flags}u)" + behind.replace(r"\b", ASCII_EDGE)


TOKEN = re.compile(r"\(\?:[^()\[\]\\.?*+{}]+\)(?![?*+{])|\\s\+|\\.|\[(?:\\.|[^\]])*\]|[()|]|\{\d*,?\d*\}|[?*+]|.", re.S)


def needed(pattern: str) -> tuple[str, bool]:
    """The longest literal that every match of a pattern holds in folded text, where all white space is
    single spaces, and whether the pattern is that literal and nothing else. ("", False): none known.

    Only what stands outside groups, classes and alternatives counts, and how all words of a group of plain
    words begin; a quantified letter does not count.
    """
    runs, plain, depth, letter = [""], True, 0, False
    for token in TOKEN.findall(pattern):
        if token.startswith("(?:") and not depth:
            runs[-1] += commonprefix(token[3:-1].split("|"))
        elif token.startswith("(?:"):
            continue
        elif token in "()":
            depth += 1 if token == "(" else -1
        elif depth:
            continue
        elif token == "|":
            return "", False
        elif token == r"\s+":
            runs[-1] += " "
            letter = False
            continue
        elif token in (r"\b", "^", "$"):
            plain = letter = False
            continue
        elif len(token) == 1 and token not in ".?*+" or len(token) == 2 and token[0] == "\\" and not token[1].isalnum():
            runs[-1] += token[-1]
            letter = True
            continue
        elif letter and token[0] in "?*+{":
            runs[-1] = runs[-1][:-1]
        runs.append("")
        plain = letter = False
    return max(runs, key=len).lower(), plain


@dataclass(frozen=True)
class RulePack:
    dialect: str
    events: dict[str, list[str]]
    cities: dict[str, list[str]]
    forms: list[tuple[bool, str, str]]
    suspect: list[str]
    #: (if this type is present, drop that one)
    suppress: tuple[tuple[str, str], ...] = (("CONTINUATION_AFTER_LOSSES", "DISSOLUTION"),)
    #: numbers that are no register: a postal code
    not_registers: tuple[int, ...] = ()
    #: the most digits of a reference and of a printed page, and the number from which a page of text has none
    reference_digits: int = 7
    page_digits: int = 6
    pages_below: int = 100_000


def pack(dialect: str = "js") -> RulePack:
    if dialect not in DIALECTS:
        raise ValueError(f"dialect must be one of {DIALECTS}")
    if dialect == "py":
        return RulePack("py", EVENTS | EVENTS_PY, CITIES_PY, FORMS_PY, SUSPECT_PY)
    return RulePack("js", EVENTS, CITIES, FORMS, SUSPECT, not_registers=(26000,))
