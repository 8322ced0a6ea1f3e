"""Normalisation of names, addresses, dates and identifiers as column expressions; no Python runs on executors."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Romanisation of Cyrillic.
CYRILLIC = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z", "и": "i", "й": "y", "к": "k",
    "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts",
    "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya", "і": "i", "ї": "yi", "є": "ye", "ґ": "g",
}
# Romanisation of Arabic.
ARABIC = {
    "ا": "a", "ب": "b", "ت": "t", "ث": "th", "ج": "j", "ح": "h", "خ": "kh", "د": "d", "ذ": "dh", "ر": "r", "ز": "z", "س": "s",
    "ش": "sh", "ص": "s", "ض": "d", "ط": "t", "ظ": "z", "ع": "a", "غ": "gh", "ف": "f", "ق": "q", "ك": "k", "ل": "l", "م": "m",
    "ن": "n", "ه": "h", "و": "w", "ي": "y", "ى": "a", "ء": "", "أ": "a", "إ": "i", "آ": "a", "ة": "h", "ّ": "",
}
# Tokens that denote a legal form.
LEGAL_FORMS = """ltd limited llc lc plc llp lp inc incorporated corp corporation co company gmbh ag sa sas sarl bv nv spa srl as ab oy
aps pte pty kk ooo oao pao zao ibc fze fzc fzco dmcc sociedad anonima aktiengesellschaft besloten vennootschap exempted bvi
business public free zone establishment""".split()
# Address tokens without evidence.
ADDRESS_STOP = "suite floor unit office po box level room building house tower street st road rd avenue ave lane drive the of and".split()
# Sound codes by letter, and the folds of a first letter.
SOUNDS = {"1": "bfpvw", "2": "cgjkqsxz", "3": "dt", "4": "l", "5": "mn", "6": "r"}
FIRST_FOLDS = {"w": "v", "c": "k", "y": "i", "j": "i", "q": "k", "x": "s"}


def _accents() -> dict[str, str]:
    """Precomposed Latin letters and their bases, from the Unicode tables."""
    found = {}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if unicodedata.category(c) != "Mn")
        if len(base) == 1 and base != chr(code):
            found[chr(code)] = base
    return found


def transliterate(text: Column) -> Column:
    """Cyrillic and Arabic letters romanised (in lower case), accents removed; other letters as they are. Null is empty.

    Text that is all ASCII, and text without letters of several romanised ones, skips what it doesn't need."""
    table = {**CYRILLIC, **{k.upper(): v for k, v in CYRILLIC.items()}, **ARABIC}
    long = {k: v for k, v in table.items() if len(v) > 1}
    short = {**_accents(), **{k: v for k, v in table.items() if len(v) == 1}}
    gone = [k for k, v in table.items() if not v]
    plain = F.coalesce(text, F.lit(""))
    spelled = plain
    for k, v in long.items():
        spelled = F.replace(spelled, F.lit(k), F.lit(v))
    spelled = F.when(plain.rlike("[" + "".join(long) + "]"), spelled).otherwise(plain)
    out = F.regexp_replace(F.translate(spelled, "".join([*short, *gone]), "".join(short.values())), r"\p{Mn}", "")
    return F.when(plain.rlike(r"[^\x00-\x7F]"), out).otherwise(plain)


def _cleaned(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(transliterate(text)), "[^a-z0-9]+", " "))


def _tokens(text: Column) -> Column:
    return F.array_remove(F.split(text, " "), "")


def normalize_name(name: Column, drop_legal_forms: bool = True) -> Column:
    """Lower-case latin words; runs of single letters are joined; legal forms go, unless nothing would be left."""
    merged = F.regexp_replace(_cleaned(name), "(?<=\\b[a-z]) (?=[a-z]\\b)", "")
    if not drop_legal_forms:
        return merged
    kept = F.array_join(F.filter(_tokens(merged), lambda t: ~t.isin(LEGAL_FORMS)), " ")
    return F.when(kept == "", merged).otherwise(kept)


def name_tokens(name: Column) -> Column:
    return _tokens(normalize_name(name))


def significant_tokens(name: Column, min_length: int = 3) -> Column:
    return F.filter(name_tokens(name), lambda t: F.length(t) >= min_length)


def normalize_address(address: Column) -> Column:
    return F.array_join(F.filter(_tokens(_cleaned(address)), lambda t: ~t.isin(ADDRESS_STOP) & ~t.rlike("^[0-9]+$")), " ")


def address_tokens(address: Column) -> Column:
    return F.array_distinct(_tokens(normalize_address(address)))


def soundex(token: Column) -> Column:
    """A sound code of a lower-case latin token: a folded first letter and three digits. Only letters count; h is skipped,
    vowels part equal codes, and the first letter is coded as folded. A token without letters has an empty code."""
    folds = "".join(FIRST_FOLDS)
    letters = F.regexp_replace(F.coalesce(token, F.lit("")), "[^a-z]", "")
    first = F.translate(F.substring(letters, 1, 1), folds, "".join(FIRST_FOLDS.values()))
    sounding = F.concat(first, F.replace(F.substring(letters, 2, 10_000), F.lit("h"), F.lit("")))
    coded = F.translate(sounding, "".join(SOUNDS.values()), "".join(k * len(v) for k, v in SOUNDS.items()))
    coded = F.regexp_replace(F.regexp_replace(coded, "[^1-6]", "0"), r"(\d)\1+", "$1")
    code = F.rpad(F.substring(F.replace(F.substring(coded, 2, 10_000), F.lit("0"), F.lit("")), 1, 3), 3, "0")
    return F.when(letters == "", "").otherwise(F.concat(F.upper(first), code))


def phonetic_key(name: Column) -> Column:
    """The sorted sound codes of the significant tokens; tokens without letters have none."""
    return F.array_join(F.array_sort(F.array_remove(F.transform(significant_tokens(name), soundex), "")), "-")


def normalize_birth_date(value: Column) -> Column:
    """Year, month and day as far as they are published; anything else is empty."""
    return F.regexp_extract(F.trim(F.coalesce(value, F.lit(""))), r"^\d{4}(?:-\d{2})?(?:-\d{2})?", 0)


def normalize_jurisdiction(value: Column) -> Column:
    return F.substring(F.upper(F.trim(F.coalesce(value, F.lit("")))), 1, 2)


def normalize_identifier(value: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), "[^a-z0-9]+", "")
