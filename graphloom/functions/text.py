"""Normalisers and text predicates as column expressions, evaluated in the JVM."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


_ASCII = r"^[\x00-\x7F]*$"
_PAIR, _HAS = "\ue000", "\ue001"


def _foldable() -> Iterator[str]:
    """The characters beyond ASCII that have any decomposition, case or combining class, but for Hangul syllables, which stay."""
    for a, b in ((0x80, 0x3400), (0xA000, 0xAC00), (0xF900, 0x20000), (0x2F800, 0x2FA20)):  # between them are ideographs, surrogates and private characters
        yield from map(chr, range(a, b))


def _characters(of) -> tuple[str, str, dict[str, str]]:
    """What `of` changes among all characters beyond ASCII: pairs for translate, and those that become several."""
    one_from, one_to, more = [], [], {}
    for c in _foldable():
        s = of(c)
        if len(s) == 1 and s != c:
            one_from.append(c), one_to.append(s)
        elif len(s) > 1:
            more[c] = s
    return "".join(one_from), "".join(one_to), more


def _class(chars) -> str:
    """A character class for Java's regular expressions."""
    ranges: list[list[int]] = []
    for code in sorted(map(ord, chars)):
        if ranges and ranges[-1][1] == code - 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]"


def _looked_up(s: Column, pieces: str, table: dict[str, str]) -> Column:
    """Each piece of s, by what the table has for it."""
    known = F.str_to_map(F.lit(_PAIR.join(f"{k}{_HAS}{v}" for k, v in table.items())), F.lit(_PAIR), F.lit(_HAS))  # a constant, folded by the optimizer
    return F.array_join(F.transform(F.regexp_extract_all(s, F.lit(pieces), F.lit(0)), lambda p: F.coalesce(F.element_at(known, p), p)), "")


@lru_cache(1)
def _folds() -> tuple[str, str, dict[str, str], str]:
    def of(c: str) -> str:
        return "".join(x for x in unicodedata.normalize("NFKD", c).casefold() if x.isascii() and x.isalnum()) or c

    a, b, more = _characters(of)
    return a, b, more, _class(more)


def ascii_fold(c: Column | str) -> Column:
    """Lower case, each character that has ASCII letters or digits in its compatibility decomposition replaced by those; other characters stay. Texts that are ASCII anyway, which most are, take one look and lower()."""
    a, b, more, some = _folds()
    s = col(c)
    single = F.lower(F.translate(s, a, b))
    several = F.lower(F.translate(_looked_up(s, r"(?s).", more), a, b))
    return F.when(s.rlike(_ASCII), F.lower(s)).when(s.rlike(some), several).otherwise(single)


def fold_id(c: Column | str) -> Column:
    """The generic identity fold: trimmed, compatibility-decomposed, case-folded, only a-z and 0-9 left; null is ''."""
    return F.coalesce(F.regexp_replace(ascii_fold(col(c).cast("string")), "[^a-z0-9]", ""), F.lit(""))


def fold_number(c: Column | str) -> Column:
    """fold_id of a whole number: its digits."""
    return F.coalesce(F.translate(col(c).cast("string"), "-", ""), F.lit(""))


def squash(c: Column | str) -> Column:
    """Only the ASCII letters and digits, lower-cased, without decomposition."""
    return F.regexp_replace(F.lower(col(c)), "[^a-z0-9]", "")


def normalize_name(c: Column | str) -> Column:
    """The entity name form: accents stripped, a leading article and possessive 's dropped, words joined by _ in upper case. Null is ''."""
    a, b, more, some = _name_folds()
    s = col(c)
    plain = lambda x: F.translate(F.translate(x, _marks(), ""), a, b)
    s = F.when(s.rlike(_ASCII), s).when(s.rlike(some), plain(_looked_up(s, r"(?s).", more))).otherwise(plain(s))
    s = F.regexp_replace(s, r"^\s+|\s+$", "")
    s = F.trim(F.regexp_replace(s, "^(?:The |the |A |a |An |an )", ""))
    s = F.when(s.rlike("^(?:[Tt]he|[Aa]|[Aa]n)$"), "").otherwise(s)
    words = F.transform(F.filter(F.split(s, r"[\s_\-]+"), lambda w: w != ""), lambda w: F.regexp_replace(w, "['’]s$", ""))
    return F.coalesce(F.upper(F.array_join(F.filter(words, lambda w: w != ""), "_")), F.lit(""))


@lru_cache(1)
def _plain_folds() -> dict[int, str]:
    a, b, more, _ = _folds()
    return {ord(k): v for k, v in (*zip(a, b), *more.items())}


def plain_fold(s: str) -> str:
    """fold_id of a plain string, for code that runs in workers."""
    return re.sub("[^a-z0-9]", "", (s if s.isascii() else s.translate(_plain_folds())).lower())


@lru_cache(1)
def _plain_names() -> dict[int, str | None]:
    a, b, more, _ = _name_folds()
    return {ord(k): v for k, v in (*zip(a, b), *more.items())} | dict.fromkeys(map(ord, _marks()))


def plain_name(s: str) -> str:
    """normalize_name of a plain string, for code that runs in workers."""
    s = (s if s.isascii() else s.translate(_plain_names())).strip(" \t\n\x0b\f\r")
    s = re.sub("^(?:The |the |A |a |An |an )", "", s).strip(" ")
    words = [] if re.fullmatch("[Tt]he|[Aa]|[Aa]n", s) else re.split(r"[ \t\n\x0b\f\r_\-]+", s)
    return "_".join(w for x in words if (w := re.sub("['’]s$", "", x))).upper()


@lru_cache(1)
def _name_folds() -> tuple[str, str, dict[str, str], str]:
    """By compatibility decomposition without marks, case kept."""
    a, b, more = _characters(lambda c: "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)) or c)
    return a, b, more, _class(more)


@lru_cache(1)
def _marks() -> str:
    return "".join(c for c in _foldable() if unicodedata.combining(c))


@lru_cache(1)
def _compositions() -> dict[str, str]:
    """A character and its marks, where together they are one character."""
    out = {}
    for c in _foldable():
        parts = unicodedata.normalize("NFD", c)
        if 1 < len(parts) < 5 and unicodedata.normalize("NFKC", parts) == c:
            out[parts] = c
    return out


@lru_cache(1)
def _shadow_folds() -> tuple[str, str, dict[str, str], str]:
    a, b, more = _characters(lambda c: "".join(unicodedata.normalize("NFKC", c).casefold().split()))
    return a, b, more, _class(more)


def canonical_id(field: str, c: Column | str, number: bool = False) -> Column:
    """The form in which an identity field is compared: names and titles by normalize_name, anything else by fold_id. number: c is a column of whole numbers."""
    if number:
        return fold_number(c)
    return normalize_name(c) if field in ("name", "title", "nom") else fold_id(c)


def canonical_list(c: Column | str) -> Column:
    return F.array_sort(F.array_distinct(F.transform(col(c), fold_id)))


def equivalence_key(c: Column | str) -> Column:
    """Strings are equivalent if they agree after compatibility composition and case folding without white space; accents tell them apart."""
    a, b, more, some = _shadow_folds()
    s = col(c).cast("string")
    whole = F.when(s.rlike(r"\p{M}"), _looked_up(s, r"(?s)\P{M}\p{M}*|\p{M}", _compositions())).otherwise(s)
    fold = lambda x: F.lower(F.translate(x, a, b))
    out = F.when(s.rlike(_ASCII), F.lower(s)).when(whole.rlike(some), fold(_looked_up(whole, r"(?s).", more))).otherwise(fold(whole))
    return F.regexp_replace(out, r"(?U)\s+", "")


def digit_signature(c: Column | str) -> Column:
    """The runs of digits in order."""
    return F.regexp_extract_all(col(c), F.lit(r"(\d+)"), 1)


def phrase_key(c: Column | str) -> Column:
    """_WORD_WORD_, so that containment respects word bounds."""
    return F.concat(F.lit("_"), F.array_join(F.filter(F.split(F.upper(col(c)), "[^0-9A-Z]+"), lambda w: w != ""), "_"), F.lit("_"))


def is_meaningful(c: Column | str, kind: str = "string") -> Column:
    """False for null, blank strings and empty collections; 0 and false are meaningful."""
    c = col(c)
    if kind == "string":
        return F.coalesce(F.length(F.trim(c)) > 0, F.lit(False))
    if kind.startswith(("array", "map")):
        return F.coalesce(F.size(c) > 0, F.lit(False))
    return c.isNotNull()


def is_empty(c: Column | str, kind: str = "string") -> Column:
    """True for null, '' and empty collections; blank strings, 0 and false aren't empty."""
    c = col(c)
    if kind == "string":
        return F.coalesce(c == "", F.lit(True))
    if kind.startswith(("array", "map")):
        return F.coalesce(F.size(c) == 0, F.lit(True))
    return c.isNull()


def is_usable_id(c: Column | str) -> Column:
    return F.coalesce(F.trim(col(c).cast("string")) != "", F.lit(False))


def is_class_echo(c: Column | str, name: str) -> Column:
    return F.coalesce(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "") == "".join(x for x in name.lower() if x.isascii() and x.isalnum()), F.lit(False))


def sentences(c: Column | str) -> Column:
    return F.split(F.trim(col(c)), r"(?<=[.!?])\s+")


def cut_at_sentence(c: Column | str, limit: int) -> Column:
    """At most limit characters, ending with the last sentence end among them, or cut hard."""
    c = col(c)
    head = F.substring(c, 1, limit)
    whole = F.regexp_extract(head, r"(?s)^(.*[.!?])", 1)
    return F.when(F.length(c) <= limit, c).when(whole != "", whole).otherwise(head)


def merge_sentences(old: Column | str, new: Column | str, limit: int = 4096) -> Column:
    """Appends the sentences of new that old doesn't contain as substrings."""
    o, n = F.trim(F.coalesce(col(old), F.lit(""))), F.trim(F.coalesce(col(new), F.lit("")))
    added = F.array_join(F.filter(sentences(n), lambda s: (s != "") & ~F.contains(o, s)), " ")
    both = F.when(o == "", n).when((n == "") | F.contains(o, n) | (added == ""), o).otherwise(F.concat_ws(" ", o, added))
    return cut_at_sentence(both, limit)


def truncate(c: Column | str, limit: int, suffix: str = "...") -> Column:
    if len(suffix) >= limit:
        raise ValueError("the suffix must be shorter than the limit")
    c = col(c)
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit - len(suffix)), F.lit(suffix))).otherwise(c)


def title_key(c: Column | str) -> Column:
    """snake_case and camelCase names as words with capitals."""
    return F.initcap(F.replace(F.regexp_replace(col(c), "([a-z0-9])([A-Z])", "$1 $2"), F.lit("_"), F.lit(" ")))


def snake_case(c: Column | str) -> Column:
    s = F.regexp_replace(F.regexp_replace(col(c), "([A-Z]+)([A-Z][a-z])", "$1_$2"), "([a-z0-9])([A-Z])", "$1_$2")
    return F.lower(F.regexp_replace(s, r"[\s\-]+", "_"))


def file_name(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(col(c)), r'[<>:"/\\|?*\x00-\x1f]', "_"), r"^[. ]+|[. ]+$", "")


def strip_markup(c: Column | str) -> Column:
    """Text without tags; the five XML entities and no-break spaces resolved, white space joined."""
    s = F.regexp_replace(col(c), r"(?is)<(script|style)\b.*?</\1>", " ")
    s = F.regexp_replace(s, "(?s)<!--.*?-->", " ")
    s = F.regexp_replace(s, "<[^>]+>", " ")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def content_chars(c: Column | str) -> Column:
    return F.length(strip_markup(c))


def without_control(c: Column | str) -> Column:
    """Without the control characters that XML forbids."""
    return F.regexp_replace(col(c), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")


def page_furniture(c: Column | str, budget: int = 1500) -> Column:
    """The distinct inner texts of page headers and footers, joined by lines, within a budget of characters."""
    found = F.array_distinct(F.filter(F.transform(F.regexp_extract_all(col(c), F.lit(r"(?s)<page_(?:header|footer)[^>]*>(.*?)</page_(?:header|footer)>"), 1), strip_markup), lambda s: s != ""))
    return F.substring(F.array_join(found, "\n"), 1, budget)


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Of two arrays as sets; 1 if both are empty."""
    both, any_ = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(any_ == 0, F.lit(1.0)).otherwise(both.cast("double") / any_)


def parse_number(c: Column | str) -> Column:
    """1 500,00 and 1,500.00 as 1500.0; null where no number can be read."""
    s = F.regexp_replace(F.trim(col(c)), r"[\s  ']", "")
    s = F.regexp_replace(s, r"^[^\d+\-.,]+|[^\d]+$", "")
    european = s.rlike(r"^[+-]?\d{1,3}(\.\d{3})*,\d+$|^[+-]?\d+,\d{1,2}$")
    plain = F.when(european, F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(s, F.lit(","), F.lit("")))
    return plain.try_cast("double")


CURRENCIES = {"€": "EUR", "$": "USD", "£": "GBP", "¥": "JPY", "₹": "INR", "euro": "EUR", "euros": "EUR", "dollar": "USD", "dollars": "USD", "pound": "GBP", "pounds": "GBP", "yen": "JPY", "chf": "CHF", "franc": "CHF"}


def currency_code(c: Column | str) -> Column:
    """The ISO code of a symbol, word or code; null if there is none."""
    s = F.lower(F.trim(col(c)))
    table = F.create_map(*(F.lit(x) for kv in CURRENCIES.items() for x in kv))
    return F.coalesce(F.element_at(table, s), F.when(s.rlike("^[a-z]{3}$"), F.upper(s)))


def enum_member(c: Column | str, members: list[str], synonyms: dict[str, str] | None = None, other: str = "OTHER") -> Column:
    """The member that the value, or a synonym of it, folds to; else other. Null stays."""
    fold = lambda s: "".join(x for x in unicodedata.normalize("NFKD", s).casefold() if x.isascii() and x.isalnum())
    table = {fold(m): m for m in members} | {fold(k): v for k, v in (synonyms or {}).items()}
    c = col(c)
    return F.when(c.isNull(), None).otherwise(F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), fold_id(c)), F.lit(other)))


def string_list(c: Column | str) -> Column:
    """A comma-separated string as an array of trimmed items without blanks."""
    return F.filter(F.transform(F.split(col(c), ","), lambda s: F.trim(s)), lambda s: s != "")


def _ratio(a: str, b: str) -> float:
    import difflib

    sort = lambda s: " ".join(sorted(s.lower().split()))
    return difflib.SequenceMatcher(None, sort(a), sort(b), autojunk=False).ratio()


@F.pandas_udf(T.DoubleType())
def fuzzy_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of the sorted words by matching blocks, 0 to 1; null if either is null."""
    return pd.Series([None if x is None or y is None else _ratio(x, y) for x, y in zip(a, b)], dtype="float64")
