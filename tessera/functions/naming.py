"""Names: documents of symbols, languages, steps, hosts, headings, cache files, times."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from tessera.functions.text import kind_prefix

#: Languages by code, their own aliases, and the locales that mean English.
LANGUAGES = {
    "ja": "Japanese", "en": "English", "zh": "Chinese", "es": "Spanish", "fr": "French", "de": "German", "ko": "Korean", "it": "Italian",
    "ru": "Russian", "pt": "Portuguese", "nl": "Dutch", "pl": "Polish", "sv": "Swedish", "da": "Danish", "fi": "Finnish", "no": "Norwegian",
    "tr": "Turkish", "ar": "Arabic", "vi": "Vietnamese", "th": "Thai", "id": "Indonesian", "hi": "Hindi", "uk": "Ukrainian", "cs": "Czech",
}
ALIASES = {
    "japanese": "Japanese", "jp": "Japanese", "日本語": "Japanese", "english": "English", "chinese": "Chinese", "spanish": "Spanish",
    "french": "French", "german": "German", "korean": "Korean", "c": "English", "posix": "English", "c.utf-8": "English", "c.utf8": "English",
}
#: Pipeline steps by name, a bare host, and what a describer calls itself.
STEPS = {
    1: ("1", "docgen", "symbol", "symbols"), 2: ("2", "data", "variable", "variables", "var"),
    3: ("3", "designgen", "design", "architecture", "models"), 4: ("4", "reportgen", "report", "readme"),
}
DEFAULT_HOST = "http://127.0.0.1:11434/v1"
PERSONAS = (
    "ソフトウェアアーキテクト", "ソフトウェア・アーキテクト", "アーキテクト", "software architect", "principal software architect",
    "principal architect", "ai assistant", "assistant",
)


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def language(name: Column) -> Column:
    """The language a name, a code or a locale stands for; an unknown one with a capital; null and blank are English."""
    bare = F.btrim(F.coalesce(name, F.lit("")))
    low = F.lower(bare)
    known = F.coalesce(F.try_element_at(_map(ALIASES), low), F.try_element_at(_map(LANGUAGES), low))
    tag = F.btrim(F.regexp_extract(F.btrim(F.regexp_extract(low, r"^[^:]*", 0)), r"^[^.@]*", 0))
    code = F.try_element_at(_map(LANGUAGES), F.regexp_extract(tag, r"^[^_-]*", 0))
    capital = F.concat(F.upper(F.substring(bare, 1, 1)), F.lower(F.substring(bare, 2, 1_000)))
    return F.when(bare == "", F.lit("English")).otherwise(F.coalesce(known, code, capital))


def step_number(step: Column) -> Column:
    """1 to 4 for a step's number or name; else null."""
    s = F.lower(F.btrim(step))
    out = F.lit(None).cast("int")
    for n, names in STEPS.items():
        out = F.when(s.isin(*names), n).otherwise(out)
    number = F.when(s.rlike(r"^[+]?0*[1-4]$"), F.regexp_replace(s, r"^[+]?0*", "").try_cast("int"))
    return F.coalesce(out, number)


def host_url(host: Column) -> Column:
    """With a scheme and the version path; null and empty are the local host."""
    h = F.regexp_replace(F.btrim(host), "/+$", "")
    h = F.when(h.startswith("http://") | h.startswith("https://"), h).otherwise(F.concat(F.lit("http://"), h))
    h = F.when(h.endswith("/v1"), h).otherwise(F.concat(h, F.lit("/v1")))
    return F.when(F.coalesce(host, F.lit("")) == "", DEFAULT_HOST).otherwise(h)


def without_persona(text: Column, fallback: Column) -> Column:
    """The trimmed text, or the fallback where it is empty or only names the describer."""
    bare = F.btrim(text)
    return F.when((F.coalesce(text, F.lit("")) == "") | F.lower(bare).isin(*PERSONAS), fallback).otherwise(bare)


def heading_text(label: Column) -> Column:
    """A heading without its marks and section number."""
    return F.btrim(F.regexp_replace(label, r"^#+\s*(?:\d+\.\s*)?", ""))


def cache_file(unique_id: Column) -> Column:
    """A file name: every character but word characters, ``-`` and ``.`` becomes ``_``."""
    return F.regexp_replace(unique_id, r"(?U)[^\w\-.]", "_")


def fqdn(scopes: Column, name: Column, separator: str = ".") -> Column:
    """The non-empty scopes and the name, joined."""
    filled = F.filter(scopes, lambda s: F.coalesce(s, F.lit("")) != "")
    return F.array_join(F.concat(filled, F.array(name)), separator)


def doc_names(path: Column, kind: Column, name: Column, unique_id: Column, fqdn: Column) -> Column:
    """Up to five file names under which a symbol's document may stand, in order and distinct: by name, by the id's
    name, with the id's prefix, and with one or two enclosing names of the FQDN."""
    head = F.concat(path, F.lit("."), kind_prefix(kind), F.lit("."))
    named = lambda *parts: F.concat(head, *parts, F.lit(".md"))
    raw = F.when(F.contains(unique_id, F.lit("::")), F.regexp_replace(F.regexp_extract(unique_id, r"(?s)^.*?::(.*)$", 1), r"(?s)^[^.]*\.", ""))
    prefix = F.when(F.contains(raw, F.lit(".")), F.regexp_extract(raw, r"(?s)^(.*\.)[^.]*$", 1))
    parts = F.split(fqdn, r"\.")
    n = F.size(parts)
    one = F.when(F.contains(fqdn, F.lit(".")), named(F.get(parts, n - 2), F.lit("."), name))
    two = F.when(F.contains(fqdn, F.lit(".")) & (n >= 3), named(F.get(parts, n - 3), F.lit("."), F.get(parts, n - 2), F.lit("."), name))
    every = F.array(named(name), named(raw), F.when(prefix != "", named(prefix, name)), one, two)
    return F.array_distinct(F.filter(every, lambda x: x.isNotNull()))


def clock(seconds: Column) -> Column:
    """mm:ss, from an hour on hh:mm:ss; null and negative are ``--:--``."""
    s = F.bround(seconds, 0).cast("long")
    short = F.format_string("%02d:%02d", F.floor(s / 60), s % 60)
    long = F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)
    return F.when(seconds.isNull() | (seconds < 0), "--:--").when(s < 3600, short).otherwise(long)


def bar(current: Column, total: Column, width: int = 24) -> Column:
    """``[━━━   ]``: the filled share of ``width``; without a total it is full."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(current.cast("double"), total)))
    filled = F.when(total <= 0, width).otherwise((share * width).cast("int"))
    return F.concat(F.lit("["), F.repeat(F.lit("━"), filled), F.repeat(F.lit(" "), F.lit(width) - filled), F.lit("]"))


def _wide(c: str) -> int:
    return 2 if unicodedata.east_asian_width(c) in ("W", "F") else 1


def _width(text: str) -> int:
    return sum(_wide(c) for c in text if ord(c) >= 32)


@F.pandas_udf(LongType())
def display_width(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Columns on a terminal: wide East Asian characters take two, control characters none."""
    for texts in parts:
        yield texts.map(lambda t: None if t is None else _width(t)).astype("Int64")


def fit_width(text: Column, most: int, suffix: str = "...") -> Column:
    """The text, or as much of it as leaves room for the suffix within ``most`` columns."""

    @F.pandas_udf(StringType())
    def cut(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(t):
            if t is None or _width(t) <= most:
                return t
            if most <= 0:
                return ""
            room, kept = max(0, most - _width(suffix)), []
            for c in t:
                room -= _wide(c)
                if room < 0:
                    break
                kept.append(c)
            return "".join(kept) + suffix

        for texts in parts:
            yield texts.map(one)

    return cut(text)


def locale_language(environment: dict[str, str]) -> str:
    """The language of the first locale variable that is set; English without one."""
    for name in ("LC_ALL", "LC_MESSAGES", "LANG", "LANGUAGE"):
        value = environment.get(name, "").strip()
        if value:
            low = value.lower()
            if low in ALIASES:
                return ALIASES[low]
            tag = re.split(r"[.@]", low.split(":")[0].strip())[0].strip()
            code = re.split(r"[_-]", tag)[0]
            return LANGUAGES.get(code) or ALIASES.get(tag) or (tag.capitalize() or "English")
    return "English"
