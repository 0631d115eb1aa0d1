"""Scalar functions as columns; the few that Spark lacks are Arrow UDFs."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Numbers that parse as one; Spark's own cast also takes blanks and type suffixes.
NUMBER = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity|nan))$"
WIKI_ALIAS = r"\[\[[^\[\]|\n]+\|([^\[\]\n]*)\]\]"
WIKI_PLAIN = r"\[\[(?:[^\[\]|#\n]*/)?([^\[\]|#/\n]*?)(?:\.md)?(?:#[^\[\]|\n]*)?\]\]"


def shown(column: Column) -> Column:
    """A missing value, null and an empty text are one: the empty text."""
    return F.coalesce(column, F.lit(""))


def truthy(display: Column) -> Column:
    return ~F.regexp_replace(shown(display), r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$", "").isin("", "false", "0")


def number(display: Column) -> Column:
    """The number that a text is as a whole, or null."""
    return F.when(shown(display).rlike(NUMBER), display.try_cast("double"))


def rounded(value: Column, digits: int) -> Column:
    """Scaled, rounded half away from zero, scaled back; ``round`` itself would look at the decimal digits."""
    scale = float(10**digits)
    return F.round(value * scale) / scale


def format_number(value: Column) -> Column:
    """Whole numbers below 1e15 without a point; others with the shortest digits, never an exponent.

    A double's own text has an exponent below 1e-3 and from 1e7 on; the decimal type writes it out.
    """
    whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
    text = value.cast("string")
    plain = F.regexp_replace(F.regexp_replace(text.try_cast("decimal(38,17)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(whole, value.cast("long").cast("string")).when(text.contains("E"), F.coalesce(plain, text)).otherwise(text)


def tokens(text: Column) -> Column:
    """The estimate of tokens that budgets use: a quarter of the characters."""
    return F.floor(F.length(shown(text)) / 4).cast("int")


def resolve_name(target: Column) -> Column:
    """The note that a link target names: no anchor, no folder, no ``.md``."""
    return F.regexp_replace(F.element_at(F.split(F.substring_index(target, "#", 1), "/", -1), -1), r"\.md$", "")


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else s if s.isascii() else unicodedata.normalize("NFKC", s))


def normalized(text: Column) -> Column:
    """NFKC, straight quotes, lower case."""
    return F.lower(F.translate(nfkc(text), "‘’“”", "''\"\""))


def link_key(target: Column) -> Column:
    """The key that both sides of a link join are compared by."""
    return normalized(resolve_name(target))


def strip_links(text: Column) -> Column:
    """Wikilinks replaced by what they show."""
    return F.regexp_replace(F.regexp_replace(text, WIKI_ALIAS, "$1"), WIKI_PLAIN, "$1")


def slug_segment(text: Column) -> Column:
    bare = F.lower(F.regexp_replace(strip_links(text), r"[`*_]", ""))
    return F.regexp_replace(F.regexp_replace(bare, r"[^\p{IsAlphabetic}\p{N}]+", "-"), r"^-+|-+$", "")


def slug_path(path: Column) -> Column:
    return F.array_join(F.transform(F.split(path, "/", -1), slug_segment), "/")


def strip_md(path: Column) -> Column:
    return F.regexp_replace(path, r"\.md$", "")


def in_folder(rel: Column, folder: str) -> Column:
    """At a boundary of the path: ``a`` holds ``a/x`` and not ``ab/x``."""
    return (rel == folder) | F.startswith(rel, F.lit(folder + "/"))


def byte_slice(text: Column, start: Column, end: Column) -> Column:
    return F.decode(F.substring(F.encode(text, "utf-8"), start + 1, end - start), "utf-8")


def lines(text: Column) -> Column:
    """LF, CRLF and CR end lines; what follows the last end is a line only if it isn't empty."""
    parts = F.split(text, r"\r\n|\n|\r", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def endings_lf(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def language(text: Column) -> Column:
    """``ru`` if more than 30 % of the letters are Cyrillic, else ``en``."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    cyrillic = F.length(F.regexp_replace(text, r"[^\p{IsCyrillic}]+", ""))
    return F.when((letters > 0) & (cyrillic / F.greatest(letters, F.lit(1)) > 0.3), "ru").otherwise("en")


def word_count(text: Column) -> Column:
    trimmed = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, " "))).cast("long")


def sentences(text: Column) -> Column:
    """Sentences: cut after . ! ? with closing marks, before white space."""
    return F.filter(F.split(F.regexp_replace(text, r"([.!?][\"'”’)\]]{0,8})\s+", "$1\u0001"), "\u0001"), lambda s: F.trim(s) != "")


def corruption_cap(a: Column, b: Column) -> Column:
    return F.least(F.lit(3), F.floor(F.greatest(F.length(a), F.length(b)) / 3)).cast("int")


def iso_week_text(date: Column) -> Column:
    return F.concat(F.date_format(F.date_add(F.date_trunc("week", date).cast("date"), 3), "yyyy"), F.lit("-W"), F.lpad(F.weekofyear(date).cast("string"), 2, "0"))


def iso_week_monday(text: Column) -> Column:
    """The Monday of ``2026-W10``; null for a week that the year doesn't have."""
    year, week = F.regexp_extract(text, r"(\d{4})-[Ww](\d{2})", 1), F.regexp_extract(text, r"(\d{4})-[Ww](\d{2})", 2)
    y, w = year.try_cast("int"), week.try_cast("int")
    monday = F.date_add(F.date_trunc("week", F.make_date(y, F.lit(1), F.lit(4))).cast("date"), (w - 1) * 7)
    return F.when((w >= 1) & (F.weekofyear(monday) == w), monday)


def tier(fm: Column) -> Column:
    """Trust of a note from its frontmatter: superseded by flag, type or status; provisional; else certified."""
    status = F.when(fm["epistemic_status"]["kind"] == "string", fm["epistemic_status"]["display"])
    flagged = F.coalesce(fm["superseded"]["bool"], F.lit(False)) | F.coalesce((fm["type"]["kind"] == "string") & (fm["type"]["display"] == "checkpoint"), F.lit(False))
    return F.when(flagged | F.coalesce(status == "superseded", F.lit(False)), "superseded").when(F.coalesce(status == "provisional", F.lit(False)), "provisional").otherwise("certified")


def multiplier(tier_name: Column) -> Column:
    return F.when(tier_name == "superseded", 0.3).when(tier_name == "provisional", 0.6).otherwise(1.0)


def any_of(conditions: list[Column]) -> Column:
    return reduce(or_, conditions) if conditions else F.lit(False)


def sanitize_query(query: str) -> str:
    """Query signs become blanks."""
    return re.sub(r'[:+\-()^~"*?\[\]{}\\!]', " ", query)
