"""Scalar functions as Column expressions.

ANSI mode throws on bad casts, so every conversion that has a default is a
``try_`` form. Text is trimmed of all Unicode white space, not of blanks alone.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that mean "no number".
NO_NUMBER = ("-", "해당사항없음", "없음", "N/A", "n/a")
NUMBER_PATTERN = r"[-+]?\d[\d,]*(?:\.\d+)?"
#: Attention thresholds of the bands, high to low.
BANDS = ((75, "urgent"), (55, "review"), (35, "watch"))
BAND_RANK = {"low": 0, "watch": 1, "review": 2, "urgent": 3}
#: Fixed value: where a filing can be viewed.
VIEWER = "https://dart.fss.or.kr/dsaf001/main.do?rcpNo="
#: Bracketed prefixes that mark a corrected filing.
CORRECTIONS = ("기재정정", "첨부정정", "첨부추가", "발행조건확정", "정정")
PREFIX_PATTERN = r"^(?:\[[^\]]+\]\s*)+"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def text(x: Column) -> Column:
    """Null as the empty text, trimmed."""
    return strip(F.coalesce(x.cast("string"), F.lit("")))


def number(x: Column, default: float = 0.0) -> Column:
    """A double, or the default; true and false are 1 and 0, NaN is the default."""
    t = x.cast("string")
    found = F.when(F.lower(t) == "true", 1.0).when(F.lower(t) == "false", 0.0).otherwise(strip(t).try_cast("double"))
    return F.coalesce(F.nanvl(found, F.lit(None).cast("double")), F.lit(default))


def unit(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def as_float(x: Column) -> Column:
    return F.nullif(x.cast("string"), F.lit("")).try_cast("double")


def clamp_score(x: Column) -> Column:
    """Within 0..100, one decimal."""
    return F.round(F.least(F.greatest(x.cast("double"), F.lit(0.0)), F.lit(100.0)), 1)


def band(attention: Column) -> Column:
    out = F.lit("low")
    for least, name in reversed(BANDS):
        out = F.when(attention >= least, name).otherwise(out)
    return out


def band_rank(name: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(v) for kv in BAND_RANK.items() for v in kv)), name)


def ladder(x: Column, levels: Sequence[tuple[float, float]]) -> Column:
    """Points of the first threshold that is reached, in descending order; 0 for null."""
    out = F.lit(0.0)
    for least, points in reversed(levels):
        out = F.when(x >= least, float(points)).otherwise(out)
    return out


def parse_number(x: Column) -> Column:
    """The first number in a Korean-style cell: units and commas go, placeholders are null."""
    t = text(x)
    bare = F.regexp_replace(t, "[원주%]", "")
    found = F.nullif(F.regexp_extract(bare, NUMBER_PATTERN, 0), F.lit(""))
    return F.when(t.isin(*NO_NUMBER), None).otherwise(F.replace(found, F.lit(","), F.lit("")).try_cast("double"))


def ratio(n: Column, d: Column) -> Column:
    return F.try_divide(n, d) * 100


def contains_any(x: Column, tokens: Iterable[str]) -> Column:
    t = F.coalesce(x, F.lit(""))
    out = F.lit(False)
    for token in tokens:
        out = out | t.contains(token)
    return out


def compact_cell(x: Column) -> Column:
    """Without white space, middle dots, dashes, slashes and parentheses."""
    return F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)[\sㆍ·・\-_/()]", "")


def fixed(x: Column, digits: int) -> Column:
    """A number with so many decimals, half to even on the exact binary value, without grouping."""
    return F.replace(F.format_number(x.cast("double"), digits), F.lit(","), F.lit(""))


def strip_prefixes(x: Column) -> Column:
    return strip(F.regexp_replace(text(x), "(?U)" + PREFIX_PATTERN, ""))


def is_correction(x: Column) -> Column:
    prefix = F.regexp_extract(text(x), "(?U)" + PREFIX_PATTERN, 0)
    return contains_any(prefix, CORRECTIONS)


def compact_name(x: Column) -> Column:
    """A report name without prefixes, white space and separators; parentheses stay."""
    return F.regexp_replace(strip_prefixes(x), r"(?U)[\sㆍ·・\-_/]", "")


def ymd(x: Column) -> Column:
    return F.try_to_date(x, "yyyyMMdd")


def minus_days(day: Column, days: int) -> Column:
    """yyyyMMdd text so many days earlier; negative counts are 0."""
    return F.date_format(F.date_sub(ymd(day), max(int(days), 0)), "yyyyMMdd")


def csv_values(x: Column) -> Column:
    return F.filter(F.transform(F.split(x, ","), strip), lambda v: v != "")


def decimal(x: Column) -> Column:
    return strip(x.cast("string")).try_cast("decimal(38,6)")


def viewer_url(receipt: Column) -> Column:
    return F.concat(F.lit(VIEWER), receipt)


def sum_or_null(*values: Column) -> Column:
    """Nulls are skipped; null if all are."""
    return F.when(F.coalesce(*values).isNotNull(), sum((F.coalesce(v, F.lit(0.0)) for v in values), F.lit(0.0)))


def positive_sum(*values: Column) -> Column:
    return sum((F.when(v > 0, v).otherwise(0.0) for v in values), F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    """0 for nulls, unequal or no dimensions and zero norms."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    value = F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    return F.when(F.size(a) != F.size(b), 0.0).otherwise(F.coalesce(value, F.lit(0.0)))


def format_number(x: Column, suffix: str = "") -> Column:
    """Grouped, with two decimals unless whole; - for nothing; other text as it is."""
    t = x.cast("string")
    v = t.try_cast("double")
    shown = F.when(v == F.floor(v), F.format_number(v, 0)).otherwise(F.format_number(v, 2))
    return F.when(F.coalesce(t, F.lit("")) == "", "-").when(v.isNull(), t).otherwise(F.concat(shown, F.lit(suffix)))


def ordered_distinct(x: Column) -> Column:
    return F.array_distinct(x)
