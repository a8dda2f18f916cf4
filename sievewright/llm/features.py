"""Text features as DataFrame expressions (no Python on the executors).

Words are maximal runs of characters other than space and \\x09-\\x0D. A null text
has no words and every count is 0. All counts are exact for whole texts; repeats
of 3-word windows inside one text are found by sorting their 64-bit hashes with
their positions, so a text costs n log n however repetitive it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

#: Frequent function words of the languages at hand (fixed values).
STOP_WORDS = (
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which "
    "der die das und ist von zu den mit sich des auf für ein eine dem nicht im auch es "
    "de la le les et des en un une du est que qui dans pour par pas sur au avec "
    "el los las y del se por con una para su al lo como más no"
).split()

_GAP = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), _GAP), lambda w: w != "")


def _count(text: Column, not_counted: str) -> Column:
    return F.length(F.regexp_replace(text, not_counted, "")).cast("long")


def _repeat_words(w: Column) -> Column:
    """Words inside 3-word windows that the text holds twice or more."""
    n = F.size(w)
    windows = F.transform(
        F.slice(w, 1, F.greatest(n - 2, F.lit(0))),
        lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")),
    )

    def positions(s: Column) -> Column:
        again = F.filter(
            s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))
        )
        return F.array_sort(F.transform(again, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, k: F.coalesce(F.least(F.get(p, k + 1) - x, F.lit(3)), F.lit(3)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    return F.when(n < 4, F.lit(0).cast("long")).otherwise(
        let(F.array_sort(windows), lambda s: let(positions(s), covered))
    )


def text_features(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and the counts, with the columns of ``extra`` carried along."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = documents.select(F.col(id_col).alias("doc_id"), text.alias("sw_text"), *extra)
    rows = rows.withColumn("sw_w", words_of(F.col("sw_text")))
    lines = F.filter(F.split("sw_text", "\n"), lambda x: F.trim(x, F.lit(" \t\x0b\x0c\r")) != "")
    w, t = F.col("sw_w"), F.col("sw_text")
    return rows.select(
        "doc_id",
        *extra,
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        _count(t, r"[^#*$%&|<>]+").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeat_words(w).alias("n_repeat_words"),
        F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
        F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))).cast("long").alias("n_stop"),
        _count(t, r"\P{Lu}+").alias("n_upper"),
        _count(t, r"\P{L}+").alias("n_letters"),
        _count(t, r"[^!]+").alias("n_bang"),
    )


_W = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_STOPS = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
#: DuckDB SQL of the same columns, as common table expressions ending in ``feat``.
FEATURES_SQL = rf"""
wd AS (SELECT doc_id, coalesce(text, '') AS t, {_W} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM wd)),
rep AS (SELECT doc_id, count(DISTINCT k) AS n FROM (
  SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1)
  GROUP BY doc_id),
feat AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
    - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(list_distinct(w)) AS BIGINT) AS n_distinct,
  CAST(len(list_filter(w, lambda x: lower(x) IN ({_STOPS}))) AS BIGINT) AS n_stop,
  CAST(length(regexp_replace(t, '\P{{Lu}}+', '', 'g')) AS BIGINT) AS n_upper,
  CAST(length(regexp_replace(t, '\P{{L}}+', '', 'g')) AS BIGINT) AS n_letters,
  CAST(length(regexp_replace(t, '[^!]+', '', 'g')) AS BIGINT) AS n_bang
  FROM wd LEFT JOIN rep USING (doc_id))"""
