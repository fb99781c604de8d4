"""Quality rules: a table of thresholds compiled into one projection of built-in functions (operator 8).

Defined results: null and empty texts have no words, all their counts and shares are 0 and they fail; texts of any
length are measured whole; every row is judged by itself, so repeated rows come out alike and null ids are passed
through; a measure at its bound passes; an empty table gives no rows; extra columns of any name are dropped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words_column

# Frequent function words of the four languages the rules know.
STOP_WORDS = [
    *["the", "of", "and", "to", "in", "that", "is", "with", "for", "as", "on", "by", "this", "are", "be", "was", "it"],
    *["der", "die", "das", "und", "nicht", "ein", "eine", "des", "zu", "von", "mit", "den", "im", "ist", "sich", "auf"],
    *["le", "la", "les", "de", "du", "un", "une", "et", "est", "que", "qui", "dans", "pour", "par", "en", "au", "aux"],
    *["el", "los", "las", "una", "y", "con", "del", "se", "por", "su", "para", "al", "lo", "es", "así", "esta", "no"],
]


@dataclass(frozen=True)
class Rule:
    """``low <= measure <= high``; an open side is None."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: The threshold table. Measures are columns of ``measures``.
RULES = [
    Rule("words", "n_words", 20, None),
    Rule("word_length", "mean_word_chars", 2.0, 20.0),
    Rule("symbols", "symbols_per_word", None, 0.5),
    Rule("stop_words", "stop_share", 0.02, None),
    Rule("capitals", "capital_share", None, 0.5),
    Rule("letters", "letter_share", 0.6, None),
    Rule("duplicate_lines", "dup_line_share", None, 0.5),
    Rule("bullet_lines", "bullet_share", None, 0.9),
    Rule("ellipsis_lines", "ellipsis_share", None, 0.5),
    Rule("repeats", "repeat_share", None, 0.3),
]

_WINDOW = 8


def _count(items: Column, test) -> Column:
    return F.size(F.filter(items, test)).cast("long")


def _share(part: str, whole: str) -> Column:
    """0 where there is nothing to share."""
    return F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(whole).cast("double")), F.lit(0.0))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, also where a filter above pulls the whole expression down."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated(words: Column) -> Column:
    """Words in windows that the text has twice or more. Where all hashes of windows differ there are none; else the
    hashes are sorted with their places, so that equal windows lie side by side, and each place adds the words that
    the place before it does not cover."""
    starts = F.sequence(F.lit(1), F.size(words) - (_WINDOW - 1))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, _WINDOW)))

    def places(windows: Column) -> Column:
        same = lambda x, k: F.coalesce(x["h"] == F.get(windows, k)["h"], F.lit(False))
        marked = F.transform(windows, lambda x, k: F.when(same(x, k - 1) | same(x, k + 1), x["i"]))
        return F.sort_array(F.filter(marked, lambda i: i.isNotNull()))

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.aggregate(
            _let(placed, places),
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
            lambda s, i: F.struct(
                (s["n"] + (i + _WINDOW - F.greatest(i, s["end"])).cast("long")).alias("n"), (i + _WINDOW).alias("end")
            ),
        )["n"]

    none = F.lit(0).cast("long")
    repeats = _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(none))
    return F.when(F.size(words) >= _WINDOW, repeats).otherwise(none)


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and every measure the rules can name.

    Null text has no words or lines; all its counts and shares are 0. Lines without a word are no lines. Extra
    columns are dropped.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select(
        "doc_id",
        words_column("text").alias("words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
    )
    stop = sorted(set(STOP_WORDS))
    counts = split.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _let(F.col("words"), _repeated).alias("n_repeat_words"),
        _count(F.col("words"), lambda w: F.rtrim(F.lower(w), F.lit(".,;:!?")).isin(stop)).alias("n_stop"),
        _count(F.col("words"), lambda w: (w == F.upper(w)) & (w != F.lower(w)) & (F.length(w) > 1)).alias("n_capital"),
        _count(F.col("words"), lambda w: F.upper(w) != F.lower(w)).alias("n_letter"),
        _count(F.col("lines"), lambda x: x.rlike("^[-*•]")).alias("n_bullet"),
        _count(F.col("lines"), lambda x: x.rlike(r"(\.\.\.|…)\s*$")).alias("n_ellipsis"),
    )
    return counts.select(
        "*",
        _share("word_chars", "n_words").alias("mean_word_chars"),
        _share("n_symbols", "n_words").alias("symbols_per_word"),
        _share("n_stop", "n_words").alias("stop_share"),
        _share("n_capital", "n_words").alias("capital_share"),
        _share("n_letter", "n_words").alias("letter_share"),
        _share("n_dup_lines", "n_lines").alias("dup_line_share"),
        _share("n_bullet", "n_lines").alias("bullet_share"),
        _share("n_ellipsis", "n_lines").alias("ellipsis_share"),
        _share("n_repeat_words", "n_words").alias("repeat_share"),
    )


def verdict(rules: list[Rule]) -> Column:
    """Names of the rules that a row of ``measures`` breaks, as an array."""
    broken = []
    for rule in rules:
        m, parts = F.col(rule.measure), []
        if rule.low is not None:
            parts.append(m < rule.low)
        if rule.high is not None:
            parts.append(m > rule.high)
        for p in parts:
            broken.append(F.when(p, F.lit(rule.name)))
    return F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")


def apply_rules(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """``measures`` with ``broken``, the rules each document breaks; one row per input row, no shuffle."""
    return measures(docs).withColumn("broken", verdict(rules))


def judged(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """Counts with base_failed (under 20 words, or over 30 % of them in repeated windows) and kept."""
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return apply_rules(docs, rules).select(
        "doc_id",
        *["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"],
        base.alias("base_failed"),
        (~base & (F.size("broken") == 0)).alias("kept"),
    )


#: The same in DuckDB SQL, over ``documents``.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols
  FROM d
), win AS (
  SELECT rid, i, array_to_string(words[i:i+7], ' ') AS win
  FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)
), rep AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM win) WHERE n > 1
), cover AS (
  SELECT rid, sum(least(8, i - prev)) AS n_repeat FROM
    (SELECT rid, i, coalesce(lag(i) OVER (PARTITION BY rid ORDER BY i), i - 8) AS prev FROM rep) GROUP BY rid
), c AS (
  SELECT w.*, len(words) AS n_words, len(lines) AS n_lines,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(cast(n_repeat AS BIGINT), 0) AS n_repeat_words,
         len(list_filter(words, lambda x: list_contains([{stop}], rtrim(lower(x), '.,;:!?')))) AS n_stop,
         len(list_filter(words, lambda x: x = upper(x) AND x <> lower(x) AND length(x) > 1)) AS n_capital,
         len(list_filter(words, lambda x: upper(x) <> lower(x))) AS n_letter,
         len(list_filter(lines, lambda x: regexp_matches(x, '^[-*•]'))) AS n_bullet,
         len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) AS n_ellipsis
  FROM w LEFT JOIN cover USING (rid)
)
SELECT doc_id, cast(n_words AS BIGINT) AS n_words, cast(word_chars AS BIGINT) AS word_chars,
       cast(n_symbols AS BIGINT) AS n_symbols, cast(n_dup_lines AS BIGINT) AS n_dup_lines, n_repeat_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
         AND word_chars::DOUBLE / n_words BETWEEN 2.0 AND 20.0
         AND n_symbols::DOUBLE / n_words <= 0.5 AND n_stop::DOUBLE / n_words >= 0.02
         AND n_capital::DOUBLE / n_words <= 0.5 AND n_letter::DOUBLE / n_words >= 0.6
         AND n_dup_lines::DOUBLE / n_lines <= 0.5 AND n_bullet::DOUBLE / n_lines <= 0.9
         AND n_ellipsis::DOUBLE / n_lines <= 0.5 AND n_repeat_words::DOUBLE / n_words <= 0.3 AS kept
FROM c
""".replace("{stop}", ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS))))
