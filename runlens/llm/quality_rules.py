"""Quality rules: a threshold table compiled into one projection of text ratios.

Everything is a built-in expression: no user function, no join, no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACES, text_or_empty, words

SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜ"
# Frequent function words of English, French, German and Spanish.
LANGUAGES = [line.split() for line in (
    "the of and to in a is that it for was on are as with be by this from at or an not have",
    "le la les de des du et en un une est que qui dans pour pas sur au par avec",
    "der die das und ist von zu den mit sich auf für nicht ein eine dem im",
    "el los las y del se una por con para su al lo como más no",
)]
STOP_WORDS = [w for language in LANGUAGES for w in language]
LETTERS = "A-Za-zàâäáçéèêëîïíñóôöùúûüÿßœæÀÂÄÁÇÉÈÊËÎÏÍÑÓÔÖÙÚÛÜŸẞŒÆ"  # of these languages


@dataclass(frozen=True)
class Rule:
    """A document passes if ``low <= expression <= high``; the expression is SQL over the metrics below."""

    name: str
    expression: str
    low: float | None = None
    high: float | None = None
    listed_only: bool = False  # holds only for texts that are shown to be in one of LANGUAGES

    def passes(self) -> str:
        parts = [f"({self.expression}) >= {self.low}"] * (self.low is not None)
        parts += [f"({self.expression}) <= {self.high}"] * (self.high is not None)
        return "(" + " AND ".join(parts) + ")"


# Length and repetition floor, then the ratios. Metrics are integers, so each test is a product, not a quotient.
BASE = (
    Rule("length", "n_words", low=50),
    Rule("repeated_runs", "100 * n_repeat_words - 50 * n_words", high=0),
)
RULES = (
    Rule("word_length", "word_chars - 2 * n_words", low=0),
    Rule("word_length_most", "word_chars - 14 * n_words", high=0),
    Rule("symbols", "100 * n_symbols - 15 * n_words", high=0),
    Rule("exclamations", "100 * n_exclamations - 15 * n_words", high=0),
    Rule("capitals", "100 * n_capitals - 30 * word_chars", high=0),
    Rule("stop_words", "100 * n_stop_words - 4 * n_words", low=0, listed_only=True),
    Rule("duplicate_lines", "100 * n_dup_lines - 40 * n_lines", high=0),
    Rule("bullet_lines", "100 * n_bullet_lines - 90 * n_lines", high=0),
)


def _windows(w: Column, n: Column) -> Column:
    """(hash, position) of all 3-word windows, sorted."""
    return F.when(
        n >= 3,
        F.sort_array(
            F.transform(
                F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))),
                lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("p")),
            )
        ),
    )


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the metrics to every row; a null text counts as empty, other columns stay.

    Columns of ``df`` that share a metric's name are replaced.
    """
    body = text_or_empty(text)
    df = df.withColumn("__words", words(body))
    lines = F.filter(F.split(body, "\n"), lambda x: F.translate(x, SPACES, "") != "")
    df = df.withColumns({
        "n_words": F.size("__words").cast("long"),
        "word_chars": F.length(F.translate(body, SPACES, "")).cast("long"),
        "n_symbols": (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long"),
        "n_exclamations": (F.length(body) - F.length(F.translate(body, "!", ""))).cast("long"),
        "n_capitals": (F.length(body) - F.length(F.translate(body, CAPITALS, ""))).cast("long"),
        "n_stop_words": F.size(F.filter("__words", lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long"),
        "__lines": lines,
        "__grams": _windows(F.col("__words"), F.size("__words")),
    })
    grams = F.col("__grams")
    again = F.filter(grams, lambda g, i: (F.get(grams, i - 1)["h"] == g["h"]) | (F.get(grams, i + 1)["h"] == g["h"]))
    df = df.withColumns({
        "n_lines": F.size("__lines").cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_bullet_lines": F.size(F.filter("__lines", lambda x: F.ltrim(x).rlike("^[-*•]"))).cast("long"),
        "__again": F.sort_array(F.transform(again, lambda g: g["p"])),
    })
    covered = F.aggregate(
        "__again",
        F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda s, p: F.struct(p.alias("last"), (s["n"] + F.least(F.lit(3), p - s["last"])).alias("n")),
        lambda s: s["n"],
    )
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    return df.drop("__words", "__lines", "__grams", "__again")


def in_a_listed_language(text: str = "text") -> Column:
    """Whether a text has five different function words of one of LANGUAGES, as 2 % of its words or more, and hardly a letter
    that none of them writes. Other texts may be in any language, so a lack of known words says nothing about them."""
    body = text_or_empty(text)
    own = F.transform(words(body), lambda w: F.lower(w))

    def known(language: list[str]) -> Column:
        found = F.filter(own, lambda w: w.isin(*language))
        return (F.size(F.array_distinct(found)) >= 5) & (100 * F.size(found) >= 2 * F.size(own))

    foreign = F.length(F.regexp_replace(body, rf"[^\p{{L}}]|[{LETTERS}]", ""))
    return F.greatest(*map(known, LANGUAGES)) & (100 * foreign <= F.length(F.translate(body, SPACES, "")))


def _holds(rule: Rule, text: str) -> Column:
    passes = F.expr(rule.passes())
    return passes | ~in_a_listed_language(text) if rule.listed_only else passes


def judged(df: DataFrame, base: Sequence[Rule] = BASE, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """Add the metrics, ``base_failed``, ``failed_rules`` (names, in table order) and ``kept`` to every row.

    Null and empty texts have all metrics 0 and fail the length rule. Repeated rows are judged alike.
    """
    df = measured(df, text)
    failed = F.filter(F.array(*[F.when(~_holds(r, text), r.name) for r in (*base, *rules)]), lambda x: x.isNotNull())
    return df.withColumns({
        "base_failed": ~F.expr(" AND ".join(r.passes() for r in base)),
        "failed_rules": failed,
        "kept": reduce(and_, [_holds(r, text) for r in (*base, *rules)], F.lit(True)),
    })


def passing(docs: DataFrame) -> DataFrame:
    """The rows that pass all rules, with their own columns, also those named like a metric.

    A filter on ``kept`` alone would be pushed below the metrics, with their definitions put in one another's place
    and worked out again for each use. A row number holds it above them.
    """
    own = {c: f"__own_column_{i}" for i, c in enumerate(docs.columns)}
    rows = judged(docs.select(*[F.col(c).alias(name) for c, name in own.items()], "text")).withColumn("__row", F.monotonically_increasing_id())
    return rows.where("kept AND __row >= 0").select(*[F.col(name).alias(c) for c, name in own.items()])


METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def verdicts_sql(source: str = "documents") -> str:
    """DuckDB SQL for :func:`judged` over ``source``, as doc_id, all metrics, ``base_failed`` and ``kept``.

    It holds every rule for every text, so it fits only texts in one of LANGUAGES.
    """
    space = r"[\x20\x09-\x0D]"
    strip = f"regexp_replace(t, '{space}', '', 'g')"
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    good, base = (" AND ".join(r.passes() for r in rs) for rs in ((*BASE, *RULES), BASE))
    return rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM {source}),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '{space}+'), lambda x: x <> '') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
g AS (SELECT rid, unnest(range(1, len(ws) - 1)) AS p, ws FROM w WHERE len(ws) >= 3),
h AS (SELECT rid, p, count(*) OVER (PARTITION BY rid, ws[p], ws[p + 1], ws[p + 2]) AS c FROM g),
r AS (SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest([p, p + 1, p + 2]) AS q FROM h WHERE c > 1) GROUP BY rid),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length({strip}) AS BIGINT) AS word_chars,
  CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
  CAST(length(t) - length(translate(t, '!', '')) AS BIGINT) AS n_exclamations,
  CAST(length(t) - length(translate(t, '{CAPITALS}', '')) AS BIGINT) AS n_capitals,
  CAST(len(list_filter(ws, lambda x: lower(x) IN ({stop}))) AS BIGINT) AS n_stop_words,
  CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  CAST(len(list_filter(ls, lambda x: regexp_matches(x, '^ *[-*•]'))) AS BIGINT) AS n_bullet_lines,
  CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN r USING (rid))
SELECT *, NOT ({base}) AS base_failed, ({good}) AS kept FROM m"""
