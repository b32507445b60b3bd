"""String expressions: message masking, token clean-up, verdict words."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import vocab

# (?U) gives \w, \d and \s their Unicode meaning.
HEX = "0x[0-9a-fA-F]+"
NUMBER = r"(?U)(?<![\w.])\d+(?:\.\d+)?(?![\w.])"
BLANKS = r"(?U)[\s\x1c-\x1f]+"


def mask(message: Column) -> Column:
    """Template of a message: addresses and free-standing numbers replaced."""
    masked = F.regexp_replace(message, HEX, "<ADDR>")
    masked = F.regexp_replace(masked, NUMBER, "<N>")
    return F.trim(F.regexp_replace(masked, BLANKS, " "))


# Fixed value: the characters a Unicode-aware strip removes.
SPACES = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(value: Column) -> Column:
    return F.btrim(value, F.lit(SPACES))


def norm_token(value: Column) -> Column:
    """Spelling-insensitive form of a categorical value."""
    text = value.cast("string")
    token = F.regexp_replace(F.lower(strip(text)), r"(?U)[\s\x1c-\x1f\-_]+", "_")
    # Most values hold no separator and need no replacement.
    return F.when(text.rlike(r"(?U)[\s\x1c-\x1f\-_]"), F.btrim(token, F.lit("_"))).otherwise(F.lower(text))


def is_nullish(value: Column) -> Column:
    return value.isNull() | F.lower(strip(value)).isin(vocab.NULLISH)


def verdict(value: Column) -> Column:
    """Free verdict word to ``pass``/``fail``; null when unknown.

    Numeric flags are compared by value, so ``1.0`` equals ``1``.
    """
    token = norm_token(value)
    token = F.when(token.rlike(r"^[01]\.0+$"), F.substring(token, 1, 1)).otherwise(token)
    return (
        F.when(token.isin(vocab.FAIL_WORDS), "fail").when(token.isin(vocab.PASS_WORDS), "pass")
    )


def outcome(value: Column) -> Column:
    """Outcome-table vocabulary; other words stay, lower-cased."""
    word = F.lower(strip(value.cast("string")))
    return (
        F.when(word.isin(vocab.OUTCOME_PASS), "pass")
        .when(word.isin(vocab.OUTCOME_FAIL), "fail")
        .otherwise(word)
    )


def scan_verdict(body: Column) -> Column:
    """First failing word of a text, else the first passing word, else null."""
    words = F.transform(
        F.regexp_extract_all(body, F.lit(r"(?U)\b([A-Za-z]{2,12})\b"), F.lit(1)), F.lower
    )
    bad = [w for w in vocab.FAIL_WORDS if w not in vocab.SCAN_SKIP_FAIL]
    good = [w for w in vocab.PASS_WORDS if w not in vocab.SCAN_SKIP_PASS]
    return F.coalesce(
        F.get(F.filter(words, lambda w: w.isin(bad)), F.lit(0)),
        F.get(F.filter(words, lambda w: w.isin(good)), F.lit(0)),
    )


def terms(template: Column) -> Column:
    """Word tokens followed by the pairs of neighbouring tokens."""
    words = F.regexp_extract_all(
        F.lower(template), F.lit("[A-Za-z_<>][A-Za-z0-9_<>]+"), F.lit(0)
    )
    pairs = F.when(
        F.size(words) > 1,
        F.zip_with(
            F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))),
            F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))),
            lambda a, b: F.concat_ws(" ", a, b),
        ),
    ).otherwise(F.array().cast("array<string>"))
    return F.concat(words, pairs)
