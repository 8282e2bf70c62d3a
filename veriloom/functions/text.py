"""Text expressions. Null in, null out, unless said otherwise; empty text stays empty."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

#: One token: a Han character, a Latin run, a number, or any other visible character.
TOKEN = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]|[A-Za-z]+|[0-9]+(?:\.[0-9]+)?|[^\s]"
# Clause marks at a line's start.
CLAUSE = r"^(第[一二三四五六七八九十百千万零〇两0-9]+条|[一二三四五六七八九十]+、)"


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility composition; the JVM has no built-in for it."""
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(DoubleType())
def substring_coverage(target: pd.Series, source: pd.Series) -> pd.Series:
    """The longest common substring over the target's length; 1 if contained, null for null or empty targets."""

    def one(a: str | None, b: str | None) -> float | None:
        if not a or b is None:
            return None
        if a in b:
            return 1.0
        # The longest length at which some stretch of the target lies in the source; found by halving, as shorter ones do too.
        low, high = 0, len(a) - 1
        while low < high:
            k = (low + high + 1) // 2
            if any(a[i : i + k] in b for i in range(len(a) - k + 1)):
                low = k
            else:
                high = k - 1
        return low / len(a)

    return pd.Series([one(a, b) for a, b in zip(target, source)], dtype="float64")


def collapsed(text: Column) -> Column:
    """White space runs as one blank, ends trimmed (apply after nfkc for questions)."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def squeezed(text: Column) -> Column:
    """Text without white space (apply after nfkc for labels)."""
    return F.regexp_replace(text, r"\s+", "")


def label_key(text: Column) -> Column:
    """A table label without stars, list number, bracketed Han number and leading 'of which' marks."""
    t = F.regexp_replace(squeezed(text), r"[*＊]", "")
    t = F.regexp_replace(t, r"^[0-9]+[.、]", "")
    t = F.regexp_replace(t, r"^（[一二三四五六七八九十]+）", "")
    return F.regexp_replace(t, r"^(?:其中[：:])+", "")


def full_label_key(text: Column) -> Column:
    """label_key of any text: NFKC first, then all white space goes. NFKC turns wide brackets into ASCII ones, so these
    are the ones around the Han number (the reference looks for wide ones after NFKC and never finds any)."""
    t = F.regexp_replace(nfkc(text), r"[\s\x1c-\x1f\x85\x{1680}\x{2028}\x{2029}]+", "")
    t = F.regexp_replace(F.regexp_replace(t, r"\*", ""), r"^[0-9]+[.、]", "")
    t = F.regexp_replace(t, r"^\([一二三四五六七八九十]+\)", "")
    return F.regexp_replace(t, r"^(?:其中:)+", "")


def file_key(name: Column) -> Column:
    """A file name's stem in lower case, letters and digits only."""
    stem = F.regexp_replace(F.regexp_replace(name, r"^.*[/\\]", ""), r"(?<=.)\.[^.]*$", "")
    return F.regexp_replace(F.lower(stem), r"[^\p{L}\p{N}]", "")


def clause(text: Column) -> Column:
    """The clause mark at the start, or null."""
    return F.nullif(F.regexp_extract(text, CLAUSE, 1), F.lit(""))


def estimate_tokens(text: Column) -> Column:
    """The number of tokens, at least 1; null text counts as 1."""
    return F.greatest(F.lit(1), F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)))


def sheet_tokens(text: Column) -> Column:
    """Half the length, at least 1: the cheap count for sheet chunks."""
    return F.greatest(F.lit(1), F.floor(F.coalesce(F.length(text), F.lit(0)) / 2).cast("int"))


def redacted(text: Column, most: int = 300) -> Column:
    """Windows paths and credential assignments hidden, cut to `most` characters (the public error form)."""
    t = F.regexp_replace(text, r"[A-Za-z]:\\[^\s\"']+", "[path hidden]")
    t = F.regexp_replace(t, r"(?i)(api[_-]?key|token|secret|password)\s*[=:]\s*[^\s,;]+", "$1=***REDACTED***")
    return F.substring(t, 1, most)


def attachment_id(reference: Column) -> Column:
    """The number that starts the last part of a path-like reference, or null."""
    return F.nullif(F.regexp_extract(reference, r"(?:^|[/\\])([0-9]+)_", 1), F.lit(""))


def bigrams(run: Column) -> Column:
    """The neighbouring pairs of a Han run; none for runs of one."""
    n = F.length(run)
    return F.when(n < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: run.substr(i, F.lit(2))))


def model_json(text: Column) -> Column:
    """The JSON object in a model's answer: code fence stripped, from the first brace to the last, or null."""
    body = F.regexp_replace(F.trim(text), r"(?s)^```[^\n]*\n|\n?```$", "")
    return F.when(F.try_parse_json(F.regexp_extract(body, r"(?s)(\{.*\})", 1)).isNotNull(), F.regexp_extract(body, r"(?s)(\{.*\})", 1))


def numbers_in(text: Column) -> Column:
    """The distinct numbers of a text, commas removed and full-width percent folded; a number inside a word is none."""
    found = F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9_])([-+]?[0-9]+(?:[,.][0-9]+)*(?:%|％)?)(?![A-Za-z0-9_])"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.translate(x, "％,，", "%")))
