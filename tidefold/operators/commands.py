"""Command lines: verb, key, and the rest joined by single spaces as the value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERBS = ["PUT", "GET", "DELETE", "STATS", "COMPACT", "HELP", "QUIT", "EXIT"]


def script(log: DataFrame) -> DataFrame:
    """(seq, line): a log as command lines of uneven case and spacing, for trials."""
    kind = F.col("seq") % 3
    key = F.concat(F.lit("  "), F.col("k"))
    put = F.concat(F.lit("pUt"), key, F.lit("   "), F.coalesce("v", F.lit("x")), F.lit("  end "))
    return log.select("seq", F.when(F.col("op") == 2, F.concat(F.lit(" delete"), key)).when(kind == 0, F.concat(F.lit("get"), key, F.lit(" "))).otherwise(put).alias("line"))


def parse(lines: DataFrame, line: Column) -> DataFrame:
    """lines with verb (null for an empty line or an unknown verb), key and value."""
    words = F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " ")
    verb = F.upper(words[0])
    known = verb.isin(VERBS)
    key = F.when(known & (F.size(words) > 1), words[1])
    value = F.when(known & (F.size(words) > 2) & (verb == "PUT"), F.array_join(F.slice(words, F.lit(3), F.greatest(F.size(words) - 2, F.lit(0))), " "))
    return lines.select("*", F.when(known, verb).alias("verb"), key.alias("key"), value.alias("value"))
