"""String functions: byte distances, file names, key = value lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_bytes(s: Column) -> Column:
    """A string whose characters are the UTF-8 bytes of ``s``."""
    return F.decode(F.encode(s, "UTF-8"), "ISO-8859-1")


def byte_distance(a: Column, b: Column) -> Column:
    """Edit distance in bytes, unit costs."""
    return F.levenshtein(as_bytes(a), as_bytes(b)).cast("long")


def is_repetitive(s: Column) -> Column:
    """More than half of the characters are i, l or I."""
    return (F.length(s) - F.length(F.translate(s, "ilI", ""))) * 2 > F.length(s)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """The file name without its last suffix."""
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def key_of(line: Column) -> Column:
    return F.substring_index(line, "=", 1)


def value_of(line: Column) -> Column:
    """What follows the first equals sign; null without one."""
    return F.when(F.instr(line, "=") > 0, F.substr(line, F.instr(line, "=") + 1))


def config_lines(lines: DataFrame, by: str, order: str, line: str) -> DataFrame:
    """Ordered key and value pairs of each file, up to its first line without an equals sign; duplicates stay."""
    before = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ok = lines.withColumn("__bad", F.max((F.instr(line, "=") == 0).cast("int")).over(before)).where("__bad = 0")
    return ok.select(by, order, F.substring_index(line, "=", 1).alias("key"), value_of(F.col(line)).alias("value"))


def joined_lines(df: DataFrame, by: str, order: str, text: str, out: str = "text") -> DataFrame:
    """The texts of a group in order, one to a line."""
    parts = F.array_sort(F.collect_list(F.struct(order, text)))
    return df.groupBy(by).agg(F.array_join(F.transform(parts, lambda p: p[text]), "\n").alias(out))


def error_rate(truth: Column, read: Column) -> Column:
    """Byte edits for each byte of the truth."""
    return byte_distance(truth, read) / F.greatest(F.octet_length(truth), F.lit(1))
