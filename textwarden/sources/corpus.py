"""Text units: reading them, gating them, writing clean copies."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from textwarden.functions import dialect
from textwarden.functions.rules import MAX_TEXT_BYTES
from textwarden.functions.text import fits, is_blank, slashed

#: Change types that bring content into a change set.
SCANNED_CHANGES = ("A", "C", "M", "R")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Gives a scan that has fewer partitions than cores one partition per core.

    Scanning text is bound by regex work, so a small table in a single file would
    keep one core busy.  A table of many files already fills the cluster and is
    left alone: its text is never shuffled.  Only for frames read from files.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys) if keys else df.repartition(cores)


def _tolerant(reader: DataFrameReader, skip_damaged: bool) -> DataFrameReader:
    return reader.option("ignoreCorruptFiles", skip_damaged).option("ignoreMissingFiles", skip_damaged)


def scan_corpus(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, key: str | None = None,
    skip_damaged: bool = False,
) -> DataFrame:
    """Reads a parquet table of text units.

    A damaged or vanished file fails the job.  With ``skip_damaged`` such files are left
    out, and their units are not scanned.
    """
    df = _tolerant(spark.read, skip_damaged).parquet(path)
    if columns:
        df = df.select(*columns)
    return spread(df, *([key] if key else []))


def scan_files(
    spark: SparkSession, path: str, glob: str | None = None, max_bytes: int | None = None,
    skip_damaged: bool = False,
) -> DataFrame:
    """Reads files as units ``(path, text, n_bytes)``.

    The size test is pushed to the file listing, so content that is too large is
    never read.  Bytes that are not UTF-8 become U+FFFD.  Files that cannot be read fail
    the job, unless ``skip_damaged`` leaves them out.
    """
    reader = _tolerant(spark.read.format("binaryFile").option("recursiveFileLookup", True), skip_damaged)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path)
    if max_bytes is not None:
        files = files.filter(F.col("length") <= max_bytes)
    return files.select(
        "path",
        F.make_valid_utf8(F.col("content").cast("string")).alias("text"),
        F.col("length").alias("n_bytes"),
    )


def is_scanned(change: Column, path: Column) -> Column:
    """True for a change that brings content in under a name."""
    return change.isin(*SCANNED_CHANGES) & ~is_blank(path)


def changed_only(df: DataFrame, change: str = "change_type", path: str = "path") -> DataFrame:
    """Keeps added, copied, modified and renamed units; blank names are dropped."""
    return df.filter(is_scanned(F.col(change), F.col(path)))


def with_size_status(
    df: DataFrame, max_bytes: int = MAX_TEXT_BYTES, text: str = "text"
) -> DataFrame:
    """Adds ``n_bytes`` and ``status``: OK or TOO_LARGE."""
    sized = df.select("*", F.octet_length(F.col(text)).alias("n_bytes"))
    status = F.when(F.col("n_bytes") > max_bytes, "TOO_LARGE").otherwise("OK")
    return sized.select("*", status.alias("status"))


def size_gate(df: DataFrame, max_bytes: int = MAX_TEXT_BYTES, text: str = "text") -> DataFrame:
    """Drops units whose UTF-8 size is strictly greater than the limit."""
    return df.filter(fits(F.col(text), max_bytes))


def blank_gate(df: DataFrame, text: str = "text") -> DataFrame:
    """Drops units that hold nothing but white space."""
    return df.filter(~is_blank(F.col(text)))


def glob_regex(glob: str, legacy: bool = False, target: str = dialect.JAVA) -> str | None:
    """The regex of a glob, or None when the glob is invalid.

    ``**`` crosses folders, ``*`` stays within one, ``?`` is any one character.  With
    ``legacy`` a star is the regex quantifier, as in rule files written for that.
    """
    if legacy:
        source = re.sub(r"[.+^${}()|\[\]\\]", lambda m: "\\" + m.group(0), glob).replace("?", ".")
    else:
        marks = {"**": ".*", "*": "[^/]*", "?": "."}
        pieces = re.split(r"(\*\*|\*|\?)", glob)
        source = "".join(marks.get(p) or re.sub(r"[.+^${}()|\[\]\\/]", r"\\\g<0>", p) for p in pieces)
    try:
        return dialect.translate(f"^{source}$", "", target).pattern
    except dialect.RegexError:
        return None


def is_excluded(path: Column, globs: Sequence[str], legacy: bool = False) -> Column:
    """True when the path matches one of the globs; invalid globs match nothing."""
    regexes = [r for r in (glob_regex(g, legacy) for g in globs) if r is not None]
    if not regexes:
        return F.lit(False)
    tests = [slashed(path).rlike(r) for r in regexes]
    return F.coalesce(reduce(lambda a, b: a | b, tests), F.lit(False))


def exclude_globs(
    df: DataFrame, globs: Sequence[str], path: str = "path", legacy: bool = False
) -> DataFrame:
    return df.filter(~is_excluded(F.col(path), globs, legacy))


def ignore_paths(df: DataFrame, ignored: DataFrame, keys: Sequence[str] = ("owner", "path")) -> DataFrame:
    """Drops units whose exact path the owner ignores.

    The size of the list is not known here, so no broadcast is forced: Spark picks it
    from the statistics, and splits hot owners itself when it has to shuffle.
    """
    return df.join(ignored.select(*keys).distinct(), list(keys), "left_anti")


def write_clean_copy(
    df: DataFrame, path: str, sanitized: str = "sanitized", mode: str = "append", text: str = "text"
) -> None:
    """Writes the units with their sanitized text; the column ``text`` stays behind."""
    kept = [c for c in df.columns if c not in (text, "matched", sanitized)]
    df.select(*kept, F.col(sanitized).alias(text)).write.mode(mode).parquet(path)
