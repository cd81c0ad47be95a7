"""Reference inputs and text extracts."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import base64_text
from .tables import load_csv

CODEBOOK = "entity string, attribute string, code string"


def clean_codebook(df: DataFrame) -> DataFrame:
    """Long table (entity, attribute, code): codes trimmed, empty ones dropped, each once."""
    return (
        df.select("entity", "attribute", F.trim("code").alias("code"))
        .filter(F.col("code").isNotNull() & (F.col("code") != ""))
        .dropDuplicates()
    )


def load_codebook(spark: SparkSession, path: str) -> DataFrame:
    return clean_codebook(load_csv(spark, path, CODEBOOK))


def load_exceptions(spark: SparkSession, path: str) -> DataFrame:
    """Names that cannot be put right at their source: (entity, name), each once."""
    df = load_csv(spark, path, "entity string, name string")
    return df.select("entity", F.trim("name").alias("name")).filter(F.col("name") != "").dropDuplicates()


#: One row per file is broadcast up to this many files; the listing tells their number.
FILES = 50_000


def quoted_fields(line: Column | str, sep: str) -> Column:
    """The fields of a separated line, as an array.

    A field whose first and last characters are quotes may hold separators, and quotes that are doubled. Any other quote
    is a character like others. A quoted field does not go on in the next line.
    """
    line = F.col(line) if isinstance(line, str) else line
    cut = re.escape(sep)
    field = f'{cut}("[^"]*+(?:""[^"]*+)*+"(?={cut}|$)|(?:(?!{cut}).)*+)'
    raw = F.regexp_extract_all(F.concat(F.lit(sep), line), F.lit(f"(?s){field}"), F.lit(1))
    closed = f'(?s)^"[^"]*+(?:""[^"]*+)*+"$'
    return F.transform(raw, lambda x: F.when(x.rlike(closed), F.replace(F.substr(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x))


def load_extracts(spark: SparkSession, path: str, header: Sequence[str], sep: str = "\t") -> DataFrame:
    """All extracts under ``path`` as one table of text columns plus ``source_file``.

    Each file starts with a preamble of free text, then its heading line. Lines up to the heading are dropped by
    position: line ids rise within a file, and only the split that holds the heading has lines before it. Files
    are split over tasks as any text file; short lines get nulls at the end. Fields may be quoted (see
    ``quoted_fields``), in the heading too.

    Nothing is dropped unseen: ``surplus`` holds the fields beyond the heading, and for a file without the heading
    line each line as it is, with nulls in the columns. ``sep`` is taken as it is written. Nothing runs while the
    plan is built.
    """
    lines = spark.read.text(path).select(
        F.col("value"), F.col("_metadata.file_path").alias("source_file"), F.monotonically_increasing_id().alias("line")
    )
    # A quick look sorts out most lines, before the fields are told apart.
    is_heading = F.col("value").startswith(header[0]) | F.col("value").startswith('"')
    is_heading &= quoted_fields("value", sep) == F.array(*map(F.lit, header))
    found = lines.filter(is_heading).groupBy("source_file").agg(F.min("line").alias("heading_line"))
    if len(lines.inputFiles()) <= FILES:
        found = F.broadcast(found)
    split = F.shiftright("line", 33)
    heading_split = F.shiftright("heading_line", 33)
    body = (
        lines.join(found, "source_file", "left")
        .filter(F.col("heading_line").isNull() | (split != heading_split) | (F.col("line") > F.col("heading_line")))
        .filter(~is_heading & (F.col("value") != ""))
    )
    headless = F.col("heading_line").isNull()
    body = body.withColumn("parts", F.when(~headless, quoted_fields("value", sep)))
    beyond = F.nullif(F.array_join(F.slice("parts", len(header) + 1, F.greatest(F.size("parts"), F.lit(1))), sep), F.lit(""))
    return body.select(
        *[F.nullif(F.get("parts", F.lit(i)), F.lit("")).alias(h) for i, h in enumerate(header)],
        F.when(headless, F.col("value")).otherwise(beyond).alias("surplus"),
        F.element_at(F.split("source_file", "/"), -1).alias("source_file"),
    )


def conform_extract(df: DataFrame, mapping: Mapping[str, tuple[str, str]], constants: Mapping[str, str] = {}) -> DataFrame:
    """Select and rename ``{model name: (source heading, type)}``, coerce, add constants, fill ``NA`` and 0."""
    picked: list[Column] = [F.lit(v).alias(n) for n, v in constants.items()]
    text, numbers = list(constants), []
    for name, (heading, kind) in mapping.items():
        picked.append(F.col(heading).try_cast(kind).alias(name))
        (text if kind == "string" else numbers).append(name)
    return df.select(*picked).fillna("NA", subset=text).fillna(0, subset=numbers)


def files_to_base64(spark: SparkSession, path: str) -> DataFrame:
    """One row per file under ``path``: its name and its content in base64."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("file_name"), base64_text("content").alias("content_base64")
    )
