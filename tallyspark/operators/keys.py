"""Key and uniqueness checks.

Counting is a grouped aggregate (combined before the shuffle), and rows are fetched by a join against the
offending keys, never by a window over the key: a key that holds a large part of all rows is then split by
the adaptive skew join instead of landing in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col
from ..sources.scratch import measured
from ..sources.tables import union_all


def duplicate_key_counts(df: DataFrame, key: Sequence[str], name: str = "key_count") -> DataFrame:
    """Keys that occur more than once, with their count. Null keys count as one key."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias(name)).filter(F.col(name) > 1)


def duplicate_keys(df: DataFrame, key: Sequence[str], name: str = "key_count") -> DataFrame:
    """Full rows of the keys that occur more than once, with the count. Rows with null keys are included."""
    repeated = duplicate_key_counts(df, key, name)
    renamed = repeated.select(*[F.col(k).alias(f"__{k}") for k in key], name)
    cond = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key]
    return df.join(renamed, cond, "inner").drop(*[f"__{k}" for k in key])


def functional_dependency(
    df: DataFrame, lhs: Sequence[str], rhs: Sequence[str], count_nulls: bool = False, name: str = "n_values"
) -> DataFrame:
    """Left sides with more than one right side.

    Without ``count_nulls`` a right side with a null part is no value; with it, null is a value of its own.
    """
    pairs = df.select(*lhs, *rhs).distinct()
    if not count_nulls:
        pairs = pairs.dropna(subset=list(rhs))
    return pairs.groupBy(*lhs).agg(F.count(F.lit(1)).alias(name)).filter(F.col(name) > 1)


def grain_duplicates(df: DataFrame, grain: Sequence[str], name: str = "n_rows") -> DataFrame:
    return duplicate_key_counts(df, grain, name)


def grain_duplicates_sql(view: str, grain: Sequence[str], name: str = "n_rows") -> str:
    """SQL text of the same check over a registered view."""
    columns = ", ".join(grain)
    return f"SELECT {columns}, count(*) AS {name} FROM {view} GROUP BY {columns} HAVING count(*) > 1"


def duplicate_row_count(tables: Mapping[str, DataFrame], digest: Sequence[str] = ()) -> DataFrame:
    """Rows and rows minus distinct rows per table, exact.

    Whole rows are not shuffled. A first pass counts row hashes (8 bytes each) and keeps the repeated ones; a second
    one compares only the rows with a repeated hash, column by column, so hash collisions do not count. Columns named
    in ``digest`` (long texts) are compared by SHA-256. Tables without a repeated hash are not read again.
    """
    hashes = union_all(df.select(F.lit(n).alias("__table"), F.xxhash64(*df.columns).alias("__hash")) for n, df in tables.items())
    per_hash = hashes.groupBy("__table", "__hash").agg(F.count(F.lit(1)).alias("__n"))
    repeated = measured(per_hash.filter(F.col("__n") > 1).drop("__n"))
    suspects = {r[0] for r in repeated.select("__table").distinct().collect()}  # names of tables only
    parts = []
    for table, df in tables.items():
        hashed = df.withColumn("__hash", F.xxhash64(*df.columns))
        own = repeated.filter(F.col("__table") == table)
        keys = [F.unhex(F.sha2(c, 256)).alias(c) if c in digest else F.col(c) for c in df.columns]
        groups = hashed.join(own, "__hash", "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
        name, zero = F.lit(table).alias("table_name"), F.lit(0).cast("bigint")
        # A bare count is read from the files' footers.
        parts.append(df.agg(F.count(F.lit(1)).alias("n_rows")).select(name, "n_rows", zero.alias("n_duplicates")))
        if table not in suspects:
            continue
        copies = groups.agg(F.sum(F.col("__n") - 1).alias("n_duplicates"))
        parts.append(copies.select(name, zero.alias("n_rows"), F.coalesce("n_duplicates", zero).alias("n_duplicates")))
    return union_all(parts).groupBy("table_name").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_duplicates").alias("n_duplicates"))


def recomposed(parts: Sequence[str | Column], sep: str = "_") -> Column:
    """Parts joined with a separator; null as soon as one part is null."""
    pieces = []
    for i, p in enumerate(parts):
        pieces += ([F.lit(sep)] if i and sep else []) + [col(p).cast("string")]
    return F.concat(*pieces)


def key_recomposition(df: DataFrame, key: str, parts: Sequence[str | Column], sep: str = "_") -> DataFrame:
    """Rows whose key is not its parts joined. A null part is a violation (null-safe comparison)."""
    return df.withColumn("expected", recomposed(parts, sep)).filter(~F.col(key).eqNullSafe(F.col("expected")))


def name_recomposition(df: DataFrame, name: str, parts: Sequence[str | Column], sep: str = "_") -> DataFrame:
    """Rows whose name is not its attribute tokens joined; null tokens are skipped."""
    return df.withColumn("expected", F.concat_ws(sep, *[col(p) for p in parts])).filter(F.col(name) != F.col("expected"))


def one_to_one(df: DataFrame, parts: Sequence[str | Column], stored: str, sep: str = "_") -> DataFrame:
    """Composed names that go with more than one stored name."""
    built = df.select(F.concat_ws(sep, *[col(p).cast("string") for p in parts]).alias("built_name"), stored)
    return functional_dependency(built, ["built_name"], [stored], name="n_stored")


def keep_one_per_key(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The row of each key that comes first in a total order.

    A grouped ``min`` over (order, row) is combined before the shuffle, so a hot key costs one row per task.
    The order must not leave ties that matter; remaining ties fall to the smallest row.
    """
    rest = [c for c in df.columns if c not in key]
    packed = F.struct(*[o.alias(f"__o{i}") for i, o in enumerate(order)], *[F.col(c) for c in rest])
    first = df.groupBy(*key).agg(F.min(packed).alias("__first"))
    return first.select(*[F.col(k) if k in key else F.col(f"__first.{k}").alias(k) for k in df.columns])


#: Files up to which a second read is limited to the files that hold a chosen row, by their names.
NAMED_FILES = 10_000


def keep_one_located(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """As ``keep_one_per_key`` for a frame read from files, with whole rows fetched last (late materialisation).

    The first pass reads the key and the order alone and finds the address of each key's first row: its file and its
    number there, to which remaining ties fall. The second pass reads whole rows only from files that hold a chosen
    one, and takes those whose address is among the chosen ones. ``df`` may filter the files but not join or group.
    """
    place = [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row")]
    ranks = [f"__o{i}" for i in range(len(order))]
    narrow = df.select(*key, *[o.alias(r) for o, r in zip(order, ranks)], *place)
    first = narrow.groupBy(*key).agg(F.min(F.struct(*ranks, "__file", "__row")).alias("__first"))
    chosen = measured(first.select("__first.__file", "__first.__row"))
    files = [r[0] for r in chosen.select("__file").distinct().limit(NAMED_FILES + 1).collect()]  # names of files only
    if len(files) <= NAMED_FILES:
        df = df.filter(F.col("_metadata.file_path").isin(files))
    return df.select("*", *place).join(chosen, ["__file", "__row"], "left_semi").select(*df.columns)


def keys_per_name(df: DataFrame, name: Sequence[str], key: str, out: str = "n_keys") -> DataFrame:
    """Number of distinct keys under each name."""
    return df.groupBy(*name).agg(F.countDistinct(key).alias(out))
