"""Where tables come from: specs, loading, expected schemas, profiles."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class TableSpec:
    """One table. ``format`` is any Spark data source; ``path`` is left out for ``jdbc`` and other connectors.

    For JDBC, ``partition_column`` with bounds and ``num_partitions`` splits the read over the executors;
    without them the whole table comes through one task.
    """

    name: str
    format: str = "parquet"
    path: str | None = None
    options: Mapping[str, str] = field(default_factory=dict)
    schema: T.StructType | None = None
    partition_column: str | None = None
    lower_bound: str | None = None
    upper_bound: str | None = None
    num_partitions: int | None = None
    keys: tuple[str, ...] = ()
    date_columns: tuple[str, ...] = ()


def reader_options(spec: TableSpec) -> dict[str, str]:
    options = dict(spec.options)
    if spec.format == "jdbc":
        options.setdefault("dbtable", spec.name)
        options.setdefault("pushDownPredicate", "true")
        split = (spec.partition_column, spec.lower_bound, spec.upper_bound, spec.num_partitions)
        if any(s is not None for s in split):
            if any(s is None for s in split):
                raise ValueError(f"{spec.name}: a split read needs column, both bounds and a partition count")
            options |= {
                "partitionColumn": spec.partition_column,
                "lowerBound": str(spec.lower_bound),
                "upperBound": str(spec.upper_bound),
                "numPartitions": str(spec.num_partitions),
            }
    return options


def load_table(spark: SparkSession, spec: TableSpec) -> DataFrame:
    reader = spark.read.format(spec.format).options(**reader_options(spec))
    if spec.schema is not None and spec.format != "jdbc":
        reader = reader.schema(spec.schema)
    return reader.load(spec.path) if spec.path else reader.load()


@dataclass(frozen=True)
class StarSchema:
    """A named set of table specs."""

    specs: Mapping[str, TableSpec]

    @classmethod
    def from_folder(cls, folder: str, names: Iterable[str]) -> StarSchema:
        return cls({n: TableSpec(n, path=f"{folder}/{n}.parquet") for n in names})

    def load(self, spark: SparkSession) -> dict[str, DataFrame]:
        return {n: load_table(spark, s) for n, s in self.specs.items()}

    def register_views(self, spark: SparkSession, prefix: str = "") -> None:
        for n, df in self.load(spark).items():
            df.createOrReplaceTempView(prefix + n)


def load_csv(spark: SparkSession, path: str, schema: T.StructType | str, sep: str = ",") -> DataFrame:
    """CSV with a heading line. The schema is given, not inferred: inferring costs one more pass over the files."""
    return spark.read.schema(schema).option("header", True).option("sep", sep).csv(path)


def load_metastore(spark: SparkSession, name: str, upper: Sequence[str] = ()) -> DataFrame:
    """A catalog table or view, with non-breaking and outer blanks taken out of its headings."""
    df = spark.table(name)
    df = df.toDF(*[c.replace("\u00a0", " ").strip() for c in df.columns])
    return df.withColumns({c: F.upper(c) for c in upper})


def schema_check(spark: SparkSession, tables: Mapping[str, DataFrame], expected: Mapping[str, T.StructType]) -> DataFrame:
    """One row per table column: expected and actual type, and whether they agree. Reads no data."""
    rows = []
    for name, want in expected.items():
        actual = {f.name: f.dataType.simpleString() for f in tables[name].schema}
        wanted = {f.name: f.dataType.simpleString() for f in want}
        for column in wanted | actual:
            e, a = wanted.get(column), actual.get(column)
            rows.append((name, column, e, a, e == a))
    return spark.createDataFrame(
        rows, "table_name string, column_name string, expected string, actual string, matches boolean"
    )


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def table_profile(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row and column count per table. Counting reads no column data from a columnar file."""
    return union_all(
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(n).alias("table_name"), "n_rows", F.lit(len(df.columns)).cast("bigint").alias("n_columns")
        )
        for n, df in tables.items()
    )


def year_spine(df: DataFrame, date: str) -> DataFrame:
    """Every year from the first to the last date of a table, one column ``year``."""
    first, last = F.year(F.min(date)), F.year(F.max(date))
    return df.agg(first.alias("lo"), last.alias("hi")).select(F.explode(F.sequence("lo", "hi")).alias("year"))


def year_values(spark: SparkSession, years: Sequence[int]) -> DataFrame:
    return spark.createDataFrame([(int(y),) for y in years], "year int")


def sample_view(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """First ``n`` rows of a total order (planned as top-k per partition, not as a full sort)."""
    return df.orderBy(*order).limit(n)
