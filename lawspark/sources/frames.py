"""Snapshot tables as datasets: decoding cells, pruning columns, reading files."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.names import Names
from ..plans.spec import Codec, Schema

TIME = "t"


@dataclass(frozen=True)
class Dataset:
    """A wide table with one row per snapshot: column t (its time or number), then a double for each known column, named c0,
    c1, ... so that dots and case in the original names don't matter. Observed values only; NaN is null."""

    name: str
    names: Names
    frame: DataFrame
    short: dict[str, str] = field(default_factory=dict)

    def column(self, name: str) -> Column:
        return F.col(self.short[name])

    def has(self, name: str) -> bool:
        return name in self.short

    def where(self, condition: Column | str) -> Dataset:
        return Dataset(self.name, self.names, self.frame.where(condition), self.short)

    def summary(self) -> dict:
        return {"name": self.name, **self.names.summary()}


def decoded(cell: Column, kind: T.DataType, codec: Codec) -> Column:
    """The observed number of a cell. Records give their primary field, under either codec plain numbers give themselves; the
    clean field is never read."""
    if codec.kind == "dict_gt_hidden":
        if isinstance(kind, T.StructType):
            cell = cell.getField(codec.primary) if codec.primary in kind.names else F.lit(None)
        elif isinstance(kind, T.MapType):
            cell = F.try_element_at(cell, F.lit(codec.primary))
    number = cell.cast("double")
    return F.when(~F.isnan(number), number)


def dataset(df: DataFrame, schema: Schema, name: str = "dataframe", timestamp: str | None = None) -> Dataset:
    """Keeps the columns that the schema reads, measured ones first, and decodes their cells: one projection, which Catalyst
    pushes down to the scan."""
    names = Names.of(schema, df.columns)
    if timestamp is None and "timestamp" in df.columns:
        timestamp = "timestamp"
    when = F.col(f"`{timestamp}`") if timestamp else F.monotonically_increasing_id()
    short = {c: f"c{k}" for k, c in enumerate(names.columns)}
    kinds = {f.name: f.dataType for f in df.schema}
    cells = [decoded(F.col(f"`{c}`"), kinds[c], schema.spec.cell_codec).alias(s) for c, s in short.items()]
    return Dataset(name, names, df.select(when.alias(TIME), *cells), short)


def dataset_from_matrix(spark: SparkSession, columns: Sequence[str], matrix, schema: Schema, name: str = "matrix", timestamps=None) -> Dataset:
    """A dataset from numbers in memory: one row a snapshot."""
    when = list(range(len(matrix))) if timestamps is None else [x.item() if hasattr(x, "item") else x for x in timestamps]
    rows = [(t, *(None if v != v else float(v) for v in row)) for t, row in zip(when, matrix)]
    kind = "string" if when and isinstance(when[0], str) else "double" if when and isinstance(when[0], float) else "long"
    fields = [T.StructField("__t", T._parse_datatype_string(kind))] + [T.StructField(c, T.DoubleType()) for c in columns]
    return dataset(spark.createDataFrame(rows, T.StructType(fields)), schema, name, "__t")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table by its extension: Parquet, ORC, CSV or JSON through Spark's readers, or a pickled pandas frame."""
    kind = path.rstrip("/").rpartition(".")[2].lower()
    if kind in ("pkl", "pickle"):
        return read_pickle(spark, path)
    if kind == "csv":
        return spark.read.csv(path, header=True, inferSchema=True)
    if kind in ("json", "jsonl"):
        return spark.read.json(path)
    return spark.read.orc(path) if kind == "orc" else spark.read.parquet(path)


#: The fields of a telemetry cell.
CELL = "hidden_ground_truth double, ground_truth double, perturbed double, corrected double, confidence double"
# End of fixed values.


def read_pickle(spark: SparkSession, path: str) -> DataFrame:
    """A pandas frame from a pickle. Unpickling runs code: for trusted files on the driver only. Large tables should come as
    Parquet. Cells that are dicts become records of CELL."""
    import pandas as pd

    raw = pd.read_pickle(path)
    if not hasattr(raw, "columns"):
        raise ValueError(f"{path}: not a table, but {type(raw).__name__}")
    return from_pandas(spark, raw)


def from_pandas(spark: SparkSession, raw) -> DataFrame:
    fields, makers = [], []
    record = T._parse_datatype_string(CELL)
    for c in raw.columns:
        values = raw[c]
        if any(isinstance(v, dict) for v in values):
            fields.append(T.StructField(str(c), record))
            makers.append(lambda v: tuple(_number(v.get(n)) for n in record.names) if isinstance(v, dict) else (None, _number(v), None, None, None))
        elif values.dtype.kind in "ifub":
            fields.append(T.StructField(str(c), T.DoubleType()))
            makers.append(_number)
        else:
            fields.append(T.StructField(str(c), T.StringType()))
            makers.append(lambda v: None if v is None or v != v else str(v))
    columns = [[m(v) for v in raw[c]] for c, m in zip(raw.columns, makers)]
    return spark.createDataFrame(list(zip(*columns)), T.StructType(fields))


def _number(v) -> float | None:
    return None if v is None or v != v else float(v)


def parse_time(c: Column) -> Column:
    """Telemetry times, as 2004/03/01 00:30 UTC."""
    return F.to_timestamp(F.regexp_replace(c, " UTC$", ""), "yyyy/MM/dd HH:mm")
