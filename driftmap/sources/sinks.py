"""Table and model sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftmap.operators.encoder import Encoder


def write_table(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    partition_by: str | Sequence[str] | None = None,
    mode: str = "overwrite",
) -> None:
    """Write ``df`` as parquet or as CSV with a header; CSV carries nested columns as JSON text."""
    if fmt == "csv":
        nested = (T.ArrayType, T.StructType, T.MapType)
        df = df.select(
            *[
                F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name)
                for f in df.schema.fields
            ]
        )
    writer = df.write.mode(mode)
    if partition_by:
        names = [partition_by] if isinstance(partition_by, str) else list(partition_by)
        writer = writer.partitionBy(*names)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)


def save_model(model, path: str, spark: SparkSession | None = None) -> None:
    """Save a Spark ML model, or an :class:`Encoder` as a small parquet table of named arrays."""
    if isinstance(model, Encoder):
        spark = spark or SparkSession.getActiveSession()
        rows = [
            (name, i, list(a.shape), [float(v) for v in a.ravel()], model.hidden, model.bottleneck, model.output)
            for name, arrays in (("weight", model.weights), ("bias", model.biases))
            for i, a in enumerate(arrays)
        ]
        schema = (
            "name string, layer int, shape array<int>, data array<double>, hidden string, bottleneck string, "
            "output string"
        )
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(path)
    else:
        model.write().overwrite().save(path)


def load_model(spark: SparkSession, path: str):
    """Load what :func:`save_model` wrote."""
    try:
        spark.read.text(f"{path}/metadata").schema
    except AnalysisException:
        # A model's own parameters: one row per layer array.
        return Encoder.from_rows(spark.read.parquet(path).collect())
    return DefaultParamsReader.loadParamsInstance(path, spark.sparkContext)
