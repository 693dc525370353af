"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmap.operators.scale import scratch_path

#: A word is a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Number of words; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def draw_key(seed: str, *cols: Column) -> Column:
    """A repeatable pseudo-random string from the values of ``cols``; NULL differs from the empty string."""
    parts = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in cols]
    return F.md5(F.concat_ws(":", F.lit(seed), *parts))


def first_32_bits(key: Column) -> Column:
    """The first 32 bits of a ``draw_key`` as a number."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint")


def group_label(col: Column) -> Column:
    """A label that is never NULL, so that plain joins and windows also keep the NULL group together."""
    return F.coalesce(F.concat(F.lit("s"), col.cast("string")), F.lit("n"))


def root_of(rows: int) -> int:
    """Buckets for ``rows`` rows such that neither their number nor their rows outgrow a task."""
    return max(1, math.ceil(math.sqrt(rows)))


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply ``f`` to every Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = f(batch)
            if out is not None:
                yield out

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut a batch where its texts exceed ``most_bytes``, so that long texts do not add up in memory."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
    start = held = 0
    for i, size in enumerate(sizes):
        if held and held + size > most_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if len(sizes) > start:
        yield batch.slice(start)


#: While an intermediate table is written: shuffle files go when it is done, and Arrow batches stay small for any rows.
_WHILE_WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(32 << 20),
}


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once, compressed, to the shared folder and return that table, with no lineage behind it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = {key: spark.conf.get(key, None) for key in _WHILE_WRITING}
    try:
        for key, value in _WHILE_WRITING.items():
            spark.conf.set(key, value)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path)
