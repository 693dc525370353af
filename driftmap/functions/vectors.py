"""Column expressions on vectors kept as arrays of numbers.

All arithmetic is done in double precision inside the JVM, for vectors of any length. NULL in gives NULL out.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _double(c: Column | str) -> Column:
    return _col(c).cast("array<double>")


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, v: total + v)


def parse_vector(col: Column | str) -> Column:
    """``"[0.1, -0.2]"`` to an array of floats; text that is not a list, such as ``"not set"``, gives NULL."""
    return F.from_json(_col(col), "array<float>")


def dot_product(a: Column | str, b: Column | str) -> Column:
    return _total(F.zip_with(_double(a), _double(b), lambda x, y: x * y))


def squared_distance(a: Column | str, b: Column | str) -> Column:
    return _total(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y)))


def euclidean_distance(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(squared_distance(a, b))


def cosine_distance(a: Column | str, b: Column | str, clamp: bool = False) -> Column:
    """One minus the cosine of the angle; NULL if a vector is all zero.

    Equal vectors may give a value a few 1e-16 off zero on either side; ``clamp`` keeps results within 0..2.
    """
    lengths = F.sqrt(dot_product(a, a)) * F.sqrt(dot_product(b, b))
    distance = F.lit(1.0) - dot_product(a, b) / F.nullif(lengths, F.lit(0.0))
    if not clamp:
        return distance
    bounded = F.least(F.greatest(distance, F.lit(0.0)), F.lit(2.0))
    return F.when(distance.isNotNull(), bounded)


def abs_difference(a: Column | str, b: Column | str) -> Column:
    return F.abs(_col(b) - _col(a))


def link_count(col: Column | str) -> Column:
    """Length of a list; a NULL list has no length."""
    return F.when(_col(col).isNotNull(), F.size(_col(col)))


def rowwise_minmax(col: Column | str) -> Column:
    """Scale each vector on its own to 0..1; a constant vector becomes all zero."""
    # The one-element outer list binds the bounds once per row instead of once per element.
    bound = F.array(
        F.struct(
            _double(col).alias("v"), F.array_min(_double(col)).alias("lo"), F.array_max(_double(col)).alias("hi")
        )
    )
    scaled = F.transform(
        bound,
        lambda s: F.transform(
            s["v"],
            lambda x: F.when(s["hi"] > s["lo"], (x - s["lo"]) / (s["hi"] - s["lo"])).otherwise(F.lit(0.0)),
        ),
    )
    return F.when(_col(col).isNotNull(), F.element_at(scaled, 1))


def with_vector(df: DataFrame, col: str = "semanticVector") -> DataFrame:
    """Rows whose vector text is set."""
    return df.filter(F.col(col).startswith("["))


def link_counts(df: DataFrame, cols: tuple[str, ...] = ("internalLinks", "externalLinks")) -> DataFrame:
    """Add ``<col>Count`` for each list column."""
    return df.withColumns({f"{c}Count": link_count(c) for c in cols})


def to_features(df: DataFrame, col: str, out: str = "features") -> DataFrame:
    """Add the ML vector of an array column; rows without a vector are left out."""
    return df.filter(F.col(col).isNotNull()).withColumn(out, array_to_vector(_double(col)))
