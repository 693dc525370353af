"""The corpus pipeline: filter, deduplicate, decontaminate, mix and shard ``documents``."""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from driftmap.llm.common import table  # noqa: E402
from driftmap.llm.decontaminate import contamination  # noqa: E402
from driftmap.llm.mixing import mix  # noqa: E402
from driftmap.llm.near_dedup import near_duplicates  # noqa: E402
from driftmap.llm.queries import THRESHOLD, toxic_labels  # noqa: E402
from driftmap.llm.sharding import interleave  # noqa: E402
from driftmap.llm.toxicity import fit, score  # noqa: E402
from driftmap.operators.scale import cut  # noqa: E402


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows as ``doc`` with what identifies them: a name for the id, also if NULL, and the hash of the text."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))
    return docs.select(F.struct("*").alias("doc"), name.alias("key"), F.xxhash64("text").alias("text_hash"))


def _named(rows: DataFrame) -> DataFrame:
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))
    return rows.select(name.alias("key"), "text_hash").distinct()


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return score(docs, fit(docs, toxic_labels(spark, sf_dir))).filter(F.col("score") < THRESHOLD).select("doc.*")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, also where ids are NULL or repeat; of repeated rows, one.

    It is the one with the smallest id, a row without id last, and with the smallest hash of the text if ids tie.
    """
    found = near_duplicates(docs, size=5, percent=80, with_component=True)
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    chosen = found.filter("component IS NOT NULL").groupBy("component").agg(F.min(order).alias("row")).select("row.*")
    alone = found.filter("component IS NULL")
    kept = _named(chosen.select("doc_id", "text_hash").unionByName(alone.select("doc_id", "text_hash")))
    # Repeated rows go first, so that a row repeated in a third of the table never gathers.
    rows = _keyed(docs).dropDuplicates(["key", "text_hash"])
    return rows.join(kept, ["key", "text_hash"], "left_semi").select("doc.*")


def not_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of ten words, and no shorter item, with the benchmark."""
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    return _keyed(docs).join(_named(found.filter("n_hit > 0")), ["key", "text_hash"], "left_anti").select("doc.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mix(docs).select("doc.*")


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ``shard`` and ``slot`` (in place of columns so named), each shard with the mixture of the whole."""
    placed = interleave(docs, 40, carry=[c for c in docs.columns if c.lower() not in ("shard", "slot")])
    return placed.select("doc.*", F.col("shard"), F.col("slot"))


STAGES = [
    ("toxicity", not_toxic),
    ("MinHash near-dedup", one_of_each),
    ("benchmark decontamination", not_contaminated),
    ("mixing sources to target weights", mixed),
    ("sharding", sharded),
]

#: Training a classifier and MinHash cannot be stated in SQL; tests/llm compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
