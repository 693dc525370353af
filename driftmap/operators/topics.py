"""Topic models whose vocabulary is a table: expectation maximisation as joins and partial sums.

The state is one row per document and term, ``id, term, n, share``: how often the term occurs there and how its
occurrences are shared among the topics. A pass sums the shares by document, by term and over all, joins the first two sums
back and shares anew; it is one job that ends in a table in the shared folder. Sums are combined before the shuffle,
and rows of a term or document that holds too many rows stay where they are (``scale.lookup``). All other joins go by
shuffles, as the sums grow with the input and a broadcast in each pass would send them through the driver, which so holds
nothing but the number of terms, the hot keys and the sums over all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftmap.operators.scale import cut, hot_hashes, lookup


def _normal(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda s, v: s + v)
    return F.transform(values, lambda v: v / total)


def term_shares(df: DataFrame, k: int, id_col: str = "id", tokens: str = "tokens", seed: int = 1) -> DataFrame:
    """``id, term, n, share`` to begin with; shares come from a hash of ``id``, ``term``, topic and ``seed``."""
    counts = (
        df.select(F.col(id_col).alias("id"), F.explode(tokens).alias("term"))
        .filter("id IS NOT NULL AND term IS NOT NULL")
        .groupBy("id", "term")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    coins = [F.pmod(F.xxhash64("id", "term", F.lit(seed), F.lit(j)), F.lit(1 << 20)) + 1 for j in range(k)]
    return counts.withColumn("share", _normal(F.array(*[c.cast("double") for c in coins])))


def _sums(k: int) -> Column:
    return F.array(*[F.sum(F.col("n") * F.col("share")[j]) for j in range(k)])


def topic_tables(
    df: DataFrame,
    k: int,
    n_terms: int = 3,
    id_col: str = "id",
    tokens: str = "tokens",
    max_iter: int = 20,
    seed: int = 1,
    doc_weight: float | None = None,
    term_weight: float = 0.1,
) -> tuple[DataFrame, DataFrame]:
    """LDA over token lists by expectation maximisation: ``topic, term, weight`` and ``id, prediction``.

    ``doc_weight`` (``50 / k`` by default) and ``term_weight`` are what is added to each sum of a document and of a term.
    The first result holds the ``n_terms`` heaviest terms of each topic, the second one row per row of ``df`` with its
    likeliest topic. The result does not depend on partitions, but for the last digits of sums.

    Rows with equal ids are one document; rows with no id or no tokens have no topic (NULL); without any tokens there
    are no terms. Equal weights are ordered by term, equal topics by number.
    """
    doc_weight = 50.0 / k if doc_weight is None else doc_weight
    state = cut(term_shares(df, k, id_col, tokens, seed))
    terms = state.select("term").distinct().count()
    rows = state.count()
    hot = {name: hot_hashes(state, [name], at_most=rows) for name in ("id", "term")}
    for _ in range(max_iter):
        by_doc = state.groupBy("id").agg(_sums(k).alias("of_doc")).hint("merge")
        by_term = state.groupBy("term").agg(_sums(k).alias("of_term")).hint("merge")
        of_all = state.agg(_sums(k)).scalar()
        met = lookup(state.select("id", "term", "n"), by_doc, ["id"], "inner", hot=hot["id"])
        met = lookup(met, by_term, ["term"], "inner", hot=hot["term"])
        parts = [
            (F.col("of_term")[j] + term_weight) * (F.col("of_doc")[j] + doc_weight) / (of_all[j] + terms * term_weight)
            for j in range(k)
        ]
        state = cut(met.select("id", "term", "n", F.array(*parts).alias("share")).withColumn("share", _normal(F.col("share"))))

    of_all = state.agg(_sums(k)).scalar()
    weights = state.groupBy("term").agg(_sums(k).alias("of_term")).select(
        "term", F.posexplode(F.array(*[F.col("of_term")[j] / of_all[j] for j in range(k)])).alias("topic", "weight")
    )
    heaviest = Window.partitionBy("topic").orderBy(F.desc("weight"), "term")
    top = weights.withColumn("place", F.row_number().over(heaviest)).filter(F.col("place") <= n_terms)
    best = state.groupBy("id").agg(_sums(k).alias("of_doc")).select(
        "id", (F.array_position("of_doc", F.array_max("of_doc")) - 1).cast("int").alias("prediction")
    )
    ids = df.select(F.col(id_col).alias("id"), (F.size(tokens) > 0).alias("known"))
    assigned = ids.join(best.hint("merge"), "id", "left").select("id", F.when(F.col("known"), F.col("prediction")).alias("prediction"))
    return top.select("topic", "term", "weight"), assigned
