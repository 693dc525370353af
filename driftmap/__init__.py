"""Embedding drift and topic analytics on Spark: DataFrames in, DataFrames out."""

import sys

from pyspark import cloudpickle

from driftmap.functions.text import drop_stopwords, remove_stopwords, url_tokens
from driftmap.functions.vectors import (
    abs_difference,
    cosine_distance,
    dot_product,
    euclidean_distance,
    link_count,
    link_counts,
    parse_vector,
    rowwise_minmax,
    squared_distance,
    to_features,
    with_vector,
)
from driftmap.operators.cluster import (
    cluster_centers,
    cluster_sizes,
    cluster_summary,
    fit_clusters,
    silhouette,
    sweep_k,
    topic_model,
)
from driftmap.operators.components import connected_components
from driftmap.operators.correlation import correlation_matrix
from driftmap.operators.density import core_points, dbscan, density_levels, density_tree, sparse_neighbors
from driftmap.operators.encoder import Encoder, autoencode, autoencoder_fit, reconstruct, reconstruction_error
from driftmap.operators.hierarchy import core_distances, density_hierarchy, merge_tree, reachability_tree
from driftmap.operators.keywords import cluster_keywords, explode_tokens, token_counts
from driftmap.operators.neighbors import eps_neighbors, expand_neighbors
from driftmap.operators.pairs import consecutive_pairs
from driftmap.operators.profile import (
    changed_share,
    corrupt_profile,
    distinct_keys,
    exact_quantiles,
    hexagons,
    histogram,
    histogram_2d,
    kernel_density,
    null_counts,
    row_count,
    snapshots_per_key,
    summary_stats,
    unchanged_keys,
    value_counts,
    vector_coverage,
    vector_lengths,
    zero_counts,
    zero_share,
)
from driftmap.operators.reduce import (
    explained_variance,
    optimal_k,
    pca_model,
    pca_project,
    project_2d,
    standardize,
)
from driftmap.operators.relational import (
    assemble,
    changed_only,
    cluster_members,
    hash_sample,
    keep_relevant,
    name_clusters,
    non_negative,
    not_null,
    top_k,
    top_n_per_group,
)
from driftmap.operators.scale import clear_scratch
from driftmap.operators.silhouette import silhouette_exact
from driftmap.operators.splits import fit_splits, label_splits, sweep_splits
from driftmap.operators.topics import topic_tables
from driftmap.operators.training import autoencoder_fit_synchronous
from driftmap.plans.drift import MEASURES, semantic_drift
from driftmap.plans.history import add_week, drift_so_far, last_snapshots
from driftmap.session import get_spark
from driftmap.sources.crawl import flatten_crawl, read_crawl, read_points, read_relevant_urls
from driftmap.sources.sinks import load_model, save_model, write_table

# Functions sent to executors carry their code, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = [name for name in dir() if not name.startswith("_")]
