"""Synchronous training of the autoencoder: every step uses one joint batch, whose gradient all tasks add up.

A batch is cut into shares of a few rows. Where a batch is long work, an epoch is one barrier stage: each task reads the
shares dealt to it in the order of steps, sends the summed gradient of its part of the batch to all others, adds up the shares
in a fixed order and takes the same step of Adam as they do. So all tasks hold equal models at all times, and the result
depends neither on their number nor on how rows lay before.

An exchange through the barrier takes a second, so batches that one task adds up in less are not spread. Then an epoch is a chain
of tasks, each with the steps of a small part of the rows: it adds up the shares in the same order, takes the same steps, and
hands the model and the moments to the next.

Rows are ranked once by the hash of their vector. Each epoch permutes the ranks and deals them to batches in turn, so
batches are of even size, are others in each epoch, and rows repeated many times are spread over all of them.

An epoch ends in a written table with its losses, the model and the optimizer's moments. A lost executor repeats the epoch
from the table before; with ``path`` a fit that was stopped goes on after the last epoch that is complete.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmap.operators.encoder import Encoder, checked_vectors, rows_of
from driftmap.operators.scale import cut, global_rank, scratch_path

_CHUNK = 1024
#: Least rows of one link of a chain, about, and most links of an epoch.
_LINK_ROWS, _LINKS = 1 << 15, 32
#: Multiplications that a task does in a second at least, the time of an exchange through the barrier.
_SECOND = 2_000_000_000
#: Rows of losses that the first task holds before it writes them.
_LOSSES = 4096
#: Most rows whose places can be permuted in whole numbers of 64 bits, and the factors used for it.
_MOST_ROWS, _FACTORS = 1 << 43, 1 << 19
_SCHEMA = (
    "step bigint, n_rows bigint, loss double, chunk int, params array<double>, first array<double>, "
    "second array<double>, settings string"
)


def _ranked(vectors: DataFrame) -> DataFrame:
    """``v, rank``: places in the order of hashes; equal vectors are in any order, which changes nothing."""
    marked = vectors.select("v", F.xxhash64("v").alias("h"), F.monotonically_increasing_id().alias("tie"))
    return cut(global_rank(marked, ["h", "tie"], "rank").select("v", "rank"))


def _permutation(rows: int, seed: int) -> tuple[int, int]:
    """Factor and shift that permute the numbers below ``rows``."""
    rng = np.random.default_rng(seed)
    factor = int(rng.integers(1, _FACTORS))
    while math.gcd(factor, rows) != 1:
        factor += 1
    return factor, int(rng.integers(0, rows))


def _place(rank: Column, rows: int, seed: int) -> Column:
    factor, shift = _permutation(rows, seed)
    return F.pmod(rank * F.lit(factor) + F.lit(shift), F.lit(rows))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray]]:
    """``step, share, rows`` of every share, from batches sorted by both."""
    key, held = None, []
    for batch in batches:
        x = rows_of(batch)
        step, share = batch.column(1).to_numpy(), batch.column(2).to_numpy()
        edges = np.flatnonzero((np.diff(step) != 0) | (np.diff(share) != 0)) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(x)]):
            if a == b:
                continue
            if (step[a], share[a]) != key:
                if held:
                    yield (*key, np.concatenate(held))
                key, held = (int(step[a]), int(share[a])), []
            held.append(x[a:b])
    if held:
        yield (*key, np.concatenate(held))


def _added(messages: Sequence[str], size: int) -> np.ndarray:
    """Rows, loss and gradient of the whole batch, shares added in their order whatever task sent them."""
    shares = np.concatenate([np.frombuffer(base64.b64decode(m)).reshape(-1, size + 3) for m in messages])
    return shares[np.argsort(shares[:, 0], kind="stable"), 1:].sum(axis=0)


def _epoch(
    model: Encoder, moments: np.ndarray, done: int, steps: range, lr: float, decay: float, settings: str, alone: bool
):
    """A function that takes ``steps`` of an epoch together with the other tasks of its stage, or ``alone``; ``done`` were taken
    in epochs before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = None if alone else BarrierTaskContext.get()
        leads = alone or context.partitionId() == 0
        flat, (first, second) = model.flat(), moments.copy()
        groups = _groups(batches)
        ahead = next(groups, None)
        losses: list[tuple[int, int, float]] = []
        none = pa.nulls

        def curve() -> pa.RecordBatch:
            n = len(losses)
            step, rows, loss = zip(*losses)
            doubles = pa.list_(pa.float64())
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(step, pa.int64()),
                    pa.array(rows, pa.int64()),
                    pa.array(loss, pa.float64()),
                    none(n, pa.int32()),
                    *[none(n, doubles) for _ in range(3)],
                    none(n, pa.string()),
                ],
                names=["step", "n_rows", "loss", "chunk", "params", "first", "second", "settings"],
            )

        for step in steps:
            at = model.with_flat(flat)
            shares = []
            while ahead is not None and ahead[0] == step:
                _, share, x = ahead
                loss, grad = at.gradients(x)
                shares.append(np.concatenate([[share, len(x), loss * len(x)], grad * len(x)]))
                ahead = next(groups, None)
            sent = base64.b64encode(np.concatenate(shares).tobytes() if shares else b"").decode()
            total = _added([sent] if alone else context.allGather(sent), len(flat))
            rows, loss, grad = total[0], total[1] / total[0], total[2:] / total[0] + decay * flat
            turn = done + step + 1
            first = 0.9 * first + 0.1 * grad
            second = 0.999 * second + 0.001 * grad * grad
            flat = flat - lr * (first / (1 - 0.9**turn)) / (np.sqrt(second / (1 - 0.999**turn)) + 1e-8)
            if leads:
                losses.append((step + 1, int(rows), float(loss)))
                if len(losses) == _LOSSES:
                    yield curve()
                    losses.clear()
        if leads:
            if losses:
                yield curve()
            parts = [[a[at : at + _CHUNK] for at in range(0, len(flat), _CHUNK)] for a in (flat, first, second)]
            n = len(parts[0])
            yield pa.RecordBatch.from_arrays(
                [
                    none(n, pa.int64()),
                    none(n, pa.int64()),
                    none(n, pa.float64()),
                    pa.array(range(n), pa.int32()),
                    *[pa.array(p, pa.list_(pa.float64())) for p in parts],
                    pa.array([settings] * n, pa.string()),
                ],
                names=["step", "n_rows", "loss", "chunk", "params", "first", "second", "settings"],
            )

    return run


def _model(stored: DataFrame) -> list:
    """The rows of one model and its moments: their number is fixed by its layers."""
    return stored.filter("chunk IS NOT NULL").orderBy("chunk").collect()


def _unpacked(model: Encoder, parts: list) -> tuple[Encoder, np.ndarray]:
    moments = np.stack([np.concatenate([p[name] for p in parts]) for name in ("first", "second")])
    return model.with_flat(np.concatenate([p["params"] for p in parts])), moments


def _chain(
    dealt: DataFrame, model: Encoder, moments: np.ndarray, done: int, steps: int, each: int, lr: float, decay: float, settings: str
) -> DataFrame:
    """One epoch as tasks that follow one another, each with ``each`` steps: the losses of all and the last one's model."""
    spark = dealt.sparkSession
    links = -(-steps // each)
    path, taken_path = scratch_path(spark, "links"), scratch_path(spark, "taken")
    # A folder for each link, with its rows in one file.
    numbered = dealt.withColumn("link", F.floor(F.col("step") / F.lit(each)).cast("int")).repartitionById(links, "link")
    numbered.write.partitionBy("link").parquet(path)
    kinds, folders = dealt.schema, []
    for link in range(links):
        taken = range(link * each, min(steps, (link + 1) * each))
        rows = spark.read.schema(kinds).parquet(f"{path}/link={link}").coalesce(1)
        rows = rows.sortWithinPartitions("step", "share", "place").select("v", "step", "share")
        folders.append(f"{taken_path}/{link}")
        rows.mapInArrow(_epoch(model, moments, done, taken, lr, decay, settings, True), _SCHEMA).write.parquet(folders[-1])
        last = spark.read.schema(_SCHEMA).parquet(folders[-1]).filter("chunk IS NOT NULL")
        if taken.stop < steps:
            model, moments = _unpacked(model, _model(last))
    return spark.read.schema(_SCHEMA).parquet(*folders).filter("step IS NOT NULL").unionByName(last)


def _complete(spark: SparkSession, path: str) -> bool:
    mark = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def autoencoder_fit_synchronous(
    df: DataFrame,
    layers: Sequence[int],
    hidden: str = "relu",
    bottleneck: str = "relu",
    output: str = "relu",
    lr: float = 1e-3,
    weight_decay: float = 0.0,
    batch: int = 80,
    epochs: int = 20,
    seed: int = 1,
    col: str = "embedding",
    share_rows: int = 80,
    workers: int | None = None,
    path: str | None = None,
) -> tuple[Encoder, DataFrame]:
    """Fit an autoencoder with joint batches; returns the model and its loss curve ``epoch, step, n_rows, loss``.

    ``loss`` is the mean squared error of a batch before its step. ``batch`` rows make a step, cut into shares of about
    ``share_rows``; there are at most as many tasks as shares, and at most ``workers``, which must all run at once. Each step
    sends one gradient a share, of the size set by ``layers``, through the barrier, which Spark polls once a second: a step
    of several tasks takes a second at least. Without ``workers`` there are as many tasks as the cluster has slots if a batch
    is work for more than a second, else one at a time, with a small part of the rows each and no barrier. The result is the
    same either way. Barrier stages need a fixed number of executors.

    ``path`` names a folder for the epochs' tables; a fit with the same settings and as many rows goes on after the epochs
    found there, one with others is an error. Rows without a vector are left out; a vector of another width than
    ``layers[0]``, or with a missing element, is an error; without rows the model is the start and the curve is empty.
    """
    spark = df.sparkSession
    vectors, rows = checked_vectors(df, col, layers[0])
    if rows >= _MOST_ROWS:
        raise ValueError(f"{rows} rows are more than {_MOST_ROWS}")
    model = Encoder.start(layers, hidden, bottleneck, output, seed)
    moments = np.zeros((2, len(model.flat())))
    curve = spark.createDataFrame([], "epoch int, step bigint, n_rows bigint, loss double")
    if not rows:
        return model, curve
    steps = -(-rows // batch)
    shares = max(1, -(-batch // share_rows))
    # Forward, and twice as much backward.
    work = 3 * batch * sum(w.size for w in model.weights)
    tasks = max(1, min(shares, workers or (spark.sparkContext.defaultParallelism if work > _SECOND else 1)))
    settings = repr((tuple(layers), hidden, bottleneck, output, lr, weight_decay, batch, seed, share_rows, rows))
    root = (path or scratch_path(spark, "training")).rstrip("/")
    ranked = None
    for epoch in range(epochs):
        target = f"{root}/epoch-{epoch + 1:06d}"
        if not _complete(spark, target):
            ranked = _ranked(vectors) if ranked is None else ranked
            place = _place(F.col("rank"), rows, seed + epoch)
            dealt = (
                ranked.select("v", place.alias("place"))
                .select(
                    "v",
                    F.pmod("place", F.lit(steps)).alias("step"),
                    F.pmod(F.floor(F.col("place") / F.lit(steps)), F.lit(shares)).cast("int").alias("share"),
                    "place",
                )
            )
            if tasks == 1:
                each = max(1, max(_LINK_ROWS, -(-rows // _LINKS)) // batch)
                trained = _chain(dealt, model, moments, epoch * steps, steps, each, lr, weight_decay, settings)
            else:
                shared = dealt.repartitionById(tasks, F.pmod("share", F.lit(tasks)))
                shared = shared.sortWithinPartitions("step", "share", "place").select("v", "step", "share")
                run = _epoch(model, moments, epoch * steps, range(steps), lr, weight_decay, settings, alone=False)
                trained = shared.mapInArrow(run, _SCHEMA, barrier=True)
            trained.write.mode("overwrite").parquet(target)
        stored = spark.read.schema(_SCHEMA).parquet(target)
        parts = _model(stored)
        if parts[0]["settings"] != settings:
            raise ValueError(f"{target} was trained with other settings: {parts[0]['settings']}")
        model, moments = _unpacked(model, parts)
    if epochs:
        number = F.regexp_extract(F.col("_metadata.file_path"), "/epoch-([0-9]+)/[^/]*$", 1).cast("int")
        folders = [f"{root}/epoch-{epoch + 1:06d}" for epoch in range(epochs)]
        curve = (
            spark.read.schema(_SCHEMA)
            .parquet(*folders)
            .filter("step IS NOT NULL")
            .select(number.alias("epoch"), "step", "n_rows", "loss")
        )
    return model, curve
