"""Autoencoder trained in parallel on shards of the rows, by averaging models after every epoch."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmap.functions.vectors import squared_distance

_CHUNK = 1024
#: Rows that one task trains on at most, about, and the least number of tasks.
_SHARD_ROWS, _LEAST_SHARDS = 250_000, 16


def _activate(kind: str, z: np.ndarray) -> np.ndarray:
    if kind == "relu":
        return np.maximum(z, 0.0)
    if kind == "sigmoid":
        return 1.0 / (1.0 + np.exp(-np.clip(z, -60.0, 60.0)))
    return z


def _slope(kind: str, a: np.ndarray) -> np.ndarray | float:
    """Derivative of an activation, from its output."""
    if kind == "relu":
        return (a > 0).astype(a.dtype)
    if kind == "sigmoid":
        return a * (1.0 - a)
    return 1.0


@dataclass
class Encoder:
    """Layers from the input to the narrowest and back, with their activations."""

    weights: list[np.ndarray]
    biases: list[np.ndarray]
    hidden: str = "relu"
    bottleneck: str = "relu"
    output: str = "relu"

    @classmethod
    def start(cls, layers: Sequence[int], hidden: str, bottleneck: str, output: str, seed: int) -> Encoder:
        rng = np.random.default_rng(seed)
        widths = [*layers, *list(layers)[-2::-1]]
        weights, biases = [], []
        for fan_in, fan_out in zip(widths, widths[1:]):
            bound = 1.0 / np.sqrt(fan_in)
            weights.append(rng.uniform(-bound, bound, (fan_in, fan_out)))
            biases.append(rng.uniform(-bound, bound, fan_out))
        return cls(weights, biases, hidden, bottleneck, output)

    @classmethod
    def from_rows(cls, rows: Sequence) -> Encoder:
        arrays = {(r["name"], r["layer"]): np.array(r["data"]).reshape(r["shape"]) for r in rows}
        n = 1 + max(r["layer"] for r in rows)
        first = rows[0]
        return cls(
            [arrays["weight", i] for i in range(n)],
            [arrays["bias", i] for i in range(n)],
            first["hidden"],
            first["bottleneck"],
            first["output"],
        )

    def kind(self, layer: int) -> str:
        if layer == len(self.weights) - 1:
            return self.output
        return self.bottleneck if layer == len(self.weights) // 2 - 1 else self.hidden

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in (*self.weights, *self.biases)])

    def with_flat(self, values: np.ndarray) -> Encoder:
        """The same layers with other parameters."""
        arrays, at = [], 0
        for a in (*self.weights, *self.biases):
            arrays.append(values[at : at + a.size].reshape(a.shape).copy())
            at += a.size
        n = len(self.weights)
        return Encoder(arrays[:n], arrays[n:], self.hidden, self.bottleneck, self.output)

    def forward(self, x: np.ndarray, layers: int | None = None) -> list[np.ndarray]:
        """Input and the output of each layer."""
        outputs = [x]
        for i in range(len(self.weights) if layers is None else layers):
            outputs.append(_activate(self.kind(i), outputs[-1] @ self.weights[i] + self.biases[i]))
        return outputs

    def encode(self, x: np.ndarray) -> np.ndarray:
        return self.forward(x, len(self.weights) // 2)[-1]

    def reconstruct(self, x: np.ndarray) -> np.ndarray:
        return self.forward(x)[-1]

    def gradients(self, x: np.ndarray) -> tuple[float, np.ndarray]:
        """Mean squared error of a batch, and its gradient in the order of :meth:`flat`."""
        outputs = self.forward(x)
        error = outputs[-1] - x
        back = 2.0 * error / error.size
        weight_grads, bias_grads = [], []
        for i in reversed(range(len(self.weights))):
            back = back * _slope(self.kind(i), outputs[i + 1])
            weight_grads.append((outputs[i].T @ back).ravel())
            bias_grads.append(back.sum(axis=0))
            back = back @ self.weights[i].T
        return float((error * error).mean()), np.concatenate([*weight_grads[::-1], *bias_grads[::-1]])


def rows_of(batch: pa.RecordBatch) -> np.ndarray:
    vectors = batch.column(0)
    return vectors.flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(len(vectors), -1)


def checked_vectors(df: DataFrame, col: str, width: int) -> tuple[DataFrame, int]:
    """The vectors as ``v``, and their number; one of another width, or with a missing element, is an error."""
    vector = F.col(col)
    broken = vector.isNotNull() & ((F.size(vector) != width) | F.exists(vector, lambda x: x.isNull() | F.isnan(x)))
    wrong, rows = df.agg(F.count_if(broken), F.count(vector)).first()
    if wrong:
        raise ValueError(f"{wrong} vectors are not of width {width} or have missing elements")
    return df.filter(vector.isNotNull()).select(vector.cast("array<float>").alias("v")), rows


def _train_partition(model: Encoder, lr: float, decay: float, batch: int, seed: int):
    """A function that passes once over a partition with Adam and returns its model in chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = model.flat()
        first, second = np.zeros_like(flat), np.zeros_like(flat)
        rng = np.random.default_rng(seed)
        steps, rows, loss_sum = 0, 0, 0.0
        for arrow in batches:
            x = rows_of(arrow)
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                part = x[order[at : at + batch]]
                loss, grad = model.with_flat(flat).gradients(part)
                grad = grad + decay * flat
                steps += 1
                first = 0.9 * first + 0.1 * grad
                second = 0.999 * second + 0.001 * grad * grad
                flat = flat - lr * (first / (1 - 0.9**steps)) / (np.sqrt(second / (1 - 0.999**steps)) + 1e-8)
                rows += len(part)
                loss_sum += loss * len(part)
        if rows:
            chunks = [flat[at : at + _CHUNK] for at in range(0, len(flat), _CHUNK)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(len(chunks)), pa.int32()),
                    pa.array(chunks, pa.list_(pa.float64())),
                    pa.array([rows] * len(chunks), pa.int64()),
                    pa.array([loss_sum] * len(chunks), pa.float64()),
                ],
                names=["chunk", "params", "n", "loss"],
            )

    return run


def autoencoder_fit(
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
    shards: int | None = None,
) -> tuple[Encoder, DataFrame]:
    """Fit an autoencoder; returns the model and its loss curve ``epoch, mean_loss``.

    ``layers`` lists the widths from the input to the narrowest layer. Rows are dealt by the hash of their vector into
    at most ``shards`` parts (by default their number follows from that of the rows), and sorted by it, so that the result
    does not depend on the cluster. In every epoch each
    part trains a copy on its rows in small batches, with the optimizer's moments starting anew; the copies are averaged,
    weighted by rows, in distributed chunks, so that no task or driver ever holds more than one model and a few chunks.
    The mean loss is that seen while training. Rows without a vector are left out; a vector of another width than
    ``layers[0]``, or with a missing element, is an error.
    """
    spark = df.sparkSession
    model = Encoder.start(layers, hidden, bottleneck, output, seed)
    vectors, rows = checked_vectors(df, col, layers[0])
    shards = shards or max(_LEAST_SHARDS, -(-rows // _SHARD_ROWS))
    vectors = vectors.repartition(shards, F.pmod(F.xxhash64("v"), F.lit(4 * shards)))
    vectors = vectors.sortWithinPartitions(F.xxhash64("v")).persist(StorageLevel.MEMORY_AND_DISK)
    losses = []
    try:
        for epoch in range(epochs):
            trained = vectors.mapInArrow(
                _train_partition(model, lr, weight_decay, batch, seed + epoch),
                "chunk int, params array<double>, n bigint, loss double",
            )
            averaged = trained.groupBy("chunk").agg(
                vector_to_array(
                    Summarizer.mean(array_to_vector(F.col("params")), F.col("n").cast("double"))
                ).alias("params"),
                (F.sum("loss") / F.sum("n")).alias("loss"),
            )
            # The rows of one model: its number of parameters is fixed by ``layers``.
            parts = sorted(averaged.collect(), key=lambda r: r["chunk"])
            if not parts:
                break
            model = model.with_flat(np.concatenate([np.array(r["params"]) for r in parts]))
            losses.append((epoch + 1, float(parts[0]["loss"])))
    finally:
        vectors.unpersist()
    return model, spark.createDataFrame(losses, "epoch int, mean_loss double")


def _apply(df: DataFrame, model: Encoder, col: str, out: str, method: str) -> DataFrame:
    # The function carries one model, of the size set by its layers.
    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        call = getattr(model, method)
        for vectors in parts:
            result = pd.Series([None] * len(vectors), dtype=object)
            known = vectors.notna().to_numpy()
            if known.any():
                made = call(np.stack(vectors[known].to_numpy()).astype("f8")).astype("f4")
                result[known] = pd.Series(list(made), index=result.index[known])
            yield result

    return df.withColumn(out, run(F.col(col)))


def autoencode(df: DataFrame, model: Encoder, col: str = "embedding", out: str = "encoded") -> DataFrame:
    """Add the narrow representation of each vector."""
    return _apply(df, model, col, out, "encode")


def reconstruct(df: DataFrame, model: Encoder, col: str = "embedding", out: str = "reconstructed") -> DataFrame:
    """Add each vector as the model restores it."""
    return _apply(df, model, col, out, "reconstruct")


def reconstruction_error(df: DataFrame, a: str, b: str) -> DataFrame:
    """Mean over rows of the mean squared difference of two vector columns."""
    per_row = squared_distance(a, b) / F.nullif(F.size(a), F.lit(0))
    return df.agg(F.count(per_row).alias("n_rows"), F.avg(per_row).alias("mse"))
