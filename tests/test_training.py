"""Synchronous training against the same steps in one place."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import driftmap as dm
from driftmap.operators import training
from driftmap.operators.encoder import Encoder
from driftmap.operators.training import _permutation

SHAPE = dict(bottleneck="linear", output="linear", lr=3e-3, weight_decay=1e-4, batch=30, seed=5)


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6).astype("f4").tolist()) for i in range(100)]
    rows += [(i, rows[0][1]) for i in range(100, 150)] + [(150, None)]  # a third of the rows are alike
    return spark.createDataFrame(rows, "id long, embedding array<float>").cache()


def in_one_place(vectors, epochs):
    """Adam over joint batches; the order of rows is that of their hashes."""
    hashed = vectors.filter("embedding IS NOT NULL").select(F.xxhash64("embedding").alias("h"), "embedding")
    x = np.array([r.embedding for r in sorted(hashed.collect(), key=lambda r: r.h)], "f8")
    model = Encoder.start([6, 4, 2], "relu", "linear", "linear", SHAPE["seed"])
    flat = model.flat()
    first, second, curve, turn = np.zeros_like(flat), np.zeros_like(flat), [], 0
    steps = -(-len(x) // SHAPE["batch"])
    for epoch in range(epochs):
        factor, shift = _permutation(len(x), SHAPE["seed"] + epoch)
        place = (np.arange(len(x)) * factor + shift) % len(x)
        assert sorted(place) == list(range(len(x)))
        for step in range(steps):
            part = x[place % steps == step]
            loss, grad = model.with_flat(flat).gradients(part)
            grad = grad + SHAPE["weight_decay"] * flat
            turn += 1
            first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
            flat = flat - SHAPE["lr"] * first / (1 - 0.9**turn) / (np.sqrt(second / (1 - 0.999**turn)) + 1e-8)
            curve.append((epoch + 1, step + 1, len(part), loss))
    return flat, curve


def test_equals_training_in_one_place(vectors):
    flat, want = in_one_place(vectors, 3)
    model, curve = dm.autoencoder_fit_synchronous(vectors, [6, 4, 2], epochs=3, share_rows=8, **SHAPE)
    got = sorted(map(tuple, curve.collect()))
    assert [r[:3] for r in got] == [r[:3] for r in want] and {r[2] for r in got} == {30}
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want], rel=1e-10)
    assert model.flat() == pytest.approx(flat, rel=1e-9, abs=1e-12)


def test_does_not_depend_on_tasks_or_partitions(vectors):
    one, _ = dm.autoencoder_fit_synchronous(vectors, [6, 4, 2], epochs=1, share_rows=8, workers=1, **SHAPE)
    many, _ = dm.autoencoder_fit_synchronous(
        vectors.repartition(5), [6, 4, 2], epochs=1, share_rows=8, workers=3, **SHAPE
    )
    assert (one.flat() == many.flat()).all()


@pytest.mark.parametrize("link_rows", [60, 1 << 15])
def test_small_batches_pay_no_barrier(vectors, monkeypatch, link_rows):
    monkeypatch.setattr(training, "_LINK_ROWS", link_rows)
    monkeypatch.setattr(training, "BarrierTaskContext", None)
    monkeypatch.setattr(type(vectors), "mapInArrow", no_barrier(type(vectors).mapInArrow))
    model, curve = dm.autoencoder_fit_synchronous(vectors, [6, 4, 2], epochs=2, share_rows=8, **SHAPE)
    flat, want = in_one_place(vectors, 2)
    got = sorted(map(tuple, curve.collect()))
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want], rel=1e-10)
    assert model.flat() == pytest.approx(flat, rel=1e-9, abs=1e-12)


def no_barrier(real):
    def run(df, f, schema, barrier=False, **other):
        assert not barrier
        return real(df, f, schema, barrier, **other)

    return run


def test_goes_on_after_the_last_epoch(vectors, tmp_path):
    path = str(tmp_path / "fit")
    fit = lambda epochs, **other: dm.autoencoder_fit_synchronous(
        vectors, [6, 4, 2], epochs=epochs, path=path, **(SHAPE | other)
    )
    fit(1)
    before = (tmp_path / "fit" / "epoch-000001" / "_SUCCESS").stat().st_mtime_ns
    model, curve = fit(2)
    assert (tmp_path / "fit" / "epoch-000001" / "_SUCCESS").stat().st_mtime_ns == before
    assert curve.count() == 10
    assert model.flat() == pytest.approx(in_one_place(vectors, 2)[0], rel=1e-9, abs=1e-12)
    with pytest.raises(ValueError, match="other settings"):
        fit(2, lr=1e-2)


def test_few_rows_and_wrong_rows(spark, vectors):
    model, curve = dm.autoencoder_fit_synchronous(vectors.filter("id = 150"), [6, 4, 2], **SHAPE)
    assert curve.count() == 0 and (model.flat() == Encoder.start([6, 4, 2], "relu", "linear", "linear", 5).flat()).all()
    assert dm.autoencoder_fit_synchronous(vectors.limit(1), [6, 4, 2], epochs=1, **SHAPE)[1].head().n_rows == 1
    with pytest.raises(ValueError, match="width 5"):
        dm.autoencoder_fit_synchronous(vectors, [5, 4, 2], **SHAPE)
