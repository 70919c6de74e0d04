"""PCA whitening of embeddings by merged moments.

Each partition reduces its vectors to a count, a local mean and a centred scatter; two such summaries merge by Chan's
formula, which adds the scatter between the two means, so that no large sums cancel. treeReduce merges them in a few
rounds of tasks: a summary has the size of a covariance however many vectors it stands for, and the driver gets one. It
finds the eigenvectors there. A second pass summarises the whitened vectors in the same way and says how far their
covariance is from the identity.

Vectors are rated in whole steps of 1/64, as SCALE says, so sums and deviations are exact integers.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

#: Steps a unit of an entry, and what is added so that they count from above zero.
SCALE, OFFSET = 64, 1_000_000
#: Entries from here on have no long number of steps; their vectors count as not finite.
LARGEST = 2.0**56
#: Cells of vectors or of results that a task handles at once.
CELLS = 2_000_000
#: Eigenvalues under this share of the largest, times the dimensions, are rounding: no variance, so nothing to whiten.
ROUNDING = 4 * np.finfo(float).eps

#: Of vectors of one length: their count, exact sums, mean and centred scatter.
Moments = tuple[int, list[int], np.ndarray, np.ndarray]


@dataclass(frozen=True)
class Whitening:
    """What fit() learned: ``n`` vectors with sums ``total`` of steps; eigenvectors in columns, by falling eigenvalue."""

    n: int
    total: tuple[int, ...]
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def scaled(self) -> np.ndarray:
        """Eigenvectors over the square roots of their eigenvalues; NaN where there is no variance."""
        return self.vectors / np.sqrt(np.where(self.values > 0, self.values, np.nan))


def _steps(batch: pa.RecordBatch, length: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and steps (without OFFSET) of the usable vectors of ``batch``, by length, in parts of about CELLS."""
    lists = batch.column(batch.num_columns - 1)
    sizes = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    for d in np.unique(sizes[sizes > 0]) if length is None else [length]:
        rows = np.flatnonzero(sizes == d)
        each = max(1, CELLS // int(d))
        for at in range(0, len(rows), each):
            part = rows[at : at + each]
            cells = pc.cast(lists.take(pa.array(part)).flatten(), pa.float64()).to_numpy(zero_copy_only=False).reshape(len(part), int(d))
            fine = (np.abs(cells) < LARGEST).all(axis=1)
            if fine.any():
                yield part[fine], np.floor(SCALE * cells[fine]).astype(np.int64)


def _summed(x: np.ndarray) -> list[int]:
    """Exact sums of columns of whole numbers."""
    narrow = x.dtype == np.int64 and int(np.abs(x).max(initial=0)) < 2**62 // max(len(x), 1)
    return [int(v) for v in (x if narrow else x.astype(object)).sum(axis=0)]


def _moments(x: np.ndarray) -> Moments:
    total = _summed(x) if x.dtype == np.int64 else []
    mean = np.array([v / len(x) for v in total]) if total else x.mean(axis=0)
    centred = x - mean
    return len(x), total, mean, centred.T @ centred


def merged(a: Moments, b: Moments) -> Moments:
    """Chan's formula: both scatters and that of the two means."""
    n, apart = a[0] + b[0], b[2] - a[2]
    return n, [p + q for p, q in zip(a[1], b[1], strict=True)], a[2] + apart * (b[0] / n), a[3] + b[3] + np.outer(apart, apart) * (a[0] / n * b[0])


def _merge_all(a: dict[int, Moments], b: dict[int, Moments]) -> dict[int, Moments]:
    return {d: merged(a[d], b[d]) if d in a and d in b else a.get(d) or b[d] for d in {*a, *b}}


def _reduced(rows: DataFrame, summarise) -> dict[int, Moments]:
    """Each partition's summary, merged pairwise in a tree of tasks."""

    def work(batches):
        out: dict[int, Moments] = {}
        for batch in batches:
            for x in summarise(batch):
                out = _merge_all(out, {x.shape[1]: _moments(x)})
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(out)], pa.binary())], ["moments"])

    parts = rows.mapInArrow(work, "moments binary").rdd
    if not parts.getNumPartitions():
        return {}
    return parts.map(lambda r: pickle.loads(r[0])).treeReduce(_merge_all, depth=max(2, int(np.log2(parts.getNumPartitions()) / 3)))


def fit(df: DataFrame, vector_col: str = "embedding") -> Whitening | None:
    """Moments and eigenvectors of all usable vectors; None if there are none.

    Unusable: null, empty, with an entry that is null, not finite or of 2**56 or more; and vectors of another length than
    the most common one (the longer one of two as common).
    """
    sums = _reduced(df.select(vector_col), lambda batch: (x for _, x in _steps(batch)))
    if not sums:
        return None
    n, total, _, scatter = sums[max(sums, key=lambda d: (sums[d][0], d))]
    values, vectors = np.linalg.eigh(scatter / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    values = np.where(values > ROUNDING * len(total) * max(values[0], 0.0), values, 0.0)
    top = np.abs(vectors).argmax(axis=0)
    return Whitening(n, tuple(total), vectors * np.where(np.take_along_axis(vectors, top[None], axis=0)[0] < 0, -1.0, 1.0), values, float(np.trace(scatter / n)))


def _whitened(x: np.ndarray, model: Whitening, axes: np.ndarray) -> np.ndarray:
    return (x - np.array([t / model.n for t in model.total])) @ axes


def identity_error(df: DataFrame, model: Whitening, vector_col: str = "embedding", components: int = 32) -> float | None:
    """A pass over all vectors: the largest entry of |covariance of the whitened vectors - identity|.

    Components without variance are left out; None if none has any.
    """
    axes = model.scaled[:, :components]
    axes = axes[:, ~np.isnan(axes).any(axis=0)]
    if not axes.shape[1]:
        return None
    length = len(model.total)
    n, _, _, scatter = _reduced(df.select(vector_col), lambda batch: (_whitened(x, model, axes) for _, x in _steps(batch, length)))[axes.shape[1]]
    return float(np.abs(scatter / n - np.eye(axes.shape[1])).max())


def _deviations(x: np.ndarray, model: Whitening) -> pa.Array:
    """Sums over dimensions of (n x - total)**2, exact; null where a long can't hold one.

    Modulo 2**64 the sum is exact whatever overflows on the way; a sum in doubles tells whether it fits.
    """
    wrapped = np.array([t % 2**64 for t in model.total], dtype=np.uint64)
    away = x.astype(np.uint64) * np.uint64(model.n % 2**64) - wrapped
    out = (away * away).sum(axis=1, dtype=np.uint64)
    about = ((x.astype(float) * model.n - np.array([float(t) for t in model.total])) ** 2).sum(axis=1)
    near = np.abs(about / 2.0**63 - 1) < 1e-3
    fits = about < 2.0**63
    for i in np.flatnonzero(near):
        fits[i] = sum((model.n * int(v) - t) ** 2 for v, t in zip(x[i], model.total, strict=True)) < 2**63
    return pa.array(np.where(fits, out, 0).astype(np.int64), mask=~fits)


def whiten(df: DataFrame, model: Whitening | None, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 32) -> DataFrame:
    """``id_col``, deviation long and whitened array<double> of each usable vector of ``df``, see fit().

    whitened: steps less their mean, projected on each component, over the root of its eigenvalue; null entries for
    components without variance. deviation: sum over dimensions of (n x - total)**2; null beyond a long. Null and repeated
    ids are rows like others; other columns are not read.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    schema = T.StructType([T.StructField(id_col, rows.schema["id"].dataType), T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    if model is None:
        return df.sparkSession.createDataFrame([], schema)
    axes, length = model.scaled[:, :components], len(model.total)

    def work(batches):
        for batch in batches:
            for at, x in _steps(batch, length):
                out = _whitened(x, model, axes)
                cells = pa.array(out.ravel(), mask=np.isnan(out.ravel()))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * axes.shape[1]), cells)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), _deviations(x, model), lists], [id_col, "deviation", "whitened"])

    return rows.mapInArrow(work, schema)


def components_of(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 32) -> DataFrame:
    """fit(), identity_error() and whiten() of one table, a row for each vector and component.

    Columns: id_col, component int (from 1), n long, deviation long, whitened double, explained double (share of all
    variance; null if there is none), identity_error double.
    """
    model = fit(df, vector_col)
    error = identity_error(df, model, vector_col, components) if model else None
    shares = [v / model.trace if model.trace > 0 else None for v in model.values[:components].tolist()] if model else []
    rows = whiten(df, model, id_col, vector_col, components)
    rows = rows.select(F.col(id_col).alias("id"), "deviation", F.posexplode("whitened").alias("nth", "white"))
    return rows.select(
        F.col("id").alias(id_col),
        (F.col("nth") + 1).cast("int").alias("component"),
        F.lit(model.n if model else 0).cast("long").alias("n"),
        "deviation",
        F.col("white").alias("whitened"),
        F.lit(shares).cast("array<double>")[F.col("nth")].alias("explained") if shares else F.lit(None).cast("double").alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
