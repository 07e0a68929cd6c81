"""Feature arrays: pooling, augmentation and linear heads."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


def _add(a: Column, b: Column) -> Column:
    return a + b


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), _add)


def mean_pool(frames: Column, width: int) -> Column:
    """Mean over the frames of an array of frames, for each of width channels."""
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda c: total(F.transform(frames, lambda f: F.get(f, c).cast("double"))) / F.size(frames))


def motion(frames: Column) -> Column:
    """Mean absolute difference of neighbouring frames (0 of a single one)."""
    flat = F.zip_with(F.slice(frames, F.lit(1), F.size(frames) - 1), F.slice(frames, F.lit(2), F.size(frames) - 1), lambda a, b: total(F.zip_with(a, b, lambda x, y: F.abs(y.cast("double") - x.cast("double")))) / F.size(a))
    return F.when(F.size(frames) > 1, total(flat) / F.size(flat)).otherwise(0.0)


def spread(values: Column) -> Column:
    """Standard deviation (of all values, not of a sample) of an array."""
    n = F.size(values)
    mean = total(values) / n
    return F.sqrt(total(F.transform(values, lambda x: F.pow(x - mean, F.lit(2.0)))) / n)


def normalize_frames(frames: Column, size: int, crop: int, mean: float = 0.421, std: float = 0.165) -> Column:
    """The middle crop x crop values of size x size frames of bytes, scaled."""
    at = (size - crop) // 2 + 1
    return F.transform(F.slice(frames, at, crop), lambda row: F.transform(F.slice(row, at, crop), lambda x: (x.cast("double") / 255 - mean) / std))


def hflip(frames: Column) -> Column:
    return F.transform(frames, F.reverse)


def _uniform(seed: int, salt: str, key: Column) -> Column:
    """Eight hex digits of a hash as a number from 0 to below 1."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(f"{seed}{salt}"), key.cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)


def temporal_mask(frames: Column, key: Column, p: float, width: int, seed: int, variable: bool = False) -> Column:
    """With probability p a block of width frames is set to 0; with variable, of a length from 0 to width, all equally likely."""
    long = F.least(F.floor(_uniform(seed, "long", key) * (width + 1)) if variable else F.lit(width), F.size(frames))
    start = F.floor(_uniform(seed, "at", key) * F.greatest(F.lit(1), F.size(frames) - long + 1))
    masked = F.transform(frames, lambda f, i: F.when((i >= start) & (i < start + long), F.transform(f, lambda x: x * 0)).otherwise(f))
    return F.when(_uniform(seed, "mask", key) < p, masked).otherwise(frames)


def feature_scale(rows: DataFrame, values: str) -> DataFrame:
    """One row: the sample standard deviation of all values; a row is first reduced to its count, sum and sum of squares."""
    v = F.transform(F.col(values), lambda x: x.cast("double"))
    parts = rows.select(F.size(v).alias("n"), total(v).alias("s"), total(F.transform(v, lambda x: x * x)).alias("q")).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    return parts.select(F.sqrt((F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1)).alias("scale"))


def feature_noise(rows: DataFrame, key: str, values: str, frac: float, drop: float, seed: int, scale: float | None = None) -> DataFrame:
    """Normal noise of a standard deviation of frac times scale (by default that of all values, feature_scale) added to the values, of which a share is dropped and the rest enlarged.

    A value's numbers follow from seed, key and place: the digits of one hash give two uniform numbers, and these a normal one, and a
    third uniform number that decides on dropping. All of it are expressions on the row.
    """
    if scale is None:
        rows, scale_of, gone = rows.crossJoin(F.broadcast(feature_scale(rows, values).select(F.col("scale").alias("_scale")))), F.coalesce("_scale", F.lit(0.0)), ["_scale"]
    else:
        scale_of, gone = F.lit(float(scale)), []
    unit = lambda h, k: (F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)
    hashed = F.transform(F.col(values), lambda x, i: F.struct(x.cast("double").alias("x"), F.md5(F.concat_ws("|", F.lit(f"{seed}noise"), F.col(key).cast("string"), i.cast("string"))).alias("h")))
    normal = lambda h: F.sqrt(-2 * F.log(unit(h, 0))) * F.cos(2 * math.pi * unit(h, 1))
    return rows.withColumn(values, F.transform(hashed, lambda v: F.when(unit(v["h"], 2) >= drop, (v["x"] + frac * scale_of * normal(v["h"])) / (1 - drop)).otherwise(0.0))).drop(*gone)


def max_abs_diff(a: DataFrame, b: DataFrame, key: str, values: str) -> DataFrame:
    """One row: the largest difference of two caches' values, joined by key, and the rows that only one of them has."""
    rows = a.select(key, F.col(values).alias("x")).join(b.select(key, F.col(values).alias("y")), key, "full_outer")
    far = F.array_max(F.zip_with("x", "y", lambda x, y: F.abs(x.cast("double") - y.cast("double"))))
    return rows.agg(F.max(far).alias("max_abs_diff"), F.count_if(F.col("x").isNull() | F.col("y").isNull()).alias("unmatched"))


def linear_scores(rows: DataFrame, values: str, weights: list[list[float]], bias: list[float]) -> DataFrame:
    """rows with logits = weights . values + bias and pred_idx, their first largest. Weights are literals of an expression, so rows stay in the JVM."""
    row = lambda w: F.array(*(F.lit(float(x)) for x in w))
    logits = F.array(*(total(F.zip_with(F.col(values), row(w), lambda x, y: x.cast("double") * y)) + float(b) for w, b in zip(weights, bias)))
    return rows.withColumn("logits", logits).withColumn("pred_idx", (F.array_position("logits", F.array_max("logits")) - 1).cast("int"))


def _fold_sums(speakers: dict, classes: int, columns: list[int], make):
    """For mapInArrow: sums of make(x with a leading 1, labels, number of the row's speaker) over a task's rows, as (cell, value)."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x, y, s = (batch.column(k) for k in columns)
                x = x.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                own = make(np.hstack([np.ones((len(x), 1)), x]), y.to_numpy(zero_copy_only=False).astype(int), np.array([speakers[v] for v in s.to_pylist()]))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["cell", "value"])

    return sums


def _collected(rows: DataFrame, sums, cells: int) -> np.ndarray:
    out = np.zeros(cells)
    for cell, value in rows.mapInArrow(sums, "cell long, value double").groupBy("cell").agg(F.sum("value")).collect():
        out[cell] = value
    return out


class _Descent:
    """One fold's limited-memory quasi-Newton steps on a smooth convex function whose curvature is bounded by a fixed matrix; each step asks for one value and gradient."""

    def __init__(self, inverse: np.ndarray, shape: tuple[int, int], tolerance: float, memory: int = 12):
        self.inverse, self.tolerance, self.memory = inverse, tolerance, memory
        self.at, self.value, self.slope = np.zeros(shape), None, None
        self.trial, self.pairs, self.size, self.done = self.at, [], 1.0, False

    def direction(self) -> np.ndarray:
        d, seen = self.slope.copy(), []
        for step, turn in reversed(self.pairs):
            a = (step * d).sum() / (step * turn).sum()
            d -= a * turn
            seen.append(a)
        d = d @ self.inverse
        for (step, turn), a in zip(self.pairs, reversed(seen)):
            d += (a - (turn * d).sum() / (step * turn).sum()) * step
        return -d

    def told(self, value: float, slope: np.ndarray) -> None:
        """Takes the value and gradient at trial, and sets the next trial."""
        if self.done:
            return
        if self.value is not None and value > self.value + 1e-4 * (self.slope * (self.trial - self.at)).sum() and self.size > 1e-6:
            self.size /= 2  # not lower enough: nearer
        else:
            if self.value is not None:
                step, turn = self.trial - self.at, slope - self.slope
                if (step * turn).sum() > 1e-12:
                    self.pairs = [*self.pairs, (step, turn)][-self.memory :]
            self.at, self.value, self.slope, self.size = self.trial, value, slope, 1.0
            self.done = np.abs(slope).max() <= self.tolerance
        self.trial = self.at + self.size * self.direction() if not self.done else self.at


def probe_heads(rows: DataFrame, values: str, label: str, speaker: str, max_iter: int = 40, penalty: float = 0.01, tolerance: float = 1e-5) -> dict:
    """By speaker the multinomial linear head (classes x [bias, weights]) fitted on all other speakers' rows; None where there are none.

    A head minimizes the mean cross entropy plus half the penalty times its squared weights, for features divided by their deviations
    among the rows that it is fitted on. Counts, sums and products of features are added up by speaker once; a fold's are the total
    less its speaker's, and bound the curvature. Then each pass over the rows gives the value and gradient of every fold at its own
    head, in one aggregate; the number of passes does not depend on the number of speakers. The driver holds the heads and the products, whose
    size follows from speakers, classes and features, not from rows.
    """
    data = rows.where(F.col(values).isNotNull() & F.col(label).isNotNull()).select(F.transform(F.col(values), lambda x: x.cast("double")).alias("x"), F.col(label).cast("int").alias("y"), F.col(speaker).cast("string").alias("s"))
    known = data.groupBy("s").agg(F.max("y").alias("y"), F.max(F.size("x")).alias("wide"), F.min(F.size("x")).alias("least")).collect()
    if not known:
        return {}
    speakers, classes, wide = {r.s: k for k, r in enumerate(sorted(known, key=lambda r: (r.s is None, r.s)))}, max(r.y for r in known) + 1, max(r.wide for r in known) + 1
    if wide - 1 != min(r.least for r in known):
        raise ValueError("feature arrays differ in length")
    many, columns = len(speakers), [0, 1, 2]

    def products(x, y, s):
        out = np.zeros((many, wide, wide))
        for k in np.unique(s):
            own = x[s == k]
            out[k] += own.T @ own
        return out.ravel()

    own = _collected(data, _fold_sums(speakers, classes, columns, products), many * wide * wide).reshape(many, wide, wide)
    rest = own.sum(0) - own
    n = rest[:, 0, 0]
    mean = rest[:, 0] / np.maximum(n, 1)[:, None]
    spread = np.sqrt(np.maximum(np.einsum("fkk->fk", rest) - n[:, None] * mean**2, 0) / np.maximum(n - 1, 1)[:, None])
    scale = np.where(spread > 1e-12, 1 / np.maximum(spread, 1e-12), 0.0)
    scale[:, 0] = 1.0
    folds = []
    for k in range(many):
        bound = 0.5 * rest[k] * np.outer(scale[k], scale[k]) / max(n[k], 1) + np.diag([1e-9] + [penalty] * (wide - 1))
        folds.append(_Descent(np.linalg.inv(bound), (classes, wide), tolerance) if n[k] else None)

    for _ in range(max_iter):
        if all(f is None or f.done for f in folds):
            break
        heads = np.array([np.zeros((classes, wide)) if f is None else f.trial * scale[k] for k, f in enumerate(folds)])

        def slopes(x, y, s, heads=heads):
            score = np.einsum("nd,fcd->fnc", x, heads)
            score -= score.max(2, keepdims=True)
            mass = np.exp(score)
            total = mass.sum(2, keepdims=True)
            mine = s[None, :] == np.arange(many)[:, None]
            loss = np.where(mine, 0, np.log(total[..., 0]) - score[:, np.arange(len(y)), y]).sum(1)
            far = mass / total
            far[:, np.arange(len(y)), y] -= 1
            far[mine] = 0
            return np.concatenate([loss, np.einsum("fnc,nd->fcd", far, x).ravel()])

        found = _collected(data, _fold_sums(speakers, classes, columns, slopes), many * (1 + classes * wide))
        loss, slope = found[:many], found[many:].reshape(many, classes, wide)
        for k, f in enumerate(folds):
            if f is not None:
                weights = f.trial * ([0.0] + [1.0] * (wide - 1))
                f.told(loss[k] / n[k] + penalty / 2 * (weights**2).sum(), slope[k] * scale[k] / n[k] + penalty * weights)
    return {name: None if folds[k] is None else folds[k].at * scale[k] for name, k in speakers.items()}


def linear_probe(rows: DataFrame, values: str, label: str, speaker: str, max_iter: int = 40) -> DataFrame:
    """Rows with pred_idx of the linear head that was fitted on all other speakers' rows (probe_heads); null for a speaker without others, and for null values."""
    heads = probe_heads(rows, values, label, speaker, max_iter)
    columns = [rows.columns.index(values), rows.columns.index(speaker)]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, pred = [None if v is None else str(v) for v in batch.column(columns[1]).to_pylist()], [None] * batch.num_rows
            for name in set(owner):
                at = [k for k, o in enumerate(owner) if o == name and batch.column(columns[0])[k].is_valid]
                if at and heads.get(name) is not None:
                    x = batch.column(columns[0]).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(at), -1)
                    best = (x @ heads[name][:, 1:].T + heads[name][:, 0]).argmax(1)
                    for k, b in zip(at, best.tolist()):
                        pred[k] = b
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.int32())], names=[*batch.schema.names, "pred_idx"])

    return rows.mapInArrow(scored, StructType([*rows.schema, StructField("pred_idx", IntegerType())]))


def unioned(tables: list[DataFrame]) -> DataFrame:
    """All tables' rows under all their columns."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def augmented_union(tables: dict[str, DataFrame]) -> DataFrame:
    """The tables' rows, each tagged with its condition."""
    return unioned([t.withColumn("condition", F.lit(c)) for c, t in tables.items()])
