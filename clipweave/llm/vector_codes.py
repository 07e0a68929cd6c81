"""Product codes of vectors: integer codebooks, nearest entries found by pivots (LAESA)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Parts of a vector, entries of a part's codebook, rounds of refinement, fixed pivots of a part, and what a component is multiplied by.
PARTS, ENTRIES, ROUNDS, PIVOTS, SCALE = 16, 64, 2, 4, 256
#: Relative width that float distances may be wrong by; bounds are loosened by it, so no entry is left out wrongly.
SLACK = 1e-6
MOST_LONG = (1 << 63) - 1


@dataclass
class Codebooks:
    """entries: parts x entries x components of a part, integers; pivots: the fixed places that distances are kept to."""

    entries: np.ndarray
    pivots: np.ndarray

    @property
    def width(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]


def whole(values: np.ndarray) -> np.ndarray:
    """floor(256 x) of rows of components, held inside a range in which a vector's squared distances fit 64 bits."""
    most = isqrt((1 << 62) // max(1, values.shape[1])) // 2
    return np.clip(np.floor(values.astype(np.float64) * SCALE), -most, most).astype(np.int64)


def spread_pivots(entries: np.ndarray, many: int) -> np.ndarray:
    """Of each part's entries so many that lie far apart: the first, then again and again the one farthest from those taken."""
    out = []
    for own in entries:
        taken, far = [0], np.full(len(own), np.inf)
        while len(taken) < many:
            far = np.minimum(far, ((own - own[taken[-1]]).astype(np.float64) ** 2).sum(1))
            taken.append(int(far.argmax()))
        out.append(own[taken])
    return np.array(out)


def pivot_distances(parts: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """rows x pivots: distances of one position's parts to its pivots."""
    return np.sqrt(((parts[:, None, :] - pivots[None]).astype(np.float64) ** 2).sum(2))


def nearest(parts: np.ndarray, known: np.ndarray, entries: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For the parts of one position: the nearest entry (the lower of equals), its squared distance, and how many exact distances were made.

    A part's distance to an entry is at least the difference of their distances to a pivot. Entries are tried in the order of the largest
    such difference; a part is done when the next bound is above its best distance.
    """
    bound = np.abs(known[:, None, :] - pivot_distances(entries, pivots)[None]).max(2)
    bound = np.maximum(bound - SLACK * (known.max(1)[:, None] + bound + 1), 0)
    order = np.argsort(bound, axis=1, kind="stable")
    best, at = np.full(len(parts), MOST_LONG, np.int64), np.zeros(len(parts), np.int64)
    live, made = np.arange(len(parts)), 0
    for k in range(len(entries)):
        entry = order[live, k]
        # a bound at the best distance itself may be a tie with a lower number
        near = bound[live, entry] <= np.sqrt(best[live].astype(np.float64)) * (1 + SLACK)
        live, entry = live[near], entry[near]
        if not len(live):
            break
        exact = ((parts[live] - entries[entry]) ** 2).sum(1)
        made += len(live)
        better = (exact < best[live]) | ((exact == best[live]) & (entry < at[live]))
        best[live[better]], at[live[better]] = exact[better], entry[better]
    return at, best, made


_STORED = "id long, label string, whole binary, pivots binary"


def _prepared(rows: DataFrame, books: Codebooks) -> DataFrame:
    """Rows with their integer components, and the distances of each part to its pivots: these are made once."""

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = len(books.entries)
        for batch in batches:
            if batch.num_rows:
                values = whole(batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
                parts = values.reshape(len(values), many, -1)
                far = np.stack([pivot_distances(parts[:, p], books.pivots[p]) for p in range(many)], 1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([v.tobytes() for v in values.astype("<i4")], pa.binary()), pa.array([d.tobytes() for d in far.astype("<f4")], pa.binary())], names=["id", "label", "whole", "pivots"])

    return rows.mapInArrow(prepare, _STORED)


def _assigned(batch: pa.RecordBatch, books: Codebooks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parts, entry numbers and squared distances of a batch, by row and position."""
    many = len(books.entries)
    parts = np.frombuffer(b"".join(batch.column("whole").to_pylist()), "<i4").astype(np.int64).reshape(batch.num_rows, many, -1)
    known = np.frombuffer(b"".join(batch.column("pivots").to_pylist()), "<f4").astype(np.float64).reshape(batch.num_rows, many, -1)
    found = [nearest(parts[:, p], known[:, p], books.entries[p], books.pivots[p]) for p in range(many)]
    return parts, np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def _refined(stored: DataFrame, books: Codebooks) -> Codebooks:
    """Every entry replaced by the mean, rounded down, of the parts that are nearest to it; unused ones stay. A task sends one sum for each entry component, whatever its rows."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many, size, wide = books.entries.shape
        total, count = np.zeros((many * size, wide), np.int64), np.zeros(many * size, np.int64)
        for batch in batches:
            if batch.num_rows:
                parts, at, _ = _assigned(batch, books)
                slot = (at + np.arange(many) * size).ravel()
                np.add.at(total, slot, parts.reshape(-1, wide))
                count += np.bincount(slot, minlength=many * size)
        used = np.flatnonzero(count)
        if len(used):
            cells = (used[:, None] * wide + np.arange(wide)).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[used].ravel()), pa.array(np.repeat(count[used], wide))], names=["cell", "total", "n"])

    cells = stored.mapInArrow(sums, "cell long, total long, n long").groupBy("cell").agg(F.sum(F.col("total").cast("decimal(20,0)")).alias("total"), F.sum("n").alias("n"))
    entries = books.entries.copy().ravel()
    for cell, total, n in cells.collect():  # as many rows as the codebooks have components
        entries[cell] = int(total) // n
    return Codebooks(entries.reshape(books.entries.shape), books.pivots)


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, pivots: int = PIVOTS) -> tuple[DataFrame, Codebooks]:
    """key, label, code (entry numbers, two hex digits for each part), error (squared distances, summed), label_error (over equal labels) of the vectors; and the codebooks.

    A vector is dropped if it is null, holds a null or a component that is not finite, or has another length than the kept vector with
    the smallest key, which must be a positive multiple of ``parts`` (else all are dropped). The first codebooks are the parts of the
    vectors with the smallest keys (null keys last, of equal keys the lesser vector first); with fewer vectors than entries, there are
    as many entries as vectors. Repeated rows and keys are rows of their own. Components that times 256 are beyond some 2^27 (at 64
    components) are held at that limit, and sums beyond a long are the largest long. Without a kept vector there is no row.

    Sums by entry are made in each task; the driver sees only codebooks, whose size does not depend on the rows. Equal labels are summed
    with partial sums before they move, and come back by a join that the optimizer may broadcast or split.
    """
    if entries > 256:
        raise ValueError("an entry has two hex digits")
    good = vectors.select(F.col(key).alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    good = good.where(F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    first = good.orderBy(F.col("id").asc_nulls_last(), "v").limit(1).collect()
    width = len(first[0].v) if first and len(first[0].v) % parts == 0 else 0
    good = good.where(F.size("v") == width)
    seeds = whole(np.array([r.v for r in good.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()], np.float64).reshape(-1, max(1, width)))
    start = seeds.reshape(len(seeds), parts, -1).transpose(1, 0, 2) if len(seeds) else np.zeros((parts, 0, 0), np.int64)
    kind = dict(vectors.dtypes)
    if not len(seeds):
        shape = f"{key} {kind[key]}, {label} {kind[label]}, code string, error long, label_error long"
        return vectors.sparkSession.createDataFrame([], shape), Codebooks(start, start)
    books = Codebooks(start, spread_pivots(start, min(pivots, len(seeds))))
    stored = saved(_prepared(good.withColumn("id", F.col("id").cast("long")), books), "parts")
    for _ in range(rounds):
        books = _refined(stored, books)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                _, at, far = _assigned(batch, books)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array([r.tobytes().hex() for r in at.astype(np.uint8)]), pa.array(far.sum(1))], names=["id", "label", "code", "error"])

    coded = saved(stored.mapInArrow(code, "id long, label string, code string, error long"), "codes")
    most = F.lit(MOST_LONG).cast("decimal(38,0)")
    sums = coded.groupBy(F.col("label").alias("_label")).agg(F.least(F.sum(F.col("error").cast("decimal(20,0)")).cast("decimal(38,0)"), most).cast("long").alias("label_error"))
    rows = coded.join(sums, F.col("label").eqNullSafe(F.col("_label")))
    return rows.select(F.col("id").cast(kind[key]).alias(key), F.col("label").cast(kind[label]).alias(label), "code", "error", "label_error"), books


def codebook_text(books: Codebooks) -> str:
    """All components in decimal digits, by part, entry and place, with commas."""
    return ",".join(map(str, books.entries.ravel().tolist()))
