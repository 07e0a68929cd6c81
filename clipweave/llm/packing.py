"""Harmonic packing of token sequences into bins of a fixed capacity."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, saved, slices

PIECES = "worker long, doc_id long, start long, length long, doc_tokens long, per_bin int, sequence_id long, offset long, ids binary"
_NAMES = [x.split()[0] for x in PIECES.split(", ")]
_TYPES = [pa.int64()] * 5 + [pa.int32(), pa.int64(), pa.int64(), pa.binary()]
#: A document's end that is longer than capacity // CUT is cut to exact shares of the capacity; a bin of shorter ends wastes little.
CUT = 16
#: Bins with how many short ends there are; few classes, so that few bins stay open.
TAIL = (16, 18, 21, 24, 28, 32, 40, 48, 64, 96, 128, 256, 512, 2048)
#: How many workers' open bins meet in a group of a later round.
FAN = 8


def cuts(n: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(length, documents in its bin) of the pieces of a document of n tokens: shares 1/k of the capacity, the largest first, then a short end."""
    while n > capacity // CUT:
        k = -(-capacity // n)
        yield capacity // k, k
        n -= capacity // k
    if n:
        yield n, max((k for k in TAIL if k * n <= capacity), default=1)


class Bins:
    """The open bins of one worker: one for each class, filled by count alone."""

    def __init__(self, first: int):
        self.next, self.open = first, {}

    def put(self, piece: dict) -> list[dict]:
        """The pieces of the bin that this piece fills, if it does."""
        held = self.open.setdefault(piece["per_bin"], [])
        held.append(piece)
        if len(held) < piece["per_bin"]:
            return []
        self.open[piece["per_bin"]] = []
        offset = 0
        for p in held:
            p["sequence_id"], p["offset"] = self.next, offset
            offset += p["length"]
        self.next += 1
        return held

    def rest(self) -> list[dict]:
        return [p for held in self.open.values() for p in held]


def best_fit(rest: list[dict], first: int, capacity: int) -> None:
    """Give the last few pieces bins: the longest first, each to the bin with the least room that still takes it."""
    room: list[tuple[int, int]] = []
    for p in sorted(rest, key=lambda p: (-p["length"], p["per_bin"])):
        k = bisect_left(room, (p["length"], -1))
        left, at = room.pop(k) if k < len(room) else (capacity, first)
        first += at == first
        p["sequence_id"], p["offset"] = at, capacity - left
        insort(room, (left - p["length"], at))


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(_NAMES, _TYPES)], names=_NAMES)


def _meeting(turn: int, last: bool, capacity: int):
    """Fill bins from the open bins of a few workers; in the last round, of all that is left."""

    def again(key, table):
        me = key[0].as_py()
        bins, rows = Bins(turn << 56 | me << 28), []
        for p in sorted(table.to_pylist(), key=lambda p: (p["worker"], p["per_bin"])):
            rows += bins.put(p | {"worker": me})
        rest = bins.rest()
        if last:
            best_fit(rest, bins.next, capacity)
        return pa.Table.from_batches([_batch(rows + rest)])

    return again


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """The pieces (columns PIECES without worker and per_bin; ids are little-endian unsigned 32-bit numbers) of all documents, packed.

    Every task encodes its own documents, ends each with end_id, cuts it into reciprocal shares of the capacity and fills its bins by
    count; no document moves. Of each task only the open bins remain, a bounded number of pieces; in rounds, FAN tasks' remainders meet
    and fill bins in the same way, until one group is left, whose bounded remainder is packed best-fit. Pieces in a bin have gapless
    offsets from 0. Null and empty texts are one piece of end_id; repeated rows and null ids are documents of their own.
    """

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker, me = pieces(tokenizer), TaskContext.get().partitionId()
        bins, done = Bins(me << 28), []
        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.concatenate((worker.encode(text or ""), np.array([end_id], worker.wide))).astype("<u4")
                start = 0
                for length, k in cuts(len(ids), capacity):
                    done += bins.put({"worker": me, "doc_id": doc_id, "start": start, "length": length, "doc_tokens": len(ids), "per_bin": k, "sequence_id": None, "offset": None, "ids": ids[start : start + length].tobytes()})
                    start += length
            if done:
                yield _batch(done)
                done = []
        if rest := bins.rest():
            yield _batch(rest)

    everything = saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(fill, PIECES), "pieces")
    parts = [everything.where("sequence_id is not null")]
    rest = everything.where("sequence_id is null")
    groups = (everything.agg(F.max("worker")).first()[0] or 0) + 1
    turn = 0
    while True:
        turn, groups = turn + 1, -(-groups // FAN)

        met = saved(rest.groupBy(F.expr(f"worker div {FAN}").alias("meets")).applyInArrow(_meeting(turn, groups == 1, capacity), PIECES), "open")
        parts.append(met.where("sequence_id is not null"))
        rest = met.where("sequence_id is null")
        if groups == 1:
            break
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out.drop("worker", "per_bin")
