"""Connected components by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

#: A task ties what it has read so far and starts afresh after about so many nodes.
HELD = 1 << 20


def _tied(batches: Iterator[pa.RecordBatch], held: int = HELD) -> Iterator[pa.RecordBatch]:
    """The edges (hi, lo) of a task as stars: what these edges connect stays connected, by no more edges than nodes."""
    up: dict[int, int] = {}

    def root(a: int) -> int:
        while (b := up.get(a, a)) != a:
            up[a] = up.get(b, b)
            a = b
        return a

    def stars() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([*up], pa.int64()), pa.array([root(a) for a in up], pa.int64())], names=["hi", "lo"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
        if len(up) > held:
            yield stars()
            up.clear()
    yield stars()


def connected(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node of the links (a, b); loops and nulls are ignored.

    In each round every node hands its larger neighbours, and then its smaller ones, to the smallest node it knows of; edges only get
    shorter, and at the end each component is a star. Before they are saved, in the shared folder, a round's edges are tied inside each
    task, so that few edges need few rounds. A round is joins and aggregates on the edges; the driver sees whether a node is left that
    has two centres or is a centre with one of its own.
    """
    tied = lambda edges: saved(edges.mapInArrow(_tied, "hi long, lo long"), "stars")
    edges = tied(links.where("a <> b").select(F.greatest("a", "b").cast("long").alias("hi"), F.least("a", "b").cast("long").alias("lo")))
    while True:
        ends = edges.select(F.col("hi").alias("u"), "lo").union(edges.select("lo", F.lit(None).cast("long")))
        ends = ends.groupBy("u").agg(F.min("lo").alias("least"), F.max("lo").alias("most"), F.max(F.col("lo").isNull()).alias("centre"))
        if not ends.agg(F.count_if(F.expr("least < most or (centre and least is not null)"))).first()[0]:
            break
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        edges = tied(small.union(least.select("hi", "m")))
    stars = edges.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return stars.union(edges.select("lo", "lo")).distinct()
