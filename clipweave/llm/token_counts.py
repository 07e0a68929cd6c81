"""Token counts by a map-side two-tier lookup."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _PIECE, pieces, replacing, slices


class _Tier(dict):
    """The broadcast lengths; a pre-token that they lack is asked of the worker's cache, which asks the library."""

    def __missing__(self, piece: str) -> int:
        return self.rest[piece]


def frequent_lengths(docs: DataFrame, path: str, text: str = "text", sample_rows: int = 1000, sample_bytes: int = 16384, entries: int = 32768) -> dict[str, int]:
    """Lengths of the most frequent pre-tokens of at most sample_rows texts of at most sample_bytes each.

    The table only makes lookups cheaper, so a bounded sample will do: counts do not depend on it. It never has more than entries pairs.
    """
    worker = pieces(path)
    seen: Counter = Counter()
    for (sample,) in docs.where(F.octet_length(text) <= sample_bytes).select(text).take(sample_rows):
        if worker.plain(sample):
            seen.update(_PIECE.findall(sample))
    return {piece: worker.lengths[piece] for piece, _ in seen.most_common(entries)}


def token_counts(docs: DataFrame, path: str, text: str = "text", out: str = "n_tokens", **table) -> DataFrame:
    """docs with the number of tokens of every whole text in a column ``out``.

    No row moves: each task reads its texts, adds up lengths of pre-tokens from the broadcast table and, where that misses, from its
    worker's cache. A text with other characters than the common scripts', or with a special token's string, is encoded whole by the
    library. Null and empty texts have 0 tokens; all other columns, and repeated rows, are kept,
    but a column that is named as ``out`` is replaced; an empty table stays empty.
    """
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(frequent_lengths(docs, path, text, **table))
    docs = replacing(docs, [out])
    names = docs.columns
    at = names.index(text)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = pieces(path)
        tier = _Tier(table.value)
        tier.rest = worker.lengths
        length, plain, find = tier.__getitem__, worker.plain, _PIECE.findall
        for batch in slices(batches, at):
            found = [0 if not t else sum(map(length, find(t))) if plain(t) else len(worker.whole(t)) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], names=[*names, out])

    return docs.mapInArrow(count, docs.select("*", F.lit(0).cast("long").alias(out)).schema)
