"""What the operators share: the shared folder, saved tables, tokens of a text."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import new_folder

#: Arrow batches are worked through in slices of about this many bytes of text, so that memory does not follow the batch size.
SLICE_BYTES = 4 << 20


#: Whether a query's shuffle files go when it ends. Else they stay until the driver happens to collect its garbage, which a large heap rarely does.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: lineage ends here, lost executors cost no recomputation, and the shuffle files that led here are removed."""
    conf, path = df.sparkSession.conf, new_folder(df.sparkSession, name)
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Up to so many ids, of 8 bytes each, are broadcast to leave their rows out.
MOST_IDS = 1_000_000


def without(docs: DataFrame, ids: DataFrame, most: int = MOST_IDS) -> DataFrame:
    """docs without the rows of these ids (column doc_id; repeats and nulls allowed). The ids are saved and counted: if they are few, they are broadcast and no document moves; else one anti-join moves the documents."""
    gone = saved(ids.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "gone")
    few = gone.limit(most + 1).count() <= most
    return docs.join(F.broadcast(gone) if few else gone.hint("shuffle_hash"), docs["doc_id"] == gone["doc_id"], "left_anti")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def replacing(docs: DataFrame, new: list[str]) -> DataFrame:
    """docs without the columns that new ones of these names replace; names are compared without case, as Spark does."""
    gone = {n.lower() for n in new}
    return docs.select(*(F.col("`" + c.replace("`", "``") + "`") for c in docs.columns if c.lower() not in gone))


def unused(docs: DataFrame, name: str, ends: tuple[str, ...] = ("",)) -> str:
    """name, with underscores before it until docs has no column of that name with any of the ends."""
    taken = {c.lower() for c in docs.columns}
    while any((name + e).lower() in taken for e in ends):
        name = "_" + name
    return name


def slices(batches: Iterator[pa.RecordBatch], text: int = -1, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in pieces of about limit bytes in the text column; a row is never cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def folded(doc_id):
    """crc32 of the id as text, which the folds of the queries use; a null id is in none of them, as if this were -1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(-1))


# ---------------------------------------------------------------- tokenizer

#: The tokenizer's pre-token pattern, for texts of the characters in _PLAIN only: there, Python's classes agree with its classes.
_PIECE = re.compile(r" ?[^\W\d_]+|'(?:s|t|re|ve|m|ll|d)| ?(?:[^\s\w]|_)+| ?\d+|\s+(?!\S)|\s+")
#: ASCII, Latin, Greek, Cyrillic, common punctuation, kana, common ideographs, without signs that are numbers to one side and letters to the other.
_PLAIN = re.compile("[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-ɏΑ-ΡΣ-ώЀ-҂Ҋ-ӿ‐-‧‰-⁞₠-₰、-〆〈-〠ぁ-ゖァ-ヺ一-龥]")


class Pieces:
    """One worker's tokenizer: splits plain texts into pre-tokens itself and asks the library for a pre-token once; other texts go to the library whole."""

    def __init__(self, path: str, most: int = 400_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.most = most
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]  # fixed values: bytes that stand for themselves in byte-level vocabularies
        rest = [b for b in range(256) if b not in set(keep)]
        self.letters = {b: chr(b) for b in keep} | {b: chr(256 + k) for k, b in enumerate(rest)}
        self.wide = np.dtype("<u2") if self.library.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.known: dict[str, bytes] = _Filled(self._piece, most)
        self.lengths: dict[str, int] = _Filled(lambda piece: len(self._ids(piece)), most)

    def _ids(self, piece: str) -> list[int]:
        return [t.id for t in self.library.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))]

    def _piece(self, piece: str) -> bytes:
        return np.array(self._ids(piece), self.wide).tobytes()

    def whole(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def plain(self, text: str) -> bool:
        return not (_PLAIN.search(text) or any(s in text for s in self.special))

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text, in the narrowest of 16 and 32 bits that holds the vocabulary."""
        if self.plain(text):
            return np.frombuffer(b"".join(map(self.known.__getitem__, _PIECE.findall(text))), self.wide)
        return np.array(self.whole(text), self.wide)


class _Filled(dict):
    """A cache that fills itself and starts afresh when it is full."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


@functools.cache
def pieces(path: str) -> Pieces:
    """The worker process's own; it outlives a task."""
    return Pieces(path)
