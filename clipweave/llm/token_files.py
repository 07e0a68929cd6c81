"""Token ids in length-delimited binary record files, with a separate offset index.

A record is: payload length (unsigned 64 bits), masked crc32 of these eight bytes, payload, masked crc32 of the payload; all numbers are
little-endian. A payload is: a byte that is 1 if the id is null, doc_id (signed 64 bits), bytes per token (one byte), and the tokens.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_folder, pieces, slices

_HEAD, _SUM, _META = struct.Struct("<Q"), struct.Struct("<I"), struct.Struct("<?qB")
INDEX = "shard long, file string, record long, doc_id long, offset long, length long, n_tokens long"


def masked(data: bytes) -> int:
    """A crc32 that can itself stand in checksummed data: turned by 15 bits, plus a constant."""
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def framed(payload: bytes) -> bytes:
    head = _HEAD.pack(len(payload))
    return b"".join((head, _SUM.pack(masked(head)), payload, _SUM.pack(masked(payload))))


def read_record(file) -> bytes | None:
    """The next payload of an open file, None at its end; a damaged record raises ValueError."""
    head = file.read(12)
    if not head:
        return None
    if len(head) < 12 or _SUM.unpack(head[8:])[0] != masked(head[:8]):
        raise ValueError("damaged length of a record")
    payload = file.read(_HEAD.unpack(head[:8])[0])
    if (tail := file.read(4)) != _SUM.pack(masked(payload)):
        raise ValueError(f"damaged record ({len(payload)} and {len(tail)} bytes)")
    return payload


def payload_of(doc_id: int | None, ids: np.ndarray) -> bytes:
    return _META.pack(doc_id is None, doc_id or 0, ids.dtype.itemsize) + ids.tobytes()


def sequence_of(payload: bytes) -> tuple[int | None, np.ndarray]:
    missing, doc_id, width = _META.unpack_from(payload)
    return None if missing else doc_id, np.frombuffer(payload, f"<u{width}", offset=_META.size).astype("<u4")


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = 0, folder: str | None = None) -> str:
    """Encode every text, append end_id, write the sequences in ascending doc_id order (null first); the folder that holds them.

    The texts are dealt out by ranges of doc_id and sorted; a task then writes one file ``ids/*.rec``, whatever size. Files get names of
    their own for each attempt, and only those that the index (Parquet, ``index/``) names count: a task that is lost and run again leaves
    no wrong record. Null and empty texts are sequences of end_id alone; rows that repeat an id are sequences of their own, in any order.
    """
    folder = folder or new_folder(docs.sparkSession, "tokens")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker, shard = pieces(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], worker.wide)
        store, root = fs.FileSystem.from_uri(folder)
        file, name, offset, record = None, f"ids/{shard:07d}-{uuid.uuid4().hex}.rec", 0, 0
        try:
            for batch in slices(batches):
                rows = []
                if file is None:
                    store.create_dir(f"{root}/ids", recursive=True)
                    file = store.open_output_stream(f"{root}/{name}", buffer_size=1 << 20)
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    ids = np.concatenate((worker.encode(text or ""), end))
                    data = framed(payload_of(doc_id, ids))
                    file.write(data)
                    rows.append((shard, name, record, doc_id, offset, len(data), len(ids)))
                    offset, record = offset + len(data), record + 1
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == 1 else pa.int64()) for k, c in enumerate(zip(*rows))], names=[x.split()[0] for x in INDEX.split(", ")])
        finally:
            if file is not None:
                file.close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    rows.mapInArrow(write, INDEX).write.parquet(f"{folder}/index")
    return folder


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (tokens of all sequences before), ids (array): each file is read from its first byte to its last, all checksums verified.

    Only one row for each file is gathered to add up the starts.
    """
    files = read_index(spark, folder).groupBy("shard", "file").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base")
    files = files.select("file", before)
    many = max(1, files.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, start in zip(*(c.to_pylist() for c in batch.columns)):
                with store.open_input_stream(f"{root}/{name}", buffer_size=1 << 20) as file:
                    rows, held = [], 0
                    while (payload := read_record(file)) is not None:
                        doc_id, ids = sequence_of(payload)
                        rows.append((doc_id, start, ids))
                        start, held = start + len(ids), held + len(ids)
                        if held > 1 << 20:
                            yield _sequences(rows)
                            rows, held = [], 0
                    if rows:
                        yield _sequences(rows)

    return files.repartition(many).mapInArrow(read, "doc_id long, start long, ids binary")


def _sequences(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2].tobytes() for r in rows], pa.binary())], names=["doc_id", "start", "ids"])


def read_records(wanted: DataFrame, folder: str) -> DataFrame:
    """The sequences that some rows of the index name, by their offsets, in whatever order they come: a shuffled read."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            rows, opened = [], {}
            for name, offset in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if name not in opened:
                    opened[name] = store.open_input_file(f"{root}/{name}")
                opened[name].seek(offset)
                doc_id, ids = sequence_of(read_record(opened[name]))
                rows.append((doc_id, offset, ids))
            yield _sequences(rows)
            for file in opened.values():
                file.close()

    return wanted.select("file", "offset").mapInArrow(read, "doc_id long, offset long, ids binary")
