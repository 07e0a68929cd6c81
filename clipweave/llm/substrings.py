"""Substring deduplication: documents are factored against the first places of passages in all documents (relative Lempel-Ziv)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE_BYTES, _Filled, slices

#: Words of the shortest duplicate passage, and of an anchor: of every window's anchors, the one with the least hash is indexed.
WINDOW, ANCHOR = 13, 7
#: A document is read in stretches of about so many bytes.
STRETCH = 1 << 20
_RNG = np.random.default_rng(13)
_PLACES = _RNG.integers(1, 1 << 63, (2, WINDOW), dtype=np.uint64) | np.uint64(1)
_BLANKS = b" \t\n\r\x0b\x0c"


def _hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word)


_KNOWN = _Filled(_hash, 200_000)


def _stretches(data: bytes) -> Iterator[bytes]:
    """The bytes in pieces that end at blanks."""
    at = 0
    while at < len(data):
        end = min(len(data), at + STRETCH)
        while end < len(data) and data[end] not in _BLANKS:
            end += 1
        yield data[at:end]
        at = end


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words of a text: what its ASCII blanks (20, 09-0D) part."""
    found = [np.fromiter(map(_KNOWN.__getitem__, words), np.uint64, len(words)) for words in (s.split() for s in _stretches(data))]
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(28))


def _runs(words: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """A hash of the size words that start at each place (as many places as there are whole runs)."""
    n = max(0, len(words) - size + 1)
    total = np.full(n, size + (salt << 8), np.uint64)
    for k in range(size):
        total += words[k : k + n] * _PLACES[salt, k]
    return _mixed(total)


def windows(words: np.ndarray, anchors: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """Of each window of a document: its hash, and its anchor's (the least of the runs of ANCHOR words in it). Equal windows have equal anchors."""
    own = _runs(words, WINDOW, 1)
    if not anchors or not len(own):
        return own, np.zeros(0, np.uint64)
    inside = _runs(words, ANCHOR)
    least = inside[: len(own)].copy()
    for k in range(1, WINDOW - ANCHOR + 1):
        np.minimum(least, inside[k : k + len(own)], out=least)
    return own, least


def _check(words: np.ndarray) -> np.ndarray:
    """31 more bits of each window's hash."""
    return (_runs(words, WINDOW, 0) >> np.uint64(33)).astype(np.int32)


def text_key(data: bytes) -> tuple[int, int]:
    """94 bits of a text's hash: a signed 64-bit number, and 30 bits more, at least 1."""
    import xxhash

    whole = xxhash.xxh3_128_intdigest(data)
    return (whole & (1 << 64) - 1) - (1 << 63), (whole >> 98) + 1


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id and the compressed text: it moves once."""
    import zstandard

    small = zstandard.ZstdCompressor(level=3)
    for batch in slices(batches, text=1):
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([small.compress(t or b"") for t in batch.column(1).cast(pa.binary()).to_pylist()], pa.binary())], names=["doc_id", "packed"])


def _values(column: pa.Array) -> list:
    if not pa.types.is_list(column.type) or not pa.types.is_struct(column.type.value_type):
        return column.to_pylist()
    lengths = pc.fill_null(column.value_lengths(), 0).to_numpy(zero_copy_only=False)
    flat = np.stack([f.to_numpy(zero_copy_only=False) for f in column.flatten().flatten()], 1)
    return np.split(flat, np.cumsum(lengths)[:-1])


def _unpacked(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[tuple]]:
    """Rows with their texts, in lists of about most bytes of text. A list of windows' first places becomes an array."""
    import zstandard

    large, held, size = zstandard.ZstdDecompressor(), [], 0
    for batch in slices(batches, text=1, limit=most // 4):
        for doc, packed, *rest in zip(*map(_values, batch.columns)):
            held.append((doc, large.decompress(packed), *rest))
            size += len(held[-1][1])
            if size >= most:
                yield held
                held, size = [], 0
    if held:
        yield held


def _owners(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the first and last of each run of equal keys in the order of (key, id), and that order."""
    order = np.lexsort((ids, keys))
    sorted_keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1]))) if len(keys) else np.zeros(0, int)
    last = np.concatenate((first[1:], [len(keys)])).astype(int) - 1
    return first, last, order


#: check is 0 for an anchor, over 0 for a whole text, -1 for anchors that are known to be shared, -2 for a known copy.
_ANCHORS = ["key", "check", "doc", "known"]
_ANCHORS_DDL = "key long, check int, doc long, known binary"


def _own_keys(docs: np.ndarray) -> np.ndarray:
    """Keys for rows that are only for a document."""
    return _mixed(docs.view(np.uint64)).view(np.int64)


def _told_rows(check: int, told: list[tuple[int, bytes]]) -> pa.RecordBatch:
    docs = np.array([d for d, _ in told], np.int64)
    return pa.RecordBatch.from_arrays([pa.array(_own_keys(docs)), pa.array(np.full(len(docs), check, np.int32)), pa.array(docs), pa.array([k for _, k in told], pa.binary())], names=_ANCHORS)


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text and each anchor of a slice once: a text with its smallest document, an anchor with its document if it is in one only, else without.

    What a slice knows by itself it tells its documents (known): that they are copies of an earlier one, or which anchors are shared.
    """
    for batch in slices(batches, text=1):
        first: dict[tuple[int, int], int] = {}
        rows = [(d, t, text_key(t)) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist())]
        for d, _, key in rows:
            first[key] = min(d, first.get(key, d))
        copies = [(d, np.array([key[0], first[key]], "<i8").tobytes()) for d, _, key in rows if d > first[key]]
        if copies:
            yield _told_rows(-2, copies)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in first], pa.int64()), pa.array([c for _, c in first], pa.int32()), pa.array([*first.values()], pa.int64()), pa.nulls(len(first), pa.binary())], names=_ANCHORS)
        rows = [(d, np.unique(windows(word_hashes(t))[1])) for d, t, key in rows if d == first[key]]
        sizes = [len(f) for _, f in rows]
        if not sum(sizes):
            continue
        keys, docs = np.concatenate([f for _, f in rows]), np.repeat(np.array([d for d, _ in rows], np.int64), sizes)
        begin, end, order = _owners(keys, docs)
        one = docs[order[begin]] == docs[order[end]]
        shared = np.sort(keys[order[begin[~one]]])
        yield pa.RecordBatch.from_arrays([pa.array(keys[order[begin]].view(np.int64)), pa.array(np.zeros(len(begin), np.int32)), pa.array(docs[order[begin]], mask=~one), pa.nulls(len(begin), pa.binary())], names=_ANCHORS)
        known = [(d, f[np.isin(f, shared, assume_unique=True)]) for d, f in rows] if len(shared) else []
        if known := [(d, f.tobytes()) for d, f in known if len(f)]:
            yield _told_rows(-1, known)


_WINDOWS = ["key", "check", "doc", "place", "known"]
_WINDOWS_DDL = "key long, check int, doc long, place int, known binary"
#: What a document learns of a window: its hash, and the document and place where it stands earlier; of its whole text, with the place -1.
_FIRST = np.dtype([("key", "<i8"), ("doc", "<i8"), ("place", "<i8")])


def _known_rows(told: list[tuple[int, bytes]]) -> pa.RecordBatch:
    docs, n = np.array([d for d, _ in told], np.int64), len(told)
    return pa.RecordBatch.from_arrays([pa.array(_own_keys(docs)), pa.array(np.full(n, -1, np.int32)), pa.array(docs), pa.nulls(n, pa.int32()), pa.array([k for _, k in told], pa.binary())], names=_WINDOWS)


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each window of a slice that holds a shared anchor once, with the smallest document and its first place there; the slice's other documents that have it learn that place (known), and copies that they are copies."""
    for rows in _unpacked(batches, SLICE_BYTES):
        keys, checks, docs, places, whole = [], [], [], [], []
        for d, text, hashes, packed, copied, copies in rows:
            own_key = text_key(text)[0]
            pairs = np.frombuffer(b"".join(copied), "<i8").reshape(-1, 2).tolist() + copies.tolist()
            if earlier := [first for key, first in pairs if key == own_key]:
                whole.append((d, np.array([own_key, min(earlier), -1], "<i8").tobytes()))
                continue
            shared = np.concatenate([np.array(hashes, np.int64).view(np.uint64), *(np.frombuffer(p, np.uint64) for p in packed)])
            words = word_hashes(text)
            own, anchors = windows(words)
            at = np.flatnonzero(np.isin(anchors, shared))
            if len(at):
                keys.append(own[at]), checks.append(_check(words)[at]), docs.append(np.full(len(at), d, np.int64)), places.append(at)
        if whole:
            yield _known_rows(whole)
        if not keys:
            continue
        keys, checks, docs, places = map(np.concatenate, (keys, checks, docs, places))
        # of a document's repeated windows the first place; of a slice's, the smallest document
        order = np.lexsort((places, docs, checks, keys))
        keys, checks, docs, places = keys[order], checks[order], docs[order], places[order]
        new = np.concatenate(([True], (keys[1:] != keys[:-1]) | (checks[1:] != checks[:-1])))
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        later = np.flatnonzero(docs > docs[head])
        later = later[np.lexsort((keys[later], docs[later]))]
        told = np.empty(len(later), _FIRST)
        told["key"], told["doc"], told["place"] = keys[later].view(np.int64), docs[head[later]], places[head[later]]
        n = int(new.sum())
        yield pa.RecordBatch.from_arrays([pa.array(keys[new].view(np.int64)), pa.array(checks[new]), pa.array(docs[new]), pa.array(places[new].astype(np.int32)), pa.nulls(n, pa.binary())], names=_WINDOWS)
        if len(told):
            to, cut = np.unique(docs[later], return_index=True)
            yield _known_rows([(d, x.tobytes()) for d, x in zip(to.tolist(), np.split(told, cut[1:]))])


def factors(words: np.ndarray, told: np.ndarray) -> np.ndarray:
    """start, length, ref_doc, ref_start of the long factors of a document: greedily from its start, as far as the windows' first places follow each other in one document.

    told: what is known of the document's windows. Windows across the border of two factors are asked for like any other, so the factors
    cover just the words of the windows that stand in an earlier document.
    """
    own, _ = windows(words, anchors=False)
    told = told[np.argsort(told["key"], kind="stable")]
    slot = np.searchsorted(told["key"], own.view(np.int64))
    hit = slot < len(told)
    hit[hit] = told["key"][slot[hit]] == own.view(np.int64)[hit]
    at = np.flatnonzero(hit)
    doc, place = told["doc"][slot[at]], told["place"][slot[at]]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1]) | (place[1:] != place[:-1] + 1)
    begin = np.flatnonzero(new)
    length = np.diff(np.concatenate((begin, [len(at)]))) + WINDOW - 1
    return np.stack((at[begin], length if len(at) else np.zeros(0, int), doc[begin], place[begin]), 1).astype(np.int64)


_RESULT = "doc_id long, n_words long, n_removed long, kept string, factors array<struct<start:long,length:long,ref_doc:long,ref_start:long>>"
_FACTOR = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "ref_doc", "ref_start")]))


def _kept(data: bytes, covered: np.ndarray) -> bytes:
    """The words that are not covered, with one space between."""
    out, at = [], 0
    for stretch in _stretches(data):
        words = stretch.split()
        mine = covered[at : at + len(words)]
        out += [w for w, c in zip(words, mine.tolist()) if not c] if mine.any() else words
        at += len(words)
    return b" ".join(out)


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _unpacked(batches, SLICE_BYTES):
        out = {n: [] for n in ("doc_id", "n_words", "n_removed", "kept", "factors")}
        for d, data, firsts, known in rows:
            found = np.zeros((0, 4), np.int64)
            told = np.frombuffer(firsts.tobytes() + b"".join(known or []), _FIRST)
            whole = told[told["place"] < 0]
            if len(whole) and (copy := whole[whole["key"] == text_key(data)[0]]["doc"]).size:
                n = sum(len(s.split()) for s in _stretches(data))
                found = np.array([[0, n, copy.min(), 0]][: n >= WINDOW], np.int64).reshape(-1, 4)
            elif len(told) > len(whole):
                words = word_hashes(data)
                found, n = factors(words, told[told["place"] >= 0]), len(words)
            else:
                n = sum(len(s.split()) for s in _stretches(data))
            edge = np.zeros(n + 1, np.int64)
            np.add.at(edge, found[:, 0], 1)
            np.add.at(edge, found[:, 0] + found[:, 1], -1)
            covered = np.cumsum(edge)[:n] > 0
            row = (d, n, int(covered.sum()), _kept(data, covered).decode(), [dict(zip(("start", "length", "ref_doc", "ref_start"), f)) for f in found.tolist()])
            for k, v in zip(out, row):
                out[k].append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), _FACTOR)
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], names=[*out])


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, one space between) and factors of every document.

    A word goes if a window of WINDOW words around it also starts in a document with a smaller doc_id, as the texts are given. factors
    are the document's passages that stand earlier: start and length in words, and the earlier document and place where the passage
    stands. They may overlap by less than a window.

    Every document is factored against all documents, as reference blocks that are indexed in two steps. First texts and anchors: each
    slice of documents (some megabytes) tells its texts and anchors once, so a passage of a third of all documents is as many rows as
    there are slices, not documents; an exact copy of an earlier text is one factor, and an anchor that two other documents share
    makes their windows candidates. Then the windows that hold such an anchor meet in the same way, and each document learns where its
    windows stand first. Texts move once, compressed, by doc_id; groups of equal keys only carry numbers; nothing is gathered in the driver.

    Null and empty texts have no words. Rows that repeat a doc_id are rows of their own, and no earlier than each other. A null doc_id is
    neither before nor after another: its row keeps all words. Other columns are ignored, whatever their names. An empty table gives no row.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = rows.where("doc_id is not null")
    same = Window.partitionBy("key", "check")
    anchors = own.where("text is not null").mapInArrow(_anchor_rows, _ANCHORS_DDL)
    anchors = anchors.select("*", (F.count("*").over(same) > 1).alias("many"), F.max(F.col("doc").isNull()).over(same).alias("inside"), F.min("doc").over(same).alias("first"))
    anchors = anchors.where("check < 0 or (check = 0 and doc is not null and (many or inside)) or (check > 0 and first < doc)")
    shared = anchors.groupBy("doc").agg(
        F.collect_list(F.when(F.col("check") == 0, F.col("key"))).alias("hashes"), F.collect_list(F.when(F.col("check") == -1, F.col("known"))).alias("known"),
        F.collect_list(F.when(F.col("check") == -2, F.col("known"))).alias("copied"), F.collect_list(F.when(F.col("check") > 0, F.struct("key", "first"))).alias("copies"),
    )

    moved = own.mapInArrow(_packed, "doc_id long, packed binary").where("doc_id is not null").repartition("doc_id")  # with the filter that a join would add, so that both joins read one exchange
    found = moved.join(shared.hint("shuffle_hash"), moved["doc_id"] == shared["doc"]).select("doc_id", "packed", "hashes", "known", "copied", "copies").mapInArrow(_window_rows, _WINDOWS_DDL)
    first = F.min(F.when(F.col("known").isNull(), F.struct("doc", "place"))).over(Window.partitionBy("key", "check"))
    found = found.withColumn("first", first).where("known is not null or first.doc < doc")
    one = F.when(F.col("known").isNull(), F.struct("key", F.col("first.doc").alias("at"), F.col("first.place").cast("long").alias("place")))
    told = found.groupBy("doc").agg(F.collect_list(one).alias("firsts"), F.collect_list("known").alias("known"))
    full = moved.join(told.hint("shuffle_hash"), moved["doc_id"] == told["doc"], "left_outer").select("doc_id", "packed", "firsts", "known")
    alone = rows.where("doc_id is null").mapInArrow(_packed, "doc_id long, packed binary").select("doc_id", "packed", F.lit(None).cast(full.schema["firsts"].dataType).alias("firsts"), F.lit(None).cast("array<binary>").alias("known"))
    return full.union(alone).mapInArrow(_cleaned, _RESULT)
