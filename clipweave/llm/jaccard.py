"""Near-duplicate components by an exact Jaccard join on word shingles, with prefixes of tokens and of token combinations."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved, slices
from .components import connected

WORDS = 5
PERCENT = 80
#: Tokens that LOCAL documents share among documents of about COUNTED shingles are counted; the frequent class has the MOST most frequent of those that count OFTEN times or more.
COUNTED, LOCAL, OFTEN, MOST = 1 << 21, 3, 6, 1 << 17
#: Sets of this many shingles or more index frequent tokens in pairs; pairs are made inside groups of about GROUP of a prefix's frequent tokens.
PAIRED, GROUP = 8, 4
#: Limits of a cluster, or a block of one, that is compared in one group: documents, and shingles in all; small clusters share groups of about GROUP_TOKENS.
BLOCK_DOCS, BLOCK_TOKENS, GROUP_TOKENS = 1024, 1 << 21, 1 << 19
DELEGATES = 4
#: Up to this many different sets that share a key are paired, in the first and in the second round of keys. Keys of more go into the second round, and there are tied to one of the sets.
FEW = (32, 48)
#: Places of a bitmap of keys (bounded: 4 MB), the bits of a key from which its places there are, and keys' tokens in the second round.
PLACES, SHIFTS, TRIPLE = 1 << 25, (0, 19, 39), 3
#: So many keys more than one have similar sets in common in the first round: a set with no more keys of many needs no second round.
SPARE = 2
#: The size of a set that stands for many, of whatever sizes.
ANY = 0

_RNG = np.random.default_rng(20)
_BYTES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_PLACES = _RNG.integers(1, 1 << 63, WORDS, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: Bands of sizes, BANDS of them to a size class, and pieces that rows with band keys of many are dealt into.
BANDS, PIECES = 4, 64
#: Size classes: sets whose similarity reaches PERCENT are in the same class or in neighbouring ones.
_SIZES = (100 / PERCENT) ** np.arange(0, 120)
_BANDS = (100 / PERCENT) ** (np.arange(0, 120 * BANDS) / BANDS)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' shingle sets as 64-bit hashes, one after the other, each ascending; and where each begins (one more: the end)."""
    data = b" ".join((t or b"").translate(_LOWER) for t in texts) + b" "
    sizes = np.array([len(t or b"") + 1 for t in texts], np.int64)
    raw = np.frombuffer(data, np.uint8)
    blank = _BLANK[raw]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if len(raw) and not blank[0]:
        edge = np.concatenate(([0], edge))
    begin, end = edge[::2], edge[1::2]
    power = np.full(len(raw) + 1, _BASE, np.uint64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    inverse = pow(_BASE, -1, 1 << 64)
    back = np.full(len(raw) + 1, inverse, np.uint64)
    back[0] = 1
    np.multiply.accumulate(back, out=back)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[raw] * power[:-1], dtype=np.uint64)))
    words = mixed((sums[end] - sums[begin]) * back[begin] + (end - begin).astype(np.uint64))
    doc = np.searchsorted(np.cumsum(sizes), begin, side="right")
    many = np.bincount(doc, minlength=len(texts))
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    padded = np.concatenate((words, np.zeros(WORDS, np.uint64)))
    place = np.arange(len(words)) - (np.cumsum(many) - many)[doc]
    length = np.minimum(many, WORDS)[doc]
    starts = place <= many[doc] - length
    total = np.zeros(len(words), np.uint64)
    for k in range(WORDS):
        total += np.where(k < length, padded[k : k + len(words)] * _PLACES[k], np.uint64(0))
    tokens = mixed(total + length.astype(np.uint64))[starts]
    doc = doc[starts]
    order = np.lexsort((tokens, doc))
    tokens, doc = tokens[order], doc[order]
    keep = np.concatenate(([True], (tokens[1:] != tokens[:-1]) | (doc[1:] != doc[:-1])))
    tokens, doc = tokens[keep], doc[keep]
    return tokens, np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(texts)))))


def _distinct(tokens: np.ndarray, begins: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Each set's digest, and the numbers of the sets that are the first of their kind and not empty."""
    digests = [hashlib.blake2b(tokens[a:b].tobytes(), digest_size=16).digest() for a, b in zip(begins, begins[1:])]
    first = {d: k for k, d in reversed(list(enumerate(digests)))}
    return digests, np.array([k for k, d in enumerate(digests) if first[d] == k and begins[k + 1] > begins[k]], int)


def _chosen(tokens: np.ndarray, begins: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = begins[which + 1] - begins[which]
    doc = np.repeat(np.arange(len(which)), sizes)
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(begins[which], sizes)
    return tokens[at], doc


def bitmap(tokens: np.ndarray) -> bytes:
    """A bit for each token, at a place by its first bits; the length is a power of two, three bits a token or more."""
    wide = max(6, int(3 * len(tokens)).bit_length())
    bits = np.zeros(1 << wide, bool)
    bits[(tokens >> np.uint64(64 - wide)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def may_link(a: bytes, b: bytes, n: int, m: int) -> bool:
    """False only if sets of n and m tokens with these bitmaps surely don't link: a bit of one set alone stands for a token that the other lacks."""
    if 100 * min(n, m) < PERCENT * max(n, m):
        return False
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) != len(y):  # fold the longer: neighbouring places become one
        long, short = (x, y) if len(x) > len(y) else (y, x)
        long = np.packbits(np.unpackbits(long).reshape(8 * len(short), -1).any(1))
        x, y = (long, short) if len(x) > len(y) else (short, long)
    lacks_a, lacks_b = (int(np.bitwise_count(z).sum()) for z in (y & ~x, x & ~y))
    both = min(n - lacks_b, m - lacks_a)
    return 100 * both >= PERCENT * (n + m - both)


_SUMMARY = {"doc_id": pa.int64(), "n": pa.int64(), "digest": pa.binary(), "token": pa.int64(), "bits": pa.binary(), "label": pa.int64()}


def _counted(tokens: list[np.ndarray]) -> pa.RecordBatch:
    found, many = np.unique(np.concatenate(tokens), return_counts=True)
    found, many = found[many >= LOCAL], many[many >= LOCAL]
    own = {"n": pa.array(many, pa.int64()), "token": pa.array(found.view(np.int64))}
    return pa.RecordBatch.from_arrays([own.get(c, pa.nulls(len(found), t)) for c, t in _SUMMARY.items()], names=[*_SUMMARY])


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n_shingles, digest and bitmap of each set; and, with null digests, tokens that several distinct sets near each other share, with their number."""
    held, many = [], 0
    for batch in slices(batches, limit=1 << 20):
        tokens, begins = shingle_sets(batch.column(1).cast(pa.binary()).to_pylist())
        digests, which = _distinct(tokens, begins)
        held.append(_chosen(tokens, begins, which)[0])
        many += len(held[-1])
        if many > COUNTED:
            yield _counted(held)
            held, many = [], 0
        bits = pa.array([bitmap(tokens[a:b]) for a, b in zip(begins, begins[1:])], pa.binary())
        own = {"doc_id": batch.column(0), "n": pa.array(np.diff(begins), pa.int64()), "digest": pa.array(digests, pa.binary()), "bits": bits, "label": pa.array([_label(d) for d in digests], pa.int64())}
        yield pa.RecordBatch.from_arrays([own.get(c, pa.nulls(len(digests), t)) for c, t in _SUMMARY.items()], names=[*_SUMMARY])
    if held:
        yield _counted(held)


def _marked(hot: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys have all their bits in the bitmap. With one bit, a long set has keys that are taken for keys of many by chance alone, the more the larger the table."""
    found = np.ones(len(keys), bool)
    for shift in SHIFTS:
        place = keys >> np.uint64(shift) & np.uint64(PLACES - 1)
        found &= hot[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1) > 0
    return found


def prefix_keys(tokens: np.ndarray, doc: np.ndarray, sizes: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], hot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index keys of sets and the numbers of the sets that they are of: two sets whose similarity reaches PERCENT have a key in common.

    All sets order their tokens in one way: rare ones first, frequent ones last, by frequency. Of a set of n tokens, at most
    n - ceil(PERCENT n / 100) are missing in a similar set. A prefix of one rare token more has one in common with it: its tokens are keys.
    Where rare tokens do not suffice, the prefix is extended by frequent ones, dealt into groups; it goes on until, for every token
    that can be missing and one more, there is a rare token, or a token beyond the first k - 1 of its group; then some group keeps k tokens, and
    combinations of k are the keys. The groups' number depends on the size class alone; a set makes keys for its own class and the next. Sets of
    small classes combine k - 1 tokens of a prefix that is longer by k - 2.

    k is 2, and everything that is needed is needed SPARE times more, so that two similar sets have SPARE + 1 keys in common. With hot, a
    bitmap of frequent tokens (as single keys), k is TRIPLE, and these are frequent too: whether a token is, is the same for all sets, and
    any such rule gives keys in common, so a place of the bitmap that two tokens share does no harm.
    """
    known, count = frequent
    at = np.minimum(np.searchsorted(known, tokens), max(0, len(known) - 1))
    often = np.where(known[at] == tokens, count[at], 0) if len(known) else np.zeros(len(tokens), np.int64)
    k = 2
    if hot is not None:
        k = TRIPLE
        often = np.maximum(often, _marked(hot, mixed(tokens)))
    order = np.lexsort((tokens, often, doc))
    tokens, often = tokens[order], often[order]
    need = np.minimum(sizes, sizes - -(-PERCENT * sizes // 100) + 1 + (SPARE if hot is None else 0))
    first = np.cumsum(sizes) - sizes
    place = np.arange(len(tokens)) - np.repeat(first, sizes)
    rare = np.bincount(doc, often == 0, len(sizes)).astype(np.int64)
    single = place < np.minimum(need, rare)[doc]
    keys, of = [mixed(tokens[single])], [doc[single]]
    for d in np.flatnonzero(rare < need):
        rest = tokens[first[d] + rare[d] : first[d] + sizes[d]]
        lacks = int(need[d] - rare[d])
        own = int(np.searchsorted(_SIZES, sizes[d], side="right")) - 1
        for size in (own, own + 1):
            salt = np.full(1, size + 1, np.uint64)
            if _SIZES[size] < PAIRED:
                chosen, many = [range(min(len(rest), lacks + k - 2))], k - 1
            else:
                groups = max(1, round(_SIZES[size] * (100 - PERCENT) / 100 / GROUP))
                group = (mixed(rest + salt) % np.uint64(groups)).astype(np.int64)
                seen: dict[int, list[int]] = {}
                spare = 0
                for i, g in enumerate(group.tolist()):
                    mine = seen.setdefault(g, [])
                    mine.append(i)
                    spare += len(mine) >= k
                    if spare >= lacks:
                        break
                chosen, many = seen.values(), k
            sets = np.array([c for ks in chosen for c in combinations(ks, many)], int).reshape(-1, many)
            found = mixed(salt + np.uint64(1000 * many))
            for column in sets.T:
                found = mixed(rest[column] + found * np.uint64(3))
            keys.append(np.broadcast_to(found, len(sets)))
            of.append(np.full(len(sets), d))
    return np.concatenate(keys), np.concatenate(of)


def band_keys(tokens: np.ndarray, doc: np.ndarray, sizes: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys for each pair of bands of sizes, the sets that they are of, and the set's side (0: the lower band, 1: the upper, 2: both bands are one): two sets that link have a key in common, on either side one or both on side 2.

    Sets of n and m tokens that link share PERCENT (n + m) / (100 + PERCENT) at least. So, of tokens in one order (rare ones first, by often),
    a set that meets one of a band with sizes from m on has one of its first n + 1 less so many in common with it. For sets of like sizes that is a ninth, not a fifth, of the tokens.
    """
    order = np.lexsort((tokens, often, doc))
    tokens, doc = tokens[order], doc[order]
    place = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    own = np.searchsorted(_BANDS, sizes, side="right") - 1
    found = []
    for apart in range(-BANDS, BANDS + 1):
        other = own + apart
        least = np.ceil(_BANDS[np.maximum(other, 0)]).astype(np.int64)
        both = -(-PERCENT * (sizes + least) // (100 + PERCENT))
        first = np.where(other >= 0, np.minimum(sizes, sizes - both + 1), 0)
        chosen = place < first[doc]
        salt = mixed((np.minimum(own, other) * (BANDS + 1) + abs(apart) + 1).astype(np.uint64))
        side = 2 if not apart else int(apart < 0)
        found.append((mixed(tokens[chosen] + salt[doc[chosen]]), doc[chosen], np.full(int(chosen.sum()), side, np.int8)))
    return tuple(np.concatenate(x) for x in zip(*found))


def _label(digest: bytes) -> int:
    """Eight bytes of a set's digest, which stand for it in keys and pairs: equal sets are one there."""
    return int.from_bytes(digest[:8], "little", signed=True)


def _index(frequent, often=None):
    """A task's keys, each with the label and the size of its set."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=1 << 20):
            tokens, begins = shingle_sets(batch.column(1).cast(pa.binary()).to_pylist())
            digests, which = _distinct(tokens, begins)
            if not len(which):
                continue
            sizes = np.diff(begins)[which]
            keys, of = prefix_keys(*_chosen(tokens, begins, which), sizes, frequent.value, often.value if often else None)
            label = np.array([_label(digests[w]) for w in which], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(label[of]), pa.array(sizes[of].astype(np.int32))], names=["key", "label", "n"])

    return index


def _crowded(frequent, hot):
    """The documents whose sets have more than SPARE keys of many, with the least of these keys, which similar sets mostly share; of equal sets of a slice, one."""

    def crowded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=1 << 20):
            tokens, begins = shingle_sets(batch.column(1).cast(pa.binary()).to_pylist())
            _, which = _distinct(tokens, begins)
            if len(which):
                keys, of = prefix_keys(*_chosen(tokens, begins, which), np.diff(begins)[which], frequent.value)
                marked = _marked(hot.value, keys)
                near = np.full(len(which), np.iinfo(np.int64).max)
                np.minimum.at(near, of[marked], keys[marked].view(np.int64))
                some = np.bincount(of[marked], minlength=len(which)) > SPARE
                yield pa.RecordBatch.from_arrays([pa.array(near[some]), *batch.take(pa.array(which[some])).columns], names=["near", "doc_id", "text"])

    return crowded


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tokens (as single keys) that several different sets near each other share, among sets of about COUNTED shingles, and how many of these have them. A token that is left out only counts as rare: the keys stay exact."""

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        found, many = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(mixed(found[many > 1]).view(np.int64)), pa.array(many[many > 1])], names=["token", "n"])

    held, many = [], 0
    for batch in slices(batches, limit=1 << 20):
        tokens, begins = shingle_sets(batch.column(1).cast(pa.binary()).to_pylist())
        held.append(_chosen(tokens, begins, _distinct(tokens, begins)[1])[0])
        many += len(held[-1])
        if many > COUNTED:
            yield counted(held)
            held, many = [], 0
    if held:
        yield counted(held)


_PAIR = {"a": pa.int64(), "b": pa.int64(), "kind": pa.int8()}
PAIR, TIE, MANY = range(3)


def _ready(keys: np.ndarray, labels: np.ndarray, sizes: np.ndarray, few: int, tie: bool) -> pa.RecordBatch:
    """Of each key, a run of rows: if few sets have it, the PAIRs of those of like sizes. Of many, with tie, each set that has one of a like size before it, tied to the first of their chain; else the key itself, as MANY."""
    order = np.lexsort((labels, sizes, keys))
    keys, labels, sizes = keys[order], labels[order], sizes[order].astype(np.int64)
    new = np.concatenate(([True], (keys[1:] != keys[:-1]) | (labels[1:] != labels[:-1])))  # rows of equal sets are one
    keys, labels, sizes = keys[new], labels[new], sizes[new]
    begin = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    long = np.diff(np.append(begin, len(keys)))
    found = []
    for n in np.unique(long[(long > 1) & (long <= few)]).tolist():
        at = begin[long == n][:, None] + np.arange(n)
        a, b = np.triu_indices(n, 1)
        a, b = at[:, a].ravel(), at[:, b].ravel()
        like = 100 * np.minimum(sizes[a], sizes[b]) >= PERCENT * np.maximum(sizes[a], sizes[b])
        found.append(np.stack((labels[a[like]], labels[b[like]], np.full(like.sum(), PAIR)), 1))
    many = long > few
    if tie:
        at = np.flatnonzero(np.repeat(many, long))
        if len(at):
            new = np.concatenate(([True], (keys[at][1:] != keys[at][:-1]) | (100 * sizes[at][:-1] < PERCENT * sizes[at][1:])))
            found.append(np.stack((labels[at][new][np.cumsum(new) - 1], labels[at], np.full(len(at), TIE)), 1))
    elif many.any():
        found.append(np.stack((keys[begin[many]], keys[begin[many]], np.full(many.sum(), MANY)), 1))
    pairs = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    pairs[:, :2].sort(axis=1)
    pairs = np.unique(pairs[(pairs[:, 0] != pairs[:, 1]) | (pairs[:, 2] == MANY)], axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, k].astype(np.int64)).cast(t) for k, t in enumerate(_PAIR.values())], names=[*_PAIR])


def _paired(few: int, tie: bool, piece: int = 1 << 16):
    """Pairs and ties, or keys of many, of rows that are sorted by key. A key of very many rows is worked on in pieces, with a set of each size class of the pieces before, so that chains go on."""

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)]
        for batch in batches:
            if not batch.num_rows:
                continue
            held = [np.concatenate((h, c.to_numpy())) for h, c in zip(held, batch.columns)]
            last = int(np.searchsorted(held[0], held[0][-1]))
            if last:
                yield _ready(*(h[:last] for h in held), few, tie)
            held = [h[last:] for h in held]
            if len(held[0]) > piece:
                yield _ready(*held, few, tie)
                # more sets than few of one key, and for each size class the first and the last: whoever comes later finds one of a like size if there was one
                classes = np.searchsorted(_SIZES, held[2], side="right")
                order = np.lexsort((held[2], classes))
                edge = np.concatenate(([True], np.diff(classes[order]) != 0))
                keep = np.union1d(order[edge | np.append(edge[1:], True)], np.unique(held[1], return_index=True)[1][: few + 1])
                held = [h[keep] for h in held]
        if len(held[0]):
            yield _ready(*held, few, tie)

    return paired


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [may_link(*row) for row in zip(*(batch.column(c).to_pylist() for c in ("bits_a", "bits_b", "n_a", "n_b")))]
        yield batch.select(["first_a", "first_b"]).rename_columns(["a", "b"]).filter(pa.array(keep, pa.bool_()))


_BANDED = "key long, doc_id long, component long, outside boolean, n int, side byte"


def _banded(frequent, often, asked=None):
    """Band keys of rows (doc_id, cluster, component, outside, text), salted with the cluster; with asked, a bitmap, only those that have their bit in it."""

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count = frequent.value
        for batch in slices(batches, 4, limit=1 << 20):
            tokens, begins = shingle_sets(batch.column(4).cast(pa.binary()).to_pylist())
            sizes = np.diff(begins)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            at = np.minimum(np.searchsorted(known, tokens), max(0, len(known) - 1))
            many = np.where(known[at] == tokens, count[at], 0) if len(known) else np.zeros(len(tokens), np.int64)
            if often:
                many = np.maximum(many, _marked(often.value, mixed(tokens)))
            keys, of, side = band_keys(tokens, doc, sizes, many)
            keys = mixed(keys ^ mixed(batch.column(1).to_numpy().view(np.uint64))[of])
            if asked:
                keep = _marked(asked.value, keys)
                keys, of, side = keys[keep], of[keep], side[keep]
            columns = [pa.array(keys.view(np.int64)), *(batch.column(c).take(pa.array(of)) for c in range(4) if c != 1), pa.array(sizes[of].astype(np.int32)), pa.array(side)]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "doc_id", "component", "outside", "n", "side"])

    return banded


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b, text_a, text_b) that link."""
    for batch in batches:
        keep = []
        for pair in zip(batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).cast(pa.binary()).to_pylist()):
            tokens, begins = shingle_sets([*pair])
            both = len(np.intersect1d(tokens[: begins[1]], tokens[begins[1] :], assume_unique=True))
            keep.append(100 * both >= PERCENT * (len(tokens) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _across(now: DataFrame, docs: DataFrame, classes: DataFrame, frequent, often, few: int) -> tuple[DataFrame, DataFrame]:
    """Links between the clusters' outside members and other components (rows: doc_id, cluster, component, outside), and the outside members (doc_id) of which some may be missing: those with a band key of more than few sets.

    Keys of many are counted before their rows move, and what is left of a key is a few rows; rows whose key only one side has meet nobody.
    """
    spark = now.sparkSession
    rows = now.join(docs, "doc_id").select("doc_id", "cluster", "component", "outside", "text")
    asked = saved(rows.where("outside").mapInArrow(_banded(frequent, often), _BANDED), "asked")
    places = spark.sparkContext.broadcast(_bitmap(asked.select("key")))
    keys = asked.union(saved(rows.where("not outside").mapInArrow(_banded(frequent, often, places), _BANDED), "answers"))
    side = lambda k: F.count_if(F.col("side") == k)
    counts = keys.groupBy("key").agg(side(0).alias("lower"), side(1).alias("upper"), side(2).alias("same")).where("lower + upper + same > 1")
    counts = saved(counts.select("key", F.expr("same > 1 or (lower > 0 and upper > 0)").alias("meet"), (F.col("lower") + F.col("upper") + F.col("same") > few).alias("many")), "band_counts")
    # a key of many is dealt out in pieces; of the others, those that meet
    piece = F.pmod(F.xxhash64("doc_id"), F.lit(PIECES)).alias("piece")
    many = counts.where("many").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PIECES - 1).cast("long"))))
    left = asked.select("key", "doc_id", piece).join(many.where("meet").select("key", "piece"), ["key", "piece"], "left_semi").select("doc_id").distinct()
    some = keys.withColumn("piece", piece).join(many.select("key", "piece"), ["key", "piece"], "left_anti").join(counts.where("meet and not many").select("key"), "key", "left_semi")
    one, two = (some.select("key", *(F.col(c).alias(f"{c}_{x}") for c in ("doc_id", "component", "outside", "n", "side"))) for x in "ab")
    meet = "component_a <> component_b and (outside_a or outside_b) and (side_a < side_b and side_b < 2 or side_a = 2 and side_b = 2 and doc_id_a < doc_id_b)"
    pairs = one.join(two, "key").where(meet).where(100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b"))
    pairs = pairs.select(F.least("doc_id_a", "doc_id_b").alias("a"), F.greatest("doc_id_a", "doc_id_b").alias("b")).distinct()
    of = lambda x: classes.select(F.col("first").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("first", "n", "bits")))
    pairs = saved(pairs.join(of("a"), "a").join(of("b"), "b").mapInArrow(_possible, "a long, b long").distinct(), "band_pairs")
    text = lambda x: docs.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}"))
    links = pairs.join(text("a"), "a").join(text("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(_linked, "a long, b long")
    return saved(links, "across"), saved(left, "left")


def _bitmap(keys: DataFrame) -> np.ndarray | None:
    """The bitmap of a column of keys, put together in parts of 64 places, so bounded on the driver; None if there are none."""
    places = keys.select(F.explode(F.array(*(F.shiftrightunsigned(keys.columns[0], shift).bitwiseAND(PLACES - 1) for shift in SHIFTS))).alias("place"))
    parts = places.select(F.shiftright("place", 6).alias("word"), F.expr("shiftleft(1L, cast(place & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    if not parts.num_rows:
        return None
    bits = np.zeros(PLACES >> 6, np.uint64)
    bits[parts.column("word").to_numpy()] = parts.column("bits").to_numpy().view(np.uint64)
    return bits


def _among(rows: DataFrame, column: str, numbers: DataFrame) -> DataFrame:
    """The rows that have one of the numbers (hashes: longs, none null) in a column, and few others: a bitmap tells, so that no row moves."""
    bits = _bitmap(numbers)
    asked = rows.sparkSession.sparkContext.broadcast(np.zeros(PLACES >> 6, np.uint64) if bits is None else bits)

    def among(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_marked(asked.value, batch.column(column).to_numpy().view(np.uint64)), pa.bool_()))

    return rows.mapInArrow(among, rows.schema)


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, a: int) -> int:
        while self.up[a] != a:
            self.up[a] = a = self.up[self.up[a]]
        return a

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def links_between(tokens: np.ndarray, doc: np.ndarray, sizes: np.ndarray, ask: np.ndarray, forest: Forest) -> list[tuple[int, int]]:
    """Compare the asking sets with all sets through an inverted list; the links that join two trees of the forest."""
    order = np.argsort(tokens, kind="stable")
    tokens, doc = tokens[order], doc[order]
    new = np.concatenate(([True], tokens[1:] != tokens[:-1])) if len(tokens) else np.zeros(0, bool)
    number = np.cumsum(new) - 1
    begin = np.append(np.flatnonzero(new), len(tokens))
    shared = np.diff(begin)[number] > 1 if len(tokens) else new
    by_doc = np.argsort(doc[shared], kind="stable")
    lists, owner = number[shared][by_doc], doc[shared][by_doc]
    bounds = np.searchsorted(owner, np.arange(len(sizes) + 1))
    links = []
    for a in ask.tolist():
        mine = lists[bounds[a] : bounds[a + 1]]
        long = begin[mine + 1] - begin[mine]
        at = np.arange(long.sum()) - np.repeat(np.cumsum(long) - long, long) + np.repeat(begin[mine], long)
        both = np.bincount(doc[at], minlength=len(sizes))
        for b in np.flatnonzero(100 * both >= PERCENT * (sizes + sizes[a] - both)).tolist():
            if a != b and forest.join(a, b):
                links.append((a, b))
    return links


def _compare(key, table):
    """One group: whole clusters, or a block of one. Sets that do not ask are only compared with those that do."""
    parts = [shingle_sets(b.column(0).cast(pa.binary()).to_pylist()) for b in slices(table.select(["text"]).to_batches(), limit=1 << 19)]
    tokens, sizes = np.concatenate([t for t, _ in parts]), np.concatenate([np.diff(b) for _, b in parts])
    begins = np.concatenate(([0], np.cumsum(sizes)))
    ids, cluster, part = table.column("doc_id").to_pylist(), table.column("cluster").to_numpy(), table.column("component").to_pylist()
    asks = table.column("asks").to_numpy()
    out: list[tuple[int, int]] = []
    order = np.argsort(cluster, kind="stable")
    for which in np.split(order, np.flatnonzero(np.diff(cluster[order])) + 1):
        own, doc = _chosen(tokens, begins, which)
        forest, names = Forest(len(which)), {}
        for k, w in enumerate(which.tolist()):
            forest.join(k, names.setdefault(part[w], k))
        for a, b in links_between(own, doc, sizes[which], np.flatnonzero(asks[which]), forest):
            out.append((ids[which[a]], ids[which[b]]))
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})


def _verified(members: DataFrame, docs: DataFrame) -> DataFrame:
    """Links among the members (doc_id, cluster, component, asks, bin) of each (cluster or -1, bin)."""
    rows = members.join(docs, "doc_id").select("doc_id", "cluster", "component", "asks", "grouped", "bin", "text")
    return rows.groupBy("grouped", "bin").applyInArrow(_compare, "a long, b long")


def near_duplicates(docs: DataFrame, block_docs: int = BLOCK_DOCS, block_tokens: int = BLOCK_TOKENS, few: tuple[int, int] = FEW, most_frequent: int = MOST) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach) of each row; a link is a similarity of PERCENT or more.

    1. Sets are summarised: size and digest; equal sets are one class from here on. Tokens that many sets share form the frequent class,
       a bounded table that only orders tokens; any such table gives the same components.
    2. Each set makes index keys (prefix_keys). Of a key that few sets share, pairs go on whose bitmaps don't rule out a link. Two sets that
       link have SPARE + 1 keys in common, so where all of these are keys of many, both sets have more than SPARE of those. Such sets are saved and make keys once
       more: their tokens are counted, sets with a key of many in common side by side; the frequent ones are put into a bitmap of bounded size, and of these combinations of one token
       more are keys. Only sets that share a key with many even there are tied in a star. What is so connected is a cluster; no link leaves it.
    3. Each class is compared inside its cluster. Small clusters share groups. A cluster beyond block_docs or block_tokens is dealt into
       blocks: first each block alone; then a few delegates of each component of the blocks; then whoever is not in the cluster's largest
       component makes keys once more, inside the cluster and for each pair of bands of sizes (band_keys), which sets that share a template
       but do not link have not in common; pairs of keys of few are compared. Whoever has a key of many even there is sent to all blocks.
       Nothing is left uncompared but pairs that are connected already.
    Null, empty and blank texts have no shingle and no link; a null doc_id has no component; rows that repeat an id are linked, as they are
    one document; an empty table gives no row; other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    seen = saved(docs.mapInArrow(_summaries, "doc_id long, n long, digest binary, token long, bits binary, label long"), "summaries")
    sets = seen.where("digest is not null")
    often = seen.where("token is not null").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "token").limit(most_frequent).collect()
    known = np.array([r[0] for r in often], np.int64).view(np.uint64)
    order = np.argsort(known)
    frequent = spark.sparkContext.broadcast((known[order], np.array([r[1] for r in often], np.int64)[order]))

    real = sets.where("n > 0 and doc_id is not null")
    classes = saved(real.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.max("n").alias("n"), F.max("label").alias("label")), "classes")
    several = classes.where("first < last").select("digest", "first")
    copies = saved(real.join(several, "digest").where("doc_id <> first").select(F.col("doc_id").alias("a"), F.col("first").alias("b")).distinct(), "copies")

    def pairs(docs: DataFrame, often, few: int, tie: bool) -> DataFrame:
        keys = docs.mapInArrow(_index(frequent, often), "key long, label long, n int")
        return saved(keys.repartition("key").sortWithinPartitions("key").mapInArrow(_paired(few, tie), "a long, b long, kind byte").distinct(), "pairs")

    named = docs.where("doc_id is not null")
    found, marks = pairs(named, None, few[0], False), None
    if (hot := _bitmap(found.where(F.col("kind") == MANY).select("a"))) is not None:
        crowded = saved(named.mapInArrow(_crowded(frequent, spark.sparkContext.broadcast(hot)), "near long, doc_id long, text string"), "crowded")
        # sets of one template are put side by side, so that their tokens are counted where they are
        crowded, together = crowded.select("doc_id", "text"), crowded.repartitionByRange("near", "doc_id").sortWithinPartitions("near", "doc_id").select("doc_id", "text")
        often = _bitmap(together.mapInArrow(_tokens, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") > few[0]).select("token"))
        marks = spark.sparkContext.broadcast(np.zeros(PLACES >> 6, np.uint64) if often is None else often)
        found = found.where(F.col("kind") == PAIR).union(pairs(crowded, marks, few[1], True))
    found = found.where(F.col("kind") != MANY)
    # sets' bitmaps are long: only those of sets in pairs move
    paired = _among(real, "label", found.select("a").union(found.select("b")))
    paired = saved(paired.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("n").alias("n"), F.max("bits").alias("bits"), F.max("label").alias("label")), "paired")
    side = lambda x: paired.select(F.col("label").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("first", "n", "bits")))
    some = found.where(F.col("kind") == PAIR).join(side("a"), "a").join(side("b"), "b")
    tied = found.where(F.col("kind") == TIE).join(side("a").select("a", "first_a"), "a").join(side("b").select("b", "first_b"), "b").select("first_a", "first_b")
    ties = some.mapInArrow(_possible, "a long, b long").union(tied)
    clusters = connected(ties.union(copies))
    heads = classes.select(F.col("first").alias("doc_id"), "n").groupBy("doc_id").agg(F.max("n").alias("n"))
    members = heads.join(clusters.select(F.col("node").alias("doc_id"), F.col("component").alias("cluster")), "doc_id")
    sizes = members.groupBy("cluster").agg(F.count("*").alias("docs"), F.sum("n").alias("tokens")).where("docs > 1")
    sizes = sizes.withColumn("blocks", F.greatest(F.ceil(F.col("docs") / block_docs), F.when(F.col("docs") > 2, F.ceil(F.col("tokens") / block_tokens)).otherwise(1)))
    members = saved(members.join(sizes, "cluster"), "members")
    hashed = F.xxhash64("doc_id").alias("hash")
    docs = saved(_among(docs.where("doc_id is not null").select("doc_id", "text", hashed), "hash", members.select(hashed)).select("doc_id", "text"), "texts")
    groups = members.where("blocks = 1").agg(F.sum("n").alias("n")).first()[0] or 0
    bins = max(1, -(-groups // min(block_tokens, GROUP_TOKENS)), -(-members.count() // block_docs))
    block = F.pmod(F.xxhash64("doc_id"), "blocks")
    small = F.col("blocks") == 1
    members = members.select("doc_id", "n", "cluster", "blocks", F.when(small, -1).otherwise(F.col("cluster")).alias("grouped"), F.when(small, F.pmod(F.xxhash64("cluster"), F.lit(bins))).otherwise(block).alias("bin"))
    alone = members.select("*", F.col("doc_id").alias("component"), F.lit(True).alias("asks"))
    found = connected(saved(_verified(alone, docs), "found").union(copies))
    # what is known are stars, so what is new is all that a later round has to work through
    joined = lambda found, new: connected(new.union(found.select("node", "component"))) if new.limit(1).count() else found

    # as many groups for so many documents and shingles, but no more than documents
    dealt = lambda docs, tokens: F.least(docs, F.greatest(F.ceil(docs / block_docs), F.when(docs > 2, F.ceil(tokens / block_tokens)).otherwise(1)))
    large = members.where("blocks > 1")
    if large.limit(1).count():
        parts = lambda found: saved(large.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id")), "parts")
        rank = F.row_number().over(W.partitionBy("cluster", "bin", "component").orderBy(F.xxhash64("doc_id")))
        some = parts(found).withColumn("rank", rank).where(F.col("rank") <= DELEGATES)
        fewer = some.groupBy("cluster").agg(dealt(F.count("*"), F.sum("n")).alias("fewer"))
        some = some.join(fewer, "cluster").withColumn("bin", F.pmod(F.xxhash64("doc_id", F.lit(1)), "fewer")).withColumn("asks", F.lit(True))
        found = joined(found, saved(_verified(some, docs), "delegates"))
        now = parts(found)
        counts = now.groupBy("cluster", "component").agg(F.count("*").alias("many"))
        main = counts.groupBy("cluster").agg(F.max(F.struct("many", "component")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
        now = saved(now.join(main.select("cluster", F.col("main.component").alias("main")), "cluster").withColumn("outside", F.expr("component <> main")), "outside")
        if now.limit(1).count():
            more, left = _across(now, docs, paired, frequent, marks, few[1])
            left = saved(now.join(left, "doc_id", "left_semi"), "asking")
            if left.limit(1).count():
                chunks = left.groupBy("cluster").agg(dealt(F.count("*"), F.sum("n")).alias("chunks"))
                bins = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
                asking = left.join(chunks, "cluster").withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.lit(2)), "chunks")).withColumn("bin", bins("blocks")).withColumn("asks", F.lit(True))
                everyone = now.join(chunks, "cluster").withColumn("chunk", bins("chunks")).withColumn("asks", F.lit(False))
                columns = ["doc_id", "cluster", "component", "asks", "grouped", F.struct("bin", "chunk").alias("bin")]
                more = more.union(saved(_verified(asking.select(columns).union(everyone.select(columns)), docs), "rest"))
            found = joined(found, more)

    final = found.withColumnRenamed("node", "doc_id")
    return sets.select("doc_id", F.col("n").alias("n_shingles")).join(final, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
