"""Benchmark decontamination by spaced seeds, on DataFrame functions alone."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import without

#: Which words of a window a seed reads: ignored places may hold other words. The first two find any one word replaced of eight, the last passages with every fifth word replaced.
MASKS = ("110111", "111011", "1011011", "1101011", "111100001")
SHORTEST = min(map(len, MASKS))
#: Words compared on either side of a seed's window, and the least number compared (or the whole item).
AROUND, LEAST = 4, 12
#: The share of the words compared that must be equal, by the least number of them: a few equal words in a row are common.
SHARES = ((11, 0.7), (10, 0.8), (0, 0.85))
#: Up to this many seeds of benchmark items are broadcast, each a row of at most some 240 bytes; up to so many bare seeds (8 bytes) filter the documents' seeds before a shuffle.
MOST_BROADCAST, MOST_FILTER = 100_000, 1_000_000


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the lower-cased runs of letters and digits of a text."""
    return F.transform(F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), ""), lambda w: F.xxhash64(w))


def _seed(words: Column, place: Column, number: int, mask: str) -> Column:
    return F.xxhash64(F.lit(number), *(F.get(words, place + k) for k, c in enumerate(mask) if c == "1"))


def _numbered(lengths: list[int]) -> list[tuple[int, str]]:
    """All masks with their numbers: MASKS, and one that reads every word for each length of items too short for those."""
    return [*enumerate(MASKS), *((-n, "1" * n) for n in lengths)]


def _keys(words: Column, place: Column, masks: list[tuple[int, str]]) -> Column:
    """The seed of every mask, null for one that does not fit the words from a place on. The mask's number is in the hash, so a seed alone is the key; no lambda works on it, which would copy the words for every place."""
    return F.array(*(F.when(place + len(m) <= F.size(words), _seed(words, place, n, m)) for n, m in masks))


def document_seeds(docs: DataFrame, masks: list[tuple[int, str]]) -> DataFrame:
    """docs (doc_id, own, doc_words), once for each window and mask, with doc_at and seed."""
    least = min(len(m) for _, m in masks)
    rows = docs.select("*", F.explode(F.when(F.size("doc_words") >= least, F.sequence(F.lit(0), F.size("doc_words") - least))).alias("doc_at"))
    return rows.select("*", F.explode(_keys(F.col("doc_words"), F.col("doc_at"), masks)).alias("seed")).where("seed is not null")


def item_seeds(items: DataFrame, masks: list[tuple[int, str]]) -> DataFrame:
    """item_id, n (its words), item_at, span, seed, and the words that are compared around a hit: near, from place near_at on. A short item has the one seed of all its words.

    A seed's row is cut out of the words before rows are multiplied: none carries its whole item.
    """
    words = F.col("item_words")

    def row(at: Column) -> Column:
        lo = F.greatest(F.lit(0), at - AROUND)
        one = lambda n, m: F.when(at + len(m) <= F.size(words), F.struct(at.alias("item_at"), F.lit(len(m)).alias("span"), _seed(words, at, n, m).alias("seed"), lo.alias("near_at"), F.slice(words, lo + 1, F.least(F.size(words), at + len(m) + AROUND) - lo).alias("near")))
        return F.array_compact(F.array(*(one(n, m) for n, m in masks if n >= 0)))

    long = F.when(F.size(words) >= SHORTEST, F.flatten(F.transform(F.sequence(F.lit(0), F.size(words) - SHORTEST), row)))
    whole = lambda n, m: F.when(F.size(words) == len(m), F.array(F.struct(F.lit(0).alias("item_at"), F.lit(len(m)).alias("span"), _seed(words, F.lit(0), n, m).alias("seed"), F.lit(0).alias("near_at"), words.alias("near"))))
    found = F.coalesce(long, *(whole(n, m) for n, m in masks if n < 0))
    return items.select("item_id", F.size(words).alias("n"), F.explode(found).alias("x")).select("item_id", "n", "x.*")


#: Words around a seed, at most.
NEAR = max(map(len, MASKS)) + 2 * AROUND


def _overlap(doc: str) -> Column:
    """Words compared and equal words around a hit, in the item's range, cut at the ends of either text. The few places are written out: with a lambda, every hit would be a row with its whole text."""
    at = F.col("doc_at") - F.col("item_at")
    lo, hi = F.greatest(F.col("near_at"), -at), F.least(F.col("near_at") + F.size("near"), F.size(doc) - at)
    same = [F.coalesce((F.get(doc, at + F.col("near_at") + k) == F.get("near", F.lit(k))).cast("int"), F.lit(0)) for k in range(NEAR)]
    return F.struct((hi - lo).alias("compared"), sum(same[1:], same[0]).alias("same"))


def contaminated(docs: DataFrame, benchmark: DataFrame, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """Documents that hold a passage of a benchmark item: doc_id, item_id, n_hits (seeds found), first_word, compared and same (of the best hit).

    Every window of every text is hashed under fixed masks that ignore some word positions, and joined with the windows of the items; a
    hit counts if a share of the words around it are equal (SHARES: the more, the fewer are compared), at least LEAST of them compared (or the whole item). Case and
    punctuation do not hide a passage, nor do replaced words: of items of 10 words or more of which a fifth is replaced, wherever, some
    0.93 and more are found (measured by length and rate in the tests); with every fifth word replaced, all from 10 words on; of 8 words, all with one replaced; of
    a part of an item, 12 unchanged words in a row. An item of fewer than six words is found only whole, its words in a row.

    The items' seeds are broadcast if they are few (their number follows from the items' sizes), each with the few words around it, so no text moves and what is
    broadcast is bounded in rows and in bytes, however long an item is; otherwise the documents' seeds are filtered by the items', if these are few
    enough to be broadcast bare, joined by a shuffle, and the hits' texts fetched by id and text. Null and empty texts match nothing; rows that
    repeat an id are one document, which has the hits of its different texts, each once; null ids are left out; an empty table gives no row; other columns are ignored, whatever their names.
    """
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("own"), word_hashes(F.col("text")).alias("doc_words"))
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), word_hashes(F.col("text")).alias("item_words"))
    sizes = items.select(F.size("item_words").alias("n")).where("n > 0").agg(F.sum(F.when(F.col("n") >= SHORTEST, F.col("n") * len(MASKS)).otherwise(1)), F.sort_array(F.collect_set(F.when(F.col("n") < SHORTEST, F.col("n"))))).first()
    many, masks = sizes[0] or 0, _numbered(sizes[1])
    known = item_seeds(items, masks)
    if many <= most_broadcast:
        hits = document_seeds(docs, masks).join(F.broadcast(known), "seed")
    else:
        found = document_seeds(docs, masks).drop("doc_words")
        if many <= MOST_FILTER:
            found = found.join(F.broadcast(known.select("seed").distinct()), "seed", "left_semi")
        hits = found.join(known, "seed").join(docs, ["doc_id", "own"])
    hits = hits.select("doc_id", "own", "item_id", "seed", "doc_at", "item_at", _overlap("doc_words").alias("o"), "n")
    # a hit of a text counts once, however many rows repeat that text under its id
    hits = hits.groupBy("doc_id", "item_id", "own", "seed", "doc_at", "item_at").agg(F.first("o").alias("o"), F.first("n").alias("n")).withColumn("first_word", F.col("doc_at") - F.col("item_at"))
    compared = F.col("o.compared")
    share = functools.reduce(lambda rest, s: F.when(compared >= s[0], s[1]).otherwise(rest), reversed(SHARES[:-1]), F.lit(SHARES[-1][1]))
    good = (F.col("o.same") >= share * compared) & (compared >= F.least(F.col("n"), F.lit(LEAST)))
    # counted under a condition: as a filter, the comparison would move into the join and run there for each of its uses
    found = hits.groupBy("doc_id", "item_id").agg(
        F.count(F.when(good, 1)).alias("n_hits"), F.min(F.when(good, F.col("first_word"))).cast("long").alias("first_word"),
        F.max(F.when(good, F.struct("o.same", (-F.col("o.compared")).alias("less")))).alias("best"),
    )
    return found.where("n_hits > 0").select("doc_id", "item_id", "n_hits", "first_word", (-F.col("best.less")).cast("long").alias("compared"), F.col("best.same").cast("long").alias("same"))


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated, all columns kept; rows with a null id stay, rows that repeat a contaminated id go. Only ids move while they are few."""
    return without(docs, contaminated(docs, benchmark).select("doc_id"))
