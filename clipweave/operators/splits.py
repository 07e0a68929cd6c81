"""Vocabularies, splits, folds, samples and what they leak."""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import detect_source
from .ranks import numbered, numbered_all


def build_vocab(rows: DataFrame, word: str = "word") -> DataFrame:
    """word, class_id by the words' order; only distinct words are brought together."""
    return rows.select(F.col(word).alias("word")).distinct().select((F.row_number().over(Window.orderBy("word")) - 1).cast("long").alias("class_id"), "word")


def build_labels(inventory: DataFrame, least: float = 0.001, prefix: str = "ru_", default_source: str = "self_recorded") -> DataFrame:
    """Labels of an inventory (word, speaker_id, file, path, duration_sec) with running ids over the order (word, speaker_id, file, path): six digits at least.

    Rows are numbered by ranges of that order, so a word of one speaker may be many tasks.
    """
    rows = numbered_all(inventory, ["word", "speaker_id", "file", "path"])
    seconds = F.bround(F.greatest("duration_sec", F.lit(least)), 3).cast("decimal(12,3)")
    return rows.select(F.concat(F.lit(prefix), F.format_string("%06d", F.col("_row"))).alias("clip_id"), F.col("path").alias("clip_path"), "word", "speaker_id", detect_source(F.col("file"), default_source).alias("source"), F.lit(0).cast("decimal(12,3)").alias("start_sec"), seconds.alias("end_sec"))


def top_words(rows: DataFrame, n: int, order: str) -> DataFrame:
    """The n most frequent words, of equals the one that comes first."""
    return rows.groupBy("word").agg(F.count("*").alias("n"), F.min(order).alias("first")).orderBy(F.desc("n"), "first").limit(n)


def speaker_split(rows: DataFrame, sets: dict[str, list[str]], exclude: list[str] = [], top: int | None = None, order: str = "clip_id") -> DataFrame:  # noqa: B006
    """rows with the split whose set holds their speaker; other rows go; a speaker of two sets raises.

    First the rows of excluded speakers go (none left raises); with top, then those of all but the most frequent words of what is left
    (of equals the one that comes first by order), whatever sets their speakers are in.
    """
    pairs = [(s, name) for name, speakers in sets.items() for s in speakers]
    if len({s for s, _ in pairs}) < len(pairs):
        raise ValueError("a speaker is in several sets")
    if exclude:
        rows = rows.where(F.col("speaker_id").isNull() | ~F.col("speaker_id").isin(exclude))
        if not rows.limit(1).count():
            raise ValueError("no rows are left without the excluded speakers")
    if top is not None:
        rows = rows.join(top_words(rows, top, order).select("word"), "word", "left_semi")
    table = rows.sparkSession.createDataFrame(pairs, "speaker_id string, split string")
    return rows.join(F.broadcast(table), "speaker_id")


def seeded(seed: int, *keys: str) -> Column:
    """A hash that orders rows at random, in the same way on any cluster."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *keys))


def stratified_split(rows: DataFrame, seed: int, train: float = 0.8, val: float = 0.1, key: str = "clip_id", word: str = "word") -> DataFrame:
    """rows with a split of exact sizes for each word: rounded shares, at least one row each for train and (of three or more) val, the rest test. A frequent word is many tasks."""
    ranked, count = numbered(rows, [word], seeded(seed, key), [key]), F.col("_n")
    first = F.greatest(F.lit(1), F.bround(count * train).cast("int"))
    second = F.when(count >= 3, F.greatest(F.lit(1), F.bround(count * val).cast("int"))).otherwise(0)
    full = first + second >= count
    n_train = F.when(full, F.greatest(F.lit(1), count - 2)).otherwise(first)
    n_val = F.when(full, F.when(count > 2, 1).otherwise(0)).otherwise(second)
    split = F.when(F.col("_rank") <= n_train, "train").when(F.col("_rank") <= n_train + n_val, "val").otherwise("test")
    return ranked.withColumn("split", split).drop("_n", "_rank")


def round_robin_sample(rows: DataFrame, n: int, keys: list[str], seed: int, key: str = "clip_id", by_name: bool = False) -> DataFrame:
    """n rows, one of each group in turn; inside a group, and unless by_name among the groups, at random."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(seeded(seed, key), key))
    order = [F.col(k) for k in keys] if by_name else [seeded(seed, *keys), *keys]
    return rows.withColumn("_turn", rank).where(F.col("_turn") <= n).orderBy("_turn", *order).limit(n).drop("_turn")


def sample_weights(rows: DataFrame, strategy: str) -> DataFrame:
    """rows with weight: uniform, word (1 / count), inverse and sqrt (of the count of speaker and word)."""
    groups = rows.groupBy("speaker_id", "word").agg(F.count("*").alias("_n"))
    if strategy == "uniform":
        return rows.withColumn("weight", F.lit(1.0))
    if strategy == "word":
        groups = groups.groupBy("word").agg(F.sum("_n").alias("_n"))
    of = ["word"] if strategy == "word" else ["speaker_id", "word"]
    n = F.col("_n").cast("double")
    return rows.join(groups, of).withColumn("weight", {"word": 1 / n, "inverse": 1 / n, "sqrt": 1 / F.sqrt(n)}[strategy]).drop("_n")


def _drawn(totals: dict[int, int], seed: int, weight: int, part: int, columns: list[int], chunk: int):
    """For a task's rows, sorted by part: those that are drawn, with how often (times) and how many draws of the part come before.

    Inside a part the draws go to chunks of rows in turn, each by its share of the weight that is left, and in a chunk to its rows; so a
    part is never held, and what is drawn depends on the seed and the rows' order alone.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, left, rng, before = None, None, 0, None, 0

        def draw(table: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal left, rest, before
            w = table.column(weight).to_numpy().astype(np.float64)
            many = left if last else rng.binomial(left, min(1.0, w.sum() / rest)) if rest > 0 else 0
            times = rng.multinomial(many, w / w.sum()) if many and w.sum() > 0 else np.zeros(len(w), np.int64)
            left, rest = left - many, rest - w.sum()
            at = np.flatnonzero(times)
            if len(at):
                first = before + np.cumsum(times[at]) - times[at]
                before += int(times.sum())
                out = table.select(columns).take(pa.array(at)).append_column("_part", table.column(part).take(pa.array(at))).append_column("_times", pa.array(times[at])).append_column("_first", pa.array(first))
                yield from out.to_batches()

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            while held is not None and (held.num_rows > chunk or last and held.num_rows):
                yield from draw(held.slice(0, chunk), last and held.num_rows <= chunk)
                held = held.slice(chunk)

        rest = 0.0
        for batch in batches:
            parts = batch.column(part).to_numpy()
            for a, b in zip(cuts := [0, *(np.flatnonzero(np.diff(parts)) + 1)], [*cuts[1:], len(parts)]):
                if a == b:
                    continue
                if parts[a] != now:
                    yield from flush(True)
                    now, held, before = int(parts[a]), None, 0
                    left, rest = totals.get(now, (0, 0.0))
                    rng = np.random.default_rng([seed, now])
                piece = pa.Table.from_batches([batch.slice(a, b - a)])
                held = piece if held is None else pa.concat_tables([held, piece])
                yield from flush(False)
        yield from flush(True)

    return rows


#: Rows are dealt out by hash into at most so many parts of about so many rows.
MOST_PARTS, PART_ROWS = 4096, 1 << 15


def weighted_draw(rows: DataFrame, n: int, seed: int, strategy: str = "inverse", key: str = "clip_id", part_rows: int = PART_ROWS, chunk: int = 4096) -> DataFrame:
    """n draws with replacement: a group by its weight, then a row of it at random; draw is the draw's number, in no order of rows.

    Nothing is joined to a drawn row. Rows are dealt out into parts by a hash of their key; the draws are dealt out to the parts by their
    sums of weights (a multinomial of at most MOST_PARTS numbers, all that the driver sees), and in each part to its rows. A drawn row is then
    repeated in place, in pieces, so one that is drawn a million times is no key of anything. The draws follow from seed and keys (which
    must be unique), on any cluster.
    """
    hashed = F.md5(F.concat_ws("|", F.lit(f"{seed}-row"), F.col(key).cast("string")))
    # exact sums, so that the order of adding does not show
    weight = F.col("weight").cast("decimal(30,18)")
    dealt = sample_weights(rows, strategy).withColumns({"_hash": hashed, "_part": F.conv(F.substring(hashed, 1, 8), 16, 10).cast("long") % MOST_PARTS, "_weight": weight}).drop("weight")
    found = dealt.groupBy("_part").agg(F.sum("_weight"), F.count("*")).collect()
    parts = min(MOST_PARTS, 1 << max(0, math.ceil(math.log2(max(1, sum(r[2] for r in found)) / part_rows))))
    exact: dict[int, Decimal] = {}
    for part, total, _ in found:
        exact[part % parts] = exact.get(part % parts, 0) + total
    sums = {p: float(w) for p, w in exact.items()}
    whole = sum(sums[p] for p in sorted(sums))
    counts = np.random.default_rng(seed).multinomial(n, [sums.get(p, 0.0) / whole for p in range(parts)]) if whole else np.zeros(parts, int)
    totals = {p: (int(counts[p]), w) for p, w in sums.items()}
    dealt = dealt.withColumn("_part", F.col("_part") % parts)
    moved = dealt.select(*rows.columns, "_part", "_hash", F.col("_weight").cast("double").alias("_weight")).repartition("_part").sortWithinPartitions("_part", "_hash", key)
    places = [moved.columns.index(c) for c in ("_weight", "_part")]
    schema = moved.select(*rows.columns).schema.add("_part", "long").add("_times", "long").add("_first", "long")
    drawn = moved.mapInArrow(_drawn(totals, seed, *places, [*range(len(rows.columns))], chunk), schema)
    step = F.lit(10_000)
    pieces = drawn.withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(_times - 1) div 10000"))))
    each = pieces.withColumn("_k", F.explode(F.sequence(F.col("_piece") * step, F.least((F.col("_piece") + 1) * step, F.col("_times")) - 1)))
    start = F.get(F.array(*(F.lit(v).cast("long") for v in (np.cumsum(counts) - counts).tolist())), F.col("_part").cast("int"))
    # a permutation of 0 .. n - 1 in place of a sort
    a = next(x for x in range(int(n * 0.618) | 1, n * 2 + 3) if math.gcd(x, n) == 1) if n else 1
    number = F.pmod((start + F.col("_first") + F.col("_k")).cast("decimal(19,0)") * F.lit(a).cast("decimal(19,0)") + F.lit(seed % max(1, n)).cast("decimal(19,0)"), F.lit(max(1, n)).cast("decimal(19,0)")).cast("long")
    return each.select(number.alias("draw"), *rows.columns)


def loo_membership(rows: DataFrame, conditions: dict[str, list[str]]) -> DataFrame:
    """rows, each once, with what it is in the folds that hold out one speaker each: out_of (the speaker in whose fold it does not train), validates (whether it validates there: originals do), trains_in (the settings whose training sets have its condition).

    A fold's membership follows from these by loo_fold; no row stands once for each fold. conditions: by setting the conditions that it
    trains on, as ``{"flipped": ["original", "hflip"]}``.
    """
    trains = F.array_compact(F.array(*(F.when(F.col("condition").isin(own), F.lit(name)) for name, own in conditions.items())))
    return rows.withColumns({"out_of": F.col("speaker_id"), "validates": F.col("condition") == "original", "trains_in": trains})


def loo_fold(members: DataFrame, speaker: str, setting: str, part: str | None = None) -> DataFrame:
    """The rows of one fold (or of one part of it) with their part: the speaker's originals validate, all others' rows of the setting's conditions train.

    It is a filter; of a table saved by out_of (save_folds) only the folders of the part are read. Rows without a speaker train.
    """
    own = F.col("out_of").eqNullSafe(speaker)
    validation, train = (F.col("out_of") == speaker) & F.col("validates"), ~own & F.array_contains("trains_in", setting)
    rows = members.where({"validation": validation, "train": train, None: validation | train}[part])
    return rows.withColumn("part", F.when(own, "validation").otherwise("train"))


def loo_folds(rows: DataFrame, speakers: DataFrame) -> DataFrame:
    """Membership in each held-out speaker's fold: originals of that speaker validate, all other rows (condition tells copies) train.

    The result has every row once for each fold by its nature; for sizes use loo_fold_sizes, for membership loo_membership, and name few speakers here.
    """
    held = rows.join(speakers.select(F.col("speaker_id").alias("fold_speaker")))
    own = F.col("speaker_id") == F.col("fold_speaker")
    part = F.when(own & (F.col("condition") == "original"), "validation").when(~own, "train")
    return held.withColumn("part", part).where(F.col("part").isNotNull())


def loo_fold_sizes(rows: DataFrame) -> DataFrame:
    """fold_speaker, part, n: how many rows loo_folds gives, parts without any left out. Rows are counted by speaker; a fold trains on all rows but its speaker's."""
    counts = rows.groupBy("speaker_id").agg(F.count("*").alias("own"), F.count_if(F.col("condition") == "original").alias("originals"))
    sizes = counts.crossJoin(counts.agg(F.sum("own").alias("all")))
    parts = F.array(*(F.struct(F.lit(p).alias("part"), n.alias("n")) for p, n in (("train", F.col("all") - F.col("own")), ("validation", F.col("originals")))))
    return sizes.select(F.col("speaker_id").alias("fold_speaker"), F.explode(parts).alias("x")).select("fold_speaker", "x.part", "x.n").where("n > 0")


def keep_first(tables: list[DataFrame]) -> DataFrame:
    """All tables' rows under all their columns; of rows with one clip_id (or, without it, clip_path) that of the first table, then by path."""
    all_rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [t.withColumn("_from", F.lit(k)) for k, t in enumerate(tables)])
    key = F.coalesce(F.nullif(F.col("clip_id"), F.lit("")), "clip_path")
    return all_rows.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy("_from", "clip_path"))).where("_rank = 1").drop("_rank", "_from")


def split_leakage(rows: DataFrame, keys: list[str]) -> DataFrame:
    """key, value, splits of values that stand in several splits."""
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys)))
    return rows.select("split", pairs.alias("x")).select("split", "x.key", "x.value").distinct().groupBy("key", "value").agg(F.array_join(F.sort_array(F.collect_list("split")), ",").alias("splits"), F.count("*").alias("n")).where("n > 1").drop("n")


def version_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """By split: clips added, removed and unchanged between two versions, and whether nothing changed."""
    sides = [t.select("split", "clip_id").distinct().withColumn(s, F.lit(True)) for t, s in ((old, "a"), (new, "b"))]
    rows = sides[0].join(sides[1], ["split", "clip_id"], "full_outer")
    a, b = F.col("a").isNotNull(), F.col("b").isNotNull()
    counts = rows.groupBy("split").agg(F.count_if(~a).alias("added"), F.count_if(~b).alias("removed"), F.count_if(a & b).alias("unchanged"))
    return counts.withColumn("equal", (F.col("added") == 0) & (F.col("removed") == 0))


def describe_splits(rows: DataFrame) -> DataFrame:
    """split, kind, name, clips, words, speakers: of each split, and of its speakers and words."""
    sets = rows.groupingSets([["split"], ["split", "speaker_id"], ["split", "word"]], "split", "speaker_id", "word")
    out = sets.agg(F.count("*").alias("clips"), F.grouping("speaker_id").alias("gs"), F.grouping("word").alias("gw"))
    by = rows.groupBy("split").agg(F.count_distinct("word").alias("words"), F.count_distinct("speaker_id").alias("speakers"))
    kind = F.when(F.col("gs") == 0, "speaker").when(F.col("gw") == 0, "word").otherwise("split")
    out = out.select("split", kind.alias("kind"), F.when(F.col("gs") == 0, F.col("speaker_id")).when(F.col("gw") == 0, F.col("word")).otherwise(F.col("split")).alias("name"), "clips").join(by, "split")
    whole = F.col("kind") == "split"
    return out.select("split", "kind", "name", "clips", F.when(whole, F.col("words")).alias("words"), F.when(whole, F.col("speakers")).alias("speakers"))


def speaker_word_crosstab(rows: DataFrame, words: list[str]) -> DataFrame:
    return rows.groupBy("speaker_id").pivot("word", words).count().na.fill(0)


def word_distribution(rows: DataFrame, vocab: DataFrame, splits: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    counts = rows.groupBy("word").agg(*(F.count_if(F.col("split") == s).alias(s) for s in splits))
    return vocab.join(counts, "word", "left").select("word", *(F.coalesce(s, F.lit(0)).alias(s) for s in splits))


def majority_baseline(rows: DataFrame) -> DataFrame:
    """By split the most frequent word (of equals the first) and its share."""
    counts = rows.groupBy("split", "word").agg(F.count("*").alias("n"))
    best = counts.groupBy("split").agg(F.min(F.struct((-F.col("n")).alias("less"), "word")).alias("best"), F.sum("n").alias("all"))
    return best.select("split", "best.word", F.round(-F.col("best.less") / F.col("all"), 6).alias("share"))


def variant_counts(rows: DataFrame, variants: dict[str, list[str]]) -> DataFrame:
    """By named set of speakers: clips, speakers, groups of speaker and word."""
    table = rows.sparkSession.createDataFrame([(v, s) for v, ss in variants.items() for s in ss], "variant string, speaker_id string")
    groups = rows.groupBy("speaker_id", "word").agg(F.count("*").alias("n")).join(F.broadcast(table), "speaker_id")
    return groups.groupBy("variant").agg(F.sum("n").alias("clips"), F.count_distinct("speaker_id").alias("speakers"), F.count("*").alias("groups"))


def class_weights(rows: DataFrame, vocab: DataFrame) -> DataFrame:
    """1 / count of each vocabulary word that occurs, over the mean of these."""
    counts = rows.join(vocab, "word", "left_semi").groupBy("word").agg((1 / F.count("*")).alias("w"))
    mean = counts.agg(F.avg("w").alias("mean"))
    return counts.join(F.broadcast(mean)).select("word", F.round(F.col("w") / F.col("mean"), 6).alias("weight"))
