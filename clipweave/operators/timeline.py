"""Subtitles, frames, runs of equal labels, clip intervals and their overlaps."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions.text import CUE_TIMES, WHITE, is_silence, lines, parse_srt_time, path_stem, strip
from ..sources.shared import saved
from .ranks import matched, medians, placed


def parse_srt(texts: DataFrame) -> DataFrame:
    """file, cue_no, start_sec, end_sec, text of the cues of subtitle texts (file, text): a blank line or a line of times ends a cue, numbers on their own lines and tags go, cues without text too."""
    rows = texts.select("file", F.posexplode(lines(F.regexp_replace("text", "^\ufeff", ""))).alias("at", "line")).withColumn("line", strip(F.col("line")))
    timing = F.col("line").rlike(CUE_TIMES)
    order = Window.partitionBy("file").orderBy("at")
    rows = rows.withColumn("part", F.sum(F.when(timing | (F.col("line") == ""), 1).otherwise(0)).over(order))
    said = F.when(~timing & (F.col("line") != "") & ~F.col("line").rlike(r"(?U)^\d+$"), F.struct("at", "line"))
    cues = rows.groupBy("file", "part").agg(F.max(F.when(timing, F.col("line"))).alias("times"), F.sort_array(F.collect_list(said)).alias("said")).where("times is not null")
    text = F.trim(F.regexp_replace(F.regexp_replace(F.array_join(F.transform("said", lambda x: x["line"]), " "), r"<[^>]+>", " "), rf"(?U){WHITE}+", " "))
    cues = cues.select("file", "part", parse_srt_time(F.regexp_extract("times", CUE_TIMES, 1)).alias("start_sec"), parse_srt_time(F.regexp_extract("times", CUE_TIMES, 2)).alias("end_sec"), text.alias("text")).where("text <> ''")
    return cues.select("file", F.row_number().over(Window.partitionBy("file").orderBy("part")).cast("long").alias("cue_no"), "start_sec", "end_sec", "text")


_ODD_LETTERS = re.compile("[^0-9a-zа-я-]+")


@functools.lru_cache(1 << 16)
def _plain(token: str) -> str:
    """A token as it is compared."""
    return _ODD_LETTERS.sub("", token.lower().replace("ё", "е"))


def _plain_texts(texts: pa.Array) -> pa.Array:
    """Texts with all tokens as they are compared, a batch at once. Letters only go, so a text has as many tokens as before if none has become empty or joined to the next."""
    return pc.replace_substring_regex(pc.replace_substring(pc.utf8_lower(texts), "ё", "е"), r"[^0-9a-zа-я\s-]+", "")


#: Cues of at most so many tokens are compared end by end.
SHORT = 32


def overlap(before: list[str], now: list[str]) -> int:
    """Length of the longest start of now that ends before, in linear time: now's own starts and ends say how far a match that breaks off may go back. Of the few tokens of most cues, whole ends are compared."""
    tail = before[-len(now) :]
    if not tail or now[0] not in tail:
        return 0
    at = tail.index(now[0])
    if len(tail) <= SHORT:
        for i in range(at, len(tail)):
            if tail[i] == now[0] and tail[i:] == now[: len(tail) - i]:
                return len(tail) - i
        return 0
    tail = tail[at:]
    back, k = [0] * len(now), 0
    for i in range(1, len(tail)):
        while k and now[i] != now[k]:
            k = back[k - 1]
        k += now[i] == now[k]
        back[i] = k
    k = 0
    for token in tail:
        while k and token != now[k]:
            k = back[k - 1]
        k += token == now[k]
    return k


def collapse_rolling(cues: DataFrame, keys: list[str], order: str = "cue_no") -> DataFrame:
    """keys, text, n_tokens: cues one after the other, each without the longest start that ends the cue before it (by normalized tokens; tokens and cues that normalize to nothing are skipped).

    Cues are sorted by key and read in turn; a task remembers the cue before, and what is new of its key.
    """
    rows = cues.where(F.col("text").isNotNull()).select(*keys, order, "text").repartition(*keys).sortWithinPartitions(*keys, order)
    many = len(keys)
    fields = StructType([*rows.select(*keys).schema, StructField("text", StringType()), StructField("n_tokens", IntegerType())])

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, before, fresh, kinds, done = None, [], [], None, []

        def batch() -> pa.RecordBatch:
            columns = [pa.array([d[k] for d in done], t) for k, t in enumerate(kinds)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([" ".join(d[many]) for d in done], pa.string()), pa.array([len(d[many]) for d in done], pa.int32())], names=fields.names)

        for given in batches:
            kinds = kinds or [c.type for c in given.columns[:many]]
            own = list(zip(*(c.to_pylist() for c in given.columns[:many])))
            for key, text, said in zip(own, given.column(many + 1).to_pylist(), _plain_texts(given.column(many + 1)).to_pylist()):
                if key != now:
                    if fresh:
                        done.append((*now, fresh))
                        if len(done) >= 1000 or sum(len(d[many]) for d in done[-1:]) > 100_000:
                            yield batch()
                            done = []
                    now, before, fresh = key, [], []
                tokens, plain = text.split(), said.split()
                if len(tokens) != len(plain):  # some normalize to nothing, or white space that is kept here went there
                    plain = list(map(_plain, tokens))
                    tokens, plain = [t for t, p in zip(tokens, plain) if p], [p for p in plain if p]
                if plain:
                    fresh += tokens[overlap(before, plain) :]
                    before = plain
        if fresh:
            done.append((*now, fresh))
        if done:
            yield batch()

    return rows.mapInArrow(collapse, fields)


def chunk_cues(cues: DataFrame, keys: list[str], total: str, chunk_sec: int = 300, min_text_tokens: int = 20, order: str = "cue_no", max_sec: float | None = None) -> DataFrame:
    """keys, chunk_idx, chunk_id (<last key>_partNNN, from 1), text, n_tokens: cues by the chunk that holds their middle, collapsed; chunks with few tokens go.

    total: column with the video's length; with max_sec only so much of a video's start counts.
    """
    middle = (F.col("start_sec") + F.col("end_sec")) / 2
    ends = F.col(total) if max_sec is None else F.least(F.col(total), F.lit(max_sec))
    rows = cues.withColumn("chunk_idx", F.floor(middle / chunk_sec).cast("int")).where((middle < ends) & (middle >= 0))
    chunks = collapse_rolling(rows, [*keys, "chunk_idx"], order).where(F.col("n_tokens") >= min_text_tokens)
    return chunks.select(*keys, "chunk_idx", F.format_string("%s_part%03d", F.col(keys[-1]).cast("string"), F.col("chunk_idx") + 1).alias("chunk_id"), "text", "n_tokens")


def intervals_to_frames(intervals: DataFrame, fps: Column) -> DataFrame:
    """video, frame_idx, label for every frame from int(start * fps) to before int(end * fps); an empty label is silence."""
    first, last = F.floor(F.col("start_sec") * fps), F.floor(F.col("end_sec") * fps)
    label = F.when(strip(F.coalesce("label", F.lit(""))) == "", "<silence:>").otherwise(F.col("label"))
    rows = intervals.withColumn("first", first).withColumn("last", last).where("last > first")
    return rows.select("video", F.explode(F.sequence("first", F.col("last") - 1)).alias("frame_idx"), label.alias("label"))


def runs_from_intervals(intervals: DataFrame, fps: Column) -> DataFrame:
    """video, word, start_frame, end_frame of label_runs without making frames: neighbouring intervals with one label and adjacent frames are merged."""
    label = F.when(strip(F.coalesce("label", F.lit(""))) == "", "<silence:>").otherwise(F.col("label"))
    rows = intervals.select("video", label.alias("word"), F.floor(F.col("start_sec") * fps).alias("first"), (F.floor(F.col("end_sec") * fps) - 1).alias("last")).where("last >= first")
    order = Window.partitionBy("video").orderBy("first")
    new = F.coalesce((F.lag("word").over(order) != F.col("word")) | (F.lag("last").over(order) + 1 != F.col("first")), F.lit(True))
    rows = rows.withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(order))
    return rows.groupBy("video", "run", "word").agg(F.min("first").alias("start_frame"), F.max("last").alias("end_frame")).drop("run").where(~is_silence(F.col("word")))


def label_runs(frames: DataFrame, min_frames: int = 1, part_frames: int = 1 << 16) -> DataFrame:
    """video, seg_idx, word, start_frame, end_frame (both within) of runs of equal labels that are not silent and have min_frames or more, numbered from 1 in each video.

    Runs are made in parts of part_frames of a video, so a long video is many tasks; runs that meet at a border are merged afterwards.
    """
    part = ["video", "_part"]
    order = Window.partitionBy(*part).orderBy("frame_idx")
    new = F.coalesce(F.lag("label").over(order) != F.col("label"), F.lit(True)).cast("int")
    runs = frames.withColumn("_part", F.floor(F.col("frame_idx") / part_frames)).withColumn("new", new).withColumn("run", F.sum("new").over(order))
    runs = runs.groupBy(*part, "run").agg(F.first("label").alias("word"), F.min("frame_idx").alias("start_frame"), F.max("frame_idx").alias("end_frame"))
    order = Window.partitionBy("video").orderBy("start_frame")
    new = F.coalesce(F.lag("word").over(order) != F.col("word"), F.lit(True)).cast("int")
    runs = runs.withColumn("new", new).withColumn("run", F.sum("new").over(order))
    runs = runs.groupBy("video", "run").agg(F.first("word").alias("word"), F.min("start_frame").alias("start_frame"), F.max("end_frame").alias("end_frame"))
    runs = runs.where(~is_silence(F.col("word")) & (F.col("end_frame") - F.col("start_frame") + 1 >= min_frames))
    return runs.select("video", F.row_number().over(order).cast("long").alias("seg_idx"), "word", "start_frame", "end_frame")


def _padded(fps: Column, pad_frames: Column, start_pad: Column, end_pad: Column) -> tuple[Column, Column]:
    """Seconds of a segment's start (not before 0) and end after padding by frames and by seconds."""
    start = F.greatest(F.lit(0.0), (F.col("start_frame") - pad_frames) / fps - start_pad)
    return start, (F.col("end_frame") + 1 + pad_frames) / fps + end_pad


def _manifest_seconds(rows: DataFrame) -> DataFrame:
    """start_sec and end_sec as a manifest has them, with three decimals."""
    return rows.withColumns({c: F.bround(c, 3).cast("decimal(12,3)") for c in ("start_sec", "end_sec")})


def clip_intervals(segments: DataFrame, fps: float | Column, pad_frames: int = 0, start_pad: float = 0.0, end_pad: float = 0.0, max_source_sec: float | None = None, max_duration_sec: float | None = None, limit: int | None = None) -> DataFrame:
    """Segments with start_sec and end_sec after padding, not before 0; those that end too late or last too long go, and of the rest the first ``limit`` of each video stay. fps may be a column."""
    start, end = _padded(F.lit(fps).cast("double") if not isinstance(fps, Column) else fps, F.lit(pad_frames), F.lit(start_pad), F.lit(end_pad))
    rows = segments.withColumns({"start_sec": start, "end_sec": end})
    if max_source_sec is not None:
        rows = rows.where(F.col("end_sec") <= max_source_sec)
    if max_duration_sec is not None:
        rows = rows.where(F.col("end_sec") - F.col("start_sec") <= max_duration_sec)
    rank = F.row_number().over(Window.partitionBy("video").orderBy("seg_idx"))
    rows = rows if limit is None else rows.withColumn("rank", rank).where(F.col("rank") <= limit).drop("rank")
    return _manifest_seconds(rows)


def clip_intervals_batch(segments: DataFrame, videos: DataFrame, vocab: DataFrame, pad_frames: int = 3, start_pad: float = 0.20, end_pad: float = 0.30, max_duration_sec: float = 2.0) -> DataFrame:
    """Padded clips of vocabulary words, inside their videos (video, fps, duration_sec), of a positive length up to the maximum; numbers are those before any filter."""
    rows = segments.join(vocab.select("word"), "word", "left_semi").join(videos.select("video", "fps", "duration_sec"), "video")
    start, end = _padded(F.col("fps"), F.lit(pad_frames), F.lit(start_pad), F.lit(end_pad))
    rows = rows.select("video", "seg_idx", "word", "start_frame", "end_frame", start.alias("start_sec"), F.least("duration_sec", end).alias("end_sec"))
    return _manifest_seconds(rows.where((F.col("end_sec") > F.col("start_sec")) & (F.col("end_sec") - F.col("start_sec") <= max_duration_sec)))


def overlap_pairs(manifest: DataFrame, width: float, by: tuple[str, ...] = ("source_video",)) -> DataFrame:
    """Pairs of clips of different words in one source_video that overlap, in seconds; a is the earlier by (start_sec, end_sec, clip_file).

    Clips are compared inside time bins: the earlier clip is put into every bin that it covers, the later only into the bin of its
    start, so each pair meets once, and a long video is many keys. width: about the longest clip, for then a clip covers two bins.
    """
    place = lambda x: F.floor(F.col(x) / width).cast("long")
    own = ("word", "clip_file", "start_sec", "end_sec")
    left = manifest.select(*by, "speaker_id", *(F.col(c).alias(f"{c}_a") for c in own), F.explode(F.sequence(place("start_sec"), place("end_sec"))).alias("bin"))
    right = manifest.select(*by, *(F.col(c).alias(f"{c}_b") for c in own), place("start_sec").alias("bin"))
    a, b = (F.struct(*(F.col(f"{c}_{s}").alias(c) for c in ("start_sec", "end_sec", "clip_file"))) for s in "ab")
    rows = left.join(right, [*by, "bin"]).where((a < b) & (F.col("start_sec_b") < F.col("end_sec_a")) & (F.col("word_a") != F.col("word_b")))
    begins, ends = F.greatest("start_sec_a", "start_sec_b"), F.least("end_sec_a", "end_sec_b")
    long_a, long_b = F.col("end_sec_a") - F.col("start_sec_a"), F.col("end_sec_b") - F.col("start_sec_b")
    share = (ends - begins).cast("double") / F.least(long_a, long_b).cast("double")
    return rows.where(ends > begins).select(
        *by, "speaker_id", "word_a", "word_b", path_stem(F.col("clip_file_a")).alias("clip_id_a"), path_stem(F.col("clip_file_b")).alias("clip_id_b"), "clip_file_a", "clip_file_b",
        "start_sec_a", "end_sec_a", "start_sec_b", "end_sec_b", *(x.cast("decimal(12,3)").alias(n) for n, x in (("duration_sec_a", long_a), ("duration_sec_b", long_b), ("overlap_sec", ends - begins))),
        F.round(share, 6).alias("overlap_ratio_shorter"), begins.alias("overlap_start_sec"), ends.alias("overlap_end_sec"),
    )


def overlap_summary(pairs: DataFrame, long_sec: float = 0.20, width: float = 0.05) -> DataFrame:
    """By speaker (null: all): pairs, median and largest overlap, pairs that overlap at least long_sec and at least half of the shorter. width: of the bins that find the median.

    The pairs are made once: counts by speaker and overlap are saved, and both levels are sums over these.
    """
    counted = pairs.groupBy("speaker_id", "overlap_sec").agg(F.count("*").alias("n"), F.count_if(F.col("overlap_ratio_shorter") >= 0.5).alias("half"))
    both = F.explode(F.array(F.struct(F.lit(1).alias("all_speakers"), F.lit(None).cast("string").alias("speaker_id")), F.struct(F.lit(0).alias("all_speakers"), F.col("speaker_id").alias("speaker_id"))))
    rows = saved(counted, "overlaps").select(both.alias("x"), "overlap_sec", "n", "half").select("x.*", "overlap_sec", "n", "half")
    keys = ["all_speakers", "speaker_id"]
    sums = rows.groupBy(*keys).agg(F.sum("n").alias("pairs"), F.max("overlap_sec").alias("max_overlap_sec"), F.sum(F.when(F.col("overlap_sec") >= long_sec, F.col("n")).otherwise(0)).alias("long_pairs"), F.sum("half").alias("half_pairs"))
    return matched(sums, medians(rows, "overlap_sec", keys, width, "n"), keys).withColumn("median_overlap_sec", F.round("median", 6)).drop("median")


def timing_variants(segments: DataFrame, variants: DataFrame, fps: float, width: float = 2.0, max_duration_sec: float | None = None) -> DataFrame:
    """By variant (variant, pad_frames, start_pad, end_pad; a small table): clips, their median and mean seconds, clips of half a second or more, and overlapping pairs of different words."""
    start, end = _padded(F.lit(float(fps)), F.col("pad_frames"), F.col("start_pad"), F.col("end_pad"))
    rows = saved(segments.select("video", "seg_idx", "word", "start_frame", "end_frame"), "segments").join(F.broadcast(variants)).withColumns({"start_sec": start, "end_sec": end})
    if max_duration_sec is not None:
        rows = rows.where(F.col("end_sec") - F.col("start_sec") <= max_duration_sec)
    rows = _manifest_seconds(rows).select("variant", F.col("video").alias("source_video"), "word", F.format_string("%s_%06d.mp4", "video", "seg_idx").alias("clip_file"), F.lit("").alias("speaker_id"), "start_sec", "end_sec")
    counted = saved(rows.groupBy("variant", (F.col("end_sec") - F.col("start_sec")).alias("sec")).agg(F.count("*").alias("n")), "lengths")
    many = F.sum("n")
    sums = counted.groupBy("variant").agg(many.alias("clips"), F.round(F.sum(F.col("sec").cast("double") * F.col("n")) / many, 6).alias("mean_sec"), F.sum(F.when(F.col("sec") >= 0.5, F.col("n")).otherwise(0)).alias("half_second"))
    pairs = overlap_pairs(rows, width, by=("variant", "source_video")).groupBy("variant").agg(F.count("*").alias("overlap_pairs"))
    sums = sums.join(medians(counted, "sec", ["variant"], 0.05, "n"), "variant").join(pairs, "variant", "left")
    return sums.select("variant", "clips", F.round("median", 6).alias("median_sec"), "mean_sec", "half_second", F.coalesce("overlap_pairs", F.lit(0)).alias("overlap_pairs"))


def review_sample(pairs: DataFrame, n: int) -> DataFrame:
    """n pairs for review, numbered: of each speaker in turn an equal number of the largest overlaps, then the rest in the order of speaker and overlap.

    Only the first n pairs of a speaker can be among them; these are saved, so the pairs are made once.
    """
    order = ["speaker_id", F.desc("overlap_sec"), "source_video", *(f"{c}_{s}" for s in "ab" for c in ("start_sec", "end_sec", "clip_file"))]
    ranked = saved(pairs.withColumn("_rank", F.row_number().over(Window.partitionBy("speaker_id").orderBy(*order))).where(F.col("_rank") <= n), "ranked")
    share = max(1, n // max(1, ranked.where("_rank = 1").count()))
    order = [F.desc(F.col("_rank") <= share), *order]
    few = ranked.orderBy(*order).limit(n)
    return few.select(F.row_number().over(Window.orderBy(*order)).cast("long").alias("review_no"), *pairs.columns, F.lit("pending").alias("review_status"), F.lit("").alias("notes"))


def frame_samples(n: Column, k: int = 24, mode: str = "even") -> Column:
    """Frame numbers of a clip of n frames: ``even``, k from 0 to n - 1 at equal distances, cut to whole numbers; ``three``, first, middle and last; ``five``, with the thirds too.

    Three and five are ascending without repeats; a clip without frames has none (of five, 0).
    """
    if mode == "even":
        return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (n - 1) / (k - 1)))
    whole = lambda x: F.floor(x).cast("long")
    last = F.greatest(F.lit(0), n - 1).cast("long")
    places = {"three": [whole(n / 2)], "five": [whole(n / 3), whole(n / 2), whole(2 * n / 3)]}[mode]
    found = F.array_sort(F.array_distinct(F.array(F.lit(0).cast("long"), *places, last)))
    return F.when(n > 0, found).otherwise(F.array().cast("array<long>") if mode == "three" else F.array(F.lit(0).cast("long")))


def filled_up(frames: Column, k: int) -> Column:
    """frames, its last value repeated until there are k; an empty array stays empty."""
    return F.when(F.size(frames) > 0, F.concat(frames, F.array_repeat(F.element_at(frames, -1), F.greatest(F.lit(0), k - F.size(frames))))).otherwise(frames)


def frame_geometry(points: DataFrame, left_eye: list[int], right_eye: list[int], lips: list[int], least_eye: float = 8.0) -> DataFrame:
    """clip_id, frame_idx, cx, cy, side, angle from landmarks (point_id, x, y): the lips' centre, the crop's side and the eyes' slope; null where the eyes are too near."""
    mean = lambda c, ids: F.avg(F.when(F.col("point_id").isin(ids), F.col(c)))
    of = lambda f, c: f(F.when(F.col("point_id").isin(lips), F.col(c)))
    rows = points.groupBy("clip_id", "frame_idx").agg(
        mean("x", left_eye).alias("lx"), mean("y", left_eye).alias("ly"), mean("x", right_eye).alias("rx"), mean("y", right_eye).alias("ry"), mean("x", lips).alias("cx"), mean("y", lips).alias("cy"),
        (of(F.max, "x") - of(F.min, "x")).alias("w"), (of(F.max, "y") - of(F.min, "y")).alias("h"),
    )
    eye = F.sqrt(F.pow(F.col("rx") - F.col("lx"), 2) + F.pow(F.col("ry") - F.col("ly"), 2))
    turned = F.col("lx") > F.col("rx")
    dx, dy = (F.when(turned, F.col(f"l{c}") - F.col(f"r{c}")).otherwise(F.col(f"r{c}") - F.col(f"l{c}")) for c in "xy")
    ok = eye >= least_eye
    side = F.greatest(1.30 * eye, 1.75 * F.col("w"), 3.00 * F.col("h"))
    return rows.select("clip_id", "frame_idx", *(F.when(ok, c).alias(n) for n, c in (("cx", F.col("cx")), ("cy", F.col("cy")), ("side", side), ("angle", F.degrees(F.atan2(dy, dx))))))


def interpolate_gaps(rows: DataFrame, key: str, order: str, columns: list[str], part_rows: int = 1 << 16) -> DataFrame:
    """Nulls filled on a straight line between the values around, or with the nearest value at the ends; keys without any value go. Rows whose order is null are not filled from others.

    Values are looked for inside parts of ``part_rows`` of the order, so a long key is many tasks; each part's first and last known values are handed
    on to the parts around it.
    """
    part = [key, "_part"]
    rows = rows.withColumn("_part", F.floor(F.col(order) / part_rows))
    pair = {c: F.when(F.col(c).isNotNull() & F.col(order).isNotNull(), F.struct(F.col(order).alias("at"), F.col(c).alias("v"))) for c in columns}
    ends = rows.groupBy(*part).agg(*(f(pair[c]).alias(f"{c}{s}") for c in columns for s, f in (("_1", F.min), ("_0", F.max))))
    parts = Window.partitionBy(key).orderBy("_part")
    past, later = parts.rowsBetween(Window.unboundedPreceding, -1), parts.rowsBetween(1, Window.unboundedFollowing)
    around = [x for c in columns for x in (F.last(f"{c}_0", ignorenulls=True).over(past).alias(f"_{c}_0"), F.first(f"{c}_1", ignorenulls=True).over(later).alias(f"_{c}_1"))]
    out = matched(rows, ends.select(*part, *around), part)
    inside = Window.partitionBy(*part).orderBy(order)
    back, ahead = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(0, Window.unboundedFollowing)
    out = out.withColumns({n: x for c in columns for n, x in ((f"{c}_0", F.coalesce(F.last(pair[c], ignorenulls=True).over(back), f"_{c}_0")), (f"{c}_1", F.coalesce(F.first(pair[c], ignorenulls=True).over(ahead), f"_{c}_1")))})
    for c in columns:
        a, b = F.col(f"{c}_0"), F.col(f"{c}_1")
        share = (F.col(order) - a["at"]) / F.nullif(b["at"] - a["at"], F.lit(0))
        value = F.coalesce(F.col(c), a["v"] + (b["v"] - a["v"]) * share, a["v"], b["v"])
        out = out.withColumn(c, value).drop(f"{c}_0", f"{c}_1", f"_{c}_0", f"_{c}_1")
    return out.drop("_part").where(F.col(columns[0]).isNotNull())


def rolling_median(rows: DataFrame, key: str, order: str, columns: list[str], radius: int = 2, part_rows: int = 1 << 16) -> DataFrame:
    """Each value replaced by the median of the values of up to radius rows on either side and its own.

    A key is cut into parts of ``part_rows`` rows, each with copies of the radius rows before and after it, so a long key is many tasks.
    """
    if part_rows < radius:
        raise ValueError("a part must hold the rows that it hands on")
    rows = placed(rows, key, order, part_rows)
    own, inside = F.floor(F.col("_at") / part_rows), F.col("_at") % part_rows
    parts = F.array_compact(F.array(own, F.when((inside < radius) & (own > 0), own - 1), F.when(inside >= part_rows - radius, own + 1)))
    w = Window.partitionBy(key, "_part").orderBy("_at").rowsBetween(-radius, radius)
    found = rows.withColumn("_part", F.explode(parts)).withColumns({c: F.percentile(c, F.lit(0.5)).over(w) for c in columns})
    return found.where(F.col("_part") == F.floor(F.col("_at") / part_rows)).drop("_part", "_at")


def detection_gate(geometry: DataFrame, least: float = 0.70, part_rows: int = 1 << 16) -> DataFrame:
    """By clip: frames, detected frames, their share, and a status; of clips that pass also the frames to fill and the mean side after filling and smoothing.

    The exact share decides; it is tested before anything else, so a clip without any hit is of a low share unless least is 0.
    """
    total, hits = F.col("total_frames"), F.col("landmark_frames")
    rows = geometry.groupBy("clip_id").agg(F.count("frame_idx").alias("total_frames"), F.count("cx").alias("landmark_frames"))
    smooth = rolling_median(interpolate_gaps(geometry.select("clip_id", "frame_idx", "side"), "clip_id", "frame_idx", ["side"], part_rows), "clip_id", "frame_idx", ["side"], part_rows=part_rows)
    share = F.coalesce(F.try_divide(hits, total), F.lit(0.0))
    status = F.when(total == 0, "no_frames").when(share < least, "low_detection_ratio").when(hits == 0, "no_landmarks").otherwise("ok")
    rows = rows.join(smooth.groupBy("clip_id").agg(F.avg("side").alias("side")), "clip_id", "left").withColumn("landmark_status", status)
    ok = F.col("landmark_status") == "ok"
    return rows.select(
        "clip_id", "total_frames", "landmark_frames", F.round(share, 4).alias("landmark_detection_ratio"), "landmark_status",
        F.when(ok, total - hits).alias("interpolated_frames"), F.when(ok, F.round("side", 2)).alias("mean_crop_side_px"),
    )


def mouth_boxes(detections: DataFrame, dims: DataFrame, fallback: bool = False) -> DataFrame:
    """clip_id, x0, y0, x1, y1, status: the lower face of the largest detection of a clip (the first of equals), inside the picture; with fallback, else a box below the picture's middle.

    Every size and place is cut to whole numbers before the box is cut at the picture's edges; a box without an area is bad and has no corners.
    """
    best = detections.where("w * h > 0").groupBy("clip_id").agg(F.max_by(F.struct("x", "y", "w", "h"), F.struct((F.col("w") * F.col("h")).alias("area"), (-F.col("sample_no")).alias("s"), (-F.col("det_no")).alias("d"))).alias("box"))
    rows = dims.join(best, "clip_id", "left")
    found, b = F.col("box").isNotNull(), F.col("box")
    wide, high = F.col("width"), F.col("height")
    short, whole = F.least(wide, high), lambda x: x.cast("int")
    # fixed values: the mouth's part of a face, and of a picture without one
    face = {"x": whole(b["x"] + 0.12 * b["w"]), "y": whole(b["y"] + 0.55 * b["h"]), "w": whole(0.76 * b["w"]), "h": whole(0.38 * b["h"])}
    lower = {"x": F.floor((wide - whole(short * 0.55)) / 2).cast("int"), "y": whole(high * 0.52), "w": whole(short * 0.55), "h": whole(short * 0.35)}
    rows = rows.withColumns({f"_{k}": F.when(found, face[k]).when(F.lit(fallback), lower[k]) for k in "xywh"})
    rows = rows.withColumns({"x0": F.greatest(F.lit(0), "_x"), "y0": F.greatest(F.lit(0), "_y"), "x1": F.least(wide, F.col("_x") + F.col("_w")), "y1": F.least(high, F.col("_y") + F.col("_h"))})
    seen = found | F.lit(fallback)
    bad = (F.col("x1") <= F.col("x0")) | (F.col("y1") <= F.col("y0"))
    status = F.when(~seen, "no_face").when(bad, "bad_crop_box").when(found, "face_mouth_crop").otherwise("fallback_lower_center_crop")
    return rows.select("clip_id", *(F.when(seen & ~bad, F.col(c)).cast("int").alias(c) for c in ("x0", "y0", "x1", "y1")), status.alias("status"))
