"""Joins, checks and counts on labels and quality measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_path, strip, unsafe_path

# Flags for which clips are dropped unless others are named, and columns that a split must have.
DROP = ["no_face_detected", "very_dark", "very_bright", "too_few_frames", "too_short", "too_long", "missing"]
REQUIRED = ["clip_id", "clip_path", "word", "speaker_id", "start_sec", "end_sec"]


def load_vocab(rows: DataFrame, column: str = "word") -> DataFrame:
    plain = F.translate(F.lower(strip(F.col(column))), "ё", "е")
    return rows.select(plain.alias("word")).where("word <> ''").distinct()


def map_phonemes(labels: DataFrame, keys: DataFrame, to_keys: bool) -> DataFrame:
    """Labels with ``mapped``: the dictionary's key, or the symbol itself; a pause is p!; with keys other tags are p! too; ``unknown`` marks the rest."""
    rows = labels.join(keys.select(F.col("symbol").alias("label"), "key"), "label", "left")
    tag = F.col("label").rlike("^<.*>$")
    if to_keys:
        mapped = F.coalesce(F.col("key"), F.when(tag, "p!"))
    else:
        mapped = F.when(F.col("label") == "<p:>", "p!").when(F.col("key").isNotNull() | tag, F.col("label"))
    return rows.withColumn("mapped", mapped).withColumn("unknown", F.col("mapped").isNull()).drop("key")


def map_prefix(rows: DataFrame, prefixes: dict[str, str], path: str) -> DataFrame:
    """rows with mapped_path: the path with its prefix (whole path components) replaced, null if no prefix fits; of several the longest. No row moves: the few prefixes are one expression."""
    value, mapped = F.col(path), F.lit(None).cast("string")
    for prefix in sorted(prefixes, key=len):
        fits = (value == prefix) | value.startswith(f"{prefix}/")
        mapped = F.when(fits, F.concat(F.lit(prefixes[prefix]), F.substring(value, F.lit(len(prefix) + 1), F.length(value)))).otherwise(mapped)
    return rows.withColumn("mapped_path", mapped)


def map_prefix_table(rows: DataFrame, prefixes: DataFrame, path: str) -> DataFrame:
    """rows with mapped_path by a table (prefix, target) of any size: the path with its longest prefix of whole components replaced, null if none fits; of a prefix's targets the least. Null paths stay, with null.

    Each different path is looked up once: it stands for itself and each of its parents, which are joined with the table by equality, and the
    longest that is found is joined back.
    """
    known = prefixes.where("prefix is not null and target is not null").groupBy("prefix").agg(F.min("target").alias("target"))
    paths = rows.select(F.col(path).alias("_path")).where("_path is not null").distinct()
    parts = F.split("_path", "/")
    starts = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    found = paths.select("_path", F.explode(starts).alias("prefix")).join(known, "prefix")
    best = found.groupBy("_path").agg(F.max(F.struct(F.length("prefix").alias("long"), "target")).alias("b"))
    mapped = best.select("_path", F.concat("b.target", F.expr("substring(_path, b.long + 1)")).alias("mapped_path"))
    return rows.join(mapped, rows[path] == F.col("_path"), "left").drop("_path")


def mapped_share(rows: DataFrame, mapped: Column, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Rows, how many are mapped, and their share: of each group, in one pass."""
    sums = rows.groupBy(*by).agg(F.count("*").alias("rows"), F.count_if(mapped).alias("mapped"))
    return sums.withColumn("share", F.round(F.try_divide(F.col("mapped").cast("double"), F.col("rows").cast("double")), 6))


def exclude_videos(jobs: DataFrame, excluded: DataFrame, speaker: str | None = None, video: str | None = None, limit: int | None = None, order: tuple[str, ...] = ("speaker_id", "video_dir")) -> DataFrame:
    """Jobs whose (speaker_id, video_dir) is not listed with the status excluded; of these only a speaker's or a video's, and of what is left the first limit by order."""
    gone = excluded.where(F.lower(strip(F.col("status"))) == "excluded").select(strip(F.col("speaker_id")).alias("speaker_id"), strip(F.col("video_dir")).alias("video_dir"))
    # of a named speaker or video no others are read
    for column, value in (("speaker_id", speaker), ("video_dir", video)):
        jobs = jobs if value is None else jobs.where(F.col(column) == value)
    jobs = jobs.join(gone, ["speaker_id", "video_dir"], "left_anti")
    return jobs if limit is None or limit < 0 else jobs.orderBy(*order).limit(limit)


def manual_reject(labels: DataFrame, bad: DataFrame) -> DataFrame:
    """labels with ``removed``: whether the list names the clip by path or by id; empty entries name nothing."""
    paths = bad.select(normalize_path(F.col("clip_path")).alias("_path")).where("_path <> ''").distinct().withColumn("_by_path", F.lit(True))
    ids = bad.select(strip(F.col("clip_id")).alias("_id")).where("_id <> ''").distinct().withColumn("_by_id", F.lit(True))
    rows = labels.withColumn("_path", normalize_path(F.col("clip_path"))).withColumn("_id", strip(F.col("clip_id"))).join(paths, "_path", "left").join(ids, "_id", "left")
    return rows.withColumn("removed", F.coalesce("_by_path", "_by_id", F.lit(False))).drop("_path", "_id", "_by_path", "_by_id")


def reject_reasons(bad: DataFrame) -> DataFrame:
    """How often each reason is given, once for a listed path and once for a listed id."""
    named = F.filter(F.array(normalize_path(F.col("clip_path")), strip(F.col("clip_id"))), lambda x: x != "")
    reason = F.when(strip(F.coalesce("reason", F.lit(""))) == "", "unspecified").otherwise(strip(F.col("reason")))
    return bad.select(reason.alias("reason"), F.explode(named)).groupBy("reason").count().withColumnRenamed("count", "n")


def quality_flags(m: DataFrame) -> DataFrame:
    """Measurements with duration_sec, reason (missing, unreadable or empty) and flags: too few frames, too short or long, dark, bright, no face.

    A clip whose file does not exist (column ``exists``, if there is one) has the one flag missing; an unreadable one (``ok`` false) has none.
    """
    duration = F.when(F.col("fps") > 0, F.col("frame_count") / F.col("fps")).otherwise(0.0)
    there = F.col("exists") if "exists" in m.columns else F.lit(True)
    flag = lambda cond, name: F.when(cond, name)
    flags = F.array_compact(F.array(
        flag(F.col("frame_count") < 5, "too_few_frames"), flag(F.col("duration_sec") < 0.18, "too_short"), flag(F.col("duration_sec") > 2.5, "too_long"),
        flag(F.col("brightness") < 15, "very_dark"), flag(F.col("brightness") > 245, "very_bright"), flag(F.col("face_sample_hits") == 0, "no_face_detected"),
    ))
    rows = m.withColumn("duration_sec", duration).withColumn("reason", F.when(~there, "missing").when(~F.col("ok"), "unreadable").otherwise(""))
    return rows.withColumn("flags", F.when(F.col("reason") == "missing", F.array(F.lit("missing"))).when(F.col("reason") == "", flags))


def drop_flagged(labels: DataFrame, quality: DataFrame, flags: list[str] = DROP) -> DataFrame:
    bad = quality.where(F.arrays_overlap("flags", F.array(*map(F.lit, flags)))).select("clip_id").distinct()
    return labels.join(bad, "clip_id", "left_anti")


def quality_report(q: DataFrame) -> DataFrame:
    """kind, name, n, value: counts of clips, readable ones, ones with a face, and by flag, speaker and word, in one pass; the least, greatest and mean duration of readable clips (n: how many) as values."""
    readable = F.col("reason") == ""
    fact = lambda kind, name: F.struct(F.lit(kind).alias("kind"), name.alias("name"))
    facts = F.array(
        fact("all", F.lit("clips")), F.when(readable, fact("all", F.lit("readable"))), F.when(readable & (F.col("face_sample_hits") > 0), fact("all", F.lit("with_face"))),
        fact("speaker", F.col("speaker_id")), fact("word", F.col("word")),
    )
    flagged = F.transform(F.coalesce("flags", F.array().cast("array<string>")), lambda f: fact("flag", f))
    rows = q.select(F.explode(F.concat(F.array_compact(facts), flagged)).alias("x"), F.when(readable, F.col("duration_sec")).alias("sec")).select("x.kind", "x.name", "sec")
    counts = rows.groupBy("kind", "name").agg(F.count("*").alias("n"), F.min("sec").alias("min"), F.max("sec").alias("max"), F.avg("sec").alias("avg"))
    # the durations of all readable clips are those of one of the counted groups
    values = F.array(F.struct("kind", "name", F.lit(None).cast("double").alias("value")), *(F.struct(F.lit("duration").alias("kind"), F.lit(f).alias("name"), F.round(f, 6).alias("value")) for f in ("min", "max", "avg")))
    also = (F.col("kind") == "all") & (F.col("name") == "readable")
    return counts.select("n", F.explode(F.when(also, values).otherwise(F.slice(values, 1, 1))).alias("x")).select("x.kind", "x.name", "n", "x.value")


def flagged_review(q: DataFrame, k: int, order: str) -> DataFrame:
    """The first k flagged clips, or the first k clips if none is flagged."""
    flagged = q.where(F.size("flags") > 0)
    some = flagged.limit(1).agg((F.count("*") > 0).alias("any"))
    return q.join(F.broadcast(some)).where(~F.col("any") | (F.size("flags") > 0)).orderBy(order).limit(k).drop("any")


def missing_files(labels: DataFrame, listing: DataFrame) -> DataFrame:
    return labels.withColumn("_path", normalize_path(F.col("clip_path"))).join(listing.select(normalize_path(F.col("path")).alias("_path")).distinct(), "_path", "left_anti").drop("_path")


def pick_files(listing: DataFrame, preferred: list[str], otherwise: str = "only") -> DataFrame:
    """dir, file: of each directory the first preferred name; else its only file, or with otherwise="first" the first by name; else none.

    A preferred name may hold ``{id}``, which stands for the listing's column ``id`` (the video's id, by which files are named).
    """
    names = [F.replace(F.lit(p), F.lit("{id}"), F.col("id").cast("string")) if "{id}" in p else F.lit(p) for p in preferred]
    rank = F.coalesce(F.nullif(F.array_position(F.array(*names), F.col("file")), F.lit(0)), F.lit(len(preferred) + 1))
    rows = listing.withColumn("_rank", rank).groupBy("dir").agg(F.min(F.struct(F.col("_rank").alias("rank"), "file")).alias("best"), F.min("file").alias("low"), F.max("file").alias("high"))
    named = F.col("best.rank") <= len(preferred)
    return rows.where(named | (F.col("low") == F.col("high")) | F.lit(otherwise == "first")).select("dir", F.when(named, F.col("best.file")).otherwise(F.col("low")).alias("file"))


def pending_jobs(jobs: DataFrame, done: DataFrame, keys: list[str], overwrite: bool = False) -> DataFrame:
    return jobs if overwrite else jobs.join(done.select(*keys).distinct(), keys, "left_anti")


def align_features(labels: DataFrame, features: DataFrame, dim: int, array: str = "embedding") -> DataFrame:
    """clip_id, problem: labels without features, features without labels, other words, other widths, values that are not finite."""
    rows = labels.select("clip_id", "word", F.lit(True).alias("l")).join(features.select("clip_id", F.col("word").alias("own"), array, F.lit(True).alias("f")), "clip_id", "full_outer")
    wrong = F.exists(array, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    problems = F.array_compact(F.array(
        F.when(F.col("f").isNull(), "missing"), F.when(F.col("l").isNull(), "extra"), F.when(F.col("word") != F.col("own"), "label_mismatch"),
        F.when(F.size(array) != dim, "wrong_dimension"), F.when(wrong, "non_finite"),
    ))
    return rows.select("clip_id", F.explode(problems).alias("problem"))


def label_warnings(rows: DataFrame, least: int = 15) -> DataFrame:
    counts = rows.groupBy("word").agg(F.count("*").alias("clips"), F.count_distinct("speaker_id").alias("speakers"))
    return counts.withColumn("few_clips", F.col("clips") < least).withColumn("one_speaker", F.col("speakers") == 1).where("few_clips or one_speaker")


def coverage_gates(rows: DataFrame, most_share: float = 0.30, least_word: int = 100, least_group: int = 5) -> DataFrame:
    """One row: the largest speaker's share, words and groups (speaker, word) below their limits, and whether all gates pass."""
    groups = rows.groupBy("speaker_id", "word").count()
    speakers = groups.groupBy("speaker_id").agg(F.sum("count").alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("all"))
    words = groups.groupBy("word").agg(F.sum("count").alias("n")).agg(F.count_if(F.col("n") < least_word).alias("few_words"))
    small = groups.agg(F.count_if(F.col("count") < least_group).alias("small_groups"))
    share = F.round(F.col("most") / F.col("all"), 6)
    return speakers.join(F.broadcast(words)).join(F.broadcast(small)).select(share.alias("largest_share"), "few_words", "small_groups", ((share <= most_share) & (F.col("few_words") == 0) & (F.col("small_groups") == 0)).alias("passed"))


def split_audit(rows: DataFrame) -> DataFrame:
    return rows.groupBy("split").agg(
        F.count("*").alias("clips"), F.count_distinct("speaker_id").alias("speakers"), F.count_distinct("word").alias("words"), (F.count("clip_id") - F.count_distinct("clip_id")).alias("repeated_ids"),
        (F.count("clip_path") - F.count_distinct("clip_path")).alias("repeated_paths"), F.count_if(F.col("end_sec") <= F.col("start_sec")).alias("bad_intervals"), F.count_if(F.col("landmark_detection_ratio") < 0.7).alias("low_ratio"),
        F.round(F.min("landmark_detection_ratio"), 6).alias("min_ratio"), F.round(F.avg("landmark_detection_ratio"), 6).alias("mean_ratio"), F.round(F.max("landmark_detection_ratio"), 6).alias("max_ratio"),
        F.round(F.min(F.col("end_sec") - F.col("start_sec")), 6).alias("min_duration"), F.round(F.avg(F.col("end_sec") - F.col("start_sec")), 6).alias("mean_duration"), F.round(F.max(F.col("end_sec") - F.col("start_sec")), 6).alias("max_duration"), F.count_if(F.col("interpolated_frames") > 0).alias("interpolated"),
    )


def validate_labels(rows: DataFrame, order: str, vocab: DataFrame | None = None, listing: DataFrame | None = None) -> DataFrame:
    """line, clip_id, problem of each label row: an empty id (nothing more is said of it), a repeated one, a missing file, an unknown word, bad times. line counts the header; ids, paths and words are read without white space around them."""
    out = rows.withColumns({c: strip(F.col(c)) for c in ("clip_id", "clip_path", "word")})
    first = out.where("clip_id <> ''").groupBy("clip_id").agg(F.min(order).alias("first"), F.count("*").alias("many")).where("many > 1").select("clip_id", "first")
    out = out.join(first, "clip_id", "left").withColumn("again", F.col(order) > F.col("first"))
    out = out.join(vocab.select("word", F.lit(True).alias("known")).distinct(), "word", "left") if vocab is not None else out.withColumn("known", F.lit(True))
    out = out.join(listing.select(F.col("path").alias("clip_path"), F.lit(True).alias("there")).distinct(), "clip_path", "left") if listing is not None else out.withColumn("there", F.lit(True))
    start, end = F.col("start_sec").try_cast("double"), F.col("end_sec").try_cast("double")
    problems = F.when(F.col("clip_id") == "", F.array(F.lit("empty_id"))).otherwise(F.array_compact(F.array(
        F.when(F.col("again"), "repeated_id"), F.when(F.col("there").isNull(), "missing_file"), F.when(F.col("known").isNull(), "unknown_word"),
        F.when(start.isNull() | end.isNull(), "not_a_number").when(end <= start, "end_before_start"),
    )))
    return out.select((F.col(order) + 2).alias("line"), "clip_id", F.explode(problems).alias("problem"))


def split_preflight(rows: DataFrame, vocab: DataFrame, listing: DataFrame, required: list[str] = REQUIRED) -> DataFrame:
    """rule, violations: one row for each rule of a split that is broken; a required column that is missing is one (missing_<column>), and the rules that read it are not tested."""
    has = lambda *names: set(names) <= set(rows.columns)
    missing = [c for c in required if c not in rows.columns]
    rules = {"empty": F.when(F.count("*") == 0, 1).otherwise(0), **{f"missing_{c}": F.lit(1) for c in missing}}
    if has("clip_id"):
        rules["unique_id"] = F.count("*") - F.count_distinct("clip_id")
    if has("clip_path"):
        rules["unique_path"] = F.count("*") - F.count_distinct("clip_path")
    if has("start_sec", "end_sec"):
        rules["positive_interval"] = F.count_if(F.col("end_sec") <= F.col("start_sec"))
    out = rows.agg(*(v.cast("long").alias(k) for k, v in rules.items())).unpivot([], [*rules], "rule", "violations")
    counted = lambda df, rule: df.agg(F.lit(rule).alias("rule"), F.count("*").alias("violations"))
    if has("word"):
        out = out.union(counted(rows.join(vocab, "word", "left_anti"), "known_word")).union(counted(vocab.join(rows, "word", "left_anti"), "vocabulary_used"))
    if has("clip_path"):
        out = out.union(counted(rows.join(listing.select(F.col("path").alias("clip_path")), "clip_path", "left_anti"), "file_exists"))
    return out.where("violations > 0")


def raw_source_map(labels: DataFrame, chunks: DataFrame) -> DataFrame:
    """clip_id, chunk_id from the clip's name, and whether that chunk of the speaker exists."""
    chunk = F.regexp_extract("clip_path", r"([^/]+_part\d{3})_\d{6}\.[^./]+$", 1)
    rows = labels.select("clip_id", "speaker_id", F.nullif(chunk, F.lit("")).alias("chunk_id"))
    return rows.join(chunks.select("speaker_id", "chunk_id", F.lit(True).alias("there")).distinct(), ["speaker_id", "chunk_id"], "left").withColumn("mapped", F.coalesce("there", F.lit(False))).drop("there")


def package_manifest(rows: DataFrame, listing: DataFrame, splits: list[str], root: str) -> DataFrame:
    """Distinct clip paths of the splits, sorted, with their names in an archive, in how many rows of each split they stand (in_<split>), and whether they are unsafe or missing."""
    paths = rows.where(F.col("split").isin(splits)).groupBy("clip_path").agg(*(F.count_if(F.col("split") == s).alias(f"in_{s}") for s in splits))
    paths = paths.join(listing.select(F.col("path").alias("clip_path"), F.lit(True).alias("there")).distinct(), "clip_path", "left")
    return paths.select("clip_path", F.concat(F.lit(f"{root}/"), "clip_path").alias("archive_name"), *(f"in_{s}" for s in splits), unsafe_path(F.col("clip_path")).alias("unsafe"), F.col("there").isNull().alias("missing")).orderBy("clip_path")


def package_counts(manifest: DataFrame, splits: list[str]) -> DataFrame:
    """One row on a manifest: unique clips, rows by split, unsafe and missing clips."""
    return manifest.agg(F.count("*").alias("clips"), *(F.coalesce(F.sum(f"in_{s}"), F.lit(0)).alias(s) for s in splits), F.count_if(F.col("unsafe")).alias("unsafe"), F.count_if(F.col("missing")).alias("missing"))


def conflicting_duplicates(rows: DataFrame, content: Column, word: str = "word") -> DataFrame:
    """fingerprint, clips, classes of equal contents that stand under several classes. The content is reduced to its digest before it moves."""
    return rows.select(F.sha2(content, 256).alias("fingerprint"), word).groupBy("fingerprint").agg(F.count("*").alias("clips"), F.count_distinct(word).alias("classes")).where("classes > 1")


def feature_audit(rows: DataFrame, content: Column, motion: Column, spread: Column, word: str, class_id: str, vocab: DataFrame) -> DataFrame:
    """One row on a table of feature arrays: whether every word's class in the vocabulary (word, class_id) is the row's, contents under several classes, clips without motion, clips without variance, and whether all checks passed."""
    known = vocab.select(F.col("word").alias(word), F.col("class_id").alias("_class")).distinct()
    sums = rows.select(word, class_id, motion.alias("_motion"), spread.alias("_spread")).join(known, word, "left").agg(
        F.coalesce(F.bool_and(F.col(class_id).eqNullSafe(F.col("_class"))), F.lit(True)).alias("round_trip_ok"), F.count_if(F.col("_motion") <= 0).alias("zero_motion"), F.count_if(F.col("_spread") <= 0).alias("zero_variance"),
    )
    twice = conflicting_duplicates(rows, content, class_id).agg(F.count("*").alias("conflicting_duplicates"))
    passed = F.col("round_trip_ok") & (F.col("conflicting_duplicates") == 0) & (F.col("zero_motion") == 0) & (F.col("zero_variance") == 0)
    return sums.crossJoin(twice).withColumn("passed", passed)
