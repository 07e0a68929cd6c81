"""Reading and writing the files around the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import path_name, path_parent, path_suffix, strip

LABELS = ["clip_id", "clip_path", "word", "speaker_id", "source", "start_sec", "end_sec"]
# Endings of media files.
MEDIA = (".mp4", ".mov", ".avi", ".mkv", ".webm")


def read_labels(spark: SparkSession, path: str, required: list[str] = LABELS, exact: bool = False) -> DataFrame:
    """A CSV with a header, all columns strings but the seconds; a byte order mark is dropped; a missing column, or with exact any other header, raises."""
    rows = spark.read.option("header", True).option("inferSchema", False).csv(path)
    rows = rows.toDF(*(c.lstrip("﻿") for c in rows.columns))
    if exact and rows.columns != required:
        raise ValueError(f"{path} has columns {rows.columns}, not {required}")
    if missing := [c for c in required if c not in rows.columns]:
        raise ValueError(f"{path} lacks columns {missing}")
    return rows.withColumns({c: F.col(c).try_cast("decimal(12,3)") for c in ("start_sec", "end_sec") if c in rows.columns})


#: Letters of the one-byte encoding that stand for bytes over 127, in the order of these.
_CYRILLIC = bytes(range(128, 256)).decode("cp1251", errors="replace")


def write_frame_labels(rows: DataFrame, path: str) -> None:
    """video, frame_idx, label as text files for ``read_frame_labels(by_line=True)``: ``video<tab>label`` lines in the frames' order, many videos to a file, so that files grow with the bytes and not with the videos.

    A video's name is form-encoded, a missing one is empty (and an empty one is read as missing). A missing label has no tab. A label with a line break raises.
    """
    label = F.when(F.contains("label", F.lit("\n")), F.raise_error(F.concat(F.lit("a label has a line break: "), "label")).cast("string")).otherwise(F.col("label"))
    line = F.concat_ws("\t", F.coalesce(F.url_encode("video"), F.lit("")), label)
    rows.repartition("video").sortWithinPartitions("video", "frame_idx").select(line.alias("value")).write.text(path)


def read_frame_labels(spark: SparkSession, glob: str, by_folder: bool = False, by_line: bool = False) -> DataFrame:
    """video, frame_idx, label of files with one label a line, in UTF-8 (a byte order mark is dropped) or, if any line of a file is none, cp1251. A file's name is the video's, or with by_folder its folder's (after ``video=``).

    With by_line a file has many videos, and each line its video's name before the label, as ``write_frame_labels`` writes them. A video's
    lines must stand together, or this raises; those in several files follow in the order of the files' paths.

    Files are read in splits, so a long one is many tasks. A row's id tells its place in its task; each split's first id, its lines (with
    by_line: by video) and whether they are UTF-8 are counted, and added up by file or video: only these few numbers meet. An empty file has no row.
    """
    # bytes are kept as they are until it is known what they mean
    text = F.regexp_replace("value", r"\r\z", "")
    rows = spark.read.option("lineSep", "\n").text(glob).select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.col("value").alias("_raw"), text.alias("value"), F.monotonically_increasing_id().alias("_id"))
    keys, whole, place = ["_file", "_start"], ["_file"], ["_start"]
    if by_line:
        rows = rows.withColumn("_name", F.btrim(F.substring_index("_raw", "\t", 1), F.lit("\ufeff\r")))
        keys, whole, place = [*keys, "_name"], ["_name"], ["_file", "_start"]
    splits = rows.groupBy(*keys).agg(F.min("_id").alias("_first"), F.max("_id").alias("_last"), F.count("*").alias("_n"), F.bool_and(F.is_valid_utf8("_raw")).alias("_utf8"))
    path = F.try_url_decode("_file")
    if by_line:
        video = F.coalesce(F.try_url_decode(F.nullif("_name", F.lit(""))), F.nullif("_name", F.lit("")))
    else:
        video = F.regexp_replace(path_name(path_parent(path)), "^[^=]*=", "") if by_folder else F.regexp_replace(path_name(path), r"\.[^.]*$", "")
    apart = F.raise_error(F.concat(F.lit("lines of a video do not stand together: "), video, F.lit(" in "), "_file")).cast("long")
    first = F.when(F.col("_last") - F.col("_first") < F.col("_n"), F.col("_first")).otherwise(apart)
    before = F.sum("_n").over(Window.partitionBy(*whole).orderBy(*place)) - F.col("_n")
    splits = splits.select(*keys, video.alias("video"), (before - first).alias("_shift"), F.min("_utf8").over(Window.partitionBy("_file")).alias("_utf8"))
    rows = rows.join(splits, keys).withColumn("frame_idx", F.col("_id") + F.col("_shift"))
    old = F.translate(F.decode(F.col("_raw").cast("binary"), "ISO-8859-1"), "".join(map(chr, range(128, 256))), _CYRILLIC)
    label = F.when(F.col("_utf8"), F.when(F.col("frame_idx") == 0, F.regexp_replace("value", "^\ufeff", "")).otherwise(F.col("value"))).otherwise(old)
    if by_line:
        label = F.get(F.split(label, "\t", 2), F.lit(1))
    return rows.select("video", "frame_idx", strip(label).alias("label"))


def write_split_set(rows: DataFrame, path: str, split: str = "split", word: str = "word", speaker: str = "speaker_id") -> None:
    """The rows by split, the vocabulary with class ids by the words' order, and a summary: clips by split, speaker and word."""
    from ..operators.splits import build_vocab

    rows.write.mode("overwrite").partitionBy(split).parquet(f"{path}/rows")
    build_vocab(rows, word).coalesce(1).write.mode("overwrite").parquet(f"{path}/vocab")
    own = [c for c in (speaker, word) if c in rows.columns]
    sets = rows.groupingSets([[split], *([split, c] for c in own)], split, *own).agg(F.count("*").alias("clips"), *(F.grouping(c).alias(f"_{c}") for c in own))
    name, kind = F.col(split), F.lit("split")
    for c, label in ((word, "word"), (speaker, "speaker")):
        if c in own:
            name, kind = F.when(F.col(f"_{c}") == 0, F.col(c)).otherwise(name), F.when(F.col(f"_{c}") == 0, label).otherwise(kind)
    sets.select(F.col(split).alias("split"), kind.alias("kind"), name.alias("name"), "clips").coalesce(1).write.mode("overwrite").parquet(f"{path}/summary")


def read_split_set(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/rows")


def read_split_summary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/summary")


def save_folds(members: DataFrame, path: str) -> None:
    """A membership table (splits.loo_membership), one folder for each speaker that is held out, so that a fold is read by folders."""
    members.write.mode("overwrite").partitionBy("out_of").parquet(path)


def load_folds(spark: SparkSession, path: str) -> DataFrame:
    # a folder's name is a text, whatever it looks like
    schema = StructType([StructField(f.name, StringType()) if f.name == "out_of" else f for f in spark.read.parquet(path).schema])
    return spark.read.schema(schema).parquet(path)


def save_features(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    rows.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def load_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def media_inventory(listing: DataFrame, middle: str = "speaker_id", first: str = "word") -> DataFrame:
    """Columns from paths ``first/middle/file``, of media files outside hidden directories."""
    parts = F.split("path", "/")
    rows = listing.where(path_suffix(F.col("path")).isin(*MEDIA) & ~F.col("path").rlike(r"(^|/)\.") & (F.size(parts) >= 3))
    return rows.select("path", F.element_at(parts, -3).alias(first), F.element_at(parts, -2).alias(middle), F.element_at(parts, -1).alias("file"))
