"""The library's tables, derived from the given ones; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def frames(self) -> DataFrame:
        number = (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long")
        return self.events.select(F.col("user_id").cast("string").alias("video"), number.alias("frame_idx"), F.when(F.col("event_type") == "error", "<p:>").otherwise(F.col("event_type")).alias("label"))

    def manifest(self) -> DataFrame:
        start = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
        seconds = lambda ms: (ms.cast("decimal(18,3)") / 1000).cast("decimal(12,3)")
        return self.events.select(
            F.concat(F.lit("clips/"), "event_id", F.lit(".mp4")).alias("clip_file"), F.col("event_type").alias("word"), F.concat(F.lit("spk"), F.col("user_id") % 19).alias("speaker_id"),
            seconds(start).alias("start_sec"), seconds(start + (600 + (F.col("event_id") * 7919) % 36000) * 1000).alias("end_sec"), F.col("user_id").cast("string").alias("source_video"),
        )

    def labels_table(self) -> DataFrame:
        e, u = F.col("event_id"), F.col("user_id")
        return self.events.select(
            F.format_string("ru_%06d", e).alias("clip_id"), F.concat(F.lit("clips/"), "event_type", F.lit("/spk"), u % 19, F.lit("/"), e, F.lit(".mp4")).alias("clip_path"), F.col("event_type").alias("word"),
            F.concat(F.lit("spk"), u % 19).alias("speaker_id"), F.when(e % 3 == 0, "youtube").otherwise("self_recorded").alias("source"), F.lit(0.0).alias("start_sec"), F.round((e % 400) / 100.0 - 0.1, 2).alias("end_sec"),
            e.alias("ord"), F.when(u % 10 < 7, "train").when(u % 10 < 9, "val").otherwise("test").alias("split"), F.round((e % 100) / 100.0, 2).alias("landmark_detection_ratio"), (e % 5).alias("interpolated_frames"),
        )

    def listing(self) -> DataFrame:
        return self.labels_table().where("ord % 7 <> 0").select(F.col("clip_path").alias("path"))

    def words(self) -> DataFrame:
        return self.labels_table().where("word <> 'error'").select("word").distinct()

    def bad(self) -> DataFrame:
        path = F.when(F.col("ord") % 2 == 0, F.concat(F.lit('"C:\\data\\ru_dataset\\02_model_inputs\\'), F.translate("clip_path", "/", "\\"), F.lit('"'))).otherwise("")
        rows = self.labels_table().where("ord % 9 = 0")
        return rows.select(path.alias("clip_path"), F.when(F.col("ord") % 2 == 1, F.col("clip_id")).otherwise("").alias("clip_id"), F.when(F.col("ord") % 5 == 0, "").otherwise(F.concat(F.lit("r"), F.col("ord") % 4)).alias("reason"))

    def measurements(self) -> DataFrame:
        d = F.col("doc_id")
        return self.documents.select(
            F.concat(F.lit("c"), d).alias("clip_id"), F.col("lang").alias("word"), F.col("source").alias("speaker_id"), (d % 17 != 0).alias("exists"), (d % 11 != 0).alias("ok"), ((d % 3) * 25.0).alias("fps"), (F.col("n_chars") % 400).alias("frame_count"),
            (F.col("n_chars") % 256).cast("double").alias("brightness"), (d % 4).alias("face_sample_hits"), d.alias("ord"),
        )

    def predictions(self) -> DataFrame:
        v = F.col("vec_id")
        return self.embeddings.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("logits"), F.col("label").alias("true_idx"), F.concat(F.lit("spk"), v % 7).alias("speaker_id"), (v % 3).alias("seed"), F.concat(F.lit("w"), "label").alias("true_word"))

    def scored(self) -> DataFrame:
        from ..operators.metrics import score_logits

        return score_logits(self.predictions()).withColumn("predicted_word", F.concat(F.lit("w"), "pred_idx"))

    def classes(self) -> DataFrame:
        return self.embeddings.select(F.explode(F.sequence(F.lit(0), F.size("embedding") - 1)).alias("k")).distinct().select(F.concat(F.lit("w"), "k").alias("word"))

    def frame_arrays(self) -> DataFrame:
        rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.transform(F.slice("embedding", k * 8 + 1, 8), lambda x: x.cast("double")))
        return self.embeddings.select("vec_id", "label", rows.alias("frames"))

    def runs(self) -> DataFrame:
        return self.orders.groupBy(F.col("o_orderpriority").alias("variant"), F.col("o_orderstatus").alias("fold"), (F.col("o_orderkey") % 3).alias("seed")).agg(F.round(F.avg("o_totalprice") / 1000000, 6).alias("macro_f1"), F.round(F.avg("o_custkey") / 10000, 6).alias("loss"), F.max("o_orderkey").alias("written"))

    def history(self) -> DataFrame:
        epoch = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long")
        return self.orders.select(F.col("o_custkey").alias("run_id"), epoch.alias("epoch"), F.round((F.col("o_orderkey") * 37 % 101) / 100.0, 2).alias("macro_f1"), F.col("o_totalprice").alias("loss"))

    def geometry(self) -> DataFrame:
        number = (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long")
        hole = F.col("event_id") % 4 == 0
        return self.events.select(F.col("user_id").alias("clip_id"), number.alias("frame_idx"), F.when(~hole, F.col("value")).alias("cx"), F.when(~hole, F.col("value") * 2).alias("side"))

    def points(self) -> DataFrame:
        rows = self.embeddings.select(F.expr("vec_id div 10").alias("clip_id"), (F.col("vec_id") % 10).alias("frame_idx"), F.explode(F.sequence(F.lit(0), F.lit(31))).alias("point_id"), "embedding")
        at = lambda k: F.get("embedding", F.col("point_id") * 2 + k).cast("double") * 100
        return rows.select("clip_id", "frame_idx", "point_id", at(0).alias("x"), at(1).alias("y"))

    def cues(self) -> DataFrame:
        """Cues of eight words, each four words on; total: where the last cue of the document ends."""
        rows = self.documents.where("trim(text) <> ''").select("doc_id", "text").repartition("doc_id").select("doc_id", F.split(F.trim("text"), r"\s+").alias("t"))
        # the texts are cut before they are exploded: a row for each cue must not carry its whole text
        cut = lambda k: F.struct(k.alias("cue_no"), F.array_join(F.slice("t", k.cast("int") * 4 + 1, 8), " ").alias("text"))
        last = F.expr("(size(t) - 1) div 4")
        rows = rows.select("doc_id", (last * 2.0 + 4).alias("total"), F.explode(F.transform(F.sequence(F.lit(0).cast("long"), last), cut)).alias("cue"))
        return rows.select("doc_id", "total", "cue.cue_no", (F.col("cue.cue_no") * 2.0).alias("start_sec"), (F.col("cue.cue_no") * 2.0 + 4).alias("end_sec"), "cue.text")

    def intervals(self) -> DataFrame:
        e = F.col("event_id")
        start = (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1) * 0.25
        return self.events.select(F.col("user_id").cast("string").alias("video"), start.alias("start_sec"), (start + F.when(e % 6 == 0, 0.0).otherwise(0.25)).alias("end_sec"), F.when(e % 10 == 0, "").otherwise(F.col("event_type")).alias("label"))


FRAMES = "f AS (SELECT CAST(user_id AS VARCHAR) AS video, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx, CASE WHEN event_type = 'error' THEN '<p:>' ELSE event_type END AS label FROM events)"
SEGMENTS = FRAMES + """,
    g AS (SELECT *, CASE WHEN label IS DISTINCT FROM lag(label) OVER (PARTITION BY video ORDER BY frame_idx) THEN 1 ELSE 0 END AS fresh FROM f),
    r AS (SELECT *, sum(fresh) OVER (PARTITION BY video ORDER BY frame_idx) AS run FROM g),
    s0 AS (SELECT video, run, any_value(label) AS word, min(frame_idx) AS start_frame, max(frame_idx) AS end_frame FROM r GROUP BY 1, 2),
    seg AS (SELECT video, row_number() OVER (PARTITION BY video ORDER BY start_frame) AS seg_idx, word, start_frame, end_frame FROM s0 WHERE word <> '<p:>')"""
MANIFEST = """m AS (SELECT 'clips/' || event_id || '.mp4' AS clip_file, CAST(event_id AS VARCHAR) AS clip_id, event_type AS word, 'spk' || (user_id % 19) AS speaker_id, CAST((epoch_us(ts) // 1000 - 1704067200000) / 1000 AS DECIMAL(12,3)) AS s,
        CAST((epoch_us(ts) // 1000 - 1704067200000 + (600 + (event_id * 7919) % 36000) * 1000) / 1000 AS DECIMAL(12,3)) AS e, CAST(user_id AS VARCHAR) AS source_video FROM events)"""
PAIRS = MANIFEST + """,
    p AS (SELECT a.source_video, a.speaker_id, a.word AS word_a, b.word AS word_b, a.clip_id AS clip_id_a, b.clip_id AS clip_id_b, a.clip_file AS clip_file_a, b.clip_file AS clip_file_b,
        a.s AS start_sec_a, a.e AS end_sec_a, b.s AS start_sec_b, b.e AS end_sec_b, CAST(a.e - a.s AS DECIMAL(12,3)) AS duration_sec_a, CAST(b.e - b.s AS DECIMAL(12,3)) AS duration_sec_b, CAST(least(a.e, b.e) - greatest(a.s, b.s) AS DECIMAL(12,3)) AS overlap_sec,
        round(CAST(least(a.e, b.e) - greatest(a.s, b.s) AS DOUBLE) / CAST(least(a.e - a.s, b.e - b.s) AS DOUBLE), 6) AS overlap_ratio_shorter, greatest(a.s, b.s) AS overlap_start_sec, least(a.e, b.e) AS overlap_end_sec
        FROM m a JOIN m b ON a.source_video = b.source_video AND (a.s, a.e, a.clip_file) < (b.s, b.e, b.clip_file) AND b.s < a.e AND a.word <> b.word WHERE least(a.e, b.e) > greatest(a.s, b.s))"""
LABELS = """l AS (SELECT printf('ru_%06d', event_id) AS clip_id, 'clips/' || event_type || '/spk' || (user_id % 19) || '/' || event_id || '.mp4' AS clip_path, event_type AS word, 'spk' || (user_id % 19) AS speaker_id,
        CASE WHEN event_id % 3 = 0 THEN 'youtube' ELSE 'self_recorded' END AS source, CAST(0 AS DOUBLE) AS start_sec, round((event_id % 400) / CAST(100 AS DOUBLE) - CAST(0.1 AS DOUBLE), 2) AS end_sec, event_id AS ord,
        CASE WHEN user_id % 10 < 7 THEN 'train' WHEN user_id % 10 < 9 THEN 'val' ELSE 'test' END AS split, round((event_id % 100) / CAST(100 AS DOUBLE), 2) AS landmark_detection_ratio, event_id % 5 AS interpolated_frames FROM events),
    listing AS (SELECT clip_path AS path FROM l WHERE ord % 7 <> 0), words AS (SELECT DISTINCT word FROM l WHERE word <> 'error')"""
BAD = LABELS + """,
    bad AS (SELECT CASE WHEN ord % 2 = 0 THEN clip_path ELSE '' END AS clip_path, CASE WHEN ord % 2 = 1 THEN clip_id ELSE '' END AS clip_id, CASE WHEN ord % 5 = 0 THEN '' ELSE 'r' || (ord % 4) END AS reason FROM l WHERE ord % 9 = 0)"""
QUALITY = """q0 AS (SELECT 'c' || doc_id AS clip_id, lang AS word, source AS speaker_id, doc_id % 17 <> 0 AS there, doc_id % 11 <> 0 AS ok, (doc_id % 3) * CAST(25 AS DOUBLE) AS fps, n_chars % 400 AS frame_count, CAST(n_chars % 256 AS DOUBLE) AS brightness, doc_id % 4 AS face_sample_hits, doc_id AS ord FROM documents),
    q1 AS (SELECT *, CASE WHEN fps > 0 THEN frame_count / fps ELSE 0 END AS duration_sec, CASE WHEN NOT there THEN 'missing' WHEN NOT ok THEN 'unreadable' ELSE '' END AS reason FROM q0),
    q AS (SELECT *, CASE reason WHEN 'missing' THEN ['missing'] WHEN '' THEN list_filter([CASE WHEN frame_count < 5 THEN 'too_few_frames' END, CASE WHEN duration_sec < 0.18 THEN 'too_short' END, CASE WHEN duration_sec > 2.5 THEN 'too_long' END,
        CASE WHEN brightness < 15 THEN 'very_dark' END, CASE WHEN brightness > 245 THEN 'very_bright' END, CASE WHEN face_sample_hits = 0 THEN 'no_face_detected' END], lambda x: x IS NOT NULL) END AS flags FROM q1)"""
SCORED = """e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS logits, label AS true_idx, 'spk' || (vec_id % 7) AS speaker_id, vec_id % 3 AS seed, 'w' || label AS true_word FROM embeddings),
    t AS (SELECT *, list_max(logits) AS top, list_sum(list_transform(logits, lambda x: exp(x - list_max(logits)))) AS mass FROM e),
    s AS (SELECT *, ln(mass) + top - logits[true_idx + 1] AS loss, 1 / mass AS pred_confidence, CAST(list_position(logits, top) - 1 AS INTEGER) AS pred_idx, list_position(logits, top) - 1 = true_idx AS correct, 'w' || (list_position(logits, top) - 1) AS predicted_word FROM t),
    classes AS (SELECT DISTINCT 'w' || k AS word FROM (SELECT unnest(range(len(embedding))) AS k FROM embeddings))"""
REPORT = SCORED + """,
    w AS (SELECT word, seed FROM classes, (SELECT DISTINCT seed FROM s)),
    c AS (SELECT w.word, w.seed, count(*) FILTER (s.true_word = w.word) AS support, count(*) FILTER (s.predicted_word = w.word) AS predicted, count(*) FILTER (s.true_word = w.word AND s.predicted_word = w.word) AS correct
        FROM w JOIN s ON s.seed = w.seed GROUP BY 1, 2),
    rep AS (SELECT seed, word, support, predicted, correct, CASE WHEN predicted > 0 THEN correct / predicted ELSE 0 END AS precision, CASE WHEN support > 0 THEN correct / support ELSE 0 END AS recall,
        CASE WHEN support + predicted > 0 THEN 2 * correct / (support + predicted) ELSE 0 END AS f1 FROM c)"""
RUNS = "runs AS (SELECT o_orderpriority AS variant, o_orderstatus AS fold, o_orderkey % 3 AS seed, round(avg(o_totalprice) / 1000000, 6) AS macro_f1, round(avg(o_custkey) / 10000, 6) AS loss, max(o_orderkey) AS written FROM orders GROUP BY 1, 2, 3)"
HISTORY = "h AS (SELECT o_custkey AS run_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS epoch, round((o_orderkey * 37 % 101) / CAST(100 AS DOUBLE), 2) AS macro_f1, o_totalprice AS loss FROM orders)"
GEOMETRY = "geo AS (SELECT user_id AS clip_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx, CASE WHEN event_id % 4 <> 0 THEN value END AS cx, CASE WHEN event_id % 4 <> 0 THEN value * 2 END AS side FROM events)"
POINTS = "pts AS (SELECT vec_id // 10 AS clip_id, vec_id % 10 AS frame_idx, k AS point_id, CAST(embedding[2 * k + 1] AS DOUBLE) * 100 AS x, CAST(embedding[2 * k + 2] AS DOUBLE) * 100 AS y FROM embeddings, range(32) t(k))"
CUES = r"""d AS (SELECT doc_id, regexp_split_to_array(trim(text), '\s+') AS t FROM documents WHERE trim(text) <> ''),
    cues AS (SELECT doc_id, k AS cue_no, k * CAST(2 AS DOUBLE) AS start_sec, k * CAST(2 AS DOUBLE) + 4 AS end_sec, t[4 * k + 1 : 4 * k + 8] AS all_tokens FROM (SELECT doc_id, t, unnest(range(0, (len(t) - 1) // 4 + 1)) AS k FROM d))"""
INTERVALS = "i AS (SELECT CAST(user_id AS VARCHAR) AS video, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) * CAST(0.25 AS DOUBLE) AS start_sec, event_id % 6 = 0 AS short, CASE WHEN event_id % 10 = 0 THEN '<silence:>' ELSE event_type END AS label FROM events)"
FRAME_ARRAYS = "fa AS (SELECT vec_id, label, list_transform(range(8), lambda k: list_transform(embedding[k * 8 + 1 : k * 8 + 8], lambda x: CAST(x AS DOUBLE))) AS frames FROM embeddings)"


def collapsed(source: str, key: str) -> str:
    """SQL that collapses rolling cues of a table with key columns, cue_no and all_tokens."""
    return rf"""
    n0 AS (SELECT *, list_filter(all_tokens, lambda x: regexp_replace(replace(lower(x), 'ё', 'е'), '[^0-9a-zа-я-]+', '', 'g') <> '') AS tokens FROM {source}),
    n1 AS (SELECT *, list_transform(tokens, lambda x: regexp_replace(replace(lower(x), 'ё', 'е'), '[^0-9a-zа-я-]+', '', 'g')) AS plain FROM n0 WHERE len(tokens) > 0),
    n2 AS (SELECT *, lag(plain) OVER (PARTITION BY {key} ORDER BY cue_no) AS before FROM n1),
    n3 AS (SELECT *, coalesce(list_max(list_filter(range(1, least(len(coalesce(before, [])), len(plain)) + 1), lambda k: before[len(before) - k + 1 : len(before)] = plain[1:k])), 0) AS same FROM n2),
    n4 AS (SELECT {key}, cue_no, tokens[same + 1 :] AS fresh FROM n3),
    col AS (SELECT {key}, array_to_string(flatten(list(fresh ORDER BY cue_no)), ' ') AS text, CAST(sum(len(fresh)) AS INTEGER) AS n_tokens FROM n4 GROUP BY {key})"""
