"""Worked examples and properties."""

from collections import Counter
from hashlib import md5
from itertools import combinations
from random import Random
from statistics import median

import pytest
from pyspark.sql import functions as F

from clipweave.functions import text as T
from clipweave.operators import curation, features, metrics, ranks, splits, timeline
from clipweave.sources import tables


def test_runs_of_a_worked_example(spark):
    labels = ["привет"] * 3 + ["как"] * 2 + ["дела", "в"]
    frames = spark.createDataFrame([("v", k, x) for k, x in enumerate(labels)], "video string, frame_idx long, label string")
    got = [(r.seg_idx, r.word, r.start_frame, r.end_frame) for r in timeline.label_runs(frames).orderBy("seg_idx").collect()]
    assert got == [(1, "привет", 0, 2), (2, "как", 3, 4), (3, "дела", 5, 5), (4, "в", 6, 6)]
    assert timeline.label_runs(frames, 2).count() == 2


def test_runs_from_intervals_equal_runs_from_frames(spark):
    rng = Random(3)
    rows, at = [], 0.0
    for _ in range(200):
        size = rng.choice((0.0, 0.1, 0.2, 0.35))
        rows.append(("v", at, at + size, rng.choice(("a", "b", "", "<laugh>"))))
        at += size
    intervals = spark.createDataFrame(rows, "video string, start_sec double, end_sec double, label string")
    a = timeline.label_runs(timeline.intervals_to_frames(intervals, F.lit(30))).select("word", "start_frame", "end_frame").collect()
    b = timeline.runs_from_intervals(intervals, F.lit(30)).select("word", "start_frame", "end_frame").collect()
    assert Counter(a) == Counter(b)


def test_overlap_example_and_brute_force(spark):
    schema = "clip_file string, word string, speaker_id string, start_sec double, end_sec double, source_video string"
    rows = spark.createDataFrame([("x/a.mp4", "a", "s", 102.233, 103.433, "v"), ("x/b.mp4", "b", "s", 103.267, 104.267, "v"), ("x/c.mp4", "b", "s", 104.267, 104.3, "v")], schema)
    (pair,) = timeline.overlap_pairs(rows, 2.0).collect()
    assert (pair.clip_id_a, pair.clip_id_b, float(pair.overlap_sec), pair.overlap_ratio_shorter) == ("a", "b", 0.166, 0.166)
    rng = Random(1)
    clips = [(f"{k}.mp4", rng.choice("abc"), "s", float(s := rng.randrange(9000)), float(s + rng.randrange(1, 2500)), rng.choice("vw")) for k in range(150)]
    want = set()
    for a, b in combinations(sorted(clips, key=lambda c: (c[3], c[4], c[0])), 2):
        if a[5] == b[5] and a[1] != b[1] and b[3] < a[4]:
            want.add((a[0], b[0]))
    for width in (400, 2500, 10**6):
        got = [(r.clip_file_a, r.clip_file_b) for r in timeline.overlap_pairs(spark.createDataFrame(clips, schema), width).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_collapse_of_sliding_windows_gives_the_tokens_back(spark):
    tokens = [f"t{k}" for k in range(50)]
    cues = spark.createDataFrame([("d", k, " ".join(tokens[k * 3 : k * 3 + 6])) for k in range(16)] + [("d", 99, " ... ")], "doc_id string, cue_no long, text string")
    (row,) = timeline.collapse_rolling(cues, ["doc_id"]).collect()
    said = tokens[: 15 * 3 + 6]
    assert row.text.split() == said and row.n_tokens == len(said)


def test_collapse_equals_the_plain_rule(spark):
    rng = Random(12)
    words = ["Да", "да!", "нет", "ё", "е", "...", "a-b", "A-B", "7", "—", "\u00a0"]
    cues = [(rng.randrange(4), k, "  ".join(rng.choice(words) for _ in range(rng.randrange(0, 9)))) for k in range(400)]
    plain = lambda t: "".join(c for c in t.lower().replace("ё", "е") if c in "0123456789-" or "a" <= c <= "z" or "а" <= c <= "я")
    want, before = {}, {}
    for doc, _, text in sorted(cues):
        own = [t for t in text.split() if plain(t)]
        if not own:
            continue
        last = before.get(doc, [])
        same = max((k for k in range(1, min(len(last), len(own)) + 1) if [*map(plain, last[-k:])] == [*map(plain, own[:k])]), default=0)
        want.setdefault(doc, []).extend(own[same:])
        before[doc] = own
    got = {r.doc_id: (r.text.split(" "), r.n_tokens) for r in timeline.collapse_rolling(spark.createDataFrame(cues, "doc_id long, cue_no long, text string"), ["doc_id"]).collect()}
    assert got == {d: (t, len(t)) for d, t in want.items()}


def test_chunks_have_names_and_a_cap(spark):
    rows = [("v", k, k * 100.0, k * 100.0 + 50, " ".join(f"w{k}x{i}" for i in range(25)), 950.0) for k in range(9)]
    cues = spark.createDataFrame(rows, "video string, cue_no long, start_sec double, end_sec double, text string, total double")
    assert [(r.chunk_idx, r.chunk_id, r.n_tokens) for r in timeline.chunk_cues(cues, ["video"], "total").orderBy("chunk_idx").collect()] == [(0, "v_part001", 75), (1, "v_part002", 75), (2, "v_part003", 75)]
    assert {r.n_tokens for r in timeline.chunk_cues(cues, ["video"], "total", max_sec=400).where("chunk_idx = 1").collect()} == {25}


@pytest.mark.parametrize("part", [1, 3, 7])
def test_runs_do_not_depend_on_the_parts(spark, part):
    rng = Random(part)
    frames = spark.createDataFrame([(v, k, rng.choice(("a", "a", "b", "<p:>", None))) for v in "xyz" for k in range(120)], "video string, frame_idx long, label string")
    assert sorted(map(tuple, timeline.label_runs(frames, 2, part).collect())) == sorted(map(tuple, timeline.label_runs(frames, 2).collect()))


def test_clip_seconds(spark):
    segments = spark.createDataFrame([("v", 1, "a", 2, 2), ("v", 2, "b", 10, 40)], "video string, seg_idx long, word string, start_frame long, end_frame long")
    got = [(str(r.start_sec), str(r.end_sec)) for r in timeline.clip_intervals(segments, 30, start_pad=0.0, end_pad=0.0).orderBy("seg_idx").collect()]
    assert got == [("0.067", "0.100"), ("0.333", "1.367")]
    assert timeline.clip_intervals(segments, 30, max_source_sec=1.3).count() == 1  # it ends later, though it starts before
    assert [str(r.start_sec) for r in timeline.clip_intervals(segments, 29.97, pad_frames=3, start_pad=0.2).orderBy("seg_idx").collect()] == ["0.000", "0.034"]
    videos = spark.createDataFrame([("v", 25.0, 1.5)], "video string, fps double, duration_sec double")
    batch = timeline.clip_intervals_batch(segments, videos, spark.createDataFrame([("b",)], "word string")).collect()
    assert [(r.seg_idx, str(r.start_sec), str(r.end_sec)) for r in batch] == [(2, "0.080", "1.500")]


def test_mouth_boxes(spark):
    dims = spark.createDataFrame([("face", 400, 300), ("none", 400, 300), ("edge", 50, 60)], "clip_id string, width int, height int")
    found = spark.createDataFrame([("face", 0, 0, 10, 20, 100, 100), ("face", 1, 0, 0, 0, 100, 100), ("edge", 0, 0, 49, 10, 40, 40), ("none", 0, 0, 5, 5, 0, 90)], "clip_id string, sample_no int, det_no int, x int, y int, w int, h int")
    box = lambda fallback: {r.clip_id: ((r.x0, r.y0, r.x1, r.y1), r.status) for r in timeline.mouth_boxes(found, dims, fallback).collect()}
    empty = (None,) * 4
    assert box(False) == {"face": ((22, 75, 98, 113), "face_mouth_crop"), "none": (empty, "no_face"), "edge": (empty, "bad_crop_box")}
    assert box(True)["none"] == ((117, 156, 282, 261), "fallback_lower_center_crop")


def test_frame_sets(spark):
    rows = {r.n: r for r in spark.createDataFrame([(n,) for n in (0, 1, 2, 5, 100)], "n long").select("n", *(timeline.frame_samples(F.col("n"), mode=m).alias(m) for m in ("three", "five"))).collect()}
    assert [rows[n].three for n in (0, 1, 2, 5, 100)] == [[], [0], [0, 1], [0, 2, 4], [0, 50, 99]]
    assert [rows[n].five for n in (0, 1, 5, 100)] == [[0], [0], [0, 1, 2, 3, 4], [0, 33, 50, 66, 99]]
    assert spark.range(1).select(timeline.filled_up(F.array(F.lit(1), F.lit(7)), 4).alias("x")).first().x == [1, 7, 7, 7]


def test_subtitles(spark):
    text = "1\n00:00:01,000 --> 00:00:02,500\nПривет <i>мир</i>\n\n2\n00:00:03,000 --> 00:00:04,000\n<b></b>\n\n3\n00:00:05,000 --> 00:00:06,000\nда\n00:00:07,000 --> 00:00:08,000\nнет"
    rows = timeline.parse_srt(spark.createDataFrame([("f", text)], "file string, text string")).orderBy("cue_no").collect()
    assert [(r.cue_no, r.start_sec, r.end_sec, r.text) for r in rows] == [(1, 1.0, 2.5, "Привет мир"), (2, 5.0, 6.0, "да"), (3, 7.0, 8.0, "нет")]


def test_scalars(spark):
    row = spark.range(1).select(
        T.normalize_path(F.lit(" \"'C:\\ru_dataset\\02_model_inputs\\a\\b.mp4'\" ")).alias("path"), T.sanitize_path_part(F.lit("..")).alias("blank"), T.sanitize_path_part(F.lit('a<b>:"c')).alias("part"),
        T.normalize_token(F.lit("Ёж,-2!")).alias("token"), T.clean_transcript(F.lit("WEBVTT x\n12\n00:00:01,000 --> 00:00:02,000\r1:02 -->3:04.5\n 00:01.000 --> 00:02.000 \u2028<i>Да</i>, [шум] Ёж!")).alias("said"), T.media_duration(F.lit("x Duration: 00:01:02.50, y")).alias("sec"), T.media_fps(F.lit("no")).alias("fps"),
    ).first()
    assert tuple(row) == ("a/b.mp4", "_", "a_b___c", "еж-2", "да ёж", 62.5, None)


@pytest.mark.parametrize(("n", "sizes"), [(1, (1, 0, 0)), (2, (1, 0, 1)), (3, (1, 1, 1)), (10, (8, 1, 1)), (25, (20, 2, 3))])
def test_stratified_sizes(spark, n, sizes):
    got = Counter(r.split for r in splits.stratified_split(spark.range(n).selectExpr("id AS clip_id", "'w' AS word"), 1).collect())
    assert tuple(got[s] for s in ("train", "val", "test")) == sizes


def test_speaker_in_two_sets_raises(spark):
    with pytest.raises(ValueError, match="several"):
        splits.speaker_split(spark.range(1).selectExpr("'a' AS speaker_id"), {"train": ["a"], "val": ["a"]})


def test_gaps_and_gate(spark):
    rows = spark.createDataFrame([("a", 0, None), ("a", 1, 2.0), ("a", 2, None), ("a", 3, 6.0), ("a", 4, None), ("b", 0, None)], "clip_id string, frame_idx long, cx double")
    got = [r.cx for r in timeline.interpolate_gaps(rows, "clip_id", "frame_idx", ["cx"]).orderBy("frame_idx").collect()]
    assert got == [2.0, 2.0, 4.0, 6.0, 6.0]
    gate = lambda least: {r.clip_id: (r.landmark_status, r.mean_crop_side_px, r.interpolated_frames) for r in timeline.detection_gate(rows.withColumn("side", F.col("cx")), least).collect()}
    assert gate(0.7) == {c: ("low_detection_ratio", None, None) for c in "ab"}
    # filled: 2 2 4 6 6; their medians in windows of five: 2 3 4 5 6
    assert gate(0.0) == {"a": ("ok", 4.0, 3), "b": ("no_landmarks", None, None)}
    third = rows.where("clip_id = 'b'").union(spark.createDataFrame([("b", k, 1.0) for k in (1, 2)], rows.schema)).withColumn("side", F.col("cx"))
    assert timeline.detection_gate(third, 2 / 3).first().landmark_status == "ok" and timeline.detection_gate(third, 0.66667).first().landmark_status != "ok"


def test_macro_f1_modes_differ(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "c"), ("b", "b")], "true_word string, predicted_word string")
    report = metrics.class_report(rows, spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "word string"))
    f1 = {m: metrics.eval_summary(report, m).first().macro_f1 for m in ("active", "observed", "vocab")}
    assert f1 == {"active": 0.833333, "observed": 0.555556, "vocab": 0.416667}


def test_quality_borders(spark):
    rows = spark.createDataFrame([("a", True, 25.0, 5, 15.0, 1), ("b", True, 0.0, 4, 245.1, 0), ("c", False, 0.0, 0, 0.0, 0)], "clip_id string, ok boolean, fps double, frame_count int, brightness double, face_sample_hits int")
    q = curation.quality_flags(rows)
    assert {r.clip_id: r.flags for r in q.collect()} == {"a": [], "b": ["too_few_frames", "too_short", "very_bright", "no_face_detected"], "c": None}
    assert {r.clip_id for r in curation.drop_flagged(rows, q, ["too_short"]).collect()} == {"a", "c"}
    gone = curation.quality_flags(rows.withColumn("exists", F.col("clip_id") != "c"))
    assert {(r.clip_id, r.reason) for r in gone.collect()} == {("a", ""), ("b", ""), ("c", "missing")} and [r.clip_id for r in curation.drop_flagged(rows, gone).collect()] == ["a"]
    report = {(r.kind, r.name): (r.n, r.value) for r in curation.quality_report(q.withColumns({"speaker_id": F.lit("s"), "word": F.lit("w")})).collect()}
    assert report["all", "readable"] == (2, None) and report["duration", "max"] == (2, 0.2) and report["duration", "avg"] == (2, 0.1)


def test_odd_label_rows(spark):
    rows = [(0, " a", "p1", "w", "0", "1"), (1, "a\t", "p1", "w ", "0", "1"), (2, "\u00a0", "p1", "w", "0", "1"), (3, "b", "px", "z", "1", "x"), (4, "c", "p1", "w", "1", "1")]
    table = spark.createDataFrame(rows, "ord long, clip_id string, clip_path string, word string, start_sec string, end_sec string")
    got = {(r.line, r.problem) for r in curation.validate_labels(table, "ord", spark.createDataFrame([("w",)], "word string"), spark.createDataFrame([("p1",)], "path string")).collect()}
    assert got == {(3, "repeated_id"), (4, "empty_id"), (5, "missing_file"), (5, "unknown_word"), (5, "not_a_number"), (6, "end_before_start")}
    broken = {r.rule: r.violations for r in curation.split_preflight(table.drop("clip_path"), spark.createDataFrame([("w",), ("q",)], "word string"), spark.createDataFrame([("p1",)], "path string")).collect()}
    assert broken == {"missing_clip_path": 1, "missing_speaker_id": 1, "positive_interval": 1, "known_word": 2, "vocabulary_used": 1}


def test_a_split_without_a_speaker_has_no_name(spark):
    rows = spark.createDataFrame([("train", None, "w"), ("train", "s", "w")], "split string, speaker_id string, word string")
    assert {(r.kind, r.name) for r in splits.describe_splits(rows).collect()} == {("split", "train"), ("speaker", None), ("speaker", "s"), ("word", "w")}


def test_files_by_rule(spark):
    rows = spark.createDataFrame([("d", "k", "b.srt"), ("d", "k", "a.srt"), ("e", "k", "k.ru.srt"), ("e", "k", "a.srt"), ("f", "k", "z.srt")], "dir string, id string, file string")
    names = ["{id}.ru.srt", "{id}.ru-orig.srt"]
    assert {(r.dir, r.file) for r in curation.pick_files(rows, names, "first").collect()} == {("d", "a.srt"), ("e", "k.ru.srt"), ("f", "z.srt")}
    assert {(r.dir, r.file) for r in curation.pick_files(rows, names).collect()} == {("e", "k.ru.srt"), ("f", "z.srt")}


def test_label_ids_beyond_six_digits(spark):
    rows = spark.range(3).selectExpr("'w' AS word", "'s' AS speaker_id", "concat('self_', id, '.mp4') AS file", "concat('p/', id) AS path", "0.0 AS duration_sec")
    many = rows.union(spark.range(1_000_001).selectExpr("'v'", "'s'", "concat('yt_', lpad(id, 7, '0'), '.mp4')", "concat('q/', id)", "1.0"))
    got = splits.build_labels(many)
    assert got.agg(F.count_distinct("clip_id"), F.max("clip_id")).first()[0] == 1_000_004
    assert {(r.clip_id, r.source, str(r.end_sec)) for r in got.where("word = 'w'").collect()} == {(f"ru_100000{k}", "self_recorded", "0.001") for k in (2, 3, 4)}


def test_noise_keeps_the_mean_and_drops_a_share(spark):
    rows = spark.range(300).select("id", F.array_repeat(F.lit(1.0), 200).alias("v"))
    noisy = features.feature_noise(rows, "id", "v", 0.05, 0.1, 4, scale=1.0)
    r = noisy.select(F.explode("v").alias("x")).agg(F.avg("x").alias("mean"), F.avg((F.col("x") == 0).cast("int")).alias("zero"), F.stddev(F.when(F.col("x") != 0, F.col("x"))).alias("sd")).first()
    assert abs(r["mean"] - 1) < 0.01 and abs(r.zero - 0.1) < 0.01 and abs(r.sd - 0.05 / 0.9) < 0.003
    assert sorted(map(tuple, noisy.collect())) == sorted(map(tuple, features.feature_noise(rows.repartition(5), "id", "v", 0.05, 0.1, 4, scale=1.0).collect()))


def test_probe_learns_from_the_other_speakers(spark):
    rng = Random(2)
    rows = [(k, [10.0 * (k % 3 == c) + rng.random() for c in range(3)], k % 3 if k % 4 else (k + 1) % 3, k % 4) for k in range(120)]
    got = features.linear_probe(spark.createDataFrame(rows, "id long, v array<double>, y int, speaker int"), "v", "y", "speaker").collect()
    # speaker 0's labels are shifted: other speakers' fits give the unshifted class
    assert len(got) == 120 and all(r.pred_idx == r.id % 3 for r in got if r.speaker == 0) and sum(r.pred_idx == r.y for r in got if r.speaker) > 60


@pytest.mark.parametrize("n", [1, 2, 7, 500])
def test_ranks_and_medians(spark, n):
    rng = Random(n)
    rows = [(rng.choice(("a", None)), rng.choice((0.1, 0.5, rng.random() * 9, None)), k) for k in range(n)]
    table = spark.createDataFrame(rows, "g string, v double, k long")
    want = {}
    for g, v, _ in rows:
        if v is not None:
            want.setdefault(g, []).append(v)
    assert {r.g: r.median for r in ranks.medians(table, "v", ["g"], 0.3).collect()} == pytest.approx({g: median(v) for g, v in want.items()})
    got = ranks.numbered(table, ["g"], splits.seeded(3, "k"), ["k"]).collect()
    for g in {g for g, _, _ in rows}:
        own = sorted((r for r in got if r.g == g), key=lambda r: md5(f"3|{r.k}".encode()).hexdigest())
        assert [r._rank for r in own] == [*range(1, len(own) + 1)] and {r._n for r in own} == {len(own)}


def test_weighted_draw_is_balanced_and_repeatable(spark):
    rows = spark.range(600).selectExpr("concat('c', id) AS clip_id", "concat('s', id % 3) AS speaker_id", "if(id < 500, 'often', 'seldom') AS word")
    drawn = splits.weighted_draw(rows, 6000, 5).collect()
    assert len(drawn) == 6000
    counts = Counter((r.speaker_id, r.word) for r in drawn)
    assert len(counts) == 6 and all(850 < n < 1150 for n in counts.values())
    again = splits.weighted_draw(rows.repartition(7), 6000, 5).collect()
    assert sorted(map(tuple, drawn)) == sorted(map(tuple, again))


def test_frame_label_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿да\n нет \n\n".encode())
    (tmp_path / "b.txt").write_bytes("да\r\nнет".encode("cp1251"))
    got = sorted(tuple(r) for r in tables.read_frame_labels(spark, f"{tmp_path}/*.txt").collect())
    assert got == [("a", 0, "да"), ("a", 1, "нет"), ("a", 2, ""), ("b", 0, "да"), ("b", 1, "нет")]


def test_read_labels_checks_the_header(spark, tmp_path):
    (tmp_path / "x.csv").write_text("﻿clip_id,word\n1,a\n", encoding="utf-8")
    with pytest.raises(ValueError, match="lacks"):
        tables.read_labels(spark, str(tmp_path / "x.csv"))
    assert tables.read_labels(spark, str(tmp_path / "x.csv"), required=["clip_id"]).columns == ["clip_id", "word"]


def test_mask_zeroes_a_block_or_nothing(spark):
    rows = spark.range(200).select("id", features.temporal_mask(F.array(*(F.array(F.lit(1.0)) for _ in range(8))), F.col("id"), 0.5, 4, 1).alias("f")).collect()
    sums = Counter(sum(x[0] for x in r.f) for r in rows)
    assert set(sums) == {4.0, 8.0} and 60 < sums[4.0] < 140
