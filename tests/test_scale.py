"""Operators whose groups may be large: the same results whatever the parts, and plans without hot keys."""

import time
from collections import Counter
from pathlib import Path
from random import Random
from statistics import median

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clipweave.operators import curation, features, metrics, ranks, splits, timeline
from clipweave.plans import registry
from clipweave.sources import tables
from clipweave.sources.shared import shared_dir


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ---------------------------------------------------------------- folds and draws


def test_fold_membership_is_a_row_a_row_and_a_fold_is_a_filter(spark, tmp_path):
    rows = spark.range(90).selectExpr("id", "concat('0', id % 5) AS speaker_id", "if(id % 3 = 0, 'hflip', 'original') AS condition")
    members = splits.loo_membership(rows, {"plain": ["original"], "flipped": ["original", "hflip"]})
    assert members.count() == 90 and "Join" not in plan(members)
    tables.save_folds(members, str(tmp_path / "folds"))
    saved = tables.load_folds(spark, str(tmp_path / "folds"))
    for speaker in ("00", "03"):
        every = splits.loo_folds(rows, spark.createDataFrame([(speaker,)], "speaker_id string"))
        for setting, own in (("plain", ["original"]), ("flipped", ["original", "hflip"])):
            want = {(r.id, r.part) for r in every.where((F.col("part") != "train") | F.col("condition").isin(own)).collect()}
            assert {(r.id, r.part) for r in splits.loo_fold(saved, speaker, setting).collect()} == want
    for part, files in (("validation", 1), ("train", 4)):
        only = splits.loo_fold(saved, "03", "plain", part)
        assert "out_of" in plan(only).split("PartitionFilters: [")[1].split("PushedFilters")[0] and {r.part for r in only.collect()} == {part}
        assert len({r.f.rsplit("/", 2)[-2] for r in only.select(F.input_file_name().alias("f")).collect()}) == files


def test_a_row_drawn_a_million_times(spark):
    rows = spark.range(2001).selectExpr("concat('c', id) AS clip_id", "if(id = 0, 'rare', 'often') AS word", "'s' AS speaker_id")
    drawn = splits.weighted_draw(rows, 2_000_000, 3, part_rows=300, chunk=100)
    counts = {r.clip_id: r["count"] for r in drawn.groupBy("clip_id").count().collect()}
    assert sum(counts.values()) == 2_000_000 and abs(counts["c0"] - 1_000_000) < 5_000
    others = [counts.get(f"c{k}", 0) for k in range(1, 2001)]
    # 500 draws are expected of each: chi-squared within five deviations
    assert abs(sum((n - 500) ** 2 / 500 for n in others) - 2000) < 5 * (2 * 2000) ** 0.5
    assert drawn.agg(F.count_distinct("draw"), F.min("draw"), F.max("draw")).first()[:] == (2_000_000, 0, 1_999_999)
    assert "Join" not in plan(drawn).split("MapInArrow")[0]  # nothing is joined to what is drawn


@pytest.mark.parametrize("strategy", ["uniform", "word", "inverse", "sqrt"])
def test_draws_follow_the_weights(spark, strategy):
    rows = spark.range(60).selectExpr("id AS clip_id", "concat('s', id % 2) AS speaker_id", "if(id < 50, 'a', 'b') AS word")
    weights = {r.clip_id: r.weight for r in splits.sample_weights(rows, strategy).collect()}
    got = Counter(r.clip_id for r in splits.weighted_draw(rows, 30_000, 9, strategy, part_rows=20, chunk=7).collect())
    for key, weight in weights.items():
        want = 30_000 * weight / sum(weights.values())
        assert abs(got[key] - want) < 6 * want**0.5
    assert splits.weighted_draw(rows, 0, 9).count() == 0 and splits.weighted_draw(rows.where("false"), 5, 9).count() == 0


# ---------------------------------------------------------------- numbers over all rows


def test_numbers_by_ranges(spark):
    rng = Random(1)
    rows = [("w", "s", f"{rng.randrange(500):03d}", k) for k in range(700)] + [(rng.choice("xyz"), None, "f", -k) for k in range(1, 90)]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "word string, speaker_id string, file string, k long").repartition(5)
    got = sorted(ranks.numbered_all(table, ["word", "speaker_id", "file", "k"]).collect(), key=lambda r: r._row)
    assert [r._row for r in got] == [*range(1, len(rows) + 1)]
    key = lambda r: (r[0], r[1] is not None, r[1] or "", r[2], r[3])
    assert [tuple(r)[:4] for r in got] == sorted(rows, key=key)
    # one word of one speaker is several tasks
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        one = ranks.numbered_all(table.where("word = 'w'"), ["word", "speaker_id", "file", "k"])
        assert one.inputFiles() and len(one.inputFiles()) >= 3 and one.agg(F.max("_row")).first()[0] == 700
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("part", [2, 5, 1000])
def test_geometry_does_not_depend_on_the_parts(spark, part):
    rng = Random(part)
    rows, want = [], {}
    for clip in "abc":
        n, values = rng.randrange(20, 60), {}
        for k in sorted(rng.sample(range(100), n)):
            values[k] = rng.random() * 10 if rng.random() < {"a": 0.5, "b": 0.08, "c": 0.0}[clip] else None
        known = {k: v for k, v in values.items() if v is not None}
        filled = {k: float(np.interp(k, [*known], [*known.values()])) for k in values} if known else {}
        order = sorted(filled)
        want |= {(clip, k): (filled[k], median(filled[o] for o in order[max(0, i - 2) : i + 3])) for i, k in enumerate(order)}
        rows += [(clip, k, v) for k, v in values.items()]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "clip_id string, frame_idx long, side double").repartition(3)
    filled = timeline.interpolate_gaps(table, "clip_id", "frame_idx", ["side"], part)
    smooth = timeline.rolling_median(filled, "clip_id", "frame_idx", ["side"], part_rows=part)
    assert {(r.clip_id, r.frame_idx): r.side for r in filled.collect()} == pytest.approx({k: v[0] for k, v in want.items()})
    assert {(r.clip_id, r.frame_idx): r.side for r in smooth.collect()} == pytest.approx({k: v[1] for k, v in want.items()})
    a, b = (sorted(map(tuple, timeline.detection_gate(table.withColumn("cx", F.col("side")), 0.0, p).collect())) for p in (part, 1 << 16))
    assert a == b
    with pytest.raises(ValueError, match="hands on"):
        timeline.rolling_median(table, "clip_id", "frame_idx", ["side"], part_rows=1)


def test_long_files_are_numbered_over_splits(spark, tmp_path):
    lines = [f"слово{k % 7}" if k % 11 else "" for k in range(5000)]
    (tmp_path / "long.a.txt").write_bytes(("﻿" + "\n".join(lines) + "\n").encode())
    (tmp_path / "old one.txt").write_bytes("\r\n".join(["ascii"] * 3000 + ["да ", "—"]).encode("cp1251"))
    (tmp_path / "empty.txt").write_bytes(b"")
    before = {c: spark.conf.get(c, None) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = tables.read_frame_labels(spark, f"{tmp_path}/*.txt")
        assert spark.read.text(f"{tmp_path}/*.txt").rdd.getNumPartitions() > 10
        rows = {(r.video, r.frame_idx): r.label for r in got.collect()}
    finally:
        for c, v in before.items():
            spark.conf.unset(c) if v is None else spark.conf.set(c, v)
    assert rows == {("long.a", k): w for k, w in enumerate(lines)} | {("old one", k): w for k, w in enumerate(["ascii"] * 3000 + ["да", "—"])}


def test_files_of_frame_labels_do_not_grow_with_videos(spark, sf_dir):
    folders = lambda: {*Path(shared_dir(spark).removeprefix("file://")).glob("clipweave/frames-*")}
    before = folders()
    got = registry.QUERIES["read_frame_labels"](spark, sf_dir)
    (made,) = folders() - before
    assert got.select("video").distinct().count() > 8 >= len([*made.rglob("*.txt")])


def test_frame_labels_of_many_videos_are_read_as_written(spark, tmp_path):
    names = ["a", "a b", "x/y=1", "+", "100%", "tab\there", "строка\n", "﻿", None]
    rows = [(v, k, [f"слово{k % 7}", "", None, "one\ttwo"][(k + i) % 4]) for i, v in enumerate(names) for k in range(20 * i + 1)] + [("long", k, f"l{k}") for k in range(3000)]
    Random(5).shuffle(rows)
    confs = {"spark.sql.files.maxPartitionBytes": "4096", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.maxRecordsPerFile": "1000"}
    before = {c: spark.conf.get(c, None) for c in confs}
    try:
        for c, v in confs.items():
            spark.conf.set(c, v)
        tables.write_frame_labels(spark.createDataFrame(rows, "video string, frame_idx long, label string").repartition(3), f"{tmp_path}/all")
        assert spark.read.text(f"{tmp_path}/all/*.txt").rdd.getNumPartitions() > 10
        got = [tuple(r) for r in tables.read_frame_labels(spark, f"{tmp_path}/all/*.txt", by_line=True).collect()]
    finally:
        for c, v in before.items():
            spark.conf.unset(c) if v is None else spark.conf.set(c, v)
    assert Counter(got) == Counter(rows)


def test_frame_labels_by_line_of_other_writers(spark, tmp_path):
    (tmp_path / "1.txt").write_bytes("﻿a\tда\r\na\t нет \r\nb%zz\tx\r\nb%zz\r\n".encode())
    (tmp_path / "2.txt").write_bytes("a\tascii\nc\tда".encode("cp1251"))
    got = {tuple(r) for r in tables.read_frame_labels(spark, f"{tmp_path}/?.txt", by_line=True).collect()}
    assert got == {("a", 0, "да"), ("a", 1, "нет"), ("a", 2, "ascii"), ("b%zz", 0, "x"), ("b%zz", 1, None), ("c", 0, "да")}
    (tmp_path / "apart.txt").write_text("a\tx\nb\tx\na\ty\n")
    with pytest.raises(Exception, match="do not stand together: a in"):
        tables.read_frame_labels(spark, f"{tmp_path}/apart.txt", by_line=True).collect()
    with pytest.raises(Exception, match="line break"):
        tables.write_frame_labels(spark.createDataFrame([("a", 0, "x\ny")], "video string, frame_idx long, label string"), f"{tmp_path}/broken")


def test_frame_labels_by_folder(spark, tmp_path):
    for name in ("video=a b", "plain"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "words_frames.txt").write_text("x\ny\n")
    got = {tuple(r) for r in tables.read_frame_labels(spark, f"{tmp_path}/*/*.txt", by_folder=True).collect()}
    assert got == {(v, k, w) for v in ("a b", "plain") for k, w in enumerate("xy")}


# ---------------------------------------------------------------- cues, pairs, prefixes


def test_longest_overlap_is_found_in_linear_time():
    rng = Random(4)
    for _ in range(3000):
        a, b = ([rng.choice("ab") for _ in range(rng.randrange(0, 9))] for _ in "xy")
        want = max((k for k in range(len(b) + 1) if k <= len(a) and a[len(a) - k :] == b[:k]), default=0) if b else 0
        assert not b or timeline.overlap(a, b) == want
    began = time.perf_counter()
    same = ["a"] * 10_000
    assert timeline.overlap([*same, "b"], same) == 0 and timeline.overlap(["b", *same], [*same, "c"]) == 10_000 and timeline.overlap([*same, "b"], [*same[1:], "b"]) == 10_000
    assert timeline.overlap(["a", "b"] * 5000, ["a", "b"] * 4999 + ["a", "c"]) == 9998
    assert time.perf_counter() - began < 1


def test_cues_with_odd_rows(spark):
    rows = [(1, 0, "a b  c"), (1, 1, None), (1, 2, "B! C d"), (1, 3, "... --"), (1, 4, "!!"), (None, 0, "x"), (None, 1, "x y"), (2, 0, " "), (3, 0, "Ёж ёж"), (3, 1, "еж Ж")]
    got = {r.k: (r.text, r.n_tokens) for r in timeline.collapse_rolling(spark.createDataFrame(rows, "k long, cue_no long, text string"), ["k"]).collect()}
    assert got == {1: ("a b c d --", 5), None: ("x y", 2), 3: ("Ёж ёж Ж", 3)}
    assert timeline.collapse_rolling(spark.createDataFrame([], "k long, cue_no long, text string"), ["k"]).count() == 0


def test_subtitles_with_any_white_space_and_a_mark(spark):
    text = "﻿1\n00:00:01,000 --> 00:00:02,000\na  b c\n١٢\n\n"
    got = timeline.parse_srt(spark.createDataFrame([("f", text)], "file string, text string")).collect()
    assert [(r.cue_no, r.start_sec, r.end_sec, r.text) for r in got] == [(1, 1.0, 2.0, "a b c")]


def test_the_pairs_of_a_summary_are_made_once(spark, sf_dir):
    summary = registry.QUERIES["overlap_summary"](spark, sf_dir)
    assert "bin" not in plan(summary).replace("_bin", "") and "explode(sequence" not in plan(summary)


def test_prefix_table_against_the_plain_rule(spark):
    rng = Random(6)
    part = lambda: rng.choice(["a", "b", "ab", "c.d", ""])
    paths = [None, "", "/", "a"] + ["/".join(part() for _ in range(rng.randrange(1, 6))) for _ in range(300)]
    table = {"/".join(part() for _ in range(rng.randrange(1, 4))): f"t{k}" for k in range(25)}
    prefixes = spark.createDataFrame([*table.items(), *[(p, "zz") for p in list(table)[:5]], (None, "n"), ("a/b", None)], "prefix string, target string")
    got = curation.map_prefix_table(spark.createDataFrame([(k, p) for k, p in enumerate(paths)], "k long, path string"), prefixes, "path")
    want = {}
    for k, p in enumerate(paths):
        fits = [x for x in table if p is not None and (p == x or p.startswith(x + "/"))]
        want[k] = table[m := max(fits, key=len)] + p[len(m) :] if fits else None
    assert {r.k: r.mapped_path for r in got.collect()} == want
    many = spark.range(100_000).selectExpr("concat('p/', id) AS prefix", "concat('t', id) AS target")
    wide = curation.map_prefix_table(spark.range(1000).selectExpr("concat('p/', id * 7, '/x') AS path"), many, "path")
    assert "NestedLoop" not in plan(wide) and "Cartesian" not in plan(wide) and wide.where("mapped_path = concat('t', split(path, '/')[1], '/x')").count() == 1000


def test_mapped_share(spark):
    rows = spark.createDataFrame([("a", True), ("a", False), ("a", None), ("b", True)], "g string, m boolean")
    assert {r.g: (r["rows"], r.mapped, r.share) for r in curation.mapped_share(rows, F.col("m"), ["g"]).collect()} == {"a": (3, 1, 0.333333), "b": (1, 1, 1.0)}
    assert curation.mapped_share(rows.where("false"), F.col("m")).first()[:] == (0, 0, None)


# ---------------------------------------------------------------- heads of all folds


def plain_head(x, y, classes, penalty=0.01):
    """Newton steps on the same function, one fold at a time."""
    scale = 1 / x.std(0, ddof=1)
    z = np.hstack([np.ones((len(x), 1)), x * scale])
    w, wide = np.zeros((classes, z.shape[1])), z.shape[1]
    fixed = np.diag([0.0] + [penalty] * (wide - 1))
    for _ in range(50):
        p = np.exp(z @ w.T - (z @ w.T).max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = (p - np.eye(classes)[y]).T @ z / len(z) + w @ fixed
        h = np.zeros((classes * wide, classes * wide))
        for a in range(classes):
            for b in range(classes):
                own = z.T @ (z * (p[:, a] * ((a == b) - p[:, b]))[:, None]) / len(z)
                h[a * wide : (a + 1) * wide, b * wide : (b + 1) * wide] = own + (fixed if a == b else 0)
        w = w - np.linalg.lstsq(h + 1e-10 * np.eye(len(h)), g.ravel(), rcond=None)[0].reshape(w.shape)
    return np.hstack([w[:, :1], w[:, 1:] * scale])


def test_heads_of_all_folds_are_plain_fits(spark, monkeypatch):
    rng = np.random.default_rng(7)
    passes = Counter()
    plainly = features._collected
    monkeypatch.setattr(features, "_collected", lambda *a: (passes.update([many]), plainly(*a))[1])
    for many in (2, 9):
        y = rng.integers(0, 3, 180)
        x = rng.normal(0, [1, 5, 0.1, 2], (180, 4)) + np.eye(3, 4)[y] * [1, 4, 0.1, 0]
        rows = spark.createDataFrame([(k, x[k].tolist(), int(y[k]), f"s{k % many}") for k in range(180)], "id long, v array<double>, y int, s string").repartition(3)
        heads = features.probe_heads(rows, "v", "y", "s", max_iter=60, tolerance=1e-7)
        for k in range(many):
            own = np.arange(180) % many == k
            want = plain_head(x[~own], y[~own], 3)
            assert heads[f"s{k}"] - heads[f"s{k}"].mean(0) == pytest.approx(want - want.mean(0), abs=2e-3)
            got = {r.id: r.pred_idx for r in features.linear_probe(rows, "v", "y", "s").where(F.col("s") == f"s{k}").collect()} if k < 1 else {}
            assert all(g == (np.hstack([[1.0], x[i]]) @ want.T).argmax() or abs(np.diff(np.sort(np.hstack([[1.0], x[i]]) @ want.T)[-2:])[0]) < 0.02 for i, g in got.items())
    assert passes[9] <= passes[2] + 40  # both bounded by the number of steps, not by speakers
    alone = spark.createDataFrame([(1, [1.0], 0, "s"), (2, None, 0, "s")], "id long, v array<double>, y int, s string")
    assert {r.id: r.pred_idx for r in features.linear_probe(alone, "v", "y", "s").collect()} == {1: None, 2: None}


# ---------------------------------------------------------------- splits, jobs, packages


def test_excluded_speakers_and_top_words(spark):
    rows = spark.createDataFrame([("c1", "a", "x"), ("c2", "a", "y"), ("c3", "b", "y"), ("c4", "c", "x"), ("c5", "c", "x"), ("c6", None, "z")], "clip_id string, speaker_id string, word string")
    got = splits.speaker_split(rows, {"train": ["a"], "val": ["b"]}, exclude=["c"], top=1)
    assert {(r.clip_id, r.split) for r in got.collect()} == {("c2", "train"), ("c3", "val")}
    with pytest.raises(ValueError, match="left"):
        splits.speaker_split(rows.where("speaker_id = 'c'"), {"train": ["a"]}, exclude=["c"])


def test_jobs_of_one_video_up_to_a_limit(spark):
    jobs = spark.createDataFrame([(s, v) for s in "ab" for v in ("v1", "v2", "v3")], "speaker_id string, video_dir string")
    gone = spark.createDataFrame([("a ", "v1", " EXCLUDED"), ("b", "v2", "kept")], "speaker_id string, video_dir string, status string")
    rows = lambda **kw: [tuple(r) for r in curation.exclude_videos(jobs, gone, **kw).collect()]
    assert rows(speaker="a", limit=1) == [("a", "v2")] and sorted(rows(video="v1")) == [("b", "v1")] and rows(limit=0) == [] and len(rows()) == len(rows(limit=-1)) == 5


def test_manifest_is_sorted_and_counted(spark):
    rows = spark.createDataFrame([("b", "train"), ("a", "val"), ("b", "train"), ("../c", "val"), ("d", "test")], "clip_path string, split string")
    manifest = curation.package_manifest(rows, spark.createDataFrame([("a",), ("b",)], "path string"), ["train", "val"], "r")
    assert [(r.clip_path, r.in_train, r.in_val, r.unsafe, r.missing) for r in manifest.collect()] == [("../c", 0, 1, True, True), ("a", 0, 1, False, False), ("b", 2, 0, False, False)]
    assert curation.package_counts(manifest, ["train", "val"]).first()[:] == (3, 2, 2, 1, 1)


def test_models_come_by_score(spark):
    one = spark.createDataFrame([("m", 0.5), ("k", 0.5), ("z", None)], "variant string, mean double")
    got = metrics.model_comparison([one, spark.createDataFrame([("a", 0.9, 1)], "variant string, mean double, n int")]).collect()
    assert [(r.place, r.variant) for r in got] == [(1, "a"), (2, "k"), (3, "m"), (4, "z")]


def test_split_set_summary(spark, tmp_path):
    rows = spark.createDataFrame([("train", "a", "x"), ("train", "b", "x"), ("val", "c", None)], "split string, speaker_id string, word string")
    tables.write_split_set(rows, str(tmp_path / "s"))
    got = {tuple(r) for r in tables.read_split_summary(spark, str(tmp_path / "s")).collect()}
    assert got == {("train", "split", "train", 2), ("val", "split", "val", 1), ("train", "speaker", "a", 1), ("train", "speaker", "b", 1), ("val", "speaker", "c", 1), ("train", "word", "x", 2), ("val", "word", None, 1)}


# ---------------------------------------------------------------- queries on larger tables


def test_clip_paths_of_long_ids(spark, tmp_path, duck):
    """Ids of seven and eight digits: the number in a path is that of the SQL."""
    ids = [0, 499, 500, 99_999, 999_999, 1_000_000, 1_000_001, 5_999_999, 8_999_999, 9_000_000, 10_500_000, 123_456_789]
    rows = spark.createDataFrame([(k, k % 23, "error" if k % 2 else "view") for k in ids], "event_id long, user_id long, event_type string")
    rows.write.parquet(f"{tmp_path}/events.parquet")
    got = {r.event_id: r.path for r in registry.QUERIES["clip_output_path"](spark, str(tmp_path)).collect()}
    sql = registry.SQL["clip_output_path"].replace("FROM events", f"FROM '{tmp_path}/events.parquet/*.parquet'")
    assert got == dict(duck.sql(sql).fetchall()) and len(got) == len(ids)


def test_overlaps_of_short_and_long_cues():
    rng = Random(5)
    for n in (6, timeline.SHORT - 1, timeline.SHORT, timeline.SHORT + 1, 80):
        for _ in range(300):
            a, b = [rng.choice("ab") for _ in range(n)], [rng.choice("ab") for _ in range(n + rng.randrange(-2, 3))]
            k = rng.randrange(n - 2)
            b[:k] = a[len(a) - k :]
            assert timeline.overlap(a, b) == max((k for k in range(min(len(a), len(b)) + 1) if a[len(a) - k :] == b[:k]), default=0)


def test_texts_are_normalized_a_batch_at_once():
    """A text whose tokens all stay has the tokens that one by one normalizing gives; the others have fewer."""
    rng = Random(6)
    letters = "aZ09яЯёЁéİK-'!.  \t\n\x0b\x1c\x85\xa0\u2003\u3000日ß"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(16))) for _ in range(20_000)]
    same = 0
    for text, plain in zip(texts, timeline._plain_texts(pa.array(texts)).to_pylist()):
        want = [timeline._plain(t) for t in text.split()]
        if len(plain.split()) == len(want):
            same += 1
            assert plain.split() == want
        else:
            assert len(plain.split()) < len(want)
    assert same > 5000
