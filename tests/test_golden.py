"""The published results again: overlaps, review samples in order, summaries of runs, fold sizes."""

import pytest
from pyspark.sql import functions as F

from clipweave.operators import metrics, splits, timeline

from golden import HFLIP, MSTCN, PAIRS, REVIEW, SAMPLER, SAMPLER_SUMMARY

SEVERITY = {"padded_overlap_v3": (45, 0.466, 0.740, 38, 22), "moderate_overlap_v3": (21, 0.226, 0.240, 11, 6), "bounded_overlap_v3": (11, 0.194, 0.227, 3, 1), "padded_overlap_final_test": (26, 0.416, 0.700, 19, 12)}


def clip(video, word, number):
    return f"{word}/{video}_{number:06d}.mp4"


def manifest(spark, name):
    clips = set()
    for video, speaker, word_a, word_b, a, b, *sec, _, _ in PAIRS[name]:
        clips |= {(video, speaker, word_a, clip(video, word_a, a), *sec[:2]), (video, speaker, word_b, clip(video, word_b, b), *sec[2:])}
    rows = spark.createDataFrame(sorted(clips), "source_video string, speaker_id string, word string, clip_file string, start_sec string, end_sec string")
    return rows.withColumns({c: F.col(c).cast("decimal(12,3)") for c in ("start_sec", "end_sec")})


@pytest.mark.parametrize("name", PAIRS)
def test_overlaps_and_review_samples(spark, name):
    pairs = timeline.overlap_pairs(manifest(spark, name), 2.0)
    got = {(r.clip_file_a, r.clip_file_b): (r.speaker_id, float(r.overlap_sec), r.overlap_ratio_shorter) for r in pairs.collect()}
    want = {(clip(v, wa, a), clip(v, wb, b)): (s, over, share) for v, s, wa, wb, a, b, *_, over, share in PAIRS[name]}
    assert got == want
    sample = timeline.review_sample(pairs, 30).orderBy("review_no").collect()
    order = [*want]
    assert [order.index((r.clip_file_a, r.clip_file_b)) for r in sample] == REVIEW[name]
    assert {(r.review_status, r.notes) for r in sample} == {("pending", "")} and [r.review_no for r in sample] == [*range(1, len(sample) + 1)]
    (whole,) = timeline.overlap_summary(pairs).where("all_speakers = 1").collect()
    assert (whole.pairs, round(whole.median_overlap_sec, 3), float(whole.max_overlap_sec), whole.long_pairs, whole.half_pairs) == SEVERITY[name]


def test_sampler_summary(spark):
    runs = spark.createDataFrame(SAMPLER, "strategy string, seed int, macro_f1 double")
    got = {r[0]: (r["mean"], r["std"], r["delta"]) for r in metrics.run_summary(runs, "strategy", "macro_f1", "speaker_word_inverse").collect()}
    assert set(got) == {x[0] for x in SAMPLER_SUMMARY}
    for name, *want in SAMPLER_SUMMARY:
        assert got[name] == pytest.approx(want, abs=2e-6)
    assert metrics.best_variant(metrics.run_summary(runs, "strategy", "macro_f1"), "strategy").first().strategy == "uniform_shuffle"


def test_paired_flips(spark):
    runs = spark.createDataFrame([(f, c, s, m) for f, c, s, *_, m in HFLIP], "fold_speaker string, condition string, seed int, macro_f1 double")
    paired = metrics.paired_deltas(runs, ["fold_speaker", "seed"], ["original", "original+hflip"], "original", "macro_f1", key="condition")
    deltas = {(r.fold_speaker, r.seed): r["original+hflip_delta"] for r in paired.collect()}
    assert deltas["spk03", 42] == pytest.approx(-0.008316, abs=2e-6) and deltas["spk17", 123] == pytest.approx(0.10184, abs=2e-6) and len(deltas) == 9
    r = metrics.paired_summary(paired, "fold_speaker", "seed", "original", "original+hflip").first()
    assert (r.folds, r.seeds, r.wins, r.comparisons) == (3, 3, 6, 9)
    assert (r.base_mean, r.other_mean, r.delta_mean, r.delta_std) == pytest.approx((0.372703, 0.390018, 0.017316, 0.057050), abs=2e-6)


def test_pretrained_against_its_baseline(spark):
    runs = spark.createDataFrame([(f, s, m) for f, s, _, m in MSTCN], "fold string, seed int, macro_f1 double")
    base = spark.createDataFrame([(f, s, b) for f, s, b, _ in MSTCN], "fold string, seed int, baseline double")
    rows = metrics.attach_baseline(runs, base, ["fold", "seed"], "macro_f1")
    r = rows.agg(F.avg("delta").alias("mean"), F.stddev_samp("delta").alias("std"), F.count_if(F.col("delta") > 0).alias("wins")).first()
    assert (r["mean"], r["std"], r.wins) == (pytest.approx(0.193159, abs=2e-6), pytest.approx(0.106754, abs=2e-6), 8)


def test_fold_sizes(spark):
    sizes = {(f, c): (t, v) for f, c, _, t, v, _ in HFLIP}
    speakers = {f: v for (f, _), (_, v) in sizes.items()}
    rest = sizes["spk03", "original"][0] - speakers["spk17"] - speakers["spk19"]
    rows = spark.createDataFrame([(s, n) for s, n in [*speakers.items(), ("others", rest)]], "speaker_id string, n int").select("speaker_id", F.explode(F.sequence(F.lit(1), "n"))).drop("col")
    for conditions in (["original"], ["original", "hflip"]):
        table = rows.select("speaker_id", F.explode(F.array(*map(F.lit, conditions))).alias("condition"))
        got = {(r.fold_speaker, r.part): r.n for r in splits.loo_fold_sizes(table).collect()}
        for speaker in speakers:
            assert (got[speaker, "train"], got[speaker, "validation"]) == sizes[speaker, "+".join(conditions)]
        whole = {(r.fold_speaker, r.part): r["count"] for r in splits.loo_folds(table, rows.select("speaker_id").distinct()).groupBy("fold_speaker", "part").count().collect()}
        assert whole == got
        members = splits.loo_membership(table, {"all": conditions})
        assert members.count() == table.count()
        for speaker in speakers:
            assert {(speaker, r.part): r["count"] for r in splits.loo_fold(members, speaker, "all").groupBy("part").count().collect()} == {k: n for k, n in got.items() if k[0] == speaker}
