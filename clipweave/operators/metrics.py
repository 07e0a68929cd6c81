"""Scores, confusion, reports, and comparisons of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .features import total, unioned


def score_logits(rows: DataFrame, logits: str = "logits", true: str = "true_idx") -> DataFrame:
    """rows with loss (cross entropy), pred_confidence (softmax), pred_idx (first largest) and correct."""
    top = F.array_max(logits)
    mass = total(F.transform(logits, lambda x: F.exp(x - top)))
    pred = (F.array_position(logits, top) - 1).cast("int")
    return rows.withColumns({"loss": F.log(mass) + top - F.get(logits, F.col(true)), "pred_confidence": 1 / mass, "pred_idx": pred, "correct": pred == F.col(true)})


def confusion(rows: DataFrame, vocab: DataFrame, true: str = "true_word", pred: str = "predicted_word") -> DataFrame:
    """true_word, predicted_word, n for all pairs of vocabulary words; counts are made before the small grid is joined."""
    counts = rows.groupBy(F.col(true).alias("true_word"), F.col(pred).alias("predicted_word")).agg(F.count("*").alias("n"))
    grid = vocab.select(F.col("word").alias("true_word")).crossJoin(vocab.select(F.col("word").alias("predicted_word")))
    return grid.join(counts, ["true_word", "predicted_word"], "left").select("true_word", "predicted_word", F.coalesce("n", F.lit(0)).alias("n"))


def class_report(rows: DataFrame, vocab: DataFrame, by: list[str] = [], true: str = "true_word", pred: str = "predicted_word") -> DataFrame:  # noqa: B006
    """By word (and the columns by): support, predicted, correct, precision, recall, f1; 0 where undefined."""
    counts = rows.groupBy(*by, F.col(true).alias("t"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))
    sides = F.array(F.struct(F.col("t").alias("word"), F.col("n").alias("s"), F.lit(0).cast("long").alias("p")), F.struct(F.col("p").alias("word"), F.lit(0).cast("long").alias("s"), F.col("n").alias("p")))
    right = F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)
    long = counts.select(*by, right.alias("c"), F.posexplode(sides).alias("side", "x"))
    sums = long.groupBy(*by, F.col("x.word").alias("word")).agg(F.sum("x.s").alias("support"), F.sum("x.p").alias("predicted"), F.sum(F.when(F.col("side") == 0, F.col("c")).otherwise(0)).alias("correct"))
    words = vocab.select("word") if not by else vocab.select("word").crossJoin(rows.select(*by).distinct())
    out = words.join(sums, [*by, "word"], "left").na.fill(0, ["support", "predicted", "correct"])
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    out = out.withColumn("precision", ratio("correct", "predicted")).withColumn("recall", ratio("correct", "support"))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("correct"), (F.col("support") + F.col("predicted")).cast("double")), F.lit(0.0))
    return out.select(*by, "word", "support", "predicted", "correct", "precision", "recall", f1.alias("f1"))


def eval_summary(report: DataFrame, mode: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """accuracy, balanced_accuracy, macro_f1, predicted_classes of a class report.

    mode names the classes that macro_f1 averages: active (those with support), observed (with support or predicted) or vocab (all).
    """
    of = {"active": F.col("support") > 0, "observed": (F.col("support") > 0) | (F.col("predicted") > 0), "vocab": F.lit(True)}[mode]
    return report.groupBy(*by).agg(
        F.round(F.sum("correct") / F.sum("support"), 6).alias("accuracy"), F.round(F.avg(F.when(F.col("support") > 0, F.col("recall"))), 6).alias("balanced_accuracy"),
        F.round(F.avg(F.when(of, F.col("f1"))), 6).alias("macro_f1"), F.count_if(F.col("predicted") > 0).alias("predicted_classes"),
    )


def prediction_distribution(rows: DataFrame, true: str = "true_word", pred: str = "predicted_word") -> DataFrame:
    t = rows.groupBy(F.col(true).alias("word")).agg(F.count("*").alias("true_count"))
    p = rows.groupBy(F.col(pred).alias("word")).agg(F.count("*").alias("predicted_count"))
    return t.join(p, "word", "full_outer").na.fill(0, ["true_count", "predicted_count"])


def hardest_clips(rows: DataFrame, k: int, key: str, wrong_only: bool = False) -> DataFrame:
    return (rows.where(~F.col("correct")) if wrong_only else rows).orderBy(F.desc("loss"), key).limit(k)


def per_class_summary(report: DataFrame) -> DataFrame:
    """By word, mean and sample deviation of precision, recall and f1 over the runs of a report."""
    return report.groupBy("word").agg(*(F.round(f(c), 6).alias(f"{c}_{n}") for c in ("precision", "recall", "f1") for f, n in ((F.avg, "mean"), (F.stddev_samp, "std"))))


def best_epoch(history: DataFrame, patience: int) -> DataFrame:
    """run_id, best_epoch, macro_f1, loss, epochs_completed: the largest (macro_f1, then smallest loss), the first of equals, until patience epochs bring nothing better."""
    order = Window.partitionBy("run_id").orderBy("epoch")
    goal = F.struct(F.col("macro_f1").alias("f"), (-F.col("loss")).alias("l"))
    rows = history.withColumn("goal", goal).withColumn("before", F.max("goal").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("better", F.col("before").isNull() | (F.col("goal") > F.col("before")))
    rows = rows.withColumn("since", F.max(F.when(F.col("better"), F.col("epoch"))).over(order))
    rows = rows.withColumn("stop", F.min(F.when(F.col("epoch") - F.col("since") >= patience, F.col("epoch"))).over(Window.partitionBy("run_id")))
    rows = rows.where(F.col("stop").isNull() | (F.col("epoch") <= F.col("stop")))
    best = F.max_by(F.struct("epoch", "macro_f1", "loss"), F.struct("goal", (-F.col("epoch")).alias("e"))).alias("b")
    return rows.groupBy("run_id").agg(best, F.max("epoch").alias("epochs_completed")).select("run_id", F.col("b.epoch").alias("best_epoch"), "b.macro_f1", "b.loss", "epochs_completed")


def keep_last(runs: DataFrame, keys: list[str], order: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return runs.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def run_summary(runs: DataFrame, key: str, score: str, base: str | None = None) -> DataFrame:
    """By variant: runs, mean and sample deviation of the score, and the mean's distance to the variant base."""
    out = runs.groupBy(key).agg(F.count("*").alias("runs"), F.avg(score).alias("mean"), F.stddev_samp(score).alias("std"))
    if base is None:
        return out.select(key, "runs", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))
    of = out.where(F.col(key) == base).select(F.col("mean").alias("base"))
    return out.join(F.broadcast(of)).select(key, "runs", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), F.round(F.col("mean") - F.col("base"), 6).alias("delta"))


def metric_summary(runs: DataFrame, columns: list[str]) -> DataFrame:
    return runs.unpivot([], columns, "metric", "value").groupBy("metric").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("std"))


def best_variant(summary: DataFrame, key: str, prefix: str = "") -> DataFrame:
    """The variant with the largest mean (of equals the first name) among those whose name starts with prefix."""
    return summary.where(F.col(key).startswith(prefix)).orderBy(F.desc("mean"), key).limit(1)


def compare_versions(a: DataFrame, b: DataFrame, on: list[str], score: str) -> DataFrame:
    rows = a.select(*on, F.col(score).alias("a")).join(b.select(*on, F.col(score).alias("b")), on, "left")
    return rows.withColumn("difference", F.round(F.col("b") - F.col("a"), 6))


def attach_baseline(runs: DataFrame, base: DataFrame, on: list[str], score: str) -> DataFrame:
    """runs with the pinned baseline's score and the distance to it. Whether the baseline is broadcast is the optimizer's choice, by its size."""
    return runs.join(base, on).withColumn("delta", F.round(F.col(score) - F.col("baseline"), 6))


def paired_deltas(runs: DataFrame, index: list[str], variants: list[str], base: str, score: str, key: str = "variant") -> DataFrame:
    """One row for each pairing key: the score of each variant, and each one's distance to the base."""
    wide = runs.groupBy(*index).pivot(key, variants).agg(F.avg(score))
    quoted = lambda v: F.col(f"`{v}`")
    return wide.select(*index, *(F.round(quoted(v), 6).alias(v) for v in variants), *(F.round(quoted(v) - quoted(base), 6).alias(f"{v}_delta") for v in variants if v != base))


def paired_summary(paired: DataFrame, fold: str, seed: str, base: str, other: str) -> DataFrame:
    delta = F.col(f"`{other}`") - F.col(f"`{base}`")
    return paired.agg(
        F.count_distinct(fold).alias("folds"), F.count_distinct(seed).alias("seeds"), F.round(F.avg(f"`{base}`"), 6).alias("base_mean"), F.round(F.avg(f"`{other}`"), 6).alias("other_mean"),
        F.round(F.avg(delta), 6).alias("delta_mean"), F.round(F.stddev_samp(delta), 6).alias("delta_std"), F.count_if(delta > 0).alias("wins"), F.count(delta).alias("comparisons"),
    )


def decision_gate(summary: DataFrame, least_mean: float | None = None, least_wins: int | None = None) -> DataFrame:
    """summary with verdict: accept if the mean distance is over 0 (or at least least_mean) and there are least_wins or more."""
    good: Column = F.col("delta_mean") > 0 if least_mean is None else F.col("delta_mean") >= least_mean
    if least_wins is not None:
        good = good & (F.col("wins") >= least_wins)
    return summary.withColumn("verdict", F.when(good, "accept").otherwise("reject"))


def model_comparison(tables: list[DataFrame], score: str = "mean", name: str = "variant") -> DataFrame:
    """All tables' rows under all their columns, the best score first (nulls last), then by name; place is the place in that order."""
    rows = unioned(tables)
    order = [F.col(score).desc_nulls_last(), F.col(name)]
    # as many rows as there are models
    return rows.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long")).orderBy("place")


def protocol_json(rows: DataFrame, seeds: list[int]) -> DataFrame:
    """One row with one JSON text: clips, speakers, vocabulary, seeds. Speakers and words are the distinct ones, small sets."""
    sums = rows.agg(F.count("*").alias("clips"), F.sort_array(F.collect_set("speaker_id")).alias("speakers"), F.sort_array(F.collect_set("word")).alias("vocabulary"))
    return sums.select(F.to_json(F.struct("clips", "speakers", "vocabulary", F.array(*map(F.lit, seeds)).alias("seeds"))).alias("protocol"))
