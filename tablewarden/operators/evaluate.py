"""Scoring of ranked issues against injected ground truth."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewarden import config
from tablewarden.functions.scoring import lookup

METRICS = ("precision", "recall", "f1", "top_5_recall", "noise_rate", "summary_accuracy", "wall_seconds")


def match_pairs(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Pairs ``(run_id, pred_pos, truth_pos)`` of the same meaning, table and columns.

    ``predicted`` carries ``run_id`` and ``pred_pos`` (its place in the ranking), ``truth``
    carries ``truth_pos``.  Columns must overlap only when both sides name some.
    """
    p = predicted.select(
        "run_id", "pred_pos", F.col("table").alias("p_table"), F.col("columns").alias("p_columns"),
        F.explode(F.coalesce(lookup(F.col("issue_type"), config.TRUTH_TYPES), F.array("issue_type"))).alias("truth_type"))
    t = truth.select("truth_pos", F.col("issue_type").alias("truth_type"),
                     F.col("table").alias("p_table"), F.col("columns").alias("t_columns"))
    return (p.join(t, ["truth_type", "p_table"])
            .where((F.size("p_columns") == 0) | (F.size("t_columns") == 0)
                   | F.arrays_overlap("p_columns", "t_columns"))
            .select("run_id", "pred_pos", "truth_pos"))


def greedy_matches(pairs: DataFrame) -> DataFrame:
    """Each prediction, best first, takes the first truth nobody has taken.

    Sequential by definition; a group holds the issues of one run (bounded by the number of
    columns in the schema), never data rows.
    """
    def assign(run: pd.DataFrame) -> pd.DataFrame:
        taken: set[int] = set()
        used: set[int] = set()
        keep = []
        ordered = run.sort_values(["pred_pos", "truth_pos"])
        for i, p, t in zip(ordered.index, ordered["pred_pos"], ordered["truth_pos"]):
            if p not in used and t not in taken:
                used.add(p)
                taken.add(t)
                keep.append(i)
        return ordered.loc[keep, ["run_id", "pred_pos", "truth_pos"]]

    return pairs.groupBy("run_id").applyInPandas(assign, "run_id string, pred_pos int, truth_pos int")


def positions(ranked: DataFrame, run_id: str) -> DataFrame:
    return ranked.withColumn("run_id", F.lit(run_id)).withColumn("pred_pos", F.col("rank").cast("int"))


def truth_positions(truth: DataFrame) -> DataFrame:
    return truth.withColumn("truth_pos", F.row_number().over(Window.orderBy("issue_id")).cast("int"))


def _ratio(a, b):
    return F.when(b > 0, a / b).otherwise(0.0)


def evaluation_metrics(predicted: DataFrame, truth: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """One row per run: counts, precision, recall, F1, noise, and the top-five measures.

    ``runs`` lists run ids, so that a run without any prediction still gets a row.
    """
    pairs = match_pairs(predicted, truth)
    tp = greedy_matches(pairs).groupBy("run_id").agg(F.count(F.lit(1)).alias("tp"))
    top = (greedy_matches(pairs.where(F.col("pred_pos") <= config.RESPONSE_TOP_ISSUES))
           .groupBy("run_id").agg(F.count(F.lit(1)).alias("hits")))
    sizes = predicted.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_pred"))
    n_truth = truth.count()
    runs = sizes.select("run_id") if runs is None else runs
    c = F.col
    zero = lambda name: F.coalesce(c(name), F.lit(0))
    joined = (runs.join(sizes, "run_id", "left").join(tp, "run_id", "left").join(top, "run_id", "left")
              .select("run_id", zero("n_pred").alias("n_pred"), zero("tp").alias("tp"),
                      zero("hits").alias("hits"), F.lit(n_truth).alias("n_truth")))
    precision, recall = _ratio(c("tp"), c("n_pred")), _ratio(c("tp"), c("n_truth"))
    top_k = F.least(F.lit(config.RESPONSE_TOP_ISSUES), c("n_pred"))
    return (joined.withColumn("p", precision).withColumn("r", recall)
            .select(
                F.col("run_id").alias("strategy"), c("tp").cast("long").alias("true_positives"),
                F.greatest(c("n_pred") - c("tp"), F.lit(0)).cast("long").alias("false_positives"),
                F.greatest(c("n_truth") - c("tp"), F.lit(0)).cast("long").alias("false_negatives"),
                F.round("p", 4).alias("precision"), F.round("r", 4).alias("recall"),
                F.round(_ratio(2 * c("p") * c("r"), c("p") + c("r")), 4).alias("f1"),
                F.round(_ratio(c("hits"), F.least(F.lit(5), c("n_truth"))), 4).alias("top_5_recall"),
                F.round(_ratio(c("n_pred") - c("tp"), c("n_pred")), 4).alias("noise_rate"),
                F.round(_ratio(c("hits"), top_k), 4).alias("summary_accuracy"),
                c("n_pred").cast("long").alias("predicted_issues"),
                c("n_truth").cast("long").alias("ground_truth_issues")))


def strategy_pivot(evaluation: DataFrame, strategies: list[str]) -> DataFrame:
    """Metric rows by strategy columns; absent values show as ``n/a``."""
    present = [m for m in METRICS if m in evaluation.columns]
    long = evaluation.select("strategy", *[F.col(m).cast("double").alias(m) for m in present]).unpivot(
        "strategy", present, "metric", "value")
    wide = long.groupBy("metric").pivot("strategy", strategies).agg(F.first("value"))
    return wide.select("metric", *[
        F.when(F.col(quote).isNotNull(), F.format_string("%.4f", F.col(quote))).otherwise("n/a").alias(s)
        for s in strategies for quote in [f"`{s}`"]])
