"""Pipelines: triage, ad-hoc triage, snapshot, inject, evaluate, analyze.

A pipeline composes the operators.  What reaches the driver is metadata: a profile row per
column, a few bounds, and issue rows.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden.operators import checks, drift, evaluate, inject, narrate, verify
from tablewarden.operators.metadata import infer_metadata, key_columns
from tablewarden.operators.profile import Tables, profile_tables, table_sizes
from tablewarden.operators.rank import rank_issues
from tablewarden.operators.snapshot import build_snapshot
from tablewarden.runtime import local_copy, local_frame, union_all
from tablewarden.schemas import EVALUATION, TableMeta
from tablewarden.sources import stores, tables as table_source

log = logging.getLogger(__name__)
STRATEGIES = {"A_baseline": (False, False), "B_supervisor": (True, False), "C_full": (True, True)}


@dataclass
class TriageResult:
    ranked: DataFrame
    issues: DataFrame
    meta: dict[str, TableMeta]
    sizes: dict[str, int]
    trace: list[str]
    timing: dict[str, float]
    failures: list[tuple[str, str]] = field(default_factory=list)

    def report(self, source: str, sensitivity: str) -> DataFrame:
        return narrate.report_lines(self.ranked, source, sensitivity, self.trace, self.timing, failures=self.failures)


def _profile(tables: Tables, meta: Mapping[str, TableMeta] | None, compared: bool) -> DataFrame:
    """What the checks, the comparison with a baseline and the inference of keys need, and no more."""
    inferred = meta is None or any(t not in meta for t in tables)
    return profile_tables(tables, meta, checks.NEEDS + (("moments",) if compared else ()), key_columns(tables) if inferred else None)


class Stages:
    """The steps of a triage over one set of tables.  Each runs when first asked for and its result is kept, with its seconds or
    its error, so that several compositions share them."""

    def __init__(self, tables: Tables, meta: Mapping[str, TableMeta] | None = None, sensitivity: str = "high",
                 snapshot: DataFrame | None = None, baseline: Tables | None = None, profile: DataFrame | None = None):
        self.tables, self.given, self.sensitivity = tables, meta, sensitivity
        self.snapshot, self.baseline, self.given_profile = snapshot, baseline, profile
        self.results: dict[str, object] = {}
        self.seconds: dict[str, float] = {}

    @property
    def compared(self) -> bool:
        return self.snapshot is not None or self.baseline is not None

    def get(self, name: str):
        if name not in self.results:
            before, start = sum(self.seconds.values()), time.perf_counter()
            try:
                self.results[name] = getattr(self, f"_{name}")()
            except Exception as error:        # noqa: BLE001 - every composition that needs this stage meets the error
                self.results[name] = error
            spent = time.perf_counter() - start - (sum(self.seconds.values()) - before)       # without stages asked for inside
            self.seconds[name] = round(spent, 3)
        if isinstance(self.results[name], Exception):
            raise self.results[name]
        return self.results[name]

    def _profiler(self) -> DataFrame:
        return _profile(self.tables, self.given, self.compared) if self.given_profile is None else self.given_profile

    def _metadata(self) -> dict[str, TableMeta]:
        return infer_metadata(self.tables, self.get("profiler"), self.given)

    def _detector(self) -> tuple[DataFrame, list[tuple[str, str]]]:
        return checks.run_checks(self.tables, self.get("metadata"), self.sensitivity, self.get("profiler"))

    def _drift_detector(self) -> DataFrame:
        return local_copy(drift.detect_drift(self.tables, self.get("metadata"), self.get("profiler"), self.snapshot, self.baseline))

    def _verifier(self) -> DataFrame:
        return local_copy(verify.verify_issues(self.tables, self.get("detector")[0], self.sensitivity))

    def _drift_verifier(self) -> DataFrame:
        return local_copy(verify.verify_issues(self.tables, self.get("drift_detector"), self.sensitivity))


def run_triage(tables: Tables, meta: Mapping[str, TableMeta] | None = None, sensitivity: str = "high",
               snapshot: DataFrame | None = None, baseline: Tables | None = None,
               with_verification: bool = True, with_drift: bool = True,
               decision: str | None = None, profile: DataFrame | None = None, strict: bool = False,
               stages: Stages | None = None) -> TriageResult:
    """Infer, check, compare with the baseline, re-count, review, rank.

    A check that fails leaves the others alone and is named in ``failures``; with ``strict`` it is an error.  ``stages``, if given,
    holds results that other runs over the same tables share; it then says what is triaged.
    """
    stages = stages or Stages(tables, meta, sensitivity, snapshot, baseline, profile)
    trace: list[str] = []
    timing: dict[str, float] = {}

    def step(name: str):
        out = stages.get(name)
        trace.append(name)
        timing[name] = stages.seconds[name]
        return out

    def own(name: str, build):
        start = time.perf_counter()
        out = build()
        trace.append(name)
        timing[name] = round(time.perf_counter() - start, 3)
        return out

    profile, meta = step("profiler"), step("metadata")
    sizes = table_sizes(profile)
    issues, failures = step("detector")
    if strict and failures:
        raise RuntimeError("checks failed: " + "; ".join(f"{check}: {error}" for check, error in failures))
    compared = with_drift and stages.compared
    if compared:
        issues = issues.unionByName(step("drift_detector"))
    reviewed = issues
    if with_verification:
        reviewed = step("verifier")
        if compared:                                              # a re-count looks at one issue at a time
            reviewed = local_copy(reviewed.unionByName(stages.get("drift_verifier")))
            timing["verifier"] = round(timing["verifier"] + stages.seconds["drift_verifier"], 3)
        if decision is not None and reviewed.agg(verify.needs_review(reviewed)).first()[0]:
            reviewed = own("review", lambda: verify.apply_decision(reviewed, decision))
    ranked = own("ranker", lambda: local_copy(rank_issues(reviewed, sizes)))
    return TriageResult(ranked, issues, meta, sizes, trace, timing, failures)


def triage(tables: Tables, **options) -> DataFrame:
    """Ranked issues of a set of tables.  A failing check is an error, as no report could name it here."""
    return run_triage(tables, **{"strict": True, **options}).ranked


def adhoc_triage(tables: Tables, baseline: Tables | None = None) -> DataFrame:
    """Uploaded tables at high sensitivity; a baseline is compared through its snapshot."""
    snapshot = build_snapshot(baseline) if baseline else None
    return triage(tables, sensitivity="high", snapshot=snapshot)


def analyze(tables: Tables, run_id: str = "run", **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ranked issues, their explanations, and the executive summary."""
    ranked = triage(tables, **options)
    runs = local_frame(ranked.sparkSession, [(run_id,)], "run_id string")
    return (ranked, narrate.explain(ranked),
            narrate.executive_summary(ranked.withColumn("run_id", F.lit(run_id)), runs))


# --------------------------------------------------------------------------------------
# Pipelines with files
# --------------------------------------------------------------------------------------

def triage_source(spark: SparkSession, source: str, folders: Mapping[str, str], out: str,
                  sensitivity: str = "high", snapshot_path: str | None = None,
                  snapshot_tag: str = "baseline", decision: str | None = None) -> TriageResult:
    """Triage of a named source with report, ranked issues and a run-log line."""
    tables = table_source.load_source(spark, source, folders)
    snapshot = stores.load_snapshot(spark, snapshot_path, snapshot_tag) if snapshot_path else None
    if snapshot is None:
        log.warning("no snapshot %s; drift is skipped", snapshot_tag)
    result = run_triage(tables, sensitivity=sensitivity, snapshot=snapshot, decision=decision)
    stores.write_report(result.report(source, sensitivity), out, source)
    stores.write_ranked(result.ranked, f"{out}/ranked_issues", source)
    entry = stores.run_entry(spark, source, sensitivity, result.ranked.count(), result.trace,
                             failures=result.failures)
    stores.append_run(entry, f"{out}/run_log")
    return result


def snapshot_source(spark: SparkSession, folders: Mapping[str, str], path: str, tag: str = "baseline") -> DataFrame:
    snapshot = build_snapshot(table_source.load_source(spark, "clean", folders), tag)
    stores.save_snapshot(snapshot, path)
    return snapshot


def inject_source(spark: SparkSession, folders: Mapping[str, str], truth_path: str, seed: int = 42) -> DataFrame:
    """Clean tables with defects written to the injected folder, and their ground truth."""
    tables, truth = inject.inject_issues(table_source.load_source(spark, "clean", folders), seed=seed)
    table_source.write_tables(tables, folders["injected"])
    stores.write_truth(truth, truth_path)
    return truth


def evaluate_tables(tables: Tables, truth: DataFrame, snapshot: DataFrame | None = None,
                    sensitivity: str = "normal", meta: Mapping[str, TableMeta] | None = None) -> DataFrame:
    """Strategies A (checks), B (+ re-count) and C (+ drift) scored against the truth.

    Stages run once and are shared; a strategy's seconds are those of the stages it is made of.  A failing strategy becomes
    a row with its error.
    """
    spark = truth.sparkSession
    stages = Stages(tables, meta, sensitivity, snapshot)
    truth = local_copy(evaluate.truth_positions(truth))
    predicted, seconds, errors = [], {}, {}
    for name, (verified, drifted) in STRATEGIES.items():
        start = time.perf_counter()
        try:
            result = run_triage(tables, with_verification=verified, with_drift=drifted, strict=True, stages=stages)
            predicted.append(evaluate.positions(result.ranked, name).select("run_id", "pred_pos", "issue_type", "table", "columns"))
            seconds[name] = round(sum(result.timing.values()), 3)
        except Exception as error:        # noqa: BLE001 - report the strategy, keep the others
            log.exception("strategy %s failed", name)
            errors[name] = str(error)
            seconds[name] = round(time.perf_counter() - start, 3)
    rows: list[tuple] = []
    if predicted:
        runs = local_frame(spark, [(n,) for n in STRATEGIES if n not in errors], "run_id string")
        for r in evaluate.evaluation_metrics(union_all(predicted), truth, runs).collect():
            rows.append((*r, seconds[r["strategy"]], None))
    rows += [(n, *[None] * 11, seconds[n], e) for n, e in errors.items()]
    return local_frame(spark, sorted(rows), EVALUATION)


def evaluate_source(spark: SparkSession, folders: Mapping[str, str], truth_path: str, out: str,
                    snapshot_path: str | None = None) -> DataFrame:
    tables = table_source.load_source(spark, "injected", folders)
    snapshot = stores.load_snapshot(spark, snapshot_path) if snapshot_path else None
    result = evaluate_tables(tables, stores.load_truth(spark, truth_path), snapshot)
    stores.write_evaluation(result, out)
    return result
