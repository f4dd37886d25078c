"""Stores for snapshots, ranked issues, ground truth, evaluations, run logs and reports."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from datetime import datetime, timezone
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewarden.runtime import local_frame
from tablewarden.schemas import EVALUATION, RANKED, RUN_LOG, SNAPSHOT, TRUTH


def _read(spark: SparkSession, path: str, schema: T.StructType, fmt: str, **options) -> DataFrame | None:
    """The stored rows, or None where nothing has been written."""
    try:
        return spark.read.schema(schema).options(**options).format(fmt).load(path)
    except Exception as error:            # noqa: BLE001
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise


def save_snapshot(snapshot: DataFrame, path: str) -> None:
    """Replaces the snapshot's own tags and leaves other tags alone."""
    (snapshot.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("tag").parquet(path))


def load_snapshot(spark: SparkSession, path: str, tag: str = "baseline") -> DataFrame | None:
    stored = _read(spark, path, SNAPSHOT, "parquet")
    if stored is None:
        return None
    mine = stored.where(F.col("tag") == tag).select(*SNAPSHOT.names)
    return None if mine.isEmpty() else mine


def _folder_of(path: str, source: str) -> str:
    return f"{path}/source={quote(source, safe='')}"


def write_ranked(ranked: DataFrame, path: str, source: str) -> None:
    """A folder for each source name, replaced as a whole, also by a run without issues; other sources stay."""
    ranked.drop("source").write.mode("overwrite").json(_folder_of(path, source))


def load_ranked(spark: SparkSession, path: str, source: str) -> DataFrame:
    """The issues of the last run of a source; none if it never ran or found nothing."""
    found = _read(spark, _folder_of(path, source), RANKED, "json")
    return (local_frame(spark, [], RANKED) if found is None else found).withColumn("source", F.lit(source))


def run_entry(spark: SparkSession, source: str, sensitivity: str, issue_count: int,
              trace: list[str], run_id: str | None = None,
              failures: Iterable[tuple[str, str]] = ()) -> DataFrame:
    """One line of the run log; ``failures`` are checks that did not come to an end, with their errors."""
    row = (run_id or uuid.uuid4().hex[:12], source, sensitivity, datetime.now(timezone.utc).isoformat(),
           issue_count, trace, [f"{check}: {error}" for check, error in failures])
    return local_frame(spark, [row], RUN_LOG)


def append_run(entry: DataFrame, path: str) -> None:
    entry.coalesce(1).write.mode("append").json(path)


def run_log(spark: SparkSession, path: str) -> DataFrame:
    """All readable entries; blank and malformed lines are left out."""
    found = _read(spark, path, RUN_LOG, "json", mode="DROPMALFORMED")
    return local_frame(spark, [], RUN_LOG) if found is None else found.where("run_id IS NOT NULL")


def get_run(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    return run_log(spark, path).where(F.col("run_id") == run_id)


def run_history(spark: SparkSession, path: str) -> DataFrame:
    """Entries, newest first."""
    return (run_log(spark, path)
            .withColumn("agent_trace", F.array_join("agent_trace", " -> "))
            .orderBy(F.desc("timestamp"), "run_id"))


def write_truth(truth: DataFrame, path: str) -> None:
    truth.coalesce(1).write.mode("overwrite").json(path)


def load_truth(spark: SparkSession, path: str) -> DataFrame:
    found = _read(spark, path, TRUTH, "json")
    if found is None:
        raise FileNotFoundError(f"no ground truth at {path}; run the injection first")
    return found


def write_evaluation(evaluation: DataFrame, path: str) -> None:
    evaluation.coalesce(1).write.mode("overwrite").json(path)


def load_evaluation(spark: SparkSession, path: str) -> DataFrame:
    found = _read(spark, path, EVALUATION, "json")
    return local_frame(spark, [], EVALUATION) if found is None else found


def write_report(lines: DataFrame, path: str, source: str) -> None:
    """Markdown as one ordered text file per source (a report has a few lines per issue)."""
    (lines.orderBy("section", "rank", "line_no").select("text").coalesce(1)
     .write.mode("overwrite").text(f"{path.rstrip('/')}/triage_report_{source}"))
