"""Row layouts shared by the operators."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

TEXTS = T.ArrayType(T.StringType())
DOUBLES = T.ArrayType(T.DoubleType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


ISSUE = _struct(
    issue_id=T.StringType(), issue_type=T.StringType(), table=T.StringType(),
    columns=TEXTS, severity=T.StringType(), metric=T.DoubleType(),
    evidence_rows=T.LongType(), description=T.StringType(),
    dim_table=T.StringType(), dim_pk=T.StringType(),
)

#: A ranked issue as stored; the counts are null where nothing was counted again.
RANKED = T.StructType([*ISSUE.fields, *_struct(
    sql_count=T.LongType(), pd_count=T.LongType(), confidence=T.DoubleType(), affected_reports=TEXTS,
    base_weight=T.DoubleType(), severity_weight=T.DoubleType(), evidence_density=T.DoubleType(),
    report_criticality=T.DoubleType(), score_breakdown=T.StringType(), impact_score=T.DoubleType(),
    rank=T.IntegerType(),
).fields])

PROFILE = _struct(
    table=T.StringType(), table_pos=T.IntegerType(), column=T.StringType(),
    col_pos=T.IntegerType(), dtype=T.StringType(), n_rows=T.LongType(),
    n_null=T.LongType(), n_future=T.LongType(), min=T.DoubleType(),
    max=T.DoubleType(), mean=T.DoubleType(), std=T.DoubleType(), n_about=T.LongType(),
)

TRUTH = _struct(
    issue_id=T.StringType(), issue_type=T.StringType(), table=T.StringType(),
    columns=TEXTS, row_count=T.LongType(), severity=T.StringType(),
    business_area=T.StringType(), intended_report_impact=T.StringType(),
    parameters=T.MapType(T.StringType(), T.StringType()),
)

SNAPSHOT = _struct(
    tag=T.StringType(), table=T.StringType(), column=T.StringType(),
    dtype=T.StringType(), n_rows=T.LongType(), n_null=T.LongType(),
    mean=T.DoubleType(), std=T.DoubleType(), min=T.DoubleType(), max=T.DoubleType(),
    p25=T.DoubleType(), p50=T.DoubleType(), p75=T.DoubleType(), p95=T.DoubleType(),
    q_probs=DOUBLES, q_values=DOUBLES,
    hist_counts=T.ArrayType(T.LongType()), hist_edges=DOUBLES,
    top_value_fracs=T.MapType(T.StringType(), T.DoubleType()),
)

RUN_LOG = _struct(
    run_id=T.StringType(), source=T.StringType(), sensitivity=T.StringType(),
    timestamp=T.StringType(), issue_count=T.IntegerType(), agent_trace=TEXTS, failures=TEXTS,
)

EVALUATION = _struct(
    strategy=T.StringType(), true_positives=T.LongType(), false_positives=T.LongType(),
    false_negatives=T.LongType(), precision=T.DoubleType(), recall=T.DoubleType(),
    f1=T.DoubleType(), top_5_recall=T.DoubleType(), noise_rate=T.DoubleType(),
    summary_accuracy=T.DoubleType(), predicted_issues=T.LongType(),
    ground_truth_issues=T.LongType(), wall_seconds=T.DoubleType(), error=T.StringType(),
)


@dataclass(frozen=True)
class TableMeta:
    """What a table is, and which of its columns are keys, dates, measures."""

    role: str
    entity: str = ""
    primary_keys: tuple[str, ...] = ()
    #: fact column -> (dimension table, dimension key)
    foreign_keys: dict[str, tuple[str, str]] = field(default_factory=dict)
    date_cols: tuple[str, ...] = ()
    numeric_cols: tuple[str, ...] = ()
    promo_cols: tuple[str, ...] = ()

    @property
    def is_fact(self) -> bool:
        return self.role == "fact"
