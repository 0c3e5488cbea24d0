"""Derived columns: buckets, calendar parts, labels, RFM rules."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from couponmill.functions.sqltext import literal
from couponmill.params import (
    DAY_UNKNOWN,
    RFM_WEIGHTS,
    SEGMENT_DEFAULT,
    SEGMENT_RULES,
    SUB_SEGMENT_DEFAULT,
    SUB_SEGMENT_RULES,
    TYPE_LABEL_DEFAULT,
    TYPE_LABELS,
    WEEKDAY,
    WEEKEND,
    BucketSpec,
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _case_sql(rules: list[tuple[str, str]], default: str) -> str:
    arms = " ".join(f"WHEN {cond} THEN {literal(label)}" for cond, label in rules)
    return f"CASE {arms} ELSE {default} END"


def _case(rules: list[tuple[str, str]], default: str) -> Column:
    """First matching condition wins; ``default`` is SQL text, labels are plain text."""
    return F.expr(_case_sql(rules, default))


def bucket(c: str, spec: BucketSpec) -> Column:
    """Label of the first rung of ``spec`` that the value of ``c`` (SQL text) meets."""
    rules = [(f"({c}) IS NULL", spec.missing)]
    if spec.negative is not None:
        rules.append((f"({c}) < 0", spec.negative))
    rules += [(f"({c}) = {v}", label) for v, label in spec.exact]
    rules += [(f"({c}) <= {edge}", label) for edge, label in spec.upper]
    return _case(rules, literal(spec.above))


# SQL text for ``bucket``: days from receipt to use, and the threshold of a fixed reduction.
GAP_DAYS = "datediff(date_used, date_received)"
FIXED_THRESHOLD = "CASE WHEN discount_type = 'fixed' THEN discount_man END"


def is_used(c: Column | str = "date_used") -> Column:
    return _col(c).isNotNull()


def is_received(c: Column | str = "date_received") -> Column:
    return _col(c).isNotNull()


def gap_days() -> Column:
    """Days from receipt to use."""
    return F.expr(GAP_DAYS)


def day_type(c: Column | str, null_label: str | None = DAY_UNKNOWN) -> Column:
    """Weekend or weekday; ``null_label`` for a missing date."""
    day = _col(c)
    known = F.when(F.dayofweek(day).isin(1, 7), WEEKEND).otherwise(WEEKDAY)
    return F.when(day.isNull(), F.lit(null_label)).otherwise(known)


def type_label(c: str, labels: dict[str, str] | None = None, default: str = literal(TYPE_LABEL_DEFAULT)) -> Column:
    """Display name of a discount type; ``default`` is SQL text."""
    return _case([(f"{c} = {literal(k)}", v) for k, v in (labels or TYPE_LABELS).items()], default)


def ym(c: Column | str) -> Column:
    """Year and month as ``yyyy-MM``."""
    return F.date_format(_col(c), "yyyy-MM")


def year_week(c: Column | str) -> Column:
    """ISO year and week as one number, e.g. 201553."""
    day = _col(c)
    return F.extract(F.lit("YEAROFWEEK"), day) * 100 + F.weekofyear(day)


def recency(c: Column | str, ref: date, default: date) -> Column:
    """Days from the last use (``default`` when never used) to ``ref``."""
    return F.datediff(F.lit(ref), F.coalesce(_col(c), F.lit(default)))


def _by_scores(rules: tuple, default: str) -> str:
    return _case_sql(
        [
            (f"r_score BETWEEN {r[0]} AND {r[1]} AND f_score BETWEEN {f[0]} AND {f[1]}", label)
            for label, r, f in rules
        ],
        literal(default),
    )


# SQL text of the segment, for views.
SEGMENT_SQL = _by_scores(SEGMENT_RULES, SEGMENT_DEFAULT)


def rfm_segment() -> Column:
    """One of six user segments from ``r_score`` and ``f_score``."""
    return F.expr(SEGMENT_SQL)


def rfm_sub_segment() -> Column:
    """One of eight finer labels from ``r_score`` and ``f_score``."""
    return F.expr(_by_scores(SUB_SEGMENT_RULES, SUB_SEGMENT_DEFAULT))


def rfm_combine(weights: tuple[float, float, float] = RFM_WEIGHTS) -> dict[str, Column]:
    """Total, cell text and weighted mean of the three scores."""
    scores = [F.col(n) for n in ("r_score", "f_score", "m_score")]
    return {
        "rfm_total": scores[0] + scores[1] + scores[2],
        "rfm_cell": F.concat(*[s.cast("string") for s in scores]),
        "rfm_weighted": F.round(sum((s * w for s, w in zip(scores, weights)), F.lit(0.0)), 2),
    }
