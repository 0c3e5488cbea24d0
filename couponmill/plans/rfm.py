"""RFM user segmentation, by tiles or by quantile bins.

The per-user frame is computed once and staged.  Tiles and bins need only the
few users on a boundary, so no ranked copy of the users is shuffled back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from couponmill.functions.derive import is_used, recency, rfm_combine, rfm_segment, rfm_sub_segment
from couponmill.functions.measures import mean_of
from couponmill.functions.sqltext import identifier
from couponmill.operators.filters import having, train_only
from couponmill.operators.ordering import ntile_columns, quantile_bin, quantile_edges
from couponmill.operators.windows import share
from couponmill.params import RFM_FALLBACK_SCORE, RFM_TILES, ReportParams
from couponmill.session import stage
from couponmill.sources.writers import materialize

DEFAULTS = ReportParams()


def user_base(f: DataFrame, p: ReportParams = DEFAULTS) -> DataFrame:
    """Last use, active days, uses, receipts and mean discounts per user."""
    return train_only(f, p.training_sources).groupBy("user_id").agg(
        F.max("date_used").alias("last_used_date"),
        F.count_distinct("date_used").alias("active_days"),
        F.count("date_used").alias("frequency"),
        F.count("date_received").alias("total_received"),
        mean_of("discount_eq_rate", 4, is_used()).alias("avg_discount"),
        mean_of("discount_man", 2, is_used()).alias("avg_threshold"),
    )


def rfm_inputs(f: DataFrame, p: ReportParams = DEFAULTS) -> DataFrame:
    """Inputs of the scores for every user with at least one use.

    All RFM reports can start from one stored copy of this frame.
    """
    base = train_only(f, p.training_sources).groupBy("user_id").agg(
        F.max("date_used").alias("last_used_date"),
        F.count("date_used").alias("frequency"),
        F.coalesce(mean_of("discount_man", 2, is_used()), F.lit(0)).alias("avg_monetary"),
        F.coalesce(mean_of("discount_man", 6, is_used()), F.lit(0)).alias("mean_threshold"),
        F.count("date_received").alias("total_received"),
    )
    return having(base, "frequency > 0").withColumn(
        "recency_days", recency("last_used_date", p.ref_date, p.default_date)
    )


def rfm_scored(inputs: DataFrame, metrics: tuple[str, ...] = ("recency_days", "frequency", "avg_monetary")) -> DataFrame:
    """Tile scores 1-5, 5 being best; ties are broken by user.

    ``inputs`` is read several times and should be staged.
    """
    tiles = ntile_columns(inputs, RFM_TILES, list(metrics), ["user_id"])
    names = {"recency_days": "r_score", "frequency": "f_score", "avg_monetary": "m_score"}
    return inputs.withColumns({
        names[m]: (RFM_TILES + 1 - tile if m == "recency_days" else tile) for m, tile in tiles.items()
    })


def _scored(f: DataFrame, p: ReportParams) -> DataFrame:
    return rfm_scored(stage(rfm_inputs(f, p).drop("mean_threshold")))


def rfm_users(f: DataFrame, p: ReportParams = DEFAULTS, scored: DataFrame | None = None) -> DataFrame:
    """Every redeeming user with scores, totals, segment and sub-segment."""
    return (
        (_scored(f, p) if scored is None else scored)
        .withColumns(rfm_combine())
        .select(
            "user_id", "recency_days", "frequency", F.col("avg_monetary").alias("monetary"), "total_received",
            "r_score", "f_score", "m_score", "rfm_total", "rfm_cell", "rfm_weighted",
            rfm_segment().alias("user_segment"), rfm_sub_segment().alias("user_sub_segment"),
        )
        .orderBy(F.desc("rfm_weighted"), "user_id")
    )


def rfm_segments(f: DataFrame, p: ReportParams = DEFAULTS, scored: DataFrame | None = None) -> DataFrame:
    """Users per segment and their share."""
    if scored is None:
        inputs = stage(rfm_inputs(f, p).select("user_id", "recency_days", "frequency"))
        scored = rfm_scored(inputs, ("recency_days", "frequency"))
    return share(segment_counts(scored.select(rfm_segment().alias("segment")), "segment"), "user_count").orderBy(
        F.desc("user_count"), "segment"
    )


def segment_counts(df: DataFrame, c: str = "user_segment") -> DataFrame:
    """Users per segment."""
    return df.groupBy(c).agg(F.count("*").alias("user_count"))


def rfm_view(f: DataFrame, p: ReportParams = DEFAULTS, scored: DataFrame | None = None) -> DataFrame:
    """The columns of the RFM view."""
    return (
        (_scored(f, p) if scored is None else scored)
        .withColumn("rfm_total", rfm_combine()["rfm_total"])
        .select(
            "user_id", "last_used_date", "frequency", "avg_monetary", "total_received", "recency_days",
            "r_score", "f_score", "m_score", "rfm_total", rfm_segment().alias("user_segment"),
        )
    )


def register_rfm_view(f: DataFrame, name: str = "v_user_rfm", p: ReportParams = DEFAULTS) -> DataFrame:
    """Create or replace the RFM view, over a table of its rows.

    The tiles are found without a global task, which a view's SQL could not do,
    so the rows are stored and no scratch file is needed later.  The view shows the
    fact as it was at the last call; loading the tables calls it.
    """
    rows = f"{name}_rows"
    materialize(rfm_view(f, p), rows)
    f.sparkSession.sql(f"CREATE OR REPLACE VIEW {identifier(name)} AS SELECT * FROM {identifier(rows)}")
    return f.sparkSession.table(name)


def rfm_qcut(
    f: DataFrame, p: ReportParams = DEFAULTS, compat: bool = False, inputs: DataFrame | None = None
) -> DataFrame:
    """RFM with quantile-bin scores; a score whose edges repeat is 3 for everyone.

    Recent users score 5.  ``compat`` scores them 1, as published results do.
    """
    users = (stage(rfm_inputs(f, p)) if inputs is None else inputs).select(
        "user_id", "last_used_date", "frequency", F.col("mean_threshold").alias("avg_monetary"), "total_received",
        "recency_days",
    )
    metrics = ["recency_days", "frequency", "avg_monetary"]
    edges = quantile_edges(users, metrics, ["user_id"], RFM_TILES)
    bins = {m: quantile_bin(m, edges[m], None) for m in metrics}
    if not compat:
        bins["recency_days"] = RFM_TILES + 1 - bins["recency_days"]
    fallback = F.lit(RFM_FALLBACK_SCORE)
    return (
        users.withColumns({
            "r_score": F.coalesce(bins["recency_days"], fallback),
            "f_score": F.coalesce(bins["frequency"], fallback),
            "m_score": F.coalesce(bins["avg_monetary"], fallback),
        })
        .withColumn("rfm_total", rfm_combine()["rfm_total"])
        .withColumn("user_segment", rfm_segment())
    )


def rfm_qcut_segments(
    f: DataFrame, p: ReportParams = DEFAULTS, compat: bool = False, inputs: DataFrame | None = None
) -> DataFrame:
    """Users per quantile-bin segment and their share."""
    return share(segment_counts(rfm_qcut(f, p, compat, inputs)), "user_count", half_even=True).orderBy(
        F.desc("user_count"), "user_segment"
    )
