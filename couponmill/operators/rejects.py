"""What a load could not read: broken lines and values that were set to NULL, counted in the pass that loads them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from couponmill.functions.cleaning import MISSING_TOKENS, action_name, parse_day, parse_num, with_discount
from couponmill.operators.ingest import canonical, canonical_fact, clean_log, union_logs, with_input_ids
from couponmill.operators.integrity import discount_losses
from couponmill.session import stage
from couponmill.sources.readers import BROKEN_LINE


def lost_values(df: DataFrame) -> dict[str, Column]:
    """For each field that is parsed leniently: true where a value is given but cannot be read.

    ``df`` has the raw columns under their star-schema names.
    """
    parsed = {
        "date_received": parse_day("date_received"),
        "date_used": parse_day("date_used"),
        "distance": parse_num("distance").try_cast("int"),
        "action": action_name("action"),
    }
    given = {c: F.col(c).isNotNull() for c in ("date_received", "date_used", "action")}
    given["distance"] = ~F.col("distance").isin(*MISSING_TOKENS)
    return {c: given[c] & value.isNull() for c, value in parsed.items() if c in df.columns}


@dataclass
class Rejects:
    """Counts of one load, there once its rows have been written."""

    seen: dict[str, Observation] = field(default_factory=dict)

    def clean(self, df: DataFrame, source: str) -> DataFrame:
        """``clean_log`` that counts lines, broken lines and lost values, and leaves the broken lines out."""
        named = canonical(df)
        whole = F.col(BROKEN_LINE).isNull() if BROKEN_LINE in df.columns else F.lit(True)
        counts = {"lines": F.count(F.lit(1)), "broken_lines": F.count_if(~whole)}
        counts |= {c: F.count_if(whole & lost) for c, lost in lost_values(named).items()}
        self.seen[source] = Observation(f"rejects_{source}")
        seen = named.observe(self.seen[source], *[c.alias(n) for n, c in counts.items()]).where(whole)
        if "_seq" in seen.columns:
            # Count on without the broken lines, so that ids have no gaps.
            seen = seen.withColumn("_seq", F.monotonically_increasing_id())
        return clean_log(seen.drop(BROKEN_LINE), source)

    def discounts(self, df: DataFrame) -> DataFrame:
        """Count the discounts that do not fit the declared decimals, as ``df`` passes."""
        self.seen["discounts"] = Observation("rejects_discounts")
        counts = [F.count_if(lost).alias(n) for n, lost in discount_losses().items()]
        return df.observe(self.seen["discounts"], *counts)

    def table(self, spark: SparkSession) -> DataFrame:
        """``source``, ``field`` and ``row_count``; discounts are counted over all sources."""
        rows = [(source, name, int(n or 0)) for source, seen in self.seen.items() for name, n in seen.get.items()]
        return spark.createDataFrame(rows, "source string, field string, row_count long")


def build_fact_counted(
    logs: dict[str, DataFrame], put: Callable[[DataFrame], DataFrame] = stage
) -> tuple[DataFrame, DataFrame]:
    """The transactions fact of the raw logs and the table of what was lost on the way.

    Logs read with ``keep_broken`` go on past broken lines.  Every count comes from the
    jobs that write the rows; no log is read a second time.
    """
    rejects = Rejects()
    numbered = with_input_ids(union_logs(logs, rejects.clean), put=put)
    # Written so that the counts of the discounts are complete.
    fact = put(canonical_fact(rejects.discounts(with_discount(numbered))))
    return fact, rejects.table(fact.sparkSession)
