"""A fact that grows by batches, and reports that follow it without reading it again.

A ledger says which batches the fact has: the name, the first id and the rows of
each.  A batch counts only once its ledger entry is written, so a load that
fails midway is not seen and can be repeated; a batch that the ledger has is
not loaded twice, and a new one is numbered from the stored end.

Reports over the fact are kept as partial states per batch: counts per cell,
and for exact distinct counts a bitmap of the key numbers per cell.  States of batches are added
up and united, so after an append only the new batch's files are read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from couponmill.functions.cleaning import with_discount
from couponmill.functions.derive import day_type, is_used, ym
from couponmill.operators.filters import has
from couponmill.operators.ingest import canonical_fact, union_logs, with_input_ids
from couponmill.params import ReportParams
from couponmill.plans import export
from couponmill.plans.summary import parameter_mark
from couponmill.schema import TRANSACTIONS
from couponmill.session import Scratch, path_exists
from couponmill.sources.writers import batch_name

DEFAULTS = ReportParams()

LEDGER = T.StructType([
    T.StructField("batch", T.StringType()), T.StructField("first_id", T.LongType()), T.StructField("row_count", T.LongType()),
])


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """``batch``, ``first_id`` and ``row_count`` of every batch of the fact under ``folder``."""
    path = f"{folder}/ledger"
    if not path_exists(spark, path):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).option("recursiveFileLookup", True).parquet(path)


def append_batch(spark: SparkSession, folder: str, batch: str, logs: dict[str, DataFrame]) -> bool:
    """Add the raw ``logs`` (by source) as one batch; False, and nothing done, if the ledger has it.

    The rows get the ids after the last stored one, in input order.  One writer
    at a time: two would number from the same end.
    """
    known = {r["batch"]: r for r in ledger(spark, folder).collect()}
    if batch_name(batch) in known:
        return False
    end = max((r["first_id"] + r["row_count"] - 1 for r in known.values()), default=0)
    work = Scratch(spark)
    numbered = with_input_ids(union_logs(logs), put=work.stage)
    numbered = numbered.withColumn("transaction_id", F.col("transaction_id") + end)
    seen = Observation("batch")
    fact = canonical_fact(with_discount(numbered)).observe(seen, F.count(F.lit(1)).alias("rows"))
    ordered = fact.sortWithinPartitions("source", "date_used")
    ordered.write.mode("overwrite").partitionBy("source").parquet(_batch_folder(folder, batch))
    work.remove()
    entry = spark.createDataFrame([(batch, end + 1, seen.get["rows"])], LEDGER)
    entry.coalesce(1).write.mode("overwrite").parquet(f"{folder}/ledger/entry-{batch}")
    return True


def _batch_folder(folder: str, batch: str) -> str:
    return f"{folder}/transactions/part-{batch}"


def facts(spark: SparkSession, folder: str, batches: list[str] | None = None) -> DataFrame:
    """The fact of the given batches, by default of all that the ledger has."""
    if batches is None:
        batches = [r["batch"] for r in ledger(spark, folder).select("batch").collect()]
    parts = [spark.read.schema(TRANSACTIONS).parquet(_batch_folder(folder, b)).select(*TRANSACTIONS.names) for b in sorted(batches)]
    if not parts:
        return spark.createDataFrame([], TRANSACTIONS)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@dataclass(frozen=True)
class Partial:
    """What a report keeps of a batch.

    ``rows`` gives the batch's rows with the cell columns; ``counts`` are
    aggregates that add up over batches; ``uniques`` maps a result column to the whole-number key
    whose distinct values it counts.
    """

    name: str
    rows: Callable[[DataFrame, ReportParams], DataFrame]
    cells: tuple[str, ...]
    counts: dict[str, Column] = field(default_factory=dict)
    uniques: dict[str, str] = field(default_factory=dict)
    finish: Callable[[DataFrame, ReportParams], DataFrame] = lambda df, p: df


def _used(f: DataFrame, p: ReportParams) -> DataFrame:
    return has(f, "date_used").withColumns({"year_month": ym("date_used"), "day_type": day_type("date_used")})


def _labelled(f: DataFrame, p: ReportParams) -> DataFrame:
    received = export.with_derived(has(f, "date_received"), p)
    return received.withColumn("has_coupon", F.col("coupon_id").isNotNull())


def partials() -> dict[str, Partial]:
    """The reports kept as states, by name."""
    used = {"used_count": F.count("*")}
    of_received = {"total_count": F.count("*"), "used_count": F.count_if(is_used())}
    people = {"unique_users": "user_id", "unique_merchants": "merchant_id"}
    return {
        "monthly": Partial("monthly", _used, ("year_month",), used, people, lambda df, p: export.monthly_of(df)),
        "day_type": Partial("day_type", _used, ("day_type",), used, {"unique_users": "user_id"}, lambda df, p: df.orderBy("day_type")),
        "labels": Partial("labels", _labelled, export.CUBE_KEYS, of_received),
    }


def state_of(f: DataFrame, spec: Partial, p: ReportParams = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """Counts per cell of ``f``, and its key sets as one bitmap per cell, result column and run of 32,768 key numbers."""
    rows = spec.rows(f, p)
    counts = rows.groupBy(*spec.cells).agg(*[c.alias(n) for n, c in spec.counts.items()])
    stacked = F.explode(F.array(*[F.struct(F.lit(n).alias("unique"), F.col(k).cast("long").alias("key")) for n, k in spec.uniques.items()]))
    if not spec.uniques:
        return counts, rows.select(*spec.cells, F.lit("").alias("unique"), F.lit(0).cast("long").alias("run"), F.lit(b"").alias("bits")).limit(0)
    keys = rows.select(*spec.cells, stacked.alias("_k")).select(*spec.cells, "_k.unique", "_k.key").where("key IS NOT NULL")
    sets = keys.groupBy(*spec.cells, "unique", F.bitmap_bucket_number("key").alias("run")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("key")).alias("bits")
    )
    return counts, sets


def merged(counts: DataFrame, sets: DataFrame, spec: Partial) -> DataFrame:
    """The report's counts from the states of several batches."""
    zero = F.lit(0).cast("long")
    summed = counts.select(*spec.cells, *spec.counts, *[zero.alias(n) for n in spec.uniques])
    if spec.uniques:
        united = sets.groupBy(*spec.cells, "unique", "run").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("n"))
        of = [F.when(F.col("unique") == n, F.col("n")).otherwise(0).alias(n) for n in spec.uniques]
        summed = summed.unionByName(united.select(*spec.cells, *[zero.alias(n) for n in spec.counts], *of))
    return summed.groupBy(*spec.cells).agg(*[F.sum(n).alias(n) for n in (*spec.counts, *spec.uniques)])


def _state_folder(folder: str, spec: Partial, p: ReportParams, batch: str) -> str:
    return f"{folder}/partials/{parameter_mark(p)[:16]}/{spec.name}/part-{batch}"


def update_states(spark: SparkSession, folder: str, name: str, p: ReportParams = DEFAULTS) -> list[str]:
    """Build the states that batches of the fact lack; returns these batches.

    A state is complete once its counts are written, which come last.  Only the files of batches
    without one are read.  States are kept per set of parameters.
    """
    spec, built = partials()[name], []
    for batch in sorted(r["batch"] for r in ledger(spark, folder).select("batch").collect()):
        target = _state_folder(folder, spec, p, batch)
        if not path_exists(spark, f"{target}/counts/_SUCCESS"):
            counts, sets = state_of(facts(spark, folder, [batch]), spec, p)
            sets.write.mode("overwrite").parquet(f"{target}/sets")
            counts.write.mode("overwrite").parquet(f"{target}/counts")
            built.append(batch)
    return built


def report(spark: SparkSession, folder: str, name: str, p: ReportParams = DEFAULTS) -> DataFrame:
    """A report over all batches of the fact (``monthly``, ``day_type`` or ``labels``), from the states of its batches."""
    spec = partials()[name]
    update_states(spark, folder, name, p)
    targets = [_state_folder(folder, spec, p, r["batch"]) for r in ledger(spark, folder).select("batch").collect()]
    if not targets:
        counts, sets = state_of(facts(spark, folder), spec, p)
    else:
        counts = spark.read.parquet(*[f"{t}/counts" for t in targets])
        sets = spark.read.parquet(*[f"{t}/sets" for t in targets])
    return spec.finish(merged(counts, sets, spec), p)
