"""Global order without a global task: row numbers, tiles, quantiles, ranks.

A window with no partition keys pulls every row into one task.  The operators
here range-partition the rows on a total order instead, so that a value shared
by a third of all rows is still split by its tie-break key.  Row placement is
written down before it is counted; only per-partition counts and the few rows at the
requested positions reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce
from itertools import accumulate
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from couponmill.functions.sqltext import literal
from couponmill.session import BROADCAST_ROWS, pin, stage

# Integer and decimal metrics are compared in this type, so mixed metrics share one sort.
METRIC_TYPE = T.DecimalType(28, 6)
# The least difference of two of its values.
METRIC_STEP = Decimal("0.000001")

# monotonically_increasing_id() holds the partition above this bit, the row below it.
_PARTITION_SHIFT = 33


def sort_columns(order: list[str]) -> list[Column]:
    """Sort expressions; a leading ``-`` means descending.  NULL is the smallest value."""
    return [
        F.col(c[1:]).desc_nulls_last() if c.startswith("-") else F.col(c).asc_nulls_first()
        for c in order
    ]


def with_row_id(df: DataFrame, order: list[str], name: str = "row_id") -> DataFrame:
    """Consecutive 1..N in ``order``, which should identify a row up to exact copies.

    Copies are told apart by the input partition they come from, so that many
    copies of one row do not end up in one task.
    """
    keys = [*sort_columns(order), F.col("_from")]
    placed = (
        df.withColumn("_from", F.spark_partition_id())
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .drop("_from")
    )
    return with_position(placed, name)


def with_position(df: DataFrame, name: str = "position") -> DataFrame:
    """Consecutive 1..N in the order that ``df`` has, partition after partition; nothing is sorted or moved."""
    placed = stage(df.withColumn("_pos", F.monotonically_increasing_id()))
    part = F.shiftright("_pos", _PARTITION_SHIFT).alias("_part")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition, of which there are at most spark.sql.shuffle.partitions after a sort.
    offsets = (
        placed.groupBy(part)
        .agg(F.count("*").alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    local = F.col("_pos").bitwiseAND(F.lit((1 << _PARTITION_SHIFT) - 1))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .select(*df.columns, (F.col("_offset") + local + 1).alias(name))
    )


@dataclass(frozen=True)
class OrderStatistics:
    """Row count and the ordering tuples ``(value, *tie)`` found at each position."""

    rows: int
    at: dict[int, tuple]


def _check_metrics(df: DataFrame, metrics: list[str]) -> None:
    """Only types that METRIC_TYPE holds without rounding."""
    for m in metrics:
        kind = df.schema[m].dataType
        exact = isinstance(kind, T.IntegralType) or (isinstance(kind, T.DecimalType) and kind.scale <= METRIC_TYPE.scale)
        if not exact:
            raise TypeError(f"{m}: {kind.simpleString()} cannot be ordered exactly, cast it to an integer or decimal")


# Relative rank error of the sketches that bracket wanted positions is one over this.
SKETCH_ACCURACY = 2_000


def _stacked(df: DataFrame, metrics: list[str], *others: str) -> DataFrame:
    """One row per row and metric: ``metric`` (its number), ``value`` and the other columns."""
    pairs = [F.struct(F.lit(i).alias("metric"), F.col(m).cast(METRIC_TYPE).alias("value")) for i, m in enumerate(metrics)]
    return df.select(F.explode(F.array(*pairs)).alias("_m"), *others).select("_m.metric", "_m.value", *others)


def _found_at(
    rows: DataFrame, group: list[str], order: list[str], wanted: dict[tuple, list[int]], weight: str | None = None
) -> dict[tuple, dict[int, Row]]:
    """The rows at 0-based positions of ``order`` within each group.

    A row with a ``weight`` fills as many positions.  Rows are range-partitioned, so a
    large group is several tasks; only partition sizes and the wanted rows reach the driver.
    """
    if not any(wanted.values()):
        return {}
    keys = sort_columns([*group, *order])
    filled = F.col(weight) if weight else F.lit(1).cast("long")
    placed = stage(rows.repartitionByRange(*keys).withColumns({"_part": F.spark_partition_id(), "_w": filled}))
    sizes: dict[tuple, list[tuple[int, int]]] = {}
    for row in sorted(placed.groupBy("_part", *group).agg(F.sum("_w").alias("_n")).collect(), key=lambda r: r["_part"]):
        sizes.setdefault(tuple(row[g] for g in group), []).append((row["_part"], row["_n"]))
    tests, targets = [], {}
    for key, positions in wanted.items():
        ends = list(accumulate(n for _, n in sizes.get(key, [])))
        for position in positions:
            slot = next(i for i, end in enumerate(ends) if position < end)
            part, n = sizes[key][slot]
            local = position - (ends[slot] - n)
            targets.setdefault((key, part), []).append((local, position))
            here = [F.col("_part") == part, *(F.col(g).eqNullSafe(F.lit(v)) for g, v in zip(group, key))]
            tests.append(reduce(and_, [*here, F.col("_end") > local, F.col("_end") - F.col("_w") <= local]))
    parts = {part for _, part in targets}
    running = Window.partitionBy("_part", *group).orderBy(*sort_columns(order)).rowsBetween(Window.unboundedPreceding, 0)
    hits = placed.where(F.col("_part").isin(*parts)).withColumn("_end", F.sum("_w").over(running)).where(reduce(or_, tests))
    found: dict[tuple, dict[int, Row]] = {}
    for row in hits.collect():
        key = tuple(row[g] for g in group)
        for local, position in targets.get((key, row["_part"]), []):
            if row["_end"] - row["_w"] <= local < row["_end"]:
                # How many rows of the group come up to the end of this one.
                found.setdefault(key, {})[position] = (row, position + row["_end"] - local)
    return found


def sketch_values(df: DataFrame, metrics: list[str], shares: list[float], accuracy: int = SKETCH_ACCURACY) -> dict[str, list]:
    """Values of each metric whose rank is off by at most one in ``accuracy``, from mergeable quantile sketches."""
    wanted = [F.percentile_approx(F.col(m).cast(METRIC_TYPE), [*shares], accuracy).alias(f"_{i}") for i, m in enumerate(metrics)]
    row = df.agg(*wanted).first()
    return {m: row[f"_{i}"] or [] for i, m in enumerate(metrics)}


def _counted_values(df: DataFrame, metrics: list[str], brackets: dict[str, list[tuple]] | None) -> DataFrame:
    """``metric``, ``value`` and ``n`` rows, added up in each task before they are shuffled.

    With ``brackets`` (sorted, apart), values outside them are counted under the upper end of the gap they lie in,
    so that there are few of them.
    """
    stacked = _stacked(df, metrics)
    if brackets:
        value, kept = F.col("value"), F.col("value")
        for i, m in enumerate(metrics):
            if not brackets.get(m):
                continue
            # The end of a gap is the value just below the next bracket.
            gap = F.lit(None).cast(METRIC_TYPE)
            for low, high in reversed(brackets[m]):
                below = (F.lit(low) - F.lit(METRIC_STEP)).cast(METRIC_TYPE)
                gap = F.when(value < F.lit(low), below).when(value <= F.lit(high), value).otherwise(gap)
            beyond = (F.lit(brackets[m][-1][1]) + F.lit(METRIC_STEP)).cast(METRIC_TYPE)
            gap = F.when(value.isNull(), value).when(value > F.lit(brackets[m][-1][1]), beyond).otherwise(gap)
            kept = F.when(F.col("metric") == i, gap).otherwise(kept)
        stacked = stacked.withColumn("value", kept)
    return stacked.groupBy("metric", "value").agg(F.count("*").alias("n"))


def _brackets(df: DataFrame, metrics: list[str], positions: list[int], rows: int) -> dict[str, list[tuple]]:
    """Ranges of values that hold the wanted positions, by sketches; overlapping ones are joined."""
    spare = 2 / SKETCH_ACCURACY
    shares = [min(max((p + 0.5) / rows + d, 0.0), 1.0) for p in positions for d in (-spare, spare)]
    out = {}
    for m, values in sketch_values(df, metrics, shares).items():
        joined: list[tuple] = []
        for low, high in sorted(zip(values[::2], values[1::2])):
            if joined and low - METRIC_STEP <= joined[-1][1]:
                joined[-1] = (joined[-1][0], max(high, joined[-1][1]))
            else:
                joined.append((low, high))
        out[m] = joined
    return out


def order_statistics(
    df: DataFrame,
    metrics: list[str],
    tie: list[str],
    positions: Callable[[int], list[int]],
    sketch: bool = False,
) -> dict[str, OrderStatistics]:
    """Exact rows at chosen 0-based positions of the order ``(metric, *tie)``.

    Rows are counted per value of a metric, and the wanted positions looked up in
    the counts.  Only a position inside a value needs the order of the rows of
    that value; without ``tie``, none does.  A position at the end of its value
    is given as ``(value,)``, others as ``(value, *tie)``.  ``positions`` maps
    the row count to the wanted positions, a handful per metric.

    With ``sketch``, for metrics of very many values, quantile sketches first say which
    values can hold the positions, and only these are told apart.  Positions that
    turn out to lie elsewhere are looked up without the sketch.
    """
    _check_metrics(df, metrics)
    rows = df.count()
    wanted = sorted(set(positions(rows)))
    if not wanted:
        return {m: OrderStatistics(rows, {}) for m in metrics}
    brackets = _brackets(df, metrics, wanted, rows) if sketch else None
    at = _found_at(
        _counted_values(df, metrics, brackets), ["metric"], ["value"], {(i,): wanted for i in range(len(metrics))}, "n"
    )
    found: dict[int, dict[int, tuple]] = {i: {} for i in range(len(metrics))}
    inside: dict[tuple, dict[int, int]] = {}
    missed = set()
    for (i,), rows_at in at.items():
        for position, (row, end) in rows_at.items():
            value = row["value"]
            known = brackets is None or value is None or any(a <= value <= b for a, b in brackets[metrics[i]])
            if not known:
                missed.add(metrics[i])
            elif not tie or position == end - 1:
                found[i][position] = (value,)
            else:
                inside.setdefault((i, value), {})[position] = position - (end - row["n"])
    if inside:
        same = [(F.col("metric") == i) & F.col("value").eqNullSafe(F.lit(v)) for i, v in inside]
        some = [F.col(metrics[i]).cast(METRIC_TYPE).eqNullSafe(F.lit(v)) for i, v in inside]
        members = _stacked(df.where(reduce(or_, some)), metrics, *tie).where(reduce(or_, same))
        ranked = _found_at(members, ["metric", "value"], tie, {key: sorted(p.values()) for key, p in inside.items()})
        for key, places in inside.items():
            for position, local in places.items():
                row, _ = ranked[key][local]
                found[key[0]][position] = (key[1], *[row[t] for t in tie])
    out = {m: OrderStatistics(rows, dict(sorted(found[i].items()))) for i, m in enumerate(metrics)}
    if missed:
        out |= order_statistics(df, sorted(missed), tie, positions)
    return out


def _after(columns: list[Column], cut: tuple) -> Column:
    """True where the row sorts after ``cut`` (ascending, NULL smallest), which may be given by its first columns alone."""
    result = F.lit(False)
    for column, value in reversed(list(zip(columns, cut))):
        if value is None:
            greater, same = column.isNotNull(), column.isNull()
        else:
            greater = F.coalesce(column > F.lit(value), F.lit(False))
            same = F.coalesce(column == F.lit(value), F.lit(False))
        result = greater | (same & result)
    return result


def ntile_cuts(rows: int, tiles: int) -> list[int]:
    """Last 0-based position of every tile but the final one."""
    size, extra = divmod(rows, tiles)
    ends = [j * size + min(j, extra) - 1 for j in range(1, tiles)]
    return [e for e in ends if 0 <= e < rows - 1]


def ntile_columns(df: DataFrame, tiles: int, metrics: list[str], tie: list[str]) -> dict[str, Column]:
    """``ntile(tiles)`` over ``(metric, *tie)`` for each metric, as plain expressions.

    Only the boundary rows are looked up, so no ranked copy is joined back.
    ``df`` should be staged; the returned columns apply to the same frame.
    """
    stats = order_statistics(df, metrics, tie, lambda n: ntile_cuts(n, tiles))
    columns = {}
    for m in metrics:
        order = [F.col(m).cast(METRIC_TYPE), *[F.col(t) for t in tie]]
        tile = F.lit(1)
        for cut in stats[m].at.values():
            tile = tile + _after(order, cut).cast("int")
        columns[m] = tile
    return columns


def ntile_all(df: DataFrame, tiles: int, by: str, tie: list[str], name: str = "tile") -> DataFrame:
    """``ntile(tiles)`` over all rows in the ascending order ``(by, *tie)``."""
    return df.withColumn(name, ntile_columns(df, tiles, [by], tie)[by])


def quantile_edges(df: DataFrame, metrics: list[str], tie: list[str], bins: int) -> dict[str, list[float]]:
    """Exact ``bins + 1`` quantile edges of each metric, linearly interpolated.

    Sketches bracket the edges; only values inside a bracket are counted one by one.
    An edge is a value, so ``tie`` makes no difference and is not read.
    """

    def neighbours(n: int) -> list[int]:
        low = [(n - 1) * j // bins for j in range(bins + 1)] if n else []
        return sorted({min(p + d, n - 1) for p in low for d in (0, 1)})

    edges = {}
    for m, s in order_statistics(df, metrics, [], neighbours, sketch=True).items():
        edges[m] = []
        for j in range(bins + 1 if s.rows else 0):
            low, part = divmod((s.rows - 1) * j, bins)
            a = float(s.at[low][0])
            b = float(s.at[min(low + 1, s.rows - 1)][0])
            edges[m].append(a + (b - a) * (part / bins))
    return edges


def sketch_edges(
    df: DataFrame, metrics: list[str], tie: list[str], bins: int, accuracy: int = SKETCH_ACCURACY
) -> dict[str, list[float]]:
    """Quantile edges from the sketches alone, in one pass: each is a value of the metric, off by at most one rank in ``accuracy``."""
    shares = [j / bins for j in range(bins + 1)]
    return {m: [float(v) for v in values] for m, values in sketch_values(df, metrics, shares, accuracy).items()}


def rank_error(df: DataFrame, c: str, edges: list[float]) -> float:
    """Largest distance, as a share of all rows, between the ranks that edges have and those they should have."""
    value, bins = F.col(c).cast("double"), len(edges) - 1
    below = [F.count_if(value < F.lit(e)).alias(f"b{j}") for j, e in enumerate(edges)]
    upto = [F.count_if(value <= F.lit(e)).alias(f"u{j}") for j, e in enumerate(edges)]
    row = df.agg(F.count(c).alias("n"), *below, *upto).first()
    n = row["n"]
    return max((max(row[f"b{j}"] / n - j / bins, j / bins - row[f"u{j}"] / n, 0.0) for j in range(bins + 1)), default=0.0) if n else 0.0


def quantile_bin(c: str, edges: list[float], fallback: int | None) -> Column:
    """1-based bin of ``c``; ``fallback`` for every row when edges repeat."""
    if not edges or len(set(edges)) < len(edges):
        return F.lit(fallback).cast("int")
    value = F.col(c).cast("double")
    label = F.lit(len(edges) - 1)
    for i in range(len(edges) - 2, 0, -1):
        label = F.when(value <= F.lit(edges[i]), i).otherwise(label)
    return label


def qcut(
    df: DataFrame, c: str, tie: list[str], bins: int, name: str, fallback: int = 3,
    edges: Callable[..., dict[str, list[float]]] = quantile_edges,
) -> DataFrame:
    """Equal-frequency bin 1..``bins`` of one numeric column; ``edges`` can be :func:`sketch_edges`."""
    return df.withColumn(name, quantile_bin(c, edges(df, [c], tie, bins)[c], fallback))


def sized_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint if ``df`` (pinned, narrow rows) has at most ``limit`` rows.

    Beyond it the frame is returned as it is and joins by shuffle.
    """
    return F.broadcast(df) if df.count() <= limit else df


def rank_all(df: DataFrame, by: str, tie: list[str]) -> DataFrame:
    """``row_num``, ``rank_num``, ``dense_rnk`` and ``pct_rank`` (0-100) over all rows."""
    column = by.lstrip("-")
    # Staged by with_row_id already.
    numbered = with_row_id(df, [by, *tie], "row_num")
    total = numbered.count()
    # The first row number of each value is its rank; the values themselves are few.
    firsts = numbered.groupBy(column).agg(F.min("row_num").alias("rank_num"))
    ranked = pin(with_row_id(firsts, ["rank_num"], "dense_rnk"))
    values = sized_broadcast(ranked.withColumnRenamed(column, "_value"))
    return numbered.join(values, F.col(column).eqNullSafe(F.col("_value"))).select(
        *df.columns, "row_num", "rank_num", "dense_rnk", _percent_rank("rank_num", total).alias("pct_rank")
    )


def _percent_rank(rank: str, total: int) -> Column:
    if total <= 1:
        return F.lit(0.0)
    return F.round((F.col(rank) - 1) * F.lit(100) / F.lit(total - 1), 2)


def rank_top(
    df: DataFrame,
    by: str,
    tie: list[str],
    k: int,
    total: int | None = None,
    tiles: int = 10,
) -> DataFrame:
    """Ranks of the ``k`` first rows; with ``total`` also percent rank and tile.

    Ranks depend only on the rows ahead, so the top rows are cut off first and
    the windows run over ``k`` rows.
    """
    top = top_k(df, [by, *tie], k)
    by_value = Window.orderBy(*sort_columns([by]))
    ranked = top.select(
        *df.columns,
        F.row_number().over(Window.orderBy(*sort_columns([by, *tie]))).alias("row_num"),
        F.rank().over(by_value).alias("rank_num"),
        F.dense_rank().over(by_value).alias("dense_rnk"),
    )
    if total is None:
        return ranked
    size, extra = divmod(total, tiles)
    at = F.col("row_num") - 1
    wide = extra * (size + 1)
    tile = F.when(at < wide, F.floor(at / (size + 1)) + 1)
    if size:
        tile = tile.otherwise(extra + F.floor((at - wide) / size) + 1)
    return ranked.withColumns({"pct_rank": _percent_rank("rank_num", total), "decile": tile.cast("int")})


def top_k(df: DataFrame, order: list[str], k: int) -> DataFrame:
    """First ``k`` rows of a total order."""
    return df.orderBy(*sort_columns(order)).limit(k)


def order_labels(df: DataFrame, c: str, labels: tuple[str, ...]) -> DataFrame:
    """Sort by the position of the label in ``labels``, unknown labels last."""
    arms = " ".join(f"WHEN {literal(label)} THEN {i}" for i, label in enumerate(labels))
    return df.orderBy(F.expr(f"CASE {c} {arms} ELSE {len(labels)} END"), c)
