"""The RFM view as SQL over the stored fact, with tiles that are found when it is read.

``ntile`` over all users would be one task.  The view counts users per value
of a metric instead and looks up the tile borders in these counts.  Only a border that
falls between users of one value needs their order; there the user at the border
is selected digit by digit of the user id, again by counting.  A border becomes
a (value, user) pair, and a user's tile is one plus the borders before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from couponmill.functions.derive import SEGMENT_SQL
from couponmill.functions.sqltext import identifier, literal
from couponmill.params import RFM_TILES, ReportParams

DEFAULTS = ReportParams()

# Metrics as the tiles compare them, by the name of their score.
METRICS = {"r": "recency_days", "f": "frequency", "m": "avg_monetary"}
VALUE_TYPE = "decimal(28,6)"
# Values that differ by less than this share a step of the first running count.
COARSE = 64
# A user id is selected in steps of so many bits, from the highest.
DIGIT_BITS = 16
STEPS = 64 // DIGIT_BITS


def _digit(step: int, user: str = "user_id") -> str:
    """The ``step``-th digit of a user id; the first one carries the sign."""
    shift = 64 - DIGIT_BITS * (step + 1)
    return f"shiftright({user}, {shift})" if step == 0 else f"(shiftright({user}, {shift}) & {(1 << DIGIT_BITS) - 1})"


def _users(table: str, p: ReportParams) -> str:
    sources = ", ".join(map(literal, p.training_sources))
    # The volatile condition is always true.  It keeps this part from being copied into each place
    # that uses it, so the fact is read and grouped once.
    return f"""
    SELECT user_id, max(date_used) AS last_used_date, count(date_used) AS frequency,
        coalesce(round(sum(CASE WHEN date_used IS NOT NULL THEN discount_man END)
            / nullif(count(CASE WHEN date_used IS NOT NULL THEN discount_man END), 0), 2), 0) AS avg_monetary,
        count(date_received) AS total_received,
        datediff(DATE '{p.ref_date}', coalesce(max(date_used), DATE '{p.default_date}')) AS recency_days
    FROM {identifier(table)} WHERE source IN ({sources})
    GROUP BY user_id HAVING count(date_used) > 0 AND rand(0) >= 0"""


def _select_digit(step: int) -> str:
    """Of the users that agree with the border in the earlier digits, the next digit and the rest of the position."""
    known = [f"d{i}" for i in range(step)]
    agree = "".join(f" AND {_digit(i)} = b.d{i}" for i in range(step))
    before = f"digit{step - 1}" if step else "inside"
    given = "".join(f", {k}" for k in known)
    carried = "".join(f", b.{k}" for k in known)
    return f"""
digit{step} AS (
    SELECT metric, j, value{given}, d{step}, k - before AS k FROM (
        SELECT *, sum(n) OVER (PARTITION BY metric, j ORDER BY d{step}) - n AS before FROM (
            SELECT b.metric, b.j, b.value, b.k{carried}, {_digit(step)} AS d{step}, count(*) AS n
            FROM metric_values v JOIN {before} b ON v.metric = b.metric AND v.value = b.value{agree}
            GROUP BY ALL))
    WHERE k >= before AND k < before + n)"""


def live_rfm_sql(table: str, p: ReportParams = DEFAULTS, tiles: int = RFM_TILES) -> str:
    """SELECT text of the RFM view over the stored fact ``table``."""
    stacked = ", ".join(f"'{m}', CAST({c} AS {VALUE_TYPE})" for m, c in METRICS.items())
    user = " | ".join(f"shiftleft(d{i}, {64 - DIGIT_BITS * (i + 1)})" for i in range(STEPS))

    def tile(metric: str) -> str:
        value = f"CAST({METRICS[metric]} AS {VALUE_TYPE})"
        passed = f"b -> b.value < {value} OR (b.value = {value} AND b.last_user < user_id)"
        return f"1 + size(filter(coalesce(borders['{metric}'], array()), {passed}))"

    # The last position of tile j among n users, counted from 0: the first n % tiles tiles hold one more.
    last = f"j * (users DIV {tiles}) + least(j, users % {tiles}) - 1"
    return f"""
WITH users AS ({_users(table, p)}),
metric_values AS (SELECT user_id, stack({len(METRICS)}, {stacked}) AS (metric, value) FROM users),
counted AS (
    SELECT metric, value, floor(value / {COARSE}) AS coarse, count(*) AS n FROM metric_values GROUP BY metric, value),
steps AS (
    SELECT metric, coarse, sum(n) OVER (PARTITION BY metric ORDER BY coarse) - n AS before,
        sum(n) OVER (PARTITION BY metric) AS users
    FROM (SELECT metric, coarse, sum(n) AS n FROM counted GROUP BY metric, coarse)),
placed AS (
    SELECT c.metric, c.value, c.n, s.users,
        s.before + sum(c.n) OVER (PARTITION BY c.metric, c.coarse ORDER BY c.value) - c.n AS first
    FROM counted c JOIN steps s ON c.metric = s.metric AND c.coarse = s.coarse),
borders AS (
    SELECT metric, value, n, j, {last} - first AS k
    FROM (SELECT *, explode(sequence(1, {tiles - 1})) AS j FROM placed)
    WHERE {last} >= first AND {last} < first + n AND {last} < users - 1),
inside AS (SELECT metric, j, value, k FROM borders WHERE k < n - 1),{",".join(_select_digit(i) for i in range(STEPS))},
found AS (
    SELECT metric, value, 9223372036854775807 AS last_user FROM borders WHERE k = n - 1
    UNION ALL SELECT metric, value, {user} FROM digit{STEPS - 1}),
border_lists AS (
    SELECT metric, collect_list(named_struct('value', value, 'last_user', last_user)) AS borders FROM found GROUP BY metric),
bordered AS (
    SELECT *, (SELECT map_from_entries(collect_list(struct(metric, borders))) FROM border_lists) AS borders FROM users),
scored AS (
    SELECT *, {tiles + 1} - ({tile("r")}) AS r_score, {tile("f")} AS f_score, {tile("m")} AS m_score FROM bordered)
SELECT user_id, last_used_date, frequency, avg_monetary, total_received, recency_days, r_score, f_score, m_score,
    r_score + f_score + m_score AS rfm_total, {SEGMENT_SQL} AS user_segment
FROM scored"""


def register_live_rfm_view(
    spark: SparkSession, table: str = "transactions", name: str = "v_user_rfm", p: ReportParams = DEFAULTS
) -> DataFrame:
    """Create or replace the RFM view over the stored fact ``table``.

    The view holds no rows and no borders: whatever the table holds when the view is
    read is what it shows.
    """
    spark.sql(f"CREATE OR REPLACE VIEW {identifier(name)} AS {live_rfm_sql(table, p)}")
    return spark.table(name)
