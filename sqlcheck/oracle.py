"""The reports written a second time as SQL over the given tables.

Nothing is shared with the Spark plans: buckets are range joins, segments are
score matrices, and every rounding is done in integers.
"""

from __future__ import annotations


def rounded(part: str, whole: str, digits: int = 2, half_even: bool = False) -> str:
    """``part / whole`` rounded exactly, as a double; NULL for a zero divisor."""
    unit = 10**digits
    a, b = f"CAST({part} AS BIGINT)", f"CAST({whole} AS BIGINT)"
    if half_even:
        n = f"(abs({a}) * {unit})"
        q = f"({n} // {b})"
        twice = f"(2 * ({n} % {b}))"
        magnitude = f"({q} + CASE WHEN {twice} > {b} OR ({twice} = {b} AND {q} % 2 = 1) THEN 1 ELSE 0 END)"
    else:
        magnitude = f"((2 * abs({a}) * {unit} + {b}) // (2 * {b}))"
    return f"CASE WHEN {b} <> 0 THEN sign({a}) * {magnitude} / CAST({unit} AS DOUBLE) END"


def percent(part: str, whole: str, digits: int = 2, half_even: bool = False) -> str:
    return rounded(f"100 * ({part})", whole, digits, half_even)


def text_day(c: str) -> str:
    return f"CAST({c} AS VARCHAR)"


# Order lines as coupon events; eq_bp, man_c and jian_c are the parsed amounts as integers.
FACT = """
logged AS (
  SELECT
    CAST(o_custkey AS BIGINT) AS user_id,
    CAST(l_suppkey AS BIGINT) AS merchant_id,
    CASE WHEN l_discount > 0 THEN CAST(l_partkey AS VARCHAR) END AS coupon_id,
    CASE
      WHEN l_discount = 0 THEN NULL
      WHEN p_size % 10 = 0 THEN 'fixed'
      WHEN l_linenumber % 2 = 1 THEN CAST(p_size * 12 AS VARCHAR) || ':' || CAST(p_size AS VARCHAR)
      ELSE CAST(round(1 - l_discount, 2) AS VARCHAR)
    END AS discount_rate,
    CASE WHEN l_linenumber = 7 THEN 'offline_test' WHEN o_orderstatus = 'P' THEN 'online' ELSE 'offline' END AS source,
    CASE WHEN o_orderstatus <> 'P' AND p_size <= 45 THEN p_size % 13 END AS distance,
    CASE WHEN l_discount > 0 THEN CAST(o_orderdate AS DATE) END AS date_received,
    CASE
      WHEN l_linenumber = 7 THEN NULL
      WHEN NOT l_discount > 0 THEN CAST(o_orderdate AS DATE)
      WHEN l_returnflag = 'R' THEN CAST(o_orderdate AS DATE) + (CAST(l_quantity AS INTEGER) - 5)
    END AS date_used,
    CASE WHEN l_linenumber <> 7 AND o_orderstatus = 'P' THEN
      CASE WHEN NOT l_discount > 0 OR l_returnflag = 'R' THEN 2 WHEN l_returnflag = 'A' THEN 1 ELSE 0 END
    END AS action
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN part ON l_partkey = p_partkey
),
split AS (
  SELECT *,
    CASE WHEN position(':' IN discount_rate) > 0 THEN TRY_CAST(split_part(discount_rate, ':', 1) AS DOUBLE) END AS man,
    CASE WHEN position(':' IN discount_rate) > 0 THEN TRY_CAST(split_part(discount_rate, ':', 2) AS DOUBLE) END AS jian,
    CASE WHEN position(':' IN discount_rate) = 0 THEN TRY_CAST(discount_rate AS DOUBLE) END AS rate
  FROM logged
),
fact AS (
  SELECT user_id, merchant_id, coupon_id, discount_rate, source, distance, date_received, date_used, action,
    CASE
      WHEN discount_rate IS NULL THEN 'none'
      WHEN man IS NOT NULL AND jian IS NOT NULL THEN 'fixed'
      WHEN rate > 0 THEN 'discount'
      ELSE 'unknown'
    END AS discount_type,
    CASE WHEN jian IS NOT NULL THEN CAST(man * 100 AS BIGINT) END AS man_c,
    CASE WHEN man IS NOT NULL THEN CAST(jian * 100 AS BIGINT) END AS jian_c,
    -- Long division of whole cents, ties to the even quotient.
    CAST(CASE
      WHEN man > 0 THEN (man_c - jian_c) * 10000 // man_c + CASE
        WHEN 2 * ((man_c - jian_c) * 10000 % man_c) > man_c THEN 1
        WHEN 2 * ((man_c - jian_c) * 10000 % man_c) = man_c THEN ((man_c - jian_c) * 10000 // man_c) % 2
        ELSE 0 END
      WHEN rate > 1 THEN round(rate * 100)
      WHEN rate > 0 THEN round(rate * 10000)
    END AS BIGINT) AS eq_bp,
    CASE action WHEN 0 THEN 'browse' WHEN 1 THEN 'receive' WHEN 2 THEN 'use' END AS action_name
  FROM split
),
train AS (SELECT * FROM fact WHERE source <> 'offline_test')
"""

NUMBERED = """
numbered AS (
  SELECT *, row_number() OVER (
    ORDER BY user_id NULLS FIRST, merchant_id NULLS FIRST, coupon_id NULLS FIRST, discount_rate NULLS FIRST,
      source NULLS FIRST, distance NULLS FIRST, date_received NULLS FIRST, date_used NULLS FIRST, action NULLS FIRST
  ) AS transaction_id
  FROM fact
)
"""

# Value ranges of each bucket, both ends included; a bucket may own two ranges.
GAP_RANGES = """
gap_ranges(label, lo, hi) AS (VALUES
  ('当天核销', 0, 0), ('次日核销', 1, 1), ('2-3天', 2, 3), ('2-3天', -1000000, -1), ('4-7天', 4, 7),
  ('8-15天', 8, 15), ('16-30天', 16, 30), ('>30天', 31, 1000000))
"""
DISTANCE_RANGES = """
distance_ranges(label, export_label, lo, hi) AS (VALUES
  ('0m（同位置）', '0m(同位置)', 0, 0), ('1m', '1m', 1, 1), ('2-3m', '2-3m', 2, 3), ('2-3m', '2-3m', -1000000, -1),
  ('4-5m', '4-5m', 4, 5), ('6-10m', '6-10m', 6, 10), ('>10m', '10m+', 11, 1000000))
"""
THRESHOLD_RANGES = """
threshold_ranges(label, export_label, lo, hi) AS (VALUES
  ('≤20元', '<=20元', -1000000000, 2000), ('21-50元', '21-50元', 2001, 5000), ('51-100元', '51-100元', 5001, 10000),
  ('101-200元', '101-200元', 10001, 20000), ('201-500元', '201-500元', 20001, 50000),
  ('>500元', '>500元', 50001, 1000000000))
"""

# Segment by score, rows R = 1..5, columns F = 1..5.
SEGMENT = """[
  ['流失用户', '流失用户', '一般用户', '沉睡用户', '沉睡用户'],
  ['流失用户', '流失用户', '一般用户', '沉睡用户', '沉睡用户'],
  ['一般用户', '一般用户', '活跃用户', '活跃用户', '活跃用户'],
  ['新用户', '新用户', '活跃用户', '核心用户', '核心用户'],
  ['新用户', '新用户', '活跃用户', '核心用户', '核心用户']
][r_score][f_score]"""
SUB_SEGMENT = """[
  ['待激活', '流失边缘', '流失边缘', '沉睡-高价值', '沉睡-高价值'],
  ['待激活', '流失边缘', '流失边缘', '沉睡-高价值', '沉睡-高价值'],
  ['待激活', '待激活', '稳定', '稳定', '稳定'],
  ['新客', '新客', '潜力', '核心', '核心'],
  ['新客', '新客', '潜力', '核心', '超级核心']
][r_score][f_score]"""

MONTH = "strftime(date_used, '%Y-%m')"
IN_WINDOW = "date_used >= DATE '2000-01-01' AND date_used < DATE '2000-08-01'"
WEEKEND = "CASE WHEN dayofweek(date_used) IN (0, 6) THEN '周末' ELSE '工作日' END"
MEAN_EQ = rounded("sum(eq_bp)", "count(eq_bp) * 10000", 4)
MEAN_MAN = rounded("sum(man_c)", "count(man_c) * 100", 2)
MEAN_JIAN = rounded("sum(jian_c)", "count(jian_c) * 100", 2)
REF_DATE, DEFAULT_DATE = "DATE '2001-12-31'", "DATE '1995-01-01'"

USERS = f"""
users AS (
  SELECT user_id, max(date_used) AS last_used, count(date_used) AS frequency, count(date_received) AS total_received,
    count(DISTINCT date_used) AS active_days,
    sum(CASE WHEN date_used IS NOT NULL THEN man_c END) AS man_sum,
    count(CASE WHEN date_used IS NOT NULL THEN man_c END) AS man_n,
    sum(CASE WHEN date_used IS NOT NULL THEN eq_bp END) AS eq_sum,
    count(CASE WHEN date_used IS NOT NULL THEN eq_bp END) AS eq_n
  FROM train GROUP BY user_id
),
redeeming AS (
  SELECT user_id, last_used, frequency, total_received, man_sum, man_n,
    CAST(date_diff('day', coalesce(last_used, {DEFAULT_DATE}), {REF_DATE}) AS INTEGER) AS recency_days,
    coalesce({rounded("man_sum", "man_n * 100", 2)}, 0) AS avg_monetary
  FROM users WHERE frequency > 0
)
"""
TILED = """
tiled AS (
  SELECT *,
    CAST(6 - ntile(5) OVER (ORDER BY recency_days, user_id) AS INTEGER) AS r_score,
    CAST(ntile(5) OVER (ORDER BY frequency, user_id) AS INTEGER) AS f_score,
    CAST(ntile(5) OVER (ORDER BY avg_monetary, user_id) AS INTEGER) AS m_score
  FROM redeeming
)
"""


def _edges(name: str) -> str:
    """Sorted-list quantile edges of column ``name``, interpolated at exact positions."""
    points = []
    for j in range(6):
        low = f"((n - 1) * {j} // 5)"
        high = f"least({low} + 1, n - 1)"
        points.append(f"s[{low} + 1] + (s[{high} + 1] - s[{low} + 1]) * (((n - 1) * {j} % 5) / CAST(5 AS DOUBLE))")
    return (
        f"(SELECT [{', '.join(points)}] FROM (SELECT list_sort(list(CAST({name} AS DOUBLE))) AS s, count(*) AS n "
        f"FROM binnable))"
    )


def _bin(name: str, edges: str) -> str:
    steps = " + ".join(f"CAST(CAST({name} AS DOUBLE) > {edges}[{i}] AS INTEGER)" for i in range(2, 6))
    return f"CASE WHEN len(list_distinct({edges})) = 6 THEN 1 + {steps} END"


def _binned(compat: bool) -> str:
    recency = "br" if compat else "6 - br"
    return f"""
binnable AS (
  SELECT user_id, last_used, frequency, total_received, recency_days,
    coalesce({rounded("man_sum", "man_n * 100", 6)}, 0) AS avg_monetary
  FROM redeeming
),
edges AS (
  SELECT {_edges("recency_days")} AS re, {_edges("frequency")} AS fe, {_edges("avg_monetary")} AS me
),
bins AS (
  SELECT binnable.*, {_bin("recency_days", "re")} AS br, {_bin("frequency", "fe")} AS bf, {_bin("avg_monetary", "me")} AS bm
  FROM binnable, edges
),
binned AS (
  SELECT *, CAST(coalesce({recency}, 3) AS INTEGER) AS r_score, CAST(coalesce(bf, 3) AS INTEGER) AS f_score,
    CAST(coalesce(bm, 3) AS INTEGER) AS m_score
  FROM bins
)
"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join(p.strip() for p in parts) + "\n"


def _merchant_usage(least: int) -> str:
    return _with(FACT, NUMBERED) + f"""
SELECT s_suppkey AS merchant_id, count(DISTINCT transaction_id) AS total_txn, count(date_used) AS used_count,
  count(CASE WHEN date_used IS NULL THEN date_received END) AS unused_count,
  {percent("count(date_used)", "count(date_received)")} AS usage_rate_pct
FROM supplier JOIN numbered ON merchant_id = s_suppkey
WHERE source <> 'offline_test'
GROUP BY s_suppkey HAVING count(date_received) >= {least}"""


def _merchants(least: int) -> str:
    return f"""
merchants AS (
  SELECT merchant_id, count(date_received) AS received, count(date_used) AS used,
    {percent("count(date_used)", "count(date_received)")} AS rate
  FROM train GROUP BY merchant_id HAVING count(date_received) >= {least}
)
"""


def _monthly(extra: str = "") -> str:
    return f"""
monthly AS (
  SELECT {MONTH} AS ym, count(*) AS used_count, count(DISTINCT user_id) AS unique_users,
    count(DISTINCT merchant_id) AS unique_merchants {extra}
  FROM train WHERE {IN_WINDOW} GROUP BY ALL
)
"""


def _growth(value: str, previous: str) -> str:
    return percent(f"{value} - {previous}", previous)


def _coupon_type(unused: bool, means: bool = True) -> str:
    return _with(FACT) + f"""
SELECT discount_type, count(*) AS total_count, count(date_used) AS used_count,
  {"count(*) - count(date_used) AS unused_count," if unused else ""}
  {percent("count(date_used)", "count(*)")} AS usage_rate_pct, {MEAN_EQ} AS avg_eq_rate
  {f", {MEAN_MAN} AS avg_threshold, {MEAN_JIAN} AS avg_reduction" if means else ""}
FROM train WHERE coupon_id IS NOT NULL AND date_received IS NOT NULL GROUP BY discount_type"""


def _threshold(label: str) -> str:
    return _with(FACT, THRESHOLD_RANGES) + f"""
SELECT coalesce({label}, '非满减') AS threshold_bucket, count(*) AS total_cnt, count(date_used) AS used_cnt,
  {percent("count(date_used)", "count(*)")} AS usage_rate_pct, {MEAN_EQ} AS avg_eq_discount
FROM train LEFT JOIN threshold_ranges ON man_c BETWEEN lo AND hi
WHERE coupon_id IS NOT NULL AND date_received IS NOT NULL GROUP BY 1"""


def _gap(source: str, pct: str | None) -> str:
    return _with(FACT, GAP_RANGES) + f"""
SELECT coalesce(label, '未核销') AS gap_bucket, count(*) AS cnt{f", {pct} AS pct" if pct else ""}
FROM {source} LEFT JOIN gap_ranges ON date_diff('day', date_received, date_used) BETWEEN lo AND hi
WHERE date_received IS NOT NULL GROUP BY 1"""


def _top_merchants(least: int = 50, top: int = 20) -> str:
    return _with(FACT, _merchants(least)) + f""",
rated AS (
  SELECT merchant_id, received, used, CAST(round({percent("used", "received", 2, True)} * 100) AS BIGINT) AS bp
  FROM merchants ORDER BY bp DESC, merchant_id LIMIT {top}
)
SELECT merchant_id, received AS received_cnt, used AS used_cnt, bp / CAST(100 AS DOUBLE) AS usage_rate_pct,
  {rounded("sum(bp) OVER ()", "100 * count(*) OVER ()", 2)} AS mean_rate,
  bp * count(*) OVER () >= sum(bp) OVER () AS above_mean
FROM rated"""


def _segment_share(source: str, name: str, digits: int = 2, half_even: bool = False) -> str:
    return f"""
SELECT {name}, count(*) AS user_count,
  {percent("count(*)", "CAST(sum(count(*)) OVER () AS BIGINT)", digits, half_even)} AS pct
FROM (SELECT {SEGMENT} AS {name} FROM {source}) GROUP BY {name}"""


def _rfm_chart(compat: bool) -> str:
    recency = "br" if compat else "6 - br"
    return _with(FACT, USERS, _binned(compat)) + f""",
charted AS (
  SELECT CASE WHEN br IS NULL OR bf IS NULL THEN 3 ELSE {recency} END AS r_score,
    CASE WHEN br IS NULL OR bf IS NULL THEN 3 ELSE bf END AS f_score
  FROM bins
)""" + _segment_share("charted", "segment", 1)


def _rfm_qcut(compat: bool) -> str:
    return _with(FACT, USERS, _binned(compat)) + f"""
SELECT user_id, {text_day("last_used")} AS last_used_date, frequency, avg_monetary, total_received, recency_days,
  r_score, f_score, m_score, r_score + f_score + m_score AS rfm_total, {SEGMENT} AS user_segment
FROM binned"""


ENRICHED = """
enriched AS (
  SELECT fact.*,
    CAST(date_used IS NOT NULL AS INTEGER) AS is_used,
    CAST(date_received IS NOT NULL AS INTEGER) AS is_received,
    coalesce(d.export_label, '未知') AS distance_bucket,
    CASE WHEN date_used IS NULL THEN '未知' WHEN isodow(date_used) >= 6 THEN '周末' ELSE '工作日' END AS day_type,
    CAST(date_diff('day', date_received, date_used) AS INTEGER) AS gap_days,
    coalesce(g.label, '未核销') AS gap_bucket,
    coalesce(t.export_label, '非满减') AS threshold_bucket,
    CASE discount_type WHEN 'fixed' THEN '满减券' WHEN 'discount' THEN '折扣券' WHEN 'none' THEN '无优惠券'
      ELSE '未知' END AS discount_type_cn,
    strftime(date_used, '%Y-%m') AS year_month
  FROM fact
  LEFT JOIN distance_ranges d ON distance BETWEEN d.lo AND d.hi
  LEFT JOIN gap_ranges g ON date_diff('day', date_received, date_used) BETWEEN g.lo AND g.hi
  LEFT JOIN threshold_ranges t ON discount_type = 'fixed' AND man_c BETWEEN t.lo AND t.hi
)
"""
ENRICH = _with(FACT, GAP_RANGES, DISTANCE_RANGES, THRESHOLD_RANGES, ENRICHED)


def _export(label: str, cond: str) -> str:
    return ENRICH + f"""
SELECT {label}, CAST(sum(is_received) AS BIGINT) AS total_count, CAST(sum(is_used) AS BIGINT) AS used_count,
  {percent("sum(is_used)", "sum(is_received)", 2, True)} AS usage_rate_pct
FROM enriched WHERE date_received IS NOT NULL AND {cond} GROUP BY {label}"""


_FACT_COLUMNS = f"""user_id, merchant_id, coupon_id, discount_rate, discount_type,
  man_c / CAST(100 AS DOUBLE) AS discount_man, jian_c / CAST(100 AS DOUBLE) AS discount_jian,
  eq_bp / CAST(10000 AS DOUBLE) AS discount_eq_rate, CAST(distance AS INTEGER) AS distance,
  {text_day("date_received")} AS date_received, {text_day("date_used")} AS date_used"""

_ACTIVE = "SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0"


def queries() -> dict[str, str]:
    sql = _reports()
    # Reports built on others: without the cut, the months that have a previous one, and the same rows through a file.
    return {
        **sql,
        "merchant_monthly": sql["merchant_monthly_growth"].removesuffix("ORDER BY merchant_id, ym LIMIT 100"),
        "growth_points": f"SELECT * FROM ({sql['monthly_chart']}) WHERE mom_pct IS NOT NULL",
        "rfm_tsv_segments": sql["rfm_segments"],
        # A fact or result that grew by parts equals the one loaded at once.
        "rfm_live_view": sql["rfm_view"],
        "summary_follows_fact": sql["summary_monthly_trend"],
        "incremental_fact": sql["raw_ingest"],
        "incremental_monthly": sql["export_monthly"],
        "incremental_day_type": sql["export_day_type"],
        "incremental_labels": sql["rollup_counts"],
        "csv_append_once": sql["csv_append"],
        # The order of a report as the place of every row.
        "ordered_by_metric": f"""
SELECT row_number() OVER (ORDER BY usage_rate_pct DESC, merchant_id) AS position, CAST(merchant_id AS BIGINT) AS merchant_id
FROM ({sql["merchant_usage"]})""",
        "ordered_by_key": f"SELECT row_number() OVER (ORDER BY year_month) AS position, year_month FROM ({sql['export_monthly']})",
        "ordered_by_label": f"""
SELECT row_number() OVER (ORDER BY list_position(
  ['当天核销', '次日核销', '2-3天', '4-7天', '8-15天', '16-30天', '>30天', '未核销'], gap_bucket)) AS position, gap_bucket
FROM ({sql["gap_distribution"]})""",
        "ordered_dimension": "SELECT row_number() OVER (ORDER BY c_custkey) AS position, CAST(c_custkey AS BIGINT) AS user_id FROM customer",
    }


def _reports() -> dict[str, str]:
    return {
        # Raw logs, star schema and integrity
        "raw_ingest": _with(FACT, NUMBERED) + f"""
SELECT row_number() OVER (
    ORDER BY list_position(['online', 'offline', 'offline_test'], source), transaction_id
  ) AS transaction_id,
  {_FACT_COLUMNS}, CAST(action AS INTEGER) AS action, action_name, source FROM numbered""",
        "raw_ingest_ids": _with(FACT) + """
SELECT source, n AS row_count, CAST(last_id - n + 1 AS BIGINT) AS first_id, last_id, n AS ids
FROM (
  SELECT source, n, CAST(sum(n) OVER (ORDER BY list_position(['online', 'offline', 'offline_test'], source)) AS BIGINT) AS last_id
  FROM (SELECT source, count(*) AS n FROM fact GROUP BY source))""",
        "dim_users": _with(FACT) + "SELECT DISTINCT user_id FROM fact",
        "dim_merchants": _with(FACT) + "SELECT DISTINCT merchant_id FROM fact",
        "dim_coupons": _with(FACT, NUMBERED) + """
SELECT coupon_id, discount_rate, discount_type, man_c / CAST(100 AS DOUBLE) AS discount_man,
  jian_c / CAST(100 AS DOUBLE) AS discount_jian, eq_bp / CAST(10000 AS DOUBLE) AS eq_discount
FROM (SELECT *, row_number() OVER (PARTITION BY coupon_id ORDER BY transaction_id) AS seen FROM numbered
  WHERE coupon_id IS NOT NULL) WHERE seen = 1""",
        "fact_transactions": _with(FACT, NUMBERED) + f"""
SELECT transaction_id, {_FACT_COLUMNS}, CAST(action AS INTEGER) AS action, action_name, source FROM numbered""",
        "table_counts": _with(FACT) + """
SELECT * FROM (
  SELECT 'users' AS table_name, count(*) AS row_count FROM customer
  UNION ALL SELECT 'merchants', count(*) FROM supplier
  UNION ALL SELECT 'coupons', count(*) FROM part
  UNION ALL SELECT 'transactions', count(*) FROM fact)""",
        "orphan_report": _with(FACT) + """,
keyed AS (
  SELECT 'users' AS dimension, CAST(user_id AS VARCHAR) AS k,
    user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0) AS known FROM fact
  UNION ALL SELECT 'merchants', CAST(merchant_id AS VARCHAR),
    merchant_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0) FROM fact
  UNION ALL SELECT 'coupons', coupon_id,
    coupon_id IN (SELECT CAST(p_partkey AS VARCHAR) FROM part WHERE p_type <> 'ECONOMY')
  FROM fact WHERE coupon_id IS NOT NULL
)
SELECT dimension, count(DISTINCT k) AS key_count, count(DISTINCT CASE WHEN NOT known THEN k END) AS missing_keys,
  CAST(sum(CASE WHEN known THEN 0 ELSE 1 END) AS BIGINT) AS orphan_rows
FROM keyed GROUP BY dimension""",
        "orphan_merchants": _with(FACT) + f"""
SELECT merchant_id, count(*) AS row_count FROM fact
WHERE merchant_id NOT IN ({_ACTIVE}) GROUP BY merchant_id""",
        "duplicate_key_report": """
SELECT l_orderkey, l_linenumber, count(*) AS row_count FROM lineitem
GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""",
        "cascade_delete": _with(FACT) + f"""
SELECT source, discount_type, count(*) AS row_count, count(DISTINCT merchant_id) AS merchants
FROM fact WHERE merchant_id IN ({_ACTIVE}) GROUP BY source, discount_type""",
        "set_null_missing": _with(FACT) + """
SELECT source, count(*) AS row_count, count(DISTINCT p_partkey) AS coupons,
  count(coupon_id) - count(p_partkey) AS cleared
FROM fact LEFT JOIN part ON coupon_id = CAST(p_partkey AS VARCHAR) AND p_type <> 'ECONOMY' GROUP BY source""",
        "invalid_values": _with(FACT) + """
SELECT source, count(*) AS row_count FROM fact WHERE source NOT IN ('online', 'offline') GROUP BY source""",
        # Merchants
        "merchant_usage": _merchant_usage(100),
        "merchant_usage_min50": _merchant_usage(50),
        "merchant_usage_min490": _merchant_usage(490),
        "merchant_rank": _with(FACT, _merchants(50)) + """
SELECT merchant_id, received AS total_received, used AS total_used, rate AS usage_rate_pct,
  CAST(rank() OVER (ORDER BY rate DESC) AS INTEGER) AS rank_by_rate,
  CAST(dense_rank() OVER (ORDER BY rate DESC) AS INTEGER) AS dense_rank_by_rate,
  CAST(row_number() OVER (ORDER BY rate DESC, merchant_id) AS INTEGER) AS row_num
FROM merchants ORDER BY row_num LIMIT 30""",
        "merchant_rank_full": _with(FACT, _merchants(30)) + f""",
ranked AS (
  SELECT *, row_number() OVER (ORDER BY rate DESC, merchant_id) AS rn, rank() OVER (ORDER BY rate DESC) AS rk,
    dense_rank() OVER (ORDER BY rate DESC) AS dr, count(*) OVER () AS n,
    ntile(10) OVER (ORDER BY rate DESC, merchant_id) AS tile
  FROM merchants
)
SELECT merchant_id, received AS received_cnt, used AS used_cnt, rate AS usage_rate, CAST(rn AS INTEGER) AS row_num,
  CAST(rk AS INTEGER) AS rank_num, CAST(dr AS INTEGER) AS dense_rnk, {percent("rk - 1", "n - 1")} AS pct_rank,
  CAST(tile AS INTEGER) AS decile
FROM ranked ORDER BY rn LIMIT 50""",
        "merchant_rank_all": _with(FACT, _merchants(30)) + f"""
SELECT merchant_id, received AS received_cnt, used AS used_cnt, rate AS usage_rate,
  row_number() OVER (ORDER BY rate DESC, merchant_id) AS row_num, rank() OVER (ORDER BY rate DESC) AS rank_num,
  dense_rank() OVER (ORDER BY rate DESC) AS dense_rnk,
  {percent("rank() OVER (ORDER BY rate DESC) - 1", "count(*) OVER () - 1")} AS pct_rank
FROM merchants""",
        "high_rate_coupon_mix": _with(FACT) + f"""
SELECT merchant_id, discount_type, count(*) AS txn_count, {MEAN_EQ} AS avg_eq_discount, count(date_used) AS used_cnt
FROM fact
WHERE coupon_id IS NOT NULL AND merchant_id IN (
  SELECT merchant_id FROM train GROUP BY merchant_id
  HAVING count(date_received) >= 100 AND 10 * count(date_used) > 3 * count(date_received))
GROUP BY merchant_id, discount_type""",
        "high_rate_coupon_mix_remaining": _with(FACT) + f"""
SELECT merchant_id, discount_type, count(*) AS txn_count, {MEAN_EQ} AS avg_eq_discount, count(date_used) AS used_cnt
FROM fact JOIN supplier ON merchant_id = s_suppkey AND s_acctbal >= 0
WHERE coupon_id IS NOT NULL AND merchant_id IN (
  SELECT merchant_id FROM train GROUP BY merchant_id
  HAVING count(date_received) >= 490 AND 100 * count(date_used) > 39 * count(date_received))
GROUP BY merchant_id, discount_type""",
        # Limits of DECIMAL(10,2) and DECIMAL(6,4) in cents: a text's value over 100, and 1 less than a price over 100.
        "discount_overflow": """
WITH cents AS (
  SELECT l_linenumber % 5 AS kind, CAST(round(l_extendedprice * 100) AS BIGINT) AS price,
    CAST(round(o_totalprice * 100) AS BIGINT) AS total, l_suppkey % 2 = 1 AS is_rate, l_suppkey % 9 + 1 AS tiny
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
)
SELECT field, count(*) AS row_count FROM (
  SELECT 'rate' AS field FROM cents WHERE (kind = 0 AND price >= 1000000) OR (kind = 2 AND price >= 1010000)
    OR kind = 3 OR (kind = 4 AND (NOT is_rate OR tiny < 5))
  UNION ALL SELECT 'threshold' FROM cents WHERE (kind = 1 AND total >= 10000000) OR (kind = 4 AND NOT is_rate AND tiny < 5)
  UNION ALL SELECT 'reduction' FROM cents WHERE kind = 3 AND total >= 10000000)
GROUP BY field""",
        "ingest_rejects": _with(FACT) + """,
logged_n AS (SELECT *, user_id + merchant_id AS n, (user_id + merchant_id) % 13 = 0 AS broken FROM fact),
read AS (SELECT * FROM logged_n WHERE NOT broken)
SELECT source, 'lines' AS field, count(*) AS row_count FROM logged_n GROUP BY 1
UNION ALL SELECT source, 'broken_lines', count(*) FILTER (WHERE broken) FROM logged_n GROUP BY 1
UNION ALL SELECT source, 'kept', count(*) FROM read GROUP BY 1
UNION ALL SELECT source, 'date_received', count(*) FILTER (WHERE n % 11 = 5) FROM read GROUP BY 1
UNION ALL SELECT source, 'date_used', count(*) FILTER (WHERE n % 5 = 4) FROM read WHERE source <> 'offline_test' GROUP BY 1
UNION ALL SELECT source, 'distance', count(*) FILTER (WHERE n % 7 = 3) FROM read WHERE source <> 'online' GROUP BY 1
UNION ALL SELECT source, 'action', count(*) FILTER (WHERE n % 17 = 1) FROM read WHERE source = 'online' GROUP BY 1
UNION ALL SELECT 'discounts', 'threshold', 0
UNION ALL SELECT 'discounts', 'reduction', 0
UNION ALL SELECT 'discounts', 'rate', count(*) FILTER (WHERE n % 19 = 2) FROM read""",
        "failed_replace": "SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, s_name, s_acctbal FROM supplier",
        "table_as_select": "SELECT c_mktsegment, count(*) AS customers FROM customer GROUP BY c_mktsegment",
        "load_order": """
SELECT 1 AS position, 'users' AS table_name, count(*) AS row_count FROM customer
UNION ALL SELECT 2, 'merchants', count(*) FROM supplier
UNION ALL SELECT 3, 'coupons', count(*) FROM part
UNION ALL SELECT 4, 'transactions', count(*) FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
        "bulk_load": """
SELECT CAST(c_custkey AS BIGINT) AS c_custkey, CASE WHEN NOT c_acctbal < 0 THEN c_name END AS c_name, c_acctbal, c_mktsegment
FROM customer""",
        "csv_append": "SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_name, c_acctbal, c_mktsegment FROM customer",
        "sorted_dimension": "SELECT CAST(s_suppkey AS BIGINT) AS merchant_id FROM supplier",
        "sample_rows": "SELECT least(count(*), 10) AS row_count FROM orders",
        "pruned_scan": "SELECT p_partkey, p_type FROM part",
        "merchants_above_semi_join": _with(FACT) + """
SELECT merchant_id, count(*) AS row_count, count(date_used) AS used_cnt FROM fact
WHERE merchant_id IN (
  SELECT merchant_id FROM train GROUP BY merchant_id
  HAVING count(date_received) >= 100 AND 100 * count(date_used) > 39 * count(date_received))
GROUP BY merchant_id""",
        "overall_stats": _with(FACT) + f"""
SELECT '整体' AS scope, count(DISTINCT user_id) AS total_users, count(DISTINCT merchant_id) AS total_merchants,
  count(DISTINCT coupon_id) AS total_coupons, count(*) AS total_records, count(date_received) AS received_cnt,
  count(date_used) AS used_cnt, {percent("count(date_used)", "count(date_received)")} AS overall_usage_rate_pct
FROM train""",
        # Trends
        "monthly_growth": _with(FACT, _monthly()) + f""",
lagged AS (
  SELECT *, lag(used_count) OVER (ORDER BY ym) AS prev_month_used, lead(used_count) OVER (ORDER BY ym) AS next_month_used,
    CAST(sum(used_count) OVER (ORDER BY ym ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumulative_used
  FROM monthly
)
SELECT *, used_count - prev_month_used AS mom_change, {_growth("used_count", "prev_month_used")} AS mom_growth_pct
FROM lagged""",
        "merchant_monthly_growth": _with(FACT) + f""",
counted AS (
  SELECT merchant_id, {MONTH} AS ym, count(*) AS used_count FROM train WHERE {IN_WINDOW} GROUP BY ALL
),
lagged AS (
  SELECT *, lag(used_count) OVER (PARTITION BY merchant_id ORDER BY ym) AS prev_month,
    CAST(rank() OVER (PARTITION BY merchant_id ORDER BY used_count DESC) AS INTEGER) AS month_rank
  FROM counted
)
SELECT *, {_growth("used_count", "prev_month")} AS mom_growth_pct
FROM lagged ORDER BY merchant_id, ym LIMIT 100""",
        "daily_moving_avg": _with(FACT) + f""",
daily AS (SELECT date_used, count(*) AS daily_used FROM train WHERE date_used IS NOT NULL GROUP BY date_used),
framed AS (
  SELECT *,
    sum(daily_used) OVER (ORDER BY date_used ROWS 6 PRECEDING) AS s7, least(row_number() OVER (ORDER BY date_used), 7) AS n7,
    sum(daily_used) OVER (ORDER BY date_used ROWS 29 PRECEDING) AS s30,
    least(row_number() OVER (ORDER BY date_used), 30) AS n30
  FROM daily
)
SELECT {text_day("date_used")} AS date_used, daily_used, {rounded("s7", "n7", 1)} AS ma_7d, {rounded("s30", "n30", 1)} AS ma_30d
FROM framed""",
        "month_first_last": _with(FACT) + f""",
daily AS (
  SELECT {MONTH} AS ym, date_used, count(*) AS n FROM fact WHERE date_used IS NOT NULL GROUP BY ALL
)
SELECT DISTINCT ym,
  first_value(n) OVER w AS first_day_count, last_value(n) OVER w AS last_day_count,
  max(n) OVER (PARTITION BY ym) AS peak_day_count,
  sum(n) OVER (PARTITION BY ym) / CAST(count(*) OVER (PARTITION BY ym) AS DOUBLE) AS avg_daily_count
FROM daily
WINDOW w AS (PARTITION BY ym ORDER BY date_used ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
        "monthly_trend": _with(FACT) + f"""
SELECT {MONTH} AS ym, CAST(year(date_used) AS INTEGER) AS year_num, CAST(month(date_used) AS INTEGER) AS month_num,
  count(*) AS used_count, count(DISTINCT user_id) AS unique_users, count(DISTINCT merchant_id) AS unique_merchants,
  {rounded("count(*)", "count(DISTINCT user_id)")} AS avg_uses_per_user, {MEAN_EQ} AS avg_discount_rate,
  {rounded("sum(man_c) FILTER (discount_type = 'fixed')", "100 * count(man_c) FILTER (discount_type = 'fixed')")}
    AS avg_fixed_threshold
FROM train WHERE {IN_WINDOW} GROUP BY ALL""",
        "weekly_growth": _with(FACT) + f""",
weekly AS (
  SELECT CAST(isoyear(date_used) * 100 + week(date_used) AS INTEGER) AS yw, min(date_used) AS first_day,
    max(date_used) AS last_day, count(*) AS used_count, count(DISTINCT user_id) AS unique_users
  FROM train WHERE {IN_WINDOW} GROUP BY 1
),
lagged AS (SELECT *, lag(used_count) OVER (ORDER BY yw) AS prev_week_used FROM weekly)
SELECT yw, {text_day("first_day")} AS week_start, {text_day("last_day")} AS week_end, used_count, unique_users,
  prev_week_used, {_growth("used_count", "prev_week_used")} AS wow_growth_pct
FROM lagged""",
        "day_type_usage": _with(FACT) + f"""
SELECT {WEEKEND} AS day_type, count(*) AS used_count, count(DISTINCT user_id) AS unique_users, {MEAN_EQ} AS avg_discount,
  {rounded("count(*)", "count(DISTINCT date_used)", 0)} AS avg_daily_uses
FROM train WHERE date_used IS NOT NULL GROUP BY 1""",
        # Breakdowns
        "coupon_type": _coupon_type(unused=True),
        "coupon_type_short": _coupon_type(unused=False, means=False),
        "threshold_usage": _threshold("label"),
        "distance_usage": _with(FACT, DISTANCE_RANGES) + f"""
SELECT coalesce(label, '未知') AS distance_bucket, count(*) AS total_cnt, count(date_used) AS used_cnt,
  {percent("count(date_used)", "count(*)")} AS usage_rate_pct
FROM fact LEFT JOIN distance_ranges ON distance BETWEEN lo AND hi
WHERE source = 'offline' AND date_received IS NOT NULL GROUP BY 1""",
        "gap_distribution": _gap("train", percent("count(*)", "sum(count(*)) OVER ()")),
        # Summaries
        "summary_merchant_usage": _with(FACT) + f"""
SELECT merchant_id, count(*) AS total_received, count(date_used) AS used_count,
  {percent("count(date_used)", "count(*)")} AS usage_rate_pct
FROM train WHERE date_received IS NOT NULL GROUP BY merchant_id HAVING count(*) >= 50""",
        "summary_monthly_trend": _with(FACT, _monthly()) + "SELECT * FROM monthly",
        "summary_coupon_type": _coupon_type(unused=False),
        "summary_rfm_scores": _with(FACT, USERS) + f"""
SELECT user_id, {text_day("last_used")} AS last_used_date, frequency, avg_monetary, total_received, recency_days
FROM redeeming""",
        "summary_threshold_bucket": _threshold("export_label"),
        "summary_gap_analysis": _gap("train", None),
        # RFM
        "rfm_user_base": _with(FACT, USERS) + f"""
SELECT user_id, {text_day("last_used")} AS last_used_date, active_days, frequency, total_received,
  {rounded("eq_sum", "eq_n * 10000", 4)} AS avg_discount, {rounded("man_sum", "man_n * 100", 2)} AS avg_threshold
FROM users""",
        "rfm_users": _with(FACT, USERS, TILED) + f"""
SELECT user_id, recency_days, frequency, avg_monetary AS monetary, total_received, r_score, f_score, m_score,
  r_score + f_score + m_score AS rfm_total, r_score::VARCHAR || f_score::VARCHAR || m_score::VARCHAR AS rfm_cell,
  (4 * r_score + 4 * f_score + 2 * m_score) / CAST(10 AS DOUBLE) AS rfm_weighted,
  {SEGMENT} AS user_segment, {SUB_SEGMENT} AS user_sub_segment
FROM tiled""",
        "rfm_segments": _with(FACT, USERS, TILED) + _segment_share("tiled", "segment"),
        "rfm_view": _with(FACT, USERS, TILED) + f"""
SELECT user_id, {text_day("last_used")} AS last_used_date, frequency, avg_monetary, total_received, recency_days,
  r_score, f_score, m_score, r_score + f_score + m_score AS rfm_total, {SEGMENT} AS user_segment
FROM tiled""",
        "rfm_qcut": _rfm_qcut(False),
        "rfm_qcut_compat": _rfm_qcut(True),
        "rfm_qcut_segments": _with(FACT, USERS, _binned(False)) + _segment_share("binned", "user_segment", 2, True),
        # Charts
        "top_merchants_chart": _top_merchants(),
        "rfm_distribution_chart": _rfm_chart(False),
        "rfm_distribution_chart_compat": _rfm_chart(True),
        "monthly_chart": _with(FACT) + f""",
monthly AS (
  SELECT {MONTH} AS ym, count(*) AS used_count, count(DISTINCT user_id) AS unique_users
  FROM train WHERE date_used IS NOT NULL GROUP BY 1
),
shown AS (SELECT *, lag(used_count) OVER (ORDER BY ym) AS prev FROM monthly WHERE ym BETWEEN '2000-01' AND '2000-07'),
grown AS (SELECT *, {percent("used_count - prev", "prev", 1, True)} AS mom_pct FROM shown)
SELECT *, mom_pct > 0 AS is_rise, printf('%+.1f%%', mom_pct) AS mom_label FROM grown""",
        "coupon_type_chart": _with(FACT) + f"""
SELECT discount_type, count(*) AS total_count, count(date_used) AS used_count,
  {percent("count(date_used)", "count(*)", 2, True)} AS usage_rate_pct,
  coalesce(map {{'fixed': '满减券', 'discount': '折扣券', 'none': '无优惠券', 'unknown': '未知类型'}}[discount_type],
    discount_type) AS label
FROM train WHERE coupon_id IS NOT NULL AND date_received IS NOT NULL GROUP BY discount_type""",
        # Exports
        "enriched": ENRICH + f"""
SELECT user_id, merchant_id, coupon_id, discount_type, discount_type_cn, man_c / CAST(100 AS DOUBLE) AS discount_man,
  jian_c / CAST(100 AS DOUBLE) AS discount_jian, eq_bp / CAST(10000 AS DOUBLE) AS discount_eq_rate,
  CAST(distance AS INTEGER) AS distance, distance_bucket, {text_day("date_received")} AS date_received,
  {text_day("date_used")} AS date_used, is_used, is_received, day_type, gap_days, gap_bucket, threshold_bucket,
  year_month, source, action_name
FROM enriched""",
        "rollup_counts": ENRICH + """
SELECT source, coupon_id IS NOT NULL AS has_coupon, discount_type_cn, distance_bucket, gap_bucket, threshold_bucket,
  count(*) AS total_count, count(date_used) AS used_count
FROM enriched WHERE date_received IS NOT NULL GROUP BY ALL""",
        "export_monthly": _with(FACT) + f"""
SELECT {MONTH} AS year_month, count(*) AS used_count, count(DISTINCT user_id) AS unique_users,
  count(DISTINCT merchant_id) AS unique_merchants,
  {rounded("count(*)", "count(DISTINCT user_id)", 2, True)} AS avg_uses_per_user
FROM fact WHERE date_used IS NOT NULL GROUP BY 1""",
        "export_coupon_type": _export("discount_type_cn", "coupon_id IS NOT NULL"),
        "export_distance": _export("distance_bucket", "source = 'offline'"),
        "export_day_type": _with(FACT) + f"""
SELECT {WEEKEND} AS day_type, count(*) AS used_count, count(DISTINCT user_id) AS unique_users
FROM fact WHERE date_used IS NOT NULL GROUP BY 1""",
        "export_gap": _gap("fact", percent("count(*)", "sum(count(*)) OVER ()", 2, True)),
        "export_threshold": _export("threshold_bucket", "coupon_id IS NOT NULL"),
        "export_rfm": _with(FACT, USERS, TILED) + _segment_share("tiled", "user_segment", 2, True),
        "kpi_overview": _with(FACT) + f"""
SELECT count(*) AS total_records, count(DISTINCT user_id) AS total_users, count(DISTINCT merchant_id) AS total_merchants,
  count(DISTINCT coupon_id) AS total_coupons, count(date_received) AS received_cnt, count(date_used) AS used_cnt,
  count(*) FILTER (date_received IS NOT NULL AND date_used IS NOT NULL) AS redeemed_cnt,
  count(*) FILTER (date_received = date_used) AS same_day_cnt,
  {percent("count(*) FILTER (date_received IS NOT NULL AND date_used IS NOT NULL)", "count(date_received)")} AS redeemed_pct,
  {percent("count(*) FILTER (date_received = date_used)", "count(date_received)")} AS same_day_pct,
  {percent("count(*) FILTER (date_received IS NOT NULL AND date_used IS NULL)", "count(date_received)")} AS unredeemed_pct
FROM fact""",
        "sql_monthly_uses": _with(FACT) + f"""
SELECT {MONTH} AS ym, count(*) AS used_count FROM train WHERE {IN_WINDOW} GROUP BY 1""",
    }
