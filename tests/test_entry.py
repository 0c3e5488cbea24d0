"""The driver contract without the text operators' libraries, and proofs of order."""

import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from couponmill.operators import ordering

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("missing", ["ahocorasick", "regex", "corpus_pipeline"])
def test_reports_load_without_the_text_operators(missing):
    code = f"""
import sys
sys.modules[{missing!r}] = None
import __spark_entry__ as entry
queries, sql = entry.queries(), entry.oracle_sql()
assert "merchant_usage" in queries and not any(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in queries)
assert set(sql) <= set(queries) and len(queries) > 70
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_positions_show_the_order(spark):
    df = spark.range(5000).withColumn("v", F.pmod(F.xxhash64("id"), F.lit(1000)))
    ordered = ordering.with_position(df.orderBy("v", "id").repartitionByRange(6, "v", "id").sortWithinPartitions("v", "id"))
    rows = sorted((r["position"], r["v"], r["id"]) for r in ordered.collect())
    assert [p for p, _, _ in rows] == list(range(1, 5001))
    assert [r[1:] for r in rows] == sorted(r[1:] for r in rows)
    loose = sorted((r["position"], r["v"]) for r in ordering.with_position(df).collect())
    assert [v for _, v in loose] != sorted(v for _, v in loose)
