from datetime import date
from decimal import ROUND_HALF_EVEN, ROUND_HALF_UP, Decimal
from random import Random

import pytest
from pyspark.sql import functions as F

from couponmill.functions.cleaning import action_name, null_tokens, parse_day, parse_num, with_discount

# raw rate -> type, threshold, reduction, equivalent rate
RATES = [
    ("150:20", "fixed", "150.00", "20.00", "0.8667"),
    ("32:31", "fixed", "32.00", "31.00", "0.0312"),
    ("0:5", "fixed", "0.00", "5.00", None),
    ("-10:5", "fixed", "-10.00", "5.00", None),
    ("a:5", "unknown", None, None, None),
    ("5:", "unknown", None, None, None),
    (":", "unknown", None, None, None),
    ("30:5:1", "fixed", "30.00", "5.00", "0.8333"),
    (" 100 : 10 ", "fixed", "100.00", "10.00", "0.9000"),
    ("\t100:10\n", "fixed", "100.00", "10.00", "0.9000"),
    ("100:100", "fixed", "100.00", "100.00", "0.0000"),
    ("0.8", "discount", None, None, "0.8000"),
    (" 0.8 ", "discount", None, None, "0.8000"),
    (".5", "discount", None, None, "0.5000"),
    ("1", "discount", None, None, "1.0000"),
    ("85", "discount", None, None, "0.8500"),
    ("1e1", "discount", None, None, "0.1000"),
    ("0", "unknown", None, None, None),
    ("-1", "unknown", None, None, None),
    ("fixed", "unknown", None, None, None),
    ("   ", "unknown", None, None, None),
    ("1d", "unknown", None, None, None),
    ("1f:2", "unknown", None, None, None),
    ("x0.8b", "unknown", None, None, None),
    (None, "none", None, None, None),
    ("", "none", None, None, None),
    ("null", "none", None, None, None),
    ("None", "none", None, None, None),
    ("99999999999:1", "fixed", None, "1.00", "1.0000"),
]


def test_discount_rules(spark):
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(RATES)], "i int, discount_rate string")
    got = with_discount(df).orderBy("i").collect()
    decimal = lambda v: None if v is None else Decimal(v)
    for row, (raw, kind, man, jian, eq) in zip(got, RATES):
        assert (
            row.discount_type, row.discount_man, row.discount_jian, row.discount_eq_rate
        ) == (kind, decimal(man), decimal(jian), decimal(eq)), raw


def test_discount_types_and_columns(spark):
    df = spark.createDataFrame([("5:1",)], "discount_rate string")
    assert with_discount(df, eq_rate="eq_discount").dtypes == [
        ("discount_rate", "string"),
        ("discount_type", "string"),
        ("discount_man", "decimal(10,2)"),
        ("discount_jian", "decimal(10,2)"),
        ("eq_discount", "decimal(6,4)"),
    ]


def test_equivalent_rate_matches_half_even(spark):
    pairs = [(man, jian) for man in range(1, 301, 7) for jian in range(0, man, 11)]
    df = spark.createDataFrame([(f"{m}:{j}",) for m, j in pairs], "discount_rate string")
    got = {r.discount_rate: r.discount_eq_rate for r in with_discount(df).collect()}
    for m, j in pairs:
        exact = (Decimal(m - j) / Decimal(m)).quantize(Decimal("0.0001"))
        assert got[f"{m}:{j}"] == exact, (m, j)


@pytest.mark.parametrize("text, day", [
    ("20160131", date(2016, 1, 31)), ("20160230", None), ("null", None), ("2016-01-01", None), ("", None), (None, None),
])
def test_parse_day(spark, text, day):
    df = spark.createDataFrame([(text,)], "d string").select(parse_day("d").alias("v"))
    assert df.first().v == day


@pytest.mark.parametrize("text, number", [
    ("5", 5.0), (" 5 ", 5.0), ("-1.5", -1.5), ("1e3", 1000.0), ("1d", None), ("5L", None), ("x", None), ("", None), (None, None),
])
def test_parse_num(spark, text, number):
    df = spark.createDataFrame([(text,)], "d string").select(parse_num("d").alias("v"))
    assert df.first().v == number


def test_null_tokens(spark):
    df = spark.createDataFrame([("null", "a"), ("", "NULL"), ("NA", "b"), ("x", None)], "a string, b string")
    assert [tuple(r) for r in null_tokens(df, ["a", "b"]).collect()] == [
        (None, "a"), (None, None), (None, "b"), ("x", None)
    ]


def test_action_name(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (3,), (None,)], "action int").select(action_name("action").alias("v"))
    assert [r.v for r in df.collect()] == ["browse", "receive", "use", None, None]


def test_large_columns_stay_native(spark):
    df = spark.range(10).select(F.col("id").cast("string").alias("discount_rate"))
    plan = with_discount(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def by_hand(raw):
    """The rules of a discount text in plain Python."""
    def number(text):
        try:
            if any(ch in text for ch in "_nN"):
                raise ValueError
            return float(text)
        except ValueError:
            return None

    def amount(value):
        value = Decimal(repr(value)).quantize(Decimal("0.01"), ROUND_HALF_UP)
        return value if abs(value) < 10**8 else None

    def rate(value, rounding):
        value = value.quantize(Decimal("0.0001"), rounding)
        return value if abs(value) < 100 else None

    if raw in (None, "", "null", "None"):
        return "none", None, None, None
    if ":" in raw:
        man, jian = (number(part) for part in raw.split(":")[:2])
        if man is None or jian is None:
            return "unknown", None, None, None
        eq = None
        if man > 0:
            exact = (Decimal(repr(man)) - Decimal(repr(jian))) / Decimal(repr(man))
            eq = rate(exact, ROUND_HALF_EVEN)
        return "fixed", amount(man), amount(jian), eq
    value = number(raw)
    if value is None or value <= 0:
        return "unknown", None, None, None
    return "discount", None, None, rate(Decimal(repr(value if value <= 1 else value / 100)), ROUND_HALF_UP)


def test_discount_rules_against_plain_python(spark):
    rnd = Random(11)
    pieces = ["0", "1", "5", "20", "32", "64", "96", "150", "0.5", ".25", "3.", "-2", "+7", "1e2", " 8", "9 ", "x", "2d", "", " "]
    texts = {None, "null", "None", ""}
    while len(texts) < 3000:
        texts.add(":".join(rnd.choice(pieces) for _ in range(rnd.choice([1, 1, 2, 2, 2, 3]))))
        texts.add(f"{rnd.randrange(1, 700)}:{rnd.randrange(0, 300)}")
        texts.add(str(round(rnd.random() * rnd.choice([1, 1, 120]), rnd.choice([1, 2, 4]))))
    df = spark.createDataFrame([(t,) for t in texts], "discount_rate string")
    for row in with_discount(df).collect():
        got = (row.discount_type, row.discount_man, row.discount_jian, row.discount_eq_rate)
        assert got == by_hand(row.discount_rate), row.discount_rate
