"""Cleaning expressions: missing tokens, lenient parsing, discount rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from couponmill.functions.sqltext import literal
from couponmill.params import ACTION_NAMES

# Texts that a log uses for "no value" in any field.
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)
# Texts that mean "no discount".
NO_DISCOUNT_TOKENS = ("null", "", "None")

# A plain number with optional white space around it; type suffixes do not match.
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def null_tokens(df: DataFrame, cols: list[str], tokens: tuple[str, ...] = MISSING_TOKENS) -> DataFrame:
    """NULL for every missing-value text in the given string columns."""
    return df.withColumns({c: F.when(~F.col(c).isin(*tokens), F.col(c)) for c in cols})


def parse_day(c: str) -> Column:
    """``yyyyMMdd`` text to a date, NULL when it is not one."""
    return F.try_to_date(F.col(c), "yyyyMMdd")


def number_sql(text: str) -> str:
    """SQL text: ``text`` as a double, NULL when it is not a plain number.

    The pattern is checked first because a cast also accepts type suffixes.
    """
    return f"CASE WHEN {text} RLIKE r'{NUMBER}' THEN try_cast({text} AS double) END"


def parse_num(c: str) -> Column:
    """Decimal text to a double, NULL when it is not a plain number."""
    return F.expr(number_sql(c))


def action_name(c: str) -> Column:
    """Name of an online action code, NULL for any other code."""
    arms = " ".join(f"WHEN {code} THEN {literal(name)}" for code, name in ACTION_NAMES.items())
    return F.expr(f"CASE {c} {arms} END")


def with_discount(df: DataFrame, c: str = "discount_rate", eq_rate: str = "discount_eq_rate") -> DataFrame:
    """Add discount type, threshold, reduction and equivalent rate of a raw rate text.

    ``150:20`` is a fixed reduction, ``0.8`` or ``80`` a discount.  The
    equivalent rate of a fixed reduction is rounded half to even.  The numbers
    are parsed in a projection of their own, so each is read once per row.
    """
    tokens = ", ".join(map(literal, NO_DISCOUNT_TOKENS))
    rule = F.expr(f"CASE WHEN {c} NOT IN ({tokens}) THEN {c} END")
    man_text = "substring_index(_rule, ':', 1)"
    jian_text = "substring_index(substring_index(_rule, ':', 2), ':', -1)"
    numbers = df.withColumn("_rule", rule).withColumns({
        "_man": F.expr(f"CASE WHEN contains(_rule, ':') THEN {number_sql(man_text)} END"),
        "_jian": F.expr(f"CASE WHEN contains(_rule, ':') THEN {number_sql(jian_text)} END"),
        "_rate": F.expr(f"CASE WHEN NOT contains(_rule, ':') THEN {number_sql('_rule')} END"),
    })
    fixed = "_man IS NOT NULL AND _jian IS NOT NULL"
    kind = f"""CASE
        WHEN _rule IS NULL THEN 'none' WHEN {fixed} THEN 'fixed' WHEN _rate > 0 THEN 'discount' ELSE 'unknown'
    END"""
    # Amounts come from the text, which is cheaper and no less exact than from the double.
    equivalent = f"""CASE
        WHEN {fixed} THEN CASE
            WHEN _man > 0
            THEN try_cast(try_cast(rint((_man - _jian) * 10000 / _man) AS int) * 0.0001 AS decimal(6,4))
        END
        WHEN _rate > 1 THEN try_cast(_rate / 100 AS decimal(6,4))
        WHEN _rate > 0 THEN try_cast(_rule AS decimal(6,4))
    END"""
    return numbers.withColumns({
        "discount_type": F.expr(kind),
        "discount_man": F.expr(f"CASE WHEN {fixed} THEN try_cast({man_text} AS decimal(10,2)) END"),
        "discount_jian": F.expr(f"CASE WHEN {fixed} THEN try_cast({jian_text} AS decimal(10,2)) END"),
        eq_rate: F.expr(equivalent),
    }).drop("_rule", "_man", "_jian", "_rate")
