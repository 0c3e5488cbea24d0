"""Dimensions and the star schema."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from couponmill.functions.cleaning import with_discount
from couponmill.operators.ingest import build_fact


@dataclass(frozen=True)
class Star:
    """The four tables, dimensions first."""

    users: DataFrame
    merchants: DataFrame
    coupons: DataFrame
    transactions: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {
            "users": self.users,
            "merchants": self.merchants,
            "coupons": self.coupons,
            "transactions": self.transactions,
        }


def dimension(f: DataFrame, key: str) -> DataFrame:
    """Distinct non-NULL keys."""
    return f.select(key).dropna(subset=[key]).distinct()


def first_by(df: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """The ``value`` of the first row of each key in ``order``.

    Rows are first reduced to (key, value) pairs, so a key that holds a third
    of all rows leaves each task as a few pairs.
    """
    position = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    if len(order) == 1:
        position = F.col(order[0])
    pairs = df.groupBy(key, value).agg(F.min(position).alias("_first"))
    return pairs.groupBy(key).agg(F.min_by(value, "_first").alias(value))


def coupon_dimension(f: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Each coupon with the first rate seen and its parsed discount."""
    first = first_by(f.where(F.col("coupon_id").isNotNull()), "coupon_id", "discount_rate", order or ["transaction_id"])
    return with_discount(first, eq_rate="eq_discount")


def star_of(fact: DataFrame) -> Star:
    """The dimensions that belong to a fact."""
    return Star(
        users=dimension(fact, "user_id"),
        merchants=dimension(fact, "merchant_id"),
        coupons=coupon_dimension(fact),
        transactions=fact,
    )


def build_star(online: DataFrame, offline: DataFrame, test: DataFrame) -> Star:
    """Clean the three raw logs and derive all four tables."""
    return star_of(build_fact(online, offline, test))
