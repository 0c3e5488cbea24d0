"""Coupon and promotion analytics as Spark jobs.

Raw behaviour logs are cleaned into a star schema (users, merchants, coupons,
transactions) and queried by report plans.  Everything is a DataFrame
transformation or a Column expression; no Python code runs inside tasks.
"""

from couponmill.params import ReportParams

__all__ = ["ReportParams"]
