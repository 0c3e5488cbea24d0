"""Report parameters, bucket edges and display labels."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date


@dataclass(frozen=True)
class BucketSpec:
    """A first-match bucket ladder.

    ``exact`` values are tested before the inclusive ``upper`` edges, and
    ``order`` is the display order of the labels.  ``negative`` gives values
    below zero a label of their own; without it they fall through the ladder.
    """

    missing: str
    exact: tuple[tuple[int, str], ...]
    upper: tuple[tuple[int, str], ...]
    above: str
    order: tuple[str, ...]
    negative: str | None = None


# Display labels, bucket edges and their display order.
ACTION_NAMES = {0: "browse", 1: "receive", 2: "use"}

DISCOUNT_TYPES = ("fixed", "discount", "none", "unknown")

TYPE_LABELS = {
    "fixed": "满减券",
    "discount": "折扣券",
    "none": "无优惠券",
    "unknown": "未知",
}
TYPE_LABEL_DEFAULT = "未知"
CHART_TYPE_LABELS = {
    "fixed": "满减券",
    "discount": "折扣券",
    "none": "无优惠券",
    "unknown": "未知类型",
}

WEEKEND, WEEKDAY, DAY_UNKNOWN = "周末", "工作日", "未知"

OVERALL_SCOPE = "整体"

GAP = BucketSpec(
    missing="未核销",
    exact=((0, "当天核销"), (1, "次日核销")),
    upper=((3, "2-3天"), (7, "4-7天"), (15, "8-15天"), (30, "16-30天")),
    above=">30天",
    order=("当天核销", "次日核销", "2-3天", "4-7天", "8-15天", "16-30天", ">30天", "未核销"),
)

DISTANCE = BucketSpec(
    missing="未知",
    exact=((0, "0m（同位置）"), (1, "1m")),
    upper=((3, "2-3m"), (5, "4-5m"), (10, "6-10m")),
    above=">10m",
    order=("0m（同位置）", "1m", "2-3m", "4-5m", "6-10m", ">10m", "未知"),
)
EXPORT_DISTANCE = BucketSpec(
    missing="未知",
    exact=((0, "0m(同位置)"), (1, "1m")),
    upper=((3, "2-3m"), (5, "4-5m"), (10, "6-10m")),
    above="10m+",
    order=("0m(同位置)", "1m", "2-3m", "4-5m", "6-10m", "10m+", "未知"),
)

THRESHOLD = BucketSpec(
    missing="非满减",
    exact=(),
    upper=((20, "≤20元"), (50, "21-50元"), (100, "51-100元"), (200, "101-200元"), (500, "201-500元")),
    above=">500元",
    order=("非满减", "≤20元", "21-50元", "51-100元", "101-200元", "201-500元", ">500元"),
)
EXPORT_THRESHOLD = BucketSpec(
    missing="非满减",
    exact=(),
    upper=((20, "<=20元"), (50, "21-50元"), (100, "51-100元"), (200, "101-200元"), (500, "201-500元")),
    above=">500元",
    order=("<=20元", "21-50元", "51-100元", "101-200元", "201-500元", ">500元", "非满减"),
)

# Segment rules, first match wins: label, (lowest, highest) R, (lowest, highest) F.
SEGMENT_RULES = (
    ("核心用户", (4, 5), (4, 5)),
    ("新用户", (4, 5), (1, 2)),
    ("沉睡用户", (1, 2), (4, 5)),
    ("流失用户", (1, 2), (1, 2)),
    ("活跃用户", (3, 5), (3, 5)),
)
SEGMENT_DEFAULT = "一般用户"
SUB_SEGMENT_RULES = (
    ("超级核心", (5, 5), (5, 5)),
    ("核心", (4, 5), (4, 5)),
    ("潜力", (4, 5), (3, 3)),
    ("新客", (4, 5), (1, 2)),
    ("稳定", (3, 3), (3, 5)),
    ("沉睡-高价值", (1, 2), (4, 5)),
    ("流失边缘", (1, 2), (2, 5)),
)
SUB_SEGMENT_DEFAULT = "待激活"

RFM_WEIGHTS = (0.4, 0.4, 0.2)
RFM_TILES = 5
RFM_FALLBACK_SCORE = 3


@dataclass(frozen=True)
class ReportParams:
    """Everything the reports would otherwise hard-code."""

    ref_date: date = date(2016, 7, 31)
    default_date: date = date(2016, 1, 1)
    window_start: date = date(2016, 1, 1)
    window_end: date = date(2016, 8, 1)
    chart_first_month: str = "2016-01"
    chart_last_month: str = "2016-07"
    training_sources: tuple[str, ...] = ("offline", "online")
    offline_source: str = "offline"
    usage_min_received: int = 100
    rank_min_received: int = 50
    full_rank_min_received: int = 30
    mix_min_received: int = 100
    mix_rate_floor: float = 0.3
    summary_min_received: int = 50
    chart_min_received: int = 50
    rank_top: int = 30
    full_rank_top: int = 50
    growth_top: int = 100
    chart_top: int = 20
    gap: BucketSpec = GAP
    distance: BucketSpec = DISTANCE
    threshold: BucketSpec = THRESHOLD
    export_distance: BucketSpec = EXPORT_DISTANCE
    export_threshold: BucketSpec = EXPORT_THRESHOLD
