"""What is released, at which caps, and how much one unit can move it.

One table of caps and minimum sizes feeds both the clipping in the release
queries and the sensitivities, so the noise always matches the clipping.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from fleetveil.plans.categories import CATEGORY_COLUMNS

INF = float("inf")

# The epsilon grid, the delta of the Gaussian mechanism, the pass
# thresholds of the three utility metrics.
EPSILON_GRID = (0.01, 0.05, 0.1, 0.5, 1.0, INF)
DELTA = 1e-6
MECHANISMS = ("gaussian", "laplace")
# Types of the grouping columns that are no text.
KEY_TYPES = {"ram_gb": "double"}
PASS_THRESHOLD = {"RE": 0.25, "TVD": 0.15, "SPEARMAN": 0.5}
LOWER_IS_BETTER = {"RE": True, "TVD": True, "SPEARMAN": False}


def epsilon_label(epsilon: float) -> str:
    return "inf" if epsilon == INF else str(float(epsilon))


@dataclass(frozen=True)
class Limits:
    """Caps on one unit's contribution and minimum group sizes per query."""

    # The published clipping caps.
    power_ons: float = 10.0
    battery_minutes: float = 60.0
    display_seconds: float = 3600.0
    blocker_entries: float = 50.0
    state_minutes: float = 1440.0
    days: float = 365.0
    web_duration_ms: float = 3_600_000.0
    package_watts: float = 50.0
    browser_rows: float = 50.0
    percent: float = 100.0
    user_power: float = 100.0
    min_units: dict[int, int] = field(
        default_factory=lambda: {1: 100, 2: 100, 3: 50, 5: 10, 7: 100, 8: 100, 9: 100, 11: 50}
    )
    # A unit without data counts as NULL; True restores its counting as the cap.
    null_is_cap: bool = False
    # Groups that one unit may count in where it can be in several; None sets no bound, and
    # then the scales cover one group only.
    max_groups_per_unit: int | None = 4
    # A mean is NULL if fewer than the minimum have a value; else all units count towards it.
    count_contributors: bool = True
    # Parts of avg_total_time that are capped one by one.
    total_time_parts: int = 4

    def unbounded(self) -> Limits:
        """The same caps as the published queries use them: a unit counts in all its groups,
        and towards the minimum size with or without a value."""
        return replace(self, max_groups_per_unit=None, count_contributors=False)

    def least(self, number: int) -> int:
        """Values that a mean of a query needs."""
        return self.min_units[number] if self.count_contributors else 0


def published_sensitivity_limits(limits: Limits) -> Limits:
    """The tighter caps the published sensitivities were computed from. Noise of
    that scale does not cover the clipping in ``Limits``: for comparison only."""
    return replace(
        limits.unbounded(), display_seconds=600.0, state_minutes=720.0, user_power=10.0,
        total_time_parts=1,
    )


# Queries whose groups come from the facts, so that a unit can be in several of them; in all
# others a unit has one group.
MANY_GROUPS = (3, 4, 5, 6, 10, 11)


@dataclass(frozen=True)
class Released:
    """One noised column. ``dist`` marks a member of the row's distribution,
    ``share`` a column whose values sum to 100 over the groups."""

    name: str
    sensitivity: float
    dist: bool = False
    share: bool = False


@dataclass(frozen=True)
class ReleasedQuery:
    number: int
    title: str
    keys: tuple[str, ...]
    columns: tuple[Released, ...]
    metric: str
    metric_columns: tuple[str, ...]
    # Column the published post-process scales to a sum of 100, true share or not.
    percent_column: str | None = None
    # Groups that one unit moves; a sensitivity is that of one group.
    groups: int = 1

    def column(self, name: str) -> Released:
        return next(c for c in self.columns if c.name == name)

    @property
    def distribution(self) -> list[str]:
        return [c.name for c in self.columns if c.dist]

    @property
    def l1_sensitivity(self) -> float:
        return self.groups * sum(c.sensitivity for c in self.columns)

    @property
    def l2_sensitivity(self) -> float:
        return math.sqrt(self.groups * sum(c.sensitivity**2 for c in self.columns))


def _count(name: str = "number_of_systems") -> Released:
    return Released(name, 1.0)


def _mean(name: str, cap: float, min_units: int) -> Released:
    return Released(name, cap / min_units)


def release_registry(limits: Limits | None = None) -> dict[int, ReleasedQuery]:
    """The twelve released queries with sensitivities derived from ``limits``.

    In one group a mean of values capped at C over at least k units moves by at most C/k, a sum
    by C, a count or a percentage by 1.
    """
    cap = limits or Limits()
    k = cap.min_units
    state_means = ("avg_on_time", "avg_off_time", "avg_modern_sleep_time", "avg_sleep_time")
    state_shares = tuple(f"avg_pcnt_{s}_time" for s in ("on", "off", "mods", "sleep"))
    queries = [
        ReleasedQuery(
            1, "Battery Power On Geographic Summary", ("country",),
            (_count(),
             _mean("avg_number_of_dc_powerons", cap.power_ons, k[1]),
             _mean("avg_duration", cap.battery_minutes, k[1])),
            "RE", ("avg_duration",)),
        ReleasedQuery(
            2, "Battery On Duration by CPU Family and Generation", ("marketcodename", "cpugen"),
            (_count(), _mean("avg_duration_mins_on_battery", cap.battery_minutes, k[2])),
            "RE", ("avg_duration_mins_on_battery",)),
        ReleasedQuery(
            3, "Display Devices Connection Type Resolution Durations",
            ("connection_type", "resolution"),
            (_count(),
             _mean("average_duration_on_ac_in_seconds", cap.display_seconds, k[3]),
             _mean("average_duration_on_dc_in_seconds", cap.display_seconds, k[3])),
            "SPEARMAN", ("average_duration_on_ac_in_seconds",)),
        ReleasedQuery(
            4, "Display Devices Vendors Percentage", ("vendor_name",),
            (_count(), _count("total_number_of_systems"),
             Released("percentage_of_systems", 1.0, share=True)),
            "RE", ("percentage_of_systems",), "percentage_of_systems"),
        ReleasedQuery(
            5, "MODS Blockers by OS Name and Codename", ("os_name", "os_codename"),
            (Released("num_entries", cap.blocker_entries), _count(),
             _mean("entries_per_system", cap.blocker_entries, k[5])),
            "RE", ("entries_per_system",)),
        ReleasedQuery(
            6, "Most Popular Browser in Each Country", ("country",), (), "SPEARMAN", ("browser",)),
        ReleasedQuery(
            7, "On Off MODS Sleep Summary by CPU", ("marketcodename", "cpugen"),
            (_count(),
             *[_mean(c, cap.state_minutes, k[7]) for c in state_means],
             # The mean of a sum of four parts, each with the cap.
             _mean("avg_total_time", cap.total_time_parts * cap.state_minutes, k[7]),
             *[Released(c, cap.percent / k[7], dist=True) for c in state_shares]),
            "TVD", state_shares, "avg_pcnt_on_time"),
        ReleasedQuery(
            8, "Persona Web Category Usage Analysis", ("persona",),
            (_count(), Released("days", cap.days),
             *[Released(c, 1.0, dist=True) for c in CATEGORY_COLUMNS]),
            "TVD", tuple(CATEGORY_COLUMNS)),
        ReleasedQuery(
            9, "Package Power by Country", ("countryname_normalized",),
            (_count(), _mean("avg_pkg_power_consumed", cap.package_watts, k[9])),
            "RE", ("avg_pkg_power_consumed",)),
        ReleasedQuery(
            10, "Popular Browsers by Count Usage Percentage", ("browser",),
            (Released("percent_systems", 1.0, share=True),
             Released("percent_instances", 1.0), Released("percent_duration", 1.0)),
            "TVD", ("percent_systems",), "percent_systems"),
        ReleasedQuery(
            11, "RAM Utilization Histogram", ("ram_gb",),
            (_count(), _mean("avg_percentage_used", cap.percent, k[11])),
            "TVD", ("avg_percentage_used",), "avg_percentage_used"),
        ReleasedQuery(
            12, "Ranked Process Classifications", ("user_id",),
            (Released("total_power_consumption", cap.user_power),),
            "SPEARMAN", ("total_power_consumption",)),
    ]
    bound = cap.max_groups_per_unit or 1
    return {
        q.number: replace(q, groups=bound if q.number in MANY_GROUPS else 1) for q in queries
    }


def slug(title: str) -> str:
    """File-safe name of a result: lower-case words joined by underscores."""
    return "_".join(title.lower().replace("/", " ").split())


def sensitivity_frame(spark: SparkSession, registry: dict[int, ReleasedQuery]) -> DataFrame:
    """(query_num, column, sensitivity, groups, is_dist, is_share, metric_type): one row per
    released column."""
    rows = [
        (q.number, c.name, float(c.sensitivity), q.groups, c.dist, c.share, q.metric)
        for q in registry.values()
        for c in q.columns
    ]
    return spark.createDataFrame(
        rows,
        "query_num int, column string, sensitivity double, groups int, is_dist boolean, is_share boolean, "
        "metric_type string",
    )
