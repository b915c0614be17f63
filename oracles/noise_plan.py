"""The noise plan in SQL, from its own table of caps: nothing here reads the code under test.

The Gaussian scale is found by bisection in a recursive query. The delta that a Gaussian of some
sigma achieves is the mean of 1 - exp(epsilon - loss) over the losses beyond epsilon; its integral
over the normal density is taken by Simpson's rule, and as all its terms are positive no digits
are lost.
"""

from __future__ import annotations

from fleetveil.plans.categories import CATEGORY_COLUMNS

# Per released column its query and cap; "mean" divides the cap by the minimum size.
CAPS = """
 1 number_of_systems sum 1
 1 avg_number_of_dc_powerons mean 10
 1 avg_duration mean 60
 2 number_of_systems sum 1
 2 avg_duration_mins_on_battery mean 60
 3 number_of_systems sum 1
 3 average_duration_on_ac_in_seconds mean 3600
 3 average_duration_on_dc_in_seconds mean 3600
 4 number_of_systems sum 1
 4 total_number_of_systems sum 1
 4 percentage_of_systems sum 1
 5 num_entries sum 50
 5 number_of_systems sum 1
 5 entries_per_system mean 50
 7 number_of_systems sum 1
 7 avg_on_time mean 1440
 7 avg_off_time mean 1440
 7 avg_modern_sleep_time mean 1440
 7 avg_sleep_time mean 1440
 7 avg_total_time mean 5760
 7 avg_pcnt_on_time mean 100
 7 avg_pcnt_off_time mean 100
 7 avg_pcnt_mods_time mean 100
 7 avg_pcnt_sleep_time mean 100
 8 number_of_systems sum 1
 8 days sum 365
 9 number_of_systems sum 1
 9 avg_pkg_power_consumed mean 50
10 percent_systems sum 1
10 percent_instances sum 1
10 percent_duration sum 1
11 number_of_systems sum 1
11 avg_percentage_used mean 100
12 total_power_consumption sum 100
"""
# Caps that the published scales were computed from, where they differ.
PUBLISHED_CAPS = {
    "average_duration_on_ac_in_seconds": 600, "average_duration_on_dc_in_seconds": 600,
    "avg_on_time": 720, "avg_off_time": 720, "avg_modern_sleep_time": 720, "avg_sleep_time": 720,
    "avg_total_time": 720, "total_power_consumption": 10,
}
# Queries in which one device can be in several groups, true shares, columns that
# the published post-process scales to 100, the grid.
MANY_GROUPS = (3, 4, 5, 10, 11)
SHARES = ((4, "percentage_of_systems"), (10, "percent_systems"))
PERCENT_COLUMNS = (
    (4, "percentage_of_systems"), (7, "avg_pcnt_on_time"), (10, "percent_systems"),
    (11, "avg_percentage_used"),
)
EPSILONS = ("0.01", "0.05", "0.1", "0.5", "1.0", "inf")
DELTA = "1e-6"


def _columns(least: dict[int, int], groups: int, published: bool) -> str:
    """(query_num, col, sensitivity, groups, is_dist, is_share, is_percent)."""
    rows = []
    lines = [line.split() for line in CAPS.strip().splitlines()]
    lines += [["8", c, "sum", "1"] for c in CATEGORY_COLUMNS]
    for number, name, kind, cap in lines:
        q = int(number)
        cap = str(PUBLISHED_CAPS.get(name, cap)) if published else cap
        sensitivity = f"{cap}::DOUBLE / {least[q]}" if kind == "mean" else f"{cap}::DOUBLE"
        dist = name.startswith("avg_pcnt_") or name in CATEGORY_COLUMNS
        rows.append(
            f"({q}, '{name}', {sensitivity}, {groups if q in MANY_GROUPS else 1}, {dist}, "
            f"{(q, name) in SHARES}, {(q, name) in PERCENT_COLUMNS})"
        )
    return ", ".join(rows)


def _delta(sigma: str) -> str:
    """Delta of sensitivity 1 by Simpson's rule over 14 standard deviations behind the border."""
    n = 2000
    border = f"greatest(eps * {sigma} - 0.5 / {sigma}, -13.0)"
    real = f"(eps * {sigma} - 0.5 / {sigma})"
    z = f"({border} + 14.0 * k / {n})"
    weight = f"CASE WHEN k = 0 OR k = {n} THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END"
    term = f"({weight}) * exp(-{z} * {z} / 2) * (1 - exp(-({z} - {real}) / {sigma}))"
    return (
        f"list_sum(list_transform(range(0, {n + 1}), lambda k: {term})) * 14.0 / {n} / 3 / sqrt(2 * pi())"
    )


def classic(eps: str, delta: str) -> str:
    return f"(sqrt(2 * ln(1.25 / {delta})) / {eps})"


def sigma_ctes(pairs: str) -> dict[str, str]:
    """``sigma_table``: (eps, delta, sigma) for the rows (eps, delta) of a query, sensitivity 1."""
    step = _delta("middle")
    return {
        "sigma_pairs": f"SELECT DISTINCT eps, delta FROM ({pairs}) x WHERE eps <> 'inf'::DOUBLE",
        "sigma_search": f"""
            WITH RECURSIVE search AS (
                SELECT eps, delta, 1e-3::DOUBLE AS low, 1e9::DOUBLE AS high, 0 AS step FROM sigma_pairs
                UNION ALL
                SELECT eps, delta, CASE WHEN {step} > delta THEN middle ELSE low END,
                       CASE WHEN {step} > delta THEN high ELSE middle END, step + 1
                FROM (SELECT *, sqrt(low * high) AS middle FROM search) s WHERE step < 56
            ) SELECT eps, delta, high AS sigma FROM search WHERE step = 56""",
        "sigma_table": """
            SELECT eps, delta, sigma AS exact_sigma,
                   ceil(sigma * pow(10.0, 4 - floor(log10(sigma)))) / pow(10.0, 4 - floor(log10(sigma)))
                       AS sigma
            FROM sigma_search""",
    }


def plan_ctes(least: dict[int, int], groups: int, published: bool = False) -> dict[str, str]:
    """``plan``: the scale and the repairs of each column, mechanism and epsilon.

    A query's budget is split evenly over its columns, all distribution columns together being
    one, and theirs evenly over them; the published variant spends the whole on every column, a
    28th of it on distribution columns, and the whole delta.
    """
    share = (
        "CASE WHEN is_dist THEN 1.0 / 28 ELSE 1.0 END" if published else
        "1.0 / (count(*) FILTER (WHERE NOT is_dist) OVER q + max(is_dist::INT) OVER q) "
        "/ CASE WHEN is_dist THEN count(*) FILTER (WHERE is_dist) OVER q ELSE 1 END"
    )
    grid = ", ".join(f"('{e}', '{e}'::DOUBLE)" for e in EPSILONS)
    delta = DELTA if published else f"{DELTA} * share"
    return {
        "plan_columns": f"""
            SELECT *, {share} AS share
            FROM (VALUES {_columns(least, groups, published)})
                AS c(query_num, col, sensitivity, groups, is_dist, is_share, is_percent)
            WINDOW q AS (PARTITION BY query_num)""",
        "plan_grid": f"""
            SELECT c.*, epsilon, e.eps AS eps, e.eps * share AS column_epsilon, {delta} AS delta
            FROM plan_columns c CROSS JOIN (VALUES {grid}) AS e(epsilon, eps)""",
        **sigma_ctes("SELECT column_epsilon AS eps, delta FROM plan_grid"),
        "plan": f"""
            SELECT query_num, col, mechanism, epsilon, g.eps, column_epsilon,
                   CASE mechanism WHEN 'gaussian' THEN g.delta ELSE 0.0 END AS column_delta,
                   CASE WHEN epsilon = 'inf' THEN 0.0
                        WHEN mechanism = 'laplace' THEN sensitivity * groups / column_epsilon
                        ELSE sigma * sensitivity * sqrt(groups) END AS scale,
                   query_num = 10 AND is_share AS rescale,
                   {'is_percent' if published else 'is_share'} AS normalise, is_dist, sensitivity, groups
            FROM plan_grid g CROSS JOIN (VALUES ('gaussian'), ('laplace')) AS m(mechanism)
            LEFT JOIN sigma_table s ON s.eps = column_epsilon AND s.delta = g.delta""",
    }
