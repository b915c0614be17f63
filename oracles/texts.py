"""Oracle CTEs: sources, reporting tables, exact release queries, release, scores."""

from __future__ import annotations

from fleetveil.operators.noise import Policy
from fleetveil.plans.categories import CATEGORIES, CATEGORY_COLUMNS
from fleetveil.plans.registry import (
    EPSILON_GRID,
    MECHANISMS,
    Limits,
    epsilon_label,
    published_sensitivity_limits,
    release_registry,
)
from oracles.noise_plan import plan_ctes
from fleetveil.sources.bindings import VIEW_SQL, BASE_TABLES

# The test tables are small, so the registered queries use smaller minimum sizes.
DEMO_LIMITS = Limits(min_units={1: 50, 2: 50, 3: 50, 5: 10, 7: 5, 8: 20, 9: 5, 11: 20})
# The exact queries as published: a device counts in all its groups.
EXACT_LIMITS = DEMO_LIMITS.unbounded()
# Fixed value: groups that the release lets one device count in.
GROUPS = 4
DEMO_SEED = "demo-seed"

CTES: dict[str, str] = {}

for _name, _text in VIEW_SQL.items():
    CTES[f"src_{_name}"] = _text.format(ntz="TIMESTAMP", **{t: t for t in BASE_TABLES})

# ---------------------------------------------------------------- reporting tables

_STATS = (("min", "min_val"), ("avg", "avg_val"), ("med", "percentile_50th"), ("max", "max_val"))


def _wavg(value: str, weight: str) -> str:
    return f"sum({weight} * {value}) / nullif(sum({weight}), 0)"


def _flat_metric(metric: str, suffix: str, extra: str) -> str:
    stats = ", ".join(f"{_wavg(src, 'nrs')} AS {s}_{suffix}" for s, src in _STATS)
    return (
        f"SELECT guid, dt, event_name, sum(nrs) AS nrs, {extra}, {stats} "
        f"FROM src_power_hist WHERE metric_name = '{metric}' GROUP BY ALL"
    )


def _core_metric(metric: str, suffix: str) -> str:
    inner = ", ".join(f"{_wavg(src, 'nrs')} AS {s}_v" for s, src in _STATS)
    outer = ", ".join(f"avg({s}_v) AS {s}_{suffix}" for s, _ in _STATS)
    return f"""
        SELECT guid, dt, event_name, max(n) AS nrs, max(core) AS number_of_cores,
               max(ms) AS duration_ms, {outer}
        FROM (SELECT guid, dt, event_name, CAST(attribute_metric_level1 AS SMALLINT) AS core,
                     sum(nrs) AS n, sum(duration_ms) AS ms, {inner}
              FROM src_power_hist WHERE metric_name = '{metric}'
              GROUP BY guid, dt, event_name, attribute_metric_level1) per_core
        GROUP BY guid, dt, event_name"""


def category_test(parent: str, sub: str | None) -> str:
    test = f"parent_category = '{parent}'"
    return test if sub is None else f"{test} AND sub_category = '{sub}'"


def pivot_columns(measure: str, prefix: str = "") -> str:
    return ", ".join(
        f"coalesce(sum({measure}) FILTER (WHERE {category_test(p, s)}), 0) AS {prefix}{c}"
        for (p, s), c in zip(CATEGORIES, CATEGORY_COLUMNS)
    )


POWER_PARTS = ("cpu", "display", "disk", "mbb", "network", "soc", "loss", "other", "total")
_BATT = ", ".join(
    f"{f}(nullif(power_{side}_battery_percent, -1)) AS {f}_power_{side}_battery_percent"
    for side in ("on", "off") for f in ("max", "min", "avg")
)

CTES |= {
    "rep_display": "SELECT * FROM src_display_devices",
    "rep_userwait": """
        SELECT guid, dt, event_name, ac_dc_event_name,
               upper(substr(ac_dc_event_name, 1, 2)) AS acdc, proc_name_current AS proc_name,
               count(*) AS number_of_instances, sum(duration_ms) AS total_duration_ms
        FROM src_userwait GROUP BY ALL""",
    "rep_hwpkg": "SELECT load_ts, guid, dt, instance, nrs, mean, rap_22 AS max FROM src_hw_pack_power",
    "rep_c0": _flat_metric(
        "HW::CORE:C0:PERCENT:", "pkg_c0",
        "max(CAST(attribute_metric_level1 AS SMALLINT)) AS number_of_cores, "
        "max(duration_ms) AS duration_ms"),
    "rep_freq": _core_metric("HW::CORE:AVG_FREQ:MHZ:", "avg_freq_mhz"),
    "rep_temp": _core_metric("HW::CORE:TEMPERATURE:CENTIGRADE:", "temp_centigrade"),
    "rep_psys": _flat_metric(
        "HW:::PSYS_RAP:WATTS:", "psys_rap_watts", "sum(duration_ms) AS duration_ms"),
    "rep_net": f"""
        SELECT guid, dt, input_description AS input_desc, sum(nr_samples) AS nrs,
               min(min_bytes_sec) AS min_bytes_sec,
               {_wavg('avg_bytes_sec', 'nr_samples')} AS avg_bytes_sec,
               max(max_bytes_sec) AS max_bytes_sec
        FROM src_network GROUP BY ALL""",
    "rep_webdur": f"SELECT guid, dt, {pivot_columns('duration_ms')} FROM src_web_usage GROUP BY guid, dt",
    "rep_web": """
        SELECT guid, dt, browser, parent_category, sub_category,
               sum(duration_ms) AS duration_ms, sum(page_load_count) AS page_load_count,
               sum(site_count) AS site_count, sum(domain_count) AS domain_count,
               sum(page_visit_count) AS page_visit_count
        FROM src_web_usage GROUP BY ALL""",
    "rep_mem": f"""
        SELECT guid, dt, nrs, free AS avg_free_ram, size AS sysinfo_ram,
               size - free AS utilized_ram, round_dec((size - free) * 1e2 / size) AS avg_percentage_used
        FROM (SELECT m.guid, m.dt, sum(sample_count) AS nrs,
                     {_wavg('average', 'sample_count')} AS free,
                     CAST(s.ram * 1024 AS INTEGER) AS size
              FROM src_memory m JOIN src_sysinfo s ON m.guid = s.guid
              WHERE s.ram <> 0 GROUP BY m.guid, m.dt, s.ram) sized""",
    "rep_power": f"""
        SELECT guid, CAST(ts_local AS DATE) AS dt, string_split(app_id, chr(92))[-1] AS app_id, user_id,
               {', '.join(f'CAST(sum({p}_power_consumption) AS INTEGER) AS {p}_power_consumption'
                          for p in POWER_PARTS)}
        FROM src_mods_power GROUP BY ALL""",
    "rep_batt": f"""
        SELECT load_ts, guid, CAST(power_on_dc_ts AS DATE) AS dt, sum(duration_mins) AS duration_mins,
               {_BATT}, count(power_on_dc_ts) AS num_power_ons
        FROM src_batt_dc_events GROUP BY ALL""",
}

# ------------------------------------------------------------ exact release queries

_K = DEMO_LIMITS.min_units
_STATES = ("on", "off", "mods", "sleep")
_TOTAL = " + ".join(CATEGORY_COLUMNS)



def release_ctes(p: str, groups: int | None) -> dict[str, str]:
    """The twelve queries under names that begin with ``p``.

    With ``groups`` a device counts in so many groups at most, chosen by a hash, where groups come
    from the facts, and a mean is NULL without enough devices that have a value.
    """

    def few(*names: str, unit: str = "guid") -> str:
        if groups is None:
            return ""
        parts = ", ".join(f"coalesce(CAST({n} AS VARCHAR), '')" for n in (unit, *names))
        return (f"QUALIFY row_number() OVER (PARTITION BY {unit} "
                f"ORDER BY md5(concat_ws('|', {parts})), {', '.join(names)}) <= {groups}")

    def mean(x: str, q: int) -> str:
        return f"avg({x})" if groups is None else f"CASE WHEN count({x}) >= {_K[q]} THEN avg({x}) END"

    return {
    f"{p}01": f"""
        SELECT country, count(*) AS number_of_systems, {mean('ons', 1)} AS avg_number_of_dc_powerons,
               {mean('mins', 1)} AS avg_duration
        FROM (SELECT s.countryname_normalized AS country, b.guid, least(avg(num_power_ons), 10) AS ons,
                     least(avg(duration_mins), 60) AS mins
              FROM rep_batt b JOIN src_sysinfo s ON s.guid = b.guid GROUP BY 1, 2) device
        GROUP BY country HAVING count(*) >= {_K[1]}""",
    f"{p}02": f"""
        SELECT marketcodename, cpugen, count(*) AS number_of_systems,
               {mean('mins', 2)} AS avg_duration_mins_on_battery
        FROM (SELECT marketcodename, cpugen, b.guid, least(avg(duration_mins), 60) AS mins
              FROM rep_batt b JOIN src_cpu_metadata c ON c.guid = b.guid
              WHERE cpugen <> 'Unknown' GROUP BY 1, 2, 3) device
        GROUP BY 1, 2 HAVING count(*) >= {_K[2]}""",
    f"{p}03": f"""
        SELECT connection_type, resolution, count(*) AS number_of_systems,
               round_dec({mean('ac', 3)}, 2) AS average_duration_on_ac_in_seconds,
               round_dec({mean('dc', 3)}, 2) AS average_duration_on_dc_in_seconds
        FROM (SELECT connection_type, concat(resolution_heigth, 'x', resolution_width) AS resolution,
                     guid, least(avg(duration_ac), 3600) AS ac, least(avg(duration_dc), 3600) AS dc
              FROM rep_display
              WHERE connection_type IS NOT NULL AND resolution_heigth <> 0 AND resolution_width <> 0
              GROUP BY 1, 2, 3 {few('connection_type', 'resolution')}) device
        GROUP BY 1, 2 HAVING count(*) >= {_K[3]}""",
    f"{p}04": f"""
        SELECT vendor_name, n AS number_of_systems, sum(n) OVER () AS total_number_of_systems,
               round_dec(n * 1e2 / sum(n) OVER (), 2) AS percentage_of_systems
        FROM (SELECT vendor_name, count(*) AS n
              FROM (SELECT vendor_name, guid FROM rep_display WHERE vendor_name IS NOT NULL
                    GROUP BY 1, 2 {few('vendor_name')}) device GROUP BY 1) vendors""",
    f"{p}05": f"""
        SELECT os_name, os_codename, sum(n) AS num_entries, count(*) AS number_of_systems,
               CAST(sum(n) AS DOUBLE) / count(*) AS entries_per_system
        FROM (SELECT os_name, os_codename, b.guid, least(count(*), 50) AS n
              FROM src_blockers b JOIN src_os_history h
                ON h.guid = b.guid AND dt_utc >= min_ts AND dt_utc <= max_ts
              GROUP BY 1, 2, 3 {few('os_name', 'os_codename', unit='b.guid')}) device
        GROUP BY 1, 2 HAVING count(*) >= {_K[5]}""",
    f"{p}06_counts": f"""
        SELECT country, browser, count(*) AS number_of_systems
        FROM (SELECT countryname_normalized AS country, browser, w.guid
              FROM rep_web w JOIN src_sysinfo s ON s.guid = w.guid
              WHERE browser IS NOT NULL GROUP BY 1, 2, 3 {few('country', 'browser', unit='w.guid')}) device
        GROUP BY 1, 2""",
    f"{p}06": f"""
        SELECT country, browser FROM {p}06_counts c
        WHERE number_of_systems = (SELECT max(number_of_systems) FROM {p}06_counts m
                                   WHERE m.country = c.country)""",
    f"{p}07": f"""
        SELECT marketcodename, cpugen, count(*) AS number_of_systems,
               round_dec({mean('s_on', 7)}, 2) AS avg_on_time, round_dec({mean('s_off', 7)}, 2) AS avg_off_time,
               round_dec({mean('s_mods', 7)}, 2) AS avg_modern_sleep_time, round_dec({mean('s_sleep', 7)}, 2) AS avg_sleep_time,
               round_dec({mean('s_on + s_off + s_mods + s_sleep', 7)}, 2) AS avg_total_time,
               {', '.join(f"round_dec(sum(s_{s}) * 1e2 / nullif(sum(s_on + s_off + s_mods + s_sleep), 0), 2)"
                          f" AS avg_pcnt_{s}_time" for s in _STATES)}
        FROM (SELECT marketcodename, cpugen, o.guid,
                     {', '.join(f'least(avg({s}_time), 1440) AS s_{s}' for s in _STATES)}
              FROM src_on_off o JOIN src_cpu_metadata c ON c.guid = o.guid GROUP BY 1, 2, 3) device
        GROUP BY 1, 2 HAVING count(*) >= {_K[7]}""",
    f"{p}08": f"""
        SELECT persona, count(*) AS number_of_systems, sum(days) AS days,
               {', '.join(f"round_dec(1e2 * sum(days * {c} / total) / sum(days), 3) AS {c}"
                          for c in CATEGORY_COLUMNS)}
        FROM (SELECT w.guid, persona, least(count(*), 365) AS days,
                     {', '.join(f"least(sum({c}), 3.6e6) AS {c}" for c in CATEGORY_COLUMNS)},
                     least(sum({_TOTAL}), 3.6e6) AS total
              FROM rep_webdur w JOIN src_sysinfo s ON s.guid = w.guid GROUP BY 1, 2) device
        WHERE total > 0 GROUP BY persona HAVING count(*) >= {_K[8]}""",
    f"{p}09": f"""
        SELECT countryname_normalized, count(*) AS number_of_systems, {mean('w', 9)} AS avg_pkg_power_consumed
        FROM (SELECT countryname_normalized, p.guid, least({_wavg('mean', 'nrs')}, 50) AS w
              FROM rep_hwpkg p JOIN src_sysinfo s ON s.guid = p.guid GROUP BY 1, 2) device
        GROUP BY 1 HAVING count(*) >= {_K[9]}""",
    f"{p}10": f"""
        SELECT browser, round_dec(n * 1e2 / sum(n) OVER (), 2) AS percent_systems,
               round_dec(r * 1e2 / sum(r) OVER (), 2) AS percent_instances,
               round_dec(ms * 1e2 / sum(ms) OVER (), 2) AS percent_duration
        FROM (SELECT browser, count(*) AS n, sum(r) AS r, sum(ms) AS ms
              FROM (SELECT browser, guid, least(count(*), 50) AS r, least(sum(duration_ms), 3.6e6) AS ms
                    FROM rep_web WHERE browser IS NOT NULL GROUP BY 1, 2 {few('browser')}) device
              GROUP BY 1) browsers""",
    f"{p}11": f"""
        SELECT ram_gb, count(*) AS number_of_systems,
               round_dec({mean('u', 11)}) AS avg_percentage_used
        FROM (SELECT sysinfo_ram / 1024 AS ram_gb, guid, least(avg(avg_percentage_used), 100) AS u
              FROM rep_mem WHERE avg_percentage_used > 0 GROUP BY 1, 2 {few('ram_gb')}) device
        GROUP BY 1 HAVING count(*) >= {_K[11]}""",
    f"{p}12": f"""
        SELECT user_id, least(sum(total_power_consumption), 100) AS total_power_consumption,
               rank() OVER (ORDER BY least(sum(total_power_consumption), 100) DESC) AS rnk
        FROM rep_power GROUP BY user_id""",
}


CTES |= release_ctes("e", None)
CTES |= release_ctes("s", GROUPS)

# ------------------------------------------------------------------- private release

DEMO_REGISTRY = release_registry(DEMO_LIMITS)
PUBLISHED_REGISTRY = release_registry(published_sensitivity_limits(DEMO_LIMITS))
DEMO_POLICY = Policy()


def key_part(column: str) -> str:
    """A grouping value as it stands in a joined key: NULL, backslash and separator marked."""
    text = f"replace(replace(CAST({column} AS VARCHAR), '\\', '\\b'), chr(31), '\\s')"
    return f"coalesce({text}, '\\0')"


def cells_text(prefix: str) -> str:
    parts = []
    for q in DEMO_REGISTRY.values():
        key = ", ".join(map(key_part, q.keys))
        for c in q.columns:
            parts.append(
                f"SELECT {q.number} AS query_num, concat_ws(chr(31), {key}) AS group_key, "
                f"'' AS item, '{c.name}' AS col, CAST({c.name} AS DOUBLE) AS true_value "
                f"FROM {prefix}{q.number:02d}"
            )
    return " UNION ALL ".join(parts)


def _literal(x) -> str:
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, str):
        return f"'{x}'"
    if x == float("inf"):
        return "'inf'::DOUBLE"
    return f"{x!r}::DOUBLE" if isinstance(x, float) else repr(x)


def uniform(*parts: str) -> str:
    text = f"concat_ws('|', '{DEMO_SEED}', {', '.join(parts)})"
    return f"((CAST('0x' || substr(md5({text}), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0)"


def laplace(scale: str, u: str) -> str:
    return f"(-({scale}) * sign({u} - 0.5) * ln(1 - 2 * abs({u} - 0.5)))"


_ID = ("query_num", "col", "epsilon", "mechanism", "group_key", "item")
_GRID = ", ".join(
    f"('{m}', '{epsilon_label(e)}', {_literal(e)})" for m in MECHANISMS for e in EPSILON_GRID
)
_AT = "query_num, mechanism, epsilon"

CTES |= {
    "cells": cells_text("s"),
    **plan_ctes(_K, GROUPS),
    "drawn": f"""
        SELECT c.query_num, mechanism, epsilon, eps, group_key, item, c.col, true_value, is_dist,
               normalise,
               CASE WHEN rescale AND epsilon <> 'inf' AND total > 0 THEN true_value * 100 / total
                    ELSE true_value END AS base,
               scale, {uniform(*[f"c.{x}" if x in ("query_num", "col") else x for x in _ID], "'1'")} AS u1,
               {uniform(*[f"c.{x}" if x in ("query_num", "col") else x for x in _ID], "'2'")} AS u2
        FROM (SELECT *, sum(true_value) OVER (PARTITION BY query_num, col) AS total FROM cells) c
        JOIN plan p ON p.query_num = c.query_num AND p.col = c.col""",
    "clamped": f"""
        SELECT * REPLACE (CASE WHEN epsilon = 'inf' THEN base
            WHEN mechanism = 'laplace' THEN greatest(base + {laplace('scale', 'u1')}, 0)
            ELSE greatest(base + scale * sqrt(-2 * ln(u1)) * cos(2 * pi() * u2), 0) END AS base)
        FROM drawn""",
    "scaled": f"""
        SELECT * REPLACE (CASE WHEN normalise AND epsilon <> 'inf' AND t > 0 THEN base * 100 / t
                               ELSE base END AS base)
        FROM (SELECT *, sum(base) OVER (PARTITION BY {_AT}, col) AS t FROM clamped) x""",
    "row_scaled": f"""
        SELECT * REPLACE (CASE WHEN is_dist AND epsilon <> 'inf'
            THEN CASE WHEN r > 0 THEN base * 100 / r ELSE base END + 0.01 ELSE base END AS base)
        FROM (SELECT *, sum(base) OVER (PARTITION BY {_AT}, group_key, is_dist) AS r FROM scaled) x""",
    "released": f"""
        SELECT {_AT}, group_key, item, col, true_value,
               CASE WHEN is_dist AND epsilon <> 'inf' AND r2 > 0 THEN base * 100 / r2 ELSE base END
                   AS noisy_value
        FROM (SELECT *, sum(base) OVER (PARTITION BY {_AT}, group_key, is_dist) AS r2
              FROM row_scaled) x""",
    "selection_draws": f"""
        SELECT 6 AS query_num, mechanism, epsilon, {key_part('country')} AS group_key, browser AS item,
               number_of_systems AS true_value,
               CASE WHEN epsilon = 'inf' THEN number_of_systems ELSE number_of_systems
                   + {laplace(f'{GROUPS} / eps', uniform('6', 'epsilon', 'mechanism', key_part('country'), 'browser', "'1'"))}
               END AS noisy_value
        FROM s06_counts CROSS JOIN (SELECT * FROM (VALUES {_GRID}) AS v(mechanism, epsilon, eps)) g""",
    "winners": f"""
        SELECT {_AT}, group_key,
               (array_agg(item ORDER BY true_value DESC, item DESC))[1] AS true_item,
               (array_agg(item ORDER BY noisy_value DESC, item DESC))[1] AS noisy_item
        FROM selection_draws GROUP BY ALL""",
}

# --------------------------------------------------------------------- utility metrics


def _metric_filter(metric: str) -> str:
    tests = [
        f"(query_num = {q.number} AND col IN ({', '.join(repr(c) for c in q.metric_columns)}))"
        for q in DEMO_REGISTRY.values() if q.metric == metric and q.columns
    ]
    return " OR ".join(tests)


def r4(x: str) -> str:
    return f"round_dec({x}, 4)"


_AVG_RANK = (
    "(rank() OVER (PARTITION BY {p} ORDER BY {v} {d}) "
    "+ (count(*) OVER (PARTITION BY {p}, {v}) - 1) / 2.0)"
)


def _rho(x: str, y: str) -> str:
    return (
        f"CASE WHEN count(*) < 2 THEN NULL WHEN var_pop({x}) = 0 OR var_pop({y}) = 0 THEN 0.0 "
        f"ELSE {r4(f'covar_pop({x}, {y}) / sqrt(var_pop({x}) * var_pop({y}))')} END"
    )


def _spread(x: str, y: str) -> str:
    """What the p-value of a correlation needs: degrees of freedom, no variation, size."""
    return (
        f"count(*) - 2 AS df, var_pop({x}) = 0 OR var_pop({y}) = 0 AS flat, "
        f"least(abs(covar_pop({x}, {y}) / sqrt(var_pop({x}) * var_pop({y}))), 1.0) AS r"
    )


def p_value() -> str:
    """Two-sided p-value by Student's t from the columns of :func:`_spread`.

    For whole degrees of freedom the distribution is a finite sum over powers of an angle's
    cosine; the angle's tangent is t / sqrt(degrees), so its sine is the correlation itself.
    """
    even = ("list_sum(list_transform(range(0, df // 2), lambda k: exp(lgamma(2 * k + 1) "
            "- 2 * lgamma(k + 1) - k * ln(4.0)) * pow(1 - r * r, k)))")
    odd = ("coalesce(list_sum(list_transform(range(0, (df - 1) // 2), lambda k: exp(k * ln(4.0) "
           "+ 2 * lgamma(k + 1) - lgamma(2 * k + 2)) * pow(1 - r * r, k + 0.5))), 0)")
    return (
        f"CASE WHEN df < 0 THEN NULL WHEN flat THEN 1.0 WHEN df < 1 THEN NULL "
        f"WHEN r >= 1 THEN 0.0 WHEN df % 2 = 0 THEN {r4(f'1 - r * {even}')} "
        f"ELSE {r4(f'1 - 2 / pi() * (asin(r) + r * {odd})')} END"
    )


_FIRST = " OR ".join(
    f"(query_num = {q.number} AND col = '{q.metric_columns[0]}')"
    for q in DEMO_REGISTRY.values() if q.columns
)
_KIND = "CASE " + " ".join(
    f"WHEN query_num = {q.number} THEN '{q.metric}'" for q in DEMO_REGISTRY.values()
) + " END"

CTES |= {
    "m_re": f"""
        SELECT {_AT}, {r4('median(abs(true_value - noisy_value) / abs(true_value))')} AS median_re
        FROM released WHERE true_value <> 0 AND ({_metric_filter('RE')}) GROUP BY ALL""",
    "m_tvd": f"""
        SELECT {_AT}, col, {r4('sum(abs(true_value / t - noisy_value / n)) / 2')} AS tvd
        FROM (SELECT *, CASE WHEN sum(true_value) OVER w > 0 THEN sum(true_value) OVER w ELSE 1 END AS t,
                     CASE WHEN sum(noisy_value) OVER w > 0 THEN sum(noisy_value) OVER w ELSE 1 END AS n
              FROM released WHERE {_metric_filter('TVD')}
              WINDOW w AS (PARTITION BY {_AT}, col)) x
        GROUP BY {_AT}, col""",
    "m_pivot": f"""
        SELECT {_AT}, {r4('avg(tvd)')} AS mean_tvd, {r4('max(tvd)')} AS max_tvd
        FROM m_tvd WHERE query_num IN (7, 8) GROUP BY ALL""",
    "m_rho": f"""
        SELECT {_AT}, {_rho('tr', 'nr')} AS spearman_rho, {_spread('tr', 'nr')}
        FROM (SELECT {_AT}, {_AVG_RANK.format(p=_AT, v='true_value', d='DESC')} AS tr,
                     {_AVG_RANK.format(p=_AT, v='noisy_value', d='DESC')} AS nr
              FROM released WHERE {_metric_filter('SPEARMAN')}) x
        GROUP BY {_AT}""",
    "placed": f"""
        SELECT *, row_number() OVER (PARTITION BY {_AT} ORDER BY group_key) - 1 AS pos,
               count(*) OVER (PARTITION BY {_AT}) AS n
        FROM winners""",
    "m_cat": f"""
        SELECT {_AT}, {_rho('pos', 'nr')} AS spearman_rho, {_spread('pos', 'nr')}
        FROM (SELECT *, {_AVG_RANK.format(p=_AT, v='lab', d='ASC')} AS nr
              FROM (SELECT a.*, coalesce((SELECT max(b.pos) FROM placed b
                        WHERE b.mechanism = a.mechanism AND b.epsilon = a.epsilon
                          AND b.true_item = a.noisy_item), a.n) AS lab
                    FROM placed a) y) x
        GROUP BY {_AT}""",
    "summary0": f"""
        SELECT s.*, {_KIND} AS metric_type, median_re, spearman_rho, mean_tvd, max_tvd, tvd
        FROM (SELECT {_AT}, count(*) AS n_rows FROM released WHERE {_FIRST} GROUP BY ALL
              UNION ALL SELECT {_AT}, count(*) FROM winners GROUP BY ALL) s
        LEFT JOIN m_re USING ({_AT})
        LEFT JOIN m_pivot USING ({_AT})
        LEFT JOIN (SELECT * FROM m_tvd WHERE query_num NOT IN (7, 8)) t USING ({_AT})
        LEFT JOIN (SELECT * FROM m_rho UNION ALL SELECT * FROM m_cat) r USING ({_AT})""",
    "scored": """
        SELECT query_num, mechanism, epsilon, metric_type, n_rows, median_re, spearman_rho, mean_tvd,
               max_tvd, tvd, CAST(epsilon AS DOUBLE) AS eps, epsilon = 'inf' AS no_noise,
               metric_type <> 'SPEARMAN' AS lower,
               coalesce(median_re, mean_tvd, tvd, spearman_rho) AS value,
               CASE WHEN median_re IS NOT NULL THEN 'median_re' WHEN mean_tvd IS NOT NULL THEN 'mean_tvd'
                    WHEN tvd IS NOT NULL THEN 'tvd' ELSE 'spearman_rho' END AS primary_col,
               CASE metric_type WHEN 'RE' THEN 0.25 WHEN 'TVD' THEN 0.15 ELSE 0.5 END AS threshold,
               CASE WHEN epsilon = 'inf' THEN 1000.0 ELSE CAST(epsilon AS DOUBLE) END AS position
        FROM summary0""",
    "judged": """
        SELECT *, CASE WHEN lower THEN value <= threshold ELSE value >= threshold END AS ok
        FROM scored WHERE value IS NOT NULL""",
    "based": """
        SELECT *, max(CASE WHEN no_noise THEN value END) OVER (PARTITION BY query_num, mechanism) AS b
        FROM judged""",
    "utility": """
        SELECT *, CASE WHEN lower AND abs(b) < 1e-9 THEN 1 - value / 0.02
                       WHEN lower THEN 1 - (value - b) / abs(b)
                       WHEN abs(b) >= 1e-9 THEN 1 - (b - value) / abs(b) END AS score
        FROM based WHERE NOT no_noise AND eps <= 1""",
    "y_eval": f"""
        SELECT query_num, mechanism, metric_type, any_value(primary_col) AS primary_col,
               arg_max(value, (CASE WHEN lower THEN value ELSE -value END, -eps)) AS worst_value,
               arg_max(epsilon, (CASE WHEN lower THEN value ELSE -value END, -eps)) AS worst_epsilon,
               arg_min(value, (CASE WHEN lower THEN value ELSE -value END, eps)) AS best_value,
               arg_min(epsilon, (CASE WHEN lower THEN value ELSE -value END, eps)) AS best_epsilon,
               max(b) AS baseline_value, {r4('avg(value)')} AS mean_across_eps,
               {r4('stddev_samp(value)')} AS std_across_eps,
               count(*) FILTER (WHERE ok AND NOT no_noise) AS n_pass_hard,
               count(*) FILTER (WHERE NOT no_noise AND CASE WHEN lower THEN value <= b / 0.9
                                ELSE value >= b * 0.9 END) AS n_pass_adaptive,
               count(*) FILTER (WHERE NOT no_noise) AS n_epsilons
        FROM based GROUP BY query_num, mechanism, metric_type""",
    "y_cmp": f"""
        SELECT g.query_num, g.epsilon, g.eps, g.metric_type, g.primary_col, g.lower, g.threshold,
               g.no_noise, {r4('g.value')} AS gaussian_value, {r4('l.value')} AS laplace_value,
               {r4('g.value - l.value')} AS difference,
               CASE WHEN abs(g.value - l.value) < 1e-7 THEN 'tie'
                    WHEN (g.value < l.value) = g.lower THEN 'gaussian' ELSE 'laplace' END AS winner
        FROM judged g JOIN judged l ON g.query_num = l.query_num AND g.epsilon = l.epsilon
        WHERE g.mechanism = 'gaussian' AND l.mechanism = 'laplace'""",
    "y_table": f"""
        SELECT mechanism, eps, {r4('avg(score)')} AS mean_utility_preserved,
               {r4('min(score)')} AS min_utility_preserved, count(*) AS n_queries_scored
        FROM utility WHERE score IS NOT NULL GROUP BY mechanism, eps""",
    "y_pick": """
        SELECT mechanism, coalesce(min(eps) FILTER (WHERE mean_utility_preserved >= 0.8),
                                   arg_max(eps, (mean_utility_preserved, -eps))) AS best_epsilon,
               CASE WHEN max(mean_utility_preserved) >= 0.8 THEN 'utility_threshold_met'
                    ELSE 'best_available' END AS status
        FROM y_table GROUP BY mechanism""",
    "y_select": """
        SELECT p.mechanism, best_epsilon, t.mean_utility_preserved, t.min_utility_preserved,
               t.n_queries_scored, r.eps AS runner_up_epsilon,
               r.mean_utility_preserved AS runner_up_utility,
               CASE WHEN t.mean_utility_preserved - r.mean_utility_preserved <= 0.05 THEN 1 ELSE 0 END
                   AS near_miss, status
        FROM y_pick p JOIN y_table t ON t.mechanism = p.mechanism AND t.eps = p.best_epsilon
        LEFT JOIN y_table r ON r.mechanism = p.mechanism
             AND r.eps = (SELECT max(x.eps) FROM y_table x
                          WHERE x.mechanism = p.mechanism AND x.eps < p.best_epsilon)""",
    "y_cmp_long": """
        SELECT *, CASE WHEN lower AND abs(b) < 1e-9 THEN 1 - value / 0.02
                       WHEN lower THEN 1 - (value - b) / abs(b)
                       WHEN abs(b) >= 1e-9 THEN 1 - (b - value) / abs(b) END AS score
        FROM (SELECT *, max(CASE WHEN no_noise THEN value END) OVER (PARTITION BY query_num, mechanism) AS b
              FROM (SELECT * EXCLUDE (gaussian_value, laplace_value), 'gaussian' AS mechanism,
                           gaussian_value AS value FROM y_cmp
                    UNION ALL SELECT * EXCLUDE (gaussian_value, laplace_value), 'laplace', laplace_value
                    FROM y_cmp) v) x""",
    "y_best": """
        SELECT c.query_num, c.mechanism, c.metric_type, best_epsilon,
               CASE WHEN CASE WHEN lower THEN value <= threshold ELSE value >= threshold END
                    THEN 1 ELSE 0 END AS passed_hard, status
        FROM y_cmp_long c JOIN (
            SELECT query_num, mechanism,
                   coalesce(min(eps) FILTER (WHERE score >= 0.8), arg_max(eps, (score, -eps))) AS best_epsilon,
                   CASE WHEN max(score) >= 0.8 THEN 'utility_threshold_met' ELSE 'best_available' END AS status
            FROM y_cmp_long WHERE NOT no_noise AND eps <= 1 AND score IS NOT NULL GROUP BY 1, 2) p
          ON p.query_num = c.query_num AND p.mechanism = c.mechanism AND p.best_epsilon = c.eps""",
}
