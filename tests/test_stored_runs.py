"""Runs over what earlier runs stored: one epsilon again, evaluation of summaries."""

import os

import pytest
from pyspark.sql import functions as F

from fleetveil.operators.noise import Policy
from fleetveil.plans import evaluation
from fleetveil.plans.registry import INF, release_registry
from fleetveil.plans.release import exact_cells, noisy_cells, rerun_epsilon
from fleetveil.sources.sinks import noisy_only, read_release, write_release, write_summary
from oracles.texts import DEMO_LIMITS

REGISTRY = release_registry(DEMO_LIMITS)


def files(folder):
    return {
        os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns
        for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")
    }


def test_one_epsilon_again_replaces_its_partitions_alone(spark, tables, tmp_path):
    folder = str(tmp_path / "release")
    cells = exact_cells(tables, REGISTRY, DEMO_LIMITS, [1, 10]).cache()
    grid = [0.1, 0.5, INF]
    write_release(noisy_only(noisy_cells(cells, REGISTRY, Policy(), "a seed", epsilons=grid)), folder)
    before, rows = files(folder), sorted(read_release(spark, folder).collect())
    assert rerun_epsilon(cells, REGISTRY, Policy(), "a seed", 0.5, folder, grid) == 1
    after = files(folder)
    kept = {f for f in before if "epsilon=0.5" not in f}
    assert kept and all(after.get(f) == before[f] for f in kept)
    assert not {f for f in before if "epsilon=0.5" in f} & after.keys()
    assert sorted(read_release(spark, folder).collect()) == rows
    # Another seed changes that epsilon and nothing else.
    rerun_epsilon(cells, REGISTRY, Policy(), "another", 0.1, folder, grid)
    again = sorted(read_release(spark, folder).collect())
    changed = {r.epsilon for r in set(again) ^ set(rows)}
    assert changed == {"0.1"} and len(again) == len(rows)
    with pytest.raises(ValueError, match="not on the grid"):
        rerun_epsilon(cells, REGISTRY, Policy(), "a seed", 0.3, folder, grid)


def summary_rows(spark, mechanism):
    rows = [
        (q, mechanism, "advance", e, None, None, "full", 3, kind, *((v,) + (None,) * 5 if kind == "RE" else (None, v, None, None, None, None)), 1)
        for q, kind, v in ((1, "RE", 0.1 if mechanism == "laplace" else 0.2), (3, "SPEARMAN", 0.9))
        for e in ("0.5", "inf")
    ]
    return spark.createDataFrame(rows, evaluation.SUMMARY_SCHEMA)


def test_evaluation_of_stored_summaries(spark, tmp_path):
    folders = {m: str(tmp_path / m) for m in ("gaussian", "laplace")}
    out = str(tmp_path / "out")
    write_summary(summary_rows(spark, "laplace"), folders["laplace"])
    report = {r.table: r for r in evaluation.evaluation_job(spark, folders, out).collect()}
    # One summary is missing: it is reported, the other is evaluated, there is nothing to compare.
    assert report["gaussian"].status == "missing" and report["laplace"].rows == 4
    assert report["evaluation_summary"].rows == 2 and "comparison" not in report
    write_summary(summary_rows(spark, "gaussian"), folders["gaussian"])
    report = {r.table: r for r in evaluation.evaluation_job(spark, folders, out).collect()}
    assert {r.status for r in report.values()} == {"ok"} and report["evaluation_summary"].rows == 4
    stored = spark.read.parquet(f"{out}/comparison")
    both = summary_rows(spark, "laplace").unionByName(summary_rows(spark, "gaussian"))
    want = evaluation.mechanism_comparison(both)
    assert sorted(map(str, stored.select(want.columns).collect())) == sorted(map(str, want.collect()))
    assert stored.where(F.col("query_num") == 1).count() == 2
    nothing = evaluation.evaluation_job(spark, {"gaussian": str(tmp_path / "no")}, str(tmp_path / "none"))
    assert [r.status for r in nothing.collect()] == ["missing"] and not (tmp_path / "none").exists()
