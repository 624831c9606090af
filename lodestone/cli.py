"""Command line: python -m lodestone.cli STEP ... (tables are parquet, csv or jsonl)."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from .operators.pool import CoverageError
from .plans import study
from .sources.readers import read_table


def _save(tables: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{folder}/{name}.parquet")


def _cache(spark, a) -> int:
    official = read_table(spark, a.query_metrics) if a.query_metrics else None
    try:
        _save(study.build(read_table(spark, a.raw), a.least, official), a.out)
    except CoverageError as e:
        _save({"candidate_audit": e.audit}, a.out)
        print(e, file=sys.stderr)
        return 1
    return 0


def _preflight(spark, a) -> int:
    means = dict((k, float(v)) for k, v in (m.split("=") for m in a.mean))
    report = study.preflight(read_table(spark, a.scores), read_table(spark, a.metrics), means, a.tolerance)
    _save({"preflight": report}, a.out)
    return 0 if spark.read.parquet(f"{a.out}/preflight.parquet").first()["passed"] else 2


def _search(spark, a) -> int:
    _save(study.search(read_table(spark, a.scores), tuple(a.grids.split(",")), a.resamples), a.out)
    summary = spark.read.parquet(f"{a.out}/summary.parquet")
    if {"w7", "w66"} <= set(a.grids.split(",")):
        _save({"discovery": study.discovery(summary)}, a.out)
    return 0


def _budget(spark, a) -> int:
    _save(study.spend(read_table(spark, a.metrics), a.repeats, a.resamples), a.out)
    return 0


def _pilot(spark, a) -> int:
    _save({"pilot": study.pilot(read_table(spark, a.summary), read_table(spark, a.coverage), a.grid)}, a.out)
    return 0


def _sample(spark, a) -> int:
    _save({"sample": study.confirmation_sample(read_table(spark, a.queries), a.n)}, a.out)
    return 0


def _decide(spark, a) -> int:
    def pair(x, y):
        return (read_table(spark, x), read_table(spark, y)) if x and y else None

    _save({"decision": study.decide(pair(a.fusion_discovery, a.fusion_confirmation), pair(a.budget_discovery, a.budget_confirmation), spark)}, a.out)
    return 0


STEPS = {
    "cache": (_cache, [("--raw", {"required": True}), ("--least", {"type": float, "default": 0.95}), ("--query-metrics", {})]),
    "preflight": (_preflight, [("--scores", {"required": True}), ("--metrics", {"required": True}), ("--mean", {"action": "append", "default": [], "metavar": "COLUMN=VALUE"}), ("--tolerance", {"type": float, "default": 0.01})]),
    "search": (_search, [("--scores", {"required": True}), ("--grids", {"default": "w7,w66"}), ("--resamples", {"type": int, "default": 10_000})]),
    "budget": (_budget, [("--metrics", {"required": True}), ("--repeats", {"type": int, "default": 100}), ("--resamples", {"type": int, "default": 10_000})]),
    "pilot": (_pilot, [("--summary", {"required": True}), ("--coverage", {"required": True}), ("--grid", {"default": "w7"})]),
    "sample": (_sample, [("--queries", {"required": True}), ("-n", {"type": int, "default": 2000})]),
    "decide": (_decide, [("--fusion-discovery", {}), ("--fusion-confirmation", {}), ("--budget-discovery", {}), ("--budget-confirmation", {})]),
}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    root = argparse.ArgumentParser(prog="lodestone")
    steps = root.add_subparsers(dest="step", required=True)
    for name, (_, options) in STEPS.items():
        p = steps.add_parser(name)
        p.add_argument("--out", required=True)
        for flag, settings in options:
            p.add_argument(flag, **settings)
    a = root.parse_args(argv)
    return STEPS[a.step][0](spark or SparkSession.builder.appName("lodestone").getOrCreate(), a)


if __name__ == "__main__":
    sys.exit(main())
