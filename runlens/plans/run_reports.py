"""Run every analysis over a results folder and write the tables as data.

    python -m runlens.plans.run_reports RESULTS_DIR OUT_DIR [--strict] [--format parquet|csv|json]

Reads the folder once (NDJSON run logs of all kinds, routed by file name, or the
run store) into a table partitioned by kind in the shared folder, and writes: the
four SQL analyses (totals, summary, idle rows, parallel batch summary), the five
report tables and the status table, one folder each. ``--strict`` restricts
totals / summary to lifecycle files; by default they read every row of the
folder, as a bare ``*.jsonl`` scan does. Lines that are no JSON record change no
table; the status table counts them (``--failfast`` stops at the first). A
folder that isn't there is an error.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from runlens.plans import reports
from runlens.session import path_exists, scratch_path
from runlens.sources.runlogs import CORRUPT, scan_runs
from runlens.sources.schemas import KIND_SCHEMAS
from runlens.sources.sinks import write_report


def read_once(spark: SparkSession, results: str, bad_lines: str = "quarantine") -> tuple[DataFrame, dict[str, int]]:
    """Every row of the folder, parsed once: all kinds' fields, ``kind``, and the text of
    bad lines, as a Parquet table partitioned by kind; and the bad lines of each kind, counted
    as the table is written."""
    if not path_exists(spark, results):
        raise FileNotFoundError(f"no such results folder: {results}")
    rows = scan_runs(spark, results, None, bad_lines=bad_lines, with_file=True)
    if CORRUPT not in rows.columns:
        rows = rows.withColumn(CORRUPT, F.lit(None).cast("string"))
    path = scratch_path(spark, "runs")
    seen = Observation()
    bad = [F.count_if((F.col("kind") == k) & F.col(CORRUPT).isNotNull()).alias(k) for k in KIND_SCHEMAS]
    rows.observe(seen, *bad).write.partitionBy("kind").parquet(path)
    return spark.read.schema(rows.schema).parquet(path), seen.get


def build(spark: SparkSession, results: str, strict: bool = False,
          bad_lines: str = "quarantine") -> dict[str, DataFrame]:
    """All analyses over ``results`` plus ``status``. The folder is read, and
    rankings and gates run, while they are built."""
    rows, bad = read_once(spark, results, bad_lines)
    good = rows.where(F.col(CORRUPT).isNull()).drop(CORRUPT)

    def of(kind: str) -> DataFrame:
        return good.where(F.col("kind") == kind).select(*KIND_SCHEMAS[kind].fieldNames())

    idle, parallel = of("idle"), of("parallel")
    every = of("lifecycle") if strict else good
    rep = {
        "lifecycle": reports.report_lifecycle(good),
        "idle": reports.report_idle(idle),
        "stealth": reports.report_stealth(of("stealth")),
        "captcha": reports.report_captcha(of("captcha")),
        "parallel": reports.report_parallel(parallel),
    }
    out = {
        "totals": reports.totals(every),
        "summary": reports.summary(every),
        "idle_rows": reports.idle_rows(idle),
        "parallel_summary": reports.parallel_summary(parallel),
    }
    out.update({f"report_{k}": r.df for k, r in rep.items()})
    out["status"] = reports.report_status(spark, rep, bad)
    return out


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    ap.add_argument("results")
    ap.add_argument("out")
    ap.add_argument("--strict", action="store_true")
    ap.add_argument("--failfast", action="store_true")
    ap.add_argument("--format", default="parquet", choices=["parquet", "csv", "json"])
    args = ap.parse_args(argv)
    from runlens import get_session
    spark = get_session()
    for name, df in build(spark, args.results, args.strict,
                          "failfast" if args.failfast else "quarantine").items():
        write_report(df, f"{args.out.rstrip('/')}/{name}", args.format)


if __name__ == "__main__":
    main()
