"""python -m substrata count STRINGS --queries Q --out DIR --store S | estimate COUNTS --strings N --out DIR --store S | report S"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from substrata.operators import count, job, metrics, models
from substrata.sources import experiments, files, reports


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="substrata")
    commands = p.add_subparsers(dest="command", required=True)
    c = commands.add_parser("count", help="count tables of all combinations of the options")
    c.add_argument("strings", nargs="+")
    c.add_argument("--queries", nargs="+", required=True)
    c.add_argument("--alg", nargs="+", default=["auto"], choices=["auto", *count.STRATEGIES])
    c.add_argument("--delta", nargs="+", type=int, default=[3])
    c.add_argument("--prefix", action="store_true")
    c.add_argument("--share", nargs="+", default=["1.0"])
    c.add_argument("--trials", type=int, default=1)
    c.add_argument("--out", required=True)
    c.add_argument("--store", required=True)
    c.add_argument("--seconds", type=float)
    e = commands.add_parser("estimate", help="fit estimators to a long count table and judge them on held-out queries")
    e.add_argument("counts")
    e.add_argument("--strings", type=int, required=True, help="how many strings were counted")
    e.add_argument("--model", nargs="+", default=["boosted"], choices=[*models.ESTIMATORS, "patterns"])
    e.add_argument("--strings-file", help="the strings that were counted, which the model patterns needs")
    e.add_argument("--p-test", type=float, default=0.1)
    e.add_argument("--p-valid", type=float, default=0.1)
    e.add_argument("--seed", default="0")
    e.add_argument("--out", required=True)
    e.add_argument("--store", required=True)
    r = commands.add_parser("report", help="the last record of each run")
    r.add_argument("store")
    r.add_argument("--table")
    r.add_argument("--keys", help="a pattern with * and ?")
    return p


def main(args: list[str], spark: SparkSession | None = None) -> None:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.getOrCreate()
    if a.command == "count":
        if min(a.delta) < 0:
            raise SystemExit("a threshold is 0 or more")
        grid = job.Grid({"trial": list(range(a.trials)), "strings": a.strings, "queries": a.queries, "prefix": [a.prefix], "delta": a.delta, "alg": a.alg, "share": sorted(a.share, key=float)})
        job.run(spark, grid.jobs(), a.store, a.out, a.seconds)
    elif a.command == "estimate":
        if not 0 < a.p_test + a.p_valid < 1:
            raise SystemExit("the test and validation shares are above 0 and leave something to train on")
        truth = files.counts_long(spark, a.counts).withColumnRenamed("word", "q")
        rows = files.strings(spark, a.strings_file).select(F.monotonically_increasing_id().alias("rid"), "s") if a.strings_file else None
        for name in a.model:
            found = models.evaluate(name, truth, a.strings, p_test=a.p_test, p_valid=a.p_valid, seed=a.seed, strings=rows).persist()
            found.write.mode("overwrite").parquet(f"{a.out}/{name}/estimates")
            metrics.crosstab(found.withColumn("len", F.length("q"))).write.mode("overwrite").parquet(f"{a.out}/{name}/crosstab")
            levels = {f"{r.level:g}": r.value for r in metrics.quantiles(found).collect()}
            experiments.put(spark, a.store, "est", f"--model {name} --counts {a.counts} --seed {a.seed}", {"err": metrics.summary(found).first().mean, "levels": levels})
    else:
        print(reports.to_html(experiments.scan(spark, a.store, a.table, a.keys).orderBy("tbl", "exp_key"), a.table or "all"))


if __name__ == "__main__":
    main(sys.argv[1:])
