"""Runs of counting and estimation jobs: parameter grids, time limits, and a record of each run in the experiment store."""

from __future__ import annotations

import itertools
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

from substrata.operators import count
from substrata.operators.runs import STATUS
from substrata.sources import experiments, files

FAIL, START, DONE, TIMEOUT = STATUS
#: What a run gets if one of a smaller share of the queries ran out of time.
SHORT_LIMIT = 5.0


@dataclass(frozen=True)
class CountJob:
    """One run: which strings and queries, the strategy, the threshold, and the share of the queries."""

    strings: str
    queries: str
    alg: str = "auto"
    delta: int = 3
    prefix: bool = False
    share: str = "1.0"
    trial: int = 0

    def key(self) -> str:
        return " ".join(f"--{k} {v}" for k, v in asdict(self).items())

    def result(self, spark: SparkSession) -> DataFrame:
        strings, queries = files.strings(spark, self.strings), files.queries(spark, self.queries)
        if self.share != "1.0":
            queries = files.some(queries, self.share, self.trial)
        make = count.prefix_counts if self.prefix else count.approx_substring_count
        return make(queries, strings, self.delta, strategy=self.alg)

    def out(self, folder: str) -> str:
        stem = self.queries.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]
        return f"{folder}/{files.save_name(stem, f'{self.alg}_{self.share}_{self.trial}', self.delta, self.prefix)}"


@dataclass
class Grid:
    """All combinations of the values of each field."""

    values: dict[str, list] = field(default_factory=dict)

    def jobs(self) -> Iterator[CountJob]:
        for chosen in itertools.product(*self.values.values()):
            yield CountJob(**dict(zip(self.values, chosen, strict=True)))


def limited(spark: SparkSession, work: Callable[[], None], seconds: float | None) -> tuple[int, float]:
    """(status, seconds) of the work; Spark's jobs of it are cancelled when the time is up."""
    tag, out = f"substrata-{uuid.uuid4().hex}", {}
    began = time.monotonic()

    def body() -> None:
        spark.sparkContext.setJobGroup(tag, "substrata", interruptOnCancel=True)
        try:
            work()
            out["status"] = DONE
        except Exception as x:  # the record says what went wrong
            out.update(status=FAIL, error=str(x)[:500])

    thread = threading.Thread(target=body, daemon=True)
    thread.start()
    thread.join(seconds)
    if thread.is_alive():
        spark.sparkContext.cancelJobGroup(tag)
        thread.join(30)
        out = {"status": TIMEOUT}
    return out["status"], time.monotonic() - began


def run(spark: SparkSession, jobs: Iterator[CountJob], store: str, folder: str, seconds: float | None = None) -> None:
    """Run the jobs that the store doesn't have as done, write their tables, and record status and time of each.

    Once a job is out of time, those that differ from it in a larger share
    alone get SHORT_LIMIT seconds.
    """
    late: set[tuple] = set()
    try:
        done = {r.exp_key for r in experiments.scan(spark, store, "status").where(f"get_json_object(value, '$.status') = '{DONE}'").collect()}
    except Exception as x:
        if "PATH_NOT_FOUND" not in str(x):
            raise
        done = set()
    for job in jobs:
        key, kind = job.key(), (job.strings, job.queries, job.alg, job.delta, job.prefix)
        if key in done:
            continue
        experiments.put(spark, store, "status", key, {"status": START})
        status, took = limited(spark, lambda job=job: files.write_counts_long(job.result(spark), job.out(folder)), SHORT_LIMIT if kind in late else seconds)
        if status == TIMEOUT:
            late.add(kind)
        experiments.put(spark, store, "status", key, {"status": status})
        experiments.put(spark, store, "join", key, {"time": took if status == DONE else -1, "alg": job.alg, "d": job.delta, "p": job.prefix})
