"""Orchestration: a registry of steps over recordings, run with skipping of what is there, errors kept to their recording, and a log.

A step takes a context and returns the DataFrame that it stands for; the runner writes it as Parquet below the output folder, at
<recording>/<step>. A step whose folder holds a finished write is skipped. A step that fails ends its recording only. What was done is
a ledger of rows (recording, step, status, detail, seconds), which is appended to the folder `_ledger`. Steps distribute their own
work; the driver only goes from one to the next.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER = "recording string, step string, status string, detail string, seconds double"


@dataclass
class Context:
    spark: SparkSession
    recording: str
    folder: str
    params: dict = field(default_factory=dict)

    def path(self, step: str) -> str:
        return f"{self.folder}/{self.recording}/{step}"

    def result(self, step: str) -> DataFrame:
        """What a step before wrote."""
        return self.spark.read.parquet(self.path(step))


Step = Callable[[Context], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.steps: dict[str, Step] = {}

    def step(self, name: str) -> Callable[[Step], Step]:
        def add(f: Step) -> Step:
            if name in self.steps:
                raise ValueError(f"step {name} is there already")
            self.steps[name] = f
            return f

        return add

    def chosen(self, names: Sequence[str] | None) -> list[str]:
        """The named steps in their order of registration; all without names."""
        unknown = set(names or ()) - set(self.steps)
        if unknown:
            raise ValueError(f"unknown steps: {', '.join(sorted(unknown))}; known: {', '.join(self.steps)}")
        return [n for n in self.steps if not names or n in names]


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a whole write is at path."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def run(spark: SparkSession, registry: Registry, recordings: Iterable[str], folder: str, names: Sequence[str] | None = None, params: dict | None = None, again: bool = False, echo: Callable[[str], None] | None = None) -> DataFrame:
    """Runs the steps for each recording and returns this run's ledger. again: steps that are done run anew."""
    rows: list[tuple] = []
    steps = registry.chosen(names)
    for recording in recordings:
        c = Context(spark, recording, folder, dict(params or {}))
        for i, name in enumerate(steps):
            began = time.time()
            if not again and finished(spark, c.path(name)):
                rows.append((recording, name, "skipped", "", 0.0))
                continue
            try:
                registry.steps[name](c).write.mode("overwrite").parquet(c.path(name))
                rows.append((recording, name, "done", "", time.time() - began))
            except Exception as e:  # the recording's error, whatever it is, must not end the others
                rows.append((recording, name, "failed", str(e).split("\n")[0][:500], time.time() - began))
                rows += [(recording, later, "not run", f"after {name}", 0.0) for later in steps[i + 1 :]]
                break
            finally:
                if echo:
                    echo(" ".join(map(str, rows[-1][:4])))
    ledger = spark.createDataFrame(rows, LEDGER)
    ledger.write.mode("append").parquet(f"{folder}/_ledger")
    return ledger


def over_folders(spark: SparkSession, registry: Registry, folders: Iterable[str], output: str, discover: Callable[[SparkSession, str], DataFrame], names: Sequence[str] | None = None, params: dict | None = None) -> DataFrame:
    """run() for the recordings that discover finds in each folder; a folder that can't be read is a failed row of the ledger."""
    out = spark.createDataFrame([], LEDGER)
    for folder in folders:
        try:
            found = [r["recording"] for r in discover(spark, folder).select("recording").distinct().orderBy("recording").toLocalIterator()]
        except Exception as e:
            out = out.unionByName(spark.createDataFrame([(folder, "discover", "failed", str(e).split("\n")[0][:500], 0.0)], LEDGER))
            continue
        out = out.unionByName(run(spark, registry, found, output, names, (params or {}) | {"folder": folder}))
    return out


def status(spark: SparkSession, folder: str) -> DataFrame:
    """recording, step and how often each status was written, over all runs."""
    return spark.read.schema(LEDGER).parquet(f"{folder}/_ledger").groupBy("recording", "step", "status").agg(F.count("*").alias("n"))
