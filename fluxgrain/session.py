"""Session defaults: adaptive execution, Arrow, UTC."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "500",  # traces come as arrays: a batch of long ones must fit a worker
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the library's defaults; conf overrides them (dots written as two underscores)."""
    builder = SparkSession.builder.appName("fluxgrain")
    if master:
        builder = builder.master(master)
    return builder.config(map=DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).getOrCreate()


#: For tables of very many columns. Otherwise a Parquet writer keeps a dictionary for each column, which costs 16 KB with its first value,
#: and each task generates and compiles code for each column, to use it on a few rows.
MANY_COLUMNS = {"parquet.enable.dictionary": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN"}


def beside(spark: SparkSession, conf: dict[str, str]) -> SparkSession:
    """A session of the same application with the settings of the given one, which stays as it is, and some more. What is read through
    it is also written with its settings."""
    own = spark.newSession()
    for k, v in {**spark.conf.getAll, **conf}.items():
        if own.conf.get(k, None) != v:
            own.conf.set(k, v)
    return own


_own: list[str] = []


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir, which driver and executors share. Without that setting a local session (as in tests)
    gets a temporary one that goes with the process; a cluster gets an error, since its machines would not see each other's files."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="fluxgrain-"))
            atexit.register(shutil.rmtree, _own[0], True)
        base = _own[0]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
