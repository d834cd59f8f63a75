"""Spark session settings shared by the tests, the bench and the command line."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from itertools import islice

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", app: str = "tidelog", memory: str = "8g", shuffle: int = 8) -> SparkSession:
    """A local session for tests and benches; on a cluster the caller brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. In local mode a temporary one where it is unset, deleted at exit; a cluster must name one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        folder = tempfile.mkdtemp(prefix=f"tidelog-{os.getpid()}-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        at = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: the lineage ends there, and a lost
    executor costs no recomputation of what stands before. It stays until drop or the end of a scratch."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    _scratches[-1].append(path) if _scratches else None
    return out


def settle_rows(spark: SparkSession, found: Iterable[tuple], ddl: str, name: str, n: int = 50_000) -> DataFrame:
    """The driver's rows as a table in the shared folder, n of them a file, so that no more than that are held at once; it stays as one of settle's does."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    from tidelog.sources.blobs import Blobs

    schema, rest, k = to_arrow_schema(StructType.fromDDL(ddl)), iter(found), 0
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    blobs = Blobs(spark, path)
    while (some := list(islice(rest, n))) or not k:
        columns, out = zip(*some, strict=True) if some else [()] * len(schema), pa.BufferOutputStream()
        pq.write_table(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema), out, compression="zstd")
        blobs.put(f"{k:08}.parquet", out.getvalue().to_pybytes(), durable=False)
        k += 1
    out = spark.read.schema(ddl).parquet(path)
    out.settled_at = path
    _scratches[-1].append(path) if _scratches else None
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop(*tables: DataFrame) -> None:
    """Delete settled tables that nothing reads any more; other DataFrames are left alone."""
    for df in tables:
        if path := getattr(df, "settled_at", None):
            _delete(df.sparkSession, path)


_scratches: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables settled inside are deleted at the end: write what you want to keep before it."""
    _scratches.append([])
    try:
        yield
    finally:
        for path in _scratches.pop():
            _delete(spark, path)
