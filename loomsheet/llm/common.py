"""What the training-data operators share: tables, the shared folder, checked sizes and hot keys."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from contextlib import contextmanager
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch. Texts of 100 kB and more occur, so a batch is kept small.
BATCH_ROWS = 128
#: Bytes in one Arrow batch.
BATCH_BYTES = 2 << 20
#: Bytes in one batch that Spark sends to a worker, about.
SENT_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces(batch: pa.RecordBatch, rows: int = BATCH_ROWS, most: int = BATCH_BYTES):
    """The batch in parts of ``rows`` rows and ``most`` bytes at most; a row of more is a part of its own."""
    at = 0
    while at < batch.num_rows:
        n = min(rows, batch.num_rows - at)
        while n > 1 and batch.slice(at, n).nbytes > most:
            n //= 2
        yield batch.slice(at, n)
        at += n


def sent_small(df: DataFrame, most: int = SENT_BYTES) -> DataFrame:
    """``df``, of whose rows Spark sends Python some ``most`` bytes at once; a row of more is sent alone.

    Otherwise it sends 10,000 rows or 64 MB, for most tasks all they read, and
    holds them several times over, outside the executor's heap and in the worker.
    The setting is made in a copy of the session, so the caller's own stays as it is.
    """
    copy = df._jdf.sparkSession().cloneSession()
    copy.conf().set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))
    plan = df._jdf.queryExecution().analyzed()
    return DataFrame(df.sparkSession._jvm.org.apache.spark.sql.classic.Dataset.ofRows(copy, plan), df.sparkSession)


def give_back() -> None:
    """Return to the system what Arrow and, under glibc, malloc hold free."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def in_batches(df: DataFrame, run, schema: str, rows: int = BATCH_ROWS, most: int = BATCH_BYTES) -> DataFrame:
    """``df.mapInArrow`` with ``run`` over small batches, which bounds what a worker makes of one.

    At its end a worker, which serves many tasks, gives back what is free.
    """

    def inner(batches):
        yield from run(p for b in batches for p in pieces(b, rows, most))
        give_back()

    return sent_small(df).mapInArrow(inner, schema)


@cache
def _temporary() -> str:
    folder = tempfile.mkdtemp(prefix="loomsheet-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def kept(names: tuple[str, ...], made: tuple[str, ...]) -> list:
    """Columns to pass on beside those that an operator makes: one whose name is taken gets a leading underscore, or as many as it needs."""
    out, used = [], {n.lower() for n in made}
    for name in names:
        new = name
        while new.lower() in used:
            new = f"_{new}"
        used.add(new.lower())
        out.append(F.col(f"`{name}`").alias(new))
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Where that is unset, a temporary one serves a local master; a cluster must name its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = _temporary()
    return found.rstrip("/")


_made: list[tuple[SparkSession, str]] = []


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path that ``stored`` or ``made_folder`` made."""
    jvm = spark.sparkContext._jvm
    if jvm is not None:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _made[:] = [m for m in _made if m[1] != path]


@atexit.register
def _sweep() -> None:
    for spark, path in list(_made):
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001 - the session has ended; nothing is left to ask
            return


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder and read again, which cuts its lineage; and its path.

    The files outlive any executor. They go when the process ends, or with ``remove``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomsheet-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path), path


@contextmanager
def scratch(spark: SparkSession):
    """A function like ``stored`` for tables that are of no use after the block: they are deleted then."""
    paths: list[str] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        out, path = stored(df, name)
        paths.append(path)
        return out

    try:
        yield keep
    finally:
        for path in paths:
            remove(spark, path)


def made_folder(spark: SparkSession, name: str) -> str:
    """A new, empty folder for files in the shared folder; it goes when the process ends."""
    path = f"{shared_dir(spark)}/loomsheet-{name}-{uuid.uuid4().hex}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(p)
    _made.append((spark, path))
    return path


#: Rows of one key from which a lookup splits it, and rows in each part, at least.
HOT_ROWS = 20_000
#: The most frequent keys that a lookup may salt.
HOT_KEYS = 1000


def hot_lookup(left: DataFrame, right: DataFrame, key: str, salt_by: str, how: str = "inner", hot_rows: int = HOT_ROWS, counts: DataFrame | None = None) -> DataFrame:
    """``left`` joined to ``right``, which has few rows per key, on the column ``key``.

    Keys with over ``hot_rows`` rows on the left, the ``HOT_KEYS`` most frequent
    of them, are salted by a hash of ``salt_by``: their left rows are spread over
    parts of about that size and their right rows are repeated for each part.
    Any other key has under a thousandth of all rows, as a thousand keys have
    no fewer each; so no task gets more than that, and what is broadcast is
    bounded. ``left`` is read twice unless ``counts`` has the rows of each key
    (key, count), so it should be cheap to make.
    """
    counts = left.where(F.col(key).isNotNull()).groupBy(key).count() if counts is None else counts
    frequent = counts.where(F.col("count") > hot_rows)
    found = frequent.orderBy(F.desc("count"), key).limit(HOT_KEYS).collect()
    if not found:
        return left.join(right, key, how)
    spark, kind = left.sparkSession, left.schema[key].dataType.simpleString()
    rows = [F.struct(F.lit(r[key]).cast(kind).alias(key), F.lit(-(-r["count"] // hot_rows)).alias("_parts")) for r in found]
    parts = spark.range(1).select(F.inline(F.array(*rows)))
    spread = right.join(F.broadcast(parts), key, "left")
    spread = spread.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    rows = left.join(F.broadcast(parts), key, "left")
    rows = rows.withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(salt_by), F.col("_parts")).cast("int"), F.lit(0))).drop("_parts")
    return rows.join(spread, [key, "_salt"], how).drop("_salt")
