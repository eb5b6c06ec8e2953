"""What the text operators share: the shared folder, hashing and small helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_own: dict[str, str] = {}
_caches: dict[str, dict] = {}
#: Rows in an Arrow batch at most: texts are long, and batches are held by the JVM and by Python.
BATCH_ROWS = 1000


def cache(owner: str) -> dict:
    """What a Python worker keeps between tasks for one operator."""
    return _caches.setdefault(owner, {})


def only(owner: str) -> dict:
    """The owner's cache; a worker that comes to another operator drops what earlier ones kept, so that its memory
    is that of one operator and not of all."""
    for name, kept in _caches.items():
        if name != owner:
            kept.clear()
    return cache(owner)


def small_batches(df: DataFrame) -> DataFrame:
    """df, whose session sends at most so many rows to Python at a time from now on."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, from ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own (removed at exit);
    on a cluster a missing setting is an error, as a machine-local folder would lose data.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="weftgraph-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _own[app] = f"file://{path}"
    return _own[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing used before."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: its lineage is cut there."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket(col: str | Column, mod: int) -> Column:
    """crc32 of the id as text, modulo mod (null ids: crc32 of the empty string, 0)."""
    col = F.col(col) if isinstance(col, str) else col
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % mod


def quoted(name: str) -> Column:
    """The column of just that name, whatever signs it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def unused(taken: DataFrame | list[str], *names: str) -> list[str]:
    """The names, with blanks of "_" before those that are taken (in any case)."""
    have = {c.lower() for c in (taken.columns if isinstance(taken, DataFrame) else taken)}
    out = []
    for name in names:
        while name.lower() in have:
            name = "_" + name
        have.add(name.lower())
        out.append(name)
    return out


def by_place(docs: DataFrame, make: Callable[[int], Callable], *more: T.StructField) -> DataFrame:
    """docs through mapInArrow, with more columns behind its own, whatever signs their names hold. make gets the
    place of the text among the columns and gives the function, which yields columns in that order."""
    place = [c.lower() for c in docs.columns].index("text")
    fields = [T.StructField(f"c{n}", f.dataType, f.nullable) for n, f in enumerate([*docs.schema.fields, *more])]
    plain = small_batches(docs).toDF(*(f.name for f in fields[: len(docs.columns)]))
    return plain.mapInArrow(make(place), T.StructType(fields)).toDF(*docs.columns, *(f.name for f in more))


@contextmanager
def one_thread():
    """numpy's products in one thread: many small ones lose far more by waiting for each other's threads than they
    gain. Where the library's switch isn't found, nothing changes."""
    import ctypes
    import glob

    import numpy

    places = glob.glob(f"{numpy.__path__[0]}/../numpy.libs/*openblas*")
    switch = next(((x, n) for p in places for x in [ctypes.CDLL(p)] for n in ("scipy_openblas_{}_num_threads64_", "openblas_{}_num_threads64_", "openblas_{}_num_threads") if hasattr(x, n.format("set"))), None)
    if switch is None:
        yield
        return
    library, name = switch
    before = getattr(library, name.format("get"))()
    getattr(library, name.format("set"))(1)
    try:
        yield
    finally:
        getattr(library, name.format("set"))(before)


def open_uri(uri: str):
    """(file system, path) of pyarrow for a URI of the shared folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")
