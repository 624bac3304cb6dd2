"""Session building and the folder every executor can reach."""

from __future__ import annotations

import atexit
import pathlib
import tempfile
import uuid
import zipfile
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_settled: list[tuple[SparkSession, str]] = []


def build_session(master: str = "local[8]", app: str = "billscope", **conf: str) -> SparkSession:
    """Session with the settings the operators are written for (UTC, AQE, skew joins)."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; only a local session without one gets its own."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="billscope-")
    context.setCheckpointDir(folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new sub-folder name under the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/billscope/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Write down a result that later steps read several times, and go on from the table.

    The rows land in the shared folder, so they outlive a lost executor and cut the lineage.
    """
    path = fresh_path(df.sparkSession, "settled")
    df.write.parquet(path)
    _settled.append((df.sparkSession, path))
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._settled_at = path
    return table


def release(table: DataFrame) -> None:
    """Remove a settled table that nothing reads any more."""
    for spark, path in [x for x in _settled if x[1] == getattr(table, "_settled_at", None)]:
        _settled.remove((spark, path))
        _remove(spark, path)


def clear_settled() -> None:
    """Remove the tables settled so far; results that still read them must be written first.

    It also runs when the driver's Python ends.
    """
    while _settled:
        spark, path = _settled.pop()
        _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:  # the session has ended
        return
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


atexit.register(clear_settled)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Workers then import it wherever they run and whatever folder the driver was started in.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = pathlib.Path(__file__).resolve().parent
    archive = pathlib.Path(tempfile.mkdtemp(prefix="billscope-")) / "billscope.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def summed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The binary column ``s``, doubles of one length per key, added up for each value of the integer ``keys``.

    A task holds one array per key and takes the rows as they come. Dozens of sums in one aggregate of
    Spark make methods that the JVM does not compile.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, ...], np.ndarray] = {}
        for batch in batches:
            for *key, s in zip(*(batch.column(c).to_pylist() for c in range(batch.num_columns)), strict=True):
                if (at := tuple(key)) in totals:
                    totals[at] += np.frombuffer(s)
                else:
                    totals[at] = np.frombuffer(s).copy()
        if totals:
            columns = [pa.array(c, kind) for c, kind in zip(zip(*totals), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([t.tobytes() for t in totals.values()], pa.binary())], names=[*keys, "s"])

    kinds = [pa.int32() if df.schema[k].dataType.typeName() == "integer" else pa.int64() for k in keys]
    ship(df.sparkSession)
    dealt = df.select(*keys, "s").repartition(*keys)
    return dealt.mapInArrow(work, dealt.schema)
