"""Helpers shared by the corpus operators: table access, lineage cuts, sums of arrays."""

from __future__ import annotations

import atexit
import io
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch sent to Python; whole texts travel in them, so both are kept small.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20
#: A side of a join is broadcast only when it has at most so many rows, of at most so many bytes (both counted first).
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 24 << 20


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once, for clusters that do not have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_veristrata_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    with zipfile.ZipFile(data := io.BytesIO(), "w") as archive:
        for path in sorted(package.rglob("*.py")):
            archive.write(path, path.relative_to(package.parent))
    folder = Path(tempfile.mkdtemp(prefix="veristrata-code-"))
    (folder / "veristrata.zip").write_bytes(data.getvalue())
    sc.addPyFile(str(folder / "veristrata.zip"))
    sc._veristrata_shipped = True


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of Python workers: few whole texts per Arrow batch. Lower limits of the session stay as they are."""
    for key, limit in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = str(spark.conf.get(f"spark.sql.execution.arrow.{key}")).lower().removesuffix("b")
        if not (now.isdigit() and 0 < int(now) <= limit):
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(limit))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset, as in tests on one machine, a temporary folder is taken.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="veristrata-")
        sc.setCheckpointDir(path)
        path = "file://" + path
    return path


_written: list[tuple[SparkSession, str]] = []


def mark() -> int:
    """The number of tables written so far; ``tidy(spark, mark)`` removes those written since."""
    return len(_written)


def tidy(spark: SparkSession, since: int, keep: tuple[DataFrame, ...] = ()) -> None:
    """Remove the tables that ``cut`` wrote since ``mark``, but for those that ``keep`` still reads."""
    wanted = {f.rsplit("/", 1)[0].rsplit(":", 1)[-1].lstrip("/") for df in keep for f in df.inputFiles()}
    for entry in _written[since:]:
        if entry[1].rsplit(":", 1)[-1].lstrip("/") not in wanted:
            drop_table(spark, entry[1])
            _written.remove(entry)


def _remove_written() -> None:
    for spark, path in _written:
        try:
            drop_table(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone at exit
            return


atexit.register(_remove_written)


def drop_table(spark: SparkSession, path: str) -> None:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def cut(df: DataFrame) -> DataFrame:
    """Write a result to the shared folder and read it back, so that its lineage ends there.

    A lost executor then costs no recomputation of what came before. The table is
    removed when the driver exits, or earlier by ``tidy``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/veristrata-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def maybe_broadcast(df: DataFrame) -> DataFrame:
    """Hint a broadcast only if counts of rows and of their bytes (written as JSON) show that the side is small; else leave it to a shuffle join."""
    return F.broadcast(df) if is_small(df) else df


def is_small(df: DataFrame) -> bool:
    seen = df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.length(F.to_json(F.struct("*"))).cast("bigint")), F.lit(0)).alias("size")).first()
    return seen["rows"] <= BROADCAST_ROWS and seen["size"] <= BROADCAST_BYTES


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names made from ``names`` that ``df`` does not have, whatever the letter case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        n = 0
        while (new := f"{name}_{n}").lower() in taken:
            n += 1
        taken.add(new.lower())
        out.append(new)
    return out


def content_key(*columns: Column) -> Column:
    """128 bits of hash as a struct: rows with equal values have equal keys; null differs from the empty text."""
    marked = [x for c in columns for x in (c.isNull(), c)]
    return F.struct(F.xxhash64(*marked).alias("a"), F.xxhash64(F.lit(7), *marked).alias("b"))


def sum_arrays(df: DataFrame, partial: Callable[[Iterable[pa.RecordBatch]], np.ndarray], size: int, fan_in: int = 16) -> np.ndarray:
    """Sum, over all partitions, the float64 vector of ``size`` that ``partial`` makes of each.

    Partial sums meet in at most ``fan_in`` tasks first and then in one, so the driver gets one
    vector, whatever the size of the input.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector = np.ascontiguousarray(partial(batches), dtype="<f8")
        assert vector.size == size
        if vector.any():
            yield pa.RecordBatch.from_arrays([pa.array([vector.tobytes()], pa.binary())], names=["v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros(size), False
        for batch in batches:
            for value in batch.column(0):
                total += np.frombuffer(value.as_buffer(), "<f8")
                some = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

    row = df.mapInArrow(first, "v binary").repartition(fan_in).mapInArrow(add, "v binary").coalesce(1).mapInArrow(add, "v binary").first()
    return np.frombuffer(bytes(row["v"]), "<f8").copy() if row else np.zeros(size)


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of an Arrow text column; null counts as the empty text."""
    return [x or "" for x in column.to_pylist()]
