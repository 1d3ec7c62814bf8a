"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import pickle
import re
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: A space before a character that no Unicode table calls white space always starts a pre-token of
#: the byte-level pattern, and what stands before it is split alike whether or not the text goes on.
_CUT = re.compile(r" (?=\S)")


#: Where tables written by :func:`materialise` lie.
_PLACES: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster for cut lineage; one of our own only where none is set and all runs on one machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spanloom-checkpoint-"))
    return sc.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder once and read it back.

    This cuts the lineage, computes each row exactly once, and survives the loss of executors,
    since the table is in shared storage. The files go with :func:`discard`, or when the application
    ends.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    written = spark.read.schema(df.schema).parquet(path)
    _PLACES[written] = place
    return written


def discard(*tables: DataFrame | None) -> None:
    """Delete materialised tables that nothing reads any more; others are let be."""
    for table in tables:
        if table is not None and (place := _PLACES.pop(table, None)) is not None:
            place.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """Whether a document is in the fold that no model may learn from; a null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def spaced_chunks(text: str) -> list[str]:
    """Cut at each single space before a visible character; every chunk but the first lost one."""
    return _CUT.split(text)


class RecentCache(dict):
    """Values of ``compute`` by key, in bounded memory: a full memo becomes the old half, and what is used again comes back.

    ``limit`` is in bytes, as estimated from the keys' lengths, of each half. Keys longer than
    ``longest`` characters, which hardly come again, are computed each time.
    """

    def __init__(self, compute: Callable[[str], Any], limit: int = 24 << 20, longest: int = 64):
        super().__init__()
        self.compute, self.limit, self.longest, self.old, self.held = compute, limit, longest, {}, 0

    def __missing__(self, key: str) -> Any:
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) <= self.longest:
            self[key] = value
            self.held += 240 + 4 * len(key)
        return value

    def room(self) -> None:
        """To be called between uses."""
        if self.held > self.limit:
            self.old, self.held = dict(self), 0
            self.clear()


_RESIDENT: dict[Any, Any] = {}


def resident(key: Any, build: Callable[[], Any]) -> Any:
    """The object named ``key`` in this process, built once.

    Workers live on from task to task and from one operator to the next; another key takes the
    place of the last one, so that a worker holds one model and its memo.
    """
    if key not in _RESIDENT:
        _RESIDENT.clear()
        hand_back_memory()
        _RESIDENT[key] = build()
    return _RESIDENT[key]


def small_batches(found: Iterator[pa.RecordBatch], rows: int = 500, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows and, but for single rows, of at most ``most_bytes``."""
    for batch in found:
        at = 0
        while at < batch.num_rows:
            step = min(rows, batch.num_rows - at)
            while step > 1 and batch.slice(at, step).nbytes > most_bytes:
                step = (step + 1) // 2
            yield batch.slice(at, step)
            at += step


def map_columns(df: DataFrame, function: Callable[[dict[str, list]], dict[str, Any]], schema: str, rows: int = 500) -> DataFrame:
    """Map ``function`` over the columns, as Python lists, of ``rows`` rows, or some MB, at a time.

    Arrow carries integers with nulls unchanged, unlike pandas, and small steps bound the memory
    that long texts take as Python objects. There is no shuffle.
    """

    arrow = pickle.dumps(to_arrow_schema(StructType.fromDDL(schema)))

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = pickle.loads(arrow)
        for part in small_batches(found, rows):
            out = function({name: part.column(name).to_pylist() for name in part.schema.names})
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in target], schema=target)
        release_memory()

    return df.mapInArrow(batches, schema)


def release_memory() -> None:
    """Return what the allocators hold but nothing uses to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def hand_back_memory() -> None:
    """The same after freeing what only cycles hold, for the end of a training run."""
    gc.collect()
    release_memory()


def sample_fraction(total: int, bound: int) -> float:
    """Share of ``total`` rows to take so that about ``bound`` of them are kept."""
    return 1.0 if total <= bound else bound / total


def hash_sample(df: DataFrame, key: Column, fraction: float, seed: int = 17) -> DataFrame:
    """Rows whose hashed key falls below the fraction: the same rows at every run and partitioning."""
    if fraction >= 1.0:
        return df
    buckets = 1 << 30
    return df.filter(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(buckets)) < int(fraction * buckets))
