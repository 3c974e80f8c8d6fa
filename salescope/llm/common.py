"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from salescope.session import materialise, ship


Batches = Iterator[pa.RecordBatch]

_CLEARS: list[Callable[[], None]] = []  # of the tables that operators keep in a Python worker
_LAST = [""]  # the module whose task a Python worker ran last


def kept_by_worker(build: Callable) -> Callable:
    """Remember what ``build`` makes for the tasks of a Python worker, until a task of another module starts in it."""
    kept = functools.lru_cache(maxsize=2)(build)
    _CLEARS.append(kept.cache_clear)
    return kept


def give_back() -> None:
    """Return freed memory to the system; a worker that waits for its next task else holds on to it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def run_task(function: Callable[[Batches], Batches], batches: Batches) -> Batches:
    """``function`` in a Python worker, without the tables of other operators and without memory left at its end.

    Spark keeps workers for later tasks, also those of other queries, and counts them to the executor.
    """
    if _LAST[0] != function.__module__:
        _LAST[0] = function.__module__
        for clear in _CLEARS:
            clear()
        gc.collect()
        give_back()
    try:
        yield from function(batches)
    finally:
        give_back()


def map_batches(df: DataFrame, function: Callable[[Batches], Batches], schema) -> DataFrame:
    """``mapInArrow`` with the package sent along."""
    ship(df.sparkSession)

    def run(batches: Batches) -> Batches:
        yield from run_task(function, batches)

    return df.mapInArrow(run, schema)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write once to the shared folder and read back; later steps restart from there when an executor is lost."""
    return materialise(df, label)


def release(spark: SparkSession) -> None:
    """Have the shuffle files of frames that nothing refers to any more dropped.

    Spark drops them only when the driver's memory is collected, which by itself may come long after a step.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def dropping_shuffles(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator on ``docs`` whose steps each have their shuffle files removed as soon as they have been stored.

    Spark does so by a setting of the session, which is as before once the operator returns. Without it the
    shuffles of all steps add up until the driver's memory happens to be collected.
    """
    @functools.wraps(operator)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        conf = docs.sparkSession.conf
        before = conf.get(_CLEANUP, None)
        conf.set(_CLEANUP, "true")
        try:
            return operator(docs, *args, **kwargs)
        finally:
            conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)

    return run


def unused(df: DataFrame, *names: str) -> str | list[str]:
    """Names for helper columns that no column of ``df`` has in any case of letters."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found[0] if len(found) == 1 else found


def as_bytes(df: DataFrame, *columns: str) -> DataFrame:
    """Cast text columns to UTF-8 bytes, which Python reads without decoding."""
    return df.withColumns({c: F.col(c).cast("binary") for c in columns})


def without(schema: StructType, *names: str) -> StructType:
    return StructType([f for f in schema.fields if f.name not in names])


def record_batch(schema: pa.Schema, columns: dict[str, list | pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v, type=schema.field(k).type) for k, v in columns.items()],
        schema=schema,
    )
