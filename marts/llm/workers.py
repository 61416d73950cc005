"""Makes this package importable in Python workers, and bounds the batches they get and the memory they keep."""

from __future__ import annotations

import ctypes
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from pathlib import Path

import pyarrow as pa
from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parents[1]
_shipped: set[str] = set()

#: Bytes of rows that Spark sends to a Python worker at once.
BATCH_BYTES = 4 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"

Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once per application.

    The driver serves the archive to the executors, as ``--py-files`` does.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    archive = Path(tempfile.mkdtemp(prefix="marts-py-")) / f"{_PACKAGE.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(_PACKAGE.rglob("*.py")):
            out.write(path, path.relative_to(_PACKAGE.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Batches of ``BATCH_BYTES`` in the jobs that run inside: a batch of wide rows is held
    outside the heap by the executor, several times over, and by the Python worker.
    """
    before = spark.conf.get(_BATCH_CONF, None)
    spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_BATCH_CONF)
        else:
            spark.conf.set(_BATCH_CONF, before)


def bound_batches(spark: SparkSession) -> None:
    """Batches of ``BATCH_BYTES`` in this session from now on, unless it has a bound of its own.

    For steps that return a plan which the caller runs: ``small_batches`` has ended by then.
    """
    if spark.conf.get(_BATCH_CONF, None) is None:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))


def give_back() -> None:
    """Return to the system what this process has freed; Arrow and the C library keep it otherwise."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def lean(task: Task) -> Task:
    """The task, keeping no freed memory between batches: workers live on and add to the next stage's need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in task(batches):
            yield batch
            del batch
            give_back()
        give_back()

    return run
