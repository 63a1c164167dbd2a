"""Shared helpers: table reading, bounded intermediate tables, worker-side caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.storage import cut, drop_stored, shared_dir, stored, stored_count  # noqa: F401 - for the modules of this package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(taken, *names: str) -> list[str]:
    """Names for work columns that none of the ``taken`` columns has, in whatever case."""
    used = {c.lower() for c in taken}
    out = []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


class BoundedCache(dict):
    """A dict that computes missing values. It holds ``limit`` entries, and as many of the generation before."""

    def __init__(self, compute, limit: int = 250_000):
        super().__init__()
        self.compute, self.limit, self.before = compute, limit, {}

    def __missing__(self, key):
        value = self.before.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) <= 256:  # a bound on entries bounds memory only if keys are short
            if len(self) >= self.limit:
                self.before = dict(self)
                self.clear()
            self[key] = value
        return value


_PER_WORKER: dict = {}


def per_worker(key, build):
    """An object built once in each Python worker and reused by its later tasks."""
    if key not in _PER_WORKER:
        _PER_WORKER[key] = build()
    return _PER_WORKER[key]


def release_memory() -> None:
    """Give a worker's free memory back to the system: what earlier tasks of other stages took, which its allocators keep."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass
