"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlespan.session import scratch_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(col: Column) -> Column:
    """A-Z to lower case, every other character as it is."""
    return F.translate(col, UPPER, UPPER.lower())


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of `df`, written once to the shared folder and read back: later readers do not recompute them, and
    a lost executor loses none of them."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def subset(table: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; extra columns of the input, whatever their names, never meet the operator's own."""
    return table.select(*[F.col(f"`{n}`") for n in names])


def spare_name(wanted: str, *tables: DataFrame) -> str:
    """`wanted`, with underscores before it until none of the tables has a column of that name, in any case of letters."""
    taken = {c.lower() for t in tables for c in t.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def drawn(df: DataFrame, n_rows: int, bound: int, *names: str) -> DataFrame:
    """About `bound` of the `n_rows` rows, or all if there are fewer: those whose columns' hash is small enough.

    Unlike the first rows of an order, this needs no rows of each partition at the driver. Equal rows are drawn together.
    """
    whole = 1 << 40
    return df.filter(F.pmod(F.xxhash64(*names), F.lit(whole)) < min(whole, whole * bound // max(n_rows, 1)))


def release() -> None:
    """Hands free memory of a Python worker back to the system: a worker kept for later tasks must not hold its peak."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library only
    if trim:
        trim(0)


_KEPT: dict = {}


def kept_in_worker(owner: str, make=object):
    """The one object a Python worker keeps between tasks. Asking for another operator's drops it, so that the caches of a
    pipeline's stages never add up in one worker."""
    if owner not in _KEPT:
        _KEPT.clear()
        release()
        _KEPT[owner] = make()
    return _KEPT[owner]
