"""Column helpers shared by the operators."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Words are maximal runs of other characters than these six.
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words(text: Column) -> Column:
    """Array of the words of a text; empty for a null text or one without a word."""
    trimmed = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(F.coalesce(F.length(trimmed), F.lit(0)) > 0, F.split(trimmed, SPACE)).otherwise(
        F.array().cast("array<string>"))


def hex16(value: Column) -> Column:
    """A long as 16 lowercase hex digits of its 64 bits."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def refuse(columns: list[str], own: list[str]) -> None:
    """ValueError if a column that is carried along has the name of a result column (case is ignored, as Spark does)."""
    low = {c.lower() for c in columns}
    if clash := [c for c in own if c.lower() in low]:
        raise ValueError(f"columns {clash} are result columns: rename the input's own first")


def tidy(run):
    """``run`` (an iterator function of Arrow batches), which at its end gives freed memory back: Python workers are kept
    between tasks and stages, and what one of them holds on to counts against its executor's memory."""
    def whole(batches):
        import ctypes

        import pyarrow as pa
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return whole


def free_name(taken: list[str], name: str) -> str:
    """``name``, with underscores until no column of ``taken`` has it (case is ignored, as Spark does)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = "_" + name
    return name
