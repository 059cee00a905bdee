"""Helpers that several corpus operators share: table access, shared scratch tables, Arrow word splitting."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..operators.joins import checkpoint_dir
from ..operators.joins import cut_lineage as cut

__all__ = ["WORD_PATTERN", "cut", "kept", "n_partitions", "new_path", "release", "sliced", "split_words", "strings", "table", "trimmed", "written"]

#: Any byte that is not white space: a word is a maximal run of these.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, reread: cuts the lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


Batches = Iterator[pa.RecordBatch]


def release() -> None:
    """Gives freed memory back: a Python worker outlives its task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    ctypes.CDLL(None).malloc_trim(0)


_kept: dict[str, object] = {}


def kept[T](name: str, make: Callable[[], T]) -> T:
    """What a worker keeps from task to task under a name. A task of trimmed() that names something else, or nothing, drops it."""
    if name not in _kept:
        _kept[name] = make()
    return _kept[name]


def trimmed(run: Callable[[Batches], Batches], keeps: str = "") -> Callable[[Batches], Batches]:
    """run, for mapInArrow: at its beginning the worker drops what tasks of other operators kept, behind it release()."""

    def whole(batches: Batches) -> Batches:
        for name in [x for x in _kept if x != keeps]:
            del _kept[name]
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def strings(column: pa.Array) -> pa.Array:
    """A null-free string array with 64-bit offsets; null becomes the empty text."""
    return pc.fill_null(column.cast(pa.large_string()), "")


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words of each text: codes into the distinct words, offsets of each text in the codes, distinct words."""
    trimmed = pc.ascii_trim_whitespace(strings(texts))
    lists = pc.ascii_split_whitespace(trimmed)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    words = lists.flatten().dictionary_encode()
    codes = words.indices.to_numpy(zero_copy_only=False)
    empty = pc.equal(trimmed, "").to_numpy(zero_copy_only=False)
    if empty.any():  # an empty text splits into one empty word
        keep = np.ones(len(codes), bool)
        keep[offsets[:-1][empty] - offsets[0]] = False
        counts = np.diff(offsets) - empty
        offsets = np.concatenate(([0], np.cumsum(counts)))
        codes = codes[keep]
    else:
        offsets = offsets - offsets[0]
    return codes, offsets, words.dictionary


def sliced(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about limit bytes of the column at most, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, start = np.cumsum(sizes), 0
    while start < len(batch):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        # a piece is a copy that begins at its own first byte: Arrow's lower-case kernels read past the text of a slice
        yield batch if stop - start == len(batch) else batch.take(pa.array(np.arange(start, stop)))
        start = stop
