"""Sources: images, tensor files, raw floats, dictionaries, catalogs, a generator; and the sinks of results."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, InputPartition, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions.text import yaml_scalar
from ..operators.catalog import catalog_files


def read_images(spark: SparkSession, path: str, fail_fast: bool = True) -> DataFrame:
    """image_id (the file's place), width, height, pixels (interleaved B, G, R): alpha dropped, grey spread over the three.

    An image that can't be decoded is an error, or with fail_fast off a row without pixels.
    """
    rows = spark.read.format("image").option("dropInvalid", False).load(path).select("image.*")
    n = F.col("nChannels")
    hexed = F.hex("data")
    from_four = F.unhex(F.regexp_replace(hexed, "(.{6}).{2}", "$1"))
    from_one = F.unhex(F.regexp_replace(hexed, "(.{2})", "$1$1$1"))
    bad = F.raise_error(F.concat(F.lit("can't decode "), F.col("origin"))) if fail_fast else F.lit(None).cast("binary")
    pixels = F.when(n == 3, F.col("data")).when(n == 4, from_four).when(n == 1, from_one).otherwise(bad)
    return rows.select(F.col("origin").alias("image_id"), "width", "height", pixels.alias("pixels"))


def images_of(rows: DataFrame) -> DataFrame:
    """Images in memory (image_id, width, height, pixels), sizes checked."""
    ok = (F.col("width") > 0) & (F.col("height") > 0) & (F.length("pixels") == F.col("width") * F.col("height") * 3)
    return rows.withColumn("pixels", F.when(ok, F.col("pixels")).otherwise(F.raise_error(F.lit("an image's pixels don't fit its size"))))


def pixel(x: int, y: int, channel: int) -> F.Column:
    place = (F.lit(y) * F.col("width") + x) * 3 + channel + 1
    return F.conv(F.hex(F.substring("pixels", place, F.lit(1))), 16, 10).cast("int")


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """class_id (from 1) and token of a recognizer's dictionary: the list below `character_dict:` of a YAML file, or plain lines."""
    return parse_dictionary(spark.read.text(path, wholetext=True).select(F.col("value").alias("contents")))


def parse_dictionary(files: DataFrame) -> DataFrame:
    """The same from a column `contents`. A byte order mark before the first entry goes; no entry, or an empty one, is an error."""
    lines = F.split(F.regexp_replace("contents", r"\r?\n\z", ""), r"\r?\n")
    start = F.array_position(F.transform(lines, lambda x: F.trim(x)), "character_dict:").cast("int")
    head = F.get(lines, start - 1)
    indent = F.length(head) - F.length(F.ltrim(head))
    body = F.filter(F.slice(lines, start + 1, F.greatest(F.size(lines) - start, F.lit(0))), lambda x: F.trim(x) != "")
    ends = F.filter(F.sequence(F.lit(0), F.size(body)), lambda i: (i == F.size(body)) | (~F.ltrim(F.get(body, i)).startswith("- ") & (F.length(F.get(body, i)) - F.length(F.ltrim(F.get(body, i))) <= indent)))
    entries = F.transform(F.slice(body, F.lit(1), F.array_min(ends)), lambda x: F.when(F.ltrim(x).startswith("- "), yaml_scalar(F.substring(F.ltrim(x), F.lit(3), F.length(x)))).otherwise(F.raise_error(F.lit("expected a character list entry"))))
    tokens = F.when(start > 0, entries).otherwise(lines)
    tokens = F.transform(tokens, lambda x, i: F.when(i == 0, F.ltrim(x, F.lit("﻿"))).otherwise(x))
    ok = F.when(F.size(tokens) == 0, F.raise_error(F.lit("recognition dictionary is empty"))).when(F.exists(tokens, lambda x: x == ""), F.raise_error(F.lit("recognition dictionary contains an empty entry"))).otherwise(tokens)
    return files.select(F.posexplode(ok).alias("place", "token")).select((F.col("place") + 1).alias("class_id"), "token")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    return catalog_files(spark.read.option("multiLine", True).json(path))


def read_raw_floats(spark: SparkSession, path: str, expected: int) -> DataFrame:
    """path, i, value of files of little-endian 32-bit floats, each of expected numbers."""
    files = spark.read.format("binaryFile").load(path)
    content = F.when(F.col("length") == 4 * expected, F.col("content")).otherwise(F.raise_error(F.lit("a file doesn't hold the expected number of floats")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                values = np.frombuffer(batch.column("c")[k].as_buffer(), "<f4")
                for first in range(0, len(values), 1 << 18):  # a file's numbers go on in slices
                    some = values[first : first + (1 << 18)]
                    name = batch.column("path").take(pa.array(np.full(len(some), k)))
                    yield pa.RecordBatch.from_arrays([name, pa.array(np.arange(first, first + len(some))), pa.array(some)], names=["path", "i", "value"])

    return files.select("path", content.alias("c")).mapInArrow(run, "path string, i long, value float")


#: The generator's multiplier, increment and seed.
LCG_A, LCG_C, LCG_SEED = 1_664_525, 1_013_904_223, 0x243F6A88


def generated_inputs(spark: SparkSession, n: int) -> DataFrame:
    """i and value (-1 to 1) of the first n numbers of the linear congruential generator, each from its place alone.

    Step k is s * A**k + C * (A**k - 1) / (A - 1) modulo 2**32: products over the bits of k, so the range splits anywhere.
    """
    powers, a, c = [], LCG_A, LCG_C
    for _ in range(32):
        powers.append((a, c))
        a, c = a * a % 2**32, (a * c + c) % 2**32
    steps = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(a).cast("long").alias("a"), F.lit(c).cast("long").alias("c")) for k, (a, c) in enumerate(powers[: max(1, n.bit_length())])])

    def step(state: F.Column, x: F.Column) -> F.Column:
        # 32-bit factors: the product is taken in two halves, so that it stays within a long
        low, high = state.bitwiseAND(65535) * x["a"], F.pmod(F.shiftright(state, 16) * x["a"], F.lit(65536)) * 65536
        return F.when(F.get(F.col("bits"), x["k"]) == 1, F.pmod(low + high + x["c"], F.lit(2**32))).otherwise(state)

    bits = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.floor((F.col("id") + 1) / F.pow(F.lit(2.0), k)) % 2)
    state = F.aggregate(steps, F.lit(LCG_SEED).cast("long"), step)
    return spark.range(n).withColumn("bits", bits).select(F.col("id").alias("i"), (F.shiftright(state, 8) / F.lit(float(0xFFFFFF)) * 2 - 1).alias("value"))


class TensorFiles(DataSource):
    """spark.read.format("tensorfile").load(path): name, dtype, shape, data of the tensors in files with a JSON header.

    A file begins with the header's length (8 bytes, little-endian), the JSON header, then the data. One partition reads one
    tensor. Only 32-bit floats are accepted. Paths are those that executors see as files. With option("prefix", "backbone.conv1")
    only tensors of that name, or below it, are read; with option("pushdown", True), where the session has
    spark.sql.python.filterPushdown.enabled, filters on name (equal, or a prefix) do the same.
    """

    @classmethod
    def name(cls) -> str:
        return "tensorfile"

    def schema(self) -> str:
        return "path string, name string, dtype string, shape array<int>, data array<float>"

    def reader(self, schema: object) -> TensorReader:
        kind = FilteredTensorReader if self.options.get("pushdown", "false").lower() == "true" else TensorReader
        return kind(self.options["path"], self.options.get("prefix", ""))


class TensorPart(InputPartition):
    def __init__(self, path: str, name: str, entry: dict, begin: int):
        self.path, self.name, self.entry, self.begin = path, name, entry, begin


class TensorReader(DataSourceReader):
    def __init__(self, path: str, prefix: str = ""):
        self.path, self.prefix = path.removeprefix("file://").removeprefix("file:"), prefix

    def wanted(self, name: str) -> bool:
        return not self.prefix or name == self.prefix or name.startswith(self.prefix + ".")

    def partitions(self) -> list[InputPartition]:
        import glob
        import os

        found: list[InputPartition] = []
        for path in sorted(glob.glob(os.path.join(self.path, "*.safetensors")) if os.path.isdir(self.path) else glob.glob(self.path)):
            with open(path, "rb") as f:
                (size,) = struct.unpack("<Q", f.read(8))
                header = json.loads(f.read(size))
            found += [TensorPart(path, name, entry, 8 + size) for name, entry in header.items() if name != "__metadata__" and self.wanted(name)]
        return found

    def read(self, part: TensorPart) -> Iterator[tuple]:
        shape, (a, b) = part.entry["shape"], part.entry["data_offsets"]
        if part.entry["dtype"] != "F32":
            raise ValueError(f"tensor {part.name} has dtype {part.entry['dtype']}; only F32 is read")
        with open(part.path, "rb") as f:
            f.seek(part.begin + a)
            raw = f.read(b - a)
        if len(raw) != b - a or b - a != 4 * int(np.prod(shape)):
            raise ValueError(f"tensor {part.name} is cut off or doesn't fit its shape")
        yield part.path, part.name, part.entry["dtype"], [int(n) for n in shape], np.frombuffer(raw, "<f4").tolist()


class FilteredTensorReader(TensorReader):
    def __init__(self, path: str, prefix: str = ""):
        super().__init__(path, prefix)
        self.names: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo | StringStartsWith) and f.attribute == ("name",):
                self.names.append(f)
            else:
                yield f

    def wanted(self, name: str) -> bool:
        return super().wanted(name) and all(name == f.value if isinstance(f, EqualTo) else name.startswith(f.value) for f in self.names)


class FloatFiles(DataSource):
    """df.write.format("floatfile").save(path): a column `value` as files of little-endian 32-bit floats, one for each
    partition that has rows, in the partition's order. Paths are those that executors see as files."""

    @classmethod
    def name(cls) -> str:
        return "floatfile"

    def schema(self) -> str:
        return "value float"

    def writer(self, schema: StructType, overwrite: bool) -> FloatWriter:
        if "value" not in schema.names:
            raise ValueError("floats are written from a column named value")
        return FloatWriter(self.options["path"])


class FloatsWritten(WriterCommitMessage):
    def __init__(self, written: str | None, wanted: str | None):
        self.written, self.wanted = written, wanted


class FloatWriter(DataSourceWriter):
    """A task writes under a name of its own attempt; the commit gives files their names, so a lost task leaves none behind."""

    def __init__(self, path: str):
        self.path = path.removeprefix("file://").removeprefix("file:")

    def write(self, rows: Iterator) -> FloatsWritten:
        import os

        from pyspark import TaskContext

        context = TaskContext.get()
        os.makedirs(self.path, exist_ok=True)
        own = os.path.join(self.path, f".attempt-{context.partitionId()}-{context.taskAttemptId()}")
        n = 0
        with open(own, "wb") as f:
            while block := [r["value"] for _, r in zip(range(1 << 16), rows, strict=False)]:
                n += len(block)
                f.write(np.array(block, "<f4").tobytes())
        return FloatsWritten(own, os.path.join(self.path, f"part-{context.partitionId():05d}.f32") if n else None)

    def commit(self, messages: list[FloatsWritten | None]) -> None:
        import os

        for m in messages:
            if m is not None:
                os.replace(m.written, m.wanted) if m.wanted else os.remove(m.written)

    def abort(self, messages: list[FloatsWritten | None]) -> None:
        import os

        for m in messages:
            if m is not None:
                os.remove(m.written)


def write_results(results: DataFrame, path: str, how: str = "json") -> None:
    """Results as JSON rows, or as text: the lines' texts, one below the other."""
    from ..functions.text import result_text

    if how == "json":
        results.write.json(path)
    elif how == "text":
        results.select(result_text(F.col("lines")).alias("value")).write.text(path)
    else:
        raise ValueError(f"unknown format {how!r}")


def as_json(results: DataFrame, pretty: bool = True) -> DataFrame:
    return results.select("image_id", F.to_json(F.struct(*[c for c in results.columns if c != "image_id"]), {"pretty": "true"} if pretty else {}).alias("json"))
