"""Recognition: batches of boxes by aspect ratio, greedy CTC decoding, joined texts, assembled results."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ..functions import geometry as geo
from ..functions import tensor as t
from ..functions import text as txt

MIN_PROBABILITY = 1e-8


def recognition_batches(detections: DataFrame, size: int = geo.RECOGNITION_BATCH) -> DataFrame:
    """detections (image_id, det_idx, polygon) with aspect, content_width, batch (from 0) and batch_width.

    Boxes of an image in the order of aspect ratio and det_idx fall into batches of size; a batch is as wide as its widest.
    """
    sized = detections.withColumn("aspect", geo.aspect_ratio(F.col("polygon"))).withColumn("content_width", geo.content_width(F.col("polygon")))
    place = F.row_number().over(Window.partitionBy("image_id").orderBy("aspect", "det_idx"))
    batched = sized.withColumn("batch", F.floor((place - 1) / size))
    return batched.withColumn("batch_width", geo.batch_width(F.max("content_width").over(Window.partitionBy("image_id", "batch"))))


def valid_steps(content_width: Column, input_width: Column, steps: int) -> Column:
    """Time steps that the content fills: padding behind it isn't read."""
    return F.least(F.greatest(F.floor((content_width * steps + input_width - 1) / input_width), F.lit(1)), F.lit(steps)).cast("int")


def winning_probability(row: Column, value: Column, logits: bool = False) -> Column:
    """The value itself where the row already is a distribution, else what softmax makes of it. Rows known to be logits go
    through softmax even where they look like a distribution."""
    softmax = 1 / t.total(F.transform(row, lambda x: F.exp(x - value)))
    if logits:
        return softmax
    spread = (F.array_min(row) >= 0) & (F.abs(t.total(row) - 1) <= 0.01)
    return F.when(spread, value).otherwise(softmax)


def decode_ctc(values: Column, steps: int, classes: int, dictionary: list[str], content_width: Column | None = None, input_width: Column | None = None, logits: bool = False) -> Column:
    """Struct (text, score) of one item's values, steps rows of classes numbers: logits, or (unless logits is set) for each
    row what it looks like.

    Class 0 is blank; with two classes more than the dictionary the last is a space. A class is emitted where it isn't blank
    and not the step before's; the score is the geometric mean of the emitted steps' probabilities, 0 without any. Narrow:
    the steps stay in their row.
    """
    if classes not in (len(dictionary) + 1, len(dictionary) + 2):
        raise ValueError("classes and dictionary don't fit each other")
    tokens = F.array(*[F.lit(x) for x in dictionary + [" "] * (classes - 1 - len(dictionary))])
    valid = F.lit(steps) if content_width is None else valid_steps(content_width, input_width, steps)
    rows = F.transform(F.sequence(F.lit(0), valid - 1), lambda k: F.slice(values, k * classes + 1, F.lit(classes)))
    best = F.transform(rows, lambda r: F.struct(t.argmax_last(r).alias("c"), winning_probability(r, F.array_max(r), logits).alias("p")))

    def finished(steps_: Column) -> Column:
        # the class before each step, blank before the first
        emitted = F.filter(steps_, lambda x, i: (x["c"] != 0) & (x["c"] != F.when(i == 0, 0).otherwise(F.get(steps_, i - 1)["c"])))
        return t.let(emitted, summary)

    def summary(emitted: Column) -> Column:
        text = F.array_join(F.transform(emitted, lambda x: F.get(tokens, x["c"] - 1)), "")
        logs = F.transform(emitted, lambda x: F.ln(F.greatest(x["p"], F.lit(MIN_PROBABILITY))))
        return F.struct(text.alias("text"), F.when(F.size(emitted) > 0, F.exp(t.mean(logs))).otherwise(0.0).alias("score"))

    return t.let(best, finished)


def collapse_steps(steps: DataFrame, item: str = "item", step: str = "t", cls: str = "cls", value: str = "v") -> DataFrame:
    """The same decisions over a long table (item, step, class, value): rows item, step, class of what is emitted."""
    best = steps.groupBy(item, step).agg(F.max(F.struct(F.col(value), F.col(cls))).alias("m")).select(item, step, F.col(f"m.{cls}").alias(cls))
    before = F.lag(cls, 1, 0).over(Window.partitionBy(item).orderBy(step))
    return best.withColumn("before", before).where((F.col(cls) != 0) & (F.col(cls) != F.col("before"))).drop("before")


def join_decoded(parts: DataFrame, group: str, order: str) -> DataFrame:
    """group, text, score: the parts (text, score) of a group in order, overlaps joined.

    Sorted parts of a group come to a task one behind the other, and only the group at hand is held.
    """
    rows = parts.select(F.col(group).alias("g"), F.col(order).alias("o"), "text", F.col("score").cast("double").alias("score"))
    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # as many tasks as asked for, however few bytes: the work is in the joining
    ordered = rows.repartition(n, "g").sortWithinPartitions("g", "o", "text", "score").select("g", "text", "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def part_rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        # NaN is one group too
        groups = ((key, txt.joined_texts((text, score) for _, text, score in own)) for key, own in groupby(part_rows(), lambda r: "NaN" if r[0] != r[0] else (r[0],)))
        keys, texts, scores, held = [], [], [], 0
        for key, (text, score) in groups:
            keys.append(float("nan") if key == "NaN" else key[0])
            texts.append(text)
            scores.append(score)
            held += len(text or "")
            if len(keys) >= 10_000 or held > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(texts, pa.string()), pa.array(scores, pa.float64())], names=["g", "text", "score"])
                keys, texts, scores, held = [], [], [], 0
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(texts, pa.string()), pa.array(scores, pa.float64())], names=["g", "text", "score"])

    kind = to_arrow_type(rows.schema["g"].dataType)
    return ordered.mapInArrow(run, StructType([StructField("g", rows.schema["g"].dataType), StructField("text", StringType()), StructField("score", DoubleType())])).withColumnRenamed("g", group)


def assembled(lines: DataFrame) -> DataFrame:
    """image_id and lines, an array of (polygon, detection_score, text, recognition_score) in the order of det_idx."""
    line = F.struct("det_idx", "polygon", "detection_score", "text", "recognition_score")
    ordered = F.transform(F.array_sort(F.collect_list(line), lambda a, b: (a["det_idx"] - b["det_idx"]).cast("int")), lambda x: x.dropFields("det_idx"))
    return lines.groupBy("image_id").agg(ordered.alias("lines"))
