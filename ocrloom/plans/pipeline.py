"""The whole flow: images, detector, boxes, batches, recognizer, texts, results.

Detector and recognizer are functions from DataFrame to DataFrame, so that any model can stand there: the detector gets
rows with `data` ([3, input_height, input_width]) and returns image_id and values (a heatmap of that size); the recognizer
gets crops with `data` ([3, 48, input_width]) and returns image_id, det_idx and values (steps of class probabilities). A
model that hands on the other columns it was given spares the flow a join: then detection is narrow up to the boxes, the
boxes go to their images once, and what follows is narrow again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..operators import preprocess
from ..operators.detections import DetectionOptions, best_in_reading_order, extract_detections
from ..operators.recognition import assembled, decode_ctc, recognition_batches

Model = Callable[[DataFrame], DataFrame]

__all__ = ["OcrPipeline", "PipelineOptions", "best_in_reading_order"]


@dataclass(frozen=True)
class PipelineOptions:
    """detector_max_side None: the default resizing, up to the least side."""

    detector_max_side: int | None = 736
    detection: DetectionOptions = field(default_factory=DetectionOptions)


class OcrPipeline:
    def __init__(self, detector: Model, recognizer: Model, dictionary: list[str], steps: int, classes: int, options: PipelineOptions = PipelineOptions()):  # noqa: B008
        if classes not in (len(dictionary) + 1, len(dictionary) + 2):
            raise ValueError("classes and dictionary don't fit each other")
        self.detector, self.recognizer, self.dictionary, self.steps, self.classes, self.options = detector, recognizer, dictionary, steps, classes, options

    def plan(self, images: DataFrame) -> DataFrame:
        """images with input_width and input_height of the detector, and their corners as polygon."""
        w, h = geo.detector_input(F.col("width"), F.col("height"), self.options.detector_max_side)
        return images.withColumn("input_width", w).withColumn("input_height", h).withColumn("content_width", F.col("input_width")).withColumn("polygon", geo.corners(F.col("width"), F.col("height")))

    def detect(self, planned: DataFrame) -> DataFrame:
        """image_id, det_idx, score, polygon."""
        sizes = planned.select("image_id", F.col("width").alias("source_width"), F.col("height").alias("source_height"), F.col("input_width").alias("width"), F.col("input_height").alias("height"))
        heat = self.detector(preprocess.prepared(planned, None, preprocess.DETECTOR_MEAN, preprocess.DETECTOR_STD))
        if {"width", "height", "input_width", "input_height"} <= set(heat.columns):
            heat = heat.select("image_id", "values", F.col("width").alias("source_width"), F.col("height").alias("source_height"), F.col("input_width").alias("width"), F.col("input_height").alias("height"))
        else:
            heat = heat.select("image_id", "values").join(sizes, "image_id")
        return extract_detections(heat.withColumn("content_width", F.col("width")).withColumn("content_height", F.col("height")), self.options.detection)

    def recognize(self, images: DataFrame, detections: DataFrame) -> DataFrame:
        """image_id, det_idx, polygon, detection_score, text, recognition_score."""
        batches = recognition_batches(detections).withColumnRenamed("batch_width", "input_width")
        # an image's crops come to it as an array, at most as long as the detector's max_boxes; its pixels are there once
        fields = ["det_idx", "polygon", "score", "content_width", "input_width"]
        crops = batches.groupBy("image_id").agg(F.collect_list(F.struct(*fields)).alias("crops"))
        wanted = images.select("image_id", "width", "height", "pixels").join(crops, "image_id")
        data = preprocess.prepared_crops(wanted, geo.RECOGNIZER_INPUT_HEIGHT, preprocess.RECOGNIZER_MEAN, preprocess.RECOGNIZER_STD)
        values = self.recognizer(data)
        if not set(fields) <= set(values.columns):
            values = batches.select("image_id", *fields).join(values.select("image_id", "det_idx", "values"), ["image_id", "det_idx"])
        decoded = decode_ctc(F.col("values"), self.steps, self.classes, self.dictionary, F.col("content_width"), F.col("input_width"))
        return values.withColumn("d", decoded).select("image_id", "det_idx", "polygon", F.col("score").alias("detection_score"), F.col("d.text").alias("text"), F.col("d.score").alias("recognition_score"))

    def transform(self, images: DataFrame) -> DataFrame:
        """images (image_id, width, height, pixels) to image_id, source_size, detector_input_size, lines: a row for each image."""
        planned = self.plan(images)
        lines = assembled(self.recognize(images, self.detect(planned)))
        sizes = planned.select("image_id", F.array("width", "height").alias("source_size"), F.array("input_width", "input_height").alias("detector_input_size"))
        none = F.array().cast(lines.schema["lines"].dataType)
        return sizes.join(lines, "image_id", "left").withColumn("lines", F.coalesce("lines", none))
