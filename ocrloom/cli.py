"""Command line: images to JSON or text. Models are named as module:function, DataFrame to DataFrame."""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import catalog
from .operators.detections import DetectionOptions
from .plans.pipeline import OcrPipeline, PipelineOptions
from .sources import readers


def named(path: str):
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="ocrloom", description=__doc__)
    parser.add_argument("images", help="a path or pattern of PNG or JPEG files")
    parser.add_argument("--detector", required=True, help="module:function")
    parser.add_argument("--recognizer", required=True, help="module:function")
    parser.add_argument("--dictionary", help="by default the one in the recognizer's package")
    parser.add_argument("--model-dir", help=f"root of the model packages; else ${catalog.ROOT_VARIABLE}, else models")
    parser.add_argument("--model-size", choices=catalog.SIZES, default="small")
    parser.add_argument("--catalog", help="JSON catalog of the packages, which are looked for before anything is read")
    access = parser.add_mutually_exclusive_group()
    access.add_argument("--offline", action="store_true", help="fail if a package of the catalog isn't there")
    access.add_argument("--verify-models", action="store_true", help="the same, by the files' digests")
    parser.add_argument("--steps", type=int, required=True)
    parser.add_argument("--classes", type=int, required=True)
    parser.add_argument("--detector-max-side", type=int, default=736)
    parser.add_argument("--binary-threshold", type=float, default=0.2)
    parser.add_argument("--box-threshold", type=float, default=0.4)
    parser.add_argument("--min-area", type=int, default=3)
    parser.add_argument("--unclip-ratio", type=float, default=1.4)
    parser.add_argument("--max-boxes", type=int, default=1000)
    parser.add_argument("--format", choices=("json", "text"), default="json")
    parser.add_argument("--output", required=True)
    return parser.parse_args(argv)


def main(argv: list[str] | None = None) -> None:
    a = arguments(argv)
    spark = SparkSession.builder.getOrCreate()
    root = catalog.model_root("models", a.model_dir)
    if a.catalog and (a.offline or a.verify_models):
        names = [catalog.model_name(kind, a.model_size) for kind in ("det", "rec")]
        catalog.require_packages(spark, root, readers.read_catalog(spark, a.catalog).where(F.col("name").isin(names)), a.verify_models)
    path = catalog.dictionary_beside(f"{root}/{catalog.model_name('rec', a.model_size)}/", a.dictionary)
    dictionary = [r["token"] for r in readers.read_dictionary(spark, path).orderBy("class_id").collect()]
    options = PipelineOptions(a.detector_max_side, DetectionOptions(a.binary_threshold, a.box_threshold, a.min_area, a.unclip_ratio, a.max_boxes))
    pipeline = OcrPipeline(named(a.detector), named(a.recognizer), dictionary, a.steps, a.classes, options)
    readers.write_results(pipeline.transform(readers.read_images(spark, a.images)), a.output, a.format)


if __name__ == "__main__":
    main()
