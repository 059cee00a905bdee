"""From heatmaps to text boxes: threshold, components, rotated boxes, filters, top-k and reading order.

The steps are relations over active pixels. Components are found over runs of pixels in a row instead of pixels: a run
links to the runs that touch it, corners too, in the row above. Heatmaps that lie whole in a row are labelled there; for
tables of pixels the same links are a relation, a few per line, over which labels move until they settle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as geo
from .graph import connected


@dataclass(frozen=True)
class DetectionOptions:
    """Thresholds of the detector's post-processing; the values are the defaults of its command line."""

    binary_threshold: float = 0.2
    box_threshold: float = 0.4
    min_area: int = 3
    unclip_ratio: float = 1.4
    max_boxes: int = 1000

    def __post_init__(self) -> None:
        for name in ("binary_threshold", "box_threshold"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} must lie between 0 and 1")
        if self.min_area < 1 or self.max_boxes < 1 or not 0 < self.unclip_ratio < float("inf"):
            raise ValueError("min_area, max_boxes and unclip_ratio must be positive")


def heatmap_problem(values: Column, width: Column, height: Column) -> Column:
    """What forbids a heatmap, null for a sound one: not width times height values, or one that isn't finite."""
    finite = F.size(values) == F.size(F.filter(values, lambda v: ~F.isnan(v) & (F.abs(v) < float("inf"))))
    return F.when(F.size(values) != width * height, "shape").when(~finite, "not finite")


def active_pixels(heatmaps: DataFrame, threshold: float) -> DataFrame:
    """image_id, x, y, v of the pixels at or above threshold. heatmaps: image_id, width, height, values and, where the
    content is smaller than the map, content_width and content_height. A value that isn't finite is an error."""
    cw = F.least("content_width", "width") if "content_width" in heatmaps.columns else F.col("width")
    ch = F.least("content_height", "height") if "content_height" in heatmaps.columns else F.col("height")
    ok = heatmap_problem(F.col("values"), F.col("width"), F.col("height")).isNull()
    values = F.when(ok, F.col("values")).otherwise(F.raise_error(F.lit("a heatmap has values that aren't finite, or not width times height of them")))
    # pixels are filtered in their array, so only active ones become rows
    active = F.filter(F.transform(values, lambda v, i: F.struct(i.alias("i"), v.cast("double").alias("v"))), lambda p: p["v"] >= threshold)
    cells = heatmaps.select("image_id", "width", cw.alias("cw"), ch.alias("ch"), F.explode(active).alias("p")).select("image_id", "width", "cw", "ch", "p.i", "p.v")
    x, y = (F.col("i") % F.col("width")).cast("long"), F.floor(F.col("i") / F.col("width"))
    return cells.select("image_id", x.alias("x"), y.alias("y"), "v", F.col("width").cast("long").alias("width"), "cw", "ch").where((F.col("x") < F.col("cw")) & (F.col("y") < F.col("ch"))).select("image_id", "x", "y", "v", "width")


def label_components(pixels: DataFrame) -> DataFrame:
    """pixels (image_id, x, y, width, ...) with label: the first place, in raster order, of their 8-connected component."""
    line = Window.partitionBy("image_id", "y").orderBy("x")
    runs_of = pixels.withColumn("run", F.col("x") - F.row_number().over(line))
    runs = runs_of.groupBy("image_id", "y", "run").agg(F.min("x").alias("first"), F.max("x").alias("last"), F.min("width").alias("width")).withColumn("id", F.col("y") * F.col("width") + F.col("first"))
    above = runs.select("image_id", (F.col("y") + 1).alias("y"), F.col("first").alias("f"), F.col("last").alias("l"), F.col("id").alias("b"))
    touching = runs.join(above, ["image_id", "y"]).where((F.col("f") <= F.col("last") + 1) & (F.col("l") >= F.col("first") - 1))
    labels = connected(runs.select(F.col("image_id").alias("g"), "id"), touching.select(F.col("image_id").alias("g"), F.col("id").alias("a"), "b"))
    named = runs.join(labels.select(F.col("g").alias("image_id"), "id", "label"), ["image_id", "id"]).select("image_id", "y", "run", "label")
    return runs_of.join(named, ["image_id", "y", "run"]).drop("run")


def _label_runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """y, x and label of the set cells of a plane: labels move between runs of a row and those that touch them in the row
    above, and then to the label's own label, until none moves. A label is the first place, in raster order."""
    h, w = mask.shape
    flat = np.zeros((h, w + 1), np.int8)
    flat[:, :w] = mask
    edge = np.diff(flat.ravel(), prepend=0)
    first, behind = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    row, begin, end = first // (w + 1), first % (w + 1), behind % (w + 1)
    # the runs of the row above that touch a run lie side by side: from the first that ends at its beginning or later
    key_end, key_begin = row * (w + 2) + end, row * (w + 2) + begin
    lo = np.searchsorted(key_end, (row - 1) * (w + 2) + begin)
    hi = np.searchsorted(key_begin, (row - 1) * (w + 2) + end, side="right")
    n = np.maximum(hi - lo, 0)
    below = np.repeat(np.arange(len(row)), n)
    above = np.arange(len(below)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    label = np.arange(len(row))
    while True:
        new = label.copy()
        np.minimum.at(new, below, label[above])
        np.minimum.at(new, above, label[below])
        new = new[new]
        if (new == label).all():
            break
        label = new
    y, x = np.nonzero(mask)
    return y, x, np.repeat(row[label] * w + begin[label], behind - first)


def _planes(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Of each row: its image_id, the heatmap, and the cells of the content."""
    values, offsets = batch.column("values").values.to_numpy(zero_copy_only=False), batch.column("values").offsets.to_numpy()
    sizes = zip(*(batch.column(c).to_pylist() for c in ("width", "height", "cw", "ch")), strict=True)
    for k, (w, h, cw, ch) in enumerate(sizes):
        plane = values[offsets[k] : offsets[k + 1]]
        if len(plane) != w * h or not np.isfinite(plane).all():
            raise ValueError("a heatmap has values that aren't finite, or not width times height of them")
        on = np.zeros((h, w), bool)
        on[:ch, :cw] = True
        yield batch.column("image_id").slice(k, 1), plane.reshape(h, w), on


def _heatmaps(heatmaps: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    sized = "content_width" in heatmaps.columns
    return heatmaps.select(*[F.col(c).alias(f"keep_{c}") for c in keep], "image_id", "width", "height", (F.col("content_width") if sized else F.col("width")).alias("cw"), (F.col("content_height") if sized else F.col("height")).alias("ch"), F.col("values").cast("array<double>").alias("values"))


def labelled_pixels(heatmaps: DataFrame, threshold: float) -> DataFrame:
    """What label_components(active_pixels()) gives, found image by image where its row lies: no shuffle, no rounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image, plane, on in _planes(batch):
                y, x, label = _label_runs((plane >= threshold) & on)
                ids = image.take(pa.array(np.zeros(len(y), np.int64)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(plane[y, x]), pa.array(np.full(len(y), plane.shape[1]), pa.int64()), pa.array(label)], names=["image_id", "x", "y", "v", "width", "label"])

    return _heatmaps(heatmaps).mapInArrow(run, f"image_id {heatmaps.schema['image_id'].dataType.simpleString()}, x long, y long, v double, width long, label long")


_MOMENTS, _AXES = ("n", "score", "sx", "sy", "sxx", "sxy", "syy"), ("cx", "cy", "ax", "ay", "a0", "a1", "b0", "b1")


def components_of(heatmaps: DataFrame, threshold: float, keep: Sequence[str] = ()) -> DataFrame:
    """A row per component: image_id, label, the sums of component_moments(), centre, axis, the spans along and across it, and
    the columns of the heatmap that keep names.

    Labels, sums and spans come from one pass over an image where its row lies, so pixels never leave it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of_row, rows = [], []
            for k, (_, plane, on) in enumerate(_planes(batch)):
                y, x, label = _label_runs((plane >= threshold) & on)
                found, of = np.unique(label, return_inverse=True)
                n = np.bincount(of, minlength=len(found))
                total = lambda v: np.bincount(of, v, len(found))  # noqa: E731, B023
                score, sx, sy, sxx, sxy, syy = total(plane[y, x]) / n, total(x), total(y), total(x * x), total(x * y), total(y * y)
                angle = 0.5 * np.arctan2(2 * (n * sxy - sx * sy), (n * sxx - sx * sx) - (n * syy - sy * sy))
                ax, ay, cx, cy = np.cos(angle), np.sin(angle), sx / n + 0.5, sy / n + 0.5
                turn = np.where((ax < 0) | ((np.abs(ax) < geo.FLOAT_EPSILON) & (ay < 0)), -1.0, 1.0)
                ax, ay = ax * turn, ay * turn
                dx, dy = x + 0.5 - cx[of], y + 0.5 - cy[of]
                spans = []
                for v in (dx * ax[of] + dy * ay[of], dy * ax[of] - dx * ay[of]):
                    for f, edge in ((np.minimum, np.inf), (np.maximum, -np.inf)):
                        spans.append(np.full(len(found), edge))
                        f.at(spans[-1], of, v)
                of_row.append(np.full(len(found), k))
                rows.append((found, n, score, *(v.astype(np.int64) for v in (sx, sy, sxx, sxy, syy)), cx, cy, ax, ay, *spans))
            if rows:
                at = pa.array(np.concatenate(of_row))
                given = [batch.column(c).take(at) for c in ("image_id", *(f"keep_{c}" for c in keep))]
                yield pa.RecordBatch.from_arrays([*given, *(pa.array(np.concatenate(c)) for c in zip(*rows, strict=True))], names=["image_id", *keep, "label", *_MOMENTS, *_AXES])

    kinds = {"n": "long", "score": "double", **dict.fromkeys(_MOMENTS[2:], "long"), **dict.fromkeys(_AXES, "double")}
    given = ", ".join(f"`{c}` {heatmaps.schema[c].dataType.simpleString()}" for c in ("image_id", *keep))
    return _heatmaps(heatmaps, keep).mapInArrow(run, f"{given}, label long, " + ", ".join(f"{k} {v}" for k, v in kinds.items()))


def component_moments(labelled: DataFrame) -> DataFrame:
    """Per component: pixels, mean value and whole-number sums from which covariances come out exactly."""
    x, y = F.col("x"), F.col("y")
    return labelled.groupBy("image_id", "label").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("score"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(x * y).alias("sxy"), F.sum(y * y).alias("syy"))


def rotated_boxes(labelled: DataFrame, options: DetectionOptions) -> DataFrame:
    """image_id, label, n, score, polygon (corners in the map's coordinates) of the components that pass the filters."""
    kept = component_moments(labelled).where((F.col("n") >= options.min_area) & (F.col("score") >= options.box_threshold))
    n = F.col("n")
    xx, xy, yy = n * F.col("sxx") - F.col("sx") * F.col("sx"), n * F.col("sxy") - F.col("sx") * F.col("sy"), n * F.col("syy") - F.col("sy") * F.col("sy")
    axes = kept.select("image_id", "label", "n", "score", (F.col("sx") / n + 0.5).alias("cx"), (F.col("sy") / n + 0.5).alias("cy"), (0.5 * F.atan2((2 * xy).cast("double"), (xx - yy).cast("double"))).alias("angle"))
    axes = axes.withColumn("ax", F.cos("angle")).withColumn("ay", F.sin("angle"))
    turn = (F.col("ax") < 0) | ((F.abs("ax") < geo.FLOAT_EPSILON) & (F.col("ay") < 0))
    axes = axes.withColumn("s", F.when(turn, -1.0).otherwise(1.0)).withColumn("ax", F.col("ax") * F.col("s")).withColumn("ay", F.col("ay") * F.col("s")).drop("s", "angle")
    dx, dy = F.col("x") + 0.5 - F.col("cx"), F.col("y") + 0.5 - F.col("cy")
    along, across = dx * F.col("ax") + dy * F.col("ay"), dy * F.col("ax") - dx * F.col("ay")
    spans = labelled.join(axes, ["image_id", "label"]).groupBy("image_id", "label", "n", "score", "cx", "cy", "ax", "ay").agg(F.min(along).alias("a0"), F.max(along).alias("a1"), F.min(across).alias("b0"), F.max(across).alias("b1"))
    return boxed(spans, options)


def boxed(spans: DataFrame, options: DetectionOptions) -> DataFrame:
    """image_id, label, n, score, polygon (and what else spans has) from the centres, axes and spans of components; the filters apply."""
    mid_a, mid_b = (F.col("a0") + F.col("a1")) / 2, (F.col("b0") + F.col("b1")) / 2
    half_a, half_b = (F.col("a1") - F.col("a0") + 1) * options.unclip_ratio / 2, (F.col("b1") - F.col("b0") + 1) * options.unclip_ratio / 2

    def corner(i: int, j: int) -> Column:
        a, b = mid_a + i * half_a, mid_b + j * half_b
        return F.array(F.col("cx") + a * F.col("ax") - b * F.col("ay"), F.col("cy") + a * F.col("ay") + b * F.col("ax"))

    kept = spans.where((F.col("n") >= options.min_area) & (F.col("score") >= options.box_threshold))
    rest = [c for c in spans.columns if c not in ("image_id", "label", *_MOMENTS, *_AXES)]
    return kept.select("image_id", *rest, "label", "n", "score", F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1)).alias("polygon"))


def mapped_to_source(boxes: DataFrame, source_width: Column, source_height: Column, content_width: Column, content_height: Column) -> DataFrame:
    polygon = F.transform("polygon", lambda p: F.array(geo.to_source(p[0], source_width, content_width), geo.to_source(p[1], source_height, content_height)))
    return boxes.withColumn("polygon", polygon)


def best_in_reading_order(detections: DataFrame, max_boxes: int, found: str = "label") -> DataFrame:
    """The max_boxes best detections of each image, numbered det_idx from 1 in reading order: by centre from top to bottom,
    then left to right, then score; found is the order of discovery and settles ties."""
    x, y = geo.polygon_center(F.col("polygon"))
    placed = detections.withColumn("center_x", x).withColumn("center_y", y)
    best = Window.partitionBy("image_id").orderBy(F.col("score").desc(), "center_y", "center_x", found)
    order = Window.partitionBy("image_id").orderBy("center_y", "center_x", "score", found)
    return placed.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= max_boxes).withColumn("det_idx", F.row_number().over(order)).drop("rank")


def extract_detections(heatmaps: DataFrame, options: DetectionOptions = DetectionOptions()) -> DataFrame:  # noqa: B008
    """image_id, det_idx, score, polygon in source coordinates. heatmaps: image_id, width, height, values; source_width,
    source_height, content_width and content_height where source and map differ."""
    sizes = ("source_width", "source_height", "content_width", "content_height") if "source_width" in heatmaps.columns else ()
    boxes = boxed(components_of(heatmaps, options.binary_threshold, sizes), options)
    if sizes:
        boxes = mapped_to_source(boxes, *map(F.col, sizes))
    return best_in_reading_order(boxes, options.max_boxes).select("image_id", "det_idx", "score", "polygon")
