"""Image preparation: bilinear sampling of a quadrilateral, rounding, normalisation, padding."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Means and deviations of the detector's planes in the order B, G, R, and of the recognizer's.
DETECTOR_MEAN, DETECTOR_STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
RECOGNIZER_MEAN, RECOGNIZER_STD = (0.5, 0.5, 0.5), (0.5, 0.5, 0.5)


def quad_point(polygon: Column, x: Column, y: Column, content_width: Column, height: Column) -> tuple[Column, Column]:
    """Source coordinates of the middle of cell (x, y): bilinear between the four corners, half a pixel back."""
    u, v = (x + 0.5) / content_width, (y + 0.5) / height
    out = []
    for c in (0, 1):
        tl, tr, br, bl = (F.get(F.get(polygon, k), c) for k in range(4))
        top, bottom = tl + (tr - tl) * u, bl + (br - bl) * u
        out.append(top + (bottom - top) * v - 0.5)
    return out[0], out[1]


def bilinear(sample: Callable[[Column, Column], Column], px: Column, py: Column, width: Column, height: Column) -> Column:
    """The image at (px, py), coordinates and neighbours kept within its edges; halves round up, 0 to 255. sample(y, x) reads a pixel."""
    x, y = F.least(F.greatest(px, F.lit(0.0)), (width - 1).cast("double")), F.least(F.greatest(py, F.lit(0.0)), (height - 1).cast("double"))
    x0, y0 = F.floor(x), F.floor(y)
    x1, y1 = F.least(x0 + 1, width - 1), F.least(y0 + 1, height - 1)
    fx, fy = x - x0, y - y0
    top = sample(y0, x0) * (1 - fx) + sample(y0, x1) * fx
    bottom = sample(y1, x0) * (1 - fx) + sample(y1, x1) * fx
    return F.least(F.greatest(F.floor(top * (1 - fy) + bottom * fy + 0.5), F.lit(0)), F.lit(255)).cast("double")


def normalized(value: Column, mean: float, std: float) -> Column:
    return value * F.lit(1.0 / (255.0 * std)) + F.lit(-mean / std)


def canvas(pixels: np.ndarray, polygon: np.ndarray, height: int, content_width: int, input_width: int, mean: tuple, std: tuple) -> np.ndarray:
    """One crop as float32 of shape [3, height, input_width]: the same arithmetic as the column expressions, over all cells at once."""
    h, w = pixels.shape[:2]
    u, v = (np.arange(content_width) + 0.5) / content_width, ((np.arange(height) + 0.5) / height)[:, None]
    tl, tr, br, bl = polygon
    px, py = ((tl[c] + (tr[c] - tl[c]) * u) * (1 - v) + (bl[c] + (br[c] - bl[c]) * u) * v - 0.5 for c in (0, 1))
    px, py = np.clip(px, 0, w - 1), np.clip(py, 0, h - 1)
    x0, y0 = px.astype(np.int64), py.astype(np.int64)
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    fx, fy, flat = (px - x0)[..., None], (py - y0)[..., None], pixels.reshape(h * w, 3)
    gx, above, below = 1 - fx, y0 * w, y1 * w

    def between(line: np.ndarray) -> np.ndarray:
        left, right = flat.take(line + x0, axis=0), flat.take(line + x1, axis=0)
        left *= gx
        right *= fx
        left += right
        return left

    top, bottom = between(above), between(below)
    top *= 1 - fy
    bottom *= fy
    top += bottom
    top += 0.5
    # of 256 values, each is normalised once; what is cut off behind the point is what floor() takes off, as none is negative
    value = np.clip(top, 0, 255).astype(np.uint8)
    table = ((np.arange(256.0)[:, None] / 255 - np.array(mean)) / np.array(std)).astype(np.float32)
    out = np.zeros((3, height, input_width), np.float32)
    for c in range(3):
        out[c, :, :content_width] = table[:, c].take(value[..., c])
    return out


#: Bytes of canvases that are handed on together.
AT_ONCE = 8 << 20


def prepared(crops: DataFrame, height: int | None, mean: tuple[float, float, float], std: tuple[float, float, float]) -> DataFrame:
    """crops (any columns, with pixels of interleaved B, G, R bytes, width, height, polygon, content_width, input_width)
    with data, array<float> of shape [3, rows, input_width], instead of the pixels; columns behind the content stay 0.

    rows is height, or the column input_height where height is None. Narrow: a crop is made where its image lies.
    """
    of = ["polygon", "content_width", "input_width"] + ["input_height"] * (height is None)
    rest = [c for c in crops.columns if c not in ("pixels", *of)]
    made = prepared_crops(crops.select(*rest, "pixels", F.array(F.struct(*of)).alias("crops")), height, mean, std)
    return made.select(*[c for c in crops.columns if c != "pixels"], "data")


def prepared_crops(images: DataFrame, height: int | None, mean: tuple[float, float, float], std: tuple[float, float, float]) -> DataFrame:
    """A row per crop of each image: the image's columns but pixels and crops, the crop's fields, and data as in prepared().

    images has pixels, width, height and crops, an array of structs with polygon, content_width, input_width (and
    input_height where height is None). An image's pixels are there once, however many crops are made of it.
    """
    rest, of = [c for c in images.columns if c not in ("pixels", "crops")], images.schema["crops"].dataType.elementType.names
    kinds = [f"`{c}` {images.schema[c].dataType.simpleString()}" for c in rest] + [f"`{f.name}` {f.dataType.simpleString()}" for f in images.schema["crops"].dataType.elementType.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crops, offsets = batch.column("crops").values, batch.column("crops").offsets.to_numpy()
            fields = {c: crops.field(c) for c in of}
            shapes = list(zip(*(fields[c].to_pylist() for c in ("polygon", "content_width", "input_width")), [height] * len(crops) if height is not None else fields["input_height"].to_pylist(), strict=True))
            sizes = list(zip(batch.column("width").to_pylist(), batch.column("height").to_pylist(), strict=True))
            image, crop, data, held = [], [], [], 0

            def rows() -> pa.RecordBatch:
                ends = np.cumsum([0, *map(len, data)])  # noqa: B023
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(data)))  # noqa: B023
                at, place = pa.array(image, pa.int64()), pa.array(crop, pa.int64())  # noqa: B023
                return pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in rest), *(fields[c].take(place) for c in of), lists], names=[*rest, *of, "data"])  # noqa: B023

            for k, (w, h) in enumerate(sizes):
                pixels = np.frombuffer(batch.column("pixels")[k].as_py(), np.uint8).reshape(h, w, 3).astype(np.float64)
                for j in range(offsets[k], offsets[k + 1]):
                    polygon, content, width, lines = shapes[j]
                    data.append(canvas(pixels, np.array(polygon), lines, content, width, mean, std).ravel())
                    image.append(k)
                    crop.append(j)
                    held += data[-1].nbytes
                    if held >= AT_ONCE:
                        yield rows()
                        image, crop, data, held = [], [], [], 0
            if data:
                yield rows()

    return images.mapInArrow(run, ", ".join(kinds) + ", data array<float>")
