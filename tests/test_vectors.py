"""Known inputs and results, and errors."""

import json
import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ocrloom import cli
from ocrloom.functions import geometry as geo
from ocrloom.functions import tensor as t
from ocrloom.functions import text as txt
from ocrloom.operators import catalog, detections, preprocess, recognition
from ocrloom.sources import readers
from ocrloom.streaming import incoming


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def array(values):
    return F.array(*[F.lit(float(v)) for v in values])


def rectangle(x0, y0, x1, y1):
    return F.array(*[array(p) for p in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))])


def test_boxes_of_two_bars(spark):
    """An upright and a lying bar in a small map, one below the least area beside them, mapped to an image twice as large."""
    w, h = 40, 30
    values = np.zeros((h, w))
    values[5:15, 3:6], values[20:22, 10:30], values[2, 35] = 0.8, 0.6, 1.0
    heat = spark.createDataFrame([(7, w, h, values.ravel().tolist(), 80, 60, w, h)], "image_id long, width int, height int, values array<double>, source_width int, source_height int, content_width int, content_height int")
    found = detections.extract_detections(heat, detections.DetectionOptions(min_area=2, unclip_ratio=1.0)).orderBy("det_idx").collect()
    assert [r["score"] for r in found] == pytest.approx([0.8, 0.6])
    edges = [[min(p[c] for p in r["polygon"]) for c in (0, 1)] + [max(p[c] for p in r["polygon"]) for c in (0, 1)] for r in found]
    assert edges[0] == pytest.approx([6, 10, 12, 30]) and edges[1] == pytest.approx([20, 40, 60, 44])


def test_labels_of_random_planes(spark):
    """Labels, moments and boxes from one pass over an image against the relations over pixels."""
    rng = np.random.default_rng(5)
    rows = [(k, 13, 9, (rng.random(117) * (rng.random(117) < 0.45)).tolist()) for k in range(12)]
    heat = spark.createDataFrame([*rows, (99, 2, 1, [0.0, 0.0])], "image_id long, width int, height int, values array<double>")
    pixels = detections.active_pixels(heat, 0.3)
    relational = detections.label_components(pixels)
    key = lambda df: sorted((r["image_id"], r["x"], r["y"], r["label"]) for r in df.collect())
    assert key(relational) == key(detections.labelled_pixels(heat, 0.3))
    options = detections.DetectionOptions(binary_threshold=0.3, box_threshold=0.1, min_area=2)
    flat = lambda df: {(r["image_id"], r["label"]): [r["n"], r["score"], *(v for p in r["polygon"] for v in p)] for r in df.collect()}
    a, b = flat(detections.rotated_boxes(relational, options)), flat(detections.boxed(detections.components_of(heat, 0.3), options))
    assert a.keys() == b.keys() and len(a) > 20
    for k in a:
        assert a[k] == pytest.approx(b[k])


def test_components_touch_at_corners_and_keep_apart_across_a_gap(spark):
    grid = ["1.1....1", ".1.....1", "........", "11.1....", "..1....."]
    values = [1.0 if c == "1" else 0.0 for row in grid for c in row]
    heat = spark.createDataFrame([(1, 8, 5, values)], "image_id long, width int, height int, values array<double>")
    rows = detections.label_components(detections.active_pixels(heat, 0.5)).collect()
    labels = {}
    for r in rows:
        labels.setdefault(r["label"], set()).add((r["x"], r["y"]))
    assert labels == {0: {(0, 0), (1, 1), (2, 0)}, 7: {(7, 0), (7, 1)}, 24: {(0, 3), (1, 3), (2, 4), (3, 3)}}


def test_a_heatmap_that_is_not_finite_is_an_error(spark):
    heat = spark.createDataFrame([(1, 2, 1, [float("nan"), 0.5])], "image_id long, width int, height int, values array<double>")
    with pytest.raises(Exception, match="finite"):
        detections.active_pixels(heat, 0.2).collect()


def test_ctc_ignores_padding(spark):
    got = one(spark, recognition.decode_ctc(array([0.1, 0.9] * 5), 5, 2, ["A"], F.lit(40), F.lit(100)))
    assert got["text"] == "A"
    with pytest.raises(ValueError, match="fit"):
        recognition.decode_ctc(array([0.0]), 1, 5, ["A"])


def test_wide_and_mixed_batches(spark):
    rows = spark.range(1).select(F.lit(1).alias("image_id"), F.explode(F.array(F.struct(F.lit(1).alias("det_idx"), rectangle(0, 0, 1000, 20).alias("polygon")))).alias("d")).select("image_id", "d.*")
    got = recognition.recognition_batches(rows).first()
    assert (got["batch_width"], got["content_width"]) == (2400, 2400)
    two = F.array(F.struct(F.lit(1).alias("det_idx"), rectangle(0, 0, 80, 20).alias("polygon")), F.struct(F.lit(2).alias("det_idx"), rectangle(0, 0, 300, 20).alias("polygon")))
    mixed = recognition.recognition_batches(spark.range(1).select(F.lit(1).alias("image_id"), F.explode(two).alias("d")).select("image_id", "d.*")).collect()
    assert {r["batch_width"] for r in mixed} == {720}


def test_detector_plan(spark):
    w, h = geo.detector_input(F.lit(1920), F.lit(1080), 736)
    assert one(spark, F.struct(w, h)) == (736, 416)
    assert one(spark, geo.to_source(F.lit(736.0), F.lit(1920), F.lit(736))) == pytest.approx(1920)
    with pytest.raises(ValueError, match="positive"):
        geo.detector_ratio(F.lit(1), F.lit(1), 0)
    with pytest.raises(Exception, match="invalid"):
        one(spark, geo.aligned_dimension(F.lit(0.0)))


def test_recognizer_canvas_is_padded_with_zero(spark):
    pixels = bytes([127]) * (80 * 20 * 3)
    crops = spark.createDataFrame([(1, pixels, 80, 20, [[0.0, 0.0], [80.0, 0.0], [80.0, 20.0], [0.0, 20.0]], 192, 320)], "image_id long, pixels binary, width int, height int, polygon array<array<double>>, content_width long, input_width long")
    data = np.array(preprocess.prepared(crops, 48, preprocess.RECOGNIZER_MEAN, preprocess.RECOGNIZER_STD).first()["data"]).reshape(3, 48, 320)
    assert data[0, 0, 0] == pytest.approx((127 / 255 - 0.5) / 0.5, abs=1e-6)
    assert data[0, 0, 192] == 0


def test_columns_and_arrays_sample_a_quadrilateral_alike(spark):
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (29, 37, 3)).astype(np.uint8)
    quad = [[2.25, 1.75], [34.5, 3.0], [32.75, 27.0], [1.0, 25.5]]
    crops = spark.createDataFrame([(image.tobytes(), 37, 29, quad, 41, 41, 23)], "pixels binary, width int, height int, polygon array<array<double>>, content_width long, input_width long, input_height long")
    data = np.array(preprocess.prepared(crops, None, preprocess.DETECTOR_MEAN, preprocess.DETECTOR_STD).first()["data"]).reshape(3, 23, 41)

    def cell(y, x):
        px, py = preprocess.quad_point(F.col("polygon"), x, y, F.lit(41), F.lit(23))
        plane = preprocess.bilinear(lambda r, c: F.get(F.col("plane"), (r * 37 + c).cast("int")).cast("double"), px, py, F.lit(37), F.lit(29))
        return preprocess.normalized(plane, preprocess.DETECTOR_MEAN[1], preprocess.DETECTOR_STD[1])

    rows = spark.createDataFrame([(quad, image[:, :, 1].ravel().tolist())], "polygon array<array<double>>, plane array<int>")
    assert np.array(rows.select(t.over_grid(23, 41, cell)).first()[0]) == pytest.approx(data[1].ravel(), abs=2e-6)


def test_numbers(spark):
    assert one(spark, t.erf(F.lit(1.0))) == pytest.approx(0.8427008, abs=2e-7)
    assert one(spark, t.erf(F.lit(-2.0))) == pytest.approx(-0.9953223, abs=2e-7)
    assert one(spark, t.relu(F.lit(float("nan")))) == 0
    assert one(spark, t.pooled(array([float("nan"), 2, 1, 0]), 2, 2, (2, 2), (1, 1), (0, 0, 0, 0), "max")) == [2.0]
    assert one(spark, t.argmax_last(array([1, 3, 3, 2]))) == 2
    assert one(spark, t.linear(array([2, 3, 1]), [[1, 0, -1], [0, 1, 1]], [0.5, -0.5])) == [1.5, 3.5]
    assert one(spark, t.layer_norm(array([4, 4, 4]), epsilon=1e-5)) == [0, 0, 0]
    assert one(spark, t.conv_transpose_2x2(array([1, 2]), [[1, 1], [1, 1]], 0.5, 1, 2)) == [1.5, 1.5, 2.5, 2.5] * 2
    planes = [array([1, 2]), array([10, 20])]
    assert one(spark, t.conv2d(planes, [[[1.0]], [[2.0]]], 0.5, 1, 2)) == [21.5, 42.5]
    assert sum(one(spark, t.softmax(array([-3, 0.5, 2, -0.25, 1, 0, -1])))) == pytest.approx(1)
    assert t.output_size(7, 3, 2, 0, 0) == 3 and t.output_size(8, 3, 2, 0, 0, ceil=True) == 4
    with pytest.raises(ValueError, match="smaller"):
        t.output_size(2, 3, 1, 0, 0)


def test_attention_against_numpy(spark):
    q, k, v = (np.array([((i * 17 + s) % 101) * 0.01 - 0.5 for i in range(12)]).reshape(3, 4) for s in (0, 12, 24))
    scores = q @ k.T * 0.5
    weights = np.exp(scores - scores.max(1, keepdims=True))
    wanted = weights / weights.sum(1, keepdims=True) @ v
    assert np.array(one(spark, t.attention(array(q.ravel()), array(k.ravel()), array(v.ravel()), 3, 4))) == pytest.approx(wanted.ravel(), abs=1e-9)


def test_joined_texts(spark):
    parts = F.array(*[F.struct(F.lit(a).alias("text"), F.lit(s).alias("score")) for a, s in (("hello wo", 0.5), ("world", 1.0), ("", 0.1), ("d!", 0.2))])
    got = one(spark, txt.joined(parts))
    assert got["text"] == "hello world!"
    assert got["score"] == pytest.approx((0.5 * 8 + 1.0 * 3 + 0.2) / 12)
    empty = F.array(F.struct(F.lit("").alias("text"), F.lit(0.7).alias("score")))
    assert one(spark, txt.joined(empty))["score"] == 0


def png(path, width, height, channels, pixels):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = b"".join(b"\0" + pixels[y * width * channels : (y + 1) * width * channels] for y in range(height))
    kind = {1: 0, 3: 2, 4: 6}[channels]
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b""))


def test_images_come_out_in_three_channels(spark, tmp_path):
    png(tmp_path / "a.png", 2, 1, 3, bytes([1, 2, 3, 4, 5, 6]))
    png(tmp_path / "b.png", 2, 1, 4, bytes([1, 2, 3, 255, 4, 5, 6, 255]))
    png(tmp_path / "c.png", 2, 1, 1, bytes([7, 9]))
    rows = {r["image_id"][-5]: bytes(r["pixels"]) for r in readers.read_images(spark, str(tmp_path)).collect()}
    assert rows == {"a": bytes([3, 2, 1, 6, 5, 4]), "b": bytes([3, 2, 1, 6, 5, 4]), "c": bytes([7, 7, 7, 9, 9, 9])}
    (tmp_path / "d.png").write_bytes(b"no image")
    with pytest.raises(Exception, match="decode"):
        readers.read_images(spark, str(tmp_path)).collect()
    assert readers.read_images(spark, str(tmp_path), fail_fast=False).where("pixels is null").count() == 1


def test_images_in_memory_are_checked(spark):
    rows = spark.createDataFrame([(1, 2, 1, bytes(6))], "image_id int, width int, height int, pixels binary")
    assert readers.images_of(rows).select(readers.pixel(1, 0, 2).alias("x")).first()["x"] == 0
    with pytest.raises(Exception, match="fit"):
        readers.images_of(rows.withColumn("height", F.lit(2))).collect()


def tensor_file(path, tensors, cut=0):
    data, header = b"", {}
    for name, (dtype, shape, values) in tensors.items():
        raw = np.array(values, "<f4").tobytes()
        header[name] = {"dtype": dtype, "shape": shape, "data_offsets": [len(data), len(data) + len(raw)]}
        data += raw
    head = json.dumps(header).encode()
    path.write_bytes(struct.pack("<Q", len(head)) + head + data[: len(data) - cut])


def test_tensor_files(spark, tmp_path):
    spark.dataSource.register(readers.TensorFiles)
    tensor_file(tmp_path / "x.safetensors", {"a.weight": ("F32", [2, 2], [1, 2, 3, 4]), "b": ("F32", [1], [5])})
    rows = {r["name"]: (r["shape"], r["data"]) for r in spark.read.format("tensorfile").load(str(tmp_path)).collect()}
    assert rows == {"a.weight": ([2, 2], [1.0, 2.0, 3.0, 4.0]), "b": ([1], [5.0])}
    tensor_file(tmp_path / "x.safetensors", {"a": ("F16", [1], [1])})
    with pytest.raises(Exception, match="F32"):
        spark.read.format("tensorfile").load(str(tmp_path)).collect()
    tensor_file(tmp_path / "x.safetensors", {"a": ("F32", [2], [1, 2])}, cut=4)
    with pytest.raises(Exception, match="cut off"):
        spark.read.format("tensorfile").load(str(tmp_path)).collect()


def test_tensors_below_a_name(spark, tmp_path):
    spark.dataSource.register(readers.TensorFiles)
    tensor_file(tmp_path / "x.safetensors", {"net.a.weight": ("F32", [1], [1]), "net.a.bias": ("F32", [1], [2]), "net.ab": ("F16", [1], [3]), "other": ("F16", [1], [4])})
    read = lambda **o: {r["name"]: r["data"] for r in spark.read.format("tensorfile").options(**o).load(str(tmp_path)).collect()}
    assert read(prefix="net.a") == {"net.a.weight": [1.0], "net.a.bias": [2.0]}  # tensors of another kind elsewhere aren't read
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    try:
        given = spark.read.format("tensorfile").option("pushdown", True).load(str(tmp_path))
        assert given.where("name like 'net.a.%'").count() == 2 and given.where("name = 'net.a.bias'").first()["data"] == [2.0]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_floats_are_written(spark, tmp_path):
    spark.dataSource.register(readers.FloatFiles)
    values = [0.5, -1.25, 3e38, 1e-40, 7.0]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, value float").orderBy("k")
    rows.select("value").coalesce(1).write.format("floatfile").mode("append").save(str(tmp_path / "out"))
    (name,) = [p for p in (tmp_path / "out").iterdir()]
    assert name.name == "part-00000.f32" and name.read_bytes() == np.array(values, "<f4").tobytes()
    assert readers.read_raw_floats(spark, str(name), 5).count() == 5


def test_jpeg_grey_and_alpha_images(spark, tmp_path):
    """Images written by Java's codecs: a JPEG of one colour, 8 and 16 bit grey, a palette, and one with alpha."""
    java, jvm = spark._jvm.java, spark._jvm
    kind = jvm.java.awt.image.BufferedImage
    for name, form, how in (("a.jpg", "jpg", kind.TYPE_INT_RGB), ("b.png", "png", kind.TYPE_BYTE_GRAY), ("c.png", "png", kind.TYPE_INT_ARGB), ("d.png", "png", kind.TYPE_USHORT_GRAY), ("e.png", "png", kind.TYPE_BYTE_INDEXED)):
        image = kind(8, 6, how)
        for y in range(6):
            for x in range(8):
                image.setRGB(x, y, -0xFFFFFF - 1 + 0x3366CC if how != kind.TYPE_BYTE_INDEXED else -0xFFFFFF - 1 + 0x3366CC)
        jvm.javax.imageio.ImageIO.write(image, form, java.io.File(str(tmp_path / name)))
    rows = {r["image_id"].rsplit("/", 1)[-1]: r for r in readers.read_images(spark, str(tmp_path), fail_fast=False).collect()}
    assert len(rows) == 5
    for name in ("a.jpg", "c.png"):
        b, g, r = rows[name]["pixels"][:3]
        assert abs(b - 0xCC) < 4 and abs(g - 0x66) < 4 and abs(r - 0x33) < 4 and len(rows[name]["pixels"]) == 8 * 6 * 3
    assert len(set(rows["b.png"]["pixels"])) == 1
    for name in ("d.png", "e.png"):  # what the image source can't hand over as bytes of one, three or four channels is a row without pixels
        assert rows[name]["pixels"] is None or len(rows[name]["pixels"]) == 8 * 6 * 3


def test_paths_of_models(monkeypatch):
    monkeypatch.delenv(catalog.ROOT_VARIABLE, raising=False)
    assert catalog.model_root("/models/") == "/models" and catalog.model_root("/models", "/own/") == "/own"
    monkeypatch.setenv(catalog.ROOT_VARIABLE, "/from/environment")
    assert catalog.model_root("/models") == "/from/environment" and catalog.model_root("/models", "/own") == "/own"
    assert catalog.dictionary_beside("/m/rec/inference.bin") == "/m/rec/inference.yml" and catalog.dictionary_beside("x") == "inference.yml"
    assert catalog.dictionary_beside("/m/x", "/d.txt") == "/d.txt"


def test_packages_on_disk(spark, tmp_path):
    import hashlib

    for name, file, content in (("small-det", "m", b"abc"), ("small-det", "n", b""), ("small-rec", "inference.yml", b"character_dict:\n- a\n")):
        (tmp_path / name).mkdir(exist_ok=True)
        (tmp_path / name / file).write_bytes(content)
    files = spark.createDataFrame([("small-det", "m", 3, hashlib.sha256(b"abc").hexdigest()), ("small-rec", "inference.yml", 20, "other")], "name string, file string, bytes long, sha256 string")
    catalog.require_packages(spark, str(tmp_path), files.where("file = 'm'"), verify=True)
    catalog.require_packages(spark, str(tmp_path), files)
    with pytest.raises(ValueError, match="small-rec"):
        catalog.require_packages(spark, str(tmp_path), files, verify=True)
    with pytest.raises(ValueError, match="small-det"):
        catalog.require_packages(spark, str(tmp_path), files.withColumn("bytes", F.when(F.col("file") == "m", 4).otherwise(F.col("bytes"))))
    base = ["x", "--detector", "m:f", "--recognizer", "m:g", "--steps", "1", "--classes", "3", "--output", "o"]
    assert cli.arguments(base).dictionary is None and cli.arguments([*base, "--offline"]).offline
    with pytest.raises(SystemExit):
        cli.arguments([*base, "--offline", "--verify-models"])


def test_lookups_of_hot_keys(spark):
    rows = spark.createDataFrame([(1, k) for k in range(3000)] + [(k, k) for k in range(2, 1500)] + [(None, 0), (9999, 0)], "k int, v int")
    entries = spark.createDataFrame([(k, f"e{k}") for k in range(1500)], "k int, e string")
    from ocrloom.operators import joins

    assert {r["k"] for r in joins.hot_keys(rows, ["k"]).collect()} == {1}
    got = joins.looked_up(rows, entries, ["k"]).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, rows.join(entries, "k").collect()))


def test_attention_heads_and_permutations(spark):
    rng = np.random.default_rng(3)
    q, k, v = (rng.normal(size=(5, 2 * 3)) for _ in range(3))
    got = one(spark, t.attention(array(q.ravel()), array(k.ravel()), array(v.ravel()), 5, 3, 2))
    wanted = np.zeros((5, 6))
    for h in (slice(0, 3), slice(3, 6)):
        s = q[:, h] @ k[:, h].T / math.sqrt(3)
        p = np.exp(s - s.max(1, keepdims=True))
        wanted[:, h] = p / p.sum(1, keepdims=True) @ v[:, h]
    assert got == pytest.approx(wanted.ravel())
    x = np.arange(24.0)
    for axes in ((0, 1, 2), (2, 0, 1), (1, 2, 0), (2, 1, 0)):
        assert one(spark, t.permute(array(x), (2, 3, 4), axes)) == x.reshape(2, 3, 4).transpose(axes).ravel().tolist()
    with pytest.raises(ValueError):
        t.permute(array(x), (2, 3, 4), (0, 0, 1))


def test_the_flow_against_a_walk_over_images(spark):
    """The flow with stand-ins for its models against plain loops over each image's own arrays."""
    from ocrloom.plans import queries
    from ocrloom.plans.pipeline import OcrPipeline, PipelineOptions

    sf = "/root/testdata/sf0.001"
    options = PipelineOptions(736, detections.DetectionOptions(binary_threshold=0.6, box_threshold=0.6))
    images = queries._synthetic_images(spark, sf).where("image_id < 12")
    rows = {r["image_id"]: r for r in OcrPipeline(queries._bright, queries._stripes, ["a", "b", "c"], 8, 4, options).transform(images).collect()}
    for image in images.collect():
        w, h = image["width"], image["height"]
        pixels = np.frombuffer(image["pixels"], np.uint8).reshape(h, w, 3).astype(float)
        row = rows[image["image_id"]]
        iw, ih = row["detector_input_size"]
        whole = np.array([[0, 0], [w, 0], [w, h], [0, h]], float)
        plane = preprocess.canvas(pixels, whole, ih, iw, iw, preprocess.DETECTOR_MEAN, preprocess.DETECTOR_STD)[0].astype(np.float32).astype(float)
        heat = 1 / (1 + np.exp(-plane))
        seen, boxes = np.zeros(heat.shape, bool), []
        for y0 in range(ih):
            for x0 in range(iw):
                if heat[y0, x0] >= 0.6 and not seen[y0, x0]:
                    todo, cells = [(y0, x0)], []
                    seen[y0, x0] = True
                    while todo:
                        y, x = todo.pop()
                        cells.append((y, x))
                        for v in range(max(0, y - 1), min(ih, y + 2)):
                            for u in range(max(0, x - 1), min(iw, x + 2)):
                                if heat[v, u] >= 0.6 and not seen[v, u]:
                                    seen[v, u] = True
                                    todo.append((v, u))
                    if len(cells) >= options.detection.min_area and np.mean([heat[c] for c in cells]) >= 0.6:
                        boxes.append((np.mean([heat[c] for c in cells]), len(cells)))
        assert len(row["lines"]) == len(boxes)
        assert sorted(x["detection_score"] for x in row["lines"]) == pytest.approx(sorted(b[0] for b in boxes))
        for line in row["lines"]:
            polygon = np.array([list(p) for p in line["polygon"]])
            width = line["recognition_score"]
            assert 0 <= width <= 1 and set(line["text"]) <= set("abc") and polygon.shape == (4, 2)


def test_raw_floats(spark, tmp_path):
    values = [0.0, -1.5, 3.1415927, 1e-40, float("inf")]
    (tmp_path / "x.bin").write_bytes(np.array(values, "<f4").tobytes())
    got = [r["value"] for r in readers.read_raw_floats(spark, str(tmp_path / "x.bin"), 5).orderBy("i").collect()]
    assert np.array(got, np.float32).tobytes() == np.array(values, np.float32).tobytes()
    with pytest.raises(Exception, match="expected number"):
        readers.read_raw_floats(spark, str(tmp_path / "x.bin"), 4).collect()


def test_dictionaries(spark, tmp_path):
    (tmp_path / "plain.txt").write_text("﻿a\nb\r\n c\n", newline="")
    assert [r["token"] for r in readers.read_dictionary(spark, str(tmp_path / "plain.txt")).orderBy("class_id").collect()] == ["a", "b", " c"]
    (tmp_path / "empty.txt").write_text("a\n\nb\n")
    with pytest.raises(Exception, match="empty entry"):
        readers.read_dictionary(spark, str(tmp_path / "empty.txt")).collect()
    with pytest.raises(Exception, match="unterminated"):
        one(spark, txt.yaml_scalar(F.lit("'x")))


def test_catalog(spark, tmp_path):
    models = {"models": [{"name": "tiny-det", "repository": "r", "revision": "v", "files": [{"name": "m", "bytes": 3, "sha256": "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"}]}]}
    (tmp_path / "models.json").write_text(json.dumps(models, indent=1))
    files = readers.read_catalog(spark, str(tmp_path / "models.json"))
    contents = spark.createDataFrame([("tiny-det", "m", b"abc")], "name string, file string, content binary")
    assert catalog.verified(files, contents).first()["valid"]
    assert not catalog.verified(files, contents.where("false")).first()["valid"]
    listing = contents.select("name", "file", F.length("content").alias("length"))
    marks = catalog.manifest_fingerprints(files)
    assert catalog.cache_status(files, listing, marks).first()["complete"]
    assert not catalog.cache_status(files, listing, marks.where("false")).first()["complete"]
    assert catalog.model_name("detector", "tiny") == "tiny-det"
    with pytest.raises(ValueError, match="unknown"):
        catalog.model_name("x", "tiny")
    for name in ("..", "a/b", ""):
        with pytest.raises(Exception, match="plain file name"):
            one(spark, catalog.checked_component(F.lit(name)))


def test_the_generator_is_the_recurrence(spark):
    state, wanted = readers.LCG_SEED, []
    for _ in range(100):
        state = (state * readers.LCG_A + readers.LCG_C) % 2**32
        wanted.append((state >> 8) / 0xFFFFFF * 2 - 1)
    assert [r["value"] for r in readers.generated_inputs(spark, 100).orderBy("i").collect()] == pytest.approx(wanted)


def test_options_are_checked():
    for wrong in ({"binary_threshold": 2.0}, {"min_area": 0}, {"unclip_ratio": 0.0}, {"max_boxes": 0}, {"box_threshold": math.nan}):
        with pytest.raises(ValueError):
            detections.DetectionOptions(**wrong)


def test_results_are_written(spark, tmp_path):
    rows = spark.createDataFrame([(1, [("x",), ("",), ("y",)])], "image_id int, lines array<struct<text: string>>")
    readers.write_results(rows, str(tmp_path / "text"), "text")
    assert [r["value"] for r in spark.read.text(str(tmp_path / "text")).collect()] == ["x", "y"]
    readers.write_results(rows, str(tmp_path / "json"), "json")
    assert spark.read.json(str(tmp_path / "json")).count() == 1
    assert cli.arguments(["a", "--detector", "m:d", "--recognizer", "m:r", "--dictionary", "d", "--steps", "1", "--classes", "2", "--output", "o"]).max_boxes == 1000


def test_arrivals_are_transformed(spark, tmp_path):
    spark.createDataFrame([(1, 2, 1, [0.9, 0.9])], "image_id long, width int, height int, values array<double>").write.parquet(str(tmp_path / "in"))
    options = detections.DetectionOptions(min_area=1)
    incoming.run_on_arrival(spark, str(tmp_path / "in"), "image_id long, width int, height int, values array<double>", lambda df: detections.extract_detections(df, options), str(tmp_path / "out"), str(tmp_path / "at")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_a_convolution_sums_each_cell_once(spark):
    """However often the activation names its argument; strides, padding on one side and several channels beside it."""
    out = t.conv2d_layer(array(range(24)), [[[[1.0, 2.0]], [[0.5, 0.0]]]], [1.0], 3, 4, (2, 3), (0, 1, 1, 0), lambda x: x * x - x * x + x)
    plain, planes = one(spark, out), np.arange(24.0).reshape(2, 3, 4)
    wide = np.pad(planes, ((0, 0), (0, 1), (1, 0)))
    assert plain == [1 + wide[0, y, x] + 2 * wide[0, y, x + 1] + 0.5 * wide[1, y, x] for y in (0, 2) for x in (0, 3)]
    assert spark.range(1).select(out.alias("x"))._jdf.queryExecution().analyzed().toString().count("aggregate(") == 1


def test_joined_texts_in_tasks_are_those_of_the_columns(spark):
    """Nulls, short parts, ends over several parts, null groups; and pieces of a text longer than a stretch."""
    cases = [["abc", "bcd", "d", "", "dd"], ["x" * 40, "x" * 50], [None, "a"], ["a", None], [""], ["ab", "a", "b", "abx"], ["日本", "本語"], ["ab" * 20, "ba" * 3]]
    rows = [(k if k else None, o, x, 0.25 * o) for k, own in enumerate(cases) for o, x in enumerate(own)]
    parts = spark.createDataFrame(rows, "g long, o int, text string, score double")
    wanted = parts.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("o", "text", "score"))).alias("p")).select("g", txt.joined(F.col("p")).alias("j")).select("g", "j.text", "j.score")
    found = recognition.join_decoded(parts, "g", "o")
    assert sorted(map(repr, found.collect())) == sorted(map(repr, wanted.collect()))
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()
    text = "".join(chr(97 + k * k % 26) + "é" * (k % 3) for k in range(50_000))
    for length in (0, 1, 60, 61, 100, 101, 1_300, 41_000, len(text)):
        last = max(-(-(length - 60) // 40), 0)
        assert one(spark, txt.pieces(F.lit(text[:length]), 60, 40)) == [text[:length][k * 40 : k * 40 + 60] for k in range(last + 1)]


def test_canvases_are_the_plain_arithmetic_in_floats_of_their_column(spark):
    """Crops that reach beyond the image too; none is made in doubles that are thrown away."""
    rng = np.random.default_rng(5)
    mean, std = preprocess.DETECTOR_MEAN, preprocess.DETECTOR_STD
    for w, h, content in ((1, 1, 3), (7, 5, 40), (30, 20, 64)):
        pixels, corners = rng.integers(0, 256, (h, w, 3)).astype(float), rng.random((4, 2)) * [w * 1.3, h * 1.3] - 2
        got = preprocess.canvas(pixels, corners, 12, content, 64, mean, std)
        assert got.dtype == np.float32 and not got[:, :, content:].any()
        u, v = (np.arange(content) + 0.5) / content, ((np.arange(12) + 0.5) / 12)[:, None]
        px, py = (np.clip((corners[0][c] + (corners[1][c] - corners[0][c]) * u) * (1 - v) + (corners[3][c] + (corners[2][c] - corners[3][c]) * u) * v - 0.5, 0, m - 1) for c, m in ((0, w), (1, h)))
        x, y = px.astype(int), py.astype(int)
        right, below, fx, fy = np.minimum(x + 1, w - 1), np.minimum(y + 1, h - 1), (px - x)[..., None], (py - y)[..., None]
        top, bottom = (pixels[r, x] * (1 - fx) + pixels[r, right] * fx for r in (y, below))
        value = np.clip(np.floor(top * (1 - fy) + bottom * fy + 0.5), 0, 255)
        assert (got[:, :, :content] == ((value / 255 - np.array(mean)) / np.array(std)).transpose(2, 0, 1).astype(np.float32)).all()
