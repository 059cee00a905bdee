"""Model packages as tables: catalog, paths, cache state, digests, fingerprints."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds and sizes of models, and the recognizers' classes.
KINDS = {"det": "det", "detector": "det", "rec": "rec", "recognizer": "rec"}
SIZES = ("medium", "small", "tiny")
CLASSES = {"medium": 18_710, "small": 18_710, "tiny": 6_906}


def model_name(kind: str, size: str) -> str:
    if kind.lower() not in KINDS:
        raise ValueError(f"unknown model kind {kind!r}")
    if size.lower() not in SIZES:
        raise ValueError(f"unknown model size {size!r}")
    return f"{size.lower()}-{KINDS[kind.lower()]}"


def catalog_files(models: DataFrame) -> DataFrame:
    """A row for each file of a catalog read as JSON: name, repository, revision, place, file, bytes, sha256."""
    rows = models.select(F.explode("models").alias("m")).select("m.name", "m.repository", "m.revision", F.posexplode("m.files").alias("place", "f"))
    return rows.select("name", "repository", "revision", "place", F.col("f.name").alias("file"), F.col("f.bytes").alias("bytes"), F.col("f.sha256").alias("sha256"))


def checked_component(name: Column) -> Column:
    """A file name that is one plain path component; any other is an error."""
    plain = (F.length(name) > 0) & ~name.isin(".", "..") & ~name.rlike(r"[/\\\x00]")
    return F.when(plain, name).otherwise(F.raise_error(F.concat(F.lit("not a plain file name: "), name)))


def asset_path(root: str, name: Column, file: Column) -> Column:
    return F.concat_ws("/", F.lit(root.rstrip("/")), name, checked_component(file))


def little_endian(n: Column) -> Column:
    """A long as eight bytes, the lowest first."""
    digits = F.lpad(F.hex(n), 16, "0")
    return F.unhex(F.concat(*[F.substring(digits, 15 - 2 * k, 2) for k in range(8)]))


def manifest_fingerprints(files: DataFrame) -> DataFrame:
    """name and SHA-256 of name, repository, revision, and each file's name, size and digest in order, with zero bytes between."""
    zero = F.unhex(F.lit("00"))
    part = F.concat(zero, F.col("file").cast("binary"), zero, little_endian(F.col("bytes")), F.col("sha256").cast("binary"))
    rows = files.groupBy("name", "repository", "revision").agg(F.array_sort(F.collect_list(F.struct("place", F.hex(part).alias("part")))).alias("parts"))
    head = F.concat(F.col("name").cast("binary"), zero, F.col("repository").cast("binary"), zero, F.col("revision").cast("binary"))
    whole = F.concat(head, F.unhex(F.array_join(F.transform("parts", lambda x: x["part"]), "")))
    return rows.select("name", F.sha2(whole, 256).alias("fingerprint"))


def cache_status(files: DataFrame, listing: DataFrame, markers: DataFrame) -> DataFrame:
    """name and complete: the marker (name, fingerprint) is the manifest's and every file has its length.

    listing: name, file, length; only names and lengths are read, so a scan of binary files leaves contents where they are.
    """
    sized = files.join(listing.select("name", "file", F.col("length").alias("found")), ["name", "file"], "left").groupBy("name").agg(F.bool_and(F.coalesce(F.col("found") == F.col("bytes"), F.lit(False))).alias("sized"))
    marked = manifest_fingerprints(files).join(markers.select("name", F.col("fingerprint").alias("marker")), "name", "left")
    return sized.join(marked, "name").select("name", (F.col("sized") & F.coalesce(F.col("marker") == F.col("fingerprint"), F.lit(False))).alias("complete"))


def verified(files: DataFrame, contents: DataFrame) -> DataFrame:
    """name and valid: every file is there with its length and SHA-256. contents: name, file, content."""
    seen = contents.select("name", "file", F.length("content").alias("found"), F.sha2("content", 256).alias("digest"))
    ok = F.coalesce((F.col("found") == F.col("bytes")) & (F.col("digest") == F.col("sha256")), F.lit(False))
    return files.join(seen, ["name", "file"], "left").groupBy("name").agg(F.bool_and(ok).alias("valid"), F.count_if(~ok).alias("bad_files"))


#: The environment variable that names another root of model packages.
ROOT_VARIABLE = "OCRLOOM_MODELS"
#: The recognizer's dictionary, where no other is given, stands beside its model file under this name.
DICTIONARY_FILE = "inference.yml"


def model_root(default: str, given: str | None = None) -> str:
    """Where packages lie: the folder given, or else the environment's, or else default."""
    return (given or os.environ.get(ROOT_VARIABLE) or default).rstrip("/") or "/"


def dictionary_beside(model_file: str, given: str | None = None) -> str:
    """A recognizer's dictionary: the file given, or that beside the model file."""
    if given:
        return given
    folder, slash, _ = model_file.rpartition("/")
    return f"{folder}{slash}{DICTIONARY_FILE}"


def resolved(root: str, files: DataFrame, listing: DataFrame) -> DataFrame:
    """name, file and path of each file of a catalog; path is null where the listing (name, file, length) lacks the file or
    has it with another length."""
    seen = listing.select("name", "file", F.col("length").alias("found"))
    return files.join(seen, ["name", "file"], "left").select("name", "file", F.when(F.col("found") == F.col("bytes"), asset_path(root, F.col("name"), F.col("file"))).alias("path"))


def package_files(spark: SparkSession, root: str) -> DataFrame:
    """name, file, length, content of the files of the packages below root; content is read only where it is asked for."""
    files = spark.read.format("binaryFile").load(f"{root.rstrip('/')}/*/*")
    parts = F.split("path", "/")
    return files.select(F.element_at(parts, -2).alias("name"), F.element_at(parts, -1).alias("file"), "length", "content")


def require_packages(spark: SparkSession, root: str, files: DataFrame, verify: bool = False) -> None:
    """An error that names the packages of a catalog that root lacks: files missing or of another length, with verify also of
    another digest. The two are the offline and the verifying access; there is no download."""
    listing = package_files(spark, root)
    if verify:
        state = verified(files, listing).select("name", F.col("valid").alias("ok"))
    else:
        state = resolved(root, files, listing).groupBy("name").agg(F.bool_and(F.col("path").isNotNull()).alias("ok"))
    bad = [r["name"] for r in state.where("not ok").orderBy("name").collect()]
    if bad:
        raise ValueError(f"model packages not complete below {root}: {', '.join(bad)}")


def missing_files(files: DataFrame, listing: DataFrame) -> DataFrame:
    return files.join(listing, ["name", "file"], "left_anti").select("name", "file")
