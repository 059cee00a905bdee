"""Toxicity by compression distance: windows of a text are compressed with an ordinary and a toxic zstandard dictionary.

Fit, on a bounded sample of labelled rows (MAX_TOXIC and MAX_ORDINARY documents, read whole), of which every third
calibrates and gives nothing to the dictionaries:

1. Character runs that occur far more often in a toxic document than in an ordinary one are the toxic text, those that
   begin a word apart from others; a zstandard dictionary is trained on the parts of words that they cover, and another
   on windows of ordinary documents. (Dictionaries of whole toxic windows hold mostly the ordinary words in them, and the
   lengths that they give hardly tell the two kinds apart; the README has figures.)
2. Both compressors begin with the ordinary dictionary; the toxic one has the toxic dictionary behind it, the other as
   many empty bytes. So ordinary text compresses alike, and a window's saving is what the toxic dictionary gives.
3. On the calibrating documents, each saving gets the logarithm of how much more often windows of toxic documents have it.
   The sum over a document's windows is its distance; the threshold is the one that parts these documents best, a false
   alarm counted FALSE_ALARM times a miss.

The sample is cut, counted and compressed on the executors: the driver gets runs that pass, a bounded number of windows,
and a line of counts for each calibrating document. Scoring needs no shuffle: dictionaries and calibration, some
kilobytes, go with the tasks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import log1p
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, sliced, trimmed

#: Bounds of the fit: labelled documents of each kind, and windows of ordinary ones for their dictionary.
MAX_TOXIC, MAX_ORDINARY, MAX_WINDOWS = 2_000, 9_000, 50_000
#: Runs, and parts of words that they cover, at most: the most frequent ones.
MAX_RUNS, MAX_PARTS = 5_000, 20_000
#: One of so many sampled documents calibrates.
CALIBRATE = 3
#: Characters of a run; how much more often it occurs in toxic documents, how surely, and how many of these hold it.
RUN, TIMES, DEVIATIONS, LEAST = 5, 8, 8, 3
WINDOW, TRAIN_WINDOW = 16, 12
ORDINARY_BYTES, TOXIC_BYTES = 8192, 2048
LEVEL, MIN_MATCH = 12, 3
#: Savings are counted from LOW to LOW + SAVINGS - 1 bytes, those beyond with the outermost.
LOW, SAVINGS = -5, 21
FALSE_ALARM = 4.0


def windows(text: str, n: int = WINDOW) -> list[bytes]:
    """The words of a text, n to a window, each behind a space: so a dictionary can tell how words begin."""
    words = text.lower().encode().split()
    return [b"".join(b" " + w for w in words[i : i + n]) for i in range(0, max(1, len(words)), n)]


def word_runs(word: str) -> list[str]:
    """Runs of RUN characters; the one that begins the word has a space before it."""
    return [" " + word[:RUN], *(word[i : i + RUN] for i in range(1, len(word) - RUN + 1))]


def runs(text: str) -> Counter:
    return Counter(r for w in text.lower().split() for r in word_runs(w))


def run_sums(rows: Iterator[tuple[bool, str]]) -> dict[str, list[float]]:
    """Of each run, for ordinary and for toxic documents: how many hold it, and the sum and the squares' sum of log(1 + occurrences).

    A document's occurrences count by their logarithm, so a word of toxic texts that ordinary ones hold now and then is
    told by how often it comes, and no single document decides.
    """
    out: dict[str, list[float]] = {}
    for toxic, text in rows:
        for r, k in runs(text).items():
            own = out.setdefault(r, [0.0] * 6)
            v, at = log1p(k), 3 * toxic
            own[at] += 1
            own[at + 1] += v
            own[at + 2] += v * v
    return out


_SUMS = ("o_n", "o_sum", "o_square", "t_n", "t_sum", "t_square")


def clear(toxic: int, ordinary: int) -> Column:
    """Whether a run with these sums occurs TIMES as often in a toxic document as in an ordinary one, and more often by DEVIATIONS standard deviations."""
    n, m = float(toxic), float(ordinary)
    a, b = F.col("t_sum") / n, F.col("o_sum") / m
    both = (F.col("t_sum") + F.col("o_sum")) / (n + m)
    spread = F.greatest((F.col("t_square") + F.col("o_square")) / (n + m) - both * both, F.lit(0.0))
    sure = a - b >= DEVIATIONS * F.sqrt(spread * (1 / n + 1 / m) + 1e-12)
    return (F.col("t_n") >= min(LEAST, toxic)) & sure & (a >= TIMES * (b + 0.5 / m))


def segments(word: str, chosen: set[str]) -> list[str]:
    """The parts of a word that chosen runs cover; the one that begins it has a space before it."""
    whole = " " + word
    on = bytearray(len(whole))
    for i, r in enumerate(word_runs(word)):
        if r in chosen:
            i += i > 0
            on[i : i + len(r)] = b"\1" * len(r)
    parts = "".join(c if x else "\n" for c, x in zip(whole, on, strict=True)).split("\n")
    return [p for p in parts if p]


def trained(size: int, samples: list[bytes], **how: int) -> bytes:
    """A dictionary trained on samples; where they are too few to train on, their distinct text."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples, **how).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(dict.fromkeys(samples))[-size:]


def compressor(raw: bytes):
    import zstandard

    if len(raw) < 8:
        raw = raw + bytes(8)
    how = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=100, dict_size=len(raw), min_match=MIN_MATCH, write_content_size=False, write_checksum=False, write_dict_id=False)
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how)


class Dictionaries:
    """The two compressors, trained on counted parts of toxic words and on ordinary windows; the order of neither matters."""

    def __init__(self, parts: dict[str, int], ordinary: list[bytes]):
        rare_first = sorted(parts.items(), key=lambda x: (x[1], x[0]))
        # samples of eight parts each in a shuffled order, so that no two parts stand together more often than others
        found = [p for p, k in rare_first for _ in range(k)]
        Random(0).shuffle(found)
        each = ["".join(found[i : i + 8]).encode() for i in range(0, len(found), 8)]
        once = ["".join(p for p, _ in rare_first[i : i + 6]).encode() for i in range(0, len(rare_first), 6)]
        own = trained(TOXIC_BYTES, each + once * 3, k=12, d=6)
        base = trained(ORDINARY_BYTES, sorted(ordinary))
        self.plain, self.toxic = base + bytes(len(own)), base + own

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "compressors"}

    def savings(self, text: str) -> np.ndarray:
        """How many windows of the text save LOW, LOW + 1, ... bytes."""
        if "compressors" not in self.__dict__:
            self.compressors = compressor(self.plain), compressor(self.toxic)
        plain, toxic = self.compressors
        v = np.array([len(plain.compress(w)) - len(toxic.compress(w)) for w in windows(text)])
        return np.bincount(np.clip(v - LOW, 0, SAVINGS - 1), minlength=SAVINGS)


class Classifier:
    """What a fit gives: the dictionaries, each saving's weight, the threshold. Without labels of both kinds, their share is the score."""

    def __init__(self, share: float, dictionaries: Dictionaries | None = None, counts: np.ndarray | None = None, toxic: np.ndarray | None = None):
        self.share, self.dictionaries = share, dictionaries
        if dictionaries is not None:
            self.calibrate(counts, toxic)

    def calibrate(self, counts: np.ndarray, toxic: np.ndarray) -> None:
        sums = [counts[toxic == k].sum(0) + 1.0 for k in (True, False)]
        self.weights = np.log(sums[0] / sums[0].sum()) - np.log(sums[1] / sums[1].sum())
        distance = counts @ self.weights
        order = np.sort(np.unique(distance))
        edges = (order[1:] + order[:-1]) / 2 if len(order) > 1 else order
        caught = np.array([(distance[toxic] >= e).mean() if toxic.any() else 0.0 for e in edges])
        alarms = np.array([(distance[~toxic] >= e).mean() if (~toxic).any() else 0.0 for e in edges])
        self.threshold = float(edges[int(np.argmax(caught - FALSE_ALARM * alarms))])
        self.scale = max(1.0, float(np.abs(distance - self.threshold).mean()))

    def score(self, text: str) -> float:
        if self.dictionaries is None:
            return self.share
        distance = float(self.dictionaries.savings(text) @ self.weights)
        return float(1 / (1 + np.exp(-np.clip((distance - self.threshold) / self.scale, -30, 30))))


def held_out(id_col: str, folds: int = 5) -> Column:
    """Rows that give no labels: crc32 of the id as text, modulo folds, is 0. A null id is none of them."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == 0, F.lit(False))


def sampled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, toxic, calibrates, t: labelled documents that aren't held out, at most MAX_TOXIC and MAX_ORDINARY in the order of a hash.

    One row for each id, brought together on the executors: of rows that share an id the first text counts.
    """
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic")).where(~held_out("doc_id"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = marks.where("toxic").orderBy(*order).limit(MAX_TOXIC).unionByName(marks.where("not toxic").orderBy(*order).limit(MAX_ORDINARY))
    # the sample's ids are bounded by the two limits
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).join(F.broadcast(chosen), "doc_id")
    calibrates = F.pmod(F.xxhash64(F.lit("calibrate"), "doc_id"), F.lit(CALIBRATE)) == 0
    return cut(rows.groupBy("doc_id", "toxic").agg(F.min("t").alias("t")).withColumn("calibrates", calibrates))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Classifier:
    sample = sampled(docs, labels, id_col, text_col)
    n = {(r["calibrates"], r["toxic"]): r["count"] for r in sample.groupBy("calibrates", "toxic").count().collect()}
    share = sum(k for (_, toxic), k in n.items() if toxic) / max(1, sum(n.values()))
    if any((part, toxic) not in n for part in (False, True) for toxic in (False, True)):
        if len({toxic for _, toxic in n}) < 2:
            return Classifier(share)
        # too few of a kind to set some apart: all of them do both
        sample = sample.withColumn("calibrates", F.lit(None).cast("boolean"))
        n = {(False, toxic): sum(k for (_, x), k in n.items() if x == toxic) for toxic in (False, True)}
    fits = sample.where("not coalesce(calibrates, false)")

    @trimmed
    def count_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = run_sums(zip(batch.column("toxic").to_pylist(), batch.column("t").to_pylist(), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), *(pa.array([v[k] for v in found.values()], pa.float64()) for k in range(6))], names=["run", *_SUMS])

    sums = fits.select("toxic", "t").mapInArrow(count_runs, "run string, " + ", ".join(f"{c} double" for c in _SUMS)).groupBy("run").agg(*[F.sum(c).alias(c) for c in _SUMS])
    passing = sums.where(clear(n[False, True], n[False, False])).orderBy(F.col("t_sum").desc(), "run").limit(MAX_RUNS)
    chosen = {r["run"] for r in passing.select("run").collect()}

    def count_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = Counter(p for x in batch.column("t").to_pylist() for w in x.lower().split() for p in segments(w, chosen))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["part", "n"])

    counted = fits.where("toxic").select("t").mapInArrow(count_parts, "part string, n long").groupBy("part").agg(F.sum("n").alias("n"))
    parts = {r["part"]: r["n"] for r in counted.orderBy(F.col("n").desc(), "part").limit(MAX_PARTS).collect()}

    def cut_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([w for x in batch.column("t").to_pylist() for w in windows(x, TRAIN_WINDOW) if w], pa.binary())], names=["w"])

    some = fits.where("not toxic").select("t").mapInArrow(cut_windows, "w binary").orderBy(F.xxhash64("w"), "w").limit(MAX_WINDOWS)
    dictionaries = Dictionaries(parts, [bytes(r["w"]) for r in some.collect()])

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [dictionaries.savings(x).tolist() for x in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(counts, pa.list_(pa.int64()))], names=["toxic", "counts"])

    rows = sample.where("coalesce(calibrates, true)").select("toxic", "t").mapInArrow(compress, "toxic boolean, counts array<long>").collect()
    return Classifier(share, dictionaries, np.array([r["counts"] for r in rows]), np.array([r["toxic"] for r in rows]))


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, held_out, score (0 to 1) and predicted (1 from 0.5 on).

    Null and empty texts are scored like a window without savings. Repeated rows get equal scores. Without labels of both
    kinds every score is the share of toxic labels (0 without any). Labels that are null, or of ids without a document,
    don't count; of two labels of an id the toxic one counts, and of rows that share an id one text. An empty docs gives
    no rows; further columns are left out. Texts are compressed whole, in windows.
    """
    model = fit(docs, labels, id_col, text_col)

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for whole in batches for x in sliced(whole, "t")):
            scores = [model.score(x or "") for x in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("i"), batch.column("h"), pa.array(scores, pa.float64())], names=[id_col, "held_out", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(F.col(id_col).alias("i"), held_out(id_col).alias("h"), F.col(text_col).alias("t")).mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents that toxicity_scores() predicts to be toxic; whole rows, in one pass over the texts."""
    model = fit(docs, labels, id_col, text_col)

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for whole in batches for x in sliced(whole, text_col)):
            yield batch.filter(pa.array([model.score(x or "") < 0.5 for x in batch.column(place).to_pylist()], pa.bool_()))

    place = docs.columns.index(text_col)
    return docs.mapInArrow(run, docs.schema)
