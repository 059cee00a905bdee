"""Quality rules: counts of a text's words, signs, lines and repeats, and a hashed n-gram log-likelihood ratio.

The ratio compares two multinomials over hashed word 1-grams and 2-grams: the trusted target (documents whose label says
good quality, at most MAX_TRUSTED of them in the order of a hash) and the raw corpus (all documents). A document's
score is the mean log ratio over its n-grams, so length doesn't matter; it is kept from THRESHOLD on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, split_words, strings

#: Buckets of the multinomials, as a power of two: their number bounds the model.
BUCKET_BITS = 16
MAX_TRUSTED = 20_000
#: Prior counts of a bucket in the corpus; the target has its share of them.
SMOOTHING = 2.0
THRESHOLD = -0.12
REPEAT_WINDOW = 5
_MIX, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of the values of each text."""
    sums = np.concatenate((np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values)))
    return sums[offsets[1:]] - sums[offsets[:-1]]


def word_hashes(words: pa.Array) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words.to_pylist()), np.uint64, len(words))


def buckets(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the 1-grams of all words, and of the 2-grams that begin at all but the last; a 2-gram over two texts has bucket -1."""
    shift = np.uint64(64 - BUCKET_BITS)
    one = ((hashes * _MIX) >> shift).astype(np.int64)
    two = (((hashes[:-1] * _MIX2 + hashes[1:]) * _MIX) >> shift).astype(np.int64)
    two[doc[1:] != doc[:-1]] = -1
    return one, two


def repeated_words(codes: np.ndarray, doc: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Of each text, the words that lie in a window of REPEAT_WINDOW words found twice or more in it.

    Windows are compared by a 64-bit hash of their words; two that differ agree by chance once in 2**64 pairs.
    """
    n, w = len(codes), REPEAT_WINDOW
    if n < w:
        return np.zeros(len(offsets) - 1, np.int64)
    with np.errstate(over="ignore"):
        value = (codes.astype(np.uint64) + np.uint64(1)) * _MIX
        value ^= value >> np.uint64(29)
        key = doc[: n - w + 1].astype(np.uint64) * _MIX2
        for k in range(w):
            key = (key ^ (key >> np.uint64(31))) * _MIX + value[k : n - w + 1 + k]
    inside = doc[: n - w + 1] == doc[w - 1 :]
    at = np.flatnonzero(inside)
    order = np.argsort(key[at], kind="stable")
    ranked = key[at][order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(n + 1, np.int64)
    starts = at[twice]
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + w, -1)
    return per_text((np.cumsum(edge)[:-1] > 0).astype(np.int64), offsets)


def duplicate_lines(texts: pa.Array) -> np.ndarray:
    lists = pc.split_pattern(texts, "\n")
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets -= offsets[0]
    lines = lists.flatten().dictionary_encode()
    with_word = pc.not_equal(pc.ascii_trim_whitespace(lines.dictionary), "").to_numpy(zero_copy_only=False)
    codes = lines.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
    on = with_word[codes] if len(codes) else np.zeros(0, bool)
    once = np.unique(doc[on] * (len(with_word) + 1) + codes[on]) // (len(with_word) + 1)
    return np.bincount(doc[on], minlength=len(texts)) - np.bincount(once, minlength=len(texts))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(1 << BUCKET_BITS, np.int64), np.zeros(1 << BUCKET_BITS, np.int64)
    for whole in batches:
        for batch in sliced(whole, "t"):
            codes, offsets, words = split_words(batch.column("t"))
            if not len(codes):
                continue
            doc = np.repeat(np.arange(len(batch)), np.diff(offsets))
            trusted = batch.column("good").to_numpy(zero_copy_only=False)[doc]
            with np.errstate(over="ignore"):
                one, two = buckets(word_hashes(words)[codes], doc)
            raw += np.bincount(one, minlength=len(raw)) + np.bincount(two[two >= 0], minlength=len(raw))
            target += np.bincount(one[trusted], minlength=len(raw)) + np.bincount(two[(two >= 0) & trusted[:-1]], minlength=len(raw))
    at = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])


def log_ratios(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> np.ndarray:
    """log p(bucket | trusted) - log p(bucket | corpus) of every bucket, from counts over all documents."""
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q > 0").orderBy(*order).limit(MAX_TRUSTED).select("doc_id", F.lit(True).alias("good"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")).join(F.broadcast(good), "doc_id", "left").select("t", F.coalesce("good", F.lit(False)).alias("good"))
    counts = rows.mapInArrow(_counts, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.zeros(1 << BUCKET_BITS), np.zeros(1 << BUCKET_BITS)
    raw[counts.bucket], target[counts.bucket] = counts.raw, counts.target
    if not target.sum():  # no trusted documents: nothing tells the two apart
        return np.zeros(1 << BUCKET_BITS)
    # both get prior counts in the same proportion, so a bucket of which little is known says little at any size of the data
    part = target.sum() / raw.sum()
    return np.log(target / part + SMOOTHING) - np.log(raw + SMOOTHING)


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, llr.

    Null and empty texts have no words: all counts 0, llr 0, base_failed true. Repeated rows get equal results; ties at the
    threshold are kept. Without trusted labels llr is 0 for all. An empty table gives no rows; further columns are left out.
    """
    ratios = log_ratios(docs, labels, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, "t"):
                texts = strings(batch.column("t"))
                codes, offsets, words = split_words(texts)
                doc = np.repeat(np.arange(len(batch)), np.diff(offsets))
                n = np.diff(offsets)
                lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
                if len(codes):
                    with np.errstate(over="ignore"):
                        one, two = buckets(word_hashes(words)[codes], doc)
                    gain = ratios[one]
                    gain[:-1] += np.where(two >= 0, ratios[two], 0)
                    total, chars = per_text(gain, offsets), per_text(lengths[codes], offsets)
                else:
                    total, chars = np.zeros(len(batch)), np.zeros(len(batch), np.int64)
                llr = np.round(total / np.maximum(1, 2 * n - 1), 9)
                repeat = repeated_words(codes, doc, offsets)
                failed = (n < 10) | (100 * repeat > 20 * n)
                symbols = pc.count_substring_regex(texts, "[#*$%&|<>]").cast(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("i"), pa.array(n), pa.array(chars), symbols, pa.array(duplicate_lines(texts)), pa.array(repeat), pa.array(failed), pa.array(~failed & (llr >= threshold)), pa.array(llr)],
                    names=[id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, llr double"
    return docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInArrow(run, schema)
