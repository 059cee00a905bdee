"""Benchmark decontamination: word n-grams of the test items seed alignments that score copies, edited ones too.

1. Words are runs of letters and digits in lower case; of scripts that don't part words, each character is one. Every
   n-gram of an item is a seed: none is left out for its count, because the n-grams that an edit made are the rarest, and
   those of a passage copied often are not rare.
2. Places where a document's seeds point at nearly the same stretch share a window. A window that holds too few of the
   item's words to reach the threshold, whatever their order, is passed over: no alignment scores more than its words.
3. The others are aligned with the item (Smith-Waterman over words).

Items are dealt by a hash into blocks of about BLOCK_WORDS words; a block's items go with the tasks, and its size is
checked before. Each block meets all documents in a pass of its own, and where there are several, a block's matches are
written before the next is read. Documents don't move: the pass is narrow, and no text is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, sliced, split_words, strings, trimmed, written

NGRAM = 3
#: Words of the items of a block, about: their n-grams, as numbers, take some tens of MB of a task.
BLOCK_WORDS = 1 << 19
#: Bits of a word's number in that of an n-gram; numbers begin at 1, so that shorter n-grams have numbers of their own.
WORD_BITS = 21
#: Places and words of windows that a task looks at at once, or those of one document.
AT_ONCE = 1 << 19
#: Bytes of text whose words are numbers at once.
SLICE = 2 << 20
MATCH, MISMATCH, GAP = 2, -1, -1
#: Share of the item's full score from which an alignment counts as a copy.
THRESHOLD = 0.5
_SIGNS = r"[^\p{L}\p{N}\p{M}]+"
#: Scripts that put no space between words.
_UNPARTED = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]"


def plain_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """split_words() of the texts in lower case with all signs but letters and digits turned into spaces."""
    texts = pc.replace_substring_regex(pc.utf8_lower(strings(texts)), _SIGNS, " ")
    if pc.any(pc.match_substring_regex(texts, _UNPARTED)).as_py():
        texts = pc.replace_substring_regex(texts, f"({_UNPARTED})", r" \1 ")
    return split_words(texts)


class Items:
    """Test items as numbers: their words' place in a sorted vocabulary, and the distinct n-grams, sorted."""

    def __init__(self, ids: list, texts: list[str]):
        codes, offsets, words = plain_words(pa.array(texts, pa.string()))
        order = pc.sort_indices(words).to_numpy()
        self.words = words.take(pa.array(order))
        if len(self.words) + 1 >= 1 << WORD_BITS:
            raise ValueError(f"a block of test items has {len(self.words)} distinct words, more than their numbers can hold")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        flat = rank[codes] if len(codes) else np.zeros(0, np.int64)
        self.ids, self.items = ids, [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        self.per_item = [self.grams(x) for x in self.items]
        self.known = np.unique(np.concatenate([*self.per_item, np.zeros(0, np.int64)]))

    @staticmethod
    def grams(words: np.ndarray, n: int = 0) -> np.ndarray:
        """n-grams as one number each; an item of fewer words than NGRAM is one short n-gram."""
        n = n or min(NGRAM, len(words))
        if not n or len(words) < n:
            return np.zeros(0, np.int64)
        out = np.zeros(len(words) - n + 1, np.int64)
        for k in range(n):
            out = out << WORD_BITS | (words[k : len(words) - n + 1 + k] + 1)
        return out

    def uses(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Items and places of the known n-grams, those of the first one first, and where those of each begin."""
        gram = np.searchsorted(self.known, np.concatenate([*self.per_item, np.zeros(0, np.int64)]))
        sizes = [len(x) for x in self.per_item]
        item, place = np.repeat(np.arange(len(sizes)), sizes), np.concatenate([*map(np.arange, sizes), np.zeros(0, np.int64)])
        order = np.argsort(gram, kind="stable")
        return item[order], place[order], np.searchsorted(gram[order], np.arange(len(self.known) + 1))

    def bags(self) -> tuple[np.ndarray, np.ndarray]:
        """Words of the items as numbers of item and word, sorted, and how often the item holds each."""
        item = np.repeat(np.arange(len(self.items)), [len(x) for x in self.items])
        return np.unique(item * len(self.words) + np.concatenate([*self.items, np.zeros(0, np.int64)]), return_counts=True)

    def places(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Where the texts of a batch hold known n-grams: document, place, index of the n-gram; the words, their offsets."""
        wanted = self.known
        codes, offsets, words = plain_words(batch.column("t"))
        own = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = own[codes] if len(codes) else np.zeros(0, np.int64)
        doc = np.repeat(np.arange(len(batch)), np.diff(offsets))
        found = []
        for n in sorted({min(NGRAM, len(x)) for x in self.items if len(x)}):
            if len(flat) < n:
                continue
            on = np.ones(len(flat) - n + 1, bool)
            for k in range(n):
                on &= flat[k : len(flat) - n + 1 + k] >= 0
            at = np.flatnonzero(on & (doc[: len(doc) - n + 1] == doc[n - 1 :]))
            value = self.grams(flat, n)[at]
            index = np.searchsorted(wanted, value)
            index[index == len(wanted)] = 0
            hit = wanted[index] == value if len(wanted) else np.zeros(len(at), bool)
            found.append((at[hit], index[hit]))
        at = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.int64)
        index = np.concatenate([x for _, x in found]) if found else np.zeros(0, np.int64)
        return doc[at], at, index, flat, offsets


def spread(first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of stretches with these beginnings and sizes, one behind the other: each element's stretch, and its number."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + first[of]


def align(item: np.ndarray, window: np.ndarray) -> tuple[float, int, int]:
    """Smith-Waterman score over the item's full score, and the words of the window that the best alignment covers.

    A row of the table at a time: gaps along the row are a running maximum of scores less the gaps up to them.
    """
    m, n = len(item), len(window)
    slope = -GAP * np.arange(n + 1)
    score, begin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best, span = 0, (0, 0)
    for w in item:
        gain = np.where(window == w, MATCH, MISMATCH)
        new, start = np.zeros(n + 1, np.int64), np.arange(n + 1)
        across, down = score[:-1] + gain, score[1:] + GAP
        take = across >= down
        new[1:], start[1:] = np.where(take, across, down), np.where(take, begin[:-1], begin[1:])
        fresh = new <= 0
        new[fresh], start[fresh] = 0, np.arange(n + 1)[fresh]
        lifted = new + slope
        top = np.maximum.accumulate(lifted)
        along = top - slope
        source = np.maximum.accumulate(np.where(lifted == top, np.arange(n + 1), 0))
        better = along > new
        new[better], start[better] = along[better], start[source[better]]
        score, begin = new, start
        k = int(np.argmax(score))
        if score[k] > best:
            best, span = int(score[k]), (int(begin[k]), k)
    return best / (MATCH * m), *span


def _match(items: Items, threshold: float, id_col: str):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_item, of_place, begin = items.uses()
        bag, held = items.bags()
        sizes = np.array([len(x) for x in items.items], np.int64)
        slack = sizes // 2 + 2

        def matches(doc: np.ndarray, at: np.ndarray, index: np.ndarray, flat: np.ndarray, offsets: np.ndarray) -> Iterator[tuple]:
            hit, use = spread(begin[index], begin[index + 1] - begin[index])
            d, k, start = doc[hit], of_item[use], at[hit] - of_place[use]
            order = np.lexsort((start, k, d))
            d, k, start = d[order], k[order], start[order]
            pair = np.ones(len(d), bool)
            pair[1:] = (d[1:] != d[:-1]) | (k[1:] != k[:-1])
            n_seeds = np.diff(np.append(np.flatnonzero(pair), len(d)))
            # places that point at nearly the same stretch share a window
            new = pair.copy()
            new[1:] |= start[1:] - start[:-1] > slack[k[1:]]
            first = np.flatnonzero(new)
            d, k, left, right = d[first], k[first], start[first], start[np.append(first[1:], len(start)) - 1]
            number = (np.cumsum(pair) - 1)[first]
            a, b = np.maximum(offsets[d], left - slack[k]), np.minimum(offsets[d + 1], right + sizes[k] + slack[k])
            ends, done = np.cumsum(b - a), 0
            best: dict[int, tuple] = {}
            while done < len(d):
                stop = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + AT_ONCE, side="right")))
                window, word = spread(a[done:stop], b[done:stop] - a[done:stop])
                window, word = window[flat[word] >= 0], word[flat[word] >= 0]
                key = k[done + window] * len(items.words) + flat[word]
                place = np.minimum(np.searchsorted(bag, key), len(bag) - 1)
                shared, times = np.unique((window * len(bag) + place)[bag[place] == key], return_counts=True)
                most = np.bincount(shared // len(bag), np.minimum(times, held[shared % len(bag)]), stop - done)
                for i in done + np.flatnonzero(most / sizes[k[done:stop]] >= threshold):
                    got, x, y = align(items.items[k[i]], flat[a[i] : b[i]])
                    if got >= threshold and got > best.get(number[i], (0,))[0]:
                        gone = int(a[i] - offsets[d[i]])
                        best[number[i]] = (got, int(d[i]), items.ids[k[i]], int(n_seeds[number[i]]), gone + x, gone + y)
                done = stop
            for got, *rest in best.values():
                yield rest[0], rest[1], got, *rest[2:]

        for whole in batches:
            for batch in sliced(whole, "t", SLICE):
                doc, at, index, flat, offsets = items.places(batch)
                order = np.argsort(doc, kind="stable")
                doc, at, index = doc[order], at[order], index[order]
                ends = np.cumsum(begin[index + 1] - begin[index])
                rows, done = [], 0
                while done < len(doc):  # whole documents, as many as AT_ONCE holds
                    stop = int(np.searchsorted(ends, (ends[done - 1] if done else 0) + AT_ONCE, side="right"))
                    if stop < len(doc):
                        stop = int(np.searchsorted(doc, doc[stop])) if doc[stop] != doc[done] else int(np.searchsorted(doc, doc[stop], side="right"))
                    rows += matches(doc[done:stop], at[done:stop], index[done:stop], flat, offsets)
                    done = stop
                yield pa.RecordBatch.from_arrays(
                    [batch.column("i").take(pa.array([r[0] for r in rows], pa.int64())), *(pa.array([r[c] for r in rows], t) for c, t in ((1, pa.int64()), (2, pa.float64()), (3, pa.int64()), (4, pa.int64()), (5, pa.int64())))],
                    names=[id_col, "item_id", "score", "n_seeds", "first_word", "end_word"],
                )

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per pair of a document and a test item that it holds a copy of: id, item_id, score (1: word for word),
    n_seeds (places where it holds an n-gram of the item), and the document's words [first_word, end_word) that align with it.

    Null and wordless texts on either side match nothing; an item below NGRAM words is one seed by itself. Repeated rows
    of docs give a row each; items with the same id are items of their own. Without items, or without documents, there
    are no rows. A copy without any NGRAM words in a row left as they were has no seed. A document of any length is
    searched whole, an item of any length up to 2**21 distinct words. Columns besides ids and texts are not looked at.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    schema = f"`{id_col}` {kind}, item_id long, score double, n_seeds long, first_word long, end_word long"

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets, _ = plain_words(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), batch.column("text"), pa.array(np.diff(offsets))], names=["item_id", "text", "n"])

    items = cut(benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(counted, "item_id long, text string, n long").where("n > 0"))
    blocks = max(1, -(-(items.agg(F.sum("n")).first()[0] or 0) // BLOCK_WORDS))
    items = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    found = None
    for k in range(blocks):
        own = items.where(F.col("block") == k)
        size = own.agg(F.sum("n")).first()[0] or 0
        if size > max(4 * BLOCK_WORDS, own.agg(F.max("n")).first()[0] or 0):
            raise ValueError(f"{size} words of test items fall into one block; some of them must be repeated very often")
        rows = own.orderBy("item_id", "text").collect()
        pairs = source.mapInArrow(_match(Items([r["item_id"] for r in rows], [r["text"] for r in rows]), threshold, id_col), schema)
        if blocks > 1:
            pairs = written(pairs, "contaminated")
        found = pairs if found is None else found.unionByName(pairs)
    return found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents that hold a copy of a test item: an id goes with all its rows."""
    found = contaminated(docs, benchmark, threshold, id_col, text_col).select(F.col(id_col).alias("__id")).distinct()
    return docs.join(found, docs[id_col].eqNullSafe(found["__id"]), "left_anti")
