"""Exact token counts at every prefix of a text, by prefix dynamic programming over a BPE vocabulary.

A byte-pair encoding is decided by its adjacent pairs: a sequence of pieces is the encoding of its text if and only if
each adjacent pair is the encoding of the pair's own text. So the last piece of the encoding of a prefix is the one
vocabulary suffix that fits behind the last piece of what remains, and

    count(prefix) = count(prefix without its last piece) + 1

gives the count of every prefix in one pass. Pieces never reach over a space (it only begins a piece) nor over a line
end (it has no piece), so a text falls apart into chunks whose states are shared by all texts: the states form a tree
of prefixes, walked in sorted order. The table of a text holds, for each of its characters, by how much the count of the
prefix that ends there differs from the one before: a signed byte each, put together from the tables of its chunks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, sliced, strings, trimmed

SPACE = "▁"
_CHUNK = re.compile(r" *[^ \n]+| +|\n")
#: Tables of chunks and fits of pairs that a worker keeps; beyond it starts anew, so its memory is bounded. Bytes of text at once.
MAX_CHUNKS, MAX_PAIRS, SLICE = 500_000, 1_000_000, 4 << 20


class PrefixCounter:
    """Prefix states of one sentencepiece BPE model: of each prefix, its count and the id of its last piece."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        normal = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.pieces = {i: sp.id_to_piece(i) for i in normal}
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in normal}
        whole = {p: len(self.merged(p)) == 1 for p in self.score}
        #: Only a piece that encodes to itself can stand in an encoding.
        self.ids = {p: i for i, p in self.pieces.items() if whole[p]}
        ends: dict[str, set[int]] = {}
        for piece in self.ids:
            ends.setdefault(piece[-1], set()).add(len(piece))
        #: Lengths of the pieces that end in a character, longest first.
        self.lengths = {c: sorted(x, reverse=True) for c, x in ends.items()}
        self.pairs: dict[int, bool] = {}
        self.tables: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text, by merging the best adjacent pair, the leftmost first."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                x = score.get(parts[i] + parts[i + 1])
                if x is not None and (best is None or x > best):
                    best, at = x, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, a: int, b: int) -> bool:
        """Whether the pieces a and b, side by side, are the encoding of their text; kept for later."""
        if len(self.pairs) > MAX_PAIRS:
            self.pairs.clear()
        left, right = self.pieces[a], self.pieces[b]
        known = self.pairs[a << 16 | b] = left + right not in self.ids and self.merged(left + right) == [left, right]
        return known

    def extend(self, chunk: str, count: list[int], last: list[int]) -> None:
        """Appends the states of the prefixes of chunk that are longer than those which count and last hold."""
        ids, pairs, lengths = self.ids, self.pairs, self.lengths
        for i in range(len(count), len(chunk) + 1):
            for k in lengths.get(chunk[i - 1], ()):
                if k > i:
                    continue
                piece = ids.get(chunk[i - k : i])
                if piece is None:
                    continue
                before = last[i - k]
                if before >= 0:
                    fit = pairs.get(before << 16 | piece)
                    if not (self.fits(before, piece) if fit is None else fit):
                        continue
                last.append(piece)
                count.append(count[i - k] + 1)
                break
            else:  # no piece holds the character: its bytes are tokens, and what follows begins anew
                last.append(-1)
                count.append(count[i - 1] + len(chunk[i - 1].encode()))

    def learn(self, raw: set[str]) -> None:
        """Tables of chunks as texts have them. In sorted order neighbours share the states of their common prefix."""
        count, last, before = [0], [-1], ""
        for chunk in sorted(raw):
            text = chunk.replace(" ", SPACE)
            known, most = 0, min(len(text), len(before))
            while known < most and text[known] == before[known]:
                known += 1
            del count[known + 1 :], last[known + 1 :]
            self.extend(text, count, last)
            self.tables[chunk] = bytes([(b - a) & 255 for a, b in zip(count, count[1:], strict=False)])
            before = text

    def tables_of(self, raw: list[str]) -> list[bytes]:
        """Tables of words that begin with spaces; such a word can hold line ends and fall into chunks there."""
        tables = self.tables
        if new := {x for x in raw if x not in tables}:
            if len(tables) + len(new) > MAX_CHUNKS:
                tables.clear()
                new = set(raw)
            parts = {x: _CHUNK.findall(x) for x in new if "\n" in x}
            self.learn({y for x in parts.values() for y in x} | {x for x in new if x not in parts})
            for x, own in parts.items():
                tables[x] = b"".join([tables[y] for y in own])
        return [tables[x] for x in raw]

    def texts(self, texts: pa.Array) -> list[bytes]:
        """The table of each text of a null-free array, one byte for each of its characters."""
        texts = pc.replace_substring(texts, SPACE, " ")  # to the model the two are one
        out: list[list[bytes]] = [[]] * len(texts)
        # a text with runs of spaces, or one at an end, is cut by the pattern; any other simply at its spaces
        plain = pc.and_(pc.not_equal(texts, ""), pc.invert(pc.match_substring_regex(texts, "^ |  | $"))).to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(texts.filter(pa.array(plain)), " ")
        words = lists.flatten().dictionary_encode()
        per_word = self.tables_of([" " + w for w in words.dictionary.to_pylist()])
        codes, offsets = words.indices.to_pylist(), lists.offsets.to_numpy()
        edges = (offsets - offsets[0]).tolist()
        for i, a, b in zip(np.flatnonzero(plain).tolist(), edges[:-1], edges[1:], strict=True):
            out[i] = [per_word[c] for c in codes[a:b]]
        for i in np.flatnonzero(~plain).tolist():
            if x := texts[i].as_py():
                out[i] = self.tables_of(_CHUNK.findall(f" {x}"))
        return [self.without_front(b"".join(x)) for x in out]

    @staticmethod
    def without_front(table: bytes) -> bytes:
        """The model's own space in front of a text is no character of it: its byte goes into that of the first character."""
        return bytes([(table[0] + table[1]) & 255]) + table[2:] if table else table


def counts_at(table: bytes) -> np.ndarray:
    """The token count at every prefix, the empty one first, from a table."""
    return np.concatenate((np.zeros(1, np.int64), np.cumsum(np.frombuffer(table, np.int8), dtype=np.int64)))


def longest(counts: np.ndarray, limit: int) -> int:
    """Characters of the longest prefix with limit tokens at most."""
    return int(np.flatnonzero(counts <= limit)[-1])


def token_counts(docs: DataFrame, model: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: n_bytes, n_tokens, over_limit, fit_chars (characters of the longest prefix within limit) and
    prefix_table, which holds the exact count at every prefix: with it any later question of truncation or budget is
    answered without the text (fitted(), counts_at()).

    model names a sentencepiece file of the public tokenizers. A null text counts as the empty text: no bytes and no
    tokens. Repeated rows are counted each on their own; an empty table gives no rows; other columns of docs are left
    out, whatever their names. A text of any length is counted whole. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        own = kept(f"counter {model}", lambda: PrefixCounter(public_tokenizers.path(model)))
        for whole in batches:
            for batch in sliced(whole, "t", SLICE):
                column = strings(batch.column("t"))
                tables = own.texts(column)
                counts = [counts_at(x) for x in tables]
                n = [int(x[-1]) for x in counts]
                out = [
                    batch.column("i"), pc.binary_length(column).cast(pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_()),
                    pa.array([longest(x, limit) if k > limit else len(x) - 1 for x, k in zip(counts, n, strict=True)], pa.int64()), pa.array(tables, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(out, names=[id_col, "n_bytes", "n_tokens", "over_limit", "fit_chars", "prefix_table"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long, prefix_table binary"
    return docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInArrow(trimmed(run, f"counter {model}"), schema)


def fitted(counts: DataFrame, limit: int, id_col: str = "doc_id") -> DataFrame:
    """id and fit_chars for another limit, from the tables that token_counts() gave: nothing is encoded again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array([longest(counts_at(x), limit) for x in batch.column("x").to_pylist()], pa.int64())], names=[id_col, "fit_chars"])

    return counts.select(F.col(id_col).alias("i"), F.col("prefix_table").alias("x")).mapInArrow(run, f"`{id_col}` {counts.schema[id_col].dataType.simpleString()}, fit_chars long")
