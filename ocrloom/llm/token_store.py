"""Token ids in a content-addressed store of binary chunks.

Encoding: a text's words (runs without ASCII white space) encode each on their own, because the tokenizer drops white
space and never joins over it; so a worker encodes distinct words only and gathers the ids of its texts from them.

Files, below one folder:

    staged/     kind=chunk: digest (SHA-256 of the ids as little-endian uint32), n, payload (the ids as zstd of little-endian
                uint16 or uint32); each distinct chunk once, however many documents hold it;
                kind=recipe: the recipes as they were made, before they are put in order
    recipes/    part, doc_id, n_tokens, lengths (uint32 each), digests (32 bytes each), root (Merkle root of the
                digests), in ascending doc_id order over the parts and within
    manifest/   part, documents, tokens, root (Merkle root over the part's documents in order: hashes of root and doc_id)

Chunks end where a rolling hash of the last WINDOW ids is zero in its low bits, and with the document; so equal
passages give equal chunks wherever they stand.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import kept, n_partitions, new_path, sliced, split_words, trimmed

WINDOW = 8
#: Bits of the rolling hash that are zero at a cut: chunks of about 2**9 ids.
CUT_BITS = 9
_GEAR = np.random.default_rng(20240229).integers(0, 2**63, 1 << 16, dtype=np.uint64)
#: Latin letters that the tokenizer takes for letters and that stand for themselves when composed.
_LATIN = "À-ÖØ-öø-įı-ɏ"
#: Those of them whose lower case isn't among them: a word that has one goes through the whole tokenizer.
_LEAVING = "".join(c for c in map(chr, range(0xC0, 0x250)) if re.match(f"[{_LATIN}]", c) and not re.fullmatch(f"[{_LATIN}]", c.lower()))
#: Distinct parts of words of which a worker keeps the ids, some 40 bytes each, and bytes of text that it encodes at once.
MAX_PARTS, SLICE = 600_000, 2 << 20


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of all items of runs that begin at starts, one run behind the other."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class WordEncoder:
    """Ids of texts through the ids of their distinct words, and those through their parts.

    The tokenizer cuts a word into runs of letters, single digits and runs of other signs before it merges, ASCII case
    put aside. Words of plain Latin signs are cut here by that rule, and each distinct part is encoded once, many in a
    call; every part ends in one id with the word end's mark, which tells them apart again. Any other word goes through
    the whole tokenizer.
    """

    def __init__(self, name: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        #: Normalizer and cutter of whole words, and of parts, which need neither lower case nor a cut.
        self.whole = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        self.parts = None, pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self.forget()

    def encoded(self, lines: list[str], how: tuple) -> list[np.ndarray]:
        self.tokenizer.normalizer, self.tokenizer.pre_tokenizer = how
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)]

    def forget(self) -> None:
        self.keys, self.flat, self.starts = pa.array([], pa.large_string()), np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def learn(self, parts: pa.Array) -> np.ndarray:
        """Indices of the parts among those known, the new ones encoded and added."""
        if len(self.keys) + len(parts) > MAX_PARTS:
            self.forget()
        at = pc.index_in(parts, value_set=self.keys)
        unknown, first = pc.is_null(at), len(self.keys)
        new = parts.filter(unknown)
        words, ids = new.to_pylist(), []
        for k in range(0, len(words), 10_000):
            lines = [" ".join(words[i : i + 200]) for i in range(k, min(k + 10_000, len(words)), 200)]
            ids += self.encoded(lines, self.parts)
        if ids:
            flat = np.concatenate(ids)
            ends = np.flatnonzero(self.ends[flat]) + 1
            if len(ends) != len(words):
                raise ValueError("the tokenizer cut a part in two")
            self.starts = np.concatenate((self.starts, ends + self.starts[-1]))
            self.flat = np.concatenate((self.flat, flat))
            self.keys = pa.concat_arrays([self.keys, new])
        places = pc.fill_null(at, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        places[unknown.to_numpy(zero_copy_only=False)] = first + np.arange(len(words))
        return places

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and their number for each word."""
        odd = pc.or_(pc.match_substring_regex(words, f"^$|[^!-&(-~{_LATIN}]|[{_LEAVING}]"), pc.match_substring(words, "<|"))
        plain = pc.invert(odd).to_numpy(zero_copy_only=False)
        cut = pc.replace_substring_regex(pc.utf8_lower(words.filter(pa.array(plain))), f"([a-z{_LATIN}]+|[0-9]|[^a-z0-9{_LATIN}]+)", "\\1 ")
        lists = pc.split_pattern(pc.ascii_rtrim(cut, " "), " ")
        parts = lists.flatten().dictionary_encode()
        known = self.learn(parts.dictionary)[parts.indices.to_numpy(zero_copy_only=False)] if len(parts) else np.zeros(0, np.int64)
        sizes = np.diff(self.starts)[known]
        ids = self.flat[ragged(self.starts[known], sizes)]
        edges = np.concatenate(([0], np.cumsum(sizes)))[lists.offsets.to_numpy() - (lists.offsets[0].as_py() if len(lists) else 0)] if len(lists) else np.zeros(1, np.int64)
        counts, odd = np.zeros(len(words), np.int64), np.flatnonzero(~plain)
        counts[plain] = np.diff(edges)
        if len(odd):
            own = self.encoded(words.take(pa.array(odd)).to_pylist(), self.whole)
            counts[odd] = [len(x) for x in own]
            whole = np.zeros(int(counts.sum()), np.uint32)
            starts = np.cumsum(counts) - counts
            whole[ragged(starts[plain], counts[plain])] = ids
            whole[ragged(starts[odd], counts[odd])] = np.concatenate(own)
            ids = whole
        return ids, counts

    def texts(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each with end_id behind it; offsets of the texts."""
        codes, offsets, words = split_words(texts)
        flat, sizes = self.words(words)
        per = sizes[codes]
        whole = flat[ragged((np.cumsum(sizes) - sizes)[codes], per)]
        ends = np.concatenate(([0], np.cumsum(per)))[offsets]
        return np.insert(whole, ends[1:], end_id), ends + np.arange(len(ends))


def cuts(ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Ends of the chunks of texts that lie in a row; a text's hash begins anew with it."""
    gear = _GEAR[ids & 0xFFFF] + ids.astype(np.uint64)
    place = np.arange(len(ids)) - np.repeat(offsets[:-1], np.diff(offsets))
    rolled = gear.copy()
    for k in range(1, WINDOW):
        before = np.zeros_like(gear)
        before[k:] = gear[:-k] if k < len(gear) else 0
        before[place < k] = 0
        rolled += before << np.uint64(k)
    # the low bits hold few of the window's ids; the high ones hold all
    hit = np.flatnonzero((rolled * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - CUT_BITS) == 0) + 1
    return np.union1d(hit, offsets[1:])


def merkle_root(digests: list[bytes]) -> bytes:
    """Root of the binary hash tree; an odd node goes up as it is. No digest: the hash of nothing."""
    level = digests or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


_STAGED = "kind string, route long, doc_id {id}, digest binary, n long, payload binary, lengths binary, root binary"
#: Digests that a task remembers, so as not to send copies that lie near each other; the shuffle drops the others.
MAX_SEEN = 100_000


def _encode(name: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        own, zstd = kept(f"encoder {name}", lambda: WordEncoder(name)), zstandard.ZstdCompressor(level=1, write_content_size=True)
        seen: set[bytes] = set()
        for whole in batches:
            for batch in sliced(whole, "t", SLICE):
                ids, offsets = own.texts(batch.column("t"), end_id)
                ends = cuts(ids, offsets)
                sizes, raw = np.diff(ends, prepend=0), ids.astype("<u4").tobytes()
                digests, rows = [], []
                for end, n in zip((ends * 4).tolist(), (sizes * 4).tolist(), strict=True):
                    part = raw[end - n : end]
                    digests.append(digest := hashlib.sha256(part).digest())
                    if digest not in seen:
                        seen.add(digest)
                        values = np.frombuffer(part, "<u4")
                        narrow = values.astype("<u2") if values.max() < 1 << 16 else values
                        rows.append((digest, n // 4, zstd.compress(narrow.tobytes())))
                yield _rows("chunk", [int.from_bytes(r[0][:8], "little", signed=True) for r in rows], [None] * len(rows), [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], None, None, batch.column("i").type)
                first = np.searchsorted(ends, offsets, side="right")  # chunks of a text: those that end in it
                lengths = sizes.astype("<u4")
                lists = [digests[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
                names, roots = batch.column("i"), [merkle_root(x) for x in lists]
                # copies of a text go different ways: the row's number in the slice is part of the route
                yield _rows("recipe", [int.from_bytes(x[:8], "little", signed=True) ^ k for k, x in enumerate(roots)], names, [b"".join(x) for x in lists], np.diff(offsets).tolist(), None, [lengths[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], roots, names.type)
                if len(seen) > MAX_SEEN:
                    seen.clear()

    return trimmed(run, f"encoder {name}")


def _rows(kind, route, ids, digests, n, payloads, lengths, roots, id_type) -> pa.RecordBatch:
    none = pa.nulls(len(route), pa.binary())
    return pa.RecordBatch.from_arrays(
        [
            pa.array([kind] * len(route), pa.string()), pa.array(route, pa.int64()), pa.array(ids, id_type) if isinstance(ids, list) else ids, pa.array(digests, pa.binary()), pa.array(n, pa.int64()),
            none if payloads is None else pa.array(payloads, pa.binary()), none if lengths is None else pa.array(lengths, pa.binary()), none if roots is None else pa.array(roots, pa.binary()),
        ],
        names=["kind", "route", "doc_id", "digest", "n", "payload", "lengths", "root"],
    )


@trimmed
def _unique(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of equal chunks, which the rows' order has brought side by side, the first stays."""
    last = None
    for batch in batches:
        keep = []
        for kind, digest in zip(batch.column("kind").to_pylist(), batch.column("digest").to_pylist(), strict=True):
            keep.append(kind == "recipe" or digest != last)
            last = digest if kind == "chunk" else None
        yield batch.filter(pa.array(keep, pa.bool_()))


class GrowingRoot:
    """merkle_root() of leaves that come one by one, in memory of the tree's height: each entry is the root of a full tree."""

    def __init__(self) -> None:
        self.full: list[tuple[int, bytes]] = []

    def add(self, leaf: bytes) -> None:
        height = 0
        while self.full and self.full[-1][0] == height:
            leaf = hashlib.sha256(self.full.pop()[1] + leaf).digest()
            height += 1
        self.full.append((height, leaf))

    def root(self) -> bytes:
        if not self.full:
            return merkle_root([])
        root = self.full[-1][1]
        for _, left in reversed(self.full[:-1]):
            root = hashlib.sha256(left + root).digest()
        return root


def document_leaf(root: bytes, doc_id: object) -> bytes:
    return hashlib.sha256(root + str(doc_id).encode()).digest()


def _part_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by part and within: each part's documents, tokens and Merkle root."""
    part, own, documents, tokens = None, GrowingRoot(), 0, 0

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([documents], pa.int64()), pa.array([tokens], pa.int64()), pa.array([own.root()], pa.binary())], names=["part", "documents", "tokens", "root"])

    for batch in batches:
        for p, i, n, root in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "n_tokens", "root")), strict=True):
            if p != part:
                if part is not None:
                    yield row()
                part, own, documents, tokens = p, GrowingRoot(), 0, 0
            own.add(document_leaf(root, i))
            documents, tokens = documents + 1, tokens + n
    if part is not None:
        yield row()


def _in_order(recipes: DataFrame, spark: SparkSession) -> DataFrame:
    """Recipes with each part's documents together, in order."""
    return recipes.repartition(n_partitions(spark), "part").sortWithinPartitions("part", "doc_id", "root", "lengths")


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes docs, end_id behind each, and writes the store below path.

    A null text is the empty text, its ids end_id alone. Rows with the same id are documents of their own, in the order
    of their contents. A null id comes first. An empty table gives empty folders with their schemas. Columns of docs
    besides the two are left out. Texts are encoded whole, in slices of a batch; no document is held twice.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    staged = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInArrow(_encode(tokenizer, end_id), _STAGED.format(id=kind))
    # one shuffle of compressed chunks, by digest: copies meet, and the rest spreads evenly
    (staged.repartition(n_partitions(spark), "route").sortWithinPartitions("kind", "digest").mapInArrow(_unique, staged.schema)
     .write.partitionBy("kind").option("compression", "none").parquet(f"{path}/staged"))
    rows = spark.read.schema(staged.schema).parquet(f"{path}/staged")
    recipes = rows.where("kind = 'recipe'").select("doc_id", F.col("n").alias("n_tokens"), "lengths", F.col("digest").alias("digests"), "root")
    # the root is that of the contents, so it parts rows of one id over the ranges too
    (recipes.repartitionByRange(n_partitions(spark), "doc_id", "root").sortWithinPartitions("doc_id", "root")
     .withColumn("part", F.spark_partition_id()).write.option("compression", "none").parquet(f"{path}/recipes"))
    ordered = _in_order(spark.read.parquet(f"{path}/recipes").select("part", "doc_id", "n_tokens", "root", "lengths"), spark)
    ordered.select("part", "doc_id", "n_tokens", "root").mapInArrow(_part_roots, _MANIFEST).write.parquet(f"{path}/manifest")


_MANIFEST = "part int, documents long, tokens long, root binary"


@trimmed
def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads payloads back: each has to give the ids that its digest names."""
    for batch in batches:
        crcs = []
        for digest, n, ids in zip(batch.column("digest").to_pylist(), batch.column("n").to_pylist(), decoded(batch), strict=True):
            raw = ids.tobytes()
            if len(ids) != n or hashlib.sha256(raw).digest() != digest:
                raise ValueError(f"chunk {digest.hex()} doesn't hold what its digest says")
            crcs.append(zlib.crc32(raw))
        yield pa.RecordBatch.from_arrays([batch.column("digest"), batch.column("n"), pa.array(crcs, pa.int64())], names=["digest", "n", "crc"])


def decoded(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    import zstandard

    zstd = zstandard.ZstdDecompressor()
    for payload, n in zip(batch.column("payload").to_pylist(), batch.column("n").to_pylist(), strict=True):
        raw = zstd.decompress(payload)
        yield np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4")


@trimmed
def _read_recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per chunk of a document: its digest, and how many bytes of ids lie behind it."""
    for batch in batches:
        rows, of = [], []
        for k, (n, lengths, digests, root) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("n_tokens", "lengths", "digests", "root")), strict=True)):
            own, sizes = [digests[i : i + 32] for i in range(0, len(digests), 32)], np.frombuffer(lengths, "<u4").astype(np.int64)
            if merkle_root(own) != root or sizes.sum() != n or len(own) != len(sizes):
                raise ValueError("a recipe doesn't match its Merkle root")
            behind = 4 * (n - np.cumsum(sizes))
            rows += zip(own, range(len(own)), sizes.tolist(), behind.tolist(), strict=True)
            of += [k] * len(own)
        take = batch.select(["doc_id", "start", "n_tokens", "root"]).take(pa.array(of, pa.int64()))
        yield pa.RecordBatch.from_arrays([*take.columns, *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.binary(), pa.int64(), pa.int64(), pa.int64())))], names=["doc_id", "start", "n_tokens", "root", "digest", "place", "size", "behind"])


def _powers() -> np.ndarray:
    """Row k: what a CRC register with one bit set becomes behind 2**k zero bytes."""
    rows = np.zeros((40, 32), np.uint64)
    for j in range(32):
        x = 1 << j
        for _ in range(8):
            x = (x >> 1) ^ (0xEDB88320 if x & 1 else 0)
        rows[0, j] = x
    for k in range(1, 40):
        rows[k] = _times(rows[k - 1], rows[k - 1])
    return rows


def _times(matrix: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.zeros_like(values)
    for j in range(32):
        out ^= matrix[j] * ((values >> np.uint64(j)) & np.uint64(1))
    return out


_POWERS = _powers()


def shifted_crc(crcs: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """What each CRC gives to the CRC of its bytes with n_bytes more behind them; the XOR over all parts is the whole's."""
    out, left = crcs.astype(np.uint64), n_bytes.astype(np.int64)
    for k in range(int(left.max()).bit_length() if len(left) else 0):
        on = (left >> k) & 1 == 1
        if on.any():
            out[on] = _times(_POWERS[k], out[on])
    return out


@trimmed
def _shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.column("crc").null_count:
            raise ValueError("a recipe names a chunk that the store doesn't hold")
        if batch.column("n").to_pylist() != batch.column("size").to_pylist():
            raise ValueError("a recipe and its chunk differ in length")
        crc = shifted_crc(batch.column("crc").to_numpy(), batch.column("behind").to_numpy()).astype(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), batch.column("root"), pa.array(crc)], names=["doc_id", "start", "n_tokens", "root", "crc"])


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a part's recipes in order: where each document starts. A part whose count, tokens or root isn't the manifest's is an error."""
    part, own, documents, tokens, start, wanted = None, GrowingRoot(), 0, 0, 0, None

    def check() -> None:
        if part is not None and (documents, tokens, own.root()) != wanted:
            raise ValueError(f"part {part} of the recipes isn't the one that its manifest names")

    for batch in batches:
        starts = []
        for p, i, n, root, *given, before in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "n_tokens", "root", "m_documents", "m_tokens", "m_root", "before")), strict=True):
            if p != part:
                check()
                if before is None:
                    raise ValueError(f"no manifest names part {p} of the recipes")
                part, own, documents, tokens, start, wanted = p, GrowingRoot(), 0, 0, before, tuple(given)
            starts.append(start)
            own.add(document_leaf(root, i))
            documents, tokens, start = documents + 1, tokens + n, start + n
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(starts, pa.int64()), *(batch.column(c) for c in ("n_tokens", "lengths", "digests", "root"))], names=["doc_id", "start", "n_tokens", "lengths", "digests", "root"])
    check()


def _placed_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _read_recipes(_placed(batches))


def _uses(spark: SparkSession, path: str) -> DataFrame:
    """The chunks of each document with its place in the whole stream, each part of the recipes held against its manifest."""
    recipes = spark.read.parquet(f"{path}/recipes")
    kind = recipes.schema["doc_id"].dataType.simpleString()
    # a row for each part, as many as partitions, not as documents
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = F.broadcast(spark.read.parquet(f"{path}/manifest").select("part", F.col("documents").alias("m_documents"), F.col("tokens").alias("m_tokens"), F.col("root").alias("m_root"), before.alias("before")))
    missing = parts.join(recipes.groupBy("part").count(), "part", "left_anti").where("m_documents > 0")
    if not missing.isEmpty():
        raise ValueError("a part that the manifest names has no recipes")
    # one function for both steps: two of them in a row would have two Python workers for each task, which stay
    return _in_order(recipes, spark).join(parts, "part", "left").mapInArrow(_placed_chunks, f"doc_id {kind}, start long, n_tokens long, root binary, digest binary, place long, size long, behind long")


def _chunks(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema(_STAGED.format(id=kind)).parquet(f"{path}/staged").where("kind = 'chunk'").select("digest", "n", "payload")


def verify_store(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of a store, from its files: doc_id, start, n_tokens, ids_crc32, n_chunks, merkle_root.

    Every payload is read and held against its digest, every recipe against its root, every part's count, tokens and root
    against the manifest; what doesn't fit is an error. The CRC of a document is put together from those of its chunks, so
    ids stay where they lie and only digests are joined.
    """
    kind = spark.read.parquet(f"{path}/recipes").schema["doc_id"].dataType.simpleString()
    chunks = _chunks(spark, path, kind).mapInArrow(_checked, "digest binary, n long, crc long")
    uses = _uses(spark, path)
    parts = uses.join(chunks, "digest", "left").mapInArrow(_shift, f"doc_id {kind}, start long, n_tokens long, root binary, crc long")
    return parts.groupBy("start", "doc_id", "n_tokens", "root").agg(F.expr("bit_xor(crc)").alias("ids_crc32"), F.count(F.lit(1)).alias("n_chunks")).select("doc_id", "start", "n_tokens", "ids_crc32", "n_chunks", F.hex("root").alias("merkle_root"))


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and ids of every document, put together again from recipes and chunks."""
    kind = spark.read.parquet(f"{path}/recipes").schema["doc_id"].dataType.simpleString()

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array([x.tolist() for x in decoded(batch)], pa.list_(pa.int64()))], names=["digest", "own"])

    chunks = _chunks(spark, path, kind).mapInArrow(unpack, "digest binary, own array<long>")
    uses = _uses(spark, path)
    parts = uses.join(chunks, "digest").groupBy("start", "doc_id").agg(F.array_sort(F.collect_list(F.struct("place", "own"))).alias("parts"))
    return parts.select("doc_id", "start", F.flatten(F.transform("parts", lambda x: x["own"])).alias("ids"))


def token_store(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Writes docs into a new store of the shared folder and returns what verify_store() reads from it."""
    path = path or new_path(docs.sparkSession, "token-store")
    write_store(docs, path, tokenizer, end_id, id_col, text_col)
    return verify_store(docs.sparkSession, path)
