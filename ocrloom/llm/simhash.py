"""SimHash fingerprints of documents, linked within a Hamming radius by BK-trees, and the components of the links."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import looked_up
from .common import cut, n_partitions, sliced, trimmed
from .components import components

SEED = 42
#: Fingerprints of a shard; a larger one is split by more of its bits.
MAX_SHARD = 20_000


class BKTree:
    """Fingerprints by Hamming distance: a child hangs from its parent at their distance."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        place = len(self.values)
        at = 0
        if place:
            while (d := (value ^ self.values[at]).bit_count()) in self.children[at]:
                at = self.children[at][d]
            self.children[at][d] = place
        self.values.append(value)
        self.children.append({})

    def within(self, value: int, radius: int) -> Iterator[int]:
        """Places of the values within radius. Below a node at distance d only the edges d - radius to d + radius can lead to one."""
        left = [0] if self.values else []
        while left:
            at = left.pop()
            d = (value ^ self.values[at]).bit_count()
            if d <= radius:
                yield at
            for k, child in self.children[at].items():
                if -radius <= k - d <= radius:
                    left.append(child)


def parts_of(bits: list[int], n: int) -> list[int]:
    """Masks of n stretches that bits (places) fall into."""
    edges = [len(bits) * k // n for k in range(n + 1)]
    return [sum(1 << p for p in bits[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


def shard_masks(radius: int, spare: int = 3, within: int = 0) -> list[int]:
    """Masks of which two fingerprints within radius share at least one: the bits outside `within`, on which they agree
    already, in radius + spare blocks, spare of them equal."""
    return [within | sum(x) for x in combinations(parts_of([p for p in range(64) if not within >> p & 1], radius + spare), spare)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(words: list[bytes], size: int) -> int:
    import xxhash

    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= size:
        hashes = xxhash.xxh64_digest(line, SEED)
    else:
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate(([0], ends[:-size] + 1))
        digest = xxhash.xxh64_digest
        hashes = b"".join([digest(line[a:b], SEED) for a, b in zip(starts.tolist(), ends[size - 1 :].tolist(), strict=True)])
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
    over = 2 * bits.sum(axis=0, dtype=np.int64) > len(bits)
    return int.from_bytes(np.packbits(over).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, row (a hash of id and text) and fp (the 64 bits as a signed long) of each row; ASCII letters in lower case, shingles of size words."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for whole in batches for x in sliced(whole, "t")):
            fps = pa.array([signed(fingerprint((x or "").encode().lower().split(), size)) for x in batch.column("t").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("i"), batch.column("row"), fps], names=[id_col, "row", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("i"), row_hash(id_col, text_col).alias("row"), F.col(text_col).alias("t")).mapInArrow(run, f"`{id_col}` {kind}, row long, fp long")


def row_hash(id_col: str, text_col: str) -> F.Column:
    return F.xxhash64(F.lit("row"), F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Fingerprints of each shard of two or more; the rows come sorted by shard."""
    before: list[np.ndarray] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        mask, key, fp = (batch.column(c).to_numpy() for c in ("mask", "key", "fp"))
        edges = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
        if last is not None and last != (mask[0], key[0]) and before:
            if sum(map(len, before)) > 1:
                yield np.concatenate(before)
            before = []
        pieces = np.split(fp, edges)
        if len(pieces) > 1:
            if before or len(pieces[0]) > 1:
                yield np.concatenate([*before, pieces[0]])
            yield from (x for x in pieces[1:-1] if len(x) > 1)
            before = []
        before.append(pieces[-1])
        last = (mask[-1], key[-1])
    if sum(map(len, before)) > 1:
        yield np.concatenate(before)


def _linked(radius: int):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for run_ in _runs(batches):
            values = [x & 0xFFFFFFFFFFFFFFFF for x in run_.tolist()]
            tree, root = BKTree(), list(range(len(values)))

            def top(i: int, root: list[int] = root) -> int:
                while root[i] != i:
                    root[i] = i = root[root[i]]
                return i

            for i, x in enumerate(values):
                for j in tree.within(x, radius):
                    p, q = top(i), top(j)
                    root[max(p, q)] = min(p, q)
                tree.add(x)
            for i in range(len(values)):
                if (t := top(i)) != i:
                    a.append(signed(values[i]))
                    b.append(signed(values[t]))
            if len(a) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _sharded(distinct: DataFrame, masks: list[int]) -> DataFrame:
    keys = F.array(*[F.struct(F.lit(signed(m)).alias("mask"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for m in masks])
    return distinct.select("fp", F.explode(keys).alias("s")).select("s.mask", "s.key", "fp")


def links(distinct: DataFrame, radius: int, max_shard: int = MAX_SHARD) -> DataFrame:
    """Links (a, b) that join the distinct fingerprints fp as all pairs within radius do: within a shard, a spanning forest of them.

    A shard holds the fingerprints that agree on one choice of blocks; two within the radius agree on one choice at least,
    so no link is lost. A shard of more than max_shard is split the same way by the bits on which its members may differ:
    of these 26 or so the parts leave 13 free, so a part has some 8,000 members at most, whatever the data. Rows go to
    their shard, and the task that gets it builds its tree: shards are small, but all of them together have no bound that
    would let them be broadcast.
    """
    masks = shard_masks(radius)
    rows = cut(_sharded(distinct, masks))
    large = cut(rows.groupBy("mask", "key").count().where(F.col("count") > max_shard).select("mask", "key"))
    if not large.isEmpty():
        split = [_sharded(rows.where(F.col("mask") == signed(m)).join(large, ["mask", "key"], "left_semi").select("fp"), shard_masks(radius, 2, m)) for m in masks]
        rows = rows.join(large, ["mask", "key"], "left_anti")
        for x in split:
            rows = rows.unionByName(x)
    return rows.repartition(n_partitions(distinct.sparkSession), "mask", "key").sortWithinPartitions("mask", "key").mapInArrow(_linked(radius), "a long, b long")


def _components(docs: DataFrame, radius: int, size: int, id_col: str, text_col: str) -> DataFrame:
    """i, row, fp, component_id of each row of docs."""
    fps = cut(fingerprints(docs, size, id_col, text_col).withColumnRenamed(id_col, "i"))
    nodes = cut(fps.groupBy("fp").agg(F.min("i").alias("least")))
    labels = components(links(nodes.select("fp"), radius))
    of = cut(nodes.join(labels.withColumnRenamed("id", "fp"), "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label")))
    smallest = of.groupBy("label").agg(F.min("least").alias("component_id"))
    named = cut(looked_up(of, smallest, ["label"]).select("fp", "component_id"))
    return looked_up(fps, named, ["fp"])


def simhash_components(docs: DataFrame, radius: int = 2, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: its id, fingerprint (16 hexadecimal digits) and component_id.

    component_id is the smallest id of the documents that links of at most radius differing bits reach. Rows without a
    word, and null texts, have fingerprint zero and are linked like any other. Equal fingerprints are one node, so a
    group of copies of any size costs one; repeated rows stay repeated. A null id joins its component without giving its
    number, and a component of null ids alone has none. An empty table gives no rows; further columns are left out.
    """
    found = _components(docs, radius, size, id_col, text_col)
    return found.select(F.col("i").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, radius: int = 2, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component, the one with the smallest id.

    A document is an id in a component: rows that share its id but belong to other components are judged there, and rows
    that repeat it (same id, same component) stay with it. Rows with a null id stay only in components without any id.
    """
    found = _components(docs, radius, size, id_col, text_col)
    keep = found.where(F.col("i").eqNullSafe(F.col("component_id"))).select(F.col("i").alias("__id"), F.col("row").alias("__row")).distinct()
    same = docs[id_col].eqNullSafe(keep["__id"]) & (row_hash(id_col, text_col) == keep["__row"])
    return docs.join(keep, same, "left_semi")
