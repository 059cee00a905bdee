"""Language-model scores by context-tree weighting over bytes.

Each byte is eight binary decisions. A decision has a node for each context of its 0 to DEPTH preceding bytes (and the
bits of the byte already known); a node estimates by Krichevsky and Trofimov, and weights its own estimate against its
children's, half and half beforehand. With the tree learned, a decision's probability is the mixture of the estimates
along its context's path, by the weights that the training data leave; a path ends where training never went on, and the
last node's estimate takes the rest: an empty child would say 1/2 there, which is worse than what its parent has learned,
and the mixture stays a distribution either way. So a text's code length needs only, for each run of DEPTH + 1 bytes in it, one number.

How that is shared out:

1. Each partition of documents lists its distinct byte runs and words with their training counts, packed in rows by a
   hash of the run or word (requests).
2. Requests meet by hash; their distinct runs go with their counts to the task of their last three context bytes, which
   holds those bytes' whole subtree. Of nodes of at most two context bytes the sums go to the driver and three numbers each
   to all tasks: text in UTF-8 can have some 8 million of them, whatever its size (33,000 pairs of bytes, 255 paths), and any
   real text has some hundred thousand; more than that is an error.
   Hash groups are as many as the texts' size asks for, so a group stays small.
3. The numbers go back to the hash tasks, there into the order of each request, and to the requesting partition, where the
   documents are scored.

Nothing that grows with the corpus is broadcast or collected: the model only ever lies in parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import n_partitions, release, sliced, split_words, strings, trimmed, written
from .quality import word_hashes

DEPTH = 5
#: Depths whose nodes are summed over all tasks; deeper ones lie whole in the task of their last TOP + 1 context bytes.
TOP = 2
#: A byte that no UTF-8 text holds: it ends a text, and stands for what lies before one.
EDGE = 0xFF
LN2 = np.log(2)
#: Bytes of text for each hash group, and how many groups there are at most: distinct runs grow far slower than texts.
GROUP_BYTES, MAX_GROUPS = 16 << 20, 1 << 14
#: Bytes of text that are cut into runs at once, which take some 50 times as much memory.
SLICE = 1 << 20
#: Nodes of at most TOP context bytes that go with the tasks, 24 bytes each.
MAX_TOP = 1 << 23
RUNS, WORDS = 0, 1


def byte_runs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each byte of the texts and their end, with the DEPTH bytes before it, as one number; offsets of the texts."""
    low = pc.ascii_lower(strings(texts)).cast(pa.large_binary())
    joined = pc.binary_join_element_wise(pa.scalar(bytes([EDGE] * DEPTH), pa.large_binary()), low, pa.scalar(bytes([EDGE]), pa.large_binary()), pa.scalar(b"", pa.large_binary()))
    n = pc.binary_length(joined).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.frombuffer(b"".join(joined.to_pylist()), np.uint8).astype(np.int64)
    out = np.zeros(max(0, len(flat) - DEPTH), np.int64)
    for k in range(DEPTH + 1):
        out = out << 8 | flat[k : len(flat) - DEPTH + k]
    starts = np.cumsum(n) - n
    on = np.ones(len(out), bool)  # runs that would begin in one text and end in the next
    for k in range(DEPTH):
        edge = starts[1:] - DEPTH + k
        on[edge[edge < len(on)]] = False
    return out[on], np.concatenate(([0], np.cumsum(n - DEPTH)))


def packed(values: np.ndarray) -> bytes:
    """Sorted keys as differences, other numbers as they are; bytes of a rank side by side, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()) if len(values) else b""


def unpacked(raw: bytes, kind: str) -> np.ndarray:
    import zstandard

    if not raw:
        return np.zeros(0, kind)
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(flat.reshape(size, -1).T).view(kind).ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    return packed(np.diff(keys, prepend=np.zeros(1, keys.dtype)))


def unpack_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(unpacked(raw, "u8"), dtype=np.uint64)


class Groups:
    """Equal keys brought together. Keys mostly come as sorted runs, which a stable sort merges."""

    def __init__(self, keys: np.ndarray):
        self.order = np.argsort(keys, kind="stable")
        ranked = keys[self.order]
        new = np.ones(len(ranked), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        self.starts = np.flatnonzero(new)
        self.keys = ranked[self.starts]

    def sums(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values[self.order], self.starts) if len(self.starts) else values[:0]


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    groups = Groups(keys)
    return groups.keys, groups.sums(counts.astype(np.int64))


def hashed(keys: np.ndarray, n: int) -> np.ndarray:
    mixed = keys * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed ^ (mixed >> np.uint64(32))) % np.uint64(n)).astype(np.int64)


def counted(batch: pa.RecordBatch) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Distinct byte runs and word hashes of some texts, with how often those that train have them."""
    trains = ~batch.column("h").to_numpy(zero_copy_only=False)
    runs, edges = byte_runs(batch.column("t"))
    codes, offsets, words = split_words(pc.ascii_lower(strings(batch.column("t"))))
    n = np.bincount(codes, np.repeat(trains, np.diff(offsets)), len(words)) if len(codes) else np.zeros(len(words))
    learned = runs[np.repeat(trains, np.diff(edges))]
    own, own_n = np.unique(learned, return_counts=True)
    rest = np.setdiff1d(np.unique(runs[np.repeat(~trains, np.diff(edges))]), own, assume_unique=True)
    keys = np.concatenate((own, rest)).astype(np.uint64)
    return {RUNS: summed(keys, np.concatenate((own_n, np.zeros(len(rest), np.int64)))), WORDS: summed(word_hashes(words), n)}


def _requests(n_buckets: int):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {RUNS: [], WORDS: []}
        pid, tokens, texts = None, 0, 0
        for whole in batches:
            for batch in sliced(whole, "t", SLICE):
                pid = batch.column("p")[0].as_py()
                for kind, found in counted(batch).items():
                    held[kind].append(found)
                    if len(held[kind]) == 8:  # bounds what waits to be summed
                        held[kind] = [summed(*(np.concatenate(x) for x in zip(*held[kind], strict=True)))]
                texts += int(pc.sum(pc.invert(batch.column("h"))).as_py() or 0)
        if pid is None:
            return
        for kind, parts in held.items():
            keys, counts = summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            tokens += int(counts.sum()) if kind == WORDS else 0
            bucket = hashed(keys, n_buckets)
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
            rows = [(b, order[a:e]) for b, (a, e) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if e > a]
            yield pa.RecordBatch.from_arrays(
                [pa.array([kind] * len(rows), pa.int32()), pa.array([b for b, _ in rows], pa.int32()), pa.array([pid] * len(rows), pa.int32()), pa.array([pack_keys(keys[x]) for _, x in rows], pa.binary()), pa.array([packed(counts[x]) for _, x in rows], pa.binary()), pa.array([0] * len(rows), pa.int64()), pa.array([0] * len(rows), pa.int64())],
                names=_REQUEST_NAMES,
            )
        yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.int32()) for x in (-1, 0, pid)), *(pa.array([b""], pa.binary()),) * 2, pa.array([tokens], pa.int64()), pa.array([texts], pa.int64())], names=_REQUEST_NAMES)

    return run


_REQUEST_NAMES = ["kind", "bucket", "pid", "keys", "counts", "tokens", "texts"]
_REQUESTS = "kind int, bucket int, pid int, keys binary, counts binary, tokens long, texts long"


def _merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys = [unpack_keys(x) for x in table.column("keys").to_pylist()]
    counts = [unpacked(x, "i8") for x in table.column("counts").to_pylist()]
    return summed(np.concatenate(keys), np.concatenate(counts))


def _totals(n_shards: int):
    """Of a hash bucket: its distinct runs and their counts, a row for each shard of last context bytes."""

    def run(table: pa.Table) -> pa.Table:
        keys, counts = _merged(table)
        shard = hashed((keys >> np.uint64(8)) & np.uint64((1 << 8 * (TOP + 1)) - 1), n_shards)
        rows = [(int(s), shard == s) for s in np.unique(shard)]
        return pa.table({"bucket": pa.array([table.column("bucket")[0].as_py()] * len(rows), pa.int32()), "shard": pa.array([s for s, _ in rows], pa.int32()), "keys": pa.array([pack_keys(keys[x]) for _, x in rows], pa.binary()), "counts": pa.array([packed(counts[x]) for _, x in rows], pa.binary())})

    return run


def lgamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function from 1/2 on: Stirling's series eight steps up."""
    down = np.log(x)
    for k in range(1, 8):
        down = down + np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) - down


class Level:
    """The nodes of one depth: keys (context and path), counts of both bits, log of the weighted probability."""

    def __init__(self, keys: np.ndarray, n0: np.ndarray, n1: np.ndarray, children: np.ndarray | None):
        self.keys, self.n0, self.n1 = keys, n0, n1
        own = lgamma(n0 + 0.5) + lgamma(n1 + 0.5) - np.log(np.pi) - lgamma(n0 + n1 + 1.0)
        self.log = own if children is None else np.logaddexp(own, children) - LN2
        #: Of the mixture below this node, the part of its own estimate; and the estimate of a 1.
        self.weight = np.ones(len(keys)) if children is None else np.exp(own - LN2 - self.log)
        self.one = (n1 + 0.5) / (n0 + n1 + 1.0)

    def estimates(self) -> Level:
        """This level with what scores need alone."""
        self.n0 = self.n1 = self.log = None
        return self

    def above(self, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Keys at depth, one less than this level's, with the sums over their children here."""
        groups = Groups(((self.keys >> 8) & ((1 << 8 * depth) - 1)) << 8 | (self.keys & 255))
        return groups.keys, *(groups.sums(x) for x in (self.n0, self.n1, self.log))


def leaves(runs: np.ndarray, counts: np.ndarray) -> Level:
    """The deepest nodes, from runs seen in training."""
    context, byte = runs >> 8, runs & 255
    keys = np.concatenate([context << 8 | (1 << j) | (byte >> (8 - j)) for j in range(8)])
    bits = np.concatenate([(byte >> (7 - j)) & 1 for j in range(8)])
    n = np.tile(counts, 8)
    groups = Groups(keys)
    return Level(groups.keys, groups.sums((n * (1 - bits)).astype(float)), groups.sums((n * bits).astype(float)), None)


def grown(level: Level, top: int, depth: int) -> list[Level]:
    """Levels top to depth, from the deepest."""
    out = [level]
    for d in range(depth - 1, top - 1, -1):
        out.insert(0, Level(*out[0].above(d)))
    return out


def log10_of(runs: np.ndarray, levels: list[Level]) -> np.ndarray:
    """log10 of the probability of the last byte of each run behind the others; levels from depth 0 on."""
    context, byte = runs >> 8, runs & 255
    total = np.zeros(len(runs))
    for j in range(8):
        path, bit = (1 << j) | (byte >> (8 - j)), ((byte >> (7 - j)) & 1).astype(bool)
        p, left, last, on = np.zeros(len(runs)), np.ones(len(runs)), np.full(len(runs), 0.5), np.ones(len(runs), bool)
        for d, level in enumerate(levels):
            if not len(level.keys):
                break
            key = (context & ((1 << 8 * d) - 1)) << 8 | path
            at = np.searchsorted(level.keys, key)
            at[at == len(level.keys)] = 0
            on &= level.keys[at] == key
            one, weight = level.one[at], level.weight[at]
            own = np.where(bit, one, 1 - one)
            last = np.where(on, own, last)
            p += np.where(on, left * weight * own, 0)
            left = np.where(on, left * (1 - weight), left)
        total += np.log10(p + left * last)
    return total


def _trained(keys: np.ndarray, counts: np.ndarray) -> list[Level]:
    seen = counts > 0
    return grown(leaves(keys[seen].astype(np.int64), counts[seen]), TOP + 1, DEPTH)


def _upwards(table: pa.Table) -> pa.Table:
    """Of a shard: the sums that its nodes give to those at depth TOP."""
    key, n0, n1, log = _trained(*_merged(table))[0].above(TOP)
    return pa.table({"key": pa.array(key, pa.int64()), "n0": pa.array(n0, pa.float64()), "n1": pa.array(n1, pa.float64()), "log": pa.array(log, pa.float64())})


def _values(top: list[Level]):
    """Of a shard: log10 probabilities of its runs, in the order of each row's keys."""

    def run(table: pa.Table) -> pa.Table:
        levels = top + _trained(*_merged(table))
        keys = table.column("keys").to_pylist()
        values = [packed(log10_of(unpack_keys(x).astype(np.int64), levels).astype(np.float32)) for x in keys]
        return pa.table({"bucket": table.column("bucket"), "keys": table.column("keys"), "values": pa.array(values, pa.binary())})

    return run


def _answers(requests: pa.Table, values: pa.Table) -> pa.Table:
    """Of a hash bucket of runs: each request's numbers in its order."""
    keys = [unpack_keys(x) for x in values.column("keys").to_pylist()]
    known = np.concatenate([np.zeros(0, np.uint64), *keys])
    numbers = np.concatenate([np.zeros(0, np.float32), *(unpacked(x, "f4") for x in values.column("values").to_pylist())])
    order = np.argsort(known)
    known, numbers = known[order], numbers[order]
    out = [packed(numbers[np.searchsorted(known, unpack_keys(x))]) for x in requests.column("keys").to_pylist()]
    return _answer_table(requests, out, 0)


def _word_answers(table: pa.Table) -> pa.Table:
    """Of a hash bucket of words: each request's training counts in its order, and the bucket's distinct training words."""
    keys, counts = _merged(table)
    out = [packed(counts[np.searchsorted(keys, unpack_keys(x))].astype(np.float32) if counts.max(initial=0) < 1 << 24 else counts[np.searchsorted(keys, unpack_keys(x))].astype(np.float64)) for x in table.column("keys").to_pylist()]
    return _answer_table(table, out, int((counts > 0).sum()))


def _answer_table(requests: pa.Table, values: list[bytes], distinct: int) -> pa.Table:
    n = len(values)
    return pa.table({"kind": requests.column("kind"), "pid": requests.column("pid"), "keys": requests.column("keys"), "values": pa.array(values, pa.binary()), "distinct": pa.array([distinct] * (n > 0) + [0] * max(0, n - 1), pa.int64())})


_ANSWERS = "kind int, pid int, keys binary, values binary, distinct long"


def _scores(tokens: int, distinct: int, texts: int, id_col: str):
    scale = np.log10(tokens + distinct + 1.0)

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        known = {kind: _looked_for(answers.filter(pc.equal(answers.column("kind"), kind))) for kind in (RUNS, WORDS)}
        out = []
        for whole in docs.select(["i", "h", "t"]).combine_chunks().to_batches():
            for batch in sliced(whole, "t", SLICE):
                runs, edges = byte_runs(batch.column("t"))
                score = np.concatenate(([0.0], np.cumsum(_found_runs(*known[RUNS], runs))))[edges]
                codes, offsets, words = split_words(pc.ascii_lower(strings(batch.column("t"))))
                counts = _found(*known[WORDS], word_hashes(words))
                per = np.concatenate(([0.0], np.cumsum(np.log10(counts + 1)[codes])))[offsets] if len(codes) else np.zeros(len(offsets))
                seen = np.concatenate(([0], np.cumsum((counts > 0)[codes])))[offsets] if len(codes) else np.zeros(len(offsets), np.int64)
                n = np.diff(offsets) + 1
                base = np.diff(per) + np.log10(texts + 1) - n * scale
                out.append(pa.table({id_col: batch.column("i"), "held_out": batch.column("h"), "n_tokens": pa.array(n), "n_known": pa.array(np.diff(seen) + (texts > 0)), "train_tokens": pa.array([tokens] * len(n), pa.int64()), "base_score": pa.array(base), "score": pa.array(np.diff(score)), "bits_per_byte": pa.array(np.diff(score) / -np.log10(2) / np.diff(edges))}))
        kinds = {id_col: docs.schema.field("i").type, "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "train_tokens": pa.int64(), "base_score": pa.float64(), "score": pa.float64(), "bits_per_byte": pa.float64()}
        del known
        release()
        return pa.concat_tables(out) if out else pa.schema(list(kinds.items())).empty_table()

    return run


def _looked_for(answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The keys of a partition's requests, sorted, and their numbers: four bytes each where the answers have four."""
    keys, values = [np.zeros(0, np.uint64)], []
    for k, v in zip(answers.column("keys"), answers.column("values"), strict=True):
        keys.append(unpack_keys(k.as_py()))
        raw = v.as_py()
        size = len(unpacked(raw, "u1")) // max(1, len(keys[-1]))
        values.append(unpacked(raw, "f4" if size == 4 else "f8"))
    flat, numbers = np.concatenate(keys), np.concatenate([np.zeros(0, np.float32), *values])
    del keys, values
    order = np.argsort(flat, kind="stable")
    return flat[order], numbers[order]


def _found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(wanted):
        return np.zeros(0)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    if not len(keys) or (keys[at] != wanted).any():
        raise ValueError("a partition of the documents isn't what it was when it asked; give a table that reads the same again")
    return values[at].astype(np.float64)


def _found_runs(keys: np.ndarray, values: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """_found() of runs as they stand in texts, block by block: a run has 48 bits, so its place in a block sorts along with it."""
    out = np.empty(len(runs))
    for first in range(0, len(runs), 1 << 16):
        block = runs[first : first + (1 << 16)].astype(np.uint64) << np.uint64(16)
        block |= np.arange(len(block), dtype=np.uint64)
        block.sort()
        out[first + (block & np.uint64(0xFFFF)).astype(np.int64)] = _found(keys, values, block >> np.uint64(16))
    return out


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Rows train unless crc32 of the id as text is 2 modulo 7; a null id trains. score is log10 of the text's probability with
    its end, ASCII letters in lower case; base_score that of its words by add-one counts. Null and empty texts consist of
    the end alone. Repeated rows train as often as they stand, and get equal scores; without rows there are none. Where no
    row trains every bit has probability 1/2. docs must read the same twice, as tables do. Further columns are left out.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = max(n_partitions(spark), min(MAX_GROUPS, -(-size // GROUP_BYTES)))
    held = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(7)) == 2, F.lit(False))
    source = docs.select(F.col(id_col).alias("i"), held.alias("h"), F.coalesce(F.col(text_col), F.lit("")).alias("t"), F.spark_partition_id().alias("p"))
    requests = written(source.mapInArrow(_requests(n), _REQUESTS), "lm-requests")
    facts = requests.where("kind = -1").agg(F.sum("tokens").alias("tokens"), F.sum("texts").alias("texts")).first()
    texts = facts["texts"] or 0
    tokens = (facts["tokens"] or 0) + texts

    of_runs = requests.where(F.col("kind") == RUNS).select("kind", "bucket", "pid", "keys", "counts")
    totals = written(of_runs.groupBy("bucket").applyInArrow(_totals(n), "bucket int, shard int, keys binary, counts binary"), "lm-totals")
    up = written(totals.groupBy("shard").applyInArrow(_upwards, "key long, n0 double, n1 double, log double").groupBy("key").agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "log"))), "lm-top")
    if (n_top := up.count()) > MAX_TOP:
        raise ValueError(f"{n_top} nodes of {TOP} context bytes: the texts aren't UTF-8")
    up = up.orderBy("key").toPandas()
    top = [level.estimates() for level in grown(Level(*(up[c].to_numpy() for c in ("key", "n0", "n1", "log"))), 0, TOP)]
    values = totals.groupBy("shard").applyInArrow(_values(top), "bucket int, keys binary, values binary")
    runs = of_runs.groupBy("bucket").cogroup(values.groupBy("bucket")).applyInArrow(_answers, _ANSWERS)
    words = requests.where(F.col("kind") == WORDS).select("kind", "bucket", "pid", "keys", "counts").groupBy("bucket").applyInArrow(_word_answers, _ANSWERS)
    answers = written(runs.unionByName(words), "lm-answers")
    distinct = (answers.agg(F.sum("distinct")).first()[0] or 0) + (1 if texts else 0)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return source.groupBy(F.col("p").alias("pid")).cogroup(answers.groupBy("pid")).applyInArrow(_scores(tokens, distinct, texts, id_col), schema)
