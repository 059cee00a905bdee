"""The corpus operators against brute force, round trips and held-out labels, on small tables with awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ocrloom.llm import context_tree, decontamination, html_text, mixing, quality, secrets, simhash, token_counts, token_store, toxicity
from ocrloom.llm.components import components

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, i int, t string, h boolean, p int, key long, fp long, size int, score double, kind string, label int"


def table(spark, texts, ids=None, sources=None):
    ids = list(range(len(texts))) if ids is None else ids
    sources = [f"s{k % 3}" for k in range(len(texts))] if sources is None else sources
    rows = [(i, x, None, s, 0, 7, "clash", True, 3, 5, 5, 5, 0.5, "clash", 9) for i, x, s in zip(ids, texts, sources, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


def sample(n=60, seed=3):
    rng = random.Random(seed)
    words = ["the", "of", "thing", "rest", "ané", "over", "Éau", "under", "blé", "and", "in", "to", "was,", "is.", "a"]
    return [" ".join(rng.choice(words) + (rng.choice("abcdefgh") if rng.random() < 0.2 else "") for _ in range(rng.randrange(1, 60))) + ("\n" if k % 5 == 0 else "") for k in range(n)]


AWKWARD = [None, "", " \t\n", "one", "one two", "x" * 30_000, "日本語 テスト", "a\x00b c", "İstanbul ΣΑΣ", "tie tie", "tie tie"]


@pytest.fixture(scope="module")
def texts():
    return sample() + AWKWARD + [" ".join(sample(40, 9))]


@pytest.fixture(scope="module")
def docs(spark, texts):
    """With a null id, a repeated id, a null source, and columns whose names the operators use inside."""
    ids = [*range(len(texts) - 2), 5, None]
    return table(spark, texts, ids, [None if k % 7 == 3 else f"s{k % 3}" for k in range(len(texts))]).cache()


def test_decontamination_finds_copies_and_edited_copies(spark):
    rng = random.Random(1)
    item = lambda k: " ".join(f"w{rng.randrange(900)}{k}" for _ in range(30))
    items = [item(k) for k in range(6)]
    edited = items[1].split()
    edited[4:6], edited[15] = ["other"], "changed"
    clean = " ".join(f"w{rng.randrange(900)}z" for _ in range(200))
    texts = [clean, f"{clean} {items[0].upper()}, {clean}", " ".join(edited), None, "", items[2][: len(items[2]) // 4], items[3] + " " + items[3], clean + " " + items[4], clean + " " + items[4], "short item here"]
    bench = spark.createDataFrame([(k, x) for k, x in enumerate([*items, None, "", "short item"])], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["score"] for r in decontamination.contaminated(table(spark, texts), bench).collect()}
    assert set(found) == {(1, 0), (2, 1), (6, 3), (7, 4), (8, 4), (9, 8)}
    assert found[1, 0] == 1 and 0.6 < found[2, 1] < 1
    kept = decontamination.drop_contaminated(table(spark, texts), bench)
    assert {r["doc_id"] for r in kept.collect()} == {0, 3, 4, 5}
    assert kept.columns == table(spark, texts).columns
    assert decontamination.contaminated(table(spark, texts), bench.where("false")).count() == 0
    assert decontamination.contaminated(table(spark, []), bench).count() == 0


def test_decontamination_finds_thoroughly_edited_copies(spark):
    """Every m-th word changed, in every phase, without and with a copy word for word beside it; all windows that brute force would pass."""
    rng = random.Random(12)
    edits = [(m, phase, beside) for m in (4, 5, 6) for phase in range(m) for beside in (False, True)]
    items = [" ".join(f"{rng.choice('abcdefgh')}{rng.randrange(400)}" for _ in range(40)) for _ in edits]
    texts, wanted = [], {}
    for x, (m, phase, _) in zip(items, edits, strict=True):
        words = [f"new{p}" if p % m == phase else w for p, w in enumerate(x.split())]
        texts.append(f"front {' '.join(words)} back")
    texts += [x for x, (_, _, beside) in zip(items, edits, strict=True) if beside] + ["nothing of any", " ".join(items[0].split()[:5])]
    code = {w: n for n, w in enumerate(sorted({w for x in texts + items for w in x.split()}))}
    number = lambda x: np.array([code[w] for w in x.split()])
    for i, x in enumerate(texts):
        for k, y in enumerate(items):
            if (got := decontamination.align(number(y), number(x))[0]) >= decontamination.THRESHOLD:
                wanted[i, k] = pytest.approx(got)
    assert {(k, k) for k in range(len(items))} <= set(wanted)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["score"] for r in decontamination.contaminated(table(spark, texts), bench).collect()}
    assert found == wanted


def test_decontamination_against_all_pairs(spark):
    """All documents against all items by whole alignments, those with a seed; short items beside long ones, null and repeated ids, scripts without spaces."""
    rng = random.Random(31)
    word = lambda: rng.choice("abcdefg") + str(rng.randrange(300))
    items = [" ".join(word() for _ in range(rng.choice([1, 2, 3, 4, 12, 30]))) for _ in range(40)] + ["aa bb cc dd", "cc dd", "这是一个测试题目的内容", "نص اختبار قصير جدا", "การทดสอบข้อความ", "--", ""]
    texts = []
    for k in range(80):
        line = [word() for _ in range(rng.randrange(60))]
        for _ in range(k % 3):
            copy = rng.choice(items).split()
            for _ in range(rng.randrange(3)):
                if copy:
                    copy[rng.randrange(len(copy))] = word()
            at = rng.randrange(len(line) + 1)
            line[at:at] = copy
        texts.append(" ".join(line))
    texts += ["aa bb", "bb cc dd", "x 这是一个测试题目的内容 y", "و نص اختبار قصير جدا و", "ก การทดสอบข้อความ ข", None, "", "long " * 40_000 + items[5]]
    ids = [None if k == 3 else 7 if k in (8, 9) else k for k in range(len(texts))]
    words = lambda x: [w for y in decontamination.plain_words(pa_array([x]))[2:] for w in y.to_pylist()] and plain(x)

    def plain(x):
        codes, _, flat = decontamination.plain_words(pa_array([x]))
        names = flat.to_pylist()
        return [names[c] for c in codes]

    def pa_array(x):
        import pyarrow as pa

        return pa.array(x, pa.string())

    grams = lambda x, n: {tuple(x[k : k + n]) for k in range(len(x) - n + 1)}
    wanted = Counter()
    for i, x in zip(ids, texts, strict=True):
        doc = words(x)
        for k, y in enumerate(items):
            item = words(y)
            n = min(decontamination.NGRAM, len(item))
            if n and grams(item, n) & grams(doc, n):
                code = {w: c for c, w in enumerate(dict.fromkeys(item + doc))}
                got = decontamination.align(np.array([code[w] for w in item]), np.array([code[w] for w in doc]))[0]
                if got >= decontamination.THRESHOLD:
                    wanted[i, k, round(got, 9)] += 1
    bench = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    rows = decontamination.contaminated(table(spark, texts, ids), bench).collect()
    assert Counter((r["doc_id"], r["item_id"], round(r["score"], 9)) for r in rows) == wanted and len(wanted) > 30
    kept = decontamination.drop_contaminated(table(spark, texts, ids), bench)
    assert sorted(map(repr, (r["doc_id"] for r in kept.collect()))) == sorted(repr(i) for i in ids if not any(i == d for d, _, _ in wanted))


def test_items_in_several_blocks(spark, monkeypatch):
    rng = random.Random(32)
    items = [" ".join(f"w{rng.randrange(900)}" for _ in range(20)) for _ in range(30)]
    bench = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    docs = table(spark, [f"front {x} back" for x in items])
    whole = Counter(map(tuple, decontamination.contaminated(docs, bench).collect()))
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", 150)
    assert Counter(map(tuple, decontamination.contaminated(docs, bench).collect())) == whole


def test_alignment_is_smith_watermans():
    rng = np.random.default_rng(2)
    for _ in range(40):
        a, b = rng.integers(0, 4, rng.integers(1, 9)), rng.integers(0, 4, rng.integers(0, 14))
        h = np.zeros((len(a) + 1, len(b) + 1))
        for i in range(len(a)):
            for j in range(len(b)):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        assert decontamination.align(a, b)[0] == pytest.approx(h.max() / (2 * len(a)))


def test_token_store_round_trip(spark, docs, texts, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    path = str(tmp_path / "store")
    token_store.write_store(docs, path, "word_bpe_49k.json", 2)
    rows = token_store.verify_store(spark, path).orderBy("start").collect()
    ids = {r["start"]: r["ids"] for r in token_store.read_store(spark, path).collect()}
    wanted = Counter((r["doc_id"], tuple(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [2])) for r in docs.collect())
    assert Counter((r["doc_id"], tuple(ids[r["start"]])) for r in rows) == wanted
    place = 0
    for r in rows:
        own = ids[r["start"]]
        assert (r["start"], r["n_tokens"]) == (place, len(own))
        assert r["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes())
        place += len(own)
    numbers = [r["doc_id"] for r in rows]
    assert numbers == sorted(numbers, key=lambda i: (i is not None, i))
    assert token_store.token_store(table(spark, [])).count() == 0


def test_equal_passages_are_stored_once(spark, tmp_path):
    passage = " ".join(sample(400, 5))
    path = str(tmp_path / "store")
    token_store.write_store(table(spark, [passage, "before " + passage, passage + " behind", passage]), path, "word_bpe_49k.json", 2)
    chunks = spark.read.parquet(f"{path}/staged").where("kind = 'chunk'")
    assert chunks.count() == chunks.select("digest").distinct().count()
    stored, whole = chunks.agg(F.sum("n")).first()[0], spark.read.parquet(f"{path}/recipes").agg(F.sum("n_tokens")).first()[0]
    assert stored < 0.6 * whole


def test_pieces_of_a_batch_hold_its_texts():
    import pyarrow as pa
    import pyarrow.compute as pc

    from ocrloom.llm.common import sliced, split_words, strings

    rng = random.Random(8)
    texts = [" ".join(rng.choice(["Ánd", "THE", "ñu", "Ω", "日本"]) * rng.randrange(1, 9) for _ in range(rng.randrange(400))) for _ in range(300)]
    batch, found = pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"]), []
    for lower in (pc.ascii_lower, pc.utf8_lower):
        found = []
        for piece in sliced(batch, "t", 20_000):
            codes, offsets, words = split_words(lower(strings(piece.column("t"))))
            flat = words.to_pylist()
            found += [[flat[c] for c in codes[a:b]] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        low = str.lower if lower is pc.utf8_lower else lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x)
        assert found == [low(x).split() for x in texts]


def test_word_encoder_on_odd_words():
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    odd = ["A B", "don't WE'LL", "x́y é  é", "ﬁ ΣΑΣ ς", "<|endoftext|> hi<|EndOfText|>", "1234", "a..", "Àé.B9c", "ÿŸ ǅ Ɏ ŉ", "it's", "Ĳ ĳ Ǆx ǰ", "~!@#$%^&*()_+`-={}|[]\\:\";<>?,./", "K", "a\u0085b\x1cc"]
    ids, offsets = token_store.WordEncoder("word_bpe_49k.json").texts(pa.array(odd), 2)
    for k, x in enumerate(odd):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == tokenizer.encode(x, add_special_tokens=False).ids + [2]


def test_word_encoder_on_all_letters():
    """Every code point below U+3000, alone, between letters and in mixes, as the library encodes it."""
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    tokenizer, rng = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), random.Random(5)
    points = [chr(k) for k in range(1, 0x3000)]
    given = points + [f"a{c}b" for c in points] + ["".join(rng.choice(points if rng.random() < 0.5 else points[:0x250]) for _ in range(rng.randrange(1, 12))) for _ in range(5000)]
    ids, offsets = token_store.WordEncoder("word_bpe_49k.json").texts(pa.array(given), 2)
    wanted = [e.ids + [2] for e in tokenizer.encode_batch(given, add_special_tokens=False)]
    assert [(x, ids[a:b].tolist()) for x, a, b, w in zip(given, offsets[:-1], offsets[1:], wanted, strict=True) if ids[a:b].tolist() != w] == []


def test_no_two_python_steps_of_the_store_share_a_stage(spark, tmp_path):
    """Each would have its own worker beside the other's, in every task."""
    path = str(tmp_path / "store")
    token_store.write_store(table(spark, ["a b", "c"]), path, "word_bpe_49k.json", 2)
    plan = token_store.verify_store(spark, path)._jdf.queryExecution().optimizedPlan().toString()
    depths = [(len(x) - len(x.lstrip(" :+-|")), x) for x in plan.split("\n") if x.strip()]
    steps = [k for k, (_, x) in enumerate(depths) if "MapInArrow" in x]
    assert len(steps) == 3
    for k in steps:  # what lies below a step, up to the next join or shuffle, has no Python
        below = next((x for _, x in depths[k + 1 :] if "Project" not in x), "")
        assert "MapInArrow" not in below


def test_store_tells_what_was_altered(spark, docs, tmp_path):
    path = str(tmp_path / "store")
    token_store.write_store(docs, path, "word_bpe_49k.json", 2)
    assert token_store.verify_store(spark, path).count() == docs.count()
    recipes = spark.read.parquet(f"{path}/recipes").cache()
    one = recipes.where("doc_id = 3")
    swapped = recipes.withColumn("doc_id", F.when(F.col("doc_id") == 3, 4).when(F.col("doc_id") == 4, 3).otherwise(F.col("doc_id")))
    for k, bad in enumerate([recipes.exceptAll(one), recipes.unionByName(one), swapped, recipes.where(F.col("part") != one.first()["part"]), recipes.withColumn("root", F.lit(b"x"))]):
        other = f"{path}-{k}"
        bad.write.parquet(f"{other}/recipes")
        for name in ("manifest", "staged"):
            spark.read.parquet(f"{path}/{name}").write.partitionBy(*(["kind"] if name == "staged" else [])).parquet(f"{other}/{name}")
        with pytest.raises(Exception, match="manifest|Merkle"):
            token_store.verify_store(spark, other).collect()


def test_growing_root_is_the_trees():
    for n in range(20):
        leaves, own = [bytes([k]) * 32 for k in range(n)], token_store.GrowingRoot()
        for x in leaves:
            own.add(x)
        assert own.root() == token_store.merkle_root(leaves)


def test_quality_counts_against_brute_force(spark, docs):
    labels = spark.createDataFrame([(k, 1, 0) for k in range(30)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    got = Counter(tuple(r)[:6] for r in quality.quality_rules(docs, labels).drop("base_failed", "kept").collect())
    wanted = Counter()
    for r in docs.collect():
        x = r["text"] or ""
        w = WORD.findall(x)
        windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        n = Counter(windows)
        covered = {p for k, v in enumerate(windows) if n[v] > 1 for p in range(k, k + 5)}
        lines = [y for y in x.split("\n") if WORD.search(y)]
        wanted[r["doc_id"], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), len(lines) - len(set(lines)), len(covered)] += 1
    assert got == wanted
    repeated = quality.quality_rules(table(spark, ["a b c d e f a b c d e f g h", "x\nx\n\n\nx\ny #$"]), labels.where("false")).orderBy("doc_id").collect()
    assert [r["n_repeat_words"] for r in repeated] == [12, 0] and [r["n_dup_lines"] for r in repeated] == [0, 2]
    assert quality.quality_rules(table(spark, []), labels).count() == 0


def test_quality_ratio_against_brute_force(spark, docs):
    """llr and kept of every row from the definition: two multinomials over hashed 1- and 2-grams, with prior counts."""
    import xxhash

    given = [(r["doc_id"], WORD.findall(r["text"] or "")) for r in docs.collect()]
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(40)] + [(5, 0, 0), (None, 1, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    good = {k for k in range(40) if k % 3 > 0} - {5}
    mask = 2**64 - 1
    mix, mix2 = int(quality._MIX), int(quality._MIX2)

    def grams(words):
        h = [xxhash.xxh64_intdigest(w) for w in words]
        two = [(a * mix2 + b) & mask for a, b in zip(h, h[1:], strict=False)]
        return [(x * mix & mask) >> (64 - quality.BUCKET_BITS) for x in h + two]

    raw, target = Counter(), Counter()
    for i, words in given:
        raw.update(grams(words))
        if i in good:
            target.update(grams(words))
    part = sum(target.values()) / sum(raw.values())
    ratio = lambda b: math.log(target[b] / part + quality.SMOOTHING) - math.log(raw[b] + quality.SMOOTHING)
    wanted = sorted((repr(i), round(sum(map(ratio, grams(w))) / max(1, 2 * len(w) - 1), 6)) for i, w in given)
    rows = quality.quality_rules(docs, labels).collect()
    got = sorted((repr(r["doc_id"]), r["llr"]) for r in rows)
    assert [i for i, _ in got] == [i for i, _ in wanted] and [x for _, x in got] == pytest.approx([x for _, x in wanted], abs=2e-6)
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and r["llr"] >= quality.THRESHOLD)


def test_quality_keeps_what_reads_like_the_trusted(spark):
    rng = random.Random(4)
    good = [" ".join(rng.choice(["the", "of", "and", "this", "rest", "thing"]) + rng.choice(["", "a", "o"]) for _ in range(80)) for _ in range(60)]
    junk = [" ".join(f"{rng.choice('QXZ')}{rng.randrange(40)}$$" for _ in range(80)) for _ in range(10)]
    labels = spark.createDataFrame([(k, 1 if k < 60 else 0, 0) for k in range(0, 70, 2)], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"]: r["kept"] for r in quality.quality_rules(table(spark, good + junk), labels).collect()}
    assert all(kept[k] for k in range(60)) and not any(kept[k] for k in range(60, 70))


def test_mixing_reaches_its_targets(spark):
    texts = sample(300, 8)
    sources = [["a", "b", "c", None][min(3, k % 9)] for k in range(300)]
    docs = table(spark, [*texts, None, ""], None, [*sources, "a", "b"])
    rows = mixing.mix_sources(docs).collect()
    again = mixing.mix_sources(docs.repartition(3)).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        assert r["size"] == len(WORD.findall((texts + [None, ""])[r["doc_id"]] or "")) and 0 <= r["taken"] <= 2 * r["size"]
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["source_size"] >= r["size"]
    left, open_, wanted = 1.5 * sum(sizes.values()), {"a": 3, "b": 1, "c": 2, None: 3}, {}
    while open_:
        full = {s for s, w in open_.items() if left * w / sum(open_.values()) > 2 * sizes[s]}
        if not full:
            wanted |= {s: left * w / sum(open_.values()) for s, w in open_.items()}
            break
        wanted |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2.0 * sizes[s] for s in full)
        open_ = {s: w for s, w in open_.items() if s not in full}
    assert target == pytest.approx(wanted)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 0.5
    whole = mixing.mixed_documents(docs)
    assert whole.columns == docs.columns
    words = Counter()
    for r in whole.collect():
        words[r["source"]] += len(WORD.findall(r["text"]))
        assert r["n_chars"] == len(r["text"])
    assert words == Counter({s: n for s, n in taken.items() if n})
    assert mixing.mix_sources(docs.where("false")).count() == 0
    assert mixing.mix_sources(table(spark, [None, ""])).agg(F.sum("taken")).first()[0] == 0


def test_mixing_takes_what_its_blocks_hold(spark):
    """Every document's words against the schedule walked slot by slot."""
    texts = sample(200, 18) + ["", None, "a b c"]
    sources = [["hot", "hot", "hot", "b", None][k % 5] for k in range(200)] + ["empty", "empty", "tiny"]
    docs = table(spark, texts, None, sources)
    rows = mixing.mix_sources(docs).collect()
    names = sorted({s for s in sources if s is not None}) + [None]
    words = [round(next(r["target"] for r in rows if r["source"] == s)) for s in names]
    total, ends, slots = sum(words), [], []
    for k in range(len(words)):
        ends.append(round(sum(words[: k + 1]) * 2**52 / total))
    n = -(-total // mixing.BLOCK)
    rank = Counter()
    for k in range(n):
        point = (k + 1) * mixing.GOLDEN % 2**52
        s = sum(e <= point for e in ends)
        slots.append((s, rank[s], k))
        rank[s] += 1
    got = {(r["s"], r["rank"]): r["slot"] for r in mixing.schedule(spark, words).collect()}
    needed = {(s, k) for s, w in enumerate(words) for k in range(-(-w // mixing.BLOCK))}
    assert set(got) == needed and len(set(got.values())) == len(got)
    assert all(got[s, k] == slot for s, k, slot in slots if (s, k) in needed)
    for s, name in enumerate(names):
        own = sorted((r for r in rows if r["source"] == name and r["size"]), key=lambda r: r["place"])
        order = [k for k, r in enumerate(own) for _ in range(r["size"])]
        taken = Counter((order * 2)[: words[s]])
        assert [r["taken"] for r in own] == [taken[k] for k in range(len(own))]
    assert {r["taken"] for r in rows if r["source"] == "empty"} == {0} and sum(r["taken"] for r in rows if r["source"] == "tiny") == 6


def test_schedule_has_sources_in_their_shares(spark):
    words = [40_000, 9_000, 1_000, 30]
    slots = sorted((r["slot"], r["s"]) for r in mixing.schedule(spark, words).collect())
    for n in (50, 150, len(slots)):
        for s, w in enumerate(words):
            assert abs(sum(x == s for _, x in slots[:n]) - n * w / sum(words)) <= 3


def test_mix_keeps_rows_of_one_id(spark):
    texts = ["a b c d", "e f g", "a b c d", "a b c d", None, "h i"]
    docs = table(spark, texts, [1, 1, 1, None, 1, None], ["x", "x", "x", "y", "x", "y"])
    mixed, rows = mixing.mixed_documents(docs).collect(), mixing.mix_sources(docs).collect()
    words, taken = Counter(), Counter()
    for r in mixed:
        words[r["doc_id"], r["source"]] += len(r["text"].split())
    for r in rows:
        taken[r["doc_id"], r["source"]] += r["taken"]
    assert words == taken and all(r["text"] in ("a b c d", "e f g", "h i") or any(x.startswith(r["text"]) for x in ("a b c d", "e f g", "h i")) for r in mixed)
    assert mixing.mixed_documents(docs.where("false")).count() == 0


class Tree:
    """Context-tree weighting by its recursion, a node at a time."""

    def __init__(self, depth):
        self.depth, self.n = depth, {}

    def learn(self, text):
        for context, path, bit in self.bits(text):
            for d in range(self.depth + 1):
                self.n.setdefault((context[:d], path), [0, 0])[bit] += 1

    def bits(self, text):
        line = b"\xff" * self.depth + text + b"\xff"
        for k in range(self.depth, len(line)):
            context, path = tuple(line[k - 1 - d] for d in range(self.depth)), 1
            for j in range(8):
                bit = line[k] >> (7 - j) & 1
                yield context, path, bit
                path = path * 2 + bit

    def weight(self):
        self.log, self.own = {}, {}
        for key in sorted(self.n, key=lambda k: -len(k[0])):
            a, b = self.n[key]
            own = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)
            self.own[key] = own
            if len(key[0]) == self.depth:
                self.log[key] = own
            else:
                below = sum(self.log[k] for k in self.n if k[1] == key[1] and len(k[0]) == len(key[0]) + 1 and k[0][:-1] == key[0])
                self.log[key] = np.logaddexp(own, below) - math.log(2)

    def score(self, text):
        total = 0.0
        for context, path, bit in self.bits(text):
            p, left, last = 0.0, 1.0, 0.5
            for d in range(self.depth + 1):
                key = (context[:d], path)
                if key not in self.n:
                    break
                last = (self.n[key][bit] + 0.5) / (sum(self.n[key]) + 1)
                w = 1.0 if d == self.depth else math.exp(self.own[key] - math.log(2) - self.log[key])
                p, left = p + left * w * last, left * (1 - w)
            total += math.log10(p + left * last)
        return total


def test_language_model_against_its_recursion(spark, tmp_path):
    texts = ["Abab ab", "baba", "abc abc ab", None, "", "zé b", "ab", "ab ab", "b a b", "abba", "aab ab"]
    table(spark, texts).write.parquet(str(tmp_path / "docs"))
    rows = {r["doc_id"]: r for r in context_tree.lm_scores(spark.read.parquet(str(tmp_path / "docs"))).collect()}
    held = {k for k in range(len(texts)) if zlib.crc32(str(k).encode()) % 7 == 2}
    assert {k for k, r in rows.items() if r["held_out"]} == held and held
    low = [(x or "").encode().lower() for x in texts]
    tree, counts = Tree(context_tree.DEPTH), Counter()
    for k, x in enumerate(low):
        if k not in held:
            tree.learn(x)
            counts.update([*x.split(), "end"])
    tree.weight()
    n, v = sum(counts.values()), len(counts)
    for k, x in enumerate(low):
        tokens = [*x.split(), "end"]
        assert rows[k]["n_tokens"] == len(tokens) and rows[k]["n_known"] == sum(counts[w] > 0 for w in tokens) and rows[k]["train_tokens"] == n
        assert rows[k]["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens))
        assert rows[k]["score"] == pytest.approx(tree.score(x), rel=1e-5)


def test_language_model_on_awkward_rows(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "docs"))
    assert context_tree.lm_scores(spark.read.parquet(str(tmp_path / "docs"))).where("score < 0").count() == docs.count()
    docs.where("false").write.parquet(str(tmp_path / "none"))
    assert context_tree.lm_scores(spark.read.parquet(str(tmp_path / "none"))).count() == 0


def test_lgamma():
    for x in (0.5, 1.0, 1.5, 2.5, 10.5, 1e6 + 0.5):
        assert context_tree.lgamma(np.array([x]))[0] == pytest.approx(math.lgamma(x), rel=1e-12, abs=1e-11)


PAGE = """<html><head><title>T</title><script>var a="</p>";</script></head><body><header><h1>Site</h1></header><nav><a href=x>One</a> <a href=y>Two</a></nav>
<div class="cookie-notice"><p>This site has cookies, and it is to be said that they are of use to all of us who are on it and to you as well as to the others.</p></div>
<main><h1>A &amp; B</h1><p>The text of the   article is about the way in which the blocks are judged, and it is long enough for that to be of use to all.<p>Short end.
<aside>Read the other one that is also on this site and that is of the same kind as this one here, for it is good.</aside><form><input><button>Go</button></form></main>
<div id="comments"><p>I think that it is not so good as it was when they had it on the other site, but it is what it is and so it will be.</p></div><footer>&copy; x</footer>"""


def test_pages(spark):
    wanted = "A & B\nThe text of the article is about the way in which the blocks are judged, and it is long enough for that to be of use to all.\nShort end."
    pages = spark.createDataFrame([(1, "u", PAGE, "clash"), (2, None, None, ""), (3, "u", "", ""), (None, "u", "<p>The", ""), (1, "u", PAGE, "")], "page_id long, url string, html string, text string")
    rows = html_text.html_texts(pages).collect()
    assert sorted(r["text"] for r in rows) == sorted([wanted, "", "", "The", wanted])
    assert all(r["n_chars"] == len(r["text"]) for r in rows)
    assert html_text.html_texts(pages.where("false")).count() == 0
    assert html_text.main_text("<div>" * 2000 + "<b" + "<" * 2000) is not None


LANGUAGES = {
    "ru": "Это довольно длинное предложение о том, как на этом языке пишут тексты для страниц.",
    "pl": "Pierwsze zdanie opowiada o książkach, które leżały przez długie lata na półkach biblioteki.",
    "zh": "这是一个比较长的中文句子,用来说明页面的正文应当被完整地保留下来,而不是被丢弃。",
    "el": "Αυτή είναι μια μεγάλη πρόταση που δείχνει πώς γράφονται τα κείμενα σε αυτή τη γλώσσα.",
    "ar": "هذه جملة طويلة نسبيا توضح كيف تكتب النصوص في هذه اللغة على صفحات الويب الحديثة.",
    "en": "This is a sentence of the kind that is to be found on the pages of this site and of others.",
}


def test_pages_of_any_language_without_article():
    for text in LANGUAGES.values():
        body = "\n".join([" ".join([text] * n) for n in (4, 3, 5)])
        page = "<html><body><div><a href=a>Alpha</a> <a href=b>Beta</a></div>" + "".join(f"<p>{x}</p>" for x in body.split("\n")) + "<ul><li><a href=c>Gamma</a><li><a href=d>Delta</a></ul></body></html>"
        assert html_text.main_text(page) == body


def test_density_links_and_neighbours_decide_without_markup():
    """Pages of plain div elements without a class: nothing but the method's rules can tell."""
    good = "This is a paragraph of the text that we are to read, and it is as long as it has to be so that it is a good one for all of us."
    listing = "Model XJ200 Weight 55kg Height 120cm Colour anthracite Voltage 230V Power 1500W Warranty 24 months Order number 88-1204-7 Shipping class B"
    links = '<div><a href=a>The first of the stories that we have for you</a> | <a href=b>and the other one that is of use to all</a></div>'
    wrap = lambda *x: "".join(f"<div>{y}</div>" for y in x)
    assert html_text.main_text(links + wrap(good, listing, good)) == f"{good}\n{good}"  # density
    assert html_text.main_text(wrap("A title", good, "Short one.", good)) == f"A title\n{good}\nShort one.\n{good}"  # neighbours, both good
    labels = lambda page: [b.label for b in settled(page)]

    def settled(page):
        blocks = html_text.blocks_of(page)
        html_text.settle(blocks)
        return blocks

    assert labels(wrap(good, "a", "b", "c") + links) == ["good", "good", "bad", "bad", "bad"]  # the nearer one; of equal ones the bad
    assert labels(wrap(good, "a", "b") + links + links) == ["good", "good", "bad", "bad", "bad"]
    assert labels(wrap("one", "two")) == ["good", "good"]  # no decided block
    assert html_text.main_text(f'<div class="no-sidebar layout">{wrap(good, good)}</div>') == f"{good}\n{good}"  # a layout's name
    assert html_text.main_text(f'<main>{wrap(good)}{links}</main>') == good  # links within main


def test_neighbours_are_those_of_a_search():
    """The sweeps against a walk from each block."""
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randrange(1, 14)
        blocks, main = [], 0
        for _ in range(n):
            main = rng.choice([main, main, rng.randrange(3)])
            blocks.append(html_text.Block("x", 0, rng.random() < 0.3, main))
        labels, bad = [rng.choice(["good", "bad", "short", "short"]) for _ in range(n)], [b.bad for b in blocks]
        for step in (-1, 1):
            for i, got in enumerate(html_text.neighbours(blocks, labels, step)):
                j, m = i + step, blocks[i].main
                while 0 <= j < n and (not m or blocks[j].main == m) and (labels[j] == "short" or m and bad[j]):
                    j += step
                inside = 0 <= j < n and (not m or blocks[j].main == m)
                assert got[0] == (labels[j] if inside else "good" if m else "") and (not got[0] or got[1] == j)


def test_pages_against_what_they_were_made_of():
    """Pages put together from parts of which each says whether it is main text: the brute force is the list of parts."""
    rng = random.Random(21)
    stop, other = "the of and to a in that is it was for on are with as this".split(), ["lorem", "table", "garden", "window", "street", "paper", "colour"]
    prose = lambda n: " ".join(rng.choice(stop) if rng.random() < 0.5 else rng.choice(other) for _ in range(n)).capitalize() + "."
    spaced = lambda x: x.replace(" ", rng.choice([" ", "  ", "\n\t "]), 2)
    for _ in range(200):
        wanted, page = [], ""

        def paragraph(tag="p"):
            nonlocal page
            x = prose(rng.randrange(40, 90))
            wanted.append(f"{x} A & B")
            page += f"<{tag}>{spaced(x)} <b>A</b> &amp; B" + (f"</{tag}>" if rng.random() < 0.8 or tag != "p" else "")

        def boilerplate():
            nonlocal page
            x = prose(rng.randrange(20, 60))
            page += rng.choice([f"<nav><ul><li><a href='x>y'>{x}</a></ul></nav>", f"<aside>{x}</aside>", f"<div class='comments-list'><p>{x}</p></div>", f"<script>if (a<b) '</p>{x}'</script>", f"<style>p {{ {x} }}</style>", f"<form><p>{x}</p><button>Go</button></form>", f"<footer>{x}</footer>", f"<!-- {x} <p> -->", f'<div id="cookie-notice">{x}</div>', f"<div><a href=u>{x}</a></div>"])

        article = rng.random() < 0.5
        page += "<!doctype html><html><head><title>T</title></head><body><header><h1>Site</h1></header>" + ("<article>" if article else "")
        for _ in range(rng.randrange(1, 12)):
            if rng.random() < 0.6:
                paragraph(rng.choice(["p", "div", "blockquote"]))
            else:
                boilerplate()
        page += "</article>" * article + "<footer>&copy; all of it is ours</footer></body></html>"
        assert html_text.main_text(page) == "\n".join(wanted)


def test_long_and_broken_pages_take_time_in_proportion():
    import time

    for piece in ('<a href="', "<li>ab", "<div>", "</span>", "<", '<div class="', "<!-", "<a b='c\">", "&", "<p id=nav_", "word <b "):
        began = time.time()
        html_text.main_text("<div>" * 5000 + piece * (1_000_000 // len(piece)))
        assert time.time() - began < 6, piece


def test_prefix_counts_are_the_librarys(spark, docs):
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    counted = token_counts.token_counts(docs, "piece_bpe_32k.model", limit=20)
    for r, given in zip(counted.collect(), docs.collect(), strict=True):
        x = given["text"] or ""
        assert (r["doc_id"], r["n_bytes"], r["n_tokens"]) == (given["doc_id"], len(x.encode()), len(model.encode(x)))
        assert r["over_limit"] == (r["n_tokens"] > 20)
        if len(x) < 500:
            at = token_counts.counts_at(r["prefix_table"]).tolist()
            assert at == [len(model.encode(x[:k])) for k in range(len(x) + 1)]
            assert r["fit_chars"] == max(k for k, n in enumerate(at) if n <= 20)
    wanted = [(r["doc_id"], r["fit_chars"]) for r in token_counts.token_counts(docs, "piece_bpe_32k.model", limit=7).collect()]
    assert [tuple(r) for r in token_counts.fitted(counted, 7).collect()] == wanted
    odd = [" ", "   a", "a  b ", "\n\n a", "a \n b", "<s></s>", "▁▁a", "▁ ▁", "▁  ", "a▁b ▁\n▁ c▁", "😀😀 a😀b", "0123456789" * 9, "-" * 90, " \t x", "▁"]
    got = token_counts.token_counts(table(spark, odd), "piece_bpe_32k.model").orderBy("doc_id").collect()
    for x, r in zip(odd, got, strict=True):
        assert token_counts.counts_at(r["prefix_table"]).tolist() == [len(model.encode(x[:k])) for k in range(len(x) + 1)]
    assert token_counts.token_counts(table(spark, []), "piece_bpe_32k.model").count() == 0


def test_counts_of_random_strings():
    """Mixes of any code points, with many spaces of both kinds and line ends among them, as the library counts them."""
    import public_tokenizers
    import pyarrow as pa
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model, own, rng = sentencepiece.SentencePieceProcessor(model_file=path), token_counts.PrefixCounter(path), random.Random(11)
    points = [chr(k) for k in range(1, 0x3000)]
    given = points + ["".join(rng.choice([" ", "▁", "\n", "a", "the", "-", rng.choice(points)]) for _ in range(rng.randrange(1, 14))) for _ in range(12000)]
    got = [int(token_counts.counts_at(x)[-1]) for x in own.texts(pa.array(given, pa.large_string()))]
    assert [(x, n, w) for x, n, w in zip(given, got, map(len, model.encode(given)), strict=True) if n != w] == []


SECRETS = ["password = hunter2hunter2", 'API_KEY: "abcd1234efgh" token=short secret: x', "AKIA" + "A1" * 8 + " AKIAX", "f" * 31 + " " + "0a" * 20, "é token='ab/cd+ef==' passwd:12345678", "-----BEGIN RSA PRIVATE KEY-----", "token=secret: abcdefgh", "see https://me:pw@host/x", "gh" + "p_" + "a" * 36, "xoxb-1234567890ab", None, ""]


def test_secret_spans_against_brute_force(spark, docs):
    given = [r["text"] for r in docs.collect()] + SECRETS
    rows = secrets.secret_spans(table(spark, given)).collect()
    assert len(rows) == len(given)
    rules = secrets.BASE + secrets.MORE
    for r in rows:
        x = given[r["doc_id"]] or ""
        spans = sorted((m.start(), k, m.end(), rule.kind) for k, rule in enumerate(rules) for m in re.finditer(rule.pattern, x) if len(m.group(rule.group)) >= rule.least)
        line = lambda some: ",".join(f"{d}:{a}:{c}" for a, _, c, d in some)
        assert r["spans"] == line(spans)
        assert r["base_sha256"] == hashlib.sha256(line([s for s in spans if s[1] < 3]).encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(s[1] == k for s in spans) for k in range(3))
    assert secrets.secret_spans(table(spark, [])).count() == 0


def test_long_texts_with_many_matches(spark):
    """A megabyte each of what could make a search start over or an array grow: spans as the expressions give them, in seconds."""
    import time

    n = 1_000_000
    long = ["0a1 " * (n // 4) + "f" * 40, "token=a " * (n // 8), "a" * n + "://x", "eyJ" * (n // 3), ("f" * 33 + " ") * (n // 34), "AKIA" * (n // 4), "password" + " " * n, "-----BEGIN " + "A " * (n // 2), "://a:" * (n // 5)]
    began = time.time()
    rows = secrets.secret_spans(table(spark, long)).collect()
    assert time.time() - began < 90
    for r in rows:
        x = long[r["doc_id"]]
        for rule in secrets.BASE:
            assert r[f"n_{rule.kind}"] == sum(len(m.group(rule.group)) >= rule.least for m in re.finditer(rule.pattern, x))


def test_base_rules_as_they_are_written():
    """Short runs matched and dropped, as the base kinds are told, against the rules that never match them."""
    rng = random.Random(3)
    for rule, pattern, least in ((secrets.BASE[1], "AKIA[A-Z0-9]+", 16), (secrets.BASE[2], "[0-9a-f]+", 32)):
        for _ in range(2000):
            x = "".join(rng.choice(["AKIA", "A1B2C3D4", "0a1b2c3d", "zz", " ", "0123456789abcdef"]) for _ in range(rng.randrange(12)))
            assert [m.span() for m in re.finditer(rule.pattern, x)] == [m.span() for m in re.finditer(pattern, x) if len(m[0]) >= least]


def test_trigram_queries():
    assert secrets.trigram_query("abcd") == [frozenset({"abc", "bcd"})]
    assert set(secrets.trigram_query("(foo|ba[rz])x+")) == {frozenset({"foo"}), frozenset({"bar"}), frozenset({"baz"})}
    assert secrets.trigram_query("[0-9a-f]+") == [] and secrets.trigram_query("ab.cd") == []
    assert secrets.trigram_query("(abc)*def") == [frozenset({"def"})]


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(6)
    words = ["thon", "rest", "ouble", "ster", "nding", "hert", "anly", "tion", "esh", "wher"]
    make = lambda: [rng.choice(words) + rng.choice(words) for _ in range(80)]
    texts = []
    for k in range(400):
        x = make()
        if k % 4 == 0:
            for _ in range(5):
                x.insert(rng.randrange(len(x)), rng.choice(["dreadful", "wretched", "numskull"]))
        texts.append(" ".join(x))
    docs = table(spark, [*texts, None, ""])
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(400)] + [(None, 0, 1), (9999, 0, 1), (7, 0, None)], "doc_id long, quality int, toxic int")
    rows = {r["doc_id"]: r for r in toxicity.toxicity_scores(docs, labels).collect()}
    assert len(rows) == 402 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows.values())
    assert {k for k, r in rows.items() if r["held_out"]} == {k for k in rows if zlib.crc32(str(k).encode()) % 5 == 0}
    out = [k for k in range(400) if rows[k]["held_out"]]
    assert sum(rows[k]["predicted"] == (k % 4 == 0) for k in out) >= 0.9 * len(out)
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.select("doc_id").collect()} == {k for k, r in rows.items() if not r["predicted"]}
    assert {r["score"] for r in toxicity.toxicity_scores(docs, labels.where("toxic = 0")).collect()} == {0.0}
    assert toxicity.toxicity_scores(docs.where("false"), labels).count() == 0


def test_toxic_words_that_ordinary_texts_hold_now_and_then(spark):
    rng = random.Random(7)
    parts = ["ver", "keit", "chlich", "ung", "heit", "schö", "ende", "stach", "ge", "ein", "be", "tz"]
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randrange(1, 4)))

    def text(n):
        x = [word() for _ in range(200)]
        for _ in range(n):
            x.insert(rng.randrange(len(x)), "wusnol" + rng.choice(["", word()]))
        return " ".join(x)

    marks = [k % 5 == 0 for k in range(600)]
    texts = [text(rng.randrange(6, 12) if toxic else int(k % 8 == 1)) for k, toxic in enumerate(marks)]  # one ordinary text in eight holds one
    labels = spark.createDataFrame([(k, 1, int(toxic)) for k, toxic in enumerate(marks)], "doc_id long, quality int, toxic int")
    rows = {r["doc_id"]: r for r in toxicity.toxicity_scores(table(spark, texts), labels).collect()}
    out = [k for k in range(600) if rows[k]["held_out"]]
    assert sum(rows[k]["predicted"] for k in out if marks[k]) >= 0.9 * sum(marks[k] for k in out)
    assert sum(rows[k]["predicted"] for k in out if not marks[k]) <= 0.05 * len(out)


def test_run_sums_against_a_count_by_hand(spark):
    """Which runs pass, on the executors and by the sums' own definition."""
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["abcdef", "ghijkl", "mnopqr"] + ["zzyzxw"] * (k % 4 == 0)) for _ in range(30)) for k in range(80)]
    marks = [k % 4 == 0 for k in range(80)]
    sums = toxicity.run_sums(zip(marks, texts, strict=True))
    logs = {toxic: [np.log1p([x.split().count("zzyzxw")])[0] for x, y in zip(texts, marks, strict=True) if y == toxic] for toxic in (True, False)}
    wanted = [sum(v > 0 for v in logs[False]), sum(logs[False]), sum(v * v for v in logs[False]), sum(v > 0 for v in logs[True]), sum(logs[True]), sum(v * v for v in logs[True])]
    assert sums[" zzyzx"] == pytest.approx(wanted) and sums["zyzxw"] == pytest.approx(wanted)
    frame = spark.createDataFrame([(r, *v) for r, v in sums.items()], "run string, " + ", ".join(f"{c} double" for c in toxicity._SUMS))
    n, m = sum(marks), 80 - sum(marks)

    def passes(v):
        a, b = v[4] / n, v[1] / m
        both = (v[1] + v[4]) / (n + m)
        spread = max((v[2] + v[5]) / (n + m) - both**2, 0.0)
        return v[3] >= toxicity.LEAST and a - b >= toxicity.DEVIATIONS * math.sqrt(spread * (1 / n + 1 / m) + 1e-12) and a >= toxicity.TIMES * (b + 0.5 / m)

    found = {r["run"] for r in frame.where(toxicity.clear(n, m)).collect()}
    assert found == {r for r, v in sums.items() if passes(v)} and " zzyzx" in found and " abcde" not in found


def test_toxicity_ties_repeats_and_long_texts(spark):
    """Repeated rows and repeated labels count once, equal texts score alike, a text is read to its end."""
    rng = random.Random(10)
    plain = lambda n: " ".join(rng.choice(["thon", "rest", "ouble", "ster"]) + rng.choice(["nding", "hert", "anly"]) for _ in range(n))
    toxic = lambda: " ".join(x for w in plain(60).split() for x in ([w, "numskull"] if rng.random() < 0.1 else [w]))
    texts = [toxic() if k % 4 == 0 else plain(60) for k in range(300)]
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(300)] * 2, "doc_id long, quality int, toxic int")
    late = plain(15_000) + " " + " ".join(toxic() for _ in range(1500))
    assert len(plain(15_000)) > 100_000
    base = table(spark, [*texts, late, late, None])
    once = {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(base, labels).collect()}
    twice = toxicity.toxicity_scores(base.unionByName(base.where("doc_id < 9")), labels).collect()
    assert len(twice) == 312 and all(r["score"] == once[r["doc_id"]] for r in twice)
    assert once[300] == once[301] >= 0.5
    few = spark.createDataFrame([(0, 1, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity_scores(base, few).where("score between 0 and 1").count() == 303


def brute_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    import xxhash

    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 3]).encode(), seed=42) for k in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components_against_brute_force(spark, docs):
    rng = random.Random(2)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(rng.randrange(300)) for _ in range(900))
    near = [long.replace(long.split()[k], "changed", 1) for k in (5, 300, 600, 700)]
    given = [r["text"] for r in docs.collect()] + [long, *near, long]
    rows = {r["doc_id"]: r for r in simhash.simhash_components(table(spark, given)).collect()}
    fps = [brute_fingerprint(x) for x in given]
    label = list(range(len(given)))
    for a in range(len(given)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = label[a], label[b]
                label = [min(x, y) if v in (x, y) else v for v in label]
    assert [rows[k]["fingerprint"] for k in range(len(given))] == [f"{x:016x}" for x in fps]
    assert [rows[k]["component_id"] for k in range(len(given))] == label
    assert len(set(label)) < len(label) - 4
    kept = simhash.drop_near_copies(table(spark, given))
    assert {r["doc_id"] for r in kept.collect()} == set(label)
    split = simhash.links(spark.createDataFrame([(simhash.signed(f),) for f in set(fps)], "fp long"), 2, max_shard=1)
    by_fp = {simhash.signed(f): min(k for k in range(len(given)) if fps[k] == f) for f in fps}
    for links in (split, simhash.links(spark.createDataFrame([(f,) for f in by_fp], "fp long"), 2)):
        joined = {r["id"]: r["label"] for r in components(links).collect()}
        for a in by_fp:
            for b in by_fp:
                assert (label[by_fp[a]] == label[by_fp[b]]) == (joined.get(a, a) == joined.get(b, b))
    assert simhash.simhash_components(table(spark, [])).count() == 0


def test_near_copies_keep_rows_of_one_id(spark):
    """A repeated id is judged by each of its texts; rows alike stay together; null ids."""
    rng = random.Random(14)
    a, b, c = (" ".join(f"{x}{rng.randrange(500)}" for _ in range(80)) for x in "abc")
    docs = table(spark, [a, b, a, c, c, a, b, None, ""], [1, 1, 2, 3, 3, None, 5, None, None])
    kept = Counter((r["doc_id"], r["text"]) for r in simhash.drop_near_copies(docs).collect())
    assert kept == Counter({(1, a): 1, (1, b): 1, (3, c): 2, (None, None): 1, (None, ""): 1})
    assert simhash.drop_near_copies(docs).columns == docs.columns
    assert simhash.drop_near_copies(docs.where("false")).count() == 0


def test_bk_tree_and_shards():
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(30)]
    values = [b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(6)]
    tree = simhash.BKTree()
    for x in values:
        tree.add(x)
    for x in values[:50]:
        assert sorted(tree.within(x, 2)) == [k for k, y in enumerate(values) if (x ^ y).bit_count() <= 2]
    masks = simhash.shard_masks(2)
    for x in values[:40]:
        for y in values:
            if (x ^ y).bit_count() <= 2:
                assert any(x & m == y & m for m in masks)


def test_components(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 101), (103, 101), (7, 7)] + [(500, k) for k in range(501, 560)]
    rows = {r["id"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(rows[k] == 0 for k in range(41)) and rows[103] == 100 and all(rows[k] == 500 for k in range(500, 560))


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA).cache()
        seen.append((name, docs.count(), out.count()))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
            docs = out
    counts = {name: (a, b) for name, a, b in seen}
    assert counts["near_copies"][1] < counts["near_copies"][0] and counts["token_ids"][0] == counts["token_ids"][1]
    found = simhash.simhash_components(spark.read.parquet(f"{DATA}/documents.parquet"))
    assert found.select("component_id").distinct().count() == simhash.drop_near_copies(spark.read.parquet(f"{DATA}/documents.parquet")).count()


def walk_components(fps, radius=2):
    label = list(range(len(fps)))
    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = label[a], label[b]
                label = [min(x, y) if v in (x, y) else v for v in label]
    return label


def test_pipeline_against_brute_force(spark, tmp_path):
    """Every stage's rows from the rows before it, walked by hand: repeated and null ids, null and empty texts, copies, test items."""
    import corpus_pipeline
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    rng = random.Random(41)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(400))
    items = [" ".join(word() for _ in range(25)) for _ in range(6)]
    texts = [" ".join(word() for _ in range(rng.randrange(30, 120))) for _ in range(50)]
    texts += [texts[0], texts[1], texts[1], texts[2] + " end", f"{texts[3]} {items[0]} {texts[4]}", items[1].replace(" ", "\n"), None, "", "short", "tie tie", "tie tie"]
    toxic = set(range(4, 50, 6))
    texts = [x if k not in toxic else " ".join(w for y in x.split() for w in ([y, "numskull"] if rng.random() < 0.2 else [y])) for k, x in enumerate(texts)]
    ids = [*range(50), 50, 51, 51, 53, 54, 55, None, 57, None, 59, 59]
    docs = spark.createDataFrame([(i, x, "en", [None, "a", "b"][k % 3], len(x or "")) for k, (i, x) in enumerate(zip(ids, texts, strict=True))], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(k, 1, int(k in toxic)) for k in range(50)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([*enumerate(items)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    plain = lambda df: Counter((r["doc_id"], r["text"], r["source"]) for r in df.collect())
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")

    scores = toxicity.toxicity_scores(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()
    first = stages["toxicity"](spark, docs, str(tmp_path)).cache()
    assert plain(first) == Counter((r["doc_id"], r["text"], r["source"]) for r, s in zip(docs.collect(), scores, strict=True) if not s["predicted"])
    assert 2 <= sum(s["predicted"] for s in scores) <= 10

    rows = list(plain(first).elements())
    label = walk_components([brute_fingerprint(x) for _, x, _ in rows])
    least = {g: min((rows[k][0] for k in range(len(rows)) if label[k] == g and rows[k][0] is not None), default=None) for g in set(label)}
    second = stages["near_copies"](spark, first, str(tmp_path)).cache()
    assert plain(second) == Counter(rows[k] for k in range(len(rows)) if rows[k][0] == least[label[k]])

    def words(x):
        codes, _, flat = decontamination.plain_words(pa.array([x], pa.string()))
        return [flat[c].as_py() for c in codes]

    def copies(x):
        doc = words(x)
        for y in items:
            item = words(y)
            code = {w: c for c, w in enumerate(dict.fromkeys(item + doc))}
            if decontamination.align(np.array([code[w] for w in item]), np.array([code[w] for w in doc], int))[0] >= decontamination.THRESHOLD:
                return True
        return False

    third = stages["decontamination"](spark, second, str(tmp_path)).cache()
    held = {i for i, x, _ in plain(second) if copies(x)}
    assert plain(third) == Counter({k: n for k, n in plain(second).items() if k[0] not in held}) and held

    fourth = stages["mixing"](spark, third, str(tmp_path)).cache()
    taken, given = Counter(), Counter()
    for r in mixing.mix_sources(third).collect():
        taken[r["doc_id"], r["source"]] += r["taken"]
    for i, x, source in plain(fourth).elements():
        given[i, source] += len(x.split())
        assert any(x == y or " ".join((y or "").split()[: len(x.split())]) == x for j, y, z in plain(third) if (j, z) == (i, source))
    assert given == Counter({k: n for k, n in taken.items() if n}) and fourth.columns == docs.columns

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found = Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in stages["token_ids"](spark, fourth, str(tmp_path)).collect())
    encode = lambda x: np.array(tokenizer.encode(x or "", add_special_tokens=False).ids + [2], "<u4")
    assert found == Counter((i, len(encode(x)), zlib.crc32(encode(x).tobytes())) for i, x, _ in plain(fourth).elements())


def test_pipeline_without_documents(spark, tmp_path):
    import corpus_pipeline

    for name, columns in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string"), ("documents", "doc_id long, text string, lang string, source string, n_chars long")):
        spark.createDataFrame([], columns).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_secret_spans_equal_their_sql(spark):
    import duckdb

    from ocrloom.llm import queries

    connection = duckdb.connect()
    connection.sql(f"create view documents as select * from '{DATA}/documents.parquet'")
    wanted = connection.sql(queries.ORACLES["op8_secret_spans"])
    rows = queries.QUERIES["op8_secret_spans"](spark, DATA).select(*wanted.columns).collect()
    assert sorted(map(tuple, rows)) == sorted(wanted.fetchall())
