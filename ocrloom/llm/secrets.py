"""Secret scans by a trigram inverted index, in DataFrame operations alone.

From the regular expression of a rule a Boolean trigram query is derived: an OR of ANDs of trigrams, one AND of which the
text of any match holds (in lower case). Postings of all trigrams that queries ask for are made from the texts; the
trigrams of an AND are intersected by counting their postings of a document. Only the documents that a rule's query
leaves are searched with its expression; a rule without mandatory trigrams searches all.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as parser
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Strings that a run of a pattern may stand for; a run of more isn't asked for.
MAX_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: A group and the characters that it has at least; shorter matches are dropped.
    group: int = 0
    least: int = 0


#: The expressions of the three base kinds.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    # a run of one class that is long enough is the same whether short ones are matched and dropped or never matched
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
#: Forms of well-known keys. What may come before a mark that is searched for has a bounded length, so
#: that no text makes a search start over and over.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("repo_token", r"gh[pousr]_[A-Za-z0-9]{36,255}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,250}"),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,250}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{0,30}://[A-Za-z0-9._%+-]+:[^\x00-\x20@/]+@"),
)


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """ANDs of lower-case trigrams, one of which every match holds; none if the pattern demands no trigram."""
    demands: list[list[frozenset[str]]] = []

    def grams(s: str) -> frozenset[str]:
        return frozenset(s[i : i + 3] for i in range(len(s) - 2))

    def close(run: set[str]) -> None:
        if run and all(len(s) >= 3 for s in run):
            demands.append(sorted({grams(s) for s in run}, key=sorted))

    def strings(items) -> set[str] | None:
        """All strings that a part stands for, if they are few."""
        run = {""}
        for op, value in items:
            if op is sre.LITERAL:
                more = {chr(value).lower()}
            elif op is sre.IN and all(o is sre.LITERAL for o, _ in value):
                more = {chr(v).lower() for _, v in value}
            elif op is sre.SUBPATTERN:
                more = strings(value[3])
            elif op is sre.BRANCH:
                each = [strings(x) for x in value[1]]
                more = None if None in each else set().union(*each)
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[1] is not sre.MAXREPEAT and value[1] <= 3:
                inner = strings(value[2])
                more = None if inner is None else {"".join(s for _ in range(k)) for k in range(value[0], value[1] + 1) for s in inner}
            else:
                more = None
            if more is None or len(run) * len(more) > MAX_STRINGS:
                return None
            run = {a + b for a in run for b in more}
        return run

    def walk(items) -> None:
        run = {""}
        for item in items:
            more = strings([item])
            if more is not None and len(run) * len(more) <= MAX_STRINGS:
                run = {a + b for a in run for b in more}
                continue
            close(run)
            run = {""}
            op, value = item
            if op is sre.SUBPATTERN:
                walk(value[3])
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[0] >= 1:
                walk(value[2])
        close(run)

    walk(parser.parse(pattern))
    ands = [frozenset()]
    for demand in demands:
        if len(ands) * len(demand) <= MAX_STRINGS:
            ands = [a | d for a in ands for d in demand]
    return [a for a in dict.fromkeys(ands) if a]


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once: inside a lambda an expression is computed for each element anew."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


_SPANS = "array<struct<start:int,end:int,part:int>>"


def _placed(rows: Column, start: Column) -> Column:
    """rows (gap, size, part) with their places, the first gap beginning at start."""
    first = F.struct(start.alias("at"), F.array().cast(_SPANS).alias("out"))

    def add(acc: Column, x: Column) -> Column:
        end = acc["at"] + x["gap"] + x["size"]
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), end.alias("end"), x["part"].alias("part")))).alias("out"))

    return F.aggregate(rows, first, add, lambda acc: acc["out"])


def _places(rows: Column) -> Column:
    """_placed() of any number of rows. An array grows by being copied, so rows are placed in stretches of the root of their
    number, each from the sum of those before it."""
    n = F.size(rows)
    width = F.greatest(F.ceil(F.sqrt(n)), F.lit(1)).cast("int")

    def of(r: Column, w: Column) -> Column:
        stretches = F.transform(F.sequence(F.lit(0), F.floor((F.size(r) - 1) / w).cast("int")), lambda k: F.slice(r, k * w + 1, w))
        sums = F.transform(stretches, lambda x: F.struct(x.alias("rows"), F.aggregate(x, F.lit(0), lambda s, y: s + y["gap"] + y["size"]).alias("sum")))
        starts = F.aggregate(sums, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda acc, x: F.struct((acc["at"] + x["sum"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
        return let(sums, lambda parts: F.flatten(F.zip_with(parts, starts, lambda x, at: _placed(x["rows"], at))))

    return F.when(n > 0, let(rows, lambda r: let(width, lambda w: of(r, w)))).otherwise(F.array().cast(_SPANS))


def _matches(text: Column, rule: Rule) -> Column:
    """All leftmost matches that don't overlap, as structs of start and end in characters, those too short left out.

    Between the matches stand the pieces that split() gives; the places are the running sums of the lengths of both.
    """
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    part = found if rule.group == 0 else F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    gaps = F.transform(F.split(text, rule.pattern, -1), lambda g: F.length(g))
    rows = F.zip_with(
        F.zip_with(F.transform(found, lambda m: F.length(m)), gaps, lambda m, g: F.struct(g.alias("gap"), m.alias("size"))), F.transform(part, lambda p: F.length(p)),
        lambda x, p: F.struct(x["gap"].alias("gap"), x["size"].alias("size"), p.alias("part")),
    )
    # behind the last match stands one more piece than there are matches
    placed = let(F.filter(rows, lambda x: x["size"].isNotNull()), _places)
    return F.filter(placed, lambda x: x["part"] >= rule.least) if rule.least else placed


def candidates(docs: DataFrame, rules: tuple[Rule, ...], text_col: str, key: Column) -> DataFrame:
    """key and the kinds of the rules whose trigram query a document meets, for documents that meet any."""
    spark = docs.sparkSession
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    trigrams = sorted({t for q in queries.values() for a in q for t in a})
    terms = [(kind, n, t, len(a)) for kind, q in queries.items() for n, a in enumerate(q) for t in a]
    held = let(F.lower(F.col(text_col)), lambda low: F.filter(F.array(*map(F.lit, trigrams)), lambda t: low.contains(t)))
    postings = docs.select(key.alias("key"), F.explode(held).alias("trigram"))
    # the queries' terms are as many as the rules have, whatever the documents
    asked = F.broadcast(spark.createDataFrame(terms, "kind string, conjunction int, trigram string, needed int"))
    met = postings.join(asked, "trigram").groupBy("key", "kind", "conjunction", "needed").agg(F.count_distinct("trigram").alias("n")).where("n = needed")
    return met.groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def secret_spans(docs: DataFrame, more: tuple[Rule, ...] = MORE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: n_assign, n_access, n_hex, base_sha256, spans (kind:start:end, in characters, end exclusive).

    A null text is the empty text and has no spans. Rows with the same id and text share their candidates and stay rows of
    their own. Spans of different kinds may overlap; of equal starts the kind listed first comes first. An empty table
    gives no rows; further columns are left out. Texts are searched whole; a text of n characters takes about n steps, and
    m matches in it about m to the power of 1.5.
    """
    rules = BASE + more
    source = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    # two documents with one hash only share candidates, and candidates are verified
    keyed = source.withColumn("key", F.xxhash64("i", "t"))
    chosen = candidates(keyed, rules, "t", F.col("key"))
    joined = keyed.join(chosen, "key", "left")

    def spans_of(rule: Rule) -> Column:
        asked = F.array_contains(F.coalesce(F.col("kinds"), F.array().cast("array<string>")), rule.kind) if trigram_query(rule.pattern) else F.col("t").rlike(rule.pattern)
        return F.when(asked, _matches(F.col("t"), rule)).otherwise(F.array().cast(_SPANS))

    searched = joined.select("i", *[spans_of(r).alias(r.kind) for r in rules])

    def ranked(k: int, kind: str) -> Column:
        return F.transform(F.col(kind), lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind")))

    named = {r.kind: ranked(k, r.kind) for k, r in enumerate(rules)}

    def joined_spans(kinds: list[str]) -> Column:
        ordered = F.array_sort(F.concat(*[named[k] for k in kinds]))
        return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    base = [r.kind for r in BASE]
    return searched.select(
        F.col("i").alias(id_col), *[F.size(k).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(joined_spans(base).cast("binary"), 256).alias("base_sha256"), joined_spans([r.kind for r in rules]).alias("spans"),
    )
