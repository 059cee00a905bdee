"""Strings: YAML scalars, joining decoded texts, results as text."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tensor import let

MAX_OVERLAP = 32


def yaml_scalar(value: Column) -> Column:
    """Single-quoted ('' stands for '), double-quoted (without escapes) or bare."""
    long = F.length(value) >= 2
    inner = F.substring(value, F.lit(2), F.length(value) - 2)

    def quoted(mark: str, out: Column, name: str) -> Column:
        return F.when(long & value.endswith(mark), out).otherwise(F.raise_error(F.lit(f"unterminated {name}-quoted character")))

    return F.when(value.startswith("'"), quoted("'", F.replace(inner, F.lit("''"), F.lit("'")), "single")).when(value.startswith('"'), quoted('"', inner, "double")).otherwise(value)


def overlap(text: Column, following: Column) -> Column:
    """Characters of the longest end of text that following begins with, MAX_OVERLAP at most."""

    def of(a: Column, b: Column) -> Column:
        most = F.least(F.length(a), F.length(b), F.lit(MAX_OVERLAP))
        fits = let(most, lambda n: F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: (k <= n) & F.endswith(a, F.left(b, k))))
        return F.coalesce(F.array_max(fits), F.lit(0))

    return let(F.right(text, F.lit(MAX_OVERLAP)), lambda a: let(F.left(following, F.lit(MAX_OVERLAP)), lambda b: of(a, b)))


#: A text is cut into stretches of so many pieces, and those again: a place in a string is found by walking to it from the beginning.
STRETCHES = (1024, 32, 1)


def pieces(text: Column, size: int, step: int) -> Column:
    """A text cut into pieces of size characters that begin step characters apart; the last may be shorter. An empty text has one."""
    last = F.greatest(F.ceil((F.length(text) - size) / step), F.lit(0)).cast("int")

    def cut(text: Column, last: Column, per: int, *finer: int) -> Column:
        def stretch(first: Column) -> Column:
            own = F.substring(text, first * step + 1, F.lit((per - 1) * step + size))
            return let(own, lambda t: let(F.least(last - first, F.lit(per - 1)), lambda n: cut(t, n, *finer))) if finer else own

        out = F.transform(F.sequence(F.lit(0), last, F.lit(per)), stretch)
        return F.flatten(out) if finer else out

    return let(text, lambda t: let(last, lambda n: cut(t, n, *STRETCHES)))


def joined_texts(parts: Iterable[tuple[str | None, float | None]]) -> tuple[str | None, float | None]:
    """What joined() makes of the parts, in time that grows with their length."""
    texts, tail, total, weight, null = [], "", 0.0, 0, False
    for text, score in parts:
        if text is None:
            null = True
        elif not null:
            # ends of the tail that begin as the text does, the longest first
            shared, at = 0, tail.find(text[:1]) if text else -1
            while at >= 0:
                if text.startswith(tail[at:]):
                    shared, at = len(tail) - at, -1
                else:
                    at = tail.find(text[:1], at + 1)
            rest = text[shared:]
            texts.append(rest)
            tail, weight = (tail + rest)[-MAX_OVERLAP:], weight + len(rest)
            total = None if total is None or score is None else total + score * len(rest)
    if null:
        return None, 0.0
    return "".join(texts), 0.0 if not weight else total if total is None else total / weight


def joined(parts: Column) -> Column:
    """An array of structs (text, score), in order, as one struct (text, score): overlaps stand once, the score is the mean
    over the characters that each part adds, 0 if none adds any. Of what has been joined only the end is looked at."""
    start = F.struct(F.lit("").alias("text"), F.lit("").alias("tail"), F.lit(0.0).alias("sum"), F.lit(0).alias("weight"))

    def grown(acc: Column, part: Column, shared: Column, rest: Column) -> Column:
        added = F.length(part["text"]) - shared
        return F.struct(F.concat(acc["text"], rest).alias("text"), F.right(F.concat(acc["tail"], rest), F.lit(MAX_OVERLAP)).alias("tail"), (acc["sum"] + part["score"] * added).alias("sum"), (acc["weight"] + added).alias("weight"))

    def add(acc: Column, part: Column) -> Column:
        rest = lambda shared: F.substring(part["text"], shared + 1, F.length(part["text"]))
        return let(overlap(acc["tail"], part["text"]), lambda shared: let(rest(shared), lambda r: grown(acc, part, shared, r)))

    return F.aggregate(parts, start, add, lambda acc: F.struct(acc["text"].alias("text"), F.when(acc["weight"] > 0, acc["sum"] / acc["weight"]).otherwise(0.0).alias("score")))


def result_text(lines: Column) -> Column:
    """Texts of the lines that have one, a line each."""
    return F.array_join(F.transform(F.filter(lines, lambda x: x["text"] != ""), lambda x: x["text"]), "\n")
