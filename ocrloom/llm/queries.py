"""The registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .context_tree import lm_scores
from .decontamination import contaminated
from .html_text import html_texts
from .mixing import mix_sources
from .quality import quality_rules
from .secrets import BASE, MORE, secret_spans
from .simhash import simhash_components
from .token_counts import token_counts
from .token_store import token_store
from .toxicity import toxicity_scores


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store(table(spark, sf_dir, "documents"), "word_bpe_49k.json", end_id=2)


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op6_html_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_texts(table(spark, sf_dir, "pages"))


def op8_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), "piece_bpe_32k.model", limit=4096)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"), radius=2, size=3)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), weights=(3, 1, 2), budget=1.5, most=2.0)


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_token_store, op3_quality_rules, op5_lm_scores, op7_token_counts, op10_simhash, op8_secret_spans, op6_html_texts, op9_toxicity, op4_mix_sources)}


def _spans_sql() -> str:
    """The scan in SQL: between the matches lie the pieces of a split, and places are sums of both's lengths."""
    parts = []
    for rank, rule in enumerate(BASE + MORE):
        pattern = rule.pattern.replace("'", "''")
        least = f"where length(regexp_extract_all(t, '{pattern}', {rule.group})[j]) >= {rule.least}" if rule.least else ""
        parts.append(
            f"select doc_id, {rank} as rank, '{rule.kind}' as kind, b, b + length(m[j]) as e from (select doc_id, t, m, j, coalesce(list_sum(list_transform(g[1:j], lambda x: length(x))), 0)::bigint + coalesce(list_sum(list_transform(m[1:j-1], lambda x: length(x))), 0)::bigint as b "
            f"from (select doc_id, t, m, string_split_regex(t, '{pattern}') as g, unnest(range(1, len(m) + 1)) as j from (select doc_id, t, regexp_extract_all(t, '{pattern}') as m from d where regexp_matches(t, '{pattern}')))) {least}"
        )
    line = "coalesce(string_agg(kind || ':' || b || ':' || e, ',' order by b, rank){}, '')"
    counts = ", ".join(f"count(*) filter (where kind = '{r.kind}') as n_{r.kind}" for r in BASE)
    return f"with d as (select doc_id, coalesce(text, '') as t from documents), s as ({' union all '.join(parts)}) select d.doc_id, {counts}, sha256({line.format(' filter (where rank < 3)')}) as base_sha256, {line.format(' filter (where kind is not null)')} as spans from d left join s using (doc_id) group by d.doc_id"


#: The others need hashes, tokenizers, compressors or trees that SQL hasn't got; tests/llm hold them against brute force.
ORACLES: dict[str, str] = {"op8_secret_spans": _spans_sql()}
