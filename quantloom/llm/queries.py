"""The subpackage's queries, each over its whole table, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontaminate, divergence, html_text, jaccard, online_packing, packing, pii, pivots, quality, sharding, spelling, suffixes, token_counts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.top_k(table(spark, sf_dir, "embeddings"))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > 2048)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.deduplicate(table(spark, sf_dir, "documents"))


def op5_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op6_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.scored(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_benchmark_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("word_spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("sign")), lambda a, x: F.struct((a["n"] + a["sign"] * x).alias("n"), (-a["sign"]).alias("sign")), lambda a: a["n"])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def op8_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.interleave(table(spark, sf_dir, "documents"))
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.groups(table(spark, sf_dir, "documents"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op11_level_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return online_packing.pack_stream(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(table(spark, sf_dir, "documents"), misspell=199))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_pivot_search,
        op2_personal_data,
        op3_token_counts,
        op4_suffix_dedup,
        op5_slack_packing,
        op6_quality_scores,
        op7_benchmark_windows,
        op8_interleaved_shards,
        op9_shingle_join,
        op10_main_text,
        op11_level_packing,
        op12_spelling_variants,
        op13_source_divergence,
    )
}

ORACLES: dict[str, str] = {
    "op13_source_divergence": r"""
with docs as (
    select row_number() over () as doc, coalesce(lang, '') as lang, coalesce(source, '') as source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as terms
    from documents
),
groups as (select distinct lang, source from docs),
hits as (select lang, source, doc, unnest(terms) as term from docs),
kept as (select lang, term from hits group by lang, term having count(distinct doc) >= 30),
sizes as (select lang, count(*) as v from kept group by lang),
counts as (select lang, source, term, count(*) as n from hits join kept using (lang, term) group by all),
totals as (select lang, source, sum(n)::bigint as total from counts group by all),
own as (
    select g.lang, g.source, k.term, coalesce(c.n, 0) as n, (1 + 1000000000::hugeint * (coalesce(c.n, 0) + 5) // (coalesce(t.total, 0) + 5 * s.v))::bigint as p
    from groups g join kept k using (lang) join sizes s using (lang) left join counts c on (c.lang, c.source, c.term) = (g.lang, g.source, k.term) left join totals t on (t.lang, t.source) = (g.lang, g.source)
),
whole as (
    select c.lang, c.term, (1 + 1000000000::hugeint * (sum(c.n)::bigint + 5) // (any_value(t.total) + 5 * any_value(s.v)))::bigint as q
    from counts c join (select lang, sum(total)::bigint as total from totals group by lang) t using (lang) join sizes s using (lang) group by c.lang, c.term
),
summed as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p))::bigint as value from own a join own b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select a.lang, a.source, b.source as item, coalesce(s.value, 0) as value from groups a join groups b on a.lang = b.lang and a.source <> b.source left join summed s on (s.lang, s.source, s.item) = (a.lang, a.source, b.source)),
found as (
    select lang, source, 'pair' as part, item, value from pairs
    union all
    select lang, source, 'term' as part, term as item, p - q as value from own join whole using (lang, term) where n > 0 and p > q
)
select lang, source, part, item, value, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank
from found qualify part = 'pair' or rank <= 50
""",
}
