"""The registered queries of the corpus operators, with SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from stateglass.llm.common import table
from stateglass.llm.contamination import find_contamination
from stateglass.llm.domain import domain_scores
from stateglass.llm.embeddings import embedding_links
from stateglass.llm.packing import pack_texts
from stateglass.llm.quality import score_quality, train as train_pu_model
from stateglass.llm.registry import QUERIES, query  # noqa: F401
from stateglass.llm.repair import read_token_shards, write_token_shards
from stateglass.llm.simhash import simhash_groups
from stateglass.llm.substring import remove_repeated_passages
from stateglass.llm.toxicity import score_toxicity, train
from stateglass.llm.urls import judge_urls, site_rule
from stateglass.session import work_dir

VOCABULARY = "word_bpe_49k.json"


@query(
    "op1_substring_dedup",
    r"""
    WITH split AS (
        SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
    ), windows AS (
        SELECT doc_id, pos, array_to_string(words[pos + 1 : pos + 20], ' ') AS win
        FROM (SELECT doc_id, words, unnest(range(greatest(len(words) - 19, 0))) AS pos FROM split)
    ), ranked AS (
        SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS nth FROM windows
    ), gone AS (
        SELECT DISTINCT doc_id, unnest(range(pos, pos + 20)) AS p FROM ranked WHERE nth > 1
    ), kept AS (
        SELECT doc_id, string_agg(w, ' ' ORDER BY p) AS kept, count(*) AS n
        FROM (SELECT doc_id, unnest(words) AS w, unnest(range(len(words))) AS p FROM split)
        ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
    )
    SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed,
           sha256(coalesce(kept, '')) AS kept_sha256
    FROM split LEFT JOIN kept USING (doc_id)
    """,
)
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeated_passages(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return cut.select(
        F.col("id").alias("doc_id"),
        "n_words",
        removed.alias("n_removed"),
        F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"),
    )


@query("op9_simhash_groups")
def op9_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_groups(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


@query(
    "op10_embedding_links",
    """
    WITH RECURSIVE usable AS (
        SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
        WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
          AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    ), links AS (
        SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
        ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
        WHERE list_cosine_similarity(a.e, b.e) >= 0.93
    ), reached AS (
        SELECT vec_id AS v, vec_id AS r FROM embeddings
        UNION SELECT links.b, reached.r FROM reached JOIN links ON reached.v = links.a
    ), lowest AS (
        SELECT v, min(r) AS component_id FROM reached GROUP BY v
    ), counted AS (
        SELECT a, count(*) AS n FROM links GROUP BY a
    )
    SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
    FROM embeddings JOIN lowest ON v = vec_id LEFT JOIN counted ON a = vec_id
    """,
)
def op10_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embedding_links(table(spark, sf_dir, "embeddings"))
    return found.select(
        F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept"
    )


@query(
    "op5_benchmark_contamination",
    r"""
    WITH docs AS (
        SELECT doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
        FROM documents
    ), items AS (
        SELECT item_id, words, least(len(words), 10) AS n FROM (
            SELECT item_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
            FROM benchmark)
        WHERE len(words) > 0
    ), grams AS (
        SELECT DISTINCT item_id, n, array_to_string(words[p + 1 : p + n], ' ') AS win
        FROM (SELECT *, unnest(range(len(words) - n + 1)) AS p FROM items)
    ), windows AS (
        SELECT doc_id, p, n, array_to_string(words[p + 1 : p + n], ' ') AS win
        FROM (SELECT *, unnest(range(greatest(len(words) - n + 1, 0))) AS p
              FROM docs CROSS JOIN (SELECT DISTINCT n FROM grams))
    ), found AS (
        SELECT doc_id, p, n, item_id FROM windows JOIN grams USING (n, win)
    ), hit AS (
        SELECT doc_id, count(DISTINCT w) AS n_hit
        FROM (SELECT doc_id, unnest(range(p, p + n)) AS w FROM (SELECT DISTINCT doc_id, p, n FROM found))
        GROUP BY doc_id
    ), named AS (
        SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
        FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM found) GROUP BY doc_id
    )
    SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
           coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
           n_hit IS NOT NULL AS contaminated
    FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
    """,
)
def op5_benchmark_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "found.n_words",
        "found.n_hit",
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("found.n_hit") > 0).alias("contaminated"),
    )


@query("op7_token_shards")
def op7_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = work_dir(spark, "token-shards")
    write_token_shards(table(spark, sf_dir, "documents"), target, public_tokenizers.path(VOCABULARY), end_id=2)
    return read_token_shards(spark, target).select(
        F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


@query("op4_pack_documents")
def op4_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_texts(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
    return pieces.select(
        F.col("id").alias("doc_id"),
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


def id_remainder(column: str, divisor: int):
    """The CRC-32 of an id as text, modulo ``divisor``."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(divisor))


def train_on_learnable(spark: SparkSession, sf_dir: str, docs: DataFrame):
    """A toxicity model of the labels whose remainder by 4 is not 2."""
    labels = table(spark, sf_dir, "labels").where(id_remainder("doc_id", 4) != 2)
    rows = docs.select(F.col("doc_id").alias("id"), "text", "lang")
    return train(rows, labels.select(F.col("doc_id").alias("id"), "toxic"))


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train_on_learnable(spark, sf_dir, docs)
    scored = score_toxicity(docs.select("doc_id", "text", "lang"), model)
    return scored.select(
        "doc_id",
        F.coalesce(id_remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"),
        F.col("toxicity.score").alias("score"),
        (F.col("toxicity.score") >= 0.3).cast("int").alias("predicted"),
        F.col("toxicity.toxic").alias("toxic_for_language"),
    )


@query("op6_quality")
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality")
    positives = labels.where((F.col("quality") == 1) & (id_remainder("id", 5) != 0))
    learnable = docs.where(id_remainder("doc_id", 5) != 0).select(F.col("doc_id").alias("id"), "text")
    net = train_pu_model(learnable, positives, labels)
    return score_quality(docs, net).select(
        "doc_id",
        F.coalesce(id_remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
        F.col("quality").alias("score"),
        (F.col("quality") >= 0.3).cast("int").alias("predicted"),
    )


SITE_RULES = [
    site_rule("allow", "com/"),
    site_rule("block", "example.com/en/"),
    site_rule("allow", "www.example.com/en/"),
    site_rule("block", "net/es/"),
    site_rule("block", "net/fr/"),
]


@query(
    "op8_url_filter",
    r"""
    WITH parsed AS (
        SELECT page_id,
               translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1),
                         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path
        FROM pages
    ), rules(name, verdict) AS (
        VALUES ('com/', 'allow'), ('example.com/en/', 'block'), ('www.example.com/en/', 'allow'),
               ('net/es/', 'block'), ('net/fr/', 'block')
    ), cut AS (
        SELECT name, verdict, split_part(name, '/', 1) AS site, substr(name, strpos(name, '/')) AS start FROM rules
    ), best AS (
        SELECT host, path, arg_max(name, length(name)) AS rule, arg_max(verdict, length(name)) AS verdict
        FROM (SELECT DISTINCT host, path FROM parsed)
        JOIN cut ON (host = site OR suffix(host, '.' || site)) AND starts_with(path, start)
        GROUP BY host, path
    )
    SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN regexp_matches(
        host, '(^|[^a-z0-9])(spam-farm|casino|porn|phishing|malware|warez)($|[^a-z0-9])') THEN 'block' ELSE 'allow' END) AS verdict
    FROM parsed LEFT JOIN best USING (host, path)
    """,
)
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), SITE_RULES)
    return judged.select("page_id", "judged.host", "judged.path", "judged.rule", "judged.verdict")


# The source whose texts are the target of the language models.
DOMAIN_SOURCE = "src1"


@query("op2_domain_scores")
def op2_domain_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return domain_scores(docs, F.col("source") == DOMAIN_SOURCE).withColumnRenamed("id", "doc_id")
