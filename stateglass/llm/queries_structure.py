"""The registered queries of conversations, shards and manifests, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stateglass.llm.common import table
from stateglass.llm.conversations import repair_conversations
from stateglass.llm.manifest import leaf_digest, merkle_manifest
from stateglass.llm.registry import query
from stateglass.llm.sharding import shard_rows

# CRC-32 of ASCII text in SQL that has no such function.
CRC32_SQL = """xor(list_reduce(
    list_concat([4294967295::BIGINT], list_transform(range(1, len({0}) + 1), lambda i: ascii(substr({0}, i, 1))::BIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0],
                             lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with the faults that the CRC-32 of ``conv_id:turn`` deals out."""

    def spaced(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    key = F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))
    dealt = rows.select(
        "conv_id",
        "turn",
        spaced("role").alias("role"),
        spaced("text").alias("text"),
        (F.crc32(key.cast("binary")) % 20).alias("fault"),
    )
    text = F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.translate("text", ".!?", ""))
    role = F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.array_repeat(F.lit(0), F.when(F.col("fault") == 0, 0).when(F.col("fault") == 3, 2).otherwise(1))
    return dealt.select(
        "conv_id", "turn", role.alias("role"), text.otherwise(F.col("text")).alias("text"), F.explode(copies).alias("copy")
    ).drop("copy")


@query(
    "op11_repair_conversations",
    r"""
    WITH RECURSIVE dealt AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, CRC % 20 AS fault
        FROM (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations)
    ), damaged AS (
        SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
               CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
        FROM dealt, range(2) AS t(copy) WHERE copy < CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END
    ), placed AS (
        SELECT *, rtrim(text, E' \t\n\x0B\x0C\r') AS ending, left(role, 1) AS initial,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS pos
        FROM damaged
    ), counted AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) AS seen FROM placed
    ), faulty AS (
        SELECT *, ending = '' AS blank, ending <> '' AND seen > 1 AS duplicate,
               ending <> '' AND seen = 1 AND right(ending, 1) NOT IN ('.', '!', '?') AS truncated,
               lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) || initial AS pair
        FROM counted
    ), stats AS (
        SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
               count_if(blank) AS blank, count_if(duplicate) AS duplicate, count_if(truncated) AS truncated,
               count_if(pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
        FROM faulty GROUP BY conv_id
    ), moves(s, t, price, edits, added) AS (
        VALUES (0, 0, 0, '', []::VARCHAR[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []),
               (0, 2, 3, 'I', ['user:']), (1, 2, 3, 'I', ['user:']), (3, 2, 3, 'I', ['user:']),
               (2, 3, 3, 'I', ['assistant:']), (0, 3, 6, 'II', ['user:', 'assistant:']), (1, 3, 6, 'II', ['user:', 'assistant:'])
    ), kept(s, initial, t) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
    steps AS (
        SELECT conv_id, pos, s, s AS t, 4 AS price, 'D' AS edit, []::VARCHAR[] AS said FROM faulty, range(4) AS r(s)
        UNION ALL
        SELECT conv_id, pos, s, CASE s WHEN 2 THEN 3 ELSE 2 END, 3 + 3 * truncated::INT, 'R',
               [CASE s WHEN 2 THEN 'assistant:' ELSE 'user:' END || text]
        FROM faulty, range(4) AS r(s) WHERE NOT blank AND NOT duplicate
        UNION ALL
        SELECT conv_id, pos, s, t, 3 * truncated::INT, 'K', [role || ':' || text]
        FROM faulty JOIN kept USING (initial) WHERE NOT blank AND NOT duplicate
    ), found AS (
        SELECT conv_id, 0 AS i, 0 AS state, {'cost': 0, 'audit': '', 'said': []::VARCHAR[]} AS best FROM stats
        UNION ALL
        SELECT f.conv_id, i + 1, steps.t, min({'cost': best.cost + moves.price + steps.price,
            'audit': best.audit || edits || edit, 'said': list_concat(list_concat(best.said, added), steps.said)})
        FROM found f JOIN moves ON moves.s = state
        JOIN steps ON steps.conv_id IS NOT DISTINCT FROM f.conv_id AND steps.pos = i + 1 AND steps.s = moves.t
        GROUP BY f.conv_id, i, steps.t
    ), ended AS (
        SELECT f.conv_id, min({'cost': best.cost + price, 'audit': best.audit || edits,
                               'said': list_concat(best.said, added)}) AS best
        FROM found f JOIN moves ON s = state JOIN stats ON stats.conv_id IS NOT DISTINCT FROM f.conv_id AND n = i
        WHERE t IN (0, 3) GROUP BY f.conv_id
    )
    SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
           coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
           coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.cost, 0)::BIGINT AS cost,
           coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.said, E'\n'), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) c
    LEFT JOIN stats ON stats.conv_id IS NOT DISTINCT FROM c.conv_id
    LEFT JOIN ended ON ended.conv_id IS NOT DISTINCT FROM c.conv_id
    """.replace("CRC", CRC32_SQL.format("k")),
)
def op11_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    fixed = repair_conversations(damaged(rows)).withColumn("key", F.struct("conv_id")).drop("conv_id")
    # Conversations that lost every row are there too.
    every = rows.select("conv_id").distinct().withColumn("key", F.struct("conv_id"))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return every.join(fixed, "key", "left").select(
        "conv_id",
        *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


@query("op12_shard_documents")
def op12_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        F.col("id").alias("doc_id"),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def framed_sql(text: str = "text") -> str:
    values = [f"{text if f == 'text' else f}::VARCHAR" for f in FIELDS]
    return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"


@query(
    "op13_merkle_manifest",
    f"""
    WITH RECURSIVE leaves AS (
        SELECT *, row_number() OVER (ORDER BY doc_id) AS row, dense_rank() OVER (ORDER BY source NULLS FIRST) AS tree,
               {framed_sql()} AS leaf,
               CASE WHEN CRC % 2 = 0 THEN {framed_sql("replace(text, chr(10), '')")} ELSE {framed_sql()} END AS claim
        FROM (SELECT *, doc_id::VARCHAR AS k FROM documents)
    ), placed AS (
        SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
               count(*) OVER (PARTITION BY tree) AS n
        FROM leaves
    ), up AS (
        SELECT tree, 0 AS lvl, place, leaf AS h, n FROM placed
        UNION ALL
        SELECT tree, lvl + 1, place // 3, sha256(string_agg(h, '' ORDER BY place)), (max(n) + 2) // 3
        FROM up WHERE n > 1 GROUP BY tree, lvl, place // 3
    ), subroots AS (
        SELECT tree, h AS subroot FROM up WHERE n = 1
    ), top AS (
        SELECT 0 AS tree, 0 AS lvl, tree - 1 AS place, subroot AS h, (SELECT count(*) FROM subroots) AS n FROM subroots
        UNION ALL
        SELECT 0, lvl + 1, place // 3, sha256(string_agg(h, '' ORDER BY place)), (max(n) + 2) // 3
        FROM top WHERE n > 1 GROUP BY lvl, place // 3
    ), runs AS (
        SELECT tree, lvl, place // 3 AS run, list(h ORDER BY place) AS hs
        FROM (FROM up UNION ALL FROM top) WHERE n > 1 GROUP BY tree, lvl, place // 3
    ), walk AS (
        SELECT row, tree, 0 AS lvl, place, n, claim AS node, '' AS proof FROM placed
        UNION ALL
        SELECT row, CASE WHEN n = 1 THEN 0 ELSE w.tree END, CASE WHEN n = 1 THEN 0 ELSE w.lvl + 1 END,
               CASE WHEN n = 1 THEN w.tree - 1 ELSE place // 3 END,
               CASE WHEN n = 1 THEN (SELECT count(*) FROM subroots) ELSE (n + 2) // 3 END,
               CASE WHEN n = 1 THEN node ELSE sha256(array_to_string(hs[1 : place % 3], '') || node || array_to_string(hs[place % 3 + 2 :], '')) END,
               CASE WHEN n = 1 THEN proof ELSE proof || array_to_string(hs[1 : place % 3], '') || array_to_string(hs[place % 3 + 2 :], '') END
        FROM walk w LEFT JOIN runs r ON r.tree = w.tree AND r.lvl = w.lvl AND r.run = place // 3 AND n > 1
        WHERE n > 1 OR w.tree <> 0
    )
    SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, node AS folded_root, node = root AS verified
    FROM placed JOIN subroots USING (tree) JOIN walk ON walk.row = placed.row AND walk.tree = 0 AND walk.n = 1,
         (SELECT h AS root FROM top WHERE n = 1)
    """.replace("CRC", CRC32_SQL.format("k")),
)
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.when(tampered, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    rest = [F.col(f) for f in FIELDS if f != "text"]
    leaves = docs.select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("tree"),
        leaf_digest(*rest, F.col("text")).alias("leaf"),
        leaf_digest(*rest, text).alias("claim"),
    )
    return merkle_manifest(leaves).select(
        F.col("id").alias("doc_id"),
        *[F.lower(F.hex(c)).alias(c) for c in ("leaf", "subroot", "root")],
        F.sha2(F.lower(F.hex("witness")).cast("binary"), 256).alias("proof_sha256"),
        F.lower(F.hex("folded")).alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )
