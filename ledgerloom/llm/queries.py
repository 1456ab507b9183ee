"""The driver's queries for the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import ann, decontamination, hard_negatives, language, licenses, near_dedup, packing, quality, repair, sharding, token_counts, toxicity, warc
from ledgerloom.session import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TOKENIZER = "word_bpe_49k.json"


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(parts: int) -> F.Column:
    """The remainder of crc32(doc_id as text) that splits rows into training and held-out ones."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(parts))


def held_out(parts: int, remainder: int) -> F.Column:
    """Whether a row is in the fold that nothing is learned from; rows without an id are in none."""
    return F.coalesce(fold(parts) == remainder, F.lit(False)).alias("held_out")


@query("op1_pack")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), with_ids=False)
    return packed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket"
    )


@query("op2_token_counts")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), limit=2048)


@query(
    "op3_warc",
    """
    WITH p AS (
        SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
        FROM pages
    ), f AS (SELECT payload_digest, min(page_id) AS first FROM p GROUP BY 1)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
    FROM p JOIN f USING (payload_digest)
    """,
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    path = shared_dir(spark, "warc")
    warc.write_archive(pages, path)
    return warc.read_archive(spark, path).select(
        "page_id",
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"),
        "record_type",
        F.col("refers_to").cast(dict(pages.dtypes)["page_id"]).alias("refers_to"),
    )


@query("op4_nearest")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


@query("op5_shards")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32")
    )
    sharded = sharding.shard_rows(docs, ["doc_id", "text_crc32", "size"], shards=8)
    return sharded.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


LOWER_LATIN = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op6_near_duplicates",
    rf"""
    WITH RECURSIVE w AS (
        SELECT doc_id, regexp_extract_all({LOWER_LATIN}, '[^\x20\x09-\x0D]+') AS ws FROM documents
    ), s AS (
        SELECT DISTINCT doc_id, array_to_string(ws[k:k + 2], ' ') AS g
        FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS k FROM w WHERE len(ws) > 0)
    ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    p AS (
        SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
        FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
    ), e AS (
        SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
    ), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    r(node, root) AS (
        SELECT doc_id, doc_id FROM documents UNION SELECT u.b, r.root FROM r JOIN u ON r.node = u.a
    ), m AS (SELECT node, min(root) AS c FROM r GROUP BY 1)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
    FROM documents d JOIN m ON m.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
    """,
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


@query("op7_language")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit_languages(docs, fold(4) != 2)
    found = language.identify(docs, model, with_spans=False)
    return found.select("doc_id", held_out(4, 2), "lang_pred", "score")


@query("op8_quality")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"), fold(3) != 1)
    return quality.score_quality(docs, model).select("doc_id", held_out(3, 1), "score", "predicted")


WORDS = rf"regexp_extract_all({LOWER_LATIN}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query(
    "op9_decontaminate",
    rf"""
    WITH d AS (SELECT doc_id, {WORDS} AS ws FROM documents),
    i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {WORDS} AS ws FROM benchmark WHERE item_id IS NOT NULL),
    wins AS (
        SELECT DISTINCT item_id, sz, array_to_string(ws[k:k + sz - 1], ' ') AS g
        FROM (SELECT item_id, ws, least(10, len(ws)) AS sz, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS k
              FROM i WHERE len(ws) > 0)
    ), sizes AS (SELECT DISTINCT sz FROM wins),
    grams AS (
        SELECT doc_id, k, sz, array_to_string(ws[k:k + sz - 1], ' ') AS g
        FROM (SELECT doc_id, ws, sz, unnest(range(1, len(ws) - sz + 2)) AS k FROM d JOIN sizes ON len(ws) >= sz)
    ), h AS (SELECT doc_id, k, sz, item_id FROM grams JOIN wins USING (sz, g)),
    c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(k, k + sz)) AS p FROM h) GROUP BY 1),
    t AS (
        SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids
        FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY 1
    )
    SELECT d.doc_id, len(ws) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items,
           sha256(coalesce(t.ids, '')) AS items_sha256, c.n IS NOT NULL AS contaminated
    FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
    """,
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


@query("op10_licenses")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def damaged(conversations: DataFrame) -> tuple[DataFrame, F.Column]:
    """Rows with the faults that crc32(``conv_id:turn``) % 20 deals out, and how many copies of each there are."""
    space = F.lit(" ")
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")))
    fault, text = F.crc32(key.cast("binary")) % 20, F.coalesce("text", space)
    rows = conversations.select(
        "conv_id",
        "turn",
        F.when(fault == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies"),
    )
    return rows, F.col("copies")


@query(
    "op11_repair",
    r"""
    WITH RECURSIVE b AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
        FROM conversations
    ), c AS (
        -- CRC-32 bit by bit: a byte is xored in, then eight shifts follow.
        SELECT *, (xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(k) + 1),
                   lambda i: [ascii(k[i])::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
                   lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) ELSE xor(x >> 1, (x & 1) * 3988292384) END), 4294967295)) % 20 AS f
        FROM b
    ), d AS (
        SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
               CASE f WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, copy
        FROM c, (SELECT unnest([1, 2]) AS copy) WHERE copy <= CASE f WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END
    ), o AS (
        SELECT *, row_number() OVER w AS p, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
               lag(role[1]) OVER w AS before, rtrim(text, E' 	

') AS bare
        FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy)
    ), s AS (
        SELECT *, role[1] AS r, CASE WHEN bare = '' THEN 1 WHEN seen > 1 THEN 2 WHEN bare[-1] NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault
        FROM o
    ), n AS (
        SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
               count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
               count(*) FILTER (before || r NOT IN ('su', 'ua', 'au')) AS illegal
        FROM s GROUP BY conv_id
    ), t AS (SELECT n.conv_id AS conv, p, r, fault FROM s JOIN n ON n.conv_id IS NOT DISTINCT FROM s.conv_id),
    -- Least (cost, audit) from row p on, in each grammar state: start, after s, after u, after a.
    g(conv, p, f0, f1, f2, f3) AS (
        SELECT conv_id, n + 1, (0::BIGINT, ''), (10::BIGINT, 'II'), (5::BIGINT, 'I'), (0::BIGINT, '') FROM n
        UNION ALL
        SELECT conv, p, least(e0, i2), least(e1, i2), least(e2, (e3[1] + 5, 'I' || e3[2]), (i2[1] + 5, 'I' || i2[2])), least(e3, i2)
        FROM (
            SELECT *, least((e2[1] + 5, 'I' || e2[2]), (e3[1] + 10, 'II' || e3[2])) AS i2
            FROM (
                SELECT g.conv, t.p,
                       least((f0[1] + 2, 'D' || f0[2]), (f2[1] + 1 + x, 'R' || f2[2]), (f1[1] + x + s, 'K' || f1[2]), (f2[1] + x + u, 'K' || f2[2])) AS e0,
                       least((f1[1] + 2, 'D' || f1[2]), (f2[1] + 1 + x, 'R' || f2[2]), (f2[1] + x + u, 'K' || f2[2])) AS e1,
                       least((f2[1] + 2, 'D' || f2[2]), (f3[1] + 1 + x, 'R' || f3[2]), (f3[1] + x + a, 'K' || f3[2])) AS e2,
                       least((f3[1] + 2, 'D' || f3[2]), (f2[1] + 1 + x, 'R' || f2[2]), (f2[1] + x + u, 'K' || f2[2])) AS e3
                FROM g JOIN (
                    -- What it costs to leave the row, and to keep it where s, u or a is wanted; a billion where that is not allowed.
                    SELECT *, CASE fault WHEN 0 THEN 0 WHEN 3 THEN 5 ELSE 1000000000 END AS x, CASE r WHEN 's' THEN 0 ELSE 1000000000 END AS s,
                           CASE r WHEN 'u' THEN 0 ELSE 1000000000 END AS u, CASE r WHEN 'a' THEN 0 ELSE 1000000000 END AS a
                    FROM t
                ) AS t
                  ON t.conv IS NOT DISTINCT FROM g.conv AND t.p = g.p - 1
            )
        )
    ), a AS (SELECT conv, f0[1] AS cost, f0[2] AS audit FROM g WHERE p = 1),
    e AS (
        SELECT conv, i, audit[i] AS edit, length(replace(audit[:i], 'I', '')) AS p, length(replace(audit[:i], 'D', '')) AS q
        FROM (SELECT conv, audit, unnest(range(1, length(audit) + 1)) AS i FROM a)
    ), h AS (SELECT e.*, s.role, s.text, s.r FROM e LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM e.conv AND s.p = e.p AND edit <> 'I' WHERE edit <> 'D'),
    z AS (SELECT conv, bool_or(q = 1 AND edit = 'K' AND r = 's') AS has_system FROM h GROUP BY conv),
    y AS (
        SELECT h.conv, string_agg(CASE edit WHEN 'K' THEN role WHEN 'R' THEN turned ELSE turned END || ':' ||
                                  CASE edit WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY i) AS whole
        FROM (SELECT h.*, CASE WHEN (q % 2 = 1) <> has_system THEN 'user' ELSE 'assistant' END AS turned
              FROM h JOIN z ON z.conv IS NOT DISTINCT FROM h.conv) AS h GROUP BY h.conv
    )
    SELECT o.conv_id, coalesce(n.gaps, 0) AS gaps, coalesce(n.blank, 0) AS blank, coalesce(n.duplicate, 0) AS duplicate,
           coalesce(n.truncated, 0) AS truncated, coalesce(n.illegal, 0) AS illegal, coalesce(a.cost, 0)::BIGINT AS cost,
           coalesce(a.audit, '') AS audit, sha256(coalesce(y.whole, '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) AS o
    LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM o.conv_id
    LEFT JOIN a ON a.conv IS NOT DISTINCT FROM o.conv_id
    LEFT JOIN y ON y.conv IS NOT DISTINCT FROM o.conv_id
    """,
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, copies = damaged(table(spark, sf_dir, "conversations"))
    return repair.Repair(rows, copies=copies).summary()


@query("op12_toxicity")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"), fold(5) != 0)
    found = toxicity.score_toxicity(docs, model)
    return found.select("doc_id", held_out(5, 0), "score", "predicted")


@query(
    "op13_hard_negatives",
    """
    WITH q AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
        FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), s AS (
        SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
        FROM q AS a JOIN q AS b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
    ), p AS (
        SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
    )
    SELECT p.anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
    WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id)
    QUALIFY row_number() OVER w <= 3
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", moved.alias("label"), "embedding")
    return hard_negatives.hard_negatives(rows, F.col("id") % 50 == 0)
