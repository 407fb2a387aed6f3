"""The registered queries of the corpus operators, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import documents

#: Bytes of text in a shard of op6.
SHARD_BYTES = 4 << 20
#: The rules of op12: host, path, verdict.
URL_RULES = "('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')"


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract_text

    return extract_text(documents(spark, sf_dir, "pages"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import remove_repeats

    return remove_repeats(documents(spark, sf_dir), window=20).drop("kept_text")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import content_sort_dedup

    return content_sort_dedup(documents(spark, sf_dir), keep="largest")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import jaccard_components

    return jaccard_components(documents(spark, sf_dir), k=3, percent=90)


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .progressive_jpeg import encode_media, read_back

    return read_back(encode_media(documents(spark, sf_dir)))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import held_out, predict, train

    docs = documents(spark, sf_dir).select("doc_id", "text", "lang").withColumn("held_out", held_out())
    return predict(docs, train(docs.filter(~docs["held_out"])), ["doc_id", "held_out"])


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pitman_yor import score_texts

    return score_texts(documents(spark, sf_dir))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_report

    return mix_report(documents(spark, sf_dir), target_entropy=0.95)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_report

    return shard_report(documents(spark, sf_dir), limit=SHARD_BYTES)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import default_vocabulary, pack

    return pack(documents(spark, sf_dir), default_vocabulary(), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    return whiten(documents(spark, sf_dir, "embeddings"), components=32)


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge_urls

    return judge_urls(documents(spark, sf_dir, "pages"), spark.sql(f"SELECT * FROM VALUES {URL_RULES} AS t(host, path, verdict)"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversation_trie import conversation_trie

    return conversation_trie(documents(spark, sf_dir, "conversations"), share=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_media": op2_media,
    "op3_language_id": op3_language_id,
    "op4_lm_score": op4_lm_score,
    "op5_mixing": op5_mixing,
    "op6_sharding": op6_sharding,
    "op7_packing": op7_packing,
    "op8_html_text": op8_html_text,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_whitening": op11_whitening,
    "op12_url_filter": op12_url_filter,
    "op13_conversation_trie": op13_conversation_trie,
}

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
ORACLES: dict[str, str] = {
    "op5_mixing": """
        WITH RECURSIVE docs AS (
            SELECT doc_id, coalesce(source, '') AS source,
                   ('0x' || substr(md5(coalesce(source, '') || '|' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % 256 AS block,
                   len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens
            FROM documents),
        blocks AS (SELECT source, block, sum(n_tokens)::BIGINT AS block_tokens FROM docs GROUP BY 1, 2),
        sources AS (SELECT source, sum(block_tokens)::BIGINT AS tokens FROM blocks GROUP BY 1 HAVING sum(block_tokens) > 0),
        whole AS (SELECT sum(tokens)::DOUBLE AS total, count(*) AS n FROM sources),
        shares AS (SELECT source, tokens, tokens / total AS p FROM sources, whole),
        -- bisection: at each step the entropy at the middle decides which half to keep
        bisect(step, low, high) AS (
            SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
            UNION ALL
            SELECT step + 1, CASE WHEN ok THEN (low + high) / 2 ELSE low END, CASE WHEN ok THEN high ELSE (low + high) / 2 END
            FROM (SELECT step, low, high,
                         (SELECT -sum(w * ln(w)) FROM (SELECT pow(p, (low + high) / 2) / (SELECT sum(pow(q.p, (low + high) / 2)) FROM shares q) AS w FROM shares))
                         >= 0.95::DOUBLE * (SELECT ln(n) FROM whole) - 1e-12::DOUBLE AS ok
                  FROM bisect WHERE step < 60)),
        chosen AS (SELECT CASE WHEN (SELECT -sum(p * ln(p)) FROM shares) >= 0.95::DOUBLE * (SELECT ln(n) FROM whole) - 1e-12::DOUBLE
                               THEN 1.0::DOUBLE ELSE (SELECT round(low, 9) FROM bisect WHERE step = 60) END AS a),
        weights AS (SELECT source, tokens, round(pow(p, a) / sum(pow(p, a)) OVER (), 12) AS weight FROM shares, chosen),
        drawn AS (SELECT source, tokens, weight, floor(weight * total)::BIGINT AS drawn FROM weights, whole),
        planned AS (
            SELECT b.source, b.block, weight, drawn // tokens AS whole_epochs, drawn % tokens AS rest,
                   row_number() OVER o AS block_rank, sum(block_tokens) OVER o AS up_to
            FROM blocks b LEFT JOIN drawn d ON b.source = d.source
            WINDOW o AS (PARTITION BY b.source ORDER BY ('0x' || substr(md5(concat_ws('|', b.source, (drawn // tokens)::VARCHAR, b.block::VARCHAR)), 1, 15))::BIGINT, b.block
                         ROWS UNBOUNDED PRECEDING))
        SELECT doc_id, d.source, n_tokens, d.block, block_rank, round(coalesce(weight, 0), 9) AS weight,
               CASE WHEN weight IS NULL THEN 1 ELSE whole_epochs + CASE WHEN up_to <= rest THEN 1 ELSE 0 END END AS copies
        FROM docs d JOIN planned p ON d.source = p.source AND d.block = p.block""",
    "op6_sharding": f"""
        WITH docs AS (SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes,
                             ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS hash FROM documents),
        levels AS (SELECT d::INTEGER AS depth FROM range(0, 61) t(d)),
        sums AS (SELECT depth, hash >> (60 - depth) AS prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_docs,
                        sum(n_bytes) <= {SHARD_BYTES} OR min(hash) = max(hash) AS fits
                 FROM docs, levels GROUP BY 1, 2),
        leaf AS (SELECT doc_id, n_bytes, hash, min(s.depth) AS depth
                 FROM docs, levels l JOIN sums s ON s.depth = l.depth
                 WHERE s.prefix = hash >> (60 - l.depth) AND s.fits GROUP BY 1, 2, 3)
        SELECT doc_id, n_bytes, CASE WHEN l.depth = 0 THEN '' ELSE left(lpad(bin(hash), 60, '0'), l.depth) END AS shard, l.depth, shard_bytes, shard_docs
        FROM leaf l JOIN sums s ON s.depth = l.depth AND s.prefix = hash >> (60 - l.depth)""",
    "op10_exact_dedup": f"""
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
        FROM (SELECT doc_id, translate(coalesce(text, ''), {_AZ}) AS norm FROM documents)
        WINDOW g AS (PARTITION BY norm)""",
    "op12_url_filter": f"""
        WITH split AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), {_AZ}) AS host,
                              coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
        fitting AS (SELECT page_id, s.host, s.path, r.host || r.path AS rule, r.verdict,
                           row_number() OVER (PARTITION BY page_id, s.host, s.path ORDER BY length(r.host || r.path) DESC) AS n
                    FROM (SELECT DISTINCT * FROM split) s JOIN (VALUES {URL_RULES}) r(host, path, verdict)
                      ON ('.' || s.host) LIKE ('%.' || r.host) AND starts_with(s.path, r.path))
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
        FROM split LEFT JOIN (SELECT * FROM fitting WHERE n = 1) USING (page_id, host, path)""",
    "op13_conversation_trie": """
        WITH t AS (
            SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS r,
                   md5(coalesce(role, '') || chr(1) || coalesce(text, '')) AS k, octet_length(encode(coalesce(text, '')))::BIGINT AS b
            FROM conversations WHERE conv_id IS NOT NULL),
        -- crc32 of the id's digits: each byte is xored in, then eight steps of one bit
        crc AS (
            SELECT c, count(*) AS total, c - c % 5 AS base,
                   xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(c::VARCHAR, ''), lambda x: [ord(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
                       lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END), 4294967295::BIGINT) % 9 AS h
            FROM t GROUP BY c),
        plan AS (SELECT a.c, a.base, a.h, least(a.h, coalesce(b.total, 0)) AS head FROM crc a LEFT JOIN crc b ON a.base = b.c),
        built AS (
            SELECT p.c, r AS d, k, b FROM plan p JOIN t ON t.c = p.base AND r <= h
            UNION ALL SELECT p.c, r - h + head, k, b FROM plan p JOIN t ON t.c = p.c AND r > h),
        firsts AS (
            SELECT c, d, b, md5(string_agg(k, '') OVER (PARTITION BY c ORDER BY d)) AS node FROM built
            UNION ALL SELECT c, 0, 0, 'root' FROM plan),
        linked AS (SELECT *, lag(node) OVER (PARTITION BY c ORDER BY d) AS up, d = max(d) OVER (PARTITION BY c) AS last FROM firsts),
        nodes AS (SELECT node, min(c) AS conv_id, min(d) AS depth, max(up) AS up, count(*) AS n_convs, (count(*) - 1) * max(b) AS saved,
                         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (last), '')) AS ends_sha256 FROM linked GROUP BY node),
        kids AS (SELECT up AS node, count(*) AS n FROM nodes WHERE up IS NOT NULL GROUP BY 1),
        totals AS (
            SELECT l.node, sum(CASE WHEN k.n IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum(n.saved)::BIGINT AS saved_tokens
            FROM nodes n LEFT JOIN kids k ON n.node = k.node JOIN linked l ON l.c = n.conv_id AND l.d <= n.depth GROUP BY 1)
        SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, n_leaves, saved_tokens, n.ends_sha256
        FROM nodes n LEFT JOIN nodes p ON n.up = p.node LEFT JOIN kids k ON n.node = k.node JOIN totals s ON n.node = s.node""",
}
