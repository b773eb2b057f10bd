"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kgspark.llm.minhash_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kgspark.llm.suffix_dedup import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents"))


def op3_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kgspark.llm.fingerprints import fingerprints

    return fingerprints(_table(spark, sf_dir, "documents"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kgspark.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents"))


def op5_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kgspark.llm.html_wrappers import main_texts

    return main_texts(_table(spark, sf_dir, "pages"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kgspark.llm.warc import read_warc, write_warc

    got = read_warc(write_warc(_table(spark, sf_dir, "pages")), keep_payload=False)
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kgspark.llm.compact_windows import near_passages

    return near_passages(_table(spark, sf_dir, "documents"))


def op8_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kgspark.llm.decontaminate import contaminated

    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from kgspark.llm.token_output import read_tokens, write_tokens

    return read_tokens(write_tokens(_table(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json"))))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kgspark.llm.quality import classify

    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from kgspark.llm.token_alignment import link_strengths

    return link_strengths(_table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("piece_bpe_32k.model")))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kgspark.llm.filter_audit import interactions

    return interactions(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kgspark.llm.sharding import shards

    return shards(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_minhash_dedup, op2_suffix_dedup, op3_imatch_fingerprints, op4_source_mixing, op5_html_wrappers, op6_warc, op7_compact_windows, op8_cgk_decontamination, op9_token_output, op10_quality_classifier, op11_token_alignment, op12_filter_audit, op13_sampled_splitters)}
ORACLES: dict[str, str] = {
    "op6_warc": """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
 f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f""",
    "op12_filter_audit": r"""WITH l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
 d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
 f AS (SELECT doc_id, part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w),
   100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS fails FROM d LEFT JOIN l USING (doc_id)),
 x AS (SELECT unnest(range(1, 6)) AS i),
 p AS (SELECT a.i AS a, b.i AS b, c.i AS c, e.i AS e, g.i AS g FROM x a, x b, x c, x e, x g WHERE len(list_distinct([a.i, b.i, c.i, e.i, g.i])) = 5),
 o AS (SELECT row_number() OVER () AS k, [a, b, c, e, g] AS o FROM p),
 s AS (SELECT list_aggregate(list_transform(o, lambda i: 'ABCDE'[i]), 'string_agg', '') AS filter_order, i AS step, o[i] AS own, o[1:i - 1] AS before FROM o, x),
 c AS (SELECT part, fails, good, toxic, count(*) AS n FROM f GROUP BY ALL),
 h AS (SELECT part, n, good, toxic, filter_order, step, own, fails[own] AS failing, len(list_filter(before, lambda b: fails[b])) > 0 AS gone, len(list_filter(fails, lambda b: b)) AS many FROM c, s),
 q AS (SELECT part, filter_order, step, own, sum(n) FILTER (WHERE NOT gone AND NOT failing) AS kept, sum(n) FILTER (WHERE failing AND NOT gone) AS removed, sum(n) FILTER (WHERE failing AND gone) AS redundant,
  sum(n) FILTER (WHERE failing AND many = 1) AS unique_fails, sum(n) FILTER (WHERE failing AND NOT gone AND good) AS good_lost, sum(n) FILTER (WHERE failing AND NOT gone AND toxic) AS toxic_lost FROM h GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
 CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
 CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM q""",
    "op13_sampled_splitters": """WITH z AS (SELECT list(v ORDER BY i) AS z FROM (SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v FROM range(256) AS r(i))),
 d AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) + 16 AS BIGINT) AS size, left(md5(coalesce(text, '')), 15) AS key, coalesce(text, '') AS t FROM documents),
 o AS (SELECT *, row_number() OVER w - 1 AS place, CAST(sum(size) OVER w AS BIGINT) AS till, CAST(sum(size) OVER () AS BIGINT) AS total FROM d WINDOW w AS (ORDER BY key, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING)),
 s AS (SELECT *, least((2 * till - size) * 40 // (2 * total), 39) AS own FROM o),
 g AS (SELECT *, CAST(sum(size) OVER k AS BIGINT) AS every, max(till) OVER k AS upto, min(own) OVER k < max(own) OVER k AS parted FROM s WINDOW k AS (PARTITION BY key)),
 m AS (SELECT *, CASE WHEN parted AND every * 8000 <= total THEN least((2 * upto - every) * 40 // (2 * total), 39) ELSE own END AS shard FROM g)
SELECT doc_id, size, 4294967295 - list_reduce([4294967295] || list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda h: CAST('0x' || h AS BIGINT)), lambda c, b: xor(z[1 + xor(c & 255, b)], c >> 8)) AS text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard, CAST(place - min(place) OVER (PARTITION BY shard) AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM m, z""",
}
