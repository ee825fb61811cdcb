"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, erasure, exact, media, mixing, packing, quality, sharding, simhash, substring, toxicity, warc, whitening
from .common import shared_root


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return warc.build_derivatives(warc.responses_of(pages, warc_date="2024-01-01T00:00:00Z"))


def op3_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"))


def op2_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.stratified_shards(table(spark, sf_dir, "documents"), n_shards=40)
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source", "position")


def op4_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op5_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.repeated_units(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", F.size("spans").alias("n_removed"), removed.alias("removed_chars"), "n_lines", "n_sentences", "n_left", substring.written_out(F.col("spans")).alias("removed_spans"))


def op6_bigru_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    found = toxicity.score_documents(docs, model, threshold=0.7)
    return found.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def target_weights(docs: DataFrame) -> DataFrame:
    """Unequal weights for the sources at hand: 1 to 16, by the hash of the source's name."""
    digit = F.conv(F.substring(F.sha2(F.col("source").cast("binary"), 256), 1, 1), 16, 10).cast("double")
    return docs.select("source").distinct().select("source", (1 + digit).alias("weight"))


def op7_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = mixing.pfair_mix(docs, target_weights(docs), keep=["doc_id", "source"])
    return found.select("doc_id", "source", "__mix.*")


def op8_simhash_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.exact_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op10_wav_landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.media_columns(table(spark, sf_dir, "documents"), with_media=False)
    feature = F.concat_ws(":", "n_peaks", "n_codes", "codes_sha256")
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"), "codes")


def op11_rank_erasure(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_root(spark)}/erased-{uuid.uuid4().hex}"
    found = erasure.erase_clients(*[table(spark, sf_dir, name) for name in ("clients", "clicks", "sales", "sale_lines")], folder)
    return found.select("file_no", "n_rows", "n_erased", "cents", "rewritten", "table_name", "ids_sha256", "columns", "path")


def op12_welford_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten_embeddings(table(spark, sf_dir, "embeddings"))


def op13_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return found.select("row.doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc_derivatives": op1_warc_derivatives,
        "op3_weak_labels": op3_weak_labels,
        "op2_stratified_shards": op2_stratified_shards,
        "op4_prefix_bpe": op4_prefix_bpe,
        "op5_unit_dedup": op5_unit_dedup,
        "op6_bigru_toxicity": op6_bigru_toxicity,
        "op7_pfair_mix": op7_pfair_mix,
        "op8_simhash_links": op8_simhash_links,
        "op9_stream_dedup": op9_stream_dedup,
        "op10_wav_landmarks": op10_wav_landmarks,
        "op11_rank_erasure": op11_rank_erasure,
        "op12_welford_whitening": op12_welford_whitening,
        "op13_bin_completion": op13_bin_completion,
    }


#: Rows with their place in the seeded shuffle of their source, from 0: the signed head of a SHA-256.
_SHUFFLED = """
    SELECT *, row_number() OVER (PARTITION BY key ORDER BY CASE WHEN u >= 9223372036854775808 THEN u::HUGEINT - 18446744073709551616 ELSE u::HUGEINT END) - 1 AS place
    FROM (SELECT *, coalesce('=' || source, '') AS key, ('0x' || substr(sha256('{seed}|' || doc_id || '|' || coalesce(text, '')), 1, 16))::UBIGINT AS u FROM documents)
"""

#: The table of CRC-32, by its rule: eight shifts of each byte.
_CRC_TABLE = "(SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS tab FROM (SELECT unnest(range(256)) AS b))"

SQL = {
    "op2_stratified_shards": rf"""
        WITH s AS ({_SHUFFLED.format(seed=20)}),
        f AS (SELECT *, (place + 0.5::DOUBLE) / count(*) OVER (PARTITION BY key) AS fraction, count(*) OVER () AS n FROM s),
        p AS (SELECT *, row_number() OVER (ORDER BY fraction, key, place) - 1 AS position FROM f),
        d AS (SELECT *, (position * 40) // n AS shard FROM p),
        b AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM documents)
        SELECT d.doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size,
               xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, x: xor(c >> 8, tab[1 + (xor(c, x) & 255)])), 4294967295) AS text_crc32,
               'rows' AS law, CAST(shard AS INTEGER) AS shard, position - CAST(ceil(shard * n / 40::DOUBLE) AS BIGINT) AS slot,
               CAST(NULL AS INTEGER) AS grown_shard, source, position
        FROM d JOIN b ON b.doc_id = d.doc_id, {_CRC_TABLE}
    """,
    "op7_pfair_mix": rf"""
        WITH RECURSIVE s AS ({_SHUFFLED.format(seed=7)}),
        w AS (SELECT key, count(*) AS n, CASE WHEN key = '' THEN 0 ELSE 1 + ('0x' || substr(sha256(substr(key, 2)), 1, 1))::INTEGER END::DOUBLE AS w FROM s GROUP BY key),
        src AS (SELECT key, row_number() OVER (ORDER BY key) AS i, n, (n + 7) // 8 AS b, greatest(1, CAST(round(w / (SELECT sum(w) FROM w) * 1099511627776) AS BIGINT))::HUGEINT AS u FROM w),
        st AS (SELECT u, b, row_number() OVER o AS k, sum(u) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS everyone,
                      coalesce(sum(b) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done
               FROM src WINDOW o AS (ORDER BY b::DOUBLE / u::DOUBLE, i)),
        x AS (SELECT i, u, unnest(range(b)) AS block FROM src),
        jobs AS (SELECT x.i, block,
                   (SELECT arg_min(st.done + (st.everyone * block) // x.u, st.k) FROM st WHERE block * st.u <= st.b * x.u) AS release,
                   (SELECT arg_min(st.done + (st.everyone * (block + 1) + x.u - 1) // x.u, st.k) FROM st WHERE (block + 1) * st.u <= st.b * x.u) AS deadline
                 FROM x),
        queues AS (SELECT list(q ORDER BY i) AS q FROM (SELECT i, list({{'r': release, 'd': deadline}} ORDER BY block) AS q FROM jobs GROUP BY i)),
        run AS (
            SELECT -1::BIGINT AS t, (SELECT list(0::BIGINT) FROM src) AS nxt, 0::BIGINT AS pick
            UNION ALL
            SELECT t + 1, list_transform(nxt, lambda v, j: CASE WHEN j = p THEN v + 1 ELSE v END), p
            FROM (SELECT t, nxt, list_sort(list_filter(list_transform(range(1, len(nxt) + 1),
                      lambda j: CASE WHEN nxt[j] < len(q[j]) THEN {{'waits': q[j][nxt[j] + 1].r > t + 1, 'd': q[j][nxt[j] + 1].d, 'j': j}} END), lambda c: c IS NOT NULL))[1].j AS p
                  FROM run, queues WHERE t + 1 < (SELECT sum(b) FROM src))
        ),
        slots AS (SELECT t AS slot, pick AS i, nxt[pick] - 1 AS block FROM run WHERE t >= 0),
        short AS (SELECT slot, b * 8 - n AS missing FROM slots JOIN src ON src.i = slots.i AND block = b - 1),
        placed AS (SELECT slots.*, slot * 8 - coalesce((SELECT sum(missing) FROM short WHERE short.slot < slots.slot), 0) AS begins FROM slots)
        SELECT s.doc_id, s.source, place // 8 AS block, placed.slot, CAST(jobs.release AS BIGINT) AS release, CAST(jobs.deadline AS BIGINT) AS deadline,
               place % 8 AS "offset", CAST(begins + place % 8 AS BIGINT) AS position
        FROM s JOIN src ON src.key = s.key JOIN placed ON placed.i = src.i AND placed.block = place // 8 JOIN jobs ON jobs.i = src.i AND jobs.block = place // 8
    """,
    "op5_unit_dedup": r"""
        WITH RECURSIVE lines AS (
            SELECT doc_id, l.line AS line, l.k AS k FROM (SELECT doc_id, regexp_extract_all(text, '[^\r\n\x0b\x0c\x{85}\x{2028}\x{2029}]+|[\r\n\x0b\x0c\x{85}\x{2028}\x{2029}]+') AS ls FROM documents),
                LATERAL (SELECT unnest(ls) AS line, generate_subscripts(ls, 1) AS k) AS l
        ), placed AS (
            SELECT *, coalesce(sum(length(line)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM lines
        ), cut AS (  -- a sentence ends behind marks that a blank follows
            SELECT doc_id, k, pos, line, string_split(regexp_replace(line, '([.!?…]+)(\s)', '\1' || chr(1) || '\2', 'g'), chr(1)) AS parts FROM placed WHERE NOT regexp_matches(line, '^[\r\n\x0b\x0c\x{85}\x{2028}\x{2029}]')
        ), parts AS (
            SELECT doc_id, k, pos, line, p.part AS part, p.j AS j FROM cut, LATERAL (SELECT unnest(parts) AS part, generate_subscripts(parts, 1) AS j) AS p
        ), sentences AS (
            SELECT *, pos + coalesce(sum(length(part)) OVER (PARTITION BY doc_id, k ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(part) - length(ltrim(part, E' \t')) AS a,
                   ltrim(part, E' \t') AS own, regexp_extract_all(lower(part), '[\p{L}\p{N}_]+') AS words
            FROM parts
        ), numbered AS (
            SELECT *, a + length(rtrim(own, E' \t')) AS b, row_number() OVER d - 1 AS s, sum(len(words)) OVER d - len(words) AS w0, sum(len(words)) OVER d AS w1, count(*) OVER (PARTITION BY doc_id, k) AS in_line
            FROM sentences WHERE len(words) > 0 WINDOW d AS (PARTITION BY doc_id ORDER BY k, j ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
        ), units AS (
            SELECT doc_id, k, array_to_string(words, ' ') AS unit, false AS is_line, a, b, s AS s0, s AS s1, w0, w1 FROM numbered WHERE in_line > 1
            UNION ALL
            SELECT doc_id, k, array_to_string(flatten(list(words ORDER BY j)), ' '), true, min(a), max(b), min(s), max(s), min(w0), max(w1) FROM numbered GROUP BY doc_id, k
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY unit ORDER BY doc_id, k, is_line, s0) AS r FROM units
        ), again AS (
            SELECT *, coalesce(max(s1) OVER (PARTITION BY doc_id ORDER BY s0, s1 DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -2) AS reach FROM ranked WHERE r > 1
        ), runs AS (
            SELECT *, sum(CASE WHEN s0 > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s0, s1 DESC ROWS UNBOUNDED PRECEDING) AS run FROM again WHERE s1 > reach
        ), judged AS (
            SELECT *, max(w1) OVER (PARTITION BY doc_id, run) - min(w0) OVER (PARTITION BY doc_id, run) >= 12 AS gone FROM runs
        ), g AS (
            SELECT doc_id, string_agg(a || '-' || b, ',' ORDER BY a, b) FILTER (gone) AS spans, count(*) FILTER (gone) AS n, sum(b - a) FILTER (gone) AS chars,
                   count(*) FILTER (gone AND is_line) AS n_lines, count(*) FILTER (NOT gone) AS n_left FROM judged GROUP BY doc_id
        )
        SELECT d.doc_id, CAST(coalesce(n, 0) AS INTEGER) AS n_removed, CAST(coalesce(chars, 0) AS BIGINT) AS removed_chars, coalesce(n_lines, 0) AS n_lines, coalesce(n, 0) - coalesce(n_lines, 0) AS n_sentences,
               coalesce(n_left, 0) AS n_left, coalesce(spans, '') AS removed_spans
        FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id
    """,
    "op9_stream_dedup": r"""
        WITH t AS (
            SELECT doc_id, length(coalesce(text, '')) AS points,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
            FROM documents
        ), k AS (
            SELECT doc_id, text_sha256,
                   first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id,
                   count(*) OVER (PARTITION BY text_sha256) AS group_size
            FROM t
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k
    """,
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
