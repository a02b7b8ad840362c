"""The registered queries over the documents and pages tables; each goes through its operator, whole table, whole texts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.llm import bitsliced, langid, line_dedup, manifest, media, mixing, mtree, pieces, quality, simhash, token_counts, warc, weighted_sampling
from netquarry.llm.common import cut_lineage


#: The letters that contracts lower-case.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op2_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits a second copy of the archive of all pages, in which pages have another first character where a sum of their lengths is 3 modulo 97."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    body = F.coalesce("html", F.lit(""))
    rotten = (F.octet_length(F.coalesce("url", F.lit(""))) * 31 + F.octet_length(body)) % 97 == 3
    copy = warc.record(F.col("url"), F.when(rotten, F.concat(F.lit("?"), F.substring(body, 2, 1 << 30))).otherwise(body))
    read = pages.select("page_id", "url", warc.record(F.col("url"), body).alias("record"), F.sha2(copy, 256).alias("copy_sha256"), F.octet_length(copy).cast("long").alias("copy_bytes"))
    listed = cut_lineage(warc.manifest(read, "record", "page_id", "url"))
    audited = warc.audit(listed.drop("copy_sha256", "copy_bytes"), listed.select("ordinal", F.col("copy_sha256").alias("sha256"), F.col("copy_bytes").alias("bytes")))
    return audited.select("page_id", "file", "begin", "end", "sha256", "damaged")


def op3_iso_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """feature: codec, duration, how many of the samples are keyframes, and a hash of the keyframes' byte ranges.

    All of it comes from the sample tables; the method never looks into a payload, so texts of one length have one feature.
    """
    found = media.containers(documents(spark, sf_dir), keep_media=False)
    ranges = F.sha2(F.concat_ws(",", F.zip_with("key_begins", "key_ends", lambda a, b: F.concat_ws("-", a.cast("string"), b.cast("string")))), 256)
    return found.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256",
        F.concat_ws(";", "codec", F.concat_ws("/", F.col("duration").cast("string"), F.col("timescale").cast("string")), F.concat_ws(" of ", F.size("key_begins").cast("string"), F.col("n_samples").cast("string")), ranges).alias("feature"))


def op4_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_sampling.with_edits(documents(spark, sf_dir))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = documents(spark, sf_dir).select("doc_id", "text")
    return line_dedup.apply(df, line_dedup.bitmaps(df)).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir), words_in_shingle=3)
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = documents(spark, sf_dir)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    profiles = langid.train(df, "doc_id", "text", "lang", ~held_out)
    return langid.predict(df, profiles).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(documents(spark, sf_dir))
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op10_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = documents(spark, sf_dir)
    model, weights = quality.fit(df)
    return quality.score(df, model, weights).select("doc_id", "posterior", "score", (F.col("score") >= 0.5).alias("keep"))


def op8_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pieces.encode(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.element_at("ends", -1) == F.col("n_bytes")).alias("spans_reach_end"))


def op11_bitsliced_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitsliced.rank(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=50)


def op12_mtree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", mtree.scaled(F.col("embedding")).alias("v"))
    found = mtree.top_k(vectors, "vec_id", "v", F.col("vec_id") % 50 == 0, k=5)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tampering goes by the digest of the lower-cased text; a null doc_id is never tampered with."""
    df = documents(spark, sf_dir)
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    lowered = F.translate("text", UPPER, UPPER.lower())
    leaves = df.select("doc_id", "lang", manifest.leaf(*fields, F.col("text")).alias("leaf"), F.when(tampered, manifest.leaf(*fields, lowered)).alias("tampered"))
    found = manifest.manifest(leaves, "lang", "doc_id")
    proof = F.zip_with("lefts", "rights", lambda a, b: F.concat(a, b))
    found = found.withColumns({"proof_sha256": F.sha2(F.concat_ws("", proof), 256), "folded_root": manifest.folded(F.coalesce("tampered", "leaf"), F.col("lefts"), F.col("rights"))})
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_warc_audit": op2_warc_audit,
    "op3_iso_media": op3_iso_media,
    "op4_weighted_sampling": op4_weighted_sampling,
    "op5_line_dedup": op5_line_dedup,
    "op6_simhash": op6_simhash,
    "op7_language_id": op7_language_id,
    "op8_piece_encoding": op8_piece_encoding,
    "op9_mixing": op9_mixing,
    "op10_weak_quality": op10_weak_quality,
    "op11_bitsliced_search": op11_bitsliced_search,
    "op12_mtree_search": op12_mtree_search,
    "op13_merkle_manifest": op13_merkle_manifest,
}


def _record_sql(body: str) -> str:
    line = "' || chr(13) || chr(10) || '"
    return (
        f"'WARC/1.0{line}WARC-Type: resource{line}WARC-Record-ID: <urn:sha256:' || sha256(url || ' ' || {body}) || '>{line}WARC-Date: {warc.DATE}{line}WARC-Target-URI: ' || url || '"
        f"{line}Content-Type: text/html{line}WARC-Block-Digest: sha256:' || sha256({body}) || '{line}Content-Length: ' || strlen({body}) || '{line}{line}' || {body} || '{line}{line}'")


def _field_sql(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR) || ':' || {column}, '-')"


_HEAD_SQL = " || ".join(_field_sql(c) for c in ("doc_id", "source", "lang", "n_chars"))
_LOWER_SQL = f"translate(text, '{UPPER}', '{UPPER.lower()}')"
_TERMS_SQL = rf"unnest(regexp_extract_all({_LOWER_SQL}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"
#: A byte's part of CRC-32, bit by bit, over the digits of a number.
_CRC_SQL = (
    "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), "
    "lambda crc, c: list_reduce([xor(crc, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, _: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))")


def _tree_sql(leaves: str, tree: str) -> str:
    """Levels of the trees of leaves (tree, idx, hash), each with its width, up to the roots."""
    return f"""{tree} AS (
            SELECT tree, 0 AS level, idx, hash, count(*) OVER (PARTITION BY tree) AS width FROM {leaves}
            UNION ALL SELECT tree, any_value(level) + 1, idx // 8, sha256(string_agg(hash, '' ORDER BY idx)), (any_value(width) + 7) // 8 FROM {tree} WHERE width > 1 GROUP BY tree, idx // 8)"""


#: DuckDB SQL for the queries that SQL can express.
SQL: dict[str, str] = {
    "op11_bitsliced_search": f"""
        WITH words AS (SELECT row_number() OVER () AS row, doc_id, {_TERMS_SQL.replace('text', "coalesce(text, '')")} AS term FROM documents),
        lengths AS (SELECT row, count(*) AS n FROM words GROUP BY 1),
        totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM lengths),
        wanted AS (SELECT DISTINCT item_id, {_TERMS_SQL} AS term FROM benchmark),
        counts AS (SELECT row, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM wanted) GROUP BY row, term),
        weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM counts, totals GROUP BY term, docs),
        parts AS (SELECT row, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))) AS part FROM counts JOIN lengths USING (row) JOIN weights USING (term), totals),
        scores AS (SELECT item_id, row, any_value(doc_id) AS doc_id, sum(part)::BIGINT AS score FROM parts JOIN wanted USING (term) GROUP BY item_id, row),
        ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST)::INT AS rank, doc_id, score FROM scores WHERE score > 0)
        SELECT * FROM ranked WHERE rank <= 50""",
    "op12_mtree_search": """
        WITH whole AS (
            SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        ranked AS (
            SELECT q.vec_id AS query_id, row_number() OVER (PARTITION BY q.row ORDER BY list_inner_product(q.v, x.v) DESC, x.vec_id, x.row)::INT AS rank, x.vec_id, list_inner_product(q.v, x.v)::BIGINT AS score
            FROM whole q JOIN whole x ON q.vec_id % 50 = 0 AND q.row <> x.row)
        SELECT * FROM ranked WHERE rank <= 5""",
    "op13_merkle_manifest": f"""
        WITH RECURSIVE hashed AS (
            SELECT doc_id, lang, sha256({_HEAD_SQL} || {_field_sql('text')}) AS leaf, CASE WHEN doc_id IS NOT NULL AND {_CRC_SQL} % 3 = 0 THEN sha256({_HEAD_SQL} || {_field_sql(f'({_LOWER_SQL})')}) END AS tampered FROM documents),
        placed AS (SELECT *, row_number() OVER (ORDER BY lang NULLS FIRST, doc_id NULLS FIRST, leaf) AS row, dense_rank() OVER (ORDER BY lang NULLS FIRST) AS tree FROM hashed),
        leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY row) - 1 AS idx, leaf AS hash FROM placed),
        {_tree_sql('leaves', 'nodes')},
        tops AS (SELECT 0 AS tree, tree - 1 AS idx, hash FROM nodes WHERE width = 1),
        {_tree_sql('tops', 'upper')},
        heights AS (SELECT tree, max(level) AS height FROM nodes GROUP BY tree),
        -- every node with its run's digests on its left and on its right
        sides AS (
            SELECT tree, level, idx, hash, coalesce(string_agg(hash, '') OVER (PARTITION BY tree, level, idx // 8 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
                coalesce(string_agg(hash, '') OVER (PARTITION BY tree, level, idx // 8 ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
            FROM (SELECT * FROM nodes WHERE width > 1 UNION ALL SELECT * FROM upper WHERE width > 1)),
        steps AS (
            SELECT row, s.level, s.l, s.r FROM leaves JOIN heights h USING (tree) JOIN sides s ON s.tree = leaves.tree AND s.level < h.height AND s.idx = leaves.idx // (8 ** s.level)::BIGINT
            UNION ALL SELECT row, h.height + s.level, s.l, s.r FROM leaves JOIN heights h USING (tree) JOIN sides s ON s.tree = 0 AND s.idx = (leaves.tree - 1) // (8 ** s.level)::BIGINT),
        proofs AS (SELECT row, sha256(string_agg(l || r, '' ORDER BY level)) AS proof_sha256, list(l ORDER BY level) AS ls, list(r ORDER BY level) AS rs FROM steps GROUP BY row),
        folds AS (
            SELECT leaves.row, 1 AS step, coalesce(tampered, leaf) AS h, coalesce(ls, []) AS ls, coalesce(rs, []) AS rs FROM leaves LEFT JOIN proofs USING (row)
            UNION ALL SELECT row, step + 1, sha256(ls[step] || h || rs[step]), ls, rs FROM folds WHERE step <= len(ls))
        SELECT doc_id, leaf, s.hash AS subroot, u.hash AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = u.hash AS verified
        FROM leaves LEFT JOIN proofs USING (row) JOIN (SELECT row, h FROM folds WHERE step = len(ls) + 1) f USING (row) JOIN nodes s ON s.tree = leaves.tree AND s.width = 1 JOIN upper u ON u.width = 1""",
    "op2_warc_audit": f"""
        WITH texts AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS body, url AS u FROM pages),
        copies AS (SELECT *, CASE WHEN rotten THEN '?' || substr(body, 2) ELSE body END AS copy FROM (SELECT *, (strlen(url) * 31 + strlen(body)) % 97 = 3 AS rotten FROM texts)),
        records AS (SELECT page_id, u, {_record_sql('body')} AS record, {_record_sql('copy')} AS copied FROM copies),
        listed AS (SELECT *, row_number() OVER (ORDER BY page_id NULLS FIRST, u NULLS FIRST, sha256(record)) - 1 AS ordinal FROM records)
        SELECT page_id, (ordinal // 4096)::BIGINT AS file, (sum(strlen(record)) OVER w - strlen(record))::BIGINT AS begin, (sum(strlen(record)) OVER w)::BIGINT AS "end",
            sha256(record) AS sha256, record <> copied AS damaged
        FROM listed WINDOW w AS (PARTITION BY ordinal // 4096 ORDER BY ordinal)""",
    "op5_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
        keyed AS (
            SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key FROM lines),
        frequent AS (SELECT line_key FROM keyed WHERE length(line_key) >= 1 GROUP BY line_key HAVING count(DISTINCT doc_id) >= 10)
        SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (f.line_key IS NOT NULL)::BIGINT AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (f.line_key IS NULL), '')) AS kept_sha256
        FROM keyed LEFT JOIN frequent f USING (line_key) GROUP BY doc_id""",
}
