"""The registered queries of the operators, and their SQL for DuckDB where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm import ann, exact_dedup, language_id, lexical, license_scan, mixing, packing, simhash, spelling, substring_dedup, token_counts, token_store, topk
from claimloom.llm.common import scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.fit(docs.filter(~language_id.held_out()))
    found = language_id.predict(docs, model)
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"))


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "store")
    token_store.write_store(_table(spark, sf_dir, "documents"), path)
    return token_store.read_digests(spark, path)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.array_join("licenses", ",").alias("licenses"), "n_licenses", F.size("sentence_ids").cast("long").alias("n_sentences"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator leaves texts that are told apart early without a full hash; the digest column asks for one of every text."""
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"), hash_all=True).select("doc_id", "keep_id", "group_size", "kept", F.col("full_hash").alias("text_sha256"))


def op10_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def _planted_spelling(doc_id, run):
    """The contract's word: of one run in 199, by document and run, one letter is missing."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    place = F.pmod(h, F.length(run).cast("long")).cast("int")
    return F.when(h % 199 == 0, F.concat(F.substr(run, F.lit(1), place), F.substr(run, place + 2))).otherwise(run)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"), spelt=_planted_spelling)


def op12_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=10)


def queries() -> dict:
    named = (op1_language_id, op2_nearest_neighbours, op3_token_counts, op4_token_store, op5_substring_dedup, op6_license_scan, op7_best_fit_packing, op8_source_mixing, op9_exact_dedup, op10_simhash_groups, op11_spelling_variants, op12_exact_top_k, op13_ranked_search)
    return {f.__name__: f for f in named}


_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP5_SQL = rf"""
WITH w AS (SELECT doc_id, {_WORDS} AS words FROM documents),
     i AS (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS p FROM w WHERE len(words) >= 13),
     h AS (SELECT doc_id, p, md5(array_to_string(words[p:p + 12], ' ')) AS seq FROM i),
     f AS (SELECT seq, min(doc_id) AS first_doc FROM h GROUP BY seq),
     c AS (SELECT DISTINCT h.doc_id, h.p + d.k AS place FROM h JOIN f USING (seq), (SELECT unnest(range(0, 13)) AS k) d WHERE f.first_doc < h.doc_id),
     g AS (SELECT doc_id, list(place) AS gone FROM c GROUP BY doc_id),
     k AS (SELECT w.doc_id, words, coalesce(gone, []) AS gone FROM w LEFT JOIN g ON w.doc_id = g.doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN len(gone) = 0 THEN words ELSE list_transform(list_filter(list_zip(words, range(1, len(words) + 1)), lambda x: NOT list_contains(gone, x[2])), lambda x: x[1]) END, ' ')) AS kept_sha256
FROM k
"""

OP8_SQL = r"""
WITH r AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
     t AS (SELECT source, sum(size)::BIGINT AS source_size FROM r GROUP BY source),
     w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]::BIGINT AS weight FROM t),
     o AS (SELECT *, sum(source_size) OVER () AS total, coalesce(sum(3 * source_size) OVER q, 0) AS before,
                  sum(weight) OVER () - coalesce(sum(weight) OVER q, 0) AS rest
           FROM w WINDOW q AS (ORDER BY source_size / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
     l AS (SELECT *, (total - before)::DOUBLE / rest::DOUBLE AS level FROM o),
     c AS (SELECT *, 3 * source_size <= level * weight AS capped FROM l),
     g AS (SELECT *, (SELECT arg_min(level, source_size / weight) FROM c WHERE NOT capped) AS open_level FROM c),
     s AS (SELECT source, source_size, CASE WHEN capped OR open_level IS NULL THEN (3 * source_size)::DOUBLE ELSE open_level * weight END AS target,
                  ('0x' || substr(md5('mix:' || coalesce(source, 'null')), 1, 5))::BIGINT / 1048576.0::DOUBLE AS shift FROM g),
     k AS (SELECT r.*, s.source_size, s.target, CASE WHEN s.source_size = 0 THEN 0 ELSE s.target / s.source_size::DOUBLE END AS rate, s.shift,
                  lpad(length(bin(size))::VARCHAR, 2, '0') || substr(bin(size), 1, 4) AS octave, substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 1) AS salt
           FROM r JOIN s ON r.source IS NOT DISTINCT FROM s.source),
     n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY octave, salt, size, doc_id)::DOUBLE AS k FROM k)
SELECT doc_id, size, source_size, target, (floor(k * rate + shift) - floor((k - 1) * rate + shift))::BIGINT * size AS taken FROM n
"""

OP9_SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
"""


def _license_sql() -> str:
    """The rules as data, over the same sentences; a sequence is found in the joined identifiers."""
    known = ", ".join(f"('{s}', '{i}')" for s, i in license_scan.SENTENCES.items())
    rules = ", ".join(f"('{name}', '>{'>'.join(seq)}>')" for name, seqs in license_scan.RULES.items() for seq in seqs)
    return rf"""
WITH known(plain, id) AS (VALUES {known}), rules(name, path) AS (VALUES {rules}),
     s AS (SELECT doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '[\r\n]+|[.!?;][ \t]+')) AS line, generate_subscripts(regexp_split_to_array(coalesce(text, ''), '[\r\n]+|[.!?;][ \t]+'), 1) AS place FROM documents),
     i AS (SELECT doc_id, place, id FROM (SELECT doc_id, place, trim(regexp_replace(lower(line), '[^a-z0-9]+', ' ', 'g')) AS plain FROM s) JOIN known USING (plain)),
     p AS (SELECT doc_id, '>' || string_agg(id, '>' ORDER BY place) || '>' AS path, count(*) AS n FROM i GROUP BY doc_id),
     e AS (SELECT DISTINCT a.name, b.path FROM rules a JOIN rules b ON a.name <> b.name AND a.path <> b.path AND starts_with(b.path, a.path)),
     m AS (SELECT doc_id, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses, count(DISTINCT name) AS k FROM p JOIN rules ON contains(p.path, rules.path)
           WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.name = rules.name AND contains(p.path, e.path)) GROUP BY doc_id)
SELECT d.doc_id, coalesce(m.licenses, '') AS licenses, coalesce(m.k, 0)::BIGINT AS n_licenses, coalesce(p.n, 0)::BIGINT AS n_sentences
FROM documents d LEFT JOIN p ON d.doc_id = p.doc_id LEFT JOIN m ON d.doc_id = m.doc_id
"""


OP12_SQL = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
           FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
     r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 10
"""

OP13_SQL = r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
     p AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM w GROUP BY doc_id, term),
     d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY doc_id),
     c AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM d),
     m AS (SELECT doc_id, 25 + (75 * n * nn) // ll AS m FROM d, c),
     f AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, c GROUP BY term, nn),
     b AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
     q AS (SELECT item_id, term, count(*)::BIGINT AS times FROM b GROUP BY item_id, term),
     s AS (SELECT item_id, p.doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
           FROM q JOIN p USING (term) JOIN f USING (term) JOIN m ON p.doc_id = m.doc_id GROUP BY item_id, p.doc_id),
     r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_substring_dedup": OP5_SQL, "op6_license_scan": _license_sql(), "op8_source_mixing": OP8_SQL, "op9_exact_dedup": OP9_SQL, "op12_exact_top_k": OP12_SQL, "op13_ranked_search": OP13_SQL}
