"""The queries over the driver's tables that apply the operators of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lamina.llm import bagminhash, bitsliced, bpe_lexicon, chat_format, common, divergence, mixing, oracles, pseudo_lm, quality_qda, quality_rules, spelling, suffix_dedup, token_store, warc


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(common.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.assign(common.table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.verdicts(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_qda.classify(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(common.table(spark, sf_dir, "documents"))


def op6_bitsliced_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = bitsliced.quantised(common.table(spark, sf_dir, "embeddings"))
    return bitsliced.search(vectors, vectors.filter("vec_id % 50 = 0"), 5)


def _op3_sql() -> str:
    """The rules in DuckDB, with exact binomial tails as sums over all terms."""
    q = quality_rules
    measure = {
        "symbols_per_word": "n_symbols / CAST(greatest(n_words, 1) AS DOUBLE)",
        "upper_share": "n_upper / CAST(greatest(word_chars, 1) AS DOUBLE)",
        "duplicate_lines_share": "n_dup_lines / CAST(n_breaks + 1 AS DOUBLE)",
        "word_length": "word_chars / CAST(greatest(n_words, 1) AS DOUBLE)",
    }
    rules = list(q.GRIDS)
    alpha = f"({q.ALPHA!r} / CAST(rules AS DOUBLE))"
    # as many rules as a stratum's labels prove if none is rejected, or all
    some = "CASE " + " ".join(f"WHEN n * ln(1 - {q.ALPHA!r} / {r}e0) <= ln({q.DELTA!r} / (strata * {r}e0)) THEN {r}" for r in range(len(rules), 0, -1)) + f" ELSE {len(rules)} END"
    cells = " UNION ALL ".join(
        f"SELECT lang, '{rule}' AS rule, {rules.index(rule) + 1} AS place, {i} AS step, {cutoff!r}::DOUBLE AS cutoff, count(*) AS n, count(*) FILTER (WHERE {measure[rule]} > {cutoff!r}::DOUBLE) AS k FROM good GROUP BY lang" for rule, grid in q.GRIDS.items() for i, cutoff in enumerate(grid)
    )
    rejects = " OR ".join(f"coalesce({m} > (SELECT min(c.cutoff) FROM passed c WHERE c.rule = '{rule}' AND c.lang IS NOT DISTINCT FROM s.lang), false)" for rule, m in measure.items())
    return f"""
WITH d AS (
  SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), g AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS times
  FROM (SELECT doc_id, i, list_slice(words, i, i + 7) AS gram FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 7)) AS i FROM d) e)
), r AS (
  SELECT doc_id, sum(least(8, i - before)) AS n_repeat_words FROM (SELECT doc_id, i, lag(i, 1, -7) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM g WHERE times > 1) t GROUP BY doc_id
), l AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) t
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id
), stats AS (
  SELECT d.doc_id, d.lang, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(l.n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(r.n_repeat_words, 0) AS BIGINT) AS n_repeat_words, length(text) - length(regexp_replace(text, '\\p{{Lu}}', '', 'g')) AS n_upper, length(text) - length(replace(text, chr(10), '')) AS n_breaks
  FROM d LEFT JOIN r ON r.doc_id = d.doc_id LEFT JOIN l ON l.doc_id = d.doc_id
), s AS (
  SELECT *, n_words < {q.LEAST_WORDS} OR 100 * n_repeat_words > {q.MOST_REPEATED_PERCENT} * n_words AS base_failed FROM stats
), good AS (
  SELECT * FROM s WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1)
), every AS ({cells}), counted AS (
  SELECT *, (SELECT count(*) FROM (SELECT DISTINCT lang FROM good) x) AS strata FROM every
), cells AS (
  SELECT * FROM (SELECT *, {some} AS rules FROM counted) y WHERE place <= rules
), tails AS (
  SELECT *, CASE WHEN k >= n * {alpha} THEN false ELSE
    list_sum(list_transform(generate_series(0, k), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({alpha}) + (n - j) * ln(1 - {alpha}))))
    <= {q.DELTA!r} / CAST(strata * rules AS DOUBLE) END AS proven
  FROM cells
), passed AS (
  SELECT t.lang, t.rule, t.cutoff FROM tails t WHERE t.step < (SELECT coalesce(min(f.step), 1000) FROM tails f WHERE f.rule = t.rule AND f.lang IS NOT DISTINCT FROM t.lang AND NOT f.proven)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({rejects}) AS kept FROM s
"""


OP3_SQL = _op3_sql()
OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY rank <= 5
"""


def op7_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_lm.score_documents(common.table(spark, sf_dir, "documents"))


def op8_bpe_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_lexicon.digests(common.table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write(common.table(spark, sf_dir, "pages"), common.new_folder(spark, "warc"))
    records = warc.read(spark, warc.splits(manifest), payloads=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return token_store.read_documents(token_store.write(docs, common.new_folder(spark, "tokens"), _tokenizer("byte_bpe_50k.json")))


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(chat_format.planted(spark))
    path = _tokenizer("byte_bpe_50k.json")
    return chat_format.digests(chat_format.write(conversations, common.new_folder(spark, "chat"), path), path)


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(common.table(spark, sf_dir, "documents"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(common.table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_mixing": op1_mixing, "op2_bagminhash": op2_bagminhash, "op3_quality_rules": op3_quality_rules, "op4_quality_classifier": op4_quality_classifier, "op5_suffix_dedup": op5_suffix_dedup, "op6_bitsliced_top5": op6_bitsliced_top5, "op7_pseudo_likelihood": op7_pseudo_likelihood, "op8_bpe_lexicon": op8_bpe_lexicon, "op9_warc": op9_warc, "op10_token_store": op10_token_store, "op11_chat_format": op11_chat_format, "op12_divergence": op12_divergence, "op13_spelling": op13_spelling}


OP9_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), m AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last_id FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last_id THEN last_id END AS refers_to
FROM m
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_rules": OP3_SQL, "op6_bitsliced_top5": OP6_SQL, "op9_warc": OP9_SQL, "op11_chat_format": oracles.CHAT_SQL, "op12_divergence": oracles.DIVERGENCE_SQL, "op13_spelling": oracles.SPELLING_SQL}
