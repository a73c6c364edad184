"""The registered queries of the ten operators and, where SQL can express them, their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import alignment, audio, backoff, bpe, divergence, html_text, language, mixture, multi_index, perspectives, pii, secrets, simhash
from tessera.session import table


def op1_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all sources takes from each document."""
    mix = mixture.mixture(table(spark, sf_dir, "documents"), ["doc_id"])
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learnt outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    known = language.fit(docs.where(~language.held_out()), "lang", "text", F.col("doc_id").cast("string"))
    return language.predict(docs.select("doc_id", language.held_out().alias("held_out"), "text"), known)


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of every page."""
    return html_text.visible_text(table(spark, sf_dir, "pages"), ["page_id", "url"])


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain and disguised personal data of every document."""
    return pii.personal_data(table(spark, sf_dir, "documents"), ["doc_id"])


def op5_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as 8-bit audio, stored, read back, cut into tensors and described by these."""
    return audio.tensor_features(audio.store_media(table(spark, sf_dir, "documents"), ["doc_id"]))


def op6_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every twentieth vector, among all others."""
    return multi_index.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    near = simhash.near_duplicates(table(spark, sf_dir, "documents"), ["doc_id"])
    return near.select("doc_id", simhash.hex_of("print").alias("fingerprint"), F.col("component").alias("component_id"))


def op8_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from each participant's side, masks written as start:end."""
    sides = perspectives.perspectives(table(spark, sf_dir, "conversations"))
    mask = F.array_join(F.transform("mask", lambda m: F.concat_ws(":", m["start"].cast("string"), m["end"].cast("string"))), ",")
    return sides.select("conv_id", "perspective", "part", "n_messages", "rendered", mask.alias("mask"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, told from examples by owners (sources) and repositories (documents)."""
    return secrets.secrets(table(spark, sf_dir, "documents"), ["doc_id"])


#: Vocabulary of the BPE query; the file is installed with the Python packages of every executor.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document and the text that they decode to, as digests."""
    both = bpe.round_trip(table(spark, sf_dir, "documents"), ["doc_id"], VOCABULARY)
    written = F.array_join(F.col("tokens").cast("array<string>"), ",")
    return both.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.sha2(written, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


#: The second vocabulary of the alignment, installed beside the first.
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of both tokenizers' tokens in every document."""
    return alignment.alignment(table(spark, sf_dir, "documents"), ["doc_id"], VOCABULARY, PIECES)


def op12_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document, by a model of nine tenths of them."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))
    scores = backoff.scored(table(spark, sf_dir, "documents"), ["doc_id"], ~held_out)
    return scores.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of all pairs of sources of each language, and the terms that set each apart."""
    return divergence.divergence(table(spark, sf_dir, "documents"))


QUERIES = {"op1_mixture": op1_mixture, "op2_language": op2_language, "op3_html": op3_html, "op4_pii": op4_pii, "op5_audio": op5_audio, "op6_multi_index": op6_multi_index, "op7_simhash": op7_simhash, "op8_perspectives": op8_perspectives, "op9_secrets": op9_secrets, "op10_bpe": op10_bpe, "op11_alignment": op11_alignment, "op12_backoff": op12_backoff, "op13_divergence": op13_divergence}


def _mixture_sql(rounds: int = mixture.ROUNDS) -> str:
    """Thresholds by running sums over the hash; cap and level as in the operator."""
    sql = r"""
WITH rows AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'text ' || text, '')), 1, 15) AS BIGINT) AS place
  FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n FROM rows GROUP BY source),
weighed AS (SELECT *, CASE n % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size * 3 AS cap FROM sizes),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
level AS (SELECT *, (SELECT f.level FROM levels f WHERE f.cap > f.level * f.weight ORDER BY f.cap / f.weight, f.n LIMIT 1) AS common FROM levels),
goals AS (SELECT source, source_size, CASE WHEN source_size = 0 THEN 0.0::DOUBLE ELSE least(cap::DOUBLE, coalesce(common * weight, cap::DOUBLE)) END AS target FROM level),
plan AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target / source_size) AS BIGINT) END AS times FROM goals),
state_0 AS (SELECT r.doc_id, r.source, r.size, r.place, p.source_size, p.target, p.times, p.target - p.times * p.source_size AS budget, 1e300::DOUBLE AS fit, false AS hit
  FROM rows r JOIN plan p ON r.source IS NOT DISTINCT FROM p.source)"""
    for k in range(rounds):
        last = k == rounds - 1
        sql += f""",
free_{k} AS (SELECT source, place, sum(size) AS w, any_value(budget) AS budget FROM state_{k} WHERE size > 0 AND size <= fit AND NOT hit GROUP BY source, place),
run_{k} AS (SELECT *, sum(w) OVER (PARTITION BY source ORDER BY place) AS upto FROM free_{k}),
cross_{k} AS (SELECT source, min(place) AS threshold, arg_min(upto - w, place) AS spent, arg_min(upto, place) AS upto FROM run_{k} WHERE upto > budget GROUP BY source),
state_{k + 1} AS (
  SELECT s.doc_id, s.source, s.size, s.place, s.source_size, s.target, s.times,
    CASE WHEN c.threshold IS NULL THEN 0 ELSE s.budget - c.spent END AS budget,
    CASE WHEN c.threshold IS NULL THEN 0 ELSE s.budget - c.spent END AS fit,
    s.hit OR (s.size > 0 AND s.size <= s.fit AND (c.threshold IS NULL OR s.place < c.threshold{" OR s.place = c.threshold AND c.spent + c.upto <= 2 * s.budget" if last else ""})) AS hit
  FROM state_{k} s LEFT JOIN cross_{k} c ON s.source IS NOT DISTINCT FROM c.source)"""
    return sql + f"""
SELECT doc_id, size, source_size, target, CAST((times + CASE WHEN hit THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM state_{rounds}"""


_PERSPECTIVES_SQL = """
WITH said AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS content FROM conversations),
people AS (SELECT DISTINCT conv_id, speaker AS perspective FROM said WHERE speaker <> 'system'),
seen AS (
  SELECT s.conv_id, p.perspective, CAST(0 AS BIGINT) AS part, s.turn, s.speaker, s.content, s.speaker = p.perspective AS own,
    CASE WHEN s.speaker = 'system' THEN '<|system|>' || chr(10) WHEN s.speaker = p.perspective THEN '<|assistant|>' || chr(10) ELSE '<|user ' || s.speaker || '|>' || chr(10) END AS head
  FROM said s JOIN people p ON s.conv_id IS NOT DISTINCT FROM p.conv_id),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id, perspective, part ORDER BY turn NULLS FIRST, speaker, content) AS k FROM seen),
placed AS (
  SELECT *, sum(length(head) + length(content) + 8) OVER (PARTITION BY conv_id, perspective, part ORDER BY k) - length(content) - 8 AS start FROM numbered)
SELECT conv_id, perspective, part, count(*) AS n_messages, string_agg(head || content || '<|end|>' || chr(10), '' ORDER BY k) AS rendered,
  coalesce(string_agg(start || ':' || (start + length(content)), ',' ORDER BY k) FILTER (WHERE own), '') AS mask
FROM placed GROUP BY conv_id, perspective, part"""

#: Every pair over all terms, without vectors or histograms.
_DIVERGENCE_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (SELECT d, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS total FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= 3),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN kept k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL),
sizes AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS size FROM groups g LEFT JOIN counts c ON g.lang = c.lang AND g.source = c.source GROUP BY ALL),
kinds AS (SELECT lang, count(*) AS v, sum(total) AS whole FROM kept GROUP BY lang),
shares AS (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, k.total, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (s.size + v.v) AS p,
    1 + (1000000000::HUGEINT * (k.total + 1)) // (v.whole + v.v) AS q
  FROM sizes s JOIN kept k ON s.lang = k.lang JOIN kinds v ON s.lang = v.lang LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce((
    SELECT sum(((x.p - y.p) * (x.p - y.p)) // y.p) FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source),
own AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // q AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM own))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200"""

SQL: dict[str, str] = {"op1_mixture": _mixture_sql(), "op8_perspectives": _PERSPECTIVES_SQL, "op13_divergence": _DIVERGENCE_SQL}
