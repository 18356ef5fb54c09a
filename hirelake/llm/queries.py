"""The registered queries of the numbered operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ballcodes, bpe, decontaminate, fim, fingerprints, html, jaccard, langid, lm, quality, search, substring, suffix


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness."""
    return fingerprints.fingerprint_with_next(_table(spark, sf_dir, "documents"))


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without the windows of 20 words that start earlier too."""
    out = substring.remove_repeated_words(_table(spark, sf_dir, "documents"), length=20)
    return out.select("doc_id", "n_words", substring.removed_count().alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's group by four-word shingles at a Jaccard of 0.85 or more."""
    return jaccard.link_similar(_table(spark, sf_dir, "documents"), size=4, percent=85)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items."""
    return decontaminate.find_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def _remainder(n: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest learned language of every text."""
    docs = _table(spark, sf_dir, "documents")
    out = langid.identify(docs, langid.fit(docs, _remainder(4) != 2))
    # A rejected text is told by its column: the contract asks for a learned language wherever there is a letter.
    return out.select("doc_id", F.coalesce(_remainder(4) == 2, F.lit(False)).alias("held_out"), F.col("nearest").alias("lang_pred"), "score", "cosine", "rejected")


def op6_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without the strings of 100 bytes that start earlier too."""
    out = suffix.remove_repeated_bytes(_table(spark, sf_dir, "documents"), length=100)
    return out.select("doc_id", "n_bytes", substring.removed_count().alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html.extract(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by the network that all of them train."""
    return lm.pseudo_likelihood(_table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality by rules learned from four fifths of the labels."""
    out = quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), _remainder(5) != 0)
    return out.select("doc_id", F.coalesce(_remainder(5) == 0, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded."""
    import public_tokenizers

    out = bpe.encode_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_ball_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-byte codes of all embeddings, with their errors."""
    out = ballcodes.compress(_table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", "codebooks_sha256")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text reordered, and rebuilt from what came out."""
    out = fim.fill_in_middle(_table(spark, sf_dir, "documents"))
    digests = [F.sha2(c.cast("binary"), 256).alias(f"{name}_sha256") for name, c in (("output", F.col("output")), ("restored", fim.restored()))]
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op13_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five embeddings nearest to each fiftieth one."""
    return search.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


QUERIES = {
    f.__name__: f
    for f in (
        op1_fingerprints,
        op2_substring,
        op3_jaccard_join,
        op4_decontaminate,
        op5_language_id,
        op6_suffix_array,
        op7_html_extraction,
        op8_lm_scoring,
        op9_quality,
        op10_bpe,
        op11_ball_codes,
        op12_fill_in_middle,
        op13_exact_search,
    )
}
_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_OP2 = rf"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
s AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i:i + 19], ' ') ORDER BY doc_id, i) AS rn FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20) x),
r AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 20 THEN 0 ELSE 1 END AS new FROM s WHERE rn > 1) y),
g AS (SELECT doc_id, min(i) AS b, max(i) + 20 AS e FROM r GROUP BY doc_id, run),
k AS (SELECT doc_id, b, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 1) AS f, e - b AS n FROM g),
t AS (SELECT doc_id, max(e) AS f FROM g GROUP BY doc_id),
p AS (SELECT doc_id, b, n, array_to_string(w[f:b - 1], ' ') AS part FROM k JOIN d USING (doc_id) UNION ALL SELECT doc_id, 1099511627776, 0, array_to_string(w[coalesce(f, 1):], ' ') FROM d LEFT JOIN t USING (doc_id))
SELECT doc_id, len(w) AS n_words, n_removed, kept_sha256 FROM (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_removed, sha256(coalesce(string_agg(part, ' ' ORDER BY b) FILTER (WHERE part <> ''), '')) AS kept_sha256 FROM p GROUP BY doc_id) o JOIN d USING (doc_id)
"""
_OP3 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0) x),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL) p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 85 * (na.n + nb.n - k)),
c AS (SELECT a, b FROM l UNION SELECT c.a, l.b FROM c JOIN l ON l.a = c.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.least, d.doc_id)) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS least FROM c GROUP BY a) m USING (doc_id)
"""
_OP6 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT doc_id, i, row_number() OVER (PARTITION BY m ORDER BY doc_id, i) AS rn FROM (SELECT doc_id, i, md5_number(substring(h, CAST(2 * i + 1 AS INT), 200)) AS m FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS i FROM d WHERE length(h) >= 200) x) z),
r AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM s WHERE rn > 1) y),
g AS (SELECT doc_id, min(i) AS b, max(i) + 100 AS e FROM r GROUP BY doc_id, run),
k AS (SELECT doc_id, b, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 0) AS f, e - b AS n FROM g),
t AS (SELECT doc_id, max(e) AS f FROM g GROUP BY doc_id),
p AS (SELECT doc_id, b, n, substring(h, CAST(2 * f + 1 AS INT), CAST(2 * (b - f) AS INT)) AS part FROM k JOIN d USING (doc_id) UNION ALL SELECT doc_id, 1099511627776, 0, substring(h, CAST(2 * coalesce(f, 0) + 1 AS INT)) FROM d LEFT JOIN t USING (doc_id))
SELECT doc_id, length(h) // 2 AS n_bytes, n_removed, n_spans, kept_sha256 FROM (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_removed, count(*) - 1 AS n_spans, sha256(unhex(string_agg(part, '' ORDER BY b))) AS kept_sha256 FROM p GROUP BY doc_id) o JOIN d USING (doc_id)
"""
ORACLES: dict[str, str] = {"op2_substring": _OP2, "op3_jaccard_join": _OP3, "op4_decontaminate": decontaminate.ORACLE, "op6_suffix_array": _OP6, "op11_ball_codes": ballcodes.ORACLE, "op12_fill_in_middle": fim.ORACLE, "op13_exact_search": search.ORACLE}
