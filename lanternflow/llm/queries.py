"""One query for each operator over its whole table, and its SQL twin where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternflow.llm import (bktree, conversations, decontaminate, langid, lexicon, licenses, linededup, mainhtml, minhash, negatives, simhash,
                             tokenfiles, urlfilter)
from lanternflow.llm.common import durable, table

TOKENIZER = "word_bpe_49k.json"
VOCABULARY = 49_408
# Fixed values of the query: host, path, verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprints, and for every hundredth document how many others lie within three bits."""
    docs = table(spark, sf, "documents")
    prints = durable(simhash.edited_fingerprints(docs))
    sizes = prints.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"))
    near = simhash.near_fingerprints(prints.filter("doc_id % 100 = 0"), sizes, radius=3)
    counted = (near.join(sizes, F.col("near") == F.col("fingerprint")).groupBy("query")
               .agg((F.sum("n") - 1).alias("n_near")))
    asked = prints.filter("doc_id % 100 = 0").join(counted, F.col("fingerprint") == F.col("query"), "left").drop("query")
    return asked.unionByName(prints.filter("doc_id IS NULL OR doc_id % 100 <> 0").withColumn("n_near", F.lit(None).cast("long")))


def op2_licenses(spark: SparkSession, sf: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_blocks", F.array_join("licenses", ",").alias("licenses"),
                        F.coalesce(F.array_max(F.transform("notices", lambda x: x["saved"])), F.lit(0.0)).alias("best_saved"),
                        F.aggregate("notices", F.lit(0).cast("long"), lambda a, x: a + F.size(x["differences"])).alias("n_differences"))


def op3_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    judged = urlfilter.judge_urls(table(spark, sf, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op4_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return linededup.dedup_lines(docs).select("doc_id", F.col("lines_removed").cast("long").alias("lines_removed"),
                                              F.length("text").cast("long").alias("n_chars_left"),
                                              F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"))


def op5_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    out = decontaminate.contamination(docs, table(spark, sf, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                      F.sha2(F.encode(F.array_join("item_ids", ","), "UTF-8"), 256).alias("items_sha256"),
                      (F.col("n_hit") > 0).alias("contaminated"))


def op6_main_text(spark: SparkSession, sf: str) -> DataFrame:
    return mainhtml.extract_main_text(table(spark, sf, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op7_token_files(spark: SparkSession, sf: str) -> DataFrame:
    return tokenfiles.token_file_digest(table(spark, sf, "documents").select("doc_id", "text"), tokenizer_path(), 1, VOCABULARY)


def op8_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return lexicon.encoding_digest(table(spark, sf, "documents").select("doc_id", "text"), tokenizer_path())


def op9_minhash(spark: SparkSession, sf: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf, "documents").select("doc_id", "text"), percent=85)


def op10_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    held_out = langid.fold(F.col("doc_id")) == 2
    model = langid.fit_languages(docs.filter(~held_out))
    return langid.identify(docs.select("doc_id", "text", held_out.alias("held_out")), model).select(
        "doc_id", "held_out", "lang_pred", "score")


def op11_conversations(spark: SparkSession, sf: str) -> DataFrame:
    return conversations.audit_conversations(conversations.damaged(table(spark, sf, "conversations")))


def op12_simhash_groups(spark: SparkSession, sf: str) -> DataFrame:
    return bktree.near_components(table(spark, sf, "documents").select("doc_id", "text"), radius=3)


def op13_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    """Anchors are every fiftieth vector; labels of every seventh are moved on by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    vectors = negatives.quantised(table(spark, sf, "embeddings").select("vec_id", "label", "embedding"), moved)
    return negatives.hard_negatives(vectors, F.col("vec_id") % 50 == 0)


def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf)


QUERIES = {f.__name__: f for f in (op1_simhash, op2_licenses, op3_url_filter, op4_line_dedup, op5_decontaminate, op6_main_text,
                                   op7_token_files, op8_bpe, op9_minhash, op10_language, op11_conversations, op12_simhash_groups,
                                   op13_hard_negatives, pipeline)}
_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_REST = "CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END"
_WORDS = "regexp_extract_all(" + _FOLD.format("coalesce(text, '')") + ", '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL: dict[str, str] = {
    "op3_url_filter": f"""WITH rules(rh, rp, v) AS (VALUES {", ".join(map(repr, URL_RULES))}),
 u AS (SELECT page_id, {_FOLD.format("regexp_extract(rest, '^[^/?#]*')")} AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM (SELECT page_id, {_REST} AS rest FROM pages)),
 f AS (SELECT page_id, arg_max({{'r': rh || rp, 'v': v}}, length(rh) * 100000 + length(rp)) AS b FROM u JOIN rules
  ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT page_id, host, path, b.r AS rule, coalesce(b.v, 'allow') AS verdict FROM u LEFT JOIN f USING (page_id)""",
    "op5_decontaminate": f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
 win AS (SELECT item_id, s, list_slice(w, s, s + 9) AS t FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
 ph AS (SELECT DISTINCT item_id, len(t) AS n, array_to_string(t, ' ') AS p FROM win),
 lens AS (SELECT DISTINCT n FROM ph),
 dw AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS s, w FROM d CROSS JOIN lens WHERE len(w) >= n),
 g AS (SELECT doc_id, n, s, array_to_string(list_slice(w, s, s + n - 1), ' ') AS p FROM dw),
 m AS (SELECT doc_id, s, n, item_id FROM g JOIN ph USING (n, p)),
 hits AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS at FROM m) GROUP BY 1),
 its AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM
  (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM m) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op13_hard_negatives": """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS l,
  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.l = c.l AS same, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score
  FROM e a JOIN e c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id),
 p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
 n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score,
  row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS r
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(r AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE r <= 3""",
}
