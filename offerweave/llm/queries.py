"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

QUERIES = {}
SQL = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def read(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Fixed rules: (verdict, host, path).
URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("block", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


@query
def op10_exact_dedup(spark, sf_dir):
    from offerweave.llm.exact_dedup import exact_dedup

    return exact_dedup(read(spark, sf_dir, "documents"))


SQL["op10_exact_dedup"] = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n"""


@query
def op4_url_filter(spark, sf_dir):
    from offerweave.llm.url_filter import url_filter

    values = ", ".join(str(r) for r in URL_RULES)
    rules = spark.sql(f"SELECT * FROM VALUES {values} AS rules(verdict, host, path)")
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter(pages, rules).select("page_id", "host", "path", "rule", "verdict")


SQL["op4_url_filter"] = r"""
WITH u AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)\A.*?://([^/?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)\A.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
r(verdict, rhost, rpath) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'),
  ('block', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/'))
SELECT page_id, host, path,
  (SELECT arg_max(rhost || rpath, length(rhost || rpath)) FROM r
   WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS rule,
  coalesce((SELECT arg_max(verdict, length(rhost || rpath)) FROM r
   WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)), 'allow') AS verdict
FROM u"""


@query
def op9_simhash_dedup(spark, sf_dir):
    from offerweave.llm.simhash import simhash_dedup

    return simhash_dedup(read(spark, sf_dir, "documents"))


@query
def op2_substring_dedup(spark, sf_dir):
    from offerweave.llm.substring_dedup import substring_dedup

    found = substring_dedup(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query
def op8_packing(spark, sf_dir):
    import public_tokenizers

    from offerweave.llm.packing import pack_documents

    return pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op6_word_bpe(spark, sf_dir):
    import public_tokenizers

    from offerweave.llm.word_bpe import encode_documents

    found = encode_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op7_license_scan(spark, sf_dir):
    from offerweave.llm.licenses import license_scan

    return license_scan(read(spark, sf_dir, "documents")).drop("matches")


def language_model(spark, docs):
    import public_tokenizers

    from offerweave.llm.language_id import train

    return train(docs, public_tokenizers.path("piece_bpe_32k.model"))


@query
def op5_language_id(spark, sf_dir):
    from offerweave.llm.language_id import held_out, identify

    docs = read(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), language_model(spark, docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query
def op1_embedding_dedup(spark, sf_dir):
    from offerweave.llm.embedding_dedup import embedding_dedup

    return embedding_dedup(read(spark, sf_dir, "embeddings"))


@query
def op3_suffix_dedup(spark, sf_dir):
    from offerweave.llm.suffix_dedup import suffix_dedup

    found = suffix_dedup(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


SQL["op2_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20),
k AS (SELECT s.doc_id AS doc_id, i, array_to_string(w[i:i + 19], ' ') AS t FROM s JOIN d ON s.doc_id = d.doc_id),
g AS (SELECT doc_id, i, (doc_id, i) <> min((doc_id, i)) OVER (PARTITION BY t) AS gone FROM k),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
c AS (SELECT p.doc_id AS doc_id, p.i AS i, w[p.i] AS word,
        coalesce(max(CAST(gone AS INTEGER)) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0) = 1 AS off
      FROM p LEFT JOIN g ON p.doc_id = g.doc_id AND p.i = g.i)
SELECT d.doc_id AS doc_id, CAST(len(any_value(d.w)) AS BIGINT) AS n_words, count(*) FILTER (WHERE off) AS n_removed,
       sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT off), '')) AS kept_sha256
FROM d LEFT JOIN c ON d.doc_id = c.doc_id GROUP BY d.doc_id"""

SQL["op3_suffix_dedup"] = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
s AS (SELECT doc_id, unnest(range(0, n)) AS i FROM d),
k AS (SELECT s.doc_id AS doc_id, i, substring(h, 2 * i + 1, 2) AS byte, CASE WHEN i + 50 <= n THEN md5_number(substring(h, 2 * i + 1, 100)) END AS t FROM s JOIN d ON s.doc_id = d.doc_id),
g AS (SELECT doc_id, i, byte, t IS NOT NULL AND doc_id > min(doc_id) OVER (PARTITION BY t) AS gone FROM k),
c AS (SELECT doc_id, i, byte, max(CAST(gone AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS off FROM g),
e AS (SELECT *, off = 1 AND coalesce(lag(off) OVER (PARTITION BY doc_id ORDER BY i), 0) = 0 AS start FROM c)
SELECT d.doc_id AS doc_id, any_value(n) AS n_bytes, coalesce(CAST(sum(off) AS BIGINT), 0) AS n_removed, count(*) FILTER (WHERE start) AS n_spans,
       sha256(unhex(coalesce(string_agg(byte, '' ORDER BY i) FILTER (WHERE off = 0), ''))) AS kept_sha256
FROM d LEFT JOIN e ON d.doc_id = e.doc_id GROUP BY d.doc_id"""

SQL["op1_embedding_dedup"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95),
r(a, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.a, r.root FROM r JOIN l ON l.b = r.a WHERE r.root < l.a),
c AS (SELECT a, min(root) AS root FROM r GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = vec_id) AS n_links, root AS component_id, vec_id = root AS kept FROM embeddings JOIN c ON c.a = vec_id"""
