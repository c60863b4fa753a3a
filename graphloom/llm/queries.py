"""Queries of the corpus operators: thin wrappers that apply each to its whole table and
derive the columns asked for. ``ORACLES`` holds SQL where SQL can express the result."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import additive_ann, bpe, decontaminate, fill_middle, html_extract, line_dedup, merkle, quality, simhash, suffix_dedup, token_store, toxicity, urlfilter
from graphloom.sources.tables import table

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN))


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= quality.CUT).cast("int").alias("predicted"))


#: host, path, verdict
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


@query
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlfilter.judge(table(spark, sf_dir, "pages"), rules)


_VALUES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
ORACLES["op3_url_filter"] = f"""
WITH rules(rhost, rpath, verdict) AS (VALUES {_VALUES}),
cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{urlfilter.UPPER}', '{urlfilter.LOWER}') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
urls AS (SELECT *, row_number() OVER (ORDER BY page_id, host, path) AS n FROM parts),
best AS (SELECT n, arg_max(rhost || rpath, length(rhost || rpath) * 1000 + length(rhost)) AS rule, arg_max(verdict, length(rhost || rpath) * 1000 + length(rhost)) AS verdict
         FROM urls JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY n)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM urls LEFT JOIN best USING (n)
"""


@query
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, radius=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(suffix_dedup.deduplicate(table(spark, sf_dir, "documents")))


@query
def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_store.checksums(token_store.write(table(spark, sf_dir, "documents"), path))


@query
def op1_additive_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return additive_ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tampered rows (an even crc32 of the decimal doc_id) have lost the newlines of their text."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    text = F.when(hit, F.translate("text", "\n", "")).otherwise(F.col("text"))
    fields = [text if f == "text" else F.col(f) for f in merkle.FIELDS]
    proved = merkle.verify(merkle.manifest(table(spark, sf_dir, "documents"), tampered=merkle.leaf(*fields)), "tampered")
    return proved.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("proof")), 256).alias("proof_sha256"), "folded_root", "verified")


# the polynomial and start of CRC-32 as in zip files are fixed values
ORACLES["op11_merkle_manifest"] = """
WITH RECURSIVE hit AS (
    SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda k: ascii(CAST(doc_id AS VARCHAR)[k]))),
                  lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) & 1 = 0 AS tampered
    FROM documents),
fields AS (
    SELECT doc_id, source, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
           || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head, text, CASE WHEN tampered THEN replace(text, chr(10), '') ELSE text END AS other FROM hit),
leaves AS (
    SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(other) || ':' || other, '-')) AS tampered FROM fields),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g FROM leaves),
low(l, g, i, n, d) AS (
    SELECT 0, g, i, n, leaf FROM placed
    UNION ALL
    SELECT l + 1, g, i // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY i)) FROM low WHERE n > 1 GROUP BY l, g, i // 3, n),
high(l, i, n, d) AS (
    SELECT 0, g, count(*) OVER (), d FROM low WHERE n = 1
    UNION ALL
    SELECT l + 1, i // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY i)) FROM high WHERE n > 1 GROUP BY l, i // 3, n),
steps AS (
    SELECT p.g, p.i, l.l, coalesce(string_agg(o.d, '' ORDER BY o.i) FILTER (WHERE o.i < CAST(floor(p.i / 3 ** l.l) AS BIGINT)), '') AS before, coalesce(string_agg(o.d, '' ORDER BY o.i) FILTER (WHERE o.i > CAST(floor(p.i / 3 ** l.l) AS BIGINT)), '') AS after
    FROM placed p JOIN (SELECT DISTINCT g, l FROM low WHERE n > 1) l USING (g)
    JOIN low o ON o.g = p.g AND o.l = l.l AND o.i // 3 = CAST(floor(p.i / 3 ** (l.l + 1)) AS BIGINT) GROUP BY p.g, p.i, l.l
    UNION ALL
    SELECT p.g, p.i, 1000 + l.l, coalesce(string_agg(o.d, '' ORDER BY o.i) FILTER (WHERE o.i < CAST(floor(p.g / 3 ** l.l) AS BIGINT)), ''), coalesce(string_agg(o.d, '' ORDER BY o.i) FILTER (WHERE o.i > CAST(floor(p.g / 3 ** l.l) AS BIGINT)), '')
    FROM placed p CROSS JOIN (SELECT DISTINCT l FROM high WHERE n > 1) l
    JOIN high o ON o.l = l.l AND o.i // 3 = CAST(floor(p.g / 3 ** (l.l + 1)) AS BIGINT) GROUP BY p.g, p.i, l.l),
proofs AS (SELECT g, i, list({'l': before, 'r': after} ORDER BY l) AS proof, string_agg(before || after, '' ORDER BY l) AS text FROM steps GROUP BY g, i),
up(g, i, k, d, proof) AS (
    SELECT p.g, p.i, 1, p.tampered, coalesce(q.proof, []) FROM placed p LEFT JOIN proofs q USING (g, i)
    UNION ALL
    SELECT g, i, k + 1, sha256(proof[k].l || d || proof[k].r), proof FROM up WHERE k <= len(proof))
SELECT p.doc_id, p.leaf, s.d AS subroot, r.d AS root, sha256(coalesce(q.text, '')) AS proof_sha256, u.d AS folded_root, u.d = r.d AS verified
FROM placed p LEFT JOIN proofs q USING (g, i) JOIN (SELECT g, d FROM low WHERE n = 1) s USING (g) JOIN (SELECT g, i, d FROM up WHERE k = len(proof) + 1) u USING (g, i)
CROSS JOIN (SELECT d FROM high WHERE n = 1) r
"""


@query
def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = line_dedup.apply(docs, line_dedup.keep_bitmaps(docs))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLES["op12_line_dedup"] = f"""
WITH docs AS (SELECT row_number() OVER () AS n, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
each AS (SELECT n, doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS place FROM docs),
keyed AS (SELECT *, translate(trim(line, chr(9) || chr(11) || chr(12) || chr(13) || ' '), '{line_dedup.UPPER}', '{line_dedup.LOWER}') AS key FROM each),
first AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key),
marked AS (SELECT k.*, coalesce(k.doc_id > f.first, false) AS gone FROM keyed k LEFT JOIN first f USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY n, doc_id
"""


@query
def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_middle.restore(fill_middle.rearrange(table(spark, sf_dir, "documents")))
    digests = [F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256")]
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


ORACLES["op13_fill_middle"] = """
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
units AS (SELECT *, regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+') AS u, [CAST('0x' || substr(h, 8 * k + 1, 8) AS BIGINT) FOR k IN range(4)] AS d FROM docs),
cuts AS (SELECT *, len(u) AS n, text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR d[3] % 100 >= 100 AS plain,
                least(d[1] % (len(u) + 1), d[2] % (len(u) + 1)) AS a, greatest(d[1] % (len(u) + 1), d[2] % (len(u) + 1)) AS b FROM units),
parts AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM cuts)
SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN d[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
       CASE WHEN NOT plain THEN length(p) END AS prefix_chars, CASE WHEN NOT plain THEN length(m) END AS middle_chars,
       sha256(CASE WHEN plain THEN text WHEN d[4] % 100 < 50 THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""
