"""The queries op1 to op13 and pipeline over the synthetic tables, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_extract, langid, line_dedup, merkle, mixing, sharding, simhash, substring_dedup, toxicity, url_filter, variants, vector_graph
from .common import doc_crc

URL_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_text(table(spark, sf_dir, "pages"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.pmod(doc_crc("doc_id"), F.lit(3)) == 1
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held)
    return toxicity.score(docs, model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.pmod(doc_crc("doc_id"), F.lit(4)) == 2
    model = langid.fit(docs, ~held)
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op4_vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_graph.link_vectors(table(spark, sf_dir, "embeddings"))


OP4_SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93),
r(a, b) AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a AS vec_id, min(b) AS m FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM p GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(c.m, e.vec_id)) AS component_id, e.vec_id <= coalesce(c.m, e.vec_id) AS kept
FROM embeddings e LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)
"""


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH l AS (SELECT doc_id, line_no, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents WHERE text IS NOT NULL)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
c AS (SELECT line, row_number() OVER (ORDER BY min((doc_id, line_no))) AS k, min((doc_id, line_no)) AS first FROM l GROUP BY line),
w AS (SELECT k, first, list_distinct(list_filter(regexp_split_to_array(lower(line), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS w FROM c),
e AS (SELECT k, len(w) AS n, unnest(w) AS tok FROM w),
o AS (SELECT a.k AS k, b.k AS j, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS common FROM e a JOIN e b ON a.tok = b.tok AND b.k < a.k AND b.n * 100 >= a.n * 80 AND a.n * 100 >= b.n * 80 GROUP BY a.k, b.k),
gone AS (SELECT DISTINCT k FROM o WHERE common * 100 >= (n + m - common) * 80),
r AS (SELECT l.doc_id, l.line_no, (gone.k IS NOT NULL OR c.first < (l.doc_id, l.line_no)) AS removed FROM l JOIN c USING (line) LEFT JOIN gone USING (k)),
g AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (removed) AS n_removed, coalesce(string_agg(line_no::VARCHAR, ',' ORDER BY line_no) FILTER (removed), '') AS removed_lines FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(removed_lines, '') AS removed_lines FROM documents LEFT JOIN g USING (doc_id)
"""


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated_words(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP6_SQL = r"""
WITH low AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
bl AS (SELECT item_id, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT item_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM bl)),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bl) WHERE len(w) >= n)),
h AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM h)) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), rules)


OP8_SQL = r"""
WITH p AS (SELECT page_id,
    translate(coalesce(regexp_extract(url, '^[\s\S]*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^[\s\S]*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(h, pre, says) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block'))
SELECT page_id, host, path,
  (SELECT h || pre FROM r WHERE (p.host = h OR ends_with(p.host, '.' || h)) AND starts_with(p.path, pre) ORDER BY length(h || pre) DESC LIMIT 1) AS rule,
  coalesce((SELECT says FROM r WHERE (p.host = h OR ends_with(p.host, '.' || h)) AND starts_with(p.path, pre) ORDER BY length(h || pre) DESC LIMIT 1), 'allow') AS verdict
FROM p
"""


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
f AS (SELECT win, min(doc_id) AS m FROM win GROUP BY win),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN f USING (win) WHERE m < doc_id),
k AS (SELECT doc_id, p, w[p] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
r AS (SELECT k.doc_id, count(g.p) AS n_removed, string_agg(word, ' ' ORDER BY k.p) FILTER (g.p IS NULL) AS kept FROM k LEFT JOIN g ON g.doc_id = k.doc_id AND g.p = k.p GROUP BY k.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN r USING (doc_id)
"""


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.when(F.pmod(doc_crc("doc_id"), F.lit(2)) == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle.manifest(table(spark, sf_dir, "documents"), changed={"text": tampered}, with_steps=False)


def crc_sql(x: str) -> str:
    """DuckDB expression of the unsigned crc32 of a string's UTF-8 bytes."""
    octets = f"list_transform(regexp_extract_all(hex(encode({x})), '..'), lambda p: ('0x' || p)::BIGINT)"
    shift = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))"
    return f"xor(list_reduce([4294967295::BIGINT] || {octets}, lambda c, b: {shift}), 4294967295)"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


OP11_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, {_leaf_sql("text")} AS leaf, CASE WHEN {crc_sql("doc_id::VARCHAR")} % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} ELSE {_leaf_sql("text")} END AS copy FROM documents),
l AS (SELECT doc_id, leaf, copy, dense_rank() OVER (ORDER BY source IS NOT NULL, encode(source)) - 1 AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM d),
t(g, k, i, n, hash) AS (SELECT g, 0, i, n, leaf FROM l UNION ALL SELECT g, k + 1, i // 3, (n + 2) // 3, sha256(string_agg(hash, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY g, k, i // 3, n),
r AS (SELECT g, hash AS subroot FROM t WHERE n = 1),
u(k, i, n, hash) AS (SELECT 0, g, (SELECT count(*) FROM r), subroot FROM r UNION ALL SELECT k + 1, i // 3, (n + 2) // 3, sha256(string_agg(hash, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY k, i // 3, n),
a AS (SELECT g AS tree, k, i, hash, n FROM t UNION ALL SELECT -1, k, i, hash, n FROM u),
s AS (SELECT l.doc_id, a.k, a.i < l.i // (3 ** a.k)::BIGINT AS before, a.i, a.hash FROM l JOIN a ON a.tree = l.g AND a.n > 1 AND a.i // 3 = l.i // (3 ** (a.k + 1))::BIGINT AND a.i <> l.i // (3 ** a.k)::BIGINT
  UNION ALL SELECT l.doc_id, 1000 + a.k, a.i < l.g // (3 ** a.k)::BIGINT, a.i, a.hash FROM l JOIN a ON a.tree = -1 AND a.n > 1 AND a.i // 3 = l.g // (3 ** (a.k + 1))::BIGINT AND a.i <> l.g // (3 ** a.k)::BIGINT),
p AS (SELECT doc_id, string_agg(hash, '' ORDER BY k, i) AS proof FROM s GROUP BY doc_id),
v AS (SELECT l.doc_id, row_number() OVER (PARTITION BY l.doc_id ORDER BY x.k) AS step, coalesce(string_agg(hash, '' ORDER BY s.i) FILTER (before), '') AS lhs, coalesce(string_agg(hash, '' ORDER BY s.i) FILTER (NOT before), '') AS rhs
  FROM l JOIN (SELECT DISTINCT tree, CASE WHEN tree = -1 THEN 1000 + k ELSE k END AS k FROM a WHERE n > 1) x ON x.tree IN (-1, l.g) LEFT JOIN s ON s.doc_id = l.doc_id AND s.k = x.k GROUP BY l.doc_id, x.k),
f(doc_id, step, h) AS (SELECT doc_id, 0, copy FROM l UNION ALL SELECT f.doc_id, f.step + 1, sha256(lhs || h || rhs) FROM f JOIN v ON v.doc_id = f.doc_id AND v.step = f.step + 1),
e AS (SELECT doc_id, max_by(h, step) AS folded FROM f GROUP BY doc_id)
SELECT l.doc_id, leaf, subroot, u.hash AS root, sha256(coalesce(proof, '')) AS proof_sha256, folded AS folded_root, folded = u.hash AS verified
FROM l JOIN r USING (g) JOIN e USING (doc_id) LEFT JOIN p USING (doc_id), u WHERE u.n = 1
"""


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: One document after the other, each to the first shard on its walk that is not full.
OP12_SQL = f"""
WITH RECURSIVE p AS (SELECT s, row_number() OVER (ORDER BY pt, s) AS j, pt >> 46 AS slot FROM (SELECT s, ('0x' || substr(md5('point11:' || s || ':' || k), 1, 15))::BIGINT AS pt FROM (SELECT unnest(range(8)) AS s), (SELECT unnest(range(256)) AS k))),
d AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, {crc_sql("text")}::BIGINT AS crc FROM documents),
h AS (SELECT *, ('0x' || substr(md5('key11:' || doc_id), 1, 15))::BIGINT >> 46 AS slot, row_number() OVER (ORDER BY ('0x' || substr(md5('order11:' || doc_id || ':' || size || ':' || coalesce(crc::VARCHAR, '-')), 1, 15))::BIGINT) AS nth FROM d),
w AS (SELECT nth, list(s ORDER BY steps) AS walk FROM (SELECT nth, s, min(CASE WHEN p.slot >= h.slot THEN j ELSE j + 2048 END) AS steps FROM h, p GROUP BY nth, s) GROUP BY nth),
c AS (SELECT list(n // 8 + CASE WHEN s < n % 8 THEN 1 ELSE 0 END ORDER BY s) AS room FROM (SELECT count(*) AS n FROM d), (SELECT unnest(range(8)) AS s)),
r(nth, shard, room) AS (SELECT 0::BIGINT, -1::BIGINT, room FROM c UNION ALL
  SELECT nth, shard, list_transform(room, lambda x, i: CASE WHEN i = shard + 1 THEN x - 1 ELSE x END) FROM (SELECT w.nth, list_filter(walk, lambda s: room[s + 1] > 0)[1] AS shard, room FROM r JOIN w ON w.nth = r.nth + 1))
SELECT doc_id, size::BIGINT AS size, crc AS text_crc32, 'rows' AS law, shard::INTEGER AS shard, row_number() OVER (PARTITION BY shard ORDER BY nth) - 1 AS slot, NULL::INTEGER AS grown_shard FROM h JOIN r USING (nth)
"""


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group_variants(table(spark, sf_dir, "documents"))


#: Near words meet in what is left of a word without one of its letters; ``chain`` is at most log2 of the largest n long.
OP13_SQL = f"""
WITH RECURSIVE t AS (SELECT doc_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS w FROM documents)),
c AS (SELECT w, k, {crc_sql("doc_id || ':' || w")} AS h FROM (SELECT doc_id, w, count(*) AS k FROM t GROUP BY ALL)),
v AS (SELECT word, sum(k)::BIGINT AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, (h % length(w))::INTEGER) || substr(w, (h % length(w))::INTEGER + 2) ELSE w END AS word, k FROM c) WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
x AS (SELECT word, n, length(word) AS len, i, substr(word, 1, (i - 1)::INTEGER) || substr(word, (i + 1)::INTEGER) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (SELECT a.word AS word, b.word AS near FROM x a JOIN x b ON a.rest = b.rest AND a.i = b.i AND a.len = b.len AND a.word <> b.word UNION SELECT x.word, v.word FROM x JOIN v ON x.rest = v.word UNION SELECT v.word, x.word FROM x JOIN v ON x.rest = v.word),
q AS (SELECT p.word, count(*) AS n_near, max(v.n) AS top, (list(p.near ORDER BY v.n DESC, encode(p.near)))[1] AS near FROM p JOIN v ON v.word = p.near GROUP BY p.word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 2 * v.n THEN near END AS form, CASE WHEN top >= 2 * v.n THEN top END AS form_n FROM v LEFT JOIN q USING (word)),
chain(word, here) AS (SELECT word, word FROM f UNION ALL SELECT chain.word, f.form FROM chain JOIN f ON f.word = chain.here WHERE f.form IS NOT NULL),
r AS (SELECT chain.word, chain.here AS root FROM chain JOIN f ON f.word = chain.here WHERE f.form IS NULL)
SELECT word, form, root, n, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n FROM f JOIN r USING (word)
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_text": op1_html_text,
        "op2_toxicity": op2_toxicity,
        "op3_language_id": op3_language_id,
        "op4_vector_graph": op4_vector_graph,
        "op5_line_dedup": op5_line_dedup,
        "op6_decontaminate": op6_decontaminate,
        "op7_simhash": op7_simhash,
        "op8_url_filter": op8_url_filter,
        "op9_mixing": op9_mixing,
        "op10_substring_dedup": op10_substring_dedup,
        "op11_merkle": op11_merkle,
        "op12_sharding": op12_sharding,
        "op13_variants": op13_variants,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_vector_graph": OP4_SQL, "op5_line_dedup": OP5_SQL, "op6_decontaminate": OP6_SQL, "op8_url_filter": OP8_SQL, "op10_substring_dedup": OP10_SQL, "op11_merkle": OP11_SQL, "op12_sharding": OP12_SQL, "op13_variants": OP13_SQL}
