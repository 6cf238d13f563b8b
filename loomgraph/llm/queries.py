"""The queries of this folder's operators, and SQL for those that SQL can check."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import canonical, chunking, clusters, leakage, near_dup, neighbours, pii, ranking, tokenise, vectors
from loomgraph.session import table

Query = Callable[[SparkSession, str], DataFrame]



def _memories(spark: SparkSession, d: str) -> DataFrame:
    """Title and content as one text; no text where the content is null."""
    m = table(spark, d, "memories").select("store_id", "title", "content").filter("content is not null")
    return m.select("store_id", F.concat_ws(" ", "title", "content").alias("t"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    out = near_dup.near_duplicate_pairs(_memories(spark, d), "store_id", F.col("t"), 0.7, 20)
    return out.select(F.col("a").alias("store_id_a"), F.col("b").alias("store_id_b"))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    out = near_dup.near_duplicate_groups(_memories(spark, d), "store_id", F.col("t"), 0.7, 20)
    return out.select(F.col("id").alias("store_id"), F.col("cls").alias("class_id"), "links", F.col("grp").alias("group_id"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "memories").select("store_id", "content").filter(F.length("content") > 512)
    m = m.groupBy("store_id").agg(F.max("content").alias("content"))  # a row delivered twice counts once
    return chunking.split_texts(m, "store_id", "content", 512, 50, 256).withColumnRenamed("id", "store_id")


def _usable(spark: SparkSession, d: str) -> DataFrame:
    return vectors.usable(table(spark, d, "node_vectors"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return clusters.vector_clusters(_usable(spark, d), 0.8, 5).withColumnRenamed("id", "vec_id")


def p3_described(spark: SparkSession, d: str) -> DataFrame:
    out = clusters.described_clusters(_usable(spark, d), 0.8, 5)
    return out.select(F.col("id").alias("vec_id"), "cluster_id", F.col("part_id").alias("medoid_id"), "size", F.round("typical", 6).alias("typical"), "typical_rank")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    n = neighbours.nearest_vectors(_usable(spark, d), 5, least=0.98)
    return n.select(F.least("id", "other").alias("vec_id_a"), F.greatest("id", "other").alias("vec_id_b")).distinct()


def p4_nearest(spark: SparkSession, d: str) -> DataFrame:
    n = neighbours.nearest_vectors(_usable(spark, d), 5, queries="id % 20 = 0")
    return n.select(F.col("id").alias("vec_id"), F.col("other").alias("similar_vec_id"), F.round("similarity", 6).alias("similarity"))


def _hits(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "search_results").select("query_id", "node_id", *ranking.SCORES)
    keep = h.groupBy("query_id", "node_id").agg(F.min(F.struct(*ranking.SCORES)).alias("s"))  # a hit logged twice counts once
    return keep.select("query_id", "node_id", "s.*")


def _fused(spark: SparkSession, d: str) -> DataFrame:
    return ranking.fused_scores(_hits(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    scored = _hits(spark, d)
    fused = ranking.fused_scores(scored)
    firsts = ranking.majority_firsts(fused)
    some = scored.filter(F.coalesce(*ranking.SCORES).isNotNull()).select("query_id").distinct()
    return firsts.join(some, "query_id", "left_semi")


def p5_ranked(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d).select("query_id", "node_id", F.round("fused", 6).alias("fused"))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "memories").select(F.lit("memories").alias("src"), F.col("store_id").alias("record_id"), F.col("content").alias("text"))
    return m.union(table(spark, d, "chat_messages").select(F.lit("chat_messages"), "message_id", "content"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.found_places(_texts(spark, d)).select("src", "record_id", "kind", "start_at").distinct()


def p6_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redacted_texts(_texts(spark, d)).distinct()


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenise.token_ids(table(spark, d, "documents"))


def p7_decoded(spark: SparkSession, d: str) -> DataFrame:
    return tokenise.decoded_texts(p7_ids(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id").distinct()


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return leakage.without_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.look_alikes(table(spark, d, "documents")).select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


def p9_classes(spark: SparkSession, d: str) -> DataFrame:
    return canonical.look_classes(table(spark, d, "documents")).withColumnRenamed("id", "doc_id")


def p9_texts(spark: SparkSession, d: str) -> DataFrame:
    return canonical.canonical_texts(table(spark, d, "documents"))


def queries() -> dict[str, Query]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1:2].isdigit() and callable(f)}


_USABLE = """u AS (SELECT vec_id, any_value(embedding) AS e FROM node_vectors
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY vec_id)"""


def _normal_sql(p: str) -> str:
    """The standard normal quantile in SQL: the fit of ``ranking``, whose own test is against the exact quantile."""
    a, b, c, d = ranking.FIT
    horner = lambda k, x: reduce(lambda s, v: f"({s} * {x} + {v!r}::DOUBLE)", k[1:], f"{k[0]!r}::DOUBLE")
    low, q = f"sqrt(-2 * ln(least({p}, 1 - {p})))", f"({p} - 0.5)"
    tail, mid = f"{horner(c, low)} / {horner(d, low)}", f"{q} * {horner(a, f'({q} * {q})')} / {horner(b, f'({q} * {q})')}"
    return f"CASE WHEN {p} < 0.02425 THEN {tail} WHEN {p} > 0.97575 THEN -({tail}) ELSE {mid} END"


def _form_sql(text: str) -> str:
    """The one form of a text in SQL: joiners before pictographs are set aside, invisible characters go, single characters are mapped, and what can be composed is."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    singles = {chr(c): f for c, f in canonical.mapping()[1].items()}
    one = {c: f for c, f in singles.items() if len(f) == 1}
    more = {c: f for c, f in singles.items() if len(f) > 1 and f != unicodedata.normalize("NFC", c)}
    t = rf"regexp_replace({text}, '\x{{200D}}([\x{{1F000}}-\x{{1FAFF}}\x{{2600}}-\x{{27BF}}])', chr(1) || '\1', 'g')"
    t = "regexp_replace(" + t + ", '[" + "".join(rf"\x{{{ord(c):X}}}" for c in canonical.INVISIBLE) + "]', '', 'g')"
    for c, f in more.items():
        t = f"replace({t}, {quote(c)}, {quote(f)})"
    return f"nfc_normalize(replace(translate({t}, {quote(''.join(one))}, {quote(''.join(one.values()))}), chr(1), chr(8205)))"


def oracle_sql() -> dict[str, str]:
    forms = f"f AS (SELECT doc_id, text, {_form_sql('text')} AS form FROM documents)"
    shown = "s AS (SELECT DISTINCT * FROM f WHERE trim(form, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '')"
    words = lambda x: rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}]+')"
    return {
        "p8_found": f"""
WITH {forms}, d AS (SELECT DISTINCT doc_id, {words("form")} AS w FROM f WHERE form IS NOT NULL),
i AS (SELECT DISTINCT item_id, {words(_form_sql("passage"))} AS w FROM eval_items WHERE passage IS NOT NULL),
dg AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, k, k + 11), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d WHERE len(w) >= 12)),
ig AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, k, k + 11), ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i WHERE len(w) >= 12))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
        "p8_spans": f"""
WITH {forms}, d AS (SELECT DISTINCT doc_id, {words("form")} AS w FROM f WHERE form IS NOT NULL),
i AS (SELECT DISTINCT item_id, {words(_form_sql("passage"))} AS w FROM eval_items WHERE passage IS NOT NULL),
dg AS (SELECT doc_id, len(w) AS n, k, array_to_string(list_slice(w, k, k + 11), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d WHERE len(w) >= 12)),
ig AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, k, k + 11), ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i WHERE len(w) >= 12)),
m AS (SELECT doc_id, item_id, n, k, CASE WHEN k - lag(k) OVER (PARTITION BY doc_id, item_id ORDER BY k) <= 12 THEN 0 ELSE 1 END AS fresh FROM dg JOIN ig USING (g)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, item_id ORDER BY k) AS run FROM m),
s AS (SELECT doc_id, item_id, n, max(k) + 12 - min(k) AS len FROM r GROUP BY doc_id, item_id, n, run)
SELECT doc_id, item_id, max(len) AS longest, sum(len)::BIGINT AS covered, n AS n_words FROM s GROUP BY doc_id, item_id, n""",
        "p5_ranked": f"""
WITH h AS (SELECT query_id, node_id, unnest(min(struct_pack(vector_score, bm25_score, rrf_score))) FROM search_results GROUP BY 1, 2),
r AS (SELECT query_id, node_id, count(*) OVER q AS n, {", ".join(f"rank() OVER (PARTITION BY query_id ORDER BY {c} ASC NULLS FIRST) AS {c}_up, rank() OVER (PARTITION BY query_id ORDER BY {c} DESC NULLS LAST) AS {c}_down" for c in ranking.SCORES)} FROM h WINDOW q AS (PARTITION BY query_id)),
p AS (SELECT query_id, node_id, {", ".join(f"({c}_up + n - {c}_down) / (2.0::DOUBLE * n) AS {c}" for c in ranking.SCORES)} FROM r)
SELECT query_id, node_id, round(({" + ".join(_normal_sql(c) for c in ranking.SCORES)}) / 3, 6) AS fused FROM p""",
        "p9_found": f"WITH {forms}, {shown} SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM s a JOIN s b ON a.form = b.form AND a.text <> b.text AND a.doc_id < b.doc_id",
        "p9_classes": f"WITH {forms}, {shown}, c AS (SELECT form, min(doc_id) AS class_id, count(*) AS members, count(DISTINCT text) AS ways FROM s GROUP BY 1) SELECT doc_id, class_id, members, ways FROM s JOIN c USING (form)",
        "p9_texts": f"WITH {forms} SELECT doc_id, form AS text FROM f",
        "p1_groups": r"""
WITH RECURSIVE w AS (SELECT store_id, any_value(list_sort(list_distinct(regexp_extract_all(lower(coalesce(title, '') || ' ' || content), '[\p{L}\p{N}]+')))) AS ws
           FROM memories WHERE content IS NOT NULL GROUP BY store_id),
s AS (SELECT store_id, ws, min(store_id) OVER (PARTITION BY ws) AS cls, len(ws) AS n FROM w WHERE len(ws) >= 20),
t AS (SELECT DISTINCT cls, n, unnest(ws) AS word FROM s),
c AS (SELECT a.cls AS a, b.cls AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM t a JOIN t b ON a.word = b.word AND a.cls <> b.cls AND 10 * least(a.n, b.n) >= 7 * greatest(a.n, b.n) GROUP BY 1, 2),
l AS (SELECT a, b FROM c WHERE 10 * k >= 7 * (na + nb - k)),
r(a, g) AS (SELECT DISTINCT cls, cls FROM s UNION SELECT l.b, r.g FROM r JOIN l ON l.a = r.a),
g AS (SELECT a, min(g) AS g FROM r GROUP BY 1),
d AS (SELECT a, count(*) AS links FROM l GROUP BY 1)
SELECT store_id, cls AS class_id, coalesce(links, 0) AS links, g AS group_id FROM s JOIN g ON g.a = cls LEFT JOIN d ON d.a = cls""",
        "p2_found": r"""
WITH RECURSIVE m AS (SELECT store_id, max(content) AS c FROM memories WHERE length(content) > 512 GROUP BY 1),
n AS (SELECT store_id, length(c) AS len, list_transform(range(1, length(c) + 1), lambda i: c[i]) AS ch FROM m),
b AS (SELECT store_id, len,
  list_filter(range(2, len + 1), lambda e: ch[e] = chr(10) AND (ch[e - 1] = chr(10) OR (e > 2 AND ch[e - 1] = chr(13) AND ch[e - 2] = chr(10)))) AS blank,
  list_filter(range(2, len + 1), lambda e: ch[e] IN ('。', '！', '？') OR (ch[e] IN (' ', chr(9), chr(10), chr(13)) AND ch[e - 1] IN ('.', '!', '?'))) AS sentence,
  list_filter(range(1, len + 1), lambda e: ch[e] IN (' ', chr(9), chr(10), chr(13))) AS space FROM n),
p(store_id, len, blank, sentence, space, a, e) AS (
  SELECT store_id, len, blank, sentence, space, -1::BIGINT, 50::BIGINT FROM b
  UNION ALL
  SELECT store_id, len, blank, sentence, space, e - 50,
    CASE WHEN len - (e - 50) <= 512 THEN len ELSE coalesce(
      list_max(list_filter(blank, lambda x: x > e - 50 + 256 AND x <= e - 50 + 512)),
      list_max(list_filter(sentence, lambda x: x > e - 50 + 256 AND x <= e - 50 + 512)),
      list_max(list_filter(space, lambda x: x > e - 50 + 256 AND x <= e - 50 + 512)),
      e - 50 + 512) END
  FROM p WHERE e < len OR a < 0)
SELECT store_id, a AS start_at, e AS end_at FROM p WHERE a >= 0""",
        "p3_found": f"""
WITH RECURSIVE {_USABLE},
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e::DOUBLE[], b.e::DOUBLE[]) >= 0.8),
c(id, r) USING KEY (id) AS (SELECT vec_id, vec_id FROM u UNION SELECT l.b, min(c.r) FROM c JOIN l ON l.a = c.id JOIN recurring.c AS k ON k.id = l.b WHERE c.r < k.r GROUP BY l.b),
n AS (SELECT r FROM c GROUP BY 1 HAVING count(*) >= 5)
SELECT id AS vec_id, r AS cluster_id FROM c WHERE r IN (SELECT r FROM n)""",
        "p1_found": r"""
WITH w AS (SELECT store_id, any_value(list_distinct(regexp_extract_all(lower(coalesce(title, '') || ' ' || content), '[\p{L}\p{N}]+'))) AS ws
           FROM memories WHERE content IS NOT NULL GROUP BY store_id),
s AS (SELECT store_id, ws, len(ws) AS n FROM w WHERE len(ws) >= 20),
t AS (SELECT store_id, n, unnest(ws) AS word FROM s),
c AS (SELECT a.store_id AS store_id_a, b.store_id AS store_id_b, a.n AS na, b.n AS nb, count(*) AS k
      FROM t a JOIN t b ON a.word = b.word AND a.store_id < b.store_id AND 10 * least(a.n, b.n) >= 7 * greatest(a.n, b.n)
      GROUP BY ALL)
SELECT store_id_a, store_id_b FROM c WHERE 10 * k >= 7 * (na + nb - k)""",
        "p4_found": f"""
WITH {_USABLE},
c AS (SELECT a.vec_id AS x, b.vec_id AS y, list_cosine_similarity(a.e::DOUBLE[], b.e::DOUBLE[]) AS s FROM u a JOIN u b ON a.vec_id <> b.vec_id),
r AS (SELECT x, y, s, row_number() OVER (PARTITION BY x ORDER BY s DESC, y) AS k FROM c)
SELECT DISTINCT least(x, y) AS vec_id_a, greatest(x, y) AS vec_id_b FROM r WHERE k <= 5 AND s >= 0.98""",
        "p4_nearest": f"""
WITH {_USABLE},
c AS (SELECT a.vec_id AS x, b.vec_id AS y, list_cosine_similarity(a.e::DOUBLE[], b.e::DOUBLE[]) AS s FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
r AS (SELECT x, y, s, row_number() OVER (PARTITION BY x ORDER BY s DESC, y) AS k FROM c)
SELECT x AS vec_id, y AS similar_vec_id, round(s, 6) AS similarity FROM r WHERE k <= 5""",
        "p5_found": """
WITH h AS (SELECT DISTINCT query_id, node_id, coalesce(vector_score, '-infinity'::DOUBLE) AS v, coalesce(bm25_score, '-infinity'::DOUBLE) AS b, coalesce(rrf_score, '-infinity'::DOUBLE) AS r FROM search_results),
q AS (SELECT query_id, count(*) AS n, max(greatest(v, b, r)) AS top FROM h GROUP BY query_id),
w AS (SELECT x.query_id, x.node_id, count(y.node_id) AS beaten
      FROM h x LEFT JOIN h y ON x.query_id = y.query_id AND x.node_id <> y.node_id AND (x.v > y.v)::INT + (x.b > y.b)::INT + (x.r > y.r)::INT >= 2
      GROUP BY x.query_id, x.node_id)
SELECT w.query_id, w.node_id FROM w JOIN q ON w.query_id = q.query_id WHERE beaten = n - 1 AND top > '-infinity'::DOUBLE""",
        "p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    }
