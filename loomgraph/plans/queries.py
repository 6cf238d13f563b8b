"""Queries over the test tables, each with SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.cypher.lower import run
from loomgraph.cypher.write import execute
from loomgraph.functions import temporal
from loomgraph.operators import algorithms as alg
from loomgraph.operators import linkprediction as lp
from loomgraph.operators import search, timeline
from loomgraph.plans import procedures
from loomgraph.plans.library_queries import CHANGED, GENERIC, LIBRARY
from loomgraph.plans.mapping import frame, memory_graph, trade_graph
from loomgraph.session import table

Query = Callable[[SparkSession, str], DataFrame]
NOW = "2026-01-01 00:00:00"

# name: (query text, SQL)
TRADE: dict[str, tuple[str, str]] = {
    "flagship": (
        "MATCH (c:Customer)-[:PLACED]->(o:Order)-[r:CONTAINS]->(p:Part) WHERE o.o_orderstatus = 'F' RETURN c.c_mktsegment AS seg, count(r) AS n, round(sum(r.l_extendedprice), 2) AS revenue ORDER BY n DESC LIMIT 10",
        "SELECT c_mktsegment AS seg, count(*) AS n, round(sum(l_extendedprice), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE o_orderstatus = 'F' GROUP BY 1 ORDER BY n DESC LIMIT 10",
    ),
    "match_label": ("MATCH (n:Nation) RETURN n.n_nationkey AS k, n.n_name AS name", "SELECT n_nationkey AS k, n_name AS name FROM nation"),
    "match_inline": ("MATCH (c:Customer {c_mktsegment: 'BUILDING'}) RETURN c.c_custkey AS k", "SELECT c_custkey AS k FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "match_where": ("MATCH (p:Part) WHERE p.p_size > 30 AND (p.p_retailprice < 1500 OR NOT p.p_brand STARTS WITH 'Brand#1') RETURN p.p_partkey AS k", "SELECT p_partkey AS k FROM part WHERE p_size > 30 AND (p_retailprice < 1500 OR NOT starts_with(p_brand, 'Brand#1'))"),
    "match_all_nodes": ("MATCH (n) RETURN count(n) AS n", "SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part) + (SELECT count(*) FROM orders) AS n"),
    "hop_out": ("MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN c.c_custkey AS c, o.o_orderkey AS o", "SELECT c_custkey AS c, o_orderkey AS o FROM customer JOIN orders ON o_custkey = c_custkey"),
    "hop_in": ("MATCH (o:Order)<-[:PLACED]-(c:Customer {c_mktsegment: 'MACHINERY'}) RETURN o.o_orderkey AS o, c.c_name AS name", "SELECT o_orderkey AS o, c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'MACHINERY'"),
    "hop_undirected": ("MATCH (n:Nation)-[:IN]-(r:Region) RETURN n.n_name AS n, r.r_name AS r", "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "hop_chain": (
        "MATCH (r:Region)<-[:IN]-(n:Nation)<-[:LIVES_IN]-(c:Customer)-[:PLACED]->(o:Order) RETURN r.r_name AS region, n.n_name AS nation, count(o) AS orders, round(avg(o.o_totalprice), 2) AS mean",
        "SELECT r_name AS region, n_name AS nation, count(*) AS orders, round(avg(o_totalprice), 2) AS mean FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2",
    ),
    "hop_types": (
        "MATCH (x)-[r:LIVES_IN|BASED_IN]->(n:Nation) RETURN n.n_name AS nation, type(r) AS kind, count(*) AS n",
        "SELECT n_name AS nation, kind, count(*) AS n FROM (SELECT c_nationkey AS k, 'LIVES_IN' AS kind FROM customer UNION ALL SELECT s_nationkey, 'BASED_IN' FROM supplier) JOIN nation ON k = n_nationkey GROUP BY 1, 2",
    ),
    "rel_props": ("MATCH (o:Order)-[r:CONTAINS]->(p:Part) WHERE r.l_quantity >= 45 RETURN o.o_orderkey AS o, p.p_partkey AS p, r.l_quantity AS q", "SELECT l_orderkey AS o, l_partkey AS p, l_quantity AS q FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity >= 45"),
    "shared_part": (
        "MATCH (a:Supplier)-[:SUPPLIES]->(p:Part)<-[:SUPPLIES]-(b:Supplier) WHERE a.s_suppkey < b.s_suppkey RETURN a.s_suppkey AS a, b.s_suppkey AS b, count(p) AS parts",
        "WITH s AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem) SELECT x.s AS a, y.s AS b, count(*) AS parts FROM s x JOIN s y ON x.p = y.p AND x.s < y.s GROUP BY 1, 2",
    ),
    "comma_join": ("MATCH (c:Customer), (s:Supplier) WHERE c.c_nationkey = s.s_nationkey RETURN c.c_nationkey AS k, count(*) AS n", "SELECT c_nationkey AS k, count(*) AS n FROM customer JOIN supplier ON c_nationkey = s_nationkey GROUP BY 1"),
    "multi_match": ("MATCH (n:Nation)-[:IN]->(r:Region) MATCH (s:Supplier)-[:BASED_IN]->(n) RETURN r.r_name AS r, count(s) AS n", "SELECT r_name AS r, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1"),
    "optional_match": ("MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 400000 RETURN c.c_custkey AS c, count(o) AS n", "SELECT c_custkey AS c, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 400000 GROUP BY 1"),
    "optional_outer_where": ("MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 40 * c.c_acctbal RETURN c.c_custkey AS c, count(o) AS n", "SELECT c_custkey AS c, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 40 * c_acctbal GROUP BY 1"),
    "exists": ("MATCH (c:Customer) WHERE EXISTS { MATCH (c)-[:PLACED]->(o:Order) WHERE o.o_orderpriority = '1-URGENT' } RETURN c.c_custkey AS c", "SELECT c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')"),
    "not_exists": ("MATCH (c:Customer) WHERE NOT EXISTS { (c)-[:PLACED]->(:Order) } RETURN c.c_custkey AS c", "SELECT c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)"),
    "pattern_predicate": ("MATCH (s:Supplier) WHERE (s)-[:SUPPLIES]->(:Part {p_size: 1}) RETURN s.s_suppkey AS s", "SELECT s_suppkey AS s FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size = 1)"),
    "count_subquery": ("MATCH (c:Customer) WHERE COUNT { (c)-[:PLACED]->(:Order) } > 12 RETURN c.c_custkey AS c", "SELECT o_custkey AS c FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1 HAVING count(*) > 12"),
    "collect_subquery": ("MATCH (n:Nation) RETURN n.n_name AS n, size(COLLECT { MATCH (n)<-[:BASED_IN]-(s:Supplier) RETURN s.s_suppkey }) AS k", "SELECT n_name AS n, count(s_suppkey)::INT AS k FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1"),
    "with_having": ("MATCH (c:Customer)-[:PLACED]->(o:Order) WITH c, count(o) AS n, sum(o.o_totalprice) AS total WHERE n >= 10 RETURN c.c_custkey AS c, n, round(total, 2) AS total ORDER BY total DESC, c LIMIT 50", "SELECT o_custkey AS c, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1 HAVING count(*) >= 10 ORDER BY total DESC, c LIMIT 50"),
    "with_then_match": ("MATCH (c:Customer) WITH c ORDER BY c.c_acctbal DESC, c.c_custkey LIMIT 20 MATCH (c)-[:PLACED]->(o:Order) RETURN c.c_custkey AS c, count(o) AS n", "SELECT c_custkey AS c, count(*) AS n FROM (SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20) JOIN orders ON o_custkey = c_custkey GROUP BY 1"),
    "unwind": ("UNWIND [3, 1, 2, 2] AS x RETURN x, count(*) AS n", "SELECT x, count(*) AS n FROM (SELECT unnest([3, 1, 2, 2]) AS x) GROUP BY 1"),
    "double_unwind": ("UNWIND [[1, 2], [3]] AS xs UNWIND xs AS x RETURN x * 2 AS y", "SELECT unnest([2, 4, 6]::BIGINT[]) AS y"),
    "unwind_match": ("UNWIND ['BUILDING', 'FURNITURE'] AS seg MATCH (c:Customer) WHERE c.c_mktsegment = seg RETURN seg, count(c) AS n", "SELECT c_mktsegment AS seg, count(*) AS n FROM customer WHERE c_mktsegment IN ('BUILDING', 'FURNITURE') GROUP BY 1"),
    "distinct": ("MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN DISTINCT c.c_mktsegment AS seg, o.o_orderpriority AS pr", "SELECT DISTINCT c_mktsegment AS seg, o_orderpriority AS pr FROM customer JOIN orders ON o_custkey = c_custkey"),
    "order_skip_limit": ("MATCH (p:Part) RETURN p.p_partkey AS k, p.p_retailprice AS price ORDER BY price DESC, k SKIP 5 LIMIT 20", "SELECT p_partkey AS k, p_retailprice AS price FROM part ORDER BY price DESC, k LIMIT 20 OFFSET 5"),
    "union_all": ("MATCH (c:Customer) RETURN c.c_nationkey AS k UNION ALL MATCH (s:Supplier) RETURN s.s_nationkey AS k", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier"),
    "union": ("MATCH (c:Customer) RETURN c.c_nationkey AS k UNION MATCH (s:Supplier) RETURN s.s_nationkey AS k", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier"),
    "call_subquery": ("MATCH (n:Nation) CALL { WITH n MATCH (n)<-[:LIVES_IN]-(c:Customer) RETURN count(c) AS customers } RETURN n.n_name AS n, customers", "SELECT n_name AS n, count(*) AS customers FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1"),
    "call_uncorrelated": ("CALL { MATCH (p:Part) RETURN max(p.p_retailprice) AS top } MATCH (p:Part) WHERE p.p_retailprice = top RETURN p.p_partkey AS k", "SELECT p_partkey AS k FROM part WHERE p_retailprice = (SELECT max(p_retailprice) FROM part)"),
    "case_simple": ("MATCH (o:Order) RETURN CASE o.o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'part' END AS s, count(*) AS n", "SELECT CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'part' END AS s, count(*) AS n FROM orders GROUP BY 1"),
    "case_aggregate": ("MATCH (o:Order) RETURN o.o_orderpriority AS p, sum(CASE WHEN o.o_totalprice > 200000 THEN 1 ELSE 0 END) AS high, count(*) AS n", "SELECT o_orderpriority AS p, sum(CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END)::BIGINT AS high, count(*) AS n FROM orders GROUP BY 1"),
    "agg_all": ("MATCH (p:Part) RETURN count(*) AS n, count(DISTINCT p.p_brand) AS brands, sum(p.p_size) AS total, round(avg(p.p_retailprice), 4) AS mean, min(p.p_size) AS lo, max(p.p_size) AS hi", "SELECT count(*) AS n, count(DISTINCT p_brand) AS brands, sum(p_size)::BIGINT AS total, round(avg(p_retailprice), 4) AS mean, min(p_size) AS lo, max(p_size) AS hi FROM part"),
    "agg_spread": ("MATCH (p:Part) RETURN p.p_brand AS b, round(stDev(p.p_retailprice), 4) AS sd, round(stDevP(p.p_retailprice), 4) AS sdp, round(percentileCont(p.p_retailprice, 0.5), 4) AS med", "SELECT p_brand AS b, round(stddev_samp(p_retailprice), 4) AS sd, round(stddev_pop(p_retailprice), 4) AS sdp, round(quantile_cont(p_retailprice, 0.5), 4) AS med FROM part GROUP BY 1"),
    "agg_empty": ("MATCH (p:Part) WHERE p.p_size < 0 RETURN count(p) AS n, sum(p.p_size) AS s", "SELECT 0::BIGINT AS n, 0::BIGINT AS s"),
    "agg_arithmetic": ("MATCH (o:Order)-[r:CONTAINS]->(p:Part) RETURN p.p_brand AS b, round(sum(r.l_extendedprice) / sum(r.l_quantity), 4) AS unit", "SELECT p_brand AS b, round(sum(l_extendedprice) / sum(l_quantity), 4) AS unit FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey GROUP BY 1"),
    "collect_size": ("MATCH (n:Nation)-[:IN]->(r:Region) WITH r, collect(n.n_name) AS names RETURN r.r_name AS r, size(names) AS n", "SELECT r_name AS r, count(*)::INT AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
    "list_comprehension": ("UNWIND [1, 2, 3, 4, 5] AS x WITH collect(x) AS xs RETURN reduce(a = 0, y IN [z IN xs WHERE z % 2 = 1 | z * z] | a + y) AS s", "SELECT 35 AS s"),
    "list_predicates": ("UNWIND [[1, 2, 3], [4, 5], [6, 7, 8]] AS xs RETURN all(x IN xs WHERE x > 1) AS a, any(x IN xs WHERE x > 5) AS b, none(x IN xs WHERE x = 2) AS c, single(x IN xs WHERE x > 4) AS d", "SELECT * FROM (VALUES (false, false, false, false), (true, false, true, true), (true, true, true, false)) t(a, b, c, d)"),
    "slices": ("WITH [10, 20, 30, 40] AS xs RETURN xs[0] AS a, xs[-1] AS b, size(xs[1..3]) AS c, head(xs) AS d, last(xs) AS e, size(tail(xs)) AS f", "SELECT 10 AS a, 40 AS b, 2 AS c, 10 AS d, 40 AS e, 3 AS f"),
    "text_functions": (
        "MATCH (n:Nation) RETURN toLower(n.n_name) AS a, left(n.n_name, 2) AS b, right(n.n_name, 2) AS c, substring(n.n_name, 1, 3) AS d, replace(n.n_name, 'A', 'x') AS e, size(n.n_name) AS f, reverse(n.n_name) AS g, trim('  ' + n.n_name) AS h",
        "SELECT lower(n_name) AS a, left(n_name, 2) AS b, right(n_name, 2) AS c, substring(n_name, 2, 3) AS d, replace(n_name, 'A', 'x') AS e, length(n_name)::INT AS f, reverse(n_name) AS g, n_name AS h FROM nation",
    ),
    "math_functions": (
        "MATCH (p:Part) RETURN p.p_partkey AS k, abs(p.p_size - 25) AS a, round(sqrt(p.p_retailprice), 6) AS b, sign(p.p_size - 25) AS c, ceil(p.p_retailprice / 100) AS d, p.p_size % 7 AS e, round(log(p.p_retailprice), 6) AS f, round(p.p_size ^ 2, 1) AS g",
        "SELECT p_partkey AS k, abs(p_size - 25)::BIGINT AS a, round(sqrt(p_retailprice), 6) AS b, sign(p_size - 25)::INT AS c, ceil(p_retailprice / 100)::BIGINT AS d, p_size % 7 AS e, round(ln(p_retailprice), 6) AS f, round(pow(p_size, 2), 1) AS g FROM part",
    ),
    "conversions": ("UNWIND ['12', '7.9', 'x', 'true'] AS s RETURN s, toInteger(s) AS i, toFloat(s) AS f, toBoolean(s) AS b", "SELECT * FROM (VALUES ('12', 12::BIGINT, 12.0, NULL), ('7.9', 7, 7.9, NULL), ('x', NULL, NULL, NULL), ('true', NULL, NULL, true)) t(s, i, f, b)"),
    "temporal_functions": ("MATCH (o:Order) RETURN date.year(o.o_orderdate) AS y, date.quarter(o.o_orderdate) AS q, date.dayOfWeek(o.o_orderdate) AS dow, count(*) AS n", "SELECT year(o_orderdate)::INT AS y, quarter(o_orderdate)::INT AS q, isodow(o_orderdate)::INT AS dow, count(*) AS n FROM orders GROUP BY 1, 2, 3"),
    "coll_functions": ("WITH [3, 1, 2, 3] AS a, [3, 4] AS b RETURN apoc.coll.sum(a) AS s, apoc.coll.max(a) AS m, size(apoc.coll.toSet(a)) AS d, apoc.coll.contains(a, 2) AS c, size(apoc.coll.union(a, b)) AS u, size(apoc.coll.intersection(a, b)) AS i, apoc.coll.indexOf(a, 2) AS at, apoc.coll.occurrences(a, 3) AS o", "SELECT 9.0 AS s, 3 AS m, 3 AS d, true AS c, 4 AS u, 1 AS i, 2::BIGINT AS \"at\", 2 AS o"),
    "text_library": ("WITH 'Hello graph World' AS t RETURN apoc.text.capitalize('abc') AS a, apoc.text.camelCase(t) AS b, apoc.text.snakeCase('helloGraphWorld') AS c, apoc.text.slug(t) AS d, apoc.text.distance('kitten', 'sitting') AS e, apoc.text.indexOf(t, 'graph') AS f, apoc.text.clean('A-b c!') AS g", "SELECT 'Abc' AS a, 'helloGraphWorld' AS b, 'hello_graph_world' AS c, 'hello-graph-world' AS d, 3 AS e, 6 AS f, 'abc' AS g"),
    "number_library": ("RETURN apoc.math.gcd(84, 36) AS g, apoc.math.lcm(4, 6) AS l, apoc.math.isPrime(97) AS p, apoc.number.romanize(1994) AS r, apoc.number.arabize('MCMXCIV') AS a, apoc.number.toHex(255) AS h, apoc.math.fibonacci(10) AS f, apoc.bitwise.xor(6, 3) AS x, apoc.math.clamp(15, 0, 10) AS c", "SELECT 12::BIGINT AS g, 12::BIGINT AS l, true AS p, 'MCMXCIV' AS r, 1994 AS a, 'ff' AS h, 55::BIGINT AS f, 5 AS x, 10 AS c"),
    "hash_library": ("MATCH (n:Nation) RETURN n.n_name AS n, apoc.hashing.md5(n.n_name) AS m, apoc.util.sha256(n.n_name) AS s", "SELECT n_name AS n, md5(n_name) AS m, sha256(n_name) AS s FROM nation"),
    "stats_library": ("WITH [2.0, 4.0, 4.0, 4.0, 5.0, 5.0, 7.0, 9.0] AS x RETURN apoc.stats.mean(x) AS m, apoc.stats.stdDev(x) AS s, apoc.stats.median(x) AS d, apoc.scoring.cosine(x, x) AS c, apoc.stats.mode(x) AS o", "SELECT 5.0 AS m, 2.0 AS s, 4.5 AS d, 1.0 AS c, 4.0 AS o"),
    "agg_library": ("MATCH (p:Part) RETURN p.p_brand AS b, apoc.agg.median(p.p_size) AS med, round(apoc.agg.stdev(p.p_size), 6) AS sd", "SELECT p_brand AS b, median(p_size) AS med, round(stddev_pop(p_size), 6) AS sd FROM part GROUP BY 1"),
    "null_logic": ("UNWIND [1, null, 3] AS x RETURN x IS NULL AS a, coalesce(x, 0) AS b, x > 1 AS c, NOT (x > 1) AS d", "SELECT * FROM (VALUES (false, 1, false, true), (true, 0, NULL, NULL), (false, 3, true, false)) t(a, b, c, d)"),
    "regex_match": ("MATCH (c:Customer) WHERE c.c_name =~ '.*[02468]$' RETURN count(c) AS n", "SELECT count(*) AS n FROM customer WHERE regexp_matches(c_name, '.*[02468]$')"),
    "in_list": ("MATCH (n:Nation) WHERE n.n_nationkey IN [1, 3, 5] AND NOT n.n_name IN ['x'] RETURN n.n_name AS n", "SELECT n_name AS n FROM nation WHERE n_nationkey IN (1, 3, 5)"),
    "degree": ("MATCH (r:Region)<-[:IN]-(n:Nation) RETURN r.r_name AS r, count(n) AS n ORDER BY n DESC, r", "SELECT r_name AS r, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1"),
    "path_value": ("MATCH p = (n:Nation)-[:IN]->(r:Region) RETURN n.n_name AS n, length(p) AS len, size(nodes(p)) AS k", "SELECT n_name AS n, 1 AS len, 2 AS k FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "customers_like": (
        "MATCH (a:Customer)-[:PLACED]->(:Order)-[:CONTAINS]->(p:Part)<-[:CONTAINS]-(:Order)<-[:PLACED]-(b:Customer) WHERE a.c_custkey = 1 AND b.c_custkey <> 1 RETURN b.c_custkey AS b, count(DISTINCT p) AS shared",
        "WITH cp AS (SELECT DISTINCT o_custkey AS c, l_partkey AS p FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN part ON p_partkey = l_partkey) SELECT y.c AS b, count(DISTINCT y.p) AS shared FROM cp x JOIN cp y ON x.p = y.p WHERE x.c = 1 AND y.c <> 1 GROUP BY 1",
    ),
    "proc_labels": ("CALL db.labels() YIELD label RETURN label", "SELECT unnest(['Region', 'Nation', 'Customer', 'Supplier', 'Part', 'Order']) AS label"),
    "proc_stats": ("CALL engine.stats() YIELD nodes, labels RETURN nodes, labels", "SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part) + (SELECT count(*) FROM orders) AS nodes, 6::BIGINT AS labels"),
}

_N = "n AS (SELECT element_id AS id, labels, properties AS props, access_count, decay_score FROM (SELECT *, row_number() OVER (PARTITION BY element_id ORDER BY updated_at DESC, access_count DESC) AS k FROM nodes) WHERE k = 1)"
_R = "r AS (SELECT DISTINCT element_id AS id, source AS src, target AS dst, rel_type AS type, confidence FROM relationships)"
MEMORY: dict[str, tuple[str, str]] = {
    "generic_labels": ("MATCH (n) UNWIND labels(n) AS label RETURN label, count(*) AS n", f"WITH {_N} SELECT label, count(*) AS n FROM (SELECT unnest(labels) AS label FROM n) GROUP BY 1"),
    "generic_hop": ("MATCH (a)-[r]->(b) RETURN type(r) AS t, count(*) AS n", f"WITH {_N}, {_R} SELECT r.type AS t, count(*) AS n FROM r JOIN n a ON a.id = r.src JOIN n b ON b.id = r.dst GROUP BY 1"),
    "generic_dangling": ("MATCH (a) WHERE NOT EXISTS { (a)-[]->() } RETURN count(a) AS n", f"WITH {_N}, {_R} SELECT count(*) AS n FROM n WHERE id NOT IN (SELECT r.src FROM r JOIN n b ON b.id = r.dst)"),
    "generic_mutual": ("MATCH (a)-[x]->(b)-[y]->(a) WHERE elementId(a) < elementId(b) RETURN count(*) AS n", f"WITH {_N}, {_R} SELECT count(*) AS n FROM r x JOIN r y ON x.dst = y.src AND y.dst = x.src AND x.id <> y.id JOIN n a ON a.id = x.src JOIN n b ON b.id = x.dst WHERE x.src < x.dst"),
    "generic_confidence": ("MATCH (a)-[r]->(b) WHERE r.confidence >= 0.8 RETURN type(r) AS t, count(*) AS n, round(avg(r.confidence), 6) AS c", f"WITH {_N}, {_R} SELECT r.type AS t, count(*) AS n, round(avg(confidence), 6) AS c FROM r JOIN n a ON a.id = r.src JOIN n b ON b.id = r.dst WHERE confidence >= 0.8 GROUP BY 1"),
    "generic_hops_range": (
        "MATCH (a)-[:FOLLOWS*1..3]->(b) RETURN count(*) AS n, count(DISTINCT b) AS ends",
        f"WITH {_N}, {_R}, f AS (SELECT * FROM r WHERE type = 'FOLLOWS'), p AS (SELECT src AS s, dst AS t FROM f UNION ALL SELECT x.src, y.dst FROM f x JOIN f y ON x.dst = y.src AND x.id <> y.id UNION ALL SELECT x.src, z.dst FROM f x JOIN f y ON x.dst = y.src AND x.id <> y.id JOIN f z ON y.dst = z.src AND z.id NOT IN (x.id, y.id)) SELECT count(*) AS n, count(DISTINCT t) AS ends FROM p JOIN n a ON a.id = s JOIN n b ON b.id = t",
    ),
    "generic_shortest": (
        "MATCH (a:Task), (b:Task) WHERE elementId(a) < elementId(b) MATCH p = shortestPath((a)-[:RELATES_TO*..3]->(b)) RETURN length(p) AS len, count(*) AS n",
        f"WITH {_N}, {_R}, f AS (SELECT DISTINCT src, dst FROM r WHERE type = 'RELATES_TO'), w AS (SELECT src AS s, dst AS t, 1 AS d FROM f UNION ALL SELECT x.src, y.dst, 2 FROM f x JOIN f y ON x.dst = y.src UNION ALL SELECT x.src, z.dst, 3 FROM f x JOIN f y ON x.dst = y.src JOIN f z ON y.dst = z.src), m AS (SELECT s, t, min(d) AS d FROM w WHERE s < t GROUP BY 1, 2) SELECT d AS len, count(*) AS n FROM m JOIN n a ON a.id = s AND list_contains(a.labels, 'Task') JOIN n b ON b.id = t AND list_contains(b.labels, 'Task') GROUP BY 1",
    ),
}

# Updates, and what is read from the new version: (graph, update, query, SQL).
UPDATES: dict[str, tuple] = {
    "write_create": (trade_graph, "MATCH (r:Region) CREATE (:Office {name: r.r_name, region: r.r_regionkey})", "MATCH (o:Office) RETURN o.name AS name, o.region AS k", "SELECT r_name AS name, r_regionkey AS k FROM region"),
    "write_create_rel": (
        trade_graph,
        "MATCH (s:Supplier), (n:Nation) WHERE s.s_nationkey = n.n_nationkey AND s.s_acctbal > 5000 CREATE (n)-[:HOSTS {bal: s.s_acctbal}]->(s)",
        "MATCH (n:Nation)-[h:HOSTS]->(s:Supplier) RETURN n.n_name AS n, count(s) AS c, round(max(h.bal), 2) AS top",
        "SELECT n_name AS n, count(*) AS c, round(max(s_acctbal), 2) AS top FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_acctbal > 5000 GROUP BY 1",
    ),
    "write_set": (
        trade_graph,
        "MATCH (p:Part) WHERE p.p_size > 40 SET p.p_retailprice = p.p_retailprice * 2, p.big = true",
        "MATCH (p:Part) RETURN p.big AS big, count(*) AS n, round(sum(p.p_retailprice), 2) AS total",
        "SELECT CASE WHEN p_size > 40 THEN true END AS big, count(*) AS n, round(sum(CASE WHEN p_size > 40 THEN 2 ELSE 1 END * p_retailprice), 2) AS total FROM part GROUP BY 1",
    ),
    "write_remove": (trade_graph, "MATCH (c:Customer {c_mktsegment: 'BUILDING'}) REMOVE c.c_acctbal", "MATCH (c:Customer) WHERE c.c_acctbal IS NULL RETURN c.c_custkey AS k", "SELECT c_custkey AS k FROM customer WHERE c_mktsegment = 'BUILDING' OR c_acctbal IS NULL"),
    "write_merge": (trade_graph, "MATCH (c:Customer) WITH DISTINCT c.c_mktsegment AS seg MERGE (s:Segment {name: seg}) ON CREATE SET s.fresh = true", "MATCH (s:Segment) RETURN s.name AS name, s.fresh AS fresh", "SELECT DISTINCT c_mktsegment AS name, true AS fresh FROM customer"),
    "write_delete": (
        memory_graph,
        "MATCH (n:Memory) DETACH DELETE n",
        "MATCH ()-[r]->() RETURN type(r) AS t, count(*) AS n",
        f"WITH {_N}, {_R}, k AS (SELECT id FROM n WHERE NOT coalesce(list_contains(labels, 'Memory'), false)) SELECT r.type AS t, count(*) AS n FROM r JOIN k a ON a.id = src JOIN k b ON b.id = dst GROUP BY 1",
    ),
    "write_delete_rel": (
        memory_graph,
        "MATCH (a)-[r:RELATES_TO]->(b) WHERE r.confidence < 0.5 DELETE r",
        "MATCH ()-[r:RELATES_TO]->() RETURN count(r) AS n",
        f"WITH {_N}, {_R} SELECT count(*) AS n FROM r JOIN n a ON a.id = src JOIN n b ON b.id = dst WHERE type = 'RELATES_TO' AND (confidence >= 0.5 OR confidence IS NULL)",
    ),
}


def _updated(graph, update: str, text: str) -> Query:
    return lambda spark, d: run(execute(graph(spark, d), spark, update).graph, spark, text)


def _text(graph, text: str) -> Query:
    return lambda spark, d: run(graph(spark, d), spark, text)


def _clean_edges(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "relationships").filter("source is not null and target is not null")
    last = lambda c: F.element_at(F.split(c, ":"), -1).cast("bigint")
    return r.select(last("source").alias("src"), last("target").alias("dst")).distinct()


def q_wcc(spark, d):
    return alg.wcc(_clean_edges(spark, d))


def q_pagerank(spark, d):
    return alg.pagerank(_clean_edges(spark, d)).select("id", F.round("score", 9).alias("score"))


def q_triangles(spark, d):
    return alg.triangles(_clean_edges(spark, d))


def q_k_core(spark, d):
    return alg.k_core(_clean_edges(spark, d), 4)


def q_bfs(spark, d):
    e = _clean_edges(spark, d)
    hub = e.groupBy("src").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "src").limit(1).select(F.col("src").alias("id"))
    return alg.bfs(e, hub, 2, "out")


def q_label_propagation(spark, d):
    return alg.label_propagation(_clean_edges(spark, d))


def q_louvain(spark, d):
    return alg.louvain(_clean_edges(spark, d))


def q_fastrp(spark, d):
    return alg.fastrp(_clean_edges(spark, d), 16).select("id", F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding"))


def q_betweenness(spark, d):
    return alg.betweenness(_clean_edges(spark, d)).select("id", F.round("score", 9).alias("score"))


def q_closeness(spark, d):
    return alg.closeness(_clean_edges(spark, d)).select("id", F.round("score", 9).alias("score"))


def q_links(spark, d):
    return _links(_clean_edges(spark, d))


def _links(edges):
    r = lp.raw_scores(edges)
    return r.select("node1", "node2", "common", F.round("aa", 9).alias("aa"), F.round("ra", 9).alias("ra"), "pa", F.round("jaccard", 9).alias("jaccard"))


def q_bm25(spark, d):
    docs = table(spark, d, "documents").filter("text is not null")
    return search.bm25(docs, "doc_id", "text", "vector index recovery", prefix=False).select("doc_id", F.round("score", 6).alias("score"))


def q_fulltext(spark, d):
    docs = table(spark, d, "documents").filter("text is not null")
    return search.bm25_fixed(docs, "doc_id", "text", "cache +session -index").select("doc_id", F.round("score", 6).alias("score"))


def q_rrf(spark, d):
    h = table(spark, d, "search_results").select("query_id", "node_id", "vector_rank", "bm25_rank").distinct()
    k = h.select(F.concat_ws("|", F.col("query_id").cast("string"), "node_id").alias("key"), "vector_rank", "bm25_rank")
    v = k.filter("vector_rank is not null").select("key", F.col("vector_rank").alias("rank"))
    b = k.filter("bm25_rank is not null").select("key", F.col("bm25_rank").alias("rank"))
    return search.rrf([(v, 1.0), (b, 1.0)], "key").select("key", F.round("score", 9).alias("score"))


def q_knn(spark, d):
    e = table(spark, d, "embeddings")
    return search.nearest(e, "vec_id", "embedding", [1.0] * 32 + [-1.0] * 32, 10, least=-1.0).select("vec_id", F.round("score", 6).alias("score"))


def q_groups(spark, d):
    e = table(spark, d, "embeddings")
    return search.best_per_group(e, "vec_id", "embedding", "label", [1.0] * 32 + [-1.0] * 32, 2).select("label", "vec_id", F.round("score", 6).alias("score"))


def q_hybrid(spark, d):
    texts = table(spark, d, "memories").filter("node_id is not null and content is not null").groupBy(F.col("node_id").alias("node")).agg(F.max("content").alias("text"))
    vecs = table(spark, d, "node_vectors").filter("size(embedding) = 64").select(F.col("element_id").alias("node"), "embedding")
    return search.hybrid(texts, vecs, "node", "text", "embedding", "cache recovery", [1.0] * 32 + [-1.0] * 32, 20).select("node", F.round("score", 9).alias("score"))


def q_recommend(spark, d):
    return search.recommend(table(spark, d, "embeddings"), "vec_id", "embedding", [1, 2], [3], 10).select("vec_id", F.round("score", 5).alias("score"))


def q_kmeans(spark, d):
    return search.kmeans(table(spark, d, "embeddings"), "vec_id", "embedding", 10)


def q_measures(spark, d):
    h = table(spark, d, "search_results").select("query_id", "node_id", "vector_rank", "bm25_rank").distinct()
    ranked = h.filter("vector_rank is not null").select("query_id", F.col("node_id").alias("item"), F.col("vector_rank").alias("rank"))
    rel = h.filter("bm25_rank <= 3").select("query_id", F.col("node_id").alias("item"))
    m = search.retrieval_measures(ranked, rel)
    return m.select("query_id", *[F.round(c, 6).alias(c) for c in ("p5", "r10", "mrr")], "hit")


def q_sessions(spark, d):
    e = table(spark, d, "events")
    return timeline.session_summary(e, "user_id", "ts", 3600).select("user_id", "session", "n")


def q_daily(spark, d):
    return timeline.daily_pattern(table(spark, d, "events"), "user_id", "ts").select("user_id", "slot", F.round("confidence", 6).alias("confidence"))


def q_weekly(spark, d):
    return timeline.weekly_pattern(table(spark, d, "events"), "user_id", "ts").select("user_id", "slot", F.round("confidence", 6).alias("confidence"))


def q_bursts(spark, d):
    return timeline.bursts(table(spark, d, "events"), "event_type", "ts", 600, 6).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def q_co_access(spark, d):
    e = table(spark, d, "events")
    return timeline.co_access(e, "event_type", "user_id", "ts", 600, 2).select("a", "b", "n", F.round("confidence", 6).alias("confidence"))


def q_transitive(spark, d):
    r = table(spark, d, "relationships").filter("confidence >= 0.9").select(F.col("source").alias("src"), F.col("target").alias("dst"), "confidence").distinct()
    return timeline.transitive(r, 0.9).select("a", "c", F.round("confidence", 6).alias("confidence"))


def q_decay(spark, d):
    n = table(spark, d, "nodes").filter("last_accessed is not null").select("element_id", "last_accessed", "access_count").distinct()
    s = timeline.decay_score(F.col("last_accessed"), F.lit(NOW), F.coalesce("access_count", F.lit(0)), F.lit("semantic"))
    return n.select("element_id", "last_accessed", "access_count", F.round(s, 6).alias("score"))


def q_edge_decay(spark, d):
    r = table(spark, d, "relationships").filter("confidence is not null and created_at is not null").select("element_id", "confidence", "created_at", "auto_generated").distinct()
    at = F.lit("2024-09-01 00:00:00")
    return r.select("element_id", "confidence", "created_at", F.round(timeline.edge_decay(F.col("confidence"), F.col("created_at"), F.col("created_at"), F.col("auto_generated"), at), 6).alias("kept"))


def q_next_access(spark, d):
    return timeline.next_access(table(spark, d, "events"), "user_id", "ts").select("user_id", "n", F.round("mean_gap_s", 3).alias("gap"), F.round("confidence", 6).alias("confidence"))


def q_load(spark, d):
    return timeline.load_by_bucket(table(spark, d, "events"), "ts", 3600).select(F.unix_seconds("bucket").alias("bucket"), "n", F.round("z", 6).alias("z"))


def q_kalman(spark, d):
    f = temporal.fold_series(table(spark, d, "events").select("user_id", F.struct("ts", "event_id").alias("o"), "value"), "user_id", "o", "value")
    return f.select("user_id", F.col("n").cast("bigint").alias("n"), F.round(f["state"]["x"], 6).alias("x"))


def q_velocity(spark, d):
    f = temporal.fold_series(table(spark, d, "events").select("user_id", F.struct("ts", "event_id").alias("o"), "value"), "user_id", "o", "value", "velocity")
    return f.select("user_id", F.col("n").cast("bigint").alias("n"), F.round(f["state"]["pos"], 6).alias("pos"), F.round(f["state"]["vel"], 6).alias("vel"))


def q_cooldown(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "ts").distinct()
    return timeline.cooled(e, ["user_id", "event_type"], "ts", 86_400).select("user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))


def q_trend(spark, d):
    v = timeline.access_velocity(table(spark, d, "events").select("event_type", "ts").distinct(), "event_type", "ts")
    return v.select("event_type", "n", F.round("velocity", 6).alias("velocity"), timeline.trend(F.col("velocity")).alias("t")).select("event_type", "n", "velocity", "t.pattern", F.round("t.confidence", 6).alias("confidence"))


def q_hot_cold(spark, d):
    return timeline.hot_and_cold(table(spark, d, "events").select("user_id", "ts").distinct(), "user_id", "ts", 10).select("side", "user_id", F.round("velocity", 4).alias("velocity"), F.col("place").cast("bigint").alias("place"))


def q_evolution(spark, d):
    r = table(spark, d, "relationships").select("source", "target", "confidence", "created_at").distinct()
    e = timeline.evolution(r, "source", "target", "confidence", "created_at")
    return e.select("a", "b", "n", "direction", *[F.round(c, 6).alias(c) for c in ("velocity", "strength", "predicted", "confidence")])


def q_schema(spark, d):
    return procedures.visualization(trade_graph(spark, d), spark)


def q_fulltext_procedure(spark, d):
    g = frame(table(spark, d, "documents").filter("text is not null"), "Document", "doc_id")
    g.indexes["doc_text"] = {"type": "FULLTEXT", "labels": ["Document"], "properties": ["text"]}
    return run(g, spark, "CALL db.index.fulltext.queryNodes('doc_text', 'recovery snapshot') YIELD node, score RETURN node, round(score, 6) AS score")


def q_vector_procedure(spark, d):
    g = frame(table(spark, d, "embeddings"), "Vector", "vec_id")
    g.indexes["vec"] = {"type": "VECTOR", "labels": ["Vector"], "properties": ["embedding"], "metric": "cosine"}
    return run(g, spark, "CALL db.index.vector.queryNodes('vec', 5, $q) YIELD node, score RETURN node, round(score, 6) AS score", {"q": [1.0] * 32 + [-1.0] * 32})


_EDGES = "e AS (SELECT DISTINCT split_part(source, ':', 3)::BIGINT AS src, split_part(target, ':', 3)::BIGINT AS dst FROM relationships WHERE source IS NOT NULL AND target IS NOT NULL)"
_UND = _EDGES + ", u AS (SELECT src, dst FROM e WHERE src <> dst UNION SELECT dst, src FROM e WHERE src <> dst)"
_Q = "(" + " + ".join(f"embedding[{i + 1}]::DOUBLE * {1 if i < 32 else -1}" for i in range(64)) + ")"
_KNN = f"SELECT vec_id, round({_Q} / (sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) * 8), 6) AS score FROM embeddings"
_BASE = "ts, user_id, event_id, event_type, value"

_SERIES = "g AS (SELECT user_id, count(*) AS n, list(struct_pack(z := value) ORDER BY ts, event_id) AS zs FROM events WHERE value IS NOT NULL GROUP BY 1)"
_X0, _P1 = "(s.x + CASE WHEN s.n > 1 THEN (s.x - s.last) * 0.5 ELSE 0 END)", f"(s.p + {temporal.Q})"
_SCALAR_STEP = f"{{'x': {_X0} + {_P1} / ({_P1} + {temporal.R}) * (z.z - {_X0}), 'p': (1 - {_P1} / ({_P1} + {temporal.R})) * {_P1}, 'last': s.x, 'n': s.n + 1, 'z': 0.0::DOUBLE}}"
_P00, _P01, _P10, _P11 = "(s.p00 + s.p10 + s.p01 + s.p11 + 0.1)", "(s.p01 + s.p11)", "(s.p10 + s.p11)", "(s.p11 + 0.01)"
_IN = "(z.z - s.pos - s.vel)"
_VELOCITY = (
    f"list_reduce(zs[2:], lambda s, z: {{'pos': s.pos + s.vel + {_P00} / ({_P00} + 1) * {_IN}, 'vel': s.vel + {_P10} / ({_P00} + 1) * {_IN}, 'p00': (1 - {_P00} / ({_P00} + 1)) * {_P00}, 'p01': (1 - {_P00} / ({_P00} + 1)) * {_P01}, 'p10': {_P10} - {_P10} / ({_P00} + 1) * {_P00}, 'p11': {_P11} - {_P10} / ({_P00} + 1) * {_P01}}},"
    " {'pos': zs[1].z, 'vel': 0.0::DOUBLE, 'p00': 100.0::DOUBLE, 'p01': 0.0::DOUBLE, 'p10': 0.0::DOUBLE, 'p11': 10.0::DOUBLE})"
)
_GAPS = f"p AS (SELECT k, ts, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY k ORDER BY ts) AS z FROM t), g AS (SELECT k, count(*) AS n, list(struct_pack(z := z) ORDER BY ts) AS zs FROM p WHERE z IS NOT NULL GROUP BY 1), w AS (SELECT k, n, {_VELOCITY} AS s FROM g)"

OPS: dict[str, tuple[Query, str | None]] = {
    "wcc": (
        q_wcc,
        f"WITH RECURSIVE {_UND}, v AS (SELECT src AS id FROM e UNION SELECT dst FROM e), c(id, r) USING KEY (id) AS (SELECT id, id FROM v UNION SELECT u.dst, min(c.r) FROM c JOIN u ON u.src = c.id JOIN recurring.c AS k ON k.id = u.dst WHERE c.r < k.r GROUP BY u.dst) SELECT id, (dense_rank() OVER (ORDER BY r) - 1)::INT AS \"componentId\" FROM c",
    ),
    "pagerank": (q_pagerank, f"WITH RECURSIVE {_EDGES}, v AS (SELECT src AS id FROM e UNION SELECT dst FROM e), o AS (SELECT src, count(*) AS d FROM e GROUP BY 1), k AS (SELECT count(*) AS n FROM v), p(i, id, s) AS (SELECT 0, id, 1.0::DOUBLE / n FROM v, k UNION ALL (WITH l AS (SELECT coalesce(sum(p.s), 0) AS loose FROM p LEFT JOIN o ON o.src = p.id WHERE o.src IS NULL), g AS (SELECT e.dst, sum(p.s / o.d) AS got FROM p JOIN e ON e.src = p.id JOIN o ON o.src = p.id GROUP BY 1), m AS (SELECT max(i) AS i FROM p) SELECT m.i + 1, v.id, 0.15 / k.n + 0.85 * (coalesce(g.got, 0) + l.loose / k.n) FROM v CROSS JOIN k CROSS JOIN l CROSS JOIN m LEFT JOIN g ON g.dst = v.id WHERE m.i < 20)) SELECT id, round(s, 9) AS score FROM p WHERE i = 20"),
    "triangles": (q_triangles, f"WITH {_UND} SELECT a.src AS id, count(*) AS triangles FROM u a JOIN u b ON a.dst = b.src JOIN u c ON b.dst = c.src AND c.dst = a.src WHERE a.dst < b.dst GROUP BY 1"),
    "k_core": (
        q_k_core,
        f"WITH RECURSIVE {_UND}, k(i, src, dst) AS (SELECT 0, src, dst FROM u UNION ALL (WITH d AS (SELECT src FROM k GROUP BY 1 HAVING count(*) >= 4) SELECT i + 1, src, dst FROM k WHERE src IN (SELECT src FROM d) AND dst IN (SELECT src FROM d) AND i < 40)) SELECT DISTINCT src AS id FROM k WHERE i = 40",
    ),
    "bfs": (
        q_bfs,
        f"WITH {_EDGES}, h AS (SELECT src FROM e GROUP BY 1 ORDER BY count(*) DESC, src LIMIT 1), a AS (SELECT DISTINCT dst AS id FROM e JOIN h USING (src)), b AS (SELECT DISTINCT e.dst AS id FROM e JOIN a ON e.src = a.id) SELECT id, min(depth)::INT AS depth FROM (SELECT src AS id, 0 AS depth FROM h UNION ALL SELECT id, 1 FROM a UNION ALL SELECT id, 2 FROM b) GROUP BY 1",
    ),
    "label_propagation": (q_label_propagation, None),
    "louvain": (q_louvain, None),
    "fastrp": (q_fastrp, None),
    "closeness": (
        q_closeness,
        f"WITH RECURSIVE {_UND}, v AS (SELECT src AS id FROM e UNION SELECT dst FROM e), w(s, t, d) USING KEY (s, t) AS (SELECT id, id, 0 FROM v UNION SELECT w.s, u.dst, min(w.d) + 1 FROM w JOIN u ON u.src = w.t LEFT JOIN recurring.w AS k ON k.s = w.s AND k.t = u.dst WHERE k.s IS NULL GROUP BY 1, 2), m AS (SELECT s, t, min(d) AS d FROM w GROUP BY 1, 2) SELECT s AS id, coalesce(round((count(*) - 1)::DOUBLE * (count(*) - 1) / nullif(sum(d) * ((SELECT count(*) FROM v) - 1), 0), 9), 0) AS score FROM m GROUP BY 1",
    ),
    "betweenness": (q_betweenness, None),
    "link_prediction": (
        q_links,
        f"WITH {_UND}, deg AS (SELECT src, count(*) AS d FROM u GROUP BY 1), w AS (SELECT a.src AS node1, b.dst AS node2, a.dst AS m FROM u a JOIN u b ON a.dst = b.src WHERE a.src < b.dst) SELECT node1, node2, count(*) AS common, round(sum(CASE WHEN k.d > 1 THEN 1 / ln(k.d) ELSE 0 END), 9) AS aa, round(sum(1.0::DOUBLE / k.d), 9) AS ra, any_value(x.d) * any_value(y.d) AS pa, round(count(*) / (any_value(x.d) + any_value(y.d) - count(*))::DOUBLE, 9) AS jaccard FROM w JOIN deg k ON k.src = m JOIN deg x ON x.src = node1 JOIN deg y ON y.src = node2 LEFT JOIN u ON u.src = node1 AND u.dst = node2 WHERE u.src IS NULL GROUP BY 1, 2",
    ),
    "bm25": (
        q_bm25,
        "WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: length(w) > 1 AND w NOT IN (" + ", ".join(f"'{w}'" for w in search.STOP_WORDS) + ")) AS ts FROM documents WHERE text IS NOT NULL), d AS (SELECT doc_id, ts, len(ts) AS dl FROM t WHERE len(ts) > 0), s AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM d), x AS (SELECT doc_id, dl, unnest(ts) AS term FROM d), f AS (SELECT doc_id, dl, term, count(*) AS tf FROM x WHERE term IN ('vector', 'index', 'recovery') GROUP BY ALL), g AS (SELECT term, count(*) AS df FROM f GROUP BY 1) SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM f JOIN g USING (term) CROSS JOIN s GROUP BY 1",
    ),
    "fulltext": (q_fulltext, "WITH d AS (SELECT doc_id, lower(text) AS t FROM documents WHERE text IS NOT NULL), s AS (SELECT count(*) AS n, count(*) FILTER (contains(t, 'cache')) AS d1, count(*) FILTER (contains(t, 'session')) AS d2 FROM d), x AS (SELECT doc_id, n, d1, d2, (length(t) - length(replace(t, 'cache', ''))) / 5.0::DOUBLE AS c1, (length(t) - length(replace(t, 'session', ''))) / 7.0::DOUBLE AS c2, len(regexp_split_to_array(t, '[ \\t\\n\\x0B\\f\\r]+')) AS dl FROM d, s WHERE contains(t, 'session') AND NOT contains(t, 'index')) SELECT doc_id, round(2.0 + greatest(ln((n + 1) / greatest(d1, 1)), 0.1) * c1 * 2.2 / (c1 + 1.2 * (0.25 + 0.75 * dl / 100)) + greatest(ln((n + 1) / greatest(d2, 1)), 0.1) * c2 * 2.2 / (c2 + 1.2 * (0.25 + 0.75 * dl / 100)), 6) AS score FROM x"),
    "fulltext_procedure": (
        q_fulltext_procedure,
        "WITH d AS (SELECT doc_id, lower(text) AS t FROM documents WHERE text IS NOT NULL), s AS (SELECT count(*) AS n, count(*) FILTER (contains(t, 'recovery')) AS d1, count(*) FILTER (contains(t, 'snapshot')) AS d2 FROM d), x AS (SELECT doc_id, n, d1, d2, (length(t) - length(replace(t, 'recovery', ''))) / 8.0::DOUBLE AS c1, (length(t) - length(replace(t, 'snapshot', ''))) / 8.0::DOUBLE AS c2, len(regexp_split_to_array(t, '[ \\t\\n\\x0B\\f\\r]+')) AS dl FROM d, s) SELECT doc_id AS node, round(CASE WHEN c1 > 0 THEN greatest(ln((n + 1) / greatest(d1, 1)), 0.1) * c1 * 2.2 / (c1 + 1.2 * (0.25 + 0.75 * dl / 100)) ELSE 0 END + CASE WHEN c2 > 0 THEN greatest(ln((n + 1) / greatest(d2, 1)), 0.1) * c2 * 2.2 / (c2 + 1.2 * (0.25 + 0.75 * dl / 100)) ELSE 0 END, 6) AS score FROM x WHERE c1 > 0 OR c2 > 0",
    ),
    "vector_procedure": (q_vector_procedure, f"SELECT vec_id AS node, score FROM ({_KNN}) WHERE score >= 0 ORDER BY score DESC, vec_id LIMIT 5"),
    "rrf": (q_rrf, "WITH h AS (SELECT DISTINCT query_id, node_id, vector_rank, bm25_rank FROM search_results) SELECT key, round(score, 9) AS score FROM (SELECT query_id || '|' || node_id AS key, coalesce(1.0::DOUBLE / (60 + vector_rank), 0) + coalesce(1.0::DOUBLE / (60 + bm25_rank), 0) AS score FROM h) WHERE score >= 0.01"),
    "knn": (q_knn, f"{_KNN} ORDER BY score DESC, vec_id LIMIT 10"),
    "best_per_group": (q_groups, f"SELECT label, vec_id, score FROM (SELECT label, vec_id, score, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS k FROM ({_KNN.replace('SELECT vec_id', 'SELECT label, vec_id')})) WHERE k <= 2"),
    "hybrid": (q_hybrid, None),
    "recommend": (
        q_recommend,
        "WITH x AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT list_transform(range(1, 65), lambda i: (a.e[i] + b.e[i]) / 2 - c.e[i]) AS q FROM x a, x b, x c WHERE a.vec_id = 1 AND b.vec_id = 2 AND c.vec_id = 3) SELECT vec_id, round(list_cosine_similarity(e, q), 5) AS score FROM x, q WHERE vec_id NOT IN (1, 2, 3) ORDER BY list_cosine_similarity(e, q) DESC, vec_id LIMIT 10",
    ),
    "kmeans": (q_kmeans, None),
    "retrieval_measures": (
        q_measures,
        "WITH h AS (SELECT DISTINCT query_id, node_id, vector_rank, bm25_rank FROM search_results), rel AS (SELECT query_id, node_id FROM h WHERE bm25_rank <= 3), n AS (SELECT query_id, count(*) AS n FROM rel GROUP BY 1), x AS (SELECT rel.query_id, vector_rank AS r FROM rel JOIN h USING (query_id, node_id) WHERE vector_rank IS NOT NULL) SELECT n.query_id, round(count(*) FILTER (r <= 5) / 5.0::DOUBLE, 6) AS p5, round(count(*) FILTER (r <= 10) / any_value(n)::DOUBLE, 6) AS r10, round(coalesce(1.0::DOUBLE / min(r), 0), 6) AS mrr, count(*) FILTER (r <= 10) > 0 AS hit FROM n LEFT JOIN x USING (query_id) GROUP BY 1",
    ),
    "sessions": (
        q_sessions,
        "WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 3600000000 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts)::BIGINT AS session FROM g) SELECT user_id, session, count(*) AS n FROM s GROUP BY 1, 2",
    ),
    "daily_pattern": (
        q_daily,
        "WITH c AS (SELECT user_id, hour(ts)::INT AS slot, count(*) AS c FROM events GROUP BY 1, 2), p AS (SELECT user_id, sum(c) AS total, max(c) AS most, min(slot) FILTER (c = m) AS slot FROM (SELECT *, max(c) OVER (PARTITION BY user_id) AS m FROM c) GROUP BY 1) SELECT user_id, slot, round(conf, 6) AS confidence FROM (SELECT *, least(greatest((most / (total / 24.0::DOUBLE) - 1) / 3, 0), 1) AS conf FROM p) WHERE conf >= 0.3",
    ),
    "weekly_pattern": (
        q_weekly,
        "WITH c AS (SELECT user_id, (isodow(ts) - 1)::INT AS slot, count(*) AS c FROM events GROUP BY 1, 2), p AS (SELECT user_id, sum(c) AS total, max(c) AS most, min(slot) FILTER (c = m) AS slot FROM (SELECT *, max(c) OVER (PARTITION BY user_id) AS m FROM c) GROUP BY 1) SELECT user_id, slot, round(conf, 6) AS confidence FROM (SELECT *, least(greatest((most / (total / 7.0::DOUBLE) - 1) / 2, 0), 1) AS conf FROM p) WHERE conf >= 0.4",
    ),
    "bursts": (q_bursts, "SELECT event_type, count(*) AS n FROM (SELECT event_type, count(*) OVER (PARTITION BY event_type ORDER BY floor(epoch_us(ts) / 1000000)::BIGINT RANGE BETWEEN 600 PRECEDING AND CURRENT ROW) AS c FROM events) WHERE c >= 6 GROUP BY 1"),
    "co_access": (
        q_co_access,
        "SELECT least(x.user_id, y.user_id) AS a, greatest(x.user_id, y.user_id) AS b, count(*) AS n, round(least(count(*) / 10.0::DOUBLE, 0.8), 6) AS confidence FROM events x JOIN events y ON x.event_type = y.event_type AND x.user_id < y.user_id AND abs(epoch_us(x.ts) - epoch_us(y.ts)) <= 600000000 GROUP BY 1, 2 HAVING count(*) >= 2",
    ),
    "transitive": (
        q_transitive,
        "WITH r AS (SELECT DISTINCT source AS src, target AS dst, confidence FROM relationships WHERE confidence >= 0.9) SELECT x.src AS a, y.dst AS c, round(max(x.confidence * y.confidence), 6) AS confidence FROM r x JOIN r y ON x.dst = y.src WHERE x.src <> y.dst AND x.confidence * y.confidence >= 0.9 GROUP BY 1, 2",
    ),
    "decay": (
        q_decay,
        f"SELECT DISTINCT element_id, last_accessed, access_count, round(least(greatest(0.4 * exp(-0.000418 * greatest((epoch_us(TIMESTAMP '{NOW}') - epoch_us(last_accessed)) / 3.6e9, 0)) + 0.3 * least(ln(1 + greatest(coalesce(access_count, 0), 0)) / ln(101), 1) + 0.3 * 0.6, 0), 1), 6) AS score FROM nodes WHERE last_accessed IS NOT NULL",
    ),
    "edge_decay": (
        q_edge_decay,
        "WITH r AS (SELECT DISTINCT element_id, confidence, created_at, auto_generated, (epoch_us(TIMESTAMP '2024-09-01 00:00:00') - epoch_us(created_at)) / 8.64e10 AS days FROM relationships WHERE confidence IS NOT NULL AND created_at IS NOT NULL) SELECT element_id, confidence, created_at, round(CASE WHEN NOT coalesce(auto_generated, false) OR days < 7 THEN confidence WHEN confidence * pow(0.95, greatest(days, 0)) >= 0.3 THEN confidence * pow(0.95, greatest(days, 0)) END, 6) AS kept FROM r",
    ),
    "next_access": (q_next_access, "SELECT user_id, count(*) AS n, round((max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6 / greatest(count(*) - 1, 1), 3) AS gap, round(count(*) / (count(*) + 10)::DOUBLE, 6) AS confidence FROM events GROUP BY 1"),
    "load": (q_load, "WITH b AS (SELECT (floor(epoch_us(ts) / 3600000000) * 3600)::BIGINT AS bucket, count(*) AS n FROM events GROUP BY 1) SELECT bucket, n, round((n - (SELECT avg(n) FROM b)) / (SELECT stddev_pop(n) FROM b), 6) AS z FROM b"),
    "kalman": (q_kalman, f"WITH {_SERIES}, k AS (SELECT user_id, n, list_reduce(zs[2:], lambda s, z: {_SCALAR_STEP}, {{'x': zs[1].z, 'p': {temporal.P0}::DOUBLE, 'last': zs[1].z, 'n': 1, 'z': 0.0::DOUBLE}}) AS s FROM g) SELECT user_id, n, round(s.x, 6) AS x FROM k"),
    "kalman_velocity": (q_velocity, f"WITH {_SERIES}, k AS (SELECT user_id, n, {_VELOCITY} AS s FROM g) SELECT user_id, n, round(s.pos, 6) AS pos, round(s.vel, 6) AS vel FROM k"),
    "cooldown": (
        q_cooldown,
        "WITH RECURSIVE e AS (SELECT DISTINCT user_id, event_type, epoch_us(ts) AS us FROM events), k(user_id, event_type, us) AS (SELECT user_id, event_type, min(us) FROM e GROUP BY 1, 2 UNION ALL SELECT k.user_id, k.event_type, min(e.us) FROM k JOIN e ON e.user_id = k.user_id AND e.event_type = k.event_type AND e.us - k.us >= 86400000000 GROUP BY 1, 2) SELECT user_id, event_type, us FROM k",
    ),
    "trend": (q_trend, f"WITH t AS (SELECT DISTINCT event_type AS k, ts FROM events WHERE ts IS NOT NULL), {_GAPS}, v AS (SELECT k, n, round(s.vel, 6) AS velocity, s.vel AS x FROM w) SELECT k AS event_type, n, velocity, CASE WHEN x > 0.05 THEN 'growing' WHEN x < -0.05 THEN 'decaying' END AS pattern, round(CASE WHEN abs(x) > 0.05 THEN least(abs(x) / 0.5, 1) END, 6) AS confidence FROM v"),
    "hot_cold": (q_hot_cold, f"WITH t AS (SELECT DISTINCT user_id AS k, ts FROM events WHERE ts IS NOT NULL), {_GAPS}, v AS (SELECT k, s.vel AS v, CASE WHEN s.vel > 0 THEN 'hot' ELSE 'cold' END AS side FROM w WHERE s.vel <> 0), r AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY abs(v) DESC, k) AS place FROM v) SELECT side, k AS user_id, round(v, 4) AS velocity, place FROM r WHERE place <= 10"),
    "evolution": (
        q_evolution,
        f"WITH d AS (SELECT DISTINCT source, target, confidence AS c, created_at AS ts FROM relationships), g AS (SELECT least(source, target) AS a, greatest(source, target) AS b, count(*) AS n, list(struct_pack(z := c) ORDER BY ts, c) AS zs FROM d WHERE source IS NOT NULL AND target IS NOT NULL AND c IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2), k AS (SELECT a, b, n, {_VELOCITY} AS s FROM g) SELECT a, b, n, CASE WHEN n < 3 THEN 'unknown' WHEN s.vel > 0.01 THEN 'strengthening' WHEN s.vel < -0.01 THEN 'weakening' ELSE 'stable' END AS direction, round(s.vel, 6) AS velocity, round(s.pos, 6) AS strength, round(s.pos + 5 * s.vel, 6) AS predicted, round(n / (n + 10.0::DOUBLE), 6) AS confidence FROM k",
    ),
    "schema": (q_schema, "SELECT * FROM (VALUES ('Customer', 'PLACED', 'Order'), ('Nation', 'IN', 'Region'), ('Customer', 'LIVES_IN', 'Nation'), ('Supplier', 'BASED_IN', 'Nation'), ('Order', 'CONTAINS', 'Part'), ('Supplier', 'SUPPLIES', 'Part')) t(\"from\", \"relationshipType\", \"to\")"),
}


def _after(calls: list[str], text: str) -> Query:
    """A query on the memory graph after procedures that change it."""

    def f(spark: SparkSession, d: str) -> DataFrame:
        g = replace(memory_graph(spark, d))  # the graph itself is kept for other queries
        for c in calls:
            run(g, spark, c)
        return run(g, spark, text)

    return f


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {k: _text(trade_graph, t) for k, (t, _) in TRADE.items()}
    out |= {k: _text(memory_graph, t) for k, (t, _) in MEMORY.items()}
    out |= {k: _updated(*x[:3]) for k, x in UPDATES.items()}
    out |= {k: _text(trade_graph, t) for k, (t, _) in LIBRARY.items()}
    out |= {k: _text(memory_graph, t) for k, (t, _) in GENERIC.items()}
    out |= {k: _after(calls, t) for k, (calls, t, _) in CHANGED.items()}
    return out | {k: f for k, (f, _) in OPS.items()}


def oracle_sql() -> dict[str, str]:
    out = {k: s for k, (_, s) in {**TRADE, **MEMORY, **LIBRARY, **GENERIC}.items()}
    return out | {k: x[2] for k, x in CHANGED.items()} | {k: x[3] for k, x in UPDATES.items()} | {k: s for k, (_, s) in OPS.items() if s}
