"""Queries over the functions and procedures of the libraries, a namespace or a part of one each, with SQL that must give the same rows."""

from __future__ import annotations

_N = "n AS (SELECT element_id AS id, labels FROM (SELECT *, row_number() OVER (PARTITION BY element_id ORDER BY updated_at DESC, access_count DESC) AS k FROM nodes) WHERE k = 1)"
_R = "r AS (SELECT DISTINCT element_id AS id, source AS src, target AS dst, rel_type AS type FROM relationships)"


def _of(kind: str) -> str:
    """The relationships of one type (f), their different pairs (e) and pairs of neighbours (u)."""
    return f"{_N}, {_R}, f AS (SELECT id, src, dst FROM r WHERE type = '{kind}' AND src IS NOT NULL AND dst IS NOT NULL), e AS (SELECT DISTINCT src, dst FROM f), u AS (SELECT src, dst FROM e WHERE src <> dst UNION SELECT dst, src FROM e WHERE src <> dst)"


_O = "strftime(o_orderdate, '%Y-%m-%d"
# name: (query text over the trade graph, SQL)
LIBRARY: dict[str, tuple[str, str]] = {
    "scalar_ids": (
        "MATCH (n:Nation)-[i:IN]->(r:Region) RETURN id(n) AS a, elementId(r) AS b, labels(n)[0] AS c, type(i) AS d, size(keys(n)) AS e, properties(n).n_name AS f, exists(n.n_name) AS g, startNode(i) AS h, endNode(i) AS i, n:Nation AS j, hasLabels(n, ['Nation']) AS k",
        "SELECT n_nationkey AS a, n_regionkey::VARCHAR AS b, 'Nation' AS c, 'IN' AS d, 3 AS e, n_name AS f, true AS g, n_nationkey AS h, n_regionkey AS i, true AS j, true AS k FROM nation",
    ),
    "scalar_degrees": (
        "MATCH (n:Nation) RETURN n.n_name AS n, outDegree(n) AS o, inDegree(n) AS i, degree(n) AS d",
        "SELECT n_name AS n, 1::BIGINT AS o, c + s AS i, c + s + 1 AS d FROM (SELECT n_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS c, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS s FROM nation)",
    ),
    "scalar_nulls": (
        "MATCH (p:Part) RETURN p.p_partkey AS k, coalesce(nullIf(p.p_size, 1), -1) AS a, isEmpty(p.p_name) AS b, isEmpty([]) AS c, isNaN(p.p_retailprice) AS d, nullIf(p.p_size, p.p_size) AS e, valueType(p.p_size) AS f",
        "SELECT p_partkey AS k, coalesce(nullif(p_size, 1), -1) AS a, length(p_name) = 0 AS b, true AS c, isnan(p_retailprice) AS d, NULL::INT AS e, 'INTEGER' AS f FROM part",
    ),
    "scalar_convert": (
        "MATCH (p:Part) RETURN p.p_partkey AS k, toString(p.p_size) AS a, toStringOrNull(p.p_size) AS b, toInt(p.p_retailprice) AS c, toIntegerOrNull(p.p_name) AS d, toFloatOrNull(toString(p.p_size)) AS e, toBooleanOrNull(p.p_name) AS f, toBoolean('false') AS g",
        "SELECT p_partkey AS k, p_size::VARCHAR AS a, p_size::VARCHAR AS b, trunc(p_retailprice)::BIGINT AS c, NULL::BIGINT AS d, p_size::DOUBLE AS e, NULL::BOOLEAN AS f, false AS g FROM part",
    ),
    "scalar_lists": (
        "MATCH (p:Part) WITH p.p_partkey AS k, [p.p_size, p.p_size + 1, 7] AS xs RETURN k, slice(xs, 1, 3)[0] AS a, indexOf(xs, 7) AS b, size(slice(xs, 0)) AS c, reverse(xs)[0] AS d, range(1, 9, 2)[4] AS e, size(range(3, 1)) AS f, toIntegerList(['1', 'x'])[0] AS g, toFloatList(['2.5'])[0] AS h, toStringList(xs)[0] AS i, toBooleanList(['true'])[0] AS j",
        "SELECT p_partkey AS k, p_size::BIGINT + 1 AS a, CASE WHEN p_size = 7 THEN 0 WHEN p_size = 6 THEN 1 ELSE 2 END::BIGINT AS b, 3 AS c, 7::BIGINT AS d, 9 AS e, 0 AS f, 1::BIGINT AS g, 2.5::DOUBLE AS h, p_size::VARCHAR AS i, true AS j FROM part",
    ),
    "scalar_text": (
        "MATCH (n:Nation) RETURN upper(n.n_name) AS a, toUpper(n.n_name) AS b, lower(n.n_name) AS c, ltrim('  ' + n.n_name) AS d, rtrim(n.n_name + '  ') AS e, btrim(' ' + n.n_name + ' ') AS f, lpad(n.n_name, 20, '*') AS g, rpad(n.n_name, 20, '-') AS h, split(n.n_name, '_')[0] AS i, char_length(n.n_name) AS j, character_length(n.n_name) AS k, format('%s has %d', n.n_name, n.n_nationkey) AS l, normalize('e\\u0301') AS m",
        "SELECT upper(n_name) AS a, upper(n_name) AS b, lower(n_name) AS c, n_name AS d, n_name AS e, n_name AS f, lpad(n_name, 20, '*') AS g, rpad(n_name, 20, '-') AS h, split_part(n_name, '_', 1) AS i, length(n_name)::INT AS j, length(n_name)::INT AS k, n_name || ' has ' || n_nationkey AS l, chr(233) AS m FROM nation",
    ),
    "scalar_trigonometry": (
        "MATCH (p:Part) WITH p.p_partkey AS k, p.p_size / 60.0 AS x RETURN k, round(sin(x), 9) AS a, round(cos(x), 9) AS b, round(tan(x), 9) AS c, round(cot(x), 6) AS d, round(asin(x), 9) AS e, round(acos(x), 9) AS f, round(atan(x), 9) AS g, round(atan2(x, 2.0), 9) AS h, round(haversin(x), 9) AS i, round(sinh(x), 9) AS j, round(cosh(x), 9) AS l, round(tanh(x), 9) AS m, round(coth(x), 6) AS n, round(radians(x), 9) AS o, round(degrees(x), 6) AS q",
        "SELECT p_partkey AS k, round(sin(x), 9) AS a, round(cos(x), 9) AS b, round(tan(x), 9) AS c, round(1 / tan(x), 6) AS d, round(asin(x), 9) AS e, round(acos(x), 9) AS f, round(atan(x), 9) AS g, round(atan2(x, 2.0::DOUBLE), 9) AS h, round((1 - cos(x)) / 2, 9) AS i, round((exp(x) - exp(-x)) / 2, 9) AS j, round((exp(x) + exp(-x)) / 2, 9) AS l, round((exp(x) - exp(-x)) / (exp(x) + exp(-x)), 9) AS m, round((exp(x) + exp(-x)) / (exp(x) - exp(-x)), 6) AS n, round(radians(x), 9) AS o, round(degrees(x), 6) AS q FROM (SELECT p_partkey, p_size / 60.0::DOUBLE AS x FROM part)",
    ),
    "scalar_math": (
        "MATCH (p:Part) RETURN p.p_partkey AS k, floor(p.p_retailprice) AS a, round(p.p_retailprice) AS b, round(exp(p.p_size / 10.0), 6) AS c, round(log10(p.p_retailprice), 9) AS d, power(p.p_size, 3) AS e, round(pi(), 9) AS f, round(e(), 9) AS g, round(-2.5) AS h",
        "SELECT p_partkey AS k, floor(p_retailprice)::BIGINT AS a, round(p_retailprice) AS b, round(exp(p_size / 10.0::DOUBLE), 6) AS c, round(log10(p_retailprice), 9) AS d, pow(p_size, 3)::DOUBLE AS e, 3.141592654::DOUBLE AS f, 2.718281828::DOUBLE AS g, -3.0::DOUBLE AS h FROM part",
    ),
    "scalar_random": (
        "MATCH (n:Nation) WITH rand() AS r, randomUUID() AS u RETURN count(*) AS n, min(CASE WHEN r >= 0 AND r < 1 THEN 1 ELSE 0 END) AS ok, count(DISTINCT u) AS ids, min(size(u)) AS len",
        "SELECT count(*) AS n, 1 AS ok, count(*) AS ids, 36 AS len FROM nation",
    ),
    "scalar_dates": (
        "MATCH (o:Order) RETURN o.o_orderkey AS k, date.month(o.o_orderdate) AS a, date.day(o.o_orderdate) AS b, date.week(o.o_orderdate) AS c, date.dayOfYear(o.o_orderdate) AS d, date.ordinalDay(o.o_orderdate) AS e, date.weekYear(o.o_orderdate) AS f, toString(date(o.o_orderdate)) AS g, toString(date.truncate('month', o.o_orderdate)) AS h",
        f"SELECT o_orderkey AS k, month(o_orderdate)::INT AS a, day(o_orderdate)::INT AS b, weekofyear(o_orderdate)::INT AS c, dayofyear(o_orderdate)::INT AS d, dayofyear(o_orderdate)::INT AS e, isoyear(o_orderdate)::INT AS f, {_O}') AS g, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS h FROM orders",
    ),
    "scalar_times": (
        "MATCH (o:Order) WITH o.o_orderkey AS k, toString(date(o.o_orderdate)) + 'T13:45:30' AS t RETURN k, datetime.year(t) AS a, datetime.month(t) AS b, datetime.day(t) AS c, datetime.hour(t) AS d, datetime.minute(t) AS e, datetime.second(t) AS f, time(t) AS g, localtime(t) AS h, time.truncate('hour', t) AS i, toString(datetime.truncate('day', t)) AS j, toString(datetime(t)) AS l, toString(localdatetime(t)) AS m",
        f"SELECT o_orderkey AS k, year(o_orderdate)::INT AS a, month(o_orderdate)::INT AS b, day(o_orderdate)::INT AS c, 13 AS d, 45 AS e, 30 AS f, '13:45:30' AS g, '13:45:30' AS h, '13:00:00' AS i, {_O} 00:00:00') AS j, {_O} 13:45:30') AS l, {_O} 13:45:30') AS m FROM orders",
    ),
    "scalar_durations": (
        "MATCH (o:Order) WITH o.o_orderkey AS k, duration.between('1990-01-01', o.o_orderdate) AS d RETURN k, duration.inDays(d) AS a, duration.inSeconds(d) AS b, duration.inMonths(duration('P1Y2M')) AS c, duration.inSeconds(duration('PT1H30M')) AS e",
        "SELECT o_orderkey AS k, date_diff('day', DATE '1990-01-01', o_orderdate::DATE)::DOUBLE AS a, date_diff('day', DATE '1990-01-01', o_orderdate::DATE) * 86400.0::DOUBLE AS b, 14::BIGINT AS c, 5400.0::DOUBLE AS e FROM orders",
    ),
    "scalar_now": (
        "RETURN timestamp() > 1700000000000 AS a, toString(date()) > '2024' AS b",
        "SELECT true AS a, true AS b",
    ),
    "scalar_points": (
        "MATCH (p:Part) WITH p.p_partkey AS k, point({x: p.p_size * 1.0, y: 2.0}) AS a, point({x: 0.0, y: 0.0}) AS b RETURN k, round(distance(a, b), 6) AS d, round(point.distance(a, b), 6) AS e, point.x(a) AS x, point.y(a) AS y, withinBBox(a, b, point({x: 20.0, y: 20.0})) AS w, point.withinBBox(a, b, point({x: 20.0, y: 20.0})) AS v, point.withinDistance(a, b, 10.0) AS u",
        "SELECT p_partkey AS k, round(sqrt(p_size * p_size + 4.0::DOUBLE), 6) AS d, round(sqrt(p_size * p_size + 4.0::DOUBLE), 6) AS e, p_size::DOUBLE AS x, 2.0::DOUBLE AS y, p_size <= 20 AS w, p_size <= 20 AS v, p_size * p_size + 4 <= 100 AS u FROM part",
    ),
    "scalar_shapes": (
        "MATCH (p:Part) WITH p.p_partkey AS k, polygon([point({x: 0.0, y: 0.0}), point({x: 10.0, y: 0.0}), point({x: 10.0, y: 10.0}), point({x: 0.0, y: 10.0})]) AS s, point({x: p.p_size + 0.5, y: 5.0}) AS c RETURN k, point.contains(s, c) AS a, point.intersects(c, s) AS b",
        "SELECT p_partkey AS k, p_size < 10 AS a, p_size < 10 AS b FROM part",
    ),
    "scalar_systems": (
        "MATCH (r:Region) WITH r.r_regionkey AS k, point({x: 1.0, y: 2.0}) AS a, point({latitude: 1.0, longitude: 2.0}) AS b, point({x: 1.0, y: 2.0, z: 3.0}) AS c RETURN k, point.srid(a) AS d, point.srid(b) AS e, point.crs(a) AS f, point.crs(b) AS g, point.crs(c) AS h, point.z(c) AS i, point.latitude(b) AS j, point.longitude(b) AS l",
        "SELECT r_regionkey AS k, 7203::BIGINT AS d, 4326::BIGINT AS e, 'cartesian' AS f, 'wgs-84' AS g, 'cartesian-3d' AS h, 3.0::DOUBLE AS i, 1.0::DOUBLE AS j, 2.0::DOUBLE AS l FROM region",
    ),
    "apoc_spatial": (
        "MATCH (p:Part) WITH p.p_partkey AS k, point({latitude: 0.0, longitude: 0.0}) AS a, point({latitude: 0.0, longitude: p.p_size * 1.0}) AS b RETURN k, round(apoc.spatial.distance(a, b), 6) AS c, round(apoc.spatial.haversineDistance(0.0, 0.0, 0.0, b.longitude), 6) AS d, round(apoc.spatial.vincentyDistance(0.0, 0.0, 0.0, b.longitude), 3) AS e, round(apoc.spatial.bearing(a, b), 6) AS f, round(apoc.spatial.midpoint(a, b).longitude, 6) AS g, round(apoc.spatial.destination(a, 90.0, 111194.926645).longitude, 6) AS h, size(apoc.spatial.withinDistance(a, [a, b], 2000.0)) AS i, apoc.spatial.within(b, apoc.spatial.boundingBox([a, point({latitude: 1.0, longitude: 20.0})])) AS j, apoc.spatial.centroid([a, b]).longitude AS l, apoc.spatial.nearest(a, [b, a]).longitude AS m, apoc.spatial.toGeoJSON(a) AS n, apoc.spatial.fromGeoJSON(apoc.spatial.toGeoJSON(b)).longitude AS o",
        "SELECT p_partkey AS k, round(6371 * radians(s), 6) AS c, round(6371 * radians(s), 6) AS d, round(6371000 * radians(s), 3) AS e, 90.0::DOUBLE AS f, round(s / 2, 6) AS g, 1.0::DOUBLE AS h, 1 + (6371 * radians(s) <= 2000)::INT AS i, s <= 20 AS j, s / 2 AS l, 0.0::DOUBLE AS m, '{\"type\":\"Point\",\"coordinates\":[0.0,0.0]}' AS n, s AS o FROM (SELECT p_partkey, p_size::DOUBLE AS s FROM part)",
    ),
    "scalar_vectors": (
        "MATCH (p:Part) RETURN p.p_partkey AS k, round(vector.similarity.cosine([p.p_size * 1.0, 1.0], [1.0, 0.0]), 9) AS a, round(vector.similarity.euclidean([p.p_size * 1.0, 1.0], [1.0, 1.0]), 9) AS b",
        "SELECT p_partkey AS k, round(p_size / sqrt(p_size * p_size + 1.0::DOUBLE), 9) AS a, round(1 / (1 + abs(p_size - 1.0::DOUBLE)), 9) AS b FROM part",
    ),
    "scalar_predicates": (
        "MATCH (p:Part) WITH p.p_partkey AS k, [p.p_size, 10, 20] AS xs RETURN k, size(filter(x IN xs WHERE x > 15)) AS a, extract(x IN xs | x * 2)[1] AS b, reduce(s = 0, x IN xs | s + x) AS c",
        "SELECT p_partkey AS k, (p_size > 15)::INT + 1 AS a, 20::BIGINT AS b, p_size + 30 AS c FROM part",
    ),
    "scalar_operators": (
        "MATCH (p:Part) WHERE p.p_size BETWEEN 10 AND 20 RETURN p.p_partkey AS k, {size: p.p_size, name: p.p_brand}.size AS a, p.p_size > 12 XOR p.p_size > 15 AS b, p.p_brand ENDS WITH '3' AS c, p.p_brand CONTAINS '#2' AS d, NOT p.p_size IN [10, 11] AS e, 7 / 2 AS f, -p.p_size AS g",
        "SELECT p_partkey AS k, p_size AS a, (p_size > 12) <> (p_size > 15) AS b, ends_with(p_brand, '3') AS c, contains(p_brand, '#2') AS d, p_size NOT IN (10, 11) AS e, 3.5::DOUBLE AS f, -p_size AS g FROM part WHERE p_size BETWEEN 10 AND 20",
    ),
    "scalar_kalman": (
        "MATCH (p:Part) WITH p.p_partkey AS k, kalman.process(p.p_size, kalman.init(0.0)).state AS s, kalman.velocity.process(p.p_size, kalman.velocity.init()).state AS v RETURN k, kalman.state(s) AS a, kalman.predict(s, 2) AS b, kalman.state(kalman.reset(s)) AS c, kalman.velocity.predict(v, 3) AS d",
        "SELECT p_partkey AS k, p_size::DOUBLE AS a, p_size::DOUBLE AS b, 0.0::DOUBLE AS c, p_size::DOUBLE AS d FROM part",
    ),
    "agg_percentiles": (
        "MATCH (p:Part) RETURN p.p_brand AS b, percentileDisc(p.p_size, 0.5) AS a, percentileCont(p.p_size, 0.9) AS c, collect(DISTINCT p.p_size)[0] IS NOT NULL AS d",
        "SELECT p_brand AS b, quantile_disc(p_size, 0.5) AS a, quantile_cont(p_size, 0.9) AS c, true AS d FROM part GROUP BY 1",
    ),
    "optional_leading": (
        "OPTIONAL MATCH (p:Part) WHERE p.p_size < 0 RETURN count(p) AS n",
        "SELECT 0::BIGINT AS n",
    ),
    "with_then_optional": (
        "MATCH (c:Customer) WITH c WHERE c.c_acctbal > 9000 OPTIONAL MATCH (c)-[:PLACED]->(o:Order) RETURN c.c_custkey AS c, count(o) AS n",
        "SELECT c_custkey AS c, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 9000 GROUP BY 1",
    ),
    "cartesian_count": (
        "MATCH (r:Region), (n:Nation) RETURN count(*) AS n",
        "SELECT (SELECT count(*) FROM region) * (SELECT count(*) FROM nation) AS n",
    ),
    "label_predicate": (
        "MATCH (x)-[:LIVES_IN|BASED_IN]->(n:Nation) WHERE x:Supplier RETURN n.n_name AS n, count(x) AS c",
        "SELECT n_name AS n, count(*) AS c FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1",
    ),
    "apoc_coll_a": (
        "MATCH (p:Part) WITH p.p_partkey AS k, [p.p_size, 3, 1, 3] AS a, [3, 4] AS b RETURN k, apoc.coll.avg(a) AS x1, apoc.coll.min(a) AS x2, apoc.coll.sort(a)[0] AS x3, apoc.coll.reverse(a)[0] AS x4, size(apoc.coll.unionAll(a, b)) AS x5, size(apoc.coll.subtract([1, 2, 3], b)) AS x6, apoc.coll.containsAll(a, [3, 1]) AS x7, apoc.coll.containsAny(a, [99, 4]) AS x8, apoc.coll.flatten([a, b])[4] AS x9, apoc.coll.containsSorted([1, 3], 3) AS y1, apoc.coll.containsDuplicates(a) AS y2, size(apoc.coll.disjunction([1, 3], b)) AS y3, apoc.coll.isEmpty([]) AS y4, apoc.coll.isNotEmpty(a) AS y5, apoc.coll.different([1, 2]) AS y6, apoc.coll.sumLongs(a) AS y7",
        "SELECT p_partkey AS k, (p_size + 7) / 4.0::DOUBLE AS x1, least(p_size, 1)::INT AS x2, least(p_size, 1)::INT AS x3, 3 AS x4, 6 AS x5, 2 AS x6, true AS x7, p_size IN (99, 4) AS x8, 3 AS x9, true AS y1, true AS y2, 2 AS y3, true AS y4, true AS y5, true AS y6, p_size::BIGINT + 7 AS y7 FROM part",
    ),
    "apoc_coll_b": (
        "WITH [1, 1, 2, 3, 3] AS a RETURN size(apoc.coll.pairs(a)) AS x1, size(apoc.coll.pairsMin(a)) AS x2, size(apoc.coll.zip([1, 2], [3, 4])) AS x3, size(apoc.coll.frequencies(a)) AS x4, size(apoc.coll.duplicates(a)) AS x5, size(apoc.coll.duplicatesWithCount(a)) AS x6, size(apoc.coll.dropDuplicateNeighbors(a)) AS x7, size(apoc.coll.fill(7, 3)) AS x8, apoc.coll.insert(a, 1, 9)[1] AS x9, size(apoc.coll.insertAll(a, 1, [9, 8])) AS y1, size(apoc.coll.remove(a, 0)) AS y2, size(apoc.coll.removeAll(a, [3])) AS y3, apoc.coll.set(a, 0, 5)[0] AS y4, apoc.coll.slice(a, 2, 2)[1] AS y5, size(apoc.coll.shuffle(a)) AS y6, apoc.coll.randomItem([4]) AS y7, size(apoc.coll.randomItems(a, 2)) AS y8, size(apoc.coll.partition(a, 2)) AS y9, round(apoc.coll.stdev([2.0, 4.0]), 6) AS z1, size(apoc.coll.split(a, 2)) AS z2",
        "SELECT 5 AS x1, 4 AS x2, 2 AS x3, 3 AS x4, 2 AS x5, 2 AS x6, 3 AS x7, 3 AS x8, 9 AS x9, 7 AS y1, 4 AS y2, 3 AS y3, 5 AS y4, 3 AS y5, 5 AS y6, 4 AS y7, 2 AS y8, 3 AS y9, 1.0::DOUBLE AS z1, 2 AS z2",
    ),
    "apoc_text_a": (
        "MATCH (n:Nation) WITH n.n_name AS t RETURN t, apoc.text.join(['a', t], '-') AS a, apoc.text.split(t, 'A')[0] AS b, apoc.text.replace(t, '[AEIOU]', '.') AS c, apoc.text.capitalizeAll(toLower(t)) AS d, apoc.text.decapitalize(t) AS e, apoc.text.swapCase(t) AS f, apoc.text.lpad(t, 20, ' ') AS g, apoc.text.rpad(t, 20, ' ') AS h, apoc.text.repeat(t, 2) AS i, apoc.text.reverse(t) AS j, apoc.text.toUpperCase(t) AS l, apoc.text.toLowerCase(t) AS m, apoc.text.trim(' ' + t) AS o, apoc.text.ltrim(' ' + t) AS p, apoc.text.rtrim(t + ' ') AS q, apoc.text.code(t) AS r, apoc.text.charAt(t, 1) AS s, apoc.text.base64Encode(t) AS u, apoc.text.base64Decode(apoc.text.base64Encode(t)) AS v, apoc.text.format('%s!', t) AS w, apoc.text.urlencode(t + '&') AS x, apoc.text.urldecode('a%26b') AS y",
        "SELECT t, 'a-' || t AS a, split_part(t, 'A', 1) AS b, regexp_replace(t, '[AEIOU]', '.', 'g') AS c, array_to_string(list_transform(string_split(lower(t), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS d, lower(t[1]) || t[2:] AS e, lower(t) AS f, lpad(t, 20, ' ') AS g, rpad(t, 20, ' ') AS h, t || t AS i, reverse(t) AS j, upper(t) AS l, lower(t) AS m, t AS o, t AS p, t AS q, ascii(t) AS r, ascii(t[2]) AS s, base64(encode(t)) AS u, t AS v, t || '!' AS w, replace(replace(url_encode(t || '&'), '%20', '+'), '%5F', '_') AS x, 'a&b' AS y FROM (SELECT upper(n_name) AS t FROM nation)",
    ),
    "apoc_text_b": (
        "MATCH (n:Nation) WITH n.n_name AS t RETURN t, apoc.text.levenshteinDistance(t, 'CANADA') AS a, round(apoc.text.levenshteinSimilarity(t, 'CANADA'), 9) AS b, round(apoc.text.fuzzyMatch(t, 'canada'), 9) AS c, apoc.text.compareCleaned(t, t + '!') AS d, apoc.text.upperCamelCase('ab cd') AS e, apoc.text.decapitalizeAll('AB Cd') AS f, size(apoc.text.regexGroups('a1b22', '[0-9]+')) AS g, apoc.text.fromCodePoint(65) AS h, size(apoc.text.bytes(t)) AS i, apoc.text.bytesToString(apoc.text.bytes(t)) AS j, size(apoc.text.indexesOf('banana', 'an')) AS l, size(apoc.text.random(8)) AS m, apoc.text.hammingDistance('karolin', 'kathrin') AS o, round(apoc.text.jaroWinklerDistance(t, 'CANADA'), 6) AS p, apoc.text.phonetic('Robert') AS q, apoc.text.phoneticDelta('Robert', 'Rupert') AS r",
        "SELECT t, levenshtein(t, 'CANADA')::INT AS a, round(1 - levenshtein(t, 'CANADA') / greatest(length(t), 6)::DOUBLE, 9) AS b, round(1 - levenshtein(lower(t), 'canada') / greatest(length(t), 6)::DOUBLE, 9) AS c, true AS d, 'AbCd' AS e, 'aB cd' AS f, 2 AS g, 'A' AS h, strlen(t)::INT AS i, t AS j, 2 AS l, 8 AS m, 3 AS o, round(jaro_winkler_similarity(t, 'CANADA'), 6) AS p, 'R163' AS q, 4 AS r FROM (SELECT n_name AS t FROM nation)",
    ),
    "apoc_math": (
        "MATCH (p:Part) WITH p.p_partkey AS k, p.p_size AS n, p.p_size / 60.0 AS x RETURN k, apoc.math.round(x, 2) AS a, apoc.math.ceil(x) AS b, apoc.math.floor(x) AS c, apoc.math.abs(-n) AS d, apoc.math.pow(n, 2) AS e, round(apoc.math.sqrt(n), 9) AS f, round(apoc.math.log(n), 9) AS g, round(apoc.math.log10(n), 9) AS h, round(apoc.math.exp(x), 9) AS i, round(apoc.math.sin(x), 9) AS j, round(apoc.math.cos(x), 9) AS l, round(apoc.math.tan(x), 9) AS m, round(apoc.math.asin(x), 9) AS o, round(apoc.math.acos(x), 9) AS q, round(apoc.math.atan(x), 9) AS r, round(apoc.math.atan2(x, 1.0), 9) AS s, round(apoc.math.sigmoid(x), 9) AS t, round(apoc.math.logit(x), 9) AS u, apoc.math.lerp(0.0, 10.0, 0.25) AS v, round(apoc.math.normalize(n, 0, 100), 9) AS w, round(apoc.math.sinh(x), 9) AS y, round(apoc.math.cosh(x), 9) AS z, round(apoc.math.tanh(x), 9) AS z1",
        "SELECT p_partkey AS k, round(x, 2) AS a, ceil(x)::BIGINT AS b, floor(x)::BIGINT AS c, n AS d, pow(n, 2)::DOUBLE AS e, round(sqrt(n), 9) AS f, round(ln(n), 9) AS g, round(log10(n), 9) AS h, round(exp(x), 9) AS i, round(sin(x), 9) AS j, round(cos(x), 9) AS l, round(tan(x), 9) AS m, round(asin(x), 9) AS o, round(acos(x), 9) AS q, round(atan(x), 9) AS r, round(atan2(x, 1.0::DOUBLE), 9) AS s, round(1 / (1 + exp(-x)), 9) AS t, round(ln(x / (1 - x)), 9) AS u, 2.5::DOUBLE AS v, round(n / 100.0::DOUBLE, 9) AS w, round((exp(x) - exp(-x)) / 2, 9) AS y, round((exp(x) + exp(-x)) / 2, 9) AS z, round((exp(x) - exp(-x)) / (exp(x) + exp(-x)), 9) AS z1 FROM (SELECT p_partkey, p_size AS n, p_size / 60.0::DOUBLE AS x FROM part)",
    ),
    "apoc_math_lists": (
        "WITH [4.0, 1.0, 3.0, 3.0] AS x RETURN apoc.math.median(x) AS a, apoc.math.mean(x) AS b, round(apoc.math.stdev(x), 9) AS c, round(apoc.math.variance(x), 9) AS d, apoc.math.mode(x) AS e, apoc.math.range(x) AS f, apoc.math.sum(x) AS g, apoc.math.product(x) AS h, apoc.math.factorial(5) AS i, apoc.math.nextPrime(13) AS j, apoc.math.maxLong() AS l, apoc.math.minLong() AS m, apoc.math.random() < 1 AS o, apoc.math.randomInt(3, 4) AS p",
        "SELECT 3.0::DOUBLE AS a, 2.75::DOUBLE AS b, round(sqrt(1.1875::DOUBLE), 9) AS c, 1.1875::DOUBLE AS d, 3.0::DOUBLE AS e, 3.0::DOUBLE AS f, 11.0::DOUBLE AS g, 36.0::DOUBLE AS h, 120::BIGINT AS i, 17 AS j, 9223372036854775807 AS l, (-9223372036854775807 - 1)::BIGINT AS m, true AS o, 3::BIGINT AS p",
    ),
    "apoc_number": (
        "MATCH (p:Part) WITH p.p_partkey AS k, p.p_size AS n RETURN k, apoc.number.parse('1,234.5') AS a, apoc.number.parseInt('1,234') AS b, apoc.number.parseFloat('2.5') AS c, apoc.number.fromHex('ff') AS d, apoc.number.toOctal(8) AS e, apoc.number.fromOctal('10') AS f, apoc.number.toBinary(n) AS g, apoc.number.fromBinary('101') AS h, apoc.number.toBase(35, 36) AS i, apoc.number.fromBase('z', 36) AS j, apoc.number.sign(-n) AS l, apoc.number.map(5.0, 0.0, 10.0, 0.0, 100.0) AS m, apoc.number.isEven(n) AS o, apoc.number.isOdd(n) AS p, apoc.number.power(n, 2) AS q, apoc.number.format(1234.5) AS r",
        "SELECT p_partkey AS k, 1234.5::DOUBLE AS a, 1234::BIGINT AS b, 2.5::DOUBLE AS c, 255::BIGINT AS d, '10' AS e, 8::BIGINT AS f, bin(p_size) AS g, 5::BIGINT AS h, 'z' AS i, 35::BIGINT AS j, -1 AS l, 50.0::DOUBLE AS m, p_size % 2 = 0 AS o, p_size % 2 = 1 AS p, pow(p_size, 2)::DOUBLE AS q, '1,234.50' AS r FROM part",
    ),
    "apoc_bitwise": (
        "MATCH (p:Part) WITH p.p_partkey AS k, p.p_size AS n RETURN k, apoc.bitwise.and(n, 12) AS a, apoc.bitwise.or(n, 12) AS b, apoc.bitwise.op(n, '&', 7) AS c, apoc.bitwise.not(n) AS d, apoc.bitwise.leftShift(n, 3) AS e, apoc.bitwise.rightShift(n, 1) AS f, apoc.bitwise.setBit(n, 6) AS g, apoc.bitwise.clearBit(n, 0) AS h, apoc.bitwise.toggleBit(n, 1) AS i, apoc.bitwise.testBit(n, 2) AS j, apoc.bitwise.countBits(n) AS l",
        "SELECT p_partkey AS k, p_size & 12 AS a, p_size | 12 AS b, p_size & 7 AS c, (~p_size)::INT AS d, (p_size::BIGINT << 3) AS e, (p_size::BIGINT >> 1) AS f, (p_size | 64)::BIGINT AS g, (p_size & ~1)::BIGINT AS h, xor(p_size, 2)::BIGINT AS i, (p_size & 4) <> 0 AS j, bit_count(p_size)::INT AS l FROM part",
    ),
    "apoc_map": (
        "MATCH (n:Nation) WITH n.n_name AS k, {a: n.n_name, b: 'x'} AS s, apoc.map.fromPairs([['a', n.n_name], ['b', 'x']]) AS m RETURN k, m['a'] AS a, apoc.map.merge(m, apoc.map.fromLists(['c'], ['y']))['c'] AS b, apoc.map.removeKey(m, 'a')['a'] IS NULL AS c, apoc.map.setKey(m, 'd', 'z')['d'] AS d, apoc.map.fromValues(['p', 'q'])['p'] AS e, apoc.map.get(m, 'zz', 'none') AS f, apoc.map.mget(m, ['b', 'a'])[1] AS g, size(apoc.map.submap(m, ['a'])) AS h, apoc.map.keys(m)[1] AS i, size(apoc.map.values(m)) AS j, apoc.map.removeKeys(m, ['a', 'b'])['a'] IS NULL AS l, apoc.map.setEntry(m, 'a', 'w')['a'] AS o, size(apoc.map.dropNullValues(m)) AS p",
        "SELECT n_name AS k, n_name AS a, 'y' AS b, true AS c, 'z' AS d, 'q' AS e, 'none' AS f, n_name AS g, 1 AS h, 'b' AS i, 2 AS j, true AS l, 'w' AS o, 2 AS p FROM nation",
    ),
    "apoc_convert": (
        "MATCH (p:Part) RETURN p.p_partkey AS k, apoc.convert.toBoolean('true') AS a, apoc.convert.toInteger('7') AS b, apoc.convert.toFloat(toString(p.p_size)) AS c, apoc.convert.toString(p.p_size) AS d, apoc.convert.fromJsonMap('{\"x\": \"y\"}')['x'] AS e, size(apoc.convert.fromJsonList('[1, 2]')) AS f, size(apoc.convert.toSet([1, 1])) AS g, apoc.convert.toList(p.p_size)[0] AS h, apoc.convert.getJsonProperty('{\"x\": 5}', 'x') AS i, apoc.convert.toIntList(['4'])[0] AS j, apoc.convert.toStringList([p.p_size])[0] AS l, apoc.convert.toFloatList(['1.5'])[0] AS m, apoc.convert.toBooleanList(['true'])[0] AS o, apoc.convert.toJson([1, 2]) AS q",
        "SELECT p_partkey AS k, true AS a, 7::BIGINT AS b, p_size::DOUBLE AS c, p_size::VARCHAR AS d, 'y' AS e, 2 AS f, 1 AS g, p_size AS h, '5' AS i, 4::BIGINT AS j, p_size::VARCHAR AS l, 1.5::DOUBLE AS m, true AS o, '[1,2]' AS q FROM part",
    ),
    "apoc_json": (
        "WITH '{\"a\": 1, \"b\": [1, 2]}' AS t RETURN apoc.json.path(t, '$.a') AS a, apoc.json.validate(t) AS b, apoc.json.validate('{x') AS c, size(apoc.json.keys(t)) AS d, apoc.json.type(t) AS e, apoc.json.type('[1]') AS f, apoc.json.size('[1, 2, 3]') AS g, apoc.json.size(t) AS h, apoc.json.compact('{ \"a\" : 1 }') AS i, apoc.json.parse('{\"z\": \"w\"}')['z'] AS j",
        "SELECT '1' AS a, true AS b, false AS c, 2 AS d, 'object' AS e, 'array' AS f, 3 AS g, 2 AS h, '{\"a\":1}' AS i, 'w' AS j",
    ),
    "apoc_hashing": (
        "MATCH (n:Nation) RETURN n.n_name AS n, apoc.hashing.sha1(n.n_name) AS a, apoc.hashing.sha256(n.n_name) AS b, apoc.util.md5(n.n_name) AS c, apoc.util.sha1(n.n_name) AS d, apoc.util.md5Hex(n.n_name) AS e, apoc.util.sha256Hex(n.n_name) AS f, size(apoc.hashing.sha512(n.n_name)) AS g, size(apoc.hashing.sha384(n.n_name)) AS h, apoc.hashing.fnv1a('a') AS i, apoc.hashing.fnv1('a') AS j, apoc.hashing.cityHash64('') AS j2, apoc.text.doubleMetaphone('Robert')[0] AS j3, apoc.util.md5Base64(n.n_name) AS l, apoc.util.encodeBase64(n.n_name) AS m",
        "SELECT n_name AS n, sha1(n_name) AS a, sha256(n_name) AS b, md5(n_name) AS c, sha1(n_name) AS d, md5(n_name) AS e, sha256(n_name) AS f, 128 AS g, 96 AS h, 3826002220 AS i, 84696446::BIGINT AS j, 0::BIGINT AS j2, 'R163' AS j3, base64(unhex(md5(n_name))) AS l, base64(encode(n_name)) AS m FROM nation",
    ),
    "apoc_util": (
        "MATCH (p:Part) RETURN p.p_partkey AS k, apoc.util.coalesce(null, p.p_size) AS a, apoc.util.when(p.p_size > 25, 'big', 'small') AS b, apoc.util.case(p.p_size > 40, 'x', p.p_size > 20, 'y', 'z') AS c, apoc.util.repeat('ab', 2) AS d, size(apoc.util.range(1, 5)) AS e, size(apoc.util.partition([1, 2, 3], 2)) AS f, apoc.util.decodeBase64(apoc.util.encodeBase64(p.p_name)) AS g, apoc.util.encodeURL('a b') AS h, apoc.util.decodeURL('a+b') AS i, apoc.util.validatePattern(p.p_brand, '^Brand#[0-9]+$') AS j, size(apoc.util.uuid()) AS l, apoc.util.decompress(apoc.util.compress(p.p_name)) AS m, apoc.util.now() > 0 AS o",
        "SELECT p_partkey AS k, p_size AS a, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS b, CASE WHEN p_size > 40 THEN 'x' WHEN p_size > 20 THEN 'y' ELSE 'z' END AS c, 'abab' AS d, 5 AS e, 2 AS f, p_name AS g, 'a+b' AS h, 'a b' AS i, regexp_full_match(p_brand, 'Brand#[0-9]+') AS j, 36 AS l, p_name AS m, true AS o FROM part",
    ),
    "apoc_scoring": (
        "MATCH (p:Part) WITH p.p_partkey AS k, p.p_size * 1.0 AS x RETURN k, apoc.scoring.existence(10, x > 25) AS a, apoc.scoring.euclidean([x, 0.0], [0.0, 0.0]) AS b, apoc.scoring.manhattan([x, 1.0], [0.0, 0.0]) AS c, round(apoc.scoring.jaccard([1, 2, 3], [2, 3, 4]), 9) AS d, round(apoc.scoring.overlap([1, 2, 3], [2, 3]), 9) AS e, round(apoc.scoring.dice([1, 2, 3], [2, 3]), 9) AS f, round(apoc.scoring.pearson([1.0, 2.0, 3.0], [2.0, 4.0, 6.0]), 9) AS g, round(apoc.scoring.tf('a', ['a', 'b', 'a']), 9) AS h, round(apoc.scoring.idf(100, 10), 9) AS i, apoc.scoring.tfidf(0.5, 2.0) AS j, round(apoc.scoring.minMax(x, 0.0, 50.0), 9) AS l, round(apoc.scoring.zScore(x, 25.0, 5.0), 9) AS m, round(apoc.scoring.sigmoid(x / 50), 9) AS o, apoc.scoring.rank([5, 3, 9], 5) AS q, apoc.scoring.topK([5, 3, 9], 2)[0] AS r, round(apoc.scoring.softmax([0.0, 0.0])[0], 9) AS s, round(apoc.scoring.normalize(x, 0.0, 100.0), 9) AS t",
        "SELECT p_partkey AS k, CASE WHEN p_size > 25 THEN 10 ELSE 0 END AS a, p_size::DOUBLE AS b, p_size + 1.0::DOUBLE AS c, 0.5::DOUBLE AS d, 1.0::DOUBLE AS e, 0.8::DOUBLE AS f, 1.0::DOUBLE AS g, round(2 / 3.0::DOUBLE, 9) AS h, round(ln(10), 9) AS i, 1.0::DOUBLE AS j, round(p_size / 50.0::DOUBLE, 9) AS l, round((p_size - 25) / 5.0::DOUBLE, 9) AS m, round(1 / (1 + exp(-p_size / 50.0::DOUBLE)), 9) AS o, 2 AS q, 9 AS r, 0.5::DOUBLE AS s, round(p_size / 100.0::DOUBLE, 9) AS t FROM part",
    ),
    "apoc_stats": (
        "WITH [1.0, 2.0, 3.0, 4.0, 100.0] AS x RETURN apoc.stats.variance([1.0, 3.0]) AS a, apoc.stats.percentile(x, 0.5) AS b, apoc.stats.quartiles(x)[0] AS c, apoc.stats.iqr(x) AS d, apoc.stats.min(x) AS e, apoc.stats.max(x) AS f, apoc.stats.range(x) AS g, apoc.stats.sum(x) AS h, apoc.stats.count(x) AS i, apoc.stats.zScore(4.0, 2.0, 2.0) AS j, apoc.stats.normalize([1.0, 3.0])[1] AS l, apoc.stats.outliers(x)[0] AS m, apoc.stats.summary(x).mean AS o, apoc.stats.histogram(x, 2)[0] AS q",
        "SELECT 1.0::DOUBLE AS a, 3.0::DOUBLE AS b, 2.0::DOUBLE AS c, 2.0::DOUBLE AS d, 1.0::DOUBLE AS e, 100.0::DOUBLE AS f, 99.0::DOUBLE AS g, 110.0::DOUBLE AS h, 5 AS i, 1.0::DOUBLE AS j, 1.0::DOUBLE AS l, 100.0::DOUBLE AS m, 22.0::DOUBLE AS o, 4 AS q",
    ),
    "apoc_agg": (
        "MATCH (p:Part) RETURN p.p_brand AS b, apoc.agg.product(CASE WHEN p.p_size > 0 THEN 1 ELSE 0 END) AS a, apoc.agg.first(p.p_brand) AS c, apoc.agg.last(p.p_brand) AS d, apoc.agg.minItems(p.p_size, 2)[0] AS e, apoc.agg.maxItems(p.p_size, 2)[0] AS f",
        "SELECT p_brand AS b, 1.0::DOUBLE AS a, p_brand AS c, p_brand AS d, min(p_size)::DOUBLE AS e, max(p_size)::DOUBLE AS f FROM part GROUP BY 1",
    ),
    "apoc_temporal": (
        "MATCH (o:Order) WITH o.o_orderkey AS k, o.o_orderdate AS d RETURN k, apoc.temporal.format(d, 'yyyy/MM/dd') AS a, apoc.temporal.toEpochMillis(d) AS b, toString(apoc.temporal.fromEpochMillis(0)) AS c, apoc.temporal.isBetween(d, '1995-01-01', '1996-12-31') AS e, apoc.temporal.dayOfWeek(d) AS f, apoc.temporal.quarter(d) AS g, apoc.temporal.isWeekend(d) AS h, apoc.temporal.isWeekday(d) AS i, apoc.temporal.dayOfYear(d) AS j, apoc.temporal.weekOfYear(d) AS l, apoc.temporal.isLeapYear(d) AS m, apoc.temporal.daysInMonth(d) AS n, toString(apoc.temporal.startOf(d, 'month')) AS o, apoc.temporal.age(d, '2024-01-01') AS p, apoc.date.format(apoc.date.parse('2020-02-03 04:05:06')) AS q, apoc.date.convert(7200000, 'ms', 'h') AS r, apoc.date.field(apoc.date.parse('2020-02-03 04:05:06'), 'h') AS s, apoc.date.toISO8601(0) AS t, apoc.date.toUnixTime('1970-01-02') AS u, apoc.date.fromISO8601('1970-01-01T00:00:01Z') AS v, apoc.date.convertFormat('2020-02-03', 'yyyy-MM-dd', 'dd.MM.yyyy') AS w, apoc.date.add(0, 'ms', 1, 's') AS x",
        "SELECT o_orderkey AS k, strftime(d, '%Y/%m/%d') AS a, epoch_ms(d) AS b, '1970-01-01 00:00:00' AS c, d BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31' AS e, dayofweek(d)::INT AS f, quarter(d)::INT AS g, dayofweek(d) IN (0, 6) AS h, dayofweek(d) NOT IN (0, 6) AS i, dayofyear(d)::INT AS j, weekofyear(d)::INT AS l, year(d) % 4 = 0 AND (year(d) % 100 <> 0 OR year(d) % 400 = 0) AS m, day(last_day(d))::INT AS n, strftime(date_trunc('month', d), '%Y-%m-%d %H:%M:%S') AS o, date_sub('year', d::DATE, DATE '2024-01-01')::INT AS p, '2020-02-03 04:05:06' AS q, 2::BIGINT AS r, 4 AS s, '1970-01-01T00:00:00.000Z' AS t, 86400::BIGINT AS u, 1000::BIGINT AS v, '03.02.2020' AS w, 1000.0::DOUBLE AS x FROM (SELECT o_orderkey, o_orderdate AS d FROM orders)",
    ),
    "apoc_meta": (
        "MATCH (p:Part) RETURN p.p_partkey AS k, apoc.meta.type(p.p_size) AS a, apoc.meta.isType(p.p_size, 'INTEGER') AS b, apoc.util.typeOf(p.p_name) AS c",
        "SELECT p_partkey AS k, 'INTEGER' AS a, true AS b, 'STRING' AS c FROM part",
    ),
    "apoc_xml": (
        "RETURN apoc.xml.getText('<a><b>x</b></a>', 'a/b') AS a, apoc.xml.getAttribute('<a q=\"7\"/>', 'a/@q') AS b, apoc.xml.escape('<&>') AS c, apoc.xml.unescape('&lt;') AS d, apoc.xml.minify('<a> <b/></a>') AS e, size(apoc.xml.query('<a><b>1</b><b>2</b></a>', 'a/b/text()')) AS f",
        "SELECT 'x' AS a, '7' AS b, '&lt;&amp;&gt;' AS c, '<' AS d, '<a><b/></a>' AS e, 2 AS f",
    ),
    "apoc_diff": (
        "MATCH (n:Nation) WITH n.n_name AS k, apoc.map.fromPairs([['a', n.n_name], ['b', 'x']]) AS m, apoc.map.fromPairs([['a', 'CANADA'], ['c', 'y']]) AS o RETURN k, size(apoc.diff.maps(m, o).leftOnly) AS a, size(apoc.diff.maps(m, o).inCommon) AS b, size(apoc.diff.lists([1, 2], [2, 3]).leftOnly) AS c, apoc.diff.strings(k, 'CANADA').equal AS d, apoc.diff.merge(m, o)['a'] AS e",
        "SELECT n_name AS k, 1 AS a, (n_name = 'CANADA')::INT AS b, 1 AS c, n_name = 'CANADA' AS d, 'CANADA' AS e FROM nation",
    ),
    # procedures
    "proc_types": ("CALL db.relationshipTypes() YIELD relationshipType RETURN relationshipType AS t", "SELECT unnest(['PLACED', 'IN', 'LIVES_IN', 'BASED_IN', 'CONTAINS', 'SUPPLIES']) AS t"),
    "proc_keys": ("CALL db.propertyKeys() YIELD propertyKey WHERE propertyKey STARTS WITH 'n_' RETURN propertyKey AS k", "SELECT unnest(['n_nationkey', 'n_name', 'n_regionkey']) AS k"),
    "proc_node_properties": ("CALL db.schema.nodeProperties() YIELD nodeLabel, propertyName RETURN nodeLabel AS l, count(propertyName) AS n", "SELECT * FROM (VALUES ('Region', 2::BIGINT), ('Nation', 3), ('Customer', 5), ('Supplier', 4), ('Part', 6), ('Order', 6)) t(l, n)"),
    "proc_schema": ("CALL db.schema.visualization() YIELD relationshipType RETURN count(relationshipType) AS n", "SELECT 6::BIGINT AS n"),
    "proc_subgraph": (
        "MATCH (r:Region {r_name: 'ASIA'}) CALL apoc.path.subgraphNodes(r, {relationshipFilter: '<IN', maxLevel: 1, minLevel: 1}) YIELD node, depth RETURN r.r_name AS r, count(node) AS n, max(depth) AS d",
        "SELECT r_name AS r, count(*) AS n, 1 AS d FROM region JOIN nation ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY 1",
    ),
}

_WALK = "w(s, t, d, used) AS (SELECT src, dst, 1, [id] FROM f UNION ALL SELECT w.s, f.dst, w.d + 1, list_append(w.used, f.id) FROM w JOIN f ON w.t = f.src WHERE NOT list_contains(w.used, f.id)), p AS (SELECT w.* FROM w JOIN n a ON a.id = w.s JOIN n b ON b.id = w.t)"
_FROM_TASKS = "k AS (SELECT id FROM n WHERE list_contains(labels, 'Task')), w(d, s, t, c) AS (SELECT 0, id, id, 1::DOUBLE FROM k UNION ALL SELECT w.d + 1, w.s, f.dst, sum(w.c) FROM w JOIN f ON w.t = f.src WHERE w.d < 30 GROUP BY 1, 2, 3), m AS (SELECT s, t, min_by(c, d) AS c, min(d) AS d FROM w WHERE d > 0 AND s <> t GROUP BY 1, 2), p AS (SELECT m.* FROM m JOIN k ON k.id = m.t)"
_HOPS = "h AS (SELECT n.id AS s, n.id AS t, 0 AS d FROM n UNION ALL SELECT src, dst, 1 FROM e UNION ALL SELECT x.src, y.dst, 2 FROM e x JOIN e y ON x.dst = y.src), m AS (SELECT s, t, min(d) AS d FROM h WHERE s IN (SELECT id FROM n) GROUP BY 1, 2)"

# name: (query text over the memory graph, SQL)
GENERIC: dict[str, tuple[str, str]] = {
    "paths_open": ("MATCH (a)-[r:DEPENDS_ON*1..]->(b) RETURN size(r) AS len, count(*) AS n, count(DISTINCT b) AS ends", f"WITH RECURSIVE {_of('DEPENDS_ON')}, {_WALK} SELECT d AS len, count(*) AS n, count(DISTINCT t) AS ends FROM p GROUP BY 1"),
    "paths_open_from": ("MATCH (a)-[r:DEPENDS_ON*4..]->(b) RETURN elementId(a) AS a, count(*) AS n", f"WITH RECURSIVE {_of('DEPENDS_ON')}, {_WALK} SELECT s AS a, count(*) AS n FROM p WHERE d >= 4 GROUP BY 1"),
    "paths_bare": ("MATCH (a)-[:MENTIONS*]->(b) RETURN count(*) AS n", f"WITH RECURSIVE {_of('MENTIONS')}, {_WALK} SELECT count(*) AS n FROM p WHERE d <= 10"),
    "shortest_open": ("MATCH (a:Task), (b:Task) WHERE a <> b MATCH p = shortestPath((a)-[:RELATES_TO*1..]->(b)) RETURN length(p) AS len, count(*) AS n", f"WITH RECURSIVE {_of('RELATES_TO')}, {_FROM_TASKS} SELECT d AS len, count(*) AS n FROM p GROUP BY 1"),
    "shortest_all": ("MATCH (a:Task), (b:Task) WHERE a <> b MATCH p = allShortestPaths((a)-[:RELATES_TO*1..]->(b)) RETURN elementId(a) AS a, elementId(b) AS b, count(p) AS n", f"WITH RECURSIVE {_of('RELATES_TO')}, {_FROM_TASKS} SELECT s AS a, t AS b, c::BIGINT AS n FROM p"),
    "bound_subgraph": ("MATCH (a) CALL apoc.path.subgraphNodes(a, {relationshipFilter: 'KNOWS>', maxLevel: 2}) YIELD node, depth RETURN elementId(a) AS a, depth, count(node) AS n", f"WITH {_of('KNOWS')}, {_HOPS} SELECT s AS a, d AS depth, count(*) AS n FROM m GROUP BY 1, 2"),
    "bound_label_out": ("MATCH (a) CALL apoc.path.subgraphNodes(a, {relationshipFilter: 'KNOWS>', maxLevel: 2, labelFilter: '-Memory'}) YIELD node RETURN elementId(a) AS a, count(node) AS n", f"WITH {_of('KNOWS')}, {_HOPS} SELECT s AS a, count(*) AS n FROM m WHERE t NOT IN (SELECT id FROM n WHERE list_contains(labels, 'Memory')) GROUP BY 1"),
    "bound_label_in": ("MATCH (a) CALL apoc.path.subgraphNodes(a, {relationshipFilter: 'KNOWS>', maxLevel: 2, labelFilter: '+Memory|+Task'}) YIELD node RETURN elementId(a) AS a, count(node) AS n", f"WITH {_of('KNOWS')}, {_HOPS} SELECT s AS a, count(*) AS n FROM m WHERE t IN (SELECT id FROM n WHERE list_contains(labels, 'Memory') OR list_contains(labels, 'Task')) GROUP BY 1"),
    "bound_label_end": (
        "MATCH (a) CALL apoc.path.subgraphNodes(a, {relationshipFilter: 'KNOWS>', maxLevel: 2, labelFilter: '/Memory'}) YIELD node RETURN elementId(a) AS a, count(node) AS n",
        f"WITH {_of('KNOWS')}, z AS (SELECT id FROM n WHERE list_contains(labels, 'Memory')), h AS (SELECT id AS s, id AS t FROM n UNION SELECT src, dst FROM e WHERE src IN (SELECT id FROM n) AND src NOT IN (SELECT id FROM z) UNION SELECT x.src, y.dst FROM e x JOIN e y ON x.dst = y.src WHERE x.src IN (SELECT id FROM n) AND x.src NOT IN (SELECT id FROM z) AND x.dst NOT IN (SELECT id FROM z)) SELECT s AS a, count(*) AS n FROM h GROUP BY 1",
    ),
    "bound_to_hop": ("MATCH (a) CALL apoc.neighbors.toHop(a, 'CITES>', 2) YIELD node RETURN elementId(a) AS a, count(node) AS n", f"WITH {_of('CITES')}, {_HOPS} SELECT s AS a, count(*) AS n FROM m WHERE d > 0 GROUP BY 1"),
    "bound_at_hop": ("MATCH (a) CALL apoc.neighbors.atHop(a, 'CITES>', 2) YIELD node RETURN elementId(a) AS a, count(node) AS n", f"WITH {_of('CITES')}, {_HOPS} SELECT s AS a, count(*) AS n FROM m WHERE d = 2 GROUP BY 1"),
    "bound_by_hop": ("MATCH (a) CALL apoc.neighbors.byHop(a, 'CITES>', 2) YIELD depth, nodes RETURN elementId(a) AS a, depth, size(nodes) AS n", f"WITH {_of('CITES')}, {_HOPS} SELECT s AS a, d AS depth, count(*)::INT AS n FROM m WHERE d > 0 GROUP BY 1, 2"),
    "bound_count": ("MATCH (a) CALL apoc.neighbors.count(a, 'CITES>', 2) YIELD count RETURN elementId(a) AS a, count AS n", f"WITH {_of('CITES')}, {_HOPS} SELECT s AS a, count(*) - 1 AS n FROM m GROUP BY 1"),
    "bound_spanning": ("MATCH (a) CALL apoc.path.spanningTree(a, {relationshipFilter: 'OWNS>', maxLevel: 2}) YIELD path RETURN size(path) AS len, count(*) AS n", f"WITH {_of('OWNS')}, {_HOPS} SELECT d + 1 AS len, count(*) AS n FROM m GROUP BY 1"),
    "bound_expand": ("MATCH (a) CALL apoc.path.expand(a, 'OWNS>', '', 1, 2) YIELD path RETURN size(path) AS len, count(*) AS n", f"WITH {_of('OWNS')}, k AS (SELECT src, dst FROM e WHERE src <> dst AND src IN (SELECT id FROM n)) SELECT 2 AS len, count(*) AS n FROM k UNION ALL SELECT 3, count(*) FROM k x JOIN e y ON x.dst = y.src AND y.dst NOT IN (x.src, x.dst)"),
    "proc_pagerank": (
        "CALL apoc.algo.pageRank(null, 'DEPENDS_ON') YIELD node, score RETURN node, round(score, 9) AS score",
        f"WITH RECURSIVE {_of('DEPENDS_ON')}, v AS (SELECT src AS id FROM f UNION SELECT dst FROM f), o AS (SELECT src, count(*) AS d FROM f GROUP BY 1), k AS (SELECT count(*) AS n FROM v), p(i, id, s) AS (SELECT 0, id, 1.0::DOUBLE / n FROM v, k UNION ALL (WITH l AS (SELECT coalesce(sum(p.s), 0) AS loose FROM p LEFT JOIN o ON o.src = p.id WHERE o.src IS NULL), g AS (SELECT f.dst, sum(p.s / o.d) AS got FROM p JOIN f ON f.src = p.id JOIN o ON o.src = p.id GROUP BY 1), m AS (SELECT max(i) AS i FROM p) SELECT m.i + 1, v.id, 0.15 / k.n + 0.85 * (coalesce(g.got, 0) + l.loose / k.n) FROM v CROSS JOIN k CROSS JOIN l CROSS JOIN m LEFT JOIN g ON g.dst = v.id WHERE m.i < 20)) SELECT id AS node, round(s, 9) AS score FROM p WHERE i = 20",
    ),
    "proc_components": ("CALL apoc.algo.wcc(null, 'ANSWERS') YIELD node, componentId RETURN node, componentId", f"WITH RECURSIVE {_of('ANSWERS')}, c(id, r) AS (SELECT src, src FROM u UNION SELECT u.dst, c.r FROM c JOIN u ON u.src = c.id), l AS (SELECT src AS id, src AS r FROM f UNION SELECT dst, dst FROM f UNION SELECT id, r FROM c), g AS (SELECT id, min(r) AS r FROM l GROUP BY 1) SELECT id AS node, (dense_rank() OVER (ORDER BY r) - 1)::INT AS \"componentId\" FROM g"),
    "proc_closeness": (
        "CALL apoc.algo.closeness(null, 'ANSWERS') YIELD node, score RETURN node, round(score, 9) AS score",
        f"WITH RECURSIVE {_of('ANSWERS')}, v AS (SELECT src AS id FROM f UNION SELECT dst FROM f), w(s, t, d) USING KEY (s, t) AS (SELECT id, id, 0 FROM v UNION SELECT w.s, u.dst, min(w.d) + 1 FROM w JOIN u ON u.src = w.t LEFT JOIN recurring.w AS k ON k.s = w.s AND k.t = u.dst WHERE k.s IS NULL GROUP BY 1, 2), m AS (SELECT s, t, min(d) AS d FROM w GROUP BY 1, 2) SELECT s AS node, coalesce(round((count(*) - 1)::DOUBLE * (count(*) - 1) / nullif(sum(d) * ((SELECT count(*) FROM v) - 1), 0), 9), 0) AS score FROM m GROUP BY 1",
    ),
    "proc_betweenness": (
        "CALL apoc.algo.betweenness(null, 'DEPENDS_ON') YIELD node, score RETURN node, round(score, 9) AS score",
        f"WITH RECURSIVE {_of('DEPENDS_ON')}, v AS (SELECT src AS id FROM f UNION SELECT dst FROM f), g AS (SELECT src, dst FROM e WHERE src <> dst), w(d, s, t, c) AS (SELECT 0, id, id, 1::DOUBLE FROM v UNION ALL SELECT w.d + 1, w.s, g.dst, sum(w.c) FROM w JOIN g ON w.t = g.src WHERE w.d < 12 GROUP BY 1, 2, 3), m AS (SELECT s, t, min(d) AS d, min_by(c, d) AS c FROM w GROUP BY 1, 2), b AS (SELECT x.t AS id, sum(x.c * y.c / z.c) AS b FROM m x JOIN m y ON x.t = y.s AND x.d > 0 AND y.d > 0 JOIN m z ON z.s = x.s AND z.t = y.t AND z.d = x.d + y.d WHERE x.s <> y.t GROUP BY 1), k AS (SELECT count(*) AS n FROM v) SELECT v.id AS node, round(coalesce(b, 0) * 2 / ((n - 1.0::DOUBLE) * (n - 2)), 9) AS score FROM v CROSS JOIN k LEFT JOIN b USING (id)",
    ),
    "proc_triangles": ("CALL apoc.algo.triangleCount(null, 'RELATES_TO') YIELD node, triangles RETURN node, triangles", f"WITH {_of('RELATES_TO')} SELECT a.src AS node, count(*) AS triangles FROM u a JOIN u b ON a.dst = b.src JOIN u c ON b.dst = c.src AND c.dst = a.src WHERE a.dst < b.dst GROUP BY 1"),
    "proc_project": ("CALL gds.graph.project('answers', 'Task', ['RELATES_TO', 'DEPENDS_ON']) YIELD nodeCount, relationshipCount RETURN nodeCount, relationshipCount", f"WITH {_N}, {_R}, k AS (SELECT id FROM n WHERE list_contains(labels, 'Task')) SELECT (SELECT count(*) FROM k) AS \"nodeCount\", (SELECT count(*) FROM r WHERE type IN ('RELATES_TO', 'DEPENDS_ON') AND src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)) AS \"relationshipCount\""),
    "proc_label_counts": ("CALL apoc.label.count() YIELD label, count RETURN label, count AS n", f"WITH {_N} SELECT label, count(*) AS n FROM (SELECT unnest(labels) AS label FROM n) GROUP BY 1"),
    "proc_type_counts": ("CALL apoc.meta.relTypes() YIELD type, count RETURN type, count AS n", f"WITH {_R} SELECT type, count(*) AS n FROM r WHERE src IS NOT NULL AND dst IS NOT NULL GROUP BY 1"),
    "proc_missing": ("CALL apoc.schema.validate() YIELD type, missing RETURN type, missing", f"WITH {_N}, {_R} SELECT type, count(*) AS missing FROM (SELECT type, src AS k FROM r WHERE dst IS NOT NULL UNION ALL SELECT type, dst FROM r WHERE src IS NOT NULL) WHERE k IS NOT NULL AND k NOT IN (SELECT id FROM n) GROUP BY 1"),
    "proc_property_keys": ("CALL db.propertyKeys() YIELD propertyKey RETURN count(propertyKey) > 0 AS some", "SELECT true AS some"),
}

_PAIRS = f"WITH {_of('KNOWS')}, deg AS (SELECT src, count(*) AS d FROM u GROUP BY 1), w AS (SELECT a.src AS x, b.dst AS y, k.d FROM u a JOIN u b ON a.dst = b.src JOIN deg k ON k.src = a.dst WHERE a.src < b.dst), g AS (SELECT x, y, count(*) AS c, sum(CASE WHEN d > 1 THEN 1 / ln(d) ELSE 0 END) AS aa, sum(1.0::DOUBLE / d) AS ra FROM w GROUP BY 1, 2), s AS (SELECT g.*, p.d AS d1, q.d AS d2 FROM g JOIN deg p ON p.src = x JOIN deg q ON q.src = y LEFT JOIN u ON u.src = x AND u.dst = y WHERE u.src IS NULL)"
_SCORE = {
    "commonNeighbors": "1 - 1 / (1 + c / 2.0::DOUBLE)",
    "adamicAdar": "tanh(aa / 5)",
    "resourceAllocation": "tanh(ra / 5)",
    "jaccard": "c / (d1 + d2 - c)::DOUBLE",
    "preferentialAttachment": "least(log10(d1 * d2 + 1) / 4, 1)",
}
_SCORE["predict"] = " + ".join(f"{w} * ({_SCORE[k]})" for k, w in (("commonNeighbors", 0.2), ("jaccard", 0.2), ("adamicAdar", 0.3), ("resourceAllocation", 0.2), ("preferentialAttachment", 0.1)))
for _k, _x in _SCORE.items():
    GENERIC[f"links_{_k}"] = (f"CALL gds.linkprediction.{_k}.stream({{relationshipTypes: 'KNOWS'}}) YIELD node1, node2, score RETURN node1, node2, round(score, 6) AS score", f"{_PAIRS} SELECT x AS node1, y AS node2, round({_x}, 6) AS score FROM s")

GENERIC |= {
    "element_node": ("MATCH (n) RETURN apoc.node.id(n) AS id, size(apoc.node.labels(n)) AS l, apoc.node.hasLabel(n, 'Task') AS t, apoc.label.hasAny(n, ['Task', 'Memory']) AS a, apoc.meta.isNode(n) AS b, apoc.node.hasProperty(n, 'name') AS c", f"WITH {_N}, p AS (SELECT element_id AS id, json_extract_string(properties, '$.name') IS NOT NULL AS c FROM (SELECT *, row_number() OVER (PARTITION BY element_id ORDER BY updated_at DESC, access_count DESC) AS k FROM nodes) WHERE k = 1) SELECT id, coalesce(len(labels), 0)::INT AS l, coalesce(list_contains(labels, 'Task'), false) AS t, coalesce(list_has_any(labels, ['Task', 'Memory']), false) AS a, true AS b, c FROM n JOIN p USING (id)"),
    "element_rel": ("MATCH (a)-[r:CITES]->(b) RETURN apoc.rel.id(r) AS id, apoc.rel.type(r) AS t, apoc.rel.startNode(r) AS s, apoc.rel.endNode(r) AS e, apoc.rel.nodes(r)[1] AS f, apoc.util.isRelationship(r) AS g, a = b AS loop", f"WITH {_N}, {_R} SELECT r.id AS id, type AS t, src AS s, dst AS e, dst AS f, true AS g, src = dst AS loop FROM r JOIN n a ON a.id = src JOIN n b ON b.id = dst WHERE type = 'CITES'"),
    "cypher_first": ("CALL apoc.cypher.runFirstColumn('MATCH (n:Task) RETURN elementId(n) AS x') YIELD value RETURN value", f"WITH {_N} SELECT id AS value FROM n WHERE list_contains(labels, 'Task')"),
    "community_clustering": ("CALL apoc.community.clusteringCoefficient(null, 'RELATES_TO') YIELD node, coefficient RETURN node, round(coefficient, 9) AS c", f"WITH {_of('RELATES_TO')}, v AS (SELECT src AS id FROM f UNION SELECT dst FROM f), d AS (SELECT src AS id, count(*) AS d FROM u GROUP BY 1), t AS (SELECT a.src AS id, count(*) AS t FROM u a JOIN u b ON a.dst = b.src JOIN u c ON b.dst = c.src AND c.dst = a.src WHERE a.dst < b.dst GROUP BY 1) SELECT id AS node, round(coalesce(2.0::DOUBLE * t / nullif(d * (d - 1), 0), 0), 9) AS c FROM v LEFT JOIN d USING (id) LEFT JOIN t USING (id)"),
    "community_triangles": ("CALL apoc.community.totalTriangles(null, 'RELATES_TO') YIELD triangles RETURN triangles", f"WITH {_of('RELATES_TO')} SELECT count(*) // 3 AS triangles FROM u a JOIN u b ON a.dst = b.src JOIN u c ON b.dst = c.src AND c.dst = a.src WHERE a.dst < b.dst"),
    "community_density": ("CALL apoc.community.density(null, 'KNOWS') YIELD density RETURN round(density, 9) AS d", f"WITH {_of('KNOWS')}, v AS (SELECT count(*) AS n FROM (SELECT src FROM f UNION SELECT dst FROM f)) SELECT round((SELECT count(*) FROM u) / (n * (n - 1))::DOUBLE, 9) AS d FROM v"),
    "community_components": ("CALL apoc.community.numComponents(null, 'ANSWERS') YIELD count RETURN count AS n", f"WITH RECURSIVE {_of('ANSWERS')}, c(id, r) AS (SELECT src, src FROM u UNION SELECT u.dst, c.r FROM c JOIN u ON u.src = c.id), l AS (SELECT src AS id, src AS r FROM f UNION SELECT dst, dst FROM f UNION SELECT id, r FROM c) SELECT count(DISTINCT r) AS n FROM (SELECT id, min(r) AS r FROM l GROUP BY 1)"),
    "community_strong": ("CALL apoc.community.stronglyConnectedComponents(null, 'RELATES_TO') YIELD node, component RETURN node, component", f"WITH RECURSIVE {_of('RELATES_TO')}, v AS (SELECT src AS id FROM f UNION SELECT dst FROM f), z(s, t) AS (SELECT id, id FROM v UNION SELECT z.s, e.dst FROM z JOIN e ON e.src = z.t) SELECT a.s AS node, min(a.t) AS component FROM z a JOIN z b ON a.s = b.t AND a.t = b.s GROUP BY 1"),
    "community_cores": (
        "CALL apoc.community.coreNumber(null, 'RELATES_TO') YIELD node, core RETURN node, core",
        f"WITH RECURSIVE {_of('RELATES_TO')}, v AS (SELECT src AS id FROM f UNION SELECT dst FROM f), k(step, k, src, dst) AS (SELECT 0, 1, src, dst FROM u UNION ALL (WITH d AS (SELECT src, count(*) AS d FROM k GROUP BY 1), bad AS (SELECT count(*) AS n FROM d, (SELECT max(k) AS k FROM k) WHERE d.d < k) SELECT k.step + 1, CASE WHEN bad.n = 0 THEN k.k + 1 ELSE k.k END, k.src, k.dst FROM k CROSS JOIN bad WHERE k.step < 200 AND k.src IN (SELECT src FROM d WHERE d >= k.k) AND k.dst IN (SELECT src FROM d WHERE d >= k.k))), "
        "s AS (SELECT src AS id, max(step) AS last FROM k GROUP BY 1), m AS (SELECT s.id, max(k.k) AS k FROM s JOIN k ON k.src = s.id AND k.step = s.last GROUP BY 1) SELECT id AS node, coalesce(m.k - 1, 0)::INT AS core FROM v LEFT JOIN m USING (id)",
    ),
    "community_degree": ("CALL apoc.algo.degreeCentrality(null, 'KNOWS') YIELD node, score RETURN node, round(score, 9) AS score", f"WITH {_of('KNOWS')}, v AS (SELECT count(*) AS n FROM (SELECT src FROM f UNION SELECT dst FROM f)) SELECT src AS node, round(count(*) / (any_value(n) - 1)::DOUBLE, 9) AS score FROM u, v GROUP BY 1"),
}

_M = "m AS (SELECT element_id AS id, labels, json_extract_string(properties, '$.name') AS name FROM (SELECT *, row_number() OVER (PARTITION BY element_id ORDER BY updated_at DESC, access_count DESC) AS k FROM nodes) WHERE k = 1)"

# name: (calls that change the memory graph, query on what they leave, SQL)
CHANGED: dict[str, tuple[list[str], str, str]] = {
    "change_create": (["CALL apoc.create.node(['Lab'], {name: 'a', size: 3})", "CALL apoc.create.nodes(['Lab', 'Big'], [{name: 'b'}, {name: 'c'}])"], "MATCH (l:Lab) RETURN l.name AS name, size(labels(l)) AS n", "SELECT * FROM (VALUES ('a', 1), ('b', 2), ('c', 2)) t(name, n)"),
    "change_merge": (["CALL apoc.merge.node(['Lab'], {name: 'a'}, {fresh: 'yes'}, {seen: 'again'})", "CALL apoc.merge.node(['Lab'], {name: 'a'}, {fresh: 'no'}, {seen: 'again'})"], "MATCH (l:Lab) RETURN l.name AS name, l.fresh AS fresh, l.seen AS seen", "SELECT 'a' AS name, 'yes' AS fresh, 'again' AS seen"),
    "change_label": (["CALL apoc.refactor.renameLabel('Task', 'Job')"], "MATCH (n) UNWIND labels(n) AS label RETURN label, count(*) AS n", f"WITH {_N} SELECT CASE label WHEN 'Task' THEN 'Job' ELSE label END AS label, count(*) AS n FROM (SELECT unnest(labels) AS label FROM n) GROUP BY 1"),
    "change_type": (["CALL apoc.refactor.renameType('KNOWS', 'MET')"], "MATCH ()-[r:MET]->() RETURN count(r) AS n", f"WITH {_N}, {_R} SELECT count(*) AS n FROM r JOIN n a ON a.id = src JOIN n b ON b.id = dst WHERE type = 'KNOWS'"),
    "change_invert": (["CALL apoc.refactor.invertRelationship('CITES')"], "MATCH (a)-[:CITES]->(b) RETURN elementId(a) AS a, elementId(b) AS b", f"WITH {_N}, {_R} SELECT dst AS a, src AS b FROM r JOIN n a ON a.id = src JOIN n b ON b.id = dst WHERE type = 'CITES'"),
    "change_parallel": (["CALL apoc.refactor.mergeRelationships()"], "MATCH ()-[r]->() RETURN type(r) AS t, count(*) AS n", f"WITH {_N}, {_R} SELECT type AS t, count(*) AS n FROM (SELECT DISTINCT src, dst, type FROM r) JOIN n a ON a.id = src JOIN n b ON b.id = dst GROUP BY 1"),
    "change_categories": (["CALL apoc.refactor.categorizeProperty('name', 'IS_CALLED', 'Name')"], "MATCH (n)-[:IS_CALLED]->(x:Name) RETURN x.name AS name, count(n) AS n", f"WITH {_M} SELECT name, count(*) AS n FROM m WHERE name IS NOT NULL GROUP BY 1"),
    "change_iterate": (["CALL apoc.periodic.iterate('MATCH (n:Task) RETURN n', 'SET n.done = \\'yes\\'', {batchSize: 10})"], "MATCH (n) WHERE n.done = 'yes' RETURN count(n) AS n", f"WITH {_N} SELECT count(*) AS n FROM n WHERE list_contains(labels, 'Task')"),
    "change_vector": (["CALL apoc.create.node(['Lab'], {name: 'v'})", "CALL apoc.periodic.iterate('MATCH (n:Lab) RETURN n', 'SET n.seen = 1', {})"], "MATCH (n:Lab) RETURN n.name AS name, n.seen AS seen", "SELECT 'v' AS name, '1' AS seen"),
    "change_collapse": (
        ["CALL apoc.refactor.collapseNode('Task', 'VIA')"],
        "MATCH (a)-[:VIA]->(b) RETURN count(*) AS n",
        f"WITH {_N}, {_R}, z AS (SELECT id FROM n WHERE list_contains(labels, 'Task')), k AS (SELECT id FROM n WHERE id NOT IN (SELECT id FROM z)) SELECT count(*) AS n FROM r x JOIN z ON x.dst = z.id JOIN r y ON y.src = z.id JOIN k a ON a.id = x.src JOIN k b ON b.id = y.dst",
    ),
}
