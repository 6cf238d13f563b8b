"""Updating queries: each gives a new version of the graph and leaves the old one as it was.

The reading part of a query gives the rows; CREATE, MERGE, SET, REMOVE and DELETE turn
them into inserts (union), changes (join) and deletions (anti-join) on the tables.
Typed graphs take new rows in the columns that the label has; a property that the label
has not becomes a new column.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.cypher.lower import Binding, Lowering, q
from loomgraph.cypher.parser import Clause, NodePat, PathPat, QueryError, RelPat, parse
from loomgraph.graph import Graph, NodeTable, RelTable
from loomgraph.session import cut

WRITES = {"create", "merge", "set", "remove", "delete", "foreach"}


def without(m: Column | str, k: str) -> Column:
    """The map without a key."""
    return F.map_filter(m, lambda x, _: x != k)


@dataclass
class Written:
    graph: Graph
    rows: DataFrame | None
    stats: dict[str, int]


class Writer:
    def __init__(self, graph: Graph, spark: SparkSession, params: dict[str, Any] | None) -> None:
        self.low = Lowering(graph, spark, params)
        self.spark, self.stats = spark, {"nodes_created": 0, "relationships_created": 0, "nodes_deleted": 0, "relationships_deleted": 0, "properties_set": 0}

    @property
    def graph(self) -> Graph:
        return self.low.graph

    @graph.setter
    def graph(self, g: Graph) -> None:
        self.low.graph = g

    def table(self, label: str) -> NodeTable | None:
        return next((n for n in self.graph.nodes if n.generic or n.label == label), None)

    def freeze(self) -> None:
        """Rows that an update reads are fixed first, so that new ids are drawn once."""
        self.low.df = cut(self.low.rows())

    # ---------- nodes
    def new_node(self, n: NodePat) -> None:
        low = self.low
        if n.var in low.scope:
            raise QueryError(f"{n.var} is already bound")
        if not n.labels and not self.graph.generic:
            raise QueryError("a new node needs a label")
        label = n.labels[0] if n.labels else None
        t = self.table(label) if label or self.graph.generic else None
        given = {k: low.expr(e) for k, e in n.props.items()}
        base = low.rows()
        if t is not None and t.generic:
            props = F.create_map(*[x for k, c in given.items() for x in (F.lit(k), c.cast("string"))]) if given else F.create_map().cast("map<string,string>")
            cols = {"id": F.expr("uuid()"), "_labels": F.array(*[F.lit(x) for x in n.labels]), "_props": props}
        else:
            key = t.id if t is not None else next((k for k in given if k == "id"), None)
            if key is None or key not in given:
                key = key or "id"
                given[key] = F.xxhash64(F.expr("uuid()")) if t is None or dict(t.df.dtypes)[key] != "string" else F.expr("uuid()")
            cols = given
        names = list(cols)
        low.df = cut(base.select("*", *[c.alias(f"{n.var}__{k}") for k, c in cols.items()]))
        new = low.df.select(*[q(f"{n.var}__{k}").alias(k) for k in names])
        self.stats["nodes_created"] += new.count()
        self.stats["properties_set"] += len(n.props)
        if t is None:
            self.graph = replace(self.graph, nodes=[*self.graph.nodes, NodeTable(label, new, "id" if "id" in names else names[0])])
            key = "id" if "id" in names else names[0]
        else:
            kinds = dict(t.df.dtypes)
            cast = new.select(*[F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in new.columns])
            grown = t.df.unionByName(cast, allowMissingColumns=True)
            self.graph = replace(self.graph, nodes=[replace(x, df=grown) if x is t else x for x in self.graph.nodes])
            key = t.id
        low.df = low.df.withColumn(f"{n.var}__id", q(f"{n.var}__{key}"))
        low.scope[n.var] = Binding("node", [k for k in names if k != "id"], None if label is None else {label}, generic=bool(t and t.generic))

    def label_of(self, v: str) -> str | None:
        b = self.low.scope[v]
        return None if b.generic or not b.labels else next(iter(b.labels))

    # ---------- relationships
    def new_rel(self, a: str, r: RelPat, b: str) -> None:
        low = self.low
        if r.direction == "in":
            a, b = b, a
        kind = r.types[0]
        src_label, dst_label = self.label_of(a), self.label_of(b)
        given = {k: low.expr(e) for k, e in r.props.items()}
        if self.graph.generic:
            t = self.graph.rels[0]
            props = F.create_map(*[x for k, c in given.items() for x in (F.lit(k), c.cast("string"))]) if given else F.create_map().cast("map<string,string>")
            new = cut(low.rows().select(F.expr("uuid()").alias("id"), q(f"{a}__id").alias("src"), q(f"{b}__id").alias("dst"), F.lit(kind).alias("_type"), props.alias("_props")))
            self.graph = replace(self.graph, rels=[replace(t, df=t.df.unionByName(new, allowMissingColumns=True))])
        else:
            new = low.rows().select(F.expr("uuid()").alias("_rid"), q(f"{a}__id").alias("_src"), q(f"{b}__id").alias("_dst"), *[c.alias(k) for k, c in given.items()])
            new = cut(new)
            t = next((x for x in self.graph.rels if (x.type, x.src_label, x.dst_label) == (kind, src_label, dst_label) and not x.owner and "_rid" in x.df.columns), None)
            if t is None:
                self.graph = replace(self.graph, rels=[*self.graph.rels, RelTable(kind, src_label, dst_label, new, "_src", "_dst", ("_rid",), hidden=("_rid",))])
            else:
                self.graph = replace(self.graph, rels=[replace(x, df=x.df.unionByName(new, allowMissingColumns=True)) if x is t else x for x in self.graph.rels])
        self.stats["relationships_created"] += new.count()

    def create(self, paths: list[PathPat]) -> None:
        self.freeze()
        for p in paths:
            for n in p.items[::2]:
                if n.var not in self.low.scope:
                    self.new_node(n)
            for a, r, b in zip(p.items[:-2:2], p.items[1::2], p.items[2::2], strict=True):
                self.new_rel(a.var, r, b.var)

    # ---------- merge
    def merge(self, d: dict) -> None:
        """Rows whose pattern is there are left to ON MATCH; for the others one new element for each different combination of values."""
        p: PathPat = d["path"]
        low = self.low
        before_df, before = cut(low.rows().withColumn("_row", F.monotonically_increasing_id())), dict(low.scope)
        low.df = before_df
        missing = before_df
        if self.try_match(p):
            hit = low.df = cut(low.df)
            missing = cut(before_df.join(hit.select("_row").distinct(), "_row", "left_anti"))
            if d["match"] and hit.take(1):
                self.set(d["match"])
        low.df, low.scope = missing.drop("_row"), dict(before)
        if missing.take(1):
            given = {f"_g{i}": low.expr(e) for i, e in enumerate(e for x in p.items for e in x.props.values())}
            bound = [f"{x.var}__id" for x in p.items[::2] if x.var in before]
            low.df = cut(low.rows().withColumns(given).dropDuplicates([*given, *bound]).drop(*given))
            self.create([p])
            if d["create"]:
                self.set(d["create"])
        low.df, low.scope = before_df.drop("_row"), dict(before)
        self.try_match(p)

    def try_match(self, p: PathPat) -> bool:
        """Binds the pattern; a label or type that the graph has not yet means that nothing is there."""
        low = self.low
        df, scope = low.df, dict(low.scope)
        try:
            low.do_match({"paths": [p], "where": None, "optional": False})
            return True
        except QueryError:
            low.df, low.scope, low.waiting = df, scope, []
            return False

    # ---------- set and remove
    def change(self, v: str, new: dict[str, Column], drop_all: bool = False, labels: tuple[list[str], bool] | None = None, remove: list[str] | None = None) -> None:
        low = self.low
        b = low.scope[v]
        self.freeze()
        if b.kind == "rel":
            self.change_rel(v, new, remove or [])
            return
        vals = low.df.select(q(f"{v}__id").alias("_k"), *[c.alias(f"_v_{k}") for k, c in new.items()]).filter(F.col("_k").isNotNull()).dropDuplicates(["_k"])
        self.stats["properties_set"] += len(new) + len(remove or [])
        out = []
        for t in self.graph.nodes:
            if not (t.generic or t.label in (b.labels or {t.label})):
                out.append(t)
                continue
            j = t.df.join(vals.withColumn("_hit", F.lit(True)), F.col(t.id).cast("string") == F.col("_k").cast("string"), "left")
            hit = F.col("_hit").isNotNull()
            if t.generic:
                m = F.create_map().cast("map<string,string>") if drop_all else F.col("_props")
                for k in new:
                    m = F.map_concat(without(m, k), F.create_map(F.lit(k), F.col(f"_v_{k}").cast("string")))
                for k in remove or []:
                    m = without(m, k)
                m = F.map_filter(m, lambda _, y: y.isNotNull())
                lab = F.col("_labels")
                if labels:
                    want = F.array(*[F.lit(x) for x in labels[0]])
                    lab = F.array_union(lab, want) if labels[1] else F.array_except(lab, want)
                j = j.withColumn("_props", F.when(hit, m).otherwise(F.col("_props"))).withColumn("_labels", F.when(hit, lab).otherwise(F.col("_labels")))
            else:
                if labels:
                    raise QueryError("labels of typed nodes are their tables")
                cols = [c for c in t.df.columns if c != t.id] if drop_all else []
                for c in cols + list(remove or []):
                    if c not in new and c in t.df.columns:
                        j = j.withColumn(c, F.when(hit, F.lit(None)).otherwise(F.col(c)))
                for k in new:
                    old = F.col(k) if k in t.df.columns else F.lit(None)
                    kind = dict(t.df.dtypes).get(k)
                    val = F.col(f"_v_{k}").cast(kind) if kind else F.col(f"_v_{k}")
                    j = j.withColumn(k, F.when(hit, val).otherwise(old))
            keep = [*t.df.columns, *[k for k in new if not t.generic and k not in t.df.columns]]
            out.append(replace(t, df=cut(j.select(*keep))))
        self.graph = replace(self.graph, nodes=out)
        for k, c in new.items():
            if not b.generic:
                low.df = low.df.withColumn(f"{v}__{k}", c)
                if k not in b.props:
                    b.props.append(k)
        if b.generic:
            m = q(f"{v}___props")
            for k, c in new.items():
                m = F.map_concat(without(m, k), F.create_map(F.lit(k), c.cast("string")))
            low.df = low.df.withColumn(f"{v}___props", m)

    def change_rel(self, v: str, new: dict[str, Column], remove: list[str]) -> None:
        low = self.low
        vals = low.df.select(q(f"{v}__rid").alias("_k"), *[c.alias(f"_v_{k}") for k, c in new.items()]).dropDuplicates(["_k"]).withColumn("_hit", F.lit(True))
        out = []
        for t in self.graph.rels:
            if t.owner or not t.id:
                out.append(t)
                continue
            rid = F.concat_ws("|", *[F.col(c).cast("string") for c in t.id])
            j = t.df.join(vals, (F.concat(F.lit(f"{t.type}|"), rid) if t.type else rid) == F.col("_k"), "left")
            hit = F.col("_hit").isNotNull()
            for k in new:
                if t.type is None and k not in t.df.columns:
                    m = F.map_concat(without(F.col("_props"), k), F.create_map(F.lit(k), F.col(f"_v_{k}").cast("string")))
                    j = j.withColumn("_props", F.when(hit, m).otherwise(F.col("_props")))
                else:
                    j = j.withColumn(k, F.when(hit, F.col(f"_v_{k}")).otherwise(F.col(k) if k in t.df.columns else F.lit(None)))
            for k in remove:
                if k in t.df.columns:
                    j = j.withColumn(k, F.when(~hit, F.col(k)))
                elif t.type is None:
                    j = j.withColumn("_props", F.when(hit, without("_props", k)).otherwise(F.col("_props")))
            out.append(replace(t, df=cut(j.drop("_k", "_hit", *[f"_v_{k}" for k in new]))))
        self.graph = replace(self.graph, rels=out)
        self.stats["properties_set"] += len(new)

    def set(self, sets: list) -> None:
        for s in sets:
            if s[0] == "prop":
                self.change(s[1], {s[2]: self.low.expr(s[3])})
            elif s[0] == "labels":
                self.change(s[1], {}, labels=(s[2], True))
            elif s[2][0] == "map":
                self.change(s[1], {k: self.low.expr(e) for k, e in s[2][1]}, drop_all=s[0] == "replace")
            else:
                raise QueryError("SET takes a property, labels or a map")

    def remove(self, items: list) -> None:
        for i in items:
            self.change(i[1], {}, labels=(i[2], False)) if i[0] == "labels" else self.change(i[1], {}, remove=[i[2]])

    # ---------- delete
    def delete(self, d: dict) -> None:
        self.freeze()
        low = self.low
        for v in d["vars"]:
            b = low.scope[v]
            if b.kind == "rel":
                gone = cut(low.df.select(q(f"{v}__rid").alias("_k")).distinct())
                out = []
                for t in self.graph.rels:
                    if t.owner:
                        out.append(t)
                        continue
                    rid = F.concat_ws("|", *[F.col(c).cast("string") for c in (t.id or (t.src, t.dst))])
                    kept = t.df.join(gone, (F.concat(F.lit(f"{t.type}|"), rid) if t.type else rid) == F.col("_k"), "left_anti")
                    out.append(replace(t, df=kept))
                self.stats["relationships_deleted"] += gone.count()
                self.graph = replace(self.graph, rels=out)
                continue
            gone = cut(low.df.select(q(f"{v}__id").cast("string").alias("_k")).filter("_k is not null").distinct())
            touched, rels = 0, []
            for t in self.graph.rels:
                d0 = t.df
                for end, lab in ((t.src, t.src_label), (t.dst, t.dst_label)):
                    if not t.owner and (lab is None or lab in (b.labels or {lab})):
                        d0 = d0.join(gone, F.col(end).cast("string") == F.col("_k"), "left_anti")
                if not t.owner and d0 is not t.df:
                    touched += t.df.count() - d0.count()
                rels.append(replace(t, df=d0))
            if touched and not d["detach"]:
                raise QueryError("a node with relationships is deleted only by DETACH DELETE")
            nodes = [replace(t, df=t.df.join(gone, F.col(t.id).cast("string") == F.col("_k"), "left_anti")) if t.generic or t.label in (b.labels or {t.label}) else t for t in self.graph.nodes]
            self.stats["nodes_deleted"] += gone.count()
            self.stats["relationships_deleted"] += touched
            self.graph = replace(self.graph, nodes=nodes, rels=rels)

    def clause(self, c: Clause) -> None:
        d = c.data
        if c.kind == "create":
            self.create(d["paths"])
        elif c.kind == "merge":
            self.merge(d)
        elif c.kind == "set":
            self.set(d["sets"])
        elif c.kind == "remove":
            self.remove(d["items"])
        elif c.kind == "delete":
            self.delete(d)
        elif c.kind == "foreach":
            kept_df, kept = self.low.rows(), dict(self.low.scope)
            self.low.do_unwind({"expr": d["list"], "var": d["var"]})
            for x in d["body"]:
                self.clause(x)
            self.low.df, self.low.scope = kept_df, kept
        else:
            self.low.clause(c)


def execute(graph: Graph, spark: SparkSession, text: str, params: dict[str, Any] | None = None) -> Written:
    """Runs a query that may update; the result has the new graph, the rows if it returns any, and counts."""
    tree = parse(text)
    if not any(c.kind in WRITES for p in tree["parts"] for c in p):
        from loomgraph.cypher.lower import run_tree

        return Written(graph, run_tree(graph, spark, tree, params), {})
    w = Writer(graph, spark, params)
    for part in tree["parts"]:
        for c in part:
            w.clause(c)
    returned = tree["parts"][-1][-1].kind == "return"
    return Written(w.graph, w.low.rows() if returned else None, w.stats)


def batched(graph: Graph, spark: SparkSession, rows_query: str, update: str, params: dict[str, Any] | None = None) -> Written:
    """A reading query whose rows an update then takes: both as one plan, since a version is made in one step."""
    cols = parse(rows_query)["parts"][0][-1].data["items"].items
    carry = ", ".join(a for _, a in cols)
    body = rows_query[: rows_query.upper().rindex("RETURN")]
    return execute(graph, spark, f"{body} WITH {carry} {update}", params)


def check_unique(graph: Graph, label: str, prop: str) -> DataFrame:
    """Values that break a uniqueness constraint, with their number."""
    t = next(n for n in graph.nodes if n.generic or n.label == label)
    d = t.df.filter(F.array_contains("_labels", label)) if t.generic else t.df
    c = F.col(prop) if prop in d.columns else F.col("_props")[prop]
    return d.select(c.alias("value")).filter("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def check_exists(graph: Graph, label: str, prop: str) -> DataFrame:
    t = next(n for n in graph.nodes if n.generic or n.label == label)
    d = t.df.filter(F.array_contains("_labels", label)) if t.generic else t.df
    c = F.col(prop) if prop in d.columns else F.col("_props")[prop]
    return d.filter(c.isNull()).select(F.col(t.id).alias("id"))


