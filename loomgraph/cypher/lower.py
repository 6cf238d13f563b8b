"""A syntax tree to one DataFrame plan.

Variables are flattened: a node variable n owns the columns n__id, n__<property>, so
that Catalyst prunes what a query doesn't use. Hops are equi-joins; a relationship that
a node table owns costs one join. EXISTS, COUNT and COLLECT become semi, anti and
grouped left joins; nothing is evaluated row by row.
"""

from __future__ import annotations

from dataclasses import dataclass, field, is_dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.cypher.parser import Clause, Items, NodePat, PathPat, QueryError, RelPat, parse
from loomgraph.functions import registry
from loomgraph.graph import Graph, NodeTable, RelTable
from loomgraph.operators.algorithms import fewest_hops
from loomgraph.session import cut

# Fixed value: hops followed where a range has no upper end ("*2.."); a bare "*" is 10, set by the parser.
OPEN_END_HOPS = 100
CHAINED_HOPS = 3  # so many hops are one plan of chained joins; further ones are rounds of a loop


@dataclass
class Binding:
    kind: str  # node, rel, rels, path, value
    props: list[str] = field(default_factory=list)
    labels: set[str] | None = None
    types: set[str] | None = None
    generic: bool = False
    parts: list[str] = field(default_factory=list)
    ends: tuple[str, str] | None = None
    stub: bool = False


Scope = dict[str, Binding]


def q(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def conjuncts(e) -> list:
    return conjuncts(e[2]) + conjuncts(e[3]) if e and e[0] == "bin" and e[1] == "and" else [e] if e else []


def variables(e) -> set[str]:
    """Names of variables that an expression mentions (patterns inside included)."""
    out: set[str] = set()

    def walk(x) -> None:
        if isinstance(x, tuple):
            if x and x[0] == "var":
                out.add(x[1])
            for y in x:
                walk(y)
        elif isinstance(x, list):
            for y in x:
                walk(y)
        elif isinstance(x, dict):
            for y in x.values():
                walk(y)
        elif isinstance(x, NodePat | RelPat):
            if x.var:
                out.add(x.var)
            walk(x.props)
        elif isinstance(x, PathPat):
            walk(x.items)
        elif isinstance(x, Clause):
            walk(x.data)
        elif isinstance(x, Items):
            walk(x.items)

    walk(e)
    return out


def has_aggregate(e) -> bool:
    if isinstance(e, tuple):
        if e and e[0] == "call" and e[1] in registry.AGGREGATES:
            return True
        return e[0] not in ("exists", "count", "collect", "lit") and any(has_aggregate(x) for x in e)
    return isinstance(e, list) and any(has_aggregate(x) for x in e)


def only_measured(part: list | None, v: str | None) -> bool:
    """Whether a path is asked for nothing but its length and how many there are."""
    if part is None:
        return False

    def other_use(x) -> bool:
        if isinstance(x, tuple) and x:
            if x[0] == "call" and x[1:] in (("length", [("var", v)], False), ("count", [("var", v)], False)):
                return False
            return x == ("var", v) or any(map(other_use, x))
        if isinstance(x, list):
            return any(map(other_use, x))
        if isinstance(x, Items) and x.star:
            return True
        return any(map(other_use, list(x.values() if isinstance(x, dict) else vars(x).values()))) if isinstance(x, dict) or is_dataclass(x) else False

    return not other_use(part)


class Lowering:
    def __init__(self, graph: Graph, spark: SparkSession, params: dict[str, Any] | None = None) -> None:
        self.graph, self.spark, self.params = graph, spark, params or {}
        self.df: DataFrame | None = None
        self.scope: Scope = {}
        self.counter = 0
        self.waiting: list = []
        self.part: list | None = None  # all clauses, where they are known
        self.product: tuple | None = None  # rows, and the tables and conditions of which they are the filtered product

    # ---------- helpers
    def unit(self) -> DataFrame:
        return self.spark.range(1).select(F.lit(1).alias("_unit"))

    def rows(self) -> DataFrame:
        return self.df if self.df is not None else self.unit()

    def tmp(self, what: str) -> str:
        self.counter += 1
        return f"_{what}{self.counter}"

    def columns(self, v: str) -> list[str]:
        b = self.scope[v]
        if b.kind == "node":
            return [f"{v}__id", *[f"{v}__{p}" for p in b.props]]
        if b.kind == "rel":
            return [f"{v}__rid", f"{v}__src", f"{v}__dst", f"{v}__type", *[f"{v}__{p}" for p in b.props]]
        return [v]

    # ---------- expressions
    def expr(self, e, lam: dict[str, Column] | None = None) -> Column:
        lam = lam or {}
        k = e[0]
        if k == "lit":
            return F.lit(e[1])
        if k == "param":
            if e[1] not in self.params:
                raise QueryError(f"parameter ${e[1]} is not given")
            return F.lit(self.params[e[1]])
        if k == "var":
            return lam[e[1]] if e[1] in lam else self.variable(e[1])
        if k == "prop":
            return self.prop(e, lam)
        if k == "bin":
            return self.binary(e, lam)
        if k == "un":
            x = self.expr(e[2], lam)
            return {"not": lambda: ~x, "-": lambda: -x, "isnull": lambda: x.isNull(), "notnull": lambda: x.isNotNull()}[e[1]]()
        if k == "list":
            return F.array(*[self.expr(x, lam) for x in e[1]])
        if k == "map":
            return F.struct(*[self.expr(v, lam).alias(n) for n, v in e[1]])
        if k == "index":
            i, x = self.expr(e[2], lam), self.expr(e[1], lam)
            if e[2][0] == "lit" and isinstance(e[2][1], str):
                return x[e[2][1]]
            return F.get(x, F.when(i < 0, F.size(x) + i).otherwise(i).cast("int"))
        if k == "slice":
            x = self.expr(e[1], lam)
            n = F.size(x)
            at = lambda p, d: d if p is None else F.when(self.expr(p, lam) < 0, n + self.expr(p, lam)).otherwise(self.expr(p, lam))
            lo, hi = F.greatest(at(e[2], F.lit(0)), F.lit(0)), F.least(at(e[3], n), n)
            return F.slice(x, (lo + 1).cast("int"), F.greatest(hi - lo, F.lit(0)).cast("int"))
        if k == "case":
            test = (lambda w: self.expr(e[1], lam) == self.expr(w, lam)) if e[1] is not None else (lambda w: self.expr(w, lam))
            c = None
            for w, t in e[2]:
                c = F.when(test(w), self.expr(t, lam)) if c is None else c.when(test(w), self.expr(t, lam))
            return c if e[3] is None else c.otherwise(self.expr(e[3], lam))
        if k == "lcomp":
            x = self.expr(e[2], lam)
            if e[3] is not None:
                x = F.filter(x, lambda v: self.expr(e[3], lam | {e[1]: v}))
            return x if e[4] is None else F.transform(x, lambda v: self.expr(e[4], lam | {e[1]: v}))
        if k == "quant":
            x, test = self.expr(e[3], lam), (lambda v: self.expr(e[4], lam | {e[2]: v}))
            return {"all": lambda: F.forall(x, test), "any": lambda: F.exists(x, test), "none": lambda: ~F.exists(x, test), "single": lambda: F.size(F.filter(x, test)) == 1}[e[1]]()
        if k == "reduce":
            return F.aggregate(self.expr(e[4], lam), self.expr(e[2], lam), lambda a, x: self.expr(e[5], lam | {e[1]: a, e[3]: x}))
        if k == "haslabels":
            return self.has_labels(e[1][1], e[2])
        if k in ("exists", "count", "collect"):
            return self.subvalue(e)
        if k == "call":
            return self.call_function(e, lam)
        raise QueryError(f"{k} can't be used here")

    def variable(self, v: str) -> Column:
        if v not in self.scope:
            raise QueryError(f"variable {v} is not defined")
        b = self.scope[v]
        if b.kind == "node":
            own = [q(f"{v}__{p}").alias(p) for p in b.props if p not in ("_labels", "_props")]
            extra = [q(f"{v}___labels").alias("labels"), q(f"{v}___props").alias("props")] if b.generic else []
            return F.when(q(f"{v}__id").isNotNull(), F.struct(q(f"{v}__id").alias("id"), *extra, *own))
        if b.kind == "rel":
            own = [q(f"{v}__{p}").alias(p) for p in b.props if p != "_props"]
            return F.when(q(f"{v}__rid").isNotNull(), F.struct(q(f"{v}__type").alias("type"), q(f"{v}__src").alias("src"), q(f"{v}__dst").alias("dst"), *own))
        return q(v)

    def prop(self, e, lam) -> Column:
        if e[1][0] == "var" and e[1][1] not in lam and e[1][1] in self.scope:
            v, b = e[1][1], self.scope[e[1][1]]
            if b.kind in ("node", "rel"):
                if e[2] in b.props:
                    return q(f"{v}__{e[2]}")
                if b.generic:
                    return q(f"{v}___props").getItem(e[2])
                if e[2] == "id" and b.kind == "node":
                    return q(f"{v}__id")
                return F.lit(None)
        full = registry.dotted(e)
        if full and full.split(".")[0] not in self.scope:
            raise QueryError(f"{full} is not defined")
        return self.expr(e[1], lam).getField(e[2])

    def numeric(self, e) -> bool:
        return (e[0] == "lit" and isinstance(e[1], int | float) and not isinstance(e[1], bool)) or (e[0] == "param" and isinstance(self.params.get(e[1]), int | float)) or (e[0] == "bin" and e[1] in "-*/%^") or (e[0] == "un" and e[1] == "-")

    def from_map(self, e) -> bool:
        return e[0] == "prop" and e[1][0] == "var" and (b := self.scope.get(e[1][1])) is not None and b.generic and e[2] not in b.props

    def same_element(self, x, y, lam) -> Column | None:
        """Two node or relationship variables are equal if their ids are, and their labels where ids are those of a label."""
        kinds = [self.scope[v[1]].kind if v[0] == "var" and v[1] in self.scope and v[1] not in lam else None for v in (x, y)]
        if kinds[0] != kinds[1] or kinds[0] not in ("node", "rel"):
            return None
        if kinds[0] == "rel":
            return q(f"{x[1]}__rid") == q(f"{y[1]}__rid")

        def label(v: str) -> Column | None:
            b = self.scope[v]
            return None if b.generic else q(f"{v}___label") if "_label" in b.props else F.lit(next(iter(b.labels or {""})))

        a, b = label(x[1]), label(y[1])
        ids = q(f"{x[1]}__id").cast("string") == q(f"{y[1]}__id").cast("string")
        return ids if a is None or b is None else ids & (a == b)

    def binary(self, e, lam) -> Column:
        o = e[1]
        if o in ("=", "<>") and (same := self.same_element(e[2], e[3], lam)) is not None:
            return same if o == "=" else ~same
        a, b = self.expr(e[2], lam), self.expr(e[3], lam)
        if o in ("=", "<>", "<", ">", "<=", ">=", "-", "*", "/", "%", "^", "+"):
            # A property out of a map is text; beside a number it is read as one.
            if self.from_map(e[2]) and (self.numeric(e[3]) or o in ("-", "*", "/", "%", "^")):
                a = a.try_cast("double")
            if self.from_map(e[3]) and (self.numeric(e[2]) or o in ("-", "*", "/", "%", "^")):
                b = b.try_cast("double")
        if o in ("+", "-", "*"):
            # Integers are 64 bits wide; a literal makes the whole operation so.
            whole = lambda x: x[0] == "lit" and isinstance(x[1], int) and not isinstance(x[1], bool)
            a = a.cast("bigint") if whole(e[2]) else a
            b = b.cast("bigint") if whole(e[3]) else b
        if o == "+":
            text = lambda x: (x[0] == "lit" and isinstance(x[1], str)) or (x[0] == "call" and x[1] in registry.TEXT_VALUED) or (x[0] == "bin" and x[1] == "+" and (text(x[2]) or text(x[3])))
            lists = lambda x: x[0] in ("list", "lcomp", "slice") or (x[0] == "call" and x[1] in registry.LIST_VALUED)
            if text(e[2]) or text(e[3]):
                return F.concat(a.cast("string"), b.cast("string"))
            if lists(e[2]) and lists(e[3]):
                return F.concat(a, b)
            if lists(e[2]):
                return F.array_append(a, b)
            if e[2][0] == e[3][0] == "prop" and self.text_column(e[2]) and self.text_column(e[3]):
                return F.concat(a, b)
            return a + b
        table = {
            "=": lambda: a == b,
            "<>": lambda: a != b,
            "<": lambda: a < b,
            ">": lambda: a > b,
            "<=": lambda: a <= b,
            ">=": lambda: a >= b,
            "and": lambda: a & b,
            "or": lambda: a | b,
            "xor": lambda: a.cast("boolean") != b.cast("boolean"),
            "-": lambda: a - b,
            "*": lambda: a * b,
            "/": lambda: F.try_divide(a, b),
            "%": lambda: F.try_mod(a, b),
            "^": lambda: F.pow(a, b),
            "=~": lambda: a.rlike(e[3][1]) if e[3][0] == "lit" else F.regexp_like(a, b),
            "starts": lambda: F.startswith(a, b),
            "ends": lambda: F.endswith(a, b),
            "contains": lambda: F.contains(a, b),
            "in": lambda: a.isin(*[x[1] for x in e[3][1]]) if e[3][0] == "list" and e[3][1] and all(x[0] == "lit" for x in e[3][1]) else F.array_contains(b, a),
        }
        return table[o]()

    def text_column(self, e) -> bool:
        v, p = e[1][1], e[2]
        return self.df is not None and dict(self.df.dtypes).get(f"{v}__{p}") == "string"

    def has_labels(self, v: str, labels: list[str]) -> Column:
        """All of these labels; one written 'A|B' asks for either."""
        b = self.scope[v]

        def one(label: str) -> Column:
            if b.generic:
                return F.array_contains(q(f"{v}___labels"), label)
            return F.lit(label in b.labels) if b.labels is not None and len(b.labels) == 1 else q(f"{v}___label") == label

        return reduce(lambda x, y: x & y, [reduce(lambda x, y: x | y, [one(x) for x in text.split("|")]) for text in labels])

    def call_function(self, e, lam) -> Column:
        name, args = e[1], e[2]
        if name in registry.AGGREGATES:
            return self.aggregate(e)
        if args and args[0][0] == "var" and args[0][1] not in lam and args[0][1] in self.scope:
            v, b = args[0][1], self.scope[args[0][1]]
            done = self.graph_function(name, v, b, args, lam)
            if done is not None:
                return done
        if name in ("size", "length", "isempty") and len(args) == 1:
            x = self.expr(args[0], lam)
            n = F.length(x) if self.is_text(args[0], x, lam) else F.size(x)
            return n == 0 if name == "isempty" else n
        f = registry.lookup(name)
        if f is None:
            raise QueryError(f"unknown function {name}")
        given = [self.expr(a, lam) for a in args]
        return f(*given)

    def is_text(self, e, x: Column, lam: dict[str, Column]) -> bool:
        """Whether an expression is text: by the analyser, or inside a lambda by its form."""
        if not lam:
            return self.rows().select(x).dtypes[0][1] == "string"
        return (e[0] == "lit" and isinstance(e[1], str)) or (e[0] == "call" and e[1] in registry.TEXT_VALUED) or e[0] == "var"

    # Further names of what a node or relationship variable says of itself.
    ACCESS = {
        "apoc.node.id": "id", "apoc.rel.id": "id", "apoc.node.labels": "labels", "apoc.label.get": "labels", "apoc.node.properties": "properties", "apoc.rel.properties": "properties",
        "apoc.rel.type": "type", "apoc.rel.startnode": "startnode", "apoc.rel.endnode": "endnode", "apoc.node.haslabels": "haslabels", "apoc.label.hasall": "haslabels",
    }

    def element_library(self, name: str, v: str, b: Binding, args) -> Column | None:
        """Library functions of one element whose further arguments are constants."""
        prop = lambda: self.expr(("prop", ("var", v), self.constant_value(args[1])))
        if name in ("apoc.node.haslabel", "apoc.label.has") and b.kind == "node":
            return self.has_labels(v, [self.constant_value(args[1])])
        if name == "apoc.label.hasany" and b.kind == "node":
            return self.has_labels(v, ["|".join(self.constant_value(args[1]))])
        if name in ("apoc.rel.property", "apoc.node.property") and b.kind in ("node", "rel"):
            return prop()
        if name in ("apoc.rel.hasproperty", "apoc.node.hasproperty") and b.kind in ("node", "rel"):
            return prop().isNotNull()
        if name == "apoc.rel.hasproperties" and b.kind == "rel":
            return reduce(lambda x, y: x & y, [self.expr(("prop", ("var", v), k)).isNotNull() for k in self.constant_value(args[1])])
        if name == "apoc.rel.nodes" and b.kind == "rel":
            return F.array(q(f"{v}__src"), q(f"{v}__dst"))
        if name == "apoc.rel.weight" and b.kind == "rel":
            key = self.constant_value(args[1]) if len(args) > 1 else "weight"
            own = self.expr(("prop", ("var", v), key)) if b.generic or key in b.props else F.lit(None)
            return F.coalesce(own.try_cast("double"), F.lit(1.0))
        kinds = {"isnode": "node", "isrelationship": "rel", "ispath": "path"}
        space, _, last = name.rpartition(".")
        return F.lit(b.kind == kinds[last]) if space in ("apoc.meta", "apoc.util") and last in kinds else None

    def graph_function(self, name: str, v: str, b: Binding, args, lam) -> Column | None:
        found = self.element_library(name, v, b, args)
        if found is not None:
            return found
        name = self.ACCESS.get(name, name)
        if name in ("id", "elementid") and b.kind in ("node", "rel"):
            c = q(f"{v}__id") if b.kind == "node" else q(f"{v}__rid")
            return c.cast("string") if name == "elementid" else c
        if b.kind == "node":
            if name == "labels":
                return q(f"{v}___labels") if b.generic else F.array(q(f"{v}___label") if "_label" in b.props else F.lit(next(iter(b.labels or {""}))))
            if name == "haslabels":
                return self.has_labels(v, [x[1] for x in args[1][1]])
            if name in ("degree", "indegree", "outdegree"):
                return self.degree(v, name)
        if b.kind == "rel" and name == "type":
            return q(f"{v}__type")
        if b.kind == "rel" and name in ("startnode", "endnode"):
            return q(f"{v}__{'src' if name == 'startnode' else 'dst'}")
        if b.kind in ("node", "rel") and name in ("keys", "properties"):
            own = [p for p in b.props if not p.startswith("_")]
            if name == "keys":
                mine = F.filter(F.array(*[F.when(q(f"{v}__{p}").isNotNull(), F.lit(p)) for p in own]), lambda x: x.isNotNull())
                return F.concat(mine, F.map_keys(q(f"{v}___props"))) if b.generic else mine
            return F.struct(*[q(f"{v}__{p}").alias(p) for p in own])
        if b.kind == "path":
            part = {"nodes": "nodes", "relationships": "rels", "rels": "rels"}.get(name)
            if part:
                return q(v).getField(part)
            if name in ("length", "size"):
                return F.size(q(v).getField("rels"))
        return None

    def degree(self, v: str, name: str) -> Column:
        """Ends are counted by the label they belong to; ids of other labels may be equal."""
        own, labelled = self.scope[v].labels, "_label" in self.scope[v].props
        sides, parts = {"degree": ("src", "dst"), "indegree": ("dst",), "outdegree": ("src",)}[name], []
        for t in self.graph.rels:
            for side in sides:
                label = t.src_label if side == "src" else t.dst_label
                if own is None or label is None or label in own:
                    parts.append(t.df.select(F.col(t.src if side == "src" else t.dst).cast("string").alias("_k"), F.lit(label).alias("_l")))
        if not parts:
            return F.lit(0).cast("bigint")
        col = self.tmp("deg")
        n = reduce(lambda x, y: x.unionAll(y), parts).groupBy("_k", "_l").agg(F.count(F.lit(1)).alias(col))
        on = q(f"{v}__id").cast("string") == F.col("_k")
        self.df = self.df.join(n, on & (q(f"{v}___label") == F.col("_l")) if labelled else on, "left").drop("_k", "_l")
        return F.coalesce(q(col), F.lit(0))

    def aggregate(self, e) -> Column:
        name, args, distinct = e[1], e[2], e[3]
        if name == "count":
            if not args or args[0][0] == "star":
                return F.count(F.lit(1))
            b = self.scope.get(args[0][1]) if args[0][0] == "var" else None
            c = q(f"{args[0][1]}__{'id' if b.kind == 'node' else 'rid'}") if b is not None and b.kind in ("node", "rel") else self.expr(args[0])
            return F.count_distinct(c) if distinct else F.count(c)
        given = [self.expr(a) for a in args]
        if self.from_map(args[0]) and name in ("sum", "avg", "min", "max", "stdev", "stdevp", "percentilecont", "percentiledisc"):
            given[0] = given[0].try_cast("double")
        return registry.AGGREGATES[name](distinct, *given)

    # ---------- subqueries as values
    def subvalue(self, e) -> Column:
        """EXISTS, COUNT and COLLECT anywhere in an expression: a grouped left join on the shared variables."""
        kind, shared, inner, keys = e[0], *self.correlated(e[1])
        col = self.tmp(kind)
        if kind == "exists":
            inner = inner.select(*keys).distinct().withColumn(col, F.lit(True))
        elif kind == "count":
            inner = inner.groupBy(*keys).agg(F.count(F.lit(1)).alias(col))
        else:
            out = [c for c in inner.columns if c not in keys]
            inner = inner.groupBy(*keys).agg(F.collect_list(F.col(f"`{out[0]}`")).alias(col))
        on = reduce(lambda x, y: x & y, [q(s) == F.col(k) for s, k in zip(shared, keys, strict=True)]) if keys else F.lit(True)
        self.df = self.rows().join(inner, on, "left").drop(*keys) if keys else self.rows().crossJoin(inner)
        default = {"exists": F.lit(False), "count": F.lit(0)}.get(kind)
        return F.coalesce(q(col), default) if default is not None else F.coalesce(q(col), F.expr("array()"))

    def correlated(self, query: dict) -> tuple[list[str], DataFrame, list[str]]:
        """The shared columns outside, the inner rows, and the names of those columns inside."""
        used = variables([c.data for c in query["parts"][0]])
        shared_vars = [v for v in self.scope if v in used and self.scope[v].kind in ("node", "value", "rel")]
        sub = Lowering(self.graph, self.spark, self.params)
        sub.counter = self.counter + 1000
        shared = []
        for v in shared_vars:
            b = self.scope[v]
            if b.kind == "node":
                sub.scope[v] = Binding("node", [], b.labels, generic=b.generic, stub=True)
                shared.append(f"{v}__id")
        # Values and node properties of outside come in as distinct rows only if they are needed.
        values = [v for v in shared_vars if self.scope[v].kind == "value"]
        needs = self.props_used(query, shared_vars)
        if values or needs or not self.stub_ok(query, shared_vars):
            cols = [c for v in shared_vars for c in self.columns(v)]
            sub.df = self.rows().select(*[q(c) for c in cols]).distinct()
            sub.scope = {v: self.scope[v] for v in shared_vars}
            shared = [f"{v}__id" if self.scope[v].kind == "node" else f"{v}__rid" if self.scope[v].kind == "rel" else v for v in shared_vars]
        for c in query["parts"][0]:
            if c.kind == "return":
                keep = [(("var", v), v) for v in shared_vars]
                items = c.data["items"]
                c = Clause("return_sub", {"items": items, "keep": keep})
            sub.clause(c)
        keys = [self.tmp("k") for _ in shared]
        inner = sub.rows()
        out = [x for x in inner.columns if x.startswith("_out_")]
        return shared, inner.select(*[q(s).alias(k) for s, k in zip(shared, keys, strict=True)], *[q(x) for x in out]), keys

    def props_used(self, query: dict, shared: list[str]) -> bool:
        found = False

        def walk(x) -> None:
            nonlocal found
            if isinstance(x, tuple):
                if x and x[0] == "prop" and x[1][0] == "var" and x[1][1] in shared:
                    found = True
                for y in x:
                    walk(y)
            elif isinstance(x, list):
                for y in x:
                    walk(y)
            elif isinstance(x, dict):
                for y in x.values():
                    walk(y)
            elif isinstance(x, Items):
                walk([x.items, x.where])
            elif isinstance(x, Clause):
                walk(x.data)
            elif isinstance(x, NodePat):
                if x.var in shared and x.props:
                    found = True
                walk(list(x.props.values()))
            elif isinstance(x, RelPat):
                walk(list(x.props.values()))
            elif isinstance(x, PathPat):
                walk(x.items)

        walk([c.data for c in query["parts"][0]])
        return found

    def stub_ok(self, query: dict, shared: list[str]) -> bool:
        """Whether every shared node is met on the first path, next to a relationship of one hop."""
        first = query["parts"][0][0]
        if first.kind != "match" or any(self.scope[v].kind != "node" for v in shared):
            return False
        p = first.data["paths"][0]
        if len(p.items) < 3 or any(r.hops for r in p.items[1::2]) or p.shortest:
            return False
        names = [n.var for n in p.items[::2]]
        return all(v in names for v in shared) and names[0] in shared

    # ---------- matching
    def scan(self, n: NodePat, tables: list[NodeTable] | None = None) -> DataFrame:
        """All nodes a pattern may stand for, with the pattern's inline conditions; binds its variable."""
        labels = [x for x in n.labels]
        wanted = {y for x in labels for y in x.split("|")}
        tables = tables or self.graph.tables(wanted or None)
        if not tables:
            raise QueryError(f"no label {':'.join(labels)}")
        v = n.var
        frames = []
        for t in tables:
            d = t.df
            if t.generic:
                for x in labels:
                    d = d.filter(reduce(lambda a, b: a | b, [F.array_contains("_labels", y) for y in x.split("|")]))
                cols = [F.col(t.id).alias(f"{v}__id"), *[F.col(c).alias(f"{v}__{c}") for c in d.columns if c != t.id]]
            else:
                cols = [F.col(t.id).alias(f"{v}__id"), *[F.col(c).alias(f"{v}__{c}") for c in d.columns if c != "id"]]
                if len(tables) > 1:
                    cols = [cols[0].cast("string").alias(f"{v}__id"), *cols[1:], F.lit(t.label).alias(f"{v}___label")]
            frames.append(d.select(*cols))
        df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
        props = [c[len(v) + 2 :] for c in df.columns if c != f"{v}__id"]
        self.scope[v] = Binding("node", props, None if tables[0].generic else {t.label for t in tables}, generic=tables[0].generic)
        return df

    def inline(self, df: DataFrame, v: str, props: dict) -> DataFrame:
        if not props:
            return df
        self.df = df
        for k, e in props.items():
            self.df = self.df.filter(self.binary(("bin", "=", ("prop", ("var", v), k), e), {}))
        return self.df

    def join(self, other: DataFrame, on: Column | None) -> None:
        if self.df is None:
            self.df = other if on is None else other.filter(on)
            self.product = (self.df, [self.df], [])
        elif on is None:
            known = self.factors()
            self.df = self.df.crossJoin(other)
            self.product = known and (self.df, [*known[0], other], known[1])
        else:
            self.df = self.df.join(other, on)

    def factors(self) -> tuple[list[DataFrame], list[Column]] | None:
        """The tables whose product the rows are, and the conditions on it; None if they aren't just that."""
        return self.product[1:] if self.product and self.product[0] is self.df else None

    def filter_product(self, c, cond: Column) -> None:
        """Filters the rows. A condition on one table of a product is that table's; of others only comparisons, which leave most rows, are kept apart."""
        known = self.factors()
        self.df = self.rows().filter(cond)
        self.product = None
        if known and "rand" not in str(c):
            tables, conds = known
            own = {i for v in variables(c) for i, t in enumerate(tables) if f"{v}__id" in t.columns}
            if len(own) == 1:
                self.product = (self.df, [t.filter(cond) if i in own else t for i, t in enumerate(tables)], conds)
            elif c[0] == "bin" and c[1] in ("<>", "<", "<=", ">", ">="):
                self.product = (self.df, tables, [*conds, cond])

    def match_path(self, p: PathPat, used_rels: list[str]) -> None:
        if p.shortest:
            self.shortest(p)
            return
        first: NodePat = p.items[0]
        flip = False
        if first.var not in self.scope and len(p.items) > 1 and p.items[-1].var in self.scope:
            flip = True  # begin at the end that is known
        items = list(reversed(p.items)) if flip else p.items
        first = items[0]
        if first.var in self.scope:
            if not self.scope[first.var].stub and first.props:
                self.df = self.inline(self.rows(), first.var, first.props)
            if first.labels and not self.scope[first.var].stub:
                self.df = self.rows().filter(self.has_labels(first.var, first.labels))
        else:
            self.join(self.inline_scan(self.narrowed(first, items, flip)), None)
            self.flush()
        prev = first
        for r, n in zip(items[1::2], items[2::2], strict=True):
            d = {"out": "in", "in": "out", "both": "both"}[r.direction] if flip else r.direction
            if r.hops:
                self.var_length(prev, r, n, d)
            else:
                self.hop(prev, r, n, d, used_rels)
            self.flush()
            prev = n
        if p.var:
            nodes = [x.var for x in p.items[::2]]
            singles = [x for x in p.items[1::2]]
            if any(r.hops for r in singles):
                r = singles[0]
                self.df = self.df.withColumn(p.var, F.struct(q(f"{r.var}__nodes").alias("nodes"), q(r.var).alias("rels")))
            else:
                self.df = self.df.withColumn(
                    p.var,
                    F.struct(F.array(*[q(f"{x}__id").cast("string") for x in nodes]).alias("nodes"), F.array(*[q(f"{r.var}__type") for r in singles]).alias("rels")),
                )
            self.scope[p.var] = Binding("path")

    def narrowed(self, n: NodePat, items: list, flip: bool) -> NodePat:
        """A node without a label takes those that the relationship beside it allows."""
        if n.labels or len(items) == 1 or self.graph.generic or items[1].hops:
            return n
        r = items[1]
        d = {"out": "in", "in": "out", "both": "both"}[r.direction] if flip else r.direction
        far = {y for x in items[2].labels for y in x.split("|")} or None
        ok = {t.src_label for t in self.graph.between(r.types, None, far) if d != "in"} | {t.dst_label for t in self.graph.between(r.types, far, None) if d != "out"}
        return NodePat(n.var, ["|".join(sorted(ok))] if ok else [], n.props)

    def inline_scan(self, n: NodePat) -> DataFrame:
        """The nodes of a pattern; conditions that name other variables wait until the rows are joined."""
        kept = self.df
        d = self.scan(n)
        d = self.inline(d, n.var, {k: e for k, e in n.props.items() if not variables(e)})
        self.waiting += [(n.var, k, e) for k, e in n.props.items() if variables(e)]
        self.df = kept
        return d

    def flush(self) -> None:
        for v, k, e in self.waiting:
            self.df = self.df.filter(self.binary(("bin", "=", ("prop", ("var", v), k), e), {}))
        self.waiting = []

    def rel_frames(self, prev: NodePat, r: RelPat, n: NodePat, direction: str) -> list[tuple[RelTable, bool]]:
        a, b = self.scope[prev.var].labels, self.scope[n.var].labels if n.var in self.scope else None
        if b is None and n.labels and not self.graph.generic:
            b = {y for x in n.labels for y in x.split("|")}
        out = []
        if direction in ("out", "both"):
            out += [(t, False) for t in self.graph.between(r.types, a, b)]
        if direction in ("in", "both"):
            out += [(t, True) for t in self.graph.between(r.types, b, a)]
        return out

    def hop(self, prev: NodePat, r: RelPat, n: NodePat, direction: str, used: list[str]) -> None:
        frames = self.rel_frames(prev, r, n, direction)
        if not frames:
            raise QueryError(f"no relationship {'|'.join(r.types)} between these nodes")
        known = n.var in self.scope
        pv, nv, rv = prev.var, n.var, r.var
        stub = self.scope[pv].stub and self.df is None
        ends = {(t.dst_label if not back else t.src_label) for t, back in frames}
        start_labels = {(t.src_label if not back else t.dst_label) for t, back in frames}
        one = len(frames) == 1 and not known and frames[0][0].type is not None and "_label" not in self.scope[pv].props
        t0, back0 = frames[0]
        far_owner = "src" if back0 else "dst"
        if one and t0.owner == far_owner and not r.props:
            # The far node's own table holds the key: one join gives hop and node.
            d = self.inline_scan(NodePat(nv, n.labels or [t0.src_label if back0 else t0.dst_label], n.props))
            near = t0.dst if back0 else t0.src
            key = q(f"{nv}__{near}")
            d = d.withColumn(f"{rv}__rid", q(f"{nv}__id").cast("string")).withColumn(f"{rv}__type", F.lit(t0.type))
            d = d.withColumn(f"{rv}__src", q(f"{nv}__id") if back0 else key).withColumn(f"{rv}__dst", key if back0 else q(f"{nv}__id"))
            self.scope[rv] = Binding("rel", [], types={t0.type}, ends=(pv, nv))
            if stub:
                self.df = d.withColumn(f"{pv}__id", key).filter(key.isNotNull())
            else:
                self.join(d, q(f"{pv}__id") == key)
            return
        near_owner = "dst" if back0 else "src"
        if one and t0.owner == near_owner and not r.props and not self.scope[pv].stub and (t0.dst if not back0 else t0.src) in self.scope[pv].props:
            # The near node's own table holds the key: it is a column already.
            key = q(f"{pv}__{t0.dst if not back0 else t0.src}")
            d = self.inline_scan(NodePat(nv, n.labels or [t0.dst_label if not back0 else t0.src_label], n.props))
            self.join(d, key == q(f"{nv}__id"))
            self.df = self.df.withColumn(f"{rv}__rid", q(f"{pv}__id").cast("string")).withColumn(f"{rv}__type", F.lit(t0.type))
            self.df = self.df.withColumn(f"{rv}__src", key if back0 else q(f"{pv}__id")).withColumn(f"{rv}__dst", q(f"{pv}__id") if back0 else key)
            self.scope[rv] = Binding("rel", [], types={t0.type}, ends=(pv, nv))
            return
        parts = []
        for t, back in frames:
            d = t.df
            if t.type is None and r.types:
                d = d.filter(F.col("_type").isin(r.types))
            a, b = (t.dst, t.src) if back else (t.src, t.dst)
            rid = F.concat_ws("|", *[F.col(c).cast("string") for c in t.id]) if t.id else F.concat_ws("|", F.col(t.src).cast("string"), F.col(t.dst).cast("string"))
            multi = len(start_labels) > 1 or len(ends) > 1
            fit = (lambda c: c.cast("string")) if multi and not self.graph.generic else (lambda c: c)
            cols = [
                fit(F.col(a)).alias("_near"),
                fit(F.col(b)).alias("_far"),
                (F.concat(F.lit(f"{t.type}|"), rid) if t.type else rid).alias(f"{rv}__rid"),
                F.col(t.src).alias(f"{rv}__src"),
                F.col(t.dst).alias(f"{rv}__dst"),
                (F.col("_type") if t.type is None else F.lit(t.type)).alias(f"{rv}__type"),
                *[F.col(c).alias(f"{rv}__{c}") for c in t.props],
                *([F.col("_props").alias(f"{rv}___props")] if t.type is None else []),
                F.lit(t.dst_label if back else t.src_label).alias("_near_label"),
                F.lit(t.src_label if back else t.dst_label).alias("_far_label"),
            ]
            parts.append(d.select(*cols).filter(F.col("_near").isNotNull() & F.col("_far").isNotNull()))
        e = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
        props = [c[len(rv) + 2 :] for c in e.columns if c.startswith(f"{rv}__") and c[len(rv) + 2 :] not in ("rid", "src", "dst", "type")]
        again = rv in self.scope
        self.scope[rv] = Binding("rel", props, types=set(r.types) or None, generic=self.graph.generic, ends=(pv, nv))
        e = self.inline_rel(e, rv, r.props)
        if stub:
            self.df = e.withColumn(f"{pv}__id", F.col("_near"))
        elif again:
            raise QueryError("a relationship variable is bound twice")
        else:
            self.join(e, self.same_label(pv, "_near", q(f"{pv}__id") == F.col("_near")))
        if known:
            if self.scope[nv].stub and f"{nv}__id" not in self.df.columns:
                self.df = self.df.withColumn(f"{nv}__id", F.col("_far"))
            else:
                self.df = self.df.filter(self.same_label(nv, "_far", q(f"{nv}__id") == F.col("_far")))
            if not self.scope[nv].stub and (n.props or n.labels):
                self.df = self.inline(self.df, nv, n.props)
                if n.labels:
                    self.df = self.df.filter(self.has_labels(nv, n.labels))
        else:
            d = self.inline_scan(NodePat(nv, n.labels or ([] if self.graph.generic else sorted({x for x in ends if x})[:1] if len(ends) == 1 else ["|".join(sorted(x for x in ends if x))]), n.props))
            self.join(d, self.same_label(nv, "_far", F.col("_far") == q(f"{nv}__id")))
        self.df = self.df.drop("_near", "_far", "_near_label", "_far_label")
        # A relationship is used once in a MATCH. Its ends are compared first: identities are made only where they are equal.
        for o in used:
            ta, tb = self.scope[o].types, self.scope[rv].types
            if ta is None or tb is None or ta & tb:
                self.df = self.df.filter((q(f"{o}__src") != q(f"{rv}__src")) | (q(f"{o}__dst") != q(f"{rv}__dst")) | (q(f"{o}__rid") != q(f"{rv}__rid")))
        used.append(rv)

    def same_label(self, v: str, end: str, on: Column) -> Column:
        """Ids of different labels may be equal: a variable of several labels is matched by label too."""
        return on & (q(f"{v}___label") == F.col(f"{end}_label")) if "_label" in self.scope[v].props else on

    def inline_rel(self, e: DataFrame, rv: str, props: dict) -> DataFrame:
        kept = self.df
        e = self.inline(e, rv, props)
        self.df = kept
        return e

    def edge_list(self, r: RelPat, direction: str, labels: set[str] | None) -> DataFrame:
        """``_a, _b, _r``: the steps of a path of several hops, with the relationship's identity."""
        parts = []
        for t in self.graph.between(r.types, labels, labels):
            d = t.df.filter(F.col("_type").isin(r.types)) if t.type is None and r.types else t.df
            rid = F.concat_ws("|", *[F.col(c).cast("string") for c in (t.id or (t.src, t.dst))])
            one = d.select(F.col(t.src).alias("_a"), F.col(t.dst).alias("_b"), (F.concat(F.lit(f"{t.type}|"), rid) if t.type else rid).alias("_r"))
            one = one.filter(F.col("_a").isNotNull() & F.col("_b").isNotNull())
            back = one.select(F.col("_b").alias("_a"), F.col("_a").alias("_b"), "_r")
            parts += {"out": [one], "in": [back], "both": [one, back.filter("_a <> _b")]}[direction]
        if not parts:
            raise QueryError(f"no relationship {'|'.join(r.types)} that can be followed repeatedly")
        return reduce(lambda x, y: x.unionByName(y), parts)

    def var_length(self, prev: NodePat, r: RelPat, n: NodePat, direction: str) -> None:
        """Paths of a range of lengths, each relationship used once a path.

        The first hops are chained joins in one plan. Beyond them each round is written and read again, so
        that a round's plan is one join whatever the length, and the loop ends when no path goes on. A range
        without an upper end that still goes on after ``OPEN_END_HOPS`` hops is an error, not a shorter result.
        """
        lo, hi = r.hops
        pv, nv = prev.var, n.var
        labels = self.scope[pv].labels
        e = self.edge_list(r, direction, labels)
        starts = self.rows().select(q(f"{pv}__id").alias("_s")).distinct()
        front = starts.select("_s", F.col("_s").alias("_e"), F.array(F.col("_s").cast("string")).alias("_n"), F.array().cast("array<string>").alias("_p"))
        found = [front] if lo == 0 else []
        none = front.filter(F.lit(False))
        last = OPEN_END_HOPS if hi is None else hi
        if last > CHAINED_HOPS:
            e = cut(e)
        for k in range(1, last + 1):
            front = front.join(e, F.col("_e") == F.col("_a")).filter(~F.array_contains("_p", F.col("_r")))
            front = front.select("_s", F.col("_b").alias("_e"), F.array_append("_n", F.col("_b").cast("string")).alias("_n"), F.array_append("_p", F.col("_r")).alias("_p"))
            if last > CHAINED_HOPS and k >= CHAINED_HOPS:
                front = cut(front)
                if not front.take(1):
                    break
            if k >= lo:
                found.append(front)
        else:
            if hi is None and front.join(e, F.col("_e") == F.col("_a")).filter(~F.array_contains("_p", F.col("_r"))).take(1):
                raise QueryError(f"paths go on after {OPEN_END_HOPS} hops; give the range an upper end")
        paths = reduce(lambda x, y: x.unionByName(y), found or [none]).select("_s", "_e", F.col("_n").alias(f"{r.var}__nodes"), F.col("_p").alias(r.var))
        self.df = self.rows().join(paths, q(f"{pv}__id") == F.col("_s"))
        self.scope[r.var] = Binding("rels")
        self.bind_end(n, labels)

    def bind_end(self, n: NodePat, labels: set[str] | None) -> None:
        nv = n.var
        if nv in self.scope:
            self.df = self.df.filter(q(f"{nv}__id") == F.col("_e"))
        else:
            d = self.inline_scan(NodePat(nv, n.labels or ([] if self.graph.generic else ["|".join(sorted(labels or []))]), n.props))
            self.df = self.df.join(d, F.col("_e") == q(f"{nv}__id"))
        self.df = self.df.drop("_s", "_e")

    def shortest(self, p: PathPat) -> None:
        """All shortest paths by a frontier that keeps, per start, the nodes first reached in each round.

        Every round is written and read again: its plan is one join and one anti-join, whatever the length.
        A start leaves the frontier when all ends asked of it are met; the loop ends when the frontier is
        empty. A range without an upper end is searched until then. Where ends aren't bound to each other and
        only lengths and counts are asked, neither pairs nor nodes of paths are kept (``measured``).
        """
        a, r, b = p.items
        every = p.shortest == "allShortestPaths"
        hi = r.hops[1] if r.hops else 1
        for n in (a, b):
            if n.var not in self.scope:
                self.join(self.inline_scan(n), None)
                self.flush()
        labels = self.scope[a.var].labels
        e = cut(self.edge_list(r, r.direction, labels))
        if self.measured(p, e, hi, every):
            return
        pairs = cut(self.df.select(q(f"{a.var}__id").alias("_s"), q(f"{b.var}__id").alias("_t")).distinct())
        front = pairs.select("_s").distinct().select("_s", F.col("_s").alias("_e"), F.array(F.col("_s").cast("string")).alias("_n"), F.array().cast("array<string>").alias("_p"))
        seen, levels, due, k = front.select("_s", "_e"), [], pairs, 0
        while hi is None or k < hi:
            k += 1
            step = front.join(e, F.col("_e") == F.col("_a")).select("_s", F.col("_b").alias("_e"), F.array_append("_n", F.col("_b").cast("string")).alias("_n"), F.array_append("_p", F.col("_r")).alias("_p"))
            step = step.join(seen, ["_s", "_e"], "left_anti")
            if not every:
                step = step.groupBy("_s", "_e").agg(F.min(F.struct("_n", "_p")).alias("_x")).select("_s", "_e", "_x.*")
            step = cut(step)
            if not step.take(1):
                break
            met = step.select("_s", F.col("_e").alias("_t")).distinct()
            levels.append(step.join(due.withColumnRenamed("_t", "_e"), ["_s", "_e"], "left_semi"))
            due = cut(due.join(met, ["_s", "_t"], "left_anti"))
            seen = seen.union(met.withColumnRenamed("_t", "_e"))
            front = step.join(due.select("_s").distinct(), "_s", "left_semi")
        paths = reduce(lambda x, y: x.unionByName(y), levels) if levels else front.filter(F.lit(False))
        v = p.var or self.tmp("path")
        paths = paths.select("_s", "_e", F.struct(F.col("_n").alias("nodes"), F.col("_p").alias("rels")).alias(v))
        self.df = self.df.join(paths, (q(f"{a.var}__id") == F.col("_s")) & (q(f"{b.var}__id") == F.col("_e"))).drop("_s", "_e")
        self.scope[v] = Binding("path")

    def measured(self, p: PathPat, e: DataFrame, hi: int | None, every: bool) -> bool:
        """Shortest paths between the nodes of two tables of a product, of which the query asks only lengths and counts.

        The product isn't made: paths are found from the nodes of one table to those of the other, and the
        conditions on pairs come after. False if the query isn't of this kind.
        """
        known, a, b = self.factors(), f"{p.items[0].var}__id", f"{p.items[2].var}__id"
        if known is None or a == b or not only_measured(self.part, p.var):
            return False
        tables, conds = known
        (i,), (j,) = ([k for k, t in enumerate(tables) if x in t.columns] for x in (a, b))
        kinds = {t.schema[x].dataType for t, x in ((tables[i], a), (tables[j], b), (e, "_a"), (e, "_b"))}
        if i == j or len(kinds) > 1:
            return False
        found = fewest_hops(e.select(F.col("_a").alias("src"), F.col("_b").alias("dst")), tables[i].select(F.col(a).alias("id")), tables[j].select(F.col(b).alias("id")), hi, every)
        if found is None:
            return False
        hops, ids = found
        own = lambda t, x, n: t.join(ids.select(F.col("id").alias(f"_i{n}"), F.col("k").alias(n)), q(x) == F.col(f"_i{n}")).drop(f"_i{n}")
        # The rows found aren't known in advance, so they may not be broadcast by estimate.
        df = hops.join(own(tables[i], a, "_s").hint("merge"), "_s").join(own(tables[j], b, "_e").hint("merge"), "_e")
        for k, t in enumerate(tables):
            df = df if k in (i, j) else df.crossJoin(t)
        for c in conds:
            df = df.filter(c)
        v, gap = p.var or self.tmp("path"), F.lit(None).cast("string")
        self.df = df.withColumn(v, F.struct(F.array_repeat(gap, F.col("_hops") + 1).alias("nodes"), F.array_repeat(gap, F.col("_hops")).alias("rels"))).drop("_s", "_e", "_hops")
        self.scope[v] = Binding("path")
        return True

    # ---------- clauses
    def where(self, e) -> None:
        """Filters; EXISTS and NOT EXISTS among the conjuncts become semi and anti joins."""
        for c in conjuncts(e):
            neg = c[0] == "un" and c[1] == "not" and c[2][0] == "exists"
            if c[0] == "exists" or neg:
                shared, inner, keys = self.correlated(c[2][1] if neg else c[1])
                on = reduce(lambda x, y: x & y, [q(s) == F.col(k) for s, k in zip(shared, keys, strict=True)]) if keys else F.lit(True)
                self.df = self.rows().join(inner.select(*keys).distinct() if keys else inner, on, "left_anti" if neg else "left_semi")
            else:
                cond = self.expr(c)
                self.filter_product(c, cond)

    def clause(self, c: Clause) -> None:
        getattr(self, f"do_{c.kind}")(c.data)

    def do_match(self, d: dict) -> None:
        if d["optional"]:
            self.optional(d)
            return
        used: list[str] = []
        for p in d["paths"]:
            self.match_path(p, used)
        if d["where"] is not None:
            self.where(d["where"])

    def optional(self, d: dict) -> None:
        before = set(self.scope)
        shared = [v for v in before if v in variables([d["paths"]])]
        sub = Lowering(self.graph, self.spark, self.params)
        sub.counter = self.counter + 5000
        outer_only = (variables(d["where"]) & before) - set(shared) if d["where"] is not None else set()
        stub = self.stub_ok({"parts": [[Clause("match", d)]]}, shared) and not self.props_used({"parts": [[Clause("match", d)]]}, shared) if shared else False
        if stub:
            for v in shared:
                sub.scope[v] = Binding("node", [], self.scope[v].labels, generic=self.scope[v].generic, stub=True)
        elif shared:
            sub.df = self.rows().select(*[q(c) for v in shared for c in self.columns(v)]).distinct()
            sub.scope = {v: self.scope[v] for v in shared}
        used: list[str] = []
        for p in d["paths"]:
            sub.match_path(p, used)
        late = []
        for c in conjuncts(d["where"]):
            if variables(c) & outer_only:
                late.append(c)
            else:
                sub.where(c)
        new = [v for v in sub.scope if v not in before]
        keys = [(f"{v}__id" if self.scope[v].kind == "node" else f"{v}__rid" if self.scope[v].kind == "rel" else v, self.tmp("o")) for v in shared]
        gone = {x for v in shared for x in self.columns(v)}
        inner = sub.rows().select(*[q(s).alias(k) for s, k in keys], *[q(c) for c in sub.rows().columns if c not in gone and c != "_unit" and c not in {s for s, _ in keys}])
        for v in new:
            self.scope[v] = sub.scope[v]
        on = [q(s) == F.col(k) for s, k in keys]
        for c in late:
            on.append(self.expr(c))
        cond = reduce(lambda x, y: x & y, on) if on else F.lit(True)
        self.df = self.rows().join(inner, cond, "left").drop(*[k for _, k in keys])

    def do_unwind(self, d: dict) -> None:
        c = self.expr(d["expr"])
        self.df = self.rows().withColumn(d["var"], F.explode(c))
        self.scope[d["var"]] = Binding("value")

    def project(self, it: Items, final: bool) -> None:
        items = list(it.items)
        if it.star:
            items = [(("var", v), v) for v in self.scope if not v.startswith("_anon")] + items
        agg = [has_aggregate(e) for e, _ in items]
        new: Scope = {}
        keep: dict[str, Column] = {}

        def bound(e, alias):
            """A variable that only passes on keeps its columns in WITH."""
            return e[0] == "var" and e[1] in self.scope and self.scope[e[1]].kind in ("node", "rel", "path", "rels") and not final

        keys: list[Column] = []
        outs: list[tuple[str, Column, bool]] = []
        for (e, alias), a in zip(items, agg, strict=True):
            if bound(e, alias) and self.scope[e[1]].kind in ("node", "rel"):
                v = e[1]
                new[alias] = self.scope[v]
                for c in self.columns(v):
                    keep[alias + c[len(v) :]] = q(c)
                    keys.append(q(c).alias(alias + c[len(v) :]))
                continue
            x = self.expr(e)
            new[alias] = self.scope[e[1]] if bound(e, alias) else Binding("value")
            outs.append((alias, x, a))
        order = []
        if any(agg):
            plain = [x.alias(n) for n, x, a in outs if not a]
            aggs = [x.alias(n) for n, x, a in outs if a]
            names = [n for n, _, _ in outs]
            for e, up in it.order:
                if e[0] == "var" and e[1] in names:
                    order.append((e[1], up))
                else:
                    same = next((n for (ie, n) in items if ie == e), None)
                    h = same or self.tmp("s")
                    if same is None and not has_aggregate(e):
                        raise QueryError("ORDER BY after aggregation must use a returned item or an aggregate")
                    if same is None:
                        aggs.append(self.expr(e).alias(h))
                    order.append((h, up))
            g = self.rows()
            self.df = g.groupBy(*keys, *plain).agg(*aggs) if keys or plain else g.agg(*aggs)
            all_names = [*keep, *names]
        else:
            hidden = []
            names = [n for n, _, _ in outs]
            for e, up in it.order:
                same = e[1] if e[0] == "var" and e[1] in names else next((n for (ie, n) in items if ie == e and n in names), None)
                if same:
                    order.append((same, up))
                else:
                    h = self.tmp("s")
                    hidden.append((h, e))
                    order.append((h, up))
            cols = [c.alias(n) for n, c in keep.items()] + [x.alias(n) for n, x, _ in outs]
            late = []
            for h, e in hidden:
                if variables(e) & set(names) - set(self.scope):
                    late.append((h, e))  # a key made of new names
                elif not it.distinct:
                    cols.append(self.expr(e).alias(h))
            self.df = self.rows().select(*cols)
            if late:
                old, self.scope = self.scope, {**self.scope, **new}
                for h, e in late:
                    self.df = self.df.withColumn(h, self.expr(e))
                self.scope = old
            all_names = [*keep, *names]
        if it.distinct:
            self.df = self.df.select(*[q(n) for n in [*all_names, *[h for h, _ in order if h not in all_names]]]).distinct()
        if order:
            self.df = self.df.orderBy(*[q(n).asc_nulls_last() if up else q(n).desc_nulls_first() for n, up in order if n in self.df.columns])
        if it.skip is not None:
            self.df = self.df.offset(int(self.constant(it.skip)))
        if it.limit is not None:
            self.df = self.df.limit(int(self.constant(it.limit)))
        self.df = self.df.select(*[q(n) for n in all_names])
        self.scope = new

    def constant(self, e):
        if e[0] == "lit":
            return e[1]
        if e[0] == "param":
            return self.params[e[1]]
        raise QueryError("SKIP and LIMIT take a number or a parameter")

    def do_with(self, d: dict) -> None:
        self.project(d["items"], False)
        if d["items"].where is not None:
            self.where(d["items"].where)

    def do_return(self, d: dict) -> None:
        self.project(d["items"], True)

    def do_return_sub(self, d: dict) -> None:
        """RETURN inside EXISTS, COUNT, COLLECT: keeps the shared columns beside the one value."""
        it: Items = d["items"]
        x = self.expr(it.items[0][0])
        self.df = self.rows().withColumn("_out_value", x)
        if it.distinct:
            self.df = self.df.dropDuplicates([c for e, _ in d["keep"] if e[1] in self.scope for c in self.columns(e[1])[:1]] + ["_out_value"])

    def do_subquery(self, d: dict) -> None:
        """CALL { }: without outer variables a view that is joined; with them a join on the distinct outer rows."""
        query = d["query"]
        first = query["parts"][0][0]
        if first.kind == "with" and all(e[0] == "var" for e, _ in first.data["items"].items):
            shared = [e[1] for e, _ in first.data["items"].items]
            frames, scope = [], {}
            for part in query["parts"]:
                sub = Lowering(self.graph, self.spark, self.params)
                sub.counter = self.counter + 9000
                sub.df = self.rows().select(*[q(c) for v in shared for c in self.columns(v)]).distinct()
                sub.scope = {v: self.scope[v] for v in shared}
                for c in part[1:]:
                    if c.kind == "return":
                        it = c.data["items"]
                        if it.limit is not None or it.order:
                            raise QueryError("a correlated CALL takes no ORDER BY or LIMIT of its own")
                        items = Items([(("var", v), v) for v in shared] + it.items, distinct=it.distinct)
                        sub.project(items, False)
                    else:
                        sub.clause(c)
                frames.append(sub.df)
                scope = sub.scope
            inner = reduce(lambda x, y: x.unionByName(y), frames)
            ids = [self.columns(v)[0] for v in shared]
            extra = [c for c in inner.columns if c not in {x for v in shared for x in self.columns(v)}]
            keys = [self.tmp("c") for _ in ids]
            inner = inner.select(*[q(i).alias(k) for i, k in zip(ids, keys, strict=True)], *[q(c) for c in extra])
            on = reduce(lambda x, y: x & y, [q(i).eqNullSafe(F.col(k)) for i, k in zip(ids, keys, strict=True)])
            self.df = self.rows().join(inner, on).drop(*keys)
            self.scope.update({v: b for v, b in scope.items() if v not in shared})
            return
        inner = run_tree(self.graph, self.spark, query, self.params)
        self.scope.update({c: Binding("value") for c in inner.columns})
        self.df = inner if self.df is None else self.df.crossJoin(inner)

    def do_call(self, d: dict) -> None:
        from loomgraph.plans import change_library, graph_library, procedures

        _ = graph_library, change_library  # register their procedures

        if d["args"] and variables(d["args"]):
            self.call_bound(d, procedures)
            return
        args = [self.constant_value(a) for a in d["args"]]
        out = procedures.call(self.graph, self.spark, d["proc"], args, self.params)
        names = d["yield"] or [(c, c) for c in out.columns]
        missing = [n for n, _ in names if n not in out.columns]
        if missing:
            raise QueryError(f"{d['proc']} has no column {missing[0]}")
        out = out.select(*[q(n).alias(a) for n, a in names])
        self.df = out if self.df is None else self.df.crossJoin(out)
        self.scope.update({a: Binding("value") for _, a in names})
        if d["where"] is not None:
            self.where(d["where"])

    def call_bound(self, d: dict, procedures) -> None:
        """A procedure whose first argument is a value of the rows: it runs once over the distinct values, and its rows are joined to them."""
        first, rest = d["args"][0], d["args"][1:]
        f = procedures.BOUND.get(d["proc"].lower())
        if f is None or variables(rest):
            raise QueryError(f"{d['proc']} takes a variable as its first argument only" if f else f"{d['proc']} takes constants and parameters only")
        node = first[0] == "var" and first[1] in self.scope and self.scope[first[1]].kind == "node"
        start, key = self.tmp("p"), self.tmp("k")
        value = self.expr(first) if not node else q(f"{first[1]}__id")
        if node and not self.graph.generic:
            label = q(f"{first[1]}___label") if "_label" in self.scope[first[1]].props else F.lit(next(iter(self.scope[first[1]].labels or {""})))
            value = F.concat(label, F.lit(":"), value.cast("string"))
        self.df = self.rows().withColumn(start, value)
        text = dict(self.df.dtypes)[start].startswith("array")
        starts = self.df.select((q(start) if text else q(start).cast("string")).alias("s")).filter("s is not null").distinct()
        out = f(self.graph, self.spark, starts, *[self.constant_value(a) for a in rest])
        names = d["yield"] or [(c, c) for c in out.columns if c != "s"]
        missing = [n for n, _ in names if n not in out.columns]
        if missing:
            raise QueryError(f"{d['proc']} has no column {missing[0]}")
        out = out.select((F.col("s") if text else F.col("s").cast("string")).alias(key), *[q(n).alias(a) for n, a in names])
        self.df = self.df.join(out, (q(start) if text else q(start).cast("string")) == F.col(key)).drop(start, key)
        self.scope.update({a: Binding("value") for _, a in names})
        if d["where"] is not None:
            self.where(d["where"])

    def constant_value(self, e):
        if e[0] == "lit":
            return e[1]
        if e[0] == "param":
            return self.params[e[1]]
        if e[0] == "list":
            return [self.constant_value(x) for x in e[1]]
        if e[0] == "map":
            return {k: self.constant_value(v) for k, v in e[1]}
        if e[0] == "un" and e[1] == "-":
            return -self.constant_value(e[2])
        raise QueryError("a procedure's arguments are constants or parameters")

    def do_loadcsv(self, d: dict) -> None:
        src = self.spark.read.option("header", d["headers"]).csv(self.constant_value(d["url"]))
        row = F.struct(*[F.col(f"`{c}`") for c in src.columns]) if d["headers"] else F.array(*[F.col(c) for c in src.columns])
        self.join(src.select(row.alias(d["var"])), None)
        self.scope[d["var"]] = Binding("value")


def run_tree(graph: Graph, spark: SparkSession, tree: dict, params: dict[str, Any] | None) -> DataFrame:
    frames = []
    for part in tree["parts"]:
        low = Lowering(graph, spark, params)
        low.part = part
        for c in part:
            low.clause(c)
        out = low.rows()
        if part and part[-1].kind == "call":
            out = out.select(*[q(c) for c in low.scope])
        frames.append(out)
    df = frames[0]
    for f, kind in zip(frames[1:], tree["unions"], strict=True):
        if len(f.columns) != len(df.columns):
            raise QueryError("UNION needs the same number of columns")
        df = df.union(f)
        if kind == "distinct":
            df = df.distinct()
    return df


def run(graph: Graph, spark: SparkSession, text: str, params: dict[str, Any] | None = None) -> DataFrame:
    """The rows of a reading query. Queries with updates go through ``loomgraph.cypher.write``."""
    tree = parse(text)
    df = run_tree(graph, spark, tree, params)
    if tree["mode"]:
        plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        return spark.createDataFrame([(line,) for line in plan.split("\n")], "plan string")
    return df
