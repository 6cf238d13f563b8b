"""Commands on the catalog: indexes, constraints, databases, aliases, composites, and what is there.

The catalog is the caller's object; a command changes it and returns rows. Indexes change
no result: they name what full-text and vector procedures search. A constraint is checked
against the data when it is made.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from loomgraph.cypher.parser import QueryError
from loomgraph.cypher.write import check_exists, check_unique
from loomgraph.graph import Graph
from loomgraph.plans.procedures import PROCS
from loomgraph.sources.graph_files import union_graph


@dataclass
class Catalog:
    graphs: dict[str, Graph] = field(default_factory=dict)
    aliases: dict[str, str] = field(default_factory=dict)
    composites: dict[str, list[str]] = field(default_factory=dict)
    limits: dict[str, dict[str, str]] = field(default_factory=dict)
    current: str = ""

    def graph(self, name: str | None = None) -> Graph:
        name = name or self.current
        name = self.aliases.get(name, name)
        if name in self.composites:
            return union_graph([self.graph(n) for n in self.composites[name]], name)
        if name not in self.graphs:
            raise QueryError(f"no database {name}")
        return self.graphs[name]


def _done(spark: SparkSession, **c) -> DataFrame:
    return spark.createDataFrame([tuple(map(str, c.values()))], ", ".join(f"{k} string" for k in c))


def command(cat: Catalog, spark: SparkSession, text: str) -> DataFrame:
    """Runs one command; raises if it isn't one or the data breaks a new constraint."""
    t = re.sub(r"\s+", " ", text.strip().rstrip(";"))
    for rule, act in RULES:
        m = re.fullmatch(rule, t, re.I)
        if m:
            return act(cat, spark, m)
    raise QueryError(f"not a catalog command: {t[:60]}")


def _props(s: str) -> list[str]:
    return [p.split(".")[-1].strip(" `()") for p in s.split(",")]


def _index(cat, spark, m):
    g, kind = cat.graph(), (m["kind"] or "RANGE").strip().upper()
    label, props = m["label"].split("|"), _props(m["props"])
    name = m["name"] or f"index_{label[0]}_{'_'.join(props)}".lower()
    if name in g.indexes and not m["safe"]:
        raise QueryError(f"index {name} exists")
    opts = dict(re.findall(r"`?vector\.(\w+)`?\s*:\s*'?(\w+)'?", m["opts"] or ""))
    g.indexes[name] = {"type": kind, "labels": label, "properties": props, "dims": int(opts["dimensions"]) if "dimensions" in opts else None, "metric": opts.get("similarity_function", "cosine").lower()}
    return _done(spark, name=name, type=kind)


def _constraint(cat, spark, m):
    g, what, props = cat.graph(), re.sub(r"^IS ", "", m["what"].upper()), _props(m["props"])
    if what in ("UNIQUE", "NODE KEY") and len(props) == 1 and check_unique(g, m["label"], props[0]).take(1):
        raise QueryError(f"{m['label']}.{props[0]} isn't unique")
    if what in ("NOT NULL", "NODE KEY"):
        for p in props:
            if check_exists(g, m["label"], p).take(1):
                raise QueryError(f"{m['label']}.{p} is missing in some nodes")
    name = m["name"] or f"constraint_{m['label']}_{'_'.join(props)}".lower()
    g.constraints[name] = {"type": what, "labels": [m["label"]], "properties": props}
    return _done(spark, name=name, type=what)


def _drop(which):
    def f(cat, spark, m):
        gone = getattr(cat.graph(), which).pop(m["name"], None)
        if gone is None and not m["safe"]:
            raise QueryError(f"no such name: {m['name']}")
        return _done(spark, name=m["name"], dropped=gone is not None)

    return f


def _create_db(cat, spark, m):
    from loomgraph.operators.refactor import from_edges

    if m["name"] in cat.graphs and not m["safe"]:
        raise QueryError(f"database {m['name']} exists")
    cat.graphs.setdefault(m["name"], from_edges(spark.createDataFrame([], "a string, b string"), "a", "b"))
    return _done(spark, name=m["name"])


def _pop(which):
    def f(cat, spark, m):
        if getattr(cat, which).pop(m["name"], None) is None and not m["safe"]:
            raise QueryError(f"no such name: {m['name']}")
        return _done(spark, name=m["name"])

    return f


def _alias(cat, spark, m):
    cat.graph(m["target"])
    cat.aliases[m["name"]] = m["target"]
    return _done(spark, name=m["name"], target=m["target"])


def _composite(cat, spark, m):
    cat.composites[m["name"]] = [x.strip() for x in (m["parts"] or "").split(",") if x.strip()]
    return _done(spark, name=m["name"], constituents=len(cat.composites[m["name"]]))


def _alter_composite(cat, spark, m):
    own = cat.composites.setdefault(m["name"], [])
    own.append(m["part"]) if m["how"].upper() == "ADD" else own.remove(m["part"])
    return _done(spark, name=m["name"], constituents=len(own))


def _limit(cat, spark, m):
    cat.limits.setdefault(m["name"], {})[m["key"]] = m["value"]
    return _done(spark, name=m["name"], limit=m["key"], value=m["value"])


def _rows(spark, data, cols):
    return spark.createDataFrame(data, cols)


def _use(cat, spark, m):
    cat.graph(m["name"])
    cat.current = m["name"]
    return _done(spark, name=m["name"])


_SAFE, _N = r"(?P<safe> IF NOT EXISTS)?", r"(?P<name>[\w.]+)"
RULES = [
    (r"CREATE (?P<kind>RANGE |FULLTEXT |VECTOR |TEXT |POINT |LOOKUP )?INDEX(?: (?P<name>\w+))??" + _SAFE + r" FOR \(\w+:(?P<label>[\w|]+)\) ON (?:EACH )?[(\[](?P<props>[^)\]]+)[)\]](?P<opts> OPTIONS.*)?", _index),
    (r"CREATE CONSTRAINT(?: (?P<name>\w+))??" + _SAFE + r" FOR \(\w+:(?P<label>\w+)\) REQUIRE \(?(?P<props>[\w., ]+?)\)? (?P<what>IS UNIQUE|IS NOT NULL|IS NODE KEY)", _constraint),
    (r"DROP INDEX (?P<name>\w+)(?P<safe> IF EXISTS)?", _drop("indexes")),
    (r"DROP CONSTRAINT (?P<name>\w+)(?P<safe> IF EXISTS)?", _drop("constraints")),
    (r"SHOW (?:\w+ )?INDEX(?:ES)?", lambda c, s, m: PROCS["db.indexes"](c.graph(), s)),
    (r"SHOW (?:\w+ )?CONSTRAINTS?", lambda c, s, m: PROCS["db.constraints"](c.graph(), s)),
    (r"SHOW PROCEDURES", lambda c, s, m: PROCS["dbms.procedures"](c.graph(), s)),
    (r"SHOW FUNCTIONS", lambda c, s, m: PROCS["dbms.functions"](c.graph(), s)),
    (r"CREATE COMPOSITE DATABASE " + _N + _SAFE + r"(?: OF (?P<parts>[\w., ]+))?", _composite),
    (r"ALTER COMPOSITE DATABASE " + _N + r" (?P<how>ADD|DROP) (?:ALIAS |CONSTITUENT )?(?P<part>\w+)", _alter_composite),
    (r"DROP COMPOSITE DATABASE " + _N + r"(?P<safe> IF EXISTS)?", _pop("composites")),
    (r"SHOW COMPOSITE DATABASES", lambda c, s, m: _rows(s, [(n, p) for n, p in c.composites.items()], "name string, constituents array<string>")),
    (r"SHOW CONSTITUENTS(?: (?:FOR|OF))? " + _N, lambda c, s, m: _rows(s, [(p,) for p in c.composites[m["name"]]], "name string")),
    (r"CREATE DATABASE " + _N + _SAFE, _create_db),
    (r"DROP DATABASE " + _N + r"(?P<safe> IF EXISTS)?", _pop("graphs")),
    (r"ALTER DATABASE " + _N + r" SET LIMIT (?P<key>\w+) ?=? ?(?P<value>\w+)", _limit),
    (r"SHOW DATABASES", lambda c, s, m: _rows(s, [(n, n == c.current) for n in c.graphs], "name string, current boolean")),
    (r"SHOW DATABASE " + _N, lambda c, s, m: _rows(s, [(m["name"], m["name"] in c.graphs)], "name string, online boolean")),
    (r"CREATE ALIAS " + _N + _SAFE + r" FOR DATABASE (?P<target>\w+)", _alias),
    (r"DROP ALIAS " + _N + r"(?P<safe> IF EXISTS)?(?: FOR DATABASE)?", _pop("aliases")),
    (r"SHOW ALIASES", lambda c, s, m: _rows(s, list(c.aliases.items()), "name string, target string")),
    (r"SHOW LIMITS(?: FOR DATABASE)? " + _N, lambda c, s, m: _rows(s, list(c.limits.get(m["name"], {}).items()), "limit string, value string")),
    (r":?USE " + _N, _use),
]
