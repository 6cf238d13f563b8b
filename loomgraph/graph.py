"""Property graphs over DataFrames.

Two forms. In the typed form every label is a table and every relationship type is a
table, or a key column of the node table at one end; Catalyst then sees plain columns
and plain joins. In the generic form one table holds all nodes (labels, property map)
and one all relationships. Updates make a new graph and leave the old one as it was.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class NodeTable:
    """All nodes of one label (or, with label None, of all labels): ``id`` and property columns."""

    label: str | None
    df: DataFrame
    id: str

    @property
    def props(self) -> list[str]:
        return [c for c in self.df.columns if c not in ("_labels", "_props")]

    @property
    def generic(self) -> bool:
        return self.label is None


@dataclass(frozen=True)
class RelTable:
    """Relationships of one type between two labels. ``owner`` says that the table is the node table at that end."""

    type: str | None
    src_label: str | None
    dst_label: str | None
    df: DataFrame
    src: str
    dst: str
    id: tuple[str, ...] = ()
    owner: str | None = None  # 'src' or 'dst'
    hidden: tuple[str, ...] = ()

    @property
    def props(self) -> list[str]:
        return [] if self.owner else [c for c in self.df.columns if c not in ("_type", "_props", self.src, self.dst, *self.hidden)]


@dataclass
class Graph:
    nodes: list[NodeTable]
    rels: list[RelTable]
    name: str = "graph"
    indexes: dict[str, dict] = field(default_factory=dict)
    constraints: dict[str, dict] = field(default_factory=dict)

    @property
    def generic(self) -> bool:
        return any(n.generic for n in self.nodes)

    def tables(self, labels: Iterable[str] | None) -> list[NodeTable]:
        if self.generic or not labels:
            return self.nodes
        want = set(labels)
        return [n for n in self.nodes if n.label in want]

    def between(self, types: list[str], src: set[str] | None, dst: set[str] | None) -> list[RelTable]:
        ok = lambda t, x: t is None or x is None or t in x
        return [r for r in self.rels if (not types or r.type is None or r.type in types) and ok(r.src_label, src) and ok(r.dst_label, dst)]

    # -- the graph as two generic tables, for algorithms and procedures
    def all_nodes(self) -> DataFrame:
        """``id string, label string`` and the element's own key."""
        out = None
        for n in self.nodes:
            one = n.df.select(F.col(n.id).cast("string").alias("id"), (F.col("_labels")[0] if n.generic else F.lit(n.label)).alias("label"))
            out = one if out is None else out.unionByName(one)
        return out

    def mixed(self, types: list[str] | None = None, src: str | None = None, dst: str | None = None) -> bool:
        """Whether these relationships join several labels, whose ids may be equal."""
        return not self.generic and len({x for r in self.between(types or [], {src} if src else None, {dst} if dst else None) for x in (r.src_label, r.dst_label)}) > 1

    def edges(self, types: list[str] | None = None, src: str | None = None, dst: str | None = None) -> DataFrame:
        """``src, dst, type`` with the ids of the typed tables, or element ids in the generic form.

        Where several labels are involved an id is 'Label:id', since tables number their rows apart.
        """
        out, mixed = None, self.mixed(types, src, dst)
        end = lambda label, c: F.concat(F.lit(f"{label}:"), F.col(c).cast("string")) if mixed else F.col(c)  # noqa: E731  null for a null id
        for r in self.between(types or [], {src} if src else None, {dst} if dst else None):
            d = r.df.filter(F.col("_type").isin(types)) if r.type is None and types else r.df
            one = d.select(end(r.src_label, r.src).alias("src"), end(r.dst_label, r.dst).alias("dst"), (F.col("_type") if r.type is None else F.lit(r.type)).alias("type"))
            one = one.filter(F.col("src").isNotNull() & F.col("dst").isNotNull())
            out = one if out is None else out.unionByName(one)
        if out is None:
            raise ValueError("no relationships of that type")
        return out

    def keys(self, starts: DataFrame, types: list[str] | None = None) -> DataFrame:
        """``s, k``: for each start as given (text: an id, or 'Label:id') the nodes it means, by their ids in ``edges(types)``."""
        kind = dict(self.edges(types).dtypes)["src"]
        if self.generic:
            return starts.select("s", F.col("s").cast(kind).alias("k"))
        labels = [n.label for n in self.nodes]
        named = F.col("s").rlike("^(" + "|".join(labels) + "):")
        bare = F.when(named, F.regexp_replace("s", "^[^:]*:", "")).otherwise(F.col("s"))
        if not self.mixed(types):
            return starts.select("s", bare.cast(kind).alias("k"))
        known = None
        for n in self.nodes:
            one = n.df.select(F.concat(F.lit(f"{n.label}:"), F.col(n.id).cast("string")).alias("k"))
            known = one if known is None else known.union(one)
        each = F.when(named, F.array("s")).otherwise(F.array(*[F.concat(F.lit(f"{x}:"), F.col("s")) for x in labels]))
        return starts.select("s", F.explode(each).alias("k")).join(known, "k", "left_semi").select("s", "k")

    # -- new versions
    def with_nodes(self, label: str | None, change: Callable[[DataFrame], DataFrame]) -> Graph:
        return replace(self, nodes=[replace(n, df=change(n.df)) if n.label == label or n.generic else n for n in self.nodes])

    def with_rels(self, change: Callable[[RelTable], DataFrame]) -> Graph:
        return replace(self, rels=[replace(r, df=change(r)) for r in self.rels])


def generic_graph(nodes: DataFrame, rels: DataFrame, name: str = "graph") -> Graph:
    """From ``id string, labels array<string>, props map<string,string>, ...`` and ``id, src, dst, type, props, ...``."""
    n = nodes.withColumnRenamed("labels", "_labels").withColumnRenamed("props", "_props")
    r = rels.withColumnRenamed("type", "_type").withColumnRenamed("props", "_props")
    return Graph([NodeTable(None, n, "id")], [RelTable(None, None, None, r, "src", "dst", ("id",))], name)
