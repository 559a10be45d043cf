"""A set of predicates on nodes, composed by AND; each is a column expression that Catalyst can push down."""

from __future__ import annotations

from dataclasses import dataclass, fields
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.refs import reference_key
from quillgraph.functions.text import day_prefix
from quillgraph.operators.graph import closure


@dataclass(frozen=True)
class FilterSet:
    """Unset fields do not filter. ``as_of`` is the day that ages count from."""

    ids: tuple[str, ...] = ()
    parent: str | None = None
    subtree: str | None = None
    status: str | None = None
    doc_type: str | None = None
    assignee: str | None = None
    priority: int | None = None
    priority_gte: int | None = None
    tags: tuple[str, ...] = ()
    older_than_days: int | None = None
    stale_days: int | None = None
    project: tuple[str, ...] = ()
    include_untagged: bool = False
    orphan: bool = False
    title_contains: str | None = None
    weight_gte: float | None = None
    directory: str | None = None
    complexity: str | None = None
    #: Whether the rows have a column ``modified``; without it ages count from ``created``.
    has_modified: bool = False
    as_of: date | None = None

    @classmethod
    def from_dict(cls, raw: dict) -> FilterSet:
        names = {f.name for f in fields(cls)}
        unknown = set(raw) - names
        if unknown:
            raise ValueError(f"unknown filters: {sorted(unknown)}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in raw.items()})

    def is_empty(self) -> bool:
        return self.describe() == "everything"

    def describe(self) -> str:
        said = [f"{f.name}={getattr(self, f.name)}" for f in fields(self) if f.name not in ("as_of", "has_modified") and getattr(self, f.name) not in (None, (), False)]
        return ", ".join(said) or "everything"

    def _aged(self, day: Column, days: int) -> Column:
        """Missing and unreadable days count as old."""
        return F.coalesce(F.datediff(F.lit(self.as_of), day) >= days, F.lit(True))

    def _of_parent(self, nodes: DataFrame, keys: DataFrame | None) -> DataFrame:
        if keys is None:
            return nodes.filter(F.col("parent").eqNullSafe(F.lit(self.parent)))
        named = keys.filter(F.col("key") == reference_key(F.lit(self.parent))).select(F.col("id").alias("__id"))
        one = F.broadcast(named.agg(F.min("__id").alias("__p")))  # one row, null where nothing is named
        return nodes.join(one, F.col("parent").eqNullSafe(F.col("__p"))).drop("__p")

    def _of_project(self, nodes: DataFrame, projects: DataFrame) -> DataFrame:
        """Rows of the projects asked for, by slug or alias on either side."""
        known = projects.select(F.lower("slug").alias("slug"), F.explode(F.concat(F.array("slug"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name")).select("slug", F.lower("name").alias("__name")).distinct()
        asked = known.filter(F.col("__name").isin([p.lower() for p in self.project])).select("slug")
        names = known.join(asked, "slug", "left_semi").select("__name").distinct()
        plain = F.lower("project").isin([p.lower() for p in self.project])
        marked = nodes.join(F.broadcast(names.withColumn("__hit", F.lit(True))), F.lower("project") == F.col("__name"), "left")
        keep = F.col("__hit") | plain | (F.col("project").isNull() if self.include_untagged else F.lit(False))
        return marked.filter(keep).drop("__name", "__hit")

    def predicates(self, resolved: bool = False) -> list[Column]:
        c, out = F.col, []
        for name, column in (("status", "status"), ("doc_type", "node_type"), ("assignee", "assignee"), ("priority", "priority"), ("complexity", "complexity")):
            if getattr(self, name) is not None:
                out.append(c(column) == F.lit(getattr(self, name)))
        if self.priority_gte is not None:
            out.append(c("priority") >= self.priority_gte)
        if self.tags:
            out.append(F.size(F.array_except(F.array(*map(F.lit, self.tags)), c("tags"))) == 0)
        if self.older_than_days is not None:
            out.append(self._aged(day_prefix(c("created")), self.older_than_days))
        if self.stale_days is not None:
            out.append(self._aged(F.coalesce(day_prefix(c("modified")) if self.has_modified else F.lit(None).cast("date"), day_prefix(c("created"))), self.stale_days))
        if self.project and not resolved:
            hit = F.lower("project").isin([p.lower() for p in self.project])
            out.append(hit | c("project").isNull() if self.include_untagged else hit)
        if self.orphan:
            out.append(c("parent").isNull() & c("project").isNull())
        if self.title_contains is not None:
            out.append(F.lower("label").contains(self.title_contains.lower()))
        if self.weight_gte is not None:
            out.append(c("weight") >= self.weight_gte)
        if self.directory is not None:
            out.append(c("path").startswith(self.directory))
        return out

    def apply(self, nodes: DataFrame, children: DataFrame | None = None, keys: DataFrame | None = None, projects: DataFrame | None = None) -> DataFrame:
        """``children``: ``src`` parent, ``dst`` child, for ``subtree``; ``keys``: see ``model.resolution``.

        With ``keys`` the parent may be written loosely; one that names nothing finds nodes
        without a parent. With ``projects`` (``slug, aliases``) aliases count as their project.
        """
        if self.parent is not None:
            nodes = self._of_parent(nodes, keys)
        if self.project and projects is not None:
            nodes = self._of_project(nodes, projects)
        df = nodes.filter(c) if (c := reduce(lambda a, b: a & b, self.predicates(projects is not None), F.lit(True))) is not None else nodes
        if self.ids:
            df = df.filter(F.col("id").isin(list(self.ids)))
        if self.subtree is not None:
            if children is None:
                raise ValueError("subtree needs the children")
            top = nodes.filter(F.col("id") == self.subtree).select("id")
            inside = closure(children, top).select("id").unionByName(top)
            df = df.join(inside, "id", "left_semi")
        return df


def tagged(df: DataFrame, tags: list[str], every: bool = True) -> DataFrame:
    """Rows with all (or any) of the tags, whatever their case."""
    low = F.transform(F.coalesce("tags", F.array().cast("array<string>")), F.lower)
    hits = [F.array_contains(low, t.lower()) for t in tags]
    return df.filter(reduce(lambda a, b: a & b if every else a | b, hits)) if hits else df


def list_documents(df: DataFrame, tags: list[str] = (), doc_type: str | None = None, status: str | None = None) -> DataFrame:
    """Any of the tags, the type and the status, whatever their case, by title."""
    df = tagged(df, list(tags), every=False)
    if doc_type is not None:
        df = df.filter(F.lower("doc_type") == doc_type.lower())
    if status is not None:
        df = df.filter(F.lower("status") == status.lower())
    return df.orderBy("title", "id")
