"""Orphan references: rows that name keys which never existed, were deleted, or came later.

Parent and child keys are tagged and brought into one long form; one aggregation by parent
table and key (partial before the shuffle, so a key that a third of all rows name costs no
more than any other) says of each key whether it has a parent, from when and until when,
and which span of times it is referred to. Only keys that cannot be clean for the whole
span are looked up again by the rows, in a salted join. The references are read and their
keys made once, then kept as a table in the shared folder.

Defined results: null and blank references name nothing and are never reported; a
repeated element of a list or a repeated row is reported once; an empty table gives an
empty result; columns not named here are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.refs import reference_key, strip_blanks
from quillgraph.plans.skew import lookup_join
from quillgraph.session import stored

#: The tables that references may name share one space of keys; this is its name.
NOTES = "notes"


def holding_state(nodes: DataFrame) -> DataFrame:
    """One row per id: the state recorded last, with the earliest ``recorded_at`` of all.

    Ties on ``recorded_at`` go to the state not deleted, then to the largest of the remaining values.
    """
    state = F.struct("recorded_at", F.col("deleted_at").isNull().alias("live"), "deleted_at", "parent", "permalink")
    return (
        nodes.filter(F.col("id").isNotNull())
        .groupBy("id")
        .agg(F.max(state).alias("s"), F.min("recorded_at").alias("first_at"))
        .select("id", "first_at", "s.recorded_at", "s.deleted_at", "s.parent", "s.permalink")
    )


def node_keys(states: DataFrame) -> DataFrame:
    """``key, id``: every id and permalink, lower-cased; an id wins over a permalink, then the smallest id."""
    pairs = F.explode(F.array(F.struct(F.lower(strip_blanks(F.col("id"))).alias("key"), F.lit(0).alias("rank")), F.struct(F.lower(strip_blanks(F.col("permalink"))).alias("key"), F.lit(1).alias("rank"))))
    keep = [c for c in states.columns if c not in ("id", "permalink", "parent", "recorded_at")]
    return (
        states.select("*", pairs.alias("p"))
        .filter(F.col("p.key") != "")
        .groupBy("p.key")
        .agg(F.min(F.struct("p.rank", "id", *keep)).alias("b"))
        .select("key", "b.id", *[f"b.{c}" for c in keep])
    )


def written_references(df: DataFrame, tab: str, row_id: str, fields: list[str], when: str = "recorded_at", to: str = NOTES) -> DataFrame:
    """``tab, row_id, field, ref, at, to, key``: one row per reference written, ``to`` the parent table; list fields are exploded."""
    kinds = dict(df.dtypes)

    def tagged(field: str) -> Column:
        items = F.coalesce(F.col(field), F.array().cast(kinds[field])) if kinds[field].startswith("array") else F.array(F.col(field))
        return F.transform(items, lambda x: F.struct(F.lit(field).alias("field"), x.alias("ref")))

    one = [tagged(f) for f in fields]
    return (
        df.select(F.col(row_id).alias("row_id"), F.col(when).alias("at"), F.explode(F.concat(*one)).alias("r"))
        .select(F.lit(tab).alias("tab"), "row_id", "r.field", "r.ref", "at")
        .withColumn("to", F.lit(to))
        .withColumn("key", reference_key(F.col("ref")))
        .filter(F.col("key") != "")
    )


def broken_references(parents: DataFrame, children: DataFrame) -> DataFrame:
    """Rows of ``children`` (``tab, row_id, field, ref, at, to, key``) that are broken.

    ``parents``: ``to, key, first_at, deleted_at``; a null ``first_at`` means "always there".
    """
    children = stored(children, "references")
    never = F.lit(None).cast("timestamp")
    tagged = parents.select("to", "key", F.lit(True).alias("is_parent"), "first_at", "deleted_at", never.alias("lo"), never.alias("hi")).unionByName(
        children.select("to", "key", F.lit(False).alias("is_parent"), never.alias("first_at"), never.alias("deleted_at"), F.col("at").alias("lo"), F.col("at").alias("hi"))
    )
    verdict = tagged.groupBy("to", "key").agg(
        F.max("is_parent").alias("has_parent"),
        F.min("first_at").alias("first_at"),
        F.max("deleted_at").alias("deleted_at"),
        F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
        F.max(~F.col("is_parent")).alias("referred"),
    )
    suspect = verdict.filter(F.col("referred") & (~F.col("has_parent") | (F.col("first_at") > F.col("lo")) | (F.col("deleted_at") <= F.col("hi")))).select("to", "key", "has_parent", "first_at", "deleted_at")
    rows = lookup_join(children, suspect, ["to", "key"])
    kind = F.when(~F.col("has_parent"), "missing").when(F.col("first_at") > F.col("at"), "late").when(F.col("deleted_at") <= F.col("at"), "deleted")
    return rows.withColumn("kind", kind).filter(F.col("kind").isNotNull()).select("tab", "row_id", "field", "ref", "kind", F.date_format("at", "yyyy-MM").alias("period")).distinct()


def parent_keys(nodes: DataFrame, projects: DataFrame) -> DataFrame:
    """What may be referred to: ids and permalinks of nodes, slugs of projects (always there)."""
    own = node_keys(holding_state(nodes)).select("key", F.lit(False).alias("project"), "first_at", "deleted_at")
    slugs = projects.select(F.lower(strip_blanks(F.col("slug"))).alias("key"), F.lit(True).alias("project"), F.lit(None).cast("timestamp").alias("first_at"), F.lit(None).cast("timestamp").alias("deleted_at")).filter("key != ''")
    # a slug that is also a node's key always exists
    return own.unionByName(slugs).groupBy("key").agg(F.max(F.struct("project", "first_at", "deleted_at")).alias("b")).select(F.lit(NOTES).alias("to"), "key", "b.first_at", "b.deleted_at")


def orphan_counts(broken: DataFrame) -> DataFrame:
    """Broken references per table, field, kind and period."""
    return broken.groupBy("tab", "field", "kind", "period").agg(F.count(F.lit(1)).alias("n"))
