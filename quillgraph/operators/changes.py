"""Edits as reviewable change rows, and their application.

A change is ``id, action, field, old, new``. Producing changes reads, applying them is a
join; nothing is edited in place, so a dry run is the change table itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.refs import reference_key
from quillgraph.plans.skew import lookup_join


def set_field(rows: DataFrame, field: str, value: Column, action: str = "update") -> DataFrame:
    """Changes of one field; rows that have the value already give none."""
    new = value.cast("string")
    return rows.filter(~F.col(field).cast("string").eqNullSafe(new)).select("id", F.lit(action).alias("action"), F.lit(field).alias("field"), F.col(field).cast("string").alias("old"), new.alias("new"))


def apply_changes(rows: DataFrame, changes: DataFrame, fields: list[str]) -> DataFrame:
    """``rows`` with the changes of ``fields`` made; of several changes of a field the largest value wins."""
    per = changes.filter(F.col("field").isin(fields)).groupBy("id").agg(*[F.max(F.when(F.col("field") == f, F.struct(F.lit(1).alias("k"), F.col("new")))).alias(f"__{f}") for f in fields])
    out = lookup_join(rows, per, ["id"], "left")
    for f in fields:
        kind = dict(rows.dtypes)[f]
        out = out.withColumn(f, F.when(F.col(f"__{f}").isNotNull(), F.col(f"__{f}.new").cast(kind)).otherwise(F.col(f)))
    return out.select(*rows.columns)


def patch(base: DataFrame, patches: DataFrame, fields: list[str], key: str = "id") -> DataFrame:
    """Merge: patched values where given, else those of the base; keys only in the patch are added, ``removed`` ones left out."""
    p = patches.select(key, *[F.col(f).alias(f"__{f}") for f in fields], F.coalesce("removed", F.lit(False)).alias("__gone"))
    both = base.select(key, *fields).join(p, key, "full_outer").filter(~F.coalesce("__gone", F.lit(False)))
    return both.select(key, *[F.coalesce(f"__{f}", f).alias(f) for f in fields])


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last writer of each key wins; ties by the remaining columns."""
    rest = [c for c in rows.columns if c not in (key, order)]
    return rows.groupBy(key).agg(F.max(F.struct(order, *rest)).alias("s")).select(key, f"s.{order}", *[f"s.{c}" for c in rest])


def rename_references(edges: DataFrame, renames: DataFrame) -> DataFrame:
    """``edges`` with both ends renamed; ``renames``: ``old, new`` (one row per old)."""
    low = renames.select(F.lower("old").alias("k"), "new")
    out = edges
    for end in ("source", "target"):
        out = lookup_join(out.withColumn("k", reference_key(F.col(end))), low, ["k"], "left").withColumn(end, F.coalesce("new", end)).drop("k", "new")
    return out.filter("source <> target").distinct()


def merge_nodes(edges: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges redirected to the survivor, and the change rows of what is given up; ``members``: ``id, survivor``."""
    moved = members.filter("id <> survivor")
    changes = moved.select("id", F.lit("merge").alias("action"), F.lit("superseded_by").alias("field"), F.lit(None).cast("string").alias("old"), F.col("survivor").alias("new"))
    return rename_references(edges, moved.select(F.col("id").alias("old"), F.col("survivor").alias("new"))), changes


def edit_list(current: Column, add: Column, remove: Column) -> Column:
    """A list with members added and removed, in order and without repeats."""
    none = F.array().cast("array<string>")
    return F.array_except(F.array_union(F.coalesce(current, none), F.coalesce(add, none)), F.coalesce(remove, none))


def decayed(weight: Column, since: Column, as_of: Column, rate: float = 0.05) -> Column:
    """Exponential decay by whole days; ages below zero count as zero."""
    return weight * F.exp(-F.lit(rate) * F.greatest(F.datediff(as_of, since), F.lit(0)))


def recency(days: Column) -> Column:
    """1 up to today, falling over 30 days, 0 from 90 on."""
    return F.when(days <= 0, 1.0).when(days >= 90, 0.0).otherwise(F.exp(-days / 30.0))


def inherit_template(rows: DataFrame, templates: DataFrame, fields: list[str], link: str = "template_id") -> DataFrame:
    """Values of the row where it has them, else those of its template."""
    t = templates.select(F.col("id").alias(link), *[F.col(f).alias(f"__{f}") for f in fields])
    return lookup_join(rows, t, [link], "left").select(*[F.coalesce(c, f"__{c}").alias(c) if c in fields else F.col(c) for c in rows.columns])


#: Fields of frontmatter that name other notes.
REFERENCE_FIELDS = ("parent", "depends_on", "soft_depends_on", "contributes_to", "supersedes", "superseded_by")


def patched(frontmatter: Column, values: Column, removed: Column) -> Column:
    """Frontmatter (JSON) with keys set and removed; ``values``: map of keys to JSON texts, ``removed``: list of keys.

    Null or unreadable frontmatter counts as empty; null values and lists change nothing.
    """
    kind = "map<string,variant>"
    old = F.coalesce(F.from_json(frontmatter, kind), F.expr(f"cast(map() AS {kind})"))
    new = F.coalesce(F.transform_values(values, lambda k, v: F.try_parse_json(v)), F.expr(f"cast(map() AS {kind})"))
    gone = F.coalesce(removed, F.array().cast("array<string>"))
    kept = F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(new), k) & ~F.array_contains(gone, k))
    return F.to_json(F.map_concat(kept, new))


def checked(updates: DataFrame) -> DataFrame:
    """``updates`` (``id, field, value``: JSON text, null removes the key) with ``problem``: null where it may be made."""
    from quillgraph.functions import vocabulary as voc
    from quillgraph.functions.text import effort_days, status_alias

    field, text = F.col("field"), F.expr("try_variant_get(try_parse_json(value), '$', 'string')")
    bad = (
        F.when(field == "blocked", "computed")
        .when(F.col("value").isNotNull() & F.expr("try_parse_json(value) IS NULL"), "unreadable")
        .when((field == "status") & ~status_alias(text).isin(voc.STATUSES), "unknown status")
        .when((field == "type") & ~text.isin(voc.NODE_TYPES), "unknown type")
        .when((field == "priority") & ~F.coalesce(text.try_cast("bigint").between(0, 4), F.lit(False)) & F.col("value").isNotNull(), "priority out of range")
        .when((field == "effort") & F.col("value").isNotNull() & effort_days(text).isNull(), "unreadable effort")
    )
    return updates.withColumn("problem", bad)


def updated(documents: DataFrame, updates: DataFrame) -> DataFrame:
    """``documents`` (``id, frontmatter``, ...) with the sound rows of ``updates`` made; of several for one field the largest value."""
    per = checked(updates).filter("problem IS NULL").groupBy("id", "field").agg(F.max("value").alias("value"))
    pairs = F.collect_list(F.when(F.col("value").isNotNull(), F.struct("field", "value")))
    of = per.groupBy("id").agg(F.map_from_entries(pairs).alias("__set"), F.collect_list(F.when(F.col("value").isNull(), F.col("field"))).alias("__gone"))
    rows = lookup_join(documents, of, ["id"], "left")
    return rows.withColumn("frontmatter", F.when(F.col("__set").isNotNull(), patched(F.col("frontmatter"), F.col("__set"), F.col("__gone"))).otherwise(F.col("frontmatter"))).select(*documents.columns)


def rename_ids(documents: DataFrame, renames: DataFrame) -> DataFrame:
    """``documents`` in which references to ``old`` name ``new`` (``renames``, one row per old): in the fields of
    frontmatter that name notes, and in wikilinks of bodies, whose aliases and sections stay.
    """
    from quillgraph.functions.text import list_or_commas, wikilinks

    fields = [F.coalesce(list_or_commas(F.get_json_object("frontmatter", f"$.{f}")), F.array().cast("array<string>")) for f in REFERENCE_FIELDS]
    written = documents.select("id", F.explode(F.array_distinct(F.concat(*fields, wikilinks(F.col("body"))))).alias("ref")).distinct()
    low = renames.select(F.lower("old").alias("k"), "new")
    pairs = lookup_join(written.withColumn("k", reference_key(F.col("ref"))), low, ["k"])
    # longer ones first, so that none is changed as part of another
    per = pairs.groupBy("id").agg(F.sort_array(F.collect_set(F.struct(F.length("ref").alias("n"), "ref", "new")), asc=False).alias("__r"))
    rows = lookup_join(documents, per, ["id"], "left")
    quoted = lambda s: F.concat(F.lit("\\Q"), s, F.lit("\\E"))
    body = F.aggregate("__r", F.col("body"), lambda s, r: F.regexp_replace(s, F.concat(F.lit(r"\[\[\s*"), quoted(r["ref"]), F.lit(r"\s*(?=[\]|#])")), F.concat(F.lit("[["), F.regexp_replace(r["new"], r"([\\$])", r"\\$1"))))
    as_json = lambda s: F.concat(F.lit('"'), s, F.lit('"'))
    fm = F.from_json("frontmatter", "map<string,variant>")
    renamed = F.transform_values(fm, lambda k, v: F.when(k.isin(list(REFERENCE_FIELDS)), F.parse_json(F.aggregate("__r", F.to_json(F.struct(v.alias("v"))), lambda s, r: F.replace(s, as_json(r["ref"]), as_json(r["new"]))))).otherwise(F.parse_json(F.to_json(F.struct(v.alias("v"))))))
    front = F.to_json(F.transform_values(renamed, lambda k, v: F.try_variant_get(v, "$.v", "variant")))
    hit = F.col("__r").isNotNull()
    return rows.withColumn("body", F.when(hit, body).otherwise(F.col("body"))).withColumn("frontmatter", F.when(hit & F.col("frontmatter").isNotNull(), front).otherwise(F.col("frontmatter"))).select(*documents.columns)
