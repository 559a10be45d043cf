"""Data-quality rules over documents, all in one pass: each is a condition on the row.

The report has ``path, severity, rule, line`` (0: the whole document). Documents are read
once, frontmatter is parsed once, and each row yields its findings as an array that is
exploded; only the columns that chosen rules need are read. What needs other rows - broken
references, circles, missing parents, unknown projects - is joined by functions of its own.

Defined results: null and unreadable frontmatter gives findings of its own and none about
its keys; a null or empty body has none; repeated rows are reported once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import vocabulary as voc
from quillgraph.functions.text import effort_days, status_alias


def _key(name: str) -> Column:
    return F.expr(f"try_variant_get(__v, '$.{name}', 'string')")


def _kind(name: str) -> Column:
    """What a key of the frontmatter holds: ``STRING``, ``BIGINT``, ``ARRAY<...>``; null where it is absent or null."""
    return F.nullif(F.expr(f"schema_of_variant(try_variant_get(__v, '$.{name}', 'variant'))"), F.lit("VOID"))


def _blank(c: str) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def _where(cond) -> Column:
    """Numbers of the body's lines that satisfy ``cond(line, index)``, from 1."""
    hit = F.transform("__lines", lambda x, i: F.when(cond(x, i), i + 1))
    return F.array_compact(hit)


def _empty_at(i: Column) -> Column:
    return F.coalesce(F.trim(F.translate(F.get("__lines", i), "\t", " ")) == "", F.lit(False))


def _rules() -> dict[str, tuple[str, str, Column, Column | None]]:
    """Severity, rule, condition and lines (None: the whole document) by name."""
    is_map = F.expr("schema_of_variant(__v) LIKE 'OBJECT%'")
    task = F.coalesce(_key("type").isin(voc.TASK_TYPES), F.lit(False))
    number = _kind("priority").rlike("^(?:BIGINT|DECIMAL|DOUBLE|FLOAT)")
    trailing = _where(lambda x, i: x.rlike(r"[ \t]+$") & ~x.rlike(r"(?:^|[^ \t])  $"))
    return {
        "missing_frontmatter": ("warning", "fm-missing", F.col("frontmatter").isNull(), None),
        "bad_frontmatter": ("error", "fm-parse-error", F.col("frontmatter").isNotNull() & F.col("__v").isNull(), None),
        "frontmatter_is_no_map": ("error", "fm-invalid", F.col("__v").isNotNull() & ~is_map, None),
        "no_title": ("warning", "fm-no-title", _blank("title"), None),
        "no_type": ("warning", "doc-no-type", _blank("doc_type"), None),
        "no_status": ("warning", "task-no-status", _blank("status"), None),
        "no_project": ("warning", "fm-missing-project", _blank("project"), None),
        "no_id": ("error", "task-no-id", is_map & _kind("id").isNull() & _kind("task_id").isNull(), None),
        "legacy_id": ("style", "task-legacy-id", _kind("id").isNull() & _kind("task_id").isNotNull(), None),
        "retired_type": ("warning", "fm-deprecated-project-type", _key("type") == "project", None),
        "unknown_type": ("style", "fm-unknown-type", (_kind("type") == "STRING") & ~_key("type").isin([*voc.NODE_TYPES, "project"]), None),
        "type_is_no_text": ("error", "fm-type-not-string", _kind("type") != "STRING", None),
        "status_alias": ("style", "fm-status-alias", task & (_kind("status") == "STRING") & (status_alias(_key("status")) != _key("status")), None),
        "unknown_status": ("warning", "fm-unknown-status", task & (_kind("status") == "STRING") & ~status_alias(_key("status")).isin(voc.STATUSES), None),
        "status_is_no_text": ("error", "fm-status-not-string", task & (_kind("status") != "STRING"), None),
        "priority_range": ("warning", "fm-priority-range", (_kind("priority") == "BIGINT") & ~_key("priority").try_cast("bigint").between(0, 4), None),
        "priority_is_no_number": ("error", "fm-priority-type", _kind("priority").isNotNull() & ~number, None),
        "bad_effort": ("warning", "fm-invalid-effort", (_kind("effort") == "STRING") & effort_days(_key("effort")).isNull(), None),
        "tags_are_no_list": ("error", "fm-tags-type", _kind("tags").isNotNull() & ~_kind("tags").rlike("^(?:ARRAY|STRING)"), None),
        "id_format": ("style", "fm-id-format", (F.length(_key("id")) > 0) & ~F.coalesce(_key("type").isin("goal", "target", "project"), F.lit(False)) & ~_key("id").rlike(voc.MADE_ID), None),
        "body_in_frontmatter": ("error", "fm-prohibited-body", _kind("body").isNotNull(), None),
        "unknown_key": ("style", "fm-unknown-key", F.size(F.array_except(F.json_object_keys("frontmatter"), F.array(*[F.lit(k) for k in voc.KNOWN_KEYS]))) > 0, None),
        "id_mismatch": ("error", "fm-other-id", _key("id") != F.col("id"), None),
        "trailing_space": ("style", "md-trailing-ws", F.size(trailing) > 0, F.slice(trailing, 1, 1)),
        "blank_runs": ("style", "md-consecutive-blanks", F.lit(True), _where(lambda x, i: (i > 1) & _empty_at(i) & _empty_at(i - 1) & _empty_at(i - 2))),
        "no_final_newline": ("style", "md-no-final-newline", (F.length("body") > 0) & ~F.col("body").endswith("\n"), None),
        "open_fence": ("warning", "md-open-fence", F.size(_where(lambda x, i: F.ltrim(x).startswith("```"))) % 2 == 1, None),
    }


def lint(documents: DataFrame, rules: list[str] | None = None) -> DataFrame:
    """``path, severity, rule, line`` of the chosen rules, all by default."""
    text = F.regexp_replace("body", "\r", "")
    df = documents.withColumn("__v", F.expr("try_parse_json(frontmatter)")).withColumn("__lines", F.split(F.regexp_replace(text, r"\n\z", ""), "\n"))
    known = _rules()
    none = F.array().cast("array<struct<severity:string,rule:string,line:int>>")

    def found(severity: str, rule: str, condition: Column, lines: Column | None) -> Column:
        one = lambda n: F.struct(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), n.cast("int").alias("line"))
        hits = F.array(one(F.lit(0))) if lines is None else F.transform(lines, one)
        return F.when(F.coalesce(condition, F.lit(False)), F.coalesce(hits, none)).otherwise(none)

    found = [found(*known[r]) for r in rules or known]
    return df.select("path", F.explode(F.concat(*found)).alias("f")).select("path", "f.severity", "f.rule", "f.line").distinct()


def no_parent(nodes: DataFrame, edges: DataFrame, types: tuple[str, ...] = ("task", "epic")) -> DataFrame:
    """``id, severity, rule``: nodes of these types without a parent; a warning where they have children themselves."""
    kids = edges.filter("type = 'parent'").select(F.col("target").alias("id"), F.lit(True).alias("has")).distinct()
    lone = nodes.filter(F.col("node_type").isin(*types) & (F.trim(F.coalesce("parent", F.lit(""))) == ""))
    return lone.join(kids, "id", "left").select("id", F.when(F.col("has"), "warning").otherwise("style").alias("severity"), F.lit("task-no-parent").alias("rule"))


def circular(parent_circles: DataFrame, hard_circles: DataFrame, own_parents: DataFrame) -> DataFrame:
    """``id, rule``: what is its own parent, on a circle of parents, on another hard circle: the first that holds."""
    rows = own_parents.select("id", F.lit(0).alias("p"), F.lit("self-parent").alias("rule"))
    rows = rows.unionByName(parent_circles.select("id", F.lit(1).alias("p"), F.lit("parent-cycle").alias("rule")))
    rows = rows.unionByName(hard_circles.select("id", F.lit(2).alias("p"), F.lit("dep-hard-cycle").alias("rule")))
    return rows.groupBy("id").agg(F.min(F.struct("p", "rule")).alias("r")).select("id", "r.rule")


def unregistered_projects(nodes: DataFrame, projects: DataFrame) -> DataFrame:
    """``id, project`` whose project is neither a slug nor an alias of the registry."""
    known = projects.select(F.explode(F.concat(F.array("slug"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("k")).select(F.lower("k").alias("k")).distinct()
    return nodes.filter("project IS NOT NULL").select("id", "project", F.lower("project").alias("k")).join(F.broadcast(known), "k", "left_anti").select("id", "project")


def self_parents(nodes: DataFrame, key) -> DataFrame:
    """Nodes that name themselves as parent; ``key`` is the expression of a written reference."""
    return nodes.filter(key(F.col("parent")) == F.lower("id")).select("id")


def summary(report: DataFrame) -> DataFrame:
    return report.groupBy("severity", "rule").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("path").alias("files"))


def fix_body(c):
    """Body with line ends, trailing blanks, runs of blank lines, list bullets and the last line put right; doing it twice changes nothing."""
    s = F.regexp_replace(c, "\r", "")
    s = F.regexp_replace(s, r"(?m)(?<![ \t])(?:[ \t]|[ \t]{3,})$|(?m)\t+[ \t]*$", "")
    s = F.regexp_replace(s, r"(?m)^(\s*)\* ", "$1- ")
    s = F.regexp_replace(s, r"\n(?:[ \t]*\n){3,}", "\n\n\n")
    return F.when((s == "") | s.endswith("\n"), s).otherwise(F.concat(s, F.lit("\n")))
