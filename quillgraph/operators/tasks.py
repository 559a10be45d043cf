"""Lists of nodes: which are ready or held up, sorted by named keys, with what stands above them.

What counts as finished, ready or held up is a parameter; the defaults are the fixed words
of ``functions.vocabulary``.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import vocabulary as voc
from quillgraph.functions.refs import reference_key
from quillgraph.functions.text import day_prefix, slugify, status_alias
from quillgraph.operators import graph
from quillgraph.operators.context import spread_from
from quillgraph.operators.model import roots
from quillgraph.operators.stats import first_per_group
from quillgraph.plans.skew import lookup_join
from quillgraph.session import observed, discard


def is_completed(status: Column) -> Column:
    """Finished, under any spelling; null is not."""
    return F.coalesce(status_alias(status).isin(voc.COMPLETED), F.lit(False))


def is_closed(status: Column) -> Column:
    """Closed for what hangs below; other spellings do not count."""
    return F.coalesce(status.isin(voc.CLOSED), F.lit(False))


def listed(nodes: DataFrame, types: list[str] = voc.TASK_TYPES, finished: bool = False) -> DataFrame:
    """Nodes of these types, without finished ones unless asked for."""
    rows = nodes.filter(F.col("node_type").isin(types))
    return rows if finished else rows.filter(~is_completed(F.col("status")))


#: Sorts by name; a missing due day sorts last. Ties go by id.
SORTS = {
    "priority": lambda: [F.coalesce("priority", F.lit(4)), F.col("id")],
    "due": lambda: [F.coalesce("due", F.lit("9999-99-99")), F.col("id")],
    "created": lambda: [F.coalesce("created", F.lit("9999-99-99")), F.col("id")],
    "severity": lambda: [F.desc_nulls_last("severity"), F.coalesce("priority", F.lit(4)), F.col("id")],
    "title": lambda: [F.col("label"), F.col("id")],
}


def sorted_by(nodes: DataFrame, name: str) -> DataFrame:
    """``nodes`` in a named order; an unknown name leaves them as they are."""
    return nodes.orderBy(*SORTS[name]()) if name in SORTS else nodes


def states(nodes: DataFrame, edges: DataFrame, ready: list[str] = ("ready", "queued"), blocked: list[str] = voc.BLOCKED, types: list[str] = ("task",), handed_on: bool = True) -> DataFrame:
    """``id, state``: ``blocked`` where something needed is unfinished or the status says so, else ``ready``.

    Blocking is handed on to all that wait, directly or not, unless ``handed_on`` is false.
    Ready are nodes of these types and statuses without children. Others have no row.
    """
    needs = edges.filter("type = 'depends_on'").select(F.col("source").alias("id"), F.col("target").alias("needed"))
    open_ = nodes.filter(~is_completed(F.col("status"))).select(F.col("id").alias("needed"))
    held = needs.join(open_, "needed", "left_semi").select("id").unionByName(nodes.filter(F.col("status").isin(list(blocked))).select("id")).distinct()
    if handed_on:
        held = spread_from(edges.filter("type = 'depends_on'").select(F.col("target").alias("src"), F.col("source").alias("dst")), held)
    above = edges.filter("type = 'parent'").select(F.col("target").alias("id")).distinct()
    free = nodes.filter(F.col("status").isin(list(ready)) & F.col("node_type").isin(list(types))).select("id").join(above, "id", "left_anti").join(held, "id", "left_anti")
    return held.withColumn("state", F.lit("blocked")).unionByName(free.withColumn("state", F.lit("ready")))


def reachable(nodes: DataFrame, edges: DataFrame, types: list[str] = voc.TASK_TYPES) -> DataFrame:
    """``id``: open leaves of these types and all that they are part of, need, or contribute to."""
    open_ = nodes.filter(F.col("status").isNotNull() & ~is_completed(F.col("status")))
    busy = edges.filter("type = 'parent'").join(open_.select(F.col("id").alias("source")), "source", "left_semi").select(F.col("target").alias("id"))
    leaves = open_.filter(F.col("node_type").isin(types)).select("id").join(busy.distinct(), "id", "left_anti")
    up = edges.filter(F.col("type").isin("parent", "depends_on", "soft_depends_on", "contributes_to")).select(F.col("source").alias("src"), F.col("target").alias("dst"))
    return spread_from(up, leaves)


def nearest_above(links: DataFrame, hits: DataFrame, itself: bool = False) -> DataFrame:
    """``id, ancestor, steps, chain``: the nearest of ``hits`` (column id) above each node, and the way there.

    ``links``: ``id, parent``. ``itself``: a hit is its own ancestor, at no steps. Nodes
    without one above, or on a circle without one, have no row. Pointer jumping: the rounds
    are the logarithm of the longest way.
    """
    marks = hits.select(F.col("id").alias("ptr"), F.lit(True).alias("hit")).distinct()
    start = links.filter("parent IS NOT NULL").select("id", F.col("parent").alias("ptr"), F.lit(1).alias("steps"), F.array("id").alias("chain"))
    first = lookup_join(start, marks, ["ptr"], "left").select("id", "ptr", "steps", "chain", F.coalesce("hit", F.lit(False)).alias("done"))
    state, seen = observed(first, "above", left=F.count_if(~F.col("done")))
    left, before = seen["left"], 0
    while left and left != before:
        ahead = state.select(F.col("id").alias("ptr"), F.col("ptr").alias("p2"), F.col("steps").alias("s2"), F.col("chain").alias("c2"), F.col("done").alias("d2"))
        # what points at a node without a parent goes nowhere and drops out
        moved = lookup_join(state.filter("NOT done"), ahead, ["ptr"]).select("id", F.col("p2").alias("ptr"), (F.col("steps") + F.col("s2")).alias("steps"), F.concat("chain", "c2").alias("chain"), F.col("d2").alias("done"))
        after, seen = observed(state.filter("done").unionByName(moved), "above", left=F.count_if(~F.col("done")))
        discard(state)
        state, before, left = after, left, seen["left"]
    found = state.filter("done").select("id", F.col("ptr").alias("ancestor"), "steps", F.concat("chain", F.array("ptr")).alias("chain"))
    if not itself:
        return found
    own = hits.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("steps"), F.array("id").alias("chain")).distinct()
    return found.join(own.select("id"), "id", "left_anti").unionByName(own)


def with_context(shown: DataFrame, nodes: DataFrame, edges: DataFrame, types: list[str] = ("epic",)) -> DataFrame:
    """``id, context``: shown nodes, and what of these types stands above them, each once."""
    up = edges.filter("type = 'parent'").select(F.col("source").alias("src"), F.col("target").alias("dst"))
    above = graph.closure(up, shown.select("id")).select("id").distinct().join(nodes.filter(F.col("node_type").isin(list(types))).select("id"), "id", "left_semi")
    return shown.select("id", F.lit(False).alias("context")).unionByName(above.join(shown.select("id"), "id", "left_anti").withColumn("context", F.lit(True)))


def dashboard(rows: DataFrame, as_of: date) -> DataFrame:
    """One row: total, urgent, overdue, with a due day, and the greatest age in days. ``rows``: ``priority, due, created``."""
    due, made, today = day_prefix(F.col("due")), day_prefix(F.col("created")), F.lit(as_of)
    return rows.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("priority") <= 1).alias("urgent"),
        F.count_if(due < today).alias("overdue"),
        F.count(due).alias("with_due"),
        F.max(F.datediff(today, made)).alias("oldest"),
    )


def next_numbers(ids: DataFrame, parents: DataFrame) -> DataFrame:
    """``id, next``: the number after the largest ``n`` among ``<id>.n`` of ``ids``, for each of ``parents``."""
    used = ids.select(F.regexp_extract("id", r"^(.+)\.(\d+)$", 1).alias("p"), F.regexp_extract("id", r"^(.+)\.(\d+)$", 2).try_cast("bigint").alias("n")).filter("n IS NOT NULL")
    most = used.groupBy(F.col("p").alias("id")).agg(F.max("n").alias("n"))
    return parents.select("id").distinct().join(most, "id", "left").select("id", (F.coalesce("n", F.lit(0)) + 1).alias("next"))


def divergences(edges: DataFrame, nodes: DataFrame, held: DataFrame, as_of: date, days: int = 14, weight: float = 0.75) -> DataFrame:
    """``source, target, weight, days``: heavy links from open nodes that are not held up and long untouched.

    ``edges``: ``source, target, weight``; ``nodes``: ``id, status, modified``; an unreadable time counts as today.
    """
    age = F.coalesce(F.floor((F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(F.col("modified").try_cast("timestamp"))) / 86_400), F.lit(0))
    idle = nodes.filter(~is_completed(F.col("status"))).select(F.col("id").alias("source"), age.alias("days")).filter(F.col("days") >= days)
    return edges.filter(F.col("weight") >= weight).join(idle, "source").join(held.select(F.col("id").alias("source")), "source", "left_anti").select("source", "target", "weight", "days")


def strategic_parents(nodes: DataFrame, parents: DataFrame, types: list[str] = voc.STRATEGIC_TYPES) -> DataFrame:
    """Changes that turn a parent of these types into a contribution: ``id, action, field, old, new``. ``parents``: ``id, parent``."""
    aims = nodes.filter(F.col("node_type").isin(types)).select(F.col("id").alias("parent"))
    rows = lookup_join(parents.filter("parent IS NOT NULL").select("id", "parent"), aims.withColumn("aim", F.lit(True)), ["parent"])
    none = F.lit(None).cast("string")
    pairs = F.array(F.struct(F.lit("parent").alias("field"), F.col("parent").alias("old"), none.alias("new")), F.struct(F.lit("contributes_to").alias("field"), none.alias("old"), F.col("parent").alias("new")))
    return rows.select("id", F.lit("migrate").alias("action"), F.explode(pairs).alias("c")).select("id", "action", "c.*")


def with_blockers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, blocked_by``: unfinished nodes that each needs, sorted; nodes that need none have no row."""
    open_ = nodes.filter(~is_completed(F.col("status"))).select(F.col("id").alias("target"))
    needs = edges.filter("type = 'depends_on'").join(open_, "target", "left_semi")
    return needs.groupBy(F.col("source").alias("id")).agg(F.array_sort(F.collect_set("target")).alias("blocked_by"))


def around_change(changed: DataFrame, nodes: DataFrame, edges: DataFrame, siblings: int = 3, unblocked: int = 5) -> DataFrame:
    """``id, kind, other``: what to look at after nodes (column id) were finished: the parent, the first open siblings,
    the children, and the first of those that waited for nothing else.
    """
    open_ = nodes.filter(~is_completed(F.col("status"))).select("id")
    ids = changed.select("id").distinct()
    live = edges.join(open_.select(F.col("id").alias("source")), "source", "left_semi")
    up = edges.filter("type = 'parent'").join(ids.select(F.col("id").alias("source")), "source", "left_semi")
    out = up.select(F.col("source").alias("id"), F.lit("parent").alias("kind"), F.col("target").alias("other"))
    out = out.unionByName(edges.filter("type = 'parent'").join(ids.select(F.col("id").alias("target")), "target", "left_semi").select(F.col("target").alias("id"), F.lit("child").alias("kind"), F.col("source").alias("other")))
    # one more than is shown, since a node is not its own sibling; the changed ones count as finished
    beside = live.filter("type = 'parent'").join(ids.select(F.col("id").alias("source")), "source", "left_anti")
    first = first_per_group(beside.select("target", "source"), "target", [F.col("source")], siblings)
    home = up.groupBy(F.col("source").alias("id")).agg(F.min("target").alias("target"))
    out = out.unionByName(lookup_join(home, first.groupBy("target").agg(F.array_sort(F.collect_list("source")).alias("s")), ["target"]).select("id", F.lit("sibling").alias("kind"), F.explode("s").alias("other")))
    needs = edges.filter("type = 'depends_on'")
    unmet = needs.join(open_.select(F.col("id").alias("target")), "target", "left_semi").join(ids.select(F.col("id").alias("target")), "target", "left_anti").select("source").distinct()
    free = needs.join(ids.select(F.col("id").alias("target")), "target", "left_semi").join(unmet, "source", "left_anti").select(F.col("target").alias("id"), F.col("source").alias("other"))
    return out.unionByName(first_per_group(free, "id", [F.col("other")], unblocked).select("id", F.lit("unblocked").alias("kind"), "other"))


def created(requests: DataFrame, keys: DataFrame, needs_parent: list[str] = ("task", "pr")) -> DataFrame:
    """Requests to write a document (``req_id, id, title, doc_type, status, parent``) as rows to add, and what is wrong with them.

    ``req_id, id, doc_type, permalink, parent, problem``: the id given or one made from the request, the
    parent's id, and the first problem, null where the document may be written. ``keys``: see ``model.resolution``.
    """
    refs = requests.select("req_id", "id", "title", "doc_type", "status", "parent").distinct()
    found = lookup_join(refs.withColumn("key", reference_key(F.col("parent"))), keys.withColumnRenamed("id", "up"), ["key"], "left")
    blank = F.trim(F.coalesce("title", F.lit(""))) == ""
    problem = (
        F.when(blank, "no title")
        .when(~F.coalesce(F.col("doc_type").isin(voc.NODE_TYPES), F.lit(True)), "unknown type")
        .when(~F.coalesce(status_alias(F.col("status")).isin(voc.STATUSES), F.lit(True)), "unknown status")
        .when((F.col("key") != "") & F.col("up").isNull(), "unknown parent")
        .when((F.col("key") == "") & F.col("doc_type").isin(list(needs_parent)), "no parent")
    )
    kind = F.coalesce("doc_type", F.lit("document"))
    own = F.coalesce(F.nullif(F.trim("id"), F.lit("")), F.concat(kind, F.lit("-"), F.substring(F.sha2(F.concat_ws("\x1f", F.col("req_id").cast("string"), "title"), 256), 1, 8)))
    return found.select("req_id", own.alias("id"), kind.alias("doc_type"), slugify(F.col("title")).alias("permalink"), F.col("up").alias("parent"), problem.alias("problem"))


def status_report(documents: DataFrame, nodes: DataFrame, edges: DataFrame, state: DataFrame, as_of: date, stale_days: int = 60) -> DataFrame:
    """One row: documents, those untouched for ``stale_days``, nodes, edges, open tasks, ready and blocked ones, roots, and nodes that hang on nothing.

    ``documents``: ``id, modified``; ``state``: see ``states``.
    """
    day = day_prefix(F.col("modified"))
    tied = edges.filter("type = 'parent'").select(F.explode(F.array("source", "target")).alias("id")).distinct()
    parts = [
        documents.select("id", "modified").distinct().agg(F.countDistinct("id").alias("documents"), F.count_if(F.datediff(F.lit(as_of), day) > stale_days).alias("stale")),
        nodes.agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("node_type").isin(voc.TASK_TYPES) & ~is_completed(F.col("status"))).alias("open_tasks")),
        edges.agg(F.count(F.lit(1)).alias("edges")),
        state.agg(F.count_if(F.col("state") == "ready").alias("ready"), F.count_if(F.col("state") == "blocked").alias("blocked")),
        roots(nodes, edges).agg(F.count(F.lit(1)).alias("roots")),
        nodes.select("id").join(tied, "id", "left_anti").agg(F.count(F.lit(1)).alias("flat")),
    ]
    out = parts[0].withColumn("__k", F.lit(1))
    for p in parts[1:]:
        out = out.join(F.broadcast(p.withColumn("__k", F.lit(1))), "__k")
    return out.drop("__k")
