"""Statistics in one pass each: distributions, frequencies, percentiles, a change token."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.session import stored

#: A group is worked on in so many shares before it comes together.
SHARES = 32


def graph_stats(current: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, deleted, typed, with parent, orphans by both fields, edges, kinds of edges, mean degree."""
    n = current.agg(
        F.count(F.lit(1)).alias("nodes"),
        F.count_if(F.col("deleted_at").isNotNull()).alias("deleted"),
        F.count_if(F.col("node_type").isNotNull()).alias("typed"),
        F.count_if(F.col("parent").isNull() & F.col("project").isNull()).alias("loose"),
        F.countDistinct("project").alias("projects"),
    )
    e = edges.agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("type").alias("edge_types"), F.count_if(F.col("type") == "parent").alias("parent_edges"))
    return n.withColumn("k", F.lit(1)).join(F.broadcast(e.withColumn("k", F.lit(1))), "k").drop("k").withColumn("mean_degree", F.round(F.col("edges") / F.greatest("nodes", F.lit(1)), 4))


def distribution(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, value, n`` of several columns in one pass; null as its own value."""
    flat = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("(null)")).alias("value")) for c in columns])).alias("p"))
    return flat.groupBy("p.column", "p.value").agg(F.count(F.lit(1)).alias("n"))


def tag_frequency(df: DataFrame) -> DataFrame:
    """Every occurrence counts, whatever its case."""
    return df.select(F.explode("tags").alias("t")).groupBy(F.lower("t").alias("tag")).agg(F.count(F.lit(1)).alias("n"))


def rollup(events: DataFrame, by: str, value: str, error: str) -> DataFrame:
    """Calls, sum and whole mean of a value, and errors per key."""
    return events.groupBy(by).agg(
        F.count(F.lit(1)).alias("calls"),
        F.round(F.sum(value), 4).alias("total"),
        F.floor(F.avg(value)).alias("mean"),
        F.count_if(F.col("event_type") == error).alias("errors"),
    )


def percentiles(df: DataFrame, by: str, value: str, points: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Nearest-rank percentiles at ``round((n - 1) q)``, exact, however many rows a key has.

    Equal values are counted first, then sorted over all partitions by range; the rank of a
    value is its rank within the partition plus the rows of the key in the partitions before.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("__n"))
    placed = stored(counts.repartitionByRange(by, value).withColumn("__p", F.spark_partition_id()), "ranked")
    parts = placed.groupBy(by, "__p").agg(F.sum("__n").alias("__all"))
    before = Window.partitionBy(by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("__off", F.coalesce(F.sum("__all").over(before), F.lit(0))).withColumn("__t", F.sum("__all").over(Window.partitionBy(by))).select(by, "__p", "__off", "__t")
    upto = F.sum("__n").over(Window.partitionBy(by, "__p").orderBy(value)) + F.col("__off")
    rows = placed.join(parts, [by, "__p"]).withColumn("__upto", upto)
    at = [F.min(F.when(F.col("__upto") > F.round((F.col("__t") - 1) * F.lit(q)).cast("bigint"), F.col(value))).alias(f"p{round(q * 100)}") for q in points]
    return rows.groupBy(by).agg(*at, F.sum("__n").alias("n"), F.round(F.sum(F.col(value) * F.col("__n")) / F.sum("__n"), 6).alias("mean"), F.max(value).alias("max"))


def top_by(df: DataFrame, metric: str, n: int, key: str = "id") -> DataFrame:
    """The ``n`` rows of largest metric, ties by key (a top-k report)."""
    return df.orderBy(F.desc_nulls_last(metric), key).limit(n)


def first_per_group(df: DataFrame, group: str, order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each group: first of each group's shares, then of those, so no task sorts a whole hot group."""
    cols = df.columns
    rows = df.withColumn("__s", F.pmod(F.xxhash64(*[c for c, k in df.dtypes if "map<" not in k and "variant" not in k]), F.lit(SHARES)))
    some = rows.withColumn("__r", F.row_number().over(Window.partitionBy(group, "__s").orderBy(*order))).filter(F.col("__r") <= n)
    return some.withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("__r") <= n).select(*cols)


def normalised_by_max(df: DataFrame, column: str, out: str) -> DataFrame:
    """``df`` with ``column`` over its largest value; 0 where that is 0 or there is none."""
    most = df.agg(F.max(column).alias("__m")).withColumn("__k", F.lit(1))
    return df.withColumn("__k", F.lit(1)).join(F.broadcast(most), "__k").withColumn(out, F.when(F.col("__m") > 0, F.coalesce(column, F.lit(0)) / F.col("__m")).otherwise(0.0)).drop("__k", "__m")


def batch_summary(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """One row: rows matched by a filter, changed, and left as they were."""
    seen = rows.select("id").distinct().join(changes.select("id", F.lit(1).alias("__c")).distinct(), "id", "left")
    return seen.agg(F.count(F.lit(1)).alias("matched"), F.count("__c").alias("changed"), (F.count(F.lit(1)) - F.count("__c")).alias("skipped"))


def change_token(counts: DataFrame) -> str:
    """64-bit FNV-1a over one collected row of counters: equal as long as they are."""
    row = counts.first()
    h = 0xCBF29CE484222325
    for b in "|".join(f"{k}={v}" for k, v in sorted(row.asDict().items())).encode():
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return f"{h:016x}"
