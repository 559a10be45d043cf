"""Joins of many rows with one row per key, safe whatever share of the rows a key holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys are counted by this many hash buckets: the counts are never more rows than this.
BUCKETS = 4_096
#: A bucket of up to this many rows is fine in one task.
LIGHT = 20_000


def _bucket(on: list[str]) -> Column:
    return F.pmod(F.xxhash64(*on), F.lit(BUCKETS)).cast("int")


def spread(facts: DataFrame, on: list[str], light: int = LIGHT) -> list[tuple[int, int]]:
    """``bucket, salts`` of the buckets that hold more than a quarter of an even task's share.

    A key is never heavier than its bucket, so every hot key is in one of these, however
    many there are. Counted with partial aggregation: each task sends at most ``BUCKETS`` rows.
    """
    parts = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = facts.groupBy(_bucket(on).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()
    share = max(light, sum(r["n"] for r in counts) / (4 * parts))
    return [(r["b"], int(-(-r["n"] // share))) for r in counts if r["n"] > share]


def lookup_join(facts: DataFrame, dim: DataFrame, on: list[str], how: str = "inner", light: int = LIGHT) -> DataFrame:
    """``facts`` with the columns of ``dim``, ``how`` inner or left; hot keys of ``facts`` are spread.

    ``dim`` has one row per key as a rule; of several each meets every row of the key.

    Rows of heavy buckets are salted by a hash of the whole row, and only the rows of
    ``dim`` in those buckets are repeated, once per salt: their number is bounded by
    ``8 x partitions / BUCKETS`` of ``dim``. ``facts`` is read twice, once for its keys
    alone; store it first where its columns are costly.
    """
    heavy = spread(facts, on, light)
    extra = [c for c in dim.columns if c not in on]
    cols = [*facts.columns, *extra]
    if not heavy:
        return facts.join(dim, on, how).select(*cols)
    salts = F.broadcast(facts.sparkSession.createDataFrame(heavy, "__b int, __s int"))
    hashed = [c for c, kind in facts.dtypes if "map<" not in kind and "variant" not in kind]
    of = F.when(F.col("__s").isNotNull(), F.pmod(F.xxhash64(*hashed, F.lit(1)), F.col("__s"))).otherwise(0).cast("int")
    left = facts.withColumn("__b", _bucket(on)).join(salts, "__b", "left").withColumn("__k", of).drop("__b", "__s")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("__s", F.lit(1)) - 1))
    right = dim.withColumn("__b", _bucket(on)).join(salts, "__b", "left").withColumn("__k", copies).drop("__b", "__s")
    return left.join(right, [*on, "__k"], how).select(*cols)


def even_labels(spark: SparkSession, parts: int) -> list[int]:
    """``parts`` integers of which hash partitioning into ``parts`` puts exactly one into each partition.

    Work dealt to these labels is spread evenly, where consecutive numbers would collide.
    """
    wide = 8
    while True:
        rows = spark.range(wide * parts, numPartitions=1).select(F.col("id").cast("int").alias("k")).groupBy(F.pmod(F.hash("k"), F.lit(parts)).alias("p")).agg(F.min("k").alias("k")).collect()
        if len(rows) == parts:
            return [r["k"] for r in sorted(rows)]
        wide *= 4
