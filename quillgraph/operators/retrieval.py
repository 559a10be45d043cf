"""Vector search, similarity joins, retrieval quality, hybrid ranking and incremental indexes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import cut_bytes, jaccard, word_set
from quillgraph.functions.vectors import cosine
from quillgraph.plans.skew import lookup_join
from quillgraph.session import stored

#: Numbers of query vectors that are broadcast at once (eight bytes each); more take another pass over the rows.
PASS_NUMBERS = 8_000_000
#: Scores that a task holds at once.
SCORES = 2_000_000
#: Classes of a block of the similarity join, and how many of them are multiplied at once.
JOIN_BLOCK = 4_096
JOIN_SLICE = 64


def chunks(entries: DataFrame, key: str = "entry_id") -> DataFrame:
    """One row per chunk: ``key, chunk_idx, embedding, text, body``."""
    return entries.select(key, F.posexplode("chunk_embeddings").alias("chunk_idx", "embedding"), "chunk_texts", "body_chunks").select(
        key, "chunk_idx", "embedding", F.get("chunk_texts", F.col("chunk_idx")).alias("text"), F.get("body_chunks", F.col("chunk_idx")).alias("body")
    )


def search(entries: DataFrame, query: list[float], k: int = 5, since: str | None = None, before: str | None = None, where: Column | None = None, key: str = "entry_id", digits: int = 6) -> DataFrame:
    """The ``k`` entries whose best chunk is nearest to the query; ties by key.

    Bounds on the day drop entries without one; filters come before scoring, the best chunk
    is chosen in the row, so one top-k is all that is exchanged.
    """
    day = F.substring("modified", 1, 10)
    df = entries.filter(where) if where is not None else entries
    if since is not None:
        df = df.filter(day >= since)
    if before is not None:
        df = df.filter(day <= before)
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = F.transform("chunk_embeddings", lambda v, i: F.struct(cosine(v, q).alias("score"), (-i).alias("neg")))
    best = F.array_max(scored)
    out = df.filter(F.size("chunk_embeddings") > 0).withColumn("__b", best).withColumn("score", F.round("__b.score", digits)).withColumn("chunk_idx", -F.col("__b.neg"))
    snippet = F.coalesce(F.get("body_chunks", F.col("chunk_idx")), F.get("body_chunks", F.lit(0)), F.get("chunk_texts", F.col("chunk_idx")))
    return out.orderBy(F.desc("score"), key).limit(k).select(key, "id", "title", "score", "chunk_idx", cut_bytes(snippet, 300).alias("snippet"))


def _passes(queries: DataFrame, key: str, vector: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys and unit vectors of the queries, in lots that fit a broadcast."""
    ids, vectors, held = [], [], 0
    for r in queries.select(key, vector).filter(F.col(vector).isNotNull()).orderBy(key).toLocalIterator():
        ids.append(r[0])
        vectors.append(r[1])
        held += len(r[1])
        if held >= PASS_NUMBERS:
            yield np.array(ids), _unit(np.array(vectors, np.float64))
            ids, vectors, held = [], [], 0
    if ids:
        yield np.array(ids), _unit(np.array(vectors, np.float64))


def _scored(rows: DataFrame, queries: DataFrame, key: str, vector: str, keep) -> DataFrame:
    """``query, key, score`` of the places that ``keep(scores)`` finds in blocks of queries by rows; a row never meets itself."""
    spark, kind = rows.sparkSession, dict(rows.dtypes)[key]
    schema = f"query {kind}, {key} {kind}, score double"
    out = spark.createDataFrame([], schema)
    for lot in _passes(queries, key, vector):
        held = spark.sparkContext.broadcast(lot)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            ids, q = held.value
            for b in batches:
                if not b.num_rows:
                    continue
                mine = b.column(0).to_numpy(zero_copy_only=False)
                v = _unit(np.array(b.column(1).to_pylist(), np.float64))
                step = max(1, SCORES // len(mine))
                for at in range(0, len(ids), step):
                    score = q[at : at + step] @ v.T
                    score[ids[at : at + step, None] == mine[None, :]] = -np.inf
                    row, col = keep(score)
                    yield pa.record_batch([pa.array(ids[at + row]), pa.array(mine[col]), pa.array(score[row, col])], ["query", key, "score"])

        out = out.unionByName(rows.filter(F.col(vector).isNotNull()).select(key, vector).mapInArrow(run, schema))
    return out.distinct()


def nearest(rows: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query, key, score, rank``: for every query row the ``k`` other rows of largest cosine, exactly.

    The rows are read once for all queries of a pass; each task multiplies its rows with
    blocks of queries and keeps the best ``k`` per query with all that tie with the last, so
    no more than those are exchanged.
    """

    def keep(score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        edge = np.partition(score, -min(k, score.shape[1]), axis=1)[:, -min(k, score.shape[1])]
        return np.nonzero((score >= edge[:, None]) & (score > -np.inf))

    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), key))
    return _scored(rows, queries, key, vector, keep).withColumn("rank", best).filter(F.col("rank") <= k)


def _unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v, axis=-1, keepdims=True)
    return np.divide(v, n, out=np.zeros_like(v), where=n > 0)


def within(rows: DataFrame, queries: DataFrame, threshold: float, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query, key, score``: every other row whose cosine with a query row reaches the threshold, exactly."""
    return _scored(rows, queries, key, vector, lambda score: np.nonzero(score >= threshold))


def equal_classes(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``name, member``: every key with the smallest key that has an equal vector."""
    held = rows.filter(F.col(vector).isNotNull()).select(key, vector)
    names = held.groupBy(vector).agg(F.min(key).alias("name"))
    return held.join(names, vector).select("name", F.col(key).alias("member")).distinct()


def similarity_join(rows: DataFrame, threshold: float = 0.85, key: str = "vec_id", vector: str = "embedding", explicit: DataFrame | None = None) -> DataFrame:
    """``a, b, score`` between classes of equal vectors, named by their smallest key, and ``a = b`` rows for the classes of several.

    Exact: classes are dealt to blocks, and every two blocks meet once in a task, which
    multiplies them slice by slice. ``equal_classes`` has the members of the classes. With
    ``explicit`` (``a, b``, either way round) the pairs are of members, without those given.
    """
    classes = stored(rows.filter(F.col(vector).isNotNull()).groupBy(F.col(vector).alias("v")).agg(F.min(key).alias("name"), F.countDistinct(key).alias("n")), "classes")
    kind = dict(rows.dtypes)[key]
    blocks = max(1, -(-classes.count() // JOIN_BLOCK))

    def meet(f: pd.DataFrame) -> pd.DataFrame:
        p, q = f["p"].iloc[0], f["q"].iloc[0]
        x = f[f["block"] == p]
        y = x if p == q else f[f["block"] == q]
        out = [pd.DataFrame({"a": x["name"].iloc[:0], "b": x["name"].iloc[:0], "score": np.zeros(0)})]
        if len(x) and len(y):
            vx = _unit(np.array(x["v"].tolist(), np.float64))
            vy = vx if p == q else _unit(np.array(y["v"].tolist(), np.float64))
            for at in range(0, len(x), JOIN_SLICE):
                row, col = np.nonzero(vx[at : at + JOIN_SLICE] @ vy.T >= threshold - 1e-9)
                row += at
                if p == q:
                    row, col = row[row < col], col[row < col]
                score = (vx[row] * vy[col]).sum(axis=1)  # the same whatever the block
                keep = score >= threshold
                out.append(pd.DataFrame({"a": x["name"].to_numpy()[row[keep]], "b": y["name"].to_numpy()[col[keep]], "score": score[keep]}))
        return pd.concat(out)

    dealt = classes.select("name", "v", F.pmod(F.xxhash64("name"), F.lit(blocks)).alias("block")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    groups = dealt.select("name", "v", "block", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"))
    met = groups.groupBy("p", "q").applyInPandas(meet, f"a {kind}, b {kind}, score double")
    far = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score")
    if explicit is None:
        return far.unionByName(classes.filter("n > 1").select(F.col("name").alias("a"), F.col("name").alias("b"), F.lit(1.0).alias("score")))
    members = stored(equal_classes(rows, key, vector), "members")
    x, y = members.select(F.col("name").alias("a"), F.col("member").alias("x")), members.select(F.col("name").alias("b"), F.col("member").alias("y"))
    same = x.join(y, F.col("a") == F.col("b")).filter("x < y").select("x", "y", F.lit(1.0).alias("score"))
    every = far.join(x, "a").join(y, "b").select("x", "y", "score").unionByName(same).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "score")
    return every.join(explicit.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), ["a", "b"], "left_anti")


def similarity_report(rows: DataFrame, threshold: float = 0.85, explicit: DataFrame | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row: pairs of rows checked, found alike, and of those known already (``explicit``: ``a, b``, either way round).

    Pairs of equal vectors are counted by the size of their class, not made.
    """
    members = stored(equal_classes(rows, key, vector), "members")
    size = stored(members.groupBy("name").agg(F.count(F.lit(1)).alias("n")), "sizes")
    far = stored(similarity_join(rows, threshold, key, vector).filter("a <> b"), "pairs")
    n = F.col("n").cast("bigint")
    total = members.agg(F.count(F.lit(1)).cast("bigint").alias("n")).select((n * (n - 1) / 2).cast("bigint").alias("checked"))
    equal = size.agg(F.coalesce(F.sum((n * (n - 1) / 2).cast("bigint")), F.lit(0)).alias("equal"))
    apart = far.join(size.select(F.col("name").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("name").alias("b"), F.col("n").alias("nb")), "b").agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("apart"))
    known = rows.sparkSession.createDataFrame([(0,)], "known bigint")
    if explicit is not None:
        pairs = explicit.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).filter("x <> y").distinct()
        named = pairs.join(members.select(F.col("member").alias("x"), F.col("name").alias("nx")), "x").join(members.select(F.col("member").alias("y"), F.col("name").alias("ny")), "y")
        hit = named.select(F.least("nx", "ny").alias("a"), F.greatest("nx", "ny").alias("b")).join(far.select("a", "b", F.lit(True).alias("far")), ["a", "b"], "left")
        known = hit.agg(F.count_if((F.col("a") == F.col("b")) | F.col("far")).alias("known"))
    one = lambda df: F.broadcast(df.withColumn("__k", F.lit(1)))
    all_ = total.withColumn("__k", F.lit(1)).join(one(equal), "__k").join(one(apart), "__k").join(one(known), "__k")
    return all_.select("checked", (F.col("equal") + F.col("apart")).alias("found"), "known")


def title_links(rows: DataFrame, threshold: float = 0.7, key: str = "id", title: str = "label") -> tuple[DataFrame, DataFrame]:
    """``na, nb, score`` between titles of different words whose word sets have at least this Jaccard similarity, and
    ``key, name`` of the members of each: equal word sets are one class, named by its smallest key.

    Prefix filter: words are ordered rare first, and two such titles share a word among the
    first ``n - ceil(t n) + 1``.
    """
    sets = stored(rows.select(key, F.array_sort(word_set(F.col(title))).alias("words")).filter(F.size("words") > 0).distinct(), "titles")
    classes = stored(sets.groupBy("words").agg(F.min(key).alias("name")), "classes")
    flat = classes.select("name", "words", F.explode("words").alias("word"))
    df = flat.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    ranked = lookup_join(flat.select("name", "word"), df, ["word"]).groupBy("name").agg(F.array_sort(F.collect_list(F.struct("df", "word"))).alias("w"))
    n = F.size("w")
    prefix = ranked.select("name", F.transform("w", lambda x: x["word"]).alias("words"), F.explode(F.slice("w", F.lit(1), n - F.ceil(n * F.lit(threshold) - 1e-9).cast("int") + 1)).alias("p")).select("name", "words", "p.word")
    prefix = stored(prefix, "prefix")
    x, y = prefix.select(F.col("name").alias("na"), F.col("words").alias("wa"), "word"), prefix.select(F.col("name").alias("nb"), F.col("words").alias("wb"), "word")
    met = lookup_join(x, y, ["word"]).filter((F.col("na") < F.col("nb")) & (F.size("wa") * threshold <= F.size("wb") + 1e-9) & (F.size("wb") * threshold <= F.size("wa") + 1e-9))
    linked = met.select("na", "nb", jaccard(F.col("wa"), F.col("wb")).alias("score")).filter(F.col("score") >= threshold).distinct()
    return stored(linked, "links"), stored(lookup_join(sets, classes, ["words"]).select(key, "name"), "members")


def title_pairs(rows: DataFrame, threshold: float = 0.7, key: str = "id", title: str = "label") -> DataFrame:
    """``a, b, score``: ``title_links`` as pairs of rows; copies of a title are paired too, so there may be many."""
    linked, names = title_links(rows, threshold, key, title)
    ma, mb = names.select(F.col(key).alias("x"), F.col("name").alias("na")), names.select(F.col(key).alias("y"), F.col("name").alias("nb"))
    far = lookup_join(mb, lookup_join(ma, linked, ["na"]), ["nb"]).select("x", "y", "score")
    same = lookup_join(ma, mb.withColumnRenamed("nb", "na"), ["na"]).filter("x < y").select("x", "y", F.lit(1.0).alias("score"))
    return far.unionByName(same).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.round("score", 6).alias("score")).distinct()


def centroids(rows: DataFrame, group: str, vector: str = "embedding") -> DataFrame:
    """``group, centroid``: element-wise means; elements beyond the first row's length do not count."""
    flat = rows.select(group, F.posexplode(vector).alias("i", "x")).groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return flat.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("s")).select(group, F.transform("s", lambda e: F.round(e["m"], 6)).alias("centroid"))


def evaluate(results: DataFrame, golden: DataFrame, k: int = 10) -> DataFrame:
    """Mean reciprocal rank, recall at k and hit rate of ranked results (``query, id, rank``) against ``query, expected``."""
    want = golden.select("query", F.explode("expected").alias("id")).distinct()
    size = want.groupBy("query").agg(F.count(F.lit(1)).alias("wanted"))
    hits = results.filter(F.col("rank") <= k).join(want, ["query", "id"]).groupBy("query").agg(F.min("rank").alias("first"), F.countDistinct("id").alias("hits"))
    return _averaged(size.join(hits, "query", "left"))


def _averaged(per: DataFrame) -> DataFrame:
    return per.agg(
        F.count(F.lit(1)).alias("queries"),
        F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr"),
        F.round(F.avg(F.coalesce(F.col("hits") / F.col("wanted"), F.lit(0.0))), 6).alias("recall"),
        F.round(F.avg(F.when(F.col("hits") > 0, 1.0).otherwise(0.0)), 6).alias("hit_rate"),
    )


def evaluate_labels(results: DataFrame, queries: DataFrame, rows: DataFrame, k: int = 10) -> DataFrame:
    """``evaluate`` where every other row of the query's label is wanted: labels are counted, their rows never paired.

    ``results``: ``query, id, rank``; ``queries``: ``query, label``; ``rows``: ``id, label``. Queries alone under their label do not count.
    """
    size = rows.groupBy("label").agg((F.count(F.lit(1)) - 1).alias("wanted")).filter("wanted > 0")
    asked = queries.join(size, "label")
    hits = results.filter(F.col("rank") <= k).join(queries, "query").join(rows.withColumnRenamed("label", "own"), "id").filter("label = own").groupBy("query").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("hits"))
    return _averaged(asked.select("query", "wanted").join(hits, "query", "left"))


def hybrid(vector: DataFrame, near: DataFrame, tags: DataFrame | None = None, weights: tuple[float, float, float, float] = (0.5, 0.3, 0.15, 0.2)) -> DataFrame:
    """``query, id, score``: vector score, closeness in the graph (one hop, two hops) and shared tags, weighted and summed.

    ``vector``: ``query, id, score``; ``near``: ``query, id, depth``; ``tags``: ``query, id``.
    """
    wv, w1, w2, wt = weights
    parts = vector.select("query", "id", (F.col("score") * wv).alias("s")).unionByName(near.filter("depth <= 2").select("query", "id", F.when(F.col("depth") == 1, w1).otherwise(w2).alias("s")))
    if tags is not None:
        parts = parts.unionByName(tags.select("query", "id", F.lit(wt).alias("s")))
    # decimals add up to the same whatever the order
    return parts.groupBy("query", "id").agg(F.round(F.sum(F.col("s").cast("decimal(20,9)")), 6).cast("double").alias("score"))


def reconcile(documents: DataFrame, index: DataFrame) -> DataFrame:
    """``id, action``: what an index must do to follow the documents.

    ``documents``: ``id, file_hash, body_hash``; ``index``: the same and ``chunks``. New and
    changed documents are embedded, a changed file with the same body only gets new metadata,
    what is gone is deleted, an entry without chunks is embedded again.
    """
    d, i = documents.select("id", F.col("file_hash").alias("f1"), F.col("body_hash").alias("b1"), F.lit(True).alias("in_docs")), index.select("id", F.col("file_hash").alias("f2"), F.col("body_hash").alias("b2"), "chunks", F.lit(True).alias("in_index"))
    both = d.join(i, "id", "full_outer")
    action = (
        F.when(F.col("in_docs").isNull(), "delete")
        .when(F.col("in_index").isNull(), "embed")
        .when(F.coalesce("chunks", F.lit(0)) == 0, "embed")
        .when(F.col("f1").eqNullSafe(F.col("f2")), "keep")
        .when(F.col("b1").eqNullSafe(F.col("b2")), "metadata")
        .otherwise("embed")
    )
    return both.select("id", action.alias("action"))


def hashed_embeddings(texts: list[str | None], dim: int = 64) -> np.ndarray:
    """Deterministic vectors of word counts, for tests and offline use in place of a model."""
    import re
    import zlib

    out, place = np.zeros((len(texts), dim)), {}
    for k, t in enumerate(texts):
        for w in re.findall(r"[^\W_]+", (t or "").lower()):
            if w not in place:
                h = zlib.crc32(w.encode())
                place[w] = h % dim, 1 if h >> 31 else -1
            at, sign = place[w]
            out[k, at] += sign
    return _unit(out).astype(np.float32)


def embed(df: DataFrame, text: str, embedder=hashed_embeddings) -> DataFrame:
    """``df`` with ``embedding``; the embedder maps a list of texts to rows of numbers, a batch at a time."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(list(np.nan_to_num(np.asarray(embedder(s.tolist()), np.float32))), dtype=object)

    return df.withColumn("embedding", run(F.col(text)))
