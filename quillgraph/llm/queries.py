"""Queries of the operators for training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.canonical import canonical_values
from quillgraph.llm.chunking import pieces, rebuilt, split_documents
from quillgraph.llm.contamination import leaked, without_leaks
from quillgraph.llm.near_duplicates import NearDuplicates
from quillgraph.llm.packing import pack, token_counts, unused
from quillgraph.llm.subjects import assign, train
from quillgraph.llm.survivors import record_instant, seniority, survivors
from quillgraph.session import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    split = split_documents(table(spark, sf, "pkb_documents"), table(spark, sf, "chunk_configs"), texts=False)
    return split.filter(F.size("pieces") > 1).select("id", "config_id", "cut").distinct()


def p1_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """All pieces of all documents."""
    return pieces(table(spark, sf, "pkb_documents"), table(spark, sf, "chunk_configs"))


def p1_rebuilt(spark: SparkSession, sf: str) -> DataFrame:
    """Bodies put together again from their pieces, with pieces over the limit or without their overlap counted."""
    return rebuilt(table(spark, sf, "pkb_documents"), table(spark, sf, "chunk_configs"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return NearDuplicates(table(spark, sf, "pkb_documents"), size=3, min_words=20, threshold=0.5).pairs().select("id_a", "id_b")


def p2_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Five-word runs, similarity 0.8: class and number of links of every document."""
    return NearDuplicates(table(spark, sf, "pkb_documents"), size=5, min_words=20, threshold=0.8).groups()


def _typed(spark: SparkSession, sf: str) -> DataFrame:
    return canonical_values(table(spark, sf, "document_entries"), "entry_id", ["status", "doc_type"], table(spark, sf, "canonical_values"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return _typed(spark, sf).select("entry_id", "field", "value_id").distinct()


def p3_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    """Values that mean nothing on the list, with how often they were typed."""
    return _typed(spark, sf).filter("value_id = 0").groupBy("field", "raw").agg(F.countDistinct("entry_id").alias("entries"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """The id and the three fields are bundles of their own: the id goes by seniority, the fields by the time modified."""
    fields = ["status", "assignee", "due"]
    late = [record_instant(F.col("modified"))]
    kept = survivors(table(spark, sf, "duplicate_entries"), {"canonical": ["id"]} | {f: [f] for f in fields}, {"canonical": seniority()} | dict.fromkeys(fields, late))
    return kept.select("cluster_id", F.col("bundle").alias("field"), "id")


def p6_records(spark: SparkSession, sf: str) -> DataFrame:
    """Survivors built from bundles: status and assignee go together, and a due date must have been seen with them."""
    entries = table(spark, sf, "duplicate_entries")
    return survivors(entries, {"work": ["status", "assignee"], "due": ["due"]}, record_instant(F.col("modified")), [("work", "due")]).select("cluster_id", "bundle", "id", "consistent")


def p8_containers(spark: SparkSession, sf: str) -> DataFrame:
    """The container of every text, for every capacity."""
    return pack(token_counts(table(spark, sf, "documents")), table(spark, sf, "pack_limits"))


def p8_unused(spark: SparkSession, sf: str) -> DataFrame:
    """Containers and room left unused, for every capacity."""
    return unused(p8_containers(spark, sf))


def p8_complete(spark: SparkSession, sf: str) -> DataFrame:
    """For every capacity: texts put somewhere, containers over it, and texts that are neither whole nor cut only because they must be."""
    packed = p8_containers(spark, sf)
    per = packed.groupBy("limit_id", "capacity", "container").agg(F.sum("tokens").alias("held"))
    over = per.groupBy("limit_id", "capacity").agg(F.count_if(F.col("held") > F.col("capacity")).alias("overfull"))
    texts = packed.groupBy("limit_id", "doc_id", "capacity").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("parts"), F.min("part").alias("first"))
    sound = F.when(F.col("tokens") > F.col("capacity"), F.col("parts") == F.ceil(F.col("tokens") / F.col("capacity"))).otherwise((F.col("parts") == 1) & (F.col("first") == 0))
    return texts.groupBy("limit_id").agg(F.count(F.lit(1)).alias("texts"), F.count_if(~sound).alias("misplaced")).join(over, "limit_id").select("limit_id", "capacity", "texts", "misplaced", "overfull")


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaked(table(spark, sf, "documents"), table(spark, sf, "eval_items")).select("doc_id", "item_id").distinct()


def p9_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Longest verbatim match of every leaked item, with its place in the document."""
    return leaked(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p9_clean(spark: SparkSession, sf: str) -> DataFrame:
    """What is left of each source once affected documents are removed."""
    return without_leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items")).groupBy("source").agg(F.count(F.lit(1)).alias("documents"))


def _subjects(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents")
    return assign(documents, train(documents, table(spark, sf, "subject_labels"), table(spark, sf, "subjects")))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return _subjects(spark, sf).select("doc_id", "subject_id").distinct()


def p10_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of each subject, and their share of the collection."""
    names = table(spark, sf, "subjects").select("subject_id", "name")
    total = table(spark, sf, "documents").agg(F.countDistinct("doc_id").alias("total"))
    per = _subjects(spark, sf).groupBy("subject_id").agg(F.countDistinct("doc_id").alias("documents"))
    whole = F.broadcast(total.withColumn("one", F.lit(1)))
    return per.join(names, "subject_id").withColumn("one", F.lit(1)).join(whole, "one").select("subject_id", "name", "documents", F.round(F.col("documents") / F.col("total"), 4).alias("share"))


QUERIES = {f.__name__: f for f in (p1_found, p1_pieces, p1_rebuilt, p2_found, p2_groups, p3_found, p3_unmatched, p6_found, p6_records, p8_containers, p8_unused, p8_complete, p9_found, p9_matches, p9_clean, p10_found, p10_shares)}


def _instant(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '([Zz]|[+-][0-9]{{2}}:?[0-9]{{2}})$') AND regexp_matches({c}, ':') THEN epoch_us(try_cast({c} AS TIMESTAMPTZ)) ELSE epoch_us(try_cast({c} AS TIMESTAMP)) END"


_SAYS = "NOT coalesce(lower(trim(v)), '') IN ('', '?', '-', 'n/a', 'na', 'none', 'null', 'nil', 'tbd', 'unknown')"
_ENTRIES = f"t AS (SELECT *, {_instant('created')} AS c, {_instant('modified')} AS m FROM (SELECT DISTINCT * FROM duplicate_entries))"
_WORDS = "w AS (SELECT id, list_filter(regexp_split_to_array(lower(coalesce(title, '') || chr(10) || coalesce(body, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w, len(list_filter(regexp_split_to_array(lower(coalesce(body, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS n FROM (SELECT DISTINCT id, title, body FROM pkb_documents))"
_RUNS = "s AS (SELECT DISTINCT id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE n >= 20)), z AS (SELECT id, count(*) AS n FROM s GROUP BY id)"

_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_BODIES = f"d AS (SELECT DISTINCT p.id, c.config_id, c.chunk_size, {_STRIP.format("replace(coalesce(p.body, ''), chr(13), '')")} AS t FROM pkb_documents p JOIN chunk_configs c ON c.config_id = coalesce(p.config_id, (SELECT config_id FROM chunk_configs WHERE is_default)))"
_LINES = "l AS (SELECT id, config_id, chunk_size, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d WHERE strlen(t) > chunk_size), f AS (SELECT *, regexp_matches(line, '^\\s*```') AS fence, count(*) FILTER (regexp_matches(line, '^\\s*```')) OVER (PARTITION BY id ORDER BY i) AS k FROM l), b AS (SELECT *, NOT fence AND k % 2 = 0 AND trim(line) = '' AS gap FROM f), g AS (SELECT *, count(*) FILTER (gap) OVER (PARTITION BY id ORDER BY i) AS block FROM b)"



def _plain(c: str) -> str:
    """A text without what the comparison passes over; of entities those that these texts may hold."""
    for raw, to in (("&#39;", "''"), ("&apos;", "''"), ("&quot;", '"'), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        c = f"replace({c}, '{raw}', '{to}')"
    for pattern, to in (
        ("(?i)</?(?:a|abbr|b|code|del|em|font|i|ins|kbd|mark|q|s|small|span|strong|sub|sup|tt|u)(?:\\s[^<>]*)?/?>", ""),
        ("</?[a-zA-Z!][^<>]*>", " "),
        ("[\\x{AD}\\x{34F}\\x{61C}\\x{180B}-\\x{180E}\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2060}-\\x{206F}\\x{FE00}-\\x{FE0F}\\x{FEFF}]", ""),
        ("\\]\\([^()\\s]*(?:\\s+\"[^\"]*\")?\\)|\\[\\[[^\\]|\\n]*\\|", ""),
        ("(?m)^[ \\t>]*(?:(?:[-+*]|\\d{1,3}[.)])[ \\t]+)?(?:\\[[ xX]\\][ \\t]+)?", ""),
        ("[*`~\\\\]+", ""),
    ):
        c = f"regexp_replace({c}, '{pattern}', '{to}', 'g')"
    return f"lower({c})"


# words parted at a line end keep a mark until it is known whether a passage has the joined word
_ITEM_WORDS = f"p AS (SELECT DISTINCT item_id, regexp_extract_all({_plain('passage')}, '[\\p{{L}}\\p{{N}}]+') AS w FROM eval_items WHERE passage IS NOT NULL), kn AS (SELECT list(DISTINCT x) AS k FROM (SELECT unnest(w) AS x FROM p))"
_DOC_WORDS = f"q AS (SELECT DISTINCT doc_id, regexp_extract_all(regexp_replace({_plain('text')}, '([\\p{{L}}\\p{{N}}]+)[-‐‑][ \\t]*\\r?\\n[ \\t>]*([\\p{{L}}\\p{{N}}]+)', '\\1⁞\\2', 'g'), '[\\p{{L}}\\p{{N}}⁞]+') AS w FROM documents WHERE text <> ''), d AS (SELECT doc_id, flatten(list_transform(w, lambda x: CASE WHEN NOT contains(x, '⁞') THEN [x] WHEN list_contains(k, replace(x, '⁞', '')) THEN [replace(x, '⁞', '')] ELSE string_split(x, '⁞') END)) AS w FROM q, kn)"
_EIGHTS = "ir AS (SELECT item_id, len(w) AS n, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 6)) AS i FROM p WHERE len(w) >= 8)), dr AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)) WHERE g IN (SELECT g FROM ir)), cv AS (SELECT dr.doc_id, ir.item_id, any_value(ir.n) AS n, len(list_distinct(flatten(list(range(ir.i, ir.i + 8))))) AS covered FROM dr JOIN ir ON ir.g = dr.g GROUP BY 1, 2)"
_LEAKED = f"WITH {_ITEM_WORDS}, {_DOC_WORDS}, {_EIGHTS}, lk AS (SELECT doc_id, item_id, n, covered FROM cv WHERE covered >= 0.3 * n - 1e-9)"

# distinct texts, their runs of five words, links between texts, and what is joined over links and copies
_TEXTS = "tx AS (SELECT row_number() OVER (ORDER BY k) AS t, k, b FROM (SELECT DISTINCT coalesce(title, '') || chr(10) || coalesce(body, '') AS k, coalesce(body, '') AS b FROM pkb_documents)), ids AS (SELECT DISTINCT d.id, tx.t FROM pkb_documents d JOIN tx ON tx.k = coalesce(d.title, '') || chr(10) || coalesce(d.body, '') AND tx.b = coalesce(d.body, ''))"
_FIVES = "w5 AS (SELECT t, list_filter(regexp_split_to_array(lower(k), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w, len(list_filter(regexp_split_to_array(lower(b), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS n FROM tx), s5 AS (SELECT DISTINCT t, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT t, w, unnest(range(1, len(w) - 3)) AS i FROM w5 WHERE n >= 20)), z5 AS (SELECT t, count(*) AS n FROM s5 GROUP BY t)"
_LINKED = "l AS (SELECT x.a, x.b FROM (SELECT a.t AS a, b.t AS b, count(*) AS k FROM s5 a JOIN s5 b ON a.g = b.g AND a.t <> b.t GROUP BY 1, 2) x JOIN z5 za ON za.t = x.a JOIN z5 zb ON zb.t = x.b WHERE x.k >= 0.8 * (za.n + zb.n - x.k)), c AS (SELECT t, t AS r FROM tx UNION SELECT c.t, l.b FROM c JOIN l ON l.a = c.r), m AS (SELECT c.t, min(ids.id) AS low FROM c JOIN ids ON ids.t = c.r GROUP BY 1), g AS (SELECT a AS t, count(*) AS n FROM l GROUP BY 1)"

# values of a group by trust, each with the record that lends it most, and every way to put work and due together
_PARTS = f"v AS (SELECT cluster_id, id, m, CASE WHEN {_SAYS.replace('v)', 'status)')} THEN status END AS st, CASE WHEN {_SAYS.replace('v)', 'assignee)')} THEN assignee END AS asg, CASE WHEN {_SAYS.replace('v)', 'due)')} THEN due END AS du FROM t)"
_RANKED = "(SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY m DESC NULLS LAST, id) AS r FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY m DESC NULLS LAST, id) AS first FROM v WHERE {says}) WHERE first = 1)"

ORACLES = {
    "p2_groups": f"WITH RECURSIVE {_TEXTS}, {_FIVES}, {_LINKED} SELECT ids.id, min(m.low) AS class_id, max(coalesce(g.n, 0)) AS links FROM ids JOIN m ON m.t = ids.t LEFT JOIN g ON g.t = ids.t GROUP BY 1",
    "p6_records": f"WITH {_ENTRIES}, {_PARTS}, wk AS {_RANKED.format(k='cluster_id, st, asg', says='st IS NOT NULL OR asg IS NOT NULL')}, du AS {_RANKED.format(k='cluster_id, du', says='du IS NOT NULL')}, pr AS (SELECT DISTINCT cluster_id, st, asg, du FROM v WHERE du IS NOT NULL AND (st IS NOT NULL OR asg IS NOT NULL)), cb AS (SELECT coalesce(wk.cluster_id, du.cluster_id) AS cluster_id, wk.id AS w, du.id AS d, row_number() OVER (PARTITION BY coalesce(wk.cluster_id, du.cluster_id) ORDER BY coalesce(wk.r, 0) + coalesce(du.r, 0), wk.r) AS k FROM wk FULL JOIN du ON du.cluster_id = wk.cluster_id WHERE wk.id IS NULL OR du.id IS NULL OR NOT EXISTS (SELECT 1 FROM pr WHERE pr.cluster_id = wk.cluster_id AND pr.st IS NOT DISTINCT FROM wk.st AND pr.asg IS NOT DISTINCT FROM wk.asg) OR EXISTS (SELECT 1 FROM pr WHERE pr.cluster_id = wk.cluster_id AND pr.st IS NOT DISTINCT FROM wk.st AND pr.asg IS NOT DISTINCT FROM wk.asg AND pr.du = du.du)) SELECT cluster_id, 'work' AS bundle, w AS id, true AS consistent FROM cb WHERE k = 1 AND w IS NOT NULL UNION ALL SELECT cluster_id, 'due', d, true FROM cb WHERE k = 1 AND d IS NOT NULL",
    "p1_rebuilt": f"WITH {_BODIES} SELECT DISTINCT id, config_id, strlen(t) AS bytes, sha256(t) AS body_hash, 0 AS over, 0 AS lacking FROM d WHERE t <> ''",
    "p1_found": f"WITH {_BODIES}, {_LINES} SELECT id, config_id, CASE WHEN max(strlen(t)) > any_value(chunk_size) THEN 'inside' ELSE 'between' END AS cut FROM (SELECT id, config_id, chunk_size, block, {_STRIP.format("string_agg(line, chr(10) ORDER BY i) FILTER (NOT gap)")} AS t FROM g GROUP BY ALL) GROUP BY id, config_id",
    "p2_found": f"WITH {_WORDS}, {_RUNS} SELECT x.a AS id_a, x.b AS id_b FROM (SELECT a.id AS a, b.id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2) x JOIN z za ON za.id = x.a JOIN z zb ON zb.id = x.b WHERE x.k >= 0.5 * (za.n + zb.n - x.k)",
    "p8_complete": "SELECT limit_id, capacity_tokens AS capacity, (SELECT count(DISTINCT doc_id) FROM documents WHERE text <> '') AS texts, 0 AS misplaced, 0 AS overfull FROM pack_limits",
    "p9_found": f"{_LEAKED} SELECT doc_id, item_id FROM lk",
    "p9_matches": f"{_LEAKED}, dp AS (SELECT DISTINCT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8 AND doc_id IN (SELECT doc_id FROM lk))), ht AS (SELECT dp.doc_id, ir.item_id, dp.i AS pos, dp.i - ir.i AS diag FROM dp JOIN ir ON ir.g = dp.g JOIN lk ON lk.doc_id = dp.doc_id AND lk.item_id = ir.item_id), sl AS (SELECT doc_id, item_id, diag, pos - row_number() OVER (PARTITION BY doc_id, item_id, diag ORDER BY pos) AS s, pos FROM ht), ln AS (SELECT doc_id, item_id, count(*) + 7 AS longest, min(pos) - 1 AS at_word FROM sl GROUP BY doc_id, item_id, diag, s), bs AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY longest DESC, at_word) AS r FROM ln) SELECT lk.doc_id, lk.item_id, CAST(lk.n AS INTEGER) AS words, CAST(lk.covered AS INTEGER) AS covered, CAST(bs.longest AS INTEGER) AS longest, CAST(bs.at_word AS INTEGER) AS at_word FROM lk JOIN bs ON bs.doc_id = lk.doc_id AND bs.item_id = lk.item_id AND bs.r = 1",
    "p9_clean": f"{_LEAKED} SELECT source, count(*) AS documents FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM lk) GROUP BY 1",
    "p6_found": f"WITH {_ENTRIES} SELECT cluster_id, 'canonical' AS field, id FROM (SELECT cluster_id, id, row_number() OVER (PARTITION BY cluster_id ORDER BY c NULLS LAST, n_children DESC, word_count DESC, id) AS r FROM t) WHERE r = 1 UNION ALL SELECT cluster_id, field, id FROM (SELECT cluster_id, field, id, row_number() OVER (PARTITION BY cluster_id, field ORDER BY m DESC NULLS LAST, id) AS r FROM (SELECT cluster_id, id, m, 'status' AS field, status AS v FROM t UNION ALL SELECT cluster_id, id, m, 'assignee', assignee FROM t UNION ALL SELECT cluster_id, id, m, 'due', due FROM t) WHERE {_SAYS}) WHERE r = 1",
}
