"""Queries of the general problems: hierarchies, instants, orphan references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.duck import KEYS, NODES, key, words
from quillgraph.operators.hierarchy import all_descendants, all_paths, descendants, hierarchy, resolved_parents
from quillgraph.operators.references import broken_references, orphan_counts, parent_keys, written_references
from quillgraph.operators.timestamps import MONTHS, ZONES, InstantDictionary, normalise_instants
from quillgraph.session import shared_dir, stored, table

TIMES = ["date", "modified", "consolidated_at"]


def _solved(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy(resolved_parents(table(spark, sf, "graph_nodes")))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return _solved(spark, sf).select("id", "root", "depth", "below")


def p4_circles(spark: SparkSession, sf: str) -> DataFrame:
    """Circles found, with their members counted and what hangs from them."""
    s = _solved(spark, sf).filter("depth < 0")
    return s.groupBy("root").agg(F.sum(F.when(F.col("depth") == -1, 1).otherwise(0)).alias("members"), F.sum(F.when(F.col("depth") == -2, 1).otherwise(0)).alias("hanging"))


def p4_paths(spark: SparkSession, sf: str) -> DataFrame:
    return all_paths(_solved(spark, sf)).select("id", "root", "depth", F.array_join("path", "/").alias("path"))


def p4_beneath(spark: SparkSession, sf: str) -> DataFrame:
    return descendants(_solved(spark, sf))


def p4_all_beneath(spark: SparkSession, sf: str) -> DataFrame:
    """Circles and what hangs from them too, which the SQL of ``p4_beneath`` leaves out."""
    links = stored(resolved_parents(table(spark, sf, "graph_nodes")), "links")
    return all_descendants(stored(hierarchy(links), "solved"), links)


#: The dictionary of instants is kept under this name; rules that change need a new one.
INSTANTS = "instants-2"


def _instants(spark: SparkSession, sf: str) -> DataFrame:
    """The dictionary stays in the shared folder and is extended by what it lacks."""
    book = InstantDictionary(spark, f"{shared_dir(spark)}/{INSTANTS}")
    return normalise_instants(table(spark, sf, "document_entries"), "entry_id", TIMES, "tz", "locale", book)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _instants(spark, sf).filter("epoch_us IS NOT NULL").select("entry_id", "field", "epoch_us").distinct()


def p5_unreadable(spark: SparkSession, sf: str) -> DataFrame:
    return _instants(spark, sf).filter("epoch_us IS NULL").select("entry_id", "field", "raw").distinct()


def _broken(spark: SparkSession, sf: str) -> DataFrame:
    parents = parent_keys(table(spark, sf, "graph_nodes"), table(spark, sf, "projects"))
    children = written_references(table(spark, sf, "doc_fields"), "doc_fields", "req_id", ["parent", "depends_on"]).unionByName(written_references(table(spark, sf, "edges"), "edges", "edge_id", ["target"]))
    return broken_references(parents, children)


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return _broken(spark, sf)


def p7_counts(spark: SparkSession, sf: str) -> DataFrame:
    return orphan_counts(_broken(spark, sf))


QUERIES = {f.__name__: f for f in (p4_found, p4_circles, p4_paths, p4_beneath, p4_all_beneath, p5_found, p5_unreadable, p7_found, p7_counts)}

_PARENTS = f"p AS (SELECT n.id, k.id AS parent FROM n LEFT JOIN k ON {key('n.parent')} = k.key AND {key('n.parent')} <> '')"
_REACH = "r AS (SELECT id, parent AS up FROM p WHERE parent IS NOT NULL UNION SELECT r.id, p.parent FROM r JOIN p ON p.id = r.up WHERE p.parent IS NOT NULL), c AS (SELECT id FROM r WHERE id = up)"
_LOW = "(SELECT id, min(up) AS low FROM r WHERE up IN (SELECT id FROM c) GROUP BY 1)"
_FOREST = f"WITH RECURSIVE {NODES}, {KEYS}, {_PARENTS}, {_REACH}"

_WRITTEN = (
    "w AS (SELECT 'doc_fields' AS tab, req_id AS row_id, 'parent' AS field, parent AS ref, recorded_at FROM doc_fields"
    " UNION ALL SELECT 'doc_fields', req_id, 'depends_on', unnest(depends_on), recorded_at FROM doc_fields"
    " UNION ALL SELECT 'edges', edge_id, 'target', target, recorded_at FROM edges)"
)
_BROKEN = (
    f"WITH {NODES}, {KEYS}, {_WRITTEN}, f AS (SELECT id, min(recorded_at) AS first_at FROM graph_nodes GROUP BY id),"
    f" x AS (SELECT DISTINCT w.tab, w.row_id, w.field, w.ref, CASE WHEN k.id IS NULL THEN 'missing' WHEN f.first_at > w.recorded_at THEN 'late' WHEN n.deleted_at <= w.recorded_at THEN 'deleted' END AS kind, strftime(w.recorded_at, '%Y-%m') AS period"
    f" FROM w LEFT JOIN k ON k.key = {key('w.ref')} LEFT JOIN n ON n.id = k.id LEFT JOIN f ON f.id = k.id WHERE {key('w.ref')} <> '' AND {key('w.ref')} NOT IN (SELECT lower(slug) FROM projects))"
)

_NAME = "|".join(sorted((n for v in MONTHS.values() for n in v.split()), key=lambda n: (-len(n), n)))
_MONTH = "CASE " + " ".join(f"WHEN m IN {words(v.split())} THEN {k}" for k, v in MONTHS.items()) + " ELSE TRY_CAST(m AS INTEGER) END"
_OFFSET = "CASE " + " ".join(f"WHEN z = '{k}' THEN {(1 if v[0] == '+' else -1) * (int(v[1:3]) * 60 + int(v[4:]))}" for k, v in ZONES.items()) + " WHEN regexp_matches(z, '^(?:utc|gmt)?[+-]') THEN CASE WHEN contains(z, '-') THEN -1 ELSE 1 END * (60 * CAST(regexp_extract(z, '[+-](\\d{1,2})', 1) AS INTEGER) + coalesce(TRY_CAST(regexp_extract(z, '[+-]\\d{1,2}?:?(\\d{2})$', 1) AS INTEGER), 0) * CASE WHEN regexp_matches(z, '[+-]\\d{1,2}$') THEN 0 ELSE 1 END) END"
_ZONED = "((?:utc|gmt)?[+-]\\d{1,2}(?::?\\d{2})?|[a-z]{1,5})?"
# the steps of the operator once more: text without weekday and zone in brackets, day, clock, wall time, instant
_INSTANTS = (
    "WITH r AS (SELECT DISTINCT entry_id, field, v AS raw, coalesce(nullif(trim(tz), ''), 'UTC') AS tz, coalesce(locale, '') = 'en_US' AS us FROM (SELECT entry_id, 'date' AS field, date AS v, tz, locale FROM document_entries UNION ALL SELECT entry_id, 'modified', modified, tz, locale FROM document_entries UNION ALL SELECT entry_id, 'consolidated_at', consolidated_at, tz, locale FROM document_entries) WHERE regexp_matches(v, '[^\\s\\p{Z}\\p{Cf}]')),"
    " a AS (SELECT *, lower(translate(regexp_replace(raw, '^[\\s\\p{Z}\\p{Cf}]+|[\\s\\p{Z}\\p{Cf}]+$', '', 'g'), '−–', '--')) AS l, regexp_extract(raw, '\\[([^\\]]*)\\]\\s*$', 1) AS zin FROM r),"
    " b AS (SELECT *, regexp_replace(regexp_replace(l, '^(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\\.?,?\\s+|^\\p{L}+tag,\\s+|^(?:lundi|mardi|mercredi|jeudi|vendredi|samedi|dimanche),?\\s+', ''), '\\[[^\\]]*\\]$', '') AS s FROM a),"
    f" c AS (SELECT *, CASE WHEN regexp_matches(s, '^\\d{{4}}[-/.]\\d{{1,2}}[-/.]\\d{{1,2}}($|t|,?\\s)') THEN regexp_replace(s, '^(\\d{{4}})[-/.](\\d{{1,2}})[-/.](\\d{{1,2}})(?:t|,?\\s+)?', '\\1|\\2|\\3|') WHEN regexp_matches(s, '^\\d{{8}}($|[t\\s])') THEN regexp_replace(s, '^(\\d{{4}})(\\d{{2}})(\\d{{2}})[t\\s]*', '\\1|\\2|\\3|') WHEN us AND regexp_matches(s, '^\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}(,?\\s|$)') THEN regexp_replace(s, '^(\\d{{1,2}})/(\\d{{1,2}})/(\\d{{4}}),?\\s*', '\\3|\\1|\\2|') WHEN regexp_matches(s, '^\\d{{1,2}}[-/.]\\d{{1,2}}[-/.]\\d{{4}}(,?\\s|$)') THEN regexp_replace(s, '^(\\d{{1,2}})[-/.](\\d{{1,2}})[-/.](\\d{{4}}),?\\s*', '\\3|\\2|\\1|')"
    f" WHEN regexp_matches(s, '^\\d{{1,2}}(?:\\.|st|nd|rd|th|er)?\\s+(?:de\\s+)?(?:{_NAME})\\.?,?\\s+(?:de\\s+)?\\d{{4}}(,?\\s|$)') THEN regexp_replace(s, '^(\\d{{1,2}})(?:\\.|st|nd|rd|th|er)?\\s+(?:de\\s+)?({_NAME})\\.?,?\\s+(?:de\\s+)?(\\d{{4}}),?\\s*', '\\3|\\2|\\1|') WHEN regexp_matches(s, '^(?:{_NAME})\\.?\\s+\\d{{1,2}}(?:st|nd|rd|th)?,?\\s+\\d{{4}}(,?\\s|$)') THEN regexp_replace(s, '^({_NAME})\\.?\\s+(\\d{{1,2}})(?:st|nd|rd|th)?,?\\s+(\\d{{4}}),?\\s*', '\\3|\\1|\\2|') END AS p FROM b),"
    " d AS (SELECT *, TRY_CAST(split_part(p, '|', 1) AS INTEGER) AS y, split_part(p, '|', 2) AS m, TRY_CAST(split_part(p, '|', 3) AS INTEGER) AS dd, trim(regexp_replace(split_part(p, '|', 4), '^(at|um|à)\\s+', '')) AS t FROM c),"
    f" e AS (SELECT *, CASE WHEN t = '' THEN '0|0|0|||' WHEN regexp_matches(t, '^\\d{{1,2}}[:h]\\d{{2}}(?::\\d{{2}}(?:[.,]\\d+)?)?\\s*(?:am|pm|a\\.m\\.|p\\.m\\.|uhr)?\\s*{_ZONED}$') THEN regexp_replace(t, '^(\\d{{1,2}})[:h](\\d{{2}})(?::(\\d{{2}})(?:[.,](\\d+))?)?\\s*(am|pm|a\\.m\\.|p\\.m\\.|uhr)?\\s*{_ZONED}$', '\\1|\\2|\\3|\\4|\\5|\\6') WHEN regexp_matches(t, '^\\d{{4}}(?:\\d{{2}})?(?:[.,]\\d+)?\\s*{_ZONED}$') THEN regexp_replace(t, '^(\\d{{2}})(\\d{{2}})(\\d{{2}})?(?:[.,](\\d+))?\\s*{_ZONED}$', '\\1|\\2|\\3|\\4||\\5') END AS q FROM d),"
    f" f AS (SELECT *, {_MONTH} AS mo, TRY_CAST(split_part(q, '|', 1) AS INTEGER) AS h0, TRY_CAST(split_part(q, '|', 2) AS INTEGER) AS mi, coalesce(TRY_CAST(nullif(split_part(q, '|', 3), '') AS INTEGER), 0) AS se, CAST(rpad(substr(split_part(q, '|', 4), 1, 6), 6, '0') AS BIGINT) AS us6, substr(split_part(q, '|', 5), 1, 1) AS half, split_part(q, '|', 6) AS z FROM e),"
    " g AS (SELECT *, CASE WHEN half IN ('a', 'p') THEN CASE WHEN h0 BETWEEN 1 AND 12 THEN h0 % 12 + CASE WHEN half = 'p' THEN 12 ELSE 0 END END ELSE h0 END AS h FROM f),"
    f" w AS (SELECT *, CASE WHEN h <= 23 AND mi <= 59 AND se <= 59 THEN TRY_CAST(printf('%04d-%02d-%02d %02d:%02d:%02d', y, mo, dd, h, mi, se) AS TIMESTAMP) END AS wall, {_OFFSET} AS off FROM g),"
    " x AS (SELECT *, timezone(CASE WHEN zin <> '' THEN zin ELSE tz END, wall) AS i FROM w),"
    " o AS (SELECT entry_id, field, raw, CASE WHEN regexp_matches(s, '^-?\\d+(\\.\\d+)?$') AND NOT regexp_matches(s, '^\\d{8}$') THEN CASE WHEN regexp_matches(s, '^-?\\d{13}$') THEN CAST(s AS BIGINT) * 1000 WHEN regexp_matches(s, '^-?\\d{1,12}$') THEN CAST(s AS BIGINT) * 1000000 WHEN regexp_matches(s, '^\\d{9,11}\\.\\d+$') THEN CAST(split_part(s, '.', 1) AS BIGINT) * 1000000 + CAST(rpad(substr(split_part(s, '.', 2), 1, 6), 6, '0') AS BIGINT) END"
    " WHEN q IS NULL THEN NULL WHEN z <> '' THEN epoch_us(wall) + us6 - CAST(off AS BIGINT) * 60000000 ELSE us6 + epoch_us(CASE WHEN timezone(CASE WHEN zin <> '' THEN zin ELSE tz END, i - INTERVAL 1 HOUR) = wall THEN i - INTERVAL 1 HOUR WHEN timezone(CASE WHEN zin <> '' THEN zin ELSE tz END, i - INTERVAL 30 MINUTE) = wall THEN i - INTERVAL 30 MINUTE ELSE i END) END AS epoch_us FROM x)"
)

ORACLES = {
    "p5_found": f"{_INSTANTS} SELECT DISTINCT entry_id, field, epoch_us FROM o WHERE epoch_us IS NOT NULL",
    "p5_unreadable": f"{_INSTANTS} SELECT DISTINCT entry_id, field, raw FROM o WHERE epoch_us IS NULL",
    "p4_found": f"{_FOREST} SELECT p.id, coalesce(l.low, t.top, p.id) AS root, CAST(CASE WHEN p.id IN (SELECT id FROM c) THEN -1 WHEN l.low IS NOT NULL THEN -2 ELSE coalesce(a.n, 0) END AS INTEGER) AS depth, CAST(coalesce(b.n, 0) AS INTEGER) AS below FROM p LEFT JOIN {_LOW} l ON l.id = p.id LEFT JOIN (SELECT id, max(up) AS top FROM r WHERE up IN (SELECT id FROM p WHERE parent IS NULL) GROUP BY 1) t ON t.id = p.id LEFT JOIN (SELECT id, count(*) AS n FROM r GROUP BY 1) a ON a.id = p.id LEFT JOIN (SELECT up, count(*) AS n FROM r WHERE id <> up GROUP BY 1) b ON b.up = p.id",
    "p4_circles": f"{_FOREST} SELECT low AS root, count(*) FILTER (id IN (SELECT id FROM c)) AS members, count(*) FILTER (id NOT IN (SELECT id FROM c)) AS hanging FROM {_LOW} GROUP BY 1",
    "p4_beneath": f"{_FOREST}, d AS (SELECT id, count(*) AS depth FROM r WHERE id NOT IN (SELECT id FROM {_LOW}) GROUP BY 1) SELECT r.up AS ancestor, r.id, CAST(d.depth - coalesce(u.depth, 0) AS INTEGER) AS steps FROM r JOIN d ON d.id = r.id LEFT JOIN d u ON u.id = r.up",
    # paths run down from roots and from the nodes of circles; what is on a circle is its own path
    "p4_paths": f"{_FOREST}, t AS (SELECT id, id AS path, id AS top, 0 AS deep FROM p WHERE parent IS NULL OR id IN (SELECT id FROM c) UNION ALL SELECT p.id, t.path || '/' || p.id, t.top, t.deep + 1 FROM t JOIN p ON p.parent = t.id WHERE p.id NOT IN (SELECT id FROM c)) SELECT t.id, coalesce(l.low, t.top) AS root, CAST(CASE WHEN t.id IN (SELECT id FROM c) THEN -1 WHEN l.low IS NOT NULL THEN -2 ELSE t.deep END AS INTEGER) AS depth, t.path FROM t LEFT JOIN {_LOW} l ON l.id = t.id",
    "p4_all_beneath": f"{_FOREST}, x AS (SELECT id, parent AS up, 1 AS s FROM p WHERE parent IS NOT NULL UNION ALL SELECT x.id, p.parent, x.s + 1 FROM x JOIN p ON p.id = x.up WHERE p.parent IS NOT NULL AND x.s < 3000 AND NOT (x.up IN (SELECT id FROM c) AND x.s > 500)) SELECT up AS ancestor, id, CAST(min(s) AS INTEGER) AS steps FROM x WHERE id <> up GROUP BY 1, 2",
    "p7_found": f"{_BROKEN} SELECT * FROM x WHERE kind IS NOT NULL",
    "p7_counts": f"{_BROKEN} SELECT tab, field, kind, period, count(*) AS n FROM x WHERE kind IS NOT NULL GROUP BY ALL",
}
