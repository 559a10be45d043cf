"""Pieces of SQL that several comparison queries share."""

from __future__ import annotations


def key(c: str) -> str:
    """The key of a written reference, as ``refs.reference_key`` makes it."""

    def blank(x: str) -> str:
        return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"

    s = blank(f"regexp_replace(coalesce({c}, ''), '[|#].*$', '', 's')")
    s = f"regexp_replace(regexp_replace({s}, '^\\[\\[|\\]\\]$', '', 'g'), '^.*/', '', 's')"
    return blank(f"regexp_replace(lower({blank(s)}), '\\.md$', '')")


NODES = "n AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY recorded_at DESC, deleted_at IS NULL DESC) AS rn FROM graph_nodes WHERE id IS NOT NULL) WHERE rn = 1)"
KEYS = "k AS (SELECT key, min(id) AS id FROM (SELECT lower(id) AS key, id FROM n UNION ALL SELECT lower(permalink), id FROM n WHERE permalink IS NOT NULL) GROUP BY key)"
EDGES = f"e AS (SELECT DISTINCT x.source, k.id AS target, x.type FROM edges x JOIN k ON {key('x.target')} = k.key WHERE x.source <> k.id)"
PARENTS = f"p AS (SELECT n.id, k.id AS parent FROM n LEFT JOIN k ON {key('n.parent')} = k.key AND {key('n.parent')} <> '')"


def words(items: list[str]) -> str:
    """``('a', 'b')``."""
    return "(" + ", ".join(f"'{w}'" for w in items) + ")"
