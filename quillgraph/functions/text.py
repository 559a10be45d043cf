"""Text expressions: slugs, byte-safe cuts, links, tags, headings, durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slugify(c: Column, most: int = 80) -> Column:
    """Lower-case letters and digits joined by single hyphens, cut at ``most`` bytes without a trailing hyphen."""
    s = F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "-"), r"^-+|-+$", "")
    return F.regexp_replace(cut_bytes(s, most), r"-+$", "")


def cut_bytes(c: Column, most: int) -> Column:
    """The longest prefix of at most ``most`` UTF-8 bytes that ends between characters."""
    raw = c.cast("binary")

    def prefix(n: int) -> Column:
        return F.substring(raw, 1, n).cast("string")

    out = prefix(max(0, most - 3))
    for n in range(max(0, most - 2), most + 1):
        out = F.when(F.hex(F.substring(raw, n + 1, 1)).between("80", "BF"), out).otherwise(prefix(n))
    return F.when(F.octet_length(c) <= most, c).otherwise(out)


def word_count(c: Column) -> Column:
    """Words between white space of any kind."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    return F.when(t == "", 0).otherwise(F.size(F.split(t, r"[\s\p{Z}]+")))


def wikilinks(c: Column) -> Column:
    """Targets of ``[[target]]`` and ``[[target|alias]]``."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\[\[([^\]|#\n]+)"), 1)
    return F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: x != "")


def markdown_links(c: Column) -> Column:
    """Targets of ``[text](target)``, without addresses on the web and places in the same text."""
    return F.filter(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\]\(([^)\s]+)\)"), 1), lambda x: ~x.startswith("http") & ~x.startswith("#"))


def hashtags(c: Column) -> Column:
    """Distinct ``#tag`` words in order of appearance, lower-cased; headings are none."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"(?:^|\s)#(\p{L}[\p{L}\p{N}_-]*)"), 1))


def first_heading(c: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(c, r"(?m)^#{1,6}[ \t]+(.+?)[ \t]*#*[ \t]*$", 1)), F.lit(""))


def content_hash(c: Column) -> Column:
    """Hash of the content, the same whatever the line ends."""
    return F.sha2(F.regexp_replace(F.coalesce(c, F.lit("")), "\r", ""), 256)


def effort_days(c: Column) -> Column:
    """Days, rounded up, in ``2d``, ``1.5w`` (7 each), ``3h`` (eighths of a day), ``5``; null otherwise."""
    s = F.lower(F.trim(c))
    number = r"^[+-]?(?:\d+\.?\d*|\.\d+)"
    n = F.regexp_extract(s, f"({number})[hdw]?$", 1).try_cast("double")
    days = F.when(s.endswith("w"), n * 7).when(s.endswith("h"), n / 8).otherwise(n)
    return F.when(s.rlike(f"{number}[hdw]?$"), F.ceil(days))


def status_alias(c: Column) -> Column:
    """The status that a spelling stands for; itself where it is none of the other spellings."""
    from quillgraph.functions.vocabulary import STATUS_ALIASES

    return F.coalesce(F.try_element_at(_map({w: k for k, ws in STATUS_ALIASES.items() for w in ws.split()}), c), c)


def type_alias(c: Column) -> Column:
    """The type that a name stands for; ``document`` for unknown ones."""
    from quillgraph.functions.vocabulary import NODE_TYPES, TYPE_ALIASES

    known = {k: k for k in NODE_TYPES} | {w: k for k, ws in TYPE_ALIASES.items() for w in ws.split()}
    return F.when(c.isNotNull(), F.coalesce(F.try_element_at(_map(known), c), F.lit("document")))


def status_rank(c: Column) -> Column:
    from quillgraph.functions.vocabulary import STATUS_RANK

    return F.coalesce(F.try_element_at(_map(STATUS_RANK), c), F.lit(0))


def stated_weight(c: Column) -> Column:
    """A number for a weight in words."""
    from quillgraph.functions.vocabulary import OTHER_WEIGHT, STATED_WEIGHTS

    return F.coalesce(F.try_element_at(_map(STATED_WEIGHTS), F.lower(c)), F.lit(OTHER_WEIGHT))


def has_criteria(body: Column) -> Column:
    from quillgraph.functions.vocabulary import CRITERIA

    return F.coalesce(body.rlike(CRITERIA), F.lit(False))


def yaml_escape(c: Column) -> Column:
    """Between double quotes in YAML."""
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def list_or_commas(c: Column) -> Column:
    """Items of a JSON list or of a text with commas, trimmed, without empty ones."""
    items = F.when(F.ltrim(c).startswith("["), F.from_json(c, "array<string>")).otherwise(F.split(c, ","))
    return F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def day_prefix(c: Column) -> Column:
    """The day in the first ten characters; null where there is none."""
    return F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd")


def embedding_text(title: Column, doc_type: Column, tags: Column, body: Column) -> Column:
    """What of a document goes into its vector: title, type, tags and body, a blank line between."""
    listed = F.when(F.size(F.coalesce(tags, F.array().cast("array<string>"))) > 0, F.concat(F.lit("tags: "), F.array_join(tags, ", ")))
    return F.concat_ws("\n\n", title, F.concat(F.lit("type: "), doc_type), listed, F.nullif(body, F.lit("")))


def word_set(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[\s\p{Z}]+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; both empty counts as equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def xml_escape(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def known_path(c: Column, root: str) -> Column:
    """Path below ``root``."""
    return F.when(c.startswith(root.rstrip("/") + "/"), c.substr(F.lit(len(root.rstrip("/")) + 2), F.length(c))).otherwise(c)


def stem(path: Column) -> Column:
    """File name without folder and ``.md``."""
    return F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"\.md$", "")


def id_prefix(c: Column) -> Column:
    """The kind that an id begins with: ``task`` of ``task-1a2b``; null without one."""
    return F.nullif(F.regexp_extract(c, r"^([a-z]+)-[0-9a-z]", 1), F.lit(""))


def seeded_id(prefix: str, *seed: Column) -> Column:
    """An id made from its seed, so the same row always gets the same one."""
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha2(F.concat_ws("\x1f", *seed), 256), 1, 8))


def readable_bytes(c: Column) -> Column:
    """``512 B``, ``1.5 KB``, ``2.0 MB``."""
    steps = [(1 << 30, "GB"), (1 << 20, "MB"), (1 << 10, "KB")]
    out = F.concat(c.cast("string"), F.lit(" B"))
    for size, unit in reversed(steps):
        out = F.when(c >= size, F.concat(F.format_number(c / size, 1), F.lit(f" {unit}"))).otherwise(out)
    return out
