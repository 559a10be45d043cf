"""Readers: folders of markdown notes, JSON logs, whiteboards, vector tables, a project registry."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.vocabulary import OWN_PROJECTS
from quillgraph.functions.text import content_hash, first_heading, hashtags

# Folders that hold no notes.
SKIPPED = ("node_modules", "target", "build", "dist", "venv", "__pycache__", "vendor", "site-packages")

DOCUMENT = "path string, frontmatter string, body string, parsed string"


def _front(text: str) -> tuple[str | None, str, str]:
    """Frontmatter as JSON, body, and how it was read: ``yaml``, ``lines`` (by lines, for broken YAML), ``none``."""
    m = re.match(r"\A---[ \t]*\r?\n(.*?)(?:^|\n)---[ \t]*(?:\r?\n|\Z)", text, re.S)
    if not m:
        return None, text, "none"
    raw, body = m[1], text[m.end() :]
    try:
        import yaml

        data = yaml.safe_load(raw) or {}
        how = "yaml"
        if not isinstance(data, dict):
            raise ValueError
    except Exception:
        data = {k.strip(): v.strip().strip("'\"") for k, _, v in (line.partition(":") for line in raw.splitlines() if re.match(r"[\w-]+\s*:", line))}
        how = "lines"
    return json.dumps(data, default=str, ensure_ascii=False, sort_keys=True), body, how


def ignore_rules(lines: str) -> list[tuple[str, bool]]:
    """``pattern, keep`` of a ``.gitignore`` or ``.ignore`` file, as regular expressions over paths below its folder; later rules win."""
    out = []
    for line in lines.splitlines():
        rule = line.rstrip()
        if not rule or rule.startswith("#"):
            continue
        keep, rule = rule.startswith("!"), rule.removeprefix("!")
        folder, rule = rule.endswith("/"), rule.rstrip("/")
        anchored = "/" in rule
        body = "".join({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(x, x if x.startswith("[") else re.escape(x)) for x in re.findall(r"\*\*|\*|\?|\[[^\]]+\]|[^*?\[]+|.", rule.lstrip("/").replace("**/", "**")))
        out.append((("^" if anchored else "(?:^|/)") + body + ("/" if folder else "(?:/|$)"), keep))
    return out


def _rules_of(spark: SparkSession, root: str, files: DataFrame) -> list[tuple[str, list[tuple[str, bool]]]]:
    """Rules of every folder that has notes, or lies above one that has, outermost first.

    Files with a leading dot are hidden from readers of tables, so they are opened one by
    one; a vault has few folders.
    """
    jvm = spark._jvm
    held = [r[0] for r in files.select(F.regexp_replace("path", r"[^/]*$", "").alias("f")).distinct().collect()]
    folders = {""} | {"".join(f"{x}/" for x in f.split("/")[:k]) for f in held for k in range(1, f.count("/") + 1)}
    out = []
    for folder in sorted(folders, key=lambda f: (f.count("/"), f)):
        for name in (".gitignore", ".ignore"):
            at = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{folder}{name}")
            fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
            if fs.exists(at):
                stream = fs.open(at)
                out.append((folder, ignore_rules(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))))
                stream.close()
    return out


def _ignored(path: str, rules: list[tuple[str, list[tuple[str, bool]]]]) -> bool:
    """Whether the rules of the folders above, outermost first, leave the path out."""
    out = False
    for folder, patterns in rules:
        if path.startswith(folder):
            for pattern, keep in patterns:
                if re.search(pattern, path[len(folder) :]):
                    out = not keep
    return out


def read_glob(spark: SparkSession, pattern: str) -> DataFrame:
    """Notes of a folder, without those beneath it, or of a pattern."""
    at = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    where = pattern.rstrip("/") + "/*.md" if fs.exists(at) and fs.getFileStatus(at).isDirectory() else pattern
    files = spark.read.format("binaryFile").load(where).select("path", "content")
    return _parsed(files.filter(F.col("path").endswith(".md")).withColumn("path", F.regexp_replace("path", r"^file:/*", "/")))


def table_column(text: str, section: str, column: int = 0) -> list[str]:
    """Code words in one column of the first table below a heading of a markdown text."""
    lines = text.splitlines()
    start = next((k for k, x in enumerate(lines) if re.match(rf"#+\s+{re.escape(section)}\s*$", x)), len(lines))
    out: list[str] = []
    for line in lines[start + 1 :]:
        if line.startswith("#"):
            break
        if line.lstrip().startswith("|"):
            cells = line.strip().strip("|").split("|")
            out += re.findall(r"`([^`]+)`", cells[column]) if column < len(cells) else []
    return out


def read_markdown(spark: SparkSession, root: str, skipped: tuple[str, ...] = SKIPPED) -> DataFrame:
    """``path, frontmatter, body, parsed`` of every ``*.md`` below ``root``.

    Left out are hidden and skipped folders, files that are not UTF-8, and what ``.gitignore``
    and ``.ignore`` files below ``root`` name.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root).select("path", "content")
    base = re.sub(r"^file:/*", "/", root).rstrip("/")
    rel = F.regexp_replace(F.regexp_replace("path", r"^file:/*", "/"), "^" + re.escape(base) + "/", "")
    hidden = "(?:^|/)(?:\\.|(?:" + "|".join(map(re.escape, skipped)) + ")/)"

    kept = files.withColumn("path", rel).filter(~F.col("path").rlike(hidden))
    rules = _rules_of(spark, root, kept)
    dropped = F.udf(lambda p: _ignored(p, rules), "boolean")
    return _parsed(kept.filter(~dropped("path")) if rules else kept)


#: The older name of ``read_markdown``.
read_all_markdown = read_markdown


def _parsed(files: DataFrame) -> DataFrame:
    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for path, content in zip(f["path"], f["content"]):
                try:
                    text = bytes(content).decode("utf-8")
                except UnicodeDecodeError:
                    continue
                out.append((path, *_front(text)))
            yield pd.DataFrame(out, columns=["path", "frontmatter", "body", "parsed"])

    return files.mapInPandas(parse, DOCUMENT)


def documents(notes: DataFrame) -> DataFrame:
    """Document rows of notes: id, title, type, status, tags, hashes; tags also from the text."""
    j = lambda k: F.nullif(F.trim(F.get_json_object("frontmatter", f"$.{k}")), F.lit(""))
    stem = F.regexp_replace(F.regexp_replace("path", r"^.*/", ""), r"\.md$", "")
    listed = F.coalesce(F.from_json(F.get_json_object("frontmatter", "$.tags"), "array<string>"), F.filter(F.transform(F.split(F.coalesce(j("tags"), F.lit("")), ","), lambda x: F.trim(x)), lambda t: t != ""))
    return notes.select(
        F.coalesce(j("id"), stem).alias("id"),
        "path",
        F.coalesce(j("title"), first_heading(F.col("body")), stem).alias("title"),
        F.array_distinct(F.concat(listed, hashtags(F.col("body")))).alias("tags"),
        j("type").alias("doc_type"),
        j("status").alias("status"),
        j("project").alias("project"),
        "body",
        content_hash(F.col("body")).alias("content_hash"),
        "frontmatter",
        "parsed",
    )


def repeated_keys(notes: DataFrame, raw: str = "text") -> DataFrame:
    """``path, key, n``: top-level frontmatter keys written more than once."""
    front = F.regexp_extract(raw, r"(?s)\A---[ \t]*\r?\n(.*?)\n---", 1)
    keys = notes.select("path", F.explode(F.regexp_extract_all(front, F.lit(r"(?m)^([\w-]+)\s*:"), 1)).alias("key"))
    return keys.groupBy("path", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


TELEMETRY = "timestamp timestamp, tool_name string, response_bytes bigint, latency_ms bigint, is_error boolean"


def read_telemetry(spark: SparkSession, path: str) -> DataFrame:
    """Calls of a JSON-lines log; lines that cannot be read are left out."""
    return spark.read.schema(TELEMETRY + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path).filter("_corrupt IS NULL AND tool_name IS NOT NULL").drop("_corrupt")


def read_scenes(spark: SparkSession, path: str) -> DataFrame:
    """``scene, json`` of whiteboard files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("scene"), F.col("value").alias("json"))


def read_vectors(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """A vector table; vectors of another length than ``dim`` make it count as empty, so that it is built anew."""
    df = spark.read.parquet(path)
    wrong = df.filter(F.exists("chunk_embeddings", lambda v: F.size(v) != dim)).limit(1).count()
    return df.limit(0) if wrong else df


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """``slug, alias`` rows of a YAML registry (``projects``: slug to settings; ``project_aliases``: alias to slug)."""
    import yaml

    text = "\n".join(r[0] for r in spark.read.text(path).collect())  # one small settings file
    data = yaml.safe_load(text) or {}
    rows = {(s, s) for s in [*(data.get("projects") or {}), *OWN_PROJECTS]}
    rows |= {(s, a) for s, v in (data.get("projects") or {}).items() for a in ((v or {}).get("aliases") or [])}
    rows |= {(s, a) for a, s in (data.get("project_aliases") or {}).items()}
    return spark.createDataFrame(sorted(rows), "slug string, alias string")
