"""Two plain chunkers for retrieval: by blocks of markdown, and by fixed size.

Sizes are UTF-8 bytes; both run in Arrow batches, since each is one pass with state. Blocks
without sentence ends stay whole, however large: ``llm.chunking`` cuts those too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A sentence has more bytes than this, its end included.
SHORTEST_SENTENCE = 10
#: A slice of fixed size ends at a sentence only from this byte on.
FIRST_BREAK = 100

_END = re.compile(r"[.!?](?=\s)")
_STOP = re.compile(r"[.!?](?=\s|\Z)")


def _size(s: str) -> int:
    return len(s.encode("utf-8", "surrogatepass"))


def _blocks(text: str) -> Iterator[str]:
    """What stands between blank lines, fences with their blank lines inside."""
    held, fenced = [], False
    for line in [*text.split("\n"), ""]:
        fence = line.lstrip().startswith("```")
        if not line.strip() and not fenced:
            if block := "\n".join(held).strip():
                yield block
            held = []
        else:
            held.append(line)
        fenced ^= fence
    if block := "\n".join(held).strip():
        yield block


def sentences(text: str) -> list[str]:
    """Cut behind sentence marks before white space; what is too short joins what follows."""
    out, begin = [], 0
    for m in _END.finditer(text):
        if _size(text[begin : m.end()]) > SHORTEST_SENTENCE:
            out.append(text[begin : m.end()].strip())
            begin = m.end()
    return [*out, text[begin:].strip()] if text[begin:].strip() else out


def _refilled(parts: list[str], limit: int, least: int) -> list[str]:
    """Sentences joined while they fit; a last piece below ``least`` goes to the one before, over the limit or not."""
    lines: list[list[str]] = [[]]
    used = 0
    for p in parts:
        if lines[-1] and used + 1 + _size(p) > limit:
            lines.append([])
            used = 0
        used += _size(p) + (1 if lines[-1] else 0)
        lines[-1].append(p)
    out = [" ".join(x) for x in lines if x]
    if len(out) > 1 and _size(out[-1]) < least:
        out[-2:] = [f"{out[-2]} {out[-1]}"]
    return out


def markdown_chunks(text: str | None, limit: int = 1500, least: int = 100) -> list[str]:
    """Blocks between blank lines, each led by the text of the last heading, which is no chunk itself.

    A block below ``least`` waits for the next ones and takes in what fits; one that is still
    waiting at the end joins the last chunk if it fits. A block over the limit is cut at
    sentence ends. A text within the limit is one chunk.
    """
    t = (text or "").replace("\r", "").strip()
    if _size(t) <= limit:
        return [t] if t else []
    out: list[str] = []
    waiting: str | None = None
    lead = ""
    for block in _blocks(t):
        heading = block.startswith("#")
        unit = lead + block
        joins = not heading and waiting is not None and _size(unit) <= limit and _size(waiting) + 2 + _size(unit) <= limit
        if joins:
            waiting = f"{waiting}\n\n{unit}"
            continue
        if waiting is not None:
            out.append(waiting)
            waiting = None
        if heading:
            lead = block.lstrip("#").strip() + "\n\n"
        elif _size(unit) > limit:
            out += _refilled(sentences(unit), limit, least)
        elif _size(unit) < least:
            waiting = unit
        else:
            out.append(unit)
    if waiting is not None:
        if out and _size(out[-1]) + 2 + _size(waiting) <= limit:
            out[-1] += "\n\n" + waiting
        else:
            out.append(waiting)
    return out or [t]


def fixed_chunks(text: str | None, limit: int = 2000, overlap: int = 500, least: int = 300) -> list[str]:
    """Slices of at most ``limit`` bytes that share ``overlap`` bytes, ending after the last sentence of the slice.

    A slice below ``least`` is put to the one before.
    """
    data = (text or "").replace("\r", "").strip().encode("utf-8", "surrogatepass")
    if len(data) <= limit:
        return [data.decode("utf-8", "surrogatepass")] if data else []
    between = lambda at: at < len(data) and data[at] & 0xC0 == 0x80
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + limit)
        while between(end):
            end -= 1
        piece = data[at:end].decode("utf-8", "surrogatepass")
        if end < len(data) and (stops := list(_STOP.finditer(piece))) and _size(piece[: stops[-1].start()]) >= FIRST_BREAK:
            piece = piece[: stops[-1].end()]
            end = at + _size(piece)
        piece = piece.strip()
        if out and _size(piece) < least:
            out[-1] += " " + piece
        else:
            out.append(piece)
        if end == len(data) or end <= at:
            break
        at = end - overlap if end - overlap > at else end
        while between(at):
            at += 1
    return out


def chunked(text: Column, strategy: str = "markdown", **sizes: int) -> Column:
    """An array of chunks of a text column."""
    cut = {"markdown": markdown_chunks, "fixed": fixed_chunks}[strategy]

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([cut(t, **sizes) for t in s], dtype=object)

    return run(text)
