"""Loose references: what they name once decoration is taken off."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANKS = r"^[\s\p{Z}\p{Cf}]+|[\s\p{Z}\p{Cf}]+$"


def strip_blanks(c: Column) -> Column:
    return F.regexp_replace(c, _BLANKS, "")


def reference_key(c: Column) -> Column:
    """Lower-case key of a written reference; the empty string where it refers to nothing.

    Surrounding blanks, ``[[ ]]``, whatever follows ``|`` or ``#``, a folder and ``.md``
    are taken off, so ``[[docs/Task-1.md#Log|the log]]`` and ``task-1`` are the same key.
    """
    s = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?s)[|#].*$", "")
    s = F.regexp_replace(strip_blanks(s), r"^\[\[|\]\]$", "")
    s = F.regexp_replace(s, r"(?s)^.*/", "")
    return strip_blanks(F.regexp_replace(F.lower(strip_blanks(s)), r"\.md$", ""))
