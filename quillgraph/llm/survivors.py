"""One surviving record per group of duplicates, by consistent bundles.

Fields that only make sense together form a bundle; a bundle is taken over whole, from
one record. Among the records' bundle values the survivor is the combination of highest
trust that respects the given dependencies between bundles, found by branch-and-bound.

A group may hold any share of the rows: it is first reduced, with partial aggregation, to
its distinct bundle values, each with the best trust any record lends it and that
record's id. In a bundle that no dependency touches every value but the best is dominated
and left out, so what reaches one task is bounded by the distinct values of the bundles
tied by dependencies. The search visits those in order of trust and gives up a branch as
soon as the best that is left cannot beat what it has; at worst, where dependencies forbid
nearly everything, it visits all combinations of the tied bundles of a group.

A dependency ``(x, y)`` between bundles means: where the group pairs the chosen value of x
with values of y at all, the chosen value of y must be one of those. Where no combination
respects all of them the survivor is marked as not ``consistent``.

Defined results: values that are null, blank or a stand-in for "nothing known" say
nothing, and a bundle says something if one of its fields does; a bundle for which no
record says anything has no row; ties in trust go to the smallest id; rows without a group
or an id are ignored; repeated rows count once; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Stand-ins for "nothing known".
STAND_INS = ["", "-", "--", "?", "??", "???", "n/a", "n.a.", "na", "none", "null", "nil", "nan", "tbd", "tba", "tbc", "unknown", "undefined", "unassigned", "not set", "<null>", "(none)", "[none]", "xxx", "."]


def says_something(c: Column) -> Column:
    plain = F.lower(F.regexp_replace(c, r"^[\s\p{Z}\p{Cf}]+|[\s\p{Z}\p{Cf}]+$", ""))
    return c.isNotNull() & ~plain.isin(STAND_INS)


def record_instant(c: Column) -> Column:
    """Microseconds of a day, or a time with or without a zone (UTC); null where unreadable."""
    s = F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    day = r"^(\d{4}-\d{2}-\d{2})(?:[Tt ]+(\d{2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?))?\s*([Zz]|UTC|[+-]\d{2}:?\d{2}|[+-]\d{2})?$"
    time = F.regexp_extract(s, day, 2)
    zone = F.regexp_replace(F.regexp_extract(s, day, 3), r"^([+-]\d{2})$", "$1:00")
    zone = F.regexp_replace(zone, r"^([+-]\d{2})(\d{2})$", "$1:$2")
    zone = F.when(F.upper(zone).isin("", "Z", "UTC"), "+00:00").otherwise(zone)
    text = F.concat(F.regexp_extract(s, day, 1), F.lit("T"), F.when(time == "", "00:00:00").when(F.length(time) == 5, F.concat(time, F.lit(":00"))).otherwise(time), zone)
    return F.when(s.rlike(day), F.unix_micros(text.try_cast("timestamp")))


def seniority(created: str = "created", children: str = "n_children", words: str = "word_count") -> list[Column]:
    """Trust in a record as the original: created earliest (unreadable times last), then more children, then more words."""
    return [-F.coalesce(record_instant(F.col(created)), F.lit((1 << 63) - 1)), F.coalesce(children, F.lit(-1)), F.coalesce(words, F.lit(-1))]


def _search(options: list[list[tuple]], allowed: dict[tuple[int, int], dict[str, set]]) -> list[tuple] | None:
    """One option per bundle, of highest total trust; options are sorted, best first."""
    best: list = [None, None]
    bound = [0] * (len(options) + 1)
    for k in range(len(options) - 1, -1, -1):
        bound[k] = bound[k + 1] + options[k][0][0]

    def fits(k: int, value: str, chosen: list[tuple]) -> bool:
        for j, c in enumerate(chosen):
            for x, y, vx, vy in ((j, k, c[2], value), (k, j, value, c[2])):
                known = allowed.get((x, y), {}).get(vx)
                if known is not None and vy not in known:
                    return False
        return True

    def step(k: int, chosen: list[tuple], total: float) -> None:
        if best[0] is not None and total + bound[k] <= best[0]:
            return
        if k == len(options):
            best[0], best[1] = total, list(chosen)
            return
        for o in options[k]:
            if best[0] is not None and total + o[0] + bound[k + 1] <= best[0]:
                break
            if fits(k, o[2], chosen):
                step(k + 1, [*chosen, o], total + o[0])

    step(0, [], 0)
    return best[1]


def survivors(entries: DataFrame, bundles: dict[str, list[str]], trust: Column | dict[str, list[Column]], dependencies: list[tuple[str, str]] = (), group: str = "cluster_id") -> DataFrame:
    """``group, bundle, id, value, consistent``: which record each bundle is taken from; ``value`` joins its fields as JSON.

    ``trust``: a number, higher for records to be believed first, null counting least; or
    for each bundle several, the first deciding first.
    Where dependencies leave no full combination, each bundle keeps its best value and is not consistent.
    """
    tied = {b for d in dependencies for b in d}
    own = trust if isinstance(trust, dict) else dict.fromkeys(bundles, [trust])
    rows = entries.filter(F.col(group).isNotNull() & F.col("id").isNotNull())
    # the id itself always says something, whatever it looks like
    means = lambda f: F.lit(True) if f == "id" else says_something(F.col(f))
    says = {n: F.array_max(F.array(*map(means, fields))) for n, fields in bundles.items()}
    value = {n: F.to_json(F.struct(*[F.when(means(f), F.col(f)).alias(f) for f in fields])) for n, fields in bundles.items()}
    # least first: trust is negated, so that the smallest id wins a tie
    rank = {n: F.array(*[-F.coalesce(c.cast("bigint"), F.lit(-(1 << 62))) for c in own[n]]) for n in bundles}
    kinds = [F.struct(F.lit(n).alias("bundle"), value[n].alias("value"), says[n].alias("says"), F.lit(n in tied).alias("tied"), rank[n].alias("t")) for n in bundles]
    flat = rows.select(group, "id", F.explode(F.array(*kinds)).alias("k")).select(group, "id", "k.*").filter("says")
    options = flat.groupBy(group, "bundle", F.when(F.col("tied"), F.col("value")).alias("key")).agg(F.min(F.struct("t", "id", "value")).alias("b")).select(group, "bundle", "b.t", "b.id", "b.value")
    if dependencies:
        # both values of a pair stand in one row
        pairs = [F.struct(F.lit(f"{x}\t{y}").alias("bundle"), value[x].alias("id"), value[y].alias("value"), (says[x] & says[y]).alias("says")) for x, y in dependencies]
        seen = rows.select(group, F.explode(F.array(*pairs)).alias("k")).select(group, "k.*").filter("says").select(group, "bundle", "id", "value").distinct()
        options = options.unionByName(seen.withColumn("t", F.array().cast("array<bigint>")))
    names = list(bundles)

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Whole groups in order: rows of one group are neighbours within a task."""
        held: list[tuple] = []
        out: list[tuple] = []

        def finish() -> None:
            by: dict[str, list[tuple]] = {}
            allowed: dict[tuple[int, int], dict[str, set]] = {}
            for _, bundle, t, i, v in held:
                if "\t" in bundle:
                    x, y = (names.index(n) for n in bundle.split("\t"))
                    allowed.setdefault((x, y), {}).setdefault(i, set()).add(v)
                else:
                    by.setdefault(bundle, []).append((tuple(t), i, v))
            used = [n for n in names if n in by]
            # trust as a rank within the bundle, so that bundles weigh the same
            lists, place = [], {names.index(n): k for k, n in enumerate(used)}
            for n in used:
                lists.append([(-r, o[1], o[2]) for r, o in enumerate(sorted(by[n]))])
            ties = {(place[x], place[y]): m for (x, y), m in allowed.items() if x in place and y in place}
            chosen = _search(lists, ties)
            out.extend((held[0][0], n, c[1], c[2], chosen is not None) for n, c in zip(used, chosen or [o[0] for o in lists]))

        for f in frames:
            for row in f.itertuples(index=False, name=None):
                if held and row[0] != held[0][0]:
                    finish()
                    held = []
                held.append(row)
            if out:
                yield pd.DataFrame(out, columns=[group, "bundle", "id", "value", "consistent"])
                out = []
        if held:
            finish()
            yield pd.DataFrame(out, columns=[group, "bundle", "id", "value", "consistent"])

    kind = dict(entries.dtypes)[group]
    ordered = options.repartition(group).sortWithinPartitions(group).select(group, "bundle", "t", "id", "value")
    return ordered.mapInPandas(solve, f"{group} {kind}, bundle string, id string, value string, consistent boolean")
