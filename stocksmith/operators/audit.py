"""Whole-table constraint audits from one aggregate (A4, V7).

Every row marks what the rules say about it: its values of each key, the rules
that it breaks by itself, and the parents that it names.  All marks of all
tables go into one aggregate by (rule, value), with partial aggregation, so
each table is read once, there is one shuffle, and a value that a third of
the rows hold is combined before it.  A reference is marked under the
parent's primary key; a value with references but no row of its own is an orphan, so
foreign keys need no join.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import schemas as S

KEYS = ("primary_key", "unique")


@dataclass(frozen=True)
class Rule:
    table: str
    kind: str
    cols: tuple[str, ...]

    def mark(self) -> tuple[Column, Column]:
        """(which rows are marked, under which value)."""
        first = F.col(self.cols[0])
        if self.kind in KEYS:
            there = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in self.cols])
            return there, F.concat_ws("|", *[F.col(c).cast("string") for c in self.cols])
        if self.kind == "check":
            return first.isNotNull() & ~first.isin(*S.CHECKS[self.table][1]), first.cast("string")
        none = F.lit(None).cast("string")
        if self.kind == "not_null":
            return first.isNull(), none
        return F.length(first) > S.MAX_LENGTHS[self.table][self.cols[0]], none


def key_rules(names) -> list[Rule]:
    """The primary and unique keys of some tables."""
    return [Rule(t, kind, tuple(cols)) for kind, keys in zip(KEYS, (S.PRIMARY_KEYS, S.UNIQUE_KEYS))
            for t, cols in keys.items() if t in names]


def row_rules(names) -> list[Rule]:
    """What each row must hold by itself: declared lengths, NOT NULL and CHECK."""
    out = [Rule(t, "length", (c,)) for t in names for c in S.MAX_LENGTHS.get(t, {})]
    out += [Rule(t, "not_null", (c,)) for t in names for c in dict.fromkeys([*S.PRIMARY_KEYS.get(t, []), *S.NOT_NULL.get(t, [])])]
    return out + [Rule(t, "check", (c,)) for t, (c, _) in S.CHECKS.items() if t in names]


def violations(tables: dict[str, DataFrame], rules: list[Rule], references: list[tuple] = ()) -> DataFrame:
    """(table_name, rule, key_columns, key_value, rows) of all that breaks ``rules``
    or has no parent under ``references`` (as in ``schemas.FOREIGN_KEYS``; the
    parents' primary keys must be among the rules)."""
    number = {r: k for k, r in enumerate(rules)}
    # slot 0 counts a value's own rows, slots 1.. the references to it
    slots: dict[int, list[tuple[str, str]]] = {}
    for child, col, parent, _ in references:
        slots.setdefault(number[Rule(parent, "primary_key", ("id",))], []).append((child, col))
    mark = lambda when, no, slot, key: F.when(when, F.struct(F.lit(no).alias("no"), F.lit(slot).alias("slot"), key.alias("key_value")))
    parts = []
    for table in dict.fromkeys([*(r.table for r in rules), *(c for c, *_ in references)]):
        marks = [mark(r.mark()[0], k, 0, r.mark()[1]) for r, k in number.items() if r.table == table]
        marks += [mark(F.col(c).isNotNull(), k, i, F.col(c).cast("bigint").cast("string"))
                  for k, refs in slots.items() for i, (child, c) in enumerate(refs, 1) if child == table]
        parts.append(tables[table].select(F.inline(F.array_compact(F.array(*marks)))))
    most = max(map(len, slots.values()), default=0)
    counts = reduce(DataFrame.unionByName, parts).groupBy("no", "key_value").agg(
        *[F.count_if(F.col("slot") == i).alias(f"n{i}") for i in range(most + 1)])
    # the names of what each number (and slot) stands for
    titles = [(r.table, r.kind, ",".join(r.cols)) for r in rules]
    found = [F.when(F.col("n0") > F.when(F.get(_texts([r.kind for r in rules]), "no").isin(*KEYS), 1).otherwise(0), _found(titles, 0))]
    for i in range(1, most + 1):
        named = [(*slots[k][i - 1],) if len(slots.get(k, [])) >= i else (None, None) for k in range(len(rules))]
        found.append(F.when((F.col("n0") == 0) & (F.col(f"n{i}") > 0), _found([(t, "foreign_key", c) for t, c in named], i)))
    out = counts.select("key_value", F.inline(F.array_compact(F.array(*found))))
    return out.select("table_name", "rule", "key_columns", "key_value", "rows")


def _texts(values: list[str | None]) -> Column:
    return F.array(*[F.lit(v).cast("string") for v in values])


def _found(titles: list[tuple], slot: int) -> Column:
    names = [F.get(_texts([t[k] for t in titles]), "no").alias(n) for k, n in enumerate(("table_name", "rule", "key_columns"))]
    return F.struct(*names, F.col(f"n{slot}").alias("rows"))
