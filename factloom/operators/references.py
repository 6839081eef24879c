"""References to records that do not exist (problem 4).

A reference is a tuple of columns, any of which may be null. References are
grouped by their null mask; each mask is anti-joined with the parent on its
non-null columns only, under the declared match semantics:

* ``simple``  - a reference with any null is satisfied (the SQL default),
* ``partial`` - the non-null columns must agree with some parent row,
* ``full``    - all columns null is satisfied, some null is a violation.

Only the key columns and the caller's own columns travel. The child side of an
anti-join may be skewed (a third of the rows may name one key): adaptive
execution splits such partitions, as an anti-join may be split on its left
side, and the parent side is reduced to distinct keys first.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEMANTICS = ("simple", "partial", "full")


def orphans(child: DataFrame, parent: DataFrame, columns: Sequence[str], parent_columns: Sequence[str], match: str = "simple") -> DataFrame:
    """The rows of ``child`` whose reference ``columns`` violate the foreign key.

    Repeated child rows stay repeated; parent rows with nulls in a key column
    satisfy only masks without that column. Empty parents make every checked
    reference an orphan; empty children give nothing. Columns of the parent
    never reach the result, so clashing names do no harm.
    """
    if match not in SEMANTICS:
        raise ValueError(f"match: one of {', '.join(SEMANTICS)}")
    if len(columns) != len(parent_columns) or not columns:
        raise ValueError("as many parent columns as columns, at least one")
    n, out = len(columns), None
    keys = parent.select(*[F.col(p).alias(f"_ref_p{i}") for i, p in enumerate(parent_columns)])
    for mask in product((True, False), repeat=n):
        there = [i for i in range(n) if mask[i]]
        if not there or (match == "simple" and len(there) < n):
            continue
        rows = child
        for i, c in enumerate(columns):
            rows = rows.filter(F.col(c).isNotNull() if mask[i] else F.col(c).isNull())
        if match == "full" and len(there) < n:
            found = rows
        else:
            named = keys.select(*[f"_ref_p{i}" for i in there]).dropna().distinct()
            on = [F.col(columns[i]) == F.col(f"_ref_p{i}") for i in there]
            cond = on[0]
            for c in on[1:]:
                cond = cond & c
            found = rows.join(named, cond, "left_anti")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else child.limit(0)


def orphan_report(found: DataFrame, by: Sequence[str]) -> DataFrame:
    """Orphan rows and distinct missing keys counted per ``by`` (table, period)."""
    return found.groupBy(*by).agg(F.count(F.lit(1)).alias("orphan_rows"), F.countDistinct("missing_id").alias("missing_keys"))
