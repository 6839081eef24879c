"""Voters that agree, where nearly all of them meet: votes as matrices, in blocks of voters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import cut

#: Voters of a block, columns of a product, rows of a tile that are looked at together.
BLOCK, COLUMNS, ROWS = 2048, 2048, 256


def _coded(df: DataFrame, column: str, name: str) -> DataFrame:
    """The values of ``column``, each with a number of its own."""
    return cut(df.select(column).distinct().withColumn(name, F.monotonically_increasing_id()))


def _blocks(v: DataFrame, count: int) -> DataFrame:
    """(block, blob): the ids, sessions and votes of the voters of each block."""

    def pack(key, t):
        parts = [t.column(c).to_numpy().astype(np.int64) for c in ("_u", "_s", "_v")]
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "blob": pa.array([np.concatenate(parts).tobytes()], pa.binary())})

    block = F.pmod(F.xxhash64("_u"), F.lit(count)).cast("int").alias("block")
    return cut(v.select(block, "_u", "_s", "_v").groupBy("block").applyInArrow(pack, "block int, blob binary"))


def _rows(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's voters, ascending, and each vote's voter by place, session and vote."""
    u, s, v = np.frombuffer(blob, np.int64).reshape(3, -1)
    ids, at = np.unique(u, return_inverse=True)
    return ids, at, s, v


def _common(a: tuple, b: tuple, voted: bool) -> np.ndarray:
    """How many sessions every two voters of two blocks share; ``voted``: with the same vote."""
    n = len(a[2])
    keys = np.unique(np.concatenate([a[2], b[2]]), return_inverse=True)[1]
    if voted:
        votes = np.unique(np.concatenate([a[3], b[3]]), return_inverse=True)[1]
        keys = keys * (int(votes.max()) + 1) + votes
    both, here = np.intersect1d(keys[:n], keys[n:]), []
    for (ids, at, _, _), k in ((a, keys[:n]), (b, keys[n:])):
        column = np.minimum(np.searchsorted(both, k), max(len(both) - 1, 0))
        keep = np.flatnonzero(both[column] == k) if len(both) else np.zeros(0, np.int64)
        here.append((len(ids), at[keep], column[keep]))
    out = np.zeros((len(a[0]), len(b[0])), np.float32)
    for lo in range(0, len(both), COLUMNS):
        sides = []
        for size, at, column in here:
            m = np.zeros((size, min(COLUMNS, len(both) - lo)), np.float32)
            k = (column >= lo) & (column < lo + COLUMNS)
            m[at[k], column[k] - lo] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


def agreeing(v: DataFrame, session: str, voter: str, min_votes: int, min_same: int, min_ratio: float, voters: int) -> DataFrame:
    """As ``relational.agreement``, of one vote ``v`` a session and voter, none null, by about ``voters`` voters.

    Every two blocks of voters meet once, as products of matrices of nought and
    one. Ratios are rounded by whole numbers, halves up.
    """
    whole = dict(v.dtypes)[voter] in ("tinyint", "smallint", "int", "bigint")
    names = None if whole else _coded(v, voter, "_u")
    x = v.join(_coded(v, session, "_s"), session).join(_coded(v, "v", "_v"), "v")
    x = (x.withColumn("_u", F.col(voter).cast("long")) if whole else x.join(names, voter)).select("_u", "_s", "_v")
    count = max(1, -(-voters // BLOCK))
    blocks = _blocks(x, count)
    one = blocks.select(F.col("block").alias("p"), F.explode(F.sequence("block", F.lit(count - 1))).alias("q"), F.col("blob").alias("left"))
    two = blocks.select(F.explode(F.sequence(F.lit(0), "block")).alias("p"), F.col("block").alias("q"), F.col("blob").alias("right"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, q, left, right in zip(*(batch.column(c) for c in ("p", "q", "left", "right")), strict=True):
                a, b = _rows(left.as_py()), _rows(right.as_py())
                shared, same = _common(a, b, False), _common(a, b, True)
                for lo in range(0, len(shared), ROWS):
                    s, m = shared[lo : lo + ROWS], same[lo : lo + ROWS]
                    # a little less than the ratio, before it is rounded
                    i, j = np.nonzero((m >= s * np.float32(min_ratio - 1e-4)) & (s >= max(min_votes, 1)) & (m >= min_same))
                    if p == q:
                        i, j = i[i + lo < j], j[i + lo < j]
                    n, k = s[i, j].astype(np.int64), m[i, j].astype(np.int64)
                    ratio = (20_000 * k + n) // (2 * n) / 10_000
                    keep = ratio >= min_ratio
                    x, y = a[0][i[keep] + lo], b[0][j[keep]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.minimum(x, y), np.maximum(x, y), n[keep], k[keep], ratio[keep])], names=["a", "b", "shared", "same", "ratio"])

    out = one.join(two, ["p", "q"]).mapInArrow(meet, "a long, b long, shared long, same long, ratio double")
    if whole:
        kind = dict(v.dtypes)[voter]
        return out.withColumns({"a": F.col("a").cast(kind), "b": F.col("b").cast(kind)})
    named = out.withColumnsRenamed({"a": "_i", "b": "_j"}).join(names.toDF("_x", "_i"), "_i").join(names.toDF("_y", "_j"), "_j")
    return named.select(F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b"), "shared", "same", "ratio")
