"""Lines repeated across one site's documents (problem 1).

A source's items are sequences of line identifiers. Blocks of lines that come
back are found in suffix arrays:

1. The first symbols of suffixes are bucketed: a bucket (source, line) holds
   every suffix that begins with the line. A bucket whose line spans too few
   items holds no block; its places end the runs of lines around them.
2. What is left of an item, its runs of repeated lines, is its skeleton. Items
   of one skeleton are counted, not carried: what a third of all rows share is
   one skeleton with a number.
3. In each bucket the suffix array of the concatenated runs is sorted by prefix
   doubling, common prefixes (LCP) of neighbours are read off the doubling's
   ranks, and the LCP intervals are the blocks, of every exact length. An
   interval's items are the sums of its distinct skeletons' numbers.
4. The deepest interval that spans enough items is the block that begins at a
   place; the lines to delete are those that such blocks cover.

No task holds a source: a bucket's task holds the distinct runs with its line.
A bucket of more than ``most`` of them gives its own block from an aggregate
and is split by the next line of its suffixes, again and again if need be.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.session import cut


def line_key(line: Column) -> Column:
    """The line without case, white space differences, and values of numbers ('' if blank)."""
    spaced = F.regexp_replace(F.lower(line), r"[\s\p{Z}\x{85}]+", " ")
    return F.trim(F.regexp_replace(spaced, r"\p{Nd}+", "0"))


def suffix_levels(ids: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... symbols; ``end`` is where the run of each place ends."""
    at = np.arange(len(ids))
    levels = [np.unique(ids, return_inverse=True)[1].astype(np.int64) + 1]
    step = 1
    while (at + step < end).any():
        rank = levels[-1]
        behind = np.where(at + step < end, rank[np.minimum(at + step, len(ids) - 1)], 0)
        levels.append(np.unique(rank * (rank.max() + 1) + behind, return_inverse=True)[1].astype(np.int64) + 1)
        step *= 2
    return levels


def common_prefixes(levels: list[np.ndarray], end: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many symbols the suffixes at ``a`` and ``b`` have in common at their beginnings."""
    a, b, end_a, end_b = a.copy(), b.copy(), end[a], end[b]
    total, open_ = np.zeros(len(a), np.int64), np.ones(len(a), bool)
    for k in range(len(levels) - 1, -1, -1):
        i = np.flatnonzero(open_)
        i = i[levels[k][a[i]] == levels[k][b[i]]]
        step = np.minimum(1 << k, end_a[i] - a[i])
        total[i] += step
        a[i] += step
        b[i] += step
        open_[i] = (a[i] < end_a[i]) & (b[i] < end_b[i])
    return total


def intervals(lcp: np.ndarray, length: np.ndarray, skeleton: np.ndarray, weight: np.ndarray, need: int) -> tuple[list[tuple[int, int, int, int]], np.ndarray]:
    """The LCP intervals of sorted suffixes that span ``need`` items, and for each suffix the length of the deepest of them.

    ``lcp[i]`` is the common prefix of suffixes i - 1 and i. Intervals are
    (first suffix, length, items, places). A suffix that several items share by
    one skeleton is an interval of its own whole length.
    """
    depth, left, parent, items, places = [], [], [], [], []
    stack: list[int] = []
    last: dict[int, int] = {}
    leaf = []

    def node(d: int, at: int) -> int:
        depth.append(d), left.append(at), parent.append(-1), items.append(0), places.append(0)
        return len(depth) - 1

    def close(upto: int) -> int:
        """Ends all open intervals deeper than ``upto``; where the last of them begins."""
        at = -1
        while stack and depth[stack[-1]] > upto:
            n = stack.pop()
            at = left[n]
            if stack and depth[stack[-1]] >= upto:
                up = stack[-1]
            else:
                up = node(upto, at)
                stack.append(up)
            parent[n] = up
            items[up] += items[n]
            places[up] += places[n]
        return at

    stack.append(node(0, 0))
    for i in range(len(lcp)):
        common = int(lcp[i]) if i else 0
        close(common)
        before = last.get(int(skeleton[i]))
        if int(length[i]) > depth[stack[-1]]:
            stack.append(node(int(length[i]), i))
        n = stack[-1]
        items[n] += int(weight[i])
        places[n] += int(weight[i])
        if before is not None:  # the skeleton's earlier suffix and this one meet in the interval that holds both
            meet = _holding(stack, left, before)
            items[meet] -= int(weight[i])
        last[int(skeleton[i])] = i
        leaf.append(n)
    close(0)
    best = [0] * len(depth)
    order = sorted(range(len(depth)), key=lambda n: depth[n])
    for n in order:
        best[n] = depth[n] if items[n] >= need else best[parent[n]] if parent[n] >= 0 else 0
    found = [(left[n], depth[n], items[n], places[n]) for n in range(len(depth)) if depth[n] and items[n] >= need]
    return found, np.array([best[n] for n in leaf], np.int64)


def _holding(stack: list[int], left: list[int], before: int) -> int:
    """The deepest open interval that began at or before the suffix ``before``."""
    lo, hi = 0, len(stack)
    while lo < hi:
        mid = (lo + hi) // 2
        if left[stack[mid]] <= before:
            lo = mid + 1
        else:
            hi = mid
    return stack[lo - 1]


class Blocks:
    """Repeated blocks of lines in the items of each source."""

    def __init__(self, items: DataFrame, item: str = "id", source: str = "source_id", text: str = "body_text", min_items: int = 3, one_in: int = 40, most: int = 200_000):
        """A block counts if it stands in ``min_items`` different items of a
        source and in at least one of ``one_in`` items with a non-empty text.

        Null and empty texts and null sources or ids give nothing; repeated
        rows of an id count once; blank lines are skipped, so a block may go on
        behind one. Only the three columns are read. A task takes at most
        ``most`` distinct runs of a bucket.
        """
        self.items = items.select(F.col(item).alias("item"), F.col(source).alias("source"), F.col(text).alias("text")).filter(
            "item is not null and source is not null and text != ''"
        )
        self.min_items, self.one_in, self.most = min_items, one_in, most

    def lines(self) -> DataFrame:
        """(source, item, pos, line_no, name): every line that is not blank, by its identifier; one row without a name where there is none."""
        split = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct((i + 1).cast("long").alias("line_no"), line_key(x).alias("key")))
        p = self.items.select("source", "item", F.posexplode_outer(F.filter(split, lambda x: x["key"] != "")).alias("pos", "line"))
        return p.select("source", "item", "pos", F.col("line.line_no").alias("line_no"), F.when(F.col("line").isNotNull(), F.xxhash64("line.key")).alias("name"))

    def skeletons(self) -> DataFrame:
        """(source, item, need, line_nos, ids, skeleton): what is left of each item in the buckets of lines that span enough items; 0 parts runs."""
        lines = cut(self.lines())
        need = lines.groupBy("source").agg(F.count_distinct("item").alias("n"))
        need = need.select("source", F.greatest(F.lit(self.min_items), F.ceil(F.col("n") / self.one_in)).cast("long").alias("need"))
        buckets = lines.filter("name is not null").groupBy("source", "name").agg(F.count_distinct("item").alias("n_items"))
        buckets = buckets.join(need, "source").filter("n_items >= need").drop("n_items")
        left = lines.join(buckets, ["source", "name"]).groupBy("source", "item", "need")
        s = left.agg(F.array_sort(F.collect_set(F.struct("pos", "line_no", "name"))).alias("s"))
        parted = F.transform("s", lambda x, i: F.when((i > 0) & (x["pos"] != F.get("s", i - 1)["pos"] + 1), F.array(F.lit(0).cast("long"), x["name"])).otherwise(F.array(x["name"])))
        s = s.select("source", "item", "need", F.col("s.line_no").alias("line_nos"), F.flatten(parted).alias("ids"))
        return s.withColumn("skeleton", F.xxhash64("ids"))

    def runs(self, skeletons: DataFrame) -> DataFrame:
        """(source, bucket, need, skeleton, n, base, run, starts): each distinct skeleton's runs, in the bucket of every line they hold."""
        kinds = skeletons.groupBy("source", "need", "skeleton").agg(F.count(F.lit(1)).alias("n"), F.first("ids").alias("ids"))

        def each(batches):
            for b in batches:
                out = []
                for r in b.to_pylist():
                    base, ids = 0, [*r["ids"], 0]
                    begin = 0
                    for i, x in enumerate(ids):
                        if x == 0:
                            run, places = ids[begin:i], {}
                            for k, y in enumerate(run):
                                places.setdefault(y, []).append(k)
                            out += [(r["source"], y, r["need"], r["skeleton"], r["n"], base, run, at) for y, at in places.items()]
                            base, begin = base + len(run), i + 1
                yield pa.RecordBatch.from_pylist([dict(zip(_RUN.names, x, strict=True)) for x in out], _RUN)

        return kinds.select("source", "need", "skeleton", "n", "ids").mapInArrow(each, _RUN_SQL)

    def _intervals(self, rows: DataFrame, depth: int, places: bool) -> DataFrame:
        def each(key, t):
            run, starts = t["run"].combine_chunks(), t["starts"].combine_chunks()
            ids, edge = run.flatten().to_numpy(), run.offsets.to_numpy() - run.offsets[0].as_py()
            first, size = edge[:-1], np.diff(edge)
            end = np.repeat(edge[1:], size)
            owner = np.repeat(np.arange(t.num_rows), np.diff(starts.offsets.to_numpy()))
            at = first[owner] + starts.flatten().to_numpy()
            levels = suffix_levels(ids, end)
            order = np.lexsort((owner, levels[-1][at]))
            at, owner = at[order], owner[order]
            lcp = np.zeros(len(at), np.int64)
            lcp[1:] = common_prefixes(levels, end, at[:-1], at[1:])
            skeleton, weight, need = t["skeleton"].to_numpy()[owner], t["n"].to_numpy()[owner], t["need"][0].as_py()
            found, deepest = intervals(lcp, end[at] - at, skeleton, weight, need)
            source = key[0].as_py()
            if places:
                some = np.flatnonzero(deepest)
                place = (t["base"].to_numpy()[owner] + at - first[owner])[some]
                return pa.table({"source": pa.array([source] * len(some), pa.int64()), "skeleton": skeleton[some], "place": place, "length": deepest[some]}, _PLACE)
            found = [(source, d, items, n) for _, d, items, n in found if d >= depth]
            return pa.Table.from_pylist([dict(zip(_BLOCK.names, x, strict=True)) for x in found], _BLOCK)

        return rows.groupBy("source", "bucket").applyInArrow(each, _PLACE_SQL if places else _BLOCK_SQL)

    def found(self, skeletons: DataFrame, places: bool) -> DataFrame:
        """The blocks (source, length, n_items, n_places), or the blocks that begin at each place (source, skeleton, place, length)."""
        rows, depth, out = self.runs(skeletons), 1, None
        while True:
            rows = cut(rows)
            large = cut(rows.groupBy("source", "bucket").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > self.most).select("source", "bucket"))
            split = not large.isEmpty()
            part = self._intervals(rows.join(large, ["source", "bucket"], "left_anti") if split else rows, depth, places)
            out = part if out is None else out.unionByName(part)
            if not split:
                return out
            rows = rows.join(large, ["source", "bucket"])
            each = rows.groupBy("source", "bucket", "need", "skeleton", "n").agg(F.sum(F.size("starts")).alias("s"))
            own = each.groupBy("source", "bucket", "need").agg(F.sum("n").alias("n_items"), F.sum(F.col("n") * F.col("s")).alias("n_places")).filter("n_items >= need")
            if places:
                begin = rows.join(own.select("source", "bucket"), ["source", "bucket"], "left_semi").select("source", "skeleton", F.explode(F.transform("starts", lambda x: (x + F.col("base")).cast("long"))).alias("place"))
                out = out.unionByName(begin.withColumn("length", F.lit(depth).cast("long")))
            # the block of ``depth`` lines is an interval of its own unless one line follows it everywhere
            x = rows.withColumn("start", F.explode("starts")).withColumn("next", F.get("run", F.col("start") + depth)).drop("starts")
            if not places:
                ahead = x.filter("next is not null").groupBy("source", "bucket", "next").agg(F.sum("n").alias("p")).groupBy("source", "bucket").agg(F.max("p").alias("p"))
                alone = own.join(ahead, ["source", "bucket"], "left").filter("coalesce(p, 0) < n_places")
                out = out.unionByName(alone.select("source", F.lit(depth).cast("long").alias("length"), "n_items", "n_places"))
            x = x.filter("next is not null").withColumn("bucket", F.xxhash64("bucket", "next"))
            rows = x.groupBy("source", "bucket", "need", "skeleton", "n", "base", "run").agg(F.sort_array(F.collect_list("start")).alias("starts")).select(*_RUN.names)
            depth += 1

    def report(self) -> DataFrame:
        """(source_id, n_lines, n_items, n_places) of the repeated blocks: one row for every block that is not always followed by the same line."""
        f = self.found(self.skeletons(), False)
        return f.select(F.col("source").alias("source_id"), F.col("length").alias("n_lines"), "n_items", "n_places")


_RUN = pa.schema([("source", pa.int64()), ("bucket", pa.int64()), ("need", pa.int64()), ("skeleton", pa.int64()), ("n", pa.int64()), ("base", pa.int64()), ("run", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64()))])
_RUN_SQL = "source long, bucket long, need long, skeleton long, n long, base long, run array<long>, starts array<long>"
_PLACE = pa.schema([("source", pa.int64()), ("skeleton", pa.int64()), ("place", pa.int64()), ("length", pa.int64())])
_PLACE_SQL = "source long, skeleton long, place long, length long"
_BLOCK = pa.schema([("source", pa.int64()), ("length", pa.int64()), ("n_items", pa.int64()), ("n_places", pa.int64())])
_BLOCK_SQL = "source long, length long, n_items long, n_places long"


def repeated_lines(items: DataFrame, min_lines: int = 1, **parameters) -> DataFrame:
    """(item, line_no) of all lines that lie in a repeated block of at least ``min_lines`` lines, each once.

    Sources are long integers, or are cast to them.
    """
    b = Blocks(items, **parameters)
    skeletons = cut(b.skeletons())
    begin = b.found(skeletons, True).groupBy("source", "skeleton", "place").agg(F.max("length").alias("length"))
    # a place is covered if a block that begins at it or before it reaches it
    reach = F.max(F.when(F.col("length") >= min_lines, F.col("place") + F.col("length"))).over(Window.partitionBy("source", "skeleton").orderBy("place"))
    covered = begin.withColumn("reach", reach).filter("reach > place").groupBy("source", "skeleton").agg(F.collect_list(F.col("place").cast("int")).alias("places"))
    lines = skeletons.join(covered, ["source", "skeleton"])
    return lines.select("item", F.explode(F.transform("places", lambda p: F.get("line_nos", p))).alias("line_no")).distinct()


def without_repeated_lines(items: DataFrame, item: str = "id", text: str = "body_text", min_lines: int = 1, **parameters) -> DataFrame:
    """``items`` with ``clean_text``: ``text`` without the repeated lines; nulls stay null."""
    gone = repeated_lines(items, min_lines, item=item, text=text, **parameters).groupBy(F.col("item").alias("_item")).agg(F.collect_set("line_no").alias("_gone"))
    d = items.join(gone, items[item] == F.col("_item"), "left").drop("_item")
    kept = F.filter(F.split(F.col(text), "\n", -1), lambda x, i: ~F.array_contains("_gone", (i + 1).cast("long")))
    return d.withColumn("clean_text", F.when(F.col("_gone").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))).drop("_gone")
