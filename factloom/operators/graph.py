"""Graph operators over edge DataFrames: degrees, components, hops, chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.relational import either_end, top_per
from factloom.session import cut


def degrees(edges: DataFrame, a: str, b: str) -> DataFrame:
    return either_end(edges, a, b).groupBy(F.col("this").alias("id")).agg(F.count(F.lit(1)).alias("degree"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the least id of each connected component.

    Large-star and small-star rounds on the edge table, checkpointed; a round
    halves paths, and every step is an aggregation by one end, so a vertex of
    many edges is never held by one task.
    """
    e = cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).dropna().filter("u != v").distinct())
    vertices = e.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    # two rounds gave the same edges if their number and two sums of hashes agree: one pass instead of two differences
    mark = lambda x: tuple(x.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 40)))).first())
    last = mark(e)
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        new = cut(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct())
        now = mark(new)
        if now == last:
            return vertices.join(new.select(F.col("u").alias("id"), F.col("v").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
        e, last = new, now


def hops(edges: DataFrame, seeds: DataFrame, a: str, b: str, most: int = 3, max_nodes: int | None = None) -> DataFrame:
    """(id, hop) of all vertices within ``most`` hops of the seeds (id).

    ``max_nodes`` ends the walk with the hop in which that many are reached;
    within it the least ids stay (the cap is part of the asked semantics).
    """
    links = either_end(edges, a, b).distinct()
    seen = cut(seeds.select(F.col("id"), F.lit(0).alias("hop")).distinct())
    for h in range(1, most + 1):
        edge = seen.filter(F.col("hop") == h - 1).select(F.col("id").alias("this"))
        new = links.join(edge, "this").select(F.col("other").alias("id")).distinct().join(seen.select("id"), "id", "left_anti")
        new = new.withColumn("hop", F.lit(h))
        if max_nodes is not None:
            new = new.orderBy("id").limit(max(0, max_nodes - seen.count()))
        seen = cut(seen.unionByName(new))
        if max_nodes is not None and seen.count() >= max_nodes:
            break
    return seen


def chains(edges: DataFrame, seeds: DataFrame, a: str, b: str, weight: str, depth: int = 4, frontier: int = 256, keep: int = 20) -> DataFrame:
    """(path, edges, score): the best simple paths from each seed, by mean weight, longer first among equals.

    Hop by hop, the best ``frontier`` paths of a seed go on; the bound is the
    asked best-first semantics and makes the result small.
    """
    links = cut(either_end(edges, a, b, [weight]).groupBy("this", "other").agg(F.max(weight).alias("w")))
    paths = seeds.select(F.col("id").alias("seed"), F.array("id").alias("path"), F.lit(0.0).alias("total"))
    out = None
    for h in range(1, depth + 1):
        step = paths.withColumn("this", F.element_at("path", -1)).join(links, "this").filter(~F.array_contains("path", F.col("other")))
        step = step.select("seed", F.array_append("path", F.col("other")).alias("path"), (F.col("total") + F.col("w")).alias("total"))
        paths = cut(top_per(step, ["seed"], [F.col("total").desc(), F.col("path")], frontier).drop("rank"))
        done = paths.select("seed", "path", F.lit(h).alias("edges"), F.round(F.col("total") / h, 4).alias("score"))
        out = done if out is None else out.unionByName(done)
    return top_per(out, ["seed"], [F.col("score").desc(), F.col("edges").desc(), F.col("path")], keep)


def best_bridge(pairs: DataFrame, bridges: DataFrame, group: str, member: str, cost: str) -> DataFrame:
    """The cheapest bridge between the members of each pair (a, b): two edges through one shared vertex."""
    x, y = bridges.select(group, F.col(member).alias("a"), F.col(cost).alias("ca")), bridges.select(group, F.col(member).alias("b"), F.col(cost).alias("cb"))
    met = pairs.join(x, "a").join(y, ["b", group])
    best = met.groupBy("a", "b").agg(F.min(F.struct((F.col("ca") + F.col("cb")).alias("cost"), F.col(group).alias("via"))).alias("m"))
    return best.select("a", "b", "m.via", "m.cost")


def communities(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 20) -> DataFrame:
    """(id, community) by label propagation, the same at every size: ends after ``most_rounds`` rounds, or when no label changes.

    In a round every vertex takes the label that most of its neighbours and
    itself bear, of equally frequent ones the least. Rounds go by turns over
    vertices of even and odd hashes, so two labels never swap for ever. A round
    is two aggregations by (vertex, label); a community is named by its least id.
    """
    e = edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).dropna().filter("u != v").distinct()
    links = cut(either_end(e, "u", "v"))
    at = cut(links.select(F.col("this").alias("id")).distinct().withColumn("label", F.col("id")))
    still = 0
    for turn in range(2 * most_rounds):
        mine = at.filter(F.pmod(F.xxhash64("id"), F.lit(2)) == turn % 2)
        near = links.join(at.select(F.col("id").alias("other"), "label"), "other").select(F.col("this").alias("id"), "label")
        votes = near.join(mine.select("id"), "id", "left_semi").unionByName(mine).groupBy("id", "label").agg(F.count(F.lit(1)).alias("n"))
        best = votes.groupBy("id").agg(F.max(F.struct("n", (-F.col("label")).alias("l"))).alias("m")).select("id", (-F.col("m.l")).alias("new"))
        now = cut(at.join(best, "id", "left").select("id", F.coalesce("new", "label").alias("label"), (F.coalesce("new", "label") != F.col("label")).alias("moved")))
        still = 0 if now.filter("moved").take(1) else still + 1
        at = now.drop("moved")
        if still == 2:
            break
    names = at.groupBy("label").agg(F.min("id").alias("community"))
    return at.join(names, "label").select("id", "community")


def greedy_communities(edges: DataFrame, a: str = "a", b: str = "b", most_nodes: int = 15_000) -> DataFrame:
    """(id, community) by greedy modularity: the pair of groups whose union gains most is joined, while any gains.

    For small graphs: beyond ``most_nodes`` vertices or twenty times as many
    edges, which is checked before anything is collected, it refuses.
    A community is named by its least id.
    """
    e = edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).dropna().filter("u != v").distinct()
    e = cut(e)
    if e.select(F.explode(F.array("u", "v")).alias("id")).distinct().count() > most_nodes or e.count() > 20 * most_nodes:
        raise ValueError(f"more than {most_nodes} vertices or {20 * most_nodes} edges: use communities")
    links: dict[int, dict[int, float]] = {}
    m = 0
    for r in e.toLocalIterator():
        links.setdefault(r.u, {})[r.v] = 1.0
        links.setdefault(r.v, {})[r.u] = 1.0
        m += 1
    degree = {i: float(len(x)) for i, x in links.items()}
    member = {i: [i] for i in links}
    while m:
        gains = ((w / m - degree[i] * degree[j] / (2 * m * m), -i, -j) for i, x in links.items() for j, w in x.items() if i < j)
        gain, i, j = max(gains, default=(0.0, 0, 0))
        if gain <= 1e-12:
            break
        i, j = -i, -j
        for k, w in links.pop(j).items():
            links[k].pop(j)
            if k != i:
                links[i][k] = links[k][i] = links[i].get(k, 0.0) + w
        degree[i] += degree.pop(j)
        member[i] += member.pop(j)
    rows = [(i, min(x)) for x in member.values() for i in x]
    return edges.sparkSession.createDataFrame(rows, "id long, community long")
