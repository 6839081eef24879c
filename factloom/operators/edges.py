"""One table of edges between entities, items, claims, bills, sessions and contracts, and walks over it.

An edge is (src, dst, relation_type, context, strength); a node is a text of
its kind and id. Finders of neighbours are made once for all nodes, so a walk
is a join. Reports' limits hold for each source of an edge, by a total order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.relational import either_end, shared_groups, top_per
from factloom.session import cut


def node(kind: str, column: str) -> Column:
    return F.concat(F.lit(kind + ":"), F.col(column).cast("string"))


def edge(rows: DataFrame, src: Column, dst: Column, kind: Column | str, context: Column | str = "", strength: Column | float = 1.0) -> DataFrame:
    """Edges of rows; rows without an end give none."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    e = rows.select(src.alias("src"), dst.alias("dst"), lit(kind).alias("relation_type"), lit(context).cast("string").alias("context"), lit(strength).cast("double").alias("strength"))
    return e.filter("src is not null and dst is not null and src != dst")


def both_ways(edges: DataFrame) -> DataFrame:
    turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "relation_type", "context", "strength")
    return edges.unionByName(turned)


def merged(edges: DataFrame, most: int = 20) -> DataFrame:
    """One edge for each (src, dst, relation_type): the greatest strength, the number of edges and the first ``most`` contexts in order."""
    g = edges.groupBy("src", "dst", "relation_type")
    contexts = F.array_join(F.slice(F.sort_array(F.collect_set(F.when(F.col("context") != "", F.col("context")))), 1, most), ",")
    return g.agg(F.max("strength").alias("strength"), F.count(F.lit(1)).alias("merged"), contexts.alias("contexts"))


def stored_relations(relations: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """Stored relations (a, b, relation_type) from both ends, without the types in ``skip``."""
    r = relations.filter(~F.col("relation_type").isin(*skip)) if skip else relations
    return both_ways(edge(r, node("entity", "a"), node("entity", "b"), F.col("relation_type"), "relation", 0.9))


def sponsor_edges(sponsors: DataFrame, most: int = 12) -> DataFrame:
    """sponsored_bill from entities to bills and back; co_sponsor between entities under a bill of at most ``most`` sponsors."""
    s = sponsors.select("bill_id", "entity_id").dropna().distinct()
    own = both_ways(edge(s, node("entity", "entity_id"), node("bill", "bill_id"), "sponsored_bill", "sponsor", 0.9))
    pairs = shared_groups(s, "bill_id", "entity_id", 1, most)
    return own.unionByName(both_ways(edge(pairs, node("entity", "a"), node("entity", "b"), "co_sponsor", F.col("shared"), 0.6)))


def vote_edges(votes: DataFrame, sessions: DataFrame, newest: int = 200) -> DataFrame:
    """voted_... from entities to their newest sessions; about_bill from sessions to bills and back."""
    v = votes.select("entity_id", "vote_session_id", "vote_result").dropna().groupBy("entity_id", "vote_session_id").agg(F.min("vote_result").alias("r"))
    v = top_per(v, ["entity_id"], [F.col("vote_session_id").desc()], newest)
    own = edge(v, node("entity", "entity_id"), node("session", "vote_session_id"), F.concat(F.lit("voted_"), "r"), "vote", 0.8)
    return own.unionByName(both_ways(edge(sessions.select("id", "bill_id").distinct(), node("session", "id"), node("bill", "bill_id"), "about_bill", "session", 1.0)))


def co_voters(agreements: DataFrame, least: int = 3, k: int = 50) -> DataFrame:
    """co_voter from each entity to the ``k`` that voted most often like it (a, b, same), ``least`` sessions or more."""
    x = either_end(agreements.filter(F.col("same") >= least), "a", "b", ["same"])
    x = top_per(x, ["this"], [F.col("same").desc(), F.col("other")], k)
    return edge(x, node("entity", "this"), node("entity", "other"), "co_voter", F.col("same"), 0.5)


def mention_edges(mentions: DataFrame, k: int = 50, in_item: int = 80) -> DataFrame:
    """mentioned_together between entities of two items or more, the ``k`` of each by items; mentions_entity from items to entities by confidence."""
    many = mentions.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("entity_id")
    pairs = either_end(shared_groups(mentions.join(many, "entity_id", "left_semi"), "content_item_id", "entity_id", 2), "a", "b", ["shared"])
    pairs = top_per(pairs, ["this"], [F.col("shared").desc(), F.col("other")], k)
    own = top_per(mentions, ["content_item_id"], [F.col("confidence").desc(), F.col("entity_id")], in_item)
    return edge(pairs, node("entity", "this"), node("entity", "other"), "mentioned_together", F.col("shared"), 0.3).unionByName(
        edge(own, node("item", "content_item_id"), node("entity", "entity_id"), "mentions_entity", "mention", F.col("confidence"))
    )


def contract_edges(parties: DataFrame) -> DataFrame:
    """government_contract from entities to contracts and back; same_inn between entities of one INN (digits)."""
    p = parties.select("contract_id", "entity_id").dropna().distinct()
    own = both_ways(edge(p, node("entity", "entity_id"), node("contract", "contract_id"), "government_contract", "party", 0.9))
    inn = parties.select("entity_id", F.regexp_replace("inn", r"\D", "").alias("inn")).filter("inn != ''").dropna().distinct()
    pairs = shared_groups(inn, "inn", "entity_id", 1)
    return own.unionByName(both_ways(edge(pairs, node("entity", "a"), node("entity", "b"), "same_inn", "inn", 0.95)))


def claim_edges(claims: DataFrame, mentions: DataFrame, links: DataFrame, k: int = 150) -> DataFrame:
    """has_claim from entities to the ``k`` claims of their items with most evidence; reported_in from claims to their items, has_evidence to linked ones."""
    n = links.groupBy(F.col("claim_id").alias("id")).agg(F.count_distinct("evidence_item_id").alias("n"))
    c = claims.select("id", "content_item_id")
    x = c.join(mentions.select("content_item_id", "entity_id"), "content_item_id").join(n, "id", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    x = top_per(x, ["entity_id"], [F.col("n").desc(), F.col("id")], k)
    out = edge(x, node("entity", "entity_id"), node("claim", "id"), "has_claim", F.col("n"), 0.7)
    out = out.unionByName(edge(c, node("claim", "id"), node("item", "content_item_id"), "reported_in", "claim", 1.0))
    e = links.join(c.select(F.col("id").alias("claim_id")), "claim_id", "left_semi").select("claim_id", "evidence_item_id").distinct()
    return out.unionByName(edge(e, node("claim", "claim_id"), node("item", "evidence_item_id"), "has_evidence", "link", 0.8))


def investigation(edges: DataFrame, seeds: DataFrame, most_hops: int = 3, least: float = 0.0, most_nodes: int | None = 500, most_edges: int | None = 2_000, types: tuple[str, ...] = ()) -> DataFrame:
    """(src, dst, relation_type, strength, hop) of the edges met from seed nodes (node), nearest first.

    Edges below ``least`` or of other types (if given) are not gone. The asked
    caps (None: no cap) hold after each hop: of new nodes the least by (strength of the best
    edge, name) stay, of edges the strongest. What is kept is bounded by them,
    so each hop is a join of the edge table with a small frontier.
    """
    e = edges.filter(F.col("strength") >= least)
    if types:
        e = e.filter(F.col("relation_type").isin(*types))
    e = cut(e)  # made once, not in every hop
    seen = cut(seeds.select("node").distinct().withColumn("hop", F.lit(0)))
    out = None
    for h in range(1, most_hops + 1):
        frontier = seen.filter(F.col("hop") == h - 1).select(F.col("node").alias("src"))
        met = e.join(frontier, "src").select("src", "dst", "relation_type", "strength")
        fresh = met.join(seen.select(F.col("node").alias("dst")), "dst", "left_anti").groupBy("dst").agg(F.max("strength").alias("s"))
        if most_nodes is not None:
            fresh = fresh.orderBy(F.col("s").desc(), "dst").limit(max(0, most_nodes - seen.count()))
        fresh = cut(fresh.select(F.col("dst").alias("node"), F.lit(h).alias("hop")))
        part = met.join(seen.select("node").unionByName(fresh.select("node")).withColumnRenamed("node", "dst"), "dst", "left_semi")
        if most_edges is not None:
            part = part.orderBy(F.col("strength").desc(), "src", "dst", "relation_type").limit(max(0, most_edges - (out.count() if out is not None else 0)))
        part = part.withColumn("hop", F.lit(h))
        out = cut(part if out is None else out.unionByName(part))
        seen = cut(seen.unionByName(fresh))
    return out.select("src", "dst", "relation_type", "strength", "hop")


def statistics(found: DataFrame) -> DataFrame:
    """(what, name, n): edges by relation type and by hop, nodes by kind."""
    nodes = found.select(F.explode(F.array("src", "dst")).alias("node")).distinct().groupBy(F.substring_index("node", ":", 1).alias("name"))
    out = found.groupBy(F.col("relation_type").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("relation").alias("what"), "name", "n")
    out = out.unionByName(found.groupBy(F.col("hop").cast("string").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("hop").alias("what"), "name", "n"))
    return out.unionByName(nodes.agg(F.count(F.lit(1)).alias("n")).select(F.lit("node").alias("what"), "name", "n"))
