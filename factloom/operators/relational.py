"""Relational building blocks: keyed writes, pair joins, windows, samples.

Every function takes and returns DataFrames, reads only the columns it names,
and leaves physical choices to the optimiser. Nulls in key columns never match.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators import ballots
from factloom.session import cut, parallelism

#: Rows of a join of pairs from which blocks are worth their planning.
MET = 5_000_000


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
    """``old`` with the rows of ``new`` put in: the last by ``order`` wins among new rows of one key.

    The key columns decide; columns that only one side has are null on the other's rows.
    """
    w = Window.partitionBy(*keys).orderBy(*(order or [F.lit(0)]))
    last = new.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    return old.join(last.select(*keys), list(keys), "left_anti").unionByName(last, allowMissingColumns=True)


def insert_missing(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``old`` and the new rows whose key it lacks, one a key."""
    fresh = new.dropDuplicates(list(keys)).join(old.select(*keys), list(keys), "left_anti")
    return old.unionByName(fresh, allowMissingColumns=True)


def replace_derived(old: DataFrame, derived: DataFrame, mark: Column) -> DataFrame:
    """All rows under ``mark`` replaced by ``derived``."""
    return old.filter(~F.coalesce(mark, F.lit(False))).unionByName(derived, allowMissingColumns=True)


def merge_entities(mentions: DataFrame, merges: DataFrame, cap: float = 0.85) -> DataFrame:
    """Mentions (entity_id, content_item_id, confidence) moved along merges (from_id, to_id).

    A moved mention's confidence is capped; where the target has its own on the
    same content, that one stays.
    """
    m = mentions.join(merges, mentions.entity_id == merges.from_id, "left")
    moved = F.col("to_id").isNotNull()
    m = m.select(
        F.coalesce("to_id", "entity_id").alias("entity_id"), "content_item_id", F.when(moved, F.least("confidence", F.lit(cap))).otherwise(F.col("confidence")).alias("confidence"), moved.alias("_moved")
    )
    best = m.groupBy("entity_id", "content_item_id").agg(F.max(F.struct((~F.col("_moved")).alias("own"), "confidence")).alias("b"))
    return best.select("entity_id", "content_item_id", F.col("b.confidence").alias("confidence"))


def merged_aliases(entities: DataFrame, merges: DataFrame) -> DataFrame:
    """(entity_id, alias): the names under which merged entities (from_id, to_id) are still found, each once."""
    e = entities.select(F.col("id").alias("from_id"), F.col("canonical_name").alias("alias"))
    return merges.join(e, "from_id").filter("alias is not null").select(F.col("to_id").alias("entity_id"), "alias").distinct()


def numbered(df: DataFrame, group: str, order: Sequence[str], name: str = "position") -> DataFrame:
    """Adds ``name``: a row's place (from 0) in its group by ``order``, which must be total.

    The table is parted by ranges of (group, order) and numbered within parts;
    the parts before are added as offsets. A group of any size is as many parts
    as it needs, never one task's sort.
    """
    n = parallelism(df.sparkSession)
    parts = cut(df.repartitionByRange(n, group, *order).withColumn("_part", F.spark_partition_id()))
    w = Window.partitionBy("_part", group).orderBy(*order)
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = parts.groupBy("_part", group).agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    x = parts.withColumn("_row", F.row_number().over(w) - 1)
    sizes = sizes.withColumnsRenamed({"_part": "_p", group: "_g"})
    x = x.join(sizes, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")))
    return x.withColumn(name, F.col("_before") + F.col("_row")).drop("_part", "_row", "_before", "_p", "_g")


def member_pairs(members: DataFrame, group: str, member: str, max_group: int | None = None, extra: Sequence[str] = ()) -> DataFrame:
    """(group, a, b) with a < b of all members of a group, each pair once a group.

    ``max_group`` leaves out larger groups, where the caller's semantics say
    that such a group relates nobody. Members are made distinct first.
    """
    m = members.select(group, member, *extra).dropna(subset=[group, member]).dropDuplicates([group, member])
    if max_group is not None:
        fit = m.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n").between(2, max_group)).select(group)
        m = m.join(fit, group, "left_semi")
    b = m.select(group, F.col(member).alias("b"))
    return m.withColumnRenamed(member, "a").join(b, group).filter("a < b")


def shared_groups(members: DataFrame, group: str, member: str, least: int, max_group: int | None = None) -> DataFrame:
    """(a, b, shared) of members that share at least ``least`` groups."""
    p = member_pairs(members, group, member, max_group)
    return p.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")).filter(F.col("shared") >= least)


def agreement(votes: DataFrame, session: str, voter: str, vote: str, min_votes: int = 20, min_same: int = 20, min_ratio: float = 0.75, most_met: int = MET) -> DataFrame:
    """(a, b, shared, same, ratio) of voters who vote alike; one vote a voter and session (the least).

    All pairs of a session meet. Where that is more than ``most_met`` rows, and
    nearly all voters meet, they are counted by blocks of voters instead.
    """
    v = votes.select(session, voter, vote).dropna().groupBy(session, voter).agg(F.min(vote).alias("v"))
    active = v.groupBy(voter).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_votes).select(voter)
    v = v.join(active, voter, "left_semi")
    met = v.groupBy(session).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("sessions"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("rows")).first()
    if (met.rows or 0) > most_met:
        v = cut(v)
        voters, votes = v.agg(F.count_distinct(voter), F.count_distinct("v")).first()
        # a row of the join costs some thousand multiplications
        if voters * voters / 2 * met.sessions * (1 + votes) < met.rows * 3000:
            return ballots.agreeing(v, session, voter, min_votes, min_same, min_ratio, voters)
    a, b = v.toDF("a", "s", "va") if v.columns[0] == voter else v.select(voter, session, "v").toDF("a", "s", "va"), v.select(voter, session, "v").toDF("b", "s", "vb")
    p = a.join(b, "s").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.count_if(F.col("va") == F.col("vb")).alias("same"))
    return p.withColumn("ratio", F.round(F.col("same") / F.col("shared"), 4)).filter((F.col("shared") >= min_votes) & (F.col("same") >= min_same) & (F.col("ratio") >= min_ratio))


def either_end(edges: DataFrame, a: str, b: str, keep: Sequence[str] = ()) -> DataFrame:
    """Every edge from both of its ends: (this, other, ...)."""
    one = edges.select(F.col(a).alias("this"), F.col(b).alias("other"), *keep)
    return one.unionByName(edges.select(F.col(b).alias("this"), F.col(a).alias("other"), *keep))


def near_in_time(left: DataFrame, right: DataFrame, key: str, days: int = 3) -> DataFrame:
    """Inner join of rows with equal ``key`` whose ``ts`` lie at most ``days`` apart: buckets of that width, then a recheck.

    Columns of the right side are named ``r_...``.
    """
    width = days * 86_400
    bucket = lambda c: F.floor(F.unix_timestamp(c) / width)
    a = left.withColumn("_b", bucket("ts"))
    b = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns]).withColumn("_o", F.explode(F.array(*map(F.lit, (-1, 0, 1)))))
    b = b.withColumn("_rb", bucket("r_ts") + F.col("_o")).drop("_o")
    out = a.join(b, (a[key] == b[f"r_{key}"]) & (a["_b"] == b["_rb"]))
    return out.filter(F.abs(F.unix_timestamp("ts") - F.unix_timestamp("r_ts")) <= width).drop("_b", "_rb")


def top_per(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group, with ``rank``; the order must be total."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_per(df, keys, order, 1).drop("rank")


def following(df: DataFrame, by: str, order: Sequence[Column], reach: int, limit: int | None = None) -> DataFrame:
    """Each row of a group (of its first ``limit``, if given) with its next ``reach`` rows, which are named ``n_...``."""
    df, w = df.filter(F.col(by).isNotNull()), Window.partitionBy(by).orderBy(*order)
    r = df.withColumn("rank", F.row_number().over(w)) if limit is None else top_per(df, [by], order, limit)
    # a window, not a join on ranks: that meets all pairs of a group
    n = F.collect_list(F.struct(*[F.col(c).alias(f"n_{c}") for c in r.columns])).over(Window.partitionBy(by).orderBy("rank").rowsBetween(1, reach))
    return r.withColumn("_n", n).select(*r.columns, F.explode("_n").alias("_n")).select(*r.columns, "_n.*")


def round_robin(df: DataFrame, group: str, order: Sequence[Column], limit: int) -> DataFrame:
    """A sample that takes the groups in turn, in order of their names (a top-k report)."""
    g = F.coalesce(F.col(group).cast("string"), F.lit("unknown"))
    r = df.withColumn("_g", g).withColumn("turn", F.row_number().over(Window.partitionBy("_g").orderBy(*order)))
    return r.filter(F.col("turn") <= limit).orderBy("turn", "_g").limit(limit).drop("_g")


def quota_sample(df: DataFrame, bucket: str, key: str, quotas: dict[str, int] | int, total: int, seed: str) -> DataFrame:
    """Quotas a bucket (one number for all, or by name) by a stable rank (hash of seed and key), then filled up from the rest by the same rank.

    Buckets are cut to their quotas before any of them is sorted whole, and the
    rest is a top-k, so a bucket of a third of all rows is never one task's.
    """
    r = df.withColumn("_h", F.sha2(F.concat(F.lit(seed + ":"), F.col(key).cast("string")), 256))
    most = quotas if isinstance(quotas, int) else max(quotas.values(), default=0)
    first = top_per(r, [bucket], [F.col("_h"), F.col(key)], most)
    if not isinstance(quotas, int):
        limit = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv]), F.col(bucket)), F.lit(0)) if quotas else F.lit(0)
        first = first.filter(F.col("rank") <= limit)
    first = first.drop("rank").withColumn("by_quota", F.lit(True))
    first = first.orderBy("_h", key).limit(total)
    rest = r.join(F.broadcast(first.select(key)), key, "left_anti").orderBy("_h", key).limit(total).withColumn("by_quota", F.lit(False))
    both = first.unionByName(rest)
    chosen = both.orderBy(F.col("by_quota").desc(), "_h", key).limit(total)
    return chosen.select(*df.columns, "by_quota")


def total_variation(now: DataFrame, before: DataFrame, label: str, n: str) -> DataFrame:
    """One row: half the summed differences of two label distributions, to four places (0 if both are empty)."""
    share = lambda d, name: d.select(F.coalesce(F.col(label).cast("string"), F.lit("unknown")).alias("l"), F.col(n)).groupBy("l").agg(F.sum(n).alias(name))
    a, b = share(now, "a"), share(before, "b")
    ta, tb = a.agg(F.sum("a").alias("ta")), b.agg(F.sum("b").alias("tb"))
    both = a.join(b, "l", "full").crossJoin(F.broadcast(ta)).crossJoin(F.broadcast(tb))
    part = lambda x, t: F.coalesce(F.col(x) / F.nullif(F.col(t), F.lit(0)), F.lit(0.0))
    return both.agg(F.round(0.5 * F.coalesce(F.sum(F.abs(part("a", "ta") - part("b", "tb"))), F.lit(0.0)), 4).alias("distance"))
