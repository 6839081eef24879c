"""Evidence outside a claim's own item: documents by common features, other sources, organisations by set variants."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.relational import top_per
from factloom.session import cut

_KINDS = ("numbers", "names", "words")
#: Claims and documents of one number or name that meet in one task, claims looked at together, and what is met with others in one call.
CLAIMS, DOCUMENTS, ROWS, RARE = 8_000, 5_000, 250, 400


def best_documents(claims: DataFrame, documents: DataFrame, number: str, name: str, word: str, k: int) -> DataFrame:
    """(id, item, score, reliable): the ``k`` best of ``documents`` (item, text, official) for each claim (id, content_item_id, text).

    5 a common number, 2 a common name, 2.5 a common long word, 1 for an
    official source. Only documents that share a number or a name are met, under
    each of these, as products of matrices that keep the ``k`` best at once; a
    frequent one is met in parts. Reliable is a number with a word, or a name with two words.
    """

    def features(d: DataFrame) -> DataFrame:
        found = lambda p, t: F.array_distinct(F.regexp_extract_all(t, F.lit(p), 1))
        t = F.coalesce("text", F.lit(""))
        return d.withColumns({"numbers": found(number, t), "names": found(name, t), "words": found(word, F.lower(t))}).drop("text")

    hashed = lambda d: d.withColumns({c: F.transform(c, lambda x: F.xxhash64(x)) for c in _KINDS})
    keyed = lambda d, *c: hashed(d.select(*c, *_KINDS, F.explode(F.array_distinct(F.concat("numbers", "names"))).alias("k")))
    a, b = keyed(features(claims), "id", "content_item_id"), keyed(features(documents), "item", "official")
    count = lambda d, n: d.groupBy("k").agg(F.count(F.lit(1)).alias(n))
    met = cut(count(a, "_na").join(count(b, "_nb"), "k"))
    rare = (F.col("_na") < RARE) & (F.col("_nb") < RARE)
    groups = max(1, int((met.filter(rare).agg(F.sum(F.col("_na") + F.col("_nb")).alias("n")).first().n or 0) // max(1, 2 * RARE)))
    # rare ones share a task's call: those that have none in common there are told by their sets
    parts = met.select(
        "k", F.when(rare, "").otherwise(F.col("k")).alias("_k"), F.when(rare, F.pmod(F.xxhash64("k"), F.lit(groups))).otherwise(-1).alias("_g"),
        F.ceil(F.col("_na") / CLAIMS).alias("_ca"), F.ceil(F.col("_nb") / DOCUMENTS).alias("_cb"),
    )
    part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    a = a.join(parts, "k").withColumn("_a", part("id", "_ca")).withColumn("_b", every("_cb")).drop("_ca", "_cb")
    b = b.join(parts.withColumnsRenamed({"_k": "_kb", "_g": "_gb"}), "k").withColumn("_b", part("item", "_cb")).withColumn("_a", every("_ca")).drop("_ca", "_cb")

    def best(x, y):
        return _best(x, y, k)

    y = a.groupBy("_k", "_g", "_a", "_b").cogroup(b.groupBy("_kb", "_gb", "_a", "_b")).applyInArrow(best, "id long, item long, score double, reliable boolean").distinct()
    return top_per(y, ["id"], [F.col("reliable").desc(), F.col("score").desc(), F.col("item")], k).drop("rank")


def _incidence(flat: np.ndarray, row: np.ndarray, rows: int, columns: np.ndarray) -> np.ndarray:
    """Which of ``columns`` (ascending) each row has."""
    out = np.zeros((rows, len(columns)), np.float32)
    if len(columns):
        at = np.minimum(np.searchsorted(columns, flat), len(columns) - 1)
        there = columns[at] == flat
        out[row[there], at[there]] = 1
    return out


def _best(claims, documents, k: int):
    """The k best of some documents that share a key with all of some claims, for each claim."""
    names, kinds = ["id", "item", "score", "reliable"], [pa.int64(), pa.int64(), pa.float64(), pa.bool_()]
    if not claims.num_rows or not documents.num_rows:
        return pa.table([pa.array([], t) for t in kinds], names=names)
    first = lambda t, c: t.take(pa.array(np.unique(t[c].to_numpy(), return_index=True)[1]))
    claims, documents = first(claims, "id"), first(documents, "item")
    item, official = documents["item"].to_numpy(), documents["official"].to_numpy().astype(np.float32)

    def flat(t, kind):
        x = t[kind].combine_chunks()
        lists = x.chunk(0) if isinstance(x, pa.ChunkedArray) else x
        return lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())

    theirs = {c: flat(documents, c) for c in _KINDS}
    out = []
    for lo in range(0, claims.num_rows, ROWS):
        t = claims.slice(lo, ROWS)
        common = {}
        for c in _KINDS:
            own, row = flat(t, c)
            columns = np.intersect1d(own, theirs[c][0])
            common[c] = _incidence(own, row, t.num_rows, columns) @ _incidence(*theirs[c], len(item), columns).T
        score = common["numbers"] * 5 + common["names"] * 2 + common["words"] * 2.5 + official
        reliable = ((common["numbers"] > 0) & (common["words"] > 0)) | ((common["names"] > 0) & (common["words"] >= 2))
        # halves as whole numbers, then the earlier item: one number orders all
        order = (reliable * 1e6 + score * 2.0).astype(np.float64) * len(item) - np.arange(len(item))
        order[common["numbers"] + common["names"] == 0] = -np.inf
        order[t["content_item_id"].to_numpy()[:, None] == item] = -np.inf
        top = np.argpartition(-order, k - 1, axis=1)[:, :k] if k < len(item) else np.tile(np.arange(len(item)), (t.num_rows, 1))
        i, j = np.repeat(np.arange(t.num_rows), top.shape[1]), top.ravel()
        keep = np.isfinite(order[i, j])
        i, j = i[keep], j[keep]
        out.append(pa.table([pa.array(x) for x in (t["id"].to_numpy()[i], item[j], score[i, j].astype(np.float64), reliable[i, j])], names=names))
    return pa.concat_tables(out)


def corroborating(claims: DataFrame, mentions: DataFrame) -> DataFrame:
    """(id, source_id, way, item): for each claim the first item of every other source that makes the same claim (way 1), else whose claim shares an entity (way 2).

    A text, and a source's claims on an entity, are one row each with their
    first item before anything meets, so copies and hot entities cost no pairs.
    """
    c = claims.select("id", "content_item_id", "source_id", F.lower("claim_text").alias("t"))
    same = c.groupBy("t", F.col("source_id").alias("other")).agg(F.min("content_item_id").alias("item"))
    one = c.join(same, "t").filter("other != source_id").select("id", F.col("other").alias("source_id"), F.lit(1).alias("way"), "item")
    m = mentions.select("entity_id", "content_item_id")
    by = m.join(c.select("content_item_id", F.col("source_id").alias("other")).distinct(), "content_item_id").groupBy("entity_id", "other").agg(F.min("content_item_id").alias("item"))
    two = c.join(m, "content_item_id").join(by, "entity_id").filter("other != source_id").groupBy("id", "other").agg(F.min("item").alias("item"))
    both = one.unionByName(two.select("id", F.col("other").alias("source_id"), F.lit(2).alias("way"), "item"))
    best = both.groupBy("id", "source_id").agg(F.min(F.struct("way", "item")).alias("b"))
    return best.select("id", "source_id", "b.way", "b.item")


def by_variant(rows: DataFrame, organisations: DataFrame, variants: Sequence[tuple[str, str]]) -> DataFrame:
    """(id, entity_id) of rows (id, name) whose name is the name of one organisation (id, name) alone, or a variant of it (pattern, replacement); case and ends aside."""
    k = F.lower(F.trim("name"))
    forms = F.array_distinct(F.array(k, *[F.regexp_replace(k, p, r) for p, r in variants]))
    o = organisations.select(F.col("id").alias("entity_id"), F.explode(forms).alias("k"))
    o = o.groupBy("k").agg(F.min("entity_id").alias("entity_id"), F.max("entity_id").alias("_hi")).filter("entity_id = _hi").drop("_hi")
    return rows.select("id", k.alias("k")).join(o, "k").select("id", "entity_id")

