"""New batches against everything already accepted (problem 3).

The accepted items live in an index of tables in a folder. It is made of
segments; a batch adds one, and segments of like size are merged, so a row is
written a logarithm of times. A segment has

* ``vectors`` - the full sparse vector (set of word-run hashes) of every
  accepted text, once;
* ``cells`` - an inverted file by coordinate: the vectors that have it among
  their first ones in a fixed order, rare coordinates first, with sizes and
  sketches;
* ``keys`` - the exact keys (hash, external id, file, equal text) of accepted items.

Each is parted on disk into groups by the first bits of what it is looked up
by; a segment has as many groups as its size asks for, so groups never grow.
``ranks`` is the order of coordinates. A commit names the segments that hold;
it is written last, under the next number, so what a lost job wrote is never
read, and any later job can open the folder and go on.

A new vector probes the cells of its coordinates in that order. After p cells
without it, a match can share at most n - p coordinates, so its similarity is
at most (n - p) / n: probing ends where that bound falls below the threshold,
and every vector near enough has been met. Only groups that a batch names are
read; a bitmap of the batch's coordinates sifts their rows in the scan, so that
what is shuffled is what the batch meets, not the history. What is met is
bounded further by sizes and positions and by segment bitmaps, then reranked
exactly with the full vectors. Accepted items are appended.

Within a batch, items are judged in order of id. An item that is not linked to
a smaller undecided or accepted one is accepted, one linked to a smaller
accepted one is a duplicate; rounds go on until nobody is undecided. Items
meet in groups (keys) of which only the least ids matter, so a key that a
third of all rows share is one minimum, never a list of pairs.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.neardup import PER_PARTITION, Entries, NearDuplicates, _rows, counter_blocks, element_counts, ranks_of
from factloom.llm.sieve import Sieve
from factloom.session import cut, scratch

#: Groups read by name; a batch that touches more of a segment reads it whole.
MOST_GROUPS = 10_000

# Fixed value: SHA-256 of nothing.
EMPTY_HASH = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def _group(kind: str, *parts) -> F.Column:
    return F.xxhash64(F.lit(kind), *parts)


def hash_key(h) -> F.Column:
    """A hash value however it is written: the 64 hexadecimal digits, else its letters and digits."""
    low = F.lower(h)
    digits = F.regexp_extract(low, r"([0-9a-f]{64})(?![0-9a-f])", 1)
    plain = F.regexp_replace(low, r"[^\p{L}\p{Nd}]", "")
    key = F.when(digits != "", digits).otherwise(plain)
    return F.when((key != "") & (key != EMPTY_HASH), key)


def exact_keys(items: DataFrame, blobs: DataFrame) -> DataFrame:
    """(id, g): the groups of items by hash, by source and external id, and by document or video file."""
    a = items.select("id", hash_key(F.col("hash_sha256")).alias("key")).filter("key is not null").select("id", _group("a", F.col("key")).alias("g"))
    external = F.regexp_replace(F.lower("external_id"), r"[^\p{L}\p{N}]", "")
    b = items.select("id", "source_id", external.alias("key")).filter("key != '' and source_id is not null").select("id", _group("b", F.col("source_id"), F.col("key")).alias("g"))
    f = blobs.filter(F.col("blob_type").isin("document", "video")).select(F.col("raw_item_id").alias("id"), F.trim(F.lower("hash_sha256")).alias("key"))
    c = f.filter("key != '' and id is not null").select("id", _group("c", F.col("key")).alias("g"))
    return a.unionByName(b).unionByName(c.join(items.select("id"), "id", "left_semi")).distinct()


def payload_text(payload) -> F.Column:
    """The value of ``text`` in a valid JSON payload, else null."""
    return F.try_variant_get(F.try_parse_json(payload), "$.text", "string")


def resolve(member: DataFrame, near: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """(id, kept_id) of the items that repeat an accepted one.

    ``member`` (id, g): the groups of the batch's items; ``near`` (g, h): groups
    whose members repeat each other's, in both directions; ``old`` (g, kept):
    the least accepted id of groups from before.
    """
    many = member.groupBy("g").agg(F.count_distinct("id").alias("n")).filter("n > 1").select("g")
    linked = many.unionByName(near.select("g"))
    if old is not None:
        linked = linked.unionByName(old.select("g"))
        linked = linked.unionByName(near.join(old.select(F.col("g").alias("h")), "h", "left_semi").select("g"))
    member = cut(member.join(linked.distinct(), "g", "left_semi").distinct())
    near = cut(near.distinct())
    state = cut(member.select("id").distinct().withColumn("accepted", F.lit(False)))  # rejected items leave it
    while True:
        live = member.join(state, "id")
        least = live.groupBy("g").agg(F.min("id").alias("any"), F.min(F.when(F.col("accepted"), F.col("id"))).alias("kept"))
        if old is not None:
            before = old.select("g", F.col("kept").alias("any"), "kept")
            least = least.unionByName(before).groupBy("g").agg(F.min("any").alias("any"), F.min("kept").alias("kept"))
        least = cut(least)
        around = least.unionByName(near.join(least.withColumnRenamed("g", "h"), "h").select("g", "any", "kept"))
        around = around.groupBy("g").agg(F.min("any").alias("any"), F.min("kept").alias("kept"))
        seen = cut(member.join(around, "g").groupBy("id").agg(F.min("any").alias("any"), F.min("kept").alias("kept")))
        if state.filter("not accepted").isEmpty():
            return seen.join(state, "id", "left_anti").select("id", F.col("kept").alias("kept_id"))
        now = state.join(seen, "id").filter("accepted or kept is null or kept >= id")
        state = cut(now.select("id", (F.col("accepted") | (F.col("any") >= F.col("id"))).alias("accepted")))


class AcceptedIndex:
    """The accepted items of all batches so far, in the folder ``path``; one job at a time may write to it."""

    def __init__(self, spark: SparkSession, path: str, fan: int = 8, per_group: int = PER_PARTITION):
        """Opens what is committed in ``path``, or begins there. ``fan`` segments of like size are merged; a group is meant for ``per_group`` entries."""
        self.spark, self.path, self.fan, self.per_group = spark, path.rstrip("/"), fan, per_group
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._at = lambda name: hadoop.Path(f"{self.path}/{name}")
        self._fs = hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self.number, self.segments, self.ranks_name = 0, [], None
        if self._fs.exists(self._at("commits")):
            self.number = max((int(f.getPath().getName()) for f in self._fs.listStatus(self._at("commits")) if f.getPath().getName().isdigit()), default=0)
        if self.number:
            last = json.loads(spark.read.text(f"{self.path}/commits/{self.number}", wholetext=True).first().value)
            self.segments, self.ranks_name = last["segments"], last["ranks"]
        self._tidy()

    def _tidy(self) -> None:
        """Removes what no commit names: parts that a lost job or a merge left behind."""
        named = {s["name"] for s in self.segments} | {self.ranks_name}
        for kind in ("vectors", "cells", "keys", "ranks"):
            if self._fs.exists(self._at(kind)):
                for f in self._fs.listStatus(self._at(kind)):
                    if f.getPath().getName() not in named:
                        self._fs.delete(f.getPath(), True)

    def _commit(self, segments: list[dict], ranks: str) -> None:
        """Makes ``segments`` the index: one small file, whole or not there, under the next number."""
        draft, name = self._at(f"commits/draft-{uuid.uuid4().hex}"), self._at(f"commits/{self.number + 1}")
        out = self._fs.create(draft)
        out.write(bytearray(json.dumps({"segments": segments, "ranks": ranks}).encode()))
        out.close()
        if self._fs.exists(name) or not self._fs.rename(draft, name):
            raise RuntimeError(f"another job has written commit {self.number + 1} of {self.path}")
        self.number, self.segments, self.ranks_name = self.number + 1, segments, ranks

    def _ranks(self) -> bytes:
        return bytes(self.spark.read.parquet(f"{self.path}/ranks/{self.ranks_name}").first().ranks)

    def _read(self, kind: str, hashes: DataFrame | None = None, column: str = "") -> DataFrame | None:
        """The rows of a kind; with ``hashes``, of the groups that those name."""
        parts = {b: [s["name"] for s in self.segments if s["bits"] == b] for b in sorted({s["bits"] for s in self.segments})}
        out = None
        for bits, names in parts.items():
            rows = None
            for n in names:
                part = self.spark.read.schema(_SCHEMAS[kind] + ", grp int").parquet(f"{self.path}/{kind}/{n}")
                rows = part if rows is None else rows.unionByName(part)
            if hashes is not None and bits:
                group = F.shiftrightunsigned(F.col(column), 64 - bits).cast("int").alias("grp")
                touched = [r.grp for r in hashes.select(group).distinct().limit(MOST_GROUPS + 1).collect()]
                if len(touched) <= MOST_GROUPS:
                    rows = rows.filter(F.col("grp").isin(touched))
            rows = rows.drop("grp")
            out = rows if out is None else out.unionByName(rows)
        return out

    def cells(self, new: DataFrame) -> DataFrame:
        """(cell, blob, m): of the cells that the entries of ``new`` name, the entries of accepted vectors."""

        def elements(batches):
            for b in batches:
                for blob in b.column("blob").to_pylist():
                    yield pa.RecordBatch.from_arrays([pa.array(np.unique(Entries.unpacked(blob)[0].element).view(np.int64))], names=["e"])

        named = cut(new.select("blob").mapInArrow(elements, "e long").distinct())
        sieve = Sieve(named, "e")

        def each(batches):
            for b in batches:
                for blob in b.column("blob").to_pylist():
                    entries, _ = Entries.unpacked(blob)
                    met = entries.only(np.flatnonzero(sieve.hits(entries.element)))
                    yield _rows(*met.packed(np.zeros(len(met.doc), np.int64), True, False))

        return self._read("cells", named, "e").mapInArrow(each, "cell int, blob binary, m int")

    def vectors(self, sets: DataFrame) -> DataFrame:
        """(set, elements) of the accepted vectors among ``sets``."""
        return Sieve(sets, "set").sifted(self._read("vectors", sets, "set"), "set").join(sets, "set", "left_semi")

    def _parted(self, rows: DataFrame, key: str, bits: int) -> DataFrame:
        group = F.shiftrightunsigned(F.col(key), 64 - bits).cast("int") if bits else F.lit(0)
        return rows.withColumn("grp", group).repartition(1 << bits, "grp")

    def _write(self, vectors: DataFrame, keys: DataFrame, ranks: bytes) -> dict:
        """A new segment, its groups by its own size; not part of the index before a commit names it."""
        name = f"s{uuid.uuid4().hex}"
        vectors, keys = cut(vectors), cut(keys)
        size = vectors.agg(F.sum(F.size("elements")).alias("n")).first().n or 0
        bits = max(0, int(max(size // 2, keys.count()) // self.per_group)).bit_length()
        self._parted(vectors, "set", bits).write.partitionBy("grp").parquet(f"{self.path}/vectors/{name}")
        self._parted(keys, "g", bits).write.partitionBy("grp").parquet(f"{self.path}/keys/{name}")
        shared, num, den = self.spark.sparkContext.broadcast(ranks), 1, 2

        def each(batches):
            ranks = np.frombuffer(shared.value, np.uint8)
            for b in batches:
                for lo in range(0, b.num_rows, 20_000):
                    part = b.slice(lo, 20_000)
                    lists = part.column("elements")
                    h, offsets = lists.flatten().to_numpy().view(np.uint64), lists.offsets.to_numpy().astype(np.int64)
                    entries = Entries.of(part.column("set").to_numpy(), h, offsets - offsets[0], ranks, num, den)
                    cell = (entries.element >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(entries.doc), np.int64)
                    yield _rows(*entries.packed(cell, True, False))

        cells = vectors.select("set", "elements").mapInArrow(each, "cell int, blob binary, m int").withColumnRenamed("cell", "grp")
        cells.repartition(1 << bits, "grp").write.partitionBy("grp").parquet(f"{self.path}/cells/{name}")
        return {"name": name, "bits": bits, "size": int(size)}

    def _save_ranks(self, ranks: bytes) -> str:
        name = f"r{uuid.uuid4().hex}"
        self.spark.createDataFrame([(bytearray(ranks),)], "ranks binary").write.parquet(f"{self.path}/ranks/{name}")
        return name

    def merge(self) -> None:
        """Merges segments of like size while there are ``fan`` of them; where all become one, the order of coordinates is made anew from all vectors."""
        while True:
            levels: dict[int, list[dict]] = {}
            for s in self.segments:
                level = 0
                while self.fan ** (level + 1) <= s["size"]:
                    level += 1
                levels.setdefault(level, []).append(s)
            full = [x for x in levels.values() if len(x) >= self.fan]
            if not full:
                return
            some = full[0]
            rest = [s for s in self.segments if s not in some]
            whole, self.segments = self.segments, some
            vectors, keys = self._read("vectors"), self._read("keys")
            self.segments = whole
            name, ranks = self.ranks_name, self._ranks()
            if not rest:
                ranks = ranks_of(vectors.select("elements").mapInArrow(_count_elements, "block long, salt long, counts binary"))
                name = self._save_ranks(ranks)
            self._commit([*rest, self._write(vectors, keys, ranks)], name)
            self._tidy()

    def judge(self, items: DataFrame, blobs: DataFrame, append: bool = True) -> DataFrame:
        """(kept_id, dup_id) of the batch's items that repeat an accepted one; the accepted ones are appended.

        Items are rows of (id, source_id, external_id, raw_payload,
        hash_sha256); repeated rows count once, null ids are left out, an empty
        batch gives nothing. Batches must come in order of id.
        """
        items = items.filter("id is not null").select("id", "source_id", "external_id", "raw_payload", "hash_sha256")
        texts = items.select(F.col("id").alias("k"), payload_text(F.col("raw_payload")).alias("t")).filter("t is not null").dropDuplicates(["k"])
        made = bool(self.segments)
        near = NearDuplicates(texts, ranks=self._ranks() if made else None, history=self if made else None)
        named = near.sets.select(F.col("k").alias("id"), _group("d", F.col("set")).alias("g"))
        member = cut(exact_keys(items, blobs).unionByName(named))
        links = near.links().select(_group("d", F.col("set_a")).alias("x"), _group("d", F.col("set_b")).alias("y"))
        links = links.select(F.explode(F.array(F.struct(F.col("x").alias("g"), F.col("y").alias("h")), F.struct(F.col("y").alias("g"), F.col("x").alias("h")))).alias("e")).select("e.g", "e.h")
        old = None
        if made:
            links = cut(links)
            asked = cut(member.select("g").unionByName(links.select(F.col("h").alias("g"))).distinct())
            keys = Sieve(asked, "g").sifted(self._read("keys", asked, "g").select("id", "g"), "g")
            old = cut(keys.join(asked, "g", "left_semi").groupBy("g").agg(F.min("id").alias("kept")))
        found = cut(resolve(member, links, old))
        if append:
            # a set that an accepted item has is a repeated one, so the sets of accepted items are new to the index
            fresh = cut(near.sets.join(found.select(F.col("id").alias("k")), "k", "left_anti").select("set").distinct())
            own = near.texts.join(near.classes.join(fresh, "set", "left_semi").select("k"), "k", "left_semi")
            keys = member.join(found.select("id"), "id", "left_anti").select("id", "g")
            ranks = near.ranks()
            segment = self._write(near.vectors(own), keys, ranks)
            self._commit([*self.segments, segment], self.ranks_name or self._save_ranks(ranks))
            self.merge()
        return found.select("kept_id", F.col("id").alias("dup_id"))


_SCHEMAS = {"vectors": "set long, elements array<long>", "cells": "blob binary, m int", "keys": "id long, g long"}


def _count_elements(batches):
    counts = 0
    for b in batches:
        counts = counts + element_counts(b.column(0).flatten().to_numpy().view(np.uint64))
    blocks, data = counter_blocks(counts) if not isinstance(counts, int) else ([], [])
    salt = [TaskContext.get().partitionId() % 32] * len(blocks)
    yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(salt, pa.int64()), pa.array(data, pa.binary())], names=["block", "salt", "counts"])


def judge_in_batches(items: DataFrame, blobs: DataFrame, ends: Sequence[int] = (), path: str | None = None, **parameters) -> DataFrame:
    """The whole table judged in batches of consecutive ids (after each of ``ends`` a new one begins), each by an index opened anew."""
    spark = items.sparkSession
    path = path or scratch(spark, "accepted")
    out, lower = None, None
    for upper in [*ends, None]:
        part = items
        if lower is not None:
            part = part.filter(F.col("id") > lower)
        if upper is not None:
            part = part.filter(F.col("id") <= upper)
        found = AcceptedIndex(spark, path, **parameters).judge(part, blobs, append=upper is not None)
        out, lower = (found if out is None else out.unionByName(found)), upper
    return out


def loads_by_days(items: DataFrame, days: int) -> list[int]:
    """The last ids of loads of ``days`` days each by ``collected_at``; ids stand in order of arrival, so an item whose date lies before its neighbours' stays in their load."""
    day = F.try_to_date(F.substring("collected_at", 1, 10))
    first = items.agg(F.min(day).alias("d")).first().d
    load = F.floor(F.date_diff(day, F.lit(first).cast("date")) / days)
    begins = items.filter("id is not null").groupBy(load.alias("load")).agg(F.min("id").alias("begin"))
    rows = sorted((r.load, r.begin) for r in begins.filter("load > 0").collect())
    # a load begins where an item of it or of a later one first stands
    ends, least = [], None
    for _, begin in reversed(rows):
        least = begin if least is None else min(least, begin)
        ends.append(least - 1)
    return sorted(set(ends))
