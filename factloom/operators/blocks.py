"""Many texts against all texts: exact cosine neighbours and ranked searches in batches.

Documents stream past the queries of a pass, which are broadcast: at most ``PASS``
queries and ``TERMS`` terms at a time, whatever the size of the table, so no list of
documents under a term is ever shuffled. Terms are 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.relational import top_per
from factloom.session import cut, parallelism

PASS, TERMS, DENSE, ROWS = 20_000, 4_000_000, 1024, 500
SLACK = 2e-4  # more than half of the fourth place and the error of single precision


def _words(docs: DataFrame, least: int) -> DataFrame:
    """(id, w, ...) of (id, text, ...) with words, spread over the cluster."""
    w = F.regexp_extract_all(F.lower("text"), F.lit(rf"([\p{{L}}\p{{N}}_]{{{least},}})"), 1)
    return docs.withColumn("w", w).drop("text").filter("size(w) > 0")


def _counted(w: pa.ListArray, pairs: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and count, by row and term; ``pairs`` adds terms of two words."""
    if isinstance(w, pa.ChunkedArray):
        w = w.combine_chunks()
    d = w.flatten().dictionary_encode()
    names = np.fromiter((int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in d.dictionary.to_pylist()), np.uint64, len(d.dictionary))
    h = names[d.indices.to_numpy()]
    row = np.repeat(np.arange(len(w)), np.diff(w.offsets.to_numpy()))
    if pairs:
        first = np.flatnonzero(row[1:] == row[:-1])
        x = (h[first] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[first + 1] >> np.uint64(29)) ^ (h[first + 1] * np.uint64(0xC2B2AE3D27D4EB4F))
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        row, h = np.concatenate([row, row[first]]), np.concatenate([h, x])
    h = h.view(np.int64)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    at = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (h[1:] != h[:-1])])
    return row[at], h[at], np.diff(np.r_[at, len(row)])


def _spans(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All places of spans that begin at ``start`` and are ``n`` long, one span after another."""
    return np.arange(n.sum()) + np.repeat(start - np.r_[0, np.cumsum(n)[:-1]], n)


def _find(terms: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` in the sorted ``terms``, and whether each is there."""
    at = np.minimum(np.searchsorted(terms, wanted), len(terms) - 1)
    return at, terms[at] == wanted


def _frequencies(docs: DataFrame, pairs: bool) -> DataFrame:
    """(term, df) of (id, w)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            term, n = np.unique(_counted(b["w"], pairs)[1], return_counts=True)
            yield pa.RecordBatch.from_pydict({"term": term, "df": n.astype(np.int64)})

    return docs.select("w").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def _parts(df: DataFrame, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted terms and their frequencies, about ``most`` at a time."""
    n = -(-df.count() // most)
    for i in range(n):
        t = df.filter(F.pmod(F.xxhash64("term"), F.lit(n)) == i).select("term", "df").toArrow()
        term, freq = t["term"].to_numpy(), t["df"].to_numpy()
        order = np.argsort(term)
        if len(term):
            yield term[order], freq[order]


def _weighted(docs: DataFrame, df: DataFrame, n: int, most: int) -> DataFrame:
    """(id, norm, terms, x): of all documents the length of the TF-IDF vector; of those with ``q`` also each term's count times idf squared."""
    sc, out = docs.sparkSession.sparkContext, None
    for part in _parts(df, most):
        shared = sc.broadcast((part[0], np.log((1.0 + n) / (1.0 + part[1])) + 1))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            terms, idf = shared.value
            for b in batches:
                row, term, tf = _counted(b["w"], True)
                at, there = _find(terms, term)
                row, term, tf, f = row[there], term[there], tf[there], idf[at[there]]
                sq = np.bincount(row, (tf * f) ** 2, b.num_rows)
                q = b["q"].to_numpy(zero_copy_only=False).astype(bool)
                own = q[row]
                off = np.r_[0, np.cumsum(np.bincount(row[own], minlength=b.num_rows))].astype(np.int32)
                lists = [pa.ListArray.from_arrays(off, pa.array(x[own])) for x in (term, tf * f * f)]
                yield pa.RecordBatch.from_arrays([b["id"], b["q"], pa.array(sq), *lists], ["id", "q", "sq", "terms", "x"])

        one = docs.select("id", "q", "w").mapInArrow(run, "id long, q boolean, sq double, terms array<long>, x array<double>")
        out = one if out is None else out.unionByName(one)
    agg = out.groupBy("id", "q").agg(F.sqrt(F.sum("sq")).alias("norm"), F.flatten(F.collect_list("terms")).alias("terms"), F.flatten(F.collect_list("x")).alias("x"))
    return cut(agg)


def _passes(queries: DataFrame, most: int) -> Iterator[pa.Table]:
    n = -(-queries.count() // most)
    for i in range(n):
        t = queries.filter(F.pmod(F.xxhash64("id"), F.lit(n)) == i).toArrow()
        if t.num_rows:
            yield t


def _inverted(ids: np.ndarray, q: np.ndarray, term: np.ndarray, x: np.ndarray):
    """Queries by term: ids, terms, where each term's queries begin, the queries, their weights; by query too."""
    order = np.lexsort((q, term))
    terms, start = np.unique(term[order], return_index=True)
    by_query = np.lexsort((term, q))
    begin = np.searchsorted(q[by_query], np.arange(len(ids) + 1))
    return ids, terms, np.r_[start, len(term)], q[order], x[order], begin, term[by_query], x[by_query]


def neighbours(docs: DataFrame, queries: DataFrame | None = None, threshold: float = 0.22, k: int = 5, most_queries: int = PASS, most_terms: int = TERMS) -> DataFrame:
    """(id, neighbour, score, rank) of each of ``queries`` (id; else of all) among all of ``docs`` (id, text), as ``similarity.neighbours``.

    The full product: frequent terms by dense blocks, the rest through the queries' inverted lists. What comes
    near the threshold is summed again in double precision.
    """
    spark = docs.sparkSession
    n = docs.count()
    d = docs.filter("text is not null").repartition(parallelism(spark), "id")
    q = d.withColumn("q", F.lit(True)) if queries is None else d.join(queries.select("id", F.lit(True).alias("q")), "id", "left").withColumn("q", F.coalesce("q", F.lit(False)))
    w = _words(q, 2)
    df = cut(_frequencies(w, True))
    if not df.take(1):
        return spark.createDataFrame([], "id long, neighbour long, score double, rank int")
    vectors = _weighted(w, df, n, most_terms)
    stream = w.select("id", "w").join(vectors.select("id", "norm"), "id")
    out = None
    for t in _passes(vectors.filter("q").select("id", "norm", "terms", "x"), most_queries):
        lists = t["terms"].combine_chunks()
        of = np.repeat(np.arange(t.num_rows), np.diff(lists.offsets.to_numpy()))
        x = t["x"].combine_chunks().flatten().to_numpy() / t["norm"].to_numpy()[of]
        shared = spark.sparkContext.broadcast(_inverted(t["id"].to_numpy(), of, lists.flatten().to_numpy(), x))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, terms, start, q, x, begin, q_term, q_x = shared.value
            m, size = len(ids), np.diff(start)
            dense = np.argsort(-size, kind="stable")[:DENSE]
            column = np.full(len(terms), -1)
            column[dense] = np.arange(len(dense))
            block = np.zeros((len(dense), m), np.float32)
            for c, i in enumerate(dense):
                block[c, q[start[i] : start[i + 1]]] = x[start[i] : start[i + 1]]
            for whole in batches:
                for at in range(0, whole.num_rows, ROWS):
                    b = whole.slice(at, ROWS)
                    row, term, tf = _counted(b["w"], True)
                    i, there = _find(terms, term)
                    row, term, i, tf = row[there], term[there], i[there], tf[there]
                    norm, own = b["norm"].to_numpy(), b["id"].to_numpy()
                    c = column[i]
                    mine = np.zeros((b.num_rows, len(dense)), np.float32)
                    mine[row[c >= 0], c[c >= 0]] = tf[c >= 0]
                    s = mine @ block
                    r, j, f = row[c < 0], i[c < 0], tf[c < 0]
                    if len(j):
                        place = _spans(start[j], size[j])
                        s += np.bincount(np.repeat(r, size[j]) * m + q[place], np.repeat(f, size[j]) * x[place], s.size).reshape(s.shape).astype(np.float32)
                    hit, to = np.nonzero(s >= ((threshold - SLACK) * norm).astype(np.float32)[:, None])
                    differs = own[hit] != ids[to]
                    hit, to = hit[differs], to[differs]
                    edge = np.searchsorted(row, np.arange(b.num_rows + 1))
                    score = np.empty(len(hit))
                    for p, (r, o) in enumerate(zip(hit, to, strict=True)):
                        a = slice(edge[r], edge[r + 1])
                        g, common = _find(q_term[begin[o] : begin[o + 1]], term[a])
                        score[p] = (tf[a][common] * q_x[begin[o] : begin[o + 1]][g[common]]).sum() / norm[r]
                    yield pa.RecordBatch.from_pydict({"id": ids[to], "neighbour": own[hit], "score": score})

        one = stream.mapInArrow(run, "id long, neighbour long, score double")
        out = one if out is None else out.unionByName(one)
    if out is None:
        return spark.createDataFrame([], "id long, neighbour long, score double, rank int")
    out = out.withColumn("score", F.round("score", 4)).filter(F.col("score") >= threshold)
    return top_per(out, ["id"], [F.col("score").desc(), F.col("neighbour").desc()], k)


def alike(docs: DataFrame, threshold: float) -> DataFrame:
    """(id, neighbour), id < neighbour, of all ``docs`` (id, text, kind) of one kind whose TF-IDF cosine (four places) is ``threshold`` or more.

    A prefix filter on weights: terms stand in order of their frequency, rare
    ones first; a document's terms behind the first ones weigh less than the
    threshold together (their squares less than its square, all being of length
    1), so two documents that are alike share one of the first of both. Only
    first terms meet. What two documents can have in common behind the last
    first term they share is at most the root of the product of their squares
    there; pairs within that bound are verified with the whole vectors.
    """
    spark = docs.sparkSession
    n = docs.count()
    w = _words(docs.filter("text is not null").select("id", "kind", "text"), 2)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, term, tf = _counted(b["w"], True)
            yield pa.RecordBatch.from_pydict({"id": b["id"].to_numpy()[row], "term": term, "tf": tf.astype(np.int64)})

    t = cut(w.select("id", "w").mapInArrow(counted, "id long, term long, tf long"))
    df = t.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    x = t.join(df, "term").select("id", F.struct("df", "term", (F.col("tf") * (F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + 1)).alias("x")).alias("t"))
    v = x.groupBy("id").agg(F.array_sort(F.collect_list("t")).alias("t")).join(docs.select("id", "kind"), "id")
    v = v.withColumn("norm", F.sqrt(F.aggregate("t", F.lit(0.0), lambda a, y: a + y["x"] * y["x"])))
    v = cut(v.select("id", "kind", F.transform("t", lambda y: F.struct(y["df"].alias("df"), y["term"].alias("term"), (y["x"] / F.col("norm")).alias("w"))).alias("t")))
    # the weight behind each term, from the end; what is kept is where it is still enough
    behind = F.transform("t", lambda y, i: F.struct(y["df"].alias("df"), y["term"].alias("term"), y["w"].alias("w"), F.aggregate(F.slice("t", i + 1, F.size("t")), F.lit(0.0), lambda a, z: a + z["w"] * z["w"]).alias("rest")))
    least = (threshold - SLACK) ** 2
    first = v.select("id", "kind", F.explode(F.filter(behind, lambda y: (y["rest"] >= least) & (y["df"] > 1))).alias("t")).select("id", "kind", "t.*")
    first = first.select("id", "kind", "df", "term", "w", F.greatest(F.col("rest") - F.col("w") * F.col("w"), F.lit(0.0)).alias("after"))
    other = first.select(F.col("id").alias("neighbour"), "kind", "term", F.col("w").alias("w2"), F.col("after").alias("after2"))
    met = first.join(other, ["kind", "term"]).filter("id < neighbour").groupBy("id", "neighbour")
    met = met.agg(F.sum(F.col("w") * F.col("w2")).alias("shared"), F.max_by(F.sqrt(F.col("after") * F.col("after2")), F.struct("df", "term")).alias("most"))
    pairs = met.filter(F.col("shared") + F.col("most") >= threshold - SLACK).select("id", "neighbour")
    a, b = v.select("id", F.col("t").alias("ta")), v.select(F.col("id").alias("neighbour"), F.col("t").alias("tb"))
    both = pairs.join(a, "id").join(b, "neighbour")
    other = F.map_from_entries(F.transform("tb", lambda y: F.struct(y["term"], y["w"])))
    dot = F.aggregate("ta", F.lit(0.0), lambda s, y: s + y["w"] * F.coalesce(F.try_element_at(F.col("m"), y["term"]), F.lit(0.0)))
    return both.withColumn("m", other).withColumn("score", F.round(dot, 4)).filter(F.col("score") >= threshold).select("id", "neighbour")


def searches(docs: DataFrame, queries: DataFrame, k: int = 20, k1: float = 1.2, b: float = 0.75, most_queries: int = PASS) -> DataFrame:
    """(query_id, id, score, rank): for each of ``queries`` (query_id, text) the ``k`` best of ``docs`` (id, text) that have all its words.

    Scores and ties as in ``search.bm25``. A query meets the documents that have its rarest word; there its other words are looked up.
    """
    spark = docs.sparkSession
    none = spark.createDataFrame([], "query_id long, id long, score double, rank int")
    w = _words(docs.filter("text is not null").select("id", "text"), 1)
    stats = w.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("w")).alias("a")).first()
    if not stats.n:
        return none
    avg_len = stats.a

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            row, term, _ = _counted(x["w"], False)
            yield pa.RecordBatch.from_pydict({"id": x["id"].to_numpy()[row], "term": term})

    asked = cut(_words(queries.filter("text is not null").select(F.col("query_id").alias("id"), "text"), 1).select("id", "w").mapInArrow(split, "id long, term long"))
    df = _frequencies(w, False).join(asked.select("term").distinct(), "term", "left_semi")
    t = asked.join(df, "term", "left").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "term"))).alias("t"), F.count_if(F.col("df").isNull()).alias("missing"))
    whole = cut(t.filter("missing = 0").select("id", F.col("t.term").alias("terms"), F.col("t.df").alias("df")))  # a word that no document has ends its query
    out = None
    for t in _passes(whole, most_queries):
        lists = t["terms"].combine_chunks()
        freq = t["df"].combine_chunks().flatten().to_numpy()
        idf = np.log((stats.n - freq + 0.5) / (freq + 0.5) + 1)
        shared = spark.sparkContext.broadcast((t["id"].to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten().to_numpy(), idf))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, begin, q_term, idf = shared.value
            known, q_place = np.unique(q_term, return_inverse=True)
            rarest, size = q_place[begin[:-1]], np.diff(begin)
            by_rarest = np.argsort(rarest, kind="stable")
            start = np.searchsorted(rarest[by_rarest], np.arange(len(known) + 1))
            n_queries = np.diff(start)
            for whole in batches:
                for at in range(0, whole.num_rows, ROWS):
                    x = whole.slice(at, ROWS)
                    row, term, tf = _counted(x["w"], False)
                    length = np.bincount(row, tf, x.num_rows)
                    i, there = _find(known, term)
                    row, i, tf = row[there], i[there], tf[there]
                    if not len(row):
                        continue
                    order = np.lexsort((i, row))
                    row, i, tf = row[order], i[order], tf[order]
                    q = by_rarest[_spans(start[i], n_queries[i])]
                    r = np.repeat(row, n_queries[i])
                    if not len(q):
                        continue
                    place = _spans(begin[q], size[q])
                    key, there = _find(row * len(known) + i, np.repeat(r, size[q]) * len(known) + q_place[place])
                    f = np.where(there, tf[key], 0)
                    part = idf[place] * f * (k1 + 1) / (f + k1 * (1 - b + b * length[np.repeat(r, size[q])] / avg_len))
                    edge = np.r_[0, np.cumsum(size[q])[:-1]]
                    full = np.logical_and.reduceat(there, edge)
                    yield pa.RecordBatch.from_pydict({"query_id": ids[q[full]], "id": x["id"].to_numpy()[r[full]], "score": np.add.reduceat(part, edge)[full]})

        one = w.mapInArrow(run, "query_id long, id long, score double")
        out = one if out is None else out.unionByName(one)
    if out is None:
        return none
    return top_per(out.withColumn("score", F.round("score", 6)), ["query_id"], [F.col("score").desc(), F.col("id")], k)
