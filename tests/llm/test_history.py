import hashlib
import json
import random
import re
from collections import defaultdict

from factloom.llm import history

ITEMS = "id long, source_id long, external_id string, raw_payload string, hash_sha256 string, kept_id string"
BLOBS = "raw_item_id long, blob_type string, hash_sha256 string, id long"


def brute(items, blobs):
    files = defaultdict(set)
    for i, kind, h, _ in blobs:
        if kind in ("document", "video") and h and h.strip():
            files[i].add(h.lower())
    owner, sets, out, seen = defaultdict(set), {}, set(), set()
    for i, s, e, p, h, _ in sorted((x for x in items if x[0] is not None), key=lambda x: x[0]):
        if i in seen:
            continue
        seen.add(i)
        keys = {("c", f) for f in files[i]}
        if h:
            m = re.search("[0-9a-f]{64}", h.lower())
            k = m[0] if m else re.sub(r"[\W_]", "", h.lower())
            if k and k != history.EMPTY_HASH:
                keys.add(("a", k))
        if e and s is not None and (k := re.sub(r"[\W_]", "", e.lower())):
            keys.add(("b", s, k))
        grams = set()
        try:
            t = json.loads(p)["text"]
            w = re.findall(r"[^\W_]+", t.lower())
            grams = {tuple(w[q : q + 3]) for q in range(len(w) - 2)}
        except Exception:
            pass
        hits = set().union(*(owner[k] for k in keys)) if keys else set()
        hits |= {o for o, g in sets.items() if grams and g and 2 * len(g & grams) >= len(g | grams)}
        if hits:
            out.add((min(hits), i))
        else:
            for k in keys:
                owner[k].add(i)
            sets[i] = grams
    return out


def data(seed, n=80):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    items, texts, hashes = [], [], []
    for i in range(1, n):
        t = [rng.choice(words) for _ in range(rng.choice([1, 4, 12, 40]))]
        if texts and rng.random() < 0.35:
            t = list(rng.choice(texts))
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(len(t))] = rng.choice(words)
        texts.append(t)
        h = hashlib.sha256(str(rng.randrange(70)).encode()).hexdigest()
        h = rng.choice([h, h.upper(), "sha256:" + h, None, history.EMPTY_HASH.upper(), ""])
        hashes.append(h)
        e = rng.choice([None, "", "--", f"post_{rng.randrange(200)}", f"#POST-{rng.randrange(200)}/"])
        p = rng.choice([json.dumps({"text": " ".join(t)})] * 6 + ['{"text": "' + " ".join(t), "", None, "[]"])
        items.append((i, rng.choice([1, 1, 2, None]), e, p, h, None))
    items += [items[3], (None, 1, None, None, None, None)]
    blobs = [(rng.randrange(1, n), rng.choice(["document", "video", "image"]), rng.choice(["ab", "AB", "cd", "ef", None, ""]), k) for k in range(14)]
    return items, blobs


def test_against_sequential_judging(spark):
    for seed, ends in ((1, []), (3, [25, 26, 60])):
        items, blobs = data(seed)
        got = history.judge_in_batches(spark.createDataFrame(items, ITEMS), spark.createDataFrame(blobs, BLOBS), ends, per_group=200).collect()
        assert {(r.kept_id, r.dup_id) for r in got} == brute(items, blobs)
        assert len(got) == len(brute(items, blobs))


def test_hot_key_and_chain(spark):
    items = [(i, 1, "same", None, None, None) for i in range(1, 60)]
    items += [(100 + i, 2, f"e{i}", None, None, None) for i in range(6)]
    blobs = [(100 + i, "video", f"f{i + k}", 10 * i + k) for i in range(6) for k in (0, 1)]  # each shares a file with the next
    got = {(r.kept_id, r.dup_id) for r in history.judge_in_batches(spark.createDataFrame(items, ITEMS), spark.createDataFrame(blobs, BLOBS)).collect()}
    assert got == {(1, i) for i in range(2, 60)} | {(100, 101), (102, 103), (104, 105)}


def test_empty(spark):
    i, b = spark.createDataFrame([], ITEMS), spark.createDataFrame([], BLOBS)
    assert history.judge_in_batches(i, b).count() == 0
    assert history.judge_in_batches(i, b, [5]).count() == 0


def test_reopened_after_each_batch_and_after_a_crash(spark, tmp_path):
    items, blobs = data(5)
    b, path = spark.createDataFrame(blobs, BLOBS), f"file://{tmp_path}/index"
    out, lower = set(), 0
    for n, upper in enumerate((16, 32, 48, 64, 10_000)):
        part = spark.createDataFrame([x for x in items if x[0] is None or lower < x[0] <= upper], ITEMS)
        index = history.AcceptedIndex(spark, path, fan=2, per_group=150)
        if n in (1, 3):  # the job is lost after it wrote its segment
            commit, index._commit = index._commit, None
            try:
                index.judge(part, b)
            except TypeError:
                pass
            assert commit.__self__.number == history.AcceptedIndex(spark, path).number
            index = history.AcceptedIndex(spark, path, fan=2, per_group=150)
        out |= {(r.kept_id, r.dup_id) for r in index.judge(part, b).collect()}
        lower = upper
    assert out == brute(items, blobs)
    assert len(history.AcceptedIndex(spark, path).segments) < 5  # merged on the way


def test_a_small_batch_does_not_shuffle_the_history(spark, tmp_path):
    rng = random.Random(9)

    def batch(lo, n):
        rows = [(i, 1, f"e{i}", json.dumps({"text": " ".join(f"w{rng.randrange(5000)}" for _ in range(60))}), f"{i:064x}", None) for i in range(lo, lo + n)]
        return spark.createDataFrame(rows, ITEMS)

    def written():
        return sum(e.totalShuffleWrite() for e in _executors(spark))

    none, cost = spark.createDataFrame([], BLOBS), []
    for n in (300, 3000):
        path = f"file://{tmp_path}/history{n}"
        history.AcceptedIndex(spark, path).judge(batch(1, n), none)
        before = written()
        assert history.AcceptedIndex(spark, path).judge(batch(100_000, 1), none, append=False).count() == 0
        cost.append(written() - before)
    assert cost[1] < 1.5 * cost[0] + 20_000, cost


def _executors(spark):
    found = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    return [found.apply(i) for i in range(found.size())]


def test_loads_by_days(spark):
    dates = ["2024-01-01", "2024-01-03", "2024-01-09", "2024-01-02", None, "2024-01-20", "2024-01-10"]
    rows = spark.createDataFrame([(i, d) for i, d in enumerate(dates, 1)], "id long, collected_at string")
    assert history.loads_by_days(rows, 7) == [2, 5]
