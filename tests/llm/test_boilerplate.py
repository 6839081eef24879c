import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from factloom.llm import boilerplate

SCHEMA = "id long, source_id long, body_text string, name string, item string"


def items(spark, rows):
    return spark.createDataFrame([(*r, "n", "i") for r in rows], SCHEMA)


def key(line):
    return re.sub(r"\d+", "0", re.sub(r"\s+", " ", line.lower())).strip()


def brute(rows, lines=1, least=3, one_in=40):
    n, spans = defaultdict(set), defaultdict(set)
    seqs = {}
    for i, s, t in rows:
        if i is None or s is None or not t:
            continue
        n[s].add(i)
        seqs[s, i] = seq = [(k, key(x)) for k, x in enumerate(t.split("\n"), 1) if key(x)]
        for a in range(len(seq) - lines + 1):
            spans[s, tuple(k for _, k in seq[a : a + lines])].add(i)
    out = set()
    for (s, i), seq in seqs.items():
        for a in range(len(seq) - lines + 1):
            if len(spans[s, tuple(k for _, k in seq[a : a + lines])]) >= max(least, len(n[s]) / one_in):
                out |= {(i, k) for k, _ in seq[a : a + lines]}
    return out


def rows_of(seed):
    rng = random.Random(seed)
    lines = ["Реклама", " РЕКЛАМА ", "Просмотров: 12", "просмотров:  7", "© 2020–2024", "", "  ", "своя строка 1", "ещё\tстрока", "другая"]
    rows = [(i, rng.choice([1, 1, 1, 2, 3]), "\n".join(rng.choice(lines) if rng.random() < 0.6 else f"text {chr(97 + rng.randrange(26))}{i}" for _ in range(rng.randint(0, 7)))) for i in range(60)]
    return rows + [(100, None, "Реклама"), (101, 1, None), (102, 1, ""), (None, 1, "Реклама"), (5, rows[5][1], rows[5][2])]


def test_against_brute_force(spark):
    for lines in (1, 2, 3, 4):
        rows = rows_of(lines)
        got = boilerplate.repeated_lines(items(spark, rows), lines)
        assert {(r[0], r.line_no) for r in got.collect()} == brute(rows, lines)
        assert got.count() == len(brute(rows, lines))


def test_share_of_a_large_source(spark):
    rows = [(i, 1, f"own {chr(97 + i % 26)}x{'abc'[i % 3] * (i // 26 + 1)}\n" + ("rare" if i < 3 else "common" if i < 6 else "")) for i in range(200)]
    assert {x[0] for x in brute(rows)} == {r[0] for r in boilerplate.repeated_lines(items(spark, rows)).collect()}


def test_clean_text_and_report(spark):
    rows = [(i, 1, f"begin\ntext {chr(97 + i)}\nend 1\nend b") for i in range(5)] + [(9, 2, "begin"), (10, 2, None)]
    d = items(spark, rows)
    clean = {r.id: r.clean_text for r in boilerplate.without_repeated_lines(d).collect()}
    assert clean == {**{i: f"text {chr(97 + i)}" for i in range(5)}, 9: "begin", 10: None}
    report = boilerplate.Blocks(d).report()
    assert sorted(map(tuple, report.collect())) == [(1, 1, 5, 5), (1, 1, 5, 5), (1, 2, 5, 5)]


def blocks_brute(rows, least=3, one_in=40):
    n, spans, follow = defaultdict(set), defaultdict(list), defaultdict(list)
    seqs = {}
    for i, s, t in rows:
        if i is not None and s is not None and t:
            n[s].add(i)
            seqs[s, i] = [key(x) for x in t.split("\n") if key(x)]
    for (s, i), q in seqs.items():
        for a in range(len(q)):
            for b in range(a + 1, len(q) + 1):
                spans[s, tuple(q[a:b])].append(i)
                follow[s, tuple(q[a:b])].append(q[b] if b < len(q) else None)
    out = []
    for (s, block), at in spans.items():
        ends = set(follow[s, block])
        if len(set(at)) >= max(least, len(n[s]) / one_in) and (len(ends) > 1 or None in ends):
            out.append((s, len(block), len(set(at)), len(at)))
    return sorted(out)


def test_blocks_of_all_lengths(spark):
    for seed in range(2):
        rows = rows_of(seed)
        rows += [(200 + i, 4, "\n".join(["a", "b", "c", "d"][: 1 + i % 4] + ["0"] * (i % 7) + ["z"])) for i in range(20)]
        for most in (200_000, 3):  # 3: buckets are split by their next lines
            b = boilerplate.Blocks(items(spark, rows), most=most)
            assert sorted(map(tuple, b.report().collect())) == blocks_brute(rows), (seed, most)
            for lines in (1, 3):
                got = boilerplate.repeated_lines(items(spark, rows), lines, most=most)
                assert {(r[0], r.line_no) for r in got.collect()} == brute(rows, lines)


def test_long_runs_of_one_line(spark):
    rows = [(i, 1, "\n".join(["0"] * 3000)) for i in range(4)]
    assert boilerplate.repeated_lines(items(spark, rows), 2).count() == 12_000
    assert boilerplate.Blocks(items(spark, rows)).report().count() == 3000


def test_empty(spark):
    assert boilerplate.repeated_lines(items(spark, []).limit(0)).count() == 0
    assert boilerplate.Blocks(items(spark, [])).report().count() == 0
