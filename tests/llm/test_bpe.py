import random

import pytest
import tiktoken

from factloom.llm import bpe


@pytest.fixture(scope="module")
def both():
    ranks = bpe.read_ranks(bpe.VOCABULARY)
    return bpe.TrieEncoder(ranks), tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def check(encoder, want, texts):
    ids, ends = encoder.encode(texts)
    for t, a, b in zip(texts, ends[:-1], ends[1:], strict=True):
        assert ids[a:b].tolist() == want.encode_ordinary(t or ""), t


def test_same_ids(both):
    rng = random.Random(3)
    alphabet = ["а", "б", " ", "  ", "1", "²", "\n", "я", "é", "😀", '"', "'s", "'ll", "_", "٣", "　", "̈", "Ⅷ", "<|endoftext|>", "ing", "ск", "\t", "\u001c", "㐀"]
    check(*both, [None, "", " ", "Привет, мир!", "hello  world", "x" * 4000, "ы" * 3000, " \n \n"] + ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(1500)])


def test_starting_anew_changes_nothing(both, monkeypatch):
    monkeypatch.setattr(bpe, "MOST_WORDS", 3)
    for _ in range(3):
        check(*both, ["один два три четыре", "пять шесть семь", "один"])


def test_trie_walk_shares_prefixes(both):
    encoder, want = both
    words = [w.encode() for w in ["мост", "мостов", "мостовая", "мостик", "ост"]]
    assert {w: ids for w, ids in encoder.walk(words)} == {w: want.encode_ordinary(w.decode()) for w in words}


def test_corpus(spark, both):
    d = spark.createDataFrame([(1, "a мост", "q"), (2, None, "q"), (3, "", "q"), (1, "a мост", "q"), (None, "b", "q")], "doc_id long, text string, ids string")
    got = [(r.doc_id, list(r.ids)) for r in bpe.encode_corpus(d).collect()]
    want = both[1].encode_ordinary("a мост")
    assert sorted(got, key=str) == sorted([(1, want), (2, []), (3, []), (1, want), (None, both[1].encode_ordinary("b"))], key=str)
    assert bpe.encode_corpus(d.limit(0)).count() == 0
