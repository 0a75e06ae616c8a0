import random

import numpy as np
import pandas as pd

from loomspan.llm import leaks as lk

ITEMS = [
    (1, "When the lismawi ferry was moved to friploku in 1798 exactly 6858 of its 2406 passengers kept their nurhoka tickets for years.", "Short one."),
    (2, "When the vodefra ferry was moved to toware in 1730 exactly 3850 of its 7523 passengers kept their kruvime tickets for years.", None),
    (3, None, "It left the valley of nomamu with 3738 goats because migano had flooded 4790 meadows below the jardrodrol dam."),
    (None, "When the lismawi ferry was moved to friploku in 1798 exactly 6858 of its 2406 passengers.", ""),
]
P = ITEMS[0][1]
DOCS = [
    (1, f"Before. {P} After.", {1}), (2, P.upper().replace(" ", "\n  "), {1}), (3, "x " + " ".join(P.split()[:9]), set()), (4, " ".join(P.split()[5:18]), {1}),
    (5, "When the zekreder ferry was moved to rowegi in 1900 exactly 1798 of its 490 passengers kept their krusdrafo tickets for years.", set()),
    (6, P.replace("lismawi", "lismwai").replace("exactly ", "").replace("their", "some"), {1}), (7, P.replace("moved to", "mo-\nved (Applause) to").replace("kept", "[Unrest: no!] kept"), {1}),
    (8, None, set()), (9, "", set()), (10, "Yes. " * 5000 + ITEMS[2][2] + P, {1, 3}), (11, "When the vódefrà ferry, was; moved to TOWARE in 1730: exactly 3850 of its 7523 passengers", {2}), (1, f"Before. {P} After.", {1}), (12, "lismawi " * 40, set()),
]


def frames(spark):
    docs = spark.createDataFrame([(d, t, 7, "x") for d, t, _ in DOCS], "id bigint, text string, item_id int, n_words string")
    items = spark.createDataFrame(ITEMS, "item bigint, prompt string, answer string")
    return docs, items


def test_leaks(spark, monkeypatch):
    docs, items = frames(spark)
    want = {(d, i) for d, _, s in DOCS for i in s}
    for chars in (lk.BLOCK_CHARS, 100):  # one block of evaluation texts, or many
        monkeypatch.setattr(lk, "BLOCK_CHARS", chars)
        found = lk.leaks(docs, "id", "text", items, "item", ["prompt", "answer"])
        rows = found.collect()
        got = [(r["id"], r["item_id"]) for r in rows]
        assert len(got) == len(set(got)) and set(got) == want
        where = {(r["id"], r["item_id"]): (r["verbatim"], r["doc_word"], r["item_word"]) for r in rows}
        assert where[1, 1] == (22, 1, 0) and where[4, 1] == (13, 0, 5) and where[10, 3][1:] == (5000, 0) and where[6, 1][0] == 7
    clean = lk.without_leaks(docs, "id", found)
    assert sorted(r["id"] for r in clean.collect()) == [3, 5, 8, 9, 12]
    assert lk.leaks(docs.limit(0), "id", "text", items, "item", ["prompt"]).count() == 0 and lk.leaks(docs, "id", "text", items.limit(0), "item", ["prompt"]).count() == 0


def test_suffix_array_and_look_up():
    rng = random.Random(4)
    for _ in range(40):
        n = rng.choice([rng.randrange(1, 60), 200])
        w = np.array([*(rng.randrange(0, 4) for _ in range(n)), 0], dtype=np.int32)
        if n == 200:
            w[100:200] = w[:100] = np.maximum(w[:100], 1)  # a match longer than a step of comparison
        a = lk.suffix_array(w, 256)
        key = lambda p: list(w[p:])
        assert [key(p) for p in a] == sorted(key(p) for p in range(n) if w[p] > 0)
        depth = rng.choice([1, 2, 5, 8])
        q = [[rng.randrange(1, 4) for _ in range(depth)] for _ in range(10)] + [w[:100].tolist() if n == 200 else [1]]
        flat, length = np.array([*(x for r in q for x in r), -1], dtype=np.int32), np.array([len(r) for r in q])
        start = np.cumsum(length) - length
        lo, hi = (lk.look_up(w, a, flat, start, length, upper) for upper in (False, True))
        best = lk.longest_matches(w, a, flat, start, length)
        for r, x in enumerate(q):
            assert sorted(a[lo[r] : hi[r]]) == [p for p in range(n) if w[p : p + len(x)].tolist() == x]
            assert best[r] == max((next((k for k in range(len(x)) if p + k >= n or w[p + k] != x[k]), len(x)) for p in range(n)), default=0)


def search(docs, rows, common=frozenset()):
    number = {}
    for _, w in lk._long_texts(rows):
        for x in w:
            number.setdefault(x, len(number) + 1)
    return lk._search(lk.Shard(docs, number, 64), lk.Items(rows, number, common)) if docs else []


def test_shards_give_the_same(monkeypatch):
    rows = [tuple(r) for r in ITEMS if r[0]]
    b = pd.DataFrame([(d, t) for d, t, _ in DOCS], columns=["id", "text"])
    whole = {x[:2] for s in lk._shards(iter([b]), "id", "text") for x in search(s, rows)}
    monkeypatch.setattr(lk, "SHARD_WORDS", 30)
    assert {x[:2] for s in lk._shards(iter([b]), "id", "text") for x in search(s, rows)} == whole


def test_telling_words_are_those_of_all_texts(spark, monkeypatch):
    # A word of 3 of 400 texts is common, one of 2 is not, whatever the blocks.
    filler = [f"w{i}" for i in range(12)]
    rows = [(k, " ".join([*(f"{w}x{k}" for w in filler), *(["three"] if k < 3 else []), *(["two"] if k in (0, 399) else []), "all"]), None) for k in range(400)]
    df = spark.createDataFrame(rows, "item bigint, prompt string, answer string").repartition(5)
    assert lk._common_words(df) == {"three", "all"}
    found = []
    docs = spark.createDataFrame([(k, "so " + r[1]) for k, r in enumerate(rows[::40])], "id bigint, text string")
    for chars in (lk.BLOCK_CHARS, 2000):
        monkeypatch.setattr(lk, "BLOCK_CHARS", chars)
        found.append(sorted(map(tuple, lk.leaks(docs, "id", "text", df, "item", ["prompt", "answer"]).collect())))
    assert found[0] == found[1] and [(r[0], r[1]) for r in found[0]] == [(k, 40 * k) for k in range(10)]


def found_in(texts, item):
    docs = [(k, lk.plain_words(t)) for k, t in enumerate(texts)]
    return {d for d, *_ in search(docs, [(1, item, None), *[tuple(r) for r in ITEMS[1:3]]])}


def test_a_misfit_at_each_place_of_a_short_passage():
    words = P.split()[:12]
    for item in (P, " ".join(words)):
        texts = []
        for k in range(12):
            texts.append(["he", "said", *words[:k], "qqqq", *words[k + 1 :], "so", "then"])  # replaced
            texts.append(["he", "said", *words[:k], "qqqq", *words[k:], "so", "then"])  # put in
        assert found_in([" ".join(t) for t in texts], item) == set(range(24))
    words = P.split()[:13]
    texts = [" ".join(["said", *words[:k], *words[k + 1 :], "so"]) for k in range(13)]  # missing
    assert found_in(texts, " ".join(words)) == set(range(13))


def test_misfits_near_the_ends_of_longer_passages():
    words = P.split()[:16]
    for bad in ((2, 4), (11, 13), (1, 14), (1, 4), (11, 14), (1, 2)):
        assert found_in([" ".join("qqqq" if k in bad else w for k, w in enumerate(words))], " ".join(words)) == {0}


def test_shorter_quotations_stay_out():
    words = P.split()
    texts = [" ".join(["qqqq", "zzzz", *words[a : a + n], "xxxx", "vvvv"]) for n in (8, 9, 10) for a in range(len(words) - n + 1)]
    assert found_in(texts, P) == set()
