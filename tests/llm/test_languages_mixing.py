import random

import pytest
from pyspark.sql import functions as F

from loomspan.llm import languages as lg
from loomspan.llm import mixing as mx

WORDS = {
    "de": "die der und nicht mit regierung ausschuss verlangt neue brücken schulen sitzung menschen", "en": "the of and not with government committee demands new bridges schools sitting people",
    "fr": "les des et pas avec gouvernement comité exige nouveaux ponts écoles séance habitants", "es": "los del y no con gobierno comisión exige nuevos puentes colegios sesión vecinos",
    "it": "gli della e non con governo commissione chiede nuovi ponti scuole seduta abitanti", "nl": "het van en niet met regering commissie eist nieuwe bruggen scholen zitting inwoners",
}

LANGUAGES = tuple(sorted(WORDS))


def sentence(rng, lang, n=8):
    return " ".join(rng.choices(WORDS[lang].split(), k=n)).capitalize() + "."


@pytest.fixture(scope="module")
def filters(spark):
    rng = random.Random(5)
    rows = []
    for i in range(600):
        lang = rng.choice(LANGUAGES)
        label = rng.choice(LANGUAGES) if rng.random() < 0.1 else lang  # one label in ten is wrong
        rows.append((i, " ".join(sentence(rng, lang) for _ in range(4)), rng.choice([label, label.upper(), f"{label}-XX", None])))
    return lg.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), "doc_id", "text", "lang")


def test_labels(spark):
    cases = [("de", "de"), ("DE", "de"), ("de_CH", "de"), ("ger", "de"), ("German", "de"), (" eng ", "en"), ("Dutch", "nl"), ("fre", "fr"), ("und", None), ("", None), (None, None), ("xx", "xx"), ("Portuguese", "pt"), ("nob", "no"), ("klingon", None), ("spa", "es"), ("Italian", "it")]
    df = spark.createDataFrame(cases, "l string, want string")
    assert df.where(~lg.label_code(F.col("l")).eqNullSafe(F.col("want"))).count() == 0


def test_filters_give_all_languages(filters):
    assert filters.bits("=regierung") == 1 and filters.bits("=exige") == (1 << 2) | (1 << 3) and filters.bits("=kelvijar") == 0


def test_held_out(spark, filters):
    rng = random.Random(6)
    rows, want = [], set()
    for i in range(150):
        paras = []
        for p in range(3):
            langs = rng.sample(LANGUAGES, rng.choice([1, 1, 2]))
            paras.append(" ".join(sentence(rng, x) for x in langs) + f" ({sentence(rng, rng.choice(LANGUAGES))})")
            want |= {(i, p, x) for x in langs}
        rows.append((i, "\n \n".join(paras), "x", "y"))
    out = lg.languages(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, row string"), "doc_id", "text", filters)
    got = {(r["doc_id"], r["para_no"], r["lang"]) for r in out.collect()}
    assert len(got & want) / len(want) > 0.99 and len(got - want) < 0.01 * len(want)
    assert out.where("confidence not between 0 and 1 or doc_confidence not between 0 and 1").count() == 0


def test_odd_texts(spark, filters):
    rng = random.Random(1)
    texts = [None, "", "   ", "\n\n\n", "...", "Mit Regierung. Nicht.", "(" + sentence(rng, "de") + ")", "12 34 56 78 90.", "zzz qqq xxx kkk.", ("Die Regierung verlangt neue Brücken. " * 20000),
             "Rząd postanowił wczoraj zwiększyć wydatki.", "Zzz qqq xxx kkk. " + sentence(rng, "fr")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    out = lg.languages(df, "doc_id", "text", filters)
    got = {(r["doc_id"], r["para_no"], r["lang"], r["n_sentences"], r["doc_lang"]) for r in out.collect()}
    # Every document has a row; short sentences and bracketed text are told as a whole; what is in no known language is null.
    want = {(i, p, None, 0, None) for i in (0, 1, 2, 4, 7, 8, 10) for p in (0,)} | {(5, 0, "de", 0, "de"), (6, 0, "de", 0, "de"), (9, 0, "de", 20000, "de"), (11, 0, "fr", 1, "fr")}
    assert {x for x in got if x[0] != 3} == want and {x[2:] for x in got if x[0] == 3} == {(None, 0, None)}
    assert lg.languages(df.limit(0), "doc_id", "text", filters).count() == 0
    assert lg.pieces("a\nb\n\n \n\nc\r\n\r\nd") == ["a\nb", "c", "d"] and lg.sentences("A b c- \nd (x y z q) [e. f]! ¿G h?")[0] == ["a", "b", "cd"]
    assert lg.fit(spark.createDataFrame([], "doc_id bigint, text string, lang string"), "doc_id", "text", "lang").slices.sum() == 0


def test_languages_come_from_the_labels(spark):
    rng = random.Random(8)
    made = {f"{a}{b}": [f"{a}{b}" + "".join(rng.choices("abcdefghij", k=5)) for _ in range(30)] for a in "vw" for b in "klmnop"}  # twelve languages
    rows = [(i, " ".join(rng.choices(made[k], k=9)).capitalize() + ".", k) for i, k in enumerate(k for k in made for _ in range(40))]
    df = spark.createDataFrame([*rows, (9000, "Klong.", "zz")], "doc_id bigint, text string, lang string")
    f = lg.fit(df, "doc_id", "text", "lang")
    assert f.languages == sorted(made)  # 'zz' has one document only
    got = {r["doc_id"]: r["lang"] for r in lg.languages(df, "doc_id", "text", f).collect()}
    assert all(got[i] == k for i, _, k in rows) and got[9000] is None
    none = lg.fit(df.withColumn("lang", F.lit(None).cast("string")), "doc_id", "text", "lang")
    assert none.languages == [] and {r["lang"] for r in lg.languages(df, "doc_id", "text", none).collect()} == {None}


DOCS = "doc_id bigint, source string, text string, rate string, copy_no string"


def test_tokens(spark):
    enc = mx.tokenizer()
    texts = ["Hello world", "", None, "äöü " * 40000, "<|endoftext|>"]
    out = mx.token_counts(spark.createDataFrame([(i, "s", t, "", "") for i, t in enumerate(texts)], DOCS), "text")
    got = {r["doc_id"]: r["n_tokens"] for r in out.collect()}
    assert got[0] == len(enc.encode_ordinary("Hello world")) and got[1] == got[2] == 0 and got[3] == len(enc.encode_ordinary(texts[3])) and got[4] > 1
    assert "text" not in out.columns


def test_mix(spark):
    rng = random.Random(7)
    sizes = {"big": 3000, "mid": 800, "tiny": 30}
    docs = [(f"{s}{i}", s, rng.randrange(50, 150)) for s, n in sizes.items() for i in range(n)] + [("n0", None, 10), ("o0", "other", 10), ("big-empty", "big", 0)]
    sized = spark.createDataFrame(docs, "doc_id string, source string, n_tokens bigint")
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 3), ("tiny", 0.2, 4), ("gone", 0.0, 2), (None, 0.1, 1), ("mid", None, None)], "source string, target_share double, max_repeats int")
    r = mx.rates(sized, targets)
    m = mx.mix(sized, r, "doc_id", seed=3)
    total = sum(t for _, s, t in docs if s in sizes)
    by = {x["source"]: x for x in mx.reached(m, r).collect()}
    assert by["tiny"]["rate"] == 4.0 and by["gone"]["mixed_tokens"] == 0
    assert by["tiny"]["mixed_tokens"] == 4 * sum(t for _, s, t in docs if s == "tiny")
    for s, share in (("big", 0.5), ("mid", 0.3)):
        assert abs(by[s]["mixed_tokens"] / total - share) < 0.02
    assert abs(sum(x["reached_share"] for x in by.values()) - 1) < 1e-9
    most = m.groupBy("doc_id", "source").agg(F.count("*").alias("n"), F.max("copy_no").alias("k")).groupBy("source").agg(F.max("n"), F.max(F.abs(F.col("n") - F.col("k")))).collect()
    limit = {"big": 1, "mid": 3, "tiny": 4}
    assert all(n <= limit[s] and d == 0 for s, n, d in map(tuple, most))
    again = mx.mix(sized.repartition(7), r, "doc_id", seed=3)
    assert m.exceptAll(again).count() == 0 and again.exceptAll(m).count() == 0
    assert mx.mix(sized.limit(0), mx.rates(sized.limit(0), targets), "doc_id").count() == 0
