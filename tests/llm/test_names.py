import pytest

from loomspan.llm import names as n

R = frozenset({"sovatovu", "frubazukri", "dekilime", "kotegato", "torbigretru", "jarfutuvo", "nosapaltu", "gritrutepi"})


@pytest.mark.parametrize("v,c,nick,ok", [
    ("Inga Søvatovu", "INGA SOVATOVU", False, True), ("I. Søvatovu", "Inga Søvatovu", False, True), ("Søvatovu, I.", "Inga Søvatovu", False, True), ("Søvatovu Inga", "Inga Søvatovu", False, True),
    ("Inga Søvhtovu", "Inga Søvatovu", False, True), ("Igna Søvatovu", "Inga Søvatovu", False, True), ("Minister Inga Søvatovu", "Inga Søvatovu", False, True), ("Inga S. Søvatovu", "Inga Søvatovu", False, True),
    ("Inga Søvatovu’", "Inga Søvatovu", False, True), ("Søvatovu, Inga", "Inga Søvatovu", False, True), ("Leni Søvatovu", "Magdalena Søvatovu", True, True), ("Lena Søvatovu", "Magdalena Søvatovu", False, True),
    ("Mag. Søvatovu", "Magdalena Søvatovu", False, True), ("R.-M. Søvatovu", "Rosa-Maria Søvatovu", False, True), ("RosaMaria Søvatovu", "Rosa-Maria Søvatovu", False, True),
    ("Inga Jarfutuvø", "Josef Jarfutuvø", False, False), ("Inga Jarfutuvø", "Inga Søvatovu", False, False), ("K. Søvatovu", "Inga Søvatovu", False, False), ("Igna Søvhtovu", "Inga Søvatovu", False, False), ("Søvatovu", "Inga Søvatovu", False, False),
])
def test_persons(v, c, nick, ok):
    x = n.likelihood("person", v, c, nick, R)
    assert (x is not None and x >= n.LEAST) == ok


@pytest.mark.parametrize("kind,v,c,ok", [
    ("org", "Frubazukri-Consulting Group", "Frubazukri Consulting Group", True), ("org", "Frubazukri Consulting", "Frubazukri Consulting Group", True), ("org", "Consulting Frubazukri Group", "Frubazukri Consulting Group", True),
    ("org", "Frubazukri CG", "Frubazukri Consulting Group", True), ("org", "Frubazukri Cons. Grp.", "Frubazukri Consulting Group", True), ("org", "The Frubazukri Consulting, Group", "Frubazukri Consulting Group", True),
    ("org", "Frubazukri Energie", "Frubazukri Energy Company", True), ("org", "Frubazukri Wate. A.G.", "Frubazukri Water Services AG", True), ("org", "Frubazukri Maritime Gesellschaft mbH", "Frubazukri Maritime GmbH", True), ("org", "Gritrutépi KG", "Gritrutépi Kitchenware Group", True), ("org", "Gritrutépi LA", "Gritrutépi Logistics AG", True),
    ("org", "Frubazukri Holdings Group", "Frubazukri Consulting Group", False), ("org", "Frubazukri Consulting AG", "Frubazukri Consulting Group", False), ("org", "Kotégato Consulting Group", "Frubazukri Consulting Group", False),
    ("org", "Min. Finance, Torbigretru", "Ministry of Finance of Torbigretru", True), ("org", "Torbigretru Ministry of Finance", "Ministry of Finance of Torbigretru", True), ("org", "Ministry of Transport of Torbigretru", "Ministry of Finance of Torbigretru", False),
    ("place", "Dékilime/See", "Dékilime am See", True), ("place", "Dékilime (See)", "Dékilime a. See", True), ("place", "Pt. Nosapaltu", "Port of Nosapaltu", True), ("place", "St. Nosapaltu (town)", "Sankt Nosapaltu", True), ("place", "Port Nosapaltu", "Sankt Nosapaltu", False),
    ("other", "Foto: Nosapaltu", "Nosapaltu", False),
])
def test_firms_and_places(kind, v, c, ok):
    x = n.likelihood(kind, v, c, False, R)
    assert (x is not None and x >= n.LEAST) == ok


def test_one_edit():
    assert all(n.one_edit("abcd", x) for x in ("abcd", "abd", "abcde", "abxd", "abdc", "bacd"))
    assert not any(n.one_edit("abcd", x) for x in ("abdce", "ab", "badc", "xbxd"))


def test_entities(spark):
    nodes = [
        (1, "Inga Søvatovu", "PER"), (2, "Inga Søvatovu", "PERSON"), (3, "I. Sovatovu", "PER"), (4, "Johannes Søvatovu", "PER"), (5, "J. Søvatovu", "PER"), (6, "Josef Søvatovu", "PER"),
        (7, "Kotégato Foods AG", "ORG"), (8, "Kotégato Foods", "ORG"), (9, "Kotégato Energy AG", "ORG"), (10, None, "PER"), (11, "Foto: Inga", "MISC"), (12, "Foto: Inga", None), (13, "", "PER"), (None, "Inga Søvatovu", "PER"), (14, "--", "LOC"), (1, "Inga Søvatovu", "PER"), (15, "x" * 3000, "PER"),
    ]
    df = spark.createDataFrame([(*r, "extra") for r in nodes], "node bigint, entity_name string, entity_type string, entity string")
    seen = spark.createDataFrame([("Johannes Søvatovu", "PER")] * 9 + [("Josef Søvatovu", "PER"), (None, "PER")], "entity_name string, entity_type string")
    alias = spark.createDataFrame([("Johannes", "Hannes"), (None, "x")], "formal_name string, short_name string")
    got = {r["node"]: r["entity"] for r in n.variant_entities(df, seen, alias).collect()}
    groups = {}
    for k, e in got.items():
        groups.setdefault(e, set()).add(k)
    assert sorted(map(sorted, groups.values())) == [[1, 2, 3], [4, 5], [6], [7, 8], [9], [11, 12], [13], [14], [15]]
    pairs = n.variant_pairs(n.variant_entities(df, seen, alias))
    assert sorted(map(tuple, pairs.collect())) == [(1, 2), (1, 3), (2, 3), (4, 5), (7, 8), (11, 12)]
    assert n.variant_entities(df.limit(0), seen.limit(0), alias.limit(0)).count() == 0


def test_common_words_are_no_keys_but_lose_nothing(spark):
    nodes = [(i, f"Inga Frawo{chr(97 + i // 26)}{chr(97 + i % 26)}nurtil", "PER") for i in range(60)] + [(100, "Inga Inga", "PER"), (101, "Inga, Inga", "PER")]
    df = spark.createDataFrame(nodes, "node bigint, entity_name string, entity_type string")
    got = {r["node"]: r["entity"] for r in n.variant_entities(df, df.limit(0), spark.createDataFrame([], "formal_name string, short_name string"), generic=4).collect()}
    assert got[100] == got[101]


def test_a_very_common_surname(spark):
    givens = ["Friedrich", "Xenia", "William", "Octavia", "Hildegard", "Ulrich", "Nathaniel", "Guadalupe"]
    nodes = [(i, f"{g} Müller", "PER") for i, g in enumerate(givens)]
    nodes += [(100, "F. Müller", "PER"), (101, "Freidrich Müller", "PER"), (102, "Bill Müller", "PER"), (103, "Müller, Hild.", "PERSON"), (104, "Dr. Octavia MULLER", "PER"), (105, "Z. Müller", "PER"), (106, "Guadalupe S. Müller", "PER")]
    df = spark.createDataFrame(nodes, "node bigint, entity_name string, entity_type string")
    alias = spark.createDataFrame([("William", "Bill")], "formal_name string, short_name string")
    for generic in (3, 64):  # the surname is no key by itself, or is one
        got = {r["node"]: r["entity"] for r in n.variant_entities(df, df.limit(0), alias, generic).collect()}
        groups = {}
        for k, e in got.items():
            groups.setdefault(e, set()).add(k)
        assert sorted(map(sorted, groups.values())) == [[0, 100, 101], [1], [2, 102], [3, 104], [4, 103], [5], [6], [7, 106], [105]]


def grouped(spark, nodes, alias=(), generic=n.GENERIC, often=()):
    seen = spark.createDataFrame([(*x[1:],) for x in nodes if x[0] in often for _ in range(9)], "entity_name string, entity_type string")
    df = spark.createDataFrame(nodes, "node bigint, entity_name string, entity_type string")
    alias = spark.createDataFrame(list(alias), "formal_name string, short_name string")
    groups = {}
    for r in n.variant_entities(df, seen, alias, generic).collect():
        groups.setdefault(r["entity"], set()).add(r["node"])
    return sorted(sorted(g) for g in groups.values() if len(g) > 1)


def test_results_do_not_depend_on_what_is_common(spark):
    syllables = ["fra", "wo", "nur", "til", "ke", "dri", "bam", "sou"]
    fill = ["".join(syllables[(i // 8**k) % 8] for k in range(3)).capitalize() for i in range(8)]
    nodes = [(200 + i, f"Hildegard {x}", "PER") for i, x in enumerate(fill)] + [(300 + i, f"{g} Müller", "PER") for i, g in enumerate(["Xenia", "Octavia", "Guadalupe", "Ulrich", "Egon"])]
    nodes += [(1, "Hildegard Müller", "PER"), (2, "Hildegard Mülller", "PER"), (3, "Müller Hildegard", "PER"), (4, "Hildegard Müllers", "PER"), (5, "Müller Hildegrad", "PER")]
    nodes += [(10, "Johannes Müller", "PER"), (11, "Johann Müller", "PER"), (12, "Magdalena Müller", "PER"), (13, "Lena Müller", "PER"), (14, 'Wilhelmina "Bobby" Müller', "PER"), (15, "B. Müller", "PER")]
    for i, (x, y) in enumerate([("Austrian", "Water"), ("Austrian", "Finance"), ("Baltic", "Water"), ("Baltic", "Finance")]):
        nodes += [(400 + 9 * i + k, f"{x} {y} {z}", "ORG") for k, z in enumerate(["Services AG", "Logistics AG", "Services", "Logistics"])]
    nodes += [(450, "Austrian Watre Services AG", "ORG"), (451, "Services Baltic Finance AG", "ORG")]
    want = [[1, 2, 3, 4, 5], [10, 11], [12, 13], [14, 15], [400, 402, 450], [401, 403], [409, 411], [410, 412], [418, 420], [419, 421], [427, 429, 451], [428, 430]]
    for generic in (3, 64):
        assert grouped(spark, nodes, generic=generic, often=(1, 10, 12, 14)) == want, generic


def test_short_surnames(spark):
    nodes = [(1, "Jong Kim", "PER"), (2, "J. Kim", "PER"), (3, "Magdalena Ott", "PER"), (4, "Mag. Ott", "PER"), (5, "William Lee", "PER"), (6, "Bill Lee", "PER"), (7, "Lee William", "PER"), (8, "Xenia Kim", "PER"), (9, "Ed Ott", "PER"), (10, "Ott, Ed", "PER"), (11, "E. Ott", "PER"), (12, "Kim", "PER"), (13, "Lee", "PER")]
    for generic in (1, 64):
        assert grouped(spark, nodes, [("William", "Bill")], generic, often=(1, 3, 5, 9)) == [[1, 2], [3, 4], [5, 6, 7], [9, 10, 11]]
    filler = [(20, "Foo of Bar AG", "ORG"), (21, "Foo of Baz AG", "ORG")]
    assert grouped(spark, filler) == []


def test_nicknames_are_learnt_from_surnames_of_any_size(spark):
    own = lambda i, m: [(f"g{i}x{j}", f"s{i}") for j in range(m)]
    for size, surnames in ((1, 3), (9, 3), (22, 6), (58, 12)):
        pairs = [x for i in range(surnames) for x in [("magdalena", f"s{i}"), ("leni", f"s{i}"), *own(i, size)]] + [("magdalena", "alone")]
        pairs += [(g, f"t{i}") for i in range(3) for g in ("xenia", f"h{i}")] + [("xenia", "s0"), ("once", "s0"), ("once", "s1")]
        givens = spark.createDataFrame([(k, g, s, "") for k, (g, s) in enumerate(pairs)], "unit bigint, given string, surname string, nick string")
        got = {tuple(r) for r in n.nicknames(givens, spark.createDataFrame([], "formal_name string, short_name string")).collect()}
        assert ("leni", "magdalena") in got and ("magdalena", "leni") in got, size
        assert not any("xenia" in x for x in got)


def test_equal_spellings_meet_in_their_midst(spark):
    names = ["Robret Wagner", "Robert Wangner", "Robert Wagner", "Robert Wagneer", "Robert Wagnr", "Anna Li", "A. Li", "Robert Kim", "R. Kim"]
    nodes = spark.createDataFrame([(i, x, "PER") for i, x in enumerate(names)], "node bigint, entity_name string, entity_type string")
    none = spark.createDataFrame([], "entity_name string, entity_type string")
    alias = spark.createDataFrame([], "formal_name string, short_name string")
    got = {r["node"]: r["entity"] for r in n.variant_entities(nodes, none, alias).collect()}
    assert len({got[i] for i in range(5)}) == 1 and got[0] == 2 and got[5] == got[6] and got[7] == got[8] and len(set(got.values())) == 3
    links = {r["node"]: r["form"] for r in n.variant_links(nodes, none, alias).collect()}
    assert links == {0: 2, 1: 2, 3: 2, 4: 2, 6: 5, 8: 7}
