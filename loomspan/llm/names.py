"""Variant spellings of names, by a noisy channel.

Spellings are tried as noisy forms of more complete or more frequent ones.  The
weight of "v was written for c" is log prior(c) + log likelihood(v | c): the
prior is how often c occurs, the likelihood a product over the parts of the
name of the chances of a typing error, initial, cut word, nickname, swapped or
missing part.  Each spelling is attached to its best c, if any is likely
enough; spellings that lead to the same end are one entity.

Candidates come from an equi-join on the rarer words of a name, each with all
its forms that lack one letter, so every pair with at most one typing error in
such a word meets.  Words in more than ``GENERIC`` spellings (given names, legal
forms, very common surnames) are no keys by themselves.  Names with such a word,
or with one that may be a misspelling of it, meet on it together with another
word: whole or with a letter left out, as the nickname or full form it stands
for, or as the beginning, end or first letter that a short form has.  A person's
two parts do so in both orders.  So nothing grows with the square of a word's
rows.  Lost are only firms that have no rare word in common, a common word
misspelt, and one cut word in place of several of which the first is common.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.plans.runtime import staged

#: A word in more spellings of its kind than this is no key by itself.
GENERIC = 64
#: Given names of a surname up to which sharing it counts in full; and the share of its surnames that a nickname has in common with its full form.
FEW, SHARED = 12, 0.6

# Kinds of entity by type label.
KINDS = {"PER": "person", "PERSON": "person", "ORG": "org", "ORGANISATION": "org", "ORGANIZATION": "org", "LOC": "place", "GPE": "place", "LOCATION": "place"}
# Titles before a person's name.
TITLES = {"dr", "prof", "professor", "sen", "senator", "minister", "ministerin", "frau", "herr", "mr", "mrs", "ms", "miss", "ing", "sir", "abg", "president", "mme", "m"}
# Legal forms, and words that are one when written together.
FORMS = {
    "ag": "ag", "aktiengesellschaft": "ag", "gmbh": "gmbh", "gesmbh": "gmbh", "gesellschaftmbh": "gmbh", "mbh": "gmbh", "ltd": "ltd", "limited": "ltd", "plc": "plc", "inc": "inc",
    "incorporated": "inc", "corp": "corp", "corporation": "corp", "co": "company", "company": "company", "group": "group", "gruppe": "group", "grp": "group", "llc": "llc", "sa": "sa", "spa": "spa", "kg": "kg", "se": "se",
}
# Words that may be left out of names of organisations and places.
SMALL = {"the", "of", "for", "f", "fur", "and", "am", "a", "de", "la", "town", "city"}
# Words for which short forms are usual in names of places.
PLACE = {"pt": "port", "st": "sankt", "saint": "sankt", "skt": "sankt", "sankt": "sankt", "port": "port"}

#: Log likelihoods of what the channel does to one part of a name.
TYPO, INITIAL, CUT, NICK, TAIL, SWAP, NO_FORM, ACRONYM = -3.0, -2.0, -2.0, -2.0, -2.5, -1.0, -1.0, -2.5
#: Less likely than this, a spelling isn't attached.
LEAST = -5.6


def fold(text: str) -> str:
    """Lower case without accents; ae, oe and ue, as umlauts are also written, become a, o and u."""
    text = text.translate(str.maketrans({"ø": "o", "Ø": "O", "ß": "ss", "æ": "ae", "Æ": "AE", "ł": "l", "Ł": "L"}))
    plain = "".join(ch for ch in unicodedata.normalize("NFD", text) if not unicodedata.combining(ch)).lower()
    return re.sub("([aou])e", r"\1", plain)


def words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", fold(text))


def kind_of(entity_type: str | None) -> str:
    return KINDS.get((entity_type or "").strip().upper(), "other")


def one_edit(a: str, b: str) -> bool:
    """Whether a and b differ by one letter put in, left out or replaced, or two neighbours swapped."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


@lru_cache(maxsize=1 << 16)
def person(name: str) -> dict | None:
    """Parts of a person's name: given (list of parts), surname, whether given is initials; None without two parts."""
    nick = re.findall(r'["“„]([^"”“]+)["”“]', name)
    text = re.sub(r'["“„][^"”“]+["”“]', " ", name)
    text = re.sub(r"['’`´](?:s\b|\s|$)", " ", text.strip())
    comma = "," in text
    if comma:
        last, _, first = text.partition(",")
        text = f"{first.strip()} {last.strip()}"
    chunks = [c for c in text.split() if words(c)]
    while len(chunks) > 2 and "".join(words(chunks[0])) in TITLES and len("".join(words(chunks[0]))) > 1:
        chunks = chunks[1:]
    if len(chunks) < 2:
        return None
    surname = "".join(words(chunks[-1]))
    given = [w for c in chunks[:-1] for w in words(c)]
    if len(given) > 1 and any(len(g) > 1 for g in given):  # initials between are left aside
        head = given[0]
        given = [head, *[g for g in given[1:] if len(g) > 1]]
    return {"given": given, "surname": surname, "initials": all(len(g) == 1 for g in given), "nick": "".join(words(nick[0])) if nick else "", "plain": not comma and len(chunks) == 2, "cut": chunks[0].endswith(".")}


def given_of(name: str) -> str:
    p = person(name)
    return "".join(p["given"]) if p and not p["initials"] and not p["cut"] else ""


def _given(v: dict, c: dict, nick: bool) -> float | None:
    a, b = "".join(v["given"]), "".join(c["given"])
    if a == b:
        return INITIAL if v["initials"] else 0.0
    if v["initials"] or c["initials"]:
        x, y = (v, c) if v["initials"] else (c, v)
        s, full = "".join(x["given"]), "".join(y["given"])
        heads = "".join(g[0] for g in y["given"])
        return INITIAL if s == heads or (len(s) == 1 and full.startswith(s)) or (len(s) == 1 and y["nick"].startswith(s) and y["nick"]) else None
    if nick or (v["nick"] and v["nick"] == b) or (c["nick"] and c["nick"] == a):
        return NICK
    if min(len(a), len(b)) >= 4 and one_edit(a, b):
        return TYPO
    s, full = sorted((a, b), key=len)
    short = v if s == a else c
    if full.startswith(s) and (len(s) >= 3 or short["cut"]):
        return CUT
    if len(s) >= 4 and full.endswith(s):
        return TAIL
    if 4 <= len(s) <= 5 and s[:3] == full[:3]:
        return TYPO
    if (len(v["given"]) > 1) != (len(c["given"]) > 1) and s in (v["given"] + c["given"]) and full != s and s == (c if len(v["given"]) > 1 else v)["given"][0] and full.startswith(s):
        return CUT
    return None


def person_likelihood(variant: str, form: str, nick: bool) -> float | None:
    """log P(variant | form), or None if the one can't come from the other."""
    v, c = person(variant), person(form)
    if not v or not c:
        return None
    best = None
    swapped = {**v, "given": [v["surname"]], "surname": "".join(v["given"]), "initials": False, "cut": False}
    for x, cost in ((v, 0.0), (swapped, SWAP)) if v["plain"] and not v["initials"] else ((v, 0.0),):
        s, t = x["surname"], c["surname"]
        if s == t:
            of_surname = 0.0
        elif min(len(s), len(t)) >= 5 and one_edit(s, t):
            of_surname = TYPO
        elif min(len(s), len(t)) >= 6 and (s == t + "s" or t == s + "s" or (s[-1] == "s" and one_edit(s[:-1], t)) or (t[-1] == "s" and one_edit(s, t[:-1]))):
            of_surname = TYPO
        else:
            continue
        of_given = _given(x, c, nick)
        if of_given is None or (of_surname == TYPO and of_given == TYPO):
            continue
        total = cost + of_surname + of_given
        best = total if best is None else max(best, total)
    return best


@lru_cache(maxsize=1 << 16)
def firm(name: str, place: bool, formless: bool = False) -> dict:
    """Words of an organisation's or place's name, its legal form, and which words are cut or capitals.

    ``formless`` reads two or three capitals as an acronym, not as a legal form.
    """
    text = re.sub(r"['’`´](?:s\b|\s|$)", " ", name.strip())
    text = re.sub(r"\b((?:[A-Za-z]\.){2,})", lambda m: m[0].replace(".", ""), text)
    text = re.sub(r"(?i)\bGes\.?\s?m\.?\s?b\.?\s?H\b\.?|\bGesellschaft\s+(?:mbH|mit beschränkter Haftung)\b", "GmbH", text)
    got, form, cut, caps = [], "", set(), set()
    for m in re.finditer(r"([^\W_]+)(\.?)", text):
        w = fold(m[1])
        if w in SMALL and not (m[1].isupper() and len(w) == 2 and not name.isupper()):  # "LA" may be an acronym
            continue
        if place:
            w = PLACE.get(w, w)
        elif w in FORMS and got and not (formless and m[1].isupper() and len(w) <= 3):
            if not form:
                form = FORMS[w]
                continue
            elif FORMS[w] == form:
                continue
        if m[2]:
            cut.add(len(got))
        if m[1].isupper() and 2 <= len(m[1]) <= 5:
            caps.add(len(got))
        got.append(w)
    return {"words": got, "form": form, "cut": cut, "caps": caps}


def _word(a: str, b: str, cut: bool) -> float | None:
    if a == b:
        return 0.0
    if len(a) < len(b) and b.startswith(a) and (len(a) >= 3 or (cut and len(a) >= 1)):
        return CUT + 0.5
    if min(len(a), len(b)) >= 4 and one_edit(a, b):
        return TYPO
    if cut and len(a) >= 2 and a[0] == b[0] and len(a) < len(b) and _inside(a, b):
        return CUT
    if min(len(a), len(b)) >= 6 and a[:5] == b[:5] and abs(len(a) - len(b)) <= 2:
        return TYPO
    return None


def _inside(a: str, b: str) -> bool:
    it = iter(b)
    return all(ch in it for ch in a)


def firm_likelihood(variant: str, form: str, rare: frozenset, place: bool) -> float | None:
    """As ``person_likelihood``, for organisations and places; ``rare`` are words that tell names apart."""
    c = firm(form, place)
    ways = [_firm(v, c, rare) for v in (firm(variant, place), *([] if place else [firm(variant, place, True)]))]
    return max((x for x in ways if x is not None), default=None)


def _firm(v: dict, c: dict, rare: frozenset) -> float | None:
    total = 0.0
    if v["form"] != c["form"]:
        if v["form"] and c["form"]:
            return None
        total += NO_FORM
    left = list(c["words"])
    rest, anchored, typos, cuts, same = [], False, 0, False, 0
    for i, w in enumerate(v["words"]):
        if w in left:
            left.remove(w)
            anchored |= w in rare and len(w) >= 4
            same += len(w) >= 4
        else:
            rest.append(i)
    # Names of common words only are told apart by two of them together.
    anchored |= same >= 2 and not rare & {*v["words"], *c["words"]}
    for i in list(rest):
        w = v["words"][i]
        ways = []
        for t in left:
            x = _word(w, t, i in v["cut"])
            y = _word(t, w, False) if x is None else None
            if (best := x if x is not None else y) is not None:
                ways.append((best, t))
        if ways:
            cost, t = max(ways)
            rest.remove(i)
            left.remove(t)
            total += cost
            typos += cost == TYPO
            cuts |= i in v["cut"] and t.startswith(w)
            anchored |= cost == TYPO and min(len(w), len(t)) >= 5 and (w in rare or t in rare)
    if len(rest) == 1 and left and rest[0] in v["caps"]:
        heads = "".join(t[0] for t in left)
        w = v["words"][rest[0]]
        if w in (heads, heads + c["form"][:1]) and len(w) >= 2:
            rest, left, total = [], [], total + ACRONYM + (0.0 if v["form"] == c["form"] else -NO_FORM)
    if cuts and not rest and left and anchored:  # a cut word stands for the words after it too
        total += INITIAL / 2 * len(left)
        left = []
    if rest or left:  # a blank may be put in the wrong place
        a, b = "".join(v["words"]), "".join(c["words"])
        anchor = bool(set(v["words"]) & set(c["words"]) & rare) or (same >= 2 and a == b)
        return TYPO + (0.0 if v["form"] == c["form"] else NO_FORM) if anchor and len(b) >= 8 and one_edit(a, b) else None
    if not anchored or typos > 1:
        return None
    if v["words"] != c["words"] and sorted(v["words"]) == sorted(c["words"]):
        total += SWAP
    return total


def likelihood(kind: str, variant: str, form: str, nick: bool, rare: frozenset) -> float | None:
    if kind == "person":
        return person_likelihood(variant, form, nick)
    if kind in ("org", "place"):
        return firm_likelihood(variant, form, rare, kind == "place")
    return None


def completeness(kind: str, name: str) -> int:
    """2 for a name written in full, less for cut, short or formless ones."""
    if kind == "person":
        p = person(name)
        return 0 if not p or p["initials"] else 1 if p["cut"] else 2
    f = firm(name, kind == "place")
    return 2 - bool(f["cut"] or (f["caps"] and not name.isupper() and any(len(f["words"][i]) <= 3 for i in f["caps"]))) - (kind == "org" and not f["form"])


def _words_told_by(kind: str, name: str) -> list[str]:
    """Words that may be keys: surname and given name of a person, whatever their length; else words of four letters or more."""
    if kind == "person":
        p = person(name)
        return sorted({p["surname"], *([] if p["initials"] else ["".join(p["given"])])}) if p else []
    return sorted({w for w in words(name) if len(w) >= 4})


def _bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        b["bag"] = [_words_told_by(k, x) for k, x in zip(b.kind, b["name"])]
        yield b[["unit", "kind", "name", "freq", "bag"]]


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        kinds = [kind_of(t) for t in b.entity_type]
        bags = [words(n) for n in b.entity_name]
        b["kind"] = kinds
        b["norm"] = [" ".join(w) if w else n for w, n in zip(bags, b.entity_name)]
        yield b[["node", "entity_name", "freq", "kind", "norm"]]


def _without_a_letter(w: str) -> set[str]:
    return {w[:i] + w[i + 1 :] for i in range(len(w))}


def _keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for unit, kind, rare, bag in zip(b.unit, b.kind, b.rare, b.bag):
            if len(rare) == 0 and kind != "person" and len(bag):
                rows.append((unit, kind, "=" + " ".join(sorted(bag))))
            for w in rare:
                rows.append((unit, kind, w))
                if len(w) >= 5:
                    rows += [(unit, kind, k) for k in _without_a_letter(w)]
                if kind == "person" and len(w) >= 6 and w[-1] == "s":
                    rows += [(unit, kind, k) for k in _without_a_letter(w[:-1])]
        yield pd.DataFrame(rows, columns=["unit", "kind", "key"]).drop_duplicates()


def _near_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(kind, w, key): words that may be misspellings of each other share a key."""
    for b in batches:
        rows = []
        for kind, w in zip(b.kind, b.w):
            keys = {w} | (_without_a_letter(w) if len(w) >= 5 else set())
            if kind == "person" and len(w) >= 6 and w[-1] == "s":
                keys |= _without_a_letter(w[:-1])
            elif kind != "person" and len(w) >= 6:
                keys.add(f"{w[:5]}-")
            rows += [(kind, w, k) for k in keys]
        yield pd.DataFrame(rows, columns=["kind", "w", "key"])


def _other_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(unit, kind, w, other, nick, short, letters): a word of a name, with each word by which names that share it are told apart.

    Of a person these are surname and given name, in both orders if they may be
    swapped.  Of others they are the rare words besides w, or all words if there
    are none.  ``letters`` are first letters of what a short form may stand for.
    """
    for b in batches:
        rows = []
        for unit, kind, name, rare, bag in zip(b.unit, b.kind, b["name"], b.rare, b.bag):
            if kind == "person":
                p = person(name)
                if not p:
                    continue
                given = "".join(p["given"])
                rows.append((unit, kind, p["surname"], given, p["nick"], p["initials"] or len(given) < 3, given[:1]))
                if p["plain"] and not p["initials"]:
                    rows.append((unit, kind, given, p["surname"], p["nick"], len(p["surname"]) < 3, p["surname"][:1]))
                continue
            f = firm(name, kind == "place")
            cut, caps = ({f["words"][i] for i in f[k]} for k in ("cut", "caps"))
            for w in bag:
                others = set(rare) - {w} or {*words(name), *f["words"]} - {w}
                if not set(f["words"]) - {w}:
                    others.add("")
                rows += [(unit, kind, w, o, "", len(o) <= 5 or o in cut, o if o in caps else o[:1]) for o in others]
        yield pd.DataFrame(rows, columns=["unit", "kind", "w", "other", "nick", "short", "letters"])


def _pair_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(unit, kind, key, side): keys of a common word and another; names meet on equal sides, or on side 1 (short) and 2 (full)."""
    for b in batches:
        rows = set()
        for unit, kind, w, t, o, nick, short, letters in zip(b.unit, b.kind, b.w, b.word, b.other, b.nick, b.short, b.letters):
            rows |= {(unit, kind, f"{t}|{x}", 0) for x in {o, nick or o}}
            if kind == "person":
                if len(o) >= 4 and w == t:  # of two misspelt words nothing is taken
                    rows |= {(unit, kind, f"{t}|{k}", 0) for k in _without_a_letter(o)}
                if 4 <= len(o) <= 5:
                    rows.add((unit, kind, f"{t}|{o[:3]}-", 1))
                rows |= {(unit, kind, f"{t}|{o[:3]}-", 2), *((unit, kind, f"{t}|{o[i:]}", 2) for i in range(1, len(o) - 3))}
                rows |= {(unit, kind, f"{t}|{x[0]}.", 2) for x in (o, nick) if x}
            elif o:
                rows.add((unit, kind, f"{t}|{o[0]}.", 2))
            if short:
                rows |= {(unit, kind, f"{t}|{x}.", 1) for x in letters}
            if len(o) >= 3:
                rows |= {(unit, kind, f"{t}|{o}", 1), *((unit, kind, f"{t}|{o[:i]}", 2) for i in range(3, len(o)))}
        yield pd.DataFrame(list(rows), columns=["unit", "kind", "key", "side"])


def _score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs that are likely enough, with the log likelihood of the lesser form given the more complete, else more frequent one."""
    for b in batches:
        rows = []
        for r in b.itertuples(index=False):
            rare = frozenset(r.rare_a) | frozenset(r.rare_b)
            full_a, full_b = completeness(r.kind, r.name_a), completeness(r.kind, r.name_b)
            a_first = (full_a, r.freq_a, r.unit_a) < (full_b, r.freq_b, r.unit_b)
            v, c = (r.name_a, r.name_b) if a_first else (r.name_b, r.name_a)
            x = likelihood(r.kind, v, c, bool(r.nick), rare)
            if x is not None and x >= LEAST:
                rows.append((r.unit_a, r.unit_b, full_a, full_b, r.freq_a, r.freq_b, x))
        yield pd.DataFrame(rows, columns=["unit_a", "unit_b", "full_a", "full_b", "freq_a", "freq_b", "likelihood"])


def attachments(scored: DataFrame) -> DataFrame:
    """(unit, parent, weight): the form of greatest posterior that each spelling is attached to; spellings without one have no row.

    Spellings are ranked as canonical forms by completeness, then frequency, and
    among equals by the evidence that others are variants of them: the sum of
    the likelihoods of all spellings linked to them, each by its frequency.  So
    of several rare spellings the one in their midst comes first.  A spelling is
    attached to forms ranked above it only, so there are no circles.
    """
    sides = [F.struct(*[F.col(f"{c}_{x}").alias(c) for c in ("unit", "full", "freq")]) for x in "ab"]
    ends = scored.select(F.explode(F.array(F.struct(sides[0].alias("own"), sides[1].alias("other")), F.struct(sides[1].alias("own"), sides[0].alias("other")))).alias("e"), "likelihood")
    ends = ends.select("e.own", "e.other", "likelihood")
    support = ends.groupBy(F.col("own.unit").alias("unit")).agg(F.round(F.sum(F.exp("likelihood") * (1 + F.col("other.freq"))), 9).alias("support"))
    known = ends.select(F.col("own.unit").alias("unit"), "own", "other", "likelihood").join(support, "unit")
    known = known.join(support.select(F.col("unit").alias("other_unit"), F.col("support").alias("other_support")), F.col("other.unit") == F.col("other_unit"))
    rank = lambda x, support: F.struct(F.col(f"{x}.full").alias("full"), F.col(f"{x}.freq").alias("freq"), F.col(support).alias("support"), F.negative(F.col(f"{x}.unit")).alias("first"))
    above = known.where(rank("other", "other_support") > rank("own", "support"))
    weight = F.col("likelihood") + F.log(1.0 + F.col("other.freq"))
    best = F.max(F.struct(weight.alias("weight"), F.col("other_support").alias("support"), F.negative("other_unit").alias("p")))
    return above.groupBy("unit").agg(best.alias("b")).select("unit", F.negative("b.p").alias("parent"), "b.weight")


def _givens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for unit, name in zip(b.unit, b["name"]):
            p = person(name)
            if p:
                rows.append((unit, given_of(name), p["surname"], p["nick"]))
        yield pd.DataFrame(rows, columns=["unit", "given", "surname", "nick"])


def nicknames(givens: DataFrame, alias: DataFrame) -> DataFrame:
    """(short, formal), both orders: pairs of given names used for each other.

    From the alias table, from names that show the nickname in quotes, and from
    pairs of given names that share surnames far more often than relatives do:
    in at least two surnames, and SHARED of those that have the rarer one.  A
    surname with k given names counts FEW / k, or 1 if that is less.
    """
    table = alias.select(F.col("short_name").alias("s"), F.col("formal_name").alias("f")).where("s is not null and f is not null")
    table = table.select(*[_folded(k).alias(k) for k in ("s", "f")])
    quoted = givens.where("nick <> '' and given <> ''").select(F.col("nick").alias("s"), F.col("given").alias("f"))
    g = givens.where("given <> ''").select("given", "surname").distinct()
    known = table.unionByName(quoted).distinct()
    # Every surname counts, one with more than FEW given names less, as two of them often share it by chance.
    k = g.groupBy("surname").agg(F.count(F.lit(1)).alias("k"))
    g = staged(g.join(k, "surname").withColumn("w", F.least(F.lit(1.0), FEW / F.col("k"))), "surnames")
    n = g.groupBy("given").agg(F.sum("w").alias("n"))
    # What shares SHARED of a name's surnames by weight is found in those that come first and make up more than the rest;
    # these are the ones with fewest given names.  The others are only looked at for the pairs this leaves.
    s = g.join(n.where("n >= 2"), "given").join(known.select(F.col("s").alias("given")).distinct(), "given", "left_anti")
    w = Window.partitionBy("given").orderBy("k", "surname").rowsBetween(Window.unboundedPreceding, 0)
    first = s.withColumn("upto", F.sum("w").over(w)).where(F.col("upto") - F.col("w") <= (1 - SHARED) * F.col("n") + 1e-9)
    f = g.join(n, "given").select(F.col("given").alias("f"), "surname", F.col("n").alias("nf"))
    met = first.withColumnRenamed("given", "s").join(f, "surname").where("s <> f and n < nf").select("s", "f").distinct()
    both = met.join(s.select(F.col("given").alias("s"), "surname", "w", "n"), "s").join(f.select("f", "surname"), ["f", "surname"]).groupBy("s", "f").agg(F.sum("w").alias("both"), F.first("n").alias("n"))
    learnt = both.where((F.col("both") >= 2 - 1e-9) & (F.col("both") >= SHARED * F.col("n") - 1e-9)).select("s", "f")
    pairs = known.unionByName(learnt)
    siblings = pairs.join(pairs.withColumnRenamed("s", "t"), "f").where("s <> t").select("s", F.col("t").alias("f"))
    pairs = pairs.unionByName(siblings)
    return pairs.unionByName(pairs.select(F.col("f").alias("s"), F.col("s").alias("f"))).distinct()


def _folded(name: str):
    plain = F.regexp_replace(F.lower(F.translate(F.col(name), "äöüéèàáíóúñçÄÖÜÉ", "aoueeaaiouncAOUE")), "[^a-z]", "")
    return F.regexp_replace(plain, "([aou])e", "$1")


def _linked(nodes: DataFrame, mentions: DataFrame, alias: DataFrame, generic: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The nodes with their spellings, the spellings, and what each is attached to.

    ``nodes`` has node, entity_name, entity_type; ``mentions`` has entity_name
    and entity_type (one row per mention, for the prior; may be empty); ``alias``
    has formal_name, short_name.  Nodes with a null name or id are passed over;
    a null or unknown type is a kind of its own, in which only equal names are
    linked; spellings that differ in case, accents, blanks and punctuation only
    are the same.  Repeated rows give one.
    """
    freq = mentions.where("entity_name is not null").groupBy("entity_name", "entity_type").agg(F.count(F.lit(1)).alias("freq"))
    n = nodes.where("node is not null and entity_name is not null").select("node", "entity_name", "entity_type").distinct()
    n = n.join(freq, n.entity_name.eqNullSafe(freq.entity_name) & n.entity_type.eqNullSafe(freq.entity_type), "left").select("node", n.entity_name, n.entity_type, F.coalesce("freq", F.lit(0)).alias("freq"))
    parsed = staged(n.mapInPandas(_parse, "node bigint, entity_name string, freq bigint, kind string, norm string"), "names")
    # A unit is a spelling; its id is the least of its nodes, and it shows its most frequent writing.
    member = parsed.groupBy("kind", "norm").agg(F.min("node").alias("unit"), F.sum("freq").alias("freq"), F.max_by("entity_name", F.struct("freq", "entity_name")).alias("name"))
    member = staged(member, "spellings")
    units = staged(member.select("unit", "kind", "name", "freq").mapInPandas(_bags, "unit bigint, kind string, name string, freq bigint, bag array<string>"), "bags")
    counts = units.select("kind", F.explode("bag").alias("w")).groupBy("kind", "w").agg(F.count(F.lit(1)).alias("n"))
    rare = units.select("unit", "kind", F.explode("bag").alias("w")).join(counts.where(F.col("n") <= generic), ["kind", "w"]).groupBy("unit").agg(F.sort_array(F.collect_list("w")).alias("rare"))
    units = staged(units.join(rare, "unit", "left").withColumn("rare", F.coalesce("rare", F.array().cast("array<string>"))), "units")

    givens = staged(units.where("kind = 'person'").select("unit", "name").mapInPandas(_givens, "unit bigint, given string, surname string, nick string"), "givens")
    nick = staged(nicknames(givens, alias), "nicknames")
    key = "unit bigint, kind string, key string"
    keys = units.where("kind <> 'other'").select("unit", "kind", "rare", "bag").mapInPandas(_keys, key)
    # A name also hangs on the common words that its own may be misspellings of.
    common = counts.where(F.col("n") > generic).select("kind", "w")
    near = common.mapInPandas(_near_keys, "kind string, w string, key string").withColumnRenamed("w", "word")
    told = units.where("kind <> 'other'").select("unit", "kind", "name", "rare", "bag").mapInPandas(_other_words, "unit bigint, kind string, w string, other string, nick string, short boolean, letters string")
    own = told.select("kind", "w").distinct().mapInPandas(_near_keys, "kind string, w string, key string")
    hung = staged(told.join(own.join(near, ["kind", "key"]).select("kind", "w", "word").distinct(), ["kind", "w"]), "common")
    by_pair = not hung.isEmpty()  # there are common words
    join_on = (F.col("x.kind") == F.col("y.kind")) & (F.col("x.key") == F.col("y.key"))
    if by_pair:
        met = staged(hung.mapInPandas(_pair_keys, f"{key}, side int"), "met")
        keys = keys.unionByName(met.where("side = 0").select("unit", "kind", "key"))
        keys = keys.unionByName(hung.join(nick, F.col("other") == F.col("s")).select("unit", "kind", F.concat_ws("|", "word", "f").alias("key")))
    pairs = keys.alias("x").join(keys.alias("y"), join_on & (F.col("x.unit") < F.col("y.unit"))).select(F.col("x.unit").alias("unit_a"), F.col("y.unit").alias("unit_b"))
    if by_pair:
        short = met.where("side = 1").alias("x").join(met.where("side = 2").alias("y"), join_on & (F.col("x.unit") != F.col("y.unit")))
        pairs = pairs.unionByName(short.select(F.least("x.unit", "y.unit").alias("unit_a"), F.greatest("x.unit", "y.unit").alias("unit_b")))
    pairs = pairs.distinct()
    side = lambda s: units.select(*[F.col(k).alias(f"{k}_{s}") for k in ("unit", "name", "freq", "rare")], *([F.col("kind")] if s == "a" else []))
    given = lambda s: givens.select(F.col("unit").alias(f"unit_{s}"), F.col("given").alias(f"given_{s}"))
    wide = pairs.join(side("a"), "unit_a").join(side("b"), "unit_b").join(given("a"), "unit_a", "left").join(given("b"), "unit_b", "left")
    wide = wide.join(nick.withColumn("nick", F.lit(True)), (F.col("given_a") == F.col("s")) & (F.col("given_b") == F.col("f")), "left").withColumn("nick", F.coalesce("nick", F.lit(False)))
    scored = wide.select("kind", "unit_a", "name_a", "freq_a", "rare_a", "unit_b", "name_b", "freq_b", "rare_b", "nick").mapInPandas(
        _score, "unit_a bigint, unit_b bigint, full_a int, full_b int, freq_a bigint, freq_b bigint, likelihood double")
    best = staged(attachments(staged(scored, "scored")), "attached")
    return parsed, member, best


def variant_links(nodes: DataFrame, mentions: DataFrame, alias: DataFrame, generic: int = GENERIC) -> DataFrame:
    """(node, form, weight): the representative node of each spelling that is attached to another, that of the form, and the log posterior weight.

    A spelling's representative is the least of its nodes.
    """
    return _linked(nodes, mentions, alias, generic)[2].select(F.col("unit").alias("node"), F.col("parent").alias("form"), "weight")


def variant_entities(nodes: DataFrame, mentions: DataFrame, alias: DataFrame, generic: int = GENERIC) -> DataFrame:
    """(node, entity): nodes that stand for the same entity share ``entity`` (the representative of its canonical form).

    See ``_linked`` for the tables and odd rows.
    """
    parsed, member, best = _linked(nodes, mentions, alias, generic)
    # Parents rank above their children, so there are no circles; each round halves what is left of every way up.
    up = best.select("unit", "parent")
    while True:
        step = up.alias("u").join(up.alias("v"), F.col("u.parent") == F.col("v.unit"), "left")
        step = staged(step.select(F.col("u.unit"), F.coalesce("v.parent", "u.parent").alias("parent"), F.col("v.parent").isNotNull().alias("moved")), "parents")
        up = step.select("unit", "parent")
        if step.where("moved").isEmpty():
            break
    tops = member.join(up, "unit", "left").select("kind", "norm", F.coalesce("parent", "unit").alias("top"))
    return parsed.join(tops, ["kind", "norm"]).select("node", F.col("top").alias("entity")).distinct()


def variant_pairs(entities: DataFrame) -> DataFrame:
    """(node_a, node_b) with node_a < node_b: all pairs of nodes with the same entity."""
    a = entities.select("entity", F.col("node").alias("node_a"))
    b = entities.select("entity", F.col("node").alias("node_b"))
    return a.join(b, "entity").where("node_a < node_b").select("node_a", "node_b")
