"""Evaluation texts in training text, by suffix arrays of the training text.

Each task turns its documents into numbers of words (whole texts; words that no
evaluation text has are 0) and sorts the places in them by what follows: a
suffix array of a shard, built once.  Every suffix of every evaluation text is
looked up in it by binary search, which gives its longest verbatim match in the
shard, however long, and all places where it starts to match.  Places that share
a telling stretch with an evaluation text are then aligned with it, word by
word, so that a passage is found in spite of words that are misspelt, missing or
replaced.

Documents are read once and never shuffled.  Evaluation texts are sent to the
tasks in blocks of bounded size, all of which are held against each shard.  What
counts as telling is worked out over all evaluation texts beforehand, so the
result doesn't depend on blocks, shards or the order of rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words in a row that make a leak, and the share of the telling words in them that must be there.
WORDS, TELLING_SHARE = 12, 0.5
#: A verbatim stretch of so many words is looked into if it has a telling word, or if it has LONG_SEED words.
SEED, LONG_SEED = 2, 8
#: A word is telling if no more than one in 200 of the evaluation texts have it, and one may always.
TELLING = 1 / 200
#: Cost of a word that doesn't fit, against 1 for one that does; and the most of them in a passage, as a share of its words.
MISS, MOST_MISSES = 1.5, 0.25
#: The share of misses that a passage may have if one of them is its first or last word.
UNCONFIRMED = 1 / 8
#: Words put in or left out that an alignment follows.
BAND = 8
#: Misfits in a row over which an alignment's end moves outward, and the steps in doc and item that this gives.
GAP = 2
STEPS = [(di, dj) for di in range(1, GAP + 2) for dj in range(1, GAP + 2)]
#: Characters of evaluation text in a block; words of training text in a shard.
BLOCK_CHARS, SHARD_WORDS = 1_000_000, 2_000_000

# Letters that have no decomposition into a plain one and an accent.
_LETTERS = {"ø": "o", "ß": "ss", "æ": "ae", "œ": "oe", "ł": "l", "đ": "d"}
_ACCENTS = re.compile("[\u0300-\u036f]+")
_BROKEN, _BRACKETS, _WORD = re.compile(r"(\w)[-\u00ad\u2010]\s*\n\s*(?=\w)"), re.compile(r"\([^()]*\)|\[[^\[\]]*\]"), re.compile(r"[^\W_]+")


def plain_words(text: str | None) -> list[str]:
    """Words without case, accents and punctuation, hyphens at line ends undone, bracketed parts left out."""
    if not text:
        return []
    text = _BROKEN.sub(r"\1", text)
    if "(" in text or "[" in text:
        text = _BRACKETS.sub(" ", text)
    text = text.lower()
    if not text.isascii():
        for a, b in _LETTERS.items():
            if a in text:
                text = text.replace(a, b)
        text = _ACCENTS.sub("", unicodedata.normalize("NFD", text))
    return _WORD.findall(text)


@lru_cache(maxsize=1 << 18)
def near(a: str, b: str) -> bool:
    """Whether one word may be a misspelling of the other; numbers may not."""
    if a == b:
        return True
    if a.isdigit() or b.isdigit() or abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 4:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """Places of the known words in ``words``, sorted by the ``depth`` words from there on at least; by doubling of ranks."""
    n = len(words)
    rank = words.astype(np.int64)
    k, different = 1, 0
    while k < depth and n:
        after = np.zeros(n, dtype=np.int64)
        after[: n - k] = rank[k:] + 1 if k < n else 0
        key = rank * (int(after.max()) + 1) + after
        order = np.argsort(key)
        ranks = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
        rank = np.empty(n, dtype=np.int64)
        rank[order] = ranks
        k *= 2
        if ranks[-1] == n - 1 or ranks[-1] == different:  # all are told apart, or nothing more ever will be
            break
        different = ranks[-1]
    places = np.flatnonzero(words > 0)
    return places[np.argsort(rank[places])]


#: Words compared at a time.
_STEP = 32


def common_length(words: np.ndarray, at: np.ndarray, flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """How many words from each place ``at`` are those of ``flat`` from ``start`` on, up to ``length``.

    Both arrays end in a word that is none of the other's.
    """
    out = np.zeros(len(at), dtype=np.int64)
    rows, off, steps = np.arange(len(at)), 0, np.arange(_STEP)
    while len(rows):
        a = words[np.minimum(at[rows][:, None] + off + steps, len(words) - 1)]
        b = flat[np.minimum(start[rows][:, None] + off + steps, len(flat) - 1)]
        differ = (a != b) | (off + steps >= length[rows][:, None])
        first = np.argmax(differ, axis=1)
        ended = differ[np.arange(len(rows)), first]
        out[rows] += np.where(ended, first, _STEP)
        rows, off = rows[~ended], off + _STEP
    return out


def look_up(words: np.ndarray, array: np.ndarray, flat: np.ndarray, start: np.ndarray, length: np.ndarray, upper: bool) -> np.ndarray:
    """Where the words of ``flat`` from each ``start`` belong in the suffix array: before or (``upper``) after the places that begin with them."""
    lo, hi = np.zeros(len(start), np.int64), np.full(len(start), len(array), np.int64)
    while (rows := np.flatnonzero(lo < hi)).size:
        mid = (lo[rows] + hi[rows]) // 2
        same = common_length(words, array[mid], flat, start[rows], length[rows])
        there, own = words[np.minimum(array[mid] + same, len(words) - 1)], flat[np.minimum(start[rows] + same, len(flat) - 1)]
        go_on = np.where(same == length[rows], upper, there < own)
        lo[rows] = np.where(go_on, mid + 1, lo[rows])
        hi[rows] = np.where(go_on, hi[rows], mid)
    return lo


def longest_matches(words: np.ndarray, array: np.ndarray, flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Length of the longest verbatim match of each suffix in the shard: with one of its two neighbours."""
    at = look_up(words, array, flat, start, length, False)
    best = np.zeros(len(start), np.int64)
    for side in (at - 1, at):
        ok = np.flatnonzero((side >= 0) & (side < len(array)))
        best[ok] = np.maximum(best[ok], common_length(words, array[side[ok]], flat, start[ok], length[ok]))
    return best


def align(doc: list[str], item: list[str], shift: int, telling: set[str]) -> list[tuple[int, float, float]]:
    """(words of the item covered, share of its telling words found, misses per word) of the best local alignment near a diagonal.

    ``shift`` is the place in doc less the place in item of the seed.  The first
    is the alignment itself; those after it reach further, see ``outward``.
    """
    best, end = (0.0, 0, 0, 0, 0), (-1, -1)
    above: dict[int, tuple] = {}
    for j in range(len(item)):
        row: dict[int, tuple] = {}
        for i in range(max(0, j + shift - BAND), min(len(doc), j + shift + BAND + 1)):
            same = doc[i] == item[j] or near(doc[i], item[j])
            # score, start in item, telling words found, misses (negated), start in doc
            a = above.get(i - 1)
            options = []
            if same:
                hit = 1 if item[j] in telling else 0
                options.append((a[0] + 1, a[1], a[2] + hit, a[3], a[4]) if a and a[0] > 0 else (1.0, j, hit, 0, i))
            elif a and a[0] > MISS:
                options.append((a[0] - MISS, a[1], a[2], a[3] - 1, a[4]))
            for b in (above.get(i), row.get(i - 1)):
                if b and b[0] > MISS:
                    options.append((b[0] - MISS, b[1], b[2], b[3] - 1, b[4]))
            if options:
                row[i] = x = max(options)
                if same and x[0] > best[0]:
                    best, end = x, (i, j)
        above = row
    if end[1] < 0:
        return []
    return outward(doc, item, (best[4], best[1]), end, best[2], -best[3], telling)


def outward(doc: list[str], item: list[str], start: tuple, end: tuple, hits: int, misses: int, telling: set[str]) -> list[tuple[int, float, float]]:
    """The alignment from ``start`` to ``end`` (places in doc and item), and what it becomes as its ends move outward.

    A score cuts off a misfit that few matches follow, though the passage goes
    on there.  So each end moves over up to GAP misfits to further matches, as
    long as MOST_MISSES allows.  Last, the word next to an end may stand for
    one that was replaced; nothing beyond confirms it, so then no more than
    UNCONFIRMED of all words may be misses.
    """
    ends = {-1: start, 1: end}
    out = []

    def note() -> None:
        span = item[ends[-1][1] : ends[1][1] + 1]
        there = sum(w in telling for w in span)
        out.append((len(span), hits / there if there else 1.0, misses / len(span)))

    def fits(i: int, j: int) -> bool:
        return 0 <= i < len(doc) and 0 <= j < len(item) and (doc[i] == item[j] or near(doc[i], item[j]))

    note()
    for step in (-1, 1):
        while True:
            i, j = ends[step]
            ways = []
            for di, dj in STEPS:
                n = 0
                while fits(i + step * (di + n), j + step * (dj + n)):
                    n += 1
                if n:
                    missed = max(di, dj) - 1
                    ways.append((n - MISS * missed, -missed, n, di + n - 1, dj + n - 1))
            if not ways:
                break
            _, missed, n, di, dj = max(ways)
            size = ends[1][1] - ends[-1][1] + 1 + dj
            if misses - missed > MOST_MISSES * size:
                break
            misses -= missed
            ends[step] = i + step * di, j + step * dj
            hits += sum(item[ends[step][1] - step * k] in telling for k in range(n))
            note()
    for step in (-1, 1):
        i, j = ends[step][0] + step, ends[step][1] + step
        if 0 <= i < len(doc) and 0 <= j < len(item) and misses + 1 <= UNCONFIRMED * (ends[1][1] - ends[-1][1] + 2):
            misses += 1
            ends[step] = i, j
            note()
    return out


def _long_texts(rows: list[tuple]) -> Iterator[tuple]:
    """(item, words) of the parts of evaluation rows that are long enough to hold a passage."""
    for item, *parts in rows:
        for part in parts:
            w = plain_words(part)
            if len(w) >= WORDS:
                yield item, w


class Items:
    """A block of evaluation texts as numbers of words; ``common`` are the words that tell nothing."""

    def __init__(self, rows: list[tuple], number: dict[str, int], common: frozenset):
        self.texts, self.owner = [], []
        for item, w in _long_texts(rows):
            self.owner.append(item)
            self.texts.append(w)
        self.telling = {x for w in self.texts for x in w} - common
        self.coded = [np.array([number[x] for x in w], dtype=np.int32) for w in self.texts]
        self.flat = np.concatenate([*self.coded, np.full(1, -1, dtype=np.int32)])
        sizes = [len(w) for w in self.texts]
        ends = np.cumsum(sizes) if sizes else np.zeros(0, np.int64)
        self.start = np.arange(int(sum(sizes)))
        self.text_of = np.repeat(np.arange(len(sizes)), sizes)
        self.place = self.start - np.repeat(ends - sizes, sizes)
        self.length = np.repeat(ends, sizes) - self.start
        tells = np.array([x in self.telling for w in self.texts for x in w], dtype=bool)
        self.seeded = np.zeros(len(tells), dtype=bool)
        for k in range(SEED):
            self.seeded[: len(tells) - k] |= tells[k:]
        self.seeded &= self.length >= SEED


class Shard:
    """Documents of a shard, and the suffix array of their words."""

    def __init__(self, docs: list[tuple], number: dict[str, int], depth: int):
        self.docs, parts, begins, at = docs, [], [], 0
        for _, w in docs:
            begins.append(at)
            parts.append(np.fromiter(map(number.get, w, repeat(0)), dtype=np.int32, count=len(w)))
            parts.append(np.zeros(1, dtype=np.int32))  # nothing matches across documents
            at += len(w) + 1
        self.words, self.begins = np.concatenate(parts), np.array(begins)
        self.array = suffix_array(self.words, depth)


def _shards(batches: Iterator[pd.DataFrame], doc: str, text: str):
    """Documents in lists of about SHARD_WORDS words; shorter ones than half a passage can't hold one, as MOST_MISSES of its words may miss."""
    docs, size = [], 0
    for b in batches:
        for d, t in zip(b[doc], b[text]):
            w = plain_words(t)
            if len(w) < WORDS // 2:
                continue
            docs.append((d, w))
            size += len(w)
            if size >= SHARD_WORDS:
                yield docs
                docs, size = [], 0
    if docs:
        yield docs


def _verbatim(doc: np.ndarray, item: np.ndarray, shifts: set[int]) -> tuple[int, int, int]:
    """(length, place in doc, place in item) of the longest stretch that is the same in both, on these diagonals."""
    best = (0, 0, 0)
    for shift in sorted(shifts):
        j0, j1 = max(0, -shift), min(len(item), len(doc) - shift)
        same = np.concatenate(([False], doc[j0 + shift : j1 + shift] == item[j0:j1], [False]))
        turns = np.flatnonzero(same[1:] != same[:-1])
        if len(turns):
            runs = turns[1::2] - turns[::2]
            k = int(np.argmax(runs))
            if runs[k] > best[0]:
                best = (int(runs[k]), int(turns[2 * k]) + j0 + shift, int(turns[2 * k]) + j0)
    return best


def _search(shard: Shard, items: Items) -> list[tuple]:
    words, array = shard.words, shard.array
    if not len(array) or not len(items.start):
        return []
    longest = longest_matches(words, array, items.flat, items.start, items.length)
    # A seed is the first SEED words of a suffix, or the first LONG_SEED; the rest may be anything.
    seeds: dict[tuple, set] = {}
    for size, rows in ((SEED, np.flatnonzero(items.seeded & (longest >= SEED))), (LONG_SEED, np.flatnonzero(longest >= LONG_SEED))):
        if not len(rows):
            continue
        length = np.full(len(rows), size)
        lo, hi = (look_up(words, array, items.flat, rows, length, upper) for upper in (False, True))
        for r, a, b in zip(rows, lo, hi):
            t, j, places = int(items.text_of[r]), int(items.place[r]), array[a:b]
            of_doc = np.searchsorted(shard.begins, places, side="right") - 1
            for d, shift in zip(of_doc.tolist(), (places - shard.begins[of_doc] - j).tolist()):
                seeds.setdefault((d, t), set()).add(shift)
    found = []
    for (d, t), shifts in seeds.items():
        doc, w = shard.docs[d][1], items.texts[t]
        best = (0, 0.0, 0.0)
        # Seeds of one alignment are near the same diagonal.
        for k in sorted({shift // (BAND // 2) for shift in shifts}):
            for got in align(doc, w, k * (BAND // 2) + BAND // 4, items.telling):
                if got[0] >= WORDS and got[1] >= TELLING_SHARE and got[2] <= MOST_MISSES:
                    best = max(best, got)
        if best[0] >= WORDS:
            coded = words[shard.begins[d] : shard.begins[d] + len(doc)]
            found.append((shard.docs[d][0], items.owner[t], best[0], best[1], *_verbatim(coded, items.coded[t], shifts)))
    return found


def leaks(documents: DataFrame, doc: str, text: str, evaluation: DataFrame, item: str, parts: list[str]) -> DataFrame:
    """(doc, item_id, n_words, telling_share, verbatim, doc_word, item_word) of each document that holds a passage of an evaluation text.

    A passage is WORDS words or more in a row of one of ``parts``, in which at
    least TELLING_SHARE of the telling words (those of few evaluation texts:
    names, numbers) are found, and no more than MOST_MISSES of the words are
    missing, replaced or put in; a misspelt word is no miss.  ``verbatim`` is
    the length of the longest stretch that is the same word for word, and the
    words (from 0) at which it starts in the document and in the part.
    Evaluation texts shorter than that have no passage.  Null and empty texts
    match nothing; repeated documents and items give repeated ids once; an
    empty table on either side gives no rows.
    """
    spark = documents.sparkSession
    kind, item_kind = documents.schema[doc].dataType.simpleString(), evaluation.schema[item].dataType.simpleString()
    schema = f"`{doc}` {kind}, item_id {item_kind}, n_words int, telling_share double, verbatim int, doc_word int, item_word int"
    known = evaluation.select(item, *parts).where(F.col(item).isNotNull())
    common = _common_words(known)
    blocks = [spark.sparkContext.broadcast(rows) for rows in _blocks(known)]
    if not blocks:
        return spark.createDataFrame([], schema)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number: dict[str, int] = {}
        depth, made = 1, None
        for b in blocks:
            for _, w in _long_texts(b.value):
                depth = max(depth, len(w))
                for x in w:
                    number.setdefault(x, len(number) + 1)
        for docs in _shards(batches, doc, text):
            shard = Shard(docs, number, depth)
            for b in blocks:
                items = made if made is not None else Items(b.value, number, common)
                made = items if len(blocks) == 1 else None
                yield pd.DataFrame(_search(shard, items), columns=[doc, "item_id", "n_words", "telling_share", "verbatim", "doc_word", "item_word"])

    out = documents.select(doc, text).where(F.col(text).isNotNull()).mapInPandas(find, schema)
    best = F.max(F.struct("n_words", "telling_share")).alias("best"), F.max(F.struct("verbatim", F.negative("doc_word").alias("d"), F.negative("item_word").alias("i"))).alias("where")
    return out.groupBy(doc, "item_id").agg(*best).select(doc, "item_id", "best.*", "where.verbatim", F.negative("where.d").alias("doc_word"), F.negative("where.i").alias("item_word"))


def _common_words(evaluation: DataFrame) -> frozenset:
    """Words that more than TELLING of all evaluation texts have: at most 1 / TELLING times the words of a text."""

    def of_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for _, w in _long_texts(list(b.itertuples(index=False, name=None))):
                yield pd.DataFrame({"word": ["", *sorted(set(w))]})  # the empty word counts the texts

    counts = evaluation.mapInPandas(of_texts, "word string").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    total = F.max(F.when(F.col("word") == "", F.col("n")))
    texts = counts.agg(total).first()[0] or 0
    return frozenset(r["word"] for r in counts.where((F.col("word") != "") & (F.col("n") > max(1, texts * TELLING))).collect())


def _blocks(evaluation: DataFrame) -> Iterator[list[tuple]]:
    """Evaluation rows in blocks of at most BLOCK_CHARS characters (and one row)."""
    rows, size = [], 0
    for r in evaluation.toLocalIterator():
        n = sum(len(x or "") for x in r[1:])
        if rows and size + n > BLOCK_CHARS:
            yield rows
            rows, size = [], 0
        rows.append(tuple(r))
        size += n
    if rows:
        yield rows


def without_leaks(documents: DataFrame, doc: str, found: DataFrame) -> DataFrame:
    """The documents in which nothing was found."""
    return documents.join(found.select(doc).distinct(), doc, "left_anti")
