"""Languages of documents and passages, by bit-sliced Bloom filters of n-grams.

For each language there is a Bloom filter of the n-grams that are usual in it.
The filters lie side by side: each position holds one bit per language, so the
AND over an n-gram's positions gives all languages that have it at once.  A
sentence is given the language with the most of its n-grams, after the hits
that a filter of this fill gives by chance are taken off, or none if even that
language has too few of them.

The languages are those of the labels, and the filters are fitted on a bounded
sample of labelled documents; some labels are wrong, so an n-gram counts for a
language only where its rate there is near its highest rate anywhere.
Everything else covers all documents and whole texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Documents of each language that the filters are fitted on, about: the bound of the sample; and the fewest that a language needs to be learnt.
SAMPLE, LEAST_DOCS = 1500, 20
#: Positions of a filter, and positions of one n-gram in it.
POSITIONS, HASHES = 1 << 20, 4
#: Languages that fit side by side.
MOST_LANGUAGES = 63
#: An n-gram is usual in a language if at least this share of its documents have it,
#: and this part of the share in the language that has it most.
LEAST_SHARE, NEAR_BEST = 0.004, 0.3
#: Words of a sentence that counts by itself; shorter ones count with the rest of their piece.
SENTENCE_WORDS = 4
#: A text is in no known language if the best one has less than COVER of its n-grams, or leads the second by less than LEAD of them.
COVER, LEAD = 0.35, 0.02
#: Letters of the n-grams within a word, which is padded by one blank on both sides.
LETTERS = 4

# Codes and names in use for each language, without case.
LABELS = {
    "cs": "cs ces cze czech čeština tschechisch", "da": "da dan danish dansk dänisch", "de": "de deu ger german deutsch", "el": "el ell gre greek ελληνικά griechisch",
    "en": "en eng english englisch", "es": "es spa spanish español espanol castellano spanisch", "fi": "fi fin finnish suomi finnisch",
    "fr": "fr fra fre french français francais französisch", "hu": "hu hun hungarian magyar ungarisch", "it": "it ita italian italiano italienisch",
    "nl": "nl nld dut dutch nederlands flemish niederländisch", "no": "no nor nb nob nn nno norwegian norsk norwegisch", "pl": "pl pol polish polski polnisch",
    "pt": "pt por portuguese português portugues portugiesisch", "ro": "ro ron rum romanian română rumänisch", "sv": "sv swe swedish svenska schwedisch", "tr": "tr tur turkish türkçe türkisch",
}


def label_code(label: Column) -> Column:
    """Two-letter code of a label in any usual writing: a known code or name, or any code of two letters; null for null, '', 'und' and others."""
    base = F.lower(F.trim(F.element_at(F.split(label, "[-_]"), 1)))
    return F.coalesce(*[F.when(base.isin(v.split()), F.lit(k)) for k, v in LABELS.items()], F.when(base.rlike("^[a-z]{2}$"), base))


def pieces(text: str) -> list[str]:
    """The pieces of a text between empty lines."""
    return re.split(r"\n[^\S\n]*\n\s*", text.replace("\r\n", "\n"))


def sentences(piece: str, brackets: bool = False) -> list[list[str]]:
    """Words of each sentence, without what is in brackets (unless asked for); broken lines and words are joined."""
    piece = re.sub(r"(\w)[-\u00ad\u2010]\s*\n\s*(?=\w)", r"\1", piece)
    if not brackets:
        piece = re.sub(r"\([^()]*\)|\[[^\[\]]*\]", " ", piece)
    return [re.findall(r"[^\W_]+", s.lower()) for s in re.split(r"[.!?…]+(?=\s|$)|[¡¿]", piece)]


def grams(word: str) -> list[str]:
    """The word itself, and its n-grams of letters."""
    p = f" {word} "
    return [f"={word}", *{p[i : i + LETTERS] for i in range(max(1, len(p) - LETTERS + 1))}]


def _positions(gram: str) -> list[int]:
    h = xxhash.xxh3_128_intdigest(gram)
    a, b = h & 0xFFFFFFFFFFFFFFFF, (h >> 64) | 1
    return [((a + k * b) & 0xFFFFFFFFFFFFFFFF) % POSITIONS for k in range(HASHES)]


class Filters:
    """The bit-sliced filters; of fixed size, whatever they are fitted on."""

    def __init__(self, languages: list[str], positions: np.ndarray, bits: np.ndarray):
        """``bits`` of the ``languages`` at some of the positions, 0 at all others."""
        self.languages = list(languages)
        self.slices = np.zeros(POSITIONS, dtype=np.int64)
        self.slices[positions] = bits
        self.shifts = np.arange(len(languages))
        fill = np.array([np.count_nonzero(self.slices >> k & 1) / POSITIONS for k in self.shifts])
        self.by_chance = fill**HASHES
        self.cache: dict[str, np.ndarray] = {}

    def bits(self, gram: str) -> int:
        """All languages that have the n-gram."""
        return int(np.bitwise_and.reduce(self.slices[_positions(gram)]))

    def word(self, word: str) -> np.ndarray:
        """Per language the n-grams of a word that it has, less those by chance; at the end how many there are."""
        if word.isdigit():
            return np.zeros(len(self.languages) + 1)
        at = np.array([_positions(g) for g in grams(word)])
        bits = np.bitwise_and.reduce(self.slices[at], axis=1)
        hits = (bits[:, None] >> self.shifts & 1).sum(axis=0)
        return np.append((hits - len(at) * self.by_chance) / np.maximum(1 - self.by_chance, 1e-9), len(at))

    def scores(self, sents: list[list[str]]) -> np.ndarray:
        """One row for each sentence: per language its hits; at the end its n-grams."""
        flat, starts = [], []
        for s in sents:
            starts.append(len(flat))
            flat += s or ["0"]
        if not flat:
            return np.zeros((0, len(self.languages) + 1))
        if len(self.cache) > 400_000:
            self.cache.clear()
        number = {w: k for k, w in enumerate(dict.fromkeys(flat))}
        table = np.empty((len(number), len(self.languages) + 1))
        for w, k in number.items():
            v = self.cache.get(w)
            if v is None:
                v = self.cache[w] = self.word(w)
            table[k] = v
        return np.add.reduceat(table[[number[w] for w in flat]], starts, axis=0)


def decide(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best language of each row, or -1 for none, and its confidence: the lead over the second, as a share of the n-grams."""
    s, n = scores[:, :-1], np.maximum(scores[:, -1], 1)
    if not s.shape[1]:
        return np.full(len(s), -1), np.zeros(len(s))
    s = np.hstack((s, np.zeros((len(s), 1))))  # a second one, where only one language is known
    order = np.argsort(-s, axis=1, kind="stable")
    at = np.arange(len(s))
    first, second = s[at, order[:, 0]], s[at, order[:, 1]]
    lead = np.clip((first - np.maximum(second, 0)) / n, 0, 1)
    known = (first >= COVER * n) & (lead >= LEAD) & (first > 0) & (order[:, 0] < s.shape[1] - 1)
    return np.where(known, order[:, 0], -1), np.where(known, lead, 0.0)


def fit(documents: DataFrame, doc: str, text: str, label: str, sample: int = SAMPLE) -> Filters:
    """Filters of the languages of the labels, from about ``sample`` labelled documents of each, chosen by a hash of their id.

    Languages with fewer than LEAST_DOCS labelled documents can't be learnt and
    are none.  The filters are put together by the tasks; the driver sees one
    number for each position in use, of POSITIONS at most.
    """
    labelled = documents.select(F.col(doc).alias("doc"), F.col(text).alias("text"), label_code(F.col(label)).alias("lang")).where("lang is not null and text is not null")
    counted = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per code of two letters
    sizes = {k: n for k, n in sorted(counted.items()) if n >= LEAST_DOCS}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not sizes:
        return Filters([], np.zeros(0, np.int64), np.zeros(0, np.int64))
    names = list(sizes)
    unit = F.pmod(F.xxhash64("doc"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, sample / n))) for k, n in sizes.items()], F.lit(0.0))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of_word: dict[str, list[str]] = {}
        for b in batches:
            count: Counter = Counter()
            for lang, t in zip(b.lang, b.text):
                words = {w for p in pieces(t) for s in sentences(p) for w in s if not w.isdigit()}
                if len(of_word) > 400_000:
                    of_word.clear()
                for w in words:
                    if w not in of_word:
                        of_word[w] = grams(w)
                count.update((lang, g) for g in {g for w in words for g in of_word[w]})
            yield pd.DataFrame([(*k, n) for k, n in count.items()], columns=["lang", "gram", "n"])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, bits) for gram, bits in zip(b.gram, b.bits) for p in _positions(gram)]
            yield pd.DataFrame(rows, columns=["position", "bits"])

    chosen = labelled.where(unit < share)
    counts = chosen.select("lang", "text").mapInPandas(split, "lang string, gram string, n bigint").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    of_lang = lambda values, kind: F.coalesce(*[F.when(F.col("lang") == k, F.lit(v)) for k, v in zip(names, values)]).cast(kind)
    rate = F.col("n") / of_lang([max(1.0, min(sizes[k], sample)) for k in names], "double")
    rates = counts.select("gram", rate.alias("rate"), of_lang([1 << i for i in range(len(names))], "bigint").alias("bit"))
    kept = rates.groupBy("gram").agg(F.collect_list(F.struct("rate", "bit")).alias("by"), F.max("rate").alias("most")).where(F.col("most") >= LEAST_SHARE)  # a row per language each
    near = F.filter("by", lambda x: (x["rate"] >= LEAST_SHARE) & (x["rate"] >= NEAR_BEST * F.col("most")))
    bits = kept.select("gram", F.aggregate(near, F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(x["bit"])).alias("bits"))
    got = bits.mapInPandas(place, "position int, bits bigint").groupBy("position").agg(F.bit_or("bits").alias("bits")).toArrow()
    return Filters(names, got["position"].to_numpy(), got["bits"].to_numpy())


def languages(documents: DataFrame, doc: str, text: str, filters: Filters) -> DataFrame:
    """(doc, para_no, lang, n_sentences, confidence, doc_lang, doc_confidence): the languages of each piece of each document.

    A language is in a piece if a whole sentence of SENTENCE_WORDS words or more
    outside brackets is in it; its confidence is the mean lead over the second
    language in its sentences.  A piece without such a sentence has one row with
    the language of all its words (those in brackets, if there are no others),
    and n_sentences 0.  ``doc_lang`` is the language of most n-grams of the
    document.  A language is null, and its confidence 0, where the text is in
    none that is known: so for null and empty texts, of which para_no is 0.
    Repeated ids are taken one by one.
    """
    spark = documents.sparkSession
    sent = spark.sparkContext.broadcast(filters)
    kind = documents.schema[doc].dataType.simpleString()

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = sent.value
        names = np.array([*f.languages, None], dtype=object)
        for b in batches:
            ids, sents, long_, piece_at, piece_no, doc_at = b[doc].tolist(), [], [], [], [], []
            for t in b[text]:
                doc_at.append(len(piece_at))
                for p, piece in enumerate(pieces(t or "")):
                    got = [s for s in sentences(piece) if s]
                    alone = bool(got)
                    if not got:
                        got = [[w for s in sentences(piece, True) for w in s]]
                    piece_at.append(len(sents))
                    piece_no.append(p)
                    sents += got
                    long_ += [alone and len(s) >= SENTENCE_WORDS for s in got]
            if not ids:
                continue
            scores = f.scores(sents)
            best, lead = decide(scores)
            of_piece = np.repeat(np.arange(len(piece_at)), np.diff([*piece_at, len(sents)]))
            by_piece = np.add.reduceat(scores, piece_at, axis=0)
            by_doc = np.add.reduceat(by_piece, doc_at, axis=0)
            row_of = np.repeat(np.arange(len(ids)), np.diff([*doc_at, len(piece_at)]))
            told = np.array(long_) & (best >= 0)
            x = pd.DataFrame({"piece": of_piece[told], "best": best[told], "lead": lead[told]})
            y = x.groupby(["piece", "best"], as_index=False).agg(n_sentences=("lead", "size"), confidence=("lead", "mean"))
            rest = np.setdiff1d(np.arange(len(piece_at)), y.piece.to_numpy())
            best_piece, lead_piece = decide(by_piece[rest])
            y = pd.concat([y, pd.DataFrame({"piece": rest, "best": best_piece, "n_sentences": 0, "confidence": lead_piece})])
            piece = y.piece.to_numpy().astype(int)
            row = row_of[piece]
            best_doc, lead_doc = decide(by_doc)
            yield pd.DataFrame({
                doc: pd.Series([ids[r] for r in row], dtype=b[doc].dtype), "para_no": np.array(piece_no)[piece], "lang": names[y.best.to_numpy().astype(int)], "n_sentences": y.n_sentences.to_numpy().astype(int),
                "confidence": y.confidence.to_numpy(), "doc_lang": names[best_doc[row]], "doc_confidence": lead_doc[row],
            })

    schema = f"`{doc}` {kind}, para_no int, lang string, n_sentences int, confidence double, doc_lang string, doc_confidence double"
    return documents.select(doc, text).mapInPandas(assign, schema)
