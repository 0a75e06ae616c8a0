"""Mixing sources to target weights, measured in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import importlib.util
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.plans.runtime import staged

#: File of the vocabulary, in the folder of tokenizers.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Where the folder of tokenizers is; a parameter of every function below.
FOLDER = "/opt/tokenizers"
#: Longer texts are split at this many characters before they are encoded, at a blank where there is one.
PIECE = 50_000


def tokenizer(folder: str = FOLDER, vocabulary: str = VOCABULARY):
    """The tokenizer whose ranks are in a file; the pattern comes with the files."""
    import tiktoken

    spec = importlib.util.spec_from_file_location("public_tokenizers_at", Path(folder) / "__init__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    lines = (Path(folder) / vocabulary).read_bytes().split(b"\n")
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
    return tiktoken.Encoding("own", pat_str=module.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _pieces(text: str) -> Iterator[str]:
    while len(text) > PIECE:
        cut = text.rfind(" ", PIECE // 2, PIECE)
        cut = cut if cut > 0 else PIECE
        yield text[:cut]
        text = text[cut:]
    yield text


def token_counts(df: DataFrame, text: str, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """Add ``n_tokens`` in place of the text; null and empty texts have 0.  Whole texts are encoded."""
    rest = [c for c in df.columns if c != text]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != text)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = tokenizer(folder, vocabulary)
        for b in batches:
            out = b[rest].copy()
            out["n_tokens"] = [sum(len(enc.encode_ordinary(p)) for p in _pieces(t)) if t else 0 for t in b[text]]
            yield out

    return df.select(*rest, text).mapInPandas(count, f"{schema}, n_tokens bigint")


def rates(sized: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """(source, target_share, max_repeats, n_docs, tokens, rate) of each target.

    ``rate`` is how often a document of the source is to be used for a mix of
    ``total`` tokens (all tokens of the sources with a target, unless given), at
    most max_repeats.  Shares are taken relative to their sum.  A source without
    tokens has rate 0; sources without a target, and null ones, take no part; a
    null share or limit is 0; of repeated targets the greatest counts.
    """
    t = targets.where("source is not null").groupBy("source").agg(F.max(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(0))).alias("max_repeats"))
    size = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("tokens"))
    j = t.join(size, "source", "left").withColumns({"n_docs": F.coalesce("n_docs", F.lit(0)), "tokens": F.coalesce("tokens", F.lit(0))})
    whole = j.agg(F.sum("tokens").alias("tokens"), F.sum("target_share").alias("shares")).first()  # two numbers
    wanted = F.col("target_share") * F.lit(float(total if total is not None else whole["tokens"] or 0) / (whole["shares"] or 1.0))
    rate = F.when(F.col("tokens") > 0, F.least(wanted / F.nullif("tokens", F.lit(0)), F.col("max_repeats").cast("double"))).otherwise(0.0)
    return j.select("source", "target_share", "max_repeats", "n_docs", "tokens", rate.alias("rate"))


def mix(sized: DataFrame, by_rate: DataFrame, doc: str, seed: int = 0) -> DataFrame:
    """One row per copy: the columns of ``sized`` and copy_no, from 1.

    A document is emitted floor(rate) times, and once more if a hash of its id
    and the seed, as a number in [0, 1), is below the fraction of the rate: the
    same documents in each run.  The rates are one row per source with a target;
    Spark sends them to the documents, which are not shuffled.
    """
    unit = F.pmod(F.xxhash64(F.col(doc), F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    whole = F.floor("rate")
    copies = (whole + F.when(unit < F.col("rate") - whole, 1).otherwise(0)).cast("int")
    r = by_rate.where("rate > 0").select("source", "rate")
    m = sized.where("source is not null").join(r, "source").withColumn("copies", copies).where("copies > 0")
    return m.select(*sized.columns, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_no"))


def reached(mixed: DataFrame, by_rate: DataFrame) -> DataFrame:
    """``by_rate`` with mixed_tokens and reached_share of each source."""
    m = mixed.groupBy("source").agg(F.sum("n_tokens").alias("mixed_tokens"))
    j = by_rate.join(m, "source", "left").withColumn("mixed_tokens", F.coalesce("mixed_tokens", F.lit(0)))
    whole = j.agg(F.sum("mixed_tokens")).first()[0] or 1
    return j.withColumn("reached_share", F.col("mixed_tokens") / F.lit(float(whole)))


def sized_documents(documents: DataFrame, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens), encoded once and written down for the two passes that need it."""
    return staged(token_counts(documents.select("doc_id", "source", "text"), "text", folder, vocabulary), "tokens")
