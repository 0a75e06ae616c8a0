"""The news pipeline's increment: new articles since the last one taken over, and mentions in their sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.functions.dates import publishing_date


def new_articles(extract: DataFrame, processed: DataFrame, default_date: str = "2000-01-01") -> DataFrame:
    """Articles extracted at or after the last processed one's time, whose url isn't processed yet.

    A url that comes several times is taken once, by its first extraction.
    """
    mark = processed.agg(F.max("extracttime")).first()[0]  # one value
    since = F.lit(mark) if mark is not None else F.to_timestamp(F.lit(default_date))
    fresh = extract.where((F.col("extracttime") >= since) & F.col("url").isNotNull()).join(processed.select("url").distinct(), "url", "left_anti")
    rest = [c for c in fresh.columns if c != "url"]
    return fresh.groupBy("url").agg(F.min(F.struct("extracttime", *[c for c in rest if c != "extracttime"])).alias("a")).select("url", *[f"a.{c}" for c in rest])


def with_publishing_date(articles: DataFrame, text: str = "date_text", crawltime: str = "crawltime") -> DataFrame:
    return articles.withColumn("publishing_date", publishing_date(F.col(text), F.col(crawltime)))


def sentence_mentions(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, sentence_index, mention): capitalised words of each sentence, as stand-ins for a recogniser's entities."""
    sents = F.posexplode(F.split(F.regexp_replace(text, "\\s+", " "), "(?<=[.!?])\\s+"))
    s = documents.select(F.col(doc_id).alias("doc_id"), sents.alias("sentence_index", "sentence"))
    words = F.regexp_extract_all("sentence", F.lit("\\b(\\p{Lu}\\p{Ll}{2,})"), F.lit(1))
    return s.select("doc_id", "sentence_index", F.explode(words).alias("mention"))
