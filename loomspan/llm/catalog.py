"""Named queries of the subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm import languages, leaks, mixing, names, terms, together
from loomspan.plans.runtime import staged
from loomspan.sources.tables import table


def _entities(spark: SparkSession, folder: str) -> DataFrame:
    return names.variant_entities(table(spark, folder, "node"), table(spark, folder, "entity").select("entity_name", "entity_type"), table(spark, folder, "name_alias"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs of nodes that stand for the same entity."""
    return names.variant_pairs(_entities(spark, folder))


def p2_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Entity of each node."""
    return _entities(spark, folder)


def p2_links(spark: SparkSession, folder: str) -> DataFrame:
    """The form that each spelling is attached to, by their representative nodes; p2_entities has the membership."""
    out = names.variant_links(table(spark, folder, "node"), table(spark, folder, "entity").select("entity_name", "entity_type"), table(spark, folder, "name_alias"))
    return out.withColumn("weight", F.round("weight", 6))


# ---- p3: items that appear together ------------------------------------------
SENTENCE = ["article_id", "sentence_index"]


def _linked(t: together.PairTable) -> DataFrame:
    # c * n >= 20 * a * b, in decimals: whole numbers without overflow.
    d = lambda c: F.col(c).cast("decimal(19,0)")
    return t.scores(least=5).where(d("c") * d("n") >= d("n_a") * d("n_b") * 20)


def _updated(spark: SparkSession, folder: str, least: int = 1, lift: float = 0.0) -> together.PairTable:
    """The pair table of all sentences, after an update.

    The table is first built from the rows with an entity_type; then the
    sentences that have names only in rows without one change to their full
    contents, by signed deltas.
    """
    e = table(spark, folder, "entity")
    known = e.where("article_id is not null and sentence_index is not null and entity_name is not null")
    cells = known.groupBy(F.col("article_id").alias("k0"), F.col("sentence_index").alias("k1"), F.col("entity_name").alias("item")).agg(F.max(F.col("entity_type").isNotNull()).alias("typed"))
    cells = staged(cells, "cells")
    before, every = cells.where("typed").drop("typed"), cells.drop("typed")
    t = together.PairTable(spark, least=least, lift=lift)
    t.apply(None, before, stored=True)
    changed = cells.where("not typed").select("k0", "k1").distinct()
    t.apply(before.join(changed, ["k0", "k1"], "left_semi"), every.join(changed, ["k0", "k1"], "left_semi"), every)
    return t


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Names in at least 5 sentences together, and 20 times as often as by chance."""
    return _linked(_updated(spark, folder, least=5, lift=20)).select(F.col("a").alias("name_a"), F.col("b").alias("name_b"))


def p3_pairs_updated(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs with their association."""
    return _updated(spark, folder).scores().select(F.col("a").alias("name_a"), F.col("b").alias("name_b"), "c", "n_a", "n_b", "n", F.round("lift", 6).alias("lift"))


P3_BASE = """
WITH b AS (SELECT DISTINCT article_id, sentence_index, entity_name FROM entity WHERE article_id IS NOT NULL AND sentence_index IS NOT NULL AND entity_name IS NOT NULL),
s AS (SELECT count(*) AS n FROM (SELECT DISTINCT article_id, sentence_index FROM b)),
m AS (SELECT entity_name, count(*) AS n FROM b GROUP BY 1),
p AS (SELECT x.entity_name AS name_a, y.entity_name AS name_b, count(*) AS c FROM b x JOIN b y USING (article_id, sentence_index) WHERE x.entity_name < y.entity_name GROUP BY 1, 2)
"""


# ---- p5: frequency of every distinct value -----------------------------------
def _frequencies(spark: SparkSession, folder: str) -> DataFrame:
    return terms.term_frequencies(table(spark, folder, "entity"), ["entity_name", "entity_type"], "article_id")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Values in too few or too many articles."""
    return _frequencies(spark, folder).where("mark is not null").select("field_name", "field_value", "mark")


def p5_frequencies(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and articles of each value."""
    return _frequencies(spark, folder)


P5_PART = """SELECT '{f}' AS field_name, {f} AS field_value, count(*) AS n_rows, count(DISTINCT article_id) AS n_records FROM entity WHERE {f} IS NOT NULL GROUP BY 2"""
P5_BASE = f"""WITH v AS ({P5_PART.format(f="entity_name")} UNION ALL {P5_PART.format(f="entity_type")}),
t AS (SELECT *, CASE WHEN n_records < 3 THEN 'rare' WHEN n_records > 0.1 * (SELECT count(DISTINCT article_id) FROM entity) THEN 'common' END AS mark FROM v)
"""


# ---- p9: mixing sources ------------------------------------------------------
def _mix(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    sized = mixing.sized_documents(table(spark, folder, "documents"))
    by_rate = mixing.rates(sized, table(spark, folder, "mix_target"))
    return mixing.mix(sized, by_rate, "doc_id"), by_rate


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    """One row per copy of a document in the mix."""
    return _mix(spark, folder)[0]


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and reached share of each source."""
    return mixing.reached(*_mix(spark, folder))


# ---- p8: evaluation texts in training text -----------------------------------
def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaks(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "eval_item"), "item_id", ["prompt", "answer"])


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a passage of an evaluation item."""
    return _leaks(spark, folder).select("doc_id", "item_id")


def p8_clean(spark: SparkSession, folder: str) -> DataFrame:
    """Documents without any such passage."""
    return leaks.without_leaks(table(spark, folder, "documents").select("doc_id", "source"), "doc_id", _leaks(spark, folder))


# ---- p10: missing or wrong language labels -----------------------------------
def _languages(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return languages.languages(docs, "doc_id", "text", languages.fit(docs, "doc_id", "text", "lang"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Languages of passages that aren't the language of the label."""
    label = table(spark, folder, "documents").select("doc_id", languages.label_code(F.col("lang")).alias("label"))
    told = _languages(spark, folder).where("n_sentences > 0 and lang is not null")  # whole sentences outside brackets
    j = told.join(label, "doc_id").where(~F.col("lang").eqNullSafe(F.col("label")))
    return j.select("doc_id", "para_no", F.col("lang").alias("true_lang")).distinct()


def p10_languages(spark: SparkSession, folder: str) -> DataFrame:
    """Languages of every passage and document, with their confidence."""
    out = _languages(spark, folder)
    return out.withColumns({c: F.round(c, 6) for c in ("confidence", "doc_confidence")})


QUERIES = {"p2_found": p2_found, "p2_entities": p2_entities, "p2_links": p2_links,
    "p3_found": p3_found, "p3_pairs_updated": p3_pairs_updated, "p5_found": p5_found, "p5_frequencies": p5_frequencies,
    "p8_found": p8_found, "p8_clean": p8_clean, "p10_found": p10_found, "p10_languages": p10_languages, "p9_mix": p9_mix, "p9_shares": p9_shares,
}
ORACLES: dict[str, str] = {
    "p3_found": P3_BASE + "SELECT name_a, name_b FROM p JOIN m x ON x.entity_name = name_a JOIN m y ON y.entity_name = name_b, s WHERE c >= 5 AND c * s.n >= 20 * x.n * y.n",
    "p3_pairs_updated": P3_BASE + """SELECT name_a, name_b, c, x.n AS n_a, y.n AS n_b, s.n, round(c * s.n / (CAST(x.n AS DOUBLE) * y.n), 6) AS lift
        FROM p JOIN m x ON x.entity_name = name_a JOIN m y ON y.entity_name = name_b, s""",
    "p5_found": P5_BASE + "SELECT field_name, field_value, mark FROM t WHERE mark IS NOT NULL",
    "p5_frequencies": P5_BASE + "SELECT * FROM t",
}
