"""A corpus pipeline of five stages over documents: language, near copies, benchmark passages, secrets, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.common import row_key, table, written
from docweave.llm.decontaminate import contamination
from docweave.llm.jaccard import row_components
from docweave.llm.language import identify, learn
from docweave.llm.packing import pack_documents
from docweave.llm.queries import tokenizer
from docweave.llm.secrets import redacted, secrets

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those without a letter or of too narrow a margin go.

    Dictionaries come from a bounded sample of the documents with an id (at most 256 texts a language); these few are judged by dictionaries that hold
    them, so that they nearly always stay. Null and empty texts have no letter and go; repeated rows stay or go together; an empty table gives no rows.
    """
    found = identify(docs.select(COLUMNS), learn(docs, F.col("doc_id").isNotNull()))
    return found.where("not rejected").select(COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (shingles of five words, similarity 0.8 or more) the text of the smallest doc_id stays.

    Null doc_ids come last, and of one doc_id's texts in a component the one of the least hash stays. Different texts
    with one doc_id, or with none, stay unless they are near copies. Null, empty and blank texts have no words and link
    with nothing; of repeated rows one stays; an empty table gives no rows.
    """
    found = written(row_components(docs, 5, 80))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "i", "k")
    linked = found.where("component is not null").groupBy("component").agg(F.min(place).alias("at"))
    alone = found.where("component is null").select("i", "k").distinct()
    kept = written(linked.select("at.i", "at.k").union(alone))
    i, k = row_key()
    keyed = docs.select(*COLUMNS, i.alias("i"), k.alias("k")).dropDuplicates(["i", "k"])
    return keyed.join(kept.hint("merge"), ["i", "k"]).select(COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated: those stay of which fewer than one word in twenty lies in a benchmark window.

    Null and empty texts have no words and stay; repeated rows stay or go together; an empty table gives no rows.
    """
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    bad = written(found.where("n_hit > 0 and 20 * n_hit >= n_words").select(F.col("a").alias("i"), F.col("b").alias("k")).distinct())
    i, k = row_key()
    keyed = docs.withColumn("i", i).withColumn("k", k)
    return keyed.join(bad.hint("merge"), ["i", "k"], "left_anti").select(COLUMNS)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, secrets replaced by [SECRET] and n_chars renewed where there were any.

    Null and empty texts stay as they are, repeated rows are redacted each, an empty table gives no rows.
    """
    found = secrets(docs).where("size(spans) > 0").dropDuplicates(["a", "b"])
    found = found.select(F.col("a").alias("i"), F.col("b").alias("k"), "spans")
    i, k = row_key()
    keyed = docs.withColumn("i", i).withColumn("k", k)
    joined = keyed.join(found.hint("merge"), ["i", "k"], "left")
    text = F.when(F.col("spans").isNotNull(), redacted(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    chars = F.when(F.col("spans").isNotNull(), F.length(text).cast("long")).otherwise(F.col("n_chars"))
    return joined.select("doc_id", text.alias("text"), "lang", "source", chars.alias("n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids, packed into sequences of 2048.

    Null and empty texts are a piece of the end id alone, repeated rows are packed each, an empty table gives no rows.
    """
    return pack_documents(docs, tokenizer("word_bpe_49k.json"))


STAGES = [("language", language), ("near_copies", near_copies), ("benchmark", benchmark), ("secrets", redact), ("packing", packing)]

#: No stage but the benchmark's can be put into SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each on all that the one before left; every stage says what it does with odd rows."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs)
    return docs
