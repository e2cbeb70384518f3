"""A corpus pipeline of five stages, each written and read again before the next.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents. n_chars follows a text that is changed.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomsheet.llm import bpe, common, decontaminate, language_id, near_dedup, secrets

#: A text is rejected if no language is found, or if fewer of its n-grams than this are known in the best one.
LEAST_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is recognised, by a model learned from the labelled documents of the stage's input."""
    labelled = docs.where(~language_id.held_out())
    model = language_id.fit(labelled)
    keep = tuple(docs.columns)
    renamed = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_t"), *[F.col(c).alias(f"_c{k}") for k, c in enumerate(keep)])
    found = language_id.predict(renamed, model, "_id", "_t", tuple(f"_c{k}" for k in range(len(keep))))
    found = found.where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    return found.select(*[F.col(f"_c{k}").alias(c) for k, c in enumerate(keep)])


#: Ids that ``dedup`` makes begin here, so that documents with smaller ids of their own come before.
_MADE = 1 << 62


def _one_text_an_id(docs: DataFrame) -> DataFrame:
    """``docs`` with _row, an id that each text has for itself: doc_id, or a made one where doc_id is null or stands for several texts.

    Of the texts of one doc_id, that of the least hash keeps it. Equal rows share their _row.
    """
    h = F.xxhash64("text")
    several = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(h).alias("_least"), F.max(h).alias("_most")).where("_least < _most")
    several, _ = common.stored(several.select("doc_id", "_least"), "several-texts")
    made = F.lit(_MADE) + F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 2)
    own = F.col("doc_id").isNotNull() & (F.col("_least").isNull() | (F.col("_least") == h))
    return docs.join(several, "doc_id", "left").withColumn("_row", F.when(own, F.col("doc_id")).otherwise(made)).drop("_least")


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8); of rows that repeat id and text, one.

    Texts are judged one by one, also those without an id and those that share
    one. A group keeps its smallest doc_id; one without an id only if none has any.
    """
    keyed = _one_text_an_id(docs)
    found, _ = common.stored(near_dedup.near_duplicates(keyed, id_col="_row").select(F.col("doc_id").alias("_row"), "component_id"), "verdicts")
    # A made id may stand for a smaller doc_id than the group's smallest _row.
    made = keyed.where("doc_id IS NOT NULL AND doc_id <> _row").select("_row", "doc_id").distinct()
    better = found.join(made, "_row").groupBy("component_id").agg(F.min(F.struct("doc_id", "_row")).alias("_b")).where("_b.doc_id < component_id")
    better, _ = common.stored(better.select("component_id", F.col("_b._row").alias("_best")), "better")
    gone = found.join(better, "component_id", "left").where("_row <> COALESCE(_best, component_id)").select("_row").distinct()
    kept = keyed.join(gone, "_row", "left_anti")
    # Only ids found more than once are grouped; their rows are few, and the rest isn't shuffled for them.
    twice, _ = common.stored(found.groupBy("_row").count().where("count > 1").select("_row"), "repeated")
    if twice.isEmpty():
        return kept.select(*docs.columns)
    one = kept.join(twice, "_row", "left_semi").dropDuplicates(["_row", "text"]).select(*docs.columns)
    return kept.join(twice, "_row", "left_anti").select(*docs.columns).unionByName(one)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in which any window of a benchmark item occurs, with or without an id.

    A passage of a benchmark in a long text spoils a test as much as in a short
    one, so the share of words that the operator's ``contaminated`` asks for
    plays no part here. Rows are judged where they are read, so texts are
    neither shuffled nor sorted, whatever the number of documents dropped.
    """
    return decontaminate.without(docs, common.table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret in the texts."""
    model = secrets.fit(docs)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            texts = batch.column(at)
            clean = [secrets.redact(t, s) if s else t for t, s in zip(texts.to_pylist(), secrets.scan(model, texts), strict=True)]
            columns = list(batch.columns)
            columns[at] = pa.array(clean, texts.type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    out = common.in_batches(docs, run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and the token ids of every text, and decoded_sha256 of what the ids decode to."""
    out = bpe.encode(docs, keep=("lang", "source"), decoded=True)
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded_sha256")


STAGES = [
    ("language ID", language),
    ("near-dedup", dedup),
    ("decontamination", clean_of_benchmark),
    ("secret scan", without_secrets),
    ("BPE", tokens),
]

#: Language, secrets and BPE are no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs, _ = common.stored(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
