"""The corpus pipeline: quality, boilerplate lines, near duplicates, benchmark items, pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read
again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import decontaminate, lines, near_duplicates, quality, sentencepiece_codec
from tessella.llm.common import read, scope, small, staged


#: Names for the stages' own columns, which no table is likely to hold.
SCORE, REMOVED, TEXTS, ROWS, NUMBER, ID, TEXT = (f"__pipeline_{x}" for x in ("score", "removed", "texts", "rows", "number", "id", "text"))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, each row by its own text and n_chars.

    Null and empty texts are judged by their statistics alone; repeated ids, rows and null
    ids are judged row by row. Without labels nothing is known against a document and all stay.
    """
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    judged = quality.scored(docs, model, docs.columns, SCORE)
    return judged.where((F.col(SCORE) >= quality.THRESHOLD) | F.lit(not model.informed)).drop(SCORE)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without boilerplate lines; every row stays, and n_chars follows where a text changes.

    Null and empty texts, and rows with a null id or source, stay as they are; rows of one
    id are one holder of a line.
    """
    clean = lines.drop_boilerplate(docs, removed_col=REMOVED)
    return clean.withColumn("n_chars", F.when(F.col(REMOVED) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def numbered(docs: DataFrame) -> DataFrame:
    """The distinct (doc_id, text) with numbers that follow the ids, then the texts' hashes."""
    texts = docs.where("doc_id is not null").select("doc_id", "text").distinct()
    order = ["doc_id", F.xxhash64("text"), F.xxhash64(F.lit(1), "text"), F.col("text").isNull()]
    return staged(texts.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(NUMBER, F.monotonically_increasing_id()), "numbered")


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one of the smallest id.

    Rows of one id with different texts are judged apart, each by its own text; of equal
    ones the row that is smallest in its other columns stays. Rows with a null id stay. All
    null texts are one class, as are all empty ones.
    """
    repeated = staged(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if not repeated.staged_rows:
        gone = staged(near_duplicates.near_duplicates(docs).where("doc_id <> class_id").select("doc_id"), "gone")
        return docs.join(small(gone), "doc_id", "left_anti").select(*docs.columns)
    texts = numbered(docs)
    gone = staged(near_duplicates.near_duplicates(texts, NUMBER).where(F.col(NUMBER) != F.col("class_id")).select(NUMBER), "gone")
    kept = texts.join(small(gone), NUMBER, "left_anti").select(F.col("doc_id").alias(ID), F.col("text").alias(TEXT))
    ordered = [c for c, kind in docs.dtypes if "map<" not in kind]
    rows = docs.where("doc_id is not null").groupBy("doc_id", "text").agg(F.min_by(F.struct(*docs.columns), F.struct(*ordered)).alias(ROWS)).select(F.col(f"{ROWS}.*"))
    rows = rows.join(kept, (F.col("doc_id") == F.col(ID)) & F.col("text").eqNullSafe(F.col(TEXT)), "left_semi")
    return rows.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null, empty and short texts hold none. Of rows that share an id all go if one of them
    holds an item; rows with a null id stay. Without items every row stays.
    """
    found = decontaminate.contamination(docs, read(spark, sf_dir, "benchmark"))
    held = staged(found.select("doc_id").distinct(), "contaminated")
    return docs.join(small(held), "doc_id", "left_anti").select(*docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document's pieces, one row for each row; null texts have null ids."""
    return sentencepiece_codec.encode_documents(docs)


STAGES = [
    ("quality", good),
    ("lines", without_boilerplate),
    ("near_duplicates", without_copies),
    ("decontamination", without_benchmark),
    ("sentencepiece", pieces),
]

#: SQL can express neither the classifier nor the encoder; tests hold the stages against plain versions on small tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again; what a stage staged on its way is deleted after it."""
    docs, last = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scope(spark) as paths:
            docs = staged(stage(spark, docs, sf_dir), name)
            paths.remove(docs.staged_path)
            paths += [last] if last else []
        last = docs.staged_path
    return docs
