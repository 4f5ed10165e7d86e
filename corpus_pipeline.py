"""A corpus from raw documents to packed sequences, in five stages. Each stage's result is a table that the next one reads.

1. language ID: documents without a letter, or without a language that is more likely than all others together, go;
2. line dedup: lines found in five documents or more stay in the largest doc_id alone; n_chars follows the text;
3. SimHash near-dedup: of each group the document with the smallest doc_id stays;
4. benchmark decontamination: documents with a benchmark window of ten words go;
5. best-fit packing: the rest as pieces of token sequences.

Null texts go in the first stage. Documents without a doc_id keep all lines and are no one's copy. Other columns pass through,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evlog.llm import decontaminate, langid, linededup, packing, simhash
from evlog.llm.common import Work, free
from evlog.llm.queries import tokenizer_path

#: No language counts as found below this posterior.
LEAST_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.train(docs.where(~langid.held_out()))
    if not model.languages:  # nothing to learn from: only the lack of any letter can be told
        return docs.where(F.col("text").rlike(r"\p{L}"))
    lang, score = free(docs, "_lang", "_score")
    return langid.predict(docs, model, lang, score).where((F.col(lang) != "und") & (F.col(score) >= LEAST_SCORE)).drop(lang, score)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lines, dropped = free(docs, "_n_lines", "_n_dropped")
    kept = linededup.dedup_lines(docs, n_lines=lines, n_dropped=dropped)
    return kept.withColumn("n_chars", F.when(F.col(dropped) > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """By id and text, so that rows that share an id, or have none, are each judged by what they say."""
    leaked_id, leaked_text, mark = free(docs, "_leaked", "_leaked_text", "_text")
    index = decontaminate.build_index(docs, mark=F.md5("text"))
    found = decontaminate.phrase_matches(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    leaked = found.where(F.size("spans") > 0).select(F.col("doc_id").alias(leaked_id), F.col("mark").alias(leaked_text)).distinct()
    marked = docs.withColumn(mark, F.md5("text"))
    return marked.join(leaked, F.col("doc_id").eqNullSafe(F.col(leaked_id)) & (F.col(mark) == F.col(leaked_text)), "left_anti").drop(mark)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack),
]

#: Language ID and tokenisation can't be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over sf_dir's documents."""
    work = Work(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = work.save(stage(spark, docs, sf_dir), f"stage-{number}")
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
