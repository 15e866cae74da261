"""Five stages that turn raw documents into token files, each a distributed operator over all its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns the columns of documents, the last the token files' documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from newsloom.llm import curriculum, decontaminate, language, simhash, token_files
from newsloom.llm.shared import kept, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
TOKENIZER = "word_bpe_49k.json"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found.

    NULL and empty texts and texts without a letter go. A corpus without usable labels keeps every text with a letter. Rows are
    judged each by its own text, so repeated ids and NULL ids, sources or labels make no difference; no rows give no rows.
    """
    return language.keep_identified(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that with the smallest id, one with an id before one without.

    Texts without words are one group. Equal rows, rows that share an id and rows without one are told apart by their text.
    """
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with no word, or fewer than one in 20, inside a passage of a benchmark item.

    NULL and empty texts have no words and stay, as do all rows if the benchmark is empty; equal rows stay or go together.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order, which their order in the written table keeps.

    NULL and empty texts have no size and are never taken. NULL is a source like any other; equal rows follow each other.
    """
    return curriculum.training_rows(docs).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all rows in the order they are stored in, the training order; returns where each row's ids are.

    NULL and empty texts give the end id alone; a row that stands several times is written as often.
    """
    folder = token_files.token_folder(spark)
    manifest = token_files.write_tokens(docs, folder, public_tokenizers.path(TOKENIZER), as_stored=True)
    return token_files.read_tokens(spark, folder, manifest).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language", language_id),
    ("simhash", simhash_dedup),
    ("decontamination", decontamination),
    ("mix", mix),
    ("tokens", tokens),
]
#: No SQL has the language model, XXH64 or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for _, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
