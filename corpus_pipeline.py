"""The corpus pipeline: quality rules, near-duplicates, decontamination, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's result to the shared folder and reads it
back for the next. All but the last keep the columns of documents.

In every stage null and empty texts are allowed, rows that repeat a key are judged each by its own text, null keys are keys, other columns are carried
along whatever their names, and an empty table gives an empty one. Very long texts are taken whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stacklight.llm import decontaminate, jaccard, mixing, rules, tokens
from stacklight.llm.queries import tokenizer_path
from stacklight.session import dropped, table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects. Null and empty texts have too few words; repeated rows share their verdict."""
    return rules.filtered(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least doc_id (nulls last, then by a hash of the text); of rows that repeat it one. Texts without words stay."""
    return jaccard.deduplicated(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage. Null texts, and null or empty items, match nothing; without items all stay."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: words taken over size, rounded half up, so 0 to 2 times. Null sources are a source; texts without words are taken 0 times."""
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the token files, in order of doc_id (nulls first), then of a hash of the text. Null texts are the end id alone."""
    return tokens.token_digests(spark, tokens.write_tokens(docs, tokenizer_path()))


STAGES = [("quality rules", quality), ("n-gram Jaccard join", deduplicate), ("benchmark decontamination", decontaminated), ("mixing sources", mix), ("token ids", encode)]
#: SQL can't express the tokenizer, nor alignment; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        made = written(stage(spark, docs, sf_dir), f"stage{i}")
        if i:
            dropped(docs)
        docs = made
    return STAGES[-1][1](spark, docs, sf_dir)
