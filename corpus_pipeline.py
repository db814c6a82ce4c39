"""Corpus pipeline: toxicity, near duplicates, benchmark passages, source mix, token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from maskwright.llm import decontamination, toxicity
from maskwright.llm.common import table, written
from maskwright.llm.mixing import mixed
from maskwright.llm.ngram_join import one_of_each
from maskwright.llm.token_files import token_output


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pattern grammar, learned from the labels, calls toxic go.

    Null and empty texts have no clause and stay; repeated rows are judged alike; texts are
    read whole, however long; without labels nothing goes. Columns stay as they are.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).where("predicted = 0").select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links of Jaccard 0.8 connect, the least id stays.

    Null and empty texts link with nothing and stay, as do rows with a null id. Of equal rows
    one stays; texts that share an id are one document. Ties cannot occur: ids are compared.
    """
    return one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go.

    Null and empty texts and items hold none; repeated rows are judged alike; without items
    nothing goes. Texts are searched whole.
    """
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each source's documents as often as its target weight asks, repeats as rows.

    Null and wordless texts have size 0 and are never taken; a null source is a source, the
    last one. Equal rows each have their own copies.
    """
    return mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the token-id files of what is left and return the digest read back from them.

    A null or empty text is its end id alone; null ids come first; equal rows each have a row.
    """
    return token_output(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
    ("token_output", tokens),
]

#: SQL can express neither the learned toxicity model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, in order. An empty table gives an empty result."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
