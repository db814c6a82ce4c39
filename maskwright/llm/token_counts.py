"""Token counts kept by signed deltas.

A store holds, for each committed batch, the change it makes to documents and tokens by
source, language and tokenizer version. Totals are sums over all committed batches, so
inserts, deletes and revised counts only ever add rows. A batch has a name; its folder is
written as a whole and named by it, so a batch that is committed again, or whose first try
was lost half-way, counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, shared_path, table

KEYS = ("source", "lang", "tokenizer")
_DELTA = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint"

#: Tokenizer versions with counts that SQL expresses: ASCII-space words, and words and marks apart.
TOKENIZERS = {"words-1": WORD, "words-2": r"[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]"}


def count_tokens(text: Column, tokenizer: str) -> Column:
    """Tokens of a text by a named tokenizer; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKENIZERS[tokenizer])), F.lit(0)).cast("long")


def inserts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """A change a document: it is there now."""
    return docs.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(1).alias("n_docs"), count_tokens(F.col("text"), tokenizer).alias("n_tokens"))


def deletes(docs: DataFrame, tokenizer: str) -> DataFrame:
    """A change a document: it is gone."""
    return inserts(docs, tokenizer).withColumns({"n_docs": -F.col("n_docs"), "n_tokens": -F.col("n_tokens")})


def revisions(docs: DataFrame, old: str, new: str) -> DataFrame:
    """Two changes a document: its old count goes, its new one comes; one pass over the texts."""
    sides = F.array(*[
        F.struct(F.lit(t).alias("tokenizer"), F.lit(sign).alias("n_docs"), (sign * count_tokens(F.col("text"), t)).alias("n_tokens"))
        for t, sign in ((old, -1), (new, 1))
    ])
    return docs.select("source", "lang", F.explode(sides).alias("c")).select("source", "lang", "c.*")


class TokenRollup:
    """Totals at a path. Null source or language is a group of its own; empty batches are allowed."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply a batch of changes (KEYS, n_docs, n_tokens; signed). False if it was applied before.

        Changes are summed before the shuffle, so a source that holds most rows is no burden.
        The folder's ``_SUCCESS`` is the commit: without it the batch is written afresh.
        """
        if not batch or "/" in batch or batch.startswith((".", "_")):
            raise ValueError(f"not a batch name: {batch!r}")
        folder = f"{self.path}/batch={batch}"
        if self._exists(f"{folder}/_SUCCESS"):
            return False
        sums = changes.groupBy(*KEYS).agg(F.sum("n_docs").cast("long").alias("n_docs"), F.sum("n_tokens").cast("long").alias("n_tokens"))
        sums.write.mode("overwrite").parquet(folder)
        return True

    def batches(self) -> list[str]:
        """Names of the committed batches, ascending."""
        if not self._exists(self.path):
            return []
        fs, p = self._fs(self.path)
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(n[6:] for n in names if n.startswith("batch=") and self._exists(f"{self.path}/{n}/_SUCCESS"))

    def totals(self) -> DataFrame:
        """Documents and tokens by key; keys whose documents and tokens are all gone have no row."""
        done = [f"{self.path}/batch={b}" for b in self.batches()]
        rows = self.spark.read.schema(_DELTA).parquet(*done) if done else self.spark.createDataFrame([], _DELTA)
        sums = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 OR n_tokens <> 0")


def documents_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of all documents after a history of batches, some of them delivered twice.

    All are inserted as words-1, then recounted as words-2, then those without any letter
    or digit are withdrawn. The recount and the insert are delivered again and change nothing.
    """
    docs = table(spark, sf_dir, "documents")
    store = TokenRollup(spark, shared_path(spark, "token-counts"))
    store.commit("0001-insert", inserts(docs, "words-1"))
    recount = revisions(docs, "words-1", "words-2")
    store.commit("0002-recount", recount)
    store.commit("0002-recount", recount)
    store.commit("0003-withdraw", deletes(docs.where(F.coalesce(~F.rlike("text", F.lit(r"[\p{L}\p{N}]")), F.lit(True))), "words-2"))
    store.commit("0001-insert", inserts(docs, "words-1"))
    return store.totals()
