"""Document frequencies of a corpus that grows batch by batch.

The state is a folder with one table a batch: the number of its documents and
in how many of them each term comes.  Frequencies are sums, so batches can
come in any order; a batch that comes again replaces itself, which makes
foreachBatch exactly-once.  `compact` folds batches into one table that names
the last batch it holds; it is written whole before anyone reads it, and what
it holds is passed over then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from condensa.operators import stats

SCHEMA = "term string, df long"


class GrowingCorpus:
    """terms: a column of the words of `text`, by default words and tags."""

    def __init__(self, spark: SparkSession, path: str, terms: Column | None = None):
        self.spark, self.path, self.terms = spark, path.rstrip("/"), terms

    def add(self, docs: DataFrame, batch: int) -> None:
        """Count docs(text) as the batch of that number; a null text is a document without terms."""
        many = docs.agg(F.lit(None).cast("string").alias("term"), F.count("*").alias("df"))
        rows = stats.document_frequencies(docs, self.terms).unionByName(many)
        rows.write.mode("overwrite").parquet(f"{self.path}/batches/batch={batch:012d}")

    def follow(self, docs: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Add every batch of a stream docs(text), from where the checkpoint is."""
        return docs.writeStream.foreachBatch(lambda df, batch: self.add(df, batch)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def _complete(self, kind: str) -> dict[int, str]:
        """Number and path of the tables that were written to their end."""
        top = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        fs = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(top):
            return {}
        found = [x.getPath() for x in fs.listStatus(top)]
        done = [p for p in found if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return {int(p.getName().split("=")[1]): p.toString() for p in done}

    def _tables(self) -> tuple[int, list[str]]:
        """(the last batch that a compacted table holds, that table and the batches after it)."""
        whole = self._complete("compact")
        last = max(whole, default=-1)
        return last, [p for _, p in sorted(whole.items())[-1:]] + [p for n, p in sorted(self._complete("batches").items()) if n > last]

    def _rows(self) -> DataFrame:
        paths = self._tables()[1]
        read = self.spark.read.schema(SCHEMA)
        return read.parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)

    def frequencies(self) -> DataFrame:
        """(term, df) over all batches."""
        return self._rows().where("term IS NOT NULL").groupBy("term").agg(F.sum("df").alias("df"))

    def documents(self) -> int:
        return self._rows().where("term IS NULL").agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]

    def compact(self) -> None:
        """One table in place of all batches so far, which from then on are settled: none of them is to come again with other documents, and none earlier for the first time."""
        last, paths = self._tables()
        upto = max(self._complete("batches"), default=last)
        if upto > last:
            rows = self._rows().groupBy("term").agg(F.sum("df").alias("df"))
            rows.write.mode("overwrite").parquet(f"{self.path}/compact/upto={upto:012d}")

    def keywords(self, docs: DataFrame, common: float | None = None) -> DataFrame:
        """(doc_id, term, tfidf) of docs(doc_id, text) by the corpus as it is now; terms that a share `common` of it has count nothing."""
        n, df = self.documents(), self.frequencies()
        return stats.keywords(docs, df, n, None if common is None else stats.derived_stop_words(df, n, common))
