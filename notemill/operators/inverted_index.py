"""A stored inverted index that takes new documents and gives up old ones without being made anew.

Below its folder, every table in batches: postings (word, document, counts) by block of words, forward (a document's words) by block of documents, frequencies (what a batch adds to or takes
from a word's document count) by block of words, gone (documents that a batch takes away), and totals, one row a batch, written last: a batch without it doesn't
count and is written over by the next try. A document that comes again replaces its earlier self. A query reads the blocks of its words only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notemill.functions import text as T
from notemill.operators import search

#: Blocks of a table: folders that a query's words choose from.
BLOCKS, K1, B = 64, search.K1, search.B
TABLES = {
    "postings": "tok string, doc_id bigint, tf bigint, dl bigint, batch int, block int", "forward": "doc_id bigint, dl bigint, terms map<string,bigint>, batch int, block int",
    "frequencies": "tok string, n bigint, batch int, block int", "gone": "doc_id bigint, batch int", "totals": "batch int, docs bigint, words bigint",
}


class Index:
    """The index in a folder that all executors see, always opened with the same number of blocks. One writer at a time."""

    def __init__(self, spark: SparkSession, folder: str, blocks: int = BLOCKS):
        self.spark, self.folder, self.blocks = spark, folder.rstrip("/"), blocks

    def _block(self, name: str) -> Column:
        return F.pmod(F.xxhash64(name), F.lit(self.blocks)).cast("int")

    def table(self, name: str) -> DataFrame:
        empty = self.spark.createDataFrame([], TABLES[name])
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return empty
        rows = self.spark.read.schema(TABLES[name]).parquet(at.toString())
        return rows if name == "totals" else rows.where(F.col("batch") <= self.last())

    def last(self) -> int:
        """The number of the last batch that counts; -1 before the first. totals has one row a batch."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/totals")
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return -1
        found = self.spark.read.schema(TABLES["totals"]).parquet(at.toString()).agg(F.max("batch")).first()[0]
        return -1 if found is None else found

    def _put(self, rows: DataFrame, name: str, batch: int, by: str | None = None) -> None:
        path = f"{self.folder}/{name}/batch={batch}"
        rows = rows.repartition("block").sortWithinPartitions("block", by).write.mode("overwrite").partitionBy("block") if by else rows.write.mode("overwrite")
        rows.parquet(path)

    def _live(self, rows: DataFrame) -> DataFrame:
        """Of rows with doc_id and batch those that no later batch took away or replaced."""
        gone = self.table("gone").groupBy("doc_id").agg(F.max("batch").alias("_until"))
        return rows.join(gone, "doc_id", "left").where("_until is null or batch >= _until").drop("_until")

    def alive(self) -> DataFrame:
        """The documents as they are now: doc_id, dl, terms, batch, block."""
        return self._live(self.table("forward"))

    def add(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> None:
        """Takes the documents of docs in. Null keys are left out, null texts have no words; of repeated keys the last text in order of texts counts. Nothing happens without rows but that a batch is counted."""
        rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("doc_id is not null").groupBy("doc_id").agg(F.max("text").alias("text"))
        # words and their number are columns of their own below the generator; beside it Spark would take the whole text apart once more for each of its words
        rows = rows.select("doc_id", T.tokens(F.col("text")).alias("toks")).select("doc_id", F.size("toks").cast("bigint").alias("dl"), F.when(F.size("toks") > 0, F.col("toks")).alias("toks"))
        counted = rows.select("doc_id", "dl", F.explode_outer("toks").alias("tok")).groupBy("doc_id", "dl", "tok").agg(F.count("*").alias("tf"))
        batch = self.last() + 1
        forward = counted.groupBy("doc_id", "dl").agg(F.map_from_entries(F.collect_list(F.when(F.col("tok").isNotNull(), F.struct("tok", "tf")))).alias("terms")).withColumn("block", self._block("doc_id"))
        self._put(forward, "forward", batch, "doc_id")
        new = self.spark.read.parquet(f"{self.folder}/forward/batch={batch}").select("doc_id", "dl", "terms")
        self._words(new, batch)
        self._settle(batch, new, self.alive().join(new.select("doc_id"), "doc_id", "left_semi"))

    def delete(self, ids: DataFrame, key: str = "doc_id") -> None:
        """Takes documents away; unknown, repeated and null keys do nothing."""
        batch = self.last() + 1
        ids = ids.select(F.col(key).cast("bigint").alias("doc_id")).distinct()
        self._settle(batch, None, self.alive().join(ids, "doc_id", "left_semi"))

    def _settle(self, batch: int, new: DataFrame | None, old: DataFrame) -> None:
        """Counts what comes (new) and what goes (old: forward rows of earlier batches), and last of all the batch itself."""
        self._put(old.select("doc_id"), "gone", batch)
        change = old.select("terms", "dl", F.lit(-1).alias("n"))
        if new is not None:
            change = change.union(new.select("terms", "dl", F.lit(1).alias("n")))
        words = change.select(F.explode("terms").alias("tok", "tf"), "n").groupBy("tok").agg(F.sum("n").cast("bigint").alias("n")).where("n <> 0")
        self._put(words.withColumn("block", self._block("tok")), "frequencies", batch, "tok")
        totals = change.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("docs"), F.coalesce(F.sum(F.col("n") * F.col("dl")), F.lit(0)).cast("bigint").alias("words"))
        self._put(totals.coalesce(1), "totals", batch)

    def compact(self, folder: str) -> Index:
        """The documents as they are now, as the one batch of a new index."""
        other = Index(self.spark, folder, self.blocks)
        other._put(self.alive().select("doc_id", "dl", "terms", "block"), "forward", 0, "doc_id")
        new = self.spark.read.parquet(f"{other.folder}/forward/batch=0").select("doc_id", "dl", "terms")
        other._words(new, 0)
        other._settle(0, new, new.limit(0))
        return other

    def _words(self, new: DataFrame, batch: int) -> None:
        words = new.select("doc_id", "dl", F.explode("terms").alias("tok", "tf")).withColumn("block", self._block("tok"))
        self._put(words.select("tok", "doc_id", "tf", "dl", "block"), "postings", batch, "tok")

    def frequencies(self, words: list[str] | None = None) -> DataFrame:
        """tok, df of the words that documents have now, or of some words."""
        rows = self.table("frequencies")
        return (self._of(rows, words) if words is not None else rows).groupBy("tok").agg(F.sum("n").alias("df")).where("df > 0")

    def _of(self, rows: DataFrame, words: list[str]) -> DataFrame:
        """Rows of some words: only their blocks' folders are read, and in these the row groups that may hold them."""
        asked = self.spark.createDataFrame([(w,) for w in words], "tok string").select(self._block("tok").alias("b"))
        blocks = sorted({r.b for r in asked.collect()})
        return rows.where(F.col("block").isin(*blocks) & F.col("tok").isin(*words))

    def totals(self) -> DataFrame:
        """One row: docs, words."""
        return self.table("totals").agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("words"), F.lit(0)).alias("words"))

    def _asked(self, query: str) -> dict[str, int]:
        toks = search._query_tokens(query)
        return {t: toks.count(t) for t in toks}

    def postings(self, query: str) -> DataFrame:
        """tok, doc_id, tf, dl, asked (times in the query) of the query's words in the documents as they are now."""
        asked = self._asked(query)
        times = self.spark.createDataFrame(list(asked.items()), "tok string, asked bigint")
        return self._live(self._of(self.table("postings"), list(asked))).join(F.broadcast(times), "tok").select("tok", "doc_id", "tf", "dl", "asked")

    def bm25(self, query: str) -> DataFrame:
        """doc_id, bm25 of the documents that have a word of the query. A query without words gives no rows."""
        df, n = self.frequencies(list(self._asked(query))), self.totals()
        # as many rows as the query has words, and one row
        rows = self.postings(query).join(F.broadcast(df), "tok").crossJoin(F.broadcast(n))
        idf = F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
        average = F.greatest(F.col("words") / F.col("docs"), F.lit(1e-6))
        share = F.col("tf") * (K1 + 1) / F.greatest(F.col("tf") + K1 * (1 - B + B * F.col("dl") / average), F.lit(1e-9))
        return rows.groupBy("doc_id").agg(F.sum(F.col("asked") * idf * share).alias("bm25"))

    def cosine(self, query: str) -> DataFrame:
        """doc_id, cosine of the documents that have a word of the query: TF-IDF of the corpus as it is now against the query's counts. Lengths are those of the documents that are asked for only."""
        weight = (1 + F.log("tf")) * (F.log((F.col("docs") + 1) / (F.col("df") + 1)) + 1)
        n, met = self.totals(), self.postings(query)
        known = self.frequencies(list(self._asked(query)))
        mine = met.join(F.broadcast(known), "tok").crossJoin(F.broadcast(n)).groupBy("doc_id").agg(F.sum(weight * F.col("asked")).alias("dot"))
        terms = self.alive().join(met.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.explode("terms").alias("tok", "tf"))
        length = terms.join(self.frequencies(), "tok").crossJoin(F.broadcast(n)).groupBy("doc_id").agg(F.sqrt(F.sum(weight * weight)).alias("length"))
        times = self.spark.createDataFrame(list(self._asked(query).items()), "tok string, asked bigint")
        asked = known.join(F.broadcast(times), "tok").agg(F.sqrt(F.sum(F.col("asked") * F.col("asked"))).alias("asked"))
        return mine.join(length, "doc_id").crossJoin(F.broadcast(asked)).select("doc_id", (F.col("dot") / F.col("length") / F.col("asked")).alias("cosine"))
