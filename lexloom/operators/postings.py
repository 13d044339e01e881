"""A kept word index: postings in blocks, appended to in committed segments, searched for many questions at once.

A segment holds the rows of one ``append``: ``docs`` (key, scope, distinct words) and
``postings`` (word, scope, block: keys and the largest number of words among them), the
latter in folders by a hash of the word, so that a search opens the folders of its words
only. Blocks are slices of the rows by length and hash and hold some ten thousand keys at most,
however frequent the word.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialise
from .kept import KeptFolder
from .skew import first_per_key, one_per_key

BUCKETS, BLOCK = 64, 65_536


class WordIndex(KeptFolder):
    """Index folder at ``path``; ``key``, ``scope`` (string) and ``words`` (array of strings) name the columns of the rows indexed."""

    def __init__(self, spark: SparkSession, path: str, key: str, scope: str, words: str = "words"):
        super().__init__(spark, path)
        self.key, self.scope, self.words = key, scope, words

    def append(self, rows: DataFrame, block: int = BLOCK) -> int:
        """Index rows whose key is not in the index yet (the first of equal keys); returns their number."""
        words = F.array_distinct(F.filter(F.coalesce(F.col(self.words), F.array().cast("array<string>")), lambda w: w.isNotNull()))
        new = rows.where(F.col(self.key).isNotNull()).select(
            F.col(self.key).alias("key"), F.coalesce(F.col(self.scope), F.lit("")).alias("scope"), F.sort_array(words).alias("words"))
        new = one_per_key(new, ["key"], ["scope", F.xxhash64("words")])
        old = self.part("docs")
        if old is not None:
            new = new.join(old.select("key"), "key", "left_anti")
        name = self.new_segment()
        folder = f"{self.path}/{name}"
        new.write.parquet(f"{folder}/docs")
        docs = self.spark.read.parquet(f"{folder}/docs")
        n = docs.count()
        if not n:
            return 0
        size = F.size("words")
        # rows of like length meet in a block, so that its longest row bounds the others closely; a block's rows are
        # brought together once, as rows, and its words are grouped where they then lie
        block_of = ["scope", "band", "shard"]
        sliced = docs.select(
            "key", "scope", size.alias("_n"), F.floor(F.log2(size + 1)).cast("int").alias("band"),
            F.pmod(F.xxhash64("key"), F.lit(-(-n // block))).cast("int").alias("shard"), "words").repartition(*block_of)
        blocks = sliced.select("key", "_n", *block_of, F.explode("words").alias("word")).groupBy("word", *block_of).agg(
            F.sort_array(F.collect_list("key")).alias("keys"), F.count(F.lit(1)).alias("n"), F.max("_n").alias("top"))
        blocks = blocks.withColumn("bucket", _bucket("word")).hint("rebalance", "bucket").sortWithinPartitions("bucket", "word")
        blocks.write.partitionBy("bucket").parquet(f"{folder}/postings")
        self.commit(name)
        return n

    def blocks(self, buckets: list[int]) -> DataFrame | None:
        """Posting blocks in the folders of the given buckets (of ``BUCKETS`` at most); no other folder is opened."""
        found = self.part("postings")
        return None if found is None else found.where(F.col("bucket").isin(buckets))

    def search(self, asked: DataFrame, by: list[str], fetch: int, words: str = "words", scopes: str = "scopes") -> DataFrame:
        """For each row of ``asked`` (named by the columns ``by``): the ``fetch`` keys with most of its words, as ``by``, key, hits, pos.

        Only rows whose scope is among ``scopes`` count; equal counts are ordered by key; keys without
        a shared word are no hits. The rarest words set a mark first: the count that ``fetch`` keys
        reach by them alone. Keys that hold nothing but the mark - 1 most frequent words stay below it, so
        these words' lists are not read; nor are blocks of rows with fewer words than the mark, nor, while
        the mark is 1 or less, more than the first ``fetch`` keys of the most frequent word (a key with
        that word alone comes behind them). The counts over the lists that were read raise the mark; keys that
        may still reach it with the lists left out are then counted on their own words.
        """
        postings, docs = self.part("postings"), self.part("docs")
        kinds = ", ".join(f"`{c}` {asked.schema[c].dataType.simpleString()}" for c in by)
        if postings is None:
            return self.spark.createDataFrame([], f"{kinds}, `{self.key}` string, hits int, pos int")
        asked = asked.select(*by, F.array_distinct(F.col(words)).alias("_asked"), F.col(scopes).alias("_scopes"))
        # what the joins below meet the index with is stored, so its size is known when they are planned
        terms = materialise(asked.select(*by, "_scopes", F.explode("_asked").alias("word")).withColumn("bucket", _bucket("word")), "terms")
        postings = self.blocks([r.bucket for r in terms.select("bucket").distinct().collect()])
        # how long each question's lists are, from the counts of the blocks
        known = terms.select("bucket", "word").distinct()
        length = postings.select("bucket", "word", "scope", "n").join(known, ["bucket", "word"]).groupBy("word", "scope").agg(F.sum("n").alias("n"))
        sized = terms.join(length, "word").where(F.array_contains("_scopes", F.col("scope"))).groupBy(*by, "_scopes", "word", "bucket").agg(F.sum("n").alias("n"))
        rare = Window.partitionBy(*by).orderBy("n", "word")
        ranked = materialise(sized.withColumn("_before", F.coalesce(F.sum("n").over(rare.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
                             .withColumn("_from_top", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), F.desc("word")))), "lists")

        def met(lists: DataFrame, mark: str | None = None) -> DataFrame:
            """Keys of the lists, with the number of lists that hold each."""
            found = postings.join(lists, ["bucket", "word"]).where(F.array_contains("_scopes", F.col("scope")))
            if mark:
                found = found.where(F.col("top") >= F.col(mark))
            extra = [mark] if mark else []
            return found.select(*by, *extra, F.explode("keys").alias("key")).groupBy(*by, *extra, "key").agg(F.count(F.lit(1)).alias("_part"))

        first = first_per_key(met(ranked.where(F.col("_before") < 20 * fetch)), by, [F.desc("_part"), "key"], fetch)
        mark = first.groupBy(*by).agg(F.when(F.count(F.lit(1)) >= fetch, F.min("_part")).otherwise(0).alias("_mark"))
        marked = materialise(ranked.join(mark, by, "left").withColumn("_mark", F.coalesce("_mark", F.lit(0)).cast("int")), "marked")
        left_out = F.greatest(F.col("_mark") - 1, F.lit(1))
        reached = materialise(met(marked.where(F.col("_from_top") > left_out), "_mark").where(F.col("_part") + left_out >= F.col("_mark")).select(*by, "_mark", "key", "_part"), "reached")
        # fetch keys have that many hits at least; from the numbers of keys by count, so no list of keys is sorted
        most = Window.partitionBy(*by).orderBy(F.desc("_part"))
        raised = reached.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_upto", F.sum("_n").over(most)).where(F.col("_upto") >= fetch).groupBy(*by).agg(F.max("_part").alias("_raised"))
        reach = reached.join(raised, by, "left").where(F.col("_part") + left_out >= F.coalesce("_raised", F.lit(0))).select(*by, "key")
        common = marked.where((F.col("_mark") <= 1) & (F.col("_from_top") == 1))
        heads = first_per_key(
            postings.join(common.select("bucket", "word").distinct(), ["bucket", "word"]).select("word", "scope", F.explode(F.slice("keys", 1, fetch)).alias("key")),
            ["word", "scope"], ["key"], fetch)
        heads = common.join(heads, "word").where(F.array_contains("_scopes", F.col("scope"))).select(*by, "key")
        cands = materialise(reach.unionByName(heads).distinct(), "candidates")
        counted = cands.join(docs.select("key", F.col("words").alias("_has")), "key").join(asked.select(*by, "_asked"), by).select(
            *by, "key", F.size(F.array_intersect("_asked", "_has")).alias("hits"))
        return first_per_key(counted, by, [F.desc("hits"), "key"], fetch, "pos", keep=True).withColumnRenamed("key", self.key)


def _bucket(word: str):
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")
