"""The stored search tables.

Layout under one folder::

    postings/    gen=/type=/bucket=   id, live, time, score, term, tf, dl, positions; sorted by term
    pairs/       gen=/type=/bucket=   id, live, term, positions of neighbours with a frequent word among them;
                                      the other columns stand in the postings of their words
    term_stats/  gen=/bucket=         scope, term, df
    corpus_stats/gen=                 scope, n, total_dl
    retired/     gen=                 ids whose rows in earlier generations are void
    commits/                          one row per finished generation, with its batch, the number of
                                      its retired ids and the frequent words

Statistics are additive: a later generation holds signed differences, and
readers sum them. Postings of a changed item are replaced by naming its id as
retired in the generation that holds the new ones. Only committed generations
are read, so a writer that dies leaves nothing visible.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from forumlake.operators.joins import BROADCAST_ROWS
from forumlake.operators.postings import bucket_of, corpus_stats, packed, postings, term_stats, unpacked
from forumlake.operators.rank import TermCounts
from forumlake.schema import ITEM_TYPES
from forumlake.session import spread, stage

BYTES_PER_BUCKET = 256 * 2**20
MIN_BUCKETS, MAX_BUCKETS = 8, 4096

POSTINGS = "gen int, type string, bucket int, id bigint, live boolean, time timestamp, score int, term string, tf int, dl int, positions array<int>"
TERM_STATS = "gen int, bucket int, scope string, term string, df bigint"
CORPUS_STATS = "gen int, scope string, n bigint, total_dl bigint"
RETIRED = "gen int, id bigint"
COMMITS = "gen int, config string, crc_buckets int, source string, retired bigint, frequent array<string>"

# A word in more than this share of all rows is frequent. As many words can be that
# frequent as a mean row has distinct words, divided by the share, whatever the corpus.
FREQUENT = 0.05


@dataclass(frozen=True)
class SearchIndex:
    spark: SparkSession
    path: str
    config: str
    buckets: int
    generations: tuple[int, ...]
    sources: tuple[str, ...] = ()
    retired: int = 0  # rows of that table
    frequent: frozenset[str] = frozenset()

    def _read(self, name: str, schema: str) -> DataFrame:
        table = self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        return table.filter(F.col("gen").isin(*self.generations))

    def _bucket_filter(self, terms: list[str]) -> Column:
        # The hashes of literal terms fold to constants, so this prunes folders,
        # and the term filter prunes row groups of the sorted files.
        return F.col("bucket").isin(*[bucket_of(F.lit(t), self.buckets) for t in terms]) & F.col("term").isin(*terms)

    def postings(self, terms: list[str] | None = None, type_: str = "all", table: str = "postings", generations: tuple[int, ...] = ()) -> DataFrame:
        """The rows of all or of some terms, from all or some ``generations``; those of pairs lie in the table ``pairs``."""
        rows = self._read(table, POSTINGS)
        if generations:
            rows = rows.filter(F.col("gen").isin(*generations))
        if terms is not None:
            rows = rows.filter(self._bucket_filter(terms)) if terms else rows.limit(0)
        if type_ in ITEM_TYPES:
            rows = rows.filter(F.col("type") == type_)
        if len(self.generations) > 1:
            last = self._read("retired", RETIRED).groupBy("id").agg(F.max("gen").alias("_retired"))
            # Below the bound no posting is shuffled for its generation; beyond it, compact the index.
            last = F.broadcast(last) if self.retired <= BROADCAST_ROWS else last
            rows = rows.join(last, "id", "left").filter("_retired IS NULL OR gen >= _retired").drop("_retired")
        return rows.drop("gen")

    def term_stats(self, terms: list[str] | None = None, scope: str | None = None) -> DataFrame:
        rows = self._read("term_stats", TERM_STATS)
        if terms is not None:
            rows = rows.filter(self._bucket_filter(terms)) if terms else rows.limit(0)
        if scope is not None:
            rows = rows.filter(F.col("scope") == scope)
        if len(self.generations) > 1:
            rows = rows.groupBy("scope", "term", "bucket").agg(F.sum("df").alias("df")).filter("df > 0")
        return rows.select("scope", "term", "df", "bucket")

    def corpus_stats(self) -> DataFrame:
        return self._read("corpus_stats", CORPUS_STATS).groupBy("scope").agg(F.sum("n").alias("n"), F.sum("total_dl").alias("total_dl"))

    def counts(self, terms: list[str], scope: str) -> TermCounts:
        """The statistics of a few terms, brought to the driver: one row per
        term and one for the scope."""
        df = self.term_stats(terms, scope).select("term", "df", F.lit(None).cast("bigint").alias("total_dl"))
        n = self.corpus_stats().filter(F.col("scope") == scope).select(F.lit(None).cast("string"), "n", "total_dl")
        rows = df.union(n).collect()
        size = next((row for row in rows if row["term"] is None), None)
        known = {row["term"]: row["df"] for row in rows if row["term"] is not None}
        return TermCounts(size["df"] if size else 0, size["total_dl"] if size else 0, known)


def open_index(spark: SparkSession, path: str) -> SearchIndex:
    rows = spark.read.schema(COMMITS).parquet(f"{path}/commits").collect()  # one row per generation
    if not rows:
        raise ValueError(f"no finished generation in {path}")
    if any(r["crc_buckets"] is None for r in rows):
        raise ValueError(f"the terms in {path} are dealt to folders by an earlier hash: build the index again")
    generations = tuple(sorted(r["gen"] for r in rows))
    sources = tuple(sorted(s for r in rows for s in (r["source"] or "").split("\n")))
    retired = sum(r["retired"] or 0 for r in rows)
    frequent = frozenset(t for r in rows for t in r["frequent"] or ())
    return SearchIndex(spark, path, rows[0]["config"], rows[0]["crc_buckets"], generations, sources, retired, frequent)


def buckets_for(size: int) -> int:
    return max(MIN_BUCKETS, min(MAX_BUCKETS, size // BYTES_PER_BUCKET))


def _write(df: DataFrame, path: str, gen: int, keys: list[str], order: list[str], mode: str = "overwrite", laid: bool = False) -> None:
    """One folder per key value. The rebalance lets Spark cut an overfull key
    into several tasks and files, and merge small ones. Rows that are ``laid`` come out of
    folders of these keys and are only sorted in their tasks."""
    even = (df if laid else df.hint("rebalance", *keys)).sortWithinPartitions(*keys, *order)
    writer = even.write.mode(mode)
    (writer.partitionBy(*keys) if keys else writer).parquet(f"{path}/gen={gen}")


def _write_packed(packs: DataFrame, path: str, gen: int, *columns: str) -> None:
    """Postings are shuffled packed and stored one a row, all of their columns or some."""
    keys = ["type", "bucket"]
    rows = unpacked(packs.hint("rebalance", *keys))
    _write(rows.select(*keys, *columns) if columns else rows, path, gen, keys, ["term", "id"], laid=True)


def _commit(spark: SparkSession, path: str, gen: int, config: str, buckets: int, source: str = "build", mode: str = "append", frequent: list[str] | None = None, retired: int = 0) -> None:
    row = spark.range(1).select(
        F.lit(gen).alias("gen"),
        F.lit(config).alias("config"),
        F.lit(buckets).alias("crc_buckets"),
        F.lit(source).alias("source"),
        F.lit(retired).cast("bigint").alias("retired"),
        F.array(*[F.lit(t) for t in frequent or ()]).cast("array<string>").alias("frequent"),
    )
    row.coalesce(1).write.mode(mode).parquet(f"{path}/commits")


def build_index(items: DataFrame, path: str, size: int, config: str = "english") -> SearchIndex:
    """Writes generation 0: the postings in one shuffle, then the statistics
    from the written postings. ``size`` is the items' size in bytes. Over an
    earlier index it becomes the only committed generation."""
    spark = items.sparkSession
    buckets = buckets_for(size)
    _write_packed(packed(spread(items, size), config, buckets), f"{path}/postings", 0)
    written = spark.read.schema(POSTINGS).parquet(f"{path}/postings").filter("gen = 0")
    stats = term_stats(written).withColumn("bucket", bucket_of(F.col("term"), buckets))
    _write(stats, f"{path}/term_stats", 0, ["bucket"], ["term", "scope"])
    _write(corpus_stats(items, written), f"{path}/corpus_stats", 0, [], ["scope"])
    _commit(spark, path, 0, config, buckets, mode="overwrite")
    return open_index(spark, path)


def add_pairs(index: SearchIndex, items: DataFrame, size: int, share: float = FREQUENT) -> SearchIndex:
    """Adds the pairs of frequent words to an index of one generation, so that
    phrases need none of those words' positions. The words stay the frequent ones
    in later generations."""
    if index.generations != (0,):
        raise ValueError("pairs are added to an index of one generation: build or compact it first")
    spark, path = index.spark, index.path
    total = index.corpus_stats().filter("scope = 'all'").first()
    least = total["n"] * share if total else 0
    frequent = sorted(row["term"] for row in index.term_stats(scope="all").filter(F.col("df") > least).select("term").collect())
    if not frequent:
        return index
    _write_pairs(spread(items, size), path, 0, index.config, index.buckets, frequent)
    _commit(spark, path, 0, index.config, index.buckets, "\n".join(last_batches(index.sources)), "overwrite", frequent)
    return open_index(spark, path)


def _write_pairs(items: DataFrame, path: str, gen: int, config: str, buckets: int, frequent: list[str]) -> None:
    _write_packed(packed(items, config, buckets, frequent), f"{path}/pairs", gen, "id", "live", "term", "positions")


def batch_of(source: str) -> tuple[str, int]:
    """(stream, number) of a batch's name; a name without a number is a stream with one batch."""
    stream, mark, number = source.rpartition("#")
    return (stream, int(number)) if mark and number.isdecimal() else (source, 0)


def is_committed(source: str, sources: tuple[str, ...]) -> bool:
    stream, number = batch_of(source)
    return any(known == stream and number <= last for known, last in map(batch_of, sources))


def last_batches(sources: tuple[str, ...]) -> list[str]:
    """The last batch of every stream: all that an index has to remember, as batches come in order."""
    last: dict[str, str] = {}
    for source in sorted(sources, key=batch_of):
        last[batch_of(source)[0]] = source
    return sorted(last.values())


def _difference(new: DataFrame, old: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    minus = old.withColumns({s: -F.col(s) for s in sums})
    summed = new.unionByName(minus).groupBy(*keys).agg(*[F.sum(s).alias(s) for s in sums])
    return summed.filter(" OR ".join(f"{s} <> 0" for s in sums))


def add_generation(index: SearchIndex, old: DataFrame, new: DataFrame, source: str) -> SearchIndex:
    """Makes changed rows searchable: ``new`` rows replace the ``old`` rows of
    the same ids. ``source`` names the batch (``stream#number``): one that is
    committed, or has a smaller number than a committed one of its stream, is left
    alone, so a replayed batch changes nothing. One writer at a
    time: its generation is the one after the last."""
    spark, path, config, buckets = index.spark, index.path, index.config, index.buckets
    index = open_index(spark, path)
    if is_committed(source, index.sources):
        return index
    gen = max(index.generations) + 1
    new_posts = postings(new, config).withColumn("bucket", bucket_of(F.col("term"), buckets))
    _write(new_posts, f"{path}/postings", gen, ["type", "bucket"], ["term", "id"])
    written = spark.read.schema(POSTINGS).parquet(f"{path}/postings").filter(F.col("gen") == gen)
    if index.frequent:
        _write_pairs(new, path, gen, config, buckets, sorted(index.frequent))
    _write(new.select("id"), f"{path}/retired", gen, [], ["id"])
    old_posts = stage(postings(old, config).drop("positions"), "before")
    terms = _difference(term_stats(written), term_stats(old_posts), ["scope", "term"], ["df"])
    _write(terms.withColumn("bucket", bucket_of(F.col("term"), buckets)), f"{path}/term_stats", gen, ["bucket"], ["term", "scope"])
    corpus = _difference(corpus_stats(new, written), corpus_stats(old, old_posts), ["scope"], ["n", "total_dl"])
    _write(corpus, f"{path}/corpus_stats", gen, [], ["scope"])
    retired = spark.read.schema(RETIRED).parquet(f"{path}/retired").filter(F.col("gen") == gen).count()
    _commit(spark, path, gen, config, buckets, source, retired=retired)
    return open_index(spark, path)


def _fold(index: SearchIndex, path: str, table: str) -> None:
    """The postings of all generations as one. Those of the first lie in their folders and are not shuffled
    again; the others, which are what was changed since, come as files beside theirs."""
    first, *others = index.generations
    keys, order = ["type", "bucket"], ["term", "id"]
    few = index.retired <= BROADCAST_ROWS  # beyond it the first one's rows are shuffled to leave out the retired
    _write(index.postings(table=table, generations=(first,)), f"{path}/{table}", 0, keys, order, laid=few)
    if others:
        _write(index.postings(table=table, generations=tuple(others)), f"{path}/{table}", 0, keys, order, "append")


def compact(index: SearchIndex, path: str) -> SearchIndex:
    """The same index as one generation in a new folder."""
    spark = index.spark
    _fold(index, path, "postings")
    _write(index.term_stats(), f"{path}/term_stats", 0, ["bucket"], ["term", "scope"])
    _write(index.corpus_stats(), f"{path}/corpus_stats", 0, [], ["scope"])
    if index.frequent:
        _fold(index, path, "pairs")
    _commit(spark, path, 0, index.config, index.buckets, "\n".join(last_batches(index.sources)), "overwrite", sorted(index.frequent))
    return open_index(spark, path)


