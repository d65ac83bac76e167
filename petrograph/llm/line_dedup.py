"""Line dedup over levelled sorted runs of line hashes, in DataFrame operations only.

A line's key is the line without white space at its ends, A-Z in lower case; keys found in at least
``min_docs`` documents lose all their lines.

1. Each document's line keys are hashed once (128 bits) into a table dealt into batches.
2. ``LineRuns`` is the index.  A batch is counted per key (each document once).  Keys that some run
   already counts to ``min_docs`` are settled: a merge anti-join of the runs takes them out, and the
   rest becomes a run of its own on level 0.  A run is a table in buckets of the hash, one sorted
   file each, so runs are merged, and anti-joined, without a shuffle of their own rows.
3. When a level holds ``FANOUT`` runs they are merged into one on the next level: counts are added,
   and what reaches ``min_docs`` becomes settled there.  So a key is rewritten once a level, and the
   number of runs follows the logarithm of the number of batches.
4. The frequent keys are those whose counts over all runs reach ``min_docs``.  Lines meet them by
   hash.  Keys that hold at least a ``HOT``-th of all (document, key) entries are fewer than HOT by
   that rule; they are broadcast.  All others are joined in a shuffle, where no key holds more than
   that share.
5. Only the places of the lines to drop go back to their documents, matched by doc_id and text digest.

Counts of settled keys stop growing, as nothing more is asked of them than that they are settled.

Defined cases: null and empty texts are one empty line, whose key has no code points and stays;
a document is a row, so rows that repeat a doc_id count each; rows alike in doc_id and text get the
same result each; null doc_ids match each other; other columns are ignored, whatever their names; an
empty table gives an empty result; a text's lines are held by one row, so memory follows the longest text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from petrograph.llm.common import bucketed, discard, empty_text, saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = " \t\n\x0b\x0c\r"
#: Runs of a level that are merged into one; batches that the query adds one after the other.
FANOUT, BATCHES = 3, 4
#: A key with at least this share (one in HOT) of all entries is looked up by broadcast.
HOT = 1000


def line_keys(text: Column) -> Column:
    """The keys of a text's lines, in order.  Texts of one byte a character take the faster lower()."""
    plain = F.octet_length(text) == F.char_length(text)
    lowered = F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.transform(F.split(lowered, "\n"), lambda line: F.btrim(line, F.lit(SPACES)))


def line_hashes(text: Column, least: int = 1) -> Column:
    """128-bit hashes of the line keys, in order; null where a key has fewer than ``least`` code points."""
    return F.transform(line_keys(text), lambda k: F.when(F.char_length(k) >= least, F.unhex(F.md5(k))))


class LineRuns:
    """The index: for each level its runs (hash binary, n bigint: documents that hold the line)."""

    def __init__(self, spark: SparkSession, min_docs: int = 10, fanout: int = FANOUT):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.levels: list[list[DataFrame]] = []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, entries: DataFrame) -> None:
        """Add a batch: one row (hash) for each document and key."""
        fresh = entries.groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
        for run in self.runs():
            fresh = fresh.join(run.filter(F.col("n") >= self.min_docs).select("hash"), "hash", "left_anti")
        self._push(0, bucketed(fresh, "hash", "line_run", ordered=True))

    def _push(self, level: int, run: DataFrame) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fanout:
            old, self.levels[level] = self.levels[level], []
            merged = bucketed(self._merged(old), "hash", "line_run", ordered=True)
            discard(*old)
            self._push(level + 1, merged)

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        """One row per hash over runs in equal buckets: full joins merge their sorted files as they lie."""
        out = runs[0]
        for run in runs[1:]:
            both = out.join(run.select(F.col("hash").alias("_h"), F.col("n").alias("_n")), F.col("hash") == F.col("_h"), "full")
            out = both.select(F.coalesce("hash", "_h").alias("hash"),
                              (F.coalesce("n", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("n"))
        return out

    def frequent(self) -> DataFrame:
        """hash, n of the keys found in at least ``min_docs`` documents (n stops growing some time after)."""
        if not self.runs():
            return self.spark.createDataFrame([], "hash binary, n bigint")
        return self._merged(self.runs()).filter(F.col("n") >= self.min_docs)

    def drop(self) -> None:
        discard(*self.runs())
        self.levels = []


def dropped_places(documents: DataFrame, min_docs: int = 10, least: int = 1, batches: int = BATCHES,
                   fanout: int = FANOUT) -> DataFrame:
    """doc_id, digest and the places (from 0) of the lines to drop, for each document that loses any."""
    spark = documents.sparkSession
    text = empty_text()
    hashed = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.md5(text).alias("digest"),
                              line_hashes(text, least).alias("hashes"))
    batch = F.pmod(F.xxhash64("digest", "doc_id"), F.lit(batches)).cast("int")
    lines = saved(hashed.withColumn("batch", batch), "lines", "batch")
    index = LineRuns(spark, min_docs, fanout)
    for b in range(batches):
        each = lines.filter(F.col("batch") == b).select(F.explode(F.array_distinct("hashes")).alias("hash"))
        index.add(each.filter("hash is not null"))
    frequent = saved(index.frequent(), "frequent")
    index.drop()
    entries = lines.agg(F.sum(F.size("hashes"))).first()[0] or 0
    often = F.col("n") >= max(min_docs, entries / HOT)
    placed = lines.select("doc_id", "digest", F.posexplode("hashes").alias("place", "hash")).filter("hash is not null")
    marked = placed.join(F.broadcast(frequent.filter(often).select(F.col("hash").alias("_hot"))),
                         F.col("hash") == F.col("_hot"), "left")
    hot = marked.filter("_hot is not null").select("doc_id", "digest", "place")
    rare = (marked.filter("_hot is null").join(frequent.filter(~often).select("hash"), "hash")
            .select("doc_id", "digest", "place"))
    found = saved(hot.union(rare).groupBy("doc_id", "digest").agg(F.collect_set("place").alias("places")), "places")
    discard(lines, frequent)
    return found


def without_common_lines(documents: DataFrame, min_docs: int = 10, least: int = 1, batches: int = BATCHES,
                         fanout: int = FANOUT) -> DataFrame:
    """doc_id, n_lines, n_dropped and the text of the lines that stay, for each row."""
    places = dropped_places(documents, min_docs, least, batches, fanout)
    text = empty_text()
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
    met = (docs.withColumn("digest", F.md5("text")).alias("d").join(
        places.alias("p"), F.col("d.doc_id").eqNullSafe(F.col("p.doc_id"))
        & (F.col("d.digest") == F.col("p.digest")), "left").select("d.doc_id", "d.text", "p.places"))
    # The struct binds the lines once, so that they aren't split again for each place.
    parts = F.array(F.struct(F.split("text", "\n").alias("lines"), F.col("places")))
    kept = F.element_at(F.transform(parts, lambda s: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(s["lines"]) - 1), s["places"]),
        lambda i: F.get(s["lines"], i)), "\n")), 1)
    n_lines = F.length("text") - F.length(F.translate("text", "\n", "")) + 1
    return met.select("doc_id", n_lines.cast("bigint").alias("n_lines"),
                      F.coalesce(F.size("places"), F.lit(0)).cast("bigint").alias("n_dropped"),
                      F.when(F.col("places").isNull(), F.col("text")).otherwise(kept).alias("text"))


def digests(kept: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256."""
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


#: The same rows in DuckDB SQL.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce("text", ''), chr(10)) AS lines FROM documents),
e AS (SELECT r, doc_id, generate_subscripts(lines, 1) AS i, unnest(lines) AS line FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key FROM e),
f AS (SELECT line_key FROM k WHERE length(line_key) >= 1 GROUP BY line_key HAVING count(DISTINCT r) >= 10)
SELECT any_value(k.doc_id) AS doc_id, count(*) AS n_lines, count(f.line_key) AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY i) FILTER (WHERE f.line_key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.line_key = f.line_key GROUP BY k.r"""
