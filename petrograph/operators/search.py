"""Substring search with a trigram index.

The index is one bucketed, sorted table of postings (trigram, kind, id): a posting for every distinct
three-character piece of the lower-cased text.  A query of three characters or more reads the postings of
its own trigrams only: the buckets of the others are pruned from the scan.  Rows that have the rarest
trigram are narrowed by the remaining ones, and what is left is confirmed on the texts by ``contains``, so the
result is that of a scan.  Shorter queries have no trigram and scan the texts.

Postings of a trigram are partially counted per query, never collected.  NULL texts match nothing; the empty
query matches every text; a row whose (kind, id) repeats is found by any of its texts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from petrograph.plans.storage import scratch_path

GRAM = 3


def grams(text: Column) -> Column:
    """Distinct trigrams of a text; none for NULL or fewer than three characters."""
    low = F.lower(text)
    last = F.char_length(low) - GRAM + 1
    at = F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1))))
    return F.array_distinct(F.transform(F.coalesce(at, F.array().cast("array<int>")), lambda i: F.substring(low, i, GRAM)))


def query_grams(q: str) -> list[str]:
    low = q.lower()
    return list(dict.fromkeys(low[i:i + GRAM] for i in range(len(low) - GRAM + 1)))


class TrigramIndex:
    """Index over (kind, id, text)."""

    def __init__(self, texts: DataFrame, buckets: int | None = None):
        self.spark: SparkSession = texts.sparkSession
        self.texts = texts.select("kind", "id", "text")
        n = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.table = f"trigrams_{uuid.uuid4().hex}"
        posted = self.texts.select(F.explode(grams(F.col("text"))).alias("gram"), "kind", "id").distinct()
        (posted.repartition(n, "gram").write.format("parquet").option("path", scratch_path(self.spark, "trigrams"))
         .bucketBy(n, "gram").sortBy("gram", "kind", "id").saveAsTable(self.table))

    def postings(self, gram: str) -> DataFrame:
        return self.spark.table(self.table).filter(F.col("gram") == gram).select("kind", "id")

    def candidates(self, q: str) -> DataFrame:
        """(kind, id) that have all trigrams of the query."""
        wanted = query_grams(q)
        sizes = {r["gram"]: r["n"] for r in self.spark.table(self.table).filter(F.col("gram").isin(wanted))
                 .groupBy("gram").agg(F.count(F.lit(1)).alias("n")).collect()}    # a number per trigram of the query
        rarest, *rest = sorted(wanted, key=lambda g: sizes.get(g, 0))
        out = self.postings(rarest)
        for g in rest:
            out = out.join(self.postings(g), ["kind", "id"], "left_semi")
        return out

    def search(self, q: str) -> DataFrame:
        """Rows (kind, id, text) whose text contains q, whatever the case."""
        hit = F.lower("text").contains(q.lower())
        if len(q.lower()) < GRAM:
            return self.texts.where(hit)
        return self.texts.join(self.candidates(q), ["kind", "id"], "left_semi").where(hit)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
