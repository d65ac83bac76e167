"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Every source gets a target number of words: its weight's share of all words, at most three times
its own size, what exceeds that being reshared by weight among the others.  Whole epochs come
first (every document of the source once each); the rest of the target is sampled without
replacement: each document draws the exponential key -ln(u) / weight, u from its doc_id's hash and
weight from its quality, and documents are taken by ascending key until the rest is used up.  The
last one taken is cut at the budget, so a source's words match its target to within one.

Running sums never put a source into one task: documents are range-partitioned by (source, key),
summed per part and source, and the parts' sums (a row for each part and source) give each part its
offset.

The quality weight grows with the words and falls with the share of markup symbols.

Defined cases: a null text has size 0 and takes 0; a null source is a source of its own, last in
order; sources of size 0 have target 0; equal keys are ordered by doc_id, then size, then text hash;
repeated rows are documents of their own; an empty table gives an empty result; the seed is a
parameter, and reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from petrograph.llm.common import WORD, empty_text, saved

#: A word and the white space before it.
SPACED = r"[\x20\x09-\x0D]*" + WORD
#: Most epochs of a source; the weights that sources carry in turn.
MAX_EPOCHS, WEIGHTS = 3, (1, 2, 3)


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def quality_weight(text: Column, size: Column) -> Column:
    """In (0, 1]: near 0 for texts of symbols or few words, near 1 for long clean ones."""
    marks = 1 - F.length(F.translate(text, "#*$%&|<>", "")) / F.greatest(F.length(text), F.lit(1))
    return F.greatest(F.lit(0.05), 1 - 4 * marks) * (size + 1) / (size + 20)


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target from (source, source_size); one row per source throughout.

    Ordered by the share at which a source reaches its cap, a source is capped if the words left
    by the capped ones before it, per unit of remaining weight, reach its cap.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)),
                          (F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    capped = sizes.withColumn("weight", weight.cast("double")) \
        .withColumn("cap", (MAX_EPOCHS * F.col("source_size")).cast("double")) \
        .withColumn("reach", F.col("cap") / F.col("weight"))
    everything = W.partitionBy()
    before = W.orderBy("reach", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    total = F.sum(F.col("source_size").cast("double")).over(everything)
    level = ((total - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
             / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    tried = capped.withColumn("level", level).withColumn("full", F.col("level") >= F.col("reach"))
    final = F.min(F.when(~F.col("full"), F.struct("reach", F.col("source").isNull(), "source", "level"))) \
        .over(everything)["level"]
    return tried.select("source", "source_size", F.when(F.col("full"), F.col("cap"))
                        .otherwise(F.col("weight") * final).alias("target"))


def mixed(documents: DataFrame, seed: int = 17) -> DataFrame:
    """doc_id, size, source_size, target, taken, source and a hash of the text for each row."""
    text = empty_text()
    sized = documents.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"),
        words(text).alias("size"), F.xxhash64(text).alias("text_hash"), text.alias("_whole"))
    unit = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    drawn = sized.withColumn("_key", -F.log(unit) / quality_weight(F.col("_whole"), F.col("size"))).drop("_whole")
    parts = saved(drawn.repartitionByRange(F.col("source").asc_nulls_last(), "_key", "doc_id", "size", "text_hash")
                  .withColumn("_part", F.spark_partition_id()), "mix")
    sums = parts.groupBy("source", "_part").agg(F.sum("size").alias("_sum"))
    earlier = W.partitionBy("source").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    goals = targets(sums.groupBy("source").agg(F.sum("_sum").alias("source_size")))
    offsets = (sums.withColumn("_offset", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
               .join(goals.withColumnRenamed("source", "_goal"), F.col("source").eqNullSafe(F.col("_goal")))
               .select(F.col("source").alias("_source"), F.col("_part").alias("_p"), "_offset", "source_size", "target"))
    within = W.partitionBy("_part", "source").orderBy("_key", "doc_id", "size", "text_hash") \
        .rowsBetween(W.unboundedPreceding, -1)
    placed = (parts.withColumn("_run", F.coalesce(F.sum("size").over(within), F.lit(0)))
              .join(offsets, (F.col("_part") == F.col("_p")) & F.col("source").eqNullSafe(F.col("_source"))))
    epochs = F.when(F.col("source_size") > 0,
                    F.least(F.lit(MAX_EPOCHS), F.floor(F.col("target") / F.col("source_size")))).otherwise(F.lit(0))
    rest = F.round(F.col("target") - epochs * F.col("source_size")).cast("bigint")
    some = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_offset") - F.col("_run")))
    return placed.select("doc_id", "size", "source_size", "target",
                         (epochs.cast("bigint") * F.col("size") + some).alias("taken"), "source", "text_hash")


def mixture(documents: DataFrame, seed: int = 17) -> DataFrame:
    """The mix itself: every document as often as it is taken, the last time cut after its budget's last word.

    Only ids, sizes and hashes are ordered and summed; the texts are shuffled once, to meet their
    decisions.  Rows alike in doc_id, source and text are written from one of them.
    """
    names = documents.columns
    taken = (mixed(documents, seed).groupBy("doc_id", "source", "text_hash", "size")
             .agg(F.sum("taken").alias("_taken")).filter("_taken > 0")
             .select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), "text_hash", "size", "_taken"))
    keyed = documents.select(F.struct(*names).alias("_row"), F.col("doc_id").cast("bigint").alias("_id"),
                             F.col("source").cast("string").alias("_source"),
                             F.xxhash64(empty_text()).alias("text_hash")) \
        .dropDuplicates(["_id", "_source", "text_hash"])
    t = taken.alias("t")
    both = keyed.alias("d").join(t, F.col("d._id").eqNullSafe(F.col("t._id"))
                                 & F.col("d._source").eqNullSafe(F.col("t._source"))
                                 & (F.col("d.text_hash") == F.col("t.text_hash")))
    whole = F.floor(F.col("_taken") / F.col("size")).cast("int")
    part = F.col("_taken") - whole * F.col("size")
    each = both.select("d._row", F.explode(F.filter(
        F.concat(F.array_repeat(F.lit(-1).cast("bigint"), whole), F.array(part)), lambda n: n != 0)).alias("_copy"))
    cut = F.array_join(F.slice(F.regexp_extract_all("_row.text", F.lit(SPACED), F.lit(0)), 1,
                               F.col("_copy").cast("int")), "")
    done = each.withColumn("_cut", F.when(F.col("_copy") > 0, cut).otherwise(F.col("_row.text")))
    out = {"text": F.col("_cut")}
    if "n_chars" in names:
        out["n_chars"] = F.when(F.col("_copy") > 0, F.length("_cut")).otherwise(F.col("_row.n_chars")) \
            .cast(documents.schema["n_chars"].dataType)
    return done.select(*(out.get(n, F.col(f"_row.{n}")).alias(n) for n in names))
