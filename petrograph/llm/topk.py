"""Exact top-k by inner product over norm-sorted vectors.

Vectors are turned into integers floor(256 * x).  The second-moment matrix (dimension squared
numbers, summed in the tasks) gives the SVD rotation that moves the weight to the first
coordinates.  Rows are range-partitioned by descending length and packed into blocks; each block
carries its vectors, its rotated vectors and the lengths of what each prefix of rotated coordinates
leaves out.

Queries, packed the same way, first meet the block of the longest vectors, which gives each query a
lower bound of its k-th score.  Pairs of blocks then drop out by the product of their greatest lengths.
In the rest, vectors are processed by descending length: by Cauchy-Schwarz, the partial sum over
the first rotated coordinates plus the product of the residual lengths bounds the score; only
vectors whose bound reaches the query's k-th best so far are scored, with exact integers.

Defined cases: null vectors and vectors that hold null or non-finite components take no part, nor
do rows with a null vec_id; vectors of different dimension are compared over the components that
both have; equal scores go to the smaller vec_id; a row is not a candidate for a query with its own
vec_id; repeated rows are candidates each; repeated queries are answered once per vec_id and vector;
an empty table gives an empty result; components must stay below 2**20 in absolute value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from petrograph.llm.common import batch, columns, saved

SCALE, QUERY_EVERY, K = 256, 50, 5
#: Vectors of a block, and queries of a block.
BLOCK, QUERY_BLOCK = 4096, 512
#: Rotated coordinates after which the bound is taken.
STEPS = (8, 24)
#: Vectors of a block scored at once, in descending length.
RUN = 512
#: Parts into which the pairs of block numbers are dealt.
LANES = 64


def integers(embeddings: DataFrame) -> DataFrame:
    """vec_id and v (array<double> of whole numbers) of the rows that take part."""
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(x * SCALE).cast("double"))
    whole = ~F.exists(F.col("embedding").cast("array<double>"), lambda x: x.isNull() | F.isnan(x)
                      | (F.abs(x) == float("inf")))
    return (embeddings.filter(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()).filter(whole)
            .select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v")))


def matrix(lists: pa.ListArray, dim: int) -> np.ndarray:
    """Rows of doubles, shorter vectors filled up with zeros."""
    offsets = np.asarray(lists.offsets)
    size = np.diff(offsets)
    out = np.zeros((len(lists), dim))
    flat = lists.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]]
    row = np.repeat(np.arange(len(lists)), size)
    out[row, np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], size)] = flat
    return out


def rotation(vectors: DataFrame, dim: int) -> np.ndarray:
    """Orthogonal matrix whose columns are the right singular vectors, greatest first."""
    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for b in batches:
            m = matrix(b.column(b.schema.get_field_index("v")), dim)
            total += m.T @ m
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)),
                                          pa.array(total[i, j])], names=["i", "j", "x"])

    rows = (vectors.select("v").mapInArrow(moments, "i int, j int, x double").groupBy("i", "j")
            .agg(F.sum("x").alias("x")).collect())  # at most dim * dim rows
    total = np.zeros((dim, dim))
    for r in rows:
        total[r.i, r.j] = r.x
    values, axes = np.linalg.eigh((total + total.T) / 2)
    return axes[:, np.argsort(-values)]


def residuals(rotated: np.ndarray) -> np.ndarray:
    """Lengths of what the first STEPS coordinates leave out, one column for each step."""
    return np.stack([np.sqrt((rotated[:, s:] ** 2).sum(axis=1)) for s in STEPS], axis=1)


def packed(vectors: DataFrame, axes: np.ndarray, size: int, name: str) -> DataFrame:
    """Blocks of vectors in descending length: block, longest, n, ids, vectors, rotated, residuals."""
    dim = len(axes)
    out = pa.schema([("longest", pa.float64()), ("n", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary()),
                     ("rotated", pa.binary()), ("residuals", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows = np.empty(0, dtype=np.int64), np.empty((0, dim))

        def block(i, m):
            turned = m @ axes
            return batch(out, [[float(np.sqrt((m[0] ** 2).sum()))], [len(i)], [i.tobytes()], [m.tobytes()],
                               [turned.tobytes()], [residuals(turned).tobytes()]])

        for b in batches:
            ids = np.concatenate((ids, np.array(columns(b, "vec_id")[0], dtype=np.int64)))
            rows = np.concatenate((rows, matrix(b.column(b.schema.get_field_index("v")), dim)))
            while len(ids) >= size:
                yield block(ids[:size], rows[:size])
                ids, rows = ids[size:], rows[size:]
        if len(ids):
            yield block(ids, rows)

    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    ranged = (vectors.withColumn("_len", length).repartitionByRange(F.desc("_len"), "vec_id")
              .sortWithinPartitions(F.desc("_len"), "vec_id"))
    made = ranged.select("vec_id", "v").mapInArrow(
        pack, "longest double, n int, ids binary, vectors binary, rotated binary, residuals binary")
    return saved(made.withColumn("block", F.monotonically_increasing_id()), name)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]


def search_block(q: dict, c: dict, floor: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query place, vec_id, score): each query's best k of the block that reach its floor."""
    found: list[tuple[int, int, int]] = []
    top = [(np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)) for _ in range(len(q["ids"]))]
    floor = floor.copy()
    reach = np.sqrt((q["vectors"] ** 2).sum(axis=1))
    lengths = np.sqrt((c["vectors"] ** 2).sum(axis=1))
    active = np.arange(len(floor))
    for at in range(0, len(c["ids"]), RUN):
        end = min(at + RUN, len(c["ids"]))
        active = active[reach[active] * lengths[at] * (1 + 1e-9) >= floor[active]]   # lengths only shrink from here
        if not len(active):
            break
        partial, done = np.zeros((len(active), end - at)), 0
        alive = np.ones(partial.shape, dtype=bool)
        for s, step in enumerate(STEPS):
            partial += q["rotated"][active, done:step] @ c["rotated"][at:end, done:step].T
            done = step
            bound = partial + np.outer(q["residuals"][active, s], c["residuals"][at:end, s])
            slack = 1e-9 * np.outer(reach[active], lengths[at:end]) + 1e-6
            alive &= bound + slack >= floor[active][:, None]
            if not alive.any():
                break
        for row in np.flatnonzero(alive.any(axis=1)):
            place = active[row]
            cand = at + np.flatnonzero(alive[row])
            cand = cand[c["ids"][cand] != q["ids"][place]]
            if not len(cand):
                continue
            score = (c["vectors"][cand].astype(np.int64) @ q["vectors"][place].astype(np.int64))
            ids, scores = np.concatenate((top[place][0], c["ids"][cand])), np.concatenate((top[place][1], score))
            keep = best(ids, scores, k)
            top[place] = ids[keep], scores[keep]
            if len(keep) == k:
                floor[place] = max(floor[place], scores[keep[-1]])
    for place, (ids, scores) in enumerate(top):
        found += [(place, int(i), int(s)) for i, s in zip(ids, scores, strict=True)]
    return found


HIT = pa.schema([("query_id", pa.int64()), ("place", pa.int32()), ("qblock", pa.int64()), ("vec_id", pa.int64()),
                 ("score", pa.int64())])


def searched(pairs: DataFrame, dim: int, k: int) -> DataFrame:
    """Hits of joined query and candidate blocks (columns of queries start with q_)."""
    def opened(b: pa.RecordBatch, i: int, prefix: str) -> dict:
        get = lambda n, kind, width: np.frombuffer(
            b.column(b.schema.get_field_index(prefix + n))[i].as_py(), dtype=kind).reshape(width)
        return {"ids": get("ids", np.int64, (-1,)), "vectors": get("vectors", np.float64, (-1, dim)),
                "rotated": get("rotated", np.float64, (-1, dim)),
                "residuals": get("residuals", np.float64, (-1, len(STEPS)))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                q, c = opened(b, i, "q_"), opened(b, i, "")
                floors = b.column(b.schema.get_field_index("floor"))[i]
                floor = np.array(floors.as_py(), dtype=np.float64) if floors.is_valid \
                    else np.full(len(q["ids"]), -np.inf)
                block = b.column(b.schema.get_field_index("q_block"))[i].as_py()
                hits = search_block(q, c, floor, k)
                yield batch(HIT, [[int(q["ids"][p]) for p, _, _ in hits], [p for p, _, _ in hits], [block] * len(hits),
                                  [v for _, v, _ in hits], [s for _, _, s in hits]])

    return pairs.mapInArrow(run, "query_id bigint, place int, qblock bigint, vec_id bigint, score bigint")


def top_k(embeddings: DataFrame, k: int = K, every: int = QUERY_EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all rows for every row whose vec_id is divisible by ``every``."""
    vectors = saved(integers(embeddings), "vectors")
    dim = vectors.agg(F.max(F.size("v"))).first()[0] or 1
    axes = rotation(vectors, dim)
    blocks = packed(vectors, axes, BLOCK, "blocks")
    asked = vectors.filter(F.col("vec_id") % every == 0).distinct()
    queries = packed(asked, axes, QUERY_BLOCK, "queries")
    queries = queries.select(*(F.col(c).alias(f"q_{c}") for c in queries.columns))
    first = blocks.orderBy(F.desc("longest"), "block").limit(1)   # one block of at most BLOCK vectors
    none = F.lit(None).cast("array<double>")
    seeds = saved(searched(queries.withColumn("_j", F.lit(1)).join(F.broadcast(first.withColumn("_j", F.lit(1))), "_j")
                           .repartition("q_block").withColumn("floor", none), dim, k), "seeds")
    place = W.partitionBy("qblock", "place").orderBy(F.desc("score"), "vec_id")
    kth = (seeds.withColumn("_r", F.row_number().over(place)).filter(F.col("_r") == k)
           .select("qblock", "place", F.col("score").cast("double").alias("low")))
    sizes = queries.select(F.col("q_block").alias("qblock"), F.explode(F.sequence(F.lit(0), F.col("q_n") - 1))
                           .alias("place"))
    floors = (sizes.join(kth, ["qblock", "place"], "left")
              .groupBy("qblock").agg(F.sort_array(F.collect_list(F.struct("place", F.coalesce("low", F.lit(-float("inf")))
                                                                          .alias("low")))).alias("_l"))
              .select(F.col("qblock").alias("q_block"), F.col("_l.low").alias("floor")))
    known = saved(queries.join(floors, "q_block"), "floors")
    # A pair of blocks is needed if its greatest lengths can reach the block's lowest floor.
    numbers = known.select("q_block", "q_longest", F.array_min("floor").alias("low"))
    held = blocks.select("block", "longest").join(first.select(F.col("block").alias("_first")),
                                                  F.col("block") == F.col("_first"), "left_anti")
    lane = F.pmod(F.xxhash64("q_block"), F.lit(LANES)).cast("int")   # deals out the pairs of block numbers
    needed = held.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(LANES - 1)))) \
        .join(numbers.withColumn("_j", lane), "_j") \
        .filter((F.col("low") <= 0) | (F.col("longest") * F.col("q_longest") * (1 + 1e-9) >= F.col("low"))) \
        .select("block", "q_block")
    rest = searched(needed.join(blocks, "block").join(known, "q_block").repartition("block", "q_block"), dim, k)
    ranked = seeds.select("query_id", "vec_id", "score", "place", "qblock") \
        .unionByName(rest.select("query_id", "vec_id", "score", "place", "qblock")) \
        .withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
