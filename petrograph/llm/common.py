"""Helpers shared by the operators: words, hashes, minimizer anchors, Arrow batches."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from petrograph.plans.storage import cut_lineage, scratch_path
from petrograph.sources.tables import read_table

__all__ = ["WORD", "WORD_RE", "anchors", "batch", "bucketed", "chunks", "columns", "components", "cut_lineage",
           "discard", "documents", "empty_text", "likely_among", "mix", "read_table", "saved", "span_hash",
           "text_bytes", "window_hash", "word_ids", "word_spans"]

#: A word: a run of anything but blank, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)

#: Symbols handled at once; longer sequences go piece by piece, so memory follows this and not the text.
CHUNK = 1 << 20
_POSITION = np.uint64((1 << 24) - 1)
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit bijective finaliser (splitmix64), element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A random 64-bit value for each byte.
_SYMBOL = mix(np.arange(1, 257, dtype=np.uint64))


def text_bytes(text: str | None) -> np.ndarray:
    """The text's UTF-8 bytes (null: none)."""
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every word in UTF-8 bytes."""
    inside = np.zeros(len(raw) + 2, dtype=np.int8)
    inside[1:-1] = ~_SPACE[raw]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


#: Spans of so many bytes are hashed one by one: a polynomial modulo 2**64 maps some pairs of long words to one
#: value whatever its base (from about 512 bytes on; far shorter words can't be such a pair).
LONG_SPAN = 128


def span_hash(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, the same wherever the span lies."""
    from xxhash import xxh3_64_intdigest

    if not len(begin):
        return np.empty(0, dtype=np.uint64)
    up, down = _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_SYMBOL[raw] * down[:len(raw)], out=total[1:])
    out = mix((total[end] - total[begin]) * up[begin] + (end - begin).astype(np.uint64))
    for i in np.flatnonzero(end - begin >= LONG_SPAN):
        out[i] = xxh3_64_intdigest(raw[begin[i]:end[i]].tobytes())
    return out


def word_ids(raw: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words, in order."""
    return span_hash(raw, *word_spans(raw))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 17)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def window_hash(symbols: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k consecutive symbols (64-bit values), by differences of one running sum."""
    n = len(symbols) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    up, down = _powers(len(symbols))
    total = np.empty(len(symbols) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(symbols * down[:len(symbols)], out=total[1:])
    return mix((total[k:] - total[:-k]) * up[:n])


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n, length = len(x) - w + 1, 1
    while length * 2 <= w:
        x = np.minimum(x[:-length], x[length:])
        length *= 2
    return np.minimum(x[:n], x[w - length:w - length + n])


def anchors(grams: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimizers: the smallest of w consecutive gram hashes, the last one among equals.

    Returns (anchor position, first window start, last window start).  Each window start belongs to
    one anchor, and where the anchor lies in a window follows from the window's content alone.
    """
    n = len(grams) - w + 1
    if n <= 0:
        none = np.empty(0, dtype=np.int64)
        return none, none, none
    at = np.arange(len(grams), dtype=np.uint64)
    low = _sliding_min((grams & ~_POSITION) | (_POSITION - at), w)
    position = (_POSITION - (low & _POSITION)).astype(np.int64)
    cut = np.flatnonzero(np.diff(position)) + 1
    first = np.concatenate(([0], cut)).astype(np.int64)
    return position[first], first, np.concatenate((cut - 1, [n - 1])).astype(np.int64)


def chunks(n: int, window: int, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """(begin, end) of pieces of n symbols; every window of ``window`` symbols starts in exactly one."""
    starts = n - window + 1
    for begin in range(0, max(starts, 0), size):
        yield begin, min(begin + size, starts) + window - 1


def columns(b: pa.RecordBatch, *names: str) -> list[list]:
    return [b.column(b.schema.get_field_index(n)).to_pylist() for n in names]


def batch(schema: pa.Schema, cols: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(cols, schema, strict=True)],
        schema=schema)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def empty_text(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def saved(df: DataFrame, name: str, *folders: str) -> DataFrame:
    """df written as Parquet into the shared folder and read back: cuts the lineage and outlives executors.

    Columns named in ``folders`` become folders, so that a filter on them reads only its own files.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.partitionBy(*folders).parquet(path) if folders else df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._petrograph_path = path
    return out


def bucketed(df: DataFrame, key: str, name: str, ordered: bool = False) -> DataFrame:
    """As saved, in buckets of ``key`` (sorted by it, if ordered): joins on it shuffle their other side only."""
    spark = df.sparkSession
    path, table = scratch_path(spark, name), f"{name}_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = df.repartition(n, key).write.format("parquet").option("path", path).bucketBy(n, key)
    (writer.sortBy(key) if ordered else writer).saveAsTable(table)
    out = spark.table(table)
    out._petrograph_path, out._petrograph_table = path, table
    return out


#: Words of 64 bits in the bitmap of likely_among: its size is fixed, whatever the tables.
FILTER_WORDS = 1 << 20


def likely_among(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows whose bigint ``key`` may be among ids (one bigint column), and few others.

    A bitmap of at most FILTER_WORDS words, one bit an id, is broadcast, so rows that an exact join
    would drop anyway needn't be shuffled for it.  It never drops a row that the join keeps; with more
    ids than bits it only lets more of the others through.  Null keys go.
    """
    hashed = ids.toDF("_id").select(F.xxhash64("_id").alias("_h"))
    bitmap = hashed.groupBy(F.pmod("_h", F.lit(FILTER_WORDS)).alias("_word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(shiftrightunsigned(_h, 58) AS int))")).alias("_bits"))
    tagged = rows.filter(F.col(key).isNotNull()).withColumn("_h", F.xxhash64(key))
    return (tagged.join(F.broadcast(bitmap), F.pmod("_h", F.lit(FILTER_WORDS)) == F.col("_word"))
            .filter(F.expr("getbit(_bits, cast(shiftrightunsigned(_h, 58) AS int)) = 1"))
            .select(*rows.columns))


def discard(*tables: DataFrame) -> None:
    """Delete saved tables that nothing reads any more."""
    for df in tables:
        if hasattr(df, "_petrograph_table"):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {df._petrograph_table}")
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._petrograph_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def _fingerprint(edges: DataFrame) -> tuple:
    """Two numbers that tell one set of edges from another."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over the undirected edges (a, b), by star contraction.

    Alternates large-star and small-star steps until nothing changes; every step is a partial
    aggregate and a join on node ids, so the rounds grow with the logarithm of the longest path.
    """
    now = saved(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
                .filter("hi <> lo").distinct(), "cc")
    before = _fingerprint(now)
    while True:
        both = now.union(now.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        low = both.groupBy("hi").agg(F.min("lo").alias("m")).select("hi", F.least("hi", "m").alias("m"))
        large = (both.join(low, "hi").filter("lo > hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
                 .filter("hi <> lo").distinct())
        first = saved(large, "cc")
        low = first.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (first.join(low, "hi").select(F.explode(F.array(
            F.struct(F.col("hi"), F.col("m").alias("lo")),
            F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e")).select("e.*")
            .filter("hi <> lo").distinct())
        after = saved(small, "cc")
        discard(first)
        mark = _fingerprint(after)
        same, before = mark == before, mark
        discard(now)
        now = after
        if same:
            return now.select(F.col("hi").alias("id"), F.col("lo").alias("component"))
