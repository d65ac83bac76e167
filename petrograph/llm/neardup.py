"""MinHash near-duplicates with odd sketches.

Words are lower-cased (A-Z only); a document's set holds the hashes of its distinct five-word
shingles, or of its whole word sequence if it has fewer words.  Documents are linked when
100 * intersection >= 75 * union.

1. One pass over the texts gives every document the digest of its set, 32 band keys of four
   MinHash values each, and an odd sketch: the 128 MinHash samples folded into a bitmap of
   parities.  Two sketches' exclusive-or has few bits set exactly when the samples agree.
2. Documents with the same set are one class from here on (its smallest doc_id stands for it).
3. Star step: in each band bucket every class is compared with the bucket's smallest id, so a
   bucket of n members gives n pairs.  Of the pairs that the sketches let through, each class's
   closest one is confirmed on the full sets.
4. Rest step, in rounds: buckets that still hold two or more components are compared block against
   block inside the tasks (sketches only, members of the leading component against the rest and the
   rest with itself).  In the first rounds every class of the rest confirms its few closest
   candidates of other components on the full sets, which joins nearly all that belong together; the
   last round confirms all that wide sketches (eight times the samples, made from the full sets of
   those still apart) let through.  So any two linked classes that share a bucket end in one component, without a pair for every two members.
5. Components by star contraction.

A pair at similarity 0.75 shares no bucket with a chance of 5e-6, and falls to the sketch bound
with a chance below 1e-6; both shrink fast above 0.75.

Defined cases: null or empty texts and texts without words have an empty set and are linked with
nothing; rows with a null doc_id are linked with nothing and kept, component_id null; rows that
repeat a doc_id are each judged by their own text, and a link of either holds for the id; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from petrograph.llm.common import (batch, bucketed, columns, components, discard, likely_among, mix, saved,
                                   text_bytes, window_hash, word_ids)

SHINGLE, PERCENT = 5, 75
BANDS, ROWS = 32, 4
SKETCH_BITS = 512
#: Most differing sketch bits of a candidate: 56.6 are expected at similarity 0.75, with a deviation of 8.7.
MOST_BITS = 98
#: The same for the wide sketch of the last round: 1024 samples in 2048 bits, 403 expected with a deviation of 22.
WIDE_SAMPLES, WIDE_BITS, WIDE_MOST = 1024, 2048, 508
#: Rounds of the rest step: closest candidates that a class has confirmed in each; the last has no limit.
ROUNDS = (4, 8, None)
#: Members of a bucket compared with each other at once.
BLOCK = 512

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_FACTORS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)
_WIDE = mix(np.arange(1001, 1001 + WIDE_SAMPLES, dtype=np.uint64)) | np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    ids = word_ids(_LOWER[text_bytes(text)])
    if 0 < len(ids) < SHINGLE:
        return mix(window_hash(ids, len(ids)) + np.uint64(len(ids)))
    return np.unique(window_hash(ids, SHINGLE))


def minhashes(grams: np.ndarray, factors: np.ndarray = _FACTORS) -> np.ndarray:
    """The smallest value of the set under each multiplier."""
    low = np.full(len(factors), np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(grams), 1024):
        np.minimum(low, (grams[i:i + 1024, None] * factors).min(axis=0), out=low)
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band, different between bands."""
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for part in low.reshape(BANDS, ROWS).T:
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + part)
    return key.view(np.int64)


def odd_sketch(low: np.ndarray, size: int = SKETCH_BITS) -> np.ndarray:
    """Bit = parity of the number of samples (index and value) that fall on it."""
    bit = mix(low + np.arange(len(low), dtype=np.uint64)) % np.uint64(size)
    return np.packbits(np.bincount(bit.astype(np.int64), minlength=size) & 1).view(np.int64)


def band_marks(bands: np.ndarray) -> np.ndarray:
    """16 bits of each band key, four to a 64-bit value: enough to tell, mostly, which band two documents share first."""
    return (bands & 0xFFFF).astype(np.uint16).view(np.int64)


PROFILE = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()),
                     ("bands", pa.list_(pa.int64())), ("marks", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))])
PROFILE_DDL = "doc_id bigint, n_shingles bigint, set_key binary, bands array<bigint>, marks array<bigint>, sketch array<bigint>"


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for b in batches:
        rows = []
        for doc_id, text in zip(*columns(b, "doc_id", "text"), strict=True):
            grams = shingles(text)
            if len(grams):
                low = minhashes(grams)
                bands = band_keys(low)
                rows.append((doc_id, len(grams), xxhash.xxh3_128_digest(grams.tobytes()), bands, band_marks(bands),
                             odd_sketch(low)))
            else:
                rows.append((doc_id, 0, None, None, None, None))
        yield batch(PROFILE, [list(c) for c in zip(*rows, strict=True)] or [[]] * 6)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = pa.schema([("id", pa.int64()), ("grams", pa.binary())])
    for b in batches:
        ids, texts = columns(b, "doc_id", "text")
        yield batch(out, [ids, [shingles(t).tobytes() for t in texts]])


def _wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = pa.schema([("id", pa.int64()), ("sketch", pa.list_(pa.int64()))])
    for b in batches:
        ids, sets = columns(b, "id", "grams")
        yield batch(out, [ids, [odd_sketch(minhashes(np.frombuffer(g, dtype=np.uint64), _WIDE), WIDE_BITS)
                                for g in sets]])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    for part in batches:
        hit = []
        for a, b, x, y in zip(*columns(part, "a", "b", "x", "y"), strict=True):
            x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
            at = np.searchsorted(y, x)
            both = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0
            if both and 100 * both >= PERCENT * (len(x) + len(y) - both):
                hit.append((a, b))
        yield batch(out, [list(c) for c in zip(*hit, strict=True)] or [[], []])


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets (id, grams) are similar enough."""
    both = (pairs.join(sets.select(F.col("id").alias("a"), F.col("grams").alias("x")), "a")
            .join(sets.select(F.col("id").alias("b"), F.col("grams").alias("y")), "b"))
    return saved(both.mapInArrow(_linked, "a bigint, b bigint").distinct(), "links")


def differing_bits(a: str, b: str):
    """Bits in which two sketch columns differ, as a column."""
    return sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(SKETCH_BITS // 64)), F.lit(0))


def _rest(limit: int | None, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Candidates in each unit; a unit's block (side 0) comes before what it is held against."""
        out = pa.schema([("me", pa.int64()), ("other", pa.int64()), ("far", pa.int64())])
        unit, block = None, None
        for part in batches:
            units, sides, ids, labels, sketches, bands, keys, late = columns(
                part, "unit", "side", "id", "label", "sketch", "bands", "key", "late")
            if not ids:
                continue
            bits = np.array(sketches, dtype=np.int64).view(np.uint64)
            ids, labels, sides = np.array(ids, dtype=np.int64), np.array(labels, dtype=np.int64), np.array(sides)
            units, keys, late = np.array(units, dtype=np.int64), np.array(keys, dtype=np.int64), np.array(late)
            bands = np.array(bands, dtype=np.int64).reshape(len(ids), -1)
            if limit:
                bands, keys = bands.view(np.uint16), (keys & 0xFFFF).astype(np.uint16)
            cuts = np.flatnonzero((np.diff(units) != 0) | (np.diff(sides) != 0)) + 1
            for s in np.split(np.arange(len(ids)), cuts):
                if sides[s[0]] == 0:
                    fresh = unit != units[s[0]] or block is None
                    unit = units[s[0]]
                    mine = (ids[s], labels[s], bits[s], bands[s])
                    block = mine if fresh else tuple(np.concatenate(p) for p in zip(block, mine, strict=True))
                    continue
                if unit != units[s[0]]:
                    continue
                for i in range(0, len(s), BLOCK):
                    t = s[i:i + BLOCK]
                    far = np.bitwise_count(block[2][:, None, :] ^ bits[t][None, :, :]).sum(axis=2, dtype=np.int64)
                    far[block[1][:, None] == labels[t][None, :]] = WIDE_BITS + 1
                    if limit and len(t) > limit:
                        near = np.argpartition(far, limit - 1, axis=1)[:, :limit]
                        x, y = np.repeat(np.arange(len(far)), limit), near.ravel()
                    else:
                        x, y = np.divmod(np.arange(far.size), len(t))
                    good = far[x, y] <= most
                    if not limit:              # a pair comes from one side only
                        good &= ~late[t][y] | (block[0][x] < ids[t][y])
                    # A pair comes from the first bucket it shares only.  A class's closest ones are among the
                    # closest in any bucket that they share with it, so none is left out by that.
                    x, y = x[good], y[good]
                    shared = block[3][x] == bands[t][y]
                    good = block[3][x, shared.argmax(axis=1)] == keys[t][y]
                    x, y = x[good], y[good]
                    if len(x):
                        yield batch(out, [pa.array(block[0][x]), pa.array(ids[t][y]), pa.array(far[x, y])])

    return run


def rest_pairs(members: DataFrame, limit: int | None, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs across components in the buckets that hold more than one; members: key, id, label; nodes:
    id, sketch, bands; sets: id, grams.

    With a limit, each class's closest ones; without, all that wide sketches of the sets let through.

    The members outside the bucket's leading component are cut into blocks, and each block meets
    all members, cut into runs; a task holds one block, never a bucket.
    """
    lead = (members.groupBy("key").agg(F.min("label").alias("lead"), F.max("label").alias("top"))
            .filter("lead <> top").select("key", "lead"))
    inside = members.join(lead, "key")
    if limit:
        sketches = nodes.select("id", "sketch", F.col("marks").alias("bands"))
    else:
        wide = saved(sets.join(inside.select("id").distinct(), "id", "left_semi")
                     .mapInArrow(_wide, "id bigint, sketch array<bigint>"), "wide")
        sketches = nodes.select("id", "bands").join(wide, "id")
    sizes = inside.groupBy("key").agg(
        F.ceil(F.count(F.when(F.col("label") != F.col("lead"), 1)) / BLOCK).cast("int").alias("blocks"),
        F.ceil(F.count("*") / (8 * BLOCK)).cast("int").alias("runs"))
    rows = inside.join(sizes, "key").join(sketches, "id")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    run = F.pmod(F.xxhash64("id", F.lit(7)), F.col("runs")).cast("int")
    block = rows.filter("label <> lead").select(
        "key", own.alias("i"), F.explode(F.sequence(F.lit(0), F.col("runs") - 1)).alias("j"), F.lit(0).alias("side"),
        "id", "label", "sketch", "bands", F.lit(True).alias("late"))
    other = rows.select(
        "key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), run.alias("j"), F.lit(1).alias("side"),
        "id", "label", "sketch", "bands", (F.col("label") != F.col("lead")).alias("late"))
    units = block.union(other).withColumn("unit", F.xxhash64("key", "i", "j")).drop("i", "j")
    near = (units.repartition("unit").sortWithinPartitions("unit", "side")
            .mapInArrow(_rest(limit, MOST_BITS if limit else WIDE_MOST), "me bigint, other bigint, far bigint").distinct())
    if limit:
        near = near.withColumn("_n", F.row_number().over(Window.partitionBy("me").orderBy("far", "other"))) \
            .filter(F.col("_n") <= limit)
    return near.select(F.least("me", "other").alias("a"), F.greatest("me", "other").alias("b")).distinct()


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of documents (see the module's text)."""
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    profile = saved(docs.mapInArrow(_profile, PROFILE_DDL), "profile")
    classes = saved(profile.filter("set_key is not null and doc_id is not null").groupBy("set_key")
                    .agg(F.min("doc_id").alias("id")), "classes")
    nodes = saved(profile.join(classes, (profile["doc_id"] == classes["id"])
                               & (profile["set_key"] == classes["set_key"]))
                  .select("id", "bands", "marks", "sketch").dropDuplicates(["id", "sketch"]), "nodes")
    buckets = nodes.select("id", F.explode("bands").alias("key"))
    leads = buckets.groupBy("key").agg(F.min("id").alias("lead"), F.max("id").alias("top")) \
        .filter("lead <> top").select("key", "lead")
    members = saved(buckets.join(leads, "key"), "members")
    sketch = nodes.select(F.col("id").alias("b"), F.col("sketch").alias("y"))
    star = (members.filter("id <> lead").select(F.col("id").alias("a"), F.col("lead").alias("b")).distinct()
            .join(nodes.select(F.col("id").alias("a"), F.col("sketch").alias("x")), "a").join(sketch, "b")
            .withColumn("far", differing_bits("x", "y")).filter(F.col("far") <= MOST_BITS))
    closest = star.groupBy("a").agg(F.min(F.struct("far", "b")).alias("best")).select("a", F.col("best.b").alias("b"))
    inside = saved(members.select(F.col("id").alias("doc_id")).distinct(), "ids")
    sets = bucketed(likely_among(docs, "doc_id", inside).join(inside, "doc_id", "left_semi")
                    .mapInArrow(_sets, "id bigint, grams binary"), "id", "sets")
    links = confirmed(closest, sets)
    final = components(links)
    for limit in ROUNDS:
        named = (members.select("key", "id").join(final, "id", "left")
                 .select("key", "id", F.coalesce("component", "id").alias("label")))
        found = confirmed(saved(rest_pairs(named, limit, nodes, sets), "rest"), sets)
        links = links.union(found)
        final = components(links)
    discard(sets)
    member = classes.join(final, "id", "left").select("set_key", F.coalesce("component", "id").alias("component_id"))
    flat = (profile.select("doc_id", "n_shingles", "set_key").join(member, "set_key", "left")
            .join(final.select(F.col("id").alias("doc_id"), F.col("component").alias("own")), "doc_id", "left"))
    component = F.when(F.col("doc_id").isNotNull(),
                       F.least(F.coalesce("component_id", "doc_id"), F.coalesce("own", "doc_id")))
    return flat.select("doc_id", "n_shingles", component.alias("component_id"),
                       F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicated(documents: DataFrame) -> DataFrame:
    """One row of each group of near-duplicates, with all columns; rows without a doc_id all stay."""
    kept = near_duplicates(documents).filter("kept and doc_id is not null").select(F.col("doc_id").alias("_id")) \
        .distinct()
    names = documents.columns
    rows = documents.filter("doc_id is not null").select(F.struct(*names).alias("_row"),
                                                         F.col("doc_id").cast("bigint").alias("_doc"))
    order = Window.partitionBy("_doc").orderBy(F.xxhash64("_row.text"))
    one = rows.join(kept, F.col("_doc") == F.col("_id")).withColumn("_n", F.row_number().over(order)) \
        .filter("_n = 1").select(*(F.col(f"_row.{n}").alias(n) for n in names))
    return one.unionByName(documents.filter("doc_id is null"))
