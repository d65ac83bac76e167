"""Suffix-array dedup with a logarithmic index family.

Every byte covered by a 400-byte string that also starts elsewhere, in the same or another text, is
removed; strings are judged on the input.

1. Every 400-byte window has an anchor: the 200 consecutive bytes in it with the smallest hash (the
   last among equals), so equal windows have equal anchors at equal places.  One pass lists each
   distinct text's anchors.
2. At anchors that occur twice or more, the windows of an anchor form a context, the stretch of text
   that they cover.  Contexts that occur twice are repeated throughout.  The distinct contexts of
   an anchor meet in one task, in batches: a batch gets the suffix array of its windows (suffixes in
   the order of their first 400 bytes), which is merge-scanned against the levels of the index that
   are there already; equal strings of 400 bytes are repeats on both sides.  The batch then becomes
   a level, and levels of equal size merge, so there are as many as the logarithm of the batches.
   Contexts of an anchor with very many are first cut into cells of 16 windows, dealt out by the 385
   bytes that the windows of a cell have in common, so such an anchor is spread over tasks.
3. Each text gets the repeated windows of its contexts and drops the bytes that they cover.

Equal texts are one text in steps 1 and 2; each row of such a group loses everything if it has 400
bytes or more.

Defined cases: null or empty texts have no bytes and keep the empty string; texts under 400 bytes
keep everything; rows that repeat (with or without the same doc_id) are documents of their own; an
empty table gives an empty result; very long texts need memory in proportion to their length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from petrograph.llm.common import _SYMBOL, anchors, batch, chunks, columns, empty_text, saved, text_bytes, window_hash

WINDOW, GRAM = 400, 200
#: Windows of a cell, contexts of an anchor from which it is cut into cells, suffixes of a batch.
CELL, MANY, BATCH = 16, 1000, 20_000


def contexts(raw: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor hash, its place, first window start, last window start), piece by piece."""
    for begin, end in chunks(len(raw), WINDOW):
        grams = window_hash(_SYMBOL[raw[begin:end]], GRAM)
        at, first, last = anchors(grams, WINDOW - GRAM + 1)
        yield grams[at].view(np.int64), at + begin, first + begin, last + begin


PROFILE = pa.schema([("digest", pa.string()), ("anchors", pa.list_(pa.int64())), ("twice", pa.list_(pa.bool_()))])


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        digests, texts = columns(b, "digest", "text")
        lists, twice = [], []
        for text in texts:
            found = [h for h, _, _, _ in contexts(text_bytes(text))]
            values, n = np.unique(np.concatenate(found), return_counts=True) if found else ([], np.zeros(0))
            lists.append(values)
            twice.append(n > 1)
        yield batch(PROFILE, [digests, lists, twice])


def context_key(raw: np.ndarray, first: int, last: int) -> int:
    """Hash of the context's bytes."""
    import xxhash

    return xxhash.xxh3_64_intdigest(raw[first:last + WINDOW].tobytes()) - (1 << 63)


CONTEXT = pa.schema([("anchor", pa.int64()), ("context", pa.int64()), ("digest", pa.string()), ("n", pa.int64()),
                     ("place", pa.int32()), ("bytes", pa.binary())])
CONTEXT_DDL = "anchor bigint, context bigint, digest string, n bigint, place int, bytes binary"


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct contexts of each text at the anchors asked for."""
    for b in batches:
        rows, size = [], 0
        for text, digest, wanted in zip(*columns(b, "text", "digest", "wanted"), strict=True):
            raw, wanted = text_bytes(text), np.array(wanted, dtype=np.int64)
            held: dict[int, list] = {}
            for names, at, first, last in contexts(raw):
                hit = np.isin(names, wanted)
                for name, place, i, j in zip(names[hit].tolist(), at[hit].tolist(), first[hit].tolist(),
                                             last[hit].tolist(), strict=True):
                    key = context_key(raw, i, j)
                    if key in held:
                        held[key][3] = 2
                    else:
                        held[key] = [name, key, digest, 1, place - i, raw[i:j + WINDOW].tobytes()]
            for row in held.values():
                rows.append(row)
                size += len(row[5])
                if size > 8_000_000:
                    yield batch(CONTEXT, [list(c) for c in zip(*rows, strict=True)])
                    rows, size = [], 0
        if rows:
            yield batch(CONTEXT, [list(c) for c in zip(*rows, strict=True)])


CELLS = pa.schema([("shard", pa.int64()), ("context", pa.int64()), ("base", pa.int32()), ("bytes", pa.binary())])


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells of contexts: windows by the distance of the anchor, shard by anchor, cell and common bytes."""
    import xxhash

    for b in batches:
        rows = []
        for anchor, context, place, data in zip(*columns(b, "anchor", "context", "place", "bytes"), strict=True):
            last = len(data) - WINDOW
            for cell in range((place - min(last, place)) // CELL, place // CELL + 1):
                i, j = max(0, place - CELL * cell - CELL + 1), min(last, place - CELL * cell)
                if i > j:
                    continue
                core = place - CELL * cell                      # the cell's last start; its common bytes begin here
                common = data[core:core + WINDOW - CELL + 1]
                key = xxhash.xxh3_64_intdigest(common, seed=(anchor ^ cell) & 0xFFFFFFFF) - (1 << 63)
                rows.append((key, context, i, data[i:j + WINDOW]))
            if len(rows) > 10_000:
                yield batch(CELLS, [list(c) for c in zip(*rows, strict=True)])
                rows = []
        if rows:
            yield batch(CELLS, [list(c) for c in zip(*rows, strict=True)])


class Level:
    """A suffix array: distinct 400-byte strings in order, and where each was seen first."""

    def __init__(self, strings: np.ndarray, owners: np.ndarray):
        self.strings, self.owners = strings, owners

    def merge(self, other: Level) -> Level:
        """Both levels' strings in order (they have none in common)."""
        at = np.searchsorted(self.strings, other.strings)
        return Level(np.insert(self.strings, at, other.strings), np.insert(self.owners, at, other.owners))


class Family:
    """Levels of an anchor's index; ``repeated`` collects (context number, window) that were met twice."""

    def __init__(self):
        self.levels: list[tuple[int, Level]] = []     # (merges so far, level)
        self.repeated: list[np.ndarray] = []
        self.waiting: list[tuple[int, bytes]] = []
        self.suffixes = 0

    def add(self, number: int, data: bytes) -> None:
        self.waiting.append((number, data))
        self.suffixes += len(data) - WINDOW + 1
        if self.suffixes >= BATCH:
            self.flush()

    def flush(self) -> None:
        """Suffix array of the waiting contexts, merge scan against the levels, geometric merging."""
        if not self.waiting:
            return
        strings = np.concatenate([
            np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(np.frombuffer(d, dtype=np.uint8), WINDOW))
            .view(f"S{WINDOW}").ravel() for _, d in self.waiting])
        owners = np.concatenate([(n << 20) + np.arange(len(d) - WINDOW + 1) for n, d in self.waiting])
        self.waiting, self.suffixes = [], 0
        order = np.argsort(strings, kind="stable")
        strings, owners = strings[order], owners[order]
        same = strings[1:] == strings[:-1]
        twice = np.concatenate((same, [False])) | np.concatenate(([False], same))
        self.repeated.append(owners[twice])
        fresh = np.concatenate(([True], ~same))
        strings, owners = strings[fresh], owners[fresh]
        for _, level in self.levels:
            at = np.minimum(np.searchsorted(level.strings, strings), len(level.strings) - 1)
            met = level.strings[at] == strings
            self.repeated += [owners[met], level.owners[at[met]]]
            strings, owners = strings[~met], owners[~met]
            if not len(strings):
                return
        rank, new = 0, Level(strings, owners)
        while self.levels and self.levels[-1][0] <= rank:
            merges, old = self.levels.pop()
            rank, new = max(rank, merges) + 1, old.merge(new)
        self.levels.append((rank, new))


MARKS = pa.schema([("context", pa.int64()), ("runs", pa.list_(pa.int32()))])


def to_runs(starts: np.ndarray) -> np.ndarray:
    """Begin and end of the runs of consecutive numbers in a sorted array, alternating."""
    cut = np.flatnonzero(np.diff(starts) != 1)
    return np.stack((starts[np.concatenate(([0], cut + 1))], starts[np.concatenate((cut, [len(starts) - 1]))] + 1),
                    axis=1).ravel()


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repeated windows of the contexts of each shard (rows of a shard lie together)."""
    shard, family, names, bases = None, Family(), [], []

    def marks() -> pa.RecordBatch | None:
        family.flush()
        found = np.unique(np.concatenate(family.repeated)) if family.repeated else np.empty(0, dtype=np.int64)
        if not len(found):
            return None
        number, start = found >> 20, found & ((1 << 20) - 1)
        parts = np.split(np.arange(len(found)), np.flatnonzero(np.diff(number)) + 1)
        return batch(MARKS, [[names[number[p[0]]] for p in parts],
                             [to_runs(start[p] + bases[number[p[0]]]) for p in parts]])

    for b in batches:
        for where, context, base, data in zip(*columns(b, "shard", "context", "base", "bytes"), strict=True):
            if where != shard:
                if len(names) > 1 and (out := marks()):
                    yield out
                shard, family, names, bases = where, Family(), [], []
            family.add(len(names), data)
            names.append(context)
            bases.append(base)
    if len(names) > 1 and (out := marks()):
        yield out


RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                    ("kept_sha256", pa.string())])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for doc_id, text, copies, marks in zip(*columns(b, "doc_id", "text", "copies", "marks"), strict=True):
            raw = text_bytes(text)
            edge = np.zeros(len(raw) + 1, dtype=np.int64)
            if copies > 1 and len(raw) >= WINDOW:
                edge[0] = 1
            elif marks:
                runs = {m["context"]: m["runs"] for m in marks}
                for _, _, first, last in contexts(raw):
                    for i, j in zip(first.tolist(), last.tolist(), strict=True):
                        found = runs.get(context_key(raw, i, j))
                        if found is None:
                            continue
                        for start, stop in zip(found[::2], found[1::2], strict=True) if found else [(0, j - i + 1)]:
                            edge[i + start] += 1
                            edge[i + stop - 1 + WINDOW] -= 1
            gone = np.cumsum(edge[:-1]) > 0
            spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
            rows.append((doc_id, len(raw), int(gone.sum()), spans, hashlib.sha256(raw[~gone].tobytes()).hexdigest()))
        yield batch(RESULT, [list(c) for c in zip(*rows, strict=True)] or [[]] * 5)


def without_repeats(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row (see the module's text)."""
    text = empty_text()
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"),
                            F.md5(text).alias("digest"))
    # A row for each text: how often it is there, and its anchors; copies are told apart by nothing but their number.
    copies = saved(docs.groupBy("digest").agg(F.count("*").alias("copies"), F.min("doc_id").alias("one")), "copies")
    profile = saved(docs.mapInArrow(_profile, "digest string, anchors array<bigint>, twice array<boolean>")
                    .filter(F.size("anchors") > 0).dropDuplicates(["digest"]), "anchors")
    each = profile.select("digest", F.explode(F.arrays_zip("anchors", "twice")).alias("a")) \
        .select("digest", F.col("a.anchors").alias("anchor"), F.col("a.twice").cast("int").alias("twice"))
    again = each.groupBy("anchor").agg(F.sum(1 + F.col("twice")).alias("n")).filter("n > 1").select("anchor")
    wanted = (each.join(again, "anchor").groupBy("digest").agg(F.collect_list("anchor").alias("wanted"))
              .join(copies, "digest").select(F.col("digest").alias("_d"), "one", "wanted"))
    found = saved(docs.join(wanted, (F.col("digest") == F.col("_d")) & F.col("doc_id").eqNullSafe(F.col("one")))
                  .select("text", "digest", "wanted").mapInArrow(_contexts, CONTEXT_DDL), "contexts")
    distinct = found.dropDuplicates(["context", "digest"]).groupBy("context").agg(
        F.first("anchor").alias("anchor"), F.sum("n").alias("n"), F.first("place").alias("place"),
        F.first("bytes").alias("bytes"))
    distinct = saved(distinct, "distinct")
    sizes = distinct.groupBy("anchor").agg(F.count("*").alias("m")).filter("m > 1")
    meeting = distinct.join(sizes, "anchor")
    plain = meeting.filter(F.col("m") <= MANY).select(F.col("anchor").alias("shard"), "context",
                                                      F.lit(0).alias("base"), "bytes")
    cells = meeting.filter(F.col("m") > MANY).select("anchor", "context", "place", "bytes") \
        .mapInArrow(_cells, "shard bigint, context bigint, base int, bytes binary")
    runs = (plain.unionByName(cells).repartition("shard").sortWithinPartitions("shard")
            .mapInArrow(_index, "context bigint, runs array<int>"))
    merged = runs.groupBy("context").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    nothing = F.array().cast("array<int>")
    whole = distinct.filter("n > 1").select("context", nothing.alias("runs"))        # no runs: all of its windows
    some = merged.join(whole.select("context"), "context", "left_anti")
    marks = (found.select("digest", "context").distinct().join(whole.unionByName(some), "context")
             .groupBy("digest").agg(F.collect_list(F.struct("context", "runs")).alias("marks")))
    known = copies.join(marks, "digest", "left").select(F.col("digest").alias("_d"), "copies",
                                                        F.when(F.col("copies") == 1, F.col("marks")).alias("marks"))
    return (docs.join(known, F.col("digest") == F.col("_d")).select("doc_id", "text", "copies", "marks")
            .mapInArrow(_remove, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"))
