"""Repeated-phrase automata: remove passages that an earlier document has, word for word.

A window is 50 consecutive words of one document.  Each word covered by a window whose words also
start in a document with a smaller doc_id goes.

1. Every window has an anchor phrase: the 25 consecutive words in it with the smallest hash (the
   last one among equals), so equal windows have equal phrases at equal places.  One pass lists
   each distinct text's phrase hashes; those of two or more documents recur.
2. Windows at recurring phrases are counted by their hash: those with a smaller first document are
   the confirmed passages, and each document gets the list of its own.
3. Documents are dealt into shards by their text.  For each shard an Aho-Corasick automaton of the
   phrases of its confirmed passages is compiled; its documents stream through it, and around every
   occurrence the windows that are on the document's list are removed.

Equal texts are one text in steps 1 and 2 (the smallest doc_id stands for them); the others of such
a group lose all words if there are 50 or more.  A shard holds about ``SHARD_WORDS`` words, so an
automaton is bounded by the words of its shard and not by the corpus.

Defined cases: null or empty texts have no words and keep the empty text; rows with a null doc_id
are kept whole and are nobody's original; rows that repeat a doc_id are no originals of each other;
an empty table gives an empty result; very long texts need memory in proportion to their length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from petrograph.llm.common import (WORD_RE, anchors, batch, chunks, columns, empty_text, saved, text_bytes,
                                   window_hash, word_ids)

WINDOW, PHRASE = 50, 25
#: Words of the documents of one shard, about.
SHARD_WORDS = 2_000_000


def phrase_anchors(ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(phrase hash, phrase place, first window start, last window start), piece by piece."""
    for begin, end in chunks(len(ids), WINDOW):
        grams = window_hash(ids[begin:end], PHRASE)
        at, first, last = anchors(grams, WINDOW - PHRASE + 1)
        yield grams[at].view(np.int64), at + begin, first + begin, last + begin


PROFILE = pa.schema([("doc_id", pa.int64()), ("digest", pa.string()), ("n_words", pa.int64()),
                     ("phrases", pa.list_(pa.int64()))])


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sizes, lists = [], []
        for text in b.column(b.schema.get_field_index("text")).to_pylist():
            ids = word_ids(text_bytes(text))
            found = [h for h, _, _, _ in phrase_anchors(ids)]
            sizes.append(len(ids))
            lists.append(np.unique(np.concatenate(found)) if found else [])
        yield batch(PROFILE, [*columns(b, "doc_id", "digest"), sizes, lists])


WINDOWS = pa.schema([("phrase", pa.int64()), ("window", pa.int64()), ("origin", pa.int64())])
WORDING = pa.schema([*WINDOWS, ("words", pa.string())])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows at recurring phrases, and the words of a phrase where its first document is read."""
    for b in batches:
        for text, origin, wanted, own in zip(*columns(b, "text", "origin", "wanted", "own"), strict=True):
            raw = text_bytes(text)
            ids = word_ids(raw)
            wanted, own = np.array(wanted, dtype=np.int64), set(own or ())
            phrase, window = [], []
            worded: dict[int, str] = {}
            words = None
            for names, at, first, last in phrase_anchors(ids):
                hit = np.isin(names, wanted)
                for name, place, begin, end in zip(names[hit], at[hit], first[hit], last[hit], strict=True):
                    hashes = window_hash(ids[begin:end + WINDOW], WINDOW)
                    phrase.append(np.full(len(hashes), name))
                    window.append(hashes.view(np.int64))
                    if int(name) in own and int(name) not in worded:
                        words = words or WORD_RE.findall(text)
                        worded[int(name)] = " ".join(words[place:place + PHRASE])
            if not phrase:
                continue
            name, hashes = np.concatenate(phrase), np.concatenate(window)
            _, one = np.unique(hashes, return_index=True)
            for part in np.array_split(one, max(1, len(one) // 100_000)):
                yield batch(WORDING, [pa.array(name[part]), pa.array(hashes[part]), pa.array([origin] * len(part)),
                                      pa.nulls(len(part), pa.string())])
            yield batch(WORDING, [list(worded), [None] * len(worded), [origin] * len(worded), list(worded.values())])


RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
                    ("kept_sha256", pa.string())])


def _kept(words: list[str], gone: np.ndarray) -> tuple[int, int, str]:
    kept = " ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g) if gone.any() else " ".join(words)
    return len(words), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest()


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shard by shard: phrases (side 0) make the automaton, through which the documents (side 1) go."""
    import ahocorasick

    shard, automaton, ready = None, None, False
    for b in batches:
        rows = []
        for where, side, doc_id, text, whole, listed, words_ in zip(
                *columns(b, "shard", "side", "doc_id", "text", "whole", "listed", "words"), strict=True):
            if where != shard:
                shard, automaton, ready = where, ahocorasick.Automaton(), False
            if side == 0:
                automaton.add_word(" " + words_ + " ", True)
                continue
            if not ready:
                automaton.make_automaton()
                ready = True
            words = WORD_RE.findall(text or "")
            gone = np.zeros(len(words), dtype=bool)
            if whole and len(words) >= WINDOW:
                gone[:] = True
            elif listed and len(automaton):
                line = " " + " ".join(words) + " "
                starts = np.concatenate(([0], np.cumsum([len(w) + 1 for w in words])))  # the blank before each word
                ends = np.fromiter((end for end, _ in automaton.iter(line)), dtype=np.int64)
                at = np.searchsorted(starts, ends) - PHRASE
                hashes = window_hash(word_ids(text_bytes(text)), WINDOW).view(np.int64)
                near = np.unique(np.clip(at[:, None] - np.arange(WINDOW - PHRASE + 1), 0, max(len(hashes) - 1, 0)))
                near = near[np.isin(hashes[near], np.array(listed, dtype=np.int64))]
                edge = np.zeros(len(words) + 1, dtype=np.int64)
                edge[near] += 1
                edge[near + WINDOW] -= 1
                gone = np.cumsum(edge[:-1]) > 0
            rows.append((doc_id, *_kept(words, gone)))
        if rows:
            yield batch(RESULT, [list(c) for c in zip(*rows, strict=True)])


def without_repeats(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row (see the module's text)."""
    text = empty_text()
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"),
                            F.md5(text).alias("digest"))
    profile = saved(docs.mapInArrow(_profile, "doc_id bigint, digest string, n_words bigint, phrases array<bigint>"),
                    "phrases")
    named = profile.filter("doc_id is not null")
    origins = named.groupBy("digest").agg(F.min("doc_id").alias("origin"))
    lists = saved(named.join(origins.withColumnRenamed("digest", "_d"),
                             (F.col("digest") == F.col("_d")) & (F.col("doc_id") == F.col("origin")))
                  .select("digest", "origin", "phrases").dropDuplicates(["digest"]), "lists")
    each = lists.select("digest", "origin", F.explode("phrases").alias("phrase"))
    recurring = (each.groupBy("phrase").agg(F.min("origin").alias("first"), F.max("origin").alias("last"))
                 .filter("first < last").select("phrase", "first"))
    wanted = (each.join(recurring, "phrase").groupBy("digest", "origin")
              .agg(F.collect_list("phrase").alias("wanted"),
                   F.collect_list(F.when(F.col("first") == F.col("origin"), F.col("phrase"))).alias("own")))
    found = saved(docs.join(wanted.withColumnRenamed("digest", "_d"),
                            (F.col("digest") == F.col("_d")) & (F.col("doc_id") == F.col("origin")))
                  .select("text", "origin", "wanted", "own")
                  .mapInArrow(_windows, "phrase bigint, window bigint, origin bigint, words string"), "windows")
    windows = found.filter("window is not null")
    confirmed = (windows.groupBy("window").agg(F.min("origin").alias("first"), F.max("origin").alias("last"))
                 .filter("first < last").select("window", "first"))
    removed = saved(windows.join(confirmed, "window").filter("origin > first").select("origin", "phrase", "window")
                    .join(lists.select("digest", "origin"), "origin"), "removed")
    total = profile.agg(F.sum("n_words")).first()[0] or 0
    shards = max(1, total // SHARD_WORDS)
    shard = F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int")
    wording = found.filter("words is not null").groupBy("phrase").agg(F.min("words").alias("words"))
    pattern = (removed.select(shard.alias("shard"), "phrase").distinct().join(wording, "phrase")
               .select("shard", F.lit(0).alias("side"), F.lit(None).cast("bigint").alias("doc_id"),
                       F.lit(None).cast("string").alias("text"), F.lit(False).alias("whole"),
                       F.lit(None).cast("array<bigint>").alias("listed"), "words"))
    listed = removed.groupBy("digest").agg(F.collect_list("window").alias("listed"))
    known = origins.join(listed, "digest", "left").withColumnRenamed("digest", "_d")
    rows = (docs.join(known, F.col("digest") == F.col("_d"), "left")
            .select(F.when(F.col("listed").isNull() | (F.coalesce("doc_id", F.lit(0)) > F.col("origin")),
                           F.pmod(F.xxhash64("digest", "doc_id"), F.lit(shards))).otherwise(shard)
                    .cast("int").alias("shard"),
                    F.lit(1).alias("side"), "doc_id", "text",
                    F.coalesce(F.col("doc_id") > F.col("origin"), F.lit(False)).alias("whole"),
                    F.when(F.col("doc_id") == F.col("origin"), F.col("listed")).alias("listed"),
                    F.lit(None).cast("string").alias("words")))
    return (pattern.unionByName(rows).repartition(int(shards), "shard").sortWithinPartitions("shard", "side")
            .mapInArrow(_stream, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"))
