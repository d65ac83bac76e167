"""Quality rules: repetition and length rules plus a target/raw n-gram likelihood ratio.

Method: words and word pairs are hashed into a fixed number of buckets.  One multinomial is
counted over the trusted-target documents, one over the whole raw corpus (every document, whole
texts).  The target is smoothed towards the raw distribution, so with few trusted documents scores
shrink towards 0 and clean documents stay.  A document scores the mean of log p_target(bucket) -
log p_raw(bucket) over its own n-grams, so long and short texts compare, and is kept from a fixed
threshold on.

Before hashing, each word is reduced to its shape: letters, capitals and digits become one class
sign each, runs are cut to three, and the word's length class follows.
The ratio then judges how text is written and not which words it uses, so clean documents in a
rare language or on a rare topic aren't punished for their vocabulary.

Defined cases: a null text has no words and no lines and is rejected by the base rule; an empty
documents table gives an empty result; without any trusted document the raw distribution stands in for
the target (every score is 0 and kept); repeated rows are judged one by one; a null label is not
trusted; repeated labels of a document count its text once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from petrograph.llm.common import (_SPACE, WORD_RE, batch, columns, likely_among, mix, span_hash, text_bytes,
                                   window_hash, word_spans)

#: Buckets of the two multinomials: their size is fixed, whatever the corpus.
BITS = 14
BUCKETS = 1 << BITS
_PAIR = np.uint64(0xD6E8FEB86659FD93)
#: N-grams of the raw distribution that are added to the target's counts.
PRIOR = 4096
#: Mean log ratio per n-gram from which a document is kept.
THRESHOLD = -0.25
#: Base rule: fewest words, and the share of words in repeated windows, in percent, that fails.
MIN_WORDS, MAX_REPEAT_PCT, WINDOW = 20, 30, 8

_IS_SYMBOL = np.zeros(256, dtype=bool)
_IS_SYMBOL[list(b"#*$%&|<>")] = True
#: Class of each byte: letters of any script, capitals A-Z, digits; every other byte is its own class.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[ord("a"):ord("z") + 1] = _CLASS[0x80:] = ord("a")
_CLASS[ord("A"):ord("Z") + 1] = ord("A")
_CLASS[ord("0"):ord("9") + 1] = ord("0")


def shapes(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each word's shape: its byte classes with runs cut to three, and its length class."""
    kind = _CLASS[raw]
    keep = np.ones(len(kind), dtype=bool)
    same = kind[1:] == kind[:-1]
    keep[3:] = ~(same[2:] & same[1:-1] & same[:-2])
    at = np.zeros(len(kind) + 1, dtype=np.int64)
    np.cumsum(keep, out=at[1:])
    return span_hash(kind[keep], at[begin], at[end]) + np.minimum((end - begin) // 8, 4).astype(np.uint64) * _PAIR


def ngram_buckets(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Buckets of the word shapes and of their pairs."""
    h = shapes(raw, begin, end)
    return (np.concatenate((mix(h), mix(h[:-1] * _PAIR + h[1:]))) >> np.uint64(64 - BITS)).astype(np.int64)


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words that lie in a window found twice or more."""
    hashes = window_hash(ids, window)
    ordered = np.sort(hashes)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    at = np.searchsorted(twice, hashes)
    starts = np.flatnonzero(twice[np.minimum(at, len(twice) - 1)] == hashes)
    edge = np.zeros(len(ids) + 1, dtype=np.int64)
    edge[starts] += 1
    edge[starts + window] -= 1
    return int((np.cumsum(edge[:-1]) > 0).sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = Counter(text.split("\n"))
    return sum(n - 1 for line, n in lines.items() if n > 1 and WORD_RE.search(line))


COUNTS = "target int, bucket int, n bigint"


def summed(totals: np.ndarray, target: int) -> pa.RecordBatch:
    """A row for each bucket that isn't empty."""
    bucket = np.flatnonzero(totals)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(bucket), target, dtype=np.int32)), pa.array(bucket.astype(np.int32)),
         pa.array(totals[bucket])], names=["target", "bucket", "n"])


def own_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's n-grams and their counts."""
    raw = text_bytes(text)
    return np.unique(ngram_buckets(raw, *word_spans(raw)), return_counts=True)


def _raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals = np.zeros(BUCKETS, dtype=np.int64)
    for b in batches:
        for text in columns(b, "text")[0]:
            found, n = own_counts(text)
            totals[found] += n
    yield summed(totals, 0)


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = pa.schema([("doc_id", pa.int64()), ("buckets", pa.binary()), ("counts", pa.binary())])
    for b in batches:
        ids, texts = columns(b, "doc_id", "text")
        own = [own_counts(t) for t in texts]
        yield batch(out, [ids, [found.astype(np.uint16).tobytes() for found, _ in own],
                          [n.astype(np.uint32).tobytes() for _, n in own]])


def _target(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals = np.zeros(BUCKETS, dtype=np.int64)
    for b in batches:
        for found, n in zip(*columns(b, "buckets", "counts"), strict=True):
            totals[np.frombuffer(found, dtype=np.uint16)] += np.frombuffer(n, dtype=np.uint32)
    yield summed(totals, 1)


def ngram_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(target, bucket, n): 0 over all rows of docs, 1 over the trusted ones; each task adds up its own rows first.

    No text is shuffled: the join with the trusted ids gets the counts of the documents that a
    bitmap of these ids lets through.
    """
    good = trusted_ids(labels)
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    sparse = likely_among(keyed, "doc_id", good).mapInArrow(_sparse, "doc_id bigint, buckets binary, counts binary")
    target = sparse.join(good.hint("merge"), "doc_id", "left_semi").select("buckets", "counts") \
        .mapInArrow(_target, COUNTS)
    return (docs.select("text").mapInArrow(_raw, COUNTS).union(target)
            .groupBy("target", "bucket").agg(F.sum("n").alias("n")))


def log_ratios(counts: DataFrame) -> np.ndarray:
    """log p_target - log p_raw of each bucket; raw counts get one added, the target's PRIOR n-grams of the raw mix.

    At most 2 * BUCKETS rows reach the driver, however large the corpus.
    """
    n = np.zeros((2, BUCKETS))
    for r in counts.collect():
        n[r.target, r.bucket] = r.n
    raw = (n[0] + 1.0) / (n[0] + 1.0).sum()
    return np.log((n[1] + PRIOR * raw) / (n[1].sum() + PRIOR)) - np.log(raw)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id of every document labelled of good quality and not toxic."""
    return (labels.filter((F.col("quality") == 1) & ~F.coalesce(F.col("toxic") == 1, F.lit(False)))
            .select(F.col("doc_id").cast("bigint").alias("doc_id")).filter("doc_id is not null").distinct())


def quality_table(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: the base counts, the score and the verdict (see the module's text)."""
    spark = docs.sparkSession
    ratio = spark.sparkContext.broadcast(log_ratios(ngram_counts(docs, labels)))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .mapInArrow(scorer(ratio, threshold), SCHEMA)


SCHEMA = ("doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
          "n_repeat_words bigint, base_failed boolean, kept boolean, score double")


def measures(text: str | None, ratio: np.ndarray) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score of one text."""
    raw = text_bytes(text)
    begin, end = word_spans(raw)
    ids, buckets = span_hash(raw, begin, end), ngram_buckets(raw, begin, end)
    return (len(ids), int((~_SPACE[raw] & ((raw & 0xC0) != 0x80)).sum()), int(_IS_SYMBOL[raw].sum()),
            duplicate_lines(text or ""), repeated_words(ids),
            round(float(ratio[buckets].mean()), 9) if len(buckets) else 0.0)


def fails_base(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEAT_PCT * n_words


def scorer(ratio, threshold: float):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
        for b in batches:
            ids, texts = columns(b, "doc_id", "text")
            rows = [measures(t, ratio.value) for t in texts]
            cols = [list(c) for c in zip(*rows, strict=True)] or [[] for _ in range(6)]
            failed = [fails_base(n, r) for n, r in zip(cols[0], cols[4], strict=True)]
            kept = [not f and s >= threshold for f, s in zip(failed, cols[5], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in [ids, *cols[:5]]]
                + [pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_()), pa.array(cols[5], pa.float64())],
                names=[*names, "base_failed", "kept", "score"])

    return score


def kept_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, whose verdict is to keep them."""
    ratio = docs.sparkSession.sparkContext.broadcast(log_ratios(ngram_counts(docs, labels)))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for text in b.column(b.schema.get_field_index("text")).to_pylist():
                n_words, _, _, _, n_repeat_words, score = measures(text, ratio.value)
                good.append(not fails_base(n_words, n_repeat_words) and score >= threshold)
            yield b.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
