"""SentencePiece encoding and decoding by a forward pass shared between words with a common prefix.

The vocabulary file is a BPE model, whose right segmentation is the one the merges give and not the
one with the best sum of piece scores.  It is found with a Viterbi pass over the lattice of pieces
all the same: a path is admitted if every two neighbouring pieces are stable, that is, merging
their joined text gives back just these two.  Every prefix of a word has exactly one admitted
path, so the forward state of a prefix is its last piece (and where that begins).

Texts are cut at blanks and line feeds, across which no piece reaches, into marked words (a blank
stands for the word mark).  Distinct words are sorted, which lists their trie depth first; each
word starts from the forward states of the prefix that it shares with the one before it.

Encoding equals the sentencepiece library's, except that a literal word mark (U+2581) in a text is
written as bytes, so that decoding returns every text exactly.

Defined cases: null and empty texts have no pieces and decode to the empty text; characters without
a piece become byte pieces; very long words need memory in proportion to their length only;
repeated rows are encoded one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import os.path
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from petrograph.llm.common import columns

#: Place of the vocabulary file, read on the driver only.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Words and pairs remembered by a Python worker, and characters of text taken up at once.
WORDS, PAIRS, SLICE = 300_000, 500_000, 2_000_000

_MARKED = re.compile(r"\n| +[^ \n]*|[^ \n]+")
_MARK = "▁"
_NONE: dict = {}


class Vocabulary:
    """Pieces of a BPE model file; encodes and decodes."""

    def __init__(self, model: bytes):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.rank: dict[str, int] = {}
        self.ids: dict[str, int] = {}
        self.bytes: list[bytes] = []
        self.byte_ids = [0] * 256
        for i in range(library.get_piece_size()):
            piece = library.id_to_piece(i)
            if library.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                self.bytes.append(bytes([value]))
            elif library.is_control(i) or library.is_unknown(i) or library.is_unused(i):
                self.bytes.append(b"")
            else:
                text = piece.replace(_MARK, " ")
                if "\n" in text or " " in text.lstrip(" "):
                    raise ValueError(f"piece {piece!r} reaches across words")
                self.rank[text] = -library.get_score(i)
                self.ids[text] = i
                self.bytes.append(text.encode())
        self.stable: dict[str, dict[str, bool]] = {}
        self.pairs = 0
        self.backward: dict = {}
        for piece in self.ids:
            if self.merge(piece) == [piece]:
                node = self.backward
                for c in reversed(piece):
                    node = node.setdefault(c, {})
                node[""] = piece
        self.words: dict[str, tuple[int, ...]] = {}

    def merge(self, text: str) -> list[str]:
        """Byte-pair merging of a short text: lowest rank first, leftmost among equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = min((self.rank.get(a + b, np.inf), i) for i, (a, b) in enumerate(zip(parts, parts[1:],
                                                                                             strict=False)))
            if best == np.inf:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def is_stable(self, left: str, right: str) -> bool:
        """Whether merging left + right gives back these two; remembered."""
        known = self.stable.setdefault(right, {})
        if left not in known:
            self.pairs += 1
            known[left] = self.merge(left + right) == [left, right]
        return known[left]

    def forward(self, words: list[str]) -> Iterator[tuple[str, list[str]]]:
        """Each of the sorted words with its forward states: the last piece of every prefix.

        Candidates for the last piece are read backward from the prefix's end, down a trie of the
        reversed pieces.
        """
        if self.pairs > PAIRS:
            self.stable.clear()
            self.pairs = 0
        states: list[str] = [""]
        stable, backward, before = self.stable, self.backward, ""
        for word in words:
            shared = 0
            for x, y in zip(before, word, strict=False):
                if x != y:
                    break
                shared += 1
            del states[shared + 1:]
            for end in range(shared + 1, len(word) + 1):
                begin = end - 1
                node = backward.get(word[begin], _NONE)
                found = word[begin]
                left = states[begin]
                if left and not ((known := stable.get(found)) and known.get(left)) and not self.is_stable(left, found):
                    found = ""
                while not found:
                    begin -= 1
                    node = node[word[begin]]
                    piece = node.get("")
                    if piece:
                        left = states[begin]
                        known = stable.get(piece)
                        if not left or ((yes := known.get(left) if known else None) is None
                                        and self.is_stable(left, piece)) or yes:
                            found = piece
                states.append(found)
            yield word, states
            before = word

    def learn(self, words: set[str]) -> None:
        """Encode words that aren't remembered."""
        for word, states in self.forward(sorted(words)):
            out, at = [], len(word)
            while at:
                piece = states[at]
                at -= len(piece)
                i = self.ids.get(piece)
                out.append((i,) if i is not None else tuple(self.byte_ids[b] for b in piece.encode()))
            self.words[word] = tuple(chain.from_iterable(reversed(out)))

    def known(self, words: list[str]) -> list[tuple[int, ...]]:
        """Ids of each marked word."""
        if len(self.words) >= WORDS:
            self.words.clear()
        self.learn(set(words).difference(self.words))
        return list(map(self.words.__getitem__, words))

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        """Piece ids of each text.

        Arrow splits the texts at single blanks and numbers their distinct words; texts with runs of
        blanks, whose marks belong to one word, are cut one by one.
        """
        odd = [bool(t) and (t[0] == " " or t[-1] == " " or "  " in t) for t in texts]
        plain = pa.array([t if t and not o else None for t, o in zip(texts, odd, strict=True)], pa.large_string())
        cut = pc.split_pattern(plain, " ")
        words = cut.values.dictionary_encode()
        ids = self.known([" " + w for w in words.dictionary.to_pylist()])
        lengths = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        at = words.indices.to_numpy()
        size = lengths[at]
        flat = np.fromiter(chain.from_iterable(ids), dtype=np.int32)
        starts = np.cumsum(lengths) - lengths
        ends = np.cumsum(size)
        tokens = flat[np.repeat(starts[at] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        edge = np.concatenate(([0], ends))[np.asarray(cut.offsets)]
        if not any(odd):
            return pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(tokens))
        each = [np.fromiter(chain.from_iterable(self.known(_MARKED.findall(" " + t))), dtype=np.int32) if o
                else tokens[edge[i]:edge[i + 1]] for i, (t, o) in enumerate(zip(texts, odd, strict=True))]
        offsets = np.concatenate(([0], np.cumsum([len(e) for e in each]))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(each)))

    def decode(self, lists: pa.ListArray) -> list[str]:
        """The text of each list of piece ids (null: empty)."""
        offsets = np.asarray(lists.offsets)
        flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
        taken = pa.array(self.bytes, pa.large_binary()).take(flat)
        edges = np.frombuffer(taken.buffers()[1], dtype=np.int64)[taken.offset:taken.offset + len(taken) + 1]
        data = memoryview(taken.buffers()[2]) if taken.buffers()[2] else memoryview(b"")
        out = []
        for begin, end in zip(edges[offsets[:-1] - offsets[0]].tolist(), edges[offsets[1:] - offsets[0]].tolist(),
                              strict=True):
            text = str(data[begin:end], "utf-8", "replace")
            out.append(text[1:] if text.startswith(" ") else text)
        return out


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of texts with about SLICE bytes (a longer text alone)."""
    begin = size = 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        size += n or 0
        if size >= SLICE:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def shared_model(spark, model: str = MODEL):
    """The model file as a broadcast variable (its size is the file's, not the data's)."""
    with open(model, "rb") as f:
        return spark.sparkContext.broadcast({"model": f.read()})


def vocabulary(shared) -> Vocabulary:
    """The vocabulary of a broadcast model, made once by each Python worker."""
    held = shared.value
    if "vocabulary" not in held:
        held["vocabulary"] = Vocabulary(held["model"])
    return held["vocabulary"]


def encoded(documents: DataFrame, model: str = MODEL) -> DataFrame:
    """All columns of documents, n_pieces and pieces (the ids of its text)."""
    names = documents.columns
    shared = shared_model(documents.sparkSession, model)
    fresh = [c for c in names if c not in ("pieces", "n_pieces")]
    schema = documents.select(*fresh).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(shared)
        for b in batches:
            texts = b.column(b.schema.get_field_index("text")).cast(pa.string())
            for begin, end in slices(texts):
                lists = voc.encode(texts[begin:end].to_pylist())
                part = b.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pc.list_value_length(lists).cast(pa.int64()), lists],
                    names=[*part.schema.names, "n_pieces", "pieces"])

    schema.add("n_pieces", T.LongType()).add("pieces", T.ArrayType(T.IntegerType()))
    return documents.select(*fresh).mapInArrow(run, schema)


def decoded(encodings: DataFrame, keep: tuple[str, ...] = ("doc_id",), model: str = MODEL) -> DataFrame:
    """The columns ``keep`` and the text that the column pieces stands for."""
    shared = shared_model(encodings.sparkSession, model)
    schema = encodings.select(*keep).schema.add("text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(shared)
        for b in batches:
            texts = voc.decode(b.column(b.schema.get_field_index("pieces")))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(k)) for k in keep),
                                              pa.array(texts, pa.string())], names=[*keep, "text"])

    return encodings.select(*keep, "pieces").mapInArrow(run, schema)


def round_trip(documents: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_pieces, pieces, the digest of the decoded text and whether it is the document's.

    Each slice is encoded and decoded in one pass, so a task needs one Python worker and one vocabulary.
    """
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = shared_model(documents.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        voc = vocabulary(shared)
        for b in batches:
            ids, texts = b.column(0), b.column(1).cast(pa.string())
            for begin, end in slices(texts):
                part = texts[begin:end].to_pylist()
                lists = voc.encode(part)
                back = voc.decode(lists)
                yield pa.RecordBatch.from_arrays(
                    [ids[begin:end], pc.list_value_length(lists).cast(pa.int64()), lists,
                     pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back], pa.string()),
                     pa.array([t == (o or "") for t, o in zip(back, part, strict=True)], pa.bool_())],
                    names=["doc_id", "n_pieces", "pieces", "decoded_sha256", "exact"])

    return docs.mapInArrow(run, "doc_id bigint, n_pieces bigint, pieces array<int>, decoded_sha256 string, "
                                "exact boolean")
