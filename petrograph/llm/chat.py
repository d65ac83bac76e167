r"""Chat formatting with offset-aligned masks.

A conversation is rendered as

    [INST]role\ntext[/INST]      for every turn but the assistant's
    <s>role\ntext</s>            for the assistant's

Control strings inside roles and texts (``<s> </s> [INST] [/INST] <|endoftext|>``) are escaped by
one backslash after their first character, with one more for each backslash already there, so
unescaping gives back every text.  No control string can begin inside a text and end in the
template, because each holds ``<`` or ``[`` as its first character only.

The rendered text is encoded once, with the control strings as tokens of their own, which makes
turns independent for the tokenizer; the loss mask holds the tokens whose character span meets that
of an assistant's text, found by binary search in the sorted turn spans.

Rows of a conversation are sorted and streamed; the output has a row for each run of turns of at
least ``CHUNK`` characters, so a task holds a turn and a chunk, never a whole conversation.  The
chunks of a conversation lie next to each other, in order.

Defined cases: a null text or role is empty; turns are ordered by turn (null first), then role, then
text, and repeated rows are turns of their own; null conv_ids make one conversation; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from petrograph.llm.common import batch, columns

#: Place of the tokenizer file, read on the driver only.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
LEARNER = "assistant"
#: Characters from which a run of turns is written out.
CHUNK = 200_000

_CONTROL = re.compile(r"([<\[])(\\*)(/?s>|/?INST\]|\|endoftext\|>)")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(/?s>|/?INST\]|\|endoftext\|>)")
_TURN = re.compile(r"(?:<s>|\[INST\])(.*?)(</s>|\[/INST\])", re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(role: str, text: str) -> tuple[str, int, int]:
    """The turn's rendering and the span of its text therein."""
    opening, closing = ("<s>", "</s>") if role == LEARNER else ("[INST]", "[/INST]")
    head, body = opening + escape_role(role) + "\n", escape(text)
    return head + body + closing, len(head), len(head) + len(body)


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of every turn of a rendered text."""
    for m in _TURN.finditer(formatted):
        role, _, text = m[1].partition("\n")
        yield unescape_role(role), unescape(text)


def loss_mask(offsets: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Which tokens (begin, end) meet one of the sorted, disjoint spans (begin, end)."""
    if not len(spans) or not len(offsets):
        return np.zeros(len(offsets), dtype=bool)
    first = np.searchsorted(spans[:, 1], offsets[:, 0], side="right")
    near = spans[np.minimum(first, len(spans) - 1)]
    return (first < len(spans)) & (near[:, 0] < offsets[:, 1]) & (offsets[:, 0] < offsets[:, 1])


def tokenizer(definition: str):
    """The tokenizer with the control strings as tokens and untrimmed offsets."""
    from tokenizers import AddedToken, Tokenizer, processors

    t = Tokenizer.from_str(definition)
    t.post_processor = processors.ByteLevel(trim_offsets=False)
    t.add_special_tokens([AddedToken(c, normalized=False) for c in CONTROLS])
    return t


FORMATTED = pa.schema([("conv_id", pa.int64()), ("chunk", pa.int64()), ("formatted", pa.string()),
                       ("token_ids", pa.list_(pa.int32())), ("token_begin", pa.list_(pa.int32())),
                       ("token_end", pa.list_(pa.int32())), ("loss_mask", pa.list_(pa.bool_()))])
FORMATTED_DDL = ("conv_id bigint, chunk bigint, formatted string, token_ids array<int>, token_begin array<int>, "
                 "token_end array<int>, loss_mask array<boolean>")


def formatted(conversations: DataFrame, tokenizer_file: str = TOKENIZER) -> DataFrame:
    """Chunks of the rendered conversations with token ids, token spans and the loss mask."""
    with open(tokenizer_file, encoding="utf-8") as f:
        shared = conversations.sparkSession.sparkContext.broadcast({"definition": f.read()})

    def write(conv: int | None, chunk: int, turns: list[tuple[str, int, int, bool]]) -> tuple:
        held = shared.value
        if "tokenizer" not in held:
            held["tokenizer"] = tokenizer(held["definition"])
        text = "".join(t[0] for t in turns)
        starts = np.cumsum([0] + [len(t[0]) for t in turns])
        spans = np.array([(s + t[1], s + t[2]) for s, t in zip(starts, turns, strict=False) if t[3] and t[1] < t[2]],
                         dtype=np.int64).reshape(-1, 2)
        code = held["tokenizer"].encode(text, add_special_tokens=False)
        offsets = np.array(code.offsets, dtype=np.int64).reshape(-1, 2)
        return conv, chunk, text, code.ids, offsets[:, 0], offsets[:, 1], loss_mask(offsets, spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, chunk, turns, size, out, held = None, 0, [], 0, [], 0
        for b in batches:
            for conv, role, text in zip(*columns(b, "conv_id", "role", "text"), strict=True):
                if turns and (conv != now or size >= CHUNK):
                    out.append(write(now, chunk, turns))
                    held += size
                    chunk, turns, size = chunk + 1, [], 0
                    if held >= 4 * CHUNK:
                        yield batch(FORMATTED, [list(c) for c in zip(*out, strict=True)])
                        out, held = [], 0
                if conv != now:
                    now, chunk = conv, 0
                turns.append((*render(role, text), role == LEARNER))
                size += len(turns[-1][0])
        if turns:
            out.append(write(now, chunk, turns))
        if out:
            yield batch(FORMATTED, [list(c) for c in zip(*out, strict=True)])

    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn",
                                *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    return (rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
            .mapInArrow(run, FORMATTED_DDL))


DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                    ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
                    ("n_tokens", pa.int64()), ("n_loss_tokens", pa.int64())])


class _Digest:
    """What is read back from the chunks of one conversation."""

    def __init__(self, conv):
        self.conv, self.turns, self.chars, self.loss_chars, self.tokens, self.loss_tokens = conv, 0, 0, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, text: str, begin: np.ndarray, end: np.ndarray, mask: np.ndarray) -> None:
        for role, said in parse(text):
            self.turns += 1
            self.all.update(f"{role}\n{said}\n".encode())
        at, stop = begin[mask], end[mask]
        new = np.flatnonzero(np.concatenate(([True], at[1:] > stop[:-1])))[:len(at)]  # tokens may share a character
        for i, j in pairwise([*new, len(at)]):
            said = unescape(text[at[i]:stop[i:j].max()])
            self.loss_chars += len(said)
            self.loss.update(said.encode())
        self.chars += len(text)
        self.tokens += len(mask)
        self.loss_tokens += int(mask.sum())

    def row(self) -> tuple:
        return (self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars,
                self.tokens, self.loss_tokens)


def digests(chunks: DataFrame) -> DataFrame:
    """One row per conversation, read back from its chunks (which must lie as ``formatted`` leaves them)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        for b in batches:
            ids, texts = columns(b, "conv_id", "formatted")
            lists = [b.column(b.schema.get_field_index(c)) for c in ("token_begin", "token_end", "loss_mask")]
            for i, (conv, text) in enumerate(zip(ids, texts, strict=True)):
                if now is None or conv != now.conv:
                    if now is not None:
                        done.append(now.row())
                    now = _Digest(conv)
                now.add(text, *(c[i].values.to_numpy(zero_copy_only=False) for c in lists))
            if len(done) >= 10_000:
                yield batch(DIGEST, [list(c) for c in zip(*done, strict=True)])
                done = []
        if now is not None:
            done.append(now.row())
        if done:
            yield batch(DIGEST, [list(c) for c in zip(*done, strict=True)])

    return chunks.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, "
                                  "loss_sha256 string, formatted_chars bigint, n_tokens bigint, n_loss_tokens bigint")


def with_probe(conversations: DataFrame) -> DataFrame:
    """The rows (conv_id, turn, role, text) and conversation -7, whose texts are control strings."""
    spark, said = conversations.sparkSession, "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"),
                                F.col("turn").cast("bigint").alias("turn"), "role", "text").unionByName(probe)
