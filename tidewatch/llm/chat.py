"""Chat formatting with loss masks that are aligned by offsets.

A conversation is rendered whole: each turn is ``<s>role[INST]text[/INST]</s>``, with
the four control strings escaped inside roles and texts. The rendered string is
encoded once, with character offsets, and the spans of the assistant's texts are
intersected with the sorted token spans by binary search.

Rows are dealt by conversation and sorted by turn, and each task streams through its
conversations, so memory holds one batch and the open conversation.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


DEFAULT_TOKENIZER = os.path.join(os.environ.get("TOKENIZER_FILES", "/opt/tokenizers"), "byte_bpe_50k.json")
OPEN, TEXT, END_TEXT, CLOSE = "<s>", "[INST]", "[/INST]", "</s>"
CONTROL = (OPEN, CLOSE, TEXT, END_TEXT)
_NEEDS_ESCAPE = re.compile("|".join(map(re.escape, ("\\", *CONTROL))))
_ESCAPED = re.compile(r"\\(\\?)")
_TURN = re.compile(r"<s>(.*?)\[INST\](.*?)\[/INST\]</s>", re.DOTALL)
#: Rendered characters that are encoded together.
TOGETHER = 1 << 20


def escape(text: str) -> str:
    """Double every backslash, and put one into every control string."""
    return _NEEDS_ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the sorted spans of the assistant's texts in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escape(role)}{TEXT}", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END_TEXT + CLOSE]
        at += len(head) + len(body) + len(END_TEXT + CLOSE)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns read back from a formatted conversation."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def loss_mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens overlap a span; token spans and spans are sorted."""
    mask = np.zeros(len(starts), bool)
    for a, b in spans:
        if a < b:
            mask[np.searchsorted(ends, a, "right") : np.searchsorted(starts, b, "left")] = True
    return mask


def masked_text(formatted: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> str:
    """The characters under masked tokens, each once, in order."""
    out, at = [], 0
    for a, b in zip(starts[mask].tolist(), ends[mask].tolist(), strict=True):
        if b > at:
            out.append(formatted[max(a, at) : b])
            at = b
    return "".join(out)


def load_tokenizer(data: str):
    """The tokenizer of a public JSON file, with the control strings as tokens of their own.

    Texts cannot hold a control string once escaped, so no token straddles the edge
    between a text and a marker.
    """
    from tokenizers import AddedToken, Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_str(data)
    tokenizer.add_tokens([AddedToken(c, normalized=False) for c in CONTROL])
    return tokenizer


FORMATTED = "conv long, n_turns long, formatted string, ids array<int>, loss array<boolean>, loss_text string"


def format_conversations(spark: SparkSession, rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """(conv, n_turns, formatted, ids, loss, loss_text): one row a conversation.

    ``loss`` has a flag for each token of ``ids``: true under the assistant's texts.
    ``loss_text`` is what the masked tokens cover, unescaped.

    Defined cases: rows are ordered by turn (nulls first), then role and text, so ties
    and repeated rows have a fixed order and all count as turns; null roles and texts
    are empty; rows without an id form one conversation with a null id; a conversation
    without assistant rows has no loss; an empty table stays empty; extra columns are
    ignored.
    """
    with open(tokenizer, encoding="utf-8") as f:
        data = spark.sparkContext.broadcast(f.read())  # bounded by the vocabulary file

    def encoded(encode, open_turns: list) -> pa.RecordBatch:
        rendered = [render(turns) for _, turns in open_turns]
        ids, masks, losses = [], [], []
        for (formatted, spans), got in zip(rendered, encode([f for f, _ in rendered]), strict=True):
            offsets = np.array(got.offsets, np.int64).reshape(-1, 2)
            mask = loss_mask(offsets[:, 0], offsets[:, 1], spans)
            ids.append(got.ids)
            masks.append(mask.tolist())
            losses.append(unescape(masked_text(formatted, offsets[:, 0], offsets[:, 1], mask)))
        columns = [pa.array([c for c, _ in open_turns], pa.int64()), pa.array([len(t) for _, t in open_turns], pa.int64()), pa.array([f for f, _ in rendered], pa.string()), pa.array(ids, pa.list_(pa.int32())), pa.array(masks, pa.list_(pa.bool_())), pa.array(losses, pa.string())]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in FORMATTED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = load_tokenizer(data.value)
        encode = lambda texts: tokens.encode_batch(texts, add_special_tokens=False)
        turns: list = []  # (conversation, its turns), the last one still open
        size = 0
        for batch in batches:
            for conv, who, said in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if not turns or turns[-1][0] != conv:
                    if size > TOGETHER:
                        yield encoded(encode, turns)
                        turns, size = [], 0
                    turns.append((conv, []))
                turns[-1][1].append((who or "", said or ""))
                size += len(said or "")
        if turns:
            yield encoded(encode, turns)

    picked = rows.select(F.col(conv_id).cast("long").alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    dealt = picked.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").select("conv", "role", "text")
    return dealt.mapInArrow(run, FORMATTED)
