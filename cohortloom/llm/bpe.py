"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash of the last bytes marks chunk edges in a text, so texts that share a passage share its
chunks whatever stands before it. A chunk's inside, from its first to its last safe place, is encoded
once per task and looked up afterwards, while it is among the last CHUNKS_HELD. A safe place is where
the tokenizer's own splitting has a boundary for certain: before a space that parts two words. The
join of two chunks runs from the last safe place before the edge to the first one behind it and is
encoded again by itself; where there is none the join grows until both its ends are safe. So the
pieces of a text always add up to its encoding.

The tokenizer is given by its definition (JSON of the tokenizers library). Where it is a byte-level
BPE whose merges are in the order of their ids, pieces of Latin letters go through tiktoken with the
same ranks, which is several times faster and finds the same ids; all others, and pieces that hold a
special token, go through the tokenizers library itself.
"""

from __future__ import annotations

import hashlib
import json
import os
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .frames import added
from .words import SPACE, column_bytes

EDGE_BITS = 9  # a chunk edge every 512 bytes, on average
_REACH = 6  # bytes that decide an edge
CHUNKS_HELD = 20_000
_LONGEST = 4096  # bytes of a chunk that is worth holding
# Letters, digits and white space below U+0280 are the same in every version of Unicode.
_LATIN = 0xCA
# Fixed value: how byte-level BPE splits a text, with the contractions of the public definition.
_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)


def safe_places(data: np.ndarray) -> np.ndarray:
    """Places of spaces between two bytes that are no white space, one of them ASCII."""
    if len(data) < 3:
        return np.empty(0, dtype=np.int64)
    word = ~SPACE[data]
    solid = (data > 0x20) & (data < 0x7F)
    between = (data[1:-1] == 0x20) & word[2:] & word[:-2] & (solid[2:] | solid[:-2])
    return np.flatnonzero(between) + 1


def chunk_edges(data: np.ndarray) -> np.ndarray:
    """Places where the hash of the bytes before is zero in its top bits."""
    if len(data) <= _REACH:
        return np.empty(0, dtype=np.int64)
    rolled = np.zeros(len(data) - _REACH + 1, dtype=np.uint32)
    factor = 1
    for j in range(_REACH):
        rolled += data[j : j + len(rolled)].astype(np.uint32) * np.uint32(factor)
        factor = factor * 0x9E3779B1 % (1 << 32)
    rolled *= np.uint32(0x85EBCA6B)
    rolled ^= rolled >> np.uint32(15)
    rolled *= np.uint32(0xC2B2AE35)
    return np.flatnonzero(rolled >> np.uint32(32 - EDGE_BITS) == 0) + _REACH


def _byte_of() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


def merge_ranks(definition: dict) -> dict[bytes, int] | None:
    """The ranks of a byte-level BPE by the order of its ids; None if it is another kind."""
    model, split = definition["model"], definition.get("pre_tokenizer") or {}
    usual = (
        model.get("type") == "BPE"
        and not definition.get("normalizer")
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix",
                                           "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        and split.get("type") == "ByteLevel"
        and split.get("use_regex", True)
        and not split.get("add_prefix_space")
        and (definition.get("decoder") or {}).get("type") == "ByteLevel"
    )
    if not usual:
        return None
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    order = [model["vocab"][a + b] for a, b in pairs]
    if order != sorted(order):
        return None
    special = {t["content"] for t in definition.get("added_tokens", [])}
    byte_of = _byte_of()
    ranks = {bytes(byte_of[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
    return ranks if all(bytes([b]) in ranks for b in range(256)) else None


class Encoder:
    """Encodes texts with the caches of one task."""

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = False
        parsed = json.loads(definition)
        special = [t["content"].encode() for t in parsed.get("added_tokens", [])]
        ranks = merge_ranks(parsed)
        self.fast = ranks and tiktoken.Encoding(
            "ranks", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.special = special
        # Without these a place may be unsafe: then a text is one piece.
        self.cut = bool(ranks) and not any(SPACE[np.frombuffer(t, np.uint8)].any() for t in special)
        self.decimal = [str(i) for i in range(self.tokenizer.get_vocab_size())]
        self.chunks: dict[bytes, bytes] = {}
        self.differs: dict[bytes, bytes] = {}  # pieces whose decoding is another text
        self.encoded = self.reused = 0

    def _ids(self, piece: bytes, latin: bool) -> bytes:
        """Ids of a piece, in decimal and joined by commas; notes what they decode to if it differs."""
        self.encoded += len(piece)
        text = piece.decode()
        if self.fast and (latin or max(piece) < _LATIN) and not any(t in piece for t in self.special):
            ids = self.fast.encode_ordinary(text)
            decoded = self.fast.decode_bytes(ids)
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            decoded = self.tokenizer.decode(ids, skip_special_tokens=False).encode()
        if decoded != piece:
            self.differs[piece] = decoded
        return ",".join([self.decimal[i] for i in ids]).encode()

    def parts(self, data: np.ndarray) -> list[tuple[bytes, bool]]:
        """A text cut into insides of chunks (true) and joins (false), in order."""
        body = data.tobytes()
        edges = chunk_edges(data) if self.cut else np.empty(0, dtype=np.int64)
        safe = safe_places(data) if len(edges) else edges
        if not len(safe) or not len(edges):
            return [(body, True)] if body else []
        behind = np.searchsorted(safe, edges, side="right")
        out = []
        at = 0
        for k in np.unique(behind[(behind > 0) & (behind < len(safe))]).tolist():
            first, last = int(safe[k - 1]), int(safe[k])
            if first > at:
                out.append((body[at:first], True))
            out.append((body[first:last], False))
            at = last
        if at < len(body):
            out.append((body[at:], True))
        return out

    def encode(self, data: np.ndarray) -> tuple[bytes, bytes]:
        """Ids of a text, in decimal and joined by commas, and what they decode to."""
        latin = bool(len(data)) and int(data.max()) < _LATIN
        found: list[bytes] = []
        parts = self.parts(data)
        for part, inside in parts:
            ids = self.chunks.get(part) if inside else None
            if ids is None:
                ids = self._ids(part, latin)
                if inside and len(part) <= _LONGEST and part not in self.differs:
                    self._hold(part, ids)
            else:
                self.reused += len(part)
            found.append(ids)
        decoded = b"".join([self.differs.get(part, part) for part, _ in parts])
        self.differs.clear()
        return b",".join(found), decoded

    def _hold(self, part: bytes, ids: bytes) -> None:
        if len(self.chunks) >= CHUNKS_HELD:  # the oldest go
            for old in list(self.chunks)[: CHUNKS_HELD // 8]:
                del self.chunks[old]
        self.chunks[part] = ids


def encode(docs: DataFrame, definition: str | Path, text: str = "text", ids: bool = True) -> DataFrame:
    """``docs`` with ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, with ``ids``, ``token_ids``.

    ``definition`` is the file of a byte-level BPE tokenizer; it is read on the driver. The digests are
    of the decimal ids joined by commas, and of the decoded text in UTF-8. A null text counts as empty
    and has no ids. Strings of special tokens in a text become these tokens. Rows stay as they are;
    columns of these names are replaced.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(Path(definition).read_text(encoding="utf-8"))

    def compute():
        encoder = Encoder(shipped.value)

        def work(batch):
            body, places = column_bytes(batch.column(text))
            counts, hashed, back, lists = [], [], [], []
            for first, last in zip(places[:-1].tolist(), places[1:].tolist()):
                joined, decoded = encoder.encode(body[first:last])
                counts.append(joined.count(b",") + 1 if joined else 0)
                hashed.append(hashlib.sha256(joined).hexdigest())
                back.append(hashlib.sha256(decoded).hexdigest())
                if ids:
                    lists.append([int(x) for x in joined.split(b",")] if joined else [])
            arrays = [pa.array(counts, pa.int64()), pa.array(hashed, pa.string()), pa.array(back, pa.string())]
            return arrays + ([pa.array(lists, pa.list_(pa.int32()))] if ids else [])

        return work

    fields = [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]
    if ids:
        fields.append(T.StructField("token_ids", T.ArrayType(T.IntegerType())))
    return added(docs, fields, compute)


def decode(docs: DataFrame, definition: str | Path, token_ids: str = "token_ids") -> DataFrame:
    """``docs`` with ``decoded``, the text of its ids; null ids decode to null."""
    shipped = docs.sparkSession.sparkContext.broadcast(Path(definition).read_text(encoding="utf-8"))

    def compute():
        encoder = Encoder(shipped.value)

        def work(batch):
            lists = batch.column(token_ids).to_pylist()
            texts = encoder.tokenizer.decode_batch([x or [] for x in lists], skip_special_tokens=False)
            return [pa.array([None if x is None else t for x, t in zip(lists, texts)], pa.string())]

        return work

    return added(docs, [T.StructField("decoded", T.StringType())], compute)
