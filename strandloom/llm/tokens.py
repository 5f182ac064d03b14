"""Encoding of a corpus with a public byte-level BPE vocabulary, and decoding.

Merges are compiled into a finite-state transducer that is determinised as the texts ask for it. It reads bytes. The
encoding of a text has the encoding of a shorter one as all but its last token, and the last token is the one suffix that
is in the vocabulary and fits its predecessor; so a state need only hold, for each place where a longer token may still
begin, the tokens up to that place. What all of them share is emitted: the lookahead is at most a token's length.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public vocabularies lie, and the one used here.
DIRECTORY, VOCABULARY = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
# Fixed value: the pattern that parts a text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bounds of what a task keeps: states and pairs of the transducer, parts of texts, characters worked on at once.
STATES, PAIRS, PARTS, AT_ONCE = 60_000, 300_000, 200_000, 1_000_000


def read_vocabulary(path: str) -> list[bytes]:
    """Token bytes by id; the ids are the ranks of the merges."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))) or sum(len(t) == 1 for t in tokens) != 256:
        raise ValueError(f"not a whole byte-level vocabulary: {path}")
    return tokens


class _State:
    __slots__ = ("before", "live", "arcs", "rest")

    def __init__(self, before: int | None, live: tuple):
        self.before, self.live, self.arcs = before, live, {}
        self.rest = live[-1][1]  # what is still to be emitted if the text ends here


class Transducer:
    """Encodes byte strings that the pattern has parted; grows states and arcs as needed, and starts anew when they are too many."""

    def __init__(self, tokens: list[bytes], states: int = STATES):
        self.tokens, self.most = tokens, states
        self.ids = {t: i for i, t in enumerate(tokens)}
        self.beginnings = {t[:i] for t in tokens for i in range(1, len(t))}
        self.pairs: dict[int, bool] = {}
        self._restart()

    def _restart(self) -> None:
        self.start = _State(None, ((b"", ()),))
        self.states = {(None, self.start.live): self.start}

    def merged(self, text: bytes) -> list[int]:
        """The tokens by the merges themselves, for texts of two tokens."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            rank, at = min((self.ids.get(a + b, len(self.ids)), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == len(self.ids):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ids[p] for p in parts]

    def fits(self, first: int | None, second: int) -> bool:
        """Whether the two tokens stay as they are when their bytes meet."""
        if first is None:
            return True
        key = first << 32 | second
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self.merged(self.tokens[first] + self.tokens[second]) == [first, second]
        return known

    def _arc(self, state: _State, byte: int) -> tuple[_State, tuple[int, ...]]:
        step, live, done = bytes((byte,)), [], None
        for suffix, tokens in state.live:
            longer = suffix + step
            if done is None and (token := self.ids.get(longer)) is not None and self.fits(tokens[-1] if tokens else state.before, token):
                done = (*tokens, token)
            if longer in self.beginnings:
                live.append((longer, tokens))
        live.append((b"", done))
        shared = 0
        while all(len(t) > shared and t[shared] == done[shared] for _, t in live):
            shared += 1
        out = done[:shared]
        rest = tuple((s, t[shared:]) for s, t in live)
        before = out[-1] if out else state.before
        key = (before if not all(t for _, t in rest) else None, rest)
        if (target := self.states.get(key)) is None:
            if len(self.states) >= self.most:
                self._restart()
            target = self.states[key] = _State(key[0], rest)
        arc = state.arcs[byte] = target, out
        return arc

    def encode(self, text: bytes) -> list[int]:
        state, out = self.start, []
        for byte in text:
            state, tokens = state.arcs.get(byte) or self._arc(state, byte)
            if tokens:
                out += tokens
        out += state.rest
        return out


class _Parts(dict):
    """Parts of texts that a task has met, with their tokens in one array."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer, self.flat, self.ends = transducer, array("i"), array("q", [0])

    def __missing__(self, part: str) -> int:
        self.flat.extend(self.transducer.encode(part.encode()))
        self.ends.append(len(self.flat))
        self[part] = number = len(self)
        return number

    def encode(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of the texts in one array, and how many each has."""
        if len(self) > PARTS:
            self.clear()
            del self.flat[:], self.ends[1:]
        counts = np.array([len(t) for t in texts], np.int64)
        which = np.fromiter((self[p] for t in texts for p in t), np.int64, int(counts.sum()))
        flat, ends = np.array(self.flat, np.int32), np.array(self.ends, np.int64)
        begin, size = ends[which], ends[which + 1] - ends[which]
        after = np.cumsum(size)
        tokens = flat[np.repeat(begin - (after - size), size) + np.arange(int(size.sum()))]
        bounds = np.concatenate([[0], after])[np.concatenate([[0], np.cumsum(counts)])]
        return tokens, np.diff(bounds)


def _pieces(texts: list[str | None]) -> Iterator[list[str]]:
    """The texts in pieces of about AT_ONCE characters; null is an empty text."""
    piece, size = [], 0
    for text in texts:
        piece.append(text or "")
        size += len(piece[-1])
        if size >= AT_ONCE:
            yield piece
            piece, size = [], 0
    if piece:
        yield piece


def encoded(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = f"{DIRECTORY}/{VOCABULARY}") -> DataFrame:
    """(doc_id, ids): the token ids of every text, without special tokens; an empty list for an empty or a null text.

    The strings of special tokens are ordinary text. No shuffle: one row in, one row out, repeated rows included. The
    vocabulary is read once by the driver (its size is fixed) and broadcast.
    """
    tokens = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, split = _Parts(Transducer(tokens.value)), regex.compile(PATTERN).findall
        for batch in batches:
            ids, counts = [], []
            for piece in _pieces(batch.column(1).to_pylist()):
                flat, each = parts.encode([split(t) for t in piece])
                ids.append(flat)
                counts.append(each)
            ends = np.concatenate([[0], *counts]).cumsum()
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "ids"])

    out = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id {dict(docs.dtypes)[doc_id]}, ids array<int>")
    return out.withColumnRenamed("doc_id", doc_id)


class Utf8Stream:
    """Text of a stream of bytes that may end within a character; malformed bytes become replacement characters.

    The state is the bytes of the open character. How many are still to come follows from its first byte; a byte that cannot
    go on closes it.
    """

    def __init__(self):
        self.open = b""

    def push(self, data: bytes) -> str:
        data = self.open + data
        cut = len(data)
        for back in range(1, min(3, cut) + 1):
            lead = data[cut - back]
            if lead < 0x80:
                break
            if lead >= 0xC0:
                wanted = 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 1
                second = data[cut - back + 1] if back > 1 else None
                low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(lead, (0x80, 0xBF))
                if back < wanted and (second is None or low <= second <= high):
                    cut -= back
                break
        self.open = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        data, self.open = self.open, b""
        return data.decode("utf-8", "replace")


def decoded(rows: DataFrame, doc_id: str = "doc_id", ids: str = "ids", vocabulary: str = f"{DIRECTORY}/{VOCABULARY}") -> DataFrame:
    """(doc_id, text): the text of each id list, streamed; unknown ids and nulls give a replacement character, a null list an empty text."""
    tokens = rows.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, lost = tokens.value, "�".encode()
        for batch in batches:
            texts = []
            for row in batch.column(1).to_pylist():
                stream = Utf8Stream()
                data = [known[i] if i is not None and 0 <= i < len(known) else lost for i in row or ()]
                texts.append("".join([stream.push(b"".join(data[a : a + 4096])) for a in range(0, len(data), 4096)]) + stream.close())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    out = rows.select(F.col(doc_id).alias("doc_id"), F.col(ids).cast("array<int>").alias("ids")).mapInArrow(run, f"doc_id {dict(rows.dtypes)[doc_id]}, text string")
    return out.withColumnRenamed("doc_id", doc_id)
