"""Byte-level BPE as a lazily determinised finite-state transducer.

Encoding. The encoding of every prefix of a piece is unique, and its last token
follows from the encodings of shorter prefixes: token ``t`` ends the encoding
of a prefix if ``t`` is a suffix of it and the token before fits, that is, the
merges leave the two side by side. So the merges compile into a transducer over
bytes of two passes. A state of the forward pass holds every open place (a place
from which the bytes read since then may still grow into a token) and the token
before it; a step drops the places that no token can leave any more and gives
the last token of the prefix. The backward pass walks from token to token.
States are made when a text first needs them (determinised lazily), shared by
all texts of a task and dropped together when they, or the steps between them,
exceed a fixed number.

Decoding. Token ids give bytes; an incremental UTF-8 state machine turns the
byte stream into characters, holding back at most three bytes of an unfinished
one.

Defined cases: null and empty texts have no tokens and decode to empty bytes; a
piece that is itself a vocabulary entry is that one token, as in the library;
long pieces are read byte by byte; repeated rows and empty tables need nothing
special; columns other than id and text are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cairn.llm.common import keyed_text, text_blocks

MAX_STATES = 250_000
MAX_STEPS = 500_000
MAX_PIECES = 300_000
_BITS = 24  # of a token's number
_MASK = (1 << _BITS) - 1
_NONE = -1 << 62


def read_ranks(path: str) -> dict[bytes, int]:
    """A ``.tiktoken`` file: base64 token and rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def halves(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts whose merge makes the token: the neighbours of least rank
    merge until two parts are left. None for a byte, and for a token that the
    merges alone do not build."""
    parts = [token[i:i + 1] for i in range(len(token))]
    while len(parts) > 2:
        pairs = [ranks.get(x + y, 1 << 62) for x, y in zip(parts, parts[1:])]
        least = min(pairs)
        if least == 1 << 62:
            return None
        at = pairs.index(least)
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


class Transducer:
    """Bytes of one piece to token ids, in two passes. Forward, ``_step[state | byte]``
    (states are numbered in steps of 256) gives the next state and, in its low
    bits, the last token of the encoding of the prefix read so far; backward, each
    token so found leads to the prefix before it.

    A state is its open places, the earliest first, each one number: the node of
    the vocabulary's trie that the bytes since the place lead to, a free byte, and
    in the low bits the last token before the place, plus 1 (0: the piece begins
    there)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self._tokens = {i: t for t, i in ranks.items()}
        self._sizes = {i: len(t) for t, i in ranks.items()}
        # The trie: node << 8 | byte to the node there; a node's token (NONE: no token; ~token: not
        # known yet whether the merges build it); whether a node goes on.
        self._child: dict[int, int] = {}
        self._token, self._open = [_NONE], bytearray(1)
        for t, i in ranks.items():
            node = 0
            for byte in t:
                self._open[node] = 1
                to = self._child.get(node << 8 | byte)
                if to is None:
                    to = self._child[node << 8 | byte] = len(self._token)
                    self._token.append(_NONE)
                    self._open.append(0)
                node = to
            self._token[node] = i if len(t) == 1 else ~i
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._fits: dict[int, bool] = {}
        self._reset()

    def _reset(self) -> None:
        start = (0,)
        self._states = [start]
        self._ids = {start: 0}
        self._step: dict[int, int] = {}

    def _parts(self, t: int) -> tuple[int, int] | None:
        try:
            return self._halves[t]
        except KeyError:
            two = halves(self._tokens[t], self.ranks)
            got = self._halves[t] = two and (self.ranks[two[0]], self.ranks[two[1]])
            return got

    def _fit(self, a: int, b: int) -> bool:
        """Whether the merges leave the two tokens side by side. The merges of
        both that touch the border are undone, the latest first; the tokens do
        not fit if the parts at the border would have merged before that. Of
        equal ranks the left merge comes first."""
        if len(self._fits) >= MAX_PIECES:
            self._fits.clear()
        x, y, rank, tokens, before = a, b, self.ranks.get, self._tokens, 1 << 62
        while fit := rank(tokens[x] + tokens[y], 1 << 62) >= before:
            left, right = self._parts(x), self._parts(y)
            if left is None and right is None:
                break
            if right is None or left is not None and x > y:
                before, x = x, left[1]
            else:
                before, y = y + 1, right[0]
        self._fits[a + 1 << _BITS | b] = fit
        return fit

    def _advance(self, state: int, byte: int) -> int:
        child, token_at, goes_on, fits = self._child.get, self._token, self._open, self._fits.get
        end, live = -1, []
        for place in self._states[state >> 8]:
            to = child(place >> _BITS | byte)
            if to is None:
                continue
            last = place & _MASK
            if end < 0 and (token := token_at[to]) != _NONE:
                if token < 0:
                    token = token_at[to] = ~token if self._parts(~token) else _NONE
                if token != _NONE:
                    fit = last == 0 or fits(last << _BITS | token)
                    if fit or fit is None and self._fit(last - 1, token):
                        end = token
            if goes_on[to]:
                live.append(to << _BITS + 8 | last)
        if end < 0:
            raise ValueError(f"the vocabulary has no token for byte {byte}")
        live.append(end + 1)
        new = tuple(live)
        to = self._ids.get(new)
        if to is None:
            to = self._ids[new] = len(self._states) << 8
            self._states.append(new)
        out = self._step[state | byte] = to << _BITS | end
        return out

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self._states) > MAX_STATES or len(self._step) > MAX_STEPS:
            self._reset()
        hops, state, step = [], 0, self._step.get
        for byte in piece:
            hop = step(state | byte)
            if hop is None:
                hop = self._advance(state, byte)
            hops.append(hop)
            state = hop >> _BITS
        out, at, sizes = [], len(hops), self._sizes
        while at:
            token = hops[at - 1] & _MASK
            out.append(token)
            at -= sizes[token]
        out.reverse()
        return out


class Utf8Stream:
    """Incremental UTF-8 state machine. The state is the unfinished character's
    bytes, at most three; invalid bytes become U+FFFD."""

    def __init__(self):
        self._open = b""

    @staticmethod
    def _unfinished(data: bytes) -> int:
        """How many trailing bytes start a character that is not complete."""
        for back in range(1, min(3, len(data)) + 1):
            b = data[-back]
            if b >= 0xC0:
                need = 2 if b < 0xE0 else 3 if b < 0xF0 else 4
                return back if back < need and b < 0xF8 else 0
            if b < 0x80:
                return 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self._open + data
        keep = self._unfinished(data)
        self._open = data[len(data) - keep:]
        return data[:len(data) - keep].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self._open = self._open, b""
        return rest.decode("utf-8", "replace")


class _Pieces(dict):
    """Ids of the pieces met so far, each four bytes; cleared when full."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self._transducer = transducer

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= MAX_PIECES:
            self.clear()
        ids = array("i", self._transducer.encode(piece.encode())).tobytes()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class Codec:
    """A vocabulary and its piece pattern, unfolded once in each Python worker.
    The vocabulary's size is fixed by its file, not by the data."""

    _workers: dict[str, tuple] = {}

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        ranks = read_ranks(path)
        self.key = hashlib.sha256(repr((pattern, sorted(ranks.items()))).encode()).hexdigest()
        self.pattern = pattern
        self._ranks = spark.sparkContext.broadcast(ranks)

    def __getstate__(self):
        return {"key": self.key, "pattern": self.pattern, "_ranks": self._ranks}

    def _unfolded(self) -> tuple:
        if self.key not in self._workers:
            import regex

            ranks = self._ranks.value
            vocabulary: list[bytes | None] = [None] * (max(ranks.values()) + 1)
            for t, i in ranks.items():
                vocabulary[i] = t
            self._workers.clear()
            self._workers[self.key] = (regex.compile(self.pattern).findall, _Pieces(Transducer(ranks)), vocabulary)
        return self._workers[self.key]

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        findall, pieces, _ = self._unfolded()
        return np.frombuffer(b"".join(map(pieces.__getitem__, findall(text))), np.int32)

    def encode(self, text: str | None) -> list[int]:
        return self.ids(text).tolist()

    def decode_bytes(self, ids) -> bytes:
        return b"".join(map(self._unfolded()[2].__getitem__, ids))

    def decode(self, ids, chunk: int = 4096) -> str:
        """Text of the ids, as a reader of a token stream gets it."""
        stream = Utf8Stream()
        out = [stream.feed(self.decode_bytes(ids[i:i + chunk])) for i in range(0, len(ids), chunk)]
        return "".join([*out, stream.close()])


def _parts(batches):
    """The batches in row slices of about a megabyte of text each."""
    for batch in batches:
        for rows, _, _ in text_blocks(batch):
            yield batch.slice(rows.start, rows.stop - rows.start)


def _encoded(batches, codec: Codec):
    for batch in _parts(batches):
        lengths, values = [0], []
        for text in batch.column("text"):
            ids = codec.ids(text.as_py())
            values.append(ids)
            lengths.append(lengths[-1] + len(ids))
        lists = pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(np.concatenate(values)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], names=["doc_id", "ids"])


def _id_arrays(column) -> list[np.ndarray]:
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.int32, copy=False)
    off = column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(off[:-1], off[1:])]


def _decoded(batches, codec: Codec):
    for batch in batches:
        texts = [codec.decode(ids.tolist()) for ids in _id_arrays(batch.column("ids"))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(texts, pa.string())],
                                         names=["doc_id", "ids", "decoded"])


def _digested(batches):
    for batch in batches:
        arrays = _id_arrays(batch.column("ids"))
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id"),
            pa.array([len(a) for a in arrays], pa.int64()),
            pa.array([hashlib.sha256(a.astype("<u4").tobytes()).hexdigest() for a in arrays], pa.string()),
            pa.array([hashlib.sha256((t.as_py() or "").encode()).hexdigest() for t in batch.column("decoded")], pa.string()),
        ], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def encode(docs: DataFrame, codec: Codec, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>): the token ids of every text."""
    kind = docs.schema[id_col].dataType.simpleString()
    return keyed_text(docs, id_col, text_col).mapInArrow(lambda b: _encoded(b, codec), f"doc_id {kind}, ids array<int>")


def decode(tokens: DataFrame, codec: Codec) -> DataFrame:
    """(doc_id, ids, decoded): the text of every row's ids."""
    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", "ids").mapInArrow(
        lambda b: _decoded(b, codec), f"doc_id {kind}, ids array<int>, decoded string")


def round_trip_digest(docs: DataFrame, codec: Codec, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of the query: both directions and the digests in one pass,
    so that a task needs one Python worker and ids never leave it."""
    kind = docs.schema[id_col].dataType.simpleString()
    return keyed_text(docs, id_col, text_col).mapInArrow(
        lambda b: _digested(_decoded(_encoded(b, codec), codec)),
        f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
