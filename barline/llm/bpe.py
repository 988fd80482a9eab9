"""Byte-level BPE by a lazily determinised transducer, and streaming decoding.

A sequence of tokens is the BPE encoding of its bytes exactly when every two
neighbours encode to themselves together: a merge that crosses a boundary in
the whole sequence would cross it in the pair too, for up to then either side
merges on its own. So a nondeterministic transducer over bytes reads tokens off
a trie and checks each token against the one before it. Its states (what token
is being read after which token) are determinised on demand: a subset holds the
hypotheses still open and the one token that ends at this place. Tokens that
all open hypotheses share are settled and emitted; hypotheses reach back no
further than the longest token, so the lookahead is bounded.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm.common import tune, with_cleared

#: Pieces and states that one worker remembers (about 200 MB together); beyond these it starts afresh.
PIECES, STATES = 250_000, 250_000
#: Tokens that are decoded in one step.
DECODED = 1024
_SHIFT, _LOW = 20, (1 << 20) - 1


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


class Transducer:
    """Encodes pieces of text by ``ranks`` (token bytes to id; a lower id merges first)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = {i: b for b, i in ranks.items()}
        self._pairs: dict[int, bool] = {}
        self._own: dict[int, bool] = {}
        # trie: node -> {byte: node}; a node that is a token has its id
        self._next: list[dict[int, int]] = [{}]
        self._token: list[int] = [-1]
        self._depth: list[int] = [0]
        self._size = {i: len(b) for b, i in ranks.items()}
        self._longest = max(map(len, ranks))
        for token, i in ranks.items():
            at = 0
            for b in token:
                to = self._next[at].get(b)
                if to is None:
                    to = self._next[at][b] = len(self._next)
                    self._next.append({})
                    self._token.append(-1)
                    self._depth.append(self._depth[at] + 1)
                at = to
            self._token[at] = i
        self._reset()

    def _reset(self) -> None:
        # a subset: codes of what is being read (a trie node, and the token before it), and last the token that ends here
        start = (0, -1)
        self._subsets: list[tuple[int, ...]] = [start]
        self._ids = {start: 0}
        self._moves: dict[int, int] = {}  # state << 8 | byte -> next state

    def _merged(self, data: bytes) -> list[int]:
        """BPE of a short byte string by definition."""
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = self.ranks
        while len(parts) > 1:
            best = min(((ranks[ab], i) for i in range(len(parts) - 1) if (ab := parts[i] + parts[i + 1]) in ranks), default=None)
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [ranks[p] for p in parts]

    def _follows(self, prev: int, token: int) -> bool:
        """Whether ``token`` may stand after ``prev`` (-1: at the start)."""
        if prev < 0:
            ok = self._own.get(token)
            if ok is None:
                ok = self._own[token] = self._merged(self.bytes[token]) == [token]
            return ok
        pair = prev << _SHIFT | token
        ok = self._pairs.get(pair)
        if ok is None:
            ok = self._merged(self.bytes[prev] + self.bytes[token]) == [prev, token]
            if len(self._pairs) >= 2 * STATES:
                self._pairs.clear()
            self._pairs[pair] = ok
        return ok

    def _move(self, state: int, byte: int) -> int:
        live, done = [], -1
        for code in (*self._subsets[state][:-1], self._subsets[state][-1] + 1):  # the last: a token may start here
            to = self._next[code >> _SHIFT].get(byte)
            if to is None:
                continue
            before = code & _LOW
            if self._next[to] or not before:
                live.append(to << _SHIFT | before)
            t = self._token[to]
            if done < 0 and t >= 0 and self._follows(before - 1, t):
                done = t
        if done < 0:
            raise ValueError("a byte is no token of this vocabulary")
        live.append(done)
        subset = tuple(live)
        to = self._ids.get(subset)
        if to is None:
            to = self._ids[subset] = len(self._subsets)
            self._subsets.append(subset)
        self._moves[state << 8 | byte] = to
        return to

    def _chain(self, ends: list[int], first: int, at: int) -> list[int]:
        """Tokens up to place ``at``, each found from its end; ``ends[i]`` ends at place first + i + 1."""
        out = []
        while at > first:
            out.append(ends[at - first - 1])
            at -= self._size[out[-1]]
        return out[::-1]

    def stream(self, data: Iterable[int]) -> Iterator[int]:
        """Token ids of one piece, each as soon as the bytes read so far settle it.

        The state at a place names the token that ends there, so tokens follow
        from the last one back. What the chains of all open hypotheses share is
        settled; it is emitted each time as many bytes as the longest token has
        twice have come in.
        """
        if len(self._subsets) > STATES:
            self._reset()
        moves, subsets = self._moves, self._subsets
        state, first, n, ends = 0, 0, 0, []
        for b in data:
            to = moves.get(state << 8 | b)
            if to is None:
                if len(subsets) > 2 * STATES:  # within one very long piece: keep the subset, drop the rest
                    subset = subsets[state]
                    self._reset()
                    moves, subsets = self._moves, self._subsets
                    state = self._ids[subset] = len(subsets)
                    subsets.append(subset)
                to = self._move(state, b)
            state = to
            n += 1
            ends.append(subsets[state][-1])
            if len(ends) >= 2 * self._longest:
                depths = [self._depth[c >> _SHIFT] for c in subsets[state][:-1]]
                chains = [self._chain(ends, first, n - d) for d in (*depths, 0)]
                for tokens in zip(*chains, strict=False):
                    if len(set(tokens)) > 1:
                        break
                    yield tokens[0]
                    first += self._size[tokens[0]]
                ends = ends[len(ends) - (n - first) :]
        for code in subsets[state][:-1]:  # the piece itself is a token, merged or not
            if code >> _SHIFT and not code & _LOW and self._token[code >> _SHIFT] >= 0:
                yield self._token[code >> _SHIFT]
                return
        yield from self._chain(ends, first, n)


class _Pieces(dict):
    """Ids of pieces as bytes, which join fast and are no concern of the collector's; long pieces are not kept."""

    def __init__(self, fst: Transducer):
        super().__init__()
        self.fst = fst

        self.old: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = array("I", self.fst.stream(piece.encode("utf-8", "surrogatepass"))).tobytes()
        if len(piece) <= 64:
            self[piece] = ids
        return ids

    def bound(self, most: int) -> None:
        """Starts another generation; of the one before, what is used moves on."""
        if len(self) > most:
            self.old = dict(self)
            self.clear()


class Codec:
    """Encodes and decodes whole texts; pieces are the matches of ``pattern``, each encoded separately."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.find = regex.compile(pattern).findall
        self.fst = Transducer(ranks)
        self.vocab = self.fst.bytes
        self._cache = _Pieces(self.fst)

    def encode_bytes(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        self._cache.bound(PIECES)
        return b"".join(map(self._cache.__getitem__, self.find(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode_stream(self, ids: Iterable[int], together: int = 1) -> Iterator[str]:
        """Text token by token, or ``together`` tokens at a time; a character whose bytes spread over two steps comes with the later."""
        utf8, ids = Utf8Stream(), iter(ids)
        while some := list(islice(ids, together)):
            if got := utf8.feed(b"".join(map(self.vocab.__getitem__, some))):
                yield got
        if got := utf8.close():
            yield got


class Utf8Stream:
    """Incremental UTF-8 decoder: a state machine over bytes that holds back an incomplete character.

    State: bytes still needed, and the range allowed for the next one, which
    rules out overlong forms, surrogates and values over U+10FFFF. Each maximal
    ill-formed part becomes one U+FFFD.
    """

    def __init__(self) -> None:
        self.need, self.low, self.high, self.value = 0, 0x80, 0xBF, 0

    def feed(self, data: bytes) -> str:
        out = []
        while self.need and data:  # the rest of a character first
            head, data = data[: self.need], data[self.need :]
            out.append(self._bytewise(head))
        if data.isascii():
            return "".join([*out, data.decode("ascii")])
        # whole characters at once; the machine takes the last, which may be cut off, and whatever is ill-formed
        cut = next((len(data) - i for i in (1, 2, 3) if i <= len(data) and data[-i] >= 0xC0), len(data))
        try:
            out += [data[:cut].decode(), self._bytewise(data[cut:])]
        except UnicodeDecodeError:
            out.append(self._bytewise(data))
        return "".join(out)

    def _bytewise(self, data: bytes) -> str:
        out = []
        need, low, high, value = self.need, self.low, self.high, self.value
        for b in data:
            if need:
                if low <= b <= high:
                    value, need, low, high = value << 6 | b & 0x3F, need - 1, 0x80, 0xBF
                    if not need:
                        out.append(chr(value))
                    continue
                out.append("�")
                need, low, high = 0, 0x80, 0xBF
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xDF:
                need, value = 1, b & 0x1F
            elif 0xE0 <= b <= 0xEF:
                need, value = 2, b & 0x0F
                low, high = (0xA0 if b == 0xE0 else 0x80), (0x9F if b == 0xED else 0xBF)
            elif 0xF0 <= b <= 0xF4:
                need, value = 3, b & 0x07
                low, high = (0x90 if b == 0xF0 else 0x80), (0x8F if b == 0xF4 else 0xBF)
            else:
                out.append("�")
        self.need, self.low, self.high, self.value = need, low, high, value
        return "".join(out)

    def close(self) -> str:
        held, self.need, self.low, self.high = self.need, 0, 0x80, 0xBF
        return "�" if held else ""


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec a worker process for each vocabulary file."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(load_ranks(path), pattern)
    return _CODECS[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", *, ids: bool = True) -> DataFrame:
    """All rows and columns of ``docs`` with ``tokens`` (array<int>, unless ``ids`` is false), ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``.

    ``path``: a tiktoken rank file that every executor can open. Special tokens
    are ordinary text. A null text counts as empty: no tokens, the digests of
    no bytes. ``decoded_sha256`` is of the UTF-8 of what the streaming decoder
    gives back. Repeated rows stay. Input columns named as those added are
    replaced. An empty table gives an empty result.
    """
    tune(docs.sparkSession)
    added = [*(["tokens"] if ids else []), "n_tokens", "ids_sha256", "decoded_sha256"]
    own = with_cleared(docs, *added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            toks, n, sums, back = [], [], [], []
            for t in b.column(text).to_pylist():
                data = c.encode_bytes(t or "")
                a = np.frombuffer(data, "<u4")
                n.append(len(a))
                sums.append(hashlib.sha256(data).hexdigest())
                decoded = hashlib.sha256()
                for part in c.decode_stream(a.tolist(), DECODED):
                    decoded.update(part.encode())
                back.append(decoded.hexdigest())
                if ids:
                    toks.append(a.astype(np.int32))
            cols = [pa.array(toks, pa.list_(pa.int32()))] if ids else []
            cols += [pa.array(n, pa.int64()), pa.array(sums, pa.string()), pa.array(back, pa.string())]
            yield pa.RecordBatch.from_arrays([*[b.column(x) for x in keep], *cols], names=[*keep, *added])

    keep = [c for c in own.columns if ids or c != text]
    kinds = ", ".join(f"`{c}` {own.schema[c].dataType.simpleString()}" for c in keep)
    more = ("tokens array<int>, " if ids else "") + "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return own.select(*own.columns).mapInArrow(run, f"{kinds}, {more}")


def digests(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row."""
    return encode(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), path, pattern, ids=False)
