"""Byte-pair encoding as a lazily determinised transducer, and streaming decoding.

Merging by rank is local: a sequence of tokens is the encoding of its bytes exactly if each token is
its own encoding and each neighbouring pair is the encoding of the pair's bytes. So every prefix of a
text has one last token, and the encoding so far is read off by walking those last tokens backwards.
The transducer keeps the bytes since the last point through which all continuations must pass; a
token is emitted as soon as every way a longer token could still arise agrees on it, so lookahead is
bounded by the longest token. States are made on first use and kept in a bounded table.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import regex


def read_ranks(path: str) -> dict[bytes, int]:
    """A .tiktoken file: base64 token and rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Vocabulary:
    """Token bytes by id, ids by bytes, and the merge rule: two ids give (rank, merged id) or None."""

    def __init__(self, tokens: dict[int, bytes], merge: Callable[[int, int], tuple[int, int] | None], whole: bool):
        self.bytes = tokens
        self.ids = {b: i for i, b in tokens.items()}
        self.merge = merge
        self.whole = whole  # a piece that is itself a token is that token, merges or not
        self._born: dict[int, tuple[int, int, int] | None] = {}
        self._edges: tuple[dict, dict] = ({}, {})

    @classmethod
    def from_ranks(cls, ranks: dict[bytes, int]) -> Vocabulary:
        """Any two neighbours merge whose bytes together are a token; the rank is the token's id."""
        tokens = {i: b for b, i in ranks.items()}

        def merge(a: int, b: int) -> tuple[int, int] | None:
            i = ranks.get(tokens[a] + tokens[b])
            return None if i is None else (i, i)

        return cls(tokens, merge, whole=True)

    @classmethod
    def from_merges(cls, tokens: dict[int, bytes], merges: Iterable[tuple[bytes, bytes]]) -> Vocabulary:
        """Only the listed pairs merge, in the order of the list."""
        ids = {b: i for i, b in tokens.items()}
        pairs = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(merges)}
        return cls(tokens, lambda a, b: pairs.get((a, b)), whole=False)

    def born(self, token: int) -> tuple[int, int, int] | None:
        """(rank, left, right) of the merge that makes the token from its bytes; rank -1 for a byte; None if no merges make it."""
        if token not in self._born:
            data = self.bytes[token]
            if len(data) == 1:
                self._born[token] = (-1, -1, -1)
            else:
                parts = merge_encode(self, data, stop=2)
                m = self.merge(*parts) if len(parts) == 2 else None
                self._born[token] = (m[0], *parts) if m and m[1] == token else None
        return self._born[token]

    def edge(self, token: int, side: int) -> list[tuple[int, int, int]]:
        """Tokens that stand at the left (0) or right (1) end while the token is made: (token, rank made, rank taken up)."""
        known = self._edges[side]
        if token not in known:
            out, until, t = [], 1 << 40, token
            while t >= 0:
                rank, *parts = self.born(t)
                out.append((t, rank, until))
                until, t = rank, parts[side]
            known[token] = out
        return known[token]

    def stays(self, a: int, b: int) -> bool:
        """Whether a followed by b is the encoding of their bytes: no two of their end tokens meet and merge first.

        Of equal ranks the merge further left comes first.
        """
        merge = self.merge
        for x, made_x, taken_x in self.edge(a, 1):
            for y, made_y, taken_y in self.edge(b, 0):
                if made_x < taken_y and made_y < taken_x and (m := merge(x, y)) is not None and m[0] < taken_x and m[0] <= taken_y:
                    return False
        return True


def merge_encode(v: Vocabulary, piece: bytes, stop: int = 1) -> list[int]:
    """The defining procedure: merge the pair of least rank, leftmost first, until none, or only stop tokens, are left."""
    parts = [v.ids[piece[i : i + 1]] for i in range(len(piece))]
    while len(parts) > stop:
        best = None
        for i in range(len(parts) - 1):
            m = v.merge(parts[i], parts[i + 1])
            if m is not None and (best is None or m[0] < best[0]):
                best = (m[0], i, m[1])
        if best is None:
            break
        parts[best[1] : best[1] + 2] = [best[2]]
    return parts


class State:
    """last: the token before the pending bytes (-1: none); ends[i]: the last token of the first i pending bytes.

    live: the places in the pending bytes from which one token may still reach beyond them, and their end.
    """

    __slots__ = ("ends", "last", "live", "next", "pending", "rest")

    def __init__(self, last: int, pending: bytes, ends: tuple[int, ...], live: tuple[int, ...]):
        self.last, self.pending, self.ends, self.live = last, pending, ends, live
        self.next: dict[int, tuple[State, tuple[int, ...]]] | int | None = None  # by byte, or the number of the state
        self.rest: tuple[int, ...] | None = None


class Transducer:
    """Bytes in, tokens out. A transition carries the tokens that it emits; a state, those at the end of input.

    Once max_states are kept, further ones serve once and are dropped; the table starts anew when
    these have become many, as after a change of language.
    """

    def __init__(self, vocabulary: Vocabulary, max_states: int = 250_000):
        self.v = vocabulary
        self.max_states = max_states
        self.prefixes = {b[:n] for b in vocabulary.ids for n in range(1, len(b))}
        self.pairs: dict[int, bool] = {}  # by (a << 32) + b
        self.reset()

    def reset(self) -> None:
        """Forgets all states; they are made again on use."""
        self.states: dict[tuple[int, bytes], State] = {}
        self.passing = 0
        self.start = self._state(-1, b"", (-1,), (0,))

    def _state(self, last: int, pending: bytes, ends: tuple[int, ...], live: tuple[int, ...]) -> State:
        s = self.states.get((last, pending))
        if s is None:
            s = State(last, pending, ends, live)
            s.next = {}
            if len(self.states) < self.max_states:
                self.states[last, pending] = s
            else:
                self.passing += 1
        return s

    def _fits(self, a: int, b: int) -> bool:
        """Whether b, after a (-1: at the start), stays as it is."""
        pair = (a << 32) + b
        known = self.pairs.get(pair)
        if known is None:
            if len(self.pairs) > self.max_states:
                self.pairs.clear()
            known = self.pairs[pair] = self.v.born(b) is not None and (a < 0 or self.v.stays(a, b))
        return known

    def _path(self, ends: tuple[int, ...], at: int) -> tuple[int, ...]:
        """The tokens of the first bytes, up to at."""
        out = []
        while at:
            out.append(ends[at])
            at -= len(self.v.bytes[ends[at]])
        return tuple(out[::-1])

    def step(self, s: State, byte: int) -> tuple[State, tuple[int, ...]]:
        """The state after one more byte, and what is certain by then. Remembered in s."""
        ids, pairs, prefixes, last_of = self.v.ids, self.pairs, self.prefixes, s.ends
        pending, found, live = s.pending + bytes((byte,)), None, []
        for start in s.live:
            tail = pending[start:]
            if found is None and (token := ids.get(tail)) is not None:
                before = last_of[start] if start else s.last
                if pairs.get((before << 32) + token) or self._fits(before, token):
                    found = token
            if tail in prefixes:
                live.append(start)
        if found is None:
            raise ValueError("the vocabulary lacks a single byte")
        ends, n = (*last_of, found), len(pending)
        live.append(n)
        if live[0]:  # no token takes up all of the pending bytes: walk back to where all ways meet
            size, ways = self.v.bytes, set(live)
            while len(ways) > 1:
                at = max(ways)
                ways.remove(at)
                ways.add(at - len(size[ends[at]]))
            cut = ways.pop()
            if cut:
                emitted = self._path(ends, cut)
                return self._to(s, byte, (emitted[-1], pending[cut:], (-1, *ends[cut + 1 :]), tuple([i - cut for i in live])), emitted)
        return self._to(s, byte, (s.last, pending, ends, tuple(live)), ())

    def _to(self, s: State, byte: int, after: tuple, emitted: tuple[int, ...]) -> tuple[State, tuple[int, ...]]:
        """The transition, remembered if the state after it is kept."""
        out = self._state(*after), emitted
        if after[:2] in self.states:
            s.next[byte] = out
        return out

    def finish(self, s: State) -> tuple[int, ...]:
        """The tokens of the pending bytes, once no more come."""
        if s.rest is None:
            s.rest = self._path(s.ends, len(s.pending))
        return s.rest

    def encode(self, piece: bytes) -> list[int]:
        if self.v.whole and (whole := self.v.ids.get(piece)) is not None:
            return [whole]
        if self.passing > 20 * self.max_states:
            self.reset()
        s, out = self.start, []
        for byte in piece:
            s, emitted = s.next.get(byte) or self.step(s, byte)
            if emitted:
                out += emitted
        return [*out, *self.finish(s)]


class _Numbered(Transducer):
    """A transducer whose states know their place in a list, and whose transitions are kept elsewhere."""

    def reset(self) -> None:
        self.listed: list[State] = []
        super().reset()

    def _state(self, last: int, pending: bytes, ends: tuple[int, ...], live: tuple[int, ...]) -> State:
        s = self.states.get((last, pending))
        if s is None:
            s = self.states[last, pending] = State(last, pending, ends, live)
            s.next = len(self.listed)
            self.listed.append(s)
        return s

    def _to(self, s: State, byte: int, after: tuple, emitted: tuple[int, ...]) -> tuple[State, tuple[int, ...]]:
        return self._state(*after), emitted


class CountTable:
    """The transducer compiled for counting: states are numbers, and a transition carries how many tokens it emits.

    Transitions are made on first use and kept in one array of (state and byte, state after and tokens),
    by open addressing, so that many stretches of bytes move at once. State 0 is the start.
    """

    def __init__(self, vocabulary: Vocabulary, max_states: int = 500_000, max_moves: int = 1_000_000):
        self.transducer = _Numbered(vocabulary)
        self.max_states, self.max_moves = max_states, max_moves
        self.reset()

    def reset(self) -> None:
        self.transducer.reset()
        self.objects = self.transducer.listed
        self.ends = np.full(1 << 12, -1, np.int64)  # what ends with the input in a state; -1: not asked for yet
        self.moves, self.log = 0, 16
        self.table = np.full((1 << self.log, 2), -1, np.int64)

    def trim(self) -> None:
        """Forgets all if there is much; only between texts, as state numbers change."""
        if len(self.objects) > self.max_states or self.moves > self.max_moves:
            self.reset()

    def rest(self, states: np.ndarray) -> np.ndarray:
        """For each state, the tokens of what is pending in it."""
        if len(self.objects) > len(self.ends):
            self.ends = np.append(self.ends, np.full(len(self.objects), -1, np.int64))
        out = self.ends[states]
        if len(out) and out.min() < 0:
            for n in np.unique(states[out < 0]).tolist():
                s = self.objects[n]
                self.ends[n] = len(self.transducer._path(s.ends, len(s.pending)))
            out = self.ends[states]
        return out

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.log)).view(np.int64)

    def _insert(self, rows: np.ndarray) -> None:
        at, mask = self._home(rows[:, 0].copy()), len(self.table) - 1
        while len(rows):
            free = np.flatnonzero(self.table[at, 0] < 0)
            slot, one = np.unique(at[free], return_index=True)  # of several for one slot the first has it
            done = free[one]
            self.table[slot] = rows[done]
            left = np.ones(len(rows), bool)
            left[done] = False
            rows, at = rows[left], (at[left] + 1) & mask

    def _learn(self, keys: np.ndarray) -> None:
        values, step, objects = [], self.transducer.step, self.objects
        for key in keys.tolist():
            after, emitted = step(objects[key >> 8], key & 255)
            values.append(after.next << 16 | len(emitted))
        self.moves += len(keys)
        while 3 * self.moves > len(self.table):
            old = self.table[self.table[:, 0] >= 0]
            self.log += 1
            self.table = np.full((1 << self.log, 2), -1, np.int64)
            self._insert(old)
        self._insert(np.stack([keys, np.array(values, np.int64)], axis=1))

    def step(self, states: np.ndarray, data: np.ndarray) -> np.ndarray:
        """For each state and byte: the number of the state after, and below it, in 16 bits, the tokens emitted."""
        keys = states << 8 | data
        while True:
            at, mask = self._home(keys), len(self.table) - 1
            rows = self.table.take(at, axis=0)
            off, unknown = np.flatnonzero(rows[:, 0] != keys), None
            while len(off):
                none = rows[off, 0] < 0
                if none.any():
                    unknown = np.unique(keys[off[none]])
                    break
                at[off] = (at[off] + 1) & mask
                rows[off] = self.table[at[off]]
                off = off[rows[off, 0] != keys[off]]
            if unknown is None:
                return rows[:, 1]
            self._learn(unknown)

    def run(self, data: np.ndarray, marks: np.ndarray, starts: np.ndarray, sizes: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What stretches of bytes do to states: (tokens, state after) for each, from its entry. Before a marked byte a piece ends."""
        count, leave = np.zeros(len(starts), np.int64), entry.copy()
        for block in range(0, len(starts), 8192):
            order = block + np.argsort(-sizes[block : block + 8192], kind="stable")
            at, live, state, n_tokens = starts[order], sizes[order], entry[order], np.zeros(len(order), np.int64)
            ends = np.searchsorted(-live, -np.arange(live[0] if len(live) else 0), "left")  # how many are longer than k
            for k, n in enumerate(ends.tolist()):
                place = at[:n] + k
                cut = np.flatnonzero(marks[place])
                if len(cut):
                    n_tokens[cut] += self.rest(state[cut])
                    state[cut] = 0
                moved = self.step(state[:n], data[place])
                state[:n] = moved >> 16
                n_tokens[:n] += moved & 0xFFFF
            count[order], leave[order] = n_tokens, state
        return count, leave


class Remembered(dict):
    """What a function gives for a piece of text, kept for pieces that come again.

    Two generations of at most limit pieces: when this one is full it becomes the older one, from
    which pieces in use come back, and what was older is dropped. Long pieces aren't kept.
    """

    def __init__(self, make: Callable[[str], object], limit: int = 120_000):
        super().__init__()
        self.make, self.limit, self.older = make, limit, {}

    def __missing__(self, piece: str):
        out = self.older.get(piece)
        if out is None:
            out = self.make(piece)
        if len(piece) <= 64:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[piece] = out
        return out


#: The pattern of the byte-level vocabularies, and the same for texts of Latin-1 characters only, whose
#: classes are written out: a plain character set is matched several times faster.
GENERAL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
LATIN = f" ?[{_L}]+|'(?:[stmd]|re|ve|ll)| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """text -> the matches of the pattern, in order."""
    general = regex.compile(pattern).findall
    if pattern != GENERAL:
        return general
    latin, beyond = re.compile(LATIN).findall, re.compile("[^\0-\xff]").search
    return lambda text: latin(text) if text.isascii() or not beyond(text) else general(text)


class Encoder:
    """Texts to ids: each match of the pattern goes through the transducer by itself."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.pieces = splitter(pattern)
        self.transducer = Transducer(vocabulary)
        encode = self.transducer.encode
        self.known = Remembered(lambda piece: b"".join([i.to_bytes(4, "little") for i in encode(piece.encode())]))

    def packed(self, text: str | None) -> bytes:
        """The ids as little-endian 32-bit numbers."""
        return b"".join(map(self.known.__getitem__, self.pieces(text or "")))


#: State after the bytes of one class, for UTF-8: 0 is between characters, 1 to 3 wait for that many
#: continuation bytes, 4 to 7 wait for a second byte of limited range (after E0, ED, F0, F4); -1 rejects.
def _utf8_next(state: int, byte: int) -> int:
    if state == 0:
        if byte < 0x80:
            return 0
        if 0xC2 <= byte <= 0xDF:
            return 1
        if 0xE0 <= byte <= 0xEF:
            return {0xE0: 4, 0xED: 5}.get(byte, 2)
        if 0xF0 <= byte <= 0xF4:
            return {0xF0: 6, 0xF4: 7}.get(byte, 3)
        return -1
    low, high, after = {1: (0x80, 0xBF, 0), 2: (0x80, 0xBF, 1), 3: (0x80, 0xBF, 2), 4: (0xA0, 0xBF, 1), 5: (0x80, 0x9F, 1), 6: (0x90, 0xBF, 2), 7: (0x80, 0x8F, 2)}[state]
    return after if low <= byte <= high else -1


class Utf8Stream:
    """Bytes in pieces of any kind, text out; a character that is cut waits in the state for its rest.

    Bytes that can't be UTF-8 become U+FFFD, as bytes.decode(errors="replace") has it.
    """

    def __init__(self):
        self.waiting = b""

    def feed(self, data: bytes) -> str:
        data = self.waiting + data
        keep = 0
        for back in range(1, min(3, len(data)) + 1):  # a character has at most 4 bytes, so at most 3 wait
            lead = data[-back]
            if lead & 0xC0 != 0x80:
                state = 0
                for byte in data[-back:]:
                    state = _utf8_next(state, byte)
                    if state < 0:
                        break
                keep = back if state > 0 else 0
                break
        self.waiting = data[len(data) - keep :]
        return data[: len(data) - keep].decode("utf-8", "replace")

    def close(self) -> str:
        out, self.waiting = self.waiting.decode("utf-8", "replace"), b""
        return out


def decode_stream(tokens: dict[int, bytes], ids: Iterable[int], window: int = 8192) -> Iterator[str]:
    """Text as it becomes certain, a window of ids at a time. Unknown ids are an error."""
    stream, ids = Utf8Stream(), list(ids)
    for i in range(0, len(ids), window):
        yield stream.feed(b"".join(map(tokens.__getitem__, ids[i : i + window])))
    yield stream.close()
