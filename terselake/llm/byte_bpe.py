"""Byte-level BPE encoding and decoding through a lazily determinised transducer.

A sequence of tokens is the BPE encoding of its bytes exactly if every two neighbours are
compatible, that is, their joined bytes encode to just the two. So the encoding of every prefix
has one last token, found among the tokens that end there: the one compatible with the last token
at its own start. The transducer reads bytes; its state is the last settled token and the bytes
since then. A boundary is settled, and the tokens before it are emitted, once every place where
a token could still be under way has it in its history; that lookahead is bounded by the
longest token. States and transitions are made when first needed and start again when their
store is full.

Stretches between spaces are kept in a bounded table (whole paths through the transducer). The
decoder joins token bytes and decodes them with an incremental UTF-8 state machine that holds back
the bytes of an unfinished character.

Edge cases: null or empty text gives no ids; repeated rows get equal results; an empty
table gives no rows; an id outside the vocabulary raises KeyError when decoding.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterable, Iterator
from itertools import tee

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terselake.llm import common
from terselake.llm.word_table import WordTable

#: Bounds of a worker's stores.
_STATES, _PAIRS, _PIECES, _STRETCHES = 150_000, 150_000, 60_000, 1_400_000
#: Bytes read between two looks at the size of the state store, and the longest piece that is remembered.
_BETWEEN, _LONGEST = 4096, 256
_NEVER = 1 << 60
_BYTE = [bytes((k,)) for k in range(256)]
_IDS = struct.Struct("<I")
#: The key of the first state, where no token is settled.
_START = b"\xff" * 4


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """A rank file: a line for each token, its bytes in base64 and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines()) }


# Fixed value: the widespread splitting pattern, for which letters and the marks after them are two pieces.
USUAL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PLAIN = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")

_TWO_LINES = re.compile(_PLAIN.pattern + "(\n)" + _PLAIN.pattern.replace(" ?", "", 1))


class Transducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.length = {v: len(k) for k, v in ranks.items()}
        #: The tokens' trie: children by node << 8 | byte, the token at each node or -1, and whether longer ones pass it.
        self.child: dict[int, int] = {}
        self.token_at, self.passed = [-1], [True]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                self.passed[node] = True
                if (below := self.child.get(node << 8 | byte)) is None:
                    below = self.child[node << 8 | byte] = len(self.token_at)
                    self.token_at.append(-1)
                    self.passed.append(False)
                node = below
            self.token_at[node] = rank
        self.halves = common.BoundedMemo(self._halves_of, len(ranks))
        self.compatible = common.BoundedMemo(self._compatible, _PAIRS)
        self._reset()

    def _reset(self) -> None:
        self.number: dict[bytes, int] = {}
        #: Of each state: its key, its last settled token (-1 at the start), then the last token at each place of the bytes
        #: since (-2 where no live history ends), the places where a token may be under way, and their trie nodes.
        #: The key is the settled token, in four bytes, and the bytes since.
        self.states: list[tuple] = []
        self.rests: list[bytes | None] = []
        #: state << 8 | byte leads to the next state, with what is emitted on the way, if anything is.
        self.step: dict[int, int | tuple[int, bytes]] = {}
        self._state((_START, -1))

    def _merge(self, data: bytes, until: int) -> list[bytes]:
        """Plain BPE of one token's bytes, down to `until` parts: the least-ranked pair merges first, of equals the left one."""
        parts, ranks = [data[k:k + 1] for k in range(len(data))], self.ranks
        while len(parts) > until:
            best, at = min((ranks.get(parts[k] + parts[k + 1], _NEVER), k) for k in range(len(parts) - 1))
            if best == _NEVER:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _halves_of(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a byte and for a token that merging never makes."""
        data = self.bytes_of[token]
        parts = self._merge(data, 2) if len(data) > 1 else ()
        return (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None

    def _compatible(self, pair: int) -> bool:
        """Whether merging leaves the border between two tokens alone; pair: (first + 1) << 32 | second.

        Their own merges are undone, the latest first. While two tokens face each other across the
        border, a merge over it would come before `limit`, the merge that made one of them part of
        a larger one; on equal ranks the left merge comes first.
        """
        a, b = (pair >> 32) - 1, pair & 0xFFFFFFFF
        if a == -1:
            return len(self.bytes_of[b]) == 1 or self.halves[b] is not None
        if not (self.compatible[a] and self.compatible[b]):
            return False
        limit = _NEVER
        while True:
            if self.ranks.get(self.bytes_of[a] + self.bytes_of[b], _NEVER) < limit:
                return False
            of_a, of_b = self.halves[a], self.halves[b]
            if of_a is None and of_b is None:
                return True
            if of_b is None or (of_a is not None and a > b):
                limit, a = a, of_a[1]
            else:
                limit, b = b + 1, of_b[0]

    def _state(self, state: tuple) -> int:
        if (k := self.number.get(state[0])) is None:
            k = self.number[state[0]] = len(self.states)
            self.states.append(state)
            self.rests.append(None)
        return k

    def _history(self, last: tuple[int, ...], at: int) -> list[int]:
        """The tokens that lead to place `at`, from the settled boundary on."""
        out, length = [], self.length
        while at > 0:
            out.append(last[at - 1])
            at -= length[last[at - 1]]
        return out[::-1]

    def transition(self, key: int) -> int | tuple[int, bytes]:
        known = self.states[key >> 8]
        name, settled = known[:2]
        byte, n, length = key & 255, len(name) - 4, self.length
        live = (len(known) - 2 - n) // 2
        last, places, nodes = known[2:2 + n], known[2 + n:2 + n + live], known[2 + n + live:]
        child, token_at, passed, compatible, token = self.child.get, self.token_at, self.passed, self.compatible, -2
        under_way, reached = [], []
        for start, node in zip((*places, n), (*nodes, 0)):  # from the first on: the longest token first
            if (node := child(node << 8 | byte)) is None:
                continue
            if token == -2 and (t := token_at[node]) >= 0 and compatible[((last[start - 1] if start else settled) + 1) << 32 | t]:
                token = t
            if passed[node]:
                under_way.append(start)
                reached.append(node)
        n += 1
        last = (*last, token)
        # the last boundary that lies on the history of all places where a token is under way or may start
        cut = n
        for other in reversed(under_way):
            while cut != other:
                if cut > other:
                    cut -= length[last[cut - 1]]
                else:
                    other -= length[last[other - 1]]
            if not cut:
                return self._state((name + _BYTE[byte], settled, *last, *under_way, *reached))
        if cut == n:
            out = (token,) if length[token] == n else self._history(last, n)
            return self._state((_IDS.pack(token), token)), b"".join(map(_IDS.pack, out))
        out = self._history(last, cut)
        rest, joined = [], {cut}  # places whose history misses the new boundary are dead
        for k in range(cut + 1, n + 1):
            t = last[k - 1]
            if t != -2 and k - length[t] in joined:
                joined.add(k)
                rest.append(t)
            else:
                rest.append(-2)
        on = [(k - cut, node) for k, node in zip(under_way, reached) if k in joined]
        state = (_IDS.pack(out[-1]) + name[4 + cut:] + _BYTE[byte], out[-1], *rest, *[k for k, _ in on], *[x for _, x in on])
        return self._state(state), b"".join(map(_IDS.pack, out))

    def rest(self, state: int) -> bytes:
        """What is still to be emitted when the bytes end in a state."""
        if (found := self.rests[state]) is None:
            known = self.states[state]
            n = len(known[0]) - 4
            found = self.rests[state] = b"".join(map(_IDS.pack, self._history(known[2:2 + n], n)))
        return found

    def encode(self, data: bytes) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        state, out = 0, []
        for at in range(0, len(data), _BETWEEN):
            if len(self.states) > _STATES or len(self.step) > 2 * _STATES:  # start again, from the state that has been reached
                reached = self.states[state]
                self._reset()
                state = self._state(reached)
            step = self.step
            for byte in data[at:at + _BETWEEN]:
                key = state << 8 | byte
                found = step.get(key)
                if found is None:
                    found = step[key] = self.transition(key)
                if found.__class__ is int:
                    state = found
                else:
                    state, emitted = found
                    out.append(emitted)
        out.append(self.rest(state))
        return b"".join(out)


class Utf8Stream:
    """Incremental UTF-8: feed bytes, get the characters that are complete; up to three bytes wait."""

    def __init__(self):
        self.held = b""

    def feed(self, data: bytes) -> str:
        data = self.held + data
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead & 0xC0 == 0x80:  # a continuation byte: its lead is further back
                continue
            if lead >= 0xC0 and back < (2 if lead < 0xE0 else 3 if lead < 0xF0 else 4):
                cut = len(data) - back
            break
        self.held = data[cut:]
        return data[:cut].decode("utf-8")

    def close(self) -> None:
        if self.held:
            raise ValueError("the ids end inside a character")


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.transducer = Transducer(ranks)
        self.pieces = regex.compile(pattern).findall
        self.usual = pattern == USUAL
        self.piece = common.BoundedMemo(lambda p: self.transducer.encode(p.encode("utf-8")), _PIECES)
        self.short = max(ranks.values()) < 1 << 16  # then the table holds ids of two bytes
        self.table = WordTable(self._kept_stretch, np.dtype("<u2" if self.short else "<u4"), _STRETCHES)

    def _pieces(self, text: str) -> bytes:
        return b"".join([self.piece[p] if len(p) <= _LONGEST else self.transducer.encode(p.encode("utf-8")) for p in self.pieces(text)])

    def _stretch(self, data: bytes, first: bool) -> bytes | None:
        """The ids of a stretch with the space before it; None if white space stands at either end."""
        stretch = data.decode("utf-8")
        if not stretch:
            return b"" if first else None
        if stretch[0].isspace() or stretch[-1].isspace():
            return None
        if not first:
            stretch = " " + stretch
        if self.usual:
            if m := _PLAIN.fullmatch(stretch):
                return self.piece[m[1]] + (self.piece[m[2]] if m[2] else b"")
            if (m := _TWO_LINES.fullmatch(stretch)):  # a line feed between other characters is a piece
                return b"".join([self.piece[x] for x in m.groups() if x])
        return self._pieces(stretch)

    def _kept_stretch(self, data: bytes, first: bool) -> bytes | None:
        ids = self._stretch(data, first)
        return np.frombuffer(ids, "<u4").astype("<u2").tobytes() if ids and self.short else ids

    def encode_all(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The ids of each whole text.

        A space between two characters that are no white space always starts a piece, so the
        stretches between such spaces are independent of one another; a text with white space
        beside a space is cut into pieces as a whole.
        """
        texts, again = tee(texts)
        for ids, text in zip(self.table.ids(texts), again, strict=True):
            yield np.frombuffer(self._pieces(text), "<u4") if ids is None else ids.astype("<u4")

    def encode(self, text: str) -> bytes:
        """Ids of one text as little-endian unsigned 32-bit numbers."""
        return next(self.encode_all([text])).tobytes()

    def decode(self, ids: Iterable[int]) -> Iterator[tuple[bytes, str]]:
        """Chunks of bytes and of the characters that they complete."""
        stream, bytes_of, ids = Utf8Stream(), self.transducer.bytes_of, list(ids)
        for k in range(0, len(ids), 65_536):
            data = b"".join(map(bytes_of.__getitem__, ids[k:k + 65_536]))
            yield data, stream.feed(data)
        stream.close()


def coder(raw: bytes, pattern: str) -> ByteBpe:
    """One coder for each rank file and pattern in a worker."""
    key = (hashlib.sha256(raw).hexdigest(), pattern)
    return common.kept_in_worker(key, lambda: ByteBpe(read_ranks(raw), pattern))


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id, n_tokens, ids_sha256, decoded_sha256, n_decoded_chars``."""
    with open(ranks_path, "rb") as f:
        raw = f.read()
    sent = docs.sparkSession.sparkContext.broadcast(raw)  # the vocabulary file, whatever the data

    def run(batch: pa.RecordBatch):
        c = coder(sent.value, pattern)
        n, ids_sha, decoded_sha, chars = [], [], [], []
        for ids in c.encode_all(common.texts_of(batch, "text")):
            n.append(len(ids))
            ids_sha.append(hashlib.sha256(ids.tobytes()).hexdigest())
            digest, length = hashlib.sha256(), 0
            for data, done in c.decode(ids.tolist()):
                digest.update(data)
                length += len(done)
            decoded_sha.append(digest.hexdigest())
            chars.append(length)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string()), pa.array(chars, pa.int64())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_decoded_chars"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return common.map_batches(narrow, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_decoded_chars long")
