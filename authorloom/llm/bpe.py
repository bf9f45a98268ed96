"""Byte-level BPE: encoding by a lazily determinised transducer, and streaming decoding.

The merges define, for every prefix of a piece of text, the last token of that prefix's
encoding: the longest token that ends there whose neighbour to the left it may follow, that
is, a pair that the merges would not join or cut otherwise. A state of the transducer is the
longest end of what was read that begins a token, with the last token before each of its
bytes where another token may begin;
states are made when they are first met and then kept as integers with a row of transitions
(determinised lazily). A token leaves the transducer when every
encoding that can still follow agrees on it, which is after at most ``reach`` bytes.

A piece always starts in the same state, so the way of a whole piece is one composed
transition: it is kept in a bounded table and met again as one step. That is what makes
words that recur cheap. Both tables start anew when they are full, so memory is bounded;
results never depend on them.

Rules: a null text is encoded as empty. Texts are read whole; no special tokens. Decoding
takes ids in chunks of any size and gives back the bytes; as text, code points cut by a chunk
border wait for their rest, and broken ones become U+FFFD. Repeated rows and other columns do
not matter.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from authorloom.llm import shared

PIECES = 300_000
"""Composed transitions that a worker keeps."""
STATES = 100_000
"""States that a worker keeps."""


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ids from a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Transducer:
    """Encoder of single pieces for one table of ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.sizes = {rank: len(token) for token, rank in ranks.items()}
        self.reach = max(map(len, ranks))
        self.known_halves: dict[int, tuple[int, int] | None] = {}
        self.begins = {token[:i] for token in ranks for i in range(1, len(token))}
        self.allowed: dict[tuple[int, int], bool] = {}
        self.ends: list[bytes] = [b""]
        self.end_ids: dict[bytes, int] = {b"": 0}
        self.edges: list[dict[int, tuple]] = [{}]
        self.pieces: dict[str, bytes] = {}
        self._reset()

    def _split(self, token: bytes) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``: what is left before its last merge."""
        if len(token) == 1:
            return None
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(
                (rank, i)
                for i in range(len(parts) - 1)
                if (rank := self.ranks.get(parts[i] + parts[i + 1])) is not None
            )
            at = best[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def halves(self, token: int) -> tuple[int, int] | None:
        if token not in self.known_halves:
            self.known_halves[token] = self._split(self.tokens[token])
        return self.known_halves[token]

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the encoding of the two tokens' bytes is these two tokens.

        Walks from the whole tokens down to their halves along the border; the pair is
        impossible if some merge across the border would have come first."""
        known = self.allowed.get((left, right))
        if known is None:
            known = self.allowed[left, right] = self._may_follow(left, right)
        return known

    def _may_follow(self, left: int, right: int) -> bool:
        limit = 1 << 62
        while True:
            joined = self.ranks.get(self.tokens[left] + self.tokens[right])
            if joined is not None and joined < limit:
                return False
            if left > right:
                limit = left
                if (halves := self.halves(left)) is None:
                    return True
                left = halves[1]
                if self.halves(limit) is not None and left == limit:
                    return True
            else:
                limit = right + 1
                if (halves := self.halves(right)) is None:
                    return True
                right = halves[0]

    def _reset(self) -> None:
        # a state: the longest end of what is read that a token may go on from, and the last token of
        # the prefix before each of its bytes and of the whole
        self.states: dict[tuple, int] = {(0, (None,)): 0}
        self.windows: list[tuple[int, tuple[int | None, ...]]] = [(0, (None,))]
        self.steps: list[dict[int, tuple[int, int]]] = [{}]
        self.allowed.clear()

    def _edge(self, end: int, byte: int) -> tuple:
        """What ``byte`` does to an end of text, whatever was before: tokens that end with it, longest first,
        each with the place where it begins; the new end; places of the old that still matter, -1 for others."""
        grown = self.ends[end] + bytes((byte,))
        tokens = tuple(
            (at, token) for at in range(len(grown)) if (token := self.ranks.get(grown[at:])) is not None
        )
        cut = 0
        while cut < len(grown) and grown[cut:] not in self.begins:
            cut += 1
        kept = tuple(at if grown[at:] in self.begins else -1 for at in range(cut, len(grown)))
        number = self.end_ids.setdefault(grown[cut:], len(self.ends))
        if number == len(self.ends):
            self.ends.append(grown[cut:])
            self.edges.append({})
        self.edges[end][byte] = out = tokens, number, kept
        return out

    def step(self, state: int, byte: int) -> tuple[int, int]:
        """(next state, last token of the prefix that ends with ``byte``)."""
        known = self.steps[state].get(byte)
        if known is not None:
            return known
        end, lasts = self.windows[state]
        tokens, number, kept = self.edges[end].get(byte) or self._edge(end, byte)
        allowed = self.allowed
        for at, token in tokens:
            left = lasts[at]
            if left is None:
                break
            if left != -1:
                fits = allowed.get((left, token))
                if fits is None:
                    fits = self.may_follow(left, token)
                if fits:
                    break
        window = number, (*[lasts[at] if at >= 0 else -1 for at in kept], token)
        state_after = self.states.setdefault(window, len(self.windows))
        if state_after == len(self.windows):
            self.windows.append(window)
            self.steps.append({})
        self.steps[state][byte] = out = state_after, token
        return out

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece: the path of last tokens, read from its end."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.windows) > STATES:
            self._reset()
        state, steps, lasts = 0, self.steps, []
        out: list[int] = []
        done = 0
        for begin in range(0, len(piece), self.reach):
            if begin:  # further back than a token is long, all ways that are still open share their tokens
                done = self._emit(lasts, done, out)
            for byte in piece[begin : begin + self.reach]:
                state, last = steps[state].get(byte) or self.step(state, byte)
                lasts.append(last)
        tail: list[int] = []
        at, sizes = len(lasts), self.sizes
        while at > done:
            last = lasts[at - 1]
            tail.append(last)
            at -= sizes[last]
        tail.reverse()
        return out + tail

    def _emit(self, lasts: list[int], done: int, out: list[int]) -> int:
        """Send what all prefixes that end within the last ``reach`` bytes agree on."""
        ends = set(range(len(lasts) - self.reach + 1, len(lasts) + 1))
        paths: list[int] = []
        at = len(lasts)
        while len(ends) > 1:  # the furthest end goes back until all ways meet
            if at in ends:
                ends.discard(at)
                ends.add(at - self.sizes[lasts[at - 1]])
            at -= 1
        meet = ends.pop()
        at = meet
        while at > done:
            paths.append(lasts[at - 1])
            at -= len(self.tokens[lasts[at - 1]])
        if at != done:
            return done
        out.extend(reversed(paths))
        return max(meet, done)

    def forget(self) -> None:
        """Give back what was kept, so that an idle worker holds little."""
        self.pieces.clear()
        self._reset()

    def composed(self, piece: str) -> bytes:
        """Ids of a piece as little-endian 32-bit integers, kept for the next time."""
        ids = array("I", self.encode_piece(piece.encode("utf-8", "surrogatepass"))).tobytes()
        if len(piece) <= 64:
            if len(self.pieces) >= PIECES:
                self.pieces.clear()
            self.pieces[piece] = ids
        return ids


def ascii_pattern(pattern: str) -> re.Pattern | None:
    """The same matches in ASCII texts by the faster built-in module; None if that can't be told."""
    for was, now in (
        (r"[^\s\p{L}\p{N}]", "[^\t-\r A-Za-z0-9]"),
        (r"\p{L}", "[A-Za-z]"),
        (r"\p{N}", "[0-9]"),
        (r"\S", "[^\t-\r ]"),
        (r"\s", "[\t-\r ]"),
    ):
        pattern = pattern.replace(was, now)
    return None if re.search(r"\\|\[\[|\(\?[^!:=]", pattern) else re.compile(pattern)


class Codec:
    """Encoder and decoder of whole texts for a rank file and a splitting pattern."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.machine = Transducer(load_ranks(path))
        self.split_any = regex.compile(pattern).findall
        plain = ascii_pattern(pattern)
        self.split_ascii = plain.findall if plain else self.split_any
        self.bytes = [self.machine.tokens.get(i, b"") for i in range(max(self.machine.tokens) + 1)]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        known, new = self.machine.pieces.get, self.machine.composed
        split = self.split_ascii if text.isascii() else self.split_any
        return b"".join([known(piece) or new(piece) for piece in split(text)])

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def decode_stream(self, chunks: Iterable[Iterable[int]]) -> Iterator[str]:
        """Text of each chunk of ids, as far as its code points are complete."""
        decoder = Utf8Stream()
        for chunk in chunks:
            yield decoder.feed(self.decode_bytes(chunk))
        yield decoder.close()


class Utf8Stream:
    """Incremental UTF-8: bytes in, text of complete code points out.

    The state is the part of a code point that has been read, at most three bytes."""

    def __init__(self) -> None:
        self.open = b""

    def feed(self, data: bytes) -> str:
        data = self.open + data
        cut = len(data) - self.unfinished(data)
        self.open = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.open = self.open, b""
        return rest.decode("utf-8", "replace")

    @staticmethod
    def unfinished(data: bytes) -> int:
        """Bytes at the end that begin a code point which needs more of them."""
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte >= 0xC0:
                need = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4 if byte < 0xF8 else 1
                return back if need > back else 0
            if byte < 0x80:
                return 0
        return 0


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec per worker and vocabulary."""
    return Codec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Adds ``ids`` (array of int) to the rows of ``docs``; ``path`` is read by every worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = codec(path, pattern)
        for block in shared.blocks(batches):
            ids = [encoder.encode(text or "") for text in block.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*block.columns, _lists(ids)], [*block.schema.names, "ids"])
        encoder.machine.forget()

    shared.small_batches(docs.sparkSession)
    docs = docs.drop("ids")
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{names}, ids array<int>")


def decode(rows: DataFrame, path: str, pattern: str, chunk: int = 4096) -> DataFrame:
    """(doc_id, decoded): the text of ``ids``, streamed in chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = codec(path, pattern)
        for batch in batches:
            texts = []
            for ids in batch.column("ids"):
                values = ids.values.to_numpy() if ids.is_valid else np.empty(0, np.int32)
                parts = (values[i : i + chunk].tolist() for i in range(0, len(values), chunk))
                texts.append("".join(decoder.decode_stream(parts)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts)], ["doc_id", "decoded"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, decoded string")


def round_trip(docs: DataFrame, path: str, pattern: str, chunk: int = 1 << 15, keep_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode each text, decode its ids as a stream, and keep
    the digests of ids and text, so that neither has to leave the task. With ``keep_ids`` the ids are a
    last column, ``ids``."""

    shared.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = codec(path, pattern)
        for block in shared.blocks(batches):
            counts, coded, decoded, kept = [], [], [], []
            for text in block.column("text").to_pylist():
                ids = both.encode(text or "")
                counts.append(len(ids) // 4)
                coded.append(hashlib.sha256(ids).hexdigest())
                digest = hashlib.sha256()
                values = np.frombuffer(ids, np.uint32)
                parts = (values[i : i + chunk].tolist() for i in range(0, len(values), chunk))
                for piece in both.decode_stream(parts):
                    digest.update(piece.encode())
                decoded.append(digest.hexdigest())
                if keep_ids:
                    kept.append(ids)
            columns = [block.column("doc_id"), pa.array(counts, pa.int64()), pa.array(coded), pa.array(decoded)]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns.append(_lists(kept))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)
        both.machine.forget()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run,
        f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids,
    )


def _lists(ids: list[bytes]) -> pa.ListArray:
    """Ids of each text as an array of int."""
    offsets = np.concatenate(([0], np.cumsum([len(i) // 4 for i in ids]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), np.int32)))
