"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The words of a corpus that haven't been seen before are laid out one after
another as token ids. An inverted index maps each pair of neighbouring tokens
to the positions where it stands. Merges are taken in rank order from a heap of
the pairs present; each is applied at all its positions at once, and only the
neighbours of a merged pair enter the index anew. The result is what merging
word by word gives, because a merge touches its own word only and, within a
word, the lowest rank goes first and the leftmost position of it first.

Positions are arrays, so that a merge is a few array operations however often
its pair stands. The corpus of a replay is the new words of some documents of a task: words
already encoded are remembered, up to a bound.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from objsql.llm.common import lean, slices
from objsql.llm.token_counts import CACHE_BYTES, batches_of, held_bytes, pieces_of

#: Bytes of text whose new words are replayed together.
CORPUS_BYTES = 1 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 token and rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class MergeReplay:
    """Encodes words by ranks and decodes ids."""

    NONE = 1 << 40  # the rank of two tokens that don't merge

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values(), default=-1) + 1
        self.tokens = [b""] * self.size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.byte_ids = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        # Every pair of tokens that makes a token, as left * size + right, and the token made.
        made = [
            (ranks[token[:k]] * self.size + ranks[token[k:]], rank)
            for token, rank in ranks.items()
            for k in range(1, len(token))
            if token[:k] in ranks and token[k:] in ranks
        ]
        table = np.array(sorted(made), np.int64).reshape(-1, 2)
        self.pairs, self.merged = np.append(table[:, 0], -1), np.append(table[:, 1], self.NONE)

    def _rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The token that two neighbours merge to, or NONE."""
        pair = left * self.size + right
        at = np.searchsorted(self.pairs[:-1], pair)
        return np.where(self.pairs[at] == pair, self.merged[at], self.NONE)

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, packed as little-endian 32-bit numbers."""
        whole = [self.ranks.get(word, -1) for word in words]
        parts = [b"" if rank >= 0 else word for word, rank in zip(words, whole)]
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        ends = np.cumsum(lengths)
        token = self.byte_ids[np.frombuffer(b"".join(parts), np.uint8)]
        n = len(token)
        # Position n stands for none, before the first and after the last of a word.
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[ends[lengths > 0] - 1] = n
        before[(ends - lengths)[lengths > 0]] = n
        after[n], token = n, np.append(token, -1)
        # Rank of the pair that begins at each position.
        rank_at = np.full(n + 1, self.NONE)
        inner = np.flatnonzero(after[:n] < n)
        rank_at[inner] = self._rank_of(token[inner], token[inner + 1])

        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def note(positions: np.ndarray) -> None:
            found = rank_at[positions]
            order = np.argsort(found, kind="stable")
            positions, found = positions[order], found[order]
            cut = np.flatnonzero(found[1:] != found[:-1]) + 1
            for own, rank in zip(np.split(positions, cut), found[np.concatenate([[0], cut])].tolist()):
                places = index.get(rank)
                if places is None:
                    index[rank] = [own]
                    heapq.heappush(heap, rank)
                else:
                    places.append(own)

        first = inner[rank_at[inner] < self.NONE]
        if len(first):
            note(first)
        while heap:
            rank = heapq.heappop(heap)
            places = index.pop(rank)
            at = np.unique(np.concatenate(places) if len(places) > 1 else places[0])
            at = at[rank_at[at] == rank]
            if not len(at):
                continue
            gone = after[at]
            clash = rank_at[gone] == rank
            if clash.any():
                # Overlapping pairs: the leftmost goes first.
                keep, taken = [], -1
                for here, there in zip(at.tolist(), gone.tolist()):
                    if here != taken:
                        keep.append(here)
                        taken = there
                at = np.array(keep)
                gone = after[at]
            following = after[gone]
            token[at], token[gone] = rank, -1
            after[at], rank_at[gone] = following, self.NONE
            inside = following < n
            before[following[inside]] = at[inside]
            rank_at[at] = self.NONE
            rank_at[at[inside]] = self._rank_of(token[at[inside]], token[following[inside]])
            previous = before[at]
            previous = previous[previous < n]
            rank_at[previous] = self._rank_of(token[previous], token[after[previous]])
            touched = np.concatenate([at, previous])
            touched = touched[rank_at[touched] < self.NONE]
            if len(touched):
                note(touched)
        alive = token[:n] >= 0
        ids = token[:n][alive].astype("<u4").tobytes()
        bounds = 4 * np.concatenate([[0], np.cumsum(alive)])
        starts, stops = bounds[ends - lengths].tolist(), bounds[ends].tolist()
        return [r.to_bytes(4, "little") if r >= 0 else ids[a:b] for r, a, b in zip(whole, starts, stops)]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def replay_of(ranks_path: str) -> MergeReplay:
    """Read once for all tasks of a Python worker."""
    return MergeReplay(load_ranks(ranks_path))


class TextCodec:
    """Encodes texts to little-endian 32-bit ids, remembering the pieces met before."""

    def __init__(self, replay: MergeReplay, pattern: str, cache_bytes: int = CACHE_BYTES, corpus_bytes: int = CORPUS_BYTES):
        import regex

        self.replay, self.split = replay, regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}  # ids of pieces
        self.words: dict[str, bytes] = {}  # and of the words they are made of
        self.held, self.cache_bytes, self.corpus_bytes = 0, cache_bytes, corpus_bytes

    def _learn(self, pieces: list[str]) -> None:
        split, words = [self.split(piece) for piece in pieces], self.words
        new = list({word for own in split for word in own} - words.keys())
        words.update(zip(new, self.replay.encode_words([word.encode() for word in new])))
        for piece, own in zip(pieces, split):
            self.known[piece] = b"".join(map(words.__getitem__, own))
        # Ids take about as much as the text.
        self.held += 2 * (held_bytes(pieces) + held_bytes(new))

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        for start, stop in batches_of(texts, self.corpus_bytes):
            split = [pieces_of(text) for text in texts[start:stop]]
            if self.held > 2 * self.cache_bytes:
                self.known.clear()
                self.words.clear()
                self.held = 0
            self._learn(list({piece for own in split for piece in own} - self.known.keys()))
            for own in split:
                yield b"".join(map(self.known.__getitem__, own))

    def decode(self, ids: bytes) -> bytes:
        return self.replay.decode(np.frombuffer(ids, "<u4").tolist())


def encoded(batches: Iterator[pa.RecordBatch], codec: TextCodec, ids: bool) -> Iterator[pa.RecordBatch]:
    """Batches of (id, text) as ``encode_documents`` has them; a batch's ids take several times its text until they are sent, so they go in parts."""
    for batch in (part for whole in batches for part in slices(whole, 1, codec.corpus_bytes)):
        n_tokens, coded, own, decoded = [], [], [], []
        for found in codec.encode(batch.column(1).to_pylist()):
            n_tokens.append(len(found) // 4)
            own.append(hashlib.sha256(found).hexdigest())
            decoded.append(hashlib.sha256(codec.decode(found)).hexdigest())
            if ids:
                coded.append(found)
        columns = [batch.column(0), pa.array(n_tokens, pa.int64()), pa.array(own, pa.string()), pa.array(decoded, pa.string())]
        names = ["_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(coded, pa.binary())] if ids else columns, [*names, "ids"] if ids else names)


def encode_documents(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True
) -> DataFrame:
    """One row per input row: ``id_col``, n_tokens, ids_sha256, decoded_sha256 and, with ``ids``, the ids (binary, little-endian 32-bit).

    - Null text counts as empty: no ids, the digests of nothing.
    - Whole texts of any length are encoded; special strings are ordinary text.
    - Decoding gives the UTF-8 bytes of the text again; decoded_sha256 is of what was decoded from the ids.
    - Repeated rows give repeated rows; an empty table gives an empty table.
    - Other columns are ignored, whatever their names.
    ``ranks_path`` must be readable on every executor.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return encoded(batches, TextCodec(replay_of(ranks_path), pattern), ids)

    narrow = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text"))
    schema = f"_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * ids
    return narrow.mapInArrow(lean(encode), schema).withColumnRenamed("_id", id_col)
