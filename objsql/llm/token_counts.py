"""Token counts: batch encoding in Arrow functions that return lengths only.

A text is cut where a character that is no white space is followed by a white
space character. The vocabulary's pattern never matches across such a place and
merges never cross matches, so the lengths of the pieces add up to the length
of the text. That bounds what the library holds at a time however long a text
is, and it lets equal pieces be encoded once per task. New pieces go to the
library in batches of about equal bytes. Next to the four separators U+001C to
U+001F, which some tables have as white space and others not, no cut is made.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of new pieces that one call of the library gets, and of texts that are gone through together.
BATCH_BYTES = 1 << 20
#: Bytes of pieces that a task remembers before it starts anew, and what a piece counts for beside its text.
CACHE_BYTES, PIECE_BYTES = 16 << 20, 120

_SPACE = " \t-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PIECES = re.compile(rf"[{_SPACE}]*[^{_SPACE}]+(?:(?<=[\x1c-\x1f])[{_SPACE}]+[^{_SPACE}]+)*|[{_SPACE}]+")


def pieces_of(text: str | None) -> list[str]:
    """A text cut at safe places."""
    return _PIECES.findall(text) if text else []


def held_bytes(pieces: Iterable[str]) -> int:
    """About what remembering the pieces takes."""
    return sum(len(piece) + PIECE_BYTES for piece in pieces)


def batches_of(texts: list[str | None], most: int) -> Iterator[tuple[int, int]]:
    """Begin and end of stretches of texts of about ``most`` bytes; a longer text is one of its own."""
    start = size = 0
    for n, text in enumerate(texts):
        length = len(text.encode()) if text else 0
        if size and size + length > most:
            yield start, n
            start, size = n, 0
        size += length
    if start < len(texts):
        yield start, len(texts)


class PieceCounter:
    """Counts the tokens of texts with a ``tokenizers`` file, special strings handled as the file says."""

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES, batch_bytes: int = BATCH_BYTES):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks share the cores already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[str, int] = {}
        self.held, self.cache_bytes, self.batch_bytes = 0, cache_bytes, batch_bytes

    def _learn(self, pieces: list[str]) -> None:
        for start, stop in batches_of(pieces, self.batch_bytes):
            batch = pieces[start:stop]
            for piece, found in zip(batch, self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)):
                self.known[piece] = len(found)
        self.held += held_bytes(pieces)

    def counts(self, texts: list[str | None]) -> list[int]:
        known, out = self.known, []
        for start, stop in batches_of(texts, self.batch_bytes):
            split = [pieces_of(text) for text in texts[start:stop]]
            if self.held > self.cache_bytes:
                known.clear()
                self.held = 0
            self._learn(list({piece for own in split for piece in own} - known.keys()))
            out += [sum(map(known.__getitem__, own)) for own in split]
        return out


def token_counts(
    docs: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: ``id_col``, n_bytes, n_tokens, over_limit.

    - Null text counts as empty: 0 bytes, 0 tokens.
    - Texts of any length are counted whole; nothing is truncated or padded.
    - Repeated rows give repeated rows; an empty table gives an empty table.
    - Other columns are ignored, whatever their names.
    ``tokenizer_path`` must be readable on every executor.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(tokenizer_path)
        for batch in batches:
            text = batch.column(1)
            n_tokens = pa.array(counter.counts(text.to_pylist()), pa.int64())
            n_bytes = pc.fill_null(pc.binary_length(text), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, n_tokens, pc.greater(n_tokens, limit)], ["_id", "n_bytes", "n_tokens", "over_limit"])

    narrow = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text"))
    return narrow.mapInArrow(count, f"_id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("_id", id_col)
