"""LM scoring with an Elias-Fano n-gram trie.

The trie has two levels. The first is the vocabulary: word hashes in order, a
word's id being its place, with counts. The second holds, for each context, the
ids of the words that follow it, in Elias-Fano code, with a pointer for each
context to where its successors begin (a monotone sequence, coded likewise) and
a byte for each successor's smoothed probability. A probability is looked up by
going from the context's pointers to its range, and there to the first
successor not less than the word.

Levels are cut into shards of about equal numbers of tokens in order of
(context, word); a context with more tokens than a shard is split among
several. Shards are files in the shared folder that workers map into memory:
each is built from counts that a shuffle brings together, so no task or driver
holds the model, and a lost task only writes its file again.

Smoothing is Dirichlet's: P(w | h) = (c(h, w) + MU * P(w)) / (c(h) + MU) with
the additive unigram P(w); for unseen pairs that is a weight of the context
times P(w), so only seen pairs are stored.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from objsql.llm.common import fresh_path, settled
from objsql.llm.text_kernel import SPACE, Run, runs

MU, ADD = 2.0, 0.1
#: Tokens that a shard of the second level is made of, about; words in a bucket of the first.
SHARD_TOKENS, BUCKET_WORDS = 2_000_000, 250_000
#: Bytes of text whose n-grams are counted together before they are sent on.
COUNT_BYTES = 32 << 20
#: Probabilities are kept as steps of log10 from 0 down to LEAST.
LEAST = -12.0

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
END, BEGIN = np.uint64(1), np.uint64(2)  # no word hashes to these but with a chance of 2 in 2**64


# -- files in the shared folder ------------------------------------------------------------------


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_arrays(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """One file of named arrays, put in place when it is whole, so a second try does no harm."""
    head, at, parts = {}, 0, []
    for name, a in arrays.items():
        a = np.ascontiguousarray(a)
        head[name] = [a.dtype.str, len(a), at]
        parts.append(a.tobytes() + b"\0" * (-a.nbytes % 8))
        at += len(parts[-1])
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    data = len(text).to_bytes(8, "little") + text + b"".join(parts)
    url = urlparse(uri)
    if url.scheme in ("", "file"):
        os.makedirs(os.path.dirname(url.path), exist_ok=True)
        own = f"{url.path}.{uuid.uuid4().hex}"
        with open(own, "wb") as out:
            out.write(data)
        os.replace(own, url.path)
    else:
        store, path = _filesystem(uri)
        store.create_dir(path.rpartition("/")[0], recursive=True)
        with store.open_output_stream(path) as out:
            out.write(data)


@lru_cache(maxsize=4096)
def read_arrays(uri: str) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped into memory where the store is a file system."""
    url = urlparse(uri)
    if url.scheme in ("", "file"):
        data = np.memmap(url.path, np.uint8, "r")
    else:
        store, path = _filesystem(uri)
        with store.open_input_file(path) as source:
            data = np.frombuffer(source.read(), np.uint8)
    n = int(data[:8].view("<u8")[0])
    head, start = json.loads(bytes(data[8 : 8 + n])), 8 + n
    return {name: data[start + at : start + at + size * np.dtype(kind).itemsize].view(kind) for name, (kind, size, at) in head.items()}


# -- Elias-Fano ----------------------------------------------------------------------------------

_ONES = np.array([b.bit_count() for b in range(256)], np.uint8)
#: Place of the k-th zero in a byte.
_ZERO_AT = np.array([[([i for i in range(8) if not b >> i & 1] + [0] * 8)[k] for k in range(8)] for b in range(256)], np.uint8)


class EliasFano:
    """A monotone sequence of numbers: low bytes as they are, high parts in unary with a directory of zeros."""

    @staticmethod
    def encode(values: np.ndarray, name: str) -> dict[str, np.ndarray]:
        values = values.astype(np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        width = min((8 * n * w + n + (top >> 8 * w) for w in range(8)))
        width = next(w for w in range(8) if 8 * n * w + n + (top >> 8 * w) == width)
        high = (values >> np.uint64(8 * width)).astype(np.int64)
        buckets = (top >> 8 * width) + 1
        bits = np.zeros(-(-(n + buckets) // 64) * 64, np.uint8)
        bits[high + np.arange(n)] = 1
        packed = np.packbits(bits, bitorder="little")
        zeros = 8 - _ONES[packed]
        directory = np.concatenate([[0], np.cumsum(zeros.reshape(-1, 8).sum(1, dtype=np.int64))]).astype(np.uint32 if len(bits) < 1 << 32 else np.uint64)
        low = values.view(np.uint8).reshape(-1, 8)[:, :width] if n else np.zeros((0, width), np.uint8)
        return {f"{name}.low": np.ascontiguousarray(low).reshape(-1), f"{name}.high": packed, f"{name}.zeros": directory, f"{name}.size": np.array([n, width, buckets], np.int64)}

    def __init__(self, arrays: dict[str, np.ndarray], name: str):
        self.low, self.high, self.zeros = (arrays[f"{name}.{part}"] for part in ("low", "high", "zeros"))
        self.n, self.width, self.buckets = (int(x) for x in arrays[f"{name}.size"])

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Places of the k-th zeros."""
        word = np.searchsorted(self.zeros, k, "right") - 1
        left, at = k - self.zeros[word].astype(np.int64), word * 8
        for _ in range(7):
            here = 8 - _ONES[self.high[at]].astype(np.int64)
            go = left >= here
            left, at = np.where(go, left - here, left), at + go
        return at * 8 + _ZERO_AT[self.high[at], left]

    def _lows(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.uint64)
        for b in range(self.width):
            out |= self.low[i * self.width + b].astype(np.uint64) << np.uint64(8 * b)
        return out

    def access(self, i: np.ndarray) -> np.ndarray:
        """The i-th numbers: the unary part is searched for by how many ones come before each word."""
        ones = np.arange(len(self.zeros), dtype=np.int64) * 64 - self.zeros.astype(np.int64)
        word = np.searchsorted(ones, i, "right") - 1
        left, at = i - ones[word], word * 8
        for _ in range(7):
            here = _ONES[self.high[at]].astype(np.int64)
            go = left >= here
            left, at = np.where(go, left - here, left), at + go
        place = at * 8 + _ZERO_AT[255 - self.high[at], left]
        return ((place - i).astype(np.uint64) << np.uint64(8 * self.width)) | self._lows(i)

    def successor(self, x: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each x the place in [first, last) of the first number not less than it, or last; and whether it equals x."""
        if not self.n:
            return last, np.zeros(len(x), bool)
        high = (x >> np.uint64(8 * self.width)).astype(np.int64)
        inside = np.minimum(high, self.buckets - 1)
        a = np.where(inside > 0, self._zero(np.maximum(inside - 1, 0)) - np.maximum(inside - 1, 0), 0)
        b = self._zero(inside) - inside
        a, b = np.where(high < self.buckets, a, self.n), np.where(high < self.buckets, b, self.n)
        a, b = np.clip(a, first, last), np.clip(b, first, last)
        low, end = x & np.uint64((1 << 8 * self.width) - 1), b
        while (open_ := a < b).any():
            middle = (a + b) >> 1
            less = self._lows(np.minimum(middle, self.n - 1)) < low
            a, b = np.where(open_ & less, middle + 1, a), np.where(open_ & ~less, middle, b)
        return a, (a < end) & (self._lows(np.minimum(a, self.n - 1)) == low)


# -- the model -----------------------------------------------------------------------------------


def text_tokens(run: Run) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of a run's texts, each text closed by END, and where each text begins."""
    run = Run(run.first, _LOWER[run.data], run.bounds)
    starts, ends, owner = run.spans(SPACE)
    n = np.bincount(owner, minlength=len(run)) + 1
    begins = np.concatenate([[0], np.cumsum(n)])
    out = np.empty(begins[-1], np.uint64)
    inner = np.ones(len(out), bool)
    inner[begins[1:] - 1] = False
    out[inner], out[~inner] = run.hashes(starts, ends), END
    return out, begins


class Model:
    """What tasks need to find the files: small whatever the corpus is, but for a boundary per shard."""

    def __init__(self, buckets: list[tuple[int, str, int]], bits: int, n: int, docs: int, boundaries: np.ndarray, shards: list[str]):
        self.files = {b: uri for b, uri, _ in buckets}
        self.base = np.zeros((1 << bits) + 1, np.int64)
        for b, _, words in buckets:
            self.base[b + 1] = words
        self.base = np.cumsum(self.base)
        self.bits, self.n, self.docs, self.v = bits, n, docs, int(self.base[-1])
        self.boundaries, self.shards = boundaries, shards

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: unknown) and counts of sorted distinct word hashes."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        cut = np.searchsorted(hashes >> np.uint64(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=np.uint64)) if self.bits else np.array([0, len(hashes)])
        for b, uri in self.files.items():
            own = hashes[cut[b] : cut[b + 1]]
            if len(own):
                arrays = read_arrays(uri)
                at = np.minimum(np.searchsorted(arrays["hash"], own), len(arrays["hash"]) - 1)
                known = arrays["hash"][at] == own
                ids[cut[b] : cut[b + 1]][known] = at[known] + self.base[b]
                counts[cut[b] : cut[b + 1]][known] = arrays["count"][at[known]]
        return ids, counts

    def counts_of(self, ids: np.ndarray) -> np.ndarray:
        """Counts of sorted ids; the id v stands for the beginning of a text."""
        out = np.full(len(ids), self.docs, np.int64)
        cut = np.searchsorted(ids, self.base)
        for b, uri in self.files.items():
            own = ids[cut[b] : cut[b + 1]]
            if len(own):
                out[cut[b] : cut[b + 1]] = read_arrays(uri)["count"][own - self.base[b]]
        return out

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return (counts + ADD) / (self.n + ADD * (self.v + 1))

    def shard_of(self, pairs: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.boundaries, pairs, "right")

    def bigrams(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 P of sorted distinct (context id << 32 | word id), and which were seen."""
        value, seen = np.zeros(len(pairs)), np.zeros(len(pairs), bool)
        cut = np.searchsorted(self.shard_of(pairs), np.arange(len(self.shards) + 1))
        for s, uri in enumerate(self.shards):
            own = pairs[cut[s] : cut[s + 1]]
            if not len(own) or not uri:
                continue
            arrays = read_arrays(uri)
            low = int(arrays["first"][0])
            pointers, successors = EliasFano(arrays, "pointers"), EliasFano(arrays, "successors")
            context, word = (own >> np.uint64(32)).astype(np.int64) - low, own & np.uint64(0xFFFFFFFF)
            # A shard's successors are made monotone by their context's number in it.
            inside = (context >= 0) & (context < pointers.n - 1)
            c = np.where(inside, context, 0)
            distinct, back = np.unique(np.concatenate([c, c + 1]), return_inverse=True)
            ends = pointers.access(distinct).astype(np.int64)[back]
            at, hit = successors.successor(c.astype(np.uint64) * np.uint64(self.v) + word, ends[: len(c)], ends[len(c) :])
            hit &= inside
            value[cut[s] : cut[s + 1]][hit] = arrays["probability"][at[hit]] * (LEAST / 255)
            seen[cut[s] : cut[s + 1]] = hit
        return value, seen

    def score(self, tokens: np.ndarray, begins: np.ndarray) -> dict[str, np.ndarray]:
        """Of texts given as by ``text_tokens``."""
        hashes, place = np.unique(tokens, return_inverse=True)
        ids, counts = self.words(hashes)
        ids, counts = ids[place], counts[place]
        base = np.log10(self.unigram(counts))
        before = np.concatenate([[0], ids[:-1]])
        total = np.concatenate([[0], counts[:-1]])
        before[begins[:-1]], total[begins[:-1]] = self.v, self.docs
        both = (before >= 0) & (ids >= 0)
        pairs, back = np.unique((before[both].astype(np.uint64) << np.uint64(32)) | ids[both].astype(np.uint64), return_inverse=True)
        value, seen = self.bigrams(pairs)
        # An unknown context has a count of 0, and so a weight of 1.
        score = np.log10(MU / (total + MU)) + base
        hit = np.flatnonzero(both)[seen[back]]
        score[hit] = value[back][seen[back]]
        add = np.add.reduceat
        return {"n_tokens": np.diff(begins), "n_known": add((counts > 0).astype(np.int64), begins[:-1]), "base_score": add(base, begins[:-1]), "score": add(score, begins[:-1])}


def _counted(values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not values:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.unique(np.concatenate(values), return_counts=True)


def _held(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
    """Tokens of runs of texts, some COUNT_BYTES together."""
    held, size = [], 0
    for batch in batches:
        for run in runs(batch.column(column)):
            held.append(text_tokens(run))
            size += len(run.data)
            if size >= COUNT_BYTES:
                yield held
                held, size = [], 0
    if held:
        yield held


def fit(texts: DataFrame, mu: float = MU) -> Model:
    """A model of the texts (one column); null counts as an empty text."""
    spark = texts.sparkSession
    folder = fresh_path(spark, "trie")

    def unigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _held(batches, 0):
            values, counts = _counted([tokens for tokens, _ in held])
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts)], ["hash", "n"])

    words = settled(texts.mapInArrow(unigrams, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")))
    v, n = words.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if v >= 1 << 32:
        raise ValueError("more than 2**32 words")
    bits = max(0, int(np.ceil(np.log2(max(1, v) / BUCKET_WORDS))))

    def write_bucket(key: tuple, table: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        hashes, counts = table["hash"].to_numpy().view(np.uint64), table["n"].to_numpy()
        order = np.argsort(hashes)
        counts = counts[order]
        uri = f"{folder}/words-{bucket}"
        write_arrays(uri, {"hash": hashes[order], "count": counts.astype(np.uint64)})
        # Where shards end: after about SHARD_TOKENS each, and inside a context that has more.
        cuts, filled = [], 0
        for at in np.flatnonzero(counts >= SHARD_TOKENS).tolist() + [len(counts)]:
            part = np.cumsum(counts[filled:at])
            cuts += [(int(x) + filled, 0.0) for x in np.unique(np.searchsorted(part, np.arange(SHARD_TOKENS, part[-1] if len(part) else 0, SHARD_TOKENS)))]
            if at < len(counts):
                parts = -(-int(counts[at]) // SHARD_TOKENS)
                cuts += [(at, k / parts) for k in range(parts)] + [(at + 1, 0.0)]
            filled = at + 1
        return pa.table({"bucket": [bucket], "uri": [uri], "words": [len(counts)], "places": pa.array([[c[0] for c in cuts]], pa.list_(pa.int64())), "shares": pa.array([[c[1] for c in cuts]], pa.list_(pa.float64()))})

    bucket = F.expr(f"shiftrightunsigned(hash, {64 - bits})") if bits else F.lit(0).cast("long")
    rows = words.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(write_bucket, "bucket long, uri string, words long, places array<long>, shares array<double>").collect()
    docs = texts.count()
    model = Model([(r.bucket, r.uri, r.words) for r in rows], bits, int(n), docs, np.zeros(0, np.uint64), [])
    keys = [((int(model.base[r.bucket]) + p) << 32) | int(s * v) for r in rows for p, s in zip(r.places, r.shares)]
    parts = -(-docs // SHARD_TOKENS)
    keys += [(int(v) << 32) | int(v * k / parts) for k in range(parts)]  # the beginnings of texts
    model.boundaries = np.unique(np.array(sorted(keys), np.uint64))

    def bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _held(batches, 0):
            hashes, place = np.unique(np.concatenate([tokens for tokens, _ in held]), return_inverse=True)
            ids = model.words(hashes)[0][place].astype(np.uint64)
            before = np.concatenate([[0], ids[:-1]]).astype(np.uint64)
            at = 0
            for tokens, begins in held:
                before[at + begins[:-1]] = model.v
                at += len(tokens)
            pairs, counts = _counted([(before << np.uint64(32)) | ids])
            cut = np.searchsorted(model.shard_of(pairs), np.arange(len(model.boundaries) + 2))
            some = np.flatnonzero(np.diff(cut))
            counts = counts.astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(some), pa.array([pairs[cut[s] : cut[s + 1]].tobytes() for s in some], pa.binary()), pa.array([counts[cut[s] : cut[s + 1]].tobytes() for s in some], pa.binary())], ["shard", "pairs", "counts"]
            )

    def write_shard(key: tuple, table: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        pairs = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in table["pairs"]])
        counts = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in table["counts"]])
        order = np.argsort(pairs, kind="stable")
        pairs, counts = pairs[order], counts[order].astype(np.int64)
        starts = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
        pairs, counts = pairs[starts], np.add.reduceat(counts, starts)
        context, word = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
        own, place = np.unique(word, return_inverse=True)
        single = model.unigram(model.counts_of(own))[place]
        contexts, at = np.unique(context, return_inverse=True)
        total = model.counts_of(contexts)[at]
        p = np.log10((counts + mu * single) / (total + mu))
        low = int(contexts[0])
        pointers = np.searchsorted(context, np.arange(low, int(contexts[-1]) + 2))
        uri = f"{folder}/pairs-{shard}"
        write_arrays(
            uri,
            {
                "first": np.array([low], np.int64),
                **EliasFano.encode(pointers, "pointers"),
                **EliasFano.encode((context - low).astype(np.uint64) * np.uint64(model.v) + word.astype(np.uint64), "successors"),
                "probability": np.clip(np.rint(p * (255 / LEAST)), 0, 255).astype(np.uint8),
            },
        )
        return pa.table({"shard": [shard], "uri": [uri]})

    made = texts.mapInArrow(bigrams, "shard long, pairs binary, counts binary").groupBy("shard").applyInArrow(write_shard, "shard long, uri string").collect()
    model.shards = [""] * (len(model.boundaries) + 1)
    for r in made:
        model.shards[r.shard] = r.uri
    return model


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: int = 10) -> DataFrame:
    """One row per input row: ``id_col``, held_out, n_tokens, n_known, train_tokens, base_score, score.

    - Learns from the rows whose crc32(id as text) modulo ``fold`` isn't 0;
      held_out rows are the others. A null id counts as the text "".
    - Null text counts as empty: one token, its end.
    - n_known: tokens seen in training. base_score: log10 of the additive
      unigram probability; score: that of the smoothed bigrams, of which the
      stored ones are rounded to steps of 12/255 in log10.
    - Repeated rows count as often as they are there, in training and in the
      result. With nothing to learn from every token has probability 1. An
      empty table gives an empty table. Other columns are ignored.
    """
    held_out = F.crc32(F.coalesce(docs[id_col].cast("string"), F.lit(""))) % fold == 0
    narrow = docs.select(docs[id_col].alias("_id"), held_out.alias("held_out"), docs[text_col].cast("string").alias("_text"))
    model = fit(narrow.where(~F.col("held_out")).select("_text"))
    kind = docs.schema[id_col].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, held, start = batch.column(0), batch.column(1), 0
            for run in runs(batch.column(2)):
                found = model.score(*text_tokens(run))
                n = len(run)
                columns = [ids.slice(start, n), held.slice(start, n), pa.array(found["n_tokens"], pa.int64()), pa.array(found["n_known"], pa.int64()), pa.array(np.full(n, model.n)), pa.array(found["base_score"]), pa.array(found["score"])]
                yield pa.RecordBatch.from_arrays(columns, ["_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
                start += n

    return narrow.mapInArrow(judge, f"_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double").withColumnRenamed("_id", id_col)
