import hashlib

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from objsql.llm.byte_bpe import MergeReplay, TextCodec, encode_documents, load_ranks, replay_of
from objsql.llm.token_counts import PieceCounter, batches_of, pieces_of, token_counts

TEXTS = [
    None, "", " ", "  ", "a", "a  b", "a   b\n\n c \n", "it's we'll  '", "x<|endoftext|>y <|endoftext|>", "é日本語 テスト", "a   b  c",
    "!\x1c! a\x1c b", "\t\ttab\r\nline\r\n", "word " * 3000, "x" * 5000, "🙂🙃 👩‍👩‍👧", "12345 1,234.5%", "a   b", "end \n", "\n \n x", "\u00a0a\u00a0b \u3000c\u2003\u2003 d\u202f!", "x\x1d y\x1f\u00a0z \x1e w", "no\u00a0break " * 2000,
]


def library_counts(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return [len(t.encode(x or "", add_special_tokens=False)) for x in texts]


def library_ids(texts):
    import tiktoken

    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    return [e.encode_ordinary(x or "") for x in texts]


def sample(spark):
    return [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]


def test_counts_match_the_library(spark):
    texts = TEXTS + sample(spark)
    assert PieceCounter(P.path("byte_bpe_50k.json"), cache_bytes=6000, batch_bytes=2000).counts(texts) == library_counts(texts)


def test_token_counts_rows(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(0, None, "y")], "doc_id long, text string, n_tokens string")
    rows = token_counts(df, P.path("byte_bpe_50k.json")).collect()
    assert len(rows) == len(TEXTS) + 1
    want = dict(enumerate(library_counts(TEXTS)))
    for r in rows:
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((TEXTS[r.doc_id] or "").encode()), want[r.doc_id], want[r.doc_id] > 512)
    assert token_counts(df.limit(0), P.path("byte_bpe_50k.json")).count() == 0


def test_replay_matches_the_library(spark):
    texts = TEXTS + sample(spark)
    codec = TextCodec(replay_of(P.path("byte_bpe_50k.tiktoken")), P.PATTERN, cache_bytes=5000, corpus_bytes=3000)
    import numpy as np

    assert [np.frombuffer(x, "<u4").tolist() for x in codec.encode(texts)] == library_ids(texts)


@pytest.mark.parametrize("word", [b"aaaa", b"aaaaaaa", b"abababab", b"", b"aabaab", b"aaabaaaab", b"baaaaa", b"xyz"])
def test_overlapping_merges(word):
    ranks = {bytes([b]): b for b in range(256)} | {b"aa": 256, b"ab": 257, b"aaa": 258, b"abab": 259}
    ids = list(word)
    while True:  # the definition: lowest rank first, leftmost first
        best = min(((ranks.get(b"".join([codes(ranks)[i] for i in ids[k : k + 2]]), 1 << 30), k) for k in range(len(ids) - 1)), default=(1 << 30, 0))
        if best[0] == 1 << 30:
            break
        ids[best[1] : best[1] + 2] = [best[0]]
    if word in ranks:
        ids = [ranks[word]]
    assert MergeReplay(ranks).encode_words([word, word]) == [b"".join(i.to_bytes(4, "little") for i in ids)] * 2


def codes(ranks):
    return {v: k for k, v in ranks.items()}


def test_encode_documents(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, ids int")
    rows = encode_documents(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    want = library_ids(TEXTS)
    for r in rows:
        packed = b"".join(i.to_bytes(4, "little") for i in want[r.doc_id])
        assert (r.n_tokens, bytes(r.ids), r.ids_sha256) == (len(want[r.doc_id]), packed, hashlib.sha256(packed).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((TEXTS[r.doc_id] or "").encode()).hexdigest()
    assert encode_documents(df.where(F.lit(False)), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_pieces_are_small_and_caches_bounded():
    """Odd white space cuts, too, and what is remembered is bounded by bytes."""
    texts = [f"{k}\u00a0" + "word\u00a0" * 2000 + "字" * 3000 for k in range(60)]
    counter = PieceCounter(P.path("byte_bpe_50k.json"), cache_bytes=100_000, batch_bytes=20_000)
    assert counter.counts(texts) == library_counts(texts)
    assert counter.held < 100_000 + 40_000 and sum(map(len, counter.known)) < counter.held
    assert max(map(len, pieces_of("a\u00a0b\u3000c d"))) == 2
    assert list(batches_of(["aa", None, "bbb", "c" * 50, "", "d"], 5)) == [(0, 3), (3, 4), (4, 6)]
    codec = TextCodec(replay_of(P.path("byte_bpe_50k.tiktoken")), P.PATTERN, cache_bytes=100_000, corpus_bytes=20_000)
    assert [len(x) // 4 for x in codec.encode(texts)] == [len(x) for x in library_ids(texts)] and codec.held < 400_000


def test_repeated_rows_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b", "n", "i")] * 3 + [(None, None, None, None)], "doc_id long, text string, n_tokens string, _id string")
    assert sorted((r.doc_id or 0, r.n_tokens) for r in token_counts(df, P.path("byte_bpe_50k.json")).collect()) == [(0, 0), (1, 2), (1, 2), (1, 2)]
    assert sorted((r.doc_id or 0, r.n_tokens) for r in encode_documents(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()) == [(0, 0), (1, 2), (1, 2), (1, 2)]


def test_a_batch_is_encoded_in_parts():
    """The ids of a large batch don't have to be held together."""
    import pyarrow as pa

    from objsql.llm.byte_bpe import encoded
    from objsql.llm.common import slices

    texts = ["some words of text " * 2000, None, "", "more \u00e9 words " * 9000, "x"] * 6
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["_id", "_text"]).slice(1)
    parts = list(slices(batch, 1, 100_000))
    assert pa.Table.from_batches(parts) == pa.Table.from_batches([batch])
    assert all(len(p) == 1 or sum(len((t or "").encode()) for t in p.column(1).to_pylist()) <= 100_000 for p in parts)
    codec = TextCodec(MergeReplay(load_ranks(P.path("byte_bpe_50k.tiktoken"))), P.PATTERN, corpus_bytes=100_000)
    out = list(encoded(iter([batch]), codec, True))
    assert len(out) == len(parts) > 1
    rows = pa.Table.from_batches(out).to_pylist()
    assert [r["_id"] for r in rows] == list(range(1, len(texts)))
    assert all(codec.decode(r["ids"]).decode() == (texts[r["_id"]] or "") for r in rows)
    assert list(slices(batch.slice(0, 0), 1, 10)) == []


def test_operators_get_batches_in_slices():
    import pyarrow as pa

    from objsql.llm.common import SLICE_BYTES, lean

    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(["word " * 100_000, None] * 20)], ["id", "text"])
    got = list(lean(lambda batches: batches, 1)(iter([batch, batch.slice(3)])))
    assert pa.Table.from_batches(got) == pa.Table.from_batches([batch, batch.slice(3)])
    assert len(got) > 2 and max(sum(len(t or "") for t in b.column(1).to_pylist()) for b in got) <= SLICE_BYTES
