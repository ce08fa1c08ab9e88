import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest
from pyspark.sql import functions as F

from objsql.llm import ngram_lm
from objsql.llm.ngram_lm import MU, EliasFano, lm_scores


@pytest.mark.parametrize("values", [[], [0], [5, 5, 5], [0, 1, 2, 1 << 40], list(range(0, 3000, 7)), sorted(np.random.Generator(np.random.PCG64(1)).integers(0, 1 << 35, 5000).tolist())])
def test_elias_fano(values):
    v = np.array(values, np.uint64)
    ef = EliasFano(EliasFano.encode(v, "x"), "x")
    n = len(v)
    assert ef.access(np.arange(n)).tolist() == values if n else True
    g = np.random.Generator(np.random.PCG64(2))
    x = np.concatenate([v, v + np.uint64(1), g.integers(0, (values[-1] if n else 1) + 300, 500).astype(np.uint64)])
    first = g.integers(0, n + 1, len(x))
    last = np.maximum(first, g.integers(0, n + 1, len(x)))
    at, hit = ef.successor(x, first, last)
    for k in range(len(x)):
        want = min(max(int(np.searchsorted(v, x[k])), first[k]), last[k])
        assert at[k] == want and hit[k] == (want < last[k] and v[want] == x[k])


def brute(rows):
    cut = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]
    out = zlib.crc32
    train = [cut(t) for d, t in rows if out(str("" if d is None else d).encode()) % 10]
    c = Counter(w for ws in train for w in ws)
    pairs = Counter((a, b) for ws in train for a, b in zip([0, *ws], ws))
    n, v = sum(c.values()), len(c)
    one = lambda w: (c[w] + 0.1) / (n + 0.1 * (v + 1))
    total = lambda h: len(train) if h == 0 else c[h]
    result = []
    for d, t in rows:
        ws = cut(t)
        base = sum(log10(one(w)) for w in ws)
        full = sum(log10((pairs[a, b] + MU * one(b)) / (total(a) + MU)) for a, b in zip([0, *ws], ws))
        result.append((d, out(str("" if d is None else d).encode()) % 10 == 0, len(ws), sum(c[w] > 0 for w in ws), n, base, full))
    return result


@pytest.mark.parametrize("small", [False, True])
def test_matches_brute_force(spark, monkeypatch, small):
    if small:  # many buckets and shards, and contexts that are split
        for name, x in (("SHARD_TOKENS", 500), ("BUCKET_WORDS", 300), ("COUNT_BYTES", 20_000)):
            monkeypatch.setattr(ngram_lm, name, x)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(-1, None), (-2, ""), (-3, "the THE É é\x0bthe"), (-3, "the THE É é\x0bthe"), (-4, "the " * 3000), (-5, "unheard of things")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int").repartition(3)
    got = sorted(tuple(r) for r in lm_scores(df).collect())
    want = sorted(brute(rows))
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5] and abs(g[5] - w[5]) < 1e-6 * max(1, -w[5])
        assert abs(g[6] - w[6]) <= 0.0236 * w[2] + 1e-6


def test_edge_cases(spark):
    none = spark.createDataFrame([(37, "a b"), (37, None)], "doc_id long, text string")  # held out
    assert zlib.crc32(b"37") % 10 == 0
    assert sorted((r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in lm_scores(none).collect()) == [(True, 1, 0, 0, 0.0), (True, 3, 0, 0, 0.0)]
    assert lm_scores(none.where(F.lit(False))).count() == 0
