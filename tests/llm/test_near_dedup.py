import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from objsql.llm.grouping import connected_groups
from objsql.llm import grouping, near_dedup
from objsql.llm.near_dedup import COMMON, FLOOR, Idf, WeightedSampler, crowded_links, drop_near_duplicates, near_duplicates


def sets_of(rows, width=5):
    out = {}
    for doc, text in rows:
        words = re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").lower())
        grams = [tuple(words[k : k + width]) for k in range(len(words) - width + 1)] or ([tuple(words)] if words else [])
        out[doc] = Counter(grams)
    return out


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(rows, similarity=0.8):
    sets = sets_of(rows)
    n = sum(1 for _, t in rows if t)
    df = Counter(g for s in sets.values() for g in s)
    idf = {g: max(FLOOR, min(1, math.log(n / c) / math.log(1 / COMMON))) if c >= COMMON * n else 1 for g, c in df.items()}
    having = defaultdict(list)
    for doc, s in sets.items():
        for g in s:
            having[g].append(doc)
    shared = defaultdict(float)
    for g, docs in having.items():
        for i, a in enumerate(docs):
            for b in docs[:i]:
                shared[a, b] += min(sets[a][g], sets[b][g]) * idf[g]
    mass = {doc: sum(c * idf[g] for g, c in s.items()) for doc, s in sets.items()}
    return roots(sets, [p for p, x in shared.items() if x / (mass[p[0]] + mass[p[1]] - x) >= similarity])


def test_classes_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = {r.doc_id: r.class_id for r in near_duplicates(docs.repartition(3)).collect()}
    assert got == want
    assert sum(a != b for a, b in got.items()) > 50


def test_samples_agree_as_often_as_sets_are_alike():
    g = np.random.Generator(np.random.PCG64(3))
    universe = g.integers(0, 1 << 63, 300, dtype=np.uint64)
    for weights in (np.ones(300), g.choice([0.5, 1.0, 2.0, 3.0], 300), g.random(300) * 4 + 0.1):
        a, b = weights.copy(), weights * g.choice([1.0, 1.0, 1.5], 300)
        a[:40], b[-30:] = 0, 0
        want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        codes = [WeightedSampler(4000, 5).sample(universe[w > 0], w[w > 0], np.array([0]))[0] for w in (a, b)]
        assert abs((codes[0] == codes[1]).mean() - want) < 0.04


def test_edge_cases(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [
        (1, None), (2, ""), (3, "!!! ..."), (4, "!!! ..."), (5, "one two"), (6, "ONE, two!"), (7, "one two three"), (8, base), (9, base.replace("w59", "x")), (10, base + " " + base[:20]),
        (11, "y " * 20000), (12, "y " * 20000), (12, "y " * 20000), (13, "other words here and there again"), (13, base), (None, base), (-4, base.upper()),
    ]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, class_id int")
    got = {r.doc_id: r.class_id for r in near_duplicates(df).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 5, 7: 7, 8: -4, 9: -4, 10: -4, 11: 11, 12: 11, 13: -4, -4: -4}
    left = drop_near_duplicates(df)
    assert left.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in left.collect()) == [(False, d) for d in (-4, 1, 2, 3, 4, 5, 7, 11)] + [(True, None)]
    assert near_duplicates(df.where(F.lit(False))).count() == 0


def test_large_group_of_variants(spark):
    words = [f"v{i}" for i in range(120)]
    rows = [(i, " ".join(words[:10] + [f"n{i}"] + words[10:] if i % 3 else words)) for i in range(300)] + [(1000 + i, " ".join(f"q{i}_{k}" for k in range(100))) for i in range(200)]
    got = {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == 0 for i in range(300)) and all(got[1000 + i] == 1000 + i for i in range(200))


@pytest.mark.parametrize("direct", [0, grouping.DIRECT])
def test_pairs_that_share_a_passage_with_many(spark, monkeypatch, direct):
    """Texts that share a passage meet in crowded buckets; pairs alike beyond it must be found, others left alone."""
    monkeypatch.setattr(grouping, "DIRECT", direct)
    g = np.random.Generator(np.random.PCG64(8))
    passage = [f"p{k}" for k in range(150)]
    rows = []
    for k in range(120):
        own = [f"t{k // 2}_{j}" for j in range(int(g.integers(28, 45)))] if k % 2 == 0 else rows[-1][1].split()[150:-4] + [f"x{k}_{j}" for j in range(4)]
        rows.append((k, " ".join(passage + own)))
    # All shingles weigh one.
    got = {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), floor=1.0).collect()}
    sets = sets_of(rows)
    alike = [(a, b) for a in sets for b in sets if a > b and sum((sets[a] & sets[b]).values()) >= 0.8 * sum((sets[a] | sets[b]).values())]
    want = roots(sets, alike)
    found = sum(got[a] == got[b] for a, b in alike)
    assert len({want[k] for k in sets}) > 30 and found >= 0.97 * len(alike)
    assert all(want[k] == want[got[k]] for k in sets)


@pytest.mark.parametrize("links", [[], [(2, 1)], [(k + 1, k) for k in range(40)], [(k, 0) for k in range(1, 50)] + [(100, 99), (99, 98), (100, 101)], [(5, 3), (3, 5), (7, 5), (9, 8), (8, 8)]])
def test_connected_groups(spark, links):
    got = {r.id: r.root for r in connected_groups(spark.createDataFrame(links, "a long, b long")).collect()}
    want = roots({x for p in links for x in p}, links)
    assert got == {n: r for n, r in want.items() if n != r}


@pytest.mark.parametrize("block_rows", [7, 512])
def test_blocks_lose_no_link(spark, monkeypatch, block_rows):
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", block_rows)
    g = np.random.Generator(np.random.PCG64(9))
    sets = {k: {int(x): int(g.choice([1, 1, 1, 4])) for x in g.choice(40, int(g.integers(15, 25)), replace=False)} for k in range(60)}
    for k in range(60, 80):
        sets[k] = dict(list(sets[k - 60].items())[1:])
    idf = Idf(np.arange(10, dtype=np.uint64), np.linspace(0.5, 0.95, 10))
    weigh = {k: {x: c * (0.5 + 0.05 * x if x < 10 else 1) for x, c in s.items()} for k, s in sets.items()}
    packed = [(k, np.array(sorted(s), np.uint64).tobytes(), np.array([s[x] for x in sorted(s)], np.uint32).tobytes()) for k, s in sets.items()]
    rows = spark.createDataFrame(packed, "id long, grams binary, counts binary")
    every = spark.createDataFrame([(1, k, float(sum(weigh[k].values())), k // 2 if k < 4 else k) for k in sets], "key long, id long, size double, own long")
    got = sorted((r.a, r.b) for r in crowded_links(every.where("id % 3 > 0"), every, rows, idf, 0.8).collect())
    own = {k: k // 2 if k < 4 else k for k in sets}
    want = []
    for a in sets:
        for b in range(a):
            shared = sum(min(w, weigh[b].get(x, 0)) for x, w in weigh[a].items())
            if (a % 3 or b % 3) and own[a] != own[b] and shared >= 0.8 * (sum(weigh[a].values()) + sum(weigh[b].values()) - shared):
                want.append((a, b))
    assert got == sorted(want) and len(want) > 8
