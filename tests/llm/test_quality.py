import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from objsql.llm.quality import COUNTS, FEATURES, BoostedTrees, document_counts, fit_quality, quality_filter

TEXTS = [None, "", " \n\t", "a b c a b c", "x", "# $% a&b|<>*", "one\none\n \n\ntwo\none \n", "é è é è é è", "A1 b2, C3.\n" * 40, "w " * 5000, "\x0bq\x0cq\rq"]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    marked = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    seen, dup, lines = set(), 0, 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += 1
            dup += line in seen
            seen.add(line)
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": dup,
        "n_repeat_words": len(marked), "n_lines": lines, "n_distinct_words": len(set(words)), "n_upper": len(re.findall("[A-Z]", text)), "n_digits": len(re.findall("[0-9]", text)),
        "n_punct": len(re.findall(r"[!-/:-@\[-`{-~\x7f]", text)), "max_word_bytes": max((len(w.encode()) for w in words), default=0), "n_short_words": sum(len(w.encode()) <= 3 for w in words),
    }


def test_counts_match_brute_force(spark):
    real = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    texts = TEXTS + real
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, n_words string").repartition(3)
    rows = document_counts(df).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r.doc_id])
        assert {c: r[c] for c in COUNTS} == want, texts[r.doc_id]


def test_trees_are_monotone_and_learn():
    g = np.random.Generator(np.random.PCG64(1))
    x = g.random((3000, 3))
    y = (x[:, 0] + 0.3 * np.sin(9 * x[:, 0]) + x[:, 1] + 0.1 * g.normal(size=3000) > 1).astype(float)
    model = BoostedTrees((1, 0, -1)).fit(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) > 0) == y[2000:]).mean() > 0.9
    for f, sign in ((0, 1), (2, -1)):
        grid = np.repeat(x[:50], 40, 0)
        grid[:, f] = np.tile(np.linspace(-1, 2, 40), 50)
        steps = np.diff(model.score(grid).reshape(50, 40), axis=1) * sign
        assert (steps >= -1e-12).all()


def test_flat_scores_match_a_walk_down_the_trees():
    g = np.random.Generator(np.random.PCG64(2))
    x = g.random((600, 4)).round(1)
    model = BoostedTrees((1, 0, -1, 0), trees=12).fit(x, (x[:, 0] + x[:, 1] * x[:, 3] + 0.2 * g.normal(size=600) > 0.8).astype(float))

    def walk(node, row):
        if model.left[node] == node:
            return model.value[node]
        side = model.left if row[model.feature[node]] <= model.threshold[node] else model.right
        return walk(side[node], row)

    want = [model.base + sum(walk(root, row) for root in model.roots) for row in x]
    assert len(set(np.round(want, 6))) > 20 and np.allclose(model.score(x), want)


def test_sample_of_the_fit_is_bounded(spark):
    docs = spark.range(300).selectExpr("id as doc_id", "repeat(concat('w', id % 7, ' '), cast(50 + id % 9 as int)) as text")
    counts = document_counts(docs.union(docs))
    labels = spark.range(300).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    model = fit_quality(counts, labels, train_rows=50)
    again = fit_quality(counts.repartition(5), labels.union(labels), train_rows=50)
    assert np.array_equal(model.value, again.value) and np.array_equal(model.threshold, again.threshold)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    train = labels.where("doc_id % 4 <> 0")
    rows = quality_filter(docs, train).join(labels.where("doc_id % 4 = 0"), "doc_id").select("kept", "quality", "base_failed").toPandas()
    judged = rows[~rows.base_failed]
    assert ((judged.kept) == (judged.quality == 1)).mean() > 0.9
    assert judged[judged.quality == 1].kept.mean() > 0.97


def test_edge_cases(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "w " * 100), (None, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = sorted(quality_filter(df, none).collect(), key=lambda r: (r.doc_id or 0))
    assert [(r.n_words, r.base_failed, r.kept, r.quality_score) for r in rows] == [(2, True, False, None), (0, True, False, None), (0, True, False, None), (100, True, False, None)]
    assert quality_filter(df.where(F.lit(False)), none).count() == 0
    assert len(FEATURES) == 12
