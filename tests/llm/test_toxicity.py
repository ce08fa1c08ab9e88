import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from objsql.llm.toxicity import LEAST_Z, MIN_DOCS, ClassifierChain, Rows, fit_logistic, fit_toxicity, kinds_of, toxicity, training_sample, word_sets


def test_logistic_is_at_the_optimum():
    g = np.random.Generator(np.random.PCG64(2))
    dense = np.column_stack([g.random((300, 2)), np.ones(300)])
    row, col = np.nonzero(g.random((300, 4)) < 0.3)
    y = (g.random(300) < 0.4).astype(float)
    x = Rows(300, row, col, 4, dense)
    w = fit_logistic(x, y, penalty=1.0, steps=50)
    p = 1 / (1 + np.exp(-x.dot(w)))
    gradient = x.transposed_dot(p - y) + np.array([1.0] * 6 + [1e-3]) * w
    assert np.abs(gradient).max() < 1e-2


def sample_of(spark, rows):
    """The training sample of (fold, label, text) rows."""
    packed = []
    for fold, label, text in rows:
        words = np.concatenate([w for _, _, _, w in word_sets(pa.array([text]))])
        packed.append((fold, label, words.tobytes()))
    return training_sample(spark.createDataFrame(packed, "fold int, label int, words binary"))


def dense_logistic(x, y, penalty=0.1):
    """Newton's method in full matrices; the last column is the intercept."""
    w, ridge = np.zeros(x.shape[1]), np.diag([penalty] * (x.shape[1] - 1) + [1e-3])
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ w))
        w = w - np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (p - y) + ridge @ w)
    return w


def test_chain_matches_full_matrices(spark):
    g = np.random.Generator(np.random.PCG64(4))
    rows = []
    for k in range(400):
        bad = g.random() < 0.4
        own = set(g.choice(["vile", "mean", "nasty", "rude"], 2)) if bad and g.random() < 0.9 else set()
        rows.append((k % 5, int(bad), " ".join([*g.choice(list("abcdefgh"), 4), *own, f"u{k}"])))
    sample, toxic = sample_of(spark, rows)
    kinds = kinds_of(sample, toxic)
    assert len(kinds) == 2 and all((~toxic[k]).sum() == 0 for k in kinds.values()) and not (kinds["kind_1"] & kinds["kind_2"]).any()
    labels = {**kinds, "toxic": toxic}
    chain = ClassifierChain.fit(sample, labels)
    full = np.zeros((len(toxic), len(sample.values)))
    full[sample.row, sample.word] = 1
    earlier = np.zeros((len(toxic), 0))

    def one(y, train):
        n, share = full[train].sum(0), y[train].mean()
        z = np.where(n < MIN_DOCS, -1, (full[train].T @ y[train] - n * share) / np.sqrt(n * share * (1 - share) + 1e-9))
        own = z >= LEAST_Z
        x = np.column_stack([full[:, own], earlier, np.ones(len(y))])
        return own, x, dense_logistic(x[train], y[train])

    for (name, y), (words, w) in zip(labels.items(), chain.models):
        y = y.astype(float)
        own, x, want = one(y, np.ones(len(y), bool))
        assert (sample.values[own] == words).all() and np.abs(want - w).max() < 0.05, name
        column = np.zeros(len(y))
        for k in range(5):
            _, x, w = one(y, sample.fold != k)
            column[sample.fold == k] = (1 / (1 + np.exp(-x @ w)))[sample.fold == k]
        earlier = np.column_stack([earlier, column])


def test_candidates_are_the_telling_words(spark):
    rows = [(k % 5, int(k < 40), ("bad " if k < 40 else "good ") + f"all own{k}") for k in range(100)]
    sample, toxic = sample_of(spark, rows)
    (wanted,) = [w for _, _, _, w in word_sets(pa.array(["bad"]))]
    assert sample.values.tolist() == wanted.tolist() and toxic.sum() == 40
    assert sorted(np.bincount(sample.row, minlength=100).tolist()) == [0] * 60 + [1] * 40


def test_held_out_accuracy(spark):
    """Over all held-out rows, also those whose label no word tells."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    chain = fit_toxicity(docs, labels.where("doc_id % 4 <> 0"))
    assert chain.categories == ["kind_1", "kind_2", "toxic"]
    rows = toxicity(docs, chain, keep=("doc_id",)).join(labels.where("doc_id % 4 = 0"), "doc_id").toPandas()
    caught, wrong = rows[rows.toxic == 1].is_toxic.mean(), rows[rows.toxic == 0].is_toxic.mean()
    print("held out: recall", caught, "false alarms", wrong)
    assert caught > 0.75 and wrong < 0.01
    assert ((rows.p_toxic >= 0.5) == rows.is_toxic).all()


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, True), (2, "", True), (3, "so bad", True), (3, "so bad", True), (None, "x", True)], "doc_id long, text string, is_toxic boolean")
    labels = spark.createDataFrame([(3, 1), (None, 1), (2, None)], "doc_id long, toxic int")
    assert fit_toxicity(docs, labels.limit(0)) is None
    out = toxicity(docs, None)
    assert out.columns == ["doc_id", "text", "is_toxic"] and not any(r.is_toxic for r in out.collect()) and out.count() == 5
    chain = ClassifierChain.fit(*(lambda sample, y: (sample, {"toxic": y}))(*sample_of(spark, [(k % 5, 1, "so bad") for k in range(40)] + [(k % 5, 0, "fine") for k in range(40)])))
    assert sorted(r.doc_id for r in toxicity(docs, chain).where("is_toxic").collect()) == [3, 3]
    kept = toxicity(docs, chain, filter=True)
    assert kept.columns == docs.columns and kept.count() == 3
    assert toxicity(docs.where(F.lit(False)), chain).count() == 0
    long = "word " * 200_000 + "bad"
    assert [r.is_toxic for r in toxicity(spark.createDataFrame([(1, long)], docs.select("doc_id", "text").schema), chain).collect()] == [True]
    one = fit_toxicity(docs, labels)
    assert toxicity(docs, one).count() == 5
