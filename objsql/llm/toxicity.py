"""Toxicity by a chain of linear classifiers.

Categories are predicted one after another. Each has a logistic model over the
presence of words; the models of later categories also get the probabilities
of the earlier ones. In training those probabilities are out-of-fold, as an
in-sample probability would look far surer than those met when scoring.

The labels only say toxic or not, so the kinds of toxicity that come before it
in the chain are found in the training rows: toxic rows are clustered by the
words that tell them from the others, and each cluster is a category.

Words are 64-bit hashes. Texts stay on the executors: words are counted there
by fold and label, and the driver gets the telling words, ``CANDIDATES`` at
most, and for each training row the numbers of those it has.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from objsql.llm.common import lean, written
from objsql.llm.text_kernel import PUNCT, runs

#: Labelled rows that a chain is fitted on at most.
TRAIN_ROWS = 16_000
FOLDS, KINDS = 5, 2
#: Words that the driver gets at most, words that a category's model looks at, and training rows that such a word is in at least.
CANDIDATES, MAX_WORDS, MIN_DOCS, LEAST_Z = 4_000, 2_000, 5, 5.0


def word_sets(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of texts: number of the first, how many, and each text's distinct words as text number and hash."""
    for run in runs(pc.utf8_lower(column)):
        starts, ends, owner = run.spans(PUNCT)
        words = run.hashes(starts, ends)
        order = np.argsort((owner.astype(np.uint64) << np.uint64(40)) | (words >> np.uint64(24)), kind="stable")
        owner, words = owner[order], words[order]
        new = np.ones(len(words), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (words[1:] != words[:-1])
        yield run.first, len(run), owner[new], words[new]


@dataclass
class Rows:
    """A sparse 0/1 matrix as the coordinates of its ones, and dense columns beside it."""

    n: int
    row: np.ndarray
    col: np.ndarray
    width: int
    dense: np.ndarray

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], self.n) + self.dense @ w[self.width :]

    def transposed_dot(self, u: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(self.col, u[self.row], self.width), self.dense.T @ u])

    def take(self, keep: np.ndarray) -> Rows:
        place = np.cumsum(keep) - 1
        own = keep[self.row]
        return Rows(int(keep.sum()), place[self.row[own]], self.col[own], self.width, self.dense[keep])


def fit_logistic(x: Rows, y: np.ndarray, penalty: float = 0.1, steps: int = 15) -> np.ndarray:
    """Weights by Newton's method with conjugate gradients; the last dense column is the unpenalised intercept."""
    w = np.zeros(x.width + x.dense.shape[1])
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-3

    def loss(w: np.ndarray) -> float:
        z = x.dot(w)
        return float(np.logaddexp(0, z).sum() - y @ z + 0.5 * (ridge * w) @ w)

    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x.dot(w)))
        gradient, curve = x.transposed_dot(p - y) + ridge * w, p * (1 - p)
        step, r = np.zeros(len(w)), -gradient
        d, rr = r.copy(), r @ r
        if rr < 1e-10:
            break
        for _ in range(20):
            hd = x.transposed_dot(curve * x.dot(d)) + ridge * d
            a = rr / (d @ hd)
            step += a * d
            r = r - a * hd
            new = r @ r
            if new < 1e-4 * (gradient @ gradient):
                break
            d, rr = r + (new / rr) * d, new
        size = 1.0
        while (after := loss(w + size * step)) > now and size > 1e-3:
            size /= 2
        if now - after < 1e-6 * abs(now):
            break
        w, now = w + size * step, after
    return w


@dataclass
class Sample:
    """Training rows: the hashes (sorted) of the candidate words, the row and the candidate of each word of a row, and each row's fold."""

    values: np.ndarray
    row: np.ndarray
    word: np.ndarray
    fold: np.ndarray

    def matrix(self, words: np.ndarray, earlier: np.ndarray) -> Rows:
        """Presence of the candidates numbered by ``words`` (sorted)."""
        dense = np.column_stack([earlier, np.ones(len(self.fold))])
        column = np.full(len(self.values) + 1, -1)
        column[words] = np.arange(len(words))
        at = column[self.word]
        return Rows(len(self.fold), self.row[at >= 0], at[at >= 0], len(words), dense)

    def z(self, y: np.ndarray, train: np.ndarray) -> np.ndarray:
        """For each candidate, how surely its rows have the label more often than others; -1 for rare ones."""
        own = train[self.row]
        n = np.bincount(self.word[own], minlength=len(self.values))
        return z_score(n, np.bincount(self.word[own], y[self.row[own]], len(self.values)), y[train].mean() if train.any() else 0.0)


def z_score(n: np.ndarray, positive: np.ndarray, share: float) -> np.ndarray:
    return np.where(n < MIN_DOCS, -1.0, (positive - n * share) / np.sqrt(n * share * (1 - share) + 1e-9))


def kinds_of(sample: Sample, toxic: np.ndarray, kinds: int = KINDS, steps: int = 10) -> dict[str, np.ndarray]:
    """Clusters of the toxic rows by their telling words: cosine k-means whose first centres are words that hardly occur together.

    Toxic rows without a telling word belong to no cluster. Ties go to the first cluster.
    """
    z = sample.z(toxic.astype(float), np.ones(len(toxic), bool))
    telling = np.flatnonzero(z >= LEAST_Z)
    if not len(telling):
        return {}
    x = sample.matrix(telling, np.zeros((len(toxic), 0)))
    on = toxic[x.row]
    row, col = x.row[on], x.col[on]
    weight = np.sqrt(z[telling])[col]
    length = np.sqrt(np.bincount(row, weight**2, len(toxic)))
    weight = weight / length[row]
    first, together = [int(np.argmax(z[telling]))], np.zeros(len(telling))
    often = np.bincount(col, minlength=len(telling)).astype(float)
    while len(first) < min(kinds, len(telling)):
        has = np.zeros(len(toxic), bool)
        has[row[col == first[-1]]] = True
        together += np.bincount(col[has[row]], minlength=len(telling))
        gain = z[telling] * (1 - np.minimum(1, together / np.maximum(1, often)))
        gain[first] = -1
        first.append(int(np.argmax(gain)))
    centres = np.zeros((len(first), len(telling)))
    centres[np.arange(len(first)), first] = 1.0
    member = np.full(len(toxic), -1)
    known = np.flatnonzero(length > 0)
    for _ in range(steps):
        score = np.stack([np.bincount(row, weight * c[col], len(toxic)) for c in centres])
        # What is like no centre goes to none at first.
        now = np.where(score.max(axis=0) > 0, score.argmax(axis=0), -1)
        now[length == 0] = -1
        if (now == member).all():
            break
        member = now
        for k in range(len(centres)):
            own = member[row] == k
            centre = np.bincount(col[own], weight[own], len(telling))
            if centre.any():
                centres[k] = centre / np.sqrt((centre**2).sum())
    member[known[member[known] < 0]] = 0
    return {f"kind_{k + 1}": member == k for k in range(len(first))}


class ClassifierChain:
    """For each category in order: its words (sorted hashes) and its weights, those of earlier probabilities and the intercept last."""

    def __init__(self, categories: list[str], models: list[tuple[np.ndarray, np.ndarray]]):
        self.categories, self.models = categories, models

    @staticmethod
    def _matrix(n: int, row: np.ndarray, words: np.ndarray, vocabulary: np.ndarray, earlier: np.ndarray) -> Rows:
        dense = np.column_stack([earlier, np.ones(n)])
        if not len(vocabulary):
            return Rows(n, row[:0], row[:0], 0, dense)
        at = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
        known = vocabulary[at] == words
        return Rows(n, row[known], at[known], len(vocabulary), dense)

    @classmethod
    def fit(cls, sample: Sample, labels: dict[str, np.ndarray], folds: int = FOLDS, max_words: int = MAX_WORDS) -> ClassifierChain:
        n = len(sample.fold)
        earlier, models = np.zeros((n, 0)), []
        for y in labels.values():
            y = np.asarray(y, float)
            out_of_fold = np.zeros(n)
            for k in range(folds):
                train = sample.fold != k
                words, w = cls._fit_one(sample, y, earlier, train, max_words)
                out_of_fold[~train] = 1 / (1 + np.exp(-sample.matrix(words, earlier).dot(w)[~train]))
            words, w = cls._fit_one(sample, y, earlier, np.ones(n, bool), max_words)
            models.append((sample.values[words], w))
            earlier = np.column_stack([earlier, out_of_fold])
        return cls(list(labels), models)

    @staticmethod
    def _fit_one(sample: Sample, y: np.ndarray, earlier: np.ndarray, train: np.ndarray, max_words: int) -> tuple[np.ndarray, np.ndarray]:
        z = sample.z(y, train)
        best = np.argsort(-z, kind="stable")[:max_words]
        words = np.sort(best[z[best] >= LEAST_Z])
        return words, fit_logistic(sample.matrix(words, earlier).take(train), y[train])

    def probabilities(self, column: pa.Array) -> np.ndarray:
        """Rows x categories."""
        out = np.zeros((len(column), len(self.models)))
        for first, n, owner, words in word_sets(column):
            earlier = np.zeros((n, 0))
            for vocabulary, w in self.models:
                p = 1 / (1 + np.exp(-self._matrix(n, owner, words, vocabulary, earlier).dot(w)))
                earlier = np.column_stack([earlier, p])
            out[first : first + n] = earlier
        return out


def _packed_words(rows: DataFrame) -> DataFrame:
    """(_id, _label, same, words, sum) of (_id, _label, same, text): the distinct words packed, and the sum of their hashes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, owner, words in word_sets(batch.column(3)):
                cut = np.searchsorted(owner, np.arange(n + 1))
                total = np.zeros(n, np.uint64)
                np.add.at(total, owner, words)
                own = [c.slice(first, n) for c in batch.columns[:3]]
                yield pa.RecordBatch.from_arrays([*own, pa.array([words[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary()), pa.array(total.view(np.int64))], ["_id", "_label", "same", "words", "sum"])

    return rows.mapInArrow(lean(pack, 3), StructType([*rows.select("_id", "_label", "same").schema.fields, *StructType.fromDDL("words binary, sum long").fields]))


def training_sample(rows: DataFrame, folds: int = FOLDS, candidates: int = CANDIDATES) -> tuple[Sample, np.ndarray]:
    """The sample of (fold, label, words) rows, words packed, and the labels; a candidate tells the label in all rows or without one fold."""
    rows = written(rows, "toxicity-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                words = np.frombuffer(batch.column(2)[k].as_buffer(), np.int64)
                cell = 2 * batch.column(0)[k].as_py() + batch.column(1)[k].as_py()
                yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(np.full(len(words), cell, np.int32))], ["word", "cell"])

    sizes = np.zeros(2 * folds)
    for r in rows.groupBy((2 * F.col("fold") + F.col("label")).alias("cell")).count().collect():
        sizes[r["cell"]] = r["count"]
    cells = [F.count(F.when(F.col("cell") == c, 1)).alias(f"c{c}") for c in range(2 * folds)]
    counts = rows.mapInArrow(lean(count), "word long, cell int").groupBy("word").agg(*cells)

    def z(left_out: int) -> Column:
        of = [k for k in range(folds) if k != left_out]
        size = sum(sizes[2 * k] + sizes[2 * k + 1] for k in of)
        share = float(sum(sizes[2 * k + 1] for k in of) / size) if size else 0.0
        positive = sum((F.col(f"c{2 * k + 1}") for k in of), F.lit(0))
        n = sum((F.col(f"c{2 * k}") for k in of), positive)
        return F.when(n < MIN_DOCS, -1.0).otherwise((positive - n * share) / F.sqrt(n * (share * (1 - share)) + 1e-9))

    best = counts.select("word", F.greatest(*[z(k) for k in range(-1, folds)]).alias("z")).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "word").limit(candidates)
    values = np.sort(np.array([r.word for r in best.collect()], np.int64).view(np.uint64))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = []
            for k in range(len(batch)):
                words = np.frombuffer(batch.column(2)[k].as_buffer(), np.uint64)
                at = np.searchsorted(values, words)
                at[at == len(values)] = 0
                known.append((at[values[at] == words] if len(values) else at[:0]).astype(np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(known, pa.binary())], ["fold", "label", "words"])

    table = rows.mapInArrow(lean(number), rows.schema).toArrow()
    # In an order that doesn't change from run to run.
    order = sorted(zip(table.column("words").to_pylist(), table.column("fold").to_pylist(), table.column("label").to_pylist()))
    packed = [np.frombuffer(w, np.uint16) for w, _, _ in order]
    sample = Sample(values, np.repeat(np.arange(len(packed)), [len(w) for w in packed]), np.concatenate([*packed, np.zeros(0, np.uint16)]).astype(np.int64), np.array([f for _, f, _ in order], np.int64))
    return sample, np.array([y for _, _, y in order], np.int64) > 0


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = TRAIN_ROWS, kinds: int = KINDS
) -> ClassifierChain | None:
    """A chain from the labelled documents; None without a label.

    At most ``train_rows`` labelled rows are used, those whose hashed id is
    least, and of equal texts one, that with the least id; of an id labelled
    more than once the greatest label counts. Only the ids are ordered, so no
    text is shuffled but those of the sample, and none comes to the driver.
    """
    known = labels.where(labels[id_col].isNotNull() & labels[label_col].isNotNull()).groupBy(labels[id_col].alias("_id")).agg((F.max(label_col).cast("int") > 0).cast("int").alias("_label"))
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(train_rows)
    # At most train_rows rows of two numbers.
    texts = docs.join(F.broadcast(known), docs[id_col] == known["_id"]).where(docs[text_col].isNotNull()).select("_id", "_label", docs[text_col].cast("string").alias("text"))
    packed = _packed_words(texts.select("_id", "_label", F.sha2("text", 256).alias("same"), "text"))
    # Rows with equal words go to the same fold, or a copy would be scored by a model that has seen it.
    fold = F.pmod(F.shiftrightunsigned(F.col("row.sum"), 13), F.lit(FOLDS)).cast("int")
    rows = packed.groupBy("same").agg(F.min(F.struct("_id", "_label", "words", "sum")).alias("row")).select(fold.alias("fold"), F.col("row._label").alias("label"), F.col("row.words").alias("words"))
    sample, toxic = training_sample(rows)
    if not len(toxic):
        return None
    return ClassifierChain.fit(sample, {**(kinds_of(sample, toxic, kinds) if kinds else {}), "toxic": toxic})


def toxicity(docs: DataFrame, chain: ClassifierChain | None, text_col: str = "text", threshold: float = 0.5, keep: tuple[str, ...] | None = None, filter: bool = False) -> DataFrame:
    """The rows of ``docs`` with ``p_<category>`` for each category and ``is_toxic``; with ``filter``, the rows that aren't toxic, as they are.

    - A row is toxic if the last category's probability is ``threshold`` or
      more. Null, empty and wordless texts have no features: they get the base
      probability. Without a chain nothing is toxic and there are no p columns.
    - ``keep`` names the input columns to return (default: all).
    - Rows come out one for one, repeated or not; an empty table stays empty.
    - Columns of ``docs`` that are named like an added one are replaced.
    """
    names = [f"p_{c}" for c in chain.categories] if chain else []
    added = [] if filter else [*names, "is_toxic"]
    own = [c for c in (keep or docs.columns) if c not in added]
    narrow = docs.select(*[docs[c] for c in own], docs[text_col].cast("string").alias("_objsql_text"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = chain.probabilities(batch.column(len(own))) if chain else np.zeros((len(batch), 0))
            bad = p[:, -1] >= threshold if chain else np.zeros(len(batch), bool)
            columns = batch.columns[: len(own)]
            if filter:
                yield pa.RecordBatch.from_arrays(columns, own).filter(pa.array(~bad))
            else:
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array(c) for c in p.T], pa.array(bad)], [*own, *added])

    schema = docs.select(*own).schema
    extra = ", ".join([*[f"`{n}` double" for n in names], "is_toxic boolean"]) if not filter else ""
    return narrow.mapInArrow(lean(judge, len(own)), StructType([*schema.fields, *(StructType.fromDDL(extra).fields if extra else [])]))
