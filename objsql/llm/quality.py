"""Quality rules: gradient-boosted trees over document statistics.

Statistics of whole texts are taken with numpy over Arrow buffers. A small
boosted ensemble is fitted here on a bounded sample of labelled documents; its
trees are flattened into one set of node arrays, so that scoring a batch is as
many array lookups as the trees are deep. Chosen features are constrained:
raising one of them never raises the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from objsql.llm.common import settled
from objsql.llm.text_kernel import PUNCT, SPACE, Run, combine, runs

#: Labelled rows that a model is fitted on at most.
TRAIN_ROWS = 20_000

#: Counts that statistics are made of; all of whole texts.
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper",
    "n_digits", "n_punct", "n_distinct_words", "max_word_bytes", "n_short_words",
)
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
_MARK = PUNCT & ~SPACE & (np.arange(256) > 0x20)


def _repeated(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks items whose key occurs again in the same text, and those that repeat an earlier one."""
    order = np.lexsort((keys, owner))
    same = (keys[order][1:] == keys[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    twice, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    later[order[1:][same]] = True
    return twice, later


def run_counts(run: Run) -> dict[str, np.ndarray]:
    """COUNTS for each text of a run."""
    n = len(run)
    starts, ends, owner = run.spans(SPACE)
    per = lambda which: np.bincount(which, minlength=n).astype(np.int64)
    hashes = run.hashes(starts, ends)
    out = {"n_words": per(owner)}
    out["word_chars"] = run.count(~SPACE[run.data] & ((run.data & 0xC0) != 0x80))
    out["n_symbols"] = run.count(_SYMBOL[run.data])

    line_starts, line_ends, line_owner = run.lines()
    # A line has a word if a word begins in it: words don't span line breaks.
    worded = np.searchsorted(starts, line_ends, "left") > np.searchsorted(starts, line_starts, "left")
    out["n_lines"] = per(line_owner[worded])
    _, later = _repeated(run.hashes(line_starts[worded], line_ends[worded]), line_owner[worded])
    out["n_dup_lines"] = per(line_owner[worded][later])

    windows, begins = combine(hashes, owner, 3)
    twice, _ = _repeated(windows, owner[begins])
    covered = np.zeros(len(hashes) + 2, bool)
    for k in range(3):
        covered[begins[twice] + k] = True
    out["n_repeat_words"] = per(owner[covered[: len(owner)]])

    out["n_upper"] = run.count(_UPPER[run.data])
    out["n_digits"] = run.count(_DIGIT[run.data])
    out["n_punct"] = run.count(_MARK[run.data])
    _, later = _repeated(hashes, owner)
    out["n_distinct_words"] = out["n_words"] - per(owner[later])
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, owner, ends - starts)
    out["max_word_bytes"] = longest
    out["n_short_words"] = per(owner[ends - starts <= 3])
    return out


def document_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and COUNTS (long) for each row; null text has no words."""
    kind = docs.schema[id_col].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [run_counts(run) for run in runs(batch.column(1))]
            columns = [pa.array(np.concatenate([p[c] for p in parts]) if parts else [], pa.int64()) for c in COUNTS]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["_id", *COUNTS])

    narrow = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text"))
    return narrow.mapInArrow(count, f"_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS)).withColumnRenamed("_id", id_col)


#: Feature -> direction in which the score may move with it (0: any).
FEATURES = {
    "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "digit_share": 0, "upper_share": 0, "punct_share": 0,
    "mean_word": 0, "max_word": 0, "distinct_share": 1, "short_share": 0, "words": 0, "words_per_line": 0,
}


def features(counts: dict[str, np.ndarray]) -> np.ndarray:
    c = {k: np.asarray(v, np.float64) for k, v in counts.items()}
    words, chars, lines = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1), np.maximum(c["n_lines"], 1)
    return np.column_stack([
        c["n_symbols"] / words, c["n_dup_lines"] / lines, c["n_repeat_words"] / words, c["n_digits"] / chars, c["n_upper"] / chars, c["n_punct"] / chars,
        c["word_chars"] / words, np.log1p(c["max_word_bytes"]), c["n_distinct_words"] / words, c["n_short_words"] / words, np.log1p(c["n_words"]), np.log1p(words / lines),
    ])


@dataclass
class BoostedTrees:
    """A boosted ensemble for a binary label, kept as flat node arrays.

    A leaf points to itself, so scoring takes the same number of steps in every
    tree. ``signs`` gives each feature's direction; splits that would break it
    are not considered, and the two sides of a split on a constrained feature
    are kept apart by a bound that all nodes below them obey.
    """

    signs: tuple[int, ...]
    trees: int = 60
    depth: int = 4
    rate: float = 0.15
    bins: int = 64
    min_rows: int = 10
    smoothing: float = 1.0
    base: float = 0.0
    roots: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    feature: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    threshold: np.ndarray = field(default_factory=lambda: np.zeros(0))
    left: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    right: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    value: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        share = (y.sum() + 0.5) / (len(y) + 1)
        self.base = float(np.log(share / (1 - share)))
        edges = [np.unique(np.quantile(column, np.linspace(0, 1, self.bins + 1)[1:-1])) for column in x.T]
        # Bin b holds edges[b-1] < value <= edges[b]; a split at b sends bins up to b left.
        binned = np.column_stack([np.searchsorted(e, column, "left") for e, column in zip(edges, x.T)])
        nodes: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
        roots, score = [], np.full(len(y), self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            gradient, weight = y - p, p * (1 - p)
            roots.append(self._grow(binned, edges, gradient, weight, np.arange(len(y)), score, nodes, self.depth, -np.inf, np.inf))
        self.roots = np.array(roots, np.int64)
        for name in ("feature", "left", "right"):
            setattr(self, name, np.array(nodes[name], np.int64))
        self.threshold, self.value = np.array(nodes["threshold"]), np.array(nodes["value"])
        return self

    def _grow(self, binned, edges, gradient, weight, rows, score, nodes, depth, low, high) -> int:
        node = len(nodes["value"])
        leaf = lambda g, w: float(np.clip(g / (w + self.smoothing), low, high))
        g, w = gradient[rows].sum(), weight[rows].sum()
        for name, x in (("feature", 0), ("threshold", np.inf), ("left", node), ("right", node), ("value", self.rate * leaf(g, w))):
            nodes[name].append(x)
        best = (1e-6, None)
        if depth and len(rows) >= 2 * self.min_rows:
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                b = binned[rows, f]
                gs, ws, ns = (np.cumsum(np.bincount(b, v, len(e) + 1))[:-1] for v in (gradient[rows], weight[rows], None))
                with np.errstate(invalid="ignore"):
                    lv, rv = np.clip(gs / (ws + self.smoothing), low, high), np.clip((g - gs) / (w - ws + self.smoothing), low, high)
                    gain = gs * lv - 0.5 * (ws + self.smoothing) * lv**2 + (g - gs) * rv - 0.5 * (w - ws + self.smoothing) * rv**2
                own = leaf(g, w)
                gain -= g * own - 0.5 * (w + self.smoothing) * own**2
                gain[(ns < self.min_rows) | (len(rows) - ns < self.min_rows) | ((rv - lv) * self.signs[f] < 0)] = -np.inf
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], (f, k, lv[k], rv[k]))
        if best[1] is None:
            score[rows] += nodes["value"][node]
            return node
        f, k, lv, rv = best[1]
        middle, goes_left = (lv + rv) / 2, binned[rows, f] <= k
        bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[self.signs[f]]
        nodes["feature"][node], nodes["threshold"][node] = f, float(edges[f][k])
        nodes["left"][node] = self._grow(binned, edges, gradient, weight, rows[goes_left], score, nodes, depth - 1, *bounds[0])
        nodes["right"][node] = self._grow(binned, edges, gradient, weight, rows[~goes_left], score, nodes, depth - 1, *bounds[1])
        return node

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of the label for each row."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.base + self.value[at].sum(1)


def fit_quality(counts: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", train_rows: int = TRAIN_ROWS) -> BoostedTrees | None:
    """A model from the labelled documents; None without a label.

    At most ``train_rows`` labelled ids are used, those whose hash is least; of
    an id labelled more than once the greatest label counts, of one with
    several texts the least counts. Only ids are ordered, and the driver gets
    the numbers of the sample alone.
    """
    known = labels.where(labels[id_col].isNotNull() & labels[label_col].isNotNull()).groupBy(labels[id_col].alias("_id")).agg(F.max(label_col).alias("_label"))
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(train_rows)
    # At most train_rows rows of two numbers.
    rows = counts.join(F.broadcast(known), counts[id_col] == known["_id"])
    sample = rows.groupBy("_id").agg(F.min("_label").alias("_label"), F.min(F.struct(*COUNTS)).alias("_counts")).orderBy(F.xxhash64("_id"), "_id").select("_label", "_counts.*").toPandas()
    if sample.empty:
        return None
    x = features({c: sample[c].to_numpy() for c in COUNTS})
    return BoostedTrees(tuple(FEATURES.values())).fit(x, (sample["_label"].to_numpy() > 0).astype(float))


def quality_filter(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS, threshold: float = 0.5
) -> DataFrame:
    """One row per input row: ``id_col``, the counts, base_failed, quality_score and kept.

    - Null, empty and wordless text: all counts 0, base_failed, not kept.
    - base_failed: under 50 words, or over half of the words in repeated
      3-word windows. kept: not base_failed, and the model gives the label a
      probability of ``threshold`` or more. Without any label there is no
      model: quality_score is null and only the base rules decide.
    - Repeated rows give repeated rows; an empty table gives an empty table.
    - Other columns are ignored, whatever their names.
    """
    counts = settled(document_counts(docs, id_col, text_col))
    model = fit_quality(counts, labels, id_col, train_rows=train_rows)
    kind = counts.schema[id_col].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in COUNTS}
            failed = (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])
            if model is None:
                score, good = pa.nulls(len(batch), pa.float64()), np.ones(len(batch), bool)
            else:
                p = 1 / (1 + np.exp(-model.score(features(c))))
                score, good = pa.array(p), p >= threshold
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(failed), score, pa.array(~failed & good)], [*batch.schema.names, "base_failed", "quality_score", "kept"])

    schema = f"`{id_col}` {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, quality_score double, kept boolean"
    return counts.mapInArrow(judge, schema)
