"""MinHash near-dedup by improved consistent weighted sampling over TF-IDF shingles.

A document is the weighted set of its distinct runs of five words. A shingle's
weight is its count in the document times an inverse document frequency that
is 1 for shingles in fewer than ``COMMON`` of all documents and falls with the
logarithm of the share above that, down to ``FLOOR``. So passages that many
documents share count less, yet a large group of copies still looks alike.
Only shingles at or over ``COMMON`` need a number, and of these there are at
most (mean shingles of a document) / COMMON, however large the corpus; their
counts are exact.

Texts of equal words, by two hashes, are one node. Distinct texts are sampled
(64 samples in bands of 4), members of a band's bucket are compared, candidates
are verified by the weighted Jaccard similarity of their whole sets, and
connected groups get one class. Crowded buckets of texts that aren't alike, as
those that share a passage, are compared block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from objsql.llm.common import lean, settled, small_side, written
from objsql.llm.grouping import connected_groups, verified_links
from objsql.llm.text_kernel import PUNCT, Run, combine, mix, runs, sequence_hashes

WIDTH, SIMILARITY = 5, 0.8
BANDS, ROWS = 16, 4
COMMON, FLOOR = 0.01, 0.5
#: Shingles that the search for common ones holds at a time.
CHUNK = 2_000_000


def shingles(run: Run, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash and count of each distinct shingle, sorted by text and hash; and a hash of each text's words (0: none).

    A text with words, but fewer than ``width``, has one shingle of all of them.
    """
    starts, ends, owner = run.spans(PUNCT)
    words = run.hashes(starts, ends)
    grams, begins = combine(words, owner, width)
    n_words = np.bincount(owner, minlength=len(run))
    first = np.concatenate([[0], np.cumsum(n_words)])
    content = sequence_hashes(words, first)
    short = np.flatnonzero((n_words > 0) & (n_words < width))
    own = np.concatenate([owner[begins], short])
    grams = np.concatenate([grams, content[short]])
    order = np.argsort((own.astype(np.uint64) << np.uint64(40)) | (grams >> np.uint64(24)), kind="stable")
    own, grams = own[order], grams[order]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (grams[1:] != grams[:-1])
    at = np.flatnonzero(new)
    return own[at], grams[at], np.diff(np.append(at, len(own))), content


def lowered(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column)


class Idf:
    """Weights of shingles; ``hashes`` (sorted) have the given values, all others 1."""

    def __init__(self, hashes: np.ndarray, values: np.ndarray):
        self.hashes, self.values = hashes, values

    def __call__(self, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        weight = counts.astype(np.float64)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, grams), len(self.hashes) - 1)
            known = self.hashes[at] == grams
            weight[known] *= self.values[at[known]]
        return weight


def _runs_of_counts(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])) if len(sorted_values) else np.zeros(0, np.int64)
    return sorted_values[at], np.diff(np.append(at, len(sorted_values)))


def common_shingles(texts: DataFrame, n_docs: int, width: int = WIDTH, common: float = COMMON, floor: float = FLOOR, chunk: int = CHUNK) -> Idf:
    """The weights of shingles in at least ``common`` of the ``n_docs`` rows of ``texts`` (one column: the text).

    A shingle in a share s of all rows is in a share s/2 of the rows of chunks
    that together hold s/2 of its rows at least. So each chunk reports what is
    in ``common``/2 of its own rows, and what was reported for fewer than
    ``common``/2 of all rows can't be common. What remains has at most (mean
    shingles of a row) / (common / 2) members, and is counted exactly.
    """

    def in_order(held: list[np.ndarray]) -> np.ndarray:
        """All numbers sorted, without another copy; the list is emptied."""
        out = np.concatenate(held)
        held.clear()
        out.sort()
        return out

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        held, size, rows = [], 0, 0
        for batch in batches:
            for run in runs(lowered(batch.column(0))):
                _, grams, _, _ = shingles(run, width)
                held.append(grams)
                size, rows = size + len(grams), rows + len(run)
                if size >= chunk:
                    yield *_runs_of_counts(in_order(held)), rows
                    size = rows = 0
        if held:
            yield *_runs_of_counts(in_order(held)), rows

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for values, counts, rows in chunks(batches):
            often = counts >= max(1, common / 2 * rows)
            yield pa.RecordBatch.from_arrays([pa.array(values[often].view(np.int64)), pa.array(counts[often].astype(np.int64))], ["gram", "n"])

    reported = texts.mapInArrow(lean(report, 0), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= common / 2 * n_docs)
    likely = np.sort(np.array([r.gram for r in reported.select("gram").collect()], np.int64).view(np.uint64))
    if not len(likely):
        return Idf(likely, np.zeros(0))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(likely), np.int64)
        for batch in batches:
            for run in runs(lowered(batch.column(0))):
                _, grams, _, _ = shingles(run, width)
                at = np.minimum(np.searchsorted(likely, grams), len(likely) - 1)
                total += np.bincount(at[likely[at] == grams], minlength=len(likely))
        yield pa.RecordBatch.from_arrays([pa.array(likely.view(np.int64)), pa.array(total)], ["gram", "n"])

    rows = texts.mapInArrow(lean(count, 0), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= common * n_docs).collect()
    hashes = np.array([r.gram for r in rows], np.int64).view(np.uint64)
    value = np.clip(np.log(n_docs / np.array([r.n for r in rows], np.float64)) / np.log(1 / common), floor, 1.0)
    order = np.argsort(hashes)
    return Idf(hashes[order], value[order])


class WeightedSampler:
    """Improved consistent weighted sampling.

    For sample k, element h draws r and c from Gamma(2, 1) and b from U(0, 1),
    takes t = floor(ln w / r + b) and ln a = ln c - r (t - b + 1); the element
    with the least a is the sample, together with t. Two sets agree on a sample
    with a probability of their weighted Jaccard similarity. The draws are
    table entries that a hash of element and k picks; elements that share an
    entry are ordered by that hash. For a weight of 1, t is 0 and ln a comes
    from a table as well.
    """

    ENTRIES = 1 << 16

    def __init__(self, samples: int = BANDS * ROWS, seed: int = 7):
        g = np.random.Generator(np.random.PCG64(seed))
        self.samples = samples
        self.r, c = g.gamma(2, 1, self.ENTRIES).astype(np.float32), g.gamma(2, 1, self.ENTRIES)
        self.ln_c, self.b = np.log(c).astype(np.float32), g.random(self.ENTRIES).astype(np.float32)
        self.at_one = self._key(self.ln_c - self.r * (1 - self.b))

    @staticmethod
    def _key(ln_a: np.ndarray) -> np.ndarray:
        """The upper half of a number that sorts as the float does."""
        bits = ln_a.astype(np.float32).view(np.int32)
        return (bits ^ ((bits >> 31) | np.int32(-(2**31)))).view(np.uint32).astype(np.uint64) << np.uint64(32)

    def sample(self, grams: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Samples (sets x samples) as 32-bit codes of element and t; set i has the elements from starts[i] on, one at least."""
        out = np.empty((len(starts), self.samples), np.uint64)
        odd = np.flatnonzero(weights != 1.0)
        ln_w = np.log(weights[odd]).astype(np.float32)
        low = np.uint64(0xFFFFFFFF)
        for k in range(self.samples):
            h = mix(grams + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            entry = (h >> np.uint64(48)).astype(np.int64)
            key = self.at_one[entry] | (h & low)
            if len(odd):
                e = entry[odd]
                t = np.floor(ln_w / self.r[e] + self.b[e])
                code = (h[odd] ^ mix(t.astype(np.int64).view(np.uint64))) & low
                code[t == 0] = (h[odd] & low)[t == 0]
                key[odd] = self._key(self.ln_c[e] - self.r[e] * (t - self.b[e] + 1)) | code
            out[:, k] = np.minimum.reduceat(key, starts) & low
        return out


def _sketches(docs: DataFrame, idf: Idf, width: int, bands: int, rows: int) -> DataFrame:
    """id, content and check (hashes of the words; content null: none), size (weight of the whole set) and one key per band."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = WeightedSampler(bands * rows)
        for batch in batches:
            ids, start = batch.column(0), 0
            for run in runs(lowered(batch.column(1))):
                own, grams, counts, content = shingles(run, width)
                begins = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
                keys = np.zeros((len(run), bands), np.uint64)
                weights = idf(grams, counts)
                size = np.bincount(own, weights, len(run)).astype(np.float64)
                check = np.zeros(len(run), np.uint64)
                if len(own):
                    check[own[begins]] = np.add.reduceat(mix(grams) * counts.astype(np.uint64), begins) >> np.uint64(32)
                    codes = sampler.sample(grams, weights, begins)
                    for band in range(bands):
                        key = np.full(len(begins), band + 1, np.uint64)
                        for column in codes.T[band * rows : (band + 1) * rows]:
                            key = mix(key * np.uint64(0x100000001B3) + column)
                        keys[own[begins], band] = key
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(run) + 1, dtype=np.int32) * bands), pa.array(keys.ravel().view(np.int64)))
                columns = [ids.slice(start, len(run)), pa.array(content.view(np.int64), mask=content == 0), pa.array(check.astype(np.uint32).view(np.int32)), pa.array(size), flat]
                yield pa.RecordBatch.from_arrays(columns, ["id", "content", "check", "size", "bands"])
                start += len(run)

    return docs.mapInArrow(lean(sketch, 1), "id long, content long, check int, size double, bands array<long>")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """id, content, and the distinct shingles and their counts as packed numbers."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, start = batch.column(0), 0
            for run in runs(lowered(batch.column(1))):
                own, grams, counts, content = shingles(run, width)
                cut = np.searchsorted(own, np.arange(len(run) + 1))
                counts = counts.astype(np.uint32)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(start, len(run)), pa.array(content.view(np.int64)), pa.array([grams[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary()), pa.array([counts[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())], ["id", "content", "grams", "counts"]
                )
                start += len(run)

    return docs.mapInArrow(lean(pack, 1), "id long, content long, grams binary, counts binary")


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two weighted sets, each sorted distinct elements and weights."""
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    both = b[0][at] == a[0] if len(b[0]) else np.zeros(len(a[0]), bool)
    x, y = a[1][both], b[1][at[both]] if len(b[0]) else b[1]
    shared = np.minimum(x, y).sum()
    union = a[1].sum() + b[1].sum() - shared
    return float(shared / union) if union else 0.0


#: Members, and bytes of their sets, that a block of a crowded bucket has, about.
BLOCK_ROWS, BLOCK_BYTES = 512, 8 << 20
#: Features of a block that are multiplied at a time.
CHUNK_COLUMNS = 1024


def _pairs_alike(rows: pa.Table, idf: Idf, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows (id, own, apart, block, grams, counts), one of them apart, of different ``own`` and, if there are two blocks, of different ones, that are alike.

    A shingle that a text has n times is n features, so that what two texts
    share is a product of 0/1 matrices, weighted; features of one row alone
    are left out. What comes near is then compared exactly.
    """
    ids, own, apart, block = (rows.column(c).to_numpy() for c in ("id", "own", "apart", "block"))
    sets = []
    for grams, counts in zip(rows.column("grams").to_pylist(), rows.column("counts").to_pylist()):
        grams = np.frombuffer(grams, np.uint64)
        sets.append((grams, np.frombuffer(counts, np.uint32)))
    counts = np.concatenate([c for _, c in sets]).astype(np.int64)
    grams = np.repeat(np.concatenate([g for g, _ in sets]), counts)
    nth = np.arange(len(grams)) - np.repeat(np.cumsum(counts) - counts, counts)
    who = np.repeat(np.repeat(np.arange(len(sets)), [len(g) for g, _ in sets]), counts)
    feature = mix(grams + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(feature, kind="stable")
    feature, grams, who = feature[order], grams[order], who[order]
    begins = np.flatnonzero(np.concatenate([[True], feature[1:] != feature[:-1]]))
    number, often = np.cumsum(np.concatenate([[False], feature[1:] != feature[:-1]])), np.diff(np.append(begins, len(feature)))
    column = np.cumsum(often > 1) - 1
    shared = often[number] > 1
    weight = idf(grams[begins][often > 1], np.ones((often > 1).sum()))
    size = np.array([idf(g, c).sum() for g, c in sets])
    mine = np.flatnonzero(apart)
    row, column = who[shared], column[number[shared]]
    both = np.zeros((len(mine), len(sets)), np.float32)
    for start in range(0, len(weight), CHUNK_COLUMNS):
        within = slice(*np.searchsorted(column, [start, start + CHUNK_COLUMNS]))
        part = np.zeros((len(sets), min(CHUNK_COLUMNS, len(weight) - start)), np.float32)
        part[row[within], column[within] - start] = 1
        both += (part[mine] * weight[start : start + CHUNK_COLUMNS].astype(np.float32)) @ part.T
    union = size[mine][:, None] + size[None, :] - both
    near = (both >= (similarity - 0.01) * union) & (own[mine][:, None] != own[None, :])
    if block.min() != block.max():
        near &= block[mine][:, None] != block[None, :]
    x, y = np.nonzero(near)
    x = mine[x]
    weighed = {int(k): (sets[k][0], idf(*sets[k])) for k in np.unique(np.concatenate([x, y]))}
    keep = np.array([weighted_jaccard(weighed[int(i)], weighed[int(j)]) >= similarity for i, j in zip(x, y)], bool)
    return ids[x[keep]], ids[y[keep]]


def crowded_links(apart: DataFrame, every: DataFrame, sets: DataFrame, idf: Idf, similarity: float) -> DataFrame:
    """Links (a, b), a > b, between members of a bucket that are alike, one of them from ``apart``, of different ``own``; both (key, id, size, own).

    A bucket's members are dealt to blocks, and each two blocks are compared as
    a whole by a task, which gives the links alone. So a task holds two blocks
    however large a bucket is, and no pair is written down that isn't a link.
    """
    packed = F.octet_length("grams") + F.octet_length("counts")
    rows = every.select("key", "id", "own").join(apart.select("key", "id", F.lit(True).alias("apart")), ["key", "id"], "left").withColumn("apart", F.col("apart").isNotNull())
    sized = settled(rows.join(small_side(settled(sets.select("id", packed.cast("long").alias("bytes")))), "id"))
    blocks = sized.groupBy("key").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_ROWS, F.sum("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
    dealt = sized.join(small_side(settled(blocks)), "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.select("key", "id", "own", "apart", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))

    def compare(rows: pa.Table) -> pa.Table:
        x, y = _pairs_alike(rows, idf, similarity) if pc.any(rows.column("apart")).as_py() else (np.zeros(0, np.int64),) * 2
        return pa.table({"a": np.maximum(x, y), "b": np.minimum(x, y)})

    whole = dealt.join(small_side(sets.select("id", "grams", "counts")), "id")
    return whole.groupBy("key", "low", "high").applyInArrow(compare, "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS, common: float = COMMON, floor: float = FLOOR
) -> DataFrame:
    """One row per document: ``id_col`` and class_id, the least id of its group of near-duplicates.

    - Words are runs of characters other than white space and ASCII
      punctuation, in lower case. Texts with equal words are always one class;
      others when linked, maybe through others, by a weighted Jaccard
      similarity of ``similarity`` or more.
    - Null, empty and wordless texts are each a class of their own.
    - A repeated id counts as one document; it belongs to the classes of all
      its texts, which thereby are one. Rows with a null id are ignored.
    - Ties: the least id names the class. An empty table gives an empty table.
    - Other columns are ignored, whatever their names. Ids must be integers.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    plain = docs.where(docs[id_col].isNotNull()).select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    texts = plain.where("text <> ''")
    idf = common_shingles(texts.select("text"), texts.count(), width, common, floor)
    sketches = written(_sketches(texts, idf, width, bands, rows).where("content is not null"), "sketches")

    # Texts with equal words have equal sketches; the least id stands for them.
    same = ["content", "check"]
    heads = written(sketches.groupBy(*same).agg(F.min("id").alias("head"), F.max("size").alias("size"), F.first("bands").alias("bands")), "heads")
    members = heads.select(F.col("head").alias("id"), "size", F.explode("bands").alias("key"))
    met = settled(members.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high").select("key"))
    members = settled(members.join(small_side(met), "key").select("key", "id", "size"))
    wanted = settled(members.select("id").distinct())
    sets = _sets(texts.join(small_side(wanted), "id", "left_semi"), width)
    # Of an id with several texts, the text that it stands for.
    sets = written(sets.join(heads.select(F.col("head").alias("id"), "content"), ["id", "content"], "left_semi").dropDuplicates(["id", "content"]), "sets")

    def verify(pairs: DataFrame) -> DataFrame:
        a = sets.select(F.col("id").alias("a"), F.col("grams").alias("a_grams"), F.col("counts").alias("a_counts"))
        b = sets.select(F.col("id").alias("b"), F.col("grams").alias("b_grams"), F.col("counts").alias("b_counts"))

        def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.zeros(len(batch), bool)
                for n in range(len(batch)):
                    both = []
                    for side in (2, 4):
                        grams = np.frombuffer(batch.column(side)[n].as_buffer(), np.uint64)
                        both.append((grams, idf(grams, np.frombuffer(batch.column(side + 1)[n].as_buffer(), np.uint32))))
                    keep[n] = weighted_jaccard(*both) >= similarity
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

        return pairs.join(b, "b").join(a, "a").select("a", "b", "a_grams", "a_counts", "b_grams", "b_counts").mapInArrow(lean(hold), "a long, b long")

    def crowded(apart: DataFrame, every: DataFrame) -> DataFrame:
        return crowded_links(apart, every, sets.join(small_side(settled(every.select("id").distinct())), "id", "left_semi"), idf, similarity)

    links = verified_links(members, verify, similarity - 1e-6, crowded)
    # An id with several texts links their heads.
    repeated = sketches.groupBy("id").agg(F.min("content").alias("x"), F.max("content").alias("y")).where("x <> y").select("id")
    own = sketches.select("id", *same).join(heads.select(*same, "head"), same).select("id", "head")
    links = links.union(own.join(repeated, "id").where("id <> head").select(F.col("id").alias("a"), F.col("head").alias("b")))
    groups = connected_groups(links)
    classed = own.join(groups.withColumnRenamed("id", "head"), "head", "left").select("id", F.coalesce("root", "head").alias("class"))
    # Wordless documents have no sketch.
    lone = plain.select("id", F.col("id").alias("class"))
    found = classed.union(lone).groupBy("id").agg(F.min("class").alias("class"))
    return found.select(F.col("id").cast(kind).alias(id_col), F.col("class").cast(kind).alias("class_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose document names its class: one document of each group stays, with all its columns.

    Rows with a null id stay. Of a repeated id all rows stay or go.
    """
    gone = near_duplicates(docs, id_col, text_col, **options).where(F.col(id_col) != F.col("class_id")).select(F.col(id_col).alias("_gone"))
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
