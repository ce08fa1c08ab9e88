import re
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from objsql.llm.line_dedup import block_hashes, dedup_lines, distinct_words, edits_within
from objsql.llm.text_kernel import PUNCT, runs
from tests.llm.test_near_dedup import roots


def word_hash(word):
    run = next(runs(pa.array([word])))
    starts, ends, _ = run.spans(PUNCT)
    return int(run.hashes(starts, ends)[0])


def brute_meets(words):
    """The meeting places of a line, from their definition."""
    out = set()
    for least, most, (blocks, agree, bits) in ((1, 20, (4, 2, 24)), (16, 50, (4, 1, 32)), (40, 100, (6, 1, 32)), (80, 200, (10, 1, 32)), (160, None, (16, 1, 32))):
        if len(set(words)) < least or most and len(set(words)) > most:
            continue
        code, count, weight = {}, Counter(), Counter()
        features = []
        for w in set(words):
            h = word_hash(w)
            features.append(((h >> 32) * blocks >> 32, h, min(len(w), 16)))
        for block in range(blocks):
            own = [(f, x) for b, f, x in features if b == block]
            count[block], weight[block] = len(own), sum(x for _, x in own)
            code[block] = sum((2 * sum(x for f, x in own if f >> bit & 1) > sum(x for _, x in own)) << bit for bit in range(bits))
        for chosen in combinations(range(blocks), agree):
            if sum(count[b] for b in chosen) >= min(2, len(set(words))) and sum(weight[b] for b in chosen) * blocks >= 0.5 * agree * sum(weight.values()):
                out.add((blocks, chosen, tuple(code[b] for b in chosen)))
    return out


def words_of(line, digits=False):
    return re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", line.lower() if digits else re.sub("[0-9]", "0", line.lower()))


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
    return row[-1]


def brute(rows, min_words=5, similarity=0.8):
    seen, first = [], {}
    for doc, text in rows:
        for n, line in enumerate((text or "").split("\n")):
            words = tuple(words_of(line))
            if len(words) < min_words:
                words = tuple(words_of(line, digits=True))
            if words:
                seen.append((doc, n, words))
                first[words] = min(first.get(words, (doc, n)), (doc, n))
    meets = {w: brute_meets(w) if len(w) >= min_words else set() for w in first}
    order = {w: k for k, w in enumerate(sorted(first))}
    links = []
    for a in order:
        for b in order:
            if order[a] > order[b] and meets[a] & meets[b]:
                x, y = " ".join(a), " ".join(b)
                if 1 - edit(x, y) / max(len(x), len(y)) >= similarity:
                    links.append((order[a], order[b]))
    root = roots(order.values(), links)
    kept = {}
    for w, at in first.items():
        g = root[order[w]]
        kept[g] = min(kept.get(g, at), at)
    gone = {(doc, n) for doc, n, w in seen if kept[root[order[w]]] != (doc, n)}
    return {doc: None if text is None else "\n".join(x for n, x in enumerate(text.split("\n")) if (doc, n) not in gone) for doc, text in rows}, len(links)


LONG = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400))
ROWS = [
    (1, None), (2, ""), (3, "short line\nshort line\n?!\n?!\nitem 1\nitem 2\nItem 1."), (4, "One two three four five, 17!\nfresh words that no one else has\n"), (5, "one TWO three-four five 99"), (6, "\n\none two three four five 11\n\n"),
    (7, LONG), (8, LONG + " tail"), (9, LONG.replace("wordbb", "wordzz")), (10, "a completely different line of words here"), (-1, "a completely different line of words here\ntail stays"),
    (12, "è é ê ë ü ö line\r\nè é ê ë ü ö line"), (13, LONG[::-1]), (14, LONG + " tail\nsomething else altogether in this one"),
]


def test_matches_brute_force(spark):
    want, links = brute(ROWS)
    assert links >= 2
    df = spark.createDataFrame([(i, t, "k", 3) for i, t in ROWS], "doc_id long, text string, key string, id int").repartition(3)
    out = dedup_lines(df, count_col="n")
    assert out.columns == [*df.columns, "n"]
    rows = out.collect()
    assert {r.doc_id: r.text for r in rows} == want and len(rows) == len(ROWS)
    assert all(r.n == len((dict(ROWS)[r.doc_id] or "").split("\n")) - len(r.text.split("\n")) for r in rows if r.text)


def test_real_documents_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 1500")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want, _ = brute(rows)
    got = {r.doc_id: r.text for r in dedup_lines(docs).collect()}
    assert got == want and any(a != dict(rows)[d] for d, a in got.items())


def test_edge_cases(spark):
    rows = [(None, "five words are in this line\nfive words are in this line"), (1, "five words are in this line\nfive words are in this line"), (1, "five words are in this line\nfive words are in this line"), (2, "five words are in this line")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.text) for r in dedup_lines(df).collect())
    assert got == [("1", "five words are in this line")] * 2 + [("2", ""), ("None", rows[0][1])]
    assert dedup_lines(df.where(F.lit(False))).count() == 0
    named = df.selectExpr("doc_id", "text", "1 as number", "text as gone", "2 as n")
    assert dedup_lines(named, count_col="n").columns == ["doc_id", "text", "number", "gone", "n"]
    huge = df.selectExpr("doc_id * (1L << 60) as doc_id", "text")
    assert sorted(r.text for r in dedup_lines(huge).collect()) == sorted(r.text for r in dedup_lines(df).collect())
    versions = spark.createDataFrame([(1, "one\nthe same"), (1, "two\nthe same"), (0, "two")], "doc_id long, text string")
    assert sorted(r.text for r in dedup_lines(versions).collect()) == ["one\nthe same", "the same", "two"]


def test_links_through_permutations(spark):
    """Many lines with the same words meet in all blocks; those alike must be found whichever represents them."""
    g = np.random.Generator(np.random.PCG64(5))
    words = [f"{a}{b}word" for a in "abcdefg" for b in "xyz"]
    swapped = words[:2] + [words[3], words[2]] + words[4:]
    rows = [(k, " ".join(g.permutation(words))) for k in range(40)] + [(100, " ".join(words)), (101, " ".join(swapped))]
    rows += [(200 + k, " ".join(g.permutation(words)[:20])) for k in range(20)]
    want, links = brute(rows)
    assert links >= 1 and want[101] == ""
    assert {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want


def test_recall_of_edit_similarity(spark):
    """Share of all pairs of different lines with an edit similarity of 0.8 or more that end in one group, by brute force on edit similarity alone."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    g = np.random.Generator(np.random.PCG64(6))
    lines = list(dict.fromkeys(" ".join(words_of(x)) for _, t in rows for x in (t or "").split("\n") if 5 <= len(words_of(x)) <= 120))[:150]
    edited = []
    for line in lines:
        words = line.split()
        for _ in range(max(1, len(words) // 12)):
            words[int(g.integers(len(words)))] = "changed" + chr(97 + int(g.integers(26)))
        edited.append(" ".join(words))
    pairs = [(a, b) for a, b in zip(lines, edited) if a != b and 1 - edit(a, b) / max(len(a), len(b)) >= 0.8]
    got = dedup_lines(spark.createDataFrame([(k, t) for k, t in enumerate([x for p in pairs for x in p])], "doc_id long, text string"), count_col="n")
    gone = {r.doc_id for r in got.where("n > 0").collect()}
    share = sum(2 * k + 1 in gone for k in range(len(pairs))) / len(pairs)
    print("recall", share, "of", len(pairs))
    assert len(pairs) > 80 and share >= 0.85


def test_block_hashes_of_long_lines():
    g = np.random.Generator(np.random.PCG64(5))
    sizes = [1, 3, 255, 40_000, 2]
    hashes = g.integers(0, 1 << 63, sum(sizes), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    hashes[300:400] = hashes[300]
    lengths = g.integers(1, 30, len(hashes))
    lengths[300:400] = 7
    firsts = np.concatenate([[0], np.cumsum(sizes)])
    codes, counts, weights = block_hashes(*distinct_words(hashes, lengths, firsts), 4, 32)
    for k in range(len(sizes)):
        h, at = np.unique(hashes[firsts[k] : firsts[k + 1]], return_index=True)
        weight = np.minimum(lengths[firsts[k] : firsts[k + 1]], 16).astype(np.int64)[at]
        block, feature = ((h >> np.uint64(32)) * np.uint64(4)) >> np.uint64(32), h
        for b in range(4):
            own = block == b
            votes = [weight[own] @ ((feature[own] >> np.uint64(bit)) & np.uint64(1)).astype(np.int64) for bit in range(32)]
            assert counts[k, b] == own.sum() and weights[k, b] == weight[own].sum()
            assert int(codes[k, b]) == sum(int(2 * v > weight[own].sum()) << bit for bit, v in enumerate(votes))


def test_edits_within():
    g = np.random.Generator(np.random.PCG64(5))
    pairs = []
    for _ in range(2000):
        x = "".join(g.choice(list("ab ü"), int(g.integers(0, 12))))
        pairs.append((x, "".join(g.choice(list("ab ü"), int(g.integers(0, 12)))) if g.random() < 0.5 else "".join(c for c in x if g.random() < 0.8)))
    for size in (60, 64, 65, 130, 400):
        for share in (0.3, 0.75, 0.8, 0.85, 0.9):
            x = "".join(g.choice(list("abcdefgh "), size))
            pairs.append((x, "".join(c if g.random() < share else g.choice(["z", "", "ab"]) for c in x)))
    x, y = [p[0] for p in pairs], [p[1] for p in pairs]
    distance = np.array([edit(*p) for p in pairs])
    longer = np.array([max(len(a), len(b)) for a, b in pairs])
    for similarity in (0.3, 0.5, 0.8, 0.9, 1.0):
        want = distance <= np.floor((1 - similarity) * longer + 1e-9)
        assert (edits_within(x, y, similarity) == want).all()
    assert edits_within([], [], 0.8).tolist() == []
    assert edits_within(["".join(map(chr, range(0x4E00, 0x4E00 + 3000)))], ["".join(map(chr, range(0x5E00, 0x5E00 + 3000)))], 0.8).tolist() == [False]


def test_texts_are_cut_without_python(spark):
    """Lines go, the first and the last and empty ones included, by Spark's own functions: texts aren't sent through Python for it."""
    rows = [(1, "alpha beta\n\ngamma \u00e9t\u00e9\n"), (2, "\nalpha beta\nown line\n\nALPHA, beta"), (3, "alpha beta"), (4, "gamma \u00e9t\u00e9\n"), (5, None), (6, ""), (7, "\n".join(f"line of {chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)) + "\nalpha beta\n\nend")]
    out = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), count_col="n")
    assert "MapInArrow" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.doc_id: (r.text, r.n) for r in out.collect()}
    assert got[1] == (rows[0][1], 0) and got[2] == ("\nown line\n", 2) and got[3] == ("", 1)
    assert got[4] == ("", 1) and got[5] == (None, 0) and got[6] == ("", 0)
    assert got[7] == (rows[6][1].replace("\nalpha beta", ""), 1)
