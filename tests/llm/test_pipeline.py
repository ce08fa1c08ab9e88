import hashlib

import public_tokenizers as P
import pytest

from objsql.llm.byte_bpe import load_ranks

pipeline = pytest.importorskip("corpus_pipeline")


def prose(seed, n):
    """Words that no other seed has."""
    return " ".join(f"w{chr(97 + seed % 26)}{chr(97 + seed // 26)}x{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    item = prose(500, 30)
    rows = [(i, prose(i, 40) + (" you utter idiot and scum" if i % 5 == 0 else ""), "en", "s", 1) for i in range(60)]
    base = prose(300, 80)
    shared = prose(400, 60)
    rows += [
        (100, base, "en", "s", len(base)), (101, base, "en", "s", len(base)),  # an exact copy
        (102, base + " tail\nand a line of its own here", "en", "s", 1),  # a near copy of the line, and a line
        (103, "Start of it.\n" + item + "\nend of it.", "en", "s", 1),  # holds a benchmark item
        (104, shared + "\n" + prose(401, 30), "en", "s", 1), (105, prose(402, 30) + "\n" + shared, "en", "s", 1),  # share a line
        (106, None, "en", "s", 0), (107, "", "en", "s", 0), (108, prose(403, 60), "fr", "s", 1), (109, prose(403, 30) + "\n" + prose(404, 30), "fr", "s", 1),
    ]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_each_stage_takes_effect(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    kept = {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, tables)
        if name != "byte_bpe":
            assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        docs = spark.createDataFrame(out.collect(), out.schema)
        kept[name] = {r.doc_id: r for r in docs.collect()}
    toxic = {i for i in range(0, 60, 5)}
    assert not toxic & set(kept["toxicity"]) and len(kept["toxicity"]) == 48 + 10
    lines = kept["line_dedup"]
    assert 101 not in lines and lines[105].text == prose(402, 30) and lines[104].text == prose(400, 60) + "\n" + prose(401, 30)
    assert lines[105].n_chars == len(lines[105].text) and lines[106].text is None and lines[107].text == ""
    assert set(kept["near_dedup"]) <= set(lines) and set(kept["near_dedup"]) >= set(range(1, 60)) - toxic
    assert set(kept["near_dedup"]) - set(kept["decontamination"]) == {103}
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    assert set(kept["byte_bpe"]) == set(kept["decontamination"])
    for i, r in kept["byte_bpe"].items():
        text = kept["decontamination"][i].text or ""
        packed = b"".join(x.to_bytes(4, "little") for x in library.encode_ordinary(text))
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_run_gives_the_last_stage(spark, tables):
    assert pipeline.run(spark, tables).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _n_dropped string, id long, key string"


def test_edge_cases_of_every_stage(spark, tables):
    """Null ids and texts, repeated rows, very long texts and columns of clashing names go through; empty tables stay empty."""
    long = prose(600, 200) + "\n" + " ".join(f"long{chr(97 + k % 26)}{k}" for k in range(60_000))
    rows = [(1, None), (2, ""), (None, prose(601, 40)), (None, None), (3, prose(602, 40)), (3, prose(602, 40)), (4, long), (5, "?!"), (6, prose(603, 50))]
    docs = spark.createDataFrame([(i, t, None, None, None, "n", 9, "k") for i, t in rows], SCHEMA)
    want = sorted(rows, key=repr)
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, tables)
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes), name
        assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == want, name
        assert {(r._n_dropped, r.id, r.key) for r in out.collect()} == {("n", 9, "k")}, name
        assert stage(spark, docs.limit(0), tables).count() == 0, name
    _, encode = pipeline.STAGES[-1]
    assert encode(spark, docs, tables).count() == len(rows) and encode(spark, docs.limit(0), tables).count() == 0


def test_run_equals_its_stages_by_brute_force(spark, tables):
    """What run() gives, from plain Python: the documents left, their texts and their tokens."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    item = prose(500, 30)
    left = {i: t for i, t in docs.items() if not (t or "").endswith("you utter idiot and scum")}
    seen, kept = {}, {}
    for i in sorted(left):
        lines = []
        for line in (left[i] or "").split("\n"):
            words = line.lower().split()
            # The table's only near copy of a line has a word more at its end.
            if words and (tuple(words) in seen or tuple(words[:-1]) in seen):
                continue
            seen[tuple(words)] = i
            lines.append(line)
        text = None if left[i] is None else "\n".join(lines)
        if left[i] in (None, "") or text.strip():
            kept[i] = text
    want = {i: t for i, t in kept.items() if item not in (t or "")}
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    got = {r.doc_id: (r.n_tokens, r.decoded_sha256) for r in pipeline.run(spark, tables).collect()}
    assert got == {i: (len(library.encode_ordinary(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in want.items()}
