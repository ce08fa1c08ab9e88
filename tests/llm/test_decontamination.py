from collections import defaultdict

import regex
from pyspark.sql import functions as F

from objsql.llm.decontamination import COVERAGE, MOST_SLOTS, UNITS, WINDOW, decontamination, drop_contaminated, tokens


def brute_tokens(text):
    text = regex.sub("[\x01-\x06]", " ", text or "")
    text = regex.sub(r"(?<=[\p{L}\p{N},;] )(?=\p{Lu})", "\x02", text)
    text = regex.sub(r"(?<=[0-9])[.,](?=[0-9])", "\x06", text)
    text = regex.sub("[0-9][0-9\x06]*", " \x03\\g<0> ", text)
    text = regex.sub(rf"(?i)(?<=[0-9] ) ?(?=(?:{'|'.join(UNITS)})(?![\p{{L}}\p{{M}}\p{{N}}]))", " \x04", text)
    return [w for w in regex.split("[^\\p{L}\\p{M}\\p{N}\x02\x03\x04\x06]+", text.lower()) if w]


def brute(docs, items):
    cut = lambda w: w[0] if w < "\x05" else w
    spans = lambda ws: [(tuple(map(cut, ws[k : k + WINDOW])), tuple(ws[k : k + WINDOW])) for k in range(len(ws) - WINDOW + 1)]
    out = {}
    asked = {i: [(t, r) for t, r in spans(brute_tokens(text)) if sum(w < "\x05" for w in t) <= MOST_SLOTS] for i, text in items}
    for doc, text in docs:
        given = defaultdict(list)
        for t, r in spans(brute_tokens(text)):
            given[t].append(r)
        found = []
        for i, own in asked.items():
            n, shared = len({t for t, _ in own}), {t for t, _ in own if t in given}
            if own and len(shared) >= COVERAGE * n:
                exact = len({t for t, r in own if r in given[t]}) / n
                slots = {(x, y) for t, r in own for g in given[t] for x, y in zip(r, g) if x < "\x05"}
                fine = len(slots) == len({x for x, _ in slots}) == len({y for _, y in slots})
                if fine or exact >= COVERAGE:
                    found.append((-len(shared) / n, i, exact))
        out[doc] = (len(found), *(min(found)[1:2] if found else (None,)))
    return out


QUESTION = "The farmer Tom has 12 apples and sells 5 kg of pears to Ann, who then gives 12 apples back to Tom for the market of the 3rd day in town."
ITEMS = [(1, QUESTION), (2, "too short"), (3, None), (4, "1 2 3 4 5 6 7 8 9 10 11 12"), (5, "plain words only here without any slots at all in the whole long item of the benchmark")]
DOCS = [
    (1, None), (2, ""), (3, "Before. " + QUESTION + " After."), (4, QUESTION.replace("Tom", "Bill").replace("12", "3,400.5").replace("Ann", "Zoë").replace("kg", "miles")),
    (5, QUESTION.replace("12", "7", 1)), (6, "9 8 7 6 5 4 3 2 1 0 9 8 7 6"), (7, "x y z " * 9000), (8, "plain words only here without any slots at all in the whole other text of a page"),
    (9, QUESTION.replace("Tom", "Ann", 1)), (12, QUESTION.replace("Tom has 12", "Bob has 7").replace("5 kg", "6 g").replace("to Ann", "to Eve").replace("3rd", "8th")), (10, QUESTION.upper()), (10, "twice"), (11, "nothing to see here but words that go on for a while, more than eight"),
]


def test_tokens(spark):
    texts = [t for _, t in [*DOCS, *ITEMS] if t] + ["é È È, È x86 5km 5.5KM 1,2,3 \x03 4 m/s", "12 h. 3 Cents"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r.w for r in df.select(tokens(F.col("text")).alias("w")).collect()] == [brute_tokens(t) for t in texts]


def test_matches_brute_force(spark):
    docs = spark.createDataFrame([(*d, "z", 1) for d in DOCS], "doc_id long, text string, item string, n int").repartition(3)
    items = spark.createDataFrame([*ITEMS, ITEMS[0]], "item_id long, text string")
    got = {r.doc_id: (r.n_items, r.best_item) for r in decontamination(docs, items).collect()}
    want = {**brute(DOCS, ITEMS), 10: max(brute([d], ITEMS)[10] for d in DOCS if d[0] == 10)}
    assert got == want
    assert got[4][0] and not got[12][0]
    left = drop_contaminated(docs, items)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {d for d in got if not got[d][0]}


def test_real_documents_match_brute_force(spark):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], [(r.item_id, r.text) for r in items.collect()])
    got = {r.doc_id: (r.n_items, r.best_item) for r in decontamination(docs, items).collect()}
    assert got == want and sum(n > 0 for n, _ in got.values()) > 5


def test_empty_tables_and_null_ids(spark):
    docs = spark.createDataFrame([(None, QUESTION), (1, QUESTION)], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert [tuple(r) for r in decontamination(docs, items.limit(0)).collect()] == [(1, False, 0, None, 0.0, 0.0)]
    assert decontamination(docs.limit(0), items).count() == 0
    assert [r.doc_id for r in drop_contaminated(docs, items).collect()] == [None]


BOXES = "The old shop keeps 3 large wooden boxes of 3 red apples near the door and sells 12 of them before the evening bell rings loudly."


def boxes(a, b, c):
    return BOXES.replace("3", str(a), 1).replace("of 3", f"of {b}").replace("12", str(c))


def test_slots_are_judged_by_occurrence_and_place(spark):
    other = QUESTION.replace("Tom has 12", "Bob has 7").replace("5 kg", "6 g").replace("to Ann", "to Eve").replace("3rd", "8th")
    named = [QUESTION.replace("Tom", a).replace("Ann", b).replace("12", n).replace("5 kg", "6 g") for a, b, n in (("Bill", "Zoe", "7"), ("Carl", "Eve", "15"))]
    texts = [
        f"{boxes(7, 7, 20)} Some words between. {boxes(15, 15, 30)}", boxes(4, 5, 4), " and so on. ".join(named), " ".join(boxes(n, n + 1, n + 2).replace("near", "very near") for n in (20, 40, 60)),
        f"{other} Then again. {other}", boxes(3, 3, 12).replace("wooden", "steel").replace("door", "gate").replace("sells", "buys"),
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(1, QUESTION), (2, BOXES)], "item_id long, text string")
    got = {r.doc_id: r.best_item for r in decontamination(docs, items).collect()}
    assert got == {0: 2, 1: 2, 2: 1, 3: 2, 4: None, 5: None}


def test_short_items_and_windows_of_placeholders_match_word_for_word(spark):
    sums = "Solve 3 x 4 + 5 x 6 - 7 + 8 x 9 - 10 x 11"
    mixed = "count the seven old wooden houses down there 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19 20 21 22 23 24 25 26 27 28 29"
    items = spark.createDataFrame([(1, sums), (2, "who wrote that book"), (3, mixed), (4, "")], "item_id long, text string")
    texts = [f"Now we read and {sums} or so.", sums.replace("3", "30").replace("6", "60").replace("9", "90"), "Tell me: Who wrote that book?", "who wrote that old book", mixed[45:], "nothing of the kind", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.contaminated, r.best_item) for r in decontamination(docs, items).collect()}
    assert got == {0: (True, 1), 1: (False, None), 2: (True, 2), 3: (False, None), 4: (True, 3), 5: (False, None), 6: (False, None)}
    assert {r.doc_id for r in drop_contaminated(docs, items).collect()} == {1, 3, 5, 6}
