import re

from pyspark.sql import functions as F

from objsql.llm.pii import ANY, HINT, dictionary, luhn_valid, replace_pii, spans

ROWS = [
    (1, None), (2, ""), (3, "Write to ann.lee@mail.example.com or ANN.LEE@mail.example.com, from 10.0.0.1!"), (4, "ann.lee@mail.example.com again; 4111 1111 1111 1111 and 4111111111111112."),
    (5, "Mr. John Smith met Mrs. Smith and Dr Braun; Frau Müller-Lüdenscheid called +49 (30) 555-3824, not (212) 555-0100."), (6, "г-н Иванов и Ольга Петрова"), (7, "key b44e15e09fd311c3cf3163b66d5a9875b883d8ce"),
    (8, "nothing, really: 12 of 345 and 6.7.8"), (8, "10.0.0.1"), (None, "10.0.0.1 here"), (9, "10.0.0.1" + " 10.0.0.2" * 500 + " " + "w " * 30000 + "10.0.0.1"), (10, "MRS. SMITH? Mrs. SMITH."),
]


def digits(s):
    return [int(c) for c in s if c.isdigit()]


def valid(s):
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits(s)))) % 10 == 0


def test_surrogates(spark):
    df = spark.createDataFrame([(*r, "s", 1) for r in ROWS], "doc_id long, text string, span string, id int")
    out = replace_pii(df, "secret", count_col="n")
    assert out.columns == [*df.columns, "n"]
    rows = out.collect()
    assert len(rows) == len(ROWS)
    new = {(r.doc_id, (r.text or "")[-8:] if r.doc_id == 8 else ""): r for r in rows}
    text = {k[0]: r.text for k, r in new.items() if k[0] != 8}
    assert text[1] is None and text[2] == "" and new[8, "nd 6.7.8"].text == ROWS[7][1] and new[8, "nd 6.7.8"].n == 0
    mail = re.findall(r"\S+@\S+\w", text[3])
    assert mail[0] == re.findall(r"\S+@\S+\w", text[4])[0] and mail[0] != "ann.lee@mail.example.com"
    assert re.fullmatch(r"[a-z]{3}\.[a-z]{3}@[a-z]{4}\.[a-z]{7}\.com", mail[0]) and re.fullmatch(r"[A-Z]{3}\.[A-Z]{3}@[a-z]{4}\.[a-z]{7}\.com", mail[1])
    ip = re.search(r"\d+\.\d+\.\d+\.\d+", text[3])[0]
    assert text[None] == f"{ip} here" and ip != "10.0.0.1" and text[9].startswith(ip + " ") and text[9].endswith(" " + ip)
    other = set(re.findall(r"\d+\.\d+\.\d+\.\d+", text[9])) - {ip}
    assert len(other) == 1 and other != {"10.0.0.2"} and next(r.n for r in rows if r.doc_id == 9) == 502
    cards = re.search(r"; (\d{4} \d{4} \d{4} \d{4}) and (\d{16})\.", text[4])
    assert valid(cards[1]) and not valid(cards[2]) and cards[1].replace(" ", "") != "4111111111111111"
    john = re.fullmatch(r"Mr\. (\w+) (\w+) met Mrs\. (\w+) and Dr (\w+); Frau (\S+) called \+49 \(\d\d\) \d{3}-\d{4}, not \(\d{3}\) \d{3}-\d{4}\.", text[5])
    assert john and john[2] == john[3] and len({john[1], john[2], john[4], "John", "Smith"}) == 5
    assert re.fullmatch(r"г-н [А-Я][а-я]+ и [А-Я][а-я]+ [А-Я][а-я]+", text[6])
    assert re.fullmatch(r"key [0-9a-f]{40}", text[7]) and text[7] != ROWS[6][1]
    smith = john[2].upper()
    assert text[10] == f"MRS. {smith}? Mrs. {smith}."
    again = {r.doc_id: r.text for r in replace_pii(df.repartition(2), "secret").collect()}
    assert all(again[d] == t for d, t in text.items())
    assert {r.doc_id: r.text for r in replace_pii(df, "other key").collect()}[3] != text[3]
    assert replace_pii(df.where(F.lit(False)), "k").count() == 0


def test_collisions_are_resolved(spark):
    values = [("ip", f"10.0.{i // 250}.{i % 250}") for i in range(2000)] + [("surname", f"name{chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(600)] + [("phone", f"{i:03d}5550000") for i in range(50)]
    # Every number of its shape is an entity, and every letter.
    values += [("phone", f"+49{i:02d}") for i in range(100)] + [("given", c) for c in "用户例子"] + [("email", f"{c}@b.cd") for c in "abcdefghijklmnopqrstuvwxyz"]
    got = dictionary(spark.createDataFrame(values, "kind string, value string"), "k").collect()
    assert len(got) == len(values)
    for kinds in (("ip",), ("surname", "given"), ("phone",), ("email",)):
        new = [r.surrogate for r in got if r.kind in kinds]
        assert len(set(new)) == len(new) and not set(new) & {r.value for r in got if r.kind in kinds}
    assert all(r.surrogate.startswith("+49") for r in got if r.value.startswith("+49"))


def replaced(spark, *texts):
    rows = replace_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "secret").collect()
    return [r.text for r in sorted(rows)]


def test_any_script_gets_surrogates(spark):
    texts = ["write 用户@例子.公司 now", "Mr Արամ came", "ёлка@почта.рф", "Dr Ωμέγα", "mail Ꮳꮃ@ex.org", "Herr Łukasz", "kim@ñandú.es"]
    for old, new in zip(texts, replaced(spark, *texts)):
        for a, b in zip(re.findall(r"\w+", old), re.findall(r"\w+", new)):
            kept = a in ("write", "now", "Mr", "came", "Dr", "mail", "Herr", "公司", "рф", "org", "es")
            assert (a == b) == kept, (old, new)
            assert kept or not set(a) & set(b) - set("abcdefghijklmnopqrstuvwxyzабвгдежзиклмнопрстуфхцчшэюя")
    armenian = replaced(spark, "Mr Արամ came")[0].split()[1]
    assert all("\u0531" <= c <= "\u0586" for c in armenian) and armenian[0].isupper() and armenian[1:].islower()


def test_spellings_of_one_entity(spark):
    a, b, c = replaced(spark, "Mr Smith went. Mr Smith's dog. Mr SMITH. Smith's and SMITH'S, not Smithy. MR SMITH", "a.b@x.com and A.B@X.com and A.B@X.COM", "+49 30 1234567 or +49-30-1234567, +4930 123 4567; 4111 1111 1111 1111, 4111-1111-1111-1111")
    name = a.split()[1].rstrip(".")
    assert name != "Smith" and a == f"Mr {name} went. Mr {name}'s dog. Mr {name.upper()}. {name}'s and {name.upper()}'S, not Smithy. MR {name.upper()}"
    mail = b.split()[0]
    assert b == f"{mail} and {mail[:3].upper()}@{mail[4].upper()}{mail[5:]} and {mail.upper()}"
    phones, cards = re.findall(r"\+[\d -]+\d", c), c.split("; ")[1].split(", ")
    assert len({re.sub(r"\D", "", p) for p in phones}) == 1 and all(p.startswith("+49") for p in phones) and [len(p) for p in phones] == [14, 14, 14]
    assert cards[0].replace(" ", "-") == cards[1] != "4111-1111-1111-1111"


def test_words_of_a_person_alone(spark):
    a, b, c = replaced(spark, "Mr John Smith. Later John said to Smith: Johnson is no Smith-like; JOHN.", "John and Smith are in no name here", "Dr John came, and John")
    words = re.fullmatch(r"Mr (\w+) (\w+)\. Later (\w+) said to (\w+): Johnson is no (\w+)-like; (\w+)\.", a)
    assert words[1] == words[3] != "John" and words[2] == words[4] == words[5] != "Smith" and words[6] == words[1].upper()
    assert b == "John and Smith are in no name here" and c == f"Dr {words[1]} came, and {words[1]}"


def test_surrogates_against_a_plain_model(spark):
    """The texts of a small corpus, replaced by a dictionary in plain Python made of the entities' surrogates."""
    docs = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    new = replaced(spark, *docs)
    import regex

    pattern, pairs = regex.compile(ANY), {}
    for old, got in zip(docs, new):
        mine, its = [m[0] for m in pattern.finditer(old)], pattern.split(old)
        if "".join(its) == old or not mine:
            continue
        rest = got
        for piece, entity, after in zip(its, mine, its[1:]):
            assert rest.startswith(piece)
            rest = rest[len(piece) :]
            end = rest.index(after) if after else len(rest)
            pairs.setdefault(entity, set()).add(rest[:end])
            rest = rest[end:]
        assert rest == its[-1]
    assert pairs and all(len(v) == 1 for v in pairs.values())
    assert len({next(iter(v)).lower() for v in pairs.values()}) == len({k.lower() for k in pairs})


def test_luhn(spark):
    df = spark.createDataFrame([("4111 1111 1111 1111",), ("4111111111111112",), ("0",), ("18",)], "v string")
    assert [r.x for r in df.select(luhn_valid(F.col("v")).alias("x")).collect()] == [True, False, True, True]


def test_real_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = replace_pii(docs, "k", count_col="n").select("doc_id", F.col("text").alias("new"), "n").join(docs.select("doc_id", "text"), "doc_id").collect()
    assert len(rows) == docs.count()
    import regex

    pattern = regex.compile(ANY.replace(r"\p{IsLatin}", r"\p{Latin}"))
    alone = 0
    for r in rows:
        spans = [m[0] for m in pattern.finditer(r.text)]
        assert len(spans) <= r.n and (r.new == r.text) == (not spans)
        alone += r.n - len(spans)
        if len(spans) == r.n:
            assert [p for p in pattern.split(r.text)] == [p for p in pattern.split(r.new)]
        assert not any(s in r.new for s in spans)
    assert alone < 50


def test_the_hint_holds_wherever_a_pattern_does(spark):
    alone = [
        "+49 30 12 34 56", "+49 30 1234567", "+493012345678", "+44 20 79 46 09", "+33 (6) 12 34 56 78", "+1.23.45", "(212) 555-0100", "212-555-0100", "a@b.cd", "1.2.3.4", "1234 5678 9012 3", "a" * 32, "F" * 32,
        "Mr. Smith", "_Mr Smith", "г-н Иванов", "_Ольга Петрова", "José Díaz", "Señor Díaz", "\u0301Don Juan",
    ]
    rows = spark.createDataFrame([(f"call {a}",) for a in alone], "text string").select("text", F.col("text").rlike(ANY).alias("any"), F.col("text").rlike(HINT).alias("hint"), F.size(spans(F.col("text"))).alias("n")).collect()
    assert all(r.any and r.hint and r.n == 1 for r in rows), [r for r in rows if r.n != 1]
    df = spark.createDataFrame(list(enumerate(alone[:4])), "doc_id long, text string")
    out = replace_pii(df, "k", count_col="n").collect()
    assert all(r.n == 1 and r.text not in alone for r in out)
