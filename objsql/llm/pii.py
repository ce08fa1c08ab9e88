"""PII: detected entities get surrogates, in DataFrame functions only.

Entities are known by a normal form: without case, possessive and, for numbers,
separators, so that all spellings of one are one entity. A surrogate is drawn
from a keyed digest of the normal form, so an entity gets the same surrogate
wherever it occurs, and without the key it can't be undone. It has the entity's
type and takes on the shape of each spelling: letters stay letters of their
script and case, digits digits, separators stay; a card keeps its Luhn status,
an address its four octets, a phone its country code; a name keeps its title,
gender, script, case and possessive, and each of its words is an entity of its
own, so that a person's surname is one surrogate with and without a first name.
Where a text names a person, the person's words are also replaced where they
stand alone in that text.

All entities of the corpus go through a dictionary. A surrogate that is an
entity of the corpus itself, or that another entity has got, is drawn again
until all differ, so distinct entities stay distinct. Where an entity's shape
has too few others, shape gives way: later draws are longer.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from objsql.llm.common import settled, small_side

# Titles before names, and first names that tell a gender.
TITLES_M = ("Mr", "Herr", "Monsieur", "Señor", "Don", "г-н", "Господин")
TITLES_F = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Doña", "г-жа", "Госпожа")
TITLES = ("Dr", "Prof")
FIRST_M = ("John", "James", "Robert", "Michael", "David", "William", "Thomas", "Peter", "Hans", "Jean", "Pierre", "Juan", "Carlos", "José", "Иван", "Пётр", "Алексей", "Дмитрий")
FIRST_F = ("Mary", "Anna", "Emma", "Sarah", "Laura", "Linda", "Julia", "Marie", "Sophie", "Claire", "Maria", "Carmen", "Elena", "Lucía", "Ольга", "Анна", "Мария", "Елена")
# Letters that a letter of the same script is replaced from.
LATIN, CYRILLIC, GREEK = "abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрстуфхцчшэюя", "αβγδεζηθικλμνξοπρστυφχψω"
# Code points of other scripts, from and to, and those that their letters are replaced from.
SCRIPTS = (
    (0x531, 0x588, 0x561, 0x586), (0x10A0, 0x10FF, 0x10D0, 0x10F0), (0x5D0, 0x5F4, 0x5D0, 0x5EA), (0x600, 0x6FF, 0x62A, 0x63A), (0x900, 0x97F, 0x915, 0x939), (0x980, 0x9FF, 0x995, 0x9A8),
    (0xE00, 0xE7F, 0xE01, 0xE2E), (0x3041, 0x309F, 0x304B, 0x3062), (0x30A0, 0x30FF, 0x30AB, 0x30C2), (0x3400, 0x9FFF, 0x4E00, 0x9FA5), (0xAC00, 0xD7A3, 0xAC00, 0xD7A3),
)
# Syllables and endings that invented names are made of, by script.
SYLLABLES = {"latin": ("ba", "be", "co", "da", "del", "fi", "ga", "ho", "jo", "ka", "le", "lin", "ma", "mi", "no", "pe", "ra", "ro", "sa", "ta", "va", "wi", "ze", "tor"), "cyrillic": ("ба", "ве", "го", "да", "ки", "ло", "ма", "не", "по", "ри", "са", "то", "фе", "ха", "ци", "ша")}
ENDINGS = {
    ("latin", "m"): ("rd", "n", "s", "l"), ("latin", "f"): ("na", "la", "ria", "tta"), ("latin", "n"): ("ey", "is", "in", "y"), ("latin", "s"): ("son", "ner", "mann", "well"),
    ("cyrillic", "m"): ("н", "р", "й", "с"), ("cyrillic", "f"): ("на", "ла", "рия", "са"), ("cyrillic", "n"): ("ли", "си", "ни", "ко"), ("cyrillic", "s"): ("нко", "дзе", "вич", "юк"),
}
#: Draws of an entity's own shape, before shape gives way.
SHAPED = 8
#: A country code at the beginning of a phone number's digits.
COUNTRY = r"^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"


def _any_of(words: tuple[str, ...]) -> str:
    """A pattern of the words, as they are and in capitals."""
    return "|".join(dict.fromkeys(v for w in words for v in (w, w.upper())))


_ALL_TITLES, _ALL_FIRST = _any_of((*TITLES_M, *TITLES_F, *TITLES)), _any_of((*FIRST_M, *FIRST_F))
_WORD = r"\p{Lu}[\p{L}'’-]*\p{L}"
_TITLED = rf"(?:{_ALL_TITLES})\.? {_WORD}(?: {_WORD})?"
_NAMED = rf"(?:{_ALL_FIRST}) {_WORD}"
#: Entity type -> pattern, in the order in which they are tried.
PATTERNS = {
    "email": r"[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.[\p{L}]{2,}",
    "ip": r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.?\d)",
    "secret": r"(?<![\p{L}\p{N}])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![\p{L}\p{N}])",
    "phone": r"(?<![\p{L}\p{N}])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]\d{2,9}){1,4}|\+\d{8,15}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\p{L}\p{N}])",
    "card": r"(?<![\p{L}\p{N}])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\p{L}\p{N}])",
    "name": rf"(?<![\p{{L}}\p{{N}}])(?:{_TITLED}|{_NAMED})(?![\p{{L}}\p{{N}}])",
}
ANY = "|".join(PATTERNS.values())
#: Holds wherever ANY does: what each pattern can't match without.
HINT = rf"@|\d{{3}}|\+\d|\d\.\d|[0-9a-fA-F]{{32}}|(?<![\p{{L}}\p{{N}}])(?:{_ALL_TITLES}|{_ALL_FIRST})[. ]"
_POSSESSIVE = "['’][sS]$"


def spans(text: Column) -> Column:
    """The entities of a text, in order; empty for null."""
    # A cheap look first: most texts have none of what an entity needs.
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(f"({ANY})"), 1)).otherwise(F.array().cast("array<string>"))


def kind_of(span: Column) -> Column:
    found = None
    for kind, pattern in PATTERNS.items():
        hit = span.rlike(f"^(?:{pattern})$")
        found = F.when(hit, F.lit(kind)) if found is None else found.when(hit, F.lit(kind))
    return found


def _digits_sum(value: Column, last: bool) -> Column:
    """The Luhn sum of a number, with its last digit or with 0 in its place."""
    digits = F.reverse(F.filter(F.split(value, ""), lambda c: c.between("0", "9")))
    part = F.transform(digits, lambda c, i: F.when(i == 0, c.cast("int") if last else F.lit(0)).when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2).cast("int") - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(part, F.lit(0), lambda a, b: a + b)


def luhn_valid(value: Column) -> Column:
    return _digits_sum(value, True) % 10 == 0


def _stream(key: str, kind: Column, value: Column, attempt: Column) -> Column:
    """256 keyed hexadecimal digits."""
    seed = F.concat_ws("\x00", F.lit(key), kind, value, attempt.cast("string"))
    # The key goes in before and after, and what is hashed is itself a digest.
    return F.concat(*[F.sha2(F.concat(F.lit(key), F.sha2(F.concat(F.lit(f"{k}:"), seed), 256)), 256) for k in range(4)])


def _byte(stream: Column, at: Column) -> Column:
    return F.conv(F.substr(stream, (at % 128) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _letter(c: Column, draw: Column) -> Column:
    """A letter of the same script or a digit for a lower-case one; marks and signs stay. Letters of scripts without a table become Latin ones."""

    def of(alphabet: str) -> Column:
        return F.substr(F.lit(alphabet), draw % len(alphabet) + 1, F.lit(1))

    out = F.when(c.rlike(r"^\p{N}$"), of("0123456789")).when(c.between("a", "z") | c.rlike(r"^[\p{IsLatin}&&\p{L}]$"), of(LATIN)).when(c.rlike(r"^[\p{IsCyrillic}&&\p{L}]$"), of(CYRILLIC)).when(c.rlike(r"^[\p{IsGreek}&&\p{L}]$"), of(GREEK))
    for low, high, least, most in SCRIPTS:
        code = F.lit(least) + draw % (most - least + 1)
        out = out.when(F.ascii(c).between(low, high) & c.rlike(r"^\p{L}$"), F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE"))
    return out.when(c.rlike(r"\p{L}"), of(LATIN)).otherwise(c)


def _shaped(value: Column, stream: Column, fixed: Column) -> Column:
    """Each letter or digit replaced by one of its kind, but for the first ``fixed`` characters."""
    two = lambda i: _byte(stream, i) * 256 + _byte(stream, i + 53)
    return F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when(i < fixed, c).otherwise(_letter(c, two(i)))), "")


def _invented(value: Column, stream: Column, attempt: Column, gender: str) -> Column:
    """A name word of the value's script; more attempts make longer ones."""

    def of(script: str) -> Column:
        syllables, endings = F.array(*map(F.lit, SYLLABLES[script])), F.array(*map(F.lit, ENDINGS[script, gender]))
        n = F.lit(2) + F.floor(attempt / 2).cast("int")
        parts = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.element_at(syllables, (_byte(stream, k) * 7 + _byte(stream, k + 60)) % len(SYLLABLES[script]) + 1))
        return F.concat(F.array_join(parts, ""), F.element_at(endings, _byte(stream, F.lit(50)) % len(ENDINGS[script, gender]) + 1))

    return F.when(value.rlike(r"^[\p{IsLatin}\p{M}'’-]+$"), of("latin")).when(value.rlike(r"^[\p{IsCyrillic}\p{M}'’-]+$"), of("cyrillic")).otherwise(F.concat(_shaped(value, stream, F.lit(0)), _more(value, stream, attempt)))


def _more(value: Column, stream: Column, attempt: Column) -> Column:
    """What is added to a surrogate of the value's shape once that was tried SHAPED times: letters, or digits after a digit."""
    drawn = F.substr(stream, F.lit(200), F.greatest(F.lit(0), attempt - (SHAPED - 1)))
    return F.when(value.rlike(r"\d$"), F.translate(drawn, "abcdef", "012345")).otherwise(F.translate(drawn, "0123456789", "ghijklmnop"))


def normal_form(kind: Column, value: Column) -> Column:
    """What is the same for all spellings of an entity: lower case, without separators in numbers or a possessive in names."""
    number = F.concat(F.when(value.startswith("+"), "+").otherwise(""), F.regexp_replace(value, r"\D", ""))
    return F.when(kind.isin("phone", "card"), number).when(kind.isin("email", "ip", "secret"), F.lower(value)).otherwise(F.lower(F.regexp_replace(value, _POSSESSIVE, "")))


def surrogate(kind: Column, value: Column, attempt: Column, key: str) -> Column:
    """The surrogate of an entity in normal form at an attempt, in normal form."""

    def draw(stream: Column) -> Column:
        shaped = _shaped(value, stream, F.lit(0))
        octets = F.array_join(F.transform(F.split(value, r"\."), lambda o, i: (_byte(stream, i) % 254 + 1).cast("string")), ".")
        more = _more(value, stream, attempt)
        # A number doesn't begin with 0; a card's last digit sets its Luhn status.
        drawn = F.regexp_replace(F.concat(shaped, more), "^0", "4")
        check = (10 - _digits_sum(drawn, False) % 10) % 10
        card = F.concat(F.substr(drawn, F.lit(1), F.char_length(drawn) - 1), F.when(luhn_valid(value), check).otherwise((check + 1 + _byte(stream, F.lit(100)) % 9) % 10).cast("string"))
        hexadecimal = F.array_join(F.transform(F.split(value, ""), lambda c, i: F.substr(stream, i % 256 + 1, F.lit(1))), "")
        tld = F.regexp_extract(value, r"\.[^.]*$", 0)
        letters = F.translate(F.substr(stream, F.lit(200), F.greatest(F.lit(0), attempt - (SHAPED - 1))), "0123456789", "ghijklmnop")
        return (
            F.when(kind == "email", F.concat(letters, _shaped(F.regexp_replace(value, r"\.[^.]*$", ""), stream, F.lit(0)), tld))
            .when(kind == "ip", F.concat(octets, more))
            .when(kind == "secret", F.concat(hexadecimal, F.substr(stream, F.lit(200), F.greatest(F.lit(0), attempt - (SHAPED - 1)))))
            .when(kind == "phone", F.concat(_shaped(value, stream, F.char_length(F.regexp_extract(value, COUNTRY, 0))), more))
            .when(kind == "card", card)
            .when(kind == "given_m", _invented(value, stream, attempt, "m"))
            .when(kind == "given_f", _invented(value, stream, attempt, "f"))
            .when(kind == "given", _invented(value, stream, attempt, "n"))
            .otherwise(_invented(value, stream, attempt, "s"))
        )

    # The digest is made once and handed on.
    return F.element_at(F.transform(F.array(_stream(key, kind, value, attempt)), draw), 1)


def spelled(kind: Column, value: Column, new: Column) -> Column:
    """A surrogate in normal form, spelled as ``value`` is: its separators, case and possessive."""
    step = lambda a, c: F.when(c.between("0", "9"), F.struct((a["n"] + 1).alias("n"), F.concat(a["out"], F.substr(a["digits"], a["n"] + 1, F.lit(1))).alias("out"), a["digits"].alias("digits"))).otherwise(
        F.struct(a["n"].alias("n"), F.concat(a["out"], c).alias("out"), a["digits"].alias("digits"))
    )
    number = F.aggregate(F.split(value, ""), F.struct(F.lit(0).alias("n"), F.lit("").alias("out"), F.regexp_replace(new, r"\D", "").alias("digits")), step, lambda a: F.concat(a["out"], F.substr(a["digits"], a["n"] + 1, F.char_length(a["digits"]))))
    capital = lambda c: (F.upper(c) == c) & (F.lower(c) != c)
    alike = F.array_join(F.transform(F.split(new, ""), lambda c, i: F.when(capital(F.substr(value, i + 1, F.lit(1))), F.upper(c)).otherwise(c)), "")
    all_capitals = capital(value) & (F.char_length(value) > 1)
    bare = F.regexp_replace(value, _POSSESSIVE, "")
    name = F.concat(F.when(capital(bare) & (F.char_length(bare) > 1), F.upper(new)).otherwise(F.initcap(new)), F.regexp_extract(value, _POSSESSIVE, 0))
    text = F.when(all_capitals, F.upper(new)).when(F.char_length(new) == F.char_length(value), alike).otherwise(new)
    return F.when(kind.isin("phone", "card"), number).when(kind.isin("email", "secret"), text).when(kind == "ip", new).otherwise(name)


def parts_of(kind: Column, span: Column) -> Column:
    """What a span is made of, as (kind, value): itself, or the words of a name."""
    title = F.lower(F.regexp_extract(span, rf"^({_ALL_TITLES})\.? ", 1))
    words = F.split(F.regexp_replace(span, rf"^(?:{_ALL_TITLES})\.? ", ""), " ")
    first = F.lower(F.regexp_replace(F.element_at(words, 1), _POSSESSIVE, ""))
    lowered = lambda values: [v.lower() for v in values]
    # A first name tells more than a title; one that isn't known ends in a vowel of its gender, or tells none.
    known = F.when(first.isin(*lowered(FIRST_M)), "given_m").when(first.isin(*lowered(FIRST_F)), "given_f")
    gender = known.when(title.isin(*lowered(TITLES_M)), "given_m").when(title.isin(*lowered(TITLES_F)), "given_f").when(first.rlike("[aая]$"), "given_f").otherwise("given")
    is_given = (F.size(words) > 1) | first.isin(*lowered((*FIRST_M, *FIRST_F)))
    names = F.transform(words, lambda w, i: F.struct(F.when((i == 0) & is_given, gender).otherwise(F.lit("surname")).alias("kind"), w.alias("value")))
    return F.when(kind == "name", names).otherwise(F.array(F.struct(kind.alias("kind"), span.alias("value"))))


def _space(kind: Column) -> Column:
    """Kinds whose surrogates have to differ from each other: those of names are one."""
    return F.when(kind.isin("given", "given_m", "given_f", "surname"), "name").otherwise(kind)


def dictionary(entities: DataFrame, key: str) -> DataFrame:
    """(kind, value, surrogate) for the distinct entities (kind, value) in normal form; surrogates of a kind, or of any names, differ from each other and from all values.

    The longer an entity goes without a free surrogate, the longer its draws get, so a few rounds find one for all.
    """
    left = settled(entities.distinct().withColumn("space", _space(F.col("kind"))))
    taken, done, attempt = settled(left.select("space", F.col("value").alias("surrogate")).distinct()), [], 0
    while not left.isEmpty():
        drawn = left.withColumn("surrogate", F.lower(surrogate(F.col("kind"), F.col("value"), F.lit(attempt), key)))
        free = settled(drawn.join(small_side(taken), ["space", "surrogate"], "left_anti"))
        # Of entities that drew the same, the least keeps it.
        owner = free.groupBy("space", "surrogate").agg(F.min(F.struct("value", "kind")).alias("owner"))
        got = settled(free.join(small_side(settled(owner)), ["space", "surrogate"]).where((F.col("value") == F.col("owner.value")) & (F.col("kind") == F.col("owner.kind"))).select("space", "kind", "value", "surrogate"))
        done.append(got)
        left = settled(left.join(small_side(got.select("kind", "value")), ["kind", "value"], "left_anti"))
        taken, attempt = taken.union(got.select("space", "surrogate")), attempt + 1
    if not done:
        return left.select("kind", "value", F.col("value").alias("surrogate"))
    return reduce(DataFrame.union, done).select("kind", "value", "surrogate")


def replace_pii(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """The rows of ``docs`` with the entities in ``text_col`` replaced; ``count_col``, if given, is added with their number, in place of a column of that name.

    - Types: e-mail, IPv4, card, phone, hexadecimal secret, person (after a
      title, or a listed first name before another capitalised word; the
      person's words of three letters or more also alone in the same text).
    - The same entity, however spelled, gets the same surrogate everywhere;
      different entities of a type get different ones. Surrogates depend on
      ``key`` and on the set of entities, where draws collide.
    - Null stays null; a text without entities comes out unchanged. Rows come
      out one for one, also repeated ones and those with a null id; ``id_col``
      doesn't matter. Other columns are untouched. An empty table gives an
      empty table.
    """
    text = docs[text_col].cast("string")
    plain = docs.select(F.xxhash64(text).alias("of"), text.alias("text"))
    # Rows of equal texts are one here.
    found = plain.select("of", F.explode(F.array_distinct(spans(F.col("text")))).alias("span")).distinct().withColumn("kind", kind_of(F.col("span")))
    found = settled(found)
    parts = found.select("of", "span", "kind", F.posexplode(parts_of(F.col("kind"), F.col("span"))).alias("at", "part")).select("of", "span", "at", F.col("part.kind").alias("kind"), F.col("part.value").alias("value"))
    parts = settled(parts.withColumn("normal", normal_form(F.col("kind"), F.col("value"))))
    known = settled(dictionary(parts.select("kind", F.col("normal").alias("value")), key))
    new = spelled(F.col("kind"), F.col("value"), F.col("surrogate"))
    distinct = settled(parts.drop("of").distinct().join(small_side(known.withColumnRenamed("value", "normal")), ["kind", "normal"]).select("span", "at", "kind", "value", "normal", "surrogate", new.alias("new")))
    # A span's words, put together again behind its title.
    whole = distinct.groupBy("span").agg(F.array_sort(F.collect_list(F.struct("at", "value", "new"))).alias("words"))
    whole = settled(whole.select("span", F.concat(F.expr("left(span, char_length(span) - char_length(array_join(transform(words, w -> w.value), ' ')))"), F.array_join(F.transform("words", lambda w: w["new"]), " ")).alias("new")))
    # A person's words where they stand alone: as written, in title case and in capitals.
    person = parts.where(F.col("kind").isin("given", "given_m", "given_f", "surname")).select("of", "kind", "normal", F.regexp_replace("value", _POSSESSIVE, "").alias("value")).distinct()
    person = person.join(small_side(known.withColumnRenamed("value", "normal")), ["kind", "normal"]).where(F.char_length("value") > 2)
    person = person.select("of", "kind", "surrogate", F.explode(F.array_distinct(F.array("value", F.initcap("value"), F.upper("value")))).alias("word"))
    # A word that is a first name and a surname in one text is taken as the surname.
    person = person.groupBy("of", "word").agg(F.max_by("surrogate", "kind").alias("surrogate")).select("of", F.col("word").alias("span"), spelled(F.lit("surname"), F.col("word"), F.col("surrogate")).alias("new"), F.lit(True).alias("alone"))
    pairs = found.select("of", "span").join(small_side(whole), "span").select("of", "span", "new", F.lit(False).alias("alone")).union(person)
    pairs = pairs.groupBy("of", "span").agg(F.min_by("new", "alone").alias("new"), F.max("alone").alias("alone"))
    words = F.array_sort(F.collect_set(F.when(F.col("alone"), F.struct((-F.char_length("span")).alias("n"), "span"))))
    by_text = pairs.groupBy(F.col("of").alias("_objsql_of")).agg(F.map_from_entries(F.collect_list(F.struct("span", "new"))).alias("_objsql_new"), words.alias("words"))
    by_text = settled(by_text.select("_objsql_of", "_objsql_new", F.when(F.size("words") > 0, F.array_join(F.transform("words", lambda w: w["span"]), "|")).alias("_objsql_words")))

    joined = docs.select(*[c for c in docs.columns if c != count_col]).withColumn("_objsql_text", F.xxhash64(F.col(text_col).cast("string")))
    joined = joined.join(small_side(by_text), F.col("_objsql_text") == F.col("_objsql_of"), "left")
    text = F.col(text_col).cast("string")

    def put(both: Column) -> Column:
        pieces, entities = both["pieces"], both["entities"]
        new = F.transform(entities, lambda e: F.coalesce(F.element_at(F.col("_objsql_new"), e), e))
        out = F.concat(F.array_join(F.transform(new, lambda e, i: F.concat(F.element_at(pieces, i + 1), e)), ""), F.element_at(pieces, -1))
        return F.struct(out.alias("text"), F.size(entities).cast("long").alias("n"))

    def cut(pattern: Column) -> Column:
        return F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.concat(F.lit("("), pattern, F.lit(")")), F.lit(1)).alias("entities"))

    # Most texts have no names; the pattern of the others is compiled anew for each.
    own = F.concat(F.lit(ANY + r"|(?<![\p{L}\p{N}])(?:"), F.col("_objsql_words"), F.lit(r")(?![\p{L}\p{N}])"))
    both = F.when(F.col("_objsql_words").isNull(), cut(F.lit(ANY))).otherwise(cut(own))
    done = F.when(F.col("_objsql_of").isNull(), F.struct(text.alias("text"), F.lit(0).cast("long").alias("n"))).otherwise(F.element_at(F.transform(F.array(both), put), 1))
    joined = joined.withColumn("_objsql_done", done)
    columns = [F.col("_objsql_done.text").alias(c) if c == text_col else F.col(c) for c in docs.columns if c != count_col]
    if count_col:
        columns.append(F.col("_objsql_done.n").alias(count_col))
    return joined.select(*columns)
