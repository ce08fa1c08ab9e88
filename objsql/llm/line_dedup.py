"""Line dedup: one occurrence stays of each group of equal or nearly equal lines.

Lines are normalised: lower case, every digit 0, words split at white space and
ASCII punctuation. Equal normalised lines are repeats. The SimHash of a line is
made of blocks, each the SimHash of its own share of the line's words, which a
word's hash deals out. So a changed word alters two blocks at most, an added or
missing one a single block, and lines that differ in a few words agree in some
block by the pigeonhole principle, however short they are. Longer lines have more
blocks, as more of their words may change; a block also outlives changes to a
few of its many words. Words count with their length, as they do in edit
distance. Lines meet in one block, short ones in two, as the words of one would
say too little.

Lines that meet are verified by edit similarity, and of each connected group the
first occurrence, by document id and line number, is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from objsql.llm.common import lean, settled, small_side, written
from objsql.llm.grouping import connected_groups, verified_links
from objsql.llm.text_kernel import PUNCT, Run, mix, runs, sequence_hashes

MIN_WORDS, SIMILARITY = 5, 0.8
#: For lines of so many different words (None: no limit): blocks, how many must agree, and bits of a block. The ranges overlap by as much as lines that are alike differ.
SCHEMES = ((1, 20, 4, 2, 24), (16, 50, 4, 1, 32), (40, 100, 6, 1, 32), (80, 200, 10, 1, 32), (160, None, 16, 1, 32))
#: The words of a meeting place weigh this share of what they would on average, and are two if the line has two, at least: a few short words make lines meet that have nothing else in common.
LEAST_SHARE = 0.5
#: Bytes of the list of meeting places with company, a number each, that may be broadcast rather than shuffle all meeting places again.
CROWDED_BYTES = 24 << 20
#: Pairs of lines whose texts a task holds as strings.
PAIRS_AT_ONCE = 4_000
#: Longer words weigh no more.
MOST_WEIGHT = 16
#: Features whose weights a 16-bit lane can sum.
_LANE = 65535 // MOST_WEIGHT
_DIGITS = np.arange(256, dtype=np.uint8)
_DIGITS[48:58] = 48
#: For four bits, four lanes of a bit each.
_LANES = np.array([sum(((b >> i) & 1) << (16 * i) for i in range(4)) for b in range(16)], np.uint64)
_TO_SPACE = bytes(0x20 if PUNCT[b] else b for b in range(256))


def distinct_words(words: np.ndarray, lengths: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of each stretch, firsts[i] to firsts[i + 1], sorted and once each, with their weights; and where each stretch begins now."""
    owner = np.repeat(np.arange(len(firsts) - 1, dtype=np.uint64), np.diff(firsts))
    order = np.argsort((owner << np.uint64(40)) | (words >> np.uint64(24)))
    words, owner = words[order], owner[order]
    new = np.ones(len(words), bool)
    new[1:] = (words[1:] != words[:-1]) | (owner[1:] != owner[:-1])
    return words[new], np.minimum(lengths[order[new]], MOST_WEIGHT).astype(np.uint64), np.searchsorted(owner[new], np.arange(len(firsts)))


def block_hashes(words: np.ndarray, weight: np.ndarray, firsts: np.ndarray, blocks: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each stretch of ``distinct_words``, none empty, the SimHash of each block's words (0: no word), their number and weight.

    A word is in the block that its hash says, and counts once however often it
    occurs, or a frequent word would outvote the rest.
    """
    n = len(firsts) - 1
    owner = np.repeat(np.arange(n, dtype=np.uint64), np.diff(firsts))
    # The upper half of a word's hash chooses its block, the lower half votes.
    segment = owner * np.uint64(blocks) + ((words >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32))
    begins = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]])) if len(words) else np.zeros(0, np.int64)
    count = np.diff(np.append(begins, len(words)))
    # Longer stretches than a lane can sum are summed in parts.
    parts = -(-count // _LANE)
    offset = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    part_begins = np.repeat(begins, parts) + _LANE * offset
    first_part = np.flatnonzero(offset == 0)
    total = np.add.reduceat(weight, begins) if len(begins) else weight
    code = np.zeros(len(begins), np.uint64)
    for j in range(0, bits, 4):
        if not len(begins):
            break
        lanes = np.add.reduceat(_LANES[(words >> np.uint64(j)) & np.uint64(15)] * weight, part_begins)
        for i in range(min(4, bits - j)):
            votes = (lanes >> np.uint64(16 * i)) & np.uint64(0xFFFF)
            if len(part_begins) > len(begins):
                votes = np.add.reduceat(votes, first_part)
            code |= (2 * votes > total).astype(np.uint64) << np.uint64(j + i)
    codes, counts, weights = np.zeros(n * blocks, np.uint64), np.zeros(n * blocks, np.int64), np.zeros(n * blocks, np.int64)
    place = segment[begins].astype(np.int64)
    codes[place], counts[place], weights[place] = code, count, total
    return codes.reshape(n, blocks), counts.reshape(n, blocks), weights.reshape(n, blocks)


def meeting_keys(words: np.ndarray, weight: np.ndarray, firsts: np.ndarray, blocks: int, agree: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(stretch, key) of the meeting places of each stretch: each choice of ``agree`` of its blocks that holds enough words."""
    codes, counts, weights = block_hashes(words, weight, firsts, blocks, bits)
    least, few = LEAST_SHARE * agree * weights.sum(axis=1), np.minimum(2, np.diff(firsts))
    rows, keys = [], []
    for number, chosen in enumerate(combinations(range(blocks), agree)):
        own = np.flatnonzero((counts[:, chosen].sum(axis=1) >= few) & (weights[:, chosen].sum(axis=1) * blocks >= least))
        key = np.full(len(own), (number * 64 + blocks) * 8 + agree, np.uint64)
        for block in chosen:
            key = mix(key * np.uint64(0x100000001B3) + codes[own, block])
        rows.append(own)
        keys.append(key)
    return np.concatenate(rows), np.concatenate(keys)


def lines_of(run: Run, min_words: int) -> dict[str, np.ndarray]:
    """Of each line with a word: its text's number, line number, two hashes of its normalised words (key, check) and their size in characters; and for lines of ``min_words`` words or more (line, meet): meeting places.

    In shorter lines digits stay as they are.
    """
    raw, run = run, Run(run.first, _DIGITS[run.data], run.bounds)
    line_starts, line_ends, owner = run.lines()
    starts, ends, _ = run.spans(PUNCT)
    firsts = np.searchsorted(starts, np.append(line_starts, len(run.data) + 1), "left")
    n = np.diff(firsts)
    words = run.hashes(starts, ends)
    key = sequence_hashes(words, firsts)
    bare = np.flatnonzero((n > 0) & (n < min_words))
    digits = np.flatnonzero(raw.data - np.uint8(48) < 10)
    bare = bare[np.searchsorted(digits, line_ends[bare]) > np.searchsorted(digits, line_starts[bare])]
    if len(bare):
        size = (line_ends - line_starts)[bare]
        cut = np.concatenate([[0], np.cumsum(size)])
        part = Run(0, raw.data[np.repeat(line_starts[bare] - cut[:-1], size) + np.arange(cut[-1])], cut)
        own_starts, own_ends, own = part.spans(PUNCT)
        key[bare] = sequence_hashes(part.hashes(own_starts, own_ends), np.searchsorted(own, np.arange(len(bare) + 1)))
    # Characters are bytes that don't continue one.
    chars = np.zeros(len(run.data) + 1, np.int64)
    np.cumsum((run.data & 0xC0) != 0x80, out=chars[1:])
    word_chars = chars[ends] - chars[starts]
    held = np.zeros(len(words) + 1, np.int64)
    np.cumsum(word_chars, out=held[1:])
    some = np.flatnonzero(n > 0)
    number = np.arange(len(owner)) - np.searchsorted(owner, np.arange(len(run)))[owner]
    line, meet = [], []
    able = np.flatnonzero(n[some] >= min_words)
    cut = np.concatenate([[0], np.cumsum(n[some[able]])])
    picked = np.repeat(firsts[:-1][some[able]] - cut[:-1], n[some[able]]) + np.arange(cut[-1])
    kind, weight, begins = distinct_words(words[picked], word_chars[picked], cut)
    kinds = np.diff(begins)
    for least, most, *scheme in SCHEMES:
        own = np.flatnonzero((kinds >= least) & (kinds <= (most or len(words))))
        if len(own):
            cut = np.concatenate([[0], np.cumsum(kinds[own])])
            picked = np.repeat(begins[:-1][own] - cut[:-1], kinds[own]) + np.arange(cut[-1])
            at, keys = meeting_keys(kind[picked], weight[picked], cut, *scheme)
            line.append(able[own[at]])
            meet.append(keys)
    # Another hash, of the sum of the words' hashes and their number: equal lines have equal ones, and it owes nothing to their order.
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words, out=total[1:])
    check = mix(total[firsts[1:]] - total[firsts[:-1]] + n.astype(np.uint64))
    none = np.zeros(0, np.int64)
    return {
        "text": owner[some], "number": number[some], "key": key[some], "check": check[some], "size": (held[firsts[1:]] - held[firsts[:-1]])[some] + n[some] - 1,
        "line": np.concatenate([none, *line]), "meet": np.concatenate([none.astype(np.uint64), *meet]),
    }


def _occurrences(docs: DataFrame, min_words: int) -> DataFrame:
    """id, version (a hash of the text), number, key, check, size and meets of each line with a word."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in runs(pc.utf8_lower(batch.column(2))):
                found = lines_of(run, min_words)
                order = np.argsort(found["line"], kind="stable")
                bounds = np.searchsorted(found["line"][order], np.arange(len(found["text"]) + 1)).astype(np.int32)
                at = pa.array(found["text"] + run.first)
                columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(found["number"], pa.int64()), pa.array(found["key"].view(np.int64)), pa.array((found["check"] >> np.uint64(32)).astype(np.uint32).view(np.int32)), pa.array(found["size"], pa.int32())]
                yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(bounds), pa.array(found["meet"][order].view(np.int64)))], ["id", "version", "number", "key", "check", "size", "meets"])

    return docs.mapInArrow(lean(emit, 2), "id long, version long, number long, key long, check int, size int, meets array<long>")


def _line_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """key and normalised words of the lines given as (id, version, number, key)."""
    by_doc = settled(wanted.groupBy(F.col("id").alias("of"), F.col("version").alias("of_version")).agg(F.collect_list(F.struct("number", "key")).alias("asked")))
    joined = docs.join(small_side(by_doc), (F.col("id") == F.col("of")) & (F.col("version") == F.col("of_version"))).select("text", "asked")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, words = [], []
            for text, asked in zip(pc.utf8_lower(batch.column(0)), batch.column(1)):
                lines = text.as_py().split("\n")
                for one in asked.as_py():
                    raw = lines[one["number"]].encode().translate(_DIGITS.tobytes())
                    keys.append(one["key"])
                    words.append(b" ".join(raw.translate(_TO_SPACE).split()).decode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(words, pa.string())], ["key", "words"])

    # A repeated row of a document gives its lines again.
    return joined.mapInArrow(lean(emit), "key long, words string").dropDuplicates(["key"])


def _common_start(x: str, y: str) -> int:
    """How many characters both begin with."""
    low, high = 0, min(len(x), len(y))
    while low < high:
        middle = (low + high + 1) // 2
        if x[low:middle] == y[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


#: How many words of either side are skipped to get in step again, fewest first.
_STEPS = sorted(((p, q) for p in range(5) for q in range(5) if p or q), key=lambda s: (s[0] + s[1], abs(s[0] - s[1])))


def _edits_by_words(a: list[str], b: list[str], most: int) -> int:
    """A number that the edit distance of two texts, given by their words, doesn't exceed; it is no longer exact once over ``most``.

    Unequal words are gone past until words are equal again; what was skipped
    is replaced as a whole.
    """
    i = j = cost = 0
    n, m = len(a), len(b)
    while i < n and j < m:
        if a[i] == b[j]:
            i, j = i + 1, j + 1
            continue
        for p, q in _STEPS:
            if i + p < n and j + q < m and a[i + p] == b[j + q]:
                break
        else:
            p = q = 1
        cost += max(sum(map(len, a[i : i + p])) + p, sum(map(len, b[j : j + q])) + q)
        if cost > most:
            return cost
        i, j = i + p, j + q
    return cost + max(sum(map(len, a[i:])) + n - i, sum(map(len, b[j:])) + m - j)


def _pair_within(x: str, y: str, most: int) -> bool:
    """Whether the edit distance of two strings, x not longer than y, is at most that: as ``_chunk_within``, with one long number for a column."""
    where: dict[str, int] = {}
    for k, c in enumerate(x):
        where[c] = where.get(c, 0) | 1 << k
    n, left = len(x), len(y)
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, distance = full, 0, n
    for c in y:
        match = where.get(c, 0)
        across = (((match & up) + up) ^ up) | match | down
        more, less = down | (full & ~(across | up)), up & across
        distance += 1 if more & top else -1 if less & top else 0
        left -= 1
        if distance - left > most:
            return False
        more = more << 1 | 1
        up, down = (less << 1 | ~(across | more)) & full, more & across & full
    return distance <= most


def _chunk_within(x: list[str], y: list[str], most: np.ndarray) -> np.ndarray:
    """Whether each pair's edit distance is at most that; x not longer than y, and all x of as many 64-bit words.

    The bits of a pair's words are the differences down a column of its distance
    table, as Myers has them; all pairs move on by a column at a time, and those
    that can't come back under their bound are left out now and then.
    """
    n, m = np.array([len(v) for v in x]), np.array([len(v) for v in y])
    blocks, rows = -(-int(n[0]) // 64), np.arange(len(x))
    letters, code = np.unique(np.frombuffer("".join([*x, *y]).encode("utf-32-le"), np.uint32), return_inverse=True)
    x_at, y_at = np.cumsum(n) - n, n.sum() + np.cumsum(m) - m
    match = np.zeros((blocks, len(x), len(letters) + 1), np.uint64)
    for k in range(int(n.max())):
        own = rows[n > k]
        match[k // 64, own, code[x_at[own] + k]] |= np.uint64(1 << (k % 64))
    one, last = np.uint64(1), ((n - 1) % 64).astype(np.uint64)
    up, down, distance = np.full((blocks, len(x)), ~np.uint64(0)), np.zeros((blocks, len(x)), np.uint64), n.copy()
    within, alive = np.zeros(len(x), bool), rows
    for j in range(int(m.max())):
        column = code[y_at + j]
        plus, minus = np.ones(len(alive), np.uint64), np.zeros(len(alive), np.uint64)
        for block in range(blocks):
            equal, pv, mv = match[block, alive, column], up[block], down[block]
            wide = equal | mv
            equal = equal | minus
            across = (((equal & pv) + pv) ^ pv) | equal
            more, less = mv | ~(across | pv), pv & across
            top = last if block == blocks - 1 else np.uint64(63)
            next_plus, next_minus = (more >> top) & one, (less >> top) & one
            more, less = (more << one) | plus, (less << one) | minus
            up[block], down[block] = less | ~(wide | more), more & wide
            plus, minus = next_plus, next_minus
        distance = distance + plus.astype(np.int64) - minus.astype(np.int64)
        ended = m == j + 1
        if ended.any():
            within[alive[ended & (distance <= most)]] = True
        if ended.any() or j % 16 == 15:
            # The last cell can fall by one for each character left.
            keep = ~ended & (distance - (m - j - 1) <= most)
            if not keep.any():
                break
            if not keep.all():
                alive, m, most, distance, y_at, last = alive[keep], m[keep], most[keep], distance[keep], y_at[keep], last[keep]
                up, down = up[:, keep], down[:, keep]
    return within


#: Bytes of bit tables that pairs measured together take at most, for alphabets of some hundred letters; pairs for each word of their columns from which that pays.
_CHUNK_BYTES, _CHUNK_PAIRS = 8 << 20, 12


def edits_within(x: list[str], y: list[str], similarity: float) -> np.ndarray:
    """For pairs of strings, whether 1 - edit distance / longer length is ``similarity`` or more."""
    found, hard = np.zeros(len(x), bool), []
    for k, (a, b) in enumerate(zip(x, y)):
        most = int((1 - similarity) * max(len(a), len(b)) + 1e-9)
        if abs(len(a) - len(b)) > most:
            continue
        start = _common_start(a, b)
        a, b = a[start:], b[start:]
        end = _common_start(a[::-1], b[::-1])
        a, b = a[: len(a) - end], b[: len(b) - end]
        if max(len(a), len(b)) <= most or most and _edits_by_words(a.split(" "), b.split(" "), most) <= most:
            found[k] = True
        elif most and a and b:
            hard.append((-(-min(len(a), len(b)) // 64), max(len(a), len(b)), k, most, *((a, b) if len(a) <= len(b) else (b, a))))
    hard.sort(key=lambda h: h[:3])
    start = 0
    while start < len(hard):
        blocks = hard[start][0]
        chunk = [h for h in hard[start : start + max(1, _CHUNK_BYTES // (blocks * 1024))] if h[0] == blocks]
        x, y, most = [h[4] for h in chunk], [h[5] for h in chunk], [h[3] for h in chunk]
        if len(chunk) < _CHUNK_PAIRS * blocks or len(set().union(*x, *y)) > 512:
            within = [_pair_within(*pair) for pair in zip(x, y, most)]
        else:
            within = _chunk_within(x, y, np.array(most))
        found[[h[2] for h in chunk]] = within
        start += len(chunk)
    return found


def _place(seen: DataFrame) -> tuple[Column, int]:
    """Document id and line number as one number that orders by both, id * lines + number, and lines: a long where the ids leave room for it."""
    r = seen.agg(F.min("id").alias("low"), F.max("id").alias("high"), F.max("number").alias("lines")).first()
    lines = (r.lines or 0) + 1
    if r.low is None or max(abs(r.low), abs(r.high)) + 1 < (1 << 62) // lines:
        return F.col("id") * F.lit(lines) + F.col("number"), lines
    return (F.col("id").cast("decimal(20,0)") * F.lit(lines).cast("decimal(11,0)") + F.col("number").cast("decimal(11,0)")).cast("decimal(33,0)"), lines


def repeated_lines(docs: DataFrame, id_col: str, text_col: str, min_words: int, similarity: float) -> DataFrame:
    """(id, version, number) of the line occurrences that go; version is a hash of the document's text."""
    texts = docs.where(docs[id_col].isNotNull() & (docs[text_col] != "")).select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text")).select("id", F.xxhash64("text").alias("version"), "text")
    seen = written(_occurrences(texts, min_words), "lines")
    place, lines = _place(seen)
    # Id and number are told by the place.
    places = seen.select("key", "version", "check", place.alias("place"))
    firsts = places.groupBy("key").agg(F.min("place").alias("first"), F.max("place").alias("last"), F.min_by("version", "place").alias("version"), F.min("check").alias("low"), F.max("check").alias("high"))
    firsts = written(firsts.select("key", "first", "version", (F.col("first") < F.col("last")).alias("again"), (F.col("low") < F.col("high")).alias("clash")), "firsts")

    met = seen.select(F.explode("meets").alias("meet"), "key", "size")
    crowded = settled(met.groupBy("meet").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low <> high").select(F.col("meet").alias("crowded")))
    members = met.join(small_side(crowded, CROWDED_BYTES), F.col("meet") == F.col("crowded")).select(F.col("meet").alias("key"), F.col("key").alias("id"), "size")
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.sparkSession.sparkContext.defaultParallelism)
    words: list[DataFrame] = []

    def document(place: str) -> Column:
        return F.expr(f"({place} - pmod({place}, {lines})) div {lines}").cast("long")

    def number(place: str) -> Column:
        return F.pmod(place, F.lit(lines)).cast("long")

    def prepare(wanted: DataFrame) -> None:
        """The texts of the lines that may be compared are fetched in one pass."""
        wanted = settled(wanted.withColumnRenamed("id", "key"))
        first = firsts.join(small_side(wanted), "key").select(document("first").alias("id"), "version", number("first").alias("number"), "key")
        words.append(written(_line_texts(texts, first), "words"))

    def verify(pairs: DataFrame) -> DataFrame:
        known = words[0]
        # Later rounds compare few of the lines; the others' texts needn't be shuffled or broadcast.
        own = settled(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct())
        if 2 * own.count() < known.count():
            known = settled(known.join(small_side(own), "key", "left_semi"))

        def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, len(batch), PAIRS_AT_ONCE):
                    part = batch.slice(start, PAIRS_AT_ONCE)
                    yield part.select([0, 1]).filter(pa.array(edits_within(part.column(2).to_pylist(), part.column(3).to_pylist(), similarity)))

        x, y = known.select(F.col("key").alias("a"), F.col("words").alias("x")), known.select(F.col("key").alias("b"), F.col("words").alias("y"))
        return pairs.repartition(tasks).join(small_side(x), "a").join(small_side(y), "b").select("a", "b", "x", "y").mapInArrow(lean(hold), "a long, b long")

    groups = settled(connected_groups(verified_links(members, verify, similarity, prepare=prepare)))
    # A root has no row in groups, so it is found by its group's rows.
    linked = settled(groups.select(F.col("id").alias("key"), "root").union(groups.select(F.col("root").alias("key"), "root").distinct()))

    # Keys that occur again or are linked.
    some = firsts.join(small_side(linked), "key", "left").where("again or root is not null").select("key", "first", F.coalesce("root", "key").alias("root"), F.col("root").isNotNull().alias("linked"), "clash")
    some = settled(some)
    kept = settled(some.where("linked").groupBy("root").agg(F.min("first").alias("kept")))
    keep = settled(some.join(small_side(kept), "root", "left").select(F.col("key").alias("of"), "first", F.coalesce("kept", "first").alias("kept"), "clash"))
    clash = not keep.where("clash").isEmpty()
    at = (places if clash else places.drop("check")).join(small_side(keep), F.col("key") == F.col("of"))
    if clash:
        # Equal keys whose second hashes differ are different lines: only those equal to the first are dealt with.
        right = at.where("clash and place = first").groupBy("key").agg(F.min("check").alias("right")).withColumnRenamed("key", "clashing")
        at = at.join(small_side(settled(right)), F.col("key") == F.col("clashing"), "left").where("right is null or right = check")
    return at.where(F.col("place") != F.col("kept")).select(document("place").alias("id"), "version", number("place").alias("number"))


def _flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of line numbers, the third column, as a byte for each line up to the last of them, 1 for those listed; and how many they are."""
    for batch in batches:
        flags = []
        for numbers in batch.column(2):
            at = numbers.values.to_numpy()
            own = np.zeros(at.max(initial=-1) + 1, np.uint8)
            own[at] = 1
            flags.append(own.tobytes())
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(flags, pa.binary()), pc.list_value_length(batch.column(2)).cast(pa.int64())], ["_objsql_id", "_objsql_version", "_objsql_gone", "_objsql_count"])


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, similarity: float = SIMILARITY, count_col: str | None = None) -> DataFrame:
    """The rows of ``docs`` with repeated lines taken out of ``text_col``; ``count_col``, if given, is added with the number of lines taken out, in place of a column of that name.

    - Lines are \\n-split. Lines with equal normalised words are repeats; lines
      of fewer than ``min_words`` words only if their digits are equal, too.
      Lines without a word always stay.
    - Lines of ``min_words`` words or more are also linked, maybe through others,
      when they meet in a block of their SimHashes and have an edit similarity
      (1 - distance / longer length) of ``similarity``.
    - Of each group the occurrence with the least (id, line number) stays.
    - Null text stays null; an empty text stays empty. A text that loses all
      its lines becomes empty; its row stays.
    - A row with a null id is left alone. Rows that repeat an id are one
      document: their equal lines at equal places stay or go together.
    - All columns come out as they went in, whatever their names. An empty
      table gives an empty table. Ids must be integers.
    """
    gone = repeated_lines(docs, id_col, text_col, min_words, similarity)
    by_doc = gone.groupBy(F.col("id").alias("_objsql_id"), F.col("version").alias("_objsql_version")).agg(F.collect_set("number").alias("_objsql_gone"))
    by_doc = settled(by_doc.mapInArrow(lean(_flags), "_objsql_id long, _objsql_version long, _objsql_gone binary, _objsql_count long"))
    names = [c for c in docs.columns if c != count_col]
    docs = docs.select(*names)
    here = (docs[id_col].cast("long") == F.col("_objsql_id")) & (F.xxhash64(docs[text_col].cast("string")) == F.col("_objsql_version"))
    joined = docs.join(small_side(by_doc), here, "left")
    # A line's flag is looked up by its place, so that a text costs as much as it has lines.
    stays = F.filter(F.split(docs[text_col], "\n", -1), lambda _, n: F.col("_objsql_gone").substr(n + 1, F.lit(1)) != F.lit(b"\x01"))
    text = F.when(F.col("_objsql_gone").isNull(), docs[text_col]).otherwise(F.array_join(stays, "\n")).cast(docs.schema[text_col].dataType)
    columns = [text.alias(c) if c == text_col else docs[c] for c in names]
    return joined.select(*columns, *([F.coalesce("_objsql_count", F.lit(0)).cast("long").alias(count_col)] if count_col else []))
