"""Operator 4, line dedup: a segment-partition edit join, in DataFrame functions alone.

A line of at least `min_chars` characters goes if an equal line, or one within `max_edits` edits,
occurs earlier; order is by doc_id, then line number. A shorter line goes only if it has at least
`short_words` words and an equal line occurs earlier. The rest of the text stays as it is.

1. Equal lines meet by a 128-bit hash, without their texts; a line with copies keeps its first place
   and its count. Half of the hash names a line while pairs are sought. Of the most frequent lines, as
   many as may be broadcast, only the first copy makes keys; other copies make the same keys, once each.
2. A distinct line holds max_edits + 1 segments of one size, the first half of them counted from its
   start, the others from its end. Of two lines within max_edits edits, some segment i of the shorter
   one lies unchanged in the longer one, with exactly i edits before it (or none, for i = 0) and at
   most max_edits - i behind it: so a line probes the index of segments only i places around that
   place. The size depends on the length, and changes so rarely that a line has one or two of them.
   What is shuffled is a key, a name and a byte; texts follow only for lines that share a key.
3. Pairs that share a key are verified by a banded bit-parallel automaton: for each number of errors
   a lane of 2 * max_edits + 1 bits, a bit a diagonal, all lanes in one word.
4. A key that many lines share gives no pairs. Its lines are compared with the earliest of them, which
   settles lines of one family; where unsettled ones remain, the key is made longer: what is left of
   the line before or behind the segment, with the edits left for it, is cut into segments again. So
   templated lines meet only where nearly all of them is equal. After LEVELS rounds what is still
   shared by many is paired as it is, unsettled lines with all others.

Defined cases: null text stays null and has no lines; lines shorter than min_chars, empty ones too,
are left alone but for `short_words`; rows with a null doc_id come last in the order; rows equal in doc_id and text are one
document, and all of them stay with the same text; other columns pass through, whatever their names;
a document may end with an empty text.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecloom.llm.common import BROADCAST_BYTES, drop_stored, maybe_broadcast, stored

MIN_CHARS, MAX_EDITS, SHORT_WORDS = 40, 3, 3
#: Lines of a key up to which all its pairs are made, and rounds in which keys of more are made longer.
HOT, LEVELS = 2048, 4
WORD = r"[^ \t\n\f\r\x0B]+"
#: Two groups of eight letters, whose counts fit a long each.
LETTERS = ("eantoirs", "dlucmpgh")
LAST = (1 << 63) - 1
#: Deletes an execution's shuffle files as soon as it ends, not once the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def letter_counts(line: Column, letters: str) -> Column:
    """Counts of eight letters, at most 127 each, in one long."""
    out = F.lit(0).cast("long")
    for i, c in enumerate(letters):
        n = F.least(F.lit(127), F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c), F.lit(""))))
        out = out.bitwiseOR(F.shiftleft(n.cast("long"), 8 * i))
    return out


def letters_apart(a: Column, b: Column) -> Column:
    each = [F.abs(F.shiftrightunsigned(a, 8 * i).bitwiseAND(127) - F.shiftrightunsigned(b, 8 * i).bitwiseAND(127)) for i in range(8)]
    return sum(each[1:], each[0])


def pair_parities(line: Column) -> list[Column]:
    """128 parities, in two longs: whether the pairs of neighbouring characters that fall into a slot are odd in number."""
    # in an array of one, so that the characters are split once
    slots = F.element_at(F.transform(F.array(F.split(line, "")), lambda cs: F.transform(F.slice(cs, 1, F.size(cs) - 1), lambda c, i: F.xxhash64(c, F.get(cs, i + 1)).bitwiseAND(127).cast("int"))), 1)
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")

    def lane(k: int) -> Column:
        return F.aggregate("slots", none, lambda acc, b: F.when(F.shiftright(b, 6) == k, acc.bitwiseXOR(F.call_function("shiftleft", one, b.bitwiseAND(63)))).otherwise(acc))

    return [slots.alias("slots"), lane(0), lane(1)]


def may_be_near(a: str, b: str, edits: int) -> Column:
    """What lines within `edits` edits fulfil: an edit changes two letter counts by one, and four pairs, at most."""
    apart = F.bit_count(F.col(f"{a}.p0").bitwiseXOR(F.col(f"{b}.p0"))) + F.bit_count(F.col(f"{a}.p1").bitwiseXOR(F.col(f"{b}.p1")))
    return (F.abs(F.col(f"{a}.n") - F.col(f"{b}.n")) <= edits) & (apart <= 4 * edits) & (letters_apart(F.col(f"{a}.l0"), F.col(f"{b}.l0")) + letters_apart(F.col(f"{a}.l1"), F.col(f"{b}.l1")) <= 2 * edits)


def segment_size(length: Column, edits: int) -> Column:
    """Characters of a segment: edits + 1 of them fit, and lengths that differ by up to `edits` have two sizes at most."""
    step = 4 * (edits + 1)
    return F.when(length >= 2 * step, 4 * F.floor(length / step)).otherwise(F.floor(F.greatest(length, F.lit(0)) / (edits + 1))).cast("int")


def segment_places(edits: int) -> list[tuple[int, bool, int]]:
    """(segment, whether it is counted from the end, move): where a probe looks for each segment."""
    first = [(i, False, move) for i in range(edits + 1) if 2 * i <= edits for move in range(-i, i + 1)]
    return first + [(i, True, move) for i in range(edits + 1) if 2 * i > edits for move in range(i - edits, edits - i + 1)]


def places_of(edits: int) -> Column:
    return F.array(*[F.struct(F.lit(p).alias("p"), F.lit(i).alias("i"), F.lit(end).alias("end"), F.lit(move).alias("move")) for p, (i, end, move) in enumerate(segment_places(edits))])


def sizes_of(size: Column, edits: int, least: int) -> list[Column]:
    return [segment_size(size, edits), segment_size(F.greatest(size - edits, F.lit(least)), edits)]


def segment_start(at: Column, s: Column, lo: Column, hi: Column, edits: int) -> Column:
    i, move = at["i"], at["move"]
    return F.when(at["end"], hi - (edits + 1 - i) * s + move).otherwise(lo + i * s + move).cast("int")


def what_is_left(at: Column, s: Column, start: Column, lo: Column, hi: Column, edits: int) -> dict[str, Column]:
    return {"lo": F.when(at["end"], lo).otherwise(start + s), "hi": F.when(at["end"], start).otherwise(hi), "left": F.when(at["end"], at["i"]).otherwise(edits - at["i"]).cast("tinyint")}


def segment_keys(rows: DataFrame, edits: int, least: int, deeper: bool) -> DataFrame:
    """Rows (key, id, n, idx, lo, hi, line), in which line[lo:hi] is still to be matched with `edits` edits,
    -> a row for each segment and place: longer key, idx (whether it is in the index) and what is left.

    In a whole line the probe is the longer one, and the row is (key, id, tag), for placed(); in a part
    of it, either may be.
    """
    size = F.col("hi") - F.col("lo")
    sizes = sizes_of(size, edits, least) + [segment_size(size + edits, edits)] * deeper
    cut = rows.select("*", F.posexplode(F.array_distinct(F.array(*sizes))).alias("other", "s")).withColumn("at", F.explode(places_of(edits)))
    at, s, start = F.col("at"), F.col("s"), F.col("start")
    there = cut.withColumn("start", segment_start(at, s, F.col("lo"), F.col("hi"), edits)).where((start >= F.col("lo")) & (start + s <= F.col("hi")))
    key = F.xxhash64("key", F.lit(edits), s, at["i"], F.substring("line", start + 1, s)).alias("key")
    idx = F.col("idx") & (at["move"] == 0) & (s == segment_size(size, edits))
    if not deeper:
        return there.select(key, "id", (at["p"] * 4 + F.col("other") * 2 + idx.cast("int")).cast("tinyint").alias("tag"))
    left = what_is_left(at, s, start, F.col("lo"), F.col("hi"), edits)
    return there.select(key, "id", "n", idx.alias("idx"), *[c.alias(k) for k, c in left.items()], F.lit(0).cast("tinyint").alias("nth"))


def placed(rows: DataFrame, edits: int, least: int) -> DataFrame:
    """Rows (key, id, tag, n) of whole lines, with what their tags say: lo, hi, left, nth."""
    at = F.get(places_of(edits), F.shiftright(F.col("tag").cast("int"), 2))
    first, second = sizes_of(F.col("n"), edits, least)
    # explode makes a column of the place and the size
    cut = rows.withColumn("cut", F.explode(F.array(F.struct(at.alias("at"), F.when(F.col("tag").bitwiseAND(F.lit(2)) > 0, second).otherwise(first).alias("s")))))
    at, s, n = F.col("cut.at"), F.col("cut.s"), F.col("n")
    left = what_is_left(at, s, segment_start(at, s, F.lit(0), n, edits), F.lit(0), n, edits)
    return cut.withColumns(left | {"nth": at["i"].cast("tinyint")}).drop("cut", "tag")


def shared_keys(keys: DataFrame) -> DataFrame:
    """Keys of several lines, at least one of them in the index, with the numbers of rows in the index (ni) and in all (nt)."""
    w = Window.partitionBy("key")
    some = keys.withColumns({"least": F.min("id").over(w), "most": F.max("id").over(w)}).where("least != most").drop("least", "most").distinct()
    if "tag" in keys.columns:
        some = some.withColumn("idx", F.col("tag").bitwiseAND(F.lit(1)) == 1)
    return some.withColumns({"ni": F.count_if("idx").over(w), "nt": F.count("*").over(w)}).where("ni > 0")


def own_segments(line: Column, length: Column, edits: int) -> Column:
    """Hashes of a whole line's segments at their own places."""
    s = segment_size(length, edits)
    start = lambda i: i * s if 2 * i <= edits else length - (edits + 1 - i) * s
    return F.array(*[F.xxhash64(s, F.substring(line, start(i) + 1, s)) for i in range(edits + 1)])


def within_edits(ca: Column, cb: Column, edits: int) -> Column:
    """Whether two arrays of characters are within `edits` edits: a banded automaton, bit-parallel over
    diagonals and numbers of errors.

    The arrays have to be columns: an expression would be evaluated anew in every step. After j
    characters of b, bit d + edits of lane e says whether j + d characters of a match them with e
    errors at most.
    """
    if not 0 <= edits <= 4:
        raise ValueError("the lanes of up to 4 edits fit one word")
    na, nb, width, lanes = F.size(ca), F.size(cb), 2 * edits + 2, edits + 1
    every = lambda bits: sum(bits << (width * e) for e in range(lanes))
    full = every((1 << (2 * edits + 1)) - 1)
    bit = lambda j, c, d: F.when(F.get(ca, j + d) == c, F.lit(1 << (d + edits)).cast("long")).otherwise(F.lit(0).cast("long"))
    match = F.transform(cb, lambda c, j: reduce(Column.bitwiseOR, [bit(j, c, d) for d in range(-edits, edits + 1)]) * F.lit(every(1)).cast("long"))
    wide = lambda x: F.lit(x).cast("long")
    # before b: d characters of a match nothing with d errors
    start = sum(sum(1 << (edits + d) for d in range(e + 1)) << (width * e) for e in range(lanes))

    def step(old: Column, m: Column) -> Column:
        up = F.shiftleft(old, width)  # one more error: a character of b is extra, or another
        new = old.bitwiseAND(m).bitwiseOR(up).bitwiseOR(F.shiftright(up, 1)).bitwiseAND(wide(full))
        for _ in range(edits):  # characters of a that b lacks, one more in each round
            new = F.element_at(F.transform(F.array(new), lambda w: w.bitwiseOR(F.shiftleft(w, width + 1).bitwiseAND(wide(full)))), 1)
        return new

    end = F.aggregate(match, wide(start), step)
    return (F.abs(na - nb) <= edits) & (F.call_function("shiftright", end, F.greatest(F.lit(0), na - nb + edits) + width * edits).bitwiseAND(wide(1)) == 1)


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64("text").alias("th"), F.split("text", "\n").alias("lines"))


def hashed_lines(docs: DataFrame) -> DataFrame:
    line = F.col("line")
    lines = _documents(docs).select("doc", "th", F.posexplode("lines").alias("pos", "line"))
    return lines.select("*", F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2"))


def later_lines(texts: DataFrame, pairs: DataFrame, edits: int) -> DataFrame:
    """(id, h2): of each pair (a, b) of lines that are within `edits` edits, the later one."""
    side = lambda of: texts.select(F.col("id").alias(of), F.struct("first", "line", "id", "h2").alias(f"t{of}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b")
    chars = lambda line: F.transform(F.split(line, ""), lambda c: F.ascii(c))
    later = F.when(F.col("ta.first") < F.col("tb.first"), F.struct("tb.id", "tb.h2")).otherwise(F.struct("ta.id", "ta.h2"))
    # explode makes columns of the arrays
    cut = met.select(later.alias("later"), F.explode(F.array(F.struct(chars(F.col("ta.line")).alias("a"), chars(F.col("tb.line")).alias("b")))).alias("c"))
    cut = cut.select("later", F.col("c.a").alias("ca"), F.col("c.b").alias("cb"))
    return stored(cut.where(within_edits(F.col("ca"), F.col("cb"), edits)).select("later.id", "later.h2").distinct(), "late")


def most_frequent(many: DataFrame) -> DataFrame:
    """Of the lines with copies those with the most, as many as may be broadcast, by powers of two."""
    power, rows, least = F.length(F.bin("copies")), 0, 64
    for p, n in sorted(many.groupBy(power.alias("p")).count().collect(), reverse=True):
        if (rows + n) * 64 > BROADCAST_BYTES:
            break
        rows, least = rows + n, p
    return F.broadcast(many.where(power >= least).select("h1", "h2", F.col("first").alias("once")))


def near_lines(docs: DataFrame, many: DataFrame, edits: int, least: int) -> DataFrame:
    """(id, h2): both hashes of the lines of docs with at least `least` characters that are within edits of an earlier one.

    many: (h1, h2, first, copies) of lines that occur several times.
    """
    lines = hashed_lines(docs).where(F.char_length("line") >= least)
    once = lines.join(most_frequent(many), ["h1", "h2"], "left").where("once is null or struct(doc, th, pos) = once")
    n = F.char_length("line")
    pair = [F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b")]
    near = (F.col("a.id") != F.col("b.id")) & may_be_near("a", "b", edits)
    # the probe is the longer line, and a pair whose earlier segments are equal, too, comes from the first of them
    probe = (F.col("b.n") > F.col("a.n")) | ((F.col("b.n") == F.col("a.n")) & (F.col("a.id") < F.col("b.id")))
    before = reduce(Column.__or__, [(F.col("a.nth") > i) & (F.get("a.own", F.lit(i)) == F.get("b.own", F.lit(i))) for i in range(edits)])
    late, level, hot, texts = [], 0, None, None
    keys = segment_keys(once.select(F.lit(0).cast("long").alias("key"), F.col("h1").alias("id"), F.lit(True).alias("idx"), F.lit(0).alias("lo"), n.alias("hi"), "line"), edits, least, False)
    while True:
        level += 1
        met = stored(shared_keys(keys), "met")
        if texts is None:  # the lines that share a segment with another one
            ids = stored(met.select("id").distinct(), "ids")
            wanted = lines.join(maybe_broadcast(ids, ids.count(), 16), lines["h1"] == ids["id"], "left_semi")
            found = wanted.groupBy("h1", "h2").agg(F.min(F.struct("doc", "th", "pos", "line")).alias("f"))
            found = found.select(F.col("h1").alias("id"), "h2", F.struct("f.doc", "f.th", "f.pos").alias("first"), F.col("f.line").alias("line"))
            slots, p0, p1 = pair_parities(F.col("line"))
            texts = found.select("*", n.alias("n"), *[letter_counts(F.col("line"), c).alias(f"l{k}") for k, c in enumerate(LETTERS)], own_segments(F.col("line"), n, edits).alias("own"), F.explode(F.array(F.struct(slots))).alias("s")).select("*", F.col("s.slots").alias("slots"))
            texts = stored(texts.select("id", "h2", "first", "line", "n", "l0", "l1", "own", p0.alias("p0"), p1.alias("p1")), "texts")
            drop_stored(ids)
            met_ = placed(met.join(texts.drop("line"), "id"), edits, least)
        else:
            met_ = met.join(texts.drop("line", "n"), "id")
        is_hot = F.col("ni") * F.col("nt") > HOT * HOT
        members = met.where(is_hot).count()
        cold = met_.where(~is_hot)
        pairs = cold.where("idx").alias("a").join(cold.alias("b"), (F.col("a.key") == F.col("b.key")) & probe & near & ~before).select(*pair)
        if members:
            hot = stored(met_.where(is_hot), "hot")
            pivots = hot.groupBy("key").agg(F.min_by(F.struct("id", "n", "l0", "l1", "p0", "p1"), "first").alias("b"))
            led = hot.alias("a").join(maybe_broadcast(pivots, members // HOT, 64), F.col("a.key") == pivots["key"]).where(near)
            pairs = pairs.union(led.select(*pair))
        pairs = stored(pairs.distinct(), "pairs")
        late.append(later_lines(texts, pairs, edits))
        drop_stored(met, pairs)
        if not members:
            break
        settled = reduce(DataFrame.union, late).distinct()
        open_ = hot.join(maybe_broadcast(settled, sum(x.count() for x in late), 24), ["id", "h2"], "left_anti")
        rest = stored(hot.join(open_.select("key").distinct(), "key", "left_semi").join(texts.select("id", "h2", "line"), ["id", "h2"]), "rest")
        drop_stored(hot)
        if level == LEVELS:  # what is left: unsettled lines with all that share their key
            unsettled = rest.join(settled, ["id", "h2"], "left_anti")
            both = unsettled.alias("a").join(rest.alias("b"), (F.col("a.key") == F.col("b.key")) & near)
            pairs = stored(both.select(*pair).distinct(), "pairs")
            late.append(later_lines(texts, pairs, edits))
            drop_stored(pairs)
        if level == LEVELS or rest.isEmpty():
            drop_stored(rest)
            break
        keys = reduce(DataFrame.union, [segment_keys(rest.where(F.col("left") == e), e, 0, True) for e in range(1, edits + 1)])
    drop_stored(texts)
    return reduce(DataFrame.union, late).distinct()


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go when their execution ends; what is needed later is stored."""
    old = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if old is None else spark.conf.set(CLEANUP, old)


def removed_lines(docs: DataFrame, min_chars: int = MIN_CHARS, max_edits: int = MAX_EDITS, short_words: int | None = SHORT_WORDS) -> DataFrame:
    """(doc, th, gone): for each document that loses lines, their numbers from 0."""
    with shuffles_deleted(docs.sparkSession):
        length = F.char_length("line")
        taken = length >= min_chars if short_words is None else F.when(length >= min_chars, True).otherwise(F.regexp_count("line", F.lit(WORD)) >= short_words)
        wide = stored(hashed_lines(docs).where(taken).drop("line"), "lines")
        many = wide.groupBy("h1", "h2").agg(F.min(F.struct("doc", "th", "pos")).alias("first"), F.count("*").alias("copies")).where("copies > 1")
        many = stored(many, "many")
        ruled = many.select("h1", "h2", "first", F.lit(False).alias("late"))
        if max_edits > 0:
            late = stored(near_lines(docs, many, max_edits, min_chars).select(F.col("id").alias("h1"), "h2", F.lit(True).alias("late")), "later")
            ruled = ruled.drop("late").join(late, ["h1", "h2"], "full").withColumn("late", F.coalesce("late", F.lit(False)))
        ruled = stored(ruled, "ruled")
        gone = wide.join(maybe_broadcast(ruled, ruled.count(), 64), ["h1", "h2"]).where("late or struct(doc, th, pos) != first")
        out = stored(gone.groupBy("doc", "th").agg(F.collect_set("pos").alias("gone")), "gone")
        drop_stored(wide, many, ruled)
    return out


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, max_edits: int = MAX_EDITS, short_words: int | None = SHORT_WORDS) -> DataFrame:
    """docs with a text column without the removed lines; n_chars, where there is one, follows."""
    gone = removed_lines(docs, min_chars, max_edits, short_words)
    size = gone.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("gone")), F.lit(0)).alias("lines")).first()
    doc, th, lost = (f"{n}_{uuid.uuid4().hex}" for n in ("doc", "th", "gone"))  # names that no column of docs has
    keyed = docs.withColumns({doc: F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), th: F.xxhash64("text")})
    side = gone.select(F.col("doc").alias(doc), F.col("th").alias(th), F.col("gone").alias(lost))
    # in an array of one, so that the text is split once
    kept = F.element_at(F.transform(F.array(F.split("text", "\n")), lambda lines: F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(lost)), lambda i: F.get(lines, i))), 1)
    text = F.when(F.col(lost).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    out = keyed.join(maybe_broadcast(side, 1, size["rows"] * 56 + size["lines"] * 8), [doc, th], "left").withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.size(F.split("text", "\n")).cast("long").alias("n_lines"))
    done = dedup_lines(docs)
    return done.select("doc_id", "n_lines", F.char_length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


#: DuckDB's levenshtein counts bytes, so letters of two bytes are first put as control characters, one for one.
ORACLE = r"""
with l as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as pos from documents),
big as (select * from l where length(line) >= 40 or len(regexp_extract_all(line, '[^ \t\n\f\r\x0B]+')) >= 3),
firsts as (select line, length(line) as n, min((doc_id, pos)) as f, count(*) as copies from big group by 1, 2),
long as (select *, n - length(replace(line, 'e', '')) as e, n - length(replace(line, 'a', '')) as a, n - length(replace(line, 'n', '')) as m, n - length(replace(line, 't', '')) as t, n - length(replace(line, ' ', '')) as s, translate(line, 'éóèñüçäöêßíÉÈÑÓÇÊÜÖÄÍáàâîôûëïúÁÀ', (select string_agg(chr(i), '' order by i) from (select unnest([1,2,3,4,5,6,7,8,14,15,16,17,18,19,20,21,22,23,24,25,26,27,28,29,30,31,127,91,93,94,95,96]) as i))) as short from firsts where n >= 40),
-- an edit changes two counts by one at most
near as (select a.line as la, b.line as lb, a.f as fa, b.f as fb from long a join long b on b.n between a.n and a.n + 3 and (a.n < b.n or a.line < b.line)
  where abs(a.e - b.e) + abs(a.a - b.a) + abs(a.m - b.m) + abs(a.t - b.t) + abs(a.s - b.s) <= 6 and levenshtein(a.short, b.short) <= 3),
late as (select distinct case when fa < fb then lb else la end as line from near),
kept as (select l.doc_id, l.pos, l.line from l left join firsts f on l.line = f.line left join late t on l.line = t.line
  where f.line is null or (t.line is null and (l.doc_id, l.pos) = f.f)),
again as (select doc_id, string_agg(line, chr(10) order by pos) as text from kept group by 1)
select d.doc_id, cast(len(string_split(d.text, chr(10))) as bigint) as n_lines, case when d.text is not null then cast(length(coalesce(a.text, '')) as bigint) end as kept_chars, case when d.text is not null then sha256(coalesce(a.text, '')) end as kept_sha256
from documents d left join again a on d.doc_id = a.doc_id
"""
