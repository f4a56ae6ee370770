"""Fuzzy line dedup by MinHash, in DataFrame functions only.

Lines are compared without blanks at their ends. The similarity is Jaccard's of the sets of a line's 5-character shingles, and all
signatures are of these sets, for lines of any length: under each of ORDERS orders of hashes, the least hash that a line has. Two lines
agree on each of these with a probability that is their similarity. A group's orders are of one hash, seen from several points far apart
(by XOR), so that lines of more than a few shingles have other ones as the least of each; the groups are independent. Bands join five of
them, one of each of five groups, so that any two bands have at most one in common; lines with a similarity of 0.75 share a band with a
chance of 0.99, of 0.8 of 0.998, short lines more often, and unrelated lines hardly ever do. (The chances are of a simulation of the hashes.)

A line's shingles are made as rows, eight at a time, and its signature is one aggregation of least values, so all of it is compiled code,
and runs where the text has been shuffled to. Later on, the lines that are asked for are broadcast as bits, so texts aren't shuffled for them.
Bands are dealt out a quarter at a time: the lines of each value that several lines have are listed, and compared with the first line
of the list, which joins most of a group of near copies with as many candidates as members. Lists that aren't one component then go on in
turns, in each of which a few lines outside a list's largest component are compared with all of the list and leave it, WIDER times as many
as in the turn before, until what is left of the list is one component. So all lines of a list that no link joins are compared, and
a group of near copies takes one comparison or two for each of its lines.
Within the join that makes them, only candidates get through that agree in four bits of 32 least values as often as similar ones practically
always do, and whose outlines differ in no more cells than similar ones can: each shingle turns over one of 64 * WORDS cells, so each cell in
which two lines differ stands for a shingle that only one of them has. This second test loses nothing, and few pairs under the least
similarity pass it, so a group of near copies that isn't one component no longer has its pairs tested one by one. The exact Jaccard similarity of
all shingles decides, once for each pair, however many lists it shares. The shingles of lines that are in many pairs are made once and held by
each executor, up to a bound. A distributed union-find gives the components, and the first line of each, by doc_id and line number, stays.

Equal lines meet as hashes of 128 bits and are one line from the start.

Defined results: null text is one empty line; blank lines stay; lines under five code points are only removed as exact copies; rows
with a null doc_id are neither compared nor changed; a row that repeats doc_id and text shares its decisions and doesn't
remove its own lines; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, cut, drop

#: Code points of a shingle; least similarity in per cent.
SHINGLE, T100 = 5, 75
#: Groups of orders, orders of a group (a prime), and turns of bands: a turn's bands have no order in common.
GROUPS, SIDE, TURNS = 5, 7, 4
ORDERS = GROUPS * SIDE
BANDS = [[[g * SIDE + (i + g * turn) % SIDE for g in range(GROUPS)] for i in range(SIDE)] for turn in range(TURNS)]
#: The orders of a group are of one hash, by what is left of it after XOR with these, whose first three bits tell them apart.
SALTS = [[(i << 29 | random.Random(300 + g * SIDE + i).getrandbits(29)) - (1 << 31) for i in range(SIDE)] for g in range(GROUPS)]
#: Of the CHECKED least values, two lines of the least similarity agree on 24.5 on average, and on fewer than AGREE with a chance of 1e-5.
CHECKED, AGREE = 32, 14
#: Words of 64 cells of a line's outline, a power of two.
WORDS = 16
#: Shingles of a row that makes the signatures; lines of a list that one turn settles; growth of the number of centres by turns.
AT_ONCE, SHORT, WIDER = 8, 64, 64
#: The shingles of lines that are in so many pairs or more are made once and held by each executor; so many code points, most frequent lines first.
AGAIN, HELD = 6, 1 << 20
#: Blocks of 64 lines, as words of bits, that are broadcast at once to find the rows of some lines.
BLOCKS = 1 << 18
ENDS = " \t\n\x0b\x0c\r"
STRETCH = rf"(?s)(?=(.{{{SHINGLE},{AT_ONCE + SHINGLE - 1}}})).{{1,{AT_ONCE}}}"


def pieces(line: Column) -> Column:
    """Stretches of a line that hold its shingles, up to AT_ONCE each; none of a line that has none."""
    return F.regexp_extract_all(line, F.lit(STRETCH), F.lit(1))


def hashed(piece: Column) -> list[Column]:
    """The hashes of the shingles of a stretch; the last one again and again where it has fewer than AT_ONCE."""
    last = F.length(piece) - (SHINGLE - 1)
    return [F.xxhash64(F.substring(piece, F.least(F.lit(i + 1), last) if i else F.lit(1), F.lit(SHINGLE))) for i in range(AT_ONCE)]


def shingles(line: Column) -> Column:
    """The hashes of a line's shingles, repeated ones too."""
    return F.flatten(F.transform(pieces(line), lambda x: F.array(*hashed(x))))


def signatures(texts: DataFrame, *keys: str) -> DataFrame:
    """(keys, s1, s2, bands0, bands1, ...) of lines (keys, line) that have shingles: four bits of each checked value, and the bands by turn.
    keys: what tells lines apart, rep by default."""
    keys, each = keys or ("rep",), range(AT_ONCE)
    rows = texts.select(*keys, F.explode(pieces(F.col("line"))).alias("x"))
    rows = rows.select(*keys, *[h.alias(f"h0_{i}") for i, h in enumerate(hashed(F.col("x")))])
    rows = rows.withColumns({f"h1_{i}": F.xxhash64(f"h0_{i}") for i in each})
    # 32 bits of two hashes for each group: unrelated shingles share them with a chance of 2e-10.
    parts = [(k, bit) for k, bit in ((0, 0), (0, 32), (1, 0), (1, 32), (0, 16))]
    rows = rows.select(*keys, *[F.shiftright(F.shiftleft(f"h{k}_{i}", bit), 32).cast("int").alias(f"g{g}_{i}") for g, (k, bit) in enumerate(parts) for i in each])
    least = [F.least(*[F.col(f"g{g}_{i}").bitwiseXOR(F.lit(salt)) for i in each]) for g in range(GROUPS) for salt in SALTS[g]]
    made = rows.groupBy(*keys).agg(*[F.min(x).alias(f"m{k}") for k, x in enumerate(least)])
    bits = [F.shiftleft(F.xxhash64(f"m{k}").bitwiseAND(F.lit(15)), 4 * (k % 16)) for k in range(CHECKED)]
    some = [reduce(Column.bitwiseOR, bits[lo : lo + 16]).alias(f"s{1 + lo // 16}") for lo in range(0, CHECKED, 16)]
    # 40 bits of a band's hash: what meets by chance is only compared.
    bands = [F.array(*[F.shiftrightunsigned(F.xxhash64(F.lit(n * SIDE + i), *[f"m{k}" for k in band]), 24) for i, band in enumerate(turn)]).alias(f"bands{n}") for n, turn in enumerate(BANDS)]
    return made.select(*keys, *some, *bands)


def outlines(texts: DataFrame) -> DataFrame:
    """(rep, n, w0, w1, ...) of lines (rep, line) that have shingles: how many distinct ones, and which cells an odd number of them falls into."""
    rows = texts.select("rep", F.explode(F.array_distinct(shingles(F.col("line")))).alias("h"))
    cell = f"shiftleft(1L, int(shiftrightunsigned(h, {WORDS.bit_length() - 1}) & 63L))"
    words = [F.bit_xor(F.expr(f"if((h & {WORDS - 1}L) = {k}L, {cell}, 0L)")).alias(f"w{k}") for k in range(WORDS)]
    return rows.groupBy("rep").agg(F.count("*").alias("n"), *words)


def alike(names: list[str], a: str, b: str) -> Column:
    """Whether the checked values s1, s2 of two lines agree often enough and, where there are outlines among the columns names, these
    differ in few enough cells; a and b: what comes before the names of each line's columns."""

    def differ(x: str) -> Column:
        return F.col(f"{a}{x}").bitwiseXOR(F.col(f"{b}{x}"))

    def values(x: Column) -> Column:
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        return F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))

    agree = values(differ("s1")) + values(differ("s2")) <= CHECKED - AGREE
    if "n" not in names:
        return agree
    # Of sets with |A| + |B| shingles, J >= T means that at most (|A| + |B|) * (1 - T) / (1 + T) are in one of them only.
    cells = reduce(Column.__add__, [F.bit_count(differ(f"w{k}")) for k in range(WORDS)])
    return agree & (cells * (100 + T100) <= (F.col(f"{a}n") + F.col(f"{b}n")) * (100 - T100))


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, t, no, line) of each line that isn't blank; t tells texts of one doc_id apart."""
    docs = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("t"), F.posexplode(F.split("text", "\n")).alias("no", "line"))
    return docs.withColumn("line", F.btrim("line", F.lit(ENDS))).where("line <> ''")


def lists(signed: DataFrame) -> DataFrame:
    """(value, rep, first) of each value of a band that several lines have, the least rep of them being the first."""
    found, same = [], Window.partitionBy("value")
    for turn in range(TURNS):
        posted = signed.where("s1 IS NOT NULL").select("rep", F.explode(f"bands{turn}").alias("value"))
        posted = posted.select("value", "rep", F.min("rep").over(same).alias("first"), F.max("rep").over(same).alias("last"))
        found.append(cut(posted.where("first < last").drop("last")))
    return reduce(DataFrame.union, found)


def within(table: DataFrame, reps: DataFrame) -> DataFrame:
    """The rows of table whose rep is among reps, in a written table. The lines are broadcast as bits, BLOCKS words at once, so the table
    isn't shuffled; reps come from monotonically_increasing_id, so they are dense in each of its partitions."""
    blocks = cut(reps.groupBy(F.shiftright("rep", 6).alias("block")).agg(F.bit_or(F.expr("shiftleft(1L, int(rep & 63L))")).alias("word")))
    ranges, held = [], BLOCKS
    for part, n in sorted(blocks.groupBy(F.shiftright("block", 27)).count().collect()):
        if held + n > BLOCKS:
            ranges.append([part, part])
            held = 0
        ranges[-1][1], held = part, held + n
    found = []
    for lo, hi in ranges or [[0, 0]]:
        some = F.broadcast(blocks.where(F.col("block").between(lo << 27, (hi + 1 << 27) - 1)))
        own = table.where(F.col("rep").between(lo << 33, (hi + 1 << 33) - 1))
        own = own.join(some, F.shiftright("rep", 6) == F.col("block")).where("(shiftrightunsigned(word, int(rep & 63L)) & 1L) = 1L")
        found.append(cut(own.select(*table.columns)))
    drop(blocks)
    return reduce(DataFrame.union, found)


def side(df: DataFrame, name: str) -> DataFrame:
    """df with its rep as name, and name before the other columns."""
    return df.select(F.col("rep").alias(name), *(F.col(x).alias(f"{name}_{x}") for x in df.columns if x != "rep"))


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of lines (rep, line) whose exact similarity is high enough, as links (u, v)."""
    often = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n")).where(F.col("n") >= AGAIN)
    often = cut(often.select("rep", F.log2("n").cast("int").alias("times")))
    # Lines have SHINGLE code points at least, so these are all that can be held; they are few, and the texts aren't shuffled for them.
    least = fitting(often, F.count("*") * SHINGLE)
    if least is not None:
        few = cut(texts.join(F.broadcast(often.where(F.col("times") >= least)), "rep"))
        drop(often)
        often, least = few, fitting(few, F.sum(F.length("line")))
    if least is None:
        drop(often)
        return apiece(pairs, texts)
    sets = cut(often.where(F.col("times") >= least).select("rep", F.array_distinct(shingles(F.col("line"))).alias("set")))
    drop(often)
    for x in "ab":
        pairs = pairs.join(F.broadcast(sets.select(F.col("rep").alias(x), F.lit(True).alias(f"{x}_held"))), x, "left")
    both = F.col("a_held").isNotNull() & F.col("b_held").isNotNull()
    return among(pairs.where(both).select("a", "b"), sets).union(apiece(pairs.where(~both).select("a", "b"), texts))


def fitting(often: DataFrame, size: Column) -> int | None:
    """The least of often's times from which on the sizes of all lines are HELD at most together, if there is one."""
    least, held = None, 0
    for times, n in sorted(often.groupBy("times").agg(size).collect(), reverse=True):
        if (held := held + n) > HELD:
            break
        least = times
    return least


def apiece(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """What verified gives, each pair with the shingles of its own two lines."""
    texts = within(texts.select("rep", "line"), pairs.select(F.explode(F.array("a", "b")).alias("rep")))
    near = pairs.join(side(texts, "b"), "b").join(side(texts, "a"), "a")
    # As rows of a generator, sets are made once however often they are used.
    sets = F.struct(*(F.array_distinct(shingles(F.col(f"{x}_line"))).alias(name) for x, name in (("a", "p"), ("b", "q"))))
    return similar(near.select("a", "b", F.inline(F.array(sets))))


def among(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """What verified gives, for pairs of lines whose sets of shingles (rep, set) all tasks get."""
    for x, name in (("b", "q"), ("a", "p")):
        pairs = pairs.join(F.broadcast(sets), F.col(x) == F.col("rep")).select(*pairs.columns, F.col("set").alias(name))
    return similar(pairs)


def similar(pairs: DataFrame) -> DataFrame:
    """The pairs (a, b, p, q) whose sets of shingles p and q are similar enough, as links (u, v)."""
    # The sizes of both sets are the intersection's and the union's together.
    enough = F.size(F.array_intersect("p", "q")) * (100 + T100) >= (F.size("p") + F.size("q")) * T100
    return pairs.where(enough).select(F.col("a").alias("u"), F.col("b").alias("v"))


def apart(members: DataFrame, joined: DataFrame) -> DataFrame:
    """Those of members (value, rep) whose lists hold several components (u, v), with comp, their list's largest component, its number of
    lines cnt and of lines outside that component."""
    members = members.join(joined.select(F.col("u").alias("rep"), "v"), "rep", "left").withColumn("comp", F.coalesce("v", "rep")).drop("v")
    parts = members.groupBy("value", "comp").agg(F.count("*").alias("n"))
    mixed = parts.groupBy("value").agg(F.max(F.struct("n", "comp")).alias("most"), F.sum("n").alias("cnt"), F.count("*").alias("parts")).where("parts > 1")
    mixed = cut(mixed.select("value", "cnt", F.col("most.comp").alias("largest"), (F.col("cnt") - F.col("most.n")).alias("others")))
    out = cut(members.join(mixed, "value"))
    drop(mixed)
    return out


def is_centre(width: int) -> Column:
    """Whether a member of a list is compared with all of it in this turn: about width of the lines outside the largest component,
    all of these in short lists."""
    dealt = F.pmod(F.xxhash64("value", "rep", F.lit(width)), F.col("others")) < width
    return (F.col("comp") != F.col("largest")) & ((F.col("cnt") <= SHORT) | dealt)


def starred(members: DataFrame, width: int, marks: DataFrame) -> DataFrame:
    """Candidates (a, b): the members of each list against its centres in other components. marks: rep, s1, s2 and perhaps outlines,
    which are joined here only, so that no other shuffle carries them for each list that a line is in."""
    names = [x for x in marks.columns if x != "rep"]
    centres = members.where(is_centre(width)).select("value", "rep", "comp").join(marks, "rep")
    centres = centres.select("value", *(F.col(x).alias(f"c_{x}") for x in ("rep", "comp", *names)))
    members = members.select("value", "rep", "comp").join(marks, "rep")
    found = members.join(centres, "value").where("comp <> c_comp").where(alike(names, "", "c_"))
    return found.select(F.least("rep", "c_rep").alias("a"), F.greatest("rep", "c_rep").alias("b"))


def linked(listed: DataFrame, signed: DataFrame, texts: DataFrame, outlined: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Components (u, v) of the lines in lists (value, rep, first); signed: (rep, s1, s2), texts: (rep, line) of these lines. outlined
    makes the outlines of lines, if these are to thin out candidates; only lines of lists that aren't one component get them."""
    pairs = listed.where("rep <> first").select(F.col("first").alias("a"), F.col("rep").alias("b")).distinct()
    pairs = pairs.join(side(signed, "b"), "b").join(side(signed, "a"), "a")
    found, *tested = checked(pairs.where(alike(["s1", "s2"], "a_", "b_")).select("a", "b"), texts)
    joined, width = components(found), 1
    members = apart(listed.where("rep <> first").select("value", "rep"), joined)
    few = cut(members.select("rep").distinct())
    marks, texts = within(signed, few), within(texts, few)  # each turn reads these only
    if outlined:
        marks = cut(marks.join(outlined(texts), "rep"))
    drop(few)
    while not members.isEmpty():
        before = found
        found, now = checked(starred(members, width, marks), texts, *tested)
        tested.append(now)
        if not found.isEmpty():
            joined, plain = components(joined.union(found)), joined
            drop(plain)
        # Centres have met all of their lists and leave them.
        left, members = members, apart(members.where(~is_centre(width)).select("value", "rep"), joined)
        drop(before, left)
        width *= WIDER
    drop(found, marks, texts, *tested)
    return joined


def checked(pairs: DataFrame, texts: DataFrame, *tested: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The links (u, v) among pairs (a, b), and those pairs that were not tested before: lists share many."""
    pairs = pairs.distinct()
    pairs = cut(pairs.join(reduce(DataFrame.union, tested), ["a", "b"], "left_anti") if tested else pairs)
    return cut(verified(pairs, texts)), pairs


def removed(docs: DataFrame) -> DataFrame:
    """(doc_id, t, lines): the numbers, from 0, of the lines to remove."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    h = [F.xxhash64("line").alias("h1"), F.xxhash64("line", F.lit(1)).alias("h2")]
    lines = lines_of(docs).select("doc_id", "t", "no", *h, "line")
    places = cut(lines.drop("line"))
    distinct = lines.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "no")).alias("first"), F.count("*").alias("cnt"), F.first("line").alias("line"))
    # The signatures are made where a line's text has been shuffled to, and join it there; first and cnt make that the same shuffle.
    signed = signatures(distinct, "h1", "h2", "first", "cnt").drop("first", "cnt")
    distinct = cut(distinct.join(signed, ["h1", "h2"], "left").withColumn("rep", F.monotonically_increasing_id()))
    listed = lists(distinct)
    some = within(distinct.select("rep", "s1", "s2", "line"), listed.select("rep"))
    joined = linked(listed, some.select("rep", "s1", "s2"), some.select("rep", "line"), outlines)
    known = distinct.select("rep", "h1", "h2", "first", "cnt").join(joined.withColumnRenamed("u", "rep"), "rep", "left")
    known = known.join(joined.select(F.col("v").alias("rep"), F.lit(True).alias("root")).distinct(), "rep", "left")
    known = known.where("cnt > 1 OR v IS NOT NULL OR root").withColumn("comp", F.coalesce("v", "rep"))
    keep = cut(known.groupBy("comp").agg(F.min("first").alias("keep")))
    known = cut(known.select("h1", "h2", "comp").join(keep, "comp").select("h1", "h2", "keep"))
    gone = places.select("doc_id", "t", "no", "h1", "h2").join(known, ["h1", "h2"])
    gone = gone.where((F.col("doc_id") != F.col("keep.doc_id")) | (F.col("no") != F.col("keep.no")))
    return gone.groupBy("doc_id", "t").agg(F.sort_array(F.collect_set("no")).alias("lines"))


def line_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, removed_lines (numbers from 0, joined by commas) of each row of docs (doc_id, text)."""
    text = F.coalesce("text", F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"))
    out = own.join(cut(removed(docs)), ["doc_id", "t"], "left")
    n = F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines"))
    return out.select("doc_id", "n_lines", n.cast("long").alias("n_removed"), F.coalesce(F.array_join("lines", ","), F.lit("")).alias("removed_lines"))


def without_lines(docs: DataFrame) -> DataFrame:
    """docs with the lines that stay as text; texts that lose nothing are unchanged, other columns too."""
    names = docs.columns
    gone = removed(docs).select(F.col("doc_id").alias("__doc"), F.col("t").alias("__t"), F.col("lines").alias("__gone"))
    out = docs.join(gone, (F.col("doc_id").cast("long") == F.col("__doc")) & (F.xxhash64("text") == F.col("__t")), "left")
    left = F.filter(F.split("text", "\n"), lambda line, no: ~F.array_contains("__gone", no))
    return out.withColumn("text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))).select(*names)
