"""The training-data operators against brute force, libraries and edge cases."""

import hashlib
import random
import re
import struct
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from clonoscope.llm import byte_bpe, common, exact_dedup, language_id, line_dedup, mixing, near_dedup, neighbours, suffix_dedup, suffix_order, token_counts, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, rep long, value string"
BLANK = re.compile(rb"[^\x20\x09-\x0D]+")


def words(rnd, n, alphabet="abcdefgh"):
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(2, 7))) for _ in range(n)]


def corpus(seed=0, n=120):
    """Rows with copies, near copies, shared passages, nulls, empty and long texts, ties, repeated rows and clashing columns."""
    rnd = random.Random(seed)
    passage = " ".join(words(rnd, 60))
    rows = []
    for i in range(n):
        kind = rnd.random()
        text = " ".join(words(rnd, rnd.randint(1, 80)))
        if rows and kind < 0.2:
            text = rnd.choice(rows)[1] or ""
        elif rows and kind < 0.45:
            w = (rnd.choice(rows)[1] or "x y z").split(" ")
            w[rnd.randrange(len(w))] = "changed"
            text = " ".join(w)
        elif kind < 0.6:
            text = text + " " + passage + "\n" + " ".join(words(rnd, 12))
        rows.append((i, text))
    rows += [(n, None), (n + 1, ""), (n + 2, " \n\t "), (n + 3, "é" * 30 + "　x"), (n + 4, "one two"), (n + 5, "ONE  two"), (n + 6, "one two three four"), (n + 7, " ".join(words(rnd, 9000)))]
    rows += [(n + 8, "on\x00e \x1c\x85 " + passage), (n + 9, "a" * 400), (n + 10, "a" * 120), (n + 11, "12345 !?"), (3, rows[3][1])]
    sources = ["web", "b", None, "", "web", "web"]
    return [(i, t, rnd.choice(["en", "xx", None]), sources[i % 6], 7, 1, 2, "v") for i, t in rows]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def with_null(spark):
    return spark.createDataFrame([(None, "the same text of more than five words and of over fifty bytes", None, None, None, None, None, None)] * 2 + [(7, "the same text of more than five words and of over fifty bytes", None, "s", 1, 1, 1, "x")], SCHEMA)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def oracle(sql, rows):
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", *"abcd"]))
    return sorted(con.sql(sql).fetchall(), key=repr)


# 5: exact dedup


def test_exact_dedup(docs, rows):
    assert collected(exact_dedup.exact_dedup(docs)) == oracle(exact_dedup.SQL, rows)


def test_exact_dedup_with_colliding_hashes(docs, rows):
    from pyspark.sql import functions as F

    assert collected(exact_dedup.exact_dedup(docs, lambda c: (F.length(c) % 7).cast("long"))) == oracle(exact_dedup.SQL, rows)


def test_exact_dedup_edges(nothing, with_null):
    assert collected(exact_dedup.exact_dedup(nothing)) == []
    got = collected(exact_dedup.exact_dedup(with_null))
    assert [r[:4] for r in got] == [(7, 7, 3, True), (None, 7, 3, False), (None, 7, 3, False)]


# 10: mixing


def test_mixing(docs, rows):
    assert collected(mixing.mix(docs)) == oracle(mixing.SQL, rows)


def test_mixing_in_many_slices(docs, rows, monkeypatch):
    monkeypatch.setattr(mixing, "SLICE", 2)
    assert collected(mixing.mix(docs)) == oracle(mixing.SQL, rows)


def test_mixing_meets_targets(spark):
    rnd = random.Random(1)
    rows = [(i, " ".join(["w"] * rnd.randint(1, 60)), None, rnd.choice("aaaaab") if i % 50 else "c", 0, 0, 0, "") for i in range(4000)]
    out = mixing.mix(spark.createDataFrame(rows, SCHEMA)).toPandas()
    by = out.groupby("source_size").agg(target=("target", "first"), taken=("taken", "sum"))
    assert (abs(by.taken - by.target) / by.target).max() < 0.03
    assert abs(by.target.sum() - out["size"].sum()) < 1e-6 * out["size"].sum()
    assert (out.taken <= 3 * out["size"]).all() and (by.target <= 3 * by.index + 1e-6).all()


def test_mixing_sampled_rows(docs, nothing, with_null):
    copies = {i: t for i, t in Counter(r["doc_id"] for r in mixing.sampled(docs).collect()).items()}
    from pyspark.sql import functions as F

    told = {r["doc_id"]: r["n"] for r in mixing.mixed(docs).groupBy("doc_id").agg(F.sum("copies").alias("n")).collect()}
    assert copies == {k: v for k, v in told.items() if v}
    assert mixing.sampled(docs).columns == docs.columns
    assert collected(mixing.mix(nothing)) == []
    assert len(collected(mixing.mix(with_null))) == 3


# 9 and 2: tokens


def texts():
    rnd = random.Random(5)
    pool = [chr(x) for r in ((9, 14), (28, 33), (32, 127), (0x80, 0x250), (0x2000, 0x2030), (0x4E00, 0x4E20), (0x1F600, 0x1F610), (0x660, 0x66A)) for x in range(*r)]
    made = ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 50))) for _ in range(400)]
    return made + ["ab<|endoftext|>c <|endoftext|>", " " * 500, "a" * 3000, "zq" * 2000, "don't we'll 123 \n\n x", ""]


def test_token_counts(spark, docs, nothing):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path("byte_bpe_50k.json"))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts())] + [(None, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.token_counts(df).collect()}
    for i, t in [*enumerate(texts()), (None, "")]:
        n = len(model.encode(t, add_special_tokens=False).ids)
        assert got[i] == (len(t.encode()), n, n > 1024)
    assert collected(token_counts.token_counts(nothing)) == []
    assert token_counts.token_counts(docs).count() == docs.count()


def test_byte_bpe(spark, nothing, docs):
    import tiktoken
    from public_tokenizers import PATTERN, path

    with open(path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        own = byte_bpe.codec(file.read(), PATTERN)
    model = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts())] + [(None, None)], "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in byte_bpe.round_trip(df).collect()}
    for i, t in [*enumerate(texts()), (None, "")]:
        ids = model.encode_ordinary(t)
        assert got[i] == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    packed = df.withColumn("ids", byte_bpe.encoded(df))
    assert all(bytes(r["back"]).decode() == (r["text"] or "") for r in packed.withColumn("back", byte_bpe.decoded(packed, "ids")).collect())
    assert collected(byte_bpe.round_trip(nothing)) == []
    assert byte_bpe.round_trip(docs).count() == docs.count()


def test_byte_bpe_pieces(monkeypatch):
    """Pieces of tokens put together are encoded as the library does; frequent pieces are encoded once, however many others come between."""
    import tiktoken
    from public_tokenizers import PATTERN, path

    with open(path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        own = byte_bpe.Codec(file.read(), PATTERN)
    model = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    rnd = random.Random(17)
    made = [b"".join(rnd.choice(own.tokens) for _ in range(rnd.randint(1, 6))) for _ in range(3000)]
    made += [bytes(rnd.choice(b"aethn ") for _ in range(rnd.randint(1, 60))) for _ in range(1000)] + [bytes(rnd.randrange(256) for _ in range(30)) for _ in range(300)]
    assert [own.encode(x) for x in made] == [model._encode_single_piece(x) for x in made]
    assert own.encode(b"") == []
    monkeypatch.setattr(byte_bpe, "MEMO_PIECES", 10)
    encoded, encode = [], own.encode
    own.encode = lambda piece: encoded.append(piece) or encode(piece)
    for _ in range(200):
        own.packed(f"often {letters(rnd, 1)}")
    assert encoded.count(b"often") == 1 and len(encoded) > 150
    assert len(own) + len(own.before) <= 20


# 6: language


def test_language_id(spark, nothing):
    rnd = random.Random(2)
    parts = {"en": ["the", "ing", "and", "er", "on"], "de": ["sch", "ung", "ein", "ß", "und"], "fr": ["eau", "ez", "ç", "ou", "les"]}
    rows = []
    for i in range(600):
        lang = rnd.choice(list(parts))
        text = " ".join("".join(rnd.choice(parts[lang]) for _ in range(rnd.randint(1, 3))) for _ in range(rnd.randint(5, 60)))
        rows.append((i, text, lang if i % 7 else None, "s", 0, 0, 0, ""))
    rows += [(1000, None, "en", "s", 0, 0, 0, ""), (1001, "12 ?! \n", "en", "s", 0, 0, 0, ""), (1002, "", None, None, 0, 0, 0, ""), (None, "the and the", None, None, 0, 0, 0, ""), (5, rows[5][1], rows[5][2], "s", 0, 0, 0, "")]
    out = language_id.language_id(spark.createDataFrame(rows, SCHEMA)).toPandas()
    assert len(out) == len(rows)
    und = out[out.doc_id.isin([1000, 1001, 1002])]
    assert (und.lang_pred == "und").all() and (und.score == 0).all()
    truth = {r[0]: r[2] for r in rows if r[2]}
    held = out[out.held_out & out.doc_id.isin(list(truth)) & (out.lang_pred != "und")]
    assert len(held) > 50 and (held.lang_pred == held.doc_id.map(truth)).mean() > 0.97
    assert out.score.between(0, 1).all() and set(out.lang_pred) <= {*parts, "und"}
    import zlib

    assert all(h == (zlib.crc32(str(int(i)).encode()) % 5 == 0) for i, h in zip(out.doc_id, out.held_out) if not pd.isna(i))
    assert collected(language_id.language_id(nothing)) == []
    unlabelled = spark.createDataFrame([(1, "some text", None, None, 0, 0, 0, "")], SCHEMA)
    assert collected(language_id.language_id(unlabelled))[0][2:] == ("und", 0.0)


# 8: near-dedup


def shingle_sets(rows):
    out = {}
    for i, t, *_ in rows:
        w = BLANK.findall((t or "").encode().lower())
        out[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    return out


def components_of(sets, t100):
    ids, parent = sorted(sets), {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if 100 * n >= t100 * (len(sets[a]) + len(sets[b]) - n):
                    p, q = find(a), find(b)
                    parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("short,rounds", [(32, 3), (1, 0), (2, 1)])
def test_near_dedup(docs, rows, monkeypatch, short, rounds):
    monkeypatch.setattr(near_dedup, "SHORT", short)
    monkeypatch.setattr(near_dedup, "ROUNDS", rounds)
    monkeypatch.setattr(near_dedup, "BLOCK", 5)
    sets = shingle_sets(rows)
    want = components_of(sets, 75)
    got = collected(near_dedup.near_dedup(docs))
    assert got == sorted([(r[0], len(sets[r[0]]), want[r[0]], r[0] == want[r[0]]) for r in rows], key=repr)


def test_near_dedup_of_long_texts(spark):
    """Sets larger than a sketch, at similarities around the threshold."""
    rnd = random.Random(9)
    base = words(rnd, 700)
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(i):
            w[rnd.randrange(len(w))] = f"x{rnd.random()}"
        rows.append((i, " ".join(w), None, None, 0, 0, 0, ""))
    want = components_of(shingle_sets(rows), 75)
    assert {r[0]: r[2] for r in collected(near_dedup.near_dedup(spark.createDataFrame(rows, SCHEMA)))} == want


def test_near_dedup_edges(nothing, with_null):
    assert collected(near_dedup.near_dedup(nothing)) == []
    assert collected(near_dedup.near_dedup(with_null)) == [(7, 9, 7, True), (None, 9, None, True), (None, 9, None, True)]


# 7: lines


def test_line_dedup(docs, rows):
    where = defaultdict(set)
    for i, t, *_ in rows:
        for k, line in enumerate((t or "").split("\n")):
            if line := line.strip(" \t\n\x0b\x0c\r"):
                where[line].add((i, k))
    lines = sorted(where)
    sets = {k: frozenset(x[j : j + 5] for j in range(len(x) - 4)) for k, x in enumerate(lines)}
    comps = defaultdict(set)
    for k, c in components_of(sets, 75).items():
        comps[c] |= where[lines[k]]
    gone = defaultdict(list)
    for places in comps.values():
        for i, k in sorted(places - {min(places)}):
            gone[i].append(k)
    got = collected(line_dedup.line_dedup(docs))
    want = sorted([(r[0], (r[1] or "").count("\n") + 1, len(gone[r[0]]), ",".join(map(str, sorted(gone[r[0]])))) for r in rows], key=repr)
    assert sum(a != b for a, b in zip(got, want, strict=True)) <= 2  # candidates come from signatures
    assert got != [] and sum(r[2] for r in got) > 20


def test_line_dedup_edges(spark, nothing, with_null):
    assert collected(line_dedup.line_dedup(nothing)) == []
    assert [r[:3] for r in collected(line_dedup.line_dedup(with_null))] == [(7, 1, 0), (None, 1, 0), (None, 1, 0)]
    df = spark.createDataFrame([(1, "a line\n\nother"), (2, "b\n a line\r\n"), (3, None)], "doc_id long, text string")
    assert collected(line_dedup.line_dedup(df)) == [(1, 3, 0, ""), (2, 3, 1, "1"), (3, 1, 0, "")]
    assert collected(line_dedup.without_lines(df)) == [(1, "a line\n\nother"), (2, "b\n"), (3, None)]


def linked_lines(spark, pairs):
    """Of pairs of lines, each in two documents of its own: whether the second one is removed."""
    rows = [(2 * i + k, line) for i, pair in enumerate(pairs) for k, line in enumerate(pair)]
    out = {r[0]: r[2] for r in collected(line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))}
    assert not any(out[2 * i] for i in range(len(pairs)))
    return [out[2 * i + 1] == 1 for i in range(len(pairs))]


def similarity(a, b):
    x, y = ({t[j : j + 5] for j in range(len(t) - 4)} for t in (a, b))
    return len(x & y) / len(x | y)


def letters(rnd, n):
    return " ".join(words(rnd, n, "abcdefghijklmnopqrstuvwxyz"))


def test_line_dedup_with_scattered_edits(spark):
    rnd = random.Random(11)
    pairs = []
    for _ in range(1200):
        a = letters(rnd, rnd.randint(12, 40))
        b = list(a)
        for j in rnd.sample(range(len(a)), max(1, round(len(a) * rnd.uniform(0.005, 0.035)))):
            b[j] = rnd.choice("0123456789")
        pairs.append((a, "".join(b)))
    want = [similarity(*p) for p in pairs]
    got = linked_lines(spark, pairs)
    assert not any(g for g, w in zip(got, want, strict=True) if w < 0.75)
    for lo, hi in ((0.75, 0.8), (0.8, 0.85), (0.85, 0.9), (0.9, 1)):
        band = [g for g, w in zip(got, want, strict=True) if lo <= w < hi]
        assert len(band) > 50 and np.mean(band) > 0.98


def test_line_dedup_of_lines_less_a_word(spark):
    rnd = random.Random(12)
    by = {n: [] for n in (2, 3, 5, 6, 7, 8, 9, 10, 11, 12, 13, 15)}
    for n, pairs in by.items():
        while len(pairs) < 60:
            w = letters(rnd, n).split(" ")
            gone = rnd.randrange(n)
            a, b = " ".join(w), " ".join(w[:gone] + w[gone + 1 :]) if n > 5 else " ".join(w)[:-1]
            if len(b) > 4 and similarity(a, b) >= 0.75:
                pairs.append((a, b))
    got = linked_lines(spark, [p for pairs in by.values() for p in pairs])
    assert min(np.mean(got[i * 60 : i * 60 + 60]) for i in range(len(by))) > 0.96


def test_line_dedup_of_repeated_content(spark):
    pairs = [("-" * 100, "-" * 40), ("=" * 5, "=" * 50), (". " * 40 + ".", ". " * 9 + "."), ("again and " * 30 + "again", "again and " * 9 + "again"), ("_" * 6, "_" * 300)]
    assert all(similarity(*p) == 1 for p in pairs)
    assert all(linked_lines(spark, pairs))


def test_line_dedup_settles_long_lists(spark):
    """One list of lines of one template, none alike but pairs and a chain: nothing is left out, however long the list."""
    rnd = random.Random(13)
    base = letters(rnd, 30)
    lines = [f"{base} {letters(rnd, 14)}" for _ in range(150)]
    lines += [x[:-1] + "7" for x in lines[:60]]
    chain = list(letters(rnd, 30))
    for i in range(40):
        chain[3 * i] = "8"
        lines.append("".join(chain))
    rnd.shuffle(lines)
    sets = {i: {x[j : j + 5] for j in range(len(x) - 4)} for i, x in enumerate(lines)}
    want = components_of(sets, 75)
    texts = spark.createDataFrame(list(enumerate(lines)), "rep long, line string")
    listed = texts.selectExpr("1L AS value", "rep", "0L AS first")
    joined = line_dedup.linked(listed, line_dedup.signatures(texts).select("rep", "s1", "s2"), texts)
    got = {r.u: r.v for r in joined.collect()}
    assert {i: got.get(i, i) for i in want} == want
    assert len(set(want.values())) == 151


def test_line_dedup_turns_read_few_texts(spark, monkeypatch):
    """Turns get the texts of lists that aren't one component only, and texts aren't shuffled to find those whose shingles are held."""
    rnd = random.Random(15)
    one, base = letters(rnd, 60), letters(rnd, 30)
    lines = [f"{one}{i}" for i in range(10)] + [f"{base} {letters(rnd, 14)}" for _ in range(12)]
    lines += [x[:-1] + "7" for x in lines[10:]]
    want = components_of({i: {x[j : j + 5] for j in range(len(x) - 4)} for i, x in enumerate(lines)}, 75)
    texts = spark.createDataFrame(list(enumerate(lines)), "rep long, line string").cache()
    listed = texts.selectExpr("IF(rep < 10, 1L, 2L) AS value", "rep", "IF(rep < 10, 0L, 10L) AS first")
    sizes, plans, verified, cut = [], [], line_dedup.verified, line_dedup.cut
    monkeypatch.setattr(line_dedup, "verified", lambda pairs, own: sizes.append(own.count()) or verified(pairs, own))
    monkeypatch.setattr(line_dedup, "cut", lambda df: plans.append((df.columns, df._jdf.queryExecution().optimizedPlan().toString())) or cut(df))
    joined = line_dedup.linked(listed, line_dedup.signatures(texts).select("rep", "s1", "s2"), texts)
    got = {r.u: r.v for r in joined.collect()}
    assert {i: got.get(i, i) for i in want} == want
    assert sizes[0] == 34 and len(sizes) > 1 and set(sizes[1:]) == {23}  # the first line has met the others
    often = [plan for columns, plan in plans if {"line", "times"} <= set(columns)]
    assert often and all("broadcast" in plan for plan in often)


def test_line_dedup_tests_a_pair_once(spark, monkeypatch):
    """Lines of a template that share many lists: no pair is tested twice, and shingles held by all tasks decide as those made for each pair."""
    rnd = random.Random(14)
    base = letters(rnd, 30)
    lines = [f"{base} {letters(rnd, 14)}" for _ in range(50)]
    lines += [x[:-1] + "7" for x in lines[:20]] + ["-" * 40, "-" * 90]
    want = components_of({i: {x[j : j + 5] for j in range(len(x) - 4)} for i, x in enumerate(lines)}, 75)
    texts = spark.createDataFrame(list(enumerate(lines)), "rep long, line string").cache()
    listed = texts.selectExpr("explode(sequence(1L, 3L)) AS value", "rep", "0L AS first")
    signed = line_dedup.signatures(texts).select("rep", "s1", "s2").cache()
    tested, held, verified, among = [], [], line_dedup.verified, line_dedup.among
    monkeypatch.setattr(line_dedup, "verified", lambda pairs, texts: tested.extend(map(tuple, pairs.collect())) or verified(pairs, texts))
    monkeypatch.setattr(line_dedup, "among", lambda pairs, sets: held.append(pairs.count()) or among(pairs, sets))
    for bound in (line_dedup.HELD, 0):
        monkeypatch.setattr(line_dedup, "HELD", bound)
        tested.clear()
        held.clear()
        got = {r.u: r.v for r in line_dedup.linked(listed, signed, texts).collect()}
        assert {i: got.get(i, i) for i in want} == want
        assert len(tested) == len(set(tested)) > 500
        assert bool(held) == (bound > 0)


def test_line_dedup_tests_few_pairs_of_a_template(spark, monkeypatch):
    """Lines that share a template but are no copies: outlines keep nearly all their pairs from being tested, and no link is lost."""
    rnd = random.Random(15)
    base = letters(rnd, 30)
    lines = [f"{base} {letters(rnd, 14)}" for _ in range(60)]
    lines += [x[:-1] + "7" for x in lines[:20]] + [x[:90] + letters(rnd, n) + x[90:] for n, x in enumerate(lines[20:40], 1)]
    lines += ["-" * 40, "-" * 90, "ab" * 30, "ab" * 50 + "a"]
    sets = {i: {x[j : j + 5] for j in range(len(x) - 4)} for i, x in enumerate(lines)}
    want, links = components_of(sets, 75), sum(4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b]) for a in sets for b in sets if a < b)
    texts = spark.createDataFrame(list(enumerate(lines)), "rep long, line string").cache()
    listed = texts.selectExpr("explode(sequence(1L, 3L)) AS value", "rep", "0L AS first")
    signed = line_dedup.signatures(texts).select("rep", "s1", "s2").cache()
    tested, verified = [], line_dedup.verified
    monkeypatch.setattr(line_dedup, "verified", lambda pairs, texts: tested.extend(map(tuple, pairs.collect())) or verified(pairs, texts))
    got = {r.u: r.v for r in line_dedup.linked(listed, signed, texts, line_dedup.outlines).collect()}
    assert {i: got.get(i, i) for i in want} == want
    assert len(tested) == len(set(tested)) < 2 * links + len(lines)
    # An outline differs in no more cells than shingles are in one line only, long lines and lines of the same shingles included.
    drawn = {r.rep: r for r in line_dedup.outlines(spark.createDataFrame([(i, x) for i, x in enumerate([*lines, lines[0] * 9])], "rep long, line string")).collect()}
    assert all(drawn[i].n == len(sets[i]) for i in sets)
    for a in sets:
        cells = sum(((drawn[a][f"w{k}"] ^ drawn[0][f"w{k}"]) & (1 << 64) - 1).bit_count() for k in range(line_dedup.WORDS))
        assert cells <= len(sets[a] ^ sets[0]) and cells % 2 == len(sets[a] ^ sets[0]) % 2


def test_line_dedup_settles_a_list_in_a_turn(spark, monkeypatch):
    """A list of some dozens of lines takes one turn, whose members carry no signatures or outlines through the shuffles by list and by line."""
    rnd = random.Random(16)
    base = letters(rnd, 30)
    lines = [f"{base} {letters(rnd, 14)}" for _ in range(45)]
    lines += [x[:-1] + "7" for x in lines[:15]]
    want = components_of({i: {x[j : j + 5] for j in range(len(x) - 4)} for i, x in enumerate(lines)}, 75)
    texts = spark.createDataFrame(list(enumerate(lines)), "rep long, line string").cache()
    listed = texts.selectExpr("1L AS value", "rep", "0L AS first")
    signed = line_dedup.signatures(texts).select("rep", "s1", "s2").cache()
    turns, starred = [], line_dedup.starred
    monkeypatch.setattr(line_dedup, "starred", lambda members, *more: turns.append(members.columns) or starred(members, *more))
    got = {r.u: r.v for r in line_dedup.linked(listed, signed, texts, line_dedup.outlines).collect()}
    assert {i: got.get(i, i) for i in want} == want
    assert len(turns) == 1 and not {"s1", "s2", "n", "w0"} & set(turns[0])


def test_line_dedup_shuffles_texts_once(spark, docs, monkeypatch):
    """Texts are shuffled when equal lines meet, signatures are made there, and which lines are in lists or turns shuffles no texts."""
    plans, cut = [], line_dedup.cut
    monkeypatch.setattr(line_dedup, "cut", lambda df: plans.append((df.columns, df._jdf.queryExecution().executedPlan().toString())) or cut(df))
    now = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    with common.settings(spark, now):
        line_dedup.removed(docs).collect()
    (made,) = [plan for columns, plan in plans if {"h1", "line"} <= set(columns)]
    assert len(re.findall("[+:]- Exchange hashpartitioning", made)) == 1 and made.count("ReusedExchange") == 1 and "s1" in made
    later = [plan for columns, plan in plans if {"rep", "line"} <= set(columns) and "h1" not in columns]
    assert later and not any("hashpartitioning" in plan for plan in later)


def test_line_dedup_finds_lines_by_bits(spark, monkeypatch):
    """Rows of several partitions, negative bits of words included, whether all words fit into one broadcast or not."""
    table = spark.range(0, 3000, 1, 5).select(F.monotonically_increasing_id().alias("rep"), F.col("id").alias("x")).cache()
    every = sorted(r.rep for r in table.collect())
    wanted = [r for i, r in enumerate(every) if i % 3 == 0 or r % 64 == 63]
    asked = spark.createDataFrame([(r,) for r in [*wanted, *wanted[:9], every[-1] + 5]], "rep long")
    for bound in (line_dedup.BLOCKS, 12):
        monkeypatch.setattr(line_dedup, "BLOCKS", bound)
        got = line_dedup.within(table, asked)
        assert got.columns == ["rep", "x"] and sorted(r.rep for r in got.collect()) == wanted
    assert line_dedup.within(table, asked.where("rep < 0")).count() == 0


def test_components_leave_no_shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return {x for x in (files.getAllFiles().apply(i).getName() for i in range(files.getAllFiles().size())) if x.startswith("shuffle_")}

    before = shuffled()
    links = spark.createDataFrame([(i + 1, i) for i in range(30)], "u long, v long").repartition(4)
    got = {r.u: r.v for r in common.components(links).collect()}
    assert got == {i + 1: 0 for i in range(30)}
    assert not shuffled() - before


# 3: neighbours


def exact_neighbours(rows, every=20, k=20):
    ids = sorted({i: np.array(v, float) for i, v in rows}.items())
    out = {}
    for q, v in ids:
        if q % every == 0:
            out[q] = [i for _, i in sorted((-float(np.dot(v, x)), i) for i, x in ids if i != q)[:k]]
    return out


def test_neighbours_are_exact_in_one_list(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(300)]
    rows += [(300 + i, rows[20][1]) for i in range(50)] + [(20, rows[20][1])]
    bad = [(900, None), (920, []), (940, [0.0] * 6), (960, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (980, [float("nan")] * 6), (1000, [1.0, 2.0]), (None, [1.0] * 6), (1020, [float("inf")] * 6)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows + bad], "vec_id long, embedding array<float>, list string, cid int")
    got = neighbours.neighbours(df, lists=1).toPandas().sort_values(["query_id", "rank"])
    want = exact_neighbours([(i, np.float32(v)) for i, v in rows])
    assert {q: list(g.vec_id) for q, g in got.groupby("query_id")} == want
    vectors = {i: np.float32(v).astype(float) for i, v in rows}
    assert all(abs(np.dot(vectors[r.query_id], vectors[r.vec_id]) - r.score) < 1e-9 for r in got.itertuples())
    assert collected(neighbours.neighbours(df.where("false"))) == []


def test_neighbours_of_few_vectors(spark):
    """Fewer candidates than places: all of them, whatever the lists."""
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)]) for i in range(0, 300, 20)], "vec_id long, embedding array<float>")
    got = neighbours.neighbours(df, lists=4).toPandas()
    assert len(got) == 15 * 14 and (got.groupby("query_id").vec_id.nunique() == 14).all()


def test_centroid_search_is_as_wide_as_it_needs():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(200, 16)) * 4
    sample = (centres[rng.integers(0, 200, 30_000)] + rng.normal(size=(30_000, 16))).astype(float)
    index = neighbours.built(sample, float((sample * sample).sum(1).max()), 512)
    x = np.concatenate([sample[:200], np.zeros((200, 1))], 1)
    ratio = 1.1
    i, at, _, looked = index.within(x, ratio, np.full(len(index.centroids), 60), 84)
    d = np.sqrt(((x[:, None, :] - index.centroids) ** 2).sum(2))
    want = {(r, c) for r, c in zip(*np.nonzero(d <= ratio * d.min(1, keepdims=True)))}
    got = set(zip(i.tolist(), at.tolist()))
    assert len(want - got) <= 0.05 * len(want) and looked / 200 < len(index.centroids) / 4


def test_neighbours_recall(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=12) * (1 + i % 3)]) for i in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {q: set(g.vec_id) for q, g in neighbours.neighbours(df).toPandas().groupby("query_id")}
    want = exact_neighbours([(i, np.float32(v)) for i, v in rows])
    assert all(len(got[q]) == 20 for q in want)
    assert np.mean([len(got[q] & set(v)) / 20 for q, v in want.items()]) >= 0.9


# 4: toxicity


def test_toxicity(spark, nothing):
    rnd = random.Random(3)
    rows, labels = [], []
    for i in range(900):
        w = words(rnd, rnd.randint(10, 60))
        toxic = i % 6 == 0
        if toxic:
            w[rnd.randrange(len(w))] = rnd.choice(["vilest", "scoundrels", "scoundrelish"])
        rows.append((i, " ".join(w), None, None, 0, 0, 0, ""))
        if i % 3 != 2:
            labels.append((i, 1, int(toxic)))
    rows += [(5000, None, None, None, 0, 0, 0, ""), (5001, "", None, None, 0, 0, 0, ""), (None, "vilest", None, None, 0, 0, 0, "")]
    labels += [(None, 1, 1), (4, 1, None), (99999, 1, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = toxicity.toxicity(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).toPandas()
    assert len(out) == len(rows)
    told = out[out.doc_id < 900]
    assert ((told.doc_id % 6 == 0) == told.toxic).mean() > 0.98
    assert out.severity.between(0, 2).all() and not out[out.doc_id >= 5000].toxic.any()
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert not toxicity.toxicity(df, none).toPandas().toxic.any()
    assert collected(toxicity.toxicity(nothing, none)) == []


def test_cumulative_link_orders_grades():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 3))
    y = np.digitize(x @ [2, -1, 0] + 0.3 * rng.normal(size=600), [-1, 1])
    w, theta = toxicity.fit(x, y, np.ones(600))
    assert theta[0] < theta[1] and w[0] > 0 > w[1] and abs(w[2]) < 0.5
    assert ((x @ w)[:, None] > theta).sum(1).tolist() != [] and (np.digitize(x @ w, theta) == y).mean() > 0.85


# 1: suffixes


def test_suffix_arrays(monkeypatch):
    rnd = random.Random(3)
    strings = []
    for _ in range(500):
        s = [rnd.randint(1, rnd.choice([1, 2, 3, 20])) for _ in range(rnd.randint(0, 50))]
        strings.append((s if rnd.random() < 0.7 else (s[:4] * 20)[: len(s)]) + [0])
    order = lambda s: sorted(range(len(s)), key=lambda i: s[i:])
    assert all(suffix_order.one(s) == order(s) for s in strings)
    starts = np.cumsum([0, *map(len, strings)])[:-1]
    for long in (3000, 25):
        monkeypatch.setattr(suffix_order, "LONG", long)
        got = suffix_order.suffix_arrays(np.concatenate(strings), starts, at_once=700)
        assert all((got[o : o + len(s)] - o).tolist() == order(s) for s, o in zip(strings, starts))


def removed_by_brute_force(rows):
    seen, out = {}, []
    for i, t, *_ in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            seen[b[k : k + 50]] = min(i, seen.get(b[k : k + 50], i))
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if seen[b[k : k + 50]] < i:
                gone[k : k + 50] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("batch,hot", [(3 << 20, 256), (2000, 2), (500, 10)])
def test_suffix_dedup(docs, rows, monkeypatch, batch, hot):
    monkeypatch.setattr(suffix_dedup, "BATCH", batch)
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    assert collected(suffix_dedup.suffix_dedup(docs)) == removed_by_brute_force(rows)


@pytest.mark.parametrize("batch", [3 << 20, 2000])
def test_suffix_dedup_of_descending_rows(spark, rows, monkeypatch, batch):
    """Copies with larger doc_ids come first in a batch; others share passages with them."""
    monkeypatch.setattr(suffix_dedup, "BATCH", batch)
    some = " ".join(words(random.Random(4), 40))
    own = [(900, f"{some} x", *rows[0][2:]), (950, some, *rows[0][2:]), (800, some, *rows[0][2:]), (850, f"y {some}", *rows[0][2:])]
    down = sorted(rows + own, key=lambda r: -r[0])
    df = spark.createDataFrame(down, SCHEMA).coalesce(1)
    assert collected(suffix_dedup.suffix_dedup(df)) == removed_by_brute_force(down)


def test_suffix_dedup_sorts_no_single_windows(monkeypatch):
    """Windows of a minimizer that is dealt out window by window are distinct: no suffixes of theirs are sorted."""
    rnd = random.Random(5)
    passage = " ".join(words(rnd, 14))
    rows = [(i, f"{' '.join(words(rnd, 30))} {passage} {' '.join(words(rnd, 30))}") for i in range(40)]
    monkeypatch.setattr(suffix_dedup, "STRETCH", 100, raising=False)
    monkeypatch.setattr(suffix_dedup, "window_minima", lambda *_: pytest.fail("sorted"))

    def batch(i, t):
        t = t.encode()
        return suffix_dedup.packed(np.array([i]), np.zeros(1, bool), np.array([len(t)]), np.frombuffer(t, np.uint8))

    table = pd.DataFrame({"batch": [i for i, _ in rows], "data": [batch(*r) for r in rows]})

    def by_batch(frame):
        return [[{"part": r.part, "reply": r.reply} for r in frame.itertuples() if r.batch == b] for b in table["batch"]]

    keyed = pd.concat(suffix_dedup.asked(iter([table]), 4))
    replies = pd.concat([suffix_dedup.answered(g, 2) for _, g in keyed.groupby("part")])
    sent = pd.concat(suffix_dedup.sent(iter([table.assign(replies=by_batch(replies))]), 4))
    answers = pd.concat([suffix_dedup.sorted_out(g) for _, g in sent[sent["part"] >= 0].groupby("part")])
    table = table.assign(notes=sent[sent["part"] < 0]["data"].tolist(), answers=by_batch(answers))
    out = pd.concat(suffix_dedup.emitted(iter([table]), 4))
    got = [(int(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in out.itertuples()]
    assert sorted(got, key=repr) == removed_by_brute_force(rows) and out["n_removed"].sum() >= 39 * 50


def test_suffix_dedup_edges(nothing, with_null):
    assert collected(suffix_dedup.suffix_dedup(nothing)) == []
    assert [r[:4] for r in collected(suffix_dedup.suffix_dedup(with_null))] == [(7, 61, 0, 0), (None, 61, 61, 1), (None, 61, 61, 1)]


def test_near_dedup_in_sql(docs, rows):
    assert collected(near_dedup.near_dedup(docs)) == oracle(near_dedup.SQL, rows)


CLASHES = "doc_id long, text string, lang string, source string, size long, target string, __skey int, __class int, row string, made int, gone long, key int, hash string, copies int"


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 999, "t", 1, 2, "r", 3, 4, 5, "h", 6) for i, t, s in rows], CLASHES)


def test_mixing_leaves_clashing_columns_alone(spark):
    rows = [(i, "word " * (i % 7 + 1), "ab"[i % 2]) for i in range(60)]
    out = mixing.sampled(clashing(spark, rows))
    assert out.columns == [x.split()[0] for x in CLASHES.split(", ")]
    assert {tuple(r)[4:] for r in out.collect()} == {(999, "t", 1, 2, "r", 3, 4, 5, "h", 6)}
    plain = spark.createDataFrame([(i, t, s) for i, t, s in rows], "doc_id long, text string, source string")
    assert Counter(r["doc_id"] for r in out.collect()) == Counter(r["doc_id"] for r in mixing.sampled(plain).collect())


def test_language_letters_and_long_texts(spark):
    rows = [(i, t, "en") for i, t in enumerate(["the and of", "a house on the hill", "when the wind blows", "some other words here", "and so it was"] * 6)]
    rows += [(900, "½ ² ① Ⅷ 3", None), (901, "the wind and the hill " * 20_000, None), (902, "the wind and the hill " * 20_000, None), (903, "ª", None)]
    out = {r["doc_id"]: r for r in language_id.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert tuple(out[900])[2:] == ("und", 0.0) and out[903]["lang_pred"] == "en"
    assert out[901]["lang_pred"] == "en" and out[901]["score"] == out[902]["score"]


def test_language_model_against_dense_kernel_ridge(monkeypatch):
    """With a landmark for each text the features span the kernel exactly: the same as kernel ridge regression on the dense kernel."""
    rnd = random.Random(4)
    texts = [(k, " ".join(words(rnd, 12, k * 2 + "aeiou"))) for k in ("xyz", "pqr", "lmn") for _ in range(15)]
    flags = np.zeros(language_id.SPACE, bool)
    grams = [language_id.present(t, flags) for _, t in texts]
    langs, matrix = language_id.fit([k for k, _ in texts], grams)
    presence = np.zeros((len(texts), language_id.SPACE))
    for row, g in zip(presence, grams, strict=True):
        row[g] = 1 / np.sqrt(len(g))
    kernel = presence @ presence.T
    target = np.array([[k == x for x in langs] for k, _ in texts], float)
    alpha = np.linalg.solve(kernel + language_id.RIDGE * np.eye(len(texts)), target)
    new = [" ".join(words(rnd, 9, k * 2 + "aeiou")) for k in ("xyz", "pqr", "lmn") for _ in range(8)]
    for t in new:
        g = language_id.present(t, flags)
        v = np.zeros(language_id.SPACE)
        v[g] = 1 / np.sqrt(len(g))
        assert np.allclose(v @ matrix, presence @ v @ alpha, atol=2e-3)


# the pipeline


def test_pipeline(spark, docs, rows, tmp_path):
    import corpus_pipeline as pipeline

    assert [n for n, _ in pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mixing", "byte_bpe"]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    sizes = []
    for _, stage in pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        if stage is not pipeline.tokens:
            assert out.columns == docs.columns
        now = out
        sizes.append(now.count())
    assert sizes[0] > sizes[1] > sizes[2]
    out = pipeline.run(spark, str(tmp_path)).toPandas()
    assert len(out) == sizes[-1]
    texts_of = {r[0]: r[1] for r in rows}
    assert all(hashlib.sha256(texts_of[i].encode()).hexdigest() == d for i, d in zip(out.doc_id, out.decoded_sha256))
    left = [r for r in rows if r[0] in set(out.doc_id)]
    sets = shingle_sets(left)
    assert all(components_of(sets, 75)[i] == i for i in sets)


def test_pipeline_decides_row_by_row(spark):
    """Null doc_ids, and doc_ids with several texts, of which some are copies or near copies."""
    import corpus_pipeline as pipeline

    rnd = random.Random(21)
    a, b, c, d, e, f = (" ".join(words(rnd, 60)) for _ in range(6))
    near = f"{b} more"
    rows = [(1, a), (2, b), (None, a), (None, c), (None, d), (3, a), (3, e), (4, near), (4, f), (4, f)]
    df = spark.createDataFrame([(*r, "en", "web", 7, 1, 2, "v") for r in rows], SCHEMA)
    out = pipeline.without_copies(spark, df, "")
    assert out.columns == df.columns
    assert collected(out.select("doc_id", "text")) == sorted([(1, a), (2, b), (None, c), (None, d), (3, e), (4, near), (4, f), (4, f)], key=repr)
    out = pipeline.without_near_copies(spark, out, "")
    assert out.columns == df.columns
    assert collected(out.select("doc_id", "text")) == sorted([(1, a), (2, b), (None, c), (None, d), (3, e), (4, f), (4, f)], key=repr)


def test_pipeline_stages_on_clashing_names_and_empty_tables(spark, nothing):
    import corpus_pipeline as pipeline

    rnd = random.Random(31)
    texts = [" ".join(words(rnd, 40)) for _ in range(12)]
    rows = [(i, t, "ab"[i % 2]) for i, t in enumerate(texts)] + [(None, texts[0], None), (20, None, "a"), (21, "", "b"), (3, texts[3], "b"), (3, texts[3] + " end", "b"), (22, texts[5] + " word", "a")]
    docs = clashing(spark, rows)
    for name, stage in pipeline.STAGES:
        out, none = stage(spark, docs, ""), stage(spark, nothing, "")
        assert collected(none) == []
        if name != "byte_bpe":
            assert out.columns == docs.columns and none.columns == nothing.columns
            assert all(tuple(r)[4:] == (999, "t", 1, 2, "r", 3, 4, 5, "h", 6) for r in out.collect())
        else:
            assert out.count() == len(rows)
    kept = {(r["doc_id"], r["text"]) for r in pipeline.without_near_copies(spark, docs, "").collect()}
    assert (22, rows[-1][1]) not in kept and {(i, t) for i, t in enumerate(texts)} - kept <= {(3, texts[3])} and (20, None) in kept
