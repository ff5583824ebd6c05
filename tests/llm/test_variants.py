"""Spelling variants, vector codes and near-duplicate vectors against brute force."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentryframe.llm import codes, spelling, vectors

from .builders import awkward, clashing, documents


def brute_words(texts, typo_every=31, shortest=7):
    total = collections.Counter()
    for doc_id, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{word}".encode())
            if doc_id is not None and typo_every and h % typo_every == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1:]
            if len(word) >= shortest:
                total[word] += 1
    return {w: n for w, n in total.items() if n >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def brute_variants(words):
    near = {w: [v for v in words if abs(len(w) - len(v)) < 2 and one_edit(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 10 * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words.get(form[w]))
    return out


def spelled(seed=3):
    rng = random.Random(seed)
    letters = "etaoinsrhldcumé" + "zßÿ×"
    stems = ["".join(rng.choice(letters) for _ in range(rng.choice((7, 8, 9, 12)))) for _ in range(40)]
    words = {}
    for k, stem in enumerate(stems):
        words[stem] = rng.choice((2, 30, 400, 5000))
        for _ in range(rng.choice((0, 3, 25))):
            at, kind = rng.randrange(len(stem)), rng.randrange(4)
            made = {0: stem[:at] + stem[at + 1:], 1: stem[:at] + rng.choice(letters) + stem[at:],
                    2: stem[:at] + rng.choice(letters) + stem[at + 1:], 3: "".join(rng.sample(stem, len(stem)))}[kind]
            words[made] = rng.choice((2, 3, 40))
    return words


def variants(spark, words):
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.group_variants(df).collect()}


def test_variants_equal_brute_force(spark, monkeypatch):
    words = spelled()
    long = "ab" * 1500
    # Counts over a class's place in the key; forms of forms; words of one letter only.
    words |= {long: 50, long + "b": 3, "c" + long[1:]: 2, "e" * 7: 4, "e" * 8: 4, "e" * 9: 4, "t" * 200: 2, "t" * 201: 2, "t" * 199 + "a": 2,
              "gardens": 3000, "gardenss": 300, "gardensss": 20, "gardenssss": 2}
    want = brute_variants(words)
    assert variants(spark, words) == want and want["gardenssss"][1] == "gardens"
    monkeypatch.setattr(spelling, "BLOCK", 3)
    monkeypatch.setattr(spelling, "ROWS", 2)
    assert variants(spark, words) == want


def test_a_cell_of_many_words_is_cut_into_blocks(spark, monkeypatch):
    rng = random.Random(5)
    words = {"".join(rng.sample("eeeettta", 8)): 2 + i for i in range(400)}
    monkeypatch.setattr(spelling, "BLOCK", 16)
    assert variants(spark, words) == brute_variants(words)


def test_words_are_counted_with_the_typos_of_the_rule(spark, monkeypatch):
    rng = random.Random(11)
    vocabulary = ["Überraschung", "régulière", "CAMELcase", "straßeÿ×÷a", "ordinary", "Ÿnotaletter", "shortly", "tiny", "naïveté"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(60)) + " 12ordinary_words" for _ in range(60)] + ["", None, "ordinary " * 20_000]
    docs = clashing(documents(spark, texts, first=5)).withColumn("word", F.lit("clash"))
    want = brute_words([(i + 5, t) for i, t in enumerate(texts)])
    got = lambda: {r["word"]: r["n"] for r in spelling.count_words(docs, typo_every=31).collect()}
    assert got() == want
    monkeypatch.setattr(spelling, "HELD", 3)
    assert got() == want
    assert {r["word"]: r["n"] for r in spelling.count_words(docs).collect()} == brute_words(list(enumerate(texts)), None)


def test_spelling_takes_awkward_rows(spark):
    found = spelling.group_variants(spelling.count_words(awkward(spark), typo_every=31))
    assert {r["root"] for r in found.collect()} <= {r["word"] for r in found.collect()}
    assert spelling.group_variants(spelling.count_words(documents(spark, []))).count() == 0
    twice = spark.createDataFrame([(None, "wordless wordless")], "doc_id long, text string")
    assert [(r["word"], r["n"]) for r in spelling.count_words(twice, typo_every=1).collect()] == [("wordless", 2)]


VECTORS = "vec_id long, embedding array<float>, label int"


def brute_codes(rows, parts=8, entries=16, rounds=6):
    """Codes by evaluating every entry, in Python's whole numbers."""
    kept = [(i, [math.floor(4096 * float(np.float32(x))) for x in v]) for i, v in rows]
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width:(p + 1) * width]
    start = [v for _, v in sorted(kept)[:entries]]
    books = [[cut(v, p) for v in start] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v, p: min((far(cut(v, p), e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for _, v in kept:
            for p in range(parts):
                groups[p, nearest(v, p)[1]].append(cut(v, p))
        for (p, k), members in groups.items():
            books[p][k] = [sum(x) // len(members) for x in zip(*members)]
    return {i: ([nearest(v, p)[1] for p in range(parts)], sum(nearest(v, p)[0] for p in range(parts))) for i, v in kept}, books


def coded(df, **options):
    out, books = codes.compress(df, **options)
    return {r["vec_id"]: (r["code"], r["error"]) for r in out.collect()}, [b.tolist() for b in books]


@pytest.mark.parametrize("cell", [1, 64, 1024, 100_000])
def test_codes_equal_brute_force(spark, monkeypatch, cell):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(codes, "REMEMBERED", 20)
    monkeypatch.setattr(codes.Nearest.__init__, "__defaults__", (cell,))
    rows = [(1000 - i, (rng.normal(size=16) * rng.choice([0.01, 0.3, 2])).astype("float32").tolist()) for i in range(120)]
    rows += [(2000 + i, rows[i][1]) for i in range(20)] + [(3000, [0.0] * 16), (3001, [-0.00001] * 16)]
    df = clashing(spark.createDataFrame([(i, v, 1) for i, v in rows], VECTORS)).withColumn("code", F.lit("x")).withColumn("whole", F.lit(1))
    assert coded(df.repartition(5)) == brute_codes(rows)


def test_codes_take_awkward_rows(spark):
    good = [(i, [0.5 * i, -0.25, 0.0, 1.0, 2.0, 3.0, 4.0, -5.0], None) for i in (4, 2, 9)]
    bad = [(1, None, 1), (3, [None] * 8, 1), (5, [math.nan] * 8, 1), (6, [math.inf] * 8, 2)]
    df = spark.createDataFrame(good + bad + [(7, [], 3), (8, [1.0], 3), (None, [1.0] * 8, 3), (2, [9.0] * 8, 3)], VECTORS)
    out, books = codes.compress(df, keep=("label",))
    rows = collections.defaultdict(list)
    for r in out.collect():
        rows[r["vec_id"]].append(r)
    assert sorted(k for k in rows if k is not None) == [2, 4, 7, 8, 9] and len(rows[2]) == 2
    assert rows[7][0]["code"] is rows[8][0]["error"] is None and rows[8][0]["label"] == 3
    assert len(rows[None][0]["code"]) == 8 and rows[9][0]["error"] is not None and [len(b) for b in books] == [3] * 8
    empty, books = codes.compress(spark.createDataFrame([], VECTORS))
    assert empty.count() == 0 and [len(b) for b in books] == [0] * 8
    assert [r["code"] for r in codes.compress(spark.createDataFrame([(1, [], 1)], VECTORS))[0].collect()] == [None]
    with pytest.raises(ValueError, match="equal parts"):
        codes.compress(spark.createDataFrame([(1, [1.0] * 9, 1)], VECTORS))
    with pytest.raises(ValueError, match="too large"):
        codes.compress(spark.createDataFrame([(1, [1e30] * 8, 1)], VECTORS))


def brute_links(rows, cosine=0.95):
    """Links by all pairs, in double precision; ids of rows sharing one are joined."""
    fit = lambda v: v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
    exact = [np.array(v, np.float32).astype(float) if i is not None and fit(v) else None for i, v in rows]
    links, group = [0] * len(rows), {i: i for i, _ in rows if i is not None}
    for x in range(len(rows)):
        for y in range(x):
            a, b = exact[x], exact[y]
            if a is not None and b is not None and len(a) == len(b) and a @ b / math.sqrt((a @ a) * (b @ b)) >= cosine:
                links[x] += 1
                links[y] += 1
                low, high = sorted((group[rows[x][0]], group[rows[y][0]]))
                group = {k: low if g == high else g for k, g in group.items()}
    return sorted((str(i), n, str(group.get(i)), i is None or group[i] == i) for (i, _), n in zip(rows, links))


def linked(df):
    return sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in vectors.near_vectors(df).collect())


@pytest.mark.parametrize("sizes", [(16_384, 2048, 2048), (7, 20, 9), (64, 4, 3)])
def test_links_equal_brute_force(spark, monkeypatch, sizes):
    for name, size in zip(("PIVOTS", "CELL_ROWS", "BLOCK"), sizes):
        monkeypatch.setattr(vectors, name, size)
    monkeypatch.setattr(vectors, "ROWS", 5)
    rng, rows = np.random.default_rng(8), []
    for size in (6, 24):
        for _ in range(12):
            centre = rng.normal(size=size)
            rows += [(centre + rng.normal(size=size) * rng.choice([0.02, 0.15, 0.3])) * rng.choice([0.001, 1, 500]) for _ in range(rng.integers(1, 12))]
    rows = [v.astype("float32").tolist() for v in rows]
    rows += [rows[0]] * 15 + [[0.0] * 6, [-0.0, 1.0], [0.0, 1.0], [1.0], [2.0], [-1.0]]
    ids = rng.permutation(len(rows)).tolist()
    rows = list(zip(ids, rows)) + [(5, None), (6, []), (7, [math.nan] * 6), (8, [None] * 6), (None, rows[0]), (ids[0], rows[40])]
    df = clashing(spark.createDataFrame([(i, v, 1) for i, v in rows], VECTORS)).withColumn("cell", F.lit(1)).withColumn("id", F.lit(2))
    assert linked(df.repartition(4)) == brute_links(rows)


def test_links_of_empty_tables_and_single_rows(spark):
    assert linked(spark.createDataFrame([], VECTORS)) == []
    assert linked(spark.createDataFrame([(3, [0.0, 0.0], 1), (4, [3e38, 3e38], 1), (2, [1e-40, 1e-40], 1)], VECTORS)) == [
        ("2", 1, "2", True), ("3", 0, "3", True), ("4", 1, "2", False)]


@pytest.mark.parametrize("wide", [40, 70])
def test_links_by_short_products_equal_brute_force(spark, monkeypatch, wide):
    """Loose and tight groups, more nodes of one cell than a slab holds, and pairs about the threshold."""
    for name, size in (("PIVOTS", 3), ("CELL_ROWS", 20), ("BLOCK", 30), ("ROWS", 7), ("SHORT", 5)):
        monkeypatch.setattr(vectors, name, size)
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(14, wide)) * np.geomspace(1, 0.05, wide)
    rows = [(c + rng.normal(size=wide) * rng.choice([0.001, 0.05, 0.1])).astype("float32").tolist() for c in centres for _ in range(rng.integers(1, 16))]
    rows = list(enumerate(rows + rows[:9]))
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], VECTORS)
    want = brute_links(rows)
    assert len({n for _, n, _, _ in want}) > 4 and linked(df.repartition(3)) == want
    assert linked(df.withColumn("embedding", F.col("embedding").cast("array<double>")).withColumn("vec_id", F.col("vec_id").cast("string"))) == sorted(
        (i, n, c, k) for i, n, c, k in brute_links([(str(i), v) for i, v in rows]))


def test_a_vector_is_stored_once_whatever_cells_it_reaches(spark, monkeypatch):
    """Independent directions are guests in nearly every cell; a pass returns counts and links only."""
    monkeypatch.setattr(vectors, "CELL_ROWS", 20)
    written = []
    keep = vectors.cut
    monkeypatch.setattr(vectors, "cut", lambda df: written.append(keep(df)) or written[-1])
    rng = np.random.default_rng(10)
    df = spark.createDataFrame([(i, rng.normal(size=40).astype("float32").tolist(), 1) for i in range(400)], VECTORS)
    assert all(n == 0 for _, n, _, _ in linked(df))
    assert sum(t.count() for t in written if "v" in t.columns) == 400


def test_slabs_hold_whole_cells_and_deal_large_ones(monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 10)
    assert vectors.slabs([(0, 4, 8), (1, 6, 8), (2, 1, 8), (5, 25, 8), (7, 10, 8), (9, 3, 8)]) == [
        (0, 0, 1), (1, 0, 1), (2, 1, 1), (5, 2, 4), (7, 6, 1), (9, 7, 1)]
    assert vectors.slabs([(0, 3, 1 << 24)]) == [(0, 0, 2)] and vectors.slabs([]) == []
