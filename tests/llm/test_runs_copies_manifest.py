"""Periodic runs, exact copies and the manifest on awkward rows, against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from custvoice.llm import copies, merkle, periodic

DOCS = ("doc_id bigint, text string, lang string, source string, n_chars bigint, node string, tree string, n int, idx int, "
        "digest string, size int, place int, runs int, path string")


def rows_of(spark, rows, parts=3):
    made = [(i, t, lang, source, n, "x", "y", 1, 2, "z", 3, 4, 5, "w") for i, t, lang, source, n in rows]
    return spark.createDataFrame(made, DOCS).repartition(parts)


def brute_runs(words):
    n, found = len(words), {}
    for q in range(1, n):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted((i, j - i, q) for (i, j), q in found.items())


def texts_with_runs():
    r = random.Random(4)
    for _ in range(250):
        size, letters = r.choice([20, 60, 150]), r.choice([1, 2, 2, 3, 8])
        yield [r.choice("abcdefgh"[:letters]) for _ in range(r.randint(0, size))]
    for _ in range(60):
        root = [r.choice("abcdefghijkl") for _ in range(r.randint(1, 40))]
        body = (root * 9)[: r.randint(len(root), 9 * len(root))]
        for _ in range(r.randint(0, 2)):
            body[r.randrange(len(body))] = "!"
        yield [r.choice("abc") for _ in range(r.randint(0, 9))] + body + [r.choice("abc") for _ in range(r.randint(0, 9))]
    fib, word = [["a"], ["a", "b"]], ["a"]
    for _ in range(10):
        fib.append(fib[-1] + fib[-2])
    for _ in range(8):
        word = word + ["b" if w == "a" else "a" for w in word]
    yield from (fib[-1], word, ["a"] * 900, ["a", "b"] * 60 + ["b", "a"] * 60, (["a"] * 40 + ["b"]) * 8, (["a", "b"] * 30 + ["c"]) * 5 + ["a", "b"] * 9)


def test_periodic_runs(spark):
    """Random words, planted periods, words that repeat at every distance: the runs that the definition gives."""
    cases = list(texts_with_runs())
    rows = [(k, " ".join(w), None, None, None) for k, w in enumerate(cases)]
    got = {x["doc_id"]: x for x in periodic.periodic_runs(rows_of(spark, rows)).collect()}
    assert len(got) == len(cases)
    for k, w in enumerate(cases):
        expected = brute_runs(w)
        assert [tuple(x) for x in got[k]["runs"]] == expected, " ".join(w)
        gone = {i for s, length, q in expected for i in range(s + q, s + length)}
        assert got[k]["collapsed"] == " ".join(x for i, x in enumerate(w) if i not in gone)


def test_periodic_runs_of_awkward_rows(spark):
    long = "é\t漢\n" * 30_000
    rows = [(None, None, None, None, None), (1, "", "", "", 0), (1, " \n\t", None, None, 1), (2, "A a " * 6, None, None, None), (2, "A a " * 6, None, None, None),
            (3, long, None, None, None), (4, "x\xa0y " * 13, None, None, None)]
    got = periodic.periodic_runs(rows_of(spark, rows)).collect()
    by = defaultdict(list)
    for x in got:
        by[x["doc_id"]].append(([tuple(y) for y in x["runs"]], x["collapsed"]))
    assert by[None] == [([], "")] and by[1] == [([], "")] * 2 and by[2] == [([(0, 12, 2)], "A a")] * 2
    assert by[3] == [([(0, 60_000, 2)], "é 漢")] and by[4] == [([(0, 13, 1)], "x\xa0y")]
    assert periodic.periodic_runs(rows_of(spark, [])).collect() == []


def test_periodic_seeds_stay_few():
    """As many seeds as words, times the classes, where all words are equal or two kinds alternate and break."""
    for words in (np.zeros(4000, np.uint64), np.tile([1, 2], 2000).astype(np.uint64), np.tile(np.append(np.tile([1, 2], 100), 3), 20).astype(np.uint64)):
        many = sum(len(x) for _, x, _ in periodic.seeds(words, np.zeros(1, np.int64)))
        assert many <= 4 * len(words) * 12


AWKWARD = [
    (1, "Same Text", "en", "a", 9), (2, "same text", "en", "a", 9), (3, "SAME TEXT", None, None, None), (3, "SAME TEXT", None, None, None),
    (None, "same text", "en", "", 9), (4, None, "en", "a", 0), (5, "", "en", None, 0), (6, "É", "fr", "b", 1), (7, "é", "fr", "b", 1),
    (8, "Éa", "fr", "b", 2), (9, "ÉA", "fr", "b", 2), (None, "alone", None, "b", 5), (None, "alone", None, "b", 5), (10, "K", "x", "c", 1), (11, "K", "x", "c", 1),
    (12, "w " * 200_000, "en", "long", 400_000), (12, "other", "en", "a", 5), (-5, "W " * 200_000, "en", "a", 400_000),
]


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("parts", [1, 40])
def test_copies(spark, keep, parts):
    got = copies.copies(rows_of(spark, AWKWARD, parts), keep).collect()
    groups = defaultdict(list)
    for i, text, *_ in AWKWARD:
        groups[hashlib.sha256(lowered(text).encode()).hexdigest()].append(i)
    assert sorted((x["doc_id"] is None, x["doc_id"] or 0) for x in got) == sorted((i is None, i or 0) for i, *_ in AWKWARD)
    pick = max if keep == "largest" else min
    for key, ids in groups.items():
        own = [x for x in got if x["text_sha256"] == key]
        best = pick((i for i in ids if i is not None), default=None)
        assert len(own) == len(ids) and {(x["keep_id"], x["group_size"]) for x in own} == {(best, len(ids))}
        assert [x["doc_id"] for x in own if x["kept"]] == [best]


def test_copies_over_many_leaves(spark):
    """Four rounds of merging: one text in a third of all rows, of every partition."""
    docs = spark.range(6000, numPartitions=700).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("Hot")).otherwise(
        F.concat(F.lit("t"), (F.col("id") % 500).cast("string"))).alias("text"))
    got = copies.copies(docs).collect()
    groups = defaultdict(list)
    for i in range(6000):
        groups["hot" if i % 3 == 0 else f"t{i % 500}"].append(i)
    expected = {(i, max(g), len(g), i == max(g)) for g in groups.values() for i in g}
    assert {(x["doc_id"], x["keep_id"], x["group_size"], x["kept"]) for x in got} == expected
    with pytest.raises(ValueError):
        copies.copies(docs, "first")


def test_copies_of_nothing(spark):
    assert copies.copies(rows_of(spark, [])).collect() == []


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def told(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf_of(row, text):
    return sha(*(told(x) for x in (row[0], row[3], row[2], row[4], text)))


def tree_of(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def path_in(levels, i):
    out = []
    for level in levels[:-1]:
        start = i // 16 * 16
        out.append(("".join(level[start:i]), "".join(level[i + 1 : start + 16])))
        i //= 16
    return out


def brute_manifest(rows, suspect):
    sources = defaultdict(list)
    for row in rows:
        sources[row[3]].append(row)
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    ordered = {s: sorted(sources[s], key=lambda x: (x[0] is not None, x[0] or 0, leaf_of(x, x[1]))) for s in names}
    trees = {s: tree_of([leaf_of(x, x[1]) for x in ordered[s]]) for s in names}
    whole = tree_of([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, row in enumerate(ordered[s]):
            path = path_in(trees[s], i) + path_in(whole, k)
            node = leaf_of(row, None if row[1] is None else lowered(row[1]) if suspect(row[0]) else row[1])
            for left, right in path:
                node = sha(left, node, right)
            root = whole[-1][0]
            out.append((row[0], trees[s][0][i], trees[s][-1][0], root, sha(*(a + b for a, b in path)), node, node == root))
    return sorted(out, key=repr)


def manifest_rows(spark, rows, parts):
    got = merkle.verify(rows_of(spark, rows, parts), suspect=F.col("doc_id") % 2 == 0)
    return sorted((tuple(x) for x in got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


@pytest.mark.parametrize("rows", [
    AWKWARD, AWKWARD[:1], [],
    [(i, f"Text {i % 7}", "en", None, i) for i in range(17)],
    [(i // 2, f"Text {i % 4}", "en", ["hot", f"s{i % 40}", "", None][min(i % 5, 3) if i % 9 else 0], None) for i in range(900)],
    [(i, "A" if i % 3 else "b", None, "one", 1) for i in range(257)],
])
def test_manifest(spark, rows):
    """Sources of no, one, 16, 17, 256, 257 rows and more: every proof as the definition gives it."""
    assert manifest_rows(spark, rows, 5) == brute_manifest(rows, lambda i: i is not None and i % 2 == 0)


def test_manifest_without_suspects(spark):
    got = merkle.verify(rows_of(spark, AWKWARD)).collect()
    assert len(got) == len(AWKWARD) and all(x["verified"] for x in got)


def test_manifest_stores_every_other_level(spark):
    leaves = merkle.document_leaves(rows_of(spark, [(i, "t", None, "s", 1) for i in range(300)]))
    made = merkle.build(leaves, merkle.Scratch(spark, "test"))
    assert [x.count() for x in made.sources.levels] == [300, 2, 1]
    assert made.sources.roots.count() == made.whole.roots.count() == 1
