"""The pipeline against a brute-force version of its stages, and its stages on awkward tables."""

import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from custvoice.llm import decontaminate, passages, quality, setjoin, sql, tokens, toxicity
from custvoice.llm.store import Scratch
from tests.compare import duck_rows
from tests.llm.test_operators import edited, prose, sets

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def fixture():
    """Documents with all that the stages look for, in an order that hides it, and the benchmark."""
    r = random.Random(42)
    item = "A grocer packs 14 kg of pears into 7 boxes and sells each box for 30 dollars. What does Anna earn if she sells them all?"
    passage = prose(80, 9001)
    texts = [prose(r.randint(60, 300), 9100 + k) for k in range(25)]
    base = prose(150, 9300)
    texts += [base, base, base.upper(), edited(base, [20, 100])]  # copies and a near copy
    texts += [prose(70, 9400 + k) + "\n" + passage + "\n" + prose(r.randint(55, 90), 9500 + k) for k in range(4)]
    texts += [passage, prose(60, 9600) + " " + item + " " + prose(60, 9601), prose(60, 9602) + " " + item.replace("14", "21").replace("Anna", "Maria") + " " + prose(60, 9603)]
    texts += [None, "", "short", "### $$$ " * 80, "one two three " * 40, prose(5000, 9700)]
    ids = r.sample(range(1000), len(texts))
    order = sorted(range(len(texts)), key=lambda i: r.random())
    return [(ids[i], texts[i], "en", f"s{i % 3}", len(texts[i] or "")) for i in order], [(1, item), (2, prose(30, 9800)), (3, None)], passage


def brute(rows, items):
    """Texts by id, as the stages leave them."""
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [row[:2] for row in rows])
    names, told = duck_rows(con, sql.OP10)
    kept = {r[names.index("doc_id")] for r in told if r[names.index("kept")]}
    texts = {i: t for i, t, *_ in rows if i in kept}
    shingles = {i: sets(t) for i, t in texts.items()}
    root = {i: i for i in texts}
    for i in texts:
        for j in texts:
            if i < j and 100 * len(shingles[i] & shingles[j]) >= 80 * len(shingles[i] | shingles[j]):
                a, b = sorted((root[i], root[j]))
                root = {k: a if x == b else x for k, x in root.items()}
    texts = {i: t for i, t in texts.items() if root[i] == i}
    # Verbatim passages: each word of a stretch of 50 words or more that an earlier document holds goes.
    lower = {i: re.sub("[A-Z]", lambda m: m[0].lower(), t) for i, t in texts.items()}
    cut = {}
    for i in sorted(texts):
        spans = [(m.start(), m.end()) for m in re.finditer(r"[^ \t\n\x0b\x0c\r]+", texts[i])]
        words = [lower[i][a:b] for a, b in spans]
        gone = set()
        for j in texts:
            if j < i:
                other = lower[j].split()
                held = {tuple(other[k : k + 50]) for k in range(len(other) - 49)}
                for k in range(len(words) - 49):
                    if tuple(words[k : k + 50]) in held:
                        gone.update(range(k, k + 50))
        out, done = "", 0
        for k in sorted(gone):
            out += texts[i][done : max(spans[k - 1][1] if k else 0, done)]
            done = spans[k][1]
        out += texts[i][done:]
        if out.split():
            cut[i] = out
    # Items: the words outside of numbers and names, in a row.
    literal = [re.escape(t).replace("14", r"\d+").replace("7", r"\d+").replace("30", r"\d+").replace("Anna", r"[A-Z]\w+") for _, t in items if t]
    return {i: t for i, t in cut.items() if not any(re.search(p, t) for p in literal)}


def test_pipeline_against_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    rows, items, passage = fixture()
    spark.createDataFrame(rows, DOCS).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    expected = brute(rows, items)
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p["doc_id"] for p in pieces} == set(expected)
    # Three copies, five that the rules reject, two leaks and the lone passage are gone; one document keeps the passage.
    assert sum(passage in t for t in expected.values()) == 1 and len(expected) == len(rows) - 11
    plain = Tokenizer.from_file(tokens.vocabulary())
    for i, text in expected.items():
        ids, at = np.array([*plain.encode(text, add_special_tokens=False).ids, 1], "<u4"), 0
        for p in sorted((p for p in pieces if p["doc_id"] == i), key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids), i
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)


INNER = ("spans", "cut_id", "row", "id", "c0", "text_", "doc", "src", "root", "node", "n", "a", "b", "key", "cell", "r", "digest", "shingles",
         "size", "bucket", "part", "place", "found", "score", "kept", "n_words", "component_id", "item_id", "covered", "low", "high", "wanted", "body")


@pytest.mark.parametrize("stage", [quality.filter_quality, setjoin.one_of_each, passages.without_repeats, None])
def test_stages_carry_any_column(spark, stage):
    """Columns named like those made inside come out as they went in."""
    rows, items, _ = fixture()
    some = spark.createDataFrame(rows, DOCS).select("*", *[F.concat(F.lit(f"{name} "), F.col("doc_id").cast("string")).alias(name) for name in INNER])
    if stage is None:
        out = decontaminate.without_leaks(some, spark.createDataFrame(items, "item_id bigint, text string"))
    else:
        out = stage(some)
    assert out.columns == some.columns and out.dtypes == some.dtypes
    got = out.collect()
    assert 0 < len(got) < len(rows)
    assert all(r[name] == f"{name} {r['doc_id']}" for r in got for name in INNER)
    empty = some.limit(0)
    made = decontaminate.without_leaks(empty, spark.createDataFrame(items, "item_id bigint, text string")) if stage is None else stage(empty)
    assert made.columns == some.columns and made.count() == 0


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_passages_inside_longer_texts(spark):
    """Recall against brute force: verbatim and changed passages at any place, on both sides of which texts differ."""
    r, texts, planted = random.Random(77), [], set()
    for k in range(120):
        size = r.randint(50, 110)
        own = prose(size, 20_000 + k)
        changed = r.randint(0, size // 60)
        pair = [own, edited(own, r.sample(range(6, size - 6), changed)) if changed else own]
        for copy in pair:
            texts.append(prose(r.randint(0, 120), 30_000 + len(texts)) + " " + copy + " " + prose(r.randint(0, 120), 40_000 + len(texts)))
        planted.add((len(texts) - 1, len(texts) - 2))
    rows = passages.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)).collect()
    found = {(x["doc_id"], x["src_doc_id"]) for x in rows}
    assert found <= planted and len(found) >= 0.95 * len(planted)
    for x in rows:
        one, two = (sets(" ".join(texts[x[d]].split()[x[a] : x[b]])) for d, a, b in (("doc_id", "start_word", "end_word"), ("src_doc_id", "src_start_word", "src_end_word")))
        assert len(one & two) >= 0.8 * len(one | two) and abs(len(one & two) / len(one | two) - x["similarity"]) < 1e-9


@pytest.mark.parametrize("n", [150, 300, 600])
def test_passage_pairs_grow_with_the_rows(spark, monkeypatch, n):
    """Variants of one passage that are not alike: a few pairs for each document, not for each pair of documents."""
    r, own = random.Random(1), prose(60, 99)
    texts = [edited(own, r.sample(range(6, 54), 3)) for _ in range(n)]
    counts, drop = {}, passages.Scratch.drop
    monkeypatch.setattr(passages.Scratch, "drop", lambda self, *names: (counts.update({x: self.spark.read.parquet(self.folder(x)).count() for x in names}), drop(self, *names)))
    passages.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3))
    assert counts["stretches"] <= 25 * n


def test_no_copy_hides_in_a_large_family(spark):
    """Of 800 variants of one passage, those like an earlier one, by brute force over all pairs: each is found, with neighbours or without."""
    r, own = random.Random(1), prose(60, 99)
    texts = [edited(own, r.sample(range(6, 54), 3)) for _ in range(800)]
    rows = passages.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)).collect()
    every = [sets(x) for x in texts]
    like = {i for i in range(800) if any(len(every[i] & every[j]) >= 0.8 * len(every[i] | every[j]) for j in range(i))}
    assert len(like) > 100 and len(like & {x["doc_id"] for x in rows}) >= 0.97 * len(like)
    for x in rows:
        one, two = (sets(" ".join(texts[x[d]].split()[x[a] : x[b]])) for d, a, b in (("doc_id", "start_word", "end_word"), ("src_doc_id", "src_start_word", "src_end_word")))
        assert x["src_doc_id"] < x["doc_id"] and len(one & two) >= 0.8 * len(one | two)


def test_blocks_of_lone_windows(spark, monkeypatch):
    """A group dealt in many blocks makes the same pairs as in one."""
    r, own, found = random.Random(5), prose(60, 98), []
    texts = [edited(own, r.sample(range(6, 54), 3)) for _ in range(150)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    for size in (passages.BLOCK, 16):
        monkeypatch.setattr(passages, "BLOCK", size)
        found.append({tuple(x) for x in passages.repeated_passages(frame).collect()})
    assert found[0] == found[1]


def _some_windows(r, n, k):
    out = np.zeros(k, passages._OWN)
    out["group"], out["c"] = r.integers(0, 4, k), r.integers(0, n, k)
    out["l"], out["r"] = r.integers(0, out["c"] + 1), r.integers(0, n - out["c"].astype(int))
    return out


def test_window_pairs_against_brute_force():
    """Windows of two documents that share a group and enough shingles, also where shingles stand more than once."""
    r = np.random.default_rng(3)
    for trial in range(60):
        body, there = (r.integers(0, r.integers(2, 60), n).astype("<u4") for n in r.integers(1, 80, 2))
        ours, theirs, least = _some_windows(r, len(body), 15), _some_windows(r, len(there), 25), int(r.integers(1, 12))
        order = np.argsort(there, kind="stable")
        one, two = passages._of_pair(ours, body, theirs[np.argsort(theirs["group"])], order, there[order], least)
        span = lambda w: (int(w["c"]), int(w["c"]) - int(w["l"]), int(w["c"]) + int(w["r"]) + 1)
        held = lambda a, b: np.isin(body[a[1] : a[2]], there[b[1] : b[2]]).sum()
        want = {(span(a), span(b)) for a in ours for b in theirs if a["group"] == b["group"] and held(span(a), span(b)) >= least}
        assert {(span(a), span(b)) for a, b in zip(one, two)} == want


def test_lists_of_documents_count_what_two_share(monkeypatch):
    """From shingles to pairs: for each document with lone windows and each earlier one, how often it has what the other holds."""
    monkeypatch.setattr(passages, "BLOCK", 3)
    monkeypatch.setattr(passages, "PAIRED", 20)
    r = np.random.default_rng(4)
    bodies = [r.integers(0, 40, n).astype("<u4") * 97_000_000 for n in r.integers(1, 60, 12)]
    windows = [_some_windows(r, len(x), 5) for x in bodies]
    lone = [int(k) for k in r.integers(0, 4, 12)]
    rows = pa.RecordBatch.from_arrays([pa.array(range(12)), pa.array(lone), pa.array([w.tobytes() for w in windows]), pa.array([x.tobytes() for x in bodies])], names=["id", "n_lone", "windows", "body"])
    dealt = pa.Table.from_batches(passages._deal_held(2)(iter([rows])))
    counts = Counter()
    for bucket in set(dealt["bucket"].to_pylist()):
        for row in passages._lists(dealt.filter(pa.array([b == bucket for b in dealt["bucket"].to_pylist()]))).to_pylist():
            blocks = [(k, row["n"], row["docs"], row["many"]) for k in range((row["size"] - 1) // 3 + 1)]
            given = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*blocks)], names=["block", "n", "docs", "many"])
            for out in passages._paired(iter([given])):
                for x in out.to_pylist():
                    counts[x["doc"], x["src"]] += x["n"]
    part = lambda i, k: {p for w in windows[i][:k] for p in range(int(w["c"]) - int(w["l"]), int(w["c"]) + int(w["r"]) + 1)}
    want = {(i, j): sum(bodies[i][p] in {bodies[j][q] for q in part(j, 5)} for p in part(i, lone[i])) for i in range(12) for j in range(i)}
    assert counts == {k: n for k, n in want.items() if n}


def test_toxicity_of_awkward_rows(spark):
    """Repeated and null ids, very long and empty texts, clashing columns, an id with two labels: a score for each row."""
    kind = "doc_id bigint, text string, label int, score string, toxic int, features string"
    rows = [(i, prose(30, i) + (" horrid" if i % 3 == 0 else ""), 0, "x", 1, "y") for i in range(120)]
    rows += [(5, None, 0, "", 0, ""), (5, "", 0, "", 0, ""), (None, "horrid " * 100_000, 0, "", 0, ""), (7, "women " + prose(20, 7), 0, "", 0, "")]
    labels = [(i, int(i % 3 == 0)) for i in range(100)] + [(3, 0), (3, 1), (None, 1), (10_000, 1)]
    docs = spark.createDataFrame(rows, kind).repartition(3)
    known = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    model = toxicity.learn(docs, known, usable=lambda i: i.isNotNull())
    got = toxicity.score(docs, model).select("doc_id", "score").collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    long = next(r["score"] for r in got if r["doc_id"] is None)
    assert long >= 0.3 > next(r["score"] for r in got if r["doc_id"] == 1)


def test_release_lets_go_of_the_last_query_too(spark, tmp_path):
    """Shuffle files of a finished query are gone soon after, although Spark's queues of events held on to it."""
    files = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(
        spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    scratch = Scratch(spark, "release")
    for k in range(3):
        before = files()
        scratch.save(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), f"t{k}")
        made = files() - before
        assert made
        scratch.release()
        until = time.monotonic() + 3
        while made & files() and time.monotonic() < until:
            time.sleep(0.1)
        assert not made & files()
    scratch.drop("t0", "t1", "t2")


def test_sets_are_compared_with_many_others(spark):
    """A text is sent along with a few hundred sets at most; all its pairs are compared."""
    base = prose(60, 9900)
    docs = spark.createDataFrame([(k, edited(base, [k % 60])) for k in range(400)] + [(1000, base)], "doc_id bigint, text string")
    nodes = docs.mapInArrow(setjoin._contents, "doc_id bigint, node bigint, body binary").select("doc_id", "node", F.length("body").alias("n"))
    one = nodes.where("doc_id = 1000").first()["node"]
    others = [r[0] for r in nodes.where("doc_id < 60").select("node").distinct().collect()]
    pairs = spark.createDataFrame([(one, x) for x in others * 6], "a bigint, b bigint")
    assert len(others) * 6 > setjoin.LISTED
    got = {r["b"]: (r["shared"], r["joint"]) for r in setjoin.compare(pairs, nodes, docs).collect()}
    whole = sets(base)
    wanted = {r["doc_id"]: r["node"] for r in nodes.where("doc_id < 60").collect()}
    for k, node in wanted.items():
        other = sets(edited(base, [k]))
        assert got[node] == (len(whole & other), len(whole | other))


def test_texts_of_wanted_documents_only(spark):
    plain = spark.createDataFrame([(k - 50, f"text {k}") for k in range(3000)] + [(7, "again")], "doc_id bigint, text string")
    wanted = spark.createDataFrame([(-50, 1), (7, 2), (2949, 3), (5000, 4)], "id bigint, x int")
    assert sorted(map(tuple, passages._texts_of(plain, wanted).select("id", "text", "x").collect())) == [
        (-50, "text 0", 1), (7, "again", 2), (7, "text 57", 2), (2949, "text 2999", 3)]
    assert passages._texts_of(plain, wanted.limit(0)).count() == 0


def test_documents_without_a_common_group_are_no_pair(spark):
    """Documents meet where a lone window of the later shares a group, whatever else they hold."""
    def member(i, groups, lone):
        w = np.zeros(len(groups), passages._OWN)
        w["group"], w["c"], w["l"], w["r"] = [np.uint64(g) << np.uint64(33) for g in groups], 30, 30, 30
        return i, lone, w.tobytes(), np.full(80, 5, "<u4").tobytes()

    members = spark.createDataFrame([member(1, [1, 2], 0), member(2, [3], 1), member(3, [2, 4], 1), member(4, [4], 1)], passages.MEMBER)
    grouped = passages._pairs(members, passages._deal_groups(4)).collect()
    assert {(r["doc"], r["src"]) for r in grouped} == {(3, 1), (4, 3)}
    held = passages._pairs(members, passages._deal_held(4)).collect()
    assert {(r["doc"], r["src"]) for r in held} == {(2, 1), (3, 1), (3, 2), (4, 1), (4, 2), (4, 3)}
