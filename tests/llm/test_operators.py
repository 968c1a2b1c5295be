"""The operators on awkward rows, and against brute force on small inputs."""

import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from custvoice.llm import (decontaminate, eliasfano, kneser_ney, licenses, packing, pages, passages, quality, queries,
                           setjoin, sql, tokens, toxicity)
from tests.compare import connect, duck_rows, spark_rows

SF_DIR = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words int, node string"
rng = random.Random(7)
LEXICON = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(LEXICON) for _ in range(n))


def edited(text, places):
    words = text.split()
    for p in places:
        words[p] = "changed"
    return " ".join(words)


BASE = prose(120, 1)
PASSAGE = prose(70, 2)
TEXTS = [
    (1, BASE), (2, BASE), (3, edited(BASE, [10, 90])), (4, None), (5, ""), (6, " \n\t "), (7, "two words"), (8, "Two  WORDS"),
    (9, prose(60, 3) + " " + PASSAGE + " " + prose(60, 4)), (10, prose(80, 5) + "\n" + PASSAGE + " " + prose(40, 6)),
    (11, prose(30_000, 8)), (None, prose(90, 9)), (12, "### $$$ " * 60), (1, BASE), (13, "ÉCOLE é " + prose(55, 10)),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t or ""), 1, "x") for i, t in TEXTS]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def sets(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_sql(spark, name):
    names, rows = spark_rows(queries.queries()[name](spark, SF_DIR))
    expected_names, expected = duck_rows(connect(SF_DIR), sql.oracle_sql()[name])
    assert names == expected_names
    assert rows == expected


def test_quality(docs, nothing):
    rows = quality.ledger(docs).collect()
    assert len(rows) == len(TEXTS)
    by = {r["doc_id"]: r for r in rows}
    assert by[4]["n_words"] == by[5]["n_words"] == by[6]["n_words"] == 0
    assert by[12]["n_symbols"] == 360 and by[12]["n_repeat_words"] == 120
    kept = quality.filter_quality(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} >= {1, 3, 9, 10, 11} and 12 not in {r["doc_id"] for r in kept.collect()}
    assert quality.ledger(nothing).count() == quality.filter_quality(nothing).count() == 0
    told = {r["rule"]: r["failed"] for r in quality.ablation(quality.ledger(docs), quality.STRICT).collect()}
    assert told["symbols"] == 1 and set(told) == set(quality.STRICT.rules)


def test_quality_hands_a_text_over_once(docs):
    """Python gets the rows alone; a text that is no string is still judged as one."""
    kept = quality.filter_quality(docs)
    plan = kept.sparkSession._jvm.PythonSQLUtils.explainString(kept._jdf.queryExecution(), "formatted")
    (given,) = re.findall(r"MapInArrow\nInput \[(\d+)\]", plan)
    assert given == "1"
    other = quality.filter_quality(docs.withColumn("text", docs["text"].cast("binary")))
    assert Counter(r["doc_id"] for r in other.collect()) == Counter(r["doc_id"] for r in kept.collect())
    assert dict(other.dtypes)["text"] == "binary"


def test_common_shingles_are_counted_in_little_memory():
    """Counts over several rounds are exact, and millions of shingles held once are not sorted again with each round."""
    r = np.random.default_rng(5)
    often = [" ".join(map(str, r.integers(0, 10**6, 9).tolist())) for _ in range(3)]
    texts = [" ".join(map(str, r.integers(0, 10**6, 40_000).tolist())) + " " + " ".join(often[: k % 4]) for k in range(110)]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[k : k + 20])], names=["text"]) for k in range(0, len(texts), 20)]
    tracemalloc.start()
    (found,) = setjoin._common(iter(batches))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    told = Counter(found["n"].to_pylist())
    # Nine words make five shingles; two phrases side by side have four more over their border.
    assert told == {sum(k % 4 >= 1 for k in range(110)): 5, sum(k % 4 >= 2 for k in range(110)): 9, sum(k % 4 >= 3 for k in range(110)): 9}
    assert set(found["sets"].to_pylist()) == {110}
    assert peak < 220e6


def test_common_shingles_of_many_small_sets():
    """Shingles held once do not pile up: a task's memory does not follow its rows."""
    r = np.random.default_rng(6)
    batches = [pa.RecordBatch.from_arrays([pa.array([" ".join(map(str, r.integers(0, 10**6, 500).tolist())) + " a b c d e f" for _ in range(2000)])], names=["text"]) for _ in range(5)]
    tracemalloc.start()
    (found,) = setjoin._common(iter(batches))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found["n"].to_pylist() == [10_000] * 2 and peak < 110e6


def test_set_join(docs, nothing):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in setjoin.component_ids(docs).collect()), key=repr)
    all_sets = [sets(t) for _, t in TEXTS]
    root = list(range(len(TEXTS)))
    for i, a in enumerate(all_sets):
        for j, b in enumerate(all_sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = root[i], root[j]
                root = [y if r == x else r for r in root]
    least = [min((TEXTS[j][0] for j in range(len(TEXTS)) if root[j] == root[i] and TEXTS[j][0] is not None), default=None) for i in range(len(TEXTS))]
    assert got == sorted(((i, len(s), c) for (i, _), s, c in zip(TEXTS, all_sets, least)), key=repr)
    assert setjoin.component_ids(nothing).count() == 0


def test_set_join_of_many_near_copies(spark):
    """Edits of one text, many sharing a passage: the same components as all pairs give."""
    r = random.Random(3)
    texts = [edited(prose(60, 20), r.sample(range(60), r.randint(0, 3))) for _ in range(60)]
    texts += [prose(25, 30) + " " + prose(r.randint(3, 12), 100 + k) for k in range(60)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    got = {x["doc_id"]: x["component_id"] for x in setjoin.component_ids(frame).collect()}
    all_sets, root = [sets(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(all_sets):
        for j in range(i):
            if 100 * len(a & all_sets[j]) >= 80 * len(a | all_sets[j]):
                x, y = max(root[i], root[j]), min(root[i], root[j])
                root = [y if v == x else v for v in root]
    assert got == dict(enumerate(root))


def test_one_of_each(docs):
    kept = setjoin.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = sorted((r["doc_id"] for r in kept.select("doc_id").collect()), key=repr)
    assert ids == sorted([1, 4, 5, 6, 7, 9, 10, 11, 12, 13, None], key=repr)


def test_windows_against_definition():
    gen = np.random.default_rng(0)
    shingles = gen.integers(0, 60, 300).astype(np.uint64)
    counts, t = np.array([120, 0, 30, 150]), 20
    found = passages.compact_windows(shingles, counts, t)
    begin = np.cumsum(counts) - counts
    for k in range(passages.HASHES):
        rank = passages.mix(shingles ^ passages.mix(np.array([k + 1], np.uint64)))
        expected = set()
        for d, n in enumerate(counts):
            own = [(int(x) >> 28, i) for i, x in enumerate(rank[begin[d] : begin[d] + n])]
            for c in range(n):
                left = right = c
                while left > 0 and own[left - 1] > own[c]:
                    left -= 1
                while right < n - 1 and own[right + 1] > own[c]:
                    right += 1
                if right - left + 1 >= t:
                    expected.add((d, c, left, right))
        assert set(zip(*(x.tolist() for x in found[k][:4]))) == expected


def test_passages(docs, nothing):
    rows = {(r["doc_id"], r["src_doc_id"]): r for r in passages.repeated_passages(docs).collect()}
    assert (10, 9) in rows and (2, 1) in rows and (3, 1) in rows
    assert {a for a, _ in rows} == {2, 3, 10}
    assert (rows[10, 9]["start_word"], rows[10, 9]["end_word"]) == (80, 150)
    assert passages.repeated_passages(nothing).count() == 0
    cut = passages.without_repeats(docs)
    texts = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert cut.columns == docs.columns and 2 not in texts and texts[9] == TEXTS[8][1]
    assert texts[10].split() == (prose(80, 5) + " " + prose(40, 6)).split()


def test_passages_among_relatives(spark):
    """Variants of one passage that are not alike hide no copy behind them: brute force over all pairs of documents."""
    r, texts, copies = random.Random(11), [], []
    for family in range(40):
        own = prose(60, 3000 + family)
        pair = [edited(own, r.sample(range(6, 54), 2)) for _ in range(7)]
        texts += [*pair[:5], own, *pair[5:], own]
        copies.append(len(texts) - 1)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    rows = passages.repeated_passages(frame).collect()
    found = {(x["doc_id"], x["src_doc_id"]) for x in rows}
    all_sets = [sets(t) for t in texts]
    like = {(i, j) for i, a in enumerate(all_sets) for j in range(i) if len(a & all_sets[j]) >= 0.8 * len(a | all_sets[j])}
    assert set(copies) <= {i for i, _ in found}
    for x in rows:
        one, two = (sets(" ".join(texts[x[d]].split()[x[a] : x[b]])) for d, a, b in (("doc_id", "start_word", "end_word"), ("src_doc_id", "src_start_word", "src_end_word")))
        assert x["src_doc_id"] < x["doc_id"] and len(one & two) >= 0.8 * len(one | two)
    expected = {i for i, _ in like}
    assert len(expected & {i for i, _ in found}) >= 0.97 * len(expected)


def test_alike_with_insertions():
    """Words put in, taken out or changed on one side: wherever the whole is alike, it is found."""
    gen = np.random.default_rng(5)
    for trial in range(600):
        n = int(gen.integers(50, 130))
        theirs = gen.integers(0, 1 << 60, n).tolist()
        ours = list(theirs)
        for _ in range(int(gen.integers(1, 4))):
            p, k = int(gen.integers(5, len(ours) - 20)), int(gen.integers(1, 15))
            ours[p : p + int(gen.integers(0, 2)) * k] = gen.integers(0, 1 << 60, k * int(gen.integers(0, 2))).tolist()
        if trial % 2:
            ours, theirs = theirs, ours
        pair = [np.array([hash(tuple(x[i : i + 5])) & (1 << 63) - 1 for i in range(len(x) - 4)], np.uint64) for x in (ours, theirs)]
        one, two = (set(x.tolist()) for x in pair)
        if min(len(pair[0]), len(pair[1])) >= 46 and len(one & two) >= 0.8 * len(one | two):
            noise = [gen.integers(1 << 62, 1 << 63, 30).astype(np.uint64) for _ in range(4)]
            found = passages.alike(np.concatenate((noise[0], pair[0], noise[1])), np.concatenate((noise[2], pair[1], noise[3])), 46)
            assert found and max(j - i + 1 for i, j, *_ in found) >= 0.8 * len(pair[0])


def test_passages_with_insertions(spark):
    """The case of 90 words with 11 put in after the first 45, many times over."""
    texts = []
    for k in range(30):
        words_ = prose(90, 5000 + k).split()
        texts += [" ".join(words_), " ".join(words_[:45] + prose(11, 6000 + k).split() + words_[45:])]
    rows = passages.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    whole = {r["doc_id"] for r in rows if r["end_word"] - r["start_word"] >= 95}
    assert len(whole) >= 27


def test_kneser_ney(docs, nothing):
    train = docs.where("doc_id <= 10")
    got = {r["doc_id"]: r for r in kneser_ney.score(docs, kneser_ney.train(train)).collect() if r["doc_id"]}
    lines = [words(t) + [None] for i, t in TEXTS if i is not None and i <= 10]
    single, pairs = Counter(w for x in lines for w in x), Counter(p for x in lines for p in zip([0, *x], x))
    after, n_after, before = Counter(), Counter(), Counter(w for _, w in pairs)
    for (v, _), n in pairs.items():
        after[v] += n
        n_after[v, min(n, 3)] += 1
    d = (0, *kneser_ney.discounts(*(list(pairs.values()).count(k) for k in (1, 2, 3, 4))))
    e = (0, *kneser_ney.discounts(*(list(before.values()).count(k) for k in (1, 2, 3, 4))))
    total, v_size, n_all = sum(before.values()), len(single), sum(single.values())
    free = sum(e[min(n, 3)] for n in before.values()) / total / (v_size + 1)

    def alone(w):
        return max(before[w] - e[min(before[w], 3)], 0) / total + free

    def p(v, w):
        if not after[v]:
            return alone(w)
        n = pairs[v, w]
        return max(n - d[min(n, 3)], 0) / after[v] + sum(d[k] * n_after[v, k] for k in (1, 2, 3)) / after[v] * alone(w)

    assert math.isclose(sum(p(None, w) for w in single) + p(None, "?"), 1) or not after[None]
    for i, text in TEXTS:
        if i in got and i != 1:
            x = [*words(text), None]
            row = got[i]
            assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (len(x), sum(w in single for w in x), n_all)
            assert math.isclose(row["base_score"], sum(math.log10((single[w] + 1) / (n_all + v_size + 1)) for w in x), rel_tol=1e-9)
            assert math.isclose(row["score"], sum(math.log10(p(v, w)) for v, w in zip([0, *x], x)), rel_tol=1e-9)
    empty = kneser_ney.score(docs.where("doc_id = 7"), kneser_ney.train(nothing)).first()
    assert (empty["n_tokens"], empty["n_known"], empty["score"], empty["base_score"]) == (3, 0, 0.0, 0.0)


def test_kneser_ney_buckets_of_pairs_stay_small(spark):
    """A bucket of pairs is merged in one worker's memory: there are two for each partition, and none has much more than its share."""
    texts = [(i, prose(60, 4000 + i)) for i in range(640)]
    rows, _ = kneser_ney.train(spark.createDataFrame(texts, "doc_id bigint, text string").repartition(64))
    sizes = [r[4] >> 32 for r in rows if r[1] == "pairs"]
    assert sum(sizes) == len({p for _, t in texts for p in zip([0, *words(t)], [*words(t), None])})
    assert len(sizes) >= 128 and max(sizes) < 8 * sum(sizes) / 128


def test_encoder():
    from tokenizers import Tokenizer

    plain, fast = Tokenizer.from_file(tokens.vocabulary()), tokens.encoder(tokens.vocabulary())
    r = random.Random(1)
    bits = [" ", "  ", "\n", "a", "I'm", "\t", "é", "漢字", "\xa0", "12", "!!", "<|endoftext|>", " the", "\0", "😀", " \n ", "　"]
    for _ in range(2000):
        text = "".join(r.choice(bits) for _ in range(r.randint(0, 12)))
        assert fast.encode(text).tolist() == plain.encode(text, add_special_tokens=False).ids


def test_encoder_of_batches(monkeypatch):
    """Many texts at once, with a memo that is full again and again, and slices of a few texts."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "MEMO", 300)
    monkeypatch.setattr(tokens, "_SLICE", 500)
    monkeypatch.setattr(tokens, "_GATHER", 64)
    plain, fast = Tokenizer.from_file(tokens.vocabulary()), tokens.Encoder(tokens.vocabulary())
    r = random.Random(2)
    texts = [r.choice([None, "", prose(r.randint(1, 60), 900 + k), " " + prose(5, k), prose(4, k) + "  " + prose(3, k), "x" * 300 + " y", "é\u2003a b", "z" * 700]) for k in range(400)]
    for _ in range(3):
        r.shuffle(texts)
        for text, ids in zip(texts, fast.encode_all(texts)):
            assert ids.tolist() == plain.encode(text or "", add_special_tokens=False).ids


def ids_of(text, end):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(tokens.vocabulary()).encode(text or "", add_special_tokens=False).ids, end]


def test_elias_fano(docs, nothing):
    got = eliasfano.encode_corpus(docs, tokens.vocabulary(), 2).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, 1, 1, *range(2, 14)]
    texts, at = dict(TEXTS), 0
    for r in got:
        ids = ids_of(texts[r["doc_id"]], 2)
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert eliasfano.encode_corpus(nothing, tokens.vocabulary(), 2).count() == 0
    for values in ([], [0], [0, 0, 5, 5, 1000], list(range(0, 9000, 9)), [10**9, 10**9 + 1]):
        whole = eliasfano.EliasFano.from_buffer(memoryview(eliasfano.EliasFano.of(np.array(values, np.int64)).to_bytes()), 0)[0]
        assert whole.values().tolist() == values == [whole.select(i) for i in range(len(values))]
        for i in range(0, len(values) + 1, 97):
            for j in {i, min(i + 1, len(values)), min(i + 300, len(values)), len(values)}:
                assert whole.select_many(i, j).tolist() == values[i:j]


def test_packing(docs, nothing):
    rows = packing.pack(docs, tokens.vocabulary(), 1).collect()
    lengths = Counter()
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == lengths[r["sequence_id"]]
        lengths[r["sequence_id"]] += r["length"]
    assert max(lengths.values()) <= packing.WINDOW
    texts = dict(TEXTS)
    for i in {r["doc_id"] for r in rows} - {1}:
        ids, at = ids_of(texts[i], 1), 0
        for r in sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    assert packing.pack(nothing, tokens.vocabulary(), 1).count() == 0
    parts = packing.partition(np.array([8, 7, 6, 5, 4]), 2)
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in p) for p in parts) == [14, 16]


def test_licenses(docs, nothing, spark):
    some = spark.createDataFrame([(1, "Released under the MIT License."), (2, None), (3, "Licensed under the GNU General Public License, version 3."),
                                  (4, "mit und license"), (5, "under the mit license under the mit license cc-by-nc")], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in licenses.scan(some).collect()}
    assert (got[1]["labels"], got[1]["n_base"], got[1]["first_word"]) == ("mit", 1, 1)
    assert (got[2]["n_words"], got[2]["labels"], got[2]["first_word"], got[2]["score"]) == (0, "", None, 0.0)
    assert (got[3]["base_labels"], got[3]["labels"]) == ("", "gpl-3") and got[4]["labels"] == ""
    assert (got[5]["n_base"], got[5]["last_word"], got[5]["base_labels"]) == (3, 8, "cc-by-nc,mit")
    assert licenses.scan(docs).count() == len(TEXTS) and licenses.scan(nothing).count() == 0


def test_licenses_of_many_statements(spark):
    """All templates in one text, and a statement in a long text that holds every template word: as the SQL twin has them."""
    import duckdb

    everything = ". ".join(t for _, t, _ in licenses.TEMPLATES)
    scattered = " x ".join(licenses.vocabulary())
    texts = [(1, everything), (2, scattered + " " + prose(3000, 70) + " licensed under the GNU Lesser General Public License " + scattered), (3, scattered)]
    texts += [(10 + k, scattered + " x " + t) for k, (_, t, _) in enumerate(licenses.TEMPLATES)]
    names, rows = spark_rows(licenses.scan(spark.createDataFrame(texts, "doc_id bigint, text string")))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", texts)
    assert (names, rows) == duck_rows(con, sql.oracle_sql()["op5_licenses"])
    who, at = names.index("doc_id"), names.index("labels")
    got = {r[who]: set(r[at].split(",")) for r in rows}
    assert got[1] == {label for label, _, _ in licenses.TEMPLATES} and "lgpl" in got[2]


def test_licenses_with_changed_words(spark):
    """Statements with as many words changed as may differ, or one more, anywhere: as the SQL twin has them, whatever words are rare."""
    import duckdb

    r, texts = random.Random(8), []
    for k, (_, text, _) in enumerate(licenses.TEMPLATES * 4):
        w = text.split()
        for p in r.sample(range(len(w)), min(len(w) // 5 + r.randint(0, 1), len(w))):
            w[p] = r.choice(["other", "license", "the"])
        texts.append((k, prose(r.randint(0, 40), 5000 + k) + ". " + " ".join(w) + "; " + prose(10, 6000 + k)))
    texts += [(None, None), (1, ""), (1, ""), (9000, "mozilla " * 3000), (9001, ("cc by 4 0 licensed under " * 800).strip())]
    names, rows = spark_rows(licenses.scan(spark.createDataFrame(texts, "doc_id bigint, text string").repartition(4)))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", texts)
    assert (names, rows) == duck_rows(con, sql.oracle_sql()["op5_licenses"])


def test_postings_follow_rarity():
    tokens = "a b c d e f g h i j".split()
    assert licenses.postings(tokens, tokens) == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    assert licenses.postings(tokens, tokens[::-1]) == [("j", 9), ("i", 8), ("h", 7), ("g", 6)]


def test_pages(spark):
    cases = {
        None: "", "": "", "no markup": "no markup",
        "<nav><a href=x>Home</a></nav><article><h1>T &amp; U</h1><p>One <b>two</b>\n three<p>Four</article><footer>f</footer>": "T & U\nOne two three\nFour",
        "<article><p>A</p><div class='ad'>Buy</div><p>B</p><section id=comments><p>Nice!</p></section></article>": "A\nB",
        "<script>var t='</p>'</script><article><p>cut &am": "cut &am",
        "<div class=menu><ul><li><a href=x>y</a></ul><article><p>open menu": "open menu",
        # Ids of headings and compound names say nothing inside the article; links are text there.
        "<article><h2 id=search>S</h2><p>One</p><h2 id='related-work'>R</h2><p id=comments>Two</p></article>": "S\nOne\nR\nTwo",
        "<article><section class='content side-by-side'><p>A</p></section><p>B</p></article>": "A\nB",
        "<article><p>Text before.</p><ul><li><a href=x>all link</a></li><li>more</li></ul><p><a href=y>link too</a></p></article>": "Text before.\nall link\nmore\nlink too",
        # On pages of nothing but div: no distance where an advert or a share bar was.
        "<body><div id=nav><a href=x>Home</a></div><div class=page><h1>Title</h1><div class='share-bar'>Tweet</div><div class=text>"
        + "<p>A long paragraph of text.</p>" * 3 + "<div class=ad>Buy</div><p>End.</p></div></div><footer>f</footer></body>": "Title\n" + "A long paragraph of text.\n" * 3 + "End.",
        # A list of links set apart inside the article goes; the text decides, not the tag.
        "<article><div><div><p>" + "Real text. " * 9 + "</p></div></div><div><div><ul><li><a href=x>Other one</a></li><li><a href=y>Other two</a></li></ul></div></div></article>":
            ("Real text. " * 9).strip(),
        "<div><p>" + "word " * 60 + "</p></div><nav>n</nav><div><p>Imprint</p></div>": ("word " * 60).strip(),
        "<article><ul><li><a href=x>only</a></li><li><a href=y>links</a></li></ul></article>": "only\nlinks",
    }
    frame = spark.createDataFrame([(i, None, html, 0) for i, html in enumerate(cases)], "page_id bigint, url string, html string, text int")
    rows = {r["page_id"]: r for r in pages.extract(frame).collect()}
    assert [rows[i]["text"] for i in range(len(cases))] == list(cases.values())
    assert all(r["n_chars"] == len(r["text"]) for r in rows.values())


def test_pages_awkward_rows(spark):
    """No rows, repeated rows, a very long page, columns with clashing names, deep nesting."""
    long = "<article>" + "".join(f"<p>Paragraph {k} &eacute;</p><div class=ad>x</div>" for k in range(20_000)) + "</article>"
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    kind = "page_id bigint, url string, html string, text int, n_chars string, blocks string"
    rows = [(1, "u", long, 0, "a", "b"), (2, None, deep, 1, None, ""), (2, None, deep, 1, None, ""), (None, "v", None, 2, "", None)]
    got = sorted(((r["page_id"] or 0, r["url"] or "", r["text"], r["n_chars"]) for r in pages.extract(spark.createDataFrame(rows, kind)).collect()))
    whole = "\n".join(f"Paragraph {k} é" for k in range(20_000))
    assert got == [(0, "v", "", 0), (1, "u", whole, len(whole)), (2, "", "deep", 4), (2, "", "deep", 4)]
    assert pages.extract(spark.createDataFrame([], kind)).count() == 0


def test_regions_against_definition():
    """A region is a longest stretch of lines in which no window of empty lines lies, between lines with text."""
    r = random.Random(9)
    for _ in range(400):
        lengths = [r.choice([0, 0, 0, 1, 9]) for _ in range(r.randint(1, 25))]
        full = [i for i, n in enumerate(lengths) if n]
        expected = []
        for i in full:
            if expected and i - expected[-1][1] <= pages.WINDOW:
                expected[-1] = (expected[-1][0], i)
            else:
                expected.append((i, i))
        assert pages.regions(np.array(lengths)) == expected


def test_decontamination(docs, nothing, spark):
    items = spark.createDataFrame([(1, "A farmer sells 12 kg of apples to Anna for 30 dollars, then gives 5 kg to Bob. How many are left?"), (2, None), (3, "too short")],
                                  "item_id bigint, text string")
    changed = "x y z. A farmer sells 77 kg of apples to Maria for 91 dollars, then gives 8 kg to Tom. How many are left? " + prose(30, 50)
    some = spark.createDataFrame([(1, changed), (2, prose(80, 51)), (3, None), (4, changed.replace("8 kg", "many fine pears"))], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in decontaminate.leaks(some, items).collect()}
    assert set(got) >= {1} and 2 not in got and got[1]["n_changed"] > 0
    assert {r["doc_id"] for r in decontaminate.without_leaks(some, items).collect()} >= {2, 3}
    assert decontaminate.leaks(nothing, items).count() == 0 and decontaminate.leaks(docs, items.limit(0)).count() == 0


def test_decontamination_of_names_that_begin_sentences():
    """Other names, numbers and line breaks: the same question; other sentences are none."""
    item = "Anna has 5 apples. Ben has 7 pears. Carla has 9 plums. Who has most?"
    changed = "Maria has 6 apples. Tom has 2 pears. Lucy has 4 plums. Who has most?"
    texts = [changed, changed.replace(" ", "\n"), changed.replace("6", "six"), "Maria met Tom. Lucy was late. Nobody knew why she came at all. Who has most?"]
    raw = [t.encode() for t in texts]
    made = decontaminate.canonical(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert {row[0] for row in decontaminate.Benchmark.of([1], [item]).leaks(made)} == {0, 1, 2}


def leaked(items, texts):
    raw = [(t or "").encode() for t in texts]
    made = decontaminate.canonical(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    return {(row[0], row[1]) for row in decontaminate.Benchmark.of(list(range(len(items))), items).leaks(made)}


def test_decontamination_of_units_and_long_names():
    items = ["A field is 12 meters long and 7 meters wide. What is its area in square feet?",
             "The train runs 60 km in 2 hours. How far does it get in 5 hours at this speed?",
             "In spring Anna Maria Smith gave 3 apples to Bob and kept the rest for the winter."]
    texts = ["A field is 30 feet long and 9 feet wide. What is its area in square feet?",
             "The train runs 80km in 3 hours. How far does it get in 7h at this speed?",
             "In spring Lucy gave 8 apples to Tom Jones and kept the rest for the winter.", "A field is wide. The train runs. In spring Lucy gave."]
    assert leaked(items, texts) == {(0, 0), (1, 1), (2, 2)}


def test_decontamination_against_brute_force():
    """Random items asked again, each number, name and unit replaced by one other of its own: all are found, and nothing else."""
    names, units = ["Anna", "Bob", "Carla", "Dieter", "Émile", "Fatima"], ["kg", "meters", "dollars", "hours", "litres"]

    def question(seed, again):
        q, change = random.Random(seed), random.Random(seed + 1000)
        other = {w: c for kind in (names, units) for w, c in zip(kind, change.sample(kind, len(kind)))} if again else {}
        numbers, out = {}, []
        for k in range(q.randint(10, 40)):
            kind, word = q.random(), q.choice(LEXICON)
            name, number, unit = q.choice(names), str(q.randint(2, 99)), q.choice(units)
            if kind < 0.12 and k:
                out += [other.get(name, name), word]
            elif kind < 0.25:
                number = numbers.setdefault(number, str(500 + 3 * len(numbers))) if again else number
                unit = other.get(unit, unit)
                out += ([number + unit] if change.random() < 0.3 else [number, unit]) + [word]
            else:
                out.append(word)
        return " ".join(out)

    items = [question(s, False) for s in range(60)]
    texts, expected = [], set()
    for k in range(60):
        texts.append(prose(30, 800 + k) + " " + question(k, True) + " " + prose(30, 900 + k))
        expected.add((len(texts) - 1, k))
        texts.append(prose(80, 1000 + k))
    assert leaked(items, texts) == expected
    assert leaked(items, items) == {(k, k) for k in range(60)}


def test_decontamination_of_numbers_alone():
    """A table of numbers against items with series of numbers: no product of places, nothing found."""
    import time

    r = random.Random(3)
    series = lambda n: " ".join(str(r.randint(0, 9999)) for _ in range(n))
    items = [f"What comes next in the row {series(30)} and why do you think so?" for _ in range(500)] + [series(40), "Anna Bob 5 7"]
    texts = [series(20_000), "Say what comes next in the row 1 2 3 4 5 6 7 8 and why do you think so?", None, ""]
    start = time.perf_counter()
    found = leaked(items, texts)
    assert {t for t, _ in found} <= {1} and time.perf_counter() - start < 20


def test_decontamination_of_repeated_rows(spark):
    item = "A farmer sells 12 kg of apples to Anna for 30 dollars and then gives 5 kg to Bob."
    kind = "doc_id bigint, text string, item_id int, covered string"
    docs = spark.createDataFrame([(1, item, 0, "x"), (1, item, 0, "x"), (None, item, 0, "x"), (2, (prose(50_000, 77) + " " + item), 1, "y")], kind)
    items = spark.createDataFrame([(7, item), (7, item), (8, item.replace("12", "99")), (None, None)], "item_id bigint, text string")
    rows = sorted(((r["doc_id"] or 0, r["item_id"]) for r in decontaminate.leaks(docs, items).collect()))
    assert rows == sorted([(d, i) for d in (0, 1, 1, 2) for i in (7, 7, 8)])
    assert decontaminate.without_leaks(docs, items).count() == 0 and decontaminate.without_leaks(docs, items).columns == docs.columns


def test_toxicity(spark, nothing):
    r = random.Random(5)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((i, prose(40, i) + (" horrid" if bad else "") + (" women" if bad or r.random() < 0.05 else "") + " " + prose(5, i + 999)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame([*rows, (1000, None), (1001, "women " + prose(40, 7777))], "doc_id bigint, text string")
    known = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    model = toxicity.learn(docs, known, usable=lambda i: ~toxicity.held_out(i))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert all((got[i] >= 0.3) == (i % 4 == 0) for i in range(400))
    # A mention that goes with the label in the training texts does not make a clean text toxic.
    assert got[1001] < 0.3 and 0 <= got[1000] < 0.3
    assert toxicity.score(nothing, toxicity.learn(docs, known.limit(0), usable=lambda i: F.lit(True))).count() == 0


def test_pipeline(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, prose(20, 10))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # 12 and the short ones fail the rules, 2 and 3 are copies of 1, 13 leaks the item.
    assert {r["doc_id"] for r in rows} == {1, 9, 10, 11, None}
    assert sum(r["length"] for r in rows if r["doc_id"] == 10) < sum(r["length"] for r in rows if r["doc_id"] == 9)
