"""Near-duplicates, embedding links and decontamination against brute force."""

import re
from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nearfield.llm import _blocks, _graph, decontam, embeddings, minhash
from nearfield.llm._common import plain_words, text_chunks, word_hashes, words_of
from nearfield.llm._graph import components, merged
from tests.conftest import SF001, SF01


class Union:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def root(self, i):
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def plain_shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def brute_near(rows, size, percent=80):
    """id -> (shingles, component) by comparing all pairs that share a shingle."""
    sets = {i: plain_shingles(t, size) for i, t in rows}
    u = Union(sets)
    by = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    seen = set()
    for own in by.values():
        for a, b in combinations(sorted(own), 2):
            if (a, b) not in seen and 0.8 * max(len(sets[a]), len(sets[b])) <= min(len(sets[a]), len(sets[b])):
                seen.add((a, b))
                if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    u.join(a, b)
    return {i: (len(s), u.root(i)) for i, s in sets.items()}


@pytest.mark.parametrize("small", [1 << 14, 3])
def test_components(spark, monkeypatch, small):
    monkeypatch.setattr(_graph, "SMALL", small)
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(i, i + 1) for i in range(200, 240)]
    u = Union(range(300))
    for a, b in edges:
        u.join(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: u.root(i) for e in edges if e[0] != e[1] for i in e}
    half = components(spark.createDataFrame(edges[:50], "a long, b long")).withColumnRenamed("component", "c")
    more = {r["node"]: r["c"] for r in merged(half, spark.createDataFrame(edges[50:], "a long, b long")).collect()}
    assert all(more[i] == c for i, c in got.items())
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_many_links_are_joined_without_rounds(spark, monkeypatch):
    """100,000 links of a shuffled chain: one table is written and one task joins them, however long the chain is."""
    tables = []
    monkeypatch.setattr(_graph, "written", lambda df, f=_graph.written: tables.append(df) or f(df))
    order = np.random.default_rng(2).permutation(100_001)
    edges = pd.DataFrame({"a": order[:-1], "b": order[1:]})
    got = components(spark.createDataFrame(edges, "a long, b long")).toPandas()
    assert len(tables) == 1
    assert len(got) == 100_001 and (got["component"] == 0).all()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aBé \t\n", max_size=12), min_size=1, max_size=6))
def test_word_hashes_follow_the_words(texts):
    parts = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(parts), np.uint8)
    starts = np.cumsum([0, *map(len, parts)])[:-1]
    hashes, per = word_hashes(data, starts)
    words = [words_of(t) for t in texts]
    assert per.tolist() == [len(w) for w in words]
    named = {}
    for h, w in zip(hashes.tolist(), [w for own in words for w in own], strict=True):
        assert named.setdefault(w, h) == h
    assert len(set(named.values())) == len(named)


@pytest.mark.parametrize("size", [2, 5])
def test_shingle_counts(size):
    texts = ["a b c d e f", "a", "", "a b a b a b a", "x y"]
    words, per = word_hashes(np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *map(len, texts)])[:-1])
    h, each = minhash.shingle_hashes(words, per, size)
    at = np.append(0, np.cumsum(each))
    assert [len(set(h[a:b].tolist())) for a, b in zip(at, at[1:], strict=False)] == [len(plain_shingles(t, size)) for t in texts]


def near_texts():
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(6):
        base = list(rng.choice(vocabulary, 90))
        for _ in range(25 if g == 0 else 4):
            w = base[:]
            for k in rng.integers(0, 90, int(rng.integers(0, 5))):
                w[k] = str(rng.choice(vocabulary))
            rows.append(" ".join(w))
    rows += [" ".join(rng.choice(vocabulary, 50)) for _ in range(20)]
    return [(i * 3 + 1, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("size,block", [(2, 1024), (2, 4), (5, 1024)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, size, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "CLUSTER_BLOCK", 3 if block == 4 else 256)
    rows = near_texts()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=size).collect()}
    assert got == brute_near(rows, size)
    assert len({c for _, c in got.values()}) < len(rows) - (20 if size == 2 else 8)


def test_a_large_cluster_costs_what_it_holds(spark, monkeypatch):
    """Near copies of one text in many blocks: the rows that meet grow as the cluster does, and nothing is lost."""
    monkeypatch.setattr(minhash, "CLUSTER_BLOCK", 8)
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(150)]
    met = []
    links = minhash._links
    monkeypatch.setattr(minhash, "_links", lambda rows, *a: met.append(rows.count()) or links(rows, *a))
    sizes = {}
    for n in (200, 800):
        rows = []
        for i in range(n):
            w = base[:]
            for k in rng.integers(0, 150, 3):
                w[k] = f"x{int(rng.integers(0, 10**6))}"
            rows.append((i, " ".join(w)))
        met.clear()
        got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=2).collect()
        assert {r["component_id"] for r in got} == {0}
        sizes[n] = sum(met)
    assert sizes[800] < 5 * sizes[200] and sizes[800] < 3 * 800


def left_outer_rows(spark, since):
    """Rows that left outer joins have made in the executions of this session from number ``since`` on."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store = spark._jsparkSession.sharedState().statusStore()
    total, executions = 0, store.executionsList()
    for i in range(executions.size()):
        k = executions.apply(i).executionId()
        if k < since:
            continue
        values, nodes = store.executionMetrics(k), store.planGraph(k).allNodes()
        for node in (nodes.apply(j) for j in range(nodes.size())):
            if "LeftOuter" in node.desc():
                for m in (node.metrics().apply(j) for j in range(node.metrics().size())):
                    if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                        total += int(values.apply(m.accumulatorId()).replace(",", ""))
    return total, max((executions.apply(i).executionId() for i in range(executions.size())), default=-1) + 1


def test_labels_are_looked_up_once_for_each_member(spark, monkeypatch):
    """Near copies of one text: a member's label isn't looked up for each of its buckets and rounds."""
    monkeypatch.setattr(minhash, "CLUSTER_BLOCK", 8)
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(150)]
    made = {}
    for n in (200, 400):
        rows = []
        for i in range(n):
            w = base[:]
            for k in rng.integers(0, 150, 3):
                w[k] = f"x{int(rng.integers(0, 10**6))}"
            rows.append((i, " ".join(w)))
        since = left_outer_rows(spark, 0)[1]
        got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=2).collect()
        assert {r["component_id"] for r in got} == {0}
        made[n] = left_outer_rows(spark, since)[0]
    assert 0 < made[400] < 3 * made[200] and made[400] <= 8 * 400


def test_rounds_end_when_they_join_few(spark, monkeypatch):
    """Pages of one template, every second with a near copy: rounds end before the last, and every copy is found all the same."""
    monkeypatch.setattr(minhash, "CLUSTER_BLOCK", 8)
    rng = np.random.default_rng(12)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(160):
        w = base[:]
        for k in rng.choice(119, 8, replace=False):
            w[k] = f"x{int(rng.integers(0, 10**6))}"
        rows.append((i, " ".join(w)))
        if i % 2:
            rows.append((1000 + i, " ".join([*w[:-1], "y"])))
    met = []
    links = minhash._links
    monkeypatch.setattr(minhash, "_links", lambda rows, *a: met.append(rows.count()) or links(rows, *a))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=2).collect()}
    assert got == brute_near(rows, 2)
    assert len({c for _, c in got.values()}) > 100 and met[1] > 100
    assert len(met) <= 4


def test_members_apart_meet_all_others(spark, monkeypatch):
    """Every pair with a member outside the largest component shares a group."""
    monkeypatch.setattr(minhash, "CLUSTER_BLOCK", 3)
    rows = [(0, i, 5, 100 if i % 3 else i) for i in range(40)] + [(1, 50 + i, 5, 50 + i) for i in range(7)] + [(2, 90 + i, 5, 90) for i in range(9)]
    got = minhash._apart(spark.createDataFrame(rows, "c long, node long, n long, label long")).collect()
    groups = {}
    for r in got:
        groups.setdefault((r["c"], r["x"], r["y"]), []).append(r["node"])
    together = {p for own in groups.values() for p in combinations(sorted(own), 2)}
    label = {node: (c, lab) for c, node, _, lab in rows}
    for (a, (ca, la)), (b, (cb, lb)) in combinations(sorted(label.items()), 2):
        if ca == cb and ca < 2 and (la != 100 or lb != 100) and not (ca == 1 and {a, b} == set()):
            assert (a, b) in together or la == lb
    assert not any(c == 2 for c, *_ in groups)


def test_near_duplicate_edges(spark):
    long = " ".join(f"t{i}" for i in range(30000))
    rows = [(5, None), (6, ""), (7, " \n"), (8, "one"), (9, "One"), (10, "same words here"), (10, "same words here"), (3, "Same WORDS here"), (None, "same words here"), (11, long), (12, long + " tail"), (13, "ONE  "), (14, "É un"), (15, "é un")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, component_id string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df, size=2).collect()), key=str)
    want = [(5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 1, 8, True), (9, 1, 8, False), (13, 1, 8, False), (10, 2, 3, False), (10, 2, 3, False), (3, 2, 3, True), (None, 2, None, True), (11, 29999, 11, True), (12, 30000, 11, False), (14, 1, 14, True), (15, 1, 15, True)]
    assert got == sorted(want, key=str)
    assert minhash.near_duplicates(df.limit(0)).count() == 0
    assert minhash.near_duplicates(df.where("text is null")).first()["n_shingles"] == 0


def test_long_texts_are_signed_whole(monkeypatch):
    """Pieces of a long text count together, also where the last of them shares a run with short texts."""
    same = "one two three four five six seven eight "
    texts = ["short one", same + "nine ten eleven", "short two", same + "other words here", "short three", None, "a b c d e f g h " * 9, "", "end"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["id", "text"])
    whole = [b.to_pylist() for b in minhash._signed(2)(iter([batch]))]
    assert [r["n"] for r in whole[0]] == [len(plain_shingles(t, 2)) for t in texts] and whole[0][1]["fp"] != whole[0][3]["fp"]
    for limit in (11, 20, 39, 50):
        monkeypatch.setattr(minhash, "text_chunks", partial(text_chunks, limit=limit))
        assert [b.to_pylist() for b in minhash._signed(2)(iter([batch]))] == whole


def test_shared_counts(monkeypatch):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(minhash, "COLUMNS", 7)
    sets = [np.unique(rng.integers(0, 40, int(rng.integers(0, 30))).astype(np.uint64)) for _ in range(12)]
    assert minhash.shared_counts(sets).tolist() == [[len(set(a.tolist()) & set(b.tolist())) for b in sets] for a in sets]


def test_near_duplicates_of_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(str(SF01 / "documents.parquet")).select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.op4_near_duplicates(spark, str(SF01)).collect()}
    assert got == brute_near(rows, 2)


def test_every_pair_within_the_distance_shares_a_key():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a = rng.integers(0, 1 << 16, minhash.SYMBOLS)
        b = a.copy()
        b[rng.choice(minhash.SYMBOLS, minhash.DISTANCE, replace=False)] ^= 1
        agree = (a == b)[None]
        four = agree.reshape(1, minhash.CHUNKS, minhash.PER_CHUNK)
        assert ((four.sum(2, keepdims=True) - four) == minhash.PER_CHUNK - 1).any()


# ---- embeddings


def brute_links(rows, threshold=0.93):
    """id -> (links, component)."""
    distinct = {}
    for i, v, label in rows:
        if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            distinct.setdefault((i, label, tuple(v)), np.array(v, float))
    u = Union({i for i, *_ in rows if i is not None})
    links = dict.fromkeys(u.up, 0)
    for ((a, la, va), x), ((b, lb, vb), y) in combinations(distinct.items(), 2):
        if la == lb and len(va) == len(vb) and a != b and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
            links[a] += 1
            links[b] += 1
            u.join(a, b)
    return {i: (n, u.root(i)) for i, n in links.items()}


@pytest.mark.parametrize("block", [1024, 5])
def test_links_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "shared_buckets", partial(_blocks.shared_buckets, block=block))
    rng = np.random.default_rng(3)
    rows = []
    for g in range(12):
        centre = rng.standard_normal(16)
        for _ in range(20 if g == 0 else 5):
            rows.append((len(rows) + 7, (centre + 0.07 * rng.standard_normal(16)).astype(np.float32).tolist(), g % 3))
    rows += [(900 + k, rows[2][1], rows[2][2]) for k in range(6)]
    rows += [(800, None, 1), (801, [0.0] * 16, 1), (802, [float("nan")] + [1.0] * 15, 1), (803, [None] + [1.0] * 15, 1), (804, rows[0][1], None), (None, rows[0][1], rows[0][2]), (805, [1.0, 2.0], 0), (806, [2.0, 4.0], 0), (807, [], 0), (900, rows[2][1], rows[2][2]), (808, [3e38] * 16, 2), (809, [1e-30] * 16, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("kept", F.lit("mine"))
    got = embeddings.link(df).collect()
    assert len(got) == len(rows)
    want = brute_links([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows])
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got if r["vec_id"] is not None} == want
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert embeddings.link(df.limit(0)).count() == 0


def test_links_of_doubles_and_text_labels(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [1.0, 0.1], "a"), (3, [1.0, 0.0], "b"), (4, [-1.0, 0.0], "a")], "vec_id long, embedding array<double>, label string")
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embeddings.link(df).collect()) == [(1, 1, 1), (2, 1, 1), (3, 0, 3), (4, 0, 4)]


# ---- decontamination


def brute_search(index, words):
    score = {}
    for w in set(words):
        for d, v in zip(*(index.postings[w][:2] if w in index.postings else ((), ())), strict=True):
            score[d] = score.get(d, 0.0) + v
    return {d: v for d, v in score.items() if v >= 1.0 - 1e-9}


def test_wand_equals_brute_force():
    rng = np.random.default_rng(0)
    vocabulary = [f"v{i}".encode() for i in range(150)]
    weights = 1 / np.arange(1, 151)
    draw = lambda n: [vocabulary[i] for i in rng.choice(150, n, p=weights / weights.sum())]
    items = [decontam.Item(i, w := draw(int(rng.integers(3, 90))), w[-3:]) for i in range(120)]
    index = decontam.BlockMaxIndex(items, block=4)
    found = 0
    for k in range(150):
        words = draw(100) + (items[k % 120].words if k % 2 else [])
        got = dict(index.retrieve(words))
        want = brute_search(index, words)
        assert got.keys() == want.keys() and all(abs(got[d] - want[d]) < 1e-9 for d in got)
        found += len(got)
    assert found > 75


def test_no_passage_is_lost_to_the_bound():
    rng = np.random.default_rng(4)
    vocabulary = [f"word{i}".encode() for i in range(300)]
    items = [decontam.Item(i, w := [vocabulary[j] for j in rng.integers(0, 300, 40)], w[-4:]) for i in range(30)]
    index = decontam.BlockMaxIndex(items)
    for k in range(40):
        words = [vocabulary[j] for j in rng.integers(0, 300, 500)]
        at = int(rng.integers(0, 460))
        words[at : at + 40] = items[k % 30].words
        kept = index.candidates(words)
        for passage in range(-(-(len(words) - decontam.PASSAGE) // decontam.STRIDE) + 1):
            if brute_search(index, words[passage * decontam.STRIDE : passage * decontam.STRIDE + decontam.PASSAGE]):
                assert passage in kept


def test_leaks_of_documents_equal_containment(spark):
    items = [decontam.parsed(r["item_id"], r["text"]) for r in spark.read.parquet(str(SF01 / "benchmark.parquet")).collect()]
    want = set()
    for r in spark.read.parquet(str(SF01 / "documents.parquet")).select("doc_id", "text").collect():
        words = plain_words(r["text"])
        there = set(zip(*(words[k:] for k in range(5)), strict=False))
        for item in items:
            own = set(zip(*(item.words[k:] for k in range(5)), strict=False))
            if len(own & there) >= 0.8 * len(own):
                want.add((r["doc_id"], item.item_id))
    got = {(r["doc_id"], r["item_id"]) for r in decontam.op9_decontamination(spark, str(SF01)).collect()}
    assert got == want and len(want) > 10


QUESTION = "Which river runs through the old capital of the northern province? The answer is the winding silver river."


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, QUESTION), (1, QUESTION), (2, None), (3, ""), (None, "text without id"), (4, "two words")], "item_id long, text string")


def test_leak_edges(spark, items):
    filler = " ".join(f"filler{i}" for i in range(3000))
    # the seventh text lacks 3 of 14 shingles, the eighth the answer
    docs = [(1, None), (2, ""), (3, filler + " " + QUESTION.upper() + " " + filler), (None, QUESTION), (7, QUESTION.replace("winding", "narrow")), (8, QUESTION.split("?")[0]), (5, filler), (6, "these two words here"), (6, "these two words here")]
    df = spark.createDataFrame([(*d, 0.5, True) for d in docs], "doc_id long, text string, bm25 double, _clean boolean")
    rows = decontam.find_leaks(df, items).collect()
    assert sorted(((r["doc_id"], r["item_id"]) for r in rows), key=str) == sorted([(3, 1), (None, 1), (6, 4), (6, 4)], key=str)
    assert all(r["overlap"] == 1.0 for r in rows)
    clean = decontam.without_leaks(df.withColumn("_clean", F.col("doc_id") == 2), items)
    assert clean.columns == df.columns and sorted((r["doc_id"], r["_clean"]) for r in clean.collect()) == [(1, False), (2, True), (5, False), (7, False), (8, False)]
    assert decontam.find_leaks(df.limit(0), items).count() == 0 and decontam.find_leaks(df, items.limit(0)).count() == 0
    assert decontam.find_leaks(spark.read.parquet(str(SF001 / "documents.parquet")).limit(0), items).columns == ["doc_id", "item_id", "bm25", "overlap", "answer_overlap"]


def test_leaks_are_the_same_for_any_number_of_indexes(spark, monkeypatch):
    """Texts with parts of items, for which thresholds matter, against one index and several."""
    items = spark.read.parquet(str(SF01 / "benchmark.parquet"))
    rng = np.random.default_rng(6)
    texts = []
    for r in items.collect():
        words = r["text"].split()
        for share in (0.8, 0.85, 0.9, 1.0):
            own = words[: int(len(words) * share)] if rng.random() < 0.5 else words[int(len(words) * (1 - share)) :]
            texts.append(" ".join([*(f"f{int(x)}" for x in rng.integers(0, 99, 150)), *own, "and", "more"]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = lambda: sorted(tuple(r) for r in decontam.find_leaks(df, items).collect())
    one = found()
    kept = sorted(r[0] for r in decontam.without_leaks(df, items).select("doc_id").collect())
    monkeypatch.setattr(decontam, "PART_BYTES", 1000)
    assert len(list(decontam.indexes(items))) > 5
    assert found() == one and 40 < len(one) < len(texts)
    assert sorted(r[0] for r in decontam.without_leaks(df, items).select("doc_id").collect()) == kept == sorted(set(range(len(texts))) - {r[0] for r in one})
    monkeypatch.setattr(decontam, "HELD_BYTES", 1)
    assert found() == one
