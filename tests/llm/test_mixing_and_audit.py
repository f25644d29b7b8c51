"""Pfair mixing, the Merkle audit, the queries' SQL, and the pipeline against a plain version."""

from collections import Counter

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from nearfield.llm import decontam, langid, minhash, mixing, quality, queries, warc
from nearfield.llm._common import plain_words
from tests.conftest import SF001, SF01
from tests.llm.test_links import brute_near


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=8))
def test_every_source_keeps_within_one_block_of_its_share(shares):
    slots, total = mixing.schedule(shares), sum(shares)
    assert sorted(t for own in slots for t in own) == list(range(total)) and [len(s) for s in slots] == shares
    for share, own in zip(shares, slots, strict=True):
        for t in range(total + 1):
            assert abs(sum(x < t for x in own) - share * t / total) < 1
        for j, t in enumerate(own):
            assert j * total // share <= t < -(-(j + 1) * total // share)


def test_mix_keeps_every_row_and_its_shares(spark):
    rows = [(i, "big" if i % 3 else ("small" if i % 2 else None), f"t{i}") for i in range(900)] + [(5, "big", "again")] * 3
    df = spark.createDataFrame(rows, "doc_id long, source string, slot string")
    shares = {"big": 2, "small": 1, None: 1}
    out = mixing.mix(df, shares=shares, block_rows=10).collect()
    assert Counter((r["doc_id"], r["source"]) for r in out) == Counter((i, s) for i, s, _ in rows)
    assert len({r["position"] for r in out}) == len(rows)
    blocks = {}
    for r in out:
        assert blocks.setdefault(r["slot"], (r["source"], r["block"])) == (r["source"], r["block"])
    supply = {s: sum(1 for b in blocks.values() if b[0] == s) for s in shares}
    full = min(supply[s] * 4 // shares[s] for s in shares)  # slots until the first source runs out
    for t in range(full):
        for s, w in shares.items():
            assert abs(sum(1 for slot, b in blocks.items() if slot < t and b[0] == s) - w * t / 4) < 1


def test_mix_edges(spark):
    schema = "doc_id long, source string, text string"
    df = spark.createDataFrame([(None, None, None), (None, None, "a"), (1, "x", ""), (1, "x", "")], schema)
    out = mixing.mix(df)
    assert out.columns == ["doc_id", "source", "text", "block", "slot", "position"] and out.count() == 4
    assert len({r["position"] for r in out.collect()}) == 4
    empty = mixing.mix(df.limit(0))
    assert empty.columns == out.columns and empty.count() == 0 and empty.schema["position"].dataType.typeName() == "long"


def test_rows_of_one_id_have_one_order(spark):
    rows = [(7, "s", f"text {i}") for i in range(60)] + [(None, "s", f"none {i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    places = [{r["text"]: r["position"] for r in mixing.mix(d, block_rows=8).collect()} for d in (df.coalesce(1), df.repartition(7), df.orderBy(F.desc("text")))]
    assert places[0] == places[1] == places[2] and len(set(places[0].values())) == 120


def test_mix_ranks_over_several_ranges(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 7)
    df = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"))
    rows = mixing.mix(df, block_rows=8).orderBy("position").collect()
    assert [r["block"] for r in rows] == [i // 8 for i in range(500)]


def test_no_python_on_the_executors(spark):
    plan = mixing.op2_mix_sources(spark, str(SF001))._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


# ---- audit


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def findings(a, b):
    return sorted(((r["id"], r["status"]) for r in warc.audit(warc.records(a), warc.records(b)).collect()), key=str)


def test_audit_finds_what_differs_and_nothing_else(spark):
    rows = [(i, f"u{i}", f"body {i} " * (i % 50 + 1)) for i in range(0, 30000, 7)] + [(None, None, f"none {i}") for i in range(40)] + [(3, None, None)] * 4
    a = pages(spark, rows)
    assert findings(a, a) == []
    changed = [(i, u, ("X" + h[1:]) if i in (7000, 21007) else h) for i, u, h in rows]
    assert findings(a, pages(spark, changed)) == [(21007, "altered"), (7000, "altered")]
    last = max(r[0] for r in rows if r[0] is not None)
    assert findings(a, pages(spark, [r for r in rows if r[0] != last])) == [(last, "missing")]
    assert findings(pages(spark, [r for r in rows if r[0] != last]), a) == [(last, "extra")]
    fewer = pages(spark, [r for r in rows if r[0] != 3] + [(3, None, None)] * 3)
    assert findings(a, fewer) == [(3, "missing")]


def test_a_loss_or_a_stray_record_in_the_middle_is_one_finding(spark):
    rows = [(i, f"u{i}", f"body {i} " * (i % 50 + 20)) for i in range(1000)]
    a, less, more = pages(spark, rows), pages(spark, [r for r in rows if r[0] != 100]), pages(spark, [*rows, (400, "x", "stray")])
    assert findings(a, less) == [(100, "missing")] and findings(less, a) == [(100, "extra")]
    assert findings(a, more) == [(400, "extra")] and findings(less, more) == [(100, "extra"), (400, "extra")]
    changed = pages(spark, [(i, u, "!" + h) if i == 700 else (i, u, h) for i, u, h in rows if i != 100] + [(None, None, "a")])
    assert findings(a, changed) == [(100, "missing"), (700, "altered"), (None, "extra")]


def test_stored_offsets_confine_the_descent(spark):
    """A replica that brings its own offsets differs only in the range that holds the lost record."""
    a = warc.records(pages(spark, [(i, "u", "x" * 3000 + str(i)) for i in range(500)]))
    b = a.where("id <> 60")
    got = warc.audit(a, b).collect()
    assert [(r["id"], r["status"], r["copies"], r["replica_copies"]) for r in got] == [(60, "missing", 1, 0)]


def test_audit_edges(spark):
    none = pages(spark, [])
    one = pages(spark, [(1, "u", "h")])
    assert findings(none, none) == [] and findings(one, none) == [(1, "missing")] and findings(none, one) == [(1, "extra")]
    nulls = pages(spark, [(None, None, None), (None, None, None), (0, "", "")])
    assert findings(nulls, nulls) == []


def test_tree_has_one_root_over_all(spark):
    rows = warc.records(pages(spark, [(i * 1000, "u", "h" * 600000 if i == 3 else "h") for i in range(40)]))
    tree = warc.build(rows, *warc.heights(rows))
    mixed = warc.records(pages(spark, [(i * 1000, "u", "h") for i in range(40)] + [(None, "u", str(i)) for i in range(9)] + [(-5, "u", "h")]))
    assert warc.build(mixed, *warc.heights(mixed)).levels[-1].count() == 1
    sizes = [level.count() for level in tree.levels]
    assert sizes[-1] == 1 and sizes == sorted(sizes, reverse=True)


# ---- queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in SF01.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = queries.QUERIES[name](spark, str(SF01))
    found = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    got = sorted(str([r[c] for c in names]) for r in df.collect())
    assert got == sorted(str(list(r)) for r in found.fetchall())


def test_all_ten_are_registered():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 11)]


# ---- pipeline


def test_pipeline_equals_a_plain_version(spark):
    docs = spark.read.parquet(str(SF001 / "documents.parquet"))
    rows = {r["doc_id"]: r.asDict() for r in docs.collect()}
    model = langid.fit(docs)
    pred, score = model.score([r["text"] for r in rows.values()])
    kept = {i: r for (i, r), p, s in zip(rows.items(), pred, score, strict=True) if p != "und" and s >= 0.5}
    labels = spark.read.parquet(str(SF001 / "labels.parquet")).select("doc_id", "quality")
    rules = quality.fit(docs, labels)
    import numpy as np

    x = np.array([quality.statistics(r["text"]) for r in kept.values()])
    z = rules.intercept + sum(w * quality.holds(r, x) for r, w in zip(rules.rules, rules.weights, strict=True))
    kept = {i: r for (i, r), v in zip(kept.items(), z, strict=True) if v >= 0}
    near = brute_near([(i, r["text"]) for i, r in kept.items()], 5)
    kept = {i: r for i, r in kept.items() if near[i][1] == i}
    items = [decontam.parsed(r["item_id"], r["text"]) for r in spark.read.parquet(str(SF001 / "benchmark.parquet")).collect()]
    kept = {i: r for i, r in kept.items() if not any(decontam.overlaps(item, plain_words(r["text"]))[0] >= 0.8 for item in items)}
    got = corpus_pipeline.run(spark, str(SF001))
    assert {r["doc_id"] for r in got.collect()} == kept.keys() and 0 < len(kept) < len(rows)
    assert got.columns == [*docs.columns, "block", "slot", "position"]


def test_stages_keep_columns_and_survive_odd_rows(spark):
    docs = spark.read.parquet(str(SF001 / "documents.parquet")).withColumns({"score": F.lit("mine"), "lang_pred": F.lit(1), "kept": F.lit(None).cast("int")})
    odd = spark.createDataFrame([(None, None, None, None, None), (900, "", None, None, 0), (901, "?? 12", "en", None, 5)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.unionByName(odd, allowMissingColumns=True).unionByName(docs.limit(3))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(SF001))
        assert out.columns == docs.columns
        assert out.where("doc_id < 200").count() > 0
    assert corpus_pipeline.STAGES[0][1](spark, docs, str(SF001)).where("doc_id is null or doc_id >= 900").count() == 0
    single = corpus_pipeline.STAGES[2][1](spark, docs, str(SF001))
    assert single.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").count() == 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(SF001)).count() == 0


def test_near_duplicate_stage_keeps_the_smallest_id(spark):
    words = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(9, words, "en", "a", 1), (4, words + " more", "en", "a", 1), (7, "something else entirely", "en", "a", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.dedup_stage(spark, docs, str(SF001)).collect()) == [4, 7]
    twice = docs.unionByName(spark.createDataFrame([(7, f"another text {k}", "en", "b", k) for k in range(9)], docs.schema))
    kept = [sorted(map(tuple, corpus_pipeline.dedup_stage(spark, d, str(SF001)).collect())) for d in (twice.coalesce(1), twice.repartition(5))]
    assert kept[0] == kept[1] and [r[0] for r in kept[0]] == [4, 7]
    assert minhash.near_duplicates(docs).where("kept").count() == 2
