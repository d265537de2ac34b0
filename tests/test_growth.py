"""Plans whose cost must not grow faster than the tables: what moves, and what is worked out twice."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessera import queries as core
from tessera.functions import phonetic
from tessera.functions import text as T
from tessera.operators import gating, index, retrieve, scoring
from tessera.plans.loop import Index
from tessera.sources import store


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string").repartition(3)


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


TEXTS = ["banana apple banana", "Apple x" + "y" * 100, None, "", "  ", "carrot é apple carrot carrot"]


def test_rationale_is_not_a_condition_of_all_features(spark, tmp_path):
    rows = [(1, 0, "user", "please fix this code"), (1, 1, "assistant", "done")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    df = core.QUERIES["directive_rationale"](spark, str(tmp_path))
    assert "size(" not in "".join(x for x in optimized(df).split("\n") if "Filter" in x)
    assert (1, 0, 13) in [tuple(r) for r in df.collect()]


def test_terms_are_counted_where_rows_are(spark):
    postings = Index.build(docs(spark, TEXTS)).postings
    plan = optimized(postings)
    assert plan.count("regexp_extract_all") == 1 and not [x for x in plan.split("\n") if "Aggregate" in x and "term#" in x]
    got = {(r["doc_id"], r["term"]): r["tf"] for r in postings.collect()}
    assert got == {(0, "banana"): 2, (0, "apple"): 1, (1, "apple"): 1, (1, "x" + "y" * 63): 1, (5, "carrot"): 3, (5, "é"): 1, (5, "apple"): 1}


def test_rows_told_twice_are_summed_up(spark):
    d = docs(spark, ["banana apple", "plum"])
    got = Index.build(d.unionByName(d)).postings.collect()
    assert sorted((r["doc_id"], r["term"], r["tf"]) for r in got) == [(0, "apple", 2), (0, "banana", 2), (1, "plum", 2)]


def test_scores_stay_where_the_segment_is(spark):
    ix = Index.build(docs(spark, TEXTS))
    terms = retrieve.query_terms(spark.createDataFrame([(7, "apple carrot"), (8, "plum")], "query_id long, text string"))
    plan = physical(retrieve.scores(ix.postings, ix.segments, terms))
    assert not [x for x in plan.split("\n") if "hashpartitioning(query_id" in x and "row_ix" in x]
    assert not [x for x in plan.split("\n") if "hashpartitioning(term" in x and "row_ix" in x]


@pytest.mark.parametrize("size", [1, 64, 4096])
def test_bitmaps_are_those_of_the_aggregate(spark, size):
    rng = random.Random(size)
    some = [(s, rng.randrange(8 * size)) for s in range(9) for _ in range(rng.choice([1, 3, 500]))] + [(99, 0), (99, 8 * size - 1)]
    bits = spark.createDataFrame(some, "segment_id long, bit long").repartition(3)
    want = {r["segment_id"]: r["b"] for r in bits.groupBy("segment_id").agg(F.bitmap_construct_agg("bit").alias("b")).collect()}
    assert {r["segment_id"]: r["bitmap"] for r in gating.bitmaps(bits).collect()} == want


def test_terms_are_hashed_once_a_segment(spark):
    """No probe is taken to see whether there is any, and none before a segment's terms are distinct."""
    plan = optimized(gating.signatures(index.term_stats(Index.build(docs(spark, TEXTS)).postings)))
    assert not [x for x in plan.split("\n") if "Filter" in x and "sha2" in x]


def test_counted(spark):
    rng = random.Random(5)
    lists = [[], ["a"], ["b", "a", "b"], *([rng.choice("abcde") for _ in range(rng.randrange(40))] for _ in range(30))]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "id long, w array<string>")
    got = {r["id"]: {x["term"]: x["tf"] for x in r["c"] or []} for r in df.select("id", T.counted("w").alias("c")).collect()}
    assert got == {i: dict(Counter(x)) for i, x in enumerate(lists)}


def test_a_hit_list_reads_its_hits_once(spark, tmp_path):
    d = docs(spark, ["banana apple", "banana"]).withColumn("lang", F.lit("en"))
    d.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "banana")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert "Union" not in optimized(core.QUERIES["hit_list"](spark, str(tmp_path)))


def test_a_table_is_worked_out_once_when_it_is_stored(spark, tmp_path):
    told = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            told.add(batch.num_rows)
            yield batch

    df = spark.range(10).mapInArrow(count, "id long")
    held = store.Store(spark, str(tmp_path))
    key = held.put("t", df)
    assert told.value == 10 and held.has("t", key) and held.put("t", spark.range(10).repartition(3)) == key
    assert sorted(r["id"] for r in held.get("t", key).collect()) == list(range(10)) and not list(tmp_path.rglob("*.part"))


def test_postings_are_worked_out_once_when_they_are_written(spark, tmp_path):
    told = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            told.add(batch.num_rows)
            yield batch

    ix = Index.build(docs(spark, TEXTS))
    counted = ix.postings.mapInArrow(count, ix.postings.schema)
    Index(ix.rows, counted, ix.segments).write(str(tmp_path / "ix"))
    assert told.value == ix.postings.count()


@pytest.mark.parametrize("name", ["batch_search", "cap_doc", "evidence_hints"])
def test_texts_are_dealt_once(spark, name):
    """Segments are counted where texts are read: no second copy of the texts is shuffled."""
    assert physical(core.QUERIES[name](spark, "/root/testdata/sf0.001")).count("REPARTITION_BY_NUM") == 1


def test_sketches_take_the_terms_of_their_rows_alone(spark):
    ix = Index.build(docs(spark, TEXTS))
    items = ix.rows.where("doc_id in (1, 5)").select("segment_id", "row_ix")
    some = ix.postings_in(items.unionByName(items))
    for df in (some, core.QUERIES["row_sketch"](spark, "/root/testdata/sf0.001")):
        plan = optimized(df).split("\n")
        taken = next(i for i, x in enumerate(plan) if "regexp_extract_all" in x)
        assert [x for x in plan[taken:] if "LeftSemi" in x] and not [x for x in plan if "MapInArrow" in x]
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, ix.postings.where("doc_id in (1, 5)").collect()))


@pytest.mark.parametrize("name", ["cap_doc", "evidence_hints"])
def test_terms_that_are_not_asked_for_are_not_counted(spark, name):
    """Words meet the asked terms before any is counted, and postings are sorted once, by segment alone."""
    plan = physical(core.QUERIES[name](spark, "/root/testdata/sf0.001")).split("\n")
    scan = next(i for i, x in enumerate(plan) if "REPARTITION_BY_NUM" in x)
    spot = next(i for i, x in enumerate(plan) if "LeftSemi" in x and i < scan)
    assert not [x for x in plan if "inline" in x] and [x for x in plan[spot:scan] if "explode" in x]
    assert not [x for x in plan[:scan] if "SortMergeJoin [segment_id" in x]


def test_asked_postings_are_those_of_the_index(spark):
    df = docs(spark, TEXTS)
    few = spark.createDataFrame([(1, "apple"), (2, "carrot"), (2, "nowhere"), (3, "apple")], "query_id long, term string")
    for phonetic in (False, True):
        ix = Index.build(df, phonetic=phonetic)
        some = ix.asked(few).where("term in ('apple', 'carrot')").select("segment_id", "row_ix", "doc_id", "term", "tf")
        assert sorted(map(tuple, some.collect())) == sorted(map(tuple, ix.postings.where("term in ('apple', 'carrot')").collect())) != []


def test_rows_are_numbered_whatever_their_order():
    row, doc, place = scoring.row_places(np.array([3, 0, 3, 0, 3]), np.array([9, 5, 8, 5, 9]))
    assert row.tolist() == [0, 3, 3] and doc.tolist() == [5, 8, 9] and place.tolist() == [2, 0, 1, 0, 2]


def test_no_threads_of_numpy_beside_the_tasks(spark):
    core.QUERIES["evidence_hints"](spark, "/root/testdata/sf0.001")
    assert spark.sparkContext.environment["OPENBLAS_NUM_THREADS"] == "1"


def test_codes_are_asked_by_their_words(spark, monkeypatch):
    """Words that sound like an asked code go to the rows: no postings are told by their codes, and codes are made in many tasks."""
    ix = Index.build(docs(spark, ["a knight rides", "the nite falls, nite", "123 _", "night and day"]), phonetic=True)
    few = spark.createDataFrame([(1, "~NT"), (1, "knight"), (2, "~XX"), (2, "nowhere")], "query_id long, term string")
    some = ix.asked(few)
    want = sorted(map(tuple, ix.postings.where("term in ('~NT', 'knight')").collect()))
    assert sorted(map(tuple, some.select("segment_id", "row_ix", "doc_id", "term", "tf").collect())) == want and len(want) == 4
    assert "inline" not in optimized(some) and "regexp_replace" not in optimized(some)
    assert phonetic.codes_of(few).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    monkeypatch.setattr(index, "BROADCAST_HEARD", 1)
    assert sorted(map(tuple, ix.asked(few).select("segment_id", "row_ix", "doc_id", "term", "tf").collect())) == want
