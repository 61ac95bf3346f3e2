"""What stays on disk while a query runs, which plans move texts, and how much is compared."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from colometry.llm import common, lines, quality

STAGES = dict(corpus_pipeline.STAGES)


def shuffle_files(spark) -> set[str]:
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {x for x in (files.apply(k).getName() for k in range(files.size())) if x.startswith("shuffle_")}


def test_stash_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    wide = spark.range(1000).withColumn("k", F.col("id") % 10)
    both = wide.join(wide.groupBy("k").agg(F.max("id").alias("m")).repartition(3), "k").repartition(4, "m")
    held = spark.conf.get(common.FREED)
    with common.scratch(spark):
        held_back = [common.stash(spark, both) for _ in range(2)]
        assert not shuffle_files(spark) - before
        assert [x.count() for x in held_back] == [1000, 1000]
    assert spark.conf.get(common.FREED) == held


def test_quality_stage_joins_no_texts(spark):
    good = "The quiet river bends past the old mill and on towards the sea, where boats wait for the tide. " * 3
    rows = [(1, good, "en", "a", 5), (1, good, "en", "a", 5), (None, good + "So it goes.", None, None, None), (2, None, "en", "a", 0), (3, "too short", "en", "a", 9), (4, good + " More.", "de", "b", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = STAGES["quality_rules"](spark, docs, "")
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Exchange" not in plan
        kept = {r.text for r in quality.judge(spark, docs, key="text").where("kept").collect()}
        assert out.columns == docs.columns
        assert sorted(map(tuple, out.collect()), key=str) == sorted((r for r in rows if r[1] in kept), key=str)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)


def test_bigram_parities_bound_the_edits():
    rng = random.Random(7)
    for n in (30, 31, 200, 900):
        a = "".join(rng.choice("abcde é漢") for _ in range(n))
        for edits in range(lines.edits(n) + 1):
            b = list(a)
            for _ in range(edits):
                at, kind = rng.randrange(len(b)), rng.randrange(3)
                b[at : at + (kind != 0)] = [] if kind == 1 else [rng.choice("abcxyz")]
            (n_a, n_b), words = lines.signs([a, "".join(b)])
            assert (n_a, n_b) == (len(a), len(b))
            assert np.bitwise_count(words[0] ^ words[1]).sum() <= 4 * edits


def test_lines_with_a_common_phrase_form_no_cluster(spark, monkeypatch):
    """Lines that share a phrase by chance are not compared each with each; near copies among them still are found."""
    rng = random.Random(5)
    phrase = " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(20))
    texts = [phrase + "".join(rng.choice("abcdefghijklmnopqrstuvw ") for _ in range(530 - len(phrase))) for _ in range(60)]
    clustered, stash = [], lines.stash

    def counted(session, df):
        out = stash(session, df)
        if {"key", "n", "line", "comp"} == set(df.columns):
            clustered.append(out.count())
        return out

    monkeypatch.setattr(lines, "stash", counted)
    near = [texts[0][:300] + "XY" + texts[0][301:], texts[1][:-3]]
    docs = spark.createDataFrame(list(enumerate(texts + near)), "doc_id long, text string")
    gone = {r.doc_id for r in lines.dedup_lines(spark, docs).where("n_removed > 0").collect()}
    assert gone == {60, 61}
    assert sum(clustered) <= 4
