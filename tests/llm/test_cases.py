"""Every operator on nulls, empty and very long texts, repeated rows, empty tables and clashing names."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from colometry.llm import bpe, html, jaccard, lines, media, mixing, nets, phrases, quality
from colometry.llm.common import CHUNK_BYTES
from colometry.llm.queries import vocabulary_path

#: Documents' columns, then names that operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, size long, kept string, n_words long, component_id long, score double, _row long, k long, r long, c long, t string, place int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, "x", 2, 3, 0.5, 4, 5, 6, 7, "y", 8) for i, t in rows], SCHEMA)


def long_text():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    words = [word() for _ in range(20_000)]
    out = " ".join(words[rng.randrange(len(words))] + ("\n" if k % 15 == 14 else "") for k in range(800_000))
    assert len(out) > CHUNK_BYTES
    return out


LONG = long_text()
ROWS = [(None, None), (1, None), (2, ""), (3, " \n\t"), (4, "one two\nthree"), (4, "one two\nthree"), (None, "one two\nthree"), (5, "x" * 300), (6, LONG)]

OPERATORS = {
    "media": lambda spark, df: media.text_media(df),
    "mixing": lambda spark, df: mixing.mix(spark, df),
    "jaccard": lambda spark, df: jaccard.near_duplicates(spark, df),
    "phrases": lambda spark, df: phrases.remove_repeats(spark, df, with_text=False),
    "quality": lambda spark, df: quality.judge(spark, df),
    "toxicity": lambda spark, df: nets.score_toxicity(spark, df, nets.WordNet(), lang="lang"),
    "bpe": lambda spark, df: bpe.encode_texts(spark, df, vocabulary_path(), keep=()),
    "language": lambda spark, df: nets.predict_language(spark, df, nets.ByteNet(["en", "fr"]).ready()),
    "lines": lambda spark, df: lines.dedup_lines(spark, df, with_text=False, short=True),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    out = OPERATORS[name](spark, frame(spark, ROWS)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out) == sorted((i is None, i or 0) for i, _ in ROWS)
    by: dict = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    assert by[4][0] == by[4][1], "equal rows, equal results"
    words = {1: 0, 2: 0, 3: 0, 4: 3, 5: 1, 6: 800_000}
    if name in ("phrases", "quality"):
        assert all(by[i][0].n_words == n for i, n in words.items())
    if name == "mixing":
        assert all(by[i][0].size == n for i, n in words.items()) and all(0 <= r.taken <= 2 * r.size for r in out)
    if name == "media":
        assert by[6][0].n_bytes == len(LONG) and by[1][0].payload_bytes == by[2][0].payload_bytes == 64
    if name == "bpe":
        assert by[6][0].decoded_sha256 == hashlib.sha256(LONG.encode()).hexdigest() and by[1][0].n_tokens == 0
    if name == "jaccard":
        assert by[1][0].n_shingles == 0 and by[1][0].component_id == 1 and by[4][0].component_id == 4
        assert sorted(str(r.component_id) for r in by[None]) == ["4", "None"]
    if name == "language":
        assert by[1][0].lang_pred == by[3][0].lang_pred == "und" and by[6][0].lang_pred in ("en", "fr")
    if name == "lines":
        # of the copies the first is that of the least id: both of its rows are that one document
        assert by[4][0].n_removed == 0 and sorted(r.n_removed for r in by[None]) == [0, 2]
    if name == "toxicity":
        assert by[1][0].score == by[2][0].score and 0 <= by[6][0].score <= 1


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    out = OPERATORS[name](spark, frame(spark, ROWS).limit(0))
    assert out.count() == 0 and out.columns[0] == "doc_id"


def test_pages(spark):
    schema = "page_id long, url string, html string, text string, host string, page long, template string"
    body = "<p>" + "many words of text " * 300_000 + "</p>"
    rows = [(1, None, None), (2, "no url", ""), (3, "http://h/", "<p>a"), (3, "http://h/", "<p>a"), (None, "http://h/x", "<p>b"), (4, "http://h/y", body), (5, "http://h/z", "<" * 1_000_000), (6, "http://h/w", "<div>" * 30_000 + "deep")]
    df = spark.createDataFrame([(*r, "t", "h", 1, "m") for r in rows], schema)
    got = [(r.page_id, r.url, r.text, r.n_chars) for r in html.extract_main(df).collect()]
    assert len(got) == len(rows) and all(n == len(t) for _, _, t, n in got)
    by = {i: t for i, _, t, _ in got}
    assert by[1] == by[2] == "" and by[3] == "a" and by[None] == "b" and len(by[4]) == len(body) - 8 and by[6] == "deep"
    assert html.extract_main(df.limit(0)).columns == ["page_id", "url", "text", "n_chars"]


def test_repeated_ids_in_labels(spark):
    df = spark.createDataFrame([(i % 40, f"good text number {i}" if i % 40 % 2 else f"bad idiot number {i}", "en") for i in range(400)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i % 40, 1 - i % 2, 1) for i in range(80)], "doc_id long, toxic int, quality int")
    net = nets.train_toxicity(df, labels)
    got = {r.doc_id: r.score for r in nets.score_toxicity(spark, df, net).collect()}
    assert np.mean([got[i] for i in range(0, 40, 2)]) > np.mean([got[i] for i in range(1, 40, 2)])


def test_stashed_files_go(spark):
    import os

    from colometry.llm import common

    folder = common.shared_dir(spark).removeprefix("file:")
    assert folder.endswith((spark.conf.get("spark.checkpoint.dir", None) or folder).removeprefix("file:").rstrip("/"))
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    with common.scratch(spark) as keep:
        gone = common.stash(spark, spark.range(3))
        kept = keep(common.stash(spark, gone.where("id > 0")))
    assert kept.count() == 2
    assert {x for x in set(os.listdir(folder)) - before if x.startswith("stash")} == {kept._stash.rsplit("/", 1)[1]}


def test_rows_beside_each_other_do_not_matter(spark):
    df = frame(spark, [r for r in ROWS if r[0] != 6])
    one = sorted(map(str, jaccard.near_duplicates(spark, df.withColumn("doc_id", F.col("doc_id"))).collect()))
    assert one == sorted(map(str, jaccard.near_duplicates(spark, df.repartition(7)).collect()))
