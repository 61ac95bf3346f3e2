"""Substring dedup by repeated-phrase automata.

A window is WINDOW consecutive words; it recurs if its word sequence starts at two places of the corpus.
Confirming: each window names an anchor, the 8-gram of least hash in it, so equal windows name equal
anchors and about 7 % of the places need to be compared. The windows that name one anchor occurrence make
its context. Only contexts whose anchor occurs twice are looked at. An anchor's only context, met twice, recurs as a whole
wherever it was met, as no other text can have a part of it. Where an anchor has several contexts their single windows are counted, and
neighbours that always follow each other make a phrase, taken from one of the contexts that have it.
Locating: the phrases are compiled into sharded Aho-Corasick automata, dealt by anchor, and the documents stream
through: every context of such an anchor (each different one once, a word being two characters of 20 bits) through the automaton of
its anchor, the only one that can have a phrase of it. The hits are the only record of what recurs where: a phrase is compiled
from one occurrence, and the others are found by the automaton.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, gram_hashes, lists, mapped, prefix_sums, range_hash, scratch, signed, spans, stash, word_hashes

WINDOW, ANCHOR = 35, 8
_REACH = WINDOW - ANCHOR + 1
#: Contexts in one shard, on average; an anchor with more contexts than SPREAD is dealt to several, each of which gets its phrases.
SHARD, SPREAD = 8_000, 4_000


def anchors(words: np.ndarray, own: np.ndarray, window: int = WINDOW, gram: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """Anchor occurrences in texts laid end to end: (text, anchor, context hash, first window, last window),
    windows counted within the text. own: the bounds of each text's words."""
    reach = window - gram + 1
    n = len(words)
    if n < window:
        return (np.zeros(0, np.int64),) * 5
    g = gram_hashes(words, gram)
    # least hash, then the rightmost place, within reach grams: minima over doubling ranges
    low, at, size = g, np.arange(len(g)), 1
    while size < reach:
        step = min(size, reach - size)
        right = low[step:] <= low[:-step]
        low, at = np.where(right, low[step:], low[:-step]), np.where(right, at[step:], at[:-step])
        size += step
    sizes = np.diff(own)
    text = np.repeat(np.arange(len(sizes)), np.maximum(0, sizes - window + 1))
    count = np.maximum(0, sizes - window + 1)
    start = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count) + own[text]
    at = at[start]
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (at[1:] != at[:-1])
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(text))[: len(heads)] - 1
    first, last, anchor, owner = start[heads], start[tails], at[heads], text[heads]
    sums = prefix_sums(words)
    context = range_hash(sums, first, last + window) ^ ((anchor - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return owner, g[anchor].view(np.int64), context.view(np.int64), first - own[owner], last - own[owner]


def _characters(words: np.ndarray) -> str:
    """Two characters a word, 20 bits of its hash each, surrogates left out."""
    both = np.stack([words % np.uint64(1 << 20), (words >> np.uint64(32)) % np.uint64(1 << 20)], axis=1).astype(np.uint32).ravel()
    return np.where(both >= 0xD800, both + 0x800, both).astype("<u4").tobytes().decode("utf-32-le")


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, bounds in chunks(batches, "text"):
        starts, ends, own = spans(data, bounds)
        owner, a, c, first, last = anchors(word_hashes(data, starts, ends), own)
        r = rows.column(0).to_numpy()[owner]
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c), pa.array(r), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], names=["a", "c", "r", "lo", "hi"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, c, n, kinds, hashes of the windows, characters) of the listed contexts of each text."""
    for rows, data, bounds in chunks(batches, "text"):
        starts, ends, own = spans(data, bounds)
        words = word_hashes(data, starts, ends)
        sums = prefix_sums(words)
        out: list[list] = [[], [], [], [], [], []]
        for i, listed in enumerate(rows.column("listed").to_pylist()):
            for x in listed:
                lo, hi = own[i] + x["lo"], own[i] + x["hi"]
                at = np.arange(lo, hi + 1)
                for column, value in zip(out, (x["a"], x["c"], x["n"], x["kinds"], range_hash(sums, at, at + WINDOW), _characters(words[lo : hi + WINDOW])), strict=True):
                    column.append(value)
        sizes = np.concatenate([[0], np.cumsum([len(x) for x in out[4]])]).astype(np.int64)
        hashes = lists(signed(np.concatenate([np.zeros(0, np.uint64), *out[4]])), sizes)
        yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:4]), hashes, pa.array(out[5], pa.string())], names=["a", "c", "n", "kinds", "windows", "chars"])


def phrases(windows: list[dict], chars: str) -> Iterator[str]:
    """Of a context the phrases that are taken from it: runs of its windows (p, then, before), then being whether
    the next window always follows, before whether the one ahead always goes before."""
    windows = sorted(windows, key=lambda x: x["p"])
    for k, x in enumerate(windows):
        if not k or windows[k - 1]["p"] + 1 != x["p"] or not (windows[k - 1]["then"] and x["before"]):
            begin = x["p"]
        if k + 1 == len(windows) or windows[k + 1]["p"] != x["p"] + 1 or not (x["then"] and windows[k + 1]["before"]):
            yield chars[2 * begin : 2 * (x["p"] + WINDOW)]


def _phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, found = [], []
        for k, (windows, chars) in enumerate(zip(batch.column("windows").to_pylist(), batch.column("chars").to_pylist(), strict=True)):
            for phrase in phrases(windows, chars):
                keys.append(k)
                found.append(phrase)
        yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(keys, pa.int64())), pa.array(found, pa.string())], names=["a", "chars"])


def _locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by shard, its phrases (c null) first, then the contexts that stream through their automaton."""
    spot = pa.struct([("lo", pa.int32()), ("hi", pa.int32())])
    shard, automaton = None, None
    for batch in batches:
        at, spots = [], []
        for k, (own, context, chars) in enumerate(zip(*(batch.column(x).to_pylist() for x in ("shard", "c", "chars")), strict=True)):
            if own != shard:
                shard, automaton = own, ahocorasick.Automaton()
            if context is None:
                automaton.add_word(chars, len(chars))
                continue
            if not len(automaton):
                continue
            if automaton.kind != ahocorasick.AHOCORASICK:
                automaton.make_automaton()
            for end, size in automaton.iter(chars):
                if (end + 1 - size) % 2 == 0:
                    at.append(k)
                    spots.append({"lo": (end + 1 - size) // 2, "hi": (end + 1) // 2})
        rows = pa.array(at, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("a").take(rows), batch.column("c").take(rows), pa.array(spots, spot)], names=["a", "c", "spot"])


def _located(spark: SparkSession, own: DataFrame, occurrences: DataFrame) -> DataFrame:
    """(a, c, spot): for each different context the places, in words, of phrases that recur."""
    contexts = occurrences.groupBy("a", "c").agg(F.count("*").alias("n"), F.min(F.struct("r", "lo", "hi")).alias("at"))
    often = contexts.groupBy("a").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).where("total > 1")
    repeated = stash(spark, contexts.join(often, "a").where("n > 1 or kinds > 1"))
    listed = repeated.where("kinds > 1").groupBy("at.r").agg(F.collect_list(F.struct("a", "c", "n", "kinds", "at.lo", "at.hi")).alias("listed"))
    edges = stash(spark, mapped(own.select("r", "text").join(listed, "r").select("text", "listed"), _contexts, "a bigint, c bigint, n bigint, kinds bigint, windows array<bigint>, chars string").dropDuplicates(["a", "c"]))
    # windows with those next to them; 0 beyond the context, whose ends its words decide
    windows = edges.select("a", "c", "n", "windows", F.posexplode("windows").alias("p", "w"))
    beside = lambda step: F.coalesce(F.get("windows", F.col("p") + step), F.lit(0)).alias
    windows = windows.select("n", "w", F.struct("a", "c", "p").alias("first"), beside(1)("then"), beside(-1)("before"))
    single = lambda x: (F.min(x) == F.max(x)).alias(x)
    recurring = windows.groupBy("w").agg(F.sum("n").alias("n"), F.min("first").alias("first"), single("then"), single("before")).where("n > 1")
    taken = recurring.groupBy(F.col("first.a").alias("a"), F.col("first.c").alias("c")).agg(F.collect_list(F.struct("first.p", "then", "before")).alias("windows"))
    parts = mapped(edges.select("a", "c", "chars").join(taken, ["a", "c"]).select("a", "windows", "chars"), _phrases, "a bigint, chars string")
    # a frequent anchor's contexts go to several shards, its phrases to each of them
    shards = max(1, edges.count() // SHARD)
    spread = edges.where(f"kinds > {SPREAD}").groupBy("a").agg(F.ceil(F.max("kinds") / SPREAD).cast("int").alias("m"))
    phrase = parts.join(spread, "a", "left").withColumn("m", F.coalesce("m", F.lit(1))).select("a", F.lit(None).cast("bigint").alias("c"), "chars", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("x"))
    context = edges.select("a", "c", "chars", F.pmod(F.xxhash64("c"), F.ceil(F.col("kinds") / SPREAD).cast("int")).cast("int").alias("x"))
    dealt = phrase.union(context).withColumn("shard", F.pmod(F.xxhash64("a", "x"), F.lit(shards))).repartition("shard").sortWithinPartitions("shard", F.col("c").isNotNull())
    alone = repeated.where("kinds = 1").select("a", "c", F.struct(F.lit(0).alias("lo"), (F.col("at.hi") - F.col("at.lo") + WINDOW).cast("int").alias("hi")).alias("spot"))
    return stash(spark, mapped(dealt, _locate, "a bigint, c bigint, spot struct<lo:int,hi:int>").distinct().union(alone))


DEDUPED = "n_words bigint, n_removed bigint, kept_sha256 string, kept string"


def remove_repeats(spark: SparkSession, df: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = True) -> DataFrame:
    """key, n_words, n_removed, kept_sha256, kept (words left, joined by one blank; null without with_text): one row for each row of df.

    A word is removed if a window over it recurs anywhere in the input, its own text included; windows are
    judged on the input. Null and empty texts have no word. Repeated rows count as documents of their own,
    so all their windows recur. Word sequences are compared by 64-bit hashes (single words by 40 bits where
    eight words before already agree).
    """
    kind = df.schema[key].dataType.simpleString()
    own = df.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text")).select(F.xxhash64("k", "text").alias("r"), "k", "text")
    occurrences = stash(spark, mapped(own.select("r", "text"), _occurrences, "a bigint, c bigint, r bigint, lo int, hi int"))
    with scratch(spark) as keep:
        located = keep(_located(spark, own, occurrences))
    covered = occurrences.join(located, ["a", "c"]).select("r", F.struct((F.col("lo") + F.col("spot.lo")).alias("lo"), (F.col("lo") + F.col("spot.hi")).alias("hi")).alias("x"))
    cover = covered.groupBy("r").agg(F.collect_set("x").alias("cover"))

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, bounds in chunks(batches, "text"):
            raw = data.tobytes()
            out: list[list] = [[], [], [], []]
            for i, spots in enumerate(rows.column("cover")):
                words = raw[bounds[i] : bounds[i + 1]].split()
                kept = words
                if spots.is_valid:
                    edge = np.zeros(len(words) + 1, np.int32)
                    ends = spots.values
                    np.add.at(edge, ends.field("lo").to_numpy(), 1)
                    np.add.at(edge, ends.field("hi").to_numpy(), -1)
                    kept = list(compress(words, (np.cumsum(edge[:-1]) == 0).tolist()))
                rest = b" ".join(kept)
                for column, value in zip(out, (len(words), len(words) - len(kept), hashlib.sha256(rest).hexdigest(), rest.decode() if with_text else None), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string())], names=[key, "n_words", "n_removed", "kept_sha256", "kept"])

    return mapped(own.join(cover, "r", "left").select("k", "text", "cover"), strip, f"`{key}` {kind}, {DEDUPED}")
