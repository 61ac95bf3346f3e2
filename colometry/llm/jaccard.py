"""N-gram Jaccard join: exact near-duplicate links among all documents, by signature trees.

A document's set holds its distinct shingles as 64-bit hashes. Documents of equal sets form a class with
one representative, so copies cost nothing further. Of two sets with Jaccard similarity 0.8 or more, each
one's first n - ceil(0.8 n) + 1 tokens in any one order of all tokens share a token (prefix filter); the
order puts a bounded list of the most frequent tokens last. Classes that share such a token meet in a
group. A group's members are the leaves of a signature tree, whose nodes hold OR-combined token bitmaps and
size ranges; a dual traversal drops node pairs whose largest possible overlap is too small. What is left is
verified on the whole sets.

Two sets can only be similar if sizes and the places of their first common token in the order allow it: a
member at place p of n meets others of size up to ((10 + T)(n - p) - T n) / T, T tenths being the bound, and the other way round.

Links that would join what is joined already need no check, so there are three rounds. The first takes few
tokens, which joins most copies; the second all prefix tokens, but only of groups that still hold two
components. In both each component names its best partners of other components in a group, so a group of m
members makes m pairs or few times that, which are verified on the texts. Members of pairs that were left out
there, and that a token still holds together in two components, form clusters by these tokens. In the third round each member's whole set
is sent once to each pair of blocks of its cluster, where every pair of different components that the
tree leaves is compared; what comes back is a spanning forest, again m links at most. No pair
is left out there, so the components are those of all links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import KNOWN, chunks, components, gram_hashes, lists, lowered, mapped, merged, mix, prefix_sums, range_hash, scratch, signed, spans, stash, word_hashes

GRAM, TENTHS = 5, 8
#: Tokens in the list of frequent ones, and occurrences in one buffer of TOKEN_BUFFER tokens that make a candidate for it.
FREQUENT, OFTEN, TOKEN_BUFFER = 1 << 16, 8, 1 << 21
#: Tokens used in the first round; partners that a component names in a group of the first and of the second round.
FIRST_TOKENS, PARTNERS = 4, (2, 1)
#: Members of a group, and of a cluster, that are compared in one task, and tokens of their sets in a cluster; larger ones are compared by pairs of blocks.
BLOCK, CLUSTER_BLOCK, BLOCK_TOKENS = 2048, 512, 1 << 19
LEAF = 16
#: Pairs that a tree gives at once.
STEP = 1 << 17
#: Keys of documents to verify that may be broadcast (8 bytes each); beyond, the texts are shuffled and joined.
BROADCAST = 2_000_000


def token_sets(data: np.ndarray, bounds: np.ndarray, gram: int = GRAM) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text, lower-cased; one hash for fewer words than gram, none for no word."""
    starts, ends, own = spans(data, bounds)
    words = word_hashes(lowered(data), starts, ends)
    grams = gram_hashes(words, gram)
    for a, b in zip(own[:-1].tolist(), own[1:].tolist(), strict=True):
        if b - a >= gram:
            yield np.unique(grams[a : b - gram + 1])
        elif b > a:
            yield range_hash(prefix_sums(words[a:b]), np.zeros(1, np.int64), np.full(1, b - a))
        else:
            yield np.zeros(0, np.uint64)


def fingerprint(tokens: np.ndarray) -> int:
    """64 bits of the whole set; two different sets of one corpus share it with a chance of 2**-64 a pair."""
    with np.errstate(over="ignore"):
        both = np.array([tokens.sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(tokens + np.uint64(0x5851F42D4C957F2D)))], np.uint64)
        return int((mix(both[:1]) * np.uint64(3) + mix(both[1:] + np.uint64(len(tokens)))).view(np.int64)[0])


def prefix_length(n: int) -> int:
    return n - (TENTHS * n + 9) // 10 + 1


def width(n: int) -> int:
    """Bits of a set's bitmap: 2 to 4 a token, up to 32 in small sets, whose bitmaps then tell them apart almost exactly."""
    return max(64, 1 << (max(2 * n, min(16 * n, 1024)) - 1).bit_length())


def bitmap(tokens: np.ndarray) -> bytes:
    w = width(len(tokens))
    bits = np.zeros(w, dtype=bool)
    bits[(tokens & np.uint64(w - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


# ---------------------------------------------------------------- signature trees


class Tree:
    """Members in the given order as leaves of LEAF; each level above halves the nodes."""

    def __init__(self, maps: np.ndarray, n: np.ndarray) -> None:
        self.maps, self.n = maps, n
        self.slack = n - np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
        cuts = np.arange(0, len(n), LEAF)
        level = (np.bitwise_or.reduceat(maps, cuts, axis=0), np.minimum.reduceat(n, cuts), np.maximum.reduceat(n, cuts), np.maximum.reduceat(self.slack, cuts))
        self.levels = [level]
        while len(level[1]) > 1:
            cuts = np.arange(0, len(level[1]), 2)
            level = (np.bitwise_or.reduceat(level[0], cuts, axis=0), np.minimum.reduceat(level[1], cuts), np.maximum.reduceat(level[2], cuts), np.maximum.reduceat(level[3], cuts))
            self.levels.append(level)

    @staticmethod
    def possible(shared: np.ndarray, lo: tuple, hi: tuple, slack: tuple) -> np.ndarray:
        """Whether sets of such sizes with so many shared bits can be similar enough.

        Shared tokens lie on shared bits; a set has slack more tokens than bits, so at most that many more.
        """
        most = np.minimum(np.minimum(*hi), shared + np.minimum(*slack))
        return (10 + TENTHS) * most >= TENTHS * (lo[0] + lo[1])

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(i, j, shared bits) with i < j of all members that may be similar, about STEP at once."""
        a = b = np.zeros(1, np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            maps, lo, hi, slack = self.levels[depth]
            shared = np.concatenate([np.bitwise_count(maps[a[i : i + 4096]] & maps[b[i : i + 4096]]).sum(axis=1, dtype=np.int64) for i in range(0, len(a), 4096)] or [np.zeros(0, np.int64)])
            ok = self.possible(shared, (lo[a], lo[b]), (hi[a], hi[b]), (slack[a], slack[b]))
            a, b = a[ok], b[ok]
            if depth:
                below = len(self.levels[depth - 1][1])
                a, b = (np.concatenate(x) for x in zip(*((2 * a + s, 2 * b + t) for s in (0, 1) for t in (0, 1)), strict=True))
                ok = (a <= b) & (a < below) & (b < below)
                a, b = a[ok], b[ok]
        held, size = [], 0
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            x, y = slice(i * LEAF, (i + 1) * LEAF), slice(j * LEAF, (j + 1) * LEAF)
            shared = np.bitwise_count(self.maps[x][:, None] & self.maps[y][None]).sum(axis=2, dtype=np.int64)
            n, m = self.n[x][:, None], self.n[y][None]
            ok = self.possible(shared, (n, m), (n, m), (self.slack[x][:, None], self.slack[y][None]))
            if i == j:
                ok &= np.tri(*ok.shape, k=-1, dtype=bool).T
            p, q = np.nonzero(ok)
            held.append((p + i * LEAF, q + j * LEAF, shared[p, q]))
            size += len(p)
            if size > STEP:
                yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                held, size = [], 0
        if size:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def similar(maps: list[bytes], n: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, score) of members of one group that may be similar, about STEP pairs at once. Bitmaps of one
    width meet in one tree; those of neighbouring widths too, the wider ones folded."""
    wide = np.array([len(x) for x in maps])
    for w in np.unique(wide):
        for other in (w, w // 2):
            at = np.flatnonzero((wide == w) | (wide == other))
            if other != w and not (wide == other).any() or len(at) < 2:
                continue
            at = at[np.lexsort((n[at], first[at], np.floor(np.log2(n[at]) * 4)))]
            rows = []
            for k in at:
                x = np.frombuffer(maps[k], np.uint64)
                rows.append(x if wide[k] == other else x[: len(x) // 2] | x[len(x) // 2 :])
            for i, j, shared in Tree(np.stack(rows), n[at]).pairs():
                i, j = at[i], at[j]
                if other != w:
                    cross = wide[i] != wide[j]
                    i, j, shared = i[cross], j[cross], shared[cross]
                yield i, j, shared / (n[i] + n[j] - np.minimum(shared, np.minimum(n[i], n[j])))


def partners(i: np.ndarray, j: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
    """Of the pairs those among the best `most` of either member."""
    who, other, pair = np.concatenate([i, j]), np.concatenate([j, i]), np.tile(np.arange(len(i)), 2)
    order = np.lexsort((other, -score[pair], who))
    who, pair = who[order], pair[order]
    begin = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]])) if len(who) else np.zeros(0, np.int64)
    rank = np.arange(len(who)) - np.repeat(begin, np.diff(np.append(begin, len(who))))
    keep = np.zeros(len(i), dtype=bool)
    keep[pair[rank < most]] = True
    return keep


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Runs of rows that are equal in the first two columns (sorted)."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = (keys[0, a], keys[1, a])
            if held and key != last:
                yield held
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield held


def _candidates(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray | None]] = []
        size = 0
        for group in _groups(batches):
            own = pa.Table.from_batches(group)
            c, n, top, comp, first = (own.column(x).to_numpy() for x in ("c", "n", "top", "comp", "first"))
            i = j = np.zeros(0, np.int64)
            score, left = np.zeros(0), np.zeros(len(c), bool)
            for p, q, value in similar(own.column("map").to_pylist(), n, first):
                apart = (comp[p] != comp[q]) & (n[p] <= top[q]) & (n[q] <= top[p])
                i, j, score = np.concatenate([i, p[apart]]), np.concatenate([j, q[apart]]), np.concatenate([score, value[apart]])
                keep = partners(comp[i], comp[j], score, most)
                left[i[~keep]] = left[j[~keep]] = True
                i, j, score = i[keep], j[keep], score[keep]
            if left.any():
                out.append((c[left], c[left], np.full(int(left.sum()), group[0].column(0)[0].as_py())))
            out.append((np.minimum(c[i], c[j]), np.maximum(c[i], c[j]), None))
            size += len(i) + int(left.sum())
            if size > 100_000:
                yield _pairs(out)
                out, size = [], 0
        yield _pairs(out)

    return run


def _pairs(out: list[tuple[np.ndarray, np.ndarray, np.ndarray | None]]) -> pa.RecordBatch:
    """Rows of pairs (token null), then of members of pairs left out (a and b the member, token the group's)."""
    empty = [np.zeros(0, np.int64)]
    a, b = (np.concatenate(empty + [x[k] for x in out if x[2] is None]) for k in (0, 1))
    pair = np.unique(np.stack([a, b]), axis=1)
    member, token = (np.concatenate(empty + [x[k] for x in out if x[2] is not None]) for k in (0, 2))
    columns = [pa.concat_arrays([pa.array(x), pa.array(member)]) for x in pair]
    return pa.RecordBatch.from_arrays([*columns, pa.concat_arrays([pa.nulls(pair.shape[1], pa.int64()), pa.array(token)])], names=["a", "b", "token"])


def forest(tokens: np.ndarray, bounds: np.ndarray, comp: np.ndarray) -> list[tuple[int, int]]:
    """Links (i, j) that join all members that are linked, apart from those that comp joins already.

    tokens: the members' whole sets end to end. Pairs that the tree leaves are compared exactly, a member
    against all others of different components at once.
    """
    n = np.diff(bounds)
    _, ids = np.unique(tokens, return_inverse=True)
    at, label, found = np.zeros(int(ids.max(initial=-1)) + 1, bool), comp.copy(), []
    first = np.minimum.reduceat(tokens, bounds[:-1]).view(np.int64)
    for i, j, _ in similar([bitmap(tokens[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], n, first):
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        heads = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]])) if len(i) else []
        for a, b in zip(heads, [*heads[1:], len(i)], strict=True):
            own, others = i[a], j[a:b]
            others = others[label[others] != label[own]]
            if not len(others):
                continue
            at[ids[bounds[own] : bounds[own + 1]]] = True
            ends = np.cumsum(n[others])
            places = np.arange(ends[-1]) + np.repeat(bounds[others] - ends + n[others], n[others])
            both = np.add.reduceat(at[ids[places]].astype(np.int64), ends - n[others])
            at[ids[bounds[own] : bounds[own + 1]]] = False
            for other in others[10 * both >= TENTHS * (n[own] + n[others] - both)].tolist():
                if label[other] != label[own]:
                    found.append((int(own), other))
                    label[label == label[other]] = label[own]
    return found


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for group in _groups(batches):
        own = pa.Table.from_batches(group)
        c, comp = (own.column(x).to_numpy() for x in ("c", "comp"))
        sets = own.column("s").combine_chunks()
        bounds = sets.offsets.to_numpy().astype(np.int64)
        tokens = sets.values.to_numpy().view(np.uint64)[bounds[0] : bounds[-1]]
        links = np.array(forest(tokens, bounds - bounds[0], comp), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(c[links[:, 0]]), pa.array(c[links[:, 1]])], names=["a", "b"])


# ---------------------------------------------------------------- the join


def near_duplicates(spark: SparkSession, df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id (smallest key reachable by links, its own included), class_id (of
    equal sets; null for an empty set): one row for each row of df.

    Null or empty texts and texts without words have an empty set, link with nothing and are their own
    component. Rows with equal keys are separate documents. Null keys count as larger than any: a
    component of null keys only has a null id.
    """
    kind = df.schema[key].dataType.simpleString()
    own = df.select(F.col(key).alias("k"), F.col(text).alias("text"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of documents (c, n), and of frequent tokens (k null, n: occurrences, c: token, mark)."""
        held: list[np.ndarray] = []

        def frequent() -> tuple[np.ndarray, np.ndarray]:
            t, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
            held.clear()
            return t[n >= OFTEN].view(np.int64), n[n >= OFTEN]

        def batch(ids: pa.Array, c: list | np.ndarray, n: list | np.ndarray, mark: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([ids, pa.array(c, pa.int64()), pa.array(n, pa.int64()), pa.array([mark] * len(ids), pa.bool_())], names=["k", "c", "n", "token"])

        kind_ = None
        for rows, data, bounds in chunks(batches, "text"):
            kind_ = rows.column(0).type
            c, n = [], []
            for tokens in token_sets(data, bounds):
                c.append(fingerprint(tokens) if len(tokens) else None)
                n.append(len(tokens))
                held.append(tokens)
            yield batch(rows.column(0), c, n, False)
            if sum(map(len, held)) > TOKEN_BUFFER:
                t, k = frequent()
                yield batch(pa.nulls(len(t), kind_), t, k, True)
        if held:
            t, k = frequent()
            yield batch(pa.nulls(len(t), kind_), t, k, True)

    seen = stash(spark, mapped(own, describe, f"k {kind}, c bigint, n bigint, token boolean"))
    docs = seen.where("not token").select("k", "c", "n")
    often = seen.where("token").groupBy("c").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "c").limit(FREQUENT).collect()
    listed = np.array([r.c for r in often][::-1], np.int64).view(np.uint64)  # rarest first
    order = np.argsort(listed)
    sent = spark.sparkContext.broadcast((listed[order], order))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens_of, rank_of = sent.value
        known: set[int] = set()
        for _, data, bounds in chunks(batches, "text"):
            cs, ns, firsts, maps = [], [], [], []
            for tokens in token_sets(data, bounds):
                c = fingerprint(tokens) if len(tokens) else None
                if c is None or c in known:
                    continue
                if len(known) > KNOWN:
                    known.clear()
                known.add(c)
                if len(tokens_of):
                    at = np.minimum(np.searchsorted(tokens_of, tokens), len(tokens_of) - 1)
                    hit = tokens_of[at] == tokens
                    rare, late = tokens[~hit], tokens[hit][np.argsort(rank_of[at[hit]])]
                    ordered = np.concatenate([rare, late])
                else:
                    ordered = tokens
                cs.append(c)
                ns.append(len(tokens))
                firsts.append(ordered[: prefix_length(len(tokens))])
                maps.append(bitmap(tokens))
            sizes = np.concatenate([[0], np.cumsum([len(x) for x in firsts])]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cs, pa.int64()), pa.array(ns, pa.int64()), lists(signed(np.concatenate([np.zeros(0, np.uint64), *firsts])), sizes), pa.array(maps, pa.binary())], names=["c", "n", "tokens", "map"])

    with scratch(spark) as keep:
        feats = stash(spark, mapped(own, features, "c bigint, n bigint, tokens array<bigint>, map binary").dropDuplicates(["c"]))
        comps = keep(_components(spark, own, docs, feats))
    classes = docs.where("c is not null").groupBy("c").agg(F.min("k").alias("low"))
    if comps is not None:
        classes = classes.join(comps, "c", "left").select("c", "low", F.coalesce("comp", "c").alias("comp"))
    else:
        classes = classes.withColumn("comp", F.col("c"))
    lowest = classes.groupBy("comp").agg(F.min("low").alias("component"))
    named = classes.join(lowest, "comp").select("c", "component")
    return docs.join(named, "c", "left").select(F.col("k").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("c").isNull(), F.col("k")).otherwise(F.col("component")).alias("component_id"), F.col("c").alias("class_id"))


def _components(spark: SparkSession, own: DataFrame, docs: DataFrame, feats: DataFrame) -> DataFrame | None:
    """(c, comp) of linked classes, by the three rounds; None if there is no link."""
    rows = feats.select("c", F.col("n").cast("int").alias("n"), "tokens")
    comps = checked = None
    for k, most in enumerate(PARTNERS):
        grouped = _mixed(rows, comps, FIRST_TOKENS if k == 0 else None).join(feats.select("c", F.element_at("tokens", 1).alias("first"), "map"), "c")
        dealt = grouped.select("token", "part", "c", "n", "top", "comp", "first", "map").repartition("token", "part").sortWithinPartitions("token", "part")
        found = stash(spark, mapped(dealt, _candidates(most), "a bigint, b bigint, token bigint"))
        pairs = found.where("token is null").select("a", "b").distinct()
        pairs = stash(spark, pairs if checked is None else pairs.join(checked, ["a", "b"], "left_anti"))
        checked = pairs
        comps = merged(spark, comps, _verified(spark, own, docs, pairs))
    left = stash(spark, _clusters(spark, found.where("token is not null").select("token", F.col("a").alias("c")).distinct(), rows, comps))
    if not left.isEmpty():
        sets = _sets(spark, own, docs, left.select("c").distinct())
        dealt = left.join(sets, "c").select("cluster", "part", "c", "comp", "s").repartition("cluster", "part").sortWithinPartitions("cluster", "part")
        comps = merged(spark, comps, stash(spark, mapped(dealt, _exact, "a bigint, b bigint").distinct()))
    return comps


def _mixed(rows: DataFrame, comps: DataFrame | None, most: int | None) -> DataFrame:
    """(token, part, c, n, top, comp) of groups that hold two components: members that another one's size
    and place allow, the group cut into blocks, each pair of which is a part.

    rows: (c, n, tokens); most: tokens taken.
    """
    # joined before tokens are listed; null stands for a class that is its own component
    at = rows.withColumn("comp", F.lit(None).cast("bigint")) if comps is None else rows.join(comps, "c", "left")
    tokens = at.select("c", "n", F.nullif(F.col("comp"), F.col("c")).alias("moved"), F.posexplode(F.slice("tokens", 1, most) if most else F.col("tokens")).alias("pos", "token"))
    top = F.floor(((10 + TENTHS) * (F.col("n") - F.col("pos")) - TENTHS * F.col("n")) / TENTHS).cast("int")
    tokens = tokens.select("token", "c", "n", top.alias("top"), F.coalesce("moved", "c").alias("comp")).repartition("token")
    by = Window.partitionBy("token").orderBy("n")
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    over = tokens.select(
        "*", F.min("comp").over(whole).alias("lo"), F.max("comp").over(whole).alias("hi"), F.count("*").over(whole).alias("size"), F.min("n").over(whole).alias("least"),
        F.max("top").over(by.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.lead("n").over(by).alias("next"), F.lead("top").over(by).alias("next_top"),
    )
    mixed = over.where("lo < hi and (least <= top and before >= n or next <= top and (size > 2 or next_top >= n))")
    return _blocks(mixed.withColumn("m", F.ceil(F.col("size") / BLOCK).cast("int"))).select("token", "part", "c", "n", "top", "comp")


def _blocks(df: DataFrame) -> DataFrame:
    """df (c, m: blocks of the group, ...) with a column part for each pair of blocks."""
    cut = df.withColumn("x", F.pmod(F.xxhash64("c"), F.col("m")).cast("int")).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    return cut.withColumn("part", (F.least("x", "y") * F.col("m") + F.greatest("x", "y")).cast("bigint"))


def _clusters(spark: SparkSession, members: DataFrame, rows: DataFrame, comps: DataFrame | None) -> DataFrame:
    """(cluster, part, c, comp): clusters of members (token, c) by the tokens that hold two components, cut into blocks."""

    def placed(df: DataFrame) -> DataFrame:
        return df.withColumn("comp", F.col("c")) if comps is None else df.join(comps, "c", "left").withColumn("comp", F.coalesce("comp", "c"))

    members = placed(members)
    tokens = members.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("c").alias("least")).where("lo < hi")
    # each hangs on the token's least member
    stars = stash(spark, members.join(tokens, "token").select(F.col("c").alias("a"), F.col("least").alias("b")).distinct())
    if stars.isEmpty():
        return spark.createDataFrame([], "cluster bigint, part bigint, c bigint, comp bigint")
    own = placed(components(spark, stars).select(F.col("node").alias("c"), F.col("component").alias("cluster"))).join(rows.select("c", "n"), "c")
    sizes = own.groupBy("cluster").agg(F.ceil(F.greatest(F.count("*") / CLUSTER_BLOCK, F.sum("n") / BLOCK_TOKENS)).cast("int").alias("m"))
    return _blocks(own.join(sizes, "cluster")).select("cluster", "part", "c", "comp")


def _sets(spark: SparkSession, own: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(c, s): the whole sets of classes (c), each from one document that has it."""
    wanted = stash(spark, classes.join(docs, "c").groupBy("c").agg(F.min("k").alias("w")).select("w").distinct())
    if wanted.count() <= BROADCAST:
        wanted = F.broadcast(wanted)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, bounds in chunks(batches, "text"):
            own = [x for x in token_sets(data, bounds) if len(x)]
            sizes = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([fingerprint(x) for x in own], pa.int64()), lists(signed(np.concatenate([np.zeros(0, np.uint64), *own])), sizes)], names=["c", "s"])

    # one document of each class; keys that aren't unique give more
    few = own.join(wanted, F.col("k").eqNullSafe(F.col("w")), "left_semi")
    return stash(spark, mapped(few, sets, "c bigint, s array<bigint>").dropDuplicates(["c"]))


def _verified(spark: SparkSession, own: DataFrame, docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those pairs (a, b) whose whole sets are similar enough."""
    found = _sets(spark, own, docs, pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct())
    both = pairs.join(found.select(F.col("c").alias("a"), F.col("s").alias("s")), "a").join(found.select(F.col("c").alias("b"), F.col("s").alias("t")), "b")
    counted = both.select("a", "b", F.size(F.array_intersect("s", "t")).alias("i"), F.size("s").alias("n"), F.size("t").alias("m"))
    return stash(spark, counted.where(f"10 * i >= {TENTHS} * (n + m - i)").select("a", "b"))
