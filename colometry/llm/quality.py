"""Quality rules by weak supervision: rules vote good or bad or abstain, expectation-maximisation
estimates how often each rule votes bad on good documents and on each kind of junk, and the posterior
probability of a good document decides. DataFrame functions only.

Rules depend on each other: a text of symbols has few words with letters, one that repeats itself has few
different words, and kinds of junk exclude each other. So bad documents are not one latent class but a mixture of kinds,
one for each rule at first; within a kind rules are independent. All rates are estimated from the votes alone. A kind is
believed if at least two rules fire on it far more often than on good documents; a rule that nothing
corroborates is taken to misfire, and its vote alone rejects nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stash

#: name: (bad when, good when) on the features of `measure`; neither: the rule abstains. Fixed rules, at most 3**len vote patterns.
RULES: dict[str, tuple[str, str]] = {
    "length": ("n_words < 10", "n_words >= 30"),
    "symbols": ("10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    "letters": ("10 * n_wordless > n_words", "50 * n_wordless <= n_words"),
    "capitals": ("2 * n_upper > word_chars", "7 * n_upper <= word_chars"),
    "exclaims": ("4 * n_exclaims > n_words", "20 * n_exclaims <= n_words"),
    "repeats": ("100 * n_repeat_words > 20 * n_words", "100 * n_repeat_words <= 10 * n_words"),
    "variety": ("n_words >= 20 and 100 * n_distinct < 25 * n_words", "100 * n_distinct >= 30 * n_words"),
    "word_size": ("word_chars < 2 * n_words or word_chars > 20 * n_words", "word_chars >= 3 * n_words and word_chars <= 12 * n_words"),
    "lines": ("n_dup_lines >= 3 and 100 * n_dup_lines > 30 * n_lines", "100 * n_dup_lines <= 10 * n_lines"),
    "ends": ("n_words >= 20 and (100 * n_ends < n_words or 3 * n_ends > n_words)", "40 * n_ends >= n_words and 5 * n_ends <= n_words"),
}
KEEP_AT = 0.5
#: A rule fires on a kind if it votes bad there at least this often, and so many times as often as on good documents; so many rules make a kind believed.
FIRES, LIFT, CORROBORATED = 0.2, 5, 2

_SPACE = r"[\x20\x09-\x0D]"


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text", row: Sequence[str] = ()) -> DataFrame:
    """key and the counts that the rules use, all long; a null text has no word and no line. row: columns that come along, in a struct _row.

    n_repeat_words: words covered by windows of 5 words that occur twice or more in the text. Windows
    are 64-bit hashes; a text whose windows all differ needs no more, else they are sorted with their
    places, so the cost is n log n in the text's length.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    along = ["_row"] if row else []
    base = docs.select(F.col(key), t.alias("t"), *[F.struct(*row).alias(x) for x in along]).select(
        key,
        *along,
        F.expr(r"filter(split(t, '[\\x20\\x09-\\x0D]+'), x -> x <> '')").alias("w"),
        (F.length("t") - F.regexp_count("t", F.lit(_SPACE))).cast("bigint").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        F.regexp_count("t", F.lit(r"\p{Lu}")).cast("bigint").alias("n_upper"),
        F.regexp_count("t", F.lit("!")).cast("bigint").alias("n_exclaims"),
        F.regexp_count("t", F.lit(r"[.!?。？！]")).cast("bigint").alias("n_ends"),
        F.regexp_count("t", F.lit(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D\p{L}]++(?![^\x20\x09-\x0D])")).cast("bigint").alias("n_wordless"),
        F.expr(r"filter(split(t, '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')").alias("ls"),
    )
    hashed = base.select("*", F.expr("transform(w, x -> xxhash64(x))").alias("h")).drop("w")
    windows = hashed.select("*", F.expr("if(size(h) < 5, array(), slice(transform(h, (x, i) -> xxhash64(x, get(h, i + 1), get(h, i + 2), get(h, i + 3), get(h, i + 4))), 1, size(h) - 4))").alias("g"))
    # windows in order with their places, only where some window recurs
    placed = windows.select("*", F.expr("if(size(array_distinct(g)) = size(g), null, array_sort(transform(g, (x, i) -> struct(x, i))))").alias("s"))
    places = placed.select("*", F.expr("array_sort(transform(filter(transform(s, (e, j) -> struct(e.i as i, j > 0 and get(s, j - 1).x = e.x or j + 1 < size(s) and get(s, j + 1).x = e.x as twice)), e -> e.twice), e -> e.i))").alias("p"))
    covered = "aggregate(p, struct(0 as n, 0 as upto), (a, i) -> struct(a.n + i + 5 - greatest(i, a.upto) as n, i + 5 as upto), a -> a.n)"
    return places.select(
        key,
        *along,
        F.expr("cast(size(h) as bigint)").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.expr("cast(size(ls) - size(array_distinct(ls)) as bigint)").alias("n_dup_lines"),
        F.expr(f"cast(coalesce({covered}, 0) as bigint)").alias("n_repeat_words"),
        "n_upper",
        "n_exclaims",
        "n_ends",
        "n_wordless",
        F.expr("cast(size(array_distinct(h)) as bigint)").alias("n_distinct"),
        F.expr("cast(size(ls) as bigint)").alias("n_lines"),
    )


def vote(name: str) -> Column:
    """1 good, 0 bad, -1 abstains."""
    bad, good = RULES[name]
    return F.expr(f"case when {bad} then 0 when {good} then 1 else -1 end")


def estimate(votes: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shares of the classes, chances of a bad vote (class x rule, abstentions aside), and which classes are
    believed to be junk. Class 0 are the good documents, the others kinds of junk.

    votes: the vote patterns (patterns x rules), at most 3**len(RULES) whatever the corpus; counts: their
    numbers of documents. Half a vote in favour of either side keeps chances off 0 and 1. A kind to which no
    document belongs in the end (less than half of one) is not believed either.
    """
    bad, good = (votes == 0).astype(float), (votes == 1).astype(float)
    rules = votes.shape[1]
    share = np.array([0.8] + [0.2 / rules] * rules)
    chance = np.vstack([np.full(rules, 0.02), np.where(np.eye(rules, dtype=bool), 0.9, 0.1)])
    for _ in range(rounds):
        p = posterior(bad, good, share, chance) * counts[:, None]
        size = p.sum(axis=0)
        share = (size + 1) / (size.sum() + len(size))
        chance = (p.T @ bad + 0.5) / (p.T @ (bad + good) + 1)
    fires = (chance >= FIRES) & (chance >= LIFT * chance[0])
    junk = (fires.sum(axis=1) >= CORROBORATED) & (size >= 0.5)
    junk[0] = False
    return share, chance, junk


def posterior(bad: np.ndarray, good: np.ndarray, share: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """Patterns x classes."""
    odds = np.log(share) + bad @ np.log(chance.T) + good @ np.log1p(-chance.T)
    odds = np.exp(odds - odds.max(axis=1, keepdims=True))
    return odds / odds.sum(axis=1, keepdims=True)


def goodness(names: list[str], share: np.ndarray, chance: np.ndarray, junk: np.ndarray) -> Column:
    """The posterior probability of no junk, from columns v_<rule>: a row of logarithms for each class, of which the votes pick theirs."""
    table = F.array(*[F.array(*[F.lit(float(x)) for x in (np.log(s), *(y for c in row for y in (0.0, np.log(c), np.log1p(-c))))]) for s, row in zip(share, chance, strict=True)])
    picked = F.array(*[F.col(f"v_{k}") + (3 * i + 2) for i, k in enumerate(names)])
    good = F.array(*[F.lit(float(not z)) for z in junk])
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x)
    logs = F.transform(table, lambda row: F.aggregate(picked, F.get(row, F.lit(0)), lambda acc, i: acc + F.get(row, i)))

    def share_of_good(own: Column) -> Column:
        weights = F.transform(own, lambda x: F.exp(x - F.array_max(own)))
        return total(F.zip_with(weights, good, lambda w, g: w * g)) / total(weights)

    return F.get(F.transform(F.array(logs), share_of_good), F.lit(0))


def judge(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", row: Sequence[str] = ()) -> DataFrame:
    """key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, quality, kept; with row also _row, a struct of these columns of docs.

    quality is the posterior probability of a good document; base_failed overrules it. An empty table
    gives no rows. A null text has no words, so it fails the base. Repeated rows count, and are judged, each; extra
    columns don't matter, whatever their names.
    """
    measured = stash(spark, measure(docs, key, text, row))
    names = list(RULES)
    votes = measured.select("*", *[vote(k).alias(f"v_{k}") for k in names])
    seen = votes.groupBy(*[f"v_{k}" for k in names]).agg(F.count("*").alias("n")).collect()  # bounded by 3**len(RULES)
    share, chance, junk = estimate(np.array([[r[f"v_{k}"] for k in names] for r in seen], int).reshape(-1, len(names)), np.array([r.n for r in seen], float))
    failed = F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")
    judged = votes.select(key, *(["_row"] if row else []), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), goodness(names, share, chance, junk).alias("quality"))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= KEEP_AT))
