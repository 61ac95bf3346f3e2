"""Pairing pieces of a source with pieces of its target: arrays within a row, then one Generate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.brackets import protect, unprotect

PA_COLUMNS = ("sentence_no", "src", "tgt", "similarity", "split_method", "align_method")


def length_similarity(a: Column, b: Column) -> Column:
    """0 if a side is blank, else half plus half the ratio of lengths."""
    return F.when(T.is_blank(a) | T.is_blank(b), 0.0).otherwise(0.5 + 0.5 * F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b)))


def null_as_text(df: DataFrame, src: str, tgt: str) -> DataFrame:
    """An empty cell as the text 'nan', for those who need it so."""
    return df.withColumns({c: F.coalesce(c, F.lit("nan")) for c in (src, tgt)})


def align_paragraphs(df: DataFrame, keys: list[str], src: str = "src", tgt: str = "tgt") -> DataFrame:
    """Sentences of the target with equally dealt tokens of the source. Rows with a blank or null side go."""
    own = df.where(T.both_sides(F.col(src), F.col(tgt))).select(*keys, T.sentences(F.col(tgt)).alias("_tgt"), T.source_tokens(F.col(src)).alias("_tok"))
    pairs = own.select(*keys, F.posexplode(F.arrays_zip(T.deal(F.col("_tok"), F.size("_tgt")).alias("src"), F.col("_tgt").alias("tgt"))).alias("_i", "_p"))
    return pairs.select(*keys, (F.col("_i") + 1).alias("sentence_no"), "_p.src", "_p.tgt", F.lit(1.0).alias("similarity"), F.lit("punctuation").alias("split_method"), F.lit("sequential").alias("align_method"))


def _safe_pairs(df: DataFrame, keys: list[str], src: str, tgt: str) -> DataFrame:
    own = df.where(T.both_sides(F.col(src), F.col(tgt))).select(*keys, T.safe_sentences(F.col(tgt)).alias("_tgt"), T.source_tokens(F.col(src)).alias("_tok"))
    pairs = own.select(*keys, F.posexplode(F.arrays_zip(T.deal(F.col("_tok"), F.size("_tgt")).alias("src"), F.col("_tgt").alias("tgt"))).alias("_i", "_p"))
    return pairs.select(*keys, (F.col("_i") + 1).alias("sentence_no"), "_p.src", "_p.tgt").withColumn("_sim", length_similarity(F.col("src"), F.col("tgt")))


def align_tokenized(df: DataFrame, keys: list[str], src: str = "src", tgt: str = "tgt", fusion: bool = False) -> DataFrame:
    """Target-led alignment with similarity by length; with fusion only the labels differ."""
    split, how = ("spacy_tokenizer_fusion", "spacy_tokenizer_based_split") if fusion else ("vice_versa_tokenized", "tgt_based_src_split")
    return _safe_pairs(df, keys, src, tgt).select(*keys, "sentence_no", "src", "tgt", F.col("_sim").alias("similarity"), F.lit(split).alias("split_method"), F.lit(how).alias("align_method"))


def align_hybrid(df: DataFrame, keys: list[str], src: str = "src", tgt: str = "tgt", quality_threshold: float = 0.8, fusion: bool = False) -> DataFrame:
    """Weighted similarity of the strategies (which share their pieces) where it meets the threshold."""
    s = F.col("_sim")
    w = 1.0 * 0.2 + 1.0 * 0.3 + s * 0.2 + s * 0.3 if fusion else F.lit(1.0 * 0.3 + 1.0 * 0.4) + s * 0.3
    good = w >= quality_threshold
    names = ("seq+sem+tok+spacy_tok", "spacy_tokenizer_fusion", "hybrid_with_spacy_tokenizer", "spacy_tokenizer_fusion_only") if fusion else ("seq+sem+tok", "vice_versa_tokenized", "hybrid_with_tokenizer", "tokenizer_vice_versa_only")
    return _safe_pairs(df, keys, src, tgt).select(
        *keys, "sentence_no", "src", "tgt", F.when(good, w).otherwise(s).alias("similarity"), F.when(good, names[0]).otherwise(names[1]).alias("split_method"), F.when(good, names[2]).otherwise(names[3]).alias("align_method")
    )


# ---------------------------------------------------------------- phrases


def even_words(c: Column, n: Column) -> Column:
    """Words dealt into n units, joined by blanks; as many or fewer words: one each, padded."""
    return F.when(n <= 0, F.array(F.array_join(T.split_ws(c), " "))).otherwise(T.deal(T.split_ws(c), n, " "))


def pad(units: Column, n: Column) -> Column:
    return T.let(units, lambda u: F.when(F.size(u) < n, F.concat(u, F.array_repeat(F.lit(""), n - F.size(u)))).otherwise(u))


def adjust(units: Column, n: Column) -> Column:
    """Exactly n units: padded, or the surplus joined into the last; n < 1 joins all."""

    def fit(u: Column) -> Column:
        surplus = F.concat(F.slice(u, 1, n - 1), F.array(F.array_join(F.slice(u, n, F.size(u)), " ")))
        return F.when(n <= 0, F.array(F.array_join(u, " "))).when(F.size(u) <= n, pad(u, n)).otherwise(surplus)

    return T.let(units, fit)


def uniform_boundaries(total: Column, need: Column) -> Column:
    """Places chosen when all scores tie: from the right end leftwards, spaced by total div (need + 2)."""
    step = F.greatest(F.lit(1), F.floor(total / (need + 2)).cast("int"))
    return F.when(need > 0, F.reverse(F.transform(F.sequence(F.lit(0), need - 1), lambda k: total - 1 - k * step))).otherwise(F.array().cast("array<int>"))


def cut(words: Column, boundaries: Column) -> Column:
    """Words joined by blanks between boundaries (sorted word numbers)."""

    def pieces(x: Column) -> Column:
        starts, ends = F.concat(F.array(F.lit(0)), x["b"]), F.concat(x["b"], F.array(F.size(x["w"])))
        return F.zip_with(starts, ends, lambda a, b: F.array_join(F.slice(x["w"], a + 1, b - a), " "))

    return T.let(F.struct(words.alias("w"), boundaries.cast("array<int>").alias("b")), pieces)


def colon_units(c: Column, n: Column) -> Column:
    """Null unless exactly one full-width colon with text at a side: what is left of it, with it, is unit 1."""

    def split(parts: Column) -> Column:
        left, right = T.strip(F.get(parts, F.lit(0))), T.strip(F.get(parts, F.lit(1)))
        rest = T.let(T.split_ws(right), lambda w: F.when(n == 2, F.array(right)).when(F.size(w) <= n - 1, pad(w, n - 1)).otherwise(T.deal(w, n - 1, " ")))
        return F.when((n >= 2) & (F.size(parts) == 2) & ((left != "") | (right != "")), F.concat(F.array(F.concat(left, F.lit("："))), rest))

    return T.let(F.split(c, "：", -1), split)


def target_units(c: Column, n: Column, boundaries: Column | None = None) -> Column:
    """n units of a target for n source units. boundaries: by scores; without, those of equal scores."""

    def by_meaning(words: Column) -> Column:
        total = F.size(words)
        scored = boundaries if boundaries is not None else uniform_boundaries(total, n - 1)
        return F.when(total <= n, pad(words, n)).otherwise(adjust(cut(words, scored), n))

    meaning = T.let(T.split_ws(c), by_meaning)
    return F.when(T.is_blank(c), F.array().cast("array<string>")).otherwise(F.coalesce(colon_units(c, n), F.when(n == 1, F.array(c)).otherwise(meaning)))


#: Scores of the places between words, from (source units, target words); tags of words.
Scorer = Callable[[Column, Column], Column]
Tagger = Callable[[Column], Column]


def analysis(units: Column, words: Column, semantic: Scorer | None = None, pos: Tagger | None = None, segmenter: Tagger | None = None) -> Column:
    """Struct of the scores of each place between words by meaning, grammar and a segmenter, and combined.

    Without a scorer each place has 0.5, 0.3 or 0.4. pos: the words' tags; segmenter: the words' number of
    segments.
    """
    last = F.greatest(F.size(words) - 1, F.lit(0))
    flat = lambda x: F.array_repeat(F.lit(x), last.cast("int"))
    s = semantic(units, words) if semantic else flat(0.5)
    g = let_grammar(pos(words)) if pos else flat(0.3)
    j = segmenter_scores(segmenter(words), F.size(words)) if segmenter else flat(0.4)
    return T.let(F.struct(s.alias("semantic"), g.alias("grammar"), j.alias("segmenter")), lambda x: F.struct(x["semantic"].alias("semantic"), x["grammar"].alias("grammar"), x["segmenter"].alias("segmenter"), combined_scores(x["semantic"], x["grammar"], x["segmenter"]).alias("combined")))


def let_grammar(tags: Column) -> Column:
    """Boundary strengths between neighbouring tags; 0.3 where a tag is null."""

    def pairs(t: Column) -> Column:
        return F.zip_with(F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))), F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))), lambda a, b: F.when(a.isNull() | b.isNull(), 0.3).otherwise(grammar_strength(a, b)).cast("double"))

    return T.let(tags, pairs)


def phrase_units(df: DataFrame, keys: list[str], src: str = "src", tgt: str = "tgt", protect_brackets: bool = True, semantic: Scorer | None = None, pos: Tagger | None = None, segmenter: Tagger | None = None) -> DataFrame:
    """keys, src, tgt, src_units, tgt_units: arrays of equal length, padded. Rows with a blank or null side go.

    With any scorer the target's words are cut at the places of the best combined scores, else at those of
    equal ones.
    """
    hide, show = (protect, unprotect) if protect_brackets else (lambda c: c, lambda c: c)
    own = df.where(T.both_sides(F.col(src), F.col(tgt))).select(*keys, F.col(src).alias("src"), F.col(tgt).alias("tgt"), hide(F.col(src)).alias("_s"), hide(F.col(tgt)).alias("_t"))
    split = own.select(*keys, "src", "tgt", T.split_ws(F.col("_s")).alias("_su"), "_t", T.split_ws(F.col("_t")).alias("_w"))
    chosen = None
    if semantic or pos or segmenter:
        shown = F.transform("_su", show), F.transform("_w", show)
        split = split.withColumn("_b", analysis(*shown, semantic, pos, segmenter)["combined"]).withColumn("_b", chosen_boundaries(F.col("_b"), F.size("_su") - 1, F.size("_w")))
        chosen = F.col("_b")
    both = split.select(*keys, "src", "tgt", "_su", target_units(F.col("_t"), F.size("_su"), chosen).alias("_tu"))
    most = F.greatest(F.size("_su"), F.size("_tu"))
    return both.select(*keys, "src", "tgt", F.transform(pad(F.col("_su"), most), show).alias("src_units"), F.transform(pad(F.col("_tu"), most), show).alias("tgt_units"))


def align_phrases(df: DataFrame, keys: list[str], src: str = "src", tgt: str = "tgt", protect_brackets: bool = True, semantic: Scorer | None = None, pos: Tagger | None = None, segmenter: Tagger | None = None) -> DataFrame:
    """One row for each source unit with its target unit; phrase_id counts from 1 and skips empty pairs."""
    return phrase_rows(phrase_units(df, keys, src, tgt, protect_brackets, semantic, pos, segmenter), keys)


def phrase_rows(units: DataFrame, keys: list[str]) -> DataFrame:
    rows = units.select(*keys, F.posexplode(F.arrays_zip("src_units", "tgt_units")).alias("_i", "_p"))
    out = rows.select(*keys, (F.col("_i") + 1).alias("phrase_id"), F.col("_p.src_units").alias("src"), F.col("_p.tgt_units").alias("tgt"))
    return out.where(~(T.is_blank(F.col("src")) & T.is_blank(F.col("tgt"))))


def units_by_meaning(tgt: Column, n: Column) -> Column:
    return target_units(tgt, n)


def units_by_source(src: Column, tgt: Column) -> Column:
    """As many units as the source has; all of the target's words in one for a blank source."""
    return F.when(T.is_blank(src), F.array(F.array_join(T.split_ws(tgt), " "))).otherwise(target_units(tgt, F.size(T.split_ws(src))))


def units_by_semantics(src_units: Column, tgt: Column) -> Column:
    return units_by_source(F.array_join(src_units, " "), tgt)


def error_rows(df: DataFrame, key: str, src: str = "src", tgt: str = "tgt") -> DataFrame:
    """What stands for rows that could not be processed: error_id, the texts, and token counts."""
    s, t = F.coalesce(F.col(src), F.lit("")), F.coalesce(F.col(tgt), F.lit(""))
    return df.select(F.concat(F.col(key).cast("string"), F.lit("_error")).alias("error_id"), s.alias("src"), t.alias("tgt"), F.lit("error_fallback").alias("split_method"), F.lit(1.0).alias("similarity"), F.size(T.split_ws(s)).alias("src_tokens"), F.size(T.split_ws(t)).alias("tgt_tokens"))


def fallback_rows(df: DataFrame, keys: list[str], src: str = "src", tgt: str = "tgt") -> DataFrame:
    """Rows passed through, with token counts."""
    s, t = F.coalesce(F.col(src), F.lit("")), F.coalesce(F.col(tgt), F.lit(""))
    return df.select(*keys, s.alias("src"), t.alias("tgt"), F.lit("fallback_mode").alias("split_method"), F.lit(1.0).alias("similarity"), F.size(T.split_ws(s)).alias("src_tokens"), F.size(T.split_ws(t)).alias("tgt_tokens"))


#: Ranges that ordered rows are numbered in, RANGES of RANGES; and rows drawn, by hashes of their keys, to find where these begin.
RANGES, DRAWN = 16, 4096


def row_numbers(df: DataFrame, order: list[str] | None = None, name: str = "row_idx") -> DataFrame:
    """df with each row's number from 0, in the order given, else in that of the partitions read.

    Counts of ranges (partitions) are the offsets, so that no task holds all rows; one row for each range is
    broadcast. A row's range follows from its keys alone, so counts and rows can't disagree however either is
    partitioned: 256 ranges at most, their bounds from the DRAWN keys of the smallest hashes.
    """
    if order:
        return _numbers_by_range(df, order, name)
    part = df.withColumn("_pos", F.monotonically_increasing_id())
    part = part.withColumn("_part", F.shiftright("_pos", 33)).withColumn("_in", F.col("_pos").bitwiseAND((1 << 33) - 1))
    return part.join(F.broadcast(_before(part)), "_part").withColumn(name, F.col("_before") + F.col("_in")).drop("_pos", "_part", "_in", "_before")


def _before(part: DataFrame) -> DataFrame:
    """_part, _before: the rows of all earlier parts."""
    counts = part.groupBy("_part").agg(F.count("*").alias("_n"))
    return counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))


def _numbers_by_range(df: DataFrame, order: list[str], name: str) -> DataFrame:
    key = F.struct(*order)
    drawn = df.select(key.alias("_k"), F.xxhash64(*order).alias("_h")).orderBy("_h", "_k").limit(DRAWN)
    every = lambda n: F.filter("_all", lambda _, i: i % F.greatest(F.lit(1), F.ceil(F.size("_all") / n)) == 0)
    bounds = drawn.agg(F.array_sort(F.collect_list("_k")).alias("_all")).select(every(RANGES * RANGES).alias("_all")).select("_all", F.filter("_all", lambda _, i: i % RANGES == 0).alias("_first"))

    def place(k: Column) -> Column:
        """The bounds up to the key: those of whole blocks, then those within its block."""
        skipped = F.greatest(F.lit(0), F.size(F.filter("_first", lambda x: x <= k)) - 1) * RANGES
        return T.let(skipped, lambda n: n + F.size(F.filter(F.slice("_all", n + 1, RANGES), lambda x: x <= k)))

    part = df.crossJoin(F.broadcast(bounds)).withColumn("_part", T.let(key, place)).drop("_all", "_first")  # one row of 256 keys at most
    inner = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return part.withColumn("_in", inner).join(F.broadcast(_before(part)), "_part").withColumn(name, F.col("_before") + F.col("_in")).drop("_part", "_in", "_before")


def chunk_ids(df: DataFrame, order: list[str], size: int = 100) -> DataFrame:
    """Chunk number of each row by its place in the order."""
    return row_numbers(df, order, "_row").withColumn("chunk_id", F.floor(F.col("_row") / size).cast("bigint")).drop("_row")


# ---------------------------------------------------------------- scores


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return dot / (norm(a) * norm(b) + 1e-8)


def best_unit(word: Column, units: Column) -> Column:
    """(best_src_idx, similarity, all_similarities): the first of the most similar source units."""
    every = F.transform(units, lambda u: cosine(word, u))
    return F.struct((F.array_position(every, F.array_max(every)) - 1).cast("int").alias("best_src_idx"), F.array_max(every).alias("similarity"), every.alias("all_similarities"))


def semantic_scores(words: Column) -> Column:
    """words: array of (best_src_idx, similarity). Between words of different units the mean similarity
    within 0.1 and 0.9, else 0.1."""
    last = F.slice(words, 1, F.size(words) - 1)
    return F.zip_with(last, F.slice(words, 2, F.size(words) - 1), lambda a, b: F.when(a["best_src_idx"] != b["best_src_idx"], F.least(F.lit(0.9), F.greatest(F.lit(0.1), (a["similarity"] + b["similarity"]) / 2))).otherwise(0.1))


def grammar_strength(before: Column, after: Column) -> Column:
    """Boundary strength from the tags of two words' first morphemes."""
    noun, verb = (lambda c: c.startswith("N")), (lambda c: c.startswith("V"))
    mixed = (noun(before) & verb(after)) | (verb(before) & noun(after))
    return F.when(before.isin("EF", "EC"), 0.9).when(before.isin("JX", "JC"), 0.8).when(before != after, F.when(mixed, 0.6).otherwise(0.4)).otherwise(0.2)


def segmenter_scores(units: Column, words: Column) -> Column:
    """One constant for each boundary, from the ratio of a segmenter's units to words."""
    ratio = units / words
    value = F.when(ratio > 1.5, 0.6).when(ratio < 0.7, 0.2).otherwise(0.4)
    return F.when(words > 1, F.array_repeat(value, (words - 1).cast("int"))).otherwise(F.array().cast("array<double>"))


def combined_scores(semantic: Column, grammar: Column, segmenter: Column) -> Column:
    """0.5, 0.3 and 0.2 of each, missing ones as 0.5, 0.3 and 0.4, within 0 and 1."""
    n = F.greatest(F.size(semantic), F.size(grammar), F.size(segmenter))

    def at(i: Column) -> Column:
        s = F.coalesce(F.get(semantic, i), F.lit(0.5)) * 0.5 + F.coalesce(F.get(grammar, i), F.lit(0.3)) * 0.3 + F.coalesce(F.get(segmenter, i), F.lit(0.4)) * 0.2
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), s))

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), at)).otherwise(F.array().cast("array<double>"))


def chosen_boundaries(scores: Column, need: Column, total: Column) -> Column:
    """Best places first, later ones on ties, each far enough from those taken; then middles of the widest gaps.

    A fold over the places sorted by score, then one over the places still needed; too few scores give equal steps.
    """
    none = F.array().cast("array<int>")

    def by_steps(x: Column) -> Column:
        step = F.when(x["total"] <= x["need"] + 1, 1).otherwise(F.floor(x["total"] / (x["need"] + 1)).cast("int"))
        return F.filter(F.transform(F.sequence(F.lit(1), x["need"]), lambda k: (k * step).cast("int")), lambda p: p < x["total"])

    def by_score(x: Column) -> Column:
        apart = F.greatest(F.lit(1), F.floor(x["total"] / (x["need"] + 2)).cast("int"))
        places = F.reverse(F.array_sort(F.transform(x["scores"], lambda s, i: F.struct(s.alias("s"), (i + 1).cast("int").alias("p")))))

        def take(taken: Column, place: Column) -> Column:
            near = F.exists(taken, lambda t: F.abs(t - place["p"]) < apart)
            return F.when((F.size(taken) < x["need"]) & ~near, F.concat(taken, F.array(place["p"]))).otherwise(taken)

        def widest(taken: Column, _: Column) -> Column:
            def best(edges: Column) -> Column:
                gaps = F.zip_with(F.slice(edges, 1, F.size(edges) - 1), F.slice(edges, 2, F.size(edges) - 1), lambda a, b: F.struct((b - a).alias("g"), (a + F.floor((b - a) / 2)).cast("int").alias("m")))
                return F.array_max(F.filter(gaps, lambda g: (g["g"] > 2) & ~F.array_contains(taken, g["m"])))["m"]

            middle = T.let(F.array_sort(F.concat(F.array(F.lit(0), x["total"]), taken)), best)
            return F.when(F.size(taken) >= x["need"], taken).otherwise(T.let(middle, lambda m: F.when(m.isNull(), taken).otherwise(F.concat(taken, F.array(m)))))

        first = F.aggregate(F.filter(places, lambda q: q["p"] < x["total"]), none, take)
        return F.array_sort(F.aggregate(F.sequence(F.lit(1), x["need"]), first, widest))

    own = F.struct(F.coalesce(scores, F.array().cast("array<double>")).alias("scores"), need.cast("int").alias("need"), total.cast("int").alias("total"))
    return T.let(own, lambda x: F.when(x["need"] <= 0, none).when(F.size(x["scores"]) < x["need"], by_steps(x)).otherwise(by_score(x)))
