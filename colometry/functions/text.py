"""Splitting and tokenizing as Column expressions. White space means Python's 29 characters everywhere."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: All that Python's str.split() and \s treat as white space.
WS = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
TERMINAL = ".!?。？！○"
DELIMITERS = "：。！？；、，"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{WS}+|{WS}+\z", "")


def is_blank(c: Column) -> Column:
    """True for null too."""
    return F.coalesce(strip(c) == "", F.lit(True))


def both_sides(src: Column, tgt: Column) -> Column:
    """Rows with text on both sides."""
    return ~is_blank(src) & ~is_blank(tgt)


def squeeze(c: Column) -> Column:
    """Without white space."""
    return F.regexp_replace(c, f"{WS}+", "")


def split_ws(c: Column) -> Column:
    """Units between white space; none for a blank text."""
    return F.filter(F.split(c, f"{WS}+"), lambda x: x != "")


def _stripped(pieces: Column) -> Column:
    return F.filter(F.transform(pieces, strip), lambda x: x != "")


def sentences(c: Column) -> Column:
    """Cut at white space after a terminal mark, which stays."""
    return _stripped(F.split(strip(c), f"(?<=[{TERMINAL}]){WS}+"))


def source_tokens(c: Column) -> Column:
    """Runs of delimiters and runs of anything else: joined, the text again."""
    inner = DELIMITERS + WS[1:-1]
    return F.regexp_extract_all(c, F.lit(f"[{inner}]+|[^{inner}]+"), 0)


def deal(tokens: Column, n: Column, sep: str = "") -> Column:
    """Tokens in order into n chunks, the first ones getting the remainder; n < 1 gives none."""

    def chunks(own: Column) -> Column:
        q, r = F.floor(F.size(own) / n).cast("int"), (F.size(own) % n).cast("int")
        return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.array_join(F.slice(own, k * q + F.least(k, r) + 1, q + F.when(k < r, 1).otherwise(0)), sep))

    return F.when(n > 0, let(tokens, chunks)).otherwise(F.array().cast("array<string>"))


def smart_split(c: Column) -> Column:
    """Zero-width cuts after full-width marks, and after ASCII marks with one white space."""
    return F.filter(F.split(F.regexp_replace(c, rf"([。？！○]|[.!?]{WS})", "$1\x01"), "\x01"), lambda x: x != "")


def punctuation_split(c: Column, max_length: int = 150) -> Column:
    """Cut at terminal marks, which go; pieces that are too long are cut at commas."""
    pieces = _stripped(F.split(c, "[.!?。！？；]"))
    return F.when(is_blank(c), F.array().cast("array<string>")).otherwise(
        F.flatten(F.transform(pieces, lambda s: F.when(F.length(s) <= max_length, F.array(s)).otherwise(_stripped(F.split(s, ",")))))
    )


def equal_chars(c: Column, n: Column) -> Column:
    """n pieces of equal length, the first ones longer by one; n < 1 gives none.

    Each of the two lengths is one pass over its part of the text, however many pieces there are.
    """

    def runs(text: Column, length: Column) -> Column:
        return F.regexp_extract_all(text, F.concat(F.lit("(?s).{"), length.cast("string"), F.lit("}")), F.lit(0))

    def pieces(x: Column) -> Column:
        q, r = F.floor(x["m"] / x["n"]).cast("int"), (x["m"] % x["n"]).cast("int")
        longer = F.when(r > 0, runs(F.substring(x["c"], 1, r * (q + 1)), q + 1)).otherwise(F.array().cast("array<string>"))
        return F.concat(longer, F.when(q > 0, runs(F.substring(x["c"], r * (q + 1) + 1, x["m"]), q)).otherwise(F.array_repeat(F.lit(""), x["n"] - r)))

    own = let(F.struct(c.alias("c"), n.cast("int").alias("n"), F.length(c).alias("m")), pieces)
    return F.when(n > 0, F.coalesce(own, F.array_repeat(F.lit(None).cast("string"), n.cast("int")))).otherwise(F.array().cast("array<string>"))


def safe_punctuation_split(c: Column, max_length: int = 150) -> Column:
    """punctuation_split whose loss was noticed: only trailing marks lost are put back at the end, after
    any other loss the text is cut into as many equal pieces."""

    def check(x: Column) -> Column:
        pieces, bare, whole = x["p"], x["b"], x["w"]
        missing = F.regexp_extract(bare, r"[.!?。！？；]+\z", 0)
        last = F.concat(F.slice(pieces, 1, F.size(pieces) - 1), F.array(F.concat(F.element_at(pieces, -1), missing)))
        return F.when(F.size(pieces) == 0, F.when(bare == "", pieces).otherwise(F.array(c))).when(whole == bare, pieces).when(F.concat(whole, missing) == bare, last).otherwise(equal_chars(c, F.size(pieces)))

    return let(punctuation_split(c, max_length), lambda p: let(F.struct(p.alias("p"), squeeze(c).alias("b"), squeeze(F.array_join(p, "")).alias("w")), check))


def safe_sentences(c: Column) -> Column:
    """sentences, unless their joining lost a line feed or tab: then the text whole. Other white space
    that was lost is appended to the last sentence; blanks may go."""
    separators = F.concat_ws("", F.regexp_extract(c, rf"\A{WS}+", 0), F.array_join(F.regexp_extract_all(strip(c), F.lit(f"(?<=[{TERMINAL}]){WS}+"), 0), ""), F.regexp_extract(c, rf"{WS}+\z", 0))

    def amended(own: Column, lost: Column) -> Column:
        return F.concat(F.slice(own, 1, F.size(own) - 1), F.array(F.concat(F.element_at(own, -1), lost)))

    def choose(lost: Column) -> Column:
        return F.when(lost.rlike(r"[\n\t]"), F.array(c)).otherwise(let(sentences(c), lambda own: F.when(lost == "", own).otherwise(amended(own, lost))))

    return F.when(is_blank(c), F.array(c)).otherwise(let(F.regexp_replace(separators, " ", ""), choose))


def han_count(c: Column) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit(r"\p{IsHan}"), 0))


def contains_chinese(c: Column) -> Column:
    """More than 30 % Han characters."""
    return han_count(c) > F.length(c) * 0.3


def merge_low_han(pieces: Column, most: int = 3) -> Column:
    """Pieces of at most 3 Han characters gather and come out as one before the next larger piece; those
    at the end join the last item."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("buf"))

    def step(acc: Column, s: Column) -> Column:
        flushed = F.when(acc["buf"] != "", F.concat(acc["out"], F.array(acc["buf"]))).otherwise(acc["out"])
        small = han_count(s) <= most
        return F.struct(F.when(small, acc["out"]).otherwise(F.concat(flushed, F.array(s))).alias("out"), F.when(small, F.concat(acc["buf"], s)).otherwise("").alias("buf"))

    def finish(acc: Column) -> Column:
        out, buf = acc["out"], acc["buf"]
        joined = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.concat(F.element_at(out, -1), buf)))
        return F.when(buf == "", out).when(F.size(out) == 0, F.array(buf)).otherwise(joined)

    return F.aggregate(pieces, start, step, finish)


def packed(c: Column, max_length: int) -> Column:
    """pack_tokens of a text's source_tokens, without them: the longest part that ends between tokens, else one token that is longer."""
    inner = DELIMITERS + WS[1:-1]
    between = rf"(?:(?<=[{inner}])(?=[^{inner}])|(?<=[^{inner}])(?=[{inner}])|\z)"
    part = f"(?s:.{{1,{max_length}}}){between}|" if max_length > 0 else ""
    return F.regexp_extract_all(c, F.lit(f"{part}[{inner}]+|[^{inner}]+"), 0)


def pack_tokens(tokens: Column, max_length: int) -> Column:
    """Greedy packing: a token that would exceed max_length opens the next part."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("part"), F.lit(False).alias("any"))

    def step(acc: Column, token: Column) -> Column:
        over = acc["any"] & (F.length(acc["part"]) + F.length(token) > max_length)
        return F.struct(F.when(over, F.concat(acc["out"], F.array(acc["part"]))).otherwise(acc["out"]).alias("out"), F.when(over, token).otherwise(F.concat(acc["part"], token)).alias("part"), F.lit(True).alias("any"))

    return F.aggregate(tokens, start, step, lambda acc: F.when(acc["any"], F.concat(acc["out"], F.array(acc["part"]))).otherwise(acc["out"]))


def characters(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def jaccard(a: Column, b: Column) -> Column:
    """Of white-space tokens, 3 decimals; 0 if a side is blank."""
    share = let(F.struct(split_ws(a).alias("x"), split_ws(b).alias("y")), lambda s: F.size(F.array_intersect(s["x"], s["y"])) / F.size(F.array_union(s["x"], s["y"])))
    return F.when(is_blank(a) | is_blank(b), 0.0).otherwise(F.round(share, 3))


# ---------------------------------------------------------------- cuts of long sentences: needs a loop

#: Patterns to cut at, most wanted first, sought within REACH characters of the wanted place.
CUTS = ("[。！？○]", r"[.!?]\s", "[：]", r"[:]\s", r"[，]\s*(?=.{10,})", r"[,]\s+(?=.{10,})", r"\s+")
REACH = 20
_CUTS = tuple(re.compile(p) for p in CUTS)


def cut_near(text: str, place: int) -> int:
    """End of the first hit of the most wanted pattern around place; place itself if there is none."""
    low = max(0, place - REACH)
    around = text[low : min(len(text), place + REACH)]
    hits = (m for m in (p.search(around) for p in _CUTS) if m)
    first = next(hits, None)
    return low + first.end() if first else place


def cut_long(text: str, max_length: int) -> list[str]:
    out = []
    while len(text) > max_length:
        at = cut_near(text, max_length)
        if not 0 < at < len(text):
            break
        out.append(text[:at])
        text = text[at:]
    return [*out, text] if text else out


def long_cut(c: Column, max_length: int = 150) -> Column:
    @F.pandas_udf(ArrayType(StringType()))
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else cut_long(t, max_length))

    return run(c)


def legacy_split(c: Column, max_length: int = 150) -> Column:
    """smart_split, then cuts of what is too long, then merging of what holds few Han characters."""

    @F.pandas_udf(ArrayType(StringType()))
    def run(pieces: pd.Series) -> pd.Series:
        return pieces.map(lambda ps: None if ps is None else [x for p in ps for x in (cut_long(p, max_length) if len(p) > max_length else [p])])

    return merge_low_han(run(smart_split(c)))


# ---------------------------------------------------------------- models, where installed


def model_loader(chinese: bool, second: str = "ko_core_news_sm"):
    """A function from text to its sentences by an installed spaCy model, or None."""
    try:
        import spacy

        nlp = spacy.load("zh_core_web_sm" if chinese else second)
    except (ImportError, OSError):
        return None
    return lambda text: [s.text for s in nlp(text).sents]


def model_sentences(c: Column, load: Callable[[bool], Callable[[str], list[str]] | None] = model_loader) -> Column:
    """Sentences by a model for Chinese (more than 30 % Han characters), else for Korean; none without a model or after an error."""

    @F.pandas_udf(ArrayType(StringType()))
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        models: dict = {}

        def one(text: str | None, chinese: bool) -> list[str]:
            if chinese not in models:
                models[chinese] = load(chinese)
            try:
                return [x.strip() for x in models[chinese](text) if x.strip()] if models[chinese] and text else []
            except Exception:  # whatever a model raises, a text it can't split has no sentences
                return []

        for texts, chinese in batches:
            yield pd.Series([one(t, bool(z)) for t, z in zip(texts, chinese, strict=True)])

    return run(c, F.coalesce(contains_chinese(c), F.lit(False)))


def model_units(c: Column, max_length: int = 180, load: Callable[[bool], Callable[[str], list[str]] | None] = model_loader) -> Column:
    """Sentences by a model, those over max_length packed anew from their tokens; without a model as `sentences`."""
    repacked = lambda found: F.flatten(F.transform(found, lambda s: F.when(F.length(s) > max_length, packed(s, max_length)).otherwise(F.array(s))))
    return let(model_sentences(c, load), lambda found: F.when(F.size(found) == 0, sentences(c)).otherwise(repacked(found)))


def model_punctuation_split(c: Column, max_length: int = 150, load: Callable[[bool], Callable[[str], list[str]] | None] = model_loader) -> Column:
    """Sentences by a model, those over max_length cut by punctuation; without a model as `punctuation_split`."""
    cut = lambda found: F.flatten(F.transform(found, lambda s: F.when(F.length(s) > max_length, punctuation_split(s, max_length)).otherwise(F.array(s))))
    return let(model_sentences(c, load), lambda found: F.when(F.size(found) == 0, punctuation_split(c, max_length)).otherwise(cut(found)))


def quotes(c: Column) -> Column:
    """The text and its quotes. No quotes are taken out: the text as it is, and none."""
    return F.struct(c.alias("text"), F.array().cast("array<string>").alias("quotes"))


def normalized_punctuation(c: Column) -> Column:
    """Punctuation as it is."""
    return c
