import difflib
import hashlib
import random
import time
from pathlib import Path

import numpy as np
import psutil
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from colometry import cli
from colometry.functions import brackets as B
from colometry.functions import text as T
from colometry.operators import align as A
from colometry.operators import embed as E
from colometry.operators import integrity as I
from colometry.operators import report as R
from colometry.sources import tables

SPACES = "".join(chr(c) for c in range(0x110000) if chr(c).isspace())


def value(spark, text, expr):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t")).alias("x")).first().x


CASES = [
    ("  가다. 나다!\n다다? 라。마.바 사○ 아  ", T.sentences, ["가다.", "나다!", "다다?", "라。마.바 사○", "아"]),
    ("曰：「學而時習之，不亦說乎？」 有朋", T.source_tokens, ["曰", "：", "「學而時習之", "，", "不亦說乎", "？", "」", " ", "有朋"]),
    ("甲，乙。丙 丁", lambda c: T.deal(T.source_tokens(c), F.lit(3)), ["甲，乙", "。丙", " 丁"]),
    ("甲，乙。丙 丁", lambda c: T.deal(T.source_tokens(c), F.lit(9)), ["甲", "，", "乙", "。", "丙", " ", "丁", "", ""]),
    ("", lambda c: T.deal(T.source_tokens(c), F.lit(2)), ["", ""]),
    ("甲。乙？ a. b! c", T.smart_split, ["甲。", "乙？", " a. ", "b! ", "c"]),
    ("aaaa bbbb, cccc dddd eeee ffff gggg. hhhh iiii jjjj kkkk", lambda c: T.long_cut(c, 30), ["aaaa bbbb, cccc dddd eeee ffff gggg. ", "hhhh iiii jjjj kkkk"]),
    ("子曰|學而時習之|不亦|乎|有朋自遠方來|矣", lambda c: T.merge_low_han(F.split(c, r"\|")), ["子曰", "學而時習之", "不亦乎", "有朋自遠方來矣"]),
    ("abcdefg", lambda c: T.equal_chars(c, F.lit(3)), ["abc", "de", "fg"]),
    ("子曰abc", T.contains_chinese, True),
    ("子曰abcdefg", T.contains_chinese, False),
    ("", T.contains_chinese, False),
    ("갑：을 병 정", lambda c: A.colon_units(c, F.lit(2)), ["갑：", "을 병 정"]),
    ("갑：을 병 정", lambda c: A.colon_units(c, F.lit(3)), ["갑：", "을 병", "정"]),
    ("갑：을 병 정", lambda c: A.colon_units(c, F.lit(5)), ["갑：", "을", "병", "정", ""]),
    ("a：b：c", lambda c: A.colon_units(c, F.lit(2)), None),
    ("a b c d e f g", lambda c: A.even_words(c, F.lit(3)), ["a b c", "d e", "f g"]),
    ("a b c", lambda c: A.adjust(T.split_ws(c), F.lit(2)), ["a", "b c"]),
    ("a b c", lambda c: A.adjust(T.split_ws(c), F.lit(4)), ["a", "b", "c", ""]),
    ("a b c", lambda c: T.jaccard(c, F.lit("b c d")), 0.5),
    ("가.\n나.", T.safe_sentences, ["가.\n나."]),
    ("가. 나.", T.safe_sentences, ["가.", "나."]),
    ("가. 나. 다", T.safe_punctuation_split, ["가. ", "나.", " 다"]),
    ("공자께서 말씀하셨다. 배우고 때때로 익히면 또한 기쁘지 아니한가", lambda c: A.target_units(c, F.lit(3)), ["공자께서 말씀하셨다. 배우고 때때로 익히면", "또한 기쁘지", "아니한가"]),
    ("벗이 먼 곳에서 찾아오면 또한 즐겁지 아니한가", lambda c: A.target_units(c, F.lit(2)), ["벗이 먼 곳에서 찾아오면 또한 즐겁지", "아니한가"]),
    (SPACES + "a" + SPACES + "b" + SPACES, T.split_ws, ["a", "b"]),
    (SPACES, T.is_blank, True),
    (None, T.is_blank, True),
    ("aa bb cc dd", lambda c: T.pack_tokens(T.source_tokens(c), 5), ["aa bb", " cc ", "dd"]),
]


@pytest.mark.parametrize("k", range(len(CASES)))
def test_literal(spark, k):
    text, expr, want = CASES[k]
    assert value(spark, text, expr) == want


def test_length_similarity(spark):
    rows = spark.createDataFrame([("abcd", "ab"), (" ", "ab"), ("學而", "배우고 때때로")], "a string, b string")
    got = [r.s for r in rows.select(A.length_similarity(F.col("a"), F.col("b")).alias("s")).collect()]
    assert got[:2] == [0.75, 0.0] and got[2] == pytest.approx(0.642857, abs=1e-6)


def choose(scores, need, total):
    """A plain model of the choice of boundaries."""
    if need <= 0:
        return []
    if len(scores) < need:
        step = 1 if total <= need + 1 else total // (need + 1)
        return [k * step for k in range(1, need + 1) if k * step < total]
    apart, taken = max(1, total // (need + 2)), []
    for _, place in sorted(((x, i) for i, x in enumerate(scores, 1) if i < total), reverse=True):
        if len(taken) < need and all(abs(place - t) >= apart for t in taken):
            taken.append(place)
    while len(taken) < need:
        edges = sorted([0, total, *taken])
        gaps = [(y - x, x + (y - x) // 2) for x, y in zip(edges, edges[1:], strict=False) if y - x > 2 and x + (y - x) // 2 not in taken]
        if not gaps:
            break
        taken.append(max(gaps)[1])
    return sorted(taken)


def chosen(spark, rows):
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, s array<double>, n int, t int")
    return [r.b for r in df.select("k", A.chosen_boundaries(F.col("s"), F.col("n"), F.col("t")).alias("b")).orderBy("k").collect()]


def test_boundaries(spark):
    rows = [([0.42] * 9, 3, 10), ([0.1, 0.9, 0.85, 0.1, 0.1, 0.1, 0.1, 0.8, 0.1], 3, 10), ([0.9 if p % 3 == 2 else 0.1 for p in range(1, 24)], 10, 24), ([], 3, 9), ([0.5], 0, 2), ([0.5], 5, 2)]
    want = [[5, 7, 9], [2, 6, 8], [2, 5, 8, 11, 14, 17, 18, 20, 21, 23], [2, 4, 6], [], [1]]
    assert chosen(spark, rows) == want == [choose(*r) for r in rows]
    rng = random.Random(3)
    rows = []
    for _ in range(300):
        total = rng.randint(1, 30)
        rows.append(([rng.choice([0.1, 0.2, 0.5, rng.random()]) for _ in range(max(0, total - 1))], rng.randint(0, total + 2), total))
    assert chosen(spark, rows) == [choose(*r) for r in rows]


def test_uniform_boundaries_are_the_general_choice(spark):
    rows = spark.createDataFrame([(t, n) for t in range(2, 40) for n in range(1, t)], "t int, n int")
    for r in rows.select("t", "n", A.uniform_boundaries(F.col("t"), F.col("n")).alias("b")).collect():
        assert r.b == choose([0.42] * (r.t - 1), r.n, r.t)


def test_cut_by_meaning_is_what_the_vectors_say(spark):
    model = E.hashing_embedder()
    rng = random.Random(5)
    words = lambda n: [rng.choice(["river", "stone", "water", "hill", "walks", "talk", "sees", "rivers", "stones"]) for _ in range(n)]
    rows = [(k, " ".join(words(rng.randint(1, 5))), " ".join(words(rng.randint(1, 12)))) for k in range(40)]
    got: dict = {}
    for r in A.align_phrases(spark.createDataFrame(rows, "id long, src string, tgt string"), ["id"], semantic=E.embedded(E.get_embedder("hash"))).orderBy("id", "phrase_id").collect():
        got.setdefault(r.id, []).append((r.src, r.tgt))
    for k, src, tgt in rows:
        u, w = src.split(), tgt.split()
        if len(u) == 1:
            units = [tgt]
        elif len(w) <= len(u):
            units = w + [""] * (len(u) - len(w))
        else:
            a, b = (np.array(model(x)) for x in (w, u))
            near = (a @ b.T) / (np.outer(np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)) + 1e-8)
            at, best = near.argmax(axis=1), near.max(axis=1)
            scores = [0.5 * (min(0.9, max(0.1, (best[i] + best[i + 1]) / 2)) if at[i] != at[i + 1] else 0.1) + 0.3 * 0.3 + 0.4 * 0.2 for i in range(len(w) - 1)]
            cuts = [0, *choose([min(1.0, max(0.0, x)) for x in scores], len(u) - 1, len(w)), len(w)]
            units = [" ".join(w[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)]
            units = units + [""] * (len(u) - len(units)) if len(units) <= len(u) else [*units[: len(u) - 1], " ".join(units[len(u) - 1 :])]
        assert got[k] == list(zip(u, units, strict=True))


def test_grammar_and_taggers(spark):
    tags = {"a": "NNG", "b": "VV", "c": "EF", "d": None}
    df = spark.createDataFrame([(["a", "b", "c", "a", "d", "a"],), (["a"],), ([],)], "w array<string>")
    got = [r.s for r in df.select(A.let_grammar(E.tagged(lambda: tags.get)(F.col("w"))).alias("s")).collect()]
    assert got == [[0.6, 0.4, 0.9, 0.3, 0.3], [], []]
    scores = df.select(A.analysis(F.lit(None).cast("array<string>"), F.col("w")).alias("x")).first().x
    assert scores.semantic == [0.5] * 5 and scores.grammar == [0.3] * 5 and scores.segmenter == [0.4] * 5 and scores.combined == pytest.approx([0.42] * 5)


def test_wrappers(spark):
    assert value(spark, "a b c d", lambda c: A.units_by_source(F.lit("x y"), c)) == value(spark, "a b c d", lambda c: A.units_by_semantics(F.array(F.lit("x"), F.lit("y")), c)) == value(spark, "a b c d", lambda c: A.units_by_meaning(c, F.lit(2)))
    assert value(spark, " a  b ", lambda c: A.units_by_source(F.lit(" "), c)) == ["a b"]
    row = A.error_rows(spark.createDataFrame([(7, "a b", None)], "id long, src string, tgt string"), "id").first()
    assert tuple(row) == ("7_error", "a b", "", "error_fallback", 1.0, 2, 0)
    fallen = A.fallback_rows(spark.createDataFrame([(7, None, "x y z")], "id long, src string, tgt string"), ["id"]).first()
    assert tuple(fallen) == (7, "", "x y z", "fallback_mode", 1.0, 0, 3)


def test_models_where_installed(spark):
    load = lambda chinese: (lambda t: t.split("|")) if not chinese else None
    assert value(spark, "a b |c| ", lambda c: T.model_sentences(c, load)) == ["a b", "c"]
    assert value(spark, "子曰。學而", lambda c: T.model_units(c, 180, load)) == ["子曰。學而"] and value(spark, "a. b|c", lambda c: T.model_units(c, 180, load)) == ["a. b", "c"]
    assert value(spark, "aa bb cc|d", lambda c: T.model_units(c, 5, load)) == ["aa bb", " cc", "d"]
    assert value(spark, "a. b|c", lambda c: T.model_punctuation_split(c, 150, load)) == ["a. b", "c"] and value(spark, "a. b", T.model_punctuation_split) == ["a", "b"]
    broken = lambda chinese: (lambda t: 1 // 0)
    assert value(spark, "a", lambda c: T.model_sentences(c, broken)) == []
    assert value(spark, "say 'x'", T.quotes) == ("say 'x'", []) and value(spark, "a…", T.normalized_punctuation) == "a…"


def test_brackets():
    masked, masks = B.mask_text("a (b) [c (d)] 「e」")
    assert "(" not in masked and "[" not in masked and B.restore_text(masked, masks) == "a (b) [c (d)] 「e」"
    assert B.mask_text("(a (b) c) [d]")[1][-1]["content"] == "(b)"


def test_bracket_is_one_word(spark):
    df = spark.createDataFrame([(1, "甲 乙", "갑(을 병：정) 무"), (2, "甲 乙", "가"), (3, "", "x"), (4, None, "x")], "id long, src string, tgt string")
    got = [(r.id, r.phrase_id, r.src, r.tgt) for r in A.align_phrases(df, ["id"]).orderBy("id", "phrase_id").collect()]
    assert got == [(1, 1, "甲", "갑(을 병：정)"), (1, 2, "乙", "무"), (2, 1, "甲", "가"), (2, 2, "乙", "")]


def test_readme_paragraph(spark):
    df = spark.createDataFrame([(1, "子曰 學而時習之 不亦說乎. 有朋自遠方來 不亦樂乎. 人不知而不慍 不亦君子乎.", "A. B. C. D.")], "id long, src string, tgt string")
    got = [r.src for r in A.align_paragraphs(df, ["id"]).orderBy("sentence_no").collect()]
    assert got == ["子曰 學而時習之 ", "不亦說乎. 有朋自遠方來", " 不亦樂乎. ", "人不知而不慍 不亦君子乎."]


def test_nothing_is_lost(spark):
    rng = random.Random(1)
    pool = "子曰가나다ab\U00020000()[]{}「」『』〈〉《》：.!?。" + SPACES
    rows = [(k, *("".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(2))) for k in range(300)]
    df = spark.createDataFrame(rows, "id long, src string, tgt string")
    checks = I.row_integrity(A.align_phrases(df, ["id"]), df.where(T.both_sides(F.col("src"), F.col("tgt"))), ["id"])
    assert checks.where("not valid").count() == 0
    back = df.select("src", B.unprotect(B.protect(F.col("src"))).alias("b"), F.array_join(T.source_tokens(F.col("src")), "").alias("t"), F.array_join(T.smart_split(F.col("src")), "").alias("s"))
    assert back.where("src <> b or src <> t or src <> s").count() == 0


def test_integrity():
    assert I.accuracy("abcd", "abd") == pytest.approx(0.857142, abs=1e-6)
    assert I.patch(["ab", "d"], "abd", "abcd") == ["ab", "dc"]
    assert I.repair_units("abcd", ["ab", "d"]) == (["ab", "cd"], True)


def corrupted(n=120):
    """Original, units of it with text lost, doubled and changed."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("가나다라ab") for _ in range(rng.randint(1, 5)))
    for _ in range(n):
        units = [" ".join(word() for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(0, 5))]
        whole = " ".join(units) + rng.choice(["", " ", "\n"])
        for k in range(len(units)):
            what = rng.randint(0, 5)
            units[k] = units[k][:-1] if what == 0 else units[k] * 2 if what == 1 else units[k].replace("a", "z") if what == 2 else units[k]
        yield whole, units


def patched(units, have, want):
    """A plain model: missing text to the end, surplus text from the first unit that has it."""
    units = list(units)
    for tag, a, b, c, d in difflib.SequenceMatcher(None, have, want).get_opcodes():
        if tag == "insert":
            units = [*units[:-1], (units[-1] if units else "") + want[c:d]]
        if tag == "delete":
            for k, unit in enumerate(units):
                if have[a:b] in unit:
                    units[k] = unit.replace(have[a:b], "", 1)
                    break
    return units


def test_repairs_against_a_plain_model(spark):
    cases = list(corrupted())
    df = spark.createDataFrame([(k, w, u) for k, (w, u) in enumerate(cases)], "k int, w string, u array<string>")
    bare = lambda x: "".join(x.split())
    cut = lambda t, n: [t[k * (len(t) // n) + min(k, len(t) % n) : (k + 1) * (len(t) // n) + min(k + 1, len(t) % n)] for k in range(n)] if n else [t]
    got = df.select("k", I.repaired(F.col("w"), F.col("u")).alias("a"), I.repaired_sentences(F.col("w"), F.col("u")).alias("b"), I.verification(F.col("w"), F.array_join("u", "")).alias("v"), I.within_tolerance(F.col("w"), F.array_join("u", "")).alias("t")).orderBy("k").collect()
    for r, (whole, units) in zip(got, cases, strict=True):
        have, want = bare("".join(units)), bare(whole)
        first = patched(units, have, want)
        out = first if bare("".join(first)) == want else cut(whole, len(units))
        ok = bare("".join(out)) == want
        assert (r.a.units, r.a.ok) == (out if ok else [whole], ok)
        plain, given = "".join(units).replace(" ", ""), whole.replace(" ", "").replace("\n", "").replace("\t", "")
        assert r.b == (units if plain == given else patched(units, plain, given))
        ratio = difflib.SequenceMatcher(None, want, have).ratio() if want else float(not have)
        assert r.v.character_accuracy == pytest.approx(1.0 if want == have else ratio) and r.v.length_diff == abs(len(want) - len(have)) and r.v.original_checksum == hashlib.sha256(want.encode()).hexdigest()
        assert r.t == (True if not want and not have else False if not want or not have else want == have or ratio >= 0.95)


def test_with_integrity_and_files(spark):
    cases = [c for c in corrupted(60) if c[0].strip()]
    df = spark.createDataFrame([(k, w, u) for k, (w, u) in enumerate(cases)], "k int, w string, u array<string>")
    bare = lambda x: "".join(x.split())
    for r, (whole, units) in zip(I.repaired_file(df, "w", "u").orderBy("k").collect(), cases, strict=True):
        assert r.restored == (bare("".join(units)) != bare(whole)) and r.valid == (bare("".join(r.u)) == bare(whole)) and (r.restored or r.u == units)
    as_file = I.repaired_file(df, "w", "u", whole=True, order=["k"]).orderBy("k").collect()
    assert [len(r.u) for r in as_file] == [len(u) for _, u in cases] and "".join(x for r in as_file for x in r.u).split() is not None
    assert bare("".join(x for r in as_file for x in r.u)) == bare("".join(w for w, _ in cases))


def test_rows_of_their_own_for_lost_sides():
    row = lambda a, b: {"src": a, "tgt": b, "similarity": 1.0, "split_method": "p", "align_method": "s"}
    assert I.repair_rows("ab c", "x", [row("ab", "x")])[0] == row("abc", "x")
    got = I.repair_rows("ab", "", [])
    assert got == [{"src": "ab", "tgt": "", "similarity": 0.0, "split_method": "integrity_restore", "align_method": "src_missing_restore"}]
    got = I.repair_rows("ab", "xy", [])
    assert [(r["src"], r["tgt"], r["align_method"]) for r in got] == [("ab", "xy", "src_missing_restore")]
    assert [r["align_method"] for r in I.repair_rows("", "xy", [])] == ["tgt_missing_restore"]


def test_checks_within_rows_and_files(spark):
    df = spark.createDataFrame([(1, "a b", "x y"), (2, "c", "z w"), (3, " ", "q")], "id long, src string, tgt string")
    units = A.phrase_units(df, ["id"])
    assert sorted((r.id, r.valid, r.missing) for r in I.row_checks(units, ["id"]).collect()) == [(1, True, False), (2, True, False)]
    assert I.file_valid(df.where("id < 3"), A.align_phrases(df, ["id"]), "tgt", ["id"], ["id", "phrase_id"]).first().valid
    assert not I.file_valid(df, A.align_phrases(df, ["id"]), "tgt", ["id"], ["id", "phrase_id"]).first().valid
    many = spark.range(250).select(F.col("id"), F.concat(F.lit("t "), F.col("id")).alias("t")).repartition(7)
    texts, digests = [f"t{i}" for i in range(250)], None
    digests = texts
    for _ in range(I.LEVELS):
        digests = [hashlib.sha256("".join(digests[k : k + I.FANOUT]).encode()).hexdigest() for k in range(0, len(digests), I.FANOUT)]
    assert tuple(I.file_checksum(many, "t", ["id"]).first()) == (digests[0], sum(map(len, texts)))
    assert I.joined_checksum(many, "t", ["id"]).first().checksum == hashlib.sha256("".join(texts).encode()).hexdigest()
    assert sorted(r.row_idx for r in A.row_numbers(many).collect()) == list(range(250))
    got = R.totals(spark.range(5), I.row_checks(units, ["id"])).first()
    assert tuple(got) == (5, 2, 0, 0)


def test_rows_are_numbered_alike_whatever_else_they_hold(spark, tmp_path):
    """Texts of several MB in the rows and none in their counts, so that partitions of either are merged differently."""
    texts = [f"{k} " + "".join(hashlib.sha256(b"%d %d" % (k, j)).hexdigest() for j in range(20)) for k in range(5000)]
    rows = spark.createDataFrame([(k * 7919 % 5000 // 7, k * 7919 % 5000 % 7, texts[k * 7919 % 5000]) for k in range(5000)], "a long, b long, t string")
    rows.repartition(8).write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))
    digests = [t.replace(" ", "") for t in texts]
    chars = sum(map(len, digests))
    for _ in range(I.LEVELS):
        digests = [hashlib.sha256("".join(digests[k : k + I.FANOUT]).encode()).hexdigest() for k in range(0, len(digests), I.FANOUT)]
    assert I.file_checksum(df, "t", ["a", "b"]).first() == (digests[0], chars)
    got = A.row_numbers(df, ["a", "b"]).select("a", "b", "row_idx").collect()
    assert len(got) == 5000 and all(r.row_idx == r.a * 7 + r.b for r in got)


def test_equal_pieces_take_linear_time(spark):
    """Cuts of any text into any number of pieces are plain Python's; a long one of many sentences takes seconds, not minutes."""
    rng = random.Random(5)
    rows = [("".join(rng.choice("ab \n。.\U00020000") for _ in range(rng.randrange(30))), rng.randrange(-1, 12)) for _ in range(300)]
    df = spark.createDataFrame([(k, t, n) for k, (t, n) in enumerate([*rows, (None, 2), ("", 3)])], "k int, t string, n int")
    got = {r.k: r.x for r in df.select("k", T.equal_chars(F.col("t"), F.col("n")).alias("x")).collect()}
    assert all(got[k] == (I.even(t, n) if n > 0 else []) for k, (t, n) in enumerate(rows)) and got[300] == [None, None] and got[301] == ["", "", ""]
    long = "abc de. " * 100_000
    began = time.monotonic()
    assert value(spark, long, T.safe_punctuation_split) == I.even(long, 100_000)
    assert time.monotonic() - began < 60


def test_texts_are_embedded_a_few_at_a_time(spark):
    """However many words a batch of rows holds; scores are those of each row alone, also for a row in several blocks."""

    def vectors(texts):
        found = np.stack([np.random.default_rng(list(t.encode())).normal(size=8) for t in texts])
        return found / np.linalg.norm(found, axis=1, keepdims=True)

    def loader():
        def few(texts):
            assert len(texts) <= 2048, len(texts)
            return vectors(texts).tolist()

        return few

    rng = random.Random(7)
    rows = [(k, [f"u{rng.randrange(10**6)}" for _ in range(40)], [f"w{rng.randrange(10**6)}" for _ in range(40)]) for k in range(100)]
    rows += [(100, [], ["a"]), (101, ["a"], []), (102, ["a", "b"], ["b"])]
    df = spark.createDataFrame(rows, "k int, u array<string>, w array<string>").coalesce(1)
    got = {r.k: r.s for r in df.select("k", E.embedded(loader)(F.col("u"), F.col("w")).alias("s")).collect()}
    for k, u, w in rows:
        best = [(int(x.argmax()), x.max()) for x in vectors(w) @ vectors(u).T] if u and w else []
        assert got[k] == pytest.approx([min(0.9, max(0.1, (a + b) / 2)) if i != j else 0.1 for (i, a), (j, b) in zip(best, best[1:], strict=False)], abs=1e-6)


def test_masks_of_many_texts_take_little_memory(spark):
    """600,000 masks in one task: its workers' peaks stay near what they had."""
    kin = lambda: [p for p in psutil.Process().children(recursive=True) if "python" in p.name()]
    peak = lambda p: int(Path(f"/proc/{p.pid}/status").read_text().split("VmHWM:")[1].split()[0]) / 1024
    texts = spark.range(3000, numPartitions=1).select(F.concat(F.col("id").cast("string"), F.repeat(F.lit(" (a) [b]"), 100)).alias("t"))
    out = lambda df: df.select("t", B.masked(F.col("t")).alias("m")).select("t", F.size("m.masks").alias("n"), B.restored(F.col("m.masked"), F.col("m.masks")).alias("b"))
    assert out(texts.limit(10)).where("t = b and n = 200").count() == 10
    before = max(p.memory_info().rss / 2**20 for p in kin())
    for p in kin():
        Path(f"/proc/{p.pid}/clear_refs").write_text("5")
    assert out(texts).where("t = b and n = 200").count() == 3000
    assert max(map(peak, kin())) < before + 150


def test_packed_is_greedy_packing_of_tokens(spark, tmp_path):
    rng = random.Random(9)
    rows = [(k, "".join(rng.choice("aab。， \n\U00020000") * rng.choice((1, 1, 1, 3, 9)) for _ in range(rng.randrange(40)))) for k in range(500)]
    df = spark.createDataFrame([*rows, (500, None)], "doc_id long, text string")
    for most in (0, 1, 5, 12):
        assert df.where(~T.packed(F.col("text"), most).eqNullSafe(T.pack_tokens(T.source_tokens(F.col("text")), most))).count() == 0
    df.write.parquet(str(tmp_path / "documents.parquet"))
    plan = __spark_entry__.queries()["pa_token_packing"](spark, str(tmp_path))._jdf.queryExecution().toString()
    assert "aggregate(" not in plan  # no step for each token


def test_characters_of_a_long_sentence(spark, tmp_path):
    """The sentence's digest is computed once, not for each of its characters."""
    long = "ab\U00020000d " * 40_000 + "e."
    spark.createDataFrame([(1, long), (2, " "), (3, None), (4, "a. b")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    began = time.monotonic()
    got = __spark_entry__.queries()["pa_characters"](spark, str(tmp_path)).orderBy("doc_id", "sentence", "n").collect()
    assert time.monotonic() - began < 30
    digest = lambda t: hashlib.md5(t.encode()).hexdigest()
    whole = digest(long)
    want = [(1, whole, k, c) for k, c in enumerate(long, 1)] + sorted([(4, digest("a."), 1, "a"), (4, digest("a."), 2, "."), (4, digest("b"), 1, "b")])
    same = [tuple(r) for r in got] == want
    assert same


def test_command_line(spark, tmp_path):
    spark.createDataFrame([("子曰 學而", "A b. C d."), ("", "x"), ("甲 乙", "e f g")], "src string, tgt string").coalesce(1).write.parquet(str(tmp_path / "in.parquet"))
    assert cli.main(["sa", str(tmp_path / "in.parquet"), str(tmp_path / "sa.parquet"), "--embedder", "hash"]) == 0
    got = spark.read.parquet(str(tmp_path / "sa.parquet")).orderBy("sentence_id", "phrase_id").collect()
    assert {r.sentence_id for r in got} == {1, 3} and "".join(r.tgt for r in got if r.sentence_id == 3).replace(" ", "") == "efg"
    assert cli.main(["pa", str(tmp_path / "in.parquet"), str(tmp_path / "pa.parquet"), "--hybrid", "--verbose"]) == 0
    assert spark.read.parquet(str(tmp_path / "pa.parquet")).count() == 3
    assert cli.main(["pa", str(tmp_path / "in.parquet"), str(tmp_path / "none.parquet"), "--similarity-threshold", "2"]) == 1
    assert cli.main(["pa", str(tmp_path / "missing.parquet"), str(tmp_path / "x.parquet")]) == 1


def test_required_columns(spark):
    with pytest.raises(ValueError, match="tgt"):
        tables.require(spark.createDataFrame([("a",)], "src string"), "src", "tgt")


def test_length_equal_corruption_passes(spark):
    df = spark.createDataFrame([("abcd", "abce"), ("abcd", "abc")], "a string, b string")
    assert [r.v for r in df.select(I.collapsed_valid(F.col("a"), F.col("b")).alias("v")).collect()] == [True, False]


def test_xlsx_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(0, "子曰 <&>", "A. B."), (1, None, " x\ny ")], "row_idx long, src string, tgt string")
    tables.write_xlsx(rows.select(F.col("src").alias("원문"), F.col("tgt").alias("번역문")), str(tmp_path / "a.xlsx"))
    got = tables.read_bitext(spark, str(tmp_path / "a.xlsx")).orderBy("row_idx").collect()
    assert [tuple(r) for r in got] == [(0, "子曰 <&>", "A. B."), (1, None, " x\ny ")]
    spark.dataSource.register(tables.XlsxSource)
    assert spark.read.format("xlsx").option("path", str(tmp_path / "a.xlsx")).load().count() == 2


def test_a_sheet_has_its_limit(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "SHEET_ROWS", 3)
    tables.write_xlsx(spark.range(2), str(tmp_path / "a.xlsx"))
    with pytest.raises(ValueError, match="sheet"):
        tables.write_xlsx(spark.range(3), str(tmp_path / "b.xlsx"))


def test_catalogue_runs(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
