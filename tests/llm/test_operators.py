"""Small cases against brute force; nulls, empty and repeated rows, clashing columns, empty tables."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from colometry.llm import html, jaccard, lines, media, mixing, nets, phrases, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, kept string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None, 1, "x") for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 6)))
    passage = [word() for _ in range(60)]
    base = [[word() for _ in range(rng.randint(40, 160))] for _ in range(25)]
    rows = [(None, None, None), (1, None, "a"), (2, "", "a"), (3, " \n\t", None), (4, "one two", "b"), (5, "one two", "b"), (5, "one two", "b")]
    for k in range(10, 90):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = word()
        if rng.random() < 0.3:
            at = rng.randrange(len(w))
            w[at:at] = passage
        rows.append((k, "".join(x + rng.choice([" ", " ", "\n"]) for x in w), rng.choice(["a", "b", "c", None])))
    return rows


def test_phrases(spark, corpus):
    words = [(t or "").split() for _, t, _ in corpus]
    count = collections.Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    want = []
    for (k, _, _), w in zip(corpus, words, strict=True):
        gone = {j for i in range(len(w) - 34) if count[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        want.append((k, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    got = [tuple(r) for r in phrases.remove_repeats(spark, docs(spark, corpus)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert phrases.remove_repeats(spark, docs(spark, corpus).limit(0)).count() == 0


def test_jaccard(spark, corpus):
    sets = []
    for _, t, _ in corpus:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    comp = list(range(len(sets)))
    for _ in range(len(sets)):
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and 100 * len(a & b) >= 80 * len(a | b):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    key = lambda i: (corpus[i][0] is None, corpus[i][0] or 0)
    low = {c: min((key(i) for i in range(len(sets)) if comp[i] == c)) for c in set(comp)}
    want = [(corpus[i][0], len(s), None if low[comp[i]][0] else low[comp[i]][1]) for i, s in enumerate(sets)]
    got = [tuple(r)[:3] for r in jaccard.near_duplicates(spark, docs(spark, corpus)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_edits():
    def slow(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            now = [i]
            for j, y in enumerate(b, 1):
                now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
            row = now
        return row[-1]

    rng = random.Random(2)
    for _ in range(4000):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randint(0, 9))) for _ in range(2))
        assert lines.edits_within(a, b) == (slow(a, b) <= 2)
    pairs = [("".join(rng.choice("abä") for _ in range(rng.randint(0, 40))) for _ in range(2)) for _ in range(300)]
    pairs = [(a, b) for a, b in pairs]
    pairs += [(a[:9] + "xy" + a[11:], a[3:]) for a, _ in pairs] + [("", ""), ("", "abc"), ("abc", "")]
    want = np.array([slow(a, b) for a, b in pairs])
    for most in (0, 1, 2, 5, 15, 16, 31):
        got = lines.distances([lines.points(a) for a, _ in pairs], [lines.points(b) for _, b in pairs], most)
        assert (got[want <= most] == want[want <= most]).all() and (got[want > most] > most).all()
    bounds = np.array([rng.choice([1, 4, 9, 20, 40]) for _ in pairs])
    assert (lines.within([lines.points(a) for a, _ in pairs], [lines.points(b) for _, b in pairs], bounds) == (want <= bounds)).all()


def test_lines(spark):
    long = "a line of more than thirty characters, the first"
    rows = [(1, f"{long}\nshort\nshort", "a"), (2, f"{long}!\nanother line that is long enough to count here", "a"), (3, None, "a"), (4, long[:10] + "zzz" + long[10:], "a"), (None, long, "b")]
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept) for r in lines.dedup_lines(spark, docs(spark, rows)).collect()}
    assert got[1][1] == 0 and got[2][1] == 1 and got[3] == (1, 0, "") and got[4][1] == 0 and got[None] == (1, 1, "")


def test_mixing(spark, corpus):
    rows = mixing.mix(spark, docs(spark, corpus)).collect()
    assert len(rows) == len(corpus) and all(0 <= r.taken <= 2 * r.size for r in rows)
    again = mixing.mix(spark, docs(spark, corpus[::-1]).repartition(5)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    by = {(r.source_size, round(r.target, 6)) for r in rows}
    assert sum(t for _, t in by) == pytest.approx(1.5 * sum(s for s, _ in by))
    for s, t in by:
        own = [r for r in rows if r.source_size == s]
        assert abs(sum(r.taken for r in own) - t) <= max(r.size for r in own)


def test_quality(spark):
    good = " ".join(f"word{i} of the day" for i in range(30))
    rows = [(i, good + f" {i}", "a") for i in range(40)] + [(100, "### " * 30 + good, "a"), (101, None, "a"), (102, "a a a a a a a b c d e f g h", "a"), (103, "x y\nx y\n \nx y", "a")]
    got = {r.doc_id: r for r in quality.judge(spark, docs(spark, rows)).collect()}
    assert all(got[i].kept for i in range(40)) and not got[100].kept and not got[101].kept
    assert got[101].n_words == 0 and got[101].base_failed
    assert (got[102].n_words, got[102].n_repeat_words, got[102].word_chars) == (14, 7, 14)
    assert got[103].n_dup_lines == 2 and got[100].n_symbols == 90


def test_media(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "é" * 40, "a"), (4, "x" * 64, "a")]
    got = {r.doc_id: r for r in media.text_media(docs(spark, rows)).collect()}
    for i, t, _ in rows:
        raw = (t or "").encode()
        full = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
        assert got[i].media_sha256 == hashlib.sha256(media.to_wav(full)).hexdigest() and got[i].media_type == "audio/wav"
    inner = media.to_wav(b"abcd" * 16)
    assert media.sniff(b"junk BM RIFF" + inner + b"PK\x03\x04") == [("audio/wav", 12, len(inner))]


def test_html(spark):
    page = "<html><head><title>t</title></head><body><nav>menu</nav><article><h1>Head</h1><p>one &amp; <b>two<br><p>three\n four</p><div class='comments'>bad</div><p>Read our notice</p></article><footer>f</footer></body></html>"
    rows = [(i, f"http://h/{i}", page.replace("three", f"unlike every other page, number {i} of all")) for i in range(6)] + [(9, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.extract_main(df).collect()}
    assert got[2] == "one & two\nunlike every other page, number 2 of all four" or got[2].endswith("number 2 of all four")
    assert "notice" not in got[2] and "bad" not in got[2] and "menu" not in got[2] and got[9] == ""
    alone = {r.page_id: r.text for r in html.extract_main(df.limit(1)).collect()}
    assert alone[0] == "Head\none & two\nunlike every other page, number 0 of all four\nRead our notice"


def test_nets_without_labels(spark):
    df = docs(spark, [(1, None, "a"), (2, "123", "a")]).withColumn("lang", F.lit(None).cast("string"))
    got = nets.predict_language(spark, df, nets.train_language(df)).collect()
    assert {r.lang_pred for r in got} == {"und"}
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.predicted for r in nets.score_toxicity(spark, df, nets.train_toxicity(df, labels)).collect()] == [0, 0]


def test_windows_cover_texts():
    x, owner = nets.windows(np.arange(1, 601).astype(np.uint8), np.array([0, 0, 300, 600]))
    assert owner.tolist() == [1, 1, 2, 2] and x.shape == (4, nets.WINDOW)


def test_short_and_long_lines(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    base = [" ".join(word() for _ in range(n)) for n in (5, 9, 14, 20, 40, 90, 200) for _ in range(6)]
    texts = []
    for line in base:
        texts.append(line)
        for _ in range(4):
            x = list(line)
            for _ in range(rng.randint(1, lines.edits(len(line)) + 2)):
                k, what = rng.randrange(len(x)), rng.randrange(3)
                x[k : k + (what != 1)] = [] if what == 0 else ["z"]
            texts.append("".join(x))
    texts += ["All rights reserved.", "All rights reserved.", "  ", "  "]
    comp = list(range(len(texts)))
    near = [(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts[:i]) if a.split() and (a == b or min(len(a), len(b)) >= 30 and lines.edits_within(a, b, lines.edits(min(len(a), len(b)))))]
    for _ in texts:
        for i, j in near:
            comp[i] = comp[j] = min(comp[i], comp[j])
    got = {r.doc_id: r.n_removed for r in lines.dedup_lines(spark, docs(spark, [(i, t, "a") for i, t in enumerate(texts)]), short=True).collect()}
    assert got == {i: int(c != i) for i, c in enumerate(comp)}
    # one word replaced, five edits, in a line of some 270
    a = " ".join(f"word{i}" for i in range(40))
    b = a.replace("word7 ", "other ")
    assert [r.n_removed for r in lines.dedup_lines(spark, docs(spark, [(1, f"{a}\n{b}\nAll.\nAll.\n\n", "a")]), short=True).collect()] == [2]


def _texts(spark, pages):
    return {r.page_id: r.text for r in html.extract_main(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}


def test_html_templates_of_large_and_small_hosts(spark):
    box = "<div>Ask our staff</div>"
    # on 4 of 60 pages of a host; on 2 pages of another, in one's article and outside of both
    large = [(i, f"http://h/{i}", f"<body><p>text number {i} of all these texts</p>{box if i < 4 else ''}</body>") for i in range(60)]
    small = [(100 + i, f"http://s/{i}", f"<body>{box}<article><p>text number {i} of all these texts</p>{box if i else ''}</article></body>") for i in range(2)]
    got = _texts(spark, large + small)
    assert [got[i] for i in (0, 3, 59, 100, 101)] == [f"text number {i} of all these texts" for i in (0, 3, 59, 0, 1)]


def test_html_long_block_and_article_paragraphs(spark):
    box = "<div>" + "All the conditions of use of this site, longer than any of its texts. " * 3 + "</div>"
    pages = [(i, f"http://h/{i}", f"<body><p>text number {i}</p>{box}</body>") for i in range(5)]
    # a paragraph amid several articles stays, copies of one article keep all
    pages += [(10 + i, f"http://s/{i}", f"<body><article><p>start {i}</p><p>A saying.</p><p>end {i}</p></article></body>") for i in range(6)]
    pages += [(20 + i, f"http://c/{i}", "<body><article><p>one</p><p>two</p></article></body>") for i in range(6)]
    got = _texts(spark, pages)
    assert got[3] == "text number 3" and got[12] == "start 2\nA saying.\nend 2" and got[22] == "one\ntwo"


def test_toxicity_thresholds_by_language(spark):
    df = spark.createDataFrame([(1, "a b", "en"), (2, "a b", "de"), (3, "a b", None)], "doc_id long, text string, lang string")
    net = nets.WordNet()
    net.thresholds = {"en": 2.0, "de": -1.0}
    got = {r.doc_id: r for r in nets.score_toxicity(spark, df, net, lang="lang").collect()}
    assert (got[1].predicted_lang, got[2].predicted_lang) == (0, 1) and got[3].predicted_lang == got[3].predicted
    assert nets.score_toxicity(spark, df, net).columns == ["doc_id", "score", "predicted"]


def test_all_languages_are_learnt(spark, monkeypatch):
    shown = []
    monkeypatch.setattr(nets.ByteNet, "fit", lambda self, x, y: shown.append((x, y)) or self)
    df = spark.createDataFrame([(i, "abc de " * 200, f"l{i}") for i in range(300)], "doc_id long, text string, lang string")
    net = nets.train_language(df)
    assert len(net.labels) > 200 and len(shown[0][0]) == len(net.labels) * -(-1400 // nets.WINDOW)
