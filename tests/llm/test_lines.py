"""op10's CPU seconds: what verifying, line finding and grouping may cost, with the same results."""

import itertools
import random

import numpy as np
import pyarrow as pa

from colometry.llm import lines


def test_verifying_takes_steps_by_edits_not_by_code_points(monkeypatch):
    rng = random.Random(1)
    pairs = []
    for n in [800] * 60 + [9000] * 4:
        a = [rng.choice("abcdefgh é漢") for _ in range(n)]
        b = list(a)
        for _ in range(rng.randint(0, 2 * lines.edits(n))):
            at, kind = rng.randrange(len(b)), rng.randrange(3)
            b[at : at + (kind != 0)] = [] if kind == 1 else [rng.choice("xyz")]
        pairs.append((lines.points("".join(a)), lines.points("".join(b))))
    most = np.array([lines.edits(min(len(a), len(b))) for a, b in pairs])
    want = [lines.edits_within(*(z.tobytes().decode("utf-32-le") for z in pair), int(k)) for pair, k in zip(pairs, most, strict=True)]
    got = lines.within([a for a, _ in pairs], [b for _, b in pairs], most)
    assert got.tolist() == want and 0 < got.sum() < len(got)
    steps, packbits = [], np.packbits
    monkeypatch.setattr(np, "packbits", lambda *a, **k: (steps.append(1), packbits(*a, **k))[1])
    lines.within([a for a, _ in pairs[:60]], [b for _, b in pairs[:60]], most[:60])
    # 800 columns before
    assert 0 < len(steps) < 300


def test_lines_of_odd_texts():
    """Lines with a word, and lines of MIN_CHARS code points, with their places, and the bytes by which buckets are made."""
    texts = ["", None, "\n", "\n\n", " \n\t\nx\n", " " * 40 + "\n" + " " * 29 + "\n" + "é" * 30 + "\n" + "é" * 29 + "\n漢", "", "a" * 30, "\n" + "😀" * 31, "z\n", " \x0b\x0c\r y", "\x1c" * 31 + "\n ", " \n"]
    for picked in (texts, texts[:2], texts[2:3], texts[-1:]):
        batch = pa.RecordBatch.from_pydict({"r": pa.array(range(len(picked)), pa.int64()), "k": pa.array(range(len(picked)), pa.int64()), "text": pa.array(picked, pa.string())})
        for short in (True, False):
            got = [row for b in lines._lines(short)(iter([batch])) for row in b.to_pylist()]
            for text, row in zip(picked, got, strict=True):
                own = (text or "").split("\n")
                kept = [(k, x) for k, x in enumerate(own) if len(x) >= lines.MIN_CHARS or short and x.strip(" \t\x0b\x0c\r")]
                assert row["places"] == [k for k, _ in kept], (text, short)
                assert row["lines"] == [lines.line_hashes(x.encode(), np.array([0]), np.array([len(x.encode())])).item() for _, x in kept]
                assert row["size"] == len((text or "").encode())


def test_large_groups_are_cut_before_their_rows_meet(spark, monkeypatch):
    """No window gathers a key's rows, groups larger than a block give the same classes, and nothing needs a broadcast."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(6))
    phrase = " ".join(word() for _ in range(12))
    docs = []
    for i in range(30):
        x = phrase + " " + " ".join(word() for _ in range(6))
        docs += [x, x[:9] + "Z" + x[10:]] if i % 3 == 0 else [x]
    base = " ".join(word() for _ in range(20))
    docs += [base[:k] + "Q" + base[k + 1 :] for k in range(0, 60, 3)]
    comp = list(range(len(docs)))
    for i, j in itertools.combinations(range(len(docs)), 2):
        if lines.edits_within(docs[i], docs[j], lines.edits(min(len(docs[i]), len(docs[j])))):
            a, b = sorted((comp[i], comp[j]))
            comp = [a if c == b else c for c in comp]
    plans, stash = [], lines.stash

    def planned(session, df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stash(session, df)

    monkeypatch.setattr(lines, "stash", planned)
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    for block, broadcast in ((4, lines.BROADCAST), (4, 0)):
        monkeypatch.setattr(lines, "BLOCK", block)
        monkeypatch.setattr(lines, "BROADCAST", broadcast)
        got = {r.doc_id: r.n_removed for r in lines.dedup_lines(spark, df).collect()}
        assert got == {i: int(c != i) for i, c in enumerate(comp)}, (block, broadcast)
    assert sum(got.values()) == 10 + 19
    assert not any("Window" in p for p in plans)
