"""The pipeline's stages, each against brute force on its own input."""

import collections
import hashlib
import itertools
import re

import numpy as np
import pytest

import corpus_pipeline
from colometry.llm import lines, quality
from colometry.llm.queries import vocabulary_path

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
STAGES = dict(corpus_pipeline.STAGES)
COLUMNS = list(corpus_pipeline.COLUMNS)


@pytest.fixture(scope="module")
def chain(spark, tmp_path_factory):
    """Each stage's input and output, written and read again as the driver does."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        before = docs
        stage(spark, docs, DATA).write.parquet(path)
        docs = spark.read.parquet(path)
        out[name] = (before, docs)
    return out


def rows(df):
    return [tuple(r) for r in df.select(*COLUMNS).collect()]


def test_columns(chain):
    assert [x for x, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "jaccard_join", "mix_sources", "byte_bpe"]
    assert all(sorted(after.columns) == sorted(COLUMNS) for name, (_, after) in chain.items() if name != "byte_bpe")


def test_quality(spark, chain):
    before, after = chain["quality_rules"]
    kept = {r.doc_id for r in quality.judge(spark, before).where("kept").collect()}
    assert sorted(rows(after), key=str) == sorted((r for r in rows(before) if r[0] in kept), key=str)
    assert all(len(WORD.findall(r[1])) >= 10 for r in rows(after))


def test_lines(chain):
    before, after = chain["line_dedup"]
    docs = {r[0]: r for r in rows(before)}
    every = list(dict.fromkeys(x for i in sorted(docs) for x in docs[i][1].split("\n") if WORD.search(x)))
    comp = {x: k for k, x in enumerate(every)}
    top = list(range(len(every)))
    long = sorted((x for x in every if len(x) >= lines.MIN_CHARS), key=len)
    size = np.array([len(x) for x in long])
    counts = [collections.Counter(x) for x in long]

    def root(k):
        while top[k] != k:
            k = top[k]
        return k

    for a, x in enumerate(long):
        most = lines.edits(len(x))
        for b in range(a + 1, int(np.searchsorted(size, len(x) + most, "right"))):
            if sum((counts[a] - counts[b]).values()) <= most and lines.edits_within(x, long[b], most):
                p, q = sorted((root(comp[x]), root(comp[long[b]])))
                top[q] = p
    seen, want = set(), {}
    for i in sorted(docs):
        kept = []
        for x in docs[i][1].split("\n"):
            if not WORD.search(x):
                kept.append(x)
            elif root(comp[x]) not in seen:
                seen.add(root(comp[x]))
                kept.append(x)
        if WORD.search("\n".join(kept)):
            want[i] = "\n".join(kept)
    assert {r[0]: r[1] for r in rows(after)} == want
    assert all(r[4] == len(r[1]) and (r[2], r[3]) == docs[r[0]][2:4] for r in rows(after))


def test_jaccard(chain):
    before, after = chain["jaccard_join"]
    docs = {r[0]: r for r in rows(before)}
    sets = {}
    for i, r in docs.items():
        w = [x.lower() if x.isascii() else "".join(c.lower() if c.isascii() else c for c in x) for x in WORD.findall(r[1])]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}
    comp = {i: i for i in docs}
    for _ in docs:
        old = dict(comp)
        for i, j in itertools.combinations(sorted(docs), 2):
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                comp[i] = comp[j] = min(comp[i], comp[j])
        if comp == old:
            break
    assert sorted(rows(after), key=str) == sorted((docs[i] for i in docs if comp[i] == i), key=str)


def test_mix(spark, chain):
    before, after = chain["mix_sources"]
    docs = {r[0]: r for r in rows(before)}
    times = collections.Counter(r[0] for r in rows(after))
    assert all(docs[r[0]] == r for r in rows(after)) and max(times.values()) <= 2
    size = {i: len(WORD.findall(r[1])) for i, r in docs.items()}
    total, taken = collections.Counter(), collections.Counter()
    for i, r in docs.items():
        total[r[3]] += size[i]
        taken[r[3]] += times[i] * size[i]
    left, target = 1.5 * sum(total.values()), {}
    open_ = dict(zip(sorted((s for s in total if s is not None)) + [None] * (None in total), itertools.cycle((5, 2, 1)), strict=False))
    while open_:
        level = left / sum(open_.values())
        full = [s for s in open_ if open_[s] * level > 2 * total[s]]
        for s in full or list(open_):
            target[s] = 2.0 * total[s] if full else open_[s] * level
            left -= target[s]
            del open_[s]
    most = collections.defaultdict(int)
    for i, r in docs.items():
        most[r[3]] = max(most[r[3]], size[i])
    assert all(abs(taken[s] - target[s]) <= most[s] for s in total)


def test_bpe(chain):
    import base64

    import public_tokenizers
    import tiktoken

    with open(vocabulary_path(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f.read().splitlines() if x)}
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    before, after = chain["byte_bpe"]
    want = collections.Counter((r.doc_id, tuple(coder.encode_ordinary(r.text)), hashlib.sha256(r.text.encode()).hexdigest()) for r in before.collect())
    assert collections.Counter((r.doc_id, tuple(r.ids), r.decoded_sha256) for r in after.collect()) == want


def test_run_is_the_chain(spark, chain):
    want = collections.Counter((r.doc_id, r.ids_sha256) for r in chain["byte_bpe"][1].collect())
    assert collections.Counter((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, DATA).collect()) == want


@pytest.mark.parametrize("name", STAGES)
def test_odd_rows(spark, name):
    """Nulls, repeated rows, names that stages use themselves, and no rows at all."""
    good = " ".join(f"some{k} words{k} of text{k}" for k in range(30)) + "."
    data = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, good, "en", "a", 5), (2, good, "en", "a", 5), (None, good + " more", None, None, None), (3, "x\n\nx", "en", "b", 4)]
    df = spark.createDataFrame([(*r, 1, 2, "z") for r in data], "doc_id long, text string, lang string, source string, n_chars long, _row long, size long, kept string")
    out = STAGES[name](spark, df, DATA)
    got = out.collect()
    ids = [r.doc_id for r in got]
    if name == "byte_bpe":
        assert len(got) == len(data)
    else:
        assert sorted(out.columns) == sorted(COLUMNS)
        texts = [r.text for r in got]
        assert {"quality_rules": ids.count(2) == 2 and 1 not in ids and 3 not in ids, "line_dedup": ids.count(2) == 2 and 1 not in ids and "x\n" in texts, "jaccard_join": ids.count(2) == 1 and ids.count(1) == 1 and 3 in ids, "mix_sources": set(ids) <= {None, 2, 3} and 2 in ids}[name], (ids, texts)
    assert STAGES[name](spark, df.limit(0), DATA).count() == 0
