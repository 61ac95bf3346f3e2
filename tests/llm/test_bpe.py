import base64
import random

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

from colometry.llm import bpe  # noqa: E402
from colometry.llm.common import flat  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def own():
    with open(PATH, "rb") as f:
        return bpe.Coder(f.read())


@pytest.fixture(scope="module")
def theirs():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(3)
    parts = ["'s", "'re", "'ll", "'l", "'", "''", " ", "  ", "\n", "\t ", "　", "a", "Zs", "été", "12", "½", "#", "!?", "漢字", "한국", "\U0001f600", "'d's", "\x1c", "\x85", "é", "t", "ve", "-" * 70, "ab" * 60]
    yield from ["", " ", "\n", "'", "'s", " 's", "it's", "a  b", "a \n b ", "   ", "'t's", "x" * 500]
    for _ in range(3000):
        yield "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))


def test_as_the_public_library(own, theirs):
    all_texts = list(texts())
    cut, _, bounds = bpe.slices(*flat(pa.array(all_texts)))
    for text, a, b in zip(all_texts, bounds[:-1], bounds[1:], strict=True):
        assert "".join(cut[a:b]) == text
        ids = b"".join(own[x] for x in cut[a:b])
        assert np.frombuffer(ids, "<u4").tolist() == theirs.encode_ordinary(text), repr(text)
        assert own.decode(ids).decode() == text


def test_a_full_cache_starts_anew(own, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 700)
    one = [own[x] for x in ("aa", "bb", "cc", "dd", "ee", "aa")]
    assert one[0] == one[-1]


def test_query_form(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 6), (3, "it's  a\ntest", 7), (3, "it's  a\ntest", 7), (None, "x", 8)], "doc_id long, text string, n_tokens int")
    got = bpe.encode_texts(spark, df, PATH).orderBy("doc_id", "n_tokens").collect()
    assert [r.doc_id for r in got] == [None, 1, 2, 3, 3]
    assert got[1].ids == [] and got[1].decoded == "" and got[1].n_tokens == 0
    assert got[3] == got[4] and got[3].decoded == "it's  a\ntest" and got[3].offsets[0] == 0 and len(got[3].offsets) == 6
    assert bpe.encode_texts(spark, df.limit(0), PATH).count() == 0
