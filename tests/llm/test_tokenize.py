import os
import random

import pytest
import tiktoken

from lodeweave.llm import tokenize as tk

pytestmark = pytest.mark.skipif(not os.path.exists(tk.vocabulary_path()), reason="no public vocabulary here")


@pytest.fixture(scope="module")
def both():
    ranks = tk.parse_ranks(open(tk.vocabulary_path(), "rb").read())
    return tk.Encoder(ranks), tiktoken.Encoding("own", pat_str=tk.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = ["", " ", "Hello, world!", "don't  stop\n\n\tnow", "naïve café ½ ② ｗｉｄｅ", "🙂👍🏽", "<|endoftext|> is text", "x" * 5000, "ab" * 3000, "日本語のテキスト", "a​b c", "123456 7.89e10", "\x00\x01"]


@pytest.mark.parametrize("text", TEXTS)
def test_same_as_library(both, text):
    ours, theirs = both
    ids = ours.encode(text)
    assert ids == theirs.encode_ordinary(text)
    assert theirs.decode(ids) == text


def test_random_runs(both):
    rng = random.Random(4)
    for _ in range(200):
        text = "".join(rng.choice("aabcdeth éß") for _ in range(rng.randrange(200))).replace(" ", "")
        assert both[0].encode(text) == both[1].encode_ordinary(text)


def test_rank_queue_gives_ranks_in_order():
    q, rng = tk.RankQueue(300_000), random.Random(1)
    pushed = [(rng.randrange(300_000), i) for i in range(2000)]
    for r, p in pushed:
        q.push(r, p)
    out = []
    while (x := q.pop()) is not None:
        out += [(x[0], p) for p in x[1]]
    assert sorted(out) == sorted(pushed) and [r for r, _ in out] == sorted(r for r, _ in out)


def test_columns(spark, both):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "Hello, world!", "c")], "doc_id long, text string, ids string")
    got = {r[0]: (r[1], r[2]) for r in df.select("doc_id", tk.token_ids(spark, "text"), tk.token_count(spark, "text")).collect()}
    want = both[1].encode_ordinary("Hello, world!")
    assert got == {1: ([], 0), 2: ([], 0), 3: (want, len(want))}
    assert df.limit(0).select(tk.token_ids(spark, "text")).count() == 0


def test_large_vocabulary_is_refused(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tk, "MAX_VOCABULARY_BYTES", 4)
    path = tmp_path / "v.tiktoken"
    path.write_bytes(b"YQ== 0\n")
    with pytest.raises(ValueError):
        tk.token_ids(spark, "text", str(path))
