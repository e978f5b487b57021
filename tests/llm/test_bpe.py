import base64
import random

import public_tokenizers as P
import pytest
import tiktoken

from tallywood.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    r = random.Random(7)
    pool = list("abcdeftheing  \n\t'sé漢字🙂01 .,!-\x1c\x85᠎​ ñ") + ["the", "ing", "'ll", "<|endoftext|>"]
    made = ["".join(r.choice(pool) for _ in range(r.randint(0, 60))) for _ in range(600)]
    return [*made, "", " ", "  ", "a ", " a", "a\n b", "x" * 20_000, "ab" * 9_000 + " " + "é" * 5_000, "a" + " " * 3_000 + "b"]


def test_ids_equal_those_of_the_reference_library(reference):
    c = bpe.codec(PATH, P.PATTERN)
    texts = odd_texts()
    for t, packed in zip(texts, c.encode_all(texts), strict=True):
        ids = bpe.np.frombuffer(packed, bpe.np.int32)
        assert c.encode(t) == packed
        assert ids.tolist() == reference.encode_ordinary(t), repr(t[:80])
        assert bpe.decoded(ids, bpe.vocabulary(PATH)) == t.encode()
        assert not c.queue.top


def test_queue_gives_the_lowest_rank_first():
    q = bpe.RankQueue(300_000)
    for rank, at in ((70_000, 4), (5, 9), (5, 2), (299_999, 1), (64, 3)):
        q.push(rank, at)
    got = []
    while (r := q.first()) >= 0:
        got.append((r, q.take(r)))
    assert got == [(5, [9, 2]), (64, [3]), (70_000, [4]), (299_999, [1])]


def test_ranks_in_any_order(tmp_path):
    """Ranks that no training gives, where merges make pairs of lower rank."""
    import itertools

    r = random.Random(11)
    for seed in range(12):
        longer = [bytes(x) for n in (2, 3, 4) for x in itertools.product(b"ab", repeat=n)]
        r.shuffle(longer)
        tokens = [bytes([i]) for i in range(256)] + longer[: r.randint(4, 20)]
        path = tmp_path / f"{seed}.tiktoken"
        path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens)))
        c = bpe.Codec(str(path), P.PATTERN)
        ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
        words = ["".join(r.choice("aabb") for _ in range(r.randint(1, 30))) for _ in range(60)]
        for w, got in zip(words, c.merge_all([w.encode() for w in words]), strict=True):
            want = ref.encode_ordinary(w)
            assert c.merge(w.encode()) == want and (w.encode() in c.ranks or bpe.np.frombuffer(got, bpe.np.int32).tolist() == want)


def test_frames_with_nulls_clashing_names_and_no_rows(spark, reference):
    rows = [(1, None, "x"), (2, "", "y"), (3, "The the.\n\nÉa", "z"), (3, "The the.\n\nÉa", "z"), (None, " a", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, Token_IDs string")
    back = bpe.bpe_decode(bpe.bpe_encode(df, PATH, P.PATTERN), PATH)
    assert back.columns == ["doc_id", "text", "token_ids", "decoded"]
    got = back.collect()
    assert len(got) == 5
    for r in got:
        assert r.token_ids == reference.encode_ordinary(r.text or "")
        assert bytes(r.decoded).decode() == (r.text or "")
    assert bpe.bpe_encode(df.limit(0), PATH, P.PATTERN).count() == 0


def test_round_trip_is_one_python_step(spark):
    import public_tokenizers
    from tallywood.llm import bpe

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    df = spark.createDataFrame([(0, "one two  three\n"), (1, None), (2, "é ß 漢"), (3, "")], "doc_id long, text string")
    both = bpe.bpe_round_trip(df, path, public_tokenizers.PATTERN)
    assert both._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    apart = bpe.bpe_decode(bpe.bpe_encode(df, path, public_tokenizers.PATTERN), path)
    assert sorted(map(tuple, both.collect()), key=lambda r: r[0]) == sorted(map(tuple, apart.collect()), key=lambda r: r[0])
    assert [bytes(r.decoded).decode() for r in both.orderBy("doc_id").collect()] == ["one two  three\n", "", "é ß 漢", ""]
