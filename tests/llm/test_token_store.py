import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from tallywood.llm import token_store as S
from tallywood.llm.binary_files import read_files

PATH = P.path("byte_bpe_50k.json")


def test_coder_round_trip_and_checkpoints():
    r = np.random.default_rng(4)
    for n in (0, 1, 2047, 2048, 2049, 50_000):
        ids = (r.zipf(1.3, n) % 60_000).astype(np.int32)
        table = S.Table.of_counts(np.bincount(ids, minlength=1))
        assert n == 0 or table.freq.sum() == 1 << S.SCALE
        reads, states, words = S.encode_ids(ids, table, 4)
        got = [S.decode_ids(n, table, states[k], np.frombuffer(words, "<u4"), reads[k], 4 * k, 4 * k + 4) for k in range(len(reads))]
        assert np.array_equal(np.concatenate([*got, []]).astype(np.int32), ids)
        if n == 50_000:
            counts = np.bincount(ids)
            p = counts[counts > 0] / n
            assert len(words) * 8 < 1.02 * n * -(p * np.log2(p)).sum()


def test_uniform_and_single_symbol_tables():
    for counts in (np.ones(50_000, np.int64), np.array([0, 0, 9]), np.array([10**9, *[1] * 40_000])):
        t = S.Table.of_counts(counts)
        assert t.freq.sum() == 1 << S.SCALE and ((t.freq > 0) == (counts > 0)).all()


def test_added_tokens_are_the_librarys():
    lib = Tokenizer.from_file(PATH)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y. <|endoftext", "plain words, no token. At all!", " <|endoftext|> ", "<|endof text|>"]
    got = S.token_ids(texts, PATH)
    assert [np.frombuffer(g, "<u2").tolist() for g in got] == [lib.encode(t, add_special_tokens=False).ids for t in texts]
    assert 50256 in np.frombuffer(got[0], "<u2")


def test_files_hold_the_librarys_ids(spark, tmp_path):
    texts = ["The the.", "", None, "  two  blanks\n\nand 'll <|endoftext|> é漢", "x" * 30_000, "a b\nc", " lead", "tail ", "one two " * 3_000]
    rows = [(i * 7 % 9 - 3, t, "k") for i, t in enumerate(texts)] + [(None, "no id", "k"), (50, "twice", "k"), (50, "twice", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    lib = Tokenizer.from_file(PATH)
    path = f"file://{tmp_path}/out"
    S.write_tokens(df, path, PATH, block_tokens=500, checkpoint_steps=2, blocks_per_file=2)
    got = sorted(S.read_tokens(spark, path).collect(), key=lambda r: r.start)
    rows.sort(key=lambda r: -100 if r[0] is None else r[0])
    start = 0
    for r, (i, t, _) in zip(got, rows, strict=True):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        assert (r.doc_id, r.start, r.n_tokens) == (i, start, len(ids))
        assert bytes(r.ids) == np.array(ids, "<u4").tobytes()
        start += len(ids)
    files = read_files(spark, path + "/ids").collect()
    assert len(files) > 1
    blocks = list(S.unpack(bytes(files[0].content)))
    assert 1 <= len(blocks) <= 2
    broken = bytearray(files[0].content)
    broken[-30] ^= 1
    with pytest.raises(ValueError):
        list(S.unpack(bytes(broken)))
    assert zlib.crc32(b"") == 0 and S.round_trip(df.limit(0), PATH).count() == 0


def test_files_ascend_on_disk(spark, tmp_path):
    """Parts of uneven size: over files by name, and within each, blocks follow one another without a gap."""
    df = spark.range(0, 900).selectExpr("id AS doc_id", "repeat('one two three ', CASE WHEN id < 30 THEN 400 ELSE CAST(id % 7 AS INT) END) AS text").repartition(11)
    path = f"file://{tmp_path}/out"
    S.write_tokens(df, path, PATH, block_tokens=700, blocks_per_file=3)
    at, last, files = 0, -1, sorted(read_files(spark, path + "/ids").collect(), key=lambda r: r.path)
    assert len(files) > 8
    for f in files:
        for header, sections in S.unpack(bytes(f.content)):
            ids = np.frombuffer(sections["ids"], "<i8")
            assert header["start"] == at and ids[0] > last and (np.diff(ids) > 0).all()
            at, last = at + header["n"], ids[-1]
    assert last == 899


def test_words_are_asked_for_many_at_a_time(monkeypatch):
    class Counting:
        asked = 0

        def encode_batch_fast(self, texts, **options):
            self.asked += len(texts)
            return lib.encode_batch_fast(texts, **options)

    lib, counting, found = Tokenizer.from_file(PATH), Counting(), S.tokenizer(PATH)
    monkeypatch.setattr(S, "tokenizer", lambda path: (counting, found[1], {}, *found[3:]))
    texts = [" ".join(f"w{i}q{i * j}." for i in range(300)) for j in range(1, 5)] + ["a\nb c\r\nd é\n e", " 's 't\t", "", "\n", "x \n y"]
    got = S.token_ids(texts, PATH)
    assert [np.frombuffer(g, "<u2").tolist() for g in got] == [lib.encode(t, add_special_tokens=False).ids for t in texts]
    assert counting.asked < 60


def test_letters_are_asked_of_the_model_and_pieces_are_told_by_lines(monkeypatch):
    class Counting:
        asked = ""

        def encode_batch_fast(self, texts, **options):
            self.asked += "|".join(texts)
            return lib.encode_batch_fast(texts, **options)

    lib, counting, found = Tokenizer.from_file(PATH), Counting(), S.tokenizer(PATH)
    monkeypatch.setattr(S, "tokenizer", lambda path: (counting, found[1], {}, *found[3:]))
    plain = ["x " + " ".join(f"Word{a}{b} {b}{a}end.\nNext{a}{b}, \u00e9t\u00e9{a}\u00df%%%" for a in "abcdefgh" for b in "stuvw\u00e0\u0101")]
    odd = ["a b\n\n\nc d\n\ne f\n\tg\t\nh i\r\nj", "x don't we'll\nI'd it's.\n's \n\n k\n", "y \u4e2d\u6587\na \u00aa\u00ba\u0370b.\u2026 a\u00a0\nb c\u0301.\nd 1a2. 3.5!!\n4 a_b_ _ __. .\n. \"q\".\n", "z \n a", "k <|endoftext|>\nq r.\n<|endoftext|>", "l a.b.\nc.d\ne b\u2028\nc \n\nb", "m w\n\n \nv A\n?B \u0130\u0131\u01c5.\n\u024f\u0250 \u00d7\u00f7a\n\u00d7"]
    late = ["x the\nend the.\nNext", "x \nend y", " \nNext  the"]  # a piece that equals a later line of one known by then
    for texts in (plain, odd, plain + odd, late, late):
        got = S.token_ids(texts, PATH)
        assert [np.frombuffer(g, "<u2").tolist() for g in got] == [lib.encode(t, add_special_tokens=False).ids for t in texts]
        if texts is plain:
            assert "end" not in counting.asked and "Next" not in counting.asked
