import corpus_pipeline as C
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from tallywood.llm import bpe, decontaminate, simhash
from tallywood.llm.common import staged
from tests.llm.test_line_dedup import brute
from tests.llm.test_shingles import classes, plain

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, f in C.STAGES:
        docs = staged(f(spark, docs, SF), name)
        out.append(docs)
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_equal_brute_force(spark, steps):
    names = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert all(s.columns == names for s in steps[:-1])
    a, b, c, d, e = map(rows, steps)
    gone = brute([(i, r.text) for i, r in a.items()], 50)
    want = {i: "\n".join(x for k, x in enumerate(r.text.split("\n")) if k not in gone.get(i, ())) for i, r in a.items()}
    assert {i: r.text for i, r in b.items()} == {i: t for i, t in want.items() if i not in gone or t.split()}
    assert all(r.n_chars == len(r.text) for r in b.values())
    ids = sorted(b)
    cls = classes([plain(b[i].text) for i in ids])
    assert set(c) == {ids[k] for k in set(cls)}
    tests = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    parts = [decontaminate.parts(t) for _, t in tests]
    dirty = set()
    for i, r in c.items():
        held = " " + " ".join(decontaminate.words(r.text)) + " "
        share = lambda w: sum(f" {' '.join(x)} " in held for x in decontaminate.runs(w)) / max(1, len(decontaminate.runs(w)))  # noqa: B023, E731
        if any(all(not w or share(w) >= 0.6 for w in both) for both in parts):
            dirty.add(i)
    assert set(d) == set(c) - dirty and set(e) == set(d)
    codec = bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for i, r in e.items():
        assert r.round_trip and r.n_tokens == len(r.token_ids) == len(codec.encode(d[i].text)) // 4


def test_language_stage_rejects_what_is_in_none_of_the_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = ["deadbeef0123456789abcdef0011223344556677" * 4, "QmFzZTY0IGVuY29kZWQgc3RyaW5nIG9mIHNvbWUga2luZA==" * 3, "Все люди рождаются свободными и равными в своем достоинстве и правах", "人人生而自由在尊嚴和權利上一律平等他們賦有理性和良心"]
    rows = spark.createDataFrame([(90_000 + i, t, None, "s", len(t)) for i, t in enumerate(odd)], docs.schema)
    kept = {r.doc_id for r in C.language_id(spark, docs.unionAll(rows), SF).collect()}
    assert not kept & set(range(90_000, 90_004)) and len(kept) >= 0.99 * docs.count()


def test_clashing_names_repeats_and_long_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    long = " ".join(f"und die in der {i}" for i in range(60_000))
    some = [(1, "the and of this that in to be", "en", "s", 28), (1, "the and of this that in to be", "en", "s", 28), (2, long, "de", "s", len(long)), (3, None, None, None, None), (None, "the and of this that in", "en", "s", 20)]
    df = docs.unionAll(spark.createDataFrame([(90_000 + (r[0] or 0) if r[0] else None, *r[1:]) for r in some], docs.schema))
    for c in ("id", "n", "row", "gone", "hash", "component_id", "__id", "leak"):
        df = df.withColumn(c, F.lit("mine"))
    for name, f in C.STAGES[:-1]:
        df = staged(f(spark, df, SF), name)
        assert df.columns[-8:] == ["id", "n", "row", "gone", "hash", "component_id", "__id", "leak"], name
    rows = df.filter("doc_id > 90000 or doc_id is null").collect()
    assert sorted(str(r.doc_id) for r in rows) == ["90001", "90002", "None"] and all(r["__id"] == r.leak == r.row == "mine" for r in rows)
    assert [len(r.text) for r in rows if r.doc_id == 90_002] == [len(long)]


def test_language_stage_keeps_prose_and_drops_what_has_no_letter(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(90_001, "12 34 !!", "en", "s", 8), (90_002, None, None, None, None), (90_003, "", "fr", "s", 0)], docs.schema)
    kept = {r.doc_id for r in C.language_id(spark, docs.unionAll(odd), SF).collect()}
    assert kept <= {r.doc_id for r in docs.collect()} and len(kept) >= 0.99 * docs.count()


def test_language_stage_keeps_prose_whatever_the_number_of_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    alike = [(i, "the words of this text stand in every language", f"l{i % 8}", "s", 46) for i in range(80)]
    assert C.language_id(spark, spark.createDataFrame(alike, docs.schema), SF).count() == 80


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, f in C.STAGES:
        docs = f(spark, docs, SF)
    assert docs.count() == 0 and simhash.simhash_components(spark.read.parquet(f"{SF}/documents.parquet")).count() == 200
