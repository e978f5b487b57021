import random

from tallywood.llm.line_dedup import line_dedup

WS = " \t\n\x0b\x0c\r"


def brute(docs, need):
    """Positions to delete by looking at every run of lines of every document."""
    import re

    seqs = []
    for d, t in sorted(docs):
        rows = [(i, x.strip(WS), len(re.findall(r"[^\x20\x09-\x0D]+", x))) for i, x in enumerate(t.split("\n"))]
        seqs.append((d, [r for r in rows if r[2]]))
    seen, gone = set(), {}
    for d, rows in seqs:
        for a in range(len(rows)):
            here = []
            for b in range(a, len(rows)):
                run = tuple(r[1] for r in rows[a : b + 1])
                if sum(r[2] for r in rows[a : b + 1]) >= need:
                    if run in seen:
                        gone.setdefault(d, set()).update(r[0] for r in rows[a : b + 1])
                    here.append(run)
            seen.update(here)
    return gone


def test_equals_brute_force_on_random_documents(spark):
    r = random.Random(3)
    pool = ["a b c", "d", "e f", "  g h i j ", "", "   ", "k l", "a b c d e f g h", "x"]
    docs = [(d, "\n".join(r.choice(pool) for _ in range(r.randint(0, 14)))) for d in range(60)]
    gone = brute(docs, 6)
    assert gone
    out = {x.doc_id: x for x in line_dedup(spark.createDataFrame(docs, "doc_id long, text string"), min_words=6).collect()}
    for d, t in docs:
        lines = t.split("\n")
        want = "\n".join(x for i, x in enumerate(lines) if i not in gone.get(d, ()))
        assert (out[d].text, out[d].n_lines, out[d].n_deleted) == (want, len(lines), len(gone.get(d, ())))


def test_a_line_of_every_document_with_other_neighbours(spark):
    r = random.Random(5)
    docs = [(d, "\n".join([f"n{r.randint(0, 40)} m", "to all of us", f"p{r.randint(0, 6)} q"])) for d in range(200)]
    gone = brute(docs, 5)
    assert gone
    out = {x.doc_id: x.n_deleted for x in line_dedup(spark.createDataFrame(docs, "doc_id long, text string"), min_words=5).collect()}
    assert out == {d: len(gone.get(d, ())) for d, _ in docs}


def test_nulls_repeats_clashing_names_and_no_rows(spark):
    long = "one two three\nfour five six"
    rows = [(1, long, "a"), (1, long, "a"), (2, long, "b"), (3, None, "c"), (None, "q " + long, None), (4, "", "d"), (5, long + "\n" + long, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, N_lines string")
    got = line_dedup(df, min_words=6)
    assert got.columns == ["doc_id", "text", "n_lines", "n_deleted"]
    seen = sorted((str(x.doc_id), x.text, x.n_deleted) for x in got.collect())
    assert seen == sorted([("1", long, 0), ("1", long, 0), ("2", "", 2), ("3", None, 0), ("None", "q " + long, 0), ("4", "", 0), ("5", "", 4)])
    assert line_dedup(df.limit(0)).count() == 0


def test_a_long_text(spark):
    body = "\n".join(f"line {i} of a very long text" for i in range(4_000))
    df = spark.createDataFrame([(1, body), (2, body + "\nthe end")], "doc_id long, text string")
    got = {x.doc_id: x for x in line_dedup(df).collect()}
    assert got[1].n_deleted == 0 and got[2].text == "the end"
