import hashlib

import pytest
import zstandard

from tallywood.llm import warc as W
from tallywood.llm.binary_files import read_files


def test_round_trip_with_copies_nulls_and_small_bundles(spark, tmp_path):
    big = "<p>" + "word é " * 40 + "</p>"
    rows = [(9, "http://a/ b\n", big, 1), (4, "http://b", big, 1), (7, None, big, 1), (1, "u", "tiny", 1), (2, "u", "tiny", 1), (3, "v", None, 1), (None, "w", big, 1), (None, "w", "x" * 200, 1), (4, "http://b", big, 1), (5, "z", "\r\n\r\n" * 80_000, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    path = f"file://{tmp_path}/out"
    W.write_warc(pages, path, frame_bytes=900, bundle_bytes=400)
    got = W.read_warc(spark, path).collect()
    want = []
    for i, _, h, _ in rows:
        p = (h or "").encode()
        first = 4 if h == big and i != 4 else None
        want.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if first else "response", first, None if first else p))
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got), key=key) == sorted(want, key=key)
    some = W.read_warc(spark, path, ids=[5, 2]).collect()
    assert sorted(r.page_id for r in some) == [2, 5]
    assert W.round_trip(pages.limit(0)).count() == 0


def test_a_bundle_is_a_plain_zstandard_file(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"<p>{i}</p>" * 50) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    path = f"file://{tmp_path}/out"
    W.write_warc(pages, path, frame_bytes=2_000)
    content = bytes(read_files(spark, path).first().content)
    assert len(W.Bundle(content).frames) > 3
    whole = b"".join(W.Bundle(content).records())
    seen, rest = b"", content
    while rest:
        d = zstandard.ZstdDecompressor().decompressobj()
        if rest[:4] in (b"\x5d\x2a\x4d\x18", b"\x5e\x2a\x4d\x18"):
            rest = rest[8 + int.from_bytes(rest[4:8], "little") :]
            continue
        seen += d.decompress(rest)
        rest = d.unused_data
    assert seen == whole and whole.count(b"WARC/1.1\r\n") == 40
    with pytest.raises(ValueError):
        W.Bundle(content[:-1])


def test_rows_without_id_have_names_of_their_own(spark, tmp_path):
    pages = spark.range(40).selectExpr("CAST(NULL AS LONG) AS page_id", "'u' AS url", "concat('page ', id % 3) AS html").repartition(5)
    path = f"file://{tmp_path}/out"
    W.write_warc(pages, path)
    names = [name for f in read_files(spark, path).collect() for name, *_ in W.Bundle(bytes(f.content)).index]
    assert len(names) == len(set(names)) == 40
