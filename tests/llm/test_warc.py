import base64
import hashlib

import pytest

from lodestone.llm.warc import assemble, parse_archive, read_warc, write_warc
from lodestone.plans.scratch import Scratch

TRICKY = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n\r\n"
ROWS = [(3, "http://a/x y", "same"), (1, None, "same"), (1, None, "same"), (None, "http://n", "same"), (4, "u\r\nInjected: 1", TRICKY),
        (5, "http://e", None), (6, "http://e", ""), (7, "http://ü", "größer 😀\n"), (8, "http://l", "long " * 100000), (None, None, None)]


def _write(spark, rows, **settings):
    path = f"{Scratch(spark, 'warc').path}/a"
    write_warc(spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string"),
               path, **settings)
    return path


def _digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_round_trip(spark):
    path = _write(spark, ROWS, archive_bytes=1000)
    captures = assemble(read_warc(spark, path)).collect()
    assert len(captures) == len(ROWS)
    got = []
    for c in captures:
        r = c["response"]
        assert [x["record_type"] for x in c["requests"]] == ["request"] and [x["record_type"] for x in c["metadata"]] == ["metadata"]
        assert c["requests"][0]["concurrent_to"] == [c["capture_id"]] and c["others"] == []
        first, page = r["headers"].get("x-refers-to-page-id"), r["headers"].get("x-page-id")
        assert (r["payload"] is None) == (r["record_type"] == "revisit")
        if r["payload"] is not None:
            assert len(r["payload"]) == r["payload_bytes"]
        got.append((page, r["payload_bytes"], r["payload_digest"], r["record_type"], first))
    want = []
    for page, _, html in ROWS:
        low = min((p for p, _, h in ROWS if (h or "") == (html or "") and p is not None), default=None)
        again = page != low
        want.append((None if page is None else str(page), len((html or "").encode()), _digest(html),
                     "revisit" if again else "response", str(low) if again else None))
    assert sorted(got, key=str) == sorted(want, key=str)
    uris = {c["response"]["target_uri"] for c in captures}
    assert {"http://a/x%20y", "u%20%20Injected:%201", "http://ü", None} <= uris


def test_small_payloads_are_never_revisits(spark):
    path = _write(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], least_bytes=3)
    kinds = {r["headers"]["x-page-id"]: r["record_type"] for r in read_warc(spark, path).collect() if r["record_type"] != "request"
             and r["record_type"] != "metadata"}
    assert kinds == {"1": "response", "2": "response", "3": "response", "4": "revisit"}


def test_empty_table_and_broken_archive(spark):
    assert assemble(read_warc(spark, _write(spark, []))).count() == 0
    with pytest.raises(ValueError):
        list(parse_archive(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 99\r\n\r\nshort"))
    with pytest.raises(ValueError):
        list(parse_archive(b"noise\r\n\r\n"))


def test_links_in_either_direction_and_orphans(spark):
    columns = "record_id string, record_type string, concurrent_to array<string>"
    records = spark.createDataFrame([
        ("r1", "response", []), ("q1", "request", ["r1"]), ("r2", "revisit", ["q2"]), ("q2", "request", []),
        ("q3", "request", ["gone"]), ("q4", "request", []), ("c1", "conversion", ["r1"]), (None, "request", ["r1"]),
        ("m1", "metadata", ["r1"]), ("m2", "metadata", ["r1"]), ("q5", "request", ["r2"])], columns)
    got = {c["capture_id"]: (c["response"] and c["response"]["record_id"],
                             *[[x["record_id"] for x in c[k]] for k in ("requests", "metadata", "others")])
           for c in assemble(records).collect()}
    assert got == {"r1": ("r1", ["q1"], ["m1", "m2"], ["c1"]), "r2": ("r2", ["q2", "q5"], [], []),
                   "gone": (None, ["q3"], [], []), "q4": (None, ["q4"], [], [])}
