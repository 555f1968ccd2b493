import base64
import hashlib
from collections import Counter

from skyframe.llm import warc
from skyframe.llm.common import scratch

PAGES = [(1, "http://a/1", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "http://a/3", None), (4, "http://a/\r\n4", ""), (5, "u", "é" * 5000), (6, "u", "b\r\n\r\nc"), (7, "u", "<p>x</p>"), (None, "u", "<p>x</p>"), (7, "u", "other")]
SCHEMA = "page_id long, url string, html string, sha string, kind string"


def brute(pages):
    first = {}
    for i, _, h in pages:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, _, h in pages:
        b = (h or "").encode()
        back = None if i is None or first[h or ""] == i else first[h or ""]
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if back is None else "revisit", back))
    return sorted(out, key=str)


def test_round_trip_and_rolling(spark):
    df = spark.createDataFrame([(*p, "s", "k") for p in PAGES], SCHEMA)
    files = []
    for n in (1, 3):
        out = scratch(spark, "t")
        m = warc.write_warc(df.repartition(n), out, shard_bytes=4000, roll_bytes=700)
        got = sorted((tuple(r) for r in warc.read_warc(m, out).drop("url").collect()), key=str)
        assert got == brute(PAGES)
        files.append(sorted((r["file"], r["bytes"], r["sha1"]) for r in m.collect()))
    assert files[0] == files[1] and len(files[0]) > 2  # the same files under any partitioning


def test_full_payloads_read_back(spark):
    from pyarrow import fs

    out = scratch(spark, "t")
    m = warc.write_warc(spark.createDataFrame(PAGES[:6], "page_id long, url string, html string"), out)
    at, root = fs.FileSystem.from_uri(out)
    got = {}
    for r in m.collect():
        with at.open_input_stream(f"{root}/{r['file']}", compression=None) as s:
            got |= {x["page_id"]: (x["payload"], x["url"]) for x in map(warc.parse, warc.members(s)) if x}
    assert got["5"][0] == ("é" * 5000).encode() and got["6"][0] == b"b\r\n\r\nc" and got["4"][0] is None and got["3"][0] == b"" and got["2"][1] is None


def test_shards_hold_their_size(spark):
    """Dense ids, one id of very many records, and ids far apart: no shard passes the limit by more than one record."""
    rows = spark.range(20_000).selectExpr("case when id % 3 = 0 then 7 when id % 3 = 1 then id else id * 1000000007 end page_id", "crc32(cast(id as string)) sub", "1000L n")
    for group_rows in (3000, 10**6):
        bounds = warc.shard_bounds(rows.repartition(5), 50_000, group_rows)
        assert len(bounds) == 399 and bounds == sorted(bounds)
    import bisect

    keys = sorted((r[0], r[1]) for r in rows.collect())
    sizes = Counter(bisect.bisect_right(bounds, k) for k in keys)
    assert set(sizes.values()) == {50}


def test_each_shard_is_a_task(spark):
    df = spark.range(300).selectExpr("id page_id", "'u' url", "concat(id, repeat('x', 600)) html")
    m = warc.write_warc(df, scratch(spark, "t"), shard_bytes=10_000)
    assert m.groupBy("shard").count().count() == m.count() == 30


def test_large_ids_beside_nulls(spark):
    big = 2**60 + 1
    df = spark.createDataFrame([(big, "u", "a"), (None, "u", "b"), (big + 2, "u", "a")], "page_id long, url string, html string").coalesce(1)
    out = scratch(spark, "t")
    got = {r["page_id"]: r["refers_to"] for r in warc.read_warc(warc.write_warc(df, out), out).collect()}
    assert got == {big: None, None: None, big + 2: big}


def test_empty(spark):
    out = scratch(spark, "t")
    assert warc.read_warc(warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), out), out).count() == 0


def test_many_small_members_are_read_in_linear_time():
    """Members of some bytes, those that end with a slice, and one of many slices; a cut member is an error."""
    import io
    import os
    import time

    import pytest

    small = [bytes([k % 251]) * (k % 7 + 1) for k in range(60_000)]
    large = os.urandom(3_000_000)
    blob = b"".join(warc._gz(b) for b in small) + warc._gz(large)
    began = time.perf_counter()
    got = list(warc.members(io.BytesIO(blob)))
    assert got[:-1] == small and got[-1] == large and time.perf_counter() - began < 20
    for step in (1, 2, 3, 64):
        assert list(warc.members(io.BytesIO(blob[:2000][: len(b"".join(warc._gz(b) for b in small[:40]))]), chunk=50, step=step)) == small[:40]
    with pytest.raises(EOFError):
        list(warc.members(io.BytesIO(blob[:-5])))
