"""WARC: a deterministic sharded writer, and a reader.

Records are sorted by page_id and payload digest, and the exact running sum of their payload bytes in that order gives
the shards, so the same table gives the same files under any partitioning; a page_id of very many records is parted
like any other range. Each shard is one task (its number is the partition's), and its files roll by compressed size. Headers and digests
are made anew from the payload. Every file is written under a temporary name; the manifest, committed by Spark, names
the files of the attempts that succeeded; these are then renamed (which may be repeated) and the final manifest is
written. Readers go by the manifest, so leftovers of lost tasks are never read.

Of records with equal payloads of at least min_bytes bytes, the one with the smallest page_id is a response, the others
are revisits of it.

Edge cases: a null payload is empty; a null url gives the target urn:x-page:ID; a null page_id is always a response and
sorts first; rows that repeat a page_id with the same payload are all responses if the id is the smallest; an empty
table gives no files and no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.window import Window

from skyframe.llm.common import scratch, small_batches, table, with_long, written

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GROUP_ROWS = 100_000  # rows whose running sum is one task's
MANIFEST = "shard long, seq long, temp string, file string, bytes long, records long, first_id string, last_id string, sha1 string"
RECORDS = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string"


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def digest_of(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _gz(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _head(fields: list[tuple[str, str]], length: int) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields), f"Content-Length: {length}", "", ""]
    return "\r\n".join(lines).encode()


def _name(page_id: str | None, digest: str) -> str:
    return f"<urn:x-page:{page_id or ''}:{digest}>"


def record(page_id: str | None, url: str | None, payload: bytes, refers_to: str | None = None, date: str = DATE) -> bytes:
    """One gzip member: a response, or a revisit if refers_to is given."""
    digest = digest_of(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    target = url.replace("\r", "%0D").replace("\n", "%0A") if url else f"urn:x-page:{page_id or ''}"
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _name(page_id, digest)), ("WARC-Date", date), ("WARC-Target-URI", target)]
    block = http + payload if refers_to is None else http
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _name(refers_to, digest))]
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{digest_of(block)}"), ("Content-Type", "application/http; msgtype=response")]
    return _gz(_head(fields, len(block)) + block + b"\r\n\r\n")


def _info(name: str, date: str) -> bytes:
    body = f"software: skyframe\r\nformat: WARC File Format 1.1\r\nisPartOf: {name}\r\n".encode()
    fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:x-file:{name}>"), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")]
    return _gz(_head(fields, len(body)) + body + b"\r\n\r\n")


def shard_bounds(rows: DataFrame, shard_bytes: int, group_rows: int = GROUP_ROWS) -> list[tuple[int, int]]:
    """First keys (page_id, sub) of all shards but the first, from rows (page_id, sub, n): a shard ends where the running
    sum of n passes a multiple of shard_bytes. Rows of equal keys stay together. What reaches the driver is a row for
    each group of group_rows rows and one for each shard."""
    key = ["page_id", "sub"]
    groups = max(1, -(-rows.count() // group_rows))
    if groups > 1:
        rows = written(rows.repartitionByRange(groups, *key).withColumn("part", F.spark_partition_id()), "ordered")
    else:
        rows = rows.withColumn("part", F.lit(0))
    sums = {r[0]: r[1] for r in rows.groupBy("part").agg(F.sum("n")).collect()}
    parts = sorted(sums)
    before = dict(zip(parts, np.cumsum([0, *[sums[p] for p in parts]]).tolist(), strict=False))
    if not parts:
        return []
    base = F.get(F.lit([int(before.get(p, 0)) for p in range(parts[-1] + 1)]), F.col("part"))
    each = rows.groupBy("part", *key).agg(F.sum("n").alias("n"))
    run = base + F.sum("n").over(Window.partitionBy("part").orderBy(*key)) - F.col("n")
    firsts = each.withColumn("shard", F.floor(run / F.lit(shard_bytes))).groupBy("shard").agg(F.min(F.struct(*key)).alias("k"))
    return [(r["k"][0], r["k"][1]) for r in firsts.orderBy("shard").collect()[1:]]


def write_warc(pages: DataFrame, out: str, *, min_bytes: int = 0, shard_bytes: int = 64 << 20, roll_bytes: int = 16 << 20, date: str = DATE) -> DataFrame:
    """Writes pages (page_id, url, html) below out and returns the final manifest."""
    spark = pages.sparkSession
    small_batches(spark)
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    sha = F.sha1(body.cast("binary"))
    sub = F.conv(F.substring("sha", 1, 15), 16, 10).cast("long")
    page_id = F.col("page_id").cast("long")
    light = written(pages.select(page_id.alias("page_id"), sha.alias("sha"), F.octet_length(body).alias("n")), "digests")
    known = light.filter(F.col("n") >= min_bytes)
    first = known.groupBy("sha").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("k")).filter("k > 1").drop("k")
    marks = known.join(first, "sha").filter("page_id > refers_to").select("page_id", "sha", "refers_to").distinct()
    bounds = shard_bounds(light.select(F.coalesce("page_id", F.lit(-(2**63))).alias("page_id"), sub.alias("sub"), (F.col("n") + 400).alias("n")), shard_bytes)
    shards = len(bounds) + 1

    first_ids, first_subs = (np.array([k[j] for k in bounds], np.int64) for j in (0, 1))  # 16 bytes for each shard, sent once

    @F.pandas_udf("int")
    def shard_of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for ids, subs in batches:
            x, y = ids.to_numpy(np.int64), subs.to_numpy(np.int64)
            low, high = np.searchsorted(first_ids, x, side="left"), np.searchsorted(first_ids, x, side="right")
            for k in np.flatnonzero(high - low):  # bounds within this id
                high[k] = low[k] + np.searchsorted(first_subs[low[k] : high[k]], y[k], side="right")
            yield pd.Series(high.astype(np.int32))

    # a mark reaches the writer just before the page that it is for: one shuffle of the payloads, and no join with them
    null = F.lit(None).cast("string")
    both = marks.select("page_id", null.alias("url"), null.alias("html"), "sha", "refers_to", F.lit(0).alias("kind"))
    rows = pages.select(page_id.alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("html"), sha.alias("sha"), F.lit(None).cast("long").alias("refers_to"), F.lit(1).alias("kind"))
    both = both.unionByName(rows)
    both = both.withColumn("shard", shard_of(F.coalesce("page_id", F.lit(-(2**63))), sub)).repartitionById(shards, "shard").sortWithinPartitions("shard", "page_id", "sha", "kind", "url")
    both = both.withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})

    def write(batches):
        fs, root = _fs(out)
        attempt = uuid.uuid4().hex
        shard = seq = stream = mark = None
        row = None

        def close():
            stream.close()
            return pd.DataFrame([row | {"sha1": sha.hexdigest()}])

        for pdf in batches:
            for page_id, url, html, digest, refers, kind, at in pdf[["page_id", "url", "html", "sha", "refers_to", "kind", "shard"]].itertuples(index=False, name=None):
                if kind == 0:
                    mark = (page_id, digest, refers)
                    continue
                data = record(page_id, url, html.encode(), mark[2] if mark and mark[:2] == (page_id, digest) else None, date)
                if stream is not None and (at != shard or row["bytes"] + len(data) > roll_bytes):
                    yield close()
                    stream = None
                if stream is None:
                    seq = seq + 1 if at == shard else 0
                    shard = at
                    name = f"shard-{shard:06d}-{seq:05d}.warc.gz"
                    temp = f"_temporary/{name}.{attempt}"
                    fs.create_dir(f"{root}/_temporary", recursive=True)
                    stream, sha = fs.open_output_stream(f"{root}/{temp}", compression=None), hashlib.sha1()
                    row = {"shard": shard, "seq": seq, "temp": temp, "file": name, "bytes": 0, "records": 0, "first_id": page_id, "last_id": page_id}
                    head = _info(name, date)
                    stream.write(head)
                    sha.update(head)
                    row["bytes"] += len(head)
                stream.write(data)
                sha.update(data)
                row["bytes"] += len(data)
                row["records"] += 1
                row["last_id"] = page_id
        if stream is not None:
            yield close()

    both.mapInPandas(write, MANIFEST).write.parquet(f"{out}/_attempts")
    files = spark.read.parquet(f"{out}/_attempts")
    n = max(1, min(256, files.count()))

    def rename(batches):
        from pyarrow.fs import FileType

        fs, root = _fs(out)
        for pdf in batches:
            for temp, name in zip(pdf["temp"], pdf["file"], strict=True):
                if fs.get_file_info(f"{root}/{temp}").type == FileType.File:
                    fs.move(f"{root}/{temp}", f"{root}/{name}")
                elif fs.get_file_info(f"{root}/{name}").type != FileType.File:
                    raise FileNotFoundError(f"{root}/{temp}")
            yield pdf

    files.repartition(n).mapInPandas(rename, MANIFEST).drop("temp").write.parquet(f"{out}/manifest")
    fs, root = _fs(out)
    for d in ("_temporary", "_attempts"):
        if fs.get_file_info(f"{root}/{d}").type.name == "Directory":
            fs.delete_dir(f"{root}/{d}")
    return with_long(spark.read.parquet(f"{out}/manifest"), "first_id", "last_id")


def members(stream, chunk: int = 1 << 20, step: int = 1 << 14):
    """The gzip members of a stream, one at a time. What follows a member in the data given to zlib is copied, so it gets
    `step` bytes at once."""
    z, parts, begun = zlib.decompressobj(31), [], False
    while data := stream.read(chunk):
        view, at = memoryview(data), 0
        while at < len(view):
            piece = view[at : at + step]
            parts.append(z.decompress(piece))
            at += len(piece) - len(z.unused_data)
            begun = True
            if z.eof:
                yield b"".join(parts)
                z, parts, begun = zlib.decompressobj(31), [], False
    if begun:
        raise EOFError("the last member is cut off")


def parse(member: bytes) -> dict | None:
    """A response or revisit record with its digests verified; None for other kinds."""
    head, _, rest = member.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0][:40]}")
    f = dict(x.split(": ", 1) for x in lines[1:])
    if f["WARC-Type"] not in ("response", "revisit"):
        return None
    block = rest[: int(f["Content-Length"])]
    if len(block) != int(f["Content-Length"]) or rest[len(block) :] != b"\r\n\r\n" or f["WARC-Block-Digest"] != f"sha1:{digest_of(block)}":
        raise ValueError(f"damaged record {f['WARC-Record-ID']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    digest, name = f["WARC-Payload-Digest"].removeprefix("sha1:"), f["WARC-Record-ID"].split(":")[2]
    full = f["WARC-Type"] == "response"
    if full and digest != digest_of(payload):
        raise ValueError(f"damaged payload {f['WARC-Record-ID']}")
    n = len(payload) if full else int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    url = f["WARC-Target-URI"]
    return {"page_id": name or None, "url": None if url.startswith("urn:x-page:") else url, "payload_bytes": n, "payload_digest": digest, "record_type": f["WARC-Type"], "refers_to": f["WARC-Refers-To"].split(":")[2] if "WARC-Refers-To" in f else None, "payload": payload if full else None}


def read_warc(manifest: DataFrame, out: str) -> DataFrame:
    """A row for each response or revisit record of the manifest's files, read as streams and verified."""

    def read(batches):
        fs, root = _fs(out)
        for pdf in batches:
            for name in pdf["file"]:
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    rows = []
                    for m in members(stream):
                        if r := parse(m):
                            del r["payload"]
                            rows.append(r)
                        if len(rows) >= 5000:
                            yield pd.DataFrame(rows)
                            rows = []
                    if rows:
                        yield pd.DataFrame(rows)

    n = max(1, min(10_000, manifest.count()))
    return with_long(manifest.select("file").repartition(n).mapInPandas(read, RECORDS), "page_id", "refers_to")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark, "warc")
    manifest = write_warc(table(spark, sf_dir, "pages"), out)
    return read_warc(manifest, out).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op9_warc": op9_warc}

ORACLE = {
    "op9_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first_id FROM p GROUP BY h),
b AS (SELECT h, CAST(unhex(h) AS BIT)::VARCHAR AS bits, first_id FROM f),
d AS (SELECT h, first_id, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  1 + CAST(16 * CAST(substr(bits, CAST(5 * i + 1 AS INT), 1) AS INT) + 8 * CAST(substr(bits, CAST(5 * i + 2 AS INT), 1) AS INT)
  + 4 * CAST(substr(bits, CAST(5 * i + 3 AS INT), 1) AS INT) + 2 * CAST(substr(bits, CAST(5 * i + 4 AS INT), 1) AS INT)
  + CAST(substr(bits, CAST(5 * i + 5 AS INT), 1) AS INT) AS INT), 1)), '') AS digest FROM b)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM p JOIN d USING (h)
""",
}
