import base64
import gzip
import hashlib
import random

import pytest

from tablediff.llm import warc
from tablediff.llm.common import new_folder

SCHEMA = "page_id long, url string, html string, size long, path string, at int, record_type string"


def pages(spark):
    body = "<p>é" + "x" * 1500 + "</p>"
    inner = warc.record(77, "http://inner", b"y" * 3000, "0" * 40, None, False).decode()
    rows = [(i, f"http://h/{i} ü", f"<p>{i}</p>" * (i * 40), 1, "p", 2, "t") for i in range(30)]
    rows += [(100 + i, "http://same", body, 1, "p", 2, "t") for i in range(6)]
    rows += [(200, "http://trap", inner * 3, 1, "p", 2, "t"), (201, "http://trap", "WARC/1.1\r\nContent-Length: 5\r\n\r\n" * 50 + "x" * 999, 1, "p", 2, "t")]
    rows += [(300, None, None, None, None, None, None), (301, "", "", 1, "p", 2, "t"), (None, "http://none", body, 1, "p", 2, "t")]
    rows += [(400, "u", "short", 1, "p", 2, "t"), (401, "u", "short", 1, "p", 2, "t"), (105, "http://same", body, 1, "p", 2, "t")]
    return spark.createDataFrame(rows, SCHEMA)


def expected(rows):
    rows = [(r.page_id, (r.html or "").encode()) for r in rows]
    out = []
    for i, p in rows:
        last = max((j for j, q in rows if q == p and j is not None), default=None)
        again = len(p) >= 1000 and i != last
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", last if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize(("block", "compressed"), [(700, False), (300, True), (8 << 20, False), (8 << 20, True)])
def test_round_trip(spark, block, compressed):
    df = pages(spark)
    files = warc.write_warc(df, new_folder(spark, "warc"), pages_per_file=20, compressed=compressed)
    got = warc.read_warc(files, block_bytes=block).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected(df.collect())
    html = {r.page_id: r.html or "" for r in df.collect()}
    assert all(bytes(r.payload).decode() == html[r.page_id] for r in got if r.record_type == "response")
    assert {r.url for r in got if r.page_id == 3} == {"http://h/3%20%C3%BC"}


def test_members_inside_a_member(spark, tmp_path):
    trap = warc.member(warc.record(9, "http://trap", b"t" * 99, "0" * 40, None, False), level=0)
    rows = [(1, b"a" * 3000), (2, trap * 40), (3, b"c" * 10)]
    data = b"".join(warc.member(warc.record(i, None, p, hashlib.sha1(p).hexdigest(), None, False), level=0) for i, p in rows)
    path = tmp_path / "x.warc.gz"
    path.write_bytes(data)
    assert data.count(warc.GZIP) == 43 == data.count(warc.ANY_GZIP)
    files = spark.createDataFrame([(str(path), len(data))], "path string, size long")
    for block in (200, 1000, 1 << 20):
        assert sorted((r.page_id, bytes(r.payload)) for r in warc.read_warc(files, block).collect()) == rows


def foreign(kind, block, **fields):
    """A record as other programs write it."""
    lines = {"WARC-Type": kind, "WARC-Record-ID": "<urn:uuid:00000000-0000-0000-0000-000000000001>", "Content-Length": len(block)} | fields
    return b"WARC/1.0\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in lines.items()) + b"\r\n" + block + b"\r\n\r\n"


@pytest.mark.parametrize("compressed", [True, False])
def test_archives_of_other_writers(spark, tmp_path, compressed):
    """Members without lengths, version 1.0, records of other types, digests in base 32, and false beginnings in payloads."""
    rnd = random.Random(3)
    trap = gzip.compress(foreign("response", b"HTTP/1.1 200 OK\r\n\r\nno"))
    bodies = [b"x" * 10, bytes(rnd.randrange(256) for _ in range(70_000)), trap * 3 + warc.ANY_GZIP * 20 + b"WARC/1.0\r\nContent-Length: 2\r\n\r\n", b""]
    http = lambda b: b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + b
    records = [foreign("warcinfo", b"software: other\r\n", **{"Content-Type": "application/warc-fields"})]
    for i, b in enumerate(bodies):
        digest = base64.b32encode(hashlib.sha1(b).digest()).decode()
        records.append(foreign("request", b"GET / HTTP/1.1\r\n\r\n", **{"Content-Type": "application/http; msgtype=request"}))
        records.append(foreign("response", http(b), **{"WARC-Target-URI": f"http://h/{i}", "WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "application/http; msgtype=response"}))
    data = b"".join(gzip.compress(r, rnd.choice([0, 9])) if compressed else r for r in records)
    path = tmp_path / ("y.warc.gz" if compressed else "y.warc")
    path.write_bytes(data)
    files = spark.createDataFrame([(str(path), len(data))], "path string, size long")
    for block in (1000, 1 << 20):
        got = warc.read_warc(files, block).collect()
        assert sorted(r.record_type for r in got) == ["request"] * 4 + ["response"] * 4 + ["warcinfo"]
        found = {r.url: r for r in got if r.record_type == "response"}
        assert [bytes(found[f"http://h/{i}"].payload) for i in range(4)] == bodies
        assert [found[f"http://h/{i}"].payload_digest for i in range(4)] == [hashlib.sha1(b).hexdigest() for b in bodies]
        assert all(r.page_id is None for r in got)
    cut = tmp_path / f"z{path.suffixes[0]}{'.gz' if compressed else ''}"
    cut.write_bytes(data[:-9])
    with pytest.raises(ValueError, match="no record leads on"):
        warc.read_warc(spark.createDataFrame([(str(cut), len(data) - 9)], "path string, size long"), 1000)


def test_empty(spark):
    assert warc.archived(spark.createDataFrame([], SCHEMA)).count() == 0
