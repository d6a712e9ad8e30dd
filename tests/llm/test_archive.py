import base64
import gzip
import hashlib
import io
import random

import pytest

from lexiflow.llm.archive import Source, archive_round_trip, encode_record, plan_records, read_archives, salvage, write_archives
from lexiflow.session import fresh_path

SCHEMA = "page_id long, url string, html string, digest string, payload int"


def archive(n, plain=False, seed=0):
    draw, parts, offsets = random.Random(seed), [], [0]
    for i in range(n):
        body = bytes(draw.choices(b"abc <>\r\n", k=draw.randrange(3000))) + b"WARC/1.0\r\n\x1f\x8b\x08"
        record = encode_record(i, f"http://x/{i}", body, hashlib.sha1(body).hexdigest(), None)
        parts.append(record if plain else gzip.compress(record))
        offsets.append(offsets[-1] + len(parts[-1]))
    return b"".join(parts), offsets


def read(data, plain, splits=None):
    out = []
    for start in range(0, max(1, len(data)), splits or max(1, len(data))):
        end = start + splits if splits else None
        out += salvage(Source(io.BytesIO(data), len(data)), plain, start, end)
    return [r[2]["page_id"] for r in out if r[2]], [(a, b) for a, b, r, _ in out if r is None]


@pytest.mark.parametrize("plain", [False, True])
def test_whole_archive(plain):
    data, _ = archive(40, plain)
    assert read(data, plain) == (list(range(40)), [])
    for splits in (1, 97, 1000, 5000):
        assert read(data, plain, splits) == (list(range(40)), [])


@pytest.mark.parametrize("plain", [False, True])
def test_damage_costs_only_the_damaged_records(plain):
    draw = random.Random(1)
    for trial in range(30):
        data, offsets = archive(12, plain, trial)
        hit = sorted(draw.sample(range(12), 2))
        broken = bytearray(data)
        for k in hit:
            at = (offsets[k] + offsets[k + 1]) // 2
            broken[at : at + 8] = bytes(x ^ 0x55 for x in broken[at : at + 8])
        for splits in (None, 700):
            ids, gaps = read(bytes(broken), plain, splits)
            assert set(ids) >= set(range(12)) - set(hit) and ids == sorted(ids)
            lost = set(range(12)) - set(ids)
            assert sum(b - a for a, b in gaps) == sum(offsets[k + 1] - offsets[k] for k in lost)


def foreign(kind, block, **headers):
    lines = ["WARC/1.0", f"WARC-Type: {kind}", "WARC-Date: 2020-02-02T00:00:00Z", f"WARC-Record-ID: <urn:uuid:{kind}-{len(block)}>"]
    lines += [f"{k.replace('_', '-')}: {v}" for k, v in headers.items()] + [f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


HTTP = {"Content_Type": "application/http; msgtype=response", "WARC_Target_URI": "http://x/"}
BODY = b"<p>hello</p>\r\n\r\nmore"
ANSWER = b"HTTP/1.1 200 OK\r\nServer: s\r\n\r\n" + BODY
BASE32 = base64.b32encode(hashlib.sha1(BODY).digest()).decode()
CHUNKED = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n2\r\nab\r\n0\r\n\r\n"
FOREIGN = [
    (foreign("warcinfo", b"software: x\r\n", Content_Type="application/warc-fields"), b"software: x\r\n"),
    (foreign("response", ANSWER, WARC_Payload_Digest="sha1:" + BASE32, **HTTP), BODY),
    (foreign("response", ANSWER + b"!", **HTTP), BODY + b"!"),
    (foreign("response", ANSWER, WARC_Payload_Digest="sha-256:" + hashlib.sha256(BODY).hexdigest().upper(), **HTTP), BODY),
    (foreign("response", ANSWER, WARC_Payload_Digest="blake3:zz", **HTTP), BODY),
    (foreign("response", CHUNKED, WARC_Payload_Digest="sha1:" + "A" * 32, **HTTP), b"2\r\nab\r\n0\r\n\r\n"),
    (foreign("response", b"HTTP/1.1 200 OK", **HTTP), b"HTTP/1.1 200 OK"),
    (foreign("request", b"GET / HTTP/1.1\r\nHost: x\r\n\r\n", Content_Type="application/http; msgtype=request"), b""),
    (foreign("metadata", b"", WARC_Refers_To="<urn:uuid:response-1>"), b""),
    (foreign("revisit", b"", WARC_Payload_Digest="sha1:" + BASE32, WARC_Refers_To="<urn:uuid:response-1>"), None),
]


@pytest.mark.parametrize("plain", [False, True])
def test_records_of_other_writers(plain):
    parts = [r if plain else gzip.compress(r) for r, _ in FOREIGN]
    data = b"".join(parts)
    for splits in (None, 100):
        out = []
        for start in range(0, len(data), splits or len(data)):
            out += salvage(Source(io.BytesIO(data), len(data)), plain, start, start + splits if splits else None)
        assert [r["payload"] for _, _, r, _ in out] == [payload for _, payload in FOREIGN]
    records = [r for _, _, r, _ in out]
    assert [r["record_type"] for r in records][::3] == ["warcinfo", "response", "response", "revisit"]
    assert all(r["payload_digest"] == hashlib.sha1(r["payload"]).hexdigest() for r in records[:5])
    assert (records[9]["payload_digest"], records[9]["payload_bytes"]) == (hashlib.sha1(BODY).hexdigest(), None)
    assert {r["date"] for r in records} == {"2020-02-02T00:00:00Z"} and records[0]["record_id"] == "<urn:uuid:warcinfo-13>"
    assert {(r["page_id"], r["refers_to"]) for r in records} == {(None, None)}
    lost = bytearray(data)
    at = len(parts[0]) + len(parts[1]) - 12
    lost[at : at + 4] = b"\0\0\0\0"
    out = list(salvage(Source(io.BytesIO(bytes(lost)), len(data)), plain))
    assert [(a, b) for a, b, r, _ in out if r is None] == [(len(parts[0]), len(parts[0]) + len(parts[1]))] and len(out) == 10


def test_wrong_digests_and_lengths_are_gaps():
    wrong = foreign("resource", b"abc", WARC_Block_Digest="sha1:" + "0" * 40)
    long = foreign("resource", b"abc").replace(b"Content-Length: 3", b"Content-Length: 999999999999999999")
    kept = foreign("resource", b"abc", WARC_Block_Digest="md5:" + hashlib.md5(b"abc").hexdigest())
    data = wrong + kept + long + kept
    out = list(salvage(Source(io.BytesIO(data), len(data)), True))
    assert [(bool(r), reason) for _, _, r, reason in out] == [
        (False, "block digest differs"), (True, None), (False, "record does not end where its length says"), (True, None)
    ]


def test_missing_and_inserted_bytes():
    data, offsets = archive(10)
    cut = data[: offsets[3] + 20] + data[offsets[4] - 5 :]
    assert read(cut, False) == ([0, 1, 2, 4, 5, 6, 7, 8, 9], [(offsets[3], offsets[3] + 25)])
    assert read(b"junk" + data + b"tail", False) == (list(range(10)), [(0, 4), (4 + len(data), 8 + len(data))])
    assert read(data[:-3], False) == (list(range(9)), [(offsets[9], len(data) - 3)])
    assert read(b"", False) == ([], [])


def expected(rows):
    out, largest = [], {}
    for page_id, _, html, *_ in rows:
        body = (html or "").encode()
        if len(body) >= 1000 and page_id is not None:
            largest[body] = max(largest.get(body, page_id), page_id)
    for page_id, url, html, *_ in rows:
        body = (html or "").encode()
        top = largest.get(body)
        kind = "response" if top is None or top == page_id else "revisit"
        out.append((page_id, len(body), hashlib.sha1(body).hexdigest(), kind, top if kind == "revisit" else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    big, other = "é" * 600, "b" * 1000
    rows = [(i, f"http://h/{i}", big if i % 3 else other + str(i % 4), "d", 1) for i in range(60)]
    rows += [(100, None, None, None, None), (101, "http://ä b\r\n", "", "", 0), (None, "u", big, "", 0), (None, None, "x", "", 0)]
    rows += [(5, "http://h/5", big, "d", 1), (200, "u", "small", "", 0), (201, "u", "small", "", 0), (300, "u", "z" * 3_000_000, "", 0)]
    records, gaps = archive_round_trip(spark.createDataFrame(rows, SCHEMA))
    got = records.collect()
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r[c] for c in columns) for r in got), key=str) == expected(rows)
    assert all(hashlib.sha1(r.payload).hexdigest() == r.payload_digest for r in got if r.record_type == "response")
    assert gaps.count() == 0
    assert archive_round_trip(spark.createDataFrame([], SCHEMA))[0].count() == 0


def test_splits_and_damaged_files(spark):
    draw = random.Random(3)
    rows = [(i, f"http://h/{i}", "".join(draw.choices("abcdefgh <>", k=2000)), "", 0) for i in range(200)]
    folder = fresh_path(spark, "warc")
    manifest = write_archives(plan_records(spark.createDataFrame(rows, SCHEMA)).coalesce(2), folder, archive_bytes=60_000)
    assert manifest.count() > 2
    records, gaps = read_archives(manifest, folder, split_bytes=7000)
    assert sorted(r.page_id for r in records.collect()) == list(range(200)) and gaps.count() == 0
    path = manifest.first().path
    data = bytearray(open(path, "rb").read())
    data[5000:5100] = bytes(100)
    open(path, "wb").write(data)
    records, gaps = read_archives(manifest, folder, payloads=False, split_bytes=7000)
    assert 197 <= records.count() < 200 and gaps.count() == 1 and gaps.first().path == path
