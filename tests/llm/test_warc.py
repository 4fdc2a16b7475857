import base64
import gzip
import glob
import hashlib
from collections import Counter, defaultdict

from cobaltmill.llm import warc
from cobaltmill.session import fresh_path

PAGES = "page_id long, url string, html string, title string, payload string"
ROWS = [
    (1, "http://a.example/1", "<p>same</p>"), (7, "http://a.example/7", "<p>same</p>"),
    (3, "http://a.example/3", "<p>same</p>"), (4, None, "other"), (5, "http://b.example/?x=1\r\nX: y", None),
    (6, "", ""), (None, "http://a.example/n", "<p>same</p>"), (8, "u8", "a\r\n\r\nb\r\n\r\n"), (9, "u9", "\r\n"),
    (10, "u10", "\r\n\r\n"), (11, "u11", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"), (12, "u12", "é日\U0001f600\x00"),
    (13, "u13", "twice"), (13, "u13", "twice"), (14, "u14", "end\r"), (15, "u15", "x" * 300000 + "\r\n\r"),
    (None, None, "null only"), (None, None, "null only"),
]


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def frame(spark, rows=ROWS, parts=3):
    full = [(p, u, h, "t", "clash") for p, u, h in rows]
    return spark.createDataFrame(full, PAGES).repartition(parts) if rows else spark.createDataFrame([], PAGES)


def expected(rows, least):
    groups = defaultdict(list)
    for p, _, h in rows:
        groups[h or ""].append(p)
    out = []
    for html, ids in groups.items():
        size = len(html.encode())
        top = max((i for i in ids if i is not None), default=None)
        first = True
        for i in ids:
            again = size >= least and not (i == top and first)
            if i == top and not again:
                first = False
            out.append((i, size, digest(html), "revisit" if again else "response", top if again else None))
    return Counter(out)


def round_trip(spark, rows, least=0):
    path = fresh_path(spark, "test-archive")
    warc.write_archive(frame(spark, rows), path, least)
    return path, warc.resolve(warc.read_archive(spark, path)).collect()


def test_revisits(spark):
    for least in (0, 12):
        _, rows = round_trip(spark, ROWS, least)
        found = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])
                        for r in rows)
        assert found == expected(ROWS, least)
        for r in rows:
            if r["record_type"] == "response":
                assert r["intact"] and digest(r["payload"]) == r["payload_digest"]
            else:
                assert r["payload"] is None and r["refers_to_record"]


def test_urls_come_back(spark):
    _, rows = round_trip(spark, ROWS)
    urls = {r["page_id"]: r["url"] for r in rows if r["page_id"]}
    assert urls[4] is None and urls[5] == "http://b.example/?x=1%0D%0AX: y" and urls[7] == "http://a.example/7"


def test_files_are_valid_records(spark):
    """An independent reader finds the records by their lengths."""
    path, rows = round_trip(spark, ROWS)
    seen, ids = 0, []
    for name in glob.glob(f"{path.removeprefix('file://')}/part-*.gz"):
        data = gzip.open(name).read()
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            assert head.startswith(b"WARC/1.1\r\n") and fields["WARC-Date"].endswith("Z")
            n = int(fields["Content-Length"])
            assert rest[n:n + 4] == b"\r\n\r\n"
            ids.append(fields["WARC-Record-ID"])
            data, seen = rest[n + 4:], seen + 1
    assert seen == len(ROWS) == len(rows) and len(set(ids)) == seen


def test_hot_payload(spark):
    rows = [(i, f"u{i}", "the same" if i % 3 else f"own {i}") for i in range(3000)]
    _, found = round_trip(spark, rows)
    kinds = Counter(r["record_type"] for r in found)
    assert kinds == {"response": 1001, "revisit": 1999}
    assert {r["refers_to"] for r in found if r["record_type"] == "revisit"} == {2999}


def test_empty(spark):
    assert round_trip(spark, [])[1] == []
