import hashlib

from foliant.llm import warc

LONG = "<p>WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n" + "é" * 60


def want(rows):
    heads = {}
    for p, _, h in rows:
        if len((h or "").encode()) >= 100 and p is not None:
            heads[h] = min(p, heads.get(h, p))
    used, out = set(), []
    for p, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (h or "").encode()
        digest = hashlib.sha256(data).hexdigest()
        if h in heads and (p != heads[h] or h in used):
            out.append((p, len(data), digest, "revisit", heads[h]))
        else:
            out.append((p, len(data), digest, "response", None))
            used.add(h)
    return out


def captures(spark, rows, path, **options):
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, ordinal long")
    warc.write_warc(pages.repartition(3), path, **options)
    return warc.assemble_captures(warc.read_warc(spark, path))


def test_round_trip(spark, tmp_path):
    rows = [(5, "http://a/", LONG), (3, "http://b/", LONG), (9, None, LONG), (1, "http://c/\r\nx: y", "short"), (2, "u", "short"), (4, "u", None), (6, "", ""), (None, "n", LONG), (3, "http://b/", LONG), (8, "big", "z" * 200_000)]
    for name, options in (("one", {}), ("many", {"segment_bytes": 300})):
        got = captures(spark, rows, f"{tmp_path}/{name}", **options).collect()
        key = lambda r: (r[0] is None, r[0] or 0, r[3])
        found = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got]
        assert sorted(found, key=key) == sorted(want(rows), key=key)
        payload = {r.page_id: bytes(r.response.payload) for r in got if r.record_type == "response"}
        assert payload[3] == LONG.encode() and payload[4] == b""
        assert all(r.request.record_id and r.metadata.record_id for r in got)
        assert {r.target_uri for r in got if r.page_id in (1, 4, 6, 9)} == {"http://c/x:y", "u", None}


def test_empty(spark, tmp_path):
    assert captures(spark, [], f"{tmp_path}/none").collect() == []
