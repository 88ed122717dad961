import base64
import glob
import gzip
import hashlib
import zlib


from listwatch.llm import warc

SCHEMA = "page_id long, url string, html string, sha string, size int, path string"


def fixture():
    rows = [(i, f"http://h/{i}", f"<p>page {i}</p>" * (i % 40)) for i in range(1, 120)]  # 40, 80: empty as well
    rows += [(200, None, "same é"), (150, "http://x/\r\nbad", "same é"), (300, "http://y", "same é"), (310, "u", None), (305, "u", ""),
             (320, "u", "x" * 300_000), (None, "u", "same é"), (None, "u", "only null"), (None, "v", "only null"), (400, "u", "twice"),
             (400, "u", "twice"), (401, "u", "a\r\n\r\nWARC/1.1\r\nb")]
    return rows


def make(spark, rows):
    return spark.createDataFrame([(i, u, h, "s", 1, "p") for i, u, h in rows], SCHEMA)


def digest(h):
    return base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()


def want(rows):
    least = {}
    for i, _, h in rows:
        if i is not None:
            least[h or ""] = min(i, least.get(h or "", i))
    out = []
    for i, _, h in rows:
        first = least.get(h or "")
        again = first is not None and i != first
        out.append((i, len((h or "").encode()), digest(h), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def test_round_trip_and_revisits(spark, scratch):
    rows = fixture()
    got = warc.round_trip(make(spark, rows).repartition(3), scratch)
    assert sorted(map(tuple, got.collect()), key=str) == want(rows)


def test_min_bytes(spark, scratch):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")]
    got = {r["page_id"]: r["record_type"] for r in warc.round_trip(make(spark, rows), scratch, min_bytes=4).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_monolithic_then_one_member_a_record(spark, scratch):
    rows = fixture()
    mono, new = scratch.path("m"), scratch.path("n")
    manifest = warc.write(make(spark, rows).coalesce(2), mono, scratch, roll_bytes=60_000)
    assert manifest.count() > 2 and sum(r["n_records"] for r in manifest.collect()) == len(rows)
    for name in (r["path"] for r in manifest.collect()):
        z = zlib.decompressobj(31)
        z.decompress(open(f"{mono}/{name}", "rb").read())
        assert z.eof and not z.unused_data  # one stream over the whole file
    index = warc.normalise(manifest, mono, new, scratch)
    entries = index.collect()
    assert len(entries) == len(rows)
    by_file = {}
    for e in entries:
        by_file.setdefault(e["path"], []).append(e)
    assert len(by_file) == manifest.count() == len(glob.glob(f"{new}/*.warc.gz"))
    for path, es in by_file.items():
        raw = open(f"{new}/{path}", "rb").read()
        es.sort(key=lambda e: e["offset"])
        assert es[0]["offset"] == 0 and sum(e["length"] for e in es) == len(raw)
        for e in es:
            record = gzip.decompress(raw[e["offset"]:e["offset"] + e["length"]])
            assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n") and e["record_type"].encode() in record
        lines = open(f"{new}/{path}.idx", "rb").read().decode().splitlines()
        assert [tuple(map(int, x.split("\t")[:2])) for x in lines] == [(e["offset"], e["length"]) for e in es]
    payloads = {r["page_id"]: bytes(r["payload"]) for r in warc.read(index, new).collect() if r["payload"] is not None and r["page_id"]}
    assert payloads["320"] == b"x" * 300_000 and payloads["401"] == b"a\r\n\r\nWARC/1.1\r\nb"


def test_cut_off_archives_are_errors(tmp_path):
    raw = warc.record(1, "u", b"payload", None) * 3
    assert len(list(warc.records(warc.inflated(__import__("io").BytesIO(gzip.compress(raw)))))) == 3
    for broken in (gzip.compress(raw)[:-12], gzip.compress(raw[:-20])):
        try:
            list(warc.records(warc.inflated(__import__("io").BytesIO(broken))))
        except (ValueError, EOFError):
            continue
        raise AssertionError("a cut-off archive was read without an error")


def test_empty_table(spark, scratch):
    assert warc.round_trip(make(spark, []), scratch).collect() == []
