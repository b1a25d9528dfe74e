import hashlib

from corpusloom.llm import warc

BIG = "<p>é</p>" * 40
PAGES = [(4, "http://a/4", BIG), (2, "http://a/2", BIG), (9, "http://a/9", BIG), (5, "http://a/5", "small"), (6, "http://a/6", "small"), (7, None, None), (8, "u\r\nX: y", ""), (10, "http://a/10", BIG + "!"), (10, "http://a/10", BIG + "!"), (10, "http://b/10", BIG + "!"), (None, "http://n", BIG), (None, "http://only-null", "z" * 200), (11, "http://a/11", "x" * 99), (12, "http://a/12", "x" * 99), (13, "q", "y" * 100), (14, "q", "y" * 100)]


def brute():
    out, used = [], set()
    ids = {}
    for p, _, h in PAGES:
        ids.setdefault(h or "", []).append(p)
    for p, u, h in sorted(PAGES, key=lambda x: (x[0] is None, x[0] or 0, x[1] or "")):
        b = (h or "").encode()
        least = min((x for x in ids[h or ""] if x is not None), default=None)
        response = len(b) < 100 or (p == least and (h or "") not in used)
        if p == least:
            used.add(h or "")
        out.append((p, len(b), hashlib.sha256(b).hexdigest(), "response" if response else "revisit", None if response else least))
    return sorted(map(str, out))


def make(spark, tmp_path, rows=PAGES):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, n int")
    warc.write_archive(df, str(tmp_path / "w"))
    return warc.read_archive(spark, str(tmp_path / "w"))


def test_like_brute_force(spark, tmp_path):
    got = warc.summary(make(spark, tmp_path)).collect()
    assert sorted(str((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])) for r in got) == brute()
    stored = spark.read.parquet(str(tmp_path / "w/payloads")).collect()
    assert sorted(bytes(r["payload"]) for r in stored) == sorted({(h or "").encode() for _, _, h in PAGES})


def test_records_are_whole(spark, tmp_path):
    records = make(spark, tmp_path).collect()
    assert len({r["record_id"] for r in records}) == len(PAGES)
    for r in records:
        head, _, block = bytes(r["record"]).partition(b"\r\n\r\n")
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        assert block[-4:] == b"\r\n\r\n" and int(fields[b"Content-Length"]) == len(block) - 4
        http, _, payload = block[:-4].partition(b"\r\n\r\n")
        assert http.startswith(b"HTTP/1.1 200 OK")
        assert payload == (bytes(r["payload"]) if fields[b"WARC-Type"] == b"response" else b"")
        assert fields[b"WARC-Payload-Digest"].decode() == "sha256:" + hashlib.sha256(bytes(r["payload"])).hexdigest()


def test_the_files_are_warc(spark, tmp_path):
    """The bytes of the files, read without Spark: records one after the other, version lines within payloads included."""
    import gzip

    rows = [*PAGES, (20, "http://in", "<pre>WARC/1.1\r\nWARC-Type: response\r\n\r\nWARC/1.1\r\n</pre>" * 9), (21, "http://in2", "WARC/1.1\r\n" * 20)]
    records = make(spark, tmp_path, rows)
    seen = []
    for file in (tmp_path / "w/warc").glob("*.gz"):
        data = gzip.decompress(file.read_bytes())
        while data:
            assert data.startswith(b"WARC/1.1\r\n")
            head, _, rest = data.partition(b"\r\n\r\n")
            n = int(dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])[b"Content-Length"])
            assert rest[n : n + 4] == b"\r\n\r\n"
            seen.append(head + b"\r\n\r\n" + rest[: n + 4])
            data = rest[n + 4 :]
    assert sorted(seen) == sorted(bytes(r["record"]) for r in records.collect())
    assert {bytes(r["payload"]) for r in records.collect()} >= {h.encode() for _, _, h in rows[-2:]}


def test_a_file_cut_off_is_seen(spark, tmp_path):
    import gzip

    import pytest

    make(spark, tmp_path)
    file = max((tmp_path / "w/warc").glob("*.gz"), key=lambda f: f.stat().st_size)
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut/a.warc.gz").write_bytes(gzip.compress(gzip.decompress(file.read_bytes())[:-30]))
    with pytest.raises(Exception, match="cut off"):
        warc.parse_warc(spark, str(tmp_path / "cut")).collect()
    (tmp_path / "cut/a.warc.gz").write_bytes(gzip.compress(gzip.decompress(file.read_bytes()) + b"more"))
    with pytest.raises(Exception, match="not as long"):
        warc.parse_warc(spark, str(tmp_path / "cut")).collect()
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain/a.warc").write_bytes(gzip.decompress(file.read_bytes()))
    with pytest.raises(Exception, match="not gzipped"):
        warc.parse_warc(spark, str(tmp_path / "plain")).collect()


def test_damage_is_seen(spark, tmp_path):
    import pytest
    from pyspark.sql import functions as F

    make(spark, tmp_path)
    bad = spark.read.parquet(str(tmp_path / "w/payloads")).withColumn("payload", F.lit(b"other"))
    bad.write.parquet(str(tmp_path / "v/payloads"))
    spark.read.parquet(str(tmp_path / "w/headers")).write.parquet(str(tmp_path / "v/headers"))
    with pytest.raises(Exception, match="does not match"):
        warc.read_archive(spark, str(tmp_path / "v")).select("payload").collect()


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archive(df, str(tmp_path / "e"))
    assert warc.summary(warc.read_archive(spark, str(tmp_path / "e"))).count() == 0


def test_repeated_rows_in_stretches(spark, tmp_path):
    rows = [(3, "http://r", BIG)] * 10 + [(4, "http://s", "small")] * 8 + [(5, "http://r", BIG)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_warc(df, str(tmp_path / "w/warc"), stretch=3)
    warc.store(spark, str(tmp_path / "w/warc"), str(tmp_path / "w"))
    records = warc.read_archive(spark, str(tmp_path / "w"))
    assert len({r["record_id"] for r in records.collect()}) == len(rows)
    got = [(r["page_id"], r["record_type"], r["refers_to"]) for r in warc.summary(records).collect()]
    assert sorted(got, key=str) == sorted([(3, "response", None)] + [(3, "revisit", 3)] * 9 + [(4, "response", None)] * 8 + [(5, "revisit", 3)], key=str)
