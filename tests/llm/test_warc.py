import base64
import hashlib

from strandloom.llm import warc as M


def brute(rows):
    out, first = [], {}
    for i, _, html in rows:
        p = (html or "").encode()
        if i is not None and (p not in first or i < first[p]):
            first[p] = i
    n = {}
    for _, _, html in rows:
        n[html or ""] = n.get(html or "", 0) + 1
    for i, _, html in rows:
        p = (html or "").encode()
        f = first.get(p) if n[html or ""] > 1 else i
        revisit = f is not None and f != i
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if revisit else "response", f if revisit else None))
    return sorted(out, key=str)


def everything(spark, folder, rows):
    """All records, looked up by the URLs of all rows."""
    return M.lookup(spark.createDataFrame([(r[1],) for r in rows], "url string"), folder).collect()


ROWS = [(5, "http://a.example.com/x?y=1#z", "<p>é</p>"), (3, "http://B.example.com:80/", "<p>é</p>"), (9, None, None), (8, "odd\turl\n", ""), (3, "http://b.example.com", "<p>é</p>"), (None, "http://c.org/ü", "alone"), (None, "http://c.org/ü", "<p>é</p>"), (7, "https://user@c.org/%41", "x\r\n\r\ny" * 30_000)]


def test_round_trip_equals_brute_force(spark):
    pages = spark.createDataFrame([(*r, "k", 0) for r in ROWS], "page_id long, url string, html string, key string, offset long")
    folder = M.write_archives(pages, lines=3)
    got = everything(spark, folder, ROWS)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == brute(ROWS)
    html = {r.page_id: r.payload for r in got if r.record_type == "response"}
    assert bytes(html[7]).decode() == "x\r\n\r\ny" * 30_000


def test_lookup_finds_every_capture(spark):
    rows = [(i, f"http://h{i % 5}.example.com/p{i % 7}", f"text {i}") for i in range(400)]
    folder = M.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), lines=4)
    urls = [("http://h3.example.com/p2",), ("http://none.org/",), ("http://h0.example.com/p0",)]
    got = sorted(r.page_id for r in M.lookup(spark.createDataFrame(urls, "url string"), folder).collect())
    assert got == sorted(i for i, u, _ in rows if (u,) in urls)


def test_keys_and_empty_table(spark):
    assert M.url_key("http://Blog.Example.com:8080/a b?q#f") == "com,example,blog)/a%20b?q"
    assert M.url_key(None) == "" and M.url_key("https://x.org") == "org,x)/"
    folder = M.write_archives(spark.createDataFrame([], "page_id long, url string, html string"))
    assert everything(spark, folder, ROWS) == []


def test_urls_read_back_as_they_were(spark):
    urls = ["http://x.com/a%20b?q=%2F", "http://x.com/a b?q=/", "http://x.com/100%", "http://x.com/ü'[]#f", "no scheme at all \t\n %0A", "", "http://x.com/%41", "http://X.com/A"]
    rows = [(k, u, f"text {k}") for k, u in enumerate(urls)]
    folder = M.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), lines=2)
    assert {r.page_id: r.url for r in everything(spark, folder, rows)} == dict(enumerate(urls))


def test_a_key_may_hold_most_captures(spark):
    """Its run of blocks is read block by block, and every other key is still found."""
    rows = [(k, "http://hot.org/" if k % 3 else f"http://h{k}.org/", f"text {k % 50}") for k in range(600)]
    folder = M.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5), lines=7)
    got = everything(spark, folder, rows)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == brute(rows)
    assert {r.page_id for r in M.lookup(spark.createDataFrame([("http://hot.org",)], "url string"), folder).collect()} == {k for k in range(600) if k % 3}
