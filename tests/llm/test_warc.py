import base64
import gzip
import hashlib
import random
import zlib

from tessera.llm import warc


def sha(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_records_link_to_their_source(spark):
    pages = [(1, "https://a.org/é", "<html><head><title>T</title><style>x</style></head><body><p>One &amp; two<p>three</body>"), (2, None, None), (3, "http://b\r\nX: y", ""), (1, "https://a.org/é", "<p>again")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "'x' AS record", "'y' AS warc_type").repartition(2)
    raw = warc.responses(df)
    got = warc.derived(raw).collect()
    assert len(got) == 8 and len({r.record_id for r in got}) == 8
    sources = {}
    for r in raw.collect():
        headers, block = warc.parsed(r.response)
        h = dict(headers)
        assert h["WARC-Block-Digest"] == sha(block) and h["WARC-Payload-Digest"] == sha(block.partition(b"\r\n\r\n")[2])
        sources[h["WARC-Record-ID"]] = h
    for r in got:
        headers, block = warc.parsed(r.record)
        h = dict(headers)
        assert h["WARC-Refers-To"] == r.refers_to and r.refers_to in sources
        assert h["WARC-Target-URI"] == sources[r.refers_to]["WARC-Target-URI"] == r.target_uri
        assert r.source_payload_digest == sources[r.refers_to]["WARC-Payload-Digest"]
        assert h["WARC-Block-Digest"] == r.block_digest == sha(block) and r.content_length == len(block)
    text = {warc.parsed(r.record)[1].decode() for r in got if r.warc_type == "conversion" and r.page_id == 1}
    assert text == {"T\nOne & two\nthree", "again"}
    again = warc.derived(warc.responses(df)).collect()
    assert sorted(bytes(r.record) for r in again) == sorted(bytes(r.record) for r in got)


def test_broken_and_other_records():
    for raw in (b"", b"WARC/1.1\r\n", b"WARC/1.1\r\nContent-Length: 99\r\n\r\nshort", warc.record([("WARC-Type", "request")], b"x")):
        (one,) = warc.derivatives(raw)
        assert one["warc_type"] == "metadata" and warc.parsed(one["record"])[1].startswith(b"error:")
    image = warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>"), ("X-Folded", "a\r\n  b")], b"HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n\r\n\x89")
    (one,) = warc.derivatives(image)
    assert b"source-x-folded: a b" in one["record"]
    latin = warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:y>")], b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=latin-1\r\n\r\n<p>\xe9")
    assert warc.parsed(warc.derivatives(latin)[1]["record"])[1].decode() == "é"


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.derived(warc.responses(df)).count() == 0


def http(body, *lines):
    return warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:z>")], b"HTTP/1.1 200 OK\r\n" + b"".join(x.encode() + b"\r\n" for x in ("Content-Type: text/html", *lines)) + b"\r\n" + body)


def text(raw):
    found = warc.derivatives(raw)
    return warc.parsed(found[1]["record"])[1].decode() if len(found) > 1 else None


def test_charsets_and_encodings():
    page = "<p>é one<p>two".encode()
    for charset in ("undefined", "idna", "nothing", "rot13", "punycode"):
        assert "one" in text(http(page, f"Content-Type: text/html; charset={charset}"))
    chunked = b"5;x=y\r\n" + page[:5] + b"\r\n" + f"{len(page) - 5:x}".encode() + b"\r\n" + page[5:] + b"\r\n0\r\n\r\n"
    deflate = zlib.compressobj(wbits=-15)
    cases = [
        (gzip.compress(page), "Content-Encoding: gzip"),
        (zlib.compress(page), "Content-Encoding: deflate"),
        (deflate.compress(page) + deflate.flush(), "Content-Encoding: deflate"),
        (chunked, "Transfer-Encoding: chunked"),
        (gzip.compress(gzip.compress(page)), "Content-Encoding: gzip, x-gzip"),
        (page, "Content-Encoding: identity"),
    ]
    for body, line in cases:
        assert text(http(body, line)) == "é one\ntwo", line
        assert f"payload-digest-computed: {sha(body)}".encode() in warc.derivatives(http(body, line))[0]["record"]
    for body, line in ((b"no gzip", "Content-Encoding: gzip"), (page, "Content-Encoding: br"), (b"5\r\nab", "Transfer-Encoding: chunked"), (b"zz\r\n", "Transfer-Encoding: chunked"), (gzip.compress(page)[:-9], "Content-Encoding: gzip")):
        (one,) = warc.derivatives(http(body, line))
        assert b"conversion-error: " in one["record"]


def test_files_in_and_out(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>page {i}" + "x" * (3_000_000 if i == 3 else 5)) for i in range(6)], "page_id long, url string, html string")
    raw = warc.responses(pages)
    rows = sorted(bytes(r.response) for r in raw.collect())
    (tmp_path / "files").mkdir()
    warc.write(raw, f"{tmp_path}/packed", "response")
    members = [bytes(r.value) for r in spark.read.parquet(f"{tmp_path}/packed").collect()]
    (tmp_path / "files" / "a.warc.gz").write_bytes(warc.joined(members[:4]))
    (tmp_path / "files" / "b.warc").write_bytes(b"".join(map(gzip.decompress, members[4:])))
    (tmp_path / "files" / "c.warc").write_bytes(b"WARC/1.1\r\nContent-Length: 50\r\n\r\nshort")
    (tmp_path / "files" / "d.warc").write_bytes(b"")
    got = warc.read(spark, f"{tmp_path}/files")
    assert sorted(bytes(r.response) for r in got.where("path not like '%c.warc'").collect()) == rows
    kinds = [r.warc_type for r in warc.derived(got, ["path"]).collect()]
    assert kinds.count("metadata") == 7 and kinds.count("conversion") == 6


def test_text_of_pages_matches_plain_removal_of_tags(spark):
    rng = random.Random(3)
    for _ in range(50):
        words = [f"w{rng.randrange(99)}" for _ in range(20)]
        page, want = "<html><title>t</title><body>", ["t"]
        for w in words:
            tag = rng.choice(["p", "div", "b", "li", "script"])
            page += f"<{tag} class='{w}'>{w}</{tag}>"
            if tag == "b":
                want.append((want.pop() if want and want[-1].startswith("+") else "+") + w)
            elif tag != "script":
                want.append(w)
            else:
                want.append("")
        assert warc.plain(page).split() == [w.lstrip("+") for w in want if w.lstrip("+")]
