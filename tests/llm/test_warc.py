import hashlib

from slatewing.llm import warc


def test_round_trip(spark, awkward, tmp_path):
    import zstandard

    pages = spark.read.parquet(f"{awkward}/pages.parquet")
    index, folder = warc.archive_pages(pages, f"file://{tmp_path}/w", frame_bytes=4000)
    places = index.collect()
    assert len(places) == pages.count() == len({r.record_id for r in places})
    raw = {None if r.html is None else hashlib.sha1(r.html.encode()).hexdigest() for r in pages.collect()}
    for r in places:
        headers, body = warc.fetch(f"{folder}/archives", r.archive, r.frame_start, r.frame_bytes, r.offset)
        assert headers["WARC-Record-ID"] == f"<{r.record_id}>" and len(headers["WARC-Date"]) == 20
        if headers["WARC-Type"] == "revisit":
            assert headers["WARC-Refers-To"][1:-1] in {x.record_id for x in places}
        if headers["WARC-Type"] == "response":
            assert hashlib.sha1(body).hexdigest() == headers["WARC-Payload-Digest"].removeprefix("sha1:")
        assert headers["WARC-Payload-Digest"].removeprefix("sha1:") in raw | {hashlib.sha1(b"").hexdigest()}
    # The whole file is a plain Zstandard stream as well: the seek table is skipped.
    for path in (tmp_path / "w/archives").glob("*.warc.zst"):
        with path.open("rb") as f:
            block = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()
        at = n = 0
        while at < len(block):
            _, _, at = warc.parse(block, at)
            n += 1
        assert n == sum(r.archive == path.name for r in places)


def test_results(spark, awkward):
    got = {(r.page_id, r.payload_bytes): (r.record_type, r.refers_to) for r in warc.op1_warc(spark, awkward).collect()}
    assert got[(2, 1203)] == ("response", None) and got[(1, 1203)] == ("revisit", 2) and got[(None, 1203)] == ("revisit", 2)
    assert got[(3, 0)] == got[(4, 0)] == got[(5, 5)] == got[(6, 5)] == got[(7, 998)] == got[(8, 998)] == ("response", None)
    assert got[(9, 1000)] == ("revisit", 10) and got[(10, 1000)] == ("response", None) and got[(11, 300_000)] == ("response", None)


def test_seek_table():
    import io

    sink = io.BytesIO()
    writer = warc.FrameWriter(sink, 3, 100)
    places = [writer.add(bytes([65 + i]) * 60) for i in range(5)]
    starts = writer.close()
    table = warc.seek_table(sink, len(sink.getvalue()))
    assert places == [(i, 0) for i in range(5)] and [(a, b) for a, b, _ in table] == starts and [c for *_, c in table] == [60] * 5


def test_a_third_of_the_pages_alike(spark):
    rows = [(i, f"u{i}", ("hot " * 400) if i % 3 == 0 else f"page {i} " * 200) for i in range(900)] + [(999, "u", "hot " * 400)] * 3
    got = warc.read_archives(*(lambda x: (x[0], f"{x[1]}/archives"))(warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as n", "3 as target", "'x' as payload", "'y' as uri")))).collect()
    assert len(got) == 903 and len({r.record_id for r in got}) == 903
    hot = hashlib.sha1(("hot " * 400).encode()).hexdigest()
    for r in got:
        assert (r.record_type, r.refers_to) == (("revisit", 999) if r.payload_digest == hot and r.page_id != 999 else ("response", None))
