import base64
import hashlib

from locusloom.llm import warc

MAGIC = "WARC/1.0\r\n"
PAGES = [
    (1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>one</p>"), (3, "http://a/3", "Ünï\r\n\r\ncode"), (4, "http://a/4", None), (5, None, ""), (6, "http://a/6", MAGIC + "WARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"),
    (7, "http://a/7", f"x\r\n\r\n{MAGIC}{MAGIC}y" * 3), (8, "http://a\r\n/8", MAGIC), (9, "http://a/9", MAGIC), (10, "http://a/10", "z" * 300_000 + MAGIC + "q"), (-3, "http://a/-3", "neg"), (11, "u", "\r\n\r\n"), (12, "u", "ends\r\n\r\n" + MAGIC),
]


def expected(pages, least=0):
    first = {}
    for i, _, h in pages:
        h = h or ""
        if len(h.encode()) >= least:
            first[h] = min(first.get(h, i), i)
    out = []
    for i, _, h in pages:
        b = (h or "").encode()
        to = first.get(h or "")
        revisit = to is not None and to != i
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", to if revisit else None))
    return sorted(out)


def digest(spark, pages, least=0):
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "'x' as value", "1 as at", "2 as file")
    out = warc.archive_digest(df, min_dedup_bytes=least)
    assert all(r.sound for r in out.collect())
    return sorted(out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())


def test_round_trip_with_magic_inside_payloads(spark):
    assert digest(spark, PAGES) == expected(PAGES)


def test_small_payloads_are_responses(spark):
    assert digest(spark, PAGES, 5) == expected(PAGES, 5)


def test_payloads_come_back_whole(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    warc.write_warc(df.repartition(1), f"file://{tmp_path}/w", records_per_file=1000)
    records = warc.read_warc(spark, f"file://{tmp_path}/w").collect()
    assert len(records) == len(PAGES)
    assert all(r.payload_digest == r.told_digest for r in records if r.type == "response")


def test_empty(spark):
    assert digest(spark, []) == []


def test_corpus(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    out = warc.archive_digest(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(out.collect()) == expected([tuple(r) for r in pages.select("page_id", "url", "html").collect()])


def test_chains_over_several_blocks(spark, tmp_path):
    """Files that can be split: pointer jumping joins the blocks, magics inside payloads at their edges included."""
    inner = MAGIC + "WARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    pages = PAGES + [(100 + i, f"http://b/{i}", inner * (i % 5) + "x" * (37 * i % 700) + MAGIC * (i % 3)) for i in range(400)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    warc.write_warc(df.repartition(3), f"file://{tmp_path}/w", compression="none")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        records = warc.read_warc(spark, f"file://{tmp_path}/w").collect()
        blocks = warc._fragments(spark, f"file://{tmp_path}/w").select("file", "block").distinct().count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert blocks > 50 and len(records) == len(pages) and all(r.sound for r in records)
    number = lambda r: int(r.id[len("<urn:page:") : -1])
    got = sorted((number(r), r.told_bytes, r.told_digest, r.type, None if r.type == "response" else int(r.refers[len("<urn:page:") : -1])) for r in records)
    assert got == expected(pages) and all(r.payload_digest == r.told_digest for r in records if r.type == "response")


def test_what_is_cut_short_is_told(spark, tmp_path):
    df = spark.createDataFrame(PAGES[:4], "page_id long, url string, html string")
    warc.write_warc(df.coalesce(1), f"file://{tmp_path}/w", compression="none")
    (part,) = (tmp_path / "w").glob("part-*")
    whole = part.read_bytes()
    (tmp_path / "v").mkdir()
    (tmp_path / "v/part").write_bytes(whole[: whole.rindex(b"code")])
    records = warc.read_warc(spark, f"file://{tmp_path}/v").collect()
    assert sorted(r.sound for r in records).count(False) == 1 and all(r.payload_digest is None for r in records if not r.sound)


def test_many_repeated_payloads(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    pages = [(i, "u", f"page {i % 7}") for i in range(60)] + [(3, "u", "page 3"), (3, "v", "page 4")]
    assert digest(spark, pages) == expected(pages)
