import pytest
from pyspark.sql import functions as F

from authorloom.llm import shared, warc


def pages(spark, n=300):
    rows = [(i, f"http://h{i % 7}.example/{i}", f"<html>{'body ' * (i % 50)}{i // 3} é</html>") for i in range(n)]
    rows += [(n, "http://x/\r\nX: y", None), (n + 1, None, ""), (n + 2, "u", "<p>" * 200_000)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_round_trip(spark):
    given = pages(spark)
    groups = {}
    rows = given.collect()
    for r in rows:
        groups.setdefault(r.html or "", []).append(r.page_id)
    got = {r.page_id: r for r in warc.round_trip(given).collect()}
    for r in rows:
        payload, newest = (r.html or "").encode(), max(groups[r.html or ""])
        first = r.page_id == newest
        assert tuple(got[r.page_id]) == (
            r.page_id,
            len(payload),
            warc.digest_of(payload),
            "response" if first else "revisit",
            None if first else newest,
        )


def test_payloads_come_back_and_archives_start_with_the_dictionary(spark):
    given = pages(spark)
    path = shared.new_table_path(spark, "test-warc")
    warc.write_archives(given, path, archive_bytes=4000)
    archives = spark.read.parquet(path)
    rows = [bytes(r.archive) for r in archives.collect()]
    assert len(rows) > 2
    assert all(a[:4] == warc.SKIPPABLE.to_bytes(4, "little") for a in rows)
    got = warc.read_archives(archives).where("record_type = 'response'")
    wrong = got.join(given, "page_id").where(F.decode("payload", "UTF-8") != F.coalesce("html", F.lit("")))
    assert wrong.count() == 0


def archive():
    writer = warc.ArchiveWriter(b"")
    writer.add(warc.record(1, "u", b"payload", None, warc.digest_of(b"payload"), 7))
    return writer.close()


def test_broken_archives_are_told():
    good = archive()
    raw = next(warc.read_records(good))
    assert warc.parse_record(raw)[1] == b"payload"
    for bad in (good[:-3], b"\x5d\x2a\x4d\x18\xff\xff\x00\x00" + good, good[:4] + b"\xff" + good[5:]):
        with pytest.raises(warc.ArchiveError):
            list(warc.read_records(bad))
    for was, now in (
        (b"WARC/1.1", b"WORC/1.1"),
        (b"Content-Length: 7", b"Content-Length: 8"),
        (b"payload\r\n", b"peyload\r\n"),
        (b"WARC-Date", b"WARC-Dote"),
        (b"\r\n\r\npay", b"\r\nno colon\r\n\r\npay"),
    ):
        with pytest.raises(warc.ArchiveError):
            warc.parse_record(raw.replace(was, now))


def test_odd_rows(spark):
    rows = [(None, "u", "a"), (1, None, "a"), (1, None, "a"), (2, "u", None)]
    given = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, refers_to int")
    got = warc.round_trip(given)
    assert got.count() == 4 and got.where("page_id is null").count() == 1
    assert warc.newest_first(got).count() == 3
    assert warc.round_trip(given.where("false")).count() == 0


def test_frames_larger_and_smaller_than_a_piece(monkeypatch):
    import zstandard

    texts = [b"", b"x", bytes(range(256)) * 200, b"small", b"y" * 100_000]
    archive = b"".join(zstandard.compress(t) for t in texts)
    for size in (1, 7, 1 << 13, 1 << 20):
        monkeypatch.setattr(warc, "PIECE", size)
        assert list(warc.read_records(archive)) == texts
        with pytest.raises(warc.ArchiveError):
            list(warc.read_records(archive[:-1]))
