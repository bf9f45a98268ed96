import json

import pytest

from authorloom.functions.phrases import compile_phrases
from authorloom.operators.ingest import build_content
from authorloom.plans.ingest import ingest_items
from authorloom.schemas import CONTENT, USERS
from authorloom.sources.listings import read_listings
from authorloom.streaming import ingest as streaming
from authorloom.streaming.ingest import stored_content, stored_users, stream_ingest, write_batch

PATTERN = compile_phrases(["I have migraine"], "migraine", ["migraine"])


def item(i, author="ann", kind="comment", text="some text", **more):
    body = {"selftext": text} if kind == "post" else {"body": text}
    return {
        "id": f"t{i}", "author": author, "kind": kind, "subreddit_name_prefixed": f"r/s{i % 2}", "title": "a title",
        "created_utc": 1546300800 + i * 90061, "is_self": True, **body, **more,
    }


PAGES = [
    [item(1), item(2, "bob"), item(3, "AutoModerator")],
    [item(4, "bob", text="I have migraine"), item(1), item(5, "cat", text="[removed]")],
    [item(6, "ann", "post", title="I have migraine"), item(2, "bob"), item(7, "dan", distinguished="moderator")],
    [item(8, "eve", text="  "), item(9, "eve"), item(9, "eve"), item(10, None)],
]


def write_page(folder, number, items):
    folder.mkdir(exist_ok=True)
    page = {"data": {"children": [{"data": i} for i in items], "after": None, "dist": len(items)}}
    (folder / f"page{number}.json").write_text(json.dumps(page))


def state(spark, root, rows):
    content = stored_content(spark, str(root)).drop("timestamp")
    users = stored_users(spark, str(root)).select("id", "has_label")
    return rows(content), rows(users)


@pytest.fixture
def expected(spark, tmp_path, rows):
    folder = tmp_path / "all"
    for n, items in enumerate(PAGES):
        write_page(folder, n, items)
    empty_users, empty_content = spark.createDataFrame([], USERS), spark.createDataFrame([], CONTENT)
    users, content = ingest_items(read_listings(spark, str(folder)), empty_users, empty_content, "key", PATTERN)
    return rows(content.drop("timestamp")), rows(users, "id", "has_label")


def test_batch_result(expected):
    content, users = expected
    assert len(content) == 5 and sum(u[1] for u in users) == 2 and len(users) == 3


@pytest.mark.parametrize("remember", [False, True])
@pytest.mark.parametrize("files_per_batch", [1, 3, None])
def test_any_split_into_batches_ends_alike(spark, tmp_path, rows, expected, remember, files_per_batch):
    source, root = tmp_path / "in", tmp_path / "out"
    write_page(source, 0, PAGES[0])

    def run():
        stream_ingest(
            spark, str(source), str(root), str(tmp_path / "ckpt"), "key", PATTERN, remember, files_per_batch
        ).awaitTermination(120)

    run()
    for n in (1, 2, 3):
        write_page(source, n, PAGES[n])
    run()
    run()
    assert state(spark, root, rows) == expected


def test_batch_may_run_twice(spark, tmp_path, rows, expected):
    for attempt in (0, 0, 1, 1):
        write_page(tmp_path / f"b{attempt}", 0, PAGES[0] + PAGES[1] if attempt == 0 else PAGES[2] + PAGES[3])
        built = build_content(read_listings(spark, str(tmp_path / f"b{attempt}")), "key", PATTERN)
        write_batch(built.select(*CONTENT.names), attempt, str(tmp_path / "out"))
    assert state(spark, tmp_path / "out", rows) == expected


def test_bytes_written_do_not_grow_with_history(spark, tmp_path):
    def size(path):
        return sum(f.stat().st_size for f in path.rglob("*.parquet"))

    root = tmp_path / "out"
    for batch in range(6):
        page = tmp_path / f"p{batch}"
        write_page(page, 0, [item(100 * batch + i, f"author{batch}-{i}") for i in range(30)])
        built = build_content(read_listings(spark, str(page)), "key", PATTERN)
        write_batch(built.select(*CONTENT.names), batch, str(root))
    sizes = [size(root / "users" / f"batch={b}") for b in range(6)]
    assert max(sizes) < 1.2 * min(sizes) and stored_users(spark, str(root)).count() == 180
    assert stored_users(spark, str(root), before=2).count() == 60


def built_page(spark, folder, items):
    write_page(folder, 0, items)
    return build_content(read_listings(spark, str(folder)), "key", PATTERN).select(*CONTENT.names)


def files_read(df):
    """Files that the scans of a plan have read."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    found = [leaves.apply(i).metrics().get("numFiles") for i in range(leaves.size())]
    return sum(m.get().value() for m in found if m.isDefined())


def test_look_back_reads_touched_buckets_only(spark, tmp_path):
    root = str(tmp_path / "out")
    for batch in range(3):
        items = [item(1000 * batch + i, f"a{i}") for i in range(200)]
        write_batch(built_page(spark, tmp_path / f"p{batch}", items), batch, root)
    parts = streaming.id_table(spark, root).manifest().parts
    asked = built_page(spark, tmp_path / "ask", [item(5), item(1007), item(9999)])
    asked = asked.withColumn("bucket", streaming.id_bucket()).select("id", "bucket")
    touched = asked.select("bucket").distinct().count()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert files_read(streaming.seen_before(spark, root, asked)) <= touched * len(parts) + 1
        whole = streaming.id_table(spark, root).read()
        assert files_read(whole) > 20 * touched
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert streaming.seen_before(spark, root, asked).count() == 2


def test_files_of_users_grow_with_the_logarithm(spark, tmp_path):
    root = str(tmp_path / "out")
    for batch in range(9):
        said = spark.createDataFrame([(f"a{batch % 2}", batch == 4, f"r/{batch}")], "author string, has_label boolean, first_found_in string")
        streaming.upsert_labels(spark, root, said, batch)
        streaming.upsert_labels(spark, root, said, batch)
        streaming.evidence_table(spark, root).compact(streaming.fold_evidence)
    assert len(streaming.evidence_table(spark, root).manifest().parts) == 3
    assert sorted(map(tuple, stored_users(spark, root).collect())) == [("a0", True, "r/0"), ("a1", False, "r/1")]
    assert sorted(map(tuple, stored_users(spark, root, before=4).collect())) == [("a0", False, "r/0"), ("a1", False, "r/1")]


@pytest.mark.parametrize("lost", ["ids", "users"])
def test_batch_that_died_halfway_goes_on(spark, tmp_path, rows, expected, monkeypatch, lost):
    """Content is committed, the driver is lost before the ids or the users are, and the batch runs again."""
    root = str(tmp_path / "out")
    commit = streaming.CommittedTable.commit

    def dies(self, *more):
        if self.path.endswith(lost):
            raise RuntimeError("driver lost")
        return commit(self, *more)

    for attempt, pages in enumerate((PAGES[:2], PAGES[2:])):
        built = built_page(spark, tmp_path / f"b{attempt}", [i for page in pages for i in page])
        monkeypatch.setattr(streaming.CommittedTable, "commit", dies)
        with pytest.raises(RuntimeError):
            write_batch(built, attempt, root)
        monkeypatch.setattr(streaming.CommittedTable, "commit", commit)
        write_batch(built, attempt, root)
    assert state(spark, root, rows) == expected


def test_state_is_bounded_by_the_watermark(spark, tmp_path):
    """Ids are kept in RocksDB, and go when the watermark has passed them."""
    write_page(tmp_path / "in", 0, [item(i) for i in range(50)])
    runs = []
    for n in (1, 2, 3):
        query = stream_ingest(
            spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ckpt"), "key", PATTERN, True, None, "0 seconds"
        )
        query.awaitTermination(120)
        runs.append(query.lastProgress)
        write_page(tmp_path / "in", n, [item(100 * n), item(1)])
    state = [p.stateOperators[0] for p in runs if p is not None]
    assert state[0].numRowsTotal <= 50 and state[-1].numRowsTotal <= 4
    assert any(name.startswith("rocksdb") for name in state[0].customMetrics)
    assert stored_content(spark, str(tmp_path / "out")).count() == 52
