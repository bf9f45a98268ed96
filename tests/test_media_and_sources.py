import datetime as dt
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from authorloom.operators import media as M
from authorloom.operators.compare import audit_counters, profile
from authorloom.operators.joins import label_content
from authorloom.plans.publish import publish_corpus
from authorloom.schemas import CONTENT, LISTING_ITEM, RESULT, USERS
from authorloom.sources import tables as S
from authorloom.sources.lists import phrase_list, read_json_list
from authorloom.sources.listings import read_listings
from authorloom.sources.media import media_file_count, read_media

PNG = bytes.fromhex("89504E470D0A1A0A") + b"x" * 20 + bytes.fromhex("0000000049454E44AE426082")
JPEG = bytes.fromhex("FFD8FFE0") + b"x" * 30 + bytes.fromhex("FFD9")
WEBP = b"RIFF\x20\x00\x00\x00WEBPVP8 " + b"x" * 20


def test_clip_boxes(spark, rows):
    boxes = spark.createDataFrame(
        [("c", "i", -3.7, -1.0, 50.9, 200.0, 100, 80), ("c", "j", 5.0, 5.0, 40.0, -2.0, 100, 80),
         ("c", "k", 120.0, 0.0, 130.0, 9.0, 100, 80)],
        "content_id string, image string, x1 double, y1 double, x2 double, y2 double, width int, height int",
    )
    assert rows(M.clip_boxes(boxes), "image", "x1", "y1", "x2", "y2") == [("i", 0, 0, 50, 80)]


def test_pixelate_plan(spark, rows):
    df = spark.createDataFrame([("c", "i", 650, 90)], "content_id string, image string, width int, height int")
    assert rows(M.pixelate_plan(df)) == [("c", "i", 3, 1)]


def test_flags(spark, rows):
    scores = spark.createDataFrame(
        [("c", "i", "nsfw", 0.7), ("c", "j", "nsfw", 0.71), ("c", "j", "normal", 0.29), ("c", "k", "normal", 0.9)],
        "content_id string, image string, label string, score double",
    )
    flags = M.flag_nsfw(scores)
    assert rows(flags) == [("c", "j")]
    media = scores.select("content_id", "image").distinct()
    assert rows(M.drop_flagged_media(media, flags), "image") == [("i",), ("k",)]
    assert audit_counters(media, flags.unionByName(flags)).first()[:] == (3, 1)


@pytest.fixture
def media_folder(tmp_path):
    files = {"c1/image1.png": PNG, "c1/image2.jpg": JPEG, "c2/image1.webp": WEBP, "c2/image2.png": PNG[:-4],
             "c3/image1.jpg": b"<html>not an image at all</html>", "gone/image1.png": PNG}
    for name, data in files.items():
        path = tmp_path / "media" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    return str(tmp_path / "media")


def test_read_media_and_broken_files(spark, media_folder, rows):
    media = read_media(spark, media_folder)
    assert media_file_count(media).first()[0] == 6
    assert "content" not in read_media(spark, media_folder, with_bytes=False).columns
    assert rows(M.drop_broken(media), "content_id", "image") == [
        ("c1", "image1.png"), ("c1", "image2.jpg"), ("c2", "image1.webp"), ("gone", "image1.png")
    ]
    assert M.drop_broken(media, F.col("image") == "image2.png").count() == 1


def test_publish(spark, media_folder, rows):
    media = read_media(spark, media_folder)
    users = spark.createDataFrame([("a", True, "s")], USERS)
    content = spark.createDataFrame(
        [("c1", "a", "t", True), ("c2", "a", "", True), ("c3", "a", "", True), ("c4", "b", "t", False)],
        "id string, author string, text string, has_media boolean",
    )
    flags = spark.createDataFrame([("c2", "image1.webp")], "content_id string, image string")
    boxes = spark.createDataFrame(
        [("c1", "image1.png", 0.0, 0.0, 5.0, 5.0, 10, 10), ("c1", "image2.jpg", 20.0, 0.0, 30.0, 5.0, 10, 10)],
        "content_id string, image string, x1 double, y1 double, x2 double, y2 double, width int, height int",
    )
    out = publish_corpus(users, content, media, flags, boxes)
    assert rows(out.content, "id", "has_media") == [("c1", True), ("c2", False), ("c3", False)]
    assert rows(out.manifest, "content_id", "image", "action", "n_boxes") == [
        ("c1", "image1.png", "blur", 1), ("c1", "image2.jpg", "keep", 0), ("c2", "image1.webp", "drop", 0),
        ("c2", "image2.png", "drop", 0), ("c3", "image1.jpg", "drop", 0), ("gone", "image1.png", "drop", 0),
    ]
    assert rows(publish_corpus(users, content, media, flags, boxes, drop_empty=True).content, "id") == [("c1",)]


def test_keyed_csv(spark, tmp_path, rows):
    path = tmp_path / "users.csv"
    path.write_text('id,has_label,first_found_in\na,True,r/x\nb,false,"r/y, ""z"""\na,FALSE,r/last\n')
    df = S.read_keyed_csv(spark, str(path), USERS)
    assert rows(df) == [("a", False, "r/last"), ("b", False, 'r/y, "z"')]
    assert df.schema.fieldNames() == USERS.names
    assert S.read_keyed_csv(spark, str(tmp_path / "none.csv"), USERS).count() == 0


def test_content_csv_round_trip(spark, tmp_path, rows):
    when = dt.datetime(2020, 5, 1, 10, 30)
    data = [("1", "a", "post", "r/x", 'line\n"quoted", text', when, True, False), ("2", "a", "post", "r/x", None, None, False, True)]
    df = spark.createDataFrame(data, CONTENT)
    S.write_content(df, str(tmp_path / "c"), "csv")
    back = S.read_table_csv(spark, str(tmp_path / "c"), CONTENT)
    assert rows(back) == rows(df)


def test_timestamps_with_zone(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text(",".join(CONTENT.names) + "\n1,a,post,r/x,t,2020-05-01 10:30:00+00:00,True,False\n")
    row = S.read_table_csv(spark, str(path), CONTENT).first()
    assert row.timestamp == dt.datetime(2020, 5, 1, 10, 30) or row.timestamp is not None
    assert spark.read.csv(str(path), header=True).count() == 1


def test_parquet_sinks(spark, tmp_path, rows):
    users = spark.createDataFrame([("a", True, "s")], USERS).withColumn("n_posts", F.lit(3))
    S.write_users(users, str(tmp_path / "u"))
    assert spark.read.parquet(str(tmp_path / "u")).columns == [*USERS.names, "n_posts"]
    for _ in range(2):
        S.append_rows(users, str(tmp_path / "v"), "user")
    assert spark.read.parquet(str(tmp_path / "v")).count() == 2


def test_bucketed_tables_join_in_place(spark, tmp_path):
    users = spark.createDataFrame([(f"a{i}", True, "s") for i in range(20)], USERS).withColumnRenamed("id", "author")
    items = spark.range(200).select(F.concat(F.lit("a"), F.col("id") % 25).alias("author"), F.lit("t").alias("text"))
    spark.sql(f"CREATE DATABASE IF NOT EXISTS bucketed LOCATION '{tmp_path}/db'")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        S.save_bucketed(users, "bucketed.users", "author", 4)
        S.save_bucketed(items, "bucketed.content", "author", 4)
        joined = label_content(spark.table("bucketed.content"), spark.table("bucketed.users").withColumnRenamed("author", "id"))
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 160
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP DATABASE bucketed CASCADE")


def test_flag_list(spark, tmp_path, rows):
    flags = spark.createDataFrame([("c", "image1.png")], "content_id string, image string")
    S.write_flag_list(flags, str(tmp_path / "f"))
    assert rows(S.read_flag_list(spark, str(tmp_path / "f"))) == [("c", "image1.png")]
    assert S.read_flag_list(spark, str(tmp_path / "missing")).count() == 0


def test_predictions_and_results(spark, tmp_path):
    df = spark.createDataFrame(
        [("e", "a", 1, 0.5, 1, "validation"), ("e", "b", 0, 0.25, 0, "test")],
        "experiment_name string, author string, true_label int, predicted_probability double, predicted_label int, dataset string",
    )
    S.write_predictions(df, str(tmp_path / "p"))
    assert (tmp_path / "p" / "experiment_name=e" / "dataset=test").is_dir()
    result = spark.createDataFrame([tuple([None] * 17)], RESULT)
    for _ in range(2):
        S.append_result(result, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).count() == 2


def test_json_lists(spark, tmp_path, rows):
    path = tmp_path / "phrases.json"
    path.write_text(json.dumps(["one", "two ?"], indent=4))
    assert rows(read_json_list(spark, str(path))) == [("one",), ("two ?",)]
    assert sorted(phrase_list(spark, str(path))) == ["one", "two ?"]


def test_listings(spark, tmp_path):
    item = {"author": "a", "id": "1", "created_utc": 1.5, "is_self": True, "extra": {"x": 1}}
    Path(tmp_path / "page.json").write_text(json.dumps({"data": {"children": [{"data": item}, {"data": {}}], "after": None}}))
    got = read_listings(spark, str(tmp_path / "page.json"))
    assert got.columns == LISTING_ITEM.names and got.count() == 2
    assert got.where("id = '1'").first().created_utc == 1.5


def test_profile(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert profile({"t": df, "u": df.limit(0)}).collect()[1][:] == ("u", 0, 2, "a,b")
