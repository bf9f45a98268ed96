from pyspark.sql import functions as F

from authorloom.functions.urls import image_extension, urls_in_text
from authorloom.operators.ingest import fetched_media, media_manifest, with_has_media, with_media_urls
from authorloom.schemas import LISTING_ITEM


def test_urls_in_text(spark):
    text = (
        "see https://preview.redd.it/a.png?x=1&amp;y (https://i.imgur.com/b.jpg). HTTPS://I.REDD.IT/c.WEBP "
        "https://imgur.com/gallery, https://example.com/d.png"
    )
    got = spark.createDataFrame([(text,), (None,)], "t string").select(urls_in_text(F.col("t"))).collect()
    assert got[0][0] == [
        "https://preview.redd.it/a.png", "https://i.imgur.com/b.jpg", "HTTPS://I.REDD.IT/c.WEBP",
        "https://imgur.com/gallery,",
    ]
    assert got[1][0] == []


def post(**fields):
    row = dict.fromkeys(LISTING_ITEM.names)
    row.update(kind="post", is_self=False, **fields)
    return row


def urls(spark, item):
    df = spark.createDataFrame([item], LISTING_ITEM).withColumn("text", F.lit(""))
    return with_media_urls(df).first()["media_urls"]


def preview(*links):
    return {"images": [{"source": {"url": u}} for u in links]}


def test_direct_and_preview(spark):
    assert urls(spark, post(url="https://i.redd.it/p.png?width=1&amp;s=2")) == ["https://i.redd.it/p.png"]
    assert urls(spark, post(url="https://i.imgur.com/p.gif")) == []
    item = post(url="https://news.example/x", preview=preview("https://preview.redd.it/a.jpg?x=1&amp;y"))
    assert urls(spark, item) == ["https://i.redd.it/a.jpg"]
    item["is_self"] = True
    assert urls(spark, item) == []
    item["is_self"] = None
    assert urls(spark, item) == []


def test_external_preview_uses_the_original(spark):
    link = "https://external-preview.redd.it/z.jpg?s=1"
    assert urls(spark, post(url="https://a.example/o.png", preview=preview(link, ""))) == ["https://a.example/o.png"]
    item = post(url="https://a.example/o", url_overridden_by_dest="https://a.example/w.webp", preview=preview(link))
    assert urls(spark, item) == ["https://a.example/w.webp"]


def test_gallery(spark):
    def meta(kind, url, variants=None):
        return {"e": kind, "s": {"u": url, "variants": variants}}

    item = post(
        url="https://x.example/gallery",
        is_gallery=True,
        gallery_data={"items": [{"media_id": m} for m in ("a", "b", "c", "d", "missing")]},
        media_metadata={
            "a": meta("Image", "https://preview.redd.it/a.jpg?w=1&amp;s=2"),
            "b": meta("AnimatedImage", "https://preview.redd.it/b.png", {"gif": {"u": "https://i.redd.it/b.gif"}}),
            "c": meta("Video", "https://preview.redd.it/c.png"),
            "d": meta("Image", ""),
        },
    )
    assert urls(spark, item) == ["https://i.redd.it/a.jpg"]
    item["is_gallery"] = False
    assert urls(spark, item) == []


def test_manifest_and_flags(spark, rows):
    items = spark.createDataFrame(
        [("c1", ["u/a.PNG", "u/b", "u/c.webp"]), ("c2", ["u/d.png"]), ("c3", [])],
        "id string, media_urls array<string>",
    )
    manifest = media_manifest(items)
    assert rows(manifest, "content_id", "image") == [
        ("c1", "image1.png"), ("c1", "image2.jpg"), ("c1", "image3.webp"), ("c2", "image1.png")
    ]
    status = spark.createDataFrame(
        [("c1", "u/a.PNG", False), ("c1", "u/b", True), ("c1", "u/c.webp", True), ("c2", "u/d.png", False)],
        "content_id string, url string, ok boolean",
    )
    got = fetched_media(manifest, status)
    assert rows(got, "content_id", "image") == [("c1", "image1.jpg"), ("c1", "image2.webp")]
    assert rows(fetched_media(manifest, status, first_only=True), "image") == [("image1.jpg",)]
    assert rows(with_has_media(items, got), "id", "has_media") == [("c1", True), ("c2", False), ("c3", False)]


def test_extension(spark):
    df = spark.createDataFrame([("a.PNG?x",), ("b.webp",), ("c.jpeg",)], "u string")
    assert [r[0] for r in df.select(image_extension(F.col("u"))).collect()] == [".png", ".webp", ".jpg"]
