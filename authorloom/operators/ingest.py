"""From raw listing items to users, content and a media manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from authorloom.functions import patterns as P
from authorloom.functions.hashing import pseudonym
from authorloom.functions.phrases import PhrasePattern
from authorloom.functions.text import collapse_ws
from authorloom.functions.urls import image_extension, urls_in_text, urls_of_post
from authorloom.operators.skew import evaluate_once

CAP_PARTS = 512
"""Parts of an author that are ranked on their own first."""


def drop_bots(items: DataFrame, author: str = "author") -> DataFrame:
    """Leave out deleted accounts and the moderation bot; a missing author stays."""
    name = F.lower(F.coalesce(F.col(author), F.lit("")))
    return items.where(~name.isin(*P.BOT_AUTHORS))


def drop_moderator(items: DataFrame, mark: str = "distinguished") -> DataFrame:
    """Leave out items posted in the role of a moderator."""
    return items.where(~F.col(mark).eqNullSafe(F.lit("moderator")))


def pseudonymise(items: DataFrame, column: str, key: str) -> DataFrame:
    """Replace a name or id by its keyed code and drop rows without one."""
    return items.where(F.length(column) > 0).withColumn(column, pseudonym(F.col(column), key))


def epoch_to_ts(seconds: Column) -> Column:
    """Epoch seconds to a timestamp; NULL when missing or zero."""
    return F.when(seconds != 0, F.timestamp_seconds(seconds))


def pick_body(items: DataFrame) -> DataFrame:
    """Text of a post is its self text, of a comment its body; drop items without."""
    body = F.when(F.col("kind") == "post", F.col("selftext")).otherwise(F.col("body"))
    return with_text(items, body)


def with_text(items: DataFrame, body: Column) -> DataFrame:
    """Add the flat ``text``; drop items without a body."""
    return evaluate_once(items.where(body.isNotNull()), text=collapse_ws(body))


def read_texts(items: DataFrame, pattern: PhrasePattern) -> DataFrame:
    """Items with what :func:`build_content` takes from ``text`` and ``title``, in place of both.

    The columns are made where the texts are, and the rows are small from there on. Whether the title
    counts is known by the kind, which need not be there yet."""
    text = F.col("text")
    titled = search_text(F.lit("post"), F.col("title"), text)
    return items.withColumns(
        {
            "text_urls": urls_in_text(text),
            "placeholder": text.isin(*P.PLACEHOLDER_BODIES),
            "text_hash": F.xxhash64(text),
            "in_text": pattern.search(text),
            "in_titled": pattern.search(titled),
        }
    ).drop("text", "title")


def with_media_urls(items: DataFrame) -> DataFrame:
    """Add ``media_urls``: links in the text and, for posts, links of the post."""
    fields = [
        "url", "is_self", "url_overridden_by_dest", "preview",
        "is_gallery", "gallery_data", "media_metadata",
    ]
    present = {name: F.col(name) for name in fields if name in items.columns}
    from_post = F.when(F.col("kind") == "post", urls_of_post(present)).otherwise(
        F.array().cast("array<string>")
    )
    in_text = F.col("text_urls") if "text_urls" in items.columns else urls_in_text(F.col("text"))
    urls = F.array_distinct(F.concat(in_text, from_post))
    return items.withColumn("media_urls", urls)


def drop_placeholder(items: DataFrame) -> DataFrame:
    """Leave out removed or empty texts that have no media."""
    read = "placeholder" in items.columns
    empty = F.col("placeholder") if read else F.col("text").isin(*P.PLACEHOLDER_BODIES)
    return items.where(F.col("has_media") | ~empty)


def search_text(kind: Column, title: Column, text: Column) -> Column:
    """What is searched for disclosures: title and text of a post, else the text."""
    titled = F.concat(F.coalesce(title, F.lit("")), F.lit(" "), text)
    return F.when(kind == "post", titled).otherwise(text)


def media_manifest(items: DataFrame, id_col: str = "id") -> DataFrame:
    """One row per image link in order of appearance, with its file name."""
    listed = items.select(
        F.col(id_col).alias("content_id"), F.posexplode("media_urls").alias("position", "url")
    )
    number = (F.col("position") + 1).cast("string")
    return listed.withColumn("image", F.concat(F.lit("image"), number, image_extension(F.col("url"))))


def fetched_media(manifest: DataFrame, status: DataFrame, first_only: bool = False) -> DataFrame:
    """Keep links that were obtained and number them again per content.

    ``status`` has (content_id, url, ok). ``first_only`` stops at the first image
    obtained per content. All links of a content come from one row of the listing,
    so their number is small.
    """
    obtained = status.where(F.col("ok")).select("content_id", "url")
    got = manifest.join(obtained, ["content_id", "url"], "left_semi")
    order = Window.partitionBy("content_id").orderBy("position")
    got = got.withColumn("number", F.row_number().over(order))
    if first_only:
        got = got.where(F.col("number") <= 1)
    name = F.concat(F.lit("image"), F.col("number").cast("string"), image_extension(F.col("url")))
    return got.withColumn("image", name).drop("number")


def with_has_media(items: DataFrame, fetched: DataFrame, id_col: str = "id") -> DataFrame:
    """``has_media`` is true where at least one image was obtained."""
    have = fetched.select(F.col("content_id").alias(id_col)).distinct()
    have = have.withColumn("_got", F.lit(True))
    joined = items.drop("has_media").join(have, id_col, "left")
    return joined.withColumn("has_media", F.coalesce("_got", F.lit(False))).drop("_got")


def with_obtained_media(items: DataFrame, status: DataFrame) -> DataFrame:
    """``has_media`` as :func:`fetched_media` of the items' :func:`media_manifest` gives it, in one pass over the items.

    The links obtained meet the rows by id, where the rows of an id are then together; one that
    has such a link decides for all of its id."""
    obtained = status.where(F.col("ok")).groupBy(F.col("content_id").alias("id"))
    joined = items.drop("has_media").join(obtained.agg(F.collect_set("url").alias("_urls")), "id", "left")
    hit = F.coalesce(F.arrays_overlap("media_urls", "_urls"), F.lit(False))
    rows = joined.withColumn("has_media", F.max(hit).over(Window.partitionBy("id"))).drop("_urls")
    return rows.select(*[c for c in items.columns if c != "has_media"], "has_media")


def skip_seen(items: DataFrame, existing: DataFrame, order: str | None = None) -> DataFrame:
    """First copy of every id that is not stored yet.

    Copies collapse map-side, so a heavily repeated id costs one row per task.
    """
    columns = [c for c in items.columns if c != "id"]
    rank = [F.col(order)] if order else [F.xxhash64(*columns)]
    first = items.groupBy("id").agg(F.min_by(F.struct(*columns), F.struct(*rank)).alias("_row"))
    fresh = first.join(existing.select("id"), "id", "left_anti")
    return fresh.select(*[F.col(c) if c == "id" else F.col(f"_row.{c}") for c in items.columns])


def author_evidence(content: DataFrame, found_in: str = "subreddit", order: str = "timestamp") -> DataFrame:
    """Per author of new content: label evidence and where it was met first."""
    rank = F.struct(F.col(order), F.col("id"))
    return content.groupBy("author").agg(
        F.bool_or("has_pattern").alias("has_label"),
        F.min_by(F.col(found_in), rank).alias("first_found_in"),
    )


def new_users(evidence: DataFrame, users: DataFrame) -> DataFrame:
    """Users to create: authors with new content that are not stored yet."""
    fresh = evidence.withColumnRenamed("author", "id")
    return fresh.join(users.select("id"), "id", "left_anti").select("id", "has_label", "first_found_in")


def upgrade_label(users: DataFrame, evidence: DataFrame) -> DataFrame:
    """Stored labels turn true on new evidence and never back."""
    found = evidence.select(F.col("author").alias("id"), F.col("has_label").alias("_found"))
    joined = users.join(found, "id", "left")
    label = F.col("has_label") | F.coalesce("_found", F.lit(False))
    return joined.select("id", label.alias("has_label"), "first_found_in")


def merge_evidence(users: DataFrame, evidence: DataFrame) -> DataFrame:
    """``upgrade_label`` and ``new_users`` in one full join."""
    found = evidence.select(
        F.col("author").alias("id"),
        F.col("has_label").alias("_found"),
        F.col("first_found_in").alias("_place"),
    )
    known = users.withColumn("_known", F.lit(True))
    joined = known.join(found, "id", "full")
    label = F.coalesce("has_label", F.lit(False)) | F.coalesce("_found", F.lit(False))
    place = F.when(F.col("_known"), F.col("first_found_in")).otherwise(F.col("_place"))
    return joined.select("id", label.alias("has_label"), place.alias("first_found_in"))


def cap_per_author(content: DataFrame, n_posts: int = 1000, n_comments: int = 1) -> DataFrame:
    """Newest posts and comments of every author up to the given numbers.

    Ranked within hashed parts of an author first, so that a very active author is spread
    over tasks whatever the numbers are; the last rank gets what the parts left.
    """
    order = [F.desc_nulls_last("timestamp"), F.col("id")]
    allowed = F.when(F.col("type") == "post", n_posts).otherwise(n_comments)
    parted = content.withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(CAP_PARTS)))
    for by in (["author", "type", "_part"], ["author", "type"]):
        newest = Window.partitionBy(*by).orderBy(*order)
        ranked = parted.withColumn("_rank", F.row_number().over(newest))
        # the constant lets Spark cut small numbers before the shuffle as well
        parted = ranked.where((F.col("_rank") <= max(n_posts, n_comments)) & (F.col("_rank") <= allowed))
    return parted.drop("_rank", "_part")


def ingest_counters(content: DataFrame, source: str = "subreddit") -> DataFrame:
    """Authors, posts and comments per source community."""
    authors = content.select(source, "author").distinct().groupBy(source)
    items = content.groupBy(source).agg(
        F.count_if(F.col("type") == "post").alias("n_posts"),
        F.count_if(F.col("type") == "comment").alias("n_comments"),
    )
    return authors.agg(F.count(F.lit(1)).alias("n_users")).join(items, source)


def build_content(
    items: DataFrame,
    key: str,
    pattern: PhrasePattern,
    status: DataFrame | None = None,
) -> DataFrame:
    """Content rows of listing items: codes, text, time, flags.

    ``status`` names the image links that were obtained, by content code; without
    it no content has media. The links stay in ``media_urls``. Items may come as
    :func:`read_texts` leaves them; content then has ``text_hash`` in place of ``text``.
    """
    read = "text_hash" in items.columns
    items = drop_moderator(drop_bots(items))
    items = pseudonymise(pseudonymise(items, "author", key), "id", key)
    items = with_media_urls(items if read else pick_body(items))
    if status is None:
        items = items.withColumn("has_media", F.lit(False))
    else:
        items = with_obtained_media(items, status)
    items = drop_placeholder(items)
    if read:
        has_pattern = F.when(F.col("kind") == "post", F.col("in_titled")).otherwise(F.col("in_text"))
    else:
        has_pattern = pattern.search(search_text(F.col("kind"), F.col("title"), F.col("text")))
    return items.select(
        "id",
        "author",
        F.col("kind").alias("type"),
        F.col("subreddit_name_prefixed").alias("subreddit"),
        "text_hash" if read else "text",
        epoch_to_ts(F.col("created_utc")).alias("timestamp"),
        has_pattern.alias("has_pattern"),
        "has_media",
        "media_urls",
    )
