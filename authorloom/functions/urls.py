"""Image links of a post or comment, as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from authorloom.functions import patterns as P

_NO_URLS = "array<string>"


def _cut_query(url: Column) -> Column:
    return F.replace(F.split_part(url, F.lit("?"), F.lit(1)), F.lit("&amp;"), F.lit("&"))


def urls_in_text(text: Column) -> Column:
    """Image links written in the text, without query string or trailing marks."""
    found = F.regexp_extract_all(text, F.lit(P.java(P.TEXT_IMAGE_URL, True)), F.lit(0))

    def tidy(url: Column) -> Column:
        bare = F.split_part(url, F.lit("?"), F.lit(1))
        bare = F.rtrim(F.rtrim(F.rtrim(bare, F.lit(")")), F.lit(".")), F.lit(")"))
        return F.replace(bare, F.lit("&amp;"), F.lit("&"))

    return F.coalesce(F.transform(found, tidy), F.array().cast(_NO_URLS))


def _image_or_original(url: Column, original: Column) -> Column:
    """External previews point to the original link, own previews to the image host."""
    own = F.replace(_cut_query(url), F.lit(P.PREVIEW_HOST), F.lit(P.IMAGE_HOST))
    chosen = F.when(url.contains(P.EXTERNAL_PREVIEW_HOST), original).otherwise(own)
    return F.when(F.length(url) > 0, chosen)


def _is_image(url: Column) -> Column:
    path = F.split_part(F.lower(url), F.lit("?"), F.lit(1))
    hit = F.lit(False)
    for ending in P.IMAGE_ENDINGS:
        hit = hit | path.endswith(ending)
    return hit


def direct_url(url: Column) -> Column:
    """Link of a post that is itself an image, as an array of at most one."""
    marked = F.lit(False)
    for mark in P.DIRECT_IMAGE_MARKS:
        marked = marked | url.contains(mark)
    return F.when(marked, F.array(_cut_query(url))).otherwise(F.array().cast(_NO_URLS))


def urls_of_post(item: dict[str, Column]) -> Column:
    """Image links of a post: direct link, previews and gallery, endings checked.

    ``item`` maps listing field names to columns; absent fields are skipped.
    """
    none = F.array().cast(_NO_URLS)
    url = item["url"]
    original = url
    if "url_overridden_by_dest" in item:
        overridden = item["url_overridden_by_dest"]
        original = F.coalesce(F.when(F.length(overridden) > 0, overridden), url)
    external = direct_url(url)
    if "preview" in item:
        previews = F.transform(
            item["preview"]["images"], lambda image: _image_or_original(image["source"]["url"], original)
        )
        external = F.concat(external, F.coalesce(previews, none))
    is_self = F.coalesce(item["is_self"], F.lit(True))
    urls = F.when(~is_self, external).otherwise(none)

    if "gallery_data" in item:
        metadata = item["media_metadata"]

        def gallery_url(entry: Column) -> Column:
            meta = metadata[entry["media_id"]]
            variants = F.coalesce(F.map_contains_key(meta["s"]["variants"], "gif"), F.lit(False))
            standard = _image_or_original(meta["s"]["u"], original)
            chosen = F.when(variants, meta["s"]["variants"]["gif"]["u"]).otherwise(standard)
            return F.when(meta["e"].isin("Image", "AnimatedImage"), chosen)

        gallery = F.transform(item["gallery_data"]["items"], gallery_url)
        wanted = F.coalesce(item["is_gallery"], F.lit(False))
        urls = F.concat(urls, F.when(wanted, F.coalesce(gallery, none)).otherwise(none))
    return F.array_distinct(F.filter(urls, lambda u: u.isNotNull() & _is_image(u)))


def image_extension(url: Column) -> Column:
    """File ending by link text: ``.png``, ``.webp``, else ``.jpg``."""
    lowered = F.lower(url)
    return (
        F.when(lowered.contains(".png"), F.lit(".png"))
        .when(lowered.contains(".webp"), F.lit(".webp"))
        .otherwise(F.lit(".jpg"))
    )
