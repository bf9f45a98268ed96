"""Queries on media tables and publication."""

from __future__ import annotations

from pyspark.sql import functions as F

from authorloom.operators import media as M
from authorloom.operators.compare import audit_counters
from authorloom.plans.catalogue.registry import query
from authorloom.plans.publish import publish_corpus
from authorloom.sources.media import media_file_count


def _scores(c):
    """Two score rows per image, as a classifier returns them."""
    pair = F.array(
        F.struct(F.lit("nsfw").alias("label"), F.col("nsfw_score").alias("score")),
        F.struct(F.lit("normal").alias("label"), (1 - F.col("nsfw_score")).alias("score")),
    )
    return c.media.select("content_id", "image", F.inline(pair))


@query("nsfw_flags", "SELECT content_id, image FROM v_media WHERE nsfw_score > 0.7e0")
def nsfw_flags(c):
    return M.flag_nsfw(_scores(c))


@query("face_flags", "SELECT content_id, image FROM v_media WHERE n_faces > 0")
def face_flags(c):
    return M.flag_faces(c.media, c.boxes)


@query("clip_boxes", """
SELECT * FROM (
  SELECT content_id, image, box_no, greatest(CAST(trunc(x1) AS BIGINT), 0) AS x1,
         greatest(CAST(trunc(y1) AS BIGINT), 0) AS y1, least(CAST(trunc(x2) AS BIGINT), width) AS x2,
         least(CAST(trunc(y2) AS BIGINT), height) AS y2 FROM v_boxes)
WHERE x2 > x1 AND y2 > y1
""")
def clip_boxes(c):
    boxes = M.clip_boxes(c.boxes)
    whole = [F.col(x).cast("bigint").alias(x) for x in ("x1", "y1", "x2", "y2")]
    return boxes.select("content_id", "image", "box_no", *whole)


@query("pixelate_plan", """
SELECT content_id, image, greatest(1, width // 200) AS grid_width, greatest(1, height // 200) AS grid_height
FROM v_media
""")
def pixelate_plan(c):
    return M.pixelate_plan(c.media)


@query("orphan_media", """
SELECT content_id, image FROM v_media WHERE content_id NOT IN (SELECT id FROM v_content_run1)
""")
def orphan_media(c):
    return M.orphan_media(c.media, c.view("v_content_run1")).select("content_id", "image")


@query("prune_media", """
SELECT content_id, image FROM v_media WHERE content_id IN (SELECT id FROM v_content_run1)
""")
def prune_media(c):
    return M.prune_media(c.media, c.view("v_content_run1")).select("content_id", "image")


@query("drop_flagged", "SELECT content_id, image FROM v_media WHERE NOT nsfw_score > 0.7e0")
def drop_flagged(c):
    return M.drop_flagged_media(c.media, M.flag_nsfw(_scores(c))).select("content_id", "image")


@query("media_file_count", "SELECT count(*) AS n_images FROM v_media")
def file_count(c):
    return media_file_count(c.media)


@query("audit_counters", """
SELECT count(*) AS total_images, count(*) FILTER (nsfw_score > 0.7e0) AS flagged_images FROM v_media
""")
def counters(c):
    return audit_counters(c.media, M.flag_nsfw(_scores(c)))


_KEPT = """
kept AS (
  SELECT m.content_id, m.image FROM v_media m JOIN v_content c ON c.id = m.content_id
  WHERE NOT m.nsfw_score > 0.7e0 AND m.readable)
"""


def _published(c):
    content = c.content.select("id", "author", "text", "has_media")
    flags = M.flag_nsfw(_scores(c))
    return publish_corpus(c.users, content, c.media, flags, c.boxes, F.col("readable"), hot=c.hot)


@query("publish_manifest", f"""
WITH {_KEPT}, blur AS (
  SELECT content_id, image, count(*) AS n FROM v_boxes
  WHERE least(trunc(x2), width) > greatest(trunc(x1), 0) AND least(trunc(y2), height) > greatest(trunc(y1), 0)
  GROUP BY content_id, image)
SELECT m.content_id, m.image,
       CASE WHEN k.image IS NULL THEN 'drop' WHEN b.n IS NOT NULL THEN 'blur' ELSE 'keep' END AS action,
       CASE WHEN k.image IS NULL THEN 0 ELSE coalesce(b.n, 0) END AS n_boxes
FROM v_media m LEFT JOIN kept k ON k.content_id = m.content_id AND k.image = m.image
LEFT JOIN blur b ON b.content_id = m.content_id AND b.image = m.image
""")
def publish_manifest(c):
    return _published(c).manifest


@query("publish_content", f"""
WITH {_KEPT}
SELECT id, author, text, has_media AND id IN (SELECT content_id FROM kept) AS has_media FROM v_content
""")
def publish_content(c):
    return _published(c).content
