"""Queries on labels, merging and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from authorloom.operators import joins as J
from authorloom.operators.merge import last_per_id, merge_content, merge_users
from authorloom.operators.selfreport import flag_pattern, relabel
from authorloom.plans.catalogue.registry import PATTERN, PATTERN_SQL, query

_HIT = f"regexp_matches(text, {PATTERN_SQL})"


@query("flag_pattern", f"SELECT id, {_HIT} AS has_pattern FROM v_content")
def flag(c):
    return flag_pattern(c.content, PATTERN).select("id", "has_pattern")


_FOUND = f"found AS (SELECT author, bool_or({_HIT}) AS hit FROM v_content_flagged GROUP BY author)"


@query("relabel", f"""
WITH {_FOUND}
SELECT u.id, u.has_label OR coalesce(f.hit, false) AS has_label, u.first_found_in
FROM v_users u LEFT JOIN found f ON f.author = u.id
""")
def relabel_users(c):
    return relabel(c.users, c.view("v_content_flagged"), PATTERN)[0]


@query("relabel_rewrite", f"""
WITH {_FOUND}
SELECT u.id, coalesce(f.hit, false) AS has_label, u.first_found_in
FROM v_users u LEFT JOIN found f ON f.author = u.id
""")
def relabel_rewrite(c):
    return relabel(c.users, c.view("v_content_flagged"), PATTERN, rewrite=True)[0]


@query("relabel_content", f"SELECT id, author, has_pattern OR {_HIT} AS has_pattern FROM v_content_flagged")
def relabel_content(c):
    return relabel(c.users, c.view("v_content_flagged"), PATTERN)[1].select("id", "author", "has_pattern")


@query("merge_users", """
SELECT coalesce(a.id, b.id) AS id, coalesce(a.has_label, false) OR coalesce(b.has_label, false) AS has_label,
       CASE WHEN a.id IS NOT NULL THEN a.first_found_in ELSE b.first_found_in END AS first_found_in
FROM v_users_run1 a FULL JOIN v_users_run2 b ON a.id = b.id
""")
def users_merged(c):
    return merge_users(c.view("v_users_run1"), c.view("v_users_run2"))


def _first(column: str) -> str:
    return f"CASE WHEN a.id IS NOT NULL THEN a.{column} ELSE b.{column} END AS {column}"


@query("merge_content", f"""
SELECT coalesce(a.id, b.id) AS id, {", ".join(_first(x) for x in
        ("author", "type", "subreddit", "text", "toxic", "has_pattern"))},
       coalesce(a.has_media, false) OR coalesce(b.has_media, false) AS has_media
FROM v_content_run1 a FULL JOIN v_content_run2 b ON a.id = b.id
""")
def content_merged(c):
    columns = ["id", "author", "type", "subreddit", "text", "toxic", "has_pattern", "has_media"]
    first = c.view("v_content_run1").select(columns)
    return merge_content(first, c.view("v_content_run2").select(columns))


@query("last_per_id", """
SELECT id, text, has_media FROM v_content_run2
UNION ALL
SELECT id, text, has_media FROM v_content_run1 WHERE id NOT IN (SELECT id FROM v_content_run2)
""")
def last_row(c):
    one = c.view("v_content_run1").select("id", "text", "has_media", F.lit(1).alias("seq"))
    two = c.view("v_content_run2").select("id", "text", "has_media", F.lit(2).alias("seq"))
    return last_per_id(one.unionByName(two), "seq")


@query("author_content", """
SELECT c.id AS content_id, u.id AS author, u.has_label, u.first_found_in, c.type
FROM v_users_known u LEFT JOIN v_content c ON c.author = u.id
""")
def author_content(c):
    content = c.content.select("id", "author", "type")
    return J.author_content(c.view("v_users_known"), content, c.hot).select(
        "content_id", "author", "has_label", "first_found_in", "type"
    )


@query("orphan_content", """
SELECT id, author FROM v_content WHERE author IN (SELECT id FROM v_users WHERE has_label)
""")
def orphan_content(c):
    return J.drop_orphan_content(c.content.select("id", "author"), c.users.where("has_label"), c.hot)


@query("empty_users", """
SELECT id, has_label FROM v_users WHERE id IN (SELECT author FROM v_content WHERE type = 'post')
""")
def empty_users(c):
    posts = c.content.where(F.col("type") == "post")
    return J.drop_empty_users(c.users, posts).select("id", "has_label")
