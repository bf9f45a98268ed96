"""Queries comparing author groups and following them over time."""

from __future__ import annotations

from pyspark.sql import functions as F

from authorloom.operators import compare as C
from authorloom.operators import timeline as T
from authorloom.operators.enrich import author_counts
from authorloom.operators.joins import label_content
from authorloom.plans.catalogue.registry import query, rounded

_COUNTS = """
counts AS (
  SELECT author, count(*) FILTER (type = 'post') AS n_posts, count(*) FILTER (type = 'comment') AS n_comments
  FROM v_content GROUP BY author)
"""


@query("profile", """
SELECT 'users' AS table_name, count(*) AS n_rows, CAST(3 AS BIGINT) AS n_columns,
       'id,has_label,first_found_in' AS column_names FROM v_users
UNION ALL
SELECT 'content', count(*), CAST(9 AS BIGINT),
       'id,author,type,subreddit,text,timestamp,has_media,lang,toxic' FROM v_content
""")
def profile(c):
    return C.profile({"users": c.users, "content": c.content})


@query("label_distribution", "SELECT has_label, count(*) AS n FROM v_users GROUP BY has_label")
def label_distribution(c):
    return C.distribution(c.users, "has_label")


@query("source_by_label", """
SELECT first_found_in, count(*) FILTER (NOT has_label) AS n_control, count(*) FILTER (has_label) AS n_label
FROM v_users GROUP BY first_found_in
""")
def source_by_label(c):
    return C.source_by_label(c.users)


@query("pattern_distribution", "SELECT has_pattern, count(*) AS n FROM o_flat GROUP BY has_pattern")
def pattern_distribution(c):
    return C.distribution(c.flat, "has_pattern")


@query("media_distribution", "SELECT has_media, count(*) AS n FROM v_content GROUP BY has_media")
def media_distribution(c):
    return C.distribution(c.content, "has_media")


def _profiles(c):
    counts = author_counts(c.content).withColumnRenamed("author", "id")
    return c.users.join(counts, "id")


@query("content_by_label", f"""
WITH {_COUNTS}
SELECT has_label, CAST(sum(n_posts) AS BIGINT) AS n_posts, CAST(sum(n_comments) AS BIGINT) AS n_comments,
       CAST(sum(n_posts + n_comments) AS BIGINT) AS n_total
FROM v_users u JOIN counts c ON c.author = u.id GROUP BY has_label
""")
def content_by_label(c):
    return C.content_by_label(_profiles(c))


@query("top_communities", """
SELECT subreddit, count(*) AS n FROM v_content WHERE subreddit IS NOT NULL
GROUP BY subreddit ORDER BY n DESC, subreddit LIMIT 10
""")
def top_communities(c):
    return C.top_communities(c.content)


def _box_sql(values: str, digits: int = 6) -> str:
    """Box statistics of (metric, has_label, value) rows."""
    names = ("q1", "median", "q3", "whisker_low", "whisker_high")
    outs = ", ".join(f"round({n}, {digits}) AS {n}" for n in names)
    return f"""
    vals AS ({values}),
    grouped AS (
      SELECT metric, 'all' AS grp, CAST(value AS DOUBLE) AS v FROM vals UNION ALL
      SELECT metric, CASE WHEN has_label THEN 'label' ELSE 'control' END, CAST(value AS DOUBLE) FROM vals),
    q AS (
      SELECT metric, grp, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median,
             quantile_cont(v, 0.75) AS q3 FROM grouped GROUP BY metric, grp),
    boxed AS (
      SELECT g.metric, g.grp, count(*) AS n, q1, median, q3,
             least(min(v) FILTER (v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), q1) AS whisker_low,
             greatest(max(v) FILTER (v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), q3)
               AS whisker_high,
             count(*) FILTER (v NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS n_fliers
      FROM grouped g JOIN q ON q.metric = g.metric AND q.grp = g.grp
      GROUP BY g.metric, g.grp, q1, median, q3)
    SELECT metric, grp, n, {outs}, n_fliers FROM boxed
    """


_BOX = ("q1", "median", "q3", "whisker_low", "whisker_high")


@query("box_stats_counts", f"WITH {_COUNTS}, " + _box_sql("""
SELECT 'n_posts' AS metric, has_label, n_posts AS value FROM v_users u JOIN counts c ON c.author = u.id
UNION ALL SELECT 'n_comments', has_label, n_comments FROM v_users u JOIN counts c ON c.author = u.id
"""))
def box_stats_counts(c):
    return rounded(C.box_stats(_profiles(c), ["n_posts", "n_comments"]), *_BOX)


_MEDIANS = """
medians AS (
  SELECT author, type, median(char_count) AS median_chars, median(word_count) AS median_words
  FROM o_counted GROUP BY author, type)
"""


@query("author_median_length", f"""
WITH {_MEDIANS}
SELECT author, type, median_chars, median_words, has_label FROM medians m LEFT JOIN v_users u ON u.id = m.author
""")
def author_median_length(c):
    return C.author_median_length(c.counted, c.users)


@query("box_stats_length", f"WITH {_MEDIANS}, " + _box_sql("""
SELECT 'chars_' || type AS metric, has_label, median_chars AS value
FROM medians m JOIN v_users u ON u.id = m.author
UNION ALL SELECT 'words_' || type, has_label, median_words FROM medians m JOIN v_users u ON u.id = m.author
"""))
def box_stats_length(c):
    lengths = C.author_median_length(c.counted, c.users)
    by_kind = [
        F.when(F.col("type") == kind, F.col(f"median_{m}")).alias(f"{m}_{kind}")
        for m in ("chars", "words")
        for kind in ("post", "comment")
    ]
    wide = lengths.select("has_label", *by_kind)
    return rounded(C.box_stats(wide, wide.columns[1:]), *_BOX)


_DAYS = """
days AS (
  SELECT author, count(DISTINCT CAST(timestamp AS DATE)) AS unique_days,
         min(CAST(timestamp AS DATE)) AS first_day, max(CAST(timestamp AS DATE)) AS last_day
  FROM v_content GROUP BY author),
ratios AS (
  SELECT author, unique_days, unique_days / (date_diff('day', first_day, last_day) + 1) AS activity_ratio FROM days)
"""


@query("box_stats_activity", f"WITH {_DAYS}, " + _box_sql("""
SELECT 'activity_ratio' AS metric, has_label, activity_ratio AS value
FROM ratios r JOIN v_users u ON u.id = r.author
"""))
def box_stats_activity(c):
    ratio = T.activity_ratio(c.content, c.users)
    return rounded(C.box_stats(ratio, ["activity_ratio"], wide=True), *_BOX)


_MEDIA = """
media AS (
  SELECT author, has_label, count(*) FILTER (has_media) AS media_count
  FROM v_content c JOIN v_users u ON u.id = c.author GROUP BY author, has_label)
"""


@query("media_per_author", f"WITH {_MEDIA} SELECT author, has_label, media_count FROM media")
def media_per_author(c):
    return C.media_per_author(c.content, c.users)


@query("box_stats_media", f"WITH {_MEDIA}, " + _box_sql(
    "SELECT 'media_count' AS metric, has_label, media_count AS value FROM media"
))
def box_stats_media(c):
    return rounded(C.box_stats(C.media_per_author(c.content, c.users), ["media_count"]), *_BOX)


@query("community_media_rate", """
SELECT subreddit, count(has_media) AS total_posts, count(*) FILTER (has_media) AS media_posts,
       round(count(*) FILTER (has_media) / count(has_media) * 100, 6) AS media_percentage
FROM v_content WHERE starts_with(subreddit, 'r/') GROUP BY subreddit HAVING count(has_media) >= 10
ORDER BY count(*) FILTER (has_media) / count(has_media) * 100 DESC, subreddit LIMIT 10
""")
def community_media_rate(c):
    return rounded(C.community_media_rate(c.content), "media_percentage")


@query("distinct_days", f"""
WITH {_DAYS}
SELECT author, unique_days, CAST(first_day AS VARCHAR) AS first_day, CAST(last_day AS VARCHAR) AS last_day
FROM days
""")
def distinct_days(c):
    days = C.distinct_days(c.content)
    return days.withColumns({x: F.col(x).cast("string") for x in ("first_day", "last_day")})


@query("distinct_labels", "SELECT DISTINCT author, has_label FROM o_labelled")
def distinct_labels(c):
    return C.distinct_labels(label_content(c.content.select("id", "author"), c.users, c.hot))


@query("median_posts_by_group", f"""
WITH {_COUNTS}, g AS (
  SELECT 'all' AS grp, n_posts FROM v_users u JOIN counts c ON c.author = u.id UNION ALL
  SELECT CASE WHEN has_label THEN 'label' ELSE 'control' END, n_posts FROM v_users u JOIN counts c ON c.author = u.id)
SELECT grp, median(n_posts) AS median FROM g GROUP BY grp
""")
def median_posts(c):
    return C.median_by_group(_profiles(c), "n_posts")


@query("yearly_content", """
SELECT year(timestamp) AS year, count(*) FILTER (type = 'post') AS n_posts,
       count(*) FILTER (type = 'comment') AS n_comments
FROM v_content GROUP BY year(timestamp)
""")
def yearly_content(c):
    return T.yearly_content(c.content)


def _yearly_sql(values: str, name: str) -> str:
    """Median per label and year of (author, year, v) rows, 0 for an absent label."""
    return f"""
    vals AS ({values}),
    years AS (SELECT DISTINCT year FROM vals),
    m AS (SELECT year, has_label, median(v) AS m FROM vals JOIN v_users u ON u.id = vals.author
          GROUP BY year, has_label)
    SELECT y.year, l.has_label, coalesce(m.m, 0) AS {name}
    FROM years y CROSS JOIN (SELECT true AS has_label UNION ALL SELECT false) l
    LEFT JOIN m ON m.year = y.year AND m.has_label = l.has_label
    """


@query("yearly_median_content", "WITH " + _yearly_sql(
    "SELECT author, year(timestamp) AS year, count(*) AS v FROM v_content GROUP BY author, year(timestamp)",
    "median_content",
))
def yearly_median_content(c):
    return T.yearly_median_content(c.content, c.users)


def _yearly_length_sql(kind: str) -> str:
    return _yearly_sql(
        f"""SELECT author, year(timestamp) AS year, median(word_count) AS v FROM o_counted
            WHERE type = '{kind}' GROUP BY author, year(timestamp)""",
        "median_words",
    )


@query("yearly_median_length_post", "WITH " + _yearly_length_sql("post"))
def yearly_median_length_post(c):
    return T.yearly_median_length(c.counted, c.users, "post")


@query("yearly_median_length_comment", "WITH " + _yearly_length_sql("comment"))
def yearly_median_length_comment(c):
    return T.yearly_median_length(c.counted, c.users, "comment")


@query("activity_ratio", f"""
WITH {_DAYS}
SELECT author, unique_days, round(activity_ratio, 6) AS activity_ratio, has_label
FROM ratios r JOIN v_users u ON u.id = r.author
""")
def activity_ratio(c):
    return rounded(T.activity_ratio(c.content, c.users), "activity_ratio")


_DAILY = """
daily AS (
  SELECT author, median(n) AS median_daily
  FROM (SELECT author, CAST(timestamp AS DATE) AS day, count(*) AS n FROM v_content GROUP BY ALL) GROUP BY author)
"""


@query("median_daily", f"""
WITH {_DAILY}
SELECT author, median_daily, has_label FROM daily d JOIN v_users u ON u.id = d.author
""")
def median_daily(c):
    return T.median_daily_content(c.content, c.users)


@query("box_stats_daily", f"WITH {_DAILY}, " + _box_sql("""
SELECT 'median_daily' AS metric, has_label, median_daily AS value FROM daily d JOIN v_users u ON u.id = d.author
"""))
def box_stats_daily(c):
    return rounded(C.box_stats(T.median_daily_content(c.content, c.users), ["median_daily"]), *_BOX)
