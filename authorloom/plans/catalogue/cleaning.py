"""Queries on cleaning and enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from authorloom.functions.text import clean_text, collapse_ws
from authorloom.operators.cleaning import drop_empty, language_filter, refresh_has_media, with_text_counts
from authorloom.operators.enrich import author_counts, author_length_stats
from authorloom.operators.langid import detect_language, filter_detected, language_profiles
from authorloom.plans.catalogue.registry import PATTERN, PATTERN_SQL, clean_sql, flat_sql, query, rounded
from authorloom.plans.curate import clean_corpus, curate

STATS = [
    f"{m}_{s}_{k}" for m in ("char", "word") for s in ("mean", "median", "std") for k in ("comment", "post")
]
_SQL_FN = {"mean": "avg", "median": "median", "std": "stddev_samp"}


def _stat_sql(name: str) -> str:
    measure, stat, kind = name.split("_")
    return f"round(CAST({_SQL_FN[stat]}({measure}_count) FILTER (type = '{kind}') AS DOUBLE), 6) AS {name}"


_STATS_SQL = ", ".join(_stat_sql(s) for s in STATS)
_COUNTS_SQL = """count(*) FILTER (type = 'post') AS n_posts, count(*) FILTER (type = 'comment') AS n_comments,
       count(*) AS n_content"""


@query("users_enriched", f"""
SELECT u.id, u.has_label, u.first_found_in, a.* EXCLUDE (author)
FROM v_users u JOIN (SELECT author, {_COUNTS_SQL}, {_STATS_SQL} FROM o_clean GROUP BY author) a ON a.author = u.id
""")
def users_enriched(c):
    return rounded(clean_corpus(c.users, c.flat, language=None)[0], *STATS)


_RUNS = ("author", "type", "subreddit", "text", "timestamp", "lang", "has_pattern")
_HIT = f"regexp_matches(text, {PATTERN_SQL})"
_CURATED = f"""
merged AS (
  SELECT coalesce(a.id, b.id) AS id,
         {", ".join(f"CASE WHEN a.id IS NOT NULL THEN a.{x} ELSE b.{x} END AS {x}" for x in _RUNS)},
         coalesce(a.has_media, false) OR coalesce(b.has_media, false) AS has_media
  FROM v_content_run1 a FULL JOIN v_content_run2 b ON a.id = b.id),
hits AS (SELECT author, bool_or({_HIT}) AS hit FROM merged GROUP BY author),
named AS (
  SELECT u.id, u.has_label OR coalesce(h.hit, false) AS has_label, u.first_found_in
  FROM (SELECT coalesce(a.id, b.id) AS id, coalesce(a.has_label, false) OR coalesce(b.has_label, false) AS has_label,
               CASE WHEN a.id IS NOT NULL THEN a.first_found_in ELSE b.first_found_in END AS first_found_in
        FROM v_users_run1 a FULL JOIN v_users_run2 b ON a.id = b.id) u
  LEFT JOIN hits h ON h.author = u.id),
cleaned AS (
  SELECT *, length(text) AS char_count,
         CASE WHEN text = '' THEN 0 ELSE len(string_split(text, ' ')) END AS word_count
  FROM (SELECT * REPLACE ({clean_sql("text")} AS text)
        FROM (SELECT * REPLACE (has_pattern OR {_HIT} AS has_pattern) FROM merged WHERE lang = 'en' OR has_media))
  WHERE text <> '' OR has_media)
"""


def _curated(c):
    """Two runs, merged, labelled again, in one language, rewritten, media flags refreshed, enriched."""
    columns = ["id", "author", "type", "subreddit", "text", "timestamp", "has_pattern", "has_media", "lang"]
    runs = tuple((c.view(f"v_users_run{n}"), c.view(f"v_content_run{n}").select(columns)) for n in (1, 2))
    return curate(runs, PATTERN, c.media.where("readable"), language="en", hot=c.hot)


@query("curate_users", f"""
WITH {_CURATED}
SELECT u.*, a.* EXCLUDE (author)
FROM named u JOIN (SELECT author, {_COUNTS_SQL}, {_STATS_SQL} FROM cleaned GROUP BY author) a ON a.author = u.id
""")
def curated_users(c):
    return rounded(_curated(c)[0], *STATS)


@query("curate_content", f"""
WITH {_CURATED}
SELECT id, author, type, subreddit, text, has_pattern,
       has_media AND id IN (SELECT content_id FROM v_media WHERE readable) AS has_media,
       CAST(char_count AS BIGINT) AS char_count, CAST(word_count AS BIGINT) AS word_count
FROM cleaned WHERE author IN (SELECT id FROM named)
""")
def curated_content(c):
    rows = _curated(c)[1].drop("timestamp")
    return rows.withColumns({x: F.col(x).cast("bigint") for x in ("char_count", "word_count")})


@query("author_counts", f"SELECT author, {_COUNTS_SQL} FROM o_clean GROUP BY author")
def counts(c):
    return author_counts(c.rewritten)


@query("author_length_stats", f"SELECT author, {_STATS_SQL} FROM o_clean GROUP BY author")
def length_stats(c):
    return rounded(author_length_stats(c.rewritten), *STATS)


@query("text_counts", """
SELECT id, CAST(char_count AS BIGINT) AS char_count, CAST(word_count AS BIGINT) AS word_count FROM o_counted
""")
def text_counts(c):
    rows = with_text_counts(c.flat)
    return rows.select("id", F.col("char_count").cast("bigint"), F.col("word_count").cast("bigint"))


@query("clean_text", f"SELECT id, {clean_sql(flat_sql('text'))} AS text FROM v_content")
def cleaned_text(c):
    return c.content.select("id", clean_text(collapse_ws(F.col("text"))).alias("text"))


@query("clean_content", """
SELECT id, author, type, subreddit, text, has_pattern, has_media,
       CAST(char_count AS BIGINT) AS char_count, CAST(word_count AS BIGINT) AS word_count
FROM o_clean
""")
def cleaned_content(c):
    rows = c.clean.drop("timestamp")
    return rows.withColumns({x: F.col(x).cast("bigint") for x in ("char_count", "word_count")})


@query("drop_empty", """
SELECT id, text, has_media FROM (
  SELECT id, has_media, CASE WHEN length(text) % 11 = 0 THEN '' WHEN length(text) % 11 <> 1 THEN text END AS text
  FROM v_content)
WHERE text IS NOT NULL AND (text <> '' OR has_media)
""")
def empties_dropped(c):
    part = F.length("text") % 11
    text = F.when(part == 0, F.lit("")).when(part != 1, F.col("text"))
    return drop_empty(c.content.select("id", text.alias("text"), "has_media"))


@query("lang_filter", "SELECT id, lang FROM v_content WHERE lang = 'en' OR has_media")
def lang_filter(c):
    return language_filter(c.content).select("id", "lang")


_GRAMS = """
g AS (
  SELECT id, lang, gram FROM (
    SELECT id, lang, unnest(list_transform(range(1, len(l) - 1), lambda i: l[i] || l[i + 1] || l[i + 2])) AS gram
    FROM (SELECT id, lang, regexp_extract_all(
                   ' ' || trim(regexp_replace(lower(text), '[^\\p{L}]+', ' ', 'g')) || ' ', '.') AS l
          FROM v_content))),
top AS (
  SELECT lang, gram, n FROM (
    SELECT lang, gram, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) AS r
    FROM (SELECT lang, gram, count(*) AS n FROM g GROUP BY lang, gram)) WHERE r <= 400),
profile AS (
  SELECT lang, gram, CAST(round(ln((n / sum(n) OVER (PARTITION BY lang)) * 1e6) * 1000) AS BIGINT) AS gain FROM top),
best AS (
  SELECT id, lang FROM (
    SELECT g.id, p.lang, row_number() OVER (PARTITION BY g.id ORDER BY sum(p.gain) DESC, p.lang) AS r
    FROM g JOIN profile p ON p.gram = g.gram GROUP BY g.id, p.lang) WHERE r = 1)
"""


@query("lang_profiles", f"WITH {_GRAMS} SELECT lang, gram, gain FROM profile")
def profiles(c):
    return language_profiles(c.content)


@query("lang_detect", f"WITH {_GRAMS} SELECT id, lang FROM best")
def detected(c):
    return c.of_content(detect_language(c.own_texts, language_profiles(c.content)))


@query("lang_filter_detected", f"""
WITH {_GRAMS}
SELECT c.id, c.has_media FROM v_content c LEFT JOIN best b ON b.id = c.id WHERE b.lang = 'en' OR c.has_media
""")
def detected_filter(c):
    return filter_detected(c.content, language_profiles(c.content), texts=c.own_texts).select("id", "has_media")


_HALF = "CAST(substr(id, 2) AS BIGINT) % 2"
_HALF_GRAMS = _GRAMS.replace("FROM g GROUP BY lang, gram", f"FROM g WHERE {_HALF} = 0 GROUP BY lang, gram")


@query("lang_accuracy", f"""
WITH {_HALF_GRAMS}
SELECT c.lang, b.lang AS found, count(*) AS n FROM v_content c JOIN best b ON b.id = c.id WHERE {_HALF.replace("id", "c.id")} = 1
GROUP BY c.lang, b.lang
""")
def lang_accuracy(c):
    """Profiles from one half of the rows, judged on the other."""
    half = F.expr(_HALF)
    rest = c.content.where(half == 1).select("id", "lang")
    found = detect_language(c.own_texts.where(half == 1), language_profiles(c.content.where(half == 0)))
    judged = rest.join(found.withColumnRenamed("lang", "found"), "id")
    return judged.groupBy("lang", "found").agg(F.count(F.lit(1)).alias("n"))


@query("refresh_has_media", """
SELECT id, has_media AND id IN (SELECT content_id FROM v_media WHERE readable) AS has_media FROM v_content
""")
def media_flag(c):
    return refresh_has_media(c.content.select("id", "has_media"), c.media.where("readable"))
