"""Derived corpus views over the driver's tables, in SQL both engines read."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from authorloom.operators.skew import evaluate_once
from authorloom.sources.tables import read_parquet

VIEWS: dict[str, str] = {}

VIEWS["v_content"] = """
SELECT 'c' || CAST(d.doc_id AS STRING) AS id,
       'u' || CAST(e.user_id AS STRING) AS author,
       CASE WHEN e.event_type IN ('purchase','signup') THEN 'post' ELSE 'comment' END AS type,
       'r/' || d.source AS subreddit,
       d.text
         || CASE WHEN d.doc_id % 7  = 0 THEN ' see [a](http://x.example/a) and [b](http://x.example/b) now' ELSE '' END
         || CASE WHEN d.doc_id % 5  = 1 THEN ' thanks u/Some_User in R/topic9' ELSE '' END
         || CASE WHEN d.doc_id % 9  = 2 THEN ' I (25 F) met him (M 31)' ELSE '' END
         || CASE WHEN d.doc_id % 8  = 3 THEN ' >!hidden!< <image>' ELSE '' END
         || CASE WHEN d.doc_id % 13 = 4 THEN ' Last year I was diagnosed with Migraine' ELSE '' END
         || CASE WHEN d.doc_id % 17 = 5 THEN ' aspirin helps my migraine' ELSE '' END AS text,
       e.ts - ((e.user_id % 5) * 365 + (d.doc_id % 4) * 91) * INTERVAL '1' DAY AS timestamp,
       d.doc_id % 5 = 0 AS has_media,
       d.lang AS lang,
       l.toxic AS toxic
FROM documents d
JOIN events e ON e.event_id = d.doc_id
LEFT JOIN labels l ON l.doc_id = d.doc_id
"""

VIEWS["v_users"] = """
SELECT author AS id, max(coalesce(toxic, 0)) = 1 AS has_label, min(subreddit) AS first_found_in
FROM v_content GROUP BY author
"""

VIEWS["v_media"] = """
SELECT c.id AS content_id,
       'image' || CAST(n.r_regionkey + 1 AS STRING)
         || CASE CAST(substr(c.id, 2) AS BIGINT) % 3 WHEN 0 THEN '.png' WHEN 1 THEN '.webp' ELSE '.jpg' END AS image,
       400 + (CAST(substr(c.id, 2) AS BIGINT) * 37) % 900 AS width,
       300 + (CAST(substr(c.id, 2) AS BIGINT) * 53) % 700 AS height,
       CAST((CAST(substr(c.id, 2) AS BIGINT) * 29 + n.r_regionkey * 13) % 100 AS DOUBLE) / 100 AS nsfw_score,
       (CAST(substr(c.id, 2) AS BIGINT) + n.r_regionkey) % 3 AS n_faces,
       (CAST(substr(c.id, 2) AS BIGINT) * 3 + n.r_regionkey) % 19 <> 0 AS readable
FROM v_content c @EACH(n, r_regionkey, CAST(substr(c.id, 2) AS BIGINT) % 4 + 1)@
WHERE c.has_media
"""

VIEWS["v_doc_scores"] = """
SELECT c.id AS content_id, CASE s.k WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' ELSE 'neutral' END AS label,
       CASE s.k WHEN 0 THEN c.a WHEN 1 THEN c.b ELSE round(1 - c.a - c.b, 6) END AS score
FROM (SELECT id, CAST(length(text) % 50 AS DOUBLE) / 100 AS a, CAST((length(text) % 7) * 7 AS DOUBLE) / 100 AS b
      FROM v_content) c @EACH(s, k, 3)@
"""

VIEWS["v_raw"] = """
SELECT d.doc_id,
       't' || CAST(d.doc_id AS STRING) AS id,
       CASE WHEN d.doc_id % 23 = 0 THEN '[deleted]'
            WHEN d.doc_id % 29 = 0 THEN 'AutoModerator'
            WHEN d.doc_id % 31 = 0 THEN NULL
            ELSE 'name' || CAST(e.user_id AS STRING) END AS author,
       CASE WHEN d.doc_id % 19 = 0 THEN 'moderator' END AS distinguished,
       CASE WHEN e.event_type IN ('purchase','signup') THEN 'post' ELSE 'comment' END AS kind,
       'r/' || d.source AS subreddit_name_prefixed,
       CASE WHEN d.doc_id % 10 = 3 THEN 'I was diagnosed with Migraine' ELSE 'title ' || d.source END AS title,
       CASE d.doc_id % 12 WHEN 1 THEN '[removed]' WHEN 2 THEN '' WHEN 3 THEN NULL ELSE d.text END AS body,
       CASE WHEN d.doc_id % 37 = 0 THEN NULL ELSE 1546300800 + d.doc_id * 90061 END AS created_utc,
       d.doc_id % 4 <> 0 AS is_self,
       CASE d.doc_id % 3 WHEN 0 THEN 'https://i.redd.it/p' || CAST(d.doc_id AS STRING) || '.png?width=64&amp;s=1'
                         WHEN 1 THEN 'https://i.imgur.com/q' || CAST(d.doc_id AS STRING) || '.gif'
                         ELSE 'https://preview.redd.it/r' || CAST(d.doc_id AS STRING) || '.webp?x=1' END AS url
FROM documents d JOIN events e ON e.event_id = d.doc_id
"""

VIEWS["v_content_flagged"] = """
SELECT *, text LIKE '%igraine%' AS has_pattern FROM v_content
"""

VIEWS["v_users_known"] = """
SELECT id, has_label, first_found_in FROM v_users
UNION ALL SELECT 'quiet' || CAST(r_regionkey AS STRING), r_regionkey % 2 = 0, 'r/quiet' FROM region
"""

VIEWS["v_content_run1"] = """
SELECT *, text LIKE '%igraine%' AS has_pattern FROM v_content WHERE CAST(substr(id, 2) AS BIGINT) % 3 <> 0
"""

VIEWS["v_content_run2"] = """
SELECT id, author, type, subreddit, 'run2 ' || text AS text, timestamp, NOT has_media AS has_media, lang, toxic,
       NOT (text LIKE '%igraine%') AS has_pattern
FROM v_content WHERE CAST(substr(id, 2) AS BIGINT) % 3 <> 1
"""

VIEWS["v_users_run1"] = """
SELECT author AS id, max(coalesce(toxic, 0)) = 1 AS has_label, min(subreddit) AS first_found_in
FROM v_content_run1 GROUP BY author
"""

VIEWS["v_users_run2"] = """
SELECT author AS id, bool_or(has_pattern) AS has_label, max(subreddit) AS first_found_in
FROM v_content_run2 GROUP BY author
"""

VIEWS["v_boxes"] = """
SELECT m.content_id, m.image, m.width, m.height, n.r_regionkey AS box_no,
       CAST(n.r_regionkey * 150 AS DOUBLE) - 20.5e0 AS x1,
       CAST(n.r_regionkey * 90 AS DOUBLE) - 10.5e0 AS y1,
       CAST(n.r_regionkey * 150 AS DOUBLE) + CAST(m.width AS DOUBLE) / 2 + 0.5e0 AS x2,
       CASE WHEN m.height % 11 = 0 THEN -5e0 ELSE CAST(m.height AS DOUBLE) * 1.2e0 END AS y2
FROM v_media m @EACH(n, r_regionkey, m.n_faces)@
"""

VIEWS["v_answers"] = """
SELECT content_id, author, true_label,
       CASE form WHEN 0 THEN said WHEN 1 THEN '  ' || said || chr(10) WHEN 2 THEN 'assistant ' || said WHEN 3 THEN noise
                 WHEN 4 THEN 'Sure: {"label": "' || said || '", "confidence": ' || sure || '} ok ' || noise
                 WHEN 5 THEN '{"label": "' || said || '"}'
                 WHEN 6 THEN '{"label": "' || said || '", "confidence": "' || sure || '"}'
                 WHEN 7 THEN '{"label": "' || said || '", "confid'
                 WHEN 8 THEN '{"label": " ' || said || '", "confidence": ' || sure || '}'
                 WHEN 9 THEN '' ELSE '{"confidence": ' || sure || '}' END AS answer
FROM (
  SELECT c.id AS content_id, c.author, u.has_label AS true_label, length(c.text) % 11 AS form,
         CASE WHEN c.text LIKE '%a%b%' THEN CASE length(c.text) % 3 WHEN 0 THEN 'YES' WHEN 1 THEN 'no' ELSE 'Yes' END
              WHEN length(c.text) % 2 = 0 THEN 'No' ELSE 'perhaps' END AS said,
         CAST(CAST(length(c.text) % 140 AS DOUBLE) / 100 AS STRING) AS sure,
         replace(replace(substr(c.text, 1, 30), '{', ' '), '}', ' ') AS noise
  FROM v_content c JOIN v_users u ON u.id = c.author)
"""

VIEWS["v_doc_proba"] = """
SELECT c.id AS content_id, c.author, u.has_label AS has_label,
       CAST((length(c.text) * 7 + CAST(substr(c.id, 2) AS BIGINT) * 13) % 101 AS DOUBLE) / 100 AS proba
FROM v_content c JOIN v_users u ON u.id = c.author
"""

VIEWS["v_lexicon"] = """
SELECT * FROM (VALUES ('function','the'), ('function','of'), ('function','and'), ('pronoun','it'), ('pronoun','he'),
                      ('verb','is'), ('verb','was'), ('verb','are'), ('insult','worthless'), ('health','migraine'))
         AS t(category, term)
"""


def each(sql: str, spark: bool) -> str:
    """Write out ``@EACH(alias, column, n)@``: every row once for each number below n, without a join."""
    form = (
        r"LATERAL VIEW explode(filter(sequence(0, CAST(\3 AS INT)), x -> x < \3)) \1 AS \2"
        if spark
        else r", unnest(range(0, \3)) AS \1(\2)"
    )
    return re.sub(r"@EACH\((\w+), (\w+), (.*?)\)@", form, sql)


TABLES = ("region", "documents", "events", "labels")


def needed(names: dict[str, str], sql: str) -> list[str]:
    """Names used by a text, directly or through others, in definition order."""
    wanted: set[str] = set()
    queue = [sql]
    while queue:
        body = queue.pop()
        for name in names:
            if name not in wanted and re.search(rf"\b{name}\b", body):
                wanted.add(name)
                queue.append(names[name])
    return [n for n in names if n in wanted]


def _between(view: str, start: str, stop: str) -> str:
    return VIEWS[view].split(start, 1)[1].split(stop, 1)[0]


# What Spark reads in place of some views: the same expressions of the same rows, taken from the text before it is joined.
_TEXT = _between("v_content", "AS subreddit,", " AS text,")
_TITLE = _between("v_raw", "AS subreddit_name_prefixed,", " AS title,")
_BODY = _between("v_raw", "AS title,", " AS body,")
_READ = _between("v_answers", "u.has_label AS true_label,", "FROM v_content")
_ANSWER = _between("v_answers", "SELECT content_id, author, true_label,", " AS answer")
_SLOW = "c.text LIKE '%a%b%'"
"""As a pattern it tries every place again where no b follows."""
_FAST = "(instr(c.text, 'a') > 0 AND instr(substr(c.text, instr(c.text, 'a')), 'b') > 0)"


class Corpus:
    """The views as lazy DataFrames over one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            path = f"{self.folder}/{name}.parquet"
            text = name == "documents"
            self._tables[name] = read_parquet(self.spark, path) if text else self.spark.read.parquet(path)
        return self._tables[name]

    def view(self, name: str) -> DataFrame:
        tables = {t: self.table(t) for t in TABLES if re.search(rf"\b{t}\b", self._closure(name))}
        parts = [f"{v} AS ({VIEWS[v]})" for v in needed(VIEWS, VIEWS[name])]
        body = VIEWS[name]
        sql = each(f"WITH {', '.join(parts)} {body}" if parts else body, spark=True)
        if not tables:
            return self.spark.sql(sql)
        sql = sql.replace("{", "{{").replace("}", "}}")
        for table in tables:
            sql = re.sub(rf"\b(FROM|JOIN) {table}\b", rf"\1 {{{table}}}", sql)
        return self.spark.sql(sql, **tables)

    def _closure(self, name: str) -> str:
        return " ".join(VIEWS[v] for v in [*needed(VIEWS, VIEWS[name]), name])

    @property
    def _texts(self) -> DataFrame:
        """Documents with the text that content has."""
        return evaluate_once(self.table("documents").alias("d"), text=F.expr(_TEXT))

    def _content(self, documents: DataFrame, columns: list[str]) -> DataFrame:
        """``v_content`` with columns of ``documents`` in place of its text.

        Rows meet on the id that content has, so a later step by id finds them in place."""
        sql = VIEWS["v_content"].replace(f"{_TEXT} AS text", " " + ", ".join(f"d.{c}" for c in columns))
        for before, after in (
            ("'c' || CAST(d.doc_id AS STRING) AS id", "d._id AS id"),
            ("FROM documents d", "FROM {documents} d"),
            ("JOIN events e ON e.event_id = d.doc_id", "JOIN {events} e ON e._id = d._id"),
            ("JOIN labels l ON l.doc_id = d.doc_id", "JOIN {labels} l ON l._id = d._id"),
        ):
            assert before in sql, before
            sql = sql.replace(before, after)

        def keyed(table: DataFrame, key: str) -> DataFrame:
            return table.withColumn("_id", F.concat(F.lit("c"), F.col(key).cast("string")))

        return self.spark.sql(
            sql,
            documents=keyed(documents, "doc_id"),
            events=keyed(self.table("events"), "event_id"),
            labels=keyed(self.table("labels"), "doc_id"),
        )

    def content_with(self, **columns: Column) -> DataFrame:
        """Content with columns made of ``text`` in place of it: they are made before the joins, which move no text."""
        return self._content(evaluate_once(self._texts, **columns), list(columns))

    @cached_property
    def content(self) -> DataFrame:
        return self._content(self._texts, ["text"])

    @property
    def own_texts(self) -> DataFrame:
        """(id, lang, text) of documents under the id they have as content, where their texts are read."""
        return self._texts.select(F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("id"), "lang", "text")

    def of_content(self, rows: DataFrame) -> DataFrame:
        """Rows, by id, of the documents that are content: those with an event."""
        events = self.table("events").select(F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("id"))
        return rows.join(events, "id", "left_semi")

    @cached_property
    def flagged(self) -> DataFrame:
        """``v_content_flagged`` without its text."""
        return self.content_with(has_pattern=F.expr("text LIKE '%igraine%'"))

    @cached_property
    def answers(self) -> DataFrame:
        """``v_answers``: each answer is written out where its text is read, once."""
        read = f"SELECT c.*, {_READ.replace(_SLOW, _FAST)} FROM {{c}} c".replace("'{'", "'{{'").replace("'}'", "'}}'")
        parts = ["form", "said", "sure", "noise"]
        told = evaluate_once(self.spark.sql(read, c=self._texts), **{p: F.col(p) for p in parts})
        content = self._content(evaluate_once(told, answer=F.expr(_ANSWER)), ["answer"])
        users = self.users.select(F.col("id").alias("author"), F.col("has_label").alias("true_label"))
        return content.join(users, "author").select(F.col("id").alias("content_id"), "author", "true_label", "answer")

    @cached_property
    def users(self) -> DataFrame:
        return self.view("v_users")

    @cached_property
    def media(self) -> DataFrame:
        return self.view("v_media")

    @cached_property
    def raw(self) -> DataFrame:
        return self.view("v_raw")

    @property
    def raw_texts(self) -> DataFrame:
        """Documents with the title and the body that raw items have."""
        texts = self.table("documents").alias("d")
        return texts.select("doc_id", "source", F.expr(_TITLE).alias("title"), F.expr(_BODY).alias("body"))

    def raw_of(self, documents: DataFrame, columns: list[str]) -> DataFrame:
        """``v_raw`` of the rows of ``documents``, with columns of theirs in place of title and body."""
        sql = VIEWS["v_raw"].replace(f"{_TITLE} AS title,", "").replace(f"{_BODY} AS body", ", ".join(f"d.{c}" for c in columns))
        sql = sql.replace("FROM documents d JOIN events e", "FROM {documents} d JOIN {events} e")
        return self.spark.sql(sql, documents=documents, events=self.table("events"))

    @cached_property
    def boxes(self) -> DataFrame:
        return self.view("v_boxes")

    @cached_property
    def lexicon(self) -> DataFrame:
        return self.view("v_lexicon")
