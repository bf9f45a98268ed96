"""Registration of a query with its check SQL, and the SQL views that check reads."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from authorloom.functions import patterns as P
from authorloom.functions.phrases import compile_phrases
from authorloom.functions.text import collapse_ws
from authorloom.operators.cleaning import with_text_counts
from authorloom.operators.enrich import enrich_users
from authorloom.operators.selfreport import flag_pattern
from authorloom.operators.skew import evaluate_once, hot_table
from authorloom.plans.curate import clean_content, rewritten_content
from authorloom.plans.fixtures import VIEWS, Corpus, each, needed
from authorloom.session import materialise

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

CONDITION = "migraine"
SYNONYMS = ["migraine", "cluster headache"]
PHRASES = ["I was diagnosed with migraine", "? helps my migraine", "I have ? migraine"]
PATTERN = compile_phrases(PHRASES, CONDITION, SYNONYMS)
_NAMED = "(?:migraine|cluster headache)"
PATTERN_SQL = (
    rf"'(?i)\b(?:i was diagnosed with {_NAMED}|[\w''-]+ helps my {_NAMED}|i have [\w''-]+ {_NAMED})\b'"
)
STOP_WORDS = (
    "a an and are as at be but by for from has have he her his i if in is it its me my no not of on or "
    "our she so that the their them they this to was we were will with you your"
).split()
STOP_SQL = "(" + ", ".join(f"'{w}'" for w in STOP_WORDS) + ")"


def quoted(pattern: str, ignore_case: bool = False) -> str:
    """A pattern as a SQL string."""
    return "'" + P.re2(pattern, ignore_case).replace("'", "''") + "'"


WS = quoted(P.WHITESPACE_RUN)


def flat_sql(text: str) -> str:
    return f"trim(regexp_replace({text}, {WS}, ' ', 'g'))"


def clean_sql(text: str) -> str:
    out = f"replace({text}, '<image>', '')"
    for pattern, blind in (
        (P.LINK_GREEDY, False), (P.MENTION, True), (P.SPOILER, False), (P.AGE_GENDER, True)
    ):
        out = f"regexp_replace({out}, {quoted(pattern, blind)}, '', 'g')"
    return flat_sql(out)


# Views that only the check SQL uses.
CHECK_VIEWS: dict[str, str] = {name: each(sql, spark=False) for name, sql in VIEWS.items()}
CHECK_VIEWS["o_flat"] = f"""
SELECT id, author, type, subreddit, text, timestamp, has_media, lang, toxic,
       regexp_matches(text, {PATTERN_SQL}) AS has_pattern
FROM (SELECT * REPLACE ({flat_sql("text")} AS text) FROM v_content)
"""
CHECK_VIEWS["o_clean"] = f"""
SELECT *, length(text) AS char_count,
       CASE WHEN text = '' THEN 0 ELSE len(string_split(text, ' ')) END AS word_count
FROM (SELECT * REPLACE ({clean_sql("text")} AS text) FROM o_flat)
WHERE text <> '' OR has_media
"""
CHECK_VIEWS["o_counted"] = """
SELECT *, length(text) AS char_count,
       CASE WHEN text = '' THEN 0 ELSE len(string_split(text, ' ')) END AS word_count
FROM o_flat
"""
CHECK_VIEWS["o_labelled"] = """
SELECT c.*, u.has_label, u.first_found_in FROM o_counted c JOIN v_users u ON u.id = c.author
"""
CHECK_VIEWS["o_experiment"] = """
SELECT c.*, u.has_label, u.first_found_in, n.n_content FROM o_clean c JOIN v_users u ON u.id = c.author
JOIN (SELECT author, count(*) AS n_content FROM o_clean GROUP BY author) n ON n.author = c.author
"""
CHECK_VIEWS["o_split"] = """
SELECT author, has_label,
       CASE WHEN r * 100 <= n * 70 THEN 'train' WHEN r * 100 <= n * 85 THEN 'val' ELSE 'test' END AS split
FROM (SELECT author, has_label,
             row_number() OVER (PARTITION BY has_label ORDER BY sha256('22:' || author), author) AS r,
             count(*) OVER (PARTITION BY has_label) AS n
      FROM (SELECT DISTINCT author, has_label FROM o_experiment WHERE NOT has_pattern AND text <> ''))
"""


class Inputs(Corpus):
    """Corpus views with the tables most queries start from."""

    @property
    def flat(self) -> DataFrame:
        """Content as ingest leaves it: flat text and a disclosure flag."""
        rows = evaluate_once(self.content, text=collapse_ws(F.col("text")))
        return flag_pattern(rows, PATTERN)

    @cached_property
    def hot(self) -> DataFrame | None:
        """Very active authors: content is part of the events, so their counts bound it."""
        authors = self.table("events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("author"))
        return hot_table(authors, "author")

    @property
    def counted(self) -> DataFrame:
        return with_text_counts(self.flat)

    @property
    def rewritten(self) -> DataFrame:
        """Cleaned rows before unknown authors are dropped; the views have none."""
        return rewritten_content(self.flat, language=None)

    @cached_property
    def written(self) -> DataFrame:
        """The same, written once for queries that read it several times: texts are cleaned in one pass."""
        return materialise(self.rewritten, "cleaned")

    @property
    def enriched(self) -> DataFrame:
        """Users with the number and the length statistics of all their cleaned content."""
        return enrich_users(self.users, self.rewritten)

    @property
    def clean(self) -> DataFrame:
        return clean_content(self.users, self.flat, hot=self.hot, language=None)


def query(name: str, sql: str | None = None):
    """Register ``fn(inputs) -> DataFrame``; ``sql`` may start with WITH."""

    def register(fn: Callable[[Inputs], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"registered twice: {name}")
        QUERIES[name] = lambda spark, folder: fn(Inputs(spark, folder))
        if sql is not None:
            body = sql.strip()
            views = [f"{v} AS ({CHECK_VIEWS[v].strip()})" for v in needed(CHECK_VIEWS, body)]
            if body.upper().startswith("WITH"):
                views.append(body[4:].strip())
                ORACLES[name] = "WITH " + ",\n".join(views)
            else:
                ORACLES[name] = ("WITH " + ",\n".join(views) + "\n" if views else "") + body
        return fn

    return register


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Round real columns whose last digits depend on the order of summing."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})
