"""Queries on words, scores and themes."""

from __future__ import annotations

from pyspark.sql import functions as F

from authorloom.functions.text import accent_table, tokenize
from authorloom.operators import words as W
from authorloom.operators.joins import label_content
from authorloom.plans.catalogue.registry import STOP_SQL, STOP_WORDS, query, rounded

_TOKENS = r"regexp_extract_all({text}, '[\p{{L}}\p{{N}}_]{{2,}}')"


def _token_sql(text: str) -> str:
    return _TOKENS.format(text=text)


def _ascii_sql(text: str) -> str:
    sources, targets, longer = accent_table()
    for char, plain in longer.items():
        text = f"replace({text}, '{char}', '{plain}')"
    quote = targets.replace("'", "''")
    return rf"regexp_replace(translate({text}, '{sources}', '{quote}'), '[^\x00-\x7F]', '', 'g')"


_LOWERED = "lower(text)"


@query("tokenize", f"""
SELECT id, term, count(*) AS n FROM (
  SELECT id, unnest({_token_sql(_LOWERED)}) AS term FROM v_content) WHERE term NOT IN {STOP_SQL}
GROUP BY id, term
""")
def tokens(c):
    rows = c.content.select("id", F.explode(tokenize(F.col("text"), STOP_WORDS)).alias("term"))
    return rows.groupBy("id", "term").agg(F.count(F.lit(1)).alias("n"))


@query("word_freq", f"""
SELECT term, count(*) AS n, count(DISTINCT id) AS n_docs FROM (
  SELECT id, unnest({_token_sql(_ascii_sql(_LOWERED))}) AS term FROM v_content) WHERE term NOT IN {STOP_SQL}
GROUP BY term HAVING count(DISTINCT id) >= 10 ORDER BY n DESC, term LIMIT 100
""")
def word_freq(c):
    return W.word_frequencies(c.content, STOP_WORDS)


@query("word_freq_by_label", f"""
SELECT has_label, term, n, n_docs FROM (
  SELECT *, row_number() OVER (PARTITION BY has_label ORDER BY n DESC, term) AS r FROM (
    SELECT has_label, term, count(*) AS n, count(DISTINCT id) AS n_docs FROM (
      SELECT c.id, u.has_label, unnest({_token_sql(_ascii_sql(_LOWERED))}) AS term
      FROM v_content c JOIN v_users u ON u.id = c.author) WHERE term NOT IN {STOP_SQL}
    GROUP BY has_label, term HAVING count(DISTINCT id) >= 10)) WHERE r <= 100
""")
def word_freq_by_label(c):
    return W.word_frequencies_by_label(label_content(c.content, c.users, c.hot), STOP_WORDS)


@query("sample_per_class", """
SELECT id, has_label FROM (
  SELECT c.id, u.has_label,
         row_number() OVER (PARTITION BY u.has_label ORDER BY sha256('22:' || c.id), c.id) AS r
  FROM v_content c JOIN v_users u ON u.id = c.author) WHERE r <= 200
""")
def sample(c):
    return W.sample_per_class(label_content(c.content, c.users, c.hot), 200).select("id", "has_label")


_LEXICON = {"function": ["the", "of", "and"], "verb": ["is", "was", "are"]}


@query("score_texts")
def score_texts(c):
    return W.score_texts(c.content, W.lexicon_scorer(_LEXICON), list(_LEXICON))


_SCORES = """
SELECT u.has_label, s.label, round(median(s.score), 6) AS median_score
FROM v_doc_scores s JOIN v_content c ON c.id = s.content_id JOIN v_users u ON u.id = c.author
"""


def _medians(c, exclude=()):
    classes = label_content(c.content.select("id", "author"), c.users, c.hot).select(
        F.col("id").alias("content_id"), "has_label"
    )
    medians = W.median_score_by_class(c.view("v_doc_scores"), classes, exclude)
    return rounded(medians, "median_score")


@query("median_scores", f"{_SCORES} GROUP BY u.has_label, s.label")
def median_scores(c):
    return _medians(c)


@query("median_scores_no_neutral", f"{_SCORES} WHERE s.label <> 'neutral' GROUP BY u.has_label, s.label")
def median_scores_no_neutral(c):
    return _medians(c, ["neutral"])


@query("theme_tokens", f"""
SELECT content_id, category, count(*) AS hits FROM (
  SELECT id AS content_id, unnest({_token_sql(_LOWERED)}) AS term FROM v_content) t
JOIN v_lexicon l ON l.term = t.term GROUP BY content_id, category
""")
def theme_tokens(c):
    return W.theme_tokens(c.content, c.lexicon)


@query("theme_means", f"""
WITH docs AS (
  SELECT c.id, u.has_label, {_token_sql(_LOWERED)} AS tokens FROM v_content c JOIN v_users u ON u.id = c.author),
hits AS (
  SELECT has_label, category, sum(w) AS w FROM (
    SELECT has_label, 1 / len(tokens) AS w, unnest(tokens) AS term FROM docs) t
  JOIN v_lexicon l ON l.term = t.term GROUP BY has_label, category),
sizes AS (SELECT has_label, count(*) AS n FROM docs GROUP BY has_label)
SELECT has_label, category, mean_freq FROM (
  SELECT h.has_label, h.category, round(w / n, 9) AS mean_freq,
         row_number() OVER (PARTITION BY h.has_label ORDER BY w / n DESC, category) AS r
  FROM hits h JOIN sizes s ON s.has_label = h.has_label) WHERE r <= 10
""")
def theme_means(c):
    return rounded(W.theme_means(label_content(c.content, c.users, c.hot), c.lexicon), "mean_freq", digits=9)
