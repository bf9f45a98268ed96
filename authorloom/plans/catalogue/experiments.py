"""Queries on author-classification experiments."""

from __future__ import annotations

from pyspark.sql import functions as F

from authorloom.operators import answers as A
from authorloom.operators import bag_of_words as B
from authorloom.operators import evaluation as E
from authorloom.operators import prompts as P
from authorloom.operators.enrich import enrich_users
from authorloom.operators.linear import text_classifier_lr
from authorloom.operators.skew import skew_join
from authorloom.operators.split import (
    TrainConfig,
    experiment_base,
    stratified_author_split,
    train_filter,
)

from authorloom.plans.catalogue.registry import STOP_SQL, STOP_WORDS, query, rounded
from authorloom.plans.experiments import as_dataset, bag_of_words_scores, evaluate_answers, run_grid, split_rows
from authorloom.session import materialise

CONFIG = TrainConfig("all")
FILTERED = TrainConfig("filtered", ("r/web",), min_words=29, min_content=6)


def _base(c):
    return experiment_base(enrich_users(c.users, c.written), c.written, c.hot)


def _rows(c):
    return split_rows(enrich_users(c.users, c.written), c.written, hot=c.hot)


@query("experiment_base", """
SELECT id, author, has_label, first_found_in, type FROM o_experiment WHERE NOT has_pattern AND text <> ''
""")
def base(c):
    return _base(c).select("id", "author", "has_label", "first_found_in", "type")


@query("author_split", "SELECT author, has_label, split FROM o_split")
def split(c):
    return stratified_author_split(_base(c))


_ROWS = """
base_rows AS (
  SELECT l.*, s.split
  FROM o_experiment l JOIN o_split s ON s.author = l.author WHERE NOT l.has_pattern AND l.text <> '')
"""


@query("train_filter", f"""
WITH {_ROWS}
SELECT id, author, split FROM base_rows
WHERE split <> 'train' OR (first_found_in <> 'r/web' AND word_count >= 29 AND n_content >= 6)
""")
def filtered(c):
    return train_filter(_rows(c), FILTERED).select("id", "author", "split")


_FIT = rf"""
{_ROWS},
train_tokens AS (
  SELECT id, has_label, term FROM (
    SELECT id, has_label, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term
    FROM base_rows WHERE split = 'train') WHERE term NOT IN {STOP_SQL}),
docs AS (
  SELECT count(*) AS n, count(*) FILTER (has_label) AS n1, count(*) FILTER (NOT has_label) AS n0
  FROM base_rows WHERE split = 'train'),
terms AS (
  SELECT term, count(*) FILTER (NOT has_label) AS tf_0, count(*) FILTER (has_label) AS tf_1,
         count(DISTINCT id) AS df, count(*) AS n
  FROM train_tokens GROUP BY term),
vocab AS (
  SELECT term, tf_0, tf_1, df, n FROM terms
  WHERE df >= 2 AND df <= 0.95e0 * (SELECT n FROM docs) ORDER BY n DESC, term LIMIT 5000),
sizes AS (SELECT sum(tf_0) AS n0, sum(tf_1) AS n1, count(*) AS v FROM vocab),
model AS (
  SELECT term, ln((tf_0 + 1) / (s.n0 + s.v)) AS log_0, ln((tf_1 + 1) / (s.n1 + s.v)) AS log_1
  FROM vocab CROSS JOIN sizes s
  UNION ALL SELECT '', ln(n0 / n), ln(n1 / n) FROM docs)
"""


def _vocab(c):
    train = _rows(c).where(F.col("split") == "train")
    return B.fit_vocab(materialise(B.train_terms(train, [CONFIG], STOP_WORDS)))


@query("vocab", f"""
WITH {_FIT}
SELECT 'all' AS experiment_name, term, tf_0, tf_1, df, n FROM vocab
""")
def vocab(c):
    return _vocab(c).drop("docs_0", "docs_1")


_LOGS = ("log_0", "log_1")


@query("nb_model", f"""
WITH {_FIT}
SELECT 'all' AS experiment_name, term, {", ".join(f"round({x}, 6) AS {x}" for x in _LOGS)} FROM model
""")
def nb_model(c):
    return rounded(B.fit_naive_bayes(_vocab(c)), *_LOGS)


_SCORED = rf"""
{_FIT},
tokens AS (
  SELECT id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term
  FROM base_rows WHERE split <> 'train'),
sums AS (
  SELECT t.id, sum(m.log_1 - m.log_0) AS s FROM tokens t JOIN model m ON m.term = t.term GROUP BY t.id),
odds AS (
  SELECT b.id, b.author, b.has_label, b.split,
         least(greatest(coalesce(s.s, 0) + (SELECT log_1 - log_0 FROM model WHERE term = ''), -700), 700) AS o
  FROM base_rows b LEFT JOIN sums s ON s.id = b.id WHERE b.split <> 'train'),
scored AS (
  SELECT id, author, has_label, split, 1 / (1 + exp(-o)) AS proba,
         CASE WHEN split = 'val' THEN 'validation' ELSE 'test' END AS dataset,
         CAST(CASE WHEN o > 0 THEN 1 ELSE 0 END AS BIGINT) AS predicted FROM odds)
"""


def _scores(c):
    return bag_of_words_scores(_rows(c), [CONFIG], STOP_WORDS)


@query("nb_predict", f"""
WITH {_SCORED}
SELECT id, author, has_label, split, round(proba, 6) AS proba, predicted FROM scored
""")
def nb_predict(c):
    scores = rounded(_scores(c), "proba").withColumn("predicted", F.col("predicted").cast("bigint"))
    return scores.select("id", "author", "has_label", "split", "proba", "predicted")


def _auc_sql(rows: str, keys: str, truth: str, score: str) -> str:
    """Rank-sum area per key; pairs with equal scores count half."""
    return f"""
    SELECT {keys}, CASE WHEN pos * neg = 0 THEN 0.5e0 ELSE (rank_sum - pos * (pos + 1) / 2) / (pos * neg) END AS roc_auc
    FROM (
      SELECT {keys}, count(*) FILTER ({truth}) AS pos, count(*) FILTER (NOT {truth}) AS neg,
             sum(avg_rank) FILTER ({truth}) AS rank_sum
      FROM (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY {score})
                      + (count(*) OVER (PARTITION BY {keys}, {score}) - 1) / 2 AS avg_rank FROM {rows})
      GROUP BY {keys})
    """


_METRICS = """
(tp + tn) / (tp + tn + fp + fn) AS accuracy,
CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1,
CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS "precision",
CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS recall
"""


def _counts_sql(rows: str, keys: str, truth: str, guess: str) -> str:
    return f"""
    SELECT {keys}, count(*) FILTER (NOT {truth} AND NOT {guess}) AS tn,
           count(*) FILTER (NOT {truth} AND {guess}) AS fp,
           count(*) FILTER ({truth} AND NOT {guess}) AS fn, count(*) FILTER ({truth} AND {guess}) AS tp
    FROM {rows} GROUP BY {keys}
    """


_RATES = ("accuracy", "f1", "precision", "recall")
_ROUND_RATES = ", ".join(f'round("{m}", 6) AS "{m}"' for m in _RATES)


@query("content_metrics", f"""
WITH {_SCORED},
rounded_scores AS (SELECT * REPLACE (round(proba, 6) AS proba) FROM scored),
auc AS ({_auc_sql("rounded_scores", "split", "has_label", "proba")}),
counts AS ({_counts_sql("scored", "split", "has_label", "(predicted = 1)")}),
rates AS (SELECT *, {_METRICS} FROM counts)
SELECT r.split, tn, fp, fn, tp, {_ROUND_RATES}, round(roc_auc, 6) AS roc_auc
FROM rates r JOIN auc a ON a.split = r.split
""")
def content_metrics(c):
    # counts and ranks both read the scores
    scores = materialise(rounded(_scores(c), "proba").select("split", "has_label", "predicted", "proba"), "scores")
    metrics = E.binary_metrics(scores, ["split"], "has_label", "predicted", "proba")
    return rounded(metrics, *_RATES, "roc_auc")


@query("softmax", """
SELECT content_id, round(1 / (1 + exp(-(b - a))), 6) AS proba, CAST(CASE WHEN b > a THEN 1 ELSE 0 END AS BIGINT) AS predicted
FROM (SELECT content_id, proba * 4 - 2 AS a, 1 - proba * 3 AS b FROM v_doc_proba)
""")
def softmax(c):
    logits = F.array(F.col("proba") * 4 - 2, 1 - F.col("proba") * 3)
    out = E.logits_to_proba(c.view("v_doc_proba").withColumn("logits", logits))
    return rounded(out, "proba").select("content_id", "proba", F.col("predicted").cast("bigint"))


_PROBA = """
doc_rows AS (
  SELECT d.author, d.has_label, d.proba, CASE WHEN s.split = 'val' THEN 'validation' ELSE 'test' END AS dataset
  FROM v_doc_proba d JOIN o_split s ON s.author = d.author WHERE s.split <> 'train'),
authors AS (
  SELECT 'all' AS experiment_name, dataset, author, bool_or(has_label) AS true_label,
         round(avg(proba), 9) AS predicted_probability
  FROM doc_rows GROUP BY dataset, author)
"""


def _proba_rows(c):
    """Given text probabilities of validation and test authors."""
    split = stratified_author_split(_base(c)).where(F.col("split") != "train").drop("has_label")
    proba = c.view("v_doc_proba")
    rows = skew_join(proba, split, "author", hot=c.hot, spread_by="content_id")
    rows = rows.withColumn("dataset", as_dataset())
    return rows.withColumn("experiment_name", F.lit("all"))


def _authors(c):
    return materialise(E.author_mean_proba(_proba_rows(c), digits=9))


@query("author_mean_proba", f"""
WITH {_PROBA}
SELECT experiment_name, dataset, author, true_label, predicted_probability FROM authors
""")
def author_mean_proba(c):
    return _authors(c)


_GRID = "(VALUES " + ", ".join(f"({t!r}e0)" for t in E.THRESHOLDS) + ") AS g(threshold)"
_SWEEP = f"""
{_PROBA},
pairs AS (
  SELECT threshold, true_label, predicted_probability >= threshold AS guess
  FROM authors CROSS JOIN {_GRID} WHERE dataset = 'validation'),
sweep AS (SELECT *, {_METRICS} FROM ({_counts_sql("pairs", "threshold", "true_label", "guess")})),
best AS (
  SELECT coalesce(max(CASE WHEN r = 1 AND f1 > 0 THEN threshold END), 0.5e0) AS best_threshold,
         max(CASE WHEN r = 1 AND f1 > 0 THEN accuracy END) AS val_accuracy,
         max(CASE WHEN r = 1 AND f1 > 0 THEN f1 END) AS val_f1,
         max(CASE WHEN r = 1 AND f1 > 0 THEN "precision" END) AS val_precision,
         max(CASE WHEN r = 1 AND f1 > 0 THEN recall END) AS val_recall
  FROM (SELECT *, row_number() OVER (ORDER BY f1 DESC, threshold) AS r FROM sweep
        WHERE tn + fp > 0 AND fn + tp > 0))
"""


def _sweep(c):
    return E.threshold_sweep(_authors(c).where(F.col("dataset") == "validation"))


@query("threshold_sweep", f"""
WITH {_SWEEP}
SELECT 'all' AS experiment_name, threshold, tn, fp, fn, tp, {_ROUND_RATES} FROM sweep
""")
def threshold_sweep(c):
    return rounded(_sweep(c), *_RATES)


@query("threshold_grid", f"""
WITH {_SWEEP}
SELECT threshold, count(*) AS n_authors, count(*) FILTER (guess) AS n_reached FROM pairs GROUP BY threshold
""")
def threshold_grid(c):
    sweep = _sweep(c)
    return sweep.select(
        "threshold",
        (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).alias("n_authors"),
        (F.col("fp") + F.col("tp")).alias("n_reached"),
    )


_BEST_COLUMNS = ("val_accuracy", "val_f1", "val_precision", "val_recall")
_ROUND_BEST = ", ".join(f"round({x}, 6) AS {x}" for x in _BEST_COLUMNS)


@query("best_threshold", f"""
WITH {_SWEEP}
SELECT 'all' AS experiment_name, best_threshold, {_ROUND_BEST} FROM best
""")
def best_threshold(c):
    return rounded(E.best_threshold(_sweep(c)), *_BEST_COLUMNS)


_PREDICTED = f"""
{_SWEEP},
predicted AS (
  SELECT a.*, predicted_probability >= (SELECT best_threshold FROM best) AS guess FROM authors a),
counts AS ({_counts_sql("predicted", "dataset", "true_label", "guess")}),
rates AS (SELECT *, {_METRICS} FROM counts),
auc AS ({_auc_sql("predicted", "dataset", "true_label", "predicted_probability")})
"""


def _predicted(c):
    authors = _authors(c)
    best = E.best_threshold(E.threshold_sweep(authors.where(F.col("dataset") == "validation")))
    return E.apply_threshold(authors, best)


@query("predictions", f"""
WITH {_PREDICTED}
SELECT experiment_name, author, CAST(true_label AS BIGINT) AS true_label, predicted_probability,
       CAST(guess AS BIGINT) AS predicted_label, dataset FROM predicted
""")
def predictions(c):
    rows = E.author_predictions(_predicted(c))
    return rows.withColumns({x: F.col(x).cast("bigint") for x in ("true_label", "predicted_label")})


@query("binary_metrics", f"""
WITH {_PREDICTED}
SELECT 'all' AS experiment_name, r.dataset, tn, fp, fn, tp, {_ROUND_RATES}, round(roc_auc, 6) AS roc_auc
FROM rates r JOIN auc a ON a.dataset = r.dataset
""")
def binary_metrics(c):
    return rounded(E.binary_metrics(_predicted(c)), *_RATES, "roc_auc")


@query("roc_auc", f"""
WITH d AS (SELECT author, has_label, proba, has_label AS truth FROM v_doc_proba),
k AS (SELECT substr(author, length(author), 1) AS digit, truth, proba FROM d),
auc AS ({_auc_sql("k", "digit", "truth", "proba")})
SELECT digit, round(roc_auc, 9) AS roc_auc FROM auc
""")
def roc_auc(c):
    rows = c.view("v_doc_proba").withColumn("digit", F.substring("author", -1, 1))
    return rounded(E.roc_auc(rows, ["digit"], "has_label", "proba"), "roc_auc", digits=9)


_MATRIX = """'[[' || CAST(tn AS STRING) || ', ' || CAST(fp AS STRING) || '], [' || CAST(fn AS STRING) || ', '
       || CAST(tp AS STRING) || ']]'"""


@query("confusion", f"WITH {_PREDICTED} SELECT dataset, {_MATRIX} AS confusion_matrix FROM counts")
def confusion(c):
    counts = E.confusion_counts(
        _predicted(c), ["dataset"], F.col("true_label"), F.col("predicted_label") == 1
    )
    return counts.select("dataset", E.confusion_text().alias("confusion_matrix"))


_RESULT_COLUMNS = [
    "val_accuracy", "val_f1", "val_precision", "val_recall", "val_roc_auc",
    "test_accuracy", "test_f1", "test_precision", "test_recall", "test_roc_auc",
]


@query("experiment_result", f"""
WITH {_PREDICTED}
SELECT 'given' AS experiment_type, CAST(1 AS BIGINT) AS version, 'all' AS experiment_name, best_threshold,
       {_ROUND_BEST}, round((SELECT roc_auc FROM auc WHERE dataset = 'validation'), 6) AS val_roc_auc,
       round(accuracy, 6) AS test_accuracy, round(f1, 6) AS test_f1, round("precision", 6) AS test_precision,
       round(recall, 6) AS test_recall, round((SELECT roc_auc FROM auc WHERE dataset = 'test'), 6) AS test_roc_auc,
       {_MATRIX} AS test_confusion_matrix, tn + fp + fn + tp AS num_users_test,
       (SELECT tn + fp + fn + tp FROM counts WHERE dataset = 'validation') AS num_users_val
FROM rates CROSS JOIN best WHERE dataset = 'test'
""")
def experiment_result(c):
    result = E.experiment_result(_authors(c), "given")
    return rounded(result, *_RESULT_COLUMNS).withColumn("version", F.col("version").cast("bigint"))


GRID_CONFIGS = (
    TrainConfig("all"),
    TrainConfig("all_long", (), min_words=29, min_content=3),
    TrainConfig("some", ("r/src0", "r/src1")),
    TrainConfig("some_long", ("r/src0", "r/src1"), min_words=29, min_content=3),
)
_SOME = "first_found_in NOT IN ('r/src0', 'r/src1')"
_LONG = "word_count >= 29 AND n_content >= 3"
_GRID_TRAIN = " UNION ALL ".join(
    f"SELECT '{name}' AS cfg, id, has_label, text FROM base_rows WHERE split = 'train' AND {condition}"
    for name, condition in (("all", "true"), ("all_long", _LONG), ("some", _SOME), ("some_long", f"{_SOME} AND {_LONG}"))
)
_GRID_SQL = rf"""
{_ROWS},
train AS ({_GRID_TRAIN}),
docs AS (
  SELECT cfg, count(*) AS n, count(*) FILTER (has_label) AS n1, count(*) FILTER (NOT has_label) AS n0
  FROM train GROUP BY cfg),
terms AS (
  SELECT cfg, term, count(*) FILTER (NOT has_label) AS tf_0, count(*) FILTER (has_label) AS tf_1,
         count(DISTINCT id) AS df, count(*) AS n
  FROM (SELECT cfg, id, has_label, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term FROM train)
  WHERE term NOT IN {STOP_SQL} GROUP BY cfg, term),
vocab AS (
  SELECT * FROM (
    SELECT t.*, row_number() OVER (PARTITION BY t.cfg ORDER BY t.n DESC, term) AS r
    FROM terms t JOIN docs d ON d.cfg = t.cfg WHERE df >= 2 AND df <= 0.95e0 * d.n) WHERE r <= 5000),
sizes AS (SELECT cfg, sum(tf_0) AS n0, sum(tf_1) AS n1, count(*) AS v FROM vocab GROUP BY cfg),
model AS (
  SELECT s.cfg, term, ln((tf_1 + 1) / (s.n1 + s.v)) - ln((tf_0 + 1) / (s.n0 + s.v)) AS w
  FROM vocab JOIN sizes s ON s.cfg = vocab.cfg),
held AS (SELECT id, author, has_label, split, text FROM base_rows WHERE split <> 'train'),
sums AS (
  SELECT m.cfg, t.id, sum(m.w) AS s
  FROM (SELECT id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term FROM held) t
  JOIN model m ON m.term = t.term GROUP BY m.cfg, t.id),
authors AS (
  SELECT d.cfg, CASE WHEN split = 'val' THEN 'validation' ELSE 'test' END AS dataset, author,
         bool_or(has_label) AS true_label,
         round(avg(1 / (1 + exp(-(coalesce(s.s, 0) + ln(d.n1 / d.n) - ln(d.n0 / d.n))))), 9) AS predicted_probability
  FROM held h CROSS JOIN docs d LEFT JOIN sums s ON s.cfg = d.cfg AND s.id = h.id GROUP BY d.cfg, split, author),
pairs AS (
  SELECT cfg, threshold, true_label, predicted_probability >= threshold AS guess
  FROM authors CROSS JOIN {_GRID} WHERE dataset = 'validation'),
sweep AS (SELECT *, {_METRICS} FROM ({_counts_sql("pairs", "cfg, threshold", "true_label", "guess")})),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY cfg ORDER BY f1 DESC, threshold) AS r FROM sweep
  WHERE tn + fp > 0 AND fn + tp > 0),
best AS (
  SELECT d.cfg, coalesce(threshold, 0.5e0) AS best_threshold, accuracy AS val_accuracy, f1 AS val_f1,
         "precision" AS val_precision, recall AS val_recall
  FROM docs d LEFT JOIN ranked k ON k.cfg = d.cfg AND k.r = 1 AND k.f1 > 0),
predicted AS (
  SELECT a.*, predicted_probability >= best_threshold AS guess FROM authors a JOIN best b ON b.cfg = a.cfg),
counts AS ({_counts_sql("predicted", "cfg, dataset", "true_label", "guess")}),
rates AS (SELECT *, {_METRICS} FROM counts),
auc AS ({_auc_sql("predicted", "cfg, dataset", "true_label", "predicted_probability")})
"""


def _grid(c):
    return run_grid(_rows(c), GRID_CONFIGS, digits=9, stop_words=STOP_WORDS)


@query("grid_results", f"""
WITH {_GRID_SQL}
SELECT 'bag_of_words' AS experiment_type, CAST(1 AS BIGINT) AS version, t.cfg AS experiment_name, best_threshold,
       {_ROUND_BEST}, CASE WHEN val_f1 IS NOT NULL THEN round(va.roc_auc, 6) END AS val_roc_auc,
       round(accuracy, 6) AS test_accuracy, round(f1, 6) AS test_f1, round("precision", 6) AS test_precision,
       round(recall, 6) AS test_recall, round(ta.roc_auc, 6) AS test_roc_auc,
       {_MATRIX} AS test_confusion_matrix, tn + fp + fn + tp AS num_users_test, v.n AS num_users_val
FROM rates t JOIN best b ON b.cfg = t.cfg
JOIN auc ta ON ta.cfg = t.cfg AND ta.dataset = 'test'
JOIN auc va ON va.cfg = t.cfg AND va.dataset = 'validation'
JOIN (SELECT cfg, tn + fp + fn + tp AS n FROM counts WHERE dataset = 'validation') v ON v.cfg = t.cfg
WHERE t.dataset = 'test'
""")
def grid_results(c):
    """Four configurations from text to result rows, on a model's own probabilities."""
    return rounded(_grid(c)[1], *_RESULT_COLUMNS).withColumn("version", F.col("version").cast("bigint"))


@query("grid_predictions", f"""
WITH {_GRID_SQL}
SELECT cfg AS experiment_name, author, CAST(true_label AS BIGINT) AS true_label,
       round(predicted_probability, 6) AS predicted_probability, CAST(guess AS BIGINT) AS predicted_label, dataset
FROM predicted
""")
def grid_predictions(c):
    rows = rounded(_grid(c)[0], "predicted_probability")
    return rows.withColumns({x: F.col(x).cast("bigint") for x in ("true_label", "predicted_label")})


_PROMPT = P.PromptTemplate(
    positive="YES", negative="NO", role="Be an expert.", task="Does the author write {positive} or {negative}?",
    answer="Say {positive} or {negative}.", answer_confidence="JSON with label and confidence.",
)


@query("prompts", """
SELECT id, 'plain' AS strategy, concat_ws(chr(10), 'Does the author write YES or NO?', 'Text: ' || text,
       'Say YES or NO.') AS prompt FROM o_flat
UNION ALL
SELECT id, 'expert', concat_ws(chr(10), 'Be an expert.', 'Does the author write YES or NO?', 'Text: ' || text,
       'Say YES or NO.') FROM o_flat
UNION ALL
SELECT id, 'plain_confidence', concat_ws(chr(10), 'Does the author write YES or NO?', 'Text: ' || text,
       'JSON with label and confidence.') FROM o_flat
UNION ALL
SELECT id, 'expert_confidence', concat_ws(chr(10), 'Be an expert.', 'Does the author write YES or NO?',
       'Text: ' || text, 'JSON with label and confidence.') FROM o_flat
""")
def prompts(c):
    strategies = [s for s in P.STRATEGIES if s != "few_shot"]
    made = P.build_all_prompts(c.flat.select("id", "text"), strategies, _PROMPT)
    return made.select("id", "strategy", "prompt")


_SHOTS = f"""
{_ROWS},
shots AS (
  SELECT id, text, has_label FROM (
    SELECT id, text, has_label,
           row_number() OVER (PARTITION BY has_label ORDER BY sha256('22:' || id), id) AS r
    FROM base_rows WHERE split = 'train') WHERE r <= 2)
"""


@query("few_shot", f"WITH {_SHOTS} SELECT id, text, has_label FROM shots")
def few_shot(c):
    return P.few_shot_examples(_rows(c).where(F.col("split") == "train"))


@query("few_shot_prompts", f"""
WITH {_SHOTS},
shown AS (
  SELECT string_agg('Text: ' || text || chr(10) || 'Label: ' || CASE WHEN has_label THEN 'YES' ELSE 'NO' END, chr(10)
                    ORDER BY NOT has_label, id) AS s FROM shots)
SELECT id, concat_ws(chr(10), 'Does the author write YES or NO?', 'Solved examples:', (SELECT s FROM shown),
                     'Text: ' || text, 'Say YES or NO.') AS prompt
FROM base_rows WHERE split <> 'train'
""")
def few_shot_prompts(c):
    rows = _rows(c)
    examples = P.few_shot_examples(rows.where(F.col("split") == "train"))
    held_out = rows.where(F.col("split") != "train")
    return P.build_prompts(held_out, "few_shot", _PROMPT, examples).select("id", "prompt")


_FIRST_IMAGES = """
first_images AS (
  SELECT content_id, list(image ORDER BY image) AS images FROM (
    SELECT content_id, image, row_number() OVER (PARTITION BY content_id ORDER BY image) AS r FROM v_media)
  WHERE r <= 3 GROUP BY content_id)
"""


@query("attach_images", f"""
WITH {_FIRST_IMAGES}
SELECT c.id, CASE WHEN c.has_media THEN coalesce(array_to_string(f.images, ','), '') ELSE '' END AS images
FROM v_content c LEFT JOIN first_images f ON f.content_id = c.id
""")
def attach_images(c):
    rows = P.attach_images(c.content.select("id", "has_media"), c.media)
    return rows.select("id", F.array_join("images", ",").alias("images"))


@query("chat_messages", f"""
WITH {_FIRST_IMAGES}, shown AS (
  SELECT c.id, CASE WHEN c.has_media THEN coalesce(len(f.images), 0) ELSE 0 END AS n,
         concat_ws(chr(10), 'Does the author write YES or NO?', 'Text: ' || c.text, 'Say YES or NO.') AS prompt
  FROM o_flat c LEFT JOIN first_images f ON f.content_id = c.id)
SELECT id, 'user' AS role, slot, CASE WHEN slot < n THEN 'image' ELSE 'text' END AS type,
       CASE WHEN slot >= n THEN prompt END AS text
FROM (SELECT *, unnest(range(0, n + 1)) AS slot FROM shown)
""")
def chat_messages(c):
    prompted = P.build_prompts(c.flat.select("id", "text", "has_media"), "plain", _PROMPT)
    turns = P.chat_messages(P.attach_images(prompted, c.media)).select("id", F.inline("messages"))
    return turns.select("id", "role", F.posexplode("content").alias("slot", "part")).select(
        "id", "role", F.col("slot").cast("bigint"), "part.type", "part.text"
    )


_NORMAL = """
normal AS (
  SELECT *, trim(replace(lower(trim(answer, e' \\t\\r\\n')), 'assistant', ''), e' \\t\\r\\n') AS told FROM v_answers)
"""
_PLAIN = f"""
{_NORMAL},
plain AS (SELECT *, CASE told WHEN 'yes' THEN 1 WHEN 'no' THEN 0 ELSE -1 END AS label FROM normal)
"""


@query("parse_label", f"""
WITH {_PLAIN}
SELECT content_id, CAST(label AS BIGINT) AS label, CASE WHEN label = -1 THEN 0e0 ELSE 1e0 END AS confidence FROM plain
""")
def parse_label(c):
    rows = A.parse_label(c.answers)
    return rows.select("content_id", F.col("label").cast("bigint"), "confidence")


_CONFIDENT = rf"""
{_NORMAL},
found AS (SELECT *, regexp_extract(told, '(?s)\{{.*\}}', 0) AS j FROM normal),
read AS (
  SELECT *, trim(json_extract_string(j, '$.label')) AS name,
         CASE WHEN json_type(j, '$.confidence') IS NULL THEN 0.5e0
              WHEN json_type(j, '$.confidence') IN ('DOUBLE', 'UBIGINT', 'BIGINT')
              THEN CAST(json_extract(j, '$.confidence') AS DOUBLE) END AS given
  FROM found WHERE json_valid(j)),
judged AS (
  SELECT content_id, CASE WHEN given BETWEEN 0 AND 1 AND name = 'yes' THEN 1
                          WHEN given BETWEEN 0 AND 1 AND name = 'no' THEN 0 ELSE -1 END AS label, given FROM read),
confident AS (
  SELECT n.content_id, n.author, n.true_label, coalesce(g.label, -1) AS label,
         CASE WHEN coalesce(g.label, -1) = -1 THEN 0e0 ELSE g.given END AS confidence
  FROM normal n LEFT JOIN judged g ON g.content_id = n.content_id)
"""


@query("parse_json_answer", f"""
WITH {_CONFIDENT}
SELECT content_id, CAST(label AS BIGINT) AS label, confidence FROM confident
""")
def parse_json_answer(c):
    rows = A.parse_json_answer(c.answers)
    return rows.select("content_id", F.col("label").cast("bigint"), F.col("confidence").cast("double"))


@query("weighted_share", f"""
WITH {_CONFIDENT}
SELECT author, bool_or(true_label) AS true_label,
       round(CASE WHEN sum(confidence) = 0 THEN 0.5e0 ELSE sum(label * confidence) / sum(confidence) END, 6)
       AS predicted_probability
FROM confident GROUP BY author
""")
def weighted_share(c):
    return A.author_weighted_share(A.parse_json_answer(c.answers), digits=6)


_ZERO_SHOT = _PREDICTED.replace(_PROBA, f"""
{_CONFIDENT},
authors AS (
  SELECT 'zs' AS experiment_name, dataset, author, bool_or(true_label) AS true_label,
         round(CASE WHEN sum(confidence) = 0 THEN 0.5e0 ELSE sum(label * confidence) / sum(confidence) END, 9)
         AS predicted_probability
  FROM (SELECT c.*, CASE WHEN s.split = 'val' THEN 'validation' ELSE 'test' END AS dataset
        FROM confident c JOIN o_split s ON s.author = c.author WHERE s.split <> 'train')
  GROUP BY dataset, author)
""")


@query("zero_shot_results", f"""
WITH {_ZERO_SHOT}
SELECT 'zero_shot' AS experiment_type, CAST(1 AS BIGINT) AS version, 'zs' AS experiment_name, best_threshold,
       {_ROUND_BEST}, round((SELECT roc_auc FROM auc WHERE dataset = 'validation'), 6) AS val_roc_auc,
       round(accuracy, 6) AS test_accuracy, round(f1, 6) AS test_f1, round("precision", 6) AS test_precision,
       round(recall, 6) AS test_recall, round((SELECT roc_auc FROM auc WHERE dataset = 'test'), 6) AS test_roc_auc,
       {_MATRIX} AS test_confusion_matrix, tn + fp + fn + tp AS num_users_test,
       (SELECT tn + fp + fn + tp FROM counts WHERE dataset = 'validation') AS num_users_val
FROM rates CROSS JOIN best WHERE dataset = 'test'
""")
def zero_shot_results(c):
    """From the answers of an external model to its result row."""
    split = stratified_author_split(_base(c)).where(F.col("split") != "train").drop("has_label")
    answers = skew_join(c.answers, split, "author", hot=c.hot, spread_by="content_id")
    _, results = evaluate_answers(answers.withColumn("experiment_name", F.lit("zs")), confident=True, digits=9)
    return rounded(results, *_RESULT_COLUMNS).withColumn("version", F.col("version").cast("bigint"))


@query("text_classifier_lr")
def classifier(c):
    rows = text_classifier_lr(_rows(c))
    return rounded(rows, "proba").select("id", "author", "has_label", "split", "proba", "predicted")
