"""Prompts, few-shot examples, images and chat messages for a text model."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from authorloom.operators.ranks import first_by_hash

STRATEGIES = ("plain", "expert", "plain_confidence", "expert_confidence", "few_shot")


@dataclass(frozen=True)
class PromptTemplate:
    """Wording of the prompts; every part may be replaced."""

    positive: str = "YES"
    negative: str = "NO"
    role: str = "Answer as a specialist in the field."
    task: str = "Decide whether the author of this text belongs to the group: {positive} or {negative}."
    answer: str = "Answer with one word, {positive} or {negative}."
    answer_confidence: str = (
        'Answer as JSON with the keys "label" ({positive} or {negative}) and "confidence" (0 to 1).'
    )
    examples: str = "Solved examples:"
    text: str = "Text: "
    label: str = "Label: "

    def fill(self, part: str) -> str:
        return part.replace("{positive}", self.positive).replace("{negative}", self.negative)


def _lines(*parts: Column) -> Column:
    return F.concat_ws("\n", *parts)


def build_prompt(
    strategy: str, text: Column, template: PromptTemplate = PromptTemplate(), examples: Column | None = None
) -> Column:
    """Prompt of one strategy; ``examples`` is the text of the solved examples."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy: {strategy}")
    head = [F.lit(template.fill(template.task))]
    if strategy.startswith("expert"):
        head.insert(0, F.lit(template.role))
    question = F.concat(F.lit(template.text), text)
    confident = strategy.endswith("confidence")
    closing = F.lit(template.fill(template.answer_confidence if confident else template.answer))
    if strategy != "few_shot":
        return _lines(*head, question, closing)

    return _lines(*head, F.lit(template.examples), examples, question, closing)


def few_shot_examples(train: DataFrame, k: int = 2, seed: int = 22) -> DataFrame:
    """``k`` training texts per class in seeded hash order: (id, text, has_label); only ids are ranked."""
    chosen = first_by_hash(train.select("has_label", "id"), "has_label", "id", k, seed).select("has_label", "id")
    return train.join(F.broadcast(chosen), ["has_label", "id"], "left_semi").select("id", "text", "has_label")


def solved_examples(examples: DataFrame, template: PromptTemplate = PromptTemplate()) -> DataFrame:
    """One row with the few examples written out, positives first."""
    label = F.when(F.col("has_label"), template.positive).otherwise(template.negative)
    shown = F.concat(F.lit(template.text), F.col("text"), F.lit("\n" + template.label), label)
    rows = F.collect_list(F.struct((~F.col("has_label")).alias("order"), "id", shown.alias("shown")))
    return examples.agg(F.array_join(F.array_sort(rows)["shown"], "\n").alias("shown"))


def build_prompts(
    content: DataFrame,
    strategy: str,
    template: PromptTemplate = PromptTemplate(),
    examples: DataFrame | None = None,
) -> DataFrame:
    """Add ``strategy`` and ``prompt`` to every content row."""
    shown = None
    if strategy == "few_shot":
        shown = solved_examples(examples, template).scalar()
    prompt = build_prompt(strategy, F.col("text"), template, shown)
    return content.withColumn("strategy", F.lit(strategy)).withColumn("prompt", prompt)


def build_all_prompts(
    content: DataFrame, strategies: Sequence[str], template: PromptTemplate = PromptTemplate()
) -> DataFrame:
    """One row per content and strategy, in one pass; for strategies without examples."""
    made = F.array(
        *[
            F.struct(F.lit(s).alias("strategy"), build_prompt(s, F.col("text"), template).alias("prompt"))
            for s in strategies
        ]
    )
    return content.select("*", F.inline(made))


def attach_images(content: DataFrame, media: DataFrame, limit: int = 3, use: bool = True) -> DataFrame:
    """Add ``images``: the first files of a content's media by name, at most ``limit``."""
    if not use:
        return content.withColumn("images", F.array().cast("array<string>"))
    by_name = Window.partitionBy("content_id").orderBy("image")
    first = media.withColumn("_rank", F.row_number().over(by_name)).where(F.col("_rank") <= limit)
    lists = first.groupBy(F.col("content_id").alias("id")).agg(
        F.array_sort(F.collect_list("image")).alias("_images")
    )
    shown = F.when(F.col("has_media"), F.col("_images"))
    joined = content.join(lists, "id", "left")
    return joined.withColumn("images", F.coalesce(shown, F.array().cast("array<string>"))).drop("_images")


def chat_messages(prompted: DataFrame) -> DataFrame:
    """Add ``messages``: one user turn with an image slot per image, then the prompt."""

    def slot(kind: str, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), text.cast("string").alias("text"))

    slots = F.transform("images", lambda _: slot("image", F.lit(None)))
    parts = F.concat(slots, F.array(slot("text", F.col("prompt"))))
    return prompted.withColumn(
        "messages", F.array(F.struct(F.lit("user").alias("role"), parts.alias("content")))
    )
