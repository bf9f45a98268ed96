"""Merging, labelling, cleaning and enriching as one lazy plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from authorloom.functions.phrases import PhrasePattern
from authorloom.operators.cleaning import (
    drop_empty,
    language_filter,
    rewrite_text,
    with_text_counts,
)
from authorloom.operators.enrich import enrich_users
from authorloom.operators.joins import drop_orphan_content, known_with_media
from authorloom.operators.langid import filter_detected
from authorloom.operators.merge import merge_content, merge_users
from authorloom.operators.selfreport import relabel

COLUMNS = ["id", "author", "type", "subreddit", "text", "timestamp", "has_pattern", "has_media"]


def rewritten_content(
    content: DataFrame,
    language: str | None = "en",
    profiles: DataFrame | None = None,
    greedy: bool = True,
    strict: bool = False,
) -> DataFrame:
    """Language filter, rewriting, empty rows and counts.

    All row by row, except that ``profiles`` join their verdict to the texts. Language is judged on the text before rewriting: by ``profiles`` if given, else
    by the ``lang`` column; ``language=None`` skips the filter.
    """
    if language is not None and profiles is not None:
        content = filter_detected(content, profiles, language)
    elif language is not None:
        content = language_filter(content, language)
    return with_text_counts(drop_empty(rewrite_text(content.select(*COLUMNS), greedy, strict)), flat=True)


def known_content(
    users: DataFrame, content: DataFrame, media: DataFrame | None = None, hot: Sequence[str] | DataFrame | None = ()
) -> DataFrame:
    """Drop content of unknown authors and refresh its media flag.

    ``hot`` names very active authors (see :func:`authorloom.operators.skew.hot_keys`).
    """
    if media is None:
        return drop_orphan_content(content, users, hot)
    return known_with_media(content, users, media, hot)


def clean_content(
    users: DataFrame,
    content: DataFrame,
    media: DataFrame | None = None,
    hot: Sequence[str] | DataFrame | None = (),
    **options,
) -> DataFrame:
    """All cleaning steps; the options are those of :func:`rewritten_content`."""
    return known_content(users, rewritten_content(content, **options), media, hot)


def clean_corpus(
    users: DataFrame,
    content: DataFrame,
    media: DataFrame | None = None,
    hot: Sequence[str] | DataFrame | None = (),
    **options,
) -> tuple[DataFrame, DataFrame]:
    """Enriched users and cleaned content.

    Enriching is an inner join of users with author totals, so users without content
    and content without a user drop out there: it reads the rewritten rows directly,
    and no text is shuffled for it. To clean only once for both outputs, write the
    content and pass the written table to :func:`enrich_users`.
    """
    rewritten = rewritten_content(content, **options)
    return enrich_users(users, rewritten), known_content(users, rewritten, media, hot)


def curate(
    runs: tuple[tuple[DataFrame, DataFrame], tuple[DataFrame, DataFrame]],
    pattern: PhrasePattern,
    media: DataFrame | None = None,
    rewrite: bool = False,
    **options,
) -> tuple[DataFrame, DataFrame]:
    """Merge two runs, label again, clean and enrich."""
    (users_1, content_1), (users_2, content_2) = runs
    users = merge_users(users_1, users_2)
    content = merge_content(content_1, content_2)
    users, content = relabel(users, content, pattern, rewrite)
    return clean_corpus(users, content, media, **options)
