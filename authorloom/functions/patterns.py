"""Regular expressions, spelled so that Java and RE2 read them alike.

Neither engine's plain ``\\s``, ``\\d`` or ``\\w`` follows Unicode, so the classes
are written out and every pattern below works in Spark SQL and in DuckDB.
"""

from __future__ import annotations

# The characters that count as white space, letters and digits.
SPACE = r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x{85}\p{Z}"
WORD = r"\p{L}\p{N}_"
DIGIT = r"\p{Nd}"

# What the cleaning steps remove.
IMAGE_TAG = "<image>"
LINK_GREEDY = r"\[[^\n]*\]\([^\n]*\)"
LINK_EACH = r"\[[^\n\]]*\]\([^\n)]*\)"
MENTION = rf"[ru]/[^{SPACE}/]+"
MENTION_STRICT = rf"\b[ru]/[^{SPACE}/]+"
SPOILER = r">!|!<"
_GENDER = r"[FM]|NB|non-?binary|male|female|other|\?"
AGE_GENDER = (
    rf"\([{SPACE}]*(?:{DIGIT}+[{SPACE}]*(?:{_GENDER})?"
    rf"|(?:{_GENDER})[{SPACE}]*{DIGIT}+)[{SPACE}]*\)"
)
WHITESPACE_RUN = rf"[{SPACE}]+"
WORD_RUN = rf"[^{SPACE}]+"
TOKEN = rf"[{WORD}]{{2,}}"

# Image hosts and endings.
IMAGE_ENDINGS = (".jpg", ".jpeg", ".png", ".webp")
DIRECT_IMAGE_MARKS = ("i.redd.it", "i.imgur.com", ".jpg", ".png")
PREVIEW_HOST = "preview.redd.it"
EXTERNAL_PREVIEW_HOST = "external-preview.redd.it"
IMAGE_HOST = "i.redd.it"
TEXT_IMAGE_URL = (
    rf"https?://(?:i\.|preview\.)redd\.it/[^{SPACE}<>\"')]+\.(?:jpg|jpeg|png|webp)"
    rf"|https?://(?:i\.)?imgur\.com/[^{SPACE}<>\"')]+(?:\.(?:jpg|jpeg|png))?"
)

# Accounts and bodies that carry no content.
BOT_AUTHORS = ("[deleted]", "automoderator")
PLACEHOLDER_BODIES = ("", "[removed]", "[deleted]", "<image>")


def java(pattern: str, ignore_case: bool = False) -> str:
    """Spelling for Spark's Java regex engine."""
    return f"(?iu){pattern}" if ignore_case else pattern


def re2(pattern: str, ignore_case: bool = False) -> str:
    """Spelling for DuckDB's RE2 engine."""
    return f"(?i){pattern}" if ignore_case else pattern
