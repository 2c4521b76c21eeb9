"""Safe cuts of a text for tokenizers that split by white space first, so that pieces repeat and can be remembered.

The splitting patterns here attach one space to the word after it and never join other white space to a word. So a text in
which no two white-space characters meet may be cut before each space and on both sides of each line end: every piece is then
split by the pattern as it would be inside the text.
"""

from __future__ import annotations

import re

MEET = re.compile(r"\s\s|\0")
# The same for engines whose \s is ASCII alone: all of Unicode's white space.
MEET_RE2 = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]{2}|\x00"


def keys(text: str) -> list[str] | None:
    """Keys of the pieces whose encodings concatenate to that of the text; None if white space meets in it (or it has a NUL)."""
    return None if MEET.search(text) else ("\0" + text).replace("\n", " \n\0").split(" ")


def unpack(key: str) -> list[str]:
    """Pieces that a key stands for: the text's first word, a line end and the word after it, or a space and a word."""
    if key[:1] == "\0":
        return [key[1:]]
    return ["\n", key[2:]] if key[:2] == "\n\0" else [" " + key]
