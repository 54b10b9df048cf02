"""Words for matching and classification: lower-cased runs of letters and digits.

Lower case is Unicode's; every ASCII character that is no letter or digit separates words, and so does nothing else.
"""

from __future__ import annotations

_SPACES = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))

#: The same words in a regular expression, for SQL.
PATTERN = r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"


def words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_SPACES).split()


def shingles(tokens: list[bytes], width: int) -> list[bytes]:
    return [b" ".join(tokens[i : i + width]) for i in range(len(tokens) - width + 1)]
