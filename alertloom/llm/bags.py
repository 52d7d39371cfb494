"""Bags of letter words of a text, for the models that score words one by one."""

from __future__ import annotations

import re
from collections import Counter

_LETTERS = re.compile(r"[^\W\d_]+")
#: Latin-1 bytes that are no letters become spaces.
_LATIN = bytes(b if chr(b).isalpha() else 32 for b in range(256))


def letter_words(text: str | None) -> Counter:
    """Lower-cased runs of letters (Unicode categories L) with their counts; empty for NULL and texts without letters."""
    if not text:
        return Counter()
    text = text.lower()
    try:
        return Counter(text.encode("latin-1").translate(_LATIN).decode("latin-1").split())
    except UnicodeEncodeError:
        found = Counter(_LETTERS.findall(text))
    # The pattern also takes signs like the fraction one half, which are numbers but no decimal digits.
    for run in [w for w in found if not w.isalpha()]:
        n = found.pop(run)
        for word in "".join(c if c.isalpha() else " " for c in run).split():
            found[word] += n
    return found
