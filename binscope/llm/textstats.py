"""Statistics of one whole text, in one pass (operators 1 and 7)."""

from __future__ import annotations

import numpy as np

from binscope.llm.common import ASCII_SPACE

SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
          "n_lines", "n_upper", "n_lower", "n_marks", "n_distinct"]


def repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more, the first included."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    v = len(ids)
    pair = a[:-1] * v + a[1:]
    if v >= 1 << 20:                 # keep the triple inside 63 bits
        pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    tri = pair[:-1] * v + a[2:]
    order = np.sort(tri)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    again = np.isin(tri, twice)
    hit = np.zeros(n, bool)
    hit[:-2] |= again
    hit[1:-1] |= again
    hit[2:] |= again
    return int(hit.sum())


def stats(text: str | None) -> dict[str, int]:
    """Counts of a text; a null text counts as empty.

    A word is a run of characters other than space and U+0009 to U+000D; a
    line ends at a line feed.
    """
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()              # on exactly the six ASCII spaces
    seen: set[str] = set()
    lines = dup = 0
    for line in text.split("\n"):
        if line.strip(ASCII_SPACE):
            lines += 1
            dup += line in seen
            seen.add(line)
    b = np.frombuffer(raw, np.uint8)
    upper = int(((b >= 65) & (b <= 90)).sum())
    lower = int(((b >= 97) & (b <= 122)).sum())
    return {
        "n_words": len(words),
        "word_chars": len(text) - sum(map(text.count, ASCII_SPACE)),
        "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_dup_lines": dup,
        "n_repeat_words": repeat_words(words),
        "n_lines": lines,
        "n_upper": upper,
        "n_lower": lower,
        "n_marks": text.count("!") + text.count("?"),
        "n_distinct": len(set(words)),
    }
