"""Substring dedup by sliding sentence spans.

A text is cut into sentences behind ``. ! ?`` and blanks, and at line ends; sentences of
more than ``LONG`` words are cut on at content-defined places, behind the word with the
smallest hash of every ``LONG`` in a row, so the same words are cut alike wherever they
stand. A span is a run of consecutive sentences with at least ``WORDS`` words, of at least
``SENTENCES`` sentences or with one that has as many words alone. Of all places of a span
the first is the one with the smallest (document id, key, position); every sentence covered
by another place of any span, however long, is removed. Spans are hashed to 128 bits
(A-Z case and blanks do not count) and joined over all documents.

Not every run is hashed. A sentence of a repeated span lies in a repeated shortest span
from its start on or back from its end: the shortest span from the last start that has one
inside the repeat is the one back from its end. Each of these holds one span that has no
shorter one inside, and repeats only if that does; so those are joined first, and carry the
hashes of what the others add to them.

Of any passage, wherever it sits, at most ``LONG`` words at each end belong to sentences
that reach into other text; so every repeat of ``2 * LONG + WORDS`` = 48 words is met,
and up to ``LONG`` words at its ends stay.

Scale: see ``spans``: slim rows per span, a first place by partial aggregation, an
equi-join of the spans that repeat with their places, and one join by the document key.
A passage shared by a third of all documents is one row per task in the aggregation,
and its places are split by adaptive execution in the join.

Cases: null and empty texts, and texts without a span, stay as they are; rows equal in
id and text are one document and get the same result; null ids come first; an empty
table gives an empty result; input columns named like an output one are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from zlib import crc32

from pyspark.sql import DataFrame

from .spans import dedup_units

SENTENCES = 2
WORDS = 16
LONG = 16  # words of a sentence that is not cut on, and of the window that cuts longer ones


def _cuts(hashes: Sequence[int]) -> list[int]:
    """The smallest of every ``LONG`` hashes in a row, of equal ones the last."""
    out, c = [], -1
    for j in range(LONG - 1, len(hashes)):
        if c <= j - LONG:
            window = hashes[j - LONG + 1:j + 1][::-1]
            c = j - window.index(min(window))
            out.append(c)
        elif hashes[j] <= hashes[c]:
            c = j
            out.append(c)
    return out


def sentences(text: str) -> list[str]:
    """Sentences with the blanks behind them, long ones in pieces; joined they are the text."""
    cuts = [m.end() for m in re.finditer(r"[.!?]+[\"')\]]*[ \t\r\f\v]+|[ \t\r\f\v]*\n\s*", text)]
    ends = [c for c in cuts if c < len(text)] + [len(text)]
    out = []
    for a, b in zip([0, *ends[:-1]], ends, strict=True):
        sentence = text[a:b]
        words = sentence.split() if b - a > 2 * LONG else []
        if len(words) <= LONG:
            out.append(sentence)
            continue
        starts = [m.start() for m in re.finditer(r"\S+", sentence)] + [len(sentence)]
        behind = _cuts([*map(crc32, " ".join(words).lower().encode("utf-8", "surrogatepass").split(b" "))])
        at = [0, *[starts[c + 1] for c in behind if c + 1 < len(words)], len(sentence)]
        out += [sentence[x:y] for x, y in zip(at, at[1:], strict=False)]
    return out


def plain(sentence: str) -> str:
    return " ".join(sentence.lower().split())


def dedup_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_sentences: int = SENTENCES,
                min_words: int = WORDS) -> DataFrame:
    """``docs`` with the text cleaned, ``n_sentences``, ``n_removed`` and
    ``removed_spans``, the removed sentences as ranges ``(first, last)`` from 0; the
    pieces of a long sentence count as sentences."""
    def runs(units: Sequence[str]) -> list[tuple[int, int, int, int]]:
        counts = [u.count(" ") + 1 for u in units]
        worth = [min_sentences if c >= min_words else 1 for c in counts]
        shortest, end, have, size = [], 0, 0, 0  # ends of the shortest spans from each start on
        for p in range(len(units)):
            while end < len(units) and (size < min_sentences or have < min_words):
                have += counts[end]
                size += worth[end]
                end += 1
            if size < min_sentences or have < min_words:
                break
            shortest.append(end)
            have -= counts[p]
            size -= worth[p]
        ends = [*shortest, len(units) + 1]
        out, low = [], 0
        for p, end in enumerate(shortest):
            if ends[p + 1] != end:  # no shorter span inside
                out.append((p, end - p, p - low, ends[p + 1] - 1 - end))
                low = p + 1
        return out

    return dedup_units(docs, sentences, plain, runs, "", "sentences", id_col, text_col, wider=True)
