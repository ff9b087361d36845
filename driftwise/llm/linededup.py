"""Line dedup by overlapping three-line windows.

A text's lines are split at ``\\n``; blank lines are no part of a window, and lines are
compared without the blanks around them. Every run of ``WINDOW`` consecutive lines is
hashed to 128 bits. Of all places where a window occurs, in any document, the first
is the one with the smallest (document id, key, position). All lines covered by a
later occurrence are removed; what overlapping windows cover is merged. A removed
line's text is still present at an earlier place, so no line vanishes from the corpus.

Scale: one slim row per window (ids, position, hash) is checkpointed and shuffled, not
text. The first place is a minimum with partial aggregation, so a line that fills a
third of the corpus is one row per task; only windows that occur twice keep a row, and
occurrences meet them in an equi-join whose skewed parts adaptive execution splits.
Covered positions are gathered per document (bounded by its own lines) and joined with
the text by the document key.

Cases: null and empty texts, and texts of fewer lines than a window, stay as they are;
rows equal in id and text are one document and get the same result; null ids come
first; an empty table gives an empty result; input columns named like an output one
are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from .common import BLANKS
from .spans import dedup_units

WINDOW = 3


def lines(text: str) -> list[str]:
    return text.split("\n")


def stripped(line: str) -> str:
    return line.strip(BLANKS)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with the text cleaned, ``n_lines`` (with content), ``n_removed`` and
    ``removed_spans``, the removed lines as ranges ``(first, last)`` of their numbers
    among the lines with content, from 0."""
    def runs(units):
        return [(p, window, 0, 0) for p in range(len(units) - window + 1)]

    return dedup_units(docs, lines, stripped, runs, "\n", "lines", id_col, text_col)
