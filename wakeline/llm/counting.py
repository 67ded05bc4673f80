"""Edit-aware token counts.

Each document gets a tree of token counts whose leaves are runs of pre-tokens. Leaves are cut
before single spaces between two non-spaces, where a pre-token always begins whatever stands
further away, so leaf counts add up to the count of the whole. An edit re-encodes the leaves it
touches, and a neighbour where it reaches the characters a cut rests on; the new counts are
carried up the touched paths of the tree.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.common import map_rows, text_or_empty
from wakeline.llm.tokens import ByteBpe

#: Characters of a leaf, at least.
LEAF_CHARS = 512
_CUT = regex.compile(r"(?<=\S) (?=\S)")


class CountTree:
    def __init__(self, text: str, count: Callable[[str], int], leaf_chars: int = LEAF_CHARS):
        self._count = count
        self.starts, at = [0], leaf_chars
        while cut := _CUT.search(text, at):
            self.starts.append(cut.start())
            at = cut.start() + leaf_chars
        self.leaves = [text[a:b] for a, b in zip(self.starts, [*self.starts[1:], len(text)])]
        self.size = 1 << (len(self.leaves) - 1).bit_length()
        counts = [count(leaf) for leaf in self.leaves]
        self.tree = [0] * self.size + counts + [0] * (self.size - len(counts))
        for node in range(self.size - 1, 0, -1):
            self.tree[node] = self.tree[2 * node] + self.tree[2 * node + 1]
        self.length, self.reencoded = len(text), 0

    @property
    def total(self) -> int:
        return self.tree[1]

    def _set(self, leaf: int, text: str) -> None:
        self.leaves[leaf] = text
        self.reencoded += len(text)
        change = self._count(text) - self.tree[self.size + leaf] if text else -self.tree[self.size + leaf]
        node = self.size + leaf
        while node:
            self.tree[node] += change
            node >>= 1

    def apply(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace [start, end) of the original text, for edits in order that do not overlap."""
        groups: list[tuple[int, int, list]] = []
        for start, end, new in edits:
            first = bisect_right(self.starts, start) - 1
            last = bisect_right(self.starts, max(start, end - 1)) - 1
            # a cut rests on the space behind it and on one character on either side
            if first and start <= self.starts[first] + 1:
                first -= 1
            if last + 1 < len(self.starts) and end >= self.starts[last + 1]:
                last += 1
            if groups and first <= groups[-1][1]:
                groups[-1] = (groups[-1][0], max(last, groups[-1][1]), [*groups[-1][2], (start, end, new)])
            else:
                groups.append((first, last, [(start, end, new)]))
        for first, last, inside in groups:
            base, old, parts = self.starts[first], "".join(self.leaves[first:last + 1]), []
            at = base
            for start, end, new in inside:
                parts += [old[at - base:start - base], new]
                at = end
            self._set(first, "".join([*parts, old[at - base:]]))
            for leaf in range(first + 1, last + 1):
                self._set(leaf, "")


def valid_edits(edits: list | None, length: int) -> list[tuple[int, int, str]]:
    """In order, within the text, without overlaps (of two that overlap the later one goes)."""
    kept, at = [], 0
    for e in sorted((max(0, e["start"]), min(length, e["end"]), e["text"] or "") for e in edits or ()
                    if e and e["start"] is not None and e["end"] is not None):
        if at <= e[0] <= e[1]:
            kept.append(e)
            at = e[1]
    return kept


def count_tokens(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Counts before and after each document's edits.

    ``docs``: doc_id, text, edits array<struct<start, end, text>> in code points, end exclusive.
    Null text is empty; null, unordered or overlapping edits are put in order as
    :func:`valid_edits` says. Special strings count as ordinary text. Returns doc_id, n_tokens,
    n_edits, edited_tokens, reencoded_chars (long), one row for each row of ``docs``.
    """

    def make():
        bpe = ByteBpe(tokenizer)

        def work(columns):
            out: list[list] = [[], [], [], []]
            for text, edits in zip(columns[1], columns[2]):
                tree = CountTree(text, bpe.count)
                before, edits = tree.total, valid_edits(edits, len(text))
                tree.apply(edits)
                for column, value in zip(out, (before, len(edits), tree.total, tree.reencoded)):
                    column.append(value)
            return [columns[0], *out]

        return work

    rows = docs.select("doc_id", text_or_empty().alias("text"), F.col("edits"))
    return map_rows(rows, make, "doc_id long, n_tokens long, n_edits long, edited_tokens long, reencoded_chars long")
