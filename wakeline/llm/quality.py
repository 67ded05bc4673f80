"""Quality rules as a short-circuit cascade.

Each rule looks at one text and may reject it. On a sample every rule is timed and its rejections
are counted; rules then run in the order of rejections per second, and a text leaves at the first
rule that rejects it. The order changes the work, never the verdict: a text is kept exactly if no
rule rejects it.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.common import map_batches, map_rows, text_or_empty

#: Fixed values of the base checks.
SPACE, SYMBOLS = b" \t\n\r\x0b\x0c", b"#*$%&|<>"
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
#: Rows on which costs and selectivities are estimated.
SAMPLE_ROWS = 500

_UPPER, _LETTERS = bytes(range(65, 91)), bytes([*range(65, 91), *range(97, 123)])
_LETTER = re.compile(rb"[A-Za-z\x80-\xff]")


class Text:
    """What rules may ask of a text; each answer is worked out once, when asked for."""

    def __init__(self, text: str):
        self.text, self.bytes = text, text.encode("utf-8")

    @cached_property
    def words(self) -> list[bytes]:
        return self.bytes.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - (len(self.bytes) - len(self.bytes.translate(None, SPACE)))

    def count_of(self, chars: bytes) -> int:
        return len(self.bytes) - len(self.bytes.translate(None, chars))

    @cached_property
    def n_symbols(self) -> int:
        return self.count_of(SYMBOLS)

    @cached_property
    def lines(self) -> list[bytes]:
        """Lines that hold a word."""
        return [line for line in self.bytes.split(b"\n") if line.strip(SPACE)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        words = self.words
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) == len(windows):
            return 0
        times, total, end = Counter(windows), 0, 0
        for i, window in enumerate(windows):
            if times[window] > 1:
                total += i + 3 - max(i, end)
                end = i + 3
        return total


#: name -> whether the rule rejects a text
RULES: dict[str, Callable[[Text], bool]] = {
    "symbols": lambda t: 10 * t.n_symbols > t.n_words,
    "word_length": lambda t: not 2 * t.n_words <= t.word_chars <= 12 * t.n_words,
    "repeated_lines": lambda t: 2 * t.n_dup_lines > len(t.lines),
    "shouting": lambda t: 2 * t.count_of(_UPPER) > t.count_of(_LETTERS),
    "exclamations": lambda t: 5 * sum(w.endswith(b"!") for w in t.words) > t.n_words,
    "letterless": lambda t: 5 * sum(not _LETTER.search(w) for w in t.words) > t.n_words,
}

#: What :func:`assess` returns, as SQL over the table ``documents``.
SQL = r"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), places AS (
  SELECT doc_id, i, concat_ws(' ', words[i], words[i + 1], words[i + 2]) AS part
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM base)
), repeated AS (
  SELECT doc_id, count(DISTINCT p) AS n
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p
        FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, part) AS times FROM places) WHERE times > 1)
  GROUP BY doc_id
), counted AS (
  SELECT base.doc_id, words, lines, text, len(words)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM base LEFT JOIN repeated ON base.doc_id = repeated.doc_id
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         10 * n_symbols > n_words
         OR NOT word_chars BETWEEN 2 * n_words AND 12 * n_words
         OR 2 * n_dup_lines > len(lines)
         OR 2 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > length(regexp_replace(text, '[^A-Za-z]', '', 'g'))
         OR 5 * len(list_filter(words, lambda x: x LIKE '%!')) > n_words
         OR 5 * len(list_filter(words, lambda x: NOT regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) > n_words AS rejected
  FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT rejected AS kept
FROM judged
"""


def rule_order(docs: DataFrame, rules: dict[str, Callable] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Rule names by rejections per second on some rows of ``docs``; ties keep their order."""

    def make():
        def work(columns):
            out: list[list] = [[], [], []]
            for text in columns[0]:
                for name, rejects in rules.items():
                    fresh = Text(text)  # a rule pays for what it asks
                    start = time.perf_counter()
                    rejected = rejects(fresh)
                    for column, value in zip(out, (name, time.perf_counter() - start, rejected)):
                        column.append(value)
            return out

        return work

    sample = docs.select(text_or_empty().alias("text")).limit(sample_rows)
    measured = (map_rows(sample, make, "rule string, seconds double, rejected boolean").groupBy("rule")
                .agg(F.sum("seconds").alias("seconds"), F.sum(F.col("rejected").cast("long")).alias("n")))
    value = {r["rule"]: (r["n"] + 0.01) / (r["seconds"] + 1e-9) for r in measured.collect()}  # one row per rule
    return sorted(rules, key=lambda name: -value.get(name, 0.0))


def assess(docs: DataFrame, rules: dict[str, Callable] = RULES, order: list[str] | None = None) -> DataFrame:
    """doc_id, counts, base_failed and kept for each row of ``docs`` (doc_id, text).

    Null text counts as empty: it has no words and fails the base checks, as any text of fewer
    than 50 words does. Whole texts are read. Repeated rows and ids are judged one by one; other
    columns are ignored.
    """
    cascade = [rules[name] for name in order or rule_order(docs, rules)]

    def make():
        def work(columns):
            out: list[list] = [[] for _ in range(7)]
            for text in columns[1]:
                t = Text(text)
                failed = t.n_words < MIN_WORDS or 100 * t.n_repeat_words > MAX_REPEATED_PERCENT * t.n_words
                kept = not failed and not any(rejects(t) for rejects in cascade)
                for column, value in zip(out, (t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines,
                                               t.n_repeat_words, failed, kept)):
                    column.append(value)
            return [columns[0], *out]

        return work

    return map_rows(docs.select("doc_id", text_or_empty().alias("text")), make,
                    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                    "n_repeat_words long, base_failed boolean, kept boolean")


def select(docs: DataFrame, rules: dict[str, Callable] = RULES) -> DataFrame:
    """The rows of ``docs`` that pass; all columns, whatever their names, as they are."""
    cascade = [rules[name] for name in rule_order(docs, rules)]
    at = docs.columns.index("text")

    def passing(batches):
        for batch in batches:
            texts = map(Text, (t or "" for t in batch.column(at).to_pylist()))
            yield batch.filter(pa.array([
                t.n_words >= MIN_WORDS and 100 * t.n_repeat_words <= MAX_REPEATED_PERCENT * t.n_words
                and not any(rejects(t) for rejects in cascade) for t in texts], pa.bool_()))

    return map_batches(docs, passing, docs.schema)
