"""Quality rules as a short-circuit cascade, ordered by rejection per cost.

Every rule is a test on one document. On a bounded sample each rule's cost (seconds a
document) and selectivity (share of documents that it rejects) are measured; the next
rule is always the one with most rejections per second among the documents that the
rules before it leave. A document stops at the first rule that rejects it, and what
rules have in common (words, lines, counts) is computed when a rule first asks for it.
The order changes the cost only: a document is kept if no rule rejects it.

Words are runs of anything but space, tab, newline, vertical tab, form feed and carriage
return. Defined cases: a null or empty text has no words and is rejected as too short;
repeated rows are judged each by itself; other columns are ignored; an empty table gives
an empty result and the order in which the rules are written.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeworks.llm.common import blocks, texts

#: Documents at most that the order of the rules is measured on.
SAMPLE_ROWS = 2_000
SYMBOLS = b"#*$%&|<>"
WINDOW = 5


class Page:
    """What rules ask about a text, each computed once when first needed."""

    def __init__(self, text: bytes):
        self.text = text

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(b"".join(self.words).decode("utf-8"))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.text) - len(self.text.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        """Lines that hold a word."""
        return [line for line in self.text.split(b"\n") if line.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        return repeated_words(self.words)

    @cached_property
    def n_distinct(self) -> int:
        return len(set(self.words))


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of `window` words found twice or more, the first one included."""
    if len(words) <= window:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(word, len(numbers)) for word in words], np.int64)
    windows, kinds = ids, len(numbers)
    count = len(words) - window + 1
    for step in range(1, window):
        if kinds * len(numbers) >= 1 << 62:
            windows = np.unique(windows, return_inverse=True)[1]
            kinds = len(words)
        windows = windows[: len(words) - step] * len(numbers) + ids[step:]
        kinds *= len(numbers)
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(count, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    places = np.flatnonzero(twice)
    change = np.zeros(len(words) + 1, np.int64)
    change[places] += 1
    change[places + window] -= 1
    return int((np.cumsum(change) > 0).sum())


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Page], bool]


#: The two base rules, then further ones in the manner of published web-text filters.
RULES = (
    Rule("too_few_words", lambda page: page.n_words < 10),
    Rule("repeated_words", lambda page: 100 * page.n_repeat_words > 20 * page.n_words),
    Rule("symbols_per_word", lambda page: 10 * page.n_symbols > 2 * page.n_words),
    Rule("word_length", lambda page: not page.n_words <= page.word_chars <= 25 * page.n_words),
    Rule("duplicate_lines", lambda page: len(page.lines) > 3 and 10 * page.n_dup_lines > 7 * len(page.lines)),
    Rule("few_distinct_words", lambda page: page.n_words >= 100 and 100 * page.n_distinct < 5 * page.n_words),
)
BASE_RULES = ("too_few_words", "repeated_words")


def first_rejection(page: Page, rules) -> str | None:
    for rule in rules:
        if rule.rejects(page):
            return rule.name
    return None


def order_rules(pages: list[bytes], rules=RULES, clock=time.perf_counter) -> list[Rule]:
    """Greedy order by measured rejections per second on the pages that earlier rules leave."""
    left, waiting, ordered = list(pages), list(rules), []
    while waiting and left:
        rates = []
        for rule in waiting:
            began = clock()
            rejected = sum(rule.rejects(Page(text)) for text in left)
            spent = max(clock() - began, 1e-9)
            rates.append(rejected / spent)
        best = waiting.pop(int(np.argmax(rates)))
        ordered.append(best)
        left = [text for text in left if not best.rejects(Page(text))]
    return ordered + waiting


def measure(documents: DataFrame, rules=RULES, rows: int = SAMPLE_ROWS) -> list[str]:
    """Names of the rules in the order found on a sample of at most `rows` documents.

    One task measures the sample, so that the driver receives names only. The sample
    chooses the order; it never decides about a document.
    """

    def run(batches):
        pages = [text for block in blocks(batches, "text") for text in texts(block.column(0))]
        yield pa.record_batch([pa.array([rule.name for rule in order_rules(pages, rules)])], names=["name"])

    total = documents.count()
    share = min(1.0, rows / total) if total else 1.0
    sample = documents.select("text")
    if share < 1.0:
        sample = sample.sample(fraction=share, seed=17)
    found = [row.name for row in sample.limit(rows).coalesce(1).mapInArrow(run, "name string").collect()]
    return found or [rule.name for rule in rules]


def apply_rules(documents: DataFrame, rules=RULES, order: list[str] | None = None) -> DataFrame:
    """Per document: doc_id, kept, rejected_by (the first rule in the order, or null) and the base counts.

    The counts are wanted for every document, so those that no rule asked for follow after the verdict.
    """
    by_name = {rule.name: rule for rule in rules}
    ordered = [by_name[name] for name in (order if order is not None else measure(documents, rules))]

    def run(batches):
        for block in blocks(batches, "text"):
            pages = [Page(text) for text in texts(block.column(1))]
            verdicts = [first_rejection(page, ordered) for page in pages]
            yield pa.record_batch(
                [
                    block.column(0),
                    pa.array([verdict is None for verdict in verdicts]),
                    pa.array(verdicts, pa.string()),
                    *(
                        pa.array([getattr(page, name) for page in pages], pa.int64())
                        for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
                    ),
                ],
                names=["doc_id", "kept", "rejected_by", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"],
            )

    return documents.select("doc_id", "text").mapInArrow(
        run,
        "doc_id bigint, kept boolean, rejected_by string, n_words bigint, word_chars bigint, n_symbols bigint, "
        "n_dup_lines bigint, n_repeat_words bigint",
    )


def kept_rows(documents: DataFrame, rules=RULES, order: list[str] | None = None) -> DataFrame:
    """The documents that no rule rejects, with all their columns.

    The text is judged where it lies: rows are filtered inside their own batch, so nothing is shuffled.
    """
    by_name = {rule.name: rule for rule in rules}
    ordered = [by_name[name] for name in (order if order is not None else measure(documents, rules))]

    def run(batches):
        for block in blocks(batches, "text"):
            column = block.column(block.schema.get_field_index("text"))
            yield block.filter(pa.array([first_rejection(Page(text), ordered) is None for text in texts(column)]))

    return documents.mapInArrow(run, documents.schema)


def judged(documents: DataFrame, rules=RULES, order: list[str] | None = None) -> DataFrame:
    """The contract's columns: the base counts, base_failed and kept."""
    return apply_rules(documents, rules, order).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"),
        "kept",
    )
