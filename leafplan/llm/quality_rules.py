"""Quality rules as a short-circuit cascade.

On a sample, each rule's cost and the part of documents that it rejects are
measured; the cascade then runs the rules in order of rejection per cost and
stops at the first that rejects. A document is kept if no rule rejects it,
whatever the order, so the sample decides the speed and never the result.

All rules count the same words, ``[^\\x20\\x09-\\x0D]+``: other white space, such as
U+00A0 or U+0085, is part of a word.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from itertools import filterfalse

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, append_columns, quoted

#: Documents that costs and selectivities are measured on, those that are measured together, and the
#: part of the rows, by hash, that the sample is taken from: it stretches over so many times its own rows.
SAMPLE_ROWS, CHUNK_ROWS, SAMPLED_PART = 2_000, 100, 0.25
SYMBOLS = "#*$%&|<>"
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


@dataclass
class Text:
    """A document's text with what several rules look at."""

    text: str
    words: list[bytes] = field(init=False)

    def __post_init__(self) -> None:
        # bytes.split() splits at space and TAB..CR, no more and no less.
        self.words = self.text.encode().split()

    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(ASCII_SPACE)]


def word_chars(doc: Text) -> int:
    return len(doc.text) - sum(map(doc.text.count, ASCII_SPACE))


def n_symbols(doc: Text) -> int:
    return sum(map(doc.text.count, SYMBOLS))


def n_dup_lines(doc: Text) -> int:
    lines = doc.lines()
    return len(lines) - len(set(lines))


def n_repeat_words(doc: Text, window: int = 5) -> int:
    """Words within windows of five words that occur twice or more in the text."""
    n = len(doc.words)
    if n <= window:
        return 0
    ids: dict[bytes, int] = {}
    words = np.fromiter((ids.setdefault(w, len(ids)) for w in doc.words), np.int64, n)
    if len(ids) == n:
        return 0
    # Windows get numbers by pairing numbers of shorter ones; all stay below n * n.
    runs, size = words, len(ids)
    for _ in range(window - 1):
        runs = np.unique(runs[:-1] * len(ids) + words[n - len(runs) + 1 :], return_inverse=True)[1]
        size = int(runs.max()) + 1
        if size == len(runs):
            return 0
    at = np.flatnonzero(np.bincount(runs, minlength=size)[runs] > 1)
    edge = np.zeros(n + 1, np.int64)
    edge[at] += 1
    edge[at + window] -= 1
    return int((edge.cumsum() > 0).sum())


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]


_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def _upper(word: bytes) -> bool:
    """Over one character, with a letter of the class Lu and none of Ll or Lt."""
    if word.isascii():
        return len(word) > 1 and word.isupper()
    import regex

    text = word.decode()
    return len(text) > 1 and regex.search(r"\p{Lu}", text) is not None and regex.search(r"[\p{Ll}\p{Lt}]", text) is None


def _uppercase(doc: Text) -> bool:
    words = list(filter(bytes.isupper, doc.words))
    if not doc.text.isascii():
        # Words beyond ASCII may be upper-case without a letter of it.
        words += [w for w in doc.words if not w.isascii() and not w.isupper() and w == w.upper()]
    return sum(map(_upper, words)) > 0.3 * len(doc.words)


def _stutters(doc: Text) -> bool:
    return sum(map(bytes.__eq__, doc.words, doc.words[1:])) > 0.3 * len(doc.words)


def _wordless(doc: Text) -> bool:
    """Words without a letter (class L)."""
    rest = filterfalse(bytes.isalpha, doc.words)
    return sum(_ASCII_LETTER.search(w) is None and (w.isascii() or not any(map(str.isalpha, w.decode()))) for w in rest) > 0.7 * len(doc.words)


#: The rules that documents must pass besides the base.
RULES: tuple[Rule, ...] = (
    Rule("symbols", lambda d: n_symbols(d) > 0.1 * len(d.words)),
    Rule("exclamations", lambda d: d.text.count("!") > 0.1 * len(d.words)),
    Rule("uppercase", _uppercase),
    Rule("repeated_lines", lambda d: n_dup_lines(d) > 0.5 * len(d.lines())),
    Rule("stuttering", _stutters),
    Rule("word_length", lambda d: not 2 * len(d.words) <= word_chars(d) <= 15 * len(d.words)),
    Rule("wordless", _wordless),
)


def measure_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> dict[str, tuple[float, float]]:
    """Seconds a document and part rejected, by rule, on up to ``sample_rows`` documents.

    Tasks measure chunks of a hash sample and hand on sums alone. As many chunks
    as are asked for are taken, from the first partitions that have them: no text
    is shuffled or brought to the driver, and a large table is not read through.
    On an empty table every rule costs nothing and rejects nothing.
    """
    some = F.pmod(F.xxhash64(quoted("doc_id"), quoted("text").cast("string")), F.lit(1 << 20)) < int(SAMPLED_PART * (1 << 20))
    # Of a few rows, all are taken.
    chunk = max(1, min(CHUNK_ROWS, sample_rows))
    text = F.coalesce(quoted("text").cast("string"), F.lit("")).alias("text")

    def run(batches):
        import pyarrow as pa

        spent, hit, n = [0.0] * len(rules), [0] * len(rules), 0
        for batch in batches:
            for t in batch.column(0):
                doc, n = Text(t.as_py()), n + 1
                for i, rule in enumerate(rules):
                    began = time.perf_counter()
                    hit[i] += bool(rule.rejects(doc))
                    spent[i] += time.perf_counter() - began
                if n == chunk:
                    yield pa.RecordBatch.from_pydict({"n": [n], "spent": [spent], "hit": [hit]})
                    spent, hit, n = [0.0] * len(rules), [0] * len(rules), 0
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n], "spent": [spent], "hit": [hit]})

    measure = lambda rows: rows.select(text).mapInArrow(run, "n long, spent array<double>, hit array<long>").take(-(-sample_rows // chunk))
    sums = measure(docs.where(some)) or measure(docs)
    n = sum(r["n"] for r in sums)
    return {r.name: (sum(x["spent"][i] for x in sums) / n, sum(x["hit"][i] for x in sums) / n) if n else (0.0, 0.0) for i, r in enumerate(rules)}


def cascade_order(measured: dict[str, tuple[float, float]]) -> list[str]:
    """Rule names by rejection per cost, the greatest first; ties by less cost, then by name."""
    return sorted(measured, key=lambda k: (-measured[k][1] / max(measured[k][0], 1e-9), measured[k][0], k))


def judge_quality(docs: DataFrame, rules: Sequence[Rule] = RULES, *, sample_rows: int = SAMPLE_ROWS, carry: list[str] | None = None) -> DataFrame:
    """Adds the base counts, ``base_failed`` and ``kept`` to ``docs``.

    A document fails the base with under 10 words, or if more than a fifth of
    its words stand in repeated 5-word windows; the cascade is not run on it. A
    null text has no words and fails. Texts of any length are read whole, in
    memory in proportion to the longest one. Repeated rows are judged alike; an
    empty table gives an empty one. Input columns named like a new one, without
    regard to case, are left out.
    """
    order = cascade_order(measure_rules(docs, rules, sample_rows))
    ordered = sorted(rules, key=lambda r: order.index(r.name))

    def make():
        def judge(text: str | None) -> tuple:
            doc = Text(text or "")
            n, repeated = len(doc.words), n_repeat_words(doc)
            failed = n < 10 or 100 * repeated > 20 * n
            kept = not failed and not any(r.rejects(doc) for r in ordered)
            return n, word_chars(doc), n_symbols(doc), n_dup_lines(doc), repeated, failed, kept

        return lambda texts: [list(c) for c in zip(*(judge(t.as_py()) for t in texts))]

    return append_columns(docs, BASE, make, carry=carry)
