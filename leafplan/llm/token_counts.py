"""Token counts by dynamic programming over a trie of pre-tokens.

The best segmentation of a prefix under a unigram model depends on the prefix
alone. Distinct pre-tokens go into a trie, and the forward score (with the
number of tokens on the best path) is computed once for each node, that is once
for each shared prefix. A pre-token's count is stored where it ends; a text's
count is the sum over its pre-tokens.

The scores are those of a public vocabulary: piece r in order of rank has the
probability of Zipf and Mandelbrot's law, in proportion to 1 / (r + 2.7).
Nothing is trained.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

from .common import append_columns, pieces_of
from .piece_codec import MARK, model_at

#: Pre-tokens with a stored count in one worker, in each of two generations, before the older one goes.
REMEMBERED = 300_000
SHIFT = 2.7
#: Characters of text whose new pre-tokens share one trie.
BATCH_CHARS = 4_000_000


class UnigramCounter:
    """Counts of the tokens in the best unigram segmentation, trie-shared.

    The trie of a batch is walked depth first, which is the order of its sorted
    pre-tokens: going from one to the next leaves the nodes below their common
    prefix and makes those of the rest, so each node is made once, and only the
    nodes of the path are held. Of equal scores the longer last piece wins. A
    character that is no piece counts one token for each byte, at a score below
    all others.
    """

    def __init__(self, scores: dict[str, float], units):
        self.scores, self.units = scores, units
        # Lengths over 2 of the pieces that end in three given characters, the longest first.
        sizes: dict[str, set[int]] = {}
        for p in scores:
            if len(p) > 2:
                sizes.setdefault(p[-3:], set()).add(len(p))
        self.sizes = {k: tuple(sorted(v, reverse=True)) for k, v in sizes.items()}
        self.unknown = min(scores.values()) - 10
        self.counts: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def terminal_counts(self, words: list[str]) -> list[int]:
        """The token count at the end of each of ``words``, which are sorted."""
        scores, sizes, unknown = self.scores.get, self.sizes.get, self.unknown
        # Forward score and number of tokens of each node on the path, the root first.
        best, tokens, out, before = [0.0], [0], [], ""
        for word in words:
            shared, most = 0, min(len(before), len(word))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del best[shared + 1 :], tokens[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                top, count = -math.inf, 0
                if end > 1:
                    for size in sizes(word[end - 3 : end], ()) if end > 2 else ():
                        if size <= end:
                            score = scores(word[end - size : end])
                            if score is not None and best[end - size] + score > top:
                                top, count = best[end - size] + score, tokens[end - size] + 1
                    score = scores(word[end - 2 : end])
                    if score is not None and best[end - 2] + score > top:
                        top, count = best[end - 2] + score, tokens[end - 2] + 1
                last = word[end - 1]
                score = scores(last)
                if score is None:
                    if best[end - 1] + unknown > top:
                        top, count = best[end - 1] + unknown, tokens[end - 1] + len(last.encode())
                elif best[end - 1] + score > top:
                    top, count = best[end - 1] + score, tokens[end - 1] + 1
                best.append(top)
                tokens.append(count)
            out.append(tokens[-1])
            before = word
        return out

    def count(self, texts: list[str]) -> list[tuple[int, int]]:
        """Tokens and pre-tokens of each text."""
        split = [self.units(t) for t in texts]
        if len(self.counts) > REMEMBERED:
            # What is used again comes over from the older generation.
            self.counts, self.older = {}, self.counts
        known, older = self.counts, self.older
        known[""] = 0
        asked = set().union(*split).difference(known)
        known.update((u, older[u]) for u in asked if u in older)
        new = sorted(u for u in asked if u not in older)
        known.update(zip(new, self.terminal_counts(new)))
        return [(sum(map(known.__getitem__, us)), len(us) - us.count("")) for us in split]


def zipf_scores(pieces_by_rank: list[str]) -> dict[str, float]:
    """Log probabilities by rank."""
    norm = math.log(sum(1 / (r + SHIFT) for r in range(len(pieces_by_rank))))
    return {p: -math.log(r + SHIFT) - norm for r, p in enumerate(pieces_by_rank)}


_COUNTERS: dict[str, UnigramCounter] = {}


def counter_at(model_path: str) -> UnigramCounter:
    """The counter of a worker for a SentencePiece vocabulary, made once."""
    if model_path not in _COUNTERS:
        model = model_at(model_path)
        ranked = sorted((p for p in model.ids if not (len(p) > 1 and set(p) == {MARK})), key=model.rank.get)
        runs = sorted((p for p in model.ids if len(p) > 1 and set(p) == {MARK}), key=model.rank.get)
        _COUNTERS[model_path] = UnigramCounter(zipf_scores([*ranked, *runs]), model.units)
    return _COUNTERS[model_path]


def count_tokens(docs: DataFrame, model_path: str, *, carry: list[str] | None = None) -> DataFrame:
    """Adds ``n_tokens`` and ``n_pretokens`` (long) to ``docs``; null and empty texts have none.

    Each task counts its own rows: nothing is shuffled, and equal texts have
    equal counts wherever they are.
    """

    def make():
        counter = counter_at(model_path)

        def count(texts):
            texts = [t or "" for t in texts.to_pylist()]
            return [list(c) for c in zip(*(x for a, b in pieces_of(texts, BATCH_CHARS) for x in counter.count(texts[a:b])))]

        return count

    return append_columns(docs, "n_tokens long, n_pretokens long", make, carry=carry)
