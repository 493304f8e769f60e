"""Token counts by prefix dynamic programming.

For every prefix of a word the last token of its encoding is found from those of shorter prefixes, and with it the exact
number of tokens. A word's row of counts answers how many tokens any cut of it has, and running sums over words do so for a
text, so truncation to a budget needs no second encoding.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm._common import Recent, batched, by_size, kept, rows
from plumbline.llm.bpe_model import BpeModel

HELD = 200_000  # words, and stretches between blanks, whose counts a worker keeps at least
_SPLIT_IN_PREFIX = ("'r", "'v", "'l")  # a cut contraction is two words, not one


def _row(opened: list[int], lasts: list[str]) -> None:
    """Carry the row of counts on to all prefixes whose last token is known: one more than the prefix before that token has."""
    for n in range(len(opened), len(lasts)):
        opened.append(opened[n - len(lasts[n])] + 1)


def _whole(model: BpeModel, n: int, opened: list[int], lasts: list[str], states: list[str]) -> int:
    """The number of tokens of the first n letters as a word of their own."""
    if not n or not model.suffix:
        return opened[n]
    return opened[n + len(model.suffix) - len(model.closing(n, lasts, states))] + 1


def prefix_counts(model: BpeModel, letters: str) -> list[int]:
    """``counts[n]`` is the number of tokens of the word's first n letters, taken as a word of their own."""
    opened, lasts, states = [0], [""], [""]
    model.extend(letters, lasts, states)
    _row(opened, lasts)
    return [_whole(model, n, opened, lasts, states) for n in range(len(letters) + 1)]


def word_counts(model: BpeModel, words: Iterable[str]) -> dict[str, int]:
    """The number of tokens of each word. In sorted order a word keeps the rows of the letters it begins with like the one before."""
    found: dict[str, int] = {}
    opened, lasts, states, before = [0], [""], [""], ""
    for letters, word in sorted((model.letters(w), w) for w in words):
        if letters + model.suffix in model.whole:
            found[word] = 1
            continue
        keep = 0
        for x, y in zip(before, letters, strict=False):
            if x != y:
                break
            keep += 1
        del opened[keep + 1 :], lasts[keep + 1 :], states[keep + 1 :]
        model.extend(letters, lasts, states)
        _row(opened, lasts)
        before = letters
        found[word] = _whole(model, len(letters), opened, lasts, states)
    return found


class TokenCounter:
    """Counts texts with one vocabulary; keeps the counts of words and of stretches between blanks."""

    def __init__(self, path: str):
        self.model = BpeModel(path)
        self._words: Recent[str, int] = Recent(HELD)
        self._runs: Recent[str, int] = Recent(HELD)

    def of_words(self, words: list[str]) -> list[int]:
        self._words.turn()
        self._learn({*words})
        return [self._words.young[w] for w in words]

    def _learn(self, words: set[str]) -> None:
        self._words.add(word_counts(self.model, self._words.missing(words)))

    def _by_runs(self, text: str) -> bool:
        """Whether stretches between white space can be counted by themselves: words never reach over it."""
        return self.model.lower and self.model.plain_letters(text)

    def count_all(self, texts: list[str]) -> list[int]:
        """The number of tokens of each text. What isn't known yet of all texts is learnt together."""
        model = self.model
        self._words.turn()
        self._runs.turn()
        parts = [[(part, special, not special and self._by_runs(part)) for part, special in model.sections(t)] for t in texts]
        runs, rest = set(), []
        for each in parts:
            for part, special, by_runs in each:
                if by_runs:
                    runs.update(part.split())
                elif not special:
                    rest.append(model.words(part))
        cut = [(r, model.words(r)) for r in self._runs.missing(runs)]
        self._learn({w for words in (*(c[1] for c in cut), *rest) for w in words})
        known = self._words.young.__getitem__
        self._runs.add({r: sum(map(known, words)) for r, words in cut})
        known_runs, left, out = self._runs.young.__getitem__, iter(rest), []
        for each in parts:
            out.append(sum(1 if special else sum(map(known_runs, part.split())) if by_runs else sum(map(known, next(left))) for part, special, by_runs in each))
        return out

    def count(self, text: str) -> int:
        return self.count_all([text])[0]

    def fit(self, text: str, budget: int) -> tuple[int, int]:
        """(tokens, code points) of the longest prefix of the normalised text of at most ``budget`` tokens.

        A cut inside a character of several bytes is never taken; special strings are kept whole.
        """
        model, used, at = self.model, 0, 0
        for part, special in model.sections(text):
            if special:
                if used + 1 > budget:
                    return used, at
                used, at = used + 1, at + len(part)
                continue
            normal = model.normal(part)
            words = model.words(part)
            ends, place = [], 0
            for w in words:
                place = normal.index(w, place) + len(w)
                ends.append(place)
            sums = list(accumulate(self.of_words(words), initial=0))
            n = bisect_right(sums, budget - used) - 1
            if n == len(words):
                used, at = used + sums[-1], at + len(normal)
                continue
            word, start = words[n], ends[n] - len(words[n])
            counts, best, held = prefix_counts(model, model.letters(word)), 0, 0
            for k in range(1, len(word)):
                c = counts[len(word[:k].encode())] if word[:k] not in _SPLIT_IN_PREFIX else sum(self.of_words([word[0], word[1]]))
                if used + sums[n] + c <= budget:
                    best, held = k, c
            return used + sums[n] + held, at + start + best
        return used, at


def counter(path: str) -> TokenCounter:
    return kept((TokenCounter, path), lambda: TokenCounter(path))


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit, fit_chars) for every row.

    Counts are those of the tokenizers library without begin and end tokens; special strings inside a text are special
    tokens. ``fit_chars`` is the length in code points of the longest prefix of the normalised text within ``limit`` tokens,
    null where the whole text is. Null counts as empty: 0 bytes, 0 tokens. Repeated rows and null ids stay; other columns are
    not looked at; an empty table gives an empty result; a text of any length is one text. One pass without a shuffle; a worker keeps counts of words, not of texts.
    """
    schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_()), ("fit_chars", pa.int64())])

    def run(batches):
        c = counter(tokenizer)

        def each():
            for group in by_size(rows(batches, "id", "text")):
                for (i, text), n in zip(group, c.count_all([t for _, t in group]), strict=True):
                    yield i, len(text.encode()), n, n > limit, c.fit(text, limit)[1] if n > limit else None

        return batched(schema, each())

    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, "id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")
