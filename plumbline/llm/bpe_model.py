"""A BPE vocabulary file as tables, its rules for neighbouring tokens, and its cutting of texts into words.

BPE has a local structure that the two encoders build on. A token sequence is the encoding of its text exactly if each
token encodes itself and each two neighbours stand next to each other in the encoding of their joint text. Hence the
encoding of a prefix is the encoding of a shorter prefix plus one last token, and there is only one such token.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import regex
from tokenizers import Tokenizer

_NEVER = 1 << 60
PAIRS = 300_000  # of tokens, whether they stand apart, that a model keeps
#: Code points on which the ``regex`` and ``unicodedata`` modules are known to agree with the tokenizers library; texts
#: with others (new scripts, capital sigma, whose lower case depends on its place here) take the library's own splitters.
_KNOWN = r"\x00-\x1b\x20-˿Ͱ-΢Τ-ԧ֐-ۿऀ-ॣ‐-⁤€℀-⅏←-⏿─-➿、-鿿가-힣＀-～\U0001f300-\U0001f64f"
_ODD = re.compile(f"[^{_KNOWN}]")

_BLANK = re.compile(f"[^{_KNOWN}]|[\t\r\x0b\x0c\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def byte_letters() -> list[str]:
    """The visible letter of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the others follow from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class BpeModel:
    """The tables of a ``tokenizers`` BPE file, with byte-level letters."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.rank = {p: i for i, p in enumerate(pairs)}
        self.parts = {a + b: (a, b) for a, b in pairs}
        if len(self.parts) != len(pairs):
            raise ValueError("a token of this vocabulary has two derivations")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.letters_of_bytes = byte_letters()
        self._letters = dict(enumerate(self.letters_of_bytes))
        self._apart: dict[str, dict[str, bool]] = {}  # by the right token, then the left one
        self._pairs = 0
        self._edges: tuple[dict, dict] = ({}, {})
        self._special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")
        # the library's splitters alone; the vocabulary is held once, here
        self._library = Tokenizer.from_str(json.dumps({**spec, "model": {"type": "BPE", "vocab": {}, "merges": []}, "added_tokens": [], "post_processor": None}))
        self.whole = self._self_encoding()
        self.heads, self.tails = self._heads()
        self.lower = spec["normalizer"] is not None
        self._word = regex.compile(
            r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
            if self.lower
            else r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        )

    def letters(self, word: str) -> str:
        """The word's UTF-8 bytes as byte letters."""
        if word.isascii() and word.isprintable():  # the blank alone has another letter
            return word.replace(" ", self._letters[32])
        return word.encode().decode("latin-1").translate(self._letters)

    def words(self, text: str) -> list[str]:
        """The words of a stretch of text without special tokens, normalised where the vocabulary is; BPE never crosses them."""
        odd = _ODD.search(text)
        if self.lower:
            text = self._library.normalizer.normalize_str(text) if odd else (text if text.isascii() else unicodedata.normalize("NFC", text)).lower()
        if odd:
            return [text[a:b] for _, (a, b) in self._library.pre_tokenizer.pre_tokenize_str(text)]
        return self._word.findall(text)

    def normal(self, text: str) -> str:
        """The text as the splitting pattern sees it (white space that it drops is left as it is)."""
        return self._library.normalizer.normalize_str(text) if self.lower else text

    def plain_letters(self, text: str) -> bool:
        """Whether the text has no letter on which Python and the library might differ."""
        return not _ODD.search(text)

    def evenly_spaced(self, text: str) -> bool:
        """Whether the white space is single blanks and line feeds between words, so that stretches between it can be cut apart."""
        return len(text.split()) == text.count(" ") + text.count("\n") + 1 and not _BLANK.search(text)

    def sections(self, text: str) -> Iterator[tuple[str, bool]]:
        """The text's stretches, each with whether it is the string of a special token."""
        if "<|" not in text:
            yield text, False
            return
        for i, part in enumerate(self._special.split(text)):
            if part:
                yield part, i % 2 == 1

    def _edge(self, token: str, side: int) -> list[tuple[str, int]]:
        """The tokens that share the left (0) or right (1) end of ``token``, outermost first, each with the rank of the merge that uses it up."""
        known = self._edges[side].get(token)
        if known is None:
            known, used, part = [], _NEVER, token
            while True:
                known.append((part, used))
                if part not in self.parts:
                    break
                used = self.rank[self.parts[part]]
                part = self.parts[part][side]
            self._edges[side][token] = known
        return known

    def _first_across(self, a: str, b: str) -> int:
        """The rank of the earliest merge across the seam of ``a`` and ``b`` that finds both of its sides still there.

        Of two places where one merge applies the left one goes first, hence < on the left and <= on the right.
        """
        found, rank, right = _NEVER, self.rank, self._edge(b, 0)
        for x, x_used in self._edge(a, 1):
            for y, y_used in right:
                r = rank.get((x, y))
                if r is not None and r < x_used and r <= y_used and r < found:
                    found = r
        return found

    def apart(self, a: str, b: str) -> bool:
        """Whether the encoding of the joint text of two tokens, each encoding itself, is these two."""
        lefts = self._apart.setdefault(b, {})
        known = lefts.get(a)
        if known is None:
            if self._pairs >= PAIRS:
                for each in self._apart.values():  # emptied where they are: the ends of beginnings hold them, too
                    each.clear()
                self._pairs = 0
            self._pairs += 1
            known = lefts[a] = self._first_across(a, b) == _NEVER
        return known

    def _self_encoding(self) -> frozenset[str]:
        """The tokens of the vocabulary that are what their own text is encoded as."""
        good = {t for t in self.ids if t not in self.parts and len(t.removesuffix(self.suffix) if self.suffix else t) == 1}
        for pair in self.rank:  # parts come before what is made of them
            if pair[0] in good and pair[1] in good and self._first_across(*pair) == self.rank[pair]:
                good.add(pair[0] + pair[1])
        return frozenset(good)

    def _heads(self) -> tuple[dict[str, tuple[tuple[int, str, dict[str, bool]], ...]], dict[str, tuple[str, ...]]]:
        """For each beginning of a token: the tokens that it ends with, longest first; and those that it and the suffix, if there is one, end with.

        Each of the first comes with its length and with what ``apart`` knows of it, so that a walk asks for a left neighbour alone.

        These are the states of a walk over a word's letters: what can still become a token is the longest end of the letters so far that
        is such a beginning, so a letter more is looked up among these alone.
        """
        n = len(self.suffix)
        closed = {t[:-n] for t in self.whole if t.endswith(self.suffix)} if n else set()
        opened = {t for t in self.whole if not n or not t.endswith(self.suffix)}
        heads = {t[:i] for t in (*opened, *closed) for i in range(len(t) + 1)}
        ends = lambda head, held: [head[i:] for i in range(len(head)) if head[i:] in held]
        told = {t: (len(t), t, self._apart.setdefault(t, {})) for t in opened}
        return {h: tuple(told[t] for t in ends(h, opened)) for h in heads}, {h: tuple(t + self.suffix for t in ends(h, closed)) for h in heads if n}

    def extend(self, letters: str, lasts: list[str], states: list[str]) -> None:
        """Carry on along a word: ``lasts[i]`` is the last token of the encoding of its first i letters, ``states[i]`` their state.

        Both lists hold the letters that are known, from none (two empty strings) on, and are extended by the others. A prefix has one last
        token: the one that stands apart from the last token of what is before it.
        """
        heads, state = self.heads, states[-1]
        for letter in letters[len(lasts) - 1 :]:
            state += letter
            while (ends := heads.get(state)) is None:
                state = state[1:]
            for n, token, lefts in ends:
                left = lasts[-n]  # none, an empty string, where the token is all of the prefix
                fits = lefts.get(left)
                if fits is None:
                    fits = self.apart(left, token)
                if fits:
                    break
            else:
                raise ValueError(f"no token ends {letters[: len(lasts)]!r}")
            lasts.append(token)
            states.append(state)

    def closing(self, n: int, lasts: list[str], states: list[str]) -> str:
        """The last token of the first n letters as a whole word; of vocabularies with a suffix it has that, too."""
        if not self.suffix:
            return lasts[n]
        for token in self.tails[states[n]]:
            start = n + len(self.suffix) - len(token)
            if not start or self.apart(lasts[start], token):
                return token
        raise ValueError(f"no token ends a word of {n} letters")
