"""BPE encoding and decoding of whole texts, over a trie of distinct words.

The distinct words of some texts are put into a trie, which is walked depth first. A node is a prefix; its state is the last token of the
prefix's encoding, which follows from the states above it. Words that begin alike share those states, so a common prefix is
encoded once for all of them. The trie is kept as its words in order: each is inserted where it leaves the branch of the one before, and
the states of the branch that the walk is on are all that it needs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm._common import Recent, batched, by_size, kept, rows, short_batches
from plumbline.llm.bpe_model import BpeModel

HELD = 80_000  # words and stretches between blanks whose encodings a worker keeps at least
GROUP = 4 << 20  # code points of texts whose words make a trie


def walk(model: BpeModel, words: Iterable[str]) -> Iterator[tuple[str, list[str]]]:
    """(word, its tokens) of each word, depth first over the trie of their letters."""
    lasts, states, before = [""], [""], ""
    for word in sorted(words):  # words that begin alike have letters that do
        letters, shared = model.letters(word), 0
        for x, y in zip(before, letters, strict=False):
            if x != y:
                break
            shared += 1
        del lasts[shared + 1 :], states[shared + 1 :]
        model.extend(letters, lasts, states)
        before = letters
        n, tokens = len(letters), []
        if n and model.suffix:
            tokens.append(model.closing(n, lasts, states))
            n -= len(tokens[0]) - len(model.suffix)
        while n:
            tokens.append(lasts[n])
            n -= len(lasts[n])
        yield word, tokens[::-1]


def encode_words(model: BpeModel, words: Iterable[str]) -> dict[str, list[int]]:
    """The ids of each word."""
    return {word: [model.ids[t] for t in tokens] for word, tokens in walk(model, words)}


def stretches(texts: pa.Array) -> pa.ListArray:
    """Evenly spaced texts cut at their white space: a stretch after a blank keeps it, and an empty one stands for each line feed."""
    return pc.split_pattern(pc.replace_substring(pc.replace_substring(texts, "\n", "\n\n"), " ", "\n "), "\n")


def together(values: pa.LargeBinaryArray, offsets: pa.Array) -> list[bytes]:
    """The values between each two offsets, one after the other, as one: in Arrow's buffer they stand like this."""
    if not len(values):
        return [b""] * (len(offsets) - 1)
    _, at, held = values.buffers()
    ends = np.frombuffer(at, np.int64)[values.offset :][offsets.to_numpy()].tolist()
    data = memoryview(held or b"")
    return [bytes(data[a:b]) for a, b in pairwise(ends)]


class Codec:
    """Encodes and decodes texts with one byte-level vocabulary."""

    def __init__(self, path: str, held: int = HELD, group: int = GROUP):
        self.model, self.group = BpeModel(path), group
        byte_of = {letter: b for b, letter in enumerate(self.model.letters_of_bytes)}
        tokens = {i: token for token, i in [*self.model.ids.items(), *self.model.special.items()]}
        held_bytes = (None if t is None else bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode() for t in map(tokens.get, range(max(tokens) + 1)))
        self.bytes_of = pa.array(held_bytes, pa.large_binary(), size=max(tokens) + 1)
        self.decimal = {token: b"%d" % i for token, i in self.model.ids.items()}
        self._known: Recent[str, bytes] = Recent(held)  # words, and stretches: those after a blank with it, those that begin a line without
        self.newline = b"%d" % self.model.ids[self.model.letters("\n")]

    def _learn(self, words: set[str]) -> None:
        """Encode those words that aren't known yet."""
        decimal = self.decimal.__getitem__
        self._known.add({word: b",".join(map(decimal, tokens)) for word, tokens in walk(self.model, self._known.missing(words))})

    def encode(self, texts: list[str]) -> list[bytes]:
        """The decimal ids of each text joined by commas."""
        model = self.model
        out: list[bytes] = []
        for group in by_size(((0, t) for t in texts), self.group):
            self._known.turn()
            parts = [[(part, special, not special and model.evenly_spaced(part)) for part, special in model.sections(t)] for _, t in group]
            words: set[str] = set()
            words.update(*(model.words(part) for each in parts for part, special, even in each if not special and not even))
            cut = stretches(pa.array([part for each in parts for part, _, even in each if even], pa.large_string()))
            runs = cut.flatten().dictionary_encode()
            seen = runs.dictionary.to_pylist()  # each stretch once; where they stand stays in Arrow's arrays
            new = self._known.missing({r for r in seen if r})
            plain = [r for r in new if r.removeprefix(" ").isalpha()]  # a word by itself
            apart = [(r, model.words(r)) for r in new.difference(plain)]
            words.update(plain, *(a[1] for a in apart))
            self._learn(words)
            known = self._known.young
            self._known.add({r: b",".join(map(known.__getitem__, held)) for r, held in apart})
            coded = pa.array([(known[r] if r else self.newline) + b"," for r in seen], pa.large_binary()).take(runs.indices)
            even_ones = iter(together(coded, cut.offsets))
            del seen, words, new, plain, apart, cut, runs, coded
            for each in parts:
                # a stretch is cut into words again rather than held as words: it has many more of them than are different
                made = [b"%d" % model.special[part] if special else next(even_ones)[:-1] if even else b",".join(map(known.__getitem__, model.words(part))) for part, special, even in each]
                out.append(b",".join(x for x in made if x))
        return out

    def decode_all(self, coded: list[bytes]) -> list[str]:
        """The texts of decimal ids joined by commas; special tokens give their strings, broken UTF-8 the replacement character."""
        ids = pc.split_pattern(pa.array([c for c in coded if c], pa.large_binary()).cast(pa.large_string()), ",")
        tokens = self.bytes_of.take(ids.flatten().cast(pa.int32()))
        whole = iter(together(tokens, ids.offsets))
        return [next(whole).decode("utf-8", "replace") if c else "" for c in coded]

    def decode(self, ids: bytes) -> str:
        """The text of one."""
        return self.decode_all([ids])[0]


def codec(path: str, held: int = HELD, group: int = GROUP) -> Codec:
    return kept((Codec, path, held, group), lambda: Codec(path, held, group))


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", held: int = HELD, group: int = GROUP) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) for every row.

    Ids are the tokenizers library's with ``add_special_tokens=False``; special strings inside a text are special tokens. Null
    counts as empty: no tokens, both digests those of the empty string. Repeated rows and null ids stay; other columns are not
    looked at; an empty table gives an empty result, a text of any length is one text. One pass without a shuffle; memory is that of ``held`` kept words or
    twice as many and of ``group`` code points of text or one longer text. Smaller ones take less memory and more time; results are the same.
    """
    short_batches(docs.sparkSession)
    schema = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches):
        c = codec(tokenizer, held, group)

        def each():
            for some in by_size(rows(batches, "id", "text"), group):
                made = c.encode([t for _, t in some])
                for (i, _), coded, text in zip(some, made, c.decode_all(made), strict=True):
                    yield i, coded.count(b",") + 1 if coded else 0, hashlib.sha256(coded).hexdigest(), hashlib.sha256(text.encode()).hexdigest()

        return batched(schema, each())

    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
