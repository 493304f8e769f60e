"""The two BPE operators against the tokenizers library."""

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from plumbline.llm import bpe_codec, token_counts
from plumbline.llm.bpe_codec import Codec, encode_words
from plumbline.llm.bpe_model import BpeModel
from plumbline.llm.token_counts import TokenCounter, prefix_counts

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
PIECES = ["a", "b", "the", "ing", " ", "  ", "\n", "\t", "\r\n", "'s", "'re", "'", "'lL", "É", "é", "ß", "İ", "Σ", "中", "한", "😀", "1", "２", "½", "!!", "<|endoftext|>", "<|startoftext|>", "<|", "́", "\x1c", "\x85", "\xa0", "　", "A", "tion", "aaaa", "Ա", "Ᲊ", "Ɤ", "٣", "‍", "Z", "-------", "\0"]


def texts(n=400):
    rnd = random.Random(5)
    made = ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 50))) for _ in range(n)]
    return made + ["", " ", "\n", " a", "a ", "a  b\tc", "a" * 3000, "ab" * 2000, "é" * 500, "x1" * 300, "word " * 3000]


@pytest.fixture(scope="module")
def libraries():
    return Tokenizer.from_file(WORD), Tokenizer.from_file(BYTE)


def test_counts_and_ids_are_the_librarys(libraries):
    word, byte = libraries
    counter, codec = TokenCounter(WORD), Codec(BYTE)
    held = texts()
    for text, ids in zip(held, codec.encode(held), strict=True):
        assert counter.count(text) == len(word.encode(text, add_special_tokens=False).ids)
        want = byte.encode(text, add_special_tokens=False).ids
        assert ids.decode() == ",".join(map(str, want))
        assert codec.decode(ids) == byte.decode(want, skip_special_tokens=False)


def test_every_prefix_has_its_count(libraries):
    word, byte = libraries
    for w in ("internationalisation", "aaaaaaaaaaa", "thththing"):
        for path, library in ((WORD, word), (BYTE, byte)):
            assert prefix_counts(BpeModel(path), w) == [len(library.encode(w[:n], add_special_tokens=False).ids) for n in range(len(w) + 1)]


def test_fit_is_the_longest_prefix_within_the_budget(libraries):
    word, _ = libraries
    counter = TokenCounter(WORD)
    for text in texts(120):
        if "<|" in text or len(text) > 200:
            continue
        normal = counter.model.normal(text)
        sizes = [len(word.encode(normal[:n], add_special_tokens=False).ids) for n in range(len(normal) + 1)]
        for budget in (1, 4, 9):
            used, chars = counter.fit(text, budget)
            assert sizes[chars] == used <= budget


def test_a_trie_serves_words_of_either_vocabulary(libraries):
    word, byte = libraries
    words = ["in", "inter", "internal", "internals", "", "int", "zzz"]
    for path, library in ((WORD, word), (BYTE, byte)):
        for w, ids in encode_words(BpeModel(path), words[:4] + words[5:]).items():
            assert ids == library.encode(w, add_special_tokens=False).ids


def test_queries_handle_odd_rows(spark, libraries):
    word, byte = libraries
    long = "naïve tokens of a very long text, " * 5000
    rows = [(1, None), (2, ""), (3, long), (3, long), (None, "x"), (4, "<|endoftext|>hi")]
    df = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], "doc_id long, text string, id string, n_tokens int")
    got = token_counts.count_tokens(df, WORD, limit=10).collect()
    assert sorted(map(str, ((r.id, r.n_bytes, r.n_tokens, r.over_limit) for r in got))) == sorted(map(str, ((d, len((t or "").encode()), n := len(word.encode(t or "", add_special_tokens=False).ids), n > 10) for d, t in rows)))
    got = bpe_codec.encode_decode(df, BYTE).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for d, t in rows:
        ids = byte.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), sha(",".join(map(str, ids))), sha(byte.decode(ids, skip_special_tokens=False))))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert token_counts.count_tokens(df.limit(0), WORD).count() == 0
    assert bpe_codec.encode_decode(df.limit(0), BYTE).count() == 0


def test_caches_forget_and_learn_again(libraries, monkeypatch):
    word, byte = libraries
    monkeypatch.setattr(bpe_codec, "HELD", 20)
    monkeypatch.setattr(bpe_codec, "GROUP", 200)
    monkeypatch.setattr(token_counts, "HELD", 20)
    counter, codec = TokenCounter(WORD), Codec(BYTE)
    rnd = random.Random(9)
    held = [" ".join(rnd.choice("abc") * rnd.randint(1, 9) + rnd.choice(["", ".", "'s"]) for _ in range(30)) for _ in range(60)]
    for text, ids in zip(held, codec.encode(held), strict=True):
        assert ids.decode() == ",".join(map(str, byte.encode(text, add_special_tokens=False).ids))
        assert counter.count(text) == len(word.encode(text, add_special_tokens=False).ids)
    assert len(codec._known.young) + len(codec._known.old) < 200


def test_a_stretch_is_looked_up_once_however_often_it_comes(libraries):
    _, byte = libraries
    asked = []

    class Counted(dict):
        def __getitem__(self, key):
            asked.append(key)
            return super().__getitem__(key)

    codec = Codec(BYTE)
    codec._known.young = Counted()
    held = ["one two, naïve\nthree two,\nfour " * n + "end." for n in (1, 700, 2000)] + ["\n", "", "a\nb", "a  b"]
    coded = codec.encode(held)
    assert [c.decode() for c in coded] == [",".join(map(str, byte.encode(t, add_special_tokens=False).ids)) for t in held]
    assert codec.decode_all(coded) == held and codec.decode_all([]) == [] and codec.decode_all([b"", b""]) == ["", ""]
    assert len(asked) < 100


def test_forgotten_pairs_are_found_again(libraries, monkeypatch):
    from plumbline.llm import bpe_model

    monkeypatch.setattr(bpe_model, "PAIRS", 7)
    model, (_, byte) = BpeModel(BYTE), libraries
    for w, ids in encode_words(model, ["internationalisation", "aaaaaaaaaaa", "thththing", "in", "zzzzz"]).items():
        assert ids == byte.encode(w, add_special_tokens=False).ids
    assert sum(map(len, model._apart.values())) == model._pairs <= 7
