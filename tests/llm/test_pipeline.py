"""The whole pipeline on small tables: what comes out of defects, and of nothing."""

import hashlib
import re
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from plumbline.llm import mixing, quality, toxicity
from plumbline.llm._common import materialize

COLUMNS = "doc_id long, text string, lang string, source string, n_chars int, gone string, id string, size int, score double"
PROSE = "The river rose slowly over the old meadow, and by the evening every gate on the lower road stood open to the water. "


def tables(spark, tmp_path, rows):
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, None), (None, 1, 0), (99, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("rows", [[], [(1, PROSE, "en", "a", 1, "x", "y", 1, 0.5), (1, PROSE, "en", "a", 1, "x", "y", 1, 0.5), (2, None, None, None, None, None, None, None, None), (3, "", "en", None, 0, "x", "y", 1, 0.5), (None, PROSE * 30, None, "b", None, "x", "y", 1, 0.5), (5, PROSE + "So it was.", "en", "b", 1, "x", "y", 1, 0.5)]], ids=["empty", "defects"])
def test_defects_and_nothing(spark, tmp_path, rows):
    """Nulls, repeated rows, copies and names that stages use themselves: no stage fails, and what comes out came in."""
    got = corpus_pipeline.run(spark, tables(spark, tmp_path, rows))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    found = got.collect()
    assert {r.doc_id for r in found} <= {r[0] for r in rows}
    assert all(len(r.ids_sha256) == len(r.decoded_sha256) == 64 for r in found)


def plain_shingles(text):
    """The text's runs of five words as simhash_groups has them: all words where there are fewer, nothing at all where there is none."""
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else {b""}


def test_each_stage_against_plain_recomputation(spark):
    """What each stage keeps of what it gets: scores text by text, all pairs of shingle sets, the rules of a mix, and the tokenizers library."""
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    seen = {r.doc_id: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())

    toxic = toxicity.fitted(docs, labels)
    docs = materialize(stages["toxicity"](spark, docs, sf_dir), "t")
    assert ids(docs) == [i for i in sorted(seen) if toxic.score(seen[i].text or "") < 0.3] and 0 < docs.count() < len(seen)

    _, scorer = quality.fitted(docs)
    before = ids(docs)
    docs = materialize(stages["quality"](spark, docs, sf_dir), "q")
    assert ids(docs) == [i for i in before if scorer.score(seen[i].text or "") >= 0.5] and 0 < docs.count() < len(before)

    before = ids(docs)
    sets, home = {i: plain_shingles(seen[i].text) for i in before}, {i: i for i in before}
    top = lambda i: i if home[i] == i else top(home[i])
    for a in before:
        for b in before:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                home[y] = x
    docs = materialize(stages["simhash_near_dedup"](spark, docs, sf_dir), "s")
    assert ids(docs) == [i for i in before if top(i) == i] and docs.columns == list(seen[before[0]].asDict())

    rows = docs.collect()
    words = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows}
    targets = {r.source: r.target for r in mixing.mix(docs).select("doc.source", "target").distinct().collect()}
    docs = materialize(stages["mixing"](spark, docs, sf_dir), "m")
    drawn = Counter(ids(docs))
    assert set(drawn) <= set(words) and max(drawn.values()) <= 3
    assert sum(targets.values()) == pytest.approx(sum(words.values()))
    for source, target in targets.items():
        own = [i for i in words if seen[i].source == source]
        taken = sum(words[i] * drawn[i] for i in own)
        assert taken <= target + 1e-6 and target - taken <= min((words[i] for i in own if words[i]), default=0)

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.no_truncation()
    library.no_padding()
    coded = {i: library.encode(seen[i].text or "", add_special_tokens=False).ids for i in drawn}
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in stages["bpe_codec"](spark, docs, sf_dir).collect())
    want = [(i, len(coded[i]), sha(",".join(map(str, coded[i]))), sha(library.decode(coded[i], skip_special_tokens=False))) for i in drawn.elements()]
    assert got == sorted(want)
