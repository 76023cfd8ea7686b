"""The pipeline's stages on odd rows, and links of vectors that share an id."""

import gc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from conftest import DATA
from corpusloom.llm import bpe, embeddings, pieces, shared, simhash
from corpusloom.llm.queries import piece_model, vocabulary
from corpusloom.llm.shared import no_cycles

WIDE = "doc_id long, text string, lang string, source string, n_chars long, copies int, copy int, row int, __row int, `a.b` int"


def story(k):
    return " ".join(f"w{k * 100 + i}" for i in range(40))


@pytest.fixture(scope="module")
def wide(spark):
    """Unrelated texts under repeated and null ids, twins, nulls and empty texts, with columns named like inner ones."""
    rows = [(5, story(1)), (2, story(2)), (5, story(3)), (None, story(4)), (None, story(5)), (9, story(1)), (1, story(5)), (7, None), (8, "  "), (7, None)]
    rows = [(i, t, "en", f"s{k % 2}", len(t or ""), 9, 9, 9, 9, 9) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(rows, WIDE)


def test_near_dedup_keeps_one_row_of_each_group(spark, wide):
    out = corpus_pipeline.near_dedup(spark, wide, DATA)
    assert out.columns == wide.columns
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter([(5, story(1)), (2, story(2)), (5, story(3)), (None, story(4)), (1, story(5)), (7, None)])


def test_near_dedup_deals_the_keys_of_fingerprints(spark, wide, monkeypatch):
    plans = []

    def components(edges):
        plans.append(edges._jdf.queryExecution().executedPlan().toString())
        return shared.components(edges)

    monkeypatch.setattr(simhash, "components", components)
    corpus_pipeline.near_dedup(spark, wide, DATA)
    assert len(plans) == 1 and "SortMergeJoin" in plans[0] and "Broadcast" not in plans[0]


def test_mixing_keeps_every_column(spark, wide):
    out = corpus_pipeline.mix_sources(spark, wide, DATA)
    assert out.columns == wide.columns and out.schema == wide.schema
    rows, given = Counter(map(tuple, out.collect())), Counter(map(tuple, wide.collect()))
    assert set(rows) <= set(given) and all(r[5:] == (9,) * 5 for r in rows)
    assert all(n <= 2 * given[r] for r, n in rows.items() if r[1])
    words = lambda found: sum(n * len((r[1] or "").split()) for r, n in found.items())
    assert abs(words(rows) - 1.5 * words(given)) <= 80


@pytest.mark.parametrize("kind", ["odd", "empty", "wide"])
def test_every_stage_on_odd_tables(spark, request, kind):
    rows = request.getfixturevalue(kind)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, rows, DATA)
        got = out.collect()
        assert out.columns == (rows.columns if name != "encoding" else ["doc_id", "ids", "decoded"]), name
        assert len(got) == 0 if kind == "empty" else len(got) <= 2 * rows.count(), name


def test_vectors_that_share_an_id_keep_their_own_links(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(2, 8))
    near = lambda v: (v + rng.normal(size=8) * 1e-3).tolist()
    rows = [(1, a.tolist(), 0), (1, b.tolist(), 0), (2, near(b), 0), (3, near(a), 0), (3, a.tolist(), 1)]
    got = embeddings.near_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert Counter(map(tuple, got)) == Counter([(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (3, 0, 3, True)])


def test_new_capitals_and_caches_that_end_with_the_task(spark):
    from tokenizers import Tokenizer

    library, coder = Tokenizer.from_file(vocabulary()), bpe.words_of(open(vocabulary(), encoding="utf-8").read())
    texts = [f"a{chr(c)}b {chr(c)}" for c in sorted(bpe.LOWER)]
    assert len(texts) == 55
    for text, (ids, _) in zip(texts, coder.encode_texts(texts)):
        assert [int(i) for i in ids.split()] == library.encode(text, add_special_tokens=False).ids
    coder.forget()
    assert not (coder.fits or coder.chunks or coder.older or coder.sizes or coder.older_sizes)


def test_a_word_with_a_sign_behind_it_is_not_walked_again(monkeypatch):
    coder = bpe.words_of(open(vocabulary(), encoding="utf-8").read())
    coder.forget()
    asked, walk = [], coder.encode_words
    monkeypatch.setattr(coder, "encode_words", lambda words, **how: asked.append(set(words)) or walk(words, **how))
    words = ["erungchzu", "größe", "ononanti"]
    alone = list(coder.encode_texts(words))
    with_signs = list(coder.encode_texts([w + s for w in words for s in ".,1"]))
    assert asked[1] == {".", ",", "1"}
    signs = list(coder.encode_texts([".", ",", "1"]))
    assert with_signs == [(f"{a[0]} {s[0]}", f"{a[1]} {s[1]}") for a in alone for s in signs]
    assert coder.count_texts([w + s for w in words for s in ".,1"]) == [a[0].count(" ") + 2 for a in alone for _ in signs]
    coder.forget()


def test_words_of_an_earlier_generation_are_not_merged_again(monkeypatch):
    monkeypatch.setattr(pieces, "KEPT_WORDS", 2)
    coder = pieces.pieces_of(open(piece_model(), "rb").read())
    coder.forget()
    asked, learn = [], coder.learn
    monkeypatch.setattr(coder, "learn", lambda words: asked.append(set(words)) or learn(words))
    first = list(coder.encode_texts(["erungchzu größe ononanti"]))
    assert list(coder.encode_texts(["erungchzu größe ononanti"])) == first
    assert len(asked[0]) == 3 and not asked[1]
    coder.forget()
    assert not (coder.words or coder.older)


def test_encoding_does_not_look_for_cycles(spark):
    def seen(batches):
        with no_cycles():
            yield from batches
            assert not gc.isenabled()
        assert gc.isenabled()

    assert spark.range(10).mapInArrow(seen, "id long").count() == 10


def test_encoding_blocks_end_by_size_and_caches_are_bounded(spark, monkeypatch):
    batch = pa.record_batch({"doc_id": range(5), "text": ["a" * bpe.BLOCK_BYTES, None, "b", "c" * bpe.BLOCK_BYTES, "d"]})
    assert [b.column(0).to_pylist() for b in bpe.blocks(batch)] == [[0], [1, 2, 3], [4]]
    assert [b.num_rows for b in bpe.blocks(pa.record_batch({"doc_id": range(1025), "text": ["x"] * 1025}))] == [512, 512, 1]
    assert not list(bpe.blocks(batch.slice(5)))
    assert bpe.id_lists(["1 48000", "", "7"]).to_pylist() == [[1, 48000], [], [7]] and not len(bpe.id_lists([]))
    docs = spark.createDataFrame([(i, f"word{i} größe ononanti{i % 3}.") for i in range(700)] + [(700, None)], "doc_id long, text string").coalesce(1)
    whole = sorted(map(tuple, bpe.encoded(docs, vocabulary()).collect()))
    assert sorted(map(tuple, bpe.encoded(docs, vocabulary(), kept=1).collect())) == whole
