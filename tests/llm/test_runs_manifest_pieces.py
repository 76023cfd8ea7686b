"""Operators 11 to 13 against brute force, plain trees and the library."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece

from corpusloom.llm import manifest, pieces, runs
from corpusloom.llm.queries import piece_model
from llm.test_operators_llm import WORDS, sha

# 11 runs


def brute_lyndon(word):
    out = []
    for i in range(len(word)):
        j = i + 1
        while j < len(word) and word[i:] < word[j:]:
            j += 1
        out.append(j - i)
    return out


def brute_runs(word, least):
    found = set()
    for q in range(1, len(word) // 2 + 1):
        i = 0
        while i + q < len(word):
            j = i
            while j + q < len(word) and word[j] == word[j + q]:
                j += 1
            part = word[i : j + q]
            if len(part) >= max(least, 2 * q) and not any(all(a == b for a, b in zip(part, part[r:])) for r in range(1, q)):
                found.add((i, len(part), q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def some_word(rng):
    letters = rng.choice([1, 2, 2, 3, 6])
    draw = lambda n: [rng.randrange(letters) for _ in range(n)]
    return draw(rng.randrange(30)) + (draw(rng.randrange(1, 9)) * 9)[: rng.randrange(60)] + draw(rng.randrange(1, 8))


def test_lyndon_arrays_and_runs():
    rng = random.Random(4)
    for _ in range(1500):
        word = some_word(rng)
        lengths, groups = runs.lyndon_array(np.array(word))
        assert lengths == brute_lyndon(word)
        same = {}
        for i, g in enumerate(groups):
            assert same.setdefault(g, word[i : i + lengths[i]]) == word[i : i + lengths[i]]
        assert len({tuple(v) for v in same.values()}) == len(same)
        for least in (2, 5, 12):
            assert runs.runs(np.array(word), least) == brute_runs(word, least), word


def test_long_and_periodic_words():
    assert runs.runs(np.zeros(200_000, np.int64)) == [(0, 200_000, 1)]
    assert runs.runs(np.arange(100_000) % 777) == [(0, 100_000, 777)]
    assert runs.runs(np.arange(50_000)) == [] == runs.runs(np.array([], np.int64))
    a, b = [0], [0, 1]
    while len(b) < 1500:
        a, b = b, b + a
    assert runs.runs(np.array(b)) == brute_runs(b, 12)


def plain_edit(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_find_runs(spark, odd, empty):
    rng = random.Random(6)
    texts = [None, "", " \n "] + [" ".join(map(str, some_word(rng))) for _ in range(120)] + ["\n".join(["x y z"] * 9) + " é", " ".join(["ab"] * 5000)]
    rows = [(7 * i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(*r, 1, "a") for r in rows], "doc_id long, text string, start int, runs string")
    got = {r.doc_id: r for r in runs.find_runs(docs, periodic=True, digests=True).collect()}
    assert len(got) == len(rows) and sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 5
    for i, text in rows:
        words = plain_edit(i, WORDS.findall(text or ""))
        found = [(0, 5000, 1)] if len(words) == 5000 else brute_runs(words, 12)
        out = {k for s, m, q in found for k in range(s + q, s + m)}
        best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
        r = got[i]
        assert (r.n_runs, r.start, r.length, r.period) == (len(found), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if found else None)
        assert r.runs_sha256 == sha("".join(f"{s},{m},{q}\n" for s, m, q in found))
        assert r.collapsed_sha256 == sha(" ".join(w for k, w in enumerate(words) if k not in out))
    plain = {r.doc_id: r for r in runs.find_runs(docs).collect()}
    assert [tuple(x) for x in plain[7 * 123].runs] == [(0, 27, 3)] and plain[7 * 123].collapsed == "x y z é" and plain[0].runs == []
    assert runs.find_runs(odd, periodic=True, digests=True).count() == odd.count() and runs.find_runs(empty).count() == 0


# 12 manifest


def plain_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def plain_path(levels, at):
    out = []
    for level in levels[:-1]:
        run = at // 8 * 8
        out.append(("".join(level[run:at]), "".join(level[at + 1 : run + 8])))
        at //= 8
    return out


def test_log_positions():
    for n in [*range(1, 140), 511, 512, 513, 600, 4097]:
        levels = plain_tree([str(i) for i in range(n)])
        log = manifest.append_log(levels[0], manifest.height(n))
        assert len(log) == sum(map(len, levels)) == manifest.subtree(n, manifest.height(n))
        assert all(log[manifest.position(k, j, n)] == h for k, level in enumerate(levels) for j, h in enumerate(level))


def plain_leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def check_proofs(docs, levels):
    rows = [tuple(r[c] for c in ("doc_id", "source", "lang", "n_chars", "text")) for r in docs.collect()]
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is None, r[0] or 0, plain_leaf(r), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [plain_tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in order]
    top = plain_tree([t[-1][0] for t in trees])
    want = Counter()
    for k, g in enumerate(order):
        for place, (_, _, leaf, r) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            steps = plain_path(trees[k], place) + plain_path(top, k)
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            at = plain_leaf((*r[:4], None if r[4] is None else r[4].encode().lower().decode())) if hit else leaf
            for left, right in steps:
                at = sha(left + at + right)
            want[r[0], leaf, trees[k][-1][0], top[-1][0], sha("".join(a + b for a, b in steps)), at, at == top[-1][0]] += 1
    assert Counter(map(tuple, manifest.verified_documents(docs, levels=levels).collect())) == want
    return want


def test_proofs_of_documents(docs, odd):
    check_proofs(docs, 3)
    check_proofs(odd, 3)


def test_proofs_over_several_rounds_and_many_groups(spark):
    rng = random.Random(8)
    langs = [None, "", "é", "z", *[f"l{i}" for i in range(30)]]
    rows = [(i if i % 50 else None, f"Text {i}", rng.choice(langs[:2] if i % 2 else langs), "s", i) for i in range(900)]
    found = check_proofs(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int"), 1)
    assert {k[6] for k in found} == {True, False}


def test_manifest_of_nothing_and_of_one(spark, docs, empty):
    assert manifest.verified_documents(empty).count() == 0
    one = manifest.verified_documents(docs.limit(1), tamper=False).first()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.verified and one.proof_sha256 == sha("")


def test_proofs_carry_their_siblings(docs):
    made = manifest.manifest(manifest.document_leaves(docs))
    for r in manifest.proofs(made, steps=True).collect():
        assert manifest.folded(r.leaf, [(s.left, s.right) for s in r.steps]) == r.root


# 13 pieces


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=piece_model())


@pytest.fixture(scope="module")
def coder():
    with open(piece_model(), "rb") as f:
        return pieces.PieceTokens(f.read())


def agrees(coder, library, texts):
    for text, (ids, shown) in zip(texts, coder.encode_texts(texts), strict=True):
        want = library.encode(text)
        assert [int(i) for i in ids.split(",") if i] == want, text
        assert shown == library.decode(want) == coder.decode(want), text


def test_pieces_equal_the_library(spark, docs, texts, odd, empty, library, coder):
    given = [t or "" for _, t in texts] + ["", " ", "  a  ", "\0x", "▁a ▁b▁", "<s>hi</s><unk>", "<0x0A>\n", "😀é日本", "﻿ﬁ\xa0　c", "a" * 5000, " " * 999, "ab" * 700, "\r\n;\r"]
    agrees(coder, library, given)
    got = {r.doc_id: r for r in pieces.encoded(docs, piece_model(), digests=True).collect()}
    plain = {r.doc_id: r for r in pieces.encoded(docs, piece_model()).collect()}
    for i, text in texts:
        ids = library.encode(text or "")
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert got[i].decoded_sha256 == sha(library.decode(ids)) and plain[i].ids == ids and plain[i].decoded == library.decode(ids)
    assert pieces.encoded(odd, piece_model()).count() == odd.count() and pieces.encoded(empty, piece_model()).count() == 0


def test_pieces_on_random_letters(library, coder, monkeypatch):
    rng = random.Random(9)
    monkeypatch.setattr(pieces, "KEPT_WORDS", 50)  # known words leave all the time
    for letters in (coder.alphabet + list("日本\n\0😀") + [" "] * 50, "aeiouthsrn ▁_()=;.0123456789ABC", "ab ", "= -", " ▁"):
        agrees(coder, library, ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 600))) for _ in range(150)])
    for _ in range(500):
        ids = [rng.randrange(3, 32000) if rng.random() < 0.6 else rng.randrange(3, 259) for _ in range(rng.randrange(30))]
        assert coder.decode(ids) == library.decode(ids), ids


def test_very_long_words(library, coder):
    rng = random.Random(10)
    agrees(coder, library, ["x9Q" * 50_000, "the" * 50_000, "".join(rng.choice("abcdefghij=") for _ in range(60_000)), "日本語" * 30_000, " " * 100_000])
    assert all(len(w) <= pieces.KEPT_LENGTH for w in coder.words)


def test_unsuitable_models_are_refused():
    with pytest.raises((ValueError, KeyError)):
        pieces.PieceTokens(b"\x12\x02\x18\x01")
