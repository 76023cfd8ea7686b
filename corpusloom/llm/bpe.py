"""Operator 9: BPE encoding and decoding by a depth-first walk over the trie of distinct words.

A byte-pair encoding has this property: the tokens of a prefix are the tokens of a shorter prefix
plus one last token. So one number per trie node, its last token, holds the encoding of the whole
path to it. Distinct words of a block of rows are sorted, which is the depth-first order of their
trie; the walk keeps the states of the current path, goes back to the prefix that the next word
shares and continues there. A token may follow another if merging the two alone gives just these two.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from corpusloom.llm.shared import give_back, no_cycles

#: Distinct chunks (in each of two generations) and token pairs that a task keeps between its blocks; more are worked out again.
KEPT_CHUNKS, KEPT_PAIRS, BLOCK_ROWS = 110_000, 300_000, 512
#: Chunks kept by a worker of an executor whose heap is already full of earlier stages.
KEPT_BESIDE_STAGES = 40_000
#: Bytes of text at which a block ends before it has that many rows.
BLOCK_BYTES = 1 << 20
#: The same where only counts are wanted: a number takes less room than ids and tokens.
KEPT_COUNTS = 250_000

# Fixed values of this kind of vocabulary file: its pre-tokenizer pattern and Unicode white space.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}--[NEW]]+|[\p{N}--[NEW]]|[[^\s\p{L}\p{N}][NEW]]+"
# Letters and numbers that the regex module knows but the vocabulary's library does not yet.
NEW = """
    558-558 58b-58c 88f-88f c5c-c5c cdc-cdc 208f-208f
    209d-209f a7ce-a7cf a7d2-a7d2 a7d4-a7d4 a7dd-a7dd a7e2-a7e2
    a7f1-a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee
    11b0a-11b0a 11db0-11ddb 11de0-11de9 11df1-11df1 1246f-1246f 12475-1247f
    12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda
    18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168-1b168
    1d6a6-1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de
    1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f
    2b81e-2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f
"""
# Capitals that the vocabulary's library lower-cases and Python's own tables do not know yet, as first, last, lower case of the first.
NEW_CAPITALS = """
    1c89-1c89-1c8a a7cb-a7cb-264 a7cc-a7cc-a7cd a7ce-a7ce-a7cf a7d2-a7d2-a7d3 a7d4-a7d4-a7d5
    a7da-a7da-a7db a7dc-a7dc-19b 10d50-10d65-10d70 16ea0-16eb8-16ebb
"""
BLANKS = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
BETWEEN = re.compile(f"[{BLANKS}]+")
NOT_BLANK = re.compile("[\x1c-\x1f]")  # str.split() parts at these, the vocabulary's pattern doesn't

NEW_CLASS = re.sub(r"(\w+)-(\w+)\s+", lambda m: rf"\U{m[1]:0>8}-\U{m[2]:0>8}", NEW.strip() + "\n")

CAPITAL_RANGES = [[int(x, 16) for x in r.split("-")] for r in NEW_CAPITALS.split()]
LOWER = {c: low + c - first for first, last, low in CAPITAL_RANGES for c in range(first, last + 1)}
HAS_NEW_CAPITAL = re.compile("[" + "".join(map(chr, LOWER)) + "]")

OLD_LETTERS = "\u0250"  # below it every version of Unicode knows the same letters

DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
CODES = "doc_id long, ids array<int>, decoded string"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where visible, else 256, 257, ... in turn."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


class WordTokens:
    """Tokens of words under one vocabulary."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        self.ranks = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(model["merges"])}
        self.halves = {a + b: (a, b) for a, b in reversed(self.ranks)}  # the two parts that a token is made of
        self.rank_of = {t: self.ranks[p] for t, p in self.halves.items()}
        self.one_way = len(self.halves) == len(self.ranks)  # no token is made in two ways
        self.inner, self.last = self.lengths_by_ending(False), self.lengths_by_ending(True)
        self.letters = {b: c for b, c in enumerate(byte_letters())}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.stops = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pieces = regex.compile(PIECES.replace("NEW", NEW_CLASS), regex.V1)
        self.numbers = {t: str(i) for t, i in self.ids.items()}
        self.follows: dict[str, dict[str, bool]] = {t: {} for t in self.ids}  # by token, then by the token before it
        self.pairs, self.kept = 0, KEPT_CHUNKS
        self.chunks: dict[str, tuple[str, str]] = {}
        self.older: dict[str, tuple[str, str]] = {}
        self.sizes: dict[str, int] = {}
        self.older_sizes: dict[str, int] = {}

    def forget(self) -> None:
        """Empty all caches; the vocabulary stays."""
        for known in (self.chunks, self.older, self.sizes, self.older_sizes):
            known.clear()
        self.forget_pairs()

    @property
    def fits(self) -> dict[str, dict[str, bool]]:
        """The pairs of tokens that are held."""
        return {token: before for token, before in self.follows.items() if before}

    def forget_pairs(self) -> None:
        for before in self.follows.values():
            if before:
                before.clear()
        self.pairs = 0

    def merged(self, symbols: list[str]) -> list[str]:
        """Plain merging of a few symbols: the lowest rank first, from the left."""
        while len(symbols) > 1:
            best = min(zip(symbols, symbols[1:]), key=lambda p: self.ranks.get(p, 1 << 60))
            if best not in self.ranks:
                return symbols
            out, i = [], 0
            while i < len(symbols):
                two = i + 1 < len(symbols) and (symbols[i], symbols[i + 1]) == best
                out.append(symbols[i] + symbols[i + 1] if two else symbols[i])
                i += 1 + two
            symbols = out
        return symbols

    def symbols(self, token: str) -> list[str]:
        if not token.endswith(self.end) or token == self.end:
            return list(token)
        body = token[: -len(self.end)]
        return [*body[:-1], body[-1] + self.end]

    def may_follow(self, before: str, token: str) -> bool:
        """Whether the two tokens, merged afresh, stay these two; an empty ``before`` asks for the token alone.

        Their merges are undone from the last one on. If by then the two signs at the border have a merge
        that comes before the one undone (of equal ranks the left one comes first), they would not have stayed apart.
        """
        if self.pairs >= KEPT_PAIRS:
            self.forget_pairs()
        self.pairs += 1
        if not before or not self.one_way:
            tokens = self.merged([*self.symbols(before), *self.symbols(token)])
            known = self.follows[token][before] = tokens == ([before, token] if before else [token])
            return known
        ranks, rank_of, halves = self.ranks, self.rank_of, self.halves
        a, b, limit = before, token, len(ranks)
        while True:
            rank = ranks.get((a, b))
            if rank is not None and rank < limit:
                known = False
                break
            x, y = rank_of.get(a, -1), rank_of.get(b, -1)
            if x > y:
                limit, a = x, halves[a][1]
            elif y >= 0:
                limit, b = y + 1, halves[b][0]
            else:
                known = True
                break
        self.follows[token][before] = known
        return known

    def lengths_by_ending(self, whole: bool) -> dict[str, tuple[int, ...]]:
        """Lengths of the tokens with this ending (their last three letters, or all of a shorter one), the longest first.

        ``whole`` takes the tokens that end a word, without their sign for it, otherwise the others.
        """
        cut, found = len(self.end), {}
        for token in self.ids:
            if token.endswith(self.end) == whole:
                body = token[:-cut] if whole else token
                found.setdefault(body[-3:], set()).add(len(body))
        for ending in list(found):
            for size in range(1, len(ending)):
                found[ending] |= {size} & found.get(ending[-size:], set())
        return {ending: tuple(sorted(sizes, reverse=True)) for ending, sizes in found.items()}

    def encode_words(self, words: set[str], count: bool = False) -> dict[str, tuple[str, str]] | dict[str, int]:
        """(ids, tokens) of each distinct word, joined by blanks, or the number of tokens; the words are given as byte letters."""
        out, path, last = {}, "", [""]
        told = [0] if count else [("", "")]  # what comes out for each prefix, a blank behind it
        numbers, follows, may_follow, end = self.numbers, self.follows, self.may_follow, self.end
        inner, whole = self.inner, self.last
        for word in sorted(words):
            shared, body, size_of_word = 0, word[:-1], len(word)
            if body.startswith(path):
                shared = len(path)
            else:
                while path[shared] == body[shared : shared + 1]:
                    shared += 1
                del last[shared + 1 :], told[shared + 1 :]
            for length in range(shared + 1, size_of_word + 1):
                sizes, sign = (inner, "") if length < size_of_word else (whole, end)
                ending = word[length - 3 : length] if length > 3 else word[:length]
                # of an ending that no token has, a shorter one
                for size in sizes.get(ending) or sizes.get(ending[-2:]) or sizes.get(ending[-1:], ()):
                    if size <= length:
                        token = word[length - size : length] + sign
                        fits = follows.get(token)
                        if fits is not None:
                            before = last[length - size]
                            known = fits.get(before)
                            if known or known is None and may_follow(before, token):
                                break
                else:
                    raise ValueError(f"the vocabulary has no token for {word[length - 1]!r}")
                so_far = told[length - size]
                if length < size_of_word:
                    last.append(token)
                    told.append(so_far + 1 if count else (f"{so_far[0]}{numbers[token]} ", f"{so_far[1]}{token} "))
                else:
                    out[word] = so_far + 1 if count else (so_far[0] + numbers[token], so_far[1] + token)
            path = body
        return out

    def parts_of(self, chunk: str) -> list[str]:
        """The words of a chunk, as byte letters."""
        if chunk.isalpha() and max(chunk) < OLD_LETTERS:
            return [chunk.encode().decode("latin-1").translate(self.letters)]
        if HAS_NEW_CAPITAL.search(chunk):
            chunk = chunk.translate(LOWER)
        return [m.encode().decode("latin-1").translate(self.letters) for m in self.pieces.findall(chunk)]

    def learn(self, chunks: set[str]) -> None:
        """Encode the chunks (text between blanks, lower case) that aren't known; those not met for long go."""
        if len(self.chunks) > self.kept:
            self.older, self.chunks = self.chunks, {}
        held, older = self.chunks, self.older
        marked = {c: (c[:-1], c[-1]) for c in chunks.difference(held) if c not in older and word_and_sign(c)}
        new = []
        for chunk in chunks.difference(marked).union(*marked.values()).difference(held):
            if chunk in older:
                held[chunk] = older[chunk]
            else:
                new.append(chunk)
        plain = {c for c in new if c.isascii() and c.isalpha()}
        parts = {c: self.parts_of(c) for c in new if c not in plain}
        tokens = self.encode_words(plain.union(*parts.values()))
        for chunk in plain:
            held[chunk] = tokens[chunk]
        for chunk, words in parts.items():
            both = [tokens[w] for w in words]
            held[chunk] = (" ".join([i for i, _ in both]), " ".join([t for _, t in both]))
        for chunk, (word, sign) in marked.items():
            (ids, text), (sign_ids, sign_text) = held[word], held[sign]
            held[chunk] = (f"{ids} {sign_ids}", f"{text} {sign_text}")

    def split(self, text: str) -> list[tuple[bool, list[str]]]:
        """(special, chunks) runs of a text: special tokens stand by themselves, the rest is normalised."""
        runs = []
        for i, part in enumerate(self.stops.split(text) if self.stops else [text]):
            if i % 2:
                runs.append((True, [part]))
            elif part:
                part = lowered(unicodedata.normalize("NFC", part))
                runs.append((False, BETWEEN.split(part) if NOT_BLANK.search(part) else part.split()))
        return runs

    def encode_texts(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """(ids, tokens), each joined by one blank, of every text."""
        split = [self.split(t) for t in texts]
        self.learn({c for runs in split for special, chunks in runs if not special for c in chunks})
        for runs in split:
            ids, tokens = [], []
            for special, chunks in runs:
                known = [(str(self.special[c]), c) for c in chunks] if special else [self.chunks[c] for c in chunks]
                ids += [i for i, _ in known if i]
                tokens += [t for _, t in known if t]
            yield " ".join(ids), " ".join(tokens)

    def count_texts(self, texts: list[str]) -> list[int]:
        """The number of tokens of every text; of known chunks only their numbers of tokens are kept."""
        if len(self.sizes) > KEPT_COUNTS:
            self.older_sizes, self.sizes = self.sizes, {}
        split = [self.split(t) for t in texts]
        met, new = {c for runs in split for special, chunks in runs if not special for c in chunks}, {}
        for chunk in met.difference(self.sizes):
            if chunk in self.older_sizes:
                self.sizes[chunk] = self.older_sizes[chunk]
            elif word_and_sign(chunk):
                new[chunk] = [*self.parts_of(chunk[:-1]), chunk[-1]]
            else:
                new[chunk] = [chunk] if chunk.isascii() and chunk.isalpha() else self.parts_of(chunk)
        words = self.encode_words(set().union(*new.values()), count=True)
        for chunk, parts in new.items():
            self.sizes[chunk] = sum(map(words.__getitem__, parts))
        return [sum(len(chunks) if special else sum(map(self.sizes.__getitem__, chunks)) for special, chunks in runs) for runs in split]


def word_and_sign(chunk: str) -> bool:
    """Whether a chunk is a word of old letters and one sign of ASCII behind it, which the pattern parts so."""
    return "!" <= chunk[-1:] <= "~" and not chunk[-1].isalpha() and chunk[:-1].isalpha() and max(chunk[:-1]) < OLD_LETTERS


def lowered(text: str) -> str:
    """Lower case letter by letter: a final sigma is not treated apart. Capitals that Python does not know follow in the chunks."""
    return "".join(map(str.lower, text)) if "Σ" in text else text.lower()


def blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch of (id, text) in runs of at most ``BLOCK_ROWS`` rows, which end once they hold ``BLOCK_BYTES`` of text."""
    first = held = 0
    for behind, size in enumerate(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist(), 1):
        held += size
        if held >= BLOCK_BYTES or behind - first == BLOCK_ROWS or behind == batch.num_rows:
            yield batch.slice(first, behind - first)
            first, held = behind, 0


def id_lists(rows: list[str]) -> pa.ListArray:
    """The ids of every row, given joined by blanks, as one flat array: no number is a Python object."""
    numbers = [np.zeros(0, dtype=np.int32), *(np.fromstring(ids, dtype=np.int32, sep=" ") for ids in rows)]
    ends = np.cumsum([*map(len, numbers)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(numbers)))


@lru_cache(maxsize=2)
def words_of(spec: str) -> WordTokens:
    return WordTokens(json.loads(spec))


def encoded(docs: DataFrame, vocabulary: str, digests: bool = False, id_col: str = "doc_id", text: str = "text", kept: int = KEPT_CHUNKS) -> DataFrame:
    """Token ids and decoded text of every row: (doc_id, ids, decoded), or counts and digests of them.

    ``vocabulary`` is a path of a tokenizer file (BPE over byte letters with an end-of-word suffix);
    its content is broadcast. Nothing is shuffled: each task walks the trie of its own blocks of
    ``BLOCK_ROWS`` rows or ``BLOCK_BYTES`` of text. A null text counts as empty and gives no ids; repeated rows give repeated
    results; other columns are left out, whatever their names; an empty table gives an empty one. ``kept`` bounds
    the cache of a task (in each of two generations), which changes its time and memory, not its results.
    """
    with open(vocabulary, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        give_back()  # what earlier stages left in this worker
        coder = words_of(spec.value)
        coder.kept = kept
        try:
            with no_cycles():
                for batch in batches:
                    for block in blocks(batch):
                        pairs = list(coder.encode_texts([t or "" for t in block.column(1).to_pylist()]))
                        if digests:
                            columns = [
                                pa.array([ids.count(" ") + 1 if ids else 0 for ids, _ in pairs], pa.int64()),
                                pa.array([hashlib.sha256(ids.encode()).hexdigest() for ids, _ in pairs], pa.string()),
                                pa.array([hashlib.sha256(text.encode()).hexdigest() for _, text in pairs], pa.string()),
                            ]
                        else:
                            columns = [id_lists([ids for ids, _ in pairs]), pa.array([text for _, text in pairs], pa.string())]
                        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["doc_id", "ids", "decoded"]
                        yield pa.RecordBatch.from_arrays([block.column(0), *columns], names=names)
                        del pairs, columns
        finally:
            coder.forget()  # an idle worker holds nothing but the vocabulary
            give_back()

    return docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{text}` text").mapInArrow(run, DIGESTS if digests else CODES)


def decoded(ids: list[int], vocabulary: str) -> str:
    """The text that a list of ids stands for: its tokens joined by one blank, as the file names no decoder."""
    with open(vocabulary, encoding="utf-8") as f:
        spec = json.load(f)
    names = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    return " ".join(names[i] for i in ids if i in names)
