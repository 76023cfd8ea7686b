"""Operator 13: SentencePiece (BPE) encoding and decoding by vectorised merge rounds.

All words of a block that are not known yet lie behind one another in flat numpy arrays of symbol
numbers. A pair of neighbouring characters that stands in no piece of the vocabulary can never come to
lie in one token, so the arrays are cut there into segments. In each round every segment finds the
least rank of its pairs, all leftmost pairs of that rank merge at once, and segments without a pair
left go out of the arrays; the rounds end when no pair is left.

Merging all pairs of one rank at once equals merging them one after the other, leftmost first, as
long as a merge makes no pair of the same or a smaller rank. Where it does (the vocabulary holds
pieces that come before their own parts, or equal to them), a segment merges only up to that place in this
round; one that is held back in several rounds, such as a long run of blanks, is finished merge by merge.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusloom.llm.shared import no_cycles

#: Words (in each of two generations) that a task keeps between its blocks of so many rows, and the longest of them; more are worked out again.
KEPT_WORDS, KEPT_LENGTH, BLOCK_ROWS = 110_000, 64, 512

# Fixed values of the model file's format: the sign for a blank, kinds of pieces and the kind of model.
BLANK = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
BPE = 2

NEVER = np.int64(1) << 40  # rank of a pair that is no piece
HELD_BACK = 8  # rounds in which a segment may be held back before it is finished merge by merge
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
CODES = "doc_id long, ids array<int>, decoded string"


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol-buffer message; fixed-width values stay bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at, value, shift = at + 1, value | (byte & 127) << shift, shift + 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, data[at : at + size]
        at += size


class PieceTokens:
    """Token ids under one model file: BPE with byte fallback and no normalisation but blanks."""

    def __init__(self, model: bytes):
        message = list(fields(model))
        self.pieces, scores, kinds = [], [], []
        for number, value in message:
            if number == 1:
                one = dict(fields(value))
                self.pieces.append(one[1].decode())
                scores.append(struct.unpack("<f", one.get(2, b"\0\0\0\0"))[0])
                kinds.append(one.get(3, NORMAL))
        trainer = dict(fields(dict(message)[2]))
        normaliser = dict(fields(dict(message).get(3, b"")))
        self.byte_id = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, kinds)) if k == BYTE}
        if trainer.get(3) != BPE or len(self.byte_id) < 256 or not set(kinds) <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("the model must be BPE with byte fallback and without unused or user-defined pieces")
        if normaliser.get(2) or not normaliser.get(3, 1) or normaliser.get(4, 1) or not normaliser.get(5, 1):
            raise ValueError("the model must leave texts as they are, but for blanks and one blank in front")
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        unknown = trainer.get(44, b" \xe2\x81\x87 ").decode()
        self.shown = [unknown if k == UNKNOWN else "" if k == CONTROL else p.replace(BLANK, " ") for p, k in zip(self.pieces, kinds)]
        self.numbers = list(map(str, range(len(self.pieces))))
        self.tables({p: i for i, (p, k) in enumerate(zip(self.pieces, kinds)) if k == NORMAL}, scores)
        self.words: dict[str, tuple[str, str]] = {}
        self.older: dict[str, tuple[str, str]] = {}

    def tables(self, ids: dict[str, int], scores: list[float]) -> None:
        """Numbers of characters, pairs of characters inside pieces, and the pieces that two symbols make."""
        many = [p for p in ids if len(p) > 1]
        inside = {p[i : i + 2] for p in many for i in range(len(p) - 1)}
        self.alphabet = sorted({c for two in inside for c in two})
        self.letter = np.zeros(0x110000, np.int16)  # 0: stands next to no other character in any piece
        self.letter[[ord(c) for c in self.alphabet]] = np.arange(1, len(self.alphabet) + 1)
        self.joined = np.zeros((len(self.alphabet) + 1,) * 2, bool)
        for two in inside:
            self.joined[self.letter[ord(two[0])], self.letter[ord(two[1])]] = True
        bare = [c for c in self.alphabet if c not in ids]
        symbol = {p: i for p, i in ids.items()} | {c: len(self.pieces) + k for k, c in enumerate(bare)}
        self.count = len(self.pieces) + len(bare)
        self.symbol = np.full(0x110000, -1, np.int32)  # -1: a character that is no piece and in none
        for p, i in symbol.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        levels = np.unique([-scores[i] for i in ids.values()])
        self.rank = np.full(self.count, NEVER, np.int64)
        for i in ids.values():
            self.rank[i] = np.searchsorted(levels, -scores[i])
        made = {symbol[p[:k]] * self.count + symbol[p[k:]]: ids[p] for p in many for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol}
        self.made = made
        self.keys = np.array(sorted(made), np.int64)
        self.makes = np.array([made[k] for k in self.keys.tolist()], np.int64)
        self.early = np.zeros(self.count, bool)  # pieces that some pair with them comes before, or along with
        for side in (self.keys // self.count, self.keys % self.count):
            late = (self.rank[side] < NEVER) & (self.rank[self.makes] <= self.rank[side])
            self.early[side[late]] = True
        plain = "".join(map(re.escape, (c for c in self.alphabet if c != BLANK)))
        # blanks open a word unless some piece has a blank behind another character; runs of lone characters are words too
        opens = not any(two[1] == BLANK != two[0] for two in inside)
        self.parts = re.compile(f"{BLANK}*[{plain}]+|{BLANK}+|[^{plain}{BLANK}]+" if opens else f"[{plain}{BLANK}]+|[^{plain}{BLANK}]+")

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, piece) of each pair of symbols; NEVER where they make no piece."""
        key = left.astype(np.int64) * self.count + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        piece = np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.makes[at], 0)
        return np.where(piece > 0, self.rank[piece], NEVER), piece

    def merged(self, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """For each character the symbol that starts there when no pair is left, -2 where none starts.

        ``codes`` are code points, ``first`` marks those where a word starts.
        """
        n = len(codes)
        out = self.symbol[codes].astype(np.int64)
        letter = self.letter[codes]
        cut = first.copy()
        cut[1:] |= ~self.joined[letter[:-1], letter[1:]]
        at, seg = np.arange(n), np.cumsum(cut) - 1
        alone = np.bincount(seg)[seg] == 1
        at, seg = at[~alone], seg[~alone]
        sym = out[at]
        rank, piece = np.full(len(at), NEVER, np.int64), np.zeros(len(at), np.int64)
        back = np.zeros(seg[-1] + 1 if len(seg) else 0, np.int32)  # rounds in which a segment was held back
        inner = np.flatnonzero(seg[:-1] == seg[1:])
        rank[inner], piece[inner] = self.pairs(sym[inner], sym[inner + 1])
        while len(at):
            starts = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
            sizes = np.diff(np.r_[starts, len(at)])
            least = np.minimum.reduceat(rank, starts)
            alive = least < NEVER
            if not alive.all():  # compaction: finished segments leave
                stay = np.repeat(alive, sizes)
                out[at[~stay]] = sym[~stay]
                at, seg, sym, rank, piece = at[stay], seg[stay], sym[stay], rank[stay], piece[stay]
                least, sizes = least[alive], sizes[alive]
                if not len(at):
                    break
            hits = np.flatnonzero(rank == np.repeat(least, sizes))
            opens = np.r_[True, hits[1:] != hits[:-1] + 1]  # of pairs that overlap every other one merges
            run = np.arange(len(hits)) - np.maximum.accumulate(np.where(opens, np.arange(len(hits)), 0))
            hits = hits[run % 2 == 0]
            if self.early[piece[hits]].any():
                every, hits = hits, self.in_turn(hits, sym, seg, rank, piece)
                held = np.unique(seg[np.setdiff1d(every, hits, assume_unique=True)])
                back[held] += 1
                slow = held[back[held] > HELD_BACK]
                if len(slow):
                    stay = ~np.isin(seg, slow)
                    for one in slow.tolist():
                        a, b = np.searchsorted(seg, [one, one + 1])
                        out[at[a:b]] = self.one_by_one(sym[a:b].tolist())
                    at, seg, sym, rank, piece = at[stay], seg[stay], sym[stay], rank[stay], piece[stay]
                    continue
            new = piece[hits]
            gone = np.zeros(len(at), bool)
            gone[hits + 1] = True
            sym[hits] = new
            out[at[hits + 1]] = -2
            left = ~gone
            place = np.cumsum(left) - 1
            at, seg, sym, rank, piece = at[left], seg[left], sym[left], rank[left], piece[left]
            changed = np.zeros(len(at) + 1, bool)
            changed[place[hits]] = changed[place[hits] - 1] = True
            touched = np.flatnonzero(changed[:-1])
            rank[touched], piece[touched] = NEVER, 0
            touched = touched[touched < len(at) - 1]
            touched = touched[seg[touched] == seg[touched + 1]]
            rank[touched], piece[touched] = self.pairs(sym[touched], sym[touched + 1])
        return out

    def in_turn(self, hits: np.ndarray, sym: np.ndarray, seg: np.ndarray, rank: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """The merges up to the first in each segment that makes a pair of the same or a smaller rank."""
        new, last = piece[hits], len(sym) - 1
        after = np.minimum(hits + 2, last)  # its right neighbour, which is not merged yet
        right, _ = self.pairs(new, sym[after])
        right[(hits + 2 > last) | (seg[after] != seg[hits])] = NEVER
        before = np.maximum(hits - 1, 0)  # its left neighbour, which a merge may just have made
        joined = np.r_[False, hits[1:] == hits[:-1] + 2]
        neighbour = np.where(joined, np.r_[0, new[:-1]], sym[before])
        left, _ = self.pairs(neighbour, new)
        left[(hits == 0) | (seg[before] != seg[hits])] = NEVER
        stops = np.minimum(left, right) <= rank[hits]
        earlier = np.cumsum(stops) - stops  # stops before this merge
        opens = np.r_[True, seg[hits[1:]] != seg[hits[:-1]]]
        at_open = np.maximum.accumulate(np.where(opens, np.arange(len(hits)), 0))
        return hits[earlier == earlier[at_open]]

    def one_by_one(self, sym: list[int]) -> list[int]:
        """The symbols of a segment after all merges, the least rank and then the leftmost first; -2 where one went into its left neighbour."""
        n, ranks, made, count = len(sym), self.rank, self.made, self.count
        after, before = [*range(1, n), n], list(range(-1, n - 1))
        queue: list[tuple[int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            piece = made.get(sym[i] * count + sym[j])
            if piece is not None:
                heapq.heappush(queue, (int(ranks[piece]), i, sym[i], sym[j]))

        for i in range(n - 1):
            offer(i, i + 1)
        while queue:
            _, i, a, b = heapq.heappop(queue)
            j = after[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue  # one of the two was merged meanwhile
            sym[i], sym[j] = made[a * count + b], -2
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                offer(i, after[j])
            if before[i] >= 0:
                offer(before[i], i)
        return sym

    def learn(self, words: set[str]) -> dict[str, tuple[str, str]]:
        """(ids joined by commas, decoded text) of each distinct word."""
        if not words:
            return {}
        listed = list(words)
        codes = np.frombuffer("".join(listed).encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(w) for w in listed])
        first = np.zeros(len(codes), bool)
        first[np.r_[0, ends[:-1]]] = True
        symbols = self.merged(codes, first)
        known = np.flatnonzero(symbols != -2)
        stops = np.searchsorted(known, ends).tolist()
        tokens, lone = symbols[known], (symbols[known] < 0) | (symbols[known] >= len(self.pieces))
        tokens[lone] = 0
        ids, shown = [self.numbers[t] for t in tokens.tolist()], [self.shown[t] for t in tokens.tolist()]
        for at, code in zip(np.flatnonzero(lone).tolist(), codes[known[lone]].tolist()):
            shown[at] = chr(code)  # its bytes, read again
            ids[at] = ",".join([self.numbers[self.byte_id[b]] for b in shown[at].encode()])
        return {w: (",".join(ids[a:b]), "".join(shown[a:b])) for w, a, b in zip(listed, [0, *stops], stops)}

    def shown_text(self, ids: list[int]) -> str:
        """What the ids stand for, blanks included; runs of bytes are read as UTF-8, a byte that fits nowhere gives U+FFFD."""
        out, run = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
            else:
                if run:
                    out.append(utf8(bytes(run)))
                    run.clear()
                out.append(self.shown[i])
        return "".join(out) + (utf8(bytes(run)) if run else "")

    def decode(self, ids: list[int]) -> str:
        """The text of a list of ids; a blank that opens the first piece with any text goes."""
        for k, i in enumerate(ids):
            if i in self.byte_of:
                break  # bytes come first, so there is no blank in front
            if self.shown[i]:
                lead = self.pieces[i].startswith(BLANK)
                return self.shown_text(ids[:k]) + self.shown[i][lead:] + self.shown_text(ids[k + 1 :])
        return self.shown_text(ids)

    def encode_texts(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """(ids joined by commas, decoded text) of every text."""
        find = self.parts.findall
        split = [find(BLANK + t.replace(" ", BLANK)) if t else [] for t in texts]
        if len(self.words) > KEPT_WORDS:
            self.older, self.words = self.words, {}  # those not met for long go
        known, older = self.words, self.older
        new = set().union(*split).difference(known)
        met = new.intersection(older)
        known.update({w: older[w] for w in met})
        known.update(self.learn(new - met))
        for words in split:
            both = [known[w] for w in words]
            # the first piece opens with the blank that encoding has put there
            yield ",".join([i for i, _ in both]), "".join([t for _, t in both])[1:]
        for word in [w for w in known if len(w) > KEPT_LENGTH]:
            del known[word]

    def forget(self) -> None:
        """Empty the caches of words; the vocabulary stays."""
        self.words.clear()
        self.older.clear()


def utf8(data: bytes) -> str:
    try:
        return data.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(data):
            for size in (1, 2, 3, 4):
                try:
                    out.append(data[at : at + size].decode())
                    at += size
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


@lru_cache(maxsize=2)
def pieces_of(model: bytes) -> PieceTokens:
    return PieceTokens(model)


def encoded(docs: DataFrame, model: str, digests: bool = False, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Token ids and decoded text of every row: (doc_id, ids, decoded), or counts and digests of them.

    ``model`` is a path of a SentencePiece model file (BPE with byte fallback, no normalisation but
    for blanks); its content is broadcast. Nothing is shuffled: each task merges the words of its own
    blocks of ``BLOCK_ROWS`` rows, whole texts and words of any length. A null text counts as empty and
    gives no ids; repeated rows give repeated results; other columns are left out, whatever their names;
    an empty table gives an empty one.
    """
    with open(model, "rb") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        coder = pieces_of(content.value)
        try:
            with no_cycles():
                for batch in batches:
                    for at in range(0, batch.num_rows, BLOCK_ROWS):
                        block = batch.slice(at, BLOCK_ROWS)
                        pairs = list(coder.encode_texts([t or "" for t in block.column(1).to_pylist()]))
                        if digests:
                            columns = [
                                pa.array([ids.count(",") + 1 if ids else 0 for ids, _ in pairs], pa.int64()),
                                pa.array([hashlib.sha256(ids.encode()).hexdigest() for ids, _ in pairs], pa.string()),
                                pa.array([hashlib.sha256(shown.encode()).hexdigest() for _, shown in pairs], pa.string()),
                            ]
                        else:
                            columns = [
                                pa.array([[int(i) for i in ids.split(",") if i] for ids, _ in pairs], pa.list_(pa.int32())),
                                pa.array([shown for _, shown in pairs], pa.string()),
                            ]
                        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["doc_id", "ids", "decoded"]
                        yield pa.RecordBatch.from_arrays([block.column(0), *columns], names=names)
        finally:
            coder.forget()

    return docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{text}` text").mapInArrow(run, DIGESTS if digests else CODES)
