"""Operator 11: periodic runs of words by Baier grouping.

A run is a stretch with a smallest period q and at least two periods that no neighbouring word
extends. Under one of two opposite orders of the words, some period of a run, its Lyndon root, is the
longest Lyndon word that starts at its place. Phase one of Baier's suffix sorter groups suffixes by
that word and so yields its length at every place (the Lyndon array) without sorting the suffixes;
this is done under both orders, and each root is extended to both sides by longest common extensions.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Least number of words of a run; a run also has two periods at least.
LEAST = 12
DIGESTS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
FOUND = "doc_id long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
ITEM = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def lyndon_array(word: np.ndarray) -> tuple[list[int], list[int]]:
    """For each place the length of the longest Lyndon word that starts there, and the number of its group.

    Places start in groups by their letter. Groups are taken from the greatest down. The parent of a
    place is the nearest place to its left in a smaller group; as greater groups have left the chain
    of places by then, it is the neighbour in the chain, or the parent of a neighbour in the same
    group. A parent's word is followed by the group's word as often as it has children there, so it
    grows by that; parents of one group that grow alike become a new group right above their old one.
    In the end places share a group exactly if they start with the same longest Lyndon word.
    """
    n = len(word)
    letters, at = np.unique(word, return_inverse=True)
    order = np.argsort(at, kind="stable")
    ends = np.cumsum(np.bincount(at, minlength=len(letters)))
    group = at.tolist()
    members = [m.tolist() for m in np.split(order, ends[:-1])]
    size = [1] * len(members)
    below = list(range(-1, len(members) - 1))
    above = [*range(1, len(members)), -1]
    left, right = list(range(-1, n - 1)), [*range(1, n), n]
    length, parent = [0] * n, [-1] * n
    top = len(members) - 1
    while top >= 0:
        own = size[top]
        grown: dict[tuple[int, int], list[int]] = {}  # parents by their group and number of children here
        last, count = -1, 0
        for i in members[top]:
            if group[i] != top:
                continue
            length[i] = own
            p = left[i]
            if p >= 0 and group[p] == top:
                p = parent[p]
            parent[i] = p
            if p == last:
                count += 1
            else:
                if last >= 0:
                    grown.setdefault((group[last], count), []).append(last)
                last, count = p, 1
        if last >= 0:
            grown.setdefault((group[last], count), []).append(last)
        for i in members[top]:
            if group[i] == top:
                a, b = left[i], right[i]
                if a >= 0:
                    right[a] = b
                if b < n:
                    left[b] = a
        members[top] = []
        # of one group, parents with more children come out above those with fewer
        for (old, count), places in sorted(grown.items(), reverse=True):
            new = len(members)
            members.append(places)
            size.append(size[old] + count * own)
            for p in places:
                group[p] = new
            up = above[old]
            below.append(old)
            above.append(up)
            above[old] = new
            if up >= 0:
                below[up] = new
        top = below[top]
    return length, group


def extent(word: list[int], i: int, j: int) -> int:
    """How many words from i and j (i < j) on agree: blocks of growing size are compared, then halved."""
    n, at, step = len(word), 0, 8
    while j + at < n and word[i + at : i + at + step] == word[j + at : j + at + step]:
        at += min(step, n - j - at)
        step *= 2
    while step > 1:
        step //= 2
        if j + at < n and word[i + at : i + at + step] == word[j + at : j + at + step]:
            at += min(step, n - j - at)
    return at


def segments(word: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Stretches that hold all runs of ``least`` words or more; most texts have none.

    In a run of m words with period q at least m - q >= least / 2 neighbouring words stand again q
    words later, and these and their repeats cover the run. So every word of a run lies in a stretch
    of h = least / 2 words that occurs twice. (Stretches of equal digest are taken for equal, which can only
    make a segment larger.)
    """
    h, n = (least + 1) // 2, len(word)
    if n < least:
        return []
    mixed = word.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    digest = np.zeros(n - h + 1, np.uint64)
    for k in range(h):
        digest = digest * np.uint64(0xBF58476D1CE4E5B9) + mixed[k : n - h + 1 + k]
    order = np.argsort(digest, kind="stable")
    same = digest[order[1:]] == digest[order[:-1]]
    twice = np.zeros(n + 1, np.int64)
    for found in (order[1:][same], order[:-1][same]):
        hit = np.zeros(n + 1, np.int64)
        hit[found] = 1
        twice |= hit
    cover = np.zeros(n + 2, np.int64)
    cover[: n + 1] += twice
    cover[h : n + 1] -= twice[: n + 1 - h]
    covered = np.r_[0, (np.cumsum(cover[:n]) > 0).astype(np.int8), 0]
    edges = np.flatnonzero(np.diff(covered))
    return [(a, b) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()) if b - a >= least]


def runs_in(word: np.ndarray, least: int) -> set[tuple[int, int, int]]:
    """(start, length, period) of the runs of one segment."""
    found: set[tuple[int, int, int]] = set()
    plain = word.tolist()
    turned = plain[::-1]
    n = len(plain)
    for letters in (word, -word):
        lengths, groups = lyndon_array(letters)
        p, g, i = np.array(lengths), np.array(groups), np.arange(n)
        after, before = i + p, i - p
        # a root is extended from its first copy only, and only where a neighbouring word goes on with its period
        first = (before < 0) | (g[before] != g)
        goes_on = (after < n) & (word[np.minimum(after, n - 1)] == word)
        came = (i > 0) & (word[i - 1] == word[after - 1])
        for a in np.flatnonzero(first & (goes_on | came)).tolist():
            period = lengths[a]
            b = a + period
            ahead = extent(plain, a, b) if b < n else 0
            back = extent(turned, n - b, n - a)  # reversed, the word left of b stands at n - b
            size = back + period + ahead
            if size >= 2 * period and size >= least:
                found.add((a - back, size, period))
    return found


def runs(word: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of ``least`` words or more, by start, then period."""
    out = []
    for a, b in segments(word, least):
        out += [(a + s, m, q) for s, m, q in runs_in(word[a:b], least)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def numbers(words: list[bytes]) -> np.ndarray:
    """A number for each word; equal words have equal numbers."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def made_periodic(doc_id: int | None, n: int) -> np.ndarray | None:
    """For one document in ten the places whose words it takes, so that its end is periodic; none for the others."""
    if doc_id is None or n == 0:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    i, p = np.arange(n), 1 + (n - a) // (3 + g % 8)
    return np.where(i < a, i, a + (i - a) % p)


def collapse(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: all but those behind the first period of a run."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def find_runs(docs: DataFrame, least: int = LEAST, periodic: bool = False, digests: bool = False, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, runs, collapsed) of every row: its runs of ``least`` words or more with at least two periods, by
    start, then period, and its words, joined by one blank, without those behind the first period of a run.

    With ``periodic`` one document in ten, chosen by a checksum of its id, is first made periodic from
    some word on. With ``digests`` there are counts and digests instead, and the greatest run (of equal ones
    that with the smallest start, then period). Words are runs of anything but the six ASCII blanks. A null
    text has no words; a row without id is left as it is; repeated rows give repeated results; other columns
    are left out, whatever their names; an empty table gives an empty one. Nothing is shuffled, and a row takes
    memory in proportion to its own words.
    """

    def rows(batch):
        for doc_id, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            words = (content.as_py() or "").encode().split()
            number = numbers(words)
            places = made_periodic(doc_id, len(words)) if periodic else None
            if places is not None:
                words, number = [words[i] for i in places.tolist()], number[places]
            found = runs(number, least)
            kept = b" ".join([words[i] for i in np.flatnonzero(collapse(len(words), found)).tolist()] if found else words)
            yield found, kept

    def run(batches):
        for batch in batches:
            if not digests:
                both = list(rows(batch))
                columns = [pa.array([f for f, _ in both], ITEM), pa.array([k.decode() for _, k in both], pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "runs", "collapsed"])
                continue
            out: list[list] = [[] for _ in range(7)]
            for found, kept in rows(batch):
                start, length, period = max(found, key=lambda r: (r[1], -r[0], -r[2])) if found else (None,) * 3
                line = "".join(f"{s},{m},{q}\n" for s, m, q in found)
                exponent = 1000 * length // period if found else None
                for column, value in zip(out, (len(found), start, length, period, exponent, sha(line.encode()), sha(kept))):
                    column.append(value)
            columns = [pa.array(c, pa.int64()) for c in out[:5]] + [pa.array(c, pa.string()) for c in out[5:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[c.split()[0] for c in DIGESTS.split(", ")])

    return docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{text}` text").mapInArrow(run, DIGESTS if digests else FOUND)
