"""Substring-edit-distance kernels over blocks of strings, in numpy.

All of them take a list of strings and distinct queries and return, for each
query and distance 0..delta, the weight of the strings at that distance.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np

WORD = 64
#: Lanes (string x query) that a block of the bit-parallel kernel works on at once.
LANES = 1 << 17
#: Characters, with padding, that a block has at most, unless it is a single string.
CELLS = 1 << 20


def sed(q: str, s: str) -> int:
    """Plain dynamic programming; for long queries and as the yardstick of the tests."""
    column = list(range(len(q) + 1))
    best = len(q)
    for x in s:
        diagonal = column[0]
        for i, y in enumerate(q, 1):
            diagonal, column[i] = column[i], min(column[i] + 1, column[i - 1] + 1, diagonal + (x != y))
        best = min(best, column[-1])
    return best


def encode(strings: list[str]) -> list[np.ndarray]:
    return [np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32) for s in strings]


def _blocks(codes: list[np.ndarray], most: int, cells: int = CELLS) -> Iterator[list[int]]:
    """Numbers of strings, longest first, at most so many at a time and fewer if they are long: strings of a block are of like length."""
    order = sorted(range(len(codes)), key=lambda k: -len(codes[k]))
    at = 0
    while at < len(order):
        n = max(1, min(most, cells // max(len(codes[order[at]]), 1)))
        yield order[at : at + n]
        at += n


def bit_parallel(queries: list[str], strings: list[str], weights: np.ndarray, delta: int) -> np.ndarray:
    """Histogram (queries, delta + 1). Myers's recurrence for text search with a query in each lane.

    Queries of up to 8, 16, 32 and 64 characters take lanes of as many bits;
    longer ones go through plain dynamic programming.
    """
    out = np.zeros((len(queries), delta + 1), np.int64)
    if not strings:
        return out
    codes, weights = encode(strings), np.asarray(weights)
    for k, q in enumerate(queries):
        if not q:
            out[k, 0] += weights.sum()
        elif len(q) > WORD:
            for s, w in zip(strings, weights, strict=True):
                if (d := sed(q, s)) <= delta:
                    out[k, d] += w
    shorter = 0
    for lane in (np.uint8, np.uint16, np.uint32, np.uint64):
        bits = lane(0).nbytes * 8
        some = [k for k, q in enumerate(queries) if shorter < len(q) <= bits]
        shorter = bits
        if some:
            out[some] += _lanes([queries[k] for k in some], codes, weights, delta, lane)
    return out


def _lanes(queries: list[str], codes: list[np.ndarray], weights: np.ndarray, delta: int, lane: type) -> np.ndarray:
    """bit_parallel() of queries that fit lanes of this type.

    A block holds many strings by all queries; at each step every lane reads
    the next character of its string. Strings that have ended leave the block.
    """
    out = np.zeros((len(queries), delta + 1), np.int64)
    coded, one = encode(queries), lane(1)
    alphabet = np.unique(np.concatenate(coded))
    length = np.array([len(q) for q in coded])
    table = np.zeros((len(alphabet) + 1, len(queries)), lane)  # the last row: characters of no query
    for k, q in enumerate(coded):
        np.bitwise_or.at(table[:, k], np.searchsorted(alphabet, q), one << np.arange(len(q), dtype=lane))
    high = one << (length - 1).astype(lane)
    for members in _blocks(codes, max(1, LANES // len(queries))):
        sizes = np.array([len(codes[k]) for k in members])
        steps = int(sizes[0])
        grid = np.full((steps, len(members)), len(alphabet), np.int32)
        for m, k in enumerate(members):
            if sizes[m]:
                at = np.searchsorted(alphabet, codes[k])
                at[at == len(alphabet)] = 0
                grid[: sizes[m], m] = np.where(alphabet[at] == codes[k], at, len(alphabet))
        score = np.broadcast_to(length.astype(np.int8), (len(members), len(queries))).copy()
        best = score.copy()
        plus = np.full(score.shape, ~lane(0))
        minus = np.zeros(score.shape, lane)
        alive = np.searchsorted(-sizes, -np.arange(steps), side="left")  # strings longer than t are the first ones
        for t in range(steps):
            n = alive[t]
            if n < len(plus):
                plus, minus, score = plus[:n], minus[:n], score[:n]
            eq = table.take(grid[t, :n], axis=0)
            xv = eq | minus
            xh = eq & plus
            xh += plus
            xh ^= plus
            xh |= eq
            mh = plus & xh
            xh |= plus
            ph = np.invert(xh, out=xh)
            ph |= minus
            score += ((ph & high) != 0).view(np.int8)
            score -= ((mh & high) != 0).view(np.int8)
            ph <<= one
            mh <<= one
            np.bitwise_and(ph, xv, out=minus)
            xv |= ph
            plus = np.invert(xv, out=xv)
            plus |= mh
            np.minimum(best[:n], score, out=best[:n])
        w = weights[members]
        for d in range(delta + 1):
            out[:, d] += w @ (best == d)
    return out


def _grid(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters as a matrix (strings, longest), padded with a code that no character has."""
    codes = encode(strings)
    width = max((len(c) for c in codes), default=0)
    grid = np.full((len(codes), width), np.iinfo(np.uint32).max, np.uint32)
    for k, c in enumerate(codes):
        grid[k, : len(c)] = c
    return grid, np.array([len(c) for c in codes])


def _next_row(row: np.ndarray, code: int, grid: np.ndarray) -> np.ndarray:
    """The distance table's row for one query character more, for all strings at once; row 0 is all zeros.

    The dependence along a row (an insertion after an insertion) is a running
    minimum of the value less its place.
    """
    width = grid.shape[1]
    place = np.arange(width + 1, dtype=row.dtype)
    new = np.empty_like(row)
    new[:, 0] = row[:, 0] + 1
    np.minimum(row[:, :-1] + (grid != code), row[:, 1:] + 1, out=new[:, 1:])
    return np.minimum.accumulate(new - place, 1) + place


def shared_prefix(queries: list[str], strings: list[str], weights: np.ndarray, delta: int, *, prune: bool = True, work: np.ndarray | None = None) -> np.ndarray:
    """The same histogram by rows of the distance table, shared by queries with a common prefix.

    Queries are walked in sorted order and keep the rows of the prefix they
    have in common with the one before, which is a walk of the tree of their
    prefixes. prune: a string leaves a subtree as soon as its row has nothing
    within delta, and a subtree that no string is left in is skipped.
    work: gets the lines and the cells of the distance tables that were computed.
    """
    out = np.zeros((len(queries), delta + 1), np.int64)
    if not strings:
        return out
    order = sorted(range(len(queries)), key=lambda k: queries[k])
    for members in _blocks(encode(strings), 256):
        grid, sizes = _grid([strings[k] for k in members])
        w = weights[members]
        beyond = np.arange(grid.shape[1] + 1)[None, :] > sizes[:, None]
        here = np.arange(len(members))
        stack = [(here, np.zeros((len(members), grid.shape[1] + 1), np.int32))]  # strings still in play and their rows
        before = ""
        for k in order:
            q = queries[k]
            same = 0
            while same < min(len(q), len(before), len(stack) - 1) and q[same] == before[same]:
                same += 1
            del stack[same + 1 :]
            for x in q[same:]:
                rows, row = stack[-1]
                if len(rows):
                    if work is not None:
                        work += (w[rows].sum(), (w * sizes)[rows].sum())
                    row = _next_row(row, ord(x), grid[rows])
                    if prune:
                        stay = np.where(beyond[rows], delta + 1, row).min(1) <= delta
                        rows, row = rows[stay], row[stay]
                stack.append((rows, row))
            before = q
            rows, row = stack[-1]
            if len(rows):
                best = np.minimum(np.where(beyond[rows], len(q), row).min(1), len(q))
                for d in range(delta + 1):
                    out[k, d] += w[rows[best == d]].sum()
    return out


def _least(spots: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct spots, ascending, with the least value of each."""
    order = np.argsort(spots, kind="stable")
    spots, values = spots[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], spots[1:] != spots[:-1]])) if len(spots) else np.zeros(0, int)
    return spots[first], np.minimum.reduceat(values, first) if len(first) else values


def _next_cells(spots: np.ndarray, values: np.ndarray, code: int, text: np.ndarray, delta: int) -> tuple[np.ndarray, np.ndarray]:
    """The cells of the next row of the distance tables that are within delta, from those of the row before."""
    here = text[spots]
    inside = here != _END
    down, beside = values + 1, (values + (here != code))[inside]
    spots, values = _least(np.concatenate([spots[down <= delta], (spots[inside] + 1)[beside <= delta]]), np.concatenate([down[down <= delta], beside[beside <= delta]]))
    for _ in range(delta):  # insertions after insertions
        more = (values < delta) & (text[spots] != _END)
        if not more.any():
            break
        spots, values = _least(np.concatenate([spots, spots[more] + 1]), np.concatenate([values, values[more] + 1]))
    return spots, values


#: Stands behind the last character of each string.
_END = np.uint32(0xFFFFFFFF)


def live_cells(queries: list[str], strings: list[str], weights: np.ndarray, delta: int, *, share: bool = True, work: np.ndarray | None = None) -> np.ndarray:
    """The same histogram from the cells of the distance tables that are within delta and no others.

    A row holds the columns of all strings that can still lead to a distance
    within delta, so columns drop out one by one, a string with its last
    column, and a subtree of the queries' prefixes with its last string.
    share: queries with a common prefix share its rows. work: gets the lines
    and the cells that were looked at.
    """
    out = np.zeros((len(queries), delta + 1), np.int64)
    if not strings:
        return out
    weights = np.asarray(weights)
    order = sorted(range(len(queries)), key=lambda k: queries[k])
    codes = encode(strings)
    for members in _blocks(codes, 1 << 14, CELLS // 4):
        sizes = np.array([len(codes[k]) for k in members])
        starts = np.concatenate([[0], np.cumsum(sizes + 1)])
        text = np.full(starts[-1], _END, np.uint32)
        for m, k in enumerate(members):
            text[starts[m] : starts[m] + sizes[m]] = codes[k]
        owner = np.repeat(np.arange(len(members)), sizes + 1)
        w = weights[members]
        stack = [(np.arange(starts[-1]), np.zeros(starts[-1], np.int8))]
        before = ""
        for k in order:
            q, same = queries[k], 0
            while share and same < min(len(q), len(before), len(stack) - 1) and q[same] == before[same]:
                same += 1
            del stack[same + 1 :]
            for x in q[same:]:
                spots, values = stack[-1]
                if len(spots):
                    if work is not None:
                        work += (w[np.unique(owner[spots])].sum(), w[owner[spots]].sum())
                    spots, values = _next_cells(spots, values, ord(x), text, delta)
                stack.append((spots, values))
            before = q
            spots, values = stack[-1]
            if len(spots):
                found, best = _least(owner[spots], values)
                out[k] += np.bincount(best, w[found], delta + 1).astype(np.int64)[: delta + 1]
    return out


#: In a pattern, any one character. Queries that hold it go through the block kernel.
_GAP = "\uffff"
#: Between texts that are walked together.
_APART = "\ufffe"
#: Bytes of the matrix of lines by queries that is filled at a time.
MARKS = 1 << 20
#: Pieces and pairs of pieces that are remembered at a time, and strings and characters of them that are learnt from at a time.
REMEMBERED, STRINGS, CHARACTERS = 600_000, 4096, 1 << 18
#: Entries of the patterns' tree; queries that make more go through the block kernel.
ENTRIES = 1 << 26


class Pieces:
    """Queries of 1 to WORD characters within `delta` <= 1 edits, looked up in the pieces of strings.

    A piece is a run of characters that queries have. A string within one edit
    of a query holds the query without one of its characters, or with a gap of
    any one character in place of an inner one or between two. So only a gap
    can be a character that no query has, and each match is in a piece or
    spans two that stand one character apart. What a piece or a pair holds is
    found once, by walks in the tree of these patterns, and remembered.
    """

    def __init__(self, queries: tuple[str, ...], delta: int):
        self.width, patterns = len(queries), {}
        for k, q in enumerate(queries):  # marks: k if the query is within one edit, width + k if it's there itself
            patterns.setdefault(q, set()).add(self.width + k)
            if delta and len(q) > 1:
                near = [q[:i] + q[i + 1 :] for i in range(len(q))] + [q[:i] + _GAP + q[i + 1 :] for i in range(1, len(q) - 1)] + [q[:i] + _GAP + q[i:] for i in range(2, len(q) - 1)]
                for pattern in near:
                    patterns.setdefault(pattern, set()).add(k)
        alphabet = "".join(sorted({x for q in queries for x in q}))
        self.split = re.compile(f"[^{re.escape(alphabet)}]").split
        gaps = [x.split(_GAP) for x in patterns if _GAP in x]
        self.lefts, self.rights = {a for a, _ in gaps}, {b[:i] for _, b in gaps for i in range(1, len(b) + 1)}
        self.longest = max(map(len, patterns))
        nodes = {x: k for k, x in enumerate(sorted({x[:i] for x in patterns for i in range(len(x) + 1)}))}  # "" is 0, the root
        self.fits = len(nodes) * (len(alphabet) + 2) <= ENTRIES
        if not self.fits:
            return
        #: 0: between texts, 1: in no query
        self.kinds = np.ones(0x110000, np.int32)
        self.kinds[[ord(x) for x in alphabet]] = np.arange(2, len(alphabet) + 2)
        self.kinds[ord(_APART)] = 0
        self.next, self.gap = np.zeros((len(nodes), len(alphabet) + 2), np.int32), np.zeros(len(nodes), np.int32)
        kind = dict(zip(alphabet, range(2, len(alphabet) + 2), strict=True))
        for x, k in nodes.items():
            if x.endswith(_GAP):
                self.gap[nodes[x[:-1]]] = k
            elif x:
                self.next[nodes[x[:-1]], kind[x[-1]]] = k
        marks = [np.array(sorted(patterns.get(x, ())), np.int32) for x in nodes]
        self.sizes = np.array([len(m) for m in marks])
        self.marks, self.from_ = np.concatenate(marks), np.cumsum(self.sizes) - self.sizes
        self.forget()

    def forget(self) -> None:
        #: piece -> its number in `held`; by number, its end that a gap can follow and its start that can follow a gap
        self.pieces, self.held = {"": 0}, [np.zeros(0, np.int32)]
        self.tail = self.head = np.zeros(1, np.int64)
        self.tails, self.heads = {"": 0}, {"": 0}
        #: end and start -> number, or -1 if the pair holds none
        self.pairs: dict[int, int] = {}

    def walk(self, texts: list[str], pairs: bool) -> Iterator[np.ndarray]:
        """The marks of each text: from each character, along the tree as far as it goes. pairs: of a pair, those that span its gap."""
        whole = encode([_APART.join([*texts, _APART * 2])])[0]
        kinds = self.kinds[whole]
        owner = np.cumsum(whole == ord(_APART))
        at = np.flatnonzero(kinds > 1)
        if pairs:
            middle = np.flatnonzero(kinds == 1)
            at = at[at < middle[owner[at]]]
        node, found, nodes = self.next[0, kinds[at]], [], []
        while len(at):
            at, node = at[node > 0], node[node > 0]
            some = self.sizes[node] > 0
            if pairs:
                some &= at > middle[owner[at]]
            found.append(owner[at[some]])
            nodes.append(node[some])
            at = at + 1
            kind, gap = kinds[at], self.gap[node]
            jump = (gap > 0) & (kind == 1 if pairs else kind > 1)
            at, node = np.concatenate([at, at[jump]]), np.concatenate([self.next[node, kind], gap[jump]])
        found, nodes = np.concatenate([np.zeros(0, int), *found]), np.concatenate([np.zeros(0, int), *nodes])
        sizes = self.sizes[nodes]
        ends = np.cumsum(sizes)
        marks = self.marks[np.repeat(self.from_[nodes] - ends + sizes, sizes) + np.arange(sizes.sum())]
        keys = np.sort(np.repeat(found, sizes) * (2 * self.width) + marks)
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
        edges = np.searchsorted(keys, np.arange(len(texts) + 1) * (2 * self.width)).tolist()
        marks = (keys % (2 * self.width)).astype(np.int32)
        return (marks[a:b] for a, b in zip(edges, edges[1:], strict=False))

    def learn(self, texts: list[str], pairs: bool) -> None:
        at, size = 0, 0
        for k, text in enumerate(texts, 1):
            size += len(text)
            if size > CHARACTERS or k == len(texts):
                self.held += self.walk(texts[at:k], pairs)
                at, size = k, 0

    def _ends(self, text: str) -> tuple[int, int]:
        """Numbers of the longest end that is a pattern's part before a gap and of the longest start that goes on behind one."""
        tail = next((x for n in range(min(len(text), self.longest), 0, -1) if (x := text[-n:]) in self.lefts), "")
        n = 0
        while n < len(text) and text[: n + 1] in self.rights:
            n += 1
        return self.tails.setdefault(tail, len(self.tails)), self.heads.setdefault(text[:n], len(self.heads))

    def numbers(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of what the strings hold, and where each string's start, and the end."""
        runs = [self.split(s) for s in strings]
        texts = [x for run in runs for x in run]
        line = np.repeat(np.arange(len(runs)), [len(run) for run in runs])
        new = list(set(texts) - self.pieces.keys())
        self.pieces.update(zip(new, range(len(self.held), len(self.held) + len(new)), strict=True))
        ends = np.array([self._ends(x) for x in new], np.int64).reshape(-1, 2)
        self.learn(new, False)
        # pairs may have numbers in between, so both are as long as `held`
        self.tail, self.head = (np.concatenate([x, np.zeros(len(self.held) - len(new) - len(x), np.int64), ends[:, k]]) for k, x in enumerate((self.tail, self.head)))
        number = np.fromiter(map(self.pieces.__getitem__, texts), np.int64, len(texts))
        tail, head = self.tail[number[:-1]], self.head[number[1:]]
        two = np.flatnonzero((tail > 0) & (head > 0) & (line[:-1] == line[1:]))
        keys, which = np.unique((tail[two] << 32) + head[two], return_inverse=True)
        keys = keys.tolist()
        new = [k for k in keys if k not in self.pairs]
        before, after, n = list(self.tails), list(self.heads), len(self.held)
        self.learn([before[k >> 32] + _GAP + after[k & 0xFFFFFFFF] for k in new], True)
        self.pairs.update((k, m if len(self.held[m]) else -1) for m, k in enumerate(new, n))
        found = np.array([self.pairs[k] for k in keys], np.int64)[which]
        some = found >= 0
        size = len(self.held)
        own = np.sort(np.concatenate([line * size + number, line[two[some]] * size + found[some]]))
        own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        return own % size, np.searchsorted(own, np.arange(len(runs) + 1) * size)

    def counts(self, strings: list[str], weights: np.ndarray) -> np.ndarray:
        """By mark, the weight of the strings that have it."""
        width = 2 * self.width
        total, step = np.zeros(width, np.int64), max(1, min(255, MARKS // width))
        for first in range(0, len(strings), STRINGS):
            if len(self.held) > REMEMBERED:
                self.forget()
            numbers, starts = self.numbers(strings[first : first + STRINGS])
            for at in range(0, len(starts) - 1, step):
                own = starts[at : at + step + 1]
                held = [self.held[k] for k in numbers[own[0] : own[-1]].tolist()]
                rows = np.repeat(np.arange(len(own) - 1) * width, np.diff(own))
                has = np.zeros((len(own) - 1, width), np.uint8)
                has.ravel()[np.repeat(rows, np.fromiter(map(len, held), np.int64, len(held))) + np.concatenate(held)] = 1
                total += has.sum(0, dtype=np.uint8)  # of 255 strings at most
                w = weights[first + at : first + at + len(has)]
                more = np.flatnonzero(w != 1)
                if len(more):
                    total += (w[more] - 1) @ has[more]
        return total


@functools.lru_cache(maxsize=1)
def _pieces(queries: tuple[str, ...], delta: int) -> Pieces:
    return Pieces(queries, delta)


def pieces(queries: list[str], strings: list[str], weights: np.ndarray, delta: int) -> np.ndarray:
    """The same histogram for delta 0 and 1 by looking up what the pieces of the strings hold, whatever the number of queries.

    Larger deltas, queries with the two characters that patterns use and those
    whose patterns are too many go through the block kernel. Of queries over WORD characters, only the strings that hold one of
    delta + 1 parts of them are verified.
    """
    if delta > 1 or any(_GAP in q or _APART in q for q in queries):
        return bit_parallel(queries, strings, weights, delta)
    out, weights = np.zeros((len(queries), delta + 1), np.int64), np.asarray(weights)
    if not strings:
        return out
    some = [k for k, q in enumerate(queries) if 0 < len(q) <= WORD]
    if some and not _pieces(tuple(queries[k] for k in some), delta).fits:
        return bit_parallel(queries, strings, weights, delta)
    if some:
        found = _pieces(tuple(queries[k] for k in some), delta).counts(strings, weights).reshape(2, -1)
        out[some, 0] = found[1]
        if delta:
            near = np.where([len(queries[k]) == 1 for k in some], weights.sum(), found[0])
            out[some, 1] = near - found[1]
    for k, q in enumerate(queries):
        if not q:
            out[k, 0] = weights.sum()
        elif len(q) > WORD:
            half = len(q) // 2 if delta else len(q)
            for s, w in zip(strings, weights, strict=True):
                if (q[:half] in s or delta and q[half:] in s) and (d := sed(q, s)) <= delta:
                    out[k, d] += w
    return out


KERNELS = {
    "block": bit_parallel,
    "pieces": pieces,
    "trie": live_cells,
    "interval": lambda q, s, w, d: live_cells(q, s, w, d, share=False),
    "sorted": lambda q, s, w, d: shared_prefix(q, s, w, d, prune=False),
    "sorted_pruned": shared_prefix,
}
