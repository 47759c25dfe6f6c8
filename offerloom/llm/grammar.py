"""Cheapest edits of symbol sequences by dynamic programming on their grammar.

Re-Pair replaces the most frequent pair of neighbours of all sequences by a rule until no pair
occurs twice. A symbol's transfer matrix holds, for every two states of the automaton of legal
sequences, the cheapest edits that lead from one to the other, as a cost and an audit; a rule's
matrix is the min-plus product of the matrices of its two symbols, computed once and shared by all
sequences that use the rule. Audits are ropes: a rule's audit refers to those of its symbols, and
ropes are compared from where they first differ. Of equal costs the ASCII-least audit counts. Two
audits of equal cost between the same states never continue one another (more insertions cost
more), so the lesser one stays the lesser whatever follows, and products may be taken in any order."""
from __future__ import annotations

from collections import defaultdict
from heapq import heapify, heappop, heappush

LEAF = 32
_MOD, _BASE = (1 << 61) - 1, 1_000_003


class Rope:
    """A string in parts, with its length and a hash of 61 bits by which equal parts are passed over."""
    __slots__ = ("n", "hash", "power", "text", "left", "right")

    def __init__(self, text=None, left=None, right=None):
        self.text, self.left, self.right = text, left, right
        if text is not None:
            self.n, self.hash, self.power = len(text), 0, pow(_BASE, len(text), _MOD)
            for c in text:
                self.hash = (self.hash * _BASE + ord(c)) % _MOD
        else:
            self.n, self.power = left.n + right.n, left.power * right.power % _MOD
            self.hash = (left.hash * right.power + right.hash) % _MOD

    def __add__(self, other: Rope) -> Rope:
        if not other.n:
            return self
        if not self.n:
            return other
        return Rope(self.text + other.text) if self.n + other.n <= LEAF else Rope(None, self, other)

    def __lt__(self, other: Rope) -> bool:
        a, b = [self], [other]
        while a and b:
            x, y = a.pop(), b.pop()
            if x is y or (x.n == y.n and x.hash == y.hash):
                continue
            if x.text is not None and y.text is not None:
                m = min(x.n, y.n)
                if x.text[:m] != y.text[:m]:
                    return x.text[:m] < y.text[:m]
                if x.n > m:
                    a.append(Rope(x.text[m:]))
                elif y.n > m:
                    b.append(Rope(y.text[m:]))
            elif x.text is None and (y.text is not None or x.n >= y.n):
                a += [x.right, x.left]
                b.append(y)
            else:
                b += [y.right, y.left]
                a.append(x)
        return any(r.n for r in b) and not any(r.n for r in a)

    def __str__(self) -> str:
        out, todo = [], [self]
        while todo:
            r = todo.pop()
            if r.text is None:
                todo += [r.right, r.left]
            else:
                out.append(r.text)
        return "".join(out)


EMPTY = Rope("")


def _best(options):
    """The cheapest (cost, rope), of equal costs the least rope; None without any."""
    best = None
    for o in options:
        if best is None or o[0] < best[0] or (o[0] == best[0] and o[1] < best[1]):
            best = o
    return best


def product(a, b):
    """Min-plus product of matrices (or of a row of vectors and a matrix)."""
    states = range(len(b))
    return [[_best((row[k][0] + b[k][j][0], row[k][1] + b[k][j][1]) for k in states if row[k] is not None and b[k][j] is not None)
             for j in states] for row in a]


def re_pair(sequences: list[list[int]], first: int):
    """(rules, sequences): rule r stands for the symbol `first` + r and is a pair of symbols."""
    sym = [s for q in sequences for s in (*q, -1)]
    n = len(sym)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    where: dict = defaultdict(set)
    for i in range(n - 1):
        if sym[i] >= 0 and sym[i + 1] >= 0:
            where[sym[i], sym[i + 1]].add(i)
    queue = [(-len(at), p) for p, at in where.items() if len(at) > 1]
    heapify(queue)
    rules = []
    while queue:
        count, pair = heappop(queue)
        at = where.get(pair, ())
        if len(at) < 2:
            continue
        if len(at) != -count:
            heappush(queue, (-len(at), pair))
            continue
        del where[pair]
        new, changed = first + len(rules), set()
        for i in sorted(at):
            j = after[i]
            if sym[i] != pair[0] or j >= n or sym[j] != pair[1]:
                continue  # taken by the occurrence before it
            h, k = before[i], after[j]
            if h >= 0 and sym[h] >= 0:
                where[sym[h], sym[i]].discard(h)
                where[sym[h], new].add(h)
                changed.add((sym[h], new))
            if k < n and sym[k] >= 0:
                where[sym[j], sym[k]].discard(j)
                where[new, sym[k]].add(i)
                changed.add((new, sym[k]))
            sym[i], sym[j], after[i] = new, -2, k
            if k < n:
                before[k] = i
        rules.append(pair)
        for p in changed:
            if len(where[p]) > 1:
                heappush(queue, (-len(where[p]), p))
    out, start = [], 0
    for q in sequences:
        out.append([s for s in sym[start:start + len(q)] if s >= 0])
        start += len(q) + 1
    return rules, out


def cheapest(sequences: list[list[int]], terminals: list, start, finish) -> list[tuple[int, str]]:
    """(cost, audit) of every sequence over the symbols whose matrices are `terminals`; `start` is
    the row of entries before the first symbol, `finish` the column of what may follow the last."""
    rules, compressed = re_pair(sequences, len(terminals))
    matrices = list(terminals)
    for a, b in rules:
        matrices.append(product([*matrices[a]], matrices[b]))
    out = []
    for q in compressed:
        row = start
        for s in q:
            row = product([row], matrices[s])[0]
        cost, audit = _best((r[0] + f[0], r[1] + f[1]) for r, f in zip(row, finish) if r is not None and f is not None)
        out.append((cost, str(audit)))
    return out
