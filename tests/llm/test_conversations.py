"""Structure repair against exhaustive search and a plain reading of the rules."""
import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from offerloom.llm import conversations as cv
from offerloom.llm import grammar
from offerloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
LEGAL = re.compile(r"(s?(ua)+)?")


def _price(kinds, edits):
    """Cost of edits (a string of K, R, D, I) over (initial, fault) rows, or None if they don't fit;
    roles of R and I are all tried."""
    if sum(e != "I" for e in edits) != len(kinds):
        return None
    cost, roles, rows = 0, [], iter(kinds)
    for e in edits:
        if e == "I":
            cost, roles = cost + 3, [*roles, "ua"]
            continue
        initial, fault = next(rows)
        if e == "D":
            cost += 4
        elif fault in "bd":
            return None
        else:
            cost += (3 if fault == "t" else 0) + (3 if e == "R" else 0)
            roles = [*roles, "ua" if e == "R" else initial]
    return cost if any(LEGAL.fullmatch("".join(c)) for c in itertools.product(*roles)) else None


def _cheapest(kinds):
    best = None
    for k in range(len(kinds) + 3):
        for edits in itertools.product("DIKR", repeat=len(kinds) + k):
            edits = "".join(edits)
            if edits.count("I") == k and (c := _price(kinds, edits)) is not None and (best is None or (c, edits) < best):
                best = (c, edits)
    return best


def _letter(initial, fault):
    return cv.SYMBOLS[4 * "suao".index(initial if initial in "sua" else "o") + " tbd".index(fault)]


def test_audits_equal_exhaustive_search():
    kinds = [(i, f) for i in "suax" for f in " tb"]
    some = [list(q) for k in (0, 1, 2) for q in itertools.product(kinds, repeat=k)]
    r = random.Random(1)
    some += [[r.choice(kinds) for _ in range(3)] for _ in range(60)]
    strings = ["".join(_letter(*k) for k in q) for q in some]
    got = cv.audits(strings)
    for s, q in zip(strings, some):
        assert got[s] == _cheapest(q), q


def _stepwise(symbols):
    """The same by one vector of plain strings from left to right."""
    row = [(0, ""), None, None, None]

    def insert(row):
        for i in (0, 1, 3, 2):
            if row[i]:
                j, e = cv._NEXT[i][1], (row[i][0] + 3, row[i][1] + "I")
                row = [min(filter(None, (row[j], e))) if k == j else x for k, x in enumerate(row)]
        return row
    for c in symbols:
        for _ in range(4):
            row = insert(row)
        m, new = cv.SYMBOLS.index(c), [None] * 4
        for i, e in enumerate(row):
            if e:
                moves = [(i, 4, "D")]
                if m % 4 < 2:
                    moves.append((cv._NEXT[i][1], 3 + 3 * (m % 4), "R"))
                    if (i, "suao"[m // 4]) in cv._STEP:
                        moves.append((cv._STEP[i, "suao"[m // 4]], 3 * (m % 4), "K"))
                for j, cost, x in moves:
                    new[j] = min(filter(None, (new[j], (e[0] + cost, e[1] + x))))
        row = new
    for _ in range(4):
        row = insert(row)
    return min(filter(None, (row[0], row[3])))


def test_long_sequences_equal_a_stepwise_solution():
    r = random.Random(5)
    some = ["".join(r.choice("aefijm" if k % 2 else cv.SYMBOLS) for _ in range(r.randrange(200))) for k in range(60)]
    some += ["ei" * 300, "e" * 500, "aei" * 100 + "o" * 77, "i" * 301 + "e" * 40, "m" * 90]
    got = cv.audits(some)
    for s in some:
        assert got[s] == _stepwise(s), s


def test_grammar_gives_the_sequences_back():
    r = random.Random(2)
    some = [[r.randrange(3) for _ in range(r.randrange(60))] for _ in range(40)] + [[1] * 31, [], [0, 1] * 40]
    rules, short = grammar.re_pair(some, 3)

    def spelled(s):
        return [s] if s < 3 else [x for y in rules[s - 3] for x in spelled(y)]
    assert [[x for s in q for x in spelled(s)] for q in short] == some
    pairs = [p for q in short for p in zip(q, q[1:])]
    assert len(rules) > 5 and all(pairs.count(p) < 2 or p[0] == p[1] for p in pairs)


def test_ropes_compare_as_strings():
    r = random.Random(8)

    def rope(s):
        if len(s) <= 2 or r.random() < 0.1:
            return grammar.Rope(s)
        k = r.randrange(1, len(s))
        return rope(s[:k]) + rope(s[k:])
    for _ in range(300):
        a = "".join(r.choice("KK D"[:r.randrange(1, 5)]) for _ in range(r.randrange(200)))
        b = a if r.random() < 0.2 else a[:r.randrange(len(a) + 1)] + "".join(r.choice("KD") for _ in range(r.randrange(50)))
        x, y = rope(a), rope(b)
        assert (x < y, y < x) == (a < b, b < a) and str(x + y) == a + b and (x.hash == y.hash) == (a == b)


def plain(rows, damage=True):
    """The rules read one by one; `rows` are (conv_id, turn, role, text)."""
    out, given = {}, {}
    for c, t, role, text in rows:
        kept = given.setdefault(c, [])
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20 if damage else 9
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 4:
            role = "user"
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(t, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    for c, kept in given.items():
        kept.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        turns, seen, symbols = {t for t, _, _ in kept if t is not None}, set(), ""
        for _, role, text in kept:
            bare = text.strip(" \t\n\x0b\x0c\r")
            symbols += _letter(role[:1] or "o", "b" if not bare else "d" if (role, text) in seen else " " if bare[-1] in ".!?" else "t")
            seen.add((role, text))
        cost, audit = _stepwise(symbols)
        said, left, last = [], iter(kept), ""
        for e in audit:
            _, role, text = (None, "", "") if e == "I" else next(left)
            if e in "IR":
                role = "assistant" if last == "u" else "user"
            if e != "D":
                said.append(f"{role}:{text}")
                last = role[:1]
        initials = [r[:1] for _, r, _ in kept]
        out[c] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(sum(symbols.count(x) for x in cv.SYMBOLS[f::4]) for f in (2, 3, 1)),
                  sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def _got(df):
    assert df.columns == ["conv_id", *NAMES]
    return {r.conv_id: tuple(r[n] for n in NAMES) for r in df.collect()}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_the_plain_reading(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert _got(QUERIES["op11_conversation_repair"](spark, f"/root/testdata/{sf}")) == plain(rows)


EDGE = [(1, 0, "user", "a."), (1, 0, "user", "a."), (1, 0, "user", "a."), (1, None, "assistant", "x!"), (1, 5, "tool", "no end"), (1, 5, "system", "s."),
        (2, None, None, None), (2, None, "user", "q?"), (3, 1, "", "z."), (3, 2, "user", " \t\x0b\n "), (None, 3, "user", "Hi. \x0c"), (None, 4, "user", "hi.\x85"),
        (4, -2 ** 63, "user", "a."), (4, 2 ** 63 - 1, "assistant", "b."), (5, 1, "unknown", "u."), (5, 2, "assistant", "x. " * 100_000), (6, 1, "system", "only.")]


def test_conversations_edge(spark):
    df = spark.createDataFrame(EDGE, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("clash") for c in ("symbols", "same", "first", "c", "row", "part", "audit", "known")})
    expected = plain(EDGE, damage=False)
    assert expected[4][0] == 2 ** 64 - 2
    expected[4] = (None, *expected[4][1:])  # beyond 64 bits
    assert _got(cv.digest(df)) == expected
    none = cv.digest(df.limit(0))
    assert none.count() == 0 and none.columns == ["conv_id", *NAMES]
    dropped = cv.digest(df.withColumn("copies", F.lit(0)))
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert _got(dropped) == dict.fromkeys(expected, empty)
    assert _got(cv.digest(cv.damaged(df))) == plain(EDGE) | {4: _got(cv.digest(cv.damaged(df)))[4]}


def test_one_long_conversation(spark):
    r = random.Random(4)
    rows = [(7, t, r.choice(["user", "assistant", "system"]), r.choice(["a.", "b", "", f"t{t}."])) for t in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    assert _got(cv.digest(df)) == plain(rows, damage=False)
    found, marked = cv.repair(df)
    said = cv.repaired(marked, found).orderBy("position").collect()
    assert [x.position for x in said] == list(range(1, len(said) + 1)) and LEGAL.fullmatch("".join(x.role[0] for x in said))
