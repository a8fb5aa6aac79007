"""Conversation repair, hard negatives and exact top-k against plain versions and on odd input."""

import hashlib
import math
import random
import zlib
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorloom.llm import cover_tree, maxscore, queries, repair, vectors

# conversation repair

START, AFTER = 0, {"s": 1, "u": 2, "a": 3}
ALLOWED = {0: "su", 1: "u", 2: "a", 3: "u"}


def plain_repair(initials, faults, costs=repair.Costs()):
    """(cost, audit, turns) by comparing all strings of edits from each turn and state on."""

    @cache
    def rest(i, state, inserts):
        best = (0, "", ()) if i == len(initials) and state in (0, 3) else (math.inf, "", ())
        nxt = "a" if state == 2 else "u"
        if inserts < 3:
            c, a, t = rest(i, AFTER[nxt], inserts + 1)
            best = min(best, (c + costs.insert, "I" + a, ((-1, nxt), *t)))
        if i < len(initials):
            c, a, t = rest(i + 1, state, 0)
            best = min(best, (c + costs.delete, "D" + a, t))
            if faults[i] not in ("b", "d"):
                more = costs.truncated if faults[i] == "t" else 0
                if initials[i] and initials[i] in ALLOWED[state]:
                    c, a, t = rest(i + 1, AFTER[initials[i]], 0)
                    best = min(best, (c + more, "K" + a, ((i, None), *t)))
                c, a, t = rest(i + 1, AFTER[nxt], 0)
                best = min(best, (c + more + costs.rerole, "R" + a, ((i, nxt), *t)))
        return best

    return rest(0, START, 0)


@pytest.mark.parametrize("stretch", [3, 64])
def test_auction_finds_the_least_of_the_cheapest_edits(monkeypatch, stretch):
    monkeypatch.setattr(repair, "STRETCH", stretch)
    rng = random.Random(5)
    for _ in range(1500):
        n = rng.randint(0, 9)
        initials, faults = [rng.choice("ssuuuaaax ") if rng.random() < 0.95 else "" for _ in range(n)], [rng.choice(["", "", "", "b", "d", "t"]) for _ in range(n)]
        costs = repair.Costs() if rng.random() < 0.5 else repair.Costs(rng.randint(0, 3), rng.randint(0, 6), rng.randint(1, 4), rng.randint(0, 6))
        stretches, exits = repair.solve(initials, faults, repair._END, True, costs, (0,))
        audit, turns, _ = repair.trace(stretches, 0)
        cost, want, places = plain_repair(tuple(initials), tuple(faults), costs)
        assert (exits[0], audit, [(p, r and r[0]) for p, r in turns]) == (cost, want, list(places)), (initials, faults, costs)


def test_prices_are_a_dual_solution():
    """No price is above the cost of an arc plus the price behind it, and the origin's is the cheapest cost."""
    rng = random.Random(1)
    initials, faults = [rng.choice("sua") for _ in range(60)], [rng.choice(["", "", "", "b", "d", "t"]) for _ in range(60)]
    (one,), (cost, *_) = repair.solve(initials, faults, repair._END, True, repair.Costs(), (0,))
    assert cost == plain_repair(tuple(initials), tuple(faults))[0]
    assert all(one.price[v] <= c + one.price[w] for v, out in enumerate(one.arcs) for _, c, w in out)


def plain_digests(rows, lost=()):
    """The contract's row for each conversation of (conv_id, turn, role, text) rows."""
    out = {}
    for conv in {r[0] for r in [*rows, *lost]}:
        own = sorted(((t is not None, t or 0, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv), key=lambda k: (*k[:2], k[3], hashlib.md5(f"{len(k[3])}:{k[3]}{k[4]}".encode()).hexdigest()))
        faults, seen = [], set()
        for _, _, _, role, text in own:
            shown = text.rstrip(" \t\n\x0b\f\r")
            faults.append("b" if not shown else "d" if (role, text) in seen else "t" if shown[-1] not in ".!?" else "")
            seen.add((role, text))
        initials, numbers = [k[3][:1] for k in own], [k[2] for k in own if k[2] is not None]
        cost, audit, turns = plain_repair(tuple(initials), tuple(faults))
        lines = [f"{'user' if r == 'u' else 'assistant' if r else own[p][3]}:{own[p][4] if p >= 0 else ''}" for p, r in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        out[conv] = (gaps, *(faults.count(k) for k in "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


TALK = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Hello!"), (1, 2, "assistant", "Hello!"), (1, 3, "user", "And"), (1, None, None, None), (1, None, "user", "First?"),
    (2, 5, "user", ""), (2, 9, "assistant", " \t\n"), (3, None, "assistant", "Only."), (None, 1, "user", "No id."), (None, 2, "assistant", "None."), (None, 2, "assistant", "None."),
    (4, 0, "", "No role."), (4, 1, "Users", "Odd!"), (5, 0, "user", "long " * 50_000 + "."), (5, 10, "assistant", "x" * 100_000), (6, -(2**63), "user", "A."), (6, 2**63 - 1, "assistant", "B. \n"), (7, 0, "user", "naïve 日本語 😀."), (7, 1, "assistant", "Sí!"),
]
SCHEMA = "conv_id long, turn long, role string, text string"


def repaired(df, **more):
    found = repair.pieces_joined(repair.repair_conversations(df, **more)).collect()
    return {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in found}, len(found)


def bounded(want):
    return {k: (min(v[0], 2**63 - 1), *v[1:]) for k, v in want.items()}


def test_odd_conversations(spark):
    rows = spark.createDataFrame(TALK * 2, SCHEMA)
    clash = rows.withColumns({c: F.lit("x") for c in ("same", "fault", "turns", "c", "n", "piece", "pos", "chunk", "cost")})
    want = bounded(plain_digests(TALK * 2))
    assert repaired(clash) == (want, len(want))
    assert repaired(rows.limit(0)) == ({}, 0)
    lost = rows.withColumn("gone", F.lit(True))
    got, _ = repaired(lost, dropped="gone")
    assert set(got.values()) == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())} and set(got) == {r[0] for r in TALK}


@pytest.mark.parametrize("most", [2, 5, 33])
def test_long_conversations_in_chunks(spark, most):
    rng = random.Random(most)
    rows = [(c, rng.randint(0, 150) if rng.random() < 0.95 else None, rng.choice(["system", "user", "user", "assistant", "assistant", "tool"]), rng.choice(["Yes.", "No!", "cut", "", *(f"Text {i}." for i in range(60))])) for c in (1, 2, None) for _ in range(130)]
    df = spark.createDataFrame([*rows, *TALK], SCHEMA)
    want = bounded(plain_digests([*rows, *TALK]))
    assert repaired(df, long_turns=most) == (want, len(want))


def test_chunks_hold_a_conversation_in_order(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"Text {i}.") for i in range(50)]
    pieces = repair.repair_conversations(spark.createDataFrame(rows, SCHEMA).repartition(5), long_turns=8).orderBy("piece").collect()
    assert len(pieces) >= 7 and {r["pieces"] for r in pieces} == {len(pieces)}
    assert [(t["role"], t["text"]) for r in pieces for t in r["repaired"]] == [(r, t) for _, _, r, t in rows] and all(set(r["audit"]) == {"K"} for r in pieces)


def test_damage(spark):
    rows = [(c, t, r, "One. Two!") for c in range(40) for t, r in enumerate(["system", "user", "assistant"])] + [(None, None, None, None)]
    want = []
    for c, t, r, x in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = r or " ", x or " "
        one = (c, t, "user" if kind == 4 else r, "" if kind == 1 else "One Two" if kind == 2 and x != " " else x, kind == 0)
        want += [one] * (2 if kind == 3 else 1)
    got = [tuple(r) for r in queries.damaged(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and {k[4] for k in want} == {True, False}


# hard negatives and top-k


def scaled(vector):
    if vector is None or any(x is None or not math.isfinite(x) for x in vector):
        return None
    return [math.floor(x * 256) for x in vector]


def product(a, b):
    return max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b, strict=False))))


def ranked(found, k):
    """The first k of (exact score, id) pairs."""
    return sorted(found, key=lambda f: (-f[0], f[1] is None, f[1]))[:k]


def plain_top_k(rows, wanted, k):
    take = [(i, v) for i, x in rows if (v := scaled(x)) is not None]
    out = []
    for q, v in {(i, tuple(v)) for i, v in take if i is not None and wanted(i)}:
        out += [(q, n + 1, i, s) for n, (s, i) in enumerate(ranked([(product(v, w), i) for i, w in take if i != q], k))]
    return out


def plain_negatives(rows, wanted, k, low=80, high=100):
    take = [(i, v, y) for i, x, y in rows if (v := scaled(x)) is not None and y is not None]
    out = []
    for q, v, y in {(i, tuple(v), y) for i, v, y in take if i is not None and wanted(i)}:
        scores = [(product(v, w), i, z) for i, w, z in take]
        for p, i in ranked([(s, i) for s, i, z in scores if z == y and i != q], k):
            below = ranked([(s, j) for s, j, z in scores if z != y and low * p <= 100 * s <= high * p], k)
            out += [(q, i, n + 1, j, p, s) for n, (s, j) in enumerate(below)]
    return out


def vector_rows(rng, n, kind):
    """Rows of spread, clustered, repeated or sparse vectors, or with odd ones among them."""
    centers = rng.normal(size=(7, 12))
    for i in range(n):
        x = rng.normal(size=12) if kind == "spread" else centers[rng.integers(7)] + 0.05 * rng.normal(size=12)
        if kind == "sparse":
            x = np.where(rng.random(12) < 0.15, np.abs(x), 0)
        if kind == "repeated":
            x = centers[0] if i % 3 else centers[i % 7]
        x = [float(v) for v in x]
        if kind == "odd":
            x = {0: None, 1: [], 2: [1e300, *x], 3: [float("nan"), *x], 4: [None, *x], 5: x[:4], 6: [0.0] * 12, 7: [2.0**50] * 12, 8: [float("inf")], 9: [-(2.0**60)] * 3}.get(i % 20, x)
        yield (i // 2 if kind == "odd" and i % 11 == 0 else None if kind == "odd" and i % 13 == 0 else i, x, int(rng.integers(3)) if i % 17 else None)


VECTORS = "vec_id long, embedding array<double>, label int"
KINDS = ["spread", "clustered", "repeated", "sparse", "odd"]


@pytest.fixture
def small_blocks(monkeypatch):
    """Many blocks, lanes, stretches and levels, so that all meet."""
    monkeypatch.setattr(maxscore, "HEAD", 8)
    monkeypatch.setattr(maxscore, "STRETCH", 40)
    for name, most in (("blocks", 70), ("lanes", 9)):
        monkeypatch.setattr(vectors, name, lambda *a, f=getattr(vectors, name), m=most, **b: f(*a, **(b | {"most": m})))


@pytest.mark.parametrize("kind", KINDS)
def test_top_k_is_that_of_all_pairs(spark, small_blocks, kind):
    rows = [*vector_rows(np.random.default_rng(3), 300, kind)]
    df = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit("x") for c in ("id", "vector", "lane", "block", "score", "rank", "query")}).repartition(3)
    got = [tuple(r) for r in maxscore.top_k(df.filter("vec_id % 10 = 0"), df, 5).collect()]
    assert sorted(got, key=str) == sorted(plain_top_k([r[:2] for r in rows], lambda i: i % 10 == 0, 5), key=str)


@pytest.mark.parametrize("kind", KINDS)
def test_negatives_are_those_of_all_pairs(spark, small_blocks, kind):
    rows = [*vector_rows(np.random.default_rng(4), 300, kind)]
    df = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit("x") for c in ("id", "vector", "lane", "block", "place", "anchor", "positive")}).repartition(3)
    got = [tuple(r) for r in cover_tree.hard_negatives(df.filter("vec_id % 10 = 0"), df).collect()]
    assert sorted(got, key=str) == sorted(plain_negatives(rows, lambda i: i % 10 == 0, 5), key=str)


def test_empty_vectors(spark):
    none = spark.createDataFrame([], VECTORS)
    one = spark.createDataFrame([(0, [1.0], 1)], VECTORS)
    for few, many in ((none, none), (one, none), (none, one), (one, one)):
        assert maxscore.top_k(few, many).count() == 0 and cover_tree.hard_negatives(few, many).count() == 0


def test_postings_are_skipped_and_probed():
    """Documents in no essential posting are never scored, and all that reach the threshold are found."""
    rng = np.random.default_rng(0)
    x = np.where(rng.random((500, 30)) < 0.1, rng.integers(1, 50, (500, 30)), 0).astype(float)
    postings = maxscore.Postings(x)
    q = rng.integers(0, 50, 30).astype(float)
    least = np.sort(x @ q)[-5]
    docs, score = postings.competitive(q, least)
    assert sorted(docs) == np.flatnonzero(x @ q >= least).tolist() and (score == (x @ q)[docs]).all()
    assert len(postings.competitive(q, (x @ q).max() + 1e6)[0]) == 0


def test_tree_covers_and_bounds():
    """Each node's points lie within its radius, levels shrink, bounds hold, and far clusters are skipped."""
    rng = np.random.default_rng(0)
    x = np.floor(256 * (rng.normal(size=(20, 10))[rng.integers(20, size=2000)] + 0.02 * rng.normal(size=(2000, 10))))
    row = cover_tree.tree_columns(x, np.arange(2000), np.ones(2000, bool), np.zeros(2000, np.int64))
    tree = cover_tree.Tree(row)
    assert sorted(tree.ids.tolist()) == list(range(2000)) and (x[tree.ids] == tree.x).all()
    spans = [(s, e) for s, e, c, t in zip(tree.start, tree.end, tree.child, tree.last, strict=True) if c == t]
    assert sorted(i for s, e in spans for i in range(s, e)) == list(range(2000))
    q = x[:5]
    low, high = tree.bounds(q)
    for n, (s, e) in enumerate(zip(tree.start, tree.end, strict=True)):
        if e > s:
            scores = tree.x[s:e] @ q.T
            assert (scores >= low[:, n]).all() and (scores <= high[:, n]).all()
    visited = sum(h >= np.sort(x @ q[0])[-5] for h, (c, t) in zip(high[0], zip(tree.child, tree.last, strict=True), strict=True) if c == t)
    assert visited <= len(spans) // 3
