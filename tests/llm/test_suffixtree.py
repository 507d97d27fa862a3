"""Suffix-tree scores against a plain tree in Python, and against the unigram base on held-out texts."""

import math
import random
import re
import zlib
from collections import Counter

import pytest

from crestline.llm import suffixtree as st

SCHEMA = "doc_id long, text string, key string, n long"


def corpus(n, seed=1):
    r = random.Random(seed)
    parts = ["th", "er", "ing", "on", "ti", "an", "re", "ed", "é", "ñ"]
    word = lambda: "".join(r.choice(parts) for _ in range(r.randint(1, 4)))
    return [(i, " ".join(word() + r.choice(["", "", ",", "."]) for _ in range(r.randint(0, 60))), "k", 0) for i in range(n)]


def plain_scores(rows, depth=st.DEPTH):
    """The same model by one dictionary for each context, and its states."""
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    tokens = lambda t: [w.lower() if w.isascii() else "".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]

    seen: dict = {}
    for i, t, *_ in rows:
        if not held(i):
            words = [None, *tokens(t), None]  # None: the end, and what stands before the beginning
            for at in range(1, len(words)):
                for k in range(at + 1):
                    seen.setdefault(tuple(words[at - k : at]), Counter())[words[at]] += 1
    root = seen.get((), Counter())
    n, v, of = sum(root.values()), len(root), Counter(root.values())
    d = min(0.95, max(0.05, of[1] / (of[1] + 2 * of[2]))) if of[1] else 0.05
    states: dict = {}

    def is_state(ctx):
        if ctx not in states:
            c = seen.get(ctx, Counter())
            total, again = sum(c.values()), sum(m > 1 for m in c.values())
            gain = 0.0
            if len(ctx) <= depth and total >= st.MIN_COUNT and (len(ctx) == 1 or is_state(ctx[1:])):
                for y, m in c.items():
                    if m > 1:
                        up = 2 ** (round(math.log2(p(ctx[1:], y)) * st.Q) / st.Q)
                        gain += m * math.log((m - 1 + len(c) * up) / (total * up))
                    else:
                        gain += math.log(len(c) / total)
            states[ctx] = gain > max(1, again)
        return states[ctx]

    def p(ctx, x):
        if not ctx:
            return (root[x] - d) / n if root[x] else d * v / n
        if not is_state(ctx):
            return p(ctx[1:], x)
        c = seen[ctx]
        return (max(c[x] - 1, 0) + len(c) * p(ctx[1:], x)) / sum(c.values())

    def longest(before):
        k = 0
        while k < len(before) and is_state(before[len(before) - k - 1 :]):
            k += 1
        return before[len(before) - k :]

    out = []
    for i, t, *_ in rows:
        words = [None, *tokens(t), None]
        base = sum(math.log10((root[w] + 1) / (n + v + 1)) for w in words[1:])
        known = sum(root[w] > 0 for w in words[1:])
        score = sum(math.log10(p(longest(tuple(words[:at])), words[at])) for at in range(1, len(words)))
        out.append((i, held(i), len(words) - 1, known, n, base, score))
    return out, [ctx for ctx, yes in states.items() if yes], p, root


ODD = [(None, "Thering ON", "k", 0), (61, None, "k", 0), (62, "", "k", 0), (3, "again", "k", 0), (3, "again", "k", 0), (63, "x" * 4000, "k", 0), (64, "a\x0bB\x85c\x1cd", None, None), (65, "loop " * 300, "k", 0), (66, "a b " * 90, "k", 0)]


def phrases(n, seed=4):
    """Texts of few words, with passages that many share, so that deep contexts tell something."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    shared = [" ".join(r.choices(words, k=r.randint(3, 12))) for _ in range(25)]
    return [(100 + i, " ".join(r.choice(shared) if r.random() < 0.5 else r.choice(words) for _ in range(r.randint(0, 30))), "k", 0) for i in range(n)]


@pytest.mark.parametrize("block_bytes, bucket_rows, max_hot, depth", [(12 << 20, 1 << 20, 1 << 16, st.DEPTH), (1500, 300, 1 << 16, 40), (700, 40, 64, 3)])
def test_scores_equal_the_plain_tree(spark, monkeypatch, block_bytes, bucket_rows, max_hot, depth):
    for name, value in (("BLOCK_BYTES", block_bytes), ("BUCKET_ROWS", bucket_rows), ("MAX_HOT", max_hot)):
        monkeypatch.setattr(st, name, value)
    rows = [*corpus(40), *ODD, *phrases(120)]
    got = sorted(map(tuple, st.score_documents(spark.createDataFrame(rows, SCHEMA).repartition(3), depth).collect()), key=lambda x: str(x[:4]) + str(round(x[6], 4)))
    want, states, _, _ = plain_scores(rows, depth)
    want.sort(key=lambda x: str(x[:4]) + str(round(x[6], 4)))
    assert max(map(len, states)) >= min(depth, 4)  # the tree is deep
    assert [x[:5] for x in got] == [x[:5] for x in want]
    for a, b in zip(got, want, strict=True):
        assert a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=1e-5)  # carried as single precision


@pytest.mark.parametrize("depth", [1, 2])
def test_trees_that_end_at_the_first_level(spark, depth):
    rows = [(i, "a b a c a b d", "k", 0) for i in range(3)] + [(10 + i, f"x{i} y{i}", "k", 0) for i in range(4)]
    got = {r.doc_id: r.score for r in st.score_documents(spark.createDataFrame(rows, SCHEMA), depth).collect()}
    for i, *_, score in plain_scores(rows, depth)[0]:
        assert got[i] == pytest.approx(score, rel=1e-5)
    alone = [(i, " ".join(f"w{i}x{j}" for j in range(5)) + " z z", "k", 0) for i in range(4)]
    got = {r.doc_id: r.score for r in st.score_documents(spark.createDataFrame(alone, SCHEMA), depth).collect()}
    for i, *_, score in plain_scores(alone, depth)[0]:
        assert got[i] == pytest.approx(score, rel=1e-5)


def test_probabilities_sum_to_one():
    rows = phrases(80)
    _, states, p, root = plain_scores(rows)
    for ctx in [(), *states[:200]]:
        assert sum(p(ctx, x) for x in [*root, "never seen"]) == pytest.approx(1.0)


def test_texts_seen_twice_score_apart(spark):
    rows = corpus(400, 7)
    twice = [(1000 + i, t, "k", 0) for i, t, *_ in rows[:20]]
    got = {r.doc_id: r for r in st.score_documents(spark.createDataFrame(rows + twice, SCHEMA)).collect()}
    per_token = lambda r: r.score / r.n_tokens
    both = [i for i in range(20) if not got[i].held_out and not got[1000 + i].held_out and got[i].n_tokens > 10]
    others = [per_token(r) for i, r in got.items() if 20 <= i < 1000 and r.n_tokens > 10]
    assert both and min(per_token(got[i]) for i in both) > max(others)


def test_held_out_texts_gain_on_the_base(spark):
    got = st.score_documents(spark.createDataFrame(corpus(300, 2), SCHEMA)).filter("held_out").collect()
    assert len(got) > 20 and sum(r.score for r in got) > sum(r.base_score for r in got)


def test_empty_and_untrained(spark):
    assert st.score_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    held = next(i for i in range(99) if st.is_held_out(i))
    (r,) = st.score_documents(spark.createDataFrame([(held, "ab", "k", 0)], SCHEMA)).collect()
    assert (r.n_known, r.train_tokens, r.base_score, r.score) == (0, 0, 0.0, 0.0)
