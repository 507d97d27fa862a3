"""Near duplicates against all pairs in Python, and planted groups."""

import random

import numpy as np

from crestline.llm import neardup as nd

SCHEMA = "doc_id long, text string, node string, n long, kept string"


def words_set(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k):
    sets = [words_set(t, k) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is None or rows[j][0] is None:
                continue
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[find(i)] = min(r[0], low.get(find(i), r[0]))
    return sorted(((r[0], len(sets[i]), low.get(find(i)), r[0] is None or r[0] == low[find(i)]) for i, r in enumerate(rows)), key=str)


def planted(seed=0):
    r = random.Random(seed)
    text = lambda n: [f"w{r.randint(0, 5000)}" for _ in range(n)]
    rows, shared = [], text(60)
    for _ in range(6):
        origin = text(r.randint(30, 200))
        for _ in range(8):
            copy = list(origin)
            for _ in range(r.randint(0, 6)):
                copy[r.randrange(len(copy))] = f"x{r.randint(0, 99)}"
            rows.append(" ".join(copy))
    chain = text(120)
    for i in range(10):  # each near to the next, the ends far apart
        chain = chain[4:] + text(4)
        rows.append(" ".join(chain))
    rows += [" ".join(text(40) + shared + text(40)) for _ in range(8)]
    rows += ["", None, "  \n", "one two", "ONE  two", "one", "a b c d", "word " * 5000, "word " * 30]
    r.shuffle(rows)
    out = [(i, t, "n", 0, None) for i, t in enumerate(rows)]
    return [*out, (2, out[2][1], "n", 0, None), (None, out[3][1], "n", 0, None)]


def test_equals_all_pairs(spark):
    for k in (4, 5):
        rows = planted(k)
        got = nd.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), words=k).collect()
        assert sorted(map(tuple, got), key=str) == brute(rows, k)


def test_rare_hashes_alone_find_every_link(spark, monkeypatch):
    monkeypatch.setattr(nd, "CENTRES", 0)
    rows = planted(11)
    got = nd.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), words=4).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 4)


def test_keep_one_of_each(spark):
    rows = planted(9)
    df = spark.createDataFrame(rows, SCHEMA)
    kept = nd.keep_one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(x[0]) for x in brute(rows, 5) if x[3])


def test_one_large_group_of_near_copies(spark):
    r = random.Random(4)
    origin = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(1500):
        copy = list(origin)
        copy[r.randrange(120)] = f"y{i}"
        rows.append((i, " ".join(copy), "n", 0, None))
    got = nd.near_duplicates(spark.createDataFrame(rows, SCHEMA)).agg({"component_id": "max"}).first()[0]
    assert got == 0


def test_signatures_estimate_similarity():
    a, b = np.arange(0, 1000, dtype=np.uint64), np.arange(200, 1200, dtype=np.uint64)
    same = np.mean([(nd.signature(nd.mix64(a + np.uint64(k * 10**6))) == nd.signature(nd.mix64(b + np.uint64(k * 10**6)))).mean() for k in range(30)])
    assert abs(same - 800 / 1200) < 0.03


def test_empty_table(spark):
    assert nd.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
