"""Gradient-boosted trees on histograms, grouped cross-validation of arms, and what is measured on them.

Feature tables have a row for each unit. Every (arm, fold) is one task that fits on all rows of the other folds
and scores its own; it holds the arm's features of all units, so its memory grows with the units.
"""

from __future__ import annotations

import hashlib
import pickle
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crestline.config import ARMS, Arm, arm_columns
from crestline.operators.evaluation import ap_of, fold_assignment

#: Shuffle partitions for each group of rows that is a task: few of them then meet another group.
SPREAD = 4
#: Rows of a forest's partition.
FOREST_ROWS = 2048
#: Nodes of more rows have their histograms summed by feature, smaller ones those of all features at once.
BY_FEATURE = 4096


def same_columns(bins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each distinct column of bytes is first seen, in order, how often it occurs, and each column's place among them."""
    keys = np.ascontiguousarray(bins.T)
    if not keys.size:
        return np.arange(min(len(keys), 1)), np.full(min(len(keys), 1), len(keys)), np.zeros(len(keys), int)
    _, first, place, times = np.unique(keys.view(f"V{keys.shape[1]}").ravel(), return_index=True, return_inverse=True, return_counts=True)
    order = np.argsort(first)
    turned = np.empty_like(order)
    turned[order] = np.arange(len(order))
    return first[order], times[order], turned[place]


def quantiles(x: np.ndarray, q: np.ndarray, times: np.ndarray | None = None) -> np.ndarray:
    """``np.quantile`` of values that each count once or so many ``times``, without writing them out."""
    if times is None:
        return np.quantile(x, q)
    values, place = np.unique(x, return_inverse=True)
    upto = np.cumsum(np.bincount(place, times).astype(np.int64))
    at = (upto[-1] - 1) * q
    low = np.floor(at).astype(np.int64)
    t, a, b = at - low, *(values[np.searchsorted(upto, i, side="right")] for i in (low, np.minimum(low + 1, upto[-1] - 1)))
    return np.where(t >= 0.5, b - (b - a) * (1 - t), a + (b - a) * t)


class BoostedTrees:
    """Binary boosting with balanced weights: leaf-wise trees on up to 255 bins of each feature.

    Rows of equal bins and label are the same to every tree and go as one row that counts so many times.
    """

    SETTINGS = {"default": {"rounds": 250, "rate": 0.1, "leaves": 31, "depth": 64, "min_leaf": 5, "l2": 0.0}, "regularised": {"rounds": 120, "rate": 0.05, "leaves": 4, "depth": 3, "min_leaf": 15, "l2": 1.0}}

    def __init__(self, kind: str = "default", **settings):
        self.s = self.SETTINGS[kind] | settings

    def fit(self, x: np.ndarray, y: np.ndarray, times: np.ndarray | None = None) -> BoostedTrees:
        """Fits rows, each of which counts once or so many ``times``."""
        n, d = len(x) if times is None else int(times.sum()), x.shape[1]
        self.cuts = [np.unique(quantiles(x[:, j], np.linspace(0, 1, 256)[1:-1], times)) if n > 255 else np.unique(x[:, j])[:-1] for j in range(d)]
        bins = self._bins(x)
        self.width = max((len(c) for c in self.cuts), default=0) + 1
        pos = y.sum() if times is None else (y * times).sum()
        first, same, place = same_columns(np.vstack([bins, (y == 1)[None].astype(np.uint8)]))
        times = (same if times is None else np.bincount(place, times)).astype(float)
        bins, y = np.ascontiguousarray(bins[:, first]), y[first]
        weight = times * np.where(y == 1, n / (2 * max(pos, 1)), n / (2 * max(n - pos, 1)))
        self.base, self.trees = 0.0, []
        raw = np.zeros(len(y))
        for _ in range(self.s["rounds"]):
            p = 1 / (1 + np.exp(-raw))
            g, h = weight * (p - y), weight * p * (1 - p)
            tree, step = self._grow(bins, g, h, times)
            if tree is None:
                break
            self.trees.append(tree)
            raw += step
        return self

    def _bins(self, x: np.ndarray) -> np.ndarray:
        """Each value's bin, by feature: at most 255."""
        out = np.zeros((len(self.cuts), len(x)), np.uint8)
        for j, c in enumerate(self.cuts):
            out[j] = np.searchsorted(c, x[:, j], side="left")
        return out

    def _split(self, bins, g, h, times, rows):
        """The best gain, and the feature and bin that it comes from; the first of equal ones."""
        none, least = (1e-12, None), self.s["min_leaf"]
        times = times[rows]
        d, n, width = len(bins), times.sum(), self.width
        if not d or width < 2 or n < 2 * least:
            return none
        g, h = g[rows], h[rows]
        gt, ht, l2 = g.sum(), h.sum(), self.s["l2"]
        if len(rows) > BY_FEATURE:
            gs, hs, ns = np.zeros((d, width)), np.zeros((d, width)), np.zeros((d, width))
            for j in range(d):
                b = bins[j][rows]
                gs[j], hs[j], ns[j] = np.bincount(b, g, width), np.bincount(b, h, width), np.bincount(b, times, width)
        else:
            at = (bins[:, rows] + (width * np.arange(d))[:, None]).ravel()
            gs, hs, ns = (np.bincount(at, np.tile(w, d), d * width).reshape(d, width) for w in (g, h, times))
        gs, hs, ns = (np.cumsum(a, axis=1)[:, :-1] for a in (gs, hs, ns))
        j, k = np.nonzero((ns >= least) & (n - ns >= least))
        if not len(j):
            return none
        gs, hs = gs[j, k], hs[j, k]
        gain = gs**2 / (hs + l2 + 1e-12) + (gt - gs) ** 2 / (ht - hs + l2 + 1e-12) - gt**2 / (ht + l2 + 1e-12)
        top = int(gain.argmax())
        return (float(gain[top]), (int(j[top]), int(k[top]))) if gain[top] > none[0] else none

    def _grow(self, bins, g, h, times):
        value = lambda rows: -self.s["rate"] * g[rows].sum() / (h[rows].sum() + self.s["l2"] + 1e-12)
        every = np.arange(len(g))
        nodes = [[None, 0, 0, 0, value(every)]]
        open_leaves = [(*self._split(bins, g, h, times, every), 0, every, 0)]
        leaves, step = {0: every}, np.zeros(len(g))
        while len(leaves) < self.s["leaves"]:
            open_leaves = [o for o in open_leaves if o[1] is not None and o[4] < self.s["depth"]]
            if not open_leaves:
                break
            at = max(range(len(open_leaves)), key=lambda i: open_leaves[i][0])
            _, (j, k), node, rows, depth = open_leaves.pop(at)
            low = bins[j][rows] <= k
            left, right = rows[low], rows[~low]
            nodes[node][:4] = [j, k, len(nodes), len(nodes) + 1]
            del leaves[node]
            for own in (left, right):
                open_leaves.append((*self._split(bins, g, h, times, own), len(nodes), own, depth + 1))
                leaves[len(nodes)] = own
                nodes.append([None, 0, 0, 0, value(own)])
        if len(nodes) == 1:
            return None, step
        for node, rows in leaves.items():
            step[rows] = nodes[node][4]
        return nodes, step

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self._predict(self._bins(x))

    def _predict(self, bins: np.ndarray) -> np.ndarray:
        first, _, place = same_columns(bins)
        bins = np.ascontiguousarray(bins[:, first])
        raw = np.zeros(len(first))
        for nodes in self.trees:
            stack = [(0, np.arange(len(raw)))]
            while stack:
                node, rows = stack.pop()
                j, k, left, right, value = nodes[node]
                if j is None:
                    raw[rows] += value
                    continue
                low = bins[j][rows] <= k
                stack += [(left, rows[low]), (right, rows[~low])]
        return (1 / (1 + np.exp(-raw)))[place]


def volume_line(train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Base and slope of each feature's line on the proxy, which is the last column."""
    x = train[:, -1]
    slope = np.array([((x - x.mean()) * (c - c.mean())).sum() for c in train[:, :-1].T]) / max(((x - x.mean()) ** 2).sum(), 1e-300)
    return train[:, :-1].mean(0) - slope * x.mean(), slope


def without_volume(rows: np.ndarray, base: np.ndarray, slope: np.ndarray) -> np.ndarray:
    """Each feature minus its line on the proxy; the proxy goes."""
    return rows[:, :-1] - base - np.outer(rows[:, -1], slope)


OOF = "arm string, topic string, label int, fold int, p double"


def arm_features(matrix: DataFrame, arms: tuple[Arm, ...], sets: dict | None = None) -> dict[str, list[str]]:
    """The columns of each arm; raises ValueError if the matrix lacks one of them."""
    columns = {a.name: arm_columns(a, sets) if sets else arm_columns(a) for a in arms}
    if lacking := sorted({c for own in columns.values() for c in own} - set(matrix.columns)):
        raise ValueError(f"the matrix does not have: {lacking}")
    return columns


class Fitted:
    """An arm's model for one fold; its size is set by rounds and leaves, not by rows."""

    def __init__(self, arm: Arm, train: np.ndarray, y: np.ndarray, times: np.ndarray | None = None, **settings):
        self.share, self.model, self.line = float(np.average(y, weights=times)) if len(y) else 0.5, None, None
        if train.shape[1] == 0 or len(np.unique(y)) < 2:
            return  # an arm without features, or a single class
        if arm.residualise:
            self.line = volume_line(train)
            train = without_volume(train, *self.line)
        self.model = BoostedTrees(arm.model, **settings).fit(train, y, times)

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.model is None:
            return np.full(len(x), self.share)
        return self.model.predict(x if self.line is None else without_volume(x, *self.line))


def _table(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Topics in order, with their labels and features, of a group with topic, label and x."""
    group = group.select(["topic", "label", "x"]).sort_by("topic").combine_chunks()
    n = len(group)
    x = group["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)
    return group["topic"].to_numpy(), group["label"].to_numpy(), x.reshape(n, -1) if len(x) else np.zeros((n, 0))


def _numbers(columns: list[str]):
    return F.array(*[F.col(c).cast("double") for c in columns]).cast("array<double>")


def oof_scores(matrix: DataFrame, arms: tuple[Arm, ...] = ARMS, folds: int = 5, seed: str = "42", sets: dict | None = None, **settings) -> DataFrame:
    """Out-of-fold scores of each arm: arm, topic, label, fold, p; an (arm, fold) is a task, which holds the arm's features of all rows."""
    by_name, columns = {a.name: a for a in arms}, arm_features(matrix, arms, sets)
    used = sorted({c for own in columns.values() for c in own})
    kept = matrix.select("topic", "label", *used).cache()  # a row a unit, read for folds and for rows
    rows = fold_assignment(kept, "topic", folds, seed)
    tasks = F.explode(F.array(*[F.struct(F.lit(a.name).alias("arm"), F.lit(f).alias("test"), _numbers(columns[a.name]).alias("x")) for a in arms for f in range(folds)]))

    def of_task(key: tuple, group: pa.Table) -> pa.Table:
        name, test = key[0].as_py(), key[1].as_py()
        own, rest = (group.filter(m) for m in (pc.equal(group["fold"], test), pc.not_equal(group["fold"], test)))
        topics, labels, x = _table(own)
        p = np.zeros(0)
        if len(labels):
            _, y, known = _table(rest)
            p = Fitted(by_name[name], known if len(y) else np.zeros((0, len(columns[name]))), y, **settings).predict(x)
        return pa.table({"arm": pa.array([name] * len(labels), pa.string()), "topic": pa.array(topics, pa.string()), "label": pa.array(labels, pa.int32()), "fold": pa.array(np.full(len(labels), test), pa.int32()), "p": pa.array(p, pa.float64())})

    dealt = rows.select("topic", F.col("label").cast("int").alias("label"), "fold", tasks.alias("t")).select("topic", "label", "fold", "t.arm", "t.test", "t.x")
    return dealt.repartition(SPREAD * len(arms) * folds, "arm", "test").groupBy("arm", "test").applyInArrow(of_task, OOF)


def _places(topics: list[str], salt: str) -> np.ndarray:
    """Rows in order of a hash of their topic."""
    end, names = f":{salt}".encode(), [t.encode() for t in topics]
    # as two numbers, first digits first, the hashes have the order of their digits
    digits = np.frombuffer(b"".join([hashlib.md5(t + end).digest() for t in names]), ">u8").astype(np.uint64).reshape(-1, 2)
    order = np.lexsort((digits[:, 1], digits[:, 0]))
    again = np.flatnonzero((digits[order[1:]] == digits[order[:-1]]).all(axis=1))
    return order if not len(again) else np.array(sorted(order.tolist(), key=lambda i: (*digits[i].tolist(), topics[i])))


def _dealt_folds(topics: list[str], labels: np.ndarray, folds: int, seed: str) -> np.ndarray:
    """The folds that ``fold_assignment`` gives to the same rows."""
    out, order = np.zeros(len(topics), int), _places(topics, seed)
    for label in np.unique(labels):
        own = order[labels[order] == label]
        out[own] = np.arange(len(own)) % folds
    return out


def same_rows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows, and each row's place among them."""
    code, n = np.zeros(len(x), np.int64), min(len(x), 1)
    for column in x.T:
        values, place = np.unique(column, return_inverse=True)
        known, code = np.unique(code * len(values) + place, return_inverse=True)
        n = len(known)
    one = np.zeros(n, np.int64)
    one[code] = np.arange(len(x))
    return x[one], code


def blocks_of(rows: DataFrame) -> DataFrame:
    """block: the rows as Arrow streams, a batch a row, so that copies for many tasks are not copied row by row."""

    def pack(batches):
        for batch in batches:
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, batch.schema) as stream:
                stream.write_batch(batch)
            yield pa.RecordBatch.from_pydict({"block": pa.array([out.getvalue().to_pybytes()], pa.binary())})

    return rows.mapInArrow(pack, "block binary")


def replicated_scores(matrix: DataFrame, arm: Arm, folds: int, seeds: list[int], shuffled: bool = False, **settings) -> DataFrame:
    """rep, label, p, n: out-of-fold scores of one arm for each of ``seeds``, which deal the folds anew; n rows have them.

    With ``shuffled`` the folds stay and the labels are dealt anew, but for the first seed's. A replicate is a
    task, which deals its own labels and folds and fits every fold on all rows of the others. Rows with equal features
    are fitted and scored as one that counts so many times.
    """
    columns = arm_features(matrix, (arm,))[arm.name]
    reps = F.explode(F.array(*[F.lit(i) for i in range(len(seeds))])).alias("rep")

    def of_rep(key: tuple, group: pa.Table) -> pa.Table:
        rep = key[0].as_py()
        topics, labels, x = _table(pa.concat_tables([pa.ipc.open_stream(b.as_buffer()).read_all() for b in group["block"]]))
        topics = topics.tolist()
        if shuffled:
            taken = labels[_places(topics, str(seeds[rep]) if rep else "")]
            labels = np.empty_like(labels)
            labels[_places(topics, "")] = taken
        fold = _dealt_folds(topics, labels, folds, str(seeds[0] if shuffled else seeds[rep]))
        distinct, code = (x, np.arange(len(x))) if arm.residualise else same_rows(x)  # lines are sums over rows as they are
        kind, found = 2 * code + (labels == 1), []
        for test in range(folds):
            rest, own = np.flatnonzero(fold != test), np.bincount(kind[fold == test], minlength=2 * len(distinct))
            first = np.full(2 * len(distinct), -1)
            first[kind[rest[::-1]]] = rest[::-1]
            first = np.sort(first[first >= 0])  # in the order in which they are first seen
            times = None if arm.residualise else np.bincount(kind[rest], minlength=2 * len(distinct))[kind[first]]
            p, seen = Fitted(arm, x[first], labels[first], times, **settings).predict(distinct), np.flatnonzero(own)
            found.append((seen % 2, p[seen // 2], own[seen]))
        label, p, n = (np.concatenate(c) for c in zip(*found, strict=True))
        return pa.table({"rep": pa.array(np.full(len(p), rep), pa.int32()), "label": pa.array(label, pa.int32()), "p": pa.array(p), "n": pa.array(n, pa.int64())})

    rows = blocks_of(matrix.select("topic", F.col("label").cast("int").alias("label"), _numbers(columns).alias("x"))).select("block", reps)
    return rows.repartition(SPREAD * len(seeds), "rep").groupBy("rep").applyInArrow(of_rep, "rep int, label int, p double, n long")


def permutation_importance(matrix: DataFrame, columns: list[str], repeats: int = 30, seed: int = 42, **settings) -> DataFrame:
    """Mean loss of average precision when a feature's values are shuffled among 30 per cent held-out rows.

    One task fits the model; it is sent to the tasks that shuffle, a feature each, which hold the held-out rows.
    """
    spark = matrix.sparkSession
    kept = matrix.select("topic", "label", *columns).cache()  # a row a unit, read for folds and for rows
    rows = fold_assignment(kept, "topic", 10).select("topic", F.col("label").cast("int").alias("label"), "fold", _numbers(columns).alias("x"))

    def fit(key: tuple, group: pa.Table) -> pa.Table:
        _, y, x = _table(group)
        model = BoostedTrees(**settings).fit(x, y) if len(np.unique(y)) > 1 else None
        return pa.table({"model": pa.array([pickle.dumps(model)], pa.binary())})

    fitted = rows.filter("fold >= 3").groupBy(F.lit(0).alias("all")).applyInArrow(fit, "model binary").collect()  # at most one
    model = spark.sparkContext.broadcast(bytes(fitted[0]["model"]) if fitted else pickle.dumps(None))
    features = F.explode(F.array(*[F.lit(c) for c in columns])).alias("feature")
    # rows of all folds, so that a feature has its row even where none are held out
    dealt = rows.withColumn("held", F.col("fold") < 3).withColumn("x", F.when(F.col("held"), F.col("x"))).select("topic", "label", "held", "x", features)

    def of_feature(key: tuple, group: pa.Table) -> pa.Table:
        name, known = key[0].as_py(), pickle.loads(model.value)
        importance = spread = 0.0
        held = group.filter(group["held"])
        if known is not None and len(held):
            _, y, x = _table(held)
            rng, bins, at = np.random.default_rng(seed), known._bins(x), columns.index(name)
            p, lost = known._predict(bins), []
            whole = ap_of(y, p)
            for _ in range(repeats):
                dealt_bins = rng.permutation(bins[at])
                other = np.flatnonzero(dealt_bins != bins[at])  # a row that got its own bin keeps its score
                shuffled, scores = bins[:, other], p.copy()
                shuffled[at] = dealt_bins[other]
                scores[other] = known._predict(shuffled)
                lost.append(whole - ap_of(y, scores))
            importance, spread = float(np.mean(lost)), float(np.std(lost))
        return pa.table({"feature": [name], "importance": [importance], "spread": [spread]})

    return dealt.repartition(SPREAD * len(columns), "feature").groupBy("feature").applyInArrow(of_feature, "feature string, importance double, spread double")


def top_importances(importance: DataFrame, n: int = 18) -> DataFrame:
    """The features whose shuffling costs most."""
    return importance.orderBy(F.desc("importance"), "feature").limit(n)


def in_order(rows: DataFrame, n: int) -> DataFrame:
    """``rows``, of which there are ``n``, in partitions of FOREST_ROWS on average, each in order of topics.

    Rows of a matrix are small, so adaptive plans put all of them into a few partitions, and a forest costs many times
    what its rows weigh. Its draws also depend on partitions and order: now they are the same on every cluster.
    """
    return rows.repartition(max(1, -(-n // FOREST_ROWS)), "topic").sortWithinPartitions("topic")


def _forest(rows: DataFrame, columns: list[str], trees: int, seed: int):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    shares = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}  # two classes
    n = sum(shares.values())
    weight = F.coalesce(*[F.when(F.col("label") == k, F.lit(n / (len(shares) * c))) for k, c in shares.items()])
    assembler = VectorAssembler(inputCols=columns, outputCol="x")
    model = RandomForestClassifier(featuresCol="x", labelCol="label", weightCol="weight", numTrees=trees, seed=seed).fit(assembler.transform(rows.withColumn("weight", weight)))
    return assembler, model


def random_forest_scores(matrix: DataFrame, columns: list[str], folds: int = 5, trees: int = 120, seed: int = 42) -> DataFrame:
    """Out-of-fold scores of a balanced random forest of Spark's library: topic, label, fold, p."""
    from pyspark.ml.functions import vector_to_array

    kept = matrix.select("topic", "label", *columns).cache()  # read for the number of rows, for folds and for rows
    rows = in_order(fold_assignment(kept, "topic", folds, str(seed)), kept.count()).cache()
    parts = []
    for fold in range(folds):
        assembler, model = _forest(rows.filter(F.col("fold") != fold), columns, trees, seed)
        parts.append(model.transform(assembler.transform(rows.filter(F.col("fold") == fold))).select("topic", "label", "fold", vector_to_array("probability")[1].alias("p")))
    return reduce(DataFrame.unionByName, parts)


def impurity_importance(matrix: DataFrame, columns: list[str], trees: int = 120, seed: int = 42) -> DataFrame:
    """How much each feature takes off the impurity in a forest over all rows: feature, importance; they sum to one."""
    kept = matrix.select("topic", "label", *columns).cache()
    _, model = _forest(in_order(kept, kept.count()).cache(), columns, trees, seed)
    found = [(c, float(v)) for c, v in zip(columns, model.featureImportances.toArray(), strict=True)]
    return matrix.sparkSession.createDataFrame(found, "feature string, importance double")
