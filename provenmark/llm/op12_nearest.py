"""Approximate nearest neighbours by learned partitions.

1. Equal vectors are one entry with their smallest ids.
2. A bounded sample (the `sample` vectors of a part with the smallest hashes) gets its exact neighbour graph, which is cut into
   balanced parts: halving along main directions, then moves to the part that holds most neighbours while sizes stay within 5 %.
3. A small classifier (one hidden layer, trained in numpy) learns how the neighbours of a vector are spread over the parts. Every
   entry goes to its most probable part; parts that are still large are split again, on their own samples.
4. A query goes to its most probable parts until they make up `mass` of the probability, several as a rule, and is held against
   every entry there in double precision. Parts are held in slices of about `slice_rows`, so a part that is too large costs more
   tasks and not a larger one.

Fitting sees at most `sample` vectors for each part and level; three levels of at most 64 parts bound what is broadcast by
64 + 64² models of about 40 KB. All entries are indexed. `recall` compares with the exact answer.

Defined cases: null and empty vectors, vectors of zeros only, and vectors with a null or non-finite component take no part, as
queries neither; shorter vectors are taken to end in zeros; rows that repeat an id and vector are rows of their own (another such
row is a neighbour at distance 0); rows with a null id are candidates, after others at the same distance, and no queries; further
columns are not read; a query without candidates has no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, table
from .vectors import NO_ID, key, leading, lists, matrix, spread, together, usable

FIRST, EVERY = 10, 100
SAMPLE, PART_ROWS, PARTS, LEVELS = 6_000, 4_096, 64, 3
MASS, SLICE_ROWS = 0.97, 8_192
NEIGHBOURS, HIDDEN, ROUNDS = 16, 64, 60


def graph(x: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
    """The k nearest other rows of each row."""
    k = min(k, len(x) - 1)
    size = (x * x).sum(1)
    out = np.zeros((len(x), k), int)
    for a in range(0, len(x), 512):
        far = size - 2 * x[a : a + 512] @ x.T
        far[np.arange(len(far)), np.arange(a, a + len(far))] = np.inf
        out[a : a + 512] = np.argpartition(far, k - 1, axis=1)[:, :k]
    return out


def halved(x: np.ndarray, parts: int) -> np.ndarray:
    """Equal parts by halving along the direction of largest spread."""
    out = np.zeros(len(x), int)
    open_ = [(np.arange(len(x)), parts, 0)]
    while open_:
        rows, n, base = open_.pop()
        if n == 1:
            out[rows] = base
            continue
        centred = x[rows] - x[rows].mean(0)
        along = centred @ np.linalg.eigh(centred.T @ centred)[1][:, -1]
        order = rows[np.argsort(along, kind="stable")]
        left = n // 2
        at = len(rows) * left // n
        open_ += [(order[:at], left, base), (order[at:], n - left, base + left)]
    return out


def balanced(near: np.ndarray, part: np.ndarray, parts: int, rounds: int = 12, slack: float = 0.05) -> np.ndarray:
    """Parts of a neighbour graph with fewer cut edges: nodes move to the part of most neighbours, largest gains first, sizes within slack."""
    part, n = part.copy(), len(near)
    most, least = np.ceil(n / parts * (1 + slack)), np.floor(n / parts * (1 - slack))
    ends, starts = np.concatenate([near.ravel(), np.repeat(np.arange(n), near.shape[1])]), np.concatenate([np.repeat(np.arange(n), near.shape[1]), near.ravel()])
    for _ in range(rounds):
        votes = np.bincount(starts * parts + part[ends], minlength=n * parts).reshape(n, parts)
        best = votes.argmax(1)
        gain = votes[np.arange(n), best] - votes[np.arange(n), part]
        sizes, moved = np.bincount(part, minlength=parts), 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if sizes[best[i]] < most and sizes[part[i]] > least:
                sizes[part[i]] -= 1
                sizes[best[i]] += 1
                part[i] = best[i]
                moved += 1
        if not moved:
            break
    return part


class Router:
    """One hidden layer and a softmax over parts."""

    def __init__(self, arrays: list[np.ndarray]):
        self.mean, self.scale, self.w1, self.b1, self.w2, self.b2 = arrays

    def inner(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(((x - self.mean) / self.scale) @ self.w1 + self.b1, 0)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self.inner(x) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.logits(x)
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def raw(self) -> list[bytes]:
        return [a.astype("<f8").tobytes() for a in (self.mean, self.scale)] + [a.astype("<f4").tobytes() for a in (self.w1, self.b1, self.w2, self.b2)]

    @classmethod
    def of(cls, raw: list[bytes], size: int) -> Router:
        w1, b1, w2, b2 = (np.frombuffer(r, "<f4").astype(np.float64) for r in raw[2:])
        return cls([np.frombuffer(raw[0], "<f8"), np.frombuffer(raw[1], "<f8"), w1.reshape(size, -1), b1, w2.reshape(len(b1), -1), b2])


def fit(x: np.ndarray, parts: int, seed: int = 0) -> Router:
    """Parts of the neighbour graph of x, and a router that was trained on nine tenths of it and stopped by the rest."""
    rng = np.random.default_rng(seed)
    most = max(float(np.abs(x).max()), 1e-300)
    x = x / most  # so that no square overflows
    near = graph(x)
    part = balanced(near, halved(x, parts), parts)
    goal = np.zeros((len(x), parts))
    np.add.at(goal, (np.repeat(np.arange(len(x)), near.shape[1]), part[near].ravel()), 1 / near.shape[1])
    mean, scale = x.mean(0), np.full(x.shape[1], max(float(x.std()), 1e-30))
    net = Router([mean, scale, rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), (HIDDEN, parts)), np.zeros(parts)])
    learn = np.arange(len(x)) % 10 != 0
    rest = np.flatnonzero(~learn)
    names = ("w1", "b1", "w2", "b2")
    slow, square, best, step = {n: 0.0 for n in names}, {n: 0.0 for n in names}, (np.inf, None), 0
    for _ in range(ROUNDS):
        for rows in np.array_split(rng.permutation(np.flatnonzero(learn)), max(1, learn.sum() // 128)):
            inner = net.inner(x[rows])
            out = (net.probabilities(x[rows]) - goal[rows]) / len(rows)
            back = (out @ net.w2.T) * (inner > 0)
            grads = {"w1": ((x[rows] - mean) / scale).T @ back + 1e-4 * net.w1, "b1": back.sum(0), "w2": inner.T @ out + 1e-4 * net.w2, "b2": out.sum(0)}
            step += 1
            for n in names:
                slow[n] = 0.9 * slow[n] + 0.1 * grads[n]
                square[n] = 0.999 * square[n] + 0.001 * grads[n] ** 2
                setattr(net, n, getattr(net, n) - 0.003 * slow[n] / (1 - 0.9**step) / (np.sqrt(square[n] / (1 - 0.999**step)) + 1e-8))
        loss = -(goal[rest] * np.log(net.probabilities(x[rest]) + 1e-12)).sum(1).mean()
        if loss < best[0]:
            best = (loss, {n: getattr(net, n).copy() for n in names}, step)
        elif step > best[2] + 6 * max(1, learn.sum() // 128):
            break
    for n, value in best[1].items():
        setattr(net, n, value)
    net.mean, net.scale = mean * most, scale * most
    return net


def _fit_part(size: int, part_rows: int, sample: int):
    """The sample of one part to its model."""

    def fitted(group: pa.Table) -> pa.Table:
        group = group.sort_by([("h1", "ascending"), ("h2", "ascending")]).slice(0, sample)
        x = matrix(group["x"], size)
        parts = max(2, min(PARTS, -(-group["number"][0].as_py() // part_rows), len(x) // 8))
        return pa.table({"part": pa.array([group["part"][0].as_py()], pa.string()), "model": pa.array([fit(x, parts).raw()], pa.list_(pa.binary()))})

    return fitted


def _leaves(routers: dict, part: str, x: np.ndarray) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(leaf, rows, probabilities) over the leaves below a part."""
    if part not in routers:
        return [(part, np.arange(len(x)), np.ones(len(x)))]
    p, out = routers[part].probabilities(x), []
    for k in range(p.shape[1]):
        rows = np.flatnonzero(p[:, k] > 1e-6)
        out += [(leaf, rows[r], q * p[rows[r], k]) for leaf, r, q in _leaves(routers, f"{part}.{k}", x[rows]) if len(r)]
    return out


def _home(routers: dict, x: np.ndarray) -> np.ndarray:
    """The most probable leaf, level by level."""
    leaf = np.full(len(x), "0", object)
    while open_ := set(leaf) & set(routers):
        for name in open_:
            rows = np.flatnonzero(leaf == name)
            leaf[rows] = [f"{name}.{k}" for k in routers[name].logits(x[rows]).argmax(1)]
    return leaf


def _place(routers: dict, size: int, slices: dict | None = None, wanted: dict | None = None):
    """Entries with their part and slice; only those of the `wanted` samples where these are given, as (part, entries, greatest hash)."""

    def placed(batches):
        for batch in batches:
            part = _home(routers, matrix(batch.column("x"), size))
            if wanted is None:
                of = np.array([(slices or {}).get(p, 1) for p in part], np.int64)
                number = batch.column("h2").to_numpy() % of if len(part) else of
                keep = np.arange(len(part))
            else:
                number = np.array([wanted.get(p, (0, 0))[0] for p in part], np.int64)
                to = np.array([wanted[p][1] if p in wanted else -(2**63) for p in part], np.int64)
                keep = np.flatnonzero(batch.column("h1").to_numpy() < to) if len(part) else number
            columns = [c.take(pa.array(keep)) for c in batch.columns]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(part[keep], pa.string()), pa.array(number[keep])], [*batch.schema.names, "part", "number"])

    return placed


def _ask(routers: dict, size: int, slices: dict, mass: float):
    """Queries to a row for each slice of each of their parts."""

    def asked(batches):
        for batch in batches:
            x = matrix(batch.column("x"), size)
            for a in range(0, len(x), 256):
                found = _leaves(routers, "0", x[a : a + 256])
                leaf = np.repeat(np.arange(len(found)), [len(r) for _, r, _ in found])
                rows, p = np.concatenate([r for _, r, _ in found]), np.concatenate([q for _, _, q in found])
                order = np.lexsort((-p, rows))
                rows, leaf, p = rows[order], leaf[order], p[order]
                before = np.cumsum(p) - p
                before -= np.maximum.accumulate(np.where(np.concatenate([[True], rows[1:] != rows[:-1]]), before, 0))
                rows, leaf = rows[before < mass], leaf[before < mass]
                many = np.array([slices.get(name, 1) for name, _, _ in found])[leaf]
                which = np.repeat(np.arange(len(rows)), many)
                number = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
                names = np.array([name for name, _, _ in found], object)[leaf[which]]
                columns = [c.take(pa.array(rows[which] + a)) for c in batch.columns]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(names, pa.string()), pa.array(number, pa.int64())], [*batch.schema.names, "part", "number"])

    return asked


_ENTRY = "h1 long, h2 long, x array<double>, ids array<long>, part string, number long"


class Index:
    """Entries (h1, h2, x, ids) in learned partitions."""

    def __init__(self, entries: DataFrame, sample: int = SAMPLE, part_rows: int = PART_ROWS):
        self.entries = entries
        facts = entries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("size")).first()
        self.size, self.routers, self.counts = facts["size"] or 1, {}, {"0": facts["n"]}
        for level in range(LEVELS):
            # a sample of each large part: the smallest hashes, of which a few more than asked for are drawn
            wanted = {p: (n, min(2**63 - 1, int(2**64 * min(1.0, 1.2 * sample / n)) - 2**63)) for p, n in self.counts.items() if n > part_rows and p.count(".") == level}
            if not wanted:
                break
            some = entries.mapInArrow(_place(self.routers, self.size, wanted=wanted), _ENTRY)
            models = some.groupBy("part").applyInArrow(_fit_part(self.size, part_rows, sample), "part string, model array<binary>").collect()
            self.routers |= {r["part"]: Router.of(r["model"], self.size) for r in models}
            placed = entries.mapInArrow(_place(self.routers, self.size), _ENTRY).groupBy("part").agg(F.count(F.lit(1)).alias("n"))
            self.counts = {r["part"]: r["n"] for r in placed.collect()}

    def nearest(self, queries: DataFrame, first: int, mass: float = MASS, slice_rows: int = SLICE_ROWS) -> DataFrame:
        """queries(h1, h2, x) to (h1, h2, found), an array of the first + 1 nearest (score, vec_id), the query's own rows among them."""
        slices = {p: -(-n // slice_rows) for p, n in self.counts.items() if n > slice_rows}
        held = self.entries.mapInArrow(_place(self.routers, self.size, slices), _ENTRY)
        asked = queries.mapInArrow(_ask(self.routers, self.size, slices, mass), "h1 long, h2 long, x array<double>, part string, number long")
        found = held.groupBy("part", "number").cogroup(asked.groupBy("part", "number")).applyInArrow(_rerank(self.size, first + 1), "h1 long, h2 long, score double, vec_id long")
        best = Window.partitionBy("h1", "h2").orderBy("score", "vec_id")
        found = found.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= first + 1)
        return found.groupBy("h1", "h2").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("found"))


def _rerank(size: int, most: int):
    """The `most` nearest rows of a slice for each query that comes to it."""

    def ranked(held: pa.Table, asked: pa.Table) -> pa.Table:
        out = [[], [], [], []]
        if held.num_rows and asked.num_rows:
            x, y = matrix(asked["x"], size), matrix(held["x"], size)
            offsets, ids = lists(held["ids"])
            norms, h1, h2 = (y * y).sum(1), asked["h1"].to_numpy(), asked["h2"].to_numpy()
            for a in range(0, len(x), 256):
                q = x[a : a + 256]
                with np.errstate(all="ignore"):
                    far = norms - 2 * q @ y.T + (q * q).sum(1)[:, None]
                k = min(most, len(y)) - 1
                limit = np.partition(far, k, axis=1)[:, k]
                slack = 1e-9 * ((q * q).sum(1) + norms.max())
                row, col = np.nonzero(~(far > (limit + slack)[:, None]))
                score = np.sqrt(((q[row] - y[col]) ** 2).sum(1))
                which, at = spread(col, offsets)
                row, score = row[which], score[which]
                keep = leading(row, score, ids[at], most)
                for values, part in zip(out, (h1[a + row[keep]], h2[a + row[keep]], score[keep], ids[at][keep]), strict=True):
                    values.append(part)
        joined = [np.concatenate(v) if v else np.zeros(0) for v in out]
        return pa.table([pa.array(v, t) for v, t in zip(joined, (pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)], ["h1", "h2", "score", "vec_id"])

    return ranked


def nearest(vectors: DataFrame, first: int = FIRST, every: int = EVERY, mass: float = MASS, part_rows: int = PART_ROWS, sample: int = SAMPLE, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """vectors(vec_id, embedding) to query_id, rank, vec_id, score for each row whose vec_id is divisible by `every`."""
    rows = usable(vectors).where(F.exists("x", lambda v: v != 0)).select("vec_id", "x", *key())
    entries = cut(together(rows, first + 1))
    queries = cut(rows.where(F.col("vec_id") % every == 0))
    index = Index(entries, sample, part_rows)
    asked = queries.groupBy("h1", "h2").agg(F.first("x").alias("x"))
    found = cut(index.nearest(asked, first, mass, slice_rows))
    # of a query's rows one is its own: the first with its id and vector, and else (ids beyond the nearest kept) the last one goes
    own = queries.select(F.col("vec_id").alias("query_id"), "h1", "h2").join(found, ["h1", "h2"])
    at = F.array_position(F.transform("found", lambda f: F.when(f["score"] == 0, f["vec_id"])), F.col("query_id"))
    rest = F.filter("found", lambda f, i: i + 1 != at)
    out = own.select("query_id", F.posexplode(F.slice(rest, 1, first)).alias("at", "f"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.nullif(F.col("f.vec_id"), F.lit(NO_ID)).alias("vec_id"), F.col("f.score").alias("score"))


def op12_nearest(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact answer's (query_id, vec_id) that was found."""
    same = exact.select("query_id", "vec_id").join(found.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_semi").count()
    return same / max(1, exact.count())
