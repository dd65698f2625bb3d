"""Hard negatives by segment summaries of vectors.

Components become whole numbers, floor(256 x). A vector of d numbers is kept with the mean and the deviation (length of what is left
after the mean) of each segment, at several widths. For two vectors, the sum over segments of width times the product of means, plus
or minus the product of deviations, bounds the inner product.

1. Vectors that are equal (and have one label) are one entry with their smallest ids.
2. Entries fall into at most 256 cells by the signs of eight segment means. For each cell the least and greatest means and the
   greatest deviation of each segment are known (a table of at most 256 rows). Cells are held in slices of about `slice_rows`.
3. Positives: an anchor meets its own cell first; its last positive there is what entries in other cells must reach, and cells whose
   bound stays below are left out. Negatives: an anchor meets the cells whose bounds reach its windows of scores.
4. In a slice, bounds of four segments and then of sixteen leave out pairs; those that are left are scored exactly. Scores beyond
   what doubles hold exactly are computed with Python's own whole numbers.

Anchors meet slices in groups of about `anchor_rows`, so no task holds more than one slice and one group. The search is exact.

Defined cases: rows with a null label, a null vector or a null or non-finite component take no part; an empty vector scores 0 with
every other; shorter vectors are taken to end in zeros; rows that repeat an id and vector are rows of their own; rows with a null id
are candidates, after others of the same score, and no anchors, and keep their label; an anchor without positives, or a positive
without negatives in its window, has no rows; components and scores are held to 64 bits; further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, table
from .vectors import NO_ID, key, leading, lists, matrix, spread, together, usable

POSITIVES, NEGATIVES, EVERY, SCALE = 5, 5, 100, 256
LOW, HIGH = 80, 100  # percent of the positive's score
SLICE_ROWS, ANCHOR_ROWS = 8_192, 2_048
COARSE, FINE, SIGNS = 4, 16, 8
_BEST = "h1 long, h2 long, label string, cap decimal(38,0), score decimal(38,0), vec_id long"
_CAP = 2**63 - 1


def segments(x: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of `many` segments of each row, times the root of their width: a product of two rows' means is their part of the score."""
    width = -(-x.shape[1] // many)
    parts = np.pad(x, ((0, 0), (0, width * many - x.shape[1]))).reshape(len(x), many, width)
    means = parts.mean(2)
    return means * np.sqrt(width), np.sqrt(((parts - means[:, :, None]) ** 2).sum(2))


def cell_of(x: np.ndarray) -> np.ndarray:
    return (segments(x, SIGNS)[0] >= 0) @ (1 << np.arange(SIGNS))


def bounds(a, b) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score of every row of a with every row of b, from (means, deviations)."""
    middle, reach = a[0] @ b[0].T, a[1] @ b[1].T
    return middle - reach, middle + reach


def slack(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """More than rounding can move a bound."""
    return 0.5 + 1e-9 * np.sqrt((a * a).sum(1))[:, None] * np.sqrt((b * b).sum(1))[None, :]


def _cells(size: int):
    """Entries with their cell and, for the table of cells, their summary."""

    def placed(batches):
        for batch in batches:
            x = matrix(batch.column("x"), size)
            means, deviations = segments(x, COARSE)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell_of(x), pa.int32()), pa.array(list(means), pa.list_(pa.float64())), pa.array(list(deviations), pa.list_(pa.float64()))], [*batch.schema.names, "cell", "means", "deviations"])

    return placed


def _visits(cells: dict, size: int, slice_rows: int, mode: str):
    """Anchors to a row for each slice of each cell they have to meet. cells: number to (rows, least means, greatest means, greatest deviations)."""
    names = sorted(cells)
    many = np.array([-(-cells[c][0] // slice_rows) for c in names])
    low, high, reach = (np.array([cells[c][i] for c in names]) for i in (1, 2, 3))

    def asked(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("x"), size)
            own = cell_of(x)[:, None] == np.array(names)[None, :]
            if mode == "own":
                go = own
            else:
                means, deviations = segments(x, COARSE)
                pairs = np.stack([means[:, None, :] * low, means[:, None, :] * high])
                spare = deviations @ reach.T + 0.5 + 1e-9 * np.abs(pairs).sum((0, 3))
                most, least = pairs.max(0).sum(2) + spare, pairs.min(0).sum(2) - spare
                at, caps = lists(batch.column("caps"))
                begins = np.minimum(at[:-1], max(0, len(caps) - 1))
                caps = caps.astype(float)
                if mode == "others":  # caps: the score to reach, if any
                    go = ~own & ((most >= (caps[begins] if len(caps) else 0)[:, None]) | (np.diff(at) == 0)[:, None]) if len(caps) else ~own
                else:  # caps: positive scores, of which any can have its window in the cell
                    top = np.maximum.reduceat(caps, begins)
                    bottom = np.minimum.reduceat(caps, begins)
                    go = (most >= (bottom * LOW / 100)[:, None]) & (least <= top[:, None])
            row, col = np.nonzero(go)
            which = np.repeat(np.arange(len(row)), many[col])
            number = np.arange(len(which)) - np.repeat(np.cumsum(many[col]) - many[col], many[col])
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(row[which])) for c in batch.columns), pa.array(np.array(names)[col[which]], pa.int32()), pa.array(number, pa.int64())], [*batch.schema.names, "cell", "number"])

    return asked


def _exact(a: np.ndarray, b: np.ndarray, pairs=None) -> np.ndarray:
    """Scores of all pairs, or of (rows of a, rows of b) `pairs`; whole numbers as Python's own where doubles cannot hold them."""
    most = max(float(np.abs(a).max(initial=0)), float(np.abs(b).max(initial=0)))
    if most * most * max(1, a.shape[1]) * 200 >= 2.0**53:
        a, b = (np.array([[int(v) for v in r] for r in m], object).reshape(m.shape) for m in (a, b))
        return (a[pairs[0]] * b[pairs[1]]).sum(1) if pairs else a @ b.T
    return np.einsum("ij,ij->i", a[pairs[0]], b[pairs[1]]) if pairs else a @ b.T


def _scored(x, y, may) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, col, score) of the pairs that `may(least, greatest)` leaves after each level of bounds."""
    room = slack(x, y)
    low, high = bounds(segments(x, COARSE), segments(y, COARSE))
    row, col = np.nonzero(may(low - room, high + room, None))
    if len(row) > 0.25 * len(x) * len(y):  # most are left: scoring all at once is cheaper than refining each
        return row, col, _exact(x, y)[row, col]
    if len(row):
        (ma, da), (mb, db) = segments(x, FINE), segments(y, FINE)
        middle, reach = (np.einsum("ij,ij->i", p[row], q[col]) for p, q in ((ma, mb), (da, db)))
        keep = may(middle - reach - room[row, col], middle + reach + room[row, col], row)
        row, col = row[keep], col[keep]
    return row, col, _exact(x, y, (row, col))


def _positives(size: int, most: int):
    """The `most` best rows of a slice with the anchor's label."""

    def found(held: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        if held.num_rows and asked.num_rows:
            x, y = matrix(asked["x"], size), matrix(held["x"], size)
            mine, theirs = (np.array(t["label"].to_pylist(), object) for t in (asked, held))
            offsets, ids = lists(held["ids"])
            at, caps = lists(asked["caps"]) if "caps" in asked.column_names else (np.zeros(len(x) + 1, int), np.zeros(0))
            reach = np.full(len(x), -np.inf)
            reach[np.diff(at) > 0] = caps.astype(float)[at[:-1][np.diff(at) > 0]]
            for label in set(mine) & set(theirs):
                rows, cols = np.flatnonzero(mine == label), np.flatnonzero(theirs == label)
                for a in range(0, len(rows), 256):
                    out += _best_of_label(x, y, rows[a : a + 256], cols, reach, most, offsets, ids)
        return _answer(asked, [(r, None, s, i) for r, s, i in out])

    return found


def _best_of_label(x, y, rows, cols, reach, most, offsets, ids):
    k = len(cols) - min(most, len(cols))

    def may(least, greatest, row):
        if row is not None:
            return greatest >= need[row]
        if k:
            need[:] = np.maximum(need, np.partition(least, k, axis=1)[:, k])  # so many score that much at least
        return greatest >= need[:, None]

    need = reach[rows].copy()
    row, col, score = _scored(x[rows], y[cols], may)
    which, place = spread(cols[col], offsets)
    keep = leading(row[which], -score[which], ids[place], most)
    return [(rows[row[which[keep]]], score[which[keep]], ids[place[keep]])] if len(keep) else []


def _negatives(size: int, most: int):
    """The `most` best rows of a slice with another label, below each of the anchor's positive scores."""

    def found(held: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        if held.num_rows and asked.num_rows:
            x, y = matrix(asked["x"], size), matrix(held["x"], size)
            mine, theirs = (np.array(t["label"].to_pylist(), object) for t in (asked, held))
            offsets, ids = lists(held["ids"])
            lists_of_caps = asked["caps"].to_pylist()
            for a in range(0, len(x), 128):
                rows = np.arange(a, min(a + 128, len(x)))
                caps = [[int(c) for c in lists_of_caps[r]] for r in rows]
                top, bottom = np.array([max(c) for c in caps], float), np.array([min(c) for c in caps], float) * LOW / 100
                other = mine[rows][:, None] != theirs[None, :]
                row, col, score = _scored(x[rows], y, lambda least, greatest, row, t=top, b=bottom, o=other: (greatest >= b[:, None]) & (least <= t[:, None]) & o if row is None else (greatest >= b[row]) & (least <= t[row]))
                for nth in range(max(map(len, caps))):
                    cap = np.array([c[nth] if nth < len(c) else -1 for c in caps], score.dtype)[row]
                    fits = np.flatnonzero((cap >= 0) & (100 * score <= HIGH * cap) & (100 * score >= LOW * cap))
                    which, place = spread(col[fits], offsets)
                    keep = leading(row[fits][which], -score[fits][which], ids[place], most)
                    if len(keep):
                        pairs = fits[which[keep]]
                        out.append((rows[row[pairs]], cap[pairs], score[pairs], ids[place[keep]]))
        return _answer(asked, out)

    return found


def _answer(asked: pa.Table, found: list) -> pa.Table:
    """(places of anchors, caps or None, scores, ids) as rows."""
    kind = pa.decimal128(38, 0)

    def whole(values):
        return pa.array([None if v is None else int(v) for v in values], kind)

    places = np.concatenate([f[0] for f in found]).astype(int) if found else np.zeros(0, int)
    caps = [c for f in found for c in ([None] * len(f[0]) if f[1] is None else f[1].tolist())]
    scores = [s for f in found for s in f[2].tolist()]
    ids = np.concatenate([f[3] for f in found]) if found else np.zeros(0, np.int64)
    of = pa.array(places)
    return pa.table([*(asked[c].take(of).combine_chunks() for c in ("h1", "h2", "label")), whole(caps), whole(scores), pa.array(ids, pa.int64())], ["h1", "h2", "label", "cap", "score", "vec_id"])


class Cells:
    """Entries (h1, h2, label, x, ids) in cells and slices."""

    def __init__(self, entries: DataFrame, anchors: int, slice_rows: int = SLICE_ROWS, anchor_rows: int = ANCHOR_ROWS):
        self.size = entries.agg(F.max(F.size("x"))).first()[0] or 1
        self.slice_rows, self.groups = slice_rows, max(1, -(-anchors // anchor_rows))
        kinds = "h1 long, h2 long, label string, x array<double>, ids array<long>"
        placed = entries.select("h1", "h2", "label", "x", "ids").mapInArrow(_cells(self.size), f"{kinds}, cell int, means array<double>, deviations array<double>")
        one = [F.array(*[f(F.get(c, F.lit(i))) for i in range(COARSE)]).alias(n) for n, f, c in (("low", F.min, "means"), ("high", F.max, "means"), ("reach", F.max, "deviations"))]
        self.cells = {r["cell"]: (r["n"], r["low"], r["high"], r["reach"]) for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *one).collect()}
        self.placed = placed

    def meet(self, anchors: DataFrame, mode: str, scan) -> DataFrame:
        """anchors(h1, h2, label, x, caps) with the slices they have to meet, group by group, through scan(entries, anchors)."""
        asked = anchors.select("h1", "h2", "label", "x", "caps").mapInArrow(_visits(self.cells, self.size, self.slice_rows, mode), "h1 long, h2 long, label string, x array<double>, caps array<decimal(38,0)>, cell int, number long")
        asked = asked.withColumn("group", F.pmod("h2", F.lit(self.groups)))
        slices = F.create_map(*[v for c, (n, *_) in self.cells.items() for v in (F.lit(c), F.lit(-(-n // self.slice_rows)))]) if self.cells else F.create_map().cast("map<int,int>")
        held = self.placed.select("h1", "label", "x", "ids", "cell", F.pmod("h1", F.try_element_at(slices, F.col("cell"))).alias("number"))
        held = held.withColumn("group", F.explode(F.expr(f"sequence(0L, {self.groups - 1}L)")))
        return held.groupBy("cell", "number", "group").cogroup(asked.groupBy("cell", "number", "group")).applyInArrow(scan, _BEST)


def _first(rows: DataFrame, most: int, *by: str) -> DataFrame:
    order = Window.partitionBy("h1", "h2", "label", *by).orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most)


def mine(vectors: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, slice_rows: int = SLICE_ROWS, anchor_rows: int = ANCHOR_ROWS) -> DataFrame:
    """vectors(vec_id, embedding, label) to anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    rows = usable(vectors, F.col("label").cast("string").alias("label")).where("label IS NOT NULL")
    whole = F.transform("x", lambda v: F.floor(v * SCALE).cast("double") + F.lit(0.0))
    rows = rows.select("vec_id", whole.alias("x"), "label").select("vec_id", "x", "label", *key())
    entries = cut(together(rows, max(positives + 1, negatives), "label"))
    wanted = cut(rows.where(F.col("vec_id") % every == 0))
    anchors = cut(wanted.groupBy("h1", "h2", "label").agg(F.first("x").alias("x")))
    cells = Cells(entries, anchors.count(), slice_rows, anchor_rows)
    most, id_ = positives + 1, ["h1", "h2", "label"]
    none = F.expr("CAST(array() AS array<decimal(38,0)>)").alias("caps")
    own = cut(cells.meet(anchors.select("*", none), "own", _positives(cells.size, most)))
    last = own.groupBy(*id_).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") >= most)
    reach = anchors.join(last, id_, "left").select(*id_, "x", F.when(F.col("least").isNotNull(), F.array("least")).otherwise(none).alias("caps"))
    others = cells.meet(reach, "others", _positives(cells.size, most))
    best = cut(_first(_first(own, most).drop("nth").unionByName(others), most))
    near = best.groupBy(*id_).agg(F.array_sort(F.collect_list(F.struct("nth", "score", "vec_id"))).alias("near"), F.array_sort(F.collect_set(F.when(F.col("score") >= 0, F.col("score")))).alias("caps"))
    near = cut(near)
    hard = cells.meet(anchors.join(near.where(F.size("caps") > 0), id_), "windows", _negatives(cells.size, negatives))
    hard = _first(hard, negatives, "cap").groupBy(*id_, "cap").agg(F.array_sort(F.collect_list(F.struct("nth", "score", "vec_id"))).alias("hard"))
    # of an anchor's rows one is its own; where it is not among the first, the last of these goes
    pairs = wanted.select(F.col("vec_id").alias("anchor_id"), *id_).join(near.drop("caps"), id_)
    at = F.array_position(F.transform("near", lambda r: r["vec_id"]), F.col("anchor_id"))
    pairs = pairs.withColumn("p", F.explode(F.slice(F.filter("near", lambda r, i: i + 1 != at), 1, positives)))
    pairs = pairs.select("anchor_id", *id_, F.col("p.vec_id").alias("positive_id"), F.col("p.score").alias("cap")).join(hard, [*id_, "cap"])
    out = pairs.select("anchor_id", "positive_id", "cap", F.explode("hard").alias("n"))
    number = lambda c: F.least(F.greatest(c, F.lit(-_CAP)), F.lit(_CAP)).cast("long")
    known = lambda c: F.nullif(c, F.lit(NO_ID))
    return out.select("anchor_id", known(F.col("positive_id")).alias("positive_id"), F.col("n.nth").cast("int").alias("rank"), known(F.col("n.vec_id")).alias("negative_id"), number(F.col("cap")).alias("positive_score"), number(F.col("n.score")).alias("negative_score"))


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return mine(vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * e::DOUBLE) FOR e IN embedding] AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([e FOR e IN embedding IF e IS NULL OR NOT isfinite(e)]) = 0
),
pairs AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, list_inner_product(a.x, b.x)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank FROM positives JOIN pairs USING (anchor_id)
  WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
WHERE rank <= 5
"""
