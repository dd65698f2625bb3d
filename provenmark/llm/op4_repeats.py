"""Repeated passages by the common-prefix interval tree of enhanced suffix arrays.

A byte goes if a string of `least` (200) bytes that covers it also starts anywhere else, in the same text or another. Every such
window belongs to the smallest hash among its 40-byte grams (its anchor), so equal windows have equal anchors wherever they stand.
Neighbouring windows with one anchor make a run, about one for 80 bytes.

1. Runs are counted by anchor. An anchor with one run, in whose bytes its gram stands once, holds no repeat; that ends the work for
   most of the text. (A gram that stands twice in its run may be a short-period stretch, whose windows equal each other.)
2. Runs whose anchor recurs are counted by 128 bits of anchor and content; equal runs go on as one string with its count. Where an
   anchor has no other string, that string is a repeat with its count, and no tree is needed.
3. The strings of other such anchors go to shards by anchor. Each task builds an enhanced suffix array (ranks by prefix doubling,
   LCPs from the ranks) for blocks of whole anchors and scans the LCPs with a stack: intervals of the common-prefix tree with LCP of
   200 or more whose occurrences differ in the byte before are the maximal repeats. Spans are their occurrences; a repeated start in
   no such interval lies one byte or more behind one that is in a longer interval, so nothing is lost.
4. An anchor with over `heavy` different strings is not sent to one task: its suffixes are cut at 200 bytes and counted by 128-bit
   digest, with partial sums, and met again by a join; so a passage that a third of all texts share stays in small pieces.
5. Spans are put together for each text, and the text is cut. `repeat_groups` returns the repeats themselves with all places.

Anchors, counts and joins are plain aggregates and joins, so hot anchors are summed before the shuffle or split by Spark. The texts
are shuffled once: the fetch of strings and the cut read the same exchange.

Defined cases: null and empty texts have 0 bytes, nothing removed and the hash of no bytes; texts under 200 bytes lose nothing;
repeated rows are texts that occur twice; a null doc_id is an ordinary row; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, table
from .words import buffers, mix

LEAST, GRAM, PIECE = 200, 40, 256
HEAVY = 4_000
BLOCK_BYTES, TEXT_BYTES = 300_000, 1_000_000
_MUL = np.array([0x9E3779B97F4A7C15], np.uint64)
_INVERSE = np.array([pow(0x9E3779B97F4A7C15, -1, 1 << 64)], np.uint64)
_HEADS = np.array([0] + [2**64 - 2 ** (64 - 8 * k) for k in range(1, 9)], np.uint64)  # the first k of eight bytes
RUNS = "d long, k long, at long, m long, rh long, again boolean"


def _view(data: np.ndarray, kind: str = "<u8") -> np.ndarray:
    """The eight bytes from each byte on, as a number."""
    return np.ndarray((len(data),), kind, np.concatenate([data, np.zeros(8, np.uint8)]), 0, (1,))


def _least_in(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.uint64(2**64 - 1))
    padded[:n] = values
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def runs_of(data: np.ndarray, ends: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, ...]:
    """(start, windows, anchor, content hash) of the runs of texts that end at `ends` in data."""
    return _flagged_runs(data, ends, least)[:4]


def _flagged_runs(data: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(start, windows, anchor, content hash, whether the anchor's gram stands twice in it) of the runs of texts that end at `ends` in data."""
    none = (np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool))
    if len(data) < least:
        return none
    view = _view(data)
    gram = view[: len(data) - GRAM + 1] * _MUL
    for k in range(8, GRAM, 8):
        gram = (gram ^ (gram >> np.uint64(29))) * _MUL + view[k : len(data) - GRAM + 1 + k]
    gram = mix(gram)
    anchor = _least_in(gram, least - GRAM + 1)
    begins = np.concatenate([[0], ends[:-1]])
    inside = np.zeros(len(anchor) + 1, np.int32)
    long = np.flatnonzero(ends - begins >= least)
    np.add.at(inside, begins[long], 1)
    np.add.at(inside, ends[long] - least + 1, -1)
    valid = np.cumsum(inside)[:-1] > 0
    fresh = valid.copy()
    fresh[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1])
    start = np.flatnonzero(fresh)
    if not len(start):
        return none
    last = valid.copy()
    last[:-1] &= ~valid[1:] | fresh[1:]
    count = np.flatnonzero(last) + 1 - start
    pieces = -(-count // PIECE)
    part = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = np.repeat(start, pieces) + part * PIECE
    count = np.minimum(np.repeat(count, pieces) - part * PIECE, PIECE)
    power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.repeat(_MUL, len(data))]))
    back = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.repeat(_INVERSE, len(data))]))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(view) * power[: len(data)], dtype=np.uint64)])
    content = mix((sums[start + count + least - 1 - 7] - sums[start]) * back[start] + count.astype(np.uint64) * _INVERSE)
    grams = count + least - GRAM
    opens = np.cumsum(grams) - grams
    at = np.arange(int(grams.sum())) + np.repeat(start - opens, grams)
    again = np.add.reduceat((gram[at] == np.repeat(anchor[start], grams)).astype(np.int32), opens) > 1
    return start, count, anchor[start], content, again


def _pieces(offsets: np.ndarray, least: int):
    """Lists of (text, from, to): texts together up to TEXT_BYTES, a longer text in overlapping parts."""
    held, size = [], 0
    for i in range(len(offsets) - 1):
        n = int(offsets[i + 1] - offsets[i])
        for a in range(0, max(1, n - least + 1), TEXT_BYTES):
            b = min(n, a + TEXT_BYTES + least - 1)
            held.append((i, a, b))
            size += b - a
            if size >= TEXT_BYTES:
                yield held
                held, size = [], 0
    if held:
        yield held


def _runs(batches, least):
    for batch in batches:
        offsets, data = buffers(batch.column(2))
        for parts in _pieces(offsets, least):
            joined = np.concatenate([data[offsets[i] + a : offsets[i] + b] for i, a, b in parts])
            ends = np.cumsum([b - a for _, a, b in parts])
            start, count, anchor, content, again = _flagged_runs(joined, ends, least)
            which = np.searchsorted(ends, start, "right")
            base = np.array([a for _, a, _ in parts]) - np.concatenate([[0], ends[:-1]])
            keys = pa.array(np.array([i for i, _, _ in parts])[which]) if len(start) else pa.array([], pa.int64())
            at = (start + base[which]) * 512 + count
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(keys), batch.column(1).take(keys), pa.array(at, pa.int64()), pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), pa.array(again)], ["d", "k", "at", "m", "rh", "again"]
            )


class SuffixArray:
    """Enhanced suffix array over the valid starts of some byte strings: order, LCPs of neighbours, and the interval tree."""

    def __init__(self, strings: list[bytes], starts: np.ndarray, least: int = LEAST):
        sizes = np.array([len(s) for s in strings], np.int64)
        data = np.frombuffer(b"".join(strings), np.uint8)
        begin = np.cumsum(sizes) - sizes
        self.least = least
        # bytes from each place to its string's end, which ranks below every byte: nothing is compared past it
        left = np.repeat(begin + sizes, sizes) - np.arange(len(data))
        first = _view(data, ">u8").astype(np.uint64) & _HEADS[np.minimum(left, 8)]
        first = np.unique(first, return_inverse=True)[1].astype(np.int64) * 9 + np.minimum(left, 8)
        rank = {8: np.unique(first, return_inverse=True)[1].astype(np.int32)}
        width, longest = 8, int(sizes.max(initial=0))
        while width < longest:
            key = rank[width].astype(np.int64) * (len(data) + 1)
            on = np.flatnonzero(left > width)
            key[on] += rank[width][on + width].astype(np.int64) + 1
            rank[2 * width] = np.unique(key, return_inverse=True)[1].astype(np.int32)
            width *= 2
        self.owner = np.repeat(np.arange(len(strings)), starts)
        self.offset = np.arange(int(starts.sum())) - np.repeat(np.cumsum(starts) - starts, starts)
        place = begin[self.owner] + self.offset
        self.order = np.argsort(rank[width][place], kind="stable")
        p, q = place[self.order[:-1]], place[self.order[1:]]
        shared = np.zeros(len(p), np.int64)
        for w in sorted(rank, reverse=True):
            level = np.append(rank[w], np.full(width + 1, -1))
            same = level[np.minimum(p + shared, len(level) - 1)] == level[np.minimum(q + shared, len(level) - 1)]
            shared += w * same
        padded = np.append(data, np.zeros(width + 8, np.uint8))
        for _ in range(7):
            shared += padded[np.minimum(p + shared, len(padded) - 1)] == padded[np.minimum(q + shared, len(padded) - 1)]
        rest = (begin + sizes)[self.owner] - place
        self.lcp = np.minimum(shared, np.minimum(rest[self.order[:-1]], rest[self.order[1:]])) if len(p) else shared
        self.left = np.where(self.offset > 0, padded[place - 1].astype(np.int64), -1 - self.owner)[self.order]

    def roots(self) -> tuple[np.ndarray, np.ndarray]:
        """First and last place of each topmost interval with LCP of `least` or more."""
        near = np.concatenate([[False], self.lcp >= self.least, [False]])
        return np.flatnonzero(near[1:] & ~near[:-1]), np.flatnonzero(near[:-1] & ~near[1:])

    def maximal(self):
        """Maximal repeats: (length, first, last place in the order) of intervals whose occurrences differ in the byte before."""
        for lo, hi in zip(*self.roots(), strict=True):
            left = self.left[lo : hi + 1]
            if left.min() == left.max():
                continue  # then the same holds for every interval inside
            stack = []  # (lcp, first place, least left, greatest left), LCPs ascending
            for i in range(lo, hi + 1):
                length = int(self.lcp[i]) if i < hi else 0
                first, low, high = i, int(self.left[i]), int(self.left[i])
                while stack and stack[-1][0] > length:  # intervals that end here take in what came last
                    size, first, a, b = stack.pop()
                    low, high = min(low, a), max(high, b)
                    if low != high:
                        yield size, first, i
                if length and stack and stack[-1][0] == length:
                    _, first, a, b = stack.pop()
                    low, high = min(low, a), max(high, b)
                if length:
                    stack.append((length, first, low, high))

LIGHT = pa.schema([("m", pa.int64()), ("d", pa.int64()), ("k", pa.int64()), ("at", pa.int64()), ("rh", pa.int64()), ("own", pa.bool_()), ("bytes", pa.binary())])
CUT = pa.schema([("digest", pa.binary()), ("d", pa.int64()), ("k", pa.int64()), ("s", pa.int64())])
GROUPS = pa.schema([("group", pa.binary()), ("length", pa.int64()), ("m", pa.int64()), ("rh", pa.int64()), ("d", pa.int64()), ("k", pa.int64()), ("at", pa.int64()), ("off", pa.int64()), ("own", pa.bool_())])
SPANS = pa.schema([(c, pa.int64()) for c in "dkab"])


def _batch(columns, schema):
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _contexts(batches, least, heavy):
    """Rows with text and wanted runs to the strings of those, or to digests of their windows for heavy anchors."""
    schema = CUT if heavy else LIGHT
    for batch in batches:
        out = []
        for d, k, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("d", "k", "text", "wanted")), strict=True):
            raw = text.encode()
            for run in wanted:
                if run["is_heavy"] != heavy:
                    continue
                start, count = divmod(run["at"], 512)
                if heavy:
                    out += [(xxhash.xxh3_128_digest(raw[s : s + least]), d, k, s) for s in range(start, start + count)]
                else:
                    out.append((run["m"], d, k, run["at"], run["rh"], run["own"], raw[start : start + count + least - 1]))
        for i in range(0, len(out), 20_000):
            yield _batch(zip(*out[i : i + 20_000], strict=True), schema)


def _trees(batches, least):
    """(rows, tree) of blocks of whole anchors, from strings sorted by anchor."""
    held, size = [], 0
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(len(LIGHT))), strict=True):
            if size > BLOCK_BYTES and row[0] != held[-1][0]:
                yield held, SuffixArray([r[6] for r in held], np.array([r[3] % 512 for r in held]), least)
                held, size = [], 0
            held.append(row)
            size += len(row[6])
    if held:
        yield held, SuffixArray([r[6] for r in held], np.array([r[3] % 512 for r in held]), least)


def _scan(batches, least):
    """Strings to spans (d, k, a, b) of the occurrences of maximal repeats in those that stand alone."""
    for rows, tree in _trees(batches, least):
        reach = np.zeros(len(tree.order), np.int64)  # bytes repeated from each start on, in the order of strings
        for length, first, last in tree.maximal():
            places = tree.order[first : last + 1]
            reach[places] = np.maximum(reach[places], length)
        own = np.array([r[5] for r in rows])
        hit = np.flatnonzero((reach > 0) & own[tree.owner])
        begin = tree.owner[hit] * 1024 + tree.offset[hit]  # strings lie apart, so their spans never touch
        end = np.maximum.accumulate(begin + reach[hit]) if len(hit) else begin
        fresh = np.flatnonzero(np.concatenate([[True], begin[1:] > end[:-1]])) if len(hit) else hit
        close = np.append(fresh[1:], len(hit))[: len(fresh)] - 1
        which = begin[fresh] // 1024
        base = np.array([r[3] // 512 for r in rows])[which] - which * 1024
        d, k = np.array([r[1] for r in rows], np.int64)[which], np.array([r[2] for r in rows], np.int64)[which]
        yield _batch([d, k, base + begin[fresh], base + end[close]], SPANS)


def _grouped(batches, least):
    """Strings to a row for each occurrence of each maximal repeat."""
    for rows, tree in _trees(batches, least):
        out = []
        for length, first, last in tree.maximal():
            for place in tree.order[first : last + 1]:
                m, d, k, at, rh, own, raw = rows[tree.owner[place]]
                off = int(tree.offset[place])
                out.append((xxhash.xxh3_128_digest(raw[off : off + length]), length, m, rh, d, k, at, off, own))
            if len(out) > 20_000:
                yield _batch(zip(*out, strict=True), GROUPS)
                out = []
        if out:
            yield _batch(zip(*out, strict=True), GROUPS)


def _sql(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "long", pa.bool_(): "boolean", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


class Repeats:
    """Runs of docs(doc_id, d, k, text) whose anchor recurs (`hits`), and their different strings with counts (`counted`)."""

    def __init__(self, docs: DataFrame, least: int = LEAST, heavy: int = HEAVY):
        self.docs, self.least = docs, least
        runs = docs.select("d", "k", "text").mapInArrow(lambda x: _runs(x, least), RUNS)
        anchors = runs.groupBy("m").agg(F.count(F.lit(1)).alias("c"), F.max("again").alias("again")).where("c > 1 OR again").select("m")
        self.hits = cut(runs.drop("again").join(anchors, "m", "left_semi"))
        counted = self.hits.groupBy("m", "rh").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("d", "k", "at")).alias("one"))
        self.counted = cut(counted)
        kinds = self.counted.groupBy("m").agg(F.count(F.lit(1)).alias("kinds")).select("m", "kinds", (F.col("kinds") > heavy).alias("is_heavy"))
        self.wanted = cut(self.counted.join(kinds, "m").where("kinds > 1 OR c = 1").select("m", "rh", "one.*", (F.col("c") == 1).alias("own"), "is_heavy"))
        self.whole = self.hits.join(self.counted.where("c > 1").select("m", "rh"), ["m", "rh"], "left_semi")

    def strings(self, is_heavy: bool) -> DataFrame:
        by = self.wanted.groupBy("d", "k").agg(F.collect_list(F.struct("m", "rh", "at", "own", "is_heavy")).alias("wanted"))
        once = self.docs.join(by, ["d", "k"]).select("doc_id", "d", "k", "text", "wanted")
        least = self.least
        found = once.mapInArrow(lambda x: _contexts(x, least, is_heavy), _sql(CUT if is_heavy else LIGHT))
        return found if is_heavy else found.repartition("m").sortWithinPartitions("m", "d", "k", "at")

    def twice(self, digests: DataFrame) -> DataFrame:
        return digests.groupBy("digest").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("digest")

    def spans(self) -> DataFrame:
        """Spans (d, k, a, b) of bytes in repeats; spans may overlap."""
        start, least = F.floor(F.col("at") / 512), self.least
        spans = self.whole.select("d", "k", start.alias("a"), (start + F.col("at") % 512 + least - 1).alias("b"))
        spans = spans.unionByName(self.strings(False).mapInArrow(lambda x: _scan(x, least), _sql(SPANS)))
        if self.wanted.where("is_heavy").isEmpty():
            return spans
        digests = self.strings(True)
        return spans.unionByName(digests.join(self.twice(digests), "digest", "left_semi").select("d", "k", F.col("s").alias("a"), (F.col("s") + least).alias("b")))

    def groups(self) -> DataFrame:
        """Every place (d, k, start) of each repeat (group, length): maximal ones of the trees, whole strings, cut suffixes of heavy anchors."""
        start, least = F.floor(F.col("at") / 512), self.least
        found = self.strings(False).mapInArrow(lambda x: _grouped(x, least), _sql(GROUPS))
        alone = found.where("own").select("group", "length", "d", "k", (start + F.col("off")).alias("start"))
        copies = self.hits.select("m", "rh", "d", "k", start.alias("from"))
        counted = found.where("NOT own").select("group", "length", "m", "rh", "off").join(copies, ["m", "rh"]).select("group", "length", "d", "k", (F.col("from") + F.col("off")).alias("start"))
        named = F.encode(F.md5(F.encode(F.concat_ws(" ", "m", "rh"), "UTF-8")), "UTF-8")
        whole = self.whole.select(named.alias("group"), (F.col("at") % 512 + least - 1).alias("length"), "d", "k", start.alias("start"))
        digests = self.strings(True)
        cut_ = digests.join(self.twice(digests), "digest", "left_semi").select(F.col("digest").alias("group"), F.lit(least).cast("long").alias("length"), "d", "k", F.col("s").alias("start"))
        return alone.unionByName(counted).unionByName(whole).unionByName(cut_)


def repeated_spans(docs: DataFrame, least: int = LEAST, heavy: int = HEAVY) -> DataFrame:
    return Repeats(docs, least, heavy).spans()


def repeat_groups(docs: DataFrame, least: int = LEAST, heavy: int = HEAVY) -> DataFrame:
    """docs(doc_id, text) to doc_id, k (a row's hash), group, length, start: each place of each repeated passage, in bytes."""
    base = keyed(docs)
    return Repeats(base, least, heavy).groups().join(base.select("doc_id", "d", "k").distinct(), ["d", "k"]).select("doc_id", "k", "group", "length", "start")


def _merge(spans: list, size: int) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _left(raw: bytes, spans) -> bytes:
    at, parts = 0, []
    for a, b in spans:
        parts.append(raw[at:a])
        at = b
    return b"".join([*parts, raw[at:]])


def _cut_texts(batches):
    for batch in batches:
        rows = []
        for d, text, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "spans")), strict=True):
            raw = (text or "").encode()
            merged = _merge(spans, len(raw))
            rows.append((d, len(raw), sum(b - a for a, b in merged), len(merged), hashlib.sha256(_left(raw, merged)).hexdigest()))
        if rows:
            kinds = [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a row's key (d, k) without nulls."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("d"), F.xxhash64("doc_id", text).alias("k"))


def with_spans(docs: DataFrame, least: int = LEAST, heavy: int = HEAVY) -> DataFrame:
    """keyed docs with `spans`, an array of (a, b), null where nothing is repeated."""
    found = repeated_spans(docs, least, heavy).groupBy("d", "k").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    return docs.join(found, ["d", "k"], "left")


def op4_repeated_passages(spark, sf_dir: str) -> DataFrame:
    found = with_spans(keyed(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "d", "k", "text", "spans").mapInArrow(_cut_texts, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _strip(batches):
    for batch in batches:
        texts = []
        for text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            texts.append(_left(text.encode(), _merge(spans, 0)).decode("utf-8", "ignore") if spans else text)
        columns = [batch.column(i) for i in range(2, batch.num_columns)]
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), *columns], ["__new", *batch.schema.names[2:]])


def strip_repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """docs with repeated passages cut out of `text` (half characters at a cut go too); texts left without a word go. Columns as given."""
    base = keyed(docs)
    spans = repeated_spans(base, least).groupBy("d", "k").agg(F.collect_set(F.struct("a", "b")).alias("__spans"))
    rest = [c for c in docs.columns if c != "text"]
    whole = docs.withColumns({"__text": F.coalesce(F.col("text"), F.lit("")), "__d": F.coalesce(F.col("doc_id").cast("long"), F.lit(0))}).withColumn("__k", F.xxhash64("doc_id", "__text"))
    joined = whole.join(spans.withColumnsRenamed({"d": "__d", "k": "__k"}), ["__d", "__k"], "left").select("__text", "__spans", *[F.col(f"`{c}`") for c in rest])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "text")
    out = joined.mapInArrow(_strip, f"__new string, {kinds}")
    return out.where(F.col("__new").rlike(r"[^\x20\x09-\x0D]")).select(*[F.col("__new").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])
