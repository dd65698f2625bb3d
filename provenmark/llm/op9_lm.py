"""Language-model scores from an interpolated modified Kneser-Ney bigram model counted in Spark.

Texts fall into chunks of about `chunk_bytes` by a hash, and n-grams into shards by the hash of their context. All tables are sorted
arrays of hashes:

1. Texts go to their chunks in compressed blocks. Each chunk sends to each shard its distinct bigrams there, with the counts of its
   training texts: contexts and next words as 64-bit hashes, each once, and places in them; words likewise go to word shards. That is
   the combining before the shuffle.
2. A shard merges what chunks sent into counts and context statistics, and answers each chunk in the chunk's own order. It also
   sends the number of contexts of each next word to the word shards, which sum continuation counts and word counts likewise.
3. Counts of counts (a dozen numbers) give the discounts.
4. Each chunk meets its texts again with its slice of the model. A worker stores the slice as a sorted hash array in a file, maps
   it into memory and scores every text by vectorised binary search.

A worker holds one chunk or one shard, never the model, and nothing but the dozen numbers passes the driver.

Tokens are words with A-Z lower-cased, then one end; the context of the first word is that end. Unknown words share the weight of
one word more. Defined cases: null and empty texts are one end token; a null doc_id is neither learned from nor held out; repeated rows are rows of their own;
without training texts every token has probability 1; other columns are not read.
"""

from __future__ import annotations

import itertools
import tempfile
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, table
from .words import buffers, mix, split

CHUNK_BYTES, BLOCK_BYTES = 12_000_000, 24_000_000
FOLD = 7
END = mix(np.array([77], np.uint64))
_MUL = np.array([0x9E3779B97F4A7C15], np.uint64)
BLOBS = "kind string, target int, source int, a binary, b binary, c binary, numbers array<long>"
_FIELDS = pa.schema([("kind", pa.string()), ("target", pa.int32()), ("source", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("numbers", pa.list_(pa.int64()))])


def pack(values: np.ndarray) -> bytes:
    return values.astype("<u8").tobytes()


def unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u8")


def _blocks(batches):
    """Rows (doc_id, text, train, held_out, chunk) to (chunk, block), a compressed table of the rows of a chunk that stand near each other."""

    def sent(held):
        rows = pa.Table.from_batches(held)
        order = pc.sort_indices(rows["chunk"])
        rows = rows.take(order)
        chunk = rows["chunk"].to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1), len(chunk)]
        blocks = []
        for a, b in itertools.pairwise(cuts):
            sink = pa.BufferOutputStream()
            part = rows.slice(a, b - a).drop_columns(["chunk"]).combine_chunks()
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(part)
            blocks.append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(chunk[cuts[:-1]], pa.int32()), pa.array(blocks, pa.binary())], ["chunk", "block"])

    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size > BLOCK_BYTES:
            yield sent(held)
            held, size = [], 0
    if held:
        yield sent(held)


def _opened(part: pa.Table) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(b.as_buffer()).read_all() for b in part["block"]])


def squeeze(values: np.ndarray) -> bytes:
    return zlib.compress(values.astype("<i8").view(np.uint8).reshape(len(values), 8).T.tobytes(), 1)  # high bytes together: mostly zeros


def loosen(raw: bytes) -> np.ndarray:
    flat = np.frombuffer(zlib.decompress(raw), np.uint8)
    return np.ascontiguousarray(flat.reshape(8, -1).T).view("<i8").ravel()


class Chunk:
    """Distinct words and bigrams of a chunk's texts, in an order that only depends on the set of rows."""

    def __init__(self, texts, train: np.ndarray, shards: int):
        offsets, data = buffers(texts)
        words = split(offsets, data, lower=True)
        self.counts = np.diff(words.first) + 1  # tokens of each text
        ends = np.cumsum(self.counts)
        tokens = np.empty(int(self.counts.sum()), np.uint64)
        is_end = np.zeros(len(tokens), bool)
        is_end[ends - 1] = True
        tokens[~is_end], tokens[is_end] = words.hashes, END[0]
        self.word, self.index = np.unique(np.concatenate([tokens, END]), return_inverse=True)
        end, self.index = self.index[-1], self.index[:-1]
        before = np.concatenate([[end], self.index[:-1]])
        if len(ends):
            before[np.concatenate([[0], ends[:-1]])] = end
        weight = np.repeat(train.astype(float), self.counts)
        pairs, self.pair = np.unique(before * len(self.word) + self.index, return_inverse=True)
        self.pair_count = np.bincount(self.pair, weight, len(pairs)).astype(np.int64)
        self.word_count = np.bincount(self.index, weight, len(self.word)).astype(np.int64)
        self.context, self.next = pairs // len(self.word), pairs % len(self.word)
        self.word_shard = shard_of(self.word, shards)
        self.pair_shard = shard_of(self.word, shards)[self.context]


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return (mix(hashes) % np.uint64(shards)).astype(int)


def by_shard(of: np.ndarray) -> dict[int, np.ndarray]:
    """Places of each shard, ascending."""
    order = np.argsort(of, kind="stable")
    cuts = np.flatnonzero(np.diff(of[order])) + 1
    return {int(of[p[0]]): p for p in np.split(order, cuts) if len(p)}


def _table(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_FIELDS)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FIELDS, strict=True)], schema=_FIELDS)


def _send(shards: int):
    def sent(part: pa.Table) -> pa.Table:
        me = part["chunk"][0].as_py()
        part = _opened(part)
        chunk = Chunk(part["text"], part["train"].to_numpy(zero_copy_only=False), shards)
        rows = []
        for s, at in by_shard(chunk.pair_shard).items():
            contexts, sizes = np.unique(chunk.context[at], return_counts=True)
            nexts, place = np.unique(chunk.next[at], return_inverse=True)
            rows.append(("pairs", s, me, pack(chunk.word[contexts]), pack(chunk.word[nexts]), squeeze(np.concatenate([sizes, place, chunk.pair_count[at]])), None))
        for s, at in by_shard(chunk.word_shard).items():
            rows.append(("words", s, me, pack(chunk.word[at]), None, squeeze(chunk.word_count[at]), None))
        return _table(rows)

    return sent


def _merge_pairs(shards: int):
    def merged(part: pa.Table) -> pa.Table:
        if part["kind"][0].as_py() == "words":  # merged later, with what the pair shards add
            return part.cast(_FIELDS)
        got = part.select(["source", "a", "b", "c"]).to_pylist()
        contexts, nexts, sizes, counts = [], [], [], []
        for r in got:
            v, n = unpack(r["a"]), loosen(r["c"])
            of_context, place, count = np.split(n, [len(v), len(v) + (len(n) - len(v)) // 2])
            contexts.append(np.repeat(v, of_context))
            nexts.append(unpack(r["b"])[place])
            sizes.append(len(place))
            counts.append(count)
        v, w, count = np.concatenate(contexts), np.concatenate(nexts), np.concatenate(counts)
        _, index, back = np.unique(mix(v * _MUL + w), return_index=True, return_inverse=True)
        total = np.bincount(back, count, len(index)).astype(np.int64)
        context, of = np.unique(v[index], return_inverse=True)
        stats = [np.bincount(of, total, len(context))] + [np.bincount(of, k, len(context)) for k in (total == 1, total == 2, total >= 3)]
        rows = [("sums", 0, 0, None, None, None, [int((total == k).sum()) for k in (1, 2, 3, 4)])]
        for r, entries, place in zip(got, np.split(total[back], np.cumsum(sizes)[:-1]), np.split(back, np.cumsum(sizes)[:-1]), strict=True):
            mine = np.searchsorted(context, unpack(r["a"]))
            rows.append(("pairs", r["source"], part["target"][0].as_py(), squeeze(entries), squeeze(np.concatenate([s[mine] for s in stats]).astype(np.int64)), None, None))
        known = total > 0
        word, number = np.unique(w[index][known], return_counts=True)
        for s, at in by_shard(shard_of(word, shards)).items():
            rows.append(("next", s, part["target"][0].as_py(), pack(word[at]), None, squeeze(number[at]), None))
        return _table(rows)

    return merged


def _merge_words(part: pa.Table) -> pa.Table:
    got = part.select(["kind", "source", "a", "c"]).to_pylist()
    words = [unpack(r["a"]) for r in got]
    numbers = [loosen(r["c"]) for r in got]
    word, back = np.unique(np.concatenate(words), return_inverse=True)
    is_next = np.repeat([r["kind"] == "next" for r in got], [len(w) for w in words])
    values = np.concatenate(numbers)
    contexts = np.bincount(back, values * is_next, len(word)).astype(np.int64)
    counts = np.bincount(back, values * ~is_next, len(word)).astype(np.int64)
    rows = [("sums", 0, 0, None, None, None, [int((contexts == k).sum()) for k in (1, 2, 3, 4)] + [int((contexts >= 3).sum()), int(contexts.sum()), int((counts > 0).sum()), int(counts.sum())])]
    for r, place in zip(got, np.split(back, np.cumsum([len(w) for w in words])[:-1]), strict=True):
        if r["kind"] == "words":
            rows.append(("words", r["source"], part["target"][0].as_py(), squeeze(contexts[place]), squeeze(counts[place]), None, None))
    return _table(rows)


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Modified Kneser-Ney discounts of counts 0, 1, 2 and 3 or more; 0.5, 1, 1.5 where counts of counts are missing."""
    if not (n1 and n2 and n3):
        return np.array([0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    return np.array([0, *(min(max(k - (k + 1) * y * b / a, 0.0), float(k)) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))])


class Slice:
    """Sorted hashes with a value each, in a file without a name that is mapped into memory."""

    def __init__(self, hashes: np.ndarray, values: np.ndarray):
        order = np.argsort(hashes)
        file = tempfile.TemporaryFile()
        file.write(hashes[order].astype("<u8").tobytes() + values[order].astype("<f8").tobytes())
        file.flush()
        n = len(hashes)
        self.hashes = np.memmap(file, "<u8", "r", 0, (n,)) if n else hashes
        self.values = np.memmap(file, "<f8", "r", 8 * n, (n,)) if n else values
        file.close()

    def find(self, hashes: np.ndarray) -> np.ndarray:
        return np.asarray(self.values[np.searchsorted(self.hashes, hashes)])


def _score(shards: int, known: dict):
    def scored(part: pa.Table, slices: pa.Table) -> pa.Table:
        part = _opened(part)
        chunk = Chunk(part["text"], part["train"].to_numpy(zero_copy_only=False), shards)
        counts, stats = np.zeros(len(chunk.next), np.int64), np.zeros((4, len(chunk.word)))
        nexts, total = np.zeros(len(chunk.word), np.int64), np.zeros(len(chunk.word), np.int64)
        pairs, words = by_shard(chunk.pair_shard), by_shard(chunk.word_shard)
        for r in slices.select(["kind", "source", "a", "b"]).to_pylist():
            if r["kind"] == "pairs":
                at = pairs[r["source"]]
                counts[at] = loosen(r["a"])
                stats[:, np.unique(chunk.context[at])] = loosen(r["b"]).reshape(4, -1)
            else:
                at = words[r["source"]]
                nexts[at], total[at] = loosen(r["a"]), loosen(r["b"])
        d, e = known["pairs"], known["words"]
        types = known["V"] + 1
        if known["M"]:
            spare = (e[1] * known["t1"] + e[2] * known["t2"] + e[3] * known["t3"]) / known["M"]
            low = np.maximum(nexts - e[np.minimum(nexts, 3)], 0) / known["M"] + spare / types
        else:
            low = np.full(len(chunk.word), 1 / types)
        seen = stats[0][chunk.context]
        gamma = d[1] * stats[1] + d[2] * stats[2] + d[3] * stats[3]
        with np.errstate(all="ignore"):
            high = (np.maximum(counts - d[np.minimum(counts, 3)], 0) + gamma[chunk.context] * low[chunk.next]) / seen
        model = Slice(mix(chunk.word[chunk.context] * _MUL + chunk.word[chunk.next]), np.log10(np.where(seen > 0, high, low[chunk.next])))
        ends = np.cumsum(chunk.counts)
        starts = ends - chunk.counts
        context = np.concatenate([END, chunk.word[chunk.index[:-1]]])
        context[starts] = END[0]
        score = np.add.reduceat(model.find(mix(context * _MUL + chunk.word[chunk.index])), starts)
        plain = np.log10((total + 1) / (known["N"] + types))[chunk.index]
        n_known = np.add.reduceat((total > 0)[chunk.index].astype(np.int64), starts)
        base = np.array([np.sum(plain[a:b]) for a, b in zip(starts, ends, strict=True)])
        n = part.num_rows
        return pa.Table.from_arrays([part["doc_id"], part["held_out"], pa.array(chunk.counts.astype(np.int64)), pa.array(n_known), pa.array(np.full(n, known["N"], np.int64)), pa.array(base), pa.array(score)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    def whole(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows:
            return scored(left, right)
        kinds = [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]
        return pa.schema(kinds).empty_table()

    return whole


def score_texts(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, fold: int = FOLD) -> DataFrame:
    """docs(doc_id, text) to doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")) + 16)).first()[0] or 0
    shards = max(1, -(-int(size) // chunk_bytes))
    rest = F.crc32(F.col("doc_id").cast("string")) % fold
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.coalesce(rest != 2, F.lit(False)).alias("train"),
        F.coalesce(rest == 2, F.lit(False)).alias("held_out"),
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).cast("int").alias("chunk"),
    )
    rows = rows.mapInArrow(_blocks, "chunk int, block binary")
    sent = rows.groupBy("chunk").applyInArrow(_send(shards), BLOBS)
    merged = cut(sent.groupBy("kind", "target").applyInArrow(_merge_pairs(shards), BLOBS))
    words = cut(merged.where("kind IN ('words', 'next')").groupBy("target").applyInArrow(_merge_words, BLOBS))

    def sums(df, n):
        found = df.where("kind = 'sums'").agg(*[F.sum(F.get("numbers", F.lit(i))).alias(f"n{i}") for i in range(n)]).first()
        return [int(x or 0) for x in found]

    t1, t2, t3, t4, over, m, v, n = sums(words, 8)
    known = {"pairs": discounts(*sums(merged, 4)), "words": discounts(t1, t2, t3, t4), "t1": t1, "t2": t2, "t3": over, "M": m, "V": v, "N": n}
    slices = merged.where("kind = 'pairs'").unionByName(words.where("kind = 'words'")).select("kind", F.col("target").alias("chunk"), "source", "a", "b")
    return rows.groupBy("chunk").cogroup(slices.groupBy("chunk")).applyInArrow(_score(shards, known), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op9_lm_scores(spark, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
