"""Alignment of source lines with Markdown lines, and multiset recall. Everything is keyed by document and stays distributed."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from ..functions import score, text
from ..sources.tables import written

#: Meetings of a source line's token with a Markdown line that are counted together.
HITS = 1_000_000


def exact_match(src: DataFrame, md: DataFrame, texts: bool = True) -> DataFrame:
    """(rel, src_no, md_no, src, md): the k-th copy of a line meets the k-th; the other side is null where there is none.

    Both sides go through one exchange by document and line digest; only numbers are sorted there, and texts come along only if
    asked for. A group holds the equal lines of one document.
    """
    line = F.col("line") if texts else F.lit(None).cast("string")
    sides = [
        d.select(
            "rel",
            F.unhex(F.md5(F.encode(text.normalize_line("line"), "UTF-8"))).alias("key"),
            F.lit(i).alias("side"),
            F.struct(F.col("n").cast("long").alias("no"), line.alias("line")).alias("at"),
        ) for i, d in enumerate(x.where(F.col("line").rlike(r"(?U)\S")) for x in (src, md))
    ]
    both = sides[0].unionByName(sides[1])
    met = both.groupBy("rel", "key").agg(
        *[F.sort_array(F.collect_list(F.when(F.col("side") == i, F.col("at")))).alias(name) for i, name in enumerate(("s", "m"))]
    )
    rows = met.select("rel", F.inline(F.arrays_zip("s", "m")))
    return rows.select("rel", F.col("s.no").alias("src_no"), F.col("m.no").alias("md_no"), F.col("s.line").alias("src"), F.col("m.line").alias("md"))


def candidates(matched: DataFrame, most: int | None = 30, dice: float = 0.5, stop: bool = True) -> DataFrame:
    """(rel, src_no, md_no, dice) of unmatched lines that share tokens.

    Tokens on more than max(500, half) or 5000 of a document's unmatched Markdown lines do not make candidates, which bounds the
    join by the stop rule; overlaps count the other tokens, sizes count all. The `most` highest overlaps of a source line count,
    those under `dice` included, ties to the smaller md_no. Without `stop` every token counts, and with `most` None every pair of this dice.

    A pair of this dice shares at least need = dice * n_src / (2 - dice) tokens, since n_md is no less than what is shared; so does
    every pair that ranks before it. Open lines go through one exchange by document; a task walks through its documents and counts, for
    some source lines at a time, what they share with the lines that hold their tokens.
    """
    alone = matched.where(F.col("rel").isNotNull() & (F.col("src_no").isNull() != F.col("md_no").isNull()))
    of_src = F.col("md_no").isNull()
    lines = alone.select("rel", of_src.alias("of_src"), F.coalesce("src_no", "md_no").cast("long").alias("no"), F.when(of_src, F.col("src")).otherwise(F.col("md")).alias("line"))
    by_document = lines.repartition("rel").sortWithinPartitions("rel")
    tokens = by_document.select("rel", "of_src", "no", F.array_distinct(text.word_tokens("line")).alias("toks"))

    def met(batches):
        for rows in _whole_documents(batches):
            yield from _similar(rows, most, dice, stop)

    return tokens.mapInArrow(met, "rel string, src_no long, md_no long, dice double")


def _whole_documents(batches):
    """Tables of rows that come sorted by rel, cut where a document ends."""
    open_ = []
    for batch in (b for b in batches if b.num_rows):
        rel = batch.column("rel")
        if open_ and open_[-1].column("rel")[-1] != rel[0]:
            yield pa.Table.from_batches(open_)
            open_ = []
        ends = np.flatnonzero(np.asarray(pc.not_equal(rel[1:], rel[:-1]))) + 1
        if len(ends):
            yield pa.Table.from_batches([*open_, batch.slice(0, ends[-1])])
            open_, batch = [], batch.slice(ends[-1])
        open_.append(batch)
    if open_:
        yield pa.Table.from_batches(open_)


def _similar(rows: pa.Table, most: int | None, dice: float, stop: bool = True):
    """candidates() of whole documents (rel, of_src, no, toks), as record batches."""
    rows = rows.combine_chunks()
    rel, of_src, no = rows.column("rel"), rows.column("of_src").to_numpy(), rows.column("no").to_numpy()
    doc = rel.combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
    size = pc.list_value_length(rows.column("toks")).to_numpy().astype(np.int64)
    word = pc.list_flatten(rows.column("toks")).combine_chunks().dictionary_encode()
    line, width = np.repeat(np.arange(len(no)), size), len(word.dictionary) + 1
    known, tok = np.unique(doc[line] * width + word.indices.to_numpy(), return_inverse=True)  # a document's tokens

    right = ~of_src[line]
    df = np.bincount(tok[right], minlength=len(known))
    use = df > 0
    if stop:
        use &= df <= np.minimum(np.maximum(500, np.bincount(doc[~of_src], minlength=doc.max() + 1) // 2), 5000)[known // width]
    first = np.cumsum(df) - df
    held = line[right][np.argsort(tok[right], kind="stable")]  # lines of Markdown by token
    asked = ~right & use[tok]
    asks, wants = line[asked], tok[asked]  # by source line, since lines are in order
    need = np.maximum(1, np.ceil(dice * size / (2 - dice) - 1e-9))

    upto, begin = np.cumsum(df[wants]), 0
    while begin < len(asks):
        # as many source lines as have HITS together, one at least
        end = np.searchsorted(upto, (upto[begin - 1] if begin else 0) + HITS, side="right")
        end = max(np.searchsorted(asks, asks[end]) if end < len(asks) else end, np.searchsorted(asks, asks[begin], side="right"))
        n = df[wants[begin:end]]
        at = np.repeat(first[wants[begin:end]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        low, high = asks[begin], asks[end - 1]
        pair = np.repeat(asks[begin:end] - low, n) * len(no) + held[at]
        if (high - low + 1) * len(no) <= 4 * len(pair):
            count = np.bincount(pair)
            pair = np.flatnonzero(count)
            overlap = count[pair]
        else:
            pair, overlap = np.unique(pair, return_counts=True)
        begin, i, j = end, pair // len(no) + low, pair % len(no)
        i, j, overlap = (x[overlap >= need[i]] for x in (i, j, overlap))
        if most is not None:
            order = np.lexsort((no[j], -overlap, i))
            i, j, overlap = i[order], j[order], overlap[order]
            first_of = np.arange(len(i)) - np.searchsorted(i, i) < most
            i, j, overlap = i[first_of], j[first_of], overlap[first_of]
        likeness = 2.0 * overlap / (size[i] + size[j])
        kept = likeness >= dice
        i, j = i[kept], j[kept]
        yield pa.RecordBatch.from_arrays(
            [rel.take(pa.array(i)).combine_chunks(), pa.array(no[i]), pa.array(no[j]), pa.array(likeness[kept])], names=["rel", "src_no", "md_no", "dice"]
        )


def assign(pairs: DataFrame) -> DataFrame:
    """One-to-one, greedily from the highest (dice, src_no, md_no) down; sees only surviving candidates.

    Candidates come sorted by document; a task walks through many documents and holds the lines that one of them has used up.
    """

    def greedy(batches):
        rel, left, right = None, set(), set()
        for batch in batches:
            kept = []
            for k, (doc, i, j) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("rel", "src_no", "md_no")), strict=True)):
                if doc != rel:
                    rel, left, right = doc, set(), set()
                if i not in left and j not in right:
                    left.add(i)
                    right.add(j)
                    kept.append(k)
            yield batch.select(["rel", "src_no", "md_no"]).take(pa.array(kept, pa.int64()))

    by_rank = pairs.repartition("rel").sortWithinPartitions("rel", F.desc("dice"), F.desc("src_no"), F.desc("md_no"))
    return by_rank.select("rel", "src_no", "md_no", "dice").mapInArrow(greedy, "rel string, src_no long, md_no long")


def segments(matched: DataFrame, changed: DataFrame) -> DataFrame:
    """Statuses in reading order (W2, O1): Markdown-only lines first by anchor, then source order."""
    c = changed.select("rel", "src_no", F.col("md_no").alias("pair"))
    src = matched.where("src_no IS NOT NULL").join(c, ["rel", "src_no"], "left")
    md_text = matched.where("md_no IS NOT NULL AND src_no IS NULL").select("rel", F.col("md_no").alias("pair"), F.col("md").alias("pair_md"))
    src = src.join(md_text, ["rel", "pair"], "left").select(
        "rel",
        "src_no",
        F.coalesce("md_no", "pair").alias("md_no"),
        "src",
        F.coalesce("md", "pair_md").alias("md"),
        F.when(F.col("md_no").isNotNull(), "match").when(F.col("pair").isNotNull(), "changed").otherwise("src_only").alias("status"),
        F.lit(None).cast("long").alias("anchor"),
    )
    order = Window.partitionBy("rel").orderBy("md_no").rowsBetween(Window.unboundedPreceding, -1)
    md = matched.where("md_no IS NOT NULL").withColumn("anchor", F.coalesce(F.last("src_no", ignorenulls=True).over(order), F.lit(-1)).cast("long"))
    md = md.where("src_no IS NULL").join(c.select("rel", F.col("pair").alias("md_no")), ["rel", "md_no"], "left_anti")
    both = src.unionByName(
        md.select(
            "rel", F.lit(None).cast("long").alias("src_no"), F.col("md_no").cast("long").alias("md_no"), "src", "md",
            F.lit("md_only").alias("status"), "anchor",
        )
    )
    seq = Window.partitionBy("rel").orderBy(F.col("status") != "md_only", F.coalesce("anchor", "src_no"), "md_no")
    return both.withColumn("seq", F.row_number().over(seq) - 1).drop("anchor")


def _found(src: DataFrame, md: DataFrame, texts: bool) -> DataFrame:
    """The match, written once, since candidates and order both read it; without `texts` lines that match leave theirs out."""
    found, kept = exact_match(src, md), F.lit(texts) | F.col("src_no").isNull() | F.col("md_no").isNull()
    return written(found.select("rel", "src_no", "md_no", *[F.when(kept, F.col(c)).alias(c) for c in ("src", "md")]))


def align(src: DataFrame, md: DataFrame, texts: bool = True) -> DataFrame:
    """Segments of every document."""
    found = _found(src, md, texts)
    return segments(found, assign(candidates(found)))


def segment_counts(src: DataFrame, md: DataFrame) -> DataFrame:
    """A1 without an order: (rel, n_match, n_src_only, n_md_only, n_changed, line_match_ratio). Changed lines are paired among all that are
    alike: no token is left out for standing on many lines, no pair for standing behind others."""
    found = _found(src, md, False)
    open_ = F.col("src_no").isNull() | F.col("md_no").isNull()
    both = found.groupBy("rel").agg(
        F.count_if(~open_).alias("n_match"),
        F.count_if(F.col("md_no").isNull()).alias("s"),
        F.count_if(F.col("src_no").isNull()).alias("m"),
    )
    pairs = assign(candidates(found, most=None, stop=False)).groupBy("rel").agg(F.count(F.lit(1)).alias("c"))
    c = F.coalesce("c", F.lit(0))
    return both.join(pairs, "rel", "left").select(
        "rel",
        "n_match",
        (F.col("s") - c).alias("n_src_only"),
        (F.col("m") - c).alias("n_md_only"),
        c.alias("n_changed"),
        (F.col("n_match") / F.nullif(F.col("n_match") + F.col("s"), F.lit(0))).alias("line_match_ratio"),
    )


def counted(texts: DataFrame, a: Column, b: Column, key: str = "rel") -> DataFrame:
    """(key, token, n, m): how often a token stands in a and in b, in all rows of a key; counts combine before the shuffle. What has no key
    meets nothing."""
    side = lambda tokens, n, m: F.transform(tokens, lambda t: F.struct(t.alias("token"), F.lit(n).alias("n"), m.alias("m")))
    meets = F.col(key).isNotNull().cast("int")
    both = texts.select(key, F.inline(F.concat(side(a, 1, F.lit(0)), side(b, 0, meets))))
    return both.groupBy(key, "token").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def recall(tokens: DataFrame, key: str = "rel") -> DataFrame:
    """Share of a's tokens (key, token, n, m) that b has too; keys without tokens in a are absent (does not apply)."""
    return tokens.where("n > 0").groupBy(key).agg((F.sum(F.least("n", "m")) / F.sum("n")).alias("recall"))


@F.pandas_udf(LongType())
def _lost(a: pd.Series, b: pd.Series) -> pd.Series:
    """How many tokens of a are not in b, repeats counted; null where a is."""

    def one(x, y):
        there = Counter(y)
        return sum(n - min(n, there.get(t, 0)) for t, n in Counter(x).items())

    return pd.Series([None if x is None else one(x, y) for x, y in zip(a, b, strict=True)], dtype="Int64")


@F.pandas_udf(ArrayType(StructType([StructField("token", StringType()), StructField("missing", LongType())])))
def lost_tokens(a: pd.Series, b: pd.Series) -> pd.Series:
    """The tokens of a that b has less often, and how much less; null where a is."""

    def one(x, y):
        return [{"token": t, "missing": n} for t, n in (Counter(x) - Counter(y)).items()]

    return pd.Series([None if x is None else one(x, y) for x, y in zip(a, b, strict=True)], dtype="object")


def _differing(a: Column, b: Column, lost) -> Column:
    """lost(a, b) of lists that differ; lists that are equal never leave the JVM."""
    return lost(F.when(a != b, a), F.when(a != b, b))


def _by_key(texts: DataFrame, key: str = "rel") -> tuple[DataFrame, DataFrame]:
    """Rows whose key no other row has, to be counted as they stand, and the rest: keys of several rows, and null. Only keys are shuffled."""
    again = written(texts.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col(key).isNull() | (F.col("__n") > 1)).select(F.col(key).alias("__key")))
    same = texts[key].eqNullSafe(again["__key"])
    return texts.join(again, same, "left_anti"), texts.join(again, same, "left_semi")


def _share(a: str, b: str) -> Column:
    """Share of list a that b has too, repeats counted; null where a has nothing."""
    size = F.size(a)
    return (size - F.coalesce(_differing(F.col(a), F.col(b), _lost), F.lit(0))) / F.nullif(size, F.lit(0))


def _present(rows: DataFrame, c: str) -> DataFrame:
    """Rows whose c is not null. A filter would be pushed below the tokens, which would then be found twice."""
    return rows.withColumn(c, F.explode(F.when(F.col(c).isNotNull(), F.array(c))))


def recall_of(texts: DataFrame, a: Column, b: Column, key: str = "rel") -> DataFrame:
    """J4 of texts that stand side by side, with the same rows: tokens a and b of a row are counted in the row, without a shuffle of tokens."""
    alone, rest = _by_key(texts, key)
    rows = alone.select(key, a.alias("__a"), b.alias("__b"))
    own = _present(rows.select(key, _share("__a", "__b").alias("recall")), "recall")
    return own.unionByName(recall(counted(rest, a, b, key), key))


def missing_tokens(texts: DataFrame, a: Column, b: Column, key: str = "rel") -> DataFrame:
    """(key, token, missing): tokens that stand more often in a than in b."""
    alone, rest = _by_key(texts, key)
    rows = alone.select(key, a.alias("__a"), b.alias("__b"))
    own = rows.select(key, F.inline(_differing(F.col("__a"), F.col("__b"), lost_tokens)))
    return own.unionByName(counted(rest, a, b, key).where("n > m").select(key, "token", (F.col("n") - F.col("m")).alias("missing")))


def common_tokens(texts: DataFrame, a: Column, b: Column, key: str = "rel") -> DataFrame:
    """(key, common): how many tokens a and b share, repeats counted; keys that share none are absent."""
    alone, rest = _by_key(texts, key)
    rows = alone.select(key, a.alias("__a"), b.alias("__b"))
    kept = F.size("__a").cast("long") - F.coalesce(_differing(F.col("__a"), F.col("__b"), _lost), F.lit(0))
    own = _present(rows.select(key, F.nullif(kept, F.lit(0).cast("long")).alias("common")), "common")
    both = counted(rest, a, b, key).where("n > 0 AND m > 0")
    return own.unionByName(both.groupBy(key).agg(F.sum(F.least("n", "m")).alias("common")))


def evaluate(pairs: DataFrame) -> DataFrame:
    """J5 without alignment: (rel, src_text, md_text) to coverage, number_recall, auto_score and counts."""
    sides = {name: (tokens("src_text"), tokens("md_text")) for name, tokens in (("coverage", text.word_tokens), ("number_recall", text.extract_numbers))}
    alone, rest = _by_key(pairs)
    size = [text.count_text(f"{side}_text")["words"].alias(f"{side}_words") for side in ("src", "md")]
    rows = alone.select("rel", *size, *[c.alias(f"__{name}_{i}") for name, both in sides.items() for i, c in enumerate(both)])
    own = rows.select("rel", "src_words", "md_words", *[_share(f"__{name}_0", f"__{name}_1").alias(name) for name in sides])
    out = rest.select("rel", *size)
    for name, (a, b) in sides.items():
        out = out.join(recall(counted(rest, a, b)).withColumnRenamed("recall", name), "rel", "left")
    return own.unionByName(out).withColumn("auto_score", score.auto_score(F.col("coverage"), F.col("number_recall")))
