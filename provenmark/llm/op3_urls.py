"""URL filters by a sorted digest array.

The rule list becomes one file: sorted 64-bit xxhash keys, offsets and the full rule strings. Spark ships the file to every
executor, workers memory-map it, and each batch of urls is probed with one vectorised binary search over all its candidate keys
(host suffixes with the path prefixes whose lengths occur among the rules). A hit counts only if the stored string is equal, so
collisions change nothing. Nothing is shuffled. The file is as large as the rule list, whose length must stay under `max_rules`.

Defined cases: a null url, or one without `://`, has an empty host and path, fits no rule and gets the default verdict; an
empty table gives an empty result; repeated rows are judged one by one; other columns are never read.
"""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# The rules of the registered query.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
DEFAULT = "allow"
MAX_RULES = 50_000_000


def write_index(rules, path: str, max_rules: int = MAX_RULES) -> None:
    """Header (count, string bytes, number of path lengths), keys, offsets, verdicts, path lengths, strings; keys ascending."""
    rules = sorted({r: v for r, v in rules}.items(), key=lambda x: (xxhash.xxh64_intdigest(x[0].encode()), x[0]))
    if len(rules) > max_rules:
        raise ValueError(f"{len(rules)} rules; at most {max_rules} are mapped by each worker")
    texts = [r.encode() for r, _ in rules]
    lengths = np.array(sorted({len(r[r.index("/") :].encode()) for r, _ in rules}), dtype="<i8")
    keys = np.array([xxhash.xxh64_intdigest(t) for t in texts], dtype="<u8")
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype("<i8")
    allow = np.array([v == "allow" for _, v in rules], dtype="<i8")
    with open(path, "wb") as out:
        out.write(np.array([len(keys), offsets[-1], len(lengths)], dtype="<i8").tobytes())
        for part in (keys, offsets, allow, lengths):
            out.write(part.tobytes())
        out.write(b"".join(texts))


class Index:
    """A mapped index file."""

    def __init__(self, path: str):
        n, size, kinds = np.memmap(path, "<i8", "r", shape=(3,))
        at = 24
        parts = []
        for kind, count in (("<u8", n), ("<i8", n + 1), ("<i8", n), ("<i8", kinds)):
            parts.append(np.memmap(path, kind, "r", at, (int(count),)) if count else np.zeros(0, kind))
            at += 8 * int(count)
        self.keys, self.offsets, self.allow, self.lengths = parts
        self.text = np.memmap(path, "u1", "r", at, (int(size),)) if size else np.zeros(0, "u1")

    def find(self, wanted: list[bytes]) -> np.ndarray:
        """Places of the wanted strings, -1 where there is none."""
        if not wanted or not len(self.keys):
            return np.full(len(wanted), -1)
        keys = np.fromiter((xxhash.xxh64_intdigest(w) for w in wanted), "<u8", len(wanted))
        at = np.searchsorted(self.keys, keys)
        found = np.full(len(wanted), -1)
        for i in np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == keys):
            k = int(at[i])
            while k < len(self.keys) and self.keys[k] == keys[i]:
                if self.text[self.offsets[k] : self.offsets[k + 1]].tobytes() == wanted[i]:
                    found[i] = k
                    break
                k += 1
        return found


def split_url(url: str | None) -> tuple[str, str]:
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    end = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    tail = rest[end:]
    return host, tail[: next((i for i, c in enumerate(tail) if c in "?#"), len(tail))]


def judge_batch(index: Index, urls: list, default: str) -> tuple[list, list, list, list]:
    parts = [split_url(u) for u in urls]
    owner, wanted = [], []
    for i, (host, path) in enumerate(parts):
        if not path:
            continue
        raw, labels = path.encode(), host.split(".")
        for k in range(len(labels)):
            suffix = ".".join(labels[k:]).encode()
            for n in index.lengths:
                if n <= len(raw):
                    owner.append(i)
                    wanted.append(suffix + raw[:n])
    best = [(-1, 0, -1)] * len(urls)
    for j, k in enumerate(index.find(wanted)):
        if k >= 0:
            best[owner[j]] = max(best[owner[j]], (len(wanted[j]), wanted[j].find(b"/"), int(k)))
    rule = [index.text[index.offsets[k] : index.offsets[k + 1]].tobytes().decode() if k >= 0 else None for *_, k in best]
    verdict = [("allow" if index.allow[k] else "block") if k >= 0 else default for *_, k in best]
    return [h for h, _ in parts], [p for _, p in parts], rule, verdict


def filter_urls(spark: SparkSession, pages: DataFrame, rules=RULES, default: str = DEFAULT) -> DataFrame:
    """pages(page_id, url) to page_id, host, path, rule, verdict."""
    name = f"urls-{uuid.uuid4().hex}.idx"
    folder = tempfile.mkdtemp(prefix="provenmark-")
    write_index(rules, os.path.join(folder, name))
    spark.sparkContext.addFile(os.path.join(folder, name))  # Spark's file server copies it to each executor

    def judged(batches):
        index = Index(SparkFiles.get(name))
        for batch in batches:
            host, path, rule, verdict = judge_batch(index, batch.column(1).to_pylist(), default)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.string()) for x in (host, path, rule, verdict))], ["page_id", "host", "path", "rule", "verdict"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string")).mapInArrow(judged, "page_id long, host string, path string, rule string, verdict string")


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    return filter_urls(spark, table(spark, sf_dir, "pages"))


ORACLE = r"""
WITH p AS (SELECT page_id, url, CASE WHEN url IS NOT NULL AND contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM p),
r AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM q),
k(rule, verdict) AS (VALUES ('net/', 'block'), ('example.net/en/', 'allow'), ('example.com/de/', 'block'), ('org/fr/', 'allow')),
m AS (SELECT page_id, rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC) AS n FROM r, k
      WHERE ends_with('.' || host, '.' || regexp_extract(rule, '^[^/]*')) AND starts_with(path, substr(rule, strpos(rule, '/'))))
SELECT r.page_id, r.host, r.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM r LEFT JOIN m ON r.page_id = m.page_id AND m.n = 1
"""
