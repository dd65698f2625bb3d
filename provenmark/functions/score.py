"""Column functions for scores, states and decisions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

THRESHOLD = 80.0
# Weights of the checks, and error classes with their needles in order.
WEIGHTS = {"text": 0.40, "numbers": 0.30, "headings": 0.20, "tables": 0.10}
REASONS = (
    ("source_changed", ("SOURCE CHANGED", "does not match the source file's checksum", "source changed")),
    ("resources", ("No space left", "not enough free disk", "MemoryError", "out of memory", "Cannot allocate memory")),
    ("download", ("download", "SSLError", "ConnectionError", "Timeout", "timed out", "Max retries", "RemoteDisconnected", "shared_link", "403", "429", "5xx")),
    ("unreadable", ("MuPDF", "cannot open", "not a PDF", "broken", "damaged", "EOF marker", "Failed to open", "BadZipFile", "format error", "repair")),
)


def auto_score(coverage: Column, numbers: Column) -> Column:
    """Half coverage, half recall of numbers; without numbers coverage counts twice; null where neither applies."""
    c = F.coalesce(coverage, F.lit(0.0))
    return F.when(coverage.isNull() & numbers.isNull(), F.lit(None).cast("double")).otherwise(F.round(100.0 * (0.5 * c + 0.5 * F.coalesce(numbers, c)), 1))


def trust_state(verdict: Column, score: Column, threshold: float = THRESHOLD) -> Column:
    """P25: trusted only if a person said ok and the score reaches the threshold."""
    return (
        F.when(verdict == "rejected", "rejected")
        .when(verdict == "diff_big", "diff_big")
        .when((verdict == "ok") & (score >= threshold), "trusted")
        .when(verdict == "ok", "need_review")
        .otherwise("unreviewed")
    )


def accuracy(parts: dict[str, Column], weights: dict[str, float] = WEIGHTS) -> Column:
    """Weighted mean over the checks that apply, 0 to 100 with one decimal; null if none does."""
    top = sum((F.coalesce(parts[k] * w, F.lit(0.0)) for k, w in weights.items()), F.lit(0.0))
    base = sum((F.when(parts[k].isNotNull(), F.lit(w)).otherwise(0.0) for k, w in weights.items()), F.lit(0.0))
    return F.when(base > 0, F.round(100 * top / base + 1e-9, 1))


def decide(acc: Column, number_diffs: Column, threshold: Column, guard: Column) -> Column:
    """P28."""
    return F.when(acc.isNull() | (guard & (number_diffs > 0)) | (acc < threshold), "below").otherwise("ok")


def reason_code(error: Column) -> Column:
    """First class one of whose needles occurs, whatever the case."""
    low, out = F.lower(F.coalesce(error, F.lit(""))), None
    for code, needles in REASONS:
        hit = F.lit(False)
        for needle in needles:
            hit = hit | F.contains(low, F.lit(needle.lower()))
        out = F.when(hit, code) if out is None else out.when(hit, code)
    return out.otherwise("other")


def size_verdict(src_chars: Column, md_chars: Column, dup: Column) -> Column:
    """P20: what a size ratio says in plain words."""
    ratio = md_chars / F.when(src_chars > 0, src_chars)
    return F.when(src_chars < 60, "source has almost no text").when(ratio < 0.2, "most content missing").when(
        (ratio > 1.8) & (dup > 0),
        "content repeated",
    ).when(ratio > 1.8, "content added").otherwise("sizes agree")


def call_cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """Cost from prices for a million tokens."""
    return (tokens_in * price_in + tokens_out * price_out) / 1_000_000


def question_key(version: Column, kind: Column, model: Column, question: Column) -> Column:
    """P44."""
    return F.sha2(F.concat_ws("\u001f", version, kind, model, question), 256)
