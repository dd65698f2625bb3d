"""Token counts with a whole-token shortcut.

Offline, on the driver: every vocabulary string that is one pre-token is encoded alone; those that give exactly one token form
the shortcut set (bounded by the vocabulary). In the workers a text falls into pieces before its spaces, a piece into pre-tokens;
those in the set count 1, any other pre-token is merged (by the vocabulary's ranks, which must agree with the library). What pieces cost
is remembered (`memory` strings, then started anew). Pieces with characters on which regex engines may differ go to the library whole, and so do texts with
an added token's string, so counts are the library's for every text.
Nothing is shuffled; a batch of Arrow rows is all that a worker holds.

Defined cases: null and empty texts have 0 bytes and 0 tokens; repeated rows are counted one by one; other columns are not read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

LIMIT = 1024
MEMORY = 1_000_000

# The pre-token pattern of the byte-level vocabulary, as its file's pre-tokenizer applies it.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Characters on whose classes all regex engines agree; pieces with others go to the library whole.
_AGREED = r"\t\n\r -~¡-¬®-ɏΆ-ϿЀ-ӿ‐-‧‰-⁞€ぁ-ゖァ-ヺ一-龥"
PLAIN, ODD = f"[{_AGREED}]*", f"[^{_AGREED}]"


def byte_letters() -> dict[str, int]:
    """The usual printable stand-ins of byte-level vocabularies: printable Latin-1 stands for itself, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def whole_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings that are a single pre-token and encode alone as one token, proved with the library."""
    from tokenizers import Tokenizer

    library, letters, pattern = Tokenizer.from_file(path), byte_letters(), regex.compile(PRE_TOKEN)
    with open(path, encoding="utf-8") as file:
        added = {t["content"] for t in json.load(file).get("added_tokens", [])}
    found = []
    for entry in library.get_vocab():
        if entry in added or any(c not in letters for c in entry):
            continue
        try:
            text = bytes(letters[c] for c in entry).decode()
        except UnicodeDecodeError:
            continue
        if pattern.fullmatch(text) and pattern.findall(text) == [text]:
            found.append(text)
    return frozenset(t for t, e in zip(found, library.encode_batch(found, add_special_tokens=False), strict=True) if len(e.ids) == 1)


def merger(path: str, singles) -> Callable[[str], list[int]] | None:
    """The merges of the file on single pre-tokens, without the library's cost a call; None where vocabulary ranks don't order them as the library does."""
    import tiktoken

    letters = byte_letters()
    with open(path, encoding="utf-8") as file:
        ranks = {bytes(letters[c] for c in entry): i for entry, i in json.load(file)["model"]["vocab"].items() if all(c in letters for c in entry)}
    if any(bytes([b]) not in ranks for b in range(256)):
        return None
    plain = tiktoken.Encoding("vocabulary", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return plain if all(len(plain(t)) == 1 for t in singles) else None


def _spans(chars: list[str]) -> str:
    """A character class of ascending characters."""
    ends = [i for i, c in enumerate(chars) if i + 1 == len(chars) or ord(chars[i + 1]) != ord(c) + 1]
    return "".join(f"{re.escape(chars[a])}-{re.escape(chars[b])}" for a, b in zip([0, *(i + 1 for i in ends[:-1])], ends, strict=True))


def plain_split() -> Callable[[str], list[str]]:
    """PRE_TOKEN for texts of PLAIN characters, with their letters and numbers spelt out: several times faster in the standard library."""
    chars = [c for c in map(chr, range(0x3100, 0xA000)) if re.fullmatch(PLAIN, c)]
    chars = [c for c in map(chr, range(0x3100)) if re.fullmatch(PLAIN, c)] + chars
    letter, number = (_spans([c for c in chars if regex.fullmatch(kind, c)]) for kind in (r"\p{L}", r"\p{N}"))
    return re.compile(PRE_TOKEN.replace(r"[^\s\p{L}\p{N}]", f"[^\\s{letter}{number}]").replace(r"\p{L}", f"[{letter}]").replace(r"\p{N}", f"[{number}]")).findall


class Counter:
    """Counts the tokens of texts; built once in a worker.

    A pre-token ends before every space that a plain character follows (a space joins the white space before it or what stands
    after it), so a text falls apart there into pieces that count alone. What a piece costs is remembered.
    """

    def __init__(self, path: str, singles, memory: int = MEMORY):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as file:
            self.special = [t["content"] for t in json.load(file).get("added_tokens", [])]
        self.merge = merger(path, singles)
        self.split, self.plain = plain_split(), re.compile(PLAIN).fullmatch
        self.singles = singles
        self.after_space = [t[1:] for t in singles if t[0] == " " and len(t) > 1]
        self.spaced = dict.fromkeys(self.after_space, 1)  # pieces without the space before them
        self.room = len(self.spaced) + memory

    def library_ids(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def whole(self, text: str) -> int:
        return len(self.library_ids(text))

    def cost(self, piece: str, odd: bool = True) -> int:
        """Tokens of a piece: proved pre-tokens count 1, the rest is merged."""
        if odd and not self.plain(piece):
            return self.whole(piece)
        singles, merge, parts = self.singles, self.merge or self.library_ids, self.split(piece)
        return len(merge(piece)) if len(parts) == 1 else sum([1 if p in singles else len(merge(p)) for p in parts])

    def count(self, text: str, odd: bool = True) -> int:
        """odd: whether the text may hold characters outside PLAIN."""
        if not text:
            return 0
        if any(s in text for s in self.special):
            return self.whole(text)
        pieces = text.split(" ")
        if "  " in text or " \n" in text or " \t" in text or " \r" in text or text[-1] == " " or (odd and not self.plain(text)):
            pieces = self.joined(pieces)
        first = self.cost(pieces[0], odd) if pieces[0] else 0
        spaced, rest = self.spaced, pieces[1:]
        try:
            return first + sum(map(spaced.__getitem__, rest))
        except KeyError:
            pass
        if len(spaced) > self.room:
            spaced = self.spaced = dict.fromkeys(self.after_space, 1)
        for p in rest:
            if p not in spaced:
                spaced[p] = self.cost(" " + p, odd)
        return first + sum(map(spaced.__getitem__, rest))

    def joined(self, pieces: list[str]) -> list[str]:
        """Pieces that begin with white space or an odd character go to the one before them."""
        out = [pieces[0]]
        held = []
        for p in pieces[1:]:
            if not p or p[0].isspace() or not self.plain(p[0]):
                held.append(p)
            else:
                if held:
                    out[-1] = " ".join([out[-1], *held])
                    held = []
                out.append(p)
        if held:
            out[-1] = " ".join([out[-1], *held])
        return out


def count_tokens(spark: SparkSession, docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """docs(doc_id, text) to doc_id, n_bytes, n_tokens, over_limit."""
    singles = spark.sparkContext.broadcast(whole_tokens(path))  # at most the vocabulary

    def counted(batches):
        counter = Counter(path, singles.value)
        for batch in batches:
            odd = pc.fill_null(pc.match_substring_regex(batch.column(1), ODD), False).to_pylist()
            tokens = [counter.count(x.as_py() or "", o) for x, o in zip(batch.column(1), odd, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    n_bytes = F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), n_bytes).mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark, table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")))
