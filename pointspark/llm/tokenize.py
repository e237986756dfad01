"""Encoding of a corpus with a public byte-level BPE vocabulary, exact for texts of any length.

Texts up to LONG_CHARS are encoded whole. Longer ones are cut into pieces that are encoded in parallel, then concatenated
in a tree. At each join the scan of pre-tokens is resumed from the last boundary that the left side fixes, over a
window that grows until it meets a boundary of the right side. Where one unsplit pre-token spans the join, its two
token lists are joined by re-encoding a growing window of tokens around the join until both outer neighbours agree: a
list of tokens is the encoding of its bytes if and only if every adjacent pair encodes to itself.

Defined cases: NULL and empty texts have no ids (an empty list); special-token strings in a text are ordinary text; blank
texts, odd characters and line ends are encoded as they are; repeated rows are each encoded; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import base64
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointspark.session import shuffle_partitions

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-token pattern of the public byte-level vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters that a match may look at beyond its start (contractions) when it fails.
LOOK = 3
LONG_CHARS = 8192
WINDOW_TOKENS = 8


class ByteBPE:
    """A rank file as encoder of texts and of raw byte strings."""

    def __init__(self, path: str) -> None:
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.pattern = regex.compile(PATTERN)

    def encode(self, text: str) -> list[int]:
        return self._own.encode_ordinary(text)

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        return [self._own.encode_ordinary(t) for t in texts]

    def piece(self, raw: bytes) -> list[int]:
        """Merges of one pre-token's bytes."""
        return self._own._encode_single_piece(raw)

    def agree(self, a: int, b: int) -> bool:
        return self.piece(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    def join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        """Encoding of the concatenation of two encoded byte strings that lie in one pre-token."""
        if not left or not right:
            return left + right
        i, j = min(WINDOW_TOKENS, len(left)), min(WINDOW_TOKENS, len(right))
        while True:
            mid = self.piece(b"".join(map(self.bytes_of.__getitem__, left[-i:] + right[:j])))
            ok_left = i == len(left) or self.agree(left[-i - 1], mid[0])
            ok_right = j == len(right) or self.agree(mid[-1], right[j])
            if ok_left and ok_right:
                return left[: len(left) - i] + mid + right[j:]
            if not ok_left:
                i = min(2 * i, len(left))
            if not ok_right:
                j = min(2 * j, len(right))


@lru_cache(maxsize=4)
def load(path: str = VOCABULARY) -> ByteBPE:
    return ByteBPE(path)


class Encoded:
    """A piece of text with its pre-token starts and the tokens of each pre-token."""

    __slots__ = ("text", "starts", "tokens")

    def __init__(self, text: str, starts: list[int], tokens: list[list[int]]) -> None:
        self.text, self.starts, self.tokens = text, starts, tokens

    @classmethod
    def of(cls, bpe: ByteBPE, text: str) -> "Encoded":
        spans = [m.span() for m in bpe.pattern.finditer(text)]
        return cls(text, [a for a, _ in spans], [bpe.piece(text[a:b].encode()) for a, b in spans])

    def ids(self) -> list[int]:
        return [t for group in self.tokens for t in group]


def join(bpe: ByteBPE, a: Encoded, b: Encoded) -> Encoded:
    """Exact encoding of a's text followed by b's."""
    if not a.text or not b.text:
        return b if not a.text else a
    cut = len(a.text)
    first = max(bisect_right(a.starts, max(cut - LOOK, 0)) - 1, 0)
    base = a.starts[first]
    inside = set(b.starts)
    width = 64
    while True:
        whole = width >= len(b.text)
        window = a.text[base:] + b.text[:width]
        spans, met = [], None
        for m in bpe.pattern.finditer(window):
            lo, hi = m.span()
            if not whole and (lo > len(window) - LOOK or hi >= len(window)):
                break
            spans.append((base + lo, base + hi))
            if base + hi >= cut and base + hi - cut in inside:
                met = base + hi - cut
                break
        if met is not None or whole:
            break
        width *= 4
    resume = b.starts.index(met) if met is not None else len(b.starts)
    starts, tokens = a.starts[:first], a.tokens[:first]
    known = dict(zip(a.starts[first:], a.tokens[first:]))
    ends = dict(zip(a.starts[first:], [*a.starts[first + 1 :], cut]))
    head_end = b.starts[1] if len(b.starts) > 1 else len(b.text)
    for lo, hi in spans:
        starts.append(lo)
        if ends.get(lo) == hi:
            tokens.append(known[lo])
        elif ends.get(lo) == cut and hi - cut == head_end:
            tokens.append(bpe.join_tokens(known[lo], b.tokens[0]))
        else:
            tokens.append(bpe.piece((a.text[lo:hi] + b.text[max(lo - cut, 0) : max(hi - cut, 0)]).encode()))
    return Encoded(a.text + b.text, starts + [cut + s for s in b.starts[resume:]], tokens + b.tokens[resume:])


def concatenate(bpe: ByteBPE, parts: list[Encoded]) -> Encoded:
    """Tree of joins over neighbouring parts."""
    while len(parts) > 1:
        parts = [join(bpe, *parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def _encode_long(rows: DataFrame, vocabulary: str, long_chars: int) -> DataFrame:
    """(k, ids) of long texts (k, t): pieces are encoded in parallel, then joined."""
    kind = rows.schema["k"].dataType.simpleString()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for u, k, t in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                s = t.as_py()
                cuts = [s[i : i + long_chars] for i in range(0, len(s), long_chars)]
                for at in range(0, len(cuts), 256):
                    part = cuts[at : at + 256]
                    yield pa.RecordBatch.from_arrays([pa.array([u] * len(part)), pa.array([k.as_py()] * len(part), type=k.type), pa.array(range(at, at + len(part)), type=pa.int32()), pa.array(part)], names=["u", "k", "no", "t"])

    def encode_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for b in batches:
            done = [Encoded.of(bpe, t) for t in b.column(3).to_pylist()]
            extra = [pa.array([e.starts for e in done], type=pa.list_(pa.int32())), pa.array([[len(g) for g in e.tokens] for e in done], type=pa.list_(pa.int32())), pa.array([e.ids() for e in done], type=pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *extra], names=["u", "k", "no", "t", "starts", "sizes", "ids"])

    def tree(t: pa.Table) -> pa.Table:
        bpe = load(vocabulary)
        t = t.sort_by("no")
        parts = []
        for s, starts, sizes, ids in zip(*(t.column(c).to_pylist() for c in ("t", "starts", "sizes", "ids"))):
            at, groups = 0, []
            for n in sizes:
                groups.append(ids[at : at + n])
                at += n
            parts.append(Encoded(s, starts, groups))
        whole = concatenate(bpe, parts)
        return pa.table([t.column("k").slice(0, 1), pa.array([whole.ids()], type=pa.list_(pa.int32()))], names=["k", "ids"])

    long = rows.select(F.monotonically_increasing_id().alias("u"), "k", "t").mapInArrow(pieces, f"u long, k {kind}, no int, t string")
    n = shuffle_partitions(rows.sparkSession)
    coded = long.repartition(n, "u", "no").mapInArrow(encode_pieces, f"u long, k {kind}, no int, t string, starts array<int>, sizes array<int>, ids array<int>")
    return coded.groupBy("u").applyInArrow(tree, f"k {kind}, ids array<int>")


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, long_chars: int = LONG_CHARS) -> DataFrame:
    """(key, ids): the token ids of every row's text."""
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = rows.schema["k"].dataType.simpleString()
    length = F.coalesce(F.length("t"), F.lit(0))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for b in batches:
            ids = bpe.encode_all([t or "" for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, type=pa.list_(pa.int32()))], names=["k", "ids"])

    done = rows.where(length <= long_chars).mapInArrow(short, f"k {kind}, ids array<int>")
    return done.union(_encode_long(rows.where(length > long_chars), vocabulary, long_chars)).withColumnRenamed("k", key)


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: list[str] | None = None, vocabulary: str = VOCABULARY, long_chars: int = LONG_CHARS) -> DataFrame:
    """(key, carried columns, n): the number of tokens of every row's text; the ids of short ones never leave the task, long ones are encoded by the tree."""
    extra = carry or []
    length = F.coalesce(F.length(text), F.lit(0))
    long = _encode_long(docs.where(length > long_chars).select(F.struct(F.col(key).alias("k"), *extra).alias("k"), F.col(text).alias("t")), vocabulary, long_chars)
    rows = docs.where(length <= long_chars).select(F.col(key).alias("k"), *extra, F.col(text).alias("t"))
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ["k", *extra])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for b in batches:
            n = [len(bpe.encode(t)) if t else 0 for t in b.column(len(extra) + 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, type=pa.int64())], names=["k", *extra, "n"])

    counted = rows.mapInArrow(count, f"{kinds}, n long").union(long.select("k.*", F.size("ids").cast("long").alias("n")))
    return counted.withColumnRenamed("k", key)
