"""Token counts of a tokenizer file, without materialising ids.

A text's count is the sum over its pre-tokens of the pieces each splits into.

1. One pass over all texts gives the distinct pre-tokens and how often they
   occur; of each distinct one the pieces are counted once, which makes a table.
2. A second pass gives each document's pre-token frequencies. The most frequent
   pre-tokens, at most ``HEAD``, are joined as a table that every task holds;
   what is left, rare pre-tokens, is joined by a shuffle, so no more than a
   small part of the frequencies moves, and no table grows in a task.

Texts are split in numpy by the library's one public pattern. A tokenizer file
with another way to split has whole texts for pre-tokens, which the library
counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._draw import most_frequent
from ._store import cut
from ._text import blocks, span_hash

#: Pre-tokens that reach every task as a table.
HEAD = 500_000
#: Distinct pre-tokens a task holds before it passes them on.
HELD = 1_000_000
#: Tokens above which a document is over the limit.
LIMIT = 1024

_SPACE, _LETTER, _NUMBER, _OTHER = range(4)
#: What follows an apostrophe in a pre-token of its own (fixed values of the pattern).
_SHORT, _LONG = "stmd", ("re", "ve", "ll")


@cache
def _kinds() -> np.ndarray:
    """Of each code point whether the pattern takes it for white space, a letter, a number or another sign, in the library's version of Unicode."""
    import regex
    from tokenizers.pre_tokenizers import ByteLevel

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.full(0x110000, _OTHER, np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            out[[ord(c) for c in m.group()]] = kind
    split = ByteLevel(add_prefix_space=False)
    for kind, before in ((_LETTER, "a"), (_NUMBER, "1")):
        some = np.flatnonzero(out == kind)  # those that the library parts from one before are not of its kind
        starts = np.array([a for _, (a, _) in split.pre_tokenize_str("".join(f"{before}{chr(c)}\n" for c in some))])
        out[some[starts[starts % 3 == 1] // 3]] = _OTHER
    return out


def pre_tokens(raw: np.ndarray, at: np.ndarray, special: re.Pattern | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first byte, last byte + 1) of the pre-tokens of the texts ``raw[at[i]:at[i + 1]]``, and each text's special strings."""
    n_special = np.zeros(len(at) - 1, np.int64)
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), n_special
    if (raw >= 128).any():
        place = np.flatnonzero((raw & 0xC0) != 0x80)
        code = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
    else:
        place, code = np.arange(len(raw)), raw
    n, kind = len(code), _kinds()[code]
    edges, holes = at, []
    if special is not None:
        data, pos = raw.tobytes(), 0
        while m := special.search(data, pos):
            d = int(np.searchsorted(at, m.start(), "right")) - 1
            if m.end() > at[d + 1]:  # begins in one text and ends in the next
                pos = m.start() + 1
                continue
            holes.append(m.span())
            n_special[d] += 1
            pos = m.end()
        edges = np.union1d(at, np.array(holes, np.int64).ravel()) if holes else at
    edge = np.zeros(n + 1, bool)
    edge[np.searchsorted(place, edges)] = True
    edge[n] = True
    start = edge[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    # A run of white space before a sign leaves its last character apart, which a sign takes if it is a space.
    i = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & ~edge[1:n]) + 1
    start[i - 1] = True
    start[i[code[i - 1] == 32]] = False
    # An apostrophe that no other sign or space precedes, and certain letters after it.
    a = np.flatnonzero((code == 39) & start)
    a = a[~edge[a + 1]]
    one = a[np.isin(code[a + 1], [ord(c) for c in _SHORT])]
    b = a[a + 2 < n]
    b = b[~edge[b + 2]]
    two = [b[(code[b + 1] == ord(x)) & (code[b + 2] == ord(y))] for x, y in _LONG]
    for first, size in ((one, 1), *((x, 2) for x in two)):
        start[first + 1] = False
        after = first + 1 + size
        start[after[after < n]] = True
    begin = place[start]
    end = np.append(begin[1:], len(raw))
    if holes:
        lo, hi = np.array(holes).T
        k = np.searchsorted(lo, begin, "right") - 1
        keep = (k < 0) | (begin >= hi[k])
        begin, end = begin[keep], end[keep]
    return np.searchsorted(at, begin, "right") - 1, begin, end, n_special


class PieceCounter:
    """Counts pieces for one tokenizer file."""

    def __init__(self, path: str):
        if path.endswith(".json"):
            import json
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(path)
            self.tokenizer.no_truncation()
            self.tokenizer.no_padding()
            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            added = [x["content"] for x in spec.get("added_tokens", [])]
            plain = not any(x.get(k) for x in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized"))
            pre = spec.get("pre_tokenizer") or {}
            #: Whether the pre-tokens of the library are those of its one public pattern.
            self.splits = plain and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and spec.get("normalizer") is None
            self.special = re.compile(b"|".join(re.escape(x.encode()) for x in sorted(added, key=len, reverse=True))) if added else None
        else:
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.tokenizer, self.splits, self.special = None, False, None

    def pieces(self, distinct: list[str]) -> np.ndarray:
        """The number of pieces of each pre-token."""
        at = self.tokenizer.encode(distinct, is_pretokenized=True, add_special_tokens=False).word_ids
        return np.bincount(at, minlength=len(distinct))

    def whole(self, texts: list[str]) -> list[int]:
        """The number of tokens of each whole text."""
        if self.tokenizer is None:
            return [len(ids) for ids in self.model.encode(texts, num_threads=1)]
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


@cache
def _counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def _at(tokenizer: str) -> str:
    import os

    import public_tokenizers

    return tokenizer if os.path.sep in tokenizer else str(public_tokenizers.path(tokenizer))


def _hashes(counter: PieceCounter, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    doc, begin, end, n_special = pre_tokens(raw, at, counter.special)
    return doc, begin, end, span_hash(raw, begin, end), n_special


def distinct_pre_tokens(docs: DataFrame, tokenizer: str) -> DataFrame:
    """hash, token and n (occurrences) of every pre-token of the column ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(_at(tokenizer))
        known, count, tokens = np.zeros(0, np.uint64), np.zeros(0, np.int64), pa.array([], pa.string())

        def rows() -> Iterator[pa.RecordBatch]:
            for lo in range(0, len(known), 1 << 16):
                k = slice(lo, lo + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(known[k].view(np.int64)), tokens.slice(lo, 1 << 16), pa.array(count[k])], ["hash", "token", "n"])

        for batch in batches:
            for _, _, raw, at in blocks(batch.column(0)):
                _, begin, end, h, _ = _hashes(counter, raw, at)
                h, first, n = np.unique(h, return_index=True, return_counts=True)
                place = np.searchsorted(known, h)
                old = (place < len(known)) & (known[np.minimum(place, len(known) - 1)] == h) if len(known) else np.zeros(len(h), bool)
                count[place[old]] += n[old]
                new, to = first[~old], place[~old]
                if len(new):
                    some = pa.array([raw[a:b].tobytes().decode() for a, b in zip(begin[new], end[new], strict=True)], pa.string())
                    order = np.insert(np.arange(len(known)), to, len(known) + np.arange(len(new)))
                    tokens = pa.concat_arrays([tokens, some]).take(pa.array(order))
                    known, count = np.insert(known, to, h[~old]), np.insert(count, to, n[~old])
                if len(known) > HELD:
                    yield from rows()
                    known, count, tokens = known[:0], count[:0], tokens[:0]
        yield from rows()

    return docs.select("text").mapInArrow(run, "hash long, token string, n long").groupBy("hash", "token").agg(F.sum("n").alias("n"))


def counted_pieces(distinct: DataFrame, tokenizer: str) -> DataFrame:
    """hash, n and pieces of distinct pre-tokens, each counted once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(_at(tokenizer))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counter.pieces(batch.column(1).to_pylist()), pa.int32())], ["hash", "n", "pieces"])

    return distinct.mapInArrow(run, "hash long, n long, pieces int")


def _frequencies(tokenizer: str, key: np.ndarray, pieces: np.ndarray):
    """Of each document its bytes, the tokens of pre-tokens in ``key`` and of special strings, and the frequencies of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(_at(tokenizer))
        for batch in batches:
            for lo, hi, raw, at in blocks(batch.column(1)):
                m = hi - lo
                doc, _, _, h, tokens = _hashes(counter, raw, at)
                h, which = np.unique(h, return_inverse=True)
                pair, times = np.unique(doc * max(1, len(h)) + which, return_counts=True)
                doc, which = np.divmod(pair, max(1, len(h)))
                place = np.minimum(np.searchsorted(key, h), max(0, len(key) - 1))
                common = key[place] == h if len(key) else np.zeros(len(h), bool)
                each = np.where(common, pieces[place], 0) if len(key) else np.zeros(len(h), np.int64)
                tokens = tokens + np.bincount(doc, each[which] * times, m).astype(np.int64)
                left = ~common[which]
                rare = pa.StructArray.from_arrays([pa.array(h[which[left]].view(np.int64)), pa.array(times[left], pa.int64())], ["hash", "times"])
                ends = pa.array(np.searchsorted(doc[left], np.arange(m + 1)), pa.int32())
                rows = batch.slice(lo, m)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), rows.column(3), pa.array(np.diff(at), pa.int64()), pa.array(tokens, pa.int64()), pa.ListArray.from_arrays(ends, rare)], ["doc_id", "t1", "t2", "n_bytes", "tokens", "rare"])

    return run


def _whole(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(_at(tokenizer))
        for batch in batches:
            for lo, hi, _, at in blocks(batch.column(1)):
                texts = [t or "" for t in batch.column(1).slice(lo, hi - lo).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(at), pa.int64()), pa.array(counter.whole(texts), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, tokenizer: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit.

    ``tokenizer`` is a file name resolved by ``public_tokenizers.path`` on each
    executor, or a path. Special strings inside a text count as the library's
    default has them (one token each). A null text counts as empty, an empty
    text has 0 tokens; repeated rows give repeated rows; other columns of
    ``docs`` are not read. Null ids stay null. Pre-tokens are told apart by 64
    bits of hash.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    over = (F.col("n_tokens") > limit).alias("over_limit")
    if not _counter(_at(tokenizer)).splits:
        return rows.mapInArrow(_whole(tokenizer), "doc_id long, n_bytes long, n_tokens long").select("*", over)
    counted, _ = cut(counted_pieces(distinct_pre_tokens(rows, tokenizer), tokenizer))
    least = most_frequent(counted, "n", HEAD)
    head = counted.where(F.col("n") >= least).select("hash", "pieces").toArrow()
    key, pieces = head["hash"].to_numpy().view(np.uint64), head["pieces"].to_numpy().astype(np.int64)
    order = np.argsort(key)
    base = rows.select("doc_id", "text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"))
    schema = "doc_id long, t1 long, t2 long, n_bytes long, tokens long, rare array<struct<hash:long,times:long>>"
    scanned, _ = cut(base.mapInArrow(_frequencies(tokenizer, key[order], pieces[order]), schema))
    text = ["t1", "t2"]
    # Copies of a text have the same frequencies, so one stands for all.
    rare = scanned.where("size(rare) > 0").select(*text, "rare").dropDuplicates(text).select(*text, F.inline("rare"))
    more = rare.join(counted.where(F.col("n") < least).select("hash", "pieces"), "hash").groupBy(*text).agg(F.sum(F.col("times") * F.col("pieces")).alias("more"))
    out = scanned.select("doc_id", *text, "n_bytes", "tokens").join(more, text, "left")
    return out.select("doc_id", "n_bytes", (F.col("tokens") + F.coalesce("more", F.lit(0))).alias("n_tokens")).select("*", over)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all ``documents`` under byte_bpe_50k.json."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), "byte_bpe_50k.json")


QUERIES = {"op7_token_counts": op7_token_counts}
ORACLES: dict[str, str] = {}
