"""Substring dedup by recompression: every word inside a 35-word window that occurs elsewhere goes.

Round 1 names runs and pairs of words up to symbols of a few words (``recompression``). Consecutive
windows with the same anchoring symbol form a span; a span is a row with its symbol, a hash of its
words and its place. Round 2 counts symbols, with the words that decide them, over the corpus: a repeated window has both in
common with its other occurrences, so spans with a symbol of their own are done. Round 3 compares
the spans of a symbol: spans with equal words repeat as a whole. Where a symbol has several different
spans, one of each kind goes back to its text for the hashes of its windows, and windows that two
spans share, or that belong to a repeated span, repeat. Round 4 takes the marked windows to the texts,
checks each against the words there and cuts.

Names and hashes are 64 bits wide; windows are only compared under the same symbol, and a mark is only
used where the words hash as marked.

Words are runs of characters other than ``\\x20`` and ``\\x09``-``\\x0D``. A null or empty text has no
words and stays empty (null stays null). Texts below 35 words lose nothing. Equal rows, also with the
same or no doc_id, count as occurrences of each other, so all copies go. Other columns pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .recompression import anchors, levels
from .registry import query
from .store import stored
from .words import ODD, ODD_INV, Block, blocks, covered, mix, per_document, powers

WINDOW = 35
LEVEL = 1  # zstd


class Sums:
    """Hashes of any word range of a block."""

    def __init__(self, hashes: np.ndarray):
        self.sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * powers(ODD, len(hashes)), out=self.sums[1:])
        self.back = powers(ODD_INV, len(hashes) + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start])


def spans(block: Block, window: int) -> tuple[np.ndarray, ...]:
    """Symbol with its context, words' hash, document, first window and number of windows of each span."""
    hashes = block.hashes()
    starts, _ = block.windows(hashes, window)
    if not len(starts):
        return tuple(np.zeros(0, kind) for kind in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    found = levels(hashes, block.bounds)
    level, index = anchors(found, starts, window, len(hashes))
    new = np.ones(len(starts), bool)
    new[1:] = (level[1:] != level[:-1]) | (index[1:] != index[:-1])
    head = np.flatnonzero(new)
    n = np.diff(np.append(head, len(starts)))
    sums = Sums(hashes)
    name = np.zeros(len(head), np.uint64)
    for k, symbols in enumerate(found):
        here = level[head] == k
        at = index[head][here]
        # the words of the context are as common to equal windows as the symbol, and far rarer
        name[here] = mix(symbols.name[at] + np.uint64(k)) ^ sums(symbols.lo[at], symbols.hi[at])
    at = starts[head]
    document = np.searchsorted(block.bounds, at, "right") - 1
    return name, sums(at, at + n + window - 1), document, at - block.bounds[document], n


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _combined(name: np.ndarray, words: np.ndarray, n: np.ndarray, row: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """A row for each kind of span, with the places of all but the first in ``more``."""
    order = np.lexsort((n, words, name))
    name, words, n, row, at = (x[order] for x in (name, words, n, row, at))
    first = np.ones(len(name), bool)
    first[1:] = (name[1:] != name[:-1]) | (words[1:] != words[:-1]) | (n[1:] != n[:-1])
    heads = np.flatnonzero(first)
    size = np.diff(np.append(heads, len(name))) - 1
    rest = pa.StructArray.from_arrays([pa.array(row[~first]), pa.array(at[~first], pa.int32())], ["row", "at"])
    offsets = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32(), mask=np.append(size == 0, False))
    return pa.record_batch({
        "symbol": _signed(name[heads]), "words": _signed(words[heads]), "row": pa.array(row[heads]),
        "at": pa.array(at[heads], pa.int32()), "n": pa.array(n[heads], pa.int32()),
        "more": pa.ListArray.from_arrays(offsets, rest),
    })


def find_spans(docs: DataFrame, window: int) -> DataFrame:
    """(symbol, words, row, at, n, more) of all spans; ``row`` is a hash of doc_id and text.

    Equal spans of a block of texts are one row, so a passage, or a word repeated over and over, that a
    third of all texts share is a row per block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("row").to_numpy()
            for start, _, block in blocks(batch, "text"):
                name, words, document, at, n = spans(block, window)
                yield _combined(name, words, n, row[start + document], at)

    return docs.select("row", "text").mapInArrow(
        run, "symbol bigint, words bigint, row bigint, at int, n int, more array<struct<row:bigint,at:int>>")


def packed(docs: DataFrame) -> DataFrame:
    """The texts compressed for the shuffle; null stays null."""
    fields = ", ".join(f"`{f.name}` {'binary' if f.name == 'text' else f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", LEVEL)
        for batch in batches:
            raw = [None if t is None else t.encode() for t in batch.column("text").to_pylist()]
            zipped = [None if t is None else len(t).to_bytes(8, "little") + codec.compress(t, asbytes=True) for t in raw]
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, "text", pa.array(zipped, pa.binary()))

    return docs.mapInArrow(run, fields)


def _unpacked(batch: pa.RecordBatch) -> pa.RecordBatch:
    codec = pa.Codec("zstd")
    texts = [None if z is None else codec.decompress(z[8:], int.from_bytes(z[:8], "little"), asbytes=True)
             for z in batch.column("text").to_pylist()]
    at = batch.schema.get_field_index("text")
    return batch.set_column(at, "text", pa.array(texts, pa.binary()).cast(pa.large_binary()).view(pa.large_string()))


def _entries(batch: pa.RecordBatch, start: int, end: int, column: str = "marks"):
    """Row number of each mark of the rows from start to end, and the marks as a struct array."""
    marks = batch.column(column).slice(start, end - start)
    return marks.value_parent_indices().to_numpy(), marks.flatten()


def window_hashes(texts: DataFrame, window: int) -> DataFrame:
    """(symbol, words, often, k, hash) of each window k of the spans in ``marks`` (symbol, words, at, n, often)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in map(_unpacked, batches):
            for start, end, block in blocks(batch, "text"):
                owner, marks = _entries(batch, start, end)
                symbol, words, at, n, often = (marks.field(f).to_numpy(zero_copy_only=False) for f in ("symbol", "words", "at", "n", "often"))
                first = block.bounds[owner] + at
                fits = first + n + window - 1 <= block.bounds[owner + 1]
                sums = Sums(block.hashes())
                good = np.flatnonzero(fits)
                good = good[sums(first[good], first[good] + n[good] + window - 1).view(np.int64) == words[good]]
                each = np.repeat(good, n[good])
                k = np.arange(len(each)) - np.repeat(np.cumsum(n[good]) - n[good], n[good])
                begin = first[each] + k
                yield pa.record_batch({
                    "symbol": pa.array(symbol[each]), "words": pa.array(words[each]), "often": pa.array(often[each]),
                    "k": pa.array(k, pa.int32()), "hash": _signed(sums(begin, begin + window)),
                })

    return texts.mapInArrow(run, "symbol bigint, words bigint, often boolean, k int, hash bigint")


def _places(spans: DataFrame) -> DataFrame:
    """(row, at, n, words, some) of every place of spans with ``more``."""
    first = F.array(F.struct("row", "at"))
    each = F.explode(F.when(F.col("more").isNull(), first).otherwise(F.concat(first, F.col("more")))).alias("place")
    return spans.select(each, "n", "words", "some").select("place.row", "place.at", "n", "words", "some")


def repeated_spans(docs: DataFrame, texts: DataFrame, window: int) -> DataFrame:
    """(row, at, n, words, some): spans with repeated windows; ``some`` lists them, null stands for all."""
    found = stored(find_spans(docs, window), "spans")
    kind, times = F.struct("words", "n"), F.sum(1 + F.coalesce(F.size("more"), F.lit(0)))
    symbols = (found.groupBy("symbol").agg(times.alias("times"), F.min(kind).alias("low"), F.max(kind).alias("high"))
               .where("times > 1").select("symbol", (F.col("low") != F.col("high")).alias("various")))
    # written, so that the join sees the sizes of both sides and can split a common symbol
    shared = stored(found.join(stored(symbols, "symbols"), "symbol"), "shared")
    alike = _places(shared.where("not various").withColumn("some", F.lit(None).cast("array<int>")))
    various = shared.where("various")
    kinds = stored(various.groupBy("symbol", "words", "n").agg(
        (times > 1).alias("often"), F.min(F.struct("row", "at")).alias("place")), "kinds")
    asked = kinds.groupBy(F.col("place.row").alias("row")).agg(
        F.collect_list(F.struct("symbol", "words", "place.at", "n", "often")).alias("marks"))
    # equal rows answer twice, but their spans are repeated as a whole anyway
    windows = stored(window_hashes(texts.select("row", "text").join(asked, "row"), window), "windows")
    again = (windows.groupBy("symbol", "hash").agg(F.count("*").alias("kinds"), F.max("often").alias("often"))
             .where("kinds > 1 or often").select("symbol", "hash"))
    some = (windows.where("not often").join(again, ["symbol", "hash"])
            .groupBy("symbol", "words").agg(F.collect_list("k").alias("some")))
    parts = (kinds.where("not often").join(some, ["symbol", "words"]).select("symbol", "words", "n", "some")
             .union(kinds.where("often").select("symbol", "words", "n", F.lit(None).cast("array<int>"))))
    return alike.union(_places(various.join(stored(parts, "parts"), ["symbol", "words", "n"])))


def _removed(batch: pa.RecordBatch, start: int, end: int, block: Block, window: int) -> np.ndarray:
    """Whether each word of the block goes."""
    owner, marks = _entries(batch, start, end)
    hashes = block.hashes() if len(owner) else np.zeros(len(block.starts), np.uint64)
    if not len(owner):
        return np.zeros(len(hashes), bool)
    at, n, words = (marks.field(f).to_numpy(zero_copy_only=False) for f in ("at", "n", "words"))
    first = block.bounds[owner] + at
    good = np.flatnonzero(first + n + window - 1 <= block.bounds[owner + 1])
    good = good[Sums(hashes)(first[good], first[good] + n[good] + window - 1).view(np.int64) == words[good]]
    some = marks.field("some")
    whole = some.is_null().to_numpy(zero_copy_only=False)
    use = good[whole[good]]
    starts = np.repeat(first[use], n[use]) + np.arange(n[use].sum()) - np.repeat(np.cumsum(n[use]) - n[use], n[use])
    parent, offset = some.value_parent_indices().to_numpy(), some.flatten().to_numpy(zero_copy_only=False)
    fine = np.isin(parent, good)
    starts = np.concatenate([starts, first[parent[fine]] + offset[fine]])
    return covered(starts.astype(np.int64), window, len(hashes))


def _cut(raw: bytes, starts: np.ndarray, gone: np.ndarray) -> bytes:
    """The text without the words that go and the white space behind them."""
    change = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]])))
    out, at = [], 0
    for a, b in zip(change[::2], change[1::2]):
        out.append(raw[at:starts[a]])
        at = starts[b] if b < len(starts) else len(raw)
    return b"".join([*out, raw[at:]])


def dedup_substrings(docs: DataFrame, window: int = WINDOW, clean: str | None = None, digest: bool = False) -> DataFrame:
    """The rows with ``n_words`` and ``n_removed``; ``clean`` names a column for the text that is left,
    ``digest`` adds ``kept_sha256`` of the kept words joined by a space. Needs doc_id and text; columns
    of the added names are replaced and ``text`` is dropped."""
    added = ["n_words", "n_removed", *([clean] if clean else []), *(["kept_sha256"] if digest else [])]
    rest = [c for c in docs.columns if c not in {*added, "text", "row", "marks"}]
    docs = docs.select(*[F.col(f"`{c}`") for c in rest], "text", F.xxhash64("doc_id", "text").alias("row"))
    texts = packed(docs)
    marks = repeated_spans(docs, texts, window).groupBy("row").agg(
        F.collect_list(F.struct("at", "n", "words", "some")).alias("marks"))
    marked = texts.join(marks, "row", "left").select(*[F.col(f"`{c}`") for c in rest], "text", "marks")
    kinds = {"n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"}
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in rest),
                        *(f"`{c}` {kinds.get(c, 'string')}" for c in added)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in map(_unpacked, batches):
            for start, end, block in blocks(batch, "text"):
                gone = _removed(batch, start, end, block, window)
                lost = per_document(gone, block)
                out = {c: batch.column(c).slice(start, end - start) for c in rest}
                out |= {"n_words": pa.array(block.n_words, pa.int64()), "n_removed": pa.array(lost, pa.int64())}
                raw = block.data.tobytes()
                cleaned, digests = [], []
                for i in range(end - start):
                    text, own = raw[block.text_at[i]:block.text_at[i + 1]], slice(block.bounds[i], block.bounds[i + 1])
                    if clean:
                        cleaned.append(_cut(text, block.starts[own] - block.text_at[i], gone[own]) if lost[i] else text)
                    if digest:
                        words = compress(text.split(), ~gone[own]) if lost[i] else text.split()
                        digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
                if clean:
                    nulls = batch.column("text").slice(start, end - start).is_null().to_pylist()
                    out[clean] = pa.array([None if z else t.decode() for z, t in zip(nulls, cleaned)], pa.string())
                if digest:
                    out["kept_sha256"] = pa.array(digests)
                yield pa.record_batch(out)

    return marked.mapInArrow(run, fields)


_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, s, md5(array_to_string(w[s:s + 34], ' ')) AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS s FROM d WHERE len(w) >= 35)),
again AS (SELECT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY k) AS n FROM windows) WHERE n >= 2),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS p FROM again),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


@query("op4_substring_dedup", _SQL)
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_substrings(docs, digest=True)
