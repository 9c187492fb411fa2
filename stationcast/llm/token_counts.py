"""Token counts by count-only Viterbi over a unigram vocabulary.

The vocabulary is the pieces and scores of a SentencePiece model file, read as a unigram model. An
Aho-Corasick automaton lists all pieces that end at a character, longest first; dynamic programming
carries the best score up to each character and the number of its pieces, never the pieces. Rules of
the unigram tokenizer: a better score must be strictly better, so of equal ones the path whose last
piece starts earliest wins; a character that is no piece itself may be taken as unknown at the lowest
score less 10 and then counts as its UTF-8 bytes (byte fallback) or as one token.

No piece holds a white space marker behind another character, and line feeds are no part of any piece,
so paths always break there: chunks between such places are counted once per worker and table (see
``sentencepiece_codec``) and a text is the sum of its chunks. Scores are whole numbers in the public
file, so their sums are exact. Its marker-only pieces carry the placeholder -1e9, beside which 32-bit
sums lose all units; placeholders are raised to the lowest other score. The counts equal those of the
library on the same file read as a unigram model with these scores.

Counts are without begin and end ids. Null and empty texts have 0 tokens.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import query
from .sentencepiece_codec import MARK, public_model

UNKNOWN_PENALTY = 10.0
PLACEHOLDER = -1e8  # scores below are no scores
TABLE_CHARS = 12_000_000
LONG_CHUNK = 4096
WORST = float("-inf")


class PieceCounter:
    def __init__(self, model: str):
        import ahocorasick
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=model)
        self.bytes_fallback = any(m.is_byte(i) for i in range(m.get_piece_size()))
        pieces = {}
        for i in range(m.get_piece_size()):
            if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i)):
                pieces[m.id_to_piece(i)] = m.get_score(i)
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces):
            raise ValueError("pieces cross white space markers or line feeds")
        floor = min(s for s in pieces.values() if s > PLACEHOLDER)
        pieces = {p: max(s, floor) for p, s in pieces.items()}
        self.singles = {p for p in pieces if len(p) == 1}
        self.unknown = min(pieces.values()) - UNKNOWN_PENALTY
        self.trie = ahocorasick.Automaton()
        for piece, score in pieces.items():
            self.trie.add_word(piece, (len(piece) - 1, score))
        self.trie.make_automaton()
        self.cut = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n").findall
        self.table: dict[str, int] = {}
        self.chars = 0

    def viterbi(self, chunk: str) -> int:
        """Number of tokens on the best path through the chunk."""
        n = len(chunk)
        best, count = [0.0] + [WORST] * n, [0] * (n + 1)
        if self.singles.issuperset(chunk):
            for end, (back, score) in self.trie.iter(chunk):
                start = end - back
                path = best[start] + score
                if path > best[end + 1]:
                    best[end + 1], count[end + 1] = path, count[start] + 1
            return count[n]
        matches = self.trie.iter(chunk)
        end, match = next(matches, (n, None))
        for at in range(n):
            while end == at:
                start = at - match[0]
                path = best[start] + match[1]
                if path > best[at + 1]:
                    best[at + 1], count[at + 1] = path, count[start] + 1
                end, match = next(matches, (n, None))
            if chunk[at] not in self.singles and best[at] + self.unknown > best[at + 1]:
                best[at + 1] = best[at] + self.unknown
                count[at + 1] = count[at] + (len(chunk[at].encode()) if self.bytes_fallback else 1)
        return count[n]

    def count(self, text: str) -> int:
        if not text:
            return 0
        if self.chars > TABLE_CHARS:
            self.table.clear()
            self.chars = 0
        total = 0
        for chunk, times in Counter(self.cut(MARK + text.replace(" ", MARK))).items():
            n = self.table.get(chunk)
            if n is None:
                n = self.viterbi(chunk)
                if len(chunk) <= LONG_CHUNK and self.chars <= TABLE_CHARS:
                    self.table[chunk] = n
                    self.chars += len(chunk)
            total += n * times
        return total


@lru_cache(maxsize=4)
def piece_counter(model: str) -> PieceCounter:
    return PieceCounter(model)


def count_tokens(docs: DataFrame, model: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """The rows with the number of tokens of a text column; a column of the same name is replaced."""
    rest = [c for c in docs.columns if c != out]
    given = docs.select(*[F.col(f"`{c}`") for c in rest])
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema if f.name != text), f"`{out}` bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = piece_counter(model)
        for batch in batches:
            n = [counter.count(t) if t else 0 for t in batch.column(text).to_pylist()]
            yield pa.record_batch({c: batch.column(c) for c in rest if c != text} | {out: pa.array(n, pa.int64())})

    return given.mapInArrow(run, fields)


@query("op8_token_counts")
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, public_model())
