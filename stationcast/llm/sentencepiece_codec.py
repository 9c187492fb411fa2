"""SentencePiece encoding and decoding through a table of distinct chunks.

When no piece of the vocabulary holds a white space marker behind another character, no merge crosses
the place before a run of markers. A text is then a sequence of chunks (a run of markers and what
follows up to the next one), a chunk always has the same ids, and each distinct chunk needs segmenting
once. A worker keeps the table of the chunks it has met, as packed ids and as decoded text; a block of
texts looks its chunks up, the chunks it lacks are segmented by the library in one call, and the ids of
a text are the table's entries joined in the order of its chunks. The table is emptied when it holds
``TABLE_CHARS`` characters, so its memory is bounded whatever the vocabulary of the corpus.

The table is kept per worker rather than shuffled as one table of the corpus: joining ids back to every
position would shuffle the whole text word by word twice.

Chunks also end behind each line feed, as no piece holds one either. These conditions, and that the
normalizer only marks spaces, are checked on the model; a model that does not fulfil them is encoded
text by text. Null and empty texts have the begin and end ids only and decode to
the empty text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import query

MARK = "▁"
TABLE_CHARS = 10_000_000
LONG_CHUNK = 4096  # longer chunks are segmented where they occur and not kept
# what the normalizer must leave alone for chunks to be cut out of the raw text
PROBE = "a b\tc  d­ﬁǺＡ　e​\x00\x7f\x85\r\nf \U0001f600 " + MARK + "g" + MARK


class ChunkTable:
    """Ids of every chunk met, and the decoded text of those that do not decode to themselves."""

    def __init__(self, model: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        inner = any(MARK in p.lstrip(MARK) for p in pieces)
        marked = self.model.encode(PROBE, out_type=str)
        plain = self.model.decode(self.model.encode(PROBE)) == PROBE.replace(MARK, " ") and marked[0].startswith(MARK)
        self.cuttable = not inner and plain and not any("\n" in p for p in pieces)
        # markers, then up to the next marker or through the next line feed
        self.cut = re.compile(f"{MARK}*[^{MARK}\n]*\n|{MARK}*[^{MARK}\n]+|{MARK}+").findall
        self.front = self.model.encode("\n")
        self.begin, self.end = (np.array([i], "<u4").tobytes() for i in (self.model.bos_id(), self.model.eos_id()))
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, bytes] = {}
        self.odd: dict[str, str] = {}
        self.chars = 0

    def _segment(self, chunks: list[str]) -> tuple[list[bytes], dict[str, str]]:
        """Packed ids, and the texts that are not the chunks', of chunks inside a text: each is encoded and decoded behind a line feed.

        The line feed takes the dummy marker and the marker that decoding drops, and no merge reaches
        across it, so what stands behind its ids belongs to the chunk.
        """
        front = len(self.front)
        found = self.model.encode(["\n" + c for c in chunks], num_threads=1)
        texts = (t[1:] for t in self.model.decode(found, num_threads=1))
        odd = {c: t for c, t in zip(chunks, texts) if t != c.replace(MARK, " ")}
        ends = 4 * np.cumsum([len(x) for x in found])
        flat = np.fromiter(chain.from_iterable(found), "<u4").tobytes()
        return [flat[a + 4 * front:b] for a, b in zip([0, *ends[:-1]], ends)], odd

    def add(self, chunks: set[str]) -> None:
        new = list(chunks)
        size = sum(map(len, new))
        if self.chars + size > TABLE_CHARS:
            self.clear()
        self.chars += size
        ids, odd = self._segment(new)
        self.ids.update(zip(new, ids))
        self.odd.update(odd)

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        """Packed ids without begin and end, and decoded text, of each text."""
        if not self.cuttable:
            for ids in self.model.encode(texts, num_threads=1):
                yield np.array(ids, "<u4").tobytes(), self.model.decode(ids)
            return
        cut = [self.cut(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        short = {c for chunks in cut for c in chunks if len(c) <= LONG_CHUNK}
        lacking = {c for c in short if c not in self.ids}
        if lacking and self.chars + sum(map(len, lacking)) > TABLE_CHARS:
            self.clear()
            lacking = short
        if lacking:
            self.add(lacking)
        for text, chunks in zip(texts, cut):
            odd, parts = self.odd, None
            if any(len(c) > LONG_CHUNK for c in chunks):
                long = [c for c in chunks if len(c) > LONG_CHUNK]
                found, more = self._segment(long)
                at, odd = dict(zip(long, found)), odd | more
                parts = [at[c] if c in at else self.ids[c] for c in chunks]
            ids = b"".join(parts or map(self.ids.__getitem__, chunks))
            if odd and not odd.keys().isdisjoint(chunks):
                yield ids, "".join(odd[c] if c in odd else c.replace(MARK, " ") for c in chunks)[1:]
            else:
                yield ids, text.replace(MARK, " ")


@lru_cache(maxsize=4)
def chunk_table(model: str) -> ChunkTable:
    return ChunkTable(model)


def _texts(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """First row and texts of consecutive rows with about ``limit`` characters."""
    part, size, start = [], 0, 0
    for i, text in enumerate(column.to_pylist()):
        part.append(text or "")
        size += len(part[-1])
        if size >= limit:
            yield start, part
            part, size, start = [], 0, i + 1
    if part:
        yield start, part


def encode_documents(docs: DataFrame, model: str, text: str = "text", ids: str | None = "ids", digest: bool = False) -> DataFrame:
    """The rows with ``n_tokens``; ``ids`` names a column for the ids (array<int>), ``digest`` adds
    ``ids_sha256`` and ``decoded_sha256``. Columns of these names are replaced, ``text`` is dropped.

    ``model`` is the path of a SentencePiece model that every executor can read.
    """
    added = {"n_tokens": "bigint"} | ({ids: "array<int>"} if ids else {})
    added |= {"ids_sha256": "string", "decoded_sha256": "string"} if digest else {}
    rest = [c for c in docs.columns if c not in added and c != text]
    given = docs.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`"))
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema if f.name != text),
                        *(f"`{c}` {t}" for c, t in added.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = chunk_table(model)
        for batch in batches:
            for start, texts in _texts(batch.column(text)):
                packed, shas, decoded = [], [], []
                for body, surface in table.encode(texts):
                    packed.append(table.begin + body + table.end)
                    if digest:
                        shas.append(hashlib.sha256(packed[-1]).hexdigest())
                        decoded.append(hashlib.sha256(surface.encode()).hexdigest())
                n = [len(p) // 4 for p in packed]
                out = {c: batch.column(c).slice(start, len(texts)) for c in rest}
                out["n_tokens"] = pa.array(n, pa.int64())
                if ids:
                    flat = np.frombuffer(b"".join(packed), "<i4")
                    out[ids] = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(n)]).astype(np.int32), pa.array(flat))
                if digest:
                    out |= {"ids_sha256": pa.array(shas), "decoded_sha256": pa.array(decoded)}
                yield pa.record_batch(out)

    return given.mapInArrow(run, fields)


def public_model(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op3_sentencepiece_codec")
def op3_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_documents(docs, public_model(), ids=None, digest=True)
