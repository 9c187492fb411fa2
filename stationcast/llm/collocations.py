"""Phrase collocations from one FM-index per shard, counts summed across shards.

``shards`` numbers the words of consecutive pieces, at most ``SHARD_WORDS`` of them (a longer text goes
on in the next shard at the end of a piece; only a longer piece makes a larger shard), and writes the
numbers and each shard's vocabulary. A phrase cannot be frequent unless the phrases in it are, so the
lengths are taken one by one: words first; what is below ``LEAST`` in all shards together ends a piece,
and the index of each shard is built over the rest and written. Then every index extends the intervals of
the phrases that are frequent everywhere, to the left and to the right, and the counts of the phrases
that result are summed by prefix and suffix. No phrase text is moved before the frequent ones are known.

A shard packs its phrases by hash of prefix and suffix into buckets, a row for each; the number of buckets
follows the number of words, so that a bucket of all shards fits a task, and as a shard has a phrase once,
a frequent phrase adds no more to its bucket than there are shards. The intervals that stay frequent go
back to their shard, whose index reads them one after the other.

A candidate of m words carries the counts of its first 1 ... m - 1 and last 1 ... m - 1 words, so that cuts
need no further counting. Of what lies in a longer candidate, only the next length has to be looked at: a
shorter phrase that a much longer one covers is covered by the one between.

Null and empty texts have no words, a null language is ``und``; repeated rows count again. Any further
columns are ignored, an empty table gives no rows. Ties are ordered by count and by the phrase's bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .fm_index import DEPTH, FmIndex, ring, transform
from .registry import query
from .store import stored
from .words import mix, text_buffers

LEAST = 30  # occurrences of a candidate
TOP = 2000  # phrases of a language
COVER_NUM, COVER_DEN = 80, 100  # share of a phrase's occurrences inside a longer one that drops it
SHARD_WORDS = 1 << 21
BUCKET_PHRASES = 1 << 20  # phrases of all shards that are summed at once, at most on average
BLOCK_BYTES = 1 << 20
ROWS = 1 << 16  # rows of a batch
SEQ_BITS, ROW_BITS = 10, 32  # shards of a task, rows of a shard

IS_BREAK = np.zeros(256, bool)
IS_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
IS_GAP = IS_BREAK.copy()
IS_GAP[[0x20, 0x09]] = True


def _pack(values: np.ndarray, rising: bool = False) -> bytes:
    """Integers in little room: by bytes of equal weight, compressed; ``rising`` ones as differences."""
    values = np.diff(values, prepend=values.dtype.type(0)) if rising else values
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unpack(payload: bytes, dtype: type, rising: bool = False) -> np.ndarray:
    size, item = int.from_bytes(payload[:8], "little"), np.dtype(dtype).itemsize
    planes = np.frombuffer(pa.decompress(payload[8:], size, codec="zstd", asbytes=True), np.uint8)
    values = np.ascontiguousarray(planes.reshape(item, size // item).T).view(dtype).ravel()
    return np.cumsum(values) if rising else values


def split_pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.LargeStringArray, np.ndarray, np.ndarray]:
    """Words of some texts, whether each begins a piece, and the number of its text."""
    data, offsets = data[offsets[0]:offsets[-1]], offsets - offsets[0]
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    word = ~IS_GAP[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | edge[1:-1]
    starts = np.flatnonzero(first)
    text = np.searchsorted(offsets, starts, "right") - 1
    breaks = np.cumsum(IS_BREAK[data], dtype=np.int32)[starts]
    opens = np.ones(len(starts), bool)
    opens[1:] = (breaks[1:] != breaks[:-1]) | (text[1:] != text[:-1])
    kept = np.append(0, np.cumsum(word, dtype=np.int64))
    bounds = np.append(kept[starts], kept[-1])
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds.tobytes()), pa.py_buffer(data[word].tobytes()))
    return words, opens, text


def _text_parts(batch: pa.RecordBatch, names: dict[str, int]) -> Iterator[tuple[pa.LargeStringArray, np.ndarray, np.ndarray]]:
    """Words, piece starts and language numbers of about ``BLOCK_BYTES`` of text; a long text comes in parts.

    names: numbers of the languages seen so far, which new ones are added to.
    """
    data, offsets = text_buffers(batch.column("text"))
    lang = np.array([names.setdefault("und" if v is None else v, len(names)) for v in batch.column("lang").to_pylist()], np.int64)
    row = 0
    while row < batch.num_rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + BLOCK_BYTES, "right")) - 1)
        if end > row + 1 or offsets[end] - offsets[row] <= 2 * BLOCK_BYTES:
            words, opens, text = split_pieces(data, offsets[row:end + 1])
            yield words, opens, lang[row + text]
        else:  # one long text: cut behind the last piece that ends in the block
            at, stop = int(offsets[row]), int(offsets[end])
            while at < stop:
                cut = min(at + BLOCK_BYTES, stop)
                while cut < stop:
                    ends = np.flatnonzero(IS_BREAK[data[at:cut]])
                    if len(ends):
                        cut = at + int(ends[-1]) + 1
                        break
                    cut = min(cut + BLOCK_BYTES, stop)
                words, opens, text = split_pieces(data, np.array([at, cut]))
                yield words, opens, lang[row + text]
                at = cut
        row = end


def shards(docs: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Rows (shard, tokens), and per word of a shard's vocabulary (shard, no, lang, word, n)."""

    def rows(shard: int, parts: list, names: list[str]) -> Iterator[pa.RecordBatch]:
        coded = pa.chunked_array([p[0] for p in parts]).combine_chunks().dictionary_encode()
        opens = np.concatenate([p[1] for p in parts])
        code = coded.indices.to_numpy().astype(np.int64) * len(names) + np.concatenate([p[2] for p in parts])
        kinds, code, counts = np.unique(code, return_inverse=True, return_counts=True)
        rank = np.empty(len(kinds), np.int32)
        by_count = np.argsort(-counts, kind="stable")
        rank[by_count] = np.arange(len(kinds))
        at = np.arange(len(code)) + np.cumsum(opens)
        tokens = np.zeros(len(code) + int(opens.sum()) + 1, np.int32)
        tokens[at] = rank[code] + 1
        yield _batch(shard, 1, tokens=[_pack(tokens)], no=[None], lang=[None], word=[None], n=[None])
        words = coded.dictionary.take(pa.array(kinds[by_count] // len(names)))
        langs = pa.array(names, pa.string()).take(pa.array(kinds[by_count] % len(names)))
        for a in range(0, len(kinds), ROWS):
            part = slice(a, a + ROWS)
            size = len(kinds[part])
            yield _batch(shard, size, tokens=pa.nulls(size, pa.binary()), no=np.arange(a, a + size),
                         lang=langs.slice(a, size), word=words.slice(a, size), n=counts[by_count[part]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq, parts, size, names = TaskContext.get().partitionId(), 0, [], 0, {}

        def flush() -> Iterator[pa.RecordBatch]:
            if seq >> SEQ_BITS or task >> (63 - SEQ_BITS - ROW_BITS):
                raise ValueError("more shards than names: split the input into smaller tasks or raise shard_words")
            return rows(task << SEQ_BITS | seq, parts, list(names))

        for batch in batches:
            for part in _text_parts(batch, names):
                if len(part[1]):
                    parts.append(part)
                    size += len(part[1])
                if size >= shard_words:
                    yield from flush()
                    seq, parts, size = seq + 1, [], 0
        if parts:
            yield from flush()

    return docs.select("text", "lang").mapInArrow(run, "shard bigint, tokens binary, no bigint, lang string, word string, n bigint")


def _batch(shard: int, size: int, **columns) -> pa.RecordBatch:
    types = {"tokens": pa.binary(), "lang": pa.string(), "word": pa.string()}
    out = {"shard": pa.array(np.full(size, shard, np.int64))}
    for name, values in columns.items():
        kind = types.get(name, pa.int64())
        out[name] = values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, kind)
    return pa.record_batch(out)


def _by_shard(payloads: DataFrame, name: str, rest: DataFrame) -> DataFrame:
    """Each shard's payload and behind it its rows of ``rest``, in one partition."""
    rows = payloads.select("shard", F.col(name).alias("payload")).unionByName(rest, allowMissingColumns=True)
    return rows.repartition("shard").sortWithinPartitions("shard", F.col("payload").isNull())


def _groups(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[tuple[int, pa.Table]]:
    """Rows of each value of ``by``, which stand together."""
    value, found = None, []
    for batch in batches:
        own = batch.column(by).to_numpy()
        cuts = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else []
        for a, b in zip(cuts, [*cuts[1:], len(own)]):
            if own[a] != value and found:
                yield value, pa.Table.from_batches(found)
                found = []
            value = int(own[a])
            found.append(batch.slice(a, b - a))
    if found:
        yield value, pa.Table.from_batches(found)


def _packed(table: pa.Table, name: str, rising: bool = False) -> np.ndarray:
    """A column of packed numbers, one behind the other."""
    parts = [_unpack(v, np.int64, rising) for v in table.column(name).to_pylist()]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def indexes(cut: DataFrame, words: DataFrame) -> DataFrame:
    """(shard, bwt, ids, size) of every shard over its frequent words; ids name the words in order of number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _groups(batches, "shard"):
            tokens = _unpack(rows.column("payload")[0].as_py(), np.int32)
            no, ids = (rows.column(c)[1:].to_numpy().astype(np.int64) for c in ("no", "id"))
            order = np.argsort(ids)
            number = np.zeros(int(tokens.max(initial=0)) + 1, np.int32)
            number[no[order] + 1] = np.arange(1, len(no) + 1)
            bwt = transform(ring(number[tokens]))
            yield pa.record_batch({"shard": [shard], "bwt": [_pack(bwt)], "ids": [_pack(ids[order], rising=True)], "size": [len(bwt)]})

    tokens = cut.where("tokens is not null")
    return _by_shard(tokens, "tokens", words.select("shard", "no", "id")).mapInArrow(run, "shard bigint, bwt binary, ids binary, size bigint")


_PHRASES = "bucket bigint, shard bigint, no binary, n binary, pid binary, sid binary"


def _emit(shard: int, index: FmIndex, member: np.ndarray, ids: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """A shard's phrases, packed by bucket of prefix and suffix."""
    starts, counts, prefix, suffix = index.extend(member)
    pid, sid = ids[prefix], ids[suffix]
    bucket = (mix(mix(pid.view(np.uint64)) + sid.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    for at in range(0, len(full), 64):
        parts = [(b, order[bounds[b]:bounds[b + 1]]) for b in full[at:at + 64]]
        yield pa.record_batch({
            "bucket": pa.array([b for b, _ in parts], pa.int64()), "shard": pa.array([shard] * len(parts), pa.int64()),
            "no": [_pack(starts[p], rising=True) for _, p in parts], "n": [_pack(counts[p]) for _, p in parts],
            "pid": [_pack(pid[p], rising=True) for _, p in parts], "sid": [_pack(sid[p], rising=True) for _, p in parts]})


def pairs(index: DataFrame, buckets: int) -> DataFrame:
    """Phrases of two words of every shard: first row, count, and the names of the first and last word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, bwt, ids in zip(*(batch.column(c).to_pylist() for c in ("shard", "bwt", "ids"))):
                fm = FmIndex(_unpack(bwt, np.int32))
                yield from _emit(shard, fm, fm.words(), _unpack(ids, np.int64, rising=True), buckets)

    return index.select("shard", "bwt", "ids").mapInArrow(run, _PHRASES)


def longer(index: DataFrame, frequent: DataFrame, buckets: int) -> DataFrame:
    """Phrases one word longer than the ``frequent`` intervals, whose prefix and suffix are frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _groups(batches, "shard"):
            kept = rows.slice(1)
            if kept.num_rows:
                fm = FmIndex(_unpack(rows.column("payload")[0].as_py(), np.int32))
                member = fm.fill(_packed(kept, "no", rising=True), _packed(kept, "n"))
                yield from _emit(shard, fm, member, _packed(kept, "id", rising=True), buckets)

    intervals = frequent.where("shard is not null").select("shard", "no", "n", "id")
    return _by_shard(index, "bwt", intervals).mapInArrow(run, _PHRASES)


def frequent_words(vocabulary: DataFrame, least: int) -> DataFrame:
    """(shard, no, id) of words with ``least`` occurrences in all shards; where the word has its name from also f, lang, word."""
    same = Window.partitionBy("lang", "word")
    own = F.shiftleft("shard", ROW_BITS).bitwiseOR(F.col("no"))
    rows = vocabulary.select("shard", "no", "lang", "word", F.sum("n").over(same).alias("f"), F.min(own).over(same).alias("id")).where(F.col("f") >= least)
    leads = F.col("id") == own
    return stored(rows.select("shard", "no", "id", *(F.when(leads, F.col(c)).alias(c) for c in ("f", "lang", "word"))), "words")


def summed(phrases: DataFrame, least: int, name: str) -> DataFrame:
    """Phrases with ``least`` occurrences in all shards: rows (phrase, pid, sid, f), and each shard's intervals of them.

    The latter are rows (shard, no, n, id) of packed numbers. A phrase is named by its bucket and its place there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _groups(batches, "bucket"):
            no, pid, sid = (_packed(rows, c, rising=True) for c in ("no", "pid", "sid"))
            n = _packed(rows, "n")
            sizes = [int.from_bytes(v[:8], "little") // 8 for v in rows.column("n").to_pylist()]
            order = np.lexsort((sid, pid))
            new = np.ones(len(order), bool)
            new[1:] = (pid[order[1:]] != pid[order[:-1]]) | (sid[order[1:]] != sid[order[:-1]])
            first = np.flatnonzero(new)
            total = np.add.reduceat(n[order], first)
            keep = total >= least
            names = np.where(keep, (bucket << ROW_BITS) + np.cumsum(keep) - 1, -1)
            lead = order[first[keep]]
            if not len(lead):
                continue
            for a in range(0, len(lead), ROWS):
                part = slice(a, a + ROWS)
                yield pa.record_batch([*[pa.nulls(len(lead[part]), t) for t in (pa.int64(), pa.binary(), pa.binary(), pa.binary())],
                                       pa.array(names[keep][part]), pa.array(pid[lead[part]]), pa.array(sid[lead[part]]), pa.array(total[keep][part])], _COLUMNS)
            name_of = np.empty(len(order), np.int64)
            name_of[order] = np.repeat(names, np.diff(np.append(first, len(order))))
            ends = np.cumsum(sizes)
            for shard, a, b in zip(rows.column("shard").to_pylist(), ends - sizes, ends):
                at = a + np.flatnonzero(name_of[a:b] >= 0)
                if len(at):
                    yield pa.record_batch([pa.array([shard], pa.int64()), pa.array([_pack(no[at], rising=True)], pa.binary()), pa.array([_pack(n[at])], pa.binary()),
                                           pa.array([_pack(name_of[at], rising=True)], pa.binary()), *[pa.nulls(1, pa.int64())] * 4], _COLUMNS)

    dealt = phrases.repartition("bucket").sortWithinPartitions("bucket")
    return stored(dealt.mapInArrow(run, "shard bigint, no binary, n binary, id binary, phrase bigint, pid bigint, sid bigint, f bigint"), name)


_COLUMNS = ["shard", "no", "n", "id", "phrase", "pid", "sid", "f"]


def candidates(docs: DataFrame, least: int = LEAST, shard_words: int = SHARD_WORDS, bucket_phrases: int = BUCKET_PHRASES) -> tuple[DataFrame, DataFrame]:
    """Phrases of 2 to 4 words that no longer candidate covers, with score; and the number of words by language.

    The phrases: lang, phrase, a, l, r, score. Needs the columns text and lang.
    """
    cut = stored(shards(docs, shard_words), "shards")
    vocabulary = cut.where("tokens is null")
    totals = vocabulary.groupBy("lang").agg(F.sum("n").alias("n"))
    words = frequent_words(vocabulary, least)
    index = stored(indexes(cut, words), "indexes")
    buckets = max(1, -(-(index.agg(F.sum("size")).first()[0] or 0) // bucket_phrases))
    lead = words.where("f is not null")
    known = lead.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"),
                        F.array("f").alias("heads"), F.array("f").alias("tails"))
    levels, frequent = [], None
    for length in range(2, DEPTH + 1):
        frequent = summed(pairs(index, buckets) if frequent is None else longer(index, frequent, buckets), least, f"phrases-{length}")
        before = known.select(F.col("id").alias("pid"), "lang", "phrase", "heads")
        after = known.select(F.col("id").alias("sid"), "last", "tails")
        lead = frequent.where("f is not null").select(F.col("phrase").alias("id"), "pid", "sid", "f")
        known = stored(lead.join(before, "pid").join(after, "sid").select(
            "id", "pid", "sid", "f", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last",
            F.concat("heads", F.array("f")).alias("heads"), F.concat("tails", F.array("f")).alias("tails")), f"known-{length}")
        levels.append(known)
    scored = None
    for i, level in enumerate(levels):
        if i + 1 < len(levels):
            above = levels[i + 1]
            over = above.select(F.col("pid").alias("id"), F.col("f").alias("above")).union(above.select("sid", "f"))
            over = over.groupBy("id").agg(F.max("above").alias("above"))
            level = level.join(over, "id", "left").where(F.col("above").isNull() | (COVER_DEN * F.col("above") < COVER_NUM * F.col("f")))
        cuts = [_cut(k, i + 2 - k) for k in range(1, i + 2)]
        best = F.array_min(F.array(*cuts)) if len(cuts) > 1 else cuts[0]
        level = level.select("lang", "phrase", F.col("f").alias("a"), best.alias("cut")).select(
            "lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
        scored = scored.union(level) if scored else level
    return scored, totals


def _cut(k: int, rest: int):
    """(score, k, l, r) of cutting behind the first k words; structs compare by score, then by k."""
    wide = "decimal(38,0)"
    a, left, right = F.col("f"), F.col("heads")[k - 1], F.col("tails")[rest - 1]
    score = F.call_function("div", F.lit(2_000_000).cast("decimal(18,0)") * a.cast("decimal(20,0)"), left.cast(wide) + right.cast(wide))
    return F.struct(score.cast("bigint").alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r"))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, shard_words: int = SHARD_WORDS, bucket_phrases: int = BUCKET_PHRASES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases."""
    scored, totals = candidates(docs, least, shard_words, bucket_phrases)
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # a language's phrases are cut to the first in parts before they meet
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    first = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))).where(F.col("rank") <= top)
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("bigint")).where(F.col("rank") <= top)
    return first.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM d),
g AS (SELECT lang, m, w[i:i + m - 1] AS w FROM (
  SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM (SELECT lang, w, unnest([1, 2, 3, 4]) AS m FROM p) WHERE len(w) >= m)),
f AS (SELECT lang, m, w, count(*) AS f FROM g GROUP BY ALL),
c AS (SELECT lang, m, w, f AS a FROM f WHERE m >= 2 AND f >= 30),
cuts AS (SELECT lang, m, w, a, unnest(range(1, m)) AS k FROM c),
s AS (
  SELECT cuts.*, x.f AS l, y.f AS r, (2000000::HUGEINT * a // (x.f::HUGEINT + y.f))::BIGINT AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.w = cuts.w[1:k] JOIN f y ON y.lang = cuts.lang AND y.w = cuts.w[k + 1:cuts.m]),
least AS (SELECT lang, m, w, any_value(a) AS a, min((score, k, l, r)) AS b FROM s GROUP BY ALL),
inner_ AS (
  SELECT lang, w[i:i + q - 1] AS w, max(a) AS above FROM (
    SELECT lang, m, w, a, q, unnest(range(1, m - q + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS q FROM c))
  GROUP BY ALL),
kept AS (
  SELECT least.lang, array_to_string(least.w, ' ') AS phrase, a, b[1] AS score, b[3] AS l, b[4] AS r
  FROM least LEFT JOIN inner_ ON inner_.lang = least.lang AND inner_.w = least.w WHERE above IS NULL OR 100 * above < 80 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT r.lang, rank, phrase, a, l, r.r AS r, n, score FROM ranked r
JOIN (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang) t ON t.lang = r.lang WHERE rank <= 2000
"""


@query("op11_phrase_collocations", _SQL)
def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))
