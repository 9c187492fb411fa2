"""Line-first cleaning: rules judge lines, failing lines go, documents losing too much go too.

Words are runs of characters other than ``\\x20`` and ``\\x09``-``\\x0D``; a line is a piece of the
text between ``\\n``. A line with a word fails if one of these holds (w words, c code points in
words):

* symbols: more than a tenth of c are ``#*$%&|<>``;
* navigation: at least a fifth of the words are separators such as ``|`` or ``>``;
* shouting: w >= 3 and more capital than small Latin letters;
* repetition: w >= 4 and more than half of the words equal the word before;
* punctuation: w >= 40 without any of ``.!?,;:``;
* boilerplate: w <= 40 and a phrase of ``BOILERPLATE``.

A document is kept if the base rules hold (at least ``min_words`` words; at most 30 in 100 words
inside repeated eight-word windows) and the failing lines hold at most ``max_lost`` hundredths of
its word characters. A null or empty text has no words and fails the base rules. Repeated rows are
judged one by one and alike; columns other than the text pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import query
from .words import Block, blocks, covered, per_document

# fixed values
SYMBOLS = "#*$%&|<>"
PUNCTUATION = ".!?,;:"
SEPARATORS = ["|", "||", ">", ">>", "/", "-", "--", "·", "»", "›", "•", "–", "—"]
BOILERPLATE = [
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy",
    "accept cookies", "uses cookies", "enable javascript", "click here", "subscribe to our newsletter",
    "sign up for", "log in to", "skip to content", "back to top", "powered by", "lorem ipsum",
]
MIN_WORDS, REPEAT_WINDOW, MAX_REPEAT, MAX_LOST = 20, 8, 30, 30
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_failed_lines", "failed_chars"]


def _bytes(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars.encode())] = True
    return table


IS_SYMBOL, IS_PUNCTUATION = _bytes(SYMBOLS), _bytes(PUNCTUATION)
IS_CAPITAL = _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
IS_SMALL = _bytes("abcdefghijklmnopqrstuvwxyz")


def _separator_hashes() -> np.ndarray:
    batch = pa.record_batch({"text": [" ".join(SEPARATORS)]})
    return next(blocks(batch, "text"))[2].hashes()


def _between(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Flags set between consecutive edges, of which the first is 0 and the last the end."""
    out = np.zeros(len(edges) - 1, np.int64)
    full = edges[1:] > edges[:-1]
    if full.any():
        out[full] = np.add.reduceat(flags, edges[:-1][full], dtype=np.int64)
    return out


def line_edges(block: Block) -> np.ndarray:
    """Byte offsets of all line starts, with the end of the block."""
    breaks = np.flatnonzero(block.data == 0x0A) + 1
    return np.sort(np.concatenate([block.text_at, breaks]))


def failing_lines(block: Block, hashes: np.ndarray, edges: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """Whether each line fails a rule; lines without words never do."""
    data = block.data
    words_at = np.searchsorted(block.starts, edges)
    words = np.diff(words_at)
    size = _between(chars, edges)
    latin = np.zeros(len(data), bool)  # second byte of U+00C0 to U+00FF
    latin[1:] = data[:-1] == 0xC3
    capital = IS_CAPITAL[data] | latin & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
    small = IS_SMALL[data] | latin & (data >= 0x9F) & (data <= 0xBF) & (data != 0xB7)
    same = np.zeros(len(hashes), bool)
    same[1:] = hashes[1:] == hashes[:-1]
    same[words_at[:-1][words > 0]] = False
    symbols = _between(IS_SYMBOL[data], edges)
    separators = _between(np.isin(hashes, _separator_hashes()), words_at)
    phrase = np.zeros(len(words), bool)
    low = data.tobytes().lower()
    for text in map(str.encode, BOILERPLATE):
        at = low.find(text)
        while at >= 0:
            line = np.searchsorted(edges, at, "right") - 1
            phrase[line] |= at + len(text) <= edges[line + 1]
            at = low.find(text, at + 1)
    bad = 10 * symbols > size
    bad |= 5 * separators >= words
    bad |= (words >= 3) & (_between(capital, edges) > _between(small, edges))
    bad |= (words >= 4) & (2 * _between(same, words_at) > words)
    bad |= (words >= 40) & (_between(IS_PUNCTUATION[data], edges) == 0)
    bad |= (words <= 40) & phrase
    return bad & (words > 0)


def repeated_lines(text: bytes) -> int:
    lines = text.split(b"\n")
    if len(set(lines)) == len(lines):
        return 0
    lines = [x for x in lines if x.split()]
    return len(lines) - len(set(lines))


def repeat_words(block: Block, hashes: np.ndarray) -> np.ndarray:
    """Words of each document inside windows that occur twice or more in it."""
    at, keys = block.windows(hashes, REPEAT_WINDOW)
    own = np.searchsorted(block.bounds, at, "right") - 1
    # windows of one document share its number in the key, so only they can be equal
    keys = keys * np.uint64(0x9E3779B97F4A7C15) + own.astype(np.uint64)
    order = np.argsort(keys)
    equal = keys[order][1:] == keys[order][:-1]
    again = np.zeros(len(keys), bool)
    again[order[1:]] |= equal
    again[order[:-1]] |= equal
    return per_document(covered(at[again], REPEAT_WINDOW, len(hashes)), block)


def _judge(block: Block) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    hashes = block.hashes()
    chars = ((block.data & 0xC0) != 0x80) & ~_spaces(block.data)
    edges = line_edges(block)
    bad = failing_lines(block, hashes, edges, chars)
    owner = np.searchsorted(block.text_at, edges[:-1], "right") - 1
    n = len(block.bounds) - 1
    raw = block.data.tobytes()
    counts = {
        "n_words": block.n_words,
        "word_chars": _between(chars, block.text_at),
        "n_symbols": _between(IS_SYMBOL[block.data], block.text_at),
        "n_dup_lines": np.array([repeated_lines(raw[a:b]) for a, b in zip(block.text_at, block.text_at[1:])]),
        "n_repeat_words": repeat_words(block, hashes),
        "n_failed_lines": np.bincount(owner[bad], minlength=n),
        "failed_chars": np.bincount(owner[bad], _between(chars, edges)[bad], n).astype(np.int64),
    }
    return counts, edges, bad


def _spaces(data: np.ndarray) -> np.ndarray:
    return (data == 0x20) | (data >= 0x09) & (data <= 0x0D)


def _clean(block: Block, edges: np.ndarray, bad: np.ndarray) -> list[str]:
    """Texts without their failing lines."""
    raw = block.data.tobytes()
    owner = np.searchsorted(block.text_at, edges[:-1], "right") - 1
    hit = np.zeros(len(block.text_at) - 1, bool)
    hit[owner[bad]] = True
    out = []
    for i, (a, b) in enumerate(zip(block.text_at, block.text_at[1:])):
        text = raw[a:b]
        if hit[i]:
            lines = slice(*np.searchsorted(edges, [a, b]))
            gone = {int(e) for e in edges[lines][bad[lines]]}
            at, left = a, []
            for line in text.split(b"\n"):
                if at not in gone:
                    left.append(line)
                at += len(line) + 1
            text = b"\n".join(left)
        out.append(text.decode())
    return out


def judge_documents(
    docs: DataFrame, text: str = "text", clean: str | None = None,
    min_words: int = MIN_WORDS, max_lost: int = MAX_LOST,
) -> DataFrame:
    """The rows with their counts, ``base_failed`` and ``kept``; ``clean`` names a column for the cleaned text.

    Columns of the same name are replaced.
    """
    added = [*COUNTS, *([clean] if clean else [])]
    rest = [c for c in docs.columns if c not in {*added, "base_failed", "kept"} or c == text]
    given = docs.select(*[F.col(f"`{c}`") for c in rest])
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema if f.name not in added),
                        *(f"`{c}` bigint" for c in COUNTS), *([f"`{clean}` string"] if clean else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, block in blocks(batch, text):
                counts, edges, bad = _judge(block)
                part = batch.slice(start, end - start)
                out = {n: part.column(n) for n in part.schema.names if n not in added}
                out |= {n: pa.array(v, pa.int64()) for n, v in counts.items()}
                if clean:
                    out[clean] = pa.array(_clean(block, edges, bad), pa.string())
                yield pa.record_batch(out)

    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    lost = 100 * F.col("failed_chars") > max_lost * F.col("word_chars")
    return given.mapInArrow(run, fields).withColumns({"base_failed": base, "kept": ~base & ~lost})


_W = r"[^\x20\x09-\x0D]+"
_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_W}') AS w FROM documents),
lines AS (
  SELECT doc_id, i, string_split(t, chr(10))[i] AS x
  FROM (SELECT doc_id, t, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS i FROM d)),
worded AS (
  SELECT *, regexp_extract_all(x, '{_W}') AS w,
    length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g')) AS c,
    translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
  FROM lines WHERE regexp_matches(x, '{_W}')),
judged AS (
  SELECT *, 10 * length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) > c
    OR 5 * len(list_filter(w, lambda s: s IN ({", ".join(f"'{s}'" for s in SEPARATORS)}))) >= len(w)
    OR (len(w) >= 3 AND length(regexp_replace(x, '[^A-ZÀ-ÖØ-Þ]', '', 'g'))
                      > length(regexp_replace(x, '[^a-zß-öø-ÿ]', '', 'g')))
    OR (len(w) >= 4 AND 2 * len(list_filter(range(2, len(w) + 1), lambda k: w[k] = w[k - 1])) > len(w))
    OR (len(w) >= 40 AND NOT regexp_matches(x, '[.!?,;:]'))
    OR (len(w) <= 40 AND ({" OR ".join(f"contains(low, '{p}')" for p in BOILERPLATE)})) AS bad
  FROM worded),
per_line AS (
  SELECT doc_id, count(*) - count(DISTINCT x) AS n_dup_lines, count(*) FILTER (bad) AS n_failed_lines,
    coalesce(sum(c) FILTER (bad), 0)::BIGINT AS failed_chars
  FROM judged GROUP BY doc_id),
windows AS (
  SELECT doc_id, s, array_to_string(w[s:s + 7], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS s FROM d WHERE len(w) >= 8)),
again AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY doc_id, k) AS n FROM windows) WHERE n >= 2),
per_doc AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest(range(s, s + 8)) AS p FROM again) GROUP BY doc_id),
counted AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    coalesce(n_failed_lines, 0)::BIGINT AS n_failed_lines, coalesce(failed_chars, 0)::BIGINT AS failed_chars
  FROM d LEFT JOIN per_line USING (doc_id) LEFT JOIN per_doc USING (doc_id))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT 100 * failed_chars > {MAX_LOST} * word_chars AS kept
FROM counted
"""


@query("op1_quality_rules", _SQL)
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge_documents(docs).select("doc_id", *COUNTS, "base_failed", "kept")
