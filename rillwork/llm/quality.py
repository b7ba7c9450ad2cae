"""Line-first cleaning of texts.

Each line is judged by itself and beside its neighbours: a line fails as symbols (several words, and hardly any letters beside
symbols), as punctuation-poor (a long line with next to no sentence punctuation), as navigation (its words parted by bars or arrows,
or one of RUN_LINES or more short lines on end that all end without punctuation, empty lines aside), as boilerplate (a short line that
is fixed phrases for the most part) or as a repeat of an earlier line. Failed lines go; a document that loses more than MAX_LOST of
its word characters is rejected, as is one that fails the base rules. Both are judged on the text as it came.

Punctuation is that of many scripts, after a word or, for scripts without spaces, anywhere; closing quotes and brackets after it don't
matter. Thai and Lao lines, which part sentences with spaces, are not judged by it.

Defined cases: a null or empty text has no words and fails the base rules; repeated rows and ties each give their own row; a
null identifier stays null; an empty table gives an empty result; other columns pass through clean() and don't matter to judged().
All work is per row, so there is no hot key; a text of any length is read in whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillwork.llm.common import slices, text_of, unused
from rillwork.llm.words import Words, mix, span_hashes, words

MIN_WORDS = 50
MAX_LOST = 0.5
#: Share of symbols in a line's characters from which it fails, and of bar-like words.
MAX_SYMBOLS, MAX_BARS = 0.2, 0.2
#: Words from which a line is long, and the most words for each mark of punctuation in it.
LONG_WORDS, WORDS_A_MARK = 30, 60
#: Most words and word characters of a menu entry, and how many on end make a menu.
SHORT_WORDS, SHORT_CHARS, RUN_LINES = 5, 40, 5
#: Most words of a line of boilerplate, and the share of its word characters that phrases hold more than.
BOILERPLATE_WORDS, BOILERPLATE_SHARE = 20, 0.5

#: Phrases, in lower case, that mark a line of boilerplate.
BOILERPLATE = (
    "all rights reserved",
    "cookie policy",
    "enable javascript",
    "lorem ipsum",
    "privacy policy",
    "sign up for our newsletter",
    "subscribe to our newsletter",
    "terms of use",
    "use of cookies",
)
#: Words that part the entries of a menu.
BARS = ("|", "»", "›", "•", "·", ">", ">>", "/")

#: Punctuation of sentences and their parts: after a word; in scripts without spaces; what may close after it.
MARKS, WIDE_MARKS, CLOSERS = ".!?:;,…،؛؟۔։।॥།።፣၊။។‽", "。、！，．：；？｡､", "\"')]}»”’›」』）】*_"

_PHRASE = re.compile("|".join(sorted(map(re.escape, BOILERPLATE), key=len, reverse=True)))

SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
VERDICTS = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, lost_share double, n_lines bigint, n_failed_lines bigint"
_BAR_HASHES = words(pa.array(BARS)).hash


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values between neighbouring bounds."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def repeated_words(w: Words, size: int = 3) -> np.ndarray:
    """For each row, the words inside windows of `size` words that its text holds twice or more."""
    last = np.flatnonzero(w.row[size - 1 :] == w.row[: len(w.row) - size + 1]) if len(w.row) >= size else np.zeros(0, np.int64)
    h = mix(w.row[last].astype(np.uint64))
    for k in range(size):
        h = mix(h * np.uint64(3) + w.hash[last + k])
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(w.row), bool)
    for k in range(size):
        covered[last[twice] + k] = True
    return np.bincount(w.row[covered], minlength=w.rows)


def _lines(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first byte and end of each line; a row has a line more than line feeds."""
    feeds = np.flatnonzero(w.data == 10)
    start = np.sort(np.concatenate([w.bounds[:-1], feeds + 1]), kind="stable")
    end = np.sort(np.concatenate([feeds, w.bounds[1:]]), kind="stable")
    row = np.repeat(np.arange(w.rows), np.bincount(np.searchsorted(w.bounds, feeds, side="right") - 1, minlength=w.rows) + 1)
    return row, start, end


def _repeats(row: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether an earlier line of the row has the same hash."""
    order = np.lexsort((np.arange(len(h)), h, row))
    again = np.zeros(len(h), bool)
    again[order[1:]] = (h[order][1:] == h[order][:-1]) & (row[order][1:] == row[order][:-1])
    return again


def _endings(data: np.ndarray, at: np.ndarray, chars: str) -> np.ndarray:
    """Bytes of the character among `chars` that ends with the byte at each place, or 0."""
    out = np.zeros(len(at), np.int64)
    for size in (1, 2, 3):
        codes = [int.from_bytes(c.encode(), "big") for c in chars if len(c.encode()) == size]
        code = np.zeros(len(at), np.int64)
        for k in range(size):
            code = code * 256 + data[np.maximum(at - (size - 1 - k), 0)]
        out[np.isin(code, codes)] = size
    return out


def _punctuation(w: Words, line_of: np.ndarray, lines: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each line: marks of punctuation, whether its last word ends with one, whether it has Thai or Lao letters."""
    at, open_ = w.end - 1, np.ones(len(w.end), bool)
    for _ in range(3):
        size = np.where(open_, _endings(w.data, at, CLOSERS), 0)
        open_ = (size > 0) & (at - size >= w.start)
        at = np.where(open_, at - size, at)
    ends = _endings(w.data, at, MARKS + WIDE_MARKS) > 0
    high = np.flatnonzero(w.data >= 0x80)
    wide = high[_endings(w.data, high, WIDE_MARKS) > 0]
    lead = high[w.data[high] == 0xE0]
    second = w.data[np.minimum(lead + 1, len(w.data) - 1)]
    spaced = lead[(second >= 0xB8) & (second <= 0xBB)]
    word_of = lambda places: np.searchsorted(w.start, places, side="right") - 1
    inside = word_of(wide)
    inside = inside[~(ends[inside] & (at[inside] == wide))]  # those at a word's end count already
    marks = np.bincount(line_of[ends], minlength=lines) + np.bincount(line_of[inside], minlength=lines)
    ended = np.zeros(lines, bool)
    ended[line_of] = ends  # the last word of a line stays
    thai = np.bincount(line_of[word_of(spaced)], minlength=lines) > 0
    return marks, ended, thai


def _menus(row: np.ndarray, entry: np.ndarray, full: np.ndarray) -> np.ndarray:
    """Whether each line is among RUN_LINES or more entries on end; full: the lines with words."""
    out = np.zeros(len(row), bool)
    if len(full):
        new = np.ones(len(full), bool)
        new[1:] = (row[full][1:] != row[full][:-1]) | (entry[full][1:] != entry[full][:-1])
        run = np.cumsum(new) - 1
        out[full] = entry[full] & (np.bincount(run)[run] >= RUN_LINES)
    return out


def _judge(texts: pa.Array) -> tuple[dict[str, np.ndarray], tuple[np.ndarray, ...]]:
    """Verdict columns of each row, and all lines: row, start, end, whether it failed; and the bytes that they are in."""
    w = words(texts)
    n = w.counts()
    starts_char = (w.data & 0xC0) != 0x80
    chars = np.concatenate([[0], np.cumsum(starts_char, dtype=np.int64)])
    word_chars = chars[w.end] - chars[w.start]
    symbols = np.concatenate([[0], np.cumsum(SYMBOLS[w.data], dtype=np.int64)])
    row, start, end = _lines(w)
    line_of = np.searchsorted(start, w.start, side="right") - 1
    held = np.bincount(line_of, minlength=len(start))  # words of a line
    full = np.flatnonzero(held)
    h = np.zeros(len(start), np.uint64)
    h[full] = span_hashes(w.data, start[full], end[full])
    dup = np.zeros(len(start), bool)
    dup[full] = _repeats(row[full], h[full])
    line_chars = np.bincount(line_of, weights=word_chars, minlength=len(start))
    bars = np.bincount(line_of, weights=np.isin(w.hash, _BAR_HASHES), minlength=len(start))
    failed = dup.copy()
    failed |= (held >= 3) & (symbols[end] - symbols[start] > MAX_SYMBOLS * np.maximum(line_chars, 1))
    failed |= (held >= 5) & (bars > MAX_BARS * held)
    marks, ended, thai = _punctuation(w, line_of, len(start))
    failed |= (held >= LONG_WORDS) & (marks * WORDS_A_MARK < held) & ~thai
    failed |= _menus(row, (held > 0) & (held <= SHORT_WORDS) & (line_chars <= SHORT_CHARS) & ~ended & ~thai, full)
    low = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    some = np.zeros(w.rows, bool)
    for phrase in BOILERPLATE:
        some |= pc.match_substring(low, phrase).to_numpy(zero_copy_only=False)
    for k in np.flatnonzero(some[row] & (held > 0) & (held <= BOILERPLATE_WORDS)):
        phrases = _PHRASE.findall(w.data[start[k] : end[k]].tobytes().decode().lower())
        failed[k] |= sum(len(x.replace(" ", "")) for x in phrases) > BOILERPLATE_SHARE * line_chars[k]
    total = np.bincount(w.row, weights=word_chars, minlength=w.rows)
    lost = np.bincount(row, weights=line_chars * failed, minlength=w.rows)
    repeat = repeated_words(w)
    base = (n < MIN_WORDS) | (100 * repeat > 50 * n)
    share = lost / np.maximum(total, 1)
    return {
        "n_words": n,
        "word_chars": total.astype(np.int64),
        "n_symbols": _sums(SYMBOLS[w.data], w.bounds),
        "n_dup_lines": np.bincount(row[dup], minlength=w.rows),
        "n_repeat_words": repeat,
        "base_failed": base,
        "kept": ~base & (share <= MAX_LOST),
        "lost_share": share,
        "n_lines": np.bincount(row[full], minlength=w.rows),
        "n_failed_lines": np.bincount(row[failed & (held > 0)], minlength=w.rows),
    }, (row, start, end, failed, w.data)


def _verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text"):
        found, _ = _judge(b.column("text"))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, found.values())], names=["doc_id", *found])


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts, base_failed, kept, the share of word characters its failed lines hold, lines and failed lines."""
    return docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(_verdicts, VERDICTS)


#: Bytes of texts that clean() judges at a time, beside whatever else their rows hold; a longer text is judged alone.
CLEAN_BYTES = 1 << 20


def _cleaned(text: str, clean: str, kept: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text, CLEAN_BYTES):
            texts = b.column(text)
            found, (row, start, end, failed, data) = _judge(texts)
            lossy = np.unique(row[failed & (end >= start)])
            out = pc.fill_null(texts, "")
            if len(lossy):
                values = out.to_pylist()
                for i in lossy:
                    of = slice(*np.searchsorted(row, [i, i + 1]))
                    values[i] = "\n".join(data[s:e].tobytes().decode() for s, e, f in zip(start[of], end[of], failed[of], strict=True) if not f)
                out = pa.array(values, pa.string())
            yield b.drop_columns([text]).append_column(clean, out).append_column(kept, pa.array(found["kept"]))

    return run


def clean(docs: DataFrame, text_col: str = "text", remove_lines: bool = False) -> DataFrame:
    """The documents that stay, with all their columns; with remove_lines, their texts without the failed lines."""
    text, cleaned, kept = (unused(docs, x) for x in ("_text", "_clean", "_kept"))
    schema = T.StructType([*docs.schema.fields, T.StructField(cleaned, T.StringType()), T.StructField(kept, T.BooleanType())])
    out = docs.withColumn(text, text_of(text_col)).mapInArrow(_cleaned(text, cleaned, kept), schema).filter(F.col(kept))
    return out.select(*(F.col(cleaned).alias(c) if remove_lines and c == text_col else F.col(f"`{c}`") for c in docs.columns))
