"""Secrets in texts: three fixed patterns, and strings that a primed zstandard coder finds new.

A candidate is a longest stretch of sixteen or more letters, digits and + / _ -, with up to two = behind it, that has a digit, touches no span of a pattern and
stands at most 48 code points behind a word of SENSITIVE. The coder's dictionary are common identifiers (IDENTIFIERS) behind those that the corpus itself
uses: all of at least one in a thousand of its documents, so no more than a thousand times what a document has on average. A candidate costs the bytes that it adds to
the compressed code around it (256 code points on both sides, without other copies of it); it is reported where these are nearly as many as a random string
of its kinds of characters needs.

Defined cases: a null or empty text has no spans; each row has a result of its own, also where identifiers are null or repeat; an empty table gives an empty
result; other columns don't matter, whatever their names; texts and spans of any length are whole.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwork.llm.common import slices
from rillwork.llm.words import buffer

# The patterns of the three kinds, and the least length of what they must hold.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "novel")
LEAST_ASSIGNED, LEAST_ACCESS = 6, 20

CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
SENSITIVE = re.compile("key|token|secret|passw|pwd|credential|auth|bearer|private|signature|session|cookie|certificate", re.IGNORECASE | re.ASCII)
BEFORE, AROUND, LEVEL, NEARLY = 48, 256, 3, 0.95
#: Documents that must have an identifier, as a share of all.
SHARE = 1000
#: Words that code is made of, whatever the corpus.
IDENTIFIERS = """
abstract access account action address admin agent alias allow amount append application argument array assert async attribute author backend background
backup balance base batch boolean bucket buffer build button cache callback cancel channel char character check class click client close cloud cluster code
collection color column command comment commit common component config configuration connect connection console constant container content context
continue control controller cookie copy count create current custom data database date debug default delete deploy description dest device dict directory
disable display document domain double driver dynamic edit element email empty enable encode endpoint engine entity entry enum environment error event
""".split()


@lru_cache(1)
def coder(dictionary: bytes) -> zstandard.ZstdCompressor:
    primed = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    primed.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)


def marginal_bytes(dictionary: bytes, around: str, candidate: str) -> int:
    """What the candidate adds to the compressed text around it."""
    compress = coder(dictionary).compress
    return len(compress(f"{around}\n{candidate}".encode("utf-8", "surrogatepass"))) - len(compress(f"{around}\n".encode("utf-8", "surrogatepass")))


def bits_of_random(candidate: str) -> float:
    """Bits that a random string of this length and these kinds of characters needs."""
    core = candidate.rstrip("=")
    if re.fullmatch("[0-9]+", core):
        kinds = 10
    elif re.fullmatch("[0-9a-f]+|[0-9A-F]+", core):
        kinds = 16
    else:
        kinds = sum(n for p, n in (("[0-9]", 10), ("[a-z]", 26), ("[A-Z]", 26)) if re.search(p, core)) + len(set(core) & set("+/_-"))
    return len(core) * math.log2(kinds)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the patterns find, in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGNED]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def novel_spans(text: str, base: list[tuple[int, int, int]], dictionary: bytes) -> list[tuple[int, int, int]]:
    found = []
    ends = np.maximum.accumulate([e for _, _, e in base]) if base else np.zeros(0)
    starts = np.array([s for s, _, _ in base])
    for m in CANDIDATE.finditer(text):
        s, e = m.span()
        if not SENSITIVE.search(text, max(0, s - BEFORE), s) or not re.search("[0-9]", m[0]):
            continue
        first = int(np.searchsorted(ends, s, side="right")) if base else 0
        if first < len(base) and starts[first:].min() < e:
            continue
        around = (text[max(0, s - AROUND) : s] + text[e : e + AROUND]).replace(m[0], "")
        if 8 * marginal_bytes(dictionary, around, m[0]) >= NEARLY * bits_of_random(m[0]):
            found.append((s, 3, e))
    return found


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _identifiers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(identifier, documents) of each batch; the number of all documents stands beside null."""
    for b in slices(batches, "text", 4 << 20):
        data, bounds = buffer(b.column("text"))
        low = data | np.uint8(32)
        inside = ((low >= 97) & (low <= 122)) | (data == 95)
        edge = np.zeros(len(data) + 1, bool)
        edge[bounds] = True
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:-1]
        ends[:-1] &= ~inside[1:] | edge[1:-1]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        long = (end - start >= 4) & (end - start <= 64)
        at = np.cumsum(inside)
        flat = pa.py_buffer(data[inside])
        offsets = np.append(at[start] - 1, at[-1] if len(at) else 0).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), flat]).filter(pa.array(long))
        coded = words.dictionary_encode()
        row = np.searchsorted(bounds, start[long], side="right") - 1
        size = max(1, len(coded.dictionary))
        pair = np.unique(row * size + coded.indices.to_numpy())
        count = np.bincount(pair % size, minlength=len(coded.dictionary)) if len(pair) else np.zeros(0, np.int64)
        names = coded.dictionary.cast(pa.binary()).cast(pa.string()).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([*names, None], pa.string()), pa.array(np.append(count, b.num_rows).astype(np.int64))], names=["identifier", "documents"])


def dictionary_of(docs: DataFrame) -> bytes:
    """The coder's dictionary: common identifiers, then the corpus's own, the most frequent last, where they are nearest."""
    seen = docs.select("text").mapInArrow(_identifiers, "identifier string, documents bigint").groupBy("identifier").agg(F.sum("documents").alias("documents"))
    total = docs.count()
    often = seen.filter(F.col("identifier").isNotNull() & (F.col("documents") * SHARE >= total) & (F.col("documents") > 1)).collect()
    own = [r["identifier"] for r in sorted(often, key=lambda r: (r["documents"], r["identifier"]))]
    return " ".join([*IDENTIFIERS, *own]).encode()


RESULT = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, n_novel bigint, base_sha256 string, spans string"


def found_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """RESULT of each document: numbers of spans by kind, a digest of the patterns' spans, and all spans as kind:start:end in code points."""
    own = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(dictionary_of(own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            rows = []
            for text in b.column("text").to_pylist():
                base = base_spans(text or "")
                novel = novel_spans(text or "", base, shared.value)
                kinds = [k for _, k, _ in base]
                rows.append((kinds.count(0), kinds.count(1), kinds.count(2), len(novel), hashlib.sha256(spelled(base).encode()).hexdigest(), spelled(sorted(base + novel))))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(list(c), t) for c, t in zip(columns, [pa.int64()] * 4 + [pa.string()] * 2, strict=True))], names=[c.split()[0] for c in RESULT.split(", ")]
            )

    return own.mapInArrow(run, RESULT)
