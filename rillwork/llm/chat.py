"""Chat conversations as training texts in budgeted windows.

Prefix sums of the turns' tokens choose turn-aligned spans: a window takes turns until the next one would pass the budget, less
what the system turn and the repeated history need. Every window opens with the conversation's system turn, repeats at most
`history` turns before its first new turn as far as they fit, and its loss mask covers the new assistant turns alone, so each
target counts once over all windows. A single turn over the budget has a window of its own and is never cut.

Template: <|role|>, line feed, escaped text, <|end|>, line feed. Inside texts and roles a mark parts the first character of any
control string from its rest, and the mark itself is doubled up, so reading back is exact.

Defined cases: a null text or role is empty; null turns come first; ties go by role and text, repeated rows are turns of their
own; rows of a null conversation are one conversation. Turns are numbered within their conversation, and blocks of `block` of them bound
a group, so a huge conversation is spread over tasks, whatever its turn numbers are; a window doesn't cross a block, but its history
does. An empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rillwork.llm.common import attach, stored, text_of
from rillwork.llm.tokens import default_vocabulary, encoding

#: Control strings of common chat templates that a text must not smuggle in.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|", "|>")
MARK = "\u2063"
_SPLIT = re.compile("|".join(f"{re.escape(s[0])}(?={re.escape(s[1:])})" for s in CONTROL))
_TURN = re.compile(r"<\|([^|]*(?:\|(?!>)[^|]*)*)\|>\n(.*?)<\|end\|>\n", re.S)
_UNMARK = re.compile(f"{MARK}([ec])")

WINDOWS = "conv_id bigint, block bigint, window int, n_repeated int, n_new int, n_tokens bigint, text string, loss array<struct<start: int, stop: int>>"


def escape(text: str) -> str:
    return _SPLIT.sub(lambda m: m[0] + MARK + "c", text.replace(MARK, MARK + "e"))


def unescape(text: str) -> str:
    return _UNMARK.sub(lambda m: MARK if m[1] == "e" else "", text)


def turns_of(text: str) -> list[tuple[str, str]]:
    """Role and text of each turn of a formatted text."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(text)]


def loss_texts(text: str, spans) -> list[str]:
    """The unescaped texts under the loss mask."""
    return [unescape(text[s["start"] : s["stop"]]) for s in spans]


def _window(turns: list, system: list, first: int, last: int, keep: int) -> tuple[int, int, str, list[dict]]:
    """Formatted text of turns first..last-1 with repeated ones before them."""
    repeated = [t for t in system if t[0] < first and t[0] < keep] + [t for t in turns if keep <= t[0] < first]
    out, loss, at = [], [], 0
    for t in [*repeated, *(t for t in turns if first <= t[0] < last)]:
        head, body = f"<|{escape(t[1])}|>\n", escape(t[2])
        out += [head, body, "<|end|>\n"]
        if t[0] >= first and t[1] == "assistant":
            loss.append({"start": at + len(head), "stop": at + len(head) + len(body)})
        at += len(head) + len(body) + 8
    return len(repeated), last - first, "".join(out), loss


def _windows(budget: int, history: int, vocabulary: str):
    def spans(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoding(vocabulary).encode_to_numpy
        tokens = lambda t: len(encode(formatted(t["role"], t["text"]), disallowed_special=()))
        for frame in frames:
            rows = []
            for conv, block, own, carried, system in frame.itertuples(index=False):
                turns = [(i - len(carried), t["role"], t["text"], tokens(t)) for i, t in enumerate([*carried, *own])]
                fixed = [(-len(carried) - 1, t["role"], t["text"], tokens(t)) for t in system] if block else turns[:1] if turns[0][1] == "system" else []
                prefix = [0]
                for t in turns:
                    prefix.append(prefix[-1] + t[3])
                cost = lambda a, b, p=prefix, k=len(carried): p[b + k] - p[a + k]
                first, window, n = 0, 0, len(own)
                while first < n:
                    extra = sum(t[3] for t in fixed if t[0] < first)
                    keep = first
                    while keep > max(-len(carried), first - history) and extra + cost(keep - 1, first) <= budget // 2 and extra + cost(keep - 1, first + 1) <= budget:
                        keep -= 1
                    if keep == 0 and not block:
                        extra = 0  # the system turn is among the repeated ones
                    last = first + 1
                    while last < n and extra + cost(keep, last + 1) <= budget:
                        last += 1
                    rows.append((conv, block, window, *(x := _window(turns, fixed, first, last, keep))[:2], extra + cost(keep, last), *x[2:]))
                    first, window = last, window + 1
            yield pd.DataFrame(rows, columns=["conv_id", "block", "window", "n_repeated", "n_new", "n_tokens", "text", "loss"])

    return spans


def formatted(role: str, text: str) -> str:
    """A turn as it stands in a window. A turn's tokens are the byte-level encoder's of this; it never joins bytes over the line feed
    and bracket between two turns, so a window has as many tokens as its turns together."""
    return f"<|{escape(role)}|>\n{escape(text)}<|end|>\n"


def numbered(turns: DataFrame, block: int) -> DataFrame:
    """Adds `block`, the turn's place in its conversation, in order of turn, role and text, by blocks of that many.

    Places are counted within stretches of turn numbers; a stretch that repeated numbers make long is parted by turn, role and the
    beginning of the text. What a stretch has before it is a running sum over stretches."""
    key = lambda *c: F.concat_ws("\x01", *(F.coalesce(F.col(x).cast("string"), F.lit("\x02")) for x in c))
    total = turns.count()
    turns = turns.withColumn("stretch", F.floor(F.col("turn") / block)).withColumn("_key", key("conv_id", "stretch"))
    sizes = turns.groupBy("_key", "conv_id", "stretch").agg(F.count("*").alias("_n"))
    long = sizes.filter(F.col("_n") > 4 * block).select("_key", "_n")
    at = F.struct("turn", "role", F.substring("text", 1, 8).alias("text"))
    if long.isEmpty():
        turns = turns.withColumn("part", F.lit(None).cast(turns.select(at.alias("p")).schema["p"].dataType))
    else:
        turns = attach(turns, long, "_key", "_n", total).withColumn("part", F.when(F.col("_n").isNotNull(), at)).drop("_n")
        turns = turns.withColumn("_key", F.concat_ws("\x01", "_key", F.sha2(F.to_json("part"), 256)))
        sizes = turns.groupBy("_key", "conv_id", "stretch", "part").agg(F.count("*").alias("_n"))
    order = ("stretch", "part") if "part" in sizes.columns else ("stretch",)
    before = Window.partitionBy("conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("_key", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    place = F.row_number().over(Window.partitionBy("_key").orderBy("turn", "role", "text")) - 1
    placed = attach(turns.withColumn("_place", place), stored(bases, "bases"), "_key", "_n", total)
    return placed.withColumn("block", F.floor((F.col("_base") + F.col("_place")) / block)).drop("_key", "_n", "_base", "_place", "stretch", "part")


def chat_windows(conversations: DataFrame, budget: int = 2048, history: int = 2, block: int = 1024, vocabulary: str | None = None) -> DataFrame:
    """Formatted windows of each conversation: conv_id, block, window, n_repeated, n_new, n_tokens, text, loss (spans of code points)."""
    own = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), text_of("role").alias("role"), text_of("text").alias("text"))
    turns = numbered(own, block)
    blocks = stored(turns.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("own")), "blocks")
    # what a block repeats from the one before it, and the conversation's first turn if that is the system's
    edges = blocks.select("conv_id", "block", F.slice("own", F.greatest(F.lit(1), F.size("own") - history + 1), history).alias("tail"), F.slice("own", 1, 1).alias("head"))
    key = lambda b: F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("none")), b)
    tails = edges.select(key(F.col("block") + 1).alias("_at"), F.col("tail").alias("carried"))
    heads = edges.filter("block = 0").select(F.coalesce(F.col("conv_id").cast("string"), F.lit("none")).alias("_of"), F.filter("head", lambda t: t["role"] == "system").alias("system"))
    sizes = blocks.groupBy(F.coalesce(F.col("conv_id").cast("string"), F.lit("none")).alias("_of")).agg(F.count("*").alias("_n"))
    rows = blocks.withColumn("_at", key(F.col("block"))).join(tails, "_at", "left").withColumn("_of", F.coalesce(F.col("conv_id").cast("string"), F.lit("none")))
    placed = attach(rows, heads.join(sizes, "_of"), "_of", "_n", blocks.count(), sizes=sizes).select("conv_id", "block", "own", F.coalesce("carried", F.slice("own", 1, 0)).alias("carried"), "system")
    return placed.mapInPandas(_windows(budget, history, vocabulary or default_vocabulary()), WINDOWS)


READ = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_windows bigint"


def _reading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows in order of conversation, block and window; one conversation's digests are open at a time."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    open_, rows = None, []

    def closed() -> tuple:
        conv, turns, loss, n = open_
        return conv, n[0], turns.hexdigest(), n[1], loss.hexdigest(), n[2], n[3]

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    for b in batches:
        for i in range(b.num_rows):
            conv, repeated, text, spans = (b.column(c)[i].as_py() for c in ("conv_id", "n_repeated", "text", "loss"))
            if open_ is None or open_[0] != conv:
                if open_ is not None:
                    rows.append(closed())
                open_ = conv, hashlib.sha256(), hashlib.sha256(), [0, 0, 0, 0]
            _, turns, loss, n = open_
            for role, said in turns_of(text)[repeated:]:
                turns.update(f"{role}\n{said}\n".encode())
                n[0] += 1
            for said in loss_texts(text, spans):
                loss.update(said.encode())
                n[1] += len(said)
            n[2] += len(text)
            n[3] += 1
        if rows:
            yield out()
            rows = []
    if open_ is not None:
        rows.append(closed())
        yield out()


def read_back(windows: DataFrame) -> DataFrame:
    """Digests of each conversation from its windows alone: all turns, and all text under the loss mask. A SHA-256 goes through its
    conversation's windows one after another, so these are one task's; it holds one window at a time and sorting may spill."""
    return windows.repartition("conv_id").sortWithinPartitions("conv_id", "block", "window").select("conv_id", "n_repeated", "text", "loss").mapInArrow(_reading, READ)
