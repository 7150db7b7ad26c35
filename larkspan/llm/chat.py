"""Chat formatting in budgeted windows with a loss mask.

A turn is rendered as `### role: text</turn>` and a line end; backslashes, the
two markers and, in roles, colons are escaped by a backslash, which reading
undoes. Rendered turns have token counts; a window takes turns for as long as
their prefix sum, with what it repeats, stays in the budget. It repeats the
conversation's system turn and a few turns before its own; targets among them
are masked, so that each assistant text is learned once.

Windows never cross a multiple of SEGMENT turns, counted from the begin of the
conversation. Each segment is an own unit of work, with the turns before it
copied in as history, so a very long conversation is dealt out to many tasks,
however its turns are numbered, and windows don't depend on partitions.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.operators.ranking import ranked_within

#: Turns to a segment, tokens to a window, and at most so many turns and tokens of history.
SEGMENT, BUDGET, HISTORY_TURNS, HISTORY_TOKENS = 256, 1024, 2, 256

_OPEN, _CLOSE = "### ", "</turn>"
_WINDOWS = pa.schema(
    [("conv_id", pa.int64()), ("segment", pa.int64()), ("window", pa.int32()), ("text", pa.string()), ("n_turns", pa.int32()), ("n_repeated", pa.int32()), ("n_tokens", pa.int64()), ("loss_start", pa.list_(pa.int32())), ("loss_end", pa.list_(pa.int32()))]
)
_WINDOWS_DDL = "conv_id long, segment long, window int, text string, n_turns int, n_repeated int, n_tokens long, loss_start array<int>, loss_end array<int>"
_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("###", "\\###").replace(_CLOSE, "\\" + _CLOSE)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


def render(role: str, text: str) -> tuple[str, int, int]:
    """The rendered turn, and where its escaped text starts and ends."""
    head = _OPEN + escape(role).replace(":", "\\:") + ": "
    body = escape(text)
    return head + body + _CLOSE + "\n", len(head), len(head) + len(body)


def _unescaped(text: str, mark: str, at: int) -> int:
    """Where the next `mark` that no backslash escapes begins."""
    while True:
        found = text.index(mark, at)
        before = found
        while before > at and text[before - 1] == "\\":
            before -= 1
        if (found - before) % 2 == 0:
            return found
        at = found + 1


def parse(text: str):
    """(role, text) of each rendered turn."""
    at = 0
    while at < len(text):
        colon = _unescaped(text, ": ", at + len(_OPEN))
        close = _unescaped(text, _CLOSE, colon + 2)
        yield unescape(text[at + len(_OPEN) : colon]), unescape(text[colon + 2 : close])
        at = close + len(_CLOSE) + 1


def count_tokens(rendered: str) -> int:
    """About the tokens of a byte-level vocabulary: a quarter of the UTF-8 bytes, rounded up."""
    return -(-len(rendered.encode()) // 4)


def encoder(path: str):
    """A token counter over a rank file of a public tokenizer; the path is the caller's. Each worker loads the file once."""

    def count(rendered: str) -> int:
        return len(_vocabulary(path).encode_ordinary(rendered))

    return count


@lru_cache
def _vocabulary(path: str):
    import base64

    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", mergeable_ranks=ranks, special_tokens={})


class _Segment:
    """The windows of one segment, built turn by turn; holds one window and the limited history.

    A turn carries the prefix sum of tokens up to its end. A window's own
    tokens are the difference of two prefix sums.
    """

    def __init__(self, key, count, budget: int, history: tuple[int, int]):
        self.key, self.count, self.budget, self.history = key, count, budget, history
        self.system, self.past, self.window, self.own = None, [], 0, []
        self.repeated: list = []
        self.sum = self.begin = self.extra = 0  # prefix sum so far, where the window's own turns begin in it, repeated tokens

    def add(self, kind: int, role: str, text: str):
        """Takes a turn (0: the system turn, 1: history, 2: own); returns a finished window or None."""
        turn = (*render(role, text), role)
        turn = (*turn, self.count(turn[0]))
        if kind == 0:
            self.system = turn
            return None
        if kind == 1:
            self._remember(turn)
            return None
        done = None
        if self.own and self.sum + turn[4] - self.begin + self.extra > self.budget:
            done = self.flush()
        if not self.own:
            self._open(turn[4])
        self.own.append(turn)
        self.sum += turn[4]
        if role == "system" and self.system is None:
            self.system = turn
        self._remember(turn)
        return done

    def _remember(self, turn) -> None:
        if turn[3] != "system":
            self.past = [*self.past, turn][-self.history[0] :] if self.history[0] else []

    def _open(self, needed: int) -> None:
        """Choose what the next window repeats beside a turn of `needed` tokens: the system turn if it fits, then the latest turns that fit."""
        left = self.budget - needed
        self.repeated = [self.system] if self.system and self.system[4] <= left else []
        room, kept = min(self.history[1], left - sum(t[4] for t in self.repeated)), []
        for turn in reversed(self.past):
            if turn[4] > room:
                break
            room -= turn[4]
            kept.insert(0, turn)
        self.repeated += kept
        self.begin, self.extra = self.sum, sum(t[4] for t in self.repeated)

    def flush(self) -> dict | None:
        if not self.own:
            return None
        at, starts, ends, parts = 0, [], [], []
        for i, (rendered, a, b, role, _) in enumerate(self.repeated + self.own):
            if i >= len(self.repeated) and role == "assistant":
                starts.append(at + a)
                ends.append(at + b)
            at += len(rendered)
            parts.append(rendered)
        row = {"conv_id": self.key[0], "segment": self.key[1], "window": self.window, "text": "".join(parts), "n_turns": len(parts), "n_repeated": len(self.repeated)}
        row |= {"n_tokens": self.sum - self.begin + self.extra, "loss_start": starts, "loss_end": ends}
        self.window, self.own, self.repeated = self.window + 1, [], []
        return row


def _format(count, budget: int, history: tuple[int, int]):
    def run(batches):
        now, out, chars = None, [], 0
        for batch in batches:
            for conv, segment, kind, role, text in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if now is None or now.key != (conv, segment):
                    out += [w for w in [now and now.flush()] if w]
                    now = _Segment((conv, segment), count, budget, history)
                done = now.add(kind, role, text)
                if done:
                    out.append(done)
                    chars += len(done["text"])
                if chars > 4_000_000 or len(out) >= 2000:
                    yield pa.RecordBatch.from_pylist(out, schema=_WINDOWS)
                    out, chars = [], 0
        out += [w for w in [now and now.flush()] if w]
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_WINDOWS)

    return run


def format_chats(turns: DataFrame, budget: int = BUDGET, history_turns: int = HISTORY_TURNS, history_tokens: int = HISTORY_TOKENS, count=count_tokens) -> DataFrame:
    """Windows of conversations (conv_id, turn, role, text): one row for each window, with its text and loss mask.

    loss_start and loss_end bound, in code points of the window's text, the
    escaped texts of its own assistant turns. Turns are ordered by turn (nulls
    first), then role, then text; equal rows are turns of their own. A null
    text or role is empty, a null conv_id is a conversation. Only a turn beyond
    the budget makes a window beyond it, and has that window to itself. The
    repeated system turn is the first row of the conversation with the role
    `system`; a window whose first own turn leaves no room for it goes without. An empty table gives no
    windows. Other columns are not read.
    """
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.lit(2).alias("kind"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    rows = ranked_within(rows, ["conv_id"], ["turn", "role", "text"], "rank").withColumn("segment", F.floor(F.col("rank") / SEGMENT).cast("long"))
    before = rows.where(F.pmod("rank", F.lit(SEGMENT)) >= SEGMENT - history_turns).withColumn("segment", F.col("segment") + 1).withColumn("kind", F.lit(1))
    spread = rows.groupBy("conv_id", "segment").agg(F.lit(1).alias("one"))
    system = rows.where("role = 'system'").groupBy("conv_id").agg(F.min(F.struct("rank", "segment", "role", "text")).alias("s"))
    system = system.select(F.col("conv_id").alias("c"), "s")
    copied = spread.join(system, F.col("conv_id").eqNullSafe(F.col("c"))).where("segment > s.segment").select("conv_id", "segment", F.lit(0).alias("kind"), "s.rank", "s.role", "s.text")
    # history after the last turn of a conversation is in a segment without turns of its own, which makes no window
    every = rows.drop("turn").unionByName(before.drop("turn")).unionByName(copied)
    dealt = every.repartition("conv_id", "segment").sortWithinPartitions("conv_id", "segment", "kind", "rank")
    return dealt.select("conv_id", "segment", "kind", "role", "text").mapInArrow(_format(count, budget, (history_turns, history_tokens)), _WINDOWS_DDL)


def _read(batches):
    import hashlib

    now = None

    def row():
        conv, n, turns, chars, loss, size = now
        return {"conv_id": conv, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": size}

    for batch in batches:
        out = []
        for w in batch.to_pylist():
            if now is None or now[0] != w["conv_id"]:
                if now:
                    out.append(row())
                now = [w["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for i, (role, text) in enumerate(parse(w["text"])):
                if i >= w["n_repeated"]:
                    now[1] += 1
                    now[2].update(f"{role}\n{text}\n".encode())
            for a, b in zip(w["loss_start"], w["loss_end"], strict=True):
                text = unescape(w["text"][a:b])
                now[3] += len(text)
                now[4].update(text.encode())
            now[5] += len(w["text"])
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_DIGEST)
    if now:
        yield pa.RecordBatch.from_pylist([row()], schema=_DIGEST)


def read_chats(windows: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), parsed from the windows' text.

    A digest over a whole conversation is one sequential computation, so a
    conversation is read by one task; it streams and holds one batch.
    """
    dealt = windows.repartition("conv_id").sortWithinPartitions("conv_id", "segment", "window")
    return dealt.mapInArrow(_read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
