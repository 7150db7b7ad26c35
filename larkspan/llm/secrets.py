"""Secret scan: fixed patterns, and values in credential context that are hard to guess."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm.guesses import guess_cost, ranks
from larkspan.session import discard, materialize

#: log10 of the guesses from which a value in credential context is a secret.
COST = 9.0
#: Words of the corpus' dictionary, and texts that a word must stand in.
DICTIONARY, LEAST_TEXTS = 20_000, 5

# fixed values: the base patterns
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")

# A quoted value goes up to the matching quote, past escaped ones; another up to white space or a sign that ends it.
_CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|bearer|auth(?:orization)?|(?:api|access|private|signing|encryption)[_\x20-]?key)"""
    r"""(?P<gap>["']?(?:\s*(?:[:=]|=>|->)\s*|\s+(?P<verb>is|was)\s+)(?:bearer\s+|basic\s+)?)"""
    r"""(?:(?P<quote>["'`])(?:bearer\s+|basic\s+)?(?P<quoted>(?:\\.|(?!(?P=quote))[^\\])++)(?P=quote)|["'`]?(?:bearer\s+|basic\s+)?(?P<bare>[^\s"'`<>,;]+))""",
    re.I | re.A | re.S,
)
_PROSE = re.compile(r"[a-z]+")
#: Texts that cannot match any pattern are set aside by one scan of the Arrow buffer.
_MAYBE = r"(?i:pass|pwd|secret|token|credential|bearer|auth|key)|AKIA[A-Z0-9]{12}|[0-9a-f]{32}"
_ORDER = {"assign": 0, "access": 1, "hex": 2, "guess": 3}

_SCHEMA = pa.schema([("id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, non-overlapping for each kind; matches, in code points."""
    out = [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(*m.span(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return out + [(*m.span(), "hex") for m in _HEX.finditer(text) if m.end() - m.start() >= 32]


def guess_spans(text: str, base: list[tuple[int, int, str]], cost: float = COST, known: dict[str, int] | None = None) -> list[tuple[int, int, str]]:
    """Spans of values in credential context that no base span overlaps and that cost at least 10 ** cost guesses.

    A quoted value is whole, spaces and punctuation included. Without quotes
    after a plain "is" or "was", a word of small letters is taken for prose.
    A value that is no secret is searched for others inside. Base spans are
    found by bisection, so time grows with the text alone.
    """
    starts, reach = [], []
    for a, b, _ in sorted(base):
        starts.append(a)
        reach.append(max(b, reach[-1] if reach else 0))  # as far as this or any span before it goes
    out, at = [], 0
    while m := _CONTEXT.search(text, at):
        at = m.end("gap")
        start = m.start("quoted") if m["quote"] else m.start("bare")
        value = m["quoted"] if m["quote"] else m["bare"].rstrip(".!?)]}:")
        end = start + len(value)
        before = bisect_left(starts, end)
        if not m["quote"] and m["verb"] and _PROSE.fullmatch(value) or before and reach[before - 1] > start:
            continue
        if guess_cost(value, known) >= cost:
            out.append((start, end, "guess"))
            at = m.end()
    return out


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], _ORDER[s[2]], s[1])))


def _scan(cost: float, shared):
    def run(batches):
        known = ranks(shared.value)
        empty = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            maybe = pc.match_substring_regex(texts, _MAYBE)
            n = len(texts)
            counts = {k: [0] * n for k in ("assign", "access", "hex")}
            sha, joined = [empty] * n, [""] * n
            for i in pc.indices_nonzero(maybe).to_pylist():
                text = texts[i].as_py()
                base = base_spans(text)
                for *_, kind in base:
                    counts[kind][i] += 1
                sha[i] = hashlib.sha256(_joined(base).encode()).hexdigest()
                joined[i] = _joined(base + guess_spans(text, base, cost, known))
            columns = [batch.column(0), *(pa.array(counts[k], pa.int64()) for k in ("assign", "access", "hex")), pa.array(sha, pa.string()), pa.array(joined, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, schema=_SCHEMA)

    return run


def frequent_words(docs: DataFrame, text_col: str = "text", size: int = DICTIONARY) -> list[str]:
    """The words that stand in the most texts of docs, at most `size`, most frequent first, ties by the word.

    Words are runs of 3 to 24 letters A-Z, lower-cased, counted once a text
    over all texts; a word must stand in at least LEAST_TEXTS of them, or a
    secret would be its own dictionary. Words are taken by steps of frequency,
    32 to a doubling, as long as a whole step fits: a sort with a limit would
    send `size` words of every partition to the driver.
    """
    low = F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    words = docs.select(F.explode(F.array_distinct(F.split(low, "[^a-z]+"))).alias("w")).where(F.length("w").between(3, 24))
    counted = materialize(words.groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_TEXTS), "words")
    step = F.floor(F.log2("n") * 32)
    steps = counted.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect()  # a few thousand at most
    room, least = size, None
    for r in sorted(steps, key=lambda r: -r.step):
        room -= r.words
        if room < 0:
            break
        least = r.step
    found = [] if least is None else counted.where(step >= least).collect()
    discard(counted)
    return [r.w for r in sorted(found, key=lambda r: (-r.n, r.w))]


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cost: float = COST, dictionary: list[str] | None = None) -> DataFrame:
    """(id_col, n_assign, n_access, n_hex, base_sha256, spans) for every row of docs.

    spans lists kind:start:end in code points, by start, then assign, access,
    hex, guess. The dictionary of the guess cost is the corpus' own, see
    frequent_words, unless one is given; it is broadcast, at most about
    DICTIONARY words. A null text counts as empty and has no spans; a null id
    stays null; repeated rows are scanned each; an empty table gives an empty
    result. Other columns are not read.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    words = frequent_words(docs, text_col) if dictionary is None else dictionary
    shared = docs.sparkSession.sparkContext.broadcast(words)
    out = source.mapInArrow(_scan(cost, shared), "id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    return out.withColumnRenamed("id", id_col)
