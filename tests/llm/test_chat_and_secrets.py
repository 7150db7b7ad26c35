"""Window budgets, conversations whose turns are alike, and secrets in long and repeated texts."""

import glob
import re
import time

import pytest
from pyspark.sql import functions as F

from larkspan.llm import queries
from larkspan.llm.chat import SEGMENT, encoder, format_chats, parse, read_chats
from larkspan.llm.guesses import guess_cost, ranks
from larkspan.llm.secrets import base_spans, frequent_words, guess_spans, scan_secrets

TURNS = "conv_id long, turn long, role string, text string, segment int, kind string, rank int"


def rows_of(spark, turns):
    return spark.createDataFrame([(*t, 3, "x", 9) for t in turns], TURNS)


def test_op7_budget_holds_beside_a_long_system_turn(spark):
    turns = [(1, 0, "system", "s" * 2400)] + [(1, i, ("user", "assistant")[i % 2], "t" * (400 * (i % 9))) for i in range(1, 120)] + [(1, 500, "user", "u" * 9000)]
    windows = format_chats(rows_of(spark, turns)).collect()
    over = [w for w in windows if w.n_tokens > 1024]
    assert all(w.n_turns - w.n_repeated == 1 and w.n_repeated == 0 for w in over) and len(over) == 1
    assert any(w.n_repeated and next(iter(parse(w.text)))[0] == "system" for w in windows) and any(w.n_repeated == 0 for w in windows)
    for w in windows:
        assert w.n_tokens == sum(-(-len(m.encode()) // 4) for m in re.findall(r"### .*?</turn>\n", w.text, flags=re.S))


def test_op7_alike_turn_numbers_are_dealt_out(spark):
    turns = [(1, None, "user", f"text {i}") for i in range(700)] + [(2, 7, "assistant", "again")] * 600
    windows = format_chats(rows_of(spark, turns))
    assert {r.segment for r in windows.where("conv_id = 1").collect()} == set(range(700 // SEGMENT + 1))
    got = {r.conv_id: (r.n_turns, r.loss_chars) for r in read_chats(windows).collect()}
    assert got == {1: (700, 0), 2: (600, 3000)}


def test_op7_tokens_of_a_public_vocabulary():
    paths = glob.glob("/opt/tokenizers/**/*.tiktoken", recursive=True)
    if not paths:
        pytest.skip("no rank file")
    count = encoder(paths[0])
    assert 0 < count("### user: hello there</turn>\n") < 20 and count("") == 0


def test_op10_words_of_the_corpus_are_cheap(spark):
    docs = spark.createDataFrame([(i, f"Zyxwort, ZYXWORT and other{i}") for i in range(6)], "doc_id long, text string")
    assert frequent_words(docs) == ["and", "other", "zyxwort"]
    assert guess_cost("zyxwort", ranks(["zyxwort"])) < 3 < guess_cost("zyxwort")
    text = 'passphrase is "zyxwort-zyxwort"'
    assert guess_spans(text, [], known=ranks(["zyxwort"])) == []
    assert scan_secrets(docs.where("false")).collect() == []


def test_op10_time_grows_with_the_text():
    text = 'token = "abcdefgh12345678" pwd: q7#Vz!m2Lw@9 ' * 20_000
    begin = time.perf_counter()
    base = base_spans(text)
    found = guess_spans(text, base)
    assert len(base) == 20_000 and len(found) == 20_000 and time.perf_counter() - begin < 60


def test_op10_base_by_patterns_of_the_contract(spark, sf):
    """The contract's words turned into patterns here, not taken from the module."""
    assign = re.compile("(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    got = {r.doc_id: r for r in queries.op10_scan_secrets(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect():
        want = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in assign.finditer(r.text) if len(m[1]) >= 8]
        want += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", r.text) if len(m[0]) >= 16]
        want += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", r.text) if len(m[0]) >= 32]
        row = got[r.doc_id]
        assert (row.n_assign, row.n_access, row.n_hex) == tuple(sum(w[1] == k for w in want) for k in range(3))
        assert row.base_sha256 == __import__("hashlib").sha256(",".join(w[2] for w in sorted(want)).encode()).hexdigest()
