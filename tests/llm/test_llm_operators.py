"""The operators against brute force on small tables, and on awkward rows."""

import hashlib
import re
import zlib
from itertools import combinations

import pytest
import xxhash
from pyspark.sql import functions as F

from larkspan.llm import queries
from larkspan.llm.chat import escape, format_chats, parse, read_chats, render, unescape
from larkspan.llm.decontamination import contaminated_regions, drop_contaminated
from larkspan.llm.mixing import mix_sources, tempered_weights
from larkspan.llm.near_dedup import drop_near_duplicates, near_dedup
from larkspan.llm.quality import classify_quality, keep_good
from larkspan.llm.secrets import base_spans, guess_spans, scan_secrets
from larkspan.llm.sharding import fill, shard_documents
from larkspan.llm.url_filter import RULES, judge_urls, labelled_table
from larkspan.llm.warc import read_warc, write_warc
from larkspan.llm.winnowing import K, W, fingerprint, fingerprint_edits, winnow
from larkspan.session import scratch_path

ODD = [(1, None), (2, ""), (3, "one"), (3, "one"), (None, "null id text"), (4, "a b c d e f g"), (5, "a b c d e f g"), (6, " ".join(f"w{i}" for i in range(60_000))), (7, "  \n\t "), (8, "\U0001f600 é ß 日本語")]


def docs_of(spark, rows=ODD):
    """Rows with extra columns whose names clash with the operators' own."""
    table = spark.createDataFrame(rows, "doc_id long, text string")
    return table.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).alias("n"), F.lit(2).alias("id"), F.lit("x").alias("component"), F.lit(0).alias("shard"), F.lit(0).alias("size"))


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


def shingles(text, k=4):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def components(texts, k=4):
    sets, root = {i: shingles(t, k) for i, t in texts.items()}, {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in texts}


def test_op6_against_all_pairs(spark, sf, texts):
    rows = queries.op6_near_dedup(spark, sf).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == components(texts)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_op6_chains_around_the_threshold(spark):
    words = [f"t{i}" for i in range(100)]
    made = {}
    for i in range(40):  # each differs from the one before by a few words
        words = [*words[: 2 * i], f"x{i}", *words[2 * i + 1 :]] if i % 7 else [f"y{i}_{j}" for j in range(100)]
        made[i] = " ".join(words)
    rows = near_dedup(docs_of(spark, list(made.items())), k=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == components(made)


def test_op6_odd_rows(spark):
    rows = near_dedup(docs_of(spark)).collect()
    assert len(rows) == len(ODD)
    found = {r.doc_id: r for r in rows}
    assert found[5].component_id == 4 and not found[5].kept and found[1].kept and found[2].n_shingles == 0
    assert found[None].component_id is None and found[None].kept
    assert near_dedup(docs_of(spark, [])).collect() == []
    assert 5 not in {r.doc_id for r in drop_near_duplicates(docs_of(spark)).collect()}


def test_op5_capacity_slots_and_groups(spark, sf, texts):
    rows = queries.op5_shard_documents(spark, sf).collect()
    assert len(rows) == len(texts) and {r.law for r in rows} == {"bytes"}
    of_text, total, groups = {}, {}, {}
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert r["size"] == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw)
        assert of_text.setdefault(raw, r.shard) == r.shard
        total[r.shard] = total.get(r.shard, 0) + r["size"]
        key = hashlib.sha256(raw).hexdigest()
        groups[key] = groups.get(key, 0) + r["size"]
    for shard in total:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
    ends = [0]
    for key in sorted(groups):
        ends.append(ends[-1] + groups[key])
    import numpy as np

    most = max(total.values())
    assert fill(np.array(ends), most, 16) is not None and (most == max(groups.values()) or fill(np.array(ends), most - 1, 16) is None)


def test_op5_odd_rows(spark):
    rows = shard_documents(docs_of(spark)).collect()
    assert len(rows) == len(ODD) and all(0 <= r.shard < 16 for r in rows)
    assert shard_documents(docs_of(spark, [])).collect() == []


def digests(turns):
    whole, loss = "", ""
    for role, text in turns:
        whole += f"{role}\n{text}\n"
        loss += text if role == "assistant" else ""
    return len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_op7_against_the_turns(spark, sf):
    want = {-7: [("user", "\\### Assistant: </turn> ok"), ("assistant", "\\### Assistant: </turn> ok")]}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect():
        want.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    got = {r.conv_id: tuple(r)[1:5] for r in queries.op7_chat_windows(spark, sf).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256").collect()}
    assert got == {c: digests(t) for c, t in want.items()}


def test_op7_template_is_reversible():
    for text in ["", "\\", "\\\\", "###", "\\###", "</turn>", "### user: x</turn>\n", "a\\</turn>\\", "####", ": "]:
        assert unescape(escape(text)) == text
        assert list(parse(render("a: b", text)[0] + render("user", text)[0])) == [("a: b", text), ("user", text)]


def test_op7_long_conversation_and_odd_rows(spark):
    turns = [(1, i, ("system", "user", "assistant")[0 if not i else 1 + i % 2], f"turn {i} " * (i % 50)) for i in range(1200)]
    rows = spark.createDataFrame([*turns, (2, None, None, None), (2, None, None, None), (None, 3, "assistant", "x")], "conv_id long, turn long, role string, text string")
    windows = format_chats(rows)
    assert windows.where("n_tokens > 1024 and n_turns - n_repeated > 1").count() == 0
    got = {r.conv_id: tuple(r)[1:5] for r in read_chats(windows).collect()}
    assert got == {1: digests([(r, t) for _, _, r, t in turns]), 2: digests([("", "")] * 2), None: digests([("assistant", "x")])}
    assert read_chats(format_chats(rows.where("false"))).collect() == []


def winnowed(text):
    raw = text.encode("utf-32-be")
    n = len(text)
    grams = [(xxhash.xxh64_intdigest(raw[4 * i : 4 * (i + K)], 42) >> 33, -i) for i in range(max(n - K + 1, 1))] if n else []
    kept = {min(grams[i : i + W]) for i in range(max(len(grams) - W + 1, 1))} if grams else set()
    return ",".join(f"{h:x}@{-i}" for h, i in sorted(kept, key=lambda g: -g[1]))


def test_op8_against_brute_force(spark, sf, texts):
    got = {r.doc_id: r for r in queries.op8_winnowing(spark, sf).collect()}
    ids = sorted(texts)
    assert sorted(got) == ids
    for i, doc in enumerate(ids):
        text, after = texts[doc], texts[ids[(i + 1) % len(ids)]]
        gone = len(text) // 4
        edited = text[: len(text) - gone] + after[:gone]
        r = got[doc]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == winnowed(text) and r.edited_fingerprint == winnowed(edited)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1


def test_op8_long_texts_in_stretches(spark):
    rows = [(n, "".join(chr(97 + (i * i * 7 + i // 5) % 26) for i in range(n))) for n in (1, K - 1, K, K + W - 2, K + W - 1, K + W + 9, K + W + 10, 500, 1501)]
    rows += [(2000, "ab" * 700), (2001, "\U0001f600z" * 400)]
    docs = spark.createDataFrame(rows, "id long, text string")
    for step in (1, 10, 64, 5000):
        got = {r.id: r.f for r in docs.select("id", fingerprint(winnow(F.col("text"), step=step)).alias("f")).collect()}
        assert got == {i: winnowed(t) for i, t in rows}


def test_op8_odd_rows(spark):
    rows = fingerprint_edits(docs_of(spark)).collect()
    assert len(rows) == len(ODD) and {r.fingerprint for r in rows if not r.n_chars} == {""}
    assert fingerprint_edits(docs_of(spark, [])).collect() == []


def test_op9_against_plain_rules(spark, sf):
    got = {r.page_id: r for r in queries.op9_judge_urls(spark, sf).collect()}
    for page in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect():
        m = re.match(r"(?s)([^/?#]*)([^?#]*)", page.url.split("://", 1)[1] if "://" in (page.url or "") else "")
        host, path = re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]
        fits = [r for r in RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        rule = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
        r = got[page.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule and rule[1] + rule[2])
        assert r.verdict == rule[0] if rule else r.verdict in ("allow", "block")


def test_op9_odd_urls(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "no scheme"), (4, "HTTP://WWW.Example.COM/en/x?y#z"), (5, "http://a.net/es/"), (None, "x://?q")], "page_id long, url string")
    got = {r.page_id: tuple(r)[1:] for r in judge_urls(rows, labelled_table(spark)).collect()}
    assert got[1][:3] == got[3][:3] == ("", "", None) and got[4] == ("www.example.com", "/en/x", "www.example.com/en/", "allow") and got[5][2:] == ("net/es/", "block")


def test_op10_against_the_patterns(spark, sf, texts):
    got = {r.doc_id: r for r in queries.op10_scan_secrets(spark, sf).collect()}
    for doc, text in texts.items():
        base = sorted(base_spans(text), key=lambda s: (s[0], ("assign", "access", "hex").index(s[2])))
        r = got[doc]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[2] == k for s in base) for k in ("assign", "access", "hex")]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in base).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for a, b, k in base} <= set(r.spans.split(",")) | {""}


def test_op10_guess_cost_adds_hard_values_only(spark):
    assert guess_spans('passphrase is "q7#Vz!m2Lw@9" and', [])[0][2] == "guess"
    assert guess_spans("the password is important to them", []) == [] and guess_spans("pwd = password1", []) == []
    rows = scan_secrets(docs_of(spark)).collect()
    assert len(rows) == len(ODD) and all(r.spans == "" for r in rows)


def test_op1_odd_rows(spark):
    rows = spark.createDataFrame([(1, "http://a/", "x" * 2000), (2, None, "x" * 2000), (3, "http://ü/ \r\n", None), (4, "u", "x" * 999), (5, "u", "x" * 999), (None, "u", "y")], "page_id long, url string, html string")
    uri = scratch_path(spark, "warc-test")
    write_warc(rows, uri, file_bytes=600)
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in read_warc(spark, uri).collect()}
    assert got == {1: (2000, "revisit", 2), 2: (2000, "response", None), 3: (0, "response", None), 4: (999, "response", None), 5: (999, "response", None), None: (1, "response", None)}


def test_op4_planted_passages(spark):
    item = "The quick auditor, having counted forty-two ledgers before noon, declared the harbour accounts balanced and left."
    wrong = item.replace("auditor", "auditr").replace("harbour", "harbor")
    other = "Nothing of the sort stands here; a clean text talks of other things for quite a while, and then it ends without any passage."
    docs = docs_of(spark, [(1, other + item + other), (2, other), (3, other + item.upper()), (4, other + wrong), (5, None), (6, "")])
    items = spark.createDataFrame([(1, item), (2, None), (3, "short")], "item_id long, text string")
    assert {r.doc_id for r in contaminated_regions(docs, items).collect()} == {1, 3, 4}
    assert {r.doc_id for r in drop_contaminated(docs, items).collect()} == {2, 5, 6}
    assert contaminated_regions(docs, items.where("false")) is not None


def test_op3_held_out_accuracy(spark, sf):
    docs, labels = spark.read.parquet(f"{sf.rsplit('/', 1)[0]}/sf0.01/documents.parquet"), spark.read.parquet(f"{sf.rsplit('/', 1)[0]}/sf0.01/labels.parquet")
    train, held = labels.where("pmod(hash(doc_id), 2) = 0"), labels.where("pmod(hash(doc_id), 2) = 1")
    right = classify_quality(docs, train).join(held, "doc_id").agg(F.avg((F.col("kept") == ((F.col("quality") == 1) & (F.col("toxic") == 0))).cast("int"))).first()[0]
    assert right >= 0.9


def test_op3_and_op2_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (3, None, None), (4, 0, 1)], "doc_id long, quality int, toxic int")
    docs = docs_of(spark)
    assert classify_quality(docs, labels).count() == len(ODD)
    assert keep_good(docs, labels).columns == docs.columns
    assert classify_quality(docs_of(spark, []), labels.where("false")).collect() == []
    mixed = mix_sources(docs, tempered_weights(docs, 0.5), epochs=3.0)
    assert mixed.count() > 0 and mix_sources(docs_of(spark, []), tempered_weights(docs, 0.5)).count() == 0


def test_pipeline_stages(spark, sf):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows, seen = docs.count(), docs
    for name, stage in pipeline.STAGES[:3]:
        seen = stage(spark, seen, sf)
        assert seen.columns == docs.columns, name
        assert 0 < seen.count() <= rows
        rows = seen.count()
    assert pipeline.STAGES[3][1](spark, seen, sf).columns == docs.columns
