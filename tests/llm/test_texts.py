"""Archives, chats, HTML, decontamination, packing, quality and licences."""

import hashlib
import html as escapes
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import chat, licences, quality, registry, warc, wrapper
from quillspark.llm.common import shared_dir, shingle_hashes, word_hashes
from quillspark.llm.decontaminate import NO_WORD, Automaton, decontaminate, matches
from quillspark.llm.packing import Packer, pack
from quillspark.llm.tokens import encoder


def test_word_hashes_see_the_same_words_as_the_pattern():
    texts = ["Ab  ab\tAB\u00a0x", "", "é É", "one", " \n ", "a" * 5000 + " b"]
    h, at = word_hashes([t.encode() for t in texts])
    lower = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})
    known = {}
    for k, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(lower))
        own = h[at[k] : at[k + 1]].tolist()
        assert len(w) == len(own)
        for x, y in zip(w, own, strict=True):
            assert known.setdefault(x, y) == y
    assert len(set(known.values())) == len(known)
    assert len(shingle_hashes(h[:2], 3)) == 1 and len(shingle_hashes(h[:0], 3)) == 0


# --- archives


def test_hostile_archives_come_back_whole(spark):
    m = warc.MAGIC
    fake = m + "Content-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(k, f"http://h/{k}", "x" * (k * 37 % 900) + (fake if k % 5 == 0 else "") + (m if k % 7 == 0 else "") + "é" * (k % 9)) for k in range(120)]
    rows += [(900, None, None), (901, "u", ""), (902, "a\r\nb", fake * 20 + "z"), (903, "c", fake * 20 + "z"), (904, "big", (fake + "q" * 5000) * 10), (None, "n", "x" * 200)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        path = f"{shared_dir(spark)}/a"
        warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), path)
        got = {r.id: r for r in warc.read(spark, path).withColumn("id", warc.page_of(F.col("record_id"))).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert set(got) == {r[0] for r in rows}
    for i, _, body in rows:
        if got[i].record_type == "response":
            assert got[i].payload == (body or "")
    assert [i for i in got if got[i].record_type == "revisit"] == [903] and got[903].refers_to == "<urn:x-page:902>"


def test_archives_are_whole_whatever_the_settings(spark):
    """Splits of one size while the table is made, of others when it is collected; extra columns with clashing names; long payloads."""
    rows = [(k, "u", "p" * (k * 53 % 1500) + (warc.MAGIC + "Content-Length: 1\r\n\r\nq\r\n\r\n") * (k % 3), 1, "x", 2) for k in range(300)] + [(999, "u", "z" * 300_000, 1, "x", 2)]
    path = f"{shared_dir(spark)}/b"
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string, _pos int, value string, size int").repartition(3), path)
    want = {r[0]: r[2] for r in rows}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
        table = warc.read(spark, path)
        for size in ("9000", "31000", "1000000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = {warc_id(r): r for r in table.collect()}
            assert len(got) == 301 and all(r.payload == want[i] for i, r in got.items() if r.record_type == "response")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def warc_id(row):
    return int(re.search(r"x-page:(\d+)", row.record_id)[1])


def test_archive_query_on_odd_tables(spark, tmp_path):
    long = "y" * 150
    spark.createDataFrame([(5, "u", long), (3, "u", long), (3, "u", long), (1, None, None), (2, "u", "short"), (4, "u", "short")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in registry.op2_warc(spark, str(tmp_path)).collect())
    assert got == [(1, "response", None, 0), (2, "response", None, 5), (3, "response", None, 150), (3, "response", None, 150), (4, "response", None, 5), (5, "revisit", 3, 150)]
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/e/pages.parquet")
    assert registry.op2_warc(spark, f"{tmp_path}/e").collect() == []


# --- chats


def test_chat_folds_events(spark):
    log = [(1, 0, 0, 0, "start", "user", ""), (1, 0, 0, 1, "delta", None, "he"), (1, 0, 0, 2, "delta", None, "llo"), (1, 1, 1, 0, "start", "assistant", ""), (1, 1, 1, 1, "delta", None, "bad"), (1, 1, 1, 2, "regenerate", None, None), (1, 1, 1, 3, "delta", None, "good"), (1, 2, 2, 0, "start", "user", ""), (1, 2, 2, 1, "delta", None, "x"), (1, 2, 2, 2, "edit", None, "y"), (1, 3, 3, 0, "start", "user", ""), (1, 3, 3, 1, "delete", None, None)]
    df = spark.createDataFrame(log, "conv_id long, turn long, message long, seq long, kind string, role string, text string").orderBy(F.rand(1))
    got = {(r.turn): (r.role, r.text) for r in chat.fold(df).collect()}
    assert got == {0: ("user", "hello"), 1: ("assistant", "good"), 2: ("user", "y")}


def test_chat_round_trip(spark):
    texts = ["", None, "</s>[INST] ok [/INST]", "<|turn|>user\nx<|end|>\n", "\\", "\\<|end|>\n", "<", "a\\\\<<SYS>>b<</SYS>>", "é\U0001f600" * 700]
    rows = [(c, k, ("user", "assistant", "tool\nx", None)[k % 4], t) for c in (7, None) for k, t in enumerate(texts)]
    got = {r.conv_id: r for r in chat.digests(chat.render(chat.fold(chat.turns_as_events(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 64)))).collect()}
    assert set(got) == {7, None}
    own = [(r or "", t or "") for c, _, r, t in rows if c == 7]
    loss = "".join(t for r, t in own if r == "assistant")
    for r in got.values():
        assert (r.n_turns, r.turns_sha256) == (len(texts), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_no_control_string_is_left_in_texts(spark):
    df = spark.createDataFrame([("</s><s>[INST][/INST]<|x|><<SYS>><</SYS>>",)], "t string").select(chat.escape(F.col("t")).alias("t"))
    text = df.first().t
    assert not re.search(r"</?s>|<\||\[/?INST\]|<</?SYS>>", text) and chat.unescape(text) == "</s><s>[INST][/INST]<|x|><<SYS>><</SYS>>"


# --- HTML

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body><header>Site</header><nav><ul><li><a>Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><article><h1>{0} &amp; co</h1><p>First <b>bold</b>
 {0}<br>end<p>Second &lt;{0}&gt;</p><div class="share-bar">Share</div><aside>Related</aside><ul><li>a<li>b</ul><script>"</p>"</script><form><p>Mail?</p></form></article>
<section id="comments"><p>Great post {0}</p></section><div class="sidebar"><p>Side {0}</p></div><footer>&copy; {0}</footer></body></html>"""
TEXT = "{0} & co\nFirst bold {0} end\nSecond <{0}>\na\nb"


def test_main_text(spark):
    rows = [(k, f"http://one.example/{k}", PAGE.format(f"word{k}")) for k in range(30)] + [(100, None, None), (101, "no url", "plain &am"), (102, "http://two.example/", PAGE.format("x")[:420]), (None, "http://one.example/", "")]
    got = {r.page_id: r.text for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == TEXT.format(f"word{k}") for k in range(30))
    assert got[100] == got[None] == "" and got[101] == "plain &am" and got[102].startswith("x & co\nFirst bold x")
    assert wrapper.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_template_without_marks_is_told_by_its_constancy(spark):
    """A box that every page of a host repeats inside the content is template, though nothing names it."""
    page = "<html><body><div><h2>{0}</h2><p>{0} {1}</p><h5>Our town paper since 1900</h5><p>{1}</p></div></body></html>"
    rows = [(k, "http://h.example/x", page.format(f"head{k}", f"text{k} " * 30)) for k in range(40)]
    got = {r.page_id: r.text for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all("town paper" not in t and f"head{k} text{k}" in t for k, t in got.items())


def test_simple_tree_matching():
    a, b = (wrapper.read_page(f"<body><div>x</div>{extra}<p>t</p></body>")[0] for extra in ("", "<section>new</section>"))
    to = wrapper.align(a, b)
    assert len(to) == len(a.split("\n"))  # all of the exemplar; the new section has no partner


def test_lists_of_any_length_match_by_one_rule():
    """As many nodes as the plain table of simple tree matching finds, in lists of 40 and of 400 boxes."""

    def most(x, y):
        if x.label != y.label:
            return 0
        row = [0] * (len(y.children) + 1)
        for c in x.children:
            ahead = [0]
            for k, d in enumerate(y.children):
                ahead.append(max(row[k + 1], ahead[k], row[k] + known((c.built, c), (d.built, d))))
            row = ahead
        return 1 + row[-1]

    seen = {}

    def known(x, y):
        if (x[0], y[0]) not in seen:
            seen[x[0], y[0]] = most(x[1], y[1])
        return seen[x[0], y[0]]

    def page(n, by):
        return wrapper.read_page("<body>" + "".join(f"<div>{'<section>s</section>' * (k * by % 3 == 0)}{'<figure>f</figure>' * (k * by % 7 < 3)}<article>{'<main>m</main>' * (k * by % 5 == 1)}</article></div>{'<section>z</section>' * (k * by % 11 < 9)}" for k in range(1, n)) + "</body>")[0]

    for n in (40, 400):
        a, b = page(n, 1), page(n, 3)
        to = wrapper.align(a, b)
        x, y = wrapper.tree_of(a), wrapper.tree_of(b)
        assert len(to) == len(set(to.values())) == known((x.built, x), (y.built, y))
        assert n < 400 or len(x.children[1 if x.children[0].tag != "body" else 0].children) > 128


def test_pages_of_the_table(spark, sf):
    for r in spark.read.parquet(f"{sf}/pages.parquet").join(registry.op7_html(spark, sf), "page_id").collect():
        inner = re.search(r"<article[^>]*>(.*?)(</article>|$)", r.html, re.DOTALL)[1]
        blocks = re.sub(r"<[^>]*(>|$)", "", re.sub(r"<br>", " ", re.sub(r"</?(p|h1)\b[^>]*>", "\x00", re.sub(r"<[^>]*$", "", inner)))).split("\x00")
        assert r.text == "\n".join(filter(None, (" ".join(escapes.unescape(x).split()) for x in blocks))) and r.n_chars == len(r.text)


# --- decontamination


def brute(texts, items, window=10):
    lower = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))

    found = defaultdict(set)
    for i, t in items:
        w = words(t)
        k = min(window, len(w))
        for at in range(len(w) - k + 1 if k else 0):
            found[tuple(w[at : at + k])].add(i)
    out = []
    for t in texts:
        w, hit, own = words(t), set(), set()
        for k in {len(x) for x in found}:
            for at in range(len(w) - k + 1):
                if tuple(w[at : at + k]) in found:
                    hit |= set(range(at, at + k))
                    own |= found[tuple(w[at : at + k])]
        out.append((len(w), len(hit), sorted(own)))
    return out


def test_matches_against_brute_force(spark):
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["a", "b", "C"], rng.integers(0, 60))) for _ in range(60)] + [None, "", "ä-ö, B_9 aa bb"]
    items = [(k, " ".join(rng.choice(["a", "b", "c"], n))) for k, n in enumerate((1, 3, 9, 10, 11, 14, 25, 40))] + [(50, None), (51, "..."), (52, "Ä Ö"), (52, "b 9")]
    items[0] = (0, "zz")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = spark.createDataFrame(items, "item_id long, text string")
    want = brute(texts, items)
    for chars in (1_000_000, 60):  # one automaton, and several
        got = {r.doc_id: (r.n_words, sum(s.end - s.start for s in r.spans), r["items"]) for r in matches(docs, table, block_chars=chars).collect()}
        assert got == dict(enumerate(want))


def test_cutting(spark):
    item = " ".join(f"q{k}" for k in range(12))
    rows = [(1, f"Keep this, {item.upper()}! And this."), (2, item), (3, None), (4, "nothing here"), (5, "")]
    done = {r.doc_id: r for r in decontaminate(spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en")), spark.createDataFrame([(1, item)], "item_id long, text string"), max_share=0.8).collect()}
    assert done[1].text == "Keep this, And this." and not done[1].dropped and done[1].n_cut == 12
    assert done[2].dropped and done[3].text is None and done[4].text == "nothing here" and done[5].text == ""


def test_blocks_cut_as_one(spark):
    # 40 items; documents of two halves, of overlapping windows and of an item alone
    items = [(k, " ".join(f"i{k}x{n}" if n < 12 else f"i{(k + 1) % 40}x{n - 12}" for n in range(20))) for k in range(40)]
    rows = []
    for k in range(40):
        own = items[k][1].split()
        other = items[(k + 7) % 40][1].split()
        rows += [(3 * k, " ".join([*own[:12], *other[:12], *(f"r{n}" for n in range(16))])), (3 * k + 1, " ".join(["a", "b", *own[:12], *items[(k + 1) % 40][1].split(), *(f"r{n}" for n in range(90))])), (3 * k + 2, " ".join(own))]
    docs, table = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one, several = ({r.doc_id: (r.text, r.n_cut, r.dropped) for r in decontaminate(docs, table, block_chars=chars).collect()} for chars in (1_000_000, 600))
    assert one == several and all(one[3 * k][2] for k in range(40))


def test_decontamination_of_odd_tables(spark, odd, none):
    """Nulls, repeated rows, long texts, columns with names that are used inside; one block of items and many."""
    rows = odd.withColumns({"_spans": F.lit("mine"), "_cut": F.lit(1), "row": F.lit(2), "n_cut": F.lit(9)})
    words = [f"w{k}" for k in range(90)]
    items = [(1, " ".join(words[5:20])), (None, " ".join(words[40:52])), (2, None), (3, ""), (4, " ".join(f"l{k}" for k in range(4990, 5000))), (4, "x y")]
    table = spark.createDataFrame([(*r, "t") for r in items], "item_id long, text string, block string")
    found = {}
    for chars in (1_000_000, 40):
        out = decontaminate(rows, table, block_chars=chars)
        assert sorted(out.columns) == sorted([*rows.columns, "dropped"]) and decontaminate(none, table, block_chars=chars).count() == 0
        cut = sorted(((r.doc_id, r.text, r.n_cut, r.dropped, r._spans) for r in out.collect()), key=str)
        hits = sorted(((r.doc_id, r.n_words, [(s.start, s.end) for s in r.spans], r["items"]) for r in matches(rows, table, block_chars=chars).collect()), key=str)
        found[chars] = cut, hits
    assert found[1_000_000] == found[40] and len(found[40][0]) == odd.count()
    # by hand: words 5 to 19 of item 1, and 40 to 51 of the item without an id, in each copy
    assert (1, 90, [(5, 20), (40, 52)], [1]) in found[40][1] and sum(h[2:] == ([(5, 20), (40, 52)], [1]) for h in found[40][1]) == 5


def test_no_items_no_hits(spark, odd, none):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert all(not r.spans for r in matches(odd, empty).collect())
    assert matches(none, empty).collect() == []


def test_automaton_knows_every_factor():
    w = word_hashes([b"a b a b c a b a c b a"], NO_WORD)[0]
    s = Automaton([(1, w)], 3)
    for a in range(len(w) - 2):
        for b in range(a + 3, len(w) + 1):
            assert s.scan(w[a:b])[0] == [(0, b - a)]


# --- packing


def test_tokens_are_those_of_the_library(spark, sf):
    fast, plain = encoder("byte_bpe_50k.json"), encoder("byte_bpe_50k.json", "tokenizers")
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for t in [*texts, "", " ", "\n\n  x", "<|endoftext|> y", "don't'll 3.14 \u00a0\u2003é\u0301 한글 \U0001f600", "a" * 2000, "\r\n\t \x1c"]:
        assert fast(t) == plain(t)


def check_pieces(rows, ids, size=1024):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for i, own in ids.items():
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(own)
            assert zlib.crc32(np.array(own[at : at + r.length], "<u4").tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(own)
    padding = 0
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    return padding


def test_packing_round_trip(spark, sf):
    plain = encoder("byte_bpe_50k.json", "tokenizers")
    ids = {r.doc_id: [*plain(r.text or ""), 0] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert check_pieces(registry.op9_pack(spark, sf).collect(), ids) == 0


def test_packing_odd_rows(spark, odd, none):
    rows = pack(odd).collect()
    assert sum(r.length for r in rows if r.doc_id == 5) == 1 and {r.doc_tokens for r in rows if r.doc_id in (4, 5)} == {1}
    assert pack(none).collect() == []


def test_packer_fills_windows_exactly():
    rng = np.random.default_rng(1)
    for sizes in (rng.integers(1, 200, 3000), np.full(500, 60), [64] * 5, [1]):
        p = Packer(64, 20, 0)
        for k, n in enumerate(sizes):
            p.add(k, np.arange(n, dtype=np.uint32))
        p.flush(last=True)
        fill = defaultdict(int)
        for _, _, length, _, seq, offset, ids in p.out:
            assert offset == fill[seq] and len(ids) == 4 * length
            fill[seq] += length
        assert sum(fill.values()) == sum(sizes)
        assert sum(f < 64 for f in fill.values()) <= 6 and all(f & (f - 1) == 0 for f in fill.values())


# --- quality


def test_marginals_are_those_of_all_labellings():
    f = quality.Field([], np.zeros((3, 0, 1)), 0.0, np.array([[0.7, -0.4], [0.1, 1.2]]))
    odds = [0.3, -1.0, 2.0, 0.5]
    total, good = 0.0, np.zeros(4)
    for code in range(16):
        y = [code >> k & 1 for k in range(4)]
        w = np.exp(sum(o for o, b in zip(odds, y, strict=True) if b) + sum(f.chain[a, b] for a, b in zip(y, y[1:], strict=False)))
        total += w
        good += w * np.array(y)
    assert f.marginals(odds) == pytest.approx((good / total).tolist())
    batch, _ = quality._posterior(np.array([odds]), np.ones((1, 4), bool), f.chain)
    assert batch[0] == pytest.approx((good / total).tolist())


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.score(docs, quality.train(docs, labels)).join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_quality_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (4, 0), (None, 1), (2, None)], "doc_id long, quality int")
    for field in (quality.train(odd, labels), None):
        rows = quality.score(odd, field).collect()
        assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert quality.train(odd, labels.filter("quality = 1")) is None
    assert quality.score(none, None).collect() == []


# --- licences


def test_licences(spark, none):
    texts = {
        1: "Some words.\nReleased under the MIT License.\nMore.", 2: "Licensed under CC BY-NC 4.0.", 3: "The pub has a licence to sell beer.", 4: None, 5: "", 6: "This work is licensed under the GNU General Public License, version 3.",
        7: "All rights reserved.\nLicensed under the Apache License, Version 2.0.", 8: "no anchors at all " * 100, 9: "See the attached Quux Shareware license agreement of 1987 for permission.",
        10: "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the conditions are met.",
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: sorted(p.family for p in r.paragraphs if p.confirmed) for r in licences.scan(df).collect()}
    assert got == {1: ["MIT"], 2: ["CC-BY-NC"], 3: [], 4: [], 5: [], 6: ["GPL"], 7: ["Apache", "Proprietary"], 8: [], 9: [], 10: ["BSD"]}
    assert licences.scan(none).collect() == []
    plan = licences.scan(df)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_all_training_statements_reach_the_classifier(spark):
    rows = [(k, family, s) for k, (family, s) in enumerate(dict.fromkeys(licences.statements())) if family != licences.NONE]
    found = {r.doc_id for r in licences.scan(spark.createDataFrame(rows, "doc_id long, family string, text string")).collect() if r.paragraphs}
    assert [s for k, _, s in rows if k not in found] == []
    plain = spark.createDataFrame([(1, "Er kam mit dem Hund."), (2, "He studied at MIT in Boston.")], "doc_id long, text string")
    assert not any(r.paragraphs for r in licences.scan(plain).collect())


def test_gram_slots_are_sparks(spark):
    grams = ["mit license", "é", "a" * 50, ""]
    rows = spark.createDataFrame([(g,) for g in grams], "g string").select("g", F.pmod(F.xxhash64("g"), F.lit(licences.WEIGHTS)).alias("s")).collect()
    assert all(licences._slot(r.g) == r.s for r in rows)


def test_deeply_nested_pages_give_their_text():
    from quillspark.llm.wrapper import main_text, read_page

    page = "<html><body>" + "<div>" * 100_000 + "deep words" + "</div>" * 100_000 + "</body></html>"
    assert main_text(page) == "deep words"
    tree = read_page(page)[0]
    assert main_text(page, tree, ()) == "deep words"


def test_template_inside_an_article_goes(spark):
    pages = [(k, f"http://h.example/{k}", f"<body><article class='q7'><h1>Title {k}</h1><p>Body {k} of the page.</p><div class='zz1'>Read this in our app.</div></article></body>") for k in range(40)]
    from quillspark.llm.wrapper import extract, main_text

    got = {r.page_id: r.text for r in extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[7] == "Title 7\nBody 7 of the page."
    # a page by itself can't tell
    assert main_text(pages[7][2]) == "Title 7\nBody 7 of the page.\nRead this in our app."


#: Licences that the model wasn't fitted on.
UNSEEN = [
    "Eiffel Forum License", "Vovida Software License 1.0", "Sleepycat License", "Zope Public License 2.1", "Intel Open Source License", "Nokia Open Source License", "Lucent Public License", "RealNetworks Public Source License",
    "Reciprocal Public License 1.5", "Frameworx License", "Motosoto License", "Naumen Public License", "Entessa Public License", "Fair License", "Educational Community License", "Historical Permission License", "Jabber Open Source License",
    "Mulan Permissive Software License", "Upstream Compatibility License", "Vim License", "Xnet License", "Watcom Public License", "Acme Community License", "Open Software License 3.0",
]


def restated(text):
    """What the scan should say, line by line, in plain Python."""
    families, weights, biases, least = licences.model()
    out = []
    units = re.split(licences.UNIT, text or "")
    units += [p for p in dict.fromkeys(re.split(licences.UNIT, re.sub(licences.SOFT, " ", text or ""))) if p not in units]
    for p in units:
        if not re.search(licences.ANCHORS.replace("(?i)", "(?i:", 1).replace("|(?-i:", ")|(?:", 1), p):
            continue
        grams = licences._grams(p)
        slots = sorted({licences._slot(g) for g in grams})
        z = biases + weights[:, slots].round(4).sum(axis=1) / max(1, len(slots)) ** 0.5
        k = int(z.argmax())
        pr = 1 / np.exp(z - z.max()).sum()
        if families[k] != licences.NONE:
            sim = max((len(set(t) & set(grams)) / len(t) for t in licences.templates().get(families[k], [])), default=0.0)
            name = families[k] if pr >= least else licences.UNKNOWN
            out.append((p, name, name != licences.UNKNOWN and sim >= 0.6, round(pr, 3), round(sim, 6)))
    return out


def test_licences_that_the_fit_lacks_are_unknown_and_the_scan_equals_its_restatement(spark):
    strange = [frame.format(name) for name in UNSEEN for frame in licences.FRAMES]
    known = [s for _, s in licences.statements()[::5]]
    texts = [*strange, *known, "", "No mark here.", "Two lines.\nLicensed under the MIT License. All rights reserved.", "licence " * 30_000]
    rows = spark.createDataFrame([*enumerate(texts), (len(texts), None)], "doc_id long, text string")
    got = {r.doc_id: r.paragraphs for r in licences.scan(rows).collect()}
    sure = [any(x.confirmed for x in got[k]) for k in range(len(strange))]
    assert sum(sure) <= 0.05 * len(sure)
    for k, t in enumerate(texts):
        assert [(x.paragraph, x.family, x.confirmed, round(x.probability, 3), round(x.similarity, 6)) for x in got[k]] == restated(t), t[:100]
    right = [any(x.confirmed and x.family == f for x in got[len(strange) + k]) for k, (f, _) in enumerate(licences.statements()[::5]) if f not in (licences.NONE, licences.UNKNOWN)]
    assert np.mean(right) >= 0.95


def test_the_wrapper_decides_without_names(spark, sf):
    """Of hosts with three pages and more, pages give the same text when all boxes are plain div."""
    pages = spark.read.parquet(sf.replace("0.001", "0.01") + "/pages.parquet")
    named = {r.page_id: (r.url, r.text) for r in wrapper.extract(pages).collect()}
    # boxes are all div, of one class
    bare = F.regexp_replace(F.regexp_replace("html", r"<(/?)(article|main|nav|footer|aside|header|section)\b[^>]*>", "<$1div>"), 'class="[^"]*"', 'class="q"')
    plain = {r.page_id: r.text for r in wrapper.extract(pages.withColumn("html", bare)).collect()}
    host = lambda url: re.sub(r"^https?://([^/]*).*", r"\1", url)
    size: dict = {}
    for url, _ in named.values():
        size[host(url)] = size.get(host(url), 0) + 1
    large = [k for k, (url, _) in named.items() if size[host(url)] >= 3]
    assert len(large) > 200 and sum(plain[k] == named[k][1] for k in large) >= 0.95 * len(large)


def test_long_pages_end():
    """20,000 blocks by turns, and as many boxes of different kinds, in seconds and little memory."""
    import time
    import tracemalloc

    one = wrapper.read_page("<html><body><article><h2>a</h2><p>b</p></article></body></html>")[0]
    turns = "".join(f"<h2>t{k}</h2><p>x {k}</p>" for k in range(20_000))
    boxes = "".join(f"<div class='k{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}'><p>x {k}</p></div><section><span>y</span>z{k}</section>" for k in range(5_000))
    other = wrapper.read_page(f"<html><body><article>{boxes[300:]}</article></body></html>")[0]
    for body, exemplar, want in ((turns, one, 40_000), (boxes, other, 10_000)):
        tracemalloc.start()
        began = time.process_time()
        text = wrapper.main_text(f"<html><body><article>{body}</article></body></html>", exemplar, ())
        spent, (_, most) = time.process_time() - began, tracemalloc.get_traced_memory()
        tracemalloc.stop()
        assert text.count("\n") + 1 == want and spent < 40 and most < 200e6


def test_names_in_an_article_drop_nothing():
    body = '<article><h1>T</h1><p class="alert">One <span class="social">two</span> three</p><div class="reactions">four</div><div class="related">five</div><p class="comment">six</p></article>'
    assert wrapper.main_text(f"<html><body><nav>menu</nav>{body}<footer>end</footer></body></html>") == "T\nOne two three\nfour\nfive\nsix"


def test_pages_of_odd_tables(spark):
    """Repeated rows, ties, nulls, clashing columns, hosts of one page."""
    page = "<html><body><nav>a b</nav><article><p>text {}</p></article></body></html>"
    rows = [(1, "http://h/1", page.format(1), "x", 1)] * 3 + [(1, "http://h/1", page.format(2), "x", 1), (None, None, None, None, None), (2, "http://g/", page.format(3), "x", 1), (3, "u", "", "", 0)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, host string, exemplar int")
    got = sorted(((r.page_id, r.text) for r in wrapper.extract(frame).collect()), key=str)
    assert got == sorted([(1, "text 1")] * 3 + [(1, "text 2"), (None, ""), (2, "text 3"), (3, "")], key=str)
    assert wrapper.extract(frame.limit(0)).count() == 0


WRAPPED = {
    "MIT": """MIT License

Permission is hereby granted, free of charge, to any person obtaining a
copy of this software and associated documentation files (the
"Software"), to deal in the Software without restriction, including
without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to
permit persons to whom the Software is furnished to do so.""",
    "BSD": """# Redistribution and use in source and binary forms, with or without
# modification, are permitted provided that the following conditions are
# met:
# Redistributions of source code must retain the above copyright notice,
# this list of conditions and the following disclaimer.""",
    "GPL": """This program is free software: you can redistribute it and/or modify it
under the terms of the GNU General Public License as published by the
Free Software Foundation, either version 3 of the License, or (at your
option) any later version.""",
    "Apache": """ * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an as is basis,
 * without warranties or conditions of any kind, either express or
 * implied.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.""",
}


def test_wrapped_licence_texts_and_choices(spark):
    texts = [(k, t) for k, t in enumerate(WRAPPED.values())] + [(50, "Licensed under the MIT License or the Apache License, Version 2.0."), (51, "Available under the GNU GPL or MPL-2.0."), (52, "Licensed under the GNU Lesser General Public License."), (53, "He walked\nto the pub that has a licence\nto sell beer.")]
    got = {r.doc_id: r.paragraphs for r in licences.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    for k, family in enumerate(WRAPPED):
        assert {p.family for p in got[k] if p.confirmed} == {family}, family
    both = lambda k: {f for p in got[k] if p.confirmed for f in (p.family, *p.also)}
    assert both(50) == {"MIT", "Apache"} and both(51) == {"GPL", "MPL"} and both(52) == {"LGPL"} and both(53) == set()
    for k, t in texts:
        assert [(x.paragraph, x.family, x.confirmed, round(x.probability, 3), round(x.similarity, 6)) for x in got[k]] == restated(t), t[:100]


def test_licences_of_odd_tables(spark, odd, none):
    rows = licences.scan(odd.withColumn("paragraphs", F.lit(1))).collect()
    assert len(rows) == odd.count() and all(r.paragraphs == [] for r in rows) and sum(r.doc_id is None for r in rows) == 2
    twice = spark.createDataFrame([(1, "Licensed under MIT."), (1, "Licensed under MIT."), (None, "Licensed under MIT.")], "doc_id long, text string")
    assert [[p.family for p in r.paragraphs] for r in licences.scan(twice).collect()] == [["MIT"]] * 3 and licences.scan(none).count() == 0
