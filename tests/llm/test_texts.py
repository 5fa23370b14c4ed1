"""The operators with Python in their tasks, against brute force on small fixtures."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dwellstat.llm import decontamination, html_extraction, language_id, near_dedup, suffix_dedup, textkernel, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, lang="en"):
    rows = [(i, t, lang, "s", 0) for i, t in (texts.items() if isinstance(texts, dict) else texts)]
    return spark.createDataFrame(rows, DOCS)


def prose(seed, n, stock="abcdefgh"):
    r = random.Random(seed)
    return " ".join("".join(r.choice(stock) for _ in range(r.randint(2, 7))) for _ in range(n))


def shingled(text, fold=False):
    words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower()) if fold else re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return collections.Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))


def test_words_hash_the_same_everywhere(monkeypatch):
    texts = [prose(i, 30) for i in range(40)] + ["", None, " \x0b ", "é ü", "x" * 9000, "a" * 30 + " " + prose(3, 2000)]
    whole = textkernel.words(*textkernel.utf8(pa.array(texts)))
    monkeypatch.setattr(textkernel, "BLOCK", 64)
    cut = textkernel.words(*textkernel.utf8(pa.array(texts)))
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()
    words = [w for t in texts for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    assert len(words) == len(whole[0])
    seen = {}
    for w, h in zip(words, whole[0].tolist(), strict=True):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_dart_minhash_estimates_weighted_similarity():
    r = np.random.default_rng(1)
    elements = r.integers(0, 1 << 63, 300).astype(np.uint64)
    a, b = r.integers(1, 6, 300).astype(float), None
    b = a.copy()
    b[:120] = np.maximum(1, b[:120] - 2) + 0.5
    owner = np.repeat([0, 1], 300)
    got = near_dedup.dart_minhash(owner, np.concatenate([elements, elements]), np.concatenate([a, b]), 2, coordinates=2000, darts=40_000)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert (got[0] == got[1]).mean() == pytest.approx(want, abs=0.035)


def near_case():
    texts = {}
    for g in range(12):
        base = prose(g, 60 + 20 * g).split()
        for c in range(9):
            r, words = random.Random(100 * g + c), list(base)
            for _ in range(c):
                words[r.randrange(len(words))] = f"new{r.randrange(10**6)}"
            texts[g * 20 + c] = " ".join(words)
        texts[g * 20 + 15] = texts[g * 20]
    passage = prose(999, 80)
    texts |= {500 + i: passage + " " + prose(2000 + i, 15 + i) for i in range(30)}
    return texts | {900: "", 901: "", 902: None, 903: None, 904: "a b c", 905: "a b c", 906: "a b d", 907: "a b c d e", 908: "a b c d e f"}


def near_classes(texts):
    parent = {k: k for k in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = {k: shingled(t) for k, t in texts.items()}
    keys = sorted(texts)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            same = texts[a] is not None and texts[a] == texts[b]
            both = sum((sets[a] & sets[b]).values())
            if same or both and both >= 0.8 * sum((sets[a] | sets[b]).values()):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in texts}


def test_near_classes(spark):
    texts = near_case()
    docs = docs_of(spark, texts).union(docs_of(spark, {0: texts[0]})).withColumn("row", F.lit("x")).withColumn("bands", F.lit(0))
    want = near_classes(texts)
    rows = near_dedup.classes(docs).collect()
    assert len(rows) == len(texts) + 1
    assert {r.doc_id: r.class_id for r in rows} == want
    assert collections.Counter(r.class_id for r in rows if r.stays) == collections.Counter(set(want.values()))
    kept = near_dedup.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_near_empty(spark):
    assert near_dedup.classes(docs_of(spark, {})).count() == 0
    assert near_dedup.deduplicated(docs_of(spark, [(None, "a b c d e f", ), (None, "a b c d e f"), (None, None)])).count() == 2


def test_leaks(spark):
    items = {i: prose(5000 + i, 18 + i) for i in range(20)} | {90: None, 91: "too short", 92: prose(5003, 21)}
    texts = {i: prose(i, 30 * (1 + i % 40)) for i in range(120)}
    for i in range(0, 120, 3):
        words = items[i % 20].split()
        if i % 2:
            words[len(words) // 2] = "changed"
        texts[i] = texts[i] + ". " + ", ".join(words).upper() + "\n" + prose(i + 7, 400)
    texts |= {200: None, 201: "", 202: items[4], 203: " ".join(items[4].split()[:12])}
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    docs = docs_of(spark, texts).withColumn("hash", F.lit(1)).withColumn("item_id", F.lit(1))
    sets = {i: set(shingled(t, True)) for i, t in items.items()}
    want = {}
    for d, t in texts.items():
        own = set(shingled(t, True))
        for i, s in sets.items():
            if s and len(s & own) >= 0.8 * len(s):
                want[d, i] = (len(s), len(s & own))
    got = {(r.doc_id, r.item_id): (r.n_shingles, r.n_found) for r in decontamination.leaks(docs, bench).collect()}
    assert got == want and len(want) > 20
    kept = decontamination.cleaned(docs, bench)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(texts) - {d for d, _ in want}
    assert decontamination.leaks(docs, bench.where("false")).count() == 0
    assert decontamination.leaks(docs.where("false"), bench).count() == 0


def test_languages(spark, sf_dir):
    stocks = {"xa": "abcdef", "xb": "fghijk", "xc": "éèüöäß"}
    rows = [(i, prose(i, 5 + i % 60, stocks[k]), k, "s", 0) for i, k in enumerate(sorted(stocks) * 60)]
    rows += [(900, None, "xa", "s", 0), (901, "12 34 !!", "xb", "s", 0), (902, "", None, "s", 0), (903, "abc def" * 3, None, "s", 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("lang_pred", F.lit("clash"))
    got = {r.doc_id: r for r in language_id.identified(docs).collect()}
    for i, t, k, *_ in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= got[i].score <= 1
        if i < 900:
            assert got[i].lang_pred == k
    assert [got[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "xa"]
    assert language_id.identified(docs.where("false")).count() == 0
    assert {r.lang_pred for r in language_id.identified(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_profile_ranks():
    grams, counts = language_id._grams(np.array([32, 97, 98, 97, 32], np.uint32))
    text = lambda g: "".join(chr((g >> s) & 0x1FFFFF) for s in (42, 21, 0) if (g >> s) & 0x1FFFFF)
    assert dict(zip(map(text, grams.tolist()), counts.tolist(), strict=True)) == {
        "a": 2, "b": 1, " a": 1, "ab": 1, "ba": 1, "a ": 1, " ab": 1, "aba": 1, "ba ": 1}


def test_toxicity_held_out(spark):
    r = random.Random(5)
    rows, labels = [], []
    for i in range(1200):
        words = prose(i, r.randint(20, 200)).split()
        bad, junk = i % 7 == 0, i % 5 == 0
        if bad:
            for _ in range(3):
                words[r.randrange(len(words))] = "zzyk" + prose(i, 1)
        if junk:
            words[:2] = ["qqjunk", "qqjunk"]
        rows.append((i, " ".join(words)))
        if i % 2:
            labels.append((i, int(not junk), int(bad)))
    docs = docs_of(spark, rows + [(5000, None), (5001, ""), (None, "plain words")]).withColumn("p_toxic", F.lit("clash"))
    labels = spark.createDataFrame(labels + [(1, None, None), (1, 1, 0), (99999, 1, 1)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in toxicity.judged(docs, labels).collect()}
    assert len(got) == 1203 and all(0 <= x.p_toxic <= 1 for x in got.values())
    held = [i for i in range(0, 1200, 2)]
    assert sum(got[i].rejected == (i % 7 == 0) for i in held) / len(held) > 0.97
    assert not got[5000].rejected and not got[5001].rejected
    kept = toxicity.filtered(docs, labels)
    assert kept.columns == docs.columns
    assert {x.doc_id for x in kept.collect()} == {i for i, x in got.items() if not x.rejected}


def test_toxicity_without_labels(spark):
    docs = docs_of(spark, {1: "some words", 2: None})
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.rejected for r in toxicity.judged(docs, none).collect()] == [False, False]
    one = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert [r.rejected for r in toxicity.judged(docs, one).collect()] == [False, False]
    assert toxicity.judged(docs.where("false"), one).count() == 0


def test_toxicity_sends_every_text_once(spark, monkeypatch):
    docs = docs_of(spark, {1: "some words", 2: None, 3: ""}).withColumn("p_toxic", F.lit("clash"))
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    sent, scored = [], toxicity.scored
    monkeypatch.setattr(toxicity, "scored", lambda rows, *a, **k: sent.append(rows.schema) or scored(rows, *a, **k))
    kept = toxicity.filtered(docs, labels)
    assert len(sent[0]["row"].dataType.fields) == len(docs.columns)  # a mark and every column but the text
    assert kept.columns == docs.columns and sorted(kept.collect(), key=str) == sorted(docs.collect(), key=str)


def test_warc_round_trip(spark):
    big, other = "<p>" + "é" * 600, "<p>" + "y" * 1500
    rows = [(1, "http://www.a.com:80/x y?q=1", big), (2, "http://b.org/", big), (3, None, big), (4, "http://b.org/", "small"), (5, "http://b.org/", "small"),
            (6, "nonsense", None), (7, "https://c.net/%", ""), (8, "http://b.org/", other), (8, "http://b.org/", other), (None, "http://b.org/", big),
            *[(100 + i, f"http://h{i % 9}.example.com/{i}", f"page {i} " * 40) for i in range(1300)]]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("file", F.lit(1))
    got = warc.round_trip(pages).collect()
    assert len(got) == len(rows)
    by_id = {r.page_id: r for r in got}
    for i, _, h in rows:
        body = (h or "").encode()
        assert (by_id[i].payload_bytes, by_id[i].payload_digest) == (len(body), hashlib.sha1(body).hexdigest())
        if by_id[i].record_type == "response":
            assert by_id[i].html == (h or "")
    assert [(by_id[i].record_type, by_id[i].refers_to) for i in (1, 2, 3, 4, 5, 8, None)] == [
        ("revisit", 3), ("revisit", 3), ("response", None), ("response", None), ("response", None), ("response", None), ("revisit", 3)]
    assert warc.round_trip(pages.where("false")).count() == 0


def test_reversed_host(spark):
    keys = spark.createDataFrame([("HTTP://www.Ex.com:8/a?b#c",), ("x",), (None,)], "u string").select(warc.reversed_host(F.col("u")).alias("k"))
    assert [r.k for r in keys.collect()] == ["com,ex,www)/a?b#c", ")x", ")"]


PAGE = ("<!DOCTYPE html><html><head><title>t</title><script>var x='</p>';</script><style>p{}</style></head><body class='page comments-on'>"
        "<header><a>logo</a></header><nav><ul><li>m1<li>m2</ul></nav><div class='ad-box'>buy</div><!-- <p>no</p> -->"
        "<article><header><h1>Head &amp; line</h1></header><p>one <b>two</b>\n three<br>four<p>five &lt;6 &copy<div>seven</div>"
        "<form><input>q</form><aside>side</aside><section class='reader comments'>c1</section><p>end</article>"
        "<div id='cookie-notice'>ok?</div><footer>foot</footer></body></html>")


def test_html_text():
    assert html_extraction.text_of(PAGE) == "Head & line\none two three four\nfive <6 ©\nseven\nend"
    assert html_extraction.text_of("") == "" and html_extraction.text_of("plain <b>te") == "plain te"
    assert html_extraction.text_of("a < b <p>c<scr") == "a < b\nc"
    assert html_extraction.text_of("<div>" * 20_000 + "deep") == "deep"
    assert html_extraction.text_of(f"<p>{'w ' * 200_000}</p>") == ("w " * 200_000).strip()


def test_site_style_tree_removes_what_repeats(spark):
    pages = [(i, "http://s.com/%d" % i, f"<body><div class='top'>Welcome to our site</div><div class='body'><p>{prose(i, 40)}</p></div>"
              f"<div class='more'>See {i % 2} also</div></body>") for i in range(60)]
    pages += [(100 + i, "http://copies.com/", "<div><p>always the same text</p></div>") for i in range(40)] + [(200, None, None), (200, None, None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("noise", F.lit(1))
    got = {r.page_id: r for r in html_extraction.extracted(df).collect()}
    assert all(got[i].text == prose(i, 40) and got[i].n_chars == len(prose(i, 40)) for i in range(60))
    assert got[100].text == "always the same text" and got[200].text == "" and got[200].n_chars == 0
    assert html_extraction.extracted(df).count() == len(pages)
    assert html_extraction.extracted(df.where("false")).count() == 0


def suffix_brute(texts):
    seen, out = {}, {}
    order = sorted(texts, key=lambda t: (t[0] is None, t[0] or 0))
    for i, t in order:
        b = (t or "").encode()
        for j in range(len(b) - 49):
            seen.setdefault(b[j:j + 50], i)
    for n, (i, t) in enumerate(order):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - 49):
            first = seen[b[j:j + 50]]
            if first is not None and (i is None or first < i):
                gone[j:j + 50] = True
        runs = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        out[n] = (i, len(b), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())
    return collections.Counter(out.values())


def suffix_case():
    passage, loop = prose(77, 40), "ab" * 120
    texts = [(i, prose(i, 20) + passage[i % 50:] + prose(i + 500, 9 + i)) for i in range(40)]
    texts += [(60 + i, "é" * (24 + i) + prose(i, 10)) for i in range(4)] + [(70, loop), (71, "x" + loop + "y"), (72, "a" * 49), (73, "a" * 49), (74, "a" * 300), (75, "a" * 51)]
    return texts + [(80, None), (81, ""), (82, texts[3][1]), (82, texts[4][1]), (82, texts[4][1]), (None, texts[5][1]), (None, prose(900, 60)), (None, prose(900, 60))]


def test_suffix_dedup(spark):
    texts = suffix_case()
    docs = docs_of(spark, texts).withColumn("row", F.lit("x")).withColumn("spans", F.lit(1))
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.report(docs).collect())
    assert got == suffix_brute(texts)
    assert suffix_dedup.report(docs.where("false")).count() == 0


def test_induced_sorting_with_tiny_blocks(monkeypatch, tmp_path):
    """Blocks of a few tuples and a queue that spills all the time give the same least documents."""
    monkeypatch.setattr(suffix_dedup, "BLOCK", 7)
    monkeypatch.setattr(suffix_dedup, "HELD", 20)
    r = random.Random(3)
    stock = [bytes(r.choice(b"ab") for _ in range(80)) for _ in range(6)]
    rows = [bytearray(r.choice(stock)) for _ in range(150)]
    for row in rows:
        for _ in range(r.randrange(3)):
            row[r.randrange(80)] = ord("c")
    columns = np.frombuffer(b"".join(map(bytes, rows)), np.uint8).reshape(150, 80)
    docs = np.array([r.randrange(1000) for _ in rows])
    got, same = suffix_dedup.least_documents(columns, docs, str(tmp_path))
    assert [same[i] for i in range(150)] == [rows.index(row) for row in rows]
    for p in range(31):
        least = {}
        for row, d in zip(rows, docs.tolist(), strict=True):
            least[bytes(row[p:p + 50])] = min(d, least.get(bytes(row[p:p + 50]), d))
        assert [least[bytes(row[p:p + 50])] for row in rows] == got[p].tolist()


def test_every_repeated_anchor_has_its_bit(spark):
    texts = suffix_case()
    rows = suffix_dedup._rows(docs_of(spark, texts), "text", "doc_id")
    bits = np.frombuffer(suffix_dedup.bitmap(suffix_dedup.repeated_anchors(rows)), np.uint8)
    seen = collections.Counter()
    for _, t in texts:
        body = np.frombuffer((t or "").encode(), np.uint8)
        seen.update({h for *_, hashes in suffix_dedup.anchors(body, np.array([0, len(body)])) for h in hashes.tolist()})
    found = dict(zip(seen, suffix_dedup._known(np.array(list(seen), np.uint64), bits).tolist(), strict=True))
    assert all(found[h] for h, n in seen.items() if n > 1)
    assert sum(found[h] for h, n in seen.items() if n == 1) < 0.1 * len(seen)
