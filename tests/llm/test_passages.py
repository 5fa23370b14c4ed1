"""Repeated passages of one line and more, as the pipeline removes them."""

import random

import corpus_pipeline
from dwellstat.llm import line_dedup


def without_passages(rows):
    """The rule in plain Python: rows of (doc_id, text) with distinct texts to an id."""
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        lines = (t or "").split("\n")
        full = [j for j, x in enumerate(lines) if x.strip()]
        gone = set()
        for n, j in enumerate(full):
            for begin in ([full[n - 1]] if n else []) + ([j] if len(lines[j].split()) > 50 else []):
                passage = tuple(lines[k] for k in (begin, j)) if begin != j else (lines[j],)
                if passage in seen:
                    gone |= set(range(begin, j + 1))
                seen.add(passage)
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone) if t is not None else None
    return out


def case():
    r = random.Random(4)
    line = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    passages = {n: [line(60 if n == 1 else 30) for _ in range(n)] for n in range(1, 6)}
    texts = {}
    for i in range(60):
        n = 1 + i % 5
        texts[i] = [line(8) for _ in range(1 + r.randrange(4))] + passages[n] + [line(8) for _ in range(1 + r.randrange(4))]
    rows = [(i, "\n".join(x)) for i, x in texts.items()]
    return passages, rows


def test_planted_passages_of_one_to_five_lines(spark):
    passages, rows = case()
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_repeated_passages(spark, docs, "").collect()}
    for i, t in rows:
        passage = passages[1 + i % 5]
        want = t if i < 5 else "\n".join(x for x in t.split("\n") if x not in passage)
        assert got[i] == want


def test_passages_against_plain_python(spark):
    r = random.Random(9)
    stock = ["a", "b", "", " ", "c d", "x " * 51, "x " * 50, "long " * 80, "e"]
    rows = [(i, "\n".join(r.choice(stock) + r.choice(["", "", str(r.randrange(40))]) for _ in range(r.randrange(25)))) for i in range(80)]
    rows += [(90, None), (91, ""), (92, "\n\n"), (None, rows[7][1])]
    docs = spark.createDataFrame(rows + [rows[7]], "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS body", "3 AS begin")
    out = line_dedup.without_passages(docs)
    assert out.columns == docs.columns
    got, want = out.collect(), without_passages(rows)
    assert len(got) == len(rows) + 1
    for x in got:
        assert x.text == want[x.doc_id], x
    assert line_dedup.without_passages(docs.where("false")).count() == 0
    one_id = spark.createDataFrame([(None, "a b\nc d\ne"), (None, "a b\nc d\nf")], "doc_id long, text string")
    assert sorted(len(x.text) for x in line_dedup.without_passages(one_id).collect()) == [1, 9]


def test_passages_of_one_to_eight_lines_are_found(spark):
    """60 passages of each length in two documents each, between foreign lines: all of two lines and more go once."""
    r = random.Random(12)
    line = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    rows, lost = [], {}
    for n in range(1, 9):
        for k in range(60):
            passage = [line(60 if n == 1 else 9) for _ in range(n)]
            for side in (0, 1):
                doc = 10_000 * side + 100 * n + k
                rows.append((doc, "\n".join([line(7) for _ in range(3)] + passage + [line(7) for _ in range(3)])))
                lost[doc] = n * side
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x.doc_id: x.n_removed_lines for x in line_dedup.report(docs).collect()} == lost


def test_copies_are_met_by_chunks(spark):
    """Chunks end by content alone, and of a copy only chunks and the pairs that lead into them are compared."""
    r = random.Random(3)
    line = lambda: " ".join(f"w{r.randrange(10**6)}" for _ in range(9))
    passage = [line() for _ in range(40)]
    texts = {i: [line() for _ in range(i)] + passage + [line() for _ in range(2)] for i in range(1, 6)}
    docs = spark.createDataFrame([(i, "\n".join(x)) for i, x in texts.items()], "doc_id long, text string")
    cuts = {}
    for x in docs.select("doc_id", line_dedup.chunks(docs.text).alias("c")).collect():
        assert [c.begin for c in x.c] == [0] + [c.end + 1 for c in x.c[:-1]] and x.c[-1].end == len(texts[x.doc_id]) - 1
        cuts[x.doc_id] = {c.end - x.doc_id for c in x.c if x.doc_id < c.end < x.doc_id + 40}
    assert len(set(map(frozenset, cuts.values()))) == 1 and 5 < len(cuts[1]) < 25
    rows = line_dedup.spots(docs).collect()
    count = lambda i: sum(x.place.doc_id == i for x in rows)
    assert count(1) == len(texts[1]) - 1  # the first occurrence: all its pairs
    ends = sorted(cuts[1])
    whole = sum(b - a > 1 for a, b in zip(ends, ends[1:]))  # chunks of one short line are no passages
    for i in range(2, 6):
        assert whole <= sum(x.id is None for x in rows if x.place.doc_id == i) <= whole + 2
        assert count(i) < count(1)
    got = {x.doc_id: x.n_removed_lines for x in line_dedup.report(docs).collect()}
    assert got == {1: 0, 2: 40, 3: 40, 4: 40, 5: 40}
