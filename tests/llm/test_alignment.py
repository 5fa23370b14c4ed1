"""Tokenizer alignment against a walk over both token lists, and its merge of runs."""

import collections
import hashlib
import os

import numpy as np
import pytest

from dwellstat.llm import alignment

pytestmark = pytest.mark.skipif(not os.path.isdir(alignment.FOLDER), reason="vocabulary files not present")


@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner(*alignment._files(alignment.FOLDER, (alignment.BYTE_BPE, alignment.PIECE_BPE)))


def walked(aligner, text):
    """(A ids, B ids, groups in print, links) by stepping along both sides, or nothing."""
    if not text:
        return [], [], [], []
    a, b = aligner.a.encode(" " + text, add_special_tokens=False).ids, aligner.b.encode(text)
    whole = (" " + text).encode()
    if b"".join(aligner.bytes_a[i] for i in a) != whole or b"".join(aligner.bytes_b[i] for i in b) != whole:
        return [], [], [], []
    groups, links, i, j, end_a, end_b, since_a, since_b = [], [], 0, 0, len(aligner.bytes_a[a[0]]), len(aligner.bytes_b[b[0]]), 0, 0
    while True:
        links.append((a[i], b[j]))
        ahead_a, ahead_b = end_a <= end_b, end_b <= end_a
        if ahead_a and ahead_b:
            groups.append(",".join(map(str, a[since_a:i + 1])) + "|" + ",".join(map(str, b[since_b:j + 1])))
            since_a, since_b = i + 1, j + 1
            if since_a == len(a):
                return a, b, groups, links
        if ahead_a:
            i += 1
            end_a += len(aligner.bytes_a[a[i]])
        if ahead_b:
            j += 1
            end_b += len(aligner.bytes_b[b[j]])


def expected(aligner, texts):
    found = [walked(aligner, t) for t in texts]
    count = collections.Counter(link for f in found for link in f[3])
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    for a, b, groups, links in found:
        yield (len(a), len(b), len(groups), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links),
               hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def check(spark, aligner, texts):
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, n_a int").repartition(4)
    out = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in alignment.aligned(df).collect()}
    assert [out[i] for i in range(len(texts))] == list(expected(aligner, texts))
    return out


def test_odd_texts(spark, aligner):
    texts = [None, "", " ", "a", "\n\n x\ty", "<|endoftext|> and <s> </s>", "naïve café ﬁne", "日本語 текст 🙂", "x" * 300, "don't  stop\r\n", "same", "same", "\u2581under", "word " * 15000, "x" + " " * 60000 + "y"]
    out = check(spark, aligner, texts)
    assert out[0] == out[1] == (0, 0, 0, 0, 0, 0, "")
    assert out[5][0] > 3 and out[10] == out[11]


def test_documents_in_many_runs(spark, sf_dir, aligner, monkeypatch):
    """Small runs and blocks: texts lie across runs, and the merge takes several rounds."""
    monkeypatch.setattr(alignment, "RUN_LINKS", 400)
    monkeypatch.setattr(alignment, "BLOCK", 16)
    monkeypatch.setattr(alignment, "FAN_IN", 2)
    monkeypatch.setattr(alignment, "SALT_RECORDS", 50)
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(40).collect()]
    check(spark, aligner, texts)


def test_pair_table_counts_every_link(spark, aligner):
    texts = ["the cat sat", "the cat ran", "a cat"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = collections.Counter(link for t in texts for link in walked(aligner, t)[3])
    assert {(r.a_id, r.b_id): r["count"] for r in alignment.pair_table(df).collect()} == dict(want)


def test_empty_table_and_unreadable_files(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.aligned(df).count() == 0
    with pytest.raises(FileNotFoundError):
        alignment.aligned(df, folder=str(tmp_path))


def test_merge_of_runs_sums_equal_pairs():
    rng = np.random.default_rng(1)
    runs = [alignment._counted(rng.integers(0, 500, 300), rng.integers(1, 9, 300)) for _ in range(7)]

    def blocks(run, step=11):
        for at in range(0, len(run[0]), step):
            yield [run[0][at:at + step], run[1][at:at + step]]

    merged = list(alignment._merged([blocks(r) for r in runs]))
    pairs = np.concatenate([m[0] for m in merged])
    assert (np.diff(pairs) > 0).all()
    want = collections.Counter()
    for p, n in runs:
        want.update(dict(zip(p.tolist(), n.tolist())))
    assert dict(zip(pairs.tolist(), np.concatenate([m[1] for m in merged]).tolist())) == dict(want)
