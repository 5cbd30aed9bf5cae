import numpy as np
import pytest

from rankloom.llm import toxicity
from rankloom.llm.queries import held_out, toxic_judge


def auc(score, y):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    p = y.sum()
    return (rank[y == 1].sum() - p * (p + 1) / 2) / (p * (len(y) - p))


@pytest.fixture(scope="module")
def judge(spark):
    return toxic_judge(spark, "/root/testdata/sf0.01")


def test_held_out_accuracy(spark, judge):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity.score(docs.filter(held_out("doc_id")), judge).join(labels, "doc_id").toPandas()
    assert rows["score"].between(0, 1).all()
    assert auc(rows["score"].values, rows["toxic"].values) > 0.75
    clean = rows[rows["toxic"] == 0]
    assert (clean["score"] >= 0.5).mean() < 0.03


def test_gain_is_a_difference_of_compressed_lengths(judge):
    import zstandard

    own = [zstandard.ZstdCompressionDict(d) for d in (judge.ordinary, judge.toxic)]
    window = toxicity._framed(b"idiot")
    sizes = [len(zstandard.ZstdCompressor(level=toxicity.LEVEL, dict_data=d, write_content_size=False, write_dict_id=False).compress(window)) for d in own]
    assert judge.gains([b"idiot"])[0] == sizes[0] - sizes[1]
    assert judge.gains([b"idiot"])[0] > judge.gains([b"the"])[0]


def test_odd_rows(odd_docs, no_docs, judge):
    out = {r["doc_id"]: r["score"] for r in toxicity.score(odd_docs, judge).collect()}
    assert len(out) == 13 and out[2] == out[3] and all(0 <= s <= 1 for s in out.values())
    assert out[13] > out[5]
    assert toxicity.score(no_docs, judge).count() == 0
    kept = toxicity.keep_ordinary(odd_docs, judge, 0.5)
    assert kept.schema == odd_docs.schema and kept.count() == sum(r["score"] < 0.5 for r in toxicity.score(odd_docs, judge).collect())


def test_no_labels(odd_docs, spark):
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id bigint, toxic int")
    judge = toxicity.fit(odd_docs, labels)
    assert {r["score"] for r in toxicity.score(odd_docs, judge).collect()} == {0.5}


def test_memo_does_not_change_counts(judge, monkeypatch):
    texts = ["the idiot " * 50 + " ".join(f"w{i}x" for i in range(400)), "", "zzz " * 9]
    want = judge.counts(texts)
    monkeypatch.setattr(toxicity, "MEMO", 20)
    small = toxicity.Judge(judge.toxic, judge.ordinary, judge.weights)
    assert (small.counts(texts) == want).all()
