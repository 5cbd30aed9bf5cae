import hashlib
from collections import defaultdict

from rankloom.llm import exact_dedup
from rankloom.llm.common import new_folder


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    return sorted(
        (
            (i, max((x for x in groups[t or ""] if x is not None), default=None), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest())
            for i, t in rows
        ),
        key=str,
    )


def found(df):
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], bytes(r["digest"]).hex()) for r in df.collect()), key=str)


def test_against_brute_force(documents, odd_docs, no_docs):
    for docs in (documents, odd_docs):
        out = exact_dedup.deduplicate(docs)
        assert found(out) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])
        assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in out.collect())
    assert exact_dedup.deduplicate(no_docs).count() == 0


def test_hot_text(spark):
    rows = [(i, "same" if i % 3 == 0 else f"text {i // 2}") for i in range(6000)]
    assert found(exact_dedup.deduplicate(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5))) == brute(rows)


def test_whole_rows_stay(odd_docs, no_docs):
    kept = exact_dedup.unique_documents(odd_docs)
    assert kept.schema == odd_docs.schema
    assert sorted((r["doc_id"] for r in kept.collect())) == [1, 3, 6, 8, 9, 10, 11, 12, 13, 13]
    assert exact_dedup.unique_documents(no_docs).count() == 0


def test_index_persists(spark):
    folder = new_folder(spark, "index")
    first = spark.createDataFrame([(1, "a"), (2, "b"), (9, "a")], "doc_id bigint, text string")
    second = spark.createDataFrame([(20, "a"), (21, "c"), (22, "c")], "doc_id bigint, text string")
    exact_dedup.deduplicate(first, exact_dedup.DigestIndex(spark, "digests_one", folder, buckets=4))
    spark.sql("DROP TABLE digests_one")  # external: its files stay
    index = exact_dedup.DigestIndex(spark, "digests_two", folder, buckets=4)
    out = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in exact_dedup.deduplicate(second, index).collect()}
    assert out == {20: (9, False), 21: (22, False), 22: (22, True)}
    again = {r["doc_id"]: r["keep_id"] for r in exact_dedup.deduplicate(second, index).collect()}
    assert again == {20: 9, 21: 22, 22: 22} and index.rows().count() == 3


def test_index_side_is_not_shuffled(spark):
    index = exact_dedup.DigestIndex.temporary(spark)
    plan = spark.range(5).select(exact_dedup.digest("id").alias("digest")).join(index.rows().hint("merge"), "digest", "left_anti")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in text and text.count("Exchange hashpartitioning") == 1
