import random

from rankloom.llm import line_dedup


def brute(rows, run):
    """Every window by its lines; the first by id and place stays."""
    first, gone = {}, {}
    for i, t in sorted({(i, t or "") for i, t in rows if i is not None}):
        lines = t.split("\n")
        for at in range(len(lines) - run + 1):
            key = tuple(lines[at : at + run])
            if first.setdefault(key, (i, at)) != (i, at):
                gone.setdefault(i, set()).update(range(at, at + run))
    return {i: (t if i not in gone else "\n".join(x for k, x in enumerate((t or "").split("\n")) if k not in gone[i]), len(gone.get(i, ()))) for i, t in rows}


def found(df):
    return {r["doc_id"]: (r["text"], r["removed"]) for r in df.collect()}


def test_whole_table(documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    for run in (1, 2, 4):
        assert found(line_dedup.without_repeats(documents, run=run, removed="removed")) == brute(rows, run)


def test_overlapping_hot_and_chained_runs(spark):
    rng = random.Random(4)
    alphabet = [f"line {k}" for k in range(12)]
    rows = [(i, "\n".join(rng.choice(alphabet) for _ in range(rng.randrange(9)))) for i in range(150)]
    rows += [(200 + i, "hot\nvery hot\nhottest\n" + f"own {i}") for i in range(100)] + [(400, "a\na\na\na\na"), (401, "a\na")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    for run in (2, 3):
        assert found(line_dedup.without_repeats(docs, run=run, removed="removed")) == brute(rows, run)


def test_odd_rows(odd_docs, no_docs):
    out = line_dedup.without_repeats(odd_docs, removed="removed")
    assert found(out) == brute([(r["doc_id"], r["text"]) for r in odd_docs.collect()], 2)
    assert line_dedup.without_repeats(odd_docs).schema.names == odd_docs.schema.names
    assert line_dedup.without_repeats(no_docs).count() == 0


def test_no_python_in_the_plan(documents):
    plan = line_dedup.without_repeats(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def brute_words(rows, words):
    """Every run of lines with at least so many words, blank lines left out; the first by id and place stays."""
    first, gone = {}, {}
    for i, t in sorted({(i, t or "") for i, t in rows if i is not None}):
        lines = [(k, x, len(x.split())) for k, x in enumerate(t.split("\n")) if x.split()]
        for a in range(len(lines)):
            held = 0
            for b in range(a, len(lines)):
                held += lines[b][2]
                if held >= words:
                    key = tuple(x for _, x, _ in lines[a : b + 1])
                    if first.setdefault(key, (i, lines[a][0])) != (i, lines[a][0]):
                        gone.setdefault(i, set()).update(k for k, _, _ in lines[a : b + 1])
    return {i: (t if i not in gone else "\n".join(x for k, x in enumerate((t or "").split("\n")) if k not in gone[i]), len(gone.get(i, ()))) for i, t in rows}


def test_passages_by_their_words(spark):
    rng = random.Random(6)
    passage = " ".join(f"w{k}" for k in range(60))
    alphabet = ["", "{", "a b", "one two three", "four five six seven", "eight nine ten eleven twelve"]
    rows = [(i, "\n".join(rng.choice(alphabet) for _ in range(rng.randrange(12)))) for i in range(120)]
    rows += [(200, passage), (201, passage), (202, f"before\n{passage}\nafter"), (203, f"other\n\n{passage}\nend"), (204, None), (205, "{\n\n}\n{\n\n}")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    for words in (4, 9, 50):
        assert found(line_dedup.without_repeats(docs, words=words, removed="removed")) == brute_words(rows, words)
    out = found(line_dedup.without_repeats(docs, words=50, removed="removed"))
    assert out[200][0] == passage and out[201] == ("", 1) and out[202] == ("before\nafter", 1) and out[203][0] == "other\n\nend"
    assert out[205] == ("{\n\n}\n{\n\n}", 0)


def test_passages_of_the_whole_table(documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.filter("length(text) < 4000").collect()]
    out = line_dedup.without_repeats(documents.filter("length(text) < 4000"), words=line_dedup.WORDS, removed="removed")
    assert found(out) == brute_words(rows, line_dedup.WORDS)


def test_repeated_ids_and_clashing_names(spark):
    rows = [(0, "x\ny", 7), (1, "x\ny", 7), (1, "p\nq", 7), (1, "p\nq", 7), (2, "p\nq\nr", 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, removed_lines int")
    out = line_dedup.without_repeats(docs, removed="removed_lines")
    assert out.columns == ["doc_id", "text", "removed_lines", "_removed_lines"]
    assert sorted((r["doc_id"], r["text"], r["_removed_lines"]) for r in out.collect()) == [
        (0, "x\ny", 0), (1, "", 2), (1, "p\nq", 0), (1, "p\nq", 0), (2, "r", 2)
    ]
