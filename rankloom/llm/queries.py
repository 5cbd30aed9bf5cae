"""The registered queries of the text operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import (
    conversation_trie, exact_dedup, line_dedup, minhash, packing, phrases, pii, sentencepiece, substring_dedup, toxicity, url_rules,
    vptree, warc,
)
from rankloom.llm.common import small_batches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

TOXIC_SCORE = 0.3
PII_KEY = "rankloom"  # of the test tables only: a real key is the caller's secret


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def toxic_judge(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> toxicity.Judge:
    """Fitted on labels outside the held-out quarter."""
    labels = table(spark, sf_dir, "labels").filter(~held_out("doc_id"))
    return toxicity.fit(table(spark, sf_dir, "documents") if docs is None else docs, labels)


def held_out(id: str):
    return F.pmod(F.crc32(F.col(id).cast("string").cast("binary")), F.lit(4)) == 2


@query("op1_best_fit_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


@query("op2_sentencepiece")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    small_batches(spark)
    pieces = sentencepiece.load_pieces(spark, public_tokenizers.path("piece_bpe_32k.model"))
    back = sentencepiece.decode(sentencepiece.encode(table(spark, sf_dir, "documents"), pieces), pieces, keep_ids=True)
    return back.select("doc_id", F.size("ids").alias("n_tokens"), "ids", F.sha2("text", 256).alias("decoded_sha256"))


@query(
    "op3_exact_dedup",
    """
    WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
    SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
           doc_id = max(doc_id) OVER g AS kept, text_sha256
    FROM d WINDOW g AS (PARTITION BY text_sha256)
    """,
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.deduplicate(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@query(
    "op4_line_dedup",
    """
    WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                      generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
    w AS (SELECT doc_id, pos, line, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS next FROM l),
    r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY line, next ORDER BY doc_id, pos) > 1 AS again
          FROM w WHERE next IS NOT NULL),
    m AS (SELECT l.doc_id, l.pos, l.line,
                 coalesce(a.again, false) OR coalesce(b.again, false) AS gone
          FROM l LEFT JOIN r a ON a.doc_id = l.doc_id AND a.pos = l.pos
                 LEFT JOIN r b ON b.doc_id = l.doc_id AND b.pos = l.pos - 1)
    SELECT doc_id, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS text_sha256,
           count(*) FILTER (WHERE gone) AS removed_lines
    FROM m GROUP BY doc_id
    """,
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.without_repeats(table(spark, sf_dir, "documents"), removed="removed_lines")
    return out.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), "removed_lines")


@query("op4_line_dedup_passages")
def op4_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages by their length in words, be they one line or many; ``op4_line_dedup`` is the rule of its SQL."""
    out = line_dedup.without_repeats(table(spark, sf_dir, "documents"), words=line_dedup.WORDS, removed="removed_lines")
    return out.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), "removed_lines")


@query("op5_vantage_point_neighbours")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return vptree.nearest(vectors, vectors.filter("vec_id % 20 = 0"), k=20)


@query("op6_pii_surrogates")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY, spans="entities")


@query("op7_url_rules")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"))


@query(
    "op8_warc",
    """
    WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
    f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
    SELECT page_id, payload_bytes,
           array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               1 + ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1) FOR i IN range(32)], '') AS payload_digest,
           CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> first THEN first END AS refers_to
    FROM f
    """,
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archived(table(spark, sf_dir, "pages"))
    return records.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    judge = toxic_judge(spark, sf_dir)
    return toxicity.score(table(spark, sf_dir, "documents"), judge).select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= TOXIC_SCORE).cast("int").alias("predicted")
    )


@query("op10_minhash_near_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=5, percent=85)


@query(
    "op11_substring_dedup",
    """
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
    w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d),
    v AS (SELECT *, count(*) OVER r AS n, md5(string_agg(word, ' ') OVER r) AS h FROM w
          WINDOW r AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
    s AS (SELECT *, n = 20 AND row_number() OVER (PARTITION BY h, n = 20 ORDER BY doc_id, i) > 1 AS again FROM v),
    c AS (SELECT doc_id, i, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM s),
    g AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM c GROUP BY doc_id)
    SELECT d.doc_id, len(words) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM d LEFT JOIN g ON g.doc_id = d.doc_id
    """,
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.without_repeats(table(spark, sf_dir, "documents"), window=20).drop("removed")


@query(
    "op12_phrases",
    """
    WITH t AS (SELECT coalesce(lang, 'und') AS lang,
                      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
    p AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM t),
    w AS (SELECT row_number() OVER () AS id, lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
    s AS (SELECT id, lang, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM w),
    g AS (SELECT lang, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM s WINDOW o AS (PARTITION BY id ORDER BY i)),
    d AS (SELECT lang, unnest([1, 2, 3]) AS words, unnest([w, w || ' ' || w2, w || ' ' || w2 || ' ' || w3]) AS v FROM g),
    f AS (SELECT lang, words, v, count(*) AS f FROM d WHERE v IS NOT NULL GROUP BY ALL),
    n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE words = 1 GROUP BY lang),
    c AS (SELECT lang, words, v, f AS a, string_split(v, ' ') AS w FROM f WHERE words > 1 AND f >= 10),
    x AS (SELECT lang, v, a, 1 AS k, w[1] AS p, substr(v, length(w[1]) + 2) AS q FROM c
          UNION ALL SELECT lang, v, a, 2, w[1] || ' ' || w[2], w[3] FROM c WHERE words = 3),
    k AS (SELECT x.lang, x.v, a, k, l.f AS l, r.f AS r, ((1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f))::BIGINT AS score
          FROM x JOIN f l ON l.lang || chr(9) || l.v = x.lang || chr(9) || x.p
               JOIN f r ON r.lang || chr(9) || r.v = x.lang || chr(9) || x.q),
    b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang, v ORDER BY score, k) = 1),
    i AS (SELECT lang, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS v, a FROM c WHERE words = 3),
    m AS (SELECT lang, v, max(a) AS longer FROM i GROUP BY ALL),
    o AS (SELECT b.*, b.v AS phrase FROM b LEFT JOIN m ON m.lang = b.lang AND m.v = b.v WHERE m.longer IS NULL OR 100 * m.longer < 50 * a)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
    FROM o JOIN n USING (lang) QUALIFY rank <= 2000
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), least_words=2, words=3, least=10, percent=50, top=2000)


@query(
    "op13_conversation_trie",
    """
    WITH o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                      row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS pos
               FROM conversations WHERE conv_id IS NOT NULL),
    c AS (SELECT conv_id, count(*) AS n, conv_id - conv_id % 5 AS base,
                 xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(
                     [[ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] FOR x IN string_split(conv_id::VARCHAR, '')])),
                     lambda a, e: CASE WHEN e >= 0 THEN xor(a, e) ELSE xor(a >> 1, 3988292384 * (a & 1)) END)) % 9 AS h
          FROM o GROUP BY conv_id),
    m AS (SELECT c.conv_id, c.base, c.h, least(c.h, coalesce(b.n, 0)) AS taken,
                 least(c.h, coalesce(b.n, 0)) + greatest(c.n - c.h, 0) AS length
          FROM c LEFT JOIN c b ON b.conv_id = c.base),
    r AS (SELECT m.conv_id, o.pos AS depth, role, text FROM m JOIN o ON o.conv_id = m.base AND o.pos <= m.h
          UNION ALL SELECT m.conv_id, o.pos - m.h + m.taken, role, text FROM m JOIN o ON o.conv_id = m.conv_id AND o.pos > m.h),
    p AS (SELECT conv_id, depth, octet_length(encode(text)) AS bytes,
                 list(sha256(role) || sha256(text)) OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM r
          UNION ALL SELECT conv_id, 0, 0, []::VARCHAR[] FROM m),
    v AS (SELECT path, depth, min(p.conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes,
                 sha256(coalesce(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) FILTER (WHERE depth = length), '')) AS ends_sha256
          FROM p JOIN m ON m.conv_id = p.conv_id GROUP BY path, depth),
    k AS (SELECT path[1:depth - 1] AS path, depth - 1 AS depth, count(*) AS n_children FROM v WHERE depth > 0 GROUP BY ALL),
    w AS (SELECT v.*, coalesce(n_children, 0) AS n_children FROM v LEFT JOIN k ON k.path = v.path AND k.depth = v.depth),
    s AS (SELECT p.path, p.depth, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * w.bytes)::BIGINT AS saved_tokens
          FROM w JOIN p ON p.conv_id = w.conv_id AND p.depth <= w.depth GROUP BY ALL)
    SELECT w.conv_id, w.depth, u.conv_id AS parent_conv_id, w.n_convs, w.n_children, s.n_leaves, s.saved_tokens, w.ends_sha256
    FROM w JOIN s ON s.path = w.path AND s.depth = w.depth
    LEFT JOIN w u ON w.depth > 0 AND u.depth = w.depth - 1 AND u.path = w.path[1:w.depth - 1]
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversation_trie.ordered_turns(table(spark, sf_dir, "conversations"))
    members, rebuilt = conversation_trie.shared_starts(turns, family=5, heads=9)
    return conversation_trie.prefix_trie(members, rebuilt).drop("enters_at")
