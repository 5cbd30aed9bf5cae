"""URL verdicts: a given list of host and path rules, and association rules mined for the rest.

Urls that the list decides are the labelled baskets: their tokens (labels of the host with
their place, segments of the path, names of parameters) and their verdict. Spark's FP-growth finds
frequent token combinations; those that imply a verdict with enough confidence and support, and more
confidently than every shorter combination in them, become rules. A rule is filed in an inverted
index under its rarest token, so a url looks up its tokens and then checks the rules it finds.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import stored

SUPPORT, CONFIDENCE = 0.005, 0.8
#: (host, path, verdict): fixed values of the list.
LISTED = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"),
]
DEFAULT = "allow"
_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: str) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path as written; both empty for null or without ``://``."""
    u = F.coalesce(F.col(f"`{url}`").cast("string"), F.lit(""))
    rest = F.regexp_extract(u, r"(?s)^.*?://(.*)$", 1)
    return F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), *_LOWER), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def listed_rule(host: Column, path: Column, rules=LISTED) -> Column:
    """The longest fitting rule as struct(rule, verdict), or null. The list is short: one expression."""
    fits = [
        F.when(
            ((host == h) | host.endswith("." + h)) & path.startswith(p),
            F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")),
        )
        for h, p, v in rules
    ]
    return F.array_max(F.array_compact(F.array(*fits)))


def tokens(host: Column, path: Column, url: Column) -> Column:
    """The distinct tokens of a url: host labels from the right, path segments, parameter names."""
    labels = F.reverse(F.split(host, r"\."))
    hosts = F.transform(labels, lambda x, i: F.concat(F.lit("h"), i.cast("string"), F.lit(":"), x))
    segments = F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("p:"), x))
    names = F.transform(F.regexp_extract_all(url, F.lit(r"[?&]([^=&#]+)="), 1), lambda x: F.concat(F.lit("q:"), x))
    return F.array_distinct(F.filter(F.concat(hosts, segments, names), lambda x: ~x.rlike(r"^(p|h\d+):$")))


def mine(baskets: DataFrame, *, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """Rules (antecedent, verdict, confidence, support) from ``baskets`` (items, verdict), one row per labelled url.

    A rule must beat every rule with fewer of its tokens. No baskets give no rules.
    """
    spark = baskets.sparkSession
    empty = spark.createDataFrame([], "antecedent array<string>, verdict string, confidence double, support double")
    if baskets.isEmpty():
        return empty
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(
        baskets.select(F.array_append("items", F.concat(F.lit("verdict:"), "verdict")).alias("items"))
    )
    rules = stored(
        model.associationRules.filter(F.element_at("consequent", 1).startswith("verdict:"))
        .filter(~F.exists("antecedent", lambda x: x.startswith("verdict:")))
        .select(
            F.sort_array("antecedent").alias("antecedent"), F.expr("substring(consequent[0], 9)").alias("verdict"), "confidence", "support"
        ),
        "rules",
    )
    # shorter rules inside a rule are found over their rarest... first token in order, then checked
    short = rules.select(F.col("antecedent").alias("inner"), F.col("confidence").alias("c"), F.col("antecedent")[0].alias("token"))
    beaten = (
        rules.withColumn("token", F.explode("antecedent")).join(short, "token")
        .filter((F.size("inner") < F.size("antecedent")) & (F.size(F.array_except("inner", "antecedent")) == 0) & (F.col("c") >= F.col("confidence")))
        .select("antecedent", "verdict").distinct()
    )
    return rules.join(beaten, ["antecedent", "verdict"], "left_anti")


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The verdict for each distinct token set of ``urls`` (items): (items, verdict), where a rule fits.

    The most confident rule decides, then the best supported, then the longest, then ``block``. Rules are
    filed under their rarest token; token sets are looked up once each, however many urls have them.
    """
    sets = stored(urls.select("items").distinct(), "token-sets")
    filed = rules.withColumn("rule_id", F.xxhash64("antecedent", "verdict"))
    common = sets.select(F.explode("items").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    by_token = filed.select("rule_id", F.explode("antecedent").alias("token")).join(common, "token")
    rarest = by_token.groupBy("rule_id").agg(F.min(F.struct("df", "token")).alias("r")).select("rule_id", F.col("r.token").alias("token"))
    index = stored(filed.join(rarest, "rule_id").select("token", "antecedent", "verdict", "confidence", "support"), "rule-index")
    better = F.struct("confidence", "support", F.size("antecedent").alias("size"), "verdict")
    return (
        sets.select("items", F.explode("items").alias("token")).join(index, "token")
        .filter(F.size(F.array_except("antecedent", "items")) == 0)
        .groupBy("items").agg(F.max(better).alias("best")).select("items", F.col("best.verdict").alias("verdict"))
    )


def judge(pages: DataFrame, *, id: str = "page_id", url: str = "url", rules=LISTED, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """page_id, host, path, rule, verdict, mined: one row per input row.

    ``rule`` is the listed rule that decides, else null; then ``mined`` tells whether an association rule
    decided, and urls that neither decides are allowed. Null urls and urls without ``://`` have empty host
    and path. Rows that repeat an id are judged each. No rows give no rows.
    """
    host, path = host_and_path(url)
    own = pages.select(F.col(f"`{id}`").alias("page_id"), host.alias("host"), path.alias("path"), F.coalesce(F.col(f"`{url}`").cast("string"), F.lit("")).alias("u"))
    own = own.withColumn("listed", listed_rule(F.col("host"), F.col("path"), rules)).withColumn("items", tokens(F.col("host"), F.col("path"), F.col("u")))
    own = stored(own.drop("u"), "judged-urls")
    found = mine(own.filter("listed IS NOT NULL").select("items", F.col("listed.verdict").alias("verdict")), support=support, confidence=confidence)
    verdicts = stored(match(own.filter("listed IS NULL"), found), "mined-verdicts").withColumnRenamed("verdict", "by_rules")
    # only rows without a listed rule look up their token set; the others' key is null and stays in its task
    open_rows = own.filter("listed IS NULL").join(verdicts, "items", "left")
    columns = ["page_id", "host", "path"]
    return open_rows.select(
        *columns, F.lit(None).cast("string").alias("rule"), F.coalesce("by_rules", F.lit(DEFAULT)).alias("verdict"), F.col("by_rules").isNotNull().alias("mined")
    ).unionByName(
        own.filter("listed IS NOT NULL").select(*columns, F.col("listed.rule").alias("rule"), F.col("listed.verdict").alias("verdict"), F.lit(False).alias("mined"))
    )
