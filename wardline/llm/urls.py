"""URL verdicts: listed rules first, then rules mined from labelled pages. DataFrame functions and Spark ML only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: verdict, rule; a rule is a host, and from its first slash on the start of a path
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
SUPPORT, CONFIDENCE = 0.001, 0.6  # of the labelled pages; of the pages that hold a rule's tokens
LEAST = 5  # labelled pages that a mined rule needs at least
SURE, Z = 0.5, 2.58  # the confidence is above SURE even at the lower end of its 99 % Wilson interval
_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BAD = "label=block"


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in small letters; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _SMALL), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def listed_rule(host_: Column, path_: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits; of equally long ones the one that sorts first."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1]), reverse=True):
        name, slash, rest = rule.partition("/")
        fits = ((host_ == name) | F.endswith(host_, F.lit("." + name))) & F.startswith(path_, F.lit(slash + rest))
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def tokens(url: Column) -> Column:
    """Distinct tokens of a URL: scheme, the host and its last two labels, first path part, digits and ending
    of the last part, and the names of query parameters.
    """
    host_, path_ = host(url), path(url)
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    names = F.transform(F.split(query, "&"), lambda x: F.concat(F.lit("query="), F.substring_index(x, "=", 1)))
    made = F.concat(
        F.array(
            F.concat(F.lit("scheme="), F.lower(F.substring_index(url, "://", 1))),
            F.concat(F.lit("host="), host_), F.concat(F.lit("site="), F.substring_index(host_, ".", -2)),
            F.concat(F.lit("part="), F.regexp_extract(path_, r"^/([^/]*[^/0-9][^/]*)(/|$)", 1)),
            F.when(path_.rlike("[0-9]"), F.lit("digits=yes")).otherwise(F.lit("digits=no")),
            F.concat(F.lit("ending="), F.regexp_extract(path_, r"\.([A-Za-z0-9]{1,5})$", 1)),
            F.when(F.contains(url, F.lit("#")), F.lit("fragment=yes")),
        ),
        names,
    )
    return F.array_distinct(F.filter(made, lambda t: t.isNotNull() & ~t.rlike("^(host|site|part|ending|query)=$")))


def mine(pages: DataFrame, bad: Column, support: float = SUPPORT, confidence: float = CONFIDENCE, least: int = LEAST) -> DataFrame:
    """Token combinations of bad pages, as rows (tokens, index_token, confidence, n).

    ``pages`` has ``url`` and whatever ``bad`` reads; rows where either is null teach nothing. Rules under the
    support, the confidence, ``least`` bad pages or a confidence that is sure are pruned, and so is a rule when the pages of a part of its
    tokens are bad with at least the same confidence. ``index_token`` is the token of a rule that fewest
    labelled pages hold. There are at most 1 / support frequent tokens to a place in a URL, so the rules are
    few whatever the input; they still stay a distributed table.
    """
    taught = pages.select(tokens(F.col("url")).alias("t"), bad.alias("bad")).filter(
        F.col("bad").isNotNull() & F.col("t").isNotNull()
    )
    schema = "tokens array<string>, index_token string, confidence double, n long"
    if taught.isEmpty():
        return pages.sparkSession.createDataFrame([], schema)
    items = taught.select(F.when(F.col("bad"), F.concat("t", F.array(F.lit(BAD)))).otherwise(F.col("t")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(items)
    sets = model.freqItemsets.select("items", F.col("freq").alias("n")).filter(F.col("n") >= least)
    rules = model.associationRules.filter(F.col("consequent")[0] == BAD).select(
        F.array_sort("antecedent").alias("tokens"), "confidence", F.round(F.col("support") * taught.count()).cast("long").alias("n")
    ).filter(F.col("n") >= least)
    n, c = F.col("n") / F.col("confidence"), F.col("confidence")  # n of a rule are its bad pages
    low = (c + Z * Z / (2 * n) - Z * F.sqrt(c * (1 - c) / n + Z * Z / (4 * n * n))) / (1 + Z * Z / n)
    rules = rules.filter(low >= SURE)
    parts = rules.select("tokens", "confidence", F.explode("tokens").alias("left_out"))
    parts = parts.withColumn("part", F.array_remove("tokens", F.col("left_out")))
    general = rules.select(F.col("tokens").alias("part"), F.col("confidence").alias("general"))
    beaten = parts.join(general, "part").filter("general >= confidence").select("tokens").distinct()
    single = sets.filter(F.size("items") == 1).select(F.col("items")[0].alias("token"), F.col("n").alias("held"))
    kept = rules.join(beaten, "tokens", "left_anti").select("*", F.explode("tokens").alias("token")).join(single, "token")
    return kept.groupBy("tokens", "confidence", "n").agg(
        F.min(F.struct("held", "token"))["token"].alias("index_token")
    ).select("tokens", "index_token", "confidence", "n")


def judge(pages: DataFrame, mined: DataFrame, rules: Sequence[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: host, path, the longest listed rule that fits, verdict, best mined rule.

    Without a listed rule a page is blocked when a mined rule fits, else allowed. Of several mined rules the
    one of highest confidence, then most pages, then first tokens is named. A URL that is null or has no ``://``
    has empty host and path and is judged by its tokens, if any. Null and repeated ids keep their rows.

    Mined rules are found by an inverted index: a page meets a rule only through the rule's rarest token. Pages
    with equal tokens are matched once.
    """
    url = F.col(f"`{url_col}`")
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), host(url).alias("host"), path(url).alias("path"), F.coalesce(tokens(url), F.array().cast("array<string>")).alias("t"))
    kinds = rows.select("t").distinct()
    met = kinds.select("t", F.explode("t").alias("index_token")).join(mined, "index_token")
    met = met.filter(F.size(F.array_except("tokens", "t")) == 0)
    best = met.groupBy("t").agg(F.min(F.struct(-F.col("confidence"), -F.col("n"), F.array_join("tokens", " ").alias("rule"))).alias("b"))
    found = rows.join(best.select("t", F.col("b.rule").alias("mined_rule")), "t", "left")
    rule = listed_rule(F.col("host"), F.col("path"), rules)
    found = found.withColumn("rule", rule)
    listed = F.lit(None).cast("string")
    for verdict, name in rules:
        listed = F.when(F.col("rule") == name, F.lit(verdict)).otherwise(listed)
    own = F.when(F.col("mined_rule").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return found.select(
        F.col("id").alias(id_col), "host", "path", "rule", F.coalesce(listed, own).alias("verdict"), "mined_rule"
    )
