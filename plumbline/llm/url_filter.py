"""URL filters: rules on hosts and paths found by hashed expressions, with DataFrame operations only.

A rule fits its host and all subdomains, where the url's path starts with the rule's. Each url is expanded into the expressions that a
rule could be: suffixes of its host at dots, no longer than the longest rule's, joined with prefixes of its path, of the lengths that rules have. The
expressions meet the rules on the first bits of a digest; whole digests confirm; of what is left the longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm._common import fresh, materialize
from plumbline.operators.skew import join_one

VERDICTS = ("allow", "block")
DEFAULT = "allow"  # what no rule fits: a filter's rules name what it keeps out
SHORT = 8  # hex digits of the digest that are the join's key
BROADCAST_RULES = 100_000  # a rule's row in a broadcast has a digest, its prefix and a number: some 20 MB for so many

# fixed values: the rules (host, path, verdict) that the query applies
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def host_of(url: str | Column) -> Column:
    """What follows the first ``://`` up to a slash, question mark, hash or the end, A to Z in lower case; empty without ``://`` and for null."""
    found = F.regexp_extract(F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str | Column) -> Column:
    """What follows the host up to a question mark, hash or the end; empty without ``://`` and for null."""
    return F.regexp_extract(F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """Rules as a table (host, path, verdict)."""
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def _keyed(rules: DataFrame) -> DataFrame:
    """(short, digest, code, host, path), a row a rule. ``code`` orders rules by length, then by the host's, and ends in the verdict."""
    clean = rules.select(F.col("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").where(F.col("host").isNotNull() & F.col("verdict").isin(*VERDICTS))
    clean = clean.where("path = '' or startswith(path, '/')").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    host, whole = F.char_length("host").cast("long"), (F.char_length("host") + F.char_length("path")).cast("long")
    code = F.shiftleft(whole, 32) + host * 2 + (F.col("verdict") == VERDICTS[1]).cast("long")
    digest = F.sha2(F.concat("host", "path"), 256)
    return clean.select(F.left(digest, F.lit(SHORT)).alias("short"), digest.alias("digest"), code.alias("code"), "host", "path")


def _expressions(host: Column, path: Column, shape) -> Column:
    """The expressions of a url that a rule of this shape could be: an array of distinct strings.

    The shape has the most labels of a rule's host, and the lengths of rules' paths: of those that end in a slash, and of others.
    """
    labels = F.split(host, r"\.")
    first = F.greatest(F.size(labels) - F.lit(shape.labels) + 1, F.lit(1))
    suffixes = F.transform(F.sequence(first, F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    lengths = lambda found: F.array(*(F.lit(n) for n in sorted(found))).cast("array<int>")
    at_slash = F.filter(lengths(shape.folders), lambda n: F.substring(path, n, F.lit(1)) == "/")
    anywhere = F.filter(lengths(shape.others), lambda n: n <= F.char_length(path))
    prefixes = F.transform(F.array_union(at_slash, anywhere), lambda n: F.left(path, n))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """(id_col, host, path, rule, verdict), a row for each row of ``pages``; other columns don't come, so none can clash.

    ``rules`` has host, path and verdict (allow or block), hosts in lower case. The longest rule, host and path together, wins, of equally long ones
    that with the longer host; of equal rules with both verdicts, block. A null path of a rule is the empty one; rules without a host, with another
    verdict, or with a path that begins otherwise than with a slash, fit nothing. Where no rule fits, rule is null and the verdict ``default``.

    A null url, or one without ``://``, has an empty host and path. Null ids and repeated rows each keep their row; an empty table of pages or
    rules gives an empty result or the default. A url may be of any length: what is expanded is bounded by the rules' labels and lengths.

    Equal rows of ``pages`` are one until the end, so heaps of copies are summed up before they are shuffled. Fewer than ``BROADCAST_RULES``
    rules, which are counted, are broadcast; more are joined with the distinct expressions, which leaves no more than there are rules, and
    the expressions' rows meet those in a join that doesn't shuffle rows of hot ones.
    """
    spark = pages.sparkSession
    keyed = materialize(_keyed(rules), "url-rules")
    lengths = lambda of: F.coalesce(F.collect_set(F.when(of, F.char_length("path"))), F.array())
    slash = F.expr("endswith(path, '/')")
    # as many numbers as the longest rule's path has characters, at most
    shape = keyed.agg(F.count("*").alias("n"), F.max(F.size(F.split("host", r"\."))).alias("labels"), lengths(slash).alias("folders"), lengths(~slash).alias("others")).first()
    key = fresh("id", ("host", "path", "n"))
    urls = pages.select(F.col(id_col).alias(key), host_of(url_col).alias("host"), path_of(url_col).alias("path"))
    urls = urls.groupBy(key, "host", "path").agg(F.count("*").alias("n"))
    row = [key, "host", "path", "n"]
    if not shape.n:
        judged = urls.withColumn("code", F.lit(None).cast("long"))
    else:
        small = shape.n <= BROADCAST_RULES
        urls = urls if small else materialize(urls, "urls")
        each = urls.select(*row, F.explode_outer(_expressions(F.col("host"), F.col("path"), shape)).alias("expression")).withColumn("d", F.sha2("expression", 256))
        known = keyed.select("short", "digest", "code")
        if small:
            met = each.withColumn("short", F.left("d", F.lit(SHORT))).join(F.broadcast(known), "short", "left")
            met = met.withColumn("code", F.when(F.col("d") == F.col("digest"), F.col("code")))
        else:
            distinct = each.where("d is not null").groupBy("d").agg(F.count("*").alias("copies")).withColumn("short", F.left("d", F.lit(SHORT)))
            found = materialize(distinct.join(known, "short").where("d = digest").select("d", "code", "copies"), "url-matches")
            met = join_one(each.select(*row, F.coalesce("d", F.lit("")).alias("d")), found, "d", "copies", how="left")
        judged = met.groupBy(*row).agg(F.max("code").alias("code"))
    length, host_length = F.shiftright("code", 32), F.shiftright(F.col("code").bitwiseAND(F.lit((1 << 32) - 1)), 1)
    rule = F.concat(F.right("host", host_length.cast("int")), F.left("path", (length - host_length).cast("int")))
    verdict = F.when(F.col("code").isNull(), default).when(F.col("code") % 2 == 1, VERDICTS[1]).otherwise(VERDICTS[0])
    return judged.select(F.col(key).alias(id_col), "host", "path", rule.alias("rule"), verdict.alias("verdict"), F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int"))).alias("copy")).drop("copy")
