"""URL rules by a sort-merge range join over reversed-host keys.

A host ``www.example.net`` becomes the key ``net/example/www/``; no host holds the
separator, as a host ends before the first ``/``.  A rule's host
and all its subdomains then lie in one interval of keys: those that start with
the rule's key.  URL rows are dealt evenly into chunks by a hash of
the whole row (a hot host spreads over all of them), the rules join every chunk, each
chunk is sorted by key and swept once.  Intervals nest, so the stack of active
rules holds one slot per host depth: the last rule host seen at that depth.  A
slot whose key is no longer a prefix of the row's key has been left.

Cases: a URL that is null or has no ``://`` has empty host and path; empty
tables give empty results; repeated URLs are judged one by one; extra columns
are kept and may not be named ``host``, ``path``, ``rule`` or ``verdict``
(those are replaced); without a fitting rule the verdict is the default.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Rule = tuple[str, str, str]  # host, path prefix, "allow" or "block"

#: The rule list is copied to every chunk; longer lists are refused.
MAX_RULES = 100_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """Host of a URL, A-Z lower-cased; empty for null or no ``://``."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """Path of a URL up to ``?`` or ``#``; empty for null or no ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels in reverse order, each followed by a slash."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "/"), F.lit("/"))


def rule_frame(spark, rules: Sequence[Rule]) -> DataFrame:
    """One row per rule host: key, depth and its (path, rule, verdict) entries.
    Of rules with equal host and path, ``allow`` wins."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} are taken")
    # a rule host with a character that ends hosts fits none
    raw = spark.createDataFrame([(h, p, v) for h, p, v in rules if not set(h) & set("/?#")],
                                "r_host string, r_path string, r_verdict string")
    one = raw.groupBy("r_host", "r_path").agg(F.min("r_verdict").alias("r_verdict"))
    entry = F.struct(F.length(F.concat("r_host", "r_path")).alias("n"),
                     F.length("r_host").alias("host_n"),
                     F.concat("r_host", "r_path").alias("rule"),
                     F.col("r_path").alias("path"), F.col("r_verdict").alias("verdict"))
    return (one.groupBy("r_host").agg(F.collect_list(entry).alias("entries"))
            .select(host_key(F.col("r_host")).alias("r_key"),
                    F.size(F.split("r_host", r"\.")).alias("depth"), "entries"))


def judge(urls: DataFrame, rules: Sequence[Rule], url: str = "url", default: str = "allow",
          chunks: int | None = None) -> DataFrame:
    """Add host, path, rule and verdict to every row of ``urls``."""
    spark = urls.sparkSession
    chunks = chunks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = [c for c in urls.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    plain = [urls[c] for c, kind in urls.dtypes if "map<" not in kind and "variant" not in kind]
    rows = urls.select(F.pmod(F.xxhash64(*plain), F.lit(chunks)).alias("chunk"),
                       F.struct(*[urls[c] for c in kept]).alias("row"),
                       url_host(urls[url]).alias("host"), url_path(urls[url]).alias("path"))
    left = rows.select("chunk", host_key(F.col("host")).alias("key"), F.lit(1).alias("kind"),
                       F.struct("row", "host", "path").alias("url_row"))
    frame = rule_frame(spark, rules)
    right = frame.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("chunk"),
                         F.col("r_key").alias("key"), F.lit(0).alias("kind"),
                         F.struct("r_key", "depth", "entries").alias("rule_row"))
    events = left.unionByName(right, allowMissingColumns=True)
    sweep = (Window.partitionBy("chunk").orderBy("key", "kind")
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    depths = sorted({len(h.split(".")) for h, _, _ in rules})
    stack = F.array(*[F.last(F.when(F.col("rule_row.depth") == d, F.col("rule_row")), True).over(sweep)
                      for d in depths]) if depths else F.expr(
        "CAST(array() AS array<struct<r_key:string,depth:int,entries:array<struct<n:int,host_n:int,"
        "rule:string,path:string,verdict:string>>>>)")
    swept = events.withColumn("stack", stack).where("kind = 1")
    active = F.flatten(F.transform(
        F.filter("stack", lambda s: s.isNotNull() & F.col("key").startswith(s["r_key"])),
        lambda s: s["entries"]))
    best = F.array_max(F.filter(active, lambda e: F.col("url_row.path").startswith(e["path"])))
    return (swept.withColumn("best", best)
            .select("url_row.row.*", "url_row.host", "url_row.path",
                    F.col("best.rule").alias("rule"),
                    F.coalesce("best.verdict", F.lit(default)).alias("verdict")))
