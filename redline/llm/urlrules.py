"""URL rules by a sort-merge range join, in DataFrame operations alone.

A host's labels reversed, each with a dot behind it, make a key whose prefixes
are the host's parents; a rule's host and path prefix then is an interval of
keys. Sorted interval ends are swept with a stack of the active nested rules:
the level of the stack is a running sum of starts and ends, and what an end
uncovers is the last start of the level below. The sweep leaves sorted points
that each name the innermost rule from there on; urls are merged into them in
key order, in groups that hold a share of the urls and all points.

Rules are the small side: LIMIT holds them, and it is checked. A url host is
swept first (innermost host that has rules), then its path among that host's
own rules, then among those of each parent of that host that has rules: as many
sweeps as such hosts are nested, and no rule is copied to another host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Most rules; urls have no bound.
LIMIT = 100_000
#: Urls swept in one sorted group, at least.
GROUP = 8_000


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or url."""
    return F.coalesce(_lowered(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def _lowered(host: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower())


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty without ``://`` or url."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(host: Column) -> Column:
    """``www.example.org`` as ``org.example.www.``; the dot at the end keeps ``org`` from being a prefix of ``orgs``."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def start_of(prefix: Column) -> Column:
    return prefix.cast("binary")


def end_of(prefix: Column) -> Column:
    """Above each string with the prefix and below every other greater one: no UTF-8 byte is 0xFF."""
    return F.concat(prefix.cast("binary"), F.unhex(F.lit("FF")))


def points(rules: DataFrame, prefix: str) -> DataFrame:
    """The sweep over nested intervals: columns key and node, the innermost prefix from that key on (null: none).

    ``rules`` has one row for each distinct prefix. The running sums need the
    ends in one order, so one task sweeps them: 2 * LIMIT short rows at most.
    """
    ends = rules.select(
        F.col(prefix).alias("p"),
        F.explode(F.array(
            F.struct(start_of(F.col(prefix)).alias("key"), F.lit(1).alias("way")),
            F.struct(end_of(F.col(prefix)).alias("key"), F.lit(-1).alias("way")),
        )).alias("e"),
    ).select("p", "e.key", "e.way")
    # no two keys are equal: prefixes are distinct, and only ends hold the byte 0xFF
    running = Window.orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    level = ends.withColumn("level", F.sum("way").over(running))
    by_level = Window.partitionBy("level").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    top = F.last(F.when(F.col("way") == 1, F.col("p")), ignorenulls=True).over(by_level)
    return level.select("key", F.when(F.col("level") > 0, top).alias("node"))


def merge(urls: DataFrame, key: str, at: DataFrame, out: str, groups: int) -> DataFrame:
    """``urls`` with ``out``: the node of the last point at or before the key.

    Urls are salted over ``groups`` sorted groups by their values, so one hot
    host spreads; every group gets all points.
    """
    columns = urls.columns
    dealt = urls.withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(groups)).cast("int")).withColumn("kind", F.lit(1))
    marks = at.select(F.col("key").alias(key), F.col("node"), F.lit(0).alias("kind"),
                      F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("salt"))
    both = dealt.unionByName(marks, allowMissingColumns=True)
    # a point without a rule must hide earlier ones, so the whole struct is carried
    sweep = Window.partitionBy("salt").orderBy(key, "kind").rowsBetween(Window.unboundedPreceding, 0)
    carried = F.last(F.when(F.col("kind") == 0, F.struct("node")), ignorenulls=True).over(sweep)
    return both.withColumn("carried", carried).where("kind = 1").select(*columns, F.col("carried.node").alias(out))


def own_rules(rules: DataFrame) -> DataFrame:
    """Each rule once, as a prefix of (reversed host, path): columns rev, prefix and won (a struct whose order is which rule wins).

    A longer rule wins (host and path together), of equals that of the longer
    host; of doubled rules allow stays. Rules without a host, or with a path
    that no url's path starts with, are left out.
    """
    rs = rules.select(
        F.lower("verdict").alias("verdict"), _lowered(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path")
    ).where("host is not null and (path = '' or startswith(path, '/'))")  # no url's path starts otherwise
    rule = F.concat("host", "path")
    won = F.struct(F.length(rule).alias("length"), F.length("host").alias("of_host"), (F.col("verdict") == "allow").alias("allows"), rule.alias("rule"), "verdict")
    rs = rs.select(reversed_host(F.col("host")).alias("rev"), "path", won.alias("won"))
    return rs.groupBy("rev", F.concat("rev", "path").alias("prefix")).agg(F.max("won").alias("won"))


def chains(own: DataFrame) -> DataFrame:
    """For each host that has rules (rev): itself and its parents that have rules, innermost first."""
    hosts = own.select("rev").distinct()
    labels = F.split("rev", r"\.")
    up = F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda i: F.concat(F.array_join(F.slice(labels, 1, i), "."), F.lit(".")))
    parents = hosts.select(F.col("rev").alias("at"), F.explode(up).alias("rev")).join(hosts, "rev")
    longest = F.sort_array(F.collect_list(F.struct(F.length("rev").alias("n"), "rev")), asc=False)
    return parents.groupBy("at").agg(F.transform(longest, lambda x: x["rev"]).alias("chain"))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", otherwise: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict of each url; columns of these names are replaced.

    ``rules`` has columns verdict (allow or block), host and path prefix. A rule
    fits its host and all subdomains if the path starts with the rule's; the
    longest rule (host and path together) wins, of equals that of the longer
    host, then allow. Without a fitting rule the verdict is ``otherwise`` and
    rule is null. A null url, or one without ``://``, has an empty host and path.
    """
    if (n_rules := rules.count()) > LIMIT:
        raise ValueError(f"{n_rules} rules; at most {LIMIT} are replicated to the groups")
    rest = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    groups = max(1, -(-pages.count() // max(GROUP, 16 * n_rules)))
    own = own_rules(rules)
    nested = chains(own)
    depth = nested.agg(F.max(F.size("chain"))).first()[0] or 0
    row = F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row")
    urls = pages.select(row, host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"))
    plain = [f"row.`{c}`" for c, kind in pages.dtypes if c in rest and "map<" not in kind and "variant" not in kind]
    urls = urls.withColumn("uid", F.xxhash64(*plain)).withColumn("key", start_of(reversed_host(F.col("host"))))
    found = merge(urls, "key", points(own.select("rev").distinct(), "rev"), "at", groups)
    found = found.join(F.broadcast(nested), "at", "left")  # a row for each host that has rules: LIMIT at most, checked above
    names, paths, won = own.select("prefix", "won"), points(own.select("prefix"), "prefix"), F.lit(None)
    for d in range(depth):
        swept = merge(found.withColumn("key", start_of(F.concat(F.get("chain", F.lit(d)), "path"))), "key", paths, "prefix", groups)
        found = swept.join(F.broadcast(names.withColumnRenamed("won", f"won{d}")), "prefix", "left").drop("prefix")  # LIMIT rules at most
        won = F.col(f"won{d}") if d == 0 else F.greatest(won, f"won{d}")
    found = found.withColumn("won", won if depth else F.lit(None).cast("struct<rule: string, verdict: string>"))
    return found.select("row.*", "host", "path", F.col("won.rule").alias("rule"), F.coalesce("won.verdict", F.lit(otherwise)).alias("verdict"))
