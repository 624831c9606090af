"""URL verdicts by rules and, where no rule fits, by a tree of path templates.

Pages that a rule judges are the labelled ones. Paths are first generalised by
their letters: digits become ``#``, long or much mixed segments ``*``. What is
left of a host's pages, a row a generalised path with counts, goes down a tree
of segments, all hosts and nodes of a level at once:

  generalise  in a node with more than VARIANTS different segments, those with
              less than a share of 1 / VARIANTS of its pages become ``*``; so a
              node has VARIANTS + 1 branches at most
  merge       a branch whose blocked share does not differ from that of its
              siblings (two-proportion test) is merged with the others alike
              into one branch ``=``; those that differ are merged into ``+``
              (more blocked) and ``-`` (less)
  purity      (blocked + SMOOTH * the parent's purity) / (labelled + SMOOTH), from
              the share of all labelled pages down to the host and every branch

A page without a rule is blocked if the purity at the end of its path reaches
REJECT. What is learnt of a node is one bounded row; rows of a node's paths meet
it by (host, node, salt), so a node with very many paths is spread over SALTS
tasks. Verdicts go back to pages by their generalised path: those of paths with a
thousandth of all pages, a thousand at most, are broadcast, the others joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, table

#: The levels of the tree; what lies deeper is one segment ``**``.
DEPTH = 3
VARIANTS, SMOOTH, REJECT = 10, 4.0, 0.75
#: Square of the normal quantile of the test, at 5 %.
SQUARED_Z = 3.8414588
LONGEST, MOST_RUNS = 40, 3
SALTS = 32
#: Paths with this share of all pages are joined by broadcast.
HEAVY = 1000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_parts(pages: DataFrame) -> DataFrame:
    """(page_id, host, path) of every row."""
    at = F.expr("instr(url, '://')")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    d = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).withColumn("rest", rest)
    host = F.translate(F.regexp_extract("rest", r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return d.select("page_id", host.alias("host"), F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1).alias("path"))


def rule_column(rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits host and path, and its verdict; null where none
    does. A rule is (verdict, host and path); of equally long ones the first in
    the list wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules[::-1], key=lambda r: len(r[1])):
        host, slash, path = text.partition("/")
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(slash + path))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def generalised(path: Column, depth: int) -> Column:
    """The segments of a path with digits as ``#``, long and much mixed ones as ``*``."""

    def one(s: Column) -> Column:
        g = F.regexp_replace(s, "[0-9]+", "#")
        return F.when((F.length(s) > LONGEST) | (F.length(g) - F.length(F.replace(g, F.lit("#"), F.lit(""))) > MOST_RUNS), F.lit("*")).otherwise(g)

    whole = F.split(path, "/")
    cut = F.transform(F.slice(whole, 2, depth), one)
    return F.when(F.size(whole) > depth + 1, F.concat(cut, F.array(F.lit("**")))).otherwise(cut)


def _salted(rows: DataFrame) -> DataFrame:
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _salt(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int")


def _nodes(shapes: DataFrame, level: int) -> DataFrame:
    """A row a node of this level that has branches: a map from segment to the
    merged branch and its purity."""
    kids = table(shapes.withColumn("seg", F.get("segs", F.lit(level))).where("seg IS NOT NULL").groupBy("host", "node", "seg").agg(
        F.sum("n").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"), F.max("purity").alias("purity")
    ), "kids")
    whole = kids.groupBy("host", "node").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("of_n"), F.sum("a").alias("of_a"), F.sum("b").alias("of_b"))
    own = kids.withColumn("salt", _salt("seg")).join(_salted(whole), ["host", "node", "salt"])
    rare = (F.col("k") > VARIANTS) & (F.col("n") * VARIANTS < F.col("of_n"))
    own = own.withColumn("seg", F.when(rare, F.lit("*")).otherwise(F.col("seg")))
    own = own.groupBy("host", "node", "seg").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), *[F.max(c).alias(c) for c in ("of_a", "of_b", "purity")])
    double = lambda c: F.col(c).cast("double")
    own = own.withColumns({c: double(c) for c in ("a", "b", "of_a", "of_b")})
    own = own.withColumn("m", F.col("a") + F.col("b")).withColumn("rest", F.col("of_a") + F.col("of_b") - F.col("m")).withColumn("gap", F.expr("b * rest - (of_b - b) * m"))
    # gap / (m * rest) is the difference of the shares; the test without divisions
    tested = F.expr("gap * gap * (of_a + of_b)") >= F.lit(SQUARED_Z) * F.expr("of_b * of_a * m * rest")
    differs = F.expr("m > 0 AND rest > 0 AND of_a > 0 AND of_b > 0") & tested
    own = own.withColumn("branch", F.when(~differs, F.lit("=")).when(F.col("gap") > 0, F.lit("+")).otherwise(F.lit("-")))
    merged = own.groupBy("host", "node", "branch").agg(
        F.collect_list("seg").alias("segs"), ((F.sum("b") + F.lit(SMOOTH) * F.max("purity")) / (F.sum("m") + SMOOTH)).alias("purity")
    )  # of VARIANTS + 1 rows a node at most
    entries = F.transform("segs", lambda s: F.struct(s.alias("key"), F.struct(F.col("branch"), F.col("purity")).alias("value")))
    out = merged.select("host", "node", entries.alias("e")).groupBy("host", "node").agg(F.map_from_entries(F.flatten(F.collect_list("e"))).alias("branches"))
    out = table(out, "nodes")
    drop(kids)
    return out


def template_purities(pages: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(host, shape, n, branch, purity) for every generalised path of every host
    of ``pages`` (host, path, blocked: 1, 0 or null where nothing is known). The
    result is a written table."""
    d = pages.select("host", generalised(F.col("path"), depth).alias("segs"), "blocked")
    d = d.groupBy("host", "segs").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("blocked") == 0).alias("a"), F.count_if(F.col("blocked") == 1).alias("b"))
    shapes = table(d, "shapes")
    known = shapes.agg(F.sum("a"), F.sum("b")).first()
    a, b = known[0] or 0, known[1] or 0
    prior = b / (a + b) if a + b else 0.0
    hosts = shapes.groupBy("host").agg(F.sum("a").alias("of_a"), F.sum("b").alias("of_b"))
    host = hosts.select("host", ((F.col("of_b").cast("double") + F.lit(SMOOTH * prior)) / (F.col("of_a").cast("double") + F.col("of_b").cast("double") + SMOOTH)).alias("purity"))
    now = table(shapes.withColumn("salt", _salt("segs")).join(_salted(host), ["host", "salt"]).drop("salt").withColumn("node", F.lit("")), "shapes")
    drop(shapes)
    for level in range(depth + 1):
        nodes = _nodes(now, level)
        joined = now.alias("s").withColumn("salt", _salt("segs")).join(_salted(nodes), ["host", "node", "salt"], "left")
        seg = F.get("segs", F.lit(level))
        to = F.coalesce(F.try_element_at("branches", F.coalesce(seg, F.lit("/"))), F.when(seg.isNotNull(), F.try_element_at("branches", F.lit("*"))))
        after = joined.withColumn("to", to).select("host", "segs", "n", "a", "b", F.concat("node", F.coalesce(F.concat(F.lit("/"), "to.branch"), F.lit(""))).alias("node"), F.coalesce("to.purity", "purity").alias("purity"))
        after = table(after, "shapes")
        drop(now, nodes)
        now = after
    return now.select("host", shape_of(F.col("segs")).alias("shape"), "n", F.col("node").alias("branch"), "purity")


def shape_of(segs: Column) -> Column:
    return F.concat_ws("", F.transform(segs, lambda s: F.concat(F.lit("/"), s)))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], depth: int = DEPTH, reject: float = REJECT) -> DataFrame:
    """(page_id, host, path, rule, verdict, purity) for every row of ``pages``.

    rule is the longest rule that fits, null where none does; the verdict
    (allow or block) is the rule's or, without one, that of the page's template;
    purity is the template's smoothed blocked share.

    Defined cases: a null url and one without :// have an empty host and path,
    which form a host of their own; a host keeps its port and user name, so rules
    fit it only as it stands; an empty path starts with no rule's path; rows that
    repeat are judged alike and count each; with no page that a rule fits nothing
    is blocked; other columns are ignored; an empty table gives an empty result.
    """
    rule, verdict = rule_column(rules)
    d = with_parts(pages).select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"))
    purities = template_purities(d.select("host", "path", F.when(F.col("ruled") == "block", 1).when(F.col("ruled") == "allow", 0).alias("blocked")), depth)
    key = F.md5(F.concat("host", F.col("shape")))
    known = purities.select(key.alias("known"), "purity", "n")
    total = purities.agg(F.sum("n")).first()[0] or 0
    heavy = known.where(F.col("n") * HEAVY >= total).select("known", "purity")  # HEAVY rows at most
    light = known.where(F.col("n") * HEAVY < total).select(F.col("known").alias("light"), F.col("purity").alias("light_purity"))
    d = d.withColumn("shape", shape_of(generalised(F.col("path"), depth))).withColumn("key", key)
    first = d.join(F.broadcast(heavy), F.col("key") == F.col("known"), "left")
    second = first.where("known IS NULL").join(light.hint("merge"), F.col("key") == F.col("light"), "left").withColumn("purity", F.col("light_purity"))
    columns = ["page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("purity") >= reject, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "purity"]
    return first.where("known IS NOT NULL").select(*columns).unionByName(second.select(*columns))
