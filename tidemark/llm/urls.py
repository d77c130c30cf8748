"""URL verdicts by rules and by a tree of path templates, in DataFrame functions only (operator 8).

Rules first: a rule (host, path) fits its host and all subdomains if the path starts with the rule's; the longest wins.
URLs without a rule are judged by their host's template tree. Runs of digits in path segments become `{n}`; level by level,
a segment with less than `SHARE` of the pages below its parent becomes `*`, so a parent keeps at most 1 / SHARE literal
branches; segments below `DEPTH` become `**`. Labelled branches of a parent are merged in the order of their purity, each with
the group before it if a two-sample test on the pooled counts can't tell them apart at five in a hundred; a branch without
labels takes no part and is judged by its parent's labels. Labels are the rules' verdicts. A template is rejected if its share of blocked pages,
smoothed towards its host's share and that towards the share of all, exceeds one half.

A null url or one without `://` has empty host and path and is judged by the template of the empty host. Repeated rows give
repeated results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import lower_ascii
from tidemark.llm.storage import checkpointed

#: The rules of the query, (verdict, rule).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
DEPTH, SHARE, STRENGTH, LIMIT, Z = 4, 0.05, 2.0, 0.5, 1.96
GROUPS = "array<struct<l:bigint,b:bigint,templates:array<string>>>"


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null if none does. The list of rules is a part of the plan."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])):
        h, _, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def split_pages(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, ruled, g: the path's generalised segments down to DEPTH."""
    p = pages.select("page_id", "url")
    host, path = parts(F.col("url"))
    p = p.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    g = F.transform(F.slice(segments, 1, DEPTH), lambda s: F.regexp_replace(s, "[0-9]+", "{n}"))
    return p.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), F.concat(g, F.when(F.size(segments) > DEPTH, F.array(F.lit("**"))).otherwise(F.array().cast("array<string>"))).alias("g"))


def pooled(groups: Column, leaf: Column) -> Column:
    """`groups` with a leaf put into the last group if their purities pass as one, else as a group of its own. The two-sample
    test compares the leaf with all that the group has pooled, with half a page added to each side's counts."""
    last = F.element_at(groups, -1)
    n1, n2 = last["l"] + 1.0, leaf["labelled"] + 1.0
    b1, b2 = last["b"] + 0.5, leaf["blocked"] + 0.5
    p = (b1 + b2) / (n1 + n2)
    same = F.abs(b1 / n1 - b2 / n2) <= Z * F.sqrt(p * (1.0 - p) * (1.0 / n1 + 1.0 / n2))
    own = F.struct(leaf["labelled"].alias("l"), leaf["blocked"].alias("b"), F.array(leaf["template"]).alias("templates"))
    joined = F.struct((last["l"] + leaf["labelled"]).alias("l"), (last["b"] + leaf["blocked"]).alias("b"), F.array_append(last["templates"], leaf["template"]).alias("templates"))
    start = F.array(own).cast(GROUPS)
    return F.when(F.size(groups) == 0, start).when(same, F.concat(F.slice(groups, F.lit(1), F.size(groups) - 1), F.array(joined).cast(GROUPS))).otherwise(F.concat(groups, start))


def templates(split: DataFrame) -> DataFrame:
    """host, g, template, rejected: each generalised path with its place in the host's tree."""
    t = split.groupBy("host", "g").agg(F.count(F.lit(1)).alias("n"), F.count("ruled").alias("labelled"), F.count_if(F.col("ruled") == "block").alias("blocked"))
    t = t.withColumn("parent", F.lit("")).withColumn("template", F.lit(""))
    t = checkpointed(t)  # one row per generalised path; a level is read several times by the next
    for k in range(DEPTH + 1):
        seg = F.get("g", F.lit(k))
        t = t.withColumn("seg", seg)
        sizes = t.where("seg is not null").groupBy("host", "template", "seg").agg(F.sum("n").alias("size"))
        total = sizes.groupBy("host", "template").agg(F.sum("size").alias("total"))
        rare = sizes.join(total, ["host", "template"]).where(F.col("size") < SHARE * F.col("total")).select("host", "template", "seg", F.lit(True).alias("rare"))
        step = F.when(F.col("seg") == "**", "**").when(F.col("rare"), "*").otherwise(F.col("seg"))
        t = (t.join(rare, ["host", "template", "seg"], "left")
             .withColumn("parent", F.when(F.col("seg").isNull(), F.col("parent")).otherwise(F.col("template")))
             .withColumn("template", F.when(F.col("seg").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), step))).drop("seg", "rare"))
        t = checkpointed(t)
    leaves = t.groupBy("host", "parent", "template").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    # branches with labels in the order of their purity; at most 1 / SHARE + 2 stand below a parent
    seen = leaves.where("labelled > 0").withColumn("leaf", F.struct(((F.col("blocked") + 0.5) / (F.col("labelled") + 1.0)).alias("purity"), "template", "labelled", "blocked"))
    chain = seen.groupBy("host", "parent").agg(F.sort_array(F.collect_list("leaf")).alias("leaves"), F.sum("labelled").alias("pl"), F.sum("blocked").alias("pb"))
    groups = F.aggregate("leaves", F.array().cast(GROUPS), lambda acc, x: pooled(acc, x))
    told = chain.select("host", "parent", F.explode(groups).alias("g")).select("host", "parent", F.explode("g.templates").alias("template"), F.col("g.l").alias("bl"), F.col("g.b").alias("bb"))
    host = leaves.groupBy("host").agg(F.sum("labelled").alias("hl"), F.sum("blocked").alias("hb"))
    whole = host.agg(F.sum("hl").alias("al"), F.sum("hb").alias("ab")).select(((F.col("ab") + 0.5) / (F.col("al") + 1.0)).alias("prior"))
    host = host.select("host", "hl", "hb", whole.scalar().alias("prior"))
    host_share = (F.col("hb") + STRENGTH * F.col("prior")) / (F.col("hl") + STRENGTH)
    # a branch without labels says nothing about others and is judged by what its parent's branches say together
    counts = (leaves.select("host", "parent", "template").join(told, ["host", "parent", "template"], "left").join(chain.select("host", "parent", "pl", "pb"), ["host", "parent"], "left")
              .select("host", "parent", "template", F.coalesce("bl", "pl", F.lit(0)).alias("bl"), F.coalesce("bb", "pb", F.lit(0)).alias("bb")))
    judged = (counts.join(host.select("host", host_share.alias("share")), "host")
              .select("host", "parent", "template", (((F.col("bb") + STRENGTH * F.col("share")) / (F.col("bl") + STRENGTH)) > LIMIT).alias("rejected")))
    return t.select("host", "g", "parent", "template").join(judged, ["host", "parent", "template"]).select("host", "g", "template", "rejected")


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template of every row."""
    split = split_pages(pages, rules)
    tree = templates(split)
    verdict = F.coalesce("ruled", F.when(F.col("rejected"), "block").otherwise("allow"))
    return split.join(tree, ["host", "g"], "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template")
