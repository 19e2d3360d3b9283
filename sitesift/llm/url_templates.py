"""URL filters: allow and block rules, then a path-template tree learned per host.

Per host, path segments that vary become wildcards of their shape, level by level from
the root; sibling branches whose subtrees a chi-square test does not tell apart and whose
labels don't contradict each other are merged; a template is rejected if the smoothed share of bad labels below it, drawn
towards its parent's, reaches a threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitesift.llm.common import stored

MIN_VALUES = 8         # distinct values of one shape that make a wildcard
DEPTH = 12             # levels of the tree; what is deeper stays one tail segment
PULL = 4.0             # labels the parent's share is worth
Z = 1.645              # standard errors from which bad shares differ
REJECT = 0.8           # smoothed bad share from which a template is rejected
_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: (host and path, verdict); a rule fits its host and all subdomains.
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"),
         ("com/fr/", "allow"), ("com/de/", "block")]


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): host after the first ://, up to /, ?, # or the end, A-Z lower-cased;
    path from there up to ?, # or the end. Null or no ://: both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _AZ, _AZ.lower()), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls. ``rules`` is a short list
    written out by hand; it becomes one expression."""
    rule = verdict = F.lit(None).cast("string")
    for r, v in sorted(rules, key=lambda x: (len(x[0]), x[0])):      # the longest is tested first
        name, tail = r[:r.index("/")], r[r.index("/"):]
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(tail)
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def shape(value: Column) -> Column:
    """Digits, long hexadecimal runs and uuids by kind, long words and slugs beside them as
    ``w``; a segment of none of these is ``w``. Every run is looked at once."""
    s = F.regexp_replace(value, "(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "\u0001")
    s = F.regexp_replace(s, "(?i)(?<![0-9a-f])(?![0-9]++(?![0-9a-f]))(?![a-f]++(?![0-9a-f]))[0-9a-f]{16,}+", "\u0002")
    s = F.regexp_replace(s, "[0-9]++", "\u0003")
    known = F.regexp_replace(s, r"[\p{L}_-]{7,}+", "w")
    for mark, name in (("\u0001", "{uuid}"), ("\u0002", "{hex}"), ("\u0003", "{n}")):
        known = F.replace(known, F.lit(mark), F.lit(name))
    return F.when(s.rlike("[\u0001\u0002\u0003]"), known).otherwise(F.lit("w"))


def generalise(paths: DataFrame, depth: int) -> DataFrame:
    """``paths`` (host, path, segs, n, bad, good) with ``tokens``: segments or wildcards.

    A shape with MIN_VALUES or more distinct values at one node, at least a quarter of
    its rows distinct, is one variable: its values become a wildcard. Values are counted
    per value first, so a host with most of the rows is spread over tasks."""
    cur = paths.withColumn("tokens", F.array().cast("array<string>")).withColumn("node", F.lit(""))
    for d in range(depth):
        val = F.get("segs", F.lit(d))
        cur = cur.withColumn("v", val).withColumn("sh", shape(F.col("v")))
        kinds = (cur.where("v is not null").groupBy("host", "node", "sh", "v").agg(F.sum("n").alias("n"))
                 .groupBy("host", "node", "sh").agg(F.count(F.lit(1)).alias("values"), F.sum("n").alias("rows"))
                 .where(f"values >= {MIN_VALUES} and values * 4 >= rows").select("host", "node", "sh", F.lit(True).alias("var")))
        cur = cur.join(kinds, ["host", "node", "sh"], "left")
        token = F.when(F.col("var"), F.concat(F.lit("{"), F.col("sh"), F.lit("}"))).otherwise(F.col("v"))
        cur = (cur.withColumn("tokens", F.when(F.col("v").isNull(), F.col("tokens"))
                              .otherwise(F.concat("tokens", F.array(token))))
               .withColumn("node", F.when(F.col("v").isNull(), F.col("node"))
                           .otherwise(F.concat("node", F.lit("/"), token))))
        cur = stored(cur.drop("v", "sh", "var"), "url-level")
    return cur.drop("node")


def _contradict(b1, g1, b2, g2):
    """Whether two branches' labels speak against each other: all bad against all good, or
    bad shares further apart than chance explains (two proportions, Z standard errors)."""
    l1, l2 = b1 + g1, b2 + g2
    p = (b1 + b2) / (l1 + l2)
    far = F.abs(b1 / l1 - b2 / l2) > Z * F.sqrt(p * (1 - p) * (F.lit(1.0) / l1 + F.lit(1.0) / l2))
    pure = ((b1 == 0) & (g2 == 0)) | ((g1 == 0) & (b2 == 0))
    return (l1 > 0) & (l2 > 0) & (pure | far)


def merge_branches(templates: DataFrame, depth: int) -> DataFrame:
    """``templates`` (host, tokens, n, bad, good) with ``merged``: tokens of sibling
    branches that are alike replaced by the largest of them, deepest level first.

    Branches with something below them are candidates if their largest template is the
    same. Of the candidates of one template, those with mostly bad, mostly good and no
    labels each have a head, the branch with most rows; a branch is compared with the head
    of its own kind, one without labels with the labelled head if there is just one. It
    joins that head if a chi-square test does not tell their shares of templates apart, at
    least half of the rows of each lie in common templates, and their labels don't
    contradict each other. So no two branches but a head and its candidates are compared,
    and a branch without anything below it is never merged."""
    cur = templates.withColumn("merged", F.col("tokens"))
    at_branch = ["host", "up", "own"]
    for d in range(depth - 1, -1, -1):
        head = F.array_join(F.slice("merged", 1, d), "/") if d else F.lit("")
        cur = cur.withColumn("up", head).withColumn("own", F.get("merged", F.lit(d))).withColumn(
            "below", F.array_join(F.slice("merged", d + 2, DEPTH + 1), "/"))
        part = stored(cur.where("own is not null and n > 0").groupBy(*at_branch, "below").agg(F.sum("n").alias("m")), "url-parts")
        marks = cur.where("own is not null").groupBy(*at_branch).agg(F.sum("bad").alias("b"), F.sum("good").alias("g"))
        size = part.groupBy(*at_branch).agg(F.sum("m").alias("rows"), F.count(F.lit(1)).alias("k"),
                                            F.max_by("below", F.struct("m", "below")).alias("top"))
        side = F.when(F.col("b") > F.col("g"), "bad").when(F.col("g") > 0, "good").otherwise("none")
        size = stored(size.join(marks, at_branch).where("top <> ''").withColumn("side", side), "url-branches")
        # heads by kind, at most three for a template
        largest = F.min_by(F.struct("own", "rows", "k", "b", "g"), F.struct(-F.col("rows"), F.col("own")))
        heads = size.groupBy("host", "up", "top", "side").agg(largest.alias("h"))
        heads = heads.groupBy("host", "up", "top").agg(F.map_from_entries(F.collect_list(F.struct("side", "h"))).alias("by"))
        by = F.col("by")
        lead = (F.when(by["bad"].isNotNull() & by["good"].isNull(), "bad")
                .when(by["good"].isNotNull() & by["bad"].isNull(), "good").otherwise("none"))
        heads = stored(heads.withColumn("lead", lead), "url-heads")
        pairs = (size.join(heads, ["host", "up", "top"])
                 .withColumn("h", F.col("by")[F.when(F.col("side") == "none", F.col("lead")).otherwise(F.col("side"))])
                 .select(*at_branch, "rows", "k", "b", "g", "h").where("h.own <> own"))
        pairs = stored(pairs, "url-pairs")
        # terms of the statistic: templates of the branch one by one, those of the head alone in one sum
        both = (part.join(pairs.select(*at_branch, "h", "rows"), at_branch)
                .select(*at_branch, "rows", "m", F.col("h.own").alias("to"), F.col("h.rows").alias("all"), "below")
                .join(part.select("host", "up", F.col("own").alias("to"), "below", F.col("m").alias("m2")), ["host", "up", "to", "below"], "left"))
        other, ratio = F.coalesce("m2", F.lit(0)), F.sqrt(F.col("all") / F.col("rows"))
        sums = both.groupBy(*at_branch).agg(
            F.sum((ratio * F.col("m") - other / ratio) ** 2 / (F.col("m") + other)).alias("own_terms"),
            F.sum(other).alias("common_head"), F.sum(F.when(F.col("m2").isNotNull(), F.col("m")).otherwise(0)).alias("common"),
            F.count("m2").alias("shared"))
        free = F.greatest(F.col("k") + F.col("h.k") - F.col("shared") - 1, F.lit(1))
        alone = (F.col("h.rows") - F.col("common_head")) * F.col("rows") / F.col("h.rows")
        test = ((F.col("own_terms") + alone <= free + 3 * F.sqrt(2 * free))
                & (2 * F.col("common") >= F.col("rows")) & (2 * F.col("common_head") >= F.col("h.rows"))
                & ~_contradict(F.col("b"), F.col("g"), F.col("h.b"), F.col("h.g")))
        joined = pairs.join(sums, at_branch).where(test).select(*at_branch, F.col("h.own").alias("to"))
        names = joined.select("host", "up", F.col("to").alias("own"), "to").distinct()
        moves = stored(joined.unionByName(names).withColumn("to", F.concat(F.lit("~"), "to")).distinct(), "url-moves")
        cur = cur.join(moves, at_branch, "left")
        cur = cur.withColumn("merged", F.when(F.col("to").isNotNull(), F.expr(
            f"concat(slice(merged, 1, {d}), array(to), slice(merged, {d + 2}, {DEPTH + 1}))")).otherwise(F.col("merged")))
        cur = stored(cur.drop("up", "own", "below", "to"), "url-merge")
    return cur


def purity(templates: DataFrame) -> DataFrame:
    """(host, template, merged, purity): bad share smoothed from all hosts to the host and
    down its tree, each level worth PULL labels of the one above. Sums of all nodes are
    made in one grouping; each template folds those on its own path."""
    total = templates.agg(F.sum("bad"), F.sum("good")).first()
    bad, good = total[0] or 0, total[1] or 0
    root = (bad + 0.5) / (bad + good + 1.0)
    nodes = (templates.withColumn("d", F.explode(F.sequence(F.lit(0), F.size("merged"))))
             .withColumn("node", F.expr("array_join(slice(merged, 1, d), '/')")))
    sums = nodes.groupBy("host", "d", "node").agg(F.sum("bad").alias("b"), F.sum("good").alias("g"))
    chain = (nodes.select("host", "tokens", "merged", "d", "node").join(sums, ["host", "d", "node"])
             .groupBy("host", "tokens", "merged").agg(F.array_sort(F.collect_list(F.struct("d", "b", "g"))).alias("c")))
    fold = F.aggregate("c", F.lit(root), lambda up, x: (x["b"] + PULL * up) / (x["b"] + x["g"] + PULL))
    return chain.select("host", F.array_join("tokens", "/").alias("template"),
                        F.concat(F.lit("/"), F.array_join("merged", "/")).alias("merged"), fold.alias("purity"))


def judge(pages: DataFrame, labelled: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url",
          rules=RULES, reject: float = REJECT) -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule, verdict, template, purity.

    The verdict is the rule's if one fits, else the template's. Labels of the tree are
    the rules' own verdicts and, if given, ``labelled`` (url, bad 0/1). Urls that are
    null or have no :// have empty host and path and are a template of their own; equal
    rows get equal verdicts; an empty table gives no rows; other columns are ignored.
    """
    host, path = url_parts(F.col("url"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url")).select(
        "id", "url", host.alias("host"), path.alias("path"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    rows = stored(rows.withColumn("rule", rule).withColumn("said", said), "url-rows")
    votes = rows.select("host", "path", F.lit(1).alias("n"), (F.col("said") == "block").alias("b"),
                        (F.col("said") == "allow").alias("g"))
    if labelled is not None:
        marks = labelled.select(F.col("url").cast("string").alias("url"), F.col("bad").cast("int").alias("bad"))
        votes = votes.union(marks.where("bad is not null").select("url", "bad").select(
            *[c.alias(a) for c, a in zip(url_parts(F.col("url")), ("host", "path"))], F.lit(0).alias("n"),
            (F.col("bad") == 1).alias("b"), (F.col("bad") == 0).alias("g")))
    segs = F.expr("filter(split(path, '/'), x -> x <> '')")
    folded = F.when(F.size("segs") > DEPTH, F.concat(F.slice("segs", 1, DEPTH - 1), F.array(F.array_join(
        F.expr(f"slice(segs, {DEPTH}, greatest(1, size(segs)))"), "/")))).otherwise(F.col("segs"))
    paths = (votes.groupBy("host", "path").agg(F.sum("n").alias("n"), F.count_if("b").alias("bad"),
                                               F.count_if("g").alias("good"))
             .withColumn("segs", segs).withColumn("segs", folded))
    paths = stored(paths, "url-paths")
    depth = paths.agg(F.max(F.size("segs"))).first()[0] or 0
    named = generalise(paths, depth)
    templates = stored(named.groupBy("host", "tokens").agg(*[F.sum(c).alias(c) for c in ("n", "bad", "good")]),
                       "url-templates")
    pure = stored(purity(merge_branches(templates, depth)), "url-purity")
    of_path = (named.select("host", "path", F.array_join("tokens", "/").alias("template"))
               .join(pure, ["host", "template"]).select("host", "path", F.col("merged").alias("template"), "purity"))
    return (rows.join(of_path, ["host", "path"], "left")
            .select("id", "host", "path", "rule",
                    F.coalesce("said", F.when(F.col("purity") >= reject, "block").otherwise("allow")).alias("verdict"),
                    "template", "purity"))
