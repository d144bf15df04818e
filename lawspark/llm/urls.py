"""URL filter: fixed rules first, then a path-template tree learnt per host from labelled pages.

Each URL's path becomes its segments. Segments that vary by their form (digits, hexadecimal ids, long tokens) are
wildcards from the start. The tree is then walked from the root: a node that fans out has its rare children replaced by one
wildcard, and other children whose share of bad pages doesn't differ from their siblings' by more than chance are
merged into the wildcard as well. A template whose smoothed share of bad labelled pages is too high is rejected. The tree is as
deep as the paths.

Scale: pages are first counted by (host, path shape), combined before the shuffle, so that a hot host costs one row for each
shape and task. The tree works on these counts only: grouped sums, and equi-joins back, which adaptive execution splits at a
hot node; a level reads the shapes that go on. Pages then fetch their verdict by an equi-join on (host, shape), salted so that the
pages of one hot shape are dealt over many tasks. Counts are whole numbers; the test of likeness multiplies them as doubles in a
fixed order, so that nothing overflows, and reruns and other engines agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Of a node with at least this many children, those with fewer than this many pages become one wildcard.
FAN_OUT, RARE = 20, 3
#: Children differ from their siblings when |difference of bad shares| is over Z standard errors, squared here.
Z2 = 9
#: Smoothing: so many pages with the prior's share of bad ones (in percent) are added to each template.
PRIOR_PAGES, PRIOR_PERCENT = 4, 20
#: Templates are rejected when their smoothed share of bad pages is over this percentage.
MAX_BAD_PERCENT = 50
SALTS = 32

# The rules (host, path, verdict) and the forms of segments that vary.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
VARIABLE = "^([0-9]+|[0-9a-f]{8,}(-[0-9a-f]+)*|[^/]*[0-9]{3,}[^/]*|[^/]{33,})$"
# End of fixed values.


def host_of(url: Column) -> Column:
    return common.ascii_lower(F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits, as text (null if none), and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(RULES, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def shape_of(path: Column) -> Column:
    """The path's segments, those of a varying form as *."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(parts, lambda s: F.when(s.rlike(VARIABLE), F.lit("*")).otherwise(s))


def alike(g: Column, b: Column, ng: Column, nb: Column) -> Column:
    """Whether a child's share of bad pages (g good, b bad) differs from its siblings' (with it ng, nb) by chance alone:
    (b/n - o/m)^2 <= Z2 * q(1-q)(1/n + 1/m), q being the share of all. Times n^2 m^2 (n + m), so nothing is divided."""
    n, m = (g + b).cast("double"), (ng + nb - g - b).cast("double")
    gap = b * m - (nb - b) * n
    return (n == 0) | (m == 0) | (gap * gap * (n + m) <= Z2 * nb.cast("double") * ng.cast("double") * n * m)


def template_tree(counts: DataFrame) -> DataFrame:
    """counts: host, shape (array of segments), pages, good, bad. Returns host, shape, template, t_good, t_bad: the template that
    each shape ends in, with the template's labelled pages."""
    names = ["host", "shape", "template", "good", "bad"]
    with common.temporary():
        tree = common.saved(counts.withColumn("template", F.lit("")), "level")
        done, d = [tree.where(F.size("shape") == 0).select(*names)], 0
        while not (tree := tree.where(F.size("shape") > d)).isEmpty():
            tree = tree.withColumn("seg", F.get("shape", F.lit(d)))
            child = tree.groupBy("host", "template", "seg").agg(F.sum("pages").alias("p"), F.sum("good").alias("g"), F.sum("bad").alias("b"))
            child = common.saved(child, "children")
            node = child.groupBy("host", "template").agg(F.count(F.lit(1)).alias("kids"), F.sum("g").alias("ng"), F.sum("b").alias("nb"))
            rare = (F.col("kids") >= FAN_OUT) & (F.col("p") < RARE)
            merged = (F.col("seg") == "*") | rare | (F.col("kids") > 1) & alike(*map(F.col, ("g", "b", "ng", "nb")))
            step = child.join(node, ["host", "template"]).select("host", "template", "seg", F.when(merged, "*").otherwise(F.col("seg")).alias("to"))
            tree = tree.join(step, ["host", "template", "seg"]).withColumn("template", F.concat("template", F.lit("/"), "to")).drop("seg", "to")
            tree, d = common.saved(tree, "level"), d + 1
            done.append(tree.where(F.size("shape") == d).select(*names))
            if len(done) > 16:
                done = [common.saved(union(done), "ends")]
        ends = common.kept(common.saved(union(done), "ends"))
    sums = ends.groupBy("host", "template").agg(F.sum("good").alias("t_good"), F.sum("bad").alias("t_bad"))
    return ends.join(sums, ["host", "template"]).select("host", "shape", "template", "t_good", "t_bad")


def union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionAll(t)
    return out


def bad_template(good: Column, bad: Column) -> Column:
    return (bad * 100 + PRIOR_PAGES * PRIOR_PERCENT) > (good + bad + PRIOR_PAGES) * MAX_BAD_PERCENT


def judge(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """pages: page_id, url. labels: page_id, bad (boolean; null counts as unlabelled); ids may repeat, a page is bad if any
    of its labels is. Returns page_id, host, path, rule, verdict, template.

    A null URL, or one without ://, has an empty host and path; such pages form a host of their own and are judged like
    the rest. Empty tables give no rows; repeated pages are judged alike.
    """
    marks = labels.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    seen = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"))
    seen = seen.withColumns({"shape": shape_of(F.col("path")), "rule": rule, "by_rule": verdict})
    counts = (
        seen.select("page_id", "host", "shape").join(marks, "page_id", "left")
        .groupBy("host", "shape")
        .agg(F.count(F.lit(1)).alias("pages"), F.count_if(~F.col("bad")).alias("good"), F.count_if(F.col("bad")).alias("bad"))
    )
    with common.temporary():
        tree = common.kept(common.saved(template_tree(counts), "templates"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    tree = tree.select("host", "shape", "template", F.when(bad_template(F.col("t_good"), F.col("t_bad")), "block").otherwise("allow").alias("by_tree"), salts)
    return (
        seen.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int"))
        .join(tree, ["host", "shape", "salt"])
        .select("page_id", "host", "path", "rule", F.coalesce("by_rule", "by_tree").alias("verdict"), "template")
    )


def op7_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict. Labels: `labels` by page_id = doc_id; a page is bad if it is of low quality or toxic."""
    labels = common.table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad")
    )
    return judge(common.table(spark, sf_dir, "pages").select("page_id", "url"), labels)


def _rules_sql(what: int) -> str:
    cases = " ".join(
        f"WHEN (l.host = '{h}' OR ends_with(l.host, '.{h}')) AND starts_with(path, '{p}') THEN '{(h + p, v)[what]}'"
        for h, p, v in sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    )
    return f"CASE {cases} END"


OP7_SQL = rf"""
WITH RECURSIVE m AS (SELECT doc_id AS page_id, bool_or(quality = 0 OR toxic = 1) AS bad FROM labels WHERE doc_id IS NOT NULL AND (quality = 0 OR toxic = 1) IS NOT NULL GROUP BY 1),
u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{common.UPPER}', '{common.LOWER}') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
w AS (SELECT *, list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: CASE WHEN regexp_matches(s, '{VARIABLE}') THEN '*' ELSE s END) AS shape FROM u),
c AS (SELECT host, shape, count(*) AS pages, count(*) FILTER (NOT bad) AS good, count(*) FILTER (bad) AS bad FROM w LEFT JOIN m ON w.page_id = m.page_id GROUP BY ALL),
tree AS (
  SELECT host, shape, '' AS t, 0 AS d, pages, good, bad FROM c
  UNION ALL
  SELECT host, shape, t || '/' || CASE WHEN seg = '*' OR (kids >= {FAN_OUT} AND p < {RARE}) OR (kids > 1 AND (n = 0 OR m = 0 OR
      (b * m - (nb - b) * n) * (b * m - (nb - b) * n) * (n + m) <= {Z2} * nb * ng * n * m)) THEN '*' ELSE seg END, d + 1, pages, good, bad
  FROM (SELECT *, g + b AS n, ng + nb - g - b AS m FROM (
    SELECT *, sum(one) OVER (PARTITION BY host, t) AS kids FROM (
      SELECT *, shape[d + 1] AS seg, sum(pages) OVER (PARTITION BY host, t, shape[d + 1]) AS p,
        CAST(sum(good) OVER (PARTITION BY host, t, shape[d + 1]) AS DOUBLE) AS g, CAST(sum(bad) OVER (PARTITION BY host, t, shape[d + 1]) AS DOUBLE) AS b,
        CAST(sum(good) OVER (PARTITION BY host, t) AS DOUBLE) AS ng, CAST(sum(bad) OVER (PARTITION BY host, t) AS DOUBLE) AS nb,
        CASE WHEN row_number() OVER (PARTITION BY host, t, shape[d + 1]) = 1 THEN 1 ELSE 0 END AS one
      FROM tree WHERE d < len(shape))))),
l AS (SELECT host, shape, t, sum(good) OVER (PARTITION BY host, t) AS good, sum(bad) OVER (PARTITION BY host, t) AS bad FROM tree WHERE d = len(shape))
SELECT page_id, l.host, path, {_rules_sql(0)} AS rule,
  coalesce({_rules_sql(1)}, CASE WHEN l.bad * 100 + {PRIOR_PAGES * PRIOR_PERCENT} > (good + l.bad + {PRIOR_PAGES}) * {MAX_BAD_PERCENT} THEN 'block' ELSE 'allow' END) AS verdict,
  l.t AS template
FROM w JOIN l ON w.host = l.host AND w.shape = l.shape"""
