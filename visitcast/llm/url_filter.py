"""URL filter: host and path rules, then a path-template tree, by DataFrame functions only.

Per host, paths become templates: numbers and long hexadecimal segments turn into
typed wildcards, and walking down the tree a segment that is rare among its
siblings becomes `*`, down to the last segment. URLs that a rule decides are the
labelled sample. Siblings (nodes below one parent) are merged in order of their shares of
blocked URLs: those whose share doesn't differ from that of their branch's first by
more than Z standard errors have their labels in common.

The purity of a node, its share of blocked labels, is smoothed towards that of its
parent as if WEIGHT labels of the parent were added: the host's towards the suffix's
(the last part of the host name), the suffix's towards the corpus's. A template is
rejected if its own branch, merged siblings included, has LEAST labels and its purity
reaches REJECT: what lies above it is a prior and blocks nothing by itself, so
templates without labels are left to the rules.

Equal (host, typed path) rows are counted first, so a hot host shrinks to its
distinct typed paths before any join; the verdicts come back by a join on these.

Defined results: a null URL or one without `://` has an empty host and path, fits
no rule and is judged by its (unlabelled) template, so allowed; repeated rows are
judged each; no labels at all: everything beyond the rules is allowed; an empty
table gives no rows; other columns pass through, but those named like a result, _k,
_verdict or _segments are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitcast.llm.common import BROADCAST_ROWS, small, table, written

#: (verdict, host, path): the rules of the registered query. Given as a short list, at most MOST_RULES.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
MOST_RULES = 1000
#: Levels of the tree in ORACLE_SQL, enough for tables whose paths have no more segments.
DEPTH = 4
#: A segment stays literal if it has this many URLs and this share (in thousandths) of its parent's.
SUPPORT, SHARE = 3, 20
#: Labels that a template's own branch needs.
LEAST = 5
Z = 1.96
WEIGHT = 10.0
REJECT = 0.8

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest fitting rule (of equally long ones, the first in order of text), else null."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]), reverse=True):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(v)).otherwise(verdict)
    return text, verdict


def typed(path: Column) -> Column:
    """Segments of the path; numbers (also with a file ending) are {n}, long hexadecimal ones {h}."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(segments, lambda s: F.when(s.rlike(r"^[0-9]+(\.[A-Za-z0-9]+)?$"), "{n}").when(s.rlike(r"^[0-9a-fA-F-]{16,}$"), "{h}").otherwise(s))


def templates(paths: DataFrame) -> DataFrame:
    """paths (host, segments, n, ...) with `template`: an array, wildcards put in from the root down, level by level to the last segment.

    Below a node of fewer than SUPPORT URLs no segment can stay literal, so the rest is put in at once:
    the levels end where no SUPPORT URLs go on together.
    """
    typed_or_any = lambda s: F.when(s.isin("{n}", "{h}"), s).otherwise("*")
    now, whole, d = written(paths.withColumn("template", F.array().cast("array<string>")), "url-paths"), F.size("template") == F.size("segments"), 0
    finished = now.filter(whole)
    while not (more := now.filter(~whole)).isEmpty():
        seg = F.get("segments", F.lit(d))
        child = more.groupBy("host", "template", seg.alias("seg")).agg(F.sum("n").alias("urls"))
        # A join and not a window: a hot host may have any number of children, which a window would gather in one task.
        child = child.join(child.groupBy("host", "template").agg(F.sum("urls").alias("all")), ["host", "template"])
        fixed = F.col("seg").isin("{n}", "{h}") | ((F.col("urls") >= SUPPORT) & (1000 * F.col("urls") >= SHARE * F.col("all")))
        child = child.select("host", "template", "seg", F.when(fixed, F.col("seg")).otherwise("*").alias("step"), (F.col("all") < SUPPORT).alias("few"))
        joined = more.withColumn("seg", seg).join(child, ["host", "template", "seg"])
        rest = F.transform(F.slice("segments", F.lit(d + 1), F.size("segments")), typed_or_any)
        longer = F.when(F.col("few"), F.concat("template", rest)).otherwise(F.array_append("template", F.col("step")))
        now, d = written(joined.withColumn("template", longer).select(*paths.columns, "template"), "url-level"), d + 1
        finished = finished.unionByName(now.filter(whole))
    return finished


def _prefixes(template: Column) -> Column:
    """The template's nodes: its first segments to the last that isn't `*`, from none on, and all of them."""
    said = F.filter(F.sequence(F.lit(1), F.greatest(F.size(template), F.lit(1))), lambda i: F.get(template, i - 1) != "*")
    depths = F.array_distinct(F.concat(F.sequence(F.lit(0), F.coalesce(F.array_max(said), F.lit(0))), F.array(F.size(template))))
    return F.transform(depths, lambda d: F.slice(template, F.lit(1), d))


def _branches(family: Column, z: float) -> Column:
    """The siblings of a family (labelled, blocked, node), rising in their share of blocked labels, each with the number of its branch.

    A branch has a leader, its first sibling; the next ones join it as long as their share doesn't differ from the
    leader's by more than z standard errors. So no two of a branch are far apart, however many lie between.
    """
    size, bad = lambda x: x["labelled"].cast("double"), lambda x: x["blocked"].cast("double")

    def near(lead: Column, x: Column) -> Column:
        both = (bad(lead) + bad(x)) / (size(lead) + size(x))
        return F.abs(bad(x) / size(x) - bad(lead) / size(lead)) <= z * F.sqrt(both * (1 - both) * (1 / size(lead) + 1 / size(x))) + 1e-9

    sibling = "struct<labelled:bigint,blocked:bigint,node:array<string>>"
    start = F.struct(F.lit(None).cast(sibling).alias("lead"), F.lit(0).alias("branch"), F.array().cast("array<int>").alias("all"))

    def step(a: Column, x: Column) -> Column:
        joins = F.coalesce(near(a["lead"], x), F.lit(False))
        branch = F.when(joins, a["branch"]).otherwise(a["branch"] + 1)
        return F.struct(F.when(joins, a["lead"]).otherwise(x).alias("lead"), branch.alias("branch"), F.concat(a["all"], F.array(branch)).alias("all"))

    return F.zip_with(family, F.aggregate(family, start, step)["all"], lambda x, b: F.struct(x["labelled"].alias("labelled"), x["blocked"].alias("blocked"), x["node"].alias("node"), b.alias("branch")))


def nodes(tree: DataFrame, z: float = Z) -> DataFrame:
    """host, node (a template's first segments, none for the root), labelled, blocked: with the labels of merged siblings in common."""
    each = tree.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked")).filter("labelled > 0")
    counted = each.select("host", F.explode(_prefixes(F.col("template"))).alias("node"), "labelled", "blocked").groupBy("host", "node").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    # A node has at most 1000 / SHARE literal children and three wildcards, so no family is large.
    parent = F.slice("node", F.lit(1), F.greatest(F.size("node") - 1, F.lit(0)))
    member = F.struct((F.col("blocked") / F.col("labelled")).alias("share"), "node", "labelled", "blocked")
    families = counted.groupBy("host", parent.alias("parent"), F.size("node").alias("depth")).agg(F.array_sort(F.collect_list(member)).alias("members"))
    plain = F.transform("members", lambda x: F.struct(x["labelled"].alias("labelled"), x["blocked"].alias("blocked"), x["node"].alias("node")))
    placed = families.select("host", "parent", "depth", F.explode(_branches(plain, z)).alias("m")).select("host", "parent", "depth", "m.*")
    common = placed.groupBy("host", "parent", "depth", "branch").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"), F.collect_list("node").alias("nodes"))
    return common.select("host", F.explode("nodes").alias("node"), "labelled", "blocked")


def _suffix(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def purity(tree: DataFrame, least: int = LEAST, z: float = Z, weight: float = WEIGHT, reject: float = REJECT, rows: int = BROADCAST_ROWS) -> DataFrame:
    """host, template, purity, rejected, for the templates of `tree` (host, template, labelled, blocked)."""
    known = written(nodes(tree, z), "url-nodes")
    roots = known.filter(F.size("node") == 0)
    total = roots.agg(F.coalesce(F.sum("labelled"), F.lit(0)), F.coalesce(F.sum("blocked"), F.lit(0))).first()
    prior = total[1] / total[0] if total[0] else 0.0
    # Suffixes are few, hosts may be many.
    ends = roots.groupBy(_suffix(F.col("host")).alias("suffix")).agg(((F.sum("blocked") + weight * prior) / (F.sum("labelled") + weight)).alias("prior"))
    each = tree.select("host", "template").distinct()
    way = each.select("host", "template", F.explode(_prefixes(F.col("template"))).alias("node")).join(small(known, rows), ["host", "node"])
    chain = way.groupBy("host", "template").agg(F.array_sort(F.collect_list(F.struct(F.size("node").alias("d"), "labelled", "blocked"))).alias("chain"))
    based = chain.withColumn("suffix", _suffix(F.col("host"))).join(small(ends, rows), "suffix")
    smooth = F.aggregate("chain", F.col("prior"), lambda p, x: (x["blocked"] + weight * p) / (x["labelled"] + weight))
    # The last node of the chain is the template itself if that has labels; wider branches are its prior, not its verdict.
    last = F.element_at("chain", -1)
    own = (last["d"] == F.size("template")) & (last["labelled"] >= least)
    judged = based.select("host", "template", smooth.alias("purity"), own.alias("enough"))
    found = judged.select(F.col("host").alias("_h"), F.col("template").alias("_t"), "purity", (F.col("enough") & (F.col("purity") >= reject)).alias("rejected"))
    # Hosts without labels don't come back from the join with the nodes.
    out = each.join(found, (F.col("host") == F.col("_h")) & (F.col("template") == F.col("_t")), "left")
    return out.select("host", "template", "purity", F.coalesce("rejected", F.lit(False)).alias("rejected"))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """pages with host, path, rule, template, purity (null on hosts without labels) and verdict."""
    pages = pages.drop("host", "path", "rule", "template", "purity", "verdict", "_verdict", "_segments")
    host, path = host_and_path(F.col("url"))
    rows = pages.withColumns({"host": host, "path": path})
    text, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": text, "_verdict": verdict, "_segments": typed(F.col("path"))})
    label = F.col("_verdict")
    paths = rows.groupBy("host", F.col("_segments").alias("segments")).agg(F.count("*").alias("n"), F.count(label).alias("labelled"), F.count_if(label == "block").alias("blocked"))
    tree = written(templates(paths), "url-templates")
    rejected = tree.join(purity(tree), ["host", "template"]).select("host", F.col("segments").alias("_segments"), F.array_join("template", "/").alias("template"), "purity", "rejected")
    joined = rows.join(rejected, ["host", "_segments"], "left")
    return joined.withColumn("verdict", F.coalesce(label, F.when(F.col("rejected"), "block").otherwise("allow"))).drop("_verdict", "_segments", "rejected")


def op5_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "template")


def _sql() -> str:
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    longest = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in longest) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in longest) + " END"
    levels = ""
    for d in range(DEPTH):
        levels += f"""
uf_c{d} AS (SELECT host, tm, segs[{d + 1}] AS seg, sum(n) AS urls FROM uf_t{d} WHERE len(segs) > {d} GROUP BY ALL),
uf_s{d} AS (SELECT host, tm, seg, CASE WHEN seg IN ('{{n}}', '{{h}}') OR (urls >= {SUPPORT} AND 1000 * urls >= {SHARE} * sum(urls) OVER (PARTITION BY host, tm)) THEN seg ELSE '*' END AS step FROM uf_c{d}),
uf_t{d + 1} AS (SELECT t.* EXCLUDE (tm), CASE WHEN step IS NULL THEN t.tm ELSE list_append(t.tm, step) END AS tm FROM uf_t{d} t LEFT JOIN uf_s{d} s ON s.host = t.host AND s.tm = t.tm AND s.seg = t.segs[{d + 1}]),"""
    return rf"""
WITH RECURSIVE uf_rest AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
uf_parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM uf_rest),
uf_rows AS (
  SELECT *, {rule} AS rule, {verdict} AS v,
    list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: CASE WHEN regexp_matches(s, '^[0-9]+(\.[A-Za-z0-9]+)?$') THEN '{{n}}' WHEN regexp_matches(s, '^[0-9a-fA-F-]{{16,}}$') THEN '{{h}}' ELSE s END) AS segs
  FROM uf_parts),
uf_t0 AS (SELECT host, segs, count(*) AS n, count(v) AS labelled, count(*) FILTER (v = 'block') AS blocked, CAST([] AS VARCHAR[]) AS tm FROM uf_rows GROUP BY host, segs),{levels}
uf_tree AS (SELECT * EXCLUDE (tm), CASE WHEN len(segs) > {DEPTH} THEN list_append(tm, '**') ELSE tm END AS tm FROM uf_t{DEPTH}),
uf_pre AS (SELECT host, tm[1:d] AS node, sum(labelled) AS n, sum(blocked) AS b FROM (SELECT host, tm, labelled, blocked, unnest(list_filter(range(0, len(tm) + 1), lambda d: d = len(tm) OR len(list_filter(tm[d:], lambda s: s <> '*')) > 0 OR d = 0)) AS d FROM uf_tree WHERE labelled > 0) GROUP BY ALL),
uf_ord AS (SELECT *, node[1:greatest(len(node) - 1, 0)] AS par, len(node) AS d, row_number() OVER (PARTITION BY host, node[1:greatest(len(node) - 1, 0)], len(node) ORDER BY b / n, node) AS place FROM uf_pre),
uf_led AS (
  SELECT host, par, d, place, node, n, b, n AS ln, b AS lb, place AS branch FROM uf_ord WHERE place = 1
  UNION ALL
  SELECT host, par, d, place, node, n, b, CASE WHEN near THEN ln ELSE n END, CASE WHEN near THEN lb ELSE b END, CASE WHEN near THEN branch ELSE place END FROM (
    SELECT o.*, l.ln, l.lb, l.branch, abs(o.b / o.n - l.lb / l.ln) <= {Z} * sqrt(((l.lb + o.b) / (l.ln + o.n)) * (1 - (l.lb + o.b) / (l.ln + o.n)) * (1 / l.ln + 1 / o.n)) + 1e-9 AS near
    FROM uf_led l JOIN uf_ord o ON o.host = l.host AND o.par = l.par AND o.d = l.d AND o.place = l.place + 1)),
uf_node AS (SELECT host, node, d, sum(n) OVER (PARTITION BY host, par, d, branch) AS n, sum(b) OVER (PARTITION BY host, par, d, branch) AS b FROM uf_led),
uf_prior AS (SELECT coalesce(sum(b) / nullif(sum(n), 0), 0) AS prior FROM uf_node WHERE d = 0),
uf_end AS (SELECT regexp_extract(host, '[^.]*$') AS suffix, (sum(b) + {WEIGHT} * any_value(prior)) / (sum(n) + {WEIGHT}) AS p FROM uf_node, uf_prior WHERE d = 0 GROUP BY ALL),
uf_way AS (
  SELECT t.host, t.tm, list({{'n': CAST(n.n AS DOUBLE), 'b': CAST(n.b AS DOUBLE)}} ORDER BY n.d) AS way, max(n.n) FILTER (n.d = len(t.tm)) AS own
  FROM (SELECT DISTINCT host, tm FROM uf_tree) t JOIN uf_node n ON n.host = t.host AND n.d <= len(t.tm) AND n.node = t.tm[1:n.d] GROUP BY ALL),
uf_judged AS (
  SELECT w.host, w.tm, coalesce(own, 0) >= {LEAST} AND list_reduce(list_prepend(e.p, list_transform(way, lambda x: CAST(NULL AS DOUBLE))), lambda p, x, i: (way[i - 1].b + {WEIGHT} * p) / (way[i - 1].n + {WEIGHT})) >= {REJECT} AS rejected
  FROM uf_way w JOIN uf_end e ON e.suffix = regexp_extract(w.host, '[^.]*$'))
SELECT r.page_id, r.host, r.path, r.rule, coalesce(r.v, CASE WHEN rejected THEN 'block' ELSE 'allow' END) AS verdict, array_to_string(t.tm, '/') AS template
FROM uf_rows r JOIN uf_tree t ON t.host = r.host AND t.segs = r.segs LEFT JOIN uf_judged j ON j.host = t.host AND j.tm = t.tm"""


ORACLE_SQL = _sql()
