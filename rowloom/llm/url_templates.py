"""URL filter by path-template trees.

A list of rules decides the urls that it covers; the verdicts of those are the labels from which the
others are judged. Per host the path segments form a tree. Segments with a digit or of more than
``LONG`` characters are variable and become ``*``. A branch with labels stays apart if its share of blocked
ones differs (chi-square with one degree of freedom of at least ``CHI2``) from that of all its siblings together or,
beside siblings without labels and where no branch above it stands apart yet, from that of all labels. All other branches, and those without
labels, are merged into ``*``, however many or few their pages are. What is left is the page's template, at any
depth. A template is blocked if its share of blocked labels is at least ``PURITY``, smoothed by that of the
host's pages outside of branches that stand apart, and this by that of all labels.

Cases: a null url, or one without ``://``, has an empty host and path and is judged like any other host;
an empty url or path has one empty segment; equal urls are judged alike, each in its own row; without
rules and labels nothing is blocked. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import col, written
from rowloom.llm.registry import query, table

LONG = 24
#: Levels of the SQL alone, which has a fixed number of them; the given paths have three.
LEVELS = 8
CHI2 = 3.84
SMOOTHING = 4.0
PURITY = 0.5
MAX_RULES = 1000

#: The given rules: a verdict, a host and the beginning of a path.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _ruled(rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; of two equal ones the one that blocks."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    rule = verdict = F.lit(None).cast("string")
    for decision, text in sorted(rules, key=lambda r: (len(r[1]), r[0] == "block", r[1])):
        host, _, path = text.partition("/")
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit(f".{host}"))) & F.startswith(F.col("path"), F.lit(f"/{path}"))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, decision).otherwise(verdict)
    return rule, verdict


def _segments() -> Column:
    parts = F.split(F.regexp_replace("path", "^/", ""), "/", -1)
    return F.transform(parts, lambda s: F.when(F.regexp_like(s, F.lit("[0-9]")) | (F.char_length(s) > LONG), "*").otherwise(s))


def _apart(share: Column) -> Column:
    """Whether the labels of a branch differ from a share; ``expected`` and its variance are of a binomial law."""
    expected = F.col("labels").cast("double") * share
    gap = F.col("bads") - expected
    return gap * gap >= CHI2 * (expected * (1 - share))


def templates(paths: DataFrame) -> DataFrame:
    """``host, path, template, kept, labels, bads`` of different paths ``host, path, labels, bads``.

    ``kept`` tells whether a branch of the template stands apart. Only paths below branches that labels may still
    tell apart go on to the next level.
    """
    state = paths.withColumns({"segs": _segments(), "template": F.lit(""), "kept": F.lit(False)})
    state = written(state, "paths")
    labels, bads = state.agg(F.sum("labels"), F.sum("bads")).first()
    overall = bads / labels if labels and 0 < bads < labels else None
    columns = ["host", "path", "template", "kept", "labels", "bads"]
    done, level = [], 0
    while True:
        rest = F.expr(f"repeat('/*', greatest(size(segs) - {level}, 0))")
        stats = state.filter(F.size("segs") > level).groupBy("host", "template", "kept", F.col("segs")[level].alias("seg")).agg(
            F.sum("labels").alias("labels"), F.sum("bads").alias("bads"))
        stats = written(stats, "segments")
        whole = stats.groupBy("host", "template", "kept").agg(
            F.sum("labels").alias("labels"), F.sum("bads").alias("bads"), F.bool_or(F.col("labels") == 0).alias("bare"))
        mixed = (F.col("bads") > 0) & (F.col("bads") < F.col("labels"))
        # labels of one kind that don't stand apart as a whole have no part that does
        against_all = ~F.col("kept") & (F.col("labels") > 0) & (mixed | _apart(F.lit(overall))) if overall is not None else F.lit(False)
        parents = whole.filter(mixed | against_all).select(
            F.col("host").alias("p_host"), F.col("template").alias("p_template"), "bare",
            F.when(mixed, F.col("bads").cast("double") / F.col("labels")).alias("share"))
        parents = written(parents, "parents")
        of_parent = (F.col("host") == F.col("p_host")) & (F.col("template") == F.col("p_template"))
        if parents.isEmpty():  # no branch below can be told apart any more
            break
        apart = F.coalesce(_apart(F.col("share")), F.lit(False))
        if overall is not None:
            apart = apart | (F.col("bare") & ~F.col("kept") & _apart(F.lit(overall)))
        literal = stats.join(parents, of_parent).filter("seg <> '*' and labels > 0").filter(apart).select(
            F.col("host").alias("l_host"), F.col("template").alias("l_template"), F.col("seg").alias("l_seg"))
        literal = written(literal, "literal")
        going = F.size("segs") > level
        closed = state.join(parents, of_parent & going, "left_anti").withColumn("template", F.concat("template", rest))
        done.append(written(closed.select(columns), "closed"))
        seg = F.col("segs")[level]
        same = (F.col("host") == F.col("l_host")) & (F.col("template") == F.col("l_template")) & (seg == F.col("l_seg"))
        below = state.filter(going).join(parents, of_parent, "left_semi").join(literal, same, "left")
        step = F.concat("template", F.lit("/"), F.coalesce("l_seg", F.lit("*")))
        below = below.withColumns({"template": step, "kept": F.col("kept") | F.col("l_seg").isNotNull()})
        state = written(below.select(*columns, "segs"), "level")
        level += 1
    state = state.withColumn("template", F.concat("template", rest)).select(columns)
    for part in done:
        state = state.unionByName(part)
    return state


def judge(pages: DataFrame, *, id: str = "page_id", url: str = "url", rules: list[tuple[str, str]] = RULES, label: str | None = None) -> DataFrame:
    """One row per page: ``host, path, rule, verdict``, and the template with its smoothed purity.

    ``label`` names a column of 1 (bad), 0 (good) or null to learn from besides the rules, which go first.
    """
    host, path = host_and_path(F.col("u"))
    base = pages.select(col(id).alias("k"), col(url).alias("u"), (F.lit(None) if label is None else col(label)).cast("int").alias("l"))
    base = base.select("k", "l", host.alias("host"), path.alias("path"))
    rule, verdict = _ruled(rules)
    bad = F.coalesce(F.when(verdict == "block", 1).when(verdict == "allow", 0), F.col("l"))
    base = base.withColumn("bad", bad)
    paths = base.groupBy("host", "path").agg(F.count("bad").alias("labels"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bads"))
    state = written(templates(paths), "state")
    found = state.groupBy("host", "template").agg(
        F.first("kept").alias("kept"), F.sum("labels").alias("labels"), F.sum("bads").alias("bads"))
    found = written(found, "templates")
    outside = lambda c: F.sum(F.when(F.col("kept"), 0).otherwise(F.col(c)))
    hosts = written(found.groupBy("host").agg(outside("labels").alias("host_labels"), outside("bads").alias("host_bads")), "hosts")
    labels, bads = found.agg(F.sum("labels"), F.sum("bads")).first()
    prior = ((bads or 0) + 1.0) / ((labels or 0) + 2.0) if labels else 0.0
    of_host = (F.col("host_bads") + SMOOTHING * F.lit(prior)) / (F.col("host_labels") + SMOOTHING)
    purity = (F.col("bads") + SMOOTHING * of_host) / (F.col("labels") + SMOOTHING)
    found = written(found.join(hosts, "host").select("host", "template", purity.alias("purity")), "purity")
    judged = state.select("host", "path", "template").join(found, ["host", "template"])
    return base.select("k", "host", "path").join(judged, ["host", "path"]).select(
        F.col("k").alias(id), "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("purity") >= PURITY, "block").otherwise("allow")).alias("verdict"), "template", "purity")


def _sql() -> str:
    cases = {"rule": "NULL", "verdict": "NULL"}
    for decision, text in sorted(RULES, key=lambda r: (len(r[1]), r[0] == "block", r[1])):
        host, _, path = text.partition("/")
        fits = f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}')"
        cases = {"rule": f"CASE WHEN {fits} THEN '{text}' ELSE {cases['rule']} END", "verdict": f"CASE WHEN {fits} THEN '{decision}' ELSE {cases['verdict']} END"}
    sql = rf"""
WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
  regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT *, {cases['rule']} AS rule, {cases['verdict']} AS ruled FROM b),
s0 AS (SELECT page_id, host, path, rule, ruled, CASE ruled WHEN 'block' THEN 1 WHEN 'allow' THEN 0 END AS bad, '' AS t, FALSE AS kept,
  list_transform(list_slice(string_split(regexp_replace(path, '^/', ''), '/'), 1, {LEVELS}),
    lambda x: CASE WHEN regexp_matches(x, '[0-9]') OR length(x) > {LONG} THEN '*' ELSE x END) AS segs FROM c),
o AS (SELECT sum(bad)::DOUBLE / count(bad) AS q FROM s0)"""
    apart = "(bads - labels * {0}) * (bads - labels * {0}) >= " + f"{CHI2}::DOUBLE * " + "(labels * {0} * (1 - {0}))"
    for i in range(1, LEVELS + 1):
        sql += f""",
n{i} AS (SELECT host, t, kept, segs[{i}] AS seg, count(bad)::DOUBLE AS labels, coalesce(sum(bad), 0)::DOUBLE AS bads FROM s{i - 1} WHERE len(segs) >= {i} GROUP BY ALL),
w{i} AS (SELECT host, t, sum(bads) / sum(labels) AS share, bool_or(labels = 0) AS bare FROM n{i} GROUP BY host, t HAVING sum(labels) > 0),
l{i} AS (SELECT host, t, seg FROM n{i} JOIN w{i} USING (host, t) CROSS JOIN o WHERE seg <> '*' AND labels > 0 AND (
  (share > 0 AND share < 1 AND {apart.format('share')}) OR (bare AND NOT kept AND q > 0 AND q < 1 AND {apart.format('q')}))),
s{i} AS (SELECT s.page_id, s.host, s.path, rule, ruled, bad, segs, s.kept OR l.seg IS NOT NULL AS kept,
  CASE WHEN len(segs) < {i} THEN s.t WHEN l.seg IS NULL THEN s.t || '/*' ELSE s.t || '/' || l.seg END AS t
  FROM s{i - 1} s LEFT JOIN l{i} l ON s.host = l.host AND s.t = l.t AND segs[{i}] = l.seg)"""
    return sql + f""",
f AS (SELECT host, t, bool_or(kept) AS kept, count(bad)::DOUBLE AS labels, coalesce(sum(bad), 0)::DOUBLE AS bads FROM s{LEVELS} GROUP BY host, t),
h AS (SELECT host, sum(CASE WHEN kept THEN 0 ELSE labels END) AS hl, sum(CASE WHEN kept THEN 0 ELSE bads END) AS hb FROM f GROUP BY host),
g AS (SELECT CASE WHEN sum(labels) > 0 THEN (sum(bads) + 1.0::DOUBLE) / (sum(labels) + 2.0::DOUBLE) ELSE 0 END AS prior FROM f),
p AS (SELECT f.host, t, (bads + {SMOOTHING}::DOUBLE * ((hb + {SMOOTHING}::DOUBLE * prior) / (hl + {SMOOTHING}::DOUBLE)))
  / (labels + {SMOOTHING}::DOUBLE) AS purity FROM f JOIN h USING (host) CROSS JOIN g)
SELECT page_id, s.host, path, rule, coalesce(ruled, CASE WHEN purity >= {PURITY} THEN 'block' ELSE 'allow' END) AS verdict, s.t AS template, purity
FROM s{LEVELS} s JOIN p ON s.host = p.host AND s.t = p.t
"""


OP3_SQL = _sql()


@query("op3_url_templates", OP3_SQL)
def op3_url_templates(spark, sf_dir):
    return judge(table(spark, sf_dir, "pages"))
