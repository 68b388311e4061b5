"""URL filters: host and path rules, and a path-template tree for what no rule fits.

Rules (host, path prefix, verdict) fit a host and its subdomains; the longest wins, then the
first by code point. Urls that a rule fits are the labelled examples of the tree.

Tree, per host: digits within a segment become {n} and long slugs {slug}. Then level by
level, below the generalised path so far, children become the wildcard * if they are a
variable segment (over VARIABLE children, this one below 5 % of the node) or statistically
similar: labelled, of about the same depth below, and with a share of blocked labels within
two standard errors of the node's. A child without labels is similar if its depth below and
its number of different children are about those of the node, at least half of which is
labelled; so a few labels never speak for a host's other branches. Levels run to the end of the longest path. A path that has
ended counts as an empty segment. After LEVELS levels, shapes leave together once none of their
template is longer, a shape that shares its template with no other keeps its own rest, and
segments that all shapes of a template share are one step. A template is rejected if its smoothed purity
(blocked + SMOOTH / 2) / (labelled + SMOOTH) reaches PURITY; unlabelled ones stay at one half.

Distinct (host, template) pairs are counted before any level runs, so a hot host is a few
rows. A null url, or one without ://, has an empty host and path and is allowed. Repeated
rows each get their verdict. DataFrame operations only.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm._common import clear_of, materialize

#: Levels that every shape takes part in.
LEVELS = 3
VARIABLE = 20
SMOOTH = 4
PURITY = 0.8
SLUG = 24
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    text: str  # host/path

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


RULES = (Rule("block", "net/"), Rule("allow", "example.net/en/"), Rule("block", "example.com/de/"), Rule("allow", "org/fr/"))


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    at = F.locate("://", F.col(url))
    rest = F.when(at > 0, F.expr(f"substring({url}, locate('://', {url}) + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(raw, _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)?", 1)


def rule_for(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, or nulls."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), [-ord(c) for c in r.text])):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, verdict = F.when(fits, F.lit(r.text)).otherwise(text), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return text, verdict


def template(path: Column) -> Column:
    """Segments of a path with digits and long slugs generalised."""
    return F.transform(
        F.split(F.substr(path, F.lit(2)), "/", -1),
        lambda s: F.when(F.char_length(s) > SLUG, F.lit("{slug}")).otherwise(F.regexp_replace(s, "[0-9]+", "{n}")),
    )


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """pages without html, with host, path, rule and verdict (block or allow)."""
    clear_of(pages, "host", "path", "rule", "verdict", "_shape", "_given")
    host, path = host_and_path()
    parsed = pages.drop("html").withColumns({"host": host, "path": path})
    text, verdict = rule_for(F.col("host"), F.col("path"), rules)
    parsed = parsed.withColumns({"rule": text, "_given": verdict, "_shape": F.array_join(template(F.col("path")), "/")})
    marked = judged_templates(parsed).select(F.col("host").alias("_h"), F.col("shape").alias("_s"), "reject")
    out = parsed.join(marked, (F.col("host") == F.col("_h")) & (F.col("_shape") == F.col("_s")), "left")
    final = F.coalesce("_given", F.when(F.col("reject"), F.lit("block")).otherwise(F.lit("allow")))
    return out.withColumn("verdict", final).drop("_h", "_s", "_given", "_shape", "reject")


def judged_templates(parsed: DataFrame) -> DataFrame:
    """(host, shape, template, purity, reject) for every distinct shape."""
    tree = parsed.groupBy("host", F.col("_shape").alias("shape")).agg(F.count(F.lit(1)).alias("n"), F.count("_given").alias("labelled"), F.count_if(F.col("_given") == "block").alias("bad"))
    tree = tree.withColumn("segments", F.split("shape", "/", -1)).withColumn("template", F.lit(""))
    tree = materialize(tree, "url-shapes")
    for level in range(1, LEVELS + 1):
        tree = _grown(tree, F.lit(level))
    tree, ended = materialize(tree.withColumn("done", F.lit(LEVELS)), "url-level"), []
    while True:
        open_ = materialize(_grown(_followed(tree), F.col("done") + 1).withColumn("done", F.col("done") + 1), "url-level")
        if open_.isEmpty():
            break
        ended.append(tree.join(open_.select("host", "shape"), ["host", "shape"], "left_anti"))
        tree = open_
    tree = reduce(DataFrame.unionByName, [*ended, tree])
    rest = F.array_join(_rest(), "/")
    tree = materialize(tree.withColumn("template", F.concat_ws("/", "template", rest)).select("host", "shape", "template", "labelled", "bad"), "url-templates")
    purity = tree.groupBy("host", "template").agg(((F.sum("bad") + SMOOTH / 2) / (F.sum("labelled") + SMOOTH)).alias("purity"))
    return tree.select("host", "shape", "template").join(purity, ["host", "template"]).withColumn("reject", F.col("purity") >= PURITY)


def _rest() -> Column:
    """The segments behind the levels that are done."""
    return F.slice("segments", F.col("done") + 1, F.greatest(F.size("segments") - F.col("done"), F.lit(0)))


def _followed(tree: DataFrame) -> DataFrame:
    """The shapes that share their template with a longer or another one, behind all segments that they have in common.

    A node with one child is that child: similar to itself if it has labels, else under its own
    name. So a chain of such nodes is one step, and rounds are as many as there are branchings on a path.
    """
    nodes = tree.groupBy("host", "template").agg(F.count(F.lit(1)).alias("shapes"), F.max(F.size("segments")).alias("most"), F.max("done").alias("least"), F.sum("labelled").alias("marks"), F.min(_rest()).alias("low"), F.max(_rest()).alias("high"))
    # Lists in order: what the first and the last have in common, all have.
    apart = F.array_position(F.zip_with("low", "high", lambda a, b: a.eqNullSafe(b)), F.lit(False))
    chain = F.slice("low", F.lit(1), F.greatest(apart - 1, F.lit(0)).cast("int"))
    nodes = nodes.filter("shapes > 1 and most > least").select("host", "template", "marks", chain.alias("chain"))
    tokens = F.transform("chain", lambda x: F.when(F.col("marks") > 0, F.lit("*")).otherwise(x))
    followed = tree.join(nodes, ["host", "template"])
    named = F.when(F.size("chain") > 0, F.concat_ws("/", "template", F.array_join(tokens, "/"))).otherwise(F.col("template"))
    return followed.withColumns({"template": named, "done": F.col("done") + F.size("chain")}).drop("marks", "chain")


def _grown(tree: DataFrame, level: Column) -> DataFrame:
    """Shapes with the templates that one more level gives."""
    at = lambda k: F.coalesce(F.try_element_at("segments", k), F.lit(""))
    here = tree.withColumns({"child": at(level), "next": at(level + 1)}).withColumn("below", F.greatest(F.size("segments") - level, F.lit(0)) * F.col("n"))
    sums = [F.sum(c).alias(c) for c in ("n", "labelled", "bad", "below")]
    child = here.groupBy("host", "template", "child").agg(*sums, F.count_distinct("next").alias("fan"))
    node = child.groupBy("host", "template").agg(F.count(F.lit(1)).alias("children"), *(F.sum(c).alias(f"all_{c}") for c in ("n", "labelled", "bad", "below", "fan")))
    d = lambda c: F.col(c).cast("double")
    variable = (F.col("children") > VARIABLE) & (d("n") * 20 < d("all_n"))
    apart = d("bad") * d("all_labelled") - d("all_bad") * d("labelled")
    deep = F.abs(d("below") * d("all_n") - d("all_below") * d("n")) * 2 <= d("n") * d("all_n")
    similar = (F.col("labelled") > 0) & deep & (apart * apart <= 4 * d("all_bad") * (d("all_labelled") - d("all_bad")) * d("labelled"))
    wide = (d("fan") * d("children") * 2 >= d("all_fan")) & (d("fan") * d("children") <= 2 * d("all_fan"))
    similar = similar | ((F.col("labelled") == 0) & (2 * d("all_labelled") >= d("all_n")) & deep & wide)
    named = child.join(node, ["host", "template"]).select("host", "template", "child", F.when(variable | similar, F.lit("*")).otherwise(F.col("child")).alias("token"))
    return here.join(named, ["host", "template", "child"]).withColumn("template", F.concat_ws("/", "template", "token")).drop("child", "next", "below", "token")
