"""URL filters: path rules where they fit, elsewhere the standing of the host in the graph of hosts.

Hosts are linked where a page of one names another host of the table, as the target of a link or in its text. Hosts with
pages that a rule allows are trusted seeds, hosts with pages that a rule blocks are blocked seeds. Trust is a personalised
PageRank that follows the links; distrust follows them backwards, from a host to those that link to it. A host whose
distrust outweighs its trust is blocked.

Scores are whole numbers and every host's share of a score is a whole division, so sums do not depend on the order in which
tasks deliver them: a run is repeatable to the last unit, and two executors can never disagree about a threshold.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from entityframe.session import stage

UNIT = 10**9  # the seed of a host all of whose pages are allowed (or blocked)
DAMPING = 85  # in hundredths
ROUNDS = 20
MARGIN = 100  # blocked if 100 * distrust > MARGIN * trust

# What parts runs that may be a host: white space and the characters that end or surround a host in a page.
SEPARATORS = r"""[\x00-\x20/?#"'<>()\[\]{},;=&]+"""
EDGES = ".:@-"  # taken off both ends of a run
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A verdict for a host and its subdomains, for urls whose path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def rule(text: str) -> Rule:
    """From ``allow org/`` or ``block com/de/``: the path begins at the first slash."""
    verdict, _, place = text.partition(" ")
    if verdict not in ("allow", "block") or "/" not in place:
        raise ValueError(f"not a rule: {text}")
    host, _, path = place.partition("/")
    return Rule(verdict, host.lower(), "/" + path)


# The rules the registered query is to use.
RULES = [rule(r) for r in ("allow org/", "block example.org/es/", "block example.org/en/1", "allow com/fr/", "block com/de/")]


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url, both empty where it is null or has no ``://``."""
    found = lambda group: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", group), F.lit(""))
    return ascii_lower(found(1)), found(2)


def _domains(host: Column) -> Column:
    """A host and the domains it lies in."""
    labels = F.split(host, "[.]")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def _candidates(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """``(host, rules)``: the rules of a host and its domains, the longest first.

    An equi-join of each host's few domains with the rules, so a list of millions of rules does no more than join.
    """
    near = hosts.select("host", F.explode(_domains(F.col("host"))).alias("domain")).join(rules, F.col("domain") == F.col("rule_host"))
    entry = F.struct(F.length("rule").alias("size"), F.length("rule_host").alias("depth"), "rule", "rule_path", "rule_verdict")
    return near.groupBy("host").agg(F.sort_array(F.collect_list(entry), asc=False).alias("rules"))


def judge_by_rules(pages: DataFrame, rules: list[Rule], url: str = "url", page_id: str = "page_id") -> DataFrame:
    """``(page_id, host, path, rule, rule_verdict)``; the longest rule that fits wins, of equal ones the later in the alphabet."""
    session = pages.sparkSession
    listed = session.createDataFrame([(r.host, r.path, r.name, r.verdict) for r in rules], "rule_host string, rule_path string, rule string, rule_verdict string")
    host, path = parts(F.col(url))
    placed = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    hosts = placed.select("host").distinct()
    fits = F.filter("rules", lambda r: F.col("path").startswith(r["rule_path"]))
    first = F.get(fits, F.lit(0))
    judged = placed.join(_candidates(hosts, listed), "host", "left")
    return judged.select("page_id", "host", "path", first["rule"].alias("rule"), first["rule_verdict"].alias("rule_verdict"))


def host_edges(pages: DataFrame, hosts: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``(src, dst)``: pairs of different hosts of the table where a page of ``src`` names ``dst``. Each pair counts once.

    Pages are cut to distinct (host, name) pairs before the first shuffle, so a host with a third of all pages sends no
    more than the different names on them.
    """
    runs = F.filter(F.split(F.col(html), SEPARATORS), lambda r: r.contains("."))
    names = F.array_distinct(F.transform(runs, lambda r: F.btrim(ascii_lower(r), F.lit(EDGES))))
    named = pages.select(parts(F.col(url))[0].alias("src"), F.explode(names).alias("dst")).filter("src <> '' and src <> dst").distinct()
    return named.join(hosts.select(F.col("host").alias("dst")).filter("host <> ''"), "dst", "left_semi").select("src", "dst")


def seeds(judged: DataFrame) -> DataFrame:
    """``(host, trusted, blocked)``: the shares of a host's pages that rules allow and block, in units."""
    share = lambda verdict: F.expr(f"(count_if(rule_verdict = '{verdict}') * {UNIT}L) div count(*)")
    return judged.filter("host <> ''").groupBy("host").agg(share("allow").alias("trusted"), share("block").alias("blocked"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: int = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """``(kind, host, score)`` from ``(kind, src, dst)`` and ``(kind, host, seed)``, by rounds of personalised PageRank.

    In a round a host passes its score on in equal shares to the hosts it links to; the new score is the damped sum of what
    arrives plus the rest of the seed. What a host without links would pass on is left out: handing it back to the seeds
    would scale all scores alike. Rounds end early once nothing changes. Each round is one join and one aggregate, written
    to the shared folder; kinds run side by side.
    """
    out = edges.groupBy("kind", "src").agg(F.count("*").alias("out"))
    edges = stage(edges.join(out, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", "out"), "host-edges")
    # Whole divisions: damping in hundredths, first of the hundreds so that the product stays in range.
    rest = F.expr(f"(seed * {100 - damping}L) div 100")
    damped = F.expr(f"(coalesce(arrived, 0L) div 100) * {damping}L + ((coalesce(arrived, 0L) % 100) * {damping}L) div 100")
    score = seeds.select("kind", "host", F.col("seed").alias("score"))
    for _ in range(rounds):
        given = edges.join(score, ["kind", "host"]).select("kind", F.col("dst").alias("host"), F.expr("score div out").alias("share"))
        arrived = given.groupBy("kind", "host").agg(F.sum("share").alias("arrived"))
        new = stage(seeds.join(arrived, ["kind", "host"], "left").select("kind", "host", (rest + damped).alias("score")), "host-scores")
        moved = new.join(score.withColumnRenamed("score", "before"), ["kind", "host"]).filter("score <> before").limit(1).count()
        score = new
        if not moved:
            break
    return score


def standing(judged: DataFrame, edges: DataFrame, damping: int = DAMPING, rounds: int = ROUNDS, margin: int = MARGIN) -> DataFrame:
    """``(host, trust, distrust, blocked)`` of every host: trust follows the links, distrust runs against them."""
    both = lambda trust, distrust: F.explode(F.array(F.struct(F.lit("trust").alias("kind"), *trust), F.struct(F.lit("distrust").alias("kind"), *distrust))).alias("x")
    name = lambda *pairs: [F.col(c).alias(n) for c, n in pairs]
    known = stage(seeds(judged).select("host", both(name(("trusted", "seed")), name(("blocked", "seed")))).select("x.kind", "host", "x.seed"), "host-seeds")
    ways = edges.select(both(name(("src", "src"), ("dst", "dst")), name(("dst", "src"), ("src", "dst")))).select("x.*")
    scores = propagate(ways, known, damping, rounds)
    of = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("score")))
    more = F.col("distrust").cast("decimal(38,0)") * 100 > F.col("trust").cast("decimal(38,0)") * margin
    return scores.groupBy("host").agg(of("trust").alias("trust"), of("distrust").alias("distrust")).withColumn("blocked", more)


def filter_urls(pages: DataFrame, rules: list[Rule], page_id: str = "page_id", url: str = "url", html: str = "html", damping: int = DAMPING, rounds: int = ROUNDS, margin: int = MARGIN) -> DataFrame:
    """One row per page row: ``page_id, host, path, rule, verdict``.

    A page that a rule fits has the rule's verdict, any other its host's: blocked where the host's distrust outweighs its
    trust, else allowed; hosts that nothing is known of, and urls without a host, are allowed. Null html links nowhere;
    repeated rows and null ids are judged like any other row, but weigh in their host's seed as often as they stand there.
    """
    judged = stage(judge_by_rules(pages, rules, url, page_id), "judged-urls")
    hosts = judged.select("host").distinct()
    blocked = standing(judged, stage(host_edges(pages, hosts, url, html), "host-links"), damping, rounds, margin).filter("blocked").select("host", F.lit("block").alias("host_verdict"))
    verdict = F.coalesce("rule_verdict", "host_verdict", F.lit("allow"))
    return judged.join(blocked, "host", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"))
