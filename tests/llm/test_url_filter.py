"""URL rules case by case, and the standing of hosts against a plain whole-number PageRank and the SQL."""

import collections
import random

import duckdb
import pytest

from entityframe.llm import queries as Q
from entityframe.llm import url_filter as U


def pages(spark, rows, extra=()):
    return spark.createDataFrame([(i, u, h) for i, u, h in rows], "page_id long, url string, html string").selectExpr("*", *extra)


def plain_scores(edges, seed):
    """Rounds over all hosts with dictionaries."""
    out = collections.Counter(s for s, _ in set(edges))
    score = dict(seed)
    for _ in range(U.ROUNDS):
        arrived = collections.Counter()
        for s, d in set(edges):
            arrived[d] += score[s] // out[s]
        score = {h: seed[h] * (100 - U.DAMPING) // 100 + arrived[h] // 100 * U.DAMPING + arrived[h] % 100 * U.DAMPING // 100 for h in seed}
    return score


@pytest.mark.parametrize(
    "url, host, path, name, verdict",
    [
        ("https://WWW.Example.ORG/es/1?x=/en/1", "www.example.org", "/es/1", "example.org/es/", "block"),
        ("http://example.org/en/17#a", "example.org", "/en/17", "example.org/en/1", "block"),
        ("http://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
        ("http://notexample.org/en/1", "notexample.org", "/en/1", "org/", "allow"),
        ("x://a.b.com/fr/", "a.b.com", "/fr/", "com/fr/", "allow"),
        ("x://com/de/1", "com", "/de/1", "com/de/", "block"),
        ("x://a.com/DE/1", "a.com", "/DE/1", None, "allow"),
        ("http://example.org", "example.org", "", None, "allow"),
        ("http://example.org?/es/", "example.org", "", None, "allow"),
        ("http://a.com#://b.org/es/", "a.com", "", None, "allow"),
        ("a://b://c.org/", "b:", "//c.org/", None, "allow"),
        ("://org/\nq", "org", "/\nq", "org/", "allow"),
        ("no scheme.org/es/", "", "", None, "allow"),
        ("", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("http:///es/", "", "/es/", None, "allow"),
        ("http://ÉXAMPLE.İorg/x", "ÉxaMPLE.İorg".replace("MPLE", "mple"), "/x", None, "allow"),
    ],
)
def test_rules(spark, url, host, path, name, verdict):
    got = U.filter_urls(pages(spark, [(1, url, None)], ["'x' as host", "'y' as rule", "0 as score"]), U.RULES, rounds=1).collect()
    assert [tuple(r) for r in got] == [(1, host, path, name, verdict)]


def graph(seed=5, hosts=40):
    """Pages that name each other's hosts in links and in text."""
    rng = random.Random(seed)
    names = [f"h{i}.{rng.choice(['net', 'com', 'org', 'example.org'])}" for i in range(hosts)]
    rows, edges = [], set()
    for n in range(hosts * 6):
        own = rng.choice(names)
        others = [rng.choice(names) for _ in range(rng.choice([0, 0, 1, 2]))]
        edges |= {(own, o) for o in others if o != own}
        html = "".join(rng.choice(['<a href="https://{}/x?y">a</a>', "see {}. and", "(//{}:)", "<p>{}</p>"]).format(o.upper() if rng.random() < 0.3 else o) for o in others)
        rows.append((n, f"https://{own}/{rng.choice(['en', 'es', 'fr', 'de'])}/{rng.randint(0, 30)}", html + " unknown.net a.b" if n % 7 else None))
        if not n % 7:
            edges -= {(own, o) for o in others if not any(r[1].split("/")[2] == own and r[2] and o in r[2].lower().replace(":", " ") for r in rows)}
    return rows


def named_edges(rows):
    hosts = {r[1].split("/")[2] for r in rows}
    out = set()
    for _, url, html in rows:
        own = url.split("/")[2]
        for h in hosts:
            if html and h != own and any(h == w.strip(".:@-") for w in __import__("re").split(U.SEPARATORS, html.lower())):
                out.add((own, h))
    return out


def test_standing_follows_links(spark):
    rows = graph()
    df = pages(spark, rows)
    judged = U.judge_by_rules(df, U.RULES)
    got = {(r.src, r.dst) for r in U.host_edges(df, judged.select("host").distinct()).collect()}
    edges = named_edges(rows)
    assert got == edges and len(edges) > 50
    share = {v: {} for v in ("allow", "block")}
    by_host = collections.defaultdict(list)
    for r in judged.collect():
        by_host[r.host].append(r.rule_verdict)
    for v in share:
        share[v] = {h: own.count(v) * U.UNIT // len(own) for h, own in by_host.items()}
    trust, distrust = plain_scores(edges, share["allow"]), plain_scores({(d, s) for s, d in edges}, share["block"])
    found = {r.host: (r.trust, r.distrust, r.blocked) for r in U.standing(judged, spark.createDataFrame(sorted(edges), "src string, dst string")).collect()}
    assert found == {h: (trust[h], distrust[h], distrust[h] > trust[h]) for h in by_host}
    assert 0 < sum(b for *_, b in found.values()) < len(found)


def test_linking_to_blocked_hosts_counts_against_a_host(spark):
    rows = [(1, "http://bad.com/de/1", None), (2, "http://fan.net/1", "<a href='http://bad.com/de/1'>x</a>"), (3, "http://good.org/1", '<a href="//liked.net/">'), (4, "http://liked.net/2", "bad.com"), (5, "http://alone.net/", "")]
    got = {r.page_id: (r.rule, r.verdict) for r in U.filter_urls(pages(spark, rows), U.RULES).collect()}
    assert got == {1: ("com/de/", "block"), 2: (None, "block"), 3: ("org/", "allow"), 4: (None, "allow"), 5: (None, "allow")}


def test_sql_on_a_linked_table(spark, tmp_path):
    rows = [*graph(9), (None, None, "h1.net"), (7, "https://h1.net/en/3", None), (7, "https://h1.net/en/3", None), (900, "no host", "h1.net h2.com")]
    df = pages(spark, rows, ["1 as verdict"])
    df.coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    got = Q.op11_link_graph_urls(spark, str(tmp_path))
    order = lambda found: sorted(map(tuple, found), key=repr)
    want = con.sql(Q.ORACLES["op11_link_graph_urls"]).project(", ".join(got.columns)).fetchall()
    assert order(got.collect()) == order(want)
    assert collections.Counter(r[4] for r in want if r[3] is None)["block"] > 0


def test_empty_table(spark):
    assert U.filter_urls(pages(spark, [(1, "x", "y")]).limit(0), U.RULES).count() == 0


def test_a_rule_needs_a_place():
    with pytest.raises(ValueError):
        U.rule("allow org")
