import numpy as np
import pytest

from postmill.llm import queries, urlgraph

PAGE = "page_id long, url string, html string, host string, verdict string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows], PAGE)


def plain_split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[cut:]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    return host, path[:min([path.index(c) for c in "?#" if c in path], default=len(path))]


def plain_rule(host, path, rules):
    hits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(hits)[1:] if hits else (None, None)


def plain_ranks(edges, seeds, damping, rounds=400):
    """edges: {(src, dst): links}; seeds: {host: (trusted, blocked)}; the sums as loops."""
    hosts = {h for e in edges for h in e} | set(seeds)
    out = {}
    for k in (0, 1):
        ways = {(e if k == 0 else e[::-1]): n for e, n in edges.items()}
        total = sum(s[k] for s in seeds.values()) or 1
        start = {h: seeds.get(h, (0, 0))[k] / total for h in hosts}
        leaving = {h: sum(n for e, n in ways.items() if e[0] == h) for h in hosts}
        rank = dict(start)
        for _ in range(rounds):
            new = {h: (1 - damping) * start[h] for h in hosts}
            for h in hosts:
                if not leaving[h]:
                    new[h] += damping * rank[h]
            for (a, b), n in ways.items():
                new[b] += damping * rank[a] * n / leaving[a]
            rank = new
        out[k] = rank
    return {h: (out[0][h], out[1][h]) for h in hosts}


URLS = ["http://A.Example.NET/en/1?x#y", "https://example.com/de/", "https://m.example.com/dex", "ftp://b.org/fr/a", "b.org/fr/a",
        "http://x.net", "http://x.net?u=/en/", "http://anet/", "x://y://z/#", None, "", "http://", "https://É.Org/fr/", "a://b\n/c",
        "http://example.net/en", "http://notexample.net/en/"]


def test_split_and_rules(spark):
    got = urlgraph.split_urls(pages(spark, [(i, u, None) for i, u in enumerate(URLS)]), urlgraph.RULES).collect()
    for r in got:
        host, path = plain_split(URLS[r.page_id])
        assert (r.host, r.path) == (host, path)
        assert (r.rule, r.said) == plain_rule(host, path, urlgraph.RULES)


def link(*hosts):
    return " ".join(f'<a HREF="https://{h}/x">a</a><a href=/own>b</a>' for h in hosts)


GRAPH = [
    (1, "http://good.org/fr/1", link("friend.com", "friend.com", "Friend.com")), (2, "http://friend.com/a", link("pal.com")),
    (3, "http://pal.com/", link("good.org")), (4, "http://bad.net/", link("worse.com")), (5, "http://fan.com/", link("bad.net")),
    (6, "http://fan.com/2", link("bad.net", "u@bad.net:80")), (7, "http://lonely.com/", None), (8, "http://sub.fan.com/", ""),
    (9, "http://both.com/", link("good.org", "bad.net"))]


def test_ranks_equal_brute_force(spark):
    got = {r.host: (r.trust, r.distrust) for r in urlgraph.judged(pages(spark, GRAPH), tolerance=1e-6).collect()}
    edges = {("good.org", "friend.com"): 3, ("friend.com", "pal.com"): 1, ("pal.com", "good.org"): 1, ("bad.net", "worse.com"): 1,
             ("fan.com", "bad.net"): 2, ("fan.com", "bad.net:80"): 1, ("both.com", "good.org"): 1, ("both.com", "bad.net"): 1,
             ("sub.fan.com", "fan.com"): 1, ("fan.com", "sub.fan.com"): 1}
    seeds = {h: (h == "good.org", h == "bad.net") for h in ("good.org", "bad.net", "friend.com", "pal.com", "fan.com", "lonely.com",
                                                            "sub.fan.com", "both.com")}
    want = plain_ranks(edges, seeds, urlgraph.DAMPING)
    for host, ranks in got.items():
        assert ranks == pytest.approx(want[host], abs=1e-5)


def test_verdicts(spark):
    got = {r.page_id: (r.rule, r.verdict) for r in urlgraph.judged(pages(spark, GRAPH)).collect()}
    assert got[1] == ("org/fr/", "allow") and got[4] == ("net/", "block")
    assert [got[i][1] for i in (2, 3, 7)] == ["allow"] * 3  # trusted, trusted, unknown
    assert [got[i] for i in (5, 6, 8)] == [(None, "block")] * 3  # they link to a blocked host, or to one that does


def test_query(spark, sf_dir):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = queries.op5_url_graph(spark, sf_dir)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    rows = got.collect()
    assert len(rows) == len(urls)
    for r in rows:
        host, path = plain_split(urls[r.page_id])
        rule, said = plain_rule(host, path, urlgraph.RULES)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == said if said else r.verdict in ("allow", "block")


def test_odd_rows(spark):
    rows = [(1, None, None), (1, None, None), (None, "http://a.b.c.net/", ""), (2, "", "x" * 200000), (3, "http://a.com/", link("a.com"))]
    got = sorted((r.page_id or 0, r.host, r.verdict) for r in urlgraph.judged(pages(spark, rows)).collect())
    assert got == [(0, "a.b.c.net", "block"), (1, "", "allow"), (1, "", "allow"), (2, "", "allow"), (3, "a.com", "allow")]
    assert urlgraph.judged(pages(spark, rows).limit(0)).collect() == []
    assert {r.rule for r in urlgraph.judged(pages(spark, rows), [], 0.1).collect()} == {None}


def test_one_blocked_host_does_not_block_its_siblings(spark):
    rows = [(1, "http://m.bets.example.com/de/", None), (2, "http://m.bets.example.com/de/2", None)]
    rows += [(10 + k, f"http://w{k}.example.com/a", None) for k in range(30)]
    got = {r.page_id: r.verdict for r in urlgraph.judged(pages(spark, rows)).collect()}
    assert got.pop(1) == got.pop(2) == "block" and set(got.values()) == {"allow"}


def solved(n, seed, damping=urlgraph.DAMPING):
    """Distrust on a chain c0 -> c1 -> ... whose host ``seed`` is blocked, as the solution of the linear system."""
    move = np.zeros((n, n))
    for k in range(n):
        move[max(0, k - 1), k] = 1  # against the links; c0 has no way on and keeps what it has
    start = np.zeros(n)
    start[seed] = 1
    return np.linalg.solve(np.eye(n) - damping * move, (1 - damping) * start), np.linalg.solve(
        np.eye(n) - damping * move, (1 - damping) * np.full(n, 1 / n))


@pytest.mark.parametrize("n", [13, 51])
def test_chains_have_the_ranks_of_the_solved_system(spark, n):
    rows = [(k, f"http://c{k}.com/", link(f"c{k + 1}.com")) for k in range(n - 2)]
    rows += [(n - 2, f"http://c{n - 2}.com/", '<a href="http://bad.net/">x</a>'), (n - 1, "http://bad.net/", None)]
    got = {r.page_id: r for r in urlgraph.judged(pages(spark, rows), tolerance=1e-6).collect()}
    distrust, base = solved(n, n - 1)
    for k in range(n):
        assert got[k].distrust == pytest.approx(distrust[k], abs=1e-5)
        # No host has any trust, so that one is blocked which has more distrust than its baseline.
        if k < n - 1 and abs(distrust[k] - base[k]) > 1e-4:
            assert got[k].verdict == ("block" if distrust[k] > base[k] else "allow")


def test_a_front_of_unfinished_mass_blocks_no_host(spark):
    rows = [(k, f"http://c{k}.com/", link(f"c{k + 1}.com")) for k in range(11)]
    rows += [(11, "http://c11.com/", link("bad.net")), (12, "http://bad.net/", None)]
    got = {r.page_id: r for r in urlgraph.judged(pages(spark, rows)).collect()}
    assert all(got[k].distrust > 0 for k in range(13))
    assert got[4].distrust == pytest.approx(0.15 * 0.85**8, abs=2e-3)


def test_ranks_that_cannot_settle_are_an_error(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0)], "src string, dst string, links double")
    seeds = spark.createDataFrame([("a", 1.0, 0.0)], "host string, trusted double, blocked double")
    with pytest.raises(RuntimeError, match="settle"):
        urlgraph.propagate(edges, seeds, tolerance=0.9e-16, damping=0.5)
