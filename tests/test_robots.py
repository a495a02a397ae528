"""Robots grouping, precedence and path verdicts on robots files of our own."""

import pytest

from crawlscope.operators import robots as R

AGENT = "Harvest-Robot/2.3 (+https://harvest.example/info)"


def verdict(spark, text, path, ua=AGENT):
    docs = spark.createDataFrame([("site", text)], "scan_id string, body string")
    targets = spark.createDataFrame([("site", path)], "scan_id string, path string")
    return R.verdicts(targets, docs, "path", ua).select("allowed").first()[0]


def lines(*rows):
    return "\n".join(rows) + "\n"


@pytest.mark.parametrize("text,path,allowed", [
    # the agent name that matches most characters decides
    (lines("User-agent: harvest", "Disallow: /", "", "User-agent: Harvest-Robot", "Disallow: /drafts/"), "/news/7", True),
    (lines("User-agent: harvest", "Disallow: /", "", "User-agent: Harvest-Robot", "Disallow: /drafts/"), "/drafts/7", False),
    # two groups of one agent count as one
    (lines("User-agent: harvest-robot", "Disallow: /cart", "", "User-agent: harvest-robot", "Disallow: /login"), "/cart/3", False),
    (lines("User-agent: harvest-robot", "Disallow: /cart", "", "User-agent: harvest-robot", "Disallow: /login"), "/login", False),
    # a blank line, or one that only holds a comment, ends a group
    (lines("User-agent: harvest-robot", "", "Disallow: /archive"), "/archive", True),
    (lines("User-agent: harvest-robot", "   # nothing here", "Disallow: /archive"), "/archive", True),
    # without a group of its own the agent obeys every * group
    (lines("User-agent: nobody", "Disallow: /", "", "User-agent: *", "Disallow: /tmp", "", "User-agent: *", "Disallow: /old"), "/tmp/1", False),
    (lines("User-agent: nobody", "Disallow: /", "", "User-agent: *", "Disallow: /tmp", "", "User-agent: *", "Disallow: /old"), "/old/1", False),
    (lines("User-agent: nobody", "Disallow: /", "", "User-agent: *", "Disallow: /tmp", "", "User-agent: *", "Disallow: /old"), "/new", True),
    # comments and space around names and values, agents that share rules
    (lines("\tUser-agent:   reader # first", "USER-AGENT: harvest-robot", "  disallow :  /inbox  # mail"), "/inbox/2", False),
    # an agent line without a name is no * group
    (lines("User-agent:", "Disallow: /", "", "User-agent: *", "Allow: /"), "/page", True),
    # a directive between agent lines ends their list
    (lines("User-agent: reader", "Crawl-delay: 9", "User-agent: harvest-robot", "Disallow: /lab"), "/lab", False),
    # the longest rule decides, Allow among equals
    (lines("User-agent: *", "Disallow: /shop", "Allow: /shop/public", "Disallow: /shop/public/hidden"), "/shop/public/hidden/1", False),
    (lines("User-agent: *", "Disallow: /shop", "Allow: /shop/public", "Disallow: /shop/public/hidden"), "/shop/public/1", True),
    (lines("User-agent: *", "Disallow: /same", "Allow: /same"), "/same", True),
    # lines that say nothing
    (lines("User-agent: *", "what is this", ":", "Disallow:", "Disallow: /stop"), "/go", True),
    (lines("User-agent: *", "what is this", ":", "Disallow:", "Disallow: /stop"), "/stop", False),
    ("", "/anywhere", True),
])
def test_verdicts(spark, text, path, allowed):
    assert verdict(spark, text, path) is allowed


def test_agent_lists_are_groups(spark):
    text = lines("User-agent: reader", "Crawl-delay: 9", "User-agent: harvest-robot", "User-agent: indexer", "Disallow: /lab")
    agents, _ = R.groups(spark.createDataFrame([("site", text)], "scan_id string, body string"))
    group = {r.agent: r.group_id for r in agents.collect()}
    assert group["harvest-robot"] == group["indexer"] != group["reader"]


def test_sitemaps_keep_their_first_place(spark):
    text = lines("Sitemap: https://m.example/b.xml", "User-agent: *", "Sitemap:", "sitemap: https://m.example/a.xml", "Sitemap: https://m.example/b.xml")
    docs = spark.createDataFrame([("site", text)], "scan_id string, body string")
    assert [r.url for r in R.sitemaps(docs).orderBy("pos").collect()] == ["https://m.example/b.xml", "https://m.example/a.xml"]


def test_longest_beginning_wins_without_a_prefix_condition(spark):
    import random

    rng = random.Random(6)
    some = lambda n: "/" + "".join(rng.choice("ab/") for _ in range(rng.randrange(n)))
    files = [(f"s{k}", "User-agent: *\n" + "".join(f"{rng.choice(['Allow', 'Disallow'])}: {some(5)}\n" for _ in range(12))) for k in range(4)]
    paths = [(f"s{k % 5}", some(9)) for k in range(300)]
    docs = spark.createDataFrame(files, "scan_id string, body string")
    out = R.verdicts(spark.createDataFrame(paths, "scan_id string, path string"), docs)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "StartsWith" not in plan and "startswith" not in plan
    rules = {s: [(line.split(": ")[1], line.startswith("Allow")) for line in body.split("\n")[1:] if line] for s, body in files}
    for r in out.collect():
        fits = [(len(p), ok) for p, ok in rules.get(r.scan_id, []) if r.path.startswith(p)]
        assert r.allowed == (max(fits)[1] if fits else True)
    assert out.count() == len(paths)
