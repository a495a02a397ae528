"""robots.txt over a table of documents (ROB-1..ROB-7).

Tokenising is a narrow ``posexplode``; grouping is sessionisation by
windows partitioned by document (a robots file is bounded in size, so one
window partition never holds more than one file's lines); the path verdict
is an equi-join on ``(scan_id, beginning of the path)``, so AQE can split a
site that owns most pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# User agent the crawler announces (fixed value).
DEFAULT_USER_AGENT = "markup-probe"


def _js_trim(col):
    return F.regexp_replace(col, "^\\s+|\\s+$", "")


def tokenize(docs: DataFrame) -> DataFrame:
    """ROB-1: one row per line: scan_id, pos, kind (blank/ua/dir/sitemap/other), key, value."""
    lines = docs.select("scan_id", F.posexplode(F.split(F.coalesce("body", F.lit("")), "\r?\n"))
                        .alias("pos", "raw"))
    line = _js_trim(F.substring_index("raw", "#", 1))
    has_sep = F.instr(line, ":") > 0
    key = F.lower(_js_trim(F.substring_index(line, ":", 1)))
    value = _js_trim(F.regexp_extract(line, "^[^:]*:(.*)$", 1))
    kind = (F.when(line == "", "blank").when(~has_sep, "other").when(key == "sitemap", "sitemap")
            .when(key == "user-agent", "ua").otherwise("dir"))
    return lines.select("scan_id", "pos", kind.alias("kind"), F.when(has_sep, key).alias("key"),
                        F.when(has_sep, value).alias("value"))


def groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ROB-2: (agents, rules).

    A user-agent line starts a group unless the previous relevant line was
    also a user-agent line; a blank (or comment-only) line ends the group; a
    directive belongs to the open group, if any.
    agents: scan_id, group_id, agent (lower-case, non-empty).
    rules: scan_id, group_id, pos, path, allowed.
    """
    tok = tokenize(docs).filter(F.col("kind").isin("blank", "ua", "dir"))
    w = Window.partitionBy("scan_id").orderBy("pos")
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    g = tok.withColumn("start", (F.col("kind") == "ua") & (F.coalesce(F.lag("kind").over(w), F.lit("blank")) != "ua"))
    g = (g.withColumn("group_id", F.sum(F.col("start").cast("int")).over(run))
         .withColumn("last_start", F.max(F.when(F.col("start"), F.col("pos"))).over(run))
         .withColumn("last_blank", F.max(F.when(F.col("kind") == "blank", F.col("pos"))).over(run)))
    in_group = F.col("last_start").isNotNull() & (F.col("last_start") > F.coalesce("last_blank", F.lit(-1)))
    agents = g.filter((F.col("kind") == "ua") & (F.col("value") != "")).select(
        "scan_id", "group_id", F.lower("value").alias("agent"))
    rules = g.filter((F.col("kind") == "dir") & F.col("key").isin("allow", "disallow") & (F.col("value") != "")
                     & in_group).select("scan_id", "group_id", "pos", F.col("value").alias("path"),
                                        (F.col("key") == "allow").alias("allowed"))
    return agents, rules


def sitemaps(docs: DataFrame) -> DataFrame:
    """ROB-3: non-empty Sitemap directives, first-seen order, de-duplicated."""
    tok = tokenize(docs).filter((F.col("kind") == "sitemap") & (F.col("value") != ""))
    return tok.groupBy("scan_id", F.col("value").alias("url")).agg(F.min("pos").alias("pos"))


def effective_rules(docs: DataFrame, user_agent: str = DEFAULT_USER_AGENT) -> DataFrame:
    """ROB-4: rules that apply to ``user_agent`` per scan.

    Agents contained in the user agent compete by length; every group holding
    an agent of the winning length is merged; with no match, all ``*`` groups
    apply.
    """
    ua = user_agent.lower()
    agents, rules = groups(docs)
    specific = agents.filter((F.col("agent") != "*") & F.lit(ua).contains(F.col("agent")))
    best = specific.groupBy("scan_id").agg(F.max(F.length("agent")).alias("best_len"))
    chosen = (specific.join(best, "scan_id").filter(F.length("agent") == F.col("best_len"))
              .select("scan_id", "group_id").distinct())
    star = agents.filter(F.col("agent") == "*").select("scan_id", "group_id").distinct() \
        .join(best.select("scan_id"), "scan_id", "left_anti")
    return rules.join(chosen.unionByName(star), ["scan_id", "group_id"], "left_semi")


def verdicts(targets: DataFrame, docs: DataFrame, path_col: str = "path",
             user_agent: str = DEFAULT_USER_AGENT) -> DataFrame:
    """ROB-5 / ROB-6: add ``allowed`` to ``targets`` (scan_id, path_col, ...).

    Literal prefix match on the path, longest rule wins, equal length -> allow,
    no rule (or no robots document) -> allowed.

    Every path is taken apart into its beginnings of the lengths that rules of
    its scan have, and these meet the rules as equal keys: work grows with the
    lengths that occur, not with rules times paths.
    """
    rules = effective_rules(docs, user_agent).groupBy("scan_id", F.col("path").alias("_begin")).agg(F.max("allowed").alias("_allow"))
    lengths = rules.groupBy("scan_id").agg(F.collect_set(F.length("_begin")).alias("_lengths"))
    path = F.col(path_col)
    keyed = targets.withColumn("_tid", F.sha2(F.concat_ws("|", "scan_id", path_col), 256))
    begins = (keyed.select("_tid", "scan_id", path.alias("_p")).distinct().join(lengths, "scan_id")
              .withColumn("_n", F.explode("_lengths")).filter(F.length("_p") >= F.col("_n"))
              .select("_tid", "scan_id", "_n", F.substring("_p", F.lit(1), F.col("_n")).alias("_begin")))
    hits = begins.join(rules, ["scan_id", "_begin"]).groupBy("_tid").agg(F.max_by("_allow", "_n").alias("_allowed"))
    return keyed.join(hits, "_tid", "left").withColumn("allowed", F.coalesce("_allowed", F.lit(True))) \
        .drop("_tid", "_allowed")


MSG_BLOCKED = "Blocked by robots.txt"


def split_blocked(requests: DataFrame, docs: DataFrame, scans: DataFrame, user_agent: str = DEFAULT_USER_AGENT) -> tuple[DataFrame, DataFrame]:
    """ROB-7: (requests to fetch, requests that the robots file of a scan that
    respects it forbids)."""
    from crawlscope.functions import urls as FU

    asked = FU.with_url(requests, "url", "_u").withColumn("_path", F.col("_u.path")).drop("_u")
    judged = verdicts(asked, docs, "_path", user_agent).drop("_path").join(scans.select("scan_id", "respect_robots"), "scan_id", "left")
    forbidden = F.coalesce(F.col("respect_robots"), F.lit(True)) & ~F.col("allowed")
    judged = judged.withColumn("_forbidden", forbidden).drop("allowed", "respect_robots")
    return judged.filter(~F.col("_forbidden")).drop("_forbidden"), judged.filter("_forbidden").drop("_forbidden")
