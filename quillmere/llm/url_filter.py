"""URL filters: rules by host and path, and empirical-Bayes host reputation for what no rule fits."""

from __future__ import annotations

import functools
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.llm.common import ascii_lower, materialize

#: A page is blocked where its host's bad rate exceeds BAD_RATE even at the lower posterior bound, Z standard deviations down.
BAD_RATE, Z = 0.25, 1.0
#: The rate that the whole corpus is shrunk to, and the outcomes that it counts for.
BASE_RATE, BASE_SIZE = 0.1, 8.0
#: Strength of a level's prior where the data don't tell, and its limits where they do; below 2 a rate would be taken for all good or all bad.
UNKNOWN, WEAKEST, STRONGEST = 2.0, 2.0, 10_000.0
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: The suffix that all IP addresses share; no name can have it.
IP = "[ip]"
IPV4, IPV6 = r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$", r"^\["


def parts(pages: DataFrame) -> DataFrame:
    """pages with host and path. A url that is null or has no :// gives empty ones."""
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.substring(F.col("url"), at + 3, F.length("url"))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return pages.withColumns({"host": host, "path": path})


@functools.cache
def public_suffixes() -> list[tuple[str, int, int, int, bool]]:
    """Keys of the bundled suffixes of two or more labels, in letters of their own and in Punycode, with their number of
    labels, how many labels the suffix has of a host that is the key and of one that ends with it after a dot, and
    whether it is an exception. A wildcard's key is what follows the star."""
    lines = (Path(__file__).parent / "public_suffixes.txt").read_text(encoding="utf-8").splitlines()
    rules = [x for x in lines if x and not x.startswith("//")]
    wild, no = ({x[skip:] for x in rules if x[0] == sign} for sign, skip in (("*", 2), ("!", 1)))
    plain = {x for x in rules if x[0] not in "*!"}
    found = {}
    for key in plain | wild | no:
        n = key.count(".") + 1
        row = (n, n - 1, n - 1, True) if key in no else (n, n if key in plain else 0, n + 1 if key in wild else n, False)
        found |= {key: row, key.encode("idna").decode(): row}
    return [(k, *row) for k, row in sorted(found.items())]


def with_domain(hosts: DataFrame) -> DataFrame:
    """hosts (host) with domain and suffix. Of a name these are the longest public suffix that fits and that with one
    label before it; the last label is a suffix by itself, and a name that is a suffix is its own domain. User names,
    ports and a last dot don't count. An IP address is its own domain, under a suffix of all such."""
    listed = public_suffixes()
    name = F.regexp_replace(F.regexp_replace("host", r"^.*@", ""), r":[0-9]*$", "")
    h = hosts.withColumn("_name", name).withColumn("_ip", F.col("_name").rlike(IPV4) | F.col("_name").rlike(IPV6))
    h = h.withColumn("_name", F.when(F.col("_ip"), F.col("_name")).otherwise(F.regexp_replace("_name", r"\.$", "")))
    size = F.size(F.split("_name", r"\."))
    takes, fixed = [F.lit(1)], []
    for n in sorted({row[1] for row in listed}):
        columns = zip(*[(k, own, below, no) for k, of, own, below, no in listed if of == n])
        rules = hosts.sparkSession.createDataFrame(pa.Table.from_pydict(dict(zip((f"_key{n}", f"_own{n}", f"_below{n}", f"_no{n}"), map(list, columns)))))
        h = h.join(F.broadcast(rules), F.substring_index("_name", ".", -n) == F.col(f"_key{n}"), "left")  # rules: the bundled list
        takes.append(F.when(size > n, F.col(f"_below{n}")).otherwise(F.col(f"_own{n}")))
        fixed.append(F.when(F.col(f"_no{n}"), n - 1))
    labels = F.coalesce(*fixed, F.greatest(*takes))
    h = h.withColumn("_labels", labels)
    domain = F.when(F.col("_ip"), F.col("_name")).otherwise(F.expr("substring_index(_name, '.', -(_labels + 1))"))
    suffix = F.when(F.col("_ip"), F.lit(IP)).otherwise(F.expr("substring_index(_name, '.', -_labels)"))
    return h.select(*hosts.columns, domain.alias("domain"), suffix.alias("suffix"))


def ruled(df: DataFrame, rules=RULES) -> DataFrame:
    """df (host, path) with rule and rule_verdict: the longest fitting rule's, null where none fits; of equal lengths block wins."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "block", r)):
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit(f".{host}"))) & F.startswith(F.col("path"), F.lit(path))
        name, verdict = F.when(fits, F.lit(host + path)).otherwise(name), F.when(fits, F.lit(act)).otherwise(verdict)
    return df.withColumns({"rule": name, "rule_verdict": verdict})


def strength(units: DataFrame, groups: list[str], name: str) -> DataFrame:
    """One row: the strength of the beta prior that units (n outcomes, x of them bad) of one group share, by the method of
    moments. The units' rates vary about their group's by chance alone as w / n, and by w / (strength + 1) besides; where no
    unit tells the two apart, or no outcome differs from its group's, the strength is UNKNOWN."""
    g = units.where("n > 0").groupBy(*groups).agg(F.sum("n").alias("g_n"), F.sum("x").alias("g_x"), F.sum(F.col("n") * F.col("n")).alias("g_nn"), F.sum(F.col("x") * F.col("x") / F.col("n")).alias("g_xx"), F.count("*").alias("k"))
    square = F.col("g_x") * F.col("g_x") / F.col("g_n")
    sums = g.agg(F.sum(F.col("g_xx") - square).alias("s"), F.sum(F.col("g_x") - square).alias("w"), F.sum("g_n").alias("n"), F.sum(F.col("g_n") - F.col("g_nn") / F.col("g_n")).alias("c"), F.sum(F.col("k") - 1).cast("double").alias("free"))
    w, more = F.col("w") / F.col("n"), F.col("c") - F.col("free")
    beyond = (F.col("s") - w * F.col("free")) / more
    told = F.when(beyond <= w / (STRONGEST + 1), STRONGEST).otherwise(F.greatest(w / beyond - 1, F.lit(WEAKEST)))
    return sums.select(F.when((w > 1e-9) & (more > 1e-9), told).otherwise(F.lit(UNKNOWN)).alias(name))


def widened(k: str) -> list:
    """n and x of a unit as evidence of its group's rate: many outcomes of one unit are worth k + 1 of different ones at most."""
    n = F.when(F.col("n") > 0, F.col("n") * (F.col(k) + 1) / (F.col("n") + F.col(k))).otherwise(0.0)
    return [F.sum(n).alias("n"), F.sum(F.when(F.col("n") > 0, n * F.col("x") / F.col("n")).otherwise(0.0)).alias("x")]


def shrunk(df: DataFrame, k: str) -> DataFrame:
    """df (mean, var of the wider level's rate) with mean and var of its own: the prior has that mean, and both the variance
    among units and that of the mean itself; outcomes n and x then count as in a beta distribution of those moments."""
    m, v = F.col("mean"), F.col("var")
    total = (m * (1 - m) - v) / (F.col(k) + 1) + v
    df = df.withColumn("_size", m * (1 - m) / total - 1)
    df = df.withColumn("prior", m).withColumn("mean", (F.col("x") + F.col("_size") * m) / (F.col("n") + F.col("_size")))
    return df.withColumn("var", F.col("mean") * (1 - F.col("mean")) / (F.col("n") + F.col("_size") + 1)).drop("_size")


def reputations(outcomes: DataFrame, bad_rate: float = BAD_RATE, z: float = Z) -> DataFrame:
    """host, n, bad, prior, mean, bound, host_verdict from outcomes (host, bad 0/1 or null where a page is not labelled).

    Rates of hosts vary about their registered domain's, those of domains about their suffix's and those of suffixes about
    the whole's, each level by a beta distribution whose strength the counts tell. Upwards, a unit's outcomes count
    as many as they tell of its group; downwards, a rate is shrunk to the wider level's, whose own uncertainty it takes
    over, so that a host without a label is blocked only where many others of its domain or suffix leave no doubt.
    Every step groups counts of hosts, not pages; a level's strength and the whole's rate are one row."""
    counts = outcomes.groupBy("host").agg(F.count("bad").cast("double").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("x"))
    hosts = materialize(with_domain(counts), "hosts")
    k_host = strength(hosts, ["suffix", "domain"], "k_host")
    domains = hosts.join(F.broadcast(k_host)).groupBy("suffix", "domain").agg(*widened("k_host"))
    domains = materialize(domains, "domains")
    k_domain = strength(domains, ["suffix"], "k_domain")
    suffixes = materialize(domains.join(F.broadcast(k_domain)).groupBy("suffix").agg(*widened("k_domain")), "suffixes")
    k_suffix = strength(suffixes, [], "k_suffix")
    whole = suffixes.join(F.broadcast(k_suffix)).agg(*widened("k_suffix"))
    whole = whole.select(((F.coalesce("x", F.lit(0.0)) + BASE_SIZE * BASE_RATE) / (F.coalesce("n", F.lit(0.0)) + BASE_SIZE)).alias("mean"), F.coalesce("n", F.lit(0.0)).alias("w_n"))
    whole = whole.select("mean", (F.col("mean") * (1 - F.col("mean")) / (F.col("w_n") + BASE_SIZE + 1)).alias("var"))
    told = shrunk(suffixes.join(F.broadcast(whole)).join(F.broadcast(k_suffix)), "k_suffix").select("suffix", "mean", "var")
    told = shrunk(domains.join(told, "suffix").join(F.broadcast(k_domain)), "k_domain").select("suffix", "domain", "mean", "var")
    out = shrunk(hosts.join(told, ["suffix", "domain"]).join(F.broadcast(k_host)), "k_host")
    out = out.withColumn("bound", F.col("mean") - z * F.sqrt("var"))
    return out.select("host", F.col("n").cast("long").alias("n"), F.col("x").cast("long").alias("bad"), "prior", "mean", "bound", F.when(F.col("bound") > bad_rate, "block").otherwise("allow").alias("host_verdict"))


def filtered(pages: DataFrame, outcomes: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages (page_id, url).

    outcomes (page_id, bad) may repeat a page: its worst counts. Rows without a url, repeated page_ids and pages
    without an outcome are all judged; an empty table gives no rows. A host may hold any share of the pages: counts
    are summed before they are shuffled, and the join back is one that Spark splits by size. Urls of any length are
    cut where they lie; ports and user names stay part of host, and don't count for its domain."""
    worst = outcomes.groupBy(F.col("page_id").alias("o_id")).agg(F.max("bad").alias("bad"))
    cut = parts(pages.select("page_id", "url")).drop("url")
    seen = cut.join(worst, cut.page_id == worst.o_id, "left").select("host", "bad")
    fame = materialize(reputations(seen).select(F.col("host").alias("h"), "host_verdict"), "fame")
    judged = ruled(cut, rules).join(fame, F.col("host") == F.col("h"), "left")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", "host_verdict").alias("verdict"))
