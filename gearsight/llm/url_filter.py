"""URL filter: explicit rules, else a host reputation shrunk through beta-binomial priors.

Labelled page outcomes are counted by host. A host's bad rate gets a beta prior around the rate of its registered
domain, which is shrunk to the rate of its suffix, which is shrunk to the overall rate. How strongly a level is shrunk
comes from the data: the method of moments gives the overdispersion of its groups. A host is blocked when even the
lower bound of its posterior bad rate is above ``max_bad``.

Defined results: a null url or one without ``://`` has an empty host and path and is judged as the host ''; pages with
a repeated id each count; null labels and null ids are unlabelled; without labels the overall rate is 0 and only rules
block; an empty table gives an empty result; result columns replace input columns of the same name.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gearsight.llm.common import attach, col, packed, stage, unpacked

Rule = tuple[str, str, str]
MADE = ("host", "path", "rule", "verdict")
#: Overdispersion is kept in this range: a prior worth 1 to 9,999 labelled pages.
LEAST_RHO, MOST_RHO = 0.0001, 0.5


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 1)
    return (F.translate(host, string.ascii_uppercase, string.ascii_lowercase),
            F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 2))


def rule_for(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null. Of equally long ones a block wins."""
    fits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p),
                   F.struct(F.lit(len(h + p)).alias("length"), F.lit(v).alias("verdict"), F.lit(h + p).alias("rule")))
            for h, p, v in rules]
    if not fits:
        return F.lit(None).cast("struct<length:int,verdict:string,rule:string>")
    return F.array_max(F.array_compact(F.array(*fits)))


def overdispersion(groups: DataFrame, mean: str) -> float:
    """Method of moments over groups (n, bad) around the means of their parents."""
    m, n = F.col(mean), F.col("n")
    over = F.pow(F.col("bad") - n * m, F.lit(2.0)) - n * m * (1 - m)
    top, base = groups.agg(F.sum(over), F.sum(n * (n - 1) * m * (1 - m))).first()
    rho = top / base if base else LEAST_RHO
    return round(min(MOST_RHO, max(LEAST_RHO, rho)), 6)


def shrunk(groups: DataFrame, prior: str, mean: str) -> tuple[DataFrame, float]:
    """Posterior mean of each group's bad rate, and the prior's worth in pages."""
    rho = overdispersion(groups, prior)
    worth = 1.0 / rho - 1.0
    return groups.withColumn(mean, (F.col("bad") + worth * F.col(prior)) / (F.col("n") + worth)), worth


def host_reputation(outcomes: DataFrame, z: float = 1.64) -> DataFrame:
    """``outcomes`` (host, pages, n labelled, bad) with the lower posterior bound of the bad rate, ``bad_low``.

    The registered domain is the last two labels of a host, the suffix its last one.
    """
    hosts = outcomes.withColumn("domain", F.substring_index("host", ".", -2)).withColumn(
        "suffix", F.substring_index("host", ".", -1))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    n, bad = suffixes.agg(F.sum("n"), F.sum("bad")).first()
    by_suffix, _ = shrunk(suffixes.withColumn("all_mean", F.lit(bad / n if n else 0.0)), "all_mean", "suffix_mean")
    by_domain, _ = shrunk(domains.join(by_suffix.select("suffix", "suffix_mean"), "suffix"), "suffix_mean",
                          "domain_mean")
    by_host, worth = shrunk(hosts.join(by_domain.select("domain", "domain_mean"), "domain"), "domain_mean", "mean")
    mean, size = F.col("mean"), F.col("n") + worth
    return by_host.withColumn("bad_low", mean - z * F.sqrt(mean * (1 - mean) / (size + 1)))


def filter_urls(pages: DataFrame, labels: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url",
                label_id: str = "page_id", bad_col: str = "bad", max_bad: float = 0.3, z: float = 1.64) -> DataFrame:
    """All rows of ``pages`` with host, path, rule and verdict. ``labels`` gives 0 or 1 in ``bad_col`` for some ids.

    ``rules`` is a short list and becomes part of the plan. Pages meet their host's reputation through ``attach``, so
    no host can fill a task.
    """
    host, path = host_path(col(url_col))
    ids = pages.select(col(id_col).alias("id"), host.alias("host"))
    known = labels.select(col(label_id).alias("id"), col(bad_col).cast("int").alias("bad")).dropna()
    counted = (ids.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
               .join(ids.join(known, "id").groupBy("host").agg(F.count("bad").alias("n"), F.sum("bad").alias("bad")),
                     "host", "left").fillna(0, ["n", "bad"]))
    outcomes = stage(counted, "hosts")
    total = outcomes.agg(F.sum("pages")).first()[0] or 0
    reputation = stage(host_reputation(outcomes, z).select("host", "pages", "bad_low"), "reputation")
    rows = packed(pages, host=host, path=path)
    spread = F.concat(F.lit("/"), F.xxhash64("path", F.monotonically_increasing_id()).cast("string"))
    judged = attach(rows, reputation, "host", "pages", total, spread)
    judged = judged.withColumn("fit", rule_for(F.col("host"), F.col("path"), rules))
    own = F.when(F.col("bad_low") > max_bad, "block").otherwise("allow")
    judged = judged.withColumn("rule", F.col("fit.rule")).withColumn("verdict", F.coalesce("fit.verdict", own))
    return unpacked(judged, pages.columns, *MADE)
