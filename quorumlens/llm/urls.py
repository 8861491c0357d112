"""URL filter: host and path rules first, a character language-model ratio for the rest.

Two smoothed variable-order Markov models, of accepted and of rejected URLs, are counted
over all labelled URLs. What is counted is a table of the n-grams of real characters, up to
``ORDER`` of them, that grows with the URLs; each character counts by its longest n-gram that
was seen. A URL is judged by the difference of its log-likelihoods per character, against a
threshold: one fold of the labelled URLs is scored with counts that leave it out, and the
value that parts its two classes best is taken. Everything is DataFrame functions.

Equal URLs are counted and scored once, with their number as weight. Scoring joins the n-grams
of all distinct URLs to the model on the n-gram and sums by URL; n-grams that start most URLs
are hot keys of that join, whose other side has one row for each, so Spark splits them.

Defined results: a null URL, or one without ``://``, has empty host and path, matches no
rule, and is scored as the text it is; null and empty URLs score 0; very long URLs are scored
whole; with no labelled URL of both classes every URL that no rule decides is allowed, and
where the fold lacks a class all labelled URLs set the threshold; repeated rows are each
judged; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpoint, write_shared

LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Characters of an n-gram at most: a context of up to five and the character after it.
ORDER = 6
#: A context of fewer sightings is not used by itself; its shorter form is.
LEAST = 4
#: Stands before a URL's first character; characters that were never seen have a share of one in ``SYMBOLS``.
START, SYMBOLS = "\x01", 256
#: Characters of a URL that are cut into n-grams at a time.
CHUNK = 1000
#: Grid on which the threshold is calibrated: scores from -REACH to REACH.
BINS, REACH = 2000, 5.0
#: One labelled URL in so many is the fold that the threshold is set on.
HOLD = 4


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), LETTERS.upper(), LETTERS)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its action. ``rules``: (action, host and path prefix).

    A rule fits its host and all subdomains whose path starts with the rule's. Longest first,
    so the first that fits decides; the list is the caller's parameter, not data.
    """
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, tail = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + tail)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        action = F.when(fits, F.lit(act)).otherwise(action)
    return rule, action


def merged(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """A join without a broadcast chosen by an estimate.

    Spark guesses a table's size from its compressed files, does not see that n-grams are some
    hundred times as large, and keeps to a broadcast that it began with: all of them would pass
    through the driver wherever the files are under ``spark.sql.autoBroadcastJoinThreshold``.
    """
    return left.join(right.hint("merge"), on, how)


def grams(rows: DataFrame, *keep: str) -> DataFrame:
    """(keep..., g): for each character of ``url`` the n-gram that ends at it.

    A URL is cut into chunks first: finding a place in a string takes a walk from its start.
    """
    size = F.length("url")
    rows = rows.where(size > 0).select(*keep, F.concat(F.lit(START * (ORDER - 1)), "url").alias("__u"), size.alias("__n"), F.explode(F.sequence(F.lit(0), F.floor((size - 1) / CHUNK).cast("int"))).alias("__c"))
    rows = rows.select(*keep, F.substring("__u", F.col("__c") * CHUNK + 1, F.lit(CHUNK + ORDER - 1)).alias("__u"), F.least(F.lit(CHUNK), F.col("__n") - F.col("__c") * CHUNK).alias("__n"))
    rows = rows.select(*keep, "__u", F.explode(F.sequence(F.lit(1), F.col("__n"))).alias("__i"))
    return rows.select(*keep, F.substring("__u", F.col("__i"), F.lit(ORDER)).alias("g"))


def counts(known: DataFrame) -> DataFrame:
    """(g, n0, n1, h0, h1): sightings in accepted and rejected URLs of (url, n0, n1, fold), and those outside fold 0."""
    outside = lambda n: F.sum(F.when(F.col("fold") > 0, F.col(n)).otherwise(0))
    return grams(known, "n0", "n1", "fold").groupBy("g").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), outside("n0").alias("h0"), outside("n1").alias("h1"))


def model(full: DataFrame) -> list[DataFrame]:
    """For each length (g, r, h): the log ratio of the two models' probabilities of an n-gram's last character.

    ``r`` is by all URLs, ``h`` by those outside fold 0 (null where it was not seen there). Each
    length is smoothed towards the shorter context in proportion to the number of different
    characters seen after it; contexts seen fewer than ``LEAST`` times give way to the shorter
    one, which makes the order vary. Counts are summed from the longest down.
    """
    levels = [full]
    for k in range(ORDER - 1, 0, -1):
        levels.append(levels[-1].groupBy(F.substring("g", 2, k).alias("g")).agg(*[F.sum(n).alias(n) for n in ("n0", "n1", "h0", "h1")]))
    out: list[DataFrame] = []
    below = None
    for k, level in enumerate(reversed(levels), 1):
        w = Window.partitionBy(F.substring("g", 1, k - 1))
        names = ("n0", "n1", "h0", "h1")
        rows = level.select("*", *[F.sum(n).over(w).alias(f"t{n}") for n in names], *[F.greatest(F.count_if(F.col(n) > 0).over(w), F.lit(1)).alias(f"d{n}") for n in names])
        if below is None:
            rows = rows.withColumns({f"b{n}": F.lit(1.0 / SYMBOLS) for n in names})
        else:
            rows = merged(rows.withColumn("s", F.substring("g", 2, k - 1)), below.select(F.col("g").alias("s"), *[F.col(f"p{n}").alias(f"b{n}") for n in names]), "s")
        smooth = lambda n, both: F.when(both < LEAST, F.col(f"b{n}")).otherwise((F.col(n) + F.col(f"d{n}") * F.col(f"b{n}")) / (F.col(f"t{n}") + F.col(f"d{n}")))
        p = {n: smooth(n, F.col(f"t{n[0]}0") + F.col(f"t{n[0]}1")) for n in names}
        below = checkpoint(rows.select("g", "h0", "h1", *[c.alias(f"p{n}") for n, c in p.items()]))
        out.append(below.select("g", F.log(F.col("pn0") / F.col("pn1")).alias("r"), F.when(F.col("h0") + F.col("h1") > 0, F.log(F.col("ph0") / F.col("ph1"))).alias("h")))
    return out


def with_score(urls: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(uid, score, held): log-likelihood differences per character of (uid, url), accepted over rejected, by ``r`` and by ``h``."""
    each = grams(urls, "uid")
    found = each.select("g").distinct()
    for k, level in zip(range(ORDER, 0, -1), reversed(levels), strict=True):
        found = found.withColumn("s", F.substring("g", ORDER - k + 1, k)).join(level.select(F.col("g").alias("s"), F.col("r").alias(f"r{k}"), F.col("h").alias(f"h{k}")), "s", "left").drop("s")
    best = lambda c: F.coalesce(*[F.col(f"{c}{k}") for k in range(ORDER, 0, -1)], F.lit(0.0)).alias(c)
    return merged(each, found.select("g", best("r"), best("h")), "g").groupBy("uid").agg(F.avg("r").alias("score"), F.avg("h").alias("held"))


def threshold(scored: DataFrame) -> float | None:
    """The score that best parts (score, n0, n1): the mean of both classes' hit rates is highest.

    Scores are counted on a fixed grid, so one row a bin is all that is ordered. None without both classes.
    """
    at = F.floor((F.least(F.greatest(F.col("score"), F.lit(-REACH)), F.lit(REACH - 1e-9)) + REACH) / (2 * REACH) * BINS)
    rows = scored.groupBy(at.alias("bin")).agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).orderBy("bin").collect()  # BINS rows at most
    all1, all0 = sum(r["n1"] for r in rows), sum(r["n0"] for r in rows)
    if not all1 or not all0:
        return None
    best, cut, below1, below0, last = -1.0, 0.0, 0, 0, None
    for r in rows:
        gain = below1 / all1 + 1 - below0 / all0
        if gain > best + 1e-12:  # half way through the empty bins before, so that neither kind is cut close
            best, cut = gain, r["bin"] if last is None else (last + 1 + r["bin"]) / 2
        below1, below0, last = below1 + r["n1"], below0 + r["n0"], r["bin"]
    return cut / BINS * 2 * REACH - REACH


def judge(pages: DataFrame, rules: list[tuple[str, str]], labelled: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row of (page_id, url).

    ``labelled`` (url, rejected) are URLs whose class is known; by default those that a rule decides.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("action", action)
    known = labelled if labelled is not None else rows.where(F.col("action").isNotNull()).select("url", (F.col("action") == "block").alias("rejected"))
    known = known.where(F.col("url").isNotNull() & F.col("rejected").isNotNull()).groupBy("url").agg(F.count_if(~F.col("rejected")).alias("n0"), F.count_if("rejected").alias("n1"))
    known = write_shared(known.withColumn("fold", F.pmod(F.xxhash64("url"), F.lit(HOLD)).cast("int")), "known")
    levels = model(checkpoint(counts(known)))
    urls = rows.select("url").unionByName(known.select("url")).where(F.length("url") > 0).distinct()
    urls = write_shared(urls.withColumn("uid", F.monotonically_increasing_id()), "urls")  # written, so the numbers stay
    scored = write_shared(merged(urls, with_score(urls, levels), "uid").select("url", "score", "held"), "scores")
    told = merged(known, scored, "url").select("fold", "n0", "n1", F.col("held").alias("score"))
    cut = threshold(told.where("fold = 0"))
    cut = threshold(told) if cut is None else cut
    value = F.coalesce("score", F.lit(0.0))
    learned = F.lit("allow") if cut is None else F.when(value < cut, F.lit("block")).otherwise(F.lit("allow"))
    return merged(rows, scored.select("url", "score"), "url", "left").select("page_id", "host", "path", "rule", F.coalesce("action", learned).alias("verdict"), value.alias("score"))
