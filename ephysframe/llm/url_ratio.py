"""URL filter by a character language-model ratio.

Two smoothed variable-order Markov models, one of accepted and one of
rejected URLs, give each URL the difference of its log-likelihoods divided by
its length; URLs below a threshold calibrated on the known URLs are blocked.
Known URLs are those that a host and path rule decides; for the calibration
each half of them is scored by models of the other half.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Longest context in characters.
ORDER = 4
#: Probability below all contexts: one of so many characters.
ALPHABET = 256
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PAD = "\u0002"


@dataclass(frozen=True)
class UrlRule:
    action: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the registered query.
RULES = (
    UrlRule("block", "net", "/"),
    UrlRule("allow", "example.net", "/en/"),
    UrlRule("block", "example.com", "/de/"),
    UrlRule("allow", "org", "/fr/"),
)
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def spelling_of(url: Column, host: Column) -> Column:
    """The whole URL, its host in lower case; one without ``://`` as it is, null as empty."""
    begin, end = (F.regexp_extract(url, r"(?s)^(.*?://)[^/?#]*(.*)$", k) for k in (1, 2))
    return F.coalesce(F.when(F.contains(url, F.lit("://")), F.concat(begin, host, end)).otherwise(url), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[UrlRule, ...]) -> Column:
    """The longest rule that fits a host (or a parent domain of it) and a path prefix."""
    out = F.lit(None).cast("struct<text:string,action:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("text"), F.lit(r.action).alias("action"))).otherwise(out)
    return out


def grams(spelling: Column) -> Column:
    """Every character with the ORDER characters before it, the start padded."""
    padded = F.concat(F.lit(PAD * ORDER), spelling)
    return F.transform(F.sequence(F.lit(1), F.char_length(spelling)), lambda i: F.substring(padded, i, F.lit(ORDER + 1)))


#: Counts of a gram: in accepted and rejected spellings, in all of them and in those of each half.
COUNTS = {"": ("acc", "rej"), "0": ("acc0", "rej0"), "1": ("acc1", "rej1")}


def ratio_model(counts: DataFrame) -> DataFrame:
    """``(gram, llr, llr0, llr1)`` from the ``COUNTS`` of each gram: log-probability of the last character given the others, accepted less rejected.

    Witten-Bell: a context seen N times with T different next characters
    gives its counts N / (N + T) of the weight and the next shorter context
    T / (N + T); a context never seen passes all weight on.
    """
    names = [c for pair in COUNTS.values() for c in pair]
    out = counts.select("gram", *[F.lit(1.0 / ALPHABET).alias(f"p_{c}") for c in names])
    for k in range(ORDER + 1):
        seen = counts.groupBy(F.substring("gram", ORDER + 1 - k, k + 1).alias("g")).agg(*[F.sum(c).alias(f"c_{c}") for c in names])
        context = seen.groupBy(F.substring("g", 1, k).alias("c")).agg(
            *[F.sum(f"c_{c}").alias(f"n_{c}") for c in names], *[F.sum((F.col(f"c_{c}") > 0).cast("long")).alias(f"t_{c}") for c in names])
        level = seen.join(context, F.substring("g", 1, k) == F.col("c")).drop("c")
        out = out.join(level, F.substring("gram", ORDER + 1 - k, k + 1) == F.col("g"))
        mixed = lambda c: (F.col(f"c_{c}") + F.col(f"t_{c}") * F.col(f"p_{c}")) / (F.col(f"n_{c}") + F.col(f"t_{c}"))
        out = out.select("gram", *[F.when(F.col(f"n_{c}") > 0, mixed(c)).otherwise(F.col(f"p_{c}")).alias(f"p_{c}") for c in names])
    return out.select("gram", *[(F.ln(f"p_{a}") - F.ln(f"p_{r}")).alias(f"llr{h}") for h, (a, r) in COUNTS.items()])


def judge(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """``(page_id, host, path, rule, verdict, score)``, a row for each row of ``pages``.

    Host and path serve the rules; the models read the whole URL, query and
    fragment too. A null URL, and one without ``://``, has an empty host and
    path; null and empty URLs score 0. Equal URLs, of repeated rows too, share
    a score, and each counts as often as it occurs. The score is the mean
    log-likelihood difference a character. The threshold lies between the two
    known classes, as many of each one's standard deviations from its mean as
    of the other's, by scores of models that have not counted the URL; with
    no known URL of one class every other URL is allowed.
    """
    address = F.col(url).cast("string")
    parts = pages.select(F.col(page_id).alias("page_id"), host_of(address).alias("host"), path_of(address).alias("path"), address.alias("__url"))
    parts = parts.withColumn("__rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("spelling", spelling_of(F.col("__url"), F.col("host")))
    parts = parts.select("page_id", "host", "path", "spelling", F.col("__rule.text").alias("rule"), F.col("__rule.action").alias("action"))
    # equal spellings are counted and scored once
    spelled = parts.groupBy("spelling", "action").agg(F.count(F.lit(1)).alias("n"))
    half = F.conv(F.substring(F.md5("spelling"), 1, 1), 16, 10).cast("int") % 2
    spelled = materialise(spelled.withColumn("half", half).withColumn("key", F.monotonically_increasing_id()), "url-spellings")
    per = spelled.where(F.char_length("spelling") > 0).select("key", "n", "action", "half", F.explode(grams(F.col("spelling"))).alias("gram"))

    def weight(action: str, part: str):
        own = (F.col("action") == action) if not part else (F.col("action") == action) & (F.col("half") == int(part))
        return F.sum(F.when(own, F.col("n")).otherwise(F.lit(0)))

    sums = [weight(action, part).alias(c) for part, pair in COUNTS.items() for action, c in zip(("allow", "block"), pair)]
    counts = materialise(per.groupBy("gram").agg(*sums), "url-grams")
    model = materialise(ratio_model(counts), "url-model")
    unseen = F.when(F.col("half") == 0, F.col("llr1")).otherwise(F.col("llr0"))
    scores = per.join(model, "gram").groupBy("key").agg(F.avg("llr").alias("score"), F.avg(unseen).alias("unseen"))
    zero = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("score", "unseen")}
    scored = materialise(spelled.join(scores, "key", "left").withColumns(zero), "url-scores")
    cut = threshold(scored)
    method = F.lit("allow") if cut is None else F.when(F.col("score") >= F.lit(cut), F.lit("allow")).otherwise(F.lit("block"))
    judged = scored.select("spelling", method.alias("__method"), "score")
    return (parts.join(judged, "spelling")
            .select("page_id", "host", "path", "rule", F.coalesce("action", "__method").alias("verdict"), "score"))


def threshold(scored: DataFrame) -> float | None:
    """The calibrated cut, from one row of sums."""
    x, n = F.col("unseen"), F.col("n")
    sums = []
    for a in ("allow", "block"):
        own = F.col("action") == a
        sums += [F.sum(F.when(own, n)).alias(f"{a}_n"), F.sum(F.when(own, n * x)).alias(f"{a}_1"), F.sum(F.when(own, n * x * x)).alias(f"{a}_2")]
    row = scored.agg(*sums).first()
    if not row["allow_n"] or not row["block_n"]:
        return None
    mean, sd = {}, {}
    for a in ("allow", "block"):
        mean[a] = row[f"{a}_1"] / row[f"{a}_n"]
        sd[a] = max(row[f"{a}_2"] / row[f"{a}_n"] - mean[a] ** 2, 0.0) ** 0.5
    both = sd["allow"] + sd["block"]
    return (mean["allow"] + mean["block"]) / 2 if both == 0 else (mean["allow"] * sd["block"] + mean["block"] * sd["allow"]) / both
