"""URL filtering by rules and, where no rule fits, by character language models.

Two variable-order Markov models over URL characters are counted from the URLs that the rules accept and
reject: contexts of two, one and no characters, each smoothed by Witten-Bell into the shorter one.  A URL's
score is the difference of its log-likelihoods per character; the threshold is calibrated on the fifth of the
rule-decided URLs (by hash) that the counts leave out, where it separates the two kinds best.

Everything is DataFrame operations.  URLs are mapped to an alphabet of ``SYMBOLS`` symbols, so that the
model is a table of SYMBOLS**3 numbers whatever the corpus, held as one array that every row looks up in:
scoring is a projection without a join or a shuffle.

Defined cases: a null URL or one without ``://`` has an empty host and path, fits no rule and is judged by its
characters (an empty one scores 0); a URL of any length is scored as a whole; characters without a symbol of their own
share symbol 0, which also stands before the beginning; without accepted or without rejected URLs to learn from all
scores are 0; a score equal to the threshold is allowed, and of equally good thresholds the one nearest to 0 is taken, as
scores beyond 4 on either side count as 4 for it; repeated rows count and give repeated results; an empty table gives an
empty result; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._scratch import written

#: The rules, as verdict and site (host and path).
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: Characters that are symbols of their own; all others are symbol 0.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0/.:-_?=&%#~"
SYMBOLS = len(ALPHABET) + 1
#: Steps of the calibration's grid of scores.
GRID = 400


def host_of(url: Column) -> Column:
    """What lies between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, in lower-case ASCII."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule whose host (or a parent domain) and path beginning fit, as struct(rule, verdict)."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, site in sorted(rules, key=lambda r: len(r[1])):  # the longest is tested first
        domain, _, rest = site.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + rest)
        out = F.when(fits, F.struct(F.lit(site).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def symbols(url: Column) -> Column:
    """The URL's characters as numbers; digits share a symbol, letters ignore case, others are 0."""
    text = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), "[0-9]", "0")
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))


def grams(text: Column) -> Column:
    """Each symbol with the two before it as one number; before the beginning lies symbol 0."""
    at = lambda i: F.coalesce(F.get(text, i), F.lit(0))
    before = lambda i, k: F.when(i >= k, at(i - k)).otherwise(0)
    return F.transform(text, lambda c, i: (before(i, F.lit(2)) * SYMBOLS + before(i, F.lit(1))) * SYMBOLS + c)


def _with_rules(pages: DataFrame, rules) -> DataFrame:
    out = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return out.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))


def log_ratios(counts: DataFrame) -> DataFrame:
    """(gram, ratio) for every gram, from (gram, good, bad) counts.

    Witten-Bell: of a context seen n times with t distinct successors the share t / (n + t) goes to the
    shorter context; no context at all is followed by every symbol alike.
    """
    full = counts.sparkSession.range(SYMBOLS**3).select(F.col("id").cast("int").alias("gram"))
    full = full.join(counts, "gram", "left").na.fill(0, ["good", "bad"])
    full = full.select("gram", "good", "bad", F.floor(F.col("gram") / SYMBOLS**2).alias("a"), F.floor(F.col("gram") / SYMBOLS % SYMBOLS).alias("b"), (F.col("gram") % SYMBOLS).alias("s"), F.lit(0).alias("any"))
    out, chance = full, {"good": F.lit(1.0 / SYMBOLS), "bad": F.lit(1.0 / SYMBOLS)}
    for level, context in enumerate((["any"], ["b"], ["a", "b"])):
        own = full.groupBy(*context, "s").agg(*[F.sum(k).alias(f"{k}{level}") for k in chance])
        seen = own.groupBy(*context).agg(*[F.sum(f"{k}{level}").alias(f"{k}_n{level}") for k in chance], *[F.count_if(F.col(f"{k}{level}") > 0).alias(f"{k}_t{level}") for k in chance])
        out = out.join(own, [*context, "s"]).join(seen, context)
        for k in chance:
            n, t = F.col(f"{k}_n{level}"), F.col(f"{k}_t{level}")
            chance[k] = F.when(n > 0, (F.col(f"{k}{level}") + t * chance[k]) / (n + t)).otherwise(chance[k])
    return out.select("gram", (F.log(chance["good"]) - F.log(chance["bad"])).alias("ratio"))


def constant(ratios: DataFrame) -> Column:
    """The ratios of all grams in millionths as an array constant (SYMBOLS**3 whole numbers, whatever the corpus)."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("gram", F.round(F.col("ratio") * 1e6).cast("int").alias("ratio")))), lambda x: x["ratio"])
    return F.from_json(F.lit(ratios.agg(F.to_json(listed)).first()[0]), "array<int>")


def score(grams_: Column, model: Column) -> Column:
    """The mean log-likelihood difference over the URL's characters; 0 for an empty URL."""
    total = F.aggregate(grams_, F.lit(0).cast("long"), lambda s, g: s + F.get(model, g))
    return F.when(F.size(grams_) > 0, total / 1e6 / F.size(grams_)).otherwise(F.lit(0.0))


def threshold(scored: DataFrame) -> DataFrame:
    """(threshold): the grid point over (score, accepted) with the best mean of the two kinds' hit rates."""
    cell = F.least(F.greatest(F.floor((F.col("score") + 4) * (GRID / 8)), F.lit(0)), F.lit(GRID)).cast("int")
    cells = scored.groupBy(cell.alias("cell")).agg(F.sum(F.col("accepted").cast("int")).alias("good"), F.sum((~F.col("accepted")).cast("int")).alias("bad"))
    cells = scored.sparkSession.range(GRID + 1).select(F.col("id").cast("int").alias("cell")).join(cells, "cell", "left").na.fill(0, ["good", "bad"])
    one = Window.partitionBy(F.lit(0))  # GRID + 1 rows
    below = one.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    hits = (F.sum("good").over(one) - F.coalesce(F.sum("good").over(below), F.lit(0))) / F.greatest(F.sum("good").over(one), F.lit(1))
    hits += F.coalesce(F.sum("bad").over(below), F.lit(0)) / F.greatest(F.sum("bad").over(one), F.lit(1))
    best = cells.select("cell", hits.alias("hits")).agg(F.max_by(F.col("cell"), F.struct(F.round("hits", 9), -F.abs(F.col("cell") - GRID // 2), F.col("cell"))).alias("cell"))
    return best.select((F.col("cell") * (8.0 / GRID) - 4).alias("threshold"))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and the method's score (null where a rule decides)."""
    found = _with_rules(pages, rules)
    known = found.filter("fit IS NOT NULL").select((F.col("fit.verdict") == "allow").alias("accepted"), (F.pmod(F.xxhash64("url"), F.lit(5)) == 0).alias("held"), grams(symbols(F.col("url"))).alias("grams"))
    flat = known.filter("NOT held").select("accepted", F.explode("grams").alias("gram"))
    counts = flat.groupBy("gram").agg(F.sum(F.col("accepted").cast("long")).alias("good"), F.sum((~F.col("accepted")).cast("long")).alias("bad"))
    model = constant(log_ratios(counts))
    cut = written(threshold(known.filter("held").select("accepted", score(F.col("grams"), model).alias("score"))), "threshold").scalar()
    own = F.when(F.col("fit").isNull(), score(grams(symbols(F.col("url"))), model))
    return found.withColumn("score", own).select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce(F.col("fit.verdict"), F.when(F.col("score") >= cut, F.lit("allow")).otherwise(F.lit("block"))).alias("verdict"), "score",
    )
