"""URL filter: allow and block rules, then gradient-boosted trees on lexical features.

DataFrame and SQL functions and Spark ML only.  A rule is ``host/path``: it
fits its host and all subdomains if the url's path starts with the rule's
path; the longest rule that fits decides.  Urls that no rule fits are judged
by gradient-boosted trees over lexical features: lengths, depth, digit ratio,
character entropy, parameter counts, and suffix statistics: how often labelled
urls of the same registered domain (last two host labels) are blocked, and the
mean of that over the domains of the same last label, both smoothed.

Learning uses labelled urls ``(url, block)``: at most ``sample`` distinct ones,
half of it for each class, those with the smallest hash, weighted back to the
classes' true shares.  ``rule_labels`` makes such labels from the rules.
The trees learn from suffix statistics without the url's own domain (by folds
of registered domains), so a suffix weighs only as much as it says of domains
not seen before; a label that a rule hangs on one domain teaches nothing of its
suffix.  Statistics are kept of all suffixes: the ``suffixes`` most frequent
are broadcast, rows with another suffix meet the rest by a shuffle join.

Defined cases.  A null url, or one without ``://``, has an empty host and path
and fits no rule.  An empty path starts with no rule's ``/``.  Without labelled
urls of both classes the only class seen decides, ``allow`` without any.  Rows
are judged one by one; other columns are carried as they are (but ``host, path,
rule, verdict, block_score``, which are the answer's).
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NAMES = ["n_url", "n_host", "n_path", "depth", "labels", "digits", "hyphens", "entropy", "params", "n_query",
         "fragment", "suffix1", "suffix2"]
SALTS = 16            # a suffix past the frequent ones is dealt over so many keys
FOLDS = 5             # parts of the registered domains
PRIOR = 10.0          # labelled urls that the overall share stands for in a suffix's statistic


def after_scheme(url):
    """What follows the first ``://``, or null."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, 1 << 30))


def host(url):
    return F.translate(F.coalesce(F.regexp_extract(after_scheme(url), r"^([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url):
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host_, path_, rules: list[tuple[str, str]]):
    """The longest rule that fits, as a struct (rule, verdict), or null."""
    out = None
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        name, _, rest = rule.partition("/")
        fits = ((host_ == name) | host_.endswith("." + name)) & path_.startswith("/" + rest)
        hit = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, hit) if out is None else out.when(fits, hit)
    return out


def entropy(text):
    """Bits a character of the characters of ``text``."""
    n = F.char_length(text)
    parts = F.transform(F.array_distinct(F.split(text, "")),
                        lambda c: (n - F.char_length(F.replace(text, c, F.lit("")))) / n)
    bits = F.aggregate(parts, F.lit(0.0), lambda s, p: s - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    return F.when(n > 0, bits).otherwise(0.0)


def lexical(urls: DataFrame) -> DataFrame:
    """``urls`` (url) with the lexical features and the host's suffixes."""
    u = F.coalesce(F.col("url"), F.lit(""))
    d = urls.withColumns({"__u": u, "__h": host(u), "__p": path(u)})
    query = F.regexp_extract("__u", r"\?([^#]*)", 1)
    count = lambda c, x: F.char_length(c) - F.char_length(F.replace(c, F.lit(x), F.lit("")))
    digits = F.char_length("__u") - F.char_length(F.translate(F.col("__u"), "0123456789", ""))
    return d.withColumns({
        "n_url": F.char_length("__u"), "n_host": F.char_length("__h"), "n_path": F.char_length("__p"),
        "depth": count(F.col("__p"), "/"), "labels": count(F.col("__h"), "."), "digits": digits / F.greatest(F.char_length("__u"), F.lit(1)),
        "hyphens": count(F.col("__h"), "-"), "entropy": entropy(F.col("__u")),
        "params": F.when(query != "", count(query, "&") + 1).otherwise(0), "n_query": F.char_length(query),
        "fragment": F.col("__u").contains("#").cast("int"),
        "__s1": F.substring_index("__h", ".", -1), "__s2": F.substring_index("__h", ".", -2)})


def rule_labels(urls: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """``(url, block)`` of the urls that a rule decides."""
    hit = rule_for(host(F.col("url")), path(F.col("url")), rules)
    return urls.select("url", hit.alias("hit")).where("hit is not null").select(
        "url", (F.col("hit.verdict") == "block").cast("int").alias("block"))


class Model:
    """Fitted trees with their suffix statistics, or one constant verdict.

    ``stats`` are the frequent suffixes, ``rest`` all others (None: there are none)."""

    def __init__(self, trees=None, stats=None, share: float = 0.0, rest=None):
        self.trees, self.stats, self.share, self.rest = trees, stats, share, rest

    def features(self, urls: DataFrame, row: str = "url") -> DataFrame:
        """Features of urls to judge; ``row``: the column whose hash deals out rows of one suffix."""
        d = lexical(urls)
        for k in (1, 2):
            s = F.broadcast(self.stats.where(F.col("k") == k).select(F.col("s").alias(f"__s{k}"), F.col("p").alias(f"suffix{k}")))
            d = d.join(s, f"__s{k}", "left")
            if self.rest is not None:
                # rows that have their statistic go to numbers of their own; a suffix without any is dealt over SALTS
                dealt = F.xxhash64(row)
                d = d.withColumn("__salt", F.when(F.col(f"suffix{k}").isNull(), F.pmod(dealt, F.lit(SALTS))).otherwise(-1 - F.pmod(dealt, F.lit(1 << 20))))
                r = (self.rest.where(F.col("k") == k).select(F.col("s").alias(f"__s{k}"), F.col("p").alias("__rest"))
                         .withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))))
                d = d.join(r.hint("merge"), [f"__s{k}", "__salt"], "left")
                d = d.withColumn(f"suffix{k}", F.coalesce(f"suffix{k}", "__rest")).drop("__rest", "__salt")
            d = d.withColumn(f"suffix{k}", F.coalesce(f"suffix{k}", F.lit(self.share)))
        return assembled(d)

    def judge(self, urls: DataFrame) -> DataFrame:
        """``urls`` with ``block_score`` (0 to 1), the trees' probability of block."""
        if self.trees is None:
            return urls.withColumn("block_score", F.lit(float(self.share)))
        from pyspark.ml.functions import vector_to_array
        rows = urls.select(F.col("url"), F.struct(*[F.col(f"`{c}`") for c in urls.columns]).alias("__row"))    # their names meet none of ours
        return self.trees.transform(self.features(rows, "__row")).select("__row.*", vector_to_array("__prob")[1].alias("block_score"))


def assembled(d: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=NAMES, outputCol="__x").transform(d.withColumns({n: F.col(n).cast("double") for n in NAMES}))


def fold_of(domain):
    """The fold of a registered domain: all its urls are in one."""
    return F.pmod(F.xxhash64(domain, F.lit("fold")), F.lit(FOLDS))


def unseen_features(urls: DataFrame, folds: DataFrame, share: float) -> DataFrame:
    """Features to learn from: the suffix statistics of a url leave out all domains of
    its own domain's fold, so they say what a new domain of that suffix would have."""
    d = lexical(urls).withColumn("__f", fold_of(F.col("__s2")))
    total = folds.groupBy("k", "s").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    for k in (1, 2):
        t = total.where(F.col("k") == k).select(F.col("s").alias(f"__s{k}"), F.col("n").alias("__n"), F.col("b").alias("__b"))
        own = folds.where(F.col("k") == k).select(F.col("s").alias(f"__s{k}"), F.col("fold").alias("__f"), F.col("n").alias("__nf"), F.col("b").alias("__bf"))
        left = lambda a, b: F.coalesce(F.col(a), F.lit(0)) - F.coalesce(F.col(b), F.lit(0))
        d = d.join(t, f"__s{k}", "left").join(own, [f"__s{k}", "__f"], "left").withColumn(
            f"suffix{k}", (left("__b", "__bf") + PRIOR * share) / (left("__n", "__nf") + PRIOR)).drop("__n", "__b", "__nf", "__bf")
    return assembled(d)


def train(labelled: DataFrame, sample: int = 20_000, suffixes: int = 5000, trees: int = 12, depth: int = 4) -> Model:
    """Fits the suffix statistics (over all labelled urls) and the trees (over the sample)."""
    rows = labelled.where("url is not null and block in (0, 1)").select("url", "block")
    t = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("block").alias("b")).first()
    share = (t["b"] or 0) / t["n"] if t["n"] else 0.0
    if share in (0.0, 1.0):
        return Model(share=share)
    h = rows.select(host(F.col("url")).alias("h"), "block")
    domains = (h.groupBy(F.substring_index("h", ".", -1).alias("s1"), F.substring_index("h", ".", -2).alias("s2"))
                .agg(F.count(F.lit(1)).alias("n"), F.sum("block").cast("double").alias("b")).withColumn("fold", fold_of(F.col("s2"))))
    # a domain's statistic counts its urls; a last label's counts domains, each once
    one = domains.groupBy(F.lit(1).alias("k"), F.col("s1").alias("s"), "fold").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("b") / F.col("n")).alias("b"))
    two = domains.groupBy(F.lit(2).alias("k"), F.col("s2").alias("s"), "fold").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    folds = materialize(one.unionByName(two), "suffix-folds")
    every = materialize(folds.groupBy("k", "s").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
                        .select("k", "s", "n", ((F.col("b") + PRIOR * share) / (F.col("n") + PRIOR)).alias("p")), "suffix-stats")
    stats = materialize(every.orderBy(F.desc("n"), "k", "s").limit(suffixes).select("k", "s", "p"), "suffixes")
    rest = every.join(F.broadcast(stats.select("k", "s")), ["k", "s"], "left_anti") if every.count() > suffixes else None
    model = Model(None, stats, share, rest)
    once = materialize(rows.distinct(), "url-labels")      # a url with labels of both classes is in both
    half = max(1, sample // 2)
    few = None
    for c in (0, 1):
        of = once.where(F.col("block") == c).orderBy(F.xxhash64("url"), "url").limit(half)
        few = of if few is None else few.unionByName(of)
    few = materialize(few, "url-sample")
    sizes = {r["block"]: r["n"] for r in once.groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()}
    got = {r["block"]: r["n"] for r in few.groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(got) < 2:
        return Model(share=share)
    w = F.when(F.col("block") == 1, F.lit(sizes[1] / got[1])).otherwise(F.lit(sizes[0] / got[0]))
    x = unseen_features(few, folds, share).withColumn("label", F.col("block").cast("double")).withColumn("__w", w)
    model.trees = GBTClassifier(featuresCol="__x", labelCol="label", weightCol="__w", predictionCol="__pred", maxIter=trees, maxDepth=depth,
                                seed=11).setRawPredictionCol("__raw").setProbabilityCol("__prob").fit(x)
    return model


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], model: Model) -> DataFrame:
    """``pages`` with ``host, path, rule, verdict, block_score``."""
    hit = rule_for(F.col("host"), F.col("path"), rules)
    out = model.judge(pages).withColumns({"host": host(F.col("url")), "path": path(F.col("url"))}).withColumn("__hit", hit)
    by_model = F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")
    return out.withColumns({"rule": F.col("__hit.rule"), "verdict": F.coalesce(F.col("__hit.verdict"), by_model)}).drop("__hit")
