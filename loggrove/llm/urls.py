"""URL verdicts: rules first, and gradient-boosted trees on lexical features for the rest.

The trees learn from the URLs that the rules label. What they see of a URL is its shape: lengths,
depth, digit share, character entropy, parameters, and how common its suffix and registered
domain are among all pages.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from loggrove.llm.registry import query, table
from loggrove.scratch import written

# The rules, as (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

TRAIN_ROWS = 20_000  # the trees are fitted on so many labelled URLs at most, chosen by hash; of the rarer kind up to half as many
TREES, DEPTH, SEED = 20, 4, 7


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def with_rules(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` and ``ruled`` (the rule's verdict); both null where no rule fits."""
    out = pages.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rule = verdict = F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked last and so wins
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return out.withColumn("rule", rule).withColumn("ruled", verdict)


def _entropy(text: Column) -> Column:
    chars = F.split(text, "")
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    return -F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda total, c: total + share(c) * F.log2(F.greatest(share(c), F.lit(1e-12))))


def _share(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)) / F.greatest(F.length(text), F.lit(1))


FEATURES = {
    "url_length": lambda: F.length("_url"), "host_length": lambda: F.length("host"), "path_length": lambda: F.length("path"),
    "host_depth": lambda: F.regexp_count("host", F.lit(r"\.")), "path_depth": lambda: F.regexp_count("path", F.lit("/")),
    "digit_ratio": lambda: _share(F.col("_url"), "[0-9]"), "host_digits": lambda: F.regexp_count("host", F.lit("[0-9]")),
    "host_hyphens": lambda: F.regexp_count("host", F.lit("-")), "vowel_ratio": lambda: _share(F.col("host"), "[aeiou]"),
    "entropy": lambda: _entropy(F.col("_url")), "host_entropy": lambda: _entropy(F.col("host")),
    "parameters": lambda: F.when(F.instr("_url", "?") > 0, 1 + F.regexp_count("_url", F.lit("&"))).otherwise(0),
    "fragment": lambda: (F.instr("_url", "#") > 0).cast("int"), "secure": lambda: F.col("_url").startswith("https:").cast("int"),
    "ends_in_slash": lambda: F.col("path").endswith("/").cast("int"), "has_extension": lambda: F.regexp_like("path", F.lit(r"\.[A-Za-z0-9]{1,5}$")).cast("int"),
    "first_folder": lambda: F.length(F.element_at(F.split(F.concat(F.col("path"), F.lit("//")), "/"), 2)),
}


def _host_statistics(urls: DataFrame, total: int) -> DataFrame:
    """``_host`` and, for its last one and last two labels, the log-share of pages and of hosts that these have."""
    hosts = written(urls.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).where("host <> ''"), "hosts")
    suffixes = hosts.select("pages", F.explode(F.array(F.substring_index("host", ".", -1), F.substring_index("host", ".", -2))).alias("suffix"))
    counted = written(suffixes.groupBy("suffix").agg(F.sum("pages").alias("pages"), F.count(F.lit(1)).alias("hosts")), "suffixes")
    out = hosts.select(F.col("host").alias("_host"))
    for name, labels in (("last", -1), ("domain", -2)):
        of = counted.select(F.col("suffix").alias(f"_{name}"), *[
            F.log1p(F.col(c) * 1e6 / max(total, 1)).alias(f"{name}_{c}") for c in ("pages", "hosts")])
        out = out.join(of, F.substring_index("_host", ".", labels) == of[f"_{name}"], "left").drop(f"_{name}")
    return out


def features(ruled: DataFrame) -> DataFrame:
    """``ruled`` with a vector of lexical features and suffix statistics."""
    staged = ruled.withColumn("_url", F.coalesce("url", F.lit("")))
    # As many rows as there are hosts; written, so that small ones are broadcast and hot hosts split at run time.
    statistics = written(_host_statistics(staged, staged.count()), "host-statistics")
    staged = staged.join(statistics, staged["host"] == statistics["_host"], "left").drop("_host")
    extra = [f"{name}_{c}" for name in ("last", "domain") for c in ("pages", "hosts")]
    staged = staged.select(*ruled.columns, *[f().cast("double").alias(f"f_{n}") for n, f in FEATURES.items()], *[
        F.coalesce(F.col(c), F.lit(0.0)).alias(f"f_{c}") for c in extra])
    names = [c for c in staged.columns if c.startswith("f_")]
    return VectorAssembler(inputCols=names, outputCol="features").transform(staged).drop(*names)


def fit(shaped: DataFrame, rows: int = TRAIN_ROWS):
    """Trees over the ruled URLs, or None where these are of fewer than two kinds.

    Beyond ``rows`` of them each kind has a bound of its own, so that a rare one is never lost, and
    its rows weigh what they stand for.
    """
    labelled = shaped.where("ruled IS NOT NULL").select(F.when(F.col("ruled") == "block", 1.0).otherwise(0.0).alias("label"), "features", "url", "page_id")
    counts = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}  # two rows at most
    if len(counts) < 2:
        return None
    rarer = min(counts, key=counts.get)
    bounds = {rarer: min(counts[rarer], rows // 2)}
    bounds |= {kind: min(counts[kind], rows - bounds[rarer]) for kind in counts if kind != rarer}
    chosen = [_chosen(labelled.where(F.col("label") == kind), bound, counts[kind]) for kind, bound in bounds.items()]
    sample = written(chosen[0].union(chosen[1]), "url-sample")
    return GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=SEED, cacheNodeIds=False, weightCol="weight").fit(sample)


def _chosen(labelled: DataFrame, bound: int, count: int) -> DataFrame:
    """``bound`` rows by hash of URL and id, each standing for count / bound of them.

    A first cut at twice the share keeps what is sorted small; a hot URL's pages have ids of their own.
    """
    share = F.pmod(F.xxhash64("url", "page_id"), F.lit(1 << 40))
    near = labelled if count < 4 * bound else labelled.where(share < int(2 * bound / count * (1 << 40)) + (1 << 40) * 64 // count)
    least = near if count <= bound else near.orderBy(share, "page_id", "url").limit(bound)
    return least.select("label", "features", F.lit(count / bound).alias("weight"))


def verdicts(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, rows: int = TRAIN_ROWS) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule`` and ``verdict`` (allow or block) of every page.

    * A null url or one without ``://`` has an empty host and path; no rule fits it, the trees judge it.
    * Without ruled URLs of both kinds nothing can be learned, and what no rule fits is allowed.
    * Repeated rows are judged alike; an empty table gives an empty result. Null ids stay null.
    * Other columns are not read, whatever their names.
    """
    ruled = with_rules(pages.select("page_id", "url"), rules)
    shaped = features(ruled)
    model = fit(shaped, rows)
    if model is None:
        judged = ruled.withColumn("prediction", F.lit(0.0))
    else:
        judged = model.transform(shaped)
    learned = F.when(F.col("prediction") > 0.5, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", learned).alias("verdict"))


@query()
def op9_url_verdicts(spark, folder):
    return verdicts(table(spark, folder, "pages"))
