"""URL filter: rules by host and path, else gradient-boosted trees on lexical features. DataFrame operations only."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TREES, DEPTH, STEP = 12, 3, 0.3
#: The bound of the labelled sample.
LABELLED_URLS = 4000
FEATURES = ["length", "host_length", "depth", "digit_ratio", "entropy", "parameters", "hyphens", "labels", "suffix_rate"]

#: (action, host, path) of the production rules: fixed values of the contract.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; '' for null or without ://."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; '' for null or without ://."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str, str]], result) -> Column:
    """result(action, host, path) of the longest rule that fits; null if none does.

    A rule fits its host and all subdomains, if the path starts with the rule's.
    """
    chosen = F.lit(None).cast("string")
    for action, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        chosen = F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.lit(result(action, h, p))).otherwise(chosen)
    return chosen


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def lexical_features(urls: DataFrame, suffix_rates: dict[str, float]) -> DataFrame:
    """urls (url and any others) with FEATURES; the rate of an unknown suffix is a half."""
    u = F.coalesce(F.col("url"), F.lit(""))
    n = F.greatest(F.length(u), F.lit(1)).cast("double")
    share = lambda c: (F.length(u) - F.length(F.replace(u, c))) / n
    entropy = F.aggregate(F.array_distinct(F.filter(F.split(u, ""), lambda c: c != "")), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))
    rate = F.lit(0.5)
    for suffix, value in sorted(suffix_rates.items()):
        rate = F.when(suffix_of(host_of(u)) == suffix, F.lit(value)).otherwise(rate)
    values = {
        "length": F.length(u),
        "host_length": F.length(host_of(u)),
        "depth": F.regexp_count(path_of(u), F.lit("/[^/]")),
        "digit_ratio": F.regexp_count(u, F.lit("[0-9]")) / n,
        "entropy": entropy,
        "parameters": F.regexp_count(u, F.lit("[?&][^?&#=]+=")),
        "hyphens": F.regexp_count(host_of(u), F.lit("-")),
        "labels": F.size(F.split(host_of(u), r"\.")),
        "suffix_rate": rate,
    }
    return urls.select("*", *(F.coalesce(v.cast("double"), F.lit(0.0)).alias(k) for k, v in values.items()))


#: Parts of the made-up sample.
SYLLABLES = "ba ce di fo gu ka le mi no pu ra se ti vo wa zen mar lin tor bel sun hol per dan".split()
SALES = "cheap pills casino bonus loans replica win prize deals adult slots payday viagra crypto coupon hot".split()
GOOD_SUFFIXES = "com com com org org net net edu gov de uk fr io info".split()
BAD_SUFFIXES = "com com net org info info biz biz top xyz click ru loan".split()


def labelled_urls(spark: SparkSession, n: int = LABELLED_URLS) -> DataFrame:
    """url, label (1: block), kind: a made-up sample, half harmless, half not, one label in fifty wrong.

    Harmless: news by date and words, products, reference pages, forum threads, searches and front pages, on
    hosts of one or two words, a sixteenth of them with a hyphen. Not so: hosts of selling words strung
    together, by themselves or below a hosting domain, mostly with plain pages, random hosts, plain hosts with affiliate links, redirects that hold another URL, deep paths
    of numbers, and chains of labels. Nothing is taken from the pages that the filter judges.
    """
    at = lambda salt, below: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(below))
    pick = lambda words, salt: F.element_at(F.array(*map(F.lit, words)), (at(salt, len(words)) + 1).cast("int"))
    number = lambda below, salt: at(salt, below).cast("string")
    code = lambda salt, size: F.substring(F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256), 1, size)
    word = lambda salt: F.concat(pick(SYLLABLES, f"{salt}1"), pick(SYLLABLES, f"{salt}2"), pick([*SYLLABLES[:6], "", "", ""], f"{salt}3"))
    slug = lambda salt: F.concat_ws("-", word(f"{salt}a"), word(f"{salt}b"), word(f"{salt}c"), F.when(at(f"{salt}n", 2) == 0, word(f"{salt}d")))
    scheme = F.concat(pick(["http", "https", "https"], "scheme"), F.lit("://"))
    front = pick(["", "", "", "www.", "www.", "docs.", "shop.", "forum.", "my.", "static.", "city."], "front")
    name = F.when(at("join", 16) == 0, F.concat(word("h"), F.lit("-"), word("i"))).when(at("join", 16) < 8, F.concat(word("h"), word("i"))).otherwise(word("h"))
    middle = pick(["", "", "", ".co", ".ac"], "middle")
    good_host = F.concat(scheme, front, name, middle, F.lit("."), pick(GOOD_SUFFIXES, "good"))
    slash = pick(["", "/"], "slash")
    page = pick(["", "", "", "?page=2", "?lang=en", "?utm_source=mail&utm_medium=link", "#comments"], "page")
    good = {
        "news": F.concat(F.lit("/"), (at("y", 15) + 2010).cast("string"), F.lit("/"), F.lpad((at("m", 12) + 1).cast("string"), 2, "0"), F.lit("/"), slug("n"), pick([".html", "", "/"], "end"), page),
        "product": F.concat(pick(["/product/", "/item/", "/p/"], "prod"), number(10**8, "pid"), F.lit("/"), slug("p"), page),
        "reference": F.concat(pick(["/docs/", "/wiki/", "/guide/", "/api/v2/"], "ref"), word("r"), F.lit("/"), word("q"), pick(["", ".htm", "#usage"], "anchor")),
        "thread": F.concat(F.lit("/t/"), slug("t"), F.lit("/"), number(10**6, "tid"), page),
        "search": F.concat(F.lit("/search?q="), word("s"), F.lit("+"), word("u"), F.lit("&page="), number(40, "sp"), F.lit("&sort=date")),
        "front": F.concat(slash),
        "section": F.concat(F.lit("/"), word("x"), F.lit("/"), number(20_000, "art"), pick(["", "/", ".html"], "secend"), page),
    }
    bad_end, host = F.concat(F.lit("."), pick(BAD_SUFFIXES, "bad")), lambda body: F.concat(scheme, pick(["", "www.", "go."], "sub"), body)
    strung = F.concat_ws("-", pick(SALES, "s1"), pick(SALES, "s2"), F.when(at("sn", 2) == 0, pick([*SALES, "online", "best", "now"], "s3")))
    track = F.concat(F.lit("?id="), number(10**9, "id"), F.lit("&aff="), number(10**6, "aff"), F.lit("&sid="), code("sid", 12), pick(["", "&sub=1&click=2"], "more"))
    bad = {
        "strung": F.concat(host(strung), F.when(at("farm", 2) == 0, F.concat(F.lit("."), word("fh"))).otherwise(""), bad_end, F.when(at("tr", 4) == 0, F.concat(pick(["/", "/buy/", "/order.php"], "buy"), track)).otherwise(good["section"])),
        "random": F.concat(host(code("host", 16)), bad_end, F.lit("/"), code("path", 10)),
        "affiliate": F.concat(host(word("h")), bad_end, pick(["/go", "/out", "/c", "/"], "go"), track),
        "redirect": F.concat(host(word("h")), bad_end, F.lit("/r?u=http%3A%2F%2F"), code("to", 12), F.lit(".com%2F"), number(10**8, "to2"), F.lit("&k="), code("k", 16)),
        "deep": F.concat(host(F.concat(word("h"), number(1000, "hn"))), bad_end, *(F.concat(F.lit("/"), number(10**7, f"deep{k}")) for k in range(6)), F.lit("/")),
        "chain": F.concat(scheme, code("c1", 5), F.lit("."), pick(SALES, "c2"), F.lit("."), code("c3", 4), F.lit("."), word("h"), bad_end, F.lit("/"), pick(SALES, "c4"), F.lit("/"), number(10**6, "c5")),
    }

    def one_of(kinds: dict[str, Column], salt: str) -> tuple[Column, Column]:
        names = list(kinds)
        k = at(salt, len(names))
        value = F.lit(None).cast("string")
        for i, name_ in enumerate(names):
            value = F.when(k == i, kinds[name_]).otherwise(value)
        return value, pick(names, salt)

    (good_path, good_kind), (bad_url, bad_kind) = one_of(good, "goodkind"), one_of(bad, "badkind")
    harmless = F.col("id") % 2 == 0
    wrong = (at("wrong", 50) == 0).cast("long")
    url, kind = F.when(harmless, F.concat(good_host, good_path)).otherwise(bad_url), F.when(harmless, good_kind).otherwise(bad_kind)
    return spark.range(0, n, numPartitions=1).select(url.alias("url"), ((F.col("id") + wrong) % 2).cast("double").alias("label"), kind.alias("kind"))


def suffix_statistics(labelled: DataFrame) -> dict[str, float]:
    """Smoothed share of blocked URLs per host suffix of the labelled sample."""
    counts = labelled.groupBy(suffix_of(host_of(F.col("url"))).alias("suffix")).agg(F.count("*").alias("n"), F.sum("label").alias("bad"))
    return {r.suffix: (r.bad + 1) / (r.n + 2) for r in counts.collect()}


def _tree(node) -> tuple:
    """(value,) of a leaf, (feature, threshold, left, right) of a split."""
    if node.subtreeDepth() == 0:
        return (node.prediction(),)
    return (node.split().featureIndex(), node.split().threshold(), _tree(node.leftChild()), _tree(node.rightChild()))


def train(labelled: DataFrame) -> tuple[dict[str, float], list[tuple[float, tuple]]]:
    """Suffix rates and weighted trees, learned from (url, label). The same rows give the same trees."""
    rates = suffix_statistics(labelled)
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(lexical_features(labelled, rates)).select("features", "label").cache()
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=7).fit(rows)
    rows.unpersist()
    return rates, [(w, _tree(t._call_java("rootNode"))) for w, t in zip(model.treeWeights, model.trees)]


_TRAINED: list[tuple[dict[str, float], list[tuple[float, tuple]]]] = []


def production_model(spark: SparkSession) -> tuple[dict[str, float], list[tuple[float, tuple]]]:
    """The model of the made-up sample, trained once per process; it holds nothing of the session."""
    if not _TRAINED:
        _TRAINED.append(train(labelled_urls(spark)))
    return _TRAINED[0]


def margin(trees: list[tuple[float, tuple]]) -> Column:
    """The ensemble as one expression over FEATURES: above 0 means block."""

    def value(tree: tuple) -> Column:
        if len(tree) == 1:
            return F.lit(tree[0])
        feature, threshold, left, right = tree
        return F.when(F.col(FEATURES[feature]) <= threshold, value(left)).otherwise(value(right))

    total = F.lit(0.0)
    for weight, tree in trees:
        total = total + F.lit(weight) * value(tree)
    return total


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, margin for every row.

    The longest fitting rule decides; else the trees. Null, empty and odd urls have empty host and
    path, fit no rule and go to the trees. Repeated rows are judged alike; only page_id and url are
    read. One narrow pass: the trained trees are a column expression, so nothing is shuffled.
    """
    rates, trees = production_model(pages.sparkSession)
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = pages.select("page_id", "url").withColumns({"host": host, "path": path})
    ruled = rows.withColumns(
        {
            "rule": longest_rule(F.col("host"), F.col("path"), rules, lambda a, h, p: h + p),
            "action": longest_rule(F.col("host"), F.col("path"), rules, lambda a, h, p: a),
        }
    )
    scored = lexical_features(ruled, rates).withColumn("margin", margin(trees))
    verdict = F.coalesce("action", F.when(F.col("margin") > 0, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "margin")
