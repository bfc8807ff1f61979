"""URL filters: host and path rules, and gradient-boosted trees for URLs without a rule; built-in SQL functions only.

Rules: a rule fits its host and all subdomains if the URL's path starts with the rule's path; the longest rule wins.
Trees: lexical features (length, path depth, digit ratio, character entropy, parameter count, host labels, host length,
hyphens, suffix length and the suffix's share of all URLs) are put in bins by their quantiles; each level of a tree takes its
splits from sums of gradients and curvatures by node, feature and bin, a DataFrame aggregate of bounded size. URLs that a rule
judges are the labels; at most about MAX_LABELLED of them, chosen by hash, are used. The model is a SQL expression.
Suffix statistics are kept for suffixes that make up at least SUFFIX_MIN of all URLs, at most 1 / SUFFIX_MIN rows, and broadcast.

Defined cases: null URLs or ones without `://`: empty host and path, no rule, judged by the trees like any text. Without
labels, or without rows, every URL without rule is allowed. Repeated URLs count as often as they stand there. Ties: of splits
with equal gain the first feature and bin; rules of one length can't both fit. URLs of any length are read whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import materialize, table

TREES, DEPTH, RATE, RIDGE, BINS, MAX_LABELLED, SUFFIX_MIN = 10, 3, 0.4, 1.0, 12, 50_000, 0.001
FEATURES = ("f_length", "f_depth", "f_digits", "f_entropy", "f_params", "f_labels", "f_host", "f_hyphens", "f_suffix", "f_share")


@dataclass(frozen=True)
class Rule:
    """`host/path`: block or allow."""

    verdict: str
    rule: str

    @property
    def host(self) -> str:
        return self.rule.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.rule.partition("/")[2]


#: The rules of the registered query.
RULES = (Rule("block", "net/"), Rule("allow", "example.net/en/"), Rule("block", "example.com/de/"), Rule("allow", "org/fr/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty if there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...], what: str) -> Column:
    """The longest fitting rule's text or verdict; null if none fits."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.rule), r.rule)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(getattr(r, what))).otherwise(out)
    return out


def lexical_features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """The features but the suffix's share, and the suffix."""
    text = F.coalesce(url, F.lit(""))
    n = F.length(text)
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    suffix = F.coalesce(F.get(labels, F.size(labels) - 1), F.lit(""))
    size = F.greatest(n, F.lit(1)).cast("double")
    # entropy from the runs of the sorted characters: how long each run is, without its start being looked for twice
    chars = F.sort_array(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)))
    start = F.struct(F.lit("").alias("c"), F.lit(0).alias("n"), F.lit(0.0).alias("t"))
    ended = lambda a: F.when(a["n"] > 0, a["n"] * F.log2(a["n"].cast("double"))).otherwise(F.lit(0.0))
    total = F.aggregate(
        chars,
        start,
        lambda a, x: F.when(x == a["c"], F.struct(x.alias("c"), (a["n"] + 1).alias("n"), a["t"].alias("t"))).otherwise(F.struct(x.alias("c"), F.lit(1).alias("n"), (a["t"] + ended(a)).alias("t"))),
        lambda a: a["t"] + ended(a),
    )
    return {
        "suffix": suffix,
        "f_length": n.cast("double"),
        "f_depth": F.regexp_count(path, F.lit("/")).cast("double"),
        "f_digits": F.regexp_count(text, F.lit("[0-9]")) / size,
        "f_entropy": F.log2(size) - total / size,
        "f_params": F.regexp_count(text, F.lit(r"[?&][^=&#]+=")).cast("double"),
        "f_labels": F.size(labels).cast("double"),
        "f_host": F.length(host).cast("double"),
        "f_hyphens": F.regexp_count(host, F.lit("-")).cast("double"),
        "f_suffix": F.length(suffix).cast("double"),
    }


def suffix_shares(suffixes: DataFrame, least: float = SUFFIX_MIN) -> DataFrame:
    """(suffix) -> (suffix, f_share) of those that make up at least `least` of all rows; a column of one row a suffix goes in."""
    counts = suffixes.groupBy("suffix").agg(F.count(F.lit(1)).alias("n"))
    total = suffixes.agg(F.count(F.lit(1)).alias("all"))
    return counts.join(F.broadcast(total)).where(F.col("n") >= least * F.col("all")).select("suffix", (F.col("n") / F.col("all")).alias("f_share"))


class Boosted:
    """Trees over bins: a tree maps node 1 (children 2i, 2i + 1) to (feature, bin) or to a leaf's value."""

    def __init__(self, cuts: dict[str, list[float]]):
        self.cuts, self.base, self.trees = cuts, 0.0, []

    def binned(self, feature: str) -> Column:
        """How many cuts the value is above."""
        return sum([(F.col(feature) > F.lit(c)).cast("int") for c in self.cuts[feature]], F.lit(0))

    def _value(self, tree: dict, node: int, feature) -> Column:
        at = tree[node]
        if isinstance(at, float):
            return F.lit(at)
        f, b = at
        return F.when(feature(f, b), self._value(tree, 2 * node, feature)).otherwise(self._value(tree, 2 * node + 1, feature))

    def margin(self, of_bins: bool) -> Column:
        low = (lambda f, b: F.col("b_" + f) <= b) if of_bins else (lambda f, b: F.col(f) <= self.cuts[f][b])
        return sum([self._value(t, 1, low) for t in self.trees], F.lit(self.base))


def train(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, ridge: float = RIDGE, bins: int = BINS) -> Boosted:
    """labelled: the features and y (1 blocks)."""
    quantiles = [k / bins for k in range(1, bins)]
    found = labelled.agg(F.count("y"), F.avg("y"), *[F.percentile_approx(f, quantiles, 1000) for f in FEATURES]).first()
    model = Boosted({f: sorted(set(found[2 + i] or [])) for i, f in enumerate(FEATURES)})
    n, rate_up = found[0], found[1]
    if not n or rate_up in (0.0, 1.0):
        model.base = -1.0 if not n or rate_up == 0.0 else 1.0
        return model
    import math

    model.base = math.log(rate_up / (1 - rate_up))
    rows = materialize(labelled.select("y", *[model.binned(f).alias("b_" + f) for f in FEATURES]))
    for _ in range(trees):
        score = 1 / (1 + F.exp(-model.margin(True)))
        tree: dict = {}
        sums: dict[int, tuple[float, float]] = {}
        open_nodes = [1]
        for level in range(depth):
            node = _node(tree, 1)
            cell = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col("b_" + f).alias("b")) for i, f in enumerate(FEATURES)])).alias("x")
            graded = rows.select(node.alias("node"), (score - F.col("y")).alias("g"), (score * (1 - score)).alias("h"), *["b_" + f for f in FEATURES]).where("node is not null").select("node", "g", "h", cell)
            hist = graded.groupBy("node", "x.f", "x.b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()  # nodes x features x bins
            cells: dict = {}
            for r in hist:
                cells.setdefault(r.node, {}).setdefault(r.f, {})[r.b] = (r.g, r.h)
            for k in open_nodes:
                if k not in cells:
                    tree[k] = 0.0
                    continue
                any_f = next(iter(cells[k].values()))
                g, h = (sum(v[i] for v in any_f.values()) for i in (0, 1))
                sums.setdefault(k, (g, h))
                best = None
                for f in sorted(cells[k]):
                    gl = hl = 0.0
                    for b in sorted(cells[k][f])[:-1]:
                        gl, hl = gl + cells[k][f][b][0], hl + cells[k][f][b][1]
                        gain = round(gl * gl / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g * g / (h + ridge), 7)
                        if gain > 1e-6 and (best is None or gain > best[0]):
                            best = (gain, FEATURES[f], b, (gl, hl), (g - gl, h - hl))
                if best is None:
                    tree[k] = float(-rate * g / (h + ridge))
                else:
                    tree[k] = (best[1], best[2])
                    sums[2 * k], sums[2 * k + 1] = best[3], best[4]
            open_nodes = [c for k in open_nodes if isinstance(tree[k], tuple) for c in (2 * k, 2 * k + 1)]
            if not open_nodes:
                break
        for k in open_nodes:
            tree[k] = float(-rate * sums[k][0] / (sums[k][1] + ridge))
        model.trees.append(tree)
    return model


def _node(tree: dict, k: int) -> Column:
    """The open node that a row of bins falls in; null if it is in a leaf."""
    if k not in tree:
        return F.lit(k)
    if isinstance(tree[k], float):
        return F.lit(None).cast("int")
    f, b = tree[k]
    return F.when(F.col("b_" + f) <= b, _node(tree, 2 * k)).otherwise(_node(tree, 2 * k + 1))


def filter_urls(pages: DataFrame, url_col: str = "url", rules: tuple[Rule, ...] = RULES, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Append host, path, rule, verdict and block_score (the trees' log odds) to pages; columns of these names give way.

    The input's other columns travel in one struct, so that none of them can be taken for a feature.
    """
    names = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "block_score")]
    url = F.col(url_col).cast("string")
    d = pages.select(F.struct(*names).alias("given"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    host, path = F.col("host"), F.col("path")
    d = d.withColumns({"rule": rule_of(host, path, rules, "rule"), "v": rule_of(host, path, rules, "verdict")})
    features = lexical_features(F.col("url"), host, path)
    shares = materialize(suffix_shares(d.select(features["suffix"].alias("suffix"))))  # at most 1 / SUFFIX_MIN rows
    with_share = lambda x: x.withColumns(features).join(F.broadcast(shares), "suffix", "left").withColumn("f_share", F.coalesce("f_share", F.lit(0.0)))
    labelled = d.where("rule is not null").select("url", "host", "path", "v")
    dealt = F.pmod(F.xxhash64("url"), F.lit(1 << 30)) / float(1 << 30)
    chosen = labelled.where(dealt < max_labelled / max(labelled.count(), 1))
    sample = materialize(with_share(chosen).select(F.when(F.col("v") == "block", 1.0).otherwise(0.0).alias("y"), *FEATURES))
    margin = train(sample).margin(False)
    judged = with_share(d).withColumn("score", margin)
    return judged.select(*[F.col("given").getField(c).alias(c) for c in names], "host", "path", "rule", F.coalesce("v", F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"), F.col("score").alias("block_score"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "block_score")
