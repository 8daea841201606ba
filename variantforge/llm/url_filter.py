"""URL verdicts: explicit rules first, then gradient-boosted trees on lexical features.

Everything here is DataFrame expressions.  Training bins the features, counts the distinct binned rows once
and grows every tree level from one grouped histogram of that small table; only split statistics (features x
bins x nodes) reach the driver.  The finished trees are one CASE expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.columns import named
from .scratch import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path): a rule fits its host and all subdomains if the URL's path starts with the rule's.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Host words that label a URL as unwanted for training; a URL with none of them is labelled wanted.
SEED_WORDS = ("ads", "adult", "bets", "casino", "pills", "porn", "spam", "xxx")
FEATURES = ("url_length", "host_length", "longest_label", "depth", "path_length", "digit_ratio", "entropy", "parameters", "fragment", "suffix_rate", "suffix_size")
TREES, DEPTH, BINS, RATE, LAMBDA = 12, 3, 16, 0.3, 1.0
#: Weight of the overall rate in a suffix's rate.
SMOOTH = 4.0


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): host after the first `://` up to `/`, `?`, `#` or end, A-Z lower-cased; path then up to `?`, `#` or end. Null or no `://`: both empty."""
    at = F.instr(url, "://")
    after = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(after, F.length(host) + 1), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def match_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, nulls if none does; of rules alike in length the first wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, at, prefix in sorted(rules, key=lambda r: -len(r[1] + r[2]))[::-1]:
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(prefix)
        rule = F.when(fits, F.lit(at + prefix)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def suffix_of(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def lexical(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """urls with host, path, suffix and the lexical FEATURES, all but those of the suffix."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    host, path = url_parts(F.col(url_col))
    base = urls.withColumns({"host": host, "path": path})
    chars = F.split(F.col("host"), "")
    share = lambda c: (F.length("host") - F.length(F.replace(F.col("host"), c, F.lit("")))) / F.length("host")
    entropy = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc - F.when(c == "", 0.0).otherwise(share(c) * F.log2(share(c))))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    count = lambda text, what: F.length(text) - F.length(F.regexp_replace(text, what, ""))
    return base.withColumns(
        {
            "suffix": suffix_of(F.col("host")),
            "url_length": F.length(url).cast("double"),
            "host_length": F.length("host").cast("double"),
            "longest_label": F.array_max(F.transform(F.split("host", r"\."), F.length)).cast("double"),
            "depth": count(F.col("path"), "/").cast("double"),
            "path_length": F.length("path").cast("double"),
            "digit_ratio": count(url, "[0-9]") / F.greatest(F.length(url), F.lit(1)),
            "entropy": F.when(F.col("host") == "", 0.0).otherwise(entropy),
            "parameters": F.when(query == "", 0.0).otherwise((count(query, "&") + 1).cast("double")),
            "fragment": url.contains("#").cast("double"),
        }
    )


def seed_label(host: Column, words=SEED_WORDS) -> Column:
    """1 if a host has one of the words between dots and hyphens, 0 if not, null for an empty host."""
    return F.when(host != "", F.arrays_overlap(F.split(host, r"[.\-]"), F.array(*[F.lit(w) for w in words])).cast("int"))


@dataclass
class Booster:
    """Boosted trees over binned features: bins by ascending edges, trees as nested (feature, bin, left, right) or leaf values."""

    base: float
    edges: dict[str, list[float]]
    trees: list = field(default_factory=list)

    def used(self) -> set[str]:
        """The features that some tree splits on."""
        out, stack = set(), list(self.trees)
        while stack:
            node = stack.pop()
            if not isinstance(node, float):
                out.add(node[0])
                stack += node[2:]
        return out

    def binned(self, name: str) -> Column:
        out = F.lit(0)
        for e in self.edges[name]:
            out = out + (F.col(name) > F.lit(e)).cast("int")
        return out

    def margin(self, bin_of) -> Column:
        def value(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            name, cut, left, right = node
            return F.when(bin_of(name) <= cut, value(left)).otherwise(value(right))

        out = F.lit(self.base)
        for tree in self.trees:
            out = out + value(tree)
        return out


def _leaf(tree, bin_of, path=()) -> Column:
    """The number of the leaf that a row reaches; leaves are numbered by their path of 0 and 1."""
    if isinstance(tree, float):
        return F.lit(int("1" + "".join(map(str, path)), 2))
    name, cut, left, right = tree
    return F.when(bin_of(name) <= cut, _leaf(left, bin_of, (*path, 0))).otherwise(_leaf(right, bin_of, (*path, 1)))


def _grow(tree, splits: dict, path=()):
    if isinstance(tree, float):
        return splits.get(int("1" + "".join(map(str, path)), 2), tree)
    name, cut, left, right = tree
    return (name, cut, _grow(left, splits, (*path, 0)), _grow(right, splits, (*path, 1)))


def train(rows: DataFrame, label_col: str, scratch: Scratch, trees: int = TREES, depth: int = DEPTH) -> Booster:
    """Boosted trees for log loss from rows of FEATURES and a label 0 or 1 (nulls are left out).

    Without rows, or of one class only, the model is its base rate alone.
    """
    rows = rows.where(F.col(label_col).isNotNull())
    marks = [i / BINS for i in range(1, BINS)]
    stats = rows.agg(F.count("*").alias("n"), F.sum(label_col).alias("p"), *[F.percentile_approx(name, marks, 10_000).alias(name) for name in FEATURES]).first()
    n, p = stats["n"], stats["p"] or 0
    booster = Booster(math.log((p + 0.5) / (n - p + 0.5)), {name: sorted(set(stats[name] or []))[:] for name in FEATURES})
    if not 0 < p < n:
        return booster
    counted = rows.select(*[booster.binned(name).alias(name) for name in FEATURES], F.col(label_col).alias("y")).groupBy(*FEATURES, "y").agg(F.count("*").alias("w"))
    counted = scratch.cut(counted, "counted")
    for _ in range(trees):
        tree = 0.0
        for _level in range(depth):
            prob = 1 / (1 + F.exp(-booster.margin(F.col)))
            hist = counted.select(_leaf(tree, F.col).alias("leaf"), ((prob - F.col("y")) * F.col("w")).alias("g"), (prob * (1 - prob) * F.col("w")).alias("h"), F.array(*[F.col(name) for name in FEATURES]).alias("bins"))
            hist = hist.select("leaf", "g", "h", F.posexplode("bins").alias("f", "bin")).groupBy("leaf", "f", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
            tree = _grow(tree, _best_splits(hist.collect()))
        booster.trees.append(tree)
    return booster


def _best_splits(hist) -> dict:
    """For each leaf its best split with both sides' values, or its value."""
    by: dict = {}
    for r in hist:
        by.setdefault(r["leaf"], {}).setdefault(r["f"], {})[r["bin"]] = (r["g"], r["h"])
    out = {}
    for leaf, fs in by.items():
        g, h = (sum(x[k] for x in fs[0].values()) for k in (0, 1))
        worth = lambda a, b: a * a / (b + LAMBDA)
        best = (1e-6, float(-RATE * g / (h + LAMBDA)))
        for f in sorted(fs):
            gl = hl = 0.0
            for cut in sorted(fs[f])[:-1]:
                gl, hl = gl + fs[f][cut][0], hl + fs[f][cut][1]
                gain = worth(gl, hl) + worth(g - gl, h - hl) - worth(g, h)
                if gain > best[0] * (1 + 1e-9):
                    best = (gain, (FEATURES[f], cut, float(-RATE * gl / (hl + LAMBDA)), float(-RATE * (g - gl) / (h - hl + LAMBDA))))
        out[leaf] = best[1]
    return out


def fit(labelled: DataFrame, scratch: Scratch) -> tuple[Booster, DataFrame, float]:
    """(trees, rows and positive rows of each suffix, the overall rate) of (url, label); nulls in either are left out."""
    seen = lexical(labelled.where(F.col("url").isNotNull() & F.col("label").isNotNull()).select("url", F.col("label").cast("int").alias("label")))
    rates = seen.groupBy("suffix").agg(F.count("*").alias("suffix_n"), F.sum("label").alias("suffix_p"))
    rates = scratch.cut(rates, "rates")
    total = rates.agg(F.sum("suffix_n").alias("n"), F.sum("suffix_p").alias("p")).first()
    overall = (total["p"] / total["n"]) if total["n"] else 0.5
    others = F.col("suffix_n") - 1
    known = seen.join(rates, "suffix").withColumns({"suffix_rate": (F.col("suffix_p") - F.col("label") + SMOOTH * overall) / (others + SMOOTH), "suffix_size": F.log2(others + 1)})
    model = train(known, "label", scratch)
    scratch.drop("counted")
    return model, rates, overall


def judge(urls: DataFrame, labelled: DataFrame, rules=RULES, url_col: str = "url") -> DataFrame:
    """urls with host, path, rule, verdict and score in place of any columns so named.

    labelled: (url, label) with label 1 for unwanted; nulls in either are left out.  The longest rule that
    fits decides; else the trees do: block from a score (probability of label 1) of 0.5.  A null url or one
    without `://` has empty host and path and is judged by the trees as an empty host.  Suffix rates and sizes
    (of the last two labels of the host) leave a training row itself out.  Without labelled rows every score is
    0.5 and every other URL allowed.  Rows repeated are judged alike.  Of splits with equal gain the first
    feature and the lowest cut stand.
    """
    model, rates, overall = fit(labelled, Scratch(urls.sparkSession, "url_filter"))
    keep = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict", "score")]
    source = urls.select(F.struct(*[named(c) for c in keep]).alias("row"), named(url_col).alias("url"))
    rows = lexical(source).join(rates, "suffix", "left")
    n = F.coalesce("suffix_n", F.lit(0))
    rows = rows.withColumns({"suffix_rate": (F.coalesce("suffix_p", F.lit(0)) + SMOOTH * overall) / (n + SMOOTH), "suffix_size": F.log2(n + 1)})
    bins = rows.withColumns({f"bin_{name}": model.binned(name) for name in FEATURES})
    score = 1 / (1 + F.exp(-model.margin(lambda name: F.col(f"bin_{name}"))))
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    judged = bins.select("row", "host", "path", rule.alias("rule"), verdict.alias("ruled"), score.alias("score"))
    return judged.select("row.*", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") > 0.5, "block").otherwise("allow")).alias("verdict"), "score")
