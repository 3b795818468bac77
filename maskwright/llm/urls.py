"""URL filters: rules first, then gradient-boosted trees on lexical features.

Rules are (host, path, verdict).  A rule fits its host and all subdomains of it where the URL's path
starts with the rule's path; the longest rule that fits decides.  Of two rules of the same length that fit, which cannot be,
the first by text would.  Host, path and rules are expressions of the JVM.

Every other URL is judged by boosted trees that were trained on labelled URLs.  Labels come from
``SEEDS``, words of hosts that serve what a corpus does not want: a URL whose host has one of them between dots and hyphens is
labelled block, any other allow.  URLs that rules decide are no examples, since a rule is about a site and not about what its URLs look
like.  The words themselves are no feature, so the trees also block hosts of that look with other words.

Features are lexical: lengths, depth, shares of digits, entropies, counts of
parameters, hyphens and labels, and statistics of the host's suffixes (last label, last two labels): how many
labelled URLs have it, and the share of blocks among them.  In training that share is taken over the other
hosts alone, so it cannot tell a URL its own label.  Training takes the features of a bounded sample (``SAMPLE`` URLs of smallest
hash) to the driver, numbers and hashes of bounded size whatever the URLs' lengths; features are cut into at most ``BINS`` bins there, and
trees are grown from histograms.  ``held_out`` tells how the trees do on hosts they have not seen.

Nulls: a null URL, or one without ``://``, has empty host and path, fits no rule and is judged by
its features.  Without labelled URLs, or with one class only, that class's share decides (none:
allow).  Repeated rows get equal results (equal URLs count once in training); other columns pass through, but those named like
the results are replaced; an empty table gives an empty result.  URLs of any length are read whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SAMPLE = 50_000
TREES = 40
DEPTH = 3
RATE = 0.25
BINS = 64
#: Smooths leaf weights and suffix rates.
SMOOTH = 2.0
LEAST_IN_LEAF = 5
FOLDS = 5
#: Words of hosts that label a URL as one to block; a parameter.
SEEDS = ("adult", "ads", "bet", "bets", "casino", "escort", "gambling", "malware", "phishing", "pills", "poker", "porn", "sex", "slots", "spam", "viagra", "warez", "xxx")

FEATURES = ("url_length", "host_length", "path_length", "query_length", "depth", "labels", "hyphens", "digit_ratio", "host_digit_ratio", "longest_number", "host_entropy", "path_entropy", "parameters", "fragment", "secure", "last_rate", "last_count", "two_rate", "two_count")
#: The features that need no statistics come first.
OWN = FEATURES.index("last_rate")

_split = re.compile(r"([^/?#]*)([^?#]*)(\??[^#]*)(#?.*)", re.DOTALL).fullmatch
_numbers = re.compile(r"[0-9]+").findall
_upper = {i: i + 32 for i in range(65, 91)}


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What is between ``://`` and the path, in lower case (A-Z), and the path up to query or fragment."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    host = F.regexp_extract(text, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.regexp_extract(text, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def apply_rules(df: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", verdict: str = "rule_verdict") -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and the rule's verdict, in place of columns of these names."""
    host, path = host_and_path(common.column(url))
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))

    def first(values: list[str]) -> Column:
        fits = [((F.col("host") == h) | F.endswith("host", F.lit("." + h))) & F.startswith("path", F.lit(p)) for h, p, _ in ordered]
        return F.coalesce(*(F.when(fit, value) for fit, value in zip(fits, values)), F.lit(None).cast("string"))

    found = df.withColumns({"host": host, "path": path})
    return found.withColumns({"rule": first([h + p for h, p, _ in ordered]), verdict: first([v for _, _, v in ordered])})


def seeded(host: Column, seeds: tuple[str, ...] = SEEDS) -> Column:
    """Whether a host has one of the words between dots and hyphens."""
    return F.arrays_overlap(F.split(host, "[.-]"), F.array(*map(F.lit, seeds)))


def parts(url: str | None) -> tuple[str, str, str, str]:
    """(host, path, query, fragment); the host in lower case (A-Z)."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", "", "", ""
    host, path, query, fragment = _split(rest).groups()
    return host.translate(_upper), path, query, fragment


def entropy(text: str) -> float:
    n = len(text)
    return -sum(k / n * math.log2(k / n) for k in Counter(text).values())


def suffixes(host: str) -> tuple[int, int, int]:
    """Hashes of the last label, of the last two and of the host."""
    labels = host.rsplit(".", 2)
    return tuple(xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) >> 1 for x in (labels[-1], ".".join(labels[-2:]), host))


def lexical(url: str | None) -> list[float]:
    """The features of one URL that need no statistics."""
    url = url or ""
    host, path, query, fragment = parts(url)
    numbers = _numbers(url)
    return [
        len(url), len(host), len(path), len(query), sum(map(bool, path.split("/"))), host.count(".") + bool(host), url.count("-"),
        sum(map(len, numbers)) / max(1, len(url)), sum(map(len, _numbers(host))) / max(1, len(host)), max(map(len, numbers), default=0),
        entropy(host), entropy(path), query.count("="), bool(fragment), url.startswith("https"),
    ]


class Suffixes:
    """Per suffix (URLs, blocks), and per suffix and host the same: what a training set says of suffixes."""

    def __init__(self, keys: np.ndarray, blocked: np.ndarray) -> None:
        self.mean = float(blocked.mean()) if len(blocked) else 0.5
        self.seen: list[dict] = [defaultdict(lambda: [0, 0]) for _ in range(2)]
        self.by_host: list[dict] = [defaultdict(lambda: [0, 0]) for _ in range(2)]
        for row, bad in zip(keys.tolist(), blocked.tolist()):
            for i in (0, 1):
                for table, key in ((self.seen[i], row[i]), (self.by_host[i], (row[i], row[2]))):
                    table[key][0] += 1
                    table[key][1] += bad

    def of_others(self, row: list[int], i: int) -> tuple[float, float]:
        """(rate, log count) over the other hosts of the suffix."""
        n, bad = (a - b for a, b in zip(self.seen[i][row[i]], self.by_host[i][row[i], row[2]]))
        return (bad + SMOOTH * self.mean) / (n + SMOOTH), math.log1p(n)

    def table(self) -> tuple[dict, dict]:
        """Per suffix (rate, log count) over all hosts."""
        return tuple({k: ((bad + SMOOTH * self.mean) / (n + SMOOTH), math.log1p(n)) for k, (n, bad) in seen.items()} for seen in self.seen)


def with_statistics(own: np.ndarray, keys: np.ndarray, stats: tuple[dict, dict], mean: float) -> np.ndarray:
    """All features of URLs, from those of their own and the statistics of their suffixes."""
    none = (mean, 0.0)
    more = np.array([[x for i in (0, 1) for x in stats[i].get(row[i], none)] for row in keys.tolist()], dtype=float).reshape(-1, len(FEATURES) - OWN)
    return np.concatenate([own.reshape(-1, OWN), more], axis=1)


class Trees:
    """Boosted trees of fixed depth, as arrays: per tree the features, limits and leaves of a full binary tree."""

    def __init__(self, start: float, trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]], stats: tuple[dict, dict], mean: float) -> None:
        self.start, self.trees, self.stats, self.mean = start, trees, stats, mean

    def probability(self, own: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Of a block, per URL."""
        x = with_statistics(own, keys, self.stats, self.mean)
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, limit, leaf in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            total += leaf[node - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-total))

    @staticmethod
    def fit(own: np.ndarray, keys: np.ndarray, blocked: np.ndarray) -> "Trees":
        """``own``: features without statistics; ``keys``: hashes of suffixes and host; a row per labelled URL."""
        y = np.asarray(blocked, dtype=float)
        if not len(y) or y.min() == y.max():
            return Trees(20.0 if y.any() else -20.0, [], ({}, {}), 0.5)
        seen = Suffixes(keys, y.astype(int))
        others = np.array([[x for i in (0, 1) for x in seen.of_others(row, i)] for row in keys.tolist()], dtype=float)
        x = np.concatenate([own, others], axis=1)
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
        start = math.log(y.mean() / (1 - y.mean()))
        score = np.full(len(y), start)
        trees = []
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            grad, hess = y - p, p * (1 - p)
            feature = np.zeros(2**DEPTH - 1, dtype=np.int64)
            limit = np.full(2**DEPTH - 1, np.inf)
            node = np.zeros(len(y), dtype=np.int64)
            for level in range(DEPTH):
                for k in range(2**level - 1, 2 ** (level + 1) - 1):
                    rows = np.flatnonzero(node == k)
                    if len(rows):
                        feature[k], limit[k] = _best_split(binned[rows], grad[rows], hess[rows], edges)
                node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > limit[node])
            at = node - (2**DEPTH - 1)
            leaf = RATE * np.bincount(at, grad, 2**DEPTH) / (np.bincount(at, hess, 2**DEPTH) + SMOOTH)
            trees.append((feature, limit, leaf))
            score += leaf[at]
        return Trees(start, trees, seen.table(), seen.mean)


def held_out(own: np.ndarray, keys: np.ndarray, blocked: np.ndarray, folds: int = FOLDS) -> np.ndarray:
    """Probabilities of blocks by trees that have seen no URL of the same host."""
    fold = keys[:, 2] % folds
    out = np.zeros(len(keys))
    for k in range(folds):
        mine = fold == k
        out[mine] = Trees.fit(own[~mine], keys[~mine], blocked[~mine]).probability(own[mine], keys[mine])
    return out


def _best_split(binned: np.ndarray, grad: np.ndarray, hess: np.ndarray, edges: list[np.ndarray]) -> tuple[int, float]:
    """(feature, limit) of most gain; rows above the limit go right.  No gain: all go left."""
    best = (0.0, 0, math.inf)
    g, h = grad.sum(), hess.sum()
    for j, edge in enumerate(edges):
        if not len(edge):
            continue
        size = len(edge) + 1
        left_n = np.cumsum(np.bincount(binned[:, j], minlength=size))[:-1]
        left_g = np.cumsum(np.bincount(binned[:, j], grad, size))[:-1]
        left_h = np.cumsum(np.bincount(binned[:, j], hess, size))[:-1]
        gain = left_g**2 / (left_h + SMOOTH) + (g - left_g) ** 2 / (h - left_h + SMOOTH) - g**2 / (h + SMOOTH)
        gain[(left_n < LEAST_IN_LEAF) | (len(grad) - left_n < LEAST_IN_LEAF)] = 0
        k = int(np.argmax(gain))
        if gain[k] > best[0] + 1e-9:
            best = (float(gain[k]), j, float(edge[k]))
    return best[1], best[2]


def sampled(labelled: DataFrame, url: str = "url", blocked: str = "blocked", sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(own features, hashes of suffixes and host, labels) of about ``sample`` URLs of smallest hash.  Equal URLs count once."""
    names = [f"f{i}" for i in range(OWN)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls = batch.column(0).to_pylist()
            own = np.array([lexical(u) for u in urls], dtype=float).reshape(-1, OWN)
            keys = np.array([suffixes(parts(u)[0]) for u in urls], dtype=np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in own.T), *(pa.array(c) for c in keys.T), batch.column(1)], names=[*names, "last", "two", "host", "blocked"])

    rows = labelled.where(common.column(url).isNotNull()).groupBy(common.column(url).alias("u")).agg(F.max(blocked).alias("b"))
    share = min(1.0, sample / max(1, rows.agg(F.approx_count_distinct("u")).first()[0]))
    chosen = rows.where(F.xxhash64("u") <= common.hash_share(share))
    schema = ", ".join(f"{n} double" for n in names) + ", last long, two long, host long, blocked boolean"
    found = np.array(sorted(tuple(r) for r in chosen.mapInArrow(run, schema).collect()), dtype=object).reshape(-1, OWN + 4)  # about ``sample`` rows
    return found[:, :OWN].astype(float), found[:, OWN : OWN + 3].astype(np.int64), found[:, -1].astype(bool)


def judge(df: DataFrame, model: Trees, url: str = "url", out: str = "block_probability") -> DataFrame:
    """Add the probability of a block."""
    shared = df.sparkSession.sparkContext.broadcast((model.start, model.trees, model.stats, model.mean))

    @F.arrow_udf("double")
    def probability(cols: Iterator[pa.Array]) -> Iterator[pa.Array]:
        trees = Trees(*shared.value)
        for col in cols:
            urls = col.to_pylist()
            own = np.array([lexical(u) for u in urls], dtype=float).reshape(-1, OWN)
            keys = np.array([suffixes(parts(u)[0]) for u in urls], dtype=np.int64).reshape(-1, 3)
            yield pa.array(trees.probability(own, keys))

    return df.withColumn(out, probability(common.column(url)))


def labelled(pages: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", seeds: tuple[str, ...] = SEEDS) -> DataFrame:
    """(url, blocked): the URLs that no rule decides, labelled by the words of their hosts."""
    ruled = apply_rules(pages.select(common.column(url).alias("url")), rules)
    return ruled.where("rule is null and url is not null").select("url", seeded(F.col("host"), seeds).alias("blocked"))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", seeds: tuple[str, ...] = SEEDS) -> DataFrame:
    """Add host, path, rule, verdict and block_probability; the trees learn from the URLs that no rule decides."""
    model = Trees.fit(*sampled(labelled(pages, rules, url, seeds)))
    own = F.when(F.col("block_probability") >= 0.5, "block").otherwise("allow")
    read, ruled = common.free_names(pages, "judged_url", "rule_verdict")
    judged = judge(apply_rules(pages.withColumn(read, common.column(url)), rules, read, ruled), model, read)
    return judged.withColumn("verdict", F.coalesce(ruled, own)).drop(ruled, read)
