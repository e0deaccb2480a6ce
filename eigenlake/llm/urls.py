"""URL verdicts by rules, and by gradient-boosted trees on lexical features where no rule fits."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled URLs that the fit takes at most, those whose hashes are lowest.
SAMPLE = 20_000
#: Host, path, verdict.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z in lower case; empty without one."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def features(urls: pd.Series, suffixes: dict[str, float], default: float) -> np.ndarray:
    """Length, depth, digit ratio, entropy, parameters, host labels, hyphens, path length, and the block rate of the host's suffix."""
    out = np.zeros((len(urls), 10))
    for i, u in enumerate(urls):
        u = u or ""
        rest = u.partition("://")[2]
        cut = min((x for x in map(rest.find, "/?#") if x >= 0), default=len(rest))
        host, tail = rest[:cut].lower(), rest[cut:]
        path = tail.partition("#")[0].partition("?")[0]
        query = tail.partition("#")[0].partition("?")[2]
        counts = np.array([u.count(c) for c in set(u)] or [1], float)
        p = counts / counts.sum()
        labels = host.split(".")
        out[i] = len(u), path.count("/"), sum(c.isdigit() for c in u) / max(len(u), 1), -(p * np.log2(p)).sum(), query.count("=") + query.count("&"), len(labels), host.count("-"), len(path), suffixes.get(labels[-1], default), suffixes.get(".".join(labels[-2:]), default)
    return out


@dataclass
class Trees:
    """Boosted regression trees of fixed depth on the logistic loss; a tree is (feature, threshold) of each inner node in heap order, and the leaves' values."""

    start: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    suffixes: dict[str, float] = field(default_factory=dict)
    default: float = 0.5

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for feature, threshold, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(value)))):
                at = 2 * at + 1 + (x[np.arange(len(x)), feature[at]] > threshold[at])
            out += value[at - len(feature)]
        return out

    def probability(self, urls: pd.Series) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(features(urls, self.suffixes, self.default)), -40, 40)))


def _best_split(x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, bins: list[np.ndarray], ridge: float) -> tuple[int, float]:
    best = (0.0, 0, np.inf)
    total_g, total_h = g[rows].sum(), h[rows].sum()
    for j, edges in enumerate(bins):
        if not len(edges):
            continue
        place = np.searchsorted(edges, x[rows, j], "left")
        left_g = np.cumsum(np.bincount(place, g[rows], len(edges) + 1))[:-1]
        left_h = np.cumsum(np.bincount(place, h[rows], len(edges) + 1))[:-1]
        gain = left_g**2 / (left_h + ridge) + (total_g - left_g) ** 2 / (total_h - left_h + ridge) - total_g**2 / (total_h + ridge)
        k = int(np.argmax(gain))
        if gain[k] > best[0] + 1e-9:
            best = (float(gain[k]), j, float(edges[k]))
    return best[1], best[2]


def fit(urls: list[str], blocked: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3, ridge: float = 1.0) -> Trees:
    """Trees for labelled URLs; with one label only, or none, every URL gets its share."""
    n = len(urls)
    share = (blocked.sum() + 0.5) / (n + 1)
    sums: dict[str, list[float]] = {}
    for u, y in zip(urls, blocked, strict=True):
        rest = (u or "").partition("://")[2]
        labels = rest[: min((x for x in map(rest.find, "/?#") if x >= 0), default=len(rest))].lower().split(".")
        for s in {labels[-1], ".".join(labels[-2:])}:
            have = sums.setdefault(s, [0.0, 0.0])
            have[0] += y
            have[1] += 1
    model = Trees(float(np.log(share / (1 - share))), [], {s: (y + 2 * share) / (m + 2) for s, (y, m) in sums.items()}, float(share))
    if n < 2 or blocked.all() or not blocked.any():
        return model
    x = features(pd.Series(urls), model.suffixes, model.default)
    bins = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 33)[1:-1])) for j in range(x.shape[1])]
    raw = np.full(n, model.start)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        g, h = blocked - p, p * (1 - p)
        inner = (1 << depth) - 1
        feature, threshold, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n, np.int64)
        for node in range(inner):
            rows = np.flatnonzero(at == node)
            if len(rows):
                feature[node], threshold[node] = _best_split(x, g, h, rows, bins, ridge)
                at[rows] = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
        leaf = at - inner
        value = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        raw += value[leaf]
        model.trees.append((feature, threshold, value))
    return model


def train(labelled: DataFrame, url_col: str = "url", blocked_col: str = "blocked", sample: int = SAMPLE) -> Trees:
    """A model from rows with a URL and a 0/1 label; at most ``sample`` of their distinct pairs, by hash, reach the driver."""
    chosen = labelled.select(labelled[url_col].alias("url"), labelled[blocked_col].cast("int").alias("y")).where("url is not null and y is not null").distinct()
    table = chosen.orderBy(F.xxhash64("url"), "url", "y").limit(sample).toArrow()
    return fit(table["url"].to_pylist(), table["y"].to_numpy().astype(float))


def judge(pages: DataFrame, model: Trees | None = None, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """(id, host, path, rule, verdict, block_probability) for every row.

    The longest fitting rule decides; where none fits, the trees do, at a
    probability of one half.  Without a model, one is trained on the URLs that
    rules decide.  A null URL has an empty host and path and is judged by the
    trees as an empty URL; repeated rows stay; other columns aren't read.
    """
    url = F.coalesce(pages[url_col], F.lit(""))
    rows = pages.select(pages[id_col].alias("id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("id", "url", "host", "path", rule.alias("rule"), verdict.alias("ruled"))
    if model is None:
        model = train(rows.where("ruled is not null").select("url", (F.col("ruled") == "block").cast("int").alias("blocked")))

    @F.pandas_udf("double")
    def probability(urls: pd.Series) -> pd.Series:
        return pd.Series(model.probability(urls))

    rows = rows.withColumn("block_probability", probability("url"))
    verdict = F.coalesce("ruled", F.when(F.col("block_probability") >= 0.5, "block").otherwise("allow"))
    return rows.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "block_probability")
