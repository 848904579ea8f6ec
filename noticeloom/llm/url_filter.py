"""URL filtering: host and path rules first, gradient-boosted trees on lexical features for the rest."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The rules as (host, path, verdict).
RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]
SYLLABLES = ["ba", "cor", "del", "fi", "gan", "hol", "jun", "kes", "lim", "mor", "nad", "pol", "ras", "sul", "tev", "vin", "wex", "zor"]
PLAIN_SUFFIXES, LOOSE_SUFFIXES = ["com", "org", "net", "edu"], ["com", "net", "info", "biz"]
CUT = 0.5


def labelled_urls(n: int = 4000, seed: int = 11) -> list[tuple[str, int]]:
    """The default labelled URLs (1: block), made by rule from random syllables, so that no word can be
    learned. The classes overlap in every feature: blocked hosts join words by hyphens or digits four
    times in five (allowed ones one time in ten), have loose suffixes more often, deeper or longer paths
    and more parameters. A deployment passes labelled URLs of its own (see train_from)."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[rng.integers(len(xs))]
    chance = lambda p: rng.random() < p
    word = lambda most: "".join(pick(SYLLABLES) for _ in range(rng.integers(1, most + 1)))
    out = []
    for k in range(n):
        bad = k % 3 == 0
        if chance(0.8 if bad else 0.1):
            host = word(2) + pick(["-", "-", "-", str(rng.integers(10, 999))]) + word(2)
        else:
            host = word(4)
        host = pick(["", "", "www.", "blog.", "m."]) + host + (f".{word(3)}" if chance(0.4) else "") + "." + pick(LOOSE_SUFFIXES if bad and chance(0.6) else PLAIN_SUFFIXES)
        parts = [word(3) for _ in range(rng.integers(1, 5 if bad else 4))] + ([str(rng.integers(1, 10**6))] if chance(0.5) else [])
        fields = rng.integers(0, 5) if chance(0.35 if bad else 0.2) else 0
        query = "&".join(f"{word(2)}={rng.integers(10 ** rng.integers(1, 9))}" for _ in range(fields))
        end = pick(["", "", "/", ".html", f"#{word(2)}"]) if not query else f"?{query}"
        out.append((f"{pick(['http', 'https'])}://{host}/{'/'.join(parts)}{end}", int(bad)))
    return out


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def suffix_of(host: str) -> str:
    return host.rpartition(".")[2]


@dataclass
class Model:
    """Boosted trees: each a list of (feature, threshold, left, right) nodes, leaves as (-1, value, 0, 0)."""

    suffixes: dict[str, tuple[float, float]] = field(default_factory=dict)
    start: float = 0.0
    trees: list[np.ndarray] = field(default_factory=list)

    def features(self, urls: list[str | None]) -> np.ndarray:
        """Length, depth, digit ratio, entropies, parameter count, host shape and suffix statistics."""
        rows = []
        for url in urls:
            url = url or ""
            rest = url.partition("://")[2]
            host = rest[: min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))].lower()
            tail = rest[len(host) :]
            path, _, query = tail.partition("#")[0].partition("?")
            labels = host.split(".")
            rate, share = self.suffixes.get(suffix_of(host), (0.5, 0.0))
            rows.append((
                len(url), len(host), path.count("/"), sum(map(str.isdigit, url)) / max(1, len(url)),
                sum(map(str.isdigit, host)) / max(1, len(host)), entropy(url), entropy(host),
                query.count("=") + query.count(";"), host.count("-"), len(labels), max(map(len, labels)),
                url.count("%") / max(1, len(url)), rate, share,
            ))
        return np.array(rows, float).reshape(len(urls), 14)

    def probability(self, urls: list[str | None]) -> np.ndarray:
        x = self.features(urls)
        total = np.full(len(x), self.start)
        for tree in self.trees:
            total += leaves(tree, x)
        return 1 / (1 + np.exp(-total))


def leaves(tree: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The value of the leaf that each row of features falls to."""
    at = np.zeros(len(x), np.int64)
    while True:
        f = tree[at, 0].astype(np.int64)
        inner = f >= 0
        if not inner.any():
            return tree[at, 1]
        left = x[np.arange(len(x)), np.maximum(f, 0)] <= tree[at, 1]
        at = np.where(inner, np.where(left, tree[at, 2], tree[at, 3]).astype(np.int64), at)


def train(pairs: list[tuple[str, int]], rounds: int = 60, depth: int = 3, rate: float = 0.2, least: int = 8, ridge: float = 1.0) -> Model:
    """Fit on labelled (url, 1 = block) pairs; their number is the caller's bound. No pairs: 0.5."""
    model = Model()
    if not pairs:
        return model
    y = np.array([p[1] for p in pairs], float)
    seen: dict[str, list[int]] = {}
    for url, label in pairs:
        host = url.partition("://")[2].partition("/")[0].lower()
        seen.setdefault(suffix_of(host), []).append(label)
    model.suffixes = {s: ((sum(v) + 1) / (len(v) + 2), len(v) / len(pairs)) for s, v in seen.items()}
    x = model.features([p[0] for p in pairs])
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model.start = float(np.log(mean / (1 - mean)))
    score = np.full(len(y), model.start)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, 49))) for f in range(x.shape[1])]

    def grow(nodes: list, rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int) -> int:
        me = len(nodes)
        value = rate * g[rows].sum() / (h[rows].sum() + ridge)
        nodes.append((-1, value, 0, 0))
        if level == depth or len(rows) < 2 * least:
            return me
        base = g[rows].sum() ** 2 / (h[rows].sum() + ridge)
        best = (1e-6, -1, 0.0)
        for f, at in enumerate(cuts):
            side = x[rows, f][:, None] <= at[None, :]
            n = side.sum(0)
            gl, hl = g[rows] @ side, h[rows] @ side
            gain = gl**2 / (hl + ridge) + (g[rows].sum() - gl) ** 2 / (h[rows].sum() - hl + ridge) - base
            gain[(n < least) | (len(rows) - n < least)] = -1
            k = int(gain.argmax()) if len(gain) else 0
            if len(gain) and gain[k] > best[0]:
                best = (float(gain[k]), f, float(at[k]))
        if best[1] < 0:
            return me
        left = x[rows, best[1]] <= best[2]
        a = grow(nodes, rows[left], g, h, level + 1)
        b = grow(nodes, rows[~left], g, h, level + 1)
        nodes[me] = (best[1], best[2], a, b)
        return me

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        nodes: list = []
        grow(nodes, np.arange(len(y)), y - p, p * (1 - p), 0)
        model.trees.append(np.array(nodes, float))
        score += leaves(model.trees[-1], x)
    return model


def train_from(labelled: DataFrame, bound: int = 20_000) -> Model:
    """train() on at most `bound` rows of labelled(url, label), those of smallest md5(url)."""
    rows = labelled.where("url IS NOT NULL AND label IN (0, 1)").select("url", F.col("label").cast("int").alias("label"))
    return train([(r.url, r.label) for r in rows.orderBy(F.md5("url"), "url", "label").limit(bound).collect()])


def host_of(url: str) -> Column:
    part = F.coalesce(F.regexp_extract(F.col(url), r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(part, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str) -> Column:
    return F.coalesce(F.regexp_extract(F.col(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits (as text) and its verdict; null without one."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def judge(pages: DataFrame, model: Model | None = None, rules: list[tuple[str, str, str]] = RULES, url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and p_block of every row of pages.

    A rule fits its host and all subdomains if the path starts with the rule's; the longest wins and
    decides. Other URLs are blocked where the trees give 0.5 or more. A null URL or one without
    `://` has empty host and path and is judged by the trees like any other text. Rows are judged
    one by one: no shuffle, and no column but page_id and the URL is read.
    """
    model = model or train(labelled_urls())

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(model.probability(b.column(1).to_pylist()), pa.float64())], ["page_id", "url", "p_block"])

    scored = pages.select(F.col("page_id").cast("long"), F.col(url).alias("url")).mapInArrow(run, "page_id long, url string, p_block double")
    host, path = host_of("url"), path_of("url")
    name, ruled = rule_of(F.col("host"), F.col("path"), rules)
    out = scored.withColumns({"host": host, "path": path})
    by_trees = F.when(F.col("p_block") >= CUT, "block").otherwise("allow")
    return out.select("page_id", "host", "path", name.alias("rule"), F.coalesce(ruled, by_trees).alias("verdict"), "p_block")
