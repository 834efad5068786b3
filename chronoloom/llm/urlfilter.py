"""URL filters: rules of hosts and paths first, then a logistic regression on hashed character n-grams.

The regression is trained on the driver from a small labelled table (``most`` rows at most; hosts' names are made by a rule from
topics, and none is taken from the tables), by gradient descent from zero, so it is the same each time. Scoring is an expression over a constant array of weights.
"""

from __future__ import annotations

import json
import math

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, fresh, pick, read

BUCKETS = 1 << 13
GRAMS = (3, 4, 5)
#: (host, path, verdict): a rule holds for a host and all its subdomains, for paths that start with its own.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Topics of hosts that are to be blocked (gambling, drugs, adult, fraud, advertising) and of ordinary ones, and words that go with either.
BAD = "casino poker roulette jackpot slots betting bets wager bingo lottery pills meds viagra cialis steroids adult porn sex xxx escort nude webcam dating spam phishing malware virus warez keygen cracks torrent ads adserver tracker banners popups clicks replica payday loans".split()
GOOD = (
    "library school garden weather kitchen museum history letters station teacher theatre method science nature travel recipes music science health doctor hospital university college research journal gazette times herald tribune post "
    "news report daily weekly review magazine book reader writer story poem art painting drawing photo film cinema radio sport football cycling running hiking climbing sailing fishing farming village city county nation region "
    "council parliament court law police firemen charity church temple mosque abbey castle bridge river mountain ocean island forest meadow flower tree animal bird horse cattle dairy bakery butcher market shop tailor carpenter plumber "
    "engine motor train railway airport harbour energy water earth planet star telescope chemistry physics maths algebra geometry language grammar dictionary translation software hardware network server forum wiki archive mail"
).split()
WORDS = "online club live zone hub world best top my new the 24 our one web info".split()


def _names(topics: list[str]) -> list[str]:
    """Four host names for each topic, by a rule."""
    w = lambda i: WORDS[i % len(WORDS)]
    return [name for i, t in enumerate(dict.fromkeys(topics)) for name in (t, f"{t}{w(i)}", f"{w(i * 3 + 1)}-{t}", f"{t}-{w(i * 5 + 2)}")]


def _urls(name: str, i: int) -> list[str]:
    """Two urls of a host name, under the usual endings and sections."""
    prefix, end, section = ("", "m.", "www.", "blog."), ("com", "net", "org"), ("en/12", "de/7.html", "fr/99/", "es/3?page=2", "es/45", "en/8#top", "de/61", "fr/5")
    return [f"https://{prefix[(i + k) % 4]}{name}.example.{end[(i + k) % 3]}/{section[(i + 4 * k) % 8]}" for k in (0, 1)]


def labelled(part: int | None = None, parts: int = 5, *, held: bool = False) -> list[tuple[str, int]]:
    """The labelled table: (url, 1 if to be blocked). With a part, all names but each ``parts``-th one, or, held, only these."""
    out = []
    for bad, topics in ((1, BAD), (0, GOOD)):
        for i, name in enumerate(_names(topics)):
            # names of one topic are neighbours: steps of another size hold out a different kind of name of each
            if part is None or ((i + i // 4) % parts == part) == held:
                out += [(url, bad) for url in _urls(name, i)]
    return out


LABELLED = tuple(labelled())


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path. Null or without ``://``: both empty."""
    rest = F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    host = F.substring_index(F.substring_index(F.substring_index(rest, "/", 1), "?", 1), "#", 1)
    path = F.substr(rest, F.char_length(host) + 1)
    return ascii_lower(host), F.substring_index(F.substring_index(path, "?", 1), "#", 1)


def split_url(url: str | None) -> tuple[str, str]:
    """The same of a Python string, for training."""
    rest = (url or "").partition("://")[2]
    host = min((rest.partition(c)[0] for c in "/?#"), key=len)
    return host.translate({65 + i: 97 + i for i in range(26)}), rest[len(host) :].partition("?")[0].partition("#")[0]


def grams(host: str, path: str) -> list[str]:
    """Character n-grams: of the host as ``^host$``, of the path as it is with ``~`` before it."""
    return [s[i : i + n] for s in (f"^{host}$", f"~{path}") for n in GRAMS for i in range(len(s) - n + 1)]


def bucket(gram: str) -> int:
    h = xxhash.xxh64_intdigest(gram.encode(), 42)
    return (h - (1 << 64) if h >> 63 else h) % BUCKETS


def train(labelled: list[tuple[str, int]], most: int = 10_000, steps: int = 1000, rate: float = 4.0, decay: float = 3e-6, momentum: float = 0.9) -> list[float]:
    """Weights by bucket, the bias last. Features are counts over the root of the number of n-grams. At most ``most`` rows are used."""
    rows = labelled[:most]
    x, y = np.zeros((len(rows), BUCKETS)), np.array([r[1] for r in rows], float)
    for i, (url, _) in enumerate(rows):
        found = [bucket(g) for g in grams(*split_url(url))]
        np.add.at(x[i], found, 1 / math.sqrt(max(1, len(found))))
    used = np.flatnonzero(x.any(0))
    x = np.concatenate([x[:, used], np.ones((len(rows), 1))], 1)
    w, v = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for _ in range(steps if len(rows) else 0):
        error = 1 / (1 + np.exp(-(x @ w))) - y
        v = momentum * v - rate * (x.T @ error / len(rows) + decay * w)
        w = w + v
    out = np.zeros(BUCKETS + 1)
    out[used], out[-1] = w[:-1], w[-1]
    return out.round(6).tolist()


def _grams(text: Column) -> Column:
    cut = lambda n: F.transform(F.when(F.char_length(text) >= n, F.sequence(F.lit(1), F.char_length(text) - n + 1)).otherwise(F.array().cast("array<int>")), lambda i: F.substr(text, i, F.lit(n)))
    return F.concat(*[cut(n) for n in GRAMS])


def judge(pages: DataFrame, rules=RULES, weights: list[float] | None = None) -> DataFrame:
    """pages with host, path, rule, score and verdict in place of columns of these names.

    The longest rule that fits decides (its host's and path's length together); without one, the score: block at 0.5 or more.
    A null or broken url has empty parts, is fit by no rule and is scored like any other. Null and repeated page_ids stay. An empty
    table gives an empty one.
    """
    weights = train(list(LABELLED)) if weights is None else weights
    pages = pages.drop("host", "path", "rule", "score", "verdict")
    own = fresh("_g", pages)
    host, path = parts(F.col("url"))
    out = pages.withColumn("host", host).withColumn("path", path)
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    table = F.from_json(F.lit(json.dumps(weights[:-1])), "array<double>")
    out = out.withColumn(own, F.concat(_grams(F.concat(F.lit("^"), F.col("host"), F.lit("$"))), _grams(F.concat(F.lit("~"), F.col("path")))))
    total = F.aggregate(own, F.lit(0.0), lambda a, g: a + F.get(table, F.pmod(F.xxhash64(g), F.lit(BUCKETS)).cast("int")))
    out = out.withColumn("score", 1 / (1 + F.exp(-(total / F.sqrt(F.greatest(F.size(own), F.lit(1))) + weights[-1])))).drop(own)
    method = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return out.withColumn("rule", rule).withColumn("verdict", F.coalesce(verdict, method))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's parts, rule and verdict."""
    return judge(pick(read(spark, sf_dir, "pages"), "page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "score")
