"""URL filter: host and path rules, and for the rest a ratio of character language models.

Two variable-order Markov models over a URL's bytes, one of accepted and one of
rejected URLs, interpolate their orders (Witten-Bell). A URL is blocked if the
rejected model gives it more bits by the byte than a threshold, which is set on
URLs held out from training.
"""

from __future__ import annotations

import math
from collections import defaultdict
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

#: Bytes of context at most.
ORDER = 4
#: Labelled URLs of each class that a model is fitted on at most, those with the lowest hashes; every fifth of them calibrates.
SAMPLE = 50_000
VERDICTS = ("allow", "block")


class Rule(NamedTuple):
    """A rule fits its host and all subdomains, for paths that begin with its path."""

    verdict: str
    host: str
    path: str

    @property
    def shown(self) -> str:
        return self.host + self.path


#: The rules of op10.
RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)


class Markov:
    """Counts of the bytes that follow each context of up to ORDER bytes."""

    def __init__(self) -> None:
        self.counts: dict[bytes, dict[int, int]] = defaultdict(lambda: defaultdict(int))

    def learn(self, url: bytes) -> None:
        padded = b"\x00" * ORDER + url + b"\x00"
        for i in range(ORDER, len(padded)):
            for k in range(ORDER + 1):
                self.counts[padded[i - k : i]][padded[i]] += 1

    def frozen(self) -> dict[bytes, float]:
        """log2 probability of the last byte of each context and byte seen, and under context + b'\\xff\\xff' the weight of shorter contexts."""
        out: dict[bytes, float] = {}
        p: dict[bytes, float] = {}
        for c in sorted(self.counts, key=len):
            follow = self.counts[c]
            n, d = sum(follow.values()), len(follow)
            for b, k in follow.items():
                lower = p.get(c[1:] + bytes([b]), 1 / 257) if c else 1 / 257
                p[c + bytes([b])] = (k + d * lower) / (n + d)
            out[c + b"\xff\xff"] = math.log2(d / (n + d))
        for key, x in p.items():
            out[key] = math.log2(x)
        return out


_UNSEEN = -math.log2(257)


def bits(model: dict[bytes, float], url: bytes) -> float:
    """log2 probability of a URL under a frozen model."""
    padded = b"\x00" * ORDER + url + b"\x00"
    total, get = 0.0, model.get
    for i in range(ORDER, len(padded)):
        k = ORDER
        while k >= 0:
            if (x := get(padded[i - k : i + 1])) is not None:
                total += x
                break
            total += get(padded[i - k : i] + b"\xff\xff", 0.0)
            k -= 1
        else:
            total += _UNSEEN
    return total


def ratio(models: tuple[dict, dict], url: bytes) -> float:
    """Bits a byte by which the rejected model (second) beats the accepted one."""
    return (bits(models[1], url) - bits(models[0], url)) / (len(url) + 1)


def split(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host and path columns; both empty for a null URL or one without '://'."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^([^?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("")), F.coalesce(path, F.lit(""))


def ruled(host: F.Column, path: F.Column, rules: tuple[Rule, ...] = RULES) -> tuple[F.Column, F.Column]:
    """The longest fitting rule as shown text and its verdict; nulls where none fits. Of rules of one length the first listed wins."""
    fits = lambda r: ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
    rule = verdict = F.lit(None).cast("string")
    for r in sorted(reversed(rules), key=lambda r: len(r.shown)):  # the last that fits is the longest, or the first listed of such
        rule, verdict = F.when(fits(r), r.shown).otherwise(rule), F.when(fits(r), r.verdict).otherwise(verdict)
    return rule, verdict


def fit(labelled: DataFrame, sample: int = SAMPLE) -> tuple[tuple[dict, dict], float]:
    """Models of accepted and rejected URLs from rows (url, verdict), and the threshold.

    Of each class the sample distinct URLs with the lowest hashes are taken: a bounded,
    uniform sample that doesn't depend on how rows are laid out. Every fifth by hash is
    held out; the threshold is where both classes' held-out error rates sum to the
    least, the middle of all such. Without URLs of both classes the ratio says nothing, and
    the threshold lets every URL pass.
    """
    rows = []
    for verdict in VERDICTS:
        d = labelled.where((F.col("verdict") == verdict) & F.col("url").isNotNull()).select("url").distinct()
        rows += [(r.url.encode("utf-8", "surrogatepass"), verdict == "block") for r in d.orderBy(F.xxhash64("url"), "url").limit(sample).collect()]
    models, held = (Markov(), Markov()), []
    for url, bad in rows:
        if xxhash.xxh3_64_intdigest(url) % 5 == 0:
            held.append((url, bad))
        else:
            models[bad].learn(url)
    frozen = (models[0].frozen(), models[1].frozen())
    if len({bad for _, bad in rows}) < 2:
        return frozen, math.inf
    if len({bad for _, bad in held}) < 2:
        held = rows
    scores = sorted((ratio(frozen, url), bad) for url, bad in held)
    n_bad = sum(bad for _, bad in held)
    n_good = len(held) - n_bad
    edges = [scores[0][0] - 1, *(((a[0] + b[0]) / 2) for a, b in zip(scores[:-1], scores[1:], strict=True)), scores[-1][0] + 1]
    below_bad = np.r_[0, np.cumsum([bad for _, bad in scores])]
    below_good = np.r_[0, np.cumsum([not bad for _, bad in scores])]
    errors = below_bad / n_bad + (n_good - below_good) / n_good
    best = np.flatnonzero(errors <= errors.min() + 1e-12)
    return frozen, float(edges[int(best[len(best) // 2])])


def judged(pages: DataFrame, rules: tuple[Rule, ...] = RULES, sample: int = SAMPLE) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every page's url.

    The rule's verdict if a rule fits, else the models': block if their ratio passes the
    threshold. URLs that a rule fits are what the models learn from. score is the ratio,
    null where a rule decided. A null or empty URL has empty host and path, and as no
    rule fits it, the models judge the empty text. Repeated rows are judged each.
    """
    host, path = split(F.col("url"))
    p = pages.select(pages["page_id"], pages["url"].cast("string").alias("url")).withColumns({"host": host, "path": path})
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    p = p.withColumns({"rule": rule, "verdict": verdict})
    models, threshold = fit(p.where("verdict IS NOT NULL"), sample)
    held = pages.sparkSession.sparkContext.broadcast((models, threshold))

    def run(batches):
        models, threshold = held.value
        for rb in batches:
            urls, verdicts = rb.column(1).to_pylist(), rb.column(5).to_pylist()
            scores = [None if v is not None else ratio(models, (u or "").encode("utf-8", "surrogatepass")) for u, v in zip(urls, verdicts, strict=True)]
            said = [v if v is not None else VERDICTS[s > threshold] for v, s in zip(verdicts, scores, strict=True)]
            yield pa.RecordBatch.from_arrays([rb.column(0), *(rb.column(i) for i in (2, 3, 4)), pa.array(said, pa.string()), pa.array(scores, pa.float64())], names=["page_id", "host", "path", "rule", "verdict", "score"])

    return common.by_arrow(p, run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, host string, path string, rule string, verdict string, score double")
