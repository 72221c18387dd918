"""URL filters: rules first, then logistic regression on hashed character n-grams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracework.llm.common import bounded_sample, map_rows
from tracework.llm.models import Logistic

#: Labelled URLs that the fit may use, lengths of n-grams, and buckets they hash to for host and path each.
LABELLED, GRAMS, BUCKETS = 4_000, (2, 3, 4), 512
_ODD = np.uint64(0x9E3779B97F4A7C15)


def host(url: Column) -> Column:
    """Host of a URL with A-Z lower-cased: after the first ``://`` up to ``/``, ``?``, ``#`` or the end; else empty."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """Path of a URL: after the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def split_rule(rule: str) -> tuple[str, str]:
    """``com/`` as host ``com`` and path ``/``."""
    at = rule.index("/")
    return rule[:at], rule[at:]


def rule_finder(rules: list[tuple[str, str]]):
    """A function from host and path to rule and verdict, or None twice: by the suffixes of the host, the longest rule first."""
    by_host: dict[str, list[tuple[int, str, str, str]]] = {}
    for verdict, rule in rules:
        h, p = split_rule(rule)
        by_host.setdefault(h, []).append((-len(rule), rule, verdict, p))
    most = max((h.count(".") + 1 for h in by_host), default=0)

    def find(h: str, p: str) -> tuple[str | None, str | None]:
        best, at = None, len(h)
        for _ in range(most):
            at = h.rfind(".", 0, at)
            for found in by_host.get(h[at + 1 :], ()):
                if p.startswith(found[3]) and (best is None or found < best):
                    best = found
            if at < 0:
                break
        return best[1:3] if best else (None, None)

    return find


def with_rules(urls: DataFrame, rules: list[tuple[str, str]], url_col: str = "url") -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``rule_verdict`` (null where no rule fits).

    A rule ``(verdict, "host/path")`` fits its host and all subdomains if the path
    starts with the rule's; the longest wins, of equal ones the first by text. The
    caller's list of rules goes to every task; a URL looks only at those of the
    suffixes of its host, and none is moved for it. Columns of these names are replaced.
    """
    df = urls.drop("host", "path", "rule", "rule_verdict").withColumns({"host": host(F.col(url_col)), "path": path(F.col(url_col))})
    shared = urls.sparkSession.sparkContext.broadcast(rules)
    columns = df.columns
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)

    def make():
        find = rule_finder(shared.value)

        def run(r: dict) -> list:
            found = [find(h, p) for h, p in zip(r["host"], r["path"])]
            return [*(r[c] for c in columns), [x for x, _ in found], [v for _, v in found]]

        return run

    return map_rows(df, f"{schema}, rule string, rule_verdict string", make)


def features(host_text: str, path_text: str) -> np.ndarray:
    """Counts of hashed n-grams of bytes, log-damped: host buckets, then path buckets."""
    out = np.zeros(2 * BUCKETS)
    for base, text in ((0, f"^{host_text}$"), (BUCKETS, f"^{path_text}$")):
        code = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint64)
        for n in GRAMS:
            if len(code) >= n:
                gram = np.full(len(code) - n + 1, n, np.uint64)
                for k in range(n):
                    gram = (gram ^ code[k : len(code) - n + 1 + k]) * _ODD
                at = (gram >> np.uint64(40)) % np.uint64(BUCKETS)
                out[base : base + BUCKETS] += np.bincount(at.astype(np.int64), minlength=BUCKETS)
    return np.log1p(out)


def learn(labelled: DataFrame) -> Logistic | None:
    """Fit from ``host, path, label`` (1 block, 0 allow), a bounded sample of distinct URLs; None without both labels.

    Of labels that disagree on one URL, block counts.
    """
    rows = labelled.where("label in (0, 1)").groupBy("host", "path").agg(F.max("label").alias("label"))
    rows = rows.withColumn("h", F.xxhash64("host", "path"))
    pdf = bounded_sample(rows, "h", LABELLED, seed=8).toPandas().sort_values(["h", "host", "path"])
    if pdf.empty or pdf["label"].nunique() < 2:
        return None
    x = np.stack([features(h, p) for h, p in zip(pdf["host"], pdf["path"])])
    return Logistic().fit(x, pdf["label"].to_numpy(float), l2=20.0)


def judge(
    urls: DataFrame, rules: list[tuple[str, str]], labelled: DataFrame, id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """Verdict on every row: ``page_id, host, path, rule, verdict, p_block``.

    Where a rule fits, it decides. Else the classifier does (``block`` from
    probability 0.5), also for URLs without a host; without labels of both kinds
    the verdict is ``allow`` and the probability null. Rows are independent, so
    repeated ones and ties get equal verdicts; null URLs have an empty host and
    path, URLs of any length are read whole, and an empty table gives an empty
    result. Other columns are ignored.
    """
    shared = urls.sparkSession.sparkContext.broadcast((learn(labelled), rules))
    kind = urls.schema[id_col].dataType.simpleString()

    def make():
        model, find = shared.value[0], rule_finder(shared.value[1])

        def run(r: dict) -> list:
            found = [find(h, p) for h, p in zip(r["host"], r["path"])]
            p = [None] * len(found)
            if model is not None and found:
                p = model.predict(np.stack([features(*x) for x in zip(r["host"], r["path"])])).tolist()
            verdict = [v or ("block" if q is not None and q >= 0.5 else "allow") for (_, v), q in zip(found, p)]
            return [r[id_col], r["host"], r["path"], [x for x, _ in found], verdict, p]

        return run

    rows = urls.select(F.col(id_col), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    return map_rows(rows, f"`{id_col}` {kind}, host string, path string, rule string, verdict string, p_block double", make)
