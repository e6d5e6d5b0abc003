"""URL filters: rules first, then logistic regression on hashed character n-grams of host and path.

The model is trained from a small labelled URL table (``labelled_urls``; another table can be given). Its n-grams come
from the host and the path apart, each hashed to its own half of the buckets. Digits of a path count as 0. A rule's
verdict stands before the model's.

Edge cases: a null URL and one without ``://`` have empty host and path, fit no rule and are judged by the model
on no n-grams (its bias: allow); of rules that fit, the one with the longest host and path stands, of equally long ones
the first by host, path and verdict; rows are judged one by one, so repeated rows and null page_ids change nothing; a
very long URL is read whole; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandflow.llm.common import fit_logistic, plain, sigmoid

#: (host, path prefix, verdict)
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
BUCKETS, GRAMS = 1 << 16, (3, 4, 5)
#: What the small labelled table is made of: common words of site names by kind, and pages by kind. Partner words, places,
#: ends of hosts and plain pages stand under both kinds, so that they speak for neither.
BLOCK_WORDS = "casino poker roulette bet bets betting odds slots jackpot lotto bingo pills viagra cialis pharmacy adult porn xxx sex nude cams escort dating warez crack keygen torrent malware phishing spam scam ads adserver banner tracker popup clicks loans payday forex replica".split()
ALLOW_WORDS = "library news wiki docs python university museum weather hospital garden recipes travel railway project forum archive school council furniture music history science theatre orchestra health kitchen sports newspaper maps dictionary theory reading thing other then there weekend station thesis nation shelter orchard hand bread street river mountain author village window father mother those which within other into stone this that".split()
PARTNERS = ["", "online-", "-online", "my", "-world", "best-", "-club", "the", "-365", "new-"]
PLACES = ["", "www.", "", "m.", "blog."]
ENDS = [".com", ".net", ".org", ".info", ".co.uk", ".io"]
PLAIN_PAGES = ["/", "/en/12", "/de/840/", "/fr/77.html", "/es/1207?page=2", "/index.html", "/page/3", ""]
BLOCK_PAGES = ["/bonus/claim", "/play/free/spins", "/buy/now", "/win/prize", "/click?aff=12", "/download/crack.exe", "/join/live", "/apply/now", "/verify/password", "/redirect/ad"]
ALLOW_PAGES = ["/articles/2021/05/review", "/books/catalog", "/about/contact", "/docs/guide.html", "/wiki/Station", "/courses/physics", "/timetable", "/forum/thread/492", "/recipes/soup", "/opinion/letters"]


def labelled_urls() -> list[tuple[str, int]]:
    """The small labelled table: (url, 1 to block or 0 to allow). Each word stands with all partners, every fourth time on a page of its kind."""
    rows = []
    for words, own, y in ((BLOCK_WORDS, BLOCK_PAGES, 1), (ALLOW_WORDS, ALLOW_PAGES, 0)):
        for i, word in enumerate(words):
            for j, partner in enumerate(PARTNERS):
                n = 7 * i + 3 * j
                name = f"{word}{partner}" if partner.startswith("-") else f"{partner}{word}"
                rows.append((f"https://{PLACES[n % len(PLACES)]}{name}{ENDS[(n + j) % len(ENDS)]}{own[n % len(own)] if j % 4 == 0 else PLAIN_PAGES[(n + 2 * i + j) % len(PLAIN_PAGES)]}", y))
    return rows


def split_url(url: str | None) -> tuple[str, str]:
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((i for c in "/?#" if (i := rest.find(c)) >= 0), default=len(rest))
    path = rest[end:]
    stop = min((i for c in "?#" if (i := path.find(c)) >= 0), default=len(path))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), path[:stop]


_DIGIT = re.compile("[0-9]")


def grams(host: str, path: str) -> set[int]:
    out = set()
    for half, part in enumerate((host, _DIGIT.sub("0", path))):
        part = f"^{part}$" if part else ""
        out |= {half * BUCKETS // 2 + crc32(part[i : i + n].encode()) % (BUCKETS // 2) for n in GRAMS for i in range(len(part) - n + 1)}
    return out


def train(rows: list[tuple[str, int]], l2: float = 1e-4) -> np.ndarray:
    """One weight a bucket and, last, the bias (held under 0, so that a URL without n-grams is allowed)."""
    found = [sorted(grams(*split_url(url))) for url, _ in rows]
    used = np.array(sorted(set().union(*found)), dtype=np.int64)
    x = np.ones((len(rows), len(used) + 1))
    x[:, :-1] = 0
    for r, g in enumerate(found):
        x[r, np.searchsorted(used, g)] = 1 / np.sqrt(max(1, len(g)))
    # fewer rows than buckets: the weights lie in the rows' span
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    own = vt.T @ fit_logistic(u * s, np.array([y for _, y in rows], dtype=float), l2=l2)
    w = np.zeros(BUCKETS + 1)
    w[used], w[-1] = own[:-1], own[-1]
    w[-1] = min(w[-1], -0.1)
    return w


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.char_length(host) + F.lit(1)), r"^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def judge(pages: DataFrame, labelled: list[tuple[str, int]] | None = None, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """Per row: page_id, host, path, rule, model_score, verdict."""
    w = train(labelled or labelled_urls())

    @F.pandas_udf("double")
    def block_score(host: pd.Series, path: pd.Series) -> pd.Series:
        out = np.empty(len(host))
        for i, (h, p) in enumerate(zip(host, path, strict=True)):
            g = list(grams(h, p))
            out[i] = (w[g].sum() / np.sqrt(max(1, len(g)))) + w[-1]
        return pd.Series(sigmoid(out))

    host, path = host_path(F.col("url"))
    df = plain(pages, "page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    by_length = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    rule = verdict = None
    for h, p, v in by_length:
        fits = ((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    df = df.withColumns({"rule": rule, "by_rule": verdict, "model_score": block_score("host", "path")})
    return df.select("page_id", "host", "path", "rule", "model_score", F.coalesce("by_rule", F.when(F.col("model_score") >= 0.5, "block").otherwise("allow")).alias("verdict"))
