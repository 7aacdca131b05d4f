"""URL filter: host and path rules, and a logistic regression on character n-grams for the rest."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locuswise.llm import linear

#: Rules of the query: (host and path, verdict).
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
BUCKETS = 1 << 13
THRESHOLD = 0.5
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_URL = re.compile(r"://([^/?#]*)([^?#]*)", re.DOTALL)

#: The labelled table: parts of host names and of paths that were judged, put together by ``labelled_urls``.
BLOCKED_PARTS = (
    "casino win poker slots jackpot bets betting lottery roulette pills pharmacy viagra cheap loans payday credit "
    "adult xxx porn sex cams escort dating hot spam farm ads adserver track tracker tracking clicks popup banner affiliate "
    "free replica warez crack torrent malware phish bonus deals prize winner x"
).split()
ALLOWED_PARTS = (
    "news daily times herald journal review library museum school college institute science nature history garden "
    "recipes travel weather city council health doctor research archive wiki docs manual forum code music art books "
    "river mountain local street north south house bridge green water stone family"
).split()
#: Syllables that made-up but harmless names are put together from.
SYLLABLES = "th er on an re he in ed nd ha at en es or nt ea ti to le is ou st ing tion the ble sh wh ly ar".split()
BLOCKED_PATHS = ("/play/now", "/bonus/free", "/click/12", "/offer/win", "/buy/cheap", "/en/1234.html", "/fr/77", "/de/5000/")
ALLOWED_PATHS = ("/en/1837/", "/fr/4163", "/articles/2020/05/title", "/about", "/wiki/Main", "/de/6137", "/es/2547.html", "/")


def labelled_urls(size: int = 1200, seed: int = 11) -> list[tuple[str, str, int]]:
    """(host, path, 1 for block): names of one or two judged parts under common prefixes and endings."""
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(size):
        bad = k % 2
        parts = BLOCKED_PARTS if bad else ALLOWED_PARTS
        # every part comes first in turn, so that each is learned
        first, second = parts[(k // 2) % len(parts)], parts[rng.integers(len(parts))]
        name = (first, f"{first}-{second}", f"{first}{second}")[rng.integers(3)]
        if bad and len(name) < 3:
            name = f"{second}-{name}"
        if not bad and k % 4 == 0:
            name = "".join(SYLLABLES[i] for i in rng.integers(len(SYLLABLES), size=rng.integers(2, 5)))
        front = ("", "www.", "m.", "blog.", "shop.")[rng.integers(5)]
        end = (".com", ".net", ".org", ".example.com", ".example.net", ".example.org", ".info", ".de")[rng.integers(8)]
        paths = (BLOCKED_PATHS if bad else ALLOWED_PATHS) if rng.integers(2) else ("/en/8423", "/", "/fr/9662.html", "/de/19", "/es/6964/")
        rows.append((front + name + end, paths[rng.integers(len(paths))], int(bad)))
    return rows


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    found = _URL.search(url or "")
    return (found[1].translate(LOWER), found[2]) if found else ("", "")


def grams(host: str, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 3- to 5-grams of the host and 3-grams of the path, as a row of length 1 at most."""
    text, tail = f"^{host}$".encode(), path.translate(LOWER).encode()
    at = [zlib.crc32(text[i : i + n]) % BUCKETS for n in (3, 4, 5) for i in range(len(text) - n + 1)]
    at += [BUCKETS + zlib.crc32(tail[i : i + 3]) % BUCKETS for i in range(len(tail) - 2)]
    found, count = np.unique(np.array(at, dtype=np.int64), return_counts=True)
    value = np.sqrt(count)
    return found, value / max(np.linalg.norm(value), 1.0)


def train(table: list[tuple[str, str, int]] | None = None) -> linear.Fitted:
    table = labelled_urls() if table is None else table
    return linear.fit(linear.Rows.of([grams(h, p) for h, p, _ in table]), np.array([y for *_, y in table]), 2 * BUCKETS, l2=1e-5, steps=600)


def find_rule(host: str, path: str, rules: dict[str, list[tuple[str, str, str]]]) -> tuple[str | None, str | None]:
    """The longest rule (as text) that fits, and its verdict; of equally long ones the first by code point."""
    best: tuple[str | None, str | None] = (None, None)
    labels = host.split(".")
    for k in range(len(labels)):
        for start, rule, verdict in rules.get(".".join(labels[k:]), ()):
            if path.startswith(start) and (best[0] is None or (-len(rule), rule) < (-len(best[0]), best[0])):
                best = (rule, verdict)
    return best


def _by_host(rules) -> dict[str, list[tuple[str, str, str]]]:
    out: dict[str, list[tuple[str, str, str]]] = {}
    for rule, verdict in rules:
        host, slash, path = rule.partition("/")
        out.setdefault(host, []).append((slash + path, rule, verdict))
    return out


def _judged(rules, model: linear.Fitted, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_host = _by_host(rules)
        for batch in batches:
            out = []
            for url in batch["url"]:
                host, path = split_url(url.as_py())
                at, value = grams(host, path)
                score = float(model.probability(np.array([model.weights[at] @ value + model.bias]))[0])
                rule, verdict = find_rule(host, path, by_host)
                out.append((host, path, rule, verdict or ("block" if score >= threshold else "allow"), score))
            columns = {c: batch[c] for c in batch.schema.names if c != "url"}
            kinds = (("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string()), ("block_score", pa.float64()))
            for (name, kind), values in zip(kinds, list(zip(*out, strict=True)) or [()] * 5, strict=True):
                columns[name] = pa.array(values, kind)
            yield pa.record_batch(columns)

    return run


def judged(pages: DataFrame, rules=RULES, model: linear.Fitted | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``pages`` (page_id, url): host, path, the rule that decides and the verdict.

    ``rules`` is a short list that travels with the job. A null url, or one without ``://``, has an empty host and path,
    meets no rule, and gets the model's verdict on empty text. Repeated rows are judged alike. An empty table gives an
    empty result; other columns are ignored.
    """
    schema = "page_id long, host string, path string, rule string, verdict string, block_score double"
    return pages.select(F.col("page_id").cast("long"), "url").mapInArrow(_judged(tuple(rules), model or train(), threshold), schema)


def query(spark, sf_dir):
    from locuswise.llm.common import table

    return judged(table(spark, sf_dir, "pages"))
