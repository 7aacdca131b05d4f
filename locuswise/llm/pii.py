"""Personal data: fixed patterns, and a skip-chain conditional random field that adds what they miss."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locuswise.llm.crf import Chain, loopy_beliefs, train_chain

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
#: Labelled texts that train the model, built by a rule (``labelled_texts``).
TRAIN_TEXTS = 500
BATCH_ROWS = 512
#: Log-odds over "none" that a label needs for a span to be added.
MARGIN = 1.0

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_SIGN = re.compile(r"[0-9@]|[\[({]\s?at\s?[\])}]", re.IGNORECASE)
#: A token that may be personal data: a spelled-out address, a grouped number, or a run with a digit or "@".
_TOKEN = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\s?[\[({]\s?at\s?[\])}]\s?[A-Za-z0-9-]+(?:(?:\.|\s?[\[({]\s?dot\s?[\])}]\s?)[A-Za-z0-9-]+)+"
    r"|(?<![\w.+-])\(?[0-9]{2,5}\)?[ .-]?[0-9]{3,4}[ .-][0-9]{4,5}(?![\w-])"
    r"|(?<!\S)[^\s0-9@]*+[0-9@]\S*",
    re.IGNORECASE,
)
_EDGES = ".,;:!?\"'()[]{}<>|"


class Span(NamedTuple):
    kind: str
    start: int
    end: int


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The fixed patterns: per kind leftmost matches that don't overlap, less those that fail their check."""
    spans = []
    end, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > end and text[begin - 1] in _LOCAL:
            begin -= 1
        domain = _DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            end = domain.end()
            spans.append(Span("email", begin, end))
        at = text.find("@", max(at + 1, end))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                spans.append(Span("ip", *m.span()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                spans.append(Span("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    spans.append(Span("phone", *m.span()))
    return ordered(spans)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


class Tokens(NamedTuple):
    """Candidate tokens with a break (always "none") wherever plain words lie between two of them."""

    spans: list[tuple[int, int] | None]
    features: list[list[str]]
    links: list[tuple[int, int]]


def _shape(token: str) -> str:
    out = re.sub(r"[0-9]+", lambda m: "9" if len(m[0]) < 5 else "99" if len(m[0]) < 12 else "999", token)
    return re.sub(r"[^\W\d_]+", "a", out)[:16]


def candidates(text: str, known: list[Span]) -> Tokens:
    """Tokens that may be personal data. Plain words can only be "none", so the chain falls apart exactly at them.

    Links join each token with the next one in the document, however far, that has the same letters and digits, and
    tokens with a common part before "@" or the same last seven digits.
    """
    spans: list[tuple[int, int] | None] = []
    features: list[list[str]] = []
    last: dict[str, int] = {}
    links: list[tuple[int, int]] = []
    end = -2
    at = 0
    for m in _TOKEN.finditer(text):
        raw = m[0]
        begin = m.start() + len(raw) - len(raw.lstrip(_EDGES.replace("(", "")))
        stop = m.end() - len(raw) + len(raw.rstrip(_EDGES))
        if begin >= stop:
            continue
        if spans and begin - end > 2:
            spans.append(None)
            features.append(["break"])
        token = text[begin:stop]
        digits = "".join(c for c in token if c in "0123456789")
        found = ["bias", "shape:" + _shape(token), f"digits:{min(len(digits), 17)}"]
        found += ["has:" + s for s in ("@", "+", "(", "-", ".", ":", "=", "/", "%", "[") if s in token]
        if len(digits) == len(token):
            found.append(f"only:{min(len(digits), 17)}")
        while at < len(known) and known[at].end <= begin:
            at += 1
        k = at
        while k < len(known) and known[k].start < stop:
            if known[k].end > begin:
                found.append("base:" + known[k].kind)
            k += 1
        before, after = text[max(0, begin - 40) : begin].split()[-2:], text[stop : stop + 30].split()[:1]
        found += ["before:" + w.strip(_EDGES).lower() for w in before] + ["after:" + w.strip(_EDGES).lower() for w in after]
        here = len(spans)
        plain = re.sub(r"[^0-9a-z]+", "", token.lower())
        names = {"=" + plain, "@" + token.split("@")[0].lower() if "@" in token else "=" + plain}
        if len(digits) >= 7:
            names.add("#" + digits[-7:])
        ends = {last[n] for n in names if n in last and last[n] != here}
        links += [(e, here) for e in sorted(ends)]
        for n in names:
            last[n] = here
        spans.append((begin, stop))
        features.append(found)
        end = stop
    return Tokens(spans, features, links)


class Model(NamedTuple):
    chain: Chain
    bond: np.ndarray


def _gold(tokens: Tokens, spans: list[Span]) -> list[int]:
    out = []
    for place in tokens.spans:
        hit = next((s for s in spans if place and s.start < place[1] and place[0] < s.end), None)
        out.append(1 + KINDS.index(hit.kind) if hit else 0)
    return out


_WORDS = "the and with from order page item about result place year house table field water after report number line list".split()
_CUES = {
    "email": ("email", "mail", "write to", "contact", "reach me at", ""),
    "ip": ("ip", "host", "server", "address", "from", ""),
    "card": ("card", "visa", "card number", "paid with", ""),
    "phone": ("call", "phone", "tel", "mobile", "telephone", "fax", "ring me on", "phone number", "call me at"),
}


def labelled_texts(count: int = TRAIN_TEXTS, seed: int = 3) -> list[tuple[str, list[Span]]]:
    """Texts put together by a rule: personal data in plain and unusual forms, some of it repeated later without a cue,
    among dates, prices, versions, keys and other numbers that are not personal."""
    rng = np.random.default_rng(seed)
    pick = lambda options: options[int(rng.integers(len(options)))]
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    name = lambda: "".join(pick("abcdefghiklmnoprst") for _ in range(int(rng.integers(3, 8))))

    def card() -> str:
        body = pick("3456") + digits(14)
        body += next(d for d in "0123456789" if _luhn(body + d))
        return body if rng.integers(2) else " ".join(body[i : i + 4] for i in range(0, 16, 4))

    def datum(kind: str) -> str:
        if kind == "email":
            host, end = name() + digits(int(rng.integers(0, 2))), pick(("com", "org", "net", "example.com"))
            user = name() + pick(("", "." + name(), "." + digits(2)))
            return pick((f"{user}@{host}.{end}", f"{user} [at] {host} [dot] com", f"{user}(at){host}(dot)org", f"{user} (at) {host}.com"))
        if kind == "ip":
            return ".".join(str(rng.integers(1, 256)) for _ in range(4))
        if kind == "card":
            return card()
        a, b, c = str(rng.integers(200, 999)), digits(3), digits(4)
        return pick((f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"+49 30 {digits(7)}", f"00{digits(2)} {a} {digits(5)}", f"0{a} {digits(3)} {digits(4)}"))

    def number() -> str:
        return pick(
            (
                f"20{digits(2)}-0{pick('123456789')}-1{digits(1)}",
                f"{pick('123456789')}{digits(int(rng.integers(0, 5)))}",
                f"{digits(1)}.{digits(1)}.{digits(2)}",
                f"{digits(1)}.{digits(1)}",
                f"version {digits(1)}.{digits(1)}.",
                f"{digits(2)}.{digits(1)}.",
                f"${digits(2)}.{digits(2)}",
                f"{digits(2)}%",
                f"password={digits(6)}ab{digits(4)}",
                f"AKIA{digits(3)}XW{digits(3)}QR",
                f"#{digits(4)}",
                f"{digits(2)}:{digits(2)}",
                f"{pick('123456789')}{digits(int(rng.integers(11, 17)))}7",
                f"ISBN 978-{digits(1)}-{digits(5)}-{digits(3)}-{digits(1)}",
                f"id_{digits(8)}",
                f"{digits(3)}/{digits(4)}",
                f"@{name()}",
                f"300.{digits(3)}.400.{digits(3)}",
            )
        )

    texts = []
    for _ in range(count):
        parts: list[tuple[str, str]] = []
        said: list[tuple[str, str]] = []
        for _ in range(int(rng.integers(3, 10))):
            parts.append(("", " ".join(pick(_WORDS) for _ in range(int(rng.integers(1, 7))))))
            roll = int(rng.integers(4))
            if roll < 2:
                kind = pick(KINDS)
                cue, value = pick(_CUES[kind]), datum(kind)
                if cue:
                    parts.append(("", cue + pick(("", ":"))))
                parts.append((kind, value))
                said.append((kind, value))
            elif roll == 2 and said:
                parts.append(pick(said))
            else:
                parts.append(("", number()))
        text, spans = "", []
        for kind, value in parts:
            text += " " if text else ""
            if kind:
                spans.append(Span(kind, len(text), len(text) + len(value)))
            text += value
            if kind and not rng.integers(4):
                text += pick((".", ",", ")"))
        texts.append((text, spans))
    return texts


def train(texts: list[tuple[str, list[Span]]] | None = None) -> Model:
    """The chain by likelihood, and the bond of linked tokens by how much more often their labels go together than by chance."""
    sequences, labels = [], []
    pairs = np.ones((len(LABELS), len(LABELS)))
    for text, spans in labelled_texts() if texts is None else texts:
        tokens = candidates(text, base_spans(text))
        if not tokens.spans:
            continue
        gold = _gold(tokens, spans)
        sequences.append(tokens.features)
        labels.append(gold)
        for a, b in tokens.links:
            pairs[gold[a], gold[b]] += 1
            pairs[gold[b], gold[a]] += 1
    joint = pairs / pairs.sum()
    bond = np.clip(np.log(joint / np.outer(joint.sum(axis=1), joint.sum(axis=0))), -2.5, 2.5)
    return Model(train_chain(sequences, labels, len(LABELS), steps=120), bond)


def find_spans(text: str | None, model: Model) -> tuple[list[Span], list[Span]]:
    """(Spans of the fixed patterns, all spans). Spans that the model adds overlap no fixed one."""
    text = text or ""
    if not _SIGN.search(text):
        return [], []
    base = base_spans(text)
    tokens = candidates(text, base)
    if not tokens.spans:
        return base, base
    score = model.chain.emissions(tokens.features)
    for k, place in enumerate(tokens.spans):
        if place is None:
            score[k, 1:] = -50.0
    belief = loopy_beliefs(score, model.chain, tokens.links, model.bond)
    label = belief.argmax(axis=1)
    label[belief.max(axis=1) - belief[:, 0] < MARGIN] = 0
    added: list[Span] = []
    for place, y in zip(tokens.spans, label, strict=True):
        if place and y:
            kind = LABELS[y]
            if added and added[-1].kind == kind and 0 <= place[0] - added[-1].end <= 2 and kind == "phone":
                added[-1] = Span(kind, added[-1].start, place[1])
            else:
                added.append(Span(kind, *place))
    taken = sorted((s.start, s.end) for s in base)
    free, k = [], 0
    for span in added:
        while k < len(taken) and taken[k][1] <= span.start:
            k += 1
        if all(s >= span.end or e <= span.start for s, e in taken[max(0, k - len(KINDS)) : k + len(KINDS)]):
            free.append(span)
    return base, ordered(base + free)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def _found(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            results = [find_spans(text.as_py(), model) for text in batch["text"]]
            columns = {c: batch[c] for c in batch.schema.names if c != "text"}
            for kind in KINDS:
                columns[f"n_{kind}"] = pa.array([sum(s.kind == kind for s in base) for base, _ in results], pa.int64())
            columns["base_sha256"] = pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in results], pa.string())
            columns["spans"] = pa.array([joined(all_of) for _, all_of in results], pa.string())
            yield pa.record_batch(columns)

    return run


def detected(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): counts of the fixed patterns, a digest of their spans, and all spans.

    A null or empty text has no spans. Texts are read whole; links reach across the whole document. Repeated rows give
    repeated results. An empty table gives an empty result; other columns are ignored.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_found(model or train()), schema)


def query(spark, sf_dir):
    from locuswise.llm.common import table

    return detected(table(spark, sf_dir, "documents"))
