"""Operator 8, personal data: generators propose spans, boosted trees choose among them.

Base spans (email, ip, card, phone) follow fixed patterns and always stay. Further generators with
high recall propose overlapping candidates: numbers in groups, written-out addresses and long key
strings. Boosted trees score every candidate from its format and the words around it; a threshold a
kind, calibrated on held-out examples for precision, selects the additions. Of overlapping
candidates the best-scored one stays, and none may overlap a base span.

The trees are trained here on `examples` labelled candidates that a seeded generator writes: the
test data has no labels for personal data. The documented bound is that number of examples.

Defined cases: null or empty text has no spans; spans are in code points, end exclusive; repeated
rows repeat; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm.boosting import BoostedTrees
from vecloom.llm.common import batch_of, text_batches

BASE = ("email", "ip", "card", "phone")
ADDED = ("x_number", "x_email", "x_key")
FOUND = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in BASE), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_spans", pa.int64())])
FOUND_DDL = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"

#: Possessive and look-behind forms of the base patterns: the same matches, in linear time.
EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

NUMBER = re.compile(r"(?<![\w+.@-])[0-9(][0-9() ./-]{5,24}[0-9](?!\w)")
WRITTEN = re.compile(r"[A-Za-z0-9._%+-]{1,64}\s?(?:\[at\]|\(at\)|\{at\}| at )\s?[A-Za-z0-9-]{1,63}(?:\s?(?:\[dot\]|\(dot\)|\{dot\}| dot |\.)\s?[A-Za-z0-9-]{2,24}){1,3}")
KEY = re.compile(r"(?<![A-Za-z0-9_/+-])(?=[A-Za-z_/+-]*[0-9])[A-Za-z0-9_/+-]{20,88}={0,2}(?![A-Za-z0-9_/+-])")
#: Words that announce personal data, and words that announce other numbers.
FOR = frozenset("phone tel telephone mobile call fax contact ssn passport iban account card email mail write reach social id key token secret password api".split())
AGAINST = frozenset("page chapter isbn version figure table section order total price score year invoice commit sha hash checksum build line".split())


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = EMAIL_DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end if m else 0))
        if not m:
            end = max(end, 0)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The contract's spans, by kind as listed, then start."""
    out = [("email", *s) for s in emails(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p) < 4 or not p.strip("0") or len(p.lstrip("0")) < 4 for p in m[0].split(".")) and all(int(p.lstrip("0")[:4] or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(index in ADDED, start, end) of everything that the generators propose."""
    out = [(0, *m.span()) for m in NUMBER.finditer(text)]
    if "at]" in text or "(at)" in text or "{at}" in text or " at " in text:  # whatever WRITTEN accepts holds one of these
        out += [(1, *m.span()) for m in WRITTEN.finditer(text)]
    return out + [(2, *m.span()) for m in KEY.finditer(text)]


def cue(before: list[str]) -> float:
    """The nearest announcing word before a span: positive for personal data, less with its distance."""
    return next(((1 if w in FOR else -1) / n for n, w in enumerate(reversed(before), 1) if w in FOR or w in AGAINST), 0.0)


def features(text: str, kind: int, start: int, end: int) -> list[float]:
    s = text[start:end]
    before = re.findall(r"[a-z]+", text[max(0, start - 40):start].lower())[-4:]
    after = re.findall(r"[a-z]+", text[end:end + 24].lower())[:2]
    digits = re.sub(r"[^0-9]", "", s)
    groups = re.findall(r"[0-9]+", s)
    counts = np.array([s.count(c) for c in set(s)], float) / max(1, len(s))
    return [
        kind, len(s), len(digits), len(digits) / max(1, len(s)), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
        luhn(digits) if 12 <= len(digits) <= 19 else 0, "(" in s, s.count("-") + s.count(" "), s.count(".") + s.count("/"), cue(before), any(w in FOR for w in after),
        float(-(counts * np.log2(counts)).sum()), sum(c.isupper() for c in s) / max(1, len(s)), sum(c.islower() for c in s) / max(1, len(s)), bool(re.fullmatch(r"[0-9a-f]+", s)), "[at]" in s or "(at)" in s or "{at}" in s, "[dot]" in s or "(dot)" in s or "{dot}" in s, text[max(0, start - 1):start] in ("=", ":", '"', "'"),
    ]


def _example(r: random.Random) -> tuple[str, int]:
    """A text around one candidate, and whether that is personal data."""
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    w = lambda n: "".join(r.choice("abcdefghijklmnoprstuvwy") for _ in range(n))
    v = lambda low, high: w(r.randrange(low, high))
    # one sentence ends and the next begins, which WRITTEN takes for an address with a dot
    prose = lambda: r.choice([str, str.capitalize])(v(1, 13)) + f" at {v(2, 15)}" + "".join(r.choice([". ", ".\n"]) + v(1, 15).capitalize() for _ in range(r.choice([1, 1, 2])))
    good = r.random() < 0.5
    kind = r.randrange(3)
    if kind == 0 and good:
        s = r.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}-{d(2)}-{d(4)}", f"0{d(3)} {d(3)} {d(3)}", f"{d(4)}-{d(4)}-{d(4)}-{d(4)}"])
    elif kind == 0:
        s = r.choice([f"19{d(2)}-20{d(2)}", f"20{d(2)}/{d(2)}/{d(2)}", f"{d(2)}.{d(2)}.20{d(2)}", d(r.randrange(7, 22)), f"{d(3)} {d(3)} {d(3)}", f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", f"{d(1)}.{d(1)}.{d(2)}.{d(3)}.{d(2)}"])
    elif kind == 1:
        s = r.choice([f"{w(5)} [at] {w(6)} [dot] com", f"{w(4)}.{w(5)} (at) {w(7)}.org", f"{w(6)} at {w(6)} dot net", f"{w(5)} at {w(6)}[dot]com", f"{w(5)} at {w(6)} (dot) org"]) if good else r.choice([f"{w(5)} at {w(6)}.{w(6)}", f"{w(3)} at {w(4)}. {w(5)}", f"{w(6)} at {w(5)} dot {w(8)}", f"{w(4)} at {d(2)}.{d(2)}", *[prose()] * 4])
    else:
        pick = lambda n, a: "".join(r.choice(a) for _ in range(n))
        full = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
        s = r.choice(["AKIA" + pick(16, full[:26] + "0123456789"), "sk-" + pick(32, full), pick(40, full), pick(32, "0123456789abcdef")]) if good else r.choice([pick(40, "0123456789abcdef"), f"{w(8)}-{w(7)}-{w(6)}-{d(2)}", f"{w(9)}/{w(8)}/{w(5)}{d(1)}", f"{w(12)}_{w(10)}{d(2)}"])
    lead = r.choice(sorted(FOR if r.random() < 0.9 else AGAINST)) if good and r.random() < 0.8 else r.choice(sorted(AGAINST)) if not good and r.random() < 0.6 else w(5)
    return f"{w(4)} {w(6)} {lead}{r.choice([' ', ': ', '=']) if kind != 1 else ' '}{s} {w(3)} {w(6)}.", int(good)


@cache
def detector(examples: int = 6000, precision: float = 0.95, seed: int = 7) -> tuple[BoostedTrees, tuple[float, ...]]:
    """The trees and a threshold a kind: the least one with that precision on the held-out fifth."""
    r, x, y = random.Random(seed), [], []
    while len(y) < examples:
        text, label = _example(r)
        for c in candidates(text):
            x.append(features(text, *c))
            y.append(label)
    x, y = np.array(x, float), np.array(y, float)
    held = np.arange(len(y)) % 5 == 0
    trees = BoostedTrees().fit(x[~held], y[~held])
    p, cuts = trees.predict(x[held]), []
    for kind in range(len(ADDED)):
        own = x[held][:, 0] == kind
        order = np.argsort(-p[own], kind="stable")
        right = y[held][own][order].cumsum() / np.arange(1, own.sum() + 1)
        fine = np.nonzero(right >= precision)[0]
        cuts.append(max(0.5, float(p[own][order][fine[-1]])) if len(fine) else 1.1)
    return trees, tuple(cuts)


def choose(base: list[tuple[str, int, int]], proposed: list[tuple[int, int, int]], scores: np.ndarray, cuts: tuple[float, ...]) -> list[tuple[str, int, int]]:
    """Base spans and, by falling score, the proposals that overlap nothing chosen before."""
    starts, ends, added = [], [], []  # of disjoint spans, in order
    for s, e in sorted((s, e) for _, s, e in base):
        if ends and s < ends[-1]:  # base spans of two kinds may overlap
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    for i in sorted(range(len(proposed)), key=lambda i: (-scores[i], proposed[i])):
        kind, s, e = proposed[i]
        if scores[i] < cuts[kind]:
            continue
        at = bisect_left(starts, e)  # spans before this one start before e
        if not at or ends[at - 1] <= s:
            starts.insert(at, s)
            ends.insert(at, e)
            added.append((ADDED[kind], s, e))
    return base + sorted(added, key=lambda t: (ADDED.index(t[0]), t[1]))


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find_personal_data(docs: DataFrame, examples: int = 6000, precision: float = 0.95) -> DataFrame:
    """doc_id, counts by base kind, base_sha256, spans (kind:start:end) and n_spans, their number, for every row of docs."""
    trees, cuts = detector(examples, precision)
    text_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            base, proposed = [base_spans(t) for t in texts], [candidates(t) for t in texts]
            x = np.array([features(t, *c) for t, cs in zip(texts, proposed) for c in cs], float)
            scores, at, rows = trees.predict(x) if len(x) else np.empty(0), 0, []
            for spans, cs in zip(base, proposed):
                n = [sum(k == kind for k, _, _ in spans) for kind in BASE]
                chosen = choose(spans, cs, scores[at:at + len(cs)], cuts)
                rows.append((*n, hashlib.sha256(written(spans).encode()).hexdigest(), written(chosen), len(chosen)))
                at += len(cs)
            yield batch_of(FOUND, b.column(0), *(map(list, zip(*rows)) if rows else [[]] * 7))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, FOUND_DDL)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
