"""Operator 7, toxicity: Levenshtein automata over a lexicon trie, with context-window scores.

The lexicon is learned: words that mark toxic rows among labelled training rows. A word of a text is
the pattern of a Levenshtein automaton (bit-parallel, one word of states for each number of errors)
that walks the trie of the lexicon; it accepts terms within the errors that their length allows.
Near forms that are ordinary words of clean training rows don't count. Each hit is judged by the
words around it: quotation marks and reporting words make it a quotation, words of address make it
abuse. A logistic model over the summed hits gives the score.

Learning uses at most `sample` labelled rows, those least by a hash of doc_id, a documented bound;
scoring covers every row and whole texts. Only rows whose crc32(doc_id as text) mod 3 is not 1 are
learned from, and doc_id, labels, lang and source are never inputs of a score.

Defined cases: null or empty text has no hits and gets the score of a text without hits; labels that
are null or without a document are left out; without labels of both kinds every score is 0.01;
several labels for one document all count; repeated rows repeat; other columns pass through the
filter.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm.common import batch_of, drop_stored, released, stored, text_batches
from vecloom.llm.pieces import PieceCache

SAMPLE, THRESHOLD = 20_000, 0.7
#: A term of at least this strength counts with errors, too.
STRONG = 0.8
#: What a near form of a term counts for, of the term itself.
NEAR = 0.9
SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32()), ("n_hits", pa.int64())])
SCORES_DDL = "doc_id long, score double, predicted int, n_hits long"
#: Look-alike characters of disguised words.
LOOKALIKE = str.maketrans("013457@$!|", "oieastasil")
DISGUISED = re.compile(r"[0-9@$!|]")
EDGES = re.compile(r"^\W+|[\W_]+$")
QUOTES = frozenset("\"'“”„‟‘’«»‹›`")
REPORTING = frozenset("said says say wrote writes called calling quoted quote quotes word words term phrase reported reads dit sagte dijo".split())
ADDRESS = frozenset("you your you're youre u ur yourself tu vous du ihr sie usted".split())
WINDOW = 4


def allowed(term: str) -> int:
    """Errors within which a term of this length still counts."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Trie:
    """The lexicon; walk() intersects it with the Levenshtein automaton of a word."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.term_at: list[int] = [-1]
        self.most = [0]  # errors that some term below allows
        heads, tails, middles = set(), set(), set()
        for n, term in enumerate(terms):
            k, at = allowed(term), 0
            for c in term:
                self.most[at] = max(self.most[at], k)
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.term_at.append(-1)
                    self.most.append(0)
                at = self.children[at][c]
            self.most[at] = max(self.most[at], k)
            self.term_at[at] = n
            # of k + 1 pieces one stays whole: the first at the start, the last at the end, or another
            cuts = [len(term) * i // (k + 1) for i in range(k + 2)]
            pieces = [term[a:b] for a, b in zip(cuts, cuts[1:])]
            heads.add(pieces[0])
            tails.add(pieces[-1])
            middles.update(pieces[1:-1])
        self.heads, self.tails = (tuple(sorted(x)) for x in (heads, tails))
        self.middle = re.compile("|".join(map(re.escape, sorted(middles)))).search if middles else lambda w: None

    def may_match(self, word: str) -> bool:
        return bool(self.terms) and (word.startswith(self.heads) or word.endswith(self.tails) or self.middle(word) is not None)

    def walk(self, word: str) -> tuple[int, int] | None:
        """(term, errors) of the term with the fewest errors, the first on ties."""
        if not self.may_match(word):
            return None
        n, k = len(word), self.most[0]
        masks: dict[str, int] = {}
        for i, c in enumerate(word):
            masks[c] = masks.get(c, 0) | 1 << (i + 1)
        full, accept = (1 << (n + 1)) - 1, 1 << n
        # bit i of states[e]: i characters of the word match the path with e errors
        start, best, stack = [(1 << (e + 1)) - 1 & full for e in range(k + 1)], None, []
        stack.append((0, start))
        while stack:
            node, states = stack.pop()
            if (t := self.term_at[node]) >= 0:
                for e in range(allowed(self.terms[t]) + 1):
                    if states[e] & accept:
                        if best is None or (e, t) < best:
                            best = (e, t)
                        break
            for c, below in self.children[node].items():
                m, new = masks.get(c, 0), []
                for e in range(self.most[below] + 1):
                    s = states[e] << 1 & m
                    if e:
                        s |= states[e - 1] | states[e - 1] << 1 | new[e - 1] << 1
                    new.append(s & full)
                if any(new):
                    stack.append((below, new + [0] * (k + 1 - len(new))))
        return (best[1], best[0]) if best else None


@dataclass
class ToxicModel:
    terms: list[str]
    strength: list[float] = field(default_factory=list)  # of each term, its log odds over the largest
    ordinary: frozenset[str] = frozenset()
    weights: np.ndarray = field(default_factory=lambda: np.zeros(6))
    bias: float = float(np.log(0.01 / 0.99))

    def __post_init__(self):
        self.trie = Trie(self.terms)
        self.cache = PieceCache(self._match, 200_000)

    def __reduce__(self):
        return ToxicModel, (self.terms, self.strength, self.ordinary, self.weights, self.bias)

    def form(self, token: str) -> str:
        word = EDGES.sub("", token.lower())
        return word.translate(LOOKALIKE) if DISGUISED.search(word) and any(c.isalpha() for c in word) else word

    def _match(self, token: str) -> tuple[float, bool] | None:
        """Strength of the term that the token is or is near to, and whether it is only near.

        A near form counts only for a strong term: weak ones are themselves half ordinary words.
        """
        word = self.form(token)
        found = self.trie.walk(word) if word else None
        if found is None or found[1] and (word in self.ordinary or self.strength[found[0]] < STRONG):
            return None
        return self.strength[found[0]], found[1] > 0

    def near_forms(self, text: str) -> set[str]:
        found = {t: self.cache[t] for t in text.split()}
        return {self.form(t) for t, hit in found.items() if hit and hit[1]}

    def features(self, text: str) -> tuple[int, list[float]]:
        tokens = text.split()
        kinds = list(map(self.cache.__getitem__, tokens))
        if not any(kinds):
            return 0, [0.0] * 6
        plain = quoted = near = near_quoted = addressed = most = 0.0
        hits = [i for i, k in enumerate(kinds) if k]
        for i in hits:
            strength, only_near = kinds[i]
            before, after = tokens[max(0, i - WINDOW):i], tokens[i + 1:i + 1 + WINDOW]
            opened = any(t[:1] in QUOTES for t in [*before, tokens[i]]) and any(t.rstrip(".,;:!?")[-1:] in QUOTES for t in [tokens[i], *after])
            around = {t.lower().strip(".,;:!?") for t in [*before, *after]}
            quote = opened and (len(around & REPORTING) > 0 or not around & ADDRESS)
            if quote:
                quoted, near_quoted = quoted + strength * (not only_near), near_quoted + strength * only_near
                continue
            addressed += strength * bool(around & ADDRESS)
            near += strength * only_near
            worth = strength * (NEAR if only_near else 1)
            plain, most = plain + worth, max(most, worth)
        return len(hits), [most**4, np.log1p(plain), np.log1p(quoted), np.log1p(near), np.log1p(near_quoted), np.log1p(addressed)]

    def score(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(rows @ self.weights + self.bias)))


#: Where the weights are drawn to for want of evidence: quotations add nothing, near forms nothing beyond their part of a hit.
PRIOR = np.array([4.0, 2.0, 0.0, 0.0, 0.0, 0.5])


def fit_logistic(x: np.ndarray, y: np.ndarray, strength: float = 1.0, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Newton steps for weights with a normal prior around PRIOR, and a free bias."""
    a, centre = np.column_stack([x, np.ones(len(x))]), np.append(PRIOR, 0.0)
    pull = np.append(strength * np.array([1, 1, 1, 20, 20, 1]), 1e-3)
    w = centre.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(pull), a.T @ (p - y) + pull * (w - centre))
        w -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text, toxic) of at most `sample` labelled training rows."""
    own = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
    picked = own.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample)  # a bounded set, safe to broadcast
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "toxic")


def _word_counts(batches):
    """Documents that hold a word, by label; the counts of one batch are summed before they leave."""
    for b in batches:
        counts = (Counter(), Counter())
        for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            counts[toxic == 1].update({w for t in text.split() if (w := EDGES.sub("", t.lower()))})
        words = list(counts[0] | counts[1])
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([counts[1][w] for w in words], pa.int64()), pa.array([counts[0][w] for w in words], pa.int64())], names=["word", "bad", "good"])


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, least: int = 8, odds: float = 20.0) -> ToxicModel:
    """Lexicon, ordinary near forms and weights from labelled rows.

    Every word enters the lexicon that `least` toxic rows and a fiftieth of them hold, and that is
    `odds` times as frequent there; so there are at most 50 times as many as distinct words in a toxic row.
    """
    text_batches(docs.sparkSession)
    rows = stored(training_rows(docs, labels, sample), "training")  # at most `sample` labels; read four times
    words = rows.mapInArrow(released(_word_counts), "word string, bad long, good long").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy((F.col("toxic") == 1).alias("toxic")).count().collect()}
    n1, n0 = sizes.get(True, 0), sizes.get(False, 0)
    if not n1 or not n0:
        drop_stored(rows)
        return ToxicModel([])
    ratio = ((F.col("bad") + 0.5) / (n1 + 1)) / ((F.col("good") + 0.5) / (n0 + 1))
    # two letters at least; a term's share of toxic rows keeps out rare words that are toxic by chance
    marked = words.where((F.col("bad") >= F.greatest(F.lit(least), F.lit(0.02 * n1))) & (ratio >= odds) & (F.char_length("word") > 1))
    found = sorted((r["word"], np.log(r["ratio"])) for r in marked.select("word", ratio.alias("ratio")).collect())
    top = max((v for _, v in found), default=1.0)
    draft = ToxicModel([w for w, _ in found], [float(v / top) for _, v in found])

    def near(batches):
        for b in batches:
            seen = Counter(w for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if toxic != 1 for w in draft.near_forms(text))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
        draft.cache.clear()

    common = rows.mapInArrow(released(near), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")  # words of the training rows, so their bound is that of `sample`
    model = ToxicModel(draft.terms, draft.strength, frozenset(r["word"] for r in common.select("word").collect()))

    def featured(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([[*model.features(t)[1], float(y == 1)] for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist())], pa.list_(pa.float64()))], names=["f"])
        model.cache.clear()

    table = np.array([r["f"] for r in rows.mapInArrow(released(featured), "f array<double>").collect()])  # at most `sample` short rows
    drop_stored(rows)
    table = table[np.lexsort(table.T)]  # sums don't depend on the order in which rows came
    weights, bias = fit_logistic(table[:, :-1], table[:, -1])
    return ToxicModel(model.terms, model.strength, model.ordinary, weights, bias)


def score_toxicity(docs: DataFrame, model: ToxicModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted, n_hits for every row of docs."""

    def run(batches):
        for b in batches:
            found = [model.features(t or "") for t in b.column(1).to_pylist()]
            s = model.score(np.array([f for _, f in found]).reshape(-1, 6))
            yield batch_of(SCORES, b.column(0), s, (s >= threshold).astype(np.int32), [n for n, _ in found])
        model.cache.clear()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(released(run), SCORES_DDL)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs whose score is below the threshold, all columns as they are."""
    model, at = learn(docs, labels, sample), docs.columns.index("text")

    def run(batches):
        for b in batches:
            s = model.score(np.array([model.features(t or "")[1] for t in b.column(at).to_pylist()]).reshape(-1, 6))
            yield b.filter(pa.array(s < threshold))
        model.cache.clear()

    return docs.mapInArrow(released(run), docs.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score_toxicity(docs, learn(docs, labels)).select("doc_id", held_out().alias("held_out"), "score", "predicted")
