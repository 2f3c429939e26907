"""Toxicity by a weighted grammar of finite-state transducers over the words of clauses.

Five transducers read the same clause. Insult and threat put out a weight at a word of theirs: for words and word beginnings of a
learned list the logarithm of how many times as often toxic documents of the labelled sample hold them as clean ones, and at
least 1 for words of the fixed lists, which cover some languages only. Target, negation and reported speech put out a factor at
every word: target while somebody was addressed a few words before, negation for the few words after a negating one,
reported speech for the rest of the clause after a verb of saying. The composed transducer multiplies what they put out,
so "not an idiot" and "she said idiot" weigh less than "you idiot"; its states and arcs are made as they are met.

A clause that puts out a weight is matched, and only matched clauses are scored: a document's features are, for each kind, the
most that its clauses put out at each distinct word, the number of matched clauses, and all they put out per hundred words.
A logistic regression with weights that are never negative, learned from labels, makes them a score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import ArrowUDFType, arrow_udf

from .common import Scratch, held_out, labelled, map_rows, tidy

#: Fixed word lists of the grammar, in English, French, German and Spanish.
INSULTS = "abject airhead asshole bastard bitch bonehead brainless buffoon clown contemptible coward cretin crook cunt deadbeat degenerate despicable dickhead dimwit dirtbag disgusting douchebag dumb dumbass dunce failure fool freak garbage halfwit hideous hypocrite idiot idiotic idiots ignorant imbecile incompetent jackass jerk leech liar lowlife lunatic loser losers maggot moron moronic morons nitwit numbskull parasite pathetic pest pig pigs prick punk rat repulsive retard rubbish scoundrel scum scumbag shithead simpleton sleazebag slut stupid subhuman swine thug toad trash traitor twerp twit useless vermin vile weasel weirdo whore wimp worm worthless wretch abruti connard crétin débile imbécile minable ordure salaud arschloch abschaum dummkopf idioten trottel versager widerlich wertlos asqueroso basura cabrón escoria estúpido imbécil inútil payaso pendejo".split()
THREATS = "annihilate beat burn butcher choke crush cripple destroy hang hurt kill killed maim murder punch shoot slap slaughter smash stab strangle tuer frapper töten schlagen umbringen matar golpear".split()
TARGETS = "you your yours youre u ya he she they them him her his their this these those that everyone people guy guys man woman author tu vous toi ton du dich dein sie ihr tú usted ustedes".split()
NEGATIONS = "not no never none nobody neither nor without isn aren wasn weren don doesn didn won cannot can't hardly pas jamais nicht kein keine nie sin nunca tampoco".split()
REPORTS = "said says say wrote writes called calls claimed claims quoted quote alleged reportedly according tells told accused dit sagte schrieb dijo".split()

#: What a clause can put out: insults, threats and learned words.
KINDS = ("insult", "threat", "learned")
#: Factors of the grammar's arcs, set beforehand: somebody is addressed, the word is negated, it is reported speech.
AIMED, NEGATED, REPORTED = 1.5, 0.3, 0.4
#: Words for which a target and a negation are remembered.
NEAR, SCOPE = 4, 3
#: Documents from which the learned list and the weights are learned, at most, and words whose weight a worker remembers.
SAMPLE, REMEMBERED = 20_000, 100_000
#: Lengths of the word beginnings that are learned, and how often and how many times as often toxic documents must hold one.
STEMS, LEAST, RATIO, LEXICON = (4, 5, 6), 6, 5.0, 4_000
_WORDS, _CLAUSES = re.compile(r"[^\W_]+(?:'[^\W\d_]+)?"), re.compile(r"[.!?;:\n|]+(?=\s|$)")
#: A document's features: of each kind the most that its clauses put out at each word, added up; matched clauses; and all that they
#: put out per hundred words.
WIDTH = len(KINDS) + 2


def classes() -> dict[str, str]:
    """Symbol of each listed word: I, H, T, N, R (of words on two lists the first counts)."""
    out: dict[str, str] = {}
    for symbol, words in zip("IHTNR", (INSULTS, THREATS, TARGETS, NEGATIONS, REPORTS), strict=True):
        for w in words:
            out.setdefault(w, symbol)
    return out


# The transducers: (state, symbol) -> (next state, what is put out). Learned words have the symbol L.
def insult(state: int, symbol: str) -> tuple[int, str]:
    return 0, {"I": "insult", "L": "learned"}.get(symbol, "")


def threat(state: int, symbol: str) -> tuple[int, str]:
    return 0, "threat" if symbol == "H" else ""


def target(state: int, symbol: str) -> tuple[int, float]:
    return (NEAR if symbol == "T" else max(0, state - 1)), AIMED if state else 1.0


def negation(state: int, symbol: str) -> tuple[int, float]:
    return (SCOPE if symbol == "N" else max(0, state - 1)), NEGATED if state else 1.0


def reported(state: int, symbol: str) -> tuple[int, float]:
    return int(state or symbol == "R"), REPORTED if state else 1.0


class Grammar:
    """The composition of the five; a state holds one of each."""

    PARTS = (insult, threat, target, negation, reported)
    START = (0,) * len(PARTS)

    def __init__(self, learned: dict[str, float]):
        self.symbols, self.learned = classes(), learned
        self.fatal = frozenset(w for w, s in self.symbols.items() if s in "IH")
        self.weights: dict[str, float] = {}
        self.arcs: dict[tuple, tuple[tuple, str, float]] = {}

    def step(self, state: tuple, symbol: str) -> tuple[tuple, str, float]:
        """Next state, kind and factor put out: made on first use and remembered."""
        if (arc := self.arcs.get((state, symbol))) is None:
            moved = [part(s, symbol) for part, s in zip(self.PARTS, state, strict=True)]
            factor = 1.0
            for _, out in moved[2:]:
                factor *= out
            arc = self.arcs[state, symbol] = tuple(s for s, _ in moved), moved[0][1] or moved[1][1], factor
        return arc

    def weight(self, word: str) -> float:
        """The largest weight of a learned word or beginning; 0 for others. Remembered for a bounded number of words."""
        if (found := self.weights.get(word)) is None:
            if len(self.weights) > REMEMBERED:
                self.weights.clear()
            found = self.weights[word] = max(map(self.learned.get, grams(word), [0.0] * (len(STEMS) + 1)))
        return found

    def matches(self, words: list[str]) -> list[tuple[str, str, float]]:
        """Word, kind and what is put out at each match of a clause; nothing if the clause doesn't match."""
        out = []
        state = self.START
        for w in words:
            symbol, weight = self.symbols.get(w), self.weight(w)
            weight = max(1.0, weight) if symbol else weight
            state, kind, factor = self.step(state, symbol or ("L" if weight else "O"))
            if kind:
                out.append((w, kind, weight * factor))
        return out

    def clause(self, words: list[str]) -> dict[str, float]:
        """What a clause puts out, by kind."""
        out: dict[str, float] = {}
        for _, kind, put in self.matches(words):
            out[kind] = out.get(kind, 0.0) + put
        return out

    def features(self, text: str | None) -> list[float]:
        """Those of the matched clauses of a text; zeros without any."""
        out = [0.0] * WIDTH
        low = (text or "").lower()
        words = _WORDS.findall(low)
        distinct = set(words)
        if self.fatal.isdisjoint(distinct) and not any(map(self.weight, distinct)):
            return out
        most: dict[tuple[str, str], float] = {}
        total = 0.0
        for clause in _CLAUSES.split(low):
            if found := self.matches(_WORDS.findall(clause)):
                out[-2] += 1
                for word, kind, put in found:
                    total += put
                    most[kind, word] = max(put, most.get((kind, word), 0.0))
        for (kind, _), put in most.items():
            out[KINDS.index(kind)] += put
        out[-1] = 100.0 * total / len(words)
        return out


def grams(word: str) -> list[str]:
    """The word itself, and its beginnings with a star."""
    return [word, *(word[:n] + "*" if len(word) > n else "" for n in STEMS)]


@lru_cache(maxsize=2)
def _grammar(learned: tuple) -> Grammar:
    return Grammar(dict(learned))


def scaled(x: np.ndarray) -> np.ndarray:
    return np.concatenate([np.ones((len(x), 1)), np.log1p(x)], axis=1)


def learn(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method, none but the constant below zero: what would be is left out
    and the rest fitted again. With one class or no rows, a constant score."""
    design = scaled(x)
    used = np.ones(design.shape[1], bool)
    while True:
        w, part = np.zeros(int(used.sum())), design[:, used]
        if not len(y):
            return np.zeros(design.shape[1])
        ridge = np.full(len(w), penalty)
        ridge[0] = 1e-3
        loss = lambda v: float(np.logaddexp(0, np.where(y > 0, -1, 1) * (part @ v)).sum() + (ridge * v * v).sum() / 2)  # noqa: E731, B023
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(part @ w, -30, 30)))
            step = np.linalg.solve((part * (p * (1 - p))[:, None]).T @ part + np.diag(ridge), part.T @ (y - p) - ridge * w)
            while loss(w + step) > loss(w) and np.abs(step).max() > 1e-8:
                step = step / 2
            w = w + step
            if np.abs(step).max() < 1e-8:
                break
        out = np.zeros(design.shape[1])
        out[used] = w
        if (out[1:] >= 0).all():
            return out
        used &= np.concatenate([[True], out[1:] >= 0])


def lexicon(rows: DataFrame) -> tuple:
    """Learned words and beginnings with their weights, from the labelled sample (doc_id, text, y): counts of documents that
    hold each, and of those toxic ones hold at least LEAST times and RATIO times as often, the LEXICON heaviest."""

    def count(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            seen: dict[str, list[int]] = {}
            for text, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                for g in {g for w in set(_WORDS.findall((text or "").lower())) for g in grams(w)}:
                    seen.setdefault(g, [0, 0])[y == 1] += 1
            yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array([x[1] for x in seen.values()], pa.int64()), pa.array([x[0] for x in seen.values()], pa.int64())], names=["gram", "toxic", "clean"])

    sizes = rows.agg(F.count_if(F.col("y") == 1), F.count_if(F.col("y") == 0)).first()
    grown = rows.mapInArrow(tidy(count), "gram string, toxic bigint, clean bigint").groupBy("gram").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    ratio = (F.col("t") / max(1, sizes[0])) / ((F.col("c") + 1) / max(1, sizes[1]))
    best = grown.where((F.col("gram") != "") & (F.col("t") >= LEAST)).withColumn("r", ratio).where(F.col("r") >= RATIO).orderBy(F.desc("r"), F.desc("t"), "gram").limit(LEXICON)
    return tuple(sorted((r["gram"], float(np.log(r["r"]))) for r in best.collect()))


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, text: str = "text") -> tuple[tuple, list[float]]:
    """The learned list and the weights, from a bounded sample; the same rows give the same fit."""
    scratch = Scratch(docs.sparkSession)
    rows = labelled(docs, labels, "toxic", 5, 0, most, text, scratch)
    learned = lexicon(rows)
    found = map_rows(rows, lambda b: {"id": b.column(0), "x": [_grammar(learned).features(t) for t in b.column(1).to_pylist()], "y": b.column(2)}, "id bigint, x array<double>, y int").collect()  # `most` rows at most
    scratch.free(rows)
    found.sort(key=lambda r: r["id"])
    return learned, learn(np.array([r["x"] for r in found]).reshape(len(found), WIDTH), np.array([r["y"] == 1 for r in found], float)).tolist()


def logits(texts: list[str | None], learned: tuple, weights: list[float]) -> np.ndarray:
    grammar = _grammar(learned)
    return scaled(np.array([grammar.features(t) for t in texts]).reshape(len(texts), WIDTH)) @ np.array(weights)


def score(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, text: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row. A null or empty text matches nothing and gets the score of no
    match; whole texts, however long; repeated rows give repeated results; without labels every score is 0.5 and, as nothing
    speaks for toxic, every prediction 0; other columns are ignored; an empty table gives an empty result."""
    learned, weights = fit(docs, labels, most, text)

    def run(batch: pa.RecordBatch) -> dict:
        z = logits(batch.column(1).to_pylist(), learned, weights)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return {"doc_id": batch.column(0), "held_out": batch.column(2), "score": p, "predicted": (z > 0).astype(np.int32)}

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return map_rows(rows.withColumn("h", held_out(F.col("doc_id"), 5, 0)), run, "doc_id bigint, held_out boolean, score double, predicted int", rows=512)


def flagged(docs: DataFrame, labels: DataFrame, name: str = "toxic", text: str = "text", most: int = SAMPLE) -> DataFrame:
    """The rows of docs, all columns, with a further column (0 or 1) by the text of each row itself; only texts go to Python.
    A table that has a column of that name is an error. Nulls, empty and long texts, repeated rows, and tables without labels or
    rows are as in score."""
    if name in docs.columns:
        raise ValueError(f"there is a column {name} already")
    learned, weights = fit(docs, labels, most, text)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [(logits(batch.slice(at, 512).to_pylist(), learned, weights) > 0).astype(np.int32) for at in range(0, len(batch), 512)]
            yield pa.array(np.concatenate([np.empty(0, np.int32), *parts]), pa.int32())

    return docs.withColumn(name, arrow_udf(tidy(run), "int", ArrowUDFType.SCALAR_ITER)(F.col(text).cast("string")))
