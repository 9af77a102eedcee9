"""Toxicity from a weighted finite-state pattern grammar over clauses.

Words become classes (insult, mild insult, threat, target, negation, reported
speech, other).  Five small transducers rewrite the class string of a clause, and a
sixth reads off what was matched; they are composed into one machine:

* negation: an insult or threat within three words after a negation is negated;
* reported speech: one after a verb of saying, to the clause's end, is reported;
* target: one with a personal word before it in its clause is aimed;
* threat: a threat counts only when a will-word stands before it or a personal word
  after it in its clause; a personal word before it is who acts, not who is meant;
* repetition: an insult after another one, in its clause or one of the last few, is
  repeated.

A clause is one match, scored by the weight of its strongest reading.  No word scores
by itself: an insult or learned stem counts when it is aimed or repeated, and the more
lightly weighted readings are of one that is negated or reported.  Weights, and insult
stems beyond the seed list, are learned from labelled rows; other columns are never read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .licences import WORD_BYTES
from .shared import written

#: Seed lexicon by class.
INSULTS = "idiot idiots moron morons stupid loser losers scum trash pathetic worthless disgusting clown clowns imbecile retard filth vermin bastard bitch asshole cunt dumbass degenerate subhuman freak parasite parasites idiota imbécil estúpido basura abruti connard ordure débile trottel arschloch abschaum dummkopf"
THREATS = "kill hurt destroy murder stab shoot strangle burn attack beat matar töten tuer"
TARGETS = "you your youre he she they him her them his we u du dich dir ihr sie er tu toi vous il elle ils tú te usted él ella ellos"
NEGATIONS = "not no never neither nor without isnt arent wasnt dont doesnt nicht kein keine ne pas jamais nunca sin"
REPORTS = "said says say claimed claims wrote writes called quoted reported according sagte dit dijo"
WILLS = "will gonna going shall must should werde vais voy"

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, WILL, MILD = range(8)
#: Symbols after rewriting: base class plus these marks.
NEGATED, REPORTED, AIMED, REPEATED = 8, 16, 32, 64
#: The end of a clause: all states begin again but that of repetition.
END = 128
SPAN = 3  # words that a negation reaches over
REACH = 5  # clauses that a repetition reaches over
READINGS = ("repeated", "aimed", "negated", "reported", "threat", "mild")
#: Weights that learning starts from and is drawn back to.
PRIOR = {"bias": -3.0, "repeated": 3.0, "aimed": 3.5, "negated": 0.5, "reported": 0.8, "threat": 2.0, "mild": 0.7}

#: Bound of the labelled sample that stems and weights are learned from.
SAMPLE = 12_000
STEM_LENGTHS = range(3, 10)
#: Share of toxic documents among those with a stem: from here it is an insult, from there a mild one.
PRECISION, MILD_PRECISION = 0.985, 0.6
_CLAUSES = re.compile(rb"[.!?;:\n]+")


@dataclass
class Transducer:
    """Deterministic: ``arc(state, symbol) -> (next state, output symbol, weight)``."""

    arc: object
    start: object = 0
    memory: dict = field(default_factory=dict)

    def step(self, state, symbol):
        key = (state, symbol)
        if key not in self.memory:
            self.memory[key] = self.arc(state, symbol)
        return self.memory[key]

    def compose(self, other: "Transducer") -> "Transducer":
        """First this machine, then the other on its output; weights add."""

        def arc(state, symbol):
            a, middle, w = self.step(state[0], symbol)
            b, out, v = other.step(state[1], middle)
            return (a, b), out, w + v

        return Transducer(arc, (self.start, other.start))


def _hostile(symbol: int) -> bool:
    return symbol & 7 in (INSULT, THREAT, MILD)


def grammar(weights: dict[str, float]) -> Transducer:
    """The composed machine; its output is a reading's number plus one, or 0."""

    def negation(left, symbol):
        if symbol == END:
            return 0, symbol, 0.0
        if symbol & 7 == NEGATION:
            return SPAN, symbol, 0.0
        return max(0, left - 1), symbol | NEGATED * (left > 0 and _hostile(symbol)), 0.0

    def report(said, symbol):
        if symbol == END:
            return 0, symbol, 0.0
        if symbol & 7 == REPORT:
            return 1, symbol, 0.0
        return said, symbol | REPORTED * (said and _hostile(symbol)), 0.0

    def target(seen, symbol):
        if symbol == END:
            return 0, symbol, 0.0
        if symbol & 7 == TARGET:
            return 1, symbol, 0.0
        return seen, symbol | AIMED * (seen and _hostile(symbol)), 0.0

    def repetition(left, symbol):
        if symbol == END:
            return max(0, left - 1), symbol, 0.0
        if symbol & 7 not in (INSULT, MILD) or symbol & (NEGATED | REPORTED):
            return left, symbol, 0.0
        return REACH, symbol | REPEATED * (left > 0), 0.0

    def rank(symbol):
        reading = read(symbol)
        return weights[reading], READINGS.index(reading)

    def threat(state, symbol):
        """A threat without a will-word is held, the strongest of several, until a personal word follows."""
        will, held = state
        if symbol == END:
            return (0, 0), symbol, 0.0
        if symbol & 7 == WILL:
            return (1, held), symbol, 0.0
        if symbol & 7 == TARGET and held:
            return (will, 0), held, 0.0
        if symbol & 7 == THREAT and not will:
            return (will, max(held, symbol, key=rank) if held else symbol), OTHER, 0.0
        return state, symbol, 0.0

    def read(symbol):
        if symbol & NEGATED:
            return "negated"
        if symbol & REPORTED:
            return "reported"
        if symbol & 7 == THREAT:
            return "threat"
        if not symbol & (AIMED | REPEATED):
            return None
        if symbol & 7 == MILD:
            return "mild"
        return "aimed" if symbol & AIMED else "repeated"

    def insult(_, symbol):
        reading = read(symbol) if symbol != END and _hostile(symbol) else None
        return (0, READINGS.index(reading) + 1, weights[reading]) if reading else (0, 0, 0.0)

    machine = Transducer(negation)
    for arc, start in ((report, 0), (target, 0), (threat, (0, 0)), (repetition, 0), (insult, 0)):
        machine = machine.compose(Transducer(arc, start))
    return machine


class _Classes(dict):
    """Word to class, with the stems tried on words not seen before."""

    def __init__(self, stems: set[bytes], mild: set[bytes], bound: int = 200_000):
        super().__init__()
        self.fixed: dict[bytes, int] = {}
        for words, kind in ((WILLS, WILL), (REPORTS, REPORT), (NEGATIONS, NEGATION), (TARGETS, TARGET), (THREATS, THREAT), (INSULTS, INSULT)):
            for w in words.split():
                self.fixed[w.encode()] = kind
        self.stems, self.mild, self.bound = stems, mild, bound
        self.lengths = sorted({len(s) for s in stems | mild})

    def __missing__(self, word: bytes) -> int:
        if len(self) > self.bound:
            self.clear()
        kind = self.fixed.get(word)
        if kind is None:
            starts = {word[:n] for n in self.lengths}
            kind = INSULT if starts & self.stems else MILD if starts & self.mild else OTHER
        self[word] = kind
        return kind


@dataclass
class Model:
    """Learned stems and weights; small and of bounded size, so it is shipped with the tasks."""

    stems: list[bytes]
    mild: list[bytes]
    weights: dict[str, float]

    def __post_init__(self):
        self._ready = None

    def __getstate__(self):
        return {"stems": self.stems, "mild": self.mild, "weights": self.weights, "_ready": None}

    @staticmethod
    def _hostile(kinds: bytes) -> bool:
        return INSULT in kinds or MILD in kinds or THREAT in kinds

    def features(self, text: str | None) -> np.ndarray:
        """Number of clauses by their strongest reading."""
        out = np.zeros(len(READINGS))
        data = (text or "").encode("utf-8", "surrogatepass")
        if self._ready is None:
            self._ready = _Classes(set(self.stems), set(self.mild)), grammar(self.weights)
        classes, machine = self._ready
        kinds = bytes(map(classes.__getitem__, data.translate(WORD_BYTES).split()))
        if not self._hostile(kinds):
            return out
        state = machine.start
        for clause in _CLAUSES.split(data):
            kinds = bytes(map(classes.__getitem__, clause.replace(b"'", b"").translate(WORD_BYTES).split()))
            best = (-math.inf, 0)
            if self._hostile(kinds):
                for kind in kinds:
                    state, reading, weight = machine.step(state, kind)
                    if reading:
                        best = max(best, (weight, reading))
            if kinds:
                state, _, _ = machine.step(state, END)
            if best[1]:
                out[best[1] - 1] += 1
        return out

    def score(self, text: str | None) -> float:
        x = np.log1p(self.features(text))
        z = self.weights["bias"] + sum(w * v for w, v in zip((self.weights[r] for r in READINGS), x))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def held_out(doc_id="doc_id"):
    """Rows that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _stem_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per prefix of a word, documents of either label that have it."""
    counts: dict[bytes, list[int]] = {}
    for batch in batches:
        for text, toxic in zip(batch["text"], batch["toxic"]):
            words = set((text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split())
            for stem in {w[:n] for w in words for n in STEM_LENGTHS if len(w) >= n}:
                counts.setdefault(stem, [0, 0])[int(toxic)] += 1
        if len(counts) > 300_000:
            yield _frame(counts)
            counts = {}
    yield _frame(counts)


def _frame(counts: dict[bytes, list[int]]) -> pd.DataFrame:
    return pd.DataFrame({"stem": list(counts), "clean": [c[0] for c in counts.values()], "toxic": [c[1] for c in counts.values()]})


def _stems(sample: DataFrame, base: float) -> tuple[list[bytes], list[bytes]]:
    """Stems that mark toxic documents beyond chance: at high precision, and at a lower one."""
    counts = sample.mapInPandas(_stem_counts, "stem binary, clean long, toxic long").groupBy("stem").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    tried = counts.filter("toxic >= 3").count()
    least = max(4, math.ceil((math.log(max(tried, 1)) + 1) / -math.log(max(min(base, 0.5), 1e-6))))
    good = counts.filter((F.col("toxic") >= least) & (F.col("toxic") >= MILD_PRECISION * (F.col("toxic") + F.col("clean"))))
    # Prefixes that several toxic documents of the bounded sample share.
    found = {bytes(r.stem): (r.toxic, r.clean) for r in good.orderBy(F.desc("toxic"), "stem").collect()}
    sure = _widest({s: t for s, (t, c) in found.items() if t >= PRECISION * (t + c)}, set())
    return sure, _widest({s: t for s, (t, _) in found.items()}, set(sure))


def _widest(found: dict[bytes, int], known: set[bytes]) -> list[bytes]:
    """Shortest stems that no known or other stem begins; each grown while it loses almost no document."""
    out = []
    for stem in sorted(found, key=len):
        if any(stem[:n] in known for n in range(1, len(stem) + 1)):
            continue
        known.add(stem)
        grown = stem
        while longer := [t for t in found if len(t) == len(grown) + 1 and t.startswith(grown) and found[t] >= 0.95 * found[stem]]:
            grown = longer[0]
        out.append(grown)
    return sorted(out)


def _fit(x: np.ndarray, y: np.ndarray) -> dict[str, float]:
    """Logistic regression by Newton steps, drawn back to the prior; all pattern weights at least 0."""
    prior = np.array([PRIOR["bias"], *(PRIOR[r] for r in READINGS)])
    w, x = prior.copy(), np.c_[np.ones(len(x)), np.log1p(x)]
    ridge = np.diag([0.05] + [0.5] * len(READINGS))
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (p - y) + ridge @ (w - prior))
        w = w - np.clip(step, -2, 2)
        w[1:] = np.maximum(w[1:], 0)
    return dict(zip(("bias", *READINGS), w.tolist()))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from at most ``sample`` labelled rows, none of them held out.

    The sample is chosen by a hash of the id.  Null labels are left out.  With
    too few labels of either kind the seed list and the prior weights remain.
    """
    usable = labels.filter(~held_out() & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    chosen = usable.select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "toxic").limit(sample)
    # At most ``sample`` ids: a fixed bound.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # Copies of one text are one witness: near copies share their least shingle hash.
    # The words are a lambda's variable, so that they are split once.
    words = F.array(F.split(F.coalesce("text", F.lit("")), r"\s+"))
    hashes = F.transform(words, lambda w: F.array_min(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 4, F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, 5)))))
    rows = rows.groupBy(hashes[0].alias("sketch"), "toxic").agg(F.min_by("text", F.struct("doc_id", F.xxhash64("text"))).alias("text"))
    rows = written(rows.select("text", "toxic").repartition(24), "toxicity-sample")
    seen = rows.agg(F.count("*"), F.sum("toxic")).first()
    n, toxic = seen[0], seen[1] or 0
    if toxic < 4 or n - toxic < 4:
        return Model([], [], dict(PRIOR))
    model = Model(*_stems(rows, toxic / n), dict(PRIOR))

    def features(batches):
        for b in batches:
            x = np.array([model.features(t) for t in b["text"]]).reshape(-1, len(READINGS))
            yield pd.DataFrame(x, columns=list(READINGS)).assign(toxic=b["toxic"].to_numpy())

    counted = rows.mapInPandas(features, ", ".join(f"{r} double" for r in READINGS) + ", toxic int").groupBy(*READINGS, "toxic").count()
    found = counted.toPandas().sort_values([*READINGS, "toxic"])  # at most ``sample`` rows
    x = np.repeat(found[list(READINGS)].to_numpy(), found["count"], axis=0)
    return Model(model.stems, model.mild, _fit(x, np.repeat(found["toxic"].to_numpy(), found["count"])))


def score_column(model: Model):
    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype="float64")

    return scored


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``.

    Null and empty texts get the score of a text without matches.  Rows that
    repeat or lack an id are scored each; an empty table gives no rows; the
    columns besides id and text are not read.  One pass after learning.
    """
    model = learn(docs, labels, sample)
    out = docs.select("doc_id", held_out().alias("held_out"), score_column(model)("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
