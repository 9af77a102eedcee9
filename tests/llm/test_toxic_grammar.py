"""The composed machine against a plain evaluation of its rules, and odd tables."""

import random

import numpy as np
from pyspark.sql import functions as F

from keyloom.llm import toxicity as T

WORDS = {T.INSULT: "idiot", T.THREAT: "hurt", T.TARGET: "you", T.NEGATION: "never", T.REPORT: "said", T.WILL: "will", T.MILD: "grubby", T.OTHER: "tree"}
MODEL = T.Model([], [b"grub"], dict(T.PRIOR))


def slow(clauses):
    """Number of clauses by their strongest reading, rule by rule."""
    out = np.zeros(len(T.READINGS))
    left = 0
    for clause in clauses:
        found = []
        for i, kind in enumerate(clause):
            if kind not in (T.INSULT, T.MILD, T.THREAT):
                continue
            negated = T.NEGATION in clause[max(0, i - T.SPAN) : i]
            reported = T.REPORT in clause[:i]
            aimed = T.TARGET in clause[:i]
            repeated = left > 0
            if kind != T.THREAT and not negated and not reported:
                left = T.REACH
            other = "negated" if negated else "reported" if reported else None
            if kind == T.THREAT:
                if T.WILL in clause[:i] or T.TARGET in clause[i + 1 :]:
                    found.append(other or "threat")
            elif other or aimed or repeated:
                found.append(other or ("mild" if kind == T.MILD else "aimed" if aimed else "repeated"))
        if clause:
            left = max(0, left - 1)
        if found:
            out[T.READINGS.index(max(found, key=lambda r: T.PRIOR[r]))] += 1
    return out


def test_machine_equals_the_rules():
    r = random.Random(12)
    for _ in range(6000):
        clauses = [[r.choice(list(WORDS)) for _ in range(r.randint(0, 7))] for _ in range(r.randint(1, 9))]
        text = ". ".join(" ".join(WORDS[k] for k in c) for c in clauses)
        assert (MODEL.features(text) == slow(clauses)).all(), text


def test_no_word_scores_alone():
    for text in ("What an idiot.", "grubby", "The word moron is old.", "kill", "scum. " + "A tree. " * 20 + "trash."):
        assert MODEL.score(text) == MODEL.score("")
    for text in ("you idiot", "an idiot and a moron", "idiot. moron."):
        assert MODEL.score(text) > MODEL.score("")


def test_odd_tables(spark):
    long = "tree " * 200_000 + "you idiot"
    rows = [(1, long), (1, long), (None, "you idiot"), (2, ""), (3, None)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit(9) for c in ("toxic", "score", "sketch", "held_out", "predicted")})
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    out = T.toxicity(d, none).collect()
    assert [c for c in out[0].asDict()] == ["doc_id", "held_out", "score", "predicted"] and len(out) == 5
    assert {r.predicted for r in out if r.doc_id in (1, None)} == {1} and {r.predicted for r in out if r.doc_id in (2, 3)} == {0}
    some = spark.createDataFrame([(k, 1, k % 2) for k in range(20)], "doc_id bigint, quality int, toxic int")
    assert T.toxicity(d.withColumn("toxic", F.lit("x")), some).count() == 5
