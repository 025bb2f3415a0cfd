"""Toxicity by a weighted finite-state pattern grammar.

Five transducers read the words of a clause and are composed into one state: the insult transducer (forms and stems with
weights), the threat transducer (a verb of harm with a target behind it), the target transducer (the clause speaks to or of
somebody), the negation transducer (true for the ``REACH`` words behind a negation) and the reported-speech transducer
(true behind a verb of saying until the clause ends). An insult leaves the grammar with the state it was met in, so a clause
is scored, not a word: the same form counts otherwise when it is negated or quoted. A clause ends at ``. , ; : ! ?``,
wherever they stand in a run of signs. Contractions with n't negate, with a straight or a curly apostrophe.

The insult lexicon is learned from labelled rows: forms and stems (first 3 to 7 bytes) that stand out in toxic ones. The
weight of each state is learned on the same rows by logistic regression, drawn towards ``PRIOR``. Both use at most
``SAMPLE`` labelled rows; the lexicon has at most ``FORMS`` entries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import saved, table
from .quality import held_out, sample

SAMPLE = 12000
FORMS = 4096
FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
STEMS = (3, 4, 5, 6, 7)
REACH = 3
LEAST_GAIN, LEAST_WEIGHT, LEAST_ROWS = 24.0, 2.0, 4
ENDS = b".,;:!?"
# Function words of the four languages; the invented prose gives them no other meaning than their place in a clause.
NEGATION = "not never no cannot nicht kein keine nie ne pas jamais nunca tampoco".split()
REPORTED = "said says say wrote writes told quoted sagte sagt schrieb dit écrit dijo dice escribió".split()
TARGET = "you your yours he she they them him her du dich dir ihr sie vous tu toi usted ustedes ellos ellas".split()
HARM = """kill kills killed killing hurt hurts hurting beat beats beaten beating shoot shoots shot shooting stab stabs stabbed
stabbing burn burns burned burnt burning destroy destroys destroyed destroying
töten töte tötet tötete getötet schlagen schlage schlägt schlug geschlagen
tuer tuent tuez tuerai tué frapper frappe frappes frappent frappez frappé
matar mato mata matan mataré matado matando golpear golpeo golpea golpean golpearé golpeado golpeando""".split()
#: State bits: 1 target in the clause, 2 negated, 4 reported; then the threat.
STATES = 9
PRIOR = np.array([1.0, 1.2, 0.5, 0.6, 0.5, 0.6, 0.3, 0.4, 1.0])


class Grammar:
    """The composed transducers over a batch of texts; ``forms`` is sorted, ``weights`` belongs to it."""

    def __init__(self, forms: np.ndarray, weights: np.ndarray):
        self.forms, self.weights = forms, weights
        self.near = np.zeros(1 << 18, bool)
        self.near[(forms >> np.uint64(46)).astype(np.int64)] = True
        self.lists = [np.sort(np.array([W.hash_of(x) for x in names], np.uint64)) for names in (NEGATION, REPORTED, TARGET, HARM)]

    def insults(self, w: W.Words) -> tuple[np.ndarray, np.ndarray]:
        """Places of words with an accepted form or stem, and the greatest weight of each."""
        best = np.zeros(len(w.hash))
        for column in (w.hash, *w.stems.T):
            at = np.flatnonzero(self.near[(column >> np.uint64(46)).astype(np.int64)])
            found = np.minimum(np.searchsorted(self.forms, column[at]), max(len(self.forms) - 1, 0))
            if len(self.forms):
                hit = self.forms[found] == column[at]
                np.maximum.at(best, at[hit], self.weights[found[hit]])
        at = np.flatnonzero((best > 0) & (w.kind == 1))
        return at, best[at]

    def features(self, column: pa.Array) -> np.ndarray:
        """Per text, the greatest weight of an insult in each state, and whether a threat is met."""
        w = cut(column)
        n = len(w.hash)
        out = np.zeros((len(column), STATES))
        if not n:
            return out
        place, row = np.arange(n), w.row
        negation, reported, target, harm = (np.isin(w.hash, x) for x in self.lists)
        negation |= contracted(w)
        signs = np.concatenate([[0], np.cumsum(np.isin(w.data, list(ENDS)))])
        ends = (w.kind == 2) & (signs[w.end] > signs[w.start])
        opens = np.zeros(n, bool)
        opens[w.first[:-1][w.first[:-1] < n]] = True
        opens[1:] |= ends[:-1]
        clause = np.cumsum(opens) - 1
        begin = np.flatnonzero(opens)[clause]

        def last(mask):
            return np.maximum.accumulate(np.where(mask, place, -1))

        spoken_to = np.bincount(clause, target, minlength=clause[-1] + 1) > 0
        at, weight = self.insults(w)
        state = spoken_to[clause[at]] * 1
        back = last(negation)[at]
        state += ((back >= begin[at]) & (at - back <= REACH)) * 2
        state += (last(reported)[at] >= begin[at]) * 4
        np.maximum.at(out, (row[at], state), weight)
        aimed = target & (last(harm) >= begin)
        out[row[aimed], STATES - 1] = 1.0
        return out


def contracted(w: W.Words) -> np.ndarray:
    """Whether a word ends a contraction with n't: ``t`` behind an apostrophe that joins it to an ``n``, or ``n’t`` in one word."""
    out = np.zeros(len(w.hash), bool)
    t, sign = (np.uint64(W.hash_of(x)) for x in ("t", "'"))
    at = np.flatnonzero((w.hash[2:] == t) & (w.hash[1:-1] == sign)) + 2
    at = at[(w.start[at] == w.end[at - 1]) & (w.start[at - 1] == w.end[at - 2]) & (w.row[at] == w.row[at - 2])]
    out[at] = (w.data[w.end[at - 2] - 1] | 32) == ord("n")
    at = np.flatnonzero((w.kind == 1) & (w.end - w.start >= 5))
    tail = w.data[w.end[at][:, None] - np.arange(5, 0, -1)]
    tail[:, [0, 4]] |= 32
    out[at] |= (tail == np.frombuffer("n’t".encode(), np.uint8)).all(1)
    return out


def cut(column: pa.Array) -> W.Words:
    return W.words(column, W.PROSE, lower=True, stems=STEMS)


def _forms(batches):
    """Distinct forms and stems per batch, with their rows of either label."""
    for batch in batches:
        w = cut(batch["text"])
        toxic = batch["label"].to_numpy() == 1
        keep = w.kind == 1
        row = np.repeat(w.row[keep], 1 + len(STEMS))
        form = np.column_stack([w.hash, w.stems])[keep].ravel()
        order = np.lexsort((form, row))
        row, form = row[order], form[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (form[1:] != form[:-1])
        form, where = np.unique(form[new], return_inverse=True)
        bad = toxic[row[new]] if len(row) else np.zeros(0, bool)
        yield pa.RecordBatch.from_arrays([
            pa.array(form.view(np.int64)), pa.array(np.bincount(where, bad, len(form)).astype(np.int64)),
            pa.array(np.bincount(where, ~bad, len(form)).astype(np.int64)),
        ], ["form", "toxic", "clean"])


def lexicon(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted forms and their weights: log odds of toxic rows, for forms whose gain is beyond chance."""
    totals = labelled.agg(F.sum("label"), F.count("label")).first()
    bad = float(totals[0] or 0)
    good = float(totals[1]) - bad
    if not bad or not good:
        return np.zeros(0, np.uint64), np.zeros(0)
    counts = labelled.select("text", "label").mapInArrow(_forms, "form long, toxic long, clean long")
    counts = counts.groupBy("form").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).where(F.col("t") >= LEAST_ROWS)
    t, c = F.col("t").cast("double"), F.col("c").cast("double")
    weight = F.log((t + 0.5) / (bad + 1)) - F.log((c + 0.5) / (good + 1))
    share = bad / (bad + good)
    gain = 2 * (t * F.log(t / ((t + c) * share)) + F.when(c > 0, c * F.log(c / ((t + c) * (1 - share)))).otherwise(0.0))
    rows = counts.select("form", weight.alias("weight"), gain.alias("gain"))
    rows = rows.where((F.col("gain") >= LEAST_GAIN) & (F.col("weight") >= LEAST_WEIGHT))
    rows = sorted(rows.orderBy(F.desc("gain"), "form").limit(FORMS).collect(), key=lambda r: r["form"] % (1 << 64))
    return np.array([r["form"] % (1 << 64) for r in rows], np.uint64), np.array([r["weight"] for r in rows])


def state_weights(x: np.ndarray, y: np.ndarray, pull: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Logistic regression by Newton steps with a ridge towards ``PRIOR`` (scaled to one insult); the last value is the bias."""
    x = np.column_stack([x, np.ones(len(x))])
    centre = np.append(PRIOR, -4.0)
    w = centre.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        gradient = x.T @ (p - y) + pull * (w - centre)
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w)), gradient)
    return w


def trained(labelled: DataFrame) -> tuple[Grammar, np.ndarray]:
    """Grammar and state weights from rows (text, label), at most SAMPLE of them."""
    grammar = Grammar(*lexicon(labelled))

    def run(batches):
        for batch in batches:
            x = np.column_stack([grammar.features(batch["text"]), batch["label"].to_numpy()])
            yield pa.RecordBatch.from_arrays([pa.array(x[:, j]) for j in range(STATES + 1)], [f"x{j}" for j in range(STATES + 1)])

    rows = labelled.select("text", "label").mapInArrow(run, ", ".join(f"x{j} double" for j in range(STATES + 1))).toArrow()
    x = np.column_stack([c.to_numpy() for c in rows.columns]) if rows.num_rows else np.zeros((0, STATES + 1))
    return grammar, state_weights(x[:, :-1], x[:, -1])


def scored(documents: DataFrame, grammar: Grammar, weights: np.ndarray) -> DataFrame:
    """doc_id and score of every row. Null and empty texts match nothing and score as a text without clauses."""
    held = documents.sparkSession.sparkContext.broadcast((grammar, weights))

    def run(batches):
        grammar, weights = held.value
        for batch in batches:
            total = grammar.features(batch["text"]) @ weights[:-1] + weights[-1]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))], ["doc_id", "score"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and score (higher: label 1 likelier) for every row of ``documents``; repeated rows stay."""
    labelled = saved(sample(documents, labels, "toxic", FOLDS, HELD_OUT, SAMPLE), "labelled")
    return scored(documents, *trained(labelled))


def op5(spark, sf_dir: str) -> DataFrame:
    rows = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select(
        "doc_id", held_out("doc_id", FOLDS, HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
