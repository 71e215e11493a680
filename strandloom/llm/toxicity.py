"""Toxicity by a weighted finite-state grammar over clauses.

Five transducers read a clause's tokens as classes (insult, threat, target,
speaker, future, negation, reported speech, other).  The insult transducer tells
bare, aimed (a target shortly before) and chained insults apart; the threat
transducer bare threats from announced ones (speaker and future before the verb)
and aimed ones (a target after it); each transition that finds something has a
label and a weight.  The other three say in which context: how long a negation
still reaches, whether speech is reported, whether a target was named.  Their
composition scores matched clauses by label and context, not single words.

The insult lexicon (words and word stems with log-odds weights) and the weights
of labels and contexts are learned from labelled rows.  At most ``max_rows``
labelled rows, taken by hash of their id, are used: a bound on what the model is
fitted to, not on what is scored.  Near copies in the training rows count once
(by the smallest hash of their 5-word runs).

Nulls and edge cases: a null or empty text scores like any text without matched
clauses; null labels are not learned from; of rows that share a labelled
``doc_id`` one (the smallest text) is learned from; without labels of both kinds
every score is the share of toxic labels (0 if there are none); repeated rows
score alike; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import logging
import math
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.hashing import WordHasher, run_hashes
from strandloom.llm.shared import free_worker, id_and_text, slices, with_rest, without_rest

#: Token classes.
INSULT, THREAT, TARGET, SPEAKER, FUTURE, NEGATION, REPORT, OTHER = "insult threat target speaker future negation report other".split()

#: Words of the closed classes, for the four languages of the corpus.
WORDS = {
    TARGET: "you your yourself they them their du dich dir dein euch ihr sie tu te toi ton vous votre ti usted ustedes vosotros ellos",
    SPEAKER: "i we ich wir je nous yo nosotros",
    FUTURE: "will going gonna shall ll must werde werden muss vais allons veux voy vamos quiero",
    NEGATION: "not never neither nor cannot nicht kein keine niemals jamais aucun nunca tampoco",
    REPORT: "said says told wrote claimed quoted sagte sagt schrieb behauptete dit disait écrit dijo dice escribió",
    THREAT: "kill murder hurt destroy beat shoot burn töten umbringen vernichten schlagen tuer détruire frapper brûler matar destruir golpear quemar",
}
_CLASS_OF = {word: kind for kind, text in WORDS.items() for word in text.split()}
_WORD = re.compile(r"\w+")
_CLAUSE_END = re.compile(r"[.!?;:\n]")

#: Tokens that a negation, a target before an insult, a speaker, and a threat's verb reach.
NEGATION_REACH, TARGET_REACH, SPEAKER_REACH, VERB_REACH = 3, 3, 4, 3

LABELS = ["insult-bare", "insult-aimed", "insult-chained", "threat-bare", "threat-announced", "threat-aimed"]
#: How much of a label's weight counts for its kind as a whole, by context.
CONTEXTS = {"plain": 1.0, "negated": 0.4, "reported": 0.6}
#: Sums by kind, so that a label or context that no training row has still counts; and apart.
FEATURES = [INSULT, THREAT] + [f"{label}-{context}" for label in LABELS for context in CONTEXTS]
FEATURES += ["targeted", "clauses", "density"]

State = str | tuple[str, int]


@dataclass(frozen=True)
class Transducer:
    """Transitions ``(state, class) -> (state, label, weight)``; an empty label says nothing.

    A state ``(name, n)`` reaches ``n`` more tokens: without a transition of its
    own it becomes ``(name, n - 1)``, and at last the start.  A plain name stays.
    Transitions are looked up by the state's name.
    """

    start: str
    moves: dict[tuple[str, str], tuple[State, str, float]]

    def step(self, state: State, kind: str) -> tuple[State, str, float]:
        name = state[0] if isinstance(state, tuple) else state
        found = self.moves.get((name, kind))
        if found is None and isinstance(state, tuple):
            found = ((name, state[1] - 1) if state[1] > 1 else self.start, "", 0.0)
        return found or (state, "", 0.0)


def insult_transducer(reach: int = TARGET_REACH) -> Transducer:
    aimed, after = ("aimed", reach), ("after", 1)
    return Transducer(
        "none",
        {(name, TARGET): (aimed, "", 0.0) for name in ("none", "aimed", "after")}
        | {
            ("none", INSULT): (after, "insult-bare", 1.0),
            ("aimed", INSULT): (after, "insult-aimed", 1.5),
            ("after", INSULT): (after, "insult-chained", 1.25),
        },
    )


def threat_transducer(speaker: int = SPEAKER_REACH, verb: int = VERB_REACH) -> Transducer:
    said = {(name, SPEAKER): (("speaker", speaker), "", 0.0) for name in ("none", "speaker", "plan")}
    return Transducer(
        "none",
        said
        | {
            ("speaker", FUTURE): (("plan", speaker), "", 0.0),
            ("none", THREAT): (("verb", verb), "threat-bare", 0.5),
            ("speaker", THREAT): (("verb", verb), "threat-bare", 0.5),
            ("plan", THREAT): (("verb", verb), "threat-announced", 1.0),
            ("verb", THREAT): (("verb", verb), "threat-bare", 0.5),
            ("verb", TARGET): ("none", "threat-aimed", 1.5),
        },
    )


def negation_transducer(reach: int = NEGATION_REACH) -> Transducer:
    return Transducer("none", {(name, NEGATION): (("negated", reach), "", 0.0) for name in ("none", "negated")})


def latch_transducer(kind: str, name: str) -> Transducer:
    """In state ``name`` after the first token of ``kind`` in a clause."""
    return Transducer("none", {("none", kind): (name, "", 0.0)})


class ClauseGrammar:
    """Composition of the transducers; states are tuples, built as they are met."""

    def __init__(self) -> None:
        self.parts = (
            insult_transducer(),
            threat_transducer(),
            negation_transducer(),
            latch_transducer(REPORT, "reported"),
            latch_transducer(TARGET, "targeted"),
        )
        self.start = tuple(p.start for p in self.parts)
        self._moves: dict[tuple[tuple[State, ...], str], tuple] = {}

    def _step(self, state: tuple[State, ...], kind: str) -> tuple[tuple[State, ...], list[tuple[str, float]], str]:
        """Next state, what the step says, and the context in which it says so."""
        key = (state, kind)
        if key not in self._moves:
            steps = [p.step(s, kind) for p, s in zip(self.parts, state)]
            context = "reported" if state[3] == "reported" else "negated" if state[2] != "none" else "plain"
            self._moves[key] = (tuple(s for s, _, _ in steps), [(label, w) for _, label, w in steps if label], context)
        return self._moves[key]

    def run(self, tokens: list[tuple[str, float]]) -> list[tuple[str, str, float]]:
        """``(label, context, weight)`` of all that a clause says; "targeted" is extra.

        A token's own weight (an insult's, from the lexicon) multiplies the transition's.
        """
        state, out, total = self.start, [], 0.0
        for kind, weight in tokens:
            state, said, context = self._step(state, kind)
            for label, factor in said:
                made = factor * (weight if kind == INSULT else 1.0)
                out.append((label, context, made))
                total += made
        if state[4] == "targeted" and out:
            out.append(("", "targeted", total))
        return out


class ClauseScorer:
    """Features of texts: weights of matched clauses by kind and context."""

    def __init__(self, lexicon: list[tuple[str, bool, float]]):
        import ahocorasick

        self._terms = {}
        self._automaton = ahocorasick.Automaton()
        for term, is_stem, weight in lexicon:
            self._automaton.add_word(term, (len(term), is_stem, weight))
        for word in WORDS[THREAT].split():
            if word not in self._automaton:
                self._automaton.add_word(word, (len(word), False, 1.0))
        self._automaton.make_automaton()
        self._grammar = ClauseGrammar()

    def _found(self, text: str) -> dict[int, float]:
        """Where matched words begin, with the largest weight there."""
        found: dict[int, float] = {}
        for last, (size, is_stem, weight) in self._automaton.iter(text):
            begin = last + 1 - size
            if begin and (text[begin - 1].isalnum() or text[begin - 1] == "_"):
                continue
            if not is_stem and last + 1 < len(text) and (text[last + 1].isalnum() or text[last + 1] == "_"):
                continue
            found[begin] = max(weight, found.get(begin, weight))
        return found

    def features(self, text: str) -> np.ndarray:
        out = np.zeros(len(FEATURES))
        text = text.lower()
        found = self._found(text)
        if not found:
            return out
        sums: dict[str, float] = defaultdict(float)
        clauses: dict[tuple[int, int], None] = {}
        done = 0
        for begin in sorted(found):
            if begin < done:
                continue
            first = max(text.rfind(mark, 0, begin) for mark in ".!?;:\n") + 1
            stop = _CLAUSE_END.search(text, begin)
            done = stop.start() if stop else len(text)
            clauses[first, done] = None
        for first, done in clauses:
            tokens = []
            for m in _WORD.finditer(text, first, done):
                kind, weight = _CLASS_OF.get(m[0], OTHER), found.get(m.start(), 0.0)
                if m.start() in found and kind != THREAT:
                    kind = INSULT
                tokens.append((kind, weight))
            for label, context, weight in self._grammar.run(tokens):
                if context == "targeted":
                    sums["targeted"] += weight
                else:
                    sums[f"{label}-{context}"] += weight
                    sums[label.split("-")[0]] += weight * CONTEXTS[context]
        total = sums[INSULT] + sums[THREAT]
        sums["clauses"], sums["density"] = len(clauses), total / math.log(2 + len(text))
        for k, name in enumerate(FEATURES):
            out[k] = math.log1p(max(0.0, sums.get(name, 0.0)))
        return out


@dataclass(frozen=True)
class ToxicityModel:
    lexicon: list[tuple[str, bool, float]]
    weights: list[float]
    bias: float


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """``doc_id, text, toxic`` of at most ``max_rows`` labelled documents, never held out."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") > 0).cast("int").alias("toxic")
    )
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    found = docs.join(F.broadcast(sample), "doc_id")  # at most max_rows rows of two numbers
    # One row for each id: rows that share one would be as many as the table has.
    return found.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


def learn_lexicon(rows: DataFrame, least_share: float, longest_stem: int | None = 9) -> list[tuple[str, bool, float]]:
    """Words and stems that mark toxic rows, with smoothed log-odds weights."""

    def vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        hasher = WordHasher(5)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for cut in slices(texts):
                words, bounds = hasher.words(texts[cut])
                runs = run_hashes(words, 5).view(np.int64)
                families = [
                    int(runs[a : b - 4].min()) if b - a >= 5 else zlib.crc32(t.encode()) for a, b, t in zip(bounds[:-1], bounds[1:], texts[cut])
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(families, pa.int64()),
                        batch.column(1)[cut.start : cut.stop],
                        pa.array([sorted(set(_WORD.findall(t.lower()))) for t in texts[cut]], pa.list_(pa.string())),
                    ],
                    names=["family", "toxic", "words"],
                )

    kept = rows.select("text", "toxic").mapInArrow(vocabulary, "family long, toxic int, words array<string>")
    kept = kept.groupBy("family", "toxic").agg(F.min("words").alias("words")).cache()
    totals = kept.agg(F.sum("toxic").alias("toxic"), F.count("*").alias("rows")).first()
    toxic = totals["toxic"] or 0
    clean = totals["rows"] - toxic
    if not toxic or not clean:
        kept.unpersist()
        return []
    words = kept.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(
        F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")
    )
    words = words.cache()
    # Chance agreement grows with the number of terms that are tried.
    least_evidence = math.log(words.count()) + 2
    longest = F.char_length("word") if longest_stem is None else F.least(F.char_length("word"), F.lit(longest_stem))
    stem_sizes = F.sequence(F.lit(4), F.greatest(longest, F.lit(4)))
    stems = (
        words.where(F.char_length("word") >= 4)
        .select("t", "c", "word", F.explode(stem_sizes).alias("size"))
        .groupBy(F.expr("substring(word, 1, size)").alias("term"))
        .agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
        .withColumn("is_stem", F.lit(True))
    )
    terms = words.where(F.char_length("word") >= 3).select(F.col("word").alias("term"), "t", "c", F.lit(False).alias("is_stem"))
    base = toxic / (toxic + clean)
    share = F.col("t") / (F.col("t") + F.col("c"))
    evidence = F.col("t") * F.log(share / base) + F.when(F.col("c") > 0, F.col("c") * F.log((1 - share) / (1 - base))).otherwise(0.0)
    weight = F.log((F.col("t") + 0.5) / (toxic + 1.0)) - F.log((F.col("c") + 0.5) / (clean + 1.0))
    found = (
        terms.unionByName(stems)
        .where((F.col("t") > 0) & (share >= least_share))
        .where(evidence >= least_evidence)
        .select("term", "is_stem", weight.alias("weight"), evidence.alias("evidence"))
        .collect()  # terms that several of the max_rows rows have
    )
    words.unpersist()
    kept.unpersist()
    # A term and its extensions count the same rows, so one of each chain is kept:
    # that of most evidence; among equals the longest, and a stem before a word.
    lexicon: list[tuple[str, bool, float]] = []
    for row in sorted(found, key=lambda r: (-round(r["evidence"], 6), -len(r["term"]), not r["is_stem"])):
        if not any(t.startswith(row["term"]) or row["term"].startswith(t) for t, _, _ in lexicon):
            lexicon.append((row["term"], row["is_stem"], float(row["weight"])))
    return lexicon


def fit_weights(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2, rounds: int = 50) -> tuple[list[float], float]:
    """Ridge-penalised logistic regression by Newton steps."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    ridge = np.diag([penalty] * x.shape[1] + [1e-6]) * len(x)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge + 1e-9 * np.eye(len(w)), z.T @ (p - y) + ridge @ w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1].tolist(), float(w[-1])


def _feature_map(lexicon: list[tuple[str, bool, float]]):
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = ClauseScorer(lexicon)
        for batch in batches:
            made = [scorer.features(t).tolist() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(made, pa.list_(pa.float64()))], names=["toxic", "x"])

    return features


def fit(
    docs: DataFrame,
    labels: DataFrame,
    max_rows: int = 20_000,
    least_share: float = 0.5,
    longest_stem: int | None = 9,
) -> ToxicityModel:
    """Learn lexicon and context weights; ``docs`` has ``doc_id, text``.

    Stems have up to ``longest_stem`` letters, or any number where it is None.
    """
    rows = training_rows(docs, labels, max_rows)
    lexicon = learn_lexicon(rows, least_share, longest_stem)
    made = rows.select("text", "toxic").mapInArrow(_feature_map(lexicon), "toxic int, x array<double>").collect()  # max_rows at most
    y = np.array([r["toxic"] for r in made], dtype=float)
    share = float(y.mean()) if len(y) else 0.0
    if not lexicon or share in (0.0, 1.0):
        return ToxicityModel([], [0.0] * len(FEATURES), math.log(max(share, 1e-9) / max(1 - share, 1e-9)))
    weights, bias = fit_weights(np.array([r["x"] for r in made]), y)
    return ToxicityModel(lexicon, weights, bias)


def score(docs: DataFrame, model: ToxicityModel, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """Columns ``keep`` of every row and its ``score`` in 0..1.

    The text crosses to Python once, whether it is kept or not.
    """
    weights, bias, lexicon = np.array(model.weights), model.bias, model.lexicon
    names = [f"_{k}" for k in range(len(keep))]
    own = names[keep.index(text_col)] if text_col in keep else "_text"
    sent = [F.col(c).alias(n) for c, n in zip(keep, names)] + [F.col(text_col).alias("_text")] * (own == "_text")
    sent_docs = docs.select(*sent)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        scorer = ClauseScorer(lexicon)
        for batch in batches:
            x = np.array([scorer.features(t or "") for t in batch.column(own).to_pylist()]).reshape(-1, len(FEATURES))
            made = 1 / (1 + np.exp(-np.clip(x @ weights + bias, -30, 30)))
            yield pa.RecordBatch.from_arrays(batch.columns[: len(names)] + [pa.array(made)], names=[*names, "score"])

    schema = sent_docs.select(*names).schema.add("score", "double")
    scored = sent_docs.mapInArrow(scores, schema)
    return scored.select(*[F.col(n).alias(c) for c, n in zip(keep, names)], "score")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **bounds: float) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of all rows; held-out labels are never learned from."""
    model = fit(id_and_text(docs), labels, **bounds)
    return score(docs, model).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **bounds: float) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score below ``threshold``.

    Where the labels teach no word that marks toxic rows, a score says nothing
    about a row: all rows stay, and a warning says so.
    """
    model = fit(id_and_text(docs), labels, **bounds)
    if not model.lexicon:
        logging.getLogger(__name__).warning("the labels teach no toxic words: no document is dropped")
        return docs
    kept = score(with_rest(docs), model, ("doc_id", "text", "rest")).where(F.col("score") < threshold)
    return without_rest(kept, docs.columns)
