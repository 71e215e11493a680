"""The composed grammar against what its parts mean, over all short clauses and random longer ones."""

import itertools
import random

from strandloom.llm import toxicity
from strandloom.llm.toxicity import FUTURE, INSULT, NEGATION, OTHER, REPORT, SPEAKER, TARGET, THREAT

CLASSES = (INSULT, THREAT, TARGET, SPEAKER, FUTURE, NEGATION, REPORT, OTHER)


def meant(tokens):
    """What a clause says, by looking back from each token."""

    def verb_open(i):
        return any(tokens[j] == THREAT and TARGET not in tokens[j + 1 : i] for j in range(max(0, i - 3), i))

    def spoke(j):
        return tokens[j] == SPEAKER and not verb_open(j)

    def speaker_open(i):  # somebody speaks of himself, and neither plans nor threatens yet
        return any(spoke(j) and not {FUTURE, THREAT} & set(tokens[j + 1 : i]) for j in range(max(0, i - 4), i)) and not verb_open(i)

    def plan_open(i):
        for f in range(max(0, i - 4), i):
            between = range(f + 1, i)
            if tokens[f] == FUTURE and speaker_open(f) and not any(tokens[k] == THREAT or spoke(k) for k in between):
                return not verb_open(i)
        return False

    out, total = [], 0.0
    for i, token in enumerate(tokens):
        label = weight = None
        if token == INSULT:
            if i and tokens[i - 1] == INSULT:
                label, weight = "insult-chained", 1.25
            elif any(tokens[j] == TARGET and INSULT not in tokens[j + 1 : i] for j in range(max(0, i - 3), i)):
                label, weight = "insult-aimed", 1.5
            else:
                label, weight = "insult-bare", 1.0
        elif token == THREAT:
            label, weight = ("threat-announced", 1.0) if plan_open(i) else ("threat-bare", 0.5)
        elif token == TARGET and verb_open(i):
            label, weight = "threat-aimed", 1.5
        if label:
            context = "reported" if REPORT in tokens[:i] else "negated" if NEGATION in tokens[max(0, i - 3) : i] else "plain"
            out.append((label, context, weight))
            total += weight
    return out + [("", "targeted", total)] * bool(out and TARGET in tokens)


def test_every_clause_of_up_to_five_tokens():
    grammar = toxicity.ClauseGrammar()
    for n in range(6):
        for tokens in itertools.product(CLASSES, repeat=n):
            assert grammar.run([(k, 1.0) for k in tokens]) == meant(tokens), tokens


def test_random_longer_clauses():
    grammar, rng = toxicity.ClauseGrammar(), random.Random(1)
    for _ in range(20_000):
        tokens = tuple(rng.choice(CLASSES) for _ in range(rng.randint(6, 14)))
        assert grammar.run([(k, 1.0) for k in tokens]) == meant(tokens), tokens
