import json
import random

from lathework.llm import pairs as p

NOUNS = "ledger invoice tempo chorus league referee recipe oven voucher itinerary lockfile compiler verdict subpoena dosage infusion".split()
EN = ["The {a} is dropped when the {b} is empty.", "Saving a {a} twice leaves the {b} in a stale state.", "Nobody could explain why the {a} was locked after the {b}."]
EN_FIX = ["The fix keeps the {a} and only then updates the {b}.", "I added a guard in src/x.py and a test that covers an empty {a}.", "All 12 tests in the touched module pass now."]
DE = ["Nach dem zweiten Speichern verschwindet {a} aus der Liste, und {b} ist leer.", "Der Fehler tritt nur auf, wenn {a} leer ist."]
DE_FIX = ["Ich habe in src/x.py eine Prüfung ergänzt und einen Test für {a} geschrieben.", "Jetzt bleibt {a} erhalten, und {b} wird erst danach aktualisiert."]


def say(rng, forms, n):
    return " ".join(rng.choice(forms).format(a=rng.choice(NOUNS), b=rng.choice(NOUNS)) for _ in range(n))


def sample(n, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        s, f = (DE, DE_FIX) if rng.random() < 0.25 else (EN, EN_FIX)
        out.append((say(rng, s, rng.randint(1, 4)), say(rng, f, rng.randint(1, 4))))
    return out


def test_held_out_accuracy():
    import numpy as np

    model = p.train(sample(700, 1))
    made = p.made_defective(sample(300, 2), np.random.default_rng(5))
    right = total = 0
    for answer, statement, note, diff, label in made:
        if label == 3:
            continue
        total += 1
        right += p.verdict(model, answer, note, diff, statement) == (p.LABELS[label] if label >= 0 else None)
    assert right / total >= 0.97


def test_reading_answers():
    lines = [json.dumps({"type": "message", "text": t}) for t in ("first", "last")] + ['{"type": "turn.completed"}', '{"type": "mess']
    assert p.answer_of("\n".join(lines), "jsonl") == "last"
    assert p.answer_of("plain text", "plain") == "plain text" and p.answer_of(None, "plain") == "" and p.answer_of("", None) == ""
    assert not p.worded("```\n```") and p.worded("ok")


def test_given_back():
    s = p.Statement("The ledger is dropped when the invoice is empty. Nothing else depends on it.")
    assert p.given_back("THE LEDGER IS DROPPED WHEN THE INVOICE IS EMPTY.", s).mine == 1
    whole = p.given_back("Here is the task: The ledger is dropped when the invoice is empty. Nothing else depends on it.", s)
    assert whole.theirs == 1 and whole.extra == 4
    assert p.given_back("> The ledger is dropped when the invoice is empty.\n\nThe fix keeps the order and only then updates the view. All tests pass now, and no public signature changes.", s).mine < 0.5
    assert p.given_back("", s) == (0, 0, 0) and p.given_back("The ledger", p.Statement(None)).theirs == 0


def test_the_closest_sentence_is_found_without_comparing_all():
    from collections import Counter

    rng = random.Random(6)
    s = p.Statement(" ".join(say(rng, EN, 1) for _ in range(60)))
    for _ in range(200):
        words = list(rng.choice(s.sentences)) if rng.random() < 0.7 else [rng.choice(NOUNS) for _ in range(6)]
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = rng.choice(["new", "the", "is"])
        best = max((Counter(words) & Counter(t)).total() for t in s.sentences if len(t) <= 3 * len(words))
        assert s.closest(tuple(words)) == (best if best >= 0.8 * len(words) - 1e-9 else 0)


def test_scores_are_calibrated():
    import numpy as np

    rng = np.random.default_rng(1)
    scores = rng.normal(0, 3, 5000)
    truth = rng.random(5000) < 1 / (1 + np.exp(-(0.5 * scores - 1)))
    a, b = p.calibrated(scores, truth)
    assert abs(a - 0.5) < 0.05 and abs(b + 1) < 0.15 and p.calibrated(scores, truth & False) == (1.0, 0.0)


def test_each_defect_is_found_on_held_out_pairs():
    found = p.held_out(p.train(sample(700, 1)), sample(300, 8))
    assert all(n > 20 and both >= 0.95 * n and both >= 0.95 * told for n, told, both in found.values()), found


def test_defects_of_tables(spark):
    diff = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1 +1 @@\n-a\n+b\n"
    rng = random.Random(3)
    rows, items = [], []
    for i, (statement, answer) in enumerate(sample(400, 4)):
        items.append((f"i{i}", statement, 1))
        rows.append((f"a{i}", f"i{i}", "s", diff, answer))
    rows += [("empty", "i0", "s", None, " "), ("refusal", "i1", "s", None, "I'm sorry, but I can't help with this one."), ("copy", "i2", "s", None, items[2][1]), ("cut", "i3", "s", diff[:-4], "Fine."), ("free", None, "s", None, say(rng, EN_FIX, 2)), (None, None, None, None, None)]
    attempts = spark.createDataFrame(rows + rows[-6:], "attempt_id string, instance_id string, solver_id string, model_patch string, raw_output string").selectExpr("*", "cast(null as string) stderr_output", "1 as statement", "2 as defect")
    solvers = spark.createDataFrame([("s", "plain")], "solver_id string, output_format string")
    table = spark.createDataFrame([*items, ("i0", None, 0), (None, None, None)], "instance_id string, problem_statement string, ingested_at int")
    found = {r[0]: r[1] for r in p.defects(attempts, solvers, table).collect()}
    assert {k: found.get(k) for k in ("empty", "refusal", "copy", "cut", "free")} == {"empty": "empty", "refusal": "refusal", "copy": "copy", "cut": "truncated", "free": None}
    assert sum(k.startswith("a") for k in found) <= 8
    assert p.defects(attempts.limit(0), solvers, table).count() == 0
    assert p.defects(attempts.filter("attempt_id = 'empty'"), solvers, table.limit(0)).collect()[0][1] == "empty"
