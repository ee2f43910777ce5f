import random

import numpy as np
import pandas as pd

from lathework.llm import subjects as s

WORDS = {"law": "verdict subpoena plaintiff clause affidavit".split(), "music": "encore metronome chorus setlist tempo".split(), "food": "broth oven dough recipe spice".split()}
FORMS = ["The {a} is dropped when the {b} is empty.", "Saving a {a} twice leaves the {b} in a stale state.", "Show the {a} beside the {b} on small screens."]


def text(rng, kinds, n):
    return " ".join(rng.choice(FORMS).format(a=rng.choice(WORDS[k]), b=rng.choice(WORDS[k])) for i in range(n) for k in [kinds[i % len(kinds)]])


def test_subjects_of_made_texts(spark):
    rng = random.Random(1)
    rows, truth = [], {}
    for i in range(600):
        kinds = rng.sample(sorted(WORDS), 2) if i % 5 == 0 else [rng.choice(sorted(WORDS))]
        truth[i] = set(kinds)
        aside = f" Think of it as the {rng.choice(WORDS[rng.choice(sorted(WORDS))])} of this module." if i % 3 == 0 else ""
        rows.append((i, text(rng, kinds, 6) + " Please rebase." + aside, "en", 1))
    rows += [(1000, None, None, None), (1001, " ", None, 2), (None, "The verdict is empty.", "en", 3), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, voice int")
    labels = spark.createDataFrame([(i, k) for i in range(0, 600, 6) for k in truth[i]] + [(5, "unknown"), (None, "law"), (77, None)], "doc_id long, subject string")
    names = spark.createDataFrame([(k, "") for k in WORDS], "subject string, description string")
    found = {}
    for r in s.subject_areas(docs, labels, names).collect():
        found.setdefault(r["doc_id"], set()).add(r["subject"])
    assert set(found) == set(truth)
    assert sum(found[i] == truth[i] for i in truth) >= 570
    assert s.subject_areas(docs, labels.limit(0), names).count() == 0 and s.subject_areas(docs.limit(0), labels, names).count() == 0
    areas = s.subject_areas(docs, labels, names)
    assert abs(sum(r["share"] for r in s.composition(areas, docs.dropna(subset=["doc_id"])).collect()) - 1) < 1e-9


def test_matrix_products():
    row, slot = np.array([0, 0, 0, 0, 2, 2]), np.array([0, 2, 2, 2, 1, 1])
    m = s.matrix(row, slot, 3, np.array([1.0, 2.0, 0.5]))
    dense = np.array([[1.0, 0, (1 + np.log(3)) * 0.5], [0, 0, 0], [0, (1 + np.log(2)) * 2, 0]])
    norm = np.linalg.norm(dense, axis=1)
    assert np.allclose(m.norm, norm)
    dense /= np.where(norm == 0, 1, norm)[:, None]
    q = np.random.default_rng(0).standard_normal((3, 2))
    out = np.zeros((3, 2))
    s.add_transposed(out, m, s.times(m, q))
    assert np.allclose(s.times(m, q), dense @ q, atol=1e-6) and np.allclose(out, dense.T @ dense @ q, atol=1e-6)


def test_reading_leaves_code_out():
    words = lambda t: [w for w in s.said(t, s._Ids()) if w >= 0]
    assert words("The `broth_oven` rises. See src/oven/a.py.") == words("the rises see")
    assert words("```\ndough(x)\n```\nuser: Warm dough\nreturn dough(1)\n  at dough.x(y)\nTypeError: oven") == words("warm dough")
    assert s.said("One. Two\nthree four", s._Ids()).count(s.BREAK) == 2 and s.said("", s._Ids()) == []
    many = s.said("word " * 100_000, s._Ids())
    assert len(many) == 100_000


def test_rare_words_share_slots():
    counts = pd.DataFrame({"id": [5, 9, 100, 101, 2000], "n": [50, 40, 1, 1, 1]})
    slot_of, held = s.slots(counts, 2, 4)
    assert slot_of[5] == 0 and slot_of[9] == 1 and {slot_of[i] for i in (100, 101, 2000)} <= {2, 3, 4, 5}
    assert held.sum() == 93 and len(held) == 6


def test_mentions_are_learned():
    rng = np.random.default_rng(3)
    sentences = [np.unique(np.r_[rng.integers(0, 500, 8), [900, 901] if i % 10 == 0 else [950]]) for i in range(2000)]
    off = np.array([float(i % 10 == 0) for i in range(2000)])
    weights, bias = s.fit_mentions(sentences, off)
    told = np.array([bias + weights[x].sum() / np.sqrt(len(x)) for x in sentences]) > 0
    assert (told == (off > 0)).mean() > 0.99
    assert s.fit_mentions(sentences, np.zeros(2000))[1] == -np.inf
