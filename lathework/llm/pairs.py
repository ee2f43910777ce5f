"""Broken prompt and response pairs (problem 5).

A response is the answer read out of the tool's output together with the patch. A
multi-label linear classifier scores it for refusal, copy, language and loss of its end,
on hashed word n-grams of the answer and on features of the pair: how much of the answer
stands in the statement and the other way round, how many words are its own, how the
languages of both lean, each also cut into steps so that a linear score can bend; whether
there is a patch. It is trained on a bounded sample of pairs that have a patch, made
defective on purpose: answers cut short, statements given back (as they are, quoted, in
capitals, with sentences turned round or left out, with a word of its own around them),
answers swapped in from an item in another language, and refusals. The scores of held-out
synthetic pairs are calibrated to probabilities.

``defects`` puts the findings together: an end lost (a case of the structural operator, which
is what the defect is) before an empty response before the classifier's most probable label,
where that is more probable than not.

Defined results: without an item or with a blank statement there is no copy and no
language; attempts delivered twice give one row; of an item delivered twice the statement
ingested last counts; a null or blank answer with a diff is no defect; broken JSON lines
are skipped when the answer is read.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathework.llm import truncation
from lathework.runtime import stow

BITS = 15
SAMPLE = 4000  # labelled pairs the classifier is fitted on, at most
EPOCHS = 6
LABELS = ("refusal", "copy", "language", "truncated")
#: Copies and foreign languages show in the pair only, so their labels weigh the pair features alone.
WORDED = np.array([1.0, 0.0, 0.0, 1.0])
#: The share of words from which a sentence given back with changes counts as the same.
SAME = 0.8
STEPS = np.linspace(0.1, 0.9, 9)
#: A Python task judges about so many pairs.
TASK = 5_000

# Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the of and to in is that it was for on are as with be at by this have from or an not but which were all when there been one no its into now only also where before after then",
    "de": "der die das und ist nicht ein eine einen einem zu den dem des mit auf für von im wird wurde werden sich auch nach bei aus wenn aber nur noch wir haben habe dass ohne an am es ich kann sie war wieder",
    "es": "el la los las de que y en un una es no se por con para del al lo como pero su sus ya sin cuando está esta este fue son más también después antes he ha hay nunca desde solo todavía aún",
    "fr": "le la les de des du et est un une que qui dans pour pas ne au aux ce cette il elle sur avec par plus ou mais sont été sans quand n'est ai j'ai nous avons cela depuis mais voir aussi à après était",
}
_SHARED = Counter(w for words in FUNCTION_WORDS.values() for w in set(words.split()))
#: A word of several languages speaks for each of them by its part.
_KNOWN = {lang: {w: 1 / _SHARED[w] for w in words.split()} for lang, words in FUNCTION_WORDS.items()}
LANGUAGES = tuple(FUNCTION_WORDS)
_LETTERS = {"de": "äöüß", "es": "ñ¿¡áíóú", "fr": "çèêàùîôœ"}

# Ways of declining used to make refused responses.
DECLINING = (
    "I'm sorry, but I can't help with this one.|I cannot assist with that request.|I have to decline the task as described.|I must decline this.|"
    "I am not permitted to carry this out.|As an automated assistant I am not allowed to do this.|This is not something I am able to work on.|"
    "Sorry, that request falls outside what I may do.|My instructions do not allow me to take this on.|Unable to comply: the task conflicts with my usage policy.|"
    "That would require me to do something I have been asked never to do.|After reading the task I have decided against taking part in it.|"
    "I will leave the code as it is since I may not act on requests of this kind.|I won't make this change.|I refuse to work on this.|I am unable to fulfil this request."
    "\nEs tut mir leid, dabei kann ich nicht helfen.|Ich muss die Aufgabe leider ablehnen.|Das liegt außerhalb dessen, was ich tun darf.|Diese Änderung werde ich nicht vornehmen.|Das darf ich nicht bearbeiten."
    "\nLo siento, no puedo ayudar con esto.|Debo rechazar la tarea tal como está descrita.|Eso queda fuera de lo que puedo hacer.|No voy a hacer este cambio.|No se me permite hacer esto."
    "\nJe suis désolé, je ne peux pas aider pour cela.|Je dois refuser la tâche telle qu'elle est décrite.|Je ne ferai pas cette modification.|Cela dépasse ce que je suis autorisé à faire.|Je ne suis pas autorisé à faire cela."
)
REFUSALS = {lang: lines.split("|") for lang, lines in zip(("en", "de", "es", "fr"), DECLINING.split("\n"))}
CLOSINGS = (
    "It touches policies I have to respect.", "You may want to consult a qualified person.", "Please ask a maintainer instead.", "Thank you for understanding.",
    "If you have another task, I am happy to look at it.", "The request could affect people who have not agreed to it.", "This might be unsafe.",
)

OPENINGS = ("The task:", "Here is the task again.", "As I understand it, the request says:", "Issue text:", "Aufgabe:", "La tarea:", "La demande :")

_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|\d+")
_QUOTED = re.compile(r"\"[^\"\n]{3,400}\"|“[^”\n]{3,400}”|«[^»\n]{3,400}»|`[^`\n]*`|```.*?```|(?:[\w.-]+/)+[\w.-]+", re.S)
_PIECE = re.compile(r"(?<=[.!?])\s+|\n+")
_MACHINE = re.compile(r"^\s*(?:Traceback \(|File \"|[\w.]+\(.*\)$|[A-Za-z]*(?:Error|Exception): )")


def answer_of(raw: str | None, style: str | None) -> str:
    """The answer in a tool's output: the last message's text in JSON lines, else the whole."""
    if not raw:
        return ""
    if style == "plain" or (style is None and not raw.lstrip().startswith('{"')):
        return raw
    for line in reversed(raw.split("\n")):
        if '"message"' not in line:
            continue
        try:
            event = json.loads(line)
        except ValueError:
            continue
        if isinstance(event, dict) and event.get("type") == "message":
            return event["text"] if isinstance(event.get("text"), str) else ""
    return ""


def worded(text: str | None) -> bool:
    return bool(text) and any(c.isalnum() for c in text)


def leaning(text: str) -> dict[str, float]:
    """How strongly the prose of a text leans to each language (0 to 1, all 0 where nothing tells)."""
    prose = _QUOTED.sub(" ", "\n".join(x for x in text.split("\n") if not _MACHINE.match(x.lstrip("> "))))
    words = [w.lower().replace("’", "'") for w in _TOKEN.findall(prose)]
    found = {lang: sum(known.get(w, 0.0) for w in words) for lang, known in _KNOWN.items()}
    lower = prose.lower()
    for lang, letters in _LETTERS.items():
        found[lang] += 0.5 * sum(lower.count(c) for c in letters)
    total = sum(found.values())
    return {lang: n / total for lang, n in found.items()} if total >= 2 else dict.fromkeys(LANGUAGES, 0.0)


def pieces(text: str) -> list[tuple[str, ...]]:
    """The sentences of a text as word tuples, without case, marks and quoting."""
    out = []
    for line in text.split("\n"):
        line = line.lstrip("> \t")
        out += [t for p in _PIECE.split(line) if (t := tuple(w.casefold() for w in _TOKEN.findall(p)))]
    return out


class Back(NamedTuple):
    mine: float  # share of the text's words that stand in the statement
    theirs: float  # share of the statement's words that stand in the text
    extra: int  # words of the text that stand nowhere in the statement


class Statement:
    """A statement's sentences with what a comparison looks up: words by sentence, runs of five words."""

    def __init__(self, text: str | None):
        said = set(pieces(text)) if text else set()
        self.sentences = list(said)
        self.known = said
        self.bags = [Counter(t) for t in self.sentences]
        self.words = Counter(w for t in self.sentences for w in t)
        self.grams = {g for s in self.sentences for g in zip(s, s[1:], s[2:], s[3:], s[4:])}
        self.places: dict[str, list[int]] = {}
        for i, bag in enumerate(self.bags):
            for w in bag:
                self.places.setdefault(w, []).append(i)

    def closest(self, s: tuple[str, ...]) -> int:
        """The most words that a sentence of the statement has in common with ``s``, where that is enough of ``s``; else 0.

        All but the missing share of the words must be met, so one of the rarest of more than that share is.
        """
        least = math.ceil(SAME * len(s) - 1e-9)
        rarest = sorted(s, key=lambda w: len(self.places.get(w, ())))[: len(s) - least + 1]
        bag = Counter(s)
        close = max(((bag & self.bags[i]).total() for i in {i for w in rarest for i in self.places.get(w, ())} if len(self.sentences[i]) <= 3 * len(s)), default=0)
        return close if close >= least else 0


def given_back(text: str, statement: Statement) -> Back:
    """Compare sentence by sentence: whole, with words left out, or in runs of five words."""
    mine = pieces(text)

    def inside(s: tuple[str, ...]) -> float:
        if s in statement.known:
            return float(len(s))
        if len(s) >= 3 and (close := statement.closest(s)):
            return float(close)
        if len(s) < 6:
            return 0.0
        runs = list(zip(s, s[1:], s[2:], s[3:], s[4:]))
        return float(len(s)) * sum(r in statement.grams for r in runs) / len(runs)

    words = sum(map(len, mine))
    back = sum(map(inside, mine))
    common = (Counter(w for s in mine for w in s) & statement.words).total()
    whole = statement.words.total()
    return Back(back / words if words else 0.0, common / whole if whole else 0.0, words - common)


def steps(x: float, there: bool = True) -> list[float]:
    """A share and the steps it passes, all 0 where there is nothing to measure."""
    return [x, *(x >= STEPS).astype(float)] if there else [0.0] * (len(STEPS) + 1)


DENSE = 8 + 6 * (len(STEPS) + 1)


def features(answer: str, statement: str | None, note: str | None, has_diff: bool) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the hashed n-grams, and the pair features."""
    words = [w.lower() for w in _TOKEN.findall(answer)]
    # digits and names of things differ from pair to pair; the n-grams keep the words as they come
    grams = set()
    for n in (1, 2, 3):
        for i in range(len(words) - n + 1):
            grams.add(zlib.crc32(" ".join(words[i : i + n]).encode("utf-8", "replace")) & ((1 << BITS) - 1))
    said = Statement(statement)
    none = Back(0.0, 0.0, 0)
    asked = bool(said.sentences)
    back = given_back(answer, said) if asked and worded(answer) else none
    noted = given_back(note, said) if asked and note else none
    here, there = leaning(answer), leaning(statement or "")
    best = max(LANGUAGES, key=lambda x: there[x])
    told = max(here.values()) > 0 and there[best] > 0
    end = answer.rstrip()[-1:] if answer.rstrip() else "."
    tight = lambda b: b.theirs / (1 + b.extra / 16)  # noqa: E731  all of the statement, and little else
    dense = np.array([
        1.0, float(has_diff), min(len(words), 200) / 200, float(len(words) < 45), float(end.isalnum() or end in ",;([{\\/_-"), float(bool(note)),
        there[best] * (max(here.values()) - here[best]) if told else 0.0, float(told),
        *steps(back.mine), *steps(tight(back)), *steps(noted.mine), *steps(tight(noted)),
        *steps(1 - here[best], told), *steps((1 - here[best]) * (1 - back.mine), told),
    ])
    return np.fromiter(grams, dtype=np.int64, count=len(grams)), dense


class Classifier(NamedTuple):
    sparse: np.ndarray
    dense: np.ndarray
    calibration: np.ndarray  # slope and offset of each label's log odds

    def scores(self, grams: np.ndarray, dense: np.ndarray) -> np.ndarray:
        z = self.dense @ dense
        return z + self.sparse[:, grams].sum(1) / np.sqrt(len(grams)) if len(grams) else z

    def log_odds(self, grams: np.ndarray, dense: np.ndarray) -> np.ndarray:
        return self.calibration[:, 0] * self.scores(grams, dense) + self.calibration[:, 1]


def made_defective(sample: list[tuple[str, str]], rng: np.random.Generator) -> list[tuple[str, str | None, str | None, bool, int]]:
    """(answer, statement, note, has_diff, label number or -1) from (statement, answer) pairs taken as sound."""
    by_lang: dict[str, list[str]] = {}
    for _, answer in sample:
        here = leaning(answer)
        best = max(LANGUAGES, key=lambda x: here[x])
        if here[best] > 0.8:
            by_lang.setdefault(best, []).append(answer)
    out: list[tuple[str, str | None, str | None, bool, int]] = []
    for statement, answer in sample:
        has_diff = bool(rng.random() < 0.6)
        out.append((answer, statement, None, has_diff, -1))
        there = leaning(statement)
        lang = max(LANGUAGES, key=lambda x: there[x])
        roll = rng.random()
        if roll < 0.25:  # given back
            lines = [p for p in _PIECE.split(statement) if p.strip()]
            rng.shuffle(lines)
            way = int(rng.integers(8))
            copy = (
                statement, "> " + statement.replace("\n", "\n> "), statement.upper(), " ".join(lines), "\n".join("> " + x for x in lines),
                OPENINGS[int(rng.integers(len(OPENINGS)))] + " " + statement, " ".join(lines[: max(1, len(lines) - 1)]), " ".join(lines[: max(1, len(lines) // 2)]),
            )[way]
            if rng.random() < 0.3:
                out.append(("", statement, copy, False, 1))
            else:
                out.append((copy, statement, None, False, 1))
        elif roll < 0.5 and there[lang] > 0.5 and (others := [x for x in by_lang if x != lang]):  # swapped
            other = others[int(rng.integers(len(others)))]
            out.append((by_lang[other][int(rng.integers(len(by_lang[other])))], statement, None, bool(rng.random() < 0.5), 2))
        elif roll < 0.8:  # refused
            mine = REFUSALS[lang if there[lang] > 0.5 and rng.random() < 0.9 else "en"]
            text = mine[int(rng.integers(len(mine)))]
            for _ in range(int(rng.integers(3))):
                text += " " + CLOSINGS[int(rng.integers(len(CLOSINGS)))]
            out.append((text, statement, None, False, 0))
        elif len(answer) > 40:  # cut short
            out.append((answer[: int(rng.integers(20, len(answer) - 5))], statement, None, has_diff, 3))
        if rng.random() < 0.2:  # a sound answer that opens with the statement's first sentence
            out.append(("> " + _PIECE.split(statement)[0] + "\n\n" + answer, statement, None, has_diff, -1))
    return out


def train(sample: list[tuple[str, str]], seed: int = 11) -> Classifier:
    """Logistic regression for each label by adaptive gradient steps; calibrated on a fifth held out."""
    rng = np.random.default_rng(seed)
    made = made_defective(sample, rng)
    rows = [(features(a, s, n, d), label) for a, s, n, d, label in made]
    order = rng.permutation(len(rows))
    held, fit = order[: len(rows) // 5], order[len(rows) // 5 :]
    k = len(LABELS)
    sparse, dense = np.zeros((k, 1 << BITS)), np.zeros((k, DENSE))
    gs, gd = np.full((k, 1 << BITS), 1e-3), np.full((k, DENSE), 1e-3)
    for _ in range(EPOCHS):
        for i in rng.permutation(fit):
            (grams, x), label = rows[i]
            scale = 1 / np.sqrt(len(grams)) if len(grams) else 0.0
            z = dense @ x + (sparse[:, grams].sum(1) * scale if len(grams) else 0.0)
            y = np.zeros(k)
            if label >= 0:
                y[label] = 1
            error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
            step = np.outer(error, x)
            gd += step**2
            dense -= 0.3 * step / np.sqrt(gd)
            if len(grams):
                step = (error * scale * WORDED)[:, None]
                gs[:, grams] += step**2
                sparse[:, grams] -= 0.3 * step / np.sqrt(gs[:, grams])
    model = Classifier(sparse, dense, np.tile([1.0, 0.0], (k, 1)))
    scores = np.array([model.scores(*rows[i][0]) for i in held]).reshape(len(held), k)
    truth = np.array([rows[i][1] for i in held])
    return model._replace(calibration=np.array([calibrated(scores[:, j], truth == j) for j in range(k)]))


def calibrated(scores: np.ndarray, truth: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset that turn scores into log odds: logistic regression with smoothed targets, by Newton steps."""
    n, hits = len(truth), int(truth.sum())
    if not hits or hits == n:
        return 1.0, 0.0
    target = np.where(truth, (hits + 1) / (hits + 2), 1 / (n - hits + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * scores + b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        grad = np.array([((p - target) * scores).sum() + 1e-3 * (a - 1), (p - target).sum()])
        hess = np.array([[(w * scores * scores).sum() + 1e-3, (w * scores).sum()], [(w * scores).sum(), w.sum() + 1e-9]])
        step = np.linalg.solve(hess, grad)
        size = min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        a, b = max(a - size * step[0], 1e-3), b - size * step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def held_out(model: Classifier, sample: list[tuple[str, str]], seed: int = 29) -> dict[str, tuple[int, int, int]]:
    """Per label, of pairs made defective anew: how many are, how many are found, how many both."""
    out = {name: [0, 0, 0] for name in LABELS[:3]}
    for answer, statement, note, diff, label in made_defective(sample, np.random.default_rng(seed)):
        if label == 3:
            continue
        told = verdict(model, answer, note, diff, statement)
        for j, name in enumerate(LABELS[:3]):
            out[name][0] += label == j
            out[name][1] += told == name
            out[name][2] += label == j and told == name
    return {name: tuple(n) for name, n in out.items()}


def responses(attempts: DataFrame, solvers: DataFrame, items: DataFrame) -> DataFrame:
    """One row an attempt with its answer, a patch that is no diff (``note``), and the statement of its item."""
    style = solvers.groupBy("solver_id").agg(F.min("output_format").alias("output_format"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            patches = pdf["model_patch"].tolist()
            diff = [bool(p) and truncation.is_diff(p) for p in patches]
            yield pd.DataFrame({
                "attempt_id": pdf["attempt_id"], "instance_id": pdf["instance_id"],
                "answer": [answer_of(r, s) for r, s in zip(pdf["raw_output"], pdf["output_format"])],
                "note": [p if p and not d and p.strip() else None for p, d in zip(patches, diff)], "has_diff": diff,
            })

    read_ = attempts.filter("attempt_id is not null").select("attempt_id", "instance_id", "solver_id", "model_patch", "raw_output").join(style, "solver_id", "left")
    answers = read_.select("attempt_id", "instance_id", "model_patch", "raw_output", "output_format").mapInPandas(
        read, "attempt_id string, instance_id string, answer string, note string, has_diff boolean"
    )
    statements = items.filter("instance_id is not null").groupBy("instance_id").agg(F.max_by("problem_statement", F.struct("ingested_at", F.col("problem_statement"))).alias("statement"))
    return answers.join(statements, "instance_id", "left")


def sound_sample(pairs: DataFrame, ready: int, size: int = SAMPLE) -> list[tuple[str, str]]:
    """A bounded sample of (statement, answer) with a diff and words on both sides, the least hashes of the attempts; ``ready`` pairs are like that."""
    found = pairs.filter(SOUND).select("statement", "answer", F.xxhash64("attempt_id").alias("h"), "attempt_id")
    # only about the wanted number passes the hash, so no task sends more than its part of it
    share = min(1.0, 1.5 * size / max(1, ready))
    below = F.col("h") < F.lit(int(-(2**63) + share * (2**64 - 2**12)))
    return [(r[0], r[1]) for r in found.filter(below if share < 1 else F.lit(True)).orderBy("h", "attempt_id").limit(size).collect()]


SOUND = "has_diff and statement rlike '[A-Za-z]' and length(answer) > 40"


def defects(attempts: DataFrame, solvers: DataFrame, items: DataFrame) -> DataFrame:
    """(attempt_id, defect) of every defective pair."""
    lost = truncation.cut_values(attempts, solvers, ("model_patch", "raw_output")).select("attempt_id").distinct().withColumn("lost", F.lit(True))
    pairs = stow(responses(attempts, solvers, items), "pairs")
    size = pairs.agg(F.count("*").alias("n"), F.count_if(F.expr(SOUND)).alias("ready")).first()  # one row
    sample = sound_sample(pairs, size["ready"])
    model = train(sample) if sample else None
    given = pairs.sparkSession.sparkContext.broadcast(tuple(model) if model else None)  # one weight vector a label; a plain tuple, so executors need not have the class

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Classifier(*given.value) if given.value else None
        for pdf in batches:
            found = []
            for attempt, answer, note, diff, statement in zip(pdf["attempt_id"], pdf["answer"], pdf["note"], pdf["has_diff"], pdf["statement"]):
                found.append((attempt, verdict(m, answer or "", note, bool(diff), statement)))
            yield pd.DataFrame([x for x in found if x[1]], columns=["attempt_id", "defect"])

    even = pairs.select("attempt_id", "answer", "note", "has_diff", "statement").repartition(max(1, -(-size["n"] // TASK)))  # files hold many pairs, and judging is the slow part
    judged = even.mapInPandas(judge, "attempt_id string, defect string").groupBy("attempt_id").agg(F.min("defect").alias("defect"))
    return judged.join(lost, "attempt_id", "full_outer").select("attempt_id", F.when(F.col("lost"), F.lit("truncated")).otherwise(F.col("defect")).alias("defect"))


def verdict(model: Classifier | None, answer: str, note: str | None, has_diff: bool, statement: str | None) -> str | None:
    """empty, refusal, copy, language or none, of a pair whose end is not lost."""
    if not worded(answer) and not has_diff and not worded(note):
        return "empty"
    if model is None:
        return None
    statement = statement if worded(statement) else None
    odds = model.log_odds(*features(answer, statement, note, has_diff))[:3]
    if statement is None:  # nothing to copy, and no language to miss
        odds[1:] = -np.inf
    best = int(np.argmax(odds))
    return LABELS[best] if odds[best] >= 0 else None
