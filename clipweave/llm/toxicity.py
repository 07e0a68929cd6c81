"""Toxicity scores by a weighted finite-state pattern grammar over clauses."""

from __future__ import annotations

import functools
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _Filled, replacing, slices
from .fitting import Logistic, labelled_sample

TOKEN = re.compile(r"[^\W\d_]+|[.!?;:\n]|[\"“”«»„]")
#: What the lexicon writes for a word (its input to the grammar) ...
OTHER, END, QUOTE, ADDRESS, PERSON, NEGATION, REPORT, THREAT, HARSH, INSULT = range(10)
#: ... and what machines write for others to read: a strong word that is negated or reported; an insult whose target is left out; a clause's end after one harsh word, after an undirected insult or a directed harsh word, after more, after a directed insult, after a threat.
EXCUSED, AIMED, SLIGHT, BARE, SEVERAL, DIRECTED, THREATENED = range(10, 17)
#: Kinds of arcs that carry a weight: insults or harsh words that pile up within SPAN clauses, an insult with its target, a threat with its target; excused ones weigh nothing, but are counted.
KINDS = ("repeated", "directed", "threat", "excused")
#: An insult is remembered for so many clauses; negation reaches so many words on. An insult counts two, a harsh word (one that clean texts hold too, but far less often) one; FULL is a pile.
SPAN, REACH, FULL = 12, 3, 3
#: Small closed word classes to start from; insults are learned, threats and verbs of speech are added to from the labelled rows.
WORDS = {
    ADDRESS: "you your yours yourself du dich dir ihr euch tu toi te vous ton votre usted ustedes ti vosotros tú",
    PERSON: "they them their he him she her sie",
    NEGATION: "not no never nor without nicht kein keine keinen nie ne pas jamais non sin nunca jamás tampoco",
    REPORT: "said says say called calls wrote claimed claims reported quoted quote sagte sagt nannte schrieb dit disait appelle écrit dijo dice llamó escribió",
    THREAT: "kill hurt destroy beat burn shoot stab töten schlagen zerstören verbrennen tuer frapper détruire brûler matar golpear destruir quemar",
}


class Transducer:
    """A deterministic weighted machine: (state, symbol) to (state, symbol written, kinds of weighted arcs). A symbol without an arc is copied and keeps the state, or, if the state fades with that symbol, takes it one step nearer to 0."""

    def __init__(self, arcs: dict[tuple[int, int], tuple], fades: frozenset[int] = frozenset()):
        self.arcs, self.fades = {k: v if len(v) == 3 else (*v, ()) for k, v in arcs.items()}, fades

    def step(self, state: int, symbol: int) -> tuple[int, int, tuple[str, ...]]:
        if (state, symbol) in self.arcs:
            return self.arcs[state, symbol]
        return max(0, state - 1) if symbol in self.fades else state, symbol, ()


def compose(*machines: Transducer) -> Transducer:
    """One machine that does what the machines do one after the other, with all their weighted arcs; its states are numbered as they are reached, 0 is the first."""
    start = (0,) * len(machines)
    numbers, todo, arcs = {start: 0}, [start], {}
    while todo:
        states = todo.pop()
        for symbol in range(INSULT + 1):
            after, out, kinds = [], symbol, ()
            for machine, state in zip(machines, states):
                state, out, more = machine.step(state, out)
                after.append(state)
                kinds += more
            if (after := tuple(after)) not in numbers:
                numbers[after] = len(numbers)
                todo.append(after)
            arcs[numbers[states], symbol] = (numbers[after], out, kinds)
    return Transducer(arcs)


@functools.cache
def grammar() -> Transducer:
    """Negation, reported speech, targets, threats, insults and their repetition, one machine after the other. The clause is what is matched: order inside it does not matter, and its end writes what it was."""
    strong = (THREAT, HARSH, INSULT)
    words = frozenset(range(INSULT + 1)) - {END}
    negation = Transducer(
        {(k, NEGATION): (REACH, NEGATION) for k in range(REACH + 1)} | {(k, END): (0, END) for k in range(REACH + 1)} | {(k, s): (k - 1, EXCUSED, ("excused",)) for k in range(1, REACH + 1) for s in strong}, fades=words
    )
    # 1: after a verb of speech, to the clause's end; 2: inside quotes that follow one
    reported = Transducer(
        {(0, REPORT): (1, REPORT), (1, END): (0, END), (1, QUOTE): (2, QUOTE), (2, QUOTE): (0, QUOTE)} | {(k, s): (k, EXCUSED, ("excused",)) for k in (1, 2) for s in strong}
    )
    # 1: the clause addresses somebody; 2: the clause before did, and this one has no word yet; 3: it has words. An insult is aimed there until a person is named; a clause without a word is none
    spoken = (OTHER, NEGATION, REPORT, THREAT, HARSH, EXCUSED)
    target = Transducer(
        {(k, ADDRESS): (1, ADDRESS) for k in range(4)} | {(1, END): (2, END), (3, END): (0, END)} | {(2, s): (3, s) for s in spoken} | {(k, PERSON): (0, PERSON) for k in (2, 3)} | {(k, INSULT): (3, AIMED) for k in (2, 3)}
    )
    # states are sets of what the clause has had; a clause that has both parts is matched, whichever came first
    threat = Transducer(
        {(k, s): (k | bit, s) for k in range(4) for s, bit in ((ADDRESS, 1), (PERSON, 1), (THREAT, 2))} | {(k, END): (0, THREATENED if k == 3 else END, ("threat",) * (k == 3)) for k in range(4)}
    )
    # twice the clause's count, and one more if it has a target; a target makes a harsh word as bad as an insult
    most = 2 * FULL
    kind = {k: None if k < 2 else (DIRECTED if k & 1 and k > 3 else SEVERAL if k >= most else BARE if k > 2 else SLIGHT) for k in range(most + 2)}
    insult = Transducer(
        {(k, s): (k | 1, s) for k in kind for s in (ADDRESS, PERSON)} | {(k, AIMED): (min(most, (k & ~1) + 4) | 1, AIMED) for k in kind} | {(k, s): (min(most, (k & ~1) + n) | k & 1, s) for k in kind for s, n in ((HARSH, 2), (INSULT, 4))}
        | {(k, end): (0, kind[k] if end == END and kind[k] else end, ("directed",) * (end == END and kind[k] == DIRECTED)) for k in kind for end in (END, THREATENED)}
    )
    # for how many more clauses a count is remembered, times FULL, plus the count; a pile is matched once, and the next begins with nothing
    again = {}
    for left in range(SPAN + 1):
        for held in range(FULL):
            at = left * FULL + held
            again[at, END] = ((left - 1) * FULL + held if left > 1 else 0, END)
            for s, n in ((SLIGHT, 1), (BARE, 2), (SEVERAL, FULL)):
                again[at, s] = (0, s, ("repeated",)) if held + n >= FULL else (SPAN * FULL + held + n, s)
            for s in (DIRECTED, THREATENED):
                again[at, s] = (SPAN * FULL + FULL - 1, s)
    return compose(negation, reported, target, threat, insult, Transducer(again))


@dataclass
class ToxicityModel:
    words: frozenset = frozenset()
    stems: frozenset = frozenset()
    harsh: frozenset = frozenset()  # words and stems
    logistic: Logistic | None = None
    share: float = 0.0  # of label 1: the score where nothing could be fitted
    more: dict = field(default_factory=dict)  # words of the other classes that were learned or given

    def __post_init__(self):
        self.fixed = {w: s for s, ws in WORDS.items() for w in ws.split()} | self.more | dict.fromkeys(".!?;:\n", END) | dict.fromkeys('"“”«»„', QUOTE)

    def symbol(self, word: str) -> int:
        if word in self.words or any(word[:k] in self.stems for k in STEMS if len(word) >= k):
            return INSULT
        return self.fixed.get(word) or HARSH * (word in self.harsh or any(word[:k] in self.harsh for k in STEMS if len(word) > k))


STEMS = (4, 5, 6, 7)
SPEECH = re.compile(r"([^\W\d_]+)\s*[:,]?\s*[\"“«„]")


class Marker:
    """Runs a text through the grammar and counts the weighted arcs that it takes."""

    def __init__(self, model: ToxicityModel):
        self.symbols = _Filled(model.symbol, 400_000)
        # a state's arcs in a row of ten: one look-up a word
        self.arcs = [arc for _, arc in sorted(grammar().arcs.items())]

    def matches(self, text: str | None) -> list[tuple[int, tuple[str, ...]]]:
        """The places (of tokens) at which weighted arcs are taken, and their kinds; those of a clause are at its end, but for excused words."""
        found = []
        symbols = list(map(self.symbols.__getitem__, TOKEN.findall((text or "").lower())))
        if symbols and max(symbols) >= THREAT:
            state = 0
            for at, symbol in enumerate((*symbols, END)):
                state, _, kinds = self.arcs[(INSULT + 1) * state + symbol]
                if kinds:
                    found.append((at, kinds))
        return found

    def count(self, text: str | None) -> Counter:
        return Counter(k for _, kinds in self.matches(text) for k in kinds)


#: Weights before any data, of: matched clauses of any kind, directed insults among them, threats, and the base. None but the base can be negative, so no context lowers a score but excuse; and a target
#: or a threat always adds its prior weight or more, so that a directed insult counts more than a pile of insults of no direction.
PRIOR = (4.5, 1.0, 1.0, -2.0)
LEAST = (0.0, 1.0, 1.0, -np.inf)


def _features(counts: list[Counter]) -> np.ndarray:
    """Logarithms of one more than the counts of matched clauses, of directed insults, and of threats."""
    return np.array([[math.log1p(c["repeated"] + c["directed"] + c["threat"]), math.log1p(c["directed"]), math.log1p(c["threat"])] for c in counts]).reshape(-1, 3)


def unlike(sample: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """The sample without near copies of earlier texts, which would make all their words look like marks of their label."""
    seen: set = set()
    out = []
    for text, y in sample:
        words = text.lower().split()
        runs = [zlib.crc32(" ".join(words[k : k + 3]).encode()) for k in range(max(1, len(words) - 2))]
        least = {(n, min(r * m & 0xFFFFFFFF for r in runs)) for n, m in enumerate((1, 0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35))}
        if not least & seen:
            out.append((text, y))
        seen |= least
    return out


def learn_lexicon(sample: list[tuple[str, int]], proof: list[tuple[str, int]], least: int = 4, ratio: float = 20.0, harsh: tuple[float, float] = (0.02, 4.0)) -> tuple[frozenset, frozenset, frozenset]:
    """Insults: words, and stems of STEMS letters, that at least ``least`` (and 0.6 %) toxic texts hold and that are ``ratio`` times as frequent there as in other texts; and harsh words and stems, for which harsh is the least share and ratio.

    Of the many words of a language some pass by chance; so each must be telling in a second sample too, insults with a wider margin.
    """

    def count(rows: list[tuple[str, int]]) -> tuple[dict, dict]:
        seen: dict[tuple[str, int], Counter] = {(kind, y): Counter() for kind in ("word", "stem") for y in (0, 1)}
        for text, y in rows:
            words = {w for w in TOKEN.findall(text.lower()) if len(w) > 2}
            seen["word", y].update(words)
            seen["stem", y].update({w[:k] for w in words for k in STEMS if len(w) > k})
        return seen, {y: sum(z == y for _, z in rows) for y in (0, 1)}

    def telling(counted: tuple[dict, dict], kind: str, word: str, ratio: float) -> bool:
        seen, many = counted
        return (seen[kind, 1][word] + 0.5) / (many[1] + 1) >= ratio * (seen[kind, 0][word] + 0.5) / (many[0] + 1)

    first, second = count(sample), count(proof)
    most: Counter = Counter()  # a stem that is one word's for the greater part is no stem
    for word, n in first[0]["word", 1].items():
        for k in STEMS:
            if len(word) > k:
                most[word[:k]] = max(most[word[:k]], n)

    def keep(kind: str, floor: float, ratio: float, proof: float) -> frozenset:
        some = (w for w, n in first[0][kind, 1].items() if n >= floor and (kind == "word" or 2 * most[w] <= n))
        return frozenset(w for w in some if telling(first, kind, w, ratio) and telling(second, kind, w, proof))

    floor = max(least, 0.006 * first[1][1])
    often = max(2 * least, harsh[0] * first[1][1])
    slight = keep("word", often, harsh[1], harsh[1]) | keep("stem", often, harsh[1], harsh[1])
    return keep("word", floor, ratio, ratio / 2), keep("stem", floor, ratio, ratio / 2), slight


def learn_classes(rows: list[tuple[str, int]], insults: frozenset, least: int = 5) -> dict[str, int]:
    """More threats and verbs of speech: of the telling words, those mostly followed within two words by a target; words mostly followed by a quotation. Each in at least ``least`` texts."""
    target = {*WORDS[ADDRESS].split(), *WORDS[PERSON].split()}
    seen, threats, speech = Counter(), Counter(), Counter()
    for text, _ in rows:
        tokens = TOKEN.findall(text.lower())
        own, quoted = set(tokens), set(SPEECH.findall(text.lower()))
        near = {w for k, w in enumerate(tokens) if w in insults and target.intersection(tokens[k + 1 : k + 3])}
        seen.update(own)
        threats.update(near)
        speech.update(quoted)
    often = lambda counts: (w for w, n in counts.items() if n >= least and 2 * n > seen[w])
    return {**dict.fromkeys(often(speech), REPORT), **dict.fromkeys(often(threats), THREAT)}


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = 2000, most_bytes: int = 16384, words: dict[int, str] | None = None) -> ToxicityModel:
    """Lexicon from half of a bounded sample of the labelled rows (see labelled_sample), proved on the other half; that half also gives the weights of the grammar's arcs.

    words: further words of the closed classes. Without texts of both labels the model scores every text with the share of label 1 (0 without any label).
    """
    sample = labelled_sample(docs, labels, label, per_class, most_bytes)
    share = sum(y for _, y in sample) / len(sample) if sample else 0.0
    given = {w: s for s, ws in (words or {}).items() for w in ws.split()}
    if len({y for _, y in sample}) < 2:
        return ToxicityModel(share=share, more=given)
    first, rest = unlike(sample[::2]), unlike(sample[1::2])
    found, stems, harsh = learn_lexicon(first, rest)
    more = learn_classes(first, found) | given
    model = ToxicityModel(frozenset(found - more.keys()), stems, harsh, share=share, more=more)
    marker = Marker(model)
    x = _features([marker.count(t) for t, _ in rest])
    model.logistic = Logistic(x, np.array([y for _, y in rest], float), ridge=0.5, prior=np.array(PRIOR), scale=False, least=np.array(LEAST))
    return model


def toxicity_scores(docs: DataFrame, model: ToxicityModel, text: str = "text", out: str = "toxicity") -> DataFrame:
    """docs with a score from 0 to 1 in column ``out``, and how often each of the KINDS of weighted arcs was taken in columns ``n_<kind>``.

    Words are mapped to symbols by the learned lexicon and small word classes, and every whole text runs through the composed grammar.
    What counts are clauses: an insult or a threat with its target in the same clause, whichever comes first; an insult in the clause after
    one that addresses somebody, if it names nobody else; or insults that pile up, in one clause or within SPAN clauses, each pile once. A word on its own matches nothing; negated and reported ones are excused. Null and empty
    texts have no match and the base score; repeated rows, null ids and all columns stay (but those with the new names are replaced), and an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    more = [out, *(f"n_{m}" for m in KINDS)]
    docs = replacing(docs, more)
    names = docs.columns
    at = names.index(text)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        marker = Marker(fitted)
        for batch in slices(batches, at):
            counts = [marker.count(t) for t in batch.column(at).to_pylist()]
            found = fitted.logistic.scores(_features(counts)) if fitted.logistic else np.full(batch.num_rows, fitted.share)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found), *(pa.array([c[m] for c in counts], pa.int64()) for m in KINDS)], names=[*names, *more])

    return docs.mapInArrow(score, docs.select("*", F.lit(0.0).alias(out), *(F.lit(0).cast("long").alias(n) for n in more[1:])).schema)
