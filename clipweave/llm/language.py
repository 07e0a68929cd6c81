"""Language of every word, and of a text, by a linear-chain conditional random field."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import replacing, slices

WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
CHAIN = 256  # words of a piece of a chain; a longer text is several pieces that pass on their messages
CELLS = 1 << 18  # padded words that are worked on at once
MANY = 400_000  # words whose emissions a worker keeps


@dataclass
class LanguageModel:
    languages: list[str]
    features: dict[str, int]
    weights: np.ndarray  # features x languages
    lexicons: dict[str, int]  # word to a bit for each language that has it
    transitions: np.ndarray  # languages x languages, of logarithms


def word_features(word: str, lexicons: dict[str, int]) -> list[str]:
    """Affixes to three letters, letter bigrams and trigrams, and the lexicons that hold the word."""
    edged = f"^{word}$"
    found = [f"<{word[:k]}" for k in (1, 2, 3)] + [f">{word[-k:]}" for k in (1, 2, 3)]
    found += [edged[k : k + 2] for k in range(len(edged) - 1)] + [edged[k : k + 3] for k in range(len(edged) - 2)]
    if bits := lexicons.get(word):
        found += [f"#{k}" for k in range(bits.bit_length()) if bits >> k & 1] + [f"={word}"]
    return found


def forward_backward(emissions: np.ndarray, transitions: np.ndarray, lengths: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None, expect: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals [chain, word, label] of padded chains, expected transitions [label, label] (zeros unless asked for), and the logarithm of each chain's partition sum.

    A piece of a chain gets the messages of the words before it, moved on to its first word, and of the words after it, for its last.
    """
    n, t, _ = emissions.shape
    top = emissions.max(2, keepdims=True)
    local, move = np.exp(emissions - top), np.exp(transitions)
    inside = np.arange(t) < lengths[:, None]
    local[~inside] = 1.0
    forward, scale = np.empty_like(local), np.ones((n, t))
    for k in range(t):
        now = (local[:, k] if before is None else local[:, k] * before) if not k else np.where(inside[:, k, None], (forward[:, k - 1] @ move) * local[:, k], forward[:, k - 1])
        scale[:, k] = now.sum(1)
        forward[:, k] = now / scale[:, k, None]
    backward = np.ones_like(local)
    if after is not None:
        backward[:, -1] = after
    pairs = np.zeros_like(move)
    for k in range(t - 1, 0, -1):
        ahead = backward[:, k] * local[:, k]
        back = ahead @ move.T
        use = inside[:, k, None]
        if expect:
            pairs += move * np.einsum("na,nb->ab", np.where(use, forward[:, k - 1] / np.maximum((forward[:, k - 1] * back).sum(1, keepdims=True), 1e-300), 0), ahead)
        backward[:, k - 1] = np.where(use, back / back.sum(1, keepdims=True), backward[:, k])
    marginals = forward * backward
    marginals /= marginals.sum(2, keepdims=True)
    logz = (np.where(inside, np.log(scale) + top[..., 0], 0)).sum(1)
    return marginals, pairs, logz


def transfers(emissions: np.ndarray, transitions: np.ndarray, lengths: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each piece of a chain the matrix, up to a factor, that turns the message before the piece into the message at its end; a chain's first piece has no transition before it."""
    n, t, many = emissions.shape
    local, move = np.exp(emissions - emissions.max(2, keepdims=True)), np.exp(transitions)
    out = np.where(first[:, None, None], np.eye(many), move) * local[:, :1]
    for k in range(1, t):
        out = np.where((k < lengths)[:, None, None], (out @ move) * local[:, k, None], out)
        if k % 8 == 0:
            out /= out.max((1, 2), keepdims=True)
    return out / out.max((1, 2), keepdims=True)


def training_rows(docs: DataFrame, lang: str, per_language: int, most_bytes: int, most_rows: int) -> list[tuple[str, str]]:
    """About per_language texts (by a hash of the id, at most twice as many) of at most most_bytes of every language; where these are more than most_rows in all, fewer of each, but eight or more. A language of longer texts alone has its shortest one."""
    rows = docs.where(F.col(lang).isNotNull() & F.col("text").isNotNull())
    short = F.octet_length("text") <= most_bytes
    counts = rows.groupBy(lang).agg(F.count_if(short).alias("n")).orderBy(lang).collect()
    if not counts:
        return []
    each = min(per_language, max(8, most_rows // len(counts)))
    part = F.create_map(*(x for r in counts for x in (F.lit(r[0]), F.lit(each / max(1, r[1])))))
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    picked = rows.where(short & (place < part[F.col(lang)])).select("text", lang).limit(2 * each * len(counts)).collect()
    if lacking := {r[0] for r in counts} - {r[1] for r in picked}:
        picked += rows.where(F.col(lang).isin(*lacking)).groupBy(lang).agg(F.min_by("text", F.struct(F.octet_length("text"), "text")).alias("text")).select("text", lang).collect()
    return sorted({(r[0], r[1]) for r in picked})


def fit_language(docs: DataFrame, lang: str = "lang", per_language: int = 300, most_bytes: int = 8192, most_rows: int = 20_000, chains: int = 2400, steps: int = 60, seed: int = 7) -> LanguageModel:
    """Fit the field on a bounded sample of the rows with a language (training_rows): all weights, transitions included, by gradient steps on the likelihood. Every language is learned.

    Training chains are code-switched: runs of 3 to 20 words of texts of random languages, one after the other, each word labelled with
    its text's language; there are at least 40 for each language. Lexicons hold the 200 most frequent words of a language. Without any labelled text the model knows no language.
    """
    sample = training_rows(docs, lang, per_language, most_bytes, most_rows)
    languages = sorted({y for _, y in sample})
    rng = np.random.default_rng(seed)
    texts = {y: [w for w in (WORD.findall(t.lower()) for t, z in sample if z == y) if w] for y in languages}
    languages = [y for y in languages if texts[y]]
    if not languages:
        return LanguageModel([], {}, np.zeros((0, 0)), {}, np.zeros((0, 0)))
    lexicons: Counter = Counter()
    for k, y in enumerate(languages):
        for word, _ in Counter(w for ws in texts[y] for w in ws).most_common(200):
            lexicons[word] |= 1 << k
    length, many = 40, len(languages)
    chains = max(chains, 40 * many)
    words, gold = [], np.zeros((chains, length), int)
    for c in range(chains):
        line: list[str] = []
        while len(line) < length:
            k = int(rng.integers(many))
            source = texts[languages[k]][int(rng.integers(len(texts[languages[k]])))]
            run = min(int(rng.integers(3, 21)), length - len(line))
            at = int(rng.integers(max(1, len(source) - run + 1)))
            part = source[at : at + run]
            gold[c, len(line) : len(line) + len(part)] = k
            line += part
        words.append(line)
    types = {w: k for k, w in enumerate(dict.fromkeys(w for line in words for w in line))}
    index = np.array([[types[w] for w in line] for line in words])
    each = [word_features(w, lexicons) for w in types]
    often = Counter(f for fs in each for f in fs)
    features = {f: k for k, f in enumerate(f for f, n in often.items() if n > 1 or f[0] in "#=")}
    pairs = np.array([(r, features[f]) for r, fs in enumerate(each) for f in fs if f in features]).reshape(-1, 2)
    weights, move = np.zeros((len(features), many)), np.zeros((many, many))
    hot = np.eye(many)[gold]
    seen = np.zeros_like(move)
    np.add.at(seen, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
    lengths = np.full(chains, length)
    moments = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(move), np.zeros_like(move)]
    for step in range(1, steps + 1):
        scores = np.stack([np.bincount(pairs[:, 0], weights[pairs[:, 1], k], len(types)) for k in range(many)], 1)
        marginals, expected, _ = forward_backward(scores[index], move, lengths)
        error = (marginals - hot).reshape(-1, many)
        by_type = np.stack([np.bincount(index.ravel(), error[:, k], len(types)) for k in range(many)], 1)
        slope = np.stack([np.bincount(pairs[:, 1], by_type[pairs[:, 0], k], len(features)) for k in range(many)], 1) + 0.5 * weights
        turn = expected - seen + 0.5 * move
        for value, grad, m, v in ((weights, slope, 0, 1), (move, turn, 2, 3)):  # Adam
            moments[m] = 0.9 * moments[m] + 0.1 * grad
            moments[v] = 0.99 * moments[v] + 0.01 * grad * grad
            value -= 0.1 * (moments[m] / (1 - 0.9**step)) / (np.sqrt(moments[v] / (1 - 0.99**step)) + 1e-8)
    return LanguageModel(languages, features, weights.astype(np.float32), dict(lexicons), move)


class Tagger:
    """One task's words and their emissions."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.known: dict[str, int] = {}
        self.rows = np.zeros((1024, len(model.languages)))

    def number(self, word: str) -> int:
        at = self.known[word] = len(self.known)
        if at >= len(self.rows):
            self.rows = np.concatenate((self.rows, np.zeros_like(self.rows)))
        get = self.model.features.get
        own = [k for f in word_features(word, self.model.lexicons) if (k := get(f)) is not None]
        self.rows[at] = self.model.weights[own].sum(0)
        return at

    def marginals(self, texts: list[list[str]]) -> list[np.ndarray]:
        """For each text's words the probability of each language."""
        if len(self.known) > MANY:
            self.known.clear()
        get, number = self.known.get, self.number
        index = np.array([k if (k := get(w)) is not None else number(w) for words in texts for w in words], int)
        sizes = np.array([len(w) for w in texts], int)
        if not len(index):
            return [np.zeros((0, len(self.model.languages)))] * len(texts)
        begins = np.concatenate(([0], np.cumsum(sizes)))
        many = -(-sizes // CHAIN)
        starts = np.concatenate([np.arange(a, b, CHAIN) for a, b in zip(begins, begins[1:])])
        lengths = np.minimum(np.repeat(begins[1:], many) - starts, CHAIN)
        first = np.isin(starts, begins[:-1][sizes > 0])
        before, after = self._messages(index, starts, lengths, first, np.repeat(many, many) > 1)
        out = np.empty((len(index), len(self.model.languages)))
        for part in self._parts(lengths):
            place = np.minimum(starts[part, None] + np.arange(lengths[part].max()), len(index) - 1)
            found, _, _ = forward_backward(self.rows[index[place]], self.model.transitions, lengths[part], before[part], after[part], expect=False)
            inside = np.arange(place.shape[1]) < lengths[part, None]
            out[place[inside]] = found[inside]
        return np.split(out, begins[1:-1])


    def _parts(self, lengths: np.ndarray) -> Iterator[np.ndarray]:
        """Numbers of the pieces, in groups of like lengths."""
        order = np.argsort(lengths, kind="stable")
        at = 0
        while at < len(order):
            size = max(1, min(len(order) - at, CELLS // max(1, int(lengths[order[min(len(order) - 1, at + CELLS // CHAIN)]]))))
            yield order[at : at + size]
            at += size

    def _messages(self, index: np.ndarray, starts: np.ndarray, lengths: np.ndarray, first: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What each piece gets from the pieces before and after it in its text: each is turned into a matrix, all at once, and only the matrices are multiplied one after the other."""
        langs = len(self.model.languages)
        before, after = np.ones((len(starts), langs)), np.ones((len(starts), langs))
        some = np.flatnonzero(long)
        if not len(some):
            return before, after
        turn = np.empty((len(some), langs, langs))
        limit = max(1, CELLS // (CHAIN * langs))
        for a in range(0, len(some), limit):
            part = some[a : a + limit]
            place = np.minimum(starts[part, None] + np.arange(lengths[part].max()), len(index) - 1)
            turn[a : a + limit] = transfers(self.rows[index[place]], self.model.transitions, lengths[part], first[part])
        move, message = np.exp(self.model.transitions), np.ones(langs)
        for k, at in enumerate(some):
            if first[at]:
                message = np.ones(langs)
            else:
                before[at] = message @ move
            message = message @ turn[k]
            message /= message.max()
        for k in range(len(some) - 1, 0, -1):
            if not first[some[k]]:
                back = turn[k] @ after[some[k]]
                # the matrix begins before the transition to its first word: it is part of the message
                after[some[k - 1]] = back / back.max()
        return before, after


def tag_languages(docs: DataFrame, model: LanguageModel, text: str = "text", spans: bool = False, out: str = "lang") -> DataFrame:
    """docs with lang_pred (the language with the largest mean probability over the words; ties: first in order) and lang_score (that mean).

    With spans, also lang_spans: runs of words of one language, as (first word, words, lang). Words are runs of letters, lower-cased; the
    whole text is one chain, however long: pieces of CHAIN words pass on their messages, so a word's marginals do not depend on where pieces begin. A null text, or one without a letter, is ``und`` with score 0 and no spans, and so is
    every text if the model knows no language. Repeated rows, null ids and all columns stay, but those with the new names are replaced;
    ``out`` is what the new names begin with. An empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    more = [f"{out}_pred", f"{out}_score"] + [f"{out}_spans"] * spans
    docs = replacing(docs, more)
    names = docs.columns
    at = names.index(text)
    kind = pa.list_(pa.struct([("first_word", pa.int32()), ("words", pa.int32()), ("lang", pa.string())]))

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        langs = shared.value.languages
        for batch in slices(batches, at, 2 << 20):
            texts = [WORD.findall((t or "").lower()) if langs else [] for t in batch.column(at).to_pylist()]
            found = tagger.marginals(texts)
            means = [p.mean(0) if len(p) else None for p in found]
            columns = [pa.array([UNKNOWN if m is None else langs[int(m.argmax())] for m in means], pa.string()), pa.array([0.0 if m is None else float(min(1.0, m.max())) for m in means])]
            if spans:
                columns.append(pa.array([runs(p.argmax(1), langs) for p in found], kind))
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*names, *more])

    schema = docs.select("*", F.lit("").alias(more[0]), F.lit(0.0).alias(more[1]), *[F.expr("cast(null as array<struct<first_word int, words int, lang string>>)").alias(f"{out}_spans")] * spans).schema
    return docs.mapInArrow(tag, schema)


def runs(best: np.ndarray, langs: list[str]) -> list[dict]:
    if not len(best):
        return []
    begins = np.concatenate(([0], np.flatnonzero(np.diff(best)) + 1))
    ends = np.append(begins[1:], len(best))
    return [{"first_word": int(a), "words": int(b - a), "lang": langs[best[a]]} for a, b in zip(begins, ends)]
