"""Toxicity scores of text that a noisy channel may have disguised.

Characters of leetspeak, repeated letters, marks inside words and letters set
apart by blanks make a lattice of readings; a Viterbi search under a character
trigram model, learned from the whole corpus, picks the likeliest one.  Words and
word beginnings of the restored texts that go with the label are the lexicon, and
a logistic curve turns a text's hits into a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize

#: What a sign may stand for.
LEET = {
    "0": "o",
    "1": "il",
    "3": "e",
    "4": "a",
    "5": "s",
    "7": "t",
    "8": "b",
    "9": "g",
    "@": "a",
    "$": "s",
    "!": "i",
    "|": "li",
    "+": "t",
}
#: Marks that may have been put between letters, or over one.
MARKS = ".-_*"
LETTERS = re.compile(r"[^\W\d_]+")
_KNOWN = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)
_SIGNS = re.escape("".join(LEET) + MARKS)
_MIXED = re.compile(rf"[^\W\d_][{_SIGNS}]+[^\W\d_]|^[{_SIGNS}]+[^\W\d_]|[^\W\d_][0134578@$]+$")
_TWICE = re.compile(r"([^\W\d_])\1")
_LONG_RUN = re.compile(r"([^\W\d_])\1\1")
_RUN = re.compile(r"([^\W\d_])\1+")
_SPACED = re.compile(r"(?:(?<=\s)|^)(?:[^\W_][ .\-_*]){2,}[^\W_](?=[\s.,;:!?]|$)")
_EDGE = ".,;:!?\"'()[]{}<>#%&*|-_"
PREFIXES = (4, 5, 6)
#: A word is known if it is at least one in so many of the corpus's words; others are judged by their letters.
#: A share, not a rank: a word is known or not whatever the corpus's size, and no more than RAREST words can be.
RAREST = 1_000_000


def _fold(c: str) -> str:
    return c if c in _KNOWN else "?"


def trigrams(words: Counter) -> Counter:
    """Character trigrams of words between two ^ and one $; letters beyond Latin-1 count as ?."""
    out: Counter = Counter()
    for w, n in words.items():
        s = "^^" + "".join(map(_fold, w)) + "$"
        for i in range(len(s) - 2):
            out[s[i : i + 3]] += n
    return out


def count_language(docs: DataFrame) -> DataFrame:
    """``(gram, n)`` over the words of all texts: trigrams, at most 60**3 as letters are folded, and words, marked by a blank before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens: Counter = Counter()
            for t in b.column(0):
                tokens.update((t.as_py() or "").lower().split())
            words: Counter = Counter()
            for t, n in tokens.items():
                for w in LETTERS.findall(t):
                    words[w] += n
            got = trigrams(words)
            names = [*got, *(" " + w for w in words)]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([*got.values(), *words.values()], pa.int64())], ["gram", "n"])

    return docs.select("text").mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


class Channel:
    """Readings of disguised words under a character model."""

    def __init__(self, grams: dict[str, int], cost: float = 0.7, double: float = 0.4, words: dict[str, int] | None = None):
        self.grams = grams
        total = sum(n for g, n in grams.items() if g[:2] == "^^") + 1
        self.known = {w: math.log(n / total) for w, n in (words or {}).items()}
        self.longest = max(map(len, self.known), default=0)
        self.unknown = math.log(max(1, total - sum((words or {}).values())) / total)
        self.pairs: Counter = Counter()
        for g, n in grams.items():
            self.pairs[g[:2]] += n
        self.size = len(_KNOWN) + 2
        self.steps: dict[str, float] = {}
        self.cost, self.double = cost, double

    def step(self, before: str, c: str) -> float:
        g = before + c
        if g not in self.steps:
            self.steps[g] = math.log((self.grams.get(g, 0) + 0.05) / (self.pairs.get(before, 0) + 0.05 * self.size))
        return self.steps[g]

    def readings(self, token: str) -> list[list[tuple[str, float]]]:
        """The lattice: for each run of one character its possible readings and their costs; a sign kept ends a word."""
        out, i = [], 0
        while i < len(token):
            c, j = token[i], i
            while j < len(token) and token[j] == c:
                j += 1
            run, i = j - i, j
            if c.isalpha():
                out.append([(c, 0.0 if run == 1 else self.double)] + ([(c + c, 0.0 if run == 2 else self.double)] if run > 1 else []))
            elif c in LEET:
                out.append([(x * k, self.cost) for x in LEET[c] for k in ((1,) if run == 1 else (1, 2))])
            elif c == "*":
                out.append([("", self.cost), (c * run, 0.0)] + [(x, 2 * self.cost) for x in "aeiou"])
            else:
                out.append([("", self.cost), (c * run, 0.0)])
        return out

    def search(self, lattice: list[list[tuple[str, float]]]) -> tuple[float, str]:
        """The likeliest reading and its log-probability, by Viterbi search over the last two letters; a sign that is no letter ends a word."""
        best: dict[str, tuple[float, tuple | None]] = {"^^": (0.0, None)}
        for options in lattice:
            after: dict[str, tuple[float, tuple | None]] = {}
            for state, (p, said) in best.items():
                for text, cost in options:
                    q, s = p - cost, state
                    for c in text:
                        if c.isalpha():
                            f = _fold(c)
                            q += self.step(s, f)
                            s = s[1] + f
                        elif s != "^^":
                            q += self.step(s, "$")
                            s = "^^"
                    if s not in after or q > after[s][0]:
                        after[s] = (q, (said, text) if text else said)
            best = after
        p, _, said = max(((p + (self.step(s, "$") if s != "^^" else 0.0), s, said) for s, (p, said) in best.items()), key=lambda x: x[:2])
        parts = []
        while said:
            said, text = said
            parts.append(text)
        return p, "".join(reversed(parts))

    def decode(self, token: str) -> str:
        """The likeliest reading of a token."""
        return self.search(self.readings(token))[1]

    def words(self, letters: str) -> str:
        """The likeliest reading of letters that were set apart, as words; a word may end after each letter."""
        lattice = []
        for options in self.readings(letters):
            if options[0][0].isalpha() and len({text[0] for text, _ in options}) == 1:
                options = options[-1:]  # repeated letters are left to the cut
            apart = [(" ".join(text), cost) for text, cost in options if len(text) > 1]
            lattice += [options + apart, [("", 0.0), (" ", 0.0)]]
        return " ".join(self.cut(self.search(lattice[:-1])[1].replace(" ", "")))

    def cut(self, letters: str) -> list[str]:
        """The likeliest words that the letters spell: known ones, maybe with letters doubled, by their frequency, others by the character model."""
        f = [*map(_fold, letters)]
        twice = [0, *(int(a == b) for a, b in zip(letters, letters[1:]))]
        last = 0  # where the latest pair of equal letters begins
        best, start = [0.0], [(0, "")]  # best cut of the first j letters; where its last word starts, and that word
        one, two = (-math.inf, 0), (-math.inf, 0)  # an unknown word of one letter, or of more, that ends here and may go on
        for j in range(1, len(f) + 1):
            c = f[j - 1]
            if j > 1:
                short, long = one[0] + self.step("^" + f[j - 2], c), -math.inf if j == 2 else two[0] + self.step(f[j - 3] + f[j - 2], c)
                two = (short, one[1]) if short >= long else (long, two[1])
            one = (best[j - 1] + self.unknown + self.step("^^", c), j - 1)
            ends = [(one[0] + self.step("^" + c, "$"), j - 1)]
            if j > 1:
                ends.append((two[0] + self.step(f[j - 2] + c, "$"), two[1]))
            if twice[j - 1]:
                last = j - 1
            said = [letters[i:j] for _, i in ends]
            for i in range(max(0, j - 2 * self.longest), j):
                w = letters[i:j]
                if (p := self.known.get(w)) is not None:
                    ends.append((best[i] + p, i))
                    said.append(w)
                if i < last and (p := self.known.get(w := _TWICE.sub(r"\1", w))) is not None:
                    ends.append((best[i] + p - self.double * sum(twice[i + 1 : j]), i))
                    said.append(w)
            k = max(range(len(ends)), key=ends.__getitem__)
            best.append(ends[k][0])
            start.append((ends[k][1], said[k]))
        out, j = [], len(f)
        while j:
            j, w = start[j]
            out.append(w)
        return out[::-1]

    def spelled(self, word: str) -> float:
        """Log-probability of a word by its letters."""
        s = "^^" + "".join(map(_fold, word)) + "$"
        steps, total = self.steps, 0.0
        for i in range(len(s) - 2):
            p = steps.get(s[i : i + 3])
            total += self.step(s[i : i + 2], s[i + 2]) if p is None else p
        return total

    def undoubled(self, token: str, word: str, pairs: list[int]) -> str:
        """The outcome of ``by_search`` for letters alone with few pairs of equal ones, in less time: all readings of the lattice are tried one by one."""
        readings = [(word, 0)]
        for i in reversed(pairs):
            readings += [(w[:i] + w[i + 1 :], n + 1) for w, n in readings]
        spelt = [self.spelled(w) for w, _ in readings]
        k = max(range(len(readings)), key=lambda k: spelt[k] - self.double * readings[k][1])
        found = []
        for j in (0, k):
            w, n = readings[j]
            found.append(((self.known[w] if w in self.known else self.unknown + spelt[j]) - self.double * n, w if j else token))
        for w, n in readings:
            if n in (0, 1, len(pairs)) and w in self.known:
                found.append((self.known[w] - self.double * n, w))
        return max(found, key=lambda x: x[0])[1]

    def by_search(self, token: str, bare: str) -> str:
        """The likeliest of the plain reading, that of the search, and the joined parts as they are or with doubled letters made single, compared by words."""
        p, said = self.search(self.readings(bare))
        found = [(p - sum(map(self.spelled, LETTERS.findall(said))) + self.score(said), said)]
        if LEET.keys().isdisjoint(bare):
            if not _LONG_RUN.search(bare):
                found.insert(0, (self.score(bare), token))
            parts = LETTERS.findall(bare)
            joined = "".join(parts)
            single, n = _RUN.subn(r"\1", joined)
            near = [(single, n)]
            if len(joined) <= self.longest + 1:  # longer ones aren't known
                near += [(joined, 0), *((joined[:i] + joined[i + 1 :], 1) for i in range(1, len(joined)) if joined[i] == joined[i - 1])]
            cost = self.cost * (len(parts) - 1)
            found += [(self.known[w] - cost - self.double * n, w) for w, n in near if w in self.known]
        return max(found, key=lambda x: x[0])[1]

    def score(self, reading: str) -> float:
        """Log-probability of the words of a reading."""
        return sum(self.known[w] if w in self.known else self.unknown + self.spelled(w) for w in LETTERS.findall(reading))

    def restore_token(self, token: str) -> str:
        """A lower-case token's likeliest reading; without signs and doubled letters there is one only."""
        bare = token.strip(_EDGE)
        if bare.isalpha():
            if not _TWICE.search(bare):
                return token
        elif not (_MIXED.search(bare) or _TWICE.search(bare)) or not any(map(str.isalpha, bare)):
            return token
        if bare.isalpha() and not _LONG_RUN.search(bare):
            pairs = [i for i in range(1, len(bare)) if bare[i] == bare[i - 1]]
            if len(pairs) <= 3:
                return self.undoubled(token, bare, pairs)
        return self.by_search(token, bare)

    def runs(self, text: str) -> list[list[str]]:
        """The words of each run of letters with a blank or mark between them; the whole run too if it comes out as several."""
        out = []
        for m in _SPACED.finditer(text):
            letters = re.sub(r"[ .\-_*]", "", m[0])
            words = self.words(letters).split()
            out.append(words if len(words) == 1 else [*words, self.decode(letters)])
        return out

    def spaced(self, text: str) -> list[str]:
        """Words written with a blank or mark between the letters."""
        return [w for words in self.runs(text) for w in words]

    def restore(self, text: str) -> str:
        """The whole lower-case text with its disguised words restored."""
        text = _SPACED.sub(lambda m: self.words(re.sub(r"[ .\-_*]", "", m[0])), text.lower())
        return re.sub(r"\S+", lambda m: self.restore_token(m[0]), text)


def channel(grams: dict[str, int], words: dict[str, int]) -> Channel:
    return Channel(grams, words=words)


class Readings(dict):
    """What the words of a token are when restored; remembers a bounded number of tokens."""

    def __init__(self, channel: Channel, use, remembered: int = 600_000):
        self.channel, self.use, self.remembered = channel, use, remembered

    def __missing__(self, token: str):
        if len(self) >= self.remembered:
            self.clear()
        got = self[token] = self.use(LETTERS.findall(self.channel.restore_token(token)))
        return got

    def of(self, text: str) -> Iterator:
        """The results for the distinct tokens of a text, and for its spaced-out words."""
        low = text.lower()
        yield from map(self.__getitem__, set(low.split()))
        for words in self.channel.runs(low):
            yield self.use(words)


def word_features(words: list[str]) -> tuple[str, ...]:
    """Words, and their beginnings marked by a hyphen."""
    return tuple(x for w in words for x in (w, *(w[:k] + "-" for k in PREFIXES if len(w) > k)))


@dataclass(frozen=True)
class Model:
    grams: dict[str, int]
    lexicon: dict[str, float]
    weights: tuple[float, ...]
    words: dict[str, int] = field(default_factory=dict)

    def hits(self, words: list[str]) -> float:
        """The largest log-odds of the words or their beginnings; 0 if the lexicon has none."""
        return max((self.lexicon[x] for x in word_features(words) if x in self.lexicon), default=0.0)


def summary(readings: Readings, text: str) -> list[float]:
    found = [x for x in readings.of(text) if x]
    return [math.log1p(sum(found)), float(bool(found)), math.log1p(len(found))]


def probability(x: np.ndarray, weights: tuple[float, ...]) -> np.ndarray:
    z = x @ np.array(weights[1:]) + weights[0]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4, steps: int = 50) -> tuple[float, ...]:
    """Logistic regression with an intercept by Newton steps."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    keep = np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        move = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x / len(x) + keep, x.T @ (p - y) / len(x) + keep @ w)
        w -= move
        if np.abs(move).max() < 1e-7:
            break
    return tuple(w)


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 40_000, least_odds: float = 4.0, least_docs: int = 3, least_ratio: float = 6.0, seed: int = 11) -> Model:
    """The character model from all of ``docs``; words and curve from labelled rows.

    At most ``max_labelled`` labelled rows, the lowest by a hash of their id, are
    used: that bound is the only sample; of rows that repeat an id the least text
    counts.  One half gives the lexicon: the features ``least_odds`` times likelier
    under the label, met in ``least_docs`` toxic texts and with a log likelihood
    ratio of ``least_ratio`` or more; the other half gives the curve.  Copies teach
    the lexicon once.  A token counts once in a text.  With one label only, every
    score is near that label; without rows they are near 0.
    """
    counted = materialize(count_language(docs), "language")
    grams = {r["gram"]: r["n"] for r in counted.where("gram not like ' %'").collect()}
    spoken = sum(n for g, n in grams.items() if g[:2] == "^^")
    words = {r["gram"][1:]: r["n"] for r in counted.where("gram like ' %'").where(F.col("n") * RAREST >= spoken).collect()}
    forget(counted)
    rows = labels.where("toxic is not null and doc_id is not null").select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic"))
    rows = rows.orderBy(F.xxhash64("_id", F.lit(seed)), "_id", "toxic").limit(max_labelled)
    half = F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(2)) == 0
    known = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known = known.join(F.broadcast(rows), known["doc_id"] == rows["_id"]).groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    known = known.select("doc_id", "text", "toxic", half.alias("first"))
    share = docs.sparkSession.sparkContext.broadcast((grams, words))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readings = Readings(channel(*share.value), word_features)
        for b in batches:
            counts = (Counter(), Counter())
            for t, y in zip(b.column(0), b.column(1)):
                counts[y.as_py() > 0].update({x for xs in readings.of(t.as_py()) for x in xs})
            some = list(counts[0].keys() | counts[1].keys())
            cols = [pa.array(some, pa.string()), *(pa.array([c[x] for x in some], pa.int64()) for c in counts)]
            yield pa.RecordBatch.from_arrays(cols, ["x", "n0", "n1"])

    first = known.where("first").groupBy("text").agg(F.max("toxic").alias("toxic"))
    total = {bool(r["y"]): r["n"] for r in first.groupBy((F.col("toxic") > 0).alias("y")).agg(F.count("*").alias("n")).collect()}
    n0, n1 = total.get(False, 0), total.get(True, 0)
    if not n0 or not n1:
        return Model(grams, {}, ((4.0 if n1 else -4.0), 0.0, 0.0, 0.0), words)
    found = first.mapInArrow(features, "x string, n0 long, n1 long").groupBy("x").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    odds = F.log((F.col("n1") + 0.5) / (n1 + 1.0)) - F.log((F.col("n0") + 0.5) / (n0 + 1.0))
    fair = (F.col("n0") + F.col("n1")) * (n1 / (n0 + n1))
    ratio = F.col("n1") * F.log(F.col("n1") / fair) + F.when(F.col("n0") > 0, F.col("n0") * F.log(F.col("n0") / (F.col("n0") + F.col("n1") - fair))).otherwise(0.0)
    found = found.where(F.col("n1") >= least_docs).select("x", odds.alias("odds"), ratio.alias("ratio"))
    top = found.where(F.col("odds") >= math.log(least_odds)).where(F.col("ratio") >= least_ratio).collect()
    model = Model(grams, {r["x"]: r["odds"] for r in top}, (0.0,) * 4, words)
    use = docs.sparkSession.sparkContext.broadcast(model)

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readings = Readings(channel(use.value.grams, use.value.words), use.value.hits)
        for b in batches:
            x = [summary(readings, t.as_py()) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(1)], ["x", "toxic"])

    second = known.where("not first").select("text", "toxic").mapInArrow(summaries, "x array<double>, toxic int")
    got = second.groupBy("x", "toxic").agg(F.count("*").alias("n")).orderBy("x", "toxic").toPandas()
    if not len(got):
        return Model(grams, model.lexicon, (-2.0, 1.0, 1.0, 0.0), words)
    x = np.repeat(np.array(got["x"].tolist()), got["n"], axis=0)
    return Model(grams, model.lexicon, logistic(x, np.repeat(got["toxic"].to_numpy() > 0, got["n"])), words)


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score, predicted)`` of each row of ``docs(doc_id, text)``, in one pass.

    A null, empty or blank text has no hit and gets the curve's value there.  Rows
    with equal or null ids are scored each on its own; other columns are left out.
    Tokens and spaced runs of any length are decoded.  No row gives no row.
    """
    use = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = use.value
        readings = Readings(channel(m.grams, m.words), m.hits)
        for b in batches:
            x = np.array([summary(readings, t.as_py() or "") for t in b.column(1)]).reshape(-1, 3)
            p = probability(x, m.weights)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int")
