"""Language identification with spans.

Fit: words of labelled texts are counted by language in letter trigrams, with word ends; each trigram of each language gets
a smoothed log-probability. Also counted: which scripts a language is written in.
Predict: a word's script narrows the candidate languages; a word's score for a candidate is the sum over its trigrams. A
Viterbi pass over the words of the whole text, with a penalty for each switch of language, labels spans of mixed text. The
language with most letters is the prediction, and its share of the letters is the score.

The pass is skipped where it can't matter: if no run of words gains more in any other language than half a switch costs,
k foreign runs gain at most k / 2 switches and pay k, or k - 1 if all runs are foreign, so the best single language is the best path.

A text that is null or has no letter is `und` with score 0, as is every text if nothing was learned. Letters of scripts that no learned language uses count as
nobody's, so they lower the score. Each row is judged by its own text: rows that repeat have one result, and columns with other names aren't looked at. Ties go to the language that sorts first.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import checkpointed, utf8

#: About so many labelled rows of each language are fitted, chosen by a hash of their id; all rows are labelled.
FIT_ROWS = 1500
#: Trigrams kept, most frequent first; the others share the smoothing.
TRIGRAMS = 60_000
#: Log-likelihood that a switch of language costs.
SWITCH = 25.0
#: A script counts as a language's own from this share of its letters.
OWN_SCRIPT = 0.01
#: Words kept ready by one worker; emptied when full.
CACHE_ENTRIES = 250_000

UNKNOWN = "und"

# First code point of a range, and its script.
_RANGES = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Other"), (0x0E00, "Thai"), (0x0E80, "Other"), (0x10A0, "Georgian"),
    (0x1100, "Hangul"), (0x1200, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x3040, "Kana"), (0x3100, "Han"),
    (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Other"), (0xFF21, "Latin"), (0xFF66, "Kana"), (0x10000, "Other"), (0x20000, "Han"),
]
_STARTS, _NAMES = [a for a, _ in _RANGES], [b for _, b in _RANGES]
_LETTERS = re.compile(r"[^\W\d_]+")


def script(word: str) -> str:
    """The script of a word's first letter."""
    return _NAMES[bisect_right(_STARTS, ord(word[0])) - 1]


def trigrams(word: str) -> list[str]:
    marked = f"\x02{word}\x03"
    return [marked[k : k + 3] for k in range(len(marked) - 2)]


@dataclass
class Model:
    languages: list[str]
    index: dict[str, int]  # trigram to row of weights; rows end with that of unknown trigrams
    weights: np.ndarray
    scripts: dict[str, np.ndarray]  # script to which languages use it


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        words: dict[str, Counter] = {}
        for lang, raw in zip(batch["lang"], batch["raw"]):
            words.setdefault(lang, Counter()).update(_LETTERS.findall(raw.decode("utf-8", "replace").lower()))
        rows = []
        for lang, counts in words.items():
            grams, scripts = Counter(), Counter()
            for word, n in counts.items():
                scripts[script(word)] += n * len(word)
                for gram in trigrams(word):
                    grams[gram] += n
            rows += [(lang, "g", k, n) for k, n in grams.items()] + [(lang, "s", k, n) for k, n in scripts.items()]
        yield pd.DataFrame(rows, columns=["lang", "kind", "part", "n"])


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = FIT_ROWS, kept: int = TRIGRAMS) -> Model:
    """labelled: rows to learn from; those without a language are left out. A language of more than `rows` rows is
    sampled by a hash of the key, at the rate that leaves about `rows`. The model's size is bounded by `kept`."""
    named = labelled.select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text")).filter("lang is not null")
    # a row for each language, which the model has anyway; as literals they need no join that would shuffle texts
    sizes = {r["lang"]: r["n"] for r in named.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], {}, np.zeros((1, 0), np.float32), {})
    rates = F.create_map(*[F.lit(x) for name, n in sorted(sizes.items()) for x in (name, min(1_000_000, -(-1_000_000 * rows // n)))])
    chosen = named.filter(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < F.element_at(rates, F.col("lang"))).select("lang", utf8("text").alias("raw"))
    counts = checkpointed(chosen.mapInPandas(_counted, "lang string, kind string, part string, n long").groupBy("kind", "part", "lang").agg(F.sum("n").alias("n")))
    grams = counts.filter("kind = 'g'").groupBy("part").agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"))
    best = grams.orderBy(F.col("total").desc(), "part").limit(kept).collect()
    totals = {r["lang"]: r["n"] for r in counts.filter("kind = 'g'").groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    letters = counts.filter("kind = 's'").select("lang", "part", "n").collect()
    languages = sorted(totals)
    at = {name: k for k, name in enumerate(languages)}
    table = np.zeros((len(best) + 1, len(languages)))
    for k, row in enumerate(best):
        for name, n in row["by"].items():
            table[k, at[name]] = n
    all_of = np.array([totals[name] for name in languages], float)
    weights = np.log(table + 0.5) - np.log(all_of + 0.5 * (len(best) + 1))
    scripts = {}
    total = Counter()
    for r in letters:
        total[r["lang"]] += r["n"]
    for r in letters:
        if r["n"] >= OWN_SCRIPT * total[r["lang"]]:
            scripts.setdefault(r["part"], np.zeros(len(languages), bool))[at[r["lang"]]] = True
    return Model(languages, {row["part"]: k for k, row in enumerate(best)}, weights.astype(np.float32), scripts)


class Labeller:
    def __init__(self, model: Model):
        self.model = model
        self.unknown = len(model.index)
        self._empty()

    def _empty(self) -> None:
        self.place: dict[str, int] = {}
        self.scores = np.zeros((1024, len(self.model.languages)))
        self.known = np.zeros(1024, bool)

    def learn(self, words: set[str]) -> None:
        """Makes the scores of words ready."""
        if len(self.place) > CACHE_ENTRIES:
            self._empty()
        new = [w for w in words if w not in self.place]
        if not new or not self.model.languages:
            return
        first = len(self.place)
        while first + len(new) > len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            self.known = np.concatenate([self.known, np.zeros_like(self.known)])
        get, unknown = self.model.index.get, self.unknown
        flat: list[int] = []
        starts = []
        for word in new:
            starts.append(len(flat))
            marked = f"\x02{word}\x03"
            flat += [get(marked[k : k + 3], unknown) for k in range(len(word))]
        sums = np.add.reduceat(self.model.weights[flat].astype(float), starts, axis=0)
        none = np.zeros(len(self.model.languages), bool)
        use = np.array([self.model.scripts.get(script(w), none) for w in new])
        known = use.any(axis=1)
        # a language that isn't a candidate scores as the least likely candidate would if every trigram were unknown
        least = np.minimum(sums.min(axis=1), 0)[:, None] - 10.0
        scored = np.where(use, sums, least)
        scored[~known] = 0
        here = slice(first, first + len(new))
        self.scores[here], self.known[here] = scored, known
        self.place.update(zip(new, range(first, first + len(new))))

    def path(self, scores: np.ndarray) -> np.ndarray:
        """The language of every word: the best path under the penalty."""
        best = int(np.argmax(scores.sum(axis=0)))
        gains = np.cumsum(scores - scores[:, [best]], axis=0)
        floor = np.minimum(np.minimum.accumulate(np.concatenate([np.zeros((1, scores.shape[1])), gains[:-1]])), 0)
        if (gains - floor).max() <= SWITCH / 2:
            return np.full(len(scores), best)
        now, came = scores[0].tolist(), []
        for row in scores[1:].tolist():
            top = max(now)
            least, leader = top - SWITCH, now.index(top)
            came.append([k if v >= least else leader for k, v in enumerate(now)])
            now = [(v if v >= least else least) + x for v, x in zip(now, row)]
        out = [now.index(max(now))]
        for step in reversed(came):
            out.append(step[out[-1]])
        return np.array(out[::-1])

    def words(self, text: str) -> list[str]:
        return _LETTERS.findall(text.lower())

    def label(self, words: list[str]) -> tuple[str, float, np.ndarray | None]:
        """(language, score, language of each word) for words that are ready."""
        if not self.model.languages or not words or not (any(map(str.isalpha, words)) or any(map(str.isalpha, "".join(words)))):
            return UNKNOWN, 0.0, None
        place = self.place
        at = np.array([place[w] for w in words])
        size = np.array(list(map(len, words)))
        known = self.known[at]
        labels = self.path(self.scores[at])
        letters = np.bincount(labels[known], size[known], len(self.model.languages))
        best = int(letters.argmax())
        return self.model.languages[best], float(letters[best] / size.sum()), labels

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, language) of the runs of one language, from the first letter to the last, in code points."""
        found = [(m.start(), m.end(), m[0].lower()) for m in _LETTERS.finditer(text)]
        words = [w for _, _, w in found]
        self.learn(set(words))
        _, _, labels = self.label(words)
        out: list[tuple[int, int, str]] = []
        for (start, end, _), k in zip(found, labels if labels is not None else ()):
            name = self.model.languages[k]
            out = [*out[:-1], (out[-1][0], end, name)] if out and out[-1][2] == name else [*out, (start, end, name)]
        return out

    def predict(self, raws: list[bytes]) -> Iterator[tuple[str, float, float]]:
        """(language, score, share of the letters that are in words that some learned language could have)."""
        for start in range(0, len(raws), 256):
            cut = [self.words(raw.decode("utf-8", "replace")) for raw in raws[start : start + 256]]
            self.learn(set().union(*cut))
            for words in cut:
                name, score, labels = self.label(words)
                size = np.array(list(map(len, words)))
                known = 0.0 if labels is None else float(size[self.known[[self.place[w] for w in words]]].sum() / size.sum())
                yield name, score, known


def predicted(spark: SparkSession, model: Model, text: Column) -> Column:
    """Struct of lang_pred, score and known, of a column of bytes. It is marked as not deterministic, which it is, so that a filter on it
    doesn't have it evaluated a second time."""
    shared = spark.sparkContext.broadcast(model)  # bounded by TRIGRAMS rows

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        labeller = Labeller(shared.value)
        for batch in batches:
            yield pd.DataFrame(labeller.predict(list(batch)), columns=["lang_pred", "score", "known"])

    return F.pandas_udf(run, "struct<lang_pred: string, score: double, known: double>").asNondeterministic()(text)
