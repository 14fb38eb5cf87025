"""Language of a text by cross-parsing against labelled texts.

For each language a suffix automaton is built from a bounded sample of its labelled
texts. A word, with a blank on both sides, is cut greedily into the longest pieces
that occur in the sample; a text's cost in a language is the number of those phrases
per character over all its words. The language with the lowest cost wins, ties go to
the smaller name. Phrases end at word ends, so a word is parsed once per worker
process however often it occurs.

A text that is null or has no letter gets ``und`` and score 0; so does every text
where nothing was labelled. Texts with null labels or null ids are not learnt from.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from patchloom.llm.tools import held, portions

# Labelled texts sampled per language, and characters learnt from per language.
SAMPLE_TEXTS = 200
SAMPLE_CHARS = 120_000
# Languages learnt at most; more labels than this are an error, not a cut.
MAX_LANGUAGES = 200
# Words whose costs a Python worker remembers.
REMEMBERED = 250_000
UNKNOWN = "und"

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters, in lower case; numerals such as fractions and circled digits are none."""
    words = _WORD.findall(text.lower())
    if "".join(words).isalpha():
        return words
    return [w for word in words for w in "".join(c if c.isalpha() else " " for c in word).split()]


class SuffixAutomaton:
    """Transitions of the automaton that accepts every substring of ``text``."""

    def __init__(self, text: str):
        self.next: list[dict[str, int]] = [{}]
        link, length, last = [-1], [0], 0
        for letter in text:
            new = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and letter not in self.next[p]:
                self.next[p][letter] = new
                p = link[p]
            if p >= 0:
                q = self.next[p][letter]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    copy = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.next[p].get(letter) == q:
                        self.next[p][letter] = copy
                        p = link[p]
                    link[q] = link[new] = copy
            last = new

    def phrases(self, text: str) -> int:
        """Number of greedy longest matches that cut ``text``; an unseen letter is one."""
        root, state, count = self.next[0], {}, 0
        for letter in text:
            to = state.get(letter)
            if to is None:
                count += 1
                to = root.get(letter)
            state = {} if to is None else self.next[to]
        return count


class Judge:
    """Costs of texts in every learnt language."""

    def __init__(self, samples: dict[str, str]):
        self.names = sorted(samples)
        self.automata = [SuffixAutomaton(samples[n]) for n in self.names]
        self.place: dict[str, int] = {}
        self.costs = np.zeros((1024, len(self.names)), np.int64)

    def _learn(self, words: set[str]) -> None:
        if len(self.place) > REMEMBERED:
            self.place.clear()
        for word in words:
            if word not in self.place:
                at = self.place[word] = len(self.place)
                if at >= len(self.costs):
                    self.costs = np.concatenate([self.costs, np.zeros_like(self.costs)])
                self.costs[at] = [a.phrases(f" {word} ") for a in self.automata]

    def judge(self, text: str | None) -> tuple[str, float]:
        words = words_of(text) if text else []
        if not words or not self.names:
            return UNKNOWN, 0.0
        if len(self.place) > REMEMBERED:
            self.place.clear()
        place = self.place
        try:
            at = [place[w] for w in words]
        except KeyError:
            self._learn(set(words))
            at = [self.place[w] for w in words]
        total = self.costs[np.array(at)].sum(axis=0) / (sum(map(len, words)) + len(words))
        best = int(np.argmin(total))
        if len(total) == 1:
            return self.names[0], 1.0
        second = float(np.min(np.delete(total, best)))
        return self.names[best], second / (second + float(total[best]))


def samples(docs: DataFrame, text_col: str, label_col: str, id_col: str) -> dict[str, str]:
    """Text to learn from per label: up to ``SAMPLE_TEXTS`` texts drawn by a hash of the
    id, joined up to ``SAMPLE_CHARS`` characters."""
    labelled = docs.filter(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(label_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col)).alias("draw"), F.col(id_col).alias("id"))
    order = Window.partitionBy("lang").orderBy("draw", "id")
    drawn = labelled.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= SAMPLE_TEXTS)
    keys = drawn.select("lang", "nth", "id").collect()  # bounded: labels times SAMPLE_TEXTS
    if len({k["lang"] for k in keys}) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} labels")
    if not keys:
        return {}
    nth = {(k["lang"], k["id"]): k["nth"] for k in keys}
    # rows that repeat an id give one text, so what is collected stays bounded
    rows = docs.filter(F.col(id_col).isin([k["id"] for k in keys])).groupBy(
        F.col(label_col).cast("string").alias("lang"), F.col(id_col).alias("id")).agg(
        F.min(F.substring(F.col(text_col), 1, SAMPLE_CHARS)).alias("text")).collect()
    found: dict[str, str] = {}
    for row in sorted((r for r in rows if (r["lang"], r["id"]) in nth and r["text"]), key=lambda r: nth[r["lang"], r["id"]]):
        words = " ".join(words_of(row["text"]))
        found[row["lang"]] = f"{found.get(row['lang'], ' ')}{words} "[:SAMPLE_CHARS]
    return found


def _own_judge(known: dict[str, str]) -> Judge:
    """One judge per worker process and sample."""
    return held(("language", hash(tuple(sorted(known.items())))), lambda: Judge(known))


def predict(docs: DataFrame, known: dict[str, str], text_col: str = "text", lang_col: str = "lang_pred",
            score_col: str = "score") -> DataFrame:
    """``docs`` with the prediction and its score; columns of these names are replaced."""
    docs = docs.drop(lang_col, score_col)
    sent = docs.sparkSession.sparkContext.broadcast(known)  # at most MAX_LANGUAGES * SAMPLE_CHARS characters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _own_judge(sent.value)
        for batch in (part for b in batches for part in portions(b, text_col)):
            found = [judge.judge(t) for t in batch.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                [*batch.schema.names, lang_col, score_col])

    out = StructType([*docs.schema.fields, StructField(lang_col, StringType()), StructField(score_col, DoubleType())])
    return docs.mapInArrow(run, out)


def held_out(id_col: str = "doc_id") -> Column:
    """Documents that nothing is learnt from: checksum of the id is 2 modulo 4."""
    return F.crc32(F.col(id_col).cast("string")) % 4 == 2


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang",
             learn: DataFrame | None = None) -> DataFrame:
    """``id_col, held_out, lang_pred, score`` for every row of ``docs``, learnt from the
    rows of ``learn`` (``docs`` itself by default) that are not held out."""
    source = (docs if learn is None else learn).filter(~F.coalesce(held_out(id_col), F.lit(False)))
    found = predict(docs.select(id_col, text_col), samples(source, text_col, label_col, id_col), text_col)
    return found.select(id_col, F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), "lang_pred", "score")
