"""Language identification by cross-parsing entropy.

Per language, a suffix automaton of labelled text answers how long the longest match is that starts at a
place of a new text: cutting the text greedily into longest matches gives its phrases, and the fewer
phrases (times the bits that name a place in the training text), the closer the language. The language
needing fewest normalised phrases wins.

Fitting reads a bounded sample: at most ``DOCS`` documents a language, the least hashes of as many buckets,
and ``LETTERS`` letters of them, of a long text `RUNS` runs that lie evenly over all of it. Everything else runs over whole texts: letters are
lower-cased, all else is a blank; automata are dense tables, and numpy parses many lanes of at most
``LANE`` signs side by side, each lane starting a new phrase.

Defined results: ``und`` with score 0 for a null text, one without letters, or where no label can be
learned; a tie goes to the language first in order; repeated rows and null ids are judged row by row; an
empty table gives an empty result. The score is 1 - fewest / second fewest normalised phrases, 1 if one
language only is known. Only id, text and, for fitting, the label are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelmark.llm import pretokens
from reelmark.session import cut_lineage

DOCS, LETTERS, LANE = 64, 20_000, 1024
RUNS = 4  # parts of a long text, evenly over all of it, that the sample takes
UNKNOWN = "und"


def held_out(id_column: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 4 == 2, F.lit(False))


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of lower-case letters with single blanks (0) between words; where each text ends."""
    _, points, starts = pretokens.joined([t.lower() for t in texts])
    kept = np.where(pretokens.classes()[points] == pretokens.LETTER, points, 0)
    use = kept != 0
    use[1:] |= kept[:-1] != 0
    use[0] = kept[0] != 0
    return kept[use], np.concatenate([[0], np.cumsum(use)])[starts[1:]]


def spread(points: np.ndarray, most: int, runs: int = RUNS) -> list[np.ndarray]:
    """All, or ``most`` of them in runs that lie evenly over the whole."""
    if len(points) <= most:
        return [points]
    size = max(1, most // runs)
    return [points[a : a + size] for a in np.linspace(0, len(points) - size, max(1, most // size)).astype(np.int64)]


def suffix_automaton(signs: list[int], alphabet: int) -> np.ndarray:
    """Transitions of every state (rows) by sign; -1 where there is none. State 0 is the start."""
    step, link, length, last = [{}], [-1], [0], 0
    for c in signs:
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                clone = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                link[q] = link[new] = clone
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
        last = new
    table = np.full((len(step), alphabet), -1, np.int32)
    for state, moves in enumerate(step):
        for c, to in moves.items():
            table[state, c] = to
    return table


class Model:
    """Automata of all languages; `costs` gives the normalised phrases of texts."""

    def __init__(self, samples: dict[str, list[str]], most: int = LETTERS):
        self.languages = sorted(samples)
        lines = {}
        for name in self.languages:
            points, ends = letters(samples[name])
            share = max(1, most // max(1, len(ends)))
            begins = np.concatenate([[0], ends[:-1]])
            parts = [part for b, e in zip(begins, ends) for part in spread(points[b:e], share)]
            lines[name] = np.concatenate([np.append(p, 0) for p in parts])[:most]
        known = np.unique(np.concatenate([np.zeros(1, np.uint32), *lines.values()]))  # 0 comes first
        self.sign_of = np.full(0x110000, len(known), np.uint16)
        self.sign_of[known] = np.arange(len(known))
        self.width = len(known) + 1
        self.tables, self.bits = [], []
        for name in self.languages:
            table = suffix_automaton(self.sign_of[lines[name]].tolist(), self.width)
            restart = np.maximum(table[0], 0)
            broken = table < 0
            # A phrase ends before a sign that can't go on; a sign never seen in training is one by itself.
            ended = broken.astype(np.int32) + (broken & (table[0] < 0))
            ended[0] = broken[0]
            self.tables.append((np.where(broken, restart, table) * 4 + ended).astype(np.int32).ravel())
            self.bits.append(math.log2(len(lines[name]) + 1))

    def costs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Costs of each text (rows) by language, and its number of letters and blanks."""
        points, ends = letters(texts)
        signs = self.sign_of[points].astype(np.int32)
        begins = np.concatenate([[0], ends[:-1]])
        size = ends - begins
        lanes = -(-size // LANE)
        doc = np.repeat(np.arange(len(texts)), lanes)
        part = np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = begins[doc] + part * LANE
        long = np.minimum(ends[doc] - at, LANE)
        order = np.argsort(-long, kind="stable")
        at, long, doc = at[order], long[order], doc[order]
        live = np.searchsorted(-long, -np.arange(int(long[0]) if len(long) else 0), side="left")
        out = np.zeros((len(texts), len(self.languages)))
        state = [np.zeros(len(at), np.int32) for _ in self.tables]
        phrases = [np.ones(len(at), np.int32) for _ in self.tables]
        for t, n in enumerate(live.tolist()):
            sign = signs[at[:n] + t]
            for s, p, table in zip(state, phrases, self.tables):
                went = table[s[:n] * self.width + sign]
                p[:n] += went & 3
                s[:n] = went >> 2
        for k, p in enumerate(phrases):
            out[:, k] = np.bincount(doc, p, len(texts)) * self.bits[k]
        return out, size

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        for a, b in pretokens.blocks(texts) if self.languages else ():
            cost, size = self.costs(texts[a:b])
            best = cost.argmin(axis=1)
            least = cost[np.arange(b - a), best]
            second = np.partition(cost, 1, axis=1)[:, 1] if len(self.languages) > 1 else np.full(b - a, np.inf)
            for i in np.flatnonzero(size).tolist():
                names[a + i] = self.languages[best[i]]
                scores[a + i] = 1 - least[i] / second[i]
        return names, scores


def fit(docs: DataFrame, use: Column, *, id_column: str = "doc_id", text: str = "text", label: str = "lang", most_docs: int = DOCS) -> Model:
    """A model from a sample of at most ``most_docs`` labelled documents a language."""
    rows = docs.where(use & F.col(label).isNotNull() & F.col(text).isNotNull()).select(
        F.col(label).alias("label"), F.col(text).alias("text"), F.xxhash64(id_column, F.length(text)).alias("key")
    )
    picked = cut_lineage(rows.groupBy("label", F.pmod("key", F.lit(most_docs)).alias("bucket")).agg(F.min("key").alias("key")))
    # Every key is one document or copies of it; the sample's texts, a bounded number, come to the driver.
    size = 8 * LETTERS // most_docs // RUNS
    step = (F.length("text") - size) / (RUNS - 1)
    runs = F.concat_ws(" ", *[F.col("text").substr((step * i).cast("int") + 1, F.lit(size)) for i in range(RUNS)])
    found = rows.join(picked.select("label", "key"), ["label", "key"], "left_semi").select(
        "label", "key", F.when(F.length("text") <= RUNS * size, F.col("text")).otherwise(runs).alias("text")
    ).dropDuplicates(["label", "key"])
    samples: dict[str, list[str]] = {}
    for row in sorted(found.collect(), key=lambda r: (r["label"], r["key"])):
        samples.setdefault(row["label"], []).append(row["text"])
    return Model({k: v for k, v in samples.items() if letters(v)[1][-1]})


def identify(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """The rows as a struct ``doc``, with lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by LETTERS a language

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = [], [np.zeros(0)]
            for _, texts in pretokens.text_blocks(batch.column(0).field(place)):
                found = shared.value.predict(texts)
                names += found[0]
                scores.append(found[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(np.concatenate(scores))], names=["doc", "lang_pred", "score"]
            )

    place = docs.columns.index(text)
    packed = docs.select(F.struct("*").alias("doc"))
    return packed.mapInArrow(work, f"doc {packed.schema['doc'].dataType.simpleString()}, lang_pred string, score double")
