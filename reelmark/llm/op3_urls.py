"""URL filters: a bit-parallel wildcard automaton over canonical urls.

Glob rules (``*`` any run, ``?`` any one sign) become state bits in one multiword mask: bit i of a rule
says that its first i signs are matched. One Shift-And step per sign of the url moves all bits of all
rules at once, for all urls of a batch side by side:

    D = ((D << 1) & B[sign]) | (D & S)

with B the bits that a sign may set and S the bits that a ``*`` keeps. A rule fits if its last bit is set
at the url's end. Of several fitting rules the longest wins, then the first given.

Defined results: a null url, or one without ``://``, has empty host and path, fits no host rule and gets
the default verdict; an empty table gives an empty result; repeated rows are judged row by row. Only the id
and the url are read, so other columns can't clash.
"""

from __future__ import annotations

import string
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ANY_RUN, ANY_ONE = -1, -2
#: Stands between host and path; no text holds it.
EDGE = sys.maxunicode + 1
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
LANES = 1 << 14


def host_path(url: str | None) -> tuple[str, str]:
    at = -1 if url is None else url.find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    stop = min((p for p in map(rest.find, "/?#") if p >= 0), default=len(rest))
    end = min((p for p in map(rest.find, "?#") if p >= 0), default=len(rest))
    return rest[:stop].translate(LOWER), rest[stop:end]


def host_rule(rule: str) -> list[int]:
    """The signs of a rule ``host/path``: the host and all below it, paths that start with its path."""
    host, slash, path = rule.partition("/")
    return [ANY_RUN, *map(ord, "." + host), EDGE, *map(ord, slash + path), ANY_RUN]


class Automaton:
    """All rules, each a list of signs, in one multiword mask."""

    def __init__(self, rules: list[list[int]]):
        width = sum(1 + sum(s != ANY_RUN for s in rule) for rule in rules)
        self.words = -(-max(width, 1) // 64)
        signs = sorted({s for rule in rules for s in rule if s >= 0})
        self.sign_of = np.zeros(EDGE + 1, np.uint16)
        self.sign_of[signs] = np.arange(1, len(signs) + 1)
        bits = lambda: [0] * (len(signs) + 1)
        step, first, stay, self.last = bits(), 0, 0, []
        at = 0
        for rule in rules:
            first |= 1 << at
            for s in rule:
                if s == ANY_RUN:
                    stay |= 1 << at
                    continue
                at += 1
                for k in range(len(step)) if s == ANY_ONE else [int(self.sign_of[s])]:
                    step[k] |= 1 << at
            self.last.append(at)
            at += 1
        self.step = np.array([self._split(m) for m in step], np.uint64)
        self.first, self.stay = (np.array(self._split(m), np.uint64) for m in (first, stay))

    def _split(self, mask: int) -> list[int]:
        return [(mask >> (64 * w)) & ((1 << 64) - 1) for w in range(self.words)]

    def fits(self, points: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Which rules (columns) fit which texts (rows); text k is points[starts[k]:starts[k + 1]]."""
        sizes = np.diff(starts)
        order = np.argsort(-sizes, kind="stable")
        begin, sizes = starts[:-1][order], sizes[order]
        state = np.tile(self.first, (len(order), 1))
        signs = self.sign_of[points]
        live = len(order)
        for t in range(int(sizes[0]) if live else 0):
            live = int(np.searchsorted(-sizes[:live], -t, side="left"))  # longer than t
            now = state[:live]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            moved &= self.step[signs[begin[:live] + t]]
            now &= self.stay
            now |= moved
        out = np.empty((len(order), len(self.last)), bool)
        for r, bit in enumerate(self.last):
            out[order, r] = (state[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1) != 0
        return out


def canonical(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``.host EDGE path`` of each url as code points, and where each starts."""
    points = np.frombuffer("".join(f".{h}\x00{p}" for h, p in zip(hosts, paths)).encode("utf-32-le"), np.uint32).copy()
    starts = np.cumsum([0, *(len(h) + len(p) + 2 for h, p in zip(hosts, paths))])
    points[starts[:-1] + 1 + np.fromiter(map(len, hosts), np.int64, len(hosts))] = EDGE
    return points, starts


def judge(pages: DataFrame, rules: list[tuple[str, str]], *, default: str = "allow", id_column: str = "page_id", url: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) of every row; rules are (host/path, verdict)."""
    ranked = sorted(rules, key=lambda r: -len(r[0]))
    names, verdicts = [r for r, _ in ranked], [v for _, v in ranked]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton([host_rule(r) for r in names])
        for whole in batches:
            for k in range(0, whole.num_rows, LANES):
                batch = whole.slice(k, LANES)
                split = [host_path(u) for u in batch.column(1).to_pylist()]
                hosts, paths = [h for h, _ in split], [p for _, p in split]
                fits = automaton.fits(*canonical(hosts, paths))
                best = np.where(fits.any(axis=1), fits.argmax(axis=1), -1).tolist() if names else [-1] * len(hosts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0), pa.array(hosts, pa.string()), pa.array(paths, pa.string()),
                        pa.array([names[b] if b >= 0 else None for b in best], pa.string()),
                        pa.array([verdicts[b] if b >= 0 else default for b in best], pa.string()),
                    ],
                    names=[id_column, "host", "path", "rule", "verdict"],
                )

    kind = pages.schema[id_column].dataType.simpleString()
    return pages.select(F.col(id_column), F.col(url)).mapInArrow(
        work, f"`{id_column}` {kind}, host string, path string, rule string, verdict string"
    )
