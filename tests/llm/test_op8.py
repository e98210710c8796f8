import random

import numpy as np
import pytest

from reelmark.llm import op8_jaccard as op
from tests.llm.test_graph import brute

SCHEMA = "doc_id long, text string, lang string"


def shingles(text):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [w for w in (text or "").translate(table).replace("\t", " ").replace("\n", " ").split(" ") if w]
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def expected(rows):
    sets = [shingles(r[1]) for r in rows]
    edges = [
        (i, j) for i in range(len(sets)) for j in range(i)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
    ]
    root = brute(edges)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root.get(i, i), []).append(i)
    least = {g: min((rows[i][0] for i in m if rows[i][0] is not None), default=None) for g, m in groups.items()}
    return sorted(((r[0], len(s), least[root.get(i, i)]) for i, (r, s) in enumerate(zip(rows, sets))), key=repr)


def edited(words, draw, share):
    return [draw.choice("abcdefgh") * 3 + str(draw.random()) if draw.random() < share else w for w in words]


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(5)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for _ in range(25):
        base = [f"w{draw.randrange(10**6)}" for _ in range(draw.choice([3, 8, 60, 300]))]
        if draw.random() < 0.5:
            base += passage
        for _ in range(draw.choice([1, 1, 2, 6])):
            rows.append(" ".join(edited(base, draw, draw.choice([0, 0.01, 0.03, 0.06]))))
    hub = [f"h{i}" for i in range(150)]
    rows += [" ".join(edited(hub, draw, 0.02)) for _ in range(60)]
    rows += ["A b\tC d\ne", "a B c D E", None, "", " \t", "one two", "ONE two", "é É", "x " * 5000]
    return [(i, t, "en") for i, t in enumerate(rows)] + [(3, rows[3], "en"), (3, rows[9], "de"), (None, rows[40], None), (None, "lonely words of nobody else here", None)]


def test_components_equal_brute_force(spark, corpus):
    found = op.jaccard_components(spark.createDataFrame(corpus, SCHEMA).repartition(4))
    assert sorted(((r["id"], r["n_shingles"], r["component_id"]) for r in found.collect()), key=repr) == expected(corpus)


def test_blocks_of_an_island(spark, corpus, monkeypatch):
    monkeypatch.setattr(op, "TASK", 2000)
    found = op.jaccard_components(spark.createDataFrame(corpus, SCHEMA))
    assert sorted(((r["id"], r["n_shingles"], r["component_id"]) for r in found.collect()), key=repr) == expected(corpus)


def test_one_of_each_group_is_kept(spark, corpus):
    kept = op.jaccard_components(spark.createDataFrame(corpus, SCHEMA)).where("kept and n_shingles > 0").collect()
    sets = [shingles(r[1]) for r in corpus]
    linked = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    root = brute(linked)
    assert len(kept) == len({root.get(i, i) for i in range(len(sets)) if sets[i]})


def test_empty_table(spark):
    assert op.jaccard_components(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("heap", [0, 10**6])
def test_divide_skip_finds_all_that_reach_the_count(monkeypatch, heap):
    monkeypatch.setattr(op, "HEAP", heap)
    draw = random.Random(heap)
    for _ in range(200):
        lists = [np.array(sorted(draw.sample(range(40), draw.randrange(1, 30)))) for _ in range(draw.randrange(1, 15))]
        need = draw.randrange(1, len(lists) + 1)
        member, count = op.divide_skip(lists, need)
        want = {m: c for m in range(40) if (c := sum(m in x for x in lists)) >= need}
        assert dict(zip(member.tolist(), count.tolist())) == want
