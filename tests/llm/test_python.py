"""Packing, urls, search, near vectors, language, extraction, token counts."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from reelmark.llm import dom, op2_pack, op3_urls, op4_search, op6_neardup, op7_language, op9_extract, op10_counts
from reelmark.llm.queries import ORACLES, URL_RULES

DOCS = "doc_id long, text string, lang string, size long"
SIGNS = ["'s", "'re", "'", "  ", " ", "\n", "a", "B", "é", "ß", "İ", "Σ", "1", "23", "$$$", "<|endoftext|>", "'ll", "\t", "漢", "😀", "'d", "'S", "\x00", "½"]


def texts():
    draw = random.Random(1)
    return ["".join(draw.choice(SIGNS) for _ in range(draw.randrange(30))) for _ in range(600)] + ["", None, "word. " * 9000, "x" * 5000]


def test_token_counts_equal_the_library(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = list(enumerate(texts())) + [(None, "a b"), (0, "again")]
    got = op10_counts.token_counts(spark.createDataFrame([(i, t, "", 0) for i, t in rows], DOCS), path).collect()
    library = Tokenizer.from_file(path)
    want = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_pack_round_trip(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = list(enumerate(texts()))
    pieces = op2_pack.pack(spark.createDataFrame([(i, t, "", 0) for i, t in rows], DOCS).repartition(3), path).collect()
    library = Tokenizer.from_file(path)
    docs, windows = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert p["ids_crc32"] == zlib.crc32(p["ids"]) and len(p["ids"]) == 4 * p["length"]
        docs[p["doc_id"]].append((p["start"], np.frombuffer(p["ids"], "<u4").tolist(), p["doc_tokens"]))
        windows[p["sequence_id"]].append((p["offset"], p["length"]))
    for i, t in rows:
        parts = sorted(docs[i])
        ids = [x for _, part, _ in parts for x in part]
        assert ids == library.encode(t or "", add_special_tokens=False).ids + [0] and {n for _, _, n in parts} == {len(ids)}
        assert [s for s, _, _ in parts] == np.cumsum([0, *(len(p) for _, p, _ in parts)])[:-1].tolist()
    for parts in windows.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *(n for _, n in parts)])[:-1].tolist() and sum(n for _, n in parts) <= 1024
    assert op2_pack.pack(spark.createDataFrame([], DOCS), path).count() == 0


def test_windows_are_optimal():
    draw = random.Random(2)
    for _ in range(100):
        places = sorted(draw.sample(range(1, 60), 25)) + [60]
        penalties = [draw.choice([0, 2, 8]) for _ in places]
        at, best = [0, *places], [0]
        for j in range(1, len(at)):
            best.append(min((best[i] + penalties[j - 1] + 20 - (at[j] - at[i]) for i in range(j) if at[j] - at[i] <= 20), default=10**9))
        cuts = op2_pack.windows(places, penalties, 20)
        cost = sum(20 - (b - a) + penalties[places.index(b)] for a, b in zip([0, *cuts], cuts))
        assert cost == best[-1]


def test_url_rules(spark):
    import duckdb

    urls = [
        None, "", "no scheme", "http://com", "http://com/", "HTTP://WWW.Example.COM/en/x?y#z", "x://example.com/en/", "x://aexample.com/en/",
        "x://a.example.com/en", "x://net/es/", "x://a.b.net/fr/q://example.com/en/", "x://ÉCOM/", "x://a.net?/es/", "x://a.com#/", "x://net.com/" + "a" * 3000,
        "http://é.com/ü", "x://www.example.com/en/", "x://b.www.example.com/en/1",
    ]
    rows = [(i, u, "r") for i, u in enumerate(urls)] + [(0, urls[5], "r"), (None, urls[6], "r")]
    got = op3_urls.judge(spark.createDataFrame(rows, "page_id long, url string, rule string"), URL_RULES).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", [r[:2] for r in rows])
    assert sorted(map(tuple, got), key=repr) == sorted(con.execute(ORACLES["op3_url_filter"]).fetchall(), key=repr)
    assert op3_urls.judge(spark.createDataFrame([], "page_id long, url string"), URL_RULES).count() == 0


def test_automaton_against_fnmatch():
    import fnmatch

    draw = random.Random(4)
    globs = ["".join(draw.choice("ab*?") for _ in range(draw.randrange(1, 9))) for _ in range(60)]
    words = ["".join(draw.choice("abc") for _ in range(draw.randrange(10))) for _ in range(200)]
    rules = [[op3_urls.ANY_RUN if c == "*" else op3_urls.ANY_ONE if c == "?" else ord(c) for c in g] for g in globs]
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    fits = op3_urls.Automaton(rules).fits(points, np.cumsum([0, *map(len, words)]))
    assert fits.tolist() == [[fnmatch.fnmatchcase(w, g) for g in globs] for w in words]


VECS = "vec_id long, embedding array<float>, row string"


def vector_rows():
    draw = np.random.default_rng(6)
    x = draw.standard_normal((300, 16))
    x[60:90] = x[5] + 0.02 * draw.standard_normal((30, 16))
    x[100] = x[101]
    x[200:220] = x[70]  # copies of a vector that has near ones
    x[230:240] = x[230]  # and of one that has none
    rows = [(i, v.tolist(), "r") for i, v in enumerate(x)]
    return rows + [(400, None, "r"), (401, [1.0, None] * 8, "r"), (402, [float("nan")] * 16, "r"), (403, [float("inf")] * 16, "r"), (404, [0.0] * 16, "r"), (405, [], "r"), (406, [1.0, 2.0], "r"), (450, [3.0, 1.0], "r")]


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(op4_search, "CANDIDATES", 64)
    rows = vector_rows()
    got = op4_search.top_k(spark.createDataFrame(rows, VECS), F.col("id") % 50 == 0, 5).collect()
    good = [(i, np.floor(np.array(v, np.float32).astype(float) * 256).astype(int)) for i, v, _ in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for i, q in good:
        if i % 50 == 0:
            near = sorted((-int(q @ c), j) for j, c in good if j != i and len(c) == len(q))[:5]
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(near)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert op4_search.top_k(spark.createDataFrame([], VECS), F.col("id") % 50 == 0, 5).count() == 0


@pytest.mark.parametrize("hot", [4, 2048])
def test_near_vectors_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(op6_neardup, "HOT", hot)
    rows = vector_rows() + [(7, vector_rows()[5][1], "r")]
    got = op6_neardup.near_duplicates(spark.createDataFrame(rows, VECS)).collect()
    good = [k for k, (_, v, _) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    from tests.llm.test_graph import brute

    unit = {k: np.array(rows[k][1], np.float32).astype(float) for k in good}
    edges = [(a, b) for a in good for b in good if a > b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95 * np.sqrt((unit[a] @ unit[a]) * (unit[b] @ unit[b]))]
    root = brute(edges)
    degree = defaultdict(int)
    for a, b in edges:
        degree[a] += 1
        degree[b] += 1
    least = defaultdict(list)
    for k, r in enumerate(rows):
        least[root.get(k, k)].append(r[0])
    want = [(r[0], degree[k], min(least[root.get(k, k)]), r[0] == min(least[root.get(k, k)])) for k, r in enumerate(rows)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert op6_neardup.near_duplicates(spark.createDataFrame([], VECS)).count() == 0


def test_suffix_automaton_knows_all_substrings():
    signs = [random.Random(9).randrange(3) for _ in range(60)]
    table = op7_language.suffix_automaton(signs, 4)
    inside = {tuple(signs[i:j]) for i in range(60) for j in range(i, 61)}

    def known(word):
        state = 0
        for c in word:
            state = table[state, c]
            if state < 0:
                return False
        return True

    draw = random.Random(8)
    for _ in range(2000):
        word = tuple(draw.randrange(4) for _ in range(draw.randrange(1, 8)))
        assert known(word) == (word in inside)


def test_cross_parsing_equals_greedy_matching():
    model = op7_language.Model({"x": ["the cat sat on the mat"], "y": ["der hund lief in den wald"]})
    for text in ["the hat", "in der stadt", "zzz", "a", "cat cat cat hund"]:
        cost, _ = model.costs([text])
        for k, train in enumerate(["the cat sat on the mat", "der hund lief in den wald"]):
            train += " "
            phrases, at, line = 0, 0, text + " "
            while at < len(line):
                size = 0
                while at + size < len(line) and line[at : at + size + 1] in train:
                    size += 1
                at += max(1, size)
                phrases += 1
            assert abs(cost[0, k] / model.bits[k] - phrases) <= 1


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = op7_language.fit(docs, ~op7_language.held_out())
    rows = op7_language.identify(docs, model).select("doc.lang", "lang_pred", "score", op7_language.held_out("doc.doc_id").alias("out")).collect()
    held = [r for r in rows if r["out"]]
    assert held and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held) and all(0 <= r["score"] <= 1 for r in rows)
    odd = spark.createDataFrame([(1, None, "en", 0), (2, "", None, 0), (3, "12 $$", "en", 0), (None, "漢字", None, 0)], DOCS)
    assert [r["lang_pred"] == "und" for r in op7_language.identify(odd, model).collect()] == [True, True, True, False]
    assert op7_language.identify(odd.limit(0), model).count() == 0
    assert {r["lang_pred"] for r in op7_language.identify(odd, op7_language.fit(odd.limit(0), F.lit(True))).collect()} == {"und"}


PAGE = (
    "<html><body><nav><a href=/>Home</a></nav><article><h1>T &amp; t</h1><p><b>One\n two<br>three<p>Four<script>var x='</p>'</script>"
    "<aside>Side</aside></article><footer>&copy; me</footer>"
)


def test_extraction(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    model = op9_extract.fit(pages)
    rows = [(1, "u", PAGE, 0), (1, "u", PAGE, 0), (2, None, None, 0), (3, "u", "", 0), (None, "u", "<<<p", 0)]
    got = op9_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int"), model).collect()
    text = "T & t\n\nOne two three\n\nFour"
    assert [(r["page_id"], r["text"], r["n_chars"]) for r in got] == [(1, text, len(text))] * 2 + [(2, "", 0), (3, "", 0), (None, "", 0)]
    assert op9_extract.extract(pages.limit(0), model).count() == 0


def test_marginals_equal_enumeration():
    import itertools
    import math

    model = op9_extract.Model([op9_extract.skeleton(s) for s in op9_extract.SKELETONS])
    nodes, _ = dom.parse("<body><nav>abc</nav><article><p>long text, of words</p><div class=ad>x</div></article></body>")
    weight = [0.0] * len(nodes)
    total = 0.0
    own = []
    for values in op9_extract.evidence(nodes):
        pairs = [known.get(v, other) for (known, other), v in zip(model.nodes, values)]
        own.append([math.exp(sum(p[label] for p in pairs)) for label in (0, 1)])
    for labels in itertools.product((0, 1), repeat=len(nodes)):
        p = math.prod(own[k][x] for k, x in enumerate(labels))
        p *= math.prod(model.pairs[labels[n.parent]][x] for n, x in zip(nodes[1:], labels[1:]))
        total += p
        weight = [w + p * x for w, x in zip(weight, labels)]
    assert model.marginals(nodes) == pytest.approx([w / total for w in weight])
