"""Phrase mining against counting everything, with small blocks, saturated bitmaps and odd rows."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelmark.llm import op11_phrases

SCHEMA = "lang string, text string"


def texts():
    draw = random.Random(6)
    words = ["the", "Of", "new", "york", "city", "é", "漢", "İ", "a-b", "x" * 30, *(f"w{i}" for i in range(40))]
    weights = [30, 30, 12, 12, 8, 5, 5, 5, 5, 2, *[1] * 40]
    rows = []
    for i in range(150):
        out = []
        for _ in range(draw.randrange(60)):
            out.append("new york city hall" if draw.random() < 0.1 else draw.choices(words, weights)[0])
            out.append(draw.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "   "]))
        rows.append((draw.choice(["en", "en", "de", None]), "".join(out)))
    rows += [("en", None), ("en", ""), (None, " . \t"), ("und", "Q the the the the the")] + [("de", "same text of copies")] * 40
    return rows + [("en", "new york " * 500), ("fr", "one two three four five six seven " * 40 + "z" * 700 + " one two three")]


def pieces(rows):
    for lang, text in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", lower):
            yield lang or "und", [w for w in re.split("[ \t]+", piece) if w]


def expected(rows, threshold, top, cover=80):
    counts, sizes = Counter(), Counter()
    for lang, words in pieces(rows):
        sizes[lang] += len(words)
        for n in range(1, 5):
            counts.update((lang, tuple(words[i : i + n])) for i in range(len(words) - n + 1))
    found = {}
    for (lang, words), a in counts.items():
        if len(words) > 1 and a >= threshold:
            cuts = []
            for k in range(1, len(words)):
                left, right = counts[lang, words[:k]], counts[lang, words[k:]]
                cuts.append((2_000_000 * a // (left + right), k, left, right))
            found[lang, words] = (a, *min(cuts))
    out = []
    for lang in sizes:
        kept = []
        for (of, words), (a, score, _, left, right) in found.items():
            longer = [b[0] for (o, w), b in found.items() if o == of and len(w) > len(words) and any(w[i : i + len(words)] == words for i in range(len(w)))]
            if of == lang and not any(100 * b >= cover * a for b in longer):
                kept.append((-score, -a, " ".join(words).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, sizes[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("shards, block, bits", [(1, 1 << 20, 1 << 26), (3, 200, 1 << 15), (4, 5000, 8)])
def test_equals_counting_everything(spark, monkeypatch, shards, block, bits):
    monkeypatch.setattr(op11_phrases, "MAX_BITS", max(bits, 1 << 15))
    if bits == 8:  # bitmaps that take every phrase for a frequent one let all be counted
        monkeypatch.setattr(op11_phrases, "_bitmaps", everything)
    given = spark.createDataFrame(texts(), SCHEMA).selectExpr("*", "lang AS n", "text AS phrase", "1 AS total").repartition(4)
    got = op11_phrases.collocations(given, threshold=5, top=30, shards=shards, block=block)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == expected(texts(), 5, 30)


def everything(state, shard, since):
    known = state.where("n > 0").groupBy("n").agg(F.max(F.coalesce(F.col("reached") >= since, F.lit(False))).alias("recent"), F.max(F.col(shard).isNull()).alias("open"))
    out, recent = {}, []
    for row in known.collect():
        out[row["n"]] = [op11_phrases.Bits(1 << 15) for _ in range(3)]
        for kind, bits in enumerate(out[row["n"]]):
            bits.bytes[:] = 255
            bits.any = kind != op11_phrases.OPEN or row["open"]
        recent += [row["n"]] if row["recent"] else []
    return out, sorted(recent)


def test_a_phrase_is_counted_after_its_parts_are_frequent(spark):
    docs = spark.createDataFrame(texts(), SCHEMA).coalesce(1)
    rows = op11_phrases.count_phrases(docs, 5, shards=3).where("reached IS NOT NULL").collect()
    reached = {(r["lang"], tuple(r["phrase"].split(" "))): r["reached"] for r in rows}
    assert {len(w) for _, w in reached} == {1, 2, 3, 4}
    for (lang, words), at in reached.items():
        if len(words) > 1:
            assert at > max(reached[lang, words[:-1]], reached[lang, words[1:]])
    # lengths interleave: trigrams come up before all words have
    assert min(at for (_, w), at in reached.items() if len(w) == 3) <= max(at for (_, w), at in reached.items() if len(w) == 1)


def test_hash_is_sparks(spark):
    row = spark.createDataFrame([("de", "ein é zug")], "lang string, phrase string").select(op11_phrases._phrase_hash().alias("h")).first()
    import xxhash

    values = [np.array([xxhash.xxh64_intdigest(w.encode(), 42)], np.uint64) for w in ("de", "ein", "é", "zug")]
    now = np.array([42], np.uint64)
    for value in values:
        now = op11_phrases.hashed(value, now)
    assert int(now.view(np.int64)[0]) == row["h"]


def test_segments_cover_a_text_once():
    draw = random.Random(7)
    for _ in range(300):
        text = "".join(draw.choice(["a", "bc", " ", "\t", ".", "dddddddd", "  "]) for _ in range(draw.randrange(200))).encode()
        limit, parts = draw.choice([1, 3, 10, 40]), []
        for part, tail in op11_phrases.segments(text, limit, 3):
            parts.append(part[: len(part) - tail])
        assert b"".join(parts) == text


def test_exact_scores_beyond_64_bits(spark):
    row = spark.range(1).selectExpr("CAST(CAST(2000000 AS DECIMAL(10, 0)) * CAST(9000000000000000 AS DECIMAL(19, 0)) div CAST(18000000000000001 AS DECIMAL(19, 0)) AS BIGINT) AS s")
    assert row.first()["s"] == 2_000_000 * 9_000_000_000_000_000 // 18_000_000_000_000_001


def test_empty(spark):
    assert op11_phrases.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert op11_phrases.collocations(spark.createDataFrame([("en", "one two")], SCHEMA).withColumn("rank", F.lit(1))).count() == 0


def test_the_driver_keeps_the_bitmaps_of_one_scan(spark, monkeypatch):
    from pyspark.core.broadcast import Broadcast

    made, gone = [], []
    begin, end = Broadcast.__init__, Broadcast.destroy
    monkeypatch.setattr(Broadcast, "__init__", lambda self, *a, **b: begin(self, *a, **b) or made.append(len(made) - len(gone)))
    monkeypatch.setattr(Broadcast, "destroy", lambda self, *a: end(self, *a) or gone.append(1))
    docs = spark.createDataFrame([("en", "one two three four")] * 40, "lang string, text string")
    assert op11_phrases.count_phrases(docs, 30, 3, 2).where("n = 3").count() == 2
    assert len(made) == len(gone) > 1 and not any(made)


def test_a_block_gives_back_its_words_and_where_phrases_start():
    found, marks = op11_phrases.encode_block([(b"New york,  new\tYork city", 0), (b"a b c d", 4)])
    block = op11_phrases.Block("en", found, marks.tobytes())
    assert [block.words[c] for c in block.code] == b"new york new york city a b c d".split()
    assert block.begins.tolist() == [True] * 7 + [False] * 2  # the last four bytes belong to the next part
    assert block.room.tolist() == [2, 1, 3, 2, 1, 4, 3, 2, 1]
    assert op11_phrases.encode_block([(b" .\t", 0)]) is None


@pytest.mark.parametrize("size", [5, 1 << 40])
def test_distinct_rows_of_numbers(monkeypatch, size):
    draw = np.random.default_rng(3)
    columns = [draw.integers(0, 5, 400) for _ in range(3)]
    if size > 5:  # too many numbers for one key of 64 bits
        columns = [draw.integers(0, 1 << 21, 3_000_000) for _ in range(3)]
        columns = [np.concatenate([c, c[:1000]]) for c in columns]
    got, counts = op11_phrases.distinct(columns, 1 << 21)
    expected = Counter(zip(*(c.tolist() for c in columns)))
    assert dict(zip(zip(*(c.tolist() for c in got)), counts.tolist())) == expected


def test_a_scan_hands_on_hashes_and_few_phrases():
    """Phrases below their share are added up as hashes; only those that came up to it are counted as strings."""
    words = [f"w{i}" for i in range(300)]
    draw = random.Random(8)
    text = " ".join("new york" if draw.random() < 0.1 else draw.choice(words) for _ in range(4000)).encode()
    found, marks = op11_phrases.encode_block([(text, 0)])
    batch = op11_phrases.pa.RecordBatch.from_pydict({"lang": ["en"], "words": [found], "marks": [marks.tobytes()]})
    every = {1: [op11_phrases.Bits(1 << 15) for _ in range(3)]}
    for bits in every[1][:2]:
        bits.bytes[:], bits.any = 255, True

    class Shared:
        def __init__(self, value):
            self.value = value

    rows = [r for b in op11_phrases._tallying([2], Shared(every))(iter([batch])) for r in zip(*b.to_pydict().values())]
    often = op11_phrases.Bits(1 << 15)
    for h, now in rows:
        if now >= 30:
            often.any = True
            for half in (h & ((1 << 64) - 1), (h & ((1 << 64) - 1)) >> 32):
                place = half & ((1 << 15) - 1)
                often.bytes[place >> 3] |= 1 << (place & 7)
    counted = [r for b in op11_phrases._counting([2], Shared((every, often, [2])))(iter([batch])) for r in b.to_pylist()]
    assert len(rows) > 1000 and len(counted) < 30
    pairs = Counter(zip(text.split(), text.split()[1:]))
    assert {r["phrase"].encode(): r["now"] for r in counted}[b"new york"] == pairs[b"new", b"york"]
    assert sum(now for _, now in rows) == sum(pairs.values())


def test_hashes_are_summed_over_tasks_in_few_rows():
    draw = np.random.default_rng(4)
    parts = [draw.integers(-(1 << 63), 1 << 63, 5000) for _ in range(3)]
    common = draw.integers(-(1 << 63), 1 << 63, 50)
    given, rows = Counter(), []
    for i, part in enumerate(parts):
        found = Counter(part.tolist()) + Counter({int(h): 2 + i for h in common})
        given += found
        tally = sorted((h % (1 << 64), h, n) for h, n in found.items())  # in the order of the unsigned hashes
        batch = op11_phrases.pa.RecordBatch.from_pydict({"hash": [h for _, h, _ in tally], "now": [n for *_, n in tally]})
        for dealt in op11_phrases._dealing(lambda batches: batches, 7)(iter([batch])):
            assert len(dealt) == 7
            rows += dealt.to_pylist()
    got = []
    for group in range(7):
        some = op11_phrases.pa.Table.from_pylist([r for r in rows if r["dealt"] == group])
        got += op11_phrases._summing(9)(some).column("hash").to_pylist()
    assert sorted(got) == sorted(h for h, n in given.items() if n >= 9) == sorted(common.tolist())


def test_words_below_their_share_are_not_counted_as_strings(spark, monkeypatch):
    added, counting = [], op11_phrases._counting
    monkeypatch.setattr(op11_phrases, "_counting", lambda sought, shared: added.append((sought, shared.value[2])) or counting(sought, shared))
    docs = spark.createDataFrame([("en", f"one two rare{i}") for i in range(40)], SCHEMA)
    rows = {r["phrase"]: r["total"] for r in op11_phrases.count_phrases(docs, 30, 2, 2).where("n > 0").collect()}
    assert rows == {"one": 40, "two": 40, "one two": 40}
    assert [1 in many for sought, many in added if 1 in sought] == [True, True]


def test_words_are_hashed_once():
    found, marks = op11_phrases.encode_block([(b"New york new\tYork city", 0)])
    made = op11_phrases.hashes_of(found)
    assert (op11_phrases.Block("en", found, marks.tobytes(), made.tobytes()).own == op11_phrases.Block("en", found, marks.tobytes()).own).all()
    batch, *_ = op11_phrases._encoding(4, 1, 1 << 20)(iter([op11_phrases.pa.RecordBatch.from_pydict({"lang": ["en"], "text": ["New york"], "shard": [0]})]))
    assert batch.to_pylist()[0]["hashes"] == op11_phrases.hashes_of(b"new york").tobytes()
    assert batch.to_pylist()[0]["size"] == 2
