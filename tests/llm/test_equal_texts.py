"""Texts that a polynomial hash takes for equal are told apart: letters in Thue-Morse order and their opposites."""

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from reelmark.llm import op2_pack, op8_jaccard, op10_counts, pretokens

DOCS = "doc_id long, text string"


def morse(letters: str, power: int = 10) -> str:
    return "".join(letters[bin(i).count("1") % 2] for i in range(1 << power))


def rows():
    words = [morse("ab"), morse("ba")]
    return [(i, text) for i, text in enumerate([*words, *(w + " and more words here now" for w in words), *(f"{w} {w}" for w in words)])]


def test_pack_gives_each_its_own_ids(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = {}
    for p in op2_pack.pack(spark.createDataFrame(rows(), DOCS).coalesce(1), path).collect():
        assert p["ids_crc32"] == zlib.crc32(p["ids"])
        got.setdefault(p["doc_id"], []).append((p["start"], np.frombuffer(p["ids"], "<u4").tolist()))
    for i, text in rows():
        ids = [x for _, part in sorted(got[i]) for x in part]
        assert ids == library.encode(text, add_special_tokens=False).ids + [0]


def test_counts_are_the_librarys(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = op10_counts.token_counts(spark.createDataFrame(rows(), DOCS).coalesce(1), path).collect()
    want = {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in rows()}
    assert {r["doc_id"]: r["n_tokens"] for r in got} == want


def test_different_texts_do_not_link(spark):
    got = op8_jaccard.jaccard_components(spark.createDataFrame(rows(), DOCS)).collect()
    assert {r["id"]: r["component_id"] for r in got} == {i: i for i, _ in rows()}


def test_distinct_spans():
    data = np.frombuffer("ab,ab é漢 é漢x".encode(), np.uint8)
    starts, ends = np.array([0, 2, 3, 6, 12, 17]), np.array([2, 3, 5, 11, 17, 18])
    which, spans = pretokens.distinct(data, starts, ends)
    assert [spans[i].as_py() for i in which.tolist()] == [data[a:b].tobytes() for a, b in zip(starts, ends)] and len(spans) == 4


def test_known_forgets(spark):
    calls = []
    known = pretokens.Known(lambda ts: calls.append(ts) or np.array([len(t) for t in ts]), limit=3)
    for text in ("a bb", "ccc a", "dddd eeeee"):
        whole, points, starts = pretokens.joined([text])
        begin, end = pretokens.word_spans(points, starts)
        assert known.of(whole, points, begin, end).tolist() == [len(t) for t in text.split(" ")]
    assert calls == [["a", "bb"], ["ccc"], ["dddd", "eeeee"]]


def test_signs_of_new_tokens_are_mapped_by_table():
    from reelmark.llm import op2_pack
    from reelmark.llm.op10_counts import byte_signs

    table = op2_pack.sign_points()
    assert len(table) == 256 and table[255] == 255  # the mark between tokens stays
    tokens = ["é漢", " \t\n", "\x00\x7f", "\U0001f600"]
    raw = "\udcff".join(tokens).encode("utf-8", "surrogateescape")
    signs = table[np.frombuffer(raw, np.uint8)].tobytes().decode("utf-32-le")
    assert signs.split("\xff") == [t.encode().decode("latin-1").translate(byte_signs()) for t in tokens]


def test_known_looks_each_token_up_once():
    class Counted(dict):
        looked = 0

        def get(self, key, default=None):
            Counted.looked += 1
            return super().get(key, default)

        def __contains__(self, key):
            Counted.looked += 1
            return super().__contains__(key)

        def __getitem__(self, key):
            Counted.looked += 1
            return super().__getitem__(key)

    known = pretokens.Known(lambda ts: np.array([len(t) for t in ts]))
    known.values = Counted()
    whole, points, doc_starts = pretokens.joined(["one two two three", "one four"])
    starts, ends = pretokens.byte_spans(points, doc_starts)
    got = known.of(whole, points, starts, ends)
    assert got.tolist() == (ends - starts).tolist()
    assert Counted.looked == len({whole[a:b] for a, b in zip(starts, ends)})
