"""Very long texts and words, clashing columns and hot ids in the operators on single texts and in sharding."""

import re
from zlib import crc32

import public_tokenizers
import sentencepiece

from larkspur.llm import line_dedup, memory, sentencepiece_codec, sharding, token_counts

PIECES = public_tokenizers.path("piece_bpe_32k.model")
LONG = "some words of a long text\n" * 60_000
WORD = "ab" * 150_000


def test_pieces(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = spark.createDataFrame([(1, LONG, "x"), (2, "x" + "y" * 30_000, "x"), (3, None, "x")], "doc_id long, text string, decoded string")
    for r in sentencepiece_codec.encode_decode(docs, PIECES).collect():
        text = {1: LONG, 2: "x" + "y" * 30_000, 3: ""}[r["doc_id"]]
        want = library.encode(text, add_eos=True)
        assert (r["ids"], r["decoded"]) == (want, library.decode(want))


def test_counts_of_long_words_equal_those_of_steps(monkeypatch):
    """Words over the bound are walked letter by letter; the counts are those of the steps over many words at once."""
    with open(PIECES, "rb") as f:
        automaton = token_counts.Automaton(*token_counts.pieces(sentencepiece_codec.PieceModel(f.read())))
    words = ["a", WORD[:2500], "one" * 700, "é" * 1500, "日本" * 900, "x|" * 600, "short", "the" * 1200]
    by_letter = automaton.count(words).tolist()
    monkeypatch.setattr(token_counts, "LONG_WORD", 10**9)
    assert by_letter == automaton.count(words).tolist() and by_letter[1] > 0


def test_counts(spark):
    docs = spark.createDataFrame([(1, LONG, 7), (2, WORD, 7), (3, "", 7)], "doc_id long, text string, n_words long")
    rows = {r["doc_id"]: r for r in token_counts.count_tokens(docs, PIECES).collect()}
    assert rows[1]["n_words"] == 360_000 and rows[2]["n_words"] == 1 and rows[3]["n_tokens"] == 0
    assert rows[2]["n_tokens"] > 10_000 and rows[2]["n_unknown"] == 0


def test_remembered_letters_are_bounded(monkeypatch):
    monkeypatch.setattr(memory, "MOST_LETTERS", 1000)
    own = token_counts.Counter(token_counts.counter(PIECES).automaton)
    with open(PIECES, "rb") as f:
        codec = sentencepiece_codec.Encoder(sentencepiece_codec.PieceModel(f.read()))
    for k in range(40):
        text = f"{k}" + "w" * 300
        own.count([text])
        codec.encode([text])
        assert own.letters <= 1000 + len(text) and codec.letters <= 1000 + len(text) + 1


def test_lines(spark):
    docs = spark.createDataFrame([(1, LONG, "x"), (2, LONG + "its own", "x"), (3, WORD, "x"), (4, WORD.upper(), "x")], "doc_id long, text string, n_lines string")
    rows = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in line_dedup.dedup_lines(docs).collect()}
    assert rows[1] == (LONG, 60_001, 0) and rows[2] == ("its own", 60_001, 60_000) and rows[3] == (WORD, 1, 0) and rows[4] == ("", 1, 1)


def test_shards_of_long_texts_and_a_hot_id(spark):
    """One id has most rows, each with a text of its own; the places are those of the sorted rows all the same."""
    rows = [(5, f"text {k}") for k in range(3000)] + [(5, "again")] * 200 + [(k, f"t{k}") for k in range(300)] + [(7, LONG)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, slot long")
    order = sorted((d, crc32(t.encode()), len(t.encode()) + 8) for d, t in rows)
    feistel = sharding.Feistel(len(rows), 1729)
    want = sorted((d, size, crc, *feistel.place(k, 24)) for k, (d, crc, size) in enumerate(order))
    found = sharding.shard(docs.repartition(4)).select("doc_id", "size", "text_crc32", "shard", "slot").collect()
    assert sorted(map(tuple, found)) == want


def test_the_pattern_of_words():
    assert re.findall(token_counts.WORD, "a\x0bb c\x85d") == ["a", "b c\x85d"]
