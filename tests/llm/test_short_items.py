"""Short benchmark items, and items in scripts without spaces."""

import pytest

from larkspur.llm import decontamination


def test_short_items_are_found_exactly(spark):
    bench = spark.createDataFrame([(1, "Paris, France"), (2, "forty two"), (3, "42"), (4, "a b c d e f"), (5, "paris france"), (6, "..."), (7, "not there at all")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "in Paris: France, paris france"), (2, "forty"), (3, "two"), (4, "x a b c d e f 42"), (5, "forty-two 421"), (6, ""), (7, "not there at")], "doc_id long, text string").coalesce(1)
    want = [(1, 1, 1, 3, 0), (1, 5, 1, 3, 0), (4, 3, 7, 8, 0), (4, 4, 1, 7, 0), (5, 2, 0, 2, 0)]
    found = decontamination.find(docs, bench)
    assert sorted((r["doc_id"], r["item_id"], r["start_word"], r["end_word"], r["distance"]) for r in found.collect()) == want
    assert {r["doc_id"] for r in decontamination.remove(docs, bench).collect()} == {2, 3, 6, 7}
    only = decontamination.find(docs, bench.where("item_id in (2, 3)"))
    assert sorted((r["doc_id"], r["item_id"]) for r in only.collect()) == [(4, 3), (5, 2)]


@pytest.mark.parametrize(("item", "text", "edits"), [
    ("今天天气很好我们去公园散步吧", "他说今天天气很好我们去公园散步吧然后", 0),
    ("今天天气很好我们去公园散步吧", "他说今天天氣很好我们去公园散步吧然后", 1),
    ("東京タワーの高さは何メートルですか", "問題：東京タワーの高さは何メートルですか。答え", 0),
    ("东京", "我去东京了", 0),
])
def test_letters_of_unspaced_scripts_are_words(item, text, edits):
    items = decontamination.Items([1], [item], decontamination.Settings())
    assert [x[4] for x in items.search(["nothing", text])] == [edits] and not items.search([text[::-1]])


def test_other_scripts_are_cut_as_before():
    assert decontamination.WORD.findall("Ünïcode_9 и слова 한국어 단어 don't x2中文ab") == ["Ünïcode_9", "и", "слова", "한국어", "단어", "don", "t", "x2", "中", "文", "ab"]
