"""Benchmark items in scripts that are written without spaces."""

from quarrymind.llm import tiling


def test_items_without_spaces_are_found():
    item = "水在标准大气压下的沸点是多少摄氏度"
    found = tiling.Index([item]).leaks("前面的文字" + item + "后面的文字", 0.6)
    assert [(k.item, k.covered, k.tiles) for k in found] == [(0, len(item), 1)]
    assert not tiling.Index([item]).leaks("完全不同的一段文字没有任何问题", 0.6)
    assert tiling.WORD.findall("plain words_1 ünï") == ["plain", "words_1", "ünï"]


def test_items_shorter_than_a_tile_are_found_whole():
    index = tiling.Index(["yes", "what is it", "one two three four five", "no no no", "", "..."])
    def found(text):
        return sorted((k.item, k.covered, k.tiles) for k in index.leaks(text, 0.6))

    assert found("well, YES") == [(0, 1, 1)]
    assert found("so what is it then") == [(1, 3, 1)] and found("what is that, it is") == []
    assert found("no no, no") == [(3, 3, 1)] and found("no no yes") == [(0, 1, 1)]
    assert found("one two three four") == [] and found("... one two three four five") == [(2, 5, 1)]
    assert found("") == found("...") == []
    assert not tiling.Index(["", "..."]).leaks("any text", 0.6) and not tiling.Index([]).leaks("any text", 0.6)
