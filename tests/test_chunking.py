import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumbra.functions import text as X
from lumbra.operators import chunking


def windows(text, size, overlap):
    """A plain loop over the text."""
    out, start = [], 0
    step = size - overlap if overlap < size else size
    while text:
        end = min(start + size, len(text))
        out.append((start, end, text[start:end]))
        if end == len(text):
            return out
        start += step
    return out


@pytest.mark.parametrize("size,overlap", [(4, 1), (4, 0), (3, 5), (5, 4), (7, 3)])
def test_fixed(spark, size, overlap):
    texts = ["", "a", "abcd", "abcde", "héllo wörld, ein längerer Text", "词典与快照" * 5, None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, content string")
    got = {}
    for r in chunking.fixed(df, size=size, overlap=overlap).orderBy("id", "chunk_index").collect():
        got.setdefault(r["id"], []).append((r["start_pos"], r["end_pos"], r["chunk"]))
    assert got == {i: windows(t, size, overlap) for i, t in enumerate(texts) if t}


def test_stream_and_buffered_tails(spark):
    df = spark.createDataFrame([(1, "abcdefg"), (2, "abc"), (3, "abcd")], "id int, content string")
    stream = [(r["id"], r["chunk"]) for r in chunking.stream(df, size=4, overlap=1).orderBy("id", "chunk_index").collect()]
    assert stream == [(1, "abcd"), (1, "defg"), (1, "g"), (2, "abc"), (3, "abcd"), (3, "d")]
    buffered = [(r["id"], r["chunk"]) for r in chunking.buffered(df, size=4, overlap=1).orderBy("id", "chunk_index").collect()]
    assert buffered == [(1, "abcd"), (1, "defg"), (1, "g"), (2, "abc"), (2, "c"), (3, "abcd"), (3, "d")]


def test_packers(spark):
    assert list(chunking._recursive("aaa\n\nbbb\n\ncc", 6, 2)) == [(0, "aaabbb"), (4, "bbcc")]
    assert list(chunking._recursive("short", 9, 2)) == [(0, "short")]
    assert list(chunking._semantic("One. Two.\n\n\n\n Three ", 12, 0)) == [(0, "One. Two."), (9, "Three")]
    assert [c for _, c in chunking._semantic("First one. Second one. Third.", 12, 0)] == ["First one.", "Second one.", "Third."]
    assert list(chunking._lines("ab\ncd\nef", 4, 0)) == [(0, "ab\ncd\n"), (6, "ef")]
    df = spark.createDataFrame([(1, "aaa\n\nbbb"), (2, None), (3, "")], "id int, content string")
    assert chunking.recursive(df, size=4, overlap=1).count() == 2
    with pytest.raises(ValueError):
        chunking.build("nope")


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab.! \n词。", max_size=80), st.integers(1, 20))
def test_deep_loses_nothing(text, size):
    pieces = list(chunking._deep(text, size))
    assert "".join(c for _, c in pieces) == text
    assert all(len(c) <= size for _, c in pieces)
    assert [s for s, _ in pieces] == [sum(len(c) for _, c in pieces[:i]) for i in range(len(pieces))]


def test_sentences(spark):
    df = spark.createDataFrame([("A b. C!  D\n 你好。end",)], "t string")
    assert df.select(X.sentences(df.t)).first()[0] == ["A b.", "C!", "D", "你好。", "end"]
