from __future__ import annotations

import random

import public_tokenizers
import pytest

from pyspark.sql import functions as F

from airlume.llm.bpe import _chunks, _pieces, boundaries, decode, encode, pieces, vocabulary

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _strings():
    draw = random.Random(4)
    parts = ["don't", "we'll", "'re", "'", " ", "  ", "\n\n", "\t", "\x1c", "\x85", "　", "word", "Straße", "日本語", "x" * 40, "12345", "...", "🙂", "é", "<|endoftext|>", " 's", "\r\n "]
    out = ["".join(draw.choices(parts, k=n)) for n in (0, 1, 5, 60, 300, 300, 900)]
    return [*out, " " * 500, "a" * 700, " \n" * 300 + "end", "日" * 400, ("it's " * 200)[:-1]]


def test_pieces_meet_at_boundaries_of_the_whole_text():
    encoding, split = vocabulary(PATH, PATTERN)
    for text in _strings():
        whole = set(boundaries(text, split)) | {len(text)}
        for chunk, overlap in ((40, 4), (41, 12), (100, 50)):
            step = chunk - overlap
            chunks = [(a, text[a : a + chunk]) for a in range(0, max(1, len(text) - overlap), step)]
            found = list(pieces(chunks, split))
            assert "".join(found) == text
            ids = [i for piece in found for i in encoding.encode_ordinary(piece)]
            assert ids == encoding.encode_ordinary(text)
            at = 0
            for piece in found:
                at += len(piece)
                assert at in whole


@pytest.mark.parametrize(("chunk", "overlap"), [(16_384, 512), (30, 5), (64, 40)])
def test_equals_the_library_and_comes_back(spark, texts, chunk, overlap):
    encoding, _ = vocabulary(PATH, PATTERN)
    rows = list(enumerate(_strings())) + [(50, None), (51, ""), (52, "twice " * 9), (52, "twice " * 9), (None, "no id " * 20)]
    rows.append((60, " ".join(_strings()) * 12))
    got = decode(encode(texts(rows), PATH, PATTERN, chunk, overlap), PATH).collect()
    want = sorted(((i, encoding.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows), key=str)
    assert sorted(((r.doc_id, r.ids, bytes(r.data)) for r in got), key=str) == want


def test_empty_table(spark, texts):
    assert decode(encode(texts([]), PATH, PATTERN), PATH).count() == 0


def test_one_long_text_is_split_and_encoded_over_many_tasks(spark, texts):
    encoding, _ = vocabulary(PATH, PATTERN)
    text = "".join(f"word{i % 977} it's {i}, " for i in range(200_000)) + "y" * 70_000 + " end"
    source = texts([(1, text)]).select("doc_id", "text")
    chunks = _chunks(source, 16_384, 512)
    assert chunks.groupBy(F.spark_partition_id()).count().count() > 4
    found = _pieces(chunks, PATH, PATTERN, 512)
    spans = sorted((r.begin, r.until) for r in found.select("begin", "until").collect())
    assert [a for a, _ in spans[1:]] == [b for _, b in spans[:-1]]
    assert (spans[0][0], spans[-1][1]) == (0, len(text))
    # Only the run of one letter, longer than four chunks, is held as one.
    assert len(spans) > 200 and sorted(b - a for a, b in spans)[-2] < 17_000
    assert encode(source, PATH, PATTERN).first().ids == encoding.encode_ordinary(text)
