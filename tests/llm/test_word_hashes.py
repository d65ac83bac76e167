"""Long words that a polynomial hash modulo 2**64 can't tell apart, whatever its base: they stay different."""

import numpy as np
import pytest

from petrograph.llm import common, neardup, phrases, quality


def pair(n):
    """The two Thue-Morse words of n letters (n a power of two)."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [2 ** k for k in range(6, 14)])
def test_words_have_hashes_of_their_own(n):
    text = "x " + " ".join(pair(n)) + " " + " ".join(pair(n))
    ids = common.word_ids(common.text_bytes(text))
    assert ids[1] != ids[2] and ids[1] == ids[3] and ids[2] == ids[4] and len(np.unique(ids)) == 3


def test_operators_tell_them_apart(spark):
    one, two = pair(2048)
    words = " ".join(f"w{i}" for i in range(49))
    docs = spark.createDataFrame([(1, one), (2, two), (3, f"{words} {one}"), (4, f"{words} {two}")], "doc_id bigint, text string")
    linked = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs.filter("doc_id < 3")).collect()}
    assert linked == {1: 1, 2: 2}
    assert {r.doc_id: r.n_removed for r in phrases.without_repeats(docs).collect()} == {1: 0, 2: 0, 3: 0, 4: 0}
    twice = [" ".join([*(f"v{i}" for i in range(7)), word] * 2) for word in (one, two)]
    mixed = twice[0][:len(twice[0]) // 2] + " " + twice[1][:len(twice[1]) // 2]
    rows = spark.createDataFrame([(1, twice[0]), (2, mixed.replace("  ", " "))], "doc_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r.doc_id: r.n_repeat_words for r in quality.quality_table(rows, labels).collect()} == {1: 16, 2: 0}
