"""Quotes in a long text, over the borders of its pieces."""

import time

from inkmill.operators import anchors


def test_quotes_over_borders_of_a_long_text(spark):
    text = "".join(f"{k * 7919 % 100_003:05d} " for k in range(50_000))
    places = [anchors.PIECE * n - 20 for n in (1, 2, 700, 2300)]
    quotes = [(n, 0, text[p : p + 15] + "#" + text[p + 16 : p + 40]) for n, p in enumerate(places)]
    began = time.monotonic()
    got = anchors.anchor(spark.createDataFrame(quotes, "quote_id long, doc_id long, quote string"), spark.createDataFrame([(0, text)], "doc_id long, text string")).collect()
    assert sorted((r.quote_id, r.start, r.end, r.edits) for r in got) == [(n, p, p + 40, 1) for n, p in enumerate(places)]
    # By the square of the text's length it takes minutes.
    assert time.monotonic() - began < 60


def test_quotes_of_a_text_that_repeats_itself(spark):
    text = "the cat sat on the mat and saw a rat " * 8_000
    quote = text[50:57] + text[58:70] + "#" + text[71:91]
    began = time.monotonic()
    got = anchors.anchor(spark.createDataFrame([(0, 0, quote)], "quote_id long, doc_id long, quote string"), spark.createDataFrame([(0, text)], "doc_id long, text string")).collect()
    assert [tuple(r) for r in got] == [(0, 13, 54, 2)]
    # With rows for every q-gram that text and quote share, and every window compared, it takes minutes.
    assert time.monotonic() - began < 40


def test_quotes_over_borders_of_stretches_and_with_signs_of_patterns(spark):
    unit = "".join(f"{k * 7919 % 100_003:05d} " for k in range(2_000))
    signs = r"a\E|b(?=c)\Q.*[d]{2}$^ \\ 😀é x|y (z) +"
    text = unit[:1010] + signs + unit[1010:]
    quotes = [(0, 0, signs[:9] + signs[10:]), (1, 0, text[2030:2050] + "#" + text[2051:2070]), (2, 0, text[:30]), (3, 0, text[-30:])]
    got = anchors.anchor(spark.createDataFrame(quotes, "quote_id long, doc_id long, quote string"), spark.createDataFrame([(0, text)], "doc_id long, text string")).collect()
    n = len(signs)
    assert sorted(map(tuple, got)) == [(0, 1010, 1010 + n, 1), (1, 2030, 2070, 1), (2, 0, 30, 0), (3, len(text) - 30, len(text), 0)]
