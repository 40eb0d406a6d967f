"""Passages just long enough to be promised: each is found in all its places, and the lot but for its borders is removed."""

import random

from cloudloom.llm import chunk_dedup

from .helpers import documents


def _prose(rnd, n, long=9):
    return " ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(2, long))) for _ in range(n))


def test_passages_of_51_words_are_found(spark):
    rnd = random.Random(11)
    passages = [_prose(rnd, 51, rnd.choice([7, 8, 9])) for _ in range(500)]
    assert min(map(len, passages)) < 245 and min(map(len, passages)) >= chunk_dedup.LEAST_RUN + 2 * chunk_dedup.WINDOW + 17
    rows = [(2 * i + k, f"{_prose(rnd, rnd.randrange(3, 40))} {p} {_prose(rnd, rnd.randrange(3, 40))}", "s") for i, p in enumerate(passages) for k in range(2)]
    got = {r.doc_id: r for r in chunk_dedup.substring_dedup(documents(spark, rows)).collect()}
    for i, p in enumerate(passages):
        least = len(p) - 2 * chunk_dedup.WINDOW - 17
        assert got[2 * i].repeated_bytes >= least and got[2 * i].removed_bytes == 0, i
        assert got[2 * i + 1].removed_bytes >= least and 2 * i in got[2 * i + 1].owner_ids, i


def test_runs_are_measured_before_ownership_cuts_them(spark):
    rnd = random.Random(12)
    passages = [_prose(rnd, 51) for _ in range(150)]
    # The first document has a piece of the passage, and so owns chunks within the run of the second.
    rows = [(3 * i + k, f"{_prose(rnd, 20)} {p[90:210] if k == 0 else p} {_prose(rnd, 20)}", "s") for i, p in enumerate(passages) for k in range(3)]
    got = {r.doc_id: r for r in chunk_dedup.substring_dedup(documents(spark, rows)).collect()}
    parts = chunk_dedup.repeated_spans(documents(spark, rows)).filter("doc_id % 3 = 1 AND end - start < 80").count()
    assert parts > 100
    for i, p in enumerate(passages):
        for k in (1, 2):
            assert got[3 * i + k].repeated_bytes >= len(p) - 2 * chunk_dedup.WINDOW - 17, (i, k)
        assert got[3 * i + 2].removed_bytes >= len(p) - 2 * chunk_dedup.WINDOW - 17, i
