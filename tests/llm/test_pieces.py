import hashlib
import random

import pytest
from helpers import clashing, frame, messy, row

from arbiter.llm import pieces as P

v = P.MergeVocabulary(P.default_path())
LETTERS = "ab the ▁ \n\r\t  ñé日本\U0001F600'\"//**{};()12 .\x00<s></s>"


def test_agenda_matches_the_library():
    r = random.Random(3)
    texts = ["".join(r.choice(LETTERS) for _ in range(r.randint(0, 150))) for _ in range(1500)] + ["a" * 3000, "▁" * 70, "\n\n\n", " "]
    for t, (ids, decoded) in zip(texts, v.encode_all(texts)):
        v.compare(t, ids, decoded)
        assert v.decode([int(x) for x in ids.split()]) == decoded.decode()


def test_list_and_heap_agendas_agree():
    r = random.Random(4)
    segs = ["".join(r.choice("▁abcdethino ñ日") for _ in range(r.randint(1, P.SHORT))) for _ in range(800)]
    assert v.merge_many(segs) == [v.encode_segment(s) for s in segs]


def test_a_difference_is_reported():
    with pytest.raises(ValueError):
        v.compare("hello", "1 2", b"hello")


def test_documents(spark):
    got = P.encode_documents(clashing(spark, messy()), P.default_path(), check_every=1, with_ids=True).collect()
    want = []
    for r in messy():
        ids = [*v.library.encode(r[1] or ""), v.end]
        want.append((r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(v.library.decode(ids).encode()).hexdigest(), ids))
    assert sorted(map(str, want)) == sorted(str(tuple(g)) for g in got)
    assert P.encode_documents(frame(spark, []), P.default_path()).count() == 0


def test_bounded_cache(monkeypatch):
    monkeypatch.setattr(P, "CACHE", 20)
    small = P.MergeVocabulary(P.default_path())
    for k in range(30):
        t = " ".join(f"word{k}x{j}" for j in range(15))
        small.compare(t, *small.encode(t))
    assert len(small.cache) <= 40
