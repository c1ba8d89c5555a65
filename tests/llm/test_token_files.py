"""Token files against the tokenizers library, and what a reader gets of them."""

import random
import zlib

import numpy as np
import pyarrow.dataset as ds
import pyarrow.parquet as pq
import pytest
import regex
from helpers import clashing, frame, messy, prose, row, wide_prose

from arbiter.llm import token_files as T
from arbiter.session import scratch_path

PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
ODD = ["don't we'll they've I'm he'd 'tis ''s 's'll're", " leading", "trailing  ", "\n\n a\n 'b\t\t'c", "x  y   z", "<|endoftext|> in <|endoftext|>text",
       "a b　　c   d", "½²³ Ⅷ ٣ 一二", "é ‍👩‍👩‍👧 \U0001F600\U0001F601x", "\x00\x1c\x1d \x85 \x0b'", "'", " '", "''", "'re", "'r", "x'l", "naïve façade", "İıſK", "  　'd"]


def texts(n, seed=3):
    r = random.Random(seed)
    bits = [" ", "  ", "\n", "'", "'s", "'re", "'l", "a", "Bc", "é", "1", "½", "　", " ", "!", "?!", "😀", "\t", "<|endoftext|>", "'ve ", "\x85", "ll"]
    return ["".join(r.choice(bits) for _ in range(r.randrange(0, 25))) for _ in range(n)]


@pytest.fixture(scope="module")
def enc():
    return T.Encoder(T.default_path())


def encode(enc, some):
    data = np.frombuffer("".join(some).encode(), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(t.encode()) for t in some])]).astype(np.int64)
    ids, counts = enc.encode(data, off)
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


def test_segments_are_the_patterns():
    classes = T._classes()
    for t in [*ODD, *texts(3000)]:
        data = np.frombuffer(t.encode(), np.uint8)
        starts = T.segment_starts(data, np.array([0, len(data)]), classes).tolist()
        assert [data[a:b].tobytes().decode() for a, b in zip(starts, [*starts[1:], len(data)])] == PATTERN.findall(t), t


def test_ids_are_the_librarys(enc):
    some = [*ODD, "", *texts(3000), prose(1, 5000), "", "z" * 3000, " " * 500, ""]
    assert encode(enc, some) == enc.whole(some)
    assert encode(enc, some[::-1]) == enc.whole(some[::-1])  # and from the table


def test_odd_characters_go_to_the_library(enc, monkeypatch):
    other = T.Encoder(T.default_path())
    monkeypatch.setattr(other, "classes", other.classes.copy())
    other.classes[ord("é")] = T.OTHER  # a table that differs from the library's
    some = ["né é", "plain text", "été", "x"]
    assert encode(other, some) == enc.whole(some) and other.odd[ord("é")] and not other.odd[ord("x")]


def test_long_texts_and_a_small_table(enc, monkeypatch):
    monkeypatch.setattr(T, "SLICE", 1000)
    monkeypatch.setattr(T, "CACHE", 50)
    other = T.Encoder(T.default_path())
    for t in (wide_prose(1, 3000), prose(2, 3000), "ab" * 4000, "a b" * 2000, "1 " * 3000 + "x y" + "é" * 900, "<|endoftext|>" * 300, wide_prose(5, 400) + "z" * 5000 + " q r"):
        assert encode(other, [t]) == enc.whole([t])
        assert len(other.cache) < 2000


def plain(rows, enc, end=0):
    out, at = [], 0
    for i, text in sorted(((r[0], r[1] or "") for r in rows), key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = [*enc.library.encode(text, add_special_tokens=False).ids, end]
        out.append((i, at, ids))
        at += len(ids)
    return out


def test_files(spark, enc):
    rows = [row(i * 7 % 1009 - 5, t) for i, t in enumerate([*ODD, *texts(300), *(prose(k, 200) for k in range(200)), None, wide_prose(3, 20_000)])]
    want = plain(rows, enc)
    path = scratch_path(spark, "tokens-test")
    T.write(frame(spark, rows).repartition(5), path, T.default_path(), files=2, row_group=64 << 10, page=8 << 10, page_rows=20, check_every=1)
    got = T.checksums(T.documents(spark, path)).collect()
    assert sorted(map(tuple, got)) == sorted((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, at, ids in want)
    assert sorted(map(tuple, T.metadata(spark, path).collect())) == sorted((i, at, len(ids)) for i, at, ids in want)
    # order of files and rows, encodings, row groups and page indexes
    local = path.removeprefix("file://")
    files = sorted(f for f in ds.dataset(f"{local}/tokens").files)
    ids = [x for f in files for x in pq.read_table(f)["doc_id"].to_pylist()]
    assert ids == sorted(ids) and len(files) == 2
    groups = 0
    for f in files:
        meta = pq.ParquetFile(f).metadata
        groups += meta.num_row_groups
        for c in range(meta.num_columns):
            col = meta.row_group(0).column(c)
            assert col.has_offset_index
            if col.path_in_schema.startswith("ids"):
                assert "RLE_DICTIONARY" in col.encodings
            elif col.path_in_schema in ("doc_id", "start", "n_tokens"):
                assert "DELTA_BINARY_PACKED" in col.encodings and col.has_column_index
    assert groups > len(files)
    plan = T.metadata(spark, path)._jdf.queryExecution().toString()
    assert "ids" not in plan.split("ReadSchema")[1].split("\n")[0]
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,10)" in T.documents(spark, path, 10, 20)._jdf.queryExecution().executedPlan().toString()
    some = {r.doc_id: r.ids for r in T.documents(spark, path, 10, 20).collect()}
    assert some == {i: ids for i, _, ids in want if 10 <= i <= 20}
    stream = [x for _, _, ids in want for x in ids]
    for first, end in ((0, 10), (5000, 5001), (1234, 30_000), (len(stream) - 5, len(stream) + 9), (7, 7)):
        cut = sorted(T.span(spark, path, first, end).collect(), key=lambda r: r.start)
        assert [x for r in cut for x in r.ids] == stream[first:end]
        assert all(stream[r.start:r.start + len(r.ids)] == r.ids for r in cut)


def test_odd_rows(spark, enc):
    rows = messy()
    path = scratch_path(spark, "tokens-test")
    T.write(clashing(spark, rows), path, T.default_path(), end=7, files=3)
    got = T.documents(spark, path).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, tuple(r.ids)) for r in got) == sorted((i is not None, i or 0, tuple(ids)) for i, _, ids in plain(rows, enc, 7))
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])])[:-1].tolist()
    T.write(frame(spark, []), path + "-empty", T.default_path())
    assert T.checksums(T.documents(spark, path + "-empty")).collect() == [] and T.span(spark, path + "-empty", 0, 9).collect() == []
    hot = [row(5, t) for t in ("x y", "a b c", "x y", None) * 30]  # one id of all rows
    T.write(frame(spark, hot), path + "-hot", T.default_path(), files=4)
    got = sorted(T.documents(spark, path + "-hot").collect(), key=lambda r: r.start)
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])])[:-1].tolist() and len(got) == 120
    assert spark.read.parquet(path + "-hot/parts").count() > 1
