"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text is normalised as the vocabularies of this kind ask (identity; spaces become U+2581, one is put in
front) and cut into segments that no piece crosses: before a run of U+2581 that follows another
character, and around line feeds.  Both cuts are verified against the vocabulary when it is loaded; where a
piece crosses one, it is not used.  Each distinct segment is encoded by a score-ordered agenda of adjacent
symbol pairs: the best-scored pair whose union is a piece is merged (ties: leftmost), its neighbours' pairs
enter the agenda, until none is left.  Characters without a piece become byte pieces.  The new segments
of a slice that have at most ``SHORT`` symbols keep their agendas as rows of one matrix, and each step merges
the best pair of every row; longer segments have a heap, so a text without spaces costs n log n.
Workers keep the encodings of at most ``CACHE`` segments.

``encode_documents`` compares every ``check_every``-th row (by a hash of its text) of an Arrow batch with the
sentencepiece library, ids and decoded text, and raises on any difference.

Nulls and odd input: a null text is empty; an empty text has the end id alone and decodes to an empty text;
repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbiter.llm.registry import query
from arbiter.llm.tables import by_slices, load

SHORT, CACHE, SLICE = 32, 400_000, 4 << 20
SPACE = "▁"
NONE = 2**31 - 1


class MergeVocabulary:
    """Pieces, their ranks by score, and the agenda."""

    def __init__(self, path: str):
        import sentencepiece
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        p, n = self.library, self.library.get_piece_size()
        normal = [i for i in range(n) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
        self.ids = {p.id_to_piece(i): i for i in normal}
        levels = {s: k for k, s in enumerate(sorted({p.get_score(i) for i in normal}, reverse=True))}
        self.rank = {x: levels[p.get_score(i)] for x, i in self.ids.items()}
        self.bytes_id = {int(p.id_to_piece(i)[1:-1], 16): i for i in range(n) if p.is_byte(i)}
        self.surface = {i: x.replace(SPACE, " ").encode() for x, i in self.ids.items()}
        self.surface |= {i: bytes([b]) for b, i in self.bytes_id.items()}
        self.surface |= {p.unk_id(): " ⁇ ".encode()}
        self.unk, self.end = p.unk_id(), p.eos_id()
        crossed = any(re.search(f"[^{SPACE}]{SPACE}", x) for x in self.ids)
        lines = any("\n" in x and len(x) > 1 for x in self.ids)
        stop = "" if lines else "\n"
        if crossed:
            self.segments = re.compile(f"[^{stop}]+|\n" if stop else r"(?s).+")
        else:
            self.segments = re.compile(f"{SPACE}*[^{SPACE}{stop}]+|{SPACE}+" + ("|\n" if stop else ""))
        self.cache: dict[str, tuple[str, bytes]] = {}
        self.digits = [str(i) for i in range(n)]
        self._pairs()

    def _pairs(self) -> None:
        """Symbols (pieces and the characters of pieces) as numbers, and the pairs whose union is a piece."""
        symbols = list(self.ids) + sorted({c for x in self.ids for c in x} - set(self.ids))
        self.number = {x: k for k, x in enumerate(symbols)}
        self.piece_of = np.array([self.ids.get(x, -1) for x in symbols] + [-1], np.int64)
        found = sorted((self.number[x[:k]] * len(symbols) + self.number[x[k:]], self.rank[x], self.number[x])
                       for x in self.ids for k in range(1, len(x)) if x[:k] in self.number and x[k:] in self.number)
        self.pair = np.array([f[0] for f in found] or [-1], np.int64)
        self.pair_rank = np.array([f[1] for f in found] or [NONE], np.int32)
        self.pair_union = np.array([f[2] for f in found] or [0], np.int64)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = np.where((a < 0) | (b < 0), -2, a * (len(self.piece_of) - 1) + b)
        i = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        ok = self.pair[i] == key
        return np.where(ok, self.pair_rank[i], NONE), self.pair_union[i]

    def merge_many(self, segs: list[str]) -> list[list[int]]:
        """Ids of segments of at most ``SHORT`` symbols: one agenda a row, one merge a row and step."""
        order = sorted(range(len(segs)), key=lambda k: len(segs[k]))
        out: list[list[int]] = [[]] * len(segs)
        for a in range(0, len(order), 8192):
            part = order[a:a + 8192]
            for k, ids in zip(part, self._merge_rows([segs[k] for k in part])):
                out[k] = ids
        return out

    def _merge_rows(self, segs: list[str]) -> list[list[int]]:
        n, size = len(segs), np.array([len(s) for s in segs])
        width = int(size.max())
        number = self.number
        flat = np.array([number.get(c, -1) for s in segs for c in s], np.int64)
        inside = np.arange(width) < size[:, None]
        sym = np.full((n, width + 1), -2, np.int64)
        sym[:, :width][inside] = flat
        agenda, union = self._ranks(sym[:, :-1].ravel(), sym[:, 1:].ravel())
        agenda, union = agenda.reshape(n, width), union.reshape(n, width)
        right = np.tile(np.arange(1, width + 2), (n, 1))
        left = np.tile(np.arange(-1, width), (n, 1))
        alive = np.zeros((n, width + 1), bool)
        alive[:, :width] = inside
        live = np.arange(n)
        while len(live):
            i = agenda[live].argmin(1)
            go = agenda[live, i] < NONE
            live, i = live[go], i[go]
            if not len(live):
                break
            j = right[live, i]
            sym[live, i] = union[live, i]
            alive[live, j] = False
            agenda[live, np.minimum(j, width - 1)] = NONE
            k = right[live, j]
            right[live, i] = k
            left[live, np.minimum(k, width)] = np.where(k <= width, i, left[live, np.minimum(k, width)])
            agenda[live, i], union[live, i] = self._ranks(sym[live, i], np.where(k <= width, sym[live, np.minimum(k, width)], -2))
            h = left[live, i]
            r = live[h >= 0]
            h, i2 = h[h >= 0], i[left[live, i] >= 0]
            agenda[r, h], union[r, h] = self._ranks(sym[r, h], sym[r, i2])
        ids = np.where(sym[:, :width] >= 0, self.piece_of[np.maximum(sym[:, :width], 0)], -1)
        got = []
        keep = alive[:, :width]
        flat_ids, cut = ids[keep].tolist(), np.concatenate([[0], np.cumsum(keep.sum(1))]).tolist()
        plain = ~((ids < 0) & keep).any(1)
        for r, s in enumerate(segs):
            if plain[r]:
                got.append(flat_ids[cut[r]:cut[r + 1]])
            else:  # some characters have no piece
                at = np.append(np.flatnonzero(keep[r]), len(s)).tolist()
                got.append([x for a, b in zip(at, at[1:]) for x in self._piece_ids(s[a:b])])
        return got

    def _piece_ids(self, x: str) -> list[int]:
        i = self.ids.get(x)
        if i is not None:
            return [i]
        return [self.bytes_id[b] for b in x.encode()] if self.bytes_id else [self.unk]

    def merge(self, seg: str) -> list[str]:
        """The symbols that are left when no adjacent pair can be merged."""
        return self._merge_heap(seg)

    def _merge_heap(self, seg: str) -> list[str]:
        parts: list[str | None] = list(seg)
        n, rank = len(parts), self.rank.get
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank(parts[i] + parts[i + 1], NONE)) < NONE]
        heapq.heapify(agenda)
        while agenda:
            _, i, a, b = heapq.heappop(agenda)
            j = right[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue  # one of the two has been merged since
            parts[i], parts[j] = a + b, None
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if (r := rank(parts[i] + parts[k], NONE)) < NONE:
                    heapq.heappush(agenda, (r, i, parts[i], parts[k]))
            if (h := left[i]) >= 0 and (r := rank(parts[h] + parts[i], NONE)) < NONE:
                heapq.heappush(agenda, (r, h, parts[h], parts[i]))
        return [x for x in parts if x is not None]

    def encode_segment(self, seg: str) -> list[int]:
        return [i for x in self.merge(seg) for i in self._piece_ids(x)]

    def encode(self, text: str) -> tuple[str, bytes]:
        """Decimal ids joined by spaces, with the end id, and the decoded text of those ids."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str], keep: int | None = None) -> list[tuple[str, bytes]]:
        segs = [self.segments.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        cache = self.cache
        new = list(dict.fromkeys(s for d in segs for s in d if s not in cache))
        if len(cache) + len(new) > (CACHE if keep is None else keep):
            cache.clear()
            new = list(dict.fromkeys(s for d in segs for s in d))
        short = [s for s in new if len(s) <= SHORT]
        long = [s for s in new if len(s) > SHORT]
        digits, surface = self.digits, self.surface
        got = {}
        for some, all_ids in ((short, self.merge_many(short)), (long, map(self.encode_segment, long))):
            for s, ids in zip(some, all_ids):
                got[s] = " ".join([digits[i] for i in ids]), b"".join([surface[i] for i in ids])
        cache.update((s, got[s]) for s in short)
        for s in long:
            cache[s] = got[s]
        out = []
        for d in segs:
            parts = [cache[s] for s in d]
            decoded = b"".join([p[1] for p in parts])
            out.append((" ".join([*[p[0] for p in parts], digits[self.end]]), decoded[1:] if decoded[:1] == b" " else decoded))
        for s in long:  # long segments are too large to keep
            del cache[s]
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of any ids: U+2581 becomes a space, the one in front goes, byte pieces are put together."""
        raw = b"".join([self.surface.get(i, b"") for i in ids])
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")

    def compare(self, text: str, ids: str, decoded: bytes) -> None:
        """Raise unless the library agrees."""
        want = [*self.library.encode(text), self.end]
        if " ".join(map(str, want)) != ids or self.library.decode(want).encode() != decoded:
            raise ValueError(f"encoding differs from the sentencepiece library in a text of {len(text)} characters")


_loaded: dict[str, MergeVocabulary] = {}


def vocabulary(path: str) -> MergeVocabulary:
    if path not in _loaded:
        _loaded[path] = MergeVocabulary(path)
    return _loaded[path]


def encode_documents(docs: DataFrame, path: str, check_every: int = 64, with_ids: bool = False,
                     keep: int | None = None, slice_bytes: int = SLICE) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row, and the ids themselves on demand.

    ``keep`` (``CACHE`` if None) bounds the segments a worker remembers, ``slice_bytes`` the text it encodes at once.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        v = vocabulary(path)
        n, sha, back, arrays = [], [], [], []
        texts = b.column(1).to_pylist()
        for text, (ids, decoded) in zip(texts, v.encode_all(texts, keep)):
            if check_every and zlib.crc32(decoded) % check_every == 0:
                v.compare(text, ids, decoded)
            n.append(ids.count(" ") + 1)
            sha.append(hashlib.sha256(ids.encode()).hexdigest())
            back.append(hashlib.sha256(decoded).hexdigest())
            if with_ids:
                arrays.append(np.fromstring(ids, np.int32, sep=" "))
        cols = [b.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if with_ids:
            flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int32)
            cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(flat)))
            names.append("ids")
        return pa.record_batch(cols, names=names)

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return by_slices(src, "text", run, schema, slice_bytes)


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


@query("op3_sentencepiece")
def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` with the 32,000-piece vocabulary."""
    return encode_documents(load(spark, sf_dir, "documents"), default_path())
