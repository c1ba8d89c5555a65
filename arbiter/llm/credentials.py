"""Secret scan: fixed patterns, and probabilistic automata inferred from labelled credentials.

Base patterns (leftmost non-overlapping matches per kind, failing ones dropped; letters are ASCII):
  assign  ``(password|passwd|secret|token|api_?key)["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)``, the words in
          either case, group 2 of 8 or more characters; the span is the whole match
  access  ``AKIA[A-Z0-9]+`` of 16 or more characters
  hex     ``[0-9a-f]+`` of 32 or more characters

Grammar inference: the credentials that the base patterns label are written over the smallest of six alphabets that
holds their letters and digits (decimal, lower and upper hexadecimal, lower- and upper-case alphanumeric, all
alphanumeric; other characters stand for themselves) and are put into one prefix tree a kind and alphabet.
States are merged by state merging with evidence (ALERGIA): two states are compatible if the relative
frequencies of ending and of every next symbol, and those of all their successors, differ by no more than the
Hoeffding bound at ``alpha``.  The result is a probabilistic deterministic automaton.  A state whose characters differ
from those of the whole automaton by the bound has its own frequencies, so a constant prefix is learnt.  Lengths are told by the ending
probabilities alone.

The trees are fitted on a bounded sample: distinct values are grouped by shape (their symbols with run lengths), and
the values of all shapes of a kind and alphabet enter in turns, up to ``PER_SHAPE`` of a shape, ``PER_TREE`` in all
and ``MAX_SYMBOLS`` symbols, so that a rare format stands beside a frequent one.  Fewer than ``MIN_VALUES`` values
can't tell any two states apart by the bound, so they give no automaton.

Scoring: candidates are maximal runs of ``[A-Za-z0-9+/_.=-]``, and what follows the last name separator ``=`` of such a
run, without outer punctuation, of ``MIN_LENGTH`` or more characters, that hold a digit and a letter and don't overlap a
base span.  A candidate's likelihood is that of its characters and its end under the automaton of its alphabet (a
character that no example has there fails at ``FLOOR``, as do all after it).  It becomes a span of kind ``format``
if, for some kind, the mean log likelihood is at least the ``QUANTILE`` of the examples' own means (less the number of
free parameters a character, by which examples fit better than new text does) and the likelihood exceeds that under the background, the frequencies of characters in the runs of the whole corpus.

Two passes: the first gathers labelled values (a few bytes a document, pre-selected a slice) and the background (a row a
character and task), the second has the automata in a broadcast.  A vectorised scan of the bytes finds the texts that hold a long run or a key word; only
those are searched by patterns.

Nulls and odd input: a null text is empty and has no spans; without any labelled value there are no automata
and no ``format`` spans; repeated rows are each reported; extra columns have no influence; a text of any length is
searched whole, and a value of any length is scored.  Values that tie in the sample's order are ordered by themselves.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arbiter.llm import words as W
from arbiter.llm.registry import query
from arbiter.llm.tables import by_slices, load, materialize, small_batches
from arbiter.operators.ordered import top_k

KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HEX_LONG = re.compile(r"[0-9a-f]{32,}")  # the same matches: a run is taken whole
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{8,}")
MIN_LENGTH, ALPHA, FLOOR, QUANTILE = 8, 0.05, 1e-4, 0.02
PER_SHAPE, PER_TREE, MAX_SYMBOLS, MIN_VALUES = 200, 1000, 20_000, 8
_RUN = np.zeros(256, bool)
_RUN[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
PUNCTUATION = "+/_.=-"
#: Symbol of a character by its class, and how many characters each class has.
CLASS_OF = {c: name for name, chars in (("d", "0123456789"), ("h", "abcdef"), ("l", "ghijklmnopqrstuvwxyz"), ("H", "ABCDEF"),
                                        ("U", "GHIJKLMNOPQRSTUVWXYZ")) for c in chars} | {c: c for c in PUNCTUATION}
CLASS_SIZE = Counter(CLASS_OF.values())
#: Alphabets from narrow to wide, and the symbols of characters in each.
ALPHABETS = {"decimal": "d", "hex": "dh", "HEX": "dH", "lower": "dhl", "upper": "dHU", "alphanumeric": "dhlHU"}
SYMBOLS = {name: {c: c if c in PUNCTUATION else "x" for c, x in CLASS_OF.items() if x in classes or c in PUNCTUATION}
           for name, classes in ALPHABETS.items()}


def alphabet_of(value: str) -> str:
    """The narrowest alphabet that holds all of a run's letters and digits."""
    classes = {CLASS_OF[c] for c in value} - set(PUNCTUATION)
    return next(name for name, held in ALPHABETS.items() if classes <= set(held))


def shape_of(value: str) -> str:
    """Symbols of a value in its alphabet, each with the length of its run."""
    of = SYMBOLS[alphabet_of(value)]
    return " ".join(f"{x}{sum(1 for _ in run)}" for x, run in itertools.groupby(of[c] for c in value))


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, kind number, value) of the base patterns, in order."""
    out = [(m.start(), m.end(), 0, m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), m.end(), 1, m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), 2, m[0]) for m in HEX_LONG.finditer(text)]
    return sorted(out)


@dataclass
class Automaton:
    """Transition and ending counts of a probabilistic deterministic automaton; state 0 starts."""

    next: list[dict[str, int]] = field(default_factory=lambda: [{}])
    count: list[dict[str, int]] = field(default_factory=lambda: [defaultdict(int)])
    ends: list[int] = field(default_factory=lambda: [0])
    of: dict[str, str] = field(default_factory=lambda: CLASS_OF)
    emit: list[dict[str, float]] = field(default_factory=list)
    cut: float = 0.0

    def add(self, symbols: list[str]) -> None:
        s = 0
        for x in symbols:
            if x not in self.next[s]:
                self.next[s][x] = len(self.next)
                self.next.append({})
                self.count.append(defaultdict(int))
                self.ends.append(0)
            self.count[s][x] += 1
            s = self.next[s][x]
        self.ends[s] += 1

    def total(self, s: int) -> int:
        return self.ends[s] + sum(self.count[s].values())

    def learn_characters(self, examples: list[str]) -> None:
        """Probabilities of characters within their symbol, smoothed by one, and the cut.

        A state has its own where a character's frequency there differs from that in the whole automaton by the bound.
        """
        size, seen = Counter(self.of.values()), [Counter() for _ in self.next]
        for e in examples:
            s = 0
            for c in e:
                seen[s][c] += 1
                s = self.next[s][self.of[c]]
        every = sum(seen, Counter())
        total = Counter()
        for c, n in every.items():
            total[self.of[c]] += n
        whole = {c: (every[c] + 1) / (total[x] + size[x]) for c, x in self.of.items()}
        self.emit = [whole if not any(_differ(total[x], every[c], self.count[s].get(x, 0), seen[s][c], ALPHA / size[x]) for c, x in self.of.items())
                     else {c: (seen[s][c] + 1) / (self.count[s].get(x, 0) + size[x]) for c, x in self.of.items()} for s in range(len(self.next))]
        used = {id(e): e for e in self.emit}.values()
        free = (sum(max(0, sum(1 for c in e if every[c]) - 1) for e in used)
                + sum(max(0, len(n) + (end > 0) - 1) for n, end in zip(self.count, self.ends)))
        self.cut = float(np.quantile([self.mean_log(e) for e in examples], QUANTILE)) - free / (sum(map(len, examples)) + len(examples))

    def log(self, text: str) -> float:
        """Log probability of the characters and the end."""
        s, total = 0, 0.0
        for i, c in enumerate(text):
            x = self.of.get(c)
            n = self.count[s].get(x, 0)
            if not n:
                return total + (len(text) - i + 1) * math.log(FLOOR)
            total += math.log(n / self.total(s) * self.emit[s][c])
            s = self.next[s][x]
        return total + (math.log(self.ends[s] / self.total(s)) if self.ends[s] else math.log(FLOOR))

    def mean_log(self, text: str) -> float:
        return self.log(text) / (len(text) + 1)

    def accepts(self, text: str) -> bool:
        return self.mean_log(text) >= self.cut


@dataclass
class Grammar:
    """The automata of a kind by alphabet, and log probabilities of characters outside credentials."""

    parts: dict[str, Automaton]
    background: dict[str, float] = field(default_factory=dict)

    def accepts(self, text: str) -> bool:
        if not all(c in CLASS_OF for c in text):
            return False
        part = self.parts.get(alphabet_of(text))
        return part is not None and part.accepts(text) and (
            not self.background or part.log(text) > sum(self.background[c] for c in text))


def _differ(n1: int, f1: int, n2: int, f2: int, alpha: float) -> bool:
    if not n1 or not n2:
        return False
    return abs(f1 / n1 - f2 / n2) > math.sqrt(0.5 * math.log(2 / alpha)) * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))


def compatible(a: Automaton, s: int, t: int, alpha: float) -> bool:
    """Whether the futures of two states pass the Hoeffding test, successors included."""
    todo = [(s, t)]
    seen = set()
    while todo:
        s, t = todo.pop()
        if s == t or (s, t) in seen:
            continue
        seen.add((s, t))
        n, m = a.total(s), a.total(t)
        if _differ(n, a.ends[s], m, a.ends[t], alpha):
            return False
        for x in a.count[s].keys() | a.count[t].keys():
            if _differ(n, a.count[s].get(x, 0), m, a.count[t].get(x, 0), alpha):
                return False
            if x in a.next[s] and x in a.next[t]:
                todo.append((a.next[s][x], a.next[t][x]))
    return True


def _fold(a: Automaton, s: int, t: int) -> None:
    """Add the subtree at ``t`` to state ``s``."""
    todo = [(s, t)]
    while todo:
        s, t = todo.pop()
        a.ends[s] += a.ends[t]
        for x, n in a.count[t].items():
            a.count[s][x] += n
            if x in a.next[s]:
                todo.append((a.next[s][x], a.next[t][x]))
            else:
                a.next[s][x] = a.next[t][x]


def infer(examples: list[str], alpha: float = ALPHA, of: dict[str, str] = CLASS_OF) -> Automaton:
    """Prefix tree of the examples' symbols, then merging of compatible states in breadth-first order."""
    a = Automaton()
    for e in sorted(examples):
        a.add([of[c] for c in e])
    red, known = [0], {0}
    while True:
        blue = None
        for r in red:
            for x in sorted(a.next[r]):
                if a.next[r][x] not in known:
                    blue = (r, x, a.next[r][x])
                    break
            if blue:
                break
        if not blue:
            break
        r, x, b = blue
        for q in red:
            if compatible(a, q, b, alpha):
                a.next[r][x] = q
                _fold(a, q, b)
                break
        else:
            red.append(b)
            known.add(b)
    new = {q: i for i, q in enumerate(red)}
    out = Automaton([{x: new[t] for x, t in a.next[q].items()} for q in red], [dict(a.count[q]) for q in red], [a.ends[q] for q in red], of)
    out.learn_characters(examples)
    return out


def candidates(text: str, taken: list[tuple]) -> list[list[tuple[int, int]]]:
    """For each run, its value after the last name separator and its whole, as far as they don't overlap ``taken`` (sorted)."""
    out, k, near = [], 0, []
    for m in CANDIDATE.finditer(text):
        while k < len(taken) and taken[k][0] < m.end():
            near.append(taken[k])
            k += 1
        near = [t for t in near if t[1] > m.start()]
        v = m[0]
        name = v.rstrip("=").rfind("=") + 1
        forms = []
        for at in (name, 0) if name else (0,):
            a = m.start() + at + len(v[at:]) - len(v[at:].lstrip(PUNCTUATION))
            b = m.start() + len(v.rstrip("+/_.-"))
            part = text[a:b]
            if (len(part) >= MIN_LENGTH and any(c.isdigit() for c in part) and any(c.isalpha() for c in part)
                    and not any(t[0] < b and t[1] > a for t in near)):
                forms.append((a, b))
        if forms:
            out.append(forms)
    return out


def suspects(w_data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Rows that can hold a span: a long run with a digit, a long hex run, an access key or a key word."""
    n = len(off) - 1
    run = _RUN[w_data]
    edge = np.diff(np.concatenate([[0], run.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = ends - starts >= MIN_LENGTH  # runs may join across rows, which only adds suspects
    starts, ends = starts[long], ends[long]
    digits = np.concatenate([[0], np.cumsum(_DIGIT[w_data], dtype=np.int64)])
    keep = (digits[ends] > digits[starts]) | (ends - starts >= 32)
    flag = np.zeros(n, bool)
    first = np.searchsorted(off, starts[keep], side="right") - 1
    last = np.searchsorted(off, ends[keep] - 1, side="right") - 1
    for a, b in zip(first, last):
        flag[a:b + 1] = True
    raw = w_data.tobytes()
    for i in np.flatnonzero(~flag):
        t = raw[off[i]:off[i + 1]]
        if b"AKIA" in t:
            flag[i] = True
        else:
            t = t.lower()
            flag[i] = b"passw" in t or b"secret" in t or b"token" in t or b"api" in t
    return flag


def labelled_values(docs: DataFrame, per_shape: int = PER_SHAPE, per_tree: int = PER_TREE) -> tuple[dict, dict[str, float]]:
    """The sample by (kind, alphabet), and log frequencies of the characters in runs of all texts."""
    def run(batches):
        seen = np.zeros(256, np.int64)
        names = ["kind", "alphabet", "shape", "h", "value", "n"]
        kinds = (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64())
        pack = lambda rows: pa.record_batch([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], names=names)
        for batch in batches:
            for b in W.slices(batch, "text"):
                data, off = W.text_buffers(b.column(0))
                seen += np.bincount(data[_RUN[data]], minlength=256)
                found = defaultdict(set)
                for i in np.flatnonzero(suspects(data, off)):
                    for _, _, k, v in base_spans(data[off[i]:off[i + 1]].tobytes().decode()):
                        v = v.lstrip(PUNCTUATION).rstrip("+/_.-")
                        if v and len(v) <= MAX_SYMBOLS:  # longer ones are beyond the sample's bound
                            h = int.from_bytes(hashlib.blake2b(v.encode(), digest_size=8).digest(), "little", signed=True)
                            found[k, alphabet_of(v), shape_of(v)].add((h, v))
                yield pack([(*key, h, v, 1) for key, held in found.items() for h, v in heapq.nsmallest(per_shape, held)])
        yield pack([(-1, "", "", 0, chr(c), int(seen[c])) for c in np.flatnonzero(seen)])

    src = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    got = materialize(small_batches(src).mapInArrow(run, "kind int, alphabet string, shape string, h long, value string, n long"))
    counts = {r.value: r.n for r in got.where("kind = -1").groupBy("value").agg(F.sum("n").alias("n")).collect()}
    total = sum(counts.values()) + len(CLASS_OF)
    background = {c: math.log((counts.get(c, 0) + 1) / total) for c in CLASS_OF}
    values = got.where("kind >= 0").select("kind", "alphabet", "shape", "h", "value").distinct()
    turns = top_k(values, ["kind", "alphabet", "shape"], ["h", "value"], per_shape, "value", 64, "turn")
    turns = turns.withColumn("size", F.length("value"))
    some = top_k(turns, ["kind", "alphabet"], ["turn", "size", "h", "value"], per_tree, "value", 64, "place")
    within = Window.partitionBy("kind", "alphabet").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)  # per_tree rows
    sample: dict[tuple[int, str], list[str]] = defaultdict(list)
    for r in some.withColumn("sum", F.sum("size").over(within)).where(F.col("sum") <= MAX_SYMBOLS).orderBy("kind", "alphabet", "place").collect():
        sample[r.kind, r.alphabet].append(r.value)
    return dict(sample), background


def learn(docs: DataFrame, per_shape: int = PER_SHAPE, per_tree: int = PER_TREE) -> dict[int, Grammar]:
    sample, background = labelled_values(docs, per_shape, per_tree)
    out: dict[int, Grammar] = {}
    for (kind, alphabet), values in sorted(sample.items()):
        if len(values) >= MIN_VALUES:
            out.setdefault(kind, Grammar({}, background)).parts[alphabet] = infer(values, of=SYMBOLS[alphabet])
    return out


def all_spans(text: str, automata: dict[int, Grammar]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans) as (start, end, kind number)."""
    base = [x[:3] for x in base_spans(text)]
    more = []
    for forms in candidates(text, base) if automata else ():
        hit = next((f for f in forms if any(m.accepts(text[f[0]:f[1]]) for m in automata.values())), None)
        more += [(*hit, 3)] if hit else []
    order = lambda s: sorted(s, key=lambda x: (x[0], x[2]))
    return order(base), order(base + more)


def _digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def scan(docs: DataFrame, automata: dict[int, Grammar]) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base, spans) of every row; spans are kind:start:end in code points."""
    shipped = docs.sparkSession.sparkContext.broadcast(automata)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        data, off = W.text_buffers(b.column(1))
        n = np.zeros((3, b.num_rows), np.int64)
        base, spans = [""] * b.num_rows, [""] * b.num_rows
        for i in np.flatnonzero(suspects(data, off)):
            some, every = all_spans(data[off[i]:off[i + 1]].tobytes().decode(), shipped.value)
            for _, _, k in some:
                n[k, i] += 1
            base[i], spans[i] = _digest(some), _digest(every)
        return pa.record_batch([b.column(0), *map(pa.array, n), pa.array(base, pa.string()), pa.array(spans, pa.string())],
                               names=["doc_id", "n_assign", "n_access", "n_hex", "base", "spans"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return by_slices(src, "text", run, "doc_id long, n_assign long, n_access long, n_hex long, base string, spans string")


def redact(docs: DataFrame, automata: dict[int, Grammar], mark: str = "[SECRET]") -> DataFrame:
    """The documents with every span (overlapping ones joined) replaced by ``mark``; ``n_chars`` follows."""
    shipped = docs.sparkSession.sparkContext.broadcast(automata)
    names = docs.columns
    at, chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None
    schema = docs.schema

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        data, off = W.text_buffers(b.column(at))
        texts, counts, changed = b.column(at).to_pylist(), b.column(chars).to_pylist() if chars is not None else None, False
        for i in np.flatnonzero(suspects(data, off)):
            if texts[i] is None:
                continue
            spans = all_spans(texts[i], shipped.value)[1]
            if not spans:
                continue
            parts, done = [], 0
            joined: list[list[int]] = []
            for a, e, _ in spans:
                if joined and a < joined[-1][1]:
                    joined[-1][1] = max(joined[-1][1], e)
                else:
                    joined.append([a, e])
            for a, e in joined:
                parts += [texts[i][done:a], mark]
                done = e
            texts[i] = "".join(parts) + texts[i][done:]
            changed = True
            if counts is not None and counts[i] is not None:
                counts[i] = len(texts[i])
        if not changed:
            return b
        cols = list(b.columns)
        cols[at] = pa.array(texts, cols[at].type)
        if counts is not None:
            cols[chars] = pa.array(counts, cols[chars].type)
        return pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return by_slices(docs, "text", run, schema)


@query("op8_grammar_secrets")
def op8_grammar_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``."""
    docs = load(spark, sf_dir, "documents")
    found = scan(docs, learn(docs))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")
