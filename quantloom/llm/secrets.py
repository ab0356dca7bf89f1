"""Secret scan: fixed patterns, and password guess-cost for values in a credential context.

The base patterns find assigned values, access ids and hex runs. The method adds values that a credential word
introduces and the base leaves out (other words, shorter values, other characters), if guessing them is dear: the least
cost over all segmentations into known words, dates, repeats, keyboard walks or sequences, and brute-force spans,
found by dynamic programming over the whole value. Words are those guessers try first, and then the words of a tokenizer's
vocabulary (a parameter) in its order, which is by frequency; the list is read from the file by each worker.

Defined results: a null or empty text has no spans; the same text always has the same spans, also in repeated rows; texts
of any length are scanned whole, positions count code points; an empty table gives no rows. Only the id and text columns are
read (``redact`` keeps all others as they are), so columns of other names may clash with nothing.
"""

from __future__ import annotations

import functools
import hashlib
import json
import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from . import token_files

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "guess")

#: Patterns over UTF-8 bytes, where (?i:) folds ASCII letters only.
ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
#: Runs of 16 and more: the same matches as runs of any length with shorter ones dropped.
HEX = re.compile(rb"[0-9a-f]{16,}")

#: Words after which a value counts as a credential. A quoted value runs to its closing quote.
CONTEXT = re.compile(rb"""(?i:(?<![A-Za-z0-9])(?:password|passwd|passphrase|passcode|pwd|pass|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|client[_-]?secret|auth|credentials?|login))["']?\x20*[:=]\x20*(?:"((?:\\[^\x00-\x1f]|[^"\\\x00-\x1f\x7f]){6,})"|'((?:\\[^\x00-\x1f]|[^'\\\x00-\x1f\x7f]){6,})'|["']?([^\x00-\x20"'<>,;\x7f]{6,}))""")
CONTEXT_WORDS = (b"pass", b"pwd", b"secret", b"token", b"key", b"auth", b"credential", b"login")
#: log10 of the guesses from which a value is taken as a secret.
DEAR = 8.0

#: Words that guessers try first, the commonest first.
WORDS = """password admin welcome login letmein master secret changeme default guest user test root pass
dragon monkey football baseball basketball shadow sunshine princess superman batman iloveyou trustno hello
freedom whatever qwerty computer internet server database example sample placeholder demo temp public private
token apikey key access account summer winter spring autumn monday friday january december love angel flower
tiger lion eagle falcon phoenix thunder hunter ranger soccer hockey killer pepper ginger cookie banana orange
apple cherry silver golden purple yellow green blue black white red love money lucky happy family mother father
michael jennifer jordan thomas robert daniel andrew joshua matthew anthony william jessica ashley nicole hannah
google microsoft windows linux oracle mysql system manager support office home work school""".split()


class Words:
    """Ranks of words, the likeliest first: ``first``, then the words of a byte-level tokenizer's vocabulary in order of id."""

    def __init__(self, vocab: str | None = None, first: list[str] = WORDS):
        self.rank: dict[str, int] = {}
        for w in [*first, *(vocabulary_words(vocab) if vocab else ())]:
            self.rank.setdefault(w, len(self.rank) + 1)
        self.longest = max(map(len, self.rank))


def vocabulary_words(vocab: str) -> Iterator[str]:
    """Entries that start a word (a space before letters), in lower case, of three letters and more."""
    with open(vocab, encoding="utf-8") as f:
        ids = json.load(f)["model"]["vocab"]
    spelled = {ord(c): b for b, c in token_files.byte_letters().items()}
    for token, _ in sorted(ids.items(), key=lambda x: x[1]):
        if token[:1] == "\u0120" and all(ord(c) in spelled for c in token):  # the space's letter
            word = bytes(spelled[ord(c)] for c in token[1:]).decode("utf-8", "replace").lower()
            if len(word) >= 3 and word.isalpha():
                yield word


@functools.cache
def known_words(vocab: str | None) -> Words:
    """One list for each worker process and file."""
    return Words(vocab)


LEET = str.maketrans("@4831!05$7", "aabeiiosst")
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz", "0123456789")
DATE = re.compile(r"(?:(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:(?:19|20)\d\d|\d\d))")
YEAR = re.compile(r"(?:19|20)\d\d")
NEXT = math.log10(2)


def char_cost(c: str) -> float:
    return 1.0 if c.isdigit() else math.log10(26) if c.isascii() and c.isalpha() else math.log10(33) if c.isascii() else 3.0


class Value:
    """A value with what its segments need, prepared once: lower case, plain spelling, and how far it repeats."""

    def __init__(self, value: str):
        self.value, self.low = value, value.lower()
        self.plain = self.low.translate(LEET)
        n = len(value)
        #: again[u][i]: how many characters from i on equal those u further on.
        self.again = {}
        for unit in range(1, 5):
            row = [0] * (n + unit + 1)
            for i in range(n - unit - 1, -1, -1):
                row[i] = row[i + 1] + 1 if value[i] == value[i + unit] else 0
            self.again[unit] = row


def segments(v: Value, i: int, words: Words) -> Iterator[tuple[int, str, float]]:
    """Structured segments from position i: (end, kind, log10 of guesses)."""
    value, low = v.value, v.low
    for n in range(3, min(words.longest, len(value) - i) + 1):
        for form, more in ((low, 0.0), (v.plain, NEXT)):
            if (rank := words.rank.get(form[i : i + n])) is not None:
                case = 0.0 if value[i : i + n] in (low[i : i + n], value[i : i + n].upper()) else NEXT
                yield i + n, "word", math.log10(rank) + case + more
                break
    if m := DATE.match(value, i):
        yield m.end(), "date", math.log10(365 * 120)
    if m := YEAR.match(value, i):
        yield m.end(), "date", math.log10(120)
    for unit in range(1, 5):
        times = (v.again[unit][i] + unit) // unit
        if unit * times >= max(3, 2 * unit):
            yield i + unit * times, "repeat", sum(map(char_cost, value[i : i + unit])) + math.log10(times)
    for row in ROWS:
        at = row.find(low[i])
        if at < 0:
            continue
        for step in (1, -1):
            j, k = i, at
            while j < len(low) and 0 <= k < len(row) and low[j] == row[k]:
                j, k = j + 1, k + step
            for end in range(i + 3, j + 1):
                yield end, "walk", math.log10(2 * len(ROWS) * 13) + math.log10(end - i)


def guess_cost(value: str, words: Words) -> tuple[float, list[tuple[str, str]]]:
    """log10 of the guesses for a value, with the cheapest segmentation. Adjoining brute-force characters are one span."""
    n, prepared = len(value), Value(value)
    best = [[math.inf, math.inf] for _ in range(n + 1)]  # by whether the last segment is brute force
    back: list[list[tuple[int, int, str] | None]] = [[None, None] for _ in range(n + 1)]
    best[0][0] = 0.0
    for i in range(n):
        start = min(best[i])
        if start == math.inf:
            continue
        last = best[i].index(start)
        opened = NEXT if i else 0.0
        for end, kind, cost in segments(prepared, i, words):
            if start + opened + cost < best[end][0]:
                best[end][0], back[end][0] = start + opened + cost, (i, last, kind)
        cost = char_cost(value[i])
        for state, more in ((1, 0.0), (0, opened)):
            if best[i][state] + more + cost < best[i + 1][1]:
                best[i + 1][1], back[i + 1][1] = best[i][state] + more + cost, (i, state, "brute")
    parts: list[tuple[str, str]] = []
    at, state = n, best[n].index(min(best[n]))
    while at:
        i, before, kind = back[at][state]
        if parts and kind == parts[-1][0] == "brute":
            parts[-1] = ("brute", value[i:at] + parts[-1][1])
        else:
            parts.append((kind, value[i:at]))
        at, state = i, before
    return min(best[n]), parts[::-1]


#: Consonants that may follow each consonant in English, German, French or Spanish words; vowels follow and precede all but q.
FOLLOW = {c: set("aeiouy" + rest) for c, rest in zip("bcdfghjklmnpqrstvwxz", "blrstdj chklrtqs dghjlmnrstvw flrst ghlnrstdm lmnrtws - lnrstwkh bcdfghklmnpqstvwz bmnpsftl cdfghjklmnpqrstvwxz fhlprst - bcdfghklmnpqrstvwz bcdfghklmnpqrstvwz bcfghlmnrstwz rl hlnrskt cpth twzlhv".split(), strict=True)} | {"q": {"u"}}


def wordlike(run: str) -> bool:
    """A run of letters that spells like prose, hump by hump where capitals start words."""
    return all((len(h) > 1 or len(run) == 1) and all(b in FOLLOW.get(a, (b,)) or not b.isascii() for a, b in zip(h, h[1:], strict=False)) for h in (x.lower() for x in re.findall(r"[^\W\d_][^\W\d_A-Z]+|[A-Z]+(?![^\W\d_A-Z])|[^\W\d_]", run)))


def prose(value: bytes) -> bool:
    """Words and numbers of at most four digits, between punctuation; the letters of each word must spell like a word."""
    text = value.decode("utf-8", "replace")
    if b" " not in value:
        return not mixed(value) and not re.search(r"\d", text) and all(map(wordlike, re.findall(r"[^\W\d_]+", text)))
    return all(re.fullmatch(r"\d{1,4}", w) or (w.isalpha() and wordlike(w)) for x in text.split() for w in re.split(r"['\u2019/-]", x.strip(".,;:!?()[]")) if w)


def mixed(value: bytes) -> bool:
    """At least two of: letters, digits, other characters."""
    return sum(bool(re.search(p, value)) for p in (rb"[A-Za-z\x80-\xff]", rb"[0-9]", rb"[^A-Za-z0-9\x80-\xff.,:!?)]")) >= 2


def scan(text: str | None, words: Words, dear: float = DEAR) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) in code points, by start, then in the order of KINDS."""
    b = C.text_of(text)
    found: list[tuple[str, int, int]] = []
    low = b.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(b) if len(m[1]) >= 12]
    if b"AKIA" in b:
        found += [("access", *m.span()) for m in ACCESS.finditer(b) if m.end() - m.start() >= 18]
    found += [("hex", *m.span()) for m in HEX.finditer(b)]
    if any(w in low for w in CONTEXT_WORDS):
        starts, ends = [s for k, s, _ in found if k == "assign"], [e for k, _, e in found if k == "assign"]
        for m in CONTEXT.finditer(b):
            value = m[m.lastindex].rstrip(b".!?):") if m.lastindex == 3 else m[m.lastindex]
            s, e = m.start(m.lastindex), m.start(m.lastindex) + len(value)
            at = bisect_right(starts, s) - 1  # assign spans don't overlap: only the last one before can hold the value
            if len(value) >= 6 and not (at >= 0 and e <= ends[at]) and not prose(value) and guess_cost(value.decode("utf-8", "replace"), words)[0] >= dear:
                found.append(("guess", s, e))
    if not found:
        return []
    if not b.isascii():
        place, at, points = {}, 0, 0
        for p in sorted({x for _, s, e in found for x in (s, e)}):
            points += sum(1 for c in b[at:p] if c & 0xC0 != 0x80)
            at, place[p] = p, points
        found = [(k, place[s], place[e]) for k, s, e in found]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dear: float = DEAR, vocab: str | None = None) -> DataFrame:
    """One row per document: id and ``spans array<struct<kind, start, end>>``."""
    src, vocab = docs.select(id_col, text_col), vocab or token_files.vocabulary_path()
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([src.schema[0], T.StructField("spans", T.ArrayType(span))])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in C.chunks(batch):
                spans = [[{"kind": k, "start": s, "end": e} for k, s, e in scan(t, known_words(vocab), dear)] for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, kind)], names=schema.names)

    return src.mapInArrow(run, schema)


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]", dear: float = DEAR, vocab: str | None = None) -> DataFrame:
    """The same rows and columns with every span of the text replaced; overlapping spans become one mark."""
    schema, vocab = docs.schema, vocab or token_files.vocabulary_path()
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in C.chunks(batch, at):
                texts = [hide(t, scan(t, known_words(vocab), dear), mark) for t in b.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(b.columns)], names=schema.names)

    return docs.mapInArrow(run, schema)


def hide(text: str | None, spans: list[tuple[str, int, int]], mark: str) -> str | None:
    if text is None or not spans:
        return text
    out, at, until = [], 0, -1
    for _, s, e in spans:
        if s >= until:
            out += [text[at:s], mark]
        until = max(until, e)
        at = until
    return "".join([*out, text[at:]])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    long = T.LongType()
    schema = T.StructType([src.schema[0], *[T.StructField(f"n_{k}", long) for k in KINDS], T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = [[(s["kind"], s["start"], s["end"]) for s in spans] for spans in b.column(1).to_pylist()]
            counts = [pa.array([sum(k == s[0] for s in spans) for spans in each], pa.int64()) for k in KINDS]
            base = pa.array([hashlib.sha256(joined([s for s in spans if s[0] in BASE_KINDS]).encode()).hexdigest() for spans in each])
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, base, pa.array([joined(s) for s in each], pa.string())], names=schema.names)

    return find(src).mapInArrow(run, schema)
