"""Secret scans: fixed patterns, and values in credential contexts judged by the cost of guessing them.

The patterns assign, access and hex give base spans. The method reads values that stand in a credential context (a key
word, perhaps with a suffix as in SECRET_KEY, then "=", ":", "is", "is:" or a space; or the password part of a URL, whose user may be empty) and finds by dynamic programming the cheapest way to
write the value as a sequence of dictionary words, dates, repeats, sequences, keyboard walks and brute-force stretches. A value whose
log10 guesses are at least MIN_GUESSES becomes a span of kind "guess", unless a base span already covers it. Only after a
mere space a value of letters alone is taken for prose, whatever its cost, and gives no span.

guess_cost() is the minimum over all segmentations of the sum of the segments' log10 costs, with JOIN for each segment. Any part of a value may be
a segment of any kind that it fits, at any length. Costs of a segment of n characters:
  word     log10(rank + 1), more for capitals and 0.5 for digits that stand for letters
  date     log10(365 x 120), a year alone log10(120)
  repeat   of one character, n >= 3: log10(26 n); of a unit of 2 to 4, n >= 2 units: 1.2 a unit's character + log10(n / unit)
  sequence letters or digits in order, n >= 3: 1 + log10(n)
  walk     neighbouring keys, n >= 4: log10(47 n) + log10(4) for each turn
  brute    n x log10(size of the value's alphabet)
The work is linear in the value's length: brute force grows by a character at a time, and of the starts of a repeat, sequence or walk
only those are kept that are cheapest for some end.

Words are ranked by their frequency in all documents, by grouped aggregation: the DICTIONARY most frequent of at least MIN_TIMES occurrences (a bounded table), values in
credential contexts left out, so that a leaked secret does not become a word. COMMON_WORDS have their ranks besides. Callers may pass words.

Null text is empty and gives zero counts. Texts are scanned whole, and values of any length. Given the words rows are independent, so ties, repeated rows and
extra columns change nothing; words of equal frequency are ranked by name. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, frugal, written

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Lower-case pieces of which at least one is in any text that ASSIGN matches.
ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: What may follow a key word in a name, as in SECRET_KEY or token_value2.
SUFFIX = r"(?:[_-]?(?:keys?|token|secret|value|string|base|id)){0,3}[_-]?[0-9]{0,2}"
CONTEXT = re.compile(r"(?:pass(?:word|wd|phrase|code)|pwd|secret|token|api[_-]?key|credentials?|private[_-]?key|access[_-]?key|bearer|auth)(?:" + SUFFIX + r"[\"']?(?:\x20is)?\x20*[:=]\x20*|[\"']?\x20is\x20|[\"']?(?P<plain>\x20))[\"']?(?P<value>[!-~]{6,})|://[^\s:/@]*+:(?P<url>[^\s:/@]{6,})@", re.IGNORECASE | re.ASCII)
CONTEXT_HINTS = ("pass", "pwd", "secret", "token", "api", "credential", "key", "bearer", "auth", "://")
MIN_GUESSES = 10.0
JOIN = 0.5
DICTIONARY, MIN_TIMES = 20_000, 5
#: Shortest and longest word of the dictionary.
WORD = (3, 24)
COMMON_WORDS = "password 123456 qwerty admin letmein welcome monkey dragon master login princess sunshine shadow football baseball secret hello freedom whatever trustno1 superman batman iloveyou starwars access flower hunter ranger buster soccer hockey killer george andrew charlie thomas robert daniel jordan michael jennifer jessica summer winter spring autumn orange purple yellow silver golden diamond internet computer server system root user test guest default changeme example sample demo token key value string number the and for with this that from have not you are was all can her his one our out day get has him how man new now old see two way who boy did its let put say she too use love money house water world night light story point small large money power apple banana cherry coffee dinner pizza tiger horse".split()
KEYBOARD = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
_SHIFT = str.maketrans("~!@#$%^&*()_+{}|:\"<>?", "`1234567890-=[]\\;',./")
_LEET = str.maketrans("4@301$5!7", "aaeolssit")
_DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0?[1-9]|1[0-2])(?:[-/._]?(?:0?[1-9]|[12]\d|3[01]))?)?|(?:0?[1-9]|[12]\d|3[01])[-/._]?(?:0?[1-9]|1[0-2])[-/._]?(?:19|20)?\d\d")


def _near_keys() -> dict[str, set[str]]:
    at = {c: (r, k) for r, row in enumerate(KEYBOARD) for k, c in enumerate(row)}
    return {c: {d for d, (s, m) in at.items() if d != c and abs(s - r) <= 1 and -1 <= (m - k) + 0.5 * (s - r) <= 1} for c, (r, k) in at.items()}


NEAR = _near_keys()


def words_by_rank(words: list[str]) -> dict[str, float]:
    """log10 cost of each word by its place; COMMON_WORDS by theirs, whichever is less."""
    out = {w: math.log10(k + 2) for k, w in reversed(list(enumerate(words)))}
    for k, w in enumerate(COMMON_WORDS):
        out[w] = min(out.get(w, math.inf), math.log10(k + 2))
    return out


RANKS = words_by_rank([])
_WORD = re.compile(r"[a-z]{%d,%d}" % WORD)


class _Chain:
    """Cheapest segment of one kind that ends here, over all its starts.

    A start s costs `base + best(s) + log10(e - s) + turns between` at the end e. Of two starts the later one falls behind for good once it
    does not lead at its first end, and the earlier one is of no use once the later has the lower sum; so few are held."""

    def __init__(self, base: float, least: int, unit: int = 1):
        self.base, self.least, self.unit = base, least, unit
        self.starts: list[tuple[int, float]] = []  # start, sum before it less the turns until it
        self.fresh: list[tuple[int, float]] = []  # those that are too near still
        self.turns = 0.0

    def add(self, start: int, before: float) -> None:
        self.fresh.append((start, before - self.turns))

    def broken(self, at: int) -> None:
        """The character `at` does not continue what was one unit before."""
        self.starts = [x for x in self.starts if x[0] > at - self.unit]
        self.fresh = [x for x in self.fresh if x[0] > at - self.unit]

    def cost(self, end: int) -> float:
        while self.fresh and end - self.fresh[0][0] >= self.least:
            s, g = self.fresh.pop(0)
            if all(h + math.log10(end - t) > g + math.log10(end - s) for t, h in self.starts):
                self.starts = [x for x in self.starts if x[1] < g]
                self.starts.append((s, g))
        return min((self.base + g + math.log10(end - s) for s, g in self.starts), default=math.inf) + self.turns


_TURN = math.log10(4)


def _words_at(value: str, low: str, leet: str, i: int, ranks: dict[str, float], longest: int) -> Iterator[tuple[int, float]]:
    """(end, cost) of the words that start at i."""
    for j in range(i + WORD[0], min(len(value), i + longest) + 1):
        for word, more in ((low[i:j], 0.0), (leet[i:j], 0.5)):
            if (rank := ranks.get(word)) is not None:
                upper = sum(map(str.isupper, value[i:j]))
                shape = 0.0 if not upper else 0.3 if upper in (1, j - i) else math.log10(2) + math.log10(math.comb(j - i, upper))
                yield j, rank + shape + more
                break


def _alphabet(value: str) -> float:
    size = sum(n for n, test in ((10, str.isdigit), (26, str.islower), (26, str.isupper)) if any(map(test, value)))
    return math.log10(max(10, size + 33 * any(not c.isalnum() for c in value)))


def guess_cost(value: str, ranks: dict[str, float] = RANKS, longest: int = WORD[1]) -> float:
    """log10 of the guesses that the cheapest segmentation takes."""
    n, per = len(value), _alphabet(value)
    low = value.lower() if len(value.lower()) == n else value
    leet, keys = low.translate(_LEET), low.translate(_SHIFT)
    best = [0.0] + [math.inf] * n
    brute = math.inf  # cheapest way whose last segment is an open stretch
    repeats = [_Chain(math.log10(26), 3), *(_Chain(1.2 * u - math.log10(u), 2 * u, u) for u in (2, 3, 4))]
    rows = {1: _Chain(1.0, 3), -1: _Chain(1.0, 3)}
    walk, last = _Chain(math.log10(47), 4), None
    for i in range(n):
        here = best[i] + JOIN
        for chain in repeats:
            if i >= chain.unit and low[i] != low[i - chain.unit]:
                chain.broken(i)
            chain.add(i, here)
        step = ord(low[i]) - ord(low[i - 1]) if i else None
        for way, chain in rows.items():
            if i and step != way:
                chain.broken(i)
            chain.add(i, here)
        if i and keys[i] in NEAR.get(keys[i - 1], ()):
            move = ord(keys[i]) - ord(keys[i - 1])
            if last is not None and move != last:
                turned = walk.fresh.pop() if walk.fresh and walk.fresh[-1][0] == i - 1 else None  # the step before lies outside a walk from here
                walk.turns += _TURN
                if turned:
                    walk.fresh.append((turned[0], turned[1] - _TURN))
            last = move
        else:
            walk.broken(i)
            last = None
        walk.add(i, here)
        for j, cost in _words_at(value, low, leet, i, ranks, longest):
            best[j] = min(best[j], here + cost)
        if value[i].isdigit():
            for j in range(i + 4, min(n, i + 10) + 1):
                if _DATE.fullmatch(value, i, j):
                    best[j] = min(best[j], here + (math.log10(365 * 120) if j - i > 4 else math.log10(120)))
        brute = min(brute, here) + per
        best[i + 1] = min(best[i + 1], brute, walk.cost(i + 1), *(c.cost(i + 1) for c in repeats), *(c.cost(i + 1) for c in rows.values()))
    return best[n]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the base patterns' matches, in order."""
    low = text.lower()
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6] if any(h in low for h in ASSIGN_HINTS) else []
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def context_values(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, whether only a space stands before it) of the values in credential contexts."""
    low = text.lower()
    if any(h in low for h in CONTEXT_HINTS):
        for m in CONTEXT.finditer(text):
            k = "value" if m["value"] is not None else "url"
            yield m.start(k), m.start(k) + len(m[k].rstrip(".,;:!?\"')")), m["plain"] is not None


def guess_spans(text: str, base: list[tuple[int, int, int]], least: float = MIN_GUESSES, ranks: dict[str, float] = RANKS, longest: int = WORD[1]) -> list[tuple[int, int]]:
    """(start, end) of context values that are hard to guess and outside the base spans."""
    out, k, past = [], 0, 0  # past: the furthest end of the base spans that begin before the value ends
    for start, end, plain in context_values(text):
        while k < len(base) and base[k][0] < end:
            past = max(past, base[k][2])
            k += 1
        value = text[start:end]
        prose = plain and value.isalpha()  # "token classification"
        if not prose and end - start >= 6 and past <= start and guess_cost(value, ranks, longest) >= least:
            out.append((start, end))
    return out


_COUNT = pa.schema([("word", pa.string()), ("n", pa.int64())])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of the texts, values in credential contexts left out, with their times, in parts of a bounded size."""
    held: Counter[str] = Counter()

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], schema=_COUNT)

    for batch in batches:
        for text in batch.column(0):
            text, at, parts = text.as_py() or "", 0, []
            for start, end, _ in context_values(text):
                parts.append(text[at:start])
                at = end
            parts.append(text[at:])
            for part in parts:
                held.update(_WORD.findall(part.lower()))
        if len(held) >= 200_000:
            yield done()
            held.clear()
    if held:
        yield done()


def dictionary(df: DataFrame, text_col: str = "text", size: int = DICTIONARY) -> list[str]:
    """The most frequent words of all texts, in order of their frequency."""
    bounded_batches(df)
    counts = df.select(F.col(text_col).alias("text")).mapInArrow(frugal(_count_words), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = written(counts.filter(F.col("n") >= MIN_TIMES))
    step = F.floor(F.log2("n") * 16).cast("int")
    steps = sorted(((r["step"], r["words"]) for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect()), reverse=True)  # a thousand at most
    total, least = 0, 0
    for least, words in steps:
        total += words
        if total >= size:
            break
    # Tasks read and filter the counts; only words of the steps that are wanted pass one task, which holds and sends `size` of them.
    few = counts.filter(step >= least).repartition(1).sortWithinPartitions(F.desc("n"), "word").limit(size)
    return [r["word"] for r in few.collect()]


def _joined(spans: list[tuple[int, int, int]], names: tuple[str, ...]) -> str:
    return ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)


_OUT = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_guess", pa.int64())])


def _scan(ranks: dict[str, float]):
    names = (*KINDS, "guess")
    longest = max(map(len, ranks), default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in _OUT]
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                base = base_spans(text)
                more = guess_spans(text, base, MIN_GUESSES, ranks, longest)
                every = sorted([*base, *((a, 3, b) for a, b in more)])
                counts = [sum(k == n for _, k, _ in base) for n in range(3)]
                for column, value in zip(out, (i, *counts, hashlib.sha256(_joined(base, names).encode()).hexdigest(), _joined(every, names), len(more)), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, _OUT, strict=True)], schema=_OUT)

    return run


def secret_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: list[str] | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_guess of every text; words by rank, or those of the texts themselves."""
    bounded_batches(df)
    ranks = words_by_rank(dictionary(df, text_col) if words is None else words)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(frugal(_scan(ranks)), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long")
