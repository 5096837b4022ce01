"""Personal data: fixed patterns, and a skip-chain conditional random field over the tokens that could be personal data.

Base patterns give email, ip, card and phone spans. The field's nodes are a document's tokens with a digit or an "@";
consecutive nodes at most GAP characters apart share a chain potential. Tokens that repeat or resemble each other (equal letters
and digits, equal last seven digits, equal mailbox name) form a group, wherever they stand in the document: each shares the skip potential with the
group's hub, a node without features of its own, so evidence goes from any member to all others in two steps and edges
stay linear in the tokens. Tokens of equal letters and digits are one witness: they share one unary score, so many uncertain repeats do not outvote a certain one. Labels are O and the four kinds. Damped sum-product messages run in each document until none changes by more
than TOLERANCE; crf_rounds tells how many rounds that took (MOST_ROUNDS where loops keep on oscillating).

The base spans are clamped. What the field adds are tokens outside them that are in a group: tokens of equal letters and digits get the label of their
group's hub, all or none, if its marginal is at least CERTAIN; a token that only resembles others gets its own best label at that marginal. They become spans
of kind "crf_" + label; neighbours of one label join. A token without a group adds nothing.

train() fits the potentials by pseudo-likelihood on the base spans of at most TRAIN_DOCS documents, those with the smallest
hash of doc_id, in a task of their own; for it, a hub has the mean label of the other members. Only the potentials come to the driver.

Null text is empty and gives zero counts. Texts are scanned whole, in time linear in their length; inference takes documents
together up to NODES tokens, and a longer one alone. Rows are independent given the potentials, so ties, repeated rows, extra columns and the
order of rows change nothing; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, frugal, unit_hash

KINDS = ("email", "ip", "card", "phone")
LABELS = len(KINDS) + 1
TRAIN_DOCS = 400
GAP, DAMPING, CERTAIN, CLAMP = 2, 0.5, 0.95, 8.0
AGREE = 4.0  # added to the skip potential of equal labels
TOLERANCE, MOST_ROUNDS, NODES = 1e-3, 500, 1 << 15
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_MAILBOX = re.compile(r"[A-Za-z0-9._%+-]+\Z")
# A run of digits is entered at its start only: a later start in it could not match where the first does not.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN, _TELLING = re.compile(r"\S+"), re.compile(r"[0-9@]")
_CUES = re.compile(r"(?:phone|tel|call|fax|mobile|e-?mail|mail|contact|card|visa|account|iban|ip|address|server|host)\W*\Z", re.IGNORECASE)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    past = 0
    for m in _DOMAIN.finditer(text):
        at = begin = m.start()
        while begin > past and (c := text[begin - 1]) < "\x7f" and (c.isalnum() or c in "._%+-"):
            begin -= 1
        if begin < at:
            yield begin, m.end()
            past = m.end()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the base patterns' matches, in order."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "." in text:
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(x) <= 3 and int(x or "0") <= 255 for x in (p.lstrip("0") for p in m[0].split(".")))]
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


# ---- the field's graph


def _keys(token: str) -> list[str]:
    """What a token shares with those that repeat or resemble it."""
    plain = "".join(c for c in token.lower() if c.isalnum())
    digits = "".join(c for c in token if c.isdigit())
    out = ["t" + plain] if len(plain) >= 6 else []
    if len(digits) >= 7:
        out.append("d" + digits[-7:])
    if "@" in token and len(box := token.split("@")[0].lower()) >= 4:
        out.append("b" + box)
    return out


#: What _features() gives.
FEATURES = 26


def _features(text: str, a: int, b: int) -> list[float]:
    token = text[a:b]
    n = b - a
    digits = sum(c.isdigit() for c in token)
    letters = sum(c.isalpha() for c in token)
    cue = bool(_CUES.search(text, max(0, a - 16), a)) if digits or "@" in token else False
    cut = lambda x, *tops: [float(x >= t) for t in tops]
    return [1.0, float("@" in token), float("@" in token and "." in token.split("@")[-1]), float(token[:1] == "+"), float(token[:1] == "("), *cut(token.count("."), 1, 2, 3), *cut(token.count("-"), 1, 2), *cut(digits, 1, 2, 4, 7, 10, 14, 20), *cut(letters, 1, 4), digits / n, float(digits == n), *cut(n, 4, 8, 16, 24), float(cue)]


class Graph:
    """Nodes, chain edges and groups of many documents together; hubs are nodes after those of tokens."""

    def __init__(self, texts: list[str], spans: list[list[tuple[int, int, int]]], unary: np.ndarray | None = None):
        """With potentials, theta has the score of each token's labels and features are not kept."""
        place, label, chain, scores = [], [], [], []
        member, hub, exact, hub_doc = [], [], [], []
        features: list[list[float]] = []

        def flush() -> None:
            x = np.array(features, dtype=np.float32).reshape(-1, FEATURES)
            scores.append(x if unary is None else x @ unary)
            features.clear()

        for d, text in enumerate(texts):
            groups: dict[str, list[int]] = {}
            at, before = [0] * len(KINDS), -1
            held = [[(s, e) for s, k, e in spans[d] if k == kind] for kind in range(len(KINDS))]  # of one kind, spans do not overlap
            for m in _TOKEN.finditer(text):
                a, b = m.span()
                if not _TELLING.search(text, a, b):
                    continue
                while a < b and text[a] in "\"'([{<":
                    a += 1
                while b > a and text[b - 1] in "\"')]}>.,;:!?#*$%&":
                    b -= 1
                if a == b:
                    continue
                node = len(place)
                hits = []
                for kind, own in enumerate(held):
                    while at[kind] < len(own) and own[at[kind]][1] <= a:
                        at[kind] += 1
                    if at[kind] < len(own) and own[at[kind]][0] < b:
                        hits.append((own[at[kind]][0], kind))
                label.append(min(hits)[1] + 1 if hits else 0)
                features.append(_features(text, a, b))
                if len(features) >= 8192:
                    flush()
                if before >= 0 and a - place[before][2] <= GAP:
                    chain.append((before, node))
                before = node
                for key in _keys(text[a:b]):
                    groups.setdefault(key, []).append(node)
                place.append((d, a, b))
            for key, own in groups.items():
                if len(own) > 1:
                    member += own
                    hub += [len(hub_doc)] * len(own)
                    exact += [key[0] == "t"] * len(own)
                    hub_doc.append(d)
        flush()
        self.place = place
        self.tokens = len(place)
        self.label = np.array(label, dtype=np.int64)
        self.chain = np.array(chain, dtype=np.int64).reshape(-1, 2)
        self.member, self.hub, self.exact = np.array(member, dtype=np.int64), np.array(hub, dtype=np.int64), np.array(exact, dtype=bool)
        self.hubs = len(hub_doc)
        self.doc = np.array([p[0] for p in place] + hub_doc, dtype=np.int64)
        rows = np.concatenate(scores)
        self.x = rows if unary is None else None
        self.theta = None if unary is None else rows


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def train(texts: list[str], steps: int = 200, rate: float = 1.0, penalty: float = 1e-3) -> dict[str, np.ndarray]:
    """Potentials by pseudo-likelihood: each label given its token's features, its neighbours' labels and those of its groups."""
    g = Graph(texts, [base_spans(t) for t in texts])
    n = g.tokens
    if not n:
        return {"unary": np.zeros((FEATURES, LABELS)), "chain": np.zeros((LABELS, LABELS)), "skip": np.zeros((LABELS, LABELS))}
    one = np.eye(LABELS)[g.label]
    around = np.zeros((3, n, LABELS))  # labels before, after, and of the other members of groups
    np.add.at(around[0], g.chain[:, 1], one[g.chain[:, 0]])
    np.add.at(around[1], g.chain[:, 0], one[g.chain[:, 1]])
    if g.hubs:
        size = np.bincount(g.hub, minlength=g.hubs)
        whole = np.zeros((g.hubs, LABELS))
        np.add.at(whole, g.hub, one[g.member])
        np.add.at(around[2], g.member, (whole[g.hub] - one[g.member]) / (size[g.hub] - 1)[:, None])
    x = np.hstack([g.x, *around])
    weight = 1 / np.maximum(1, np.bincount(g.label, minlength=LABELS))[g.label] ** 0.5
    weight /= weight.sum()
    w = np.zeros((x.shape[1], LABELS))
    speed = np.zeros_like(w)
    for _ in range(steps):
        grad = x.T @ ((_softmax(x @ w) - one) * weight[:, None]) + penalty * w
        speed = 0.9 * speed - rate * 0.1 * grad
        w += speed
    before, after, skip = np.split(w[FEATURES:], 3)
    skip = (skip + skip.T) / 2
    np.fill_diagonal(skip, skip.diagonal().mean() + AGREE)  # one agreement is worth as much as another, or the label with more edges would win
    return {"unary": w[:FEATURES], "chain": (before + after.T) / 2, "skip": skip}


def marginals(g: Graph, model: dict[str, np.ndarray], clamped: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(label probabilities of each token and then of each hub, rounds of each document) by loopy sum-product; base labels are held by CLAMP."""
    n = g.tokens + g.hubs
    theta = np.zeros((n, LABELS), np.float32)
    if not n:
        return theta, np.zeros(0, np.int64)
    theta[: g.tokens] = g.theta if g.theta is not None else g.x @ model["unary"]
    theta[g.member[g.exact]] /= np.bincount(g.hub, minlength=g.hubs)[g.hub[g.exact]][:, None]
    if clamped:
        held = np.flatnonzero(g.label)
        theta[held, g.label[held]] += CLAMP
    c, s = len(g.chain), len(g.member)
    hub = g.hub + g.tokens
    source = np.concatenate([g.chain[:, 0], g.chain[:, 1], g.member, hub])
    target = np.concatenate([g.chain[:, 1], g.chain[:, 0], hub, g.member])
    back = np.concatenate([np.arange(c) + c, np.arange(c), np.arange(s) + 2 * c + s, np.arange(s) + 2 * c])
    kind = np.repeat([0, 1, 2, 3], [c, c, s, s])
    pair = [np.exp(m).astype(np.float32) for m in (model["chain"], model["chain"].T, model["skip"], model["skip"].T)]
    message = np.zeros((len(source), LABELS), np.float32)
    rounds = np.zeros(int(g.doc.max()) + 1, np.int64)

    def belief() -> np.ndarray:
        total = theta.copy()
        np.add.at(total, target, message)
        return total

    live = np.arange(len(source))  # edges of the documents that still change
    of = g.doc[source]
    for turn in range(1, MOST_ROUNDS + 1):
        if not len(live):
            break
        out = belief()[source[live]] - message[back[live]]
        out = np.exp(out - out.max(1, keepdims=True))
        fresh = np.empty_like(out)
        for k, table in enumerate(pair):
            rows = kind[live] == k
            fresh[rows] = np.log(np.maximum(out[rows] @ table, 1e-30))
        fresh -= fresh.max(1, keepdims=True)
        fresh = np.float32(DAMPING) * message[live] + np.float32(1 - DAMPING) * fresh
        change = np.zeros(len(rounds))
        np.maximum.at(change, of[live], np.abs(fresh - message[live]).max(1))
        message[live] = fresh
        rounds[np.unique(of[live])] = turn
        live = live[change[of[live]] > TOLERANCE]
    return _softmax(belief()), rounds


def field_spans(texts: list[str], spans: list[list[tuple[int, int, int]]], model: dict[str, np.ndarray]) -> tuple[list[list[tuple[int, int, int]]], list[int]]:
    """For each document (start, number of the label's kind, end) of what the field adds, and its rounds."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    g = Graph(texts, spans, model["unary"])
    p, rounds = marginals(g, model)
    if not g.hubs:
        return out, [*rounds.tolist(), *[0] * (len(texts) - len(rounds))]
    by = np.zeros(g.tokens, np.int64) - 1  # of each token in a group, the node that decides: its group's hub, or itself where it only resembles others
    by[g.member] = g.member
    by[g.member[g.exact]] = g.hub[g.exact] + g.tokens
    asked = np.flatnonzero((by >= 0) & (g.label == 0))
    best = p[by[asked]].argmax(1)
    sure = (best > 0) & (p[by[asked], best] >= CERTAIN)
    for node, y in zip(asked[sure].tolist(), best[sure].tolist(), strict=True):
        d, a, b = g.place[node]
        if out[d] and out[d][-1][1] == y - 1 and a - out[d][-1][2] <= GAP:
            a = out[d].pop()[0]
        out[d].append((a, y - 1, b))
    return out, [*rounds.tolist(), *[0] * (len(texts) - len(rounds))]


_OUT = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_crf", pa.int64()), ("crf_rounds", pa.int64())])
_DDL = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_crf long, crf_rounds long"
_NAMES = (*KINDS, *(f"crf_{k}" for k in KINDS))


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{_NAMES[k]}:{a}:{b}" for a, k, b in spans)


def _scan(model: dict[str, np.ndarray]):
    def done(ids: list, texts: list[str], base: list[list[tuple[int, int, int]]]) -> pa.RecordBatch:
        more, rounds = field_spans(texts, base, model)
        out: list[list] = [[] for _ in _OUT]
        for i, own, extra, turns in zip(ids, base, more, rounds, strict=True):
            counts = [sum(k == n for _, k, _ in own) for n in range(len(KINDS))]
            every = sorted([*own, *((a, k + len(KINDS), b) for a, k, b in extra)])
            for column, value in zip(out, (i, *counts, hashlib.sha256(_joined(own).encode()).hexdigest(), _joined(every), len(extra), turns), strict=True):
                column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, _OUT, strict=True)], schema=_OUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, base, size = [], [], [], 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                ids.append(i)
                texts.append(text)
                base.append(base_spans(text))
                size += len(text)
                if size >= 32 * NODES or len(ids) >= 1024:
                    yield done(ids, texts, base)
                    ids, texts, base, size = [], [], [], 0
        if ids:
            yield done(ids, texts, base)

    return run


_MODEL = pa.schema([("name", pa.string()), ("rows", pa.int32()), ("cells", pa.binary())])


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model = train([t or "" for batch in batches for t in batch.column(0).to_pylist()])
    yield pa.RecordBatch.from_arrays([pa.array(list(model)), pa.array([len(m) for m in model.values()], pa.int32()), pa.array([m.astype("<f8").tobytes() for m in model.values()], pa.binary())], schema=_MODEL)


def personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_docs: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_crf, crf_rounds of every text."""
    bounded_batches(df)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rate = min(1.0, 4 * train_docs / max(1, rows.count()))  # tasks then hold back all but a few candidates
    few = rows.filter(unit_hash(F.col("doc_id")) < rate).orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(train_docs)
    found = few.select("text").coalesce(1).mapInArrow(frugal(_trained), "name string, rows int, cells binary").collect()
    model = {r["name"]: np.frombuffer(r["cells"], "<f8").reshape(r["rows"], LABELS) for r in found}
    return rows.mapInArrow(frugal(_scan(model or train([]))), _DDL)
