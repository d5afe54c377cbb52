"""Personal data: patterns, and a skip-chain conditional random field that adds to them.

Tokens that hold a digit or ``@`` are the nodes of a graph; all others are outside of any
entity. Neighbouring nodes share a potential (the chain). All nodes of one document that are
equal or alike in some form share a hub, to which each has a skip edge, so that a clear
mention is two edges away from every other one. Marginals come from loopy message passing
over the whole graph of a batch, until the messages no longer change.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.samples import sample_texts
from trackloom.llm.words import SEED

# The base patterns, as given. Digit runs are entered at their first digit only and never
# given up again, which finds the same matches in linear time.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
# Bounds of the training sample, and the belief that adds a span.
TRAINING_ROWS, TRAINING_CHARS, DRAWN = 2000, 4000, 60
BELIEF = 0.9
# Messages of a document stop when none changes by more than this. A graph with loops need
# not come to rest: the rounds after which it is left as it is.
SETTLED, ROUNDS = 1e-7, 2000
SPAN = "array<struct<kind:string,start:long,end:long,base:boolean>>"
EDGE = ".,;:!?\"'<>[]{}"


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2])
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each ``@``: a local part ends at one."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in LOCAL:
            begin -= 1
        match = DOMAIN.match(text, at) if begin < at else None
        free = match.end() if match else at + 1
        if match:
            found.append((begin, match.end()))
        at = text.find("@", free)
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the patterns, by kind as listed and then by start."""
    found = [("email", s, e) for s, e in _emails(text)]
    found += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(map(_small, m.groups()))]
    for m in CARD.finditer(text):
        digits = re.sub("[ -]", "", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
            found.append(("phone", m.start(), m.end()))
    return found


def _features(token: str, before: str, after: str) -> list[float]:
    core = token.strip(EDGE)
    digits = re.sub(r"[^0-9]", "", core)
    n = len(digits)
    parts = core.split(".")
    dotted = len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts)
    letters = any(c.isalpha() for c in core)
    bands = [lo <= n <= hi for lo, hi in ((0, 0), (1, 2), (3, 4), (5, 8), (9, 12), (13, 19))]
    cue = before.strip(EDGE).lower()
    return [float(x) for x in (
        True, "@" in core, "@" in core and bool(_emails(core)), dotted, dotted and all(map(_small, parts)),
        *bands, n > 19, core.startswith("+"), "(" in core, "-" in core, letters, n == len(core) > 0,
        13 <= n <= 19 and not letters and luhn(digits), before.startswith("+"), before.startswith("("),
        after[:1].isdigit(), cue in ("mail", "email", "e-mail"), cue in ("tel", "phone", "call", "mobile"),
        cue in ("ip", "host", "address"), cue in ("card", "visa", "account"))]


FEATURES = len(_features("1", "", ""))


class Graph:
    """Nodes and edges of some documents; a skip edge joins a node and a hub."""

    def __init__(self, texts: list[str]):
        self.text, self.start, self.end, self.x = [], [], [], []
        self.chain, self.skip, self.hubs = [], [], 0
        for number, text in enumerate(texts):
            self._add(number, text)
        self.x = np.array(self.x, float).reshape(-1, FEATURES)

    def _add(self, number: int, text: str) -> None:
        tokens = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
        alike: dict[str, list[int]] = {}
        previous, chained = -2, len(self.chain)
        for k, (start, end) in enumerate(tokens):
            token = text[start:end]
            if "@" not in token and not re.search("[0-9]", token):
                continue
            near = [text[slice(*tokens[j])] if 0 <= j < len(tokens) else "" for j in (k - 1, k + 1)]
            node = len(self.text)
            self.text.append(number)
            self.start.append(start)
            self.end.append(end)
            self.x.append(_features(token, *near))
            if previous == k - 1:
                self.chain.append((node - 1, node))
            previous = k
            core = re.sub(r"[\W_]", "", token.lower())
            digits = re.sub("[^0-9]", "", token)
            for form in {core, token.lower().split("@")[0] if "@" in token else "", digits[-7:] if len(digits) >= 7 else ""}:
                if form:
                    alike.setdefault(form, []).append(node)
        # Forms of the same nodes share a hub; two neighbours have their chain edge.
        joined = set(self.chain[chained:])
        for nodes in dict.fromkeys(map(tuple, alike.values())):
            if len(nodes) > 2 or (len(nodes) == 2 and nodes not in joined):
                self.skip += [(node, self.hubs) for node in nodes]
                self.hubs += 1


def _sums(index: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(index, column, n) for column in values.T], 1)


class SkipChain:
    """Weights of features (unary), of neighbours (chain) and of a token and its hub (skip)."""

    def __init__(self, unary: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.unary, self.chain, self.skip = unary, chain, skip

    def marginals(self, graph: Graph) -> np.ndarray:
        """Beliefs of every label at every token after the sum-product messages have settled."""
        n = len(graph.text)
        local = np.zeros((n + graph.hubs, len(LABELS)))
        local[:n] = graph.x @ self.unary
        pairs = np.array(graph.chain + [(node, n + hub) for node, hub in graph.skip], int).reshape(-1, 2)
        # Both directions of every edge; message e goes from source[e] to target[e].
        source = np.concatenate([pairs[:, 0], pairs[:, 1]])
        target = np.concatenate([pairs[:, 1], pairs[:, 0]])
        back = np.roll(np.arange(len(source)), len(pairs))
        kind = np.repeat([0, 1, 2, 3], [len(graph.chain), len(graph.skip)] * 2)
        tables = [self.chain, self.skip, self.chain.T, self.skip.T]
        tables = np.array([np.exp(t - t.max()) for t in tables])
        document = np.array(graph.text, int)[np.concatenate([pairs[:, 0]] * 2)]
        sent = np.full((len(source), len(LABELS)), -np.log(len(LABELS)))
        # Edges of documents that have not settled, with their ends numbered anew.
        live, here = np.arange(len(source)), None
        for _ in range(ROUNDS):
            if here is None:
                if not len(live):
                    break
                nodes, ends = np.unique(np.concatenate([source[live], target[live]]), return_inverse=True)
                here, there = ends[:len(live)], ends[len(live):]
                opposite = np.searchsorted(live, back[live])
                bounds = np.searchsorted(kind[live], range(5))
                now, start = sent[live], local[nodes]
            given = (start + _sums(there, now, len(nodes)))[here] - now[opposite]
            given = np.exp(given - given.max(1, keepdims=True))
            fresh = np.concatenate([given[a:b] @ t for t, a, b in zip(tables, bounds, bounds[1:])])
            fresh = 0.5 * now + 0.5 * np.log(fresh / fresh.sum(1, keepdims=True))
            change = np.abs(fresh - now).max(1)
            now = fresh
            moving = np.unique(document[live[change > SETTLED]])
            stay = np.isin(document[live], moving)
            if stay.sum() <= 0.7 * len(live):
                sent[live] = now
                live, here = live[stay], None
        else:
            sent[live] = now
        belief = (local + _sums(target, sent, len(local)))[:n]
        return np.exp(belief - np.logaddexp.reduce(belief, axis=1, keepdims=True))

    def spans(self, texts: list[str]) -> list[list[tuple[str, int, int, bool]]]:
        """All spans of each text: the patterns' and those that the field adds."""
        graph = Graph(texts)
        base = [base_spans(text) for text in texts]
        out = [[(*span, True) for span in spans] for spans in base]
        if len(graph.text):
            belief = self.marginals(graph)
            label, sure = belief.argmax(1), belief.max(1) >= BELIEF
            linked = {b for _, b in graph.chain}
            open_span = None
            for node, (k, start, end) in enumerate(zip(graph.text, graph.start, graph.end)):
                known = any(s < end and start < e for _, s, e in base[k])
                if not sure[node] or not label[node] or known:
                    open_span = None
                elif open_span and open_span[0] == (k, label[node]) and node in linked:
                    open_span[2] = end
                else:
                    open_span = [(k, label[node]), start, end]
                    out[k].append(open_span)
        return [sorted((_closed(s, texts[k]) for s in spans), key=lambda s: (KINDS.index(s[0]), s[1]))
                for k, spans in enumerate(out)]


def _closed(span, text: str) -> tuple[str, int, int, bool]:
    if isinstance(span, tuple):
        return span
    (_, label), start, end = span
    token = text[start:end]
    lead = len(token) - len(token.lstrip(EDGE))
    return LABELS[label], start + lead, start + lead + len(token.strip(EDGE)), False


def _drawn() -> list[str]:
    """Labelled sentences around drawn numbers and names, so that no kind lacks samples."""
    generator = np.random.default_rng(SEED)

    def digits(n: int) -> str:
        return "".join(map(str, generator.integers(0, 10, n)))

    texts = []
    for k in range(DRAWN):
        card = digits(15)
        card += next(d for d in "0123456789" if luhn(card + d))
        parts = ".".join(map(str, generator.integers(1, 255, 4)))
        texts += [f"mail user{digits(2)}@host{k}.example.org or call +{digits(1)} ({digits(3)}) {digits(3)}-{digits(4)} now",
                  f"the host {parts} and card {card} in {digits(4)} and order {digits(6)}",
                  f"version {digits(1)}.{digits(1)} of {digits(2)} items, row {digits(3)}, total {digits(5)}.{digits(2)}",
                  f"card {card[:4]} {card[4:8]} {card[8:12]} {card[12:]} from +{digits(11)} at {parts}"]
    return texts


def fit(texts: list[str], rounds: int = 300) -> SkipChain:
    """Fit by pseudo-likelihood: each label given its features and its neighbours' labels.

    The labels are those of the base patterns. A hub counts, for each of its nodes, as the
    mean label of its other nodes.
    """
    graph = Graph(texts + _drawn())
    base = [base_spans(text) for text in texts + _drawn()]
    label = np.array([
        next((LABELS.index(kind) for kind, s, e in base[k] if s < end and start < e), 0)
        for k, start, end in zip(graph.text, graph.start, graph.end)])
    n, size = len(label), len(LABELS)
    hot = np.eye(size)[label]

    def seen(pairs: list, way: int) -> np.ndarray:
        out = np.zeros((n, size))
        if pairs:
            pair = np.array(pairs)
            np.add.at(out, pair[:, 1 - way], hot[pair[:, way]])
        return out

    node, hub = np.array(graph.skip, int).reshape(-1, 2).T
    others = _sums(hub, hot[node], graph.hubs)[hub] - hot[node]
    others /= np.maximum(others.sum(1, keepdims=True), 1)
    inputs = [graph.x, seen(graph.chain, 0), seen(graph.chain, 1), _sums(node, others, n)]
    unary, chain, skip = np.zeros((FEATURES, size)), np.zeros((size, size)), np.zeros((size, size))
    rate = 2.0
    for _ in range(rounds):
        score = inputs[0] @ unary + inputs[1] @ chain + inputs[2] @ chain.T + inputs[3] @ skip.T
        off = hot - np.exp(score - np.logaddexp.reduce(score, axis=1, keepdims=True))
        unary += rate * (inputs[0].T @ off / n - 1e-4 * unary)
        chain += rate * ((inputs[1].T @ off + off.T @ inputs[2]) / n - 1e-4 * chain)
        skip += rate * (off.T @ inputs[3] / n - 1e-4 * skip)
    return SkipChain(unary, chain, skip)


def _finder(model: SkipChain):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()),
                                    ("end", pa.int64()), ("base", pa.bool_())]))
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows = []
            for begin in range(0, len(texts), 500):
                for spans in model.spans(texts[begin:begin + 500]):
                    rows.append([dict(kind=k, start=s, end=e, base=b) for k, s, e, b in spans])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(rows, kinds)], names=["key", "spans"])

    return find


def _eligible(text_column: str):
    """Every kind has a digit or an ``@``, so other texts need not leave the JVM."""
    return F.col(text_column).rlike("[0-9@]")


def pii_model(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> SkipChain:
    """The field, fitted on a bounded sample (about TRAINING_ROWS texts with a digit or @)."""
    return fit(sample_texts(docs.filter(_eligible(text_column)), id_column, text_column,
                            TRAINING_ROWS, TRAINING_CHARS))


def find_personal_data(
    docs: DataFrame, model: SkipChain | None = None, id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """One row (id, spans) for each row of ``docs``.

    ``spans`` are structs (kind, start, end, base) in code points, end exclusive, by kind
    (email, ip, card, phone) and then start. Matches of the patterns have base true; the
    field adds runs of tokens that overlap none of them and that it believes in.

    Null and empty texts have no spans; a null id stays null; an empty table gives an
    empty result; other columns are ignored. Each row is judged on its own whole text.
    """
    model = model or pii_model(docs, id_column, text_column)
    kind = dict(docs.select(id_column).dtypes)[id_column]
    text = F.when(_eligible(text_column), F.col(text_column))
    return docs.select(F.col(id_column).alias("key"), text.alias("text")).mapInArrow(
        _finder(model), f"key {kind}, spans {SPAN}").withColumnRenamed("key", id_column)
