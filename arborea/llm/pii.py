"""Personal data by weak supervision.

Candidates are the spans of fixed base patterns, the matches of these patterns that fail a check, and those of wider patterns: spelled-out
mail addresses, six-group addresses of hosts, numbers without a leading ``+``, cards of 13 to 15 digits or with dots.
Labelers vote on each candidate, for (1), against (-1) or not at all (0):

* *form*: the base pattern holds, or only a wider one;
* *check*: the kind's own check holds (Luhn, byte range, number of digits, a plausible domain);
* *gazetteer*: the top-level domain, country code, card prefix or address block is a known one;
* *cue* and *counter-cue*: words shortly before it that announce such data, or something else (versions, sections);
* *border*: it stands apart from letters, digits and number signs.

Votes and context are counted over all candidates of the corpus. Expectation-maximisation over these counts estimates for each labeler how it
votes on true and on false candidates, and each vote pattern's probability. A logistic span classifier is then trained on these
probabilities over votes and context (``CONTEXT``: number of digits and of separators, what lies on either side), and decides on all but
the base candidates. Base spans always stay.

What travels is one row a kind, vote pattern and context: at most 4 * 2^3 * 3 * 2^2 * 6 * 4 * 4^2, whatever the corpus.

Defined cases: a null text counts as empty and has no span; of other candidates that overlap a base span or each other
the base one or the earlier one stays; texts of any length are read whole, in time linear in the text; repeated rows each get a row;
a null doc_id stays null; other columns, whatever their names, are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bounded_batches

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("form", "check", "gazetteer", "cue", "counter", "border")
CONTEXT = ("digits", "separators", "left", "right")
#: Probability from which a candidate that is no base span counts.
ACCEPT = 0.95

_LOCAL = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-"
_DIGIT = re.compile("[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match begins where a run of digits does, and takes runs whole: linear in the text
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WIDE = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:[\[(]dot[\])]|\.) ?[A-Za-z0-9-]{1,63}){1,4}"),
    "ip": re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"),
    "card": re.compile(r"(?<![0-9.])(?:[0-9]{4}(?:[._/][0-9]{4}){3}|3[0-9]{3}[ -]?[0-9]{6}[ -]?[0-9]{4,5}|[0-9]{13,15})(?![0-9.])"),
    "phone": re.compile(r"(?<![0-9+.-])(?:(?:00|1[ .-])[1-9]?[0-9]{0,2}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"),
}
# fixed values: what labelers know
_TLDS = frozenset("com net org edu gov mil int info biz io co dev app ai uk de fr es it nl eu us ca au in jp cn br mx ch at be se no dk fi pl pt ru".split())
_COUNTRY = ("1", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "61", "64", "81", "82", "86", "90", "91", "351", "352", "353", "358", "420")
_CUES = {
    "email": ("mail", "contact", "write to", "reach", "contacto", "correo", "courriel", "kontakt"),
    "ip": ("ip", "host", "server", "address", "addr", "from", "client", "adresse"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "cell", "whatsapp", "telefon", "movil", "appel"),
}
_COUNTER = ("version", "release", "section", "isbn", "issn", "order", "invoice", "build", "figure", "table", "chapter", "§", "part no")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str):
    end = seen = 0
    at = text.find("@")
    while at >= 0:
        begin = max(end, seen)
        local = begin + len(text[begin:at].rstrip(_LOCAL))
        found = _DOMAIN.match(text, at + 1) if local < at else None
        if found:
            end = found.end()
            yield local, end
        seen = at + 1
        at = text.find("@", max(seen, end))


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _ip_bytes(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in s.split("."))


def _matches(text: str):
    """kind, start, end of every match of a base pattern with a plausible number of digits, and whether its check holds; by kind as listed."""
    for a, b in _emails(text):
        yield "email", a, b, True
    if not _DIGIT.search(text):
        return
    for m in _IP.finditer(text):
        yield "ip", *m.span(), _ip_bytes(m[0])
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 16 <= len(d) <= 19:
            yield "card", *m.span(), luhn(d)
    for m in _PHONE.finditer(text):
        yield "phone", *m.span(), 8 <= len(_digits(m[0])) <= 15


def _wider(text: str):
    if "at" in text and ("[" in text or "(" in text):
        yield from ((*m.span(), "email") for m in _WIDE["email"].finditer(text))
    if _DIGIT.search(text):
        yield from ((*m.span(), kind) for kind in ("card", "phone") for m in _WIDE[kind].finditer(text))
    if text.count(":") > 6:
        yield from ((*m.span(), "ip") for m in _WIDE["ip"].finditer(text))


def candidates(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans by kind as listed, then start; and all other candidates in order: what fails a base check, and what only a wider pattern finds."""
    found = list(_matches(text))
    base = [x[:3] for x in found if x[3]]
    known, taken, others = {x[1:] for x in base}, sorted(x[1:] for x in base), []
    more = [(a, b, kind) for kind, a, b, ok in found if not ok and (a, b) not in known] + list(_wider(text))
    end = at = 0
    for a, b, kind in sorted(more):
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        if a >= end and not (at < len(taken) and taken[at][0] < b):
            others.append((kind, a, b))
            end = b
    return base, others


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """kind, start, end of every base span, by kind as listed, then start; time linear in the text."""
    return [x[:3] for x in _matches(text) if x[3]]


def votes(text: str, kind: str, a: int, b: int, base: bool) -> tuple[int, ...]:
    """Of each labeler, then the context."""
    span, before = text[a:b], text[max(0, a - 48) : a].lower()
    d = _digits(span)
    if kind == "email":
        domain = span.rpartition("@")[2] if "@" in span else re.split(r"[\[(]at[\])]", span)[-1]
        last = re.split(r"[. \])]+", domain.strip())[-1].lower()
        form, check, known = "@" in span, last.isalpha() and len(last) > 1, last in _TLDS
    elif kind == "phone":
        form, check = span[:1] == "+", 8 <= len(d) <= 15
        known = d.removeprefix("00").startswith(_COUNTRY) if form or d[:2] == "00" else len(d) == 10 and d[0] not in "01"
    elif kind == "card":
        form, check, known = 16 <= len(d) <= 19 and "." not in span, luhn(d), d[0] in "3456"
    else:
        form, check = "." in span, ":" in span or _ip_bytes(span)
        known = not span.startswith(("0", "127.", "255.", "::"))
    side = lambda c: 0 if not c or c.isspace() else 1 if c.isalnum() else 2 if c in "+-./:_#" else 3
    left, right = side(text[a - 1 : a]), side(text[b : b + 1])
    apart = left in (0, 3) and (right in (0, 3) or text[b : b + 2] in (". ", ".\n", "."))
    cast = (1 if form else -1, 1 if check else -1, 1 if known else -1, int(any(c in before for c in _CUES[kind])), -int(any(c in before for c in _COUNTER)), 1 if apart else -1)
    return *cast, min(5, len(d) // 4), min(3, sum(not c.isalnum() for c in span) // 2), left, right


@dataclass
class SpanModel:
    """The classifier's weights by kind; of each labeler how often it votes for, against or not at all on true and on false candidates."""

    weights: dict[str, list[float]] = field(default_factory=dict)
    reliability: dict[str, np.ndarray] = field(default_factory=dict)

    def probability(self, kind: str, v: tuple[int, ...]) -> float:
        w = self.weights.get(kind)
        return 0.0 if w is None else float(1 / (1 + np.exp(-np.clip(_inputs(np.array([v]))[0] @ w, -50, 50))))


def _inputs(v: np.ndarray) -> np.ndarray:
    """Inputs of the classifier: a constant, the votes, the context's values one by one."""
    n = len(LABELERS)
    hot = [(v[:, n + i, None] == np.arange(size)) for i, size in enumerate((6, 4, 4, 4))]
    return np.concatenate([np.ones((len(v), 1)), v[:, :n], *hot], axis=1).astype(float)


def estimate(counts: list[tuple[str, tuple[int, ...], int]], rounds: int = 100) -> SpanModel:
    """Expectation-maximisation over vote patterns, then the classifier, for each kind."""
    model = SpanModel()
    for kind in KINDS:
        rows = [(v, n) for k, v, n in counts if k == kind]
        if not rows:
            continue
        v, n = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
        cast = v[:, : len(LABELERS)]
        p = 1 / (1 + np.exp(-1.5 * (cast.sum(1) + 0.0)))  # begins with the majority
        # beforehand a labeler is taken to be right three times in four, as if ten candidates of each side had been seen
        before = np.array([[1.0, 1.5, 7.5], [7.5, 1.5, 1.0]])
        for _ in range(rounds):
            prior = np.clip(((p * n).sum() + 1) / (n.sum() + 2), 0.01, 0.99)
            logit, table = np.full(len(v), np.log(prior / (1 - prior))), np.zeros((2, len(LABELERS), 3))
            for j in range(len(LABELERS)):
                for side, share in enumerate((p, 1 - p)):
                    seen = np.array([(n * share)[cast[:, j] == x].sum() for x in (-1, 0, 1)]) + before[side]
                    table[side, j] = seen / seen.sum()
                logit += np.log(table[0, j, cast[:, j] + 1] / table[1, j, cast[:, j] + 1])
            p = 1 / (1 + np.exp(-np.clip(logit, -50, 50)))
        x, m = _inputs(v), n / n.sum()
        w = np.zeros(x.shape[1])
        for _ in range(60):
            q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (m * q * (1 - q))[:, None]).T @ x + 1e-3 * np.eye(x.shape[1]), x.T @ (m * (p - q)) - 1e-3 * w)
            w += step
            if np.abs(step).max() < 1e-9:
                break
        model.weights[kind], model.reliability[kind] = w.tolist(), table
    return model


def vote_counts(docs: DataFrame, text: str = "text") -> list[tuple[str, tuple[int, ...], int]]:
    """How often each vote pattern with its context occurs over all candidates of the corpus."""
    schema = pa.schema([("kind", pa.string()), *((x, pa.int32()) for x in LABELERS + CONTEXT), ("n", pa.int64())])

    def run(batches):
        counts: dict = {}
        for batch in batches:
            for t in batch.column(0):
                s = t.as_py() or ""
                base, others = candidates(s)
                for is_base, spans in ((True, base), (False, others)):
                    for kind, a, b in spans:
                        key = (kind, *votes(s, kind, a, b, is_base))
                        counts[key] = counts.get(key, 0) + 1
        rows = [(*k, n) for k, n in counts.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    bounded_batches(docs)
    found = docs.select(F.col(text).alias("text")).mapInArrow(run, "kind string, " + ", ".join(f"{x} int" for x in LABELERS + CONTEXT) + ", n long")
    rows = found.groupBy("kind", *LABELERS, *CONTEXT).agg(F.sum("n").alias("n")).collect()  # one row a pattern and context
    return sorted((r[0], tuple(r[1:-1]), r[-1]) for r in rows)


def find_spans(text: str, model: SpanModel) -> tuple[list, list]:
    """Base spans, and all spans, by kind as listed, then start."""
    base, others = candidates(text)
    more = [s for s in others if model.probability(s[0], votes(text, *s, False)) >= ACCEPT]
    return base, sorted(base + more, key=lambda s: (KINDS.index(s[0]), s[1])) if more else base


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind; overlapping spans are replaced as one."""
    out, at, hold = [], 0, None
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if hold and a < hold[2]:
            hold[2] = max(hold[2], b)
            continue
        if hold:
            out += [text[at : hold[1]], f"[{hold[0].upper()}]"]
            at = hold[2]
        hold = [kind, a, b]
    if hold:
        out += [text[at : hold[1]], f"[{hold[0].upper()}]"]
        at = hold[2]
    return "".join(out) + text[at:]


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: SpanModel | None = None) -> DataFrame:
    """doc_id, the number of base spans of each kind, base_sha256 and spans for every row."""
    model = model or estimate(vote_counts(docs, text))
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])

    def run(batches):
        for batch in batches:
            rows = []
            for key, t in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                base, spans = find_spans(t.as_py() or "", model)
                rows.append((key, *(sum(s[0] == k for s in base) for k in KINDS), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return src.mapInArrow(run, "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")


def redacted(model: SpanModel):
    """A column function of the text that replaces all its spans."""

    def run(texts):
        return texts.map(lambda t: t if t is None else redact(t, find_spans(t, model)[1]))

    return F.pandas_udf(run, "string")
