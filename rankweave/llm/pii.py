"""Personal data: patterns, and a linear-chain conditional random field that adds what they miss.

The field labels words as email, ip, card, phone or none, from word-shape
features of the word and its neighbours. It is trained on a small labelled
table made by `training_table`, by gradient ascent on the exact conditional
likelihood, in numpy. Texts are decoded by Viterbi in batches. A word whose
score for "none" leads by more than any transition can make up is "none" on the
best path whatever surrounds it; such words cut a text into short runs, and
only the runs are decoded, padded to one array. The result is the same as
decoding the whole text.

Spans found by the patterns stay; spans of the field that overlap one of them,
or do not look like their kind (see `plausible`), are left out.

Defined cases: a null or empty text has no spans; a text of any length is
searched whole; equal rows are treated alike;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rankweave.llm.shared import WORD, table

KINDS = ("email", "ip", "card", "phone")
DIGIT = re.compile("[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for place, d in enumerate(reversed(digits)):
        n = int(d) * (1 + place % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of the patterns, leftmost and non-overlapping within a kind, in time linear in the text.

    Emails are sought from each @ outwards, and chains of numbers in fours:
    the same matches as scanning for the pattern, without trying each start.
    """
    found: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        match = DOMAIN.match(text, at + 1) if start < at else None
        if match:
            end = match.end()
            found.append((0, start, end))
        else:
            end = max(end, at + 1)
        at = text.find("@", max(end, at + 1))
    if not DIGIT.search(text):
        return found
    if "." in text:
        for chain in CHAIN.finditer(text):
            parts = list(DIGIT_RUN.finditer(text, chain.start(), chain.end()))
            for low in range(0, len(parts) - 3, 4):
                if all(int(p[0].lstrip("0")[:4] or 0) <= 255 for p in parts[low : low + 4]):
                    found.append((1, parts[low].start(), parts[low + 3].end()))
    for match in CARD.finditer(text):
        if match.end() - match.start() >= 16:
            digits = match[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append((2, match.start(), match.end()))
    if "+" in text:
        for match in PHONE.finditer(text):
            if 8 <= len(DIGIT.findall(match[0])) <= 15:
                found.append((3, match.start(), match.end()))
    return found


DIGIT_RUN = re.compile("[0-9]+")

# Words that tell the field something.
HINTS = {
    "at": ("at", "(at)", "[at]", "{at}"),
    "dot": ("dot", "(dot)", "[dot]", "{dot}"),
    "top": ("com", "org", "net", "edu", "io", "co", "de", "fr", "es"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telephone", "cell"),
    "mail": ("email", "mail", "e-mail", "contact"),
    "card": ("card", "visa", "mastercard", "credit", "amex"),
    "ip": ("ip", "host", "server", "address"),
}
HINT_OF = {word: name for name, words in HINTS.items() for word in words}
EDGE = ".,;:!?\"'"
PLAIN = ("plain",)


def features(word: str) -> tuple[str, ...]:
    """Word-shape features; their tuple is all that the field sees of a word."""
    bare = word.strip(EDGE)
    low = bare.lower()
    if bare.isalpha() and low not in HINT_OF:
        return PLAIN
    shape = re.sub("[0-9]+", "9", re.sub("[A-Z]", "X", re.sub("[a-zß-ɏ]", "x", bare)))
    shape = re.sub(r"(.)\1+", r"\1", shape)[:12]
    digits = len(DIGIT.findall(bare))
    runs = [len(r) for r in DIGIT_RUN.findall(bare)][:5]
    hint = HINT_OF.get(low.strip("()[]{}") if low not in HINT_OF else low, "")
    if not digits and not hint and "@" not in bare and ":" not in bare and not ("." in bare and bare.isascii()):
        return PLAIN
    found = [f"shape={shape}", f"digits={min(digits, 20)}", "runs=" + "-".join(map(str, runs)), f"hint={hint}"]
    found += [name for name, mark in (("has@", "@"), ("has+", "+"), ("has(", "("), ("has.", "."), ("has-", "-"), ("has:", ":")) if mark in bare]
    if hint:
        found.append(f"brackets={bare[:1] in '([{'}")
    return tuple(found)


def training_table() -> list[tuple[list[str], list[int]]]:
    """Labelled word sequences: 0 for none, 1 + index in KINDS otherwise. Made by rule, the same each time."""
    rng = np.random.default_rng(7)
    names = ["anna", "john.doe", "k.lee", "info", "maria", "sales", "peter9", "team"]
    hosts = ["example", "mail", "acme", "uni-test", "web", "corp"]
    filler = "the of and a to in is was for on that with as by we you send please write number code page section total see it Der la los und est".split()
    number = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    pick = lambda items: items[int(rng.integers(len(items)))]

    def some() -> list[tuple[str, int]]:
        return [(pick(filler), 0) for _ in range(int(rng.integers(0, 5)))]

    def email() -> list[tuple[str, int]]:
        at, dot = pick([("[at]", "[dot]"), ("(at)", "(dot)"), ("at", "dot"), ("{at}", "{dot}")])
        return [(pick(["", "email", "mail:", "contact"]) or "mail", 0), (pick(names), 1), (at, 1), (pick(hosts), 1), (dot, 1), (pick(["com", "org", "net"]), 1)]

    def email_joined() -> list[tuple[str, int]]:
        return [(pick(names), 1), (pick(["[at]", "(at)", "{at}"]), 1), (f"{pick(hosts)}.{pick(['com', 'org', 'net'])}", 1)]

    def ip() -> list[tuple[str, int]]:
        groups = [f"{int(rng.integers(1, 65535)):x}" for _ in range(8)]
        return [("ip", 0), (":".join(groups) if rng.random() < 0.5 else ":".join(groups[:3]) + "::" + groups[4], 2)]

    def card() -> list[tuple[str, int]]:
        parts = [number(4) for _ in range(4)]
        return [("card", 0), (pick([".", "/"]).join(parts), 3)]

    def phone() -> list[tuple[str, int]]:
        form = pick(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}"]).format(number(3), number(3), number(4))
        return [(pick(["call", "phone", "tel:", "mobile"]), 0), *((w, 4) for w in form.split())]

    def other() -> list[tuple[str, int]]:
        return pick(
            [
                [(pick(filler), 0), ("at", 0), (pick(filler), 0)],
                [("dot", 0), (pick(filler), 0)],
                [(number(int(rng.integers(1, 8))), 0)],
                [(f"{number(4)}-{number(2)}-{number(2)}", 0)],
                [(f"{number(1)}.{number(2)}", 0)],
                [(f"{number(2)}:{number(2)}", 0)],
                [(f"{pick(filler)}.", 0)],
                [(number(int(rng.integers(12, 24))), 0)],
                [("card", 0), (number(3), 0)],
                [("call", 0), (number(2), 0)],
                [("at", 0), (number(2) + ":" + number(2), 0)],
                [(pick(filler) + "." + pick(filler), 0)],
            ]
        )

    made = []
    for k in range(600):
        middle = (email, email_joined, ip, card, phone, other, other, other)[k % 8]()
        row = [*some(), *middle, *some()]
        made.append(([w for w, _ in row], [y for _, y in row]))
    return made


class Field:
    """Linear-chain conditional random field: weights for the word, the one before and the one after, and transitions."""

    LABELS = 1 + len(KINDS)

    def __init__(self, rows: list[tuple[list[str], list[int]]], steps: int = 120, rate: float = 0.15, decay: float = 2e-3):
        self.names: dict[str, int] = {}
        coded = [[[self.names.setdefault(f, len(self.names)) for f in features(w)] for w in words] for words, _ in rows]
        n, width, longest = len(rows), len(self.names), max(len(words) for words, _ in rows)
        seen = np.zeros((n, longest + 2, width))
        mask, gold = np.zeros((n, longest), bool), np.zeros((n, longest), np.int64)
        for i, (words, labels) in enumerate(rows):
            mask[i, : len(words)], gold[i, : len(words)] = True, labels
            for t, ids in enumerate(coded[i]):
                seen[i, t + 1, ids] = 1
        inputs = np.concatenate([seen[:, 1:-1], seen[:, :-2], seen[:, 2:]], axis=2)
        truth = np.eye(self.LABELS)[gold] * mask[..., None]
        self.weights, self.moves = np.zeros((3 * width, self.LABELS)), np.zeros((self.LABELS, self.LABELS))
        state = [[np.zeros_like(x), np.zeros_like(x)] for x in (self.weights, self.moves)]
        flat = inputs.reshape(-1, 3 * width)
        for step in range(1, steps + 1):
            marginal, pairs = self._expected(inputs @ self.weights, mask)
            gold_pairs = np.einsum("nta,ntb->ab", truth[:, :-1], truth[:, 1:])
            slopes = (flat.T @ (truth - marginal).reshape(-1, self.LABELS) - decay * n * self.weights, gold_pairs - pairs - decay * n * self.moves)
            for value, slope, (first, second) in zip((self.weights, self.moves), slopes, state):  # Adam
                first += 0.1 * (slope / n - first)
                second += 0.01 * ((slope / n) ** 2 - second)
                value += rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        self._settle()

    def _expected(self, scores: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Label marginals of each word and expected transitions, by the forward-backward recursion."""
        n, longest, labels = scores.shape
        moves = np.exp(self.moves)
        local = np.exp(scores - scores.max(axis=2, keepdims=True)) * mask[..., None]
        ahead, back = np.zeros_like(local), np.zeros_like(local)
        ahead[:, 0] = local[:, 0] / local[:, 0].sum(axis=1, keepdims=True)
        for t in range(1, longest):
            ahead[:, t] = (ahead[:, t - 1] @ moves) * local[:, t]
            ahead[:, t] /= np.maximum(ahead[:, t].sum(axis=1, keepdims=True), 1e-300)
        last = mask & ~np.pad(mask[:, 1:], ((0, 0), (0, 1)))
        pairs = np.zeros((labels, labels))
        for t in range(longest - 1, -1, -1):
            if t + 1 < longest:
                onward = local[:, t + 1] * back[:, t + 1]
                back[:, t] = onward @ moves.T
                joint = ahead[:, t, :, None] * moves * onward[:, None, :]
                norm = joint.sum(axis=(1, 2))
                pairs += (joint[norm > 0] / norm[norm > 0, None, None]).sum(axis=0)
            back[last[:, t], t] = 1
            back[:, t] /= np.maximum(back[:, t].sum(axis=1, keepdims=True), 1e-300)
        marginal = ahead * back
        return marginal / np.maximum(marginal.sum(axis=2, keepdims=True), 1e-300), pairs

    def _settle(self) -> None:
        """Scores by feature tuple, and the lead with which "none" wins a word against any neighbours."""
        self.width = len(self.names)
        self.tables: list[np.ndarray] = [np.zeros((1, self.LABELS)) for _ in range(3)]
        self.number: dict[tuple[str, ...] | None, int] = {None: 0}
        self.met: dict[bytes, int] = {}
        self.name = hashlib.sha256(self.weights.tobytes() + self.moves.tobytes()).hexdigest()
        gain = self.moves - self.moves[:, :1]
        into, out = gain[:, 1:].max(axis=0), (self.moves - self.moves[:1, :])[1:].max(axis=1)
        self.lead = into + out

    def key(self, found: tuple[str, ...]) -> int:
        """Row of the tables for a feature tuple; features that training has not seen count nothing."""
        if found not in self.number:
            ids = [self.names[f] for f in found if f in self.names]
            for k in range(3):
                part = self.weights[k * self.width : (k + 1) * self.width]
                self.tables[k] = np.vstack([self.tables[k], part[ids].sum(axis=0)])
            self.number[found] = len(self.number)
        return self.number[found]

    def decode(self, keys: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Labels of words given by keys; first marks the first word of each text."""
        none = np.zeros(1, keys.dtype)
        before = np.where(first, 0, np.concatenate([none, keys[:-1]]))
        last = np.concatenate([first[1:], [True]])
        after = np.where(last, 0, np.concatenate([keys[1:], none]))
        labels = np.zeros(len(keys), np.int8)
        own, left, right = self.tables
        # a bound on each key alone finds most words that are "none"
        bound = own[:, :1] - own[:, 1:] - self.lead + (left[:, :1] - left[:, 1:]).min(axis=0) + (right[:, :1] - right[:, 1:]).min(axis=0)
        open_ = np.flatnonzero(bound.min(axis=1)[keys] <= 0)
        if not len(open_):
            return labels
        scores = own[keys[open_]] + left[before[open_]] + right[after[open_]]
        stay = (scores[:, :1] - scores[:, 1:] - self.lead).min(axis=1) <= 0
        open_, scores = open_[stay], scores[stay]
        if not len(open_):
            return labels
        starts = np.flatnonzero(np.concatenate([[True], (np.diff(open_) > 1) | first[open_[1:]]]))
        sizes = np.diff(np.append(starts, len(open_)))
        for low, high in ((0, 8), (8, 64), (64, 1 << 62)):
            chosen = np.flatnonzero((sizes > low) & (sizes <= high))
            for at in range(0, len(chosen), 4096):
                some = chosen[at : at + 4096]
                self._viterbi(scores, starts[some], sizes[some], open_, first, last, labels)
        return labels

    def _viterbi(self, scores, starts, sizes, at, first, last, labels) -> None:
        n, longest = len(starts), int(sizes.max())
        inside = np.arange(longest) < sizes[:, None]
        place = np.where(inside, starts[:, None] + np.arange(longest), 0)
        best = scores[place[:, 0]] + np.where(first[at[place[:, 0]]][:, None], 0, self.moves[0])
        back = np.zeros((longest, n, self.LABELS), np.int8)
        for t in range(1, longest):
            paths = best[:, :, None] + self.moves
            back[t] = paths.argmax(axis=1)
            best = np.where(inside[:, t, None], paths.max(axis=1) + scores[place[:, t]], best)
        end = at[starts + sizes - 1]
        now = (best + np.where(last[end][:, None], 0, self.moves[:, 0])).argmax(axis=1)
        for t in range(longest - 1, -1, -1):
            here = inside[:, t]
            labels[at[place[here, t]]] = now[here]
            if t:
                now = np.where(here, back[t][np.arange(n), now], now)


@lru_cache(maxsize=1)
def trained_field() -> Field:
    return Field(training_table())


def plausible(kind: int, text: str) -> bool:
    """Whether a span of the field looks like its kind at all."""
    digits = len(DIGIT.findall(text))
    low = " ".join(text.lower().split())  # white space of any length, in time that grows with the text alone
    if kind == 0:
        return bool(re.search(r"\S\s*[(\[{ ]\s*at\s*[)\]} ]\s*[a-z0-9]", low)) and bool(re.search(r"[a-z0-9](\.|\s*[(\[{ ]\s*dot\s*[)\]} ]\s*)[a-z]{2,}$", low))
    if kind == 1:
        return text.count(":") >= 3 and not re.search("[^0-9A-Fa-f:]", text)
    if kind == 2:
        return 16 <= digits <= 19 and luhn("".join(DIGIT.findall(text))) and not re.search("[A-Za-z]", text)
    return 8 <= digits <= 15 and bool(re.fullmatch(r"\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}", text))


#: Words that a worker keeps with their rows of the field's tables; the fields that it has met.
CACHED_WORDS = 200_000
_fields: dict[str, Field] = {}


def field_spans(texts: list[str], field: Field) -> list[list[Span]]:
    """Spans of the field in each text."""
    field = _fields.setdefault(field.name, field)
    split = [t.encode().split() for t in texts]
    if len(field.met) > CACHED_WORDS:
        field.met.clear()
    for word in set().union(*split) - field.met.keys():
        field.met[word] = field.key(features(word.decode()))
    sizes = np.array([len(words) for words in split], dtype=np.int64)
    keys = np.fromiter((field.met[w] for words in split for w in words), np.int64, int(sizes.sum()))
    first = np.zeros(len(keys), bool)
    starts = np.cumsum(sizes) - sizes
    first[starts[sizes > 0]] = True
    labels = field.decode(keys, first)
    found: list[list[Span]] = [[] for _ in texts]
    for row in np.unique(np.searchsorted(starts + sizes, np.flatnonzero(labels), "right")).tolist():
        text, own = texts[row], labels[starts[row] : starts[row] + sizes[row]]
        places = [m.span() for m in re.finditer(WORD, text)]
        changes = np.flatnonzero(np.diff(own)) + 1
        for low, high in zip([0, *changes.tolist()], [*changes.tolist(), len(own)]):
            if own[low]:
                kind, start, end = int(own[low]) - 1, places[low][0], places[high - 1][1]
                while start < end and text[start] in EDGE:
                    start += 1
                while end > start and text[end - 1] in EDGE:
                    end -= 1
                if plausible(kind, text[start:end]):
                    found[row].append((kind, start, end))
    return found


def find_spans(texts: list[str | None], field: Field) -> list[tuple[list[Span], list[Span]]]:
    """(spans of the patterns, all spans) of each text, by kind and start."""
    whole = [t or "" for t in texts]
    found = []
    for text, more in zip(whole, field_spans(whole, field)):
        base = sorted(base_spans(text))
        taken = sorted((s, e) for _, s, e in base)
        added = [x for x in more if not any(s < x[2] and x[1] < e for s, e in taken)]
        found.append((base, sorted(base + added)))
    return found


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, base counts by kind, sha256 of the base spans, all spans, and how many the field added."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    field = trained_field()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 1000):
                batch = whole.slice(low, 1000)
                found = find_spans(batch.column(1).to_pylist(), field)
                counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in range(len(KINDS))]
                digest = pa.array([hashlib.sha256(listed(base).encode()).hexdigest() for base, _ in found], pa.string())
                spans = pa.array([listed(every) for _, every in found], pa.string())
                added = pa.array([len(every) - len(base) for base, every in found], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digest, spans, added], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {counts}, base_sha256 string, spans string, n_added long")


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans, the kind listed first."""
    out, at = [], 0
    for start, end, kind in sorted((s, e, k) for k, s, e in spans):
        if start >= at:
            out.append(f"{text[at:start]}[{KINDS[kind].upper()}]")
        at = max(at, end)
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """docs with personal data in text replaced, and n_chars, where there is one, counted anew; null texts stay null."""
    field = trained_field()
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 1000):
                batch = whole.slice(low, 1000)
                texts = batch.column(names.index("text")).to_pylist()
                clean = [t if t is None else redacted(t, every) for t, (_, every) in zip(texts, find_spans(texts, field))]
                columns = list(batch.columns)
                columns[names.index("text")] = pa.array(clean, pa.string())
                if "n_chars" in names:
                    at = names.index("n_chars")
                    columns[at] = pa.array([None if t is None else len(t) for t in clean], columns[at].type)
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, docs.schema)


def op4_personal_data(spark, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents"))
