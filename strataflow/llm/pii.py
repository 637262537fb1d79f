"""Personal data: base patterns and a character BiLSTM-CRF trained from spans they label."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_sample
from .frames import map_rows

# The kinds in the order of ties, and their patterns.
KINDS = ("email", "ip", "card", "phone")
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

# A match can only start inside a run of these if the run's start could not, so the search skips there.
RUN_BEFORE = {"email": r"(?<![A-Za-z0-9._%+-])", "ip": r"(?<![0-9])", "card": "", "phone": ""}
PATTERNS = {
    kind: (re.compile(pattern), re.compile(RUN_BEFORE[kind] + pattern))
    for kind, pattern in zip(KINDS, (EMAIL, IP, CARD, PHONE))
}
NEEDED = {"email": re.compile("@"), "ip": re.compile("[0-9]"), "card": re.compile("[0-9]"), "phone": re.compile(r"\+")}
MARKS = re.compile("[0-9@]")
DIGITS = frozenset("0123456789")
JOINS = frozenset("./_-")
LETTERS = "éößñ"  # of hosts beyond the base pattern

WINDOW = 64
STRIDE = WINDOW // 2
HIDDEN = 12
SAMPLE_DOCUMENTS = 512
TRAINING_WINDOWS = 1_024
REWRITES = 2
PAD = 0
CLASSES = ["", "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", " \t", "\n\r", "@", ".", "-", "_", "+", "%", "()", ",;:", "/"]
CLASS_OF = np.full(129, len(CLASSES), dtype=np.int64)
for number, characters in enumerate(CLASSES):
    CLASS_OF[[ord(c) for c in characters]] = number
N_CLASSES = len(CLASSES) + 1
N_TAGS = 1 + 2 * len(KINDS)  # outside; begin and inside of each kind


def passes(kind: str, text: str) -> bool:
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))
    digits = [int(c) for c in text if c in "0123456789"]
    if kind == "phone":
        return 10 <= len(digits) <= 15
    if not 14 <= len(digits) <= 19:
        return False
    doubled = [d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def matches(text: str) -> tuple[list[tuple], list[tuple]]:
    """Base spans (kind number, start, end), and the matches that failed their check."""
    good, failed = [], []
    for number, kind in enumerate(KINDS):
        if not NEEDED[kind].search(text):
            continue
        anywhere, at_run = PATTERNS[kind]
        position = 0
        while True:
            # Right after a match the next one may start inside a run; elsewhere only at its start.
            found = (anywhere.match(text, position) if position else None) or at_run.search(text, position)
            if found is None:
                break
            position = found.end()
            (good if passes(kind, found[0]) else failed).append((number, found.start(), position))
    return good, failed


class Lstm:
    """One direction; inputs are class numbers, so the input product is a row lookup."""

    def __init__(self, rng):
        self.x = rng.normal(0, 0.3, (N_CLASSES, 4 * HIDDEN)).astype(np.float32)
        self.h = rng.normal(0, 0.3, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
        self.x[:, HIDDEN : 2 * HIDDEN] += 1.0  # open forget gates

    def parameters(self):
        return [self.x, self.h]

    def forward(self, classes: np.ndarray, keep: bool = False):
        """(steps, rows) class numbers to (steps, rows, HIDDEN) states."""
        steps, rows = classes.shape
        h = c = np.zeros((rows, HIDDEN), np.float32)
        states = np.empty((steps, rows, HIDDEN), np.float32)
        tape = []
        for t in range(steps):
            gates = self.x[classes[t]] + h @ self.h
            i, f, o = (1 / (1 + np.exp(-gates[:, k * HIDDEN : (k + 1) * HIDDEN])) for k in (0, 1, 2))
            g = np.tanh(gates[:, 3 * HIDDEN :])
            before_h, before_c = h, c
            c = f * c + i * g
            tanh_c = np.tanh(c)
            h = o * tanh_c
            states[t] = h
            if keep:
                tape.append((i, f, o, g, before_h, before_c, tanh_c))
        return states, tape

    def backward(self, classes, tape, grad_states):
        grad_x, grad_h = np.zeros_like(self.x), np.zeros_like(self.h)
        dh = dc = 0.0
        for t in range(len(tape) - 1, -1, -1):
            i, f, o, g, before_h, before_c, tanh_c = tape[t]
            dh = grad_states[t] + dh
            dc = dh * o * (1 - tanh_c**2) + dc
            gates = np.concatenate(
                [dc * g * i * (1 - i), dc * before_c * f * (1 - f), dh * tanh_c * o * (1 - o), dc * i * (1 - g**2)], axis=1
            )
            np.add.at(grad_x, classes[t], gates)
            grad_h += before_h.T @ gates
            dh, dc = gates @ self.h.T, dc * f
        return [grad_x, grad_h]


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


class Tagger:
    """Bidirectional LSTM over characters with CRF transitions between tags."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.forth, self.back = Lstm(rng), Lstm(rng)
        self.out = rng.normal(0, 0.3, (2 * HIDDEN, N_TAGS)).astype(np.float32)
        self.bias = np.zeros(N_TAGS, np.float32)
        self.move = np.zeros((N_TAGS, N_TAGS), np.float32)

    def parameters(self):
        return [*self.forth.parameters(), *self.back.parameters(), self.out, self.bias, self.move]

    def emissions(self, classes, keep=False):
        a, tape_a = self.forth.forward(classes, keep)
        b, tape_b = self.back.forward(classes[::-1], keep)
        states = np.concatenate([a, b[::-1]], axis=2)
        return states @ self.out + self.bias, states, tape_a, tape_b

    def loss(self, classes: np.ndarray, tags: np.ndarray):
        """Mean negative log-likelihood per window and its gradients; arrays are (steps, rows)."""
        steps, rows = classes.shape
        e, states, tape_a, tape_b = self.emissions(classes, keep=True)
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0]
        for t in range(1, steps):
            alpha[t] = log_sum(alpha[t - 1][:, :, None] + self.move, 1) + e[t]
        for t in range(steps - 2, -1, -1):
            beta[t] = log_sum(self.move + (beta[t + 1] + e[t + 1])[:, None, :], 2)
        z = log_sum(alpha[-1], 1)
        each = np.arange(rows)
        path = sum(e[t][each, tags[t]] for t in range(steps))
        path = path + sum(self.move[tags[t - 1], tags[t]] for t in range(1, steps))
        grad_e = np.exp(alpha + beta - z[:, None])
        grad_move = np.zeros_like(self.move)
        for t in range(1, steps):
            pair = alpha[t - 1][:, :, None] + self.move + (beta[t] + e[t])[:, None, :] - z[:, None, None]
            grad_move += np.exp(pair).sum(axis=0)
            np.add.at(grad_move, (tags[t - 1], tags[t]), -1.0)
        for t in range(steps):
            grad_e[t][each, tags[t]] -= 1.0
        grad_states = grad_e @ self.out.T
        grads = [
            *self.forth.backward(classes, tape_a, grad_states[:, :, :HIDDEN]),
            *self.back.backward(classes[::-1], tape_b, grad_states[::-1, :, HIDDEN:]),
            np.einsum("trh,trk->hk", states, grad_e),
            grad_e.sum(axis=(0, 1)),
            grad_move,
        ]
        return float((z - path).mean()), [g / rows for g in grads]

    def decode(self, classes: np.ndarray) -> np.ndarray:
        """Best tag sequence of each window, by Viterbi."""
        e = self.emissions(classes)[0]
        steps, rows = classes.shape
        best, came = e[0], np.empty((steps, rows, N_TAGS), np.int8)
        for t in range(1, steps):
            scores = best[:, :, None] + self.move
            came[t] = scores.argmax(axis=1)
            best = scores.max(axis=1) + e[t]
        tags = np.empty((steps, rows), np.int8)
        tags[-1] = best.argmax(axis=1)
        each = np.arange(rows)
        for t in range(steps - 1, 0, -1):
            tags[t - 1] = came[t][each, tags[t]]
        return tags

    def fit(self, classes: np.ndarray, tags: np.ndarray, epochs: int = 14, batch: int = 64, rate: float = 0.02, seed: int = 0):
        """Adam over shuffled windows; the rate falls in a line to a tenth."""
        rng = np.random.default_rng(seed)
        mean = [np.zeros_like(p) for p in self.parameters()]
        spread = [np.zeros_like(p) for p in self.parameters()]
        step, steps = 0, epochs * -(-classes.shape[1] // batch)
        for _ in range(epochs):
            order = rng.permutation(classes.shape[1])
            for lo in range(0, len(order), batch):
                rows = order[lo : lo + batch]
                _, grads = self.loss(classes[:, rows], tags[:, rows])
                now = rate * (1 - 0.9 * step / steps)
                step += 1
                for p, g, m, s in zip(self.parameters(), grads, mean, spread):
                    g = np.clip(g, -5, 5)
                    m += 0.1 * (g - m)
                    s += 0.01 * (g * g - s)
                    p -= now * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
        return self


def classes_of(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")
    return CLASS_OF[np.minimum(codes, 128)]


def windows(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and classes of the windows that hold a digit or an @; every kind needs one.

    Window w covers the characters from w * STRIDE on, WINDOW of them, so neighbours overlap by half.
    """
    marks = np.fromiter((m.start() for m in MARKS.finditer(text)), dtype=np.int64)
    blocks = np.unique(marks // STRIDE)
    numbers = np.unique(np.concatenate([blocks, blocks - 1]))
    numbers = numbers[numbers >= 0]
    # Only the stretch that holds windows is turned into classes.
    padded = np.full(len(text) + WINDOW + STRIDE, PAD, dtype=np.int64)
    padded[: len(text)] = classes_of(text)
    return numbers, padded[numbers[:, None] * STRIDE + np.arange(WINDOW)]


def tags_of(length: int, spans: list[tuple]) -> np.ndarray:
    tags = np.zeros(length + WINDOW + STRIDE, dtype=np.int64)
    for kind, start, end in sorted(spans, key=lambda s: -s[0]):
        tags[start:end] = 2 + 2 * kind
        tags[start] = 1 + 2 * kind
    return tags


def rewritten(text: str, spans: list[tuple], rng) -> tuple[str, list[tuple]]:
    """The text with its labelled spans written in other ways that no pattern knows, and their places."""
    parts, out, at, length = [], [], 0, 0
    for kind, start, end in sorted(spans, key=lambda s: s[1:]):
        if start < at:
            continue
        span = text[start:end]
        digits = "".join(c for c in span if c in DIGITS)
        if KINDS[kind] == "phone":
            mark = rng.choice([".", "-", " ", "/"])
            local = f"{digits[-10:-7]}{mark}{digits[-7:-4]}{mark}{digits[-4:]}"
            bracketed = f"({digits[-10:-7]}) {digits[-7:-4]}{rng.choice(['-', ' ', '.'])}{digits[-4:]}"
            far = f"00{digits[:2]}{mark}{digits[2:5]}{mark}{digits[5:]}"
            span = [local, bracketed, far][rng.integers(3)]
        elif KINDS[kind] == "card":
            mark = rng.choice([".", "  ", "/", "_", " - "])
            span = mark.join(digits[i : i + 4] for i in range(0, len(digits), 4))
        elif KINDS[kind] == "ip":
            span = str(rng.choice([" . ", ". ", " ."])).join(span.split("."))
        else:
            name, _, host = span.partition("@")
            span = f"{name}@{host[:1]}{rng.choice(list(LETTERS))}{host[1:]}"
        parts += [text[at:start], span]
        length += start - at
        out.append((kind, length, length + len(span)))
        length += len(span)
        at = end
    return "".join([*parts, text[at:]]), out


def reconcile(numbers: np.ndarray, tags: np.ndarray, length: int) -> list[tuple]:
    """Spans of a text from the tags of its windows: each character follows the window it is most central in."""
    whole = np.zeros(length + WINDOW + STRIDE, dtype=np.int8)
    nearness = np.full(len(whole), -1)
    inside = np.minimum(np.arange(WINDOW), WINDOW - 1 - np.arange(WINDOW))
    for number, row in zip(numbers, tags):
        lo = number * STRIDE
        better = inside > nearness[lo : lo + WINDOW]
        whole[lo : lo + WINDOW][better] = row[better]
        nearness[lo : lo + WINDOW][better] = inside[better]
    whole = whole[:length]
    kind = (whole + 1) // 2 - 1
    turns = np.flatnonzero(np.diff(kind, prepend=-1, append=-1) != 0) if length else []
    spans = []
    for lo, hi in zip(turns[:-1], turns[1:]):
        if kind[lo] >= 0:
            begins = [lo, *(lo + 1 + np.flatnonzero(whole[lo + 1 : hi] % 2 == 1)), hi]
            spans += [(int(kind[lo]), int(a), int(b)) for a, b in zip(begins, begins[1:])]
    return spans


def snapped(kind: int, text: str, a: int, b: int) -> tuple[int, int]:
    """A tagger's span moved to the edges of what it cuts: words for an email, else runs of digits."""
    if KINDS[kind] == "email":
        inner = r"[A-Za-z0-9._%+@'\w-]"
        while a > 0 and re.match(inner, text[a - 1]):
            a -= 1
        while b < len(text) and re.match(inner, text[b]):
            b += 1
        edge = ".-'"
        while a < b and text[a] in edge + "+%":
            a += 1
        while a < b and (text[b - 1].isspace() or text[b - 1] in edge + ",;:"):
            b -= 1
        return a, b
    while a < b and text[a] not in DIGITS:
        a += 1
    while a < b and text[b - 1] not in DIGITS:
        b -= 1
    if a == b:
        return a, b
    while a > 0 and text[a - 1] in DIGITS:
        a -= 1
    while b < len(text) and text[b] in DIGITS:
        b += 1
    # A number whose groups are joined by single marks is one: 1111.1111 within 4111.1111.1111.1111.
    while a > 1 and text[a - 1] in JOINS and text[a - 2] in DIGITS:
        a -= 2
        while a > 0 and text[a - 1] in DIGITS:
            a -= 1
    while b + 1 < len(text) and text[b] in JOINS and text[b + 1] in DIGITS:
        b += 2
        while b < len(text) and text[b] in DIGITS:
            b += 1
    if KINDS[kind] == "phone":
        for sign in "(+":
            a -= a > 0 and text[a - 1] == sign
    return a, b


def plausible(kind: int, text: str) -> bool:
    """What a span of the tagger must hold to count: the marks without which its kind cannot be."""
    if KINDS[kind] == "email":
        return re.fullmatch(r"[^\s@]+@[^\s@]+\.[^\s@]+", text) is not None
    if KINDS[kind] == "ip":
        parts = re.fullmatch(r"([0-9]{1,3})[.\s]+([0-9]{1,3})[.\s]+([0-9]{1,3})[.\s]+([0-9]{1,3})", text)
        return parts is not None and all(int(p) <= 255 for p in parts.groups())
    return re.fullmatch(r"[(+]{0,2}[0-9](?:[\s().,/_-]{0,3}[0-9])+", text) is not None and passes(KINDS[kind], text)


def all_spans(texts: list[str], tagger: Tagger | None, rows_at_once: int = 2048):
    """Per text: base spans, and spans the tagger adds."""
    base, extra, waiting = [], [[] for _ in texts], []

    def settle():
        if not waiting:
            return
        stacked = np.concatenate([c for _, _, c in waiting])
        tags = np.concatenate(
            [tagger.decode(stacked[lo : lo + rows_at_once].T).T for lo in range(0, len(stacked), rows_at_once)]
        )
        at = 0
        for row, numbers, classes in waiting:
            good, failed = base[row]
            taken, refused = [(a, b) for _, a, b in good], set(failed)
            for kind, a, b in reconcile(numbers, tags[at : at + len(classes)], len(texts[row])):
                a, b = snapped(kind, texts[row], a, b)
                # A good match stands; a failed one speaks for its own kind and extent only.
                if (kind, a, b) not in refused and plausible(kind, texts[row][a:b]) and not any(a < d and c < b for c, d in taken):
                    extra[row].append((kind, a, b))
                    taken.append((a, b))
            at += len(classes)
        waiting.clear()

    held = 0
    for row, text in enumerate(texts):
        marked = MARKS.search(text) is not None
        base.append(matches(text) if marked else ([], []))
        if marked and tagger is not None:
            numbers, classes = windows(text)
            waiting.append((row, numbers, classes))
            held += len(numbers)
            if held > 4 * rows_at_once:
                settle()
                held = 0
    settle()
    return [good for good, _ in base], extra


def train(docs: DataFrame, sample_documents: int = SAMPLE_DOCUMENTS, training_windows: int = TRAINING_WINDOWS) -> Tagger | None:
    """A tagger from at most ``sample_documents`` documents that hold a digit or an @, chosen by hash of the id.

    Their base spans label at most ``training_windows`` windows, half of them with spans where there are as
    many; half as many windows again hold spans written in other ways.  None if no window has a span: then the base patterns stand alone.
    """
    ids = hash_sample(docs.filter(F.col("text").rlike("[0-9@]")).select("doc_id").dropna(), sample_documents)
    if not ids:
        return None

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for original in batch["text"]:
                spans = matches(original)[0]
                rng = np.random.default_rng(zlib.crc32(original.encode("utf-8", "replace")))
                for text, labels in [(original, spans), *(rewritten(original, spans, rng) for _ in range(REWRITES if spans else 0))]:
                    numbers, classes = windows(text)
                    tags = tags_of(len(text), labels)[numbers[:, None] * STRIDE + np.arange(WINDOW)]
                    # At most 64 windows of one text, those with spans first.
                    order = np.argsort(~tags.any(axis=1), kind="stable")[:64]
                    if text is not original:
                        order = order[tags[order].any(axis=1)]
                    yield pd.DataFrame({"c": [bytes(x) for x in classes[order].astype(np.uint8)], "t": [bytes(x) for x in tags[order].astype(np.uint8)], "r": text is not original})

    sample = docs.filter(F.col("doc_id").isin(ids) & F.col("text").rlike("[0-9@]")).select("text")
    rows = sample.mapInPandas(cut, "c binary, t binary, r boolean").toPandas().sort_values(["c", "t", "r"]).drop_duplicates(["c", "t"])
    classes = np.array([np.frombuffer(x, np.uint8) for x in rows["c"]], dtype=np.int64).reshape(-1, WINDOW)
    tags = np.array([np.frombuffer(x, np.uint8) for x in rows["t"]], dtype=np.int64).reshape(-1, WINDOW)
    order = np.random.default_rng(0).permutation(len(classes))
    held = tags[order].any(axis=1)
    other_ways = rows["r"].to_numpy(dtype=bool)[order]
    with_spans, without = order[held & ~other_ways][: training_windows // 2], order[~held][: training_windows // 2]
    if not len(with_spans):
        return None
    used = np.concatenate([with_spans, without, order[other_ways][: training_windows // 2]])
    return Tagger().fit(classes[used].T, tags[used].T)


def find(docs: DataFrame, tagger: Tagger | None) -> DataFrame:
    """Adds ``base`` and ``added``: arrays of (start, kind number, end) in code points, in order.

    Base spans follow the fixed patterns and checks; the tagger adds spans that touch no base
    span and are no failed match of their own kind.  Overlapping windows are decoded apart and each character follows the window it is most
    central in.  A null or empty text has no spans; repeated rows get the same; columns named base or
    added are replaced, others kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tagger)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            base, extra = [], []
            for lo in range(0, len(texts), 256):
                b, x = all_spans(texts[lo : lo + 256], shared.value)
                base += b
                extra += x
            yield pd.DataFrame({"base": [ordered(s) for s in base], "added": [ordered(s) for s in extra]})

    kind = "array<struct<start: int, kind: int, end: int>>"
    return map_rows(docs.drop("base", "added"), run, f"base {kind}, added {kind}", reads=["text"])


def ordered(spans: list[tuple]) -> list[dict]:
    return [{"start": s, "kind": k, "end": e} for s, k, e in sorted((s, k, e) for k, s, e in spans)]


def masked_text(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """The text with the kind in angle brackets in place of each span (start, kind number, end)."""
    if text is None or not spans:
        return text
    parts, at = [], 0
    for start, kind, end in sorted(spans):
        if end <= at:
            continue
        if start >= at:
            parts += [text[at:start], f"<{KINDS[kind]}>"]
        at = end
    return "".join([*parts, text[at:]])


def mask(docs: DataFrame) -> DataFrame:
    """Replaces the spans that ``find`` added to ``docs`` by their kind in angle brackets, in the text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [
                masked_text(text, [(s["start"], s["kind"], s["end"]) for s in [*base, *added]])
                for text, base, added in zip(batch["text"], batch["base"], batch["added"])
            ]
            yield pd.DataFrame({"_masked": pd.Series(out, dtype=object)})

    changed = map_rows(docs, run, "_masked string", reads=["text", "base", "added"])
    columns = [F.col("_masked").alias("text") if c == "text" else F.col(c) for c in docs.columns]
    return changed.select(*columns).drop("base", "added")


def find_and_mask(docs: DataFrame, tagger: Tagger | None) -> DataFrame:
    """``mask`` of ``find`` in one step: a task needs one worker, not one for each."""
    shared = docs.sparkSession.sparkContext.broadcast(tagger)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, out = batch["text"].tolist(), []
            for lo in range(0, len(texts), 256):
                some = texts[lo : lo + 256]
                base, extra = all_spans([t or "" for t in some], shared.value)
                out += [masked_text(t, [(s, k, e) for k, s, e in [*b, *x]]) for t, b, x in zip(some, base, extra)]
            yield pd.DataFrame({"_masked": pd.Series(out, dtype=object)})

    changed = map_rows(docs, run, "_masked string", reads=["text"])
    return changed.select(*[F.col("_masked").alias("text") if c == "text" else F.col(c) for c in docs.columns])
