"""Personal data: base patterns, and a semi-Markov conditional random field that adds spans.

The field reads a text as a row of segments: single words that are nothing, or spans of up to
MOST_WORDS words of one kind. A span is scored as a whole (its digits and their groups, check sums,
separators, the word before it), and one dynamic programme over the words near digits, at-signs and
their spelled-out forms chooses boundaries and kinds together. Words without any of these nearby can
only be nothing, so they are not visited. Spans of the field that touch a base span give way to it.

The field is trained here, on sentences drawn from a fixed seed (TRAINING_SENTENCES of them), by
maximising the likelihood of their segmentations; only its small table of weights goes to the tasks.

Defined cases: a null text counts as empty and has no span; repeated rows are searched one by one;
positions are code points; an empty table gives an empty result. Other columns pass through
``redacted`` unchanged, except that ``n_chars``, where present, follows the new text.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from stationflow.llm.batches import in_small_batches

Span = tuple[int, int, str]  # start, end, kind

# Kinds in their order, and the base patterns (a look-behind keeps starts at the start of a run).
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile("[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end(), "email"
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def _small(part: str) -> bool:
    return len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns, by start and then kind in the order of BASE_KINDS."""
    found = list(_emails(text))
    if re.search("[0-9]", text):
        found += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(map(_small, m.group().split(".")))]
        for pattern, kind, least, most in ((_CARD, "card", 14, 19), (_PHONE, "phone", 10, 15)):
            for m in pattern.finditer(text):
                digits = _NOT_DIGIT.sub("", m.group())
                if least <= len(digits) <= most and (kind == "phone" or luhn(digits)):
                    found.append((m.start(), m.end(), kind))
    return sorted(found, key=_order)


def _order(span: Span) -> tuple[int, int, int]:
    return span[0], KINDS.index(span[2]), span[1]


# --- the field ----------------------------------------------------------------------------------

MOST_WORDS, REACH = 6, 7  # words of a span; words around a trigger that are read
TRAINING_SENTENCES, EPOCHS, RATE, PENALTY = 700, 8, 0.3, 1e-4
MARGIN = 1.5  # a span must beat 'nothing' by this much for each kind it could be
_WORD = re.compile(r"\S+")
_TRIGGER = re.compile(r"[0-9@]|[\[({](?:at|dot)[\])}]|\bdot\b")
_MARK = re.compile(r"[\[({](?:at|dot)[\])}]|\b(?:at|dot)\b")
_LONG_KEY = re.compile(r"[A-Za-z0-9_/+=-]{16,}\Z")
_CUES = {
    "phone": ("phone", "tel", "call", "mobile", "fax", "tel:", "phone:"), "card": ("card", "visa", "card:", "cc"),
    "ip": ("ip", "host", "ip:", "address"), "email": ("email", "mail", "e-mail", "email:", "contact"),
    "secret": ("token", "key", "secret", "password", "=", "key:", "token:", "api_key"),
}


@lru_cache(maxsize=8_000)
def span_features(span: str, before: str) -> tuple[float, ...]:
    """Features of a whole span and the word before it."""
    digits = _NOT_DIGIT.sub("", span)
    n, size = len(digits), len(span)
    letters = sum(c.isalpha() for c in span)
    groups = re.findall("[0-9]+", span)
    marks = [m.group().strip("[](){}") for m in _MARK.finditer(span)]
    compact = _LONG_KEY.match(span) is not None
    parts = span.split(".")
    dotted = len(parts) == 4 and all(p.isdigit() for p in parts)
    cue = before.lower()
    return (
        1.0, float("@" in span), float("at" in marks and "dot" in marks), float(span.startswith("+")),
        float(dotted), float(dotted and all(map(_small, parts))), float(n == 0), float(1 <= n <= 6), float(7 <= n <= 9),
        float(10 <= n <= 13), float(14 <= n <= 19), float(n > 19), float(14 <= n <= 19 and luhn(digits)),
        float(letters == 0), float(letters > 0.5 * size), float(n > 0 and letters == 0 and size - n > n),
        float(len(groups) == 4 and all(len(g) == 4 for g in groups)), float(2 <= len(groups) <= 4 and len(groups[-1]) == 4),
        float(len(groups) > 5), float(compact and letters > 0 and n > 2), float(compact and size >= 32),
        float(bool(re.search("[()]", span))), float("-" in span), float(" " in span), math.log1p(span.count(" ")),
        float("@" in span and _DOMAIN.search(span) is not None), float(span[:1] in "([{" and span[-1:] not in ")]}"),
        float(not span[-1:].isalnum()), float(not (span[:1].isalnum() or span[:1] in "+(")),
        *[float(cue in _CUES[k]) for k in KINDS],
    )


WIDTH = len(span_features("1", ""))


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    while start < end and text[start] in "\"'<[{,;:=":
        start += 1
    while end > start and text[end - 1] in "\"'>]},;:.!?=":
        end -= 1
    if end > start and text[end - 1] == ")" and "(" not in text[start:end]:
        end -= 1
    return start, end


def windows(text: str) -> list[list[tuple[int, int]]]:
    """Runs of words within REACH words of a trigger; only the text around triggers is cut into words."""
    out: list[list[tuple[int, int]]] = []
    done = 0
    for m in _TRIGGER.finditer(text):
        if m.start() < done and out:
            continue
        # words before the trigger, back to where the window before ended
        start, spaces = m.start(), 0
        while start > done and spaces <= REACH:
            start -= 1
            spaces += text[start].isspace() and not text[start + 1].isspace()
        words, last = [], m.start()
        for w in _WORD.finditer(text, start):
            if _TRIGGER.search(text, w.start(), w.end()):
                last = len(words)
            words.append((w.start(), w.end()))
            if len(words) - last > REACH and w.start() > m.start():
                break
        done = words[-1][1]
        out.append(words)
    return out


def candidates(text: str, words: list[tuple[int, int]]) -> list[list[tuple[int, int, int]]]:
    """For each word index e: (first word, start, end) of the spans that end with word e."""
    out: list[list[tuple[int, int, int]]] = []
    for e, (_, word_end) in enumerate(words):
        own = []
        for b in range(e, max(-1, e - MOST_WORDS), -1):
            if "\n" in text[words[b][0]:word_end]:
                break
            start, end = trimmed(text, words[b][0], word_end)
            if start < end and _TRIGGER.search(text, start, end):
                own.append((b, start, end))
        out.append(own)
    return out


def _phi(text: str, words, spans) -> list[np.ndarray]:
    return [
        np.array([span_features(text[s:e], text[slice(*words[b - 1])] if b else "") for b, s, e in own]).reshape(-1, WIDTH)
        for own in spans
    ]


class Field:
    """Weights of the kinds (features × kinds) and of a kind after a kind (0 is nothing)."""

    def __init__(self, weights: np.ndarray, after: np.ndarray):
        self.weights, self.after = weights, after

    def spans(self, text: str, margin: float = MARGIN) -> list[Span]:
        return [s for words in windows(text) for s in self._best(text, words, margin)]

    def _best(self, text: str, words, margin: float) -> list[Span]:
        spans = candidates(text, words)
        k, n = len(KINDS) + 1, len(words)
        best = np.full((n + 1, k), -np.inf)
        best[0, 0] = 0.0
        back: list[list] = [[None] * k for _ in range(n + 1)]
        for e, phi in enumerate(_phi(text, words, spans)):
            into = best[e] + self.after[:, 0]
            came = int(into.argmax())
            best[e + 1, 0], back[e + 1][0] = into[came], (e, came, None)
            for (b, start, end), scores in zip(spans[e], phi @ self.weights - margin):
                into = best[b][:, None] + self.after[:, 1:]
                came = into.argmax(axis=0)
                total = into.max(axis=0) + scores
                for y in np.flatnonzero(total > best[e + 1, 1:]):
                    best[e + 1, y + 1], back[e + 1][y + 1] = total[y], (b, int(came[y]), (start, end, KINDS[y]))
        found, e, y = [], n, int(best[n].argmax())
        while e:
            e, y, span = back[e][y]
            if span:
                found.append(span)
        return found[::-1]

    def gradient(self, text: str, words, truth: dict) -> tuple[np.ndarray, np.ndarray, float]:
        """Of the log likelihood of ``truth`` ((first word, last word) -> kind number from 1), and that itself."""
        spans = candidates(text, words)
        phi = _phi(text, words, spans)
        scores = [p @ self.weights for p in phi]
        k, n = len(KINDS) + 1, len(words)
        fore, rear = np.full((n + 1, k), -np.inf), np.full((n + 1, k), -np.inf)
        fore[0, 0], rear[n] = 0.0, 0.0
        more = np.logaddexp
        for e in range(n):
            fore[e + 1, 0] = more.reduce(fore[e] + self.after[:, 0])
            for (b, _, _), s in zip(spans[e], scores[e]):
                fore[e + 1, 1:] = more(fore[e + 1, 1:], more.reduce(fore[b][:, None] + self.after[:, 1:], axis=0) + s)
        for e in range(n - 1, -1, -1):
            rear[e] = more(rear[e], self.after[:, 0] + rear[e + 1, 0])
            for (b, _, _), s in zip(spans[e], scores[e]):
                rear[b] = more(rear[b], more.reduce(self.after[:, 1:] + (s + rear[e + 1, 1:])[None, :], axis=1))
        total = more.reduce(fore[n])
        d_weights, d_after, own = np.zeros_like(self.weights), np.zeros_like(self.after), 0.0
        for e in range(n):
            d_after[:, 0] -= np.exp(fore[e] + self.after[:, 0] + rear[e + 1, 0] - total)
            for (b, _, _), p, s in zip(spans[e], phi[e], scores[e]):
                share = np.exp(fore[b][:, None] + self.after[:, 1:] + (s + rear[e + 1, 1:])[None, :] - total)
                d_after[:, 1:] -= share
                d_weights -= np.outer(p, share.sum(axis=0))
        e, last = 0, 0
        starts = {b: (end, y) for (b, end), y in truth.items()}
        while e < n:
            end, y = starts.get(e, (e, 0))
            d_after[last, y] += 1
            own += self.after[last, y]
            if y:
                at = next(i for i, (b, _, _) in enumerate(spans[end]) if b == e)
                d_weights[:, y - 1] += phi[end][at]
                own += scores[end][at][y - 1]
            e, last = end + 1, y
        return d_weights, d_after, float(own - total)


def _sentence(rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """A made-up sentence and its true (first word, last word, kind number)."""
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice(("an", "er", "th", "o", "in", "re", "la", "s", "qu", "é")) for _ in range(rng.randint(1, 4)))
    hexes = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    octet = lambda: str(rng.randint(0, 255))

    def card() -> str:
        body = rng.choice("3456") + digits(rng.choice((13, 14)))
        whole = next(body + d for d in "0123456789" if luhn(body + d))
        return " ".join(whole[i:i + 4] for i in range(0, len(whole), 4)) if rng.random() < 0.3 else whole

    def no_card() -> str:
        """As many digits, whose check sum fails."""
        whole = card().replace(" ", "")
        whole = whole[:-1] + str((int(whole[-1]) + rng.randint(1, 9)) % 10)
        return " ".join(whole[i:i + 4] for i in range(0, len(whole), 4)) if rng.random() < 0.3 else whole

    makers = {
        1: lambda: rng.choice((f"{word()}.{digits(2)}@{word()}.example.com", f"{word()} [at] {word()} [dot] com",
                               f"{word()} (at) {word()} (dot) org", f"{word()}{digits(1)}@{word()}.org", f"{word()} at {word()} dot com")),
        2: lambda: ".".join(octet() for _ in range(4)),
        3: card,
        4: lambda: rng.choice((f"+{digits(1)} ({digits(3)}) {digits(3)}-{digits(4)}", f"+{digits(2)} {digits(3)} {digits(3)} {digits(4)}",
                               f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"+{digits(11)}")),
        5: lambda: rng.choice((hexes(39) + digits(1), "AKIA" + "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZ0123456789") for _ in range(15)) + digits(1),
                               "sk-" + hexes(31) + digits(1), hexes(31) + digits(1), "ghp_" + hexes(35) + digits(1))),
        0: lambda: rng.choice((digits(rng.randint(1, 6)), str(rng.randint(1900, 2030)), f"{digits(1)}.{digits(2)}", f"{digits(1)}.{digits(1)}.{digits(2)}",
                               f"20{digits(2)}-{digits(2)}-{digits(2)}", f"{digits(2)}:{digits(2)}", f"{digits(1)},{digits(3)}", f"{digits(3)} - {digits(3)}",
                               f"${digits(3)}.{digits(2)}", f"{digits(2)} {digits(2)} {digits(3)}", f"{digits(rng.randint(7, 12))}", f"{word()}{digits(2)}",
                               f"{digits(4)}.{digits(3)}.{digits(2)}.{digits(1)}", f"@{word()}", f"v{digits(1)}.{digits(1)}", f"{digits(4)}-{digits(4)}",
                               f"{word()} at {word()}", f"{word()} dot {word()}", f"http://{word()}.com/{digits(4)}",
                               f"{digits(3)} {digits(4)} {digits(2)}", no_card(), no_card(), no_card(), f"ISBN {digits(3)}-{digits(1)}-{digits(5)}", f"{word()}@{word()}")),
    }
    words: list[str] = []
    truth: list[tuple[int, int, int]] = []
    for _ in range(rng.randint(1, 3)):
        words += [word() for _ in range(rng.randint(1, 5))]
        kind = rng.choice((0, 0, 0, 1, 2, 3, 4, 5))
        if kind and rng.random() < 0.25:
            words.append(rng.choice(_CUES[KINDS[kind - 1]]))
        made = makers[kind]().split(" ")
        if kind:
            truth.append((len(words), len(words) + len(made) - 1, kind))
        if rng.random() < 0.25:
            made[-1] += rng.choice(".,;")
        elif rng.random() < 0.1:
            made[0], made[-1] = f'"{made[0]}', f'{made[-1]}"'
        words += made
    words += [word() for _ in range(rng.randint(0, 3))]
    return " ".join(words), truth


@lru_cache(maxsize=4)
def trained(sentences: int = TRAINING_SENTENCES, epochs: int = EPOCHS, seed: int = 7) -> Field:
    """The field after ``epochs`` passes of adaptive gradient steps over the drawn sentences."""
    rng = random.Random(seed)
    cases = []
    for _ in range(sentences):
        text, truth = _sentence(rng)
        words = [(m.start(), m.end()) for m in _WORD.finditer(text)]
        cases.append((text, words, {(b, e): y for b, e, y in truth}))
    field = Field(np.zeros((WIDTH, len(KINDS))), np.zeros((len(KINDS) + 1, len(KINDS) + 1)))
    seen = [np.full_like(field.weights, 1e-6), np.full_like(field.after, 1e-6)]
    for _ in range(epochs):
        rng.shuffle(cases)
        for case in cases:
            for held, square, step in zip((field.weights, field.after), seen, field.gradient(*case)):
                step = step - PENALTY * held
                square += step * step
                held += RATE * step / np.sqrt(square)
    return field


# --- on tables ----------------------------------------------------------------------------------

def all_spans(text: str, field: Field, base: list[Span] | None = None) -> list[Span]:
    """Base spans, and those of the field that touch none of them, in order."""
    base = base_spans(text) if base is None else base
    free, k, reach = [], 0, 0
    for start, end, kind in field.spans(text):
        while k < len(base) and base[k][0] < end:
            reach = max(reach, base[k][1])
            k += 1
        if reach <= start:
            free.append((start, end, kind))
    return sorted(base + free, key=_order)


def personal_spans(text: Column, field: Field | None = None) -> Column:
    """struct<base, spans>: arrays of struct<start, end, kind> by start and kind."""
    field = field or trained()
    kind = "array<struct<start:long,end:long,kind:string>>"

    @pandas_udf(f"base {kind}, spans {kind}")
    def found(texts: pd.Series) -> pd.DataFrame:
        shaped = lambda spans: [{"start": s, "end": e, "kind": k} for s, e, k in spans]
        rows = []
        for t in texts:
            base = base_spans(t) if t else []
            rows.append((shaped(base), shaped(all_spans(t, field, base))) if t else ([], []))
        return pd.DataFrame(rows, columns=["base", "spans"])

    return found(text)


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, number of base spans of each kind, digest of the base spans, all spans."""
    rows = in_small_batches(docs).select("doc_id", personal_spans(F.col("text")).alias("found"))
    def number(kind: str) -> Column:
        return F.size(F.filter("found.base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(kind) for kind in BASE_KINDS]
    return rows.select(
        "doc_id", *counts, F.sha2(listed(F.col("found.base")), 256).alias("base_sha256"),
        listed(F.col("found.spans")).alias("spans"))


def redact(text: str, spans: list[Span]) -> str:
    """``text`` with every span, or run of overlapping spans, replaced by the first one's kind."""
    out, done = [], 0
    for start, end, kind in spans:
        if start >= done:
            out += [text[done:start], f"<{kind.upper()}>"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def redacted(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced; null texts stay null."""
    field = field or trained()

    @pandas_udf("string")
    def cleaned(texts: pd.Series) -> pd.Series:
        return pd.Series([redact(t, all_spans(t, field)) if t else t for t in texts], dtype=object)

    docs = in_small_batches(docs).withColumn("text", cleaned(F.col("text")))
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


def base_digest(text: str) -> str:
    """What ``digests`` gives as base_sha256, for tests."""
    said = ",".join(f"{k}:{s}:{e}" for s, e, k in base_spans(text))
    return hashlib.sha256(said.encode()).hexdigest()
