"""Personal data with offset-preserving deobfuscation.

Base detectors find identifiers in the text as it stands. Then transducers rewrite disguises step by step - look-alike
and full-width characters, digits spelled as words, `at` and `dot` in words or brackets - and keep for every character
of the rewritten text the source characters that it came from. The same detectors run on the rewritten text, and their
spans are mapped back to the source. A span found that way is added if it overlaps no other span and its source text
really was disguised; base spans always stay.

All detectors work in time linear in the text, also on very long runs of one kind of character.

Defined cases: a null text counts as empty: no spans; a null doc_id stays null; repeated rows are treated one by one;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidied

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_RUN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])*")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")


def _from_digits(pattern: re.Pattern, text: str):
    """Matches of a pattern that starts with a digit and takes all it can: a plain search finds the digits faster."""
    m = _DIGITS.search(text)
    while m:
        m = pattern.match(text, m.start())
        yield m
        m = _DIGITS.search(text, m.end())


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches: from every @ left over local characters, right over a dotted name."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at + 1)
        if m:
            start = at
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                out.append((start, m.end()))
                last = m.end()
        # an earlier scan stopped at this @, so the next one starts behind it
        last = max(last, at + 1)
        at = text.find("@", last)
    return out


def ips(text: str) -> list[tuple[int, int]]:
    """Four numbers joined by dots, taken four at a time from a chain; matches with a part over 255 are dropped."""
    out = []
    if text.count(".") < 3:
        return out
    for m in _from_digits(_RUN, text):
        chain = m.group()
        if chain.count(".") < 3:
            continue
        parts, at = chain.split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append((at, end))
            at = end + 1
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _from_digits(_CARD, text):
        if m.end() - m.start() < 12:
            continue
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    if "+" not in text:
        return []
    return [m.span() for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.findall(m.group())) <= 15]


DETECTORS = {"email": emails, "ip": ips, "card": cards, "phone": phones}

# Letters of other scripts that look like Latin ones.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t",
    "у": "y", "х": "x", "ѵ": "v", "ԝ": "w", "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P",
    "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "Α": "A",
    "Β": "B", "Ε": "E", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ζ": "Z", "ɡ": "g", "ı": "i",
    "ո": "n", "օ": "o", "ս": "u", "։": ".", "。": ".", "․": ".", "·": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-",
}
#: Invisible characters, taken out.
INVISIBLE = ["­", "​", "‌", "‍", "⁠", "﻿"]
DIGIT_WORDS = {"zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}


def _lookalike_table() -> dict[str, str]:
    """The letters above, every other decimal digit, and what compatibility forms make of one printable ASCII character."""
    out = {}
    for cp in range(0xA0, 0x1FC00):
        c = chr(cp)
        if unicodedata.category(c) == "Nd":
            out[c] = str(unicodedata.decimal(c))
        elif unicodedata.decomposition(c).startswith("<") and len(n := unicodedata.normalize("NFKC", c)) == 1 and " " <= n <= "~":
            out[c] = n
    return out | LOOKALIKES | dict.fromkeys(INVISIBLE, "")


TABLE = _lookalike_table()
_DIGIT_WORD = re.compile(r"(?<![A-Za-z0-9])(?:" + "|".join(DIGIT_WORDS) + r")(?![A-Za-z0-9])", re.I)
# a run of blanks is tried from its start only, so that long runs stay linear
_BRACKET_AT = re.compile(r"(?<![ \t])[ \t]*[\[({<][ \t]*(?:at|@)[ \t]*[\])}>][ \t]*", re.I)
_BRACKET_DOT = re.compile(r"(?<![ \t])[ \t]*[\[({<][ \t]*(?:dot|\.)[ \t]*[\])}>][ \t]*", re.I)
_WORD_DOT = re.compile(r"(?<=[A-Za-z0-9])[ _-]+dot[ _-]+(?=[A-Za-z0-9])", re.I)
_SPACED_DOT = re.compile(r"(?<=[0-9]) ?\. ?(?=[0-9])")
_WORD_AT = re.compile(r"(?<=[A-Za-z0-9])[ _-]+at[ _-]+(?=[A-Za-z0-9])", re.I)
_HOST = re.compile(r"[A-Za-z0-9.-]+")
_NAME_RUN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-])?")
_WORD = re.compile(r"\S+")
_MAILBOX = re.compile(r"[A-Za-z][._+-]?[0-9]|[A-Za-z0-9][._+][A-Za-z0-9]")
_SPACED_AT = re.compile(r"(?<=[A-Za-z0-9]) *@ *(?=[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)")
_PLUS = re.compile(r"(?<![A-Za-z0-9])plus[ ]+(?=[0-9])", re.I)
_DIGIT_GAP = re.compile(r"(?<=[0-9])(?:, ?| ?[/_] ?| {2,}| ?- ?)(?=[0-9])")
# Signs of a disguise in lower-cased text; most patterns start with plain characters, which are searched fast. The last
# two take all that _SPACED_DOT and _DIGIT_GAP would change.
_HINTS = [re.compile(p) for p in (r"\[[ \t]*(?:at|@|\.|dot)", r"\([ \t]*(?:at|@|\.|dot)", r"\{[ \t]*(?:at|@|\.|dot)", r"<[ \t]*(?:at|@|\.|dot)", r" at[ _-]+[a-z0-9][a-z0-9-]*\.[a-z0-9]", r"_at[ _-]", r"-at[ _-]", r" @", r"@ ", r"[0-9](?: \. ?|\. )[0-9]", r"[0-9](?:, ?| ?[/_] ?| {2,}| ?- ?)[0-9]")]


def has_hint(text: str) -> bool:
    """Whether a disguise in ASCII may be there; a false alarm only costs time."""
    low = text.lower()
    for word in (*DIGIT_WORDS, "plus", "dot"):
        at = low.find(word)
        while at >= 0:
            end = at + len(word)
            if not (at and low[at - 1].isalnum() and low[at - 1].isascii()) and not (end < len(low) and low[end].isalnum() and low[end].isascii()):
                return True
            at = low.find(word, end)
    return any(p.search(low) for p in _HINTS)


class Rewritten:
    """A text with, for each of its characters, the source range [start, end) that it stands for."""

    def __init__(self, text: str):
        self.text = text
        self.start = np.arange(len(text))
        self.end = self.start + 1

    def step(self, pattern: re.Pattern, replacement) -> bool:
        """Replace all matches; `replacement` is a string or a function of the match (None: leave it)."""
        parts, starts, ends, at = [], [], [], 0
        for m in pattern.finditer(self.text):
            new = replacement if isinstance(replacement, str) else replacement(m)
            if new is None or new == m.group():
                continue
            a, b = m.span()
            parts += [self.text[at:a], new]
            starts += [self.start[at:a], np.full(len(new), self.start[a])]
            ends += [self.end[at:a], np.full(len(new), self.end[b - 1])]
            at = b
        if not parts:
            return False
        self.text = "".join([*parts, self.text[at:]])
        self.start, self.end = np.concatenate([*starts, self.start[at:]]), np.concatenate([*ends, self.end[at:]])
        return True

    def source(self, a: int, b: int) -> tuple[int, int]:
        return int(self.start[a]), int(self.end[b - 1])


def rewrite(text: str) -> Rewritten | None:
    """The text without its disguises; None if it shows no sign of one."""
    odd = () if text.isascii() or TABLE.keys().isdisjoint(text) else TABLE.keys() & set(text)
    if not odd and not has_hint(text):
        return None
    out = Rewritten(text)
    changed = bool(odd) and out.step(re.compile("[" + "".join(map(re.escape, odd)) + "]"), lambda m: TABLE[m.group()])
    if odd and not has_hint(out.text):
        return out if changed else None
    changed |= out.step(_DIGIT_WORD, lambda m: DIGIT_WORDS[m.group().lower()])
    changed |= out.step(_BRACKET_AT, "@")
    changed |= out.step(_BRACKET_DOT, ".")
    said_dot = out.step(_WORD_DOT, ".")
    changed |= said_dot | out.step(_SPACED_DOT, ".")

    if _WORD_AT.search(out.text):
        changed |= out.step(_WORD_AT, _at_word(out))
    changed |= out.step(_SPACED_AT, "@")
    changed |= out.step(_PLUS, "+")
    changed |= out.step(_DIGIT_GAP, " ")
    return out if changed else None


def _at_word(out: Rewritten):
    """Replacement of the word "at": it is common, so a dotted name must follow it, and either a dot was disguised there
    or the word before it, up to the blank, looks like a mailbox. Runs and words are found once for the whole text."""
    runs = [(m.start(), m.end(), m[1] is not None) for m in _NAME_RUN.finditer(out.text)]
    run_starts = [r[0] for r in runs]
    words = [m.span() for m in _WORD.finditer(out.text)]
    word_starts = [w[0] for w in words]
    mailbox: dict[int, int] = {}  # word -> end of its first sign of a mailbox

    def at(m: re.Match) -> str | None:
        a, b = m.span()
        run = runs[bisect_right(run_starts, b) - 1]
        if not (run[2] and b < run[1] - 2):
            return None
        host = _HOST.match(out.text, b).end()
        s, e = out.source(b, host)
        if e - s > host - b:
            return "@"
        k = bisect_left(word_starts, a) - 1
        if k not in mailbox:
            found = _MAILBOX.search(out.text, *words[k])
            mailbox[k] = found.end() if found else len(out.text) + 1
        return "@" if mailbox[k] <= a else None

    return at


def spans(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, added spans) as (start, end, kind) in code points."""
    base = [(a, b, kind) for kind, find in DETECTORS.items() for a, b in find(text)]
    plain = rewrite(text)
    if plain is None:
        return base, []
    # what is taken, as disjoint ranges in order
    starts, ends = [], []
    for a, b in sorted((a, b) for a, b, _ in base):
        if starts and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    added = []
    for kind, find in DETECTORS.items():
        for a, b in find(plain.text):
            s, e = plain.source(a, b)
            k = bisect_left(starts, e)
            if text[s:e] != plain.text[a:b] and not (k and ends[k - 1] > s):
                added.append((s, e, kind))
                starts.insert(k, s)
                ends.insert(k, e)
    return base, added


def listed(found: list[tuple[int, int, str]]) -> str:
    """kind:start:end, by start and then by kind in the order of KINDS."""
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1])))


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, base counts by kind, base_sha256, spans; one map over whole texts."""
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]

    def run(batches):
        for b in batches:
            counts, sha, every, extra = [], [], [], []
            for text in b.column(1).to_pylist():
                base, added = spans(text or "")
                counts.append([sum(k == kind for _, _, k in base) for kind in KINDS])
                sha.append(hashlib.sha256(listed(base).encode()).hexdigest())
                every.append(listed(base + added))
                extra.append(len(added))
            cols = [pa.array(c, pa.int64()) for c in (zip(*counts) if counts else [[]] * len(KINDS))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols, pa.array(sha, pa.string()), pa.array(every, pa.string()), pa.array(extra, pa.int64())], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tidied(run), f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long")


def masked(text: str | None) -> str | None:
    """The text with every span replaced by <KIND>; where spans overlap, the one that starts first covers."""
    if not text:
        return text
    base, added = spans(text)
    if not base and not added:
        return text
    out, at = [], 0
    for a, b, k in sorted(base + added, key=lambda x: (x[0], -x[1])):
        if a < at:
            if b > at:  # the rest of a span that the one before doesn't cover
                at = b
            continue
        out += [text[at:a], f"<{k.upper()}>"]
        at = b
    return "".join([*out, text[at:]])


def mask(docs: DataFrame) -> DataFrame:
    """The documents with identifiers masked and n_chars counted anew; all other columns as they were."""

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index("text")
            texts = pa.array([masked(t) for t in b.column(at).to_pylist()], b.schema.field(at).type)
            yield b.set_column(at, b.schema.field(at), texts)

    out = docs.mapInArrow(tidied(run), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
