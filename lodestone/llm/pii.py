"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors: at-signs, plus signs, digits, schemes
and words that announce an identifier. From each anchor a deterministic local
parser expands over the characters its kind may hold, and validates the result
(part ranges, Luhn, digit counts, IBAN check digits). The base kinds equal a
leftmost, non-overlapping search of their patterns over the whole text: a match
never leaves the run of characters that its pattern can hold, so searching the
run is searching the text.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .hashed import numbered

Span = tuple[int, int]

#: Words that announce an account number (fixed values).
ACCOUNT_CUES = ("iban", "account", "acct", "konto", "cuenta", "compte", "ssn", "passport")
#: Street words that follow or precede a house number (fixed values).
STREET_CUES = (" street", " avenue", " road", " lane", "straße", "strasse", "rue ", "calle ", "avenida ")
#: Schemes whose address part may name a person (fixed values).
SCHEMES = ("mailto:", "://", "tel:")
#: Characters of an account number by country, as registered under ISO 13616 (fixed values): a following word can look like its last groups.
IBAN_LENGTHS = {
    c: n
    for n, codes in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
        24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for c in codes.split()
}
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "account", "address", "url")

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_IP_RUN = re.compile(r"[0-9.]+")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_CARD_RUN = re.compile(r"[0-9\x20-]+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"[A-Za-z]{2}[0-9]{2}(?:\x20?[A-Za-z0-9]{4}){2,7}(?:\x20?[A-Za-z0-9]{1,3})?(?![A-Za-z0-9])")
_NUMBER = re.compile(r"[^\w\n]{0,3}(?:(?:no|nr|number|num)\.?[^\w\n]{0,2})?([0-9](?:[\x20-]?[0-9]){5,17})(?!\w)", re.I)
_HOUSE = re.compile(r"(?<!\w)[0-9]{1,5}[A-Za-z]?$")
_HOUSE_AFTER = re.compile(r"(?:[^\W\d_]+\x20){0,4}[0-9]{1,5}[A-Za-z]?(?!\w)")
_HOUSE_NEXT = re.compile(r"\x20[0-9]{1,5}[A-Za-z]?(?!\w)")
_NOT_IN_URL = re.compile(r"[\s<>\"']")
_DIGITS = "0123456789"


@cache
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for kind, cues in (("at", "@"), ("plus", "+"), ("digit", _DIGITS), ("account", ACCOUNT_CUES), ("street", STREET_CUES), ("scheme", SCHEMES)):
        for c in cues:
            a.add_word(c, (kind, len(c)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if k & 1:
            v = v * 2 - 9 if v > 4 else v * 2
        total += v
    return total % 10 == 0


def iban(text: str) -> bool:
    s = text.replace(" ", "").upper()
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _iban_end(text: str, start: int, end: int) -> int:
    """End of the account number in a match, which may hold words that follow after a space: the length of its country before others, then the longest. 0 if no check digits hold."""
    right = []
    while end > start:
        if iban(text[start:end]):
            right.append(end)
        end = text.rfind(" ", start, end)
    length = IBAN_LENGTHS.get(text[start : start + 2].upper())
    return next((e for e in right if len(text[start:e].replace(" ", "")) == length), right[0] if right else 0)


def _digits(text: str) -> str:
    return "".join(c for c in text if c in _DIGITS)


def _runs(text: str, at: list[int], chars: re.Pattern, allowed: frozenset) -> Iterator[Span]:
    """Maximal runs of allowed characters around the anchors, each once."""
    done = 0
    for p in at:
        if p < done:
            continue
        a = p
        while a > done and text[a - 1] in allowed:
            a -= 1
        done = chars.match(text, p).end()
        yield a, done


_IP_CHARS = frozenset(_DIGITS + ".")
_CARD_CHARS = frozenset(_DIGITS + " -")


def _emails(text: str, at: list[int]) -> list[Span]:
    out: list[Span] = []
    low = 0
    for p in at:
        a = p
        while a > low and text[a - 1] in _LOCAL:
            a -= 1
        if a < p and (m := _DOMAIN.match(text, p + 1)):
            out.append((a, low := m.end()))
        else:
            low = max(low, a)
    return out


def _ips(text: str, a: int, b: int) -> Iterator[Span]:
    """Four groups of digits at a time from every chain of groups joined by single dots, which is where the pattern matches."""
    for chain in _IP_CHAIN.finditer(text, a, b):
        at = chain.start()
        groups = chain[0].split(".")
        for k in range(0, len(groups) - 3, 4):
            four = groups[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(g.lstrip("0")) <= 3 and int(g.lstrip("0") or 0) <= 255 for g in four):
                yield at, end
            at = end + 1


def _accounts(text: str, cues: list[tuple[int, int]], digits: list[int]) -> Iterator[Span]:
    for _, end in cues:
        if m := _NUMBER.match(text, end):
            yield m.span(1)
    done = 0
    for p in digits:
        if p >= done and p >= 2 and text[p - 2].isascii() and text[p - 2 : p].isalpha() and not (p > 2 and text[p - 3].isalnum()) and (m := _IBAN.match(text, p - 2)):
            if end := _iban_end(text, *m.span()):
                yield m.start(), end
                done = end


def _letter(c: str) -> bool:
    return c.isalnum() and not c.isdecimal()


def _house_before(text: str, end: int) -> int | None:
    """Where a house number and one to four words, all followed by one space but the last, begin that end at ``end``."""
    at = end
    for _ in range(4):
        word = at
        while at > 0 and _letter(text[at - 1]):
            at -= 1
        if at == word or at == 0 or text[at - 1] != " ":
            return None
        at -= 1
        # Six characters of a number, and the one before it.
        if m := _HOUSE.search(text[max(0, at - 7) : at]):
            return at - len(m[0])
    return None


def _addresses(text: str, cues: list[tuple[int, int]]) -> Iterator[Span]:
    for a, end in cues:
        if end < len(text) and text[a:end][-1] != " " and text[end].isalpha():
            continue
        if text[a] == " ":
            if (start := _house_before(text, a)) is not None:
                yield start, end
        elif text[end - 1] == " ":
            if (a == 0 or not text[a - 1].isalnum()) and (m := _HOUSE_AFTER.match(text, end)):
                yield a, m.end()
        elif m := _HOUSE_NEXT.match(text, end):
            while a > 0 and text[a - 1].isalpha():
                a -= 1
            yield a, m.end()


def _urls(text: str, cues: list[tuple[int, int]], ats: list[int], digits: list[int], digit_ends: list[int]) -> Iterator[Span]:
    """Addresses after a scheme that name a user: mail and telephone links, and hosts behind a login. Every run of characters of an address is read once, whatever the number of schemes in it."""
    run_end = trimmed = -1
    counted = [0, *accumulate(b - a for a, b in zip(digits, digit_ends, strict=True))]

    def digits_before(at: int) -> int:
        k = bisect_left(digits, at)
        return counted[k] - (max(digit_ends[k - 1] - at, 0) if k else 0)

    for a, end in cues:
        if end > run_end:
            m = _NOT_IN_URL.search(text, end)
            run_end = trimmed = m.start() if m else len(text)
            while trimmed > end and text[trimmed - 1] in ".,;:!?)]":
                trimmed -= 1
        stop = max(trimmed, end)
        kind = text[a:end]
        if kind == "://":
            while a > 0 and text[a - 1].isascii() and text[a - 1].isalpha():
                a -= 1
            slash = text.find("/", end, stop)
            k = bisect_left(ats, end)
            if a == end - 3 or k == len(ats) or ats[k] >= (slash if slash >= 0 else stop):
                continue
        elif stop == end or kind == "tel:" and digits_before(stop) - digits_before(end) < 7:
            continue
        yield a, stop


def find_spans(text: str) -> dict[str, list[Span]]:
    """Spans in code points by kind; base kinds exactly as their patterns find them. Time and memory grow in proportion to the text."""
    anchors: dict[str, list] = {"at": [], "plus": [], "digit": [], "account": [], "street": [], "scheme": []}
    digit_ends: list[int] = []
    found = {k: [] for k in KINDS}
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c if len(x := c.lower()) != 1 else x for c in text)
    last_digit = -2
    for last, (kind, n) in automaton().iter(low):
        if kind == "digit":
            # A run of digits is one anchor.
            if last == last_digit + 1:
                digit_ends[-1] = last + 1
            else:
                anchors["digit"].append(last)
                digit_ends.append(last + 1)
            last_digit = last
        else:
            anchors[kind].append((last - n + 1, last + 1) if n > 1 else last)
    if anchors["at"]:
        found["email"] = _emails(text, anchors["at"])
    if digits := anchors["digit"]:
        for a, b in _runs(text, digits, _IP_RUN, _IP_CHARS):
            if b - a >= 7:
                found["ip"] += _ips(text, a, b)
        for a, b in _runs(text, digits, _CARD_RUN, _CARD_CHARS):
            if b - a >= 13:
                found["card"] += [m.span() for m in _CARD.finditer(text, a, b) if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if anchors["plus"]:
        found["phone"] = [m.span() for p in anchors["plus"] if (m := _PHONE.match(text, p)) and 9 <= len(_digits(m[0])) <= 15]
    if anchors["account"] or digits:
        found["account"] = sorted(set(_accounts(text, anchors["account"], digits)))
    if anchors["street"]:
        found["address"] = sorted(set(_addresses(text, anchors["street"])))
    if anchors["scheme"]:
        found["url"] = sorted(set(_urls(text, anchors["scheme"], anchors["at"], digits, digit_ends)))
    return found


def joined(found: dict[str, list[Span]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in found[k])


def redacted(text: str, found: dict[str, list[Span]]) -> str:
    """The text with every span replaced by its kind in angle brackets; of overlapping spans the first, longest one."""
    spans = sorted((a, -b, k) for k in KINDS for a, b in found[k])
    if not spans:
        return text
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += [text[at:a], f"<{k}>"]
            at = -b
        elif -b > at:
            at = -b
    return "".join([*out, text[at:]])


def _finder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, _, _ in tv.pieces(batches, "text"):
        counts, base, every = [[], [], [], []], [], []
        for text in rows.column(1):
            found = find_spans(text.as_py() or "")
            for k, kind in enumerate(BASE_KINDS):
                counts[k].append(len(found[kind]))
            base.append(hashlib.sha256(joined(found, BASE_KINDS).encode()).hexdigest())
            every.append(joined(found, KINDS))
        yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(base, pa.string()), pa.array(every, pa.string())], ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"])


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    A null text counts as empty and has no spans; rows that repeat are searched
    each; other columns are ignored; an empty table gives an empty result.
    """
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return src.mapInArrow(_finder, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """``docs`` with every span replaced by its kind; nulls stay null, and ``length_col`` follows the new text.

    Columns keep their names, types and order, whatever the names; rows that
    repeat stay; an empty table gives an empty result.
    """
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, _ in tv.pieces(batches, f"c{at}"):
            new = [None if (t := x.as_py()) is None else redacted(t, find_spans(t)) for x in rows.column(at)]
            yield rows.set_column(at, rows.schema.field(at), pa.array(new, rows.schema.field(at).type))

    src = numbered(docs)
    out = src.mapInArrow(run, src.schema)
    if length_col:
        k = docs.columns.index(length_col)
        text, length = F.col(f"c{at}"), F.col(f"c{k}")
        out = out.withColumn(f"c{k}", F.when(text.isNull(), length).otherwise(F.length(text)).cast(src.schema[k].dataType))
    return out.toDF(*docs.columns)
