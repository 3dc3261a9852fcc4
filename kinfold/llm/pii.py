"""Personal data, plain and disguised, with offsets into the source text.

Base detectors find e-mail addresses, IP addresses, payment cards and phone
numbers as written.  Each runs in time linear in the text.

A transducer then rewrites the parts of a text that look disguised: look-alike
letters and digits of other alphabets and widths, invisible characters,
spelled digits and numbers ("plus one 8 three", "one hundred twenty seven"), dots and dashes in disguise between
numerals ("192 dot 168", "10[.]0"), and "(at)", "[dot]", "at ... dot"
disguises.  Hints spare a text the rewriting; they pass all that it accepts,
and the detectors' length, range and Luhn checks decide.  Each rewritten piece keeps the span it came from.  The detectors
run on the rewritten text; what they find there, and not in the source, is
mapped back and added.  Base spans stay.

Offsets are code points, ends exclusive.  Null text is empty and has no spans.
Rows with a null or repeated doc_id are judged each by their own text; of
spans of one kind that start together the shorter comes first.  An empty table
gives an empty answer.  Other columns are left out by ``detect`` and kept by
``redact``.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from . import tokens
from .common import prepare

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

# Characters and classes of the base detectors.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}+")
NUMBER = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str):
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield ("email", start, m.end())
            free = m.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", free)


def _ips(text: str):
    for m in DOTTED.finditer(text):
        parts, at = m.group().split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in four)):
                yield ("ip", at, at + size)
            at += size + 1


def _cards(text: str):
    for m in NUMBER.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                yield ("card", *m.span())


def _phones(text: str):
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                yield ("phone", *m.span())


def base_spans(text: str) -> list[Span]:
    """Plain identifiers: kinds in the order of KINDS, then by start."""
    return [*_emails(text), *_ips(text), *_cards(text), *_phones(text)]


# Letters of other alphabets that look like Latin ones, point by point.
CONFUSABLE = dict(zip("АВЕЅІЈКМНОРСТУХаеорсухіјѕԁԛԝһΑΒΕΖΗΙΚΜΝΟΡΤΥΧοαρνιϳ", "ABESIJKMHOPCTYXaeopcyxijsdqwhABEZHIKMNOPTYXoapvij"))
# Marks that stand for an ASCII one, and characters that show nothing.
MARKS = dict(zip("。․｡‐‑‒–—−", "...------"))
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
# Digits as words, and words of the disguises, in the corpus's languages.
DIGITS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
AT, DOT = ("at", "arroba", "arobase", "ät"), ("dot", "punkt", "punto", "point")
# English numbers above nine.
TEENS = ("ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen")
TENS = ("twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety")
# Words before a bare "at", and after it, that make it a word of the sentence.
BEFORE_AT = (
    "look", "looks", "looking", "looked", "meet", "meets", "meeting", "met", "arrive", "arrives", "arrived", "work", "works", "worked", "working", "start", "starts", "started", "end", "ends", "ended",
    "stay", "stays", "stayed", "live", "lives", "lived", "stop", "stops", "stopped", "is", "are", "was", "were", "be", "been", "am", "it", "me", "us", "him", "her", "them", "and", "or", "not", "but", "here", "there", "up", "down", "back", "out",
    "good", "better", "best", "bad", "aim", "aimed", "sit", "sat", "stand", "stood", "shop", "buy", "bought", "sold", "find", "found", "see", "seen", "saw", "laugh", "laughed", "point", "pointed", "only", "now", "while",
)
AFTER_AT = (
    "this", "that", "these", "those", "the", "a", "an", "my", "your", "his", "her", "its", "our", "their", "noon", "midnight", "night", "dawn", "dusk", "home", "work", "school", "once", "least", "most", "first", "last", "all", "any", "some",
    "every", "each", "no", "one", "what", "which", "whatever", "times", "best", "worst", "present", "large", "hand", "it", "me", "you", "us", "them", "him",
)
# Letters written for a digit beside digits, in lower case.
LETTER_DIGITS = str.maketrans("oli", "011")


@lru_cache(maxsize=65_536)
def _plain(char: str) -> str:
    """The ASCII character that a character stands for, nothing if it is invisible, or itself."""
    if char in INVISIBLE:
        return ""
    if char in CONFUSABLE or char in MARKS:
        return CONFUSABLE.get(char) or MARKS[char]
    if char.isdecimal():
        return str(unicodedata.decimal(char))
    shape = unicodedata.decomposition(char).split(" ")
    if shape[0] in ("<wide>", "<font>", "<narrow>", "<small>", "<circle>", "<noBreak>") and len(shape) == 2 and int(shape[1], 16) < 128:
        return chr(int(shape[1], 16))
    return char


_ONES = "|".join(w for w, d in list(DIGITS.items())[:11] if d != "0")
_TEENS, _TENS = "|".join(TEENS), "|".join(TENS)
#: "one hundred and twenty seven", "twenty-seven", "twelve".
_LARGE = rf"(?:(?:{_ONES})[ -]hundred(?:[ -](?:and[ -])?(?:(?:{_TENS})(?:[ -](?:{_ONES}))?|{_TEENS}|{_ONES}))?|(?:{_TENS})(?:[ -](?:{_ONES}))?|{_TEENS})"
_WORD = f"{_LARGE}(?![a-z])|" + "|".join(sorted(DIGITS, key=len, reverse=True))
#: Before a run that begins with a word: that word belongs to a larger number, which is not read.
_LARGER = re.compile(r"(?<!\w)(?:hundred|thousand|million|hundert|tausend|mille|cent|mil)[ -](?:and[ -])?\Z", re.I)
_AT, _DOT = "|".join(AT), "|".join(DOT)
_B, _E = r"[ ]{0,2}[(\[{<][ ]{0,2}", r"[ ]{0,2}[)\]}>][ ]{0,2}"
_CODED_AT, _CODED_DOT = r"&(?:#0{0,4}64|#x0{0,4}40|commat);|%40", r"&(?:#0{0,4}46|#x0{0,4}2e|period);"
_ANY_AT = rf"(?:{_B}(?:{_AT}|@){_E}|[(\[{{<]a[)\]}}>]|{_CODED_AT}|[ ]{{1,2}}(?:{_AT})[ ]{{1,2}}|[ ]{{1,2}}@[ ]{{1,2}}|[_-](?:{_AT})[_-]|@)"
_ANY_DOT = rf"(?:{_B}(?:{_DOT}|\.){_E}|{_CODED_DOT}|[ ]{{1,2}}(?:{_DOT})[ ]{{1,2}}|[_-](?:{_DOT})[_-]|\.)"
_SIGNED = rf"[_-](?:{_AT}|{_DOT})[_-]|%40"
_PART, _LABEL = rf"(?!(?:{_AT}|{_DOT})(?![A-Za-z0-9_%+-]))(?:(?!{_SIGNED})[A-Za-z0-9_%+-])++", rf"[A-Za-z0-9](?:(?!{_SIGNED})[A-Za-z0-9-])*+"
#: Words with dots of any form between them: what may stand before an at sign, and after it.  Any number of them, and
#: nothing is given back, so that time stays linear.
USER, HOST = re.compile(rf"{_PART}(?:{_ANY_DOT}{_PART})*+", re.I), re.compile(rf"{_LABEL}(?:{_ANY_DOT}{_LABEL})*+", re.I)
_TOP = re.compile(r"[A-Za-z]{2,24}\Z")
#: What any disguise of MAIL holds; for lower-cased text, like RUN_HINTS.
MAIL_HINTS = (
    re.compile(rf"[(\[{{<] {{0,2}}(?:{_AT}|a|@|{_DOT}|\.) {{0,2}}[)\]}}>]"),
    re.compile(rf" (?:{'|'.join(AT[1:])}|{_DOT}|@) "),
    re.compile(rf"[_-](?:{_AT}|{_DOT})[_-]|{_CODED_AT}|{_CODED_DOT}"),
)
_AT_SIGN, _DOT_SIGN = re.compile(_ANY_AT, re.I), re.compile(_ANY_DOT, re.I)
_HIDDEN_AT = re.compile(rf"[(\[{{<&%]|(?:{'|'.join(AT[1:])})| @ ", re.I)
_HIDDEN_DOT = re.compile(rf"[(\[{{<&]|[ _-](?:{_DOT})[ _-]", re.I)
#: Dots that no sentence holds; the other words for a dot are words of a language too.
_SURE_DOT = re.compile(rf"[(\[{{<&]|[ _-]{DOT[0]}[ _-]", re.I)
#: A run of digits of which some, or dots and dashes between them, may be words or in brackets.
#: What separates two numbers is matched in one way only, so that time stays linear.
_GAP = r"(?:[ ]?[()][ ]?|[ ,.-]{1,2})"
_SIGN = rf"(?:{_B}(?:{_DOT}|dash|[.-]){_E}|[ ]{{0,2}}(?:{_DOT}|dash)[ ]{{0,2}})"
_BETWEEN = rf"(?>{_GAP}(?:(?:{_DOT}|dash){_GAP})+|{_SIGN}|{_GAP})"
_MIXED = r"(?=[oli]*+[0-9])[0-9oli]++(?!\w)"
_NUMBER = rf"(?:(?:{_WORD})(?!\w)|[0-9]++(?:(?!\w)|(?=(?:{_DOT}|dash)[0-9]))|{_MIXED})"
RUN = re.compile(rf"(?<![\w])(?:plus[ ]|\+[ ]?)?\(?{_NUMBER}(?:{_BETWEEN}{_NUMBER})+", re.I)
_RUN_PART = re.compile(rf"plus[ ]|\+[ ]|(?:{_WORD})(?!\w)|{_MIXED}|[0-9]+|{_SIGN}|.", re.I | re.S)
_VALUE = re.compile(rf"(?:{_WORD})(?!\w)|[0-9oli]+", re.I)
#: A run shorter than this in numbers and in digits is no identifier, if no plus sign stands in the text.
_NUMBERS, _DIGITS = 4, 8
_ANY_GAP = r"[ ,.()\[\]{}<>-]{1,12}"
_FIRST = "".join(sorted({w[0] for w in DIGITS}))
#: What any disguise of RUN holds, in a text that a space was put before.
RUN_HINTS = (
    re.compile(rf"[^a-z0-9_à-öø-ÿ](?=[{_FIRST}])(?:{_WORD}){_ANY_GAP}(?:(?:{_WORD})\b|[0-9oli]|{_DOT}|dash)"),
    re.compile(rf"[0-9oli](?:{_ANY_GAP}(?:(?:{_WORD})\b|{_DOT}|dash)|(?:{_DOT}|dash)[0-9]|{_B}[.-]{_E}[0-9])"),
    re.compile(r"[0-9][oli]|[oli][0-9]"),
)

Piece = tuple[str, int, int]


class Rewritten:
    """A text as pieces (what it says now, the span it came from in the text below)."""

    def __init__(self, pieces: list[Piece], below: "Rewritten | None" = None):
        self.pieces, self.below = pieces, below
        self.text = "".join(p[0] for p in pieces)
        self.at = [0, *accumulate(len(p[0]) for p in pieces)]

    def _piece(self, place: int) -> tuple[Piece, int]:
        """The piece that a character is in, and its place there."""
        k = bisect_right(self.at, place) - 1
        return self.pieces[k], place - self.at[k]

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The span of the first source that a span of this text came from."""
        (said, a, b), i = self._piece(start)
        first = a + i if b - a == len(said) else a
        (said, a, b), i = self._piece(end - 1)
        last = a + i + 1 if b - a == len(said) else b
        return self.below.source(first, last) if self.below else (first, last)

    def then(self, pieces: list[Piece]) -> "Rewritten":
        """The rewriting of this text by ``pieces``; itself if they change nothing."""
        return Rewritten(pieces, self) if len(pieces) > 1 else self


def unmask_letters(text: str, odd: set[str]) -> Rewritten:
    """Look-alike and invisible characters, which ``odd`` is made of."""
    pieces, since = [], 0
    for m in re.finditer(f"[{re.escape(''.join(odd))}]", text):
        pieces += [(text[since : m.start()], since, m.start()), (_plain(m.group()), m.start(), m.end())]
        since = m.end()
    return Rewritten([*pieces, (text[since:], since, len(text))])


def unmask_digits(text: str, joined: bool = False) -> list[Piece]:
    """Runs with a word or a disguised sign: words become digits, and the gaps between two words go.

    ``joined`` is the other reading of a run: gaps between a word and a numeral go as well, and a dot without
    spaces stays.
    """
    pieces, since = [], 0
    plus = "+" in text or "plus " in text.lower()
    for m in RUN.finditer(text):
        numbers = _VALUE.findall(m.group())
        if not plus and len(numbers) < _NUMBERS and sum(len(_said(n) or n) for n in numbers) < _DIGITS:
            continue
        if m.group()[0].isalpha() and _LARGER.search(text, max(0, m.start() - 16), m.start()):
            continue
        parts = [(p.group(), m.start() + p.start(), m.start() + p.end()) for p in _RUN_PART.finditer(m.group())]
        said = [_said(part) for part, _, _ in parts]
        if not any(said):
            continue
        pieces.append((text[since : m.start()], since, m.start()))
        spelled = before = False  # what stands before the gap is a word; is a word or a numeral
        for k, (part, a, b) in enumerate(parts):
            if part in " ,.-":
                after = _next(parts, k)
                word_after = after is not None and said[after] is not None
                if joined:
                    tight = part == "." and after == k + 1 and parts[k - 1][0] not in " ,.-"
                    gone = part != "-" and not tight and before and after is not None and (spelled or word_after)
                else:
                    gone = part != "-" and spelled and word_after
                pieces.append(("" if gone else part, a, b))
                continue
            if part.lower() == "plus " or part == "+ ":
                pieces.append(("+", a, b))
            else:
                pieces.append((said[k] or part, a, b))
            spelled, before = said[k] is not None, said[k] is not None or part.isdigit()
        since = m.end()
    return [*pieces, (text[since:], since, len(text))]


_MIX = frozenset("0123456789oli")


def _said(part: str) -> str | None:
    """What a spelled digit or a disguised sign stands for."""
    low = part.lower().strip(" ()[]{}<>")
    if low in DIGITS:
        return DIGITS[low]
    if low[:1].isalpha() and (large := _large(low)):
        return large
    if low[:1] in _MIX and not low.isdigit() and low.strip("0123456789oli") == "":
        return low.translate(LETTER_DIGITS)
    if low in DOT or low == "." and part != "." and part[0] in " ([{<":
        return "."
    return "-" if low == "dash" or low == "-" and part[0] in " ([{<" else None


@lru_cache(maxsize=4096)
def _large(said: str) -> str | None:
    """The digits of an English number of ten and more, or None."""
    if not re.fullmatch(_LARGE, said):
        return None
    total = 0
    for word in re.split("[ -]", said):
        if word == "hundred":
            total *= 100
        elif word in TENS:
            total += 10 * (TENS.index(word) + 2)
        elif word in TEENS:
            total += TEENS.index(word) + 10
        elif word != "and":
            total += int(DIGITS[word])
    return str(total)


def _next(parts: list[Piece], k: int) -> int | None:
    """The first part after ``k`` that is a number or a sign, if only gaps come before it."""
    for i in range(k + 1, len(parts)):
        part = parts[i][0]
        if part not in " ,.-":
            return i if part.isdigit() or _said(part) is not None else None
    return None


def _disguised(user: str, at: str, host: str) -> bool:
    """Whether an address is written so that it must be meant as one, and not plainly."""
    if at == "@":
        return bool(_HIDDEN_DOT.search(host) or _SURE_DOT.search(user))
    if at.strip(" _-").lower() != AT[0]:
        return bool(_HIDDEN_AT.search(at))
    if at.strip(" ") == "AT" and user != user.upper() and host != host.upper():
        return True
    if not _SURE_DOT.search(host) and len(_HIDDEN_DOT.findall(host)) < 2:
        return False
    # A word that any sentence may hold.
    return at[0] != " " or user.lower() not in BEFORE_AT and _DOT_SIGN.split(host, maxsplit=1)[0].lower() not in AFTER_AT


def _addresses(text: str):
    """The spans (user, at, host) of addresses, disguised or not."""
    since = 0
    while user := USER.search(text, since):
        start, since = user.start(), user.end()
        at = _AT_SIGN.match(text, since)
        host = at and HOST.match(text, at.end())
        if not host:
            continue
        if start and text[start - 1] in _LOCAL_CHARS:  # it begins inside something else, but may have parts that don't
            start = next((d.end() for d in _DOT_SIGN.finditer(text, start, since) if text[d.end() - 1] not in _LOCAL_CHARS), None)
            if start is None:
                continue
        # The labels up to the last that can end a domain.
        ends = [(d.start(), d.end()) for d in _DOT_SIGN.finditer(text, host.start(), host.end())]
        starts, stops = [host.start(), *(e for _, e in ends)], [*(e for e, _ in ends), host.end()]
        last = next((k for k in range(len(starts) - 1, 0, -1) if _TOP.match(text[starts[k] : stops[k]])), None)
        if last and all(text[e - 1] != "-" for e in stops[: last + 1]):
            since = stops[last]
            yield (start, user.end()), at.span(), (host.start(), stops[last])


def unmask_signs(text: str) -> list[Piece]:
    """At and dot disguises; a bare "at" counts only in capitals, beside the word "dot", a dot in brackets, or two other words for it, and not where a sentence would have it."""
    pieces, since = [], 0
    for user, at, host in _addresses(text):
        if not _disguised(text[slice(*user)], text[slice(*at)], text[slice(*host)]):
            continue
        pieces.append((text[since : user[0]], since, user[0]))
        for (a, b), sign in ((user, None), (at, "@"), (host, None)):
            if sign:
                pieces.append((sign, a, b))
                continue
            here = a
            for d in _DOT_SIGN.finditer(text, a, b):
                pieces += [(text[here : d.start()], here, d.start()), (".", d.start(), d.end())]
                here = d.end()
            pieces.append((text[here:b], here, b))
        since = host[1]
    return [*pieces, (text[since:], since, len(text))]


def added_spans(text: str, base: list[Span]) -> list[Span]:
    """Identifiers that show only after rewriting, in offsets of the source."""
    odd = set() if text.isascii() else {c for c in set(text) if c > "\x7f" and _plain(c) != c}
    now = unmask_letters(text, odd) if odd else Rewritten([(text, 0, len(text))])
    low = " " + now.text.lower()
    runs, signs = any(h.search(low) for h in RUN_HINTS), " AT " in now.text or any(h.search(low) for h in MAIL_HINTS)
    if not odd and not runs and not signs:
        return []
    readings = [now]
    if runs:
        readings = [now.then(unmask_digits(now.text))]
        other = now.then(unmask_digits(now.text, joined=True))
        readings += [other] if other.text != readings[0].text else []
    known, found = set(base), []
    for k, read in enumerate(readings):
        read = read.then(unmask_signs(read.text)) if signs else read
        if not read.below and not odd:
            found.append([])  # the hints were wrong
            continue
        spans = []
        for kind, a, b in base_spans(read.text):
            span = (kind, *read.source(a, b))
            if span not in known and text[span[1] : span[2]] != read.text[a:b]:
                spans.append(span)
        known.update(spans)
        found.append(spans)
    if len(found) == 2:  # where both readings see one identifier, the longer span stands
        more = found[1]
        return more + [s for s in found[0] if not any(s[0] == t[0] and t[1] <= s[1] and s[2] <= t[2] for t in more)]
    return found[0]


def find(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans: kinds in the order of KINDS, then by start and end."""
    text = text or ""
    base = base_spans(text)
    more = added_spans(text, base)
    return base, sorted(base + more, key=lambda s: (KINDS.index(s[0]), s[1], s[2])) if more else base


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def mask(text: str | None) -> str | None:
    """The text with each identifier replaced by its kind; overlapping spans become one."""
    if text is None:
        return None
    out, at = [], 0
    for kind, a, b in sorted(find(text)[1], key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]]) if out else text


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, numbers of base spans by kind, base_sha256 and spans of each document."""
    prepare(docs.sparkSession)
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

    def run(batches):
        for batch in batches:
            rows = []
            for text in tokens.texts_of(batch.column(1)):
                base, every = find(text)
                counts = [sum(s[0] == k for s in base) for k in KINDS]
                rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), [*[pa.int64()] * 4, pa.string(), pa.string()])]
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(docs: DataFrame) -> DataFrame:
    """The documents with identifiers masked in ``text`` and ``n_chars``, if there is one, counted anew."""
    prepare(docs.sparkSession)
    text_at = docs.columns.index("text")
    count_at = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches):
        for batch in batches:
            masked = [mask(t) for t in batch.column(text_at).to_pylist()]
            columns = list(batch.columns)
            columns[text_at] = pa.array(masked, batch.schema.field(text_at).type)
            if count_at is not None:
                old = batch.column(text_at).to_pylist()
                counts = batch.column(count_at).to_pylist()
                columns[count_at] = pa.array([n if a == b else len(b) for a, b, n in zip(old, masked, counts)], batch.schema.field(count_at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
