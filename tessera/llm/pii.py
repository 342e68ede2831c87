"""Personal data: regular expressions propose, checksums confirm, context words adjust the score.

Base kinds (leftmost, non-overlapping per kind; a match that fails its check is dropped and not
tried again): email, ip (parts at most 255), card (13 to 19 digits passing Luhn), phone (9 to 15
digits). Base spans are always kept. Further kinds are kept from a score of 0.5: iban (mod-97
must be 1), ssn (valid area, group and serial; needs a context word), tel (an international number
inside a longer run that failed as a phone) and pan (a group of 13 to 19 digits passing Luhn inside a
longer run that failed as a card). A context word within ``CONTEXT`` code points before the span,
or right after it, raises the score; a word that names other numbers lowers it.

Spans are (kind, start, end, score) in code points, end exclusive. Defined results: null and
empty texts have no span; spans of different kinds may overlap; rows repeat as they are; a
null ``doc_id`` keeps its row; an empty table gives no row; other columns are kept, but for those
that the result is called by.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import slices

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "tel", "pan")
CONTEXT = 40

# fixed values: the patterns of the base kinds
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+").match
# as [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+): a match can only begin at the start of a run of digits, and takes runs whole,
# so nothing is tried again inside a run and the time is linear
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}").finditer
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+").finditer
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]").finditer

_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])").search
_IBAN_SIZE = {c[:2]: int(c[2:]) for c in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 "
    "FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 "
    "LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 "
    "ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20").split()}
_SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])").finditer
_TEL = re.compile(r"\+[0-9]{1,3} ?\([0-9]{2,4}\) ?[0-9]{3}[ -][0-9]{4}(?![0-9])").finditer
_RUN = re.compile(r"(?<![0-9])[0-9]{13,19}(?![0-9])|(?<![0-9])[0-9]{4}(?:[ -][0-9]{4}){3}(?![0-9])").finditer
_DIGIT = re.compile("[0-9]").search

#: Words near a span that make its kind likelier.
WORDS = {
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social security", "social-security"),
    "tel": ("phone", "telephone", "call", "calling", "tel", "mobile", "telefon"),
    "pan": ("card", "visa", "mastercard", "amex", "credit", "karte", "kreditkarte", "carte", "tarjeta"),
    "email": ("mail", "email", "contact", "write"), "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "mastercard", "amex", "credit"),
    "phone": ("phone", "telephone", "call", "calling", "tel", "mobile"),
}
#: Words that name other long numbers.
AGAINST = ("isbn", "order", "invoice", "version", "serial", "tracking")


def _any_word(words: tuple[str, ...]):
    """Whole words (or their plural) only: ``tel`` is not in ``hotel``."""
    return re.compile(rf"(?<![^\W\d_])(?:{'|'.join(words)})s?(?![^\W\d_])").search


_NEAR = {kind: _any_word(words) for kind, words in WORDS.items()}
_AGAINST = _any_word(AGAINST)
START = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.3, "tel": 0.7, "pan": 0.6}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    if not 15 <= len(s) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _is_byte(digits: str) -> bool:
    """At most 255, however many zeros come first."""
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or 0) <= 255


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> list[tuple[int, int]]:
    out, past = [], 0
    at = text.find("@")
    while at >= 0:
        # the local part is the whole run before the sign, from the end of the last match on
        s = at
        while s > past and text[s - 1] in _LOCAL:
            s -= 1
        m = _DOMAIN(text, at) if s < at else None
        if m:
            past = m.end()
            out.append((s, past))
        at = text.find("@", max(at + 1, past))
    return out


def _ibans(text: str) -> list[tuple[int, int]]:
    """A match may have taken following words in: the country's length comes first, then all, then (unknown
    country) up to three groups less. The search goes on behind a number, or inside a match that has none."""
    out = []
    m = _IBAN(text)
    while m:
        s, e = m.span()
        ends = [e]
        size = _IBAN_SIZE.get(text[s:s + 2])
        if size:
            at = [i + 1 for i in range(s, e) if text[i] != " "]
            if len(at) > size and text[at[size - 1]] == " ":
                ends = [at[size - 1], e]
        else:
            for _ in range(3):
                ends.append(text.rfind(" ", s, ends[-1]))
                if ends[-1] < 0:
                    ends.pop()
                    break
        end = next((x for x in ends if mod97(text[s:x])), None)
        if end:
            out.append((s, end))
        m = _IBAN(text, end or s + 1)
    return out


def _context(text: str, start: int, end: int) -> str:
    """What stands around a span, without the parts of words that the window cuts."""
    lo, hi = max(0, start - CONTEXT), min(len(text), end + CONTEXT // 2)
    before, after = text[lo:start], text[end:hi]
    if lo and text[lo - 1].isalpha():
        before = _tail(before)
    if hi < len(text) and text[hi].isalpha():
        after = _tail(after[::-1])[::-1]
    return (before + " " + after).lower()


def _tail(s: str) -> str:
    """``s`` from its first character on that is no letter."""
    return s[next((i for i, c in enumerate(s) if not c.isalpha()), len(s)):]


def _score(kind: str, text: str, start: int, end: int) -> float:
    near = _context(text, start, end)
    score = START[kind]
    if _NEAR[kind](near):
        score += 0.3
    if _AGAINST(near):
        score -= 0.3
    return round(min(max(score, 0.0), 1.0), 2)


def find_spans(text: str) -> list[tuple[str, int, int, float]]:
    """All spans by kind as listed, then start."""
    found: dict[str, list[tuple[int, int]]] = {}
    if "@" in text:
        found["email"] = _emails(text)
    if _DIGIT(text):
        found["ip"] = [m.span() for m in _IP(text) if all(map(_is_byte, m.group().split(".")))]
        failed = []
        found["card"] = []
        for m in _CARD(text):
            d = _digits(m.group())
            if 13 <= len(d) <= 19 and luhn(d):
                found["card"].append(m.span())
            elif len(d) > 13:
                failed.append(m)
        found["pan"] = [(m.start() + r.start(), m.start() + r.end()) for m in failed for r in _RUN(m.group())
                        if luhn(_digits(r.group()))]
        if "+" in text:
            failed = []
            found["phone"] = []
            for m in _PHONE(text):
                if 9 <= len(_digits(m.group())) <= 15:
                    found["phone"].append(m.span())
                else:
                    failed.append(m)
            found["tel"] = [(m.start() + r.start(), m.start() + r.end()) for m in failed for r in _TEL(m.group())]
        found["iban"] = _ibans(text)
        found["ssn"] = [m.span() for m in _SSN(text)
                        if m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000"]
    out = []
    for kind in KINDS:
        for s, e in found.get(kind, ()):
            score = _score(kind, text, s, e)
            if kind in KINDS[:4] or score >= 0.5:
                out.append((kind, s, e, score))
    return out


def mask(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """The text with every covered stretch replaced by the kind (of its first span) in angle brackets."""
    out, at = [], 0
    for kind, s, e, _ in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"<{kind}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
                            ("score", pa.float64())]))


def find_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Every row with ``spans array<struct<kind, start, end, score>>`` and ``masked string`` added."""
    rest = docs.drop("spans", "masked")
    names = rest.columns

    def run(batches):
        for b in slices(batches, text_col):
            spans, masked = [], []
            for t in b.column(text_col).to_pylist():
                s = find_spans(t) if t else []
                spans.append([dict(zip(("kind", "start", "end", "score"), x)) for x in s])
                masked.append(mask(t, s) if s else t)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(spans, SPANS), pa.array(masked, pa.string())],
                                             [*names, "spans", "masked"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields)
    return rest.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(
        run, f"{kinds}, spans array<struct<kind string, start int, end int, score double>>, masked string")
