"""Personal data by anchor expansion.

One Aho-Corasick automaton finds all anchors of a text in one pass: at-signs, plus signs, digits, URL schemes and cue
words.  At an anchor a local parser decides where the value begins and ends and whether it is valid; text without
anchors is never parsed.

========  =======================  ==============================================================================
kind      anchors                  value
========  =======================  ==============================================================================
email     ``@``                    local part, at-sign, domain with a dot
ip        digits                   four dotted numbers up to 255
card      digits                   14 to 19 digits, blanks or hyphens between, Luhn check
phone     ``+``                    plus sign and 10 to 15 digits
url       ``://``                  user data before the host of a URL, ``user:password@host``
account   ``iban``, ``account`` …  after the cue: an IBAN whose remainder is 1, or 6 to 17 digits
secret    ``token``, ``key`` …     after the cue and ``=`` or ``:``: 16 or more letters, digits and ``+/_-.``, ``=`` at the end, with a digit
handle    ``@``                    at-sign after a blank and 2 or more word characters, where no email is
========  =======================  ==============================================================================

The first four are the base kinds: leftmost, non-overlapping per kind, as a regular expression search finds them.  A
search tries every position; it can only begin at an anchor (email: at the first of the characters before the at-sign),
so trying the anchors in order gives the same matches.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.common import add_column, fresh_name

KINDS = ("email", "ip", "card", "phone", "url", "account", "secret", "handle")
BASE = KINDS[:4]
CUES = {
    "account": ("iban", "account", "acct", "konto", "compte", "cuenta"),
    "secret": ("token", "password", "passwd", "secret", "api_key", "apikey", "api-key"),
}
KIND = "array<struct<kind: string, start: bigint, end: bigint>>"

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_USER = re.compile(r"://([^\s/@]+@[^\s/?#]+)")
_ACCOUNT = re.compile(r"[\x20:#=.]{0,3}(?:no|nr|number)?[\x20:#=.]{0,3}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{2,4}){3,8}|[0-9][0-9-]{4,20}[0-9])")
_SECRET = re.compile(r"[\x20\"']{0,2}[=:][\x20\"']{0,2}([A-Za-z0-9+/_.-]{15,}[A-Za-z0-9+/_-]=*)")
_HANDLE = re.compile(r"@\w{2,}")


#: Cues are found in a copy with A-Z in lower case, which keeps all positions.
_LOWER = {c: c + 32 for c in range(65, 91)}


@lru_cache(maxsize=1)
def _anchors():
    found = ahocorasick.Automaton()
    for c in "0123456789":
        found.add_word(c, ("digit", 1))
    found.add_word("+", ("phone", 1))
    found.add_word("@", ("email", 1))
    found.add_word("://", ("url", 3))
    for kind, cues in CUES.items():
        for cue in cues:
            found.add_word(cue, (kind, len(cue)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def iban(text: str) -> bool:
    text = text.replace(" ", "")
    if not (15 <= len(text) <= 34 and text[:2].isalpha()):
        return False
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _email(text: str, at: int, free: int):
    """The address around an at-sign; the local part begins where the last email ended at the earliest."""
    start = at
    while start > free and text[start - 1] in _LOCAL:
        start -= 1
    if start < at and (m := _DOMAIN.match(text, at)):
        return start, m.end()
    return None


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` by start, then kind as listed; code points, end exclusive."""
    text = text or ""
    out, end = [], dict.fromkeys(KINDS, 0)

    def add(kind, a, b):
        out.append((kind, a, b))
        end[kind] = b

    for last, (what, length) in _anchors().iter(text.translate(_LOWER)):
        at = last + 1 - length
        if what == "digit":
            inside = at > 0 and "0" <= text[at - 1] <= "9"  # where a run of digits fails, so does every part of it
            if not inside and at >= end["ip"] and (m := _IP.match(text, at)):
                end["ip"] = m.end()
                if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split(".")):
                    out.append(("ip", at, m.end()))
            if at >= end["card"] and (m := _CARD.match(text, at)):
                end["card"] = m.end()
                digits = _digits(m[0])
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", at, m.end()))
        elif what == "phone":
            if at >= end["phone"] and (m := _PHONE.match(text, at)):
                end["phone"] = m.end()
                if 10 <= len(_digits(m[0])) <= 15:
                    out.append(("phone", at, m.end()))
        elif what == "email":
            if at < end["email"]:
                continue
            if found := _email(text, at, end["email"]):
                add("email", *found)
            elif at >= end["handle"] and (at == 0 or text[at - 1].isspace()) and (m := _HANDLE.match(text, at)):
                add("handle", at, m.end())
        elif what == "url":
            if at >= end["url"] and (m := _USER.match(text, at)):
                add("url", *m.span(1))
        elif at >= end[what]:
            m = (_ACCOUNT if what == "account" else _SECRET).match(text, last + 1)
            if m and what == "account" and (m[1].replace("-", "").isdigit() and 6 <= len(_digits(m[1])) <= 17 or iban(m[1])):
                add(what, *m.span(1))
            elif m and what == "secret" and any(map(str.isdigit, m[1])):
                add(what, *m.span(1))
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(out, key=lambda s: (s[1], order[s[0]]))


def with_spans(docs: DataFrame, name: str, text_col: str = "text", keep=None) -> DataFrame:
    """``docs`` with all spans of the text as column ``name``; none for a null or empty text."""
    def make():
        def work(texts):
            return [[{"kind": k, "start": a, "end": b} for k, a, b in spans(t)] for t in texts]
        return work

    return add_column(docs, {"text": F.col(text_col)}, name, KIND, make, keep)


def _joined(found):
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _count(found: str, kind: str):
    return F.size(F.filter(found, lambda s: s["kind"] == F.lit(kind))).cast("long")


def pii_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans``.

    A null or empty text has no spans; repeated rows get a row each, an empty table none; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = with_spans(rows, "found", keep=["doc_id"])
    base = F.filter("found", lambda s: s["kind"].isin(list(BASE)))
    return found.select(
        "doc_id",
        *[_count("found", kind).alias(f"n_{kind}") for kind in BASE],
        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))


def redact(text: str | None) -> str | None:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first, longest one counts."""
    if text is None:
        return None
    out, at = [], 0
    for kind, a, b in sorted(spans(text), key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
            at = b
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with personal data replaced, columns as before."""
    name = fresh_name(docs.columns, "_text")
    out = add_column(docs, {"text": F.col(text_col)}, name, "string", lambda: lambda texts: list(map(redact, texts)))
    return out.withColumn(text_col, F.col(name)).select(*docs.columns)


def base_digest(found: list[tuple[str, int, int]]) -> str:
    """``base_sha256`` of a list of spans."""
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in found if k in BASE).encode()).hexdigest()
