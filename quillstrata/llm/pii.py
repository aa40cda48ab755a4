"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, URI schemes and identifier cues. At each
anchor a deterministic local parser expands to the boundaries of an email, an IP address, a card or phone number, a
personal URI or an account identifier, and validates it. Parsers of one kind never look back past the end of their last
match, so that spans of a kind are the leftmost non-overlapping ones and a text is read in linear time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order that breaks ties between spans of one start. The first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "uri", "account")
BASE = KINDS[:4]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_USERINFO = re.compile(r"[^\s/?#@<>\"']+@(?:\[[0-9A-Fa-f:.]+\]|[A-Za-z0-9.-]+)(?::[0-9]+)?(?:[/?#][^\s<>\"']*)?")
_HANDLE = re.compile(r"[A-Za-z0-9+._%@-]*[A-Za-z0-9]")
_ACCOUNT = re.compile(r"(?: ?(?:account|number|num|no|nr|id|code|#)\.?)? ?[:=#]? ?((?:[A-Z]{1,4}[ -]?)?[0-9](?:[ -]?[A-Z0-9]){5,33})(?![A-Za-z0-9])")
_USER = re.compile(r" ?[:=] ?([A-Za-z0-9][A-Za-z0-9._-]{1,31}[A-Za-z0-9])")

_ACCOUNT_CUES = ("account", "acct", "iban", "passport", "ssn", "social security", "customer id", "member id", "tax id", "routing")
_USER_CUES = ("username", "user name", "user id", "userid", "login")
_HANDLE_CUES = ("mailto:", "tel:", "sip:", "skype:")


@cache
def anchors() -> ahocorasick.Automaton:
    """Cues are matched in lower case, in capitals and with a capital first letter."""
    found = ahocorasick.Automaton()
    for word in ("@", "+", "://", *"0123456789"):
        found.add_word(word, ("digit" if word.isdigit() else word, len(word)))
    for kind, cues in (("account", _ACCOUNT_CUES), ("user", _USER_CUES), ("handle", _HANDLE_CUES)):
        for cue in cues:
            for form in {cue, cue.upper(), cue.capitalize()}:
                found.add_word(form, (kind, len(form)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _iban(value: str) -> bool:
    compact = re.sub("[ -]", "", value)
    if not re.fullmatch("[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}", compact):
        return False
    return int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def scan(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) of each span, in the order in which anchors are met; code points, end exclusive."""
    end = dict.fromkeys(KINDS, 0)
    for last, (anchor, size) in anchors().iter(text):
        at = last - size + 1
        if anchor == "digit":
            if at and text[at - 1] in "0123456789":
                continue
            if at >= end["ip"] and (m := _IP.match(text, at)):
                end["ip"] = m.end()
                if all(map(_small, m.groups())):
                    yield at, m.end(), "ip"
            if at >= end["card"] and (m := _CARD.match(text, at)):
                end["card"] = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    yield at, m.end(), "card"
        elif anchor == "@":
            start = at
            while start > end["email"] and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                end["email"] = m.end()
                yield start, m.end(), "email"
        elif anchor == "+":
            if at >= end["phone"] and (m := _PHONE.match(text, at)):
                end["phone"] = m.end()
                if 10 <= sum(map(m[0].count, "0123456789")) <= 15:
                    yield at, m.end(), "phone"
        elif anchor == "://":
            start = at
            while start > max(end["uri"], at - 32) and text[start - 1].isascii() and text[start - 1].isalpha():
                start -= 1
            if start < at and (m := _USERINFO.match(text, last + 1)):
                end["uri"] = m.end()
                yield start, m.end(), "uri"
        elif at and text[at - 1].isalnum():
            continue  # a cue inside a word
        elif anchor == "handle":
            if at >= end["uri"] and (m := _HANDLE.match(text, last + 1)) and ("@" in m[0] or sum(map(m[0].count, "0123456789")) >= 6):
                end["uri"] = m.end()
                yield at, m.end(), "uri"
        elif last + 1 >= end["account"]:
            m = (_ACCOUNT if anchor == "account" else _USER).match(text, last + 1)
            if m and (anchor == "user" or sum(map(m[1].count, "0123456789")) >= 6 or _iban(m[1])):
                end["account"] = m.end(1)
                yield m.start(1), m.end(1), "account"


def find(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all spans by start, then kind."""
    order = {kind: i for i, kind in enumerate(KINDS)}
    return [(kind, start, end) for start, _, end, kind in sorted((s, order[k], e, k) for s, e, k in scan(text or ""))]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


FIELDS = {f"n_{k}": "bigint" for k in BASE} | {"base_sha256": "string", "spans": "string"}


def personal(text: Column) -> Column:
    """A struct of n_email, n_ip, n_card, n_phone (base spans), base_sha256 and spans; a null text counts as empty."""

    @F.arrow_udf("struct<" + ", ".join(f"{k}: {v}" for k, v in FIELDS.items()) + ">")
    def run(texts: pa.Array) -> pa.Array:
        rows = []
        for text in texts:
            spans = find(text.as_py())
            base = [s for s in spans if s[0] in BASE]
            counts = [sum(s[0] == kind for s in base) for kind in BASE]
            rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
        columns = list(zip(*rows, strict=True)) or [()] * len(FIELDS)
        kinds = [pa.string() if v == "string" else pa.int64() for v in FIELDS.values()]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], list(FIELDS))

    return run(text)


def find_personal(docs: DataFrame) -> DataFrame:
    """doc_id and FIELDS for each row; other columns are not read, so they may have any name.

    Null and empty texts have no spans; null ids stay null; repeated rows give repeated results; very long texts are read in
    whole; spans of one start are ordered by kind; an empty table gives an empty one.
    """
    done = docs.select("doc_id", personal(F.col("text")).alias("_pii"))
    return done.select("doc_id", *(F.col(f"_pii.{k}").alias(k) for k in FIELDS))


def redact(text: str | None, mask: str = "[{}]") -> str | None:
    """The text with each span replaced by its kind; overlapping spans are replaced together under the first one's kind."""
    if not text:
        return text
    out, at = [], 0
    for kind, start, end in find(text):
        if start >= at:
            out += [text[at:start], mask.format(kind.upper())]
        at = max(at, end)
    return "".join([*out, text[at:]])
