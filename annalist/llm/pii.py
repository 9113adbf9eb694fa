"""Personal data by anchor expansion.

One Aho-Corasick pass finds at-signs, plus signs, URL schemes and identifier cues; deterministic local parsers expand
from each anchor to the boundaries of an e-mail address, a phone number, an account number or credentials in a URL and
validate it. Digit groups (IP addresses, card numbers) anchor on runs of digits. Work is linear in the text.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.llm.common import map_arrow, table

BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("account", "url")
#: Identifier cues, followed at once or after a few marks by the identifier.
CUES = ("iban", "account", "acct", "konto", "compte", "cuenta", "ssn", "passport")
#: Digits that an identifier of digits alone may have, by its cue.
DIGITS = {"iban": (1, 0), "account": (8, 20), "acct": (8, 20), "konto": (8, 20), "compte": (8, 20), "cuenta": (8, 20), "ssn": (9, 9), "passport": (6, 9)}
SCHEMES = ("http://", "https://", "ftp://", "ssh://", "sftp://", "postgres://", "mysql://", "mongodb://", "redis://")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# A match never starts inside a run of digits: a start at the run's head reaches the same end.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_ACCOUNT = re.compile(r"(?:\s*(?:no|nr|number|num|nummer|numero)\b\.?)?[\s:#=.-]{0,4}([A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]{1,4}){3,8}|[0-9](?:[\x20-]?[0-9]){5,19})", re.IGNORECASE | re.ASCII)
_USERINFO = re.compile(r"[A-Za-z0-9._~%!$&'()*+,;=-]+:[^\s/@:]+@[A-Za-z0-9.-]+")
_AUTOMATON = None


def _automaton():
    global _AUTOMATON
    if _AUTOMATON is None:
        import ahocorasick

        found = ahocorasick.Automaton()
        for mark in ("@", "+"):
            found.add_word(mark, (mark, mark))
        for cue in CUES:
            for form in (cue, cue.upper(), cue.capitalize()):
                found.add_word(form, ("cue", form))
        for scheme in SCHEMES:
            for form in (scheme, scheme.upper()):
                found.add_word(form, ("scheme", form))
        found.make_automaton()
        _AUTOMATON = found
    return _AUTOMATON


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    """Check digits of an IBAN: the number of rearranged letters and digits is 1 mod 97."""
    s = text.replace(" ", "").upper()
    if not 15 <= len(s) <= 34:
        return False
    remainder = 0
    for c in s[4:] + s[:4]:
        remainder = (remainder * (100 if c.isalpha() else 10) + int(c, 36)) % 97
    return remainder == 1


def find_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind in code points, end exclusive."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in BASE_KINDS + MORE_KINDS}
    if not text:
        return found
    email_end = phone_end = 0
    for last, (what, form) in _automaton().iter(text):
        if what == "@":
            start = last
            while start > email_end and text[start - 1] in _LOCAL:
                start -= 1
            if start < last and (m := _DOMAIN.match(text, last)):
                found["email"].append((start, m.end()))
                email_end = m.end()
        elif what == "+":
            if last >= phone_end and (m := _PHONE.match(text, last)):
                phone_end = m.end()
                if 9 <= sum(c.isdecimal() for c in m.group()) <= 15:
                    found["phone"].append(m.span())
        elif what == "cue":
            first = last + 1 - len(form)
            if (not first or not text[first - 1].isalnum()) and (m := _ACCOUNT.match(text, last + 1)):
                number = m.group(1)
                if not number[0].isdecimal():  # the longest start of it that validates
                    number = next((number[:n] for n in range(len(number), 14, -1) if number[n - 1] != " " and iban_valid(number[:n])), "")
                elif not DIGITS[form.lower()][0] <= sum(c.isdecimal() for c in number) <= DIGITS[form.lower()][1]:
                    number = ""
                if number:
                    found["account"].append((m.start(1), m.start(1) + len(number)))
        elif m := _USERINFO.match(text, last + 1):
            found["url"].append((last + 1 - len(form), m.end()))
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in m.group().split(".")):
            found["ip"].append(m.span())
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(digits := m.group().replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            found["card"].append(m.span())
    return found


def join_spans(found: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in sorted(found[k]))


def scan_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, found: array of (kind, start, end, value) with the text itself, in order of kind and start.

    docs: doc_id, text. A null text is empty; a text without finds gives an empty array; repeated rows stay.
    """

    def run(part: dict) -> dict:
        out = []
        for text in part["text"]:
            spans = find_spans(text or "")
            out.append([{"kind": k, "start": a, "end": b, "value": text[a:b]} for k in BASE_KINDS + MORE_KINDS for a, b in sorted(spans[k])])
        return {"doc_id": part["doc_id"], "found": out}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, run, "doc_id long, found array<struct<kind:string,start:long,end:long,value:string>>")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_personal_data(table(spark, sf_dir, "documents"))

    def joined(kinds: tuple[str, ...]):
        kept = F.filter("found", lambda x: x["kind"].isin(*kinds))
        return F.array_join(F.transform(kept, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *map(count, BASE_KINDS),
        F.sha2(joined(BASE_KINDS), 256).alias("base_sha256"),
        joined(BASE_KINDS + MORE_KINDS).alias("spans"),
        F.size("found").cast("long").alias("n_found"),
    )
