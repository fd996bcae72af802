"""Secret scans: Aho-Corasick keyword prefilter, anchored patterns near hits, embedded checksums.

One automaton pass over each text finds the rules' keywords.  A rule's regular
expression is tried only at a hit of its keyword (anchored: the match must contain the
keyword hit) and runs to the secret's own end, however far that is; no text is read again for
each of many hits in it, so the cost follows the hits and what they match.  A match counts
only if the rule's checksum holds:

* ``github``/``npm`` tokens end in six base-62 digits of the CRC-32 of their entropy,
* card numbers satisfy Luhn, IBANs satisfy mod 97; where digits or words that follow could belong to
  the number, each end that leaves a whole number is tried, the issuer's or country's length first,
* a number without such a word (card, visa, ...) before it counts as a card's only if it has an issuer's
  first digits and one of their lengths as well,
* generic assignments (``token = "..."``) need a Shannon entropy of 3 bits a character
  and, for hexadecimal digests, at least 8 different digits.

A private key runs to its END line, whatever header lines it has; one that is cut off before it
has the base64 lines that follow BEGIN.

Defined results: a null or empty text has no secrets; texts are scanned whole; of
overlapping matches the longest earliest one stays (ties: the rule listed first);
repeated rows each give their own rows; an empty table gives an empty result; other
columns of ``docs`` are never touched by :func:`scan`.
"""

from __future__ import annotations

import binascii
import math
import re
from collections import Counter

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import read, text_documents

_B62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62_crc(payload: str) -> str:
    n, out = binascii.crc32(payload.encode()), ""
    while n:
        n, r = divmod(n, 62)
        out = _B62[r] + out
    return out.rjust(6, "0")


def crc_suffix(token: str) -> bool:
    body = token.split("_", 1)[1]
    return base62_crc(body[:-6]) == body[-6:]


def luhn(token: str) -> bool:
    digits = [int(c) for c in token if c.isdigit()]
    odd = digits[-1::-2]
    even = [2 * d - 9 * (d > 4) for d in digits[-2::-2]]
    return len(set(digits)) > 1 and (sum(odd) + sum(even)) % 10 == 0


def iban(token: str) -> bool:
    t = token.replace(" ", "").upper()
    return int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1


def entropy(counts: Counter) -> float:
    n = sum(counts.values())
    return -sum(c / n * math.log2(c / n) for c in counts.values() if c)


def random_looking(token: str | Counter) -> bool:
    counts = Counter(token)
    return sum(c > 0 for c in counts.values()) >= 8 and entropy(counts) >= 3.0


def always(_: str) -> bool:
    return True


class Span:
    """The group ``s`` of a match that a pattern alone does not give."""

    def __init__(self, text: str, start: int, end: int):
        self.text, self.at, self.to = text, start, end

    def start(self, _: str) -> int:
        return self.at

    def end(self, _: str) -> int:
        return self.to

    def __getitem__(self, _: str) -> str:
        return self.text[self.at : self.to]


class PrivateKey:
    """From the BEGIN line to the next END line, or over the base64 lines if another BEGIN or the text's end comes first."""

    body = re.compile(r"(?:(?:\s|\\[nr])*+(?:(?:Proc-Type|DEK-Info): ?[^\n]*+|[A-Za-z0-9+/=]{32,}+))*+(?:(?:\s|\\[nr])*+[A-Za-z0-9+/]*={1,2})?")
    mark = re.compile(r"-----(BEGIN|END) [A-Z0-9 ]*PRIVATE KEY-----")

    def __init__(self, pattern: str):
        self.begin = re.compile(pattern)

    def match(self, text: str, at: int) -> Span | None:
        m = self.begin.match(text, at)
        if not m:
            return None
        other = self.mark.search(text, m.end())
        if other and other[1] == "END":
            return Span(text, at, other.end())
        return Span(text, at, self.body.match(text, m.end(), other.start() if other else len(text)).end())


class SlackToken:
    """A head and the run of characters after it; a run is counted once for all the heads in it."""

    run = re.compile(r"[A-Za-z0-9-]*+")

    def __init__(self, pattern: str):
        self.head = re.compile(pattern)
        self.text, self.at, self.to, self.counts = "", 0, 0, Counter()

    def match(self, text: str, at: int) -> Span | None:
        if not self.head.match(text, at):
            return None
        if text is self.text and self.at <= at < self.to:
            self.counts.subtract(text[self.at : at])
        else:
            self.text, self.to = text, self.run.match(text, at).end()
            self.counts = Counter(text[at : self.to])
        self.at = at
        return Span(text, at, self.to) if random_looking(self.counts) else None


class Ends:
    """A pattern whose match may run on into what follows the secret: the first end whose checksum holds is taken."""

    def __init__(self, pattern: str, ends, valid):
        self.pattern, self.ends, self.valid = re.compile(pattern), ends, valid

    def match(self, text: str, at: int) -> Span | None:
        m = self.pattern.match(text, at)
        if m:
            for n in self.ends(m["s"]):
                if self.valid(m["s"][:n]):
                    return Span(text, m.start("s"), m.start("s") + n)
        return None


def whole_ends(token: str, least: int) -> dict[int, int]:
    """characters other than separators -> end, for each end of that many or more that is not inside a group."""
    out, n = {}, 0
    for i, c in enumerate(token):
        n += c.isalnum()
        if c.isalnum() and n >= least and not token[i + 1 : i + 2].isalnum():
            out[n] = i + 1
    return out


#: first digits (from, to) of an issuer's numbers, and their lengths
ISSUED = [
    (("4", "4"), (16, 19, 13)),
    (("51", "55"), (16,)),
    (("2221", "2720"), (16,)),
    (("34", "34"), (15,)),
    (("37", "37"), (15,)),
    (("300", "305"), (14, 16, 17, 18, 19)),
    (("309", "309"), (14, 16, 17, 18, 19)),
    (("36", "36"), (14, 15, 16, 17, 18, 19)),
    (("38", "39"), (14, 16, 17, 18, 19)),
    (("3528", "3589"), (16, 17, 18, 19)),
    (("2200", "2204"), (16, 17, 18, 19)),
    (("50", "50"), (16, 13, 14, 15, 17, 18, 19)),
    (("56", "58"), (16, 13, 14, 15, 17, 18, 19)),
    (("60", "69"), (16, 19, 18, 17, 15, 14, 13)),
    (("81", "82"), (16, 17, 18, 19)),
]


def issued(token: str) -> list[int]:
    digits = "".join(c for c in token if c.isdigit())
    return [n for (low, high), lengths in ISSUED if low <= digits[: len(low)] <= high for n in lengths]


def card_ends(token: str) -> list[int]:
    ends = whole_ends(token, 13)
    return [ends[n] for n in dict.fromkeys([*issued(token), *sorted(ends, reverse=True)]) if n in ends]


def issued_ends(token: str) -> list[int]:
    ends = whole_ends(token, 13)
    return [ends[n] for n in dict.fromkeys(issued(token)) if n in ends]


#: first two digits, or the one, of ISSUED
ISSUERS = ["4", *(str(n) for n in (*range(22, 28), 30, *range(34, 40), *range(50, 59), *range(60, 70), 81, 82))]

_IBAN = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 "
    "HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 "
    "RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
)
#: length of an IBAN by country
IBAN_LENGTH = {x[:2]: int(x[2:]) for x in _IBAN.split()}


def iban_ends(token: str) -> list[int]:
    ends = whole_ends(token, 15)
    if own := IBAN_LENGTH.get(token[:2]):
        return list(dict.fromkeys([*[ends[own]] * (own in ends), len(token)]))
    return sorted(ends.values(), reverse=True)


_NAMES = "(?i:token|secret|passw(?:or)?d|api[_-]?key|access_key|auth_key)"

#: name, keywords (lower case), pattern whose group ``s`` is the secret, what matches it from the keyword, ends of a match to try, validator
RULES = [
    ("github_token", ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"], r"(?<![A-Za-z0-9])(?P<s>gh[pousr]_[A-Za-z0-9]{36})(?![A-Za-z0-9])", re.compile, None, crc_suffix),
    ("npm_token", ["npm_"], r"(?<![A-Za-z0-9])(?P<s>npm_[A-Za-z0-9]{36})(?![A-Za-z0-9])", re.compile, None, crc_suffix),
    ("aws_access_key", ["akia", "asia"], r"(?<![A-Za-z0-9])(?P<s>A[KS]IA[A-Z2-7]{16})(?![A-Za-z0-9])", re.compile, None, random_looking),
    ("google_api_key", ["aiza"], r"(?<![A-Za-z0-9_-])(?P<s>AIza[A-Za-z0-9_-]{35})(?![A-Za-z0-9_-])", re.compile, None, random_looking),
    ("slack_token", ["xoxb-", "xoxp-", "xoxa-", "xoxr-", "xoxs-"], r"(?P<s>xox[abprs]-[A-Za-z0-9-]{10})", SlackToken, None, always),
    ("gitlab_token", ["glpat-"], r"(?P<s>glpat-[A-Za-z0-9_-]{20})(?![A-Za-z0-9_-])", re.compile, None, random_looking),
    ("stripe_key", ["sk_live_", "rk_live_", "sk_test_"], r"(?P<s>[sr]k_(?:live|test)_[A-Za-z0-9]{16,}+)", re.compile, None, random_looking),
    ("private_key", ["-----begin"], r"(?P<s>-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----)", PrivateKey, None, always),
    ("jwt", ["eyj"], r"(?<![A-Za-z0-9_-])(?P<s>eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)", re.compile, None, always),
    ("iban", ["iban"], r"(?i:iban)[\s:=]++(?P<s>[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])", Ends, iban_ends, iban),
    ("card", ["card", "visa", "mastercard"], r"(?i:card|visa|mastercard)[^0-9\n]{0,24}(?P<s>[0-9](?:[ -]?[0-9]){12,18})(?![0-9])", Ends, card_ends, luhn),
    ("card", ISSUERS, r"(?<![A-Za-z0-9])(?P<s>[0-9](?:[ -]?[0-9]){12,18})(?![A-Za-z0-9])", Ends, issued_ends, luhn),
    (
        "assigned_secret",
        ["token", "secret", "passwd", "password", "api_key", "apikey", "api-key", "access_key", "auth_key"],
        _NAMES + rf"(?:(?!{_NAMES})[A-Za-z_])*+[\"']?\s*+(?::=|=>|=|:)\s*+[\"'`](?P<s>[A-Za-z0-9_\-+/=.~]{{16,}}+)[\"'`]",
        re.compile,
        None,
        random_looking,
    ),
]
_state: dict = {}


def _automaton():
    if not _state:
        auto, of = ahocorasick.Automaton(), {}
        for k, (_, words, *_rest) in enumerate(RULES):
            for w in words:
                of.setdefault(w, []).append(k)
        for w, ks in of.items():
            auto.add_word(w, (len(w), tuple(ks)))
        auto.make_automaton()
        _state["auto"], _state["re"] = auto, [r[3](r[2], r[4], r[5]) if r[4] else r[3](r[2]) for r in RULES]
    return _state["auto"], _state["re"]


def _ascii_lower(text: str) -> str:
    """Lower case of ASCII alone, so that positions stay those of the text."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(_LOWER)


_LOWER = {c: c + 32 for c in range(65, 91)}


def find(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, rule) of each secret, by start, in code points; none overlap."""
    if not text:
        return []
    auto, patterns = _automaton()
    tried, found = set(), []
    for last, (size, rules) in auto.iter(_ascii_lower(text)):
        at = last - size + 1
        for k in rules:
            if (at, k) in tried:
                continue
            tried.add((at, k))
            m = patterns[k].match(text, at)
            if m and RULES[k][5](m["s"]):
                found.append((m.start("s"), m.end("s"), k))
    found.sort(key=lambda f: (f[0], -f[1], f[2]))
    out, end = [], -1
    for s, e, k in found:
        if s >= end:
            out.append((s, e, RULES[k][0]))
            end = e
    return out


def redact(text: str | None) -> str | None:
    """The text with each secret replaced by ``[SECRET:rule]``; a text without secrets is unchanged."""
    hits = find(text)
    if not hits:
        return text
    parts, at = [], 0
    for s, e, rule in hits:
        parts += [text[at:s], f"[SECRET:{rule}]"]
        at = e
    return "".join([*parts, text[at:]])


def scan(docs: DataFrame) -> DataFrame:
    """A row (doc_id, rule, start, length, sha256 of the secret) for each secret; the secret itself is not given out."""
    import hashlib

    def run(batches):
        for pdf in batches:
            rows = [
                (i, rule, s, e - s, hashlib.sha256(t[s:e].encode()).hexdigest())
                for i, t in zip(pdf["doc_id"], pdf["text"])
                for s, e, rule in find(t)
            ]
            out = pd.DataFrame(rows, columns=["doc_id", "rule", "start", "length", "sha256"])
            yield out.astype({"doc_id": "Int64", "start": "int64", "length": "int64"})

    return text_documents(docs).mapInPandas(run, "doc_id long, rule string, start long, length long, sha256 string")


def redacted(text: Column) -> Column:
    """The column of texts with secrets replaced; null stays null."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(redact, na_action="ignore")

    return run(text)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))
