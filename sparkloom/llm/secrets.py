"""Secret scans: an Aho-Corasick pass for keywords, a regular expression anchored near each hit, then embedded checks.

A rule is a keyword's followers: its expression is matched at the hit and nowhere else, so the expressions never scan a
text. Where a format carries its own check (the CRC-32 at the end of repository and registry tokens, the JSON header of
a web token, the length of a private key's outer structure) it is computed, and a match that fails it is no secret. Values
of general keywords (``token = "..."``, in any case) have no check; they must look random, or like a password.
"""

from __future__ import annotations

import base64
import bisect
import binascii
import json
import math
import re
import zlib
from collections import Counter
from collections.abc import Callable
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common
from .common import per_batch

BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: Bits a character that the value of a general keyword must have.
ENTROPY = 2.8


def crc62(token: str) -> bool:
    """The last six characters are the CRC-32 of what stands between the prefix and them, in base 62."""
    body, tail = token.rpartition("_")[2][:-6], token[-6:]
    n, want = zlib.crc32(body.encode()), ""
    while n:
        n, d = divmod(n, 62)
        want = BASE62[d] + want
    return want.rjust(6, "0") == tail


def jwt(token: str) -> bool:
    """The first part is a JSON object that names an algorithm."""
    head = token.split(".")[0]
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, TypeError, RecursionError):
        return False


#: A header within a key's marks, as encrypted keys have them; its value has no blanks.
_KEY_HEADER = re.compile(r"[A-Za-z][A-Za-z-]*:[ \t]*\S*")


def der(block: str) -> bool:
    """The body is base 64; an outer ASN.1 sequence, if it has one, is as long as it says; a body that a header calls encrypted is of whole cipher blocks."""
    # Line ends may be escaped, as in JSON and environment files, or blanks.
    body = re.sub(r"\\+[nrt]", "\n", block.partition(" KEY-----")[2].rpartition("-----END")[0]).replace("\\/", "/")
    heads = _KEY_HEADER.findall(body)
    try:
        raw = base64.b64decode("".join(_KEY_HEADER.sub(" ", body).split()), validate=True)
    except (binascii.Error, ValueError):
        return False
    if any(x.startswith("Proc-Type:") and x.endswith("ENCRYPTED") for x in heads):
        return len(raw) > 15 and len(raw) % 8 == 0
    if raw[:15] == b"openssh-key-v1\0":
        return True
    if len(raw) < 4 or raw[0] != 0x30:
        return False
    n = raw[1] & 0x7F
    return len(raw) == (2 + raw[1] if raw[1] < 128 else 2 + n + int.from_bytes(raw[2 : 2 + n], "big"))


def aws_account(key: str) -> bool:
    """The characters after the prefix are base 32; the account number within them has at most 12 digits."""
    try:
        raw = base64.b32decode(key[4:])
    except binascii.Error:
        return False
    return (int.from_bytes(raw[:6], "big") & 0x7FFFFFFFFF80) >> 7 < 10**12


def random_looking(value: str) -> bool:
    n = len(value)
    return any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and -sum(c / n * math.log2(c / n) for c in Counter(value).values()) >= ENTROPY


def password_like(value: str) -> bool:
    """Letters, and digits or signs that names haven't; characters vary as far as so few can. No placeholder such as ``${NAME}``."""
    n = len(value)
    if value.startswith(("${", "$(", "{{", "<", "%(")) or not any(c.isalpha() for c in value) or all(c.isalpha() or c in "_-./" for c in value):
        return False
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) >= min(ENTROPY, 0.75 * math.log2(n))


class Rule(NamedTuple):
    name: str
    keywords: tuple[str, ...]
    #: Matched where the keyword begins; group 1 is the secret.
    pattern: re.Pattern
    check: Callable[[str], bool]
    #: Whether ``check`` computes something embedded in the secret.
    verifies: bool


def _forms(*words: str) -> tuple[str, ...]:
    return tuple(f for w in words for f in (w, w.capitalize(), w.upper()))


_END = r"(?![A-Za-z0-9_\-])"
#: The rest of the name that a keyword begins in; nothing that may follow it is of these characters.
_NAME = r"[A-Za-z_\-]++"
_NAME_END, _TOKEN_END = re.compile(_NAME), re.compile(r"[A-Za-z0-9_\-]++")
RULES = (
    Rule("repository_token", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile(r"(gh[pousr]_[A-Za-z0-9]{36})" + _END), crc62, True),
    Rule("registry_token", ("npm_",), re.compile(r"(npm_[A-Za-z0-9]{36})" + _END), crc62, True),
    Rule("web_token", ("eyJ",), re.compile(r"(eyJ[A-Za-z0-9_\-]{8,}+\.eyJ[A-Za-z0-9_\-]{8,}+\.[A-Za-z0-9_\-]*+)"), jwt, True),
    Rule("private_key", ("-----BEGIN",), re.compile(r"(-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----[^-]*+(?:-(?!----)[^-]*+)*+-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----)"), der, True),
    Rule("cloud_key_id", ("AKIA", "ASIA"), re.compile(r"(A[KS]IA[A-Z2-7]{16})" + _END), aws_account, True),
    Rule("api_key_35", ("AIza",), re.compile(r"(AIza[A-Za-z0-9_\-]{35})" + _END), random_looking, False),
    Rule("chat_token", ("xoxb-", "xoxp-", "xoxa-", "xoxs-"), re.compile(r"(xox[baps]-[0-9]+-[A-Za-z0-9\-]{10,250})" + _END), random_looking, False),
    Rule("payment_key", ("sk_live_", "rk_live_"), re.compile(r"([sr]k_live_[A-Za-z0-9]{16,247})" + _END), random_looking, False),
    Rule(
        "assigned_value",
        _forms("token", "secret", "password", "passwd", "api_key", "apikey", "api-key", "access_key", "accesskey", "access-key", "auth_key", "authkey", "auth-key"),
        re.compile(_NAME + r"[\"']?[ \t]{0,4}(?::=|=>|[:=])[ \t]{0,4}[\"']?([A-Za-z0-9+/_\-]{16,}+={0,2})(?![A-Za-z0-9+/_\-=])"),
        random_looking,
        False,
    ),
    # Passwords are shorter and have other signs: to the closing quote, or to the next blank.
    Rule(
        "assigned_value",
        _forms("password", "passwd"),
        re.compile(
            _NAME + r"[\"']?[ \t]{0,4}(?::=|=>|[:=])[ \t]{0,4}[\"']?"
            r"((?<=\")[^\"\s]{8,128}(?=\")|(?<=')[^'\s]{8,128}(?=')|(?<![\"'])[^\s\"'<>(){}\[\],;]{8,128}(?![^\s\"'<>,;]))"
        ),
        password_like,
        False,
    ),
)


class Scanner:
    def __init__(self) -> None:
        import ahocorasick

        # Keywords of assignments count in any case: they are sought, in lower case, in the lowered text.
        self.words, self.names = ahocorasick.Automaton(), ahocorasick.Automaton()
        names: dict[str, list[Rule]] = {}
        for rule in RULES:
            for w in rule.keywords:
                if rule.name != "assigned_value":
                    self.words.add_word(w, (len(w), (rule,)))
                elif rule not in names.setdefault(w.lower(), []):
                    names[w.lower()].append(rule)
        for w, rules in names.items():
            self.names.add_word(w, (len(w), tuple(rules)))
        self.words.make_automaton()
        self.names.make_automaton()

    def __call__(self, text: str | None) -> list[tuple[int, int, str, bool]]:
        """(begin, end, rule, verified) in order, apart; a rule with a check comes before one without, then the earlier, then the longer.

        Time is linear in the text: all keywords of one name share what follows it, and all starts of a web token its end.
        """
        if not text:
            return []
        found = set()
        low = text.lower()
        if len(low) != len(text):  # some characters lower to two
            low = "".join(c.lower() if c.isascii() else c for c in text)
        tokens = _WebTokens(text)
        for last, (n, rules) in self.words.iter(text):
            at = last - n + 1
            if at and (text[at - 1].isalnum() or text[at - 1] == "_"):
                continue
            for rule in rules:
                if rule.check is jwt:
                    if (end := tokens.end(at)) > at:
                        found.add((at, end, rule.name, True))
                elif (m := rule.pattern.match(text, at)) and rule.check(m[1]):
                    found.add((*m.span(1), rule.name, rule.verifies))
        name_end, tried = 0, set()
        for last, (n, rules) in self.names.iter(low):
            at = last - n + 1
            if at >= name_end:
                m = _NAME_END.match(text, at)
                name_end, tried = m.end() if m else last + 1, set()
            for rule in rules:
                if id(rule) not in tried:
                    tried.add(id(rule))
                    # From the last character of the name on: what comes before it was only passed over.
                    if (m := rule.pattern.match(text, name_end - 1)) and rule.check(m[1]):
                        found.add((*m.span(1), rule.name, rule.verifies))
        out: list[tuple[int, int, str, bool]] = []
        for s in sorted(found, key=lambda s: (not s[3], s[0], -s[1], s[2])):
            k = bisect.bisect_left(out, s)
            if (not k or out[k - 1][1] <= s[0]) and (k == len(out) or s[1] <= out[k][0]):
                out.insert(k, s)
        return out


class _WebTokens:
    """Web tokens of one text. What follows a run of their characters, and the run decoded in each of the four alignments, serve all starts in it."""

    def __init__(self, text: str):
        self.text, self.stop, self.whole, self.decoded = text, 0, 0, {}
        self.json = json.JSONDecoder()

    def end(self, at: int) -> int:
        """The end of the token that begins at ``at``, or 0."""
        text = self.text
        if at >= self.stop:
            self.stop, self.whole, self.decoded = _TOKEN_END.match(text, at).end(), 0, {}
            if text.startswith(".eyJ", self.stop):
                second = _TOKEN_END.match(text, self.stop + 1).end()
                if second - self.stop >= 12 and text.startswith(".", second):
                    third = _TOKEN_END.match(text, second + 1)
                    self.whole = third.end() if third else second + 1
        if not self.whole or self.stop - at < 11:
            return 0
        if at % 4 not in self.decoded:
            part = text[at : self.stop]
            try:
                self.decoded[at % 4] = at, base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)).decode("latin-1")
            except binascii.Error:
                self.decoded[at % 4] = at, ""
        since, head = self.decoded[at % 4]
        if not head:
            return 0
        begin = (at - since) // 4 * 3
        part = head[begin : begin + 512]
        try:
            self.json.raw_decode(part)
        except json.JSONDecodeError as e:
            # A fault that more text wouldn't mend, so starts that are none cost little.
            if e.pos < len(part) - 16 and not e.msg.startswith("Unterminated"):
                return 0
        except RecursionError:
            return 0
        return self.whole if jwt(text[at : self.whole]) else 0


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, rule, begin, end, verified, fingerprint) of every secret, places in characters from 0.

    The fingerprint is the SHA-256 of the secret, so that the result doesn't hold it. Null and empty texts, and an empty
    table, give no rows; repeated rows give theirs each; a null id is passed on. Texts are read whole, in time linear in
    their length. Of finds that overlap, those with an embedded check come first, then the earlier, then the longer. Other
    columns are ignored; a column of ours that is named like the id has underscores before it.
    """
    ours = {"rule": "string", "begin": "long", "end": "long", "verified": "boolean", "fingerprint": "string"}

    def make():
        import hashlib

        f = Scanner()

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            row, rest = [], []
            for r, t in enumerate(b.column(1).to_pylist()):
                for begin, end, rule, verified in f(t):
                    row.append(r)
                    rest.append((rule, begin, end, verified, hashlib.sha256(t[begin:end].encode("utf-8", "surrogatepass")).hexdigest()))
            cols = zip(*rest) if rest else ((),) * 5
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
            return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["id", "rule", "begin", "end", "verified", "fingerprint"])

        return run

    kind = docs.schema[id_col].dataType.simpleString()
    return per_batch(docs, [id_col, text_col], make, common.schema_of(id_col, kind, ours))


def op4(spark, sf_dir: str) -> DataFrame:
    """All secrets in the documents."""
    return scan(common.table(spark, sf_dir, "documents"))
