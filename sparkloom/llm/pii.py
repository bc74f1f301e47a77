"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds its anchors: at-signs, schemes and identifier cues (a plus before a digit, two
digits around a dot, four digits in a row, the start of a bank account number, words such as "account no"). Each anchor
names a local parser, which grows from the anchor to both sides by fixed rules and checks what it finds: the labels of a
host, the ranges of an address, the length of a telephone number, the check digits of cards and bank accounts. Text far
from an anchor is never looked at again. Nothing is limited in length but what the formats themselves limit.
"""

from __future__ import annotations

import ipaddress

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common
from .common import per_batch

#: Longest local part, label and host of an electronic mail address (RFC 5321, RFC 1035).
LOCAL_MAX, LABEL_MAX, HOST_MAX = 64, 63, 253
#: Digits of card numbers (ISO/IEC 7812) and of international telephone numbers (E.164).
CARD_DIGITS, PHONE_DIGITS = (12, 19), (8, 15)
#: How far after a cue word its number may begin, and how many digits it has.
CUE_REACH, ACCOUNT_DIGITS = 16, (6, 20)
ACCOUNT_CUES = ("account number", "account no", "account #", "acct no", "acct #", "kontonummer", "konto-nr", "número de cuenta", "numéro de compte", "social security number", "ssn")
PHONE_CUES = ("tel:", "tel.", "phone:", "fax:", "mobile:")
#: Lengths of bank account numbers by country (ISO 13616).
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22,
    "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21,
    "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24,
    "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24,
    "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "XK": 20,
}

Span = tuple[int, int, str]


def _local(c: str) -> bool:
    return c.isalnum() or c in "._+-"


def _digit(c: str) -> bool:
    return "0" <= c <= "9"


def _host(text: str, at: int, stop: int | None = None) -> int:
    """The end of the host name that begins at ``at`` and ends before ``stop``, or ``at`` if there is none."""
    end, stop = at, len(text) if stop is None else stop
    while end < stop and end - at <= HOST_MAX + 1 and (text[end].isalnum() or text[end] in ".-"):
        end += 1
    while end > at and text[end - 1] in ".-":
        end -= 1
    labels = text[at:end].split(".")
    fine = len(labels) > 1 and end - at <= HOST_MAX and labels[-1].isalpha() and len(labels[-1]) > 1
    return end if fine and all(0 < len(x) <= LABEL_MAX and x[0] != "-" and x[-1] != "-" for x in labels) else at


def email(text: str, at: int, end: int) -> Span | None:
    """Grows from the at-sign: a local part to the left, a host to the right."""
    begin = at
    while begin > 0 and at - begin <= LOCAL_MAX and _local(text[begin - 1]):
        begin -= 1
    if at - begin > LOCAL_MAX:
        return None
    if (k := text.rfind("..", begin, at)) >= 0:
        begin = k + 2
    while begin < at and text[begin] in ".-+":
        begin += 1
    if begin == at or text[at - 1] == ".":
        return None
    to = _host(text, end)
    return (begin, to, "email") if to > end else None


_URL_END = frozenset(" \t\r\n\f\v<>\"'`{}|\\^")
_URL_TAIL = frozenset(".,;:!?*&%$#")


def url(text: str, at: int, end: int) -> Span | None:
    """Grows from ``://``: the scheme to the left; host, port and path to the right; closing signs of the sentence go."""
    begin = at
    while begin > 0 and (text[begin - 1].isascii() and text[begin - 1].isalnum() or text[begin - 1] in "+.-"):
        begin -= 1
    while begin < at and not text[begin].isalpha():
        begin += 1
    if at - begin < 2:
        return None
    authority = end
    while authority < len(text) and text[authority] not in "/?#" and text[authority] not in _URL_END and not text[authority].isspace():
        authority += 1
    host = text.rfind("@", end, authority) + 1 or end
    while authority > host and text[authority - 1] in _URL_TAIL:
        authority -= 1
    name = text[host:authority]
    if name[:1] == "[":
        try:
            ipaddress.IPv6Address(name[1 : name.find("]")])
        except ValueError:
            return None
    elif name.lower().split(":")[0] != "localhost" and _host(text, host, authority) == host and not _octets(name.split(":")[0]):
        return None
    to = authority
    while to < len(text) and text[to] not in _URL_END and not text[to].isspace():
        to += 1
    open_ = {")": text.count("(", end, to) - text.count(")", end, to), "]": text.count("[", end, to) - text.count("]", end, to)}
    while to > authority and (text[to - 1] in _URL_TAIL or open_.get(text[to - 1], 0) < 0):
        if text[to - 1] in open_:
            open_[text[to - 1]] += 1
        to -= 1
    return begin, to, "url"


def _octets(s: str) -> bool:
    p = s.split(".")
    return len(p) == 4 and all(x.isascii() and x.isdigit() and len(x) <= 3 and int(x) < 256 and (x == "0" or x[0] != "0") for x in p)


def address(text: str, at: int, end: int) -> Span | None:
    """Grows from a dot between digits: four octets and nothing of a word or a longer number beside them."""
    begin = at
    while begin > 0 and (_digit(text[begin - 1]) or text[begin - 1] == ".") and end - begin <= 17:
        begin -= 1
    while end < len(text) and (_digit(text[end]) or text[end] == ".") and end - begin <= 17:
        end += 1
    while end > begin and text[end - 1] == ".":
        end -= 1
    if (begin and (text[begin - 1].isalnum() or text[begin - 1] in "_-")) or (end < len(text) and (text[end].isalnum() or text[end] in "_-")):
        return None
    return (begin, end, "ip") if _octets(text[begin:end]) else None


def phone(text: str, at: int, end: int) -> Span | None:
    """Grows to the right from a plus and a digit: ``+1`` and ten digits, or groups of other countries with single signs between."""
    if at and (text[at - 1].isalnum() or text[at - 1] in "+_"):
        return None
    digits, to, last, inside = 0, at + 1, at + 1, False
    most = 11 if text[at + 1] == "1" else PHONE_DIGITS[1]
    gap = 0
    while to < len(text):
        c = text[to]
        if _digit(c):
            if digits == most:
                if gap:
                    break
                return None
            digits, gap, last = digits + 1, 0, to + 1
        elif c == "(" and not inside and gap <= 1:
            inside, gap = True, gap + 1
        elif c == ")" and inside:
            inside, gap = False, gap + 1
        elif c in " .-" and gap < (2 if text[to - 1] == ")" else 1):
            gap += 1
        else:
            break
        to += 1
    if last < len(text) and (text[last].isalnum() or text[last] == "_"):
        return None
    return (at, last, "phone") if (digits == 11 if most == 11 else digits >= PHONE_DIGITS[0]) else None


def luhn(digits: str) -> bool:
    d = [ord(c) - 48 for c in reversed(digits)]
    return (sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def card(text: str, at: int, end: int) -> Span | None:
    """Grows from four digits to the run they stand in, then over single blanks or hyphens between groups of four; Luhn's check."""
    begin = at
    while begin > 0 and _digit(text[begin - 1]) and at - begin <= CARD_DIGITS[1]:
        begin -= 1
    if begin and (text[begin - 1].isalnum() or text[begin - 1] in "_.+"):
        return None
    while end < len(text) and _digit(text[end]) and end - begin <= CARD_DIGITS[1]:
        end += 1
    if end - begin == 4:
        # Digit groups: 4-4-4-4(-3), or 4-6-5.
        sign = text[end : end + 1]
        for shape in ((4, 4, 4, 4, 3), (4, 4, 4, 4), (4, 6, 5)):
            to, parts = begin, []
            for n in shape:
                part = text[to : to + n]
                if len(part) < n or not all(map(_digit, part)):
                    break
                parts.append(part)
                to += n + 1
                if len(parts) < len(shape) and text[to - 1 : to] != sign:
                    break
            if sign and sign in " -" and len(parts) == len(shape) and not (to - 1 < len(text) and (text[to - 1].isalnum() or text[to - 1] == "_")) and luhn("".join(parts)):
                return begin, to - 1, "card"
        return None
    if not CARD_DIGITS[0] <= end - begin <= CARD_DIGITS[1] or (end < len(text) and (text[end].isalnum() or text[end] == "_")):
        return None
    number = text[begin:end]
    return (begin, end, "card") if len(set(number)) > 1 and luhn(number) else None


def iban(text: str, at: int, end: int) -> Span | None:
    """Grows from a country and two check digits to that country's length, with single blanks between groups; modulo 97."""
    if at and text[at - 1].isalnum():
        return None
    need, got, to = IBAN_LENGTHS[text[at : at + 2]], [], at
    while to < len(text) and len(got) < need:
        c = text[to]
        if c.isascii() and (c.isdigit() or c.isupper()):
            got.append(c)
        elif c != " " or text[to - 1] == " ":
            return None
        to += 1
    if len(got) < need or (to < len(text) and text[to].isalnum()):
        return None
    return (at, to, "iban") if int("".join(str(int(c, 36)) for c in got[4:] + got[:4])) % 97 == 1 else None


def account(text: str, at: int, end: int) -> Span | None:
    """From a cue word to the right: signs, then a number of 6 to 20 digits with single hyphens or blanks between."""
    if at and text[at - 1].isalnum():
        return None
    begin = end
    while begin < len(text) and begin - end <= CUE_REACH and text[begin] in " .:#=-\t":
        begin += 1
    n, to, last = 0, begin, begin
    while to < len(text):
        if _digit(text[to]):
            n, last = n + 1, to + 1
        elif text[to] not in " -" or text[to - 1] in " -":
            break
        to += 1
    fine = begin - end <= CUE_REACH and ACCOUNT_DIGITS[0] <= n <= ACCOUNT_DIGITS[1] and not (last < len(text) and text[last].isalnum())
    return (begin, last, "account") if fine else None


def called(text: str, at: int, end: int) -> Span | None:
    """From a cue such as ``tel:`` to the right: 7 to 15 digits with single signs between."""
    if at and text[at - 1].isalnum():
        return None
    begin = end
    while begin < len(text) and begin - end <= CUE_REACH and text[begin] in " \t":
        begin += 1
    if text[begin : begin + 1] == "+":
        return phone(text, begin, begin + 1) if begin + 1 < len(text) and _digit(text[begin + 1]) else None
    n, to, last = 0, begin, begin
    while to < len(text):
        if _digit(text[to]):
            n, last = n + 1, to + 1
        elif text[to] not in " -./()" or (to > begin and text[to - 1] in "-./"):
            break
        to += 1
    return (begin, last, "phone") if 7 <= n <= PHONE_DIGITS[1] else None


def anchors() -> dict[str, str]:
    """Every anchor and the parser it names."""
    out = {"@": "email", "://": "url"}
    out |= {f"+{d}": "phone" for d in range(10)}
    out |= {f"{a}.{b}": "address" for a in range(10) for b in range(10)}
    out |= {f"{n:04d}": "card" for n in range(10_000)}
    out |= {f"{c}{n:02d}": "iban" for c in IBAN_LENGTHS for n in range(2, 99)}
    for words, parser in ((ACCOUNT_CUES, "account"), (PHONE_CUES, "called")):
        out |= {form: parser for w in words for form in (w, w.capitalize(), w.title(), w.upper())}
    return out


PARSERS = {f.__name__: f for f in (email, url, address, phone, card, iban, account, called)}


class Finder:
    def __init__(self) -> None:
        import ahocorasick

        self.anchors = ahocorasick.Automaton()
        for a, parser in anchors().items():
            self.anchors.add_word(a, (len(a), PARSERS[parser]))
        self.anchors.make_automaton()

    def __call__(self, text: str | None) -> list[Span]:
        """(begin, end, kind) in order and apart; null and empty texts have none. Of spans that overlap, the first and then the longest counts."""
        if not text:
            return []
        found = set()
        skip: dict[object, int] = {}
        for last, (n, parser) in self.anchors.iter(text):
            at = last - n + 1
            # A later anchor inside what its own parser has found adds nothing.
            if at >= skip.get(parser, 0) and (span := parser(text, at, last + 1)):
                found.add(span)
                skip[parser] = span[1]
        out: list[Span] = []
        for span in sorted(found, key=lambda s: (s[0], -s[1], s[2])):
            if not out or span[0] >= out[-1][1]:
                out.append(span)
        return out


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, kind, begin, end, value) of all personal data, places counted in characters from 0.

    Null and empty texts, and an empty table, give no rows; repeated rows give theirs each; a null id is passed on. Texts
    are read whole, however long. Of finds that overlap, the first and then the longest counts; two kinds of one place go
    by name. Other columns are ignored; a column of ours that is named like the id has underscores before it.
    """
    ours = {"kind": "string", "begin": "long", "end": "long", "value": "string"}

    def make():
        f = Finder()

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            row, rest = [], []
            for r, t in enumerate(b.column(1).to_pylist()):
                for begin, end, kind in f(t):
                    row.append(r)
                    rest.append((kind, begin, end, t[begin:end]))
            kind, begin, end, value = zip(*rest) if rest else ((), (), (), ())
            arrays = [b.column(0).take(pa.array(row, pa.int64())), pa.array(kind, pa.string()), pa.array(begin, pa.int64()), pa.array(end, pa.int64()), pa.array(value, pa.string())]
            return pa.RecordBatch.from_arrays(arrays, names=["id", "kind", "begin", "end", "value"])

        return run

    kind = docs.schema[id_col].dataType.simpleString()
    return per_batch(docs, [id_col, text_col], make, common.schema_of(id_col, kind, ours))


def redact(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with each find replaced by its kind in angle brackets; null and empty texts stay as they are."""
    at = docs.columns.index(text_col)

    def run(batches):
        f = Finder()
        for b in batches:
            texts = []
            for t in b.column(at).to_pylist():
                spans = f(t)
                if spans:
                    ends = [0, *(e for _, e, _ in spans)]
                    t = "".join(f"{t[p:s]}<{k}>" for p, (s, _, k) in zip(ends, spans)) + t[ends[-1] :]
                texts.append(t)
            yield b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def op3(spark, sf_dir: str) -> DataFrame:
    """All personal data in the documents."""
    return find(common.table(spark, sf_dir, "documents"))
