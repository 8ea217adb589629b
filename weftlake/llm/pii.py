"""Personal data by a semi-Markov conditional random field.

A text is looked at where personal data can be: runs of white-space-separated
tokens that each hold a digit or ``@`` (every type the model knows has one in
each of its tokens, so nothing is missed elsewhere).  A run is cut into atoms,
runs of letters and digits or single signs, and every segment that could be an
entity is scored as a whole: its shape, its length, checksums, what touches it
and which of the three words before it are cues.  Dynamic programming over
these segments then finds the best segmentation, boundaries and types together;
atoms outside entities are segments of their own.

What could be an entity is bounded, so that the work is in proportion to the
text: numbers (telephone, card, address of a host) by NUMBER_DIGITS and
NUMBER_SIGNS; mail addresses begin and end within ADDRESS_SIGNS of their ``@``
or where the run of signs that addresses may have does, however far that is;
secrets, IPv6 addresses and unspaced account numbers are whole runs of their
signs, of any length.  No bound cuts an entity in two.

Types: EMAIL, PHONE, IP (4 and 6), CARD, IBAN, SECRET (keys of 16 signs or more
with letters and digits).  Names, postal addresses and secrets without a digit
are not among them.

Weights are trained here by stochastic gradient ascent on the conditional
likelihood (forward-backward over the same segments), on lines generated with a
fixed seed: entities in many notations amid numbers that are none.

Defined cases: ids are integers; null, empty and unlettered texts give no rows;
``start`` and ``end`` count characters; rows that are repeated are reported as
often, and rows with a null id under a null doc_id; an empty table gives an
empty result.  Values are not part of the result.
"""

from __future__ import annotations

import ipaddress
import random
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import isolate, place, restore, table

TYPES = ("O", "EMAIL", "PHONE", "IP", "CARD", "SECRET", "IBAN")
#: Of telephone and card numbers, IPv4 addresses and spaced account numbers.
NUMBER_DIGITS, NUMBER_SIGNS = 34, 44
ADDRESS_SIGNS = 320
SCHEMA = "doc_id long, start int, end int, pii_type string, score double"

_ATOM = re.compile(r"[^\W_]+|\s|[^\w\s]|_", re.UNICODE)
_EMAIL = re.compile(r"[\w.+%-]+@(?:[\w-]+\.)+[^\W\d_]{2,}", re.UNICODE)
_IP = re.compile(r"(?:\d{1,3}\.){3}\d{1,3}")
_PHONE = re.compile(r"\+?\d{0,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]\d{2,4}){1,4}")
#: Numbers without separators or with long groups; with 6 to 15 digits they may be telephone numbers.
_NUMBER = re.compile(r"\+?(?:\d+[ .-]?)?(?:\(\d{1,5}\)[ .-]?)?\d+(?:[ .-]\d+)*")
_CARD = re.compile(r"\d(?:[ -]?\d){12,18}")
_DATE = re.compile(r"\d{4}-\d{1,2}-\d{1,2}|\d{1,2}[./-]\d{1,2}[./-]\d{2,4}")
_HEX = re.compile(r"[0-9a-fA-F]{16,}")
_KEY = re.compile(r"[A-Za-z0-9_\-]{16,}")
_IBAN = re.compile(r"[A-Za-z]{2}\d{2}(?: ?[A-Za-z0-9]{4}){2,7}(?: ?[A-Za-z0-9]{1,4})?")
_SIX = re.compile(r"[0-9A-Fa-f]*:[0-9A-Fa-f:]*:[0-9A-Fa-f:]*(?:(?:\d{1,3}\.){3}\d{1,3})?")
_LOCAL = re.compile(r"[\w.+%-]*\Z", re.UNICODE)
_DOMAIN = re.compile(r"[\w.-]*", re.UNICODE)
_CUES = {
    "secret": {"token", "key", "secret", "password", "passwd", "pwd", "apikey", "bearer", "auth"},
    "phone": {"tel", "phone", "call", "fax", "mobile", "cell", "telephone"},
    "ip": {"ip", "host", "server", "address", "addr"},
    "card": {"card", "visa", "mastercard", "amex", "credit", "debit"},
    "ref": {"order", "invoice", "isbn", "id", "no", "nr", "version", "page", "ticket", "commit", "sha", "build", "serial", "item"},
}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def iban(value: str) -> bool:
    v = value.replace(" ", "").upper()
    return sum(1 for _ in v) >= 15 and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def six(value: str) -> bool:
    try:
        return ipaddress.ip_address(value).version == 6
    except ValueError:
        return False


def atoms(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _ATOM.finditer(text)]


def segment_features(text: str, start: int, end: int, before: frozenset[str], left: str, right: str) -> tuple[str, ...]:
    """Of the whole segment text[start:end]; ``before``: cues in the words before it; left and right: the sign before it and the two after."""
    s = text[start:end]
    digits = "".join(c for c in s if c.isdecimal())
    letters = sum(c.isalpha() for c in s)
    out = [f"touch:{left.isalnum() or left in tuple(".@+-_")}:{right[:1].isalnum() or right[:1] in ('@', '_')}", f"digits:{min(20, len(digits))}", f"letters:{min(3, letters)}"]
    if right[:1] in (".", "-") and right[1:2].isalnum():
        out.append("right:joined")
    if _EMAIL.fullmatch(s):
        out.append("email")
    if _IP.fullmatch(s):
        ok = all(int(v) < 256 for v in s.split("."))
        out.append("ip:ok" if ok else "ip:bad")
    if s.count(":") > 1 and _SIX.fullmatch(s):
        out += ["six", f"six:{six(s)}:{min(8, s.count(':'))}"]
    if s.isascii() and _IBAN.fullmatch(s):
        out += ["iban", f"iban:{iban(s)}"]
    if _CARD.fullmatch(s):
        out += ["card", f"card:{len(digits)}:{luhn(digits)}"]
    if _PHONE.fullmatch(s) or (6 <= len(digits) <= 15 and len(s) <= 32 and _NUMBER.fullmatch(s)):
        longest = max(map(len, re.findall(r"\d+", s)))
        out += ["phone", f"phone:longest:{min(12, longest)}", f"phone:bare:{longest == len(s)}:{'phone' in before}", f"phone:plus:{s[0] == '+'}:{min(12, longest)}", f"phone:{min(16, len(digits))}", f"phone:plus:{s[0] == '+'}", f"phone:paren:{'(' in s}"]
    if _DATE.fullmatch(s):
        out.append("date")
    if letters and digits and _KEY.fullmatch(s):
        kinds = len(set(s)) / len(s)
        out += ["key", f"key:{min(40, len(s)) // 8}", f"key:mixed:{kinds > 0.2}"]
        if _HEX.fullmatch(s):
            out += ["hex", f"hex:{len(s)}" if len(s) in (32, 40, 64) else "hex:other"]
    out += [f"cue:{c}" for c in sorted(before)]
    if "key" in out:
        out += [f"key+{c}" for c in sorted(before)] or ["key+none"]
    if "card" in out or "phone" in out:
        out += [f"number+{c}" for c in sorted(before)]
    return tuple(out)


_SHAPES = {"email", "ip:ok", "ip:bad", "six", "iban", "card", "phone", "key"}


def cues(context: str) -> frozenset[str]:
    said = {w.lower() for w in re.findall(r"[^\W\d_]+", context)[-3:]}
    return frozenset(c for c, w in _CUES.items() if said & w)


_RUN = re.compile(r"[A-Za-z0-9_\-]{15,}|[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*")


def _possible(text: str, cut: list[tuple[int, int]]):
    """(first atom, atom after the last) of the segments that could be an entity, by the bounds of this module."""
    at = {a: k for k, (a, _) in enumerate(cut)}
    upto = {b: k + 1 for k, (_, b) in enumerate(cut)}
    plain = [text[a:b] for a, b in cut]
    for i, p in enumerate(plain):  # numbers
        if p[0] in "+(" or p.isdecimal():
            digits, j = 0, i
            while j < len(cut) and cut[j][1] - cut[i][0] <= NUMBER_SIGNS:
                q = plain[j]
                if q.isdecimal():
                    digits += len(q)
                    if digits > NUMBER_DIGITS:
                        break
                    if digits > 4 or plain[i:j].count(".") == 3:
                        yield i, j + 1
                elif q not in " \t.-+()":
                    break
                j += 1
        elif len(p) >= 4 and p[:2].isalpha() and p[2:4].isdecimal() and p.isascii():  # spaced account numbers
            j = i
            while j < len(cut) and cut[j][1] - cut[i][0] <= NUMBER_SIGNS and (plain[j] == " " or (plain[j].isascii() and plain[j].isalnum())):
                if plain[j] != " ":
                    yield i, j + 1
                j += 1
    for m in re.finditer("@", text):  # addresses
        k = m.start()
        left = _LOCAL.search(text, max(0, k - ADDRESS_SIGNS), k).start()
        if left == k - ADDRESS_SIGNS:  # the run is longer
            left = k
            while left and (text[left - 1].isalnum() or text[left - 1] in "_.+%-"):
                left -= 1
        right = _DOMAIN.match(text, k + 1).end()
        starts = [at[x] for x in range(max(left, k - ADDRESS_SIGNS), k) if x in at and (text[x].isalnum() or text[x] in "_+%-")]
        if left < k - ADDRESS_SIGNS:
            starts.insert(0, next(at[x] for x in range(left, k) if x in at))
        ends = [upto[x] for x in range(k + 2, min(right, k + ADDRESS_SIGNS) + 1) if x in upto and text[x - 1].isalnum()]
        if right > k + ADDRESS_SIGNS:
            ends.append(next(upto[x] for x in range(right, k, -1) if x in upto))
        yield from ((i, j) for i in starts for j in ends)
    for m in _RUN.finditer(text):  # whole runs
        if m.start() in at and m.end() in upto:
            yield at[m.start()], upto[m.end()]


def segments(text: str, left: str = "", right: str = "") -> tuple[int, list[tuple[int, int, int, int, tuple[str, ...]]]]:
    """(number of atoms, (first atom, atom after the last, start, end, features) of each segment that could be an entity)."""
    cut = atoms(text)
    found, before = [], {}
    for i, j in sorted(set(_possible(text, cut))):
        a, b = cut[i][0], cut[j - 1][1]
        if i not in before:
            before[i] = cues(left[-60:] + " " + text[max(0, a - 60) : a])
        f = segment_features(text, a, b, before[i], text[a - 1 : a] or left[-1:], (text[b : b + 2] + right)[:2])
        if not _SHAPES.isdisjoint(f):
            found.append((i, j, a, b, f))
    return len(cut), found


class Field:
    """Weights by feature, one for each type, and by pair of types that follow each other."""

    def __init__(self) -> None:
        self.w: dict[str, np.ndarray] = {}
        self.t = np.zeros((len(TYPES), len(TYPES)))

    def score(self, f: tuple[str, ...]) -> np.ndarray:
        s = np.zeros(len(TYPES))
        for name in f:
            v = self.w.get(name)
            if v is not None:
                s += v
        s[0] = -np.inf  # a segment of type O is one atom
        return s

    def best(self, n: int, found) -> list[tuple[int, int, int, int, int, float]]:
        """(first atom, atom after, start, end, type, score) of the entities of the best segmentation."""
        by_end: list[list] = [[] for _ in range(n + 1)]
        for seg in found:
            by_end[seg[1]].append(seg)
        k = len(TYPES)
        top = np.full((n + 1, k), -np.inf)
        back: list[list] = [[None] * k for _ in range(n + 1)]
        top[0, 0] = 0.0
        for j in range(1, n + 1):
            p = int((top[j - 1] + self.t[:, 0]).argmax())
            top[j, 0], back[j][0] = top[j - 1, p] + self.t[p, 0], (j - 1, p, None)
            for seg in by_end[j]:
                own = self.score(seg[4])
                here = top[seg[0]][:, None] + self.t + own[None, :]
                for y in range(1, k):
                    p = int(here[:, y].argmax())
                    if here[p, y] > top[j, y]:
                        top[j, y], back[j][y] = here[p, y], (seg[0], p, (*seg[:4], y, float(own[y])))
        j, y, out = n, int(top[n].argmax()), []
        while j > 0:
            i, p, seg = back[j][y]
            if seg:
                out.append(seg)
            j, y = i, p
        return out[::-1]

    def step(self, n: int, found, gold: set[tuple[int, int, int]], rate: float, decay: float) -> None:
        """One step up the gradient of the log likelihood of the segmentation ``gold`` of (first atom, atom after, type)."""
        k = len(TYPES)
        scores = [self.score(s[4]) for s in found]
        by_end: list[list[int]] = [[] for _ in range(n + 1)]
        by_start: list[list[int]] = [[] for _ in range(n + 1)]
        for x, s in enumerate(found):
            by_end[s[1]].append(x)
            by_start[s[0]].append(x)
        fwd, bwd = np.full((n + 1, k), -np.inf), np.full((n + 1, k), -np.inf)
        fwd[0, 0], bwd[n] = 0.0, 0.0
        lse = lambda m, axis=0: np.logaddexp.reduce(m, axis=axis)
        for j in range(1, n + 1):
            fwd[j, 0] = lse(fwd[j - 1] + self.t[:, 0])
            for x in by_end[j]:
                fwd[j] = np.logaddexp(fwd[j], lse(fwd[found[x][0]][:, None] + self.t) + scores[x])
        for j in range(n - 1, -1, -1):
            bwd[j] = self.t[:, 0] + bwd[j + 1, 0]
            for x in by_start[j]:
                bwd[j] = np.logaddexp(bwd[j], lse(self.t + (scores[x] + bwd[found[x][1]])[None, :], 1))
        z = lse(fwd[n])
        for x, s in enumerate(found):
            p = np.exp(lse(fwd[s[0]][:, None] + self.t) + scores[x] + bwd[s[1]] - z)
            g = -p
            for y in range(1, k):
                g[y] += (s[0], s[1], y) in gold
            g[0] = 0.0
            if np.abs(g).max() > 1e-4:
                for name in s[4]:
                    v = self.w.setdefault(name, np.zeros(k))
                    v += rate * (g - decay * v)
            joint = np.exp(fwd[s[0]][:, None] + self.t + scores[x][None, :] + bwd[s[1]][None, :] - z)
            self.t -= rate * 0.1 * joint
        single = np.exp(fwd[:-1] + self.t[:, 0][None, :] + bwd[1:, :1] - z).sum(0)
        prev, ends = 0, {a: (b, y) for a, b, y in gold}
        j = 0
        while j < n:
            b, y = ends.get(j, (j + 1, 0))
            if y:
                self.t[prev, y] += rate * 0.1
            else:
                single[prev] -= 1
            j, prev = b, y
        self.t[:, 0] -= rate * 0.1 * single


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _luhn_number(r: random.Random, n: int) -> str:
    s = _digits(r, n - 1)
    return next(s + c for c in "0123456789" if luhn(s + c))


def _word(r: random.Random) -> str:
    return "".join(r.choice("abcdefghijklmnoprstuvwxyzéüñ") for _ in range(r.randint(2, 9)))


def sample_entity(r: random.Random) -> tuple[str, str, str]:
    """(words before, value, type)."""
    kind = r.choice(TYPES[1:])
    if kind == "EMAIL":
        local = r.choice([_word(r), f"{_word(r)}.{_word(r)}", f"{_word(r)}.{_digits(r, 2)}", f"{_word(r)}_{_digits(r, 3)}", f"{_word(r)}+{_word(r)}"])
        if r.random() < 0.1:
            return r.choice(["", "mail", "contact"]), f"{_word(r)[:1]}@{_word(r)[: r.randint(1, 2)]}.{r.choice(['co', 'de', 'io', 'com'])}", kind
        return r.choice(["", "mail", "contact"]), f"{local}@{r.choice(['mail' + _digits(r, 1) + '.', 'mx.', ''])}{r.choice(['example', 'site', 'web'])}.{r.choice(['com', 'org', 'net', 'de', 'co.uk'])}", kind
    if kind == "PHONE":
        a, b, c = _digits(r, 3), _digits(r, 3), _digits(r, 4)
        plain = r.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{r.randint(1, 99)} {a} {b} {c}", f"+1-{a}-{b}-{c}", f"+49 {_digits(r, 3)} {_digits(r, 4)}", f"{a} {b} {c}", f"{a}.{b}.{c}", f"+33 {' '.join(_digits(r, 2) for _ in range(4))}"])
        if r.random() < 0.4:
            plain = r.choice([f"+1{a}{b}{c}", f"+{r.randint(20, 99)}{_digits(r, r.randint(8, 11))}", f"({a}) {b}{c}", f"({a}){b}{c}", f"+{r.randint(20, 99)} {_digits(r, 2)} {_digits(r, r.randint(6, 8))}", f"+{r.randint(20, 99)} {_digits(r, 4)} {_digits(r, 6)}", f"+{r.randint(20, 99)} (0){_digits(r, 2)} {_digits(r, 4)} {_digits(r, 4)}", f"+{r.randint(20, 99)} {_digits(r, 10)}"])
        if r.random() < 0.15:  # without any sign only words tell them from other numbers
            return r.choice(["tel", "phone", "call", "mobile"]), _digits(r, r.choice([7, 9, 10, 10, 10, 11])), kind
        return r.choice(["", "", "tel", "phone", "call"]), plain, kind
    if kind == "IBAN":
        body = _digits(r, r.choice([12, 14, 16, 18, 20]))
        land = r.choice(["DE", "FR", "ES", "IT", "GB", "NL", "AT", "CH"])
        value = next(v for k in range(2, 99) if iban(v := f"{land}{k:02d}{body}"))
        return r.choice(["", "iban", "account"]), r.choice([value, " ".join(value[k : k + 4] for k in range(0, len(value), 4))]), kind
    if kind == "IP" and r.random() < 0.3:
        groups = [f"{r.randrange(65536):x}" for _ in range(8)]
        return r.choice(["", "ip", "host"]), r.choice([":".join(groups), "fe80::" + ":".join(groups[:4]), "2001:db8::" + groups[0], "2001:db8:" + groups[1] + "::1"]), kind
    if kind == "IP":
        return r.choice(["", "ip", "host"]), ".".join(str(r.randint(0, 255)) for _ in range(4)), kind
    if kind == "CARD":
        n = r.choice([16, 16, 16, 15, 13, 19])
        s = _digits(r, 16) if n == 16 and r.random() < 0.5 else _luhn_number(r, n)
        return r.choice(["", "", "card", "visa"]), r.choice([s, s, s, " ".join(s[k : k + 4] for k in range(0, 16, 4)) if n == 16 else s, "-".join(s[k : k + 4] for k in range(0, 16, 4)) if n == 16 else s]), kind
    n = r.choice([40, 40, 32, 64, 24])
    value = "".join(r.choice("0123456789abcdef") for _ in range(n))
    if n == 24:
        value = "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n)) + "7"
    if r.random() < 0.3:
        value = value.upper()
    return r.choice(["token =", "key:", "secret =", "password:", "token ="]), value, kind


def sample_other(r: random.Random) -> str:
    y = r.randint(1900, 2099)
    return r.choice(
        [
            "Version 2.0.", "4.0.", "3.", f"{y}", f"{y}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", f"{r.randint(1, 28)}.{r.randint(1, 12)}.{y}", f"{r.randint(1, 12)}/{r.randint(1, 28)}/{y}", f"{r.randint(0, 23)}:{r.randint(0, 59):02d}",
            f"order {_digits(r, 8)}", f"{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 20)}", f"{r.randint(1, 9)}.{r.randint(0, 9)}.{r.randint(0, 9)}.{r.randint(300, 999)}", f"{_digits(r, 2)},{_digits(r, 3)}.{_digits(r, 2)}", f"page {r.randint(1, 999)}", f"@{_word(r)}{r.randint(1, 99)}",
            f"{_word(r)}@{_word(r)}", f"{y}-{y + 1}", f"{_digits(r, 5)}", f"{_digits(r, 10)}", f"{_digits(r, 12)}", f"invoice {_digits(r, 12)}", f"{_word(r)}{_digits(r, 2)}", f"{_digits(r, 2)} {_digits(r, 2)} {_digits(r, 3)}", f"commit {''.join(r.choice('0123456789abcdef') for _ in range(40))}", f"{r.randint(10, 999)} x {r.randint(10, 999)}", f"{_digits(r, 3)} {_digits(r, 3)}", f"item{_digits(r, 16)}x",
            f"{_digits(r, r.randint(6, 11))}", f"order {_digits(r, 10)}", f"id {_digits(r, r.randint(6, 11))}", f"{_digits(r, r.randint(4, 7))}.{_digits(r, r.randint(2, 6))}", f"{_digits(r, 6)}-{_digits(r, 4)}", f"{_digits(r, 4)} {_digits(r, 6)}", f"a{r.randint(1, 9)}@b", f"+{r.randint(1, 99)}",
            f"{r.randint(0, 23):02d}:{r.randint(0, 59):02d}:{r.randint(0, 59):02d}", f"{r.randint(1, 9)}:{r.randint(1, 9)}:{r.randint(1, 9)}", f"ab{_digits(r, 2)} {_digits(r, 4)} {_digits(r, 4)}", f"DE{_digits(r, 12)}",
        ]
    )


def sample_line(r: random.Random) -> tuple[str, list[tuple[int, int, str]]]:
    """A line and the (start, end, type) of its entities."""
    text, marks = "", []
    for _ in range(r.randint(1, 5)):
        text += " ".join(_word(r) for _ in range(r.randint(0, 3))) + " "
        if r.random() < 0.55:
            before, value, kind = sample_entity(r)
            text += before + " " if before else ""
            open_, close = r.choice([("", ""), ("", ""), ("", "."), ('"', '"'), ("", "###"), ("(", ")"), ("", ","), ("", "!!")]) if kind != "PHONE" else r.choice([("", ""), ("", "."), ("", "###"), ("", ",")])
            marks.append((len(text) + len(open_), len(text) + len(open_) + len(value), kind))
            text += open_ + value + close + " "
        else:
            text += sample_other(r) + " "
    return text.strip(" ") + " ", [m for m in marks] if not text.startswith(" ") else [(a - (len(text) - len(text.lstrip(" "))), b - (len(text) - len(text.lstrip(" "))), k) for a, b, k in marks]


@lru_cache(2)
def trained(lines: int = 700, epochs: int = 6, seed: int = 11) -> Field:
    r, field, data = random.Random(seed), Field(), []
    for _ in range(lines):
        text, marks = sample_line(r)
        for a, b in regions(text):
            n, found = segments(text[a:b], text[:a], text[b:])
            place = {(s[2] + a, s[3] + a): (s[0], s[1]) for s in found}
            gold = {(*place[x, y], TYPES.index(t)) for x, y, t in marks if (x, y) in place}
            data.append((n, found, gold))
    for e in range(epochs):
        r.shuffle(data)
        for n, found, gold in data:
            if found:
                field.step(n, found, gold, 0.3 / (1 + e), 1e-3)
    return field


_MARK = re.compile(r"[0-9@]")
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ANCHOR = np.zeros(256, bool)
_ANCHOR[0x30:0x3A] = True
_ANCHOR[0x40] = True


def _byte_regions(data: np.ndarray) -> list[tuple[int, int]]:
    """Runs of tokens that hold an anchor each and have one sign of white space between them."""
    space = np.flatnonzero(_SPACE[data])
    token = np.unique(np.searchsorted(space, np.flatnonzero(_ANCHOR[data])))  # by the number of spaces before it
    if not len(token):
        return []
    edge = np.concatenate([[-1], space, [len(data)]])
    start, end = edge[token] + 1, edge[token + 1]
    line = data[np.minimum(end, len(data) - 1)] == 10
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1] + 1) | line[:-1]
    first = np.flatnonzero(new)
    return list(zip(start[first].tolist(), end[np.append(first[1:], len(token)) - 1].tolist()))


def regions(text: str) -> list[tuple[int, int]]:
    raw = text.encode("utf-8", "replace")
    return [(len(raw[:a].decode("utf-8", "replace")), len(raw[:b].decode("utf-8", "replace"))) for a, b in _byte_regions(np.frombuffer(raw, "u1"))]


#: Bytes that hold the signs of context, four each at most.
_CONTEXT = 240


def find(field: Field, raw: bytes) -> list[tuple[int, int, str, float]]:
    """(start, end, type, score) in characters of a UTF-8 text."""
    out: list[tuple[int, int, str, float]] = []
    chars, upto = 0, 0
    for a, b in _byte_regions(np.frombuffer(raw, "u1")):
        chars += len(raw[upto:a].decode("utf-8", "replace"))
        upto = a
        text = raw[a:b].decode("utf-8", "replace")
        if len(text) < 6 and "::" not in text:  # no entity is shorter than a@b.co but for IPv6 addresses
            continue
        n, found = segments(text, raw[max(0, a - _CONTEXT) : a].decode("utf-8", "ignore"), raw[b : b + 8].decode("utf-8", "ignore")[:2])
        if found:
            out += [(chars + s[2], chars + s[3], TYPES[s[4]], s[5]) for s in field.best(n, found)]
    return out


def _finder(field: Field):
    def run(batches):
        for pdf in batches:
            rows = []
            for i, t in zip(pdf["id"].tolist(), pdf["t"]):
                rows += [(i, *hit) for hit in find(field, t.encode("utf-8", "replace"))]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "end", "pii_type", "score"]).astype({"doc_id": "Int64"})

    return run


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None) -> DataFrame:
    """(doc_id, start, end, pii_type, score) of each entity."""
    inner, (i, t) = isolate(docs, id_col, text_col)
    texts = inner.select(i.cast("long").alias("id"), t.alias("t")).where(F.col("t").rlike("[0-9@]"))
    return texts.mapInPandas(_finder(field or trained()), SCHEMA)


def redact(docs: DataFrame, text_col: str = "text", field: Field | None = None) -> DataFrame:
    """``docs`` with each entity replaced by its type in angle brackets, all other columns as they are."""
    inner, (t,) = isolate(docs, text_col)
    name = f"__in{place(docs, text_col)}"
    own = field or trained()

    @F.pandas_udf("string")
    def clean(text: pd.Series) -> pd.Series:
        def one(s):
            if not s or not _MARK.search(s):
                return s
            for a, b, kind, _ in reversed(find(own, s.encode("utf-8", "replace"))):
                s = f"{s[:a]}<{kind}>{s[b:]}"
            return s

        return text.map(one)

    return restore(inner.withColumn(name, clean(t)), docs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(table(spark, sf_dir, "documents"))
