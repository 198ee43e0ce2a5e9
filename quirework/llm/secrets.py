"""Secret scans by assignment-aware lexing: names and the literals given to them, in source and configuration syntax.

Each text is lexed into assignments: name = "literal", name: literal, "name": "literal", export NAME=literal,
<tag name="literal">, name := 'literal', map["name"] => "literal". Right sides may join parts with + or . and may
refer to names assigned before, also inside strings as ${name}, $name, {name} or %(name)s; those constants are put in.
A literal is scored by the words in the name that it reaches and by how much like a secret it is itself.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id long, name string, start int, end int, masked string, secret_md5 string, score double"
#: Findings below are not reported.
LEAST = 0.5
NAME = r"""(?:[A-Za-z_$@][\w$@]*(?:(?:\.|->|::|-)[A-Za-z_$@][\w$@]*)*(?:\[\s*+(?:"[^"\n]++"|'[^'\n]++'|\w++)\s*+\])*|"[^"\n=:]++"|'[^'\n=:]++')"""
#: A name, perhaps its type on the same line, and a sign of assignment that isn't a comparison.
TARGET = re.compile(rf"(?<![\w$@.])(?<![\w$@.]-)({NAME})\s*+(?::[ \t]*+([A-Za-z_][\w.\[\]<>, ]*+)(?==[^=]))?(:=|=>|(?<![=!<>])=(?!=)|:(?![:/=\\]))[ \t]*+(?=\S)")
#: The name that ends what was read as a type, if it was none: "Note: the token = ".
LAST = re.compile(r"[A-Za-z_][\w.]*(?:\[\w*\])*")
BETWEEN = re.compile(r"[<>, ]")
#: What opens a string, and strings that end on their line.
OPEN = re.compile(r"""[rRbBuUfF@]{0,2}(\"{3}|'{3}|["'`])""")
LINE = {q: re.compile(rf"(?:[^{q}\\\n]|\\.)*+{q}", re.DOTALL) for q in "\"'"}
#: What ends a string over lines, or an escape, beyond which to go on.
ENDS = {q: re.compile(rf"\\.|{q}", re.DOTALL) for q in ('"""', "\'\'\'", "`")}
REFER = re.compile(r"\$?\{?[A-Za-z_][\w.]*\}?(?![\w(])")
BLANKS = re.compile(r"\s*")
#: Characters of constants that are put into the literals of a text, beyond its own length; references that would take
#: more stay as they are written, so that doubling a constant again and again does no harm.
ROOM = 1_000_000
#: A value without quotes ends at white space or at a sign that closes what it is in.
BARE = re.compile(r"[^\s\"'`,;<>{}()\[\]|#]+")
REFERENCE = re.compile(r"\$\{(\w+)\}|\$\((\w+)\)|\$(\w+)|%\((\w+)\)s|\{(\w+)\}")
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
HOT = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "passcode": 0.9, "pass": 0.8, "secret": 1.0, "secrets": 1.0, "token": 0.95, "tokens": 0.8, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "cred": 0.8, "creds": 0.8,
    "bearer": 0.9, "authorization": 0.9, "auth": 0.75, "oauth": 0.8, "jwt": 0.9, "signature": 0.6, "salt": 0.6, "pin": 0.6, "dsn": 0.6, "cookie": 0.6, "session": 0.55, "webhook": 0.6,
}
#: Pairs of neighbouring words in a name; "key" alone says little.
HOT_PAIRS = {("api", "key"): 1.0, ("private", "key"): 1.0, ("access", "key"): 1.0, ("secret", "key"): 1.0, ("auth", "key"): 1.0, ("encryption", "key"): 1.0, ("signing", "key"): 1.0, ("account", "key"): 0.9, ("master", "key"): 0.9, ("client", "secret"): 1.0, ("connection", "string"): 0.7, ("ssh", "key"): 0.9, ("license", "key"): 0.7}
#: Names that end so hold a property of a secret, not a secret.
COLD = frozenset("length size count type name id url uri path file expiry expires expiration ttl timeout field label hint prompt header format regex pattern enabled required policy count index limit max min".split())
#: Words that fillers are made of, such as your-key-here and my_password.
FILLER = "my|your|own|the|insert|enter|put|api|app|secret|password|passwd|pass|pwd|token|key|here|value|example|sample|dummy|placeholder|access|auth|client|database|db|user|name|string|goes|is|private"
DUMMY = re.compile(rf"(?i)^(?:(?:example|sample|dummy|placeholder|my|your|insert|enter|put)(?:[\W_]*+(?:{FILLER}|\d))*[\W_]*+|x+|\*+|\.+|-+|_+|0+|1234\w{{0,8}}|test\w{{0,4}}|changeme|change_me|todo|tbd|none|null|nil|true|false|undefined|redacted|password|passwd|secret|token|foo|bar|foobar|<.*>|\[.*\]|\{{.*\}}|\$\{{?.*\}}?|%.*%|(?:os\.|env\.|process\.env|getenv|sys\.).*)$")


SPLIT = re.compile("[?&]")


def entropy(text: str) -> float:
    """Bits per character."""
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def heat(name: str) -> float:
    """How much a name says that its value is a secret, from 0 to 1."""
    words = [w.lower() for w in WORDS.findall(name)]
    if not words:
        return 0.0
    best = max(HOT.get(w, 0.0) for w in words)
    best = max([best, *(HOT_PAIRS.get(p, 0.0) for p in zip(words, words[1:], strict=False))])
    return best * 0.2 if words[-1] in COLD else best


def strength(literal: str) -> float:
    """How much a literal is like a secret itself, from 0 to 1: long and of much variety, not a filler, not prose."""
    n = len(literal)
    if n < 4 or DUMMY.match(literal) or len(set(literal)) < 3:
        return 0.0
    spaces = literal.count(" ")
    base = min(1.0, 0.45 + 0.04 * (n - 4)) * min(1.0, entropy(literal) / 2.5)
    if spaces and not literal.startswith("-----BEGIN"):
        base *= 0.6 if spaces < 4 else 0.3
    kinds = sum(bool(re.search(k, literal)) for k in ("[a-z]", "[A-Z]", r"\d", r"[^\w\s]"))
    return base if kinds > 1 or n >= 20 else base * 0.7


def unquote(token: str) -> str:
    t = token.lstrip("rRbBuUfF@")
    t = t[3:-3] if t[:3] in ('"""', "'''") else t[1:-1]
    return t.replace('\\"', '"').replace("\\'", "'").replace("\\\\", "\\") if "\\" in t else t


class Lexer:
    """A text with what was assigned in it so far."""

    def __init__(self, text: str) -> None:
        self.text, self.known, self.room = text, {}, ROOM + len(text)
        #: For a kind of quote, a place from which on nothing closes one.
        self.open: dict[str, int] = {}

    def string(self, p: int) -> tuple[int, int, int] | None:
        """(start and end of what is in the string at p, its end), if there is one."""
        if not (m := OPEN.match(self.text, p)):
            return None
        quote, start = m[1], m.end()
        if quote in ENDS:
            if start < self.open.get(quote, len(self.text) + 1):
                for e in ENDS[quote].finditer(self.text, start):
                    if e[0] == quote:
                        return start, e.start(), e.end()
                self.open[quote] = start
            if quote == "`":
                return None
            quote, start = quote[0], start - 2  # an empty string, then
        if not (e := LINE[quote].match(self.text, start)):
            return None
        return start, e.end() - 1, e.end()

    def constant(self, name: str, else_: str) -> str:
        value = self.known.get(name, else_)
        if value is not else_:
            if len(value) > self.room:
                return else_
            self.room -= len(value)
        return value

    def fill(self, s: str) -> str:
        if not self.known or not ("$" in s or "{" in s or "%(" in s):
            return s
        return REFERENCE.sub(lambda m: self.constant(next(g for g in m.groups() if g), m[0]), s)

    def right(self, p: int, sign: str) -> tuple[list[str], int, list[tuple[int, int]]]:
        """The parts of the right side at p, its end, and where what is in its strings stands."""
        parts, end, inside = [], p, []
        while True:
            p = BLANKS.match(self.text, p).end()
            if q := self.string(p):
                parts.append(self.fill(unquote(self.text[p : q[2]])))
                inside.append(q[:2])
                end = q[2]
            elif (m := REFER.match(self.text, p)) and (ref := m[0].strip("${}")) in self.known and (sign != ":" or parts or m[0][0] == "$"):
                parts.append(self.constant(ref, m[0]))
                end = m.end()
            else:
                return parts, end, inside
            p = BLANKS.match(self.text, end).end()
            if self.text[p : p + 1] not in ("+", ".") or self.text[p : p + 2] in ("++", "+="):
                return parts, end, inside
            p += 1

    def run(self, at: int, stop: int) -> Iterator[tuple[str, str, int, int]]:
        while m := TARGET.search(self.text, at, stop):
            name, sign, start = m[1].strip("\"'"), m[3], m.end()
            # both readings: a name and its type, or a heading and a name
            other = q[0] if m[2] and (q := LAST.fullmatch(BETWEEN.split(m[2].rstrip())[-1])) else name
            name, other = (other, name) if heat(other) > heat(name) == 0 else (name, other)
            parts, end, inside = self.right(start, sign)
            if end > stop:
                parts, end, inside = [], start, []
            within: list[tuple[str, str, int, int]] = []
            if not parts and (b := BARE.match(self.text, start, stop)) and sign != "=>":
                parts, end = [self.fill(b[0])], b.end()
                # name=value once more, as in a query or an option
                within = [(n, v, start, end) for n, eq, v in (x.rpartition("=") for x in SPLIT.split(b[0])) if eq and v and heat(n)] if "=" in b[0] else []
            at = max(end, m.end()) if parts else m.end()
            if parts:
                value = "".join(parts)
                yield name, value, start, end
                yield from within
                for x in (other, name):
                    self.known[x.rpartition(".")[2]] = self.known[x] = value
                for a, b in inside:
                    if b - a > 4:
                        yield from self.run(a, b)


def assignments(text: str) -> Iterator[tuple[str, str, int, int]]:
    """(name, literal, start, end of the right side) of all assignments, constants put in, in order; after each, those
    that stand in its literal."""
    return Lexer(text).run(0, len(text))


def scan(text: str, least: float = LEAST) -> list[tuple[str, int, int, str, float]]:
    """(name, start, end, literal, score) of the assignments of a text that score ``least`` or more."""
    out = []
    for name, value, start, end in assignments(text):
        if (h := heat(name)) and (score := round(h * strength(value), 4)) >= least:
            out.append((name, start, end, value, score))
    return out


def mask(literal: str) -> str:
    return literal[:3] + "*" * min(8, max(1, len(literal) - 3))


def scan_docs(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, name, start, end, masked, secret_md5, score): a row for each secret found, places in characters from 0.

    The secret itself isn't passed on but for its first three characters and its MD5, by which copies can be joined.
    Texts without = or : don't leave the JVM. Null, empty and blank texts: no rows. Null id: reported with it. Repeated
    rows: each is reported. A name that is assigned twice: both. Long texts and literals: whole. Assignments within a
    literal are reported besides its own. No rows: none. Extra columns aren't passed on.
    """

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(i, n, s, e, mask(v), hashlib.md5(v.encode("utf-8", "surrogatepass")).hexdigest(), x) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for n, s, e, v, x in scan(t, least)]
            cols = list(zip(*out, strict=True)) or [[]] * 7
            types = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "name", "start", "end", "masked", "secret_md5", "score"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.filter(F.col("text").contains("=") | F.col("text").contains(":")).mapInArrow(one, SCHEMA)
