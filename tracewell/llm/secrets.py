"""Secret scans with assignment-aware lexing.

Base spans come from three fixed patterns. Beside them, a lexer reads name-literal pairs in source code, JSON, YAML, INI,
shell and XML style: bound names, quoted keys and subscripts, flags and elements; strings of one or more lines, joined
ones, and what is assigned inside strings and comments; braces are scopes. Names used as values lead to earlier bindings,
and the score of the most sensitive name flows back along them to the literals, which are scored by it and by their own
shape. Literals that score high enough become spans of kind `pair`.
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

from tracewell.llm.common import slices

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"

# Fixed values of the base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # runs are maximal, so a floor in the pattern drops the same matches
KINDS = {"assign": 0, "access": 1, "hex": 2, "pair": 3}
HINTS = ("password", "passwd", "secret", "token", "api")

#: How much a word inside a target name says that its value is secret.
NAME_WORDS = {"password": 3.0, "passwd": 3.0, "pwd": 3.0, "passphrase": 3.0, "secret": 3.0, "token": 2.5, "apikey": 3.0, "credential": 2.5, "credentials": 2.5, "private": 1.5, "auth": 1.5, "key": 1.5, "access": 1.0, "api": 1.0, "session": 1.0, "signature": 1.0, "salt": 1.0, "bearer": 2.0, "cert": 1.0}
DULL = re.compile(r"^(?:x+|\*+|\.+|-+|your[_-].*|example.*|change_?me.*|placeholder.*|none|null|true|false|todo.*|<.*>|\$\{.*\}|\{\{.*\}\}|%\(.*\)s)$", re.I)

#: Names that say nothing by themselves: what holds them decides.
NEUTRAL = {"value", "val", "default", "data", "text", "content", "string", "raw"}
#: Without one of these no name can score.
SENSITIVE = re.compile("|".join(sorted(NAME_WORDS)))

_STRING = r'''"""[\s\S]*?"""|\'\'\'[\s\S]*?\'\'\'|"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|`[^`]*+`'''
_NAME = r"[A-Za-z_$][\w$]*+(?:[.-][\w$]++)*+"
_OP = r"(?::=|=>|\+=|={1,3}|:(?!:))"
STRING, NAME = re.compile(_STRING), re.compile(_NAME)
TERM = re.compile(r"""[^\s,;"'`<>()\[\]{}]+""")
AFTER = re.compile(rf"\]?[ \t]*({_OP})")
JOIN = re.compile(r"[ \t]*(?:\+(?!=)|\.\.|\|\||&&?|\.)\s*")
BLANK = re.compile(r"[ \t]*")
REFERENCE = re.compile(r"^(?:\$\{?|\{\{\s*|%\()?([A-Za-z_][\w.-]*?)(?:\}|\s*\}\}|\)s)?$")
#: Where the lexer stops: a bound name (quoted or not), a flag, an element, a comment, a quote, a brace.
EVENT = re.compile(
    rf"""(?<![\w$.-])(?P<quote>["']?)(?P<name>{_NAME})(?P=quote)[ \t]*(?P<op>{_OP})|(?<!\S)--(?P<flag>[A-Za-z][\w-]*+)[ \t]+(?=[^\s-])|<(?P<tag>[A-Za-z_][\w.:-]*+)(?:\s[^<>]*+)?>(?P<inside>[^<>]*+)</"""
    rf"""|(?P<block>/\*|<!--)|(?<!\S)(?P<line>//|\#|--(?=\s))|(?<!\w)(?P<string>["'`])|(?P<open>\{{)|(?P<close>\}})"""
)
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
#: What ends a comment; others end with the line.
CLOSERS = {"/*": "*/", "<!--": "-->"}


def name_score(name: str) -> float:
    """Sum over the words of a name, camelCase and snake_case alike."""
    words = {w.lower() for w in WORDS.findall(name)}
    if {"api", "key"} <= words:
        words |= {"apikey"}
    return sum(NAME_WORDS.get(w, 0.0) for w in words)


def literal_score(value: str) -> float:
    """Bits of entropy a character, more for mixed character classes; dull values and short ones get none."""
    n = len(value)
    if n < 8 or DULL.match(value):
        return 0.0
    bits = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    classes = sum(map(bool, (re.search("[a-z]", value), re.search("[A-Z]", value), re.search("[0-9]", value), re.search("[^A-Za-z0-9]", value))))
    return bits + 0.5 * (classes - 1)


class Scopes:
    """Names of the open scopes. Each name has a stack of its bindings, so the innermost is found at once, however many scopes are open."""

    def __init__(self) -> None:
        self.held = [0.0]  # score of the name that holds each scope
        self.own: list[list[str]] = [[]]  # names bound in each
        self.bound: dict[str, list[tuple[int, int]]] = {}  # scope and binding, innermost last

    def open(self, score: float) -> None:
        self.held.append(score)
        self.own.append([])

    def close(self) -> None:
        if len(self.own) > 1:
            self.held.pop()
            for name in self.own.pop():
                self.bound[name].pop()

    def bind(self, name: str, binding: int) -> None:
        stack, scope = self.bound.setdefault(name, []), len(self.own)
        if stack and stack[-1][0] == scope:
            stack.pop()
        else:
            self.own[-1].append(name)
        stack.append((scope, binding))

    def get(self, name: str) -> int | None:
        stack = self.bound.get(name)
        return stack[-1][1] if stack else None


class Lexer:
    """Bindings of a text, in order: names, their literals, and the earlier bindings that they are made of.

    A binding keeps references and no values, so chains of constants cost what their text costs. Braces open scopes, of
    any number; comments and strings are lexed too, as regions with scopes of their own, one in another to any depth.
    What holds a comment does not read it, and a string holds none of its own kind of quotes, so no character is read
    more often than there are kinds, whatever the depth.
    """

    def __init__(self, text: str) -> None:
        self.text = text
        self.names: list[float] = []  # score of each binding's name
        self.uses: list[list[int]] = []  # earlier bindings in its value
        self.literals: list[tuple[list[tuple[int, int]], str]] = []  # spans in its value, and what they join to
        self.regions: list[tuple[int, int, frozenset[str]]] = [(0, len(text), frozenset())]  # still to be lexed
        while self.regions:
            self.walk(*self.regions.pop())

    def walk(self, at: int, end: int, absent: frozenset[str]) -> None:
        """Lex a region; absent: ends of comments that are known not to occur in it."""
        text, held = self.text, 0.0
        self.scopes = Scopes()
        self.unclosed: dict[str, int] = {}  # up to where no quote of a kind begins a string
        while m := EVENT.search(text, at, end):
            kind, at = m.lastgroup, m.end()
            if kind == "op":
                at, held = self.bind(m["name"], m["op"], at, end, absent)
            elif kind == "flag":
                at, held = self.bind(m["flag"], "", at, end, absent)
            elif kind == "inside":
                if text.startswith(m["tag"], at) and (value := m["inside"].strip()):
                    lo = m.start("inside") + m["inside"].index(value)
                    self.keep(m["tag"], [(lo, lo + len(value))], value, [])
                else:
                    self.regions.append((m.start("inside"), m.end("inside"), absent))
            elif kind in ("block", "line"):
                closer = CLOSERS.get(m[kind], "\n")
                close = -1 if closer in absent else text.find(closer, at, end)
                close = end if close < 0 else close
                self.regions.append((at, close, absent | {closer}))
                at = close
            elif kind == "string":
                if (s := self.string(m.start(), end)) is None:
                    continue
                at = s.end()
                if (after := AFTER.match(text, at, end)) and "\n" not in s[0]:  # a quoted key, or a subscript
                    at, held = self.bind(s[0].strip("\"'`"), after[1], after.end(), end, absent)
                else:
                    self.inner(s.start(), at, absent)
            elif kind == "open":
                self.scopes.open(held)
                held = 0.0
            else:
                self.scopes.close()

    def string(self, at: int, end: int) -> re.Match[str] | None:
        """The string that begins at `at`. Where a quote is not closed on its line, those of its kind behind it are escaped, and not closed either."""
        quote = self.text[at]
        if quote not in "\"'`" or at < self.unclosed.get(quote, 0):
            return None
        if (m := STRING.match(self.text, at, end)) is None:
            line = self.text.find("\n", at, end)
            self.unclosed[quote] = end if line < 0 else line
        return m

    def inner(self, lo: int, hi: int, absent: frozenset[str]) -> None:
        if hi - lo > 8:  # a name, an operator and the shortest literal that scores take more
            self.regions.append((lo + 1, hi - 1, absent))

    def keep(self, name: str, spans: list[tuple[int, int]], joined: str, uses: list[int]) -> float:
        score = self.scopes.held[-1] if name.lower() in NEUTRAL and self.scopes.held[-1] else name_score(name)
        self.scopes.bind(name, len(self.names))
        self.names.append(score)
        self.uses.append(uses)
        self.literals.append((spans, joined))
        return score

    def bound(self, word: str) -> int | None:
        """The binding that a word refers to, from the innermost scope out."""
        return self.scopes.get(m[1]) if (m := REFERENCE.match(word)) else None

    def bind(self, name: str, op: str, at: int, end: int, absent: frozenset[str]) -> tuple[int, float]:
        """Read the value at `at` and keep it; (where it ends, the name's score)."""
        text, spans, uses, strings = self.text, [], [], []
        if op == "+=" and (old := self.bound(name)) is not None:
            uses.append(old)
        at = BLANK.match(text, at, end).end()
        deep = 0
        while at < end and text[at] == "(":
            deep, at = deep + 1, re.compile(r"\s*").match(text, at + 1, end).end()
        while at < end:
            if m := self.string(at, end):
                width = 3 if m[0][:3] in ('"""', "'''") else 1
                lo, hi = m.start() + width, m.end() - width
                if (ref := self.bound(m[0][width:-width])) is not None and text[lo] in "$%{":
                    uses.append(ref)
                else:
                    spans.append((lo, hi))
                strings.append((m.start(), m.end()))
                at, quoted = m.end(), True
            elif m := TERM.match(text, at, end):
                word, quoted = m[0], False
                found = [self.bound(w) for w in word.split("+")]
                if None not in found:
                    uses += found
                elif text[m.end() : m.end() + 1] not in ("(", "[") and not re.fullmatch(r"[A-Za-z_]+(?:\.[A-Za-z_]+)+", word):
                    spans.append((m.start(), m.end()))
                at = m.end()
            else:
                break
            if m := JOIN.match(text, at, end):
                at = m.end()
            elif quoted and (m := re.compile(r"\s*" if deep else r"[ \t]*").match(text, at, end)) and text[m.end() : m.end() + 1] in ('"', "'"):
                at = m.end()
            else:
                break
        score = self.keep(name, spans, "".join(text[a:b] for a, b in spans), uses)
        for lo, hi in strings:
            self.inner(lo, hi, absent)
        return at, score

    def found(self) -> Iterator[tuple[float, str, list[tuple[int, int]]]]:
        """(score of the most sensitive name that the literals reach, what they join to, their spans) of each binding."""
        best = list(self.names)
        for k in range(len(best) - 1, -1, -1):  # a binding is used by later ones only
            for u in self.uses[k]:
                best[u] = max(best[u], best[k])
        for score, (spans, joined) in zip(best, self.literals):
            yield score, joined, spans


def scan(text: str, threshold: float = 5.0) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, spans the lexer adds), each by start, then kind."""
    low = text.lower()
    base = []
    if any(h in low for h in HINTS):
        base += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    if "AKIA" in text:
        base += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    base += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    more = set()
    if SENSITIVE.search(low):
        for name, value, spans in Lexer(text).found():
            if name >= 1.5 and (v := literal_score(value)) > 0 and name + v >= threshold:
                more |= {("pair", a, b) for a, b in spans if b > a}
    order = lambda s: (s[1], KINDS[s[0]], s[2])
    return sorted(base, key=order), sorted(more, key=order)


def shown(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 5.0) -> DataFrame:
    """Secrets in every whole text: counts and digest of the base spans, and all spans (code points, end exclusive).

    Null and empty texts have no spans (the digest is that of the empty string). Null ids and repeated rows pass
    through, a row each; an empty table gives an empty result; other columns are not read. Spans of different kinds may
    overlap; equal spans of one kind are listed once. Names, values and chains of constants may be of any length, and
    braces, comments and strings nest to any depth: time and memory grow with the text. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in slices(whole, "text", 4 << 20)):
            out: list[list] = [[], [], [], [], []]
            for text in batch.column(1).to_pylist():
                base, more = scan(text or "", threshold)
                kinds = Counter(k for k, _, _ in base)
                both = sorted(base + more, key=lambda s: (s[1], KINDS[s[0]], s[2]))
                for column, value in zip(out, (kinds["assign"], kinds["access"], kinds["hex"], hashlib.sha256(shown(base).encode()).hexdigest(), shown(both))):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in out[:3]), *(pa.array(c, pa.string()) for c in out[3:])],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)
