"""A reader for the parts of Go, JavaScript and TypeScript that become graph entities.

Source is split into tokens with their places; declarations are found at the depths where the languages have them, and
bodies by matching brackets. Plain Python without Spark; extract.py runs it over tables.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field
from itertools import accumulate

LANGUAGES = {"go": "go", "js": "javascript", "ts": "typescript"}

TOKEN = re.compile(
    r"(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<string>\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)"
    r"|(?P<word>[A-Za-z_$][\w$]*)|(?P<number>\d[\w.]*)|(?P<space>\s+)|(?P<sign>:=|=>|\.\.\.|[^\s\w])",
    re.S,
)
CLOSE = {"(": ")", "[": "]", "{": "}"}
# Words that stand before a bracket without being called.
NOT_CALLED = {"if", "for", "while", "switch", "return", "func", "function", "catch", "typeof", "new", "await", "else", "go", "defer", "range", "case", "select", "constructor", "super", "import", "async"}


@dataclass
class Token:
    kind: str
    text: str
    start: int
    end: int


@dataclass
class Entity:
    kind: str
    name: str
    qualified: str
    start: int
    end: int
    parent: str | None = None
    body: tuple[int, int] | None = None  # tokens of the body, without its brackets
    calls: dict[str, int] = field(default_factory=dict)
    heritage: list[tuple[str, str]] = field(default_factory=list)


def tokens(source: str) -> list[Token]:
    return [Token(m.lastgroup, m.group(), m.start(), m.end()) for m in TOKEN.finditer(source) if m.lastgroup != "space"]


def _match(ts: list[Token], at: int) -> int:
    """The place of the bracket that closes the one at; the end where it is never closed."""
    close, depth = [], 0
    for i in range(at, len(ts)):
        t = ts[i].text if ts[i].kind == "sign" else ""
        if t in CLOSE:
            close.append(CLOSE[t])
        elif close and t == close[-1]:
            close.pop()
            if not close:
                return i
        depth = len(close)
    return len(ts) - 1 if depth else at


def _find(ts: list[Token], at: int, sign: str, stop: str = "") -> int | None:
    """The next sign at this depth from at; None at a stop sign or the end."""
    i = at
    while i < len(ts):
        t = ts[i].text
        if ts[i].kind == "sign":
            if t == sign:
                return i
            if stop and t in stop:
                return None
            if t in CLOSE:
                i = _match(ts, i)
        i += 1
    return None


def parse(path: str, source: str) -> dict:
    """entities, relations, unresolved, imports of one file; ValueError for a language that isn't read.

    Entities: (qualified, kind, name, start, end), the File first, qualified by the path. Relations: (from, type, to,
    weight), by qualified names. Calls match by plain name within the file, the last declaration of a name winning;
    calls of Go to other names are dropped, those of the other languages are unresolved (caller, name, weight).
    """
    ending = path.rsplit(".", 1)[-1] if "." in path.rsplit("/", 1)[-1] else ""
    if ending not in LANGUAGES:
        raise ValueError(f"no reader for {path}")
    ts = [t for t in tokens(source) if t.kind != "comment"]
    found = _go(ts) if ending == "go" else _script(ts, ending == "ts")
    found.sort(key=lambda e: e.start)
    names: dict[str, str] = {}
    for e in found:
        if e.kind in ("Function", "Method", "Class"):
            names[e.name] = e.qualified
    relations: list[tuple[str, str, str, int | None]] = []
    unresolved = []
    by_name = {e.name: e.qualified for e in found if e.kind in ("Class", "Interface")}
    for e in found:
        relations.append((e.parent or path, "CONTAINS", e.qualified, None))
        for kind, target in e.heritage:
            if target in by_name:
                relations.append((e.qualified, kind, by_name[target], None))
        if e.body:
            for name, n in sorted(_calls(ts, *e.body).items()):
                if name in names:
                    relations.append((e.qualified, "CALLS", names[name], n))
                elif ending != "go":
                    unresolved.append((e.qualified, name, n))
    entities = [(path, "File", path.rsplit("/", 1)[-1], 0, len(source))] + [(e.qualified, e.kind, e.name, e.start, e.end) for e in found]
    return {"entities": entities, "relations": relations, "unresolved": unresolved, "imports": [] if ending == "go" else imports(source)}


def _calls(ts: list[Token], start: int, end: int) -> dict[str, int]:
    out: dict[str, int] = {}
    for i in range(start, min(end, len(ts) - 1)):
        if ts[i].kind == "word" and ts[i + 1].text == "(" and ts[i].text not in NOT_CALLED and ts[i - 1].text != "new":
            out[ts[i].text] = out.get(ts[i].text, 0) + 1
    return out


def _go(ts: list[Token]) -> list[Entity]:
    out, i = [], 0
    while i < len(ts):
        t = ts[i].text
        if t == "type" and i + 2 < len(ts) and ts[i + 2].text in ("struct", "interface"):
            at = _find(ts, i + 3, "{")
            if at is None:
                break
            end = _match(ts, at)
            kind = "Class" if ts[i + 2].text == "struct" else "Interface"
            out.append(Entity(kind, ts[i + 1].text, ts[i + 1].text, ts[i].start, ts[end].end))
            i = end
        elif t == "func" and i + 1 < len(ts):
            receiver, at = "", i + 1
            if ts[at].text == "(":
                close = _match(ts, at)
                words = [x.text for x in ts[at + 1 : close] if x.kind == "word"]
                receiver = words[1] if len(words) > 1 else words[0] if words else ""
                at = close + 1
            if at + 1 < len(ts) and ts[at].kind == "word":
                name = ts[at].text
                args = _find(ts, at, "(")
                body = _find(ts, _match(ts, args) + 1, "{") if args is not None else None
                if body is not None:
                    end = _match(ts, body)
                    out.append(Entity("Method" if receiver else "Function", name, f"{receiver}.{name}" if receiver else name, ts[i].start, ts[end].end, body=(body + 1, end)))
                    i = end
        elif t in CLOSE and ts[i].kind == "sign":
            i = _match(ts, i)
        i += 1
    return out


def _script(ts: list[Token], typed: bool) -> list[Entity]:
    out, i = [], 0
    while i < len(ts):
        t, start = ts[i].text, ts[i].start
        if t == "class" and i + 1 < len(ts) and ts[i + 1].kind == "word":
            name, at = ts[i + 1].text, _find(ts, i + 2, "{")
            if at is None:
                break
            end = _match(ts, at)
            out.append(Entity("Class", name, name, start, ts[end].end, heritage=_heritage(ts[i + 2 : at]) if typed else []))
            out += _members(ts, at + 1, end, name)
            i = end
        elif typed and t == "interface" and i + 1 < len(ts) and ts[i + 1].kind == "word":
            name, at = ts[i + 1].text, _find(ts, i + 2, "{")
            if at is None:
                break
            end = _match(ts, at)
            out.append(Entity("Interface", name, name, start, ts[end].end, heritage=_heritage(ts[i + 2 : at])))
            out += _members(ts, at + 1, end, name)
            i = end
        elif t == "function":
            at = i + 2 if i + 1 < len(ts) and ts[i + 1].text == "*" else i + 1
            args = _find(ts, at, "(") if at < len(ts) and ts[at].kind == "word" else None
            body = _find(ts, _match(ts, args) + 1, "{") if args is not None else None
            if body is not None:
                end = _match(ts, body)
                out.append(Entity("Function", ts[at].text, ts[at].text, start, ts[end].end, body=(body + 1, end)))
                i = end
        elif t in CLOSE and ts[i].kind == "sign":
            i = _match(ts, i)
        i += 1
    return out


def _heritage(ts: list[Token]) -> list[tuple[str, str]]:
    out, kind = [], ""
    for t in ts:
        if t.text in ("extends", "implements"):
            kind = "EXTENDS" if t.text == "extends" else "IMPLEMENTS"
        elif kind and t.kind == "word":
            out.append((kind, t.text))
    return out


def _members(ts: list[Token], at: int, end: int, owner: str) -> list[Entity]:
    """Methods with a body, and method signatures, of a class or interface."""
    out, i = [], at
    while i < end:
        if ts[i].kind == "word" and i + 1 < end and ts[i + 1].text == "(" and ts[i].text not in ("if", "for", "while", "switch", "return"):
            close = _match(ts, i + 1)
            body = _find(ts, close + 1, "{", ";}=")
            stop = ts[close].end
            if body is not None and body < end:
                last = _match(ts, body)
                out.append(Entity("Method", ts[i].text, f"{owner}.{ts[i].text}", ts[i].start, ts[last].end, owner, (body + 1, last)))
                i = last
            else:
                out.append(Entity("Method", ts[i].text, f"{owner}.{ts[i].text}", ts[i].start, stop, owner))
                i = close
        elif ts[i].kind == "sign" and ts[i].text in CLOSE:
            i = _match(ts, i)
        i += 1
    return out


NAMED_IMPORT = re.compile(r"import\s+(?:type\s+)?(?:[\w$]+\s*,\s*)?\{([^}]*)\}\s*from\s*[\"']([^\"']+)[\"']")


def imports(source: str) -> list[tuple[str, str, str]]:
    """(local, imported, specifier) of named imports; default and namespace imports bind no name of the other file."""
    out = []
    for m in NAMED_IMPORT.finditer(source):
        for part in m.group(1).split(","):
            words = part.split()
            if words and words[0] == "type":
                words = words[1:]
            if len(words) == 1:
                out.append((words[0], words[0], m.group(2)))
            elif len(words) == 3 and words[1] == "as":
                out.append((words[2], words[0], m.group(2)))
    return out


def merkle_hash(source: str) -> str:
    """A digest of the syntax that white space, comments and the names of Go's local variables don't change.

    Leaves are tokens, inner nodes brackets; a node's digest covers its kind and its children's digests. Inside braces,
    names that := or var declares are numbered in order of declaration.
    """
    ts = [t for t in tokens(source) if t.kind != "comment"]
    local: dict[str, str] = {}
    depth = 0
    for i, t in enumerate(ts):
        depth += (t.text == "{") - (t.text == "}")
        if depth and t.text == ":=":
            j = i - 1
            declared = []
            while j >= 0 and (ts[j].kind == "word" or ts[j].text == ","):
                if ts[j].kind == "word":
                    declared.append(ts[j].text)
                    if j == 0 or ts[j - 1].text != ",":
                        break
                j -= 1
            for name in reversed(declared):
                local.setdefault(name, f"LOCAL_{len(local)}")
        elif depth and t.text == "var" and i + 1 < len(ts) and ts[i + 1].kind == "word":
            local.setdefault(ts[i + 1].text, f"LOCAL_{len(local)}")

    def leaf(t: Token, inside: bool, after_dot: bool) -> str:
        text = local.get(t.text, t.text) if inside and not after_dot and t.kind == "word" else t.text
        return hashlib.sha256(f"{t.kind}{text}".encode()).hexdigest()

    stack: list[tuple[str, list[str]]] = [("file", [])]
    braces = 0
    for i, t in enumerate(ts):
        if t.kind == "sign" and t.text in CLOSE:
            stack.append((t.text, []))
            braces += t.text == "{"
        elif t.kind == "sign" and len(stack) > 1 and t.text == CLOSE[stack[-1][0]]:
            kind, kids = stack.pop()
            braces -= kind == "{"
            stack[-1][1].append(hashlib.sha256((kind + "".join(kids)).encode()).hexdigest())
        else:
            stack[-1][1].append(leaf(t, braces > 0, i > 0 and ts[i - 1].text == "."))
    while len(stack) > 1:
        kind, kids = stack.pop()
        stack[-1][1].append(hashlib.sha256((kind + "".join(kids)).encode()).hexdigest())
    return hashlib.sha256(("file" + "".join(stack[0][1])).encode()).hexdigest()


def doc_hash(source: str, start: int, ts: list[Token] | None = None) -> str | None:
    """SHA-256 of the comments directly above the offset, without a blank line between; None if there are none. ts: the tokens of source, if known."""
    ts = tokens(source) if ts is None else ts
    last = bisect_left(ts, start, key=lambda t: t.start) - 1
    first, end = last + 1, start
    while first and ts[first - 1].kind == "comment" and source.count("\n", ts[first - 1].end, end) <= 1:
        first -= 1
        end = ts[first].start
    return hashlib.sha256(source[ts[first].start : ts[last].end].encode()).hexdigest() if first <= last else None


def syntax_ok(language: str, source: str) -> bool:
    """Whether brackets and strings of a known language close; False for a language that isn't read."""
    if language not in ("go", "javascript", "typescript", "js", "ts"):
        return False
    open_ = []
    for t in tokens(source):
        if t.kind == "sign":
            if t.text in CLOSE:
                open_.append(CLOSE[t.text])
            elif t.text in CLOSE.values():
                if not open_ or open_.pop() != t.text:
                    return False
            elif t.text in "\"'`":
                return False
    return not open_


class _Outline:
    """Tokens of a span of source, where their brackets close, and how many characters other than white space came before.

    A bracket that is never closed, as in a cut-off text, counts as a plain sign.
    """

    def __init__(self, source: str, start: int, end: int) -> None:
        self.source, self.start = source, start
        self.ts = tokens(source[start:end])
        self.before = [0, *accumulate(not c.isspace() for c in source[start:end])]
        self.mate = list(range(len(self.ts)))
        still_open: list[int] = []
        waiting: dict[str, int] = {}
        for i, t in enumerate(self.ts):
            if t.kind != "sign":
                continue
            if t.text in CLOSE:
                still_open.append(i)
                waiting[CLOSE[t.text]] = waiting.get(CLOSE[t.text], 0) + 1
            elif waiting.get(t.text):
                while CLOSE[self.ts[still_open[-1]].text] != t.text:
                    waiting[CLOSE[self.ts[still_open.pop()].text]] -= 1
                waiting[t.text] -= 1
                self.mate[still_open.pop()] = i

    def size(self, first: int, last: int) -> int:
        return self.before[self.ts[last].end] - self.before[self.ts[first].start]

    def text(self, first: int, last: int) -> str:
        return self.source[self.start + self.ts[first].start : self.start + self.ts[last].end]

    def statements(self, first: int, last: int) -> list[tuple[int, int]]:
        """Ranges of tokens that end where a line does, outside brackets."""
        out, begun, i = [], first, first
        while i <= last:
            i = min(self.mate[i], last)
            if i == last or "\n" in self.source[self.start + self.ts[i].end : self.start + self.ts[i + 1].start]:
                out.append((begun, i))
                begun = i + 1
            i += 1
        return out

    def parts(self, first: int, last: int) -> list[tuple[int, int]]:
        """The statements of the range; of a single one, its head, the statements in its longest braces, and its tail. Empty if it has none."""
        found = self.statements(first, last)
        if len(found) > 1:
            return found
        longest, i = (0, 0), first
        while i <= last:
            close = self.mate[i]
            if self.ts[i].text == "{" and i < close <= last and close - i > longest[1] - longest[0]:
                longest = (i, close)
            i = close + 1
        if longest == (0, 0) or longest[0] + 1 == longest[1]:
            return []
        return [(first, longest[0]), *self.statements(longest[0] + 1, longest[1] - 1), (longest[1], last)]


def chunk_tree(source: str, start: int, end: int, budget: int = 1500) -> list[tuple[str, int]]:
    """(text, size) of the chunks of source[start:end]; size counts characters that are no white space.

    Whole if it fits. Otherwise its statements, or those within its longest braces, however deep: siblings between two
    that have to be split themselves are put together from the left, as many as fit. What has no parts may exceed the
    budget.
    """
    if budget < 1:
        raise ValueError("budget must be positive")
    outline = _Outline(source, start, end)
    if outline.before[-1] <= budget or not outline.ts:
        return [(source[start:end], outline.before[-1])]
    # ranges from right to left; None keeps what is on either side of it apart
    todo: list[tuple[int, int] | None] = [(0, len(outline.ts) - 1)]
    rows: list[list[tuple[int, int]]] = [[]]
    while todo:
        here = todo.pop()
        if here is None:
            rows.append([])
        elif outline.size(*here) > budget:
            parts = outline.parts(*here)
            if len(parts) > 1:
                todo += [None, *reversed(parts), None]
            else:
                rows += [[here], []]
        else:
            rows[-1].append(here)
    out = []
    for row in rows:
        ends = list(accumulate((outline.size(*r) for r in row), initial=0))
        i = 0
        while i < len(row):
            upto = max(bisect_right(ends, ends[i] + budget) - 1, i + 1)
            out.append((outline.text(row[i][0], row[upto - 1][1]), outline.size(row[i][0], row[upto - 1][1])))
            i = upto
    return out
