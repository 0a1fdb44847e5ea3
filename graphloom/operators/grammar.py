"""Language tables: how a language is cut into tokens, and which token patterns are symbols.

A pattern is a line of atoms:

    word    that token              NAME    a name, captured
    ()      a balanced group        <>      a balanced group of angles, if there is one
    ...     tokens up to what comes next in the pattern, over groups, not over ; or a brace
    {}      a balanced block; the symbol ends with it
    ;       the symbol ends with it

The tables are data: they can be read from and written to JSON, and a table that is passed
to the extraction adds a language or takes the place of one.
"""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field
from functools import lru_cache

from graphloom.schema import LANGUAGES


@dataclass(frozen=True)
class Language:
    """Token and symbol tables of a language. Without patterns a file gives its file node only."""

    name: str
    comments: tuple[tuple[str, str], ...] = (("//", "\n"), ("/*", "*/"))
    strings: tuple[str, ...] = ('"', "'")
    long_strings: tuple[str, ...] = ()  # may cross lines
    directives: str = ""  # a line that begins with it is no code
    symbols: tuple[tuple[str, str], ...] = ()  # kind (class, function, import), pattern
    not_after: tuple[str, ...] = ()  # a function is none after one of these tokens
    typed: bool = False  # functions begin with a type, and those right inside a class are none
    not_calls: tuple[str, ...] = ("if", "for", "while", "switch", "catch", "return", "new", "sizeof", "function", "throw", "else", "do", "delete", "await", "typeof", "constructor", "super")
    python: bool = field(default=False)  # parsed by the standard grammar


# The languages that have symbols, and what counts as one.
TABLES = {
    t.name: t
    for t in (
        Language("python", python=True),
        Language("java", symbols=(("class", "class NAME ... {}"), ("import", "import ... ;")), not_after=(".",)),
        Language(
            "typescript", long_strings=("`",), symbols=(("class", "class NAME ... {}"), ("function", "function NAME <> () ... {}"), ("import", "import ... ;")),
            not_after=("=", "(", ",", ":", "?", "[", "&", "|", "!", "+", "-", ">", ".", "return", "typeof", "new"),
        ),
        Language("cpp", directives="#", symbols=(("class", "class NAME ... {}"), ("function", "NAME () ... {}")), typed=True, not_after=("enum",)),
    )
}


def language(name: str, tables: dict[str, Language] | None = None) -> Language:
    """The table of a language; ValueError for one that is not known."""
    known = TABLES | (tables or {})
    if name in known:
        return known[name]
    if name in LANGUAGES:
        return Language(name)
    raise ValueError(f"Unsupported language: {name}. Supported: {sorted({*LANGUAGES, *known})}")


def dump_tables(tables: dict[str, Language]) -> str:
    return json.dumps({n: asdict(t) for n, t in tables.items()}, indent=1)


def load_tables(text: str) -> dict[str, Language]:
    """Tables of dump_tables' JSON; unknown fields raise TypeError."""
    frozen = lambda v: tuple(map(frozen, v)) if isinstance(v, list) else v
    return {n: Language(**{k: frozen(v) for k, v in t.items()}) for n, t in json.loads(text).items()}


@lru_cache(maxsize=64)
def lexer(table: Language) -> re.Pattern:
    """One pattern of all tokens; what opens and is not closed becomes a token of kind bad."""
    every = re.escape
    parts = []
    if table.directives:
        parts.append(rf"(?P<skip>^[ \t]*{every(table.directives)}(?:\\\n|[^\n])*)")
    gone = [f"{every(a)}[^\n]*" if b == "\n" else f"{every(a)}.*?{every(b)}" for a, b in table.comments]
    gone += [rf"{every(q)}(?:\\.|[^{every(q)}\\\n])*{every(q)}" for q in table.strings]
    gone += [rf"{every(q)}(?:\\.|[^{every(q)}\\])*{every(q)}" for q in table.long_strings]
    parts.append(f"(?P<gone>{'|'.join(gone)})")
    opened = [every(a) for a, b in table.comments if b != "\n"] + [every(q) for q in (*table.strings, *table.long_strings)]
    parts.append(f"(?P<bad>{'|'.join(opened)})")
    parts.append(r"(?P<name>[^\W\d]\w*)|(?P<number>\d\w*)|(?P<mark>::|->|=>|[^\s\w])")
    return re.compile("|".join(parts), re.S | re.M)


PAIRS = {"(": ")", "[": "]", "{": "}"}


class Tokens:
    """Tokens of a text without comments and strings, the partner of each bracket, and how many errors there are."""

    def __init__(self, table: Language, source: str):
        self.text, self.start, self.errors = [], [], 0
        for m in lexer(table).finditer(source):
            if m.lastgroup == "bad":
                self.errors += 1
            elif m.lastgroup not in ("gone", "skip"):
                self.text.append(m[0])
                self.start.append(m.start())
        self.partner: dict[int, int] = {}
        self.above: list[int] = []  # for each token, the brace that is open around it, or -1
        stack: list[int] = []
        braces = [-1]
        for i, t in enumerate(self.text):
            self.above.append(braces[-1])
            if t in PAIRS:
                stack.append(i)
                if t == "{":
                    braces.append(i)
            elif t in ")]}":
                while stack and PAIRS[self.text[stack[-1]]] != t and t == "}" and self.text[stack[-1]] != "{":
                    stack.pop()  # a brace closes what was left open within it
                    self.errors += 1
                if stack and PAIRS[self.text[stack[-1]]] == t:
                    self.partner[stack.pop()] = i
                    if t == "}":
                        braces.pop()
                else:
                    self.errors += 1
        self.errors += len(stack)

    def is_call(self, i: int) -> bool:
        """Whether token i is a name before a group that is neither defined here nor the head of a block."""
        t, n = self.text[i], len(self.text)
        if i + 1 >= n or self.text[i + 1] != "(" or not (t[0].isalpha() or t[0] == "_"):
            return False
        after = self.partner.get(i + 1, n) + 1
        return (i == 0 or self.text[i - 1] != "function") and (after >= n or self.text[after] != "{")

    def match(self, i: int, atoms: list[str]) -> tuple[str, int, int] | None:
        """Name, body token and last token of a pattern that begins at token i; the body is -1 where it has none."""
        name, n = "", len(self.text)
        for k, atom in enumerate(atoms):
            if i >= n:
                return None
            t = self.text[i]
            if atom == "NAME":
                if not (t[0].isalpha() or t[0] == "_"):
                    return None
                name = t
            elif atom == "()":
                if t != "(" or i not in self.partner:
                    return None
                i = self.partner[i]
            elif atom == "<>":
                if t != "<":
                    continue
                depth = 0
                while i < n and self.text[i] not in ";)]}":
                    depth += (self.text[i] == "<") - (self.text[i] == ">")
                    if not depth:
                        break
                    i = self.partner.get(i, i) + 1
            elif atom == "...":
                until = "{" if atoms[k + 1] == "{}" else atoms[k + 1]
                while i < n and self.text[i] != until:
                    if self.text[i] in ";)]}" or self.text[i] == "{" and until != ";":
                        return None
                    i = self.partner.get(i, i) + 1
                continue
            elif atom == "{}":
                if t != "{":
                    return None
                return name, i, self.partner.get(i, n - 1)
            elif t != atom:
                return None
            i += 1
        return name, -1, i - 1


__all__ = ["TABLES", "Language", "Tokens", "dump_tables", "language", "lexer", "load_tables"]
