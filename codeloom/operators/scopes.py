"""Scopes of source text: what is code, which brackets belong together, what lies in which class or function.

``layers`` takes out comments, then strings, and keeps every position, so a pattern's matches on one text can be judged on another. ``pairs`` matches
brackets of the bare text and copes with files that were cut or never compiled. A definition's extent is the bracket that follows it; the owner of a
place is the innermost extent around it. All of it is linear in the text, up to a sort of the definitions.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable

#: Patterns of comments and strings by family; possessive, so that text without an end costs one pass.
_BLOCK = r"/\*[^*]*+(?:\*(?!/)[^*]*+)*+(?:\*/|\Z)"
_DOUBLE, _SINGLE = r'"(?:\\.|[^"\\\n])*+"', r"'(?:\\.|[^'\\\n])*+'"
_TEMPLATE = r"`(?:\\.|\$\{(?:[^{}`]|`[^`]*+`|\{[^{}]*+\})*+\}|\$(?!\{)|[^`\\$])*+`"
_REGEX = r"(?:(?<=[=(,:!&|?;])|(?<=[=(,:!&|?;] ))/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*+\]|[^/\\\n\[])++/[a-z]*"
FAMILIES = {
    "javascript": (rf"//[^\n]*+|{_BLOCK}", rf"{_DOUBLE}|(?<!\w){_SINGLE}|{_TEMPLATE}|{_REGEX}"),
    "java": (rf"//[^\n]*+|{_BLOCK}", rf'"""(?:\\.|"(?!"")|[^"\\])*+"""|{_DOUBLE}|{_SINGLE}'),
    "c++": (rf"//[^\n]*+|{_BLOCK}", rf'R"\((?:[^)]|\)(?!"))*+\)"|{_DOUBLE}|(?<!\w){_SINGLE}'),
    "c#": (rf"//[^\n]*+|{_BLOCK}", rf'@"(?:""|[^"])*+"|{_DOUBLE}|{_SINGLE}'),
    "go": (rf"//[^\n]*+|{_BLOCK}", rf"`[^`]*+`|{_DOUBLE}|{_SINGLE}"),
    "php": (rf"//[^\n]*+|#(?!\[)[^\n]*+|{_BLOCK}", rf"{_DOUBLE}|{_SINGLE}"),
    "python": (r"#[^\n]*+", rf'"""(?:\\.|"(?!"")|[^"\\])*+"""|\'\'\'(?:\\.|\'(?!\'\')|[^\'\\])*+\'\'\'|{_DOUBLE}|{_SINGLE}'),
}
_LEXERS = {k: re.compile(f"(?P<comment>{c})|(?P<string>{s})", re.DOTALL) for k, (c, s) in FAMILIES.items()}
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")": "(", "]": "[", "}": "{"}


#: Stands for what is left out: neither space nor word, so that no pattern walks through it.
HOLE = "\x01"


def blank(s: str) -> str:
    return re.sub(r"[^\n]", HOLE, s)


def layers(content: str, family: str) -> tuple[str, str]:
    """(code, bare), each as long as the text: without comments; without comments and what strings hold after their first sign."""
    code, bare, at = [], [], 0
    for m in _LEXERS[family].finditer(content):
        between, empty = content[at:m.start()], blank(m[0])
        code += [between, empty if m["comment"] is not None else m[0]]
        bare += [between, empty if m["comment"] is not None else m[0][0] + empty[1:]]
        at = m.end()
    return "".join([*code, content[at:]]), "".join([*bare, content[at:]])


def pairs(bare: str) -> dict[int, int]:
    """Place of the closing bracket by place of the opening one.

    A closing bracket that nothing opened is passed over; one that closes an outer bracket also ends those left open inside; brackets open at the
    end of the text end there.
    """
    out, stack, open_ = {}, [], {"(": 0, "[": 0, "{": 0}
    for m in re.finditer(r"[()\[\]{}]", bare):
        c = m[0]
        if c in _OPEN:
            stack.append((c, m.start()))
            open_[c] += 1
        elif open_[_CLOSE[c]]:
            while True:
                o, at = stack.pop()
                open_[o] -= 1
                out[at] = m.start()
                if o == _CLOSE[c]:
                    break
    out.update((at, len(bare)) for _, at in stack)
    return out


def hollow(bare: str, at: int, closes: dict[int, int]) -> str:
    """The inside of the bracket at ``at``, where inner brackets are kept and all that they hold is blank."""
    end, i, out = closes[at], at + 1, []
    for m in re.finditer(r"[(\[{]", bare[at + 1:end]):
        p = m.start() + at + 1
        if p < i:
            continue
        close = closes[p]
        out += [bare[i:p + 1], blank(bare[p + 1:close])]
        i = close
    return "".join([*out, bare[i:end]])


def extent(bare: str, at: int, closes: dict[int, int], arrow: bool = False) -> tuple[int, int] | None:
    """(start, end) of the body that follows place ``at``; none where a declaration ends without one.

    An arrow's body is a bracket, or an expression to the end of its statement: a semicolon, or a line's end outside of brackets.
    """
    i, n = at, len(bare)
    while i < n and bare[i].isspace():
        i += 1
    if arrow and i < n and bare[i] != "{":
        start = i
        while i < n and bare[i] not in ";)]}":
            if bare[i] in "([{":
                i = closes[i]
            elif bare[i] == "\n":
                break
            i += 1
        return start, min(i, n)
    while i < n:
        c = bare[i]
        if c == "{":
            return i, closes[i]
        if c in ";}":
            return None
        i = closes[i] + 1 if c in "([" else i + 1
    return None


class Owners:
    """Extents of named definitions, asked which is the innermost around a place."""

    def __init__(self, spans: Iterable[tuple[int, int, str]]):
        """spans: (start, end, name). Ends are cut to those of the span around, so that spans nest whatever the text."""
        self.starts, self.names, self.parents, self.ends = [], [], [], []
        stack: list[int] = []
        for start, end, name in sorted(spans, key=lambda s: (s[0], -s[1])):
            while stack and self.ends[stack[-1]] <= start:
                stack.pop()
            self.starts.append(start)
            self.ends.append(min(end, self.ends[stack[-1]]) if stack else end)
            self.names.append(name)
            self.parents.append(stack[-1] if stack else -1)
            stack.append(len(self.starts) - 1)

    def of(self, place: int) -> str | None:
        k = bisect_right(self.starts, place) - 1
        while k >= 0 and self.ends[k] <= place:
            k = self.parents[k]
        return self.names[k] if k >= 0 else None


_ID = r"[A-Za-z_$#][\w$]*"
#: Members of a class by family, over its hollow body: methods, then fields.
MEMBERS = {
    "javascript": (
        re.compile(rf"(?P<mods>(?:\b(?:public|private|protected|static|async|get|set|override)\s+)*)\*?\s*(?P<name>{_ID})\s*(?P<at>\()[^()]*+\)\s*(?::[^{{;=]+)?(?=\{{)"),
        re.compile(rf"(?:^|(?<=[;\n}}]))[ \t]*(?P<mods>(?:\b(?:public|private|protected|static|readonly|declare)\s+)*)(?P<name>{_ID})\??[ \t]*(?::[^=;\n(]+)?(?P<end>=(?!>)|;|\n|$)"),
    ),
    "java": (
        re.compile(r"(?P<mods>(?:\b(?:public|private|protected|static|abstract|final|synchronized|default)\s+)*)(?:<[^>()]*>\s*)?\b(?!return\b|new\b|else\b|throw\b)[A-Za-z_][\w.<>\[\], ?]*[\s>\]](?P<name>\w+)\s*(?P<at>\()[^()]*+\)\s*(?:throws\s+[\w, .]+)?\s*(?=[{;])"),
        re.compile(r"(?P<mods>\b(?:(?:public|private|protected|static|final|volatile|transient)\s+)+)[\w.<>\[\], ?]+?\s+(?P<name>\w+)\s*(?P<end>=|;)"),
    ),
    "c++": (
        re.compile(r"(?P<mods>(?:\b(?:virtual|static|inline|constexpr|explicit)\s+)*)\b(?!return\b|else\b|new\b)[A-Za-z_][\w:<>,*& ]*?[\s*&](?P<name>~?\w+)\s*(?P<at>\()[^()]*+\)\s*(?:const\b)?\s*(?:noexcept\b)?\s*(?:override\b|final\b)?\s*(?:=\s*\w+\s*)?(?=[{;])"),
        re.compile(r"(?:^|(?<=[;:}\n]))[ \t]*(?P<mods>(?:\b(?:static|mutable|const|constexpr)\s+)*)(?!return\b|public\b|private\b|protected\b|using\b|friend\b)[A-Za-z_][\w:<>,*& ]*?[\s*&](?P<name>\w+)(?:\[[^\]]*\])?\s*(?P<end>=|;)"),
    ),
}
