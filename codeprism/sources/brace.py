"""C, C++ and Java sources without a compiler: masking, a scope scan, a statement tree, and what is measured on it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

# Words of the languages.
CONTROL_WORDS = frozenset("if for while switch catch return sizeof new throw else do case default goto synchronized assert".split())
TYPE_WORDS = frozenset("class struct union interface enum record namespace".split())
MODIFIERS = frozenset("const volatile static struct class enum final transient register unsigned signed inline extern virtual explicit constexpr public private protected abstract native strictfp default friend mutable typename".split())
_TOKEN = re.compile(r"[A-Za-z_$][\w$]*|\d[\w.]*|->|::|&&|\|\||\+\+|--|<<=|>>=|<=|>=|==|!=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\.\.\.|[^\w\s]")


#: What mask blanks: comments, text blocks, strings and characters; group 1 is the mark between digits, which stays.
_HIDDEN = re.compile(r"""//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|\"{3}(?:\\(?:[\s\S]|\Z)|(?!\"{3})[^\\])*(?:\"{3}|\Z)|"(?:\\(?:[\s\S]|\Z)|[^"\\\n])*"?|((?<=[^\W_])'(?=[^\W_]))|'(?:\\(?:[\s\S]|\Z)|[^'\\\n])*'?""")
_VISIBLE = re.compile(r"[^\r\n]")


def mask(text: str, strings: bool = True) -> str:
    """text with comments, and strings, characters and text blocks, as blanks: length and line breaks stay."""

    def blank(m: re.Match) -> str:
        found = m[0]
        if m.lastindex or (not strings and found[0] != "/"):
            return found
        return _VISIBLE.sub(" ", found) if "\n" in found or "\r" in found else " " * len(found)

    return _HIDDEN.sub(blank, text)


def first_branch(text: str) -> str:
    """C text with only the first branch of each #if kept; all else, directives too, is blank, and offsets stay."""
    if "#" not in text:
        return text
    out, live, continued = [], [], False
    for line in text.splitlines(keepends=True):
        m = None if continued or "#" not in line else re.match(r"\s*#\s*(\w+)", line)
        word = m[1] if m else ""
        if word in ("if", "ifdef", "ifndef"):
            live.append(True)
        elif word in ("else", "elif", "elifdef", "elifndef") and live:
            live[-1] = False
        elif word == "endif" and live:
            live.pop()
        hide = bool(m) or continued or not all(live)
        continued = (bool(m) or continued) and line.rstrip("\r\n").endswith("\\")
        out.append(re.sub(r"[^\r\n]", " ", line) if hide else line)
    return "".join(out)


def non_comment_loc(text: str) -> int:
    """Lines with anything but comments; a block comment goes on over lines, and strings are not looked at."""
    bare = re.sub(r"/\*.*?(?:\*/|\Z)|//[^\n\r]*", lambda m: re.sub(r"[^\n\r]", "", m[0]), text, flags=re.S)
    return sum(1 for line in bare.splitlines() if line.strip())


def thin_forwarder(body: str) -> bool:
    """Whether a body only hands on: one call, returned or not."""
    flat = " ".join(mask(body).split())
    return bool(re.fullmatch(r"\{\s*(?:return\s+)?[A-Za-z_$][\w$.]*\s*\([^;{}]*\)\s*;\s*\}", flat))


@dataclass(slots=True)
class Token:
    text: str
    at: int
    line: int


_PAIR = {"(": ")", "[": "]", "{": "}"}


class Tokens(list):
    """Tokens, and for brackets that nest as they should the place of each one's partner."""

    pairs: dict[int, int] | None = None


def tokenize(masked: str) -> Tokens:
    """Tokens of masked text with their places and lines; none goes over a line's end."""
    out, at = Tokens(), 0
    for number, line in enumerate(masked.split("\n"), 1):
        if line and not line.isspace():
            out += [Token(m[0], at + m.start(), number) for m in _TOKEN.finditer(line)]
        at += len(line) + 1
    pairs, open_ = {}, []
    for i, t in enumerate(out):
        t = t.text
        if t in _PAIR:
            open_.append(i)
        elif t in _CLOSERS:
            if not open_ or _PAIR[out[open_[-1]].text] != t:
                return out
            pairs[open_.pop()] = i
    if not open_:
        out.pairs = pairs
    return out


_CLOSERS = frozenset(")]}")


def _closing(tokens: list[Token], i: int) -> int:
    """The place of the bracket that closes the one at i, or the end."""
    pairs = getattr(tokens, "pairs", None)
    if pairs is not None:
        return pairs[i]
    stack = [_PAIR[tokens[i].text]]
    for j in range(i + 1, len(tokens)):
        t = tokens[j].text
        if t in _PAIR:
            stack.append(_PAIR[t])
        elif t == stack[-1]:
            stack.pop()
            if not stack:
                return j
        elif t in ")]}" and t in stack:
            while stack and stack.pop() != t:
                pass
            if not stack:
                return j
    return len(tokens)


@dataclass
class Callable_:
    name: str
    owner: str
    begin: int
    line: int
    body: tuple[int, int]
    end_line: int
    signature: str
    params: list[str]
    body_text: str
    code: str  # the body with only the first branch of each #if, and no directives
    modifiers: set[str] = field(default_factory=set)
    annotations: list[str] = field(default_factory=list)
    tokens: list[Token] = field(default_factory=list)  # of the body; Java only, where the whole text's are the body's


@dataclass
class Type_:
    kind: str
    name: str
    line: int
    end_line: int
    at: int
    end: int
    supers: list[str]
    interfaces: list[str]


def _params(tokens: list[Token], masked: str, lo: int, hi: int) -> list[str]:
    """Parameters between the brackets at lo and hi, parted by commas outside all brackets."""
    out, depth, start = [], 0, lo + 1
    for j in range(lo + 1, hi + 1):
        t = tokens[j].text if j < len(tokens) else ")"
        if j == hi or (t == "," and depth == 0):
            if j > start:
                end = tokens[j].at if j < len(tokens) else len(masked)
                out.append(" ".join(masked[tokens[start].at : end].split()))
            start = j + 1
        elif t in "([{<":
            depth += 1
        elif t in ")]}>":
            depth = max(0, depth - 1)
    return [p for p in out if p and p != "void"]


def scan(text: str, language: str) -> tuple[list[Callable_], list[Type_]]:
    """Functions with bodies and types of a source, by a walk over its braces.

    What a brace opens follows from the tokens since the last ; or brace: a type, a function (a name and its parameter
    list, outside of functions), or a block. Types within functions (anonymous ones too) hold functions of their own.
    """
    masked, code = mask(text), text
    if language in ("c", "cpp"):
        masked, code = first_branch(masked), first_branch(text)
    tokens = tokenize(masked)
    functions, types, enums = [], [], []
    # (kind, name, last token)
    scopes: list[tuple[str, str, int]] = []
    start = i = 0
    depth = 0
    while i < len(tokens):
        t = tokens[i].text
        while scopes and i > scopes[-1][2]:
            scopes.pop()
        if t in "([":
            depth += 1
        elif t in ")]":
            depth = max(0, depth - 1)
        if t == "@" and i + 1 < len(tokens) and tokens[i + 1].text == "interface":
            i += 1
            continue
        if t == ";" and depth == 0:
            start = i + 1
        elif t == "}":
            start, depth = i + 1, 0
        elif t == ":" and i and tokens[i - 1].text in ("public", "private", "protected") and language == "cpp":
            start = i + 1
        elif t == "{":
            head = tokens[start:i]
            words = _behind_template([h.text for h in head]) if language == "cpp" else [h.text for h in head]
            end = _closing(tokens, i)
            if language == "cpp" and ")" in words and ":" in words[words.index(")") :] and re.match(r"[A-Za-z_]", words[-1]) and words[-1] not in ("const", "override", "final", "noexcept", "try"):
                i = end + 1  # a value in a constructor's list of initial ones
                continue
            inside = scopes[-1][0] if scopes else "top"
            if inside == "type" and enums and scopes[-1][2] == enums[-1][0] and i < enums[-1][1]:
                kind, name = "type", ""  # the body of an enum's constant
            elif inside == "type" and language == "java" and words and words[-1] == scopes[-1][1] and set(words[:-1]) <= MODIFIERS:
                kind, name = "compact", words[-1]  # a record's constructor without a list of parameters
            else:
                kind, name = _opens(words, inside, language)
            last = tokens[end] if end < len(tokens) else tokens[-1]
            if kind == "type":
                path = [s[1] for s in scopes if s[0] == "type" and s[1]]
                types.append(_type(words, ".".join([*path, name]), head, last, end))
                if "enum" in words and language == "java":
                    enums.append((end, _constants_end(tokens, i, end)))
            elif kind == "compact":
                path = [s[1] for s in scopes if s[0] == "type" and s[1]]
                functions.append(Callable_(name, ".".join(path), tokens[start].at, tokens[start].line, (tokens[i].at, last.at + 1), last.line, " ".join(words), [], text[tokens[i].at : last.at + 1], text[tokens[i].at : last.at + 1], set(words) & MODIFIERS, [], _part(tokens, i, end)))
                kind = "function"
            elif kind == "function":
                open_ = next(j for j in range(start, i) if tokens[j].text == "(" and j > start and _is_name(tokens, j - 1, start, name))
                if name.endswith("operator()"):
                    open_ = next(j for j in range(open_ + 1, i) if tokens[j].text == "(")
                close = _closing(tokens, open_)
                path = [s[1] for s in scopes if s[0] == "type" and s[1]]
                bare = name.split("::") if "operator" not in name else [*name.split("operator")[0].rstrip(":").split("::"), "operator" + name.split("operator", 1)[1]]
                bare = [x for x in bare if x]
                functions.append(Callable_(bare[-1], ".".join([*path, *bare[:-1]]), tokens[start].at, tokens[start].line, (tokens[i].at, last.at + 1), last.line, " ".join(text[tokens[start].at : tokens[i].at].split()), _params(tokens, masked, open_, close), text[tokens[i].at : last.at + 1], code[tokens[i].at : last.at + 1], set(words) & (MODIFIERS | {"synchronized"}), [words[k + 1] for k, w in enumerate(words[:-1]) if w == "@"], _part(tokens, i, end) if language == "java" else []))
            scopes.append((kind, name, end))
            start, depth = i + 1, 0
        i += 1
    return functions, types


def _part(tokens: Tokens, lo: int, hi: int) -> Tokens:
    """The tokens from a bracket to its partner, lines as they are in the whole text; none if it is never closed, since the text between then ends within a token."""
    if hi >= len(tokens):
        return Tokens()
    out = Tokens(tokens[lo : hi + 1])
    if tokens.pairs is not None:
        out.pairs = {k - lo: tokens.pairs[k] - lo for k in range(lo, hi + 1) if k in tokens.pairs}
    return out


def _behind_template(words: list[str]) -> list[str]:
    """The words behind `template <...>`, once or more."""
    while words[:2] == ["template", "<"]:
        depth, k = 0, 1
        while k < len(words):
            depth += (words[k] == "<") - (words[k] == ">")
            k += 1
            if depth == 0:
                break
        words = words[k:]
    return words


def _constants_end(tokens: list[Token], i: int, end: int) -> int:
    """The place of the semicolon behind the constants of an enum that opens at i, or its end."""
    k = i + 1
    while k < min(end, len(tokens)) and tokens[k].text != ";":
        k = _closing(tokens, k) + 1 if tokens[k].text in _PAIR else k + 1
    return k


def _is_name(tokens: list[Token], at: int, start: int, name: str) -> bool:
    return at >= start and (tokens[at].text == name.split("::")[-1].lstrip("~") or "operator" in name)


def _opens(words: list[str], inside: str, language: str) -> tuple[str, str]:
    """What a brace behind these tokens opens: (type | namespace | function | block, name)."""
    depth, flat = 0, []
    for w in words:
        if w in ("(", "["):
            flat.append((w, depth))
            depth += 1
        elif w in (")", "]"):
            depth = max(0, depth - 1)
            flat.append((w, depth))
        else:
            flat.append((w, depth))
    top = [w for w, d in flat if d == 0]
    if "new" in top and (inside in ("function", "block") or "=" in top):
        return "type", ""
    for k, w in enumerate(top):
        if w in TYPE_WORDS and (w != "record" or language == "java") and "=" not in top[:k]:
            after = [x for x in top[k + 1 :] if re.match(r"[A-Za-z_$]", x) and x not in TYPE_WORDS and x not in ("final", "alignas")]
            if w == "namespace":
                return "type" if after else "block", after[0] if after else ""
            if "(" in top[k + 1 :] and w != "record" and language != "java":
                break  # a function that returns a struct
            return "type", after[0] if after else ""
    if inside in ("function", "block"):
        return "block", ""
    k = next((j for j, (w, d) in enumerate(flat) if w == "(" and d == 0 and j and (re.match(r"[A-Za-z_$]", flat[j - 1][0]) or "operator" in words[:j])), None)
    if k is None or "=" in [w for w, d in flat[:k] if d == 0] and "operator" not in words[:k]:
        return "block", ""
    if "operator" in words[:k]:
        at = words.index("operator")
        if words[at + 1 : k] == [] and words[k : k + 3] == ["(", ")", "("]:
            k += 2  # operator()
        owner = []
        while at >= 2 and words[at - 1] == "::":
            owner, at = [words[at - 2], *owner], at - 2
        return "function", "".join(f"{x}::" for x in owner) + "operator" + "".join(words[words.index("operator") + 1 : k])
    # annotations with arguments come before the name
    while k is not None and k >= 2 and words[k - 2] == "@":
        k = next((j for j in range(k + 1, len(flat)) if flat[j][0] == "(" and flat[j][1] == 0 and re.match(r"[A-Za-z_$]", flat[j - 1][0])), None)
    if k is None or words[k - 1] in CONTROL_WORDS:
        return "block", ""
    name, j = words[k - 1], k - 2
    if j >= 0 and words[j] == "~":
        name, j = "~" + name, j - 1
    while j >= 1 and words[j] == "::":
        j -= 1
        if words[j] == ">":  # the owner's template arguments
            depth = 0
            while j > 0:
                depth += (words[j] == ">") - (words[j] == "<")
                j -= 1
                if depth == 0:
                    break
        name, j = f"{words[j]}::{name}", j - 1
    return "function", name


def _type(words: list[str], name: str, head: list[Token], last: Token, end: int) -> Type_:
    kind = next((w for w in words if w in TYPE_WORDS), "anonymous")
    plain = re.sub(r"<[^<>]*>", "", re.sub(r"<[^<>]*>", "", " ".join(words)))
    listed = lambda text: [x.replace(" ", "") for x in text.split(",") if x.strip()]
    ext = re.search(r"\bextends (.+?)(?: implements | permits |$)", plain)
    imp = re.search(r"\bimplements (.+?)(?: permits |$)", plain)
    base = re.search(r"[^:]:(?!:) ?(.+)$", plain) if not ext and not imp else None
    bases = listed(re.sub(r"\b(?:public|private|protected|virtual)\b", "", base[1])) if base and kind != "enum" else []
    supers = listed(ext[1]) if ext else bases
    faces = listed(imp[1]) if imp else []
    if kind == "interface":
        supers, faces = [], supers
    return Type_(kind, name, head[0].line if head else last.line, last.line, head[0].at if head else last.at, last.at + 1, supers, faces)


@dataclass
class Node:
    """A statement: kind, line, the tokens of its head or expression, and the statements within."""

    kind: str
    line: int
    head: list[str] = field(default_factory=list)
    children: list[Node] = field(default_factory=list)
    other: list[Node] = field(default_factory=list)


class _Parser:
    def __init__(self, tokens: list[Token]):
        self.t, self.i = tokens, 0
        self.w = [*(x.text for x in tokens), "", "", ""]  # no more than two are looked ahead
        self.n = len(tokens)

    def word(self, k: int = 0) -> str:
        return self.w[self.i + k] if self.i < self.n else ""

    def line(self) -> int:
        return self.t[min(self.i, len(self.t) - 1)].line if self.t else 0

    def brackets(self) -> list[str]:
        """The tokens within the round brackets that come next."""
        if self.word() != "(":
            return []
        end = _closing(self.t, self.i)
        out = self.w[self.i + 1 : min(end, self.n)]
        self.i = end + 1
        return out

    def block(self) -> list[Node]:
        out = []
        if self.word() == "{":
            self.i += 1
        while self.i < len(self.t) and self.word() != "}":
            before = self.i
            out.append(self.statement())
            if self.i == before:
                self.i += 1
        self.i += 1
        return out

    def statement(self) -> Node:
        w, line = self.word(), self.line()
        if w == "{":
            return Node("block", line, [], self.block())
        if w == "if":
            self.i += 1
            if self.word() == "constexpr":
                self.i += 1
            node = Node("if", line, self.brackets())
            node.children = [self.statement()]
            if self.word() == "else":
                self.i += 1
                node.other = [self.statement()]
            return node
        if w in ("for", "while", "switch", "synchronized") and self.word(1) == "(":
            self.i += 1
            head = self.brackets()
            kind = "foreach" if w == "for" and ":" in head and ";" not in head else w
            node = Node(kind, line, head)
            if w == "while" and self.word() == ";":
                self.i += 1
            else:
                node.children = [self.statement()]
            return node
        if w == "do":
            self.i += 1
            node = Node("do", line, [], [self.statement()])
            if self.word() == "while":
                self.i += 1
                node.head = self.brackets()
            if self.word() == ";":
                self.i += 1
            return node
        if w == "try":
            self.i += 1
            node = Node("try", line, self.brackets())
            node.children = [self.statement()]
            while self.word() in ("catch", "finally"):
                part = Node(self.word(), self.line())
                self.i += 1
                part.head = self.brackets()
                part.children = [self.statement()]
                node.other.append(part)
            return node
        if w in ("case", "default"):
            node, arrow = Node("case", line), False
            self.i += 1
            while self.i < len(self.t) and self.word() not in (":", "->", ";", "}"):
                node.head.append(self.word())
                self.i += 1
            arrow = self.word() == "->"
            self.i += 1 if self.word() != "}" else 0
            if arrow:
                node.children = [self.statement()]
                node.kind = "rule"
            return node
        if re.match(r"[A-Za-z_$]", w or " ") and self.word(1) == ":" and self.word(2) != ":" and w not in CONTROL_WORDS:
            self.i += 2
            return Node("label", line, [w], [self.statement()])
        return self.expression(line)

    def expression(self, line: int) -> Node:
        node, depth = Node("expression", line), 0
        first = self.word()
        if first in ("return", "break", "continue", "throw", "goto", "yield", "assert"):
            node.kind = first
        words, n = self.w, self.n
        while self.i < n:
            w = words[self.i]
            if w == "}" and depth == 0:
                return node
            if w == "{":
                # a lambda's or an anonymous type's body, else values
                prev = node.head[-1] if node.head else ""
                if prev == "->" or (prev in (")", "mutable") and "new" not in node.head) or (prev == "]" and "[" in node.head):
                    node.children.append(Node("lambda", self.line(), [], self.block()))
                elif "new" in node.head and prev == ")" or any(x in TYPE_WORDS for x in node.head):
                    end = _closing(self.t, self.i)
                    node.children.append(Node("type", self.line(), [x.text for x in self.t[self.i : end + 1]]))
                    self.i = end + 1
                    if any(x in TYPE_WORDS for x in node.head):
                        node.kind = "declaration"
                        if self.word() == ";":
                            self.i += 1
                        return node
                else:
                    self.i = _closing(self.t, self.i) + 1
                continue
            if w in "([":
                depth += 1
            elif w in ")]":
                depth = max(0, depth - 1)
            self.i += 1
            if w == ";" and depth == 0:
                return node
            node.head.append(w)
        return node


def parse_body(body: str, tokens: list[Token] | None = None) -> list[Node]:
    """The statements of a body (with or without its braces); tokens: its own, if they are known."""
    tokens = tokens or tokenize(mask(body))
    if not tokens or tokens[0].text != "{":
        tokens = [Token("{", 0, 1), *tokens, Token("}", len(body), 1)]
    return _Parser(tokens).block()


LOOPS = ("for", "foreach", "while", "do")


def nesting(nodes: list[Node], language: str, depth: int = 0) -> int:
    """The deepest control statement; an if behind an else lies within its if, lambdas and types count for themselves."""
    control = {"if", *LOOPS, "switch"} | ({"catch"} if language == "cpp" else set())
    deepest = depth
    for n in nodes:
        inner = depth + (n.kind in control)
        deepest = max(deepest, inner)
        if n.kind not in ("lambda", "type"):
            deepest = max(deepest, nesting(n.children, language, inner), nesting(n.other, language, inner))
    return deepest


def complexity(nodes: list[Node], language: str, depth: int = 0, chained: bool = False) -> int:
    """Sum of 1 + depth over control statements; else-if stays on its if's level."""
    control = {"if", *LOOPS, "switch", "case", "rule"} | ({"catch"} if language == "cpp" else set())
    total = 0
    for n in nodes:
        if n.kind in control:
            level = depth - 1 if chained and n.kind == "if" else depth
            total += 1 + level
            inner = level + 1
        else:
            inner = depth
        total += complexity(n.children, language, inner)
        total += complexity(n.other, language, inner, chained=n.kind == "if")
    return total


def _bool_runs(words: list[str], now: str) -> tuple[int, str]:
    """Changes of the boolean operator along an expression; a negation begins anew."""
    n = 0
    for k, w in enumerate(words):
        if w in ("&&", "||"):
            if w != now:
                n, now = n + 1, w
        elif w == "!" and k + 1 < len(words):
            now = ""
    return n, now


def cognitive(nodes: list[Node], name: str = "", depth: int = 0) -> int:
    """Java's cognitive complexity: 1 + nesting for each structure, 1 for each else, each run of one boolean operator, recursion and jump to a label."""

    def words(head: list[str]) -> int:
        n, _ = _bool_runs(head, "")
        calls = sum(1 for a, b in zip(head, head[1:]) if name and a == name and b == "(")
        ternary = sum(1 for k, w in enumerate(head) if w == "?" and (k + 1 >= len(head) or head[k + 1] not in (">", ",", "extends", "super")))
        return n + calls + sum(1 + depth + k for k in range(ternary))

    total = 0
    for n in nodes:
        total += words(n.head)
        if n.kind == "if":
            total += _cognitive_if(n, name, depth)
        elif n.kind in (*LOOPS, "switch", "catch"):
            total += 1 + depth + cognitive(n.children, name, depth + 1)
        elif n.kind == "lambda":
            total += cognitive(n.children, name, depth + 1)
        elif n.kind == "type":
            for f, _ in [(f, None) for f in scan("class X " + " ".join(n.head), "java")[0]]:
                total += cognitive(parse_body(f.body_text), name, depth + 1)
        else:
            total += cognitive(n.children, name, depth) + cognitive(n.other, name, depth)
            if n.kind in ("break", "continue") and len(n.head) > 1:
                total += 1
    return total


def _cognitive_if(n: Node, name: str, depth: int, chained: bool = False) -> int:
    """An if without its condition; an else is 1, and nests what it holds, the structure of an else-if apart."""
    total = 0 if chained else 1 + depth
    total += cognitive(n.children, name, depth + (not chained))
    if n.other:
        total += 1
        o = n.other[0]
        if o.kind == "if":
            total += _bool_runs(o.head, "")[0] + _cognitive_if(o, name, depth + 1, chained=True)
        else:
            total += cognitive(n.other, name, depth + 1)
    return total


def ncss(nodes: list[Node]) -> int:
    """Statements that don't hold others only: declarations, expressions, structures, 1 more for each else, labels of switches."""
    total = 0
    for n in nodes:
        if n.kind not in ("block", "rule", "type", "lambda", "label") and not (n.kind == "expression" and not n.head):
            total += 1
        if n.kind in ("label", "rule"):
            total += 1
        if n.kind == "if" and n.other:
            total += 1
        total += ncss(n.children) + ncss(n.other)
    return total


def switch_metrics(text: str) -> tuple[int, int, float]:
    """Switches, cases and cases per switch of masked text."""
    bare = mask(text)
    switches, cases = len(re.findall(r"\bswitch\b", bare)), len(re.findall(r"\bcase\b", bare))
    return switches, cases, cases / switches if switches else 0.0


def control_nodes(nodes: list[Node]) -> int:
    """Control statements, those of lambdas and types apart."""
    return sum((n.kind in ("if", *LOOPS, "switch", "catch")) + (control_nodes(n.children) + control_nodes(n.other) if n.kind not in ("lambda", "type") else 0) for n in nodes)


def accesses(body: str, first_line: int = 1, tokens: list[Token] | None = None) -> Iterator[tuple[str, str, int, bool, bool]]:
    """(receiver, member, line, written, called) of each member access; the receiver is the chain's root, none for a call's result.

    tokens: the body's own, if they are known, with the lines of the whole text.
    """
    known, tokens = tokens, tokens or tokenize(mask(body))
    first_line = first_line - known[0].line + 1 if known else first_line
    for i, t in enumerate(tokens):
        if t.text not in (".", "->") or i == 0 or i + 1 >= len(tokens) or not re.match(r"[A-Za-z_$]", tokens[i + 1].text):
            continue
        j = i - 1
        while j >= 0:
            if tokens[j].text in "])":
                back, k = 1, j - 1
                while k >= 0 and back:
                    back += (tokens[k].text in "])") - (tokens[k].text in "([")
                    k -= 1
                if tokens[j].text == ")":
                    j = -1 if k < 0 or not re.match(r"[A-Za-z_$]", tokens[k].text) else k
                else:
                    j = k
                if j >= 0 and tokens[j].text not in ("]", ")") and j >= 1 and tokens[j - 1].text in (".", "->"):
                    j -= 2
                    continue
            if j >= 1 and tokens[j - 1].text in (".", "->") and re.match(r"[A-Za-z_$]", tokens[j].text):
                j -= 2
                continue
            break
        if j < 0 or not re.match(r"[A-Za-z_$]", tokens[j].text) or (j + 1 < len(tokens) and tokens[j + 1].text == "("):
            continue
        after = tokens[i + 2].text if i + 2 < len(tokens) else ""
        yield tokens[j].text, tokens[i + 1].text, first_line + tokens[i + 1].line - 1, after in ("=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", "++", "--"), after == "("


_DECLARED = re.compile(r"^(?:(?:const|static|final|unsigned|signed|struct|volatile|register|auto)\s+)*[A-Za-z_$][\w$.:]*(?:\s*<[^;=]*>)?(?:\s*\[\s*\])*[\s*&]+(?:const\s+)?([A-Za-z_$][\w$]*)\s*(?:\[[^\]]*\]\s*)*(?:=(?!=)|;|,|$|:(?!:))")
_NOT_DECLARED = frozenset("return throw else goto new delete case default package import using typedef break continue do".split())


def local_names(body: str, first_line: int = 1) -> Iterator[tuple[str, int]]:
    """(name, line) of each variable declared in a body, loop and catch heads included."""
    masked = mask(body)
    for m in re.finditer(r"[;{}()]\s*([^;{}()]+)", masked):
        text = re.sub(r"^(?:case\b[^:]*|[A-Za-z_$][\w$]*)\s*:(?!:)\s*", "", " ".join(m[1].split()))
        end = masked[m.end() : m.end() + 1]
        if text.split(" ", 1)[0] in _NOT_DECLARED or (end == "(" and "=" not in text):
            continue
        d = _DECLARED.match(text + ("" if "=" in text else ";"))
        if d and d[1] not in CONTROL_WORDS and not (masked[m.start()] == "(" and "=" not in text and " : " not in f" {text} " and end != ")"):
            if masked[m.start()] == "(" and "=" not in text and ":" not in text and not re.search(r"\bcatch\s*$", masked[: m.start()]):
                continue
            yield d[1], first_line + masked.count("\n", 0, m.start(1) + len(m[1]) - len(m[1].lstrip()))


def field_names(text: str, language: str) -> list[str]:
    """Distinct fields declared directly in a type's body."""
    masked = mask(text)
    tokens = tokenize(first_branch(masked) if language in ("c", "cpp") else masked)
    out, start, i = [], 1, 1
    while i < len(tokens):
        w = tokens[i].text
        if w == "{":
            end = _closing(tokens, i)
            words = [t.text for t in tokens[start:i]]
            i = end
            if "=" not in words:
                start = i + 1
        elif w == ";":
            words = [t.text for t in tokens[start:i]]
            words = words[: words.index("=")] if "=" in words else words
            if len(words) >= 2 and "(" not in words and words[0] not in ("using", "typedef", "friend", "return"):
                names = [words[k] for k in range(1, len(words)) if re.match(r"[A-Za-z_$]", words[k]) and (k + 1 == len(words) or words[k + 1] in (",", "["))]
                out += [n for n in names if n not in MODIFIERS]
            start = i + 1
        elif w == ":" and tokens[i - 1].text in ("public", "private", "protected"):
            start = i + 1
        i += 1
    return list(dict.fromkeys(out))


# Marks of tests, assertions, disabled tests and skips.
_TEST = re.compile(r"@\s*(?:[A-Za-z_$][\w$]*\s*\.\s*)*(?:Test|ParameterizedTest|RepeatedTest|TestFactory|TestTemplate)\b")
_JUNIT3 = re.compile(r"\b(?:public\s+)?(?:final\s+)?void\s+test[A-Za-z0-9_$]*\s*\(")
_ASSERT_CALL = re.compile(r"(?<![\w$])(?:assert[A-Z][A-Za-z0-9_$]*|assertThat|fail|expectThrows|verify|verifyNoInteractions|verifyNoMoreInteractions)\s*\(")
_ASSERT = re.compile(r"\bassert\s+(?![A-Za-z_$][\w$]*\s*\()[^;]+;")
_DISABLED = re.compile(r"@\s*(?:[A-Za-z_$][\w$]*\s*\.\s*)*(?:Disabled|Ignore|IgnoreRest|PendingFeature|Quarantined)\b")
_SKIP = re.compile(r"(?<![\w$])(?:assumeTrue|assumeFalse|assumeThat|assumeNoException|assumingThat|assume)\s*\(|\b(?:throw\s+new\s+)?SkipException\s*\(")


def test_strength(source: str) -> tuple[int, int, int, int]:
    """Test methods, assertions, disabling marks and skips, comments and literals apart."""
    code = mask(source)
    count = lambda *patterns: sum(len(p.findall(code)) for p in patterns)
    return count(_TEST, _JUNIT3), count(_ASSERT_CALL, _ASSERT), count(_DISABLED), count(_SKIP)
