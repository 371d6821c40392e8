"""Tokens, brackets, names and declarations of TypeScript and JavaScript, each found in one pass over a file.

No grammar is followed. Comments, strings, templates (which nest), regular
expressions and JSX are told apart, brackets are matched, and what is read from
the tokens are imports, declarations with their ends, the scopes that a
``require`` may be bound in, and brackets, strings, templates and comments that
don't end. Other syntax errors aren't found. Every text is read without an
exception, in time about linear in its length.
"""

from __future__ import annotations

import re
from bisect import bisect_right

# Words of the language.
OPERATORS = frozenset("return typeof case in of delete void throw new do else instanceof yield await extends default".split())
CONTROL = frozenset("if for while switch catch with".split())
MODIFIERS = frozenset("export default declare abstract async public private protected static readonly override accessor".split())
STATEMENTS = frozenset("const let var function class import export if for while do switch return throw try break continue interface type enum declare abstract namespace module".split())

#: Words that no type and no head of a declaration holds.
DECLARING = ("function", "class", "interface", "enum", "const", "let", "var", "return", "if", "for", "while", "import", "export")

SKIP = re.compile(r"(?:\s+|//[^\n]*|/\*.*?\*/)+", re.S)
TOKEN = re.compile(r"(?P<i>[A-Za-z_$#@\u0080-\U0010ffff][\w$]*)|(?P<n>\d[\w.]*|\.\d[\w.]*)|(?P<s>\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')|(?P<p>=>|\?\.|\.\.\.|.)", re.S)
REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/\w*")
TEMPLATE = re.compile(r"(?:\\.|\$(?!\{)|[^`\\$])*", re.S)
TAG = re.compile(r"<(?:[A-Za-z_$][\w$.:-]*)?(?=[\s/>])")
CLOSES = {"{": "}", "(": ")", "[": "]", "${": "}"}
ESCAPE = re.compile(r"\\(?:u\{([0-9a-fA-F]{1,6})\}|u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|\r?\n|(.))", re.S)
SPECIAL = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0"}


def cooked(raw: str) -> str:
    """What a literal's text means."""

    def one(m: re.Match) -> str:
        digits = m[1] or m[2] or m[3]
        if digits:
            return chr(min(int(digits, 16), 0x10FFFF))
        return SPECIAL.get(m[4], m[4]) if m[4] else ""

    return ESCAPE.sub(one, raw) if "\\" in raw else raw


class Script:
    """kind, word, at, stop: tokens (i: names, s: literals, n: numbers, p: marks, x: other values); match: the bracket that closes or opens; errors: (message, position)."""

    def __init__(self, text: str, jsx: bool = False):
        self.text = text
        self.kind: list[str] = []
        self.word: list[str] = []
        self.at: list[int] = []
        self.stop: list[int] = []
        self.match: dict[int, int] = {}
        self.errors: list[tuple[str, int]] = []
        self.ends: dict[int, int] = {}
        self.types: dict[tuple[int, bool], int] = {}
        self.lines = [0, *(m.end() for m in re.finditer("\n", text))]
        self._read(jsx)
        self._enclosing()

    def place(self, position: int) -> tuple[int, int]:
        """Line and column from 1; columns count UTF-16 units."""
        line = bisect_right(self.lines, position)
        return line, len(self.text[self.lines[line - 1] : position].encode("utf-16-le", "surrogatepass")) // 2 + 1

    def put(self, kind: str, word: str, at: int, stop: int) -> int:
        self.kind.append(kind)
        self.word.append(word)
        self.at.append(at)
        self.stop.append(stop)
        return stop

    def operand(self, i: int) -> bool:
        """Whether token i ends a value, so that a slash after it divides."""
        return i >= 0 and (self.kind[i] in "nsx" or self.word[i] in (")", "]", "}") or (self.kind[i] == "i" and self.word[i] not in OPERATORS))

    def _read(self, jsx: bool) -> None:
        text, n, pos = self.text, len(self.text), 0
        stack: list[list] = []  # what is open, its token, whether a template has had substitutions
        while pos < n:
            mode = stack[-1][0] if stack else ""
            if mode == "`":
                pos = TEMPLATE.match(text, pos).end()
                if pos >= n or text[pos] == "\\":
                    self.errors.append(("Unterminated template literal.", n))
                    return
                top = stack[-1]
                if text[pos] == "`":
                    stack.pop()
                    pos = self.put("x" if top[2] else "s", "" if top[2] else text[top[1] + 1 : pos], top[1], pos + 1)
                else:
                    top[2] = True
                    stack.append(["${", len(self.kind), False])
                    pos = self.put("p", "${", pos, pos + 2)
                continue
            if mode == "jsx":
                end = min((x for x in (text.find("<", pos), text.find("{", pos)) if x >= 0), default=n)
                pos = end
                if pos >= n:
                    break
                if text[pos] == "{":
                    stack.append(["{", len(self.kind), False])
                    pos = self.put("p", "{", pos, pos + 1)
                elif text.startswith("</", pos):
                    stack.pop()
                    end = text.find(">", pos)
                    pos = self.put("x", "", pos, end + 1 if end >= 0 else n)
                else:
                    stack.append(["tag", len(self.kind), False])
                    pos += 1
                continue
            if m := SKIP.match(text, pos):
                pos = m.end()
                continue
            c = text[pos]
            if mode == "tag" and (c == ">" or text.startswith("/>", pos)):
                if c == ">":
                    stack[-1][0] = "jsx"
                    pos += 1
                else:
                    stack.pop()
                    pos = self.put("x", "", pos, pos + 2)
                continue
            if mode == "tag" and c in "\"'":
                end = text.find(c, pos + 1)
                pos = n if end < 0 else end + 1
                continue
            if text.startswith("/*", pos):
                self.errors.append(("'*/' expected.", n))
                return
            if c == "/" and mode != "tag" and not self.operand(len(self.kind) - 1) and (m := REGEX.match(text, pos)):
                pos = self.put("x", "", pos, m.end())
                continue
            if c == "`":
                stack.append(["`", pos, False])
                pos += 1
                continue
            if jsx and c == "<" and not self.operand(len(self.kind) - 1) and (m := TAG.match(text, pos)) and not re.match(r"\s+extends\b", text[m.end() : m.end() + 20]):
                stack.append(["tag", len(self.kind), False])
                pos = m.end()
                continue
            m = TOKEN.match(text, pos)
            kind, word = m.lastgroup, m[0]
            if word in ("{", "(", "["):
                stack.append([word, len(self.kind), False])
            elif word in ("}", ")", "]"):
                if not stack or stack[-1][0] not in CLOSES:
                    self.errors.append(("Declaration or statement expected.", pos))
                elif CLOSES[stack[-1][0]] != word:
                    self.errors.append((f"'{CLOSES[stack[-1][0]]}' expected.", pos))
                    while stack and CLOSES.get(stack[-1][0]) != word:
                        stack.pop()
                if stack and CLOSES.get(stack[-1][0]) == word:
                    begin = stack.pop()[1]
                    self.match[begin], self.match[len(self.kind)] = len(self.kind), begin
            elif kind == "p" and word in "\"'" and mode != "tag":
                end = text.find("\n", pos)
                self.errors.append(("Unterminated string literal.", n if end < 0 else end))
            if mode == "tag" and kind != "p":
                pos = m.end()
                continue
            pos = self.put(kind, word[1:-1] if kind == "s" else word, pos, m.end())
        for what in reversed(stack):
            if what[0] in CLOSES:
                self.errors.append((f"'{CLOSES[what[0]]}' expected.", n))
                break

    def _enclosing(self) -> None:
        """up: for each token the innermost bracket that is open there, or -1."""
        self.up, open_ = [], [-1]
        for i, w in enumerate(self.word):
            if self.kind[i] == "p" and w in ("}", ")", "]") and i in self.match and open_[-1] == self.match[i]:
                open_.pop()
            self.up.append(open_[-1])
            if self.kind[i] == "p" and w in CLOSES and i in self.match:
                open_.append(i)

    def is_word(self, i: int, *words: str) -> bool:
        return 0 <= i < len(self.kind) and self.kind[i] != "s" and self.word[i] in words

    def new_line(self, i: int) -> bool:
        return "\n" in self.text[self.stop[i - 1] : self.at[i]]

    def past(self, i: int) -> int:
        """The token after i, and after its bracket if it opens one."""
        return max(self.match.get(i, i), i) + 1

    def value_end(self, i: int) -> int:
        """The token after the expression that begins at i: at a comma, a semicolon, a closing bracket, or a line that begins a statement."""
        n, last, seen = len(self.kind), i - 1, []
        while i < n and i not in self.ends and not self.is_word(i, ",", ";", ")", "]", "}"):
            if last >= 0 and self.operand(last) and self.kind[i] == "i" and self.new_line(i) and (self.word[i] in STATEMENTS or self.word[last] != "=>"):
                break
            seen.append(i)
            last = self.past(i) - 1
            i = last + 1
        i = self.ends.get(i, i)
        self.ends |= dict.fromkeys(seen, i)
        return i

    def after_type(self, i: int) -> int:
        """Past a colon and the type that follows a parameter list; i is the token after it."""
        if not self.is_word(i, ":"):
            return i
        i, fresh, seen = i + 1, True, []  # a brace can begin a type only where a type is due
        while i < len(self.kind) and (i, fresh) not in self.types and not self.is_word(i, ";", ",", ")", "]", "}", "="):
            seen.append((i, fresh))
            if self.is_word(i, "{") and not fresh:
                break
            if self.is_word(i, "=>") and not self.is_word(i - 1, ")"):
                break
            fresh = self.is_word(i, "|", "&", "<", "=>", ",", "is", "keyof", "typeof")
            if self.is_word(i, "=>") and self.is_word(i + 1, "{"):
                break
            i = self.past(i)
        i = self.types.get((i, fresh), i)
        self.types |= dict.fromkeys(seen, i)
        return i

    def after_generics(self, i: int) -> int:
        if not self.is_word(i, "<"):
            return i
        depth, j = 0, i
        while j < len(self.kind) and not self.is_word(j, ";", *DECLARING):
            depth += self.is_word(j, "<") - self.is_word(j, ">")
            j = self.past(j)
            if not depth:
                return j
        return i


def bindings(s: Script, a: int, b: int, names: set[str]) -> set[str]:
    """Which of names a pattern or parameter list between tokens a and b introduces."""
    out = set()
    for i in range(a, b):
        if s.kind[i] == "i" and s.word[i] in names and s.is_word(i - 1, "(", ",", "{", "[", "...", ":", "const", "let", "var", *MODIFIERS):
            inner = s.is_word(s.up[i], "{", "[")
            if s.is_word(i + 1, ",", ")", "}", "]", "=", "?", "of", "in", ";") or (not inner and s.is_word(i + 1, ":")) or i + 1 == b:
                if not s.is_word(i - 1, ":") or inner:
                    out.add(s.word[i])
    return out


class Outline:
    """Functions, scopes and declarations of a script.

    functions: body and parameter ranges; scopes: (first token, token after the last, is a function's); declared:
    (kind, name, first token, token after the last).
    """

    def __init__(self, s: Script):
        self.s = s
        self.scopes: list[tuple[int, int, bool]] = [(-1, len(s.kind), True)]
        self.params: dict[int, tuple[int, int]] = {}  # first token of a scope -> parameter list
        self.declared: list[tuple[str, str, int, int]] = []
        self.factories: set[str] = set()  # names given to createRequire(...)
        self.variables: list[tuple[int, int, str]] = []  # keyword, first token of the pattern, kind
        self.classes: set[int] = set()
        for i in range(len(s.kind)):
            self._token(i)

    def first(self, i: int) -> int:
        """Where a declaration begins, its modifiers included."""
        while self.s.is_word(i - 1, *MODIFIERS) and not self.s.is_word(i - 2, "."):
            i -= 1
        return i

    def function(self, paren: int, parameters_from: int, arrow: bool = False) -> int:
        """Add the scope of a function whose parameters begin at paren; returns the token after its end."""
        s = self.s
        close = s.past(paren)
        i = s.after_type(close)
        if arrow:
            if not s.is_word(i, "=>"):
                return -1
            i += 1
        if s.is_word(i, "{") and i in s.match:
            end = s.past(i)
        elif arrow:
            end = s.value_end(i)
        else:
            return i + 1 if s.is_word(i, ";") else i
        self.scopes.append((parameters_from, end, True))
        self.params[parameters_from] = (paren, close)
        return end

    def _token(self, i: int) -> None:
        s, w = self.s, self.s.word[i]
        if s.kind[i] not in "ip" or s.is_word(i - 1, ".", "?."):
            return
        if w == "function" and not s.is_word(i + 1, ":", ",", "}", "="):
            j = i + 1 + s.is_word(i + 1, "*")
            name = s.word[j] if s.kind[j : j + 1] == ["i"] else None
            paren = s.after_generics(j + 1 if name else j)
            if s.is_word(paren, "("):
                end = self.function(paren, i)
                first = self.first(i)
                if name and self.statement(first):
                    self.declared.append(("function", name, first, end))
        elif w == "class" and (s.kind[i + 1 : i + 2] == ["i"] or s.is_word(i + 1, "{")):
            j = i + 1
            while j < len(s.kind) and not s.is_word(j, "{", ";", *DECLARING):
                j = s.past(j)
            if s.is_word(j, "{"):
                self.classes.add(j)
                first = self.first(i)
                if not s.is_word(i + 1, "{", "extends", "implements") and self.statement(first):
                    self.declared.append(("class", s.word[i + 1], first, s.past(j)))
        elif w in ("interface", "enum", "type") and s.kind[i + 1 : i + 2] == ["i"] and not s.new_line(i + 1):
            first = self.first(i - 1 if s.is_word(i - 1, "const") else i)
            j = s.after_generics(i + 2)
            if w == "type" and s.is_word(j, "=") and self.statement(first):
                end = s.value_end(j + 1 + s.is_word(j + 1, "|", "&"))
                self.declared.append(("type", s.word[i + 1], first, end + s.is_word(end, ";")))
            elif w != "type" and self.statement(first):
                while j < len(s.kind) and not s.is_word(j, "{", ";", *DECLARING):
                    j = s.past(j)
                if s.is_word(j, "{"):
                    self.declared.append((w, s.word[i + 1], first, s.past(j)))
        elif w in ("const", "let", "var") and (s.kind[i + 1 : i + 2] == ["i"] or s.is_word(i + 1, "{", "[")) and not s.is_word(i + 1, "enum"):
            self.declarators(i, w)
        elif w == "(" and i in s.match:
            self.parenthesis(i)
        elif s.is_word(i + 1, "=>") and s.kind[i] == "i":
            end = s.past(i + 2) if s.is_word(i + 2, "{") else s.value_end(i + 2)
            self.scopes.append((i, end, True))
            self.params[i] = (i - 1, i + 1)
        elif w == "{" and i in s.match and i not in self.classes:
            self.scopes.append((i, s.past(i), False))

    def statement(self, first: int) -> bool:
        """Whether a declaration can stand before token first."""
        s = self.s
        return first <= 0 or s.is_word(first - 1, ";", "{", "}", ")", ":", "else") or s.kind[first - 1] == "i" and s.word[first - 1].startswith("@") or s.new_line(first) and s.operand(first - 1) or s.is_word(first, "export")

    def parenthesis(self, i: int) -> None:
        """Parameter lists of methods and arrow functions, and the heads of loops and catch."""
        s, before, close = self.s, i - 1, self.s.past(i)
        if s.is_word(before, "for", "catch") or (s.is_word(before, "await") and s.is_word(before - 1, "for")):
            end = s.past(close) if s.is_word(close, "{") else s.value_end(close)
            self.scopes.append((i, end, False))
            if s.is_word(before, "catch"):
                self.params[i] = (i, close)
            return
        if s.is_word(s.after_type(close), "=>"):
            self.function(i, i, arrow=True)
            return
        name = before
        if s.is_word(before, ">"):  # generics of a method
            while name >= 0 and not s.is_word(name, "<", ";", "{", "}", "(", ")"):
                name -= 1
            name -= 1
        if name < 0 or s.kind[name] not in "isn" and not s.is_word(name, "]") or s.is_word(name, *CONTROL, "function") or s.is_word(name - 1, "function", "new", ".", "?."):
            return
        first = s.match.get(name, name)
        star = s.is_word(first - 1, "*")
        begin = self.first(first - star)
        while begin > 0 and s.kind[begin - 1] == "i" and s.word[begin - 1].startswith("@"):
            begin -= 1
        in_class = s.up[begin] in self.classes
        body = s.after_type(close)
        accessor = s.is_word(begin - 1, "get", "set") and not s.new_line(begin)
        own = begin - 1 if accessor else begin
        at_edge = s.is_word(own - 1, "{", ",") or in_class and (s.is_word(own - 1, ";", "}") or s.new_line(own))
        if not at_edge or s.up[begin] < 0 or s.word[s.up[begin]] != "{":
            return
        if not (s.is_word(body, "{") or in_class and (s.is_word(body, ";", "}") or body < len(s.kind) and s.new_line(body))):
            return
        if in_class and s.up[i] != s.up[begin] or not in_class and s.is_word(own - 1, "}"):
            return
        end = self.function(i, begin)
        if accessor:
            return
        label = s.word[name] if s.kind[name] in "is" else s.text[s.at[first] : s.stop[name]]
        kind = "constructor" if in_class and s.kind[name] == "i" and label == "constructor" else "method"
        self.declared.append((kind, label, begin, end))

    def declarators(self, i: int, kind: str) -> None:
        s, j = self.s, i + 1
        while j < len(s.kind):
            name = j
            self.variables.append((i, j, kind))
            j = s.past(j)
            if s.is_word(j, "!"):
                j += 1
            if s.is_word(j, ":"):
                j += 1
                while j < len(s.kind) and not s.is_word(j, "=", ",", ";", ")", "}", *DECLARING):
                    j = s.after_generics(j) if s.is_word(j, "<") else s.past(j)
            if s.is_word(j, "="):
                value, j = j + 1, s.value_end(j + 1)
                k = value + s.is_word(value, "async")
                if s.kind[name] == "i":
                    head = s.after_generics(k)
                    arrow = s.is_word(head, "(") and s.is_word(s.after_type(s.past(head)), "=>") or s.is_word(head + 1, "=>")
                    if arrow or s.is_word(k, "function"):
                        self.declared.append(("function", s.word[name], name, j))
                    call = k + 2 if s.is_word(k + 1, ".") else k
                    if s.is_word(call, "createRequire") and s.is_word(call + 1, "("):
                        self.factories.add(s.word[name])
            if not s.is_word(j, ","):
                return
            j += 1


def declarations(s: Script, outline: Outline) -> list[tuple[str, str, str, int, int, int, int]]:
    """(kind, name, qualified name, start line and column, end line and column) in source order."""
    out, open_ = [], []
    for kind, name, a, b in sorted(set(outline.declared), key=lambda x: (x[2], -x[3])):
        while open_ and open_[-1][0] <= a:
            open_.pop()
        b = min(max(b, a + 1), len(s.kind))
        out.append((kind, name, ".".join((*(n for _, n in open_), name)), *s.place(s.at[a]), *s.place(s.stop[b - 1])))
        if kind in ("function", "class", "constructor", "method"):
            open_.append((b, name))
    return out


def imports(s: Script, outline: Outline) -> list[tuple[str, int]]:
    """(specifier, line) of imports, re-exports, import = require, import() and calls of the module loader, in source order."""
    found: list[int] = []
    calls: list[int] = []
    names = {"require"} | outline.factories
    for i in range(len(s.kind)):
        if s.kind[i] != "i" or s.is_word(i - 1, ".", "?."):
            continue
        w = s.word[i]
        if w == "import" and s.kind[i + 1 : i + 2] == ["s"]:
            found.append(i + 1)
        elif w == "import" and s.is_word(i + 1, "("):
            if s.kind[i + 2 : i + 3] == ["s"] and s.is_word(i + 3, ",", ")"):
                found.append(i + 2)
        elif w in ("import", "export"):
            j = i + 1
            while j < len(s.kind) and not s.is_word(j, "from", "=", ";", "(") and (s.kind[j] == "i" or s.is_word(j, "{", "*", ",")) and not s.is_word(j, "const", "function", "class", "default"):
                j = s.past(j)
            if s.is_word(j, "from") and s.kind[j + 1 : j + 2] == ["s"]:
                found.append(j + 1)
            elif w == "import" and s.is_word(j, "=") and s.is_word(j + 1, "require") and s.is_word(j + 2, "(") and s.kind[j + 3 : j + 4] == ["s"] and s.is_word(j + 4, ")"):
                found.append(j + 3)
        elif w in names and s.is_word(i + 1, "(") and s.kind[i + 2 : i + 3] == ["s"] and not s.is_word(i - 1, "function", "new"):
            close = i + 3 + s.is_word(i + 3, ",")
            if s.match.get(i + 1) == close and not (s.is_word(i - 1, "=") and s.is_word(i - 3, "import")):
                calls.append(i)
    if calls:
        bound = bound_names(s, outline, names)
        for i in calls:
            how = next((bound[scope][s.word[i]] for scope in reversed(around(outline, i)) if s.word[i] in bound.get(scope, ())), None)
            if how == "factory" or how is None and s.word[i] == "require":
                found.append(i + 2)
    return [(cooked(s.word[i]), s.place(s.at[i])[0]) for i in sorted(found)]


def around(outline: Outline, i: int) -> list[int]:
    """The scopes that hold token i, outermost first."""
    if not hasattr(outline, "ordered"):
        outline.ordered = sorted(range(len(outline.scopes)), key=lambda k: (outline.scopes[k][0], -outline.scopes[k][1]))
        outline.parent, open_ = {}, []
        for k in outline.ordered:
            while open_ and outline.scopes[open_[-1]][1] < outline.scopes[k][1] or open_ and outline.scopes[open_[-1]][1] <= outline.scopes[k][0]:
                open_.pop()
            outline.parent[k] = open_[-1] if open_ else None
            open_.append(k)
        outline.starts = [outline.scopes[k][0] for k in outline.ordered]
    k = outline.ordered[bisect_right(outline.starts, i) - 1]
    out = []
    while k is not None:
        if outline.scopes[k][0] <= i < outline.scopes[k][1]:
            out.append(k)
        k = outline.parent[k]
    return out[::-1]


def bound_names(s: Script, outline: Outline, names: set[str]) -> dict[int, dict[str, str]]:
    """For each scope those of names that are declared in it, and whether as a factory's result."""
    out: dict[int, dict[str, str]] = {}

    def bind(i: int, name: str, how: str, hoisted: bool = False) -> None:
        scopes = around(outline, i)
        scope = next((k for k in reversed(scopes) if outline.scopes[k][2]), scopes[0]) if hoisted else scopes[-1]
        out.setdefault(scope, {}).setdefault(name, how)

    by_start = {a: k for k, (a, _, function) in enumerate(outline.scopes) if a in outline.params}
    for start, (a, b) in outline.params.items():
        for name in bindings(s, a, b, names) | ({s.word[a + 1]} & names if b == a + 2 and s.kind[a + 1] == "i" else set()):
            out.setdefault(by_start[start], {})[name] = "other"
    for keyword, j, kind in outline.variables:
        for name in bindings(s, j, s.past(j), names) if s.is_word(j, "{", "[") else {s.word[j]} & names:
            v = j + 2 if s.is_word(j + 1, "=") else j
            call = v + 2 if s.is_word(v + 1, ".") else v
            factory = s.is_word(j + 1, "=") and s.is_word(call, "createRequire") and s.is_word(call + 1, "(")
            bind(keyword, name, "factory" if factory else "other", kind == "var")
    for i in range(len(s.kind)):
        if s.kind[i] == "i" and s.word[i] in names:
            if s.is_word(i - 1, "function") or s.is_word(i - 1, "*") and s.is_word(i - 2, "function"):
                at = i - 1 - s.is_word(i - 1, "*")
                declared = outline.statement(outline.first(at))
                if declared:
                    bind(max(at - 1, -1) if at else -1, s.word[i], "other")
                elif at in by_start:
                    out.setdefault(by_start[at], {}).setdefault(s.word[i], "other")
            elif s.is_word(i - 1, "class"):
                bind(i, s.word[i], "other")
            elif s.is_word(i - 1, "import", "as") and not s.is_word(i + 1, "(") or s.is_word(s.up[i], "{") and s.is_word(s.up[i] - 1, "import") or s.is_word(i - 1, "{", ",") and s.up[i] >= 0 and s.is_word(s.up[i] - 2, "import"):
                if not s.is_word(i + 1, "as"):
                    bind(i, s.word[i], "other")
    return out


def read(text: str, jsx: bool = False) -> tuple[list[tuple[str, int]], list[tuple], list[tuple[str, int, int]]]:
    """(imports, declarations, errors) of a script: errors are (message, line, column), and a script with any has no imports."""
    s = Script(text, jsx)
    outline = Outline(s)
    errors = [(m, *s.place(p)) for m, p in s.errors]
    return [] if errors else imports(s, outline), declarations(s, outline), errors
