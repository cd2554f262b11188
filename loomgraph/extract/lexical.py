"""Lexical extractors: definitions with their ranges, call sites, comments.

Python goes through its own parser, all other languages through a scanner that blanks comments and
strings, then matches definition heads and brackets. What is measured as an error is an unbalanced
bracket (or a Python syntax error), under this extractor's own name.
"""

from __future__ import annotations

import ast
import hashlib
import io
import re
import tokenize
import warnings
from bisect import bisect_right
from collections.abc import Iterator
from contextlib import suppress
from dataclasses import dataclass, field

NAME = "lexical/1"
LANGUAGES = ("typescript", "tsx", "javascript", "csharp", "python", "go", "java", "kotlin", "rust", "cpp", "ruby", "php", "dart")

_HASH_COMMENTS = ("ruby", "php")
_CLASS_WORDS = {
    "typescript": "class", "tsx": "class", "javascript": "class", "java": "class|interface|enum|record|@interface", "csharp": "class|struct|interface|record",
    "kotlin": "class|interface|object", "rust": "struct|enum|trait|impl", "cpp": "class|struct", "php": "class|interface|trait", "dart": "class|mixin|extension", "go": "",
}
_CONTROL = set("if for while switch catch return throw else do try new typeof instanceof await yield case in of when match loop foreach lock using fixed sizeof nameof assert super this synchronized function fn fun func def elif unless until except finally with lambda print_ isset empty unset array list echo include require default delete void operator".split())
_GO_TYPES = set("bool byte complex64 complex128 error float32 float64 int int8 int16 int32 int64 rune string uint uint8 uint16 uint32 uint64 uintptr any".split())
_OWN_CONTROL = {"php": {"use"}, "kotlin": {"constructor"}, "typescript": {"async"}, "tsx": {"async"}, "javascript": {"async"}, "dart": {"async"}}
_NO_BARE_ARGS = ("java",)
_ANY_ARGUMENT = r"\s*(?:::|&)?\$?([A-Za-z_][\w$]*)\s*"
_ARGUMENT = {
    "kotlin": r"\s*(?:(?:\w+\s*)?::\s*)?([A-Za-z_]\w*)\s*",
    "php": r"\s*(?:\$|(?:\\?\w+\\)*(?=\w+\s*\(\s*\.\.\.))([A-Za-z_]\w*)(?:\s*\(\s*\.\.\.\s*\))?\s*",  # a variable, or a function taken as a value
}
_NOT_A_CALL_AFTER = {"new", "function", "fn", "fun", "func", "def", "class", "struct", "interface", "enum", "record", "trait"}


@dataclass
class Extraction:
    """Ranges are character places; ``calls`` are ``(name, place)``."""

    definitions: list[tuple[str, str, int, int]] = field(default_factory=list)
    calls: list[tuple[str, int]] = field(default_factory=list)
    comments: list[tuple[str, int]] = field(default_factory=list)
    errors: list[tuple[int, int, str]] = field(default_factory=list)


def signature(language: str, what: str, parent: str = "") -> str:
    return hashlib.sha256(f"{language}@{NAME}|{what}|parent={parent}".encode()).hexdigest()[:12]


#: Longer sources are scanned in pieces of about so many characters.
PIECE = 1 << 20
_WHOLE = ("python", "ruby", "dart")
_NEXT_DEFINITION = re.compile(r"[ \t]*(?://[^\n]*)?\r?\n(?=[A-Za-z_])")
_NEXT_PHP = re.compile(r"[ \t]*(?:(?://|#(?!\[))[^\n]*)?\r?\n(?=[A-Za-z_])")


def pieces(source: str, language: str) -> Iterator[tuple[int, str]]:
    """``(place, text)`` of the parts that a long source is scanned in: the ends of lines behind a bracket that closes all others.

    Nothing matches across such a place, as the next line starts with a word; Python and Ruby have no such brackets and Dart tells constructors by the classes of
    the whole file, so these stay whole.
    """
    begin, stack, after = 0, [], _NEXT_PHP if language == "php" else _NEXT_DEFINITION
    if len(source) > PIECE and language not in _WHOLE:
        closing = {")": "(", "]": "[", "}": "{"}
        for m in re.finditer(f"{_opaque(language)}|(?P<b>[()\\[\\]{{}}])", source, re.DOTALL | re.MULTILINE):
            c = m["b"]
            if not c:
                continue
            if c in "([{":
                stack.append(c)
            elif stack and stack[-1] == closing[c]:
                stack.pop()
                if not stack and c == "}" and m.end() - begin >= PIECE and (at := after.match(source, m.end())):
                    yield begin, source[begin : at.end()]
                    begin = at.end()
    yield begin, source[begin:] if begin else source


def extract(source: str, language: str) -> Extraction:
    if language == "python":
        return _python(source)
    if language not in LANGUAGES:
        raise ValueError(f"no extractor for {language}")
    return _Scanner(source, language).run()


def _python(source: str) -> Extraction:
    out = Extraction()
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError) as e:
        out.errors.append((getattr(e, "lineno", 0) or 0, 1, type(e).__name__))
        out.comments = [(m[0], m.start()) for m in re.finditer(r"(?m)(?<![\"'\w])#[^\n]*", source)]
        return out
    starts = [0]
    for line in source.splitlines(keepends=True):
        starts.append(starts[-1] + len(line))
    lines = source.splitlines(keepends=True)
    with suppress(tokenize.TokenError, SyntaxError):
        out.comments = [(t.string, starts[t.start[0] - 1] + t.start[1]) for t in tokenize.generate_tokens(io.StringIO(source).readline) if t.type == tokenize.COMMENT]

    def place(line: int, column: int) -> int:
        text = lines[line - 1] if line <= len(lines) else ""
        return starts[min(line, len(starts)) - 1] + len(text.encode()[:column].decode("utf-8", "ignore"))

    span = lambda n: (place(n.lineno, n.col_offset), place(n.end_lineno, n.end_col_offset))
    for n in ast.walk(tree):
        if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef):
            out.definitions.append(("function", n.name, *span(n)))
        elif isinstance(n, ast.ClassDef):
            out.definitions.append(("class", n.name, *span(n)))
        elif isinstance(n, ast.Assign) and isinstance(n.value, ast.Lambda) and len(n.targets) == 1 and isinstance(n.targets[0], ast.Name):
            out.definitions.append(("function", n.targets[0].id, *span(n)))
        elif isinstance(n, ast.Call):
            at = span(n)[0]
            if isinstance(n.func, ast.Name):
                out.calls.append((n.func.id, at))
            elif isinstance(n.func, ast.Attribute):
                out.calls.append((n.func.attr, at))
            out.calls += [(a.id, span(a)[0]) for a in n.args if isinstance(a, ast.Name)]
    out.definitions.sort(key=lambda d: (d[2], -d[3]))
    return out


def _opaque(lang: str) -> str:
    """The pattern of comments (``c``, ``h``) and strings (``s``)."""
    parts = [r"(?P<c>/\*.*?(?:\*/|\Z)|//[^\n]*)"] if lang != "ruby" else [r"(?P<c>^=begin.*?^=end[^\n]*|#(?!\{)[^\n]*)"]
    if lang == "php":
        parts.append(r"(?P<h>#(?!\[)[^\n]*)")
    strings = [r'"(?:\\.|[^"\\\n])*"', r"'(?:\\.|[^'\\\n])*'"]
    if lang in ("javascript", "typescript", "tsx", "go"):
        strings.append(r"`(?:\\.|[^`\\])*`")
    if lang in ("kotlin", "java", "dart", "csharp"):
        strings.insert(0, r'"""(?:.|\n)*?"""')
    if lang in ("rust", "cpp"):
        strings[1] = r"'(?:\\.[^']{0,8}|[^'\\\n])'"
    parts.append("(?P<s>" + "|".join(strings) + ")")
    return "|".join(parts)


class _Scanner:
    def __init__(self, source: str, language: str):
        self.source, self.language, self.out = source, language, Extraction()
        self.code = self._blank()
        self.pair, self.depth_error = self._brackets()

    def _blank(self) -> str:
        """The source with comments and strings overwritten by blanks, so places stay."""
        def blank(m: re.Match) -> str:
            if m.lastgroup in ("c", "h"):
                self.out.comments.append((m[0], m.start()))
            return re.sub(r"[^\n]", " ", m[0]) if m.lastgroup != "s" else '"' + re.sub(r"[^\n]", "_", m[0][1:-1]) + '"' if len(m[0]) > 1 else " "

        return re.sub(_opaque(self.language), blank, self.source, flags=re.DOTALL | re.MULTILINE)

    def _brackets(self) -> tuple[dict[int, int], bool]:
        pair, stack, bad = {}, [], False
        closing = {")": "(", "]": "[", "}": "{"}
        for m in re.finditer(r"[()\[\]{}]", self.code):
            c = m[0]
            if c in "([{":
                stack.append((c, m.start()))
            elif stack and stack[-1][0] == closing[c]:
                pair[stack.pop()[1]] = m.start()
            else:
                bad = True
                self.out.errors.append((m.start(), 1, c))
        for c, at in stack:
            bad = True
            self.out.errors.append((at, len(self.code) - at, c))
        return pair, bad

    def run(self) -> Extraction:
        if self.language == "ruby":
            self._ruby()
        else:
            self._classes()
            self._functions()
        self._calls()
        self.out.definitions = sorted(set(self.out.definitions), key=lambda d: (d[2], -d[3]))
        return self.out

    def _after(self, at: int) -> int:
        """The next place that is no white space."""
        m = re.compile(r"\S").search(self.code, at)
        return m.start() if m else len(self.code)

    def _classes(self) -> None:
        if self.language == "go":
            for m in re.finditer(r"\btype\s+(\w+)(?:\[[^\]]*\])?\s+(?:struct|interface)\s*\{", self.code):
                self._add("class", m[1], m.start(), self.pair.get(m.end() - 1, len(self.code)))
            return
        words = _CLASS_WORDS[self.language]
        for m in re.finditer(rf"(?<![\w.$@])(?:{words})\b(?:\s+class)?\s*(?:<[^{{;>]*>)?\s*(?:[\w:<>, &]+?\bfor\s+)?(?P<n>[A-Za-z_$][\w$]*)", self.code):
            name = m["n"]
            if self.language == "rust" and re.match(r"\s*::", self.code[m.end() :]) or re.fullmatch(r"impl\b.*\bfor\b.*", self.code[m.start() : m.start("n")].strip(), re.DOTALL) is None and re.match(r"(?:<[^{};]*>)?\s+for\b", self.code[m.end() :]):
                continue
            if name in ("extends", "implements", "where", "for") or (self.language == "cpp" and re.match(r"\s*[;*&>,)]", self.code[m.end() :])):
                continue
            opening = re.compile(r"[{;]").search(self.code, m.end())
            end = self.pair.get(opening.start(), len(self.code)) if opening and opening[0] == "{" else (opening.start() if opening else m.end())
            self._add("class", name, m.start(), end)

    def _add(self, kind: str, name: str, start: int, end: int) -> None:
        self.out.definitions.append((kind, name, start, end + 1))

    def _body(self, at: int, arrow: bool = True) -> int | None:
        """Where the body that begins at ``at`` ends; None without a body."""
        if at >= len(self.code):
            return None
        if self.code[at] == "{":
            return self.pair.get(at, len(self.code) - 1)
        if arrow:
            return self._expression_end(at)
        return None

    def _expression_end(self, at: int) -> int:
        i = at
        while i < len(self.code):
            c = self.code[i]
            if c in "([{":
                i = self.pair.get(i, len(self.code))
            elif c in ";,)]}":
                break
            elif c == "\n" and not re.match(r"\s*[.?:+*/&|=-]", self.code[i + 1 : i + 40]):
                break
            i += 1
        return i - 1

    def _functions(self) -> None:
        lang, code = self.language, self.code
        if lang in ("javascript", "typescript", "tsx"):
            for m in re.finditer(r"(?<![\w.$])function\s*\*?\s*([A-Za-z_$][\w$]*)\s*(?:<[^(]*>)?\(", code):
                self._head(m.start(), m[1], m.end() - 1)
            for m in re.finditer(r"(?<![\w.$])([A-Za-z_$][\w$]*)\s*(?::[^=;\n]+)?=\s*(?:async\s+)?(?:function\s*\*?\s*[\w$]*\s*(?P<f>\()|(?:<[^(]*>)?(?P<a>\()|(?P<i>[A-Za-z_$][\w$]*)\s*=>)", code):
                if m["i"]:
                    end = self._body(self._after(m.end()))
                    self._maybe(m.start(), m[1], end)
                elif m["f"]:
                    self._head(m.start(), m[1], m.end() - 1)
                else:
                    close = self.pair.get(m.end() - 1)
                    arrow = re.compile(r"\s*(?::[^=;{]+)?=>").match(code, close + 1) if close is not None else None
                    if arrow:
                        self._maybe(m.start(), m[1], self._body(self._after(arrow.end())))
            self._methods(r"(?<![\w.$])(?:(?:async|static|get|set|public|private|protected|readonly|override)\s+)*\*?\s*(#?[A-Za-z_$][\w$]*|\"[^\"]*\")\s*(?:<[^(){};]*>)?\(")
        elif lang == "go":
            for m in re.finditer(r"(?<!\w)func\s*(?:\([^)]*\)\s*)?(\w+)\s*(?:\[[^\]]*\])?\(", code):
                self._head(m.start(), m[1], m.end() - 1)
            for m in re.finditer(r"(?<!\w)(\w+)\s*(?::=|=)\s*func\s*\(", code):
                if code[: m.start()].rstrip(" \t").endswith(","):  # one name of several
                    continue
                self._head(m.start(), m[1], m.end() - 1)
        elif lang == "kotlin":
            for m in re.finditer(r"(?<!\w)fun\s+(?:<[^>]*>\s*)?(?:[\w<>?, ]+\.)?(\w+)\s*\(", code):
                self._head(m.start(), m[1], m.end() - 1, "=")
            for m in re.finditer(r"(?<!\w)va[lr]\s+(\w+)\s*(?::[^=\n]+)?=\s*\{", code):
                self._maybe(m.start(), m[1], self.pair.get(m.end() - 1))
        elif lang == "rust":
            for m in re.finditer(r"(?<!\w)fn\s+(\w+)\s*(?:<[^(]*>)?\(", code):
                self._head(m.start(), m[1], m.end() - 1, bodiless=True)
            for m in re.finditer(r"(?<!\w)let\s+(?:mut\s+)?(\w+)\s*(?::[^=\n]+)?=\s*(?:move\s+)?\|[^|]*\|", code):
                self._maybe(m.start(), m[1], self._body(self._after(m.end())))
        elif lang == "php":
            for m in re.finditer(r"(?<![\w$])function\s*&?\s*(\w+)\s*\(", code):
                self._head(m.start(), m[1], m.end() - 1)
            for m in re.finditer(r"\$(\w+)\s*=\s*(?:static\s+)?(?:function|fn)\s*&?\s*\(", code):
                close = self.pair.get(m.end() - 1)
                if close is not None:
                    at = re.compile(r"(?:\s*use\s*\([^)]*\))?\s*(?::\s*[?\w\\|]+)?\s*(?:=>)?\s*").match(code, close + 1).end()
                    self._maybe(m.start(), m[1], self._body(at))
        else:  # Java, C#, C++, Dart: a name, its parameters, a body
            self._methods(r"(?<![\w.])(~?[A-Za-z_]\w*)\s*(?:<[^(){};=]*>)?\(", out_of_line=lang == "cpp")
            lambdas = {"java": r"->", "csharp": r"=>", "dart": r"=>|(?=\{)"}.get(lang)
            if lambdas:
                for m in re.finditer(r"(?<![\w.])(\w+)\s*=\s*(?:async\s+)?(?:\(|(\w+)\s*(?:->|=>))", code):
                    if m[2]:
                        self._maybe(m.start(), m[1], self._body(self._after(m.end())))
                        continue
                    close = self.pair.get(m.end() - 1)
                    arrow = re.compile(rf"\s*(?:{lambdas})").match(code, close + 1) if close is not None else None
                    if arrow:
                        self._maybe(m.start(), m[1], self._body(self._after(arrow.end())))
            if lang == "dart":
                classes = {d[1] for d in self.out.definitions if d[0] == "class"}
                self.out.definitions = [d for d in self.out.definitions if d[0] == "class" or d[1] not in classes]  # constructors
                for m in re.finditer(r"(?<![\w.])get\s+(\w+)\s*(?:async\*?\s*|sync\*\s*)?(=>|\{)", code):
                    self._maybe(m.start(), m[1], self.pair.get(m.start(2)) if m[2] == "{" else self._expression_end(self._after(m.end())))
            elif lang == "cpp":
                for m in re.finditer(r"(?<!\w)auto\s+(\w+)\s*=\s*\[[^\]]*\]\s*(?:\([^)]*\))?[^{;]*\{", code):
                    self._maybe(m.start(), m[1], self.pair.get(m.end() - 1))

    def _maybe(self, start: int, name: str, end: int | None) -> None:
        if end is not None:
            self._add("function", name, start, end)

    _TAIL = re.compile(r"(?:\s+(?:throws|where)\s+[^{;=]*|\s*(?:->|:)\s*[^{;=]+|\s*(?:const|noexcept|override|final|async\*?|sync\*|volatile|&&?|mutable)\b)*\s*")

    def _head(self, start: int, name: str, opening: int, assign: str = "", bodiless: bool = False) -> None:
        """A definition whose parameters open at ``opening``."""
        close = self.pair.get(opening)
        if close is None:
            return
        nxt = re.compile(r"[{;=\n]" if not assign else r"[{=\n]").search(self.code, close + 1)
        at = close + 1
        while nxt and nxt[0] == "\n":
            at = self._after(nxt.start())
            if at < len(self.code) and self.code[at] in "{=;":
                nxt = re.compile(r"[{;=]").match(self.code, at)
                break
            if self.language in ("go", "kotlin"):
                nxt = None
                break
            nxt = re.compile(r"[{;=]").search(self.code, at)
        if nxt and nxt[0] == "{":
            self._maybe(start, name, self.pair.get(nxt.start(), len(self.code) - 1))
        elif nxt and nxt[0] == "=" and assign:
            self._maybe(start, name, self._body(self._after(nxt.end())))
        elif bodiless:
            self._maybe(start, name, nxt.start() if nxt else close)

    def _methods(self, head: str, out_of_line: bool = False) -> None:
        for m in re.finditer(head, self.code):
            name = m[1]
            if name in _CONTROL or re.search(r"(?:\bnew|\breturn|=>|->|=|\bfunction\s*\*?|\brecord)\s*$", self.code[max(0, m.start() - 12) : m.start()]):
                continue
            close = self.pair.get(m.end() - 1)
            if close is None:
                continue
            tail = self._TAIL.match(self.code, close + 1)
            at = tail.end() if tail else close + 1
            if at < len(self.code) and self.code[at] == "{":
                self._add("function", name.strip('"'), m.start(), self.pair.get(at, len(self.code) - 1))
            elif self.language in ("csharp", "dart") and self.code.startswith("=>", at) and re.search(r"[\w>\])?]\s+$", self.code[max(0, m.start() - 60) : m.start()]):
                self._maybe(m.start(), name, self._expression_end(self._after(at + 2)))

    def _ruby(self) -> None:
        stack: list[tuple[str, str, int]] = []
        opener = re.compile(r"(?m)(?P<def>\bdef\s+(?:self\.)?(?P<n>[\w]+[?!=]?|[+\-*/<=>\[\]%!~^&|]+))|(?P<class>^\s*(?:class|module)\s+(?P<c>[\w:]+))|(?P<open>(?:^|[=;(]|\bdo\b.*?;)\s*\b(?:if|unless|case|while|until|begin|for)\b|\bdo\b)|(?P<end>\bend\b)")
        for m in opener.finditer(self.code):
            if m["def"]:
                rest = self.code[m.end() :].split("\n", 1)[0]
                if re.match(r"\s*(?:\([^)]*\))?\s*=\s*\S", rest) and not m["n"].endswith("="):
                    self._add("function", m["n"], m.start(), m.end() + len(rest))
                else:
                    stack.append(("function", m["n"], m.start()))
            elif m["class"]:
                stack.append(("class", m["c"].split("::")[-1], m.start("class") + len(m["class"]) - len(m["class"].lstrip())))
            elif m["open"]:
                stack.append(("", "", m.start()))
            elif stack:
                kind, name, start = stack.pop()
                if kind:
                    self._add(kind, name, start, m.end() - 1)
        for kind, name, start in stack:
            if kind:
                self._add(kind, name, start, len(self.code) - 1)
                self.out.errors.append((start, len(self.code) - start, "end"))
        for m in re.finditer(r"(?<!\w)(\w+)\s*=\s*(?:->\s*(?:\([^)]*\))?|lambda|proc)\s*\{", self.code):
            self._maybe(m.start(), m[1], self.pair.get(m.end() - 1))

    def _calls(self) -> None:
        lang, code = self.language, self.code
        control = _CONTROL | _OWN_CONTROL.get(lang, set())
        heads = {(d[1], d[2]) for d in self.out.definitions}
        names_at = {m for n, s in heads for m in [code.find(n, s)]}
        generic = r"(?:::)?(?:<[\w\s,.:<>\[\]?&']*>)?" if lang in ("typescript", "tsx", "rust", "cpp", "java", "dart") else ""
        bang = r"[?!]?" if lang == "ruby" else ""
        for m in re.finditer(rf"(#?[A-Za-z_$][\w$]*{bang})\s*{generic}(?:\?\.)?\(", code):
            name = m[1]
            before = code[max(0, m.start() - 16) : m.start()].rstrip()
            word = re.search(r"[\w$]+$", before)
            if name in control or m.start() in names_at or code[max(0, m.start() - 1) : m.start()] == "~" or (word and word[0] in _NOT_A_CALL_AFTER) or (lang == "go" and name in _GO_TYPES and not before.endswith(".")):
                continue
            self.out.calls.append((name.lstrip("$") if lang == "php" else name, m.start()))
            if lang not in _NO_BARE_ARGS:
                self._arguments(m.end() - 1)
        if lang == "java":
            self.out.calls += [(m[1], m.start()) for m in re.finditer(r"(?<=::)\s*([A-Za-z_]\w*)(?=\s*[,)])", code)]
        if lang == "kotlin":
            self.out.calls += [(m[1], m.start()) for m in re.finditer(r"(?<!\w)([a-z]\w*)\s*\{", code) if m[1] not in _CONTROL and m.start(1) not in names_at and m[1] not in ("object", "init", "get", "set", "companion", "class", "interface", "enum")]
        if lang == "ruby":
            self.out.calls += [(m[1], m.start(1)) for m in re.finditer(r"(?<=\.)([A-Za-z_]\w*+[?!]?+)(?!\s*\()(?!\s*=(?![=~>]))", code) if m.start() not in names_at]
            self.out.calls += [(m[1], m.start(1)) for m in re.finditer(r"(?<![\w.:@$])([a-z_]\w*[?!])(?!\s*[(=])", code) if m.start(1) not in names_at]
        self.out.calls.sort(key=lambda c: c[1])

    def _arguments(self, opening: int) -> None:
        """Bare names as direct arguments are references."""
        close = self.pair.get(opening)
        if close is None:
            return
        at, depth, starts = opening + 1, 0, [opening + 1]
        while at < close:
            c = self.code[at]
            if c in "([{":
                at = self.pair.get(at, close)
            elif c == ",":
                starts.append(at + 1)
            at += 1
        del depth
        for a, b in zip(starts, [*(s - 1 for s in starts[1:]), close], strict=True):
            m = re.fullmatch(_ARGUMENT.get(self.language, _ANY_ARGUMENT), self.code[a:b])
            if m and m[1] not in ("true", "false", "null", "None", "nil", "this", "self", "undefined", "nullptr"):
                self.out.calls.append((m[1], a + m.start(1)))


def line_of(source: str, places: list[int]) -> list[int]:
    """Line numbers, from 1, of places."""
    breaks = [m.start() for m in re.finditer("\n", source)]
    return [bisect_right(breaks, p - 1) + 1 for p in places]
