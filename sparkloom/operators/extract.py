"""Symbols from source files of seven languages: functions, structs, fields, calls, imports, comments, variables.

Python goes through the standard library's parser, with a line-based reading where a file does not
parse. The brace languages share one lexer (strings, comments, brackets) and one walk over its
tokens that decides, at every `{` and at every end of a statement, what the tokens before declare.
One file is one unit of work inside mapInPandas; files are never grouped."""

from __future__ import annotations

import ast
import hashlib
import re
import sys
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import long_enough, namespace
from ..schemas import stable_id

SYMBOLS = (
    "file_path string, language string, kind string, name string, symbol_id string, parent_id string, start_row int, end_row int, decl_end_row int, "
    "start_byte int, end_byte int, class_type string, bases array<string>, args array<struct<name:string,type:string>>, return_type string, type_name string, "
    "path_components array<string>, alias string, import_type string, declaration string, content string, is_error boolean"
)
COLUMNS = [re.split(r"[ ]", x.strip(), maxsplit=1)[0] for x in re.split(r",(?![^<]*>)", SYMBOLS)]


class Token(NamedTuple):
    kind: str  # word, number, string, comment, mark
    text: str
    start: int
    end: int


LEX = re.compile(
    r"""(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))
      |(?P<string>(?:\b[rbu]{0,2})?r\#+".*?"\#+|(?:\b[LuUbr]{1,2}8?)?"(?:[^"\\\n]|\\.)*"|`(?:[^`\\]|\\.)*`|'(?:[^'\\\n]|\\.){1,80}')
      |(?P<word>[A-Za-z_$@\#][\w$]*!?(?![=\w]))|(?P<word2>[A-Za-z_$@\#][\w$]*)
      |(?P<number>\d[\w.]*)
      |(?P<mark>=>|->|::|\.\.\.|&&|\|\||[-+*/%=<>!&|^]=|[^\s\w])""",
    re.X | re.S,
)


def lex(code: str, language: str) -> Iterator[Token]:
    at = 0
    while m := LEX.search(code, at):
        kind, text = m.lastgroup, m[0]
        at = m.end()
        if kind == "word2":
            kind = "word"
        if kind == "word" and text.endswith("!") and language != "rust":
            text, at = text[:-1], at - 1
        if kind == "string" and language in ("rust", "cpp", "java", "go") and text[0] == "'" and len(text) > 12:
            kind, text, at = "mark", "'", m.start() + 1
        if kind == "string" and language == "rust" and text[0] == "'" and not re.fullmatch(r"'(?:[^'\\]|\\.[^']*)'", text):
            kind, text, at = "mark", "'", m.start() + 1
        yield Token(kind, text, m.start(), at)


# Words that are no calls and no function names, by family.
KEYWORDS = frozenset(
    "if else for while do switch case default return break continue match loop in of new delete typeof instanceof void yield await async throw throws try catch finally "
    "sizeof alignof decltype static_assert function func fn let const var mut ref move pub use mod impl trait struct enum union class interface type where dyn unsafe extern crate "
    "super self Self this import export from package go defer select chan range fallthrough public private protected static final abstract synchronized native volatile transient "
    "namespace template typename using operator friend virtual inline explicit constexpr noexcept override extends implements as is keyof readonly declare".split()
) - {"self", "Self"}
#: Of these, words that only one language reserves.
RESERVED_BY = {
    "go": frozenset("go defer chan range select func fallthrough".split()),
    "rust": frozenset("match loop mod ref move impl trait fn crate dyn mut pub unsafe where use".split()),
    "cpp": frozenset("template typename operator friend virtual explicit constexpr noexcept alignof decltype sizeof inline using union".split()),
}


def keywords_of(language: str) -> frozenset[str]:
    return KEYWORDS.difference(*(w for k, w in RESERVED_BY.items() if k != language))


STRUCT_WORDS = {
    "rust": ("struct", "enum", "union", "trait", "impl"),
    "javascript": ("class",),
    "typescript": ("class", "interface", "enum"),
    "go": ("struct",),
    "java": ("class", "interface", "enum", "record"),
    "cpp": ("class", "struct", "enum", "union"),
}
CLASS_TYPES = {"struct": "Struct", "class": "Class", "interface": "Interface", "enum": "Enum", "trait": "Trait", "union": "Struct", "impl": "Struct", "record": "Class", "object": "Struct", "alias": "Struct"}
PYTHON_SYSTEM = sys.stdlib_module_names


class Scope:
    def __init__(self, kind: str, row: dict | None, opened: int):
        self.kind, self.row, self.opened = kind, row, opened


class BraceWalk:
    """The symbols of one file of a brace language."""

    def __init__(self, path: str, language: str, code: str):
        self.path, self.language, self.code = path, language, code
        self.rows: list[dict] = []
        self.words = keywords_of(language)
        self.lines = [0, *(m.end() for m in re.finditer("\n", code))]
        self.scopes = [Scope("file", None, 0)]

    def row_of(self, at: int) -> int:
        import bisect

        return bisect.bisect_right(self.lines, at) - 1

    def add(self, kind: str, name: str, start: int, end: int, decl_end: int | None = None, parent: Scope | None = None, **more) -> dict:
        owner = parent or next((s for s in reversed(self.scopes) if s.row is not None), None)
        row = dict.fromkeys(COLUMNS)
        row |= {"file_path": self.path, "language": self.language, "kind": kind, "name": name, "_start": start, "_end": end, "_decl": decl_end or end, "_parent": owner.row if owner else None, "is_error": False, **more}
        self.rows.append(row)
        return row

    def run(self) -> list[dict]:
        header: list[Token] = []
        depth, last = [], None
        skip_macro = 0
        skip_to = 0
        for t in lex(self.code, self.language):
            if t.start < skip_to:
                continue
            if self.language == "cpp" and t.text.startswith("#"):
                stop = self.code.find("\n", t.start)
                skip_to = stop if stop >= 0 else len(self.code)
                if "include" in self.code[t.start : skip_to]:
                    self.imports([Token("word", "#include", t.start, skip_to)])
                continue
            if t.kind == "comment":
                self.comment(t)
                continue
            # languages in which a line may end a statement
            if last is not None and header and not depth and self.language in ("go", "javascript", "typescript") and "\n" in self.code[last.end : t.start] and t.text not in (".", "{", "?", ":", "=>", "&&", "||", "=", ")", "]") and last.text not in (",", ".", "=", "=>", "&&", "||", "(", "["):
                self.statement(header)
                header = []
            if skip_macro and t.text in ("(", "[", "{"):
                depth.append(t.text)
                skip_macro = len(depth) if skip_macro < 0 else skip_macro
            elif t.text in ("(", "["):
                depth.append(t.text)
                if t.text == "(":
                    self.call(header)
                    if self.language == "rust" and header and header[-1].kind == "word" and header[-1].text.endswith("!"):
                        skip_macro = len(depth)
            elif t.text in (")", "]") and depth:
                depth.pop()
                if skip_macro > len(depth):
                    skip_macro = 0
            elif t.text == "{" and header and (header[0].text in ("use", "import") or [x.text for x in header[:2]] == ["pub", "use"]):
                depth.append("{")
            elif t.text == "}" and depth and depth[-1] == "{":
                depth.pop()
                if skip_macro > len(depth):
                    skip_macro = 0
            elif t.text == "{" and not skip_macro:
                scope = self.opened(header, t, depth)
                scope.depth = depth
                self.scopes.append(scope)
                header, depth = [], []
                last = t
                continue
            elif t.text == "}":
                if header:
                    self.statement(header, True)
                    header = []
                if len(self.scopes) > 1:
                    scope = self.scopes.pop()
                    depth = scope.depth
                    if scope.row is not None:
                        scope.row["_end"] = t.end
                    if depth or scope.kind in ("object", "literal"):
                        header = [Token("mark", "{}", scope.opened, t.end)]
                last = t
                continue
            elif (t.text == ";" or (t.text == "," and self.scopes[-1].kind in ("struct", "enum", "object", "trait"))) and not depth:
                self.statement([*header, t] if t.text == ";" else header)
                header = []
                last = t
                continue
            elif self.language == "cpp" and t.text == ":" and len(header) == 1 and header[0].text in ("public", "private", "protected"):
                header = []
                last = t
                continue
            header.append(t)
            last = t
        if header:
            self.statement(header, True)
        return self.finish()

    def comment(self, t: Token) -> None:
        before = self.rows[-1] if self.rows else None
        row = self.row_of(t.start)
        if t.text.startswith("//") and before is not None and before["kind"] == "comment" and before["_line"] and self.row_of(before["_end"] - 1) == row - 1 and not self.code[self.lines[row] : t.start].strip():
            before["_end"] = before["_decl"] = t.end
            return
        self.add("comment", "", t.start, t.end, _line=t.text.startswith("//"))

    def call(self, header: list[Token]) -> None:
        """A call at an opening parenthesis, if the token before names one and it declares nothing."""
        if not header or header[-1].kind != "word":
            return
        name, before = header[-1].text, header[-2].text if len(header) > 1 else ""
        if self.language == "rust" and name.endswith("!"):
            return
        if name in self.words or name.startswith(("@", "#")) or before in ("function", "fn", "func", "class", "struct", "new") and not (before == "new" and self.language == "java"):
            return
        inside = self.scopes[-1].kind
        if before == "::" and self.language == "cpp" and inside not in ("function", "block"):
            return
        self.add("call", name, header[-1].start, header[-1].end)

    def drop_pending_calls(self, start: int, end: int) -> None:
        """Drops the calls read since start, which stand at the end of the rows."""
        k = len(self.rows)
        while k and self.rows[k - 1]["_start"] >= start:
            k -= 1
        self.rows[k:] = [r for r in self.rows[k:] if not (r["kind"] == "call" and r["_start"] < end)]

    def opened(self, header: list[Token], brace: Token, depth: list) -> Scope:
        words = [t.text for t in header]
        start = header[0].start if header else brace.start
        scope_kind, lang = self.scopes[-1].kind, self.language
        for i, w in enumerate(words):
            if w in STRUCT_WORDS[lang] and not depth:
                if lang == "go" and not ("type" in words[:i] and i >= 1):
                    break
                if lang == "cpp" and "(" in words[:i]:
                    break
                name, bases = self.struct_name(header, i)
                if name:
                    self.drop_pending_calls(start, brace.start)
                    kind = "trait" if w in ("trait", "interface") else "enum" if w == "enum" else "struct"
                    row = self.add("struct", name, start, brace.end, header[-1].end, class_type=CLASS_TYPES["struct" if lang == "go" else w], bases=bases)
                    return Scope(kind, row, brace.start)
        if lang == "rust" and "mod" in words[:2] or lang == "cpp" and "namespace" in words[:2] or lang in ("typescript",) and words[:1] in (["namespace"], ["module"]):
            return Scope("namespace", None, brace.start)
        if found := self.function_name(header, depth):
            name, name_token, first, last = found
            self.drop_pending_calls(name_token.start, name_token.end)
            args = self.arguments(header, name_token)
            row = self.add("function", name, first, brace.end, last, args=args, return_type=self.return_type(header, name_token))
            return Scope("function", row, brace.start)
        if lang in ("javascript", "typescript") and len(words) >= 2 and words[-1] in ("=", ":", "return", "(") and not (words[-1] == ":" and "?" in words):
            named = next((t for t in reversed(header[:-1]) if t.kind in ("word", "string") and t.text not in self.words), None)
            if words[-1] in ("=", ":") and named is not None and scope_kind in ("file", "object", "function", "namespace", "block", "struct") and "interface" not in words:
                row = self.add("struct", named.text.strip("'\""), named.start, brace.end, named.end, class_type="Struct", bases=[])
                return Scope("object", row, brace.start)
            return Scope("literal", None, brace.start)
        if lang == "rust" and header and header[-1].kind == "word" and words[-1][:1].isupper() and scope_kind in ("function", "block") and not set(words) & {"if", "while", "for", "match", "loop", "impl"}:
            self.add("call", words[-1], header[-1].start, header[-1].end)
            return Scope("literal", None, brace.start)
        return Scope("block" if scope_kind in ("function", "block", "literal") else "other", None, brace.start)

    def struct_name(self, header: list[Token], i: int) -> tuple[str, list[str]]:
        after = header[i + 1 :]
        words = [t.text for t in after if t.kind == "word" and t.text not in ("extends", "implements", "public", "private", "protected", "virtual", "final", "class", "for", "where")]
        if self.language == "go":
            named = header[i - 1]
            return (named.text if named.kind == "word" else "", [])
        if header[i].text == "impl":
            text = [t.text for t in after]
            if text[:1] == ["<"]:
                n, k = 0, 0
                for k, x in enumerate(text):
                    n += (x == "<") - (x == ">")
                    if n == 0:
                        break
                text, after = text[k + 1 :], after[k + 1 :]
            if "for" in text:
                k = text.index("for")
                trait = next((x.text for x in after[:k] if x.kind == "word"), "")
                name = next((x.text for x in after[k + 1 :] if x.kind == "word" and x.text not in ("mut", "dyn")), "")
                return name, [trait]
            return next((x.text for x in after if x.kind == "word"), ""), []
        if not words:
            return "anonymous", []
        marks = [t.text for t in after]
        cut = next((k for k, x in enumerate(marks) if x in (":", "extends", "implements")), None)
        bases = [t.text for t in after[cut:] if t.kind == "word" and t.text not in ("extends", "implements", "public", "private", "protected", "virtual")] if cut is not None else []
        return words[0], bases

    def function_name(self, header: list[Token], depth: list):
        """(name, its token, start, declaration end) if the header ends in a function's declaration."""
        lang, words, inside = self.language, [t.text for t in header], self.scopes[-1].kind
        if not header:
            return None
        for key in ("fn", "func", "function"):
            if key in words and lang in {"fn": ("rust",), "func": ("go",), "function": ("javascript", "typescript")}[key]:
                i = len(words) - 1 - words[::-1].index(key)
                j = i + 1
                if lang == "go" and j < len(words) and words[j] == "(":
                    j = self.matching(words, j) + 1
                if j < len(header) and words[j] == "*":
                    j += 1
                if j < len(header) and header[j].kind == "word" and (words[j] not in self.words or key != "function"):
                    return words[j], header[j], header[0].start if key != "function" or not depth else header[i].start, header[-1].end
                if lang == "go":
                    return None
                named = self.bound_name(header[:i])
                if named:
                    return named.text.strip("'\""), named, header[0].start if not depth else named.start, header[-1].end
                return f"lambda-{header[i].start}", header[i], header[i].start, header[-1].end
        if words[-1] == "=>" and lang in ("javascript", "typescript"):
            named = self.bound_name(header)
            if named and not depth:
                return named.text.strip("'\""), named, header[0].start, header[-1].end
            return f"lambda-{header[-1].start}", header[-1], header[-1].start, header[-1].end
        if "(" not in words or lang in ("rust", "go"):
            return None
        i = words.index("(")
        if i == 0 or header[i - 1].kind != "word" or words[i - 1] in self.words - {"new"} or "=" in words[:i] or depth:
            if not (lang == "cpp" and "operator" in words[:i]):
                return None
        if lang == "cpp":
            if inside in ("function", "block", "literal") or words[0] in ("if", "for", "while", "switch", "return", "else", "do", "catch"):
                return None
        elif lang == "java":
            if inside not in ("struct", "enum", "trait"):
                return None
        elif inside != "struct":
            if inside != "object":
                return None
        return words[i - 1], header[i - 1], header[0].start, header[-1].end

    @staticmethod
    def matching(words: list[str], i: int) -> int:
        n = 0
        for k in range(i, len(words)):
            n += (words[k] == "(") - (words[k] == ")")
            if n == 0:
                return k
        return len(words) - 1

    def bound_name(self, header: list[Token]) -> Token | None:
        """The variable, key or member that a function value is bound to."""
        words = [t.text for t in header]
        for mark in ("=", ":"):
            if mark in words and (mark == "=" or self.scopes[-1].kind == "object"):
                i = words.index(mark)
                left = header[:i]
                if ":" in words[:i] and mark == "=":
                    left = header[: words.index(":")]
                found = [t for t in left if t.kind in ("word", "string") and t.text not in self.words]
                return found[-1] if found else None
        return None

    def arguments(self, header: list[Token], name: Token) -> list[dict]:
        k = next((i for i, t in enumerate(header) if t.start >= name.start and t.text == "("), None)
        if k is None:
            return []
        words = [t.text for t in header]
        stop = self.matching(words, k)
        out, part, n = [], [], 0
        for t in [*header[k + 1 : stop], Token("mark", ",", 0, 0)]:
            n += (t.text in "([{<") - (t.text in ")]}>") if len(t.text) == 1 else 0
            if t.text == "," and n <= 0:
                if part:
                    out.append(self.argument(part))
                part = []
            else:
                part.append(t)
        return out

    def argument(self, part: list[Token]) -> dict:
        raw = re.sub(r"\s+", " ", self.code[part[0].start : part[-1].end])
        if self.language in ("rust", "typescript") and ":" in raw:
            name, _, kind = raw.partition(":")
            return {"name": name.strip(), "type": kind.strip()}
        if self.language == "go":
            name, _, kind = raw.partition(" ")
            return {"name": name, "type": kind or None}
        if self.language in ("java", "cpp") and len(part) > 1 and part[-1].kind == "word":
            return {"name": part[-1].text, "type": raw[: len(raw) - len(part[-1].text)].strip()}
        return {"name": raw, "type": None}

    def return_type(self, header: list[Token], name: Token) -> str | None:
        k = next((i for i, t in enumerate(header) if t.start >= name.start and t.text == "("), None)
        if k is None:
            return None
        stop = self.matching([t.text for t in header], k)
        after = header[stop + 1 :]
        if after and after[0].text in ("->", ":") and self.language in ("rust", "typescript"):
            tail = [t for t in after[1:] if t.text not in ("=>", "where")]
            return self.code[tail[0].start : tail[-1].end] if tail else None
        if self.language == "go":
            return self.code[after[0].start : after[-1].end] if after else None
        if self.language in ("java", "cpp"):
            before = [t for t in header if t.end <= name.start and t.text not in ("public", "private", "protected", "static", "final", "abstract", "virtual", "inline", "synchronized", "native") and not t.text.startswith("@")]
            return self.code[before[0].start : before[-1].end] if before else None
        return None

    def statement(self, header: list[Token], unfinished: bool = False) -> None:
        """What a statement without a block declares: an import, a field, a signature, an alias, a variable."""
        if not header:
            return
        words, scope, lang = [t.text for t in header], self.scopes[-1].kind, self.language
        start, end = header[0].start, header[-1].end
        if words[0] in ("import", "use", "#include") or words[:2] == ["pub", "use"] or words[:2] == ["export", "from"] or (lang in ("go",) and scope == "file" and header[0].kind == "string") or (words[0] == "import" and lang == "go"):
            self.imports(header)
            return
        if lang == "cpp" and words[0] == "#" and "include" in words:
            self.imports(header)
            return
        if scope in ("struct", "trait", "enum", "object"):
            bare = [t for t in header if t.text != ";"]
            if not bare or bare[0].text == "{}":
                return
            plain = [t.text for t in bare]
            if "(" in plain and scope != "enum" and "=" not in plain[: plain.index("(")]:
                i = plain.index("(")
                named = bare[i - 1] if i else None
                if "fn" in plain or (named is not None and named.kind == "word" and lang != "rust" and lang != "go"):
                    if named is not None and ("fn" in plain or named.text not in self.words):
                        self.drop_pending_calls(start, end)
                        self.add("function", named.text, start, end, end, args=self.arguments(bare, named), return_type=self.return_type(bare, named))
                        return
            if scope == "enum":
                self.drop_pending_calls(start, end)
            self.field(bare, scope, end)
            return
        if "type" in words[:3] and "=" in words or words[0] in ("typedef", "using") and lang == "cpp" and "namespace" not in words:
            named = next((t for t in header[words.index("type") + 1 :] if t.kind == "word"), None) if "type" in words[:3] else next((t for t in (header[1:] if words[0] == "using" else header[::-1]) if t.kind == "word"), None)
            if named is not None:
                self.add("struct" if lang == "typescript" else "type_alias", named.text, start, end, end, class_type="Struct" if lang == "typescript" else None, bases=[])
            return
        if words[0] in ("struct",) and lang == "rust" or words[:2] == ["pub", "struct"]:
            named = next((t for t in header[words.index("struct") + 1 :] if t.kind == "word"), None)
            if named is not None:
                self.drop_pending_calls(start, end)
                self.add("struct", named.text, start, end, end, class_type="Struct", bases=[])
            return
        if lang == "rust" and "fn" in words:
            named = header[min(words.index("fn") + 1, len(header) - 1)]
            self.add("function", named.text, start, end, end, args=self.arguments(header, named))
            return
        if words[-1:] == ["=>"] or "=>" in words:
            named = self.bound_name(header)
            if named is not None and lang in ("javascript", "typescript"):
                self.add("function", named.text, start, end, end, args=[])
                return
        if words[0] in ("let", "const", "var", "static", "auto") or ":=" in self.code[start:end] or (lang in ("java", "cpp") and "=" in words and words.index("=") >= 2 and "(" not in words[: words.index("=")]):
            stop = words.index("=") if "=" in words else len(words)
            left = [t for t in header[:stop] if t.kind == "word" and t.text not in self.words]
            if left:
                named = left[-1] if lang in ("java", "cpp") else left[0]
                self.add("variable", named.text, start, end, end)

    def field(self, bare: list[Token], scope: str, end: int) -> None:
        words, lang = [t.text for t in bare], self.language
        stop = next((i for i, w in enumerate(words) if w in ("=", ":", "?") or w == "{}"), len(words))
        left = [t for t in bare[:stop] if t.kind in ("word", "string") and t.text not in self.words and not t.text.startswith(("@", "#"))]
        if not left:
            return
        if scope == "enum" or lang in ("go", "rust"):
            named = left[0]
        elif lang in ("java", "cpp"):
            named = left[-1]
        else:
            named = left[-1] if scope != "object" else left[0]
        kind = None
        if lang in ("rust", "typescript") and ":" in words:
            k = words.index(":")
            tail = [t for t in bare[k + 1 :] if t.text != "="]
            kind = self.code[tail[0].start : tail[-1].end] if tail else None
        elif lang in ("java", "cpp") and len(left) > 1:
            kind = self.code[left[0].start : left[-1].start].strip()
        elif lang == "go" and len(bare) > 1:
            kind = self.code[bare[1].start : bare[-1].end]
        last = end if lang in ("java", "cpp", "typescript") else bare[-1].end
        self.add("field", named.text.strip("'\""), bare[0].start, last, last, type_name=kind)

    def imports(self, header: list[Token]) -> None:
        raw = self.code[header[0].start : header[-1].end].rstrip(";").strip()
        found: list[tuple[list[str], str | None]] = []
        if self.language == "rust":
            body = re.sub(r"^(?:pub(?:\([^)]*\))?\s+)?use\s+", "", raw)
            found = [(p.split("::"), a) for p, a in rust_paths(body)]
        elif self.language == "java":
            found = [(re.sub(r"^import\s+(?:static\s+)?", "", raw).split("."), None)]
        elif self.language == "cpp":
            m = re.search(r"[<\"]([^>\"]+)[>\"]", self.code[header[0].start : self.code.find("\n", header[0].start) if "\n" in self.code[header[0].start :] else None])
            found = [(m[1].split("/"), None)] if m else []
        elif self.language == "go":
            for t in header:
                if t.kind == "string":
                    i = header.index(t)
                    alias = header[i - 1].text if i and header[i - 1].kind == "word" and header[i - 1].text != "import" else None
                    found.append((t.text.strip('"`').split("/"), alias))
        else:
            strings = [t.text[1:-1] for t in header if t.kind == "string"]
            found = [(strings[-1].split("/"), None)] if strings else []
        for parts, alias in found:
            self.add("import", parts[-1], header[0].start, header[-1].end, path_components=parts, alias=alias, import_type=import_type(self.language, parts, raw))

    def finish(self) -> list[dict]:
        starts, broken = encoded_offsets(self.code), unbalanced(self.code, self.language)
        for r in self.rows:
            r["is_error"] = r["is_error"] or (r["kind"] == "call" and any(a <= r["_start"] < z for a, z in broken))
            first, last = self.row_of(r["_start"]), self.row_of(max(r["_end"] - 1, r["_start"]))
            r |= {"start_row": first, "end_row": last, "decl_end_row": self.row_of(max(r["_decl"] - 1, r["_start"])), "start_byte": starts(r["_start"]), "end_byte": starts(r["_end"])}
            r["declaration"] = self.code[r["_start"] : r["_decl"]]
            stop = self.lines[last + 1] - 1 if last + 1 < len(self.lines) else len(self.code)
            r["content"] = self.code[self.lines[first] : stop]
        return identified(self.rows)


def unbalanced(code: str, language: str) -> list[tuple[int, int]]:
    """Character ranges that cannot be parsed: from a bracket that never closes to what ends it (the closing bracket
    around it, or the file), and the line of a closing bracket that nothing opened. Calls there are marked as errors."""
    pairs, stack, out = {")": "(", "]": "[", "}": "{"}, [], []
    for t in lex(code, language):
        if t.kind in ("string", "comment"):
            continue
        if t.text in ("(", "[", "{"):
            stack.append(t)
        elif t.text in pairs:
            if not any(s.text == pairs[t.text] for s in stack):
                out.append((code.rfind("\n", 0, t.start) + 1, t.end))
                continue
            while stack[-1].text != pairs[t.text]:
                out.append((stack.pop().start, t.start))
            stack.pop()
    return out + [(t.start, len(code)) for t in stack]


def encoded_offsets(code: str):
    """Byte offsets of character offsets."""
    if code.isascii():
        return lambda at: at
    import numpy as np

    ends = np.cumsum([len(c.encode("utf-8", "replace")) for c in code])
    return lambda at: int(ends[at - 1]) if at else 0


def rust_paths(body: str) -> list[tuple[str, str | None]]:
    body = re.sub(r"\s+", " ", body.strip())
    m = re.match(r"^(.*?)\{(.*)\}$", body)
    if not m:
        path, _, alias = body.partition(" as ")
        return [(path.strip(), alias.strip() or None)]
    out, part, n = [], "", 0
    for ch in m[2] + ",":
        n += (ch == "{") - (ch == "}")
        if ch == "," and n == 0:
            if part.strip():
                out += [(m[1].strip() + p, a) for p, a in rust_paths(part)]
            part = ""
        else:
            part += ch
    return out


def import_type(language: str, parts: list[str], raw: str) -> str:
    head = parts[0]
    if language == "python":
        return "UserModule" if head in ("", ".") or raw.lstrip().startswith("from .") else "System" if head in PYTHON_SYSTEM else "Library"
    if language == "rust":
        return "System" if head in ("std", "core", "alloc") else "UserModule" if head in ("crate", "self", "super") else "Library"
    if language == "java":
        return "System" if head in ("java", "javax") else "Library"
    if language == "cpp":
        return "System" if "<" in raw else "UserModule"
    if language == "go":
        return "UserModule" if head.startswith(".") else "System"
    return "UserModule" if head.startswith(".") else "Library"


def identified(rows: list[dict]) -> list[dict]:
    """Rows with deterministic ids: the same file gives the same ids in every run."""
    seen: dict = {}
    for r in rows:
        key = (r["file_path"], r["kind"], r["start_row"], r["end_row"], r["name"])
        n = seen[key] = seen.get(key, -1) + 1
        r["symbol_id"] = hashlib.md5("\x1f".join(map(str, (*key, n) if n else key)).encode("utf-8", "replace")).hexdigest()
    for r in rows:
        r["parent_id"] = r["_parent"]["symbol_id"] if r.get("_parent") else None
    return [{c: r.get(c) for c in COLUMNS} for r in rows]


def python_symbols(path: str, code: str) -> list[dict]:
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError):
        return python_lines(path, code)
    lines, rows = code.split("\n"), []
    at = [0]
    for x in lines:
        at.append(at[-1] + len(x.encode("utf-8", "replace")) + 1)

    def add(kind, name, node, parent, **more):
        first = min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", ()))])
        row = dict.fromkeys(COLUMNS)
        row |= {"file_path": path, "language": "python", "kind": kind, "name": name, "_parent": parent, "start_row": first - 1, "end_row": node.end_lineno - 1, "decl_end_row": node.end_lineno - 1, "start_byte": at[first - 1] + (node.col_offset if first == node.lineno else 0), "end_byte": at[node.end_lineno - 1] + node.end_col_offset, "is_error": False}
        row |= {"content": "\n".join(lines[first - 1 : node.end_lineno]), **more}
        row["declaration"] = row.get("declaration") or ast.get_source_segment(code, node)
        rows.append(row)
        return row

    def header(node) -> tuple[str, int]:
        """A definition's text up to its colon, and the row where that ends."""
        stop = node.body[0].lineno if not isinstance(node.body, ast.AST) else node.end_lineno
        text = "\n".join(lines[node.lineno - 1 : max(stop, node.lineno)]).lstrip()
        n = 0
        for k, ch in enumerate(text):
            n += (ch in "([{") - (ch in ")]}")
            if ch == ":" and n == 0:
                text = text[:k].rstrip()
                break
        return text, node.lineno - 1 + text.count("\n")

    def visit(node, parent, in_class):
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef):
                text, end = header(child)
                a = child.args
                args = [{"name": x.arg, "type": ast.unparse(x.annotation) if x.annotation else None} for x in [*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else [])]]
                row = add("function", child.name, child, parent, declaration=text, decl_end_row=end, args=args, return_type=ast.unparse(child.returns) if child.returns else None)
                visit(child, row, False)
            elif isinstance(child, ast.ClassDef):
                text, end = header(child)
                row = add("struct", child.name, child, parent, declaration=text, decl_end_row=end, class_type="Class", bases=[ast.unparse(b) for b in child.bases])
                visit(child, row, True)
            elif isinstance(child, ast.Lambda):
                visit(child, add("function", "", child, parent, args=[{"name": x.arg, "type": None} for x in child.args.args]), False)
            elif isinstance(child, ast.Import | ast.ImportFrom):
                base = ["." * child.level + (child.module or "")] if isinstance(child, ast.ImportFrom) else []
                for n in child.names:
                    parts = [p for x in [*base, n.name] for p in (x.split(".") if not x.startswith(".") else [x])]
                    add("import", n.name, child, parent, path_components=parts, alias=n.asname, import_type=import_type("python", parts, "from ." if isinstance(child, ast.ImportFrom) and child.level else ""))
            elif isinstance(child, ast.Assign | ast.AnnAssign | ast.AugAssign):
                targets = child.targets if isinstance(child, ast.Assign) else [child.target]
                kind = ast.unparse(child.annotation) if isinstance(child, ast.AnnAssign) else None
                for t in targets:
                    if isinstance(t, ast.Name):
                        add("field" if in_class else "variable", t.id, child, parent, type_name=kind)
                    elif isinstance(t, ast.Attribute):
                        add("variable", t.attr, child, parent, type_name=kind)
                visit(child, parent, False)
            elif isinstance(child, ast.Expr) and isinstance(child.value, ast.Constant) and isinstance(child.value.value, str):
                add("comment", "", child, parent)
            else:
                if isinstance(child, ast.Call):
                    f = child.func
                    name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else ""
                    if name:
                        add("call", name, child, parent)
                visit(child, parent, in_class and isinstance(child, ast.If | ast.Try | ast.With))

    visit(tree, None, False)
    import io
    import tokenize

    try:
        for t in tokenize.generate_tokens(io.StringIO(code).readline):
            if t.type == tokenize.COMMENT:
                row = dict.fromkeys(COLUMNS)
                rows.append(row | {"file_path": path, "language": "python", "kind": "comment", "name": "", "_parent": None, "start_row": t.start[0] - 1, "end_row": t.end[0] - 1, "decl_end_row": t.end[0] - 1, "start_byte": at[t.start[0] - 1] + t.start[1], "end_byte": at[t.end[0] - 1] + t.end[1], "is_error": False, "content": lines[t.start[0] - 1], "declaration": t.string})
    except (tokenize.TokenError, IndentationError):
        pass
    return identified(rows)


def python_lines(path: str, code: str) -> list[dict]:
    """Definitions and calls of a file that does not parse, read by indentation; calls are marked as errors."""
    lines, rows, open_ = code.split("\n"), [], []
    for k, line in enumerate(lines):
        if not line.strip():
            continue
        indent = len(line) - len(line.lstrip())
        while open_ and open_[-1][0] >= indent:
            open_.pop()
        parent = open_[-1][1] if open_ else None
        base = {"file_path": path, "language": "python", "start_row": k, "end_row": k, "decl_end_row": k, "start_byte": 0, "end_byte": 0, "_parent": parent, "content": line, "is_error": True}
        m = re.match(r"\s*(?:async\s+)?(def|class)\s+(\w+)([^:]*)", line)
        if m:
            row = dict.fromkeys(COLUMNS) | base | {"kind": "function" if m[1] == "def" else "struct", "name": m[2], "declaration": line.strip().rstrip(":"), "class_type": None if m[1] == "def" else "Class"}
            rows.append(row)
            open_.append((indent, row))
        for _, row in open_:
            row["end_row"] = k
        for c in re.finditer(r"(\w+)\s*\(", line if not m else ""):
            if c[1] not in KEYWORDS and c[1] not in ("and", "or", "not", "lambda", "assert", "elif"):
                rows.append(dict.fromkeys(COLUMNS) | base | {"kind": "call", "name": c[1], "declaration": c[1]})
    for r in rows:
        if r["kind"] != "call":
            r["content"] = "\n".join(lines[r["start_row"] : r["end_row"] + 1])
    return identified(rows)


def symbols_of(path: str, language: str, code: str) -> list[dict]:
    """The symbols of one file; none for an unknown language."""
    if language == "python":
        return python_symbols(path, code)
    if language not in STRUCT_WORDS:
        return []
    return BraceWalk(path, language, code).run()


def extract(files: DataFrame) -> DataFrame:
    """SYMBOLS of all files (path, content, language). A file that breaks the extractor gives one row of kind `error`."""

    def run(frames):
        import pandas as pd

        for pdf in frames:
            rows = []
            for path, code, language in zip(pdf["path"], pdf["content"], pdf["language"], strict=True):
                try:
                    rows += symbols_of(path, language, code or "")
                except Exception as e:
                    rows.append(dict.fromkeys(COLUMNS) | {"file_path": path, "language": language, "kind": "error", "name": type(e).__name__, "is_error": True, "declaration": str(e)[:200]})
            yield pd.DataFrame(rows, columns=COLUMNS)

    lang = F.when(F.col("language") == "unknown", F.when(F.col("path").rlike(r"\.(?:inl|inc|tpp|tpl)$"), "cpp").otherwise("unknown")).otherwise(F.col("language"))
    return files.select("path", "content", lang.alias("language")).mapInPandas(run, SYMBOLS)


def functions_of(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """The functions table. A signature is `name()` where the declaration spans other lines than the whole."""
    ns = files.select(F.col("path").alias("file_path"), namespace(F.col("content"), F.col("language")).alias("namespace"))
    f = symbols.where("kind = 'function'").join(ns, "file_path")
    out = f.select("name", "file_path", (F.col("start_row") + 1).alias("line_start"), (F.col("end_row") + 1).alias("line_end"), "namespace", "language", F.when(F.col("decl_end_row") != F.col("end_row"), F.concat("name", F.lit("()"))).otherwise(F.col("name")).alias("signature"))
    return out.withColumn("id", stable_id(F.col("file_path"), F.col("line_start"), F.col("line_end"), F.col("name"))).dropDuplicates(["id"])


def classes_of(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """The classes table with its member functions (ids of the functions table) and variables."""
    ns = files.select(F.col("path").alias("file_path"), namespace(F.col("content"), F.col("language")).alias("namespace"))
    members = symbols.where("parent_id is not null and kind in ('function', 'field')").groupBy(F.col("parent_id").alias("symbol_id")).agg(
        F.array_sort(F.collect_list(F.when(F.col("kind") == "function", stable_id(F.col("file_path"), F.col("start_row") + 1, F.col("end_row") + 1, F.col("name"))))).alias("member_functions"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "field", F.col("name")))).alias("member_variables"),
    )
    c = symbols.where("kind = 'struct'").join(ns, "file_path").join(members, "symbol_id", "left")
    none = F.array().cast("array<string>")
    bases = F.coalesce("bases", none)
    return c.select(
        F.col("symbol_id").alias("id"), "name", "file_path", (F.col("start_row") + 1).alias("line_start"), (F.col("end_row") + 1).alias("line_end"), "namespace", "language", "class_type",
        F.get(bases, 0).alias("parent_class"), F.slice(bases, 2, F.greatest(F.size(bases) - 1, F.lit(0))).alias("implemented_interfaces"), F.coalesce("member_functions", none).alias("member_functions"), F.coalesce("member_variables", none).alias("member_variables"),
    )


def call_sites(symbols: DataFrame) -> DataFrame:
    """file_path, line (from 1) and callee_name of every call symbol."""
    return symbols.where("kind = 'call' and name <> ''").select("file_path", (F.col("start_row") + 1).alias("line"), F.col("name").alias("callee_name"))


def chunks_of(symbols: DataFrame, least: int = 16) -> DataFrame:
    """Chunks of functions and structs with enough text; snippet_id is path#line#symbol."""
    s = symbols.where("kind in ('function', 'struct')").where(long_enough(F.col("content"), least))
    line = F.col("start_row") + 1
    return s.select(F.concat_ws("#", "file_path", line.cast("string"), "name").alias("snippet_id"), "file_path", "content", F.col("name").alias("symbol_name"), F.when(F.col("kind") == "function", "FunctionDeclaration").otherwise("StructDeclaration").alias("symbol_type"), "language", line.alias("line_start"), (F.col("end_row") + 1).alias("line_end"))


def entity_edges(classes: DataFrame, symbols: DataFrame) -> DataFrame:
    """source, target, edge_type: Contains, DefinesIn, Inherits, Implements and Imports; targets of the last three are names."""
    contains = classes.select(F.col("id").alias("source"), F.explode("member_functions").alias("target"), F.lit("Contains").alias("edge_type"))
    defines = classes.select(F.col("id").alias("source"), F.col("file_path").alias("target"), F.lit("DefinesIn").alias("edge_type"))
    inherits = classes.where("parent_class is not null").select(F.col("id").alias("source"), F.col("parent_class").alias("target"), F.lit("Inherits").alias("edge_type"))
    implements = classes.select(F.col("id").alias("source"), F.explode("implemented_interfaces").alias("target"), F.lit("Implements").alias("edge_type"))
    imports = symbols.where("kind = 'import'").select(F.col("file_path").alias("source"), F.array_join("path_components", ".").alias("target"), F.lit("Imports").alias("edge_type"))
    return contains.unionByName(defines).unionByName(inherits).unionByName(implements).unionByName(imports)
