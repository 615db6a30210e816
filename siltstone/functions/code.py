"""The structure of source files: one scanner that knows strings, comments and nesting, and what definitions, imports and calls stand in the code that is left."""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from typing import NamedTuple

#: Languages by the end of a file's name.
LANGUAGES = {"py": "python", "ts": "script", "tsx": "script", "mts": "script", "cts": "script", "js": "script", "jsx": "script", "mjs": "script", "cjs": "script", "go": "go", "rs": "rust"}
#: Scores of constructs as places to cut at. Fixed values.
SCORES = {"class": 100, "interface": 100, "struct": 100, "trait": 100, "impl": 100, "mod": 100, "export": 90, "function": 90, "method": 90, "decorated": 90, "type": 80, "enum": 80, "import": 60}

_STRING = r'"(?:\\.|[^"\\\n])*"?'
_COMMENT = r"//[^\n]*"
#: What may begin something that is no code.
_NOISE = {
    "script": re.compile(rf"{_COMMENT}|/\*|`|{_STRING}|'(?:\\.|[^'\\\n])*'?|/(?![/*])", re.S),
    "go": re.compile(rf"{_COMMENT}|/\*|`|{_STRING}|'(?:\\.|[^'\\\n])+'", re.S),
    "rust": re.compile(rf'{_COMMENT}|/\*|b?r#*"|b?"|b?\'(?:\\[^\n]|[^\\\'\n])[^\'\n]{{0,8}}?\'', re.S),
    "python": re.compile(r"#[^\n]*|[rRbBuUfF]{0,2}(?:'''|\"\"\"|'(?:\\.|[^'\\\n])*'?|\"(?:\\.|[^\"\\\n])*\"?)", re.S),
}
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
#: Words after which a slash begins a regular expression; other words are values, which it divides.
_BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "yield", "await"}


def language(path: str) -> str | None:
    return LANGUAGES.get(path.rsplit(".", 1)[-1].lower()) if "." in path else None


def _template_end(text: str, at: int) -> int:
    """After a template string that begins at `at`: its code parts may hold strings and templates of their own."""
    i = at + 1
    while i < len(text):
        c = text[i]
        if c == "\\":
            i += 2
        elif c == "`":
            return i + 1
        elif text.startswith("${", i):
            depth, i = 1, i + 2
            while i < len(text) and depth:
                c = text[i]
                if c == "`":
                    i = _template_end(text, i)
                    continue
                if c in "\"'":
                    i = _NOISE["script"].match(text, i).end()
                    continue
                depth += (c == "{") - (c == "}")
                i += 1
        else:
            i += 1
    return len(text)


def _block_end(text: str, at: int, nested: bool) -> int:
    """After a block comment that begins at `at`."""
    if not nested:
        end = text.find("*/", at + 2)
        return len(text) if end < 0 else end + 2
    depth = 0
    for m in re.compile(r"/\*|\*/").finditer(text, at):
        depth += 1 if m[0] == "/*" else -1
        if not depth:
            return m.end()
    return len(text)


def _noise_end(text: str, m: re.Match, lang: str) -> int | None:
    """Where what begins with a match ends; None if it is code after all."""
    head, at = m[0], m.start()
    if head.startswith("/*"):
        return _block_end(text, at, lang == "rust")
    if head == "`":
        if lang == "script":
            return _template_end(text, at)
        end = text.find("`", at + 1)
        return len(text) if end < 0 else end + 1
    if head == "/":
        before = text[max(0, at - 200) : at].rstrip()
        word = re.search(r"[\w$]+$", before)
        value = (word and word[0] not in _BEFORE_REGEX) or before[-1:] in (")", "]", "}")
        found = None if value else _REGEX.match(text, at)
        return found.end() if found else None
    if lang == "rust" and head[-1] == '"':
        if "r" in head:
            close = '"' + "#" * head.count("#")
            end = text.find(close, m.end())
            return len(text) if end < 0 else end + len(close)
        end = re.compile(r'(?:\\.|[^"\\])*"', re.S).match(text, m.end())
        return end.end() if end else len(text)
    if lang == "python" and head[-3:] in ("'''", '"""') and not head.endswith(("\\'''", '\\"""')):
        end = re.compile(r"(?:\\.|(?!%s).)*(?:%s)?" % (head[-3:], head[-3:]), re.S).match(text, m.end())
        return end.end()
    return m.end()


def mask(text: str, lang: str) -> str:
    """text with blanks for all that is in strings, comments and regular expressions; lines and places stay."""
    out, at, pattern = [], 0, _NOISE[lang]
    while (m := pattern.search(text, at)) is not None:
        end = _noise_end(text, m, lang)
        if end is None:
            out.append(text[at : m.end()])
            at = m.end()
            continue
        out += [text[at : m.start()], re.sub(r"[^\n]", " ", text[m.start() : end])]
        at = end
    out.append(text[at:])
    return "".join(out)


class Construct(NamedTuple):
    at: int
    kind: str
    name: str
    line: int


_NAME = r"[A-Za-z_$][\w$]*"
_DEFS = {
    "script": [
        ("import", re.compile(r"import\b(?!\s*[(.])")),
        ("export", re.compile(r"export\b")),
        ("class", re.compile(rf"(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?class\s+(?P<name>{_NAME})")),
        ("interface", re.compile(rf"(?:export\s+)?(?:default\s+)?(?:declare\s+)?interface\s+(?P<name>{_NAME})")),
        ("type", re.compile(rf"(?:export\s+)?(?:declare\s+)?type\s+(?P<name>{_NAME})\s*(?:<[^=]*>)?\s*=")),
        ("enum", re.compile(rf"(?:export\s+)?(?:declare\s+)?(?:const\s+)?enum\s+(?P<name>{_NAME})")),
        ("function", re.compile(rf"(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:async\s+)?function\s*\*?\s*(?P<name>{_NAME})")),
        ("function", re.compile(rf"(?:export\s+)?(?:const|let)\s+(?P<name>{_NAME})\s*(?::[^=\n]+)?=\s*(?:async\s+)?(?:function\b|{_NAME}\s*=>|\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^=\n]+)?=>)")),
    ],
    "go": [
        ("import", re.compile(r"import\b")),
        ("type", re.compile(rf"type\s+(?P<name>{_NAME})")),
        ("type", re.compile(r"type\s*\(")),
        ("method", re.compile(rf"func\s*\([^)]*\)\s*(?P<name>{_NAME})")),
        ("function", re.compile(rf"func\s+(?P<name>{_NAME})")),
    ],
    "rust": [
        ("import", re.compile(r"(?:pub(?:\([^)]*\))?\s+)?use\b")),
        *[(kind, re.compile(rf"(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?{word}\s+(?P<name>{_NAME})")) for kind, word in (("struct", "struct"), ("trait", "trait"), ("enum", "enum"), ("type", "type"), ("mod", "mod"))],
        ("impl", re.compile(rf"(?:unsafe\s+)?impl\b(?:\s*<[^{{;]*?>)?\s*(?:[\w:<>,\s&']+\s+for\s+)?(?P<name>{_NAME})")),
        ("function", re.compile(rf"(?:pub(?:\([^)]*\))?\s+)?(?:default\s+)?(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?(?:extern\s+)?fn\s+(?P<name>{_NAME})")),
    ],
    "python": [
        ("import", re.compile(r"(?:import|from)\b")),
        ("class", re.compile(rf"class\s+(?P<name>{_NAME})")),
        ("function", re.compile(rf"(?:async\s+)?def\s+(?P<name>{_NAME})")),
    ],
}
_METHOD = re.compile(rf"(?:(?:public|private|protected|static|async|readonly|override|get|set|declare|abstract)\s+)*\*?\s*(?P<name>#?{_NAME})\s*(?:<[^(]*>)?\(")
_NO_METHOD = {"if", "for", "while", "switch", "catch", "return", "function", "await", "with", "super", "new", "throw", "typeof"}
_CLOSE = {"(": ")", "[": "]", "{": "}"}


def _closed(code: str, at: int) -> int:
    """After the bracket that closes the one at `at`."""
    depth = 0
    for m in re.compile(r"[(\[{}\])]").finditer(code, at):
        depth += 1 if m[0] in _CLOSE else -1
        if not depth:
            return m.end()
    return len(code)


def constructs(text: str, path: str) -> list[Construct]:
    """Definitions and imports of a file in order, by the start of the line they stand on; a file in no known language has none."""
    lang = language(path)
    if lang is None:
        return []
    if lang == "python" and (found := _python(text)) is not None:
        return found
    code = mask(text, lang)
    starts = [0, *(m.end() for m in re.finditer("\n", code))]
    out, bodies, depth = [], [], 0
    for number, start in enumerate(starts, 1):
        line_end = starts[number] - 1 if number < len(starts) else len(code)
        line = code[start:line_end]
        at = start + len(line) - len(line.lstrip())
        bodies = [b for b in bodies if at < b[1]]
        for kind, pattern in _DEFS[lang] if line.strip() else []:
            m = pattern.match(code, at)
            if m is None or (kind in ("import", "export") and depth):
                continue
            name = m.groupdict().get("name") or ""
            out.append(Construct(at, kind, name, number))
            if kind == "class" and lang == "script" and (brace := code.find("{", m.end())) >= 0:
                bodies.append((depth + 1, _closed(code, brace)))
        if lang == "script" and bodies and depth == bodies[-1][0] and (m := _METHOD.match(code, at)) and m["name"] not in _NO_METHOD:
            after = code[_closed(code, m.end() - 1) :]
            if re.match(r"\s*(?::[^;{]*)?\{", after):
                out.append(Construct(at, "method", m["name"], number))
        depth += sum(line.count(c) for c in _CLOSE) - sum(line.count(c) for c in _CLOSE.values())
    return out


def _python(text: str) -> list[Construct] | None:
    """By Python's own parser; None where it doesn't parse."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    out = []
    for node in ast.walk(tree):
        kind = {ast.ClassDef: "class", ast.FunctionDef: "function", ast.AsyncFunctionDef: "function", ast.Import: "import", ast.ImportFrom: "import"}.get(type(node))
        if kind:
            line = min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))])
            out.append(Construct(starts[line - 1], kind, getattr(node, "name", ""), line))
    return sorted(out)


def breaks(text: str, path: str) -> dict[int, int]:
    """Places to cut a file at, before its constructs, with their scores; of several at one place the best counts."""
    out: dict[int, int] = {}
    for c in constructs(text, path):
        at = max(0, text.rfind("\n", 0, c.at + 1 if text[c.at : c.at + 1] != "\n" else c.at))
        out[at] = max(SCORES[c.kind], out.get(at, 0))
    return out


def symbols(text: str, path: str) -> list[tuple[str, str, int]]:
    """(name, kind, line) of what a file defines."""
    return [(c.name, c.kind, c.line) for c in constructs(text, path) if c.name and c.kind not in ("import", "export", "impl")]


class Relation(NamedTuple):
    kind: str
    source: str | None
    ref: str
    target: str | None
    line: int


def relations(text: str, path: str) -> list[Relation]:
    """What a file imports, extends, implements and calls of what it imports."""
    lang = language(path)
    if lang is None:
        return []
    code = mask(text, lang)
    starts = [0, *(m.end() for m in re.finditer("\n", code))]
    line = lambda at: bisect_right(starts, at)
    out: list[Relation] = []
    if lang == "script":
        for m in re.finditer(r"(?m)^[ \t]*import\s+(?:type\s+)?(?P<what>[^;()]*?)\s*\bfrom\b", code):
            ref = re.compile(r"\s*[\"']([^\"'\n]*)[\"']").match(text, m.end())
            if ref is None:
                continue
            what, braced = m["what"], re.search(r"\{([^}]*)\}", m["what"])
            names = [n.group(1) for n in [re.match(rf"\s*(?:type\s+)?({_NAME})\s*(?:,|$)", what)] if n]
            names += [x.strip().removeprefix("type ").split(" as ")[0].strip() for x in (braced[1].split(",") if braced else []) if x.strip()]
            out += [Relation("imports", None, ref[1], n, line(m.start())) for n in names]
        for m in re.finditer(rf"\bclass\s+(?P<name>{_NAME})(?:\s*<[^{{]*?>)?(?:\s+extends\s+(?P<base>[\w$.]+)(?:<[^{{]*?>)?)?(?:\s+implements\s+(?P<faces>[^{{]+))?\s*\{{", code):
            if m["base"]:
                out.append(Relation("extends", m["name"], m["base"], None, line(m.start())))
            for face in re.sub(r"<[^<>]*>", "", m["faces"] or "").split(","):
                if re.fullmatch(rf"\s*{_NAME}\s*", face):
                    out.append(Relation("implements", m["name"], face.strip(), None, line(m.start())))
    elif lang == "python":
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return []
        for node in ast.walk(tree):
            if isinstance(node, ast.ImportFrom):
                out += [Relation("imports", None, "." * node.level + (node.module or ""), a.name, node.lineno) for a in node.names]
            elif isinstance(node, ast.Import):
                out += [Relation("imports", None, a.name, a.name.split(".")[0], node.lineno) for a in node.names]
            elif isinstance(node, ast.ClassDef):
                out += [Relation("extends", node.name, ast.unparse(b), None, node.lineno) for b in node.bases]
        known = {r.target for r in out if r.kind == "imports"}
        out += [Relation("calls", None, node.func.id, node.func.id, node.lineno) for node in ast.walk(tree) if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in known]
        return sorted(out, key=lambda r: (r.line, r.kind, r.ref, r.target or ""))
    elif lang == "go":
        for m in re.finditer(r"(?m)^import\b", code):
            many = re.compile(r"\s*\(").match(text, m.end())
            end = _closed(code, many.end() - 1) if many else code.find("\n", m.end())
            for ref in re.finditer(r"\"([^\"\n]+)\"", text[m.end() : end if end >= 0 else len(text)]):
                at = m.end() + ref.start()
                if not re.search(r"//", text[text.rfind("\n", 0, at) + 1 : at]):
                    out.append(Relation("imports", None, ref[1], ref[1].split("/")[-1], line(at)))
    elif lang == "rust":
        for m in re.finditer(r"(?m)^[ \t]*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+);", code):
            for ref in _uses(re.sub(r"\s+", " ", m[1]).strip()):
                out.append(Relation("imports", None, ref, ref.split("::")[-1], line(m.start())))
    known = {r.target for r in out if r.kind == "imports"}
    defined = {c.at for c in constructs(text, path)}
    for m in re.finditer(rf"(?<![\w$.])(?P<of>{_NAME})(?:(?:\.|::)(?P<part>{_NAME}))?\s*\(", code):
        if m["of"] in known and m.start() not in defined and not re.search(r"(?:function|func|fn|class)\s+$", code[max(0, m.start() - 12) : m.start()]):
            out.append(Relation("calls", None, m["of"], m["part"] or m["of"], line(m.start())))
    return sorted(out, key=lambda r: (r.line, r.kind, r.ref, r.target or ""))


def _uses(tree: str) -> list[str]:
    """Paths of a use declaration; groups in braces are taken apart."""
    m = re.match(r"([^{]*)\{(.*)\}$", tree)
    if not m:
        return [tree.split(" as ")[0].strip()] if tree else []
    parts, depth, at = [], 0, 0
    for i, c in enumerate(m[2]):
        depth += (c == "{") - (c == "}")
        if c == "," and not depth:
            parts.append(m[2][at:i])
            at = i + 1
    return [(m[1].strip() + p).removesuffix("::self") for part in [*parts, m[2][at:]] for p in _uses(part.strip())]
