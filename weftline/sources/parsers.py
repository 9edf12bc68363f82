"""Symbols and raw references of source files, a function a language.

Each parser takes (path, text, context) and returns rows of NODE: one for the
module where the language has one, and one a symbol. Files are independent of
each other; `parse` runs them as a table function over (path, language, text).
"""

from __future__ import annotations

import ast
import posixpath
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from weftline.functions.constants import DECLARED_NAMES
from weftline.plans.workspace import ship
from weftline.sources.masking import Source, split_top

_LISTS = ("annotations", "decorators", "params", "declared", "calls", "bases", "imports", "strings", "star_exports")
_MAPS = ("import_modules", "import_symbols", "member_types", "member_qualifiers", "exports")
_TEXTS = ("node", "module", "qualname", "kind", "file", "language", "class_context", "package", "bean", "error")
NODE = (
    ", ".join(f"{c} string" for c in _TEXTS)
    + ", start_line int, end_line int, is_abstract boolean, is_primary boolean, exported boolean, "
    + ", ".join(f"{c} array<string>" for c in _LISTS)
    + ", "
    + ", ".join(f"{c} map<string,string>" for c in _MAPS)
)


def row(path: str, language: str, module: str, qualname: str, kind: str, lines: tuple[int, int], **more) -> dict:
    out = {c: None for c in _TEXTS} | {c: [] for c in _LISTS} | {c: {} for c in _MAPS} | {"is_abstract": False, "is_primary": False, "exported": False}
    out |= {"node": f"{module}:{qualname}", "module": module, "qualname": qualname, "kind": kind, "file": path, "language": language, "start_line": lines[0], "end_line": lines[1]}
    for k, v in more.items():
        out[k] = list(dict.fromkeys(v)) if k in ("params", "decorators", "declared", "star_exports", "annotations") else sorted(set(v)) if k in _LISTS else v
    return out


def group_name(path: str, language: str, package: str = "") -> str:
    """language.package, else language.directory."""
    folder = posixpath.dirname(path)
    return ".".join(x for x in (language, package or folder.replace("/", ".")) if x)


def dotted_strings(text: str, known: set[str]) -> set[str]:
    """Quoted dotted names of two to eight parts that are not known as imports."""
    return {s for s in re.findall(r"""["']([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+)["']""", text) if s.count(".") < 8} - known


# Python


class _Scope(ast.NodeVisitor):
    """Calls, imports and dotted strings of statements, without the definitions among them."""

    def __init__(self, module: str):
        self.module, self.calls, self.modules, self.symbols, self.strings = module, set(), {}, {}, set()

    def _skip(self, node: ast.AST) -> None:
        pass

    visit_FunctionDef = visit_AsyncFunctionDef = visit_ClassDef = _skip

    def visit_Call(self, node: ast.Call) -> None:
        if name := dotted_name(node.func):
            self.calls.add(name)
        self.generic_visit(node)

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self.modules[a.asname or a.name.split(".")[0]] = a.name if a.asname else a.name.split(".")[0]

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        base = relative_module(self.module, node.level, node.module or "")
        for a in node.names:
            if a.name != "*":
                self.symbols[a.asname or a.name] = f"{base}.{a.name}" if base else a.name

    def visit_Constant(self, node: ast.Constant) -> None:
        if isinstance(node.value, str) and re.fullmatch(r"[A-Za-z_]\w*(\.[A-Za-z_]\w*)+", node.value):
            self.strings.add(node.value)


def relative_module(module: str, level: int, name: str) -> str:
    """The absolute module of an import with `level` leading dots."""
    parts = module.split(".")[: max(0, module.count(".") + 1 - level)] if level else []
    return ".".join([*parts, *([name] if name else [])])


def dotted_name(node: ast.AST) -> str:
    """The dotted name of an expression; `super()` keeps its call."""
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        head = dotted_name(node.value)
        return f"{head}.{node.attr}" if head else node.attr
    if isinstance(node, ast.Call):
        head = dotted_name(node.func)
        return "super()" if head == "super" else head
    if isinstance(node, ast.Subscript):
        return dotted_name(node.value)
    return ""


def _scope(module: str, statements: list[ast.stmt]) -> _Scope:
    s = _Scope(module)
    for x in statements:
        s.visit(x)
    return s


def parse_python(path: str, text: str, context: dict) -> list[dict]:
    """Classes and functions; nested functions too where context["nested"] is set. The module itself only if it holds dotted strings."""
    module = re.sub(r"(^|\.)__init__$", "", re.sub(r"\.py$", "", path).replace("/", "."))
    tree = ast.parse(text)
    top = _Scope(module)
    for x in tree.body:
        if isinstance(x, (ast.Import, ast.ImportFrom)):
            top.visit(x)
    out: list[dict] = []

    def add(kind: str, node: ast.AST, qualname: str, context_class: str | None, modules: dict, symbols: dict, **more) -> tuple[dict, dict]:
        own = _scope(module, node.body)
        modules, symbols = modules | own.modules, symbols | own.symbols
        known = own.calls | set(modules) | set(modules.values()) | set(symbols) | set(symbols.values())
        out.append(
            row(path, "python", module, qualname, kind, (node.lineno, node.end_lineno or node.lineno), class_context=context_class, calls=own.calls, strings=own.strings - known, import_modules=modules, import_symbols=symbols, exported=not node.name.startswith("_"), **more)
        )
        return modules, symbols

    def walk(body: list[ast.stmt], prefix: str, context_class: str | None, modules: dict, symbols: dict) -> None:
        for x in body:
            qualname = f"{prefix}.{x.name}" if prefix and hasattr(x, "name") else getattr(x, "name", "")
            if isinstance(x, ast.ClassDef):
                add("class", x, qualname, qualname, modules, symbols, bases=filter(None, map(dotted_name, x.bases)))
                walk(x.body, qualname, qualname, modules, symbols)
            elif isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
                a = x.args
                params = [p.arg for p in (*a.posonlyargs, *a.args, *filter(None, [a.vararg]), *a.kwonlyargs, *filter(None, [a.kwarg]))]
                kind = "function" if isinstance(x, ast.FunctionDef) else "async_function"
                inner = add(kind, x, qualname, context_class, modules, symbols, params=params, decorators=filter(None, map(dotted_name, x.decorator_list)))
                if context.get("nested"):
                    walk(x.body, qualname, context_class, *inner)

    walk(tree.body, "", None, top.modules, top.symbols)
    loose = _scope(module, tree.body)
    known = loose.calls | set(top.modules.values()) | set(top.symbols.values())
    if loose.strings - known:
        last = max(1, len(text.splitlines()))
        out.append(row(path, "python", module, "__module__", "module", (1, last), strings=loose.strings - known, import_modules=top.modules, import_symbols=top.symbols))
    return out


# JavaScript and TypeScript

_NAME = r"[A-Za-z_$][\w$]*"
_JS_WORDS = {"if", "for", "while", "switch", "catch", "function", "return", "typeof", "new", "await", "super", "import", "require", "constructor", "delete", "void", "with", "do", "else", "in", "of", "instanceof", "yield", "async"}
_PLAIN_TYPES = {"string", "number", "boolean", "any", "void", "never", "unknown", "object", "null", "undefined", "int", "long", "double", "float", "char", "byte", "short", "String", "Integer", "Long", "Double", "Boolean", "Object", "var", "bool", "bigint", "symbol"}


def clean_type(text: str) -> str:
    """The class that a type names: no generics, arrays, unions or modifiers; nothing for a plain type."""
    text = re.sub(r"@\w+(\([^)]*\))?", " ", text).strip()
    if made := re.match(rf"new\s+({_NAME}(?:\.{_NAME})*)", text):
        return made.group(1)
    text = re.sub(r"<.*", "", text.split("|")[0].split("&")[0]).replace("[]", "").replace("?", "").strip()
    last = text.split()[-1] if text.split() else ""
    return last if re.fullmatch(rf"{_NAME}(\.{_NAME})*", last) and last not in _PLAIN_TYPES else ""


def calls_of(plain: str, skip: set[str]) -> set[str]:
    """Callees, `a`, `a.b` or `this.a.b`, constructors, and elements with a capital, in blanked text."""
    found = set()
    for m in re.finditer(rf"(?<![\w$.])((?:this\.|super\.|self\.)?{_NAME}(?:\.{_NAME})?)\s*(?:<[\w\s,.<>]*>)?\(", plain):
        name = m.group(1)
        before = plain[max(0, m.start() - 12) : m.start()]
        if name.split(".")[0] not in skip - {"super", "this", "self"} and not re.search(r"\bfunction\s*\*?\s*$", before):
            found.add(name)
    found |= {m.group(1) for m in re.finditer(rf"\bnew\s+({_NAME}(?:\.{_NAME})*)", plain)}
    return found - skip


def _js_params(text: str) -> list[str]:
    out = []
    for p in split_top(text):
        m = re.match(rf"(?:(?:public|private|protected|readonly)\s+)*(?:\.\.\.)?({_NAME})", re.sub(r"@\w+(\([^)]*\))?\s*", "", p))
        if m:
            out.append(m.group(1))
    return out


def _js_bindings(clause: str, spec: str, modules: dict, symbols: dict) -> None:
    if m := re.match(rf"(?:type\s+)?({_NAME})\s*(?:,|$)", clause):
        symbols[m.group(1)] = f"{spec}#default"
    if m := re.search(rf"\*\s+as\s+({_NAME})", clause):
        modules[m.group(1)] = spec
    if m := re.search(r"\{([^}]*)\}", clause):
        for original, alias in _aliases(m.group(1)):
            symbols[alias] = f"{spec}#{original}"


def _aliases(names: str) -> Iterator[tuple[str, str]]:
    for item in names.split(","):
        parts = re.split(r"\s+as\s+", re.sub(r"^type\s+", "", item.strip()))
        if parts[0]:
            yield parts[0], parts[-1]


def _js_members(src: Source, start: int, end: int) -> dict[str, str]:
    """Types of a class's members: typed or constructed fields, constructor properties, and what the constructor assigns."""
    level = src.depth[start] + 1
    out: dict[str, str] = {}
    for m in re.finditer(rf"(?:^|[;{{}}\n])\s*(?:(?:public|private|protected|readonly|static|declare|override)\s+)*#?({_NAME})\s*[?!]?\s*:\s*([^=;{{}}()\n]+)", src.plain[start:end]):
        if src.depth[start + m.start(1)] == level and (kind := clean_type(m.group(2))):
            out[m.group(1)] = kind
    for m in re.finditer(rf"(?:^|[;{{}}\n])\s*(?:(?:public|private|protected|readonly|static)\s+)*#?({_NAME})\s*(?::[^=;\n]+)?=\s*(new\s+{_NAME}(?:\.{_NAME})*)", src.plain[start:end]):
        if src.depth[start + m.start(1)] == level:
            out.setdefault(m.group(1), clean_type(m.group(2)))
    typed: dict[str, str] = {}
    if m := re.search(r"\bconstructor\s*\(", src.plain[start:end]):
        stop = src.parenthesis(start + m.end() - 1)
        for p in split_top(src.plain[start + m.end() : stop]) if stop else []:
            if q := re.match(rf"((?:(?:public|private|protected|readonly)\s+)*)({_NAME})\s*\??\s*:\s*(.+)", p):
                if kind := clean_type(q.group(3)):
                    typed[q.group(2)] = kind
                    if q.group(1).strip():
                        out[q.group(2)] = kind
    for m in re.finditer(rf"\bthis\.({_NAME})\s*=\s*(new\s+{_NAME}(?:\.{_NAME})*(?=\s*\()|{_NAME}(?=\s*[;\n}}]))", src.plain[start:end]):
        value = clean_type(m.group(2)) if m.group(2).startswith("new") else typed.get(m.group(2), "")
        if value:
            out.setdefault(m.group(1), value)
    return out


def parse_js(path: str, text: str, context: dict, language: str = "javascript") -> list[dict]:
    """The module, and top-level classes, functions, arrow functions and methods."""
    src = Source(text)
    plain, module = src.plain, group_name(path, language)
    modules, symbols, exports, stars, imports = {}, {}, {}, [], set()

    quoted = r"""(?P<q>["'])(?P<s>[^"'\n]*)(?P=q)"""

    def spec(m: re.Match) -> str:
        return text[m.start("s") : m.end("s")]  # the blanked text has no strings

    for m in re.finditer(rf"(?m)^[ \t]*import\s+(?P<clause>[^;'\"]+?)\s+from\s+{quoted}", plain):
        imports.add(spec(m))
        _js_bindings(m.group("clause").strip(), spec(m), modules, symbols)
    for m in re.finditer(rf"(?m)^[ \t]*import\s+{quoted}", plain):
        imports.add(spec(m))
    for m in re.finditer(rf"(?m)^[ \t]*export\s+(?P<what>\*(?:\s+as\s+(?P<alias>{_NAME}))?|(?:type\s+)?\{{(?P<names>[^}}]*)\}})\s*from\s+{quoted}", plain):
        imports.add(spec(m))
        if m.group("alias"):
            exports[m.group("alias")] = spec(m)
        elif m.group("what").startswith("*"):
            stars.append(spec(m))
        else:
            exports |= {alias: f"{spec(m)}#{original}" for original, alias in _aliases(m.group("names"))}
    for m in re.finditer(rf"(?m)(?:\b(?:const|let|var)\s+(?:(?P<one>{_NAME})|\{{(?P<some>[^}}]*)\}})\s*=\s*)?\brequire\s*\(\s*{quoted}\s*\)", plain):
        imports.add(spec(m))
        if m.group("one"):
            symbols[m.group("one")] = f"{spec(m)}#default"
        for original, alias in _aliases((m.group("some") or "").replace(":", " as ")):
            symbols[alias] = f"{spec(m)}#{original}"
    for m in re.finditer(rf"\bimport\s*\(\s*{quoted}\s*\)", plain):
        imports.add(spec(m))

    out: list[dict] = []

    def add(kind: str, qualname: str, start: int, end: int, calls: set[str], context_class: str | None, **more) -> None:
        body = text[start:end]
        strings = dotted_strings(body, imports | set(modules.values()) | set(symbols.values()))
        out.append(
            row(path, language, module, qualname, kind, src.lines(start, end), class_context=context_class, calls=calls | set(re.findall(r"<([A-Z][\w$]*)(?=[\s/>])", src.plain[start:end])), strings=strings, import_modules=modules, import_symbols=symbols, **more)
        )

    names: list[str] = []
    for m in re.finditer(rf"\b(export\s+)?(default\s+)?(abstract\s+)?class\s+({_NAME})(?:\s*<[^{{]*?>)?(?:\s+extends\s+({_NAME}(?:\.{_NAME})*))?", plain):
        if src.depth[m.start()] or not (body := src.body(m.end())):
            continue
        name = m.group(4)
        names.append(name)
        a, b = body
        members = _js_members(src, a, b)
        level = src.depth[a] + 1
        top = "".join(c if src.depth[i] == level else " " for i, c in enumerate(plain[a:b], a))
        methods, spans = [], set()
        for k in re.finditer(rf"(?:^|[;{{}}\n])[ \t]*((?:(?:public|private|protected|static|async|readonly|override|get|set)\s+|\*\s*)*)(#?{_NAME})\s*(?:<[^>(]*>)?(\()", plain[a:b]):
            if src.depth[a + k.start(2)] != level or k.group(2) in _JS_WORDS - {"constructor"} or not (stop := src.parenthesis(a + k.start(3))):
                continue
            rest = re.match(r"\s*(?::\s*[^{;=]+?)?\s*\{", plain[stop + 1 : b + 1])
            if rest and (inner := src.body(stop + 1)):
                methods.append((k.group(2), a + k.start(2), inner, plain[a + k.end(3) : stop]))
        for k in re.finditer(rf"(?:^|[;{{}}\n])[ \t]*(?:(?:public|private|protected|static|readonly)\s+)*({_NAME})\s*(?::[^=;\n]+)?=\s*(?:async\s*)?(?:\(([^()]*)\)|({_NAME}))\s*(?::[^=;\n]+)?=>", plain[a:b]):
            if src.depth[a + k.start(1)] == level:
                inner = src.body(a + k.end()) or (a + k.end(), plain.find("\n", a + k.end()) if "\n" in plain[a + k.end() : b] else b)
                methods.append((k.group(1), a + k.start(1), inner, k.group(2) or k.group(3) or ""))
        declared = {x for x, *_ in methods}
        add("class", name, m.start(), b + 1, calls_of(top, _JS_WORDS) - declared, name, bases=[m.group(5)] if m.group(5) else [], member_types=members, is_abstract=bool(m.group(3)), exported=bool(m.group(1)))
        for method, start, inner, params in methods:
            span = (method, src.lines(start, inner[1] + 1))
            if span not in spans:
                spans.add(span)
                add("method", f"{name}.{method}", start, inner[1] + 1, calls_of(plain[inner[0] : inner[1]], _JS_WORDS), name, member_types=members, params=_js_params(params), exported=bool(m.group(1)))
    functions = rf"\b(export\s+)?(?:default\s+)?(async\s+)?function\s*\*?\s*({_NAME})\s*(?:<[^>(]*>)?(\()"
    for m in re.finditer(functions, plain):
        if src.depth[m.start()] == 0 and (stop := src.parenthesis(m.start(4))) and (body := src.body(stop)):
            names.append(m.group(3))
            kind = "async_function" if m.group(2) else "function"
            add(kind, m.group(3), m.start(), body[1] + 1, calls_of(plain[body[0] : body[1]], _JS_WORDS), None, params=_js_params(plain[m.end() : stop]), exported=bool(m.group(1)))
    for m in re.finditer(rf"(?m)^[ \t]*(export\s+)?(?:const|let|var)\s+({_NAME})\s*(?::[^=\n]+)?=\s*(async\s*)?(?:(\()|({_NAME})\s*=>)", plain):
        if src.depth[m.start(2)]:
            continue
        stop, params = m.end(), m.group(5) or ""
        if m.group(4):
            close = src.parenthesis(m.start(4))
            if close is None or not (arrow := re.match(r"\s*(?::[^=;\n]+)?=>", plain[close + 1 :])):
                continue
            params, stop = plain[m.end(4) : close], close + 1 + arrow.end()
        lead = re.match(r"\s*\{", plain[stop:])
        body = src.body(stop) if lead else None
        end = body[1] + 1 if body else (plain.find(";", stop) if ";" in plain[stop : plain.find("\n", stop) if "\n" in plain[stop:] else len(plain)] else (plain.find("\n", stop) if "\n" in plain[stop:] else len(plain)))
        names.append(m.group(2))
        add("async_function" if m.group(3) else "function", m.group(2), m.start(2), end, calls_of(plain[stop:end], _JS_WORDS), None, params=_js_params(params), exported=bool(m.group(1)))
    names += [m.group(1) for m in re.finditer(rf"(?m)^\s*(?:export\s+)?(?:declare\s+)?(?:interface|type|enum)\s+({_NAME})", plain)]
    bases = {r for x in out for r in x["bases"]}
    whole = row(path, language, module, posixpath.basename(path), "module", (1, src.last_line), declared=list(dict.fromkeys(names))[:DECLARED_NAMES], imports=imports, bases=bases, strings=dotted_strings(text, imports), import_modules=modules, import_symbols=symbols, exports=exports, star_exports=stars)
    return [whole, *out]


def parse_ts(path: str, text: str, context: dict) -> list[dict]:
    return parse_js(path, text, context, "typescript")


# Go and Rust: a module a file


def parse_go(path: str, text: str, context: dict) -> list[dict]:
    """One module; every double-quoted string counts as an import."""
    names = re.findall(r"(?m)^\s*func\s+(?:\([^)]+\)\s*)?([A-Za-z_]\w*)\s*\(", text) + re.findall(r"(?m)^\s*type\s+([A-Za-z_]\w*)\s+(?:struct|interface|map|chan|func|\[\])", text)
    imports = set(re.findall(r'"([^"]+)"', text))
    folder, root = posixpath.dirname(path), context.get("go_module", "")
    module = (f"{root}/{folder}" if folder else root) if root else group_name(path, "go")
    last = max(1, len(text.splitlines()))
    return [row(path, "go", module, posixpath.basename(path), "module", (1, last), declared=list(dict.fromkeys(names))[:DECLARED_NAMES], imports=imports, strings=dotted_strings(text, imports), import_modules={s.split("/")[-1]: s for s in sorted(imports)})]


def rust_uses(spec: str) -> list[str]:
    """The paths of a use declaration, one level of braces expanded."""
    spec = re.sub(r"\s+", "", spec)
    if "{" not in spec:
        return [spec]
    head, _, rest = spec.partition("{")
    head = head.removesuffix("::")
    return [head if item == "self" else f"{head}::{item}".removeprefix("::") for item in rest.rpartition("}")[0].split(",") if item]


def rust_path(path: str) -> str:
    """The module path of a file: crate for main.rs and lib.rs, directories for mod.rs."""
    tail = path.removeprefix("src/")
    if tail in ("lib.rs", "main.rs"):
        return "crate"
    tail = tail.removesuffix("/mod.rs") if tail.endswith("/mod.rs") else tail.removesuffix(".rs")
    return "::".join(["crate", *(p for p in tail.split("/") if p)])


def parse_rust(path: str, text: str, context: dict) -> list[dict]:
    names = re.findall(r"(?m)^\s*(?:pub\s+)?fn\s+([A-Za-z_]\w*)\s*\(", text) + re.findall(r"(?m)^\s*(?:pub\s+)?(?:struct|enum|trait|mod)\s+([A-Za-z_]\w*)\b", text)
    imports = {u for s in re.findall(r"(?m)^\s*(?:pub\s+)?use\s+([^;]+);", text) for u in rust_uses(s)}
    imports |= {f"mod::{m}" for m in re.findall(r"(?m)^\s*(?:pub\s+)?mod\s+([A-Za-z_]\w*)\s*;", text)}
    last = max(1, len(text.splitlines()))
    return [row(path, "rust", group_name(path, "rust"), posixpath.basename(path), "module", (1, last), package=rust_path(path), declared=list(dict.fromkeys(names))[:DECLARED_NAMES], imports=imports, strings=dotted_strings(text, imports))]


# Java, C#, Kotlin, PHP: packages, types and methods by declaration patterns

_CURLY_WORDS = {"if", "for", "foreach", "while", "switch", "catch", "synchronized", "return", "new", "throw", "super", "this", "try", "else", "using", "lock", "nameof", "typeof", "sizeof", "assert", "when", "fun", "function", "array", "list", "isset", "empty", "echo", "print", "do", "case", "default", "instanceof", "record", "yield", "base", "match", "fn", "unset", "exit", "die", "elseif"}
_COMPONENTS = ("Component", "Controller", "Named", "Repository", "RestController", "Service", "Singleton")
_QUALIFIERS = ("Named", "Qualifier", "Resource")


class Dialect:
    """Where a language's packages, imports, types and methods stand."""

    def __init__(self, name: str, package: str, imports: str, types: str, methods: str, calls: bool, separator: str = ".", **mask):
        self.name, self.package, self.imports = name, re.compile(package), re.compile(imports)
        self.types, self.methods, self.calls, self.separator, self.mask = re.compile(types), re.compile(methods), calls, separator, mask


_WORD = r"[A-Za-z_]\w*"
_JAVA = Dialect(
    "java",
    r"(?m)^\s*package\s+([\w.]+)\s*;",
    r"(?m)^\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;",
    rf"(?P<mods>(?:\b(?:public|protected|private|abstract|final|static|sealed|strictfp)\s+)*)\b(?P<kind>class|interface|enum|record)\s+(?P<name>{_WORD})(?:\s*<[^{{(]*>)?(?:\s*\([^)]*\))?(?P<heads>[^{{;]*)",
    rf"(?P<mods>(?:\b(?:public|protected|private|static|final|abstract|synchronized|default|native)\s+)*)(?:<[^>]+>\s+)?(?:[\w.<>\[\],?\s]+?\s+)?(?P<name>{_WORD})\s*(?P<open>\()",
    True,
)
_CSHARP = Dialect(
    "csharp",
    r"(?m)^\s*namespace\s+([\w.]+)",
    r"(?m)^\s*(?:global\s+)?using\s+(?:static\s+)?(?:\w+\s*=\s*)?([\w.]+)\s*;",
    rf"(?P<mods>(?:\b(?:public|internal|protected|private|abstract|sealed|static|partial|readonly)\s+)*)\b(?P<kind>class|interface|enum|record|struct)\s+(?P<name>{_WORD})(?:\s*<[^{{(]*>)?(?:\s*\([^)]*\))?(?P<heads>[^{{;]*)",
    rf"(?P<mods>(?:\b(?:public|internal|protected|private|static|virtual|override|abstract|sealed|async|extern|new)\s+)+)(?:[\w.<>\[\],?\s]+?\s+)?(?P<name>{_WORD})\s*(?:<[^>(]*>)?\s*(?P<open>\()",
    True,
)
_KOTLIN = Dialect(
    "kotlin",
    r"(?m)^\s*package\s+([\w.]+)",
    r"(?m)^\s*import\s+([\w.]+(?:\.\*)?)",
    rf"(?P<mods>(?:\b(?:public|internal|protected|private|abstract|open|sealed|data|inner|enum|annotation|value|companion)\s+)*)\b(?P<kind>class|interface|object)\s+(?P<name>{_WORD})(?:\s*<[^{{(]*>)?(?:\s*(?:@\w+\s+)?(?:private\s+)?(?:constructor\s*)?\([^)]*\))?(?P<heads>[^{{\n]*)",
    rf"(?P<mods>(?:\b(?:public|internal|protected|private|abstract|open|override|suspend|inline|operator|tailrec|infix)\s+)*)\bfun\s+(?:<[^>]+>\s+)?(?:[\w.<>?]+\.)?(?P<name>{_WORD})\s*(?P<open>\()",
    False,
    triple=True,
)
_PHP = Dialect(
    "php",
    r"(?m)^\s*(?:<\?php\s+)?namespace\s+([\w\\]+)",
    r"(?m)^\s*use\s+(?:function\s+|const\s+)?([\w\\]+)(?:\s+as\s+\w+)?\s*;",
    rf"(?P<mods>(?:\b(?:abstract|final|readonly)\s+)*)\b(?P<kind>class|interface|trait|enum)\s+(?P<name>{_WORD})(?P<heads>[^{{;]*)",
    rf"(?P<mods>(?:\b(?:public|protected|private|static|abstract|final)\s+)*)\bfunction\s+&?(?P<name>{_WORD})\s*(?P<open>\()",
    False,
    separator="\\",
    comments=("//", "#"),
)


def _annotations(text: str, at: int) -> str:
    """The annotations and attributes right before a declaration."""
    head = text[:at]
    m = re.search(r"((?:@\w[\w.]*(?:\s*\((?:[^()]|\([^()]*\))*\))?\s*|\[[\w\s.,()\"'=/{}:-]+\]\s*)+)$", head)
    return m.group(1) if m else ""


def _qualifier(marks: str) -> str:
    m = re.search(rf"@(?:{'|'.join(_QUALIFIERS)})\s*\(\s*(?:name\s*=\s*|value\s*=\s*)?\"([^\"]*)\"", marks)
    return m.group(1) if m else ""


def _typed(items: list[str]) -> Iterator[tuple[str, str, str]]:
    """(name, type, qualifier) of declarations `@X("q") final T name`."""
    for item in items:
        marks = " ".join(re.findall(r"@\w+(?:\([^)]*\))?", item))
        bare = re.sub(r"@\w+(?:\([^)]*\))?|\b(?:final|private|public|protected|static|readonly|volatile|transient|ref|out|in|this|params)\b", " ", item).split("=")[0].strip()
        if m := re.fullmatch(rf"(.+?)\s+\$?({_WORD})", bare, re.S):
            yield m.group(2), clean_type(m.group(1)), _qualifier(marks)


def _heads(heads: str, language: str) -> list[str]:
    """The types that a declaration extends and implements."""
    heads = re.sub(r"<[^<>]*>", "", re.sub(r"<[^<>]*>", "", heads))
    if language in ("csharp", "kotlin"):
        heads = heads.partition(":")[2].split(" where ")[0]
        heads = re.sub(r"\([^)]*\)", "", heads)
    else:
        heads = re.sub(r"\b(extends|implements|permits)\b", ",", heads).split(" permits ")[0]
    return [b.strip().lstrip("\\").replace("\\", ".") for b in heads.split(",") if re.fullmatch(r"\s*[\w.\\]+\s*", b)]


def _parse_curly(path: str, text: str, d: Dialect) -> list[dict]:
    src = Source(text, **d.mask)
    plain = src.plain
    package = (m.group(1).replace("\\", ".") if (m := d.package.search(plain)) else "")
    module = group_name(path, d.name, package)
    imports = {s.replace("\\", ".").strip(".") for s in d.imports.findall(plain)}
    symbols = {s.rsplit(".", 1)[-1]: s for s in imports if not s.endswith("*")}
    strings = dotted_strings(text, imports)
    out: list[dict] = []
    names: list[str] = []
    bases: set[str] = set()
    found = []
    for m in d.types.finditer(plain):
        level = src.depth[m.start("kind")]
        if level <= (1 if d.name in ("csharp", "php") else 0) and (body := src.body(m.end("name") + len(m.group("heads")))):
            if not any(a < m.start() < b for *_, (a, b) in found):
                found.append((m, body))
    for m, (a, b) in found:
        name, mods = m.group("name"), m.group("mods")
        kind = {"record": "class", "struct": "class", "object": "class", "trait": "class"}.get(m.group("kind"), m.group("kind"))
        if d.name == "kotlin" and "enum" in mods:
            kind = "enum"
        marks = _annotations(text, m.start())
        tags = re.findall(r"[@\[]\s*([A-Za-z_]\w*)", marks)
        own = _heads(m.group("heads"), d.name)
        bases |= set(own)
        names.append(name)
        level = src.depth[a] + 1
        members, qualifiers = {}, {}
        if d.calls:
            fields = "".join(c if src.depth[i] == level else " " for i, c in enumerate(text[a + 1 : b], a + 1))
            kept = [s for s in fields.split(";") if "(" not in re.sub(r"@\w+\([^)]*\)", "", s).split("=")[0]]
            for field, t, q in _typed(kept):
                if t:
                    members[field] = t
                if q:
                    qualifiers[field] = q
        methods = []
        for k in d.methods.finditer(plain, a + 1, b):
            before = re.sub(r"\s+", " ", plain[max(a, k.start("name") - 40) : k.start("name")]).rstrip()
            if before.endswith(("new", "return", "throw", "=", ".", "@", "(", ",")) or plain[k.start("name") - 1] in "@.":
                continue
            if src.depth[k.start("name")] != level or k.group("name") in _CURLY_WORDS or not (stop := src.parenthesis(k.start("open"))):
                continue
            inner = src.body(stop + 1, ";=") or None
            arrow = re.match(r"[^{};=]*=>?\s*[^;\n]*", plain[stop + 1 : b]) if not inner else None
            if not inner and d.name in ("kotlin", "csharp") and arrow:
                inner = (stop + 1, stop + 1 + arrow.end())
            if not inner and not (d.name in ("csharp", "php") and re.match(r"\s*(?:throws\s+[\w.,\s]+)?(?::\s*\??[\w\\|]+\s*)?;", plain[stop + 1 : b])):
                continue
            methods.append((k, stop, inner))
        if d.calls:  # what a constructor puts into fields carries the parameters' qualifiers
            for k, stop, inner in methods:
                if k.group("name") == name and inner:
                    given = {p: (t, q) for p, t, q in _typed(split_top(text[k.end("open") : stop]))}
                    for f, p in re.findall(rf"(?:this\.)?({_WORD})\s*=\s*({_WORD})\s*;", plain[inner[0] : inner[1]]):
                        if p in given:
                            t, q = given[p]
                            if t and f not in members:
                                members[f] = t
                            if q and members.get(f) == t:
                                qualifiers.setdefault(f, q)
        bean = ""
        if any(c in tags for c in _COMPONENTS):
            value = re.search(rf"@(?:{'|'.join(_COMPONENTS)})\s*\(\s*(?:value\s*=\s*)?\"([^\"]+)\"", marks)
            bean = value.group(1) if value else name[:1].lower() + name[1:]
        top = re.sub(r"@\w+(?:\s*\([^()]*\))?", " ", "".join(c if src.depth[i] == level else " " for i, c in enumerate(plain[a:b], a)))
        # A Java type's own declarations look like calls, and count as calls of its methods.
        calls = calls_of(top, _CURLY_WORDS) if d.name == "java" else set()
        shared = {"package": package, "import_symbols": symbols, "member_types": members, "member_qualifiers": qualifiers}
        out.append(
            row(path, d.name, module, name, kind, src.lines(m.start(), b + 1), class_context=name, bases=own, calls=calls, annotations=tags, bean=bean, is_abstract=kind == "interface" or "abstract" in mods, is_primary="Primary" in tags, exported="public" in mods, **shared)
        )
        for k, stop, inner in methods:
            local, local_q = dict(members), dict(qualifiers)
            params = list(_typed(split_top(text[k.end("open") : stop])))
            if d.calls:
                for p, t, q in params + (list(_typed(text[inner[0] + 1 : inner[1]].split(";"))) if inner else []):
                    if t:
                        local[p] = t
                    if q:
                        local_q[p] = q
            end = inner[1] + 1 if inner else stop + 1
            # Kotlin names a parameter before its type.
            given = [p for p, *_ in params if d.name != "kotlin"] or [q.split(":")[0].split("=")[0].split()[-1].lstrip("$&.") for q in split_top(plain[k.end("open") : stop]) if q.split(":")[0].split("=")[0].split()]
            out.append(
                row(path, d.name, module, f"{name}.{k.group('name')}", "method", src.lines(k.start("name"), end), class_context=name, calls=calls_of(plain[inner[0] : inner[1]], _CURLY_WORDS) if d.calls and inner else [], params=given, decorators=re.findall(r"[@\[]\s*([A-Za-z_]\w*)", _annotations(text, k.start())), exported="public" in k.group("mods"), **(shared | {"member_types": local, "member_qualifiers": local_q}))
            )
    if d.name == "kotlin":
        for k in d.methods.finditer(plain):
            if src.depth[k.start("name")] == 0 and not any(a < k.start() < b for _, (a, b) in found) and (stop := src.parenthesis(k.start("open"))):
                inner = src.body(stop + 1, "=\n") or (stop, plain.find("\n", stop) if "\n" in plain[stop:] else len(plain))
                names.append(k.group("name"))
                out.append(row(path, d.name, module, k.group("name"), "function", src.lines(k.start("name"), inner[1] + 1), package=package, import_symbols=symbols, params=[q.split(":")[0].strip() for q in split_top(plain[k.end("open") : stop])]))
    whole = row(path, d.name, module, posixpath.basename(path), "module", (1, src.last_line), package=package, declared=list(dict.fromkeys(names))[:DECLARED_NAMES], imports=imports, bases=bases, strings=strings, import_symbols=symbols)
    return [whole, *out]


# Ruby


def parse_ruby(path: str, text: str, context: dict) -> list[dict]:
    """Classes and modules at the margin, their methods as Type#name and Type.name."""
    lines = text.splitlines()
    package = posixpath.basename(path).removesuffix(".rb")
    module = group_name(path, "ruby")
    imports = {s.split("/")[-1] for s in re.findall(r"""(?m)^\s*require(?:_relative)?\s*\(?\s*['"]([^'"]+)['"]""", text)}
    out, names, bases = [], [], set()

    def end_of(first: int) -> int:
        """The line of the `end` that closes the block opened on a line."""
        level = 0
        for n in range(first, len(lines)):
            s = re.sub(r"(#.*|'[^']*'|\"[^\"]*\")", "", lines[n]).strip()
            level += len(re.findall(r"^(?:class|module|def|if|unless|while|until|case|begin|for)\b|\bdo\b(?:\s*\|[^|]*\|)?\s*$", s)) - len(re.findall(r"^end\b|;\s*end\b", s))
            if level <= 0:
                return n
        return len(lines) - 1

    for n, line in enumerate(lines):
        m = re.match(r"(class|module)\s+([A-Z]\w*(?:::\w+)*)(?:\s*<\s*([\w:]+))?", line)
        if not m:
            continue
        kind, name, base = m.group(1), m.group(2), m.group(3)
        stop = end_of(n)
        names.append(name)
        bases |= {base} if base else set()
        out.append(row(path, "ruby", module, name, "class", (n + 1, stop + 1), class_context=name, package=package, bases=[base] if base else []))
        for k in range(n + 1, stop):
            if d := re.match(r"\s+def\s+(self\.)?([\w?!=]+)\s*\(?([^)]*)", lines[k]):
                sep = "." if d.group(1) else "#"
                params = [p.split("=")[0].split(":")[0].strip(" *&") for p in d.group(3).split(",") if p.strip()]
                out.append(row(path, "ruby", module, f"{name}{sep}{d.group(2)}", "method", (k + 1, end_of(k) + 1), class_context=name, package=package, params=params))
    whole = row(path, "ruby", module, posixpath.basename(path), "module", (1, max(1, len(lines))), package=package, declared=names[:DECLARED_NAMES], imports=imports, bases=bases, strings=dotted_strings(text, imports))
    return [whole, *out]


PARSERS: dict[str, Callable[[str, str, dict], list[dict]]] = {
    "python": parse_python,
    "javascript": parse_js,
    "typescript": parse_ts,
    "go": parse_go,
    "rust": parse_rust,
    "java": lambda path, text, context: _parse_curly(path, text, _JAVA),
    "csharp": lambda path, text, context: _parse_curly(path, text, _CSHARP),
    "kotlin": lambda path, text, context: _parse_curly(path, text, _KOTLIN),
    "php": lambda path, text, context: _parse_curly(path, text, _PHP),
    "ruby": parse_ruby,
}


def parse_file(path: str, language: str, text: str | None, context: dict) -> list[dict]:
    """A file's rows; one row with an error, and no node, if it cannot be read or parsed."""
    try:
        if text is None:
            raise ValueError("not readable as UTF-8")
        return PARSERS[language](path, text, context)
    except Exception as e:  # a broken file is a row of the result, not the end of the job
        return [row(path, language, "", "", "", (0, 0)) | {"node": None, "error": f"{type(e).__name__}: {e}"[:300]}]


#: Rows of symbols, and characters of the files that they stand in, after which a batch goes out.
BATCH_ROWS = 2_000
BATCH_CHARS = 1 << 20


def parsed_batches(batches: Iterator[pa.RecordBatch], context: dict, kinds: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows of all files of batches(path, language, text). Many files share a batch, whose fixed cost is many times that of a small file."""
    rows, chars = [], 0

    def batch() -> pa.RecordBatch:
        data = [pa.array([list(r[f.name].items()) if pa.types.is_map(f.type) else r[f.name] for r in rows], f.type) for f in kinds]
        return pa.RecordBatch.from_arrays(data, schema=kinds)

    for given in batches:
        for path, language, text in zip(*(given.column(k).to_pylist() for k in range(3))):
            rows += parse_file(path, language, text, context)
            chars += len(text or "")
            if rows and (len(rows) >= BATCH_ROWS or chars >= BATCH_CHARS):
                yield batch()
                rows, chars = [], 0
    if rows:
        yield batch()


def parse(files: DataFrame, context: dict | None = None) -> DataFrame:
    """NODE rows of files(path, language, text), a file at a time; rows with an error have no node."""
    ship(files.sparkSession)
    context = context or {}
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kinds = to_arrow_schema(_parse_datatype_string(NODE))
    return files.select("path", "language", "text").mapInArrow(lambda batches: parsed_batches(batches, context, kinds), NODE)
