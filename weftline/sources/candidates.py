"""Where each raw reference may lead, in order of priority.

A candidate is (reference kind, raw text, priority, resolution kind, space,
key): the reference resolves to what the index of that space holds under the
key. The lists are made file by file from the parsers' rows; finding the first
candidate that exists is one join of all candidates with all indices
(weftline.plans.analysis).

Spaces:

* id, class: node ids, of any kind and of classes alone,
* fq, fqclass: module.qualname,
* class1, python1, script1, java1: short names that one entry bears, of classes, of Python, of JavaScript and TypeScript, of Java,
* local1: module and short name that one entry bears,
* script: file#name of what a file exports, script_file: file of a module,
* jtype, jmember: package.Type and package.Type.member,
* go: directory, rust: module path, csharp1: package, kotlin1: package or what it begins with, php: package.Type, php1:
  package or what it ends with, ruby1: a class's file or its name in snake case; all where one symbol bears it,
* up: node id of a class | member of its nearest base that has it; own: of the class or its nearest base,
* dotted: a string that names a symbol.

A candidate of space `typed` goes through a type: key is type reference |
member, and the type reference is resolved by candidates of kind `type`.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

Candidate = tuple[str, str, int, str, str, str]

#: Suffixes that an import of a script file may leave out, in order.
SCRIPT_SUFFIXES = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")


def _listed(kind: str, raw: str, options: list[tuple[str, str, str]]) -> Iterator[Candidate]:
    for k, (resolution, space, key) in enumerate(options):
        yield kind, raw, k, resolution, space, key


def script_files(path: str, spec: str, configs: list[dict]) -> list[tuple[str, bool]]:
    """(file, by alias) that an import may mean: relative, by the aliases of the nearest configurations, else below their base."""
    if spec.startswith("."):
        bases = [(posixpath.normpath(posixpath.join(posixpath.dirname(path), spec)), False)]
    else:
        near = [c for c in configs if not c["dir"] or path.startswith(c["dir"] + "/")] or configs
        bases = []
        for c in near:
            for alias, targets in c["paths"].items():
                head, star, tail = alias.partition("*")
                if spec == alias or star and spec.startswith(head) and spec.endswith(tail):
                    middle = spec[len(head) : len(spec) - len(tail)] if star else ""
                    bases += [(posixpath.normpath(x.replace("*", middle)), True) for x in targets]
        if not bases:
            bases = [(posixpath.normpath(posixpath.join(c["base"], spec)), True) for c in near if c["base"] is not None]
    out = []
    for base, alias in bases:
        out += [(base, alias)] + [(base + s, alias) for s in SCRIPT_SUFFIXES] + [(f"{base}/index{s}", alias) for s in SCRIPT_SUFFIXES]
    return list(dict.fromkeys(out))


def _script_options(path: str, binding: str, configs: list[dict], space: str = "script") -> list[tuple[str, str, str]]:
    spec, _, name = binding.partition("#")
    return [("alias_resolved" if alias else "import_exact", space, f"{f}#{name}" if space == "script" else f) for f, alias in script_files(path, spec, configs)]


def _python_base(r: dict, raw: str) -> list[tuple[str, str, str]]:
    out = [("inheritance_exact", "class", f"{r['module']}:{raw}")]
    head, _, tail = raw.partition(".")
    if tail:
        for known in (r["import_modules"], r["import_symbols"]):
            if head in known:
                out.append(("inheritance_exact", "fqclass", f"{known[head]}.{tail}"))
        out.append(("inheritance_exact", "fqclass", raw))
    if raw in r["import_symbols"]:
        out.append(("inheritance_exact", "fqclass", r["import_symbols"][raw]))
    return [*out, ("heuristic", "class1", raw)]


def _python_call(r: dict, raw: str) -> list[tuple[str, str, str]]:
    module, own = r["module"], r["class_context"]
    out = [("direct_symbol", "id", f"{module}:{raw}")]
    head, _, tail = raw.partition(".")
    if head in ("self", "cls") and tail:
        return out + ([("same_class_method", "id", f"{module}:{own}.{tail}")] if own else [])
    if raw.startswith("super()."):
        return out + ([("super_dispatch", "up", f"{module}:{own}|{tail}")] if own else []) + [("heuristic", "local1", f"{module}|{tail}")]
    if tail:
        for known in (r["import_modules"], r["import_symbols"]):
            if head in known:
                out.append(("import_exact", "fq", f"{known[head]}.{tail}"))
        out.append(("direct_symbol", "fq", raw))
    if raw in r["import_symbols"]:
        out.append(("import_exact", "fq", r["import_symbols"][raw]))
    if own:
        out.append(("same_class_method", "id", f"{module}:{own}.{raw}"))
    return [*out, ("same_module_symbol", "id", f"{module}:{raw}"), ("heuristic", "python1", raw)]


def _script_type(r: dict, name: str, configs: list[dict]) -> list[tuple[str, str, str]]:
    out = [("direct_symbol", "class", f"{r['module']}:{name}"), ("direct_symbol", "script", f"{r['file']}#{name}")]
    if name in r["import_symbols"]:
        out = _script_options(r["file"], r["import_symbols"][name], configs) + out
    return out


def _script_call(r: dict, raw: str, configs: list[dict]) -> tuple[list[tuple[str, str, str]], list[str]]:
    """The options, and the types that they go through."""
    module, own, types = r["module"], r["class_context"], []
    name = raw.removeprefix("this.")
    if raw.startswith("super."):
        return ([("super_dispatch", "up", f"{module}:{own}|{raw[6:]}")] if own else []), types
    head, _, tail = name.partition(".")
    out: list[tuple[str, str, str]] = []
    if tail and head in r["member_types"]:
        types.append(r["member_types"][head])
        out.append(("instance_dispatch", "typed", f"{types[-1]}|{tail}"))
    if not raw.startswith("this."):
        if tail and head in r["import_modules"]:
            out += _script_options(r["file"], f"{r['import_modules'][head]}#{tail}", configs)
        if tail and head in r["import_symbols"]:
            types.append(head)
            out.append(("import_exact", "typed", f"{head}|{tail}"))
        if name in r["import_symbols"]:
            out += _script_options(r["file"], r["import_symbols"][name], configs)
    if own and not tail:
        out.append(("same_class_method", "id", f"{module}:{own}.{name}"))
    if raw.startswith("this."):
        return out, types
    out.append(("direct_symbol", "id", f"{module}:{name}") if tail else ("same_module_symbol", "script", f"{r['file']}#{name}"))
    return [*out, ("heuristic", "script1", name)], types


def _java_type(r: dict, name: str) -> list[tuple[str, str, str]]:
    out = [("direct_symbol", "jtype", name)] if "." in name else []
    if name in r["import_symbols"]:
        out.append(("import_exact", "jtype", r["import_symbols"][name]))
    return [*out, ("same_module_symbol", "jtype", f"{r['package']}.{name}" if r["package"] else name)]


def _java_call(r: dict, raw: str) -> tuple[list[tuple[str, str, str]], list[str]]:
    own, types = r["class_context"], []
    if raw.startswith("super."):
        return ([("super_dispatch", "up", f"{r['module']}:{own}|{raw[6:]}")] if own else []), types
    name = raw.removeprefix("this.")
    head, _, tail = name.partition(".")
    out = [("direct_symbol", "jmember", name)] if tail else []
    if tail and head in r["member_types"]:
        types.append(r["member_types"][head])
        out.append(("instance_dispatch", "di", f"{types[-1]}|{tail}|{r['member_qualifiers'].get(head, '')}"))
    elif tail and head in r["import_symbols"]:
        out.append(("import_exact", "jmember", f"{r['import_symbols'][head]}.{tail}"))
        types.append(head)
        out.append(("import_exact", "typed", f"{head}|{tail}"))
    elif tail and head[:1].isupper():
        types.append(head)
        out.append(("direct_symbol", "typed", f"{head}|{tail}"))
    if not tail:
        if name in r["import_symbols"]:
            out.append(("import_exact", "jtype", r["import_symbols"][name]))
        if own:
            out.append(("same_class_method", "id", f"{r['module']}:{own}.{name}"))
        out.append(("heuristic", "java1", name))
    return out, types


def _import(r: dict, raw: str, context: dict) -> list[tuple[str, str, str]]:
    language = r["language"]
    if language in ("javascript", "typescript"):
        return _script_options(r["file"], raw, context.get("configs", []), "script_file")
    if language == "go":
        root = context.get("go_module", "")
        return [("import_exact", "go", raw[len(root) + 1 :] if root and raw.startswith(root + "/") else "" if root and raw == root else raw)] if root else []
    if language == "java":
        return [] if raw.endswith("*") else [("import_exact", "jtype", raw), ("import_exact", "jmember", raw)]
    if language == "rust":
        own = r["package"] or "crate"
        if raw.startswith("mod::"):
            full = f"{own}::{raw[5:]}"
        elif raw.startswith("self::"):
            full = f"{own}::{raw[6:]}"
        elif raw.startswith("super::"):
            full = f"{own.rpartition('::')[0] or 'crate'}::{raw[7:]}"
        else:
            full = raw if raw.startswith("crate") else f"crate::{raw}"
        parts = full.split("::")
        return [("import_exact", "rust", "::".join(parts[:k])) for k in range(len(parts), 0, -1)]
    if language == "csharp":
        return [("import_exact", "csharp1", raw)]
    if language == "kotlin":
        return [("import_exact", "kotlin1", raw)]
    if language == "php":
        return [("import_exact", "php", raw), ("import_exact", "php1", raw)]
    if language == "ruby":
        return [("import_exact", "ruby1", raw.replace("-", "_").lower())]
    return []


def candidates(r: dict, context: dict) -> Iterator[Candidate]:
    """All candidates of a row's references, and of the types that they go through."""
    language, configs = r["language"], context.get("configs", [])
    script = language in ("javascript", "typescript")
    types: list[str] = []
    for raw in r["bases"]:
        if language == "python":
            options = _python_base(r, raw)
        elif script:
            options = [(("inheritance_exact"), s, k) for _, s, k in _script_type(r, raw, configs)]
        else:
            options = [("inheritance_exact", s, k) for _, s, k in _java_type(r, raw)] if language == "java" else [("inheritance_exact", "class", f"{r['module']}:{raw}")]
            options.append(("inheritance_exact", "class1", raw.rpartition(".")[2]))
        yield from _listed("base", raw, options)
    for raw in r["calls"]:
        if script:
            options, more = _script_call(r, raw, configs)
        elif language == "java":
            options, more = _java_call(r, raw)
        else:
            options, more = _python_call(r, raw), []
        types += more
        yield from _listed("call", raw, options)
    for name in dict.fromkeys(types):
        yield from _listed("type", name, _script_type(r, name, configs) if script else _java_type(r, name))
    for raw in r["imports"]:
        yield from _listed("import", raw, _import(r, raw, context))
    for raw in r["strings"]:
        if raw not in r["imports"] and raw not in r["calls"]:
            yield "string", raw, 0, "string_ref", "dotted", raw
