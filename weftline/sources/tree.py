"""Reading a source tree: files, lines, configurations, manifests, change statistics."""

from __future__ import annotations

import fnmatch
import json
import posixpath
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
import tomllib
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.constants import LANGUAGE_BY_SUFFIX
from weftline.functions.text import universal_lines
from weftline.plans.workspace import ship

# Directories that are not read.
IGNORED_DIRS = ("__pycache__", "venv", "node_modules")
IGNORED_PREFIXES = (".", "llm_bundle", "ask_bundle")


def _ignored(part):
    test = part.isin(*IGNORED_DIRS)
    for p in IGNORED_PREFIXES:
        test = test | part.startswith(p)
    return test


def _underscored(spark: SparkSession, root: str) -> list[str]:
    """Addresses of the files whose names begin with an underscore, which Spark's file sources leave out: names are listed on the driver."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    store = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    found, todo = [], [path(root)]
    while todo:
        for f in store.listStatus(todo.pop()):
            name = f.getPath().getName()
            if f.isDirectory():
                if name not in IGNORED_DIRS and not name.startswith(IGNORED_PREFIXES):
                    todo.append(f.getPath())
            elif name.startswith("_"):
                found.append(f.getPath().toString())
    return sorted(found)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    for batch in batches:
        for address in batch.column(0).to_pylist():
            store, name = fs.FileSystem.from_uri(address)
            with store.open_input_file(name) as f:
                data = f.read()
            yield pa.RecordBatch.from_arrays([pa.array([address]), pa.array([len(data)]), pa.array([data], pa.binary())], ["path", "length", "content"])


def all_files(spark: SparkSession, root: str, names: list[str] | None = None) -> DataFrame:
    """(path, size, content) of the files below a folder outside ignored directories; paths are relative to it.

    names: globs of which a file's name must match one; other files are only
    listed. Where `content` is not selected, no file is read.
    """
    base = root.rstrip("/")
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if names:
        reader = reader.option("pathGlobFilter", f"{{{','.join(names)}}}")
    raw = reader.load(base).select("path", "length", "content")
    more = [x for x in _underscored(spark, base) if not names or any(fnmatch.fnmatchcase(posixpath.basename(x), g) for g in names)]
    if more:
        ship(spark)
        listed = spark.createDataFrame([(x,) for x in more], "path string")
        raw = raw.unionByName(listed.mapInArrow(_read, "path string, length long, content binary"))
    # The readers give full addresses; the part after the root is the path.
    marker = re.sub(r"^\w+:/*", "/", base)
    path = F.substring_index(F.col("path"), f"{marker}/", -1)
    out = raw.select(path.alias("path"), F.col("length").alias("size"), "content")
    folders = F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1)
    return out.where(~F.exists(folders, _ignored))


def glob_expression(patterns: list[str]) -> str:
    return "|".join(f"(?:{fnmatch.translate(p)})" for p in patterns)


def source_files(spark: SparkSession, root: str, exclude: list[str] | None = None, languages: list[str] | None = None) -> DataFrame:
    """(path, language, text): files of known suffixes, without declaration files; text is null where it is no UTF-8.

    exclude: globs that a directory's name, the whole path or the file's name
    may match. Files of other suffixes are not read.
    """
    files = all_files(spark, root, [f"*{x}" for x in LANGUAGE_BY_SUFFIX])
    suffix = F.regexp_extract("path", r"(\.[A-Za-z0-9]+)$", 1)
    language = F.create_map(*(F.lit(x) for k, v in LANGUAGE_BY_SUFFIX.items() for x in (k, v)))[suffix]
    files = files.withColumn("language", language).where(F.col("language").isNotNull() & ~F.col("path").endswith(".d.ts"))
    if languages:
        files = files.where(F.col("language").isin(*languages))
    if exclude:
        e = re.sub(r"\(\?s:(.*?)\)\\[zZ]", r"^(?:\1)$", glob_expression(exclude))
        parts = F.split("path", "/")
        files = files.where(~F.col("path").rlike(e) & ~F.exists(parts, lambda p: p.rlike(e)))
    return files.select("path", "language", F.expr("try_validate_utf8(cast(content as string))").alias("text"))


def file_lines(files: DataFrame) -> DataFrame:
    """(path, language, lineno, text): lines at any of the line ends that Python's splitlines knows."""
    rows = files.where("text is not null").select("path", "language", F.posexplode(universal_lines("text")).alias("pos", "line"))
    return rows.select("path", "language", (F.col("pos") + 1).alias("lineno"), F.col("line").alias("text"))


def numstat(text: DataFrame) -> DataFrame:
    """(added, deleted, path) from lines(value) of a change log with tab-separated numbers; other lines are skipped."""
    parts = F.split("value", "\t")
    rows = text.where(F.size(parts) == 3).select(F.get(parts, F.lit(0)).alias("added"), F.get(parts, F.lit(1)).alias("deleted"), F.get(parts, F.lit(2)).alias("path"))
    return rows.where(F.col("added").rlike(r"^(\d+|-)$") & F.col("deleted").rlike(r"^(\d+|-)$"))


# Configurations and manifests: a few small files, read on the driver


def relaxed_json(text: str) -> dict:
    """A JSON object with comments and trailing commas; anything else is an empty one."""
    kept = re.compile(r'"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\])*\'|//[^\n]*|/\*.*?\*/', re.S)
    plain = kept.sub(lambda m: m.group() if m.group()[0] in "\"'" else " ", text)
    plain = re.sub(r",(\s*[}\]])", r"\1", plain)
    try:
        out = json.loads(plain)
    except ValueError:
        return {}
    return out if isinstance(out, dict) else {}


def named_files(spark: SparkSession, root: str, names: list[str]) -> dict[str, str]:
    """path -> text of the files whose name matches one of the globs: configurations and manifests, which the driver reads as a whole."""
    rows = all_files(spark, root, names).select("path", F.expr("try_validate_utf8(cast(content as string))")).collect()
    return {r[0]: r[1] for r in rows if r[1] is not None}


def framework_probe(texts: dict[str, str]) -> bool:
    """Whether a tree looks like an app of the framework whose document types are JSON: a list of apps, or a dependency of that name."""
    return any(posixpath.basename(p) == "apps.txt" for p in texts) or any(d.lower() == "frappe" for _, d in dependencies(texts))


def go_module(texts: dict[str, str]) -> str:
    m = re.search(r"(?m)^\s*module\s+(\S+)", texts.get("go.mod", ""))
    return m.group(1) if m else ""


def script_configs(texts: dict[str, str]) -> list[dict]:
    """{dir, base, paths} of every tsconfig*.json and jsconfig.json, with what they extend; the deepest directories first."""

    def options(path: str, seen: frozenset[str]) -> tuple[str | None, dict]:
        if path in seen or path not in texts:
            return None, {}
        data = relaxed_json(texts[path])
        base, paths = None, {}
        parent = data.get("extends")
        if isinstance(parent, str) and parent.startswith("."):
            to = posixpath.normpath(posixpath.join(posixpath.dirname(path), parent))
            for option in (to, f"{to}.json", f"{to}/tsconfig.json"):
                if option in texts:
                    base, paths = options(option, seen | {path})
                    break
        own = data.get("compilerOptions")
        own = own if isinstance(own, dict) else {}
        if isinstance(own.get("baseUrl"), str):
            base = posixpath.normpath(posixpath.join(posixpath.dirname(path), own["baseUrl"]))
        root = base if base is not None else posixpath.dirname(path)
        for alias, targets in (own.get("paths") or {}).items():
            if isinstance(targets, list):
                paths = paths | {alias: [posixpath.normpath(posixpath.join(root, t)) for t in targets if isinstance(t, str)]}
        return base, paths

    out = []
    for path in sorted(texts):
        if re.fullmatch(r"(tsconfig[^/]*|jsconfig)\.json", posixpath.basename(path)):
            base, paths = options(path, frozenset())
            if base is not None or paths:
                out.append({"dir": posixpath.dirname(path), "base": base, "paths": {k: [t.lstrip("./") if t.startswith("./") else t for t in v] for k, v in paths.items()}})
    return sorted(out, key=lambda c: (-len(c["dir"]), c["dir"]))


def dependencies(texts: dict[str, str]) -> list[tuple[str, str]]:
    """(manifest, dependency) of the manifests of Node, Python, Go, Rust and Maven projects; broken ones give none."""

    def of(path: str, text: str) -> Iterator[str]:
        name = posixpath.basename(path)
        if name == "package.json":
            data = relaxed_json(text)
            for key in ("dependencies", "devDependencies", "peerDependencies"):
                if isinstance(data.get(key), dict):
                    yield from data[key]
        elif name == "pyproject.toml" or name == "Cargo.toml":
            data = tomllib.loads(text)
            listed = data.get("project", {}).get("dependencies", [])
            yield from (re.split(r"[\s<>=!~;\[]", d, maxsplit=1)[0] for d in listed)
            yield from data.get("tool", {}).get("poetry", {}).get("dependencies", {})
            yield from data.get("dependencies", {}) if name == "Cargo.toml" else ()
        elif re.fullmatch(r"requirements[^/]*\.txt", name):
            yield from (re.split(r"[\s<>=!~;\[]", x, maxsplit=1)[0] for x in text.splitlines() if x.strip() and not x.startswith(("#", "-")))
        elif name == "go.mod":
            yield from re.findall(r"(?m)^\s*(?:require\s+)?([\w.-]+\.[\w.-]+/[\w./-]+)\s+v", text)
        elif name == "pom.xml":
            yield from (e.text.strip() for e in ET.fromstring(text).iter() if e.tag.rpartition("}")[2] == "artifactId" and e.text)

    out = []
    for path in sorted(texts):
        try:
            out += [(path, d) for d in of(path, texts[path])]
        except (ValueError, ET.ParseError):
            continue
    return list(dict.fromkeys(out))
