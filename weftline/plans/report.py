"""Reports of an analysis: tables of the whole, a JSON summary, Markdown, a bundle of slices; comparison of two of them."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.constants import CYCLES_SHOWN, LANGUAGE_BY_SUFFIX
from weftline.operators import evidence, risk
from weftline.plans.analysis import Analysis
from weftline.sources import tree

# Files that start a program or describe one.
ENTRYPOINTS = (
    "main.py", "app.py", "manage.py", "wsgi.py", "asgi.py", "cli.py", "__main__.py", "package.json", "src/main.ts", "src/main.tsx", "src/index.ts", "src/index.tsx", "src/index.js",
    "server.js", "server.ts", "main.go", "src/main.rs", "src/lib.rs", "go.mod", "Cargo.toml", "pom.xml",
)

#: Technologies by a word that a dependency's name begins with, after its scope.
TECHNOLOGIES = {
    "react": "React", "next": "Next.js", "vite": "Vite", "express": "Express", "@nestjs/": "NestJS", "vue": "Vue", "angular": "Angular", "svelte": "Svelte", "django": "Django", "flask": "Flask", "fastapi": "FastAPI",
    "sqlalchemy": "SQLAlchemy", "pyspark": "Spark", "pytest": "pytest", "spring-boot": "Spring Boot", "hibernate": "Hibernate", "tokio": "Tokio", "actix": "Actix", "axum": "Axum", "serde": "Serde", "github.com/gin-gonic": "Gin", "gorm": "GORM", "frappe": "Frappe",
}


def entrypoints(files: DataFrame) -> DataFrame:
    """(path, reason) of files(path) that start a program: known names, Go commands, Java applications."""
    p = F.col("path")
    reason = F.when(p.isin(*ENTRYPOINTS), "a known name").when(p.rlike(r"^cmd/[^/]+/main\.go$"), "a Go command").when(p.endswith("Application.java"), "a Java application")
    return files.select("path", reason.alias("reason")).where("reason is not null").orderBy("path")


def documentation(files: DataFrame, limit: int = 12) -> DataFrame:
    low = F.lower("path")
    return files.where(low.isin("readme.md", "readme.txt") | (low.startswith("docs/") & low.rlike(r"\.(md|txt|rst)$"))).select("path").orderBy("path").limit(limit)


def extensions(files: DataFrame, limit: int = 12) -> DataFrame:
    """(suffix, n) of the most frequent suffixes."""
    suffix = F.regexp_extract("path", r"[^/](\.[^./]+)$", 1)
    return files.groupBy(F.when(suffix == "", "(none)").otherwise(F.lower(suffix)).alias("suffix")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "suffix").limit(limit)


def technologies(texts: dict[str, str], languages: list[str]) -> list[str]:
    """Languages, and what the manifests' dependencies name."""
    names = [d.lower() for _, d in tree.dependencies(texts)]
    found = {title for word, title in TECHNOLOGIES.items() if any(n.startswith(word) or n.rpartition("/")[2].startswith(word) for n in names)}
    return sorted(found | set(languages))


def source_insights(nodes: DataFrame, limit: int = 20) -> DataFrame:
    """(file, language, functions, types, score): what a file declares; types weigh twice."""
    is_type = F.col("kind").isin("class", "interface", "enum")
    runs = F.col("kind").isin("function", "async_function", "method")
    out = nodes.groupBy("file", "language").agg(F.count(F.when(runs, 1)).alias("functions"), F.count(F.when(is_type, 1)).alias("types"), F.max(F.size("declared")).alias("declared"))
    score = F.greatest(F.col("functions") + 2 * F.col("types"), F.coalesce("declared", F.lit(0)))
    return out.select("file", "language", "functions", "types", score.alias("score")).orderBy(F.desc("score"), "file").limit(limit)


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def summary(a: Analysis, top: int = 20) -> dict:
    """A report but for its nodes and edges: counts, the riskiest symbols, cycles, modules, all warnings, inventory."""
    files = tree.all_files(a.spark, a.root).select("path", "size")
    shown = ["node", "kind", "file", "start_line", "end_line", "risk", "ca", "ce_internal", "ce_external", "instability", "layer", "scc_size", "pagerank", "betweenness", "signals", "reasons"]
    languages = [r[0] for r in a.nodes.select("language").distinct().orderBy("language").collect()]
    warnings = a.warnings.join(a.nodes.select("node", "file"), "node")
    rank = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "high", 1).otherwise(2)
    cycles = a.cycles.orderBy(F.desc("size"), "members")
    return {
        "meta": {
            "nodes": a.nodes.count(),
            "edges": a.edges.count(),
            "cycles": a.cycles.count(),
            "warnings": warnings.count(),
            "parse_errors": a.parse_errors.count(),
            "languages": {r["language"]: r["n"] for r in _rows(a.nodes.groupBy("language").agg(F.count("*").alias("n")).orderBy("language"))},
        },
        "top_risks": _rows(risk.top_risks(a.metrics, top).select(*shown, "single_point")),
        "cycles": _rows(cycles.limit(CYCLES_SHOWN)),
        "modules": _rows(a.modules.orderBy(F.desc("risk"), "module").limit(40)),
        "warnings": _rows(warnings.orderBy(rank, "rule", "node")),
        "parse_errors": _rows(a.parse_errors.orderBy("file")),
        "signals": {
            "candidates": _rows(evidence.signal_candidates(a.signal_nodes)),
            "watchlist": _rows(evidence.watchlist(a.signal_nodes)),
            "entrypoints": _rows(evidence.signal_entrypoints(a.signal_nodes)),
            "by_signal": {r["signal"]: r["n"] for r in _rows(evidence.nodes_by_signal(a.signal_nodes).orderBy("signal"))},
            "files": _rows(evidence.files_by_weight(a.refs)),
        },
        "tainted": _rows(a.taint.orderBy("node")),
        "confidence": {r["label"]: r["n"] for r in _rows(a.edges.groupBy("label").agg(F.count("*").alias("n")).orderBy("label"))},
        "inventory": {
            "extensions": _rows(extensions(files)),
            "entrypoints": _rows(entrypoints(files)),
            "documentation": [r["path"] for r in _rows(documentation(files))],
            "technologies": technologies(a.configs, languages),
            "sources": _rows(source_insights(a.nodes)),
        },
    }


def write_tables(a: Analysis, folder: str) -> None:
    """nodes and edges as JSON lines, written by the executors."""
    a.metrics.write.mode("overwrite").json(f"{folder}/nodes")
    a.edges.withColumn("kinds", F.split("kinds", ",")).write.mode("overwrite").json(f"{folder}/edges")


def markdown(report: dict) -> str:
    """The summary as Markdown."""
    m = report["meta"]
    out = ["# Structure report", "", f"{m['nodes']} symbols, {m['edges']} edges, {m['cycles']} cycles, {m['warnings']} warnings, {m['parse_errors']} unreadable files.", "", "## Riskiest symbols", "", "| symbol | risk | dependents | dependencies | reasons |", "| --- | --- | --- | --- | --- |"]
    out += [f"| `{r['node']}` | {r['risk']} | {r['ca']} | {r['ce_internal']} | {', '.join(r['reasons'])} |" for r in report["top_risks"]]
    out += ["", "## Cycles", ""] + [f"- {c['size']}: {c['members'].replace(',', ', ')}" for c in report["cycles"]]
    out += ["", "## Languages", ""] + [f"- {k}: {v}" for k, v in m["languages"].items()]
    out += ["", "## Modules", "", "| module | symbols | in | out | instability | risk |", "| --- | --- | --- | --- | --- | --- |"]
    out += [f"| {r['module']} | {r['n_nodes']} | {r['ca']} | {r['ce']} | {r['instability']} | {r['risk']} |" for r in report["modules"]]
    for severity in ("critical", "high", "medium"):
        rows = [w for w in report["warnings"] if w["severity"] == severity]
        if rows:
            out += ["", f"## Warnings: {severity}", ""] + [f"- {w['rule']}: `{w['node']}` ({w['file']})" for w in rows]
    return "\n".join(out) + "\n"


def reading_list(report: dict) -> list[dict]:
    """What to read first, each file once: six entry points, four documents, six files of risky symbols, four sources, four files at a boundary."""
    inventory = report["inventory"]
    parts = (
        ("entry point", 6, [x["path"] for x in inventory["entrypoints"]]),
        ("document", 4, inventory["documentation"]),
        ("risk", 6, [x["file"] for x in report["top_risks"]]),
        ("source", 4, [x["file"] for x in inventory["sources"]]),
        ("boundary", 4, [x["file"] for x in report["signals"]["files"]]),
    )
    out: dict[str, str] = {}
    for why, limit, paths in parts:
        fresh = [p for p in dict.fromkeys(paths) if p not in out]
        out |= {p: why for p in fresh[:limit]}
    return [{"path": p, "why": why} for p, why in out.items()]


def excerpts(files: DataFrame, paths: list[str], chars: int = 2200, lines: int = 80) -> DataFrame:
    """(path, excerpt): the beginning of each of the files(path, text), by characters and lines."""
    kept = files.where(F.col("path").isin(*paths) & F.col("text").isNotNull())
    text = F.array_join(F.slice(F.split(F.substring("text", 1, chars), "\n", -1), F.lit(1), F.lit(lines)), "\n")
    return kept.select("path", text.alias("excerpt")).orderBy("path")


def fence(path: str) -> str:
    """The name of a file's language for a Markdown fence."""
    suffix = Path(path).suffix.lower()
    return {".md": "markdown", ".json": "json", ".toml": "toml", ".yml": "yaml", ".yaml": "yaml", ".xml": "xml", ".sh": "bash", ".sql": "sql", ".html": "html", ".css": "css", ".tsx": "tsx", ".jsx": "jsx"}.get(suffix) or LANGUAGE_BY_SUFFIX.get(suffix, "text")


def slice_text(lines: DataFrame, file: str, start: int, stop: int) -> str:
    """The numbered lines of one slice."""
    rows = lines.where((F.col("path") == file) & F.col("lineno").between(start, stop)).orderBy("lineno").collect()
    return "\n".join(f"{r['lineno']:>5}  {r['text']}" for r in rows)


def write_bundle(a: Analysis, folder: str, top: int = 20, answer: dict | None = None) -> list[str]:
    """Writes the summary, its Markdown, a reading list and a Markdown file a slice; with an answer, that too. Gives the files."""
    base = Path(folder)
    (base / "slices").mkdir(parents=True, exist_ok=True)
    report = summary(a, top)
    texts = {"report.json": json.dumps(report, indent=2, sort_keys=True, default=str), "report.md": markdown(report)}
    lines = tree.file_lines(a.files)
    slices = [(r["node"], r["file"], r["start_line"], r["end_line"]) for r in report["top_risks"]] if answer is None else [(s["names"], s["file"], s["start"], s["stop"]) for s in answer["slices"]]
    reading = []
    for k, (name, file, start, stop) in enumerate(slices, 1):
        texts[f"slices/{k:02}.md"] = f"# {name}\n\n{file}, lines {start} to {stop}\n\n```{fence(file)}\n{slice_text(lines, file, start, stop)}\n```\n"
        reading.append(f"{k}. slices/{k:02}.md: {name}")
    if answer is not None:
        texts["answer.json"] = json.dumps(answer, indent=2, sort_keys=True, default=str)
        texts["prompt.md"] = answer["prompt"]
    first = [f"- {x['path']} ({x['why']})" for x in reading_list(report)]
    texts["README.md"] = "# Reading order\n\n" + "\n".join(["- report.md", *reading]) + "\n\n# Files to know\n\n" + "\n".join(first) + "\n"
    begin = excerpts(a.files, [x["path"] for x in reading_list(report)]).collect()
    texts["excerpts.md"] = "\n".join(f"# {r['path']}\n\n```{fence(r['path'])}\n{r['excerpt']}\n```\n" for r in begin)
    for name, text in texts.items():
        (base / name).write_text(text)
    return sorted(texts)


def load(spark: SparkSession, path: str) -> dict:
    return json.loads(Path(path).read_text())


def compare(spark: SparkSession, old: dict, new: dict) -> DataFrame:
    """What became of the riskiest symbols of one summary in another."""
    of = lambda r: spark.createDataFrame([(x["node"], float(x["risk"])) for x in r["top_risks"]], "symbol string, risk double")
    return risk.report_diff(of(old), of(new)).orderBy("status", "symbol")
