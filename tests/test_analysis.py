import json
import random

import pyarrow as pa
import pytest

from weftline.plans import analysis as plans
from weftline.plans.analysis import Analysis
from weftline.plans.workspace import Scratch
from weftline.sources import parsers, tree

TREE = {
    "go.mod": "module example.org/app\n",
    "cmd/tool/main.go": 'package main\n\nimport "example.org/app/lib"\n\nfunc main() { lib.Go("a.b") }\n',
    "lib/lib.go": "package lib\n\nfunc Go(s string) {}\n",
    "lib/zz.go": "package lib\n",
    "src/main.rs": "mod net;\nuse crate::net::{self, Conn};\nfn main() {}\n",
    "src/net.rs": "use super::nothing;\npub struct Conn;\n",
    "pkg/__init__.py": "",
    "pkg/base.py": "class Root:\n    def go(self):\n        return 1\n\n\nclass Mid(Root):\n    pass\n",
    "pkg/use.py": (
        "import os\nfrom .base import Mid as M\nfrom pkg import base\n\n\nclass Leaf(M):\n    def go(self):\n        return super().go() + self.help() + self.gone()\n\n    def help(self):\n"
        "        from pkg import far\n        return far.away(os.getcwd())\n\n\ndef again(n):\n    return again(n - 1) or base.Root().go()\n\n\nHOOK = 'pkg.far.away'\n"
    ),
    "pkg/far.py": "def away(x):\n    if x is None:\n        raise ValueError\n    return open(x)\n",
    "pkg/broken.py": "def (:\n",
    "pkg/.hidden/skip.py": "def hidden(): pass\n",
    "tsconfig.json": '{ // paths\n "compilerOptions": {"baseUrl": ".", "paths": {"~/*": ["web/*"],}} }',
    "web/types.d.ts": "export function no(): void;\n",
    "web/core/Api.ts": "export class Api {\n  get(u: string) {\n    return fetch(u); // not(here)\n  }\n}\nexport default Api;\n",
    "web/core/index.ts": "export * from './Api';\nexport { helper as aid } from './help';\n",
    "web/core/help.ts": "export const helper = async (x: number) => {\n  return x;\n};\n",
    "web/app.tsx": (
        "import { Api, aid } from '~/core';\nimport Def from './core/Api';\nimport * as H from './core/help';\n\nexport class App extends Api {\n  constructor(private api: Api) {\n    super();\n  }\n"
        "  run() {\n    this.api.get('x(y)');\n    aid(1);\n    H.helper(2);\n    return this.stop();\n  }\n  stop = () => { super.get('q'); }\n}\n\nexport function view() {\n  return <App />;\n}\n"
    ),
    "j/Store.java": "package org.ex;\npublic interface Store {\n  String load(String k);\n}\n",
    "j/Disk.java": 'package org.ex;\nimport org.ann.Named;\n@Named("disk")\npublic class Disk implements Store {\n  public String load(String k) { return k; }\n}\n',
    "j/Mem.java": "package org.ex;\nimport org.ann.*;\n@Primary\n@Service\npublic class Mem implements Store {\n  public String load(String k) { return k; }\n}\n",
    "j/Bus.java": "package org.ex;\npublic interface Bus {\n  void send();\n}\n",
    "j/BusA.java": "package org.ex;\npublic class BusA implements Bus {\n  public void send() { }\n}\n",
    "j/BusB.java": "package org.ex;\npublic class BusB implements Bus {\n  public void send() { }\n}\n",
    "j/Shop.java": (
        'package org.ex;\npublic class Shop {\n  private Store store;\n  @Qualifier("disk")\n  private Store named;\n  private Bus bus;\n  private final Mem mem = new Mem();\n'
        "  public String plain() { return this.store.load(\"a(b\"); }\n  public String marked() { return named.load(\"x\"); }\n  public void open() { bus.send(); }\n  public String own() { return mem.load(plain()); }\n}\n"
    ),
    "c/Order.cs": "namespace Shop.Core;\nusing System;\npublic class Order : Base {\n  public int Total(int n) { return Compute(n); }\n  private int Compute(int n) => n;\n}\n",
    "c/Base.cs": "namespace Shop.Core;\npublic abstract class Base { }\n",
    "k/Main.kt": "package org.kt\nimport org.kt.Thing\nopen class Thing(val a: Int) : Any() {\n  fun size(): Int = a\n}\nfun top(x: Int) { }\n",
    "p/User.php": "<?php\nnamespace App\\Model;\nuse App\\Base;\nabstract class User extends Base {\n  public function name(): string { return $this->n; }\n}\n",
    "p/Base.php": "<?php\nnamespace App;\nclass Base { }\n",
    "r/thing.rb": "require 'set'\nclass Thing < Base\n  def self.make(a)\n    if a\n      new\n    end\n  end\n  def size\n    3\n  end\nend\n",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("tree")
    for name, text in TREE.items():
        (base / name).parent.mkdir(parents=True, exist_ok=True)
        (base / name).write_text(text)
    (base / "pkg/bytes.py").write_bytes(b"x = '\xff\xfe'\n")
    return str(base)


@pytest.fixture(scope="module")
def analysis(spark, root):
    return Analysis(spark, root)


def edges_of(analysis, prefix):
    return {(r.src, r.dst): (r.kinds, r.resolution) for r in analysis.edges.collect() if r.src.startswith(prefix)}


def test_errors_do_not_end_the_job(analysis):
    assert {r.file: r.error.split(":")[0] for r in analysis.parse_errors.collect()} == {"pkg/broken.py": "SyntaxError", "pkg/bytes.py": "ValueError"}
    files = {r.file for r in analysis.nodes.collect()}
    assert "web/types.d.ts" not in files and "pkg/.hidden/skip.py" not in files


def test_python(analysis):
    assert edges_of(analysis, "pkg.") == {
        ("pkg.base:Mid", "pkg.base:Root"): ("inheritance", "inheritance_exact"),
        ("pkg.use:Leaf", "pkg.base:Mid"): ("inheritance", "inheritance_exact"),
        ("pkg.use:Leaf.go", "pkg.base:Root.go"): ("call", "super_dispatch"),
        ("pkg.use:Leaf.go", "pkg.use:Leaf.help"): ("call", "same_class_method"),
        ("pkg.use:Leaf.help", "pkg.far:away"): ("call", "import_exact"),
        ("pkg.use:again", "pkg.use:again"): ("call", "direct_symbol"),
        ("pkg.use:again", "pkg.base:Root"): ("call", "import_exact"),
        ("pkg.use:again", "pkg.base:Root.go"): ("call", "import_exact"),
        ("pkg.use:__module__", "pkg.far:away"): ("string_ref", "string_ref"),
    }
    out = {(r.node, r.raw) for r in analysis.external.collect() if r.node.startswith("pkg.")}
    assert ("pkg.use:Leaf.help", "os.getcwd") in out


def test_go_and_rust(analysis):
    assert edges_of(analysis, "example.org") == {("example.org/app/cmd/tool:main.go", "example.org/app/lib:lib.go"): ("import", "import_exact")}
    assert edges_of(analysis, "rust.") == {("rust.src:main.rs", "rust.src:net.rs"): ("import", "import_exact"), ("rust.src:net.rs", "rust.src:main.rs"): ("import", "import_exact")}


def test_scripts(analysis):
    got = edges_of(analysis, "typescript.")
    app, core = "typescript.web:", "typescript.web.core:"
    assert got[app + "App", core + "Api"] == ("inheritance", "inheritance_exact")
    assert got[app + "App.run", core + "Api.get"] == ("call", "instance_dispatch")
    assert got[app + "App.run", core + "helper"] == ("call", "import_exact")  # better than the re-exported one
    assert got[app + "App.run", app + "App.stop"] == ("call", "same_class_method")
    assert got[app + "App.stop", core + "Api.get"] == ("call", "super_dispatch")
    assert got[app + "view", app + "App"] == ("call", "same_module_symbol")
    assert got[app + "app.tsx", core + "index.ts"] == ("import", "alias_resolved")
    assert got[core + "index.ts", core + "Api.ts"] == ("import", "import_exact")
    raw = {(r.node, r.raw): r.kind for r in analysis.resolved.collect() if r.ref_kind == "call"}
    assert raw[app + "App.run", "aid"] == "barrel_reexport"


def test_java_injection(analysis):
    got = edges_of(analysis, "java.org.ex:Shop")
    j = "java.org.ex:"
    assert got[j + "Shop.plain", j + "Mem.load"] == ("call", "java_di_primary")
    assert got[j + "Shop.marked", j + "Disk.load"] == ("call", "java_di_qualifier")
    assert got[j + "Shop.own", j + "Mem.load"] == ("call", "instance_dispatch")
    assert got[j + "Shop.own", j + "Shop.plain"] == ("call", "same_class_method")
    assert not any(s == j + "Shop.open" for s, _ in got)
    r = analysis.resolved.where("node = 'java.org.ex:Shop.open'").first()
    assert (r.kind, r.options) == ("ambiguous_candidates", j + "BusA.send," + j + "BusB.send")
    nodes = {r.node: r for r in analysis.nodes.collect()}
    assert nodes[j + "Disk"].bean == "disk" and nodes[j + "Mem"].bean == "mem" and nodes[j + "Mem"].is_primary


def test_other_languages(analysis):
    nodes = {r.node: (r.kind, r.start_line, r.end_line) for r in analysis.nodes.collect()}
    assert nodes["csharp.Shop.Core:Order.Total"] == ("method", 4, 4) and nodes["csharp.Shop.Core:Base"] == ("class", 2, 2)
    assert nodes["kotlin.org.kt:Thing.size"][0] == "method" and nodes["kotlin.org.kt:top"] == ("function", 6, 6)
    assert nodes["php.App.Model:User.name"] == ("method", 5, 5)
    assert nodes["ruby.r:Thing.make"] == ("method", 3, 7) and nodes["ruby.r:Thing#size"] == ("method", 8, 10)
    assert edges_of(analysis, "csharp.") | edges_of(analysis, "php.") | edges_of(analysis, "ruby.") == {
        ("csharp.Shop.Core:Order", "csharp.Shop.Core:Base"): ("inheritance", "inheritance_exact"),
        ("csharp.Shop.Core:Order.Total", "csharp.Shop.Core:Order.Compute"): ("call", "same_class_method"),
        ("csharp.Shop.Core:Order.cs", "csharp.Shop.Core:Base"): ("inheritance", "inheritance_exact"),
        ("php.App.Model:User.php", "php.App:Base"): ("import", "import_exact"),
    }


def test_metrics_and_signals(analysis):
    rows = {r.node: r for r in analysis.metrics.collect()}
    assert set(rows) == {r.node for r in analysis.nodes.collect()}
    assert rows["pkg.use:again"].self_call and rows["pkg.use:Leaf"].n_bases == 1 and "inherits" in rows["pkg.use:Leaf"].reasons
    assert 0 <= min(r.risk for r in rows.values()) and max(r.risk for r in rows.values()) <= 100
    away = rows["pkg.far:away"]
    assert set(away.signals) == {"filesystem_io", "external_io", "validation_guard", "error_handling", "dynamic_dispatch"}
    assert {r.rule for r in analysis.warnings.collect() if r.node == "typescript.web.core:Api.get"} == {"open_network_call"}
    assert analysis.flows.where("node = 'pkg.far:away'").first().path == "dynamic_dispatch -> validation_guard -> error_handling -> filesystem_io"
    assert analysis.modules.count() > 5 and analysis.cycles.first().members == "rust.src:main.rs,rust.src:net.rs"


def test_excludes_and_languages(spark, root):
    files = {r.path for r in tree.source_files(spark, root, exclude=["j", "*.ts", "pkg/far.py"], languages=["java", "python", "typescript"]).collect()}
    assert files == {"pkg/__init__.py", "pkg/base.py", "pkg/use.py", "pkg/broken.py", "pkg/bytes.py", "web/app.tsx"}


def test_document_types(spark, tmp_path):
    for name, more in (("Sales Order", [{"fieldtype": "Link", "options": "Client"}, {"fieldtype": "Table", "options": "Line"}]), ("Client", []), ("Line", [])):
        folder = tmp_path / name.lower().replace(" ", "_")
        folder.mkdir()
        (folder / f"{folder.name}.json").write_text(json.dumps({"doctype": "DocType", "name": name, "fields": more}))
    (tmp_path / "client/client.py").write_text("import frappe\n\n\ndef f():\n    return frappe.get_doc('Sales Order', 1)\n")
    (tmp_path / "odd.json").write_text("[1,")
    a = Analysis(spark, str(tmp_path), doctypes=True)
    d = "frappe.doctype."
    assert {(r.src, r.dst): r.kinds for r in a.edges.collect()} == {
        (d + "sales_order:sales_order", d + "client:client"): "doctype_link",
        (d + "sales_order:sales_order", d + "line:line"): "doctype_child",
        (d + "client:client", "client.client:f"): "doctype_controller",
        ("client.client:f", d + "sales_order:sales_order"): "orm_load",
    }


def test_configurations():
    assert tree.relaxed_json('{"a": "x // y", /* no */ "b": [1, 2,], // z\n}') == {"a": "x // y", "b": [1, 2]}
    assert tree.relaxed_json("[1]") == {} and tree.relaxed_json("{") == {}
    texts = {"base.json": '{"compilerOptions": {"baseUrl": "lib", "paths": {"@a": ["one"], "@b": ["two"]}}}', "app/tsconfig.json": '{"extends": "../base", "compilerOptions": {"paths": {"@b": ["./three"]}}}'}
    assert tree.script_configs(texts) == [{"dir": "app", "base": "lib", "paths": {"@a": ["lib/one"], "@b": ["lib/three"]}}]
    assert tree.framework_probe({"x/apps.txt": "erp"}) and not tree.framework_probe({"package.json": "{}"})
    found = tree.dependencies({"package.json": '{"dependencies": {"react": "1"}}', "requirements.txt": "flask>=1\n# x\n", "pom.xml": "<project><dependencies><dependency><artifactId>boot</artifactId></dependency></dependencies></project>", "go.mod": "module a\nrequire example.com/x/y v1.0\n", "Cargo.toml": "[dependencies]\nserde = '1'\n", "pyproject.toml": "["})
    assert found == [("Cargo.toml", "serde"), ("go.mod", "example.com/x/y"), ("package.json", "react"), ("pom.xml", "boot"), ("requirements.txt", "flask")]


def test_change_statistics(spark):
    log = spark.createDataFrame([("3\t1\ta.py",), ("-\t-\timg.png",), ("commit x",), ("2\t0\ta.py",), ("1\t1\tb c.py",)], "value string")
    assert sorted(tuple(r) for r in tree.numstat(log).collect()) == [("-", "-", "img.png"), ("1", "1", "b c.py"), ("2", "0", "a.py"), ("3", "1", "a.py")]


def test_rust_uses():
    assert parsers.rust_uses("a::{ b, self, c::d }") == ["a::b", "a", "a::c::d"] and parsers.rust_path("src/x/mod.rs") == "crate::x"


def test_report_bundle_and_question(spark, analysis, root, tmp_path):
    from weftline.__main__ import check_result
    from weftline.plans import ask, report

    out = report.summary(analysis, 5)
    assert out["meta"]["parse_errors"] == 2 and len(out["top_risks"]) == 5 and out["meta"]["cycles"] == 1
    assert {"path": "cmd/tool/main.go", "reason": "a Go command"} in out["inventory"]["entrypoints"]
    assert "# Structure report" in report.markdown(out)
    assert {"node": "pkg.far:away", "sources": ["event_hook", "file_read"], "tainted": {"x": "event_hook"}} not in out["tainted"]
    assert {"node": "pkg.far:away", "sources": ["file_read"], "tainted": {"x": "file_read"}} in out["tainted"]
    assert out["signals"]["by_signal"]["filesystem_io"] == 1 and "pkg/far.py" in {f["file"] for f in out["signals"]["files"]}
    assert analysis.layout.count() == out["meta"]["nodes"]
    answer = ask.ask(analysis, "How does away open the file?", 40)
    assert answer["candidates"][0]["node"] == "pkg.far:away" and answer["slices"][0]["file"] == "pkg/far.py"
    assert "filesystem_io" in answer["signals"] and answer["outcome"] == "confirmed" and answer["mentions"] == []
    assert answer["plan"]["steps"][0]["open"] == "pkg/far.py:3-4" and answer["result"]["posture"] == "firm" and answer["packet"]["mode"] == "verify"
    assert "pkg/far.py:4-4#filesystem_io" in answer["evidence"] and answer["followup"] is None
    # The slice holds the line that opens the file, not the test before it; nothing is called from there.
    assert answer["completeness"] == {"pkg.far:away": "partial"} and answer["gaps"] == answer["paths"] == answer["chains"] == []
    file = ask.ask(analysis, "What is in far.py?", 40)
    assert file["mentioned_files"] == ["pkg/far.py"] and file["candidates"][0]["file"] == "pkg/far.py"
    other = ask.ask(analysis, "How does away open the file and query the database?", 40)
    assert other["outcome"] == "partial" and other["missing_signals"] == ["database_io"] and "no evidence of database_io" in other["result"]["limits"]
    assert all(x["blocked_by"] or x["allowed"] for x in other["escalation"])
    names = report.write_bundle(analysis, str(tmp_path / "b"), 3, answer)
    assert [x["why"] for x in report.reading_list(out)][:2] == ["entry point", "entry point"] and len({x["path"] for x in report.reading_list(out)}) == len(report.reading_list(out))
    assert report.fence("a/b.tsx") == "tsx" and report.fence("x.py") == "python" and report.fence("x.bin") == "text"
    assert {"README.md", "excerpts.md", "answer.json", "prompt.md", "report.json", "report.md", "slices/01.md"} <= set(names)
    assert "return open(x)" in (tmp_path / "b/slices/01.md").read_text()
    c = answer["contract"]
    good = {
        "inspected_slice_refs": c["required_read_order_refs"], "inspected_symbols": c["required_primary_symbols"], "used_claims": c["allowed_claims"][:1], "final_claim": c["allowed_claims"][0], "final_outcome": "confirmed",
        "stop_condition": c["valid_stop_conditions"][0], "completion_state": "completed_within_bounds", "followup_used": False,
    }
    assert check_result(spark, c, good)["status"] == "accepted"
    assert check_result(spark, c, good | {"final_claim": "anything"})["violations"] == ["must_respect_allowed_claims"]
    changed = json.loads(json.dumps(out))
    changed["top_risks"][0]["risk"] += 5
    assert {r.status for r in report.compare(spark, out, changed).collect()} == {"degraded", "unchanged"}
    parts = {r["part"] for r in ask.why(analysis, "pkg.use:Leaf.go")}
    assert {"risk", "callee"} <= parts
    report.write_tables(analysis, str(tmp_path / "t"))
    assert spark.read.json(str(tmp_path / "t/edges")).count() == out["meta"]["edges"]


def test_other_files_are_not_read(spark, tmp_path):
    """Archives and images beside the sources are listed and not read, of whatever size; manifests of any size are."""
    from weftline.sources import tree

    (tmp_path / "a.py").write_text("x = 1\n")
    (tmp_path / "_b.py").write_text("y = 1\n")
    (tmp_path / "blob.bin").write_bytes(b"0" * 200_000)
    (tmp_path / "package.json").write_text('{"name": "' + "n" * 30_000 + '"}')
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 100_000)
    try:
        assert sorted(r.path for r in tree.source_files(spark, str(tmp_path)).collect()) == ["_b.py", "a.py"]
        assert sorted(r.path for r in tree.all_files(spark, str(tmp_path)).select("path", "size").collect()) == ["_b.py", "a.py", "blob.bin", "package.json"]
        assert len(tree.named_files(spark, str(tmp_path), ["package.json"])["package.json"]) > 30_000
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_files_of_one_task_are_parsed_in_several(spark):
    line = "# " + "x" * 98 + "\n"
    files = spark.createDataFrame([(f"m{k}.py", "python", f"def f{k}():\n    pass\n" + line * 3000) for k in range(4)], "path string, language string, text string").coalesce(1)
    a = Analysis.of_files(spark, files)
    assert len(a.files.inputFiles()) == 1 and len(a.parsed.inputFiles()) > 1
    assert sorted(r.node for r in a.nodes.collect()) == [f"m{k}:f{k}" for k in range(4)]


def test_small_files_share_a_batch(monkeypatch):
    files = [(f"s{k}.rb", "ruby", f"class S{k}\nend\n") for k in range(50)]
    given = [pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*files[i : i + 5])], ["path", "language", "text"]) for i in range(0, 50, 5)]
    kinds = pa.schema([("node", pa.string()), ("import_symbols", pa.map_(pa.string(), pa.string()))])
    nodes = [f"ruby:{n}" for k in range(50) for n in (f"s{k}.rb", f"S{k}")]
    for rows, chars, n in ((1000, 10_000, 1), (20, 10_000, 5), (1000, 1, 50)):
        monkeypatch.setattr(parsers, "BATCH_ROWS", rows)
        monkeypatch.setattr(parsers, "BATCH_CHARS", chars)
        out = list(parsers.parsed_batches(iter(given), {}, kinds))
        assert len(out) == n and [x for b in out for x in b.column(0).to_pylist()] == nodes


@pytest.mark.parametrize("seed", range(3))
def test_members_of_nearest_bases(spark, seed):
    """Random classes with cycles among their bases, against a plain search; only what is asked for is answered."""
    rng = random.Random(seed)
    names = [f"C{k}" for k in range(14)]
    pairs = sorted({(rng.choice(names), rng.choice(names)) for _ in range(16)})
    has = sorted({(rng.choice(names), rng.choice("xyz")) for _ in range(8)})
    asked = sorted({(rng.choice(("own", "up")), rng.choice([*names, "F"]), rng.choice("xyzw")) for _ in range(40)})
    nodes = [(f"m:{n}", "m", n, rng.choice(("class", "interface"))) for n in names] + [(f"m:{n}.{x}", "m", f"{n}.{x}", "method") for n, x in [*has, ("F", "x")]] + [("m:F", "m", "F", "function")]
    out = plans.member_index(
        spark.createDataFrame([(s, f"m:{n}", x) for s, n, x in asked], "space string, seed string, member string"),
        spark.createDataFrame([(f"m:{a}", f"m:{b}") for a, b in pairs], "src string, dst string"),
        spark.createDataFrame(nodes, "node string, module string, qualname string, kind string"),
        Scratch(spark, "test"),
    )
    want = set()
    for space, n, member in asked:
        level, seen = {n} - {"F"}, {n}
        for step in range(len(names) + 1):
            hits = sorted(c for c in level if (c, member) in has) if step or space == "own" else []
            if hits:
                want.add((space, f"m:{n}|{member}", f"m:{hits[0]}.{member}"))
                break
            level = {b for a, b in pairs if a in level} - seen
            seen |= level
    got = [tuple(r) for r in out.collect()]
    assert set(got) == want and len(got) == len(want)


def test_no_walk_for_members_at_hand(spark):
    """A chain of classes is not walked where every called member is the class's own."""
    text = "package p.c{k};\nimport p.c{b}.C{b};\nclass C{k} extends C{b} {{\n  int go() {{\n    return C{b}.make();\n  }}\n  static int make() {{\n    return 1;\n  }}\n}}\n"
    files = [(f"p/C{k}.java", "java", text.format(k=k, b=max(0, k - 1))) for k in range(12)]
    a = Analysis.of_files(spark, spark.createDataFrame(files, "path string, language string, text string"))
    calls = {(r.src, r.dst) for r in a.edges.collect() if r.kinds == "call" and r.src.endswith(".go")}
    assert calls == {(f"java.p.c{k}:C{k}.go", f"java.p.c{max(0, k - 1)}:C{max(0, k - 1)}.make") for k in range(12)}
    path = spark._jvm.org.apache.hadoop.fs.Path(a.scratch.path("walk2"))
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    assert a.spark.read.parquet(a.scratch.path("asked")).count() == 11
