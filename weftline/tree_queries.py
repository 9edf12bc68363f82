"""Queries over source files that are made from the tables, for parsers, resolution and line patterns.

Every supplier K has a file a language, which builds on that of the supplier
of half its key, P; so bases are a tree of logarithmic depth. Files are written from a template a language; what is expected
of them follows from the supplier's key alone, and the SQL says it in lines,
names and targets without looking at any text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import signals
from weftline.plans.analysis import Analysis
from weftline.queries import _t, query
from weftline.sources import doctypes, parsers

#: Go's module and the folder of each language are what imports are written against.
GO_MODULE = "example.com/stock"

_CURLY_JS = """import { S@P } from './b@P';
import { make_@P } from './s@P';

export function make_@K() {
  return make_@P();
}

export class S@K extends S@P {
  open() {
    return make_@K();
  }
  close() {
    return this.open();
  }
}
"""

#: (language, path, text); what @K builds on is @P, and itself for the root.
TEMPLATES: list[tuple[str, str, str]] = [
    (
        "python",
        "shop/s@K.py",
        """from shop.s@P import S@P, make_@P

def make_@K():
    return make_@P()

class S@K(S@P):
    def open(self, key):
        return make_@K()
    def close(self):
        return self.open()
""",
    ),
    ("typescript", "web/s@K.ts", _CURLY_JS),
    ("typescript", "web/b@K.ts", "export { S@K } from './s@K';\n"),
    ("javascript", "old/s@K.js", _CURLY_JS),
    ("javascript", "old/b@K.js", "export { S@K } from './s@K';\n"),
    (
        "java",
        "store/S@K.java",
        """package store.s@K;

import store.s@P.S@P;

class S@K extends S@P {
  int open(int key) {
    return S@P.make();
  }
  int close() {
    return this.open();
  }
  static int make() {
    return 1;
  }
}
""",
    ),
    (
        "csharp",
        "desk/S@K.cs",
        """using Desk.I@P;

namespace Desk.S@K
{
  public class S@K
  {
    public int Open(int key)
    {
      return key;
    }
  }
}
""",
    ),
    (
        "kotlin",
        "phone/S@K.kt",
        """package phone.s@K

import phone.t@P

class S@K {
  fun open(key: Int): Int {
    return key
  }
}
""",
    ),
    ("csharp", "desk/I@K.cs", "namespace Desk.I@K\n{\n  public interface I@K\n  {\n  }\n}\n"),
    ("kotlin", "phone/t@K.kt", "package phone.t@K\n\nfun tell(key: Int): Int {\n  return key\n}\n"),
    (
        "php",
        "site/S@K.php",
        """<?php
namespace Site\\S@K;

use Site\\S@P\\S@P;

class S@K
{
  public function open($key)
  {
    return $key;
  }
}
""",
    ),
    (
        "ruby",
        "gem/s@K.rb",
        """require 's@P'

class S@K
  def open(key)
    key
  end
end
""",
    ),
    (
        "go",
        "stock/s@K/s@K.go",
        f"""package s@K

import "{GO_MODULE}/stock/s@P"

func Make() int {{
	return s@P.Make()
}}
""",
    ),
    (
        "rust",
        "src/s@K.rs",
        """use crate::s@P::make;

pub fn open() -> i32 {
    make()
}
""",
    ),
]


def supplier_files(spark: SparkSession, sf: str) -> DataFrame:
    """(path, language, text): all files of all suppliers; P is K where no supplier has half the key, and for key 0."""
    keys = _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"))
    before = keys.select(F.col("k").alias("p"))
    rows = keys.join(before, F.expr("k div 2") == F.col("p"), "left").withColumn("p", F.coalesce("p", "k"))
    # A key becomes fourteen files, so a small table of one task is spread before it grows.
    rows = rows.repartition(4 * spark.sparkContext.defaultParallelism, "k")
    files = F.explode(F.array(*(F.struct(*(F.lit(x).alias(n) for n, x in zip(("language", "path", "text"), t))) for t in TEMPLATES)))
    filled = lambda c: F.replace(F.replace(c, F.lit("@K"), F.col("k").cast("string")), F.lit("@P"), F.col("p").cast("string"))
    return rows.select("k", "p", files.alias("f")).select(filled(F.col("f.path")).alias("path"), "f.language", filled(F.col("f.text")).alias("text"))


def _values(rows: list[tuple], names: str) -> str:
    """SQL for a row of each tuple and supplier, with @K and @P filled in; `who` keeps rows of roots, where P is K (f), of the others (n) or of all (a)."""
    cell = lambda x: str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"
    columns = [c.strip() for c in names.split(",")]
    listed = ", ".join("(" + ", ".join(cell(x) for x in r) + ")" for r in rows)
    texts = {c for c, x in zip(columns, rows[0]) if isinstance(x, str) and c != "who"}
    shown = ", ".join(f"replace(replace({c}, '@K', k::VARCHAR), '@P', p::VARCHAR) AS {c}" if c in texts else c for c in columns if c != "who")
    kept = "WHERE who = 'a' OR (who = 'f') = (k = p)" if "who" in columns else ""
    return f"""
    WITH keys AS (SELECT a.s_suppkey AS k, coalesce(b.s_suppkey, a.s_suppkey) AS p FROM supplier a LEFT JOIN supplier b ON b.s_suppkey = a.s_suppkey // 2)
    SELECT {shown} FROM keys, (VALUES {listed}) AS v({", ".join(columns)}) {kept}
    """


def _script_symbols(language: str, folder: str, suffix: str) -> list[tuple]:
    of, file = f"{language}.{folder}", f"{folder}/s@K.{suffix}"
    return [
        (f"{of}:s@K.{suffix}", "module", file, 1, 15, "", "", "S@P", "./b@P,./s@P"),
        (f"{of}:b@K.{suffix}", "module", f"{folder}/b@K.{suffix}", 1, 1, "", "", "", "./s@K"),
        (f"{of}:make_@K", "function", file, 4, 6, "", "make_@P", "", ""),
        (f"{of}:S@K", "class", file, 8, 15, "", "", "S@P", ""),
        (f"{of}:S@K.open", "method", file, 9, 11, "", "make_@K", "", ""),
        (f"{of}:S@K.close", "method", file, 12, 14, "", "this.open", "", ""),
    ]


_SYMBOLS = [
    ("shop.s@K:make_@K", "function", "shop/s@K.py", 3, 4, "", "make_@P", "", ""),
    ("shop.s@K:S@K", "class", "shop/s@K.py", 6, 10, "", "", "S@P", ""),
    ("shop.s@K:S@K.open", "function", "shop/s@K.py", 7, 8, "self,key", "make_@K", "", ""),
    ("shop.s@K:S@K.close", "function", "shop/s@K.py", 9, 10, "self", "self.open", "", ""),
    *_script_symbols("typescript", "web", "ts"),
    *_script_symbols("javascript", "old", "js"),
    ("java.store.s@K:S@K.java", "module", "store/S@K.java", 1, 15, "", "", "S@P", "store.s@P.S@P"),
    ("java.store.s@K:S@K", "class", "store/S@K.java", 5, 15, "", "close,make,open", "S@P", ""),
    ("java.store.s@K:S@K.open", "method", "store/S@K.java", 6, 8, "key", "S@P.make", "", ""),
    ("java.store.s@K:S@K.close", "method", "store/S@K.java", 9, 11, "", "this.open", "", ""),
    ("java.store.s@K:S@K.make", "method", "store/S@K.java", 12, 14, "", "", "", ""),
    ("csharp.Desk.S@K:S@K.cs", "module", "desk/S@K.cs", 1, 12, "", "", "", "Desk.I@P"),
    ("csharp.Desk.S@K:S@K", "class", "desk/S@K.cs", 5, 11, "", "", "", ""),
    ("csharp.Desk.S@K:S@K.Open", "method", "desk/S@K.cs", 7, 10, "key", "", "", ""),
    ("csharp.Desk.I@K:I@K.cs", "module", "desk/I@K.cs", 1, 6, "", "", "", ""),
    ("csharp.Desk.I@K:I@K", "interface", "desk/I@K.cs", 3, 5, "", "", "", ""),
    ("kotlin.phone.s@K:S@K.kt", "module", "phone/S@K.kt", 1, 9, "", "", "", "phone.t@P"),
    ("kotlin.phone.s@K:S@K", "class", "phone/S@K.kt", 5, 9, "", "", "", ""),
    ("kotlin.phone.s@K:S@K.open", "method", "phone/S@K.kt", 6, 8, "key", "", "", ""),
    ("kotlin.phone.t@K:t@K.kt", "module", "phone/t@K.kt", 1, 5, "", "", "", ""),
    ("kotlin.phone.t@K:tell", "function", "phone/t@K.kt", 3, 5, "key", "", "", ""),
    ("php.Site.S@K:S@K.php", "module", "site/S@K.php", 1, 12, "", "", "", "Site.S@P.S@P"),
    ("php.Site.S@K:S@K", "class", "site/S@K.php", 6, 12, "", "", "", ""),
    ("php.Site.S@K:S@K.open", "method", "site/S@K.php", 8, 11, "key", "", "", ""),
    ("ruby.gem:s@K.rb", "module", "gem/s@K.rb", 1, 7, "", "", "", "s@P"),
    ("ruby.gem:S@K", "class", "gem/s@K.rb", 3, 7, "", "", "", ""),
    ("ruby.gem:S@K#open", "method", "gem/s@K.rb", 4, 6, "key", "", "", ""),
    (f"{GO_MODULE}/stock/s@K:s@K.go", "module", "stock/s@K/s@K.go", 1, 7, "", "", "", f"{GO_MODULE}/stock/s@P"),
    ("rust.src:s@K.rs", "module", "src/s@K.rs", 1, 5, "", "", "", "crate::s@P::make"),
]


@query(_values(_SYMBOLS, "node, kind, file, start_line, end_line, params, calls, bases, imports"))
def parsed_symbols(spark, sf):
    """Symbols, lines, parameters and raw references of all files."""
    rows = parsers.parse(supplier_files(spark, sf), {"go_module": GO_MODULE})
    joined = [F.array_join(c, ",").alias(c) for c in ("params", "calls", "bases", "imports")]
    return rows.select("node", "kind", "file", "start_line", "end_line", *joined)


def _script_edges(language: str, folder: str, suffix: str) -> list[tuple]:
    of = f"{language}.{folder}"
    return [
        ("a", f"{of}:make_@K", f"{of}:make_@P", "call", "import_exact", 0.93),
        ("n", f"{of}:S@K", f"{of}:S@P", "inheritance", "inheritance_exact", 0.9),
        ("a", f"{of}:s@K.{suffix}", f"{of}:S@P", "inheritance", "inheritance_exact", 0.9),
        ("n", f"{of}:S@K.open", f"{of}:make_@K", "call", "same_module_symbol", 0.95),
        ("f", f"{of}:S@K.open", f"{of}:make_@K", "call", "import_exact", 0.93),
        ("a", f"{of}:S@K.close", f"{of}:S@K.open", "call", "same_class_method", 0.97),
        ("a", f"{of}:b@K.{suffix}", f"{of}:s@K.{suffix}", "import", "import_exact", 0.93),
        ("a", f"{of}:s@K.{suffix}", f"{of}:b@P.{suffix}", "import", "import_exact", 0.93),
        ("n", f"{of}:s@K.{suffix}", f"{of}:s@P.{suffix}", "import", "import_exact", 0.93),
    ]


_JAVA = "java.store.s@K:S@K"
_EDGES = [
    ("n", "shop.s@K:make_@K", "shop.s@P:make_@P", "call", "import_exact", 0.93),
    ("f", "shop.s@K:make_@K", "shop.s@P:make_@P", "call", "direct_symbol", 0.99),
    ("n", "shop.s@K:S@K", "shop.s@P:S@P", "inheritance", "inheritance_exact", 0.9),
    ("a", "shop.s@K:S@K.open", "shop.s@K:make_@K", "call", "direct_symbol", 0.99),
    ("a", "shop.s@K:S@K.close", "shop.s@K:S@K.open", "call", "same_class_method", 0.97),
    *_script_edges("typescript", "web", "ts"),
    *_script_edges("javascript", "old", "js"),
    *(("a", _JAVA, f"{_JAVA}.{m}", "call", "same_class_method", 0.97) for m in ("open", "close", "make")),
    ("a", f"{_JAVA}.close", f"{_JAVA}.open", "call", "same_class_method", 0.97),
    ("a", f"{_JAVA}.open", "java.store.s@P:S@P.make", "call", "import_exact", 0.93),
    ("a", f"{_JAVA}.java", "java.store.s@P:S@P", "import,inheritance", "import_exact", 0.93),
    ("n", _JAVA, "java.store.s@P:S@P", "inheritance", "inheritance_exact", 0.9),
    ("a", "csharp.Desk.S@K:S@K.cs", "csharp.Desk.I@P:I@P", "import", "import_exact", 0.93),
    ("a", "kotlin.phone.s@K:S@K.kt", "kotlin.phone.t@P:tell", "import", "import_exact", 0.93),
    ("a", "php.Site.S@K:S@K.php", "php.Site.S@P:S@P", "import", "import_exact", 0.93),
    ("a", "ruby.gem:s@K.rb", "ruby.gem:S@P", "import", "import_exact", 0.93),
    ("n", f"{GO_MODULE}/stock/s@K:s@K.go", f"{GO_MODULE}/stock/s@P:s@P.go", "import", "import_exact", 0.93),
    ("n", "rust.src:s@K.rs", "rust.src:s@P.rs", "import", "import_exact", 0.93),
]


@query(_values(_EDGES, "who, src, dst, kinds, resolution, score"))
def resolved_edges(spark, sf):
    """Typed edges of all files of all languages: imports, calls, bases, barrels."""
    a = Analysis.of_files(spark, supplier_files(spark, sf), {"go.mod": f"module {GO_MODULE}\n"})
    return a.edges.select("src", "dst", "kinds", "resolution", "score")


#: (language, line, signals it shows), for each language lines of input, output, outside, state, guards, data and chance.
SAMPLES: list[tuple[str, str, str]] = [
    ("python", "rows = requests.get(url)", "network_io"),
    ("python", "cursor.execute(sql)", "database_io"),
    ("python", "self.total = 1", "state_mutation"),
    ("python", "print(total)", "output_boundary"),
    ("python", "name = input()", "input_boundary"),
    ("python", "d = json.loads(text)", "deserialization"),
    ("python", "total = a + b", ""),
    ("typescript", "const r = await fetch(url);", "concurrency,network_io"),
    ("typescript", "async fetch(url) {", ""),
    ("typescript", "this.total = 1;", "state_mutation"),
    ("typescript", "console.log(total);", "output_boundary"),
    ("typescript", "const d = JSON.parse(text);", "deserialization"),
    ("javascript", "const now = Date.now();", "time_or_randomness"),
    ("javascript", "const key = process.env.KEY;", "config_access"),
    ("java", "this.total = 1;", "state_mutation"),
    ("java", "Files.readString(path);", "filesystem_io"),
    ("java", "throw new IllegalStateException();", "error_handling"),
    ("go", "resp, err := http.Get(url)", "network_io"),
    ("go", "data := json.Unmarshal(raw, &v)", "deserialization"),
    ("go", "if err != nil {", "error_handling"),
    ("rust", "let f = File::open(path);", "filesystem_io"),
    ("rust", "let t = Instant::now();", "time_or_randomness"),
    ("csharp", "var id = Guid.NewGuid();", "time_or_randomness"),
    ("csharp", "Console.WriteLine(total);", "output_boundary"),
    ("kotlin", "println(total)", "output_boundary"),
    ("kotlin", "require(total > 0)", "validation_guard"),
    ("php", "$q = json_decode($raw);", "deserialization"),
    ("php", "$this->total = 1;", "state_mutation"),
    ("ruby", "puts total", "output_boundary"),
    ("ruby", "key = ENV['KEY']", "config_access"),
]


def _sample_sql() -> str:
    rows = ", ".join(f"('{language}', {k}, '{signal}')" for k, (language, _, shown) in enumerate(SAMPLES, 1) for signal in shown.split(",") if signal)
    return f"SELECT language || ':' || s_suppkey AS node, lineno, signal FROM supplier, (VALUES {rows}) AS v(language, lineno, signal)"


@query(_sample_sql())
def language_signals(spark, sf):
    """What lines of ten languages show, a node a supplier and language."""
    samples = F.explode(F.array(*(F.struct(F.lit(a).alias("language"), F.lit(k).alias("lineno"), F.lit(b).alias("text")) for k, (a, b, _) in enumerate(SAMPLES, 1))))
    lines = _t(spark, sf, "supplier").select("s_suppkey", samples.alias("x")).select("s_suppkey", "x.*")
    lines = lines.withColumn("node", F.concat_ws(":", "language", "s_suppkey")).withColumn("file", F.col("node"))
    return signals.match_lines(lines).select("node", F.col("start").alias("lineno"), "signal")


#: Lines by event: tests of rights, tests of values, ways out, and neither.
_EVENT_LINE = {"signup": "if not user.has_role(name):", "click": "if total is None:", "error": "raise ValueError(name)", "view": "total += price", "purchase": "if price > total:"}


@query(f"""
WITH l AS (
  SELECT 'u' || user_id AS node, event_id AS lineno, CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _EVENT_LINE.items())} END AS text FROM events WHERE user_id IS NOT NULL
), w AS (
  SELECT node, lineno, text, lead(text, 1) OVER o AS t1, lead(lineno, 1) OVER o AS l1, lead(text, 2) OVER o AS t2, lead(lineno, 2) OVER o AS l2 FROM l WINDOW o AS (PARTITION BY node ORDER BY lineno)
), g AS (
  SELECT node, lineno AS "start", CASE WHEN t1 LIKE 'raise %' THEN l1 WHEN t2 LIKE 'raise %' THEN l2 END AS "stop", text || ' ' || coalesce(t1, '') || ' ' || coalesce(t2, '') AS whole FROM w WHERE text LIKE 'if %'
)
SELECT node, CASE WHEN whole LIKE '%has_role%' THEN 'auth_guard' ELSE 'validation_guard' END AS signal, "start", "stop" FROM g
WHERE "stop" IS NOT NULL AND (whole LIKE '%has_role%' OR whole LIKE '%is None%')
""")
def guard_windows(spark, sf):
    """Tests that leave within the next two lines of their node."""
    text = F.create_map(*(F.lit(x) for pair in _EVENT_LINE.items() for x in pair))[F.col("event_type")]
    rows = _t(spark, sf, "events").where("user_id is not null").select(F.concat(F.lit("u"), F.col("user_id")).alias("node"), F.lit("f").alias("file"), F.col("event_id").alias("lineno"), text.alias("text"))
    return signals.guard_windows(rows).select("node", "signal", "start", "stop")


#: Texts of functions by market segment, and the kinds of input they take.
_SEGMENT = {
    "MACHINERY": ("key = os.environ['KEY']", "env_var"),
    "BUILDING": ("rows = json.load(open(path))", "file_read"),
    "AUTOMOBILE": ("r = requests.get(sys.argv[1])", "cli_arg,external_api"),
    "HOUSEHOLD": ("return total", ""),
    "FURNITURE": ("d = frappe.form_dict", "http_param"),
}


@query(f"""
SELECT 'c' || c_custkey AS node, sources, split_part(sources, ',', 1) AS path_taint
FROM (SELECT c_custkey, CASE c_mktsegment {" ".join(f"WHEN '{k}' THEN '{v[1]}'" for k, v in _SEGMENT.items())} END AS sources FROM customer) WHERE sources <> ''
""")
def taint_sources(spark, sf):
    """Kinds of outside input of a function a customer, and its parameter's taint."""
    text = F.create_map(*(F.lit(x) for k, v in _SEGMENT.items() for x in (k, v[0])))[F.col("c_mktsegment")]
    none = F.array().cast("array<string>")
    nodes = _t(spark, sf, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey")).alias("node"), F.lit("function").alias("kind"), F.lit("python").alias("language"), text.alias("text"), none.alias("decorators"),
        F.array(F.lit("self"), F.lit("path")).alias("params"), F.lit(False).alias("exported"), F.lit(False).alias("hooked"),
    )
    return signals.taint_sources(nodes).select("node", F.array_join("sources", ",").alias("sources"), F.col("tainted")["path"].alias("path_taint"))


@query("""
WITH n AS (SELECT lower(n_name) AS n, n_name, n_nationkey AS k, replace(lower(r_name), ' ', '_') AS r, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
id AS (SELECT *, 'frappe.doctype.' || n || ':' || n AS node, 'frappe.doctype.' || r || ':' || r AS region FROM n)
SELECT node AS src, region AS dst, 'doctype_link' AS kind FROM id
UNION ALL SELECT region, node, 'doctype_child' FROM id
UNION ALL SELECT node, 'types.' || n || '.' || n || ':load', 'doctype_controller' FROM id
UNION ALL SELECT 'types.' || n || '.' || n || ':load', region, 'orm_load' FROM id
""")
def doctype_edges(spark, sf):
    """Links, child tables, controllers and loads by name: a document type a nation and region, a controller a nation."""
    region, nation = _t(spark, sf, "region"), _t(spark, sf, "nation")
    both = nation.join(region, nation.n_regionkey == region.r_regionkey)
    field = lambda kind, options: F.struct(F.lit(kind).alias("fieldtype"), F.lit("x").alias("fieldname"), options.alias("options"))
    text = lambda name, fields: F.to_json(F.struct(F.lit("DocType").alias("doctype"), name.alias("name"), fields.alias("fields")))
    low = F.lower("n_name")
    folder = F.concat(F.lit("types/"), low, F.lit("/"), low)
    one = both.select(F.concat(folder, F.lit(".json")).alias("path"), text(F.col("n_name"), F.array(field("Link", F.col("r_name")), field("Data", F.lit("")))).alias("text"))
    per = both.groupBy("r_name").agg(F.collect_list("n_name").alias("names"))
    kids = per.select(F.concat(F.lit("types/"), F.lower("r_name"), F.lit(".json")).alias("path"), text(F.col("r_name"), F.transform("names", lambda x: field("Table", x))).alias("text"))
    types = doctypes.doctypes(one.unionByName(kids))
    code = F.concat(F.lit("import frappe\n\ndef load(key):\n    return frappe.get_doc('"), F.col("r_name"), F.lit("', key)\n"))
    files = both.select(F.concat(folder, F.lit(".py")).alias("path"), F.lit("python").alias("language"), code.alias("text"))
    return doctypes.doctype_edges(types, parsers.parse(files).where("node is not null"), files).select("src", "dst", "kind")
