"""The analysis of a source tree: files -> symbols -> edges -> metrics -> signals -> risk.

Every stage is a function from DataFrames to a DataFrame; `Analysis` holds the
tables of one run, written to the shared folder as they are made, since several
later stages read each of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions.constants import CONTAINER_KINDS, EXECUTABLE_KINDS
from weftline.operators import graph, intervals, resolve, risk, signals
from weftline.plans.workspace import Scratch, ship
from weftline.sources import doctypes, parsers, tree
from weftline.sources.candidates import candidates

_CANDIDATE = "node string, ref_kind string, raw string, prio int, kind string, space string, key string"
_TYPES = ("class", "interface", "enum")


def reference_candidates(nodes: DataFrame, context: dict) -> DataFrame:
    """All candidates of all references of parsed nodes."""
    ship(nodes.sparkSession)
    names = ["node", "module", "file", "language", "class_context", "package", "calls", "bases", "imports", "strings", "import_modules", "import_symbols", "member_types", "member_qualifiers"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                r = {k: dict(v) if k in ("import_modules", "import_symbols", "member_types", "member_qualifiers") else v for k, v in r.items()}
                rows += [(r["node"], *c) for c in candidates(r, context)]
            if rows:
                kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], ["node", "ref_kind", "raw", "prio", "kind", "space", "key"])

    refer = nodes.where("size(calls) > 0 or size(bases) > 0 or size(imports) > 0 or size(strings) > 0")
    return refer.select(*names).mapInArrow(run, _CANDIDATE)


def _unique(index: DataFrame, space: str) -> DataFrame:
    return resolve.unique_names(index).select(F.lit(space).alias("space"), F.col("name").alias("key"), F.col("node").alias("target"))


def name_index(nodes: DataFrame) -> DataFrame:
    """(name, node, language, kind, module): short names, with the repeats that make a name ambiguous.

    Python nodes have the last part of their qualified name. Others have that,
    the name without its last suffix, and the names they declare: a name
    without dots is thus there twice and never unique.
    """
    last = F.element_at(F.split("qualname", r"\."), -1)
    stem = F.regexp_replace("qualname", r"(?<=.)\.[^.]*$", "")
    names = F.when(F.col("language") == "python", F.array(last)).otherwise(F.concat(F.array(last, stem), F.col("declared")))
    return nodes.select(F.explode(names).alias("name"), "node", "language", "kind", "module").where("name <> ''")


def indices(nodes: DataFrame) -> DataFrame:
    """(space, key, target) of all spaces that need the nodes alone."""
    c = F.col
    is_type = c("kind").isin(*_TYPES)
    full = F.concat_ws(".", "module", "qualname")

    def rows(of: DataFrame, space: str, key) -> DataFrame:
        return of.groupBy(key.alias("key")).agg(F.max("node").alias("target")).select(F.lit(space).alias("space"), "key", "target")

    short = name_index(nodes)
    packaged = F.concat_ws(".", F.when(c("package") != "", c("package")), "qualname")
    java = nodes.where("language = 'java'")
    modules = nodes.where("kind = 'module'")
    symbols = nodes.where("kind <> 'module' and package <> ''")
    folder = F.regexp_replace("file", "/?[^/]*$", "")
    stem = F.regexp_replace(F.regexp_replace("file", "^.*/", ""), r"\.[^.]*$", "")
    name = F.regexp_replace("file", "^.*/", "")
    order = Window.partitionBy("key").orderBy(F.when(name == "main.go", 0).otherwise(1), F.when((stem == F.regexp_replace(folder, "^.*/", "")) & (folder != ""), 0).otherwise(1), "file")
    go = modules.where("language = 'go'").withColumn("key", folder).withColumn("_k", F.row_number().over(order)).where("_k = 1")
    one = lambda of, space, key: _unique(of.select(key.alias("name"), "node"), space)
    parts = [
        nodes.select(F.lit("id").alias("space"), c("node").alias("key"), c("node").alias("target")),
        nodes.where(c("kind") == "class").select(F.lit("class").alias("space"), c("node").alias("key"), c("node").alias("target")),
        rows(nodes, "fq", full),
        rows(nodes.where(c("kind") == "class"), "fqclass", full),
        _unique(short.where(c("kind") == "class"), "class1"),
        _unique(short.where("language = 'python'"), "python1"),
        _unique(short.where("language in ('javascript', 'typescript')"), "script1"),
        _unique(short.where("language = 'java'"), "java1"),
        _unique(short.withColumn("name", F.concat_ws("|", "module", "name")), "local1"),
        rows(modules.where("language in ('javascript', 'typescript')"), "script_file", c("file")),
        rows(java.where(is_type), "jtype", packaged),
        rows(java.where("kind = 'method' and package <> ''"), "jmember", packaged),
        go.select(F.lit("go").alias("space"), "key", c("node").alias("target")),
        rows(modules.where("language = 'rust'"), "rust", c("package")),
        one(symbols.where("language = 'csharp'"), "csharp1", c("package")),
        one(symbols.where("language = 'kotlin'"), "kotlin1", F.explode(resolve.prefixes(c("package"), "."))),
        one(symbols.where("language = 'php' and not contains(qualname, '.')"), "php", packaged),
        one(symbols.where("language = 'php'"), "php1", F.explode(F.concat(F.array("package"), resolve.suffixes(c("package"), ".")))),
        one(nodes.where("language = 'ruby' and kind = 'class'"), "ruby1", F.explode(F.array_distinct(F.array(F.lower(F.translate(stem, "-", "_")), F.lower(F.regexp_replace(F.regexp_replace("qualname", "^.*::", ""), "(?<!^)(?=[A-Z])", "_")))))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def script_exports(nodes: DataFrame, context: dict, scratch: Scratch, rounds: int = 9) -> DataFrame:
    """(space, key, target) of file#name for scripts: own top-level symbols, then what re-exports lead to, to a depth of `rounds`.

    A default import means the symbol named as the file, the default binding
    or the only symbol. Through re-exports of everything a name counts if one
    symbol bears it.
    """
    spark = nodes.sparkSession
    script = nodes.where("language in ('javascript', 'typescript')")
    own = script.where("kind <> 'module' and not contains(qualname, '.')")
    named = own.groupBy("file", F.col("qualname").alias("name")).agg(F.count("*").alias("n"), F.min("node").alias("target")).where("n = 1")
    stem = F.regexp_replace(F.regexp_replace("file", "^.*/", ""), r"\.[^.]*$", "")
    lone = own.groupBy("file").agg(F.count("*").alias("n"), F.min("node").alias("only"), F.max(F.when(F.col("qualname") == stem, F.col("node"))).alias("named"))
    default = lone.select("file", F.lit("default").alias("name"), F.coalesce("named", F.when(F.col("n") == 1, F.col("only"))).alias("target")).where("target is not null")
    known = scratch.table(named.select("file", "name", "target").unionByName(default), "exports0")

    from weftline.sources.candidates import script_files

    modules = script.where("kind = 'module'").select("file", "exports", "star_exports")
    ship(spark)

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                for alias, binding in dict(r["exports"]).items():
                    spec, _, name = binding.partition("#")
                    rows += [(r["file"], alias, k, f, name) for k, (f, _) in enumerate(script_files(r["file"], spec, context.get("configs", [])))]
                for spec in r["star_exports"]:
                    rows += [(r["file"], None, k, f, None) for k, (f, _) in enumerate(script_files(r["file"], spec, context.get("configs", [])))]
            if rows:
                kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], ["file", "alias", "prio", "far", "name"])

    raw = modules.mapInArrow(links, "file string, alias string, prio int, far string, name string")
    raw = raw.join(modules.select(F.col("file").alias("far")), "far")
    raw = scratch.table(raw.groupBy("file", "alias", "name").agg(F.min(F.struct("prio", "far")).alias("f")).select("file", "alias", "name", "f.far"), "reexports")
    hops = known.where("false").withColumn("barrel", F.lit(True))
    every = known.withColumn("barrel", F.lit(False))
    for k in range(rounds):
        there = every.select(F.col("file").alias("far"), F.col("name").alias("there"), "target")
        one = raw.where("alias is not null").join(there, "far").where("name = there").select("file", F.col("alias").alias("name"), "target")
        star = raw.where("alias is null").join(there.where("there <> 'default'"), "far").groupBy("file", F.col("there").alias("name"))
        star = star.agg(F.count_distinct("target").alias("n"), F.min("target").alias("target")).where("n = 1").select("file", "name", "target")
        new = one.unionByName(star).groupBy("file", "name").agg(F.min("target").alias("target")).join(every, ["file", "name"], "left_anti").withColumn("barrel", F.lit(True))
        new = scratch.table(new, f"exports{k + 1}")
        if not new.limit(1).count():
            break
        every, hops = every.unionByName(new), hops.unionByName(new)
    return every.select(F.lit("script").alias("space"), F.concat_ws("#", "file", "name").alias("key"), "target", "barrel")


def member_index(wanted: DataFrame, inherits: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(space, key, target) for wanted(space, seed, member): class|member of the nearest base that has it; `own` counts the class itself, `up` does not.

    Step by step from the classes up; a pair that has found its member goes no
    further. Of several bases at one distance the least by name.
    """
    members = nodes.where("contains(qualname, '.')").select(
        F.concat(F.col("module"), F.lit(":"), F.regexp_replace("qualname", r"\.[^.]*$", "")).alias("node"), F.element_at(F.split("qualname", r"\."), -1).alias("member"), F.col("node").alias("target")
    )
    members = scratch.table(members.join(wanted.select("member").distinct(), "member", "left_semi"), "wanted_members")
    pairs = scratch.table(graph.edge_set(inherits), "inherits")
    seeds = wanted.join(nodes.where(F.col("kind").isin(*_TYPES)).select(F.col("node").alias("seed")), "seed", "left_semi")
    frontier = scratch.table(seeds.select("space", "seed", "member", F.col("seed").alias("node")).distinct(), "walk0")
    key = ["space", "seed", "member"]
    every, seen, step = None, frontier, 0
    while True:
        # A class that is its own base by a cycle was there at the start.
        found = (frontier if step else frontier.where("space = 'own'")).join(members, ["node", "member"])
        found = scratch.table(found.groupBy(*key).agg(F.min(F.struct("node", "target")).alias("b")).select(*key, "b.target"), f"found{step}")
        every = found if every is None else every.unionByName(found)
        rest = frontier.join(found, key, "left_anti").join(pairs, F.col("node") == F.col("src"))
        more = rest.select(*key, F.col("dst").alias("node")).distinct().join(seen, [*key, "node"], "left_anti")
        step += 1
        frontier = scratch.table(more, f"walk{step}")
        if not frontier.limit(1).count():
            break
        seen = seen.unionByName(frontier)
    return every.select("space", F.concat_ws("|", "seed", "member").alias("key"), "target")


_REF = ["node", "ref_kind", "raw"]


def injected(wanted: DataFrame, types: DataFrame, nodes: DataFrame, closure: DataFrame, own: DataFrame) -> DataFrame:
    """(node, ref_kind, raw, prio, kind, target, n) of calls on typed members: the implementation that would be injected.

    wanted(_REF, prio, type, member, qualifier) with types(node, raw, target).
    A concrete class is called itself. Of an abstract one, the implementations
    with the member whose name, decapitalised name or bean name is the
    qualifier, else the primary one, else the only one; several make the call
    ambiguous (target null), none means the declared member.
    """
    c = F.col
    t = wanted.join(types.select("node", c("raw").alias("type"), c("target").alias("declared")), ["node", "type"])
    kinds = nodes.select(c("node").alias("declared"), "is_abstract")
    t = t.join(kinds, "declared").withColumn("self_key", F.concat_ws("|", "declared", "member"))
    members = own.select(c("key").alias("self_key"), c("target").alias("self_target"))
    t = t.join(members, "self_key", "left")
    impl = closure.select(c("base").alias("declared"), c("target").alias("impl"))
    impl = impl.join(nodes.select(c("node").alias("impl"), c("qualname").alias("impl_name"), "bean", "is_primary"), "impl")
    of_class = own.select(F.substring_index("key", "|", 1).alias("impl"), F.substring_index("key", "|", -1).alias("impl_member"), c("target").alias("impl_target"))
    impl = impl.join(of_class, "impl").select("declared", "impl_member", "impl_name", "bean", "is_primary", "impl_target")
    every = t.where("is_abstract").join(impl, (t.declared == impl.declared) & (t.member == impl.impl_member), "left").drop(impl.declared)
    want = F.lower("qualifier")
    decap = F.concat(F.lower(F.substring("impl_name", 1, 1)), F.expr("substring(impl_name, 2)"))
    matches = (c("qualifier") != "") & ((F.lower("impl_name") == want) | (F.lower(decap) == want) | (F.lower("bean") == want))
    agg = every.groupBy(*_REF, "prio", "qualifier", "self_target").agg(
        F.count("impl_target").alias("n"),
        F.count(F.when(matches, 1)).alias("nq"), F.min(F.when(matches, c("impl_target"))).alias("tq"),
        F.count(F.when(c("is_primary"), 1)).alias("np"), F.min(F.when(c("is_primary"), c("impl_target"))).alias("tp"),
        F.min("impl_target").alias("t1"), F.array_join(F.array_sort(F.collect_set("impl_target")), ",").alias("options"),
    )
    named = c("qualifier") != ""
    kind = (
        F.when(named & (c("nq") == 1), "java_di_qualifier")
        .when(named & (c("nq") > 1), "ambiguous_candidates")
        .when(named, "instance_dispatch")
        .when(c("np") == 1, "java_di_primary")
        .when(c("np") > 1, "ambiguous_candidates")
        .when(c("n") == 1, "java_di_unique_impl")
        .when(c("n") > 1, "ambiguous_candidates")
        .otherwise("instance_dispatch")
    )
    target = F.when(kind == "java_di_qualifier", c("tq")).when(kind == "java_di_primary", c("tp")).when(kind == "java_di_unique_impl", c("t1")).when(kind == "instance_dispatch", c("self_target"))
    abstract = agg.select(*_REF, "prio", kind.alias("kind"), target.alias("target"), F.when(kind == "ambiguous_candidates", c("options")).alias("options"))
    plain = t.where("not is_abstract").select(*_REF, "prio", F.lit("instance_dispatch").alias("kind"), c("self_target").alias("target"), F.lit(None).cast("string").alias("options"))
    return abstract.unionByName(plain).where("target is not null or options is not null")


#: Characters of source text that a parsing task gets at most, and at least where cores would otherwise be idle.
PARSE_MOST, PARSE_LEAST = 4 << 20, 1 << 18


def spread(files: DataFrame) -> DataFrame:
    """files(path, language, text) over as many tasks as their size asks for, however few the files are that they are read from."""
    chars = files.agg(F.sum(F.length("text"))).first()[0] or 0
    cores = files.sparkSession.sparkContext.defaultParallelism
    return files.repartition(max(1, -(-chars // PARSE_MOST), min(-(-chars // PARSE_LEAST), 4 * cores)))


class Analysis:
    """The tables of one analysis of a source tree."""

    def __init__(self, spark: SparkSession, root: str, exclude: list[str] | None = None, languages: list[str] | None = None, nested: bool = False, numstat: DataFrame | None = None, doctypes: bool = False):
        self.spark, self.root, self.exclude, self.languages, self.nested, self.numstat = spark, root, exclude, languages, nested, numstat
        self.with_doctypes = doctypes
        self.scratch = Scratch(spark, "analysis")

    @classmethod
    def of_files(cls, spark: SparkSession, files: DataFrame, configs: dict[str, str] | None = None, **options) -> Analysis:
        """The analysis of files(path, language, text) that some other source gave, with the texts of configurations by path."""
        out = cls(spark, "", **options)
        out.files = out._table(files.select("path", "language", "text"), "files")
        out.configs = dict(configs or {})
        return out

    def _table(self, df: DataFrame, name: str) -> DataFrame:
        return self.scratch.table(df, name)

    @cached_property
    def configs(self) -> dict[str, str]:
        return tree.named_files(self.spark, self.root, ["apps.txt", "go.mod", "package.json", "pyproject.toml", "Cargo.toml", "pom.xml", "requirements*.txt", "tsconfig*.json", "jsconfig.json"])

    @cached_property
    def context(self) -> dict:
        return {"go_module": tree.go_module(self.configs), "configs": tree.script_configs(self.configs), "nested": self.nested}

    @cached_property
    def files(self) -> DataFrame:
        return self._table(tree.source_files(self.spark, self.root, self.exclude, self.languages), "files")

    @cached_property
    def parsed(self) -> DataFrame:
        return self._table(parsers.parse(spread(self.files), self.context), "parsed")

    @cached_property
    def parse_errors(self) -> DataFrame:
        return self.parsed.where("error is not null").select("file", "error")

    @cached_property
    def doctypes(self) -> DataFrame:
        found = tree.all_files(self.spark, self.root, ["*.json"])
        return self._table(doctypes.doctypes(found.select("path", F.expr("try_validate_utf8(cast(content as string))").alias("text"))), "doctypes")

    @cached_property
    def nodes(self) -> DataFrame:
        """One row a node id: the last by file of those that bear it."""
        rows = self.parsed.where("node is not null")
        if self.with_doctypes:
            one = F.lit(1)
            rows = rows.unionByName(
                self.doctypes.select("node", F.concat(F.lit("frappe.doctype."), "snake").alias("module"), F.col("snake").alias("qualname"), F.lit("doctype").alias("kind"), "file", F.lit("doctype").alias("language"), one.alias("start_line"), one.alias("end_line"), F.array("name").alias("declared")),
                allowMissingColumns=True,
            )
            empty = {c: F.coalesce(c, F.array().cast("array<string>")) for c, k in rows.dtypes if k == "array<string>"}
            empty |= {c: F.coalesce(c, F.create_map().cast("map<string,string>")) for c, k in rows.dtypes if k == "map<string,string>"}
            rows = rows.withColumns(empty | {c: F.coalesce(c, F.lit(False)) for c, k in rows.dtypes if k == "boolean"} | {"package": F.coalesce("package", F.lit(""))})
        order = Window.partitionBy("node").orderBy(F.desc("file"), F.desc("start_line"))
        return self._table(rows.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k", "error"), "nodes")

    @cached_property
    def candidates(self) -> DataFrame:
        return self._table(reference_candidates(self.nodes, self.context), "candidates")

    @cached_property
    def index(self) -> DataFrame:
        scripts = script_exports(self.nodes, self.context, self.scratch)
        return self._table(indices(self.nodes).withColumn("barrel", F.lit(False)).unionByName(scripts), "index")

    @cached_property
    def resolved(self) -> DataFrame:
        """(node, ref_kind, raw, kind, target, options) of every reference: the first candidate that exists; options where it is ambiguous."""
        c = F.col
        nodes, found, index = self.nodes, self.candidates, self.index
        # What the index alone decides, for all references at once; types are only gone through.
        hits = found.where("space not in ('typed', 'di', 'dotted', 'up')").join(index, ["space", "key"])
        hits = self._table(hits.select(*_REF, "prio", "kind", "target", "barrel"), "hits")
        first = hits.where("ref_kind in ('base', 'type')").groupBy(*_REF).agg(F.min(F.struct("prio", "target", "kind")).alias("b"))
        first = self._table(first.select(*_REF, "b.prio", "b.kind", "b.target"), "bases")
        inherits = first.where("ref_kind = 'base' and target <> node").select(c("node").alias("src"), c("target").alias("dst"))
        # A module of other languages repeats its classes' bases; only types inherit.
        inherits = inherits.join(nodes.where(c("kind").isin(*_TYPES)).select(c("node").alias("src")), "src", "left_semi")
        types = first.where("ref_kind = 'type'")
        named = types.select("node", "raw", "target")

        split = F.split("key", r"\|")
        typed = found.where("space = 'typed'").select(*_REF, "prio", "kind", split[0].alias("type"), split[1].alias("member"))
        typed = self._table(typed.join(named.select("node", c("raw").alias("type"), c("target").alias("class")), ["node", "type"]), "typed")
        wanted = self._table(found.where("space = 'di'").select(*_REF, "prio", split[0].alias("type"), split[1].alias("member"), split[2].alias("qualifier")), "wanted")
        of_types = nodes.where(c("kind").isin(*_TYPES))
        concrete = of_types.select("node", (c("kind").isin("class", "enum") & ~c("is_abstract")).alias("concrete"))
        declared = wanted.join(named.select("node", c("raw").alias("type"), c("target").alias("declared")), ["node", "type"]).select("declared", "member").distinct()
        abstract = declared.join(nodes.where("is_abstract").select(c("node").alias("declared")), "declared", "left_semi")
        closure = self._table(graph.subtype_closure(inherits, concrete, abstract.select(c("declared").alias("node"))), "closure")

        # Only the members that some reference asks for are looked up along the bases.
        of = lambda df, space, seed: df.select(F.lit(space).alias("space"), c(seed).alias("seed"), "member")
        asked = of(typed, "own", "class").unionByName(of(declared, "own", "declared"))
        asked = asked.unionByName(of(closure.join(abstract, c("base") == c("declared")), "own", "target"))
        asked = asked.unionByName(of(found.where("space = 'up'").select(split[0].alias("class"), split[1].alias("member")), "up", "class"))
        members = self._table(member_index(self._table(asked.distinct(), "asked"), inherits, nodes, self.scratch), "members")
        typed = typed.join(members.where("space = 'own'").select(c("key").alias("k"), "target"), F.concat_ws("|", "class", "member") == c("k")).select(*_REF, "prio", "kind", "target").withColumn("options", F.lit(None).cast("string"))
        di = injected(wanted, named, nodes, closure, members.where("space = 'own'"))
        up = found.where("space = 'up'").join(members, ["space", "key"]).select(*_REF, "prio", "kind", "target", F.lit(False).alias("barrel"))
        hits = hits.where("ref_kind in ('base', 'call', 'import')").unionByName(up)
        how = F.when(c("barrel") & c("kind").isin("import_exact", "alias_resolved"), "barrel_reexport").otherwise(c("kind"))
        hits = hits.select(*_REF, "prio", how.alias("kind"), "target").withColumn("options", F.lit(None).cast("string"))
        best = hits.unionByName(typed).unionByName(di.select(*_REF, "prio", "kind", "target", "options"))
        best = best.groupBy(*_REF).agg(F.min(F.struct("prio", F.col("target").isNull().alias("open"), "target", "kind", "options")).alias("b"))
        strings = self._table(found.where("space = 'dotted'").select(c("raw").alias("ref"), "node").distinct(), "strings")
        # Names that no string can mean need no grouping.
        meant = strings.select(F.explode(F.concat(F.array("ref"), resolve.suffixes(c("ref"), "."))).alias("name")).distinct()
        full = index.where("space = 'fq'").select(c("key").alias("name"), c("target").alias("node")).join(meant, "name", "left_semi")
        looked = resolve.dotted_lookup(strings, full, name_index(nodes).join(meant, "name", "left_semi")).withColumnRenamed("node", "target")
        texts = strings.join(looked, "ref").select("node", F.lit("string").alias("ref_kind"), c("ref").alias("raw"), F.lit("string_ref").alias("kind"), "target", F.lit(None).cast("string").alias("options"))
        return self._table(best.select(*_REF, "b.kind", "b.target", "b.options").unionByName(texts), "resolved")

    @cached_property
    def edges(self) -> DataFrame:
        """Merged edges; a call of oneself stays as a self-loop, other references to oneself are dropped."""
        names = F.create_map(*(F.lit(x) for x in ("base", "inheritance", "call", "call", "import", "import", "string", "string_ref")))
        rows = self.resolved.where("target is not null and (ref_kind = 'call' or target <> node)")
        raw = rows.select(F.col("node").alias("src"), F.col("target").alias("dst"), names[F.col("ref_kind")].alias("kind"), F.col("kind").alias("resolution"), F.concat(F.col("ref_kind"), F.lit(" "), F.col("raw")).alias("reason"))
        if self.with_doctypes:
            raw = raw.unionByName(doctypes.doctype_edges(self.doctypes, self.nodes, self.files))
        return self._table(resolve.merge_edges(raw.withColumn("score", resolve.resolution_score("resolution"))), "edges")

    @cached_property
    def external(self) -> DataFrame:
        """(node, ref_kind, raw): references without a target whose first part is imported, or imports that lead outside."""
        known = F.map_keys("import_modules"), F.map_keys("import_symbols")
        refs = self.candidates.where("ref_kind in ('base', 'call', 'import')").select(*_REF).distinct()
        # Imports of languages whose imports have no candidate are references too.
        more = self.nodes.select("node", F.lit("import").alias("ref_kind"), F.explode("imports").alias("raw"))
        refs = refs.unionByName(more).distinct().join(self.resolved.where("target is not null").select(*_REF), _REF, "left_anti")
        refs = refs.join(self.nodes.select("node", "import_modules", "import_symbols"), "node")
        head = F.substring_index("raw", ".", 1)
        imported = F.array_contains(known[0], head) | F.array_contains(known[1], head) | F.array_contains(known[1], F.col("raw"))
        inside = F.col("raw").startswith(".") | F.col("raw").startswith("crate") | F.col("raw").startswith("mod::") | F.col("raw").startswith("self::") | F.col("raw").startswith("super")
        return refs.where(((F.col("ref_kind") != "import") & imported) | ((F.col("ref_kind") == "import") & ~inside)).select(*_REF)

    # Signals

    @cached_property
    def spans(self) -> DataFrame:
        return self.nodes.select("node", "file", F.col("start_line").alias("start"), F.col("end_line").alias("stop"), "kind", "language", "class_context", "qualname")

    @cached_property
    def children(self) -> DataFrame:
        """(outer, inner): for modules all other nodes of the file, for containers the nodes of their class or below their name."""
        c = F.col
        a = self.spans.where(c("kind").isin(*CONTAINER_KINDS)).select(c("node").alias("outer"), "file", c("start").alias("s1"), c("stop").alias("e1"), c("kind").alias("outer_kind"), c("qualname").alias("outer_name"))
        b = self.spans.where("kind <> 'module'").select(c("node").alias("inner"), "file", c("start").alias("s2"), c("stop").alias("e2"), "class_context", "qualname")
        pairs = a.join(b, "file").where("s2 >= s1 and e2 <= e1 and outer <> inner")
        below = (c("class_context") == c("outer_name")) | c("qualname").startswith(F.concat("outer_name", F.lit(".")))
        return pairs.where((c("outer_kind") == "module") | below).select("outer", "inner")

    @cached_property
    def refs(self) -> DataFrame:
        """Evidence of all nodes: an executable's whole span, a container's lines outside its children."""
        lines = self._table(tree.file_lines(self.files), "lines")
        at = intervals.span_lines(self.spans.select("node", "file", "start", "stop", "kind", "language"))
        inner = self.children.join(at.select(F.col("node").alias("inner"), "lineno"), "inner").select(F.col("outer").alias("node"), "lineno").distinct()
        runs = F.col("kind").isin(*EXECUTABLE_KINDS)
        kept = at.where(runs).unionByName(at.where(~runs).join(inner, ["node", "lineno"], "left_anti"))
        own = kept.join(lines.select(F.col("path").alias("file"), "lineno", "text"), ["file", "lineno"]).select("node", "file", "language", "lineno", "text")
        own = self._table(own, "own")
        found = signals.match_lines(own).unionByName(signals.guard_windows(own))
        named = self.resolved.where("ref_kind = 'string'").groupBy(F.col("target").alias("node")).agg(F.count_distinct("node").alias("n"))
        dynamic = named.join(self.spans.select("node", "file", "start"), "node")
        return self._table(signals.evidence(found, dynamic), "refs")

    @cached_property
    def signals(self) -> DataFrame:
        return self._table(signals.node_signals(self.refs), "signals")

    @cached_property
    def guards(self) -> DataFrame:
        own = self.refs.where(F.col("signal").isin("auth_guard", "validation_guard", "error_handling")).select("node", "signal").distinct()
        return graph.guard_reach(self.edges, own)

    @cached_property
    def warnings(self) -> DataFrame:
        rows = self.signals.select("node", "signals").join(self.guards.select("node", F.split("guards", ",").alias("reachable")), "node", "left")
        return signals.arch_rules(rows)

    @cached_property
    def flows(self) -> DataFrame:
        return signals.flow_summary(signals.flow_steps(self.refs, self.spans.select("node", "kind", "start")))

    # Metrics

    @cached_property
    def metrics(self) -> DataFrame:
        """Every node with its degrees, component, layer, rank, centrality, change statistics, signals, risk and reasons."""
        names = self.nodes.select("node")
        pairs = self.edges.select("src", "dst")
        external = self.external.select("node")
        out = graph.degrees(names, pairs, external)
        for more in (graph.scc(names, pairs), graph.layers(names, pairs), graph.pagerank(names, pairs), graph.betweenness(names, pairs)):
            out = out.join(more, "node")
        loops = self.edges.where("src = dst").select(F.col("src").alias("node"), F.lit(True).alias("self_call"))
        bases = self.resolved.where("ref_kind = 'base' and target <> node").groupBy("node").agg(F.count_distinct("target").alias("n_bases"))
        out = out.join(loops, "node", "left").join(bases, "node", "left").na.fill(False, ["self_call"]).na.fill(0, ["n_bases"])
        out = out.join(self.nodes.select("node", "module", "kind", "language", "file", "start_line", "end_line"), "node")
        if self.numstat is not None:
            out = out.join(risk.hotness(self.numstat).select(F.col("path").alias("file"), F.col("hotness").alias("git_hotness")), "file", "left")
        else:
            out = out.withColumn("git_hotness", F.lit(0.0))
        out = out.join(self.signals.select("node", "signals", "weight"), "node", "left")
        out = out.withColumn("signals", F.coalesce("signals", F.array().cast("array<string>"))).na.fill(0.0, ["git_hotness", "weight"])
        return self._table(risk.reasons(risk.risk_scores(out), git=self.numstat is not None), "metrics")

    @cached_property
    def cycles(self) -> DataFrame:
        return graph.cycles(self.nodes.select("node"), self.edges.select("src", "dst"))

    @cached_property
    def modules(self) -> DataFrame:
        return risk.module_rollup(self.nodes.select("node", "module"), self.edges.select("src", "dst"))

    @cached_property
    def shadowless(self) -> DataFrame:
        """Nodes with signals that no better node of their file stands for."""
        fine = F.when(F.col("kind").isin(*EXECUTABLE_KINDS), 2).when(F.col("kind") != "module", 1).otherwise(0)
        rows = self.signals.join(self.spans, "node").select("node", "file", "signals", fine.alias("fineness"), (F.col("stop") - F.col("start")).alias("span"))
        return intervals.not_shadowed(rows)

    @cached_property
    def layout(self) -> DataFrame:
        return risk.layout(self.metrics.select("node", "module", "layer"))

    @cached_property
    def hooks(self) -> DataFrame:
        """Nodes that the dotted strings of a hooks.py name."""
        named = self.resolved.where("ref_kind = 'string'").join(self.nodes.where(F.col("file").rlike(r"(^|/)hooks\.py$")).select("node"), "node", "left_semi")
        return named.select(F.col("target").alias("node")).distinct()

    @cached_property
    def taint(self) -> DataFrame:
        """(node, sources, tainted): where executable nodes get input from outside, and which parameters carry it."""
        lines = tree.file_lines(self.files).select(F.col("path").alias("file"), "lineno", F.col("text").alias("line"))
        runs = self.nodes.where(F.col("kind").isin(*EXECUTABLE_KINDS))
        at = intervals.span_lines(runs.select("node", "file", F.col("start_line").alias("start"), F.col("end_line").alias("stop")))
        text = at.join(lines, ["file", "lineno"])
        text = text.groupBy("node").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("lineno", "line"))), lambda x: x["line"]), "\n").alias("text"))
        hooked = self.hooks.withColumn("hooked", F.lit(True))
        rows = runs.select("node", "kind", "language", "decorators", "params", "exported").join(text, "node", "left").join(hooked, "node", "left")
        return signals.taint_sources(rows)

    @cached_property
    def signal_nodes(self) -> DataFrame:
        """(node, kind, file, signals, weight, risk, ambiguous) of the nodes with signals that none shadows."""
        open_ = self.resolved.where("kind = 'ambiguous_candidates'").select("node").distinct().withColumn("ambiguous", F.lit(True))
        rows = self.shadowless.select("node").join(self.metrics.select("node", "kind", "file", "signals", "weight", "risk"), "node").join(open_, "node", "left")
        return rows.na.fill(False, ["ambiguous"])
