import pytest
from pyspark.sql import functions as F

from weftline.functions import text as tx
from weftline.operators import contract, intervals, resolve, retrieve, signals


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "v string").select(expression(F.col("v")).alias("r")).first().r


def test_cascade_takes_the_first_hit(spark):
    refs = spark.createDataFrame([(1,), (2,), (3,), (4,)], "ref int")
    s = lambda rows: spark.createDataFrame(rows, "ref int, target string, kind string")
    got = resolve.cascade(refs, [s([(1, "a", "direct_symbol")]), s([(1, "b", "heuristic"), (2, "z", "heuristic"), (2, "y", "heuristic"), (3, None, "heuristic")]), s([(3, "late", "heuristic")])], ["ref"])
    assert {r.ref: (r.target, r.kind, r.score, r.label) for r in got.collect()} == {
        1: ("a", "direct_symbol", 0.99, "very_high"), 2: ("y", "heuristic", 0.65, "medium"), 3: (None, None, None, None), 4: (None, None, None, None),
    }


def test_a_doubled_name_is_not_unique(spark):
    index = spark.createDataFrame([("a", "n1"), ("a", "n1"), ("b", "n2")], "name string, node string")
    assert [tuple(r) for r in resolve.unique_names(index).collect()] == [("b", "n2")]


def test_edge_merge_keeps_the_best_provenance(spark):
    raw = spark.createDataFrame([("a", "b", "call", "heuristic", 0.65, "x"), ("a", "b", "import", "import_exact", 0.93, "y"), ("a", "b", "call", "import_exact", 0.93, "z")], "src string, dst string, kind string, resolution string, score double, reason string")
    r = resolve.merge_edges(raw).first()
    assert (r.kinds, r.resolution, r.score, r.label, r.reason) == ("call,import", "import_exact", 0.93, "high", "z")


def test_prefix_and_suffix_lookup(spark):
    refs = spark.createDataFrame([("crate::a::b",), ("other::x",)], "ref string")
    index = spark.createDataFrame([("crate", "0"), ("crate::a", "1")], "name string, node string")
    assert [tuple(r) for r in resolve.longest_prefix(refs, index).collect()] == [("crate::a::b", "crate::a", "1")]
    refs = spark.createDataFrame([("x.pkg.mod.f",), ("pkg.mod.f",), ("q.only",), ("q.twice",)], "ref string")
    full = spark.createDataFrame([("pkg.mod.f", "F"), ("mod.f", "G")], "name string, node string")
    short = spark.createDataFrame([("only", "O"), ("twice", "T"), ("twice", "T")], "name string, node string")
    assert {r.ref: (r.node, r.how) for r in resolve.dotted_lookup(refs, full, short).collect()} == {"x.pkg.mod.f": ("F", "suffix"), "pkg.mod.f": ("F", "exact"), "q.only": ("O", "unique")}


def test_ranges(spark):
    spans = spark.createDataFrame([("m", "f", 1, 10), ("m.a", "f", 2, 4), ("m.b", "f", 6, 8), ("x", "g", 2, 4)], "node string, file string, start int, stop int")
    lines = spark.createDataFrame([("f", k, str(k)) for k in range(1, 11)], "file string, lineno int, text string")
    own = {}
    for r in intervals.own_lines(lines, spans).collect():
        own.setdefault(r.node, []).append(r.lineno)
    assert {k: sorted(v) for k, v in own.items()} == {"m": [1, 5, 9, 10], "m.a": [2, 3, 4], "m.b": [6, 7, 8]}
    slices = spark.createDataFrame([("f", 1, 3, "a", 1.0), ("f", 5, 6, "b", 3.0), ("f", 9, 9, "c", 2.0), ("f", 2, 2, "d", 0.0)], "file string, start int, stop int, name string, score double")
    assert sorted((r.start, r.stop, r.names, r.score) for r in intervals.merge_slices(slices).collect()) == [(1, 6, "a,b,d", 3.0), (9, 9, "c", 2.0)]
    assert [r.node for r in intervals.covered(spans, slices).collect()] == []
    assert sorted(r.start for r in intervals.padded(slices.withColumn("last", F.lit(10))).collect()) == [1, 1, 2, 6]


def test_shadowed_nodes(spark):
    rows = [("outer", "f", ["a", "b"], 1, 20), ("inner", "f", ["a", "b", "c"], 2, 5), ("same", "f", ["c"], 2, 9), ("alone", "g", ["a"], 0, 1)]
    nodes = spark.createDataFrame(rows, "node string, file string, signals array<string>, fineness int, span int")
    assert sorted(r.node for r in intervals.not_shadowed(nodes).collect()) == ["alone", "inner"]


def lines_of(spark, text, language="python", node="n"):
    return spark.createDataFrame([(node, "f", language, k + 1, x) for k, x in enumerate(text.split("\n"))], "node string, file string, language string, lineno int, text string")


def test_guard_windows_count_own_lines(spark):
    code = "if not user.token:\n    pass\n    raise Denied()\nx = 1\nif value is None:\n    return None\nif a:\n    b()\n    c()\n    return 1\nnotify(x)"
    got = sorted((r.signal, r.start, r.stop) for r in signals.guard_windows(lines_of(spark, code)).collect())
    assert got == [("auth_guard", 1, 3), ("validation_guard", 5, 6)]


def test_evidence_limit_and_derived_signal(spark):
    refs = spark.createDataFrame([("n", "f", "network_io", 30, 30, "r")] + [("n", "f", "process_io", k, k, "r") for k in range(13)] + [("m", "f", "caching", 1, 1, "r")], "node string, file string, signal string, start int, stop int, reason string")
    got = signals.evidence(refs).collect()
    n = [r.signal for r in sorted(got, key=lambda r: r.rank) if r.node == "n"]
    assert n == ["process_io"] * 12  # the limit cuts the weaker ones, the derived one too
    assert sorted(r.signal for r in got if r.node == "m") == ["caching", "external_io"]
    s = {r.node: (r.signals, r.weight) for r in signals.node_signals(signals.evidence(refs)).collect()}
    assert s == {"n": (["process_io"], 2.9), "m": (["external_io", "caching"], 4.0)}


@pytest.mark.parametrize(
    "language, line, signal",
    [
        ("python", "r = requests.get(url)", "network_io"),
        ("python", "    self.total += 1", "state_mutation"),
        ("python", "if self.total == 1:", None),
        ("javascript", "const r = await fetch(u)", "network_io"),
        ("javascript", "function fetch(u) {", None),
        ("java", "@PreAuthorize(\"x\")", "auth_guard"),
        ("go", "if err != nil {", "error_handling"),
        ("go", "s.count = 3", "state_mutation"),
        ("rust", "let f = File::open(p)?;", "filesystem_io"),
        ("csharp", "_total = 3;", "state_mutation"),
        ("kotlin", "println(x)", "output_boundary"),
        ("php", "$_SESSION['a'] = 1;", "state_mutation"),
        ("ruby", "x = `ls`", "process_io"),
    ],
)
def test_patterns(spark, language, line, signal):
    found = {r.signal for r in signals.match_lines(lines_of(spark, line, language)).collect()}
    assert signal in found if signal else not found


def test_rules_and_flows(spark):
    rows = [("a", ["input_boundary"], None), ("b", ["input_boundary"], ["auth_guard"]), ("c", ["concurrency", "state_mutation", "caching"], None), ("d", [], ["auth_guard"]), ("e", ["input_boundary", "state_mutation"], ["validation_guard"])]
    nodes = spark.createDataFrame(rows, "node string, signals array<string>, reachable array<string>")
    got = sorted((r.node, r.rule) for r in signals.arch_rules(nodes).collect())
    assert got == [("a", "unguarded_entry"), ("c", "cache_coherence_risk"), ("c", "concurrent_mutation"), ("e", "stateful_input_boundary")]
    refs = spark.createDataFrame([("n", "f", s, k, k, "names a response object") for k, s in enumerate(["output_boundary", "input_boundary", "database_io", "database_io", "output_boundary"], 1)], "node string, file string, signal string, start int, stop int, reason string")
    runs = spark.createDataFrame([("n", "function", 1)], "node string, kind string, start int")
    r = signals.flow_summary(signals.flow_steps(refs, runs)).first()
    assert (r.path, r.boundary_first, r.ends_in_output) == ("input_boundary -> database_io -> output_boundary", True, True)


def test_taint(spark):
    rows = [("a", "function", "python", "x = os.environ['A']\ny = requests.get(u)", [], ["self", "u"], False, False), ("b", "function", "python", "pass", ["app.route"], [], False, False), ("c", "function", "typescript", "", [], ["q"], True, False), ("d", "class", "python", "sys.argv", [], [], False, False)]
    nodes = spark.createDataFrame(rows, "node string, kind string, language string, text string, decorators array<string>, params array<string>, exported boolean, hooked boolean")
    assert {r.node: (r.sources, r.tainted) for r in signals.taint_sources(nodes).collect()} == {"a": (["env_var", "external_api"], {"u": "env_var"}), "b": (["http_param"], {}), "c": (["http_param"], {"q": "http_param"})}


def test_names(spark):
    assert one(spark, "parseHTTPResponse2_ok", tx.identifier_tokens) == ["parsehttpresponse2", "parse", "http", "response", "2", "ok"]
    assert one(spark, "a/../b/./c//../d", tx.fold_path) == "b/d"
    assert one(spark, "pkg/sub/__init__.py", tx.module_of_path) == "pkg.sub"
    assert one(spark, "--A b!", tx.slug) == "a_b" and one(spark, "!!", tx.slug) == "item"
    assert one(spark, "a\r\nb\x0bc\n", tx.universal_lines) == ["a", "b", "c"]
    assert sorted(one(spark, "How is the userToken for di checked?", tx.query_tokens)) == ["checked", "di", "token", "user", "usertoken"]
    assert sorted(one(spark, "How is the userToken for di checked?", tx.strict_tokens)) == ["checked", "di", "usertoken"]


def test_candidates_by_mention_scope_and_cover(spark):
    q = retrieve.analyse_questions(spark.createDataFrame([("q", "How does saveOrder reach the database over the network?")], "id string, question string"))
    rows = [
        ("m:saveOrder", "saveOrder", "m.py", "function", 0.0, ["database_io", "network_io"], [], 0.0, False, True),
        ("m:half", "half", "m.py", "function", 0.0, ["database_io"], [], 0.0, False, False),
        ("m:Box", "Box", "m.py", "class", 0.0, [], ["database_io", "network_io"], 0.0, False, False),
        ("m:other", "other", "m.py", "function", 90.0, [], [], 1.0, False, False),
    ]
    nodes = spark.createDataFrame(rows, "node string, name string, file string, kind string, risk double, signals array<string>, contained array<string>, support double, ambiguous boolean, leads boolean")
    named = spark.createDataFrame([("q", "m:saveOrder")], "id string, node string")
    got = {r.node: r.score for r in retrieve.rank_candidates(q, nodes, 10, named).collect()}
    wanted = q.first()
    assert set(wanted.signals) == {"database_io", "network_io"} and wanted.scope == "path"
    # 16 by name, 4.5 for three words (saveorder, save, order), 16 for two signals, 4 for their share, 3.5 as a function, 10 for all of them, 1.5 on a path
    assert got["m:saveOrder"] == 16 + 4.5 + 16 + 4 + 3.5 + 10 + 1.5
    # one of two signals, and nothing that ties it to the question
    assert got["m:half"] == 8 + 2 + 3.5 - 4 - 10
    assert got["m:Box"] == 6 + 1.5 + 0.5 - 2 + 1.5 - 3 and "m:other" not in got


def test_budget_skips_and_goes_on(spark):
    rows = spark.createDataFrame([("q", k, c) for k, c in enumerate([50, 60, 30, 40, 5])], "g string, key int, cost int")
    got = {r.key: r.taken for r in retrieve.within_budget(rows, "g", ["key"], "cost", 100, first=1, share=0.9).collect()}
    assert got == {0: True, 1: False, 2: True, 3: False, 4: True}


def test_questions(spark):
    q = retrieve.analyse_questions(spark.createDataFrame([("q", "How does saveOrder reach the database and validate the request?")], "id string, question string"))
    r = q.first()
    assert "explain_flow" in r.intents and "validation" in r.intents and set(r.signals) >= {"validation_guard", "database_io", "network_io"}
    assert r.scope == "path"
    names = spark.createDataFrame([("a:saveOrder", ["saveOrder"], "function", 3), ("a:x", ["data.base"], "class", 3), ("a:y", ["the.database"], "class", 9), ("a:z", ["request"], "class", 1)], "node string, forms array<string>, kind string, span int")
    assert [(x.node, x.score) for x in sorted(retrieve.mentions(q, names).collect(), key=lambda x: x.rank)] == [("a:y", 14.0), ("a:saveOrder", 9.0)]
    files = spark.createDataFrame([("src/database.py",), ("src/other.py",)], "file string")
    assert [(x.file, x.score) for x in retrieve.file_mentions(q, files).collect()] == [("src/database.py", 10.0)]
    nodes = spark.createDataFrame(
        [("a:saveOrder", "saveOrder", "a.py", "function", 50.0, ["database_io"], [], 0.9, False), ("a:other", "other", "a.py", "function", 90.0, [], [], 0.9, False), ("a", "a", "order.py", "module", 10.0, [], ["database_io"], 0.0, False)],
        "node string, name string, file string, kind string, risk double, signals array<string>, contained array<string>, support double, ambiguous boolean",
    )
    assert [x.node for x in sorted(retrieve.rank_candidates(q, nodes).collect(), key=lambda x: x.rank)] == ["a:saveOrder", "a"]
    flows = spark.createDataFrame([("p", "complete", 1, 2), ("r", "context_only", 0, 2), ("s", "missing", 0, 0)], "id string, completeness string, covered int, wanted int")
    open_ = spark.createDataFrame([("r",)], "id string")
    assert {x.id: x.outcome for x in retrieve.outcome_mode(flows, open_).collect()} == {"p": "confirmed", "r": "ambiguous", "s": "unproven"}


def test_read_order(spark):
    rows = [("all", ["a", "b"], ["a", "x", "b"]), ("none", ["a"], []), ("off", ["a"], ["x"]), ("part", ["a", "b"], ["a", "c"]), ("free", [], ["z"]), ("short", ["a", "b"], ["a"])]
    got = contract.read_order(spark.createDataFrame(rows, "id string, required array<string>, observed array<string>")).collect()
    assert {r.id: (r.matched, r.ratio, r.missing, r.diverged_at, r.sequence_status) for r in got} == {
        "all": (2, 1.0, [], None, "complete_in_order"), "none": (0, 0.0, ["a"], None, "not_started"), "off": (0, 0.0, ["a"], 1, "diverged_before_start"),
        "part": (1, 0.5, ["b"], 2, "partial_with_divergence"), "free": (0, 1.0, [], None, "no_requirements"), "short": (1, 0.5, ["b"], 2, "partial_with_divergence"),
    }


def test_contract(spark):
    base = dict(
        allowed_claims=["ok"], disallowed_claims=["bad"], required_read_order_refs=["s1", "s2"], required_primary_symbols=["f"], valid_stop_conditions=["done"], supported_states=["completed_within_bounds", "in_progress"], rules=[],
        expected_ceiling="partial", minimum_honest="ambiguous", followup_allowed=False, inspected_slice_refs=["s1", "s2"], inspected_symbols=["f"], used_claims=["ok"], final_claim="ok", final_outcome="partial", stop_condition="done",
        completion_state="completed_within_bounds", followup_used=False,
    )
    cases = {
        "fine": {}, "claim": {"used_claims": ["bad"]}, "high": {"final_outcome": "confirmed"}, "low": {"final_outcome": "unproven"}, "order": {"inspected_slice_refs": ["s2", "s1"]}, "primary": {"inspected_symbols": []},
        "stop": {"stop_condition": ""}, "follow": {"followup_used": True}, "unset": {"final_outcome": None}, "open": {"completion_state": "in_progress", "final_outcome": "", "inspected_slice_refs": None, "stop_condition": ""},
        "ambiguous": {"rules": ["must_not_claim_uniqueness_while_ambiguous"]},
    }
    schema = "id string, " + ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'boolean' if isinstance(v, bool) else 'string'}" for k, v in base.items())
    rows = spark.createDataFrame([(k, *(base | v).values()) for k, v in cases.items()], schema)
    got = {r.id: r for r in contract.result_report(contract.validate(rows)).collect()}
    assert {k: r.violations for k, r in got.items()} == {
        "fine": [], "claim": ["must_respect_allowed_claims", "must_not_use_disallowed_claims"], "high": ["must_not_exceed_outcome_ceiling"], "low": ["must_not_drop_below_minimum_honest_outcome"],
        "order": ["must_read_primary_slice_first", "must_read_required_sequence_for_terminal_result"], "primary": ["must_cover_required_primary_symbols_for_terminal_result"], "stop": ["must_stop_when_completion_criteria_met"],
        "follow": ["must_not_open_followup_when_disabled"], "unset": ["must_set_final_outcome_for_terminal_result"], "open": [], "ambiguous": ["must_not_claim_uniqueness_while_ambiguous"],
    }
    assert got["fine"].valid and got["fine"].status == "accepted" and got["high"].capped_outcome == "partial" and got["open"].status == "open"


def test_calls_of_fetch_are_no_definitions(spark):
    rows = ["async fetch(url) {", "fetch(x) {", "export function fetch(u) {", "static async fetch(a, b) { return 1 }", "$fetch('/x')", "axios.defaults", "this.fetch(1)"]
    calls = ["const r = await fetch('/x')", "return fetch(u)", "axios.get('/x')", "axios(o)", "fetch('/a').then(x => { go(x) })"]
    lines = spark.createDataFrame([(f"n{k}", "f.js", "javascript", k + 1, x) for k, x in enumerate(rows + calls)], "node string, file string, language string, lineno int, text string")
    got = {r["node"] for r in signals.match_lines(lines).where("signal = 'network_io'").collect()}
    assert got == {f"n{len(rows) + k}" for k in range(len(calls))}


def test_flow_keeps_the_output_of_a_single_line(spark):
    refs = [("a", "f", "output_boundary", 5, 5, "prints"), ("b", "f", "output_boundary", 5, 5, "Names a Response Object"), ("b", "f", "database_io", 7, 7, "q")]
    refs += [("c", "f", "output_boundary", 3, 3, "prints"), ("c", "f", "config_access", 3, 3, "x"), ("c", "f", "database_io", 9, 9, "q"), ("c", "f", "output_boundary", 9, 9, "prints")]
    refs = spark.createDataFrame(refs, "node string, file string, signal string, start int, stop int, reason string")
    nodes = spark.createDataFrame([("a", "function", 5), ("b", "function", 5), ("c", "function", 1)], "node string, kind string, start int")
    got = sorted((r["node"], r["step"], r["signal"], r["start"]) for r in signals.flow_steps(refs, nodes).collect())
    assert [r for r in got if r[0] == "a"] == [("a", 1, "output_boundary", 5)]
    assert [r for r in got if r[0] == "b"] == [("b", 1, "database_io", 7)]
    assert [(r[2], r[3]) for r in got if r[0] == "c"] == [("config_access", 3), ("database_io", 9), ("output_boundary", 9)]


def test_ranges_of_many_blocks(spark):
    import random

    rng = random.Random(6)
    rows = [(f"n{k}", f"f{k % 2}", s, s + rng.choice([0, 3, 70, 900])) for k in range(120) for s in [rng.randrange(1, 1500)]]
    spans = spark.createDataFrame(rows, "node string, file string, start int, stop int")
    pairs = [(a, b) for a in rows for b in rows if a[1] == b[1]]
    inside = lambda a, b: b[2] >= a[2] and b[3] <= a[3]
    assert sorted(map(tuple, intervals.contained(spans).collect())) == sorted((a[0], b[0]) for a, b in pairs if a[0] != b[0] and inside(a, b))
    got = intervals.overlapping(spans, spans.withColumnRenamed("node", "target")).select("node", "target").collect()
    assert sorted(map(tuple, got)) == sorted((a[0], b[0]) for a, b in pairs if a[2] <= b[3] and b[2] <= a[3])
    few = spans.where("stop - start > 60")
    assert {r[0] for r in intervals.covered(spans, few).collect()} == {b[0] for a, b in pairs if a[3] - a[2] > 60 and inside(a, b)}
