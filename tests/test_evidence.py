from weftline.operators import evidence

NODES = "node string, kind string, signals array<string>, weight double, risk double, ambiguous boolean"


def nodes(spark):
    rows = [
        ("a", "function", ["input_boundary", "database_io"], 5.5, 60.0, False),
        ("b", "module", ["process_io"], 2.9, 12.0, True),
        ("c", "function", ["error_handling"], 1.7, 0.0, False),
        ("d", "function", [], 0.0, 99.0, False),
        ("e", "method", ["state_mutation", "network_io", "auth_guard", "error_handling"], 9.5, 24.0, False),
    ]
    return spark.createDataFrame(rows, NODES)


def test_candidates_watch_rules_and_entrypoints(spark):
    got = [(r.node, r.score, r.why) for r in evidence.signal_candidates(nodes(spark)).orderBy("rank").collect()]
    assert got == [("e", 32.5, ["side_effect", "guard"]), ("a", 26.5, ["boundary", "side_effect", "structural_risk"]), ("b", 10.7, ["side_effect", "ambiguous"]), ("c", 5.1, ["guard"])]
    watch = {r.node: r.why for r in evidence.watchlist(nodes(spark)).collect()}
    assert watch == {"e": ["mutation_with_outside_effects", "rights_on_a_boundary", "effects_rely_on_error_handling"], "b": ["ambiguous_and_critical", "process_execution"]}
    assert [r.node for r in evidence.signal_entrypoints(nodes(spark)).collect()] == ["e", "a", "b"]
    assert {r.signal: r.n for r in evidence.nodes_by_signal(nodes(spark)).collect()}["error_handling"] == 2


def test_overview_priority_and_groups(spark):
    refs = spark.createDataFrame([("a", "f", "network_io"), ("b", "f", "network_io"), ("c", "g", "process_io"), ("c", "g", "caching")], "node string, file string, signal string")
    assert [(r.file, r.signals, r.weight, r.n_nodes) for r in evidence.files_by_weight(refs).collect()] == [("g", ["process_io", "caching"], 4.7, 1), ("f", ["network_io"], 2.6, 2)]
    rows = spark.createDataFrame([(50.0, 0.9, 9, 1, ["network_io"], 2.6, "function"), (10.0, None, 1, 0, [], 0.0, "class")], "risk double, best_score double, degree int, n_ambiguous int, signals array<string>, weight double, kind string")
    assert sorted(r.priority for r in evidence.evidence_priority(rows).collect()) == [11.0, 68.92]
    groups = spark.createDataFrame([("a", "r", ["x"], ["1"], 1.0), ("a", "r", ["y", "x"], ["2"], 3.0), ("a", "s", ["z"], [], 2.0)], "anchor string, role string, symbols array<string>, refs array<string>, score double")
    assert sorted((r.role, r.symbols, r.refs, r.score) for r in evidence.merge_groups(groups).collect()) == [("r", ["x", "y"], ["1", "2"], 3.0), ("s", ["z"], [], 2.0)]


def test_gaps_and_sequence(spark):
    rows = spark.createDataFrame([("q", "a", ["x", "y"], ["x"]), ("q", "b", ["x", "y"], []), ("q", "c", ["x"], ["x"])], "id string, node string, wanted array<string>, shown array<string>")
    assert [(r.node, r.missing) for r in evidence.flow_gaps(rows, 1).collect()] == [("b", ["x", "y"])]
    seq = spark.createDataFrame([("q", 2, 1, "m"), ("q", 1, 2, "n"), ("q", 1, 1, "m"), ("q", 3, 1, "o"), ("q", 3, 2, "p"), ("q", 3, 3, "r")], "id string, source int, position int, ref string")
    assert evidence.open_sequence(seq).first().refs == ["m", "n", "o", "p"]


def test_escalations(spark):
    schema = "id string, option string, outcome string, request string, signals array<string>, wanted array<string>, missing array<string>, targets int, lines int, files int, n_gaps int, n_ambiguous int"
    rows = [
        ("q", "all", "partial", "signal", ["network_io"], ["network_io"], ["network_io"], 1, 5, 1, 0, 0),
        ("q", "some", "unproven", "signal", ["network_io"], ["network_io"], ["network_io", "caching"], 2, 20, 2, 0, 0),
        ("q", "done", "confirmed", "symbol", [], [], [], 1, 5, 1, 0, 0),
        ("q", "apart", "ambiguous", "ambiguity", [], [], [], 1, 30, 1, 0, 1),
        ("q", "wrong", "ambiguous", "signal", ["network_io"], ["network_io"], [], 1, 5, 1, 0, 1),
        ("q", "none", "partial", "symbol", [], ["caching"], ["caching"], 0, 0, 0, 0, 0),
    ]
    out = evidence.escalations(spark.createDataFrame(rows, schema))
    got = {r.option: (r.cost, r.expected, r.blocked_by, r.confidence) for r in out.collect()}
    assert got == {
        "all": ("low", "confirmed", [], "high"),
        "some": ("medium", "partial", [], "medium"),
        "done": ("low", None, ["already_confirmed", "no_better_outcome"], "low"),
        "apart": ("high", "confirmed", [], "low"),
        "wrong": ("low", None, ["only_disambiguation_helps", "no_better_outcome"], "low"),
        "none": ("low", None, ["nothing_to_read", "no_better_outcome"], "low"),
    }
    assert [r.option for r in evidence.rank_escalations(out, 3).orderBy("rank").collect()] == ["all", "apart", "some"]
    budget = {r.option: (r.line_budget, r.slice_budget, r.file_budget) for r in evidence.followup_budget(out).collect()}
    assert budget == {"all": (8, 1, 1), "some": (24, 2, 2), "done": (8, 1, 1), "apart": (36, 1, 1), "wrong": (8, 1, 1), "none": (8, 1, 1)}
    kinds = {r.option: r.kind for r in evidence.followup_kind(out.withColumn("closes_gap", out.n_gaps > 0)).collect()}
    assert kinds == {"all": "semantic_confirmation", "some": "semantic_confirmation", "done": "focused_symbol_check", "apart": "ambiguity_resolution", "wrong": "semantic_confirmation", "none": "focused_symbol_check"}


def test_chains_and_order(spark):
    paths = spark.createDataFrame([("q", "p1", 1, "a"), ("q", "p1", 2, "b"), ("q", "p2", 1, "a"), ("q", "p2", 2, "c"), ("q", "p3", 1, "c")], "id string, path string, position int, node string")
    flows = spark.createDataFrame([("a", ["input_boundary", "output_boundary"]), ("b", ["database_io", "output_boundary"])], "node string, steps array<string>")
    got = [(r.path, r.chain, r.n_flows, r.complete) for r in evidence.flow_chains(paths, flows).collect()]
    assert got == [("p1", "input_boundary -> database_io -> output_boundary", 2, True), ("p2", "input_boundary", 1, False)]
    edges = spark.createDataFrame([("x", 1, "b", "c"), ("x", 2, "a", "b"), ("y", 1, "m", "n"), ("y", 2, "n", "m"), ("z", 1, "s", "t"), ("z", 2, "u", "v")], "id string, position int, src string, dst string")
    assert {r.id: r.nodes for r in evidence.ordered_nodes(edges).collect()} == {"x": ["a", "b", "c"], "y": ["m", "n"], "z": ["s", "t", "u", "v"]}


def test_paths_and_states_of_an_answer(spark):
    from types import SimpleNamespace

    from weftline.plans import ask

    edges = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.8), ("b", "a", 0.99), ("c", "d", 0.9), ("x", "a", 0.9)], "src string, dst string, score double")
    rows = ask.evidence_paths(SimpleNamespace(edges=edges), spark.createDataFrame([("a",)], "node string"))
    got = sorted((r.path, r.position, r.node, r.confidence) for r in rows.collect())
    assert got == [("a -> b", 0, "a", 0.9), ("a -> b", 1, "b", 0.9), ("a -> b -> c", 0, "a", 0.8), ("a -> b -> c", 1, "b", 0.8), ("a -> b -> c", 2, "c", 0.8)]
    flows = spark.createDataFrame([("a", ["input_boundary"]), ("b", ["output_boundary", "database_io"]), ("c", ["database_io", "output_boundary"])], "node string, steps array<string>")
    chains = {r.path: (r.chain, r.complete) for r in evidence.flow_chains(rows, flows).collect()}
    assert chains == {"a -> b": ("input_boundary -> output_boundary -> database_io", True), "a -> b -> c": ("input_boundary -> database_io -> output_boundary", True)}

    steps = spark.createDataFrame([("n", "s", 5, 5), ("n", "t", 70, 71), ("m", "s", 5, 6), ("o", "s", 200, 200), ("p", "s", 130, 130)], "node string, signal string, start int, stop int")
    spans = spark.createDataFrame([(n, "f") for n in "nmop"], "node string, file string")
    primary = spark.createDataFrame([("f", 1, 10)], "file string, start int, stop int")
    every = primary.union(spark.createDataFrame([("f", 60, 140)], "file string, start int, stop int"))
    assert {r.node: r.completeness for r in ask.flow_states(steps, spans, primary, every).collect()} == {"n": "partial", "m": "complete", "o": "missing", "p": "context_only"}
