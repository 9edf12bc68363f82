"""Answering questions: what a question mentions, how nodes match it, and which slices fit a budget of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.constants import BOUNDARY, COMPLETENESS_ORDER, EXECUTABLE_KINDS, GENERIC_WORDS, INTENT_WORDS, SIGNAL_WORDS
from weftline.functions.text import compact_text, has_keyword, identifier_tokens, query_tokens, spaced_text, strict_tokens


def _named(test_of: dict[str, tuple[str, ...]]) -> Column:
    def any_of(words: tuple[str, ...]) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | has_keyword("question", "tokens", w)
        return out

    return F.array_compact(F.array(*(F.when(any_of(words), F.lit(name)) for name, words in test_of.items())))


def analyse_questions(questions: DataFrame) -> DataFrame:
    """questions(id, question) with plain (spaced text), compact, tokens, strict, intents and signals (arrays), and scope.

    tokens are the question's words and the parts of its identifiers, strict
    its words alone; keywords are looked up among tokens. scope is the kind of
    evidence to prefer: symbol, path, boundary, risk or semantic.
    """
    out = questions.withColumn("plain", spaced_text("question")).withColumn("compact", compact_text("question"))
    out = out.withColumn("tokens", query_tokens("question")).withColumn("strict", strict_tokens("question"))
    out = out.withColumn("intents", _named(INTENT_WORDS)).withColumn("signals", _named(SIGNAL_WORDS))
    on_path = F.lit(False)
    for w in ("how", "path", "flow", "reach", "before", "after"):
        on_path = on_path | F.col("plain").contains(w)
    some = lambda c, names: F.size(F.array_intersect(c, F.array(*map(F.lit, names)))) > 0
    scope = (
        F.when(F.array_contains("intents", "ambiguity_resolution") | F.col("plain").contains("smallest slice"), "symbol")
        .when(on_path, "path")
        .when(some("intents", ("auth", "validation")) | some("signals", (*BOUNDARY, "auth_guard", "validation_guard")), "boundary")
        .when(F.array_contains("intents", "architecture"), "risk")
        .when(F.size("signals") > 0, "semantic")
        .otherwise("symbol")
    )
    return out.withColumn("scope", scope)


#: Questions up to which they are broadcast.
QUESTIONS = 1_000


def _few(questions: DataFrame) -> DataFrame:
    """The stated questions, marked for broadcast if counted few."""
    return F.broadcast(questions) if questions.limit(QUESTIONS + 1).count() <= QUESTIONS else questions


def mentions(questions: DataFrame, names: DataFrame, limit: int = 8) -> DataFrame:
    """(id, node, score, rank): the nodes that analysed questions mention, from names(node, forms, kind, span).

    forms are what a node may be called, the most telling first; the i-th form
    (from 0) gives 14 - i as a phrase of several words within the question,
    9 - i as a single word of five letters or more among its words that is not
    a generic one, 11 - i if both are equal without separators. A node without
    such a form gets 1.5 for each part of its first form among the words, 6 at
    most, if there are two, or 3.5 for one of eight letters or more. At one
    score executable nodes go first, then shorter ones, then by name.
    Up to QUESTIONS questions are broadcast.
    """
    q = questions.select("id", "plain", "compact", "strict")
    pairs = names.crossJoin(_few(q))  # a stated set of questions against all names

    def scored(form: Column, i: Column) -> Column:
        words, flat = spaced_text(form), compact_text(form)
        lone = ~words.contains(" ") & F.array_contains("strict", words)
        return (
            F.when(words.contains(" ") & F.col("plain").contains(words), 14.0 - i)
            .when(lone & (F.length(words) >= 5) & ~words.isin(*GENERIC_WORDS), 9.0 - i)
            .when((F.length(flat) >= 5) & (flat == F.col("compact")), 11.0 - i)
            .otherwise(0.0)
        )

    best = F.array_max(F.transform("forms", scored))
    common = F.array_sort(F.filter(F.array_intersect(identifier_tokens(F.get("forms", F.lit(0))), "strict"), lambda t: ~t.isin(*GENERIC_WORDS)))
    few = F.when(F.size(common) >= 2, F.least(F.lit(6.0), 1.5 * F.size(common))).when(F.length(F.get(common, F.lit(0))) >= 8, 3.5).otherwise(0.0)
    order = Window.partitionBy("id").orderBy(F.desc("score"), F.desc(F.col("kind").isin(*EXECUTABLE_KINDS)), "span", "node")
    pairs = pairs.withColumn("best", best).withColumn("score", F.when(F.col("best") > 0, F.col("best")).otherwise(few)).where("score > 0")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("id", "node", "score", "rank")


def file_mentions(questions: DataFrame, files: DataFrame, limit: int = 6) -> DataFrame:
    """(id, file, score, rank) of files(file): 12 for its name as a phrase, 10 for its stem as a word, 8 for equality without separators."""
    base = F.regexp_replace("file", "^.*/", "")
    stem = F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")
    pairs = files.select("file").distinct().crossJoin(_few(questions.select("id", "plain", "compact", "strict")))
    words = spaced_text(base)
    score = (
        F.when(words.contains(" ") & F.col("plain").contains(words), 12.0)
        .when(F.array_contains("strict", spaced_text(stem)), 10.0)
        .when((F.length(compact_text(stem)) >= 5) & (compact_text(stem) == F.col("compact")), 8.0)
        .otherwise(0.0)
    )
    order = Window.partitionBy("id").orderBy(F.desc("score"), "file")
    pairs = pairs.withColumn("score", score).where("score > 0")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("id", "file", "score", "rank")


def rank_candidates(questions: DataFrame, nodes: DataFrame, limit: int = 10, named: DataFrame | None = None, named_files: DataFrame | None = None) -> DataFrame:
    """(id, node, score, rank) of nodes(node, name, file, kind, risk, signals, contained, support, ambiguous, leads) for analysed questions.

    named(id, node) and named_files(id, file) are what the questions mention.
    The score adds up:

    * 16 for a mentioned node, else 9 if its last name stands in the question; 9 for a mentioned file, else 4 for its stem;
      1.5 for each other word in common, 6 at most, generic words apart,
    * 8 for each signal asked for that the node shows itself, 3 for each that it contains, 4 and 1.5 times the shares of those,
      less 2 if it only contains some; risk / 18 up to 5; 2.5 times the best edge's score; a bonus for executable and a malus for module nodes,
    * 5 if calls of the node are ambiguous and the question is about that or mentions it,
    * for several signals: 10 for all of them, 1.5 for all contained; less for a part, and less still if the question is about a path and nothing ties the node to it,
    * up to 2 for what the question's scope prefers.

    leads, which may be absent, tells whether an edge leaves the node. Nodes without a word, signal
    or mention in common do not count.
    """
    q = questions.select("id", "tokens", "compact", "scope", F.col("signals").alias("wanted"), "intents")
    n = nodes if "leads" in nodes.columns else nodes.withColumn("leads", F.lit(False))
    n = n.withColumn("parts", identifier_tokens(F.concat_ws(" ", "name", "file")))
    pairs = n.crossJoin(_few(q))  # a stated set of questions against all nodes
    for rows, by, mark in ((named, "node", "by_name"), (named_files, "file", "by_file")):
        if rows is None:
            pairs = pairs.withColumn(mark, F.lit(False))
        else:  # a few a question, as mentions and file_mentions limit them
            pairs = pairs.join(rows.select("id", by).distinct().withColumn(mark, F.lit(True)), ["id", by], "left").withColumn(mark, F.coalesce(mark, F.lit(False)))
    common = F.array_except(F.array_intersect("parts", "tokens"), F.array(*map(F.lit, GENERIC_WORDS)))
    words = F.size(common)
    last, stem = compact_text(F.element_at(F.split("name", r"\."), -1)), compact_text(F.regexp_replace(F.regexp_replace("file", "^.*/", ""), r"(?<=.)\.[^.]*$", ""))
    within_question = lambda x: (x != "") & F.col("compact").contains(x)
    by_name, by_file = F.col("by_name"), F.col("by_file")
    lexical = F.when(by_name, 16.0).when(within_question(last), 9.0).otherwise(0.0) + F.when(by_file, 9.0).when(within_question(stem), 4.0).otherwise(0.0) + F.least(F.lit(6.0), 1.5 * words)
    anchored = by_name | by_file | (words >= 2) | F.exists(common, lambda t: F.length(t) >= 8)

    shown = F.array_intersect("signals", "wanted")
    direct, within, asked = F.size(shown), F.size(F.array_intersect("contained", "wanted")), F.size("wanted")
    cover = lambda k: F.when(asked > 0, k / asked).otherwise(0.0)
    runs = F.col("kind").isin(*EXECUTABLE_KINDS)
    kind = F.when(runs, 3.5).when(F.col("kind") == "module", -2.0).otherwise(0.5)
    about = F.col("ambiguous") & (F.array_contains("intents", "ambiguity_resolution") | by_name)
    base = 8.0 * direct + 3.0 * within + F.least(F.col("risk") / 18, F.lit(5.0)) + 2.5 * F.col("support") + 4.0 * cover(direct) + 1.5 * cover(within) + kind
    base = base + F.when(about, 5.0).otherwise(0.0) - F.when((direct == 0) & (within > 0), 2.0).otherwise(0.0)

    scope = F.col("scope")
    loose = lambda malus: F.when((scope == "path") & ~anchored, malus).otherwise(0.0)
    several = (
        F.when(asked < 2, 0.0)
        .when(direct == asked, 10.0)
        .when(direct > 0, -8.0 * (1 - cover(direct)) - loose(10.0))
        .when(within == asked, 1.5 - F.when(scope == "path", 3.0).otherwise(0.0))
        .when(within > 0, -6.0 * (1 - cover(within)) - 4.0 - loose(6.0))
        .otherwise(-loose(3.0))
    )
    limits = F.array(*map(F.lit, (*BOUNDARY, "auth_guard", "validation_guard")))
    preferred = (
        F.when((scope == "path") & runs & F.col("leads"), 1.5)
        .when((scope == "boundary") & (F.size(F.array_intersect(shown, limits)) > 0), 2.0)
        .when((scope == "semantic") & (direct > 0), 2.0)
        .when((scope == "symbol") & by_name, 2.0)
        .otherwise(0.0)
    )
    pairs = pairs.where((words > 0) | (direct > 0) | (within > 0) | by_name | by_file).withColumn("score", F.round(lexical + base + several + preferred, 4))
    order = Window.partitionBy("id").orderBy(F.desc("score"), F.desc(runs), F.desc("risk"), "node")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("id", "node", "score", "rank")


def within_budget(rows: DataFrame, group: str, order: list[Column | str], cost: str, budget: int, first: int = 1, share: float = 1.0) -> DataFrame:
    """rows with taken: in order, the first `first` of a group always, and each later one that still fits into floor(share * budget).

    One that does not fit is skipped and later, smaller ones may fit, so this
    is a fold over the group's rows, which are candidates of one question: a
    few tens. rows needs a column `key` that is unique within the group.
    """
    limit = int(share * budget)
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    all_of = ranked.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("_rank", "key", F.col(cost).cast("long").alias("cost")))).alias("rows"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("keys"))

    def step(a: Column, r: Column) -> Column:
        fits = (r["_rank"] <= first) | (a["used"] + r["cost"] <= limit)
        return F.struct(F.when(fits, a["used"] + r["cost"]).otherwise(a["used"]).alias("used"), F.when(fits, F.array_append(a["keys"], r["key"].cast("string"))).otherwise(a["keys"]).alias("keys"))

    taken = all_of.select(group, F.explode(F.aggregate("rows", start, step)["keys"]).alias("_key")).withColumn("taken", F.lit(True))
    out = ranked.withColumn("_key", F.col("key").cast("string")).join(taken, [group, "_key"], "left")
    return out.withColumn("taken", F.coalesce("taken", F.lit(False))).drop("_rank", "_key")


def completeness(rows: DataFrame) -> DataFrame:
    """rows(wanted, direct, context: arrays of slice refs) with completeness: complete, partial, context_only or missing."""
    have = F.size(F.array_intersect("wanted", "direct"))
    state = F.when((F.size("wanted") > 0) & (have == F.size("wanted")), "complete").when(have > 0, "partial").when(F.size(F.array_intersect("wanted", "context")) > 0, "context_only").otherwise("missing")
    return rows.withColumn("completeness", state)


def outcome_mode(flows: DataFrame, ambiguous: DataFrame) -> DataFrame:
    """(id, outcome): what may honestly be said, from flows(id, completeness, covered, wanted) and ambiguous(id).

    An open ambiguity goes first; then a complete flow or one that covers all
    wanted signals is confirmed, any other evidence is partial, none unproven.
    """
    rank = F.create_map(*(F.lit(x) for k, v in COMPLETENESS_ORDER.items() for x in (k, v)))[F.col("completeness")]
    best = flows.groupBy("id").agg(F.max(rank).alias("r"), F.max(F.when(F.col("wanted") > 0, F.col("covered") / F.col("wanted"))).alias("share"))
    open_ = ambiguous.select("id").distinct().withColumn("a", F.lit(True))
    out = best.join(open_, "id", "full_outer")
    mode = F.when(F.col("a"), "ambiguous").when((F.col("r") == 3) | (F.col("share") >= 1), "confirmed").when((F.col("r") >= 1) | (F.col("share") > 0), "partial").otherwise("unproven")
    return out.select("id", mode.alias("outcome"))


def escalation_cost(rows: DataFrame) -> DataFrame:
    """rows(targets, lines, files: counts) with cost: low, medium or high."""
    low = (F.col("targets") <= 1) & (F.col("lines") <= 8) & (F.col("files") <= 1)
    medium = (F.col("targets") <= 2) & (F.col("lines") <= 24) & (F.col("files") <= 2)
    return rows.withColumn("cost", F.when(low, "low").when(medium, "medium").otherwise("high"))
