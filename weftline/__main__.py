"""python -m weftline ROOT: analyse a source tree, ask about it, compare reports, check a worker's result."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from weftline.operators import contract
from weftline.plans import ask, report
from weftline.plans.analysis import Analysis
from weftline.sources import tree

_RESULT = (
    "allowed_claims array<string>, disallowed_claims array<string>, required_read_order_refs array<string>, required_primary_symbols array<string>, valid_stop_conditions array<string>, supported_states array<string>, "
    "rules array<string>, expected_ceiling string, minimum_honest string, followup_allowed boolean, inspected_slice_refs array<string>, inspected_symbols array<string>, used_claims array<string>, final_claim string, "
    "final_outcome string, stop_condition string, completion_state string, followup_used boolean"
)


def check_result(spark: SparkSession, terms: dict, result: dict) -> dict:
    """The verdict on one worker's result under its contract."""
    both = terms | result
    names = [c.split()[0] for c in _RESULT.split(", ")]
    row = spark.createDataFrame([tuple(both.get(n) for n in names)], _RESULT)
    out = contract.result_report(contract.validate(row)).first().asDict()
    return {k: out[k] for k in ("valid", "violations", "warnings", "accepted", "rejected", "capped_outcome", "status", "accepted_mode", "next_action")}


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="weftline", description=__doc__)
    p.add_argument("root", nargs="?", default=".")
    p.add_argument("--out", default="report.json", help="where the summary goes")
    p.add_argument("--tables", help="a folder for nodes and edges as JSON lines")
    p.add_argument("--markdown", help="where the summary goes as Markdown")
    p.add_argument("--bundle-dir", help="a folder for the summary, slices and reading order")
    group = p.add_mutually_exclusive_group()
    group.add_argument("--ask", help="a question about the tree")
    group.add_argument("--question-file", help="a file with the question")
    p.add_argument("--ask-lines", type=int, default=110, help="lines that an answer may hold")
    p.add_argument("--top", type=int, default=20)
    p.add_argument("--exclude", action="append", default=[], help="globs of folders, paths or names to leave out")
    p.add_argument("--language", action="append", default=[], help="languages to read")
    p.add_argument("--numstat", help="a text file with the numstat lines of the change log")
    p.add_argument("--nested", action="store_true", help="read functions within functions")
    p.add_argument("--doctypes", action="store_true", help="read document types kept as JSON")
    p.add_argument("--diff", nargs=2, metavar=("OLD", "NEW"), help="compare two summaries")
    p.add_argument("--why", metavar="SYMBOL", help="explain a symbol of the tree")
    p.add_argument("--validate-result", metavar="FILE", help="a worker's result to check")
    p.add_argument("--against", metavar="FILE", help="the answer or contract that it is checked against")
    o = p.parse_args(argv)
    spark = SparkSession.builder.appName("weftline").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    if o.diff:
        old, new = (report.load(spark, x) for x in o.diff)
        for r in report.compare(spark, old, new).collect():
            print(f"{r['status']:<10} {r['symbol']}  {r['old_risk']} -> {r['new_risk']}")
        return 0
    if o.validate_result:
        if not o.against:
            p.error("--validate-result needs --against")
        terms = json.loads(Path(o.against).read_text())
        verdict = check_result(spark, terms.get("contract", terms), json.loads(Path(o.validate_result).read_text()))
        Path(o.out).write_text(json.dumps(verdict, indent=2, sort_keys=True))
        return int(not verdict["valid"])
    changes = tree.numstat(spark.read.text(o.numstat)) if o.numstat else None
    a = Analysis(spark, str(Path(o.root).resolve()), o.exclude or None, o.language or None, o.nested, changes, o.doctypes)
    if o.why:
        print(json.dumps(ask.why(a, o.why), indent=2, default=str))
        return 0
    question = o.ask or (Path(o.question_file).read_text().strip() if o.question_file else "")
    if not o.doctypes and tree.framework_probe(a.configs):
        print("This tree seems to keep document types as JSON; --doctypes reads them.", file=sys.stderr)
    out = report.summary(a, max(1, o.top))
    answer = ask.ask(a, question, o.ask_lines) if question else None
    if answer:
        out["answer"] = answer
    Path(o.out).write_text(json.dumps(out, indent=2, sort_keys=True, default=str))
    if o.markdown:
        Path(o.markdown).write_text(report.markdown(out))
    if o.tables:
        report.write_tables(a, o.tables)
    if o.bundle_dir:
        report.write_bundle(a, o.bundle_dir, max(1, o.top), answer)
    return 0


if __name__ == "__main__":
    sys.exit(main())
