"""Command line: check, rewrite, rules, version.

Exit codes: 0 done, 2 input or output failed, 3 a model pass failed, 4 wrong usage.
"""

from __future__ import annotations

import argparse
import json
import sys

from quillmark import __version__
from quillmark.functions.catalogue import RULES
from quillmark.operators.masking import UsageError

OK, IO_ERROR, MODEL_ERROR, USAGE_ERROR = 0, 2, 3, 4


class _Parser(argparse.ArgumentParser):
    def error(self, message):
        self.print_usage(sys.stderr)
        self.exit(IO_ERROR, f"{self.prog}: {message}\n")


def parser() -> argparse.ArgumentParser:
    shared = argparse.ArgumentParser(add_help=False)
    shared.add_argument("--pretty", action="store_true", help="indented JSON")
    model = argparse.ArgumentParser(add_help=False)
    model.add_argument("--judge-bin", default="judge", help="program that answers prompts")
    model.add_argument("--model", default="")
    p = _Parser(prog="quillmark")
    sub = p.add_subparsers(dest="verb", required=True, parser_class=_Parser)
    c = sub.add_parser("check", parents=[shared, model])
    c.add_argument("path", nargs="?")
    c.add_argument("--lang", default="auto")
    c.add_argument("--llm", action=argparse.BooleanOptionalAction)
    c.add_argument("--llm-deep", action=argparse.BooleanOptionalAction)
    c.add_argument("--llm-effort")
    c.add_argument("--timeout", type=float, default=60)
    r = sub.add_parser("rewrite", parents=[shared, model])
    r.add_argument("path", nargs="?")
    r.add_argument("--rules", default="")
    r.add_argument("--timeout", type=float, default=20)
    u = sub.add_parser("rules", parents=[shared])
    u.add_argument("--category")
    u.add_argument("--llm-only", action="store_true")
    sub.add_parser("version", parents=[shared])
    return p


def _session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master("local[*]").appName("quillmark").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _rule(r: dict) -> dict:
    names = {"id": "id", "name": "name", "category": "category", "description": "description", "tip": "tip", "can_remove": "canRemove", "color": "color", "bg_color": "bgColor", "requires_llm": "requiresLLM", "llm_tier": "llmTier", "llm_detection_hint": "llmDetectionHint", "rewrite_hint": "rewriteHint", "llm_directive": "llmDirective"}
    return {to: r[k] for k, to in names.items() if r[k] is not None}


def rules_payload(category: str | None = None, llm_only: bool = False) -> dict:
    chosen = [_rule(r) for r in RULES if (category is None or r["category"] == category) and (not llm_only or r["requires_llm"])]
    return {"count": len(chosen), "rules": chosen}


def check_payload(spark, text: str, path: str | None, lang: str, effort: str = "off", auto: bool = True, judge=None) -> dict:
    from quillmark.operators.judge import with_model
    from quillmark.operators.masking import mask
    from quillmark.operators.report import check, report_json
    from quillmark.sources.files import one_document

    docs = mask(one_document(spark, text, path, lang))
    if effort != "off":
        docs = with_model(docs, judge, effort, auto)
    done = check(docs, lang="lang", masked="masked", extra="extra" if effort != "off" else None)
    out = json.loads(report_json(done.drop("path")).first()["value"])
    if effort != "off":
        out["llm"] = {"effort": effort, **json.loads(done.selectExpr("to_json(llm) as j").first()["j"])}
    return out


def main(argv: list[str] | None = None) -> int:
    from quillmark.operators import judge as J
    from quillmark.sources.files import read_input, to_text

    args = parser().parse_args(argv)
    try:
        if args.verb == "version":
            out = {"version": __version__}
        elif args.verb == "rules":
            out = rules_payload(args.category, args.llm_only)
        elif args.verb == "rewrite":
            text = read_input(args.path)
            hints = J.rewrite_hints(args.rules.split(","))
            judge = J.CommandJudge(args.judge_bin, args.model, args.timeout)
            got = judge(J.rewrite_prompt([h for _, h in hints]), text, J.REWRITE_SCHEMA)
            out = {"rewritten": str(got.get("rewritten", "")).strip(), "applied_rules": [r for r, _ in hints] or None}
        else:
            from quillmark.operators.masking import resolve_lang

            text = read_input(args.path)  # a missing file comes before a wrong language
            lang = resolve_lang(args.lang, args.path)
            effort, auto = J.resolve_effort(args.llm_effort, args.llm, args.llm_deep, J.auto_enabled(args.judge_bin))
            out = check_payload(_session(), text, args.path, lang, effort, auto, J.CommandJudge(args.judge_bin, args.model, args.timeout))
        sys.stdout.write(to_text(out, args.pretty))
        return OK
    except UsageError as e:
        sys.stderr.write(f"quillmark: {e}\n")
        return USAGE_ERROR
    except J.JudgeError as e:
        sys.stderr.write(f"quillmark: {e}\n")
        return MODEL_ERROR
    except OSError as e:
        sys.stderr.write(f"quillmark: {e}\n")
        return IO_ERROR


if __name__ == "__main__":
    raise SystemExit(main())
