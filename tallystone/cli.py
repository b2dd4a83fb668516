"""The command line: init, ingest, extract, review, search, reindex, rebuild-registry."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import SparkSession

from tallystone.config import Config
from tallystone.operators import extract, index, ingest, registry, review, search
from tallystone.sources import log


#: Commands and their options: a name and what it takes ("" a flag, "*" several words, a type, or choices).
COMMANDS = {
    "init": {},
    "ingest": {"dry-run": "", "backfill": ""},
    "extract": {"dry-run": "", "skip-entities": "", "skip-commitments": ""},
    "review list": {"kind": ("entity", "commitment"), "all": ""},
    "review show": {},
    "review approve": {"merge-into": str, "note": str},
    "review reject": {"note": str},
    "search": {"terms": "*", "kinds": "*", "top-k": int, "min-ratio": float, "min-coverage": float, "budget": int, "recency-days": float, "no-alias": "", "hint": ""},
    "reindex": {"stats": ""},
    "rebuild-registry": {},
}
DEFAULTS = {"top-k": 5, "min-ratio": 0.35, "min-coverage": 0.0, "note": ""}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tallystone", description="An append-only memory log with staged extraction and full-text search.")
    for o in ("home", "llm-cmd"):
        top.add_argument(f"--{o}")
    top.add_argument("--json", action="store_true")
    groups = {"": top.add_subparsers(required=True, dest="command")}
    for name, options in COMMANDS.items():
        group, _, last = name.rpartition(" ")
        if group not in groups:
            groups[group] = groups[""].add_parser(group).add_subparsers(required=True, dest="action")
        one = groups[group].add_parser(last)
        if name == "search":
            one.add_argument("query")
        elif group and last != "list":
            one.add_argument("id")
        for o, takes in options.items():
            how = {"action": "store_true"} if takes == "" else {"nargs": "*"} if takes == "*" else {"choices": takes} if isinstance(takes, tuple) else {"type": takes}
            flags = (["-k"] if o == "top-k" else []) + [f"--{o}"]
            one.add_argument(*flags, **how, **({"default": DEFAULTS[o]} if o in DEFAULTS else {}))
    return top


def _spark() -> SparkSession:
    return SparkSession.builder.appName("tallystone").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    cfg = Config.load(a.home, llm_cmd=a.llm_cmd)
    if a.command == "init":
        print(f"ready: {cfg.ensure_dirs().home}")
        return 0
    spark = spark or _spark()
    if a.command == "ingest":
        return ingest.run(spark, cfg.ensure_dirs(), a.dry_run, a.backfill)
    if a.command == "extract":
        return extract.run(spark, cfg.ensure_dirs(), None, a.dry_run, a.skip_entities, a.skip_commitments)
    try:
        if a.command == "review":
            return _review(spark, cfg, a)
        if a.command == "search":
            return _search(spark, cfg, a)
        if a.command == "reindex":
            print(json.dumps(index.stats(spark, cfg) if a.stats else index.build(spark, cfg), ensure_ascii=False))
            return 0
    except (review.ReviewError, FileNotFoundError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    ledger = registry.replay(log.read(spark, cfg.events))
    ledger.save(cfg.registry)
    print(f"{len(ledger.entities)} entities rebuilt from the log")
    return 0


def _review(spark: SparkSession, cfg: Config, a) -> int:
    if a.action == "list":
        rows = review.rows(spark, cfg, a.all, a.kind)
        if a.json:
            print(json.dumps(rows, ensure_ascii=False))
        for p in () if a.json else rows:
            print(review.describe(p) + ("" if p["state"] == "queued" else f"  [{p['state']}]"))
        if not rows and not a.json:
            print("nothing waits for review")
    elif a.action == "show":
        p = review.get(spark, cfg, a.id)
        if a.json:
            print(json.dumps(p, ensure_ascii=False))
            return 0
        print(review.describe(p))
        if hint := review.source_hint(p, cfg.home):
            print(f"  from: {hint}")
        for k in "state entity_type aliases note date_hint collides_with".split():
            if p.get(k):
                print(f"  {k}: {p[k]}")
    else:
        done = review.approve(spark, cfg, a.id, merge_into=a.merge_into, note=a.note) if a.action == "approve" else review.reject(spark, cfg, a.id, note=a.note)
        print(json.dumps(done, ensure_ascii=False) if a.json else f"{a.id}: {'approved' if a.action == 'approve' else 'rejected'}")
    return 0


def _search(spark: SparkSession, cfg: Config, a) -> int:
    aliases = None if a.no_alias else registry.Ledger.load(cfg.registry).alias_map(cfg.generic_aliases)
    query = search.Query.of(a.query, a.terms, aliases)
    top = 4 * a.top_k if a.hint else a.top_k
    hits = index.search(spark, cfg, query, top_k=top, kinds=a.kinds, weights=cfg.kind_weights, min_ratio=a.min_ratio, min_coverage=a.min_coverage, budget=a.budget, recency_days=a.recency_days, now=time.time())
    if a.hint:
        hits = search.hints(hits, a.top_k)
    rows = [r.asDict() for r in hits.collect()]
    if a.json:
        print(json.dumps([{**r, **({"alias_expanded": query.added} if query.added else {})} for r in rows], ensure_ascii=False))
    else:
        text = search.format_hints(rows, str(cfg.home)) if a.hint else search.format_results(rows, a.query, str(cfg.home))
        print(text or "(nothing related is stored)")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
