"""A thin command line: ``python -m tessera --root DIR COMMAND``; results are JSON on stdout.

Exit code 0: done; 1: refused, with an error result; 2: bad arguments.
"""

from __future__ import annotations

import argparse
import json
import sys
from datetime import datetime

from .functions.embed import HashEmbedder
from .functions.messages import LANGUAGES, error
from .operators.query import QueryError
from .plans.library import Store
from .session import local_session
from .sources import files


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera")
    p.add_argument("--root", required=True)
    p.add_argument("--lang", choices=LANGUAGES, default="en")
    p.add_argument("--embed", action="store_true", help="vector route too, with hashed vectors, which carry no meaning")
    sub = p.add_subparsers(dest="command", required=True)
    for name, arguments in {"ingest": ("workspace", "folder"), "search": ("query",), "section": ("ref",), "entry": ("entry_id",), "stats": (), "verify": (), "list": ()}.items():
        one = sub.add_parser(name)
        for a in arguments:
            one.add_argument(a)
        if name == "ingest":
            one.add_argument("--replace", action="store_true")
        if name == "search":
            one.add_argument("--workspace", action="append")
            one.add_argument("--limit", type=int, default=20)
            one.add_argument("--mode", default="fused")
        if name in ("section", "entry"):
            one.add_argument("--max-chars", type=int, default=30_000)
    return p


def _rows(df) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def run(args: argparse.Namespace, store: Store) -> dict:
    """The result of a command."""
    embedder = HashEmbedder() if args.embed else None
    if args.command == "ingest":
        found = files.extract(files.scan(store.spark, args.folder)).cache()
        items = found.where("error is null").selectExpr(f"'{args.workspace}' as workspace", "text", "kind as source_type", "path as source_ref", "pages", "chapters", "outline")
        refused = store.ingest(items, datetime.now().isoformat(timespec="seconds"), embedder, args.replace)
        return {"refused": _rows(refused.select("source_ref", "reason")), "unreadable": _rows(found.where("error is not null").select("path", "error"))}
    if args.command == "search":
        hits, search = store.search(args.query, embedder, args.limit, args.mode, args.workspace)
        return {"hits": _rows(hits.orderBy("section_rank")), "mode": search.mode, "vector_available": search.vector_available, **_rows(store.envelope(search))[0]}
    if args.command in ("section", "entry"):
        found = _rows(store.section(args.ref, args.max_chars) if args.command == "section" else store.entry(args.entry_id, most=args.max_chars))
        if not found:
            raise ValueError(f"{args.command}_not_found: {args.ref if args.command == 'section' else args.entry_id}")
        return {"found": found}
    return {"stats": lambda: {"workspaces": _rows(store.stats())}, "verify": lambda: {"checks": _rows(store.problems())}, "list": lambda: {"workspaces": store.names()}}[args.command]()


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    try:
        result = {"success": True} | run(args, Store(local_session(), args.root))
    except ValueError as e:
        code, _, detail = (e.code, "", str(e)) if isinstance(e, QueryError) else str(e).partition(": ")
        result = error(code, detail, args.lang)
    print(json.dumps(result, ensure_ascii=False, default=str))
    return 0 if result["success"] else 1


if __name__ == "__main__":
    sys.exit(main())
