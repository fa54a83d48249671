"""python -m cairn STORE COMMAND ...: the store's commands on a terminal.

Commands: save KEY JSON, get KEY, delete KEY, list [PREFIX], find WORD, dig WORD [--keywords a,b] [--window 2h] [--max 10], edge FROM RELATION TO, neighbours ENTITY,
session PROJECT [DATA], search TEXT and context TEXT (by words in common), goals [STATUS], query NAME FOLDER. --json gives one JSON object a row.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame

from cairn.api import Store
from cairn.goal_store import Goals
from cairn.operators.embedding import hashed_words
from cairn.session import build_session


def arguments(args: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="cairn")
    p.add_argument("store")
    p.add_argument("--json", action="store_true")
    p.add_argument("--master", default="local[*]")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *names: str, **options: dict) -> None:
        c = sub.add_parser(name)
        for n in names:
            c.add_argument(n.rstrip("?"), nargs="?" if n.endswith("?") else None, default=None)
        for n, o in options.items():
            c.add_argument(f"--{n}", **o)

    command("save", "key", "value", auto={"action": "store_true"})
    command("get", "key")
    command("delete", "key")
    command("list", "prefix?")
    command("find", "word", limit={"type": int, "default": 20})
    command("dig", "word", keywords={"default": ""}, window={"default": ""}, max={"type": int, "default": 10})
    command("edge", "src", "relation", "dst")
    command("neighbours", "entity")
    command("session", "project", "data?")
    command("search", "text", limit={"type": int, "default": 10})
    command("context", "text", limit={"type": int, "default": 5})
    command("goals", "status?")
    command("query", "name", "folder")
    return p.parse_args(args)


def shown(df: DataFrame, as_json: bool) -> None:
    if as_json:
        for row in df.toJSON().toLocalIterator():
            print(row)
    else:
        df.show(1000, truncate=120)


def main(args: list[str]) -> int:
    a = arguments(args)
    spark = build_session("cairn", a.master)
    spark.sparkContext.setLogLevel("ERROR")
    if a.command == "query":
        from cairn.plans.queries import QUERIES

        shown(QUERIES[a.name](spark, a.folder), a.json)
        return 0
    s = Store(spark, a.store, hashed_words)
    if a.command == "save":
        print(s.save(a.key, a.value, a.auto))
    elif a.command == "get":
        try:
            print(s.get(a.key))
        except KeyError:
            print(f"no such key: {a.key}", file=sys.stderr)
            return 1
    elif a.command == "delete":
        s.delete(a.key)
    elif a.command == "list":
        shown(s.list(a.prefix or ""), a.json)
    elif a.command == "find":
        shown(s.find(a.word, a.limit), a.json)
    elif a.command == "dig":
        shown(s.dig(a.word, a.keywords.split(","), a.window, a.max), a.json)
    elif a.command == "edge":
        s.add_edge(a.src, a.dst, a.relation)
    elif a.command == "search":
        shown(s.search(a.text, a.limit), a.json)
    elif a.command == "context":
        print(s.context(a.text, Goals(spark, f"{a.store.rstrip('/')}-goals").current(), a.limit).first()["text"])
    elif a.command == "goals":
        shown(Goals(spark, f"{a.store.rstrip('/')}-goals").list("active" if a.status is None else a.status), a.json)
    elif a.command == "neighbours":
        shown(s.neighbours(a.entity), a.json)
    elif a.data is None:
        print(s.session(a.project))
    else:
        s.save_session(a.project, json.dumps(json.loads(a.data)))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
