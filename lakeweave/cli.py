"""An interactive shell: ``python -m lakeweave.cli FOLDER [--init SCRIPT]``."""

from __future__ import annotations

import argparse
import sys

from pyspark.errors import PySparkException

from lakeweave.connection import Connection, connect
from lakeweave.plans.lexer import SqlError, tokens

SHOWN = 1_000


def complete(text: str) -> bool:
    """Whether the text ends a statement: a semicolon last, outside a trigger's body."""
    try:
        ts = [t for t in tokens(text) if t.kind != "end"]
    except SqlError:
        return False
    if not ts or (ts[-1].kind, ts[-1].value) != ("op", ";"):
        return False
    words = [t.upper for t in ts]
    if words[0] == "CREATE" and "TRIGGER" in words:
        depth = words.count("BEGIN") + words.count("CASE") - words.count("END")
        return depth <= 0
    return True


def run(connection: Connection, text: str, out=sys.stdout) -> None:
    cursor = connection.execute(text)
    if cursor.frame is None:
        print(f"{cursor.rowcount} rows changed", file=out)
        return
    rows = cursor.fetchmany(SHOWN)
    names = [n for n, _ in cursor.description]
    shown = [["NULL" if v is None else v.hex() if isinstance(v, (bytes, bytearray)) else str(v) for v in r] for r in rows]
    widths = [max([len(n), *[len(r[i]) for r in shown]]) for i, n in enumerate(names)]
    print(" | ".join(n.ljust(w) for n, w in zip(names, widths, strict=True)), file=out)
    print("-+-".join("-" * w for w in widths), file=out)
    for r in shown:
        print(" | ".join(v.ljust(w) for v, w in zip(r, widths, strict=True)), file=out)
    print(f"({len(rows)} rows{', more not shown' if len(rows) == SHOWN else ''})", file=out)


def command(connection: Connection, line: str, out=sys.stdout) -> bool:
    """A dot command; False ends the shell."""
    if line in (".quit", ".exit"):
        return False
    if line.startswith(".schema"):
        wanted = line.split()[1:]
        for _, _, name, definition in connection.database.schema_rows():
            if not wanted or name.lower() == wanted[0].lower():
                print(f"{definition};", file=out)
    elif line == ".tables":
        print("  ".join(connection.database.tables()), file=out)
    else:
        print("commands: .schema [NAME], .tables, .quit", file=out)
    return True


def main(args: list[str] | None = None, source=sys.stdin, out=sys.stdout) -> int:
    parser = argparse.ArgumentParser(prog="lakeweave")
    parser.add_argument("folder")
    parser.add_argument("--init", help="a script of statements to run first")
    given = parser.parse_args(args)
    with connect(given.folder) as connection:
        if given.init:
            with open(given.init, encoding="utf-8") as f:
                connection.execute(f.read())
        pending = ""
        for line in source:
            if not pending and line.strip().startswith("."):
                if not command(connection, line.strip(), out):
                    break
                continue
            pending += line
            if complete(pending):
                try:
                    run(connection, pending, out)
                except (SqlError, PySparkException, RuntimeError) as e:
                    print(f"error: {str(e).splitlines()[0]}", file=out)
                pending = ""
    return 0


if __name__ == "__main__":
    sys.exit(main())
