"""python -m pegspark GRAMMAR_FILE [PATH] [lines A to B] [--glob G] [--no-color]: search files, one line of output a hit line.

Without a path, or with -, standard input is searched. Hits are coloured if the output is a terminal.
"""

from __future__ import annotations

import os
import queue
import sys
import threading
import time
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.grammar import Grammar
from .operators.search import format_results, search_lines
from .sources.files import search_folder

#: Lines of standard input that are searched together, and how long more lines are waited for once there is one.
CHUNK_LINES = 10_000
WAIT_SECONDS = 0.5


def chunks(lines: Iterable[str], last: int | None = None) -> Iterator[tuple[int, list[str]]]:
    """Standard input in pieces, with the number of lines before each: as many lines as are there, up to CHUNK_LINES.

    No more is read than a piece ahead, so input without end is answered as it comes; nothing is read beyond line last.
    """
    ready: queue.Queue = queue.Queue(CHUNK_LINES)
    end = object()

    def fill() -> None:
        for k, line in enumerate(lines, 1):
            ready.put(line.removesuffix("\n"))
            if k == last:
                break
        ready.put(end)

    threading.Thread(target=fill, daemon=True).start()
    before, line = 0, ready.get()
    while line is not end:
        held, until = [line], time.monotonic() + WAIT_SECONDS
        while len(held) < CHUNK_LINES:
            try:
                line = ready.get(timeout=max(0.0, until - time.monotonic()))
            except queue.Empty:
                line = None
                break
            if line is end:
                break
            held.append(line)
        yield before, held
        before += len(held)
        line = end if line is end else ready.get()


def search_piped(spark: SparkSession, grammar: Grammar, lines: Iterable[str], first: int | None, last: int | None) -> Iterator[DataFrame]:
    """Hit lines of standard input, a DataFrame for each piece of it."""
    for before, held in chunks(lines, last):
        if first is not None and before + len(held) < first:
            continue
        found = search_lines(spark.createDataFrame([("\n".join(held),)], "text string"), grammar, "text")
        found = found.withColumn("line", F.col("line") + F.lit(before))
        yield found if first is None else found.filter(F.col("line") >= first)


def main(args: list[str]) -> int:
    color = "--no-color" not in args and "NO_COLOR" not in os.environ and sys.stdout.isatty()
    args = [a for a in args if a != "--no-color"]
    glob = first = last = None
    if "--glob" in args[:-1]:
        k = args.index("--glob")
        glob, args = args[k + 1], args[:k] + args[k + 2 :]
    if len(args) >= 5 and args[-4] == "lines" and args[-2] == "to" and args[-3].isdigit() and args[-1].isdigit():
        first, last, args = int(args[-3]), int(args[-1]), args[:-4]
    if len(args) not in (1, 2) or args[0].startswith("--"):
        print(__doc__, file=sys.stderr)
        return 2
    with open(args[0], encoding="utf-8") as f:
        grammar = Grammar(f.read())
    spark = SparkSession.builder.appName("pegspark").getOrCreate()
    if len(args) == 1 or args[1] == "-":
        parts, errors = search_piped(spark, grammar, sys.stdin, first, last), None
    else:
        lines, errors = search_folder(spark, grammar, args[1], glob, first, last)
        parts = [lines]
    shown = 0
    for lines in parts:
        for row in format_results(lines.orderBy("file", "line"), color).toLocalIterator():
            print(row["shown"], flush=True)
            shown += 1
    for row in errors.toLocalIterator() if errors is not None else ():
        print(f"{row['file']}: {row['error']}", file=sys.stderr)
    if not shown:
        print("no matches found")
    return 0 if shown else 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
