"""Single-process Python loops for the headline queries over $BENCH_SF_DIR: what the Spark queries are compared with. Prints one JSON line.

Each loop reads its table with pyarrow and runs in one process, median of three runs. The loops of the operators for language-model
data call the same per-text functions as the tasks do, so they show what distribution costs and gains, not another algorithm.
"""

import hashlib
import json
import os
import re
import statistics
import sys
import time
import unicodedata
from collections import Counter
from functools import partial

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")


def column(table: str, *names: str) -> list[list]:
    import pyarrow.parquet as pq

    return [c.to_pylist() for c in pq.read_table(f"{SF_DIR}/{table}.parquet", columns=list(names)).columns]


_TOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)*")


def terms(text: str) -> list[str]:
    return _TOKEN.findall(unicodedata.normalize("NFC", text).casefold().replace("’", "'"))


def fixed_overlap_chunks() -> int:
    n = 0
    for t in column("documents", "text")[0]:
        words = [m.span() for m in re.finditer(r"\S+", t)]
        k = 0
        while words and k < len(words):
            a, z = words[k][0], words[min(k + 512, len(words)) - 1][1]
            n += len(hashlib.md5(t[a:z].encode()).hexdigest()) == 32
            if k + 512 >= len(words):
                break
            k += 384
    return n


def recursive_chunks() -> int:
    from quire.operators.chunking import recursive

    return sum(len(recursive(t)) for t in column("documents", "text")[0])


def term_frequency() -> int:
    return sum(len(Counter(terms(t))) for t in column("documents", "text")[0])


def document_frequency() -> int:
    df: Counter = Counter()
    for s, t in zip(*column("documents", "source", "text")):
        df.update((s, x) for x in set(terms(t)))
    return len(df)


def hash_embedding() -> int:
    n = 0
    for t in column("documents", "text")[0]:
        t = t[:24_000] if t.strip() else " "
        raw = [b / 127.5 - 1 for k in range(2) for b in hashlib.sha256(f"{k}:{t}".encode()).digest()]
        norm = sum(x * x for x in raw) ** 0.5
        n += len([round(x / norm, 6) for x in raw])
    return n


def p7_found() -> int:
    from quire.operators import nested
    from quire.queries.workbooks import RULES

    by: dict = {}
    for r in RULES:
        by.setdefault(r.within, []).append(r)
    n = 0
    for body in dict(zip(*column("workbook_responses", "response_id", "body"))).values():
        try:
            record = json.loads(body)
        except (TypeError, ValueError):
            continue
        n += len(nested.shred_one(record, by)) if isinstance(record, dict) else 0
    return n


LOOPS = [fixed_overlap_chunks, recursive_chunks, term_frequency, document_frequency, hash_embedding, p7_found]
try:
    from quire.llm import loops
except ModuleNotFoundError as e:
    if e.name != "quire.llm":
        raise
else:
    LOOPS += [partial(f, column) for f in loops.LOOPS]


def main() -> None:
    took, rows = {}, {}
    for f in LOOPS:
        name = getattr(f, "func", f).__name__
        runs = []
        for _ in range(3):
            start = time.time()
            rows[name] = f()
            runs.append(time.time() - start)
        took[name] = round(statistics.median(runs), 3)
    print(json.dumps({"metric": "single_process_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "rows": rows, "sf": os.path.basename(SF_DIR.rstrip("/"))}))


if __name__ == "__main__":
    main()
