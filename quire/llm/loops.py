"""Single-process loops of the operators for language-model data, for baseline.py. column(table, names) gives a table's columns."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa

from quire.llm import packing, residue, scannoise


def p1_found(column: Callable) -> int:
    texts = [t for t in column("parsed_docs", "text")[0] + column("document_views", "main_text")[0] if t]
    counts = {k: Counter() for k in ("word", "compound", "pair", "total")}
    batch = pa.record_batch([pa.array(texts)] * 3, names=["id", "field", "text"])
    for b in scannoise._count(batch.slice(i, 2000) for i in range(0, len(texts), 2000)):
        for kind, key, n in zip(*(c.to_pylist() for c in b.columns)):
            counts[kind][key] += n
    kept = {k: {w: n for w, n in c.items() if n >= 4} for k, c in counts.items()}
    channel = scannoise.Channel(kept["word"], kept["compound"], kept["pair"], counts["total"][""], dict.fromkeys(scannoise.PRIOR, scannoise.PRIOR_RATE))
    return sum(len(scannoise.repair(t, channel)[1]) for t in texts)


def p8_containers(column: Callable) -> int:
    encode = packing.tokenizer(f"{packing.TOKENIZERS}/{packing.VOCABULARY}").encode_ordinary
    sizes = np.array([len(encode(t)) for t in column("documents", "text")[0] if t])
    bins = 0
    for capacity, separator in zip(*column("pack_limits", "capacity_tokens", "separator_tokens")):
        rest = np.where(sizes > capacity, sizes % capacity, sizes)
        whole = (sizes // capacity)[sizes > capacity].sum()
        bins += int(whole) + int(packing.pack_vectors(rest[rest > 0, None] + separator, np.array([capacity + separator])).max()) + 1
    return bins


def p10_found(column: Callable) -> int:
    texts = [t for t in column("documents", "text")[0] if t]
    words, forms = residue.labelled_words(), residue.labelled_shapes()
    exact, buckets, seen = {t: 0 for _, ts, _ in words + forms for t in ts}, np.zeros(residue.BUCKETS, np.int64), Counter()
    for t in map(residue.without_code, texts):
        seen.update(set(chain.from_iterable(map(residue._words.__getitem__, set(t.lower().split())))))
        seen.update(set(chain.from_iterable(residue._shaped(t))))
    for t, n in seen.items():
        if t in exact:
            exact[t] = n
        else:
            buckets[residue._bucket(t)] += n
    d = residue.Detector(words, forms, residue.Weights(exact, buckets, len(texts)))
    return sum(len(d.sorts(t)) for t in texts)


LOOPS = (p1_found, p8_containers, p10_found)
