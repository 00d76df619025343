"""Language of documents and of segments in mixed documents, by a multilingual mixture.

A document is a mixture of languages over its sentences. Character n-gram models give every sentence a likelihood under each
language; expectation-maximisation estimates the document's language proportions; the set of languages grows from the best single one
as long as the gain in log-likelihood exceeds a penalty a language (a penalised likelihood). Responsibilities give each segment its
language and confidence, the proportions give the document's.

The n-gram models are fitted on a bounded sample of labelled texts (at most ``per_language`` a language, chosen by a hash of the id);
wrong labels among them are smoothed out by their number. Everything else reads all texts, whole.

Sentences: texts are cut at paragraphs and sentence ends, and unwrapped for scoring (line-end hyphens joined). What stands in quotes or
brackets within a paragraph (at most 120 characters, longer is text of its own) belongs to its sentence and is no evidence of a
language. A sentence is whole if it has at least ``min_words`` words of its own.

Defined results: null, empty, blank and number-only texts have no running words: no language, no segment, no issue; ties go to the
language named first; rows with a null id are ignored; repeated ids count once (the latest version, if a version
column is given, then the greatest label and parts); an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANGUAGES = ["en", "de", "fr", "es", "pt"]
#: Names and codes of the languages, and labels that name none.
NAMES = {
    "en": "en eng english englisch anglais inglés inglês",
    "de": "de deu ger german deutsch allemand alemán alemão",
    "fr": "fr fra fre french français francais französisch francés francês",
    "es": "es spa spanish español espanol castellano spanisch espagnol espanhol",
    "pt": "pt por portuguese português portugues portugiesisch portugais portugués",
}
NO_LANGUAGE = ["", "und", "unk", "unknown", "undefined", "n/a", "na", "none", "null", "nan", "-", "--", "---", "?", "??", "zxx", "mis", "mul", "xx", "unbekannt", "inconnu", "other"]
BUCKETS = 1 << 17
PER_LANGUAGE = 600
GAIN_BASE, GAIN_LOG = 8.0, 1.0
_IN = r"(?:[^{0}\n]|\n(?!\s*\n)){{0,120}}"
_QUOTED = re.compile("|".join(o + _IN.format(re.escape(o[-1] + c[-1])) + c for o, c in ((r"\(", r"\)"), ('"', '"'), ("“", "”"), ("„", "[“”]"), ("«", "»"), (r"\[", r"\]"))))
_WRAP = re.compile(r"(?<=\w)[-‐­¬][ \t]*\n[ \t]*(?=[a-zà-ÿ])")
_PARAGRAPH = re.compile(r"\n[ \t]*\n\s*|\f+")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"”»’]*\s+")
_LETTERS = re.compile(r"[^\W\d_]+")
_SQUEEZE = re.compile(r"[^\w']+|_+|\d+")


def label_code(label: Column) -> Column:
    """Code of the language a label names, '' if it names none, the label itself if it names another language."""
    low = F.lower(F.regexp_replace(F.coalesce(label, F.lit("")), r"(?U)^\s+|\s+$", ""))
    head = F.regexp_extract(low, r"^(\p{L}+)", 1)  # of en-US, pt_BR, English (UK)
    known = F.create_map(*[F.lit(x) for code, names in NAMES.items() for n in names.split() for x in (n, code)])
    none = F.array(*map(F.lit, NO_LANGUAGE))
    return F.when(F.array_contains(none, low) | ~low.rlike(r"\p{L}"), "").otherwise(F.coalesce(F.try_element_at(known, head), head))


def _blank(m: re.Match) -> str:
    return " " * (m.end() - m.start())


def spans(text: str) -> tuple[list[str], list[int], list[int]]:
    """Sentences as they are scored, where each one's part of the text starts, and its letters.

    Every part reaches to the start of the next, so that the parts are the whole text. What stands in quotes or brackets belongs to the
    sentence around it: it counts among its letters, but only the sentence's own words are scored. A part without words of its own
    belongs to the sentence before it (at the head of a text, to the one after it).
    """
    own = _QUOTED.sub(_blank, text)  # as long as the text, so places stay
    cuts = sorted({0, len(text), *(m.end() for m in _PARAGRAPH.finditer(own)), *(m.end() for m in _SENTENCE.finditer(own))})
    said: list[str] = []
    starts: list[int] = []
    letters: list[int] = []
    early = 0
    for a, z in zip(cuts[:-1], cuts[1:]):
        part = own[a:z]
        n = sum(map(len, _LETTERS.findall(text[a:z])))
        if _LETTERS.search(part):
            said.append(_WRAP.sub("", part).replace("\n", " ").strip())
            starts.append(a if starts else 0)
            letters.append(n + early)
            early = 0
        elif letters:
            letters[-1] += n
        else:
            early += n
    return said, starts, letters


def grams(sentences: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character 1- to 4-grams of the sentences, and where each sentence's start."""
    text = "\n".join(f"  {_SQUEEZE.sub(' ', s.lower()).strip()} " for s in sentences) + "\n"
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    start = np.r_[0, np.flatnonzero(c == 10)[:-1] + 1]
    h = np.empty((len(c) - 3, 3), dtype=np.uint64) if len(c) > 3 else np.empty((0, 3), np.uint64)
    if len(c) > 3:
        a, b, d, e = c[:-3], c[1:-2], c[2:-1], c[3:]
        h[:, 0] = (a * np.uint64(0x9E3779B1) + b) * np.uint64(0x85EBCA77)
        h[:, 1] = h[:, 0] * np.uint64(0xC2B2AE3D) + d * np.uint64(0x27D4EB2F)
        h[:, 2] = h[:, 1] * np.uint64(0x165667B1) + e
        h ^= h >> np.uint64(15)
        h %= np.uint64(BUCKETS)
    return h.astype(np.int64), np.minimum(start, max(0, len(h) - 1))


class Model:
    """Log-probabilities of hashed n-grams under each language, as differences to their mean."""

    def __init__(self, texts: dict[str, list[str]]):
        self.languages = list(texts)
        counts = np.zeros((BUCKETS, len(texts)))
        for k, some in enumerate(texts.values()):
            for t in some:
                s, _, _ = spans(t or "")
                if s:
                    h, _ = grams(s)
                    counts[:, k] += np.bincount(h.ravel(), minlength=BUCKETS)
        p = (counts + 0.5 * counts.sum(axis=1, keepdims=True) / np.maximum(1, counts.sum()) + 1e-3) / (counts.sum(axis=0) + 1.0)
        logs = np.log(p)
        self.table = ((logs - logs.mean(axis=1, keepdims=True)) / 3.0).astype(np.float32)  # three orders score each place

    def likelihoods(self, sentences: list[str]) -> np.ndarray:
        h, start = grams(sentences)
        if not len(h):
            return np.zeros((len(sentences), len(self.languages)))
        per_place = np.clip(self.table[h].sum(axis=1), -4, 4)
        return np.add.reduceat(per_place, start, axis=0).astype(np.float64)


def mixture(ll: np.ndarray, size: np.ndarray, chosen: list[int], rounds: int = 25) -> tuple[float, np.ndarray, np.ndarray]:
    """EM over the chosen languages: log-likelihood, proportions, responsibilities."""
    part = ll[:, chosen]
    pi = np.full(len(chosen), 1 / len(chosen))
    for _ in range(rounds):
        joint = part + np.log(pi)
        top = joint.max(axis=1, keepdims=True)
        r = np.exp(joint - top)
        r /= r.sum(axis=1, keepdims=True)
        new = np.maximum((r * size[:, None]).sum(axis=0) / size.sum(), 1e-9)
        done = np.abs(new - pi).max() < 1e-6
        pi = new
        if done:
            break
    joint = part + np.log(pi)
    top = joint.max(axis=1)
    return float((top + np.log(np.exp(joint - top[:, None]).sum(axis=1))).sum()), pi, r


def decompose(ll: np.ndarray, size: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Languages of a document, their proportions and each sentence's responsibilities, by penalised likelihood."""
    chosen = [int(np.argmax(ll.sum(axis=0)))]
    value, pi, r = mixture(ll, size, chosen)
    penalty = GAIN_BASE + GAIN_LOG * np.log(max(2, len(ll)))
    while len(chosen) < ll.shape[1]:
        options = [(mixture(ll, size, [*chosen, k]), k) for k in range(ll.shape[1]) if k not in chosen]
        (best, bpi, br), k = max(options, key=lambda o: o[0][0])
        if best - value <= penalty:
            break
        chosen, value, pi, r = [*chosen, k], best, bpi, br
    return chosen, pi, r


def train(docs: DataFrame, *, id: str, text: str, label: str, languages: list[str] = LANGUAGES, per_language: int = PER_LANGUAGE) -> Model:
    """Fits the models on at most per_language texts a language; labels are read by label_code."""
    rows = docs.select(label_code(F.col(label)).alias("code"), F.xxhash64(F.col(id)).alias("h"), F.col(text).alias("text")).filter(F.col("code").isin(languages) & F.col("text").isNotNull())
    n = {r["code"]: r["count"] for r in rows.groupBy("code").count().collect()}
    share = F.create_map(*[x for c in languages for x in (F.lit(c), F.lit(min(1.0, per_language / max(1, n.get(c, 0)))))])
    some = rows.filter(F.pmod("h", F.lit(1_000_000)) < share[F.col("code")] * 1_000_000).limit(2 * per_language * len(languages)).collect()
    texts: dict[str, list[str]] = {c: [] for c in languages}
    for r in sorted(some, key=lambda r: r["h"]):
        if len(texts[r["code"]]) < per_language:
            texts[r["code"]].append(r["text"])
    return Model(texts)


def _arrow(kinds: dict[str, pa.DataType]) -> pa.DataType:
    return pa.list_(pa.struct([pa.field(n, k) for n, k in kinds.items()]))


PARTS = {"code": pa.string(), "confidence": pa.float64(), "proportion": pa.float64(), "main": pa.bool_(), "whole_sentences": pa.int32(), "chars": pa.int64()}
SEGMENTS = {"segment": pa.int32(), "code": pa.string(), "confidence": pa.float64(), "sentences": pa.int32(), "char_start": pa.int32(), "char_end": pa.int32(), "text": pa.string()}
_SQL = {"string": "string", "double": "double", "bool": "boolean", "int32": "int", "int64": "long"}


def _parts(docs: DataFrame, held: Broadcast, work: Callable[[Model, str], list[tuple]], kinds: dict[str, pa.DataType], *, id: str, text: str, more: dict[str, Column], version: str | None) -> DataFrame:
    """A row per document: id, more, parts (what work makes of its text). Of repeated ids the row of the latest version counts.

    Texts are scored where they are read. Taking repeated ids together first would shuffle all texts, to save the few that are repeated.
    """
    some = docs.select(F.col(id).cast("string").alias("id"), F.col(text).alias("text"), (F.col(version) if version else F.lit(None)).cast("string").alias("version"), *[c.alias(n) for n, c in more.items()])
    some = some.filter(F.col("id").isNotNull() & F.col("text").rlike(r"\p{L}"))
    names, kind = list(kinds), _arrow(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[dict(zip(names, r)) for r in work(held.value, t)] for t in b.column("text").to_pylist()]
            keep = [c for c in b.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(found, kind)], names=[*keep, "parts"])

    fields = ", ".join(f"{n}: {_SQL[str(k)]}" for n, k in kinds.items())
    schema = "".join(f"{n} string, " for n in ("id", "version", *more)) + f"parts array<struct<{fields}>>"
    one = some.mapInArrow(run, schema).filter(F.size("parts") > 0)
    last = one.groupBy("id").agg(F.max(F.struct("version", *more, "parts")).alias("last"))
    return last.select("id", *[F.col(f"last.{n}").alias(n) for n in more], F.explode("last.parts").alias("part")).select("id", *more, "part.*")


def languages(docs: DataFrame, model: Model, *, id: str, text: str, label: str | None = None, version: str | None = None, min_words: int = 3) -> DataFrame:
    """One row per document and language in it. main marks the language of most text; whole_sentences counts its whole sentences.

    named is the code of the document's label, if a label column is given; of rows with the same id the one of the latest version counts.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages numbers
    more = {"named": label_code(F.col(label))} if label else {}
    return _parts(docs, held, lambda m, t: _document(m, t, min_words), PARTS, id=id, text=text, more=more, version=version)


def _assigned(model: Model, text: str):
    s, starts, letters = spans(text)
    if not s:
        return None
    size = np.maximum(1, letters).astype(np.float64)
    chosen, pi, r = decompose(model.likelihoods(s), size)
    return s, starts, size, chosen, r


def _document(model: Model, text: str, min_words: int) -> list[tuple]:
    got = _assigned(model, text)
    if got is None:
        return []
    s, _, size, chosen, r = got
    of = r.argmax(axis=1)
    chars = np.array([size[of == k].sum() for k in range(len(chosen))])
    main = int(np.argmax(chars))
    out = []
    for k, c in enumerate(chosen):
        mine = np.flatnonzero(of == k)
        if len(mine) or k == main:
            whole = sum(1 for i in mine if len(_LETTERS.findall(s[i])) >= min_words)
            conf = float((r[mine, k] * size[mine]).sum() / size[mine].sum()) if len(mine) else 0.0
            out.append((model.languages[c], round(conf, 6), round(float(chars[k] / size.sum()), 6), k == main, whole, int(chars[k])))
    return out


def _runs(model: Model, text: str) -> list[tuple]:
    got = _assigned(model, text)
    if got is None:
        return []
    _, starts, size, chosen, r = got
    of = r.argmax(axis=1)
    cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
    ends = [*starts[1:], len(text)]
    out = []
    for k, (a, z) in enumerate(zip(cuts[:-1], cuts[1:])):
        conf = float((r[a:z, of[a]] * size[a:z]).sum() / size[a:z].sum())
        out.append((k, model.languages[chosen[of[a]]], round(conf, 6), z - a, starts[a], ends[z - 1], text[starts[a] : ends[z - 1]]))
    return out


def segments(docs: DataFrame, model: Model, *, id: str, text: str, version: str | None = None) -> DataFrame:
    """Runs of neighbouring sentences of one language: id, segment, code, confidence, sentences, char_start, char_end, text.

    Together the segments of a document are its whole text; char_end is the char_start of the next one.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    return _parts(docs, held, _runs, SEGMENTS, id=id, text=text, more={}, version=version)


def issues(docs: DataFrame, model: Model, *, id: str, text: str, label: str, version: str | None = None) -> DataFrame:
    """id, issue and lang_code: missing and wrong with the main language; mixed, if a sentence of another language is whole, with every
    language of a whole sentence, the main one included."""
    found = languages(docs, model, id=id, text=text, label=label, version=version)
    each = found.groupBy("id").agg(
        F.max("named").alias("named"),
        F.max(F.when(F.col("main"), F.col("code"))).alias("main"),
        F.collect_list(F.when(F.col("whole_sentences") > 0, F.col("code"))).alias("whole"),  # as many as there are languages
    )
    said = F.when(F.col("named") == "", "missing").when(F.col("named") != F.col("main"), "wrong")
    label_rows = F.filter(F.array(F.struct(said.alias("issue"), F.col("main").alias("lang_code"))), lambda x: x.issue.isNotNull())
    other = F.exists("whole", lambda c: c != F.col("main"))
    mixed = F.when(other, F.transform("whole", lambda c: F.struct(F.lit("mixed").alias("issue"), c.alias("lang_code")))).otherwise(F.array())
    return each.select("id", F.inline(F.concat(label_rows, mixed)))
