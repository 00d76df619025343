"""Noise in text from scanned pages: line-end hyphens, misrecognised characters, running heads and page numbers.

Noisy channel: a written word is some true word seen through character confusions, so a line is read by the words that maximise
confusion probability times n-gram likelihood, decoded by Viterbi over the candidate words of each place. Word and bigram counts come
from all texts. The confusions are learnt from the corpus: rare words are aligned with frequent ones that they differ from in one
place by one or two characters, over all words, and a confusion that recurs in a good share of the words that could show it is one of
the channel's; their probabilities come from a round of expectation-maximisation over all words. A short list of confusions known of
recognisers is the prior, so that small corpora have a channel too.

What is sent to the tasks is bounded: only words and bigrams with a share of at least ``min_share`` of all tokens belong to the model,
so there are at most 1 / min_share of each, whatever the size of the corpus (``min_share=0, least_count=1`` holds every word). A word
that is no more frequent than the misreadings of a word that explains it by confusions is dropped from the model as a misreading that
is itself frequent. A word may be read with one confusion for each started three letters.

Layout first: page-number lines and repeated heads are found per text, in the reading the channel gives their words, then words cut at line ends are joined if the joined word is
known (after correction) and the form with its hyphen is not, then words are decoded, then lines are unwrapped into paragraphs.

Defined results: null and empty texts have no defects and no repaired text; lines end at line and form feeds; one row per id, field
and defect, repeated ids once; rows with a null id are ignored; codes (digits with letters, run numbers) and numbers are never
corrected; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.session import cut

HYPHEN, HEADER, PAGE, MISREAD = "hyphen_break", "running_header", "page_number", "misread"
MIN_SHARE = 4e-6
RATE = 4e-3  # of a true word, misread in one way: an upper estimate
#: Confusions known of recognisers, true and seen: the prior of the channel.
PRIOR = [
    ("e", "c"), ("c", "e"), ("o", "0"), ("0", "o"), ("l", "1"), ("i", "1"), ("i", "l"), ("l", "i"), ("s", "5"), ("b", "8"), ("b", "6"), ("g", "9"), ("q", "9"), ("z", "2"), ("t", "f"), ("f", "t"), ("h", "b"), ("b", "h"), ("n", "u"), ("u", "n"),
    ("m", "rn"), ("rn", "m"), ("n", "ri"), ("ri", "n"), ("d", "cl"), ("cl", "d"), ("h", "li"), ("li", "h"), ("w", "vv"), ("u", "ii"), ("a", "ä"), ("ä", "a"), ("o", "ö"), ("ö", "o"), ("u", "ü"), ("ü", "u"), ("é", "e"), ("c", "("), ("i", "|"), ("l", "|"),
]
PRIOR_RATE = 1e-3
# A confusion is learnt if it is seen in at least so many pairs of words, and in at least this share of the frequent words that could show it.
LEARN_PAIRS, LEARN_SHARE, LEARN_COUNT = 4, 0.04, 100
CONTEXT = 4  # characters that two words must share for one to be a misreading of the other: fewer bring together words that have nothing to do with each other
_TOKEN = re.compile(r"[^\W_]+(?:[-'’][^\W_]+)*")
_PART = re.compile(r"[^\W_]+")
_WRITTEN = re.compile(r"[(|]?[^\W_]+(?:[(|][^\W_]+)*")  # with signs that may be misread letters
_CODE = re.compile(r"\d+|[a-z]\d+|(?=.*\d.*\d)[0-9a-f]{6,}|r[0-9a-f]{4}|[ivxlc]+")
_ENDS = re.compile(r"(?<![^\W_])([^\W_]+(?:[-'’][^\W_]+)*)[-‐­¬][ \t]*$")
_HYPHENS = ("-", "‐", "\xad", "¬")
_STARTS = re.compile(r"^\s*([^\W_]+(?:[-'’][^\W_]+)*)")
_SENTENCE_END = re.compile(r"[.!?:…][\"”»)\]]*$")
_LINES = re.compile(r"[\n\f]")
_LABELS = "page página pagina pag pág seite blatt folio p s".split()  # fixed values: what stands before page numbers
_NUMBER = r"(?:\d{1,4}|[ivxlc]{1,8})"
_MARKED = re.compile(rf"[\[(<–—\-·•|~\s]*(?:(?:{'|'.join(_LABELS)})\.?\s*)?{_NUMBER}(?:\s*(?:[/·|]|of|von|de|sur)\s*\d{{1,5}})?\s*[\])>–—\-·•|~\s]*", re.I)
_BARE = re.compile(r"\d{1,4}")
_ROMAN = re.compile(r"(?=[ivxlc])(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})")
_EDGE_NUMBER = re.compile(rf"^\s*{_NUMBER}\s{{2,}}|\s{{2,}}{_NUMBER}\s*$|^\s*\d{{1,4}}\s*[|·]\s*|\s*[|·]\s*\d{{1,4}}\s*$", re.I)
HEAD_LETTERS = 6
GRAM = 4


def _near(a: str, b: str) -> bool:
    """Whether two readings differ by at most one place in ten."""
    budget = min(len(a), len(b)) // 10
    if a == b:
        return True
    if abs(len(a) - len(b)) > budget or (Counter(a) - Counter(b)).total() > budget:  # letters that b lacks are edits at least
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > budget:
            return False
    return row[-1] <= budget


def page_lines(lines: list[str], channel: Channel) -> set[int]:
    """Lines that hold only the number of their page, a word for page before it read through the channel."""
    shown = [(i, s) for i, s in ((i, x.strip()) for i, x in enumerate(lines)) if s]
    out, bare = set(), []
    for k, (i, s) in enumerate(shown):
        if s.count(" ") > 8 or not _MARKED.fullmatch(s) and not _MARKED.fullmatch(channel.label(s)):
            continue
        if _BARE.fullmatch(s):
            alone = not (k and _BARE.fullmatch(shown[k - 1][1])) and not (k + 1 < len(shown) and _BARE.fullmatch(shown[k + 1][1]))
            if alone:
                bare.append((i, int(s)))
        elif s.isalpha():
            if s.islower() and _ROMAN.fullmatch(s):
                out.add(i)
        elif re.search(r"\d", s) or re.search(r"[\[(\-–—]", s):
            out.add(i)
    numbers = [n for _, n in bare]
    if len(bare) > 1 and all(0 < b - a <= 3 for a, b in zip(numbers, numbers[1:])):
        out |= {i for i, _ in bare}
    return out


def head_lines(lines: list[str], pages: set[int], channel: Channel) -> set[int]:
    """Head and foot lines that repeat over the pages: equal, or nearly so, in the reading of the channel.

    Lines that differ in at most one place in ten share a good part of their letter runs of GRAM, so only such groups are compared.
    """
    groups: list[tuple[str, list[int]]] = []
    named: dict[str, int] = {}
    holding: dict[str, list[int]] = {}
    for i, line in enumerate(lines):
        s = line.strip()
        if i in pages or not s or not (s[0].isupper() or s[0].isdigit()) or s[-1] in ",;-‐­¬" or _SENTENCE_END.search(s):
            continue
        k = channel.reading(_EDGE_NUMBER.sub("", s))
        if len(k) < HEAD_LETTERS:
            continue
        at = named.get(k)
        if at is None:
            grams = {k[j : j + GRAM] for j in range(len(k) - GRAM + 1)}
            least = len(grams) - GRAM * (len(k) // 10)
            shared = Counter(g for x in grams for g in holding.get(x, ()))
            at = next((g for g, n in sorted(shared.items()) if n >= least and _near(groups[g][0], k)), None)
            if at is None:
                at = len(groups)
                groups.append((k, []))
                for x in grams:
                    holding.setdefault(x, []).append(at)
            named[k] = at
        groups[at][1].append(i)
    out: set[int] = set()
    for _, held in groups:
        if len(held) > 1 and all(b - a > 1 for a, b in zip(held, held[1:])):
            out |= set(held)
    return out


class _Written(dict):
    """Of each written token (between white space, in lower case): its words, and the compounds among them."""

    def __missing__(self, raw: str) -> tuple[str, ...]:
        if len(self) > 300_000:
            self.clear()
        got = self[raw] = tuple(_PART.findall(raw))
        return got


_CUT = re.compile(r"\S*[-‐­¬][ \t]*[\n\f]\s*\S*")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words, hyphenated words and bigrams; words cut at line ends are left out. Added up per task first."""
    kinds: dict[str, Counter] = {"word": Counter(), "compound": Counter(), "pair": Counter(), "total": Counter()}

    def flush() -> Iterator[pa.RecordBatch]:
        for kind, counts in kinds.items():
            if counts:
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(counts), pa.string()), pa.array(list(map(" ".join, counts)) if kind == "pair" else list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["kind", "key", "n"])
                counts.clear()

    written = _Written()
    for b in batches:
        for text in b.column(2).to_pylist():
            raw = _CUT.sub(" \n ", text.lower()).split()
            words = list(chain.from_iterable(map(written.__getitem__, raw)))
            kinds["word"].update(words)
            kinds["pair"].update(zip(words, words[1:]))
            kinds["compound"].update(t for x in raw if "-" in x for t in _TOKEN.findall(x) if "-" in t)
            kinds["total"][""] += len(words)
        if sum(map(len, kinds.values())) > 300_000:
            yield from flush()
    yield from flush()


class Channel:
    """Lexicon, bigrams and confusion probabilities."""

    def __init__(self, words: dict[str, int], compounds: dict[str, int], pairs: dict[str, int], total: int, rates: dict[tuple[str, str], float]):
        self.rules = [r for r in rates if rates[r] > 0]
        self.rates = {r: math.log(rates[r]) for r in self.rules}
        self.total = max(1, total)
        self.words = words
        self.order = sorted(words)
        self.begins: dict[str, list[tuple[str, str]]] = {}
        for rule in self.rules:
            self.begins.setdefault(rule[1][0], []).append(rule)
        self.compounds = compounds
        self.pairs = {p: n for p, n in pairs.items() if all(w in self.words for w in p.split(" "))}
        self.unknown = math.log(1e-8 / self.total)  # any explanation by confusions is likelier than a new word
        self.signs = {seen for _, seen in self.rules if not seen.isalnum()}
        self.cache: dict[str, list[tuple[str, float]]] = {}
        self.clean: dict[str, bool] = {}
        self.labels = {seen for t in _LABELS if len(t) > 2 for seen in _written_as(t, self.rules)}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"cache": {}, "clean": {}}

    def explained(self, w: str, n: int) -> bool:
        """Whether w is no more frequent than misreadings of some more frequent word of the lexicon are (four standard deviations allowed)."""
        if _CODE.fullmatch(w) or len(w) < 3:
            return False
        for v in self.readings(w, 1 if len(w) < 5 else 2):
            often = RATE * self.words[v]
            if self.words[v] > n and n <= often + 4 * math.sqrt(often) + 4:
                return True
        return False

    def readings(self, w: str, places: int) -> dict[str, tuple]:
        """Words of the lexicon that may be written as ``w`` by one to ``places`` confusions, each with the likeliest ones.

        The word is read from left to right; a reading goes on only as long as some word of the lexicon begins like it.
        """
        order, out, n = self.order, {}, len(w)
        open_ = [(0, "", ())]
        while open_:
            at, head, used = open_.pop()
            if at == n:
                if used and head in self.words and (head not in out or self.cost(used) > self.cost(out[head])):
                    out[head] = used
                continue
            steps = [(w[at], 1, used)]
            if len(used) < places:
                steps += [(rule[0], len(rule[1]), (*used, rule)) for rule in self.begins.get(w[at], ()) if w.startswith(rule[1], at)]
            for add, width, now in steps:
                longer = head + add
                i = bisect_left(order, longer)
                if i < len(order) and order[i].startswith(longer):
                    open_.append((at + width, longer, now))
        return out

    def cost(self, used: tuple) -> float:
        return sum(self.rates[r] for r in used)

    def candidates(self, written: str) -> list[tuple[str, float]]:
        """Possible true words of a written word, with the log-probability of the channel."""
        w = written.lower()
        if w in self.cache:
            return self.cache[w]
        if w in self.words or len(w) < 3 or _CODE.fullmatch(w):
            out = [(w, 0.0)]
        else:
            found = self.readings(w, -(-len(w) // 3))
            few = [v for v, used in found.items() if len(used) <= 2]
            out = [(w, 0.0), *((v, self.cost(found[v])) for v in few or found)]  # more than two confusions only where fewer explain nothing
        if len(self.cache) > 200_000:
            self.cache.clear()
        self.cache[w] = out
        return out

    def is_clean(self, raw: str) -> bool:
        """Whether a written token (between white space) can only be read as it stands."""
        got = self.clean.get(raw)
        if got is None:
            if len(self.clean) > 300_000:
                self.clean.clear()
            got = all(len(self.candidates(raw[a:z])) == 1 for m in _WRITTEN.finditer(raw) for a, z in _words(m, self))
            self.clean[raw] = got
        return got

    def label(self, line: str) -> str:
        """A short line with the misread words for page put right."""
        return _LABEL_WORD.sub(lambda m: "page" if m[0].lower() in self.labels else m[0], line)

    def reading(self, line: str) -> str:
        """The letters and digits of a line as the channel reads it, in lower case."""
        if all(map(self.is_clean, line.split())):
            return "".join(_PART.findall(line.lower()))
        return "".join(_PART.findall(_rewrite(line, self, False)[0].lower()))

    def prior(self, w: str, before: str | None) -> float:
        """Interpolated bigram likelihood; an unknown word has a small fixed one."""
        n = self.words.get(w, 0)
        one = math.log(n / self.total) if n else self.unknown
        if before is None or before not in self.words:
            return one
        p = 0.6 * self.pairs.get(f"{before} {w}", 0) / self.words[before] + 0.4 * math.exp(one)
        return math.log(p)

    def decode(self, parts: list[str]) -> list[str]:
        """The likeliest true words of a line, by Viterbi over the candidates of each place.

        A word with one candidate parts the lattice, so each run of doubtful words is decoded between the sure ones around it.
        """
        options = [self.candidates(w) for w in parts]
        out = [o[0][0] for o in options]
        k, n = 0, len(parts)
        while k < n:
            if len(options[k]) == 1:
                k += 1
                continue
            z = k
            while z < n and len(options[z]) > 1:
                z += 1
            before = out[k - 1] if k else None
            score = [c + self.prior(w, before) for w, c in options[k]]
            back: list[list[int]] = []
            for i in range(k + 1, min(z + 1, n)):  # the sure word after the run takes part in its score
                step, came = [], []
                for w, c in options[i]:
                    best = max(range(len(score)), key=lambda j: score[j] + self.prior(w, options[i - 1][j][0]))
                    step.append(score[best] + self.prior(w, options[i - 1][best][0]) + c)
                    came.append(best)
                score = step
                back.append(came)
            j = max(range(len(score)), key=score.__getitem__)
            for i in range(k + len(back), k - 1, -1):
                out[i] = options[i][j][0]
                if i > k:
                    j = back[i - k - 1][j]
            k = z
        return out

    def corrected(self, w: str) -> str:
        return self.decode([w])[0]

    def joined(self, left: str, right: str) -> str | None:
        """The word that left and right make if the hyphen between them is only a line end's, else None."""
        a, b = left.lower(), right.lower()
        whole, kept = a + b, f"{a}-{b}"
        if "-" in whole:
            known, with_hyphen = self.compounds.get(whole, 0), self.compounds.get(kept, 0)
            if not known and not with_hyphen:
                head, _, tail = a.rpartition("-")
                first, _, rest = b.partition("-")
                return left + right if self._known(tail + first) and not (self._known(tail) and self._known(first)) else None
            return left + right if known > with_hyphen else None
        with_hyphen = self.compounds.get(kept, 0)
        if with_hyphen > self.words.get(whole, 0):
            return None
        if self._known(whole):
            return left + right
        if self._known(a) and self._known(b):  # two words that are known apart: likely a compound of its own
            return None
        return left + right if right[:1].islower() and not re.search(r"\d", whole) else None

    def _known(self, w: str) -> bool:
        return w in self.words or self.corrected(w) in self.words


_LABEL_WORD = re.compile(r"[^\W_]+")


def _written_as(word: str, rules: list[tuple[str, str]], places: int = 2) -> set[str]:
    """What a word may be written as by at most ``places`` confusions."""
    out, new = {word}, {(word, 0)}
    for _ in range(places):
        new = {(w[:i] + seen + w[i + len(true) :], i + len(seen)) for w, start in new for true, seen in rules for i in range(start, len(w)) if w.startswith(true, i)}
        out |= {w for w, _ in new}
    return out


def _match_case(written: str, true: str) -> str:
    if len(written) > 1 and written.isupper():
        return true.upper()
    return true[:1].upper() + true[1:] if written[:1].isupper() else true


def _words(m: re.Match, channel: Channel) -> list[tuple[int, int]]:
    """One word, if reading its brackets and bars as letters makes a known one, else the words between them."""
    a, z = m.span()
    if m[0].isalnum() or len(channel.candidates(m[0])) > 1 and not (m[0][0] in "(|" and m[0][1:].lower() in channel.words):
        return [(a, z)]
    return [(a + p.start(), a + p.end()) for p in _PART.finditer(m[0])]


def _rewrite(line: str, channel: Channel, skip_last: bool) -> tuple[str, bool]:
    if all(map(channel.is_clean, line.split())):
        return line, False
    spans = [p for m in _WRITTEN.finditer(line) for p in _words(m, channel)]
    if skip_last and spans and spans[-1][1] == len(line.rstrip()):
        spans = spans[:-1]
    parts = [line[a:z] for a, z in spans]
    out, last, changed = [], 0, False
    for (a, z), written, true in zip(spans, parts, channel.decode(parts)):
        if true != written.lower():
            changed = True
            out += [line[last:a], _match_case(written, true)]
            last = z
    return "".join(out) + line[last:], changed


def repair(text: str, channel: Channel) -> tuple[str, set[str]]:
    """Continuous paragraphs and the defects that were there."""
    lines = _LINES.split(text)
    defects: set[str] = set()
    pages = page_lines(lines, channel)
    heads = head_lines(lines, pages, channel)
    if pages:
        defects.add(PAGE)
    if heads:
        defects.add(HEADER)
        for i in heads:
            if _rewrite(_EDGE_NUMBER.sub("", lines[i]), channel, True)[1]:
                defects.add(MISREAD)
    flow: list[str] = []
    cut_off = False  # a head or page number stood here: a paragraph may go on after it
    for i, line in enumerate(lines):
        if i in pages or i in heads:
            cut_off = True
            continue
        s = line.strip()
        if not s:
            if flow and flow[-1] and not (cut_off and not _SENTENCE_END.search(flow[-1])):
                flow.append("")
            continue
        if cut_off and flow and not flow[-1] and len(flow) > 1 and not _SENTENCE_END.search(flow[-2]) and s[0].islower():
            flow.pop()
        cut_off = False
        flow.append(s)
    paragraphs: list[str] = []
    held = ""
    for s in [*flow, ""]:
        if not s:
            if held:
                paragraphs.append(held)
            held = ""
            continue
        left = _ENDS.search(held) if held[-1:] in _HYPHENS else None
        right = _STARTS.match(s) if left else None
        if left and right:
            word = channel.joined(left[1], right[1])
            if word is not None:
                defects.add(HYPHEN)
                held = held[: left.start()] + word + s[right.end() :]
            else:
                held = held.rstrip() + s
        else:
            held = f"{held} {s}" if held else s
    done = []
    for p in paragraphs:
        fixed, changed = _rewrite(p, channel, False)
        if changed:
            defects.add(MISREAD)
        done.append(fixed)
    return "\n\n".join(done), defects


def texts_of(df: DataFrame, id: str, text: str, field: str) -> DataFrame:
    return df.select(F.col(id).cast("string").alias("id"), F.lit(field).alias("field"), F.col(text).cast("string").alias("text")).filter("id is not null and length(text) > 0")


def _holes(word: Column, lengths: list[int]) -> Column:
    """A word with each of its places (of these lengths) blanked out, where CONTEXT characters are left: structs key, part."""

    def at(n: int) -> Column:
        last = F.length(word) - n + 1
        return F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.struct(F.concat(F.substring(word, F.lit(1), i - 1), F.lit("\0"), F.substring(word, i + n, F.length(word))).alias("key"), F.substring(word, i, F.lit(n)).alias("part")))).otherwise(F.array())

    return F.filter(F.flatten(F.array(*map(at, lengths))), lambda h: F.length(h["key"]) > CONTEXT)


def learnt_confusions(counts: DataFrame) -> list[tuple[str, str]]:
    """Confusions that recur between rare words and frequent words one place apart. counts: kind, key, n of all words.

    Words meet by what is left of them with one or two neighbouring characters blanked out. Of true and seen at least one is a single
    character, and they share neither their first nor their last one. What comes to the driver is a row a confusion.
    """
    words = counts.filter((F.col("kind") == "word") & (F.length("key") >= 4)).select(F.col("key").alias("word"), "n")
    often = words.filter((F.col("n") >= LEARN_COUNT) & F.col("word").rlike(r"^\p{L}+$"))
    true = often.select("word", F.col("n").alias("n_true"), F.explode(_holes(F.col("word"), [1, 2])).alias("h")).select("n_true", "h.key", F.col("h.part").alias("true"))
    seen = words.filter(~F.col("word").rlike(r"^\p{N}+$")).select("n", F.explode(_holes(F.col("word"), [1, 2])).alias("h")).select("n", "h.key", F.col("h.part").alias("seen"))
    apart = (F.substring("true", 1, 1) != F.substring("seen", 1, 1)) & (F.right("true", F.lit(1)) != F.right("seen", F.lit(1))) & (F.length("true") + F.length("seen") <= 3)
    pairs = true.join(seen, "key").filter(apart & (F.col("n") <= RATE * F.col("n_true") + 4 * F.sqrt(RATE * F.col("n_true")) + 4))
    found = pairs.groupBy("true", "seen").agg(F.count("*").alias("pairs"))
    could = often.select(F.explode(F.array_distinct(F.transform(_holes(F.col("word"), [1, 2]), lambda h: h["part"]))).alias("true")).groupBy("true").agg(F.count("*").alias("words"))
    kept = found.filter(F.col("pairs") >= LEARN_PAIRS).join(could, "true").filter(F.col("pairs") >= LEARN_SHARE * F.col("words"))
    return sorted((r["true"], r["seen"]) for r in kept.collect())


def fit(texts: DataFrame, min_share: float = MIN_SHARE, least_count: int = 2, prior: list[tuple[str, str]] = PRIOR) -> Channel:
    """Counts over all texts, the confusions they show, then one round of EM for their probabilities over all words."""
    counts = cut(texts.mapInArrow(_count, "kind string, key string, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")))
    total = sum(r["n"] for r in counts.filter("kind = 'total'").collect())
    least = max(least_count, math.ceil(min_share * total))
    held: dict[str, dict[str, int]] = {"word": {}, "compound": {}, "pair": {}}
    for r in counts.filter((F.col("kind") != "total") & (F.col("n") >= least)).toLocalIterator():  # at most 1 / min_share of each kind
        held[r["kind"]][r["key"]] = r["n"]
    rules = list(dict.fromkeys([*prior, *learnt_confusions(counts)]))
    spark = texts.sparkSession
    words = counts.filter("kind = 'word'").select("key", "n")
    first = spark.sparkContext.broadcast(Channel(held["word"], {}, {}, total, dict.fromkeys(rules, PRIOR_RATE)))

    def misreadings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([first.value.explained(w, n) for w, n in zip(*(c.to_pylist() for c in b.columns))]))

    for r in words.filter(F.col("n") >= least).mapInArrow(misreadings, "key string, n long").toLocalIterator():  # words of the lexicon
        del held["word"][r["key"]]
    sent = spark.sparkContext.broadcast(Channel(held["word"], held["compound"], held["pair"], total, dict.fromkeys(rules, PRIOR_RATE)))

    def explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: Counter = Counter()
        channel = sent.value
        for b in batches:
            for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                true = channel.corrected(w) if len(channel.candidates(w)) > 1 else w
                if true != w:
                    for rule in channel.readings(w, -(-len(w) // 3)).get(true, ()):
                        tally[rule] += n
        if tally:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in tally], pa.string()), pa.array([r[1] for r in tally], pa.string()), pa.array(list(tally.values()), pa.int64())], names=["true", "seen", "n"])

    seen = {(r["true"], r["seen"]): r["n"] for r in words.mapInArrow(explain, "true string, seen string, n long").groupBy("true", "seen").agg(F.sum("n").alias("n")).collect()}  # a row a rule
    chars: Counter = Counter()
    for w, n in held["word"].items():
        for true in {r[0] for r in rules}:
            chars[true] += n * w.count(true)
    rates = {r: (seen.get(r, 0) + 0.5) / (chars[r[0]] + 1000.0) for r in rules}
    return Channel(held["word"], held["compound"], held["pair"], total, rates)


def _mapped(texts: DataFrame, channel: Channel, defects: bool) -> DataFrame:
    sent = texts.sparkSession.sparkContext.broadcast(channel)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, f, t in zip(*(c.to_pylist() for c in b.columns)):
                text, found = repair(t, sent.value)
                out += [(i, f, d) for d in sorted(found)] if defects else [(i, f, text)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], names=["id", "field", "defect" if defects else "text"])

    return texts.mapInArrow(run, f"id string, field string, {'defect' if defects else 'text'} string")


def defects(texts: DataFrame, channel: Channel | None = None) -> DataFrame:
    """id, field, defect. texts: id, field, text (see texts_of)."""
    return _mapped(texts, channel or fit(texts), True).distinct()


def repaired(texts: DataFrame, channel: Channel | None = None) -> DataFrame:
    """id, field, text as continuous paragraphs."""
    return _mapped(texts, channel or fit(texts), False).dropDuplicates(["id", "field"])
