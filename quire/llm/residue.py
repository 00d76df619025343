"""Template residue and error-page text, by retrieval of labelled exemplars with TF-IDF containment.

Exemplars are labelled lines and passages. An inverted index from their heaviest tokens retrieves those a passage window may hold;
containment is the share of an exemplar's TF-IDF weight that the window holds, coverage the share of the window's weight that the
exemplar holds (or, where it alone holds less, all exemplars of its sort together). A window that holds most of an exemplar and little
else is residue of the exemplar's sort, so texts that talk about such things (which hold much else) are none. Texts are read in two kinds of tokens:

- words, over windows of one and two units (lines, then sentences). Of a dummy passage, which is longer than a window, any part is
  residue: there the window must be contained in the exemplar.
- shapes, for exemplars that are a form with a name in it (slots such as ``{{ name }}``, lines of a stack trace): signs and the letter
  class of the names between them, two neighbours a token, over windows as long as the exemplar within a unit. Code blocks and backticks are
  examples of syntax and are left out.

Weights come from document frequencies over all texts, of words and shapes alike: exact for the exemplars' tokens, in a table of
BUCKETS hashed counters for all others, so what is sent to the tasks is bounded whatever the corpus.

Defined results: null and empty texts are no residue; a text has a row for each sort found, repeated ids and texts count once per id;
rows with a null id are ignored; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from http import HTTPStatus
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PLACEHOLDER, FILLER, ERROR, SCRIPT = "placeholder", "filler", "error_page", "script_notice"
CONTAINMENT, COVERAGE, DUMMY_COVERAGE, DUMMY_TOKENS = 0.8, 0.55, 0.9, 3
OWN_COVERAGE, SORT_COVERAGE = 0.35, 0.75  # what an exemplar, and all exemplars of its sort together, must cover instead
BUCKETS = 1 << 16
LEAST_SHARE = 1e-4  # of the texts: rarer tokens weigh no more, so that weights do not grow with the corpus

#: Labelled exemplar lines.
PHRASES = {
    FILLER: """
Your text goes here
Insert your content here
Content goes here
This is placeholder text
Placeholder paragraph, to be replaced
Replace this paragraph with the final wording
Replace this text with your own
Sample paragraph used to show how the layout looks with words in it
Add a short description of the section here
Hier steht später der Fließtext
Hier kommt Ihr Text hin
Dies ist ein Platzhaltertext
Bitte diesen Absatz ersetzen
Texte à venir
Ceci est un texte de remplissage
Remplacez ce paragraphe par le contenu définitif
Aquí irá el contenido
Este es un texto de relleno
Sustituya este párrafo de ejemplo
Aqui entra o texto
Este é um texto de preenchimento
Substitua este parágrafo de exemplo
""",
    ERROR: """
The upstream server gave no valid reply
The server encountered an internal error and was unable to complete your request
The server is temporarily unable to service your request due to maintenance downtime or capacity problems
The requested resource could not be delivered by this server
The gateway waited # seconds for an answer
The requested URL was not found on this server
Error establishing a database connection
Database connection failed timeout after # ms
Something went wrong
Something went wrong on our side
An error occurred while processing your request
An unexpected error occurred
An unexpected error occurred while loading the content
Please try again later
Please try again later or contact the administrator
This service is down for maintenance
Service temporarily unavailable
The site is temporarily out of reach
Access denied
You are not allowed to read this folder
You do not have permission to view this page
You don't have permission to access this resource
Your session has expired
Please sign in again to continue
Please log in to continue
Sorry, the page you are looking for can't be found
The page you requested could not be found
We could not find that document
The page has moved or was deleted
This link seems to be broken
Page not found
Oops, that page can't be found
This page does not exist
This page is no longer available
The link you followed may be broken or the page may have been removed
The file could not be found
The connection has timed out
The server took too long to respond
Our website is undergoing scheduled maintenance
We are down for maintenance and will be back shortly
Database connection failed
Could not connect to the database
Login required
Sign in to continue
You must be logged in to view this page
Your session has timed out, please log in again
Too many requests, please slow down
Fatal error Uncaught exception
Fatal error Uncaught exception thrown in on line #
Uncaught exception
Uncaught TypeError
Exception in thread main
java.lang.NullPointerException
Traceback most recent call last
Segmentation fault core dumped
upstream connect error or disconnect before headers, reset reason #
Connection refused
Connection reset by peer
Connection timed out
This page isn't working
This site can't be reached
Temporarily unavailable
Zugriff verweigert
Bitte melden Sie sich erneut an
Die angeforderte Seite wurde nicht gefunden Fehler #
Die Seite wurde nicht gefunden
Interner Fehler
Interner Serverfehler
Der Dienst ist vorübergehend nicht verfügbar
Ihre Sitzung ist abgelaufen
Es ist ein Fehler aufgetreten
Bitte versuchen Sie es später erneut
Der Server antwortet nicht
Der Vorgang wurde abgebrochen
Diese Seite existiert nicht mehr oder wurde verschoben
Sie haben keine Berechtigung, diese Seite anzuzeigen
Wegen Wartungsarbeiten vorübergehend nicht erreichbar
Keine Verbindung zur Datenbank
Erreur # le serveur ne répond pas
Service momentanément indisponible
Réessayez dans quelques instants
Cette page n'existe plus ou a été déplacée
Accès refusé
Votre session a expiré
Page introuvable
Une erreur est survenue
Veuillez réessayer plus tard
Veuillez vous reconnecter
La page demandée est introuvable
La page que vous cherchez n'existe pas
Vous n'êtes pas autorisé à accéder à cette page
Le serveur ne répond pas
Erreur interne du serveur
Site en maintenance
Acceso denegado
Inicie sesión de nuevo
No se ha podido encontrar la página solicitada
Se ha producido un error interno
Servicio no disponible temporalmente
El servidor no responde
Inténtelo de nuevo más tarde
Página no encontrada
Su sesión ha caducado
La página solicitada no existe
La página solicitada no existe o se ha movido
No tiene permiso para ver esta página
Error interno del servidor
Se ha producido un error
Sitio en mantenimiento
Acesso negado
Acesso recusado
Inicie sessão novamente
A página pedida não foi encontrada
Página não encontrada
Ocorreu um erro interno
Ocorreu um erro inesperado
Tente novamente mais tarde
Serviço temporariamente indisponível
O servidor não responde
A sessão expirou
Volte a iniciar sessão
A página que procura não existe ou foi movida
Não tem permissão para ver esta página
Erro interno do servidor
Ocorreu um erro
Site em manutenção
""",
    SCRIPT: """
Please enable JavaScript
Please enable JavaScript to continue
Please enable JavaScript and try again
Please enable JavaScript to view the page content
Please enable JavaScript if you want to see the content
You need to enable JavaScript
You need to enable JavaScript to run this app
JavaScript must be enabled
JavaScript is disabled in your browser
JavaScript is required to view this page
This page needs JavaScript
This page requires JavaScript
Turn on JavaScript and reload the page
Enable JavaScript and cookies to continue
JavaScript must be allowed
Allow cookies and scripts
Allow cookies and scripts to view this page
noscript the reader could not start because scripting is off
Scripting is off
Scripting is disabled
Scripts are disabled
If nothing appears, your browser may not support or permit scripts
Your browser blocks the script that loads this page
Your browser does not support JavaScript
Your browser does not support scripts or they are blocked
It looks like JavaScript is turned off in your browser settings
This site works only with scripts enabled
This viewer does not work without scripts
Checking your browser before accessing
Bitte aktivieren Sie JavaScript
Bitte aktivieren Sie JavaScript, um diese Seite anzuzeigen
JavaScript ist in Ihrem Browser deaktiviert
Diese Seite benötigt JavaScript
Ohne Skripte kann der Inhalt nicht geladen werden
Bitte Skripte zulassen
Veuillez activer JavaScript
Veuillez activer JavaScript pour afficher cette page
JavaScript est désactivé dans votre navigateur
Cette page nécessite JavaScript
Votre navigateur bloque les scripts
Votre navigateur bloque les scripts nécessaires à l'affichage du texte
Active JavaScript en su navegador
Active JavaScript en su navegador para ver el contenido
JavaScript está desactivado en su navegador
Habilite JavaScript para ver esta página
Esta página requiere JavaScript
Actívelo y vuelva a cargarla
Ative o JavaScript no navegador
Ative o JavaScript no navegador para ler este documento
O JavaScript está desativado no seu navegador
Esta página precisa de JavaScript
Active o JavaScript para ver o conteúdo
Os scripts estão bloqueados
""",
}
#: Passages of which any part is filler.
DUMMY = [
    """Lorem ipsum dolor sit amet, consectetur consectetuer adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.
    Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat. Duis aute irure dolor in
    reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur. Excepteur sint occaecat cupidatat non proident, sunt in
    culpa qui officia deserunt mollit anim id est laborum.""",
    "xxx xxx xxx",
    "foo bar baz qux quux",
    "asdf qwer jkl zxcv qwerty asdfgh",
    "text follows text follows",
    "blah bla blindtext",
    "dummy sample placeholder text",
    "test testing",
    "aaa bbb ccc",
    "texto texto aqui ejemplo exemplo",
]


def _status_lines() -> list[str]:
    """What servers answer with: the standard phrases of all client and server errors, in the forms they are written in."""
    out = []
    for s in HTTPStatus:
        if s >= 400:
            for p in {s.phrase, s.phrase.replace("Timeout", "Time-out")}:
                out += [f"Error # {p}", f"HTTP/1.1 # {p}", f"HTTP Error # {p}", f"# {p}", f"{p} #"] + [p] * (" " in p)
    return out


def _slots() -> list[str]:
    """Unfilled slots in the syntaxes of template languages, around names of each letter class."""
    both = ["{{%s}}", "{{{%s}}}", "{%%%s%%}", "<%%=%s%%>", "<%%%s%%>", "${%s}", "[[%s]]", "<<%s>>", "@@%s@@"]  # with or without space
    tight = ["{%s}", "<%s>", "%%(%s)s", "...... (%s)", "......(%s)", "(%s: to be completed)", "(%s: to be defined)", "(%s: to be filled in)", "(%s: to be added)", "[INSERT %s]", "[insert %s]", *(f"[{w} %s]" for w in ("Your", "Ihr", "Ihre", "Votre", "Su", "Seu", "Sua")), "XX-%s-XX"]
    upper = ["«%s»", "« %s »", "[%s]", "__%s__", "%%%s%%", "#%s#", "$%s$", "TBD_%s", "TODO_%s", "FIXME_%s"]
    out = [t % n for names in (("name", "NAME", "FIRST_NAME"),) for n in names for t in [*tight, *both, *(b.replace("%s", " %s ") for b in both)]]
    return [*out, *(t % n for n in ("NAME", "FIRST_NAME") for t in upper), "[INSERT]", "$FIRST_NAME"]


#: Labelled exemplar shapes.
SHAPES = {PLACEHOLDER: _slots(), ERROR: ["at com.example.Main.main(Main.java:12)", 'File "main.py", line 12, in main', 'File "main.py", line 12, in <module>', 'File "lib/main.py", line 12, in main']}

_CODE = re.compile(r"(```|~~~).*?\1|(`+)(?!`)[^`\n]+?\2(?!`)", re.S)
_TOKEN = re.compile(r"[^\W\d_]+|\d+")
_UNIT = re.compile(r"\n+|(?<=[.!?])\s+")


class _Words(dict):
    """Tokens of each written word (between white space): words in lower case, # for numbers, runs of one letter as three."""

    def __missing__(self, raw: str) -> tuple[str, ...]:
        if len(self) > 300_000:
            self.clear()
        got = tuple("#" if t[0].isdigit() else t[0] * 3 if len(t) > 2 and len(set(t)) == 1 else t for t in _TOKEN.findall(raw))
        self[raw] = got
        return got


_words = _Words()


def tokens(unit: str) -> list[str]:
    return list(chain.from_iterable(map(_words.__getitem__, unit.lower().split())))


def without_code(text: str) -> str:
    return _CODE.sub(" ", text) if "`" in text or "~~~" in text else text


def units(text: str) -> list[str]:
    """Lines and sentences."""
    return [u for u in _UNIT.split(text) if u and not u.isspace()]


_NAME_RUN = r"[^\W_]+(?:[ ._-]?[^\W_]+)*"
_SIGN_RUN = r"%\(|\]\(|<%=|_{2,}|\.{6,}|>(?=<)|[{}<>\[\]%$@«»#\\]+|[^\w\s]"
_LEX = re.compile(rf"({_NAME_RUN})|({_SIGN_RUN})")
# Affixes that make a slot of a name stand for signs of their own.
_AFFIXES = ((re.compile(r"(?<![^\W_])XX-(?=[^\W_])"), "\ue000"), (re.compile(r"(?<=[^\W_])-XX(?![^\W_])"), "\ue001"), (re.compile(r"(?<![^\W_])(?:TBD|TODO|FIXME)_(?=[^\W_])"), "\ue002"))
# Words that keep their identity after a sign: markup tags are no slots, and some slots have fixed words.
_KEPT = {
    "<": set("br p div span table thead tbody tfoot tr td th b i u s a ul ol li h1 h2 h3 h4 h5 h6 img hr pre code sup sub em strong html body head".split()),
    "[": set("insert your ihr ihre votre su seu sua".split()),
    ":": set("to be completed defined filled in added".split()),
    "": set("at file".split()),
    ",": set("line in".split()),
}
_TRIGGER = re.compile(r"[{}<>\[%$«@]|#\w|__|XX-|TBD_|TODO_|FIXME_|\.{6}|: to be |\.java:|\.py\"")  # every exemplar shape holds one of these


def _name(run: str, before: str) -> list[str]:
    """Shape of a run of words: those that keep their identity, then the letter class of the rest (A_ and A for capitals, else a)."""
    kept, words = [], re.split(r"[ ._-]", run)
    while words and words[0].lower() in _KEPT.get(before, ()):
        kept.append(words.pop(0).lower())
    if not words:
        return kept
    if words[0][0].isdigit():
        return [*kept, "#"]
    if before in ("$", "\ue002") and " " in run:  # only what is written in one belongs to the sign
        return [*_name(run[: run.index(" ")], before), "a"]
    if all(w.isupper() or w.isdigit() for w in words):
        return [*kept, "1" if len(run) == 1 else "A_" if "_" in run else "A"]
    return [*kept, "a"]


def shapes(line: str) -> list[str]:
    """Shingles of two neighbours among the signs and names of a unit. A sign before a name says whether it is set apart from what is around it."""
    if "XX" in line or "_" in line:
        for affix, sign in _AFFIXES:
            line = affix.sub(sign, line)
    parts: list[tuple[str, str]] = []  # as the first and as the second of two
    sign = ""
    for m in _LEX.finditer(line):
        a, z = m.span()
        glued = a > 0 and line[a - 1].isalnum()
        if m[1]:
            parts += [(x, x) for x in _name(m[1], sign)]
            sign = "\0"
        else:
            sign = m[2][:6]
            spaced = " " if line[z : z + 1].isspace() else ""
            parts.append((("w" if glued and z - a == 1 else "") + sign + spaced, (" " if a > 0 and line[a - 1].isspace() else "") + sign))
    return [f"{x[0]}\0{y[1]}" for x, y in zip(parts, parts[1:])]


def _shaped(text: str) -> list[list[str]]:
    return [s for unit in _UNIT.split(text) if _TRIGGER.search(unit) and (s := shapes(unit))]


class Weights(dict):
    """Inverse document frequency of tokens: of the exemplars' tokens from exact counts, of others from their bucket."""

    def __init__(self, exact: dict[str, int], buckets: np.ndarray, n_docs: int):
        super().__init__({t: self.idf(n, n_docs) for t, n in exact.items()})
        self.table = [self.idf(int(n), n_docs) for n in buckets]

    @staticmethod
    def idf(n: int, n_docs: int) -> float:
        return math.log((n_docs + 1) / (min(max(n, LEAST_SHARE * n_docs), n_docs) + 1)) + 0.1

    def __missing__(self, t: str) -> float:
        if len(self) > 500_000:
            return self.table[_bucket(t)]
        w = self[t] = self.table[_bucket(t)]
        return w


def _bucket(t: str) -> int:
    return zlib.crc32(t.encode("utf-8", "surrogatepass")) % BUCKETS


class Exemplars:
    """Labelled exemplars as TF-IDF vectors with an inverted index, for words or for shapes."""

    def __init__(self, labelled: list[tuple[str, list[str], bool]], weights: Weights):
        self.weights = weights
        self.held = [(sort, Counter(toks), toks, dummy) for sort, toks, dummy in labelled if toks]
        self.total = [sum(n * weights[t] for t, n in c.items()) for _, c, _, _ in self.held]
        # A window that holds CONTAINMENT of an exemplar holds one of its heaviest tokens, as soon as these weigh more than the rest may miss.
        # Of a dummy passage a window must hold one of the heavier tokens (at least half as heavy as they are on average).
        self.index: dict[str, list[int]] = {}
        for k, (_, c, _, dummy) in enumerate(self.held):
            left = (1 - CONTAINMENT) * self.total[k]
            for t in sorted(c, key=lambda t: (-c[t] * weights[t], t)) if not dummy else (t for t in c if weights[t] >= self.total[k] / sum(c.values()) / 2):
                self.index.setdefault(t, []).append(k)
                left -= c[t] * weights[t]
                if left < -1e-9 and not dummy:
                    break
        self.anchors = frozenset(self.index)
        self.of_sort: dict[str, set[str]] = {}
        for sort, c, _, dummy in self.held:
            self.of_sort.setdefault(sort, set()).update(() if dummy else c)

    def match(self, k: int, window: Counter, whole: float) -> float:
        """Coverage of a window by an exemplar that it matches, else 0."""
        sort, own, _, dummy = self.held[k]
        weights = self.weights
        both = own.keys() & window.keys()
        coverage = sum(window[t] * weights[t] for t in both) / whole
        if dummy:
            return coverage if coverage >= DUMMY_COVERAGE and sum(window[t] for t in both) >= DUMMY_TOKENS else 0.0
        if coverage < OWN_COVERAGE or sum(min(own[t], window[t]) * weights[t] for t in both) < CONTAINMENT * self.total[k] - 1e-9:
            return 0.0
        if coverage >= COVERAGE or sum(window[t] * weights[t] for t in window.keys() & self.of_sort[sort]) >= SORT_COVERAGE * whole:
            return coverage
        return 0.0

    def judge(self, toks: list[str], found: set[str]) -> None:
        """Adds the sort of the exemplar that covers a window of words best, of those it matches."""
        have = self.anchors.intersection(toks)
        if not have:
            return
        window, weights = Counter(toks), self.weights
        whole = sum(n * weights[t] for t, n in window.items())
        cover, k = max((self.match(k, window, whole), -k) for k in {k for t in have for k in self.index[t]})
        if cover:
            found.add(self.held[-k][0])

    def judge_aligned(self, toks: list[str], found: set[str]) -> None:
        """The same for a line of shapes: each exemplar over the window it would fill from the place of the token that called it up."""
        weights = self.weights
        for i, t in enumerate(toks):
            for k in self.index.get(t, ()):
                sort, _, own, _ = self.held[k]
                if sort in found:
                    continue
                for o in (o for o, x in enumerate(own) if x == t):
                    part = toks[max(0, i - o) : i - o + len(own)]
                    if self.match(k, Counter(part), sum(weights[x] for x in part)):
                        found.add(sort)
                        break


def labelled_words(phrases: dict[str, str] = PHRASES, dummy: list[str] = DUMMY) -> list[tuple[str, list[str], bool]]:
    lines = [(sort, tokens(line), False) for sort, some in phrases.items() for line in some.strip().split("\n")]
    return [*lines, *((ERROR, tokens(s), False) for s in (_status_lines() if ERROR in phrases else ())), *((FILLER, tokens(d), True) for d in dummy)]


def labelled_shapes(forms: dict[str, list[str]] = SHAPES) -> list[tuple[str, list[str], bool]]:
    return [(sort, s, False) for sort, some in forms.items() for s in dict.fromkeys(tuple(shapes(f)) for f in some)]


class Detector:
    def __init__(self, words: list, forms: list, weights: Weights):
        self.words, self.forms = Exemplars(words, weights), Exemplars([(s, list(t), d) for s, t, d in forms], weights)

    def sorts(self, text: str) -> set[str]:
        found: set[str] = set()
        text = without_code(text)
        if _TRIGGER.search(text):
            for line in _shaped(text):
                self.forms.judge_aligned(line, found)
        written = set(text.lower().split())
        if self.words.anchors.isdisjoint(chain.from_iterable(map(_words.__getitem__, written))):
            return found
        last: list[str] = []
        for u in units(text):
            toks = tokens(u)
            if toks:
                self.words.judge(toks, found)
                if last:
                    self.words.judge(last + toks, found)
                last = toks
        return found


def frequencies(docs: DataFrame, names: set[str]) -> tuple[dict[str, int], np.ndarray, int]:
    """Over all texts, the number that hold each of the names, and each bucket of other tokens; and the number of texts.

    Each task adds up its own texts first, so at most a row for each name and bucket leaves it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, exact, other = 0, Counter(), np.zeros(BUCKETS, dtype=np.int64)
        seen: Counter = Counter()

        def settle() -> None:
            for t, n in seen.items():
                if t in names:
                    exact[t] += n
                else:
                    other[_bucket(t)] += n
            seen.clear()

        for b in batches:
            for text in b.column(0).to_pylist():
                total += 1
                text = without_code(text)
                seen.update(set(chain.from_iterable(map(_words.__getitem__, set(text.lower().split())))))
                if _TRIGGER.search(text):
                    seen.update(set(chain.from_iterable(_shaped(text))))
            if len(seen) > 300_000:
                settle()
        settle()
        at = np.flatnonzero(other)
        keys, ns = [None, *exact, *[None] * len(at)], [total, *exact.values(), *other[at].tolist()]
        places = [-1, *[None] * len(exact), *at.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(places, pa.int32()), pa.array(ns, pa.int64())], names=["key", "bucket", "n"])

    rows = docs.select("text").mapInArrow(run, "key string, bucket int, n long").groupBy("key", "bucket").agg(F.sum("n").alias("n")).collect()  # a row a name and bucket
    exact, buckets, total = {}, np.zeros(BUCKETS, dtype=np.int64), 0
    for r in rows:
        if r["key"] is not None:
            exact[r["key"]] = r["n"]
        elif r["bucket"] < 0:
            total = r["n"]
        else:
            buckets[r["bucket"]] = r["n"]
    return {t: exact.get(t, 0) for t in names}, buckets, total


def residues(docs: DataFrame, *, id: str, text: str, phrases: dict[str, str] = PHRASES, dummy: list[str] = DUMMY, forms: dict[str, list[str]] = SHAPES) -> DataFrame:
    """One row per text and sort of residue: doc_id, residue."""
    some = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("doc_id is not null and length(text) > 0")
    words, shaped = labelled_words(phrases, dummy), labelled_shapes(forms)
    names = {t for _, toks, _ in chain(words, shaped) for t in toks}
    counted = docs.sparkSession.sparkContext.broadcast(frequencies(some, names))  # BUCKETS numbers, and one an exemplar token

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detector = Detector(words, shaped, Weights(*counted.value))
        for b in batches:
            found = [(d, s) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for s in sorted(detector.sorts(t))]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), (pa.int64(), pa.string()))], names=["doc_id", "residue"])

    return some.mapInArrow(run, "doc_id long, residue string").distinct()


def clean(docs: DataFrame, *, id: str, text: str) -> DataFrame:
    """The rows of docs whose texts hold no residue."""
    bad = residues(docs, id=id, text=text).select(F.col("doc_id").alias("_residue_of")).distinct()
    return docs.join(bad, F.col(id).cast("long") == F.col("_residue_of"), "left_anti")
