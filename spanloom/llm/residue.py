"""Template residue, filler and error pages instead of content.

Labelled exemplars are held in an inverted index (term -> exemplars).  A few
come with the library: public messages of servers, sites and page builders.
The rest are learned from the collection: pages that were served with an error
are labelled, and those of their passages that ordinary pages lack become
exemplars, while passages that ordinary pages share are page furniture.  Every
passage window of a document (a sentence, or a line without one) retrieves
exemplars by its terms, and the share of its TF-IDF weight that the best one
contains decides whether it is residue, furniture or content.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COVERAGE = 0.5
CONTENT_SHARE = 0.5
#: The bounded sample of labelled pages from which exemplars are learned, and of their passages.
LABELLED_PAGES, LABELLED_PASSAGES = 3_000, 60_000
#: How many times likelier on labelled pages than on all a passage must be to become an exemplar of residue; up to
#: the second figure it is furniture, which stands on all pages alike.  Between the two it is neither.
LIFT, EVEN = 6.0, 2.0
_LONGEST_PASSAGE = 2_000

# Public messages of servers, sites and page builders, one passage a line.
RESIDUE_EXEMPLARS = {
    "missing": """
404 Not Found
Error 404: this page could not be found.
The requested URL was not found on this server. If you entered the URL manually please check your spelling and try again.
Sorry, the page you are looking for does not exist or has been moved.
We can't seem to find the page you're looking for.
This content isn't available at the moment. The link may be broken or the page may have been removed.
The resource you are looking for might have been removed, had its name changed, or is temporarily unavailable.
No results found. Sorry, but nothing matched your search terms.
This video is no longer available because the account has been terminated.
The item has expired and is no longer for sale.
Your session has timed out. Please log in again.
Seite nicht gefunden
The page you requested is no longer available.
This page can't be displayed right now.
This link may have expired.
Diese Anzeige ist nicht mehr verfügbar.
Die Seite kann derzeit nicht angezeigt werden.
Die von Ihnen aufgerufene Seite konnte leider nicht gefunden werden.
Diese Seite existiert nicht mehr oder wurde verschoben.
Der gewünschte Inhalt ist leider nicht verfügbar.
Ihre Suche ergab keine Treffer.
Page non trouvée
La page que vous recherchez est introuvable ou n'existe plus.
Désolé, cette page n'est pas disponible ou a été supprimée.
Ce contenu n'est plus accessible.
Cette offre n'est plus disponible.
La page ne peut pas être affichée pour le moment.
Aucun résultat pour votre recherche.
Página no encontrada
Lo sentimos, la página que está buscando no existe o se ha eliminado.
No se ha podido encontrar la página solicitada.
Este contenido ya no está disponible.
Este producto ya no existe.
La página no se puede mostrar en este momento.
No hay resultados para su búsqueda.
""",
    "unavailable": """
503 Service Unavailable
Service temporarily unavailable
The server is temporarily unable to service your request due to maintenance downtime or capacity problems. Please try again later.
502 Bad Gateway
504 Gateway Time-out
upstream timed out while connecting to upstream
500 Internal Server Error
The server encountered an internal error or misconfiguration and was unable to complete your request.
Something went wrong. Please try again later.
An unexpected error has occurred.
We are currently performing scheduled maintenance. We should be back shortly.
This site is temporarily down for maintenance.
You have been rate limited because of too many requests.
Es ist ein unerwarteter Fehler aufgetreten. Bitte versuchen Sie es später noch einmal.
Wegen Wartungsarbeiten ist diese Seite derzeit nicht erreichbar.
Der Server ist vorübergehend nicht verfügbar.
Une erreur inattendue est survenue. Veuillez réessayer plus tard.
Une erreur s'est produite. Réessayez plus tard.
Le site est actuellement en maintenance, merci de revenir plus tard.
Le serveur est temporairement indisponible.
Se ha producido un error inesperado. Por favor, inténtelo de nuevo más tarde.
Ha ocurrido un error. Inténtelo de nuevo más tarde.
El sitio se encuentra en mantenimiento. Vuelva a intentarlo más tarde.
El servidor no está disponible temporalmente.
""",
    "denied": """
403 Forbidden
You don't have permission to access this resource on this server.
401 Unauthorized
Access denied. You do not have permission to view this page.
Sorry, you have been blocked. You are unable to access this website.
This content is not available in your country.
You must be logged in to view this page.
This account has been suspended. Contact your hosting provider for more information.
This domain is for sale. Buy this domain today.
Zugriff verweigert
Sie haben keine Berechtigung, auf diese Seite zuzugreifen.
Bitte melden Sie sich an, um diesen Inhalt zu sehen.
Accès refusé
Vous n'êtes pas autorisé à accéder à cette page.
Vous devez vous connecter pour voir cette page.
Acceso denegado
No tiene permiso para acceder a esta página.
Debe iniciar sesión para ver este contenido.
""",
    "scripts": """
You need to enable JavaScript to run this app.
Please enable JavaScript to view this site.
JavaScript is disabled in your browser. Please enable JavaScript to proceed.
We've detected that JavaScript is disabled in this browser. Please enable JavaScript or switch to a supported browser to continue.
This site requires JavaScript and cookies to work.
Your browser is out of date or not supported. Please update your browser.
Bitte aktivieren Sie JavaScript in Ihrem Browser, um diese Website zu nutzen.
JavaScript ist in Ihrem Browser deaktiviert.
Veuillez activer JavaScript dans votre navigateur pour utiliser ce site.
JavaScript est désactivé dans votre navigateur.
Por favor, active JavaScript en su navegador para usar este sitio.
JavaScript está desactivado en su navegador.
""",
    "check": """
Checking your browser before accessing the website. This process is automatic. Please allow up to five seconds.
Checking if the site connection is secure.
Verify you are human by completing the action below.
Please complete the security check to access the website.
I'm not a robot. Please solve the captcha to continue.
Ihr Browser wird überprüft, bevor Sie auf die Website zugreifen. Bitte einen Moment Geduld.
Ihr Browser wird geprüft. Einen Moment bitte.
Bitte bestätigen Sie, dass Sie kein Roboter sind.
Vérification de votre navigateur avant l'accès au site. Veuillez patienter quelques secondes.
Veuillez confirmer que vous n'êtes pas un robot.
Estamos comprobando su navegador antes de acceder al sitio. Espere unos segundos.
Confirme que no es un robot.
""",
    "fault": """
Traceback (most recent call last)
Fatal error: Uncaught Error: Call to undefined function in index.php on line 9
Warning: Undefined variable in index.php on line 9
Parse error: syntax error, unexpected end of file in index.php on line 9
Exception in thread main java.lang.NullPointerException
You have an error in your SQL syntax; check the manual that corresponds to your server version for the right syntax to use near
Error establishing a database connection
Uncaught TypeError: Cannot read properties of undefined
panic: runtime error: invalid memory address or nil pointer dereference
Unhandled exception occurred during the execution of the current web request. Please review the stack trace for more information about the error.
Segmentation fault (core dumped)
Internal Server Error: the application failed to respond
""",
    "filler": """
Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua. Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat. Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur. Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.
Sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium, totam rem aperiam, eaque ipsa quae ab illo inventore veritatis et quasi architecto beatae vitae dicta sunt explicabo.
At vero eos et accusamus et iusto odio dignissimos ducimus qui blanditiis praesentium voluptatum deleniti atque corrupti quos dolores et quas molestias excepturi sint occaecati cupiditate non provident.
This is placeholder text. Replace it with your own content.
Your content goes here. Edit or remove this text inline or in the module settings.
I'm a paragraph. Click here to add your own text and edit me.
Welcome to WordPress. This is your first post. Edit or delete it, then start writing!
This is an example page. It's different from a blog post because it will stay in one place.
Hier steht ein Blindtext. Bitte ersetzen Sie ihn durch Ihren eigenen Text.
Ceci est un texte d'exemple. Remplacez-le par votre propre contenu.
Este es un texto de ejemplo. Sustitúyalo por su propio contenido.
This site is under construction. Coming soon.
""",
}
#: Furniture of pages; neither content nor a reason to exclude a page.
FURNITURE_EXEMPLARS = """
Go back to the home page or try the search box instead.
Return to the previous page. If the problem persists, please contact the site administrator.
Request ID 9
Some features of this page need scripts.
This website uses cookies to ensure you get the best experience. By continuing you agree to our cookie policy.
We use cookies and similar technologies. Accept all. Manage settings.
Diese Website verwendet Cookies. Mit der Nutzung stimmen Sie der Verwendung von Cookies zu.
Ce site utilise des cookies. En poursuivant votre navigation vous acceptez leur utilisation.
Este sitio web utiliza cookies. Si continúa navegando acepta su uso.
All rights reserved. Terms of use. Privacy policy.
Alle Rechte vorbehalten. Impressum. Datenschutz.
Tous droits réservés. Mentions légales. Confidentialité.
Todos los derechos reservados. Aviso legal. Privacidad.
"""

#: How template languages write a field that is still to be filled.
_FIELD = re.compile(
    r"\{\{\s*[#/^>&!]?[\w.]+(?:[\s|][^{}\n]{0,60})?\}\}|\{%-?\s*\w+[^%{}\n]{0,60}%\}|<%[=-]?\s*[\w.@]+[^%<>\n]{0,60}%>|[$#]\{[\w.]+\}"
    r"|%%\w+%%|%[A-Z][A-Z_]{2,}%|__[A-Z][A-Z_]+__|@@\w+@@|@[a-z]+(?:_[a-z]+)*@(?![\w.])|#[A-Z][A-Z_]{2,}#|<<[a-z]+(?:_[a-z]+)*>>|\[\[[a-z]+(?:_[a-z]+)*\]\]"
    r"|\[(?:[Yy]our|[Ii]nsert|[Ee]nter|INSERT|YOUR|ENTER)\s[\w ]{2,40}\]|\{[a-z]+(?:_[a-z]+)*\}|\[[A-Z]{2,}(?:_[A-Z]+)+\]"
)
_FIELD_HINT = re.compile(r"\{|<[%<]|%[%A-Z]|__|@|#[A-Z{]|\[")
_QUOTES = "`\"'“”„«»‘’‹›"

_FOREIGN = re.compile(r"[^\x00-\x7f]+")
_TERM = re.compile(r"[0-9a-z][0-9a-z*]*")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\s(?:[|/]|[^\x00-\x7f]{1,3})\s")
_QUOTED = re.compile(r"«[^«»]*»|“[^“”]*”|„[^„“”]*[“”]|‘[^‘’]{20,}’|\"[^\"]*\"")
_FOOTER = re.compile(r"^\W{0,3}(?:©|\(c\)|[^\x00-\x7f]+)\s?(?:19|20)\d\d\b", re.I)
_TAIL = re.compile(r"[.!?…:;]\W*$")


def _fold(text: str) -> str:
    return (text if text.isascii() else _FOREIGN.sub("*", text)).lower()


def signatures(text: str) -> list[str]:
    """Terms of ``text``, alike for any garbling of its non-ASCII letters.

    Runs of non-ASCII characters become one ``*`` (dropped at a term's ends), so
    a word decoded with the wrong charset keeps its signature; terms with digits
    are all ``#``.
    """
    return [s for s in map(_signature, _TERM.findall(_fold(text))) if s]


def _signature(term: str) -> str:
    term = term.strip("*")
    return term if not term or term.isalpha() or not any(c.isdigit() for c in term) else "#"


class ExemplarIndex:
    """Inverted index over the labelled exemplars; each is one passage, kept as its terms."""

    def __init__(self, residue: dict[str, str] | None = None, furniture: str | None = None, least: float = COVERAGE, learned: list[tuple[str, frozenset[str]]] = ()):
        self.least = least
        self.labels, self.terms, self.postings = [], [], defaultdict(list)
        groups = [*(residue or RESIDUE_EXEMPLARS).items(), ("", furniture if furniture is not None else FURNITURE_EXEMPLARS)]
        for label, lines in groups:
            for line in filter(None, map(str.strip, lines.split("\n"))):
                self._add(label, frozenset(signatures(line)))
        for label, terms in learned:
            self._add(label, terms)
        self.vocabulary = sorted(self.postings)

    def _add(self, label: str, terms: frozenset[str]) -> None:
        for t in terms:
            self.postings[t].append(len(self.labels))
        self.labels.append(label), self.terms.append(terms)

    def weigh(self, df: dict[str, int], n: int) -> None:
        """Inverse document frequencies from the whole collection."""
        self.idf = {t: math.log((n + 1) / (df.get(t, 0) + 1)) + 0.05 for t in self.vocabulary}
        # a term of no exemplar is not counted; it weighs what a term of an exemplar does on average
        self.rare = sum(self.idf.values()) / max(len(self.idf), 1)
        self.known = dict(self.idf)  # raw term -> weight; 0 for signatures of no exemplar
        self.seen: dict[str, tuple[float, float, int]] = {}

    def judge(self, part: str) -> tuple[float, float, int]:
        """(residue cover, furniture cover, terms) of a window.

        A window with too little weight in the exemplars' vocabulary can be
        covered by none of them, so its postings are not read.
        """
        if (found := self.seen.get(part)) is not None:
            return found
        whole = part
        # a sentence that quotes a passage of three words or more is judged by what it says itself
        for m in _QUOTED.finditer(part):
            if m[0].count(" ") >= 2 and len(_TERM.findall(_fold(outside := part[: m.start()] + " " + part[m.end() :]))) >= 3:
                part = outside
                break
        terms, known, inside = _TERM.findall(_fold(part)), self.known, 0.0
        n = len(terms)
        for t in terms:
            w = known.get(t)
            if w is None:
                w = self.idf.get(_signature(t), 0.0)
                if len(known) < 200_000:
                    known[t] = w
            if w:
                inside += w
            else:
                inside -= self.rare * self.least / (1 - self.least)
        bad, around = self.cover(signatures(part)) if n and inside >= 0 else (0.0, 0.0)
        if len(whole) < 200 and (bad or around) and len(self.seen) < 50_000:
            self.seen[whole] = bad, around, n
        return bad, around, n

    def cover(self, terms: list[str]) -> tuple[float, float]:
        """Share of the window's weight that its best residue exemplar contains, and its best furniture exemplar."""
        total, score = 0.0, defaultdict(float)
        for t, k in Counter(terms).items():
            w = k * self.idf.get(t, self.rare)
            total += w
            for e in self.postings.get(t, ()):
                score[e] += w
        if not total:
            return 0.0, 0.0
        bad = around = 0.0
        for e, v in score.items():
            if self.labels[e]:
                bad = max(bad, v)
            else:
                around = max(around, v)
        return bad / total, around / total


def unfilled_fields(text: str) -> int:
    """Template fields standing in the text itself, not quoted as examples."""
    n = 0
    for m in _FIELD.finditer(text) if _FIELD_HINT.search(text) else ():
        before, after = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
        n += not (before and before in _QUOTES and after and after in _QUOTES)
    return n


def weigh_page(text: str, index: ExemplarIndex) -> tuple[int, int, int]:
    """(residue words, content words, unfilled fields) of one page.

    Headings (short lines without closing punctuation), lists of links and
    page furniture are neither.
    """
    residue = content = 0
    fields, coverage = unfilled_fields(text), index.least
    for line in text.split("\n"):
        line = line.strip()
        if not line or (line[0] in "©(" or not line[0].isascii()) and _FOOTER.match(line):
            continue
        if fields:
            line = _FIELD.sub(" ", line)
        parts = _SENTENCE.split(line)
        for part in parts:
            bad, around, n = index.judge(part)
            if bad >= coverage and bad > around:
                residue += n
            elif around < coverage and _is_sentence(part, n):
                content += n
    return residue, content, fields


def _windows(text: str) -> Iterator[str]:
    """Passage windows of a page, without its footer."""
    for line in text.split("\n"):
        line = line.strip()
        if line and not ((line[0] in "©(" or not line[0].isascii()) and _FOOTER.match(line)):
            yield from _SENTENCE.split(line)


def _head(part: str) -> tuple[str, ...]:
    """The first two terms, by which most windows are told from the sample's at once."""
    return tuple(map(_signature, _TERM.findall(_fold(part[:60]))[:2]))


def _is_sentence(part: str, n: int) -> bool:
    return n > 3 and (n > 9 or bool(_TAIL.search(part)))


def _labelled_passages(docs: DataFrame, pages: int, passages: int) -> dict[int, dict[str, tuple[str, bool]]]:
    """Page -> signature -> (head, whether it is a sentence), of a sample of the labelled pages without fields."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for part in () if unfilled_fields(t) else dict.fromkeys(_windows(t)):
                    if len(part) <= _LONGEST_PASSAGE and (sig := signatures(part)):
                        rows.append((d, " ".join(sig), "\t".join(_head(part)), _is_sentence(part, len(sig))))
            cols = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.bool_()))], names=["d", "sig", "head", "sentence"])

    # the least hashes make the sample; only hashes are ordered, texts stay where they are
    h, marked = F.xxhash64("d"), docs.where("lab")
    most = marked.select(h.alias("h")).distinct().orderBy("h").limit(pages).agg(F.max("h").alias("h")).first().h
    found: dict[int, dict[str, tuple[str, bool]]] = defaultdict(dict)
    if most is None:
        return found
    told = marked.where(h <= most).select("d", "t").mapInArrow(run, "d bigint, sig string, head string, sentence boolean")
    for r in told.orderBy(F.xxhash64("d", "sig"), "d", "sig").limit(passages).collect():
        found[r.d][r.sig] = (r.head, r.sentence)
    return found


def _counts(docs: DataFrame, vocabulary: set[str], passages: dict[str, str]) -> tuple[dict[str, int], dict[str, tuple[int, int]], int, int]:
    """Documents per term and per passage of the sample, over the whole collection: bounded by the exemplars.

    ``(df, passage -> (documents, labelled documents), documents, labelled documents)``.
    """
    known, heads = frozenset(vocabulary), frozenset(passages.values())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df: Counter[str] = Counter()
        seen: dict[str, list[int]] = {}
        cached: dict[str, str] = {}
        for batch in batches:
            for t, lab in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                terms = set(_TERM.findall(_fold(t)))
                hits = terms & known
                hits.update(known.intersection(_signature(x) for x in terms if "*" in x or x[0].isdigit() or x[-1].isdigit()))
                df.update(hits)
                met = set()
                for part in _windows(t) if heads else ():
                    if (sig := cached.get(part)) is None:
                        sig = " ".join(signatures(part)) if "\t".join(_head(part)) in heads else ""
                        sig = sig if sig in passages else ""
                        if len(part) < 200 and len(cached) < 20_000:
                            cached[part] = sig
                    if sig:
                        met.add(sig)
                for sig in (*met, ""):
                    n = seen.setdefault(sig, [0, 0])
                    n[0] += 1
                    n[1] += bool(lab)
        rows = [*((False, k, v, 0) for k, v in df.items()), *((True, k, *v) for k, v in seen.items())]
        cols = list(zip(*rows)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.bool_(), pa.string(), pa.int64(), pa.int64()))], names=["whole", "key", "n", "labelled"])

    counted = docs.select("t", "lab").mapInArrow(count, "whole boolean, key string, n bigint, labelled bigint").groupBy("whole", "key").agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"))
    rows = counted.collect()  # one row per exemplar term and sampled passage
    df = {r.key: r.n for r in rows if not r.whole}
    per = {r.key: (r.n, r.labelled) for r in rows if r.whole}
    n, labelled = per.pop("", (0, 0))
    return df, per, n, labelled


def learn_exemplars(pages: dict[int, dict[str, tuple[str, bool]]], counts: dict[str, tuple[int, int]], n: int, labelled: int, lift: float = LIFT, even: float = EVEN) -> list[tuple[str, frozenset[str]]]:
    """Exemplars of the sampled pages: their passages that all pages rarely have, together; furniture one by one.

    A passage alone on its page must be a sentence; a shorter one (a heading, a
    code) must stand on several labelled pages.
    """
    out, base = set(), labelled / max(n, 1)
    for passages in pages.values():
        terms: set[str] = set()
        for sig, (_, sentence) in passages.items():
            k, m = counts.get(sig, (1, 1))
            if m >= min(1.0, lift * base) * k:
                if sentence or m > 1:
                    terms.update(sig.split())
            elif m <= even * base * k:
                out.add(("", frozenset(sig.split())))
        if terms:
            out.add(("learned", frozenset(terms)))
    return sorted(out, key=lambda x: (x[0], sorted(x[1])))


def find_residue(
    documents: DataFrame, doc_id: str, text: str, coverage: float = COVERAGE, content_share: float = CONTENT_SHARE, exemplars: ExemplarIndex | None = None,
    labelled: Column | None = None, labelled_pages: int = LABELLED_PAGES, labelled_passages: int = LABELLED_PASSAGES,
) -> DataFrame:
    """``(doc_id, residue_words, content_words, fields, is_residue)`` per document.

    A document is residue if it holds unfilled template fields (found by their
    syntax, ``unfilled_fields``), or if windows covered by residue exemplars make
    up more than ``1 - content_share`` of its words outside page furniture and
    headings.  Null texts and ids yield no row, empty texts count as no residue;
    whole texts are read; repeated rows stay.

    ``labelled`` is a condition that marks pages known to be no content, such as
    those served with an error status; null counts as false.  Exemplars are
    learned from at most ``labelled_pages`` of them, taken by a hash, and
    ``labelled_passages`` of their passages; frequencies of terms and passages
    are counted over all documents.  Without labels the public exemplars serve.
    """
    lab = F.coalesce(labelled.cast("boolean"), F.lit(False)) if labelled is not None else F.lit(False)
    docs = documents.select(F.col(doc_id).cast("bigint").alias("d"), F.col(text).cast("string").alias("t"), lab.alias("lab")).where("d is not null and t is not null")
    pages = _labelled_passages(docs, labelled_pages, labelled_passages) if labelled is not None and exemplars is None else {}
    passages = {sig: head for p in pages.values() for sig, (head, _) in p.items()}
    index = exemplars or ExemplarIndex(least=coverage)
    df, counts, n, n_labelled = _counts(docs, {*index.vocabulary, *(t for sig in passages for t in sig.split())}, passages)
    if pages:
        index = ExemplarIndex(least=coverage, learned=learn_exemplars(pages, counts, n, n_labelled))
    index.weigh(df, n)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, *weigh_page(t, index)) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            cols = list(zip(*rows)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "residue_words", "content_words", "fields"])

    judged = docs.select("d", "t").mapInArrow(scan, "doc_id bigint, residue_words bigint, content_words bigint, fields bigint")
    words = F.col("residue_words") + F.col("content_words")
    return judged.withColumn("is_residue", (F.col("fields") > 0) | ((F.col("residue_words") > 0) & (F.col("content_words") < content_share * words)))
