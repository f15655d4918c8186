"""Template residue, filler, error messages and script notices in short texts.

One multi-pattern automaton runs over the folded text. It carries the phrases
of several languages and the opening signs of placeholders; a hit on a sign is
verified by the placeholder's own form. A text is residue when a placeholder is
left in it, or when the phrases cover enough of the whole text or of one of its
parts between separators, so that only site or posting names remain beside.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases by kind and language. "§" stands for an HTTP status
# code of 400 to 599. They are matched at word limits, in any case.
ERROR_PHRASES = {
    "en": [
        "§", "http §", "http status §", "status §", "status code §", "error §", "error code §", "§ error", "error: §", "not found", "page not found", "file not found", "object not found",
        "the page you requested could not be found", "the requested page could not be found", "this page could not be found", "this page does not exist", "page does not exist",
        "page isn't available", "this page isn't available", "page unavailable", "page not available", "page no longer available", "the requested url was not found on this server",
        "forbidden", "access denied", "access forbidden", "access blocked", "permission denied", "unauthorized", "not authorized", "you have been blocked", "request blocked", "blocked",
        "bad request", "bad gateway", "gateway timeout", "gateway time-out", "request timeout", "request timed out", "connection timed out", "gone", "payment required", "method not allowed",
        "too many requests", "rate limit exceeded", "rate limited", "service unavailable", "service temporarily unavailable", "temporarily unavailable", "internal server error", "server error",
        "application error", "runtime error", "fatal error", "parse error", "syntax error", "unexpected error", "an error occurred", "an error has occurred", "something went wrong", "oops", "whoops",
        "unhandled exception", "exception", "stack trace", "database error", "database connection failed", "error establishing a database connection", "connection failed", "connection refused",
        "request failed", "failed with §", "this site can't be reached", "this site cant be reached", "site can't be reached", "this page isn't working", "your connection is not private",
        "dns resolution error", "web server is down", "origin is unreachable", "host error", "session expired", "your session has expired", "session timed out", "we'll be right back", "we will be right back",
        "be right back", "under maintenance", "site under maintenance", "scheduled maintenance", "maintenance mode", "down for maintenance", "site offline", "website offline",
        "just a moment", "one moment please", "checking your browser", "attention required", "security check", "are you a robot", "are you human", "verify you are human", "verifying you are human",
        "captcha", "robot check", "bot check", "bot detection", "pardon our interruption", "ddos protection", "loading", "please wait", "redirecting",
    ],
    "de": [
        "fehler §", "fehlercode §", "fehler", "fehlerseite", "serverfehler", "interner serverfehler", "datenbankfehler", "anwendungsfehler", "ein fehler ist aufgetreten", "es ist ein fehler aufgetreten",
        "unerwarteter fehler", "seite nicht gefunden", "seite wurde nicht gefunden", "die seite wurde nicht gefunden", "seite existiert nicht", "die angeforderte seite existiert nicht",
        "die angeforderte seite wurde nicht gefunden", "diese seite existiert nicht", "seite nicht verfügbar", "diese seite ist nicht verfügbar", "nicht gefunden", "zugriff verweigert", "zugriff nicht möglich", "zugriff gesperrt",
        "zugriff nicht erlaubt", "kein zugriff", "anfrage blockiert", "anfrage fehlgeschlagen", "anfrage abgelehnt", "verbindung fehlgeschlagen", "zeitüberschreitung", "zu viele anfragen", "dienst nicht verfügbar",
        "dienst vorübergehend nicht verfügbar", "vorübergehend nicht erreichbar", "ihre sitzung ist abgelaufen", "sitzung abgelaufen", "wartungsarbeiten", "wartungsmodus", "wegen wartung geschlossen", "bot-prüfung läuft",
        "bot-prüfung", "sicherheitsprüfung", "sicherheitsabfrage", "einen moment bitte", "bitte warten", "bitte bestätigen sie, dass sie ein mensch sind", "wird geladen", "hoppla", "ups", "etwas ist schiefgelaufen",
    ],
    "fr": ["erreur §", "erreur", "erreur serveur", "erreur interne du serveur", "une erreur est survenue", "une erreur s'est produite", "page introuvable", "page non trouvée", "page inexistante", "cette page n'existe pas", "accès refusé", "accès interdit", "service indisponible", "trop de requêtes", "site en maintenance", "maintenance en cours", "session expirée", "veuillez patienter", "un instant"],
    "es": ["error §", "error del servidor", "error interno del servidor", "se ha producido un error", "ha ocurrido un error", "página no encontrada", "pagina no encontrada", "la página no existe", "esta página no existe", "acceso denegado", "acceso prohibido", "servicio no disponible", "demasiadas solicitudes", "sitio en mantenimiento", "en mantenimiento", "sesión caducada", "un momento", "espere por favor"],
    "pl": ["błąd §", "błąd", "błąd serwera", "wystąpił błąd", "nie znaleziono strony", "strona nie istnieje", "nie znaleziono", "strona nie została znaleziona", "dostęp zabroniony", "odmowa dostępu", "brak dostępu", "usługa niedostępna", "przerwa techniczna", "sesja wygasła", "chwileczkę", "proszę czekać"],
    "cs": ["chyba §", "chyba", "chyba serveru", "interní chyba serveru", "došlo k chybě", "nastala chyba", "stránka nenalezena", "stránka neexistuje", "stránka nebyla nalezena", "nenalezeno", "přístup odepřen", "přístup zamítnut", "služba nedostupná", "probíhá údržba", "relace vypršela", "okamžik prosím", "čekejte prosím"],
    "pt": ["erro §", "erro", "erro do servidor", "erro interno do servidor", "ocorreu um erro", "página não encontrada", "pagina não encontrada", "a página não existe", "esta página não existe", "acesso negado", "acesso proibido", "serviço indisponível", "muitas solicitações", "site em manutenção", "em manutenção", "sessão expirada", "um momento", "aguarde"],
}
SCRIPT_PHRASES = {
    "en": [
        "javascript is required", "javascript required", "javascript is disabled", "javascript disabled", "javascript is not enabled", "please enable javascript", "enable javascript", "turn on javascript", "please turn on javascript",
        "you need to enable javascript to run this app", "you need to enable javascript", "this site requires javascript", "this page requires javascript", "requires javascript", "activate javascript", "enable js",
        "please enable js", "enable js and disable any ad blocker", "please enable js and disable any ad blocker", "enable cookies", "please enable cookies", "cookies are required", "cookies required", "cookies must be enabled", "cookies are disabled",
        "enable javascript and cookies to continue", "javascript and cookies are required", "your browser does not support scripts", "your browser does not support javascript", "your browser is not supported", "unsupported browser", "browser not supported",
        "please update your browser", "noscript", "to continue", "this website uses cookies", "accept cookies", "cookie settings",
    ],
    "de": [
        "javascript ist deaktiviert", "javascript ist nicht aktiviert", "javascript deaktiviert", "javascript aktivieren", "bitte javascript aktivieren", "bitte aktivieren sie javascript", "diese seite benötigt javascript", "diese website benötigt javascript",
        "diese seite erfordert javascript", "javascript wird benötigt", "javascript erforderlich", "cookies und javascript werden benötigt", "javascript und cookies werden benötigt", "cookies werden benötigt", "cookies aktivieren", "bitte aktivieren sie cookies",
        "cookies erforderlich", "cookies sind deaktiviert", "browser nicht unterstützt", "skripte einschalten", "skripte aktivieren", "ihr browser unterstützt keine skripte", "ihr browser unterstützt kein javascript", "ihr browser wird nicht unterstützt",
        "bitte schalten sie javascript ein", "javascript einschalten", "cookie-einstellungen",
    ],
    "fr": ["veuillez activer javascript", "activez javascript", "javascript est désactivé", "javascript est requis", "javascript requis", "ce site nécessite javascript", "cette page nécessite javascript", "veuillez activer les cookies", "activez les cookies", "cookies requis", "navigateur non pris en charge", "pour continuer"],
    "es": ["active javascript para continuar", "active javascript", "activa javascript", "habilite javascript", "habilita javascript", "por favor active javascript", "javascript está desactivado", "javascript desactivado", "se requiere javascript", "este sitio requiere javascript", "active las cookies", "habilite las cookies", "se requieren cookies", "navegador no compatible", "para continuar"],
    "pl": ["włącz javascript", "proszę włączyć javascript", "javascript jest wyłączony", "wymagany javascript", "javascript jest wymagany", "ta strona wymaga javascript", "włącz obsługę javascript", "włącz cookies", "włącz pliki cookie", "twoja przeglądarka nie obsługuje skryptów", "nieobsługiwana przeglądarka", "aby kontynuować"],
    "cs": ["povolte javascript", "zapněte javascript", "prosím povolte javascript", "javascript je vypnutý", "javascript je vyžadován", "je vyžadován javascript", "tato stránka vyžaduje javascript", "povolte cookies", "zapněte cookies", "váš prohlížeč nepodporuje skripty", "nepodporovaný prohlížeč", "pro pokračování"],
    "pt": ["ative o javascript", "ative javascript", "habilite o javascript", "habilite javascript", "por favor ative o javascript", "javascript está desativado", "javascript desativado", "javascript é necessário", "é necessário javascript", "este site requer javascript", "ative os cookies", "habilite os cookies", "navegador não suportado", "para continuar"],
}
FILLER_PHRASES = {
    "any": [
        "lorem ipsum", "lorem ipsum dolor sit amet", "dolor sit amet", "consectetur adipiscing elit", "consectetur adipisici elit", "sed do eiusmod tempor", "consetetur sadipscing elitr", "ut enim ad minim veniam",
        "asdf", "asdfasdf", "asdf asdf", "asdfgh", "qwertz", "qwerty", "xxx", "xxxx", "xxxxx", "xyz", "foo bar", "foobar", "test test", "test test test", "test", "testseite", "test page", "testtest", "undefined", "undefined in undefined", "null", "null in null", "nan", "none", "nan stellenangebote", "nan jobs", "nan stellen", "nan results", "undefined stellenangebote", "undefined jobs", "null stellenangebote", "null jobs",
        "n/a", "[object object]", "object object", "function toString() { [native code] }", "todo", "tbd", "fixme",
    ],
    "en": [
        "untitled", "untitled document", "untitled page", "no title", "title", "page title", "your title here", "your title goes here", "title goes here", "insert title here", "enter title here", "document title", "new page", "new document", "sample page",
        "sample post", "sample job", "example page", "example domain", "default page", "default web site page", "default title", "placeholder", "placeholder text", "placeholder title", "dummy text", "dummy title", "dummy page", "job title", "job title here", "coming soon", "under construction",
        "site under construction", "website coming soon", "welcome to nginx", "apache2 ubuntu default page", "it works", "it works!", "test page for the apache http server", "index of", "directory listing", "domain for sale", "this domain is parked", "parked domain", "hello world", "headline", "heading", "heading 1", "welcome to your new website",
        "my site", "my website", "wordpress site", "just another wordpress site", "home page title", "do not publish", "please delete", "please replace",
    ],
    "de": [
        "titel", "titel hier eingeben", "titel hier einfügen", "titel eingeben", "titel einfügen", "hier titel eingeben", "seitentitel", "stellentitel", "stellentitel einfügen", "stellentitel eingeben", "jobtitel", "jobtitel eingeben", "jobtitel hier einfügen", "kein titel", "ohne titel", "unbenannt", "unbenanntes dokument", "unbenannte seite",
        "neue seite", "neues dokument", "überschrift", "überschrift hier", "beispielseite", "beispieltext", "beispieltitel", "musterseite", "mustertext", "mustertitel", "musteranzeige", "muster-stellenanzeige", "musterstellenanzeige", "bitte ersetzen", "bitte löschen", "bitte ausfüllen", "dummy-stelle", "dummy-text", "dummytext",
        "blindtext", "blindtext überschrift", "platzhalter", "platzhaltertext", "platzhaltertitel", "teststelle", "testanzeige", "test bitte ignorieren", "hier entsteht eine neue webseite", "hier entsteht eine neue website", "hier entsteht in kürze eine neue internetpräsenz", "hier entsteht", "demnächst verfügbar", "in kürze verfügbar", "im aufbau", "seite im aufbau",
        "diese seite befindet sich im aufbau", "es klappt! ihr server läuft", "es klappt", "ihr server läuft", "domain zu verkaufen",
    ],
    "fr": ["sans titre", "document sans titre", "page sans titre", "titre", "titre de la page", "votre titre ici", "insérez le titre ici", "page d'exemple", "exemple de page", "page par défaut", "texte de remplissage", "en construction", "bientôt disponible", "nouvelle page"],
    "es": ["sin título", "documento sin título", "título", "título de la página", "tu título aquí", "su título aquí", "página de ejemplo", "página de muestra", "página por defecto", "texto de relleno", "en construcción", "próximamente", "nueva página"],
    "pl": ["bez tytułu", "dokument bez tytułu", "tytuł", "tytuł strony", "wpisz tytuł", "przykładowa strona", "strona domyślna", "tekst zastępczy", "w budowie", "strona w budowie", "wkrótce", "nowa strona"],
    "cs": ["bez názvu", "dokument bez názvu", "název", "název stránky", "zadejte název", "ukázková stránka", "výchozí stránka", "zástupný text", "ve výstavbě", "již brzy", "nová stránka"],
    "pt": ["sem título", "documento sem título", "título da página", "seu título aqui", "página de exemplo", "página padrão", "texto de preenchimento", "em construção", "em breve", "nova página"],
}
#: Names under which templates fill their blanks; a single pair of brackets needs one of them, or a name with a dot, an underscore or inner capitals.
FIELD_NAMES = [
    "anzahl", "count", "city", "company", "firma", "firmenname", "headline", "item", "job", "jobtitle", "jobtitel", "location", "metatitle", "name", "ort", "page", "position", "posting", "region", "seite", "stadt", "stelle", "stellentitel",
    "title", "titel", "titre", "título", "unternehmen", "überschrift", "berufsbezeichnung", "seo", "id", "nr", "beruf", "rolle", "role", "department", "abteilung", "platzhalter", "placeholder", "variable", "value", "wert", "text",
]
#: Words that a message may have beside its phrases without being content.
LIGHT_WORDS = ["vorgang", "request", "id", "ref", "nr", "code", "mit", "with", "the", "and", "und", "oder", "or", "bitte", "please", "any", "in"]

_NAME = r"[^\W\d]\w*(?:[.\-]\w+)*"
_STRONG = {
    "{{": rf"\{{\{{\s*[#/^!&>]?\s*{_NAME}[^{{}}]{{0,60}}\}}\}}", "${": rf"\$\{{\s*{_NAME}\s*\}}", "#{": rf"#\{{\s*{_NAME}\s*\}}", "{%": r"\{%[^%]{1,60}%\}", "{!": rf"\{{!\s*{_NAME}\s*\}}", "<%": r"<%[^%]{1,60}%>",
    "<<": rf"<<\s*{_NAME}\s*>>", "@@": rf"@@\s*{_NAME}\s*@@", "[[": rf"\[\[\s*{_NAME}\s*\]\]", "__": r"__[^\W\d][\w.]*?__", "$(": rf"\$\(\s*{_NAME}\s*\)", "$$": rf"\$\$\s*{_NAME}\s*\$\$", "*|": rf"\*\|\s*{_NAME}\s*\|\*", "##": rf"##+\s*{_NAME}\s*##+",
    "%%": rf"%%\s*{_NAME}\s*%%", "???": rf"\?\?\?\s*{_NAME}\s*\?\?\?", "%s": r"(?<![\w%])%s(?!\w)", "%d": r"(?<![\w%])%d(?!\w)", "%1$": r"%1\$[sd]", "i18n": rf"i18n[:.]{_NAME}", "tx_": r"\btx_\w+(?:\.\w+)+", "[object": r"\[object object\]", "~": rf"~{_NAME}~",
}
_WEAK = {"[": rf"\[\s*({_NAME})(?:\s+(?:einfügen|eingeben|einsetzen|here|hier))?\s*\]", "{": rf"\{{\s*(#?{_NAME}|\d)\s*\}}", "<": rf"<\s*/?\s*({_NAME})\s*>", "#": rf"#({_NAME})#", "%": rf"%({_NAME})%", "(": rf"^\s*\(\s*({_NAME})\s*\)\s*$", "|": rf"\|({_NAME})\|"}
_SEPARATORS = re.compile(r"\s+[|–—·•»›/]\s*|\s*[|»›•]\s+|\s+-\s+|\s*::\s*|:\s+")
_WORDS = re.compile(r"(?<!\w)(?=[a-f]*\d)[0-9a-f]{4,}(?!\w)|[^\W\d]+|\d+|§")
_CODE = re.compile(r"(?<![\w.,])[45]\d\d(?![\w.,]*\d|\s*%)")


def fold(text: str) -> str:
    text = unicodedata.normalize("NFKC", text).replace("’", "'").replace("´", "'").replace("­", "")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = text.replace(a, b)
    return re.sub(r"\s+", " ", text).strip()


class ResidueMatcher:
    """The automaton and the coverage rule; built once per Python worker."""

    def __init__(self, min_coverage: float = 0.8):
        import ahocorasick

        self.min_coverage = min_coverage
        self.auto = ahocorasick.Automaton()
        for family in (ERROR_PHRASES, SCRIPT_PHRASES, FILLER_PHRASES):
            for phrases in family.values():
                for p in phrases:
                    p = p.casefold()
                    self.auto.add_word(p, ("phrase", p))
        for signs, kind in ((_STRONG, "strong"), (_WEAK, "weak")):
            for sign in signs:
                self.auto.add_word(sign, (kind, sign))
        self.auto.make_automaton()
        self.strong = {k: re.compile(v) for k, v in _STRONG.items()}
        self.weak = {k: re.compile(v) for k, v in _WEAK.items()}
        self.names = {n.casefold() for n in FIELD_NAMES}
        self.light = {w.casefold() for w in LIGHT_WORDS}

    def _weak_name(self, name: str) -> bool:
        if name.isdigit() or name.startswith("#"):
            return True
        parts = re.split(r"[._\-]", name.casefold())
        return "_" in name or "." in name or any(p in self.names for p in parts) or bool(re.search(r"[a-zäöü][A-ZÄÖÜ]", name))

    def placeholders(self, text: str) -> bool:
        return self.scan(text)[0]

    def scan(self, text: str) -> tuple[bool, list[bool], str]:
        """Whether a placeholder is left; the characters that phrases cover; the folded text they refer to."""
        shown = fold(text)
        low = _CODE.sub("§", shown).casefold()
        if len(low) < len(shown) and "§" not in low:
            shown = low
        covered = [False] * len(low)
        spans = []
        signs: set[tuple[str, str]] = set()
        for end, (kind, word) in self.auto.iter(low):
            if kind != "phrase":
                signs.add((kind, word))
                continue
            start = end - len(word) + 1
            if (start and low[start - 1].isalnum() and word[0].isalnum()) or (end + 1 < len(low) and low[end + 1].isalpha() and word[-1].isalnum()):
                continue
            spans.append((start, end + 1))
        for kind, sign in signs:
            if kind == "strong":
                if self.strong[sign].search(shown) or self.strong[sign].search(low):
                    return True, covered, low
            else:
                for m in self.weak[sign].finditer(shown):
                    if self._weak_name(m.group(1)):
                        return True, covered, low
        spans.sort(key=lambda s: (s[0] - s[1], s[0]))  # longest first
        for a, b in spans:
            if not any(covered[a:b]):
                covered[a:b] = [True] * (b - a)
        return False, covered, low

    def _share(self, low: str, covered: list[bool], a: int, b: int) -> float:
        total = hit = 0
        for m in _WORDS.finditer(low[a:b]):
            w, n = m.group(), m.end() - m.start()
            inside = sum(covered[a + m.start() : a + m.end()])
            if inside == 0 and (w in self.light or any(c.isdigit() for c in w)):
                continue
            total += n
            hit += inside
        return hit / total if total else 0.0

    def coverage(self, text: str | None) -> float:
        """1.0 for a placeholder, else the largest covered share of the whole text or of one part of it; 0.0 for NULL and blanks."""
        if text is None or not text.strip():
            return 0.0
        placeholder, covered, low = self.scan(text)
        if placeholder:
            return 1.0
        if not any(covered):
            return 0.0
        best = self._share(low, covered, 0, len(low))
        cuts = [m.span() for m in _SEPARATORS.finditer(low) if not any(covered[m.start() : m.end()])]
        at = 0
        for a, b in [*cuts, (len(low), len(low))]:
            best = max(best, self._share(low, covered, at, a))
            at = b
        return best


@lru_cache(maxsize=4)
def matcher(min_coverage: float) -> ResidueMatcher:
    return ResidueMatcher(min_coverage)


def residue_coverage(text: Column, min_coverage: float = 0.8) -> Column:
    """Covered share of a text (double), 0 for NULL, empty and blank texts.

    Works on whole texts of any length in linear time; equal texts of a batch
    are looked at once.
    """

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = matcher(min_coverage)
        for s in batches:
            codes, values = pd.factorize(s, use_na_sentinel=True)
            share = [m.coverage(v) for v in values] + [0.0]
            yield pd.Series([share[c] for c in codes], dtype="float64")

    return run(text)


def is_residue(text: Column, min_coverage: float = 0.8) -> Column:
    return residue_coverage(text, min_coverage) >= min_coverage
