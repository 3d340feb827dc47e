"""Placeholders, filler, error messages and demands for scripts in place of text.

Each block of a page and each part of a title is masked (addresses, dates,
numbers, placeholders, filler and the names of the site), so that one message of
many sites becomes one key.  Exact hashes of the keys are grouped across
sources, and each key is judged once: one that recurs widely is a message if it
stands mostly where pages have no other text of their own, and phrase rules say
so or, in any language, it does so nearly always.  Text that recurs on no other
source is judged by the phrase rules alone.  Placeholders in the article of a
page are found by their marks outside code.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrain.llm.page_parts import blocks
from tidegrain.runtime import join_small, stage

#: Sources on which a text has to recur to be judged by its recurrence, and to
#: be a message although no phrase rule knows it.
MIN_SOURCES, UNNAMED_SOURCES = 3, 5
#: Share of its pages that have no other text of their own, from which on a
#: recurring text is a message: one that resembles a message, and any other.
NAMED_ALONE, UNNAMED_ALONE = 0.5, 0.9
#: Share of filler words in filler, and of telling words in a recurring title.
FILLER_SHARE, TELLING_SHARE = 0.7, 0.5

# -- fixed values: marks of placeholders -------------------------------------
PLACEHOLDERS = re.compile(
    r"\{\{[^{}\n]+\}\}"
    r"|\$\{[^{}\n]+\}"
    r"|\{%[^%\n]+%\}"
    r"|<%[=@-]?[^%\n]+%>"
    r"|%%[A-Za-z][\w.-]*%%"
    r"|(?<![\w%])%[A-Z][A-Z0-9_]{2,}%(?![\w%])"
    r"|\[\[[^\[\]\n]+\]\]"
    r"|@@[A-Za-z][\w.-]*@@"
    r"|(?<!\w)__[A-Z][A-Z0-9_]*__(?!\w)"
    r"|(?<!\w)#[A-Z][A-Z0-9_]{2,}#(?!\w)"
    r"|\{[A-Za-z][A-Za-z0-9]*(?:[_.][A-Za-z0-9]+)*\}"
    r"|\[(?i:insert|enter|add|your|type|placeholder|title|name|date|todo|tbd)\b[^\[\]\n]*\]"
    r"|\b(?:TODO|FIXME|TBD):"
    r"|\bXX[./-]XX[./-](?:XX){1,2}\b"
    r"|\((?i:date|name|title|text|price|author) to be (?i:filled in|added|announced|confirmed)\)"
)
#: A whole title or heading that is a placeholder in words.
NAMELESS = re.compile(
    r"(?i)(your|page|post|article|site)? ?(title|headline|name|text|heading)( goes)? here|(page |site |post )?(title|headline|name) placeholder|placeholder( (title|text|page))?"
    r"|undefined|null|nan|\[object object\]|untitled( (document|page))?|new page|default title|sample (page|title|text)|test page"
)
#: Words of scrambled-Latin filler.
FILLER = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud "
    "exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint "
    "occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)
# -- fixed values: phrases of messages, in the languages of the collection ----
_PAGE = r"(the |this |that |your |requested |la |die |das |der |diese |gewünschte |angeforderte |cette |esta |página |a |o |il |l['’] ?)*"
_THING = r"(page|address|site|resource|document|file|content|url|link|article|seite|adresse|datei|ressource|inhalt|dokument|fichier|adresse|página|dirección|archivo|recurso|contenido|pagina|indirizzo|risorsa|documento|endereço|arquivo|conteúdo|site)"
#: At the start of a message, after an optional interjection: it is one.
OUTRIGHT = [
    # not found, gone, moved
    rf"{_PAGE}{_THING}( (that |which )?(you|we) [^.]{{0,40}})?( (solicitada|solicitado|demandée|demandé|richiesta|richiesto|requested))? (could not be|cannot be|can't be|was not|is not|wasn't|isn['’]t|not|no longer|does not|doesn't|has been|konnte nicht|wurde nicht|existiert nicht|ist nicht|est|n['’]existe|n['’]est|n['’]a pas|no (fue|ha sido|existe|se)|non (è|esiste|è stata)|não (foi|existe|está)|nicht|introuvable|non trovata|no encontrada|não encontrada)\b[^.]*",
    r"(we|i) (could|can|did|are) ?(not|n['’]t|unable to)? ?(find|locate|load)\b[^.]*(page|address|looking for|resource|site)[^.]*",
    r"no (hemos encontrado|se (ha )?encontr(ó|ado)|se pudo)\b[^.]*", r"não (encontramos|foi possível|foi encontrad[ao])\b[^.]*", r"(nous n['’]avons pas trouvé|impossible de trouver)\b[^.]*", r"non (abbiamo trovato|è stato possibile)\b[^.]*", r"wir konnten\b[^.]*nicht (finden|laden)",
    # no right
    r"(you|your account|your request) (do|does|have|has|are|is|was) (not|been|no)\b[^.]*(permission|allowed|authori[sz]ed|access|denied|blocked|forbidden|rights?)[^.]*",
    r"access (to this [^.]* )?(is |was |has been )?(denied|forbidden|blocked)[^.:]{0,40}", r"(zugriff|zugang) (verweigert|gesperrt|nicht erlaubt)[^.:]{0,40}", r"sie haben keine (berechtigung|rechte|erlaubnis)\b[^.]*",
    r"(accès|acceso|acesso|accesso) (est |está |è )?(refusé|interdit|denegado|prohibido|negado|proibido|negato|vietato)[^.:]{0,40}", r"vous n['’]avez pas (la permission|l['’]autorisation|le droit|accès)\b[^.]*",
    r"(usted )?no tiene(s)? (permiso|autorización|acceso)\b[^.]*", r"(você )?não tem (permissão|autorização|acesso)\b[^.]*", r"non (hai|dispone di|disponi|ha) (il permesso|l['’]autorizzazione|permess[oi]|access[oi]|autorizzazion[ei])\b[^.]*",
    # error of the server
    r"(an? |the )?(internal|unexpected|unknown|fatal|server|critical|application)( server)? (error|exception|failure)\b[^.]{0,80}[^.]*",
    r"fatal error\b.*", r"error (establishing|connecting|while|during|processing|loading)\b[^.]*", r"(uncaught|unhandled) (exception|error|typeerror)\b.*", r"warning: [a-z_]+\(\).*", r"(parse|syntax) error\b.*",
    r"(the |an? )?(upstream |bad )?gateway\b[^.]*(not answer|time|timed|error|failed|unavailable|invalid)[^.]*", r"(bad gateway|gateway time-?out)",
    r"(the |this |our )?(service|server|site|database|system) (is|was|has|did|are)\b[^.]{0,40}(unavailable|down|overloaded|busy|not (available|respond|answer)|maintenance|offline|unreachable|encountered)[^.]*", r"service (temporarily )?unavailable[^.]*",
    r"(der dienst|der server|die seite|der service) ist\b[^.]*(nicht erreichbar|nicht verfügbar|überlastet|gewartet)[^.]*", r"(ein )?(interner|unerwarteter|schwerer) (server)?fehler\b[^.]*", r"(es ist )?ein [^.]{0,30}fehler (ist )?aufgetreten[^.]*",
    r"(une )?erreur (interne|inattendue|serveur|critique)\b[^.]*", r"une erreur [^.]{0,40}(est survenue|s['’]est produite)[^.]*", r"le (service|serveur|site) est\b[^.]*(indisponible|surchargé|injoignable)[^.]*",
    r"(se ha producido|ha ocurrido|ocurrió) un error\b[^.]*", r"error (interno|inesperado)\b[^.]*", r"el (servicio|servidor|sitio) (no está|está)\b[^.]*(disponible|mantenimiento|sobrecargado)[^.]*",
    r"(ocorreu|houve) um erro\b[^.]*", r"erro (interno|inesperado)\b[^.]*", r"o (serviço|servidor|site) (não está|está)\b[^.]*(disponível|indisponível|manutenção)[^.]*",
    r"(si è verificato|c['’]è stato) un errore\b[^.]*", r"errore (interno|imprevisto|del server)\b[^.]*", r"il (servizio|server|sito) (non è|è)\b[^.]*(disponibile|manutenzione|raggiungibile)[^.]*",
    r"(too many requests|demasiadas solicitudes|trop de requêtes|troppe richieste|zu viele anfragen|muitas solicitações)\b[^.]*", r"(rate limit|quota|bandwidth limit)\b[^.]*exceeded[^.]*",
    # scripts, cookies, blockers
    r"(you (need|have) to |please |to [^.]{0,60} |for [^.]{0,60} |in order to [^.]{0,60} )*(enable|activate|allow|turn on|switch on|turn off|disable)\b[^.]{0,60}(javascript|scripts?|cookies?|blocker|adblock)[^.]*",
    r"(this |the |our )?(site|page|app|application|website|content|\w+)( \w+)? (requires|needs|works best with|doesn['’]t work (properly )?without|does not work without)\b[^.]{0,40}(javascript|scripts?|cookies?)[^.]*",
    r"(javascript|scripts|cookies)( support)? (is|are|must be|has to be|seems to be|is required|ist|sind|est|está|è)\b[^.]{0,20}(disabled|required|enabled|off|blocked|needed|deaktiviert|erforderlich|désactivé|requis|desactivado|necesario|desativado|necessário|disattivato|necessario)[^.]{0,60}",
    r"(bitte )?(aktivieren|erlauben|schalten) sie\b[^.]{0,60}(javascript|skripte?|cookies?)[^.]*", r"(bitte )?javascript (aktivieren|einschalten)[^.]*", r"(veuillez|merci d['’])\b[^.]{0,40}(activer|autoriser)\b[^.]{0,60}(javascript|scripts?|cookies?)[^.]*", r"activez (javascript|les cookies)[^.]*",
    r"(por favor,? )?(active|activa|habilite|habilita|ative|ativa|attiva|attivare|abilita|abiliti|attivi)\b[^.]{0,20}(javascript|scripts?|cookies?)[^.]*", r"(per|para|pour|um) [^.]{0,60}(bisogna|occorre|è necessario|hay que|debe|é preciso|deve|il faut|muss)\b[^.]{0,30}(attivare|abilitare|activar|habilitar|ativar|activer|aktivier)[^.]{0,20}(javascript|scripts?|cookies?)[^.]*",
    # human check
    r"(please )?(verify|confirm|prove|check) (that )?you(['’]re| are) (a )?(human|not a robot)[^.]*", r"(checking|verifying) (your browser|you are human|if the site connection)\b.*", r"(complete|solve) the (captcha|security check)[^.]*", r"(just a|one|please wait a) (moment|second)( please)?",
    r"(bitte )?bestätigen sie,? dass sie (ein mensch|kein roboter)[^.]*", r"(vérifiez|confirmez) que vous (êtes|n['’]êtes)[^.]*(humain|robot)[^.]*", r"(confirme|verifique|verifica|conferma|confirma) que\b[^.]*(humano|robot|robô)[^.]*", r"(verifica|conferma) di (essere|non essere)[^.]*(umano|robot)[^.]*",
]
#: A whole title that is a message.
TITLES = [
    r"(error |erreur |fehler |errore |erro |http )?(status )?# ?[:-]? ?(page )?(not found|forbidden|bad gateway|bad request|service unavailable|gateway time-?out|internal server error|internal error|unauthorized|gone|moved permanently|too many requests|error|unavailable|access denied|page not found|seite nicht gefunden|introuvable)",
    r"(error|erreur|fehler|errore|erro)( #)?", r"(page|site|file|document|article|content) (not found|not available|unavailable|no longer available|does not exist|missing)", r"(not found|forbidden|access denied|permission denied|bad gateway|service unavailable|internal server error|unauthorized|request blocked|too many requests|server error|application error|gateway time-?out)",
    r"(die |diese )?seite (wurde )?nicht (gefunden|verfügbar|erreichbar)", r"(zugriff|zugang) verweigert", r"page (introuvable|non trouvée|inexistante)", r"(accès|acceso|acesso|accesso) (refusé|interdit|denegado|negado|negato)", r"página no (encontrada|disponible)", r"página não (encontrada|disponível)", r"pagina non (trovata|disponibile)", r"(servicio|service|serviço|servizio) (no disponible|indisponible|indisponível|non disponibile)", r"(error|erro|errore|erreur) (interno|interne)( del servidor| do servidor| del server| du serveur)?",
    r"(oops|ooops|whoops|ups|ops|hoppla)?[!,. ]*(something went wrong|an error occurred|that page can['’]t be found|etwas ist schiefgelaufen|algo salió mal|algo deu errado|qualcosa è andato storto|une erreur est survenue)", r"(just a|one) moment( please)?", r"please wait", r"(attention required|security check|are you (a )?(human|robot)|verify you are human|robot check|captcha)", r"(please )?(enable|activate|turn on) (javascript|cookies)( and cookies)?( to (continue|view|use).*)?", r"(javascript|cookies?) (is |are )?(disabled|required|not enabled|deaktiviert|désactivé|desactivado|desativado|disattivato)", r"(bitte )?javascript aktivieren",
    r"this (page|site|content) (isn['’]t|is not|is no longer) (available|working|here|reachable)( right now| at the moment| anymore)?", r"(site|page) (under|in) (maintenance|construction)", r"(under construction|coming soon|maintenance|wartung|wartungsarbeiten)", r"lorem ipsum.*",
]
#: Words that make a short text resemble a message.
RESEMBLES = re.compile(
    r"(?i)\b(not found|error|denied|forbidden|unavailable|timed? ?out|javascript|captcha|human|robot|maintenance|expired|no longer|not exist|permission|nicht gefunden|fehler|verweigert|nicht erreichbar|berechtigung|introuvable|erreur|refusé|indisponible|no encontrad[ao]|denegado|erro|não encontrad[ao]|negado|errore|non trovat[ao]|negato)\b"
)
_START = re.compile(r"^(?:(?:oops|ops|ups|hoppla|sorry|error|attention|warning|hinweis|achtung|fehler|désolé|lo sentimos|lo siento|desculpe|spiacenti|ci dispiace|leider|please|http|status)\b[\s!,.:;#-]*|[#\s!,.:;-]+)*", re.I)
_OUTRIGHT = [re.compile(p, re.I) for p in OUTRIGHT]
_TITLES = [re.compile(p, re.I) for p in TITLES]
_WORD = re.compile(r"[^\W_]+")
_ADDRESS = re.compile(r"https?://\S+|\bwww\.\S+|\b[\w.-]+@[\w-]+\.\w+|\b(?:[a-z0-9-]+\.)+(?:example|com|org|net|[a-z]{2})\b", re.I)
_DATE = re.compile(r"\b\d{1,4}[./-]\d{1,2}[./-]\d{1,4}\b|\b\d{1,2}:\d{2}(?::\d{2})?\b")
_DOTTED = re.compile(r"\w[.@]\w|//")
_DIGIT, _NUMBER = re.compile(r"\d"), re.compile(r"\d+")
_SEPARATOR = re.compile(r"\s+[|–—·»-]\s+|\s+\(|\)$")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
#: What may follow a message in the same block.
_TAIL = re.compile(r"(?i)(please|try|go|return|back|reload|refresh|retry|check|contact|reference|this takes|use|see|click|bitte|versuchen|zurück|veuillez|réessayez|retour|vuelva|inténtelo|volver|por favor|tente|volte|riprova|torna|ritorna|you (can|may)|if (you|the)|it (may|might)|we (are|will|apologi)|sorry|then)\b.*")


@lru_cache(maxsize=20_000)
def site_words(host: str) -> frozenset[str]:
    """Words of the site's name in its address."""
    return frozenset(w for w in re.split(r"[^a-z]+", (host or "").lower()) if len(w) > 3)


def mask(text: str, site: frozenset[str]) -> str:
    """Addresses as ``@``, dates and numbers as ``#``, names of the site as
    ``~``, blanks made single; letters keep their case."""
    text = " ".join(text.split())
    if _DOTTED.search(text):
        text = _ADDRESS.sub("@", text)
    if _DIGIT.search(text):
        text = _NUMBER.sub("#", _DATE.sub("#", text))
    lower = text.lower()
    if any(w in lower for w in site):
        text = _WORD.sub(lambda m: "~" if m.group().lower() in site else m.group(), text)
    return text


def is_filler(text: str) -> bool:
    """Mostly words of filler, five at least."""
    found = [w.lower() for w in _WORD.findall(text)]
    return len(found) >= 3 and sum(w in FILLER for w in found) >= FILLER_SHARE * len(found) and any(w in ("lorem", "ipsum", "consectetur", "eiusmod", "incididunt", "adipiscing") for w in found)


def message_strength(masked: str) -> int:
    """2: outright a message, 1: resembles one, 0: neither.

    Every sentence has to be a message or what may follow one.
    """
    if masked == "&":
        return 2
    text = masked.strip(" .!")
    if any(p.fullmatch(text) for p in _TITLES):
        return 2
    outright = False
    for sentence in _SENTENCE.split(masked):
        said, bare = sentence.strip(" .!?"), _START.sub("", sentence).strip(" .!?")
        if not bare or (outright and (_TAIL.fullmatch(bare) or _TAIL.fullmatch(said))):
            continue
        if not any(p.fullmatch(x) for x in (said, bare) for p in (*_OUTRIGHT, *_TITLES)):
            return int(bool(RESEMBLES.search(masked)))
        outright = True
    return 2 if outright else 0


def has_placeholder(text: str) -> bool:
    """A mark of a placeholder stands in the text."""
    return bool(PLACEHOLDERS.search(text))


def residue_key(text: str, site: frozenset[str]) -> str:
    """What recurs of a text: filler as ``&``, placeholders as ``{}``, the rest
    masked."""
    return "&" if is_filler(text) else mask(PLACEHOLDERS.sub("{}", text), site)


def title_keys(title: str, site: frozenset[str]) -> list[str]:
    """The keys of a title and of its parts between separators."""
    whole = residue_key(title, site).strip()
    return list(dict.fromkeys(p.strip(" .!…").lower() for p in [whole, *_SEPARATOR.split(whole)] if p and p.strip(" .!…")))


def title_verdict(key: str, sources: int) -> bool:
    """Whether a key of titles is residue: it holds a placeholder or is filler
    or a message; if it recurs, also if most of its words tell of a message."""
    if "{}" in key or key == "&" or NAMELESS.fullmatch(key) or any(t.fullmatch(key) for t in _TITLES):
        return True
    if sources < MIN_SOURCES:
        return False
    telling = sum(len(_WORD.findall(m.group())) for m in RESEMBLES.finditer(key))
    return telling >= TELLING_SHARE * max(len(_WORD.findall(key)), 1)


def title_case(title: str, site: frozenset[str], sources: int = 1) -> bool:
    """The verdict on a single title; the name of a site before or after a
    separator doesn't count."""
    return any(title_verdict(k, sources) for k in title_keys(title, site))


@lru_cache(maxsize=20_000)
def _host(url: str | None) -> str:
    m = re.match(r"(?i)\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#:\s]+)", url or "")
    return m.group(1).lower() if m else ""


def _sentence_like(text: str) -> bool:
    end = text.rstrip()
    return end.rstrip("»… ")[-1:] in ".!?;:" and len(_WORD.findall(text)) >= 3 and not end.endswith(("»", "…")) and not text.startswith("©")


def page_rows(page: str, site: frozenset[str]) -> list[tuple[int, str | None, bool, bool, bool, bool]]:
    """(branch, key, sentence, h1, own, named) of what stands on a page outside
    branches that are marked as no article.

    ``own``: code and cells, which are a page's own text.  ``named``: one row of
    each branch whose every sentence is outright a message by phrase rules.  A
    page with a placeholder outside code has one row only, with branch -1.
    """
    blocks_ = [b for b in blocks(page) if not b.aside]
    if any(not b.code and has_placeholder(b.text) for b in blocks_):
        return [(-1, None, False, False, False, False)]
    out, other, said = [], set(), {}
    for b in blocks_:
        own = b.code or b.tag in ("td", "th")
        if own:
            other.add(b.branch)
            out.append((b.branch, None, False, False, True, False))
            continue
        key = residue_key(b.text, site)
        heading = b.tag in ("h1", "h2", "h3")
        sentence = not heading and (key == "&" or _sentence_like(b.text))
        if sentence or (not heading and len(b.text) > 3):
            said.setdefault(b.branch, []).append((key, sentence))
        out.append((b.branch, key, sentence, b.tag == "h1", False, False))
    for branch, keys in said.items():
        if branch in other:
            continue
        outright = False
        for key, sentence in keys:  # ends at the first sentence that is no message
            strength = message_strength(key)
            outright = outright or strength == 2
            if sentence and strength != 2:
                break
        else:
            if outright:
                out.append((branch, None, False, False, False, True))
    return out


def message_verdict(key: str, sentence: bool, sources: int, alone: float) -> bool:
    """Whether a recurring key is a message: ``sources`` that show it, and the
    share of its pages on which it stands alone."""
    if alone >= NAMED_ALONE and message_strength(key):
        return True
    return sentence and sources >= UNNAMED_SOURCES and alone >= UNNAMED_ALONE


def _pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for page_no, url, page in zip(batch["page_no"], batch["url"], batch["html"], strict=True):
            host = _host(url)
            out.extend((page_no, host, *row) for row in page_rows(page, site_words(host)))
        yield pd.DataFrame(out, columns=["page_no", "host", "branch", "key", "sentence", "h1", "own", "named"])


def _judge_messages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        case = [message_verdict(*x) for x in zip(batch["key"], batch["sentence"], batch["sources"], batch["alone"], strict=True)]
        yield batch.loc[case, ["h"]]


def _title_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = [(doc_id, host, key) for doc_id, title, host in zip(batch["doc_id"], batch["title"], batch["host"], strict=True) for key in title_keys(title, site_words(host))]
        yield pd.DataFrame(out, columns=["doc_id", "host", "key"])


def _judge_titles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        case = [title_verdict(*x) for x in zip(batch["key"], batch["sources"], strict=True)]
        yield batch.loc[case, ["h"]]


def _branches(when: Column) -> Column:
    """The branches of a page in which a row fulfils ``when``."""
    return F.collect_set(F.when(when, F.col("branch")))


def residue_pages(pages: DataFrame, min_sources: int = MIN_SOURCES) -> DataFrame:
    """Distinct page_no of pages that carry residue instead of real content.

    ``pages``: page_no, url, html; other columns, the status code among them,
    are not read.  Null ids and pages without html are no cases; a page
    delivered twice counts once; an empty table gives no rows.
    """
    return page_findings(pages, min_sources).select("page_no").distinct()


def page_findings(pages: DataFrame, min_sources: int = MIN_SOURCES) -> DataFrame:
    """Distinct (page_no, by) of residue pages; ``by`` tells what found them:
    ``recurring`` keys, ``phrases`` alone, or a ``placeholder`` in the article.

    Text of a page's own is code, cells and sentences that recur on fewer than
    ``min_sources`` hosts and are not outright messages.  A page with such text
    in the branch of its page heading has an article and is no case but for
    placeholders.  On other pages a key stands alone if its branch has no text
    of the page's own.
    """
    rows = pages.where("page_no IS NOT NULL AND html IS NOT NULL").select("page_no", "url", "html")
    rows = rows.mapInPandas(_pages, "page_no long, host string, branch int, key string, sentence boolean, h1 boolean, own boolean, named boolean")
    rows = stage(rows.withColumn("h", F.when(F.col("key").isNotNull(), F.xxhash64(F.lower("key")))))
    shown = rows.where("h IS NOT NULL").groupBy("h", "host").agg(F.lit(1).alias("_"))
    recurring = stage(shown.groupBy("h").agg(F.count("*").alias("sources")).where(F.col("sources") >= min_sources))
    marked = join_small(rows.where("branch >= 0").drop("key", "host"), recurring, ["h"], "left")
    again = F.col("sources").isNotNull()
    one = marked.groupBy("page_no").agg(
        _branches(F.col("own") | (F.col("sentence") & ~again)).alias("own"), _branches(F.col("h1")).alias("headed"), _branches(F.col("named")).alias("named"),
        F.collect_set(F.when(again, F.struct("h", "branch"))).alias("keys"),
    )
    one = one.withColumn("text", F.array_except("own", "named"))
    one = stage(one.where(F.size(F.array_intersect("text", "headed")) == 0).unionByName(one.where(F.size(F.array_intersect("text", "headed")) > 0).withColumn("text", F.lit(None).cast("array<int>"))))
    stands = one.select("page_no", "text", F.explode("keys").alias("k")).select("page_no", "k.h", F.coalesce(~F.array_contains("text", F.col("k.branch")), F.lit(False)).alias("alone"))
    stands = stands.groupBy("page_no", "h").agg(F.max("alone").alias("alone"))
    share = stands.groupBy("h").agg(F.avg(F.col("alone").cast("int")).alias("alone")).where(F.col("alone") >= NAMED_ALONE)
    open_ = stage(share.join(recurring, "h"))
    texts = join_small(rows.select("h", "key", "sentence"), open_.select("h"), ["h"], "left_semi").groupBy("h").agg(F.min("key").alias("key"), F.max("sentence").alias("sentence"))
    messages = stage(texts.join(open_, "h").select("h", "key", "sentence", F.col("sources").cast("int").alias("sources"), "alone").mapInPandas(_judge_messages, "h long"))
    by_key = join_small(stands.where("alone"), messages, ["h"], "left_semi").select("page_no", F.lit("recurring").alias("by"))
    by_phrase = one.where("text IS NOT NULL").where(F.size(F.array_intersect("named", "own")) > 0).select("page_no", F.lit("phrases").alias("by"))
    return by_key.union(by_phrase).union(rows.where("branch < 0").select("page_no", F.lit("placeholder").alias("by"))).distinct()


def residue_titles(documents: DataFrame) -> DataFrame:
    """Distinct doc_id of documents whose title is residue.

    ``documents``: doc_id, title, host.  Titles are masked and cut at their
    separators; each distinct key is judged once, with the number of hosts that
    show it.  Null ids and missing titles are no cases.
    """
    titled = documents.where("doc_id IS NOT NULL AND trim(title) != ''").select("doc_id", "title", F.lower(F.coalesce("host", F.lit(""))).alias("host"))
    rows = stage(titled.mapInPandas(_title_rows, "doc_id long, host string, key string").withColumn("h", F.xxhash64("key")))
    keys = rows.groupBy("h", "host").agg(F.min("key").alias("key")).groupBy("h").agg(F.min("key").alias("key"), F.count("*").cast("int").alias("sources"))
    cases = stage(keys.mapInPandas(_judge_titles, "h long"))
    return join_small(rows, cases, ["h"], "left_semi").select("doc_id").distinct()
