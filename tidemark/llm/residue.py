"""Problem 3: template residue, filler, error pages and script notices in place of content.

Each result is reduced to its answer (without query line, links and closing hint) or its instructions, and cut into
units (sentences and lines).

* Alignment. The skeleton of a unit has a gap for every slot, short delimited token, number, id, path and host. Units of
  all results are aligned by their skeletons. A skeleton recurs if it is met under at least three queries and as many as
  one in 10,000 results; the same answer given again to the same query is a copy, not a template. A result is suspect if half of its units recur or are bad by themselves; a recurring skeleton is a template if
  four fifths of its results are suspect. What content merely quotes, or says in the same words by chance, is met among
  content and so is none.
* Slots. Tokens in template syntax and the defaults of unset variables. A unit with two or more slots that retain a
  variable's name or nothing at all is residue.
* Whole pages. The set of skeletons of a result; if it recurs and one of its units is bad, the page is a template.
* Text without words, or words without grammar, and notices known beforehand (four languages): evidence for what is too
  rare to be aligned. `known=False` does without the lists of notices.

A result is residue if all its units are, if two or more are made of slots or filler, or if at least half are residue and
one of them is by alignment or three are. All counts are exact aggregates over all results; no result is compared with
another, and what is shuffled is hashes of skeletons.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from re import _constants as code
from re import _parser as parser

import ahocorasick
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut

_HEADER = re.compile(r"\A\s*Web search results for query:.*?(?:\n\s*\n|\Z)", re.S)
_LINKS = re.compile(r"^\s*Links:\s*\[\{.*?\}\]\s*$|^\s*Links:\s*\[\]\s*$", re.M | re.S)
_LEAD = re.compile(r"^\s*(?:Summary for [^\n]{0,300}:|Name the sources above when you answer\.|End of results\.)\s*$", re.M)
_INSTR = re.compile(r'"instructions"\s*:\s*"((?:[^"\\]|\\.)*)', re.S)
_TASK = re.compile(r"\A\s*(?:Research .{1,80}? in depth|Untersuche .{1,80}? gründlich|Survey what is known about .{1,80}?|Write a cited report on .{1,80}?)\.\s*")
_SPLIT = re.compile(r"(?<=[.!?…])[\"'”’)]*\s+(?=\S)|\s*\n+\s*")
_BULLET = re.compile(r"^(?:[-*•>#]+|\d{1,3}[.)])\s+")

_NAME = r"[A-Za-zÀ-ÿ][\w .\-]{0,30}?"
# How template languages and forms write a variable, and what stands there when it was never set.
SLOTS = [
    r"\{\{\{?\s*[\w.\[\]|\- ]{0,40}\s*\}?\}\}", r"\{%[^%]{0,60}%\}", r"\$\{[\w. ]{0,40}\}", r"#\{[\w. ]{0,40}\}", r"<%[=-]?[^%]{0,60}%>", r"<\?=?[^?]{0,60}\?>",
    r"%\([\w ]{1,40}\)[sdif]", r"%[A-Za-z_]{2,40}%", r"@@[\w ]{1,40}@@", r"\[\[[\w .\-]{1,40}\]\]", r"__[A-Za-z][\w]{1,40}__", r"\$[A-Z_]{2,40}\$", r"(?<!\w)\$[A-Za-z_]{2,40}\b",
    r"~[A-Za-z_]{2,40}~", r"\|[A-Za-z_]{2,40}\|", r"(?<!\w)\?[A-Za-z_]{2,40}\?", rf"\({_NAME}\?\)", r"&lt;[\w .\-]{1,40}&gt;", r"<[A-Z][A-Z_ .\-]{1,40}>", r"\*\|[\w ]{1,40}\|\*", r"«[\w ]{1,40}»",
    rf"\[(?:insert|enter|add|your|name of|placeholder|fill in|hier|inserte|insertar|su|ihr|einf(?:ü|ue)gen)\b[^\]]{{0,40}}\]", rf"\[{_NAME} (?:here|to be added|to follow|to come|goes here|tbd|pending|hier|einfügen|aquí)\]",
    r"\[[A-Z][A-Z_ .\-]{2,40}\]", r"\{[a-z_][\w.]{1,40}\}", r"_{3,}", r"\.{5,}", r"\bX{3,}\b", r"\[object Object\]", r"\b(?:undefined|NaN)\b", r"(?<![\w/])(?:null|None|nil|N/A|TBD|TODO|n/a)(?![\w/])",
    r":[a-z_]{3,30}:(?=\s|[.,;]|$)", r"\[\s*\]", r"(?<=\s)-{3,}(?=\s|[.,])",
]
_SLOT = re.compile("|".join(SLOTS))
#: Any short token between delimiters: a slot only if alignment shows it.
_WEAK = re.compile(r"(?<!\w)[\[\](){}<>%$#@~|?^*_=«»:+!/\\]{1,3}\s?[A-Za-z][\w ]{0,24}?\s?[\[\](){}<>%$#@~|?^*_=«»:+!/\\]{1,3}(?!\w)")

# Sentences of filler, of error pages and of script notices (lower case).
FILLER = [
    r"^lorem ipsum\b", r"^\W*(?:lorem|ipsum|dolor|tk)(?: \w+){0,3}\W*$", r"\b(?:sample|dummy|filler|placeholder|example|default) (?:text|copy|content|paragraph|sentence|post|page)\b(?!.{0,40}\b(?:was|were|in the|says|said)\b)",
    r"\b(?:text|copy|content|description|intro(?:duction)?|details?|headline|title|caption|label|paragraph|summary|body|item|step|point|feature) (?:text |description |details? |copy )?(?:go|goes|to go|will go) here\b",
    r"\b(?:description|text|details?|copy|caption|title|content|label) (?:here|pending|tbd|to (?:come|follow|be added))\W*$", r"\b(?:subheading|heading|image|title|text|button|headline|caption) (?:placeholder|caption|label)\W*$", r"\bplaceholder\W*$",
    r"^(?:put|add|insert|write|type|enter|replace|edit) (?:a|an|your|this|the|some|it|or)\b.{0,60}\b(?:here|own (?:copy|text|words)|delete it|text|copy)\b", r"\b(?:body copy|more text|content|details) to (?:follow|come)\b",
    r"\b(?:blindtext|platzhalter|beispieltext|mustertext|fülltext)\b", r"^hier (?:steht|kommt|folgt)\b.{0,40}\b(?:inhalt|text|später|beschreibung)\b", r"\btexto (?:de (?:relleno|ejemplo|muestra|prueba)|provisional|simulado)\b", r"\bcontenido (?:de (?:ejemplo|relleno|prueba)|provisional)\b",
    r"^aquí (?:irá|va|iría|vendrá)\b", r"^just another site\b", r"^welcome to wordpress\b", r"^edit or delete it\b", r"^hello world\W*$", r"^default post\b", r"^(?:paragraph|section|item|step|heading|column|slide) \d+\W*$",
    r"^uncategori[sz]ed\W*$", r"^leave a comment\W*$", r"\bfor layout purposes\b", r"^(?:tbd|tba|todo|tbc|wip|coming soon|under construction|work in progress|n/a)\W*$", r"^(?:loading|please wait|bitte warten|cargando|chargement)\W*$",
    r"^this is (?:a|your first|the default) (?:sample|dummy|test|placeholder|post)\b", r"^texte? (?:de remplissage|d'exemple|à venir)\b",
]
ERRORS = [
    r"\b(?:error|fehler|código|(?<!exit )code|erreur|status|http)[ :]*(?:4\d\d|5\d\d)\b", r"^\W*(?:4\d\d|5\d\d)\W+[a-z ]{3,40}\W*$", r"\b(?:page|site|url|resource|document|file|address|link) (?:you (?:were|are|requested).{0,40}|was |is |could |can ?not |has )?(?:not (?:be )?found|no longer|moved|missing|unavailable|broken|expired)\b",
    r"\b(?:seite|adresse|datei) (?:wurde )?nicht gefunden\b", r"\bangeforderte (?:seite|adresse|datei)\b", r"\bgibt es .{0,60}nicht\W*mehr\b", r"\bpágina no encontrada\b", r"\bpage introuvable\b", r"\b(?:el enlace|le lien)\b.{0,60}\b(?:caducado|incorrecto|rompu|périmé|roto)\b",
    r"^oops\b", r"\bcan'?t find the page\b", r"\bit may have (?:been )?(?:moved|removed|deleted)\b", r"^go to (?:the )?(?:start|home)\W?page\b", r"\b(?:something|etwas|algo) (?:went|ist|salió) (?:wrong|schief|mal)\b", r"\b(?:try again|come back|versuchen sie es|inténtelo) (?:in|later|später|erneut|más tarde|de nuevo)\b",
    r"^please (?:come back|try again|reload|refresh|wait)\b", r"\bdatabase (?:connection|error)\b.{0,40}\b(?:could not|failed|established|refused)\b", r"^(?:warning|fatal error|notice|uncaught \w+|parse error)\b.{0,80}\b(?:line|on line|at|in)\b", r"^traceback\b", r"^at \w+ ?\([^)]*\)\W*$",
    r"\b(?:access|zugriff|acceso|accès)\b.{0,60}\b(?:denied|verweigert|denegado|refusé|forbidden)\b", r"\bsent too many requests\b", r"\bslow down and retry\b", r"\bsite (?:is )?under maintenance\b", r"\bwill be back at\b", r"^thank you for your patience\b", r"\bnot available in your (?:region|country|area)\b",
    r"\bthe upstream\b.{0,40}\b(?:too long|timed out|failed|closed)\b", r"\bgave up after \d+ ?ms\b", r"\b(?:fetch|request|connection|lookup|handshake) (?:failed|refused|reset|timed out|aborted)\b", r"\bcertificate\b.{0,60}\b(?:ran out|expired|invalid)\b", r"^(?:request|ray|trace|incident|reference|error)[ -]?(?:id)?\W{0,2} ?#?[0-9a-f\-]{6,}\W*$",
    r'^\{"?(?:status|error|code|message)"?\s*:', r"<(?:html|head|title|h1|body|hr|noscript)\b", r"\b(?:service|gateway|server) (?:temporarily )?(?:unavailable|timeout|error|overloaded)\b", r"^(?:bad gateway|forbidden|not found|internal server error|unauthorized|too many requests)\W*$",
    r"\bteam has been (?:told|notified|informed)\b", r"\b(?:session|sitzung|sesión) (?:has )?(?:expired|timed out|abgelaufen|caducado)\b", r"^err_\w+:", r"\btook no connection\b", r"\bcould not answer this request\b", r"\b(?:nameserver|dns|host)\b.{0,40}\b(?:not (?:be )?(?:found|resolved)|unknown|failed)\b",
]
SCRIPTS = [
    r"^(?:\S+ ){0,12}javascript(?: \S+){0,8}$", r"\b(?:enable|turn on|activate|allow|switch on|requires?|needs?)\b.{0,20}\b(?:javascript|js|scripts|scripting|cookies)\b", r"\bjavascript\b.{0,40}\b(?:enabled|disabled|required|aktivieren|off|must|is)\b", r"\b(?:aktivieren|activez|activer|active|habilite|activar)\b.{0,20}\b(?:javascript|scripts?|cookies)\b",
    r"\b(?:scripting|scripts?|javascript) (?:switched|turned|is|are) (?:off|disabled)\b", r"\bneeds? scripts? to run\b", r"\bcookies must be (?:allowed|enabled)\b", r"^checking your browser\b", r"^verify(?:ing)? you are (?:a )?human\b", r"\bif you use (?:a|an) (?:ad ?)?blocker\b", r"\bone moment\W*$", r"\brequires js\b",
]
# Reporting words; a unit with one of these talks about such text.
REPORT = [
    r"\bexplains?\b", r"\brecommends?\b", r"\blists? the\b", r"\bcounts? how\b", r"\bshould be caught\b", r"\bthe guide\b", r"\bthe author\b", r"\bthe article\b",
    r"\bder artikel\b", r"\berklärt\b", r"\bel artículo\b", r"\bexplica\b", r"\bl'article\b", r"\bexplique\b", r"\bstudy\b", r"\bstudie\b", r"\bestudio\b", r"\bmade up\b",
    r"\bvisitors with\b", r"\bcomo\b", r"\bmeasured\b", r"\btypesetters\b", r"\bcame to use\b", r"\brewrote\b", r"\bgestaltet\b", r"\bsamples\b", r"\bexamples? from\b",
    r"\barchived pages\b", r"\bfor mail merges\b", r"\bsays\b", r"\bsaid\b", r"\bsagt\b", r"\bschreibt .{0,30}dass\b", r"\bdice\b", r"\bwrote\b", r"\bdescribes?\b",
    r"\bbeschreibt\b", r"\bdescribe\b", r"\bchapter\b", r"\bsection (?:explains|shows|on)\b", r"\brate of\b", r"\bper (?:cent|mille)\b", r"\btutorial\b",
    r"\bdocuments? how\b", r"\bteaches\b", r"\bmentions?\b", r"\bquotes?\b", r"\bzitiert\b", r"\bcita\b",
]


def literals(pattern) -> set[str] | None:
    """Strings one of which every match of a parsed pattern contains; None if it has none of two characters or more."""
    best: set[str] | None = None
    run = ""

    def offer(s: set[str] | None) -> None:
        nonlocal best
        if s and min(map(len, s)) >= 2 and (best is None or min(map(len, s)) > min(map(len, best))):
            best = s

    for op, arg in [*pattern, (None, None)]:
        if op is code.LITERAL:
            run += chr(arg)
            continue
        offer({run})
        run = ""
        if op is code.SUBPATTERN:
            offer(literals(arg[3]))
        elif op is code.BRANCH:
            each = [literals(x) for x in arg[1]]
            offer(None if None in each else set().union(*each))
        elif op in (code.MAX_REPEAT, code.MIN_REPEAT) and arg[0] > 0:
            offer(literals(arg[2]))
    return best


class Screen:
    """Whether one of many patterns is in a text; only those are tried whose literals an automaton finds in it."""

    def __init__(self, patterns: list[str]):
        self.patterns = [re.compile(p) for p in patterns]
        self.always, by = [], {}
        for i, p in enumerate(patterns):
            need = literals(parser.parse(p))
            if need is None:
                self.always.append(i)
            for x in need or ():
                by.setdefault(x, set()).add(i)
        self.auto = ahocorasick.Automaton()
        for x, ids in by.items():
            self.auto.add_word(x, tuple(ids))
        self.auto.make_automaton()

    def search(self, text: str) -> bool:
        tried = set(self.always)
        for _, ids in self.auto.iter(text):
            tried.update(ids)
        return any(self.patterns[i].search(text) for i in tried)


_FILLER, _ERRORS, _SCRIPTS, _REPORT = Screen(FILLER), Screen(ERRORS), Screen(SCRIPTS), Screen(REPORT)
#: Units that say nothing by themselves: numbers, ids, hosts with a few words.
_NEUTRAL = re.compile(r"^\W*\d+\W*$|^(?=.*\b(?:[0-9a-f]{8,}|[\w\-]+\.(?:example|invalid|test|com|org|net|io|dev)|\d{1,3}(?:\.\d{1,3}){3})\b)(?:\S+\s*){1,9}$", re.I)
_LOREM = re.compile(r"\blorem\b.{0,10}\bipsum\b")
# Words that prose of en, de, es or fr can hardly do without.
_GLUE = frozenset("the a an of to in is was and for that it with on as at by be not are or from this der die das und ist nicht mit für ein eine zu den von im auf es wir el la los las de que y en no un una con por para se le les des du est et dans pour une sur".split())
_MASK = re.compile(r"\b[0-9a-f]{8,}\b|\b[\w\-]+(?:\.[\w\-]+)*\.(?:example|invalid|test|com|org|net|io|dev)\b|(?<!<)/[\w/.\-]+|\b\w+/[\d.]+|\b\w*_\w+\b|\d+")
#: Queries under which a skeleton must be met to recur: this many, and this share of the number of results.
LEAST, RATE = 3, 1e-4
#: Share of a recurring skeleton's results that must be suspect.
TOGETHER = 0.8


def answer(text: str) -> str:
    """The answer or the instructions of a result."""
    m = _INSTR.search(text)
    if m and ("researchId" in text or "model" in text):
        body = m[1].replace("\\n", "\n").replace('\\"', '"').replace("\\t", " ").replace("\\/", "/").replace("\\\\", "\\")
        return _TASK.sub("", re.sub(r"\\u([0-9a-fA-F]{4})", lambda x: chr(int(x[1], 16)), body), count=1)
    return _LEAD.sub("", _LINKS.sub("", _HEADER.sub("", text, count=1)))


def units(body: str) -> list[str]:
    out = []
    body = _SLOT.sub(lambda m: m[0].replace("?", "\ue000").replace(".", "\ue001"), body)  # no cut within a slot
    for u in _SPLIT.split(body):
        u = u.replace("\ue000", "?").replace("\ue001", ".")
        u = _BULLET.sub("", u.strip()).strip()
        if u and any(c.isalnum() or c in "_?" for c in u):
            out.append(u)
    return out


def _gibberish(unit: str) -> bool:
    ws = re.findall(r"[^\W\d_]+", unit.lower())
    if len(ws) < 8:
        return len(ws) >= 4 and len(set(ws)) == 1
    return len(set(ws)) <= max(2, len(ws) // 6) or (len(ws) >= 15 and sum(w in _GLUE for w in ws) < 0.1 * len(ws))


def skeleton(unit: str) -> str:
    return _WEAK.sub("¤", _SLOT.sub("¤", unit))


def judge(unit: str, known: bool = True) -> str:
    """slot, filler, error, script, neutral or '' for a unit by itself."""
    low = unit.lower()
    n = len(_SLOT.findall(unit))
    bare = re.sub(r"[\W_]+", "", _SLOT.sub("", unit))
    reports = known and _REPORT.search(low)
    if (n >= 2 and not (reports and n < 3 and not unit.startswith(("Über", "In ", "Dear")))) or (n == 1 and len(bare) < 4):
        return "slot"
    if _gibberish(unit) or _LOREM.match(low):
        return "filler"
    if reports and len(low) > 40:
        return ""
    if known:
        for kind, screen in (("filler", _FILLER), ("script", _SCRIPTS), ("error", _ERRORS)):
            if screen.search(low):
                return kind
    return "neutral" if _NEUTRAL.search(unit) else ""


def key(unit: str) -> int:
    """A hash of a unit's skeleton, in which hosts, paths, ids and numbers are gaps too."""
    return xxhash.xxh64_intdigest(_MASK.sub("#", skeleton(unit)).lower()) - 2**63


def _units(results: DataFrame, known: bool) -> DataFrame:
    """result_table, result_id, origin (hash of the query, or of the result where none is known), page (hash of the set of skeletons), n (units that say something), bad, made (slots and
    filler), kind, keys (skeletons of the units that are neither bad nor neutral). The one scan of the texts."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: dict[str, list] = {c: [] for c in ("origin", "page", "n", "bad", "made", "kind", "keys")}
            for table, i, asked, text in zip(pdf["result_table"], pdf["result_id"], pdf["tool_input"], pdf["result_text"]):
                head = _HEADER.match(text)
                out["origin"].append(xxhash.xxh64_intdigest(asked or (head and head[0].strip().split("\n")[0]) or f"{table}\n{i}") - 2**63)
                us = units(answer(text))
                kinds, keys = [judge(u, known) for u in us], [key(u) for u in us]
                bad = [k for k in kinds if k not in ("", "neutral")]
                out["page"].append(xxhash.xxh64_intdigest(str(sorted(set(keys)))) - 2**63 if keys else None)
                out["n"].append(sum(k != "neutral" for k in kinds))
                out["bad"].append(len(bad))
                out["made"].append(sum(k in ("slot", "filler") for k in bad))
                out["kind"].append(max(bad, default=None))
                out["keys"].append([x for x, k in zip(keys, kinds) if k == ""])
            yield pdf[["result_table", "result_id"]].assign(**out).astype({"page": "Int64"})

    return results.mapInPandas(make, "result_table string, result_id long, origin long, page long, n int, bad int, made int, kind string, keys array<long>")


def residue(tables: dict[str, DataFrame], known: bool = True) -> DataFrame:
    """result_table, result_id, kind of each result that is residue. Null and blank texts are none; a redelivered row
    counts once. Results without any unit (only marks) are none."""
    ids = ["result_table", "result_id"]
    rows = reduce(DataFrame.unionByName, (t.select(F.lit(n).alias("result_table"), "result_id", (F.col("tool_input") if "tool_input" in t.columns else F.lit(None)).cast("string").alias("tool_input"), "result_text") for n, t in tables.items()))
    rows = rows.where(F.col("result_id").isNotNull()).where(F.length(F.trim(F.regexp_replace("result_text", r"[\s\p{Z}\p{Cf}]+", " "))) > 0).dropDuplicates(ids)
    results = cut(_units(rows, known))
    least = F.greatest(F.lit(LEAST), F.ceil(results.agg(F.count(F.lit(1))).scalar() * F.lit(RATE)))
    # one row per result and skeleton; nearly all skeletons are met once and are gone after the first aggregation
    each = results.select(*ids, "origin", F.explode("keys").alias("key")).groupBy(*ids, "origin", "key").agg(F.count(F.lit(1)).alias("c"))
    often = each.select("key", "origin").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") >= least).select("key")
    again = cut(each.join(often, "key"))
    found = lambda which, name: which.groupBy(*ids).agg(F.sum("c").alias(name))
    suspect = results.join(found(again, "r"), ids, "left").select(*ids, ((F.col("bad") + F.coalesce("r", F.lit(0))) * 2 >= F.greatest("n", F.lit(1))).alias("suspect"))
    templates = again.join(suspect, ids).groupBy("key").agg(F.avg(F.col("suspect").cast("double")).alias("share")).where(F.col("share") >= TOGETHER).select("key")
    pages = results.where("bad > 0 and page is not null").select("page", "origin").distinct().groupBy("page").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") >= least).select("page", F.lit(True).alias("again"))
    votes = results.drop("keys").join(found(again.join(templates, "key"), "a"), ids, "left").fillna(0, ["a"])
    some = votes.where("bad > 0 or a > 0").join(pages, "page", "left")
    total = F.col("bad") + F.col("a")
    whole = total == F.col("n")
    half = (total * 2 >= F.col("n")) & ((F.col("a") > 0) | (F.col("bad") >= 3))
    return some.where(whole | (F.col("made") >= 2) | half | F.coalesce("again", F.lit(False))).select(*ids, F.coalesce("kind", F.lit("template")).alias("kind"))


def clean(name: str, results: DataFrame) -> DataFrame:
    """The results of one table without residue; null and blank texts stay."""
    bad = residue({name: results}).select("result_id")
    return results.join(bad, "result_id", "left_anti")
