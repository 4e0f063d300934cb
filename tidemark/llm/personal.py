"""Problem 4: personal information in free text, found and replaced by typed placeholders.

A text is read through a small transducer that undoes disguises and remembers where every output character came from:
look-alike letters and full-width forms, invisible characters, digits spelled out, "at" and "dot" in words or brackets,
character references. Identifiers are detected in the plain form; their spans are mapped back to source characters, so
everything else of the text stays as it is. Plain texts take the short way: no disguise, same offsets.

Types: email, phone, id_number, street_address, person_name. Where candidates overlap the earlier type of ORDER wins.
Null and empty texts hold nothing.

Given names are learnt from the corpus itself (given_names): words met within sentences before two or more different
words that hardly occur without such a word before them, which are surnames. A short list of common names and forms of
address serve where the corpus is too small, and unknown names are found with a cue before and after.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textnorm import INVISIBLE, LOOKALIKES
from tidemark.session import cut

ORDER = ("email", "id_number", "phone", "street_address", "person_name")
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "street_address": "[STREET_ADDRESS]", "person_name": "[PERSON_NAME]"}

# ---- the transducer ------------------------------------------------------------------------------------------------
# Digits as words (en, de, es, fr).
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
}
_W = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_SPELLED = re.compile(rf"(?i)\b(?:(?:plus[ -])?(?:{_W}|double (?:{_W})|triple (?:{_W})|\d+)[ ,.\-]{{1,2}}){{4,}}(?:{_W}|\d+)\b")
_SPELLED_HINT = re.compile(rf"(?i)\b(?:{_W})[ ,.\-]{{1,2}}(?:{_W})[ ,.\-]{{1,2}}(?:{_W})\b")
_AT = re.compile(r"(?i)(?<=[\w]) ?[\[({<] ?(?:at|ät|arroba|arobase|a|@) ?[\])}>] ?(?=\w)|(?<=\w) (?:at|ät|arroba|arobase|klammeraffe) (?=[\w-]+(?: ?[\[({<]? ?(?:dot|punkt|punto|point) ?[\])}>]? ?[\w-]+)+)|&#0*64;|&#x0*40;|&commat;|(?<=[\w.])%40(?=\w)")
_DOT = re.compile(r"(?i)(?<=\w) ?[\[({<] ?(?:dot|punkt|punto|point|\.) ?[\])}>] ?(?=\w)|(?<=\w) (?:dot|punkt|punto) (?=\w)|&#0*46;|&period;")
_HINT = re.compile(r"(?i)[\[({<] ?(?:at|ät|arroba|arobase|a|@) ?[\])}>]|\b(?:at|ät|arroba|arobase|klammeraffe) [\w-]+ ?[\[({<]? ?(?:dot|punkt|punto|point)\b|&#|&commat;|%40|& ?period;")
_ZERO_WIDTH = frozenset(INVISIBLE)
#: Anything but ASCII, the letters of Latin-1 and marks that stay as they are: only such texts are read by character.
_UNUSUAL = re.compile("[^\x00-\x7fÀ-ÖØ-öø-ÿ¿¡«»“”„‘’€]")
_ATS, _DOTS = frozenset(("at", "ät", "arroba", "arobase", "klammeraffe")), frozenset(("dot", "punkt", "punto", "point"))
_DOUBLES = frozenset(("double", "triple"))


def _tokens(low: str) -> list[str]:
    """The words of a lower-case text, cheaply: what stands between white space and the usual marks."""
    for c in ",.-()[]{}<>:;/'\"|":
        if c in low:
            low = low.replace(c, " ")
    return low.split()


class Plain:
    """A text in plain form and the place of each of its characters in the source."""

    __slots__ = ("text", "at", "size", "low", "tokens")

    def __init__(self, text: str):
        self.size = len(text)
        self.at: list[int] | None = None
        if not text.isascii() and _UNUSUAL.search(text):
            chars, at = [], []
            same = True
            for i, c in enumerate(text):
                if c < "\x80":
                    chars.append(c)
                    at.append(i)
                    continue
                if c in _ZERO_WIDTH:
                    same = False
                    continue
                out = LOOKALIKES.get(c)
                if out is None:
                    out = " " if c in "     　" else "-" if c in "‐‑‒–−" else c if unicodedata.category(c)[0] == "L" and ord(c) < 0x250 else unicodedata.normalize("NFKC", c)
                same = same and len(out) == 1
                chars += out
                at += [i] * len(out)
            text = "".join(chars)
            self.at = None if same else at
        self.low = text.lower()
        self.tokens = words = _tokens(self.low)
        # the patterns of disguises are tried only where their words are
        known = frozenset(words)
        bracket = "(" in text or "[" in text or "<" in text or "{" in text
        at_word = not known.isdisjoint(_ATS)
        if ("&" in text or "%40" in text or (at_word and (bracket or not known.isdisjoint(_DOTS))) or (bracket and ("@" in text or "a" in known))) and _HINT.search(text):
            text = self._rewrite(text, _AT, lambda m: "@")
            text = self._rewrite(text, _DOT, lambda m: ".") if "@" in text else text
        if sum(w in DIGIT_WORDS for w in words) >= 3 and _SPELLED_HINT.search(text):
            text = self._rewrite(text, _SPELLED, self._digits)
        self.text = text

    @staticmethod
    def _digits(m: re.Match) -> str:
        out, times = [], 1
        for w in re.findall(r"\w+", m[0].lower()):
            if w in ("double", "triple"):
                times = 2 if w == "double" else 3
            elif w == "plus":
                out.append("+")
            else:
                out.append(DIGIT_WORDS.get(w, w) * times)
                times = 1
        return "".join(out)

    def _rewrite(self, text: str, pattern: re.Pattern, new) -> str:
        parts, at, last = [], [], 0
        old = self.at or range(len(text))
        for m in pattern.finditer(text):
            put = new(m)
            parts += [text[last : m.start()], put]
            at += [*old[last : m.start()], *[old[m.start()]] * len(put)]
            last = m.end()
        if not parts:
            return text
        self.at = [*at, *old[last:]]
        return "".join(parts) + text[last:]

    def source(self, lo: int, hi: int) -> tuple[int, int]:
        """The source span of [lo, hi): up to where the next plain character begins."""
        if self.at is None:
            return lo, hi
        end = self.at[bisect_right(self.at, self.at[hi - 1])] if self.at[hi - 1] < self.at[-1] else self.size
        return self.at[lo], end


# ---- detectors -----------------------------------------------------------------------------------------------------
_EMAIL = re.compile(r"(?<![\w.+%-])[\w][\w.+%'-]{0,63}@(?:[A-Za-z0-9](?:[\w-]{0,62}\w)?\.)+[A-Za-z]{2,24}(?![\w@])(?!\()", re.A)
#: Runs that may be a phone or id number: at least 7 characters of digits, separators and capitals.
_RUN = re.compile(r"(?<![\w@.#/:+-])(?:\+ ?|\()?[A-Z]{0,3}(?: ?(?=\d))?\d[\dA-Z]*(?:(?: ?[-./()] ?| )?[\dA-Z(]+\)?){0,12}", re.A)
# Words that announce an identity, licence, tax, social insurance or bank number of a person.
ID_WORDS = (
    r"passport|reisepass|pasaporte|passeport|(?:personal)?ausweis\w*|perso\b|dni|nie|nif|cni|identity (?:card|document|no|number)|id card|identity|national id|(?:carte|tarjeta) (?:d'identité|de identidad)|documento (?:nacional )?de identidad|"
    r"ssn|social (?:security|insurance)|sozialversicherung\w*|versicherungsnummer|seguridad social|sécurité sociale|national insurance|ni (?:number|no)|nino|insurance (?:number|no)|krankenversicherten\w*|"
    r"steuer-?(?:id|nummer|identifikationsnummer|nr)\w*|tax (?:id|number|no|identification)|taxpayer|tin|utr|itin|número fiscal|numéro fiscal|"
    r"(?:driver'?s?|driving) (?:licen[cs]e|permit)|licen[cs]e (?:no|number)|führerschein\w*|permiso de conducir|carné de conducir|permis de conduire|"
    r"iban|bank account|account (?:no|number)|kontonummer|konto-?nr|sort code|cuenta bancaria|número de cuenta|numéro de compte|bic\b"
)
_ID_BEFORE = re.compile(rf"(?i)(?<![\w-])(?:{ID_WORDS})(?:['’]s)?(?: ?(?:no|nr|num|number|nummer|número|numéro|id|card|code)\b\.?)?(?: ?(?:is|was|lautet|ist|es|est)\b)?[ :#=.\"'n°º]{{0,4}}$")
_ID_SHAPE = re.compile(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?$|\d{3}-\d{2}-\d{4}$|\d{8}-?[A-Z]$|[XYZ]-?\d{7}-?[A-Z]$|[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-Z]$")
_NOT_PHONE = re.compile(r"(?i)(?:\b(?:order|invoice|ticket|case|issue|commit|epoch|build|port|version|ref(?:erence)?|id|sku|isbn|ean|part|serial|chapter|page|row|line|unix|timestamp|batch|job|pid|account|customer|rechnung|bestellung|auftrag|factura|pedido|release)\b[ .:#]*(?:no|nr|number|nummer)?[ .:#]*)$|(?<!tel)(?<!phone)(?<!mobile)=$|[#/]$|\b(?:no|nr)\.? ?$")
_PHONE_CUE = re.compile(r"(?i)(?:\b(?:tel\w*|phone|mobile|mobil|handy|cell|call|text|sms|whatsapp|fax|ring|reach|callback|number|nummer|móvil|erreichbar|llámame|llamar?|anrufen|rufnummer|contact|signal)\b[^\d\n]{0,24}|\|\s*|^\s*|\n\s*)$")
_NANP = re.compile(r"(?:\+?1[-. ]?)?(?:\([2-9]\d\d\) ?|[2-9]\d\d[-. ])[2-9]\d\d[-. ]\d{4}$")

# Words of streets, of which an address has one; and endings of German ones, which a number follows.
_STREET_WORDS = frozenset("""street st road rd avenue ave lane ln drive dr court ct square sq terrace boulevard blvd close crescent way place pl highway hwy parkway grove gardens row hill mews
calle c avenida avda av paseo plaza camino carrera ronda travesía via viale corso piazza rue bd chemin allée impasse quai route""".split())  # fmt: skip
_STREET_ENDS = ("straße", "strasse", "str.", "weg", "gasse", "allee", "platz", "ufer", "damm", "ring", "chaussee", "steig", "pfad", "graben", "markt")
_NUMBERED = re.compile(r"(?<=[^\W\d_]) (?=\d)|(?<=\.) (?=\d)")


def _has_street(plain: Plain) -> bool:
    """Whether an address can be in a text: it has a street word, or a word with a street's ending before a number."""
    if not _STREET_WORDS.isdisjoint(plain.tokens):
        return True
    low = plain.text.lower()
    return any(low.endswith(_STREET_ENDS, 0, m.start()) for m in _NUMBERED.finditer(low))


_CAPS = r"[A-ZÄÖÜÁÉÍÓÚÑ][\w'’-]*"
_EN = r"(?:Street|St\.?|Road|Rd\.?|Avenue|Ave\.?|Lane|Ln\.?|Drive|Dr\.?|Court|Ct\.?|Square|Sq\.?|Terrace|Boulevard|Blvd\.?|Close|Crescent|Way|Place|Pl\.?|Highway|Hwy\.?|Parkway|Grove|Gardens|Row|Hill|Mews)(?!\w)"
_UNIT = r"(?:, ?(?:Apt|Apartment|Flat|Unit|Suite|Ste|No)\.? ?\w{1,5}|, ?\d{1,2}(?:st|nd|rd|th) floor|, ?\d{1,2}\.? ?(?:Stock|OG|Etage)|, ?\d{1,2}[ºª°](?: ?[A-Z0-9]{1,3}\b)?|, ?(?:bajo|ático|entresuelo)(?: [A-Z])?)"
_PLACE = rf"(?:,? ?(?:[A-Z]{{1,2}}-)?\d{{5}} {_CAPS}(?: {_CAPS})?|, {_CAPS}(?: {_CAPS})?(?: \d{{4,5}})?)?"
_ADDRESS = re.compile(
    rf"(?:\b(?:Flat|Apartment|Apt\.?|Unit|Suite) \w{{1,5}}, )?\b\d{{1,5}}[A-Za-z]?,? (?!(?:The|A|An|In|On|At|This|That|Our) )(?:{_CAPS} ){{1,3}}{_EN}{_UNIT}?{_PLACE}"
    rf"|\b(?:{_CAPS} ){{1,2}}(?:Street|Road|Avenue|Lane|Drive|Court|Square|Terrace|Boulevard|Close|Crescent|Way|Place|St\.|Rd\.|Ave\.) \d{{1,4}}[A-Za-z]?\b(?![.:,]?\d){_UNIT}?{_PLACE}"
    rf"|\b[A-ZÄÖÜ][\w-]*(?:[Ss]traße|[Ss]trasse|[Ss]tr\.|[Ww]eg|[Gg]asse|[Aa]llee|[Pp]latz|[Uu]fer|[Dd]amm|[Rr]ing|[Cc]haussee|[Ss]teig|[Pp]fad) \d{{1,4}}(?: ?[a-zA-Z]\b)?(?:[-/]\d{{1,4}})?{_UNIT}?{_PLACE}"
    rf"|\b(?:Calle|C/|Avenida|Avda\.?|Av\.|Paseo|Plaza|Camino|Carrera|Ronda|Travesía|Via|Viale|Corso|Piazza) ?(?:de(?: la| las| los|l)? )?{_CAPS}(?: {_CAPS})?,? (?:n[ºo°]\.? ?)?\d{{1,4}}[A-Za-z]?\b{_UNIT}?{_PLACE}"
    rf"|\b\d{{1,4}}(?: ?(?:bis|ter))?,? (?:rue|avenue|av\.|boulevard|bd|place|chemin|allée|impasse|quai|route)(?: (?:de|du|des|de la|de l'|d'))? ?{_CAPS}(?: {_CAPS})?{_UNIT}?{_PLACE}"
)

# Common given names of several languages, for corpora too small to learn from.
GIVEN_NAMES = frozenset("""
Aaron Abigail Adam Adrian Agnes Aisha Albert Alejandro Alexander Alexandra Alice Amelia Amir Ana Andrea Andreas Andrew Anna Anneke Anthony Antonio
Anton Arthur Astrid Beatrice Benjamin Bernard Birgit Brigitte Bruno Carla Carlos Carmen Caroline Catherine Charles Charlotte Chloe Christian Christine
Christopher Clara Claudia Daniel David Deborah Diego Dimitri Dorothy Edward Elena Elias Elisabeth Elizabeth Ella Emily Emma Eric Erik Esther Eva
Fatima Felix Fernando Fiona Francisco Frank Franz Friedrich Gabriel George Gerhard Giulia Grace Greta Gwendolyn Hannah Hans Heinrich Helen Helga Henry
Hugo Ian Ines Ingrid Isabel Ivan Jack Jacob James Jan Jane Javier Jean Jennifer Jessica Joachim Johann John Jorge Jose Joseph Juan Julia Julian Karen
Karl Katharina Kevin Klaus Lars Laura Leah Leo Leon Linda Lisa Louis Lucas Lucia Luis Lukas Magdalena Manuel Margaret Maria Mark Markus Marta Martin
Mary Matthew Michael Miguel Mila Mohammed Monika Nadia Natalia Nicholas Nicole Nina Noah Oliver Olivia Oscar Pablo Patricia Patrick Paul Pedro Peter
Petra Philip Pierre Rachel Raul Rebecca Richard Robert Rosa Ruth Samuel Sara Sarah Sebastian Sofia Stefan Stephen Susan Sven Teresa Thomas Tobias
Tomas Ursula Vera Victor Vincent Walter Werner William Wolfgang Yasmin Yusuf Zoe
""".split())  # fmt: skip
_GIVEN = frozenset(n.casefold() for n in GIVEN_NAMES)
# Forms of address and street words that stand before names, in lower case.
_FORMS = frozenset("mr mrs ms miss mx dr prof professor herr herrn frau señor señora señorita sr sra srta don doña mme mlle monsieur madame sir dame lady lord calle avenida paseo plaza camino carrera ronda via viale corso piazza rue avenue boulevard place".split())
#: Different surnames that make a given name, share of a surname's uses after a given name, and share of all pairs that
#: a name must have: so there are at most 1 / RATE learnt names, whatever the corpus.
SURNAMES, PAIRED, RATE = 2, 0.7, 1e-5
_TITLE = re.compile(rf"(?<![\w])(?:Mr|Mrs|Ms|Miss|Mx|Dr|Prof|Professor|Herrn?|Frau|Señora?|Señorita|Sra?|Srta|Don|Doña|Mme|Mlle|Monsieur|Madame|M|Sir|Dame|Lady|Lord)(?:\. ?| )(?:(?:Dr|Prof|med|Ing)\. ?)*({_CAPS}(?: (?:de|von|van|der|la|den) )?(?: {_CAPS})?)")
_TITLE_HINT = re.compile(r"(?<!\w)(?:M[rsx]s?|Miss|Dr|Prof\w*|Herrn?|Frau|Señor\w*|Srt?a?|Do[nñ]a?|Mme|Mlle|Monsieur|Madame|M|Sir|Dame|Lady|Lord)\b\.? ?[A-ZÄÖÜÁÉÍÓÚÑ]")
_PAIR = re.compile(r"(?<![\w@.'/-])([A-ZÄÖÜÁÉÍÓÚÑØŠČŽ][\w'’-]+)(,?) (?:[A-Z]\.? )?(?:(?:de|von|van|der|la|den|da|di|del) ){0,2}(?=([A-ZÄÖÜÁÉÍÓÚÑØŠČŽ][\w'’-]+))")
# Second words that make a name one of a thing or place.
_THINGS = frozenset("""street road avenue lane drive court square terrace boulevard way place layer cluster handbook project release version server service
library framework team group office valley lake mountain river island beach bridge park airport station hotel museum university college school hospital clinic
church stadium cup league prize award foundation institute company bank airlines motors records protocol format edition series conference summit festival plot""".split())  # fmt: skip
_NOT_SURNAME = frozenset("""the a an and or but if when while after before with without in on at for from to of is was it this that we you they he she i what who which why how
there here then human assistant user system der die das und oder aber el la los las en bei für wir ich sie er es nach ohne tras sin con por para can could please would should do does did now then also my his her their our your see call mail send write ask hier noch meine bitte send kannst monday tuesday wednesday thursday
friday saturday sunday""".split())  # fmt: skip
_CUE_BEFORE = re.compile(r"(?i)(?:\b(?:applicant|attendees?|contact(?: card| person)?|signed by|regards|sincerely|gr(?:u|ü)(?:ß|ss)e|saludos|spoke with|talked to|manager|boss|colleague|credit|reviewer|author|name(?:d|s)?|employee|patient|client|tenant|customer|ansprechpartner(?:in)?|empleado|paciente|lo pidió|das hat|it was|asked by|reported by|owner|assignee)\b[\"']?\s?[:,=]?\s{0,2}[\"']?)$")
_CUE_AFTER = re.compile(r"(?i)^(?:[\"']?\s?(?:\||,? (?:signed (?:it )?off|who noticed|wants it|lives at|so gewollt|in the text|about this)))")


def _numbers(t: str, out: list[tuple[int, int, str]]) -> None:
    for m in _RUN.finditer(t):
        if m.end() - m.start() < 6:
            continue
        word = re.match(r"[A-Z]{3} (?=\d)", m[0])  # an announcing word in capitals
        lo = m.start() + (len(word[0]) if word else 0)
        run = t[lo : m.end()].split(". ")[0].rstrip(" (-./")
        digits = sum(c.isdigit() for c in run)
        if digits < 5:
            continue
        before = t[max(0, lo - 60) : lo]
        first = _ID_BEFORE.search(before) if before else None
        if first or _ID_SHAPE.match(run):
            if first:
                out.append((lo, lo + len(run), "id_number"))
                continue
            if _ID_SHAPE.match(run) and not _NOT_PHONE.search(before):
                out.append((lo, lo + len(run), "id_number"))
                continue
        core = re.match(r"[+\d(][\d ().\-/]*\d", run)
        if not core or _NOT_PHONE.search(before):
            continue
        core = core[0]
        n = sum(c.isdigit() for c in core)
        hi = lo + len(core)
        nxt = t[hi : hi + 1]
        if nxt.isalnum() or (nxt in ":.-" and t[hi + 1 : hi + 2].isdigit()):
            continue
        plus = core[0] == "+" or core.startswith("00")
        separated = bool(re.search(r"\d[ ).\-/]+\(?\d", core))
        if (
            (plus and 9 <= n <= 15)
            or (core[0] == "0" and 9 <= n <= 12 and separated and not re.match(r"\d{1,2}[./-]\d{1,2}[./-]\d{4}", core))
            or (core.startswith("(0") and 9 <= n <= 12)
            or (10 <= n <= 11 and _NANP.match(core))
            or (9 <= n <= 12 and not re.search(r"[./]", core) and _PHONE_CUE.search(before) and (core[0] in "01" or n == 10) and (separated or re.fullmatch(r"[\d]+", core)))
        ):
            out.append((lo, hi, "phone"))


def given_names(texts: DataFrame) -> frozenset[str]:
    """Given names, lower case, learnt from a frame with a column `text`; a repeated text counts as often as it is there.

    What is shuffled is counts of capitalised words and of their pairs, summed per task; the driver gets at most 1 / RATE
    names. JVM only.
    """
    cap = r"\\p{Lu}\\p{Ll}[\\p{Ll}'’-]*"
    pair = rf"((?<=[\\p{{Ll}},;:(]) )?(?<![\\p{{L}}\\d@.'/-])({cap})(?= (?:\\p{{Lu}}\\. ?)?(?:(?:de|von|van|der|la|den|da|di|del) ){{0,2}}({cap})(?![\\p{{L}}\\d@]))"
    got = lambda p, g: F.expr(f'regexp_extract_all(text, "{p}", {g})')
    texts = texts.where("text is not null").select("text")
    pairs = texts.select(F.explode(F.arrays_zip(got(pair, 1).alias("m"), got(pair, 2).alias("a"), got(pair, 3).alias("b"))).alias("p")).select("p.*")
    pairs = cut(pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("m") == " ").alias("mid")))
    words = texts.select(F.explode(got(rf"(?<![\\p{{L}}\\d@.'/-]){cap}(?![\\p{{L}}\\d@])", 0)).alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("uses"))
    behind = pairs.groupBy("b").agg(F.sum("n").alias("after")).join(words, "b").where(F.col("after") >= PAIRED * F.col("uses")).select("b", F.lit(True).alias("surname"))
    per = pairs.join(behind, "b", "left").groupBy("a").agg(F.count_if("surname").alias("d"), F.sum(F.when(F.col("surname"), F.col("n")).otherwise(0)).alias("good"), F.sum("n").alias("n"), F.sum("mid").alias("mid"))
    all_ = pairs.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    kept = per.where((F.col("d") >= SURNAMES) & (F.col("good") >= 0.6 * F.col("n")) & (F.col("mid") >= 0.2 * F.col("n")) & (F.col("n") >= RATE * all_))
    return frozenset(r[0].casefold() for r in kept.select("a").collect()) - _FORMS - _THINGS - _NOT_SURNAME


def _names(t: str, out: list[tuple[int, int, str]], given: frozenset[str]) -> None:
    if _TITLE_HINT.search(t):
        for m in _TITLE.finditer(t):
            w, *more = m[1].split()
            hi = m.end() - len(more[-1]) - 1 if more and more[-1].casefold() in _NOT_SURNAME else m.end()
            if len(w) > 2 and w.casefold() not in _NOT_SURNAME and w.casefold() not in _THINGS:
                out.append((m.start(), hi, "person_name"))
    for m in _PAIR.finditer(t):
        a, comma, b = m[1], m[2], m[3]
        hi = m.start(3) + len(b)
        fa, fb = a.casefold(), b.casefold()
        if fb in _NOT_SURNAME or fb in _THINGS or fa in _NOT_SURNAME:
            continue
        if comma:
            if fb in given and fa not in given and len(a) > 2 and not re.match(r" [A-ZÄÖÜ][a-z]", t[hi : hi + 3]) or fb in given and _CUE_BEFORE.search(t[max(0, m.start() - 40) : m.start()]):
                out.append((m.start(), hi, "person_name"))
        elif fa in given:
            out.append((m.start(), hi, "person_name"))
        elif not comma and a[1:].islower() and b[1:].islower() and _CUE_BEFORE.search(t[max(0, m.start() - 40) : m.start()]) and _CUE_AFTER.search(t[hi : hi + 24]):
            out.append((m.start(), hi, "person_name"))


def find(text: str, given: frozenset[str] = _GIVEN) -> list[tuple[int, int, str]]:
    """(start, end, type) of what a text holds, in source characters, in order and without overlaps."""
    plain = Plain(text)
    t = plain.text
    spans: list[tuple[int, int, str]] = []
    if "@" in t:
        spans = [(m.start(), m.end(), "email") for m in _EMAIL.finditer(t)]
    _numbers(t, spans)
    if any(c in t for c in "0123456789") and _has_street(plain):
        spans += [(m.start(), m.end(), "street_address") for m in _ADDRESS.finditer(t)]
    _names(t, spans, given)
    if not spans:
        return []
    kept: list[tuple[int, int, str]] = []
    for s in sorted(spans, key=lambda s: (ORDER.index(s[2]), s[0] - s[1])):
        k = bisect_right(kept, s)  # kept spans are apart and in order, so only the neighbours can overlap
        if (not k or kept[k - 1][1] <= s[0]) and (k == len(kept) or s[1] <= kept[k][0]):
            kept.insert(k, s)
    return [(*plain.source(a, b), kind) for a, b, kind in kept]


def redact(text: str | None, given: frozenset[str] = _GIVEN) -> str | None:
    """A text with every finding replaced by the placeholder of its type."""
    if not text:
        return text
    out, last = [], 0
    for lo, hi, kind in find(text, given):
        out += [text[last:lo], PLACEHOLDER[kind]]
        last = hi
    return "".join([*out, text[last:]])


def redacted(col: Column | str, given: frozenset[str] = _GIVEN) -> Column:
    """redact() as a column."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: redact(x, given), na_action="ignore")

    return run(col)


def _texts(episodes: DataFrame, notes: DataFrame) -> DataFrame:
    """What names are learnt from; content holds the question too."""
    return episodes.select(F.col("content").cast("string").alias("text")).unionByName(notes.select(F.col("body").cast("string").alias("text")))


def redactions(episodes: DataFrame, notes: DataFrame) -> DataFrame:
    """item_table, item_id, field, text: each field with placeholders, null ones too. A redelivered row counts once."""
    given, out = _GIVEN | given_names(_texts(episodes, notes)), None
    for table, df, fields in (("episodes", episodes, ("human_turn", "content")), ("notes", notes, ("body",))):
        each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("text")) for f in fields))).alias("x")
        rows = df.select("id", *fields).distinct().select(F.lit(table).alias("item_table"), F.col("id").cast("long").alias("item_id"), each)
        out = rows if out is None else out.unionByName(rows)
    return out.select("item_table", "item_id", "x.field", redacted("x.text", given).alias("text"))


def findings(episodes: DataFrame, notes: DataFrame) -> DataFrame:
    """item_table, item_id, field, pii_type: what each field holds at least once.

    A scan with no shuffle but that of the findings, after one for the given names. Where content begins with the question, as it is written, both
    are read in one go. Rows without an id are left out.
    """
    schema = "item_table string, item_id long, field string, pii_type string"
    given = _GIVEN | given_names(_texts(episodes, notes))

    def in_episodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list[tuple] = []
            for i, q, c in zip(pdf["id"], pdf["human_turn"], pdf["content"]):
                at = len("Human: ")
                spans = find(c, given) if c else []
                if q and c and c.startswith(q, at) and c.startswith("\n\nAssistant:", at + len(q)):
                    inner = {k for a, b, k in spans if a >= at and b <= at + len(q)}
                else:
                    inner = {k for _, _, k in find(q, given)} if q else set()
                rows += [("episodes", i, "content", k) for k in {k for _, _, k in spans}]
                rows += [("episodes", i, "human_turn", k) for k in inner]
            yield pd.DataFrame(rows, columns=["item_table", "item_id", "field", "pii_type"])

    def in_notes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [("notes", i, "body", k) for i, x in zip(pdf["id"], pdf["body"]) if x for k in {k for _, _, k in find(x, given)}]
            yield pd.DataFrame(rows, columns=["item_table", "item_id", "field", "pii_type"])

    return (
        episodes.where("id is not null").select("id", "human_turn", "content").mapInPandas(in_episodes, schema)
        .unionByName(notes.where("id is not null").select("id", "body").mapInPandas(in_notes, schema)).distinct()
    )
