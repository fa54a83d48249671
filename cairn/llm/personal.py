"""Personal information inside free text (problem 2).

Patterns propose spans, checksums confirm the ones that have them, and words nearby raise or lower the score; spans that
reach the threshold are findings. Names are proposed from the words of an address book, in any of the usual forms.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.bits import bit_set, held
from cairn.operators.skew import salted_lookup

KINDS = ("email", "phone", "id_number", "address", "person")
THRESHOLD = 1.0
#: Contacts of an address book that is sent to all tasks; a larger one is joined with the words of texts.
MOST_NAMES = 200_000

_EMAIL = re.compile(
    r"(?<![\w.+@-])[\w.+-]*\w\s?(?:@|\(at\)|\[at\]|\{at\})\s?[\w-]+(?:(?:\.|\s?(?:\[dot\]|\(dot\)|\{dot\})\s?)[\w-]+)+(?![\w@])", re.I
)
#: Shapes of numbers: kind, score by itself, pattern. Groups of digits are those of the countries' usual ways of writing.
_SHAPES = [
    ("phone", 1.0, r"\+\d{1,3}[ .-]?\(?\d{1,5}\)?(?:[ .-]?\d{1,5}){1,6}"),
    ("phone", 0.9, r"00\d{2}[ .-]\d{1,4}(?:[ .-]?\d{2,9}){1,4}"),
    ("phone", 0.8, r"\(\d{2,5}\) ?\d{2,6}(?:[ -]\d{2,6}){1,3}"),
    ("phone", 0.7, r"\d{3}([.-])\d{3}\1\d{4}|0\d{2} \d{4} \d{4}|0\d{4} \d{6}|0\d{2,4}/\d{5,9}|0\d(?:([. -])\d{2})(?:\2\d{2}){3}|[89]\d{2}[ -]\d{3}[ -]\d{3}(?![ -]?\d)|[089] \(?\d{3}\)? \d{3}[ -]\d{2}[ -]\d{2}"),
    ("id_number", 0.9, r"[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|[XYZ]-?\d{7,9}-?[A-Z]|\d{2}\.\d{3}\.\d{3}-[A-Z]|\d{8}[A-Z]|[A-Z]{1,2}\d[A-Z]\d{2}[A-Z]\d{4}[A-Z]?|[A-Z]{1,2}\d[A-Z] \d{2}[A-Z] \d{4}(?: [A-Z])?|\d{2} \d{6} [A-Z] \d{3}|[A-Z]{2}\d{2}(?: ?[\dA-Z]{4}){3,7}(?: ?[\dA-Z]{1,4})?"),
    ("id_number", 0.8, r"\d{3}-\d{3}-\d{3} \d{2}|№ ?\d{4} ?\d{6}|\d{4} № ?\d{6}|[0-478] \d{2} \d{2} \d{2} \d{3} \d{3} \d{2}|[A-Z]\d{8,9}|[A-Z]{2} ?\d{6,7}"),
    ("id_number", 0.7, r"\d{3}([ -])\d{2}\1\d{4}|\d{2} \d{2} \d{6}|\d{4} \d{6}|\d{4} ?\d{4} ?\d{4} ?\d{4}"),
    ("id_number", 0.5, r"\d{8,12}"),
]
_TRIGGER = re.compile(r"(?<![\w@/#.+№-])(?:№ ?\d{4}|\+\d|\(\d{2,5}\)|[A-Z]{1,2}-?\d|[A-Z]{2} \d{2} |\d)(?=(?:[^\w\n]{0,2}[\dA-Z]){5})")
_EACH = [(kind, score, re.compile(rf"(?:{p})(?![\w@]|[.,-]\d)")) for kind, score, p in _SHAPES]

#: Words near a number that speak for and against it, in the languages of the texts.
_FOR = {
    "phone": re.compile(r"call|phone|text me|tel\b|mobile|number changed|on-call|rufnummer|telefon|anruf|störung|handy|appel|numéro d|téléphone|astreinte|llamar|teléfono|ligar|telefone|звон|телефон|номеру|дежурн|чергов|подзвон", re.I),
    "id_number": re.compile(r"identity|passport|document|registered under|social|insurance|ausweis|nummer|versicherung|pièce|identité|numéro|documento|número|dni|nif|паспорт|документ|номер|снилс|инн|анкет", re.I),
}
_AGAINST = re.compile(r"(?:order|ticket|build|commit|version|versión|versão|invoice|bestellung|auftrag|stand|pedido|commande|encomenda|заказ|замовлення|сборка|збірка|тикет|коммит|коміт|заявк\w+ №|release|pull request|issue|error|row|record)s?\W{0,3}(?:no\.?|nr\.?|n\.?º|#|№)?\W{0,2}$", re.I)

_CAP = r"[A-ZÀ-ÖØ-ÞА-ЯЁЇІЄҐ][\w'’-]*"
_TOWN = rf"(?:, (?:\d{{4}}-\d{{3}}|\d{{5,6}}|[A-Z]{{1,2}}\d\w? ?\d[A-Z]{{2}})(?: {_CAP}(?:[ -]{_CAP})?)?)?"
_DOOR = r"(?:, (?:Flat|Apt\.?|Apartment|Suite|Unit|Room) \d+[A-Za-z]?)?"
_NO = r"\d{1,4}[a-zа-яіїє]?(?!\w)"
#: Street addresses by the parts they are made of: street words, house number, flat, post code and town.
_ADDRESS = (
    rf"(?:(?:Flat|Apt\.?|Apartment|Unit|Suite) \d+[A-Za-z]?, )?\d{{1,4}}[A-Za-z]? (?:{_CAP} ){{1,3}}(?:Street|Road|Lane|Avenue|Drive|Court|Close|Way|Square|Place|Terrace|Boulevard|Crescent|Row|Gardens|Grove|Mews|Hill|St|Rd|Ave|Blvd|Dr)\b{_DOOR}(?:, {_CAP}(?! ?:))?(?:,? [A-Z]{{2}} \d{{5}})?{_TOWN}",
    rf"(?:{_CAP}(?:straße|strasse|str\.|weg|gasse|platz|allee|ring|ufer|damm|steig|pfad)|(?:(?:Am|An der|An den|Im|In der|Alter|Alte|Altes|Neuer|Neue|Zum|Zur|Auf der|Auf dem|Unter den|Hinter der|Hinter dem|Vor dem|Kleiner|Großer|Oberer|Unterer|Langer|Hoher) {_CAP}(?: {_CAP})?)|{_CAP} (?:Straße|Weg|Gasse|Platz|Allee|Ring|Ufer|Damm)) \d{{1,4}}(?:[a-z]|(?: [a-z](?=[,.])))?(?!\w)(?:, \d{{5}} {_CAP}(?:[ -]{_CAP})?)?",
    rf"\d{{1,4}}(?: (?:bis|ter|quater))?,? (?:rue|avenue|av\.|boulevard|bd\.?|impasse|place|allée|chemin|quai|cours|route|passage|square|sentier|ruelle) (?:(?:de la|de l['’]|des|du|de|d['’]|la|le|les|l['’]) ?)?{_CAP}(?: (?:de la |des |du |de |d['’])?{_CAP})*(?:, (?:bât\.?|bâtiment|appt\.?|apt\.?|étage|esc\.?) ?\w+)*{_TOWN}",
    rf"(?:Calle|C/|Avda\.|Avenida|Plaza|Pza\.|Paseo|Camino|Ronda|Travesía|Rua|R\.|Av\.|Travessa|Tv\.|Praça|Largo|Estrada|Alameda|Beco|Calçada) ?(?:(?:de las|de los|de la|del|de|das|dos|do|da) )?{_CAP}(?: (?:(?:de las|de los|de la|del|de|das|dos|do|da) )?{_CAP})*,? (?:n\.?º ?)?\d{{1,4}}(?: ?[a-z](?!\w))?(?:, \d{{1,3}}\.?[ºª]\.?(?: (?:Esq|Dto|Dir|Fte|izq|dcha|dch|ctro|pta)\.?| [A-Z](?!\w))?| ?, (?:piso|puerta|bloque|andar|lote) \w+)*{_TOWN}",
    rf"(?:ул\.|улица|пер\.|переулок|пр-т|просп\.|проспект|бульвар|б-р|бульв\.|наб\.|набережная|ш\.|шоссе|пл\.|площадь|площа|проезд|туп\.|вул\.|вулиця|пров\.|провулок|узвіз|майдан) ?{_CAP}(?: {_CAP})*, (?:(?:д|дом|буд|б)\.? ?)?{_NO}(?:, (?:кв|корп|стр|оф|под|эт|прим|пов|під)\.? ?\d+[а-я]?)*(?:, \d{{5,6}}(?:,? (?:г\.|м\.)? ?{_CAP})?)?",
    rf"{_CAP} (?:ул\.|улица|пер\.|переулок|пр-т|просп\.|проспект|бульвар|б-р|наб\.|шоссе|площадь|проезд|вул\.|вулиця|пров\.|провулок), (?:(?:д|дом|буд|б)\.? ?)?{_NO}(?:, (?:кв|корп|стр|оф|под|эт|прим|пов|під)\.? ?\d+[а-я]?)*(?:, \d{{5,6}}(?:,? (?:г\.|м\.)? ?{_CAP})?)?",
)
#: Words of which a lower-cased text must hold one before the address pattern of the same place is tried.
_STREET = (
    ("street", "road", "lane", "avenue", "drive", "court", "close", "square", "place", "terrace", "boulevard", "crescent", " row", "gardens", "grove", "mews", " hill", " st", " rd", " ave", "blvd", " dr"),
    ("straße", "strasse", "str.", "weg ", "gasse", "platz", "allee", "ring ", "ufer ", "damm ", "steig ", "pfad ", "am ", "an der ", "an den ", "im ", "in der ", "alter ", "alte ", "altes ", "neuer ", "neue ", "zum ", "zur ", "auf de", "unter den ", "hinter de", "vor dem ", "kleiner ", "großer ", "oberer ", "unterer ", "langer ", "hoher "),
    (" rue ", " avenue", " av.", "boulevard", " bd", "impasse", " place ", "allée", "chemin", " quai ", " cours ", " route ", "passage", " square ", "sentier", "ruelle"),
    ("calle ", "c/", "avda.", "avenida", "plaza ", "pza.", "paseo", "camino", "ronda ", "travesía", "rua ", "r.", "av.", "travessa", "tv.", "praça", "largo ", "estrada", "alameda", "beco ", "calçada"),
    ("ул.", "улица", "пер.", "переулок", "пр-т", "просп", "бульвар", "б-р", "бульв.", "наб.", "набережн", "ш.", "шоссе", "пл.", "площадь", "площа", "проезд", "туп.", "вул.", "вулиц", "пров.", "провулок", "узвіз", "майдан"),
    (" ул.", " улица", " пер.", " переулок", " пр-т", " просп", " бульвар", " б-р", " наб.", " шоссе", " площадь", " проезд", " вул.", " вулиц", " пров.", " провулок"),
)
#: A house number, which every address has; and the least that a phone or identity number has.
_HOUSE = re.compile(r"(?<![\d.,])\d{1,4}(?![\d.])")
_DIGITS = re.compile(r"\d[\d .()/-]{5,}\d|[A-Z]{1,2}[ -]?\d[\dA-Z -]{5,}")
_ADDRESSES = [re.compile(rf"(?<![\w-])(?:{p})(?!\w)") for p in _ADDRESS]
_FOLDED = [re.compile(rf"(?<![\w-])(?:{p.replace(_CAP, r"[^\W\d_][\w'’-]*")})(?!\w)", re.I) for p in _ADDRESS]
_PUNCTUATION = re.compile(r"[,.;:!?()\"«»*_\[\]]")
#: Words before a name or an address that speak against it (parts of documents, as in "Appendix A. Martin", "see section 12 Hill Road"), and words for an address.
_AGAINST_NAME = re.compile(r"(?:appendix|annex|section|chapter|figure|table|exhibit|anhang|abschnitt|kapitel|tabelle|annexe|chapitre|tableau|anexo|sección|capítulo|secção|приложение|раздел|глава|таблица|додаток|розділ|таблиця)\s$", re.I)
_AGAINST_PLACE = re.compile(r"(?:release|version|build|branch|ticket|commit|folder|file|path|ordner|datei|dossier|fichier|carpeta|archivo|pasta|ficheiro|версия|сборка|папка|файл|версія|збірка|тека)\W{1,2}$", re.I)
_FOR_PLACE = re.compile(r"address|live[sd]? at|moved to|deliver|parcel|office|visit|adresse|wohn|liefer|paket|habite|livr|colis|dirección|vive en|entreg|paquete|morada|vive na|encomenda|адрес|живёт|живет|достав|посыл|живе|посил", re.I)
_INITIAL = r"[A-ZÀ-ÖØ-ÞА-ЯЁЇІЄҐ]\."


def luhn(digits: str) -> bool:
    """Whether the last digit checks the others, doubling every second from the right."""
    total = sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits)))
    return len(digits) > 1 and total % 10 == 0


def iban(text: str) -> bool:
    """ISO 7064 mod 97-10 over the text with its first four signs moved to the end, letters as 10 to 35."""
    t = re.sub(r"\W", "", text).upper()
    return len(t) > 14 and t[:2].isalpha() and int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1


def nir(digits: str) -> bool:
    """A 15-digit number whose last two digits are 97 less the others modulo 97."""
    return len(digits) == 15 and (97 - int(digits[:13]) % 97) == int(digits[13:])


def snils(digits: str) -> bool:
    """An 11-digit number checked by the sum of its first nine digits by their places."""
    return len(digits) == 11 and sum(int(c) * (9 - i) for i, c in enumerate(digits[:9])) % 101 % 100 == int(digits[9:])


def nif(text: str) -> bool:
    """Eight digits and the letter that their remainder by 23 picks."""
    t = re.sub(r"\W", "", text).upper()
    if t[:1] in "XYZ" and t[:1]:
        t = str("XYZ".index(t[0])) + t[1:]
    return len(t) == 9 and t[:8].isdigit() and "TRWAGMYFPDXBNJZSQVHLCKE"[int(t[:8]) % 23] == t[8]


#: Forms that claim a checksum: Luhn (cards), mod 97 (bank accounts, French numbers), Russian and Spanish check digits.
_CLAIMS = (
    (re.compile(r"\d{4} ?\d{4} ?\d{4} ?\d{4}|\d{15}"), lambda t: luhn(re.sub(r"\D", "", t))),
    (re.compile(r"[A-Z]{2}\d{2}(?: ?[\dA-Z]{4}){3,7}(?: ?[\dA-Z]{1,4})?"), lambda t: iban(t)),
    (re.compile(r"[0-478] \d{2} \d{2} \d{2} \d{3} \d{3} \d{2}|[12]\d{14}"), lambda t: nir(re.sub(r"\D", "", t))),
    (re.compile(r"\d{3}-\d{3}-\d{3} \d{2}|\d{11}"), lambda t: snils(re.sub(r"\D", "", t))),
    (re.compile(r"(?:[XYZ]-?\d{7}|\d{8}|\d{2}\.\d{3}\.\d{3})-?[A-Z]"), lambda t: nif(t)),
)
#: What a checksum that holds adds to a score, and one that fails takes off. Bare digits (no letters or marks) lose nothing: they claim no scheme.
HOLDS, FAILS = 0.6, -0.15


def checked(surface: str) -> float:
    """HOLDS if a checksum that the surface's form claims holds, FAILS if all that it claims fail, 0 if it claims none."""
    claimed = [check(surface) for form, check in _CLAIMS if form.fullmatch(surface)]
    return HOLDS if any(claimed) else FAILS if claimed and not surface.isdigit() else 0.0


@dataclass(frozen=True)
class Names:
    """First and last names of an address book, lower-cased."""

    first: frozenset[str]
    last: frozenset[str]

    @classmethod
    def of(cls, full: list[str | None]) -> Names:
        parts = [n.split() for n in full if n and len(n.split()) > 1]
        return cls(frozenset(p[0].lower() for p in parts), frozenset(p[-1].lower() for p in parts))


@lru_cache(maxsize=20_000)
def _person_pattern(first: tuple[str, ...], last: tuple[str, ...]) -> re.Pattern:
    f, n = "|".join(map(re.escape, first)) or r"(?!)", "|".join(map(re.escape, last))
    return re.compile(rf"(?<![\w-])(?:(?:(?i:{f})|{_INITIAL}|\b[a-zа-яёїієґ]\.)(?: ?{_INITIAL}| [a-zа-яёїієґ]\.)? ?(?i:{n})|(?i:{n}), ?(?:(?i:{f})(?: {_INITIAL})?|{_INITIAL}(?: ?{_INITIAL})?)|(?i:{n}) (?:(?i:{f})|{_INITIAL} ?{_INITIAL}))(?![\w])")


def people(text: str, names: Names) -> Iterator[tuple[int, int, float]]:
    """Spans of full names or initials with a last name of the book; a first name of the book confirms them."""
    low = set(_PUNCTUATION.sub(" ", text.lower()).split()) if any(c in text for c in ":;!?()\"«»*_") else set(text.lower().replace(",", " ").replace(".", " ").split())
    last = low & names.last
    if not last:
        return
    first = low & names.first
    for m in _person_pattern(tuple(sorted(first, key=len, reverse=True)), tuple(sorted(last, key=len, reverse=True))).finditer(text):
        # A first name of the book confirms an initial's place; words nearby speak against the rest.
        score = 1.4 if any(w.strip(".,").lower() in first for w in m[0].split()) else 1.1
        yield m.start(), m.end(), score - (0.3 if _AGAINST_NAME.search(text[max(0, m.start() - 24) : m.start()]) else 0)


def places(text: str, pattern: re.Pattern) -> Iterator[tuple[int, int, float]]:
    """Spans of addresses: longer ones first, as words nearby speak for and against them."""
    for m in pattern.finditer(text):
        near = text[max(0, m.start() - 32) : m.start()]
        score = 1.5 + (m.end() - m.start()) / 1000 + (0.2 if _FOR_PLACE.search(near) else 0) - (0.6 if _AGAINST_PLACE.search(near) else 0)
        yield m.start(), m.end(), score


def numbers(text: str) -> Iterator[tuple[int, int, str, float]]:
    for t in _TRIGGER.finditer(text):
        at, best = t.start(), None
        near = text[max(0, at - 48) : at]
        against = _AGAINST.search(near)
        for kind, score, shape in _EACH:
            m = shape.match(text, at)
            if not m:
                continue
            surface = m[0]
            if len(re.sub(r"\W", "", surface)) < 7:
                continue
            if against:
                score -= 1
            if _FOR[kind].search(near) or _FOR[kind].search(text[m.end() : m.end() + 24]):
                score += 0.5
            if kind == "id_number":
                score += checked(surface)
            if best is None or (score, m.end()) > (best[3], best[1]):
                best = (at, m.end(), kind, score)
        if best:
            yield best


def findings(text: str | None, names: Names) -> list[tuple[int, int, str]]:
    """(start, end, kind) of a text's personal information, in order, without overlaps; [] for null and empty texts."""
    if not text:
        return []
    spans: list[tuple[float, int, int, str]] = []
    if "@" in text or "at)" in text or "at]" in text or "at}" in text or "AT]" in text or "AT)" in text:
        spans += [(2.0, m.start(), m.end(), "email") for m in _EMAIL.finditer(text)]
    if _DIGITS.search(text):
        spans += [(s, a, b, k) for a, b, k, s in numbers(text) if s >= THRESHOLD]
    if _HOUSE.search(text):
        low = text.lower()
        flat = text in (low, text.upper())
        for i, words in enumerate(_STREET):
            if any(w in low for w in words):
                spans += [(s, a, b, "address") for a, b, s in places(text, (_FOLDED if flat else _ADDRESSES)[i]) if s >= THRESHOLD]
    spans += [(s, a, b, "person") for a, b, s in people(text, names) if s >= THRESHOLD]
    out: list[tuple[int, int, str]] = []
    for _, a, b, kind in sorted(spans, key=lambda x: (-x[0], x[1], -x[2])):
        if all(b <= x or a >= y for x, y, _ in out):
            out.append((a, b, kind))
    return sorted(out)


def masked(text: str | None, names: Names) -> str | None:
    """The text with each finding replaced by a placeholder of its kind; null for null."""
    if not text:
        return text
    out, at = [], 0
    for a, b, kind in findings(text, names):
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def _found(rows: list[tuple], names) -> pa.RecordBatch:
    src, row, kind, surface = [], [], [], []
    for (s, i, text), own in zip(rows, names):
        for k, v in dict.fromkeys((k, text[a:b]) for a, b, k in findings(text, own)):
            src.append(s), row.append(i), kind.append(k), surface.append(v)
    return pa.RecordBatch.from_arrays([pa.array(src, pa.string()), pa.array(row, pa.int64()), pa.array(kind, pa.string()), pa.array(surface, pa.string())], ["src", "row_id", "kind", "surface"])


def _masked(rows: list[tuple], names) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([masked(r[2], own) for r, own in zip(rows, names)], pa.string())], ["src", "row_id", "text"]
    )


def _with_book(work, names: Names):
    """work on rows (src, row_id, text), with one address book for all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield work(list(zip(*(batch.column(k).to_pylist() for k in range(3)))), repeat(names))

    return run


def _with_own(work):
    """work on rows (src, row_id, text, first, last), with each row's own names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(5)]
            yield work(list(zip(*columns[:3])), [Names(frozenset(f or ()), frozenset(n or ())) for f, n in zip(*columns[3:])])

    return run


def _candidates(bits: np.ndarray):
    """Rows (src, row_id, text, words): the words of each text that may be names of the book, in small letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [sorted(set(_PUNCTUATION.sub(" ", t.lower()).split())) if t else [] for t in batch.column(2).to_pylist()]
            flat = [w for x in words for w in x]
            may = iter(held(bits, pd.util.hash_array(np.array(flat, dtype=object)).view(np.int64)).tolist() if flat else ())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array([[w for w in x if next(may)] for x in words], pa.list_(pa.string()))], ["src", "row_id", "text", "words"])

    return run


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = batch.column(0).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array(pd.util.hash_array(np.array(words, dtype=object)).view(np.int64) if words else [], pa.int64())], ["h"])


def joined_names(texts: DataFrame, contacts: DataFrame) -> DataFrame:
    """src, row_id, text, first, last: every text with the first and last names of the book among its words, for books of any size.

    Only texts with a word that may be a name (by a set of bits of a fixed size) are joined; words that many texts hold are split by salts.
    """
    part = F.split(F.trim(F.lower(F.regexp_replace("full_name", r"\s+", " "))), " ")
    book = contacts.where(F.col("full_name").isNotNull()).select(part.alias("p")).where(F.size("p") > 1)
    book = book.select(F.explode(F.array(F.struct(F.col("p")[0].alias("w"), F.lit(True).alias("f")), F.struct(F.element_at("p", -1).alias("w"), F.lit(False).alias("f")))).alias("x"))
    book = book.groupBy(F.col("x.w").alias("w")).agg(F.max("x.f").alias("is_first"), (~F.min("x.f")).alias("is_last"))
    rows = texts.mapInArrow(_candidates(bit_set(book.select("w").mapInArrow(_hashed, "h bigint"))), "src string, row_id bigint, text string, words array<string>")
    some = rows.where(F.size("words") > 0).withColumn("k", F.xxhash64("src", "row_id", "text"))
    met = salted_lookup(some.select("k", F.explode("words").alias("w")).distinct(), book, "w", F.col("k"), how="inner")
    own = met.groupBy("k").agg(F.collect_set(F.when(F.col("is_first"), F.col("w"))).alias("first"), F.collect_set(F.when(F.col("is_last"), F.col("w"))).alias("last"))
    none = F.lit(None).cast("array<string>")
    named = some.join(own, "k", "left").select("src", "row_id", "text", "first", "last")
    return named.unionByName(rows.where(F.size("words") == 0).select("src", "row_id", "text", none.alias("first"), none.alias("last")))


def _each_text(texts: DataFrame, contacts: DataFrame, work, schema: str, most: int) -> DataFrame:
    names = contacts.select("full_name").where(F.col("full_name").isNotNull())
    some = names.limit(most + 1).collect()
    if len(some) > most:
        return joined_names(texts, contacts).mapInArrow(_with_own(work), schema)
    return texts.mapInArrow(_with_book(work, Names.of([r["full_name"] for r in some])), schema)


def find_personal(texts: DataFrame, contacts: DataFrame, most_names: int = MOST_NAMES) -> DataFrame:
    """src, row_id, kind, surface: each distinct finding of a text once. texts: src, row_id, text; contacts: full_name.

    Each text is looked at by itself, whole, without a shuffle while the address book has at most `most_names` contacts and is sent to
    the tasks; a larger one is joined, with the same result. Null and empty texts have no findings, repeated rows count each;
    without contacts no persons are found. Extra columns do not matter.
    """
    rows = texts.select("src", F.col("row_id").cast("bigint").alias("row_id"), "text").where(F.col("text").isNotNull())
    return _each_text(rows, contacts, _found, "src string, row_id bigint, kind string, surface string", most_names)


def mask_personal(texts: DataFrame, contacts: DataFrame, most_names: int = MOST_NAMES) -> DataFrame:
    """src, row_id, text: every text with placeholders of their kind in the place of findings; null texts stay null."""
    rows = texts.select("src", F.col("row_id").cast("bigint").alias("row_id"), "text")
    return _each_text(rows, contacts, _masked, "src string, row_id bigint, text string", most_names)


def personal_texts(memories: DataFrame, goals: DataFrame) -> DataFrame:
    return memories.select(F.lit("memories").alias("src"), F.col("seq").alias("row_id"), F.col("value.content").alias("text")).unionByName(
        goals.select(F.lit("goals").alias("src"), F.col("seq").alias("row_id"), F.col("description").alias("text"))
    )
