"""Personal information inside free text: where it is (first half of problem 8).

Addresses of every kind are found by component grammars of six languages; identity numbers by their label and shape;
phone numbers by national shapes, unless a code label stands before them; names by a lexicon that grows from a short
list with counts over all documents: a word that mostly stands next to known name parts is one. Occurrences in lower
case count too, so that an ordinary word of a text in capitals is none. Listed words are judged by the same counts; one
that is mostly something else, as a place, is a name only beside another name part or in a context (the words before and
after) in which sure names stand and other capitalised words do not.

Everything works on characters of the text as given; full-width letters and digits are read as plain ones (one
character each, so positions stay). The texts are processed whole, batch by batch; spans of fixed shape are searched
once and written beside the text; only counts of word pairs and contexts are shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import log

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellspindle.session import materialize, spread

KINDS = ("email", "phone", "id", "address", "name")
FULL_WIDTH = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)} | {0x3000: 0x20}

# Shapes of e-mail addresses, also spelled out.
_PART = r"[\p{Latin}\p{Cyrillic}0-9_+%'’-]+"
_AT = r"(?: ?@ ?| ?[\(\[](?:at|AT|arroba)[\)\]] ?| AT )"
_DOT = r"(?:\.| ?[\(\[](?:dot|DOT|punto)[\)\]] ?| DOT )"
EMAIL = rf"(?<![\p{{Latin}}\p{{Cyrillic}}0-9_.+%-]){_PART}(?:\.{_PART})*(?:{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*{_DOT}[A-Za-z]{{2,}}| at [A-Za-z0-9-]+(?: dot [A-Za-z0-9-]+)* dot [A-Za-z]{{2,}})(?![A-Za-z0-9])"

# Labels of identity numbers and the shapes that follow them.
ID_LABELS = (
    r"SSN|[Ss]ocial [Ss]ecurity [Nn]umber|[Ss]ocial [Ss]ecurity|NI number|NINO|[Nn]ational [Ii]nsurance number|[Nn]ational ID|[Ii]dentity card|[Pp]assport|[Tt]ax ID|ITIN|ID card"
    r"|Steuer-ID|Steuer-Identifikationsnummer|Steuernummer|SV-Nummer|Sozialversicherungsnummer|Ausweisnummer|Personalausweis(?:nummer)?|Reisepass(?:-Nr\.|nummer)?"
    r"|DNI|NIE|NIF|[Pp]asaporte|[Nn]úmero de la Seguridad Social"
    r"|NIR|[Nn]° de sécurité sociale|[Nn]uméro de sécurité sociale|[Cc]arte d['’]identité|CNI|[Pp]asseport"
    r"|[Пп]аспорт|СНИЛС|ИНН|身份证(?:号码|号)?|护照(?:号码|号)?|社会保障号|社保号"
)
ID_SHAPES = (
    r"\d{3}[- ]?\d{2}[- ]?\d{4}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|\d{17}[\dXx]|[A-Z]{1,3}\d{6,9}|[A-Z]\d{3}[A-Z]{2}\d{3}|[A-Z]{2}\d{3}[A-Z]\d{3}|\d{2}[A-Z]{2}\d{5}"
    r"|\d{2} \d{2} \d{6}|\d{4} \d{6}|\d{2} ?\d{3} ?\d{3} ?\d{3}|\d{8}[A-Z]\d{3}|\d{2}\.?\d{3}\.?\d{3}-?[A-Z]|[XYZ]-?\d{7}-?[A-Z]"
    r"|[12] ?\d{2} ?\d{2} ?\d{2} ?\d{3} ?\d{3} ?\d{2}|\d{3}-\d{3}-\d{3}[- ]\d{2}|\d{9,15}"
)
ID = rf"(?:(?<![\p{{Latin}}\p{{Cyrillic}}])(?:{ID_LABELS})(?:\s?(?:no\.?|n°|№|Nr\.|nº|núm\.|number|号码))?\s?[:：=]?\s*\K(?:{ID_SHAPES}))(?![\p{{Latin}}\p{{Cyrillic}}\d])"

# Labels of codes that look like numbers of people, and national phone shapes.
CODE_BEFORE = regex.compile(r"(?i)(?:lot|batch|order|ISBN|doi:?|chr\w*:?) $")
PHONES = (
    r"\+\d{1,3}[ .-]?\(\d{1,4}\)[ .-]?\d{1,5}(?:[ .-]?\d{2,5}){1,4}|\+\d{1,3}(?:[ .-]\d{1,5}){2,6}|\+\d{9,14}|\(\+\d{1,3}\) ?\d{1,4}(?:[ .-]?\d{2,4}){1,4}|00[1-9]\d{9,13}"
    r"|0[1-9]\d{3} \d{6}|0[12]\d \d{4} \d{4}|1[-. ]\d{3}[-. ]\d{3}[-. ]\d{4}|\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4}|\(\d{3}\) ?\d{3}-\d{4}|\(0\d{2,3}\) ?\d{4} \d{4}"
    r"|0[1-9]\d{1,3}/\d{6,8}|0[1-9]\d{1,3}/\d{3,5}-\d{2,4}|0[1-9]\d{2} \d{7}|\(0[1-9]\d{1,3}\) ?\d{3,8}(?:-\d{2,4})?"
    r"|0[1-9]([ .-]?)\d{2}(?:\g{-1}\d{2}){3}|[6789]\d{2}([ .-])\d{3}\g{-1}\d{3}|[6789]\d{2}([ .-])\d{2}\g{-1}\d{2}\g{-1}\d{2}"
    r"|8[ -]?\(\d{3}\)[ -]?\d{3}[ -]\d{2}[ -]\d{2}|8[ -]\d{3}[ -]\d{3}[ -]\d{2}[ -]\d{2}|8\d{10}|0\d{2,3}-\d{7,8}|1\d{10}|[6789]\d{8}"
).replace(r"\g{-1}", "§")


def _numbered(pattern: str) -> str:
    """Name each separator group, so that the pattern can stand inside others."""
    out, n = [], 0
    for piece in regex.split(r"(\(\[ \.-\]\??\))", pattern):
        if piece.startswith("([ .-]"):
            n += 1
            out.append(f"(?P<s{n}>{piece[1:-1]})")
        else:
            out.append(piece.replace("§", f"(?P=s{n})"))
    return "".join(out)


PHONE = rf"(?<![\p{{Latin}}\p{{Cyrillic}}\d_+/.@#-]|\d:|\d[ .-])(?:{_numbered(PHONES)})(?![\p{{Latin}}\p{{Cyrillic}}\d_/@]|[-.:]\d)"

# Components of street addresses.
_SEP = r"(?:, ?|,?\s?\n)"
_CAP = r"\p{Lu}[\p{Ll}'’]+"
_TOWN = rf"{_CAP}(?:[ -]{_CAP}){{0,2}}"
_EN_TYPE = r"(?:Street|Str|St\.?|Road|Rd\.?|Avenue|Ave\.?|Lane|Ln\.?|Close|Terrace|Quay|Drive|Dr\.?|Court|Ct\.?|Way|Place|Square|Crescent|Row|Gardens|Boulevard|Blvd\.?|Walk|Mews)"
ADDRESSES = (
    rf"(?:(?:Flat|Apt|Apartment|Unit|Suite)\.? \d+[A-Z]?{_SEP})?\d+[A-Z]? (?:(?:\p{{Lu}}\.|{_CAP}) ){{1,4}}{_EN_TYPE}(?![\p{{L}}])(?:{_SEP}(?:Flat|Apt|Apartment|Unit|Suite)\.? \d+[A-Z]?)?"
    rf"(?:{_SEP}{_TOWN}(?: [A-Z]{{1,2}}\d{{1,2}} \d[A-Z]{{2}})?(?:{_SEP}[A-Z]{{2}} \d{{5}}(?!\d))?)?",
    rf"(?<![\p{{L}}])(?:(?:Am|Alte|Alter|An der|Im|In der|Auf der|Zum|Zur|Neue|Große|Kleine) )?\p{{Lu}}[\p{{L}}-]*(?:straße|strasse|str\.|weg|gasse|platz|allee|hang|ufer|damm|ring|steig|graben)"
    rf" \d+(?: ?[a-z](?![\p{{L}}]))?(?:{_SEP}\d{{5}} {_TOWN})?",
    rf"\d+(?: (?:bis|ter|quater))?,? (?:rue|impasse|quai|avenue|av\.|boulevard|bd\.?|chemin|allée|place|route|cours|square)(?: (?:de la|de l['’]|des|du|de|d['’]))?[ ]?{_CAP}(?:[ -]{_CAP}){{0,3}}(?:{_SEP}\d{{5}} {_TOWN})?",
    rf"(?<![\p{{L}}])(?:Calle|C/|Avda\.|Avenida|Av\.|Paseo|Plaza|Pza\.|Camino|Ronda|Travesía)(?: (?:de las|de los|de la|del|de))? {_CAP}(?: {_CAP}){{0,2}}(?:{_SEP}| )(?:n[º°]\.? ?)?\d+"
    rf"(?:{_SEP}(?:bajo|ático|\d+\.?[ºª°] ?[A-Z]?))?(?:{_SEP}\d{{5}} {_TOWN})?",
    rf"(?<![\p{{L}}])(?:ул\.|улица|пер\.|переулок|пр\.|пр-т|проспект|наб\.|набережная|пл\.|площадь|бульвар|б-р|ш\.|шоссе) {_CAP}(?: \p{{L}}[\p{{Ll}}]+)?{_SEP}(?:д\.|дом) ?\d+\p{{Ll}}?"
    rf"(?:{_SEP}(?:кв\.|квартира|оф\.) ?\d+)?(?:{_SEP}(?:\d{{6}} {_TOWN}|г\. ?{_TOWN}))?",
    r"(?:(?<=[到在寄给往：:，,、\s]|^)\p{Han}{2,3}|\p{Han}{2})[市县区](?:\p{Han}{2,3}区)?\p{Han}{2,4}?[路街巷道]\d+号(?:\d+(?:号楼|栋))?(?:\d+单元)?(?:\d+室)?",
)

# Words before names that are no part of them, and particles inside them.
TITLES = frozenset("frau herr herrn mme mlle madame monsieur m mr mrs ms miss dr prof sir sr sra srta señor señora don doña г-н г-жа господин госпожа".split())
PARTICLES = r"(?:van der|van den|van de|van|von der|von|de la|de los|de las|del|de|di|da|du|le|la|bin|ibn|ben)"

WORD = regex.compile(r"[\p{Latin}\p{M}]+(?:['’­-][\p{Latin}\p{M}]+)*|[\p{Cyrillic}\p{M}]+(?:-[\p{Cyrillic}\p{M}]+)*")
CAPITALISED = regex.compile(
    r"(?=\p{Lu})(?<![\p{Latin}\p{Cyrillic}\p{M}]|[\p{Latin}\p{M}]['’­-]|[\p{Cyrillic}\p{M}]-)(?:[\p{Latin}\p{M}]{2,}(?:['’­-][\p{Latin}\p{M}]+)*|\p{Latin}['’­-][\p{Latin}\p{M}]+(?:['’­-][\p{Latin}\p{M}]+)*|[\p{Cyrillic}\p{M}]{2,}(?:-[\p{Cyrillic}\p{M}]+)*)"
)
GAP = regex.compile(r"(?:[  ]|[  ]?\p{Lu}\.[  ]?|[  ](?:" + PARTICLES + r")[  ]|[  ]al-)+")
COMMA = regex.compile(r",[  ](?:\p{Lu}\.[  ])?")
LEAD = regex.compile(rf"(?:(?<![\p{{Latin}}\p{{Cyrillic}}.])\p{{Lu}}\.[  ]?)+(?:{PARTICLES}[  ])?$")
TRAIL = regex.compile(r"[  ]\p{Lu}\.(?![\p{L}])")

PRIOR_WEIGHT = 10  # words of the usual share that stand for what is not known of a context

MARK = regex.compile(rf"{_AT}| at (?=[A-Za-z0-9-]+(?: dot [A-Za-z0-9-]+)* dot )")
AT_SIGNS = ("@", " AT ", " dot ", "at)", "at]", "AT)", "AT]", "arroba")  # one of them stands in every address
LOCAL = regex.compile(r"[\p{Latin}\p{Cyrillic}0-9_.+%'’-]*+", regex.REVERSE)
DIGIT = regex.compile(r"\d")
HAN = regex.compile(r"\p{Han}")
TRIM = " \t\u00a0\u2009\u202f\u3000"
BEFORE = regex.compile(rf"(?:\p{{Han}}{{1,2}}|[^\P{{Alnum}}\p{{Han}}][^\P{{L}}\p{{Han}}'’]{{0,40}}\.?|[^{TRIM}])?[{TRIM}]*", regex.REVERSE)
AFTER = regex.compile(rf"[{TRIM}]*(?:\p{{Han}}{{1,2}}|[^\P{{Alnum}}\p{{Han}}]['’\w\-&&[^\p{{Han}}]]{{0,40}}|[^{TRIM}])?", regex.V1)
WIDE = regex.compile("[\uff01-\uff5e\u3000]")


def plain_width(text: str) -> str:
    """The text with full-width characters as plain ones, position by position."""
    return text if text.isascii() or not WIDE.search(text) else text.translate(FULL_WIDTH)


# Each grammar is tried only where its most telling piece stands: digits close together, a word for street with what must follow it.
DENSE = regex.compile(r"\d(?:[^\d\n]{0,4}\d){5,}")
NEAR = 90  # characters before a run of digits in which a label or the first signs of a number stand
TELLING = (
    regex.compile(rf" {_EN_TYPE}(?![\p{{L}}])"),
    regex.compile(r" \d(?<=(?:straße|strasse|str\.|weg|gasse|platz|allee|hang|ufer|damm|ring|steig|graben) \d)"),
    regex.compile(r"(?:\d|bis|ter),? (?:rue|impasse|quai|av|bo|bd|chemin|allée|place|route|cours|square)"),
    regex.compile(r"Calle|C/|Av|Paseo|Plaza|Pza\.|Camino|Ronda|Travesía"),
    regex.compile(r"(?:д\.|дом) ?\d"),
    regex.compile(r"\d号"),
)


@lru_cache(maxsize=1)
def _patterns():
    return regex.compile(ID), regex.compile(EMAIL), [(t, regex.compile(a)) for t, a in zip(TELLING, ADDRESSES, strict=True)], regex.compile(PHONE)


def _windows(text: str) -> list[tuple[int, int]]:
    """Stretches that may hold a number of at least six digits, with what stands before it."""
    out: list[tuple[int, int]] = []
    for m in DENSE.finditer(text):
        lo, hi = max(0, m.start() - NEAR), m.end() + 8
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
    return out


def _emails(pattern, text: str) -> Iterator[tuple[int, int]]:
    """Spans of addresses, tried from the local part that stands before each mark."""
    if not any(sign in text for sign in AT_SIGNS):
        return
    done = 0
    for mark in MARK.finditer(text):
        before = LOCAL.match(text, done, mark.start())
        lo = before.start() if before else mark.start()
        while lo < mark.start() and text[lo] in ".'’-":
            lo += 1
        m = pattern.match(text, lo) if lo < mark.start() else None
        if m and m.end() > mark.end():
            done = m.end()
            yield m.span()


def fixed_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, lo, hi) of everything but names, in order of precedence; spans do not overlap."""
    plain = plain_width(text)
    ids, emails, addresses, phones = _patterns()
    taken: list[tuple[str, int, int]] = []

    def take(kind: str, spans) -> None:
        for lo, hi in spans:
            if lo < hi and all(hi <= a or lo >= b for _, a, b in taken):
                taken.append((kind, lo, hi))

    near = _windows(plain) if DIGIT.search(plain) else []
    for lo, hi in near:
        take("id", (m.span() for m in ids.finditer(plain, lo, hi)))
    take("email", _emails(emails, plain))
    if DIGIT.search(plain):
        for telling, pattern in addresses:
            if telling.search(plain):
                take("address", (m.span() for m in pattern.finditer(plain)))
    for lo, hi in near:
        take("phone", (m.span() for m in phones.finditer(plain, lo, hi) if not CODE_BEFORE.search(plain[max(0, m.start() - 12) : m.start()])))
    return sorted(taken, key=lambda s: s[1])


def _blank(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with the spans overwritten, of the same length."""
    at, out = 0, []
    for _, lo, hi in spans:
        out += [text[at:lo], "\0" * (hi - lo)]
        at = hi
    return "".join([*out, text[at:]])


def _even(text: str) -> str:
    return text.casefold().replace("’", "'").replace("­", "")


def _stem(word: str) -> str:
    w = _even(word)
    return w[:-2] if w.endswith("'s") else w


def _small(word: str) -> bool:
    """Whether a word is in lower case; the article of "al-X" says nothing."""
    return word[0].islower() and not word.lower().startswith("al-")


SPAN = "array<struct<kind: string, lo: int, hi: int>>"
SCANNED = f"doc_id long, text string, fixed {SPAN}"
SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("lo", pa.int32()), ("hi", pa.int32())]))


def _span_array(found: list) -> pa.Array:
    return pa.array([[{"kind": k, "lo": a, "hi": b} for k, a, b in spans] for spans in found], SPAN_TYPE)


def _plain_spans(spans: list[dict] | None) -> list[tuple[str, int, int]]:
    return [(s["kind"], s["lo"], s["hi"]) for s in spans or ()]


def _scan_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fixed = _span_array([fixed_spans(t) if t else [] for t in batch.column(1).to_pylist()])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), fixed], names=["doc_id", "text", "fixed"])


def scan(docs: DataFrame, doc_id: Column, text: Column) -> DataFrame:
    """(doc_id, text, fixed): every text with its spans of fixed shape, written once for all later passes."""
    rows = spread(docs.select(doc_id.cast("bigint").alias("doc_id"), text.alias("text")))
    return materialize(rows.mapInArrow(_scan_rows, SCANNED), "scanned")


def _blanks(batch: pa.RecordBatch, text: int, fixed: int) -> Iterator[str]:
    for t, spans in zip(batch.column(text).to_pylist(), batch.column(fixed).to_pylist(), strict=True):
        yield _blank(plain_width(t), _plain_spans(spans)) if t else ""


def _pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, n, low): capitalised words beside each other, and with empty b the count of each word and how often it is in lower case.

    After a genitive the name has ended, so what follows is not beside it.
    """
    for batch in batches:
        seen: Counter[tuple[str, str]] = Counter()
        words: Counter[str] = Counter()
        for blank in _blanks(batch, 0, 1):
            words.update(WORD.findall(blank))
            before, end = "", 0
            for m in CAPITALISED.finditer(blank):
                word = m.group()
                stem = _stem(word)
                if before and GAP.fullmatch(blank, end, m.start()):
                    seen[before, stem] += 1
                before, end = "" if _even(word[-2:]) == "'s" else stem, m.end()
        low: Counter[tuple[str, str]] = Counter()
        for word, n in words.items():
            key = _stem(word), ""
            seen[key] += n
            if word[0].islower():
                low[key] += n
        if seen:
            a, b = zip(*seen, strict=True)
            counts = [pa.array(list(seen.values()), pa.int64()), pa.array([low[k] for k in seen], pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), *counts], names=["a", "b", "n", "low"])


def grow_lexicon(
    scanned: DataFrame, names: DataFrame, rounds: int = 3, share: float = 0.3, listed_share: float = 0.15, trust: float = 3.0, one: float = 0.8, against: float = 0.4, behind: float = 0.5, weak_share: float = 0.005, most_low: float = 0.5
) -> tuple[DataFrame, DataFrame]:
    """(w, sure) of the words of names, and (a, b) of the fixed phrases that look like two of them.

    All words are judged by the same counts over all documents, listed ones too, since a list holds words that are
    mostly something else. A word is a sure one if at least ``share`` of its occurrences, in any case, stand beside a sure
    word; a word that is not listed is none where more than ``most_low`` of them are in lower case. For listed words
    ``listed_share`` is enough, with ``trust`` occurrences beside a name granted, so that rare ones stay. Other listed words
    are weak: names only beside another name part, or where the context says so. So are words that stand behind a sure one
    in ``behind`` of their occurrences behind any capitalised word, and in ``weak_share`` of all.
    "Xs" is a form of the word X, no word of its own: what stands behind it stands behind a genitive.
    Two words that stand beside each other in more than ``one`` of what stands behind the first and before the second
    are a fixed phrase, as a place name is (each a has one b at most); ``against`` keeps pairs seen once from being one. Nothing here depends on the corpus' size.
    """
    pairs = materialize(scanned.where("text != ''").select("text", "fixed").mapInArrow(_pair_rows, "a string, b string, n long, low long").groupBy("a", "b").agg(F.sum("n").alias("n"), F.sum("low").alias("low")), "word-pairs")
    both = pairs.where("b != ''")
    after = both.groupBy(F.col("b").alias("w")).agg(F.sum("n").alias("any_before"))
    ahead = both.groupBy("a").agg(F.sum("n").alias("any_after"))
    held = (F.col("n") > one * (F.col("any_before") + against)) & (F.col("n") > one * (F.col("any_after") + against))
    links = materialize(both.join(ahead, "a").join(after.withColumnRenamed("w", "b"), "b").select("a", "b", "n", held.alias("fixed")), "word-links")
    free = links.where("not fixed")
    sides = free.select(F.col("a").alias("w"), F.col("b").alias("other"), "n", F.lit(0).alias("behind")).unionAll(free.select("b", "a", "n", F.lit(1)))
    listed = names.where("token is not null").select(F.col("token").alias("raw")).mapInArrow(_stem_rows, "w string").distinct().withColumn("listed", F.lit(True))
    totals = pairs.where("b = ''").select(F.col("a").alias("w"), F.col("n").alias("total"), "low")
    linked = links.select(F.col("a").alias("w")).unionAll(links.select("b")).distinct()
    base = linked.join(listed, "w", "full").join(totals, "w", "left").join(after, "w", "left").where(~F.col("w").isin(*sorted(TITLES)))
    base = base.select("w", "listed", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("total", "low", "any_before")])
    base = materialize(base.where(F.col("listed") | (F.col("low") <= most_low * F.col("total"))), "name-base")
    n, by = (F.coalesce(F.col(c), F.lit(0)) for c in ("n", "by"))
    grade = F.when(F.col("listed"), n + trust >= listed_share * (F.col("total") + trust)).when((n > 0) & (n >= share * F.col("total")), True)
    grade = grade.when((by >= 2) & (by >= behind * F.col("any_before")) & (by >= weak_share * F.col("total")), False)
    words = base.where("listed").select("w", F.lit(True).alias("sure"))
    for _ in range(rounds):  # small tables, written so that the next round plans with their true size
        known = words.where("sure").select(F.col("w").alias("other"))
        beside = sides.join(known, "other").groupBy("w").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("behind")).alias("by"))
        words = materialize(base.join(beside, "w", "left").select("w", "listed", grade.alias("sure")).where("sure is not null"), "name-words")
        genitive = words.select(F.concat("w", F.lit("s")).alias("w"))
        words = words.where("listed").unionAll(words.where("listed is null").join(genitive, "w", "left_anti"))
    kept = words.select("w", "sure")
    weak = kept.where("not sure").select("w")
    phrases = links.where("fixed").select("a", "b").join(weak.toDF("a"), "a", "left_semi").join(weak.toDF("b"), "b", "left_semi").select("a", "b")
    return kept, phrases


def _stem_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([_stem(w) for w in batch.column(0).to_pylist()], pa.string())], names=["w"])


def _token_before(text: str, at: int) -> str:
    """What stands before a place: a title with its point, a word, two Han characters, or one other character."""
    if text[at - 1 : at] == " ":
        word = text[text.rfind(" ", 0, at - 1) + 1 : at - 1]
        if len(word) <= 40 and word.isascii() and word.isalpha():
            return word.lower()
    m = BEFORE.match(text, 0, at)
    token = m.group().rstrip(TRIM).casefold() if m else "^"
    return "." if token[-1:] == "." and token[:-1] not in TITLES else token or "^"


def _token_after(text: str, at: int) -> str:
    if text[at : at + 1] == " ":
        word = text[at + 1 : text.find(" ", at + 1)]
        if len(word) <= 40 and word.isascii() and word.isalpha():
            return word.lower()
    m = AFTER.match(text, at)
    return m.group().lstrip(TRIM).casefold() or "^"


def _context_rows(model):
    """(side, token, names, total) of the words before and after capitalised words that are not weak."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple[str, str], list[int]] = {}
            for blank, find in zip(_blanks(batch, 1, 2), model.finders(batch), strict=True):
                for m in CAPITALISED.finditer(blank):
                    stem = _stem(m.group())
                    if stem in find.weak:
                        continue
                    sure = stem in find.lexicon
                    for key in (("", ""), ("before", _token_before(blank, m.start())), ("after", _token_after(blank, m.end()))):
                        e = seen.setdefault(key, [0, 0])
                        e[0] += sure
                        e[1] += 1
            if seen:
                sides, tokens = zip(*seen, strict=True)
                counts = list(zip(*seen.values(), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(sides, pa.string()), pa.array(tokens, pa.string()), *[pa.array(c, pa.int64()) for c in counts]], names=["side", "token", "names", "total"])

    return rows


def _form_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, w) of every form under which a word of a text may stand in the lexicon."""
    for batch in batches:
        keys, forms = [], []
        for key, blank in zip(batch.column(0).to_pylist(), _blanks(batch, 1, 2), strict=True):
            own = {f for m in WORD.finditer(blank) for f in _forms(_stem(m.group()))}
            keys += [key] * len(own)
            forms += sorted(own)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(forms, pa.string())], names=["key", "w"])


def _forms(stem: str) -> list[str]:
    return [stem, *([stem[:-1]] if stem.endswith("s") else []), *([stem[3:]] if stem.startswith("al-") else [])]


def _around_rows(model):
    """(key, side, token) of what stands before and after the weak words of a text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, str, str]] = []
            for key, blank, find in zip(batch.column(0).to_pylist(), _blanks(batch, 1, 2), model.finders(batch), strict=True):
                own: set[tuple[int, str, str]] = set()
                for m in WORD.finditer(blank):
                    n = find.part(m.group())
                    if n and not find._sure(_stem(m.group())):
                        own |= {(key, "before", _token_before(blank, m.start())), (key, "after", _token_after(blank, m.start() + n))}
                out += sorted(own)
            if out:
                keys, sides, tokens = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sides, pa.string()), pa.array(tokens, pa.string())], names=["key", "side", "token"])

    return rows


class NameModel:
    """The lexicon and the contexts of one corpus, for Arrow functions over (doc_id, text, fixed, known, around)."""

    def __init__(self, words):
        self.words, self.contexts, self.by_text = words, {}, False
        self.shared: NameFinder | None = None  # made once by each task

    def finders(self, batch: pa.RecordBatch) -> Iterator[NameFinder]:
        """A finder for each row; it holds for that row only."""
        for i in range(batch.num_rows):
            if self.words is not None:
                find = self.shared = self.shared or NameFinder(*self.words.value, self.contexts).with_trie()
            else:
                find = NameFinder(*_packed(batch.column(3)[i].as_py() or ()), self.contexts)
            if self.by_text:
                find.contexts = self.contexts | _context_counts(batch.column(4)[i].as_py() or ())
            yield find


def _packed(words) -> tuple[frozenset, frozenset, frozenset]:
    """Sure words, weak words and fixed phrases of rows of the lexicon."""
    return frozenset(r["w"] for r in words if r["sure"]), frozenset(r["w"] for r in words if not r["sure"]), frozenset((r["w"], r["next"]) for r in words if r["next"])


def _context_counts(rows) -> dict:
    return {(r["side"], r["token"]): (r["names"], r["total"]) for r in rows}


def name_model(scanned: DataFrame, names: DataFrame, most: int = 500_000, most_contexts: int = 100_000) -> tuple[DataFrame, NameModel]:
    """The texts with what the model needs beside them, and the model.

    Up to ``most`` words and ``most_contexts`` contexts go to the workers as a whole. Beyond that every text gets the words
    of the lexicon it holds, with the fixed phrases they begin, and the contexts of its weak words by joins, on a hash of the
    text (texts that share a hash share these, which changes nothing). The results are the same either way.
    """
    sc = scanned.sparkSession.sparkContext
    words, phrases = grow_lexicon(scanned, names)
    words = materialize(words.join(phrases.toDF("w", "next"), "w", "left"), "lexicon")
    none = F.lit(None).cast("string")
    if words.count() <= most:
        packed = _packed(words.collect())
        texts, model = scanned.withColumns({"known": none, "around": none}), NameModel(sc.broadcast(packed))
        if not packed[1]:
            return texts, model
    else:
        keyed = scanned.withColumn("key", F.xxhash64("text"))
        forms = keyed.where("text != ''").select("key", "text", "fixed").mapInArrow(_form_rows, "key long, w string").distinct()
        own = forms.join(words, "w").groupBy("key").agg(F.collect_list(F.struct("w", "sure", "next")).alias("known"))
        texts, model = materialize(keyed.join(own, "key", "left").drop("key").withColumn("around", none), "texts-with-words"), NameModel(None)
    counts = materialize(texts.where("text != ''").mapInArrow(_context_rows(model), "side string, token string, names long, total long").groupBy("side", "token").agg(F.sum("names").alias("names"), F.sum("total").alias("total")), "contexts")
    base = counts.where("side = ''").collect()  # one row at most
    if base:
        model.contexts = _context_counts(base)
        counts = counts.where("side != ''")
        if counts.count() <= most_contexts:
            model.contexts |= _context_counts(counts.collect())
        else:
            keyed = texts.drop("around").withColumn("key", F.xxhash64("text"))
            around = keyed.where("text != ''").select("key", "text", "fixed", "known").mapInArrow(_around_rows(model), "key long, side string, token string").distinct()
            own = around.join(counts, ["side", "token"]).groupBy("key").agg(F.collect_list(F.struct("side", "token", "names", "total")).alias("around"))
            texts = materialize(keyed.join(own, "key", "left").drop("key"), "texts-with-contexts")
            model.by_text = True
    return texts, model


class NameFinder:
    """Spans of personal names in a text whose other spans are blanked."""

    def __init__(self, lexicon: frozenset, weak: frozenset, phrases: frozenset = frozenset(), contexts: dict | None = None):
        self.lexicon, self.weak, self.phrases, self.contexts = lexicon, weak, phrases, contexts or {}
        self.quick = self.lexicon | self.weak
        self.parts: dict[str, int] = {}
        self.trie = None

    def with_trie(self) -> NameFinder:
        """Texts that hold no word of the lexicon are told apart first, by one automaton of all words."""
        trie = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for w in self.quick:
            trie.add_word(w)
        if self.quick:
            trie.make_automaton()
            self.trie = trie
        return self

    def part(self, word: str) -> int:
        """Length of the word's name part, 0 if it is none; a genitive ending is no part of the name."""
        n = self.parts.get(word)
        if n is None:
            if len(self.parts) > 200_000:
                self.parts.clear()
            n = self.parts[word] = self._part(word)
        return n

    def _part(self, word: str) -> int:
        stem = _stem(word)
        if stem in self.quick:
            return len(word) - 2 if _even(word[-2:]) == "'s" else len(word)
        if stem.endswith("s") and stem[:-1] in self.quick and len(stem) > 4:
            return len(word) - 1
        if stem.startswith("al-") and stem[3:] in self.quick:
            return len(word)
        return 0

    def __call__(self, blank: str) -> list[tuple[str, int, int]]:
        if self.trie is not None and next(self.trie.iter(_even(blank)), None) is None:
            return []
        words = [(m.start(), m.end(), n, m.group()) for m in WORD.finditer(blank) if (n := self.part(m.group()))]
        found: list[tuple[str, int, int]] = []
        i = 0
        while i < len(words):
            group = [words[i]]
            comma = False
            while i + 1 < len(words):
                lo, hi, n, w = group[-1]
                whole = hi - lo == n  # after a genitive the name has ended
                nxt = words[i + 1]
                small, other = _small(w), _small(nxt[3])
                if small != other and not self._sure(_stem(w if small else nxt[3])):
                    break  # a weak word in lower case is no part of a name in capitals
                if whole and GAP.fullmatch(blank, hi, nxt[0]):
                    if comma and len(group) > 2:
                        break
                elif whole and not comma and len(group) == 1 and COMMA.fullmatch(blank, hi, nxt[0]) and not LEAD.search(blank, max(0, lo - 24), lo):
                    comma = True
                else:
                    break
                group.append(nxt)
                i += 1
            i += 1
            found += self._judge(blank, group)
        return found

    def _judge(self, blank: str, group: list) -> list[tuple[str, int, int]]:
        stems = [_stem(w) for *_, w in group]
        sure = [self._sure(s) for s in stems]
        lo, hi = group[0][0], group[-1][0] + group[-1][2]
        lead = LEAD.search(blank, max(0, lo - 24), lo)
        if not any(sure):
            # weak words, each of which may be a place or a thing: after an initial, beside each other, or in the context of names
            if not all(w[0].isupper() for *_, w in group):
                return []
            if len(group) > 1:
                if any(p in self.phrases for p in zip(stems, stems[1:], strict=False)):
                    return []
            elif not (lead and "." in lead.group()) and self._context(blank, lo, hi) <= 0:
                return []
        lower = [_small(w) for *_, w in group]
        if all(lower) and len(group) < 2 and not lead:
            return []
        if len(group) == 1 and not lead:
            # the first half of a place name ("Linden Gate"): a capitalised word follows that is no name
            if regex.match(r"[  ]\p{Lu}\p{Ll}+", blank[hi : hi + 12]) and group[0][3][1:].islower() and hi == group[0][1]:
                return []
            if not group[0][3][0].isupper():
                return []
        if lead:
            lo = lead.start()
        elif blank[max(0, lo - 3) : lo].lower() == "al-":
            lo -= 3
        if len(group) == 1 or not any(self._sure(s) for s in stems[1:]):
            trail = TRAIL.match(blank, hi)
            if trail and len(group) == 1 and not lead and not regex.match(r"\s+\p{Lu}|\s*$", blank[trail.end() :]):
                hi = trail.end()
        return [("name", lo, hi)]

    def _context(self, blank: str, lo: int, hi: int) -> float:
        """Log odds that a capitalised word is a name, from the words before and after it, taken as independent.

        ``PRIOR_WEIGHT`` words of the usual share are added to each count, so that one or two names in a context decide nothing.
        """
        names, total = self.contexts.get(("", ""), (0, 0))
        if not 0 < names < total:
            return 0.0
        prior = names / total
        odds = -log(prior / (1 - prior))
        for key in (("before", _token_before(blank, lo)), ("after", _token_after(blank, hi))):
            n, of = self.contexts.get(key, (0, 0))
            p = (n + PRIOR_WEIGHT * prior) / (of + PRIOR_WEIGHT)
            odds += log(p / (1 - p))
        return odds

    def _sure(self, stem: str) -> bool:
        return stem in self.lexicon or (stem.endswith("s") and stem[:-1] in self.lexicon) or (stem.startswith("al-") and stem[3:] in self.lexicon)


def all_spans(text: str, finder: NameFinder) -> list[tuple[str, int, int]]:
    fixed = fixed_spans(text)
    return sorted(fixed + finder(_blank(plain_width(text), fixed)), key=lambda s: s[1])


def _located_rows(model: NameModel):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                sorted([*_plain_spans(fixed), *find(blank)], key=lambda s: s[1])
                for fixed, blank, find in zip(batch.column(2).to_pylist(), _blanks(batch, 1, 2), model.finders(batch), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _span_array(found)], names=["doc_id", "text", "spans"])

    return rows


def locate(docs: DataFrame, doc_id: Column, text: Column, names: DataFrame) -> DataFrame:
    """(doc_id, text, spans): every text with all its spans, written once."""
    texts, model = name_model(scan(docs, doc_id, text), names)
    return materialize(texts.mapInArrow(_located_rows(model), f"doc_id long, text string, spans {SPAN}"), "located")
