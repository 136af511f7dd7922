"""Surrogates for personal information (second half of problem 8).

Every detected entity gets a keyed replacement of its own type, script, case and format: digits stay digits, separators
and country codes stay, a name gets a name of the same script, case and (as far as its ending tells) gender. The
replacement depends only on the key and the entity's normal form, so all mentions of an entity agree across documents
and spellings. Distinctness is checked over the whole corpus: where two entities would share a replacement, all but the
first are derived again until none collide. Only those few exceptions travel to the workers.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellspindle.llm import pii
from cellspindle.session import materialize, spread

PLACEHOLDER = {k: f"[{k.upper()}]" for k in pii.KINDS}

# Letters for surrogates by script, endings by gender, words of an address that stay.
LETTERS = {"latin": ("aeiou", "bdfghklmnprstvz"), "cyrillic": ("аеиоу", "бвгдзклмнпрстфх")}
ENDINGS = {"latin": {"f": "a", "m": "n"}, "cyrillic": {"f": "а", "m": "н"}}
HAN = "东南西北山水云石林田松竹梅兰春秋江湖河海星月风雨金玉清明安平福康"
ADDRESS_WORDS = regex.compile(
    rf"^(?:{pii._EN_TYPE[3:-1]}|Flat|Apt|Apartment|Unit|Suite|Calle|C|Avda|Avenida|Av|Paseo|Plaza|Pza|Camino|Ronda|Travesía|Am|Alte|Alter|Im|In|An|Auf|Zum|Zur|Neue|Große|Kleine|\p{{Lu}})$"
)
GERMAN_TYPE = regex.compile(r"(?:straße|strasse|str|weg|gasse|platz|allee|hang|ufer|damm|ring|steig|graben)$")
DOTS, ATS, TLD = regex.compile(rf"{pii._DOT}| dot "), regex.compile(rf"{pii._AT}| at "), regex.compile(rf"(?:{pii._DOT}| dot )[A-Za-z]+$")
NO_NUMBER, NO_CODE, SPACES = regex.compile(r"[^\d+]"), regex.compile(r"[\W_]"), regex.compile(r"[\s,]+")
NAME_WORD, PLACE_WORD, CYRILLIC = regex.compile(r"[\p{L}\p{M}]+(?:['’­-][\p{L}\p{M}]+)*"), regex.compile(r"\d+|\p{Han}|[\p{L}\p{M}'’]+"), regex.compile(r"\p{Cyrillic}")
SPELLED = regex.compile(rf"{pii._AT}|{pii._DOT}| at | dot |[+_-]")


def normal_forms(kind: str, text: str) -> list[str]:
    """Normal forms of an entity; a name has one for each of its words, all other kinds one."""
    plain = text.translate(pii.FULL_WIDTH)
    if kind == "email":
        return [DOTS.sub(".", ATS.sub("@", plain, count=1)).casefold()]
    if kind == "phone":
        return [NO_NUMBER.sub("", plain)]
    if kind == "id":
        return [NO_CODE.sub("", plain).upper()]
    if kind == "address":
        return [SPACES.sub(" ", plain).casefold()]
    return [w.casefold().replace("’", "'") for w in _name_words(plain)]


def _name_words(text: str) -> list[str]:
    return [m.group() for m in pii.WORD.finditer(text) if not _stays(m.group())]


def _stays(word: str) -> bool:
    """Initials are mapped letter by letter; particles stay."""
    return len(word) == 1 or word in pii.PARTICLES[3:-1].replace("|", " ").split()


class Surrogates:
    def __init__(self, key: bytes, bumps: dict[tuple[str, str], int], syllables: int = 3):
        self.key, self.bumps, self.syllables = key, bumps, syllables
        self.memo: dict[tuple[str, str], str] = {}

    def _bytes(self, kind: str, form: str) -> Iterator[int]:
        block = 0
        attempt = self.bumps.get((kind, form), 0)
        while True:
            yield from hashlib.blake2b(f"{kind}\0{form}\0{attempt}\0{block}".encode(), key=self.key).digest()
            block += 1

    def _letter(self, c: str) -> str:
        """A keyed permutation of initials, so that an initial agrees with its name."""
        base = unicodedata.normalize("NFD", c)[0].upper()
        script = "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ" if CYRILLIC.match(base) else "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
        if base not in script:
            return script[0]
        shift = next(self._bytes("letter", script)) % (len(script) - 1) + 1
        return script[(script.index(base) + shift) % len(script)]

    def word(self, kind: str, form: str, initial: bool) -> str:
        """A capitalised word of the script and gender of ``form``."""
        if (kind, form) in self.memo:
            return self.memo[kind, form]
        script = "cyrillic" if CYRILLIC.search(form) else "latin"
        vowels, consonants = LETTERS[script]
        stream = self._bytes(kind, form)
        first = self._letter(form[0]) if initial else consonants[next(stream) % len(consonants)].upper()
        body = [first] if first.lower() in vowels + ("яюэеё" if script == "cyrillic" else "y") else [first, vowels[next(stream) % 5]]
        for _ in range(self.syllables):
            body += [consonants[next(stream) % len(consonants)], vowels[next(stream) % 5]]
        gender = "f" if form[-1] in "aeаея" else "m"
        out = "".join(body[:-1]) + ENDINGS[script][gender] if gender == "f" else "".join(body) + ENDINGS[script][gender]
        if len(self.memo) > 200_000:
            self.memo.clear()
        self.memo[kind, form] = out
        return out

    def _pour(self, text: str, stream: Iterator[int], keep: int = 0) -> str:
        """Each digit and letter replaced by one of its kind; the first ``keep`` digits stay."""
        out = []
        for c in text:
            if c.isdigit() and keep:
                keep -= 1
                out.append(c)
            elif "0" <= c <= "9":
                out.append(chr(48 + next(stream) % 10))
            elif "０" <= c <= "９":
                out.append(chr(0xFF10 + next(stream) % 10))
            elif c.isalpha():
                base = "абвгдежзиклмнопрст" if CYRILLIC.match(c) else "abcdefghijklmnopqrstuvwxyz"
                new = base[next(stream) % len(base)]
                out.append(new.upper() if c.isupper() else new)
            else:
                out.append(c)
        return "".join(out)

    def replace(self, kind: str, text: str) -> str:
        plain = text.translate(pii.FULL_WIDTH)
        if kind == "name":
            return NAME_WORD.sub(lambda m: self._name(m.group()), text)
        stream = self._bytes(kind, normal_forms(kind, text)[0])
        if kind == "phone":
            return self._pour(text, stream, 2 if "+" in plain else 4 if plain.startswith("00") else int(plain.lstrip("(")[0] in "01"))
        if kind == "id":
            return self._pour(text, stream)
        if kind == "email":
            last = TLD.search(plain)
            head, tld = text[: last.start()], text[last.start() :]
            out, at = [], 0
            for s in SPELLED.finditer(head.translate(pii.FULL_WIDTH)):
                out += [self._pour(head[at : s.start()], stream), head[s.start() : s.end()]]
                at = s.end()
            return "".join([*out, self._pour(head[at:], stream), tld])
        return PLACE_WORD.sub(lambda m: self._place(m.group(), stream), text)

    def _name(self, word: str) -> str:
        if word.lower().startswith("al-"):
            return word[:3] + self._name(word[3:])
        if _stays(word):
            return self._letter(word) if len(word) == 1 else word
        new = self.word("name", word.casefold().replace("’", "'"), True)
        return new.upper() if word.isupper() else new.lower() if word.islower() else new

    def _place(self, word: str, stream: Iterator[int]) -> str:
        if word[0].isdigit():
            return self._pour(word, stream, int(word[0] == "0"))
        if pii.HAN.match(word):
            return word if word in "市县区路街巷道号楼栋单元室" else HAN[next(stream) % len(HAN)]
        if word[0].islower() or ADDRESS_WORDS.match(word):
            return word
        if word.isupper() and len(word) <= 3:  # part of a postcode
            return self._pour(word, stream)
        tail = GERMAN_TYPE.search(word)
        new = self.word("place", word.casefold(), False)
        return new + tail.group() if tail else new

    def entry(self, kind: str, form: str) -> str:
        """What must be distinct among the entities of a kind."""
        if kind == "name":
            return self.word("name", form, True).casefold()
        return normal_forms(kind, self.replace(kind, form))[0]


def _entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen = {(s["kind"], f) for t, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for s in spans for f in normal_forms(s["kind"], t[s["lo"] : s["hi"]])}
        if seen:
            kinds, forms = zip(*seen, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(forms, pa.string())], names=["kind", "form"])


def _entries(maker):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Surrogates(*maker.value)
        for batch in batches:
            new = [make.entry(k, f) for k, f in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(new, pa.string())], names=["kind", "form", "entry"])

    return rows


def distinct_surrogates(entities: DataFrame, key: bytes, most: int = 200_000, rounds: int = 30) -> tuple[bytes, dict, int]:
    """Arguments of ``Surrogates`` under which no two entities (kind, form) share a replacement, and no name gets one of the corpus.

    The exceptions (entities derived again) are held on the driver, at most ``most``; where there would be more, names get
    one more syllable, which divides their number by about 75, and the check starts again.
    """
    spark = entities.sparkSession
    syllables, bumps, named = 3, {}, None
    own = Window.partitionBy("kind", "entry")  # an entry and who has it, the name of the corpus that it equals among them
    given = entities.where("kind = 'name'").select("kind", F.col("form").alias("entry"), F.lit(None).cast("string").alias("form"))
    for _ in range(rounds):
        args = (key, bumps, syllables)
        entries = lambda rows: rows.mapInArrow(_entries(spark.sparkContext.broadcast(args)), "kind string, form string, entry string")  # noqa: B023, E731
        if named is None:
            first = named = materialize(entries(spread(entities)), "surrogates")
        else:  # only those derived again have changed
            again = spark.createDataFrame(sorted(bumps), "kind string, form string")
            named = first.join(F.broadcast(again), ["kind", "form"], "left_anti").unionByName(materialize(entries(spread(again)), "surrogates"))
        held = named.select("kind", "entry", "form").unionAll(given).withColumns({"first": F.min("form").over(own), "given": F.bool_or(F.col("form").isNull()).over(own)})
        losers = held.where("form is not null and (given or form != first)").select("kind", "form").limit(most + 1).collect()
        if not losers:
            return args
        if len(losers) > most or len(bumps) > most:
            syllables, bumps, named = syllables + 1, {}, None
        else:
            bumps = bumps | {(r.kind, r.form): bumps.get((r.kind, r.form), 0) + 1 for r in losers}
    raise ValueError("replacements still collide")


def _rewritten(maker):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Surrogates(*maker.value)
        for batch in batches:
            texts, masks = [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                new, mask, at = [], [], 0
                for s in spans:
                    between = text[at : s["lo"]]
                    new += [between, make.replace(s["kind"], text[s["lo"] : s["hi"]])]
                    mask += [between, PLACEHOLDER[s["kind"]]]
                    at = s["hi"]
                texts.append("".join([*new, text[at:]]))
                masks.append("".join([*mask, text[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(masks, pa.string()), batch.column(2)], names=["doc_id", "text", "masked", "spans"])

    return rows


def replace_personal(docs: DataFrame, doc_id: Column, text: Column, names: DataFrame, key: bytes) -> DataFrame:
    """(doc_id, text, masked, spans): the text with surrogates, with typed placeholders such as [EMAIL], and what was replaced.

    ``spans`` holds (kind, lo, hi) in characters of the text as given, end exclusive. ``key`` is the secret that the
    replacements depend on. Defined cases: one row per row of ``docs``; a null text stays null and has no spans, as have
    empty and blank ones; texts without personal information stay as they are; repeated rows repeat their occurrences;
    a null id stays null; very long texts are searched whole; an empty table gives no rows; clashing column names do no harm.
    """
    if not key:
        raise ValueError("replacements need a secret key")
    sc = docs.sparkSession.sparkContext
    found = pii.locate(docs, doc_id, text, names)
    entities = materialize(found.where(F.size("spans") > 0).select("text", "spans").mapInArrow(_entities, "kind string, form string").distinct(), "entities")
    maker = sc.broadcast(distinct_surrogates(entities, key))
    touched = found.where(F.size("spans") > 0).mapInArrow(_rewritten(maker), f"doc_id long, text string, masked string, spans {pii.SPAN}")
    return touched.unionAll(found.where(F.size("spans") == 0).select("doc_id", "text", F.col("text").alias("masked"), "spans"))


def found_spans(replaced: DataFrame) -> DataFrame:
    """(doc_id, kind, lo, hi): one row per replaced occurrence."""
    return replaced.select("doc_id", F.inline("spans"))
