import pytest

from cellspindle.llm import pii
from cellspindle.llm.surrogates import Surrogates, distinct_surrogates, found_spans, normal_forms, replace_personal

LEXICON = frozenset("flint linden gildora oswick mottrell rusvik o'drennagh çelmirhan jarmund quarendon таврик палисков".split())
FINDER = pii.NameFinder(LEXICON, frozenset({"tolbury"}))


def spans(text):
    return [(k, text[a:b]) for k, a, b in pii.all_spans(text, FINDER)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Call (000) 555-0104 or mail <g.rusvik+lab3@mail.example.com>.", [("phone", "(000) 555-0104"), ("email", "g.rusvik+lab3@mail.example.com")]),
        ("contact=oswick [at] uni-velm [dot] test;tel=07700 900563", [("email", "oswick [at] uni-velm [dot] test"), ("phone", "07700 900563")]),
        ("to rusvik AT lab DOT example DOT org, x＠lab.example.org, y @ ward.invalid", [("email", "rusvik AT lab DOT example DOT org"), ("email", "x＠lab.example.org"), ("email", "y @ ward.invalid")]),
        ("Sample pool@216, @rack_03, lot 671 263 883, order 000/715960, ISBN 0-00-360417-X, QC-590-88-7935, chr7:3634-25015, 2042-01-14, 0.035826709, v2.66.6, 12:63:93", []),
        ("SSN: 666478369, NI number QQ 26 15 78 C, passport no. XZ6403703", [("id", "666478369"), ("id", "QQ 26 15 78 C"), ("id", "XZ6403703")]),
        ("Steuer-ID 00 689 391 357; SV-Nummer 00347983X539; DNI: 00.000.660W; NIR 1 99 13 99 091 041 49", [("id", "00 689 391 357"), ("id", "00347983X539"), ("id", "00.000.660W"), ("id", "1 99 13 99 091 041 49")]),
        ("паспорт 00 00 388461, СНИЛС 000-268-811 44, 身份证号 00000018995138463X", [("id", "00 00 388461"), ("id", "000-268-811 44"), ("id", "00000018995138463X")]),
        ("+49 (0)171 39 200 79, 030/23125716, +33 (0)1 99 00 60 79, (+34) 900 000 906, 600000768, 来自０１０-００００９０８５，", [("phone", "+49 (0)171 39 200 79"), ("phone", "030/23125716"), ("phone", "+33 (0)1 99 00 60 79"), ("phone", "(+34) 900 000 906"), ("phone", "600000768"), ("phone", "０１０-００００９０８５")]),
        ("lives at Flat 9, 157B N. Orchard Ave, Apt 2, Linden Gate ZQ6 1XX. Then", [("address", "Flat 9, 157B N. Orchard Ave, Apt 2, Linden Gate ZQ6 1XX")]),
        ("an Flat 13\n85 Kiln Terrace\nHessingen, QX 00492, on", [("address", "Flat 13\n85 Kiln Terrace\nHessingen, QX 00492")]),
        ("wohnt in Moorbachstraße 154 b, 08651 Velmstadt.", [("address", "Moorbachstraße 154 b, 08651 Velmstadt")]),
        ("habite 130 bis impasse de l'Orgeval, 00136 Brumeval, sans", [("address", "130 bis impasse de l'Orgeval, 00136 Brumeval")]),
        ("vive en Plaza del Encinar, nº 27, 2.º B, 00895 Cala Brisa.", [("address", "Plaza del Encinar, nº 27, 2.º B, 00895 Cala Brisa")]),
        ("адрес: ул. Ольховая, д. 28, кв. 3, 000593 Остров", [("address", "ул. Ольховая, д. 28, кв. 3, 000593 Остров")]),
        ("住在青岚市石桥街127号3单元165室。", [("address", "青岚市石桥街127号3单元165室")]),
        ("Dr. Gildora de la Rusvik, J. Quarendon, QUARENDON Jarmund and Tolbury, Oswick met.", [("name", "Gildora de la Rusvik"), ("name", "J. Quarendon"), ("name", "QUARENDON Jarmund"), ("name", "Tolbury, Oswick")]),
        ("Flint Bridge, Linden Gate and Tolbury are places; Flint Tolbury's and oswick mottrell are not.", [("name", "Flint Tolbury"), ("name", "oswick mottrell")]),
        ("Sablon? Gildora\xa0H. O'Drennaghs Nummer, de Flint Rusvik", [("name", "Gildora\xa0H. O'Drennagh"), ("name", "Flint Rusvik")]),
        ("来自N. Rusvik。 Таврик S. Палисков", [("name", "N. Rusvik"), ("name", "Таврик S. Палисков")]),
        ("", []),
        ("  \n ", []),
    ],
)
def test_spans(text, want):
    assert spans(text) == want


def docs(spark):
    people = ["Gildora Rusvik", "Oswick Rusvik", "Gildora Velda", "Oswick Velda", "Velda, Jarmund"]
    texts = [f"Please write to {p} at x{i}@lab.example.org. The end." for i, p in enumerate(people)] + [None, "", "near Linden Gate", "near Linden Gate"]
    rows = [(i, t, "en", "k") for i, t in enumerate(texts)] + [(None, "Call 07700 900563 or 07700900563", "en", "k"), (50, "SSN 666-26-7929 " * 3_000, None, "k")]
    names = spark.createDataFrame([("Gildora", "given"), ("Oswick", "given"), ("Rusvik", "family"), ("Jarmund", "given"), ("Linden", "given"), (None, None)], "token string, token_kind string")
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, kind string"), names


def test_lexicon_grows(spark):
    d, n = docs(spark)
    known, _ = lexicon(d, n)
    assert "velda" in known and "gate" not in known and "the" not in known
    german = spark.createDataFrame([(None, f"{g} Veldas Nummer ist alt. {g} Velda kam.") for g in ("Gildora", "Oswick", "Jarmund")], "doc_id long, text string")
    known, weak = lexicon(german, n)
    assert "velda" in known and not {"veldas", "nummer"} & (known | weak)
    found = {(r.doc_id, r.kind, r.lo, r.hi) for r in found_in(d, n) if r.doc_id != 50}
    assert (2, "name", 16, 29) in found and (4, "name", 16, 30) in found and (None, "phone", 5, 17) in found
    assert not any(i in (5, 6, 7, 8) for i, *_ in found)
    assert not found_in(d.limit(0), n)


def lexicon(d, names):
    words = pii.grow_lexicon(pii.scan(d, d.doc_id, d.text), names)[0].collect()
    return {r.w for r in words if r.sure}, {r.w for r in words if not r.sure}


def found_in(d, names):
    return found_spans(replace_personal(d, d.doc_id, d.text, names, b"key")).collect()


def town_texts(town):
    """Names beside a town that is listed as a name too, and is one here and there."""
    people = [(g, f) for g in ("Gildora", "Oswick", "Jarmund", "Calidra") for f in ("Rusvik", "Velda", "Mottrell", town)]
    texts = [f"The door in {town} stays open on day {i}." for i in range(150)]
    texts += [f"A letter for {g} {f} came. {g} can be reached at noon. Thanks, {f}!" if f != town else f"A letter for {g} {f} came." for g, f in people]
    return [*texts, f"now {town} can be reached at noon. Thanks, {town}!"]


@pytest.mark.parametrize("most", [500_000, 0])  # the lexicon as a whole, and joined to the texts
def test_listed_words_are_judged(spark, most):
    texts = town_texts("Marbury")
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    n = spark.createDataFrame([(w,) for w in "Gildora Oswick Jarmund Calidra Rusvik Mottrell Marbury".split()], "token string")
    rows, model = pii.name_model(pii.scan(d, d.doc_id, d.text), n, most=most)
    located = {r.doc_id: [texts[r.doc_id][s.lo : s.hi] for s in r.spans] for r in rows.mapInArrow(pii._located_rows(model), f"doc_id long, text string, spans {pii.SPAN}").collect()}
    assert not any(located[i] for i in range(150))
    assert located[153] == ["Gildora Marbury"] and located[150] == ["Gildora Rusvik", "Gildora", "Rusvik"]
    assert located[len(texts) - 1] == ["Marbury", "Marbury"]


@pytest.mark.parametrize("sizes", [{"most": 0}, {"most_contexts": 0}, {"most": 0, "most_contexts": 0}])
def test_sizes_change_nothing(spark, sizes):
    """Words, fixed phrases and contexts joined to the texts give the same rows as when they are sent whole."""
    texts = [*town_texts("Marbury"), *[f"Room {i} in Flint Bridge was closed." for i in range(60)], "Marbury's gate", "Once Marbury can be lost.", "", None]
    d = spark.createDataFrame([*enumerate(texts), (None, "now Marbury can be reached at noon.")], "doc_id long, text string")
    n = spark.createDataFrame([(w,) for w in "Gildora Oswick Jarmund Calidra Rusvik Mottrell Marbury Flint Bridge".split()], "token string")
    scanned = pii.scan(d, d.doc_id, d.text)

    def located(**limits):
        rows, model = pii.name_model(scanned, n, **limits)
        found = rows.mapInArrow(pii._located_rows(model), f"doc_id long, text string, spans {pii.SPAN}").collect()
        return {(r.doc_id, r.text): [r.text[s.lo : s.hi] for s in r.spans] for r in found}

    want = located()
    assert want[None, "now Marbury can be reached at noon."] == ["Marbury"] and not any("Bridge" in x for spans in want.values() for x in spans)
    assert located(**sizes) == want


def test_place_phrases(spark):
    """Both halves of a place name in the list are no name; a third of the list missing is grown again."""
    texts = [f"Room {i} in Flint Bridge was closed." for i in range(60)]
    texts += [f"A note for {g} {f} came." for g in ("Gildora", "Oswick", "Jarmund", "Calidra", "Flint") for f in ("Rusvik", "Velda", "Mottrell")]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    n = spark.createDataFrame([(w,) for w in "Gildora Oswick Flint Bridge Rusvik".split()], "token string")
    got = [(r.doc_id, texts[r.doc_id][r.lo : r.hi]) for r in found_in(d, n)]
    assert sorted(got) == [(i, texts[i][11:-6]) for i in range(60, 75)]


def test_words_of_capitals_are_no_names(spark):
    """One text in capitals must not make names of the ordinary words beside the names in it."""
    people = [f"{g} {f}" for g in ("Gildora", "Oswick", "Jarmund") for f in ("Rusvik", "Mottrell")]
    texts = [f"{p}'s number is lost; the form lists {p} twice. We met in Tolbury." for p in people] * 3
    texts += ["GILDORA VELDA'S NUMBER IS LOST. THE FORM LISTS OSWICK VELDA TWICE, AS SEEN IN JARMUND VELDA IN TOLBURY."]
    texts += [f"{p}s Nummer ist alt." for p in people]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    n = spark.createDataFrame([(w,) for w in "Gildora Oswick Jarmund Rusvik Mottrell".split()], "token string")
    known, weak = lexicon(d, n)
    assert "velda" in known and not {"is", "number", "lists", "in", "nummer", "twice"} & (known | weak)
    assert {texts[r.doc_id][r.lo : r.hi].title() for r in found_in(d, n)} == {*people, "Gildora Velda", "Oswick Velda", "Jarmund Velda"}


def test_weak_words_in_lower_case():
    find = pii.NameFinder(LEXICON, frozenset({"can", "tolbury"}))
    texts = ("Gildora can come", "can Gildora come", "Gildora Tolbury came", "oswick tolbury came")
    assert [[t[a:b] for _, a, b in find(t)] for t in texts] == [["Gildora"], ["Gildora"], ["Gildora Tolbury"], ["oswick tolbury"]]


def test_replacement(spark):
    d, n = docs(spark)
    out = {r.doc_id: r for r in replace_personal(d, d.doc_id, d.text, n, b"key").collect()}
    assert len(out) == 11 - 0 and out[5].text is None and out[7].text == "near Linden Gate"
    assert out[0].masked == "Please write to [NAME] at [EMAIL]. The end."
    assert "Gildora" not in out[0].text and out[0].text.endswith(".org. The end.")
    word = lambda i, k: out[i].text.split(" ")[k]
    assert word(0, 3) == word(2, 3) and word(0, 4) == word(1, 4) and word(2, 4) == word(3, 4) == word(4, 3).rstrip(",")
    assert out[50].masked.startswith("SSN [ID] SSN [ID]")
    assert replace_personal(d.limit(0), d.doc_id, d.text, n, b"key").count() == 0


def test_formats():
    s = Surrogates(b"key", {})
    phone = s.replace("phone", "+44 20 7946 0823")
    assert phone.startswith("+44 ") and [len(x) for x in phone.split(" ")] == [3, 2, 4, 4]
    assert normal_forms("phone", phone) == normal_forms("phone", s.replace("phone", "+442079460823"))
    assert s.replace("name", "RUSVIK Gildora") == f"{s.replace('name', 'Rusvik').upper()} {s.replace('name', 'Gildora')}"
    assert s.replace("name", "G. Rusvik")[0] == s.replace("name", "Gildora")[0]
    assert s.replace("name", "Таврик")[0] in "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"
    assert s.replace("address", "12 Kiln Terrace, Tolbury").split(" ")[2] == "Terrace,"
    assert s.replace("email", "a.b(at)lab.example.org").count("(at)") == 1
    assert Surrogates(b"other", {}).replace("name", "Rusvik") != s.replace("name", "Rusvik")


def test_collisions_are_resolved(spark):
    # passport numbers of one digit: at most ten replacements for ten entities, so they must collide at first
    forms = [("id", str(i)) for i in range(8)] + [("name", f"n{'abcdefghij'[i % 10]}{'aeiou'[i % 5]}{i // 50 * 'x'}") for i in range(200)]
    args = distinct_surrogates(spark.createDataFrame(sorted(set(forms)), "kind string, form string"), b"key")
    make = Surrogates(*args)
    for kind in ("id", "name"):
        entries = [make.entry(kind, f) for k, f in set(forms) if k == kind]
        assert len(entries) == len(set(entries))
    assert args[1]
