import os
import random

import numpy as np
import pytest
import regex as re

from weftline.llm import name_tagger as N
from weftline.llm import pii as I
from weftline.llm import pseudonyms as S
from weftline.tables import load

SF_DIR = "/root/testdata/sf0.01"  # enough texts for weak labels
pytestmark = pytest.mark.skipif(not os.path.exists(SF_DIR), reason="the test tables are not here")

NAMES = frozenset({"jarlyn", "hesby", "käthel"})
FOUND = {
    "Write to a.b+c@mail.ex.example or ring 430.555.0182 after six.": [("email", "a.b+c@mail.ex.example"), ("phone", "430.555.0182")],
    "Reply-To: x_7[at]letters[dot]test": [("email", "x_7[at]letters[dot]test")],
    "mail j-k at post dot invalid\n": [("email", "j-k at post dot invalid")],
    "correo a (at) example.net; Tel. (+34) 600 00 02 68": [("email", "a (at) example.net"), ("phone", "(+34) 600 00 02 68")],
    "cell +44 (0)7700 900429, Tél. : 01.99.00.12.33": [("phone", "+44 (0)7700 900429"), ("phone", "01.99.00.12.33")],
    "Telefon (030) 23 125 779, Anschrift: Hafengasse 12/8": [("phone", "(030) 23 125 779"), ("address", "Hafengasse 12/8")],
    "My address is still 53 Station St..": [("address", "53 Station St.")],
    "My address is still 7 Larkfield Ave.": [("address", "7 Larkfield Ave")],
    "colis : 193 bis, avenue Montrelin.": [("address", "193 bis, avenue Montrelin")],
    "Mi dirección es Avda. de la Ribera, nº 46.": [("address", "Avda. de la Ribera, nº 46")],
    "ID QQ 14 05 55 C was typed; ID 930-02-1132 was typed": [("id_number", "QQ 14 05 55 C"), ("id_number", "930-02-1132")],
    "El documento 00.306.740-N está a nombre de Soliro Mendoñez.": [("id_number", "00.306.740-N"), ("name", "Soliro Mendoñez")],
    "We spoke to HESISSA OSKLEY, who found it": [("name", "HESISSA OSKLEY")],
    "— Feswley, Corric This column": [("name", "Feswley, Corric")],
    "as Dr. Wynvin van Brundingham told the desk": [("name", "Wynvin van Brundingham")],
    "Mme A. Delarier a relu la transcription": [("name", "A. Delarier")],
    "we met Jarlyn Feswick today": [("name", "Jarlyn Feswick")],
    "The verso of inv. 195-395-2567 and Game 401968980, TM 470207; see vol. 33, 333-594": [],
    "Im Jahr 1343 kostete ein Scheffel 64 Pfennig; Pebylon asks for barley; @hoops33": [],
    "Saved from https://reads.example/57/49?u=a@b.org and left": [],
    "": [],
}


#: general phrasing, no template of any table: what a tagger without training has to find
GENERAL = {
    "Her SSN 123-45-6789 was typed; 666-12-1234 was not": [("id_number", "123-45-6789")],
    "Please dial 212-345-6789": [("phone", "212-345-6789")],
    "phone: 3456789012": [("phone", "3456789012")],
    "My number: 020 7946 0958": [("phone", "020 7946 0958")],
    "passport AB1234567 lost": [("id_number", "AB1234567")],
    "DNI 12345678Z was shown, and 12345678A is no number": [("id_number", "12345678Z")],
    "12345678Z and X1234567L pass by their letters": [("id_number", "12345678Z"), ("id_number", "X1234567L")],
    "call +420 601 123 456 or +353 86 123 4567": [("phone", "+420 601 123 456"), ("phone", "+353 86 123 4567")],
    "mail me: joe at mycorp dot shop": [("email", "joe at mycorp dot shop")],
    "Interviewed by Ursula Kroeber": [("name", "Ursula Kroeber")],
    "Maria Lopez Garcia": [("name", "Maria Lopez Garcia")],
    "We met Maria Lopez Garcia yesterday.": [("name", "Maria Lopez Garcia")],
    "Regards,\nJohn Smith": [("name", "John Smith")],
    "Smith, John A. wrote": [("name", "Smith, John A.")],
    "Call Mr. Smithson Bell at (415) 555-2671": [("name", "Smithson Bell"), ("phone", "(415) 555-2671")],
    "Thanks, John": [],
    "order 1234567890 and inv. 662-315-3888": [],
    "The museum at Palaia Monytynis and Brimabrook Tech": [],
}


@pytest.fixture(scope="module")
def tagger(spark):
    names = I.forename_set(load(spark, SF_DIR, "given_names"), "given_name")
    fitted = N.fit_tagger(load(spark, SF_DIR, "documents"), "doc_id", "text", names | NAMES)
    assert fitted.labelled_mean < 1.0
    return fitted


@pytest.mark.parametrize("text", FOUND)
def test_details(text, tagger):
    assert [(k, text[a:b]) for k, a, b in I.find_details(text, tagger)] == FOUND[text]


@pytest.mark.parametrize("text", GENERAL)
def test_details_without_training(text):
    prior = N.Tagger(frozenset({"maria", "john", "ursula"}))
    assert [(k, text[a:b]) for k, a, b in I.find_details(text, prior)] == GENERAL[text]


#: contexts of names in the tables; each is held out in turn
CONTEXTS = [r" told the desk", r"spoke to $", r"are held for $", r" lives at", r"[—–] $", r" habite ", r" a relu", r" wohnt ", r"gehört zu $", r" revisó", r"Contact: $", r"form lists $", r"photographs to $"]


@pytest.mark.parametrize("held", [CONTEXTS[::2], CONTEXTS[1::2]])
def test_names_in_phrasing_never_seen(spark, held, tagger):
    """Weak labels in half of the contexts are removed from training; names in them are found nevertheless."""
    texts = sorted({r["text"] for r in load(spark, SF_DIR, "documents").select("text").collect() if r["text"]})

    def inside(t, a, b):
        return any(re.search(c, t[max(0, a - 20) : a]) if c.endswith("$") else re.match(c, t[b : b + 16]) for c in held)

    start = N.Tagger(tagger.forenames, tagger.common, tagger.openers)
    feats, y = [], []
    for t in texts:
        for a, b, f, known, fit in N.candidates(t, start):
            if fit and not inside(t, a, b):
                feats.append(f)
                y.append(known)
    blind = N.fit_on(feats, np.array(y, dtype=float), start)
    want, got = set(), set()
    for i, t in enumerate(texts):
        names = lambda g: {(i, a, b) for k, a, b in I.find_details(t, g) if k == "name"}  # noqa: B023, E731
        full, part = names(tagger), names(blind)
        want |= {x for x in full if inside(t, x[1], x[2])}
        got |= {x for x in part if inside(t, x[1], x[2]) or x not in full}
    assert len(want) > 30
    assert len(want & got) >= 0.9 * len(want) and len(want & got) >= 0.9 * len(got)


def test_spans_never_overlap_in_noise(tagger):
    rnd = random.Random(5)
    bits = [t for t in FOUND if t]
    for _ in range(200):
        text = rnd.choice(["\n", " ", "  "]).join(rnd.sample(bits, 4))
        last = 0
        for _, a, b in I.find_details(text, tagger):
            assert last <= a < b <= len(text)
            last = b


PHONES = ["+44 (0)7700 900392", "07700 900392", "+44 7700 900 392", "(401) 555-0154", "+1 401 555 0154", "14015550154", "0049 30 23125229", "+49 30 23125-229", "030/23125229", "600000975"]
IDS = ["00598614Q", "00.306.740-N", "X1234567L", "X0013074B", "1 99 99 99 919 364 11", "123-45-6789", "929-98-4589", "QQ 14 05 55 C", "L05X0T942", "00XX51524"]


@pytest.mark.parametrize("kind,value", [*(("phone", v) for v in PHONES), *(("id_number", v) for v in IDS), ("date", "1984-03-02"), ("date", "29.02.2000")])
def test_pseudonyms_keep_the_format_and_can_be_undone(kind, value):
    new = S.stand_in(kind, value, b"k")
    shape = lambda v: re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", v))
    assert new != value and shape(new) == shape(value) and S.stand_in(kind, new, b"k", True) == value
    found = [k for k, _, _ in I.find_details(f"phone {new}" if kind == "phone" else f"passport {new}" if kind == "id_number" else "", N.Tagger())]
    assert kind == "date" or found == [kind]


def test_a_number_is_linked_however_it_is_dialled():
    same = lambda vs: len({S.P.national_number(S.stand_in("phone", v, b"k"))[0] for v in vs}) == 1
    assert same(PHONES[:3]) and same(PHONES[3:6]) and same(PHONES[6:9])
    assert S.P.dni_letter(S.stand_in("id_number", "12345678Z", b"k")[:8]) == S.stand_in("id_number", "12345678Z", b"k")[8]  # valid stays valid


def test_feistel_is_a_permutation_and_can_be_undone():
    for n in (1, 2, 3, 4):
        every = [str(i).zfill(n) for i in range(10**n)]
        out = [S.feistel_digits(x, b"k") for x in every]
        assert sorted(out) == every
        assert [S.feistel_digits(x, b"k", back=True) for x in out] == every
    assert S.feistel_digits("4305550182", b"k") != S.feistel_digits("4305550182", b"l")
    days = [S.permute_within(i, 366, b"k") for i in range(366)]
    assert sorted(days) == list(range(366)) and [S.permute_within(x, 366, b"k", back=True) for x in days] == list(range(366))


def test_masking_links_equal_values(spark, tagger):
    rows = [(1, "ring 430.555.0182 now"), (2, "or ring 430.555.0182"), (3, None), (4, ""), (5, "— Jarlyn Feswick"), (6, "— Feswick, Jarlyn"), (7, "x" * 300_000 + " ring 430.555.0182"), (8, "born on 1984-03-02")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, kind string")
    masked = I.mask_details(df, "doc_id", "text", tagger, b"k")
    got = {r["doc_id"]: r["text"] for r in masked.collect()}
    tag = got[2].removeprefix("or ring ")
    assert tag.startswith("[PHONE ") and got[1] == f"ring {tag} now" and got[7].endswith(tag) and "555.0182" not in got[1]
    assert got[3] is None and got[4] == "" and got[5].removeprefix("— ") == got[6].removeprefix("— ") and "1984-03-02" not in got[8]
    back = {r["doc_id"]: r["text"] for r in I.unmask_details(masked, "doc_id", "text", b"k").collect()}
    assert all(back[i] == t for i, t in rows if i not in (5, 6))
    found = I.detect_details(df, "doc_id", "text", tagger)
    assert found.filter("doc_id = 7").first()["span_start"] == 300_006 and found.count() == 5
    assert I.detect_details(df.limit(0), "doc_id", "text", tagger).count() == 0


def test_whole_table_unmasks(spark, tagger):
    docs = load(spark, SF_DIR, "documents").select("doc_id", "text")
    masked = {r["doc_id"]: r["text"] for r in I.mask_details(docs, "doc_id", "text", tagger, b"k").collect()}
    for r in docs.collect():
        if r["text"]:
            kept = [(k, r["text"][a:b]) for k, a, b in I.find_details(r["text"], tagger, dates=True) if k in ("phone", "id_number", "date")]
            back = I.unmask_text(masked[r["doc_id"]], b"k")
            assert all(v in back for _, v in kept)


def test_tagger_is_fitted_on_every_text(spark):
    """A word that only a few of very many texts use, long texts and late candidates count; the driver gets sums only."""
    names = [f"Maria W{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}ler" for i in range(400)]
    texts = [f"{n} told the desk number {i} that the gate is open." for i, n in enumerate(names)]
    texts += [f"The lamp of Old Harbour {'stands quietly ' * 400}near pier {i}." for i in range(6)]  # over 5,000 characters
    texts += [f"Line {i} is kept here." for i in range(7_000)]
    texts += [f"A zwiebel was sold on day {i}." for i in range(5)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, *texts[:50], "", None])], "doc_id long, text string")
    fitted = N.fit_tagger(df, "doc_id", "text", frozenset({"maria"}))
    assert {"zwiebel", "quietly", "kept"} <= fitted.common
    start = N.Tagger(fitted.forenames, fitted.common, fitted.openers)
    got = [(f, known) for t in texts for _, _, f, known, fit in N.candidates(t, start) if fit]
    whole = N.fit_on([f for f, _ in got], np.array([k for _, k in got], dtype=float), start)
    assert sum(k for _, k in got) == 400
    assert np.abs(whole.weights - fitted.weights).max() < 1e-3 and abs(whole.labelled_mean - fitted.labelled_mean) < 1e-4
