from cairn.llm.personal import FAILS, HOLDS, Names, checked, find_personal, findings, iban, luhn, mask_personal, masked, nir, snils

NAMES = Names.of(["Calder Venmoor", "Radomil Brackley-Voss", "Калдер Венмур", None, "single"])


def found(text):
    return [(k, text[a:b]) for a, b, k in findings(text, NAMES)]


def test_kinds():
    for text, wanted in {
        "Write to A.B+c@box7.example.net, please.": ("email", "A.B+c@box7.example.net"),
        "Write to ab (at) box7.example.net today": ("email", "ab (at) box7.example.net"),
        "Write to ab [at] box7 [dot] example [dot] net today": ("email", "ab [at] box7 [dot] example [dot] net"),
        "Call +44 20 7946 0150 now": ("phone", "+44 20 7946 0150"),
        "Call (202) 555-0127.": ("phone", "(202) 555-0127"),
        "Звонить по номеру 8 000 555 33 38 при сбое": ("phone", "8 000 555 33 38"),
        "Bei Störung 030/23125168 anrufen": ("phone", "030/23125168"),
        "Identity number QQ 27 43 94 C was": ("id_number", "QQ 27 43 94 C"),
        "Документ № 0000 848468 приложен": ("id_number", "№ 0000 848468"),
        "номер 000-459-130 65 без": ("id_number", "000-459-130 65"),
        "Le numéro 0 00 14 99 435 859 14 figure": ("id_number", "0 00 14 99 435 859 14"),
        "We meet at Flat 9, 155 Tillerman Street instead": ("address", "Flat 9, 155 Tillerman Street"),
        "an Alter Mühlpfad 145, 06006 Birkenrode bis Freitag": ("address", "Alter Mühlpfad 145, 06006 Birkenrode"),
        "au 213 bis, impasse du Vieux-Lavoir avant": ("address", "213 bis, impasse du Vieux-Lavoir"),
        "para Rua dos Amieirais, 196, 66.º Esq. antes": ("address", "Rua dos Amieirais, 196, 66.º Esq."),
        "адресу ул. Тихвоярская, д. 60, кв. 91 до": ("address", "ул. Тихвоярская, д. 60, кв. 91"),
        "пров. Верхньоозерський, 204 у вівторок": ("address", "пров. Верхньоозерський, 204"),
        "Ask Dr. Calder R. Brackley-Voss for it": ("person", "Calder R. Brackley-Voss"),
        "Mit Venmoor, Radomil wurde": ("person", "Venmoor, Radomil"),
        "заметил К. Венмур вчера": ("person", "К. Венмур"),
    }.items():
        assert found(text) == [wanted], text


def test_what_is_none():
    for text in ("Build 10.4.71575 fixed it", "Ticket ZEL-79104 stays", "Order 4883756-77 was closed", "Commit 48907502 is on hold", "goal/2026-01-01/1770821241000000035", "@velutis stays", "reports 86330 changes", "Harbor Release 561", "", None):
        assert findings(text, NAMES) == [], text


def test_masks_keep_the_rest():
    assert masked("Call +44 20 7946 0150 or a@b.test.", NAMES) == "Call [PHONE] or [EMAIL]."
    assert masked(None, NAMES) is None and masked("", NAMES) == ""


def test_checksums():
    assert luhn("4539578763621486") and not luhn("4539578763621487")
    assert iban("GB82 WEST 1234 5698 7654 32") and not iban("GB82 WEST 1234 5698 7654 33")
    assert nir("255081416802538") and not nir("255081416802539")
    assert snils("11223344595") and not snils("11223344596")
    assert [checked(x) for x in ("12345678Z", "00416290X", "QQ 27 43 94 C", "11223344595", "11223344596")] == [HOLDS, FAILS, 0.0, HOLDS, 0.0]


def test_checksums_decide_where_no_word_does():
    for good, bad in (("GB82 WEST 1234 5698 7654 32", "GB82 WEST 1234 5698 7654 33"), ("12345678Z", "12345678X"), ("4539 5787 6362 1486", "4539 5787 6362 1487"), ("112-233-445 95", "112-233-445 96")):
        assert found(f"It says {good} there") == [("id_number", good)]
        assert found(f"It says {bad} there") == []
        assert found(f"Passport {bad} there") == [("id_number", bad)]  # a word nearby outweighs a checksum that fails


def test_words_nearby_decide():
    assert found("Call 020 7946 0150 now") == [("phone", "020 7946 0150")] and found("It is 020 7946 0150 here") == []
    assert found("It is 48907502 here") == [] and found("passport 48907502 here") == [("id_number", "48907502")]
    assert found("passport, order no. 48907502") == []
    assert found("Ask C. Venmoor about it") == [("person", "C. Venmoor")] and found("see Appendix C. Venmoor") == []
    assert found("see Appendix Calder Venmoor") == [("person", "Calder Venmoor")]
    assert found("sent to 155 Tillerman Street today") == [("address", "155 Tillerman Street")] and found("in version 155 Tillerman Street") == []


def test_a_book_of_any_size_gives_the_same(spark):
    rows = [("m", i, t) for i, t in enumerate(["Ask Dr. Calder R. Brackley-Voss for it", "Mit Venmoor, Radomil wurde", "заметил К. Венмур вчера", "nobody here", "", None, "Call +44 20 7946 0150 or C. Venmoor", "single Calder"])]
    texts = spark.createDataFrame([*rows, rows[0]], "src string, row_id bigint, text string")
    people = spark.createDataFrame([(n,) for n in ["Calder Venmoor", "Radomil Brackley-Voss", "Калдер Венмур", None, "single"]], "full_name string")
    for operator in (find_personal, mask_personal):
        few, many = (sorted((tuple(r) for r in operator(texts, people, most_names=k).collect()), key=repr) for k in (100, 1))
        assert few == many and len(few) > 4


def test_tables(spark):
    rows = [("m", 1, "Call +44 20 7946 0150, +44 20 7946 0150"), ("m", 2, None), ("m", 3, ""), ("g", 1, "x " * 100_000 + "a@b.test"), ("g", 1, "a@b.test")]
    texts = spark.createDataFrame([(*r, "clash") for r in rows], "src string, row_id bigint, text string, kind string")
    people = spark.createDataFrame([("Calder Venmoor", 1), (None, 2)], "full_name string, row_id int")
    got = sorted(tuple(r) for r in find_personal(texts, people).collect())
    assert got == [("g", 1, "email", "a@b.test"), ("g", 1, "email", "a@b.test"), ("m", 1, "phone", "+44 20 7946 0150")]
    assert mask_personal(texts, people).count() == 5
    assert find_personal(texts.limit(0), people.limit(0)).count() == 0
