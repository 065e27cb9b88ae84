"""Restoring misread text: round trips, traps, lost bytes, edge cases."""

import pytest

from reelspan.llm.encoding import Model, corpus_model, looks_misread, pieces_of, restored

CLEAN = [
    "Você não devia ter dito isso, a coleção está no porão.", "Hast du den Löffel wirklich in die Küche gestellt? Natürlich weiß er nichts.",
    "Où as-tu caché le gâteau ? Le garçon a cassé la fenêtre près de l'entrée.", "Кто открыл дверь? Завтра Кольм принесёт портрет, пожалуйста.", "昨日、帽子が壊れました。 雨がまだ降っています。",
    "“Oh no,” she said — really…", "Żółta łódź płynie, chodź i weź walizkę.", "¿Quién dejó la canción aquí? Mañana.",
]
NAMES = ["Hey Tiødrezan, come on.", "Hm, Œremiè, wait.", "It is 21 °C outside, 12 µm thick.", "That costs 9 €.", "ÂNGULO ERRADO", "NÃO! ESTAÇÃO DE SÃO BRÁS", "Junia\u00a0laughs", "♪ la la ♪", "СМЕЁТСЯ И САДИТСЯ", "naïve café ½ × £"]


@pytest.fixture(scope="module")
def model(spark):
    return corpus_model(spark.createDataFrame([(t,) for t in CLEAN * 20 + NAMES * 2], "t string"), "t")


@pytest.mark.parametrize("text", CLEAN + NAMES)
def test_what_was_written_so_stays(model, text):
    assert model.restore(text) == (text, 0, 0)


@pytest.mark.parametrize("read", ["cp1252", "latin-1", "mac-roman", "cp437", "cp850"])
@pytest.mark.parametrize("text", CLEAN)
def test_utf8_read_as_a_code_page_comes_back(model, text, read):
    if read == "cp1252":
        wrong = "".join(bytes([b]).decode("cp1252", "replace") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in text.encode())
    else:
        wrong = text.encode().decode(read)
    got, misread, lost = model.restore(wrong)
    assert misread and not lost and got == text


@pytest.mark.parametrize(("written", "read"), [("cp1251", "cp1252"), ("koi8-r", "cp1251"), ("cp1251", "latin-1")])
def test_one_code_page_read_as_another(model, written, read):
    text = "Завтра Кольм принесёт портрет, пожалуйста."
    got, misread, _ = model.restore(text.encode(written).decode(read))
    assert misread and got == text


def test_twice(model):
    text = "Você não devia, coleção"
    wrong = text.encode().decode("latin-1").encode().decode("latin-1")
    assert model.restore(wrong)[0] == text


def test_lost_bytes(model):
    assert model.restore("Hast du den L\ufffdffel in die K\ufffdche gestellt?")[0] == "Hast du den Löffel in die Küche gestellt?"
    assert model.restore("Nat\u00c3\u00bcrlich wei\u00c3\ufffd er nichts.")[0] == "Natürlich weiß er nichts."
    text, misread, lost = model.restore("Hey Za\ufffdosvo, wait")
    assert (misread, lost) == (1, 1) and text == "Hey Za\ufffdosvo, wait"


def test_a_no_break_space_between_words_is_a_blank(spark):
    texts = CLEAN * 20 + ["It says Æ\u00a0& Ø on the crate."] * 4 + ["Can\u00a0you see\u00a0Zoë?", "Il est là, voilà."] * 10
    m = corpus_model(spark.createDataFrame([(t,) for t in texts], "t string"), "t")
    assert m.restore("It says Æ\u00a0& Ø on the crate.")[1] == 0
    assert m.restore("Il est l\u00c3\u00a0, voil\u00c3\u00a0.")[0] == "Il est là, voilà."


def test_a_lost_byte_of_four(spark):
    counts: dict = {"w": {}, "c": {}, "t": {}}
    for t in ("so\U0001f600", "so\U0001f3ac", "é"):
        for k, v in pieces_of(t).items():
            counts[k[0]][k[1:]] = counts[k[0]].get(k[1:], 0) + v
    m = Model(counts["w"], counts["c"], counts["t"])
    lattice = list("so\U0001f600".encode())
    lattice[-2] = -1
    assert m._viterbi(lattice, False) == "so\U0001f600"


def test_nulls_blanks_long_texts_and_clashing_columns(spark):
    rows = [(1, None, "r"), (2, "", "r"), (3, " \n", "r"), (4, "plain", "r"), (5, ("Você não " * 20_000).encode().decode("latin-1"), "r")] + [(6, t, "r") for t in CLEAN]
    got = {r.id: r for r in restored(spark.createDataFrame(rows, "id int, t string, restored string"), "t").collect()}
    assert got[1].restored is None and got[1].misread == 0 and got[2].restored == "" and got[3].restored == " \n" and got[4].restored == "plain"
    assert got[5].misread == 40_000 and got[5].restored == "Você não " * 20_000
    assert restored(spark.createDataFrame([], "id int, t string"), "t").count() == 0


def test_training_leaves_out_what_looks_misread():
    assert looks_misread("nÃ£o") and looks_misread("x\ufffd") and not looks_misread("não") and not looks_misread("Завтра") and not looks_misread("帽子が壊れました。")
    assert not pieces_of("abcж")  # two scripts in one word
    assert Model({}, {}, {}).restore("é")[1] == 0


def test_every_character_that_fits_a_lost_byte_is_tried():
    kana = [bytes([0xE3, 0x81, b]).decode() for b in range(0x81, 0xC0)]
    words = {"".join(kana[i : i + 3]): 2 for i in range(0, 60, 3)} | {"ねこだ": 400}
    chars = {c: 1000 - i for i, c in enumerate(k for k in kana if k != "こ")} | {"こ": 3}
    m = Model(words, chars, {"^h": 500, "hh": 1000, "h$": 500})
    lattice = list("ねこだ".encode())
    lattice[5] = -1
    assert m._viterbi(lattice, False) == "ねこだ"
    lattice[4] = -1
    assert m._viterbi(lattice, False) == "ねこだ"


def test_lattices_are_searched_exactly():
    """The cheapest of all texts on the lattice, by the cost they are ranked with."""
    counts: dict = {"w": {}, "c": {}, "t": {}}
    for t in ("você", "d’água", "l’Été", "été-là", "ÎLE", "Кто", "дверь", "こに", "帽子が", "Löffel", "ΛΌΓΟΣ", "é-é", "É", "—à", "Été", "ß9é"):
        for k, v in pieces_of(t).items():
            counts[k[0]][k[1:]] = counts[k[0]].get(k[1:], 0) + v
    m = Model(counts["w"], counts["c"], counts["t"])
    wide = [c for c in counts["c"] if ord(c) > 127]

    def texts(b: list[int]) -> list[str]:
        if not b:
            return [""]
        if 0 <= b[0] < 128:
            return [chr(b[0]) + r for r in texts(b[1:])]
        fit = [c for c in wide if len(c.encode()) <= len(b) and all(x in (-1, y) for x, y in zip(b, c.encode()))]
        return [c + r for c in fit for r in texts(b[len(c.encode()) :])]

    for t in ("d’água-é", "l’Été", "ÎLE", "Кто", "こに", "Löffel—é", "ΛΌΓ", "été-là"):
        b = list(t.encode())
        high = [i for i, x in enumerate(b) if x > 127]
        for lost in (high[:1], high[1:2], high[:2], high[-2:]):
            lattice = [-1 if i in lost else x for i, x in enumerate(b)]
            assert m._cost(m._viterbi(lattice, False)) == pytest.approx(min(map(m._cost, texts(lattice)))), (t, lost)


def test_words_too_rare_for_the_broadcast_are_known_all_the_same(spark):
    damaged = ["Hast du den L\ufffdffel?", "Nat\u00c3\ufffdrlich", "\ufffd\ufffd\ufffd\ufffd\ufffd\ufffd", "z K\ufffdche", "при\ufffd\ufffdсёт", *["Завтра портрет".encode("cp1251").decode("cp1252"), "帽子が".encode().decode("latin-1")]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(CLEAN * 3 + NAMES + damaged)], "id int, t string")
    whole, thin = corpus_model(df, "t"), corpus_model(df, "t", 0.04)
    assert whole.rare is None and thin.rare and len(thin.words) < len(whole.words)
    assert thin.n_words == whole.n_words and all(thin.count(w) == n for w, n in whole.words.items()) and thin.count("zzz") is None
    assert {p: thin.after(p) for p in ("", "l", "по", "帽", "zz")} == {p: whole.after(p) for p in ("", "l", "по", "帽", "zz")}
    want = sorted(map(tuple, restored(df, "t").collect()))
    assert sorted(map(tuple, restored(df, "t", 0.04).collect())) == want
    assert next(r for r in want if r[1] == damaged[0])[2] == "Hast du den Löffel?"


def test_sorted_tables_of_many_blocks(spark):
    from reelspan.llm.wordlist import sorted_table

    words = sorted({a + b + c for a in "aéжこ\U0001f600" for b in "bz￮" for c in ("", "q", "я")})
    t = sorted_table(spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, n int").repartition(5), "word", 2)
    assert len(t.blocks) > 10 and all(t.row(w) == (i,) for i, w in enumerate(words)) and t.row("") is None and t.row("ab0") is None and t.row("\U0010ffff") is None
    for key in ("", "ab", "abq\0", "é", "жz\U0010ffff", "\U0001f600z0"):
        assert t.next_key(key) == next((w for w in words if w >= key), None), key
    assert t.next_key("\U0010ffff") is None and sorted_table(spark.createDataFrame([], "word string, n int"), "word").next_key("") is None
