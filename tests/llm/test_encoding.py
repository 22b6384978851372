import pytest
from conftest import rows

from moraine.llm import encoding as E

TEXTS = [
    "Für einen Ölfilter braucht man 4 Tage, manchmal auch länger.",
    "La compañía cambió el plátano por un avión de 24 piezas. ¿Cómo elegir? ¡Qué fácil!",
    "À noite, é preciso guardar o coração e o avião. NÃO HÁ OPÇÃO melhor.",
    "Grâce à la crème, l’idée paraît âgée — “très régulière” … 5 €.",
    "Вчера огород был новый, а сегодня уже лёгкий. Её словарь стоит около 20 рублей.",
]


@pytest.mark.parametrize("text", TEXTS)
def test_sound_text_is_left_alone(text):
    assert E.repair(text) == (text, False, True)
    assert E.repair(text.upper())[1] is False


@pytest.mark.parametrize("text", TEXTS[:4])
@pytest.mark.parametrize("enc", ["latin-1", "cp437", "mac_roman", "cp1251"])
def test_round_trip(text, enc):
    try:
        bad = text.encode().decode(enc)
    except UnicodeDecodeError:
        pytest.skip("not every byte has a character there")
    assert E.repair(bad) == (text, True, True)


@pytest.mark.parametrize("text", TEXTS[:4])
def test_nested_and_partial(text):
    bad = text.encode().decode("latin-1")
    assert E.repair(bad.encode().decode("latin-1"))[0] == text
    assert E.repair(text + "\n" + bad) == (text + "\n" + text, True, True)


def test_cp1252_with_gaps():
    assert E.repair("donâ€™t  CafÃ© Â· 10 Â°C")[0] == "don’t  Café · 10 °C"
    assert E.repair("Ãƒâ‚¬ noite")[0] == "À noite"


@pytest.mark.parametrize("wrote,read", [("koi8-r", "cp1251"), ("cp1251", "cp1252"), ("cp866", "cp1251")])
def test_cyrillic_read_as_another(wrote, read):
    text = "Вчера огород был новый, а сегодня уже тихий. Жители часто вспоминают старый берег."
    try:
        bad = text.encode(wrote).decode(read)
    except UnicodeDecodeError:
        pytest.skip("not every byte has a character there")
    assert E.repair(bad)[:2] == (text, True)
    utf = text.encode().decode("latin-1")
    assert E.repair(utf)[0] == text


def test_quoted_garbling_is_no_case():
    for s in ("If “Ã©” or “â€™” shows up instead of an accent, the file was saved wrongly.", "The mark “�” stands for lost bytes."):
        assert E.repair(s)[1] is False


def test_lost_bytes():
    assert E.repair("Se�ora V�lmora") == ("Se�ora V�lmora", True, False)


SCRIPTS = [
    "今天天气很好，我们去公园散步吧。",
    "今日はとても良い天気ですね。散歩に行きましょう。",
    "Η γρήγορη αλεπού πηδά πάνω από το σκυλί.",
    "השועל החום המהיר קופץ מעל הכלב של העצלן",
    "Tiếng Việt có nhiều dấu thanh, rất đẹp và ưa nhìn.",
    "Hello 😀 world",
    "สวัสดีชาวโลก วันนี้อากาศดี",
    "यह एक अच्छा दिन है और मौसम सुहावना है",
    "안녕하세요 세계",
    "السلام عليكم ورحمة الله",
    "ქართული ენა მდიდარია",
    "α-particles and β decay",
]


@pytest.mark.parametrize("text", SCRIPTS)
@pytest.mark.parametrize("enc", ["cp1252", "latin-1"])
def test_any_script(text, enc):
    assert E.repair(text) == (text, False, True)
    bad = "".join(bytes([b]).decode(enc, "ignore") or chr(b) for b in text.encode())
    assert E.repair(bad) == (text, True, True)
    assert E.repair("Sound before\n" + bad + "\nand after")[0] == "Sound before\n" + text + "\nand after"


@pytest.mark.parametrize("text", ["café\xa0» dit-il", "«\xa0voilà\xa0»", "der Buchstabe ‚Ä‘", "Ü– und É…", "Größe: 5×”", "Fuß“", "à\xa0»", "ça… É–t", "naïveté\xa0!", "“Ñ” is a letter", "Ø–Å", "São “João”… à…"])
def test_sound_marks_beside_letters_are_left_alone(text):
    assert E.repair(text) == (text, False, True)


def test_long_damaged_runs_and_short_cyrillic_lines():
    text = "字" * 5000
    assert E.repair(text.encode().decode("latin-1") + "é")[0] == text + "é"
    long, short = "Вчера огород был новый, а сегодня уже тихий.", "Она"
    bad = [t.encode("koi8-r").decode("cp1251") for t in (long, short)]
    assert E.repair("\n".join(bad))[0] == long + "\n" + short


def test_operator(spark):
    bad = "FÃ¼r Ã–l"
    data = [("a", None, bad), ("a", None, bad), ("b", bad, ""), ("c", "plain", "x" * 300_000), ("d", "Für", None), (None, bad, None)]
    df = spark.createDataFrame([(*r, 1, "f") for r in data], "docid string, title string, body string, id int, field string")
    got = rows(E.garbled(df, "docid", ["title", "body"]).where("docid IS NOT NULL").distinct())
    assert got == [("a", "body", True, "Für Öl"), ("b", "title", True, "Für Öl")]
    assert rows(E.garbled(df.limit(0), "docid", ["title", "body"], with_text=False)) == []
