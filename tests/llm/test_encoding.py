import pytest

from stepmill.llm.encoding import find_garbled, restore

FRENCH = "Élève référence déjà vérifiée, le résultat est préféré."
RUSSIAN = "Версия сервера: проверка очереди не прошла, новый запрос."
JAPANESE = "再試行の結果を保存します。データは新しい設定です。"


@pytest.mark.parametrize(
    "text,garble",
    [
        (FRENCH, lambda t: t.encode().decode("latin-1")),
        (FRENCH, lambda t: t.encode().decode("latin-1").encode().decode("latin-1")),
        ("Größe und Länge prüfen", lambda t: t.encode().decode("latin-1").encode().decode("latin-1").encode().decode("latin-1")),
        (FRENCH, lambda t: t.encode().decode("mac_roman")),
        (FRENCH, lambda t: t.encode("mac_roman").decode("latin-1")),
        ("Größe und Länge prüfen", lambda t: t.encode().decode("cp437")),
        ("Größe und Länge prüfen", lambda t: t.encode().decode("cp850")),
        ("Größe und Länge prüfen", lambda t: t.encode().decode("cp1251", "ignore")),
        (RUSSIAN, lambda t: t.encode().decode("latin-1")),
        (RUSSIAN, lambda t: t.encode("cp1251").decode("latin-1")),
        (RUSSIAN, lambda t: t.encode("koi8_r").decode("cp1251")),
        (JAPANESE, lambda t: t.encode("cp932").decode("latin-1")),
        (JAPANESE, lambda t: t.encode("euc_jp").decode("latin-1")),
        (FRENCH, lambda t: "".join(f"&#{ord(c)};" if ord(c) > 127 else c for c in t.encode().decode("latin-1"))),
        (FRENCH, lambda t: "".join(f"\\u{ord(c):04x}" if ord(c) > 127 else c for c in t.encode().decode("latin-1"))),
    ],
)
def test_round_trip(text, garble):
    bad = garble(text)
    assert bad != text
    assert restore(bad)[:2] == (text, True)


@pytest.mark.parametrize("text", [FRENCH, RUSSIAN, JAPANESE, "", "plain", "├── src\n│   └── a.py", "╔═box═╗ ░▒▓ x ▓▒░", "the token `Ã©` is mojibake for `é`", "Ratio 3×4 ≠ 12½ – see § 7.", "It’s “quoted”… 5 ± 1 µs, 10 → 12 €", "a &amp; b &lt;c&gt; &#39;d&#39; 50%20x", "naïve café Ångström piñata façade Übergröße", "Ça coûte où ? À voir.", "x" * 100_000 + " é"])
def test_correct_text_stays(text):
    assert restore(text) == (text, False, False)


SCRIPTS = {
    "latin": "Élève référence déjà vérifiée, le résultat est préféré.",
    "polish": "Zażółć gęślą jaźń, proszę sprawdzić źródło błędu.",
    "turkish": "Değişiklik şu anda çalışmıyor, lütfen günlüğü gözden geçirin.",
    "vietnamese": "Tiếng Việt có nhiều dấu thanh và chữ cái đặc biệt.",
    "russian": RUSSIAN,
    "greek": "Η αλλαγή δεν λειτουργεί και το σφάλμα επιστρέφει πάντα.",
    "hebrew": "השינוי אינו עובד והשגיאה חוזרת תמיד לאותו מקום.",
    "arabic": "التغيير لا يعمل والخطأ يعود دائما إلى نفس المكان.",
    "hindi": "परिवर्तन काम नहीं कर रहा है और त्रुटि हमेशा लौटती है।",
    "thai": "การเปลี่ยนแปลงไม่ทำงานและข้อผิดพลาดกลับมาเสมอ",
    "korean": "변경 사항이 작동하지 않으며 오류가 항상 반환됩니다.",
    "chinese": "更改不起作用，错误总是返回到同一个地方。",
    "japanese": JAPANESE,
}


@pytest.mark.parametrize("read", ["latin-1", "cp1252"])
@pytest.mark.parametrize("script", SCRIPTS)
def test_scripts_read_as_western(script, read):
    text = SCRIPTS[script]
    raw = text.encode()
    # lenient readers give bytes that the encoding lacks as control characters
    bad = "".join(bytes([b]).decode(read) if read == "latin-1" or b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in raw)
    assert restore(bad) == (text, True, False)
    assert restore(text) == (text, False, False)


@pytest.mark.parametrize("script,written", [("russian", "cp1251"), ("russian", "koi8_r"), ("greek", "cp1253"), ("hebrew", "cp1255"), ("arabic", "cp1256"), ("korean", "cp949"), ("chinese", "gb18030"), ("japanese", "cp932"), ("japanese", "euc_jp"), ("thai", "cp874")])
def test_legacy_encodings_read_as_western(script, written):
    text = SCRIPTS[script]
    assert restore(text.encode(written).decode("latin-1")) == (text, True, False)


def test_nothing_is_invented():
    fixed, garbled, lossy = restore("FaÃ§ade Ãlvaro")
    assert fixed.startswith("Façade ") and "í" not in fixed and garbled and lossy


def test_part_of_a_text():
    good = "Une ligne déjà correcte.\n"
    bad = "Une référence".encode().decode("latin-1")
    assert restore(good + bad) == (good + "Une référence", True, False)


def test_lost_characters():
    assert restore("r�f�rence")[1:] == (True, True)
    assert restore("quoted `�` only")[1:] == (False, False)


def test_frame(spark):
    bad = FRENCH.encode().decode("latin-1")
    rows = [(1, bad, "x"), (2, FRENCH, "x"), (3, None, "x"), (4, "", "x"), (1, bad, "x"), (None, bad, "x"), (5, (bad + "\n") * 3000, "x")]
    got = find_garbled(spark.createDataFrame(rows, "doc_id long, text string, restored string")).collect()
    assert sorted((r["doc_id"], r["restored"][: len(FRENCH)]) for r in got) == [(1, FRENCH), (1, FRENCH), (5, FRENCH)]
    assert find_garbled(spark.createDataFrame([], "doc_id long, text string")).count() == 0
