import pytest
from pyspark.sql import functions as F

from culvert.llm import garbled as G
from tests.tables import make, rows

TEXTS = {
    "fr": "L’écart relevé près de la rue dépasse la tolérance prévue – à vérifier.", "es": "¿Podría confirmar si la válvula del año próximo se sustituirá?", "de": "Die Maße am Übergang wurden für die Straße überprüft; Höhe fehlt.",
    "pl": "Zasypkę należy zagęścić do 95 % i odebrać przed położeniem nawierzchni.", "ru": "Просим проверить, действует ли узел 3180, указанный на листе.", "ja": "縦断図の管底高が平面図と一致しないため、再提出をお願いします。", "en": "Joints of the Ø36″ HDPE — about 30½ per block, ±2° at 4 ft².",
}


#: Pairs of Cyrillic encodings that change too few letters of a text to be found in it.
NOT_FOUND = {("mac_cyrillic", "cp1251")}
#: Found, but spans that look like Japanese are taken for that.
NOT_RESTORED = {("cp866", "cp1251")}


def wrongly(text, right, wrong):
    table = G.byte_table(wrong)
    return "".join(table[b] for b in text.encode(right))


@pytest.mark.parametrize("wrong", ["cp1252", "latin_1", "mac_roman", "cp437", "cp850", "cp1251"])
@pytest.mark.parametrize("lang", list(TEXTS))
def test_utf8_round_trip(lang, wrong):
    bad = wrongly(TEXTS[lang], "utf-8", wrong)
    hit, restored, faults = G.restore(bad)
    assert hit and restored == TEXTS[lang], faults


@pytest.mark.parametrize("lang", ["fr", "es", "de", "pl", "en"])
def test_twice(lang):
    bad = wrongly(wrongly(TEXTS[lang], "utf-8", "cp1252"), "utf-8", "cp1252")
    assert G.restore(bad)[:2] == (True, TEXTS[lang])


@pytest.mark.parametrize(
    ("text", "right", "wrong"),
    [(TEXTS["ru"], "cp1251", "cp1252"), (TEXTS["ru"], "koi8_r", "cp1251"), ("Studzienka ma rzędną pokrywy, została ułożona; gdyż leży.", "cp1250", "cp1252"), (TEXTS["ja"], "cp932", "cp1252"), ("It’s the reviewer’s view — please revise", "cp1252", "latin_1"), ("estación está", "cp1252", "cp1251"), ("an area of 52 ft².", "cp1252", "cp1251")],
)
def test_other_pairs(text, right, wrong):
    assert G.restore(wrongly(text, right, wrong))[:2] == (True, text)


@pytest.mark.parametrize(
    "text",
    [*TEXTS.values(), "Note ¶ 3 still says Â-line for the east alignment.", "The plate says CHÂTELÂIN Nº 4, cast in raised letters.", "Label on the lid reads “SÃO BRÁS”, so keep it.", "─── (E) curb, │ = match line, Δ = revision, √ = checked", "REVISÃO 4: SEÇÃO CORRIGIDA", "4.7 kΩ; § 12.3", "\xa0", "naïve café 👍", "ОТДЕЛ «СССР», США…", "├──┤", "créées à Noël", "ООО «ВодоКАНАЛ»", 'Труба 12" Ч 4', "СШ-1 Ч 5", "Узел «Насос», отм. 12° и №4 – см. лист…", "ГОСТ 8732—78 и ТУ, ООО «ПроектСТРОЙ»"],
)
def test_correct_text_is_left_alone(text):
    assert G.restore(text) == (False, text, [])


@pytest.mark.parametrize("times", [3, 5, 6])
def test_many_times(times):
    bad = "L’été “x”"
    for _ in range(times):
        bad = wrongly(bad, "utf-8", "cp1252")
    assert G.restore(bad)[:2] == (True, "L’été “x”")


LONG = "Просим проверить отметки верха и уклон самотечной линии на листе; колодец показан неверно, расстояние между ними не указано."


@pytest.mark.parametrize(("right", "wrong"), [(r, w) for r in G.CYRILLIC for w in G.CYRILLIC if r != w])
def test_cyrillic_pairs(right, wrong):
    """Found for every pair; restored as well but for lone letters and the pairs listed."""
    hit, restored, _ = G.restore(wrongly(LONG, right, wrong))
    if (right, wrong) in NOT_FOUND:
        assert not hit
        return
    assert hit
    if (right, wrong) in NOT_RESTORED:
        return
    words = LONG.split()
    same = sum(a == b for a, b in zip(restored.split(), words)) / len(words)
    assert same >= 0.8, restored


def test_only_the_damaged_span_changes():
    mixed = "L’écart est noté. " + wrongly("La pente passe à 2 % – voir détail", "utf-8", "cp1252") + " “fin”"
    assert G.restore(mixed)[1] == "L’écart est noté. La pente passe à 2 % – voir détail “fin”"


def test_rows(spark):
    texts = [None, "", "plain", TEXTS["fr"], wrongly(TEXTS["fr"], "utf-8", "cp1252"), "lost � here", "x" * 100_000 + "Ã©", "x\x92s"]
    docs = make(spark, "documents", [{"doc_id": i, "text": t} for i, t in enumerate(texts)] + [{"doc_id": 9, "text": texts[4]}]).withColumn("restored", F.lit(1)).withColumn("faults", F.lit(1))
    got = rows(G.repair(docs), "doc_id", "complete")
    assert got == [(4, True), (5, False), (6, True), (7, True), (9, True)]
    assert G.repair(docs.limit(0)).count() == 0
