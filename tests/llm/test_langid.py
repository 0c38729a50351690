from pathlib import Path

import pandas as pd
import pytest

from tracewright.llm import langid

DATA = Path("/root/testdata/sf0.01")
LANGS = [("en", "English"), ("zh", "Chinese"), ("de", "German"), ("fr", "French"), ("es", "Spanish"), ("pt", "Portuguese"), ("it", "Italian"), ("nl", "Dutch"), ("ru", "Russian"), ("uk", "Ukrainian"), ("ja", "Japanese"), ("ko", "Korean")]


@pytest.fixture(scope="module")
def model(spark):
    return langid.fit(langid.training_rows(spark.read.parquet(str(DATA / "documents.parquet")), LANGS))


def test_labels(spark):
    df = spark.createDataFrame([("EN",), ("zh_Hans",), ("pt-BR",), ("Chinese",), ("german",), ("deu",), ("",), (" ",), ("und",), ("xx",), ("n/a",), (None,), ("en_GB.UTF-8",)], "l string")
    got = [r[0] for r in df.select(langid.label_code(df["l"], LANGS)).collect()]
    assert got == ["en", "zh", "pt", "zh", "de", "de", None, None, None, None, None, None, "en"]


def test_held_out_documents(model):
    # Documents of another size of the test data, with a plain label; a tenth of the labels is wrong by design.
    d = pd.read_parquet(DATA.parent / "sf0.001" / "documents.parquet")
    codes = {c for c, _ in LANGS}
    d = d[d.lang.isin(codes) & (d.text.fillna("").str.len() > 60)]
    got = [[x[2] for x in model.document(t)] for t in d.text]
    judged = [(c, g) for c, g in zip(d.lang, got, strict=True) if g]
    assert len(judged) > 40 and sum(c in g for c, g in judged) >= 0.8 * len(judged)


def test_sentences(model):
    for lang, s in (
        ("en", "The server says that it is missing although it is installed."), ("de", "Der Server behauptet, dass es fehlt, obwohl es installiert ist."), ("fr", "Le serveur prétend que ce mod est absent alors qu'il est bien installé."),
        ("es", "El servidor dice que falta aunque está instalado."), ("pt", "O servidor diz que falta, embora ele esteja instalado."), ("it", "Il server dice che manca anche se è installata."), ("nl", "De server zegt dat het ontbreekt terwijl het wel geïnstalleerd is."),
        ("ru", "Сервер пишет, что не хватает мода, хотя он установлен."), ("uk", "Сервер пише, що бракує мода, хоча його встановлено."), ("zh", "服务器说缺少模组,可是明明已经装好了。"), ("ja", "サーバーに入れてあるのにないと言われます。"), ("ko", "설치했는데도 없다고 나옵니다."),
        ("en", "THE WORLD NEVER FINISHES SAVING ON THE SERVER."), ("ru", "Zhurnal zabit odnim i tem zhe preduprezhdeniem na servere."),
    ):
        assert model.sentence(s)[0] == lang, s


def test_signs_and_names_of_other_scripts_decide_nothing(model):
    for lang, s in (
        ("en", "🚀 launched the base 🇺🇳 and it worked every time I open the inventory."), ("de", "\ufeffDer Server behauptet, dass es fehlt, obwohl es installiert ist."), ("fr", "Le serveur prétend que 小明 est absent alors qu'il est bien installé."),
        ("ru", "Сервер пишет, что не хватает мода 🙂, хотя он установлен."), ("en", "ＦＵＬＬ ＷＩＤＴＨ Going back to the old version made things worse!"), (None, "𝕸𝖔𝖉 𝖒𝖊𝖓𝖚 ①②③"), (None, "🚀 🇺🇳 小明"), ("zh", "服务器说缺少 🙂 模组"),
    ):
        assert model.sentence(s)[0] == lang, s


def test_stretches_and_what_has_no_language(model):
    t = "The world never finishes saving. Mobs stand still until somebody relogs.\n[10:00:00] [main/INFO]: Loaded 5 recipes\n  expected 19 but found 57\n```\ncode here is not text\n```\nLe monde ne finit jamais de se sauvegarder. La mémoire dépasse la limite en quelques minutes."
    got = model.document(t)
    assert [x[2] for x in got] == ["en", "fr"] and t[got[1][0] : got[1][1]].startswith("Le monde") and all(0 < x[3] <= 1 for x in got)
    for x in ("", "   ", "d8f681dbae3099e0bc9b", "[10:00:00] [main/INFO]: Loaded 5 recipes", "## Title", "@neon_yak4 (1):", "\tat a.b.C.d(C.java:1)"):
        assert model.document(x) == []


def test_operator_edges(spark, model):
    df = spark.createDataFrame([(1, None, "en", 3), (2, "", None, 3), (3, "Der Server behauptet, dass es fehlt. " * 3000, "xx", 3), (4, "Hi", "en", 3)], "doc_id long, text string, lang string, langs int")
    ll = spark.createDataFrame(LANGS, "lang_code string, lang_name string")
    out = {r.doc_id: r for r in langid.identify(df, ll, model).collect()}
    assert [list(out[i].langs) for i in (1, 2, 3, 4)] == [[], [], ["de"], []] and out[3].code is None and out[3].segments[0].confidence > 0.5
    assert langid.identify(df.limit(0), ll, model).count() == 0


def test_emoji_and_wide_signs_decide_nothing(model):
    for lang, s in (
        ("en", "The server crashes every time I join the world please help me fix this 🎮"), ("de", "Der Server stürzt jedes Mal ab, wenn ich der Welt beitrete 😀"), ("ru", "Сервер падает каждый раз, когда я захожу в мир 🙂"), ("es", "El servidor se cierra cada vez que entro al mundo （1.20）"),
    ):
        assert model.sentence(s)[0] == lang, s


def test_a_language_is_found_by_its_documents_alone():
    """Languages and scripts come from the labelled rows: one that no table of the module names is found."""
    rows = [("el", "Ο διακομιστής δεν ανοίγει όταν μπαίνω στον κόσμο. Το παιχνίδι κλείνει κάθε φορά που φορτώνει ο χάρτης. Δεν ξέρω τι να κάνω με αυτό το πρόβλημα."), ("en", "The server does not open when I join the world. The game closes every time the map loads. I do not know what to do with this problem."), ("sv", "Servern öppnas inte när jag går in i världen. Spelet stängs varje gång kartan laddas. Jag vet inte vad jag ska göra med detta problem.")]
    m = langid.fit(rows * 3)
    for lang, s in (("el", "Το παιχνίδι δεν φορτώνει τον χάρτη όταν μπαίνω."), ("sv", "Spelet laddas inte när jag öppnar kartan."), ("en", "The game does not load the map when I open it.")):
        assert m.sentence(s)[0] == lang, s


def test_ranks_of_the_text_count():
    p = langid.Profiles([("a", langid.Counter({"x": 9, "y": 5, "z": 1})), ("b", langid.Counter({"z": 9, "y": 5, "x": 1}))])
    p.words = {"w1": [p.ids["x"]] * 3 + [p.ids["y"]] * 2 + [p.ids["z"]], "w2": [p.ids["z"]] * 3 + [p.ids["y"]] * 2 + [p.ids["x"]]}
    assert p.distances(["w1"]).tolist() == pytest.approx([0.0, 4 / 3 / langid.PROFILE]) and p.distances(["w2"]).tolist() == pytest.approx([4 / 3 / langid.PROFILE, 0.0])
