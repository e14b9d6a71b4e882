from pyspark.sql import functions as F

from lexloom.llm import langid

TEXTS = {
    "en": "The mean of heat loss rose by two percent after the second round, and it was measured at ten sites.",
    "de": "Der Mittelwert der Größe stieg nach der zweiten Runde, und wir haben ihn an zehn Orten gemessen.",
    "fr": "La moyenne de la variable a augmenté après le second tour, et nous l'avons mesurée sur dix sites.",
    "es": "La media de la variable subió tras la segunda ronda, y la medimos en diez lugares con el mismo equipo.",
    "ru": "Среднее показателя выросло после второго тура, и мы измерили его в десяти местах.",
    "zh": "第二轮之后，热损失的均值上升了，我们在十个地点进行了测量。",
    "ja": "第二回のあと、熱の損失の平均は上昇し、私たちは十か所で測定した。",
    "th": "ค่าเฉลี่ยของการสูญเสียความร้อนเพิ่มขึ้นหลังรอบที่สอง และเราวัดในสิบแห่ง",
}


def prototypes():
    return langid.build_prototypes({k: [v] for k, v in TEXTS.items()})


def test_held_out_sentences(spark):
    held_out = {
        "en": "Participants were told nothing about the control group of this trial.", "de": "Die Teilnehmenden erfuhren nichts über das Thema der Studie und der Gruppe.",
        "fr": "Les participants n'ont rien su du thème de la recherche dans les groupes.", "es": "A los participantes no se les dijo nada sobre el tema de la investigación.",
        "ru": "Участникам ничего не сказали о теме исследования.", "zh": "参与者没有被告知任何有关对照组的信息。", "ja": "参加者には対照群について何も知らせなかった。", "th": "ผู้เข้าร่วมไม่ได้รับแจ้งเรื่องกลุ่มควบคุม",
    }
    df = spark.createDataFrame(list(held_out.items()), "k string, text string")
    got = {r.k: r for r in langid.identify(df, prototypes(), ("k",)).collect()}
    assert all(got[k].lang_code == k and 0 < got[k].confidence <= 1 for k in held_out)


def test_no_letters(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " 12 %\n"), (4, "🧪🧪")], "k int, text string")
    assert all(r.lang_code is None and r.confidence == 0 for r in langid.identify(df, prototypes(), ("k",)).collect())
    assert langid.identify(df.limit(0), prototypes(), ("k",)).count() == 0


def test_profiles_are_nearly_orthogonal():
    import numpy as np

    maker = langid.Profiles(np.zeros((1, langid.DIMENSIONS)))
    keys, _ = langid.grams_of(["abcdefghij klmnop"])
    v = maker.vectors(np.unique(keys)).astype(int)
    gram = v @ v.T / langid.DIMENSIONS
    assert (np.diag(gram) == 1).all() and abs(gram - np.eye(len(v))).max() < 0.15


def test_permutation_tells_order():
    import numpy as np

    maker = langid.Profiles(np.zeros((1, langid.DIMENSIONS)))
    (a,), (b,) = (np.unique([k for k, w in zip(*map(list, langid.grams_of([t])))])[:1] for t in ("abc", "cba"))
    assert abs((maker.vectors(np.array([a]))[0].astype(int) @ maker.vectors(np.array([b]))[0].astype(int))) < 0.15 * langid.DIMENSIONS


def test_declared_codes(spark):
    spellings = {"英文": "en", "en-US": "en", " EN ": "en", "français": "fr", "日文": "ja", "zho": "zh", "其他": "other", "und": None, "N/A": None, "": None, "未知": None, "de_DE": "de"}
    df = spark.createDataFrame(list(spellings.items()), "s string, c string").select("s", "c", langid.declared_code(F.col("s")).alias("got"))
    assert all(r.c == r.got for r in df.collect())


def test_wrong_labels_and_blocks(spark):
    docs = spark.createDataFrame([(1, "英文", TEXTS["en"]), (2, None, TEXTS["de"]), (3, "其他", TEXTS["fr"]), (4, "其他", TEXTS["zh"]), (5, "fr", TEXTS["es"]), (6, "-", " ")], "doc_id bigint, language string, text string")
    got = {(r.doc_id, r.lang_code) for r in langid.wrong_labels(docs, prototypes(), {}).collect()}
    assert got == {(2, "de"), (4, "zh"), (5, "es")}
    content = "\n\n".join(["# Title", TEXTS["en"], TEXTS["en"], TEXTS["ja"], "```\ncode der die das\n```", "| der | die |", TEXTS["en"]])
    parsed = spark.createDataFrame([(1, content), (2, None), (3, ""), (4, TEXTS["en"])], "doc_id bigint, content string")
    assert [(r.doc_id, r.block_no, r.lang_code) for r in langid.foreign_blocks(parsed, prototypes()).collect()] == [(1, 4, "ja")]
