import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm.prose import LANGUAGES, SAMPLES, zipf_profiles
from marlstone.llm.structure import _NUMBERS, NAMES, PROSE, STATISTICS, divergence, languages, shape, statistics, structure

PROSE_TEXTS = [
    "The server was restarted before lunch because it had run out of memory. Nobody noticed until the next day, when most of the builds failed.",
    "Der Dienst wurde gestern neu gestartet, weil der Speicher voll war. Niemand hat es bemerkt, bis am nächsten Tag die meisten Läufe scheiterten.",
    "Le service a été relancé hier parce que le disque était plein. Personne ne l'a remarqué avant que les tâches échouent dans la nuit.",
    "El servicio se reinició ayer porque el disco estaba lleno. Nadie lo notó hasta que las tareas fallaron durante la noche.",
    "> it was late and nobody\n> wanted to look at the logs again so we\n> left them for the morning",
    "We had to wait.",
    "THE SERVER WAS RESTARTED BEFORE LUNCH BECAUSE IT HAD RUN OUT OF MEMORY.",
]
OTHER_TEXTS = [
    "- red apple\n- green pear\n- ripe plum\n- fresh bread", "1. open file\n2. read line\n3. close file\n4. print total", "a\t12\t90\nb\t7\t13\nc\t99\t2044\nd\t4\t1",
    "2025-03-18T05:40:17Z DEBUG registry[4341]: blocked bucket=/srv/x code=73\n2025-04-03T00:34:43Z ERROR node[94]: counted router=y code=4",
    "def f(x):\n    return x+1\nfor (i=0;i<n;i++) { a[i]=b[i]; }\nx = f(y) - g(z);", "dGhpcyBpcyBub3QgcHJvc2UgYXQgYWxsIGJ1dCBlbmNvZGVkIGRhdGE5OTgx\nc29tZSBtb3JlIG9mIGl0IGZvciBnb29kIG1lYXN1cmUgMTIzNDU2Nzg5MA==",
    "apples pears plums bread butter cheese milk eggs flour sugar salt pepper", "qwrtz plkjh gfdsx mnbvc ytrwq lkjhg zxcvb. pqrst hjklm? wxrtz bnmgh", "Click here now.\n" * 30, "Nobody wanted to look at the logs again. " * 12,
]


def prose(text):
    shares, _ = shape([text])
    return shares[0, : len(PROSE)].sum()


@pytest.mark.parametrize("text", PROSE_TEXTS)
def test_prose(text):
    assert prose(text) > 0.5


@pytest.mark.parametrize("text", OTHER_TEXTS)
def test_other(text):
    assert prose(text) < 0.5


MORE_LANGUAGES = {
    "it": "Il server è stato riavviato stamattina perché la memoria era finita. Nessuno se ne è accorto fino a sera.",
    "pt": "O servidor foi reiniciado de manhã porque a memória tinha acabado. Ninguém percebeu isso até à noite.",
    "nl": "De server werd vanochtend opnieuw gestart omdat het geheugen vol was. Niemand merkte het tot de avond.",
    "pl": "Serwer został rano ponownie uruchomiony, ponieważ skończyła się pamięć. Nikt tego nie zauważył aż do wieczora.",
    "ru": "Сервер был перезапущен утром, потому что закончилась память. Никто этого не заметил до вечера.",
    "el": "Ο διακομιστής επανεκκινήθηκε το πρωί επειδή τελείωσε η μνήμη. Κανείς δεν το πρόσεξε μέχρι το βράδυ.",
    "vi": "Máy chủ đã được khởi động lại vào sáng nay vì hết bộ nhớ. Không ai nhận ra điều đó cho đến buổi tối.",
    "zh": "服务器今天早上重新启动了，因为内存已经用完。直到晚上才有人注意到这件事。",
}
OTHER_LANGUAGES = [
    "Server byl ráno znovu spuštěn, protože došla paměť. Nikdo si toho až do večera nevšiml.", "Palvelin käynnistettiin aamulla uudelleen, koska muisti loppui. Kukaan ei huomannut sitä.",
    "أعيد تشغيل الخادم هذا الصباح لأن الذاكرة امتلأت. لم يلاحظ أحد ذلك حتى المساء.", "サーバーは今朝再起動されました。メモリが足りなくなったからです。", "सर्वर को आज सुबह फिर से चालू किया गया। शाम तक किसी ने ध्यान नहीं दिया।",
]


@pytest.mark.parametrize("language", sorted(MORE_LANGUAGES))
def test_languages_with_a_profile(language):
    shares, _ = shape([MORE_LANGUAGES[language]])
    assert NAMES[shares[0].argmax()] == f"prose {language}"
    assert shares[0].max() == 1


@pytest.mark.parametrize("text", OTHER_LANGUAGES)
def test_languages_without_a_profile(text):
    shares, _ = shape([text])
    assert NAMES[shares[0].argmax()] == "prose other"


def test_scripts_alone_make_no_prose():
    for text in ("память\nсервер\nвечер\nутро\nархив\nсписок", "Ð¿Ð°Ð¼Ñ\x8fÑ‚ÑŒ Ñ\x81ÐµÑ€Ð²ÐµÑ€ Ð±Ñ‹Ð» Ð²Ñ‹ÐºÐ»ÑŽÑ‡ÐµÐ½", "- яблоко\n- груша\n- слива\n- хлеб", "memоry sеrver wаs rеstаrted tоdаy", "内存 服务器 列表 档案"):
        assert prose(text) < 0.5


def test_paragraphs_have_their_own_language():
    shares, _ = shape([PROSE_TEXTS[0] + "\n\n" + PROSE_TEXTS[3] + "\n\n" + MORE_LANGUAGES["ru"]])
    found = {NAMES[i] for i in np.flatnonzero(shares[0])}
    assert found == {"prose en", "prose es", "prose ru"}


def test_profiles_of_function_words():
    numbers, shares = zipf_profiles({"en": "the hereby"})
    assert np.allclose(shares.sum(1), 1)
    en = shares[LANGUAGES.index("en")]
    assert en[numbers["the"]] == en.max()
    assert 0 < en[numbers["hereby"]] == en[en > 0].min()
    assert all(0 < len(s) <= 2_000 for s in SAMPLES.values())


def test_language_is_that_of_the_nearest_distribution():
    words = ["der", "die", "und", "in", "haus", "the", "of"]
    functions = np.array([_NUMBERS.get(w, -1) for w in words])
    apart = languages(functions, np.array([0, 0, 0, 0, 0, 1, 1]), 3)
    assert LANGUAGES[apart[0].argmin()] == "de"
    assert LANGUAGES[apart[1].argmin()] == "en"
    assert (apart[2] == 1).all()
    assert ((apart >= 0) & (apart <= 1)).all()


def test_long_tags_are_markup():
    tag = '<a href="' + "u" * 5_000 + '" title="x y z">'
    assert prose(tag + "\n" + PROSE_TEXTS[0]) < 0.5  # most characters are the tag's
    assert prose(f"It was {tag}late</a> and nobody wanted to look at the logs again.") == 1
    assert prose('<p\nclass="x"\nid="y">\n' + PROSE_TEXTS[0] + "\n</p>") > 0.8


def test_mixture():
    paragraph = PROSE_TEXTS[0]
    assert prose(paragraph + "\n\n" + "- red apple\n" * 2) > 0.5
    assert prose(paragraph + "\n\n" + "\n".join(f"- red apple {i} box" for i in range(40))) < 0.5


def test_divergence():
    p = np.array([[0.5, 0.5, 0.0], [1.0, 0.0, 0.0]], np.float32)
    q = np.array([[0.5, 0.5, 0.0], [0.0, 0.0, 1.0]], np.float32)
    d = divergence(p, q)
    assert d[0, 0] == pytest.approx(0, abs=1e-6)
    assert d[1, 1] == pytest.approx(1, abs=1e-5)
    assert divergence(p[:1], q[1:])[0, 0] == pytest.approx(1, abs=1e-5)


def test_batches_do_not_matter():
    texts = [*PROSE_TEXTS, None, "", "  \n", *OTHER_TEXTS]
    whole, n = shape(texts)
    for i, t in enumerate(texts):
        alone, k = shape([t])
        assert np.allclose(whole[i], alone[0], atol=1e-5)
        assert n[i] == k[0]
    assert not whole[len(PROSE_TEXTS)].any()


def test_frame(spark):
    rows = [(1, PROSE_TEXTS[0], "x"), (2, None, "x"), (3, " \n ", "x"), (4, "​", "x"), (5, OTHER_TEXTS[0], "x"), (6, "a" * 300_000, "x"), (6, "a" * 300_000, "x"), (7, "The end of it. " * 20_000, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, profile string")
    found = df.select("doc_id", structure("text").alias("s")).collect()
    by = {r["doc_id"]: r["s"] for r in found}
    assert by[1]["profile"] == "prose en"
    assert by[1]["prose_share"] == 1
    assert by[5]["profile"] == "list"
    assert all(by[i]["profile"] is None for i in (2, 3, 4))
    assert by[6]["profile"] in NAMES
    assert by[7]["profile"] == "filler"
    assert df.limit(0).select(structure("text")).count() == 0


def test_statistics(spark):
    rows = [(1, "The cat sat. And\nthen it left!\n\nx=1"), (2, None), (3, ""), (4, " \n")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = statistics(df.withColumn("n_words", F.lit("x")))
    assert sorted(found.columns) == sorted(["doc_id", "text", *STATISTICS])
    got = {r["doc_id"]: r for r in found.collect()}
    assert got[1]["n_words"] == 8
    assert got[1]["mean_word_length"] == 27 / 8
    assert got[1]["symbol_share"] == 3 / 27
    assert got[1]["ended_line_share"] == 1 / 3
    assert got[1]["common_word_share"] == 4 / 8
    assert got[2]["n_words"] is None
    assert (got[3]["n_words"], got[3]["mean_word_length"], got[4]["n_words"], got[4]["ended_line_share"]) == (0, None, 0, None)


def test_lines_of_tags():
    entries = "\n".join(f'<entry key="a{i}" value="{i}"/>' for i in range(40))
    shares, n = shape([entries, "> <b>\n</b>", PROSE_TEXTS[0] + "\n\n" + entries, "<p>\n" + PROSE_TEXTS[0] + "\n</p>", " \n>\n"])
    assert shares[:, : len(PROSE)].sum(1)[:3] == pytest.approx([0, 0, len(PROSE_TEXTS[0] + "\n") / len(PROSE_TEXTS[0] + "\n" + entries + "\n")])
    assert shares.sum(1) == pytest.approx([1, 1, 1, 1, 0])
    assert shares[3, : len(PROSE)].sum() > 0.9
    assert n[0] == n[1] == 0
