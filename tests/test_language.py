"""The statistical guess on sentences that it hasn't seen, and on labelled documents."""

import pytest

from quern.functions import language, tongues
from quern.operators import steps

#: Two sentences of each language that the statistics aren't counted from.
UNSEEN = {
    "ar": ["أين أقرب محطة قطار من فضلك؟", "أريد أن أشرب القهوة وأقرأ الجريدة قبل العمل."],
    "bg": ["Къде е най-близката гара, моля?", "Искам да пия кафе и да прочета вестника преди работа."],
    "cs": ["Kde je prosím nejbližší nádraží?", "Chtěl bych si dát kávu a přečíst noviny před prací."],
    "da": ["Hvor er den nærmeste station, tak?", "Jeg vil gerne drikke kaffe og læse avisen, før jeg går på arbejde."],
    "de": ["Wo ist bitte der nächste Bahnhof?", "Ich möchte vor der Arbeit Kaffee trinken und die Zeitung lesen."],
    "el": ["Πού είναι ο πλησιέστερος σταθμός;", "Θέλω να πιω καφέ και να διαβάσω την εφημερίδα."],
    "en": ["Where is the nearest station, please?", "I would like to drink coffee and read the newspaper before work."],
    "es": ["¿Dónde está la estación más cercana, por favor?", "Quiero tomar un café y leer el periódico antes del trabajo."],
    "et": ["Kus on siin lähim raudteejaam, palun?", "Ma tahaksin enne tööd kohvi juua ja ajalehte lugeda."],
    "fa": ["نزدیک‌ترین ایستگاه کجاست لطفا؟", "می‌خواهم پیش از کار قهوه بنوشم و روزنامه بخوانم."],
    "fi": ["Missä on lähin rautatieasema, kiitos?", "Haluaisin juoda kahvia ja lukea sanomalehteä ennen töitä."],
    "fr": ["Où se trouve la gare la plus proche, s'il vous plaît ?", "Je voudrais boire un café et lire le journal avant le travail."],
    "he": ["איפה נמצאת התחנה הקרובה ביותר?", "אני רוצה לשתות קפה ולקרוא עיתון לפני העבודה."],
    "hi": ["सबसे नज़दीकी स्टेशन कहाँ है, कृपया बताइए?", "मैं काम से पहले कॉफ़ी पीना और अख़बार पढ़ना चाहता हूँ।"],
    "hr": ["Gdje je najbliža željeznička stanica, molim vas?", "Želio bih popiti kavu i pročitati novine prije posla."],
    "hu": ["Hol van a legközelebbi pályaudvar, kérem?", "Szeretnék kávét inni és újságot olvasni munka előtt."],
    "id": ["Di mana stasiun yang paling dekat?", "Saya ingin minum kopi dan membaca koran sebelum bekerja."],
    "it": ["Dove si trova la stazione più vicina, per favore?", "Vorrei bere un caffè e leggere il giornale prima del lavoro."],
    "ja": ["一番近い駅はどこにありますか。教えてください。", "仕事の前にコーヒーを飲んで、新聞を読みたいです。"],
    "ko": ["가장 가까운 역이 어디에 있습니까? 알려 주세요.", "일하기 전에 커피를 마시고 신문을 읽고 싶습니다."],
    "lt": ["Kur yra artimiausia geležinkelio stotis?", "Norėčiau prieš darbą išgerti kavos ir paskaityti laikraštį."],
    "lv": ["Kur atrodas tuvākā dzelzceļa stacija?", "Es vēlētos pirms darba iedzert kafiju un palasīt avīzi."],
    "nl": ["Waar is het dichtstbijzijnde station, alstublieft?", "Ik wil graag koffie drinken en de krant lezen voor het werk."],
    "no": ["Hvor er den nærmeste stasjonen, takk?", "Jeg vil gjerne drikke kaffe og lese avisen før jeg går på jobb."],
    "pl": ["Gdzie jest najbliższy dworzec, proszę?", "Chciałbym napić się kawy i przeczytać gazetę przed pracą."],
    "pt": ["Onde fica a estação mais próxima, por favor?", "Gostaria de beber um café e ler o jornal antes do trabalho."],
    "ro": ["Unde este cea mai apropiată gară, vă rog?", "Aș vrea să beau o cafea și să citesc ziarul înainte de muncă."],
    "ru": ["Скажите, пожалуйста, где ближайший вокзал?", "Я хотел бы выпить кофе и почитать газету перед работой."],
    "sv": ["Var ligger den närmaste stationen, tack?", "Jag skulle vilja dricka kaffe och läsa tidningen före jobbet."],
    "th": ["สถานีที่ใกล้ที่สุดอยู่ที่ไหนครับ", "ฉันอยากดื่มกาแฟและอ่านหนังสือพิมพ์ก่อนทำงาน"],
    "tr": ["En yakın istasyon nerede, lütfen?", "İşten önce kahve içmek ve gazete okumak istiyorum."],
    "uk": ["Скажіть, будь ласка, де найближчий вокзал?", "Я хотів би випити кави і почитати газету перед роботою."],
    "vi": ["Nhà ga gần nhất ở đâu, làm ơn cho tôi biết?", "Tôi muốn uống cà phê và đọc báo trước khi làm việc."],
    "zh": ["请问最近的火车站在什么地方？我们想去那里看看。", "我想在工作之前喝咖啡，看一看今天的报纸，然后再出门。"],
}


def test_unseen_sentences(spark):
    assert set(UNSEEN) == set(tongues.TEXTS) and len(UNSEEN) >= 30
    rows = [(name, t) for name, both in UNSEEN.items() for t in both]
    got = spark.createDataFrame(rows, "want string, text string").withColumn("g", language.by_letters(steps.F.col("text"))).collect()
    wrong = [(r["want"], r["g"]["language"], r["text"]) for r in got if r["want"] != r["g"]["language"]]
    assert len(wrong) <= 0.1 * len(rows), wrong


def test_labelled_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("lang is not null")
    got = steps.filter_language(docs, {"text_column": "text", "tag_column_name": "guess"}).df.filter("guess <> 'unknown'")
    n, right = got.selectExpr("count(*)", "count_if(guess = lang)").first()
    assert right >= 0.95 * n


def test_awkward_texts(spark):
    long = "The weather was good and we went home with the children. " * 20_000
    rows = [(0, None), (1, ""), (2, "short"), (3, "1234567890 !!! 1234567890 ???"), (4, "  \n" * 20), (5, long), (6, "日本語の文章です。これはとても長い文章なので大丈夫です。"), (7, "\U00010400\U00010401 " * 10), (8, "Ünïcödé wörds with the English language in between them 😀")]
    df = spark.createDataFrame(rows, "rid long, text string")
    got = {r["rid"]: r for r in steps.filter_language(df, {}).df.collect()}
    assert [got[k]["language"] for k in range(5)] == ["unknown"] * 5 and all(got[k]["language_confidence"] == 0 for k in range(5))
    assert [got[k]["language"] for k in (5, 6, 8)] == ["en", "ja", "en"] and got[5]["language_confidence"] > 0.99
    assert steps.filter_language(df.limit(0), {}).df.count() == 0
    with pytest.raises(ValueError):
        steps.filter_language(df, {"method": "other"})


def test_blocks_make_no_difference(spark, monkeypatch):
    import pyarrow as pa

    texts = pa.array([" " + " ".join(t.split()) + " " for t in tongues.TEXTS.values()] + ["", " "])
    whole = language.model().of(texts)
    monkeypatch.setattr(language, "_STEP", 7)
    assert (language.model().of(texts) == whole).all()


def test_long_texts_are_looked_up_fast():
    """Sums are those of counting by hand, and ten million letters don't take many seconds (34 sums a letter took about nine)."""
    import math
    import time

    import pyarrow as pa

    m, found = language.model(), language.counts()
    texts = ["", " ", " a ", " qzqx ", *(language._letters(t) for t in tongues.TEXTS.values())]
    runs = {r for c in found.values() for r in c}
    total = {n: sum(found[n].values()) + language.ADDED * len(runs) for n in m.names}
    by_hand = lambda t, n: sum(math.floor(1000 * math.log((found[n][r] + language.ADDED) / total[n])) for w in (1, 2, 3) for k in range(len(t) - w + 1) if (r := t[k : k + w]) in runs)
    got = m.of(pa.array(texts))
    assert all(got[k, j] == by_hand(t, n) for k, t in enumerate(texts) for j, n in enumerate(m.names))
    many = pa.array([texts[7] * (10_000_000 // len(texts[7]) // 40)] * 40)
    start = time.process_time()
    m.of(many)
    assert time.process_time() - start < 4
