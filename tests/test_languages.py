"""Language profiles on texts that they were not counted from."""

import math

import pytest
from pyspark.sql import functions as F

from postmill.operators import filters, languages

# descriptions of about a hundred characters, none of them in the profiles' texts
HELD = {
"en": ["Our customers trust us with their money, and we want to make sure that every payment arrives on time and without errors.", "Are you a student in your final year? Spend six months with our research group and see how real systems are tested."],
"de": ["Unsere Kunden vertrauen uns ihr Geld an, und wir wollen dafür sorgen, dass jede Zahlung rechtzeitig und ohne Fehler ankommt.", "Bist du im letzten Studienjahr? Verbringe sechs Monate in unserer Forschungsgruppe und sieh, wie echte Systeme geprüft werden."],
"fr": ["Nos clients nous confient leur argent et nous voulons que chaque paiement arrive à temps et sans erreur.", "Vous êtes en dernière année d'études ? Passez six mois dans notre groupe de recherche et voyez comment on teste de vrais systèmes."],
"es": ["Nuestros clientes nos confían su dinero y queremos asegurarnos de que cada pago llegue a tiempo y sin errores.", "¿Estás en el último año de la carrera? Pasa seis meses con nuestro grupo de investigación y mira cómo se prueban los sistemas reales."],
"it": ["I nostri clienti ci affidano il loro denaro e vogliamo essere certi che ogni pagamento arrivi in tempo e senza errori.", "Sviluppatore Senior PHP MySQL per azienda fintech italiana di Roma, contratto a tempo indeterminato e buoni pasto."],
"pt": ["Os nossos clientes confiam-nos o seu dinheiro e queremos garantir que cada pagamento chega a horas e sem erros.", "Você está no último ano da faculdade? Passe seis meses com o nosso grupo de pesquisa e veja como sistemas reais são testados."],
"nl": ["Onze klanten vertrouwen ons hun geld toe en wij willen ervoor zorgen dat elke betaling op tijd en zonder fouten aankomt.", "Zit je in het laatste jaar van je studie? Breng zes maanden door bij onze onderzoeksgroep en zie hoe echte systemen worden getest."],
"sv": ["Våra kunder anförtror oss sina pengar och vi vill se till att varje betalning kommer fram i tid och utan fel.", "Går du sista året på din utbildning? Tillbringa sex månader hos vår forskargrupp och se hur riktiga system provas."],
"da": ["Vores kunder betror os deres penge, og vi vil sørge for, at hver betaling når frem til tiden og uden fejl.", "Går du på sidste år af dit studie? Tilbring seks måneder hos vores forskningsgruppe og se, hvordan rigtige systemer bliver testet."],
"fi": ["Asiakkaamme luottavat meille rahansa, ja haluamme varmistaa, että jokainen maksu saapuu ajoissa ja ilman virheitä.", "Oletko viimeisen vuoden opiskelija? Vietä kuusi kuukautta tutkimusryhmässämme ja katso, miten oikeita järjestelmiä testataan."],
"pl": ["Nasi klienci powierzają nam swoje pieniądze, a my chcemy mieć pewność, że każda płatność dotrze na czas i bez błędów.", "Jesteś na ostatnim roku studiów? Spędź sześć miesięcy w naszej grupie badawczej i zobacz, jak testuje się prawdziwe systemy."],
"cs": ["Naši zákazníci nám svěřují své peníze a my chceme zajistit, aby každá platba dorazila včas a bez chyb.", "Jste v posledním ročníku studia? Strávte šest měsíců v naší výzkumné skupině a podívejte se, jak se zkoušejí skutečné systémy Python, Kubernetes a AWS."],
"hu": ["Ügyfeleink ránk bízzák a pénzüket, és gondoskodni akarunk arról, hogy minden fizetés időben és hiba nélkül megérkezzen.", "Utolsó éves hallgató vagy? Tölts el hat hónapot a kutatócsoportunkban, és nézd meg, hogyan tesztelik a valódi rendszereket."],
"ro": ["Clienții noștri ne încredințează banii lor și vrem să ne asigurăm că fiecare plată ajunge la timp și fără greșeli.", "Ești în ultimul an de studii? Petrece șase luni în grupul nostru de cercetare și vezi cum sunt testate sistemele reale."],
"tr": ["Müşterilerimiz bize paralarını emanet ediyor ve her ödemenin zamanında ve hatasız ulaşmasını sağlamak istiyoruz.", "Son sınıf öğrencisi misiniz? Araştırma grubumuzda altı ay geçirin ve gerçek sistemlerin nasıl denendiğini görün."],
"hr": ["Naši klijenti povjeravaju nam svoj novac i želimo osigurati da svaka uplata stigne na vrijeme i bez pogrešaka.", "Jeste li na posljednjoj godini studija? Provedite šest mjeseci u našoj istraživačkoj skupini i vidite kako se ispituju stvarni sustavi."],
"id": ["Para pelanggan mempercayakan uang mereka kepada kami dan kami ingin memastikan setiap pembayaran tiba tepat waktu dan tanpa kesalahan.", "Apakah Anda mahasiswa tahun terakhir? Habiskan enam bulan bersama kelompok penelitian kami dan lihat bagaimana sistem nyata diuji."],
"ru": ["Наши клиенты доверяют нам свои деньги, и мы хотим, чтобы каждый платёж приходил вовремя и без ошибок.", "Вы учитесь на последнем курсе? Проведите полгода в нашей исследовательской группе и посмотрите, как проверяют настоящие системы."],
"uk": ["Наші клієнти довіряють нам свої гроші, і ми хочемо, щоб кожен платіж надходив вчасно й без помилок.", "Ви навчаєтеся на останньому курсі? Проведіть пів року в нашій дослідницькій групі й подивіться, як перевіряють справжні системи."],
"el": ["Οι πελάτες μας μάς εμπιστεύονται τα χρήματά τους και θέλουμε κάθε πληρωμή να φτάνει στην ώρα της και χωρίς λάθη.", "Είστε φοιτητής στο τελευταίο έτος; Περάστε έξι μήνες με την ερευνητική μας ομάδα και δείτε πώς δοκιμάζονται τα πραγματικά συστήματα."],
}


def guesses(spark, texts, known=None):
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, t string").select("n", languages.detect(F.col("t"), known).alias("guess")).collect()
    return [r["guess"] for r in sorted(rows, key=lambda r: r["n"])]


def test_short_descriptions_of_twenty_languages(spark):
    texts = [(k, t) for k, own in HELD.items() for t in own]
    found = guesses(spark, [t for _, t in texts])
    assert len(HELD) >= 15 and sum(k == g for (k, _), g in zip(texts, found, strict=True)) >= 0.95 * len(texts)
    half = guesses(spark, [t[:60] for _, t in texts])
    assert sum(k == g for (k, _), g in zip(texts, half, strict=True)) >= 0.9 * len(texts)


def test_no_letters_is_english_and_null_is_null(spark):
    assert guesses(spark, ["", "  ", "12 34", "a", None, "日本"]) == ["en", "en", "en", guesses(spark, ["a"])[0], None, guesses(spark, ["日本"])[0]]


@pytest.mark.parametrize(
    "title, english",
    [
        ("AI Engineer", True),
        ("Junior Software Engineer", True),
        ("Entwickler gesucht in Berlin", True),  # under 30 characters nothing is told
        ("Junior Software Engineer with strong Python and AWS experience required", True),
        ("Software Engineering Internship for Backend Cloud Platform", True),
        ("Senior Backend Developer (Golang, Kubernetes, PostgreSQL) - Remote", True),
        ("Sviluppatore Senior PHP MySQL per azienda fintech italiana di Roma", False),
        ("Programista Java do zespołu rozwoju systemów bankowych w Krakowie", False),
        ("", True),
        (None, True),
        (" " * 40, True),
    ],
)
def test_titles(spark, title, english):
    assert spark.createDataFrame([(title,)], "t string").select(filters.english_title(F.col("t"))).first()[0] is english


def test_descriptions(spark):
    czech = "Hledáme Python vývojáře pro náš tým v Praze. Stack: Python, Django, PostgreSQL, Docker, AWS. " * 3
    cases = [("<p>" + HELD["en"][0] + "</p>", True), (HELD["de"][0], False), ("Wir suchen dich.", True), (None, True), (czech, False), ("ř" * 3 + " the and of with our team " * 10, False), ("<div class='wir suchen einen entwickler der das kann'>" + HELD["en"][1] + "</div>", True)]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "n int, t string").select("n", filters.english_description(F.col("t")).alias("ok")).collect()
    assert [r["ok"] for r in sorted(rows, key=lambda r: r["n"])] == [x for _, x in cases]


def test_profiles_from_a_table_are_those_of_python(spark):
    table = spark.createDataFrame([(k, t) for k, t in languages.TEXTS.items()] + [(None, "x"), ("en", None)], "lang string, text string").repartition(4)
    assert languages.model(languages.profiles(table)) == dict(sorted(languages.own_profiles().items()))


def test_sequences_are_counted_in_tasks(spark):
    """Profiles against a plain count of slots(), with texts that meet in one lot, long and short ones; a task's sums are shuffled, not its sequences."""
    texts = ["", "a", "é1ß", "😀𝒜𝒷 文字列", "x" * 999, "Ab, cd", " ", "42"] * 80
    table = spark.createDataFrame([(i, f"l{i % 3}", t) for i, t in enumerate(texts)] + [(-1, "none", "42")], "i int, lang string, text string").coalesce(2)
    plain = table.select("lang", F.explode(languages.slots(F.col("text"))).alias("slot")).groupBy("lang", "slot").count().collect()
    totals: dict = {}
    for r in plain:
        totals[r["lang"]] = totals.get(r["lang"], 0) + r["count"]
    penalty = lambda n, total: min(languages.WORST, round(-languages.SCALE * math.log((n + languages.SMOOTH) / (total + languages.SMOOTH * languages.SLOTS))))
    want = sorted([(r["lang"], r["slot"], penalty(r["count"], totals[r["lang"]])) for r in plain] + [(k, -1, penalty(0, n)) for k, n in totals.items()])
    found = languages.profiles(table)
    assert sorted((r["lang"], -1 if r["slot"] is None else r["slot"], r["penalty"]) for r in found.collect()) == want
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
