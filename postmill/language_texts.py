"""Sample texts from which the language profiles are counted, written for this library: postings and plain prose. The invented
words of a corpus are no language; to tell those apart, give operators.languages.profiles a labelled table of one's own."""

TEXTS = {
    "en": """We are looking for a developer who would like to join our growing team and help us build the next version of our product. You will work
closely with designers and engineers, write clean and tested code, and take part in planning what we do next. The role is open to people with little
experience who learn quickly. What you bring: good knowledge of at least one programming language, interest in data and the web, and the ability to
explain your ideas. We offer flexible hours, a fair salary, health insurance and the chance to work from home or from our offices. There is no need for
a degree if you can show what you have made. This is what other people say about working here: they have time to think, their questions are answered,
and everyone is treated with respect. If this sounds like you, please send us your application before the end of the month. Strong experience with
cloud services, machine learning or large databases would be a plus, but should not keep you from applying. Which tools are used is up to the team.
Senior backend developer, graduate data scientist, frontend engineer, research internship, full stack web developer, site reliability engineer, product
designer, technical writer, remote within Europe, part time or full time, hybrid, machine learning and search ranking, cloud infrastructure and platform.""",
    "de": """Wir suchen einen Entwickler, der unser wachsendes Team verstärken und uns beim Aufbau der nächsten Version unseres Produkts helfen möchte. Du
arbeitest eng mit Gestaltern und Ingenieuren zusammen, schreibst sauberen und getesteten Code und planst mit, was wir als Nächstes tun. Die Stelle ist
auch für Menschen mit wenig Erfahrung offen, die schnell lernen. Was du mitbringst: gute Kenntnisse in mindestens einer Programmiersprache, Interesse an
Daten und am Netz sowie die Fähigkeit, deine Ideen zu erklären. Wir bieten flexible Arbeitszeiten, ein faires Gehalt, eine Krankenversicherung und die
Möglichkeit, von zu Hause oder in unseren Büros zu arbeiten. Ein Abschluss ist nicht nötig, wenn du zeigen kannst, was du gemacht hast. Das sagen andere
über die Arbeit hier: Sie haben Zeit zum Nachdenken, ihre Fragen werden beantwortet, und alle werden mit Achtung behandelt. Wenn das nach dir klingt,
schicke uns bitte deine Bewerbung bis zum Ende des Monats. Für unser Unternehmen in Berlin und München ist außerdem eine Ausbildung zum Fachinformatiker von Vorteil.""",
    "fr": """Nous recherchons un développeur qui souhaite rejoindre notre équipe en pleine croissance et nous aider à construire la prochaine version de notre
produit. Vous travaillerez en étroite collaboration avec des concepteurs et des ingénieurs, vous écrirez un code propre et testé et vous participerez à la
planification de ce que nous ferons ensuite. Le poste est ouvert aux personnes ayant peu d'expérience qui apprennent vite. Votre profil : une bonne
connaissance d'au moins un langage de programmation, un intérêt pour les données et le web, et la capacité d'expliquer vos idées. Nous proposons des
horaires souples, un salaire juste, une mutuelle et la possibilité de travailler chez vous ou dans nos bureaux. Aucun diplôme n'est nécessaire si vous
pouvez montrer ce que vous avez fait. Voici ce que disent les autres : ils ont le temps de réfléchir, on répond à leurs questions et chacun est traité avec
respect. Si cela vous ressemble, envoyez-nous votre candidature avant la fin du mois. Le stage se déroule au sein du siège de l'entreprise, à Paris ou à Lyon.""",
    "es": """Buscamos un desarrollador que quiera unirse a nuestro equipo en crecimiento y ayudarnos a construir la próxima versión de nuestro producto.
Trabajarás de cerca con diseñadores e ingenieros, escribirás código limpio y probado y participarás en la planificación de lo que haremos después. El puesto
está abierto a personas con poca experiencia que aprendan rápido. Lo que aportas: buen conocimiento de al menos un lenguaje de programación, interés por los
datos y la web, y la capacidad de explicar tus ideas. Ofrecemos horario flexible, un salario justo, seguro médico y la posibilidad de trabajar desde casa o
en nuestras oficinas. No hace falta un título si puedes mostrar lo que has hecho. Esto es lo que dicen otros sobre trabajar aquí: tienen tiempo para pensar,
sus preguntas reciben respuesta y todos son tratados con respeto. Si esto suena como tú, envíanos tu solicitud antes de que termine el mes. Se valorará
también la experiencia con servicios en la nube y el conocimiento de las herramientas que usa la empresa.""",
    "it": """Cerchiamo uno sviluppatore che voglia entrare nella nostra squadra in crescita e aiutarci a costruire la prossima versione del nostro prodotto.
Lavorerai a stretto contatto con progettisti e ingegneri, scriverai codice pulito e verificato e parteciperai alla scelta di ciò che faremo dopo. Il ruolo è
aperto anche a persone con poca esperienza che imparano in fretta. Che cosa porti: una buona conoscenza di almeno un linguaggio di programmazione, interesse
per i dati e per il web, e la capacità di spiegare le tue idee. Offriamo orari flessibili, uno stipendio giusto, assicurazione sanitaria e la possibilità di
lavorare da casa o nei nostri uffici. Non serve una laurea se puoi mostrare quello che hai fatto. Ecco che cosa dicono gli altri del lavoro qui: hanno il
tempo per pensare, alle loro domande si risponde e tutti sono trattati con rispetto. Se questo ti somiglia, mandaci la tua candidatura entro la fine del
mese. Per la sede di Roma o Milano della nostra azienda è gradita anche la conoscenza degli strumenti più usati dal gruppo.""",
    "pt": """Procuramos um programador que queira juntar-se à nossa equipa em crescimento e ajudar-nos a construir a próxima versão do nosso produto. Vai
trabalhar de perto com designers e engenheiros, escrever código limpo e testado e participar no planeamento do que faremos a seguir. A vaga está aberta a
pessoas com pouca experiência que aprendam depressa. O que você traz: bom conhecimento de pelo menos uma linguagem de programação, interesse por dados e
pela web, e a capacidade de explicar as suas ideias. Oferecemos horário flexível, um salário justo, seguro de saúde e a possibilidade de trabalhar em casa
ou nos nossos escritórios. Não é preciso ter um curso se conseguir mostrar o que já fez. É isto que os outros dizem sobre trabalhar aqui: têm tempo para
pensar, as suas perguntas têm resposta e todos são tratados com respeito. Se isso parece consigo, envie a sua candidatura até ao fim do mês. Não há
problema se ainda não conhece as nossas ferramentas; a empresa dá formação e então você começa com um projeto pequeno.""",
    "nl": """Wij zoeken een ontwikkelaar die ons groeiende team wil versterken en ons wil helpen de volgende versie van ons product te bouwen. Je werkt nauw samen
met ontwerpers en ingenieurs, schrijft schone en geteste code en denkt mee over wat we hierna gaan doen. De functie staat open voor mensen met weinig ervaring
die snel leren. Wat je meebrengt: goede kennis van minstens één programmeertaal, belangstelling voor gegevens en het web, en het vermogen om je ideeën uit te
leggen. Wij bieden flexibele werktijden, een eerlijk salaris, een ziektekostenverzekering en de mogelijkheid om thuis of op onze kantoren te werken. Een
diploma is niet nodig als je kunt laten zien wat je hebt gemaakt. Dit zeggen anderen over het werken hier: ze hebben tijd om na te denken, hun vragen worden
beantwoord en iedereen wordt met respect behandeld. Klinkt dit als iets voor jou, stuur ons dan je sollicitatie voor het einde van de maand. Ook zijn wij op
zoek naar een stagiair voor onze vestiging in Utrecht, die graag bij een jong bedrijf aan de slag gaat.""",
    "sv": """Vi söker en utvecklare som vill bli en del av vårt växande team och hjälpa oss att bygga nästa version av vår produkt. Du kommer att arbeta nära
formgivare och ingenjörer, skriva ren och testad kod och vara med och planera vad vi ska göra härnäst. Tjänsten är öppen för personer med lite erfarenhet som
lär sig snabbt. Det du har med dig: goda kunskaper i minst ett programspråk, intresse för data och webben samt förmågan att förklara dina idéer. Vi erbjuder
flexibla arbetstider, en rättvis lön, sjukförsäkring och möjligheten att arbeta hemifrån eller på våra kontor. Du behöver ingen examen om du kan visa vad du
har gjort. Så här säger andra om att arbeta här: de har tid att tänka, deras frågor får svar och alla behandlas med respekt. Om det låter som du, skicka din
ansökan till oss före månadens slut. Det är också bra om du har använt molntjänster eller stora databaser, men det är inget krav för att bli anställd hos företaget.""",
    "da": """Vi søger en udvikler, der har lyst til at blive en del af vores voksende hold og hjælpe os med at bygge den næste udgave af vores produkt. Du kommer til
at arbejde tæt sammen med designere og ingeniører, skrive ren og afprøvet kode og være med til at planlægge, hvad vi skal gøre bagefter. Stillingen er åben for
folk med lidt erfaring, som lærer hurtigt. Det har du med: godt kendskab til mindst ét programmeringssprog, interesse for data og nettet og evnen til at forklare
dine ideer. Vi tilbyder fleksible arbejdstider, en rimelig løn, sygesikring og mulighed for at arbejde hjemmefra eller på vores kontorer. Du behøver ikke en
uddannelse, hvis du kan vise, hvad du har lavet. Det siger andre om at arbejde her: De har tid til at tænke, deres spørgsmål bliver besvaret, og alle bliver
behandlet med respekt. Hvis det lyder som dig, så send os din ansøgning inden udgangen af måneden. Det er også godt, hvis du har brugt skytjenester før, men det er ikke noget krav.""",
    "fi": """Etsimme kehittäjää, joka haluaa liittyä kasvavaan tiimiimme ja auttaa meitä rakentamaan tuotteemme seuraavan version. Työskentelet läheisesti
suunnittelijoiden ja insinöörien kanssa, kirjoitat siistiä ja testattua koodia ja osallistut siihen, mitä teemme seuraavaksi. Tehtävä sopii myös ihmisille,
joilla on vähän kokemusta mutta jotka oppivat nopeasti. Odotamme sinulta vähintään yhden ohjelmointikielen hyvää osaamista, kiinnostusta tietoon ja verkkoon sekä
kykyä selittää ajatuksiasi. Tarjoamme joustavat työajat, reilun palkan, terveysvakuutuksen ja mahdollisuuden työskennellä kotona tai toimistoillamme. Tutkintoa
ei tarvita, jos voit näyttää, mitä olet tehnyt. Näin muut kertovat työstä täällä: heillä on aikaa ajatella, heidän kysymyksiinsä vastataan ja kaikkia kohdellaan
kunnioittavasti. Jos tämä kuulostaa sinulta, lähetä meille hakemuksesi ennen kuun loppua. Myös kokemus pilvipalveluista on hyödyksi, mutta se ei ole välttämätöntä yrityksessämme.""",
    "pl": """Szukamy programisty, który chciałby dołączyć do naszego rosnącego zespołu i pomóc nam zbudować następną wersję naszego produktu. Będziesz blisko
współpracować z projektantami i inżynierami, pisać czysty i sprawdzony kod oraz brać udział w planowaniu tego, co zrobimy dalej. Stanowisko jest otwarte dla osób
z niewielkim doświadczeniem, które szybko się uczą. Czego oczekujemy: dobrej znajomości przynajmniej jednego języka programowania, zainteresowania danymi i siecią
oraz umiejętności wyjaśniania swoich pomysłów. Oferujemy elastyczne godziny pracy, uczciwe wynagrodzenie, ubezpieczenie zdrowotne i możliwość pracy z domu lub w
naszych biurach. Dyplom nie jest potrzebny, jeśli możesz pokazać, co zrobiłeś. Tak mówią inni o pracy u nas: mają czas na myślenie, na ich pytania ktoś odpowiada i
wszyscy są traktowani z szacunkiem. Jeśli to brzmi jak ty, wyślij nam swoje zgłoszenie przed końcem miesiąca. Mile widziane jest także doświadczenie z usługami w chmurze.""",
    "cs": """Hledáme vývojáře, který by se chtěl přidat k našemu rostoucímu týmu a pomoci nám postavit další verzi našeho produktu. Budete úzce spolupracovat s
návrháři a inženýry, psát čistý a otestovaný kód a podílet se na plánování toho, co budeme dělat dál. Místo je otevřené i lidem s malými zkušenostmi, kteří se rychle
učí. Co od vás čekáme: dobrou znalost alespoň jednoho programovacího jazyka, zájem o data a web a schopnost vysvětlit své nápady. Nabízíme pružnou pracovní dobu,
férovou mzdu, zdravotní pojištění a možnost pracovat z domova nebo v našich kancelářích. Titul není potřeba, pokud můžete ukázat, co jste udělali. Takto mluví
ostatní o práci u nás: mají čas přemýšlet, na jejich otázky někdo odpoví a se všemi se jedná s respektem. Pokud vám to zní jako vy, pošlete nám svůj životopis do konce
měsíce. Výhodou je také zkušenost s cloudovými službami nebo velkými databázemi, ale není to nutné pro přijetí do firmy.""",
    "hu": """Olyan fejlesztőt keresünk, aki szívesen csatlakozna növekvő csapatunkhoz, és segítene megépíteni termékünk következő változatát. Szorosan együtt fogsz
dolgozni tervezőkkel és mérnökökkel, tiszta és ellenőrzött kódot írsz, és részt veszel annak tervezésében, hogy mit csináljunk ezután. Az állás nyitva áll olyanok előtt
is, akiknek kevés tapasztalatuk van, de gyorsan tanulnak. Amit várunk: legalább egy programozási nyelv jó ismerete, érdeklődés az adatok és a web iránt, valamint az a
képesség, hogy elmagyarázd az ötleteidet. Rugalmas munkaidőt, tisztességes fizetést, egészségbiztosítást kínálunk, és azt a lehetőséget, hogy otthonról vagy az
irodáinkból dolgozz. Nincs szükség diplomára, ha meg tudod mutatni, mit készítettél. Ezt mondják mások az itteni munkáról: van idejük gondolkodni, a kérdéseikre választ
kapnak, és mindenkivel tisztelettel bánnak. Ha ez rád illik, küldd el nekünk a jelentkezésedet a hónap vége előtt.""",
    "ro": """Căutăm un programator care vrea să se alăture echipei noastre în creștere și să ne ajute să construim următoarea versiune a produsului nostru. Vei lucra
îndeaproape cu designeri și ingineri, vei scrie cod curat și testat și vei lua parte la planificarea a ceea ce facem mai departe. Postul este deschis și persoanelor cu
puțină experiență care învață repede. Ce aduci: o bună cunoaștere a cel puțin unui limbaj de programare, interes pentru date și pentru web și capacitatea de a-ți explica
ideile. Oferim program flexibil, un salariu corect, asigurare de sănătate și posibilitatea de a lucra de acasă sau din birourile noastre. Nu este nevoie de o diplomă dacă
poți arăta ce ai făcut. Iată ce spun alții despre munca aici: au timp să gândească, întrebările lor primesc răspuns și toți sunt tratați cu respect. Dacă ți se potrivește,
trimite-ne cererea ta înainte de sfârșitul lunii. Experiența cu serviciile din cloud este un avantaj, dar nu este obligatorie pentru firma noastră.""",
    "tr": """Büyüyen ekibimize katılmak ve ürünümüzün bir sonraki sürümünü oluşturmamıza yardım etmek isteyen bir yazılım geliştirici arıyoruz. Tasarımcılar ve
mühendislerle yakın çalışacak, temiz ve sınanmış kod yazacak ve bundan sonra ne yapacağımızın planlanmasına katılacaksınız. Bu görev, az deneyimi olan ama çabuk öğrenen
kişilere de açıktır. Sizden beklediğimiz: en az bir programlama dilini iyi bilmek, verilere ve internete ilgi duymak ve düşüncelerinizi açıklayabilmek. Esnek çalışma
saatleri, adil bir ücret, sağlık sigortası ve evden ya da ofislerimizden çalışma olanağı sunuyoruz. Ne yaptığınızı gösterebiliyorsanız diploma gerekmez. Başkaları burada
çalışmak hakkında şunları söylüyor: düşünmek için zamanları var, sorularına yanıt veriliyor ve herkese saygıyla davranılıyor. Bu size uygunsa, lütfen başvurunuzu ay sonuna
kadar bize gönderin. Bulut hizmetleri ile deneyim de bir artıdır, ancak şirketimiz için zorunlu değildir.""",
    "hr": """Tražimo programera koji se želi pridružiti našem rastućem timu i pomoći nam izgraditi sljedeću inačicu našeg proizvoda. Blisko ćete surađivati s
dizajnerima i inženjerima, pisati čist i provjeren kod te sudjelovati u planiranju onoga što ćemo raditi dalje. Radno mjesto otvoreno je i osobama s malo iskustva koje
brzo uče. Što očekujemo: dobro poznavanje barem jednog programskog jezika, zanimanje za podatke i mrežu te sposobnost da objasnite svoje zamisli. Nudimo fleksibilno radno
vrijeme, poštenu plaću, zdravstveno osiguranje i mogućnost rada od kuće ili u našim uredima. Diploma nije potrebna ako možete pokazati što ste napravili. Ovako drugi
govore o radu kod nas: imaju vremena za razmišljanje, na njihova se pitanja odgovara i prema svima se odnosi s poštovanjem. Ako vam se to čini prikladnim, pošaljite nam
svoju prijavu do kraja mjeseca. Prednost je i iskustvo s uslugama u oblaku, ali nije nužno za našu tvrtku.""",
    "id": """Kami mencari seorang pengembang yang ingin bergabung dengan tim kami yang sedang berkembang dan membantu kami membangun versi berikutnya dari produk kami.
Anda akan bekerja erat dengan perancang dan insinyur, menulis kode yang bersih dan teruji, serta ikut merencanakan apa yang akan kami lakukan selanjutnya. Lowongan ini
terbuka bagi orang dengan sedikit pengalaman yang cepat belajar. Yang kami harapkan: pengetahuan yang baik tentang sedikitnya satu bahasa pemrograman, minat pada data dan
web, serta kemampuan menjelaskan gagasan Anda. Kami menawarkan jam kerja yang luwes, gaji yang adil, asuransi kesehatan, dan kesempatan untuk bekerja dari rumah atau dari
kantor kami. Gelar tidak diperlukan jika Anda dapat menunjukkan apa yang telah Anda buat. Inilah yang dikatakan orang lain tentang bekerja di sini: mereka punya waktu untuk
berpikir, pertanyaan mereka dijawab, dan semua orang diperlakukan dengan hormat. Jika ini cocok dengan Anda, silakan kirim lamaran Anda sebelum akhir bulan.""",
    "ru": """Мы ищем разработчика, который хотел бы присоединиться к нашей растущей команде и помочь нам создать следующую версию нашего продукта. Вы будете тесно
работать с дизайнерами и инженерами, писать чистый и проверенный код и участвовать в планировании того, что мы будем делать дальше. Эта работа подходит и людям с небольшим
опытом, которые быстро учатся. Что мы ожидаем: хорошее знание хотя бы одного языка программирования, интерес к данным и сети, а также умение объяснять свои идеи. Мы
предлагаем гибкий график, честную зарплату, медицинскую страховку и возможность работать из дома или в наших офисах. Диплом не нужен, если вы можете показать, что вы
сделали. Вот что говорят другие о работе у нас: у них есть время подумать, на их вопросы отвечают, и ко всем относятся с уважением.""",
    "uk": """Ми шукаємо розробника, який хотів би приєднатися до нашої команди, що зростає, і допомогти нам створити наступну версію нашого продукту. Ви будете тісно
працювати з дизайнерами та інженерами, писати чистий і перевірений код і брати участь у плануванні того, що ми робитимемо далі. Ця робота підходить і людям з невеликим
досвідом, які швидко вчаться. Що ми очікуємо: добре знання хоча б однієї мови програмування, цікавість до даних і мережі, а також уміння пояснювати свої ідеї. Ми
пропонуємо гнучкий графік, чесну платню, медичне страхування та можливість працювати з дому або в наших офісах. Диплом не потрібен, якщо ви можете показати, що ви
зробили. Ось що кажуть інші про роботу в нас: вони мають час подумати, на їхні запитання відповідають, і до всіх ставляться з повагою.""",
    "el": """Αναζητούμε έναν προγραμματιστή που θέλει να ενταχθεί στην ομάδα μας που μεγαλώνει και να μας βοηθήσει να φτιάξουμε την επόμενη έκδοση του προϊόντος μας. Θα
συνεργάζεστε στενά με σχεδιαστές και μηχανικούς, θα γράφετε καθαρό και ελεγμένο κώδικα και θα συμμετέχετε στον σχεδιασμό αυτών που θα κάνουμε στη συνέχεια. Η θέση είναι
ανοιχτή και σε άτομα με λίγη εμπειρία που μαθαίνουν γρήγορα. Τι περιμένουμε: καλή γνώση τουλάχιστον μιας γλώσσας προγραμματισμού, ενδιαφέρον για τα δεδομένα και τον ιστό
και την ικανότητα να εξηγείτε τις ιδέες σας. Προσφέρουμε ευέλικτο ωράριο, δίκαιο μισθό, ασφάλιση υγείας και τη δυνατότητα να εργάζεστε από το σπίτι ή από τα γραφεία μας.""",
}
