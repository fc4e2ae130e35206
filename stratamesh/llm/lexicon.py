"""Everyday words of six languages that the detector's features and training texts use."""

from __future__ import annotations

TITLES = frozenset("mr mrs ms miss dr prof mx sir rev m mme mlle me monsieur madame mademoiselle herr herrn frau sr sra srta señor señora señorita don doña г-н г-жа господин госпожа гражданин гражданка товарищ доктор doctor docteur doktor nurse judge captain".split())
TITLES_AFTER = ("先生", "女士", "小姐", "太太", "老师", "医生", "教授", "博士")
PARTICLES = frozenset("de da do dos das del della di du la le van von der den ter ten zu al el bin ben ibn abu mac st o y e af av".split())
#: Particles that only follow another one, as in "van den".
INNER_PARTICLES = frozenset("der den ten ter la le los".split())

STREETS_EN = "street st road rd avenue ave boulevard blvd drive dr lane ln court ct crescent cres way place pl terrace square sq highway hwy trail close row gardens parkway pkwy mews grove".split()
STREETS_FR = "rue chemin ch avenue av boulevard boul bd allée allee impasse place côte rang route rte ruelle quai square passage sentier".split()
STREETS_DE = "straße strasse str weg platz gasse allee ufer ring damm".split()
STREETS_RU = "улица улице улицы ул проспект проспекте пр-т просп переулок переулке пер шоссе ш бульвар бульваре бул площадь площади пл набережная набережной наб".split()
STREETS_ES = "calle c/ avenida av avda plaza pza paseo camino carretera ctra callejón ronda".split()
STREETS_ZH = "街 路 大道 巷 大街 胡同".split()
ABBREVIATED = frozenset("st rd ave blvd dr ln ct cres hwy av boul bd ch rte str ул пр-т просп пер пл наб бул ш avda pza ctra pl sq pkwy".split())

PLACE_WORDS = frozenset(
    """lake upper lower port fort mount saint sainte san santa baie island isle harbour harbor river bay landing north south east west new old cape point creek valley hill hills
    beach falls springs bridge mountain mountains sea ocean coast county state province city town village park forest les las los rio villa puerto cabo sierra ciudad norte sur mont lac île val
    rivière bad ober unter neu alt see berg insel нижний верхний великий новый старый северный южный восточный западный гора озеро река остров grand grande great little big long""".split()
)
ORG_WORDS = frozenset(
    """council board company bank office ministry department agency authority union club league school university college hospital clinic library museum church committee commission
    association society institute foundation trust group limited ltd inc corp llc gmbh ag kg sa sas foods motors airlines insurance services service team court police parliament
    senate congress house registry bureau conseil banque société école mairie université hôpital association ministère tribunal amt rat verein schule stadtrat bundestag gesellschaft
    banco consejo escuela universidad hospital ministerio ayuntamiento empresa instituto банк совет школа университет министерство компания завод больница управление комитет дума
    палата hotel café restaurant store market press news times post radio""".split()
)
STOP_WORDS = frozenset(
    """the a an in on at to from for with by of and or but if when while after before since until as this that these those my our your his her their its he she it we they i you is was are were be not no
    yes please dear hello hi thanks thank regards sincerely all each every some any both many most other another where who what which why how there here then now today tomorrow yesterday
    le la les un une des du de au aux en dans sur sous avec sans pour par et ou mais si quand après avant depuis ce cette ces mon ma mes notre votre son sa ses leur il elle nous vous ils elles je on est
    était sont ne pas oui bonjour merci cher chère à chez vers lors
    der die das den dem des ein eine einen einem einer im am an auf aus bei mit nach seit von vor zu zum zur für ohne um und oder aber wenn als während dieser diese dieses mein unser ihr sein er sie es wir
    ich ist war sind nicht kein ja nein bitte liebe lieber hallo danke alle jeder
    el los las una unos en con sin por para y o pero cuando después antes desde hasta este esta estos mi nuestro su él ella nosotros ellos yo es era son no sí hola gracias querido querida al
    в на с со к ко у о об от до из за под над при по для без и или но если когда после перед через этот эта это эти мой наш ваш его её их он она оно мы вы они я не да нет уважаемый уважаемая здравствуйте
    спасибо все каждый""".split()
)
CALENDAR = frozenset(
    """january february march april may june july august september october november december jan feb mar apr jun jul aug sep sept oct nov dec monday tuesday wednesday thursday friday saturday sunday
    janvier février mars avril mai juin juillet août septembre octobre novembre décembre lundi mardi mercredi jeudi vendredi samedi dimanche
    januar februar märz juni juli oktober dezember montag dienstag mittwoch donnerstag freitag samstag sonntag
    enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre lunes martes miércoles jueves viernes sábado domingo
    января февраля марта апреля мая июня июля августа сентября октября ноября декабря понедельник вторник среда четверг пятница суббота воскресенье""".split()
)
PASSPORT = ("passport", "passeport", "reisepass", "pasaporte", "паспорт", "护照", "pass-nr", "passnummer", "pass nr", "travel document")
INSURANCE = ("sin", "nas", "insurance", "assurance", "versicherung", "seguro", "seguridad", "страхов", "снилс", "社会保险", "社保", "保险号", "social")

#: Common given and family names of many countries, in Latin and Cyrillic letters.
GIVEN_LATIN = """James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Thomas Sarah Daniel Karen Matthew Nancy Anthony Lisa Mark Betty Paul Sandra Andrew Ashley
Emily Joshua Olivia Kevin Amanda Brian Melissa George Deborah Hannah Rachel Oliver Charlotte Harry Sophie Jack Chloe Pierre Marie Jean Camille Luc Julie Antoine Claire Nicolas Isabelle Mathieu Élodie
François Nathalie Hans Anna Peter Sabine Klaus Ursula Jürgen Petra Stefan Katrin Lukas Lena Felix Johanna Juan María José Carmen Carlos Ana Luis Laura Miguel Lucía Javier Elena Diego Sofía Pablo Isabel
Giovanni Giulia Marco Francesca João Beatriz Pedro Mariana Lars Ingrid Erik Astrid Mikko Aino Piotr Agnieszka Jakub Katarzyna Ivan Olga Dmitri Natalia Ahmed Fatima Mohammed Aisha Omar Layla Yusuf
Zeynep Mehmet Elif Raj Priya Arjun Ananya Vikram Deepa Sanjay Kavita Wei Mei Li Jing Hiroshi Yuki Kenji Sakura Minh Linh Kwame Ama Chinedu Ngozi Thabo Zanele Kofi Amara Tariq Noor""".split()
FAMILY_LATIN = """Smith Johnson Williams Brown Jones Miller Davis Wilson Anderson Taylor Moore Jackson Martin Lee Thompson White Harris Clark Lewis Robinson Walker Hall Allen Young King Wright Scott Green
Baker Adams Nelson Carter Mitchell Roberts Campbell Evans Turner Murphy Kelly O'Brien O'Connor MacDonald Tremblay Gagnon Roy Bouchard Gauthier Morin Lavoie Fortin Dubois Bernard Petit Durand Leroy
Moreau Lefebvre Dupont Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Schulz Hoffmann Koch Bauer Richter Klein Wolf Neumann García González Rodríguez Fernández López Martínez Sánchez Pérez
Gómez Díaz Hernández Torres Ramírez Flores Rossi Russo Ferrari Silva Santos Oliveira Souza Costa Hansen Johansson Andersson Nielsen Virtanen Kowalski Nowak Novák Horvat Popescu Ivanov Petrov Khan
Hussein Hassan Ali Rahman Yılmaz Kaya Demir Singh Patel Sharma Kumar Gupta Mehta Reddy Chen Wang Zhang Liu Huang Nguyen Tran Pham Kim Park Tanaka Suzuki Sato Watanabe Mensah Okafor Adeyemi Dlamini
Nkosi Diallo Traoré Haddad Cohen Levy""".split()
GIVEN_CYRILLIC = """Александр Сергей Дмитрий Андрей Алексей Иван Михаил Николай Владимир Павел Пётр Виктор Олег Юрий Борис Игорь Максим Артём Роман Антон Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана
Екатерина Людмила Галина Юлия Анастасия Дарья Полина Ксения Надежда Любовь Марина Вероника Оксана Тарас Гульнара Рустам""".split()
FAMILY_CYRILLIC = """Иванов Смирнов Кузнецов Попов Васильев Петров Соколов Михайлов Новиков Фёдоров Морозов Волков Алексеев Лебедев Семёнов Егоров Павлов Козлов Степанов Николаев Орлов Андреев Макаров Никитин Захаров
Шевченко Коваленко Бондаренко Мельник Кравчук Островский Жуковский Савицкий Ахметов""".split()

#: Capitalised pairs that are no persons.
CAPITAL_PAIRS = [
    *"United States|Great Britain|New York|South Africa|World War|Middle Ages|Good Friday|Black Friday|Prime Minister|Star Wars|Happy Birthday|Merry Christmas|Los Angeles|San Francisco|Hong Kong|Cape Town|Costa Rica|Puerto Rico|Wall Street|White House|Red Cross|Human Resources|Customer Service|Quality Control|Monday Morning|Annual Report|Table Tennis|Apple Pie|Green Tea|Ice Hockey|North America|Middle East|Security Guard|General Manager|Lost Property|Main Entrance|Final Notice|Blue Ribbon|Golden Eagle".split("|"),
    *"États Unis|Nouvelle Zélande|Grande Bretagne|Premier Ministre|Joyeux Noël|Code Civil|Afrique Australe|Ressources Humaines|Service Clients|Bonne Année".split("|"),
    *"Buenos Aires|Costa Brava|Semana Santa|Código Penal|América Latina|Recursos Humanos|Banco Central|Feliz Navidad|Gran Vía".split("|"),
    *"Deutsche Bahn|Frohe Weihnachten|Ende August|Anfang Mai|Stadt Leipzig|Grüner Tee|Rote Rüben|Herzliche Grüße|Neues Testament|Guten Morgen|Blauer Brief|Abteilung Einkauf|Kaffee Kuchen|Bahnhof Mitte|Karte Deutschland".split("|"),
    *"Нижний Новгород|Новый Год|Красная Площадь|Северная Америка|Отдел Кадров|Великий Пост|Добрый День|Банк России|Московский Вокзал|Чёрное Море|Служба Поддержки".split("|"),
]

#: Words in lower case to fill sentences with.
FILLER = {
    "en": "yesterday morning bread coffee window garden without question almost later kitchen school lesson ticket invoice parcel chair football doctor dentist quickly very late quite cold wet warm meeting report evening lunch bicycle repair again often because maybe price discount order delivery homework cousin neighbour dinner music rehearsal station luggage".split(),
    "fr": "hier matin pain café fenêtre jardin sans question presque cuisine école leçon billet facture colis chaise football médecin vite très tard froid chaud réunion rapport soir déjeuner vélo réparation encore souvent peut-être prix remise commande livraison devoirs cousin voisin musique gare bagages".split(),
    "de": "gestern morgens schon wieder sehr spät kalt warm vielleicht oft leider gern schnell bald noch immer fast Brot Kaffee Fenster Garten Schule Rechnung Paket Stuhl Fußball Arzt Sitzung Bericht Abend Fahrrad Reparatur Preis Rabatt Bestellung Lieferung Musik Bahnhof Gepäck Küche".split(),
    "ru": "вчера утром хлеб кофе окно сад вопрос почти кухня школа урок билет счёт посылка стул футбол врач быстро очень поздно холодно тепло встреча отчёт вечер обед велосипед ремонт снова часто возможно цена скидка заказ доставка сосед музыка вокзал багаж".split(),
    "zh": "昨天 早上 面包 咖啡 窗户 花园 问题 厨房 学校 课程 车票 发票 包裹 椅子 足球 医院 很快 非常 晚了 会议 报告 晚上 午饭 修理 经常 也许 价格 折扣 订单 邻居 音乐 车站 行李".split(),
    "es": "ayer mañana pan café ventana jardín sin pregunta casi cocina escuela lección billete factura paquete silla fútbol médico rápido muy tarde frío calor reunión informe noche almuerzo bicicleta reparación otra vez quizás precio descuento pedido entrega deberes primo vecino música estación maletas".split(),
}
