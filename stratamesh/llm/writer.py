"""Training texts with known mentions, written from small grammars of everyday language."""

from __future__ import annotations

import random
import re
import unicodedata

from stratamesh.llm import lexicon as L

# Slots: {N} name, {E} e-mail, {P} phone, {S} insurance number, {K} passport number, {A} address are mentions; {C} place,
# {O} organisation, {T} capitalised phrase, {D} date, {X} code, {Q} amount, {H} small numbers, {B} a number with a letter,
# {Z} nine digits whose check digit fails, {F} words, {G} a given name alone, {U} a family name alone, {R} a street without number are not.
#: What a person or an organisation does; what stands before a person; before a place; kinds of persons.
_DOES = {
    "en": "called|wrote back|arrived late|paid the rent|was born in {C}|works here|has left the team|asked about the {F}|won|is on holiday|bought a {F}|did not answer|teaches {F}|will join us|fixed the {F}|said so|moved to {C}|owes {Q} dollars|, {H}, sings|'s {F}|and {N} are married|was here on {D}|lost a {F}|cooks".split("|"),
    "fr": "a appelé|a répondu|est arrivé en retard|a payé le loyer|est née à {C}|travaille ici|a quitté l'équipe|demande un {F}|a gagné|est en vacances|enseigne la {F}|viendra|habite {C}|doit {Q} euros|et {N} sont mariés|a réparé le {F}|chante|est absente|a perdu son {F}".split("|"),
    "de": "hat angerufen|schrieb zurück|kam zu spät|zahlt die Miete|wurde in {C} geboren|arbeitet hier|fragt nach dem {F}|gewann|ist im Urlaub|kauft ein {F}|kommt mit|wohnt in {C}|schuldet uns {Q} Euro|und {N} heiraten|kocht|war am {D} hier|hat die {F} verloren|singt".split("|"),
    "ru": "позвонил|позвонила|ответила на письмо|опоздал|платит за квартиру|родилась в {C}|работает здесь|спрашивает про {F}|победил|в отпуске|купила {F}|не ответил|переехал в {C}|должен {Q} рублей|и {N} поженились|готовит {F}|заболела|уволился".split("|"),
    "zh": "打来电话|回信了|迟到了|付了房租|出生在{C}|在这里工作|问起{F}|赢了|正在休假|买了{F}|没有回答|搬到了{C}|欠{Q}元|和{N}结婚了|会修理{F}|请假了".split("|"),
    "es": "llamó|respondió|llegó tarde|paga el alquiler|nació en {C}|trabaja aquí|dejó el equipo|pregunta por la {F}|ganó|está de vacaciones|compró un {F}|no contestó|se mudó a {C}|debe {Q} euros|y {N} se casaron|cocina|cantó|estuvo aquí el {D}".split("|"),
}
_WITH = {
    "en": "with|by|for|from|to|and|ask|thank|meet|my friend|photo by|Name:|Contact:|Attn:|Regards,\n|Sincerely,\n|Dear|c/o|Tenant:|Patient:|between {N} and|interview with|according to|invited|Best,\n|Guest:|Hi, I am|My name is|I'm|calls herself|author:|written by|employee".split("|"),
    "fr": "avec|par|pour|de la part de|et|demandez|merci à|mon amie|photo :|Nom :|Contact :|Cordialement,\n|Chère|Patient :|Locataire :|entre {N} et|selon|je m'appelle|Je suis|chez|rendez-vous avec|auteur :|écrit par|salarié :".split("|"),
    "de": "mit|von|für|und|fragen Sie|dank|mein Freund|Foto:|Name:|Kontakt:|Mit freundlichen Grüßen\n|Liebe|Patient:|Mieter:|zwischen {N} und|laut|ich heiße|Ich bin|bei|Termin mit|Autor:|geschrieben von|Kollegin".split("|"),
    "ru": "с|от|для|и|спросите|спасибо,|мой друг|фото:|Имя:|Контакт:|С уважением,\n|Уважаемая|Пациент:|Арендатор:|между {N} и|меня зовут|Я —|у|встреча с|автор:|написал|сотрудник".split("|"),
    "zh": "和|由|给|来自|联系人：|姓名：|患者：|我叫|我是|感谢|采访|作者：|请找|我的朋友|此致\n|房客：|员工|据".split("|"),
    "es": "con|por|para|de parte de|y|pregunte por|gracias a|mi amigo|foto:|Nombre:|Contacto:|Atentamente,\n|Estimada|Paciente:|Inquilino:|entre {N} y|según|me llamo|Soy|cita con|autor:|escrito por|empleado".split("|"),
}
_WHERE = {
    "en": "in|near|at|to|from|outside|via|of|around|across|The train to|The road from|welcome to|weather in|past|The people of|Hotels in|north of|flight to|village|the town of|Island of|parish|District|Station".split("|"),
    "fr": "à|près de|de|vers|depuis|par|Le train pour|bienvenue à|les gens de|météo à|au nord de|Hôtels à|À|Depuis|village de|Commune de|l'île|Gare de|Comté de".split("|"),
    "de": "in|bei|nach|aus|von|über|Der Zug nach|willkommen in|Wetter in|nördlich von|Hotels in|In|Ab|rund um|Stadt|die Gemeinde|die Insel|das Dorf|im Bezirk|der Landkreis|die Siedlung|Die Region|Amt|Schloss|Die Festung".split("|"),
    "ru": "в|возле|из|до|через|поезд в|погода в|жители|дорога на|севернее|В|Из|около|город|посёлок|район|Село|Область|Остров|река".split("|"),
    "zh": "在|到|从|去|附近的|欢迎来到|开往|天气：|自".split("|"),
    "es": "en|cerca de|de|hacia|desde|por|El tren a|bienvenidos a|el tiempo en|al norte de|Hoteles en|En|Desde|la gente de|el pueblo|La isla|Provincia|la aldea".split("|"),
}
_ROLE = {
    "en": "our neighbour|the plumber|engineer|nurse|the tenant|witness|teacher|Mr.|Mrs|Ms.|Dr.|Prof.|Miss|goalkeeper|the late|singer|coach|Captain".split("|"),
    "fr": "notre voisine|le plombier|l'ingénieur|infirmière|le locataire|témoin|M.|Mme|Mlle|le docteur|professeur|la chanteuse|le gardien|Me".split("|"),
    "de": "unsere Nachbarin|der Klempner|Ingenieur|Mieterin|Zeuge|Herr|Frau|Dr.|Prof.|Lehrer|die Sängerin|Trainer|Herrn".split("|"),
    "ru": "наша соседка|сантехник|инженер|медсестра|свидетель|г-н|г-жа|господин|госпожа|доктор|учитель|певица|тренер|гражданин".split("|"),
    "zh": "邻居|工程师|护士|证人|老师|教练|歌手".split("|"),
    "es": "nuestra vecina|el fontanero|ingeniero|enfermera|testigo|Sr.|Sra.|Don|Doña|la doctora|profesor|la cantante|entrenador".split("|"),
}
_OTHER = {
    "en": [
        "Mail {E} for a refund.", "You can reach me at {P} or {E}.", "Email: {E}", "fax {P}", "Phone {P} ({F} hours only)", "Text {P} if the {F} is late.", "My social insurance number: {S}", "SIN {S} on file for {N}.", "Passport no. {K}, holder {N}.", "Lost passport {K} near {C}.",
        "We live at {A} in {C}.", "Deliver to {A}, {C}, before {D}.", "Ship to: {N}, {A}, {C}", "Bill to {N}\n{A}\n{C}", "The shop is at {A}.", "Invoice {X} was paid on {D}.", "Order {X} weighs {H} kg.", "Serial number {X}.", "Version {X} is out since {D}.", "Reference {X}, total {Q} dollars.", "Turn left on {R} after {H} blocks.", "They won {H} to {H} on {R}.",
        "{T} starts on {D}.", "Read the {T} before the {F}.", "{G} said the {F} is cold.", "{U} lost again.", "Do not miss {T}!", "Chapter {H}: {T}", "See you in {C} on {D}.", "About {Q} people came to {C}.", "It costs {Q}, not {Q}.", "In {G} the weather is fine.", "{F} {F} {C} {F}.", "{F} {C} {F} {F} {F}", "Tickets at {X} or from {O}.", "Follow @{F}_{F} for more.", "Rated {H} out of {H}.", "{N} <{E}>", "{N}, {P}", "Write to {N} at {E}.", "Our {F}, {N}, lives at {A}.", "{N} / {E} / {P}", "Passengers: {N}; {N}; {N}", "{N} ({O})", "{N} - {T}", "Was {N} there? No, {N} was.", "I saw {N}.", "{N}!", "Ask {N} or {N}.", "Account {X} of {O}.", "There are {H} {F} in every street.", "{H} {F} along the way", "Page {X} of the {F}.", "Sample {X} was {F}.", "Box {X} is {F}.", "{T} {X} {F}.", "Meeting at {H}:30 with {N} and {G}.",
    ],
    "fr": [
        "Écrivez à {E} pour un remboursement.", "Joignez-moi au {P} ou à {E}.", "Courriel : {E}", "Tél. : {P}", "Mon numéro d'assurance sociale : {S}", "NAS {S} de {N}.", "Passeport no {K}, titulaire {N}.", "Passeport perdu : {K}.", "Nous habitons {A} à {C}.", "Livrer au {A}, {C}, avant le {D}.", "Destinataire : {N}, {A}, {C}", "Le magasin est situé {A}.",
        "Facture {X} payée le {D}.", "Commande {X}, total {Q} euros.", "Numéro de série {X}.", "Boîte {X}, {H} {F}.", "{T} {X} {F}.",  "Tournez à gauche rue {C}.", "{T} commence le {D}.", "{G} dit que le {F} est froid.", "{U} a encore perdu.", "Chapitre {H} : {T}", "Environ {Q} personnes sont venues à {C}.", "{F} {C} {F} {F}.", "{N} <{E}>", "{N}, {P}", "Notre {F}, {N}, habite {A}.", "Passagers : {N} ; {N}", "J'ai vu {N}.", "« {N} est là ? »", "Ça coûte {Q}, pas {Q}.", "L'{F} de {C} ouvre le {D}.",
    ],
    "de": [
        "Mailen Sie an {E}.", "Sie erreichen mich unter {P} oder {E}.", "E-Mail: {E}", "Tel.: {P}", "Sozialversicherungsnummer: {S}", "Reisepass Nr. {K}, Inhaber {N}.", "Verlorener Reisepass: {K}.", "Wir wohnen {A} in {C}.", "Lieferung an {N}, {A}, {C}", "Der Laden ist in der {A}.", "Rechnung {X} vom {D}.", "Bestellung {X}, Summe {Q} Euro.", "Seriennummer {X}.", "Karton {X} ist da.", "Die Firma verkauft seit Mai das Gebäude.", "{T} {X} {F}.",
        "{T} beginnt am {D}.", "{G} sagt, der {F} ist kalt.", "{U} hat wieder verloren.", "Kapitel {H}: {T}", "Etwa {Q} Leute kamen nach {C}.", "{F} {C} {F}.", "{N} <{E}>", "{N}, {P}", "Unsere {F}, {N}, wohnt {A}.", "Gäste: {N}; {N}", "Ich habe {N} gesehen.", "Das kostet {Q}, nicht {Q}.", "Die Alte Schule in {C} ist zu.", "Der {F} liegt auf dem {F}.", "Am {D} ist die {F} in {C} zu.", "Im {F} von {C} steht ein {F}.", "Die {F} der {O} ist neu.",
    ],
    "ru": [
        "Пишите на {E}.", "Мой телефон {P}, почта {E}.", "Почта: {E}", "Тел.: {P}", "Номер социального страхования: {S}", "Паспорт № {K}, владелец {N}.", "Утерян паспорт {K}.", "Мы живём по адресу {A}, {C}.", "Доставка: {N}, {A}, {C}", "Магазин находится: {A}.", "Счёт {X} оплачен {D}.", "Заказ {X}, сумма {Q} рублей.", "Серийный номер {X}.", "Коробка {X} здесь.", "{T} {X} {F}.",
        "{T} начинается {D}.", "{G} говорит, что {F} холодный.", "{U} снова проиграл.", "Глава {H}. {T}", "Около {Q} человек приехало в {C}.", "{F} {C} {F}.", "{N} <{E}>", "{N}, {P}", "Наш {F}, {N}, живёт: {A}.", "Гости: {N}; {N}", "Я видел {N}.", "Это стоит {Q}, а не {Q}.",
    ],
    "zh": [
        "请写信到{E}。", "我的电话是{P}，邮箱{E}。", "电话：{P}", "社会保险号：{S}", "护照号码{K}，持有人{N}。", "遗失护照{K}。", "我们住在{A}。", "送货至{N}，{A}，{C}", "商店地址：{A}。", "发票{X}于{D}付款。", "订单{X}，共{Q}元。", "序列号{X}。", "{T}于{D}开始。", "大约{Q}人来到{C}。", "{F}{C}{F}。", "{N}，{P}", "我看见了{N}。", "{N}先生{F}。", "{N}女士和{N}先生{F}。", "价格是{Q}。", "{C}的{F}很冷。", "{F}于{D}在{C}举行。",
    ],
    "es": [
        "Escriba a {E}.", "Mi teléfono es {P} o {E}.", "Correo: {E}", "Tel.: {P}", "Número de seguro social: {S}", "Pasaporte n.º {K}, titular {N}.", "Pasaporte perdido: {K}.", "Vivimos en {A}, {C}.", "Enviar a {N}, {A}, {C}", "La tienda está en {A}.", "Factura {X} pagada el {D}.", "Pedido {X}, total {Q} euros.", "Número de serie {X}.", "Caja {X} lista.", "{T} {X} {F}.", "{T} empieza el {D}.", "{G} dice que el {F} está frío.", "{U} perdió otra vez.", "Capítulo {H}: {T}",
        "Unas {Q} personas llegaron a {C}.", "{F} {C} {F}.", "{N} <{E}>", "{N}, {P}", "Nuestra {F}, {N}, vive en {A}.", "Invitados: {N}; {N}", "Vi a {N}.", "Cuesta {Q}, no {Q}.",
    ],
}
_LISTS = "NEPSKACOXDGZ"
#: Lists of numbers, for the phone model alone.
LISTED = ["{P} {P}", "{P} {P} {P}", "{P}, {P}.", "{P} / {P}", "{H} {P}", "{H} {P} {P}", "{F}: {P} {P} {P}.", "{H} {P} {H}", "{P} {B} {F}", "{P} {B}", "{H} {H} {F}", "{H} {H}", "{P} {A}", "{P} - {P}", "{F} {P} {F}", "{H} {X}", "{X} {P}", "({P})", "{F}: {P}; {F}: {P}"]
_MONTHS = {"en": "January February March April May June July August September October November December", "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre", "de": "Januar Februar März April Mai Juni Juli August September Oktober November Dezember", "ru": "января февраля марта апреля мая июня июля августа сентября октября ноября декабря", "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre"}
_ORG = {
    "en": ("Northern Central National City Royal First United Local Public Green".split(), "Bank Council Company Library Hospital Office School Museum Union Foundation Club Registry Airlines Insurance Board Press Master Association".split()),
    "fr": ("Grande Première Nouvelle Haute".split(), "Banque Société École Mairie Bibliothèque Compagnie Association".split()),
    "de": ("Städtische Deutsche Neue Erste Alte".split(), "Bücherei Bank Schule Versicherung Gesellschaft Post Kasse".split()),
    "ru": ("Северный Городской Новый Первый Народный".split(), "Банк Совет Завод Музей Комитет Университет Театр".split()),
    "es": ("Gran Nuevo Primer".split(), "Banco Consejo Instituto Hospital Museo Colegio".split()),
}
_ENDS = {"en": ("", "", "son", "ley", "er", "wood", "man", "s"), "fr": ("", "", "eau", "ier", "ard", "et", "ot"), "de": ("", "", "mann", "er", "stein", "ke"), "es": ("", "", "ez", "es", "era", "o"), "zh": ("", ""), "ru": ("ов", "ова", "ин", "ина", "ский", "ская", "енко", "ук", "ев", "ева", "ян", "")}
_CASES = [("", ""), ("а", "а"), ("у", "у"), ("ом", "ым"), ("е", "е")]
KINDS_OF = {"N": "name", "E": "email", "P": "phone", "S": "id_number", "K": "id_number", "A": "address"}


def luhn(digits: str) -> bool:
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def plain(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", s) if c.isascii() and (c.isalnum() or c == "-")).replace("-", "") or "x"


class Writer:
    """Writes texts with the places of their mentions. Given names come from ``given``, the lexicon and a syllable
    generator, so that a name need not be in any list; so do family names and places."""

    def __init__(self, given: list[str], seed: int) -> None:
        self.r = random.Random(seed)
        self.latin = sorted(g for g in given if g[0] < "ʰ") + L.GIVEN_LATIN
        self.cyrillic = sorted(g for g in given if "Ѐ" <= g[0] <= "ӿ") + L.GIVEN_CYRILLIC

    def made(self, lang: str = "en", ends: tuple[str, ...] = ()) -> str:
        r = self.r
        ends = ends or (("", "н", "к", "ш", "в", "р") if lang == "ru" else ("", "n", "r", "th", "ck", "l", "s", "d"))
        if lang == "ru":
            c, v = "б в г д з к л м н п р с т х ст др кр гл".split(), "а е и о у я".split()
        else:
            c, v = "b c d f g h j k l m n p r s t v w z br ch cl dr gr kr sh sl st th tr qu nd mb".split(), "a e i o u ei ou ai é ö á ee ü".split()
            v = v[:5] * 3 + v
        w = "".join(r.choice(c) + r.choice(v) for _ in range(r.choice((1, 2, 2, 2, 3)))) + r.choice(ends)
        return w[:1].upper() + w[1:] if len(w) > 2 else self.made(lang, ends)

    def N(self, lang: str) -> str:
        r, ru = self.r, lang == "ru" and self.r.random() < 0.85
        first = self.made("ru") if ru and r.random() < 0.35 else r.choice(self.cyrillic) if ru else r.choice(self.latin) if r.random() < 0.6 else self.made()
        last = r.choice(L.FAMILY_CYRILLIC if ru else L.FAMILY_LATIN) if r.random() < 0.3 else self.made(lang if ru else "en", _ENDS[lang if ru or lang != "ru" else "en"])
        if r.random() < 0.1:
            last += "-" + self.made("ru" if ru else "en")
        style = r.random()
        if ru and style > 0.75 and first[-1] not in "аяьй":
            a, b = r.choice(_CASES)
            first, last = first + a, last + (b if last.endswith(("ов", "ев", "ин")) else "")
        if style < 0.12:
            return f"{last.upper() if r.random() < 0.6 else last}, {first}"
        if style < 0.18:
            return f"{last} {first}" if r.random() < 0.5 else f"{last.upper()} {first}"
        mid = f" {r.choice('АВГЛНС' if ru else 'ABCDGHJLMQXZ')}." if r.random() < 0.1 else f" {r.choice(self.latin)}" if not ru and r.random() < 0.08 else f" {r.choice(['de', 'van', 'von', 'de la', 'da', 'bin', 'al', 'del', 'du', 'van der'])}" if not ru and r.random() < 0.08 else ""
        if r.random() < 0.05:
            first = f"{first[0]}." + (f" {r.choice('ABCDEHJKLMPRST')}." if not ru and r.random() < 0.6 else "")
            return f"{first} {last}"
        if r.random() < 0.05 and not ru:
            first = f"{first}-{r.choice(self.latin)}"
        s = f"{first}{mid} {last}"
        return s.upper() if style < 0.28 else f"{first}{mid} {last.upper()}" if style < 0.32 else s.lower() if style < 0.4 and first in self.latin + self.cyrillic and "." not in mid else s

    def G(self, lang: str) -> str:
        return self.r.choice(self.cyrillic if lang == "ru" else self.latin)

    def U(self, lang: str) -> str:
        return self.r.choice(L.FAMILY_CYRILLIC if lang == "ru" else L.FAMILY_LATIN)

    def C(self, lang: str) -> str:
        r = self.r
        w = self.made(lang if lang == "ru" else "en", ("", "", "ton", "ville", "berg", "ford", "burg", "n") if lang != "ru" else ("", "ск", "град", "во", "ино"))
        if lang == "ru" and r.random() < 0.8:
            return r.choice([w, w, f"Нижний {w}", f"Великий {w}", f"Новый {w}", f"озеро {w}", f"{w}-на-Дону"])
        g = r.choice(self.latin)
        return r.choice([w, w, w, f"Lake {w}", f"New {w}", f"Port {w}", f"Fort {g}", f"Mount {w}", f"San {w}", f"Saint-{g}", f"Upper {w}", f"{w} Bay", f"{w} River", f"{g} Island", f"{w} Hills", f"{w} Harbour", f"{w} Beach", f"{w} Park", f"{w}-sur-{w[:4]}", f"Bad {w}", f"Cape {g}", f"Puerto {w}", f"{w} County", f"{w}, {self.made()}"])

    def O(self, lang: str) -> str:  # noqa: E743
        r = self.r
        a, n = _ORG.get(lang, _ORG["en"])
        w = self.made(lang if lang == "ru" else "en")
        return r.choice([f"{r.choice(a)} {r.choice(n)}", f"{r.choice(a)} {r.choice(n)}", f"{w} {r.choice(n)}", f"{w} & {self.made()}", f"{w} {r.choice(['Ltd', 'Inc.', 'GmbH', 'Foods', 'Group', 'Motors', 'Hotel', 'SA'])}", w.upper()[:4], f"{r.choice(n)} {r.choice(['of', 'de', 'von', 'für'])} {w}", f"{r.choice(a)} {w} {r.choice(n)}"])

    def T(self, lang: str) -> str:
        r = self.r
        f = [w.capitalize() for w in L.FILLER[lang]]
        return r.choice([r.choice(L.CAPITAL_PAIRS), f"{r.choice(f)} {r.choice(f)}", f"{r.choice(f)} {r.choice(f)} {r.choice(f)}", f"{r.choice(f)} {self.made(lang if lang == 'ru' else 'en')}", f"{r.choice(f).upper()} {r.choice(f).upper()}"])

    def F(self, lang: str) -> str:
        return (" " if lang != "zh" else "").join(self.r.choice(L.FILLER[lang]) for _ in range(self.r.choice((1, 1, 2))))

    def R(self, lang: str) -> str:
        return f"{self.made()} {self.r.choice(L.STREETS_EN).capitalize()}"

    def E(self, lang: str) -> str:
        r = self.r
        a, b = plain(r.choice(self.latin)).lower(), plain(self.made()).lower()
        local = r.choice([f"{a}.{b}", f"{a[0]}{b}", f"{b}_{a}{r.randrange(99)}", f"{a}-{b}", f"{a}+{b[:4]}", a, f"{a}{r.randrange(1900, 2020)}", f"{a}.{b[0]}.{b}", "info", "office"])
        dom = r.choice([[b, "com"], ["mail", b, "net"], [b, "org"], [b, "co", "uk"], [f"{b}-{a}", "de"], [b, "fr"], [b, "example"], [a, b, "edu"], [b, "invalid"], [b, "test"]])
        at, dot = r.choice(["@"] * 14 + ["＠", " (at) ", " [at] ", "[at]", "(at)", " AT ", " at ", " arobase "]), "."
        if at.strip() != "@" and at != "＠" and (r.random() < 0.6 or at in (" AT ", " at ", " arobase ")):
            dot = " [dot] " if "[" in at else " (dot) " if "(" in at else f" {'point' if 'arobase' in at else 'DOT' if at == ' AT ' else 'dot'} "
        s = local + at + dot.join(dom)
        return s.upper() if r.random() < 0.08 and at == "@" else s

    def P(self, lang: str) -> str:
        r = self.r
        d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
        a, b, sep = f"{r.randrange(2, 10)}{d(2)}", f"{r.randrange(2, 10)}{d(2)}", r.choice("---    ..‑\xa0")
        s = r.choice([
            *[sep.join([a, b, d(4)])] * 4, f"({a}) {b}-{d(4)}", f"({a}){b}-{d(4)}", f"+1 {a} {b} {d(4)}", f"+1-{a}-{b}-{d(4)}", f"1-{a}-{b}-{d(4)}", f"1 {a} {b} {d(4)}", f"+1{a}{b}{d(4)}", f"+1 ({a}) {b}-{d(4)}", f"020 {d(4)} {d(4)}", f"07{d(3)} {d(6)}", f"+44 20 {d(4)} {d(4)}", f"+44 (0)20 {d(4)} {d(4)}", f"+44 7{d(3)} {d(6)}",
            sep.join(["0" + r.choice("1234567"), d(2), d(2), d(2), d(2)]), f"+33 {r.choice('1234567')} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(2)}/{d(7)}", f"0{d(3)} {d(6)}", f"+49 (0){d(2)} {d(4)} {d(3)}", f"+49 {d(3)} {d(7)}", f"8 ({d(3)}) {d(3)}-{d(2)}-{d(2)}", f"+7 {d(3)} {d(3)}-{d(2)}-{d(2)}", f"8-{d(3)}-{d(3)}-{d(2)}-{d(2)}", f"1{r.randrange(3, 10)}{d(9)}", f"1{r.randrange(3, 10)}{d(1)} {d(4)} {d(4)}", f"+86 1{r.randrange(3, 10)}{d(1)} {d(4)} {d(4)}", f"010-{d(8)}",
            f"+34 {r.choice('679')}{d(2)} {d(3)} {d(3)}", f"{r.choice('679')}{d(2)} {d(3)} {d(3)}", f"9{d(1)} {d(3)} {d(2)} {d(2)}", f"0{d(2)} {d(6)}", f"0{d(2)} {d(4)} {d(3)}", f"+{r.randrange(20, 99)} {d(5)} {d(5)}", f"+{r.randrange(200, 999)} {d(2)} {d(3)} {d(4)}", f"+{r.randrange(200, 999)} {d(3)} {d(3)} {d(3)}", f"8 {d(3)} {d(3)}-{d(2)}-{d(2)}", f"+{r.randrange(20, 99)} {d(2)} {d(5)} {d(4)}", f"0{d(2)}-{d(8)}", f"{r.choice('69')}{d(2)} {d(2)} {d(2)} {d(2)}", f"+{r.randrange(20, 99)} {d(2)} {d(3)} {d(4)}",
        ])
        return s + (f" ext. {r.randrange(100, 999)}" if r.random() < 0.06 else "")

    def nine(self, good: bool) -> str:
        while True:
            d = f"{self.r.randrange(10**8, 10**9) if self.r.random() < 0.7 else self.r.randrange(10**8):09d}"
            if luhn(d) == good:
                return self.r.choice(["", "-", " ", " ", "\xa0"]).join([d[:3], d[3:6], d[6:]])

    def S(self, lang: str) -> str:
        return self.nine(True)

    def Z(self, lang: str) -> str:
        return self.nine(False)

    def K(self, lang: str) -> str:
        r = self.r
        letters = "".join(r.choice("ABCDEFGHJKLMNPRSTVWXYZ") for _ in range(r.choice((1, 2, 2, 2, 3))))
        if r.random() < 0.1:
            return r.choice(["{0}{1}{2}", "{1}{0}{2}"]).format(str(r.randrange(10, 99)), letters[:2].ljust(2, "F"), str(r.randrange(10**4, 10**5)))
        return letters + r.choice(["", "", " "]) + str(r.randrange(10**5, 10**8)).zfill(6)

    def A(self, lang: str) -> str:
        r, w = self.r, self.made()
        num = f"{r.choice([r.randrange(1, 30), r.randrange(1, 400), r.randrange(1, 15000)])}"
        own = r.random() < 0.8
        if lang == "fr" and own:
            return f"{num}{r.choice(['', '', '', ' bis', ' ter', 'A'])}{r.choice([' ', ', '])}{r.choice(['rue', 'chemin', 'avenue', 'boul.', 'boulevard', 'place', 'allée', 'impasse', 'quai', 'route', 'Rue', 'av.'])} {r.choice(['', '', 'de ', 'du ', 'de la ', 'des ', 'Jean '])}{w}"
        if lang == "de" and own:
            return r.choice([f"{w}{r.choice(['straße', 'strasse', 'weg', 'str.', 'platz', 'allee', 'gasse'])}", f"{w}er {r.choice(['Straße', 'Weg', 'Allee', 'Platz', 'Str.'])}"]) + f" {num}{r.choice(['', '', 'a', ' b'])}"
        if lang == "ru" and own:
            w = self.made("ru", ("ая", "ова", "ина", "ский", "а"))
            return r.choice([f"ул. {w}, д. {num}", f"улица {w}, дом {num}", f"ул. {w}, {num}", f"проспект {w}, {num}", f"пер. {w}, д. {num}", f"{w} улица, дом {num}", f"пр. {w}, д.{num}", f"наб. {w}, {num}"])
        if lang == "zh" and own:
            name = r.choice([w, "".join(r.choice("中山北京人民建设解放南东西新华光明") for _ in range(2))])
            return f"{name}{r.choice(['街', '路', '大道', '巷'])}{num}号"
        if lang == "es" and own:
            return f"{r.choice(['Calle', 'Avenida', 'Av.', 'Plaza', 'Paseo', 'calle', 'Camino', 'C/'])} {r.choice(['', '', 'de ', 'del ', 'de la ', 'San '])}{w}{r.choice([', ', ' ', ', n.º '])}{num}"
        s = f"{num}{r.choice(['', '', '', 'B', '½', '-A'])} {r.choice(['', '', '', 'North ', 'Old '])}{r.choice([w, w, f'{w} {self.made()}', 'Main', 'King', 'Park', 'Mill', 'Church'])} {r.choice(['Street', 'Road', 'Blvd', 'Court', 'Lane', 'Avenue', 'St.', 'Rd', 'Drive', 'Crescent', 'Ave', 'Way', 'Place', 'Close', 'Terrace', 'Square'])}{r.choice(['', '', '', ' N', ' West', ' SE'])}"
        return s.upper() if r.random() < 0.08 else s.lower() if r.random() < 0.05 else s

    def D(self, lang: str) -> str:
        r = self.r
        m, day, year = r.choice(_MONTHS.get(lang, _MONTHS["en"]).split()), r.randrange(1, 29), r.randrange(1700, 2030)
        if lang == "zh":
            return f"{year}年{r.randrange(1, 13)}月{day}日"
        if r.random() < 0.3:
            return r.choice([f"{year}-{r.randrange(1, 13):02d}-{day:02d}", f"{day:02d}.{r.randrange(1, 13):02d}.{year}", f"{r.randrange(1, 13)}/{day}/{year}"])
        return f"{m} {day}, {year}" if lang == "en" else f"{day}. {m} {year}" if lang == "de" else f"{day} de {m} de {year}" if lang == "es" else f"{day} {m} {year}"

    def Q(self, lang: str) -> str:
        n = self.r.choice([self.r.randrange(100), self.r.randrange(10**4), self.r.randrange(10**7)])
        return f"{n:,}".replace(",", {"en": ",", "de": ".", "es": ".", "zh": ""}.get(lang, self.r.choice(" \xa0")))

    def H(self, lang: str) -> str:
        return " ".join(str(self.r.choice([self.r.randrange(2, 20), self.r.randrange(2, 100), self.r.randrange(2, 3000)])) for _ in range(self.r.choice((1, 1, 2, 3))))

    def B(self, lang: str) -> str:
        return f"{self.r.randrange(1, 100)}{self.r.choice(['th', 'nd', 'B', 'a', 'e', 'st', 'er'])}"

    def X(self, lang: str) -> str:
        r = self.r
        d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
        return r.choice([
            self.nine(False), self.nine(False), self.K(lang), self.K(lang), f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", f"ISBN 978{d(10)}", f"{r.uniform(0, 80):.4f}, -{r.uniform(0, 170):.4f}", f"{d(1)}.{d(2)}.{d(1)}.{d(3)}", f"192.168.{r.randrange(255)}.{r.randrange(255)}", f"@{self.made().lower()}", f"{d(2)}@{d(2)}kg",
            f"{r.choice('ABD')}-{d(2)}/{r.randrange(1700, 1999)}", f"{r.choice('ABX')}{r.choice('NXW')}-{d(5)}", f"{r.randrange(16**12):012x}", d(20), d(16), f"{d(4)} {d(4)} {d(4)} {d(4)}", f"#{d(6)}", f"{d(2)}:{d(2)}:{d(2)}", f"{d(3)},{d(3)},{d(3)}", f"1:{d(2)} {d(3)}", f"{d(4)}-{d(4)}-{d(4)}", f"{self.made()}{d(3)}@", f"{d(3)}/{d(3)}/{d(4)}", f"${d(3)},{d(3)}.{d(2)}", d(7), f"DE{d(20)}",
        ])

    def sentence(self, lang: str) -> str:
        r = self.r
        does, with_, where, role = (r.choice(t[lang]) for t in (_DOES, _WITH, _WHERE, _ROLE))
        role = role[:1].upper() + role[1:] if r.random() < 0.4 else role
        gap, dot = ("", "。") if lang == "zh" else (" ", ".")
        kind = r.random()
        who = r.choice(["{N}", "{N}", "{N}", "{O}", "{O}", "{C}", "{T}", f"{role}{gap}{{N}}", "{G}"])
        if kind < 0.25:
            return f"{who}{'' if does[0] in ',' + chr(39) else gap}{does}{dot}"
        if kind < 0.42:
            end = r.choice(["{F}", does, "", "{D}", f"{where}{gap}{{C}}"])
            return f"{r.choice(['{F}', '', '', ''])}{gap}{with_}{gap}{r.choice(['{N}', '{N}', '{N}', '{O}', '{C}', '{T}'])}{gap if end else ''}{end}{dot}"
        if kind < 0.57:
            return f"{r.choice(['{F}', '', '{D}'])}{gap}{where}{gap}{{C}}{r.choice([gap, ','])}{gap}{r.choice(['{F}', '{O} ' + does, '{N} ' + does, '{T}'])}{dot}"
        if kind < 0.6:
            slot, sep = "{" + r.choice(_LISTS) + "}", r.choice([", ", ", ", "; ", " / ", "\n", "，" if lang == "zh" else ", "])
            word = r.choice([w for t in (L.PASSPORT, L.INSURANCE) for w in t]) if slot in ("{K}", "{S}", "{Z}") else ""
            each = r.random() < 0.5
            head = r.choice([f"{{F}}: ", f"{{O}}: ", f"{does}: " if "{" not in does else "", ""]) if not word or each else f"{word}: "
            items = [f"{word} {slot}" if each and word else slot for _ in range(r.choice((2, 3, 4, 5)))]
            return head + sep.join(items) + r.choice([dot, ""])
        if kind < 0.65:
            return f"{r.choice(['{N}', '{O}', '{C}', '{T}'])}{r.choice([', ', ' ', ' / ', '\n'])}{r.choice(['{N}', '{O}', '{C}', '{T}'])}{r.choice([', ', ' ', ' / ', '\n'])}{r.choice(['{N}', '{O}', '{C}', '{P}', '{A}', '{E}'])}"
        return r.choice(_OTHER[lang])

    def text(self, listed: bool = False) -> tuple[str, set[tuple[str, int, int]]]:
        lang = self.r.choices(["en", "fr", "de", "ru", "zh", "es"], [5, 4, 3, 3, 2, 3])[0]
        out, spans = "", set()
        for _ in range(self.r.choice((1, 2, 3))):
            s = self.r.choice(LISTED) if listed else self.sentence(lang)
            for part in re.split(r"(\{[A-Z]\})", s):
                if not re.fullmatch(r"\{[A-Z]\}", part):
                    out += part
                    continue
                w = getattr(self, part[1])(lang)
                if part[1] in KINDS_OF:
                    spans.add((KINDS_OF[part[1]], len(out), len(out) + len(w)))
                out += w
            out += self.r.choice([" ", " ", " ", " ", "  ", "\n", "\n", "" if out[-1:] in ".。!?" else " "])
        return out, spans
