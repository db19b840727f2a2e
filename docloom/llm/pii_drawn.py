"""Drawn texts with labelled spans, on which the tagger of ``pii`` is trained.

Sentences are put together from function words, ordinary and made-up words, and the fields wanted, in any order; beside
them stand look-alikes without a label: numbers of papers, firms, places, projects, headings, amounts and dates.
"""

from __future__ import annotations

import random

import numpy as np

from .pii import FIRMS, FUNCTION, GIVEN, KINDS, MONTHS, PLACES, WORD_KINDS, word_kinds

ONSETS = "b br c ch d dr f fl g gr h j k kl kr l m n p qu r s sch sh sk sp st t tr th v w wh y z".split()
VOWELS = "a e i o u ar el en er im in or ul un ai ea ee oo ou ie".split()
LATIN = "ü ö ø ô é á ñ å ä".split()
NAME_ENDS = "son sen berg mann ström ez ova ev ski sky ini etti eau ard dottir wick holt by lin rup vane ano ell ist ardi eck mont ano wood ley man er es a o i ic ov enko shvili akis oglu".split()
PLACE_ENDS = "ton ham field mouth bury ford wick stead dale port ville stadt heim hagen grad abad vik by dorf ness pool combe mere burg well moor spit deep row vick".split()
WORD_ENDS = "ing ed er s ion ment ness al ly ful less able ive ity ure age ance ship y le t d n".split()
# Everyday words in lower case.
EVERYDAY = "account answer apple area article attic barn basket bell bench boat book bottle bread bridge brush bucket button cabinet camera candle card carpet chair change check clock cloth coat coffee colour corner cost country cup curtain day desk dinner door dress drink engine evening farm fence field film fire floor flower fork friend fruit garden glass grass group hall hand hat heat home horse hotel hour house idea inch iron jacket job juice key kitchen knife lamp leaf lesson letter light line list lock machine mail map meal meat meeting metal milk minute money month morning mountain music nail needle news night noise note office oil orange oven owner paint pair paper park part pen phone photo picture piece pipe plan plant plate price problem question rain reason rent rice ring river road roof room rope rule salt sand school screen seat shape sheet shelf ship shirt shoe shop side sign silver size sky snow soap song soup space spoon spring stage stamp star station steam step stick stone store storm story sugar summer sun table tail tea team test thing ticket time tool town toy train tree trip truck visit voice wall watch water way week wheel wind window winter wood word work world year".split()
DOING = "add ask bake begin boil borrow bring build burn buy call carry catch choose clean climb close collect cook count cover cut dance draw drive drop dry eat feed fill find fix fold follow give grow hang heat help hide hold keep kick lead learn leave lend lift look lose make mark measure meet mend mix move need offer open pack park pass pay pick plant play pour press pull push put raise reach read rest ride roll run save sell send serve set sew shake share show shut sing sit sort spend stand start stay stop store study sweep take teach tell tie touch turn type use visit wait walk want wash watch wear weigh win wish work wrap write".split()
LIKE = "big blue bright brown busy calm cheap clean clear cold cool dark dear deep dry early easy empty fair false fast final fine flat free fresh full good great green grey happy hard heavy high hot kind large late light local long loud low narrow near neat new nice odd old open plain poor proud quick quiet rare raw red rich right ripe rough round safe sharp short slow small soft sour steep still strong sweet tall thick thin tight tiny true warm weak wet wide wild wise wrong young".split()
FRIDAYS = "Monday Tuesday Wednesday Thursday Friday Saturday Sunday Montag Dienstag Mittwoch lundi martes".split()
LEADS = {
    "person": "signed by|from|to|by|with|for|and|or|ask|meet|thanks to|according to|prepared by|written by|sent to|handed to|contact|dear|regards,|yours,|sincerely,|attn|cc|my name is|this is|i am|on behalf of|is|did|was|has|that|when|because|,|;|".split("|"),
    "email": "at|to|write to|mail|e-mail|email|via|reach|cc|from|under|using|and|or|by|:|(|;|".split("|"),
    "phone": "call|ring|on|at|dial|phone|tel.|mobile|text|under|reach me on|via|or|and|fax|with|:|(|;|".split("|"),
    "address": "at|lives at|to|moved to|of|from|near|in|deliver to|ship to|sent to|, of|,|is|:|(|;|or|and|".split("|"),
    "identity": "with|my|the|under|has|gave|shows|and|about|(|:|;|".split("|"),
}
LABELS = {
    "email": "E-mail|Email|Mail|E-Mail|Email address|Mail address".split("|"), "phone": "Phone|Tel|Tel.|Mobile|Telephone|Telefon|Fax|Cell|Contact number|Phone no.".split("|"), "identity": "Identity|ID|ID document|Identification|Proof of ID|Identity proof|Proof of identity|Document".split("|"),
    "address": "Address|Home|Residence|Anschrift|Home address|Street|Postal address|Delivery to".split("|"), "person": "Name|Full name|Applicant|Holder|Account holder|Customer|Owner|Contact|Signed|Guest|Patient|Member|Author".split("|"),
}
ODD_LABELS = "Rate|Amount|Term|Total|Product|Reference|Branch|Bank|Company|Project|Place|Ticket|Invoice|Order no.|Application number|Serial|Date|Status|Tenure in months|Team|Version|Pages|Firm|Supplier".split("|")
CONFUSED = [("l", "1"), ("o", "0"), ("s", "5"), ("e", "c"), ("m", "rn"), ("i", "!"), ("t", "†"), ("h", "li"), ("w", "vv"), ("a", "@")]


class Drawer:
    """Draws texts; ``usual`` are the made-up words that stand for ordinary ones."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.usual = set(EVERYDAY) | set(DOING) | set(LIKE)
        self.made = [self.word() for _ in range(3000)]
        self.usual |= set(self.made[:2700])

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def letters(self, n: int) -> str:
        return "".join(self.r.choice("ABCDEFGHJKLMNPQRSTUVWXYZ") for _ in range(n))

    def word(self) -> str:
        pick = self.r.choice
        return "".join(pick(ONSETS) + pick(VOWELS) for _ in range(self.r.randint(1, 2))) + pick(WORD_ENDS)

    def common(self) -> str:
        x = self.r.random()
        return self.r.choice(EVERYDAY if x < 0.35 else DOING if x < 0.5 else LIKE if x < 0.65 else self.made)

    def coined(self, ends: list[str] = NAME_ENDS) -> str:
        pick = self.r.choice
        return (pick(ONSETS) + (pick(VOWELS) if self.r.random() < 0.85 else pick(LATIN)) + (pick("l n r s t m v nd rt".split()) if self.r.random() < 0.5 else "") + pick(ends)).capitalize()

    def words(self, least: int, most: int) -> str:
        return " ".join(self.r.choice(FUNCTION) if self.r.random() < 0.4 else self.common() for _ in range(self.r.randint(least, most)))

    # fields

    def person(self) -> str:
        r, pick = self.r, self.r.choice
        family = lambda: self.coined() + (f"-{self.coined()}" if r.random() < 0.12 else "")
        given = pick(GIVEN) if r.random() < 0.85 else self.coined()
        x = r.random()
        if x < 0.5:
            s = f"{given} {family()}"
        elif x < 0.63:
            s = f"{given} {pick('ABCDEFGHIJKLMNOPRSTUVW')}. {family()}"
        elif x < 0.8:
            s = f"{family()}, {given}"
        elif x < 0.95:
            s = f"{pick(['Mr', 'Mrs', 'Ms', 'Miss', 'Mr.', 'Mrs.', 'Ms.', 'Dr.', 'Dr', 'Prof.', 'Herr', 'Frau'])} {family() if r.random() < 0.8 else given + ' ' + family()}"
        elif x < 0.98:
            s = f"{given} {pick(['van', 'de', 'von', 'da', 'van der', 'del'])} {family()}"
        else:
            s = f"{pick(['Иван', 'Анна', 'Ольга', 'Пётр', 'Мария', 'Олег'])} {pick(['Петров', 'Соколова', 'Иванов', 'Кузнецова', 'Лебедев'])}"
        return s.upper() if r.random() < 0.14 else s

    def email(self) -> str:
        r, pick = self.r, self.r.choice
        a, b = pick(GIVEN).lower(), self.coined().lower()
        user = pick([f"{a}.{b}", f"{a}_{b}", f"{a}-{b}", f"{a[0]}{b}", f"{b}{self.digits(2)}", f"{a}+{pick(EVERYDAY)}", pick(EVERYDAY), pick("helpdesk info office sales support team admin ops contact".split()), b, f"{a}{self.digits(4)}"])
        host = self.coined(PLACE_ENDS).lower() + pick(["", "", "-mail", "-post", "-" + pick(EVERYDAY)]) + pick([".example", ".example", ".test", ".invalid", ".co.example", ".com", ".org", ".net", ".de", ".co.uk", ".fr", ".io"])
        x = r.random()
        s = f"{user}@{host}" if x < 0.58 else f"{user} (at) {host}" if x < 0.72 else f"{user} [at] {host.replace('.', ' [dot] ')}" if x < 0.86 else f"{user} at {host.replace('.', ' dot ')}" if x < 0.95 else f"{user}(at){host.replace('.', '(dot)')}"
        return s.upper() if r.random() < 0.14 else s

    def phone(self) -> str:
        d, r = self.digits, self.r
        return r.choice([
            lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"{d(3)}.{d(3)}.{d(4)}", lambda: f"+1 {d(3)} {d(3)} {d(4)}", lambda: f"+1{d(10)}", lambda: f"+44 {d(4)} {d(6)}", lambda: f"+49 (0){d(2)} {d(4)} {d(3)}",
            lambda: f"{d(3)}-{d(4)} ext. {d(2)}", lambda: f"{d(3)}-{d(4)} x{d(3)}", lambda: f"0{d(3)} {d(3)} {d(4)}", lambda: f"+33 {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", lambda: f"{d(3)}-{d(4)}", lambda: f"+{d(2)} {d(3)} {d(3)} {d(3)}", lambda: f"0{d(2)}/{d(7)}",
        ])()

    def identity(self) -> tuple[str, str]:
        """What stands before the number, and the number."""
        d, l, pick = self.digits, self.letters, self.r.choice
        cue, number = pick([
            lambda: (pick("social security number|SSN|SSN:|social security no.|SSN #|Social Security".split("|")), pick([f"{d(3)}-{d(2)}-{d(4)}", d(9)])),
            lambda: (pick("national ID|ID number|ID card|identity number|national identity no.|ID:|ID no.".split("|")), pick([f"{d(4)} {d(4)} {d(4)}", d(11), f"{l(1)}{d(8)}"])),
            lambda: (pick("tax ID|tax number|Steuernummer|tax no.|TIN".split("|")), pick([f"{d(2)}/{d(3)}/{d(5)}", f"{d(2)} {d(3)} {d(3)} {d(3)}"])),
            lambda: (pick("passport no.|passport|passport number|Passport:|Reisepass".split("|")), l(2) + d(7)), lambda: (pick("driving licence|driver's license|licence no.|driving license number|licence".split("|")), f"{l(1)}{d(3)}-{d(3)}-{d(3)}"),
            lambda: (pick("national insurance number|NINO|national insurance no.".split("|")), pick([f"{l(2)} {d(2)} {d(2)} {d(2)} {l(1)}", f"{l(2)}{d(6)}{l(1)}"])),
        ])()
        return cue + (": " if cue[-1] not in ":#" and self.r.random() < 0.15 else " "), number

    def place(self) -> str:
        pick, c = self.r.choice, lambda: self.coined(PLACE_ENDS)
        return pick([c, c, lambda: f"{c()} {pick(PLACES)}", lambda: f"{pick(PLACES)} {c()}", lambda: f"{pick(PLACES)} {pick(PLACES)}", lambda: f"{pick(EVERYDAY).capitalize()} {pick(PLACES)}"])()

    def address(self) -> str:
        r, pick, d = self.r, self.r.choice, self.digits
        n = str(r.randint(1, 999 if r.random() < 0.9 else 9999)) + (pick("ABCD") if r.random() < 0.12 else "")
        street = lambda: (pick(EVERYDAY).capitalize() if r.random() < 0.55 else self.coined()) + (" " + pick(EVERYDAY).capitalize() if r.random() < 0.06 else "")
        road = pick("Street Avenue Lane Road Rd Ave Drive Square Court Way Terrace Close Place Boulevard Crescent Row St".split())
        flat = pick(["Apt.", "Apt", "Flat", "Unit", "Suite"])
        s = pick([
            lambda: f"{n} {street()} {road}, {self.place()}", lambda: f"{n} {street()} {road}, {self.place()} {d(5)}", lambda: f"{street()}{pick(['straße', 'strasse', 'weg', 'platz', 'gasse', 'allee'])} {n}, {d(5)} {self.place()}", lambda: f"{n} rue {pick(['de la ', 'du ', 'des ', ''])}{street()}, {self.place()}",
            lambda: f"Flat {r.randint(1, 60)}, {n} {street()} {road}, {self.place()}", lambda: f"{n} {street()} {road}, {flat} {r.randint(1, 60)}", lambda: f"{n} {street()} {road}", lambda: f"{pick(['Calle', 'Avenida', 'Plaza', 'Via'])} {street()} {n}, {self.place()}", lambda: f"{n} {street()} {road}, {flat} {r.randint(1, 60)}, {self.place()} {d(5)}",
        ])()
        return s.upper() if r.random() < 0.03 else s

    def field(self, kind: str) -> list:
        if kind == "identity":
            cue, number = self.identity()
            return [cue, (kind, number)]
        return [(kind, getattr(self, kind)())]

    # look-alikes

    def firm(self) -> str:
        return f"{self.coined(NAME_ENDS + PLACE_ENDS)} {self.r.choice(FIRMS)}" + (f" {self.r.choice(FIRMS)}" if self.r.random() < 0.1 else "")

    def plain(self) -> str:
        """Something with digits or capitals that is no field."""
        r, pick, d, l = self.r, self.r.choice, self.digits, self.letters
        cap = lambda: self.common().capitalize()
        return pick([
            lambda: f"{pick(['invoice', 'Invoice', 'order', 'tracking', 'batch', 'shipment'])} {pick(['', 'no. ', 'number '])}{pick([f'{d(4)} {d(4)} {d(4)}', d(10), f'{d(3)}-{d(4)}', f'{d(5)}'])}", lambda: f"{pick(['serial', 'Serial', 'serial number', 'Serial no.'])} {pick([f'{d(3)}-{d(2)}-{d(4)}-{d(2)}', f'{l(2)}{d(7)}', f'{d(3)}-{d(2)}-{d(4)}'])}",
            lambda: f"{pick(['build', 'Build', 'version', 'release', 'v'])} {r.randint(1, 20)}.{r.randint(0, 99)}.{d(2)}.{d(r.randint(1, 4))}", lambda: f"{pick(['ticket', 'Ticket', 'case', 'issue', 'reference', 'application', 'Application number:', 'application number'])} {l(3)}-{d(r.randint(4, 7))}", lambda: f"{pick(['ticket', 'case', 'application', 'policy', 'account'])} {pick(['', 'no. ', 'number '])}{d(r.randint(5, 10))}",
            lambda: f"{pick(['part', 'model', 'item', 'article'])} {pick([f'{d(3)}-{d(4)}', f'{l(1)}{d(3)}-{d(3)}-{d(3)}', f'{d(4)} {d(3)}'])}", lambda: f"{r.randint(1, 31)} {pick(MONTHS)} {r.randint(1900, 2040)}", lambda: f"{pick(MONTHS)} {r.randint(1, 31)}", lambda: f"20{d(2)}-0{r.randint(1, 9)}-1{d(1)}", lambda: f"0{r.randint(1, 9)}/1{d(1)}/20{d(2)}",
            lambda: f"{r.randint(1, 99)},{d(3)}", lambda: f"{r.randint(1, 99)},{d(3)},{d(3)}", lambda: f"{r.randint(1, 99)}.{d(1)} percent", lambda: f"{d(7)} {self.common()}", lambda: f"{r.randint(1, 999)} {self.common()} {pick(['', 'on the street', 'in the road', 'of the square'])}", lambda: f"{pick(['Section', 'Clause', 'Table', 'Page', 'Figure', 'page', 'section'])} {r.randint(1, 99)}{pick(['', '.' + d(1), '.' + d(2) + '.' + d(1)])}",
            lambda: f"@{self.common()}", lambda: f"{r.randint(2, 99)} {self.common()}, {r.randint(2, 99)} {self.common()} and {pick(['one', 'a', 'some', str(r.randint(2, 99))])} {self.common()}", lambda: f"{r.randint(2, 99)} {self.common()}, {r.randint(2, 99)} {self.common()}", lambda: f"with {r.randint(2, 99)} {self.common()}. {cap()},",
            lambda: f"{r.randint(2, 99)} {pick(['Prozent', 'Seiten', 'Tage', 'Blätter', 'Fälle', 'pages', 'páginas', 'jours', 'casos', 'días'])}", lambda: d(r.randint(12, 24)), lambda: "".join(pick("abcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(r.randint(20, 90))), lambda: self.common() * r.randint(1, 2) + d(r.randint(1, 3)), lambda: f"{pick(['im', 'am', 'in', 'at', 'near', 'bei', 'vom', 'zum'])} {pick([cap, self.coined])()} {pick(['Süd', 'Nord', 'Ost', 'West', 'Station', 'Centre', 'Market', 'Terminal', 'Hall', 'Airport'])}",
            lambda: f"in {r.randint(1900, 2040)}. {cap()} {self.words(1, 3)}", lambda: f"of {r.randint(1900, 2040)}. {pick(['The', 'It', 'Two', 'Each', 'No', 'In'])} {cap() if r.random() < 0.3 else self.common()}", lambda: f"{self.place()}. {cap()} {self.words(1, 3)}", lambda: f"In {self.place()}, {self.words(1, 3)}", lambda: f"in {self.place()}, {self.words(1, 3)}", lambda: f"{self.words(1, 3)} {d(4)}: {cap()} {cap()}",
            lambda: self.script(), lambda: self.script(), lambda: self.script(), lambda: f"{cap()} und {cap()}", lambda: f"{self.coined(PLACE_ENDS)}, {self.coined(PLACE_ENDS)} and {self.place()}", lambda: f"{self.firm()} — {cap()} {cap()}", lambda: f"{self.firm()}, {self.firm()} and {self.firm()}", lambda: f"{r.randint(1, 9)} @ {d(2)}.{d(2)}", lambda: f"[{pick(['SOURCE ', 'source ', ''])}{r.randint(1, 20)}]", lambda: f"{r.randint(0, 23)}:{d(2)}", lambda: f"https://{self.common()}.example/{self.common()}/{d(3)}", lambda: f"{l(3)}-{d(4)}", lambda: f"{l(2)}{d(2)}",
            self.firm, self.firm, self.firm, self.place, self.place, lambda: f"Project {self.coined()}", lambda: f"Project {cap()}", lambda: f"{cap()} {cap()}", lambda: f"the {self.common()} {pick(['team', 'desk', 'office', 'crew', 'panel', 'unit', 'group', 'board'])}", lambda: f"the {cap()} {pick(['Team', 'Desk', 'Office', 'Committee'])}",
            lambda: f"{cap()} {pick(STREETS_PLAIN)}", lambda: pick(FRIDAYS), lambda: f"{pick(MONTHS)} and {pick(MONTHS)}", lambda: f"{self.place()} and {self.place()}", lambda: f"{self.firm()} and {self.firm()}", lambda: f"„{cap()} im {cap()} {pick(['Süd', 'Nord', 'Ost', 'West'])}“", lambda: f"\"{cap()} {self.words(1, 3)}\"", lambda: f"{self.coined(PLACE_ENDS)}'s {self.common()}",
            lambda: pick(["Das Lager", "Der Bericht", "Die Prüfung", "Ein Vertrag", "L'usine", "La Factura", "El Almacén", "Le Contrat", "Los Datos", "Tout"]) + f" {self.words(1, 4)} {cap()}", lambda: pick(["Сервер работает", "Отчёт готов", "Договор подписан", "報告書", "合同已签署", "उत्तर", "รายงาน", "В пункте 12"]),
        ])()

    def script(self) -> str:
        """Text in another script, with or without numbers."""
        r = self.r
        low, high = r.choice([(0x4E00, 0x9000), (0x3041, 0x3094), (0x0E01, 0x0E2E), (0x0905, 0x0939), (0x0430, 0x044F), (0x0430, 0x044F), (0x05D0, 0x05EA), (0x0627, 0x064A), (0xAC00, 0xD000)])
        runs = ["".join(chr(r.randint(low, high)) for _ in range(r.randint(2, 9))) for _ in range(r.randint(1, 6))]
        if low == 0x0430 and r.random() < 0.7:
            runs[0] = runs[0].capitalize()
        for _ in range(r.randint(0, 2)):
            runs.insert(r.randrange(len(runs) + 1), str(r.randint(1, 999)))
        return ("" if 0x3000 < low < 0xA000 or low == 0x0E01 else " ").join(runs) + r.choice(["。", "", "।", "."])

    def sentence(self) -> list:
        """Words with or without look-alikes and fields."""
        r, pick = self.r, self.r.choice
        out: list = []
        x = r.random()
        say = lambda s, first=False: out.append((" " if out else "") + s)
        if x < 0.5:  # no field
            n = r.randint(0, 4)
            if r.random() < 0.6:
                say(self.words(1, 5))
            for _ in range(n):
                say(self.plain())
                if r.random() < 0.75:
                    say(self.words(1, 5))
                elif r.random() < 0.3:
                    out.append(",")
            if not out:
                say(self.words(3, 9))
        else:
            if r.random() < 0.6:
                say(self.words(1, 5))
            if r.random() < 0.25:
                say(self.plain())
            kinds = r.choices(KINDS, [3, 2, 2, 2, 4], k=1 if r.random() < 0.6 else r.randint(2, 3))
            for i, kind in enumerate(kinds):
                lead = pick(LEADS[kind])
                if i == 0 and lead in ",;:":
                    lead = ""
                if lead in (",", ";", ":") or lead.startswith(", "):
                    out.append(lead)
                elif lead == "(":
                    say("(")
                elif lead:
                    say(lead)
                if out and out[-1] != " (":
                    out.append(" ")
                out += self.field(kind)
                if lead == "(":
                    out.append(")")
                if r.random() < 0.4:
                    say(self.words(1, 4)) if r.random() < 0.75 else say(self.plain())
            if r.random() < 0.5:
                if r.random() < 0.35:
                    out.append(",")
                say(self.words(1, 6))
            if r.random() < 0.15:
                say(self.plain())
        out.append(pick([".", ".", ".", ".", "?", "!", "", "", ":", ";"]))
        if isinstance(out[0], str) and out[0] and r.random() < 0.8:
            out[0] = out[0][0].upper() + out[0][1:]
        if r.random() < 0.05:
            out = [p.upper() if isinstance(p, str) else p for p in out]
        return out

    def form(self) -> list:
        """Label and value lines, table rows and lists."""
        r, pick = self.r, self.r.choice
        join = pick([": ", ": ", "\n", " ", " | ", "\t", " - "])
        out: list = []
        for _ in range(r.randint(1, 5)):
            bar = join == " | "
            if r.random() < 0.55:
                kind = pick(KINDS)
                label, value = pick(LABELS[kind]), self.field(kind)
            else:
                label, value = pick(ODD_LABELS), [pick([self.firm, self.place, self.plain, self.plain, lambda: self.words(1, 3), lambda: f"{r.randint(1, 99)}.{self.digits(1)}", lambda: f"{self.letters(3)}-{self.digits(4)}", lambda: f"{r.randint(1, 99)},{self.digits(3)}", lambda: f"{self.letters(3)}-{self.digits(7)}", lambda: str(r.randint(1, 120))])()]
            if r.random() < 0.1:
                label = label.upper()
            out += [("| " if bar else "") + label + join, *value, " |\n" if bar else "\n"]
        return out

    def heading(self) -> list:
        r, pick = self.r, self.r.choice
        cap = lambda: self.common().capitalize()
        return [pick([lambda: f"{cap()} {cap()}", lambda: f"# {cap()} {self.words(1, 2)}", lambda: f"{cap()} {cap()} | {cap()} {self.common()}", lambda: f"{self.firm()} — {cap()} {cap()}", lambda: f"{self.common().upper()} {self.common().upper()}", lambda: f"{cap()} / {self.firm()}", lambda: f"{cap()} {cap()} (rev. {pick('ABCD')})  Page {r.randint(1, 99)}", lambda: f"- {self.words(1, 4)}\n- {self.words(1, 4)}", lambda: f"{self.place()}, {cap()} {self.common()}"])() + pick(["\n", "\n\n"])]

    def text(self) -> tuple[str, list[int]]:
        r = self.r
        parts: list = []
        for _ in range(r.randint(1, 3)):
            x = r.random()
            parts += self.form() if x < 0.24 else self.heading() if x < 0.34 else self.sentence()
            parts.append(r.choice([" ", " ", " ", "\n", "\n\n"]))
        chars: list[str] = []
        labels: list[int] = []
        for p in parts:
            kind, s = (None, p) if isinstance(p, str) else p
            chars += s
            labels += [0] * len(s) if kind is None else [1 + 2 * KINDS.index(kind)] + [2 + 2 * KINDS.index(kind)] * (len(s) - 1)
        if r.random() < 0.4:  # hard line ends
            width, column = r.randint(40, 90), r.randint(0, 60)
            i = 0
            while i < len(chars):
                column = 0 if chars[i] == "\n" else column + 1
                if column > width - 8 and chars[i] == " ":
                    chars[i], column = "\n", 0
                elif column > width and 0 < i < len(chars) - 1 and chars[i].isalpha() and chars[i - 1].isalpha() and chars[i + 1].isalpha() and labels[i] % 2 == 0:
                    inside = labels[i]
                    chars[i:i], labels[i:i], column = ["-", "\n"], [inside, inside], 0
                    i += 2
                i += 1
        if r.random() < 0.12:  # misread letters
            for i, c in enumerate(chars):
                if r.random() < 0.04:
                    for right, wrong in r.sample(CONFUSED, 3):
                        if c == right and len(wrong) == 1:
                            chars[i] = wrong
        return "".join(chars), labels


STREETS_PLAIN = "Street Road Lane Avenue Square".split()


def drawn(count: int, seed: int = 11) -> tuple[list[str], list[np.ndarray], list[np.ndarray]]:
    """``count`` texts, the label of each character, and the kind of word it belongs to. One text in twenty sees no
    lists, and a few words lose their kind, so that the model does not lean on them alone."""
    d = Drawer(seed)
    texts, gold, kinds = [], [], []
    listed = {w.lower() for w in (*FIRMS, *PLACES)}
    while len(texts) < count:
        text, labels = d.text()
        start = d.r.randint(0, 8) if d.r.random() < 0.1 else 0
        text, labels = text[start : start + 480], labels[start : start + 480]
        if not text or labels[0] and labels[0] % 2 == 0:
            continue
        kind = word_kinds(text, d.usual | listed)
        if d.r.random() < 0.05:
            kind = np.where(kind > 1, d.r.randint(0, 1), kind).astype(np.uint8)
        else:
            step = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]]))
            for a, b in zip(step, [*step[1:], len(kind)]):
                if kind[a] and d.r.random() < 0.03:
                    kind[a:b] = 0 if d.r.random() < 0.5 else WORD_KINDS.index("ordinary")
        texts.append(text)
        gold.append(np.array(labels))
        kinds.append(kind.astype(np.int64))
    return texts, gold, kinds
