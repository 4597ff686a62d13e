"""Trains the tagger of :mod:`skein.llm.pii` in numpy: ``python -m skein.llm.pii_train MINUTES WORKERS``.

Labelled spans come from sentences made here: an item of each type, in one of its many forms,
between a lead and a tail put together at random; sentences are joined, misspelt, shouted or
written in lower case.  Their other words are drawn from the vocabularies of two public
tokenizers, names and streets from general lists, so nothing is taken from any table.  Sentences
with look-alikes (numbers of loans and policies, rates, firms, rules named after somebody, first
names alone, products) carry no label.
"""

from __future__ import annotations

import random
import re
import sys
import time
from functools import lru_cache

import numpy as np

from .pii import CHARACTERS, MODEL, TAGS, TYPES, WINDOW, WORD_KINDS, symbols

#: Given names and pieces of family names of many countries, from general knowledge.
FIRST = (
    "Aaron Abigail Adam Adriana Ahmed Aisha Albert Alejandro Alexander Alice Amelia Amina Amy Andrew Angela Anna Anthony Antonio Arjun Arthur Barbara Beatrice Benjamin Bernard Bianca Brenda Brian Bruno Camila Caroline Catherine Cecilia Charles "
    "Charlotte Christian Claire Claudia Cristina Daniel David Deborah Deepak Diana Dimitri Dominic Dorothy Eduardo Edward Eleanor Elizabeth Emily Emma Eric Esther Evelyn Fatou Felix Fernando Florence Francis Frank Gabriel George Gerald Giovanni "
    "Gloria Grace Gustav Hannah Harold Harry Haruto Heidi Helen Henry Hiroshi Howard Ibrahim Ines Irene Isabel Jack Jacob James Jan Javier Jean Jennifer Jessica Joan John Jorge Joseph Julia Julian Karen Katarzyna Kenneth Kenji Kevin Khalid Klaus Laila "
    "Laura Lauren Leo Leonard Linda Lisa Louis Lucas Lucy Luis Manuel Marcus Margaret Maria Marie Mark Martin Mary Matthew Maya Mehmet Michael Miguel Mohammed Monica Nancy Natalia Nathan Nicole Nina Oliver Oscar Patricia Paul Pedro Peter Philip "
    "Rachel Raj Rebecca Richard Robert Roberto Roger Sanjay Sarah Sergei Sofia Stephen Susan Takeshi Teresa Thomas Tomasz Valeria Victor Walter William Wolfgang Xiao Yuki Zofia Jürgen Zoë José René Søren Łukasz Björn"
).split()
_HEADS = (
    "Ack Ad Al Alm And Arm Aug Bach Bal Bart Beck Ben Berg Black Blum Bor Brad Bro Bur Can Car Chan Clay Col Con Cross Cum Dan Dav Dem Dick Don Doug Dra Ed Eck Ell Eng Er Ev Far Ferr Fitz Flet For Fran Fried Gal Gar Gib Gil Gold Gon Grab Gra Gri Gut Had Hag "
    "Hal Han Hard Har Hen Her Hil Hoff Hol How Hub Hun Ig Ing Iv Jack Jan Jen Joh Jor Kap Kath Kel Ken Kim Kir Kla Kno Koch Kow Kra Lam Land Lang Lar Laz Leb Lew Lind Lom Lop Lud Mac Mal Mann Mar Mart Mat May Mel Mer Mich Mil Mor Mun Nag Nak Nav New Nich Nor Nov "
    "Ob Ol Ort Pal Par Pat Pav Per Pet Pfe Phil Pol Pop Pres Qui Ram Rei Ren Rich Rob Rod Rom Rosen Roth Rus Sal San Sat Schul Schwar Sch Ser Shah Sil Sim Smir Sod Som Stev Stra Sul Suz Tak Tan Tay Thom Tim Tor Tuck Ul Vas Ver Vog Wag Wall War Web Wein Whit Wil Win Wood Yam Zam Zim"
).split()
_TAILS = (
    "ada aker akis ala aldi aldo ano arczyk ard aro as auer aux bach bauer berg berger berry bourne burn by chuk cki croft dahl den der do dorf dottir dson dt e eau einen el ela elli ello en enko er erman ero ers erson ert es escu esen ett ette ev ez feld fer ffer field ford gard gen ger ges ham hart heim "
    "herd holm house huis hurst i ia iak ic ich idis ien ier iev in ina ine ing ingham ini ino inski io is ishi itch itz ke kel ken ker kin kins ko kov kowski kar la ley li lin ling lis lund man mann mark mas mayer mer meyer mond mons mont more moto mura nak nen ner ney o off oglu oko olan on one oni opoulos or ora ori os "
    "osa otti ov ova ova ovic owicz quez quist rell ren ri rick ries rin ro ros rup sch sen ser shima ski sky smith son sson stad stein ster stone strom ta ter ters thal ti ton tz ucci ul va ville vist wald wala ward well wen wick win wood worth y yan yama zadeh zak zano zer"
).split()
_STREETS = "Acacia Airport Albert Amber Aspen Bay Beach Beech Boundary Bright Broad Burton Cathedral Central Chestnut Church Cliff College Commerce Coral County Cricket Crown Cypress Dale Diamond Dogwood Eagle East Factory Farm Fir First Forest Fourth Garfield George Granite Hampton Harbor Harrison Hawthorn Highland Holly Hospital Industrial Jackson Jasmine Jefferson Jubilee Lakeview Laurel Liberty Lincoln London Long Magnolia Main Manor Mary Mayfair Monroe Mountain Museum New Nightingale Northern Ocean Oxford Palm Park Peach Pearl Pioneer Prince Prospect Railway Regent Ridge Royal Sandy Second Shore Silver Smith South Spruce Stanley Sunset Sycamore Temple Third Union University Valley Victoria View Village Walnut Washington Wellington White Wilson Windsor York".split()
_ENDS = "Street St St. Road Rd Rd. Avenue Ave Ave. Lane Ln Drive Dr Court Ct Close Terrace Way Place Pl Boulevard Blvd Crescent Gardens Row Hill Square Mews Walk Parade Highway Circle Trail Grove Quay".split()
#: Words that people stand beside in a sentence, and words that make a title-case run a firm, a team, a product, a rule (written without a look at any table).
_TITLES = "Mr Mrs Ms Dr Mr. Mrs. Ms. Dr. Miss Prof. Professor Sir".split()
_FIRM = "Bank|Ltd|Group|Partners|& Co|Insurance|University|Clinic|Holdings|Logistics|Software|Savings|Hospital|Foundation|Capital|Mutual|Services|Trust|Finance|Society|Union|Lending|Mortgages|Homes|Agency|Authority|Council|Inc|GmbH|LLP|Building Society|Credit Union".split("|")
_PRODUCT = "Plus|Flex|Saver|Tracker|Basic|Premium|Starter|Fixed|Account|Card|Cover|Plan|Bundle|Edition|Scheme|Guide|Manual|Portal|Report|Form|Package|Line|Pro|Reserve|Bridge|Offset|Bond|Fund|Loan|Programme|Product|Suite".split("|")
_ROLE = "officer|manager|analyst|adviser|assistant|clerk|agent|inspector|supervisor|engineer|nurse|director|specialist|coordinator|auditor|desk|team|department|support|helpdesk|unit|committee|office|reviewer|owner|lead|intern|secretary|teller|broker|examiner|processor".split("|")
_RULE = "rule|ratio|test|clause|index|method|act|standard|formula|model|theorem|principle|scale|effect|directive|table|report|amendment|convention|protocol|office|branch|portfolio|list|project|plan|policy".split("|")
_OF_PERSON = "applicant|customer|client|patient|guest|tenant|borrower|member|student|colleague|passenger|neighbour|husband|wife|mother|father|brother|sister|partner|guarantor|witness|lawyer|landlord|buyer|seller|visitor|user|employee|co-signer|contact|caller|owner|spouse".split("|")
_VERBS = "asks about|wants|called about|sent|signed|lost|needs|complained about|paid for|cancelled|uploaded|is waiting for|left without|was told about|booked|forgot|has questions on|wrote twice about|did not get|moved before|submitted|still owes|is listed on|already has|qualifies for|got".split("|")
_WHERE = "please|today|again|yesterday|this week|as discussed|on the phone|by mail|at once|thanks||||||".split("|")
_UNITS = "hours|days|weeks|months|years|minutes|working days|business days|calendar days|thousand|million|hundred|percent|points|pages|copies|users|rooms|miles|euros|dollars|pounds|units|people|times|lines|items|cases|weeks now|basis points|per cent|in total|or more|plus tax".split("|")
_OTHER_GLUE = "el la los las de del con para por que es un una y en le les des du et est pour avec der die das und mit für ist ein i z na w do jest o os da".split()
_GLUE = "the a an of for to in on with is are was and or not this that my our your it can how what when why does do we i you which who where if by from as at be have has will should there".split()


@lru_cache(maxsize=2)
def vocabulary(directory: str | None = None) -> tuple[list[str], list[str]]:
    """(English words, words of other languages): lower-case tokens of two public vocabularies."""
    import base64
    import os

    from .bpe import TOKENIZER_DIR

    found = []
    for name, least in (("byte_bpe_50k.tiktoken", 4), ("byte_bpe_multi_50k.tiktoken", 3)):
        with open(os.path.join(directory or TOKENIZER_DIR, name), "rb") as lines:
            tokens = [base64.b64decode(x.split()[0]).decode("utf-8", "replace") for x in lines]
        found.append([t[1:] for t in tokens if t[:1] == " " and len(t) > least and t[1:].isalpha() and t[1:] == t[1:].lower()])
    english, others = found
    known = set(english)
    return english, [w for w in others if w not in known]


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def one(self, *options):
        return self.r.choice(options)

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def letters(self, n: int) -> str:
        return "".join(self.r.choice("ABCDEFGHJKLMNOPQRSTVWXYZ") for _ in range(n))

    def word(self) -> str:
        """A word of the public vocabulary, common ones more often."""
        english = vocabulary()[0]
        return english[int(len(english) * self.r.random() ** 2.2)]

    def words(self, least: int, most: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(least, most)))

    def doc(self) -> str:
        return self.words(1, 3)

    def titled(self, least: int, most: int) -> str:
        """Words with capitals; some of them stand in no vocabulary, as names of products often do."""
        made = [self.word() if self.r.random() < 0.78 else self.one(self.word()[:6] + self.word()[-5:], self.r.choice(_HEADS).lower() + self.word()[-4:], self.misspell(self.word())) for _ in range(self.r.randint(least, most))]
        return " ".join(made).title()

    def firm(self) -> str:
        p = self.r.random()
        head = self.family() if p < 0.25 else f"{self.family()} & {self.one(self.family(), self.titled(1, 1))}" if p < 0.4 else self.titled(1, 2)
        return f"{head} {self.r.choice(_FIRM)}"

    def product(self) -> str:
        p = self.r.random()
        if p < 0.35:
            return self.titled(2, 2)
        return f"{self.titled(1, 2)} {self.r.choice(_PRODUCT)}" if p < 0.8 else f"{self.titled(1, 1)} {self.one('Second', 'Interest-Only', 'Buy-to-Let', 'Low-Cost', 'Self-Service', 'All-in-One')} {self.one(self.r.choice(_PRODUCT), '')}".strip()

    def named_thing(self) -> str:
        """A product or the like that is easily taken for somebody: its first word may be a first name, its words may be misspelt or the space between them slipped."""
        made = self.one(self.product(), self.titled(2, 2), f"{self.r.choice(FIRST)} {self.titled(1, 1)}")
        p, at = self.r.random(), made.find(" ")
        if p < 0.3:
            return self.misspell(made)
        return made[: at - 1] + " " + made[at - 1] + made[at + 1 :] if p < 0.4 and at > 1 else made

    def role(self) -> str:
        made = f"{self.word()} {self.r.choice(_ROLE)}"
        return made.title() if self.r.random() < 0.35 else made

    def plain(self) -> str:
        """A sentence without an item, in English or a mixture of other languages' words."""
        p = self.r.random()
        if p < 0.2:
            others = vocabulary()[1]
            made = [self.r.choice(_OTHER_GLUE) if self.r.random() < 0.35 else self.r.choice(others) if self.r.random() < 0.85 else self.word() for _ in range(self.r.randint(3, 9))]
            if self.r.random() < 0.3:
                made.insert(0, self.one("¿qué", "¿cómo", "el", "la", "le", "der", "die", "quel", "wie", "jak", "¿dónde está el", "¿qué es el"))
        else:
            made = [self.r.choice(_GLUE) if self.r.random() < 0.45 else self.word() for _ in range(self.r.randint(2, 10))]
            if self.r.random() < 0.2:
                made.insert(self.r.randrange(len(made)), self.one(self.product(), self.firm(), self.role(), self.product(), self.titled(1, 1)))
        return " ".join(made) + self.one("", "", "?", ".", "!", " " + self.digits(2), f" {self.digits(1)}.{self.digits(2)}%")

    def family(self) -> str:
        if self.r.random() < 0.2:
            made = "".join(self.r.choice("bcdfghjklmnprstvwz") + self.r.choice("aeiou") for _ in range(self.r.randint(2, 4))).capitalize() + self.one("", "n", "s", "r", "th", "nk")
        else:
            made = self.r.choice(_HEADS) + self.one("", "", "", "i", "o", "e", "im", "an", "av") + self.r.choice(_TAILS)
        if self.r.random() < 0.03:
            made = self.one("O'", "Mc", "de ", "van ", "al-", "D'") + made
        return made

    def name(self) -> str:
        first, family = self.r.choice(FIRST), self.family()
        if self.r.random() < 0.15:
            family += self.one("-", "-", " ") + self.family()
        if self.r.random() < 0.25:
            first = self.family()[: self.r.randint(4, 8)].capitalize()
        middle = f" {self.r.choice('ABCDEFGHJKLMNPRSTW')}." if self.r.random() < 0.15 else ""
        p = self.r.random()
        if p < 0.6:
            return f"{first}{middle} {family}"
        if p < 0.72:
            return f"{family}, {first}"
        if p < 0.82:
            return f"{first[0]}. {family}"
        return f"{self.one('Mr', 'Mrs', 'Ms', 'Dr', 'Mr.', 'Mrs.', 'Ms.', 'Miss', 'Dr.')} {self.one('', '', '', first + ' ')}{family}"

    def email(self) -> str:
        first = re.sub(r"[^a-z]", "", self.r.choice(FIRST).lower()) or "ana"
        family = re.sub(r"[^a-z]", "", self.family().lower())
        local = self.one(f"{first}.{family}", f"{family}.{first}", f"{first[0]}{family}", f"{first[0]}-{family}", f"{first}{self.digits(2)}", f"{first}_{family}{self.digits(2)}", f"{family}{self.digits(1)}", f"{first}.{family}-{re.sub(r'[^a-z]', '', self.family().lower())}")
        if self.r.random() < 0.12:
            local += self.one("+" + self.word(), "+" + self.digits(3))
        domain = self.one("mail", "post", "inbox", "home", "example", self.word(), f"{self.word()}-{self.word()}", self.word() + self.word()) + self.one(".example", ".test", ".invalid", ".example.org", ".com", ".net", ".org", ".co.uk")
        if self.r.random() < 0.15:
            domain = self.one("example", "example", "mail.example") + self.one(".com", ".org", ".net", "")
            domain = domain if "." in domain else domain + ".com"
        p = self.r.random()
        if p < 0.74:
            made = f"{local}@{domain}"
        elif p < 0.8:
            made = f"{local} @ {domain}"
        else:
            at, dot = self.one((" (at) ", " (dot) "), (" [at] ", " [dot] "), (" at ", " dot "), ("(at)", "(dot)"))
            made = local + at + domain.replace(".", dot)
        return made.title() if self.r.random() < 0.05 else made

    def phone(self) -> str:
        area, ex, line = self.digits(3), self.one("555", self.digits(3)), self.digits(4)
        p = self.r.random()
        nbh = "‑"
        if p < 0.5:
            made = self.one(f"({area}){ex}-{line}", f"({area}) {ex}-{line}", f"{area}-{ex}-{line}", f"{area} {ex} {line}", f"{area} {ex}{nbh}{line}", f"{area}.{ex}.{line}", f"{area}{ex}{line}", f"+1 {area} {ex} {line}", f"1-{area}-{ex}-{line}", *[f"{area}/{ex}/{line}"] * 4, f"{ex}-{line}", f"+1{area}{ex}{line}", f"+1-{area}-{ex}-{line}")
        elif p < 0.62:
            word = {"0": "zero", "1": "one", "2": "two", "3": "three", "4": "four", "5": "five", "6": "six", "7": "seven", "8": "eight", "9": "nine"}
            spoken = " ".join(word[d] for d in ex)
            made = self.one(f"{area} {spoken} {line}", f"{area} {spoken} {line}", f"{spoken} {line}", f"{' '.join(word[d] for d in area)} {ex} {line}")
        else:
            made = self.one(f"07{self.digits(3)} {self.digits(6)}", f"+447{self.digits(9)}", f"+44 7{self.digits(3)} {self.digits(3)} {self.digits(3)}", f"020 7{self.digits(3)} {self.digits(4)}", f"(0)20-7{self.digits(3)}-{self.digits(4)}", f"0044 20 7{self.digits(7)}", f"+44 (0)20 7{self.digits(3)} {self.digits(4)}", f"+49 30 {self.digits(3)} {self.digits(4)}", f"+34 6{self.digits(2)} {self.digits(3)} {self.digits(3)}", f"01{self.digits(3)} {self.digits(6)}")
        return made + (self.one(" ext ", " x", " ext. ") + self.digits(2) if self.r.random() < 0.15 else "")

    def id_number(self) -> tuple[str, str]:
        """(words before the number, the number)."""
        s = self.digits
        qq = self.letters(2)
        kind = self.r.random()
        ssn = self.one(f"{s(3)}-{s(2)}-{s(4)}", f"{s(3)} {s(2)} {s(4)}", f"{s(3)}.{s(2)}.{s(4)}", s(9))
        if kind < 0.34:
            if "-" in ssn and self.r.random() < 0.35 or (" " in ssn or "." in ssn) and self.r.random() < 0.35:
                return "", ssn
            return f"{self.one('SSN', 'SSN', 'SSN#', 'social security number', 'social security no.', 'Social Security', 'soc sec', 'ssn:')} ", ssn
        if kind < 0.56:
            body = s(6)
            ni = self.one(f"{qq}{body}{self.r.choice('ABCD')}", f"{qq} {body[:2]} {body[2:4]} {body[4:]} {self.r.choice('ABCD')}", f"{qq}-{body[:2]}-{body[2:4]}-{body[4:]}-{self.r.choice('ABCD')}")
            return ("" if self.r.random() < 0.35 else f"{self.one('NI number', 'national insurance no.', 'national insurance number', 'NINO', 'NI no')} "), ni
        if kind < 0.72:
            return f"{self.one('passport', 'passport no:', 'passport number', 'passport no.', 'passport #')} ", self.one(self.letters(2) + s(6), self.letters(1) + s(7), self.letters(1) + s(8), s(9), self.letters(2) + s(7))
        if kind < 0.88:
            ch = self.r.choice
            return self.one("driver's license ", "driving licence ", "driver license ", "driving license ", "licence no ", "DL "), self.one(f"{self.letters(2)}-{s(3)}-{s(3)}-{s(2)}", f"{self.letters(5)}{s(6)}{self.letters(2)}{s(1)}{self.letters(2)}", f"{self.letters(5)}{s(6)}{self.letters(1)}{s(1)}{self.letters(2)}", ch("ABDQSTW") + s(7), f"{self.letters(1)}{s(3)}-{s(4)}-{s(4)}", self.letters(2) + s(6))
        return f"{self.one('tax id (ITIN)', 'tax id', 'ITIN', 'TIN', 'UTR', 'tax number', 'tax reference', 'taxpayer id')} ", self.one(s(9), f'9{s(2)}-{s(2)}-{s(4)}', s(10))

    def address(self) -> str:
        base = self.r.choice(_STREETS)
        if self.r.random() < 0.4:
            base += self.one(" ", "", "") + self.r.choice(_STREETS).lower()
            base = " ".join(x.capitalize() for x in base.split())
        elif self.r.random() < 0.2:
            base = self.family()
        number = str(self.r.randint(1, 2400))
        p = self.r.random()
        if p < 0.13:
            made = f"Calle {base} {number}" + self.one("", f", {self.r.randint(1, 9)}º {self.r.choice('ABC')}")
        elif p < 0.26:
            made = f"{base.replace(' ', '').capitalize()}{self.one('straße', 'strasse', 'weg', 'platz')} {number}"
        else:
            made = f"{number} {self.one('', '', '', '', 'E ', 'N ', 'South ', 'NW ', 'West ')}{base} {self.r.choice(_ENDS)}"
            q = self.r.random()
            if q < 0.2:
                made = f"{self.one('Flat', 'Unit', 'Apartment', 'Suite')} {self.r.randint(1, 20)}{self.one(', ', ' / ', ', ')}{made}"
            elif q < 0.35:
                made += f"{self.one(' ', ', ')}{self.one('Apt', 'Apt', 'Unit', '#')} {self.r.randint(1, 30)}{self.one('', 'A', 'B', 'C')}"
        if self.r.random() < 0.65:
            town = self.one("", "", "Port ", "Saint ", "San ", "New ", "Old ", "Upper ", "Bad ") + self.one(self.r.choice(_STREETS), self.family(), self.titled(1, 1), self.r.choice(_HEADS) + self.one("haven", "mere", "ford", "ley", "ton", "burg", "ville", "stadt", "port", " Falls", " Bay", " Springs"))
            made += f", {town}"
            if self.r.random() < 0.25:
                made += f", {self.letters(2)} {self.digits(5)}"
        return made

    def sentence(self, kind: str) -> list[tuple[str, str]]:
        """Pieces (text, type or ""): an item between a lead and a tail of many makes."""
        d, r, one = self.doc(), self.r, self.one
        thing = one(d, d, self.product(), "the " + d, "a " + d)
        tail = one("", "", f" {one('about', 're', 'for', 'on', 'with', 'and', '-', 'because of')} {thing}", f" {r.choice(_WHERE)}", f", {self.plain()}", f"? {self.plain()}", f"; {self.words(1, 2)}={self.word()}")
        lead = one("", "", f"{self.plain()} ", f"{self.words(1, 3)}: ", f"{self.words(1, 2)}=", f"{thing} for ", f"{self.words(1, 4)} ")
        if kind == "person_name":
            x = (self.name(), kind)
            who = r.choice(_OF_PERSON)
            return r.choice([
                [(f"{one('', 'my ', 'the ', 'our ', 'does ', 'did ', 'has ', 'docs of ', 'file of ')}{who}{one(' ', ' ', ': ', ' name ', ' is ', ', ')}", ""), x, (one("", f" {r.choice(_VERBS)} {thing}", tail), "")],
                [(one("I am ", "my name is ", "i'm ", "this is ", "name: ", "signed, ", "Regards, ", "regards\n", "cc ", "- ", "from ", "thanks, ", "Thank you ", "Best wishes\n", "kind regards ", "me llamo ", "gracias, ", "merci ", "ich bin ", "Danke ", "soy "), ""), x, (one("", "", tail), "")],
                [(one("spoke with ", "ask for ", "call ", "tell ", "speak to ", "meeting with ", "helped by ", "met ", "advice from ", "status of ", "update for ", "file for ", "case of ", "on behalf of ", "joint with ", "sent by ", "assigned to ", "thanks to ", "letter for ", "is this for ", "contact ", "did ", "does ", "can ", "when will ", "why was ", "where is ", "pull up ", "change to ", "name on it is ", "listed as "), ""), x, (one("", "'s " + d, f" {r.choice(_VERBS)} {thing}", tail), "")],
                [x, (one(f" {r.choice(_VERBS)} {thing}", " was very helpful.", " is my " + who, " and " + thing, " here", ", " + self.plain(), f" from {self.firm()} {r.choice(_VERBS)} {thing}", " explained it well", " never rang back", tail), "")],
                [(lead, ""), x, (tail, "")],
                [(f"{one('el', 'la', 'le', 'der', 'die', 'o', 'il')} {one('cliente', 'señora', 'client', 'Kunde', 'Frau', 'dossier de', 'signor', 'pan')} ", ""), x, (" " + self.plain(), "")],
            ])
        if kind == "email":
            x = (self.email(), kind)
            return r.choice([[(lead, ""), x, (tail, "")], [(one("my mail is ", "mail ", "write to ", "reply to ", "send it to ", "email: ", "e-mail ", "contact ", "from: ", "cc ", "invite ", "copy to ", "is ", "who is ", "forward to ", "account of ", "(", "<", "login ", "correo "), ""), x, (one("", tail, ")", ">", "."), "")], [x, (tail, "")], [(f"{self.plain()} ", ""), x]])
        if kind == "phone":
            x = (self.phone(), kind)
            return r.choice([[(lead, ""), x, (tail, "")], [(one("call me on ", "ring ", "tel ", "Tel. ", "tel:", "phone ", "phone: ", "mobile ", "cell ", "my number is ", "number is ", "text ", "reach me at ", "fax ", "caller ", "dial ", "whatsapp ", "ph ", "call back ", "nobody answers ", "teléfono ", "contact number "), ""), x, (one("", tail, ".", "!", " after five", ", mornings only", " does not work"), "")], [(f"{self.plain()} ", ""), x, (tail, "")]])
        if kind == "id_number":
            label, number = self.id_number()
            x = [(label, ""), (number, kind)] if label else [(number, kind)]
            return r.choice([[(lead, ""), *x, (tail, "")], [(one("my ", "the ", "his ", "her ", "", "with ", "has ", "gave ", "typed ", "verify ", "check ", "record ", "update ", "wrong ", "is ", "why is ", "does ", "it showed my "), ""), *x, (one("", tail, ".", " is wrong", " on file", " does not match " + thing, " ok"), "")]])
        if kind == "street_address":
            x = (self.address(), kind)
            return r.choice([[(lead, ""), x, (tail, "")], [(one("I live at ", "property at ", "house at ", "moving to ", "send it to ", "post to ", "address: ", "address ", "letters go to ", "deliver to ", "located at ", "we bought ", "flood at ", "valuation of ", "is ", "visit ", "the flat on ", "near ", "registered at ", "new home ", "vivo en ", "wohne "), ""), x, (one("", tail, ".", " was sold", " is empty", " last month", f" - {thing}"), "")]])
        s = self.digits
        number = one(s(10), s(9), s(8), s(7), f"{s(3)}-{s(3)}-{s(4)}", f"{s(3)}-{s(2)}-{s(4)}", f"{s(3)} {s(2)} {s(4)}", f"{s(3)} {s(3)} {s(4)}", f"{s(4)}-{s(5)}", f"{self.letters(2)}-{s(4)}-{s(5)}", f"{self.letters(2)}{s(6)}", f"{s(3)}.{s(2)}.{s(4)}", f"{s(3)}-{s(7)}", f"{s(4)}-{s(2)}-{s(2)}", f"{s(4)} {s(4)}", f"#{s(7)}", f"0x{s(6)}", f"{s(3)}-{s(2)}-{s(4)}{self.letters(1)}", f"{s(3)}-{s(2)}-{s(4)}-{s(1)}")
        what = one("loan", "ticket", "case", "policy", "policy no", "invoice", "account", "account no", "order", "ref", "reference", "claim", "file", "loan no.", "batch", "batch no", "escrow ref", "docket", "template", "doc id", "version", "error", "account ending", "contract", "booking", "form", "serial", "item", "row", "page", "section", "case no.", "ticket #", "invoice no", "tracking", "member no", "folio", "expediente", "poliza", "Rechnung")
        place = one(self.titled(1, 2), self.titled(1, 1), r.choice(_STREETS))
        some = self.one(s(1), s(2), s(2), s(3), s(3), f"{s(3)},{s(3)}", s(4))
        shown = self.one(self.titled(2, 2), self.titled(2, 2), self.product(), self.product(), self.titled(1, 3), self.firm(), self.titled(1, 1), *[self.named_thing() for _ in range(4)])
        if r.random() < 0.4:  # names of things where names of people may stand
            return [(self.one(f"{self.words(1, 6)} {one('for', 'on', 'of', 'at', 'to', 'under')} {shown}{one('', '', tail)}", f"{one('does', 'is', 'can', 'why is', 'what is', 'has', 'will', 'are')} {shown} {r.choice(_VERBS + ['open', 'for', 'available', 'right', 'priced', 'and', 'or'])} {thing}", f"{self.plain()} {one('for', 'on', 'of', 'with', 'from', 'about', 'vs', 'in', 'under', 'and', 'the')} {shown}{one('', '', tail)}", f"{shown} {one('fees', 'limits', 'terms', 'rate', 'minimum', 'case', 'list', 'guide', 'sheet', r.choice(_VERBS))} {self.plain()}", f"the {one('', 'old ', 'new ', self.word() + ' ')}{shown} {self.word()}{tail}", f"{one('want', 'need', 'about', 'use', 'prefer', 'read', 'compare', 'open', 'max', 'min', 'limit of')} {shown}{tail}"), "")]
        return [(r.choice([
            f"{lead}{some} {r.choice(_UNITS)}{tail}", f"{self.plain()} {one('within', 'in', 'after', 'over', 'under', 'is', 'of', 'for', 'about', 'at least')} {some} {r.choice(_UNITS)}{one('', tail)}", f"{self.plain()} {some} {self.word()} {self.word()}{one('', tail)}", f"{one('within', 'over', 'max')} {some} {r.choice(_UNITS)} and {s(2)} {r.choice(_UNITS)}{tail}",
            f"{lead}{what} {number}{tail}", f"{what} {number} {self.plain()}", f"{what} {number}", f"{self.plain()}", f"{self.plain()}", f"{lead}{thing}{tail}",
            f"{one('is', 'does', 'did', 'ask', 'at', 'by', 'from', 'for', 'why is', 'who runs')} {self.firm()} {self.plain()}", f"{self.role()} {r.choice(_VERBS)} {thing}", f"ask {one('the', 'our', 'a', '')} {self.role()} at {self.firm()}", f"{self.role()} and {self.role()} {self.plain()}",
            f"the {self.family()} {r.choice(_RULE)}{tail}", f"{one('the', 'does the', 'is the', 'under', 'see the')} {self.family()} {r.choice(_RULE).title()}{tail}", f"{self.family()} {one(r.choice(_RULE), r.choice(_PRODUCT))} {self.plain()}", f"{self.family()}-{self.family()} {r.choice(_RULE)}{tail}",
            f"{one('thanks', 'hi', 'hello', 'ask', 'what if', 'because')} {r.choice(FIRST)}{one('', ' ' + self.plain(), ' from the ' + self.role(), ', ' + self.plain())}", f"{r.choice(FIRST)} {one('said', 'told me', 'is late', r.choice(_VERBS))} {thing}", f"{r.choice(FIRST)} from {self.role()} {self.plain()}",
            f"{self.product()} {one('vs', 'or', 'and', 'versus', 'with')} {self.product()}{tail}", f"{one('is', 'why', 'what is', 'how much is', 'limit of', 'fees of', 'for', 'about', 'rate on', 'difference between')} {self.product()} {self.plain()}", f"{lead}{self.product()}{tail}", f"{self.product()} {one('fees', 'limits', 'terms', 'product', 'guide', 'case', 'plan')}{tail}",
            f"rate@{s(1)}.{s(2)} or @ {s(1)}.{s(3)}{tail}", f"priced @{s(1)}.{s(3)} for {thing}", f"ping @{self.word()}-{self.word()}{tail}", f"see @{self.word()}{tail}", f"hours {s(2)}:{s(2)}-{s(2)}:{s(2)}{tail}", f"max {one('€', '$', '£')}{s(3)},{s(3)} or {one('€', '$', '£')}{s(3)},{s(3)}.{s(2)}{tail}", f"{s(2)}.{s(2)}% of {thing} within {s(2)} {one('days', 'hours', 'months')}",
            f"{one('on', 'by', 'from', 'since')} {s(2)}{one('/', '.', '-')}{s(2)}{one('/', '.', '-')}20{s(2)}{tail}", f"{thing} of {s(2)} {one('January', 'May', 'June', 'March', 'October')} 20{s(2)} at {s(2)}:{s(2)}", f"form {s(4)} or {s(4)}-{s(2)}{tail}", f"units {s(2)}-{s(2)} of {thing}, lot {s(4)}", f"room {s(3)}, floor {s(1)}{tail}", f"step {s(1)} on page {s(2)}{tail}",
            f"{one('a', 'the', 'our', 'is the')} {s(2)} {self.titled(1, 2)} {one('Way', 'Street', 'Road', 'Drive', 'Court', 'Place', 'Lane')} {one('plan', 'product', 'scheme', 'guide', 'policy', 'fees', 'method')}{tail}", f"{place} {one('Way', 'Road', 'Street', 'Lane', 'Square')} {one('plan', 'scheme', 'product', 'policy', 'guide', 'office', 'branch', 'lending')}{tail}", f"{s(1)}-{s(1)} {self.word()} {self.word()} of {thing}", f"{s(2)} {self.word()} {one('court', 'drive', 'way', 'close', 'place', 'hill')} {self.word()}{tail}",
            f"{one('Regulation', 'Article', 'Annex', 'Schedule', 'Class', 'Tier')} {self.letters(1)}{tail}", f"{r.choice(_OF_PERSON)} {one('file', 'data', 'letter', 'number', 'name', 'address', 'and ' + r.choice(_OF_PERSON))} {self.plain()}", f"{one('does', 'can', 'if', 'what if', 'when')} {one('the', 'a')} {r.choice(_OF_PERSON)} {self.plain()}", f"{one('email', 'phone number', 'address', 'name', 'passport', 'SSN', 'driving licence', 'tax id', 'telephone')} {one('missing', 'of the ' + r.choice(_OF_PERSON), 'needed', 'wrong', 'for ' + thing)}{tail}",
        ]), "")]

    def misspell(self, text: str) -> str:
        i = self.r.randrange(len(text)) if text else 0
        p = self.r.random()
        if len(text) < 4 or not text[i].isalpha():
            return text
        return text[:i] + text[i + 1 :] if p < 0.4 else text[:i] + text[i] + text[i:] if p < 0.6 else text[:i] + text[i + 1 : i + 2] + text[i] + text[i + 2 :]

    def text(self) -> tuple[str, list[tuple[int, int, int]]]:
        pieces: list[tuple[str, str]] = []
        for k in range(self.one(1, 1, 1, 2, 2, 3)):
            if k:
                pieces.append((self.one(". ", "; ", ", ", "\n", " ", "? ", "! "), ""))
            p = self.r.random()
            if p < 0.25:
                made = [(self.plain(), "")]
            elif p < 0.6:
                made = self.sentence("")
            else:
                made = self.sentence(self.one(*TYPES, "person_name", "id_number", "street_address"))
            if self.r.random() < 0.15:
                made = [(self.misspell(s), t) if not t else (s, t) for s, t in made]
            if made[0][1] == "" and made[0][0][:1].islower() and self.r.random() < 0.3:
                made[0] = (made[0][0][:1].upper() + made[0][0][1:], "")
            pieces += made
        if self.r.random() < 0.4:
            pieces.append((self.one("?", "??", ".", "!", " "), ""))
        case = self.r.random()
        change = str.lower if case < 0.2 else str.upper if case < 0.25 else str
        text, spans = "", []
        for s, t in pieces:
            if self.r.random() < 0.02 and not t:
                s = s.replace(" ", "  ", 1)
            changed = change(s)
            if t:
                spans.append((len(text), len(text) + len(changed), TYPES.index(t)))
            text += changed
        return text, spans


def tags_of(length: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    tags = np.zeros(length, dtype=np.int64)
    for a, b, kind in spans:
        tags[a:b] = 2 * kind + 2
        tags[a] = 2 * kind + 1
    return tags


# --- training ------------------------------------------------------------------------------


def new_weights(hidden: int, embedding: int, seed: int = 0) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    init = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[-2])).astype(np.float32)
    bias = np.zeros((2, 4 * hidden), dtype=np.float32)
    bias[:, hidden : 2 * hidden] = 1.0
    return {
        "emb": np.tile(rng.standard_normal((CHARACTERS, embedding)) * 0.5, (WORD_KINDS, 1)).astype(np.float32), "w": init(2, embedding, 4 * hidden), "u": init(2, hidden, 4 * hidden), "b": bias, "out": init(2 * hidden, TAGS), "out_b": np.zeros(TAGS, np.float32),
        "trans": np.zeros((TAGS, TAGS), np.float32), "start": np.zeros(TAGS, np.float32), "end": np.zeros(TAGS, np.float32),
    }


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def loss_and_gradients(w: dict[str, np.ndarray], rows: np.ndarray, lengths: np.ndarray, gold: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean negative log-likelihood a text of the CRF, and its gradient by back-propagation."""
    n, t = rows.shape
    h = w["u"].shape[1]
    steps = np.arange(t)
    back = np.maximum(lengths[:, None] - 1 - steps[None, :], 0)
    both = np.stack([rows, np.take_along_axis(rows, back, 1)])  # direction, n, t
    x = w["emb"][both]  # 2, n, t, e
    inputs = np.matmul(x.reshape(2, n * t, -1), w["w"]).reshape(2, n, t, 4 * h) + w["b"][:, None, None, :]
    hs, cs, gs = np.zeros((t + 1, 2, n, h), np.float32), np.zeros((t + 1, 2, n, h), np.float32), np.empty((t, 2, n, 4 * h), np.float32)
    for i in range(t):
        g = inputs[:, :, i] + np.matmul(hs[i], w["u"])
        g[..., : 3 * h] = _sigmoid(g[..., : 3 * h])
        g[..., 3 * h :] = np.tanh(g[..., 3 * h :])
        gs[i] = g
        cs[i + 1] = cs[i] * g[..., h : 2 * h] + g[..., :h] * g[..., 3 * h :]
        hs[i + 1] = np.tanh(cs[i + 1]) * g[..., 2 * h : 3 * h]
    forward = hs[1:, 0].transpose(1, 0, 2)
    backward = np.take_along_axis(hs[1:, 1].transpose(1, 0, 2), back[:, :, None], 1)
    features = np.concatenate([forward, backward], axis=2)
    scores = features @ w["out"] + w["out_b"]
    mask = steps[None, :] < lengths[:, None]

    # forward and backward sums of the CRF
    alpha = np.empty((t, n, TAGS))
    alpha[0] = scores[:, 0] + w["start"]
    etrans = np.exp(w["trans"].astype(np.float64))
    for i in range(1, t):
        top = alpha[i - 1].max(axis=1, keepdims=True)
        step = np.log(np.exp(alpha[i - 1] - top) @ etrans) + top + scores[:, i]
        alpha[i] = np.where(mask[:, i, None], step, alpha[i - 1])
    last = alpha[-1] + w["end"]
    top = last.max(axis=1, keepdims=True)
    z = np.log(np.exp(last - top).sum(axis=1)) + top[:, 0]
    beta = np.empty((t, n, TAGS))
    beta[-1] = w["end"]
    for i in range(t - 2, -1, -1):
        inner = beta[i + 1] + scores[:, i + 1]
        top = inner.max(axis=1, keepdims=True)
        step = np.log(np.exp(inner - top) @ etrans.T) + top
        beta[i] = np.where(mask[:, i + 1, None], step, w["end"])
    marginal = np.exp(alpha + beta - z[None, :, None]).transpose(1, 0, 2)
    d_scores = marginal.copy()
    d_trans = np.zeros((TAGS, TAGS))
    for i in range(1, t):
        live = mask[:, i]
        if live.any():
            a = alpha[i - 1][live] - z[live, None] / 2
            b = beta[i][live] + scores[live, i] - z[live, None] / 2
            shift_a, shift_b = a.max(axis=1, keepdims=True), b.max(axis=1, keepdims=True)
            d_trans += (np.exp(a - shift_a) * np.exp(shift_a + shift_b)).T @ np.exp(b - shift_b) * etrans
    rows_at = np.arange(n)
    d_scores[rows_at[:, None], steps[None, :], gold] -= 1
    d_scores[~mask] = 0
    np.subtract.at(d_trans, (gold[:, :-1][mask[:, 1:]], gold[:, 1:][mask[:, 1:]]), 1)
    ends = gold[rows_at, lengths - 1]
    d_start, d_end = marginal[:, 0].sum(axis=0), marginal[rows_at, lengths - 1].sum(axis=0)
    np.subtract.at(d_start, gold[:, 0], 1)
    np.subtract.at(d_end, ends, 1)
    gold_score = (np.take_along_axis(scores, gold[:, :, None], 2)[:, :, 0] * mask).sum() + w["start"][gold[:, 0]].sum() + w["end"][ends].sum() + (w["trans"][gold[:, :-1], gold[:, 1:]] * mask[:, 1:]).sum()
    loss = float((z.sum() - gold_score) / n)

    d_scores = (d_scores / n).astype(np.float32)
    grad = {"out": features.reshape(n * t, -1).T @ d_scores.reshape(n * t, -1), "out_b": d_scores.sum(axis=(0, 1)), "trans": (d_trans / n).astype(np.float32), "start": (d_start / n).astype(np.float32), "end": (d_end / n).astype(np.float32)}
    d_features = d_scores @ w["out"].T
    d_hs = np.zeros((t, 2, n, h), np.float32)
    d_hs[:, 0] = d_features[:, :, :h].transpose(1, 0, 2)
    turned = np.take_along_axis(d_features[:, :, h:], back[:, :, None], 1) * mask[:, :, None]
    d_hs[:, 1] = turned.transpose(1, 0, 2)
    d_h, d_c = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
    d_g = np.empty((t, 2, n, 4 * h), np.float32)
    ut = w["u"].transpose(0, 2, 1)
    for i in range(t - 1, -1, -1):
        g, tc = gs[i], np.tanh(cs[i + 1])
        dh = d_h + d_hs[i]
        o, ig, fg, cand = g[..., 2 * h : 3 * h], g[..., :h], g[..., h : 2 * h], g[..., 3 * h :]
        dc = d_c + dh * o * (1 - tc * tc)
        d = d_g[i]
        d[..., 2 * h : 3 * h] = dh * tc * o * (1 - o)
        d[..., :h] = dc * cand * ig * (1 - ig)
        d[..., h : 2 * h] = dc * cs[i] * fg * (1 - fg)
        d[..., 3 * h :] = dc * ig * (1 - cand * cand)
        d_c = dc * fg
        d_h = np.matmul(d, ut)
    flat = d_g.transpose(1, 2, 0, 3)  # direction, n, t, gates
    grad["u"] = np.matmul(hs[:-1].transpose(1, 3, 0, 2).reshape(2, h, t * n), d_g.transpose(1, 0, 2, 3).reshape(2, t * n, 4 * h))
    grad["b"] = flat.sum(axis=(1, 2))
    grad["w"] = np.matmul(x.reshape(2, n * t, -1).transpose(0, 2, 1), flat.reshape(2, n * t, 4 * h))
    d_x = np.matmul(flat.reshape(2, n * t, 4 * h), w["w"].transpose(0, 2, 1)).reshape(-1, w["emb"].shape[1])
    grad["emb"] = np.zeros_like(w["emb"])
    order = np.argsort(both.ravel(), kind="stable")
    ids, first = np.unique(both.ravel()[order], return_index=True)
    grad["emb"][ids] = np.add.reduceat(d_x[order], first, axis=0)
    return loss, grad


def batch_of(samples: list[tuple[str, list[tuple[int, int, int]]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.array([len(t) for t, _ in samples])
    rows, gold = np.zeros((len(samples), lengths.max()), np.int64), np.zeros((len(samples), lengths.max()), np.int64)
    for i, (t, spans) in enumerate(samples):
        rows[i, : len(t)] = symbols(t)
        gold[i, : len(t)] = tags_of(len(t), spans)
    return rows, lengths, gold


class Feed:
    """Endless batches of made texts, cut to the window, each batch of like lengths."""

    def __init__(self, seed: int, size: int):
        self.maker, self.size, self.pool = Maker(seed), size, []
        self.rng = random.Random(seed)

    def __call__(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.pool:
            many = [self.maker.text() for _ in range(self.size * 16)]
            many = sorted(((t[:WINDOW], [(a, min(b, WINDOW), k) for a, b, k in s if a < WINDOW]) for t, s in many if t), key=lambda x: len(x[0]))
            self.pool = [many[i : i + self.size] for i in range(0, len(many) - self.size + 1, self.size)]
            self.rng.shuffle(self.pool)
        return batch_of(self.pool.pop())


_FEED: Feed | None = None


def _start(seeds, size: int) -> None:
    global _FEED
    _FEED = Feed(seeds.get(), size)


def _shard(w: dict[str, np.ndarray]) -> tuple[float, dict[str, np.ndarray]]:
    return loss_and_gradients(w, *_FEED())


def train(batches: int, hidden: int = 28, embedding: int = 16, size: int = 96, seed: int = 0, minutes: float = 1e9, report: int = 0, workers: int = 1, start: dict[str, np.ndarray] | None = None, top_rate: float = 0.008) -> dict[str, np.ndarray]:
    """Adam with a falling rate; each step averages the gradients of ``workers`` batches."""
    import multiprocessing

    w = {k: x.astype(np.float32) for k, x in start.items()} if start else new_weights(hidden, embedding, seed)
    m, v = {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}
    began, running = time.time(), 0.0
    if workers > 1:
        context = multiprocessing.get_context("fork")
        seeds = context.Queue()
        for i in range(workers):
            seeds.put(seed * 100 + i + 1)
        crew = context.Pool(workers, _start, (seeds, size))
        shards = lambda: crew.map(_shard, [w] * workers, 1)
    else:
        feed = Feed(seed + 1, size)
        shards = lambda: [loss_and_gradients(w, *feed())]
    for step in range(1, batches + 1):
        parts = shards()
        loss = sum(x for x, _ in parts) / len(parts)
        grad = {k: sum(g[k] for _, g in parts) / len(parts) for k in w}
        part = max(step / batches, (time.time() - began) / 60 / minutes)
        if part >= 1 and step < batches:
            break
        rate = top_rate * min(1.0, step / 30) * (0.02 + 0.98 * 0.5 * (1 + np.cos(np.pi * part)))
        norm = np.sqrt(sum(float((g**2).sum()) for g in grad.values()))
        for k, g in grad.items():
            g = g * min(1.0, 5.0 / (norm + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            w[k] = (w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        running = 0.95 * running + 0.05 * loss
        if report and step % report == 0:
            print(step, round(running, 3), round(time.time() - began), flush=True)
    return w


if __name__ == "__main__":
    minutes = float(sys.argv[1] if len(sys.argv) > 1 else 8)
    start = dict(np.load(sys.argv[3])) if len(sys.argv) > 3 else None  # a model to go on from
    if start and len(start["emb"]) == CHARACTERS:  # of a network that did not read the kinds of words
        start["emb"] = np.tile(start["emb"], (WORD_KINDS, 1))
    learned = train(100_000, minutes=minutes, report=100, workers=int(sys.argv[2]) if len(sys.argv) > 2 else 1, start=start, top_rate=0.004 if start else 0.008, seed=1 if start else 0)
    np.savez_compressed(MODEL, **{k: x.astype(np.float16) if x.ndim > 1 and k != "trans" else x for k, x in learned.items()})
