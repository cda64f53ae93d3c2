"""Labelled sentences for training the judges of personal information, from a fixed seed.

Everything is invented: family names are made of syllables, numbers are random.
A sentence is a list of pieces; ``{kind}`` slots are filled and labelled, the
rest, including the number-like and name-like traps, is not.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

from tessella.llm.names import NICKNAMES, TITLES, fold

SEED, N_SENTENCES = 20, 14_000

_FULL = sorted(NICKNAMES)
_SHORTS = sorted({s for v in NICKNAMES.values() for s in v.split()})
_SYLLABLES = "ba be bi bo bra ca co cre da de dro fa fe fi ga go gri ha hel in jo ka ke la le lin ma me mo na ne no or pa pe po qua ra re ri ro sa se so ta te ti to tru va ve vi wa wo xa ya zan zel".split()
_ENDS = "ro do ger mann son ssi lli ira ova enko ard olt ung ani ede eiro ães iski ette oux im and ura".split()
_TITLES = ["Dr.", "Dra.", "Sr.", "Sra.", "Mr", "Ms.", "Mrs.", "Prof.", "Prof", "dona"]
_TOWNS = ["Campo Belo", "Northwick", "Águas Claras", "Eastbrook", "Monte Verde", "Port Alder", "Vila Nova", "Greenholm"]
_PETS = ["Rex", "Fumaça", "Biscoito", "Pipoca", "Shadow", "Ginger", "Mel", "Luna"]
_DAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday", "January", "March", "July", "October", "December", "Easter", "Natal"]
_PLANS = ["Ouro", "Prata", "Horizonte", "Gold", "Basic", "Solar"]
_THINGS = ["vaso", "tear", "cadeado", "forno", "bilhete", "bicycle", "kiln", "loom", "invoice", "ticket", "seedling", "corrente"]
_SAY_EN = "zero one two three four five six seven eight nine".split()
_SAY_PT = "zero um dois três quatro cinco seis sete oito nove".split()
_HOSTS = ["correio", "mail", "posta", "caixa.norte", "inbox", "web-post", "box9"]
_ROOTS = ["example", "test", "invalid", "com", "org", "com.br"]

#: Sentences with something personal in them.
_PERSONAL = [
    "dear {name},", "hi {name},", "thanks, {name}", "best, {name}", "talk to {name} about the price", "I met {name} at the office", "{name} wrote back", "my sister {name} called", "prezado {name},", "oi {name},", "valeu, {name}", "att, {name}", "fale com {name} sobre o preço", "encontrei {name} no escritório", "{name} respondeu", "meu irmão {name} passou aí",
    "{spoken}", "my phone is {spoken}", "it is {spoken}", "meu telefone é {spoken}", "liga no {spoken}", "call {spoken} please",
    "aqui é {name}", "this is {name}", "falei ontem com {name}", "I spoke with {name} yesterday", "obrigado, {name}", "thank you {name}", "assinado, {name}", "regards, {name}",
    "ask {name} at the desk", "pergunte para {name} no balcão", "a reserva está em nome de {name}", "it is booked under {name}", "minha filha {name} também vai", "my son {name} comes too", "cc {name}",
    "quem vai retirar é {name}", "the pickup is by {name}", "a turma de {name} lotou", "the group of {name} is full", "{name}", "meu nome é {name}", "my name is {name}", "o cliente {name} ligou", "{name} ligou ontem", "deixei com {name} na portaria",
    "me liga no {phone}", "call me on {phone}", "tel. {phone}", "tel.: {phone}", "whats {phone} (só à tarde)", "text {phone} after six", "meu número novo: {phone}", "new number: {phone}", "o telefone de casa é {phone}", "the landline is {phone}",
    "ninguém atende no {phone} faz dias", "nobody picks up at {phone} these days", "{phone}", "reach me at {phone}",
    "o documento é {identity}", "my document is {identity}", "anote aí, {identity}", "please note {identity}", "segue para o cadastro: {identity}", "for the form: {identity}", "a ficha pede e eu informo {identity}, certo", "the desk wanted it, so {identity} it is", "{identity}",
    "escreva p/ {email} por favor", "cc {email} please", "my mail is {email} now", "não chegou nada em {email}", "{email}", "you can reach me at {email}", "<{email}>", "pode mandar o recibo para {email}",
    "moro em {address}", "I live at {address}", "mudei, agora é {address}", "we moved, it's {address} now", "a entrega é em {address}", "deliver it to {address}", "retirem o pacote em {address}", "the box was left at {address} by mistake", "{address}", "collect it from {address}",
]
#: Sentences with nothing personal, and with what looks like it.
_TRAPS = [
    "I need it by {Day} ok", "it broke and I need it by {Day} please", "see you on {Day}", "not before {Day} then", "{Day} works for me", "closed for {Day} and {Day}", "até {Day}, obrigado", "THE FRAME IS A {TOWN} 29", "the {plan} one is in the {Town} box",
    "(ref K00–{n7})", "note Q00 {n7}", "REF q00–{n7}", "ficha M00 {n7}", "ref R12 {n8} closed", "case 4–{n7} is open", "use code @{COUPON}{n4} today",
    "the {Town} office is open", "we flew to {Town} last week", "{Town} is far away", "the {plan} edition is out", "{pet} sleeps all day", "fomos a {Town} na semana passada", "a edição {plan} saiu", "chapter one two three", "count one two three four five", "um dois três e já", "see {Town} and {Town}", "buy {plan} or {plan}", "the {Fam} method works", "o teorema de {Fam} vale", "a rua {Fam} fechou",
    "o pedido nº {n10} veio errado", "order no. {n10} came wrong", "recebi o protocolo {year}-{n8}, e agora?", "I got ticket {year}-{n8}, what now?", "o app travou na versão {ver}", "the app hung on build {ver}", "mark it as paid, bill {n10}", "lote {n10}", "please note lot {n10}",
    "o valor cobrado foi {price} reais", "I was charged {price} dollars", "código de rastreio {track} não aparece", "tracking {track} shows nothing", "a peça custa {price}", "the kiln hit 1180 degrees at {clock}", "medi {n6} gramas de argila", "o forno chegou a {n6} graus", "the frame is a {Town} 29, serial {n10}", "o boleto termina em {n4}", "the card ends in {n4}",
    "meu cachorro {pet} comeu o {thing}", "my dog {pet} ate the {thing}", "quero o plano {plan} com entrega", "I want the {plan} plan", "moro em {Town} mesmo", "I live in {Town}", "mark my words, grace is thin here", "existe período de graça para a {thing}?", "falei ontem com a equipe", "I spoke with the front desk yesterday", "obrigado, equipe", "thank you all", "quem vai retirar é o motorista", "the pickup is by noon",
    "me liga no horário da loja", "call me on Monday", "o documento é o mesmo de antes", "my document is incomplete", "deliver it to the back door", "a entrega é em três dias", "a rua estava fechada e cheguei tarde", "the road was closed so I was late", "sala 214, bloco B, segundo andar", "room 12, block B, second floor", "use o cupom @{COUPON}{n4}", "use coupon @{COUPON}{n4}", "meu contato é pelo aplicativo", "my mail is full again",
    "regards from the whole choir", "aqui é da oficina de baixo", "Certo!", "Sure!", "Lembrete apagado.", "Reminder removed.", "vocês abrem terça?", "are you open Tuesday?", "Cancelei a entrega; não há cobrança.", "I cancelled the class; nothing is charged.", "a Livraria {Fam} Ltda fechou", "the {Fam} Bakery is closed", "Padaria {Fam} ME", "Escola {Fam} S.A.", "will you come on Friday?", "Will the bill come on Monday?", "city: {Town}; pet: {pet}; plan: {plan}; ref: M00-{n7}", "(ref K00-{n7})", "nota 46, ficha Q00-{n7}",
    "Sinto muito pelo {thing}, vou avisar a equipe.", "Sorry about the {thing}, I will tell the team.", "Não encontrei nada sobre o {thing}; pode repetir?", "There are two seats in the class on Thursday, 9:30.", "Há duas vagas na terça, 14h.", "SÓ QUERO O MEU {thing} DE VOLTA", "I JUST WANT MY {thing} BACK", "pode ser quinta", "yes, Thursday works", "a bicicleta é a Serra 29 e o aro {n4}", "gosta de {thing} azul", "Tracking {track} should appear by Friday.", "tem vaga na aula de sábado?", "o valor de {price} já consta como pago", "fé em dias melhores", "vale a pena",
]


class _Maker:
    def __init__(self, rng: random.Random):
        self.r = rng

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def family(self) -> str:
        r = self.r
        return ("".join(r.choice(_SYLLABLES) for _ in range(r.choice((1, 2, 2)))) + r.choice(_ENDS)).capitalize()

    def given(self) -> str:
        return self.accent(self.r.choice(_FULL)).capitalize()

    def accent(self, w: str) -> str:
        marks = {"jose": "josé", "luis": "luís", "leticia": "letícia", "ursula": "úrsula", "antonio": "antônio", "sebastiao": "sebastião", "patricia": "patrícia", "otavio": "otávio", "cecilia": "cecília", "vinicius": "vinícius", "tete": "tetê", "lele": "lelê", "ze": "zé", "tiao": "tião", "cica": "ciça", "fe": "fê"}
        return marks.get(w, w) if self.r.random() < 0.8 else w

    def name(self) -> tuple[str, str]:
        """(before, name): the form of address is not part of the name."""
        r, f = self.r, self.family()
        short = self.accent(r.choice(_SHORTS)).capitalize()
        made = [
            lambda: f"{self.given()} {f}", lambda: f"{self.given()} {f}", lambda: f"{self.given()} {self.family()} {f}", lambda: f"{self.given()} {self.family()[0]}. {f}", lambda: f"{self.given()[0]}. {f}", lambda: f"{self.given()[0]}. {self.family()} {f}",
            lambda: f"{short} {f}", lambda: f"{short} {f}", lambda: f"{f}, {self.given()}", lambda: f"{f.upper()}, {self.given()}", lambda: f"{self.given()} {r.choice(('de', 'da', 'do'))} {f}", lambda: self.given(), lambda: self.given(), lambda: self.given(), lambda: self.given(), lambda: short,
        ]
        x = r.random()
        if x < 0.12:
            return r.choice(_TITLES) + " ", f if r.random() < 0.7 else f"{self.given()} {f}"
        n = r.choice(made)()
        if x < 0.22:
            n = n.lower() if not n.startswith(f) else n
        elif x < 0.32:
            n = n.upper()
        return "", n

    def phone(self) -> str:
        r, d = self.r, self.digits
        a, b, c = str(r.randint(11, 99)), "9" + d(4), d(4)
        return r.choice([
            f"({a}) {b}-{c}", f"({a}) 3{d(3)}-{c}", f"{a} {b} {c}", f"{a}.{b}.{c}", f"+55 {a} {b}-{c}", f"+55 ({a}) 3{d(3)} {c}", f"0055-{a}-{b}.{c}", f"{b[0]} {d(2)} {d(2)} {d(2)} {d(2)}, ddd {a}", f"555 {d(4)}", f"555-{d(4)} ext. {d(2)}", f"555-{d(4)}",
            f"+1 (555) 555-{d(4)}", f"+44 20 7946 {d(4)}", f"{a}{b}{c}", f"{b}-{c}", f"3{d(3)}-{c} ramal {d(2)}", f"+1-555-{d(3)}-{d(4)}",
        ])

    def spoken(self) -> str:
        """A phone number said digit by digit."""
        words = self.r.choice((_SAY_EN, _SAY_PT))
        return self.r.choice((" ", " ", ", ", "-")).join(words[int(c)] for c in self.digits(self.r.choice((7, 8, 9, 10, 11))))

    def identity(self) -> str:
        r, d = self.r, self.digits
        dots = f"{d(3)}.{d(3)}.{d(3)}-{d(2)}"
        return r.choice([
            dots, f"CPF {d(11)}", f"CPF: {d(9)}-{d(2)}", f"cpf nº {dots}", f"CPF {dots}", f"{d(3)} {d(3)} {d(3)} {d(2)} (CPF)", f"RG {d(2)}.{d(3)}.{d(3)}-{d(1)}", f"SSN {d(3)}-{d(2)}-{d(4)}", f"social security {d(3)} {d(2)} {d(4)}", f"passport no. {r.choice('ABZ')}{r.choice('QXY')}{d(7)}", f"passaporte {r.choice('FGZ')}{r.choice('ABX')}{d(6)}", f"RG {d(8)}-{d(1)}",
        ])

    def email(self) -> str:
        r = self.r
        local = fold(r.choice([f"{self.given()}.{self.family()}", f"{self.given()}_{self.family()[:4]}", f"{self.family()}{self.digits(2)}", f"{self.given()}+news", self.given()[0] + self.family(), self.given() + self.family()])).lower()
        host, root = r.choice(_HOSTS), r.choice(_ROOTS)
        x = r.random()
        if x < 0.7:
            m = f"{local}@{host}.{root}"
            return m.upper() if r.random() < 0.1 else f"mailto:{m}" if r.random() < 0.1 else m
        if x < 0.8:
            return f"{local} @ {host}.{root}"
        if x < 0.9:
            return f"{local} (at) {host} (dot) {root}".replace(".", " (dot) ")
        return re.sub(r"\W", "", local) + f" arroba {host} ponto {root}".replace(".", " ponto ")

    def address(self) -> str:
        r, d, f = self.r, self.digits, self.family()
        n, town, cep = str(r.randint(1, 2500)), r.choice(_TOWNS), f"{d(5)}-{d(3)}"
        return r.choice([
            f"Rua {f}, {n}, apto {d(2)}, {town}", f"r. {f.lower()}, {n} fundos", f"Av. {f} {n} – bloco {r.choice('ABC')}", f"Avenida {f}, {n}", f"Praça {f}, s/n, {town}, {cep}", f"Travessa do {f} nº {n}, CEP {cep}", f"Estrada {f}, km {d(2)}, casa {d(2)}", f"Alameda {f} {self.family()}, {n}",
            f"{n} {f} Lane, Apt {d(2)}, {town}", f"{n} {f} St., {town}", f"Flat {d(2)}, {n} {f} Road", f"{n} {f} Avenue", f"{n} {f} {self.family()} Street, {town}",
        ])

    def trap(self, key: str) -> str:
        r, d = self.r, self.digits
        if key[0] == "n" and key[1:].isdigit():
            n = int(key[1:])
            return f"{d(3)}.{d(3)}" if n == 6 else d(n)
        return {
            "year": lambda: str(r.randint(2020, 2027)), "ver": lambda: f"{r.randint(1, 12)}.{r.randint(0, 30)}.{r.randint(0, 30)}.{r.randint(0, 255)}", "price": lambda: r.choice((f"{r.randint(1, 999)},{d(2)}", f"{r.randint(1, 999)}.{d(2)}", f"1.{d(3)},{d(2)}-")),
            "track": lambda: "".join(r.choice("ABCDEFGHJKNPRSVXYZ") for _ in range(2)) + d(9) + "ZZ", "clock": lambda: f"{d(2)}:{d(2)}:{d(2)}", "pet": lambda: r.choice(_PETS), "plan": lambda: r.choice(_PLANS), "Day": lambda: r.choice(_DAYS), "TOWN": lambda: r.choice(_TOWNS).upper(), "Town": lambda: r.choice(_TOWNS), "thing": lambda: r.choice(_THINGS), "COUPON": lambda: r.choice(_THINGS).upper(), "Fam": self.family,
        }[key]()


_SLOT = re.compile(r"\{(\w+)\}")


def sentences() -> Iterator[tuple[str, list[tuple[str, int, int]]]]:
    """(text, [(kind, from, to)]) of every synthetic text."""
    rng = random.Random(SEED)
    mk = _Maker(rng)
    for _ in range(N_SENTENCES):
        text, truth = "", []
        joint = rng.choice([". ", "; ", "\n", ", ", " / "])
        for k in range(rng.choice((1, 1, 2, 2, 3))):
            if k:
                text += joint
            for i, piece in enumerate(_SLOT.split(rng.choice(_PERSONAL if rng.random() < 0.55 else _TRAPS))):
                if i % 2 == 0:
                    text += piece
                elif piece in ("phone", "identity", "email", "address", "spoken"):
                    value = getattr(mk, piece)()
                    truth.append(("phone" if piece == "spoken" else piece, len(text), len(text) + len(value)))
                    text += value
                elif piece == "name":
                    before, value = mk.name()
                    text += before
                    truth.append(("name", len(text), len(text) + len(value)))
                    text += value
                else:
                    text += mk.trap(piece)
        x = rng.random()
        if x < 0.03 and text.upper() and len(text.upper()) == len(text):
            text = text.upper()
        elif x < 0.06 and len(text.lower()) == len(text):
            text = text.lower()
        yield text, truth


def things() -> frozenset:
    """The words of towns, pets and plans: written with a capital, and no names of persons."""
    return frozenset(fold(w) for t in _TOWNS + _PETS + _PLANS + _DAYS for w in re.findall(r"[^\W\d_]{2,}", t))


def ordinary_words() -> frozenset:
    """The words of the templates."""
    out = set()
    for t in _PERSONAL + _TRAPS + _THINGS:
        out |= {fold(w) for w in re.findall(r"[^\W\d_]{2,}", _SLOT.sub(" ", t))}
    return frozenset(out - set(_FULL) - TITLES)
