"""Made-up sentences with labelled personal data in four languages, to train ``pii`` on.

A sentence is put together from an opener, a passage and a closer that are drawn apart, so that a few hundred parts give
tens of thousands of frames; names, numbers and streets are made from rules of their own. Sentences without personal data
hold what looks like it: places, bodies, batch numbers, dates, measures. ``HELD_OUT`` in the tests is written apart.
"""

from __future__ import annotations

import random

_SYLLABLES = (
    "ba be bi bo cor da del dor em er fa fen gor had hal il is ja jo kar kir la lin lu mar mor nak nim o or pa per qui ras ro sal san sul ta tes tri ul va ven wen yo za zwar dal vik lund hof rac mont "
    "bert sen ska nen lle tov ann el ma ria son ham ton ley ker man el gar cía rez ño lez ran gue sch mid mül ler fer ein hart bau wol ke hei nri ch jean luc pi erre thi baut dup ont mi chel ant oine "
    "el ena ste fan ni co la giu lia ros si smi th ca rter jo hn sa rah han na em ily wi lli am pe ter so fi a lea no ah li am jón sø ren åke świ ęt ch en wa ng li zh ao ya mi ha ru ka to"
).split()
PARTICLES = ("de", "de la", "del", "van", "van der", "von", "di", "da", "dos", "bin", "le", "du", "zu", "ter", "y")


def word(r: random.Random, least: int = 2) -> str:
    text = "".join(r.choice(_SYLLABLES) for _ in range(r.choice((least, least, 2, 3, 3, 4))))
    return text[:1].upper() + text[1:]


def name(r: random.Random) -> str:
    first, last = word(r), word(r)
    if r.random() < 0.08:
        last += "-" + word(r)
    if r.random() < 0.04:
        last = r.choice(("O'", "Mc", "Mac", "D'")) + last
    if r.random() < 0.05:
        first += "-" + word(r)
    if r.random() < 0.03:
        last = r.choice(("Li", "Wu", "Ng", "Xu", "Ek", "Ito", "Kim", "Roy", "Fox"))
    form = r.random()
    if form < 0.40:
        out = f"{first} {last}"
    elif form < 0.50:
        out = f"{first} {r.choice(PARTICLES)} {last}"
    elif form < 0.56:
        out = f"{last}, {first}"
    elif form < 0.61:
        out = f"{last.upper()} {first}"
    elif form < 0.64:
        out = f"{first} {last.upper()}"
    elif form < 0.70:
        out = f"{first[0]}. {last}"
    elif form < 0.74:
        out = f"{first} {r.choice('ABCDEFGHJKLMNPRSTVW')}. {last}"
    elif form < 0.84:
        out = last
    elif form < 0.88:
        out = last.upper()
    elif form < 0.93:
        out = f"{first} {word(r)} {last}"
    elif form < 0.96:
        out = f"{first} {word(r)} {r.choice(PARTICLES)} {last} {word(r)}"
    elif form < 0.98:
        out = f"{first} {word(r)} {word(r)} {last} {word(r)}"
    else:
        out = f"{first} {last} {r.choice(PARTICLES)} {word(r)}"
    if r.random() < 0.10:
        out = out.lower()
    elif r.random() < 0.04:
        out = out.upper()
    return out.replace(" ", " ", 1) if r.random() < 0.03 else out


def digits(r: random.Random, mask: str) -> str:
    """# a digit, @ a capital letter, the rest as it is."""
    return "".join(str(r.randrange(10)) if c == "#" else r.choice("ABCDEFGHJKLMNPQRSTUVWXYZ") if c == "@" else c for c in mask)


ID_MASKS = (
    "@@-####-#####", "@@#######", "@@ ## ## ## @", "@@######@", "###.###.###-##", "########-@", "1 ## ## ## ### ### ##", "2 ## ## ## ### ### ##", "9##-##-####", "###-##-####", "@#######@", "########@", "@########",
    "@@@######", "@@@@######@@@@@@##", "## ###### @ ###", "####-####-####", "######-####", "###########", "#########", "@##-###-###", "@@ ######", "##.##.##-###.##", "@# ### ###", "########", "#### ##### ####", "@@@-######-@", "##-#######",
)
PHONE_MASKS = (
    "+44 #### ######", "+44 (0)## #### ####", "+44 ## #### ####", "+44########## ", "0#### ######", "07### ######", "+1 ### ### ####", "+1-###-###-####", "+1 (###) ###-####", "(###) ###-####", "###-###-####", "1.###.###.####", "+1.###.###.####",
    "+33 # ## ## ## ##", "0033 # ## ## ## ##", "0# ## ## ## ##", "0#.##.##.##.##", "+33 (0)# ## ## ## ##", "+49 ## ##### ###", "+49 ### #######", "0## / ##### ###", "0###/######", "0### ########", "+49-###-######", "+34 ### ### ###", "+34 ### ## ## ##",
    "9## ### ###", "6## ## ## ##", "+41 ## ### ## ##", "+31 # ########", "+39 ### #######", "+351 ### ### ###", "+52 ## #### ####", "+91 ##### #####", "+254 ### ######", "00## ### ### ####", "+##########", "+############", "##########", "+45 ## ## ## ##", "+46 ##-### ## ##",
)
TOWNS = ("Norwick", "Saint-Aubin", "Villanova", "Grünfeld", "Ostra", "Kelham", "Port Marran", "Belmonte", "Aldorf", "Les Ormes", "Harle", "Santa Ilda")
MONTHS = "January February March April May June July August September October November December janvier mars avril juin août enero marzo abril junio agosto Januar März Mai Juli Oktober Dezember".split()
BODIES = (
    "the Ministry of Agriculture", "the Regional Veterinary Office", "World Animal Health Watch", "Lake District", "the Northern Province", "the Central Laboratory", "the European Union", "the Directorate General", "la Direction des Services", "el Ministerio de Agricultura",
    "das Bundesamt", "the District Council", "Green Valley Farm", "the Upper River Basin", "Highland Holdings", "African Swine Fever", "Foot and Mouth Disease", "Newcastle Disease", "Rift Valley Fever", "Bluetongue", "Avian Influenza", "Trend Analysis", "Weekly Situation Report",
    "Rhode Island Red", "Holstein Friesian", "Monday Market", "New Year", "Good Friday", "the Animal Movement Book", "National Reference Laboratory", "Bacillus anthracis", "the Border Post", "Open Data Portal", "la Casa Grande", "der Alte Hof",
)
_STREET_EN = ("Street", "St", "St.", "Road", "Rd", "Rd.", "Lane", "Ln", "Close", "Avenue", "Ave.", "Ave", "Drive", "Dr", "Court", "Boulevard", "Blvd", "Way", "Place", "Terrace", "Crescent", "Square", "Hill", "Row", "Parade", "Highway", "Grove", "Mews", "Gardens")
_STREET_FR = ("rue", "Rue", "chemin", "avenue", "Avenue", "impasse", "place", "allée", "quai", "route", "boulevard", "Boulevard", "cours", "square")
_STREET_ES = ("Calle", "calle", "C/", "Camino", "Plaza", "Avenida", "Avda.", "Paseo", "Carrera", "Ronda", "Travesía", "Carretera")
_STREET_DE = ("straße", "str.", "strasse", "weg", "gasse", "platz", "allee", "ring", "damm", "kamp", "ufer", "steig", "berg", "hof")


def address(r: random.Random) -> str:
    n = str(r.randrange(1, 400)) + (r.choice("ABCabc") if r.random() < 0.12 else "")
    w = " ".join(word(r) for _ in range(r.choice((1, 1, 2, 2, 3))))
    form = r.random()
    if form < 0.36:
        unit = f"{r.choice(('Flat', 'Apt', 'Apartment', 'Unit', 'Suite', 'Room', 'Apt.'))} {r.randrange(1, 60)}{r.choice(('', '', 'A', 'B'))}, " if r.random() < 0.25 else ""
        out = f"{unit}{n} {w} {r.choice(_STREET_EN)}"
    elif form < 0.58:
        of = r.choice(("", "", "de ", "de la ", "du ", "des ", "de l'", "d'"))
        out = f"{n}{r.choice(('', '', '', ' bis', ' ter', ','))} {r.choice(_STREET_FR)} {of}{w}"
    elif form < 0.78:
        of = r.choice(("", "", "de ", "de la ", "del ", "de los "))
        out = f"{r.choice(_STREET_ES)} {of}{w}{r.choice((' ', ' ', ', ', ' n.º ', ' nº ', ', núm. '))}{n}{r.choice(('', '', '', ', 2.º B', ', piso 3', ', bajo'))}"
    elif form < 0.93:
        out = f"{r.choice(('', '', '', 'Obere ', 'Alte ', 'Neue '))}{word(r)}{r.choice(_STREET_DE)} {n}"
    else:
        out = f"{r.choice(('Am', 'An der', 'Zum', 'Im', 'Auf dem', 'Unter den', 'Hinter der'))} {word(r)} {n}"
    return out


def email(r: random.Random) -> str:
    user = r.choice(("{a}.{b}", "{a}_{b}", "{a}{n}", "{b}", "{a}-{b}", "{c}{b}", "info", "{a}.{b}+{n}", "office.{b}")).format(a=word(r).lower(), b=word(r).lower(), c=r.choice("abcdejkmprst"), n=r.randrange(1, 999))
    host = ".".join([word(r).lower() for _ in range(r.choice((1, 1, 2, 3)))] + [r.choice(("org", "com", "net", "example", "gov", "fr", "es", "de", "co.uk", "int", "info"))])
    at, dot = r.choice((("@", "."), ("@", "."), ("@", "."), ("@", "."), (" (at) ", "."), ("[at]", "[dot]"), (" at ", " dot "), ("＠", "."), (" @ ", "."), ("(at)", "(dot)")))
    out = f"{user}{at}{host.replace('.', dot)}"
    return out.upper() if r.random() < 0.04 else out.title() if r.random() < 0.03 else out


ROLES = "farm manager,owner,keeper,veterinarian,inspector,farmer,neighbour,shepherd,foreman,driver,vet,official,technician,breeder,herdsman,district officer,stockman,witness,patient,applicant,director".split(",")
TITLES = ("Dr", "Dr.", "Mr", "Mr.", "Mrs", "Mrs.", "Ms", "Ms.", "Prof.", "Professor", "Herr", "Frau", "M.", "Mme", "Monsieur", "Madame", "Sr.", "Sra.", "Señor", "Señora", "Don", "Doña", "Herrn", "Miss", "Sir", "Dra.", "Dott.")
NAME_OPEN = (
    "According to ", "Reported by ", "Interview with ", "Contact: ", "Contact person - ", "contact person: ", "Please contact ", "Please ask ", "Ask for ", "Questions go to ", "Signed: ", "Signed by ", "Attention: ", "For the attention of ", "My name is ", "I am ", "Owner: ", "Name: ", "Full name: ",
    "The {role}, ", "The {role} ", "Our {role} ", "the {role}, ", "{role} ", "We spoke with ", "The call came from ", "Samples were taken by ", "The holding belongs to ", "The land is owned by ", "The report was filed by ", "It was ", "cc ", "From: ", "To: ", "Dear ", "Regards, ", "Inspected by ", "visited by ",
    "Selon ", "D'après ", "Signalé par ", "L'exploitation appartient à ", "Le propriétaire, ", "Je m'appelle ", "Contactez ", "Nom : ", "Bonjour ", "L'éleveur ", "Signé : ", "Demandez à ", "Visité par ", "Según ", "Avisó ", "La granja es de ", "El dueño, ", "Me llamo ", "Pregunte por ", "Nombre: ",
    "Estimada ", "Contacto: ", "Firmado: ", "El veterinario ", "Informó ", "Laut ", "Gemeldet von ", "Der Betrieb gehört ", "Der Halter, ", "Mein Name ist ", "Fragen Sie ", "Ansprechpartner: ", "Name: ", "Sehr geehrte ", "Gezeichnet: ", "Die Tierärztin ", "Besuch von ", "",
)
NAME_CLOSE = (
    ".", ".", ". ", ", ", " said the flock was calm.", ", who runs the holding, called twice.", " on site.", " on Monday.", " (owner).", " - farm manager", "; see the file.", " told the team that nothing had changed.", " first saw the sick birds.", ", keeper, agreed.", " about the delivery.", " was not at home.", "\n",
    " | phone below", " and the neighbours helped.", " will bring the samples.", " signed the form.", " wrote back.", " has moved away.", ", the feed was changed.", ", l'aliment avait changé.", " a appelé hier.", " sur place.", ", éleveur, confirme.", " n'était pas là.", " dice que no.", ", cambió el pienso.", " llamó ayer.",
    " no estaba.", ", ganadero, lo vio.", " wurde das Futter gewechselt.", " hat angerufen.", " war nicht da.", ", Landwirt, bestätigt das.", " vor Ort.", "'s herd was moved.", "?", "!", ": yes", " tomorrow", ";",
)
OPEN = {
    "email": ("Write to ", "E-mail: ", "email ", "Mail ", "Contact ", "Reach us at ", "Send it to ", "cc: ", "Adresse : ", "Courriel : ", "Écrire à ", "Correo: ", "Escriba a ", "E-Mail an ", "Schreiben Sie an ", "", "(", "<", "From: ", "Kontakt: ", "the list is kept by "),
    "phone": ("Call ", "Tel. ", "Tel: ", "Phone: ", "phone ", "Mobile ", "reach him on ", "can be reached on ", "ring ", "Fax ", "Tél. : ", "Téléphone ", "Appelez le ", "joindre au ", "Tfno. ", "Teléfono: ", "Llame al ", "móvil ", "Telefon: ", "Tel.: ", "erreichbar unter ", "Rufen Sie ", "Hotline ", "WhatsApp ", "", "on "),
    "id_number": (
        "National ID ", "ID no. ", "ID card ", "Passport ", "passport number ", "Passport No: ", "SSN ", "Social security number ", "Identity number ", "identity card no. ", "NI number ", "Driving licence ", "tax number ", "Keeper ID ", "personal number ", "born 1971, ID ", "Numéro de sécurité sociale ", "NIR : ",
        "Carte d'identité n° ", "Passeport ", "DNI ", "DNI: ", "NIE ", "Cédula ", "CURP ", "Pasaporte n.º ", "Personalausweis ", "Ausweisnummer ", "Reisepass Nr. ", "Steuer-ID ", "Sozialversicherungsnummer ", "CPF ", "document d'identité ", "documento ", "Ausweis ",
    ),
    "street_address": (
        "He lives at ", "She lives at ", "The office is at ", "Address: ", "address ", "Deliver to ", "found at ", "premises at ", "The keeper's house, ", "moved to ", "Visit us at ", "from ", "Adresse : ", "Il habite au ", "domicilié ", "Le bureau se trouve ", "livrer au ", "Vive en ", "Domicilio: ", "Dirección: ",
        "La oficina está en ", "Wohnhaft ", "Adresse: ", "wohnt in der ", "Das Büro ist ", "Anschrift: ", "", "Home: ", "at ",
    ),
}
CLOSE = (
    ".", ".", ". ", ", ", " for the list.", " today.", " was checked.", " with two dogs.", " until noon.", " - ", ";", "\n", " |", ")", " and wait.", ", {town}.", " in {town}.", ", {town}", " (home)", " pour la liste.", " aujourd'hui.", " à {town}.", " hoy.", " en {town}.", " para la lista.", " heute.", " in {town}.",
    " wurde geprüft.", ". It was cold.", ", please", " or later", " if urgent",
)
MAKE = {"email": email, "id_number": lambda r: digits(r, r.choice(ID_MASKS)), "street_address": address, "phone": lambda r: digits(r, r.choice(PHONE_MASKS)).strip()}
PLAIN = (
    "Accession {x} was logged.", "Lot {n} was closed on {d}.", "Tag range {n} to {m} was read twice.", "{b} published its figures on {d}.", "Between {d} and {e}, {n} birds died and {m} were culled.", "Batch {x} arrived at {t}.", "The distance is {n}.{k} km at {k} degrees.", "Report no. {x}, version {k}.",
    "{b} asked {c} for help.", "In {t}, the market reopened.", "The strain resembles {x}.", "Temperatures rose from {k} to {j} degrees in {M}.", "Room {k} holds {n} doses.", "See figure {k} and table {j}.", "Order {n}-{m} was shipped.", "On {M} {k}, {y}, the zone was lifted.", "The price was {n}.{k} per head.",
    "Ear tag {x} was missing.", "Le lot {n} a été fermé à {t}.", "{b} a publié {n} cas.", "El lote {n} se cerró en {t}.", "{b} informó de {n} casos el {d}.", "Die Charge {n} kam nach {t}.", "{b} meldete {n} Fälle am {d}.", "Version {k}.{j}.{k} of the form.", "Coordinates {k}.{n}, -{j}.{m}.", "Sample {x} tested negative.",
    "The Hen House on the hill was empty.", "Most keepers know this.", "The keeper lives near {t}.", "They moved to the old road.", "Nothing else was found on site.", "Call back later, please.", "Contact tracing goes on.", "Reported by phone on {d}.", "The owner agreed.", "According to the plan, work goes on.", "Signed and sealed.",
    "Selon le plan, rien ne change.", "Laut Plan bleibt alles.", "Según el plan, todo sigue.", "Interview with the keeper, part {k}.", "The form asks for name and address.", "Dr on duty: see list.", "ISBN 978-{k}-{n}-{m}-{k}.", "Invoice {x} for {n} euros.", "Herd {n} of holding {x}.", "Permit {n}/{y} expired.",
)


def plain(r: random.Random) -> str:
    """A sentence without personal data."""
    x = digits(r, r.choice(("EPI-####-###-#####", "@@@-##-####", "H#N#/####", "LAB#####", "ACC ######", "B-###/##", "Q######", "##/####", "A/duck/####/##", "MN######")))
    day = f"{r.randrange(1, 28)} {r.choice(MONTHS)} {r.randrange(1998, 2026)}" if r.random() < 0.5 else f"{r.randrange(1998, 2026)}-{r.randrange(1, 13):02}-{r.randrange(1, 28):02}"
    body, other = r.choice(BODIES), r.choice(BODIES)
    return r.choice(PLAIN).format(x=x, n=r.randrange(10, 9999), m=r.randrange(10, 9999), k=r.randrange(1, 40), j=r.randrange(1, 40), d=day, e=day, y=r.randrange(1990, 2026), M=r.choice(MONTHS), t=r.choice(TOWNS), b=body[:1].upper() + body[1:], c=other)


ID_WORDS = ("passport", "identity card", "ID", "SSN", "national ID", "licence", "tax number", "passeport", "carte d'identité", "DNI", "pasaporte", "documento", "Ausweis", "Personalausweis", "Reisepass", "identity document", "insurance number", "personal number")
PLACE_KINDS = ("{w} District", "{w} Province", "the {w} River", "Lake {w}", "{w} County", "Port {w}", "North {w}", "{w} Valley", "{w} Market", "Mount {w}", "Saint-{w}", "{w} Farm", "the {w} Institute", "{w}shire", "{w} region", "{w} virus", "the {w} Report", "Camp {w}", "{w} University", "{w} GmbH", "{w} Ltd")


def inserted(r: random.Random, background: list[str]) -> tuple[str, tuple[int, int, str] | None]:
    """A passage, or a place's name, between any two words of a sentence that has neither: what tells it is its shape."""
    words = (r.choice(background) if background and r.random() < 0.7 else plain(r)).split()
    at = r.randrange(1, len(words)) if len(words) > 1 else len(words)
    before, after = " ".join(words[:at]).rstrip(",;") + r.choice((" ", " ", " ", " ", ", ", ": ", " (")), r.choice((" ", " ", " ", ", ", ". ", ") ")) + " ".join(words[at:])
    pick = r.random()
    if pick < 0.14:
        return before + r.choice(("in ", "near ", "at ", "from ", "", "à ", "en ", "bei ")) + r.choice(PLACE_KINDS).format(w=word(r)) + after, None
    if pick < 0.20:
        return before + r.choice((*BODIES, *TOWNS)) + after, None
    if pick < 0.56:
        kind, passage = "name", name(r)
        if " " not in passage.replace("\u00a0", " ") or passage.islower():
            before += r.choice(TITLES) + " "
        elif r.random() < 0.2:
            before += r.choice(TITLES) + " " if r.random() < 0.5 else r.choice(ROLES) + " "
    else:
        kind = r.choice(("email", "phone", "id_number", "street_address", "street_address"))
        passage = MAKE[kind](r)
        if kind == "id_number":
            before += r.choice(ID_WORDS) + r.choice((" ", " ", " no ", " no. ", " n° ", ": ", " is ", " ist ", " (", " number "))
        elif kind == "phone" and passage.isdigit():
            before += "tel. "
    return before + passage + after, (len(before), len(before) + len(passage), kind)


def sentence(r: random.Random, background: list[str] = ()) -> tuple[str, tuple[int, int, str] | None]:
    """A sentence and its labelled span, or None where it has none."""
    if r.random() < 0.55:
        return inserted(r, background)
    pick = r.random()
    if pick < 0.28:
        return plain(r), None
    if pick < 0.62:
        before = r.choice(NAME_OPEN).format(role=r.choice(ROLES))
        if r.random() < 0.35 or not before:
            before += r.choice(TITLES) + " "
        kind, passage, after = "name", name(r), r.choice(NAME_CLOSE)
    else:
        kind = r.choice(tuple(MAKE))
        before, passage, after = r.choice(OPEN[kind]), MAKE[kind](r), r.choice(CLOSE)
        if kind == "phone" and not before and passage.isdigit():
            before = "Tel. "
    after = after.format(town=r.choice(TOWNS))
    return before + passage + after, (len(before), len(before) + len(passage), kind)


def text(r: random.Random, background: list[str], length: int) -> tuple[str, list[tuple[int, int, str]]]:
    """Sentences, some of them from real texts without labels, up to a length."""
    out, spans = "", []
    while len(out) < length:
        if background and r.random() < 0.22:
            piece, span = r.choice(background), None
        else:
            piece, span = sentence(r, background)
        if span:
            spans.append((len(out) + span[0], len(out) + span[1], span[2]))
        out += piece + r.choice((" ", " ", " ", "\n", "  "))
    return out, spans
