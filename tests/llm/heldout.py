"""Sentences with personal data, written apart from the training frames: [kind:passage] marks a passage."""

import re

SENTENCES = """
The farm manager, [name:John Carter], told investigators that feed had arrived late.
My name is [name:Sarah Connor] and I keep forty hens.
You could ask [name:Peter Hansen] whether the gate was shut.
The attending veterinarian [name:Elena Rossi] took six swabs.
For the attention of [name:Jean Dupont], department of herds.
[name:Mrs] is a title here, but Mrs [name:Jane Doe] is a person.
Ana's cousin, [name:Ana de la Cruz], keeps the goats.
Two days later [name:Ludwig van Beethoven] returned the questionnaire.
Dr [name:María del Carmen López García] chaired the meeting.
It was Dr [name:Li] who noticed the swelling first.
A note by [name:SMITH] was pinned to the door.
Yesterday [name:Thomas Müller] and [name:Ingrid Sørensen] compared their lists.
The complaint of [name:Patrick O'Brien] was withdrawn.
Thanks go to [name:Fatima bint Khalid] for the photographs.
Hired in spring, [name:Giulia Bianchi] cleans the sheds.
We were met by [name:Robert McAllister] at the quarry.
[name:Hans-Peter Vogel] hat die Tür geöffnet.
Am Telefon war Frau [name:Annika Lindqvist] sehr freundlich.
Der Schäfer [name:Karl von der Heide] zählte nach.
Auskunft gibt Herr [name:Jürgen Baumgartner] gern.
Notre voisine, Mme [name:Claire Lefèvre], a vu le camion.
Le vétérinaire [name:Étienne Marchand] est passé mardi.
Le rapport de M. [name:Olivier de Villiers] manque encore.
Ayer vino don [name:Francisco Javier Ortega Ruiz] con su hijo.
La doctora [name:Lucía Fernández] tomó muestras.
Quien firma es [name:Carlos Mendoza], encargado del corral.
The minutes name [name:Wilson, Margaret] as chair.
Witness statement of [name:A. K. Sharma], second page.
The gate code was given to [name:Noah Fischer] alone.
Replacing [name:Oluwaseun Adeyemi] took three weeks.
Her new office: [street_address:14 Rue Victor Hugo], Lyon.
Parcels should go to [street_address:5 Elm Boulevard], Kelham.
The van stood outside [street_address:221B Baker Street] all night.
Our depot moved to [street_address:78 Northgate Avenue] last autumn.
Inspectors went to [street_address:Flat 12, 9 Harbour Crescent] without success.
The cheque was mailed to [street_address:1600 Pine Hollow Road], Ostra.
Elle travaille au [street_address:27 avenue des Tilleuls] depuis mai.
Rendez-vous [street_address:3 bis, chemin du Moulin] à neuf heures.
Le dépôt du [street_address:112 quai de la Loire] est fermé.
El taller queda en [street_address:Calle Mayor 45], junto al río.
Nos mudamos a [street_address:Avenida de la Paz 7] en junio.
El corral de [street_address:Camino Viejo 118] está vacío.
Unser Hof liegt in der [street_address:Lindenstraße 22] am Ortsrand.
Die Lieferung ging an [street_address:Alte Mühlgasse 3], Aldorf.
Man findet uns [street_address:Am Kirchplatz 9] neben der Post.
Seine Werkstatt, [street_address:Bergweg 41a], brannte ab.
His number on the form reads [id_number:123-45-6789], in pencil.
The traveller's passport [id_number:AB1234567] had expired.
National insurance: [id_number:QQ 12 34 56 C] as printed.
She showed identity document [id_number:X4829175K] at the gate.
Identity card [id_number:C01X00T47] was copied.
Copied from his identity card: [id_number:90 12 31 123 45] on both sides.
The holder of ID [id_number:ZX-4410-88213] is barred.
Passport no [id_number:P4481920] belongs to the driver.
Son numéro de sécurité sociale, [id_number:1 85 05 78 006 084 36], figure en bas.
Carte nationale d'identité [id_number:880692310285] vérifiée.
Con DNI [id_number:12345678-Z] y sin fecha.
Pasaporte [id_number:XDB123456] retenido en frontera.
Seine Ausweisnummer ist [id_number:L01X00T471], gültig bis Mai.
Personalausweis [id_number:T22000129] lag bei.
The clerk wrote down SSN [id_number:987-65-4320] twice.
Tax ID [id_number:529.982.247-25] on the receipt.
If the dog limps, dial [phone:+44 20 7946 0958] at once.
Her mobile is [phone:07700 900123], evenings only.
Dispatch answers at [phone:(555) 123-4567] around the clock.
From abroad use [phone:+1 202 555 0143] instead.
The night desk, [phone:+1-303-555-0199], keeps a log.
Numéro du cabinet : [phone:01 42 68 53 00], répondeur le soir.
Vous pouvez téléphoner au [phone:+33 6 12 34 56 78] avant midi.
Nuestro número es [phone:+34 912 345 678] en horario de oficina.
Si no contesta, marque [phone:612 34 56 78] otra vez.
Die Zentrale hat [phone:+49 30 901820] als Nummer.
Mobil meist unter [phone:0151 23456789] zu sprechen.
In Bern gilt [phone:+41 31 322 21 11] für Notfälle.
A text to [phone:+254 712 345678] is enough.
The Delhi line [phone:+91 98765 43210] was busy.
Forward the scans to [email:lab.results@vetlab.example] tonight.
Her address is [email:m.keller@hof-keller.de], not the old one.
Bounced: [email:stock+alerts@farm-news.co.uk] does not exist.
Spell it out: [email:jane dot doe at example dot org] works too.
Anyone may use [email:ovejas@cooperativa.es] for orders.
Merci d'envoyer le tout à [email:c.lefevre@gds-ain.fr] sans tarder.
Rückfragen bitte [email:amt@kreis-nord.de] senden.
Ask [email:helpdesk(at)outbreaks.example.com] for a password.
Backups land at [email:BACKUP@EXAMPLE.NET] every night.
The old list, [email:sheep_owners@lists.example.org], is closed.
""".strip().splitlines()

PLAIN = """
Nothing was found on site after the second visit.
Dr on call changes every week.
The Ministry of Agriculture closed the Northern District on 3 May 2021.
African Swine Fever reached the Upper Valley in autumn.
Between 120 and 340 birds died at the Green Hill Farm.
Lot 4471 left the warehouse at 14:30.
Sample EPI-2231-110-40021 tested negative for Newcastle Disease.
The tag range 555-4715 to 555-290 was read twice.
Figure 3 and Table 12 show weekly totals for 2019-2023.
Der Bericht des Bundesamtes erschien im März 2022.
La Dirección General publicó 45 casos nuevos en Villanova.
Le ministère a confirmé 12 foyers dans la région Nord.
Contact tracing continues; owners were told by letter.
According to the plan, markets reopen on Monday.
ISBN 978-3-16-148410-0 is out of print.
Coordinates 51.507, -0.127 mark the pond.
Permit 88231/2020 covers both holdings.
Temperatures fell from 31 to 12 degrees overnight.
""".strip().splitlines()

_MARK = re.compile(r"\[(email|phone|id_number|street_address|name):([^\]]*)\]")


def cases():
    """(text, {(kind, passage)}) of every sentence."""
    out = []
    for line in SENTENCES:
        spans = {(m[1], m[2]) for m in _MARK.finditer(line) if m[2] != "Mrs"}
        out.append((_MARK.sub(lambda m: m[2], line), spans))
    return out + [(line, set()) for line in PLAIN]
